import datetime as dt
import math


from flowsieve.operators import knowledge, report, triage, windows

COLUMNS = (
    "flow_id bigint, flag int, flow_byts_s double, flow_pkts_s double, fwd_bytes double, "
    "rst_flag double, syn_flag double, flow_duration_s double, total_pkts double"
)


def rows():
    """Unflagged rows with mean 10 and deviation 1 in every measure, then one row per rule."""
    base = [(i, 0, *[9.0 if i % 2 else 11.0] * 6, 50.0) for i in range(100)]
    flagged = {
        # byts, pkts, fwd, rst, syn, dur, total
        101: (20, 10, 10, 10, 10, 10, 50),
        102: (10, 20, 10, 10, 10, 10, 50),
        103: (10, 10, 10, 15, 12, 10, 50),
        104: (10, 10, 10, 15, 10, 10, 5),
        105: (10, 10, 15, 10, 10, 12, 50),
        106: (9, 10, 10, 10, 10, 15, 50),
        107: (10, 10, 10, 10, 10, 10, 50),
        108: (10, 10, 10, 15, 10, 10, 50),
        109: (math.nan, 10, 10, 10, 10, 10, 50),
        110: (math.inf, 10, 10, 10, 10, 10, 50),
        111: (None, 10, 10, 10, 10, 15, 50),
    }
    return base + [(i, 1, *[None if v is None else float(v) for v in f]) for i, f in flagged.items()]


def test_all_rules(spark):
    df = spark.createDataFrame(rows(), COLUMNS)
    found = triage.classify_flagged(df, triage.baseline_stats(df))
    kinds = {r.flow_id: (r.type, r.severity) for r in found.collect()}
    unknown = ("Unknown", "LOW")
    assert kinds == {
        101: ("DDoS / Flood", "CRITICAL"),
        102: ("DDoS / Flood", "CRITICAL"),
        103: ("Port Scan", "HIGH"),
        104: ("Brute Force", "HIGH"),
        105: ("Data Exfiltration", "CRITICAL"),
        106: ("Botnet C&C", "MEDIUM"),
        107: unknown, 108: unknown, 109: unknown, 110: unknown, 111: unknown,
    }


def test_no_baseline_rows_means_no_rule(spark):
    df = spark.createDataFrame([r for r in rows() if r[1] == 1], COLUMNS)
    found = triage.classify_flagged(df, triage.baseline_stats(df))
    assert {r.type for r in found.collect()} == {"Unknown"}


def test_best_per_bucket_and_ranking(spark):
    t = dt.datetime(2024, 1, 15, 10, 0)
    minutes = lambda m: t + dt.timedelta(minutes=m)
    df = spark.createDataFrame(
        [
            (1, minutes(5), "Port Scan", "HIGH", -0.5),
            (2, minutes(2), "Port Scan", "HIGH", -0.5),
            (3, minutes(29), "Port Scan", "HIGH", -0.4),
            (4, minutes(30), "Port Scan", "HIGH", -0.3),
            (5, minutes(1), "Unknown", "LOW", -0.9),
            (6, minutes(1), "DDoS / Flood", "CRITICAL", -0.1),
            (7, minutes(1), "Odd", "OTHER", -1.0),
        ],
        "flow_id bigint, ts timestamp_ntz, type string, severity string, if_score double",
    )
    kept = triage.best_per_bucket(df, ["flow_id"])
    ranked = triage.rank_findings(kept, ["flow_id"]).orderBy("rank").collect()
    assert [r.flow_id for r in ranked] == [6, 2, 4, 5, 7]
    assert [r["rank"] for r in ranked] == [1, 2, 3, 4, 5]
    counts = dict(triage.count_by_type(kept).collect())
    assert counts["Port Scan"] == 2


def test_knowledge_defaults_to_unknown(spark):
    kinds = ["Port Scan", "DDoS / Flood", None, "Traffic Spike", "Night Activity"]
    df = spark.createDataFrame([(k,) for k in kinds], "type string")
    entries = {r.type: r for r in knowledge.enrich(df).collect()}
    assert entries["DDoS / Flood"].entry == entries[None].entry == "Unknown"
    assert entries["DDoS / Flood"].cves == [] and len(entries["DDoS / Flood"].mitigations) == 3
    assert entries["Traffic Spike"].mitre == "T1498 — Network Denial of Service"
    cves = knowledge.type_cves(df)
    assert cves.filter("type = 'DDoS / Flood'").first().cve_id is None
    assert cves.filter("type = 'Port Scan'").count() == 2
    assert knowledge.type_mitigations(df).filter("type = 'Night Activity'").count() == 3
    assert knowledge.knowledge_table(spark).count() == 7


def test_knowledge_given_as_a_table(spark):
    own = knowledge.knowledge_table(spark).filter("type in ('Unknown', 'Port Scan')")
    df = spark.createDataFrame([("Port Scan",), ("Brute Force",)], "type string")
    assert {r.entry for r in knowledge.enrich(df, own).collect()} == {"Port Scan", "Unknown"}


def test_resample_keeps_empty_bins(spark):
    t = dt.datetime(2024, 1, 15, 0, 1)
    df = spark.createDataFrame(
        [(t, 2.0, 3.0, 1.0, -0.5), (t, 4.0, 3.0, 1.0, -0.7), (t + dt.timedelta(minutes=12), 1.0, 1.0, 0.0, -0.2)],
        "ts timestamp_ntz, flow_byts_s double, total_pkts double, rst_flag double, if_score double",
    )
    found = [tuple(r)[1:] for r in windows.resample(df).orderBy("bin").collect()]
    assert found == [(3.0, 6.0, 2.0, -0.7), (0.0, 0.0, 0.0, None), (1.0, 1.0, 0.0, -0.2)]


def test_findings_document(spark):
    t = dt.datetime(2024, 1, 15, 3, 4, 5)
    df = spark.createDataFrame(
        [(t, "a", "Unknown", "LOW", -0.123456, 12.9, 3, 2, 0.33333)],
        "ts timestamp_ntz, src_ip string, type string, severity string, if_score double, "
        "n_bytes double, n_packets bigint, n_dst_ports bigint, failed_ratio double",
    )
    row = report.findings_document(df, df, "x.csv").first()
    assert (row.file, row.records, row.time_range, row.total_anomalies) == (
        "x.csv", 1, "2024-01-15 03:04 – 03:04", 1,
    )
    found = row.anomaly
    assert (found.timestamp, found.if_score, found.n_bytes, found.failed_ratio) == (
        "2024-01-15 03:04:05", -0.1235, 12, 0.3333,
    )
    none = report.findings_document(df.filter("false"), df, "x.csv").first()
    assert none.total_anomalies == 0 and none.anomaly is None
