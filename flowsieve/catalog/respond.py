"""Registered queries: triage, knowledge, routing and time windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowsieve.catalog.detect import EXPECTED, PATHS, TREES
from flowsieve.catalog.views import (
    CLASSES,
    DEDUPE,
    DEDUPED,
    HIDDEN,
    MEASURES,
    SEVERITY_RANK,
    TYPED,
    event_flags,
    EVENT_FLAGGED,
    flagged_flows,
    forest_sql,
    r,
    rounded,
    routed,
    scaled,
    sql,
    staged_flows,
    typed,
    walk_sql,
)
from flowsieve.operators import iforest, knowledge, report, routing, triage, windows
from flowsieve.plans import detect
from flowsieve.session import scratch_path, written
from flowsieve.sources import tables
from flowsieve.sources.flows import FEATURES, event_records, order_flows

QUERIES = {}
SQL = {}


def query(name: str, oracle: str | None = None):
    def register(function):
        QUERIES[name] = function
        if oracle:
            SQL[name] = oracle
        return function

    return register


def text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def typed_findings(spark, folder):
    flagged = flagged_flows(spark, folder)
    return triage.classify_flagged(flagged, triage.baseline_stats(flagged))


def deduplicated(spark, folder):
    return triage.best_per_bucket(typed_findings(spark, folder), ["flow_id"])


@query(
    "e1_baseline_stats",
    sql(TYPED, body="SELECT " + ", ".join(
        r(f"{s}_{m}", f"{s}_{m}", 4) for s in MEASURES for m in ("mean", "sd")) + " FROM baseline"),
)
def baseline_stats(spark, folder):
    return rounded(triage.baseline_stats(flagged_flows(spark, folder)), 4)


@query(
    "e2_z_scores",
    sql(TYPED, body=f"SELECT flow_id, {', '.join(r(f'z_{s}') for s in MEASURES)} FROM z_rows"),
)
def z_scores(spark, folder):
    flagged = flagged_flows(spark, folder)
    scored = triage.with_z_scores(flagged.filter("flag = 1"), triage.baseline_stats(flagged))
    return rounded(scored.select("flow_id", *[f"z_{s}" for s in MEASURES]))


@query(
    "e3_finding_types",
    sql(TYPED, body=f"SELECT flow_id, type, severity, {r('if_score')} FROM typed"),
)
def finding_types(spark, folder):
    return rounded(typed_findings(spark, folder).select("flow_id", "type", "severity", "if_score"))


@query(
    "e4_best_per_bucket",
    sql(DEDUPED, body=f"SELECT flow_id, type, bucket, {r('if_score')} FROM deduped"),
)
def best_per_bucket(spark, folder):
    return rounded(deduplicated(spark, folder).select("flow_id", "type", "bucket", "if_score"))


RANK = f"""
ranked AS (SELECT *, row_number() OVER (ORDER BY {SEVERITY_RANK}, if_score, ts, flow_id) AS "rank"
           FROM deduped)
"""
RANKED = f"{DEDUPED}, {RANK}"


@query(
    "e5_ranked_findings",
    sql(RANKED, body=f'SELECT flow_id, type, severity, "rank", {r("if_score")} FROM ranked'),
)
def ranked_findings(spark, folder):
    ranked = triage.rank_findings(deduplicated(spark, folder), ["flow_id"])
    return rounded(ranked.select("flow_id", "type", "severity", "rank", "if_score"))


@query("e6_findings_by_type", sql(DEDUPED, body="SELECT type, count(*) AS findings FROM deduped GROUP BY type"))
def findings_by_type(spark, folder):
    return triage.count_by_type(deduplicated(spark, folder))


KB = "kb(entry, description, mitre, n_cves, worst_cvss, n_mitigations) AS (VALUES " + ", ".join(
    f"({text(t)}, {text(d)}, {text(m)}, {len(c)}, {max((x[2] for x in c), default='NULL')}::DOUBLE, {len(f)})"
    for t, d, m, c, f in knowledge.KNOWLEDGE
) + ")"
KB_CVES = "kb_cves(entry, cve_rank, cve_id, summary, cvss) AS (VALUES " + ", ".join(
    f"({text(t)}, {i}, {text(c[0])}, {text(c[1])}, {c[2]}::DOUBLE)"
    for t, _, _, cves, _ in knowledge.KNOWLEDGE for i, c in enumerate(cves, 1)
) + ")"
KB_STEPS = "kb_steps(entry, step, mitigation) AS (VALUES " + ", ".join(
    f"({text(t)}, {i}, {text(m)})"
    for t, _, _, _, steps in knowledge.KNOWLEDGE for i, m in enumerate(steps, 1)
) + ")"
ENTRY = "CASE WHEN type IN (SELECT entry FROM kb) THEN type ELSE 'Unknown' END"


def with_knowledge(findings):
    return knowledge.enrich(findings).select(
        *findings.columns,
        "entry",
        "description",
        "mitre",
        F.size("cves").alias("n_cves"),
        F.array_max("cves.cvss").alias("worst_cvss"),
        F.size("mitigations").alias("n_mitigations"),
    )


@query(
    "e7_knowledge_lookup",
    sql(TYPED, KB, f"e AS (SELECT flow_id, type, {ENTRY} AS entry FROM typed)",
        body="SELECT flow_id, type, entry, description, mitre, n_cves, worst_cvss, n_mitigations "
             "FROM e JOIN kb USING (entry)"),
)
def knowledge_lookup(spark, folder):
    return with_knowledge(typed_findings(spark, folder).select("flow_id", "type"))


@query(
    "e8_type_cves",
    sql(TYPED, KB, KB_CVES, f"e AS (SELECT DISTINCT type, {ENTRY} AS entry FROM typed)", body="""
    SELECT type, entry, mitre, cve_rank, cve_id, summary, cvss
    FROM e JOIN kb USING (entry) LEFT JOIN kb_cves USING (entry)"""),
)
def type_cves(spark, folder):
    return knowledge.type_cves(typed_findings(spark, folder))


@query(
    "e8_type_mitigations",
    sql(TYPED, KB, KB_STEPS, f"e AS (SELECT DISTINCT type, {ENTRY} AS entry FROM typed)",
        body="SELECT type, step, mitigation FROM e JOIN kb_steps USING (entry)"),
)
def type_mitigations(spark, folder):
    return knowledge.type_mitigations(typed_findings(spark, folder))


def routed_flows(spark, folder, limit):
    names = F.array(*[F.lit(c) for c in CLASSES])
    staged = staged_flows(spark, folder).select(
        "id", "y", "category", "flag",
        routing.predicted_class(F.col("probabilities"), names).alias("predicted"),
        routing.confidence(F.col("probabilities")).alias("confidence"),
    )
    return routing.route(staged, limit)


ROUTED = routed(0.60)
ROUTED_HOLD_OUT = routed(0.55)
HIDDEN_SQL = ", ".join(f"'{h}'" for h in HIDDEN)


@query("e9_routes", sql(ROUTED, body=f"SELECT id, flag, predicted, {r('confidence')}, route, final FROM routed"))
def routes(spark, folder):
    df = routed_flows(spark, folder, routing.CONFIDENCE)
    return rounded(df.select("id", "flag", "predicted", "confidence", "route", "final"))


@query(
    "e9_routes_hold_out",
    sql(ROUTED_HOLD_OUT, body="SELECT route, count(*) AS n FROM routed GROUP BY route"),
)
def routes_hold_out(spark, folder):
    df = routed_flows(spark, folder, routing.HOLD_OUT_CONFIDENCE)
    return df.groupBy("route").agg(F.count(F.lit(1)).alias("n"))


@query(
    "e10_queue_quality",
    sql(ROUTED, f"""
    q AS (SELECT count(*) AS queued, count(*) FILTER (y = 1) AS attacks,
                 count(*) FILTER (y = 0) AS false_alarms,
                 count(*) FILTER (category IN ({HIDDEN_SQL})) AS hidden
          FROM routed WHERE route = 'ZERO_DAY_QUEUE')""", body=f"""
    SELECT queued, attacks, false_alarms, hidden, {r("attacks / (queued + 1e-9)", "precision")},
           {r("CASE WHEN queued = 0 THEN 0 ELSE hidden / queued::DOUBLE END", "hidden_share")} FROM q"""),
)
def queue_quality(spark, folder):
    return rounded(routing.queue_quality(routed_flows(spark, folder, routing.CONFIDENCE), HIDDEN))


@query(
    "e11_queue_composition",
    sql(ROUTED, body=f"""
    SELECT category, count(*) AS queued,
           {r("100.0 * count(*) / sum(count(*)) OVER ()", "share_pct")},
           CASE WHEN category IN ({HIDDEN_SQL}) THEN 1 ELSE 0 END AS is_hidden
    FROM routed WHERE route = 'ZERO_DAY_QUEUE' GROUP BY category"""),
)
def queue_composition(spark, folder):
    return rounded(routing.queue_composition(routed_flows(spark, folder, routing.CONFIDENCE), HIDDEN))


@query(
    "e11_attacks_in_queue",
    sql(ROUTED, body=f"""
    SELECT category, count(*) AS queued,
           {r("100.0 * count(*) / sum(count(*)) OVER ()", "share_pct")},
           CASE WHEN category IN ({HIDDEN_SQL}) THEN 1 ELSE 0 END AS is_hidden
    FROM routed WHERE route = 'ZERO_DAY_QUEUE' AND y = 1 GROUP BY category"""),
)
def attacks_in_queue(spark, folder):
    routed = routed_flows(spark, folder, routing.CONFIDENCE)
    return rounded(routing.queue_composition(routed, HIDDEN, attacks_only=True))


def routing_by_class_sql(hidden: str) -> str:
    known = f"route = category AND category NOT IN ({hidden})"
    return sql(ROUTED, f"""
    per AS (SELECT category, count(*) AS flagged, count(*) FILTER ({known}) AS known,
                   count(*) FILTER (route = 'ZERO_DAY_QUEUE') AS queued
            FROM routed WHERE flag = 1 AND category <> 'Normal' GROUP BY category)""", body=f"""
    SELECT category, flagged, known, queued, flagged - known - queued AS rest,
           {r("100.0 * known / flagged", "known_pct")}, {r("100.0 * queued / flagged", "queued_pct")} FROM per""")


@query("e12_routing_by_class", routing_by_class_sql("''"))
def routing_by_class(spark, folder):
    return rounded(routing.routing_by_class(routed_flows(spark, folder, routing.CONFIDENCE)))


@query("e12_routing_with_hidden", routing_by_class_sql("'1-URGENT'"))
def routing_with_hidden(spark, folder):
    """A hidden class is never known, whatever it was taken for."""
    routed = routed_flows(spark, folder, routing.CONFIDENCE)
    return rounded(routing.routing_by_class(routed, ["1-URGENT"]))


@query(
    "e13_hidden_detection",
    sql(ROUTED, "h(category) AS (VALUES " + ", ".join(f"('{h}')" for h in HIDDEN) + ")", """
    c AS (SELECT h.category, count(id) AS total, count(id) FILTER (flag = 1) AS flagged,
                 count(id) FILTER (route = 'ZERO_DAY_QUEUE') AS queued
          FROM h LEFT JOIN routed USING (category) GROUP BY h.category)""", body=f"""
    SELECT category, total, flagged, queued,
           {r("100.0 * flagged / greatest(total, 1)", "flagged_pct")},
           {r("100.0 * queued / greatest(total, 1)", "queued_pct")} FROM c"""),
)
def hidden_detection(spark, folder):
    return rounded(routing.hidden_detection(routed_flows(spark, folder, routing.CONFIDENCE), HIDDEN))


@query(
    "e14_false_alarm_reduction",
    sql(ROUTED, """
    c AS (SELECT count(*) FILTER (y = 0 AND flag = 1) AS stage1_fp,
                 count(*) FILTER (y = 0 AND final = 1) AS final_fp FROM routed)""",
        body=f"SELECT stage1_fp, final_fp, {r('1 - final_fp / greatest(stage1_fp, 1)::DOUBLE', 'reduction')} FROM c"),
)
def false_alarm_reduction(spark, folder):
    return rounded(routing.false_alarm_reduction(routed_flows(spark, folder, routing.CONFIDENCE)))


@query("e15_findings_by_time", sql(TYPED, body="SELECT ts, flow_id, type FROM typed ORDER BY ts, flow_id"))
def findings_by_time(spark, folder):
    return triage.by_time(typed_findings(spark, folder), ["flow_id"]).select("ts", "flow_id", "type")


@query(
    "e16_resample",
    f"""
    WITH rows AS (
      SELECT time_bucket(INTERVAL '5 minutes', ts) AS bin, value,
             CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k,
             CASE WHEN event_type = 'error' THEN 1.0 ELSE 0.0 END AS failed FROM events),
    bins AS (SELECT bin, avg(value) AS mean_rate, sum(k) AS packets, sum(failed) AS resets,
                    min(-value) AS min_score FROM rows GROUP BY bin),
    every AS (SELECT unnest(generate_series((SELECT min(bin) FROM rows), (SELECT max(bin) FROM rows),
                     INTERVAL '5 minutes')) AS bin)
    SELECT bin, {r("coalesce(mean_rate, 0)", "mean_rate")}, {r("coalesce(packets, 0)", "packets")},
           {r("coalesce(resets, 0)::DOUBLE", "resets")}, {r("min_score")}
    FROM every LEFT JOIN bins USING (bin)""",
)
def resample(spark, folder):
    events = tables.table(spark, folder, "events").select(
        "ts",
        F.col("value").alias("flow_byts_s"),
        F.get_json_object("props", "$.k").cast("double").alias("total_pkts"),
        F.when(F.col("event_type") == "error", 1.0).otherwise(0.0).alias("rst_flag"),
        (-F.col("value")).alias("if_score"),
    )
    return rounded(windows.resample(events))


@query(
    "e17_time_range",
    """SELECT count(*) AS records, strftime(min(ts), '%Y-%m-%d %H:%M') || ' – ' ||
              strftime(max(ts), '%H:%M') AS time_range FROM events""",
)
def time_range(spark, folder):
    return windows.time_range(tables.table(spark, folder, "events"))


def window_sql(interval: str) -> str:
    return f"""
windowed AS (
  SELECT time_bucket(INTERVAL '{interval}', ts) AS window_start, user_id AS src,
         sum(value) AS n_bytes, count(*) AS n_packets, count(DISTINCT event_type) AS n_dst_ports,
         avg(CASE WHEN event_type = 'error' THEN 1.0 ELSE 0.0 END) AS failed_ratio
  FROM events GROUP BY ALL)
"""


WINDOW_COLUMNS = f"window_start, src, {r('n_bytes')}, n_packets, n_dst_ports, {r('failed_ratio')}"


@query("e18_window_features_5min", sql(window_sql("5 minutes"), body=f"SELECT {WINDOW_COLUMNS} FROM windowed"))
def window_features_5min(spark, folder):
    return rounded(windows.window_features(event_records(spark, folder)))


@query("e18_window_features_10min", sql(window_sql("10 minutes"), body=f"SELECT {WINDOW_COLUMNS} FROM windowed"))
def window_features_10min(spark, folder):
    return rounded(windows.window_features(event_records(spark, folder), "10 minutes"))


@query("e18_window_features_1h", sql(window_sql("1 hour"), body=f"SELECT {WINDOW_COLUMNS} FROM windowed"))
def window_features_1h(spark, folder):
    return rounded(windows.window_features(event_records(spark, folder), "1 hour"))


@query(
    "e19_row_counts",
    sql(EVENT_FLAGGED, body="""
    SELECT y AS "class", count(*) AS n, count(*) FILTER (flag = 1) AS flagged FROM flagged GROUP BY y"""),
)
def row_counts(spark, folder):
    return report.row_counts(event_flags(spark, folder))


WINDOW_FEATURES = detect.WINDOW_FEATURES
FOREST_SCORES = f"""
{scaled("keyed", "z", WINDOW_FEATURES, "window_id", "zero")},
{forest_sql(TREES, WINDOW_FEATURES, "z", ids="window_id")}, {walk_sql(f"range({TREES})", WINDOW_FEATURES)},
scores AS (
  SELECT w8.id AS window_id, -pow(2.0::DOUBLE, -sum(leaf_micro) / {iforest.MICRO * TREES}::DOUBLE
                                               / {EXPECTED!r}) AS if_score
  FROM w8 JOIN leaves USING (tree, node) GROUP BY w8.id)
"""
PLAIN_SCORES = f"""
{scaled("keyed", "z", WINDOW_FEATURES, "window_id")},
scores AS (SELECT window_id, -({" + ".join(f"{c} * {c}" for c in WINDOW_FEATURES)}) AS if_score FROM z)
"""


def window_flags(window: str, scores: str) -> str:
    return f"""
{window_sql(window)},
keyed AS (SELECT *, concat_ws('@', src, strftime(window_start, '%Y-%m-%d %H:%M:%S')) AS window_id,
                 window_start AS ts FROM windowed),
{scores},
flagged AS (
  SELECT k.*, if_score, n_bytes AS flow_byts_s, n_packets AS flow_pkts_s, n_bytes AS fwd_bytes,
         failed_ratio AS rst_flag, n_dst_ports AS syn_flag, 0.0::DOUBLE AS flow_duration_s,
         n_packets AS total_pkts,
         CASE WHEN if_score < (SELECT quantile_cont(if_score, 0.02) FROM scores) THEN 1 ELSE 0 END AS flag
  FROM keyed k JOIN scores USING (window_id)),
{typed("flagged")}
"""


RECORD = f"""strftime(ts, '%Y-%m-%d %H:%M:%S') AS "timestamp", src AS src_ip, type, severity,
           {r("if_score", digits=4)}, {r("failed_ratio", digits=4)},
           CAST(trunc(n_bytes) AS BIGINT) AS n_bytes, n_packets, n_dst_ports"""


@query(
    "a6_findings_document",
    sql(window_flags("5 minutes", FOREST_SCORES), body=f"""
    SELECT 'events' AS file, (SELECT count(*) FROM events) AS records,
           (SELECT strftime(min(ts), '%Y-%m-%d %H:%M') || ' – ' || strftime(max(ts), '%H:%M')
            FROM events) AS time_range,
           count(*) OVER () AS total_anomalies, {RECORD} FROM typed"""),
)
def findings_document(spark, folder):
    """The nested result, its findings spread out into columns for comparison."""
    events = event_records(spark, folder)
    document = report.findings_document(detect.analyze(events), events, "events")
    return document.select("*", "anomaly.*").drop("anomaly")


@query(
    "a6_plain_findings",
    sql(window_flags("1 hour", PLAIN_SCORES), body=f"SELECT {RECORD} FROM typed"),
)
def plain_findings(spark, folder):
    """Hourly windows with the plain score."""
    found = detect.analyze(event_records(spark, folder), "1 hour", forest=False)
    return report.finding_records(found)


@query(
    "a7_written_findings",
    sql(window_flags("5 minutes", FOREST_SCORES), body=f"SELECT {RECORD} FROM typed"),
)
def written_findings(spark, folder):
    """Write the findings as JSON lines and read them back."""
    records = report.finding_records(detect.analyze(event_records(spark, folder)))
    path = scratch_path(spark, "findings")
    tables.write_findings(records, path)
    return tables.read_findings(spark, path, records.schema)


@query(
    "triage_report",
    sql(RANKED, KB, f"e AS (SELECT *, {ENTRY} AS entry FROM ranked)", body=f"""
    SELECT flow_id, ts, bucket, type, severity, "rank", {r("if_score")}, {r("total_pkts")},
           {r("fwd_bytes")}, true_label, entry, mitre, n_cves, worst_cvss
    FROM e JOIN kb USING (entry)"""),
)
def triage_report(spark, folder):
    """Flagged flows, typed, the worst per type and half hour, ranked and explained."""
    found = detect.ranked_findings(flagged_flows(spark, folder), "flow_id")
    return rounded(
        found.select(
            "flow_id", "ts", "bucket", "type", "severity", "rank", "if_score", "total_pkts",
            "fwd_bytes", "true_label", "entry", "mitre", F.size("cves").alias("n_cves"),
            F.array_max("cves.cvss").alias("worst_cvss"),
        )
    )


FOREST_FLAGGED = f"""
{PATHS},
forest_scores AS (
  SELECT flow_id, -pow(2.0::DOUBLE, -mean_path / {EXPECTED!r}) AS if_score FROM paths),
flagged AS (
  SELECT o.*, if_score,
         CASE WHEN if_score < (SELECT quantile_cont(if_score, 0.4) FROM forest_scores)
              THEN 1 ELSE 0 END AS flag
  FROM order_flows o JOIN forest_scores USING (flow_id))
"""


@query(
    "forest_triage_report",
    sql(FOREST_FLAGGED, typed("flagged"), DEDUPE, RANK, KB, f"e AS (SELECT *, {ENTRY} AS entry FROM ranked)",
        body=f"""
    SELECT flow_id, ts, type, severity, "rank", {r("if_score")}, entry, mitre FROM e JOIN kb USING (entry)"""),
)
def forest_triage_report(spark, folder):
    """The same with isolation forest scores and 40 % of the flows flagged."""
    flows = written(order_flows(spark, folder), "flows")
    flagged = detect.flag_scored(detect.forest_scores(flows, FEATURES, "flow_id"), 0.40)
    found = detect.ranked_findings(flagged, "flow_id")
    return rounded(found.select("flow_id", "ts", "type", "severity", "rank", "if_score", "entry", "mitre"))
