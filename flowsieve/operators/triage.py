"""From flagged rows to ranked, typed findings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from flowsieve.functions.columns import finite_or_null, quoted, z_score

# Measures with a baseline, as (short name, column).
BASELINE_MEASURES = {
    "byts": "flow_byts_s",
    "pkts": "flow_pkts_s",
    "fwd": "fwd_bytes",
    "rst": "rst_flag",
    "syn": "syn_flag",
    "dur": "flow_duration_s",
}

# Severities, most urgent first.
SEVERITIES = ["CRITICAL", "HIGH", "MEDIUM", "LOW"]


def baseline_stats(df: DataFrame, flag: str = "flag") -> DataFrame:
    """One row with mean and sample deviation of each measure over the unflagged rows."""
    return df.filter(F.col(flag) == 0).agg(
        *[
            f(finite_or_null(c)).alias(f"{short}_{name}")
            for short, c in BASELINE_MEASURES.items()
            for name, f in (("mean", F.avg), ("sd", F.stddev_samp))
        ]
    )


def with_z_scores(df: DataFrame, stats: DataFrame) -> DataFrame:
    """Add ``z_<measure>`` and ``pkts_mean`` from the one-row baseline."""
    joined = df.join(F.broadcast(stats), F.lit(True))
    scores = {
        f"z_{short}": z_score(finite_or_null(c), F.col(f"{short}_mean"), F.col(f"{short}_sd"))
        for short, c in BASELINE_MEASURES.items()
    }
    return joined.select(
        *[quoted(c) for c in df.columns], *[e.alias(n) for n, e in scores.items()], "pkts_mean"
    )


def finding_type() -> Column:
    """(type, severity) of the first rule that holds; a NULL z-score holds for no rule."""
    z = {short: F.col(f"z_{short}") for short in BASELINE_MEASURES}

    def finding(kind: str, severity: str) -> Column:
        return F.struct(F.lit(kind).alias("type"), F.lit(severity).alias("severity"))

    # Rules and their thresholds, in order. The packet count is compared with the mean
    # packet rate, as the rule is defined.
    rules = [
        ((z["byts"] > 4) | (z["pkts"] > 4), finding("DDoS / Flood", "CRITICAL")),
        ((z["rst"] > 3) & (z["syn"] > 1), finding("Port Scan", "HIGH")),
        ((z["rst"] > 3) & (F.col("total_pkts") < F.col("pkts_mean")), finding("Brute Force", "HIGH")),
        ((z["fwd"] > 3) & (z["dur"] > 1), finding("Data Exfiltration", "CRITICAL")),
        ((z["dur"] > 3) & (z["byts"] < 0), finding("Botnet C&C", "MEDIUM")),
    ]
    first, *others = rules
    choice = F.when(*first)
    for rule in others:
        choice = choice.when(*rule)
    return choice.otherwise(finding("Unknown", "LOW"))


def classify_flagged(df: DataFrame, stats: DataFrame, flag: str = "flag") -> DataFrame:
    """Type and severity for the flagged rows only."""
    scored = with_z_scores(df.filter(F.col(flag) == 1), stats)
    return scored.withColumn("_f", finding_type()).select(
        *[quoted(c) for c in df.columns], F.col("_f.type"), F.col("_f.severity")
    )


def best_per_bucket(
    findings: DataFrame, ids: Sequence[str], score: str = "if_score", time: str = "ts",
    bucket: str = "30 minutes",
) -> DataFrame:
    """Lowest score per (type, time bucket); earlier time, then lower id, wins ties.

    ``min_by`` over the ordering struct is combined before the shuffle, so one hot bucket costs
    its task one row per upstream task, unlike a window over all rows of the bucket.
    """
    start = F.window(time, bucket)["start"]
    order = F.struct(F.col(score), F.col(time), *[F.col(i) for i in ids])
    row = F.struct(*[quoted(c) for c in findings.columns])
    return (
        findings.groupBy("type", start.alias("bucket"))
        .agg(F.min_by(row, order).alias("_row"))
        .select("_row.*", "bucket")
    )


def severity_rank(column: str = "severity") -> Column:
    rank = F.lit(len(SEVERITIES) + 5)
    for place, name in reversed(list(enumerate(SEVERITIES))):
        rank = F.when(F.col(column) == name, F.lit(place)).otherwise(rank)
    return rank


def rank_findings(
    findings: DataFrame, ids: Sequence[str], score: str = "if_score", name: str = "rank", time: str = "ts"
) -> DataFrame:
    """Number findings by severity, then score; earlier time, then lower id, wins ties.

    For deduplicated findings, whose number is bounded by types times time buckets.
    """
    order = W.orderBy(severity_rank(), F.col(score), F.col(time), *[F.col(i) for i in ids])
    return findings.withColumn(name, F.row_number().over(order).cast("bigint"))


def count_by_type(findings: DataFrame) -> DataFrame:
    return findings.groupBy("type").agg(F.count(F.lit(1)).alias("findings"))


def by_time(findings: DataFrame, ids: Sequence[str], time: str = "ts") -> DataFrame:
    """Findings in time order (a range-partitioned sort)."""
    return findings.orderBy(time, *ids)
