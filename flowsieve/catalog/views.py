"""What the registered queries share: rounding, and the stand-in views as SQL for the oracle."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowsieve.functions.columns import quoted
from flowsieve.operators import iforest
from flowsieve.plans.detect import squared_z
from flowsieve.session import written
from flowsieve.sources.flows import FEATURES, event_scores, order_flows

CONTAMINATION = 0.10
HIDDEN = ["4-NOT SPECIFIED", "5-LOW", "9-ABSENT"]
CLASSES = ["Normal", "1-URGENT", "2-HIGH"]


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round floating-point columns, so that both engines print the same value."""
    kinds = dict(df.dtypes)
    return df.select(
        *[
            F.round(F.col(quoted(c)), digits).alias(c) if kinds[c] in ("double", "float") else F.col(quoted(c))
            for c in df.columns
        ]
    )


def r(expression: str, name: str | None = None, digits: int = 6) -> str:
    """The same rounding in SQL; adding 0 turns a negative zero into zero."""
    text = f"(round({expression}, {digits}) + 0.0)"
    return f"{text} AS {name or expression}"


def sql(*ctes: str, body: str) -> str:
    return f"WITH {', '.join(c.strip() for c in ctes)} {body}"


ORDER_FLOWS = """
order_flows AS (
  SELECT o_orderkey AS flow_id, o_custkey AS src, o_orderdate AS ts,
         CASE WHEN o_orderkey % 97 = 0 THEN NULL
              WHEN o_orderkey % 101 = 0 THEN CAST('Infinity' AS DOUBLE) ELSE net END AS flow_byts_s,
         flow_pkts_s, fwd_bytes, bwd_bytes, total_pkts, fwd_pkts, bwd_pkts, syn_flag, rst_flag,
         ack_flag, fin_flag, flow_duration_s, pkt_len_mean, pkt_len_std, 0.0::DOUBLE AS const_col,
         CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS true_label,
         o_orderpriority AS category
  FROM orders JOIN (
    SELECT l_orderkey, sum(l_extendedprice * (1 - l_discount)) AS net,
           avg(l_quantity) AS flow_pkts_s, sum(l_extendedprice) AS fwd_bytes,
           sum(l_extendedprice * l_discount) AS bwd_bytes, sum(l_quantity) AS total_pkts,
           sum(CASE WHEN l_linestatus = 'O' THEN l_quantity ELSE 0 END) AS fwd_pkts,
           sum(CASE WHEN l_linestatus <> 'O' THEN l_quantity ELSE 0 END) AS bwd_pkts,
           count(*) FILTER (l_returnflag = 'N')::DOUBLE AS syn_flag,
           count(*) FILTER (l_returnflag = 'R')::DOUBLE AS rst_flag,
           count(*) FILTER (l_returnflag = 'A')::DOUBLE AS ack_flag,
           count(*) FILTER (l_linestatus = 'F')::DOUBLE AS fin_flag,
           date_diff('day', min(l_shipdate), max(l_shipdate))::DOUBLE AS flow_duration_s,
           avg(l_extendedprice) AS pkt_len_mean, stddev_pop(l_extendedprice) AS pkt_len_std
    FROM lineitem GROUP BY l_orderkey) ON o_orderkey = l_orderkey)
"""

EVENT_SCORES = """
event_scores AS (
  SELECT event_id AS id, CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS y, value AS score
  FROM events)
"""

EVENT_SCORE_SET = """
event_score_set AS (
  SELECT event_id AS id, CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS y,
         value AS if_score, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS lof_score,
         value * (CAST(json_extract_string(props, '$.k') AS DOUBLE) + 1) AS recon_score
  FROM events)
"""

EVENT_FLAGGED = f"""
{EVENT_SCORES},
flagged AS (
  SELECT id, y, score, -score AS if_score,
         CASE WHEN -score < (SELECT quantile_cont(-score, {CONTAMINATION}) FROM event_scores)
              THEN 1 ELSE 0 END AS flag
  FROM event_scores)
"""


def finite(column: str) -> str:
    return f"CASE WHEN abs({column}) < CAST('Infinity' AS DOUBLE) THEN {column} END"


def scaled(source: str, name: str, columns: Sequence[str], ids: str, fill: str = "median") -> str:
    """CTEs that impute and standardise ``columns`` of ``source``, as ``name``."""
    inner = ", ".join(f"{finite(c)} AS {c}" for c in columns)
    filled = ", ".join(
        f"coalesce({c}, {f'(SELECT median({c}) FROM {name}_f)' if fill == 'median' else '0'}) AS {c}"
        for c in columns
    )
    stats = ", ".join(f"avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}" for c in columns)
    out = ", ".join(f"({c} - m_{c}) / CASE WHEN s_{c} = 0 THEN 1 ELSE s_{c} END AS {c}" for c in columns)
    return f"""
    {name}_f AS (SELECT {ids}, {inner} FROM {source}),
    {name}_i AS (SELECT {ids}, {filled} FROM {name}_f),
    {name}_s AS (SELECT {stats} FROM {name}_i),
    {name} AS (SELECT {ids}, {out} FROM {name}_i, {name}_s)"""


FLAGGED = f"""
{ORDER_FLOWS},
{scaled("order_flows", "z", FEATURES, "flow_id")},
scores AS (SELECT flow_id, -({" + ".join(f"{c} * {c}" for c in FEATURES)}) AS if_score FROM z),
flagged AS (
  SELECT o.*, if_score,
         CASE WHEN if_score < (SELECT quantile_cont(if_score, {CONTAMINATION}) FROM scores)
              THEN 1 ELSE 0 END AS flag
  FROM order_flows o JOIN scores USING (flow_id))
"""

MEASURES = {
    "byts": "flow_byts_s", "pkts": "flow_pkts_s", "fwd": "fwd_bytes",
    "rst": "rst_flag", "syn": "syn_flag", "dur": "flow_duration_s",
}


def typed(source: str) -> str:
    """CTEs baseline and typed (flagged rows with type and severity) from a flagged table."""
    stats = ", ".join(
        f"avg({finite(c)}) AS {s}_mean, stddev_samp({finite(c)}) AS {s}_sd" for s, c in MEASURES.items()
    )
    z = ", ".join(
        f"({finite(c)} - {s}_mean) / CASE WHEN {s}_sd IS NOT NULL THEN greatest(abs({s}_sd), 1e-9) END"
        f" AS z_{s}"
        for s, c in MEASURES.items()
    )
    rules = [
        ("z_byts > 4 OR z_pkts > 4", "DDoS / Flood", "CRITICAL"),
        ("z_rst > 3 AND z_syn > 1", "Port Scan", "HIGH"),
        ("z_rst > 3 AND total_pkts < pkts_mean", "Brute Force", "HIGH"),
        ("z_fwd > 3 AND z_dur > 1", "Data Exfiltration", "CRITICAL"),
        ("z_dur > 3 AND z_byts < 0", "Botnet C&C", "MEDIUM"),
    ]
    kinds = " ".join(f"WHEN {c} THEN '{t}'" for c, t, _ in rules)
    severities = " ".join(f"WHEN {c} THEN '{s}'" for c, _, s in rules)
    return f"""
    baseline AS (SELECT {stats} FROM {source} WHERE flag = 0),
    z_rows AS (SELECT t.*, pkts_mean, {z} FROM {source} t, baseline WHERE flag = 1),
    typed AS (SELECT *, CASE {kinds} ELSE 'Unknown' END AS type,
                     CASE {severities} ELSE 'LOW' END AS severity FROM z_rows)"""


TYPED = f"{FLAGGED}, {typed('flagged')}"

DEDUPE = """
deduped AS (
  SELECT * FROM (
    SELECT *, time_bucket(INTERVAL '30 minutes', ts) AS bucket,
           row_number() OVER (PARTITION BY type, time_bucket(INTERVAL '30 minutes', ts)
                              ORDER BY if_score, ts, flow_id) AS rn
    FROM typed) WHERE rn = 1)
"""

DEDUPED = f"{TYPED}, {DEDUPE}"

SEVERITY_RANK = (
    "CASE severity WHEN 'CRITICAL' THEN 0 WHEN 'HIGH' THEN 1 WHEN 'MEDIUM' THEN 2 "
    "WHEN 'LOW' THEN 3 ELSE 9 END"
)

STAGED = f"""
{ORDER_FLOWS},
given AS (
  SELECT flow_id AS id, true_label AS y,
         CASE WHEN true_label = 0 THEN 'Normal' ELSE category END AS category,
         CASE WHEN fwd_bytes > 250000 THEN 1 ELSE 0 END AS flag,
         [(syn_flag + 1) / (syn_flag + rst_flag + ack_flag + 3),
          (rst_flag + 1) / (syn_flag + rst_flag + ack_flag + 3),
          (ack_flag + 1) / (syn_flag + rst_flag + ack_flag + 3)] AS probabilities
  FROM order_flows),
staged AS (
  SELECT *, list_max(probabilities) AS confidence,
         ['Normal', '1-URGENT', '2-HIGH'][list_position(probabilities, list_max(probabilities))]
           AS predicted
  FROM given)
"""


def routes(limit: float, name: str = "routed") -> str:
    """CTE with route and final decision at a confidence limit, from ``staged``."""
    path = (
        f"CASE WHEN flag = 0 THEN 'NORMAL' WHEN confidence >= {limit} THEN predicted "
        "ELSE 'ZERO_DAY_QUEUE' END"
    )
    return f"""
{name} AS (
  SELECT *, {path} AS route,
         CASE WHEN {path} IN ('NORMAL', 'Normal') THEN 0 ELSE 1 END AS final FROM staged)
"""


def routed(limit: float) -> str:
    return f"{STAGED}, {routes(limit)}"


def event_flags(spark: SparkSession, folder: str) -> DataFrame:
    df = event_scores(spark, folder).withColumn("if_score", -F.col("score"))
    return df.withColumn("flag", iforest.flag_lowest(df, "if_score", CONTAMINATION).cast("int"))


def flagged_flows(spark: SparkSession, folder: str) -> DataFrame:
    """Order flows with the deterministic score and the lowest-scored fraction flagged."""
    scored = squared_z(written(order_flows(spark, folder), "flows"), FEATURES)
    # The cut needs the scores alone; they follow from the row, so that no row is written again.
    low = iforest.flag_lowest(written(scored.select("if_score"), "scores"), "if_score", CONTAMINATION)
    return scored.withColumn("flag", F.coalesce(low, F.lit(False)).cast("int"))


def staged_flows(spark: SparkSession, folder: str) -> DataFrame:
    """Order flows with a given flag and class probabilities, in place of fitted models."""
    total = F.col("syn_flag") + F.col("rst_flag") + F.col("ack_flag") + 3
    return order_flows(spark, folder).select(
        F.col("flow_id").alias("id"),
        F.col("true_label").alias("y"),
        F.when(F.col("true_label") == 0, "Normal").otherwise(F.col("category")).alias("category"),
        F.when(F.col("fwd_bytes") > 250000, 1).otherwise(0).alias("flag"),
        F.array(*[(F.col(c) + 1) / total for c in ("syn_flag", "rst_flag", "ack_flag")]).alias(
            "probabilities"
        ),
    )


def forest_sql(trees: int, features: Sequence[str], source: str, depth: int = 8, ids: str = "flow_id") -> str:
    """CTEs that build the forest over ``source``: tree_sample, splits, leaves."""
    d = range(len(features))
    f = ", ".join(f"f{k}" for k in d)
    renamed = ", ".join(f"{c} AS f{k}" for k, c in enumerate(features))
    ranges = ", ".join(f"min(f{k}) OVER g AS lo{k}, max(f{k}) OVER g AS hi{k}" for k in d)
    varying = ", ".join(f"CASE WHEN hi{k} > lo{k} THEN {k} END" for k in d)
    los, his = (", ".join(f"{s}{k}" for k in d) for s in ("lo", "hi"))
    parts = [f"""
    m AS MATERIALIZED (SELECT {ids} AS id, {renamed} FROM {source}),
    params AS (SELECT count(*) AS n, least(256, count(*)) AS size,
                      count(*) // least(256, count(*)) AS blocks FROM m),
    laps AS (SELECT unnest(range(0, CAST(ceil({trees} / blocks::DOUBLE) AS BIGINT))) AS lap FROM params),
    placed AS (
      SELECT m.*, lap, row_number() OVER (
               PARTITION BY lap ORDER BY md5(concat_ws(':', id, lap, '42')), id) - 1 AS place
      FROM m, laps),
    l0 AS MATERIALIZED (
      SELECT lap * blocks + place // size AS tree, 1 AS node, {f} FROM placed, params
      WHERE place < blocks * size AND lap * blocks + place // size < {trees})"""]
    for level in range(depth):
        parts.append(f"""
    r{level} AS (SELECT tree, node, {f}, count(*) OVER g AS n, {ranges} FROM l{level}
                 WINDOW g AS (PARTITION BY tree, node)),
    v{level} AS (SELECT *, list_filter([{varying}], lambda x: x IS NOT NULL) AS varying,
                        md5(concat_ws(':', 'split', tree, node, '42')) AS digest FROM r{level}),
    p{level} AS (SELECT *, varying[1 + CAST(floor(CAST('0x' || substr(digest, 1, 8) AS BIGINT)
                        / CAST(4294967296 AS DOUBLE) * len(varying)) AS BIGINT)] AS pick FROM v{level}),
    c{level} AS MATERIALIZED (
      SELECT tree, node, {f}, n, pick, v, CASE WHEN cut >= hi THEN lo ELSE cut END AS threshold
      FROM (SELECT tree, node, {f}, n, pick, [{f}][pick + 1] AS v, [{los}][pick + 1] AS lo,
                   [{his}][pick + 1] AS hi,
                   [{los}][pick + 1] + CAST('0x' || substr(digest, 9, 13) AS BIGINT)
                   / CAST(4503599627370496 AS DOUBLE) * ([{his}][pick + 1] - [{los}][pick + 1]) AS cut
            FROM p{level})),
    l{level + 1} AS (SELECT tree, {f}, CASE WHEN pick IS NULL THEN node WHEN v > threshold
                     THEN 2 * node + 1 ELSE 2 * node END AS node FROM c{level})""")
    splits = " UNION ".join(
        f"SELECT tree, node, n, pick, threshold FROM c{level} WHERE pick IS NOT NULL"
        for level in range(depth)
    )
    parts.append(f"""
    splits AS MATERIALIZED ({splits}),
    leaf_rows AS (SELECT tree, node, count(*) AS n FROM l{depth} GROUP BY tree, node),
    leaves AS MATERIALIZED (
      SELECT tree, node, n, CAST(round(1000000 * (length(bin(node)) - 1 +
        CASE WHEN n <= 1 THEN 0 WHEN n = 2 THEN 1
             ELSE 2 * (ln(n - 1) + 0.5772156649015329::DOUBLE) - 2 * (n - 1) / n::DOUBLE END)) AS BIGINT)
        AS leaf_micro FROM leaf_rows)""")
    return ",".join(parts)


def walk_sql(trees: str, features: Sequence[str], depth: int = 8) -> str:
    """CTEs w0 ... w<depth>: the node of every row in each of ``trees`` (a list expression)."""
    f = ", ".join(f"f{k}" for k in range(len(features)))
    parts = [f"w0 AS (SELECT id, unnest({trees}) AS tree, 1 AS node FROM m)"]
    for level in range(depth):
        parts.append(f"""
    w{level + 1} AS (
      SELECT w.id, w.tree, CASE WHEN s.pick IS NULL THEN w.node
               WHEN [{f}][s.pick + 1] > s.threshold THEN 2 * w.node + 1 ELSE 2 * w.node END AS node
      FROM w{level} w JOIN m USING (id) LEFT JOIN splits s ON s.tree = w.tree AND s.node = w.node)""")
    return ",".join(parts)
