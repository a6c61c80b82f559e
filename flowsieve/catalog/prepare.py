"""Registered queries: sources, sampling and feature preparation."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowsieve.catalog.views import (
    EVENT_SCORES,
    HIDDEN,
    ORDER_FLOWS,
    finite,
    flagged_flows,
    r,
    rounded,
    scaled,
    sql,
    FLAGGED,
)
from flowsieve.functions.columns import (
    finite_or_null,
    finite_or_zero,
    not_below_zero,
    number_or_zero,
)
from flowsieve.operators import ordering, prep, routing
from flowsieve.session import scratch_path, written
from flowsieve.sources import flows, tables
from flowsieve.sources.flows import FEATURES, FLOW_FILE_COLUMNS, order_flows

QUERIES = {}
SQL = {}


def query(name: str, oracle: str | None = None):
    def register(function):
        QUERIES[name] = function
        if oracle:
            SQL[name] = oracle
        return function

    return register


SHORT = {c: c.lower().replace(" ", "_").replace("/", "_per_") for c in FLOW_FILE_COLUMNS}
FILE_SQL = f"""
{ORDER_FLOWS},
file_rows AS (
  SELECT flow_id, flow_byts_s AS flow_byts_per_s, flow_pkts_s AS flow_pkts_per_s,
         fwd_bytes AS totlen_fwd_pkts, bwd_bytes AS totlen_bwd_pkts, fwd_pkts AS tot_fwd_pkts,
         bwd_pkts AS tot_bwd_pkts, syn_flag AS syn_flag_cnt, rst_flag AS rst_flag_cnt,
         fin_flag AS fin_flag_cnt, ack_flag AS ack_flag_cnt,
         flow_duration_s * 1000000 AS flow_duration, pkt_len_mean, pkt_len_std,
         fwd_pkts / greatest(flow_duration_s, 1) AS fwd_pkts_per_s,
         bwd_pkts / greatest(flow_duration_s, 1) AS bwd_pkts_per_s, true_label AS label
  FROM order_flows)
"""


@query(
    "a1_scan_csv",
    sql(FILE_SQL, body=f"""
    SELECT flow_id, label, CASE WHEN flow_byts_per_s = CAST('Infinity' AS DOUBLE) THEN 1 ELSE 0 END
             AS infinite,
           {r(finite("flow_byts_per_s"), "flow_byts_per_s")},
           {", ".join(r(s, digits=12) for s in list(SHORT.values())[1:] if s.endswith("wd_pkts_per_s"))},
           {", ".join(r(s) for s in list(SHORT.values())[1:] if not s.endswith("wd_pkts_per_s"))}
    FROM file_rows"""),
)
def scan_csv(spark, folder):
    path = scratch_path(spark, "flow-file")
    rows = flows.flow_file_rows(order_flows(spark, folder))
    rows.write.option("header", True).csv(path)
    df = tables.scan_csv(spark, path, flows.flow_file_schema())
    rate = F.col("`Flow Byts/s`")
    # Rates per day are rounded finely enough to stay clear of halves.
    fine = {SHORT[c] for c in ("Fwd Pkts/s", "Bwd Pkts/s")}
    named = rounded(
        df.select(
            "flow_id",
            F.col("Label").alias("label"),
            F.when(rate == float("inf"), 1).otherwise(0).alias("infinite"),
            finite_or_null(rate).alias(SHORT["Flow Byts/s"]),
            *[F.col(f"`{c}`").alias(SHORT[c]) for c in FLOW_FILE_COLUMNS[1:]],
        ),
        12,
    )
    return named.withColumns({c: F.round(c, 6) for c in SHORT.values() if c not in fine})


@query(
    "a2_union_classes",
    sql(ORDER_FLOWS, body=f"SELECT flow_id, true_label, {r('fwd_bytes')} FROM order_flows"),
)
def union_classes(spark, folder):
    rows = order_flows(spark, folder).select("flow_id", "fwd_bytes", "true_label")
    attack, normal = (rows.filter(F.col("true_label") == k).drop("true_label") for k in (1, 0))
    return rounded(tables.union_classes([(attack, 1), (normal, 0)]))


@query(
    "a3_resolve_label",
    "SELECT doc_id, n_chars, toxic AS true_label FROM documents JOIN labels USING (doc_id)",
)
def resolve_label(spark, folder):
    df = tables.resolve_label(flows.labelled_documents(spark, folder))
    return df.select("doc_id", "n_chars", F.col("true_label").cast("int").alias("true_label"))


@query(
    "a4_drop_columns",
    sql(ORDER_FLOWS, body=f"SELECT flow_id, {', '.join(r(c) for c in FEATURES[1:])} FROM order_flows"),
)
def drop_columns(spark, folder):
    df = order_flows(spark, folder)
    drop = [
        "src", "ts", "flow_byts_s", "fwd_pkts", "bwd_pkts", "ack_flag", "pkt_len_std",
        "const_col", "true_label", "category",
    ]
    return rounded(df.select(*tables.feature_columns(df, drop)))


@query(
    "a5_numeric_columns",
    "SELECT event_id, user_id, (round(value, 6) + 0.0) AS value FROM events",
)
def numeric_columns(spark, folder):
    df = tables.table(spark, folder, "events")
    return rounded(df.select(*tables.numeric_columns(df)))


SAMPLE = """
SELECT flow_id, true_label FROM (
  SELECT flow_id, true_label, row_number() OVER (
           PARTITION BY true_label ORDER BY md5(concat_ws(':', flow_id, '42')), flow_id) AS rn
  FROM order_flows) WHERE rn <= 6000
"""


@query("b1_sample_per_class", sql(ORDER_FLOWS, body=SAMPLE))
def sample_per_class(spark, folder):
    rows = written(order_flows(spark, folder).select("flow_id", "true_label"), "flows")
    marked = ordering.hash_quota(rows, ["flow_id"], F.lit(6000), by=["true_label"])
    return marked.filter("taken").drop("taken")


@query(
    "b2_shuffle",
    sql(ORDER_FLOWS, body="""
    SELECT flow_id, row_number() OVER (ORDER BY md5(concat_ws(':', flow_id, '42')), flow_id) - 1
             AS position FROM order_flows"""),
)
def shuffle(spark, folder):
    return ordering.hash_positions(order_flows(spark, folder).select("flow_id"), ["flow_id"])


SPLIT = """
split AS (
  SELECT *, CASE WHEN row_number() OVER (
                        PARTITION BY true_label ORDER BY md5(concat_ws(':', flow_id, '42')), flow_id)
                      <= floor(0.3 * count(*) OVER (PARTITION BY true_label)) THEN 1 ELSE 0 END AS is_test
  FROM order_flows)
"""


def split_flows(df):
    quota = F.floor(F.lit(0.3) * F.col("group_rows"))
    marked = ordering.hash_quota(df, ["flow_id"], quota, by=["true_label"], name="_t")
    return marked.withColumn("is_test", F.col("_t").cast("int")).drop("_t")


@query(
    "b3_stratified_split",
    sql(ORDER_FLOWS, SPLIT, body="SELECT flow_id, true_label, is_test FROM split"),
)
def stratified_split(spark, folder):
    return split_flows(order_flows(spark, folder).select("flow_id", "true_label"))


@query(
    "b4_spread_over_day",
    sql(ORDER_FLOWS, body="""
    SELECT flow_id, TIMESTAMP '2024-01-15 00:00:00' + to_microseconds(CAST(
             (row_number() OVER (ORDER BY md5(concat_ws(':', flow_id, '42')), flow_id) - 1)
             * round_even(86400000000 / CAST(count(*) OVER () AS DOUBLE), 0) AS BIGINT)) AS "timestamp"
    FROM order_flows"""),
)
def spread_over_day(spark, folder):
    return prep.spread_over_day(order_flows(spark, folder).select("flow_id"), ["flow_id"])


@query(
    "b5_benign_rows",
    sql(ORDER_FLOWS, body=f"SELECT flow_id, {r('fwd_bytes')} FROM order_flows WHERE true_label = 0"),
)
def benign_rows(spark, folder):
    df = order_flows(spark, folder).filter(F.col("true_label") == 0)
    return rounded(df.select("flow_id", "fwd_bytes"))


@query(
    "b6_class_hold_out",
    sql(FLAGGED, body=f"""
    SELECT flow_id, category FROM flagged
    WHERE flag = 1 AND category NOT IN ({", ".join(f"'{h}'" for h in HIDDEN)})"""),
)
def class_hold_out(spark, folder):
    df = flagged_flows(spark, folder)
    return routing.hold_out(df, "category", HIDDEN, "flag").select("flow_id", "category")


@query(
    "c1_text_to_number",
    sql(FILE_SQL, body=f"""
    SELECT flow_id, CASE WHEN flow_byts_per_s = CAST('Infinity' AS DOUBLE) THEN 1 ELSE 0 END AS infinite,
           {r(f"CASE WHEN flow_byts_per_s IS NULL THEN 0 ELSE {finite('flow_byts_per_s')} END", "flow_byts_per_s")},
           {r("totlen_fwd_pkts")}, {r("flow_duration")} FROM file_rows"""),
)
def text_to_number(spark, folder):
    rows = flows.flow_file_rows(order_flows(spark, folder))
    rate = number_or_zero("Flow Byts/s")
    return rounded(
        rows.select(
            "flow_id",
            F.when(rate == float("inf"), 1).otherwise(0).alias("infinite"),
            finite_or_null(rate).alias("flow_byts_per_s"),
            number_or_zero("TotLen Fwd Pkts").alias("totlen_fwd_pkts"),
            number_or_zero("Flow Duration").alias("flow_duration"),
        )
    )


@query(
    "c2_clip_at_zero",
    sql(ORDER_FLOWS, body=f"""
    SELECT flow_id, {r("greatest(coalesce(" + finite("flow_byts_s") + ", 0) - 150000, 0)", "above")}
    FROM order_flows"""),
)
def clip_at_zero(spark, folder):
    shifted = finite_or_zero("flow_byts_s") - 150000
    return rounded(order_flows(spark, folder).select("flow_id", not_below_zero(shifted).alias("above")))


@query(
    "c3_featurise",
    sql(FILE_SQL, body=f"""
    SELECT flow_id, {r(f"CASE WHEN flow_byts_per_s IS NULL THEN 0 ELSE {finite('flow_byts_per_s')} END", "flow_byts_s")},
           {r("flow_pkts_per_s", "flow_pkts_s")}, {r("totlen_fwd_pkts", "fwd_bytes")},
           {r("totlen_bwd_pkts", "bwd_bytes")}, {r("tot_fwd_pkts + tot_bwd_pkts", "total_pkts")},
           {r("syn_flag_cnt", "syn_flag")}, {r("rst_flag_cnt", "rst_flag")},
           {r("fin_flag_cnt", "fin_flag")}, {r("flow_duration / 1000000", "flow_duration_s")},
           {r("pkt_len_mean")}
    FROM file_rows"""),
)
def featurise(spark, folder):
    df = prep.featurise(flows.flow_file_rows(order_flows(spark, folder)), ["flow_id"])
    return rounded(df.withColumn("flow_byts_s", finite_or_null("flow_byts_s")))


@query(
    "c4_infinity",
    sql(ORDER_FLOWS, body=f"""
    SELECT flow_id, {r(finite("flow_byts_s"), "as_null")},
           {r("coalesce(" + finite("flow_byts_s") + ", 0)", "as_zero")} FROM order_flows"""),
)
def infinity(spark, folder):
    return rounded(
        order_flows(spark, folder).select(
            "flow_id",
            finite_or_null("flow_byts_s").alias("as_null"),
            finite_or_zero("flow_byts_s").alias("as_zero"),
        )
    )


FINITE = f"finite AS (SELECT flow_id, true_label, {finite('flow_byts_s')} AS rate, fwd_bytes FROM order_flows)"


@query(
    "c5_median_impute",
    sql(ORDER_FLOWS, FINITE, body=f"""
    SELECT flow_id, {r("coalesce(rate, (SELECT median(rate) FROM finite))", "flow_byts_s")} FROM finite"""),
)
def median_impute(spark, folder):
    df = written(order_flows(spark, folder).select("flow_id", "flow_byts_s"), "flows")
    fill = prep.fit_medians(df, ["flow_byts_s"])["flow_byts_s"]
    value = F.coalesce(finite_or_null("flow_byts_s"), F.lit(fill))
    return rounded(df.select("flow_id", value.alias("flow_byts_s")))


@query(
    "c6_own_medians",
    sql(ORDER_FLOWS, SPLIT, f"""
    test AS (SELECT flow_id, {finite('flow_byts_s')} AS rate FROM split WHERE is_test = 1)""",
    body=f"""
    SELECT flow_id, {r("coalesce(rate, (SELECT median(rate) FROM test))", "flow_byts_s")} FROM test"""),
)
def own_medians(spark, folder):
    """Test rows filled with the test table's own median, the prepared columns being the trained ones."""
    split = written(split_flows(order_flows(spark, folder)), "split")
    train, test = (split.filter(F.col("is_test") == k) for k in (0, 1))
    fitted = prep.fit_prep(train, ["flow_byts_s"])
    own = prep.fit_medians(test, ["flow_byts_s"])
    return rounded(test.select("flow_id", fitted.imputed("flow_byts_s", own).alias("flow_byts_s")))


@query(
    "c7_drop_constant",
    sql(ORDER_FLOWS, body=" UNION ALL ".join(
        f"SELECT '{c}' AS feature, {r(f'stddev_samp({c})', 'sd', 4)}, "
        f"CASE WHEN var_samp({c}) > 0 THEN 1 ELSE 0 END AS kept FROM order_flows"
        for c in ("fwd_bytes", "rst_flag", "const_col", "flow_duration_s"))),
)
def drop_constant(spark, folder):
    columns = ["fwd_bytes", "rst_flag", "const_col", "flow_duration_s"]
    fitted = prep.fit_prep(written(order_flows(spark, folder).select(*columns), "flows"), columns)
    return rounded(
        fitted.table(spark).select(
            "feature", F.sqrt("variance").alias("sd"), F.col("kept").cast("int").alias("kept")
        ),
        4,
    )


SKEWED = """
shapes AS (
  SELECT event_id, value AS plain, value * value * value AS right_tail,
         -value * value * value AS left_tail FROM events)
"""


def skew_shapes(spark, folder):
    v = F.col("value")
    return tables.table(spark, folder, "events").select(
        "event_id", v.alias("plain"), (v * v * v).alias("right_tail"), (-v * v * v).alias("left_tail")
    )


def skew_sql(column: str) -> str:
    mean = f"(SELECT avg({column}) FROM shapes)"
    return (
        f"avg(({column} - {mean}) ** 3) / avg(({column} - {mean}) ** 2) ** 1.5 "
        "* sqrt(count(*)::DOUBLE * (count(*) - 1)) / (count(*) - 2)"
    )


SKEWS = ("skews AS (" + " UNION ALL ".join(
    f"SELECT '{c}' AS feature, {skew_sql(c)} AS skew FROM shapes"
    for c in ("plain", "right_tail", "left_tail")) + ")")


@query(
    "c8_skewed_columns",
    sql(SKEWED, SKEWS, body=f"""
    SELECT feature, {r("skew")}, CASE WHEN skew > 2 THEN 1 ELSE 0 END AS one_sided,
           CASE WHEN abs(skew) > 2 THEN 1 ELSE 0 END AS two_sided FROM skews"""),
)
def skewed_columns(spark, folder):
    df = skew_shapes(spark, folder)
    columns = ["plain", "right_tail", "left_tail"]
    # Skewness does not depend on the fill value where nothing is missing.
    fitted = prep.fit_prep(df, columns, impute="zero")
    return rounded(
        fitted.table(spark).select(
            "feature",
            "skew",
            (F.col("skew") > 2).cast("int").alias("one_sided"),
            F.col("skewed").cast("int").alias("two_sided"),
        )
    )


@query(
    "c9_log_skewed",
    sql(SKEWED, SKEWS, body="SELECT event_id, " + ", ".join(
        r(f"CASE WHEN abs((SELECT skew FROM skews WHERE feature = '{c}')) > 2 "
          f"THEN ln(1 + greatest({c}, 0)) ELSE {c} END", c)
        for c in ("plain", "right_tail", "left_tail")) + " FROM shapes"),
)
def log_skewed(spark, folder):
    df = skew_shapes(spark, folder)
    columns = ["plain", "right_tail", "left_tail"]
    fitted = prep.fit_prep(df, columns, impute="zero")
    return rounded(df.select("event_id", *[fitted.shaped(c).alias(c) for c in columns]))


@query(
    "c10_standardise",
    sql(ORDER_FLOWS, scaled("order_flows", "z", FEATURES, "flow_id", "zero"),
        body=f"SELECT flow_id, {', '.join(r(c) for c in FEATURES)} FROM z"),
)
def standardise(spark, folder):
    df = written(order_flows(spark, folder).select("flow_id", *FEATURES), "flows")
    fitted = prep.fit_prep(df, FEATURES, impute="zero", drop_constant=False, log_skewed=False)
    return rounded(fitted.transform(df, ["flow_id"]))


APPLIED = ["flow_byts_s", "fwd_bytes", "flow_duration_s"]


@query(
    "c11_apply_fit",
    sql(ORDER_FLOWS, SPLIT, f"""
    parts AS (SELECT flow_id, is_test, {", ".join(f"{finite(c)} AS {c}" for c in APPLIED)} FROM split),
    medians AS (SELECT {", ".join(f"median({c}) AS d_{c}" for c in APPLIED)} FROM parts WHERE is_test = 0),
    filled AS (SELECT flow_id, is_test, {", ".join(f"coalesce({c}, d_{c}) AS {c}" for c in APPLIED)}
               FROM parts, medians),
    fitted AS (SELECT {", ".join(f"avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}" for c in APPLIED)}
               FROM filled WHERE is_test = 0)""",
    body=f"""
    SELECT flow_id, {", ".join(r(f"({c} - m_{c}) / s_{c}", c) for c in APPLIED)}
    FROM filled, fitted WHERE is_test = 1"""),
)
def apply_fit(spark, folder):
    split = written(split_flows(order_flows(spark, folder)), "split")
    train, test = (split.filter(F.col("is_test") == k) for k in (0, 1))
    fitted = prep.fit_prep(train, APPLIED)
    return rounded(fitted.transform(test, ["flow_id"]))


@query(
    "c12_winsorise",
    sql(EVENT_SCORES, body=f"""
    SELECT id, y, {r("least(score, CASE WHEN y = 1 THEN (SELECT quantile_cont(score, 0.995) FROM event_scores WHERE y = 1) ELSE (SELECT quantile_cont(score, 0.995) FROM event_scores WHERE y = 0) END)", "score")}
    FROM event_scores"""),
)
def winsorise(spark, folder):
    return rounded(prep.winsorise(flows.event_scores(spark, folder), ["score"], by="y"))


@query(
    "c12_winsorise_users",
    f"""SELECT event_id AS id, user_id, {r("least(value, quantile_cont(value, 0.9) OVER (PARTITION BY user_id))", "score")}
        FROM events""",
)
def winsorise_users(spark, folder):
    """A cut of its own for every user."""
    events = tables.table(spark, folder, "events")
    events = events.select(F.col("event_id").alias("id"), "user_id", F.col("value").alias("score"))
    return rounded(prep.winsorise(events, ["score"], 0.9, by="user_id"))


@query(
    "c13_trim_names",
    "SELECT o_orderkey, trim(concat('  ', o_orderpriority, ' ')) AS category FROM orders",
)
def trim_names(spark, folder):
    padded = F.concat(F.lit("  "), F.col("o_orderpriority"), F.lit(" "))
    return tables.table(spark, folder, "orders").select("o_orderkey", F.trim(padded).alias("category"))


@query(
    "c14_encode_labels",
    """SELECT o_orderkey, o_orderpriority AS category,
              dense_rank() OVER (ORDER BY o_orderpriority) - 1 AS class_id,
              o_orderpriority AS decoded FROM orders""",
)
def encode_labels(spark, folder):
    rows = tables.table(spark, folder, "orders").select(
        "o_orderkey", F.col("o_orderpriority").alias("category")
    )
    encoded = prep.encode_labels(rows, "category")
    return prep.decode_labels(encoded, "class_id", encoded, "category", "decoded")


@query(
    "c14_encode_names",
    """SELECT c_custkey, c_name, dense_rank() OVER (ORDER BY c_name) - 1 AS name_id FROM customer""",
)
def encode_names(spark, folder):
    """As many different texts as rows."""
    return prep.encode_labels(tables.table(spark, folder, "customer").select("c_custkey", "c_name"), "c_name", "name_id")
