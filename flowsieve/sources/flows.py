"""Flow tables: the file schema, and views that give the order and event tables that shape."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowsieve.sources.tables import table

# Column names of the flow files.
FLOW_FILE_COLUMNS = [
    "Flow Byts/s",
    "Flow Pkts/s",
    "TotLen Fwd Pkts",
    "TotLen Bwd Pkts",
    "Tot Fwd Pkts",
    "Tot Bwd Pkts",
    "SYN Flag Cnt",
    "RST Flag Cnt",
    "FIN Flag Cnt",
    "ACK Flag Cnt",
    "Flow Duration",
    "Pkt Len Mean",
    "Pkt Len Std",
    "Fwd Pkts/s",
    "Bwd Pkts/s",
]

# The ten model features.
FEATURES = [
    "flow_byts_s",
    "flow_pkts_s",
    "fwd_bytes",
    "bwd_bytes",
    "total_pkts",
    "syn_flag",
    "rst_flag",
    "fin_flag",
    "flow_duration_s",
    "pkt_len_mean",
]


def flow_file_schema() -> T.StructType:
    """Schema of a flow file; every measure is read as a number."""
    fields = [T.StructField("flow_id", T.LongType())]
    fields += [T.StructField(c, T.DoubleType()) for c in FLOW_FILE_COLUMNS]
    return T.StructType(fields + [T.StructField("Label", T.IntegerType())])


def _lines_by_order(lines: DataFrame) -> DataFrame:
    """Line items summed per order. Grouping before the join keeps the join one row per order."""
    price, quantity = F.col("l_extendedprice"), F.col("l_quantity")
    return lines.groupBy("l_orderkey").agg(
        F.sum(price * (1 - F.col("l_discount"))).alias("net"),
        F.avg("l_quantity").alias("flow_pkts_s"),
        F.sum("l_extendedprice").alias("fwd_bytes"),
        F.sum(price * F.col("l_discount")).alias("bwd_bytes"),
        F.sum("l_quantity").alias("total_pkts"),
        F.sum(F.when(F.col("l_linestatus") == "O", quantity).otherwise(0.0)).alias("fwd_pkts"),
        F.sum(F.when(F.col("l_linestatus") != "O", quantity).otherwise(0.0)).alias("bwd_pkts"),
        F.count(F.when(F.col("l_returnflag") == "N", 1)).cast("double").alias("syn_flag"),
        F.count(F.when(F.col("l_returnflag") == "R", 1)).cast("double").alias("rst_flag"),
        F.count(F.when(F.col("l_returnflag") == "A", 1)).cast("double").alias("ack_flag"),
        F.count(F.when(F.col("l_linestatus") == "F", 1)).cast("double").alias("fin_flag"),
        F.datediff(F.max("l_shipdate"), F.min("l_shipdate")).cast("double").alias("flow_duration_s"),
        F.avg("l_extendedprice").alias("pkt_len_mean"),
        F.stddev_pop("l_extendedprice").alias("pkt_len_std"),
    )


def order_flows(spark: SparkSession, folder: str) -> DataFrame:
    """One row per order, shaped like a flow; some byte rates are missing or infinite on purpose."""
    orders = table(spark, folder, "orders")
    grouped = _lines_by_order(table(spark, folder, "lineitem"))
    key = F.col("o_orderkey")
    rate = (
        F.when(key % 97 == 0, F.lit(None).cast("double"))
        .when(key % 101 == 0, F.lit(float("inf")))
        .otherwise(F.col("net"))
    )
    return orders.join(grouped, key == F.col("l_orderkey")).select(
        key.alias("flow_id"),
        F.col("o_custkey").alias("src"),
        F.col("o_orderdate").alias("ts"),
        rate.alias("flow_byts_s"),
        "flow_pkts_s",
        "fwd_bytes",
        "bwd_bytes",
        "total_pkts",
        "fwd_pkts",
        "bwd_pkts",
        "syn_flag",
        "rst_flag",
        "ack_flag",
        "fin_flag",
        "flow_duration_s",
        "pkt_len_mean",
        "pkt_len_std",
        F.lit(0.0).alias("const_col"),
        F.when(F.col("o_orderstatus") == "F", 1).otherwise(0).alias("true_label"),
        F.col("o_orderpriority").alias("category"),
    )


def flow_file_rows(flows: DataFrame) -> DataFrame:
    """Flows under the file's column names, as text, with unreadable entries where a rate is missing."""
    seconds = F.greatest(F.col("flow_duration_s"), F.lit(1.0))
    named = {
        "Flow Byts/s": F.coalesce(F.col("flow_byts_s").cast("string"), F.lit("n/a")),
        "Flow Pkts/s": F.col("flow_pkts_s"),
        "TotLen Fwd Pkts": F.col("fwd_bytes"),
        "TotLen Bwd Pkts": F.col("bwd_bytes"),
        "Tot Fwd Pkts": F.col("fwd_pkts"),
        "Tot Bwd Pkts": F.col("bwd_pkts"),
        "SYN Flag Cnt": F.col("syn_flag"),
        "RST Flag Cnt": F.col("rst_flag"),
        "FIN Flag Cnt": F.col("fin_flag"),
        "ACK Flag Cnt": F.col("ack_flag"),
        "Flow Duration": F.col("flow_duration_s") * 1e6,
        "Pkt Len Mean": F.col("pkt_len_mean"),
        "Pkt Len Std": F.col("pkt_len_std"),
        "Fwd Pkts/s": F.col("fwd_pkts") / seconds,
        "Bwd Pkts/s": F.col("bwd_pkts") / seconds,
    }
    return flows.select(
        "flow_id",
        *[named[c].cast("string").alias(c) for c in FLOW_FILE_COLUMNS],
        F.col("true_label").alias("Label"),
    )


def event_scores(spark: SparkSession, folder: str) -> DataFrame:
    """A labelled score table with ties: one row per event."""
    events = table(spark, folder, "events")
    return events.select(
        F.col("event_id").alias("id"),
        F.when(F.col("event_type") == "error", 1).otherwise(0).alias("y"),
        F.col("value").alias("score"),
    )


def event_score_set(spark: SparkSession, folder: str) -> DataFrame:
    """Three scores per event, standing in for three detectors."""
    events = table(spark, folder, "events")
    k = F.get_json_object("props", "$.k").cast("double")
    return events.select(
        F.col("event_id").alias("id"),
        F.when(F.col("event_type") == "error", 1).otherwise(0).alias("y"),
        F.col("value").alias("if_score"),
        k.alias("lof_score"),
        (F.col("value") * (k + 1)).alias("recon_score"),
    )


def event_records(spark: SparkSession, folder: str) -> DataFrame:
    """Events as raw records for windowed features: source, time, bytes, port and failure."""
    return table(spark, folder, "events").select(
        F.col("user_id").alias("src"),
        "ts",
        F.col("value").alias("n_bytes"),
        F.col("event_type").alias("dst_port"),
        F.when(F.col("event_type") == "error", 1.0).otherwise(0.0).alias("failed"),
    )


def vectors(spark: SparkSession, folder: str) -> DataFrame:
    """Embeddings as double vectors; class 0 plays the outlier class."""
    return table(spark, folder, "embeddings").select(
        F.col("vec_id").alias("id"),
        F.col("embedding").cast("array<double>").alias("x"),
        F.when(F.col("label") == 0, 1).otherwise(0).alias("y"),
    )


def labelled_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Document lengths with a binary label under the fallback name."""
    documents = table(spark, folder, "documents").select("doc_id", "n_chars", "lang", "source")
    labels = table(spark, folder, "labels").select("doc_id", "quality", F.col("toxic").alias("Label"))
    return documents.join(labels, "doc_id")
