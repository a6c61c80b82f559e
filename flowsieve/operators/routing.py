"""Two-stage decisions: pass, known class, or review queue; and how good they are."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from flowsieve.functions.columns import count_where, ratio

# Route names and confidence limits (two-class or all classes / class hold-out).
NORMAL = "Normal"
PASSED = "NORMAL"
QUEUE = "ZERO_DAY_QUEUE"
CONFIDENCE = 0.60
HOLD_OUT_CONFIDENCE = 0.55


def hold_out(df: DataFrame, category: str, hidden: Sequence[str], flag: str | None = None) -> DataFrame:
    """Training rows for stage 2: flagged rows of every class but the hidden ones."""
    kept = ~F.coalesce(F.col(category).isin(*hidden), F.lit(False))
    return df.filter(kept if flag is None else (F.col(flag) == 1) & kept)


def confidence(probability: Column) -> Column:
    """Highest class probability of an array."""
    return F.array_max(probability)


def predicted_class(probability: Column, classes: Column) -> Column:
    """Class of the highest probability; the first one on ties."""
    best = F.array_position(probability, F.array_max(probability))
    return F.get(classes, (best - 1).cast("int"))


def route(
    df: DataFrame,
    limit: float = CONFIDENCE,
    flag: str = "flag",
    predicted: str = "predicted",
    confidence: str = "confidence",
    normal: str = NORMAL,
) -> DataFrame:
    """Add ``route`` and ``final`` (1 = attack). Queued rows count as attacks."""
    sure = F.col(confidence) >= limit
    path = (
        F.when(F.col(flag) == 0, F.lit(PASSED))
        .when(sure, F.col(predicted))
        .otherwise(F.lit(QUEUE))
    )
    return df.withColumn("route", path).withColumn(
        "final", F.when(F.col("route").isin(PASSED, normal), 0).otherwise(1)
    )


def queue_quality(
    routed: DataFrame, hidden: Sequence[str] = (), category: str = "category", label: str = "y"
) -> DataFrame:
    """Size of the review queue, true and false attacks, hidden-class rows, precision."""
    queued = routed.filter(F.col("route") == QUEUE)
    in_hidden = F.col(category).isin(*hidden) if hidden else F.lit(False)
    counts = queued.agg(
        F.count(F.lit(1)).alias("queued"),
        count_where(F.col(label) == 1).alias("attacks"),
        count_where(F.col(label) == 0).alias("false_alarms"),
        count_where(in_hidden).alias("hidden"),
    )
    return counts.select(
        "*",
        (F.col("attacks") / (F.col("queued") + F.lit(1e-9))).alias("precision"),
        ratio(F.col("hidden"), F.col("queued")).alias("hidden_share"),
    )


def queue_composition(
    routed: DataFrame,
    hidden: Sequence[str] = (),
    category: str = "category",
    attacks_only: bool = False,
    label: str = "y",
) -> DataFrame:
    """Queue by class, largest first, with share and hidden tag; of true attacks only, if asked."""
    queued = F.col("route") == QUEUE
    counts = (
        routed.filter(queued & (F.col(label) == 1) if attacks_only else queued)
        .groupBy(category)
        .agg(F.count(F.lit(1)).alias("queued"))
    )
    in_hidden = F.col(category).isin(*hidden) if hidden else F.lit(False)
    return counts.select(
        category,
        "queued",
        (100.0 * F.col("queued") / F.sum("queued").over(W.partitionBy())).alias("share_pct"),
        in_hidden.cast("int").alias("is_hidden"),
    ).orderBy(F.col("queued").desc(), category)


def routing_by_class(
    routed: DataFrame,
    hidden: Sequence[str] = (),
    category: str = "category",
    flag: str = "flag",
    normal: str = NORMAL,
) -> DataFrame:
    """Flagged rows per attack class: known (right and confident), queued, the rest, and shares.

    A hidden class is never known.
    """
    visible = ~F.col(category).isin(*hidden) if hidden else F.lit(True)
    known = count_where((F.col("route") == F.col(category)) & visible)
    queued = count_where(F.col("route") == QUEUE)
    flagged = F.count(F.lit(1))
    return (
        routed.filter((F.col(flag) == 1) & (F.col(category) != normal))
        .groupBy(category)
        .agg(
            flagged.alias("flagged"),
            known.alias("known"),
            queued.alias("queued"),
            (flagged - known - queued).alias("rest"),
            (100.0 * known / flagged).alias("known_pct"),
            (100.0 * queued / flagged).alias("queued_pct"),
        )
    )


def hidden_detection(
    routed: DataFrame, hidden: Sequence[str], category: str = "category", flag: str = "flag"
) -> DataFrame:
    """How far each hidden class got: total, flagged, queued. Classes without rows stay, with 0."""
    classes = routed.sparkSession.createDataFrame([(h,) for h in hidden], f"{category} string")
    counts = (
        routed.filter(F.col(category).isin(*hidden))
        .groupBy(category)
        .agg(
            F.count(F.lit(1)).alias("total"),
            count_where(F.col(flag) == 1).alias("flagged"),
            count_where(F.col("route") == QUEUE).alias("queued"),
        )
    )
    filled = classes.join(counts, category, "left").na.fill(0, ["total", "flagged", "queued"])
    base = F.greatest(F.col("total"), F.lit(1))
    return filled.select(
        "*",
        (100.0 * F.col("flagged") / base).alias("flagged_pct"),
        (100.0 * F.col("queued") / base).alias("queued_pct"),
    )


def false_alarm_reduction(routed: DataFrame, label: str = "y", flag: str = "flag") -> DataFrame:
    """False alarms of stage 1 and of the final decision, and the reduction between them."""
    benign = F.col(label) == 0
    counts = routed.agg(
        count_where(benign & (F.col(flag) == 1)).alias("stage1_fp"),
        count_where(benign & (F.col("final") == 1)).alias("final_fp"),
    )
    return counts.select(
        "*", (1 - F.col("final_fp") / F.greatest("stage1_fp", F.lit(1))).alias("reduction")
    )
