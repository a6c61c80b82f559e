"""How classes differ: CDFs, densities, effect sizes, box-plot numbers, threshold sweep."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from flowsieve.functions.columns import count_where, log1p_clipped, quoted, ratio
from flowsieve.operators.ordering import order_values, quantiles
from flowsieve.session import broadcast_if_small, written

# Boxes of a Gauss transform, and how far kernels reach, in kernel widths; moments per box.
GAUSS_BOX, GAUSS_REACH, GAUSS_TERMS = 0.5, 7.0, 12


def class_sizes(df: DataFrame, label: str) -> DataFrame:
    return df.agg(
        count_where(F.col(label) == 1).alias("positives"),
        count_where(F.col(label) == 0).alias("negatives"),
    )


def cdf_grid(
    df: DataFrame,
    score: str = "score",
    label: str = "y",
    points: int = 400,
    shares: tuple[float, float] = (0.005, 0.995),
) -> DataFrame:
    """Both class CDFs on an even grid between two score quantiles, with the gap between them.

    Each row is counted at the first grid point at or above its score; running sums over the grid
    give the CDFs. No row is compared with more than one grid point.
    """
    lo, hi = (0.0 if q is None else q for q in quantiles(df, [score], shares)[score])
    step = (hi - lo) / (points - 1)
    if step > 0:
        place = F.greatest(F.ceil((F.col(score) - F.lit(lo)) / F.lit(step)), F.lit(0))
    else:
        # A constant score: its CDF is one step, at the first point.
        place = F.when(F.col(score) <= lo, F.lit(0)).otherwise(F.lit(points))
    counts = (
        df.withColumn("_i", place)
        .filter(F.col("_i") < points)
        .groupBy("_i")
        .agg(count_where(F.col(label) == 1).alias("_p"), count_where(F.col(label) == 0).alias("_n"))
    )
    grid = df.sparkSession.range(points).select(F.col("id").alias("_i"))
    upto = W.orderBy("_i").rowsBetween(W.unboundedPreceding, W.currentRow)
    cdf = grid.join(F.broadcast(counts), "_i", "left").select(
        "_i",
        F.coalesce(F.sum("_p").over(upto), F.lit(0)).alias("_p"),
        F.coalesce(F.sum("_n").over(upto), F.lit(0)).alias("_n"),
    )
    return (
        cdf.join(F.broadcast(class_sizes(df, label)), F.lit(True))
        .select(
            F.col("_i").alias("point"),
            (F.lit(lo) + F.col("_i") * F.lit(step)).alias("score"),
            ratio(F.col("_p"), F.col("positives")).alias("cdf_positive"),
            ratio(F.col("_n"), F.col("negatives")).alias("cdf_negative"),
        )
        .withColumn("gap", F.abs(F.col("cdf_positive") - F.col("cdf_negative")))
    )


def widest_gap(grid: DataFrame) -> DataFrame:
    """Grid point with the largest gap, the first one on ties."""
    order = F.struct("gap", -F.col("point"))
    return grid.agg(F.max_by(F.struct("point", "score", "gap"), order).alias("_g")).select("_g.*")


def histogram(
    df: DataFrame,
    value: str,
    label: str,
    bins: int,
    lo: float | None = None,
    hi: float | None = None,
) -> DataFrame:
    """Counts and densities per class on shared equal-width bins; the last bin is closed.

    Values outside the range are left out, also of the density's total.
    """
    if lo is None or hi is None:
        ends = df.agg(F.min(value).alias("lo"), F.max(value).alias("hi")).first()
        lo, hi = (ends.lo if lo is None else lo), (ends.hi if hi is None else hi)
    if lo is None or hi is None:
        lo, hi = 0.0, 1.0
    if lo == hi:
        lo, hi = lo - 0.5, hi + 0.5
    width = (hi - lo) / bins
    column = F.col(quoted(value))
    place = F.least(F.floor((column - F.lit(lo)) / F.lit(width)), F.lit(bins - 1))
    counts = (
        df.filter((column >= lo) & (column <= hi))
        .groupBy(F.col(label).alias("class"), place.cast("int").alias("bin"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    total = F.sum("n").over(W.partitionBy("class"))
    return counts.select(
        "class",
        "bin",
        (F.lit(lo) + F.col("bin") * F.lit(width)).alias("bin_start"),
        "n",
        (F.col("n") / (total * F.lit(width))).alias("density"),
    )


def density_overlap(counts: DataFrame) -> DataFrame:
    """Per bin, the smaller of the two class densities."""
    both = counts.groupBy("bin").agg(
        F.max(F.when(F.col("class") == 1, F.col("density")).otherwise(0.0)).alias("positive"),
        F.max(F.when(F.col("class") == 0, F.col("density")).otherwise(0.0)).alias("negative"),
    )
    return both.withColumn("overlap", F.least("positive", "negative"))


def kernel_density(
    df: DataFrame,
    score: str = "score",
    label: str = "y",
    points: int = 300,
    bandwidth: float = 0.15,
    margin: float = 0.0,
) -> DataFrame:
    """Gaussian kernel density per class on an even grid over the class's score range.

    The bandwidth is the factor times the sample deviation; a class without one has no density (NULL).

    A fast Gauss transform: scores go to boxes half a kernel width wide, and a box keeps
    ``GAUSS_TERMS`` moments of its scores, from which the sum of their kernels at any point is a
    series of Hermite functions. The grid is evaluated from boxes, each at the points that it reaches,
    so the cost does not grow with the number of different scores. The error is below 1e-9 of
    one kernel's height at its centre.
    """
    stats = df.groupBy(F.col(quoted(label)).alias("class")).agg(
        F.count(score).alias("_size"),
        (F.min(score) - margin).alias("_lo"),
        (F.max(score) + margin).alias("_hi"),
        F.nullif(F.stddev_samp(score) * bandwidth, F.lit(0.0)).alias("_h"),
    )
    stats = broadcast_if_small(written(stats, "density-classes"))
    # In units of the kernel's width, exp(-z * z).
    width = F.col("_h") * math.sqrt(2)
    rows = df.select(F.col(quoted(label)).alias("_of"), F.col(quoted(score)).cast("double").alias("_x"))
    placed = rows.filter(F.col("_x").isNotNull()).join(stats.filter("_h is not null"), F.col("_of").eqNullSafe(F.col("class")))
    moments = box_moments(placed, (F.col("_x") - F.col("_lo")) / width, ["class"])
    step = (F.col("_hi") - F.col("_lo")) / width / F.lit(points - 1)
    reached = moments.join(stats.withColumnRenamed("class", "_of"), F.col("_of").eqNullSafe(F.col("class"))).select(
        "class", "centre", "moments", step.alias("_step"),
        F.explode(F.sequence(
            F.greatest(F.ceil((F.col("centre") - GAUSS_REACH) / step), F.lit(0)),
            F.least(F.floor((F.col("centre") + GAUSS_REACH) / step), F.lit(points - 1)),
        )).alias("point"),
    )
    total = hermite_sum(F.col("moments"), F.col("point") * F.col("_step") - F.col("centre"))
    summed = reached.groupBy(F.col("class").alias("_of"), F.col("point").alias("_at")).agg(F.sum(total).alias("_sum"))
    grid = stats.withColumn("point", F.explode(F.sequence(F.lit(0), F.lit(points - 1))))
    at = F.col("_lo") + F.col("point") * (F.col("_hi") - F.col("_lo")) / F.lit(points - 1)
    # Points no box reaches have density 0.
    height = F.coalesce("_sum", F.lit(0.0)) / (F.col("_size") * F.col("_h") * F.lit(math.sqrt(2 * math.pi)))
    same = F.col("class").eqNullSafe(F.col("_of")) & (F.col("point") == F.col("_at"))
    return grid.join(summed, same, "left").select("class", "point", at.alias("at"), height.alias("density"))


def box_moments(df: DataFrame, place: Column, by: Sequence[str]) -> DataFrame:
    """(by, centre, moments): per box of ``place``, the sums of powers of the distance to its centre,
    each divided by its factorial. One row per box that is not empty, combined before the shuffle."""
    boxed = df.select(*by, F.floor(place / GAUSS_BOX).alias("_box"), place.alias("_z"))
    centre = (F.col("_box") + 0.5) * GAUSS_BOX
    away = F.col("_z") - centre
    power, terms = F.lit(1.0), []
    for n in range(GAUSS_TERMS):
        terms.append(power / F.lit(float(math.factorial(n))))
        power = power * away
    found = boxed.groupBy(*by, "_box").agg(*[F.sum(t).alias(f"_m{n}") for n, t in enumerate(terms)])
    return found.select(*by, centre.alias("centre"), F.array(*[f"_m{n}" for n in range(GAUSS_TERMS)]).alias("moments"))


def hermite_sum(moments: Column, z: Column) -> Column:
    """Sum over n of moment n times the Hermite function h_n(z); h_0 is exp(-z * z), and
    h_(n+1) is 2 z h_n - 2 n h_(n-1)."""

    def state(n: Column, before: Column, now: Column, total: Column) -> Column:
        return F.struct(n.alias("n"), before.alias("before"), now.alias("now"), total.alias("total"))

    def follow(held: Column, moment: Column) -> Column:
        following = 2.0 * z * held["now"] - 2.0 * held["n"] * held["before"]
        return state(held["n"] + 1.0, held["now"], following, held["total"] + moment * held["now"])

    start = state(F.lit(0.0), F.lit(0.0), F.exp(-z * z), F.lit(0.0))
    return F.aggregate(moments, start, follow, lambda held: held["total"])


def threshold_sweep(
    df: DataFrame,
    score: str = "if_score",
    label: str = "y",
    shares: Sequence[float] | None = None,
) -> DataFrame:
    """Precision, recall, F1 when flagging ``score <= k-th lowest`` for k = int(n * share).

    The cut scores are exact order statistics; all settings are then counted in one pass.
    """
    # 5 % to 75 % in steps of 5 %.
    shares = shares or [0.05 + i * 0.05 for i in range(15)]
    n = df.count()
    ranks = [min(int(n * s), n - 1) for s in shares]
    cuts = order_values(df, {score: sorted(set(ranks))})[score]
    cut_of = dict(zip(sorted(set(ranks)), cuts))
    flagged = [F.col(score) <= F.lit(cut_of[r]) for r in ranks]
    entries = [
        F.struct(
            F.lit(i).alias("step"),
            F.lit(float(s)).alias("share"),
            count_where(f & (F.col(label) == 1)).alias("tp"),
            count_where(f & (F.col(label) == 0)).alias("fp"),
            count_where(~f & (F.col(label) == 1)).alias("fn"),
        )
        for i, (s, f) in enumerate(zip(shares, flagged))
    ]
    swept = df.agg(F.array(*entries).alias("_e")).select(F.explode("_e").alias("_e")).select("_e.*")
    tp, small = F.col("tp"), F.lit(1e-9)
    p, r = tp / (tp + F.col("fp") + small), tp / (tp + F.col("fn") + small)
    return swept.select(
        "step", "share", "tp", "fp", "fn", p.alias("precision"), r.alias("recall")
    ).withColumn(
        "f1",
        2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall") + small),
    )


def best_of_sweep(sweep: DataFrame) -> DataFrame:
    """Setting with the highest F1, and the shares one step to either side."""
    order = W.orderBy("step")
    last = F.col("share")
    around = sweep.select(
        "*",
        F.coalesce(F.lag("share").over(order), last).alias("from_share"),
        F.coalesce(F.lead("share").over(order), last).alias("to_share"),
    )
    best = F.max_by(
        F.struct("share", "f1", "from_share", "to_share"), F.struct("f1", -F.col("step"))
    )
    return around.agg(best.alias("_b")).select("_b.*")


def cohens_d(df: DataFrame, columns: Sequence[str], label: str = "true_label") -> DataFrame:
    """Effect size per feature from population deviations, and which class is higher.

    All moments come from one aggregation over the wide table; nothing is unpivoted before it.
    """
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"no such columns: {missing}")

    def moment(f, column: str, value: int) -> Column:
        return f(F.when(F.col(label) == value, F.col(quoted(column))))

    entries = [
        F.struct(
            F.lit(c).alias("feature"),
            moment(F.avg, c, 1).alias("m1"),
            moment(F.avg, c, 0).alias("m0"),
            moment(F.stddev_pop, c, 1).alias("s1"),
            moment(F.stddev_pop, c, 0).alias("s0"),
        )
        for c in columns
    ]
    tidy = df.agg(F.array(*entries).alias("_e")).select(F.explode("_e").alias("_e")).select("_e.*")
    pooled = F.sqrt((F.col("s1") * F.col("s1") + F.col("s0") * F.col("s0")) / 2) + F.lit(1e-9)
    return tidy.withColumn("d", (F.col("m1") - F.col("m0")) / pooled).select(
        "feature",
        F.col("m1").alias("mean_positive"),
        F.col("m0").alias("mean_negative"),
        "d",
        F.when(F.col("d") > 0, "positive").otherwise("negative").alias("higher_in"),
    )


def class_summary(df: DataFrame, score: str = "score", label: str = "y") -> DataFrame:
    """Rows, mean, median and sample deviation of the score per class."""
    medians = _class_quantiles(df, score, label, [0.5])
    stats = df.groupBy(F.col(label).alias("class")).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(score).alias("mean"),
        F.stddev_samp(score).alias("sd"),
    )
    return stats.withColumn("median", _per_class(medians, 0))


def box_summary(
    df: DataFrame, columns: Sequence[str], label: str = "true_label"
) -> DataFrame:
    """Quartiles of log1p values per class and feature, and whiskers at 1.5 quartile ranges.

    One call finds the quartiles of all features and classes, one aggregation the whiskers.
    """
    pairs = [(c, k) for c in columns for k in (0, 1)]
    split = df.select(
        *[F.when(F.col(label) == k, log1p_clipped(c)).alias(f"v{i}") for i, (c, k) in enumerate(pairs)]
    )
    found = quantiles(split, split.columns, [0.25, 0.5, 0.75])
    entries = []
    for i, (c, k) in enumerate(pairs):
        q1, q2, q3 = (F.lit(q) for q in found[f"v{i}"])
        v, reach = F.col(f"v{i}"), 1.5 * (q3 - q1)
        entries.append(
            F.struct(
                F.lit(c).alias("feature"),
                F.lit(k).alias("class"),
                q1.alias("q1"),
                q2.alias("median"),
                q3.alias("q3"),
                F.min(F.when(v >= q1 - reach, v)).alias("low_whisker"),
                F.max(F.when(v <= q3 + reach, v)).alias("high_whisker"),
                count_where((v < q1 - reach) | (v > q3 + reach)).alias("outside"),
            )
        )
    return split.agg(F.array(*entries).alias("_e")).select(F.explode("_e").alias("_e")).select("_e.*")


def _class_quantiles(
    df: DataFrame, value: str, label: str, shares: Sequence[float]
) -> dict[int, list[float | None]]:
    """Exact quantiles of both classes in one go: each class becomes a column."""
    split = df.select(*[F.when(F.col(label) == k, F.col(value)).alias(f"c{k}") for k in (0, 1)])
    found = quantiles(split, ["c0", "c1"], shares)
    return {k: found[f"c{k}"] for k in (0, 1)}


def _per_class(found: dict[int, list[float | None]], place: int) -> Column:
    return F.when(F.col("class") == 1, F.lit(found[1][place])).otherwise(F.lit(found[0][place]))
