"""Global ordering without a global sort in one task.

* :func:`running_sums` - prefix sums over any number of distinct keys,
* :func:`order_values` / :func:`quantiles` - exact order statistics by bracketing,
* :func:`hash_positions` / :func:`hash_quota` - seeded shuffles, samples and splits.

All of them cut the key range into buckets, count per bucket, and only then order inside buckets.
What crosses the driver or is broadcast has a fixed size (bucket edges or bucket totals).
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.types import DataType, DatetimeType, NumericType, StructType

from flowsieve.functions.columns import SEED, as_column, count_where, hash_key, quoted
from flowsieve import session
from flowsieve.session import broadcast_if_small, written

SKETCH_ACCURACY = 10_000
HEX_DIGITS = 4
# Buckets that a low limit on a task's rows is met by. More are made only to keep them to ``TASK_ROWS``.
BUCKETS = 256
# Values drawn at once to choose splitters from, and splitters counted in one pass.
SPLITTER_SAMPLE, SPLITTERS = 4_096, 64
# Size of a group's sketch, how far its ranks are trusted (a rank beyond is found without it), and the
# rows up to which a group needs none.
GROUP_SKETCH, GROUP_SLACK, SMALL_GROUP = 800, 0.007, 1_000


def running_sums(
    df: DataFrame,
    key: str,
    sums: Sequence[str],
    descending: bool = False,
    task_rows: int | None = None,
    by: Sequence[str] = (),
) -> DataFrame:
    """Add ``cum_<name>`` for each of ``sums``, running along ``key``, which is unique in its group of ``by``.

    Keys are of any type that can be ordered. As long as the largest group has no more than
    ``task_rows`` rows, each group is summed up in one task. Beyond that, rows are range-partitioned by
    group and key into buckets of about that size and summed up inside buckets. A limit so low that this
    takes more than ``BUCKETS`` of them, each a task of its own, is exceeded up to the usual one: edges,
    tasks and what they send to the driver do not grow with rows over a tiny limit. Only a group that
    continues from one bucket to the next needs the totals before it, so there are at most two totals
    a bucket, however many groups there are; these are broadcast. NULL keys come first in ascending
    and last in descending order; NaN is the highest key.
    """
    limit = task_rows or session.task_rows(df.sparkSession)
    # The input is often an aggregation of a much larger table; several passes over it follow.
    df = written(df, "keys")
    order = F.col(quoted(key)).desc() if descending else F.col(quoted(key)).asc()
    groups = [quoted(c) for c in by]
    sizes = df.groupBy(*groups).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n").alias("most"), F.sum("n").alias("all")).first()
    if (sizes.most or 0) <= limit:
        window = W.partitionBy(*groups).orderBy(order).rowsBetween(W.unboundedPreceding, W.currentRow)
        return df.select("*", *[F.sum(s).over(window).alias(f"cum_{s}") for s in sums])

    # Edges are sampled, so half the size is asked for; written, so that rows stay in their bucket.
    buckets = min(-(-2 * sizes.all // limit), max(BUCKETS, -(-2 * sizes.all // session.TASK_ROWS)))
    ranged = df.repartitionByRange(buckets, *[F.col(c).asc() for c in groups], order)
    ranged = written(ranged.withColumn("_bucket", F.spark_partition_id()), "ranges")
    names = [f"_g{i}" for i in range(len(by))]
    group = [F.col(c).alias(n) for c, n in zip(groups, names)]
    totals = ranged.groupBy(*group, F.col("_bucket").alias("_at")).agg(*[F.sum(s).alias(f"_t_{s}") for s in sums])
    if names:
        inside = F.struct(*names)
        ends = totals.groupBy("_at").agg(F.min(inside).alias("_first"), F.max(inside).alias("_last"))
        totals = totals.join(F.broadcast(ends), "_at").filter((inside == F.col("_first")) | (inside == F.col("_last")))
    before = W.partitionBy(*names).orderBy("_at").rowsBetween(W.unboundedPreceding, -1)
    offsets = totals.select(
        *names,
        "_at",
        *[F.coalesce(F.sum(f"_t_{s}").over(before), F.lit(0)).alias(f"_o_{s}") for s in sums],
    )
    same = reduce(
        lambda x, y: x & y,
        [F.col(c).eqNullSafe(F.col(n)) for c, n in zip(groups, names)],
        F.col("_bucket") == F.col("_at"),
    )
    along = W.partitionBy(*groups, "_bucket").orderBy(order)
    along = along.rowsBetween(W.unboundedPreceding, W.currentRow)
    return ranged.join(F.broadcast(offsets), same, "left").select(
        *[F.col(quoted(c)) for c in df.columns],
        *[(F.sum(s).over(along) + F.coalesce(F.col(f"_o_{s}"), F.lit(0))).alias(f"cum_{s}") for s in sums],
    )


def order_values(
    df: DataFrame,
    ranks: dict[str, Sequence[int]],
    task_rows: int | None = None,
    sizes: dict[str, int] | None = None,
) -> dict[str, list]:
    """Exact k-th smallest non-NULL values (k counts from 0), per column.

    Up to ``task_rows`` values, distinct values are counted and ranked as they are. Beyond that,
    sketches of all columns bracket each rank in one pass; a second pass counts what lies below
    each bracket, and only the few rows inside brackets are counted and ranked. Texts, structs and
    other columns that are no numbers or times have no such sketches: ``narrowed_values`` finds theirs.

    ``sizes``, the number of non-NULL values per column, saves a pass where it is known.
    """
    if sizes is None:
        found = df.agg(*[F.count(as_column(c)).alias(f"n{i}") for i, c in enumerate(ranks)]).first()
        sizes = {c: found[f"n{i}"] for i, c in enumerate(ranks)}
    for column, wanted in ranks.items():
        if wanted and not 0 <= min(wanted) <= max(wanted) < sizes[column]:
            raise ValueError(f"{column} has {sizes[column]} values, not rank {max(wanted)}")
    columns = [c for c in ranks if ranks[c]]
    task_rows = task_rows or session.task_rows(df.sparkSession)
    if max((sizes[c] for c in columns), default=0) <= task_rows:
        return {c: _ranked_values(_value_counts(df, c), ranks[c]) for c in columns}

    found = {
        c: narrowed_values(df, c, ranks[c], sizes[c], task_rows)
        for c in columns
        if not isinstance(df.select(as_column(c)).schema[0].dataType, (NumericType, DatetimeType))
    }
    columns = [c for c in columns if c not in found]
    if not columns:
        return found
    brackets = _brackets(df, {c: ranks[c] for c in columns}, sizes)
    # One pass finds the values inside any bracket of their column. Columns share a type.
    entries = [
        F.when(
            reduce(lambda x, y: x | y, [_within(as_column(c), lo, hi) for lo, hi, _ in brackets[c]]),
            F.struct(F.lit(i).alias("c"), as_column(c).alias("v")),
        )
        for i, c in enumerate(columns)
    ]
    kept = df.select(F.explode(F.array_compact(F.array(*entries))).alias("e"))
    counted = kept.groupBy(F.col("e.c").alias("_c"), F.col("e.v").alias("_v"))
    counted = written(counted.agg(F.count(F.lit(1)).alias("_n")), "brackets")
    return found | _bracketed_values(counted, columns, ranks, brackets, task_rows)


def narrowed_values(
    df: DataFrame, column: str, ranks: Sequence[int], size: int, task_rows: int
) -> list:
    """Exact values at ``ranks`` of a column of any type that can be ordered.

    Splitters are drawn from the values themselves, by hash, so that they follow their distribution.
    One pass counts the values below each; a rank lies between two neighbours, and from round to round
    only what is between them is read. ``size`` is the number of non-NULL values.
    """
    field = df.select(as_column(column).alias("_v")).schema[0]
    rows = df.select(as_column(column).alias("_v")).filter(F.col("_v").isNotNull())
    v = F.col("_v")

    def between(lo, hi) -> Column:
        above = F.lit(True) if lo is None else v >= literal(lo, field.dataType)
        return above if hi is None else above & (v < literal(hi, field.dataType))

    # Per rank: from, up to (not included), values below, values inside.
    held = {k: (None, None, 0, size) for k in ranks}
    wide = {place for place in held.values() if place[3] > task_rows}
    while wide:
        narrower = {}
        for place in wide:
            lo, hi, below, inside = place
            part = -(-inside // SPLITTER_SAMPLE)
            sample = rows.filter(between(lo, hi) & (F.pmod(F.xxhash64("_v"), F.lit(part)) == 0))
            drawn = [r[0] for r in sample.distinct().orderBy("_v").collect()]
            step = max(len(drawn) // SPLITTERS, 1)
            splitters = [x for x in drawn[step // 2 :: step] if x != lo]
            if not splitters:
                # Many rows, but hardly any different values.
                continue
            counts = rows.filter(between(lo, hi)).agg(*[count_where(v < literal(x, field.dataType)) for x in splitters]).first()
            edges = [(lo, 0), *zip(splitters, counts), (hi, inside)]
            narrower[place] = [(f, t, below + n, m - n) for (f, n), (t, m) in zip(edges, edges[1:])]
        wide = set()
        for k, place in held.items():
            for f, t, below, inside in narrower.get(place, ()):
                if below <= k < below + inside:
                    held[k] = (f, t, below, inside)
                    if task_rows < inside < place[3]:
                        wide.add(held[k])
    out = {}
    for place in set(held.values()):
        lo, hi, below, _ = place
        inside = [k for k in held if held[k] == place]
        counted = rows.filter(between(lo, hi)).groupBy("_v").agg(F.count(F.lit(1)).alias("_n"))
        out |= zip(inside, _ranked_values(counted, [k - below for k in inside]))
    return [out[k] for k in ranks]


def literal(value, kind: DataType) -> Column:
    """A value fetched from a column of type ``kind`` as a column again; structs field by field."""
    if isinstance(kind, StructType) and value is not None:
        return F.struct(*[literal(value[f.name], f.dataType).alias(f.name) for f in kind])
    return F.lit(value).cast(kind)


def _value_counts(df: DataFrame, column: str) -> DataFrame:
    value = as_column(column)
    rows = df.filter(value.isNotNull())
    return rows.groupBy(value.alias("_v")).agg(F.count(F.lit(1)).alias("_n"))


def _ranked_values(counted: DataFrame, ranks: Sequence[int]) -> list:
    """Values at ``ranks`` of a table that one task can sort."""
    order = W.orderBy("_v").rowsBetween(W.unboundedPreceding, W.currentRow)
    placed = counted.withColumn("_upto", F.sum("_n").over(order))
    picks = [F.min(F.when(F.col("_upto") > k, F.col("_v"))).alias(f"v{j}") for j, k in enumerate(ranks)]
    return list(placed.agg(*picks).first())


def _bracketed_values(
    counted: DataFrame,
    columns: Sequence[str],
    ranks: dict[str, Sequence[int]],
    brackets: dict[str, list[tuple]],
    task_rows: int,
) -> dict[str, list]:
    """Values at ``ranks`` from the counts inside brackets (low, high, rows below low).

    ``counted`` has (_c, _v, _n) with the column's place in ``columns`` as _c.
    """
    v, n = F.col("_v"), F.col("_n")
    # Rows of the same column in other, lower brackets come first in its running count.
    earlier = {
        f"e{i}_{j}": F.coalesce(F.sum(F.when((F.col("_c") == i) & (v < lo), n)), F.lit(0))
        for i, c in enumerate(columns)
        for j, (lo, _, _) in enumerate(brackets[c])
        if lo is not None
    }
    sums = [total.alias(name) for name, total in earlier.items()]
    found = counted.agg(F.count(F.lit(1)).alias("rows"), *sums).first().asDict()

    def pick(i: int, c: str, j: int) -> Column:
        lo, hi, below = brackets[c][j]
        enough = F.col("cum__n") > ranks[c][j] - below + found.get(f"e{i}_{j}", 0)
        return F.min(F.when((F.col("_c") == i) & _within(v, lo, hi) & enough, v)).alias(f"v{i}_{j}")

    def picks(i: int, c: str) -> list[Column]:
        return [pick(i, c, j) for j in range(len(ranks[c]))]

    if found["rows"] <= task_rows:
        order = W.partitionBy("_c").orderBy("_v").rowsBetween(W.unboundedPreceding, W.currentRow)
        placed = counted.withColumn("cum__n", F.sum("_n").over(order))
        row = placed.agg(*[p for i, c in enumerate(columns) for p in picks(i, c)]).first()
        return {c: [row[f"v{i}_{j}"] for j in range(len(ranks[c]))] for i, c in enumerate(columns)}
    return {
        c: list(
            running_sums(counted.filter(F.col("_c") == i), "_v", ["_n"], task_rows=task_rows)
            .agg(*picks(i, c))
            .first()
        )
        for i, c in enumerate(columns)
    }


def _within(value: Column, lo, hi) -> Column:
    above = value.isNotNull() if lo is None else value >= F.lit(lo)
    return above if hi is None else above & (value <= F.lit(hi))


def _brackets(
    df: DataFrame, ranks: dict[str, Sequence[int]], sizes: dict[str, int]
) -> dict[str, list[tuple]]:
    """(low, high, rows below low) around each wanted rank, from two passes over all columns."""
    # One sketch per column answers for both ends of all its ranks.
    asked: dict[int, list[tuple[str, float]]] = {}
    for i, (column, wanted) in enumerate(ranks.items()):
        n = sizes[column]
        slack = 2 / SKETCH_ACCURACY + 2 / n
        for j, k in enumerate(wanted):
            for side, share in (("lo", k / n - slack), ("hi", (k + 1) / n + slack)):
                if 0 < share < 1:
                    asked.setdefault(i, []).append((f"{side}{i}_{j}", share))
    ends = {}
    if asked:
        names = list(ranks)
        sketches = [
            F.percentile_approx(as_column(names[i]), [s for _, s in entries], SKETCH_ACCURACY).alias(f"s{i}")
            for i, entries in asked.items()
        ]
        row = df.agg(*sketches).first()
        ends = {name: v for i, entries in asked.items() for (name, _), v in zip(entries, row[f"s{i}"])}
    lows = {
        f"lo{i}_{j}": as_column(c) < F.lit(ends[f"lo{i}_{j}"])
        for i, (c, wanted) in enumerate(ranks.items())
        for j in range(len(wanted))
        if f"lo{i}_{j}" in ends
    }
    below = {}
    if lows:
        below = df.agg(*[count_where(low).alias(name) for name, low in lows.items()]).first().asDict()
    return {
        c: [
            (ends.get(f"lo{i}_{j}"), ends.get(f"hi{i}_{j}"), below.get(f"lo{i}_{j}", 0))
            for j in range(len(wanted))
        ]
        for i, (c, wanted) in enumerate(ranks.items())
    }


def quantiles(
    df: DataFrame,
    columns: Sequence[str],
    shares: Sequence[float],
    task_rows: int | None = None,
) -> dict[str, list[float | None]]:
    """Exact, linearly interpolated quantiles of the non-NULL values of each column.

    Up to ``task_rows`` values in all columns the built-in ``percentile`` does it in one job. Its
    buffers hold every distinct value, so larger tables go through :func:`order_values` instead.
    """
    row = df.agg(*[F.count(as_column(c)).alias(f"n{i}") for i, c in enumerate(columns)]).first()
    counts = {c: row[f"n{i}"] for i, c in enumerate(columns)}
    task_rows = task_rows or session.task_rows(df.sparkSession)
    if sum(counts.values()) <= task_rows:
        exact = df.agg(
            *[
                F.percentile(as_column(c).cast("double"), list(shares)).alias(f"q{i}")
                for i, c in enumerate(columns)
            ]
        ).first()
        empty = [None] * len(shares)
        return {c: exact[f"q{i}"] or empty for i, c in enumerate(columns)}

    places = {c: [(n - 1) * s for s in shares] for c, n in counts.items() if n}
    ranks = {
        c: sorted({r for p in ps for r in (math.floor(p), math.ceil(p))})
        for c, ps in places.items()
    }
    numbers = df.select(*[as_column(c).cast("double").alias(c) for c in columns])
    values = {
        c: dict(zip(ranks[c], found))
        for c, found in order_values(numbers, ranks, task_rows, counts).items()
    }
    result: dict[str, list[float | None]] = {}
    for c in columns:
        if not counts[c]:
            result[c] = [None] * len(shares)
            continue
        result[c] = [
            _between(values[c][math.floor(p)], values[c][math.ceil(p)], p - math.floor(p))
            for p in places[c]
        ]
    return result


def _between(low: float, high: float, part: float) -> float:
    return float(low) if low == high else float(low) * (1 - part) + float(high) * part


def grouped_quantile(
    df: DataFrame, columns: Sequence[str], share: float, by: str, task_rows: int | None = None
) -> DataFrame:
    """(``by``, one column per name): exact, linearly interpolated quantile of each group.

    A mergeable sketch per group and column brackets the two middle ranks. The brackets are joined to
    the rows, never fetched: values below a bracket are counted, those inside it are counted by value,
    those above it end there. A group that its bracket misses is counted whole. Any number of groups,
    and groups of any size, take the same passes; ``df`` is read twice and should be a stored table.
    NaN is the highest value; a group without values has NULL.
    """
    values = [as_column(c).cast("double") for c in columns]
    rows = df.select(F.col(quoted(by)).alias("_by"), *[v.alias(f"_v{i}") for i, v in enumerate(values)])
    sketched = rows.groupBy("_by").agg(
        *[F.count(f"_v{i}").alias(f"_n{i}") for i in range(len(columns))],
        *[count_where(~F.isnan(f"_v{i}")).alias(f"_m{i}") for i in range(len(columns))],
        *[
            F.kll_sketch_agg_double(F.when(~F.isnan(f"_v{i}"), F.col(f"_v{i}")), GROUP_SKETCH).alias(f"_s{i}")
            for i in range(len(columns))
        ],
    )
    brackets = written(sketched.select("_by", *[_bracket(i, share) for i in range(len(columns))]), "group-brackets")
    picked = written(_picked(rows, brackets, len(columns), share, task_rows), "group-ranks")
    missed = picked.filter("not held").select("_by", "_c")
    if not missed.isEmpty():
        # Brackets of the missed groups are opened, all others have nothing to find.
        open_ = missed.groupBy("_by").agg(F.collect_set("_c").alias("_cs")).withColumnRenamed("_by", "_of")
        whole = brackets.join(open_, F.col("_by").eqNullSafe(F.col("_of")))
        whole = whole.select(
            "_by",
            *[
                F.when(
                    F.array_contains("_cs", i),
                    F.struct(f"_b{i}.n", F.lit(None).cast("double").alias("lo"), F.lit(None).cast("double").alias("hi")),
                ).alias(f"_b{i}")
                for i in range(len(columns))
            ],
        )
        again = _picked(rows, written(whole, "open-brackets"), len(columns), share, task_rows)
        picked = picked.filter("held").unionByName(again)
    found = picked.groupBy("_by").agg(*[F.max(F.when(F.col("_c") == i, F.col("value"))).alias(c) for i, c in enumerate(columns)])
    groups = brackets.select(F.col("_by").alias(by))
    return groups.join(found, F.col(quoted(by)).eqNullSafe(F.col("_by")), "left").drop("_by")


def _bracket(i: int, share: float) -> Column:
    """(n, lo, hi): values of a group, and bounds around its two middle ranks; NULL is no bound.

    Small groups, which are counted whole at no cost, have none.
    """
    n, m = F.col(f"_n{i}"), F.col(f"_m{i}")

    def bound(part: float) -> Column:
        if not 0 < part < 1:
            return F.lit(None).cast("double")
        return F.when(m > SMALL_GROUP, F.kll_sketch_get_quantile_double(f"_s{i}", F.lit(part)))

    return F.when(n > 0, F.struct(n.alias("n"), bound(share - GROUP_SLACK).alias("lo"), bound(share + GROUP_SLACK).alias("hi"))).alias(f"_b{i}")


def _picked(rows: DataFrame, brackets: DataFrame, columns: int, share: float, task_rows: int | None) -> DataFrame:
    """(_by, _c, value, held): each group's quantile, and whether its ranks lie in its bracket."""
    sides = brackets.withColumnRenamed("_by", "_of")
    # An aggregation's size is unknown to the planner; below a checked size no row is shuffled.
    joined = rows.join(broadcast_if_small(sides), F.col("_by").eqNullSafe(F.col("_of")))
    entries = []
    for i in range(columns):
        v, b = F.col(f"_v{i}"), F.col(f"_b{i}")
        below = F.coalesce(v < b["lo"], F.lit(False))
        above = F.coalesce(v > b["hi"], F.lit(False))
        # What is below has no value of its own: one count per group.
        entry = F.struct(F.lit(i).alias("c"), F.when(~below, v).alias("v"))
        entries.append(F.when(v.isNotNull() & b.isNotNull() & ~above, entry))
    kept = joined.select("_by", F.explode(F.array_compact(F.array(*entries))).alias("_e"))
    counted = kept.groupBy("_by", F.col("_e.c").alias("_c"), F.col("_e.v").alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
    placed = running_sums(counted, "_v", ["_n"], task_rows=task_rows, by=["_by", "_c"])
    sizes = brackets.select(
        F.col("_by").alias("_of"),
        F.explode(F.array(*[F.struct(F.lit(i).alias("c"), F.col(f"_b{i}.n").alias("n")) for i in range(columns)])).alias("_e"),
    ).filter("_e.n is not null")
    at = (F.col("_e.n") - 1) * F.lit(share)
    sizes = broadcast_if_small(sizes.select("_of", F.col("_e.c").alias("_k"), at.alias("_at")))
    ranked = placed.join(sizes, F.col("_by").eqNullSafe(F.col("_of")) & (F.col("_c") == F.col("_k")))

    # The first value that reaches a rank; below the bracket there is none, beyond it no entry.
    reached = ranked.groupBy("_by", "_c", "_at").agg(
        F.min(F.when(F.col("cum__n") > F.floor("_at"), F.struct("cum__n", "_v"))).alias("_lo"),
        F.min(F.when(F.col("cum__n") > F.ceil("_at"), F.struct("cum__n", "_v"))).alias("_hi"),
    )
    lo, hi, part = F.col("_lo._v"), F.col("_hi._v"), F.col("_at") - F.floor("_at")
    between = F.when(lo == hi, lo).otherwise(lo * (1 - part) + hi * part)
    return reached.select("_by", "_c", between.alias("value"), (lo.isNotNull() & hi.isNotNull()).alias("held"))


def hash_positions(
    df: DataFrame,
    ids: Sequence[str],
    seed: int = SEED,
    name: str = "position",
    digits: int = HEX_DIGITS,
) -> DataFrame:
    """Place of each row (from 0) in the seeded shuffle, i.e. in the order of its hash.

    Leading hex digits of the hash are evenly filled buckets whatever the data looks like; their
    16 ** ``digits`` totals give each bucket's offset, and rows are numbered inside buckets.
    """
    keyed = df.withColumn("_hash", hash_key(ids, seed)).withColumn(
        "_bucket", F.substring("_hash", 1, digits)
    )
    before = W.orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    offsets = (
        keyed.groupBy("_bucket")
        .agg(F.count(F.lit(1)).alias("_n"))
        .select("_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    )
    inside = W.partitionBy("_bucket").orderBy("_hash", *[quoted(i) for i in ids])
    return (
        keyed.join(F.broadcast(offsets), "_bucket")
        .withColumn(name, (F.row_number().over(inside) - 1 + F.col("_offset")).cast("bigint"))
        .drop("_hash", "_bucket", "_offset")
    )


def hash_quota(
    df: DataFrame,
    ids: Sequence[str],
    quota: Column,
    by: Sequence[str] = (),
    seed: int = SEED,
    name: str = "taken",
    digits: int = HEX_DIGITS,
) -> DataFrame:
    """Mark the first ``quota`` rows of the seeded shuffle, per group of ``by``.

    ``ids`` identify a row, and ``quota`` may use ``group_rows``, the size of the group. Counting per
    hash bucket finds the one bucket in which each group's quota ends; only its rows (one in
    16 ** ``digits``) are shuffled and numbered, which gives the group's last hash. The rows
    themselves are compared with that hash where they are. ``df`` is read three times and should be
    a stored table.
    """
    digest = hash_key(ids, seed)
    names = [f"_g{i}" for i in range(len(by))]
    group = [F.col(quoted(c)).alias(n) for c, n in zip(by, names)]
    keyed = df.select(*group, digest.alias("_hash"), F.substring(digest, 1, digits).alias("_bucket"))
    totals = keyed.groupBy(*names, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    running = W.partitionBy(*names).orderBy("_bucket")
    cuts = (
        totals.withColumn("_end", F.sum("_n").over(running))
        .withColumn("group_rows", F.sum("_n").over(W.partitionBy(*names)))
        .withColumn("_quota", quota.cast("bigint"))
        .filter(F.col("_end") >= F.col("_quota"))
        .groupBy(*names)
        .agg(
            F.min(F.struct("_bucket", (F.col("_quota") - F.col("_end") + F.col("_n")).alias("rest")))
            .alias("_c")
        )
        .select(*[F.col(n).alias(f"_of{n}") for n in names], F.col("_c._bucket").alias("_cut"), F.col("_c.rest").alias("_rest"))
    )
    cuts = broadcast_if_small(written(cuts, "cuts"))
    same = [F.col(n).eqNullSafe(F.col(f"_of{n}")) for n in names]
    edge = keyed.join(cuts, reduce(lambda x, y: x & y, same, F.col("_bucket") == F.col("_cut")))
    place = F.row_number().over(W.partitionBy(*names).orderBy("_hash"))
    last = edge.withColumn("_at", place).filter(F.col("_at") == F.col("_rest")).select(*names, F.col("_hash").alias("_last"))
    # A cut without rows to take keeps the bucket's prefix, which is below every hash in it.
    on = reduce(lambda x, y: x & y, same) if same else F.lit(True)
    limits = cuts.join(last, on, "left").select(
        *[f"_of{n}" for n in names], F.coalesce("_last", "_cut").alias("_limit")
    )
    limits = broadcast_if_small(written(limits, "limits"))
    # A group whose quota exceeds its size has no limit and is taken whole.
    held = [F.col(quoted(c)).eqNullSafe(F.col(f"_of{n}")) for c, n in zip(by, names)] or [F.lit(True)]
    placed = df.join(limits, reduce(lambda x, y: x & y, held), "left")
    taken = F.col("_limit").isNull() | (digest <= F.col("_limit"))
    return placed.select(*[F.col(quoted(c)) for c in df.columns], taken.alias(name))


def top_rows(
    df: DataFrame, score: str, id_column: str | Sequence[str], count: int, task_rows: int | None = None
) -> Column:
    """Condition that holds for exactly ``count`` rows: the highest scores, lower ids first on ties."""
    return top_rows_of(df, {score: count}, id_column, task_rows)[score]


def top_rows_of(
    df: DataFrame, counts: dict[str, int], id_column: str | Sequence[str], task_rows: int | None = None
) -> dict[str, Column]:
    """For each score, the condition that holds for exactly its count of rows: the highest, lower ids
    first on ties.

    An id is a column of any type that can be ordered, or several that are compared in turn. Two order
    statistics per score are looked up, those of all scores in the same passes (the cut score, and the
    cut id among rows that share it), so applying the conditions needs no sort and no shuffle.
    """
    scores = list(counts)
    row = df.agg(*[F.count(F.col(quoted(c))).alias(f"n{i}") for i, c in enumerate(scores)]).first()
    sizes = {c: row[f"n{i}"] for i, c in enumerate(scores)}
    out = {c: F.lit(False) if counts[c] <= 0 else F.col(quoted(c)).isNotNull() for c in scores}
    ranks = {c: [sizes[c] - counts[c]] for c in scores if 0 < counts[c] < sizes[c]}
    if not ranks:
        return out
    cuts = {c: F.lit(found[0]) for c, found in order_values(df, ranks, task_rows, sizes).items()}
    row = df.agg(
        *[count_where(F.col(quoted(c)) > cuts[c]).alias(f"above{i}") for i, c in enumerate(ranks)],
        *[count_where(F.col(quoted(c)) == cuts[c]).alias(f"level{i}") for i, c in enumerate(ranks)],
    ).first()
    names = [id_column] if isinstance(id_column, str) else list(id_column)
    key = F.col(quoted(names[0])) if len(names) == 1 else F.struct(*[quoted(c) for c in names])
    level, id_ranks, id_sizes = {}, {}, {}
    for i, c in enumerate(ranks):
        if row[f"above{i}"] + row[f"level{i}"] == counts[c]:
            out[c] = F.col(quoted(c)) >= cuts[c]
            continue
        level[c] = F.when(F.col(quoted(c)) == cuts[c], key).alias(f"_id{i}")
        id_ranks[f"_id{i}"] = [counts[c] - row[f"above{i}"] - 1]
        id_sizes[f"_id{i}"] = row[f"level{i}"]
    if level:
        ids = df.select(*level.values())
        last = order_values(ids, id_ranks, task_rows, id_sizes)
        for i, c in enumerate(ranks):
            if c in level:
                limit = literal(last[f"_id{i}"][0], ids.schema[f"_id{i}"].dataType)
                out[c] = (F.col(quoted(c)) > cuts[c]) | ((F.col(quoted(c)) == cuts[c]) & (key <= limit))
    return out
