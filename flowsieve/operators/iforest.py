"""Isolation forest (Liu, Ting, Zhou 2008) on DataFrames.

Every draw is a hash of (row id, tree, node, seed), so the forest does not depend on partitioning
and can be rebuilt by any SQL engine.

Sample. Each tree needs ``min(256, n)`` rows. Rows are shuffled by hash and cut into blocks of that
size, one block per tree; if the table is too small for that many disjoint blocks, it is shuffled
again with another salt ("lap"). So one hash per row suffices however many trees there are.

Build. At most ``trees * 256`` sample rows are hash-partitioned by tree once, and each tree is grown
where its rows are: one shuffle of a bounded sample, in one job.

Score. The node table is bounded by the parameters (``trees * 2 ** (depth + 1)`` rows), never by the
data, so it is fetched and broadcast as arrays, and rows are scored in one narrow Arrow pass.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from flowsieve.functions.columns import SEED, hash_key, quoted
from flowsieve.operators.ordering import hash_quota, quantiles
from flowsieve.session import written

TREES = 200
SAMPLE_ROWS = 256
# Path lengths are summed as whole millionths: the sum is exact in any order of addition.
MICRO = 1_000_000
EULER_GAMMA = 0.5772156649015329


def average_path(n: float) -> float:
    """Expected depth of an unsuccessful search among n points, c(n) of the paper."""
    if n <= 1:
        return 0.0
    if n == 2:
        return 1.0
    return 2.0 * (math.log(n - 1.0) + EULER_GAMMA) - 2.0 * (n - 1.0) / n


def depth_limit(sample_rows: int) -> int:
    return max(1, math.ceil(math.log2(max(sample_rows, 2))))


@dataclass(frozen=True)
class Forest:
    """A fitted forest: its node table and the parameters needed to score with it.

    ``nodes`` has (tree, node, rows, feature, threshold, leaf_micro). Children of ``node`` are
    ``2 * node`` (value <= threshold) and ``2 * node + 1``. Leaves have no feature.
    """

    nodes: DataFrame
    features: tuple[str, ...]
    trees: int
    sample_rows: int

    @property
    def depth(self) -> int:
        return depth_limit(self.sample_rows)

    def path_micro(
        self, df: DataFrame, splits_only: bool = False, inputs: Sequence[Column] | None = None
    ) -> Column:
        """Column with the sum of path lengths over all trees, in millionths.

        A path length is the splits passed plus the expected rest at an impure leaf, or just the
        splits if ``splits_only``. ``inputs`` gives the features as expressions on ``df``, in order,
        where they are no columns of it.
        """
        arrays = df.sparkSession.sparkContext.broadcast(self._arrays(splits_only))
        width = self.depth

        @F.pandas_udf("bigint")
        def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.Series]:
            feature, threshold, leaf = arrays.value
            for batch in batches:
                values = np.ascontiguousarray(batch.to_numpy(dtype=float).T)
                yield pd.Series(_walk(values, feature, threshold, leaf, width))

        inputs = inputs or [F.col(quoted(f)) for f in self.features]
        return walk(F.struct(*[c.alias(f"f{k}") for k, c in enumerate(inputs)]))

    def score(
        self,
        df: DataFrame,
        keep: Sequence[str] | None = None,
        inputs: Sequence[Column] | None = None,
    ) -> DataFrame:
        """Add ``mean_path`` and ``anomaly_score`` in (0, 1], higher = more anomalous."""
        keep = df.columns if keep is None else keep
        expected = average_path(self.sample_rows) or 1.0
        return (
            df.withColumn("_path", self.path_micro(df, inputs=inputs))
            .select(*[quoted(c) for c in keep], (F.col("_path") / (MICRO * self.trees)).alias("mean_path"))
            .withColumn("anomaly_score", F.pow(F.lit(2.0), -F.col("mean_path") / expected))
        )

    def mean_depth(self, df: DataFrame, keep: Sequence[str]) -> DataFrame:
        """Mean number of splits per row over all trees."""
        path = self.path_micro(df, splits_only=True)
        return df.withColumn("_path", path).select(
            *[quoted(c) for c in keep], (F.col("_path") / (MICRO * self.trees)).alias("mean_depth")
        )

    def _arrays(self, splits_only: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Node table as complete binary trees; a leaf is continued leftwards to the last level."""
        nodes = self.nodes.toPandas()
        inner = 2**self.depth
        feature = np.zeros((self.trees, inner), dtype=np.int64)
        threshold = np.full((self.trees, inner), np.inf)
        leaf = np.zeros((self.trees, inner), dtype=np.int64)
        place = {name: i for i, name in enumerate(self.features)}
        split = nodes[nodes["feature"].notna()]
        tree, node = split["tree"].to_numpy(), split["node"].to_numpy()
        feature[tree, node] = split["feature"].map(place).to_numpy()
        threshold[tree, node] = split["threshold"].to_numpy()
        ends = nodes[nodes["feature"].isna()]
        node = ends["node"].to_numpy()
        level = np.floor(np.log2(node)).astype(int)
        last = node * 2 ** (self.depth - level) - inner
        length = level * MICRO if splits_only else ends["leaf_micro"].to_numpy()
        leaf[ends["tree"].to_numpy(), last] = length
        return feature, threshold, leaf


def _walk(
    values: np.ndarray, feature: np.ndarray, threshold: np.ndarray, leaf: np.ndarray, depth: int
) -> np.ndarray:
    """Summed leaf values for a batch of rows given as (features, rows), one tree at a time."""
    width = values.shape[1]
    flat, row = values.ravel(), np.arange(width)
    total = np.zeros(width, dtype=np.int64)
    for tree in range(feature.shape[0]):
        at, cut = feature[tree] * width, threshold[tree]
        node = np.ones(width, dtype=np.int64)
        for _ in range(depth):
            node = 2 * node + (flat[at[node] + row] > cut[node])
        total += leaf[tree][node - feature.shape[1]]
    return total


def fit_forest(
    df: DataFrame,
    features: Sequence[str],
    ids: Sequence[str],
    trees: int = TREES,
    sample_rows: int = SAMPLE_ROWS,
    seed: int = SEED,
) -> Forest:
    """Fit on finite, non-NULL ``features``; ``ids`` must identify a row."""
    n = df.count()
    if not n:
        raise ValueError("cannot fit a forest on an empty table")
    size = min(sample_rows, n)
    sample = tree_samples(df, features, ids, n, trees, size, seed)
    nodes = written(tree_nodes(sample, features, trees, size, seed), "forest")
    return Forest(nodes, tuple(features), trees, size)


def tree_samples(
    df: DataFrame,
    features: Sequence[str],
    ids: Sequence[str],
    n: int,
    trees: int,
    size: int,
    seed: int,
) -> DataFrame:
    """``size`` distinct rows for each of ``trees`` trees: columns tree and f0, f1, ..."""
    rows = df.select(
        *[F.col(quoted(i)).alias(f"_id{k}") for k, i in enumerate(ids)],
        *[F.col(quoted(f)).cast("double").alias(f"f{k}") for k, f in enumerate(features)],
    )
    keys = [f"_id{k}" for k in range(len(ids))]
    blocks = n // size
    laps = math.ceil(trees / blocks)
    if laps == 1:
        # Only the first trees * size rows of the shuffle are needed, out of any number.
        rows = hash_quota(rows, [*keys], F.lit(trees * size), seed=f"0:{seed}").filter("taken")
        rows = rows.withColumn("_lap", F.lit(0))
    else:
        rows = rows.withColumn("_lap", F.explode(F.sequence(F.lit(0), F.lit(laps - 1))))
    # At most trees * size rows per lap are left here, a bound set by the parameters.
    order = W.partitionBy("_lap").orderBy(hash_key(keys, F.col("_lap"), seed), *keys)
    place = F.row_number().over(order) - 1
    return (
        rows.withColumn("_place", place)
        .filter(F.col("_place") < blocks * size)
        .withColumn("tree", (F.col("_lap") * blocks + F.floor(F.col("_place") / size)).cast("int"))
        .filter(F.col("tree") < trees)
        .select("tree", *[f"f{k}" for k in range(len(features))])
    )


def tree_nodes(
    sample: DataFrame, features: Sequence[str], trees: int, size: int, seed: int
) -> DataFrame:
    """Grow each tree from its at most ``size`` sample rows, one tree per group.

    Growing all trees by one window per tree level needs no Python, but nine stacked windows over two
    columns per feature made the forest queries take more than twice as long at sf0.01.
    """
    # A fixed count, as adaptive execution would merge a sample this small into a single task.
    tasks = min(trees, sample.sparkSession.sparkContext.defaultParallelism)
    return (
        sample.repartition(tasks, "tree")
        .groupBy("tree")
        .applyInPandas(
            _grower(tuple(features), depth_limit(size), seed),
            "tree int, node int, rows bigint, feature string, threshold double, leaf_micro bigint",
        )
    )


def _grower(features: tuple[str, ...], limit: int, seed: int) -> Callable:
    names = [f"f{k}" for k in range(len(features))]

    def grow(rows: pd.DataFrame) -> pd.DataFrame:
        tree = int(rows["tree"].iloc[0])
        nodes, open_nodes = [], [(1, 0, rows[names].to_numpy(dtype=float))]
        while open_nodes:
            node, depth, values = open_nodes.pop()
            low, high = values.min(axis=0), values.max(axis=0)
            varying = np.flatnonzero(high > low)
            # Only features that still vary in the node can be drawn; without any, it is a leaf.
            if depth == limit or not len(varying):
                length = round(MICRO * (depth + average_path(len(values))))
                nodes.append((tree, node, len(values), None, None, length))
                continue
            digest = hashlib.md5(f"split:{tree}:{node}:{seed}".encode()).hexdigest()
            pick = varying[int(int(digest[:8], 16) / 16.0**8 * len(varying))]
            cut = low[pick] + int(digest[8:21], 16) / 16.0**13 * (high[pick] - low[pick])
            if cut >= high[pick]:
                # Rounding can reach the upper end, which would leave the right side empty.
                cut = low[pick]
            right = values[:, pick] > cut
            nodes.append((tree, node, len(values), features[pick], float(cut), None))
            open_nodes.append((2 * node, depth + 1, values[~right]))
            open_nodes.append((2 * node + 1, depth + 1, values[right]))
        columns = ["tree", "node", "rows", "feature", "threshold", "leaf_micro"]
        return pd.DataFrame(nodes, columns=columns).astype({"leaf_micro": "Int64"})

    return grow


def trace_paths(df: DataFrame, forest: Forest, tree: int, keep: Sequence[str]) -> DataFrame:
    """Ordered splits each row passes in one tree, and the depth at which it ends.

    The tree is one row of arrays (at most 2 ** (depth + 1) entries), broadcast to the rows.
    """
    width = 2 ** (forest.depth + 1)
    place = {name: i for i, name in enumerate(forest.features)}
    number = F.lit(None).cast("int")
    for name, i in place.items():
        number = F.when(F.col("feature") == name, F.lit(i)).otherwise(number)
    heap = (
        forest.nodes.filter(F.col("tree") == tree)
        .groupBy()
        .agg(F.map_from_entries(F.collect_list(F.struct("node", F.struct(number.alias("f"), "threshold")))).alias("m"))
        .select(F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda i: F.col("m")[i]).alias("heap"))
    )
    values = F.array(*[F.col(quoted(f)).cast("double") for f in forest.features])
    names = F.array(*[F.lit(f) for f in forest.features])
    start = F.array().cast(
        "array<struct<step:int,node:int,feature:string,threshold:double,value:double,went:string>>"
    )

    def advance(state: Column, step: Column) -> Column:
        node = state["node"]
        split = F.get(F.col("heap"), node)
        value = F.get(F.col("_values"), split["f"])
        # NaN and NULL go left, as in the scorer.
        right = F.coalesce((value > split["threshold"]) & ~F.isnan(value), F.lit(False))
        entry = F.struct(
            step.alias("step"),
            node.alias("node"),
            F.get(names, split["f"]).alias("feature"),
            split["threshold"].alias("threshold"),
            value.alias("value"),
            F.when(right, "right").otherwise("left").alias("went"),
        )
        moved = F.struct(
            (2 * node + F.when(right, 1).otherwise(0)).alias("node"),
            F.array_append(state["splits"], entry).alias("splits"),
        )
        return F.when(split["f"].isNull(), state).otherwise(moved)

    walked = df.select(*[quoted(c) for c in keep], values.alias("_values")).join(
        F.broadcast(heap), F.lit(True)
    )
    state = F.aggregate(
        F.sequence(F.lit(1), F.lit(forest.depth)),
        F.struct(F.lit(1).alias("node"), start.alias("splits")),
        advance,
    )
    return walked.select(*[quoted(c) for c in keep], state["splits"].alias("splits")).withColumn(
        "depth", F.size("splits")
    )


def split_counts(forest: Forest) -> DataFrame:
    """Splits per tree and feature, with totals per feature (tree NULL) and per tree."""
    counts = [
        F.count(F.when(F.col("feature") == f, 1)).alias(f) for f in forest.features
    ]
    return (
        forest.nodes.filter(F.col("feature").isNotNull())
        .rollup("tree")
        .agg(*counts, F.count(F.lit(1)).alias("splits"))
    )


def flag_lowest(df: DataFrame, score: str, share: float, task_rows: int | None = None) -> Column:
    """Condition for the ``share`` of rows with the lowest score: strictly below that quantile."""
    limit = {} if task_rows is None else {"task_rows": task_rows}
    cut = quantiles(df, [score], [share], **limit)[score][0]
    return F.col(quoted(score)) < F.lit(cut)


def decision_boundary(
    df: DataFrame, score: str, flag: str, fallback: float | None = None
) -> DataFrame:
    """Highest score that is still flagged; ``fallback``, or the lowest score, if none is."""
    flagged = F.max(F.when(F.col(flag) == 1, F.col(score)))
    other = F.min(score) if fallback is None else F.lit(fallback)
    return df.agg(F.coalesce(flagged, other).alias("boundary"))
