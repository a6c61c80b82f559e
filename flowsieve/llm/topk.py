"""Exact top-k search by distributed histogram selection.

Every vector is scored against the queries in blocks. The scores themselves are never kept: each
pass counts, per query, the scores that fall into the bins of a range, the counts are summed over
all tasks, and the bin with the k-th highest score becomes the next range, until a bin is one score
wide. A last pass keeps what lies above that score and, of its ties, the smallest ids needed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from flowsieve.session import written

# Queries handled in one round of passes. It bounds what is broadcast and what a task counts.
QUERY_BLOCK = 2_048
BINS = 256
# Candidate rows scored at once: a block of scores has QUERY_BLOCK * ROWS numbers.
ROWS = 512
EXACT = 2**53


def quantised(vector: Column, scale: int = 1024) -> Column:
    """floor(scale * x) of each component, as longs."""
    return F.transform(vector, lambda x: F.floor(x.cast("double") * F.lit(float(scale))))


def usable(vector: Column) -> Column:
    """False for a null vector or one with a null, NaN or infinite component."""
    finite = F.forall(
        vector,
        lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < F.lit(float("inf"))),
    )
    return F.coalesce(vector.isNotNull() & finite, F.lit(False))


def prepared(df: DataFrame, id_column: str, vector: str, scale: int = 1024) -> DataFrame:
    """(id, row, v): every row with an id and a usable vector; ``row`` tells rows of one id apart.

    Row numbers are given as rows are read, so the table has to be written before it is used.
    """
    v = F.col(vector)
    rows = df.filter(F.col(id_column).isNotNull() & usable(v))
    return rows.select(
        F.col(id_column).cast("bigint").alias("id"), F.monotonically_increasing_id().alias("row"), quantised(v, scale).alias("v")
    )


def top_k(vectors: DataFrame, queries: Column, k: int, query_block: int = QUERY_BLOCK) -> DataFrame:
    """The ``k`` best rows for each row that satisfies ``queries``, as (query_id, rank, vec_id, score).

    ``vectors`` is (id, row, v) as from :func:`prepared`, written beforehand, as each pass reads it.
    Score: inner product of the integer vectors, a shorter one continued with zeros. A query does
    not find its own row; other rows of its id are candidates like any, and queries of their own.
    Fewer than ``k`` other rows: all of them. Ties go to the smaller id. No rows, or no queries: no
    result rows.
    """
    spark = vectors.sparkSession
    # Blocks of consecutive ids, cut at exact places of the ordered query ids.
    chosen = written(vectors.filter(queries), "topk-queries")
    total = chosen.count()
    parts: list[DataFrame] = []
    rest = chosen
    for _ in range(-(-total // query_block)):
        block = rest.orderBy("id", "row").limit(query_block).collect()
        last = block[-1]
        rest = chosen.filter((F.col("id") > last.id) | ((F.col("id") == last.id) & (F.col("row") > last.row)))
        parts.append(written(_block_top_k(vectors, block, k), "topk-found"))
    if not parts:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score bigint")
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result


class _Scorer:
    """Scores of a block of queries against batches of candidates."""

    def __init__(self, queries: list):
        self.ids, self.rows = (np.array([q[c] for q in queries], np.int64) for c in ("id", "row"))
        self.matrix = _matrix([q.v for q in queries], max((len(q.v) for q in queries), default=0))
        self.floats = self.matrix.astype(float)
        self.largest = int(np.abs(self.matrix).max(initial=0))

    def batches(self, frames: Iterator[pd.DataFrame]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(candidate ids, scores by query and candidate, False where a query meets itself)."""
        for frame in frames:
            for at in range(0, len(frame), ROWS):
                part = frame.iloc[at : at + ROWS]
                ids, own = part["id"].to_numpy(np.int64), part["row"].to_numpy(np.int64)
                width = self.matrix.shape[1]
                rows = _matrix([r[:width] for r in part["v"]], width)
                bound = self.largest * int(np.abs(rows).max(initial=0)) * max(width, 1)
                if bound < EXACT:
                    scores = (self.floats @ rows.T.astype(float)).astype(np.int64)
                else:
                    scores = self.matrix @ rows.T
                yield ids, scores, own[None, :] != self.rows[:, None]


def _matrix(rows, width: int) -> np.ndarray:
    out = np.zeros((len(rows), width), np.int64)
    for i, row in enumerate(rows):
        out[i, : len(row)] = row
    return out


def _best(found: np.ndarray, k: int) -> np.ndarray:
    """Of columns (query, id, score), the first ``k`` of each query: high scores, then small ids."""
    found = found[:, np.lexsort((found[1], -found[2], found[0]))]
    new = np.ones(found.shape[1], bool)
    new[1:] = found[0, 1:] != found[0, :-1]
    first = np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))
    return found[:, np.arange(len(new)) - first < k]


def _block_top_k(vectors: DataFrame, block: list, k: int) -> DataFrame:
    scorer = _Scorer(block)
    n = len(block)

    def extremes(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        low, high = np.full(n, np.iinfo(np.int64).max), np.full(n, np.iinfo(np.int64).min)
        count = np.zeros(n, np.int64)
        for _, scores, other in scorer.batches(frames):
            low = np.minimum(low, np.where(other, scores, np.iinfo(np.int64).max).min(1))
            high = np.maximum(high, np.where(other, scores, np.iinfo(np.int64).min).max(1))
            count += other.sum(1)
        seen = np.flatnonzero(count)
        yield pd.DataFrame({"q": seen, "low": low[seen], "high": high[seen], "n": count[seen]})

    found = (
        vectors.mapInPandas(extremes, "q int, low long, high long, n long")
        .groupBy("q")
        .agg(F.min("low").alias("low"), F.max("high").alias("high"), F.sum("n").alias("n"))
        .collect()
    )
    low, high = np.zeros(n, np.int64), np.full(n, -1, np.int64)
    wanted = np.zeros(n, np.int64)  # rank of the searched score, counted from the highest in the range
    for row in found:
        low[row.q], high[row.q], wanted[row.q] = row.low, row.high, min(k, row.n)

    # Invariant: the k-th highest score of a query is the wanted[q]-th highest in [low, high].
    while (wide := np.flatnonzero(high > low)).size:
        width = -(-(high - low + 1) // BINS)

        def histogram(frames: Iterator[pd.DataFrame], low=low, high=high, width=width, wide=wide):
            counts = np.zeros((n, BINS), np.int64)
            for _, scores, other in scorer.batches(frames):
                inside = other & (scores >= low[:, None]) & (scores <= high[:, None])
                q, c = np.nonzero(inside)
                bins = (scores[q, c] - low[q]) // width[q]
                counts += np.bincount(q * BINS + bins, minlength=n * BINS).reshape(n, BINS)
            q, b = np.nonzero(counts[wide])
            yield pd.DataFrame({"q": wide[q], "b": b, "n": counts[wide[q], b]})

        counted = vectors.mapInPandas(histogram, "q int, b int, n long").groupBy("q", "b")
        table = np.zeros((n, BINS), np.int64)
        for row in counted.agg(F.sum("n").alias("n")).collect():
            table[row.q, row.b] = row.n
        for q in wide:
            above = 0
            for b in range(BINS - 1, -1, -1):
                if above + table[q, b] >= wanted[q]:
                    break
                above += table[q, b]
            wanted[q] -= above
            bottom = low[q]
            low[q] = bottom + b * width[q]
            high[q] = min(high[q], low[q] + width[q] - 1)

    cut = low

    def kept(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # Any number of rows may tie with the cut: a task passes on its k best per query.
        best = np.zeros((3, 0), np.int64)
        for ids, scores, other in scorer.batches(frames):
            q, c = np.nonzero(other & (scores >= cut[:, None]) & (high >= low)[:, None])
            best = _best(np.concatenate([best, [q, ids[c], scores[q, c]]], axis=1), k)
        yield pd.DataFrame(
            {"query_id": scorer.ids[best[0]], "query_row": scorer.rows[best[0]], "vec_id": best[1], "score": best[2]}
        )

    ordered = W.partitionBy("query_row").orderBy(F.desc("score"), "vec_id")
    return (
        vectors.mapInPandas(kept, "query_id long, query_row long, vec_id long, score long")
        .withColumn("rank", F.row_number().over(ordered))
        .filter(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )
