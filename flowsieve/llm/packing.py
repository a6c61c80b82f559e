"""Packing into optimal length buckets.

The lengths of all documents are counted in one global histogram. Dynamic programming over it chooses
the bucket boundaries with the least padding, and batches of a token budget are filled inside each
bucket, every document padded to the longest that its bucket may hold.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from flowsieve.session import written

BUCKETS = 16
BATCH_TOKENS = 65_536
# Lengths up to EXACT are cells of the histogram by themselves; beyond, an octave has CELLS cells. The
# histogram has a few thousand rows whatever the corpus, and each cell knows its true longest length.
EXACT = 1_024
CELLS = 128


def token_count(text: Column) -> Column:
    """Words between ASCII white space. A null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("bigint")


def _cell(n: Column) -> Column:
    above = F.floor(F.log2(n / F.lit(EXACT)) * CELLS) + EXACT + 1
    return F.when(n <= EXACT, n).otherwise(above)


def bucket_ends(counts: list[int], sums: list[int], longest: list[int], buckets: int) -> list[int]:
    """Longest lengths of at most ``buckets`` runs of cells with the least padding in total.

    The cells come in order of length. Of equally good choices the one with the shorter last bucket's
    start wins at each step, and no more buckets are used than help.
    """
    m = len(counts)
    if not m:
        return []
    n, s, top = np.cumsum([0, *counts]), np.cumsum([0, *sums]), np.array(longest, dtype=float)
    # cost[i, j]: padding when cells i to j share a bucket.
    cost = (n[None, 1:] - n[:-1, None]) * top[None, :] - (s[None, 1:] - s[:-1, None])
    cost[np.tril_indices(m, -1)] = np.inf
    best, choice = cost[0].copy(), []
    for _ in range(1, min(buckets, m)):
        # A bucket over cells i to j after the best of what ends at i - 1.
        total = np.full((m, m), np.inf)
        total[1:] = best[:-1, None] + cost[1:]
        at = total.argmin(0)
        better = total[at, np.arange(m)]
        gain = better < best
        choice.append(np.where(gain, at, -1))
        best = np.where(gain, better, best)
    ends, j, k = [], m - 1, len(choice) - 1
    while j >= 0:
        ends.append(int(longest[j]))
        while k >= 0 and choice[k][j] < 0:
            k -= 1
        if k < 0:
            break
        j, k = int(choice[k][j]) - 1, k - 1
    return ends[::-1]


def pack(
    documents: DataFrame,
    tokens: Column | None = None,
    buckets: int = BUCKETS,
    batch_tokens: int = BATCH_TOKENS,
) -> DataFrame:
    """(doc_id, n_tokens, bucket, bucket_tokens, batch, slot), one row per document.

    ``bucket_tokens``: the length its bucket pads to; ``batch``: number of its batch in the bucket, from
    0; ``slot``: its place there. A batch holds as many documents as fit into ``batch_tokens`` at their
    padded length; a document longer than that is a batch by itself and is never cut. Inside a bucket,
    documents are in the order of a hash of doc_id and text.

    Null and empty texts have no tokens and are packed with the shortest. Null and repeated ids are
    documents like others. Other columns are ignored; an empty table gives no rows.
    """
    tokens = token_count(F.col("text")) if tokens is None else tokens
    lengths = documents.select(
        "doc_id",
        tokens.alias("n_tokens"),
        F.xxhash64("doc_id", "text").alias("place"),
    )
    lengths = written(lengths, "lengths")
    cells = (
        lengths.groupBy(_cell(F.col("n_tokens")).alias("cell"))
        .agg(F.count(F.lit(1)).alias("n"), F.sum("n_tokens").alias("sum"), F.max("n_tokens").alias("max"))
        .collect()
    )
    cells.sort(key=lambda c: c["max"])
    ends = bucket_ends([c.n for c in cells], [c["sum"] for c in cells], [c["max"] for c in cells], buckets)
    total = sum(c.n for c in cells)
    bucket = reduce(lambda x, y: x + y, [(F.col("n_tokens") > e).cast("int") for e in ends], F.lit(0))
    sizes = F.array(*[F.lit(e).cast("bigint") for e in ends or [0]])
    # Documents of a bucket are numbered in two levels, each about the root of their number.
    chunks = max(math.isqrt(total), 1)
    placed = lengths.withColumn("bucket", bucket).withColumn("chunk", F.pmod("place", F.lit(chunks)))
    earlier = W.partitionBy("bucket").orderBy("chunk").rowsBetween(W.unboundedPreceding, -1)
    offsets = (
        placed.groupBy("bucket", "chunk")
        .agg(F.count(F.lit(1)).alias("n"))
        .select("bucket", "chunk", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("offset"))
    )
    inside = W.partitionBy("bucket", "chunk").orderBy("place", "doc_id", "n_tokens")
    number = F.col("offset") + F.row_number().over(inside) - 1
    length = F.element_at(sizes, F.col("bucket") + 1)
    held = F.greatest(F.floor(F.lit(batch_tokens) / F.greatest("bucket_tokens", F.lit(1))), F.lit(1))
    return (
        placed.join(offsets, ["bucket", "chunk"])
        .withColumn("number", number)
        .withColumn("bucket_tokens", length)
        .withColumn("held", held)
        .select(
            "doc_id",
            "n_tokens",
            "bucket",
            "bucket_tokens",
            F.floor(F.col("number") / F.col("held")).alias("batch"),
            (F.col("number") % F.col("held")).alias("slot"),
        )
    )
