"""Labelled rows to learn from: which ones, how many, and dealt into which blocks."""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowsieve.session import written

# Rows a classifier is fitted on at most, and rows and bytes of text of the blocks they are dealt into.
TRAIN_ROWS = 24_000
BLOCK_ROWS = 3_000
BLOCK_BYTES = 16_000_000


def id_remainder(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id's text, modulo ``modulus``; null for a null id."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(modulus))


def training_rows(
    documents: DataFrame, labels: DataFrame, label: str, learnt: Column, rows: int = TRAIN_ROWS
) -> DataFrame:
    """(row, block, weight, label, text) of at most ``rows`` labelled documents for which ``learnt`` holds.

    Labels are bounded before texts are read: the ids with the smallest hashes are broadcast. A null
    label or id teaches nothing; of several labels of an id the highest counts. Equal texts of an id are
    one row, whose ``weight`` is their number; different texts of an id are rows of their own, bounded
    by a hash again. ``row`` counts from 0. Blocks hold ``BLOCK_ROWS`` rows at most and, unless a text
    is longer, about ``BLOCK_BYTES``.
    """
    known = (
        labels.filter(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & learnt)
        .groupBy("doc_id")
        .agg(F.max(F.col(label).cast("int")).alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(rows)
    )
    known = written(known, "labels")
    keyed = documents.select("doc_id", "text", F.xxhash64("text").alias("text_key"))
    # Keys and sizes alone are counted and bounded, so that no copy of a text leaves its task.
    distinct = (
        keyed.join(F.broadcast(known), "doc_id")
        .groupBy("doc_id", "text_key", "label")
        .agg(F.count(F.lit(1)).alias("weight"), F.coalesce(F.max(F.octet_length("text")), F.lit(0)).alias("size"))
        .orderBy(F.xxhash64("doc_id", "text_key"), "doc_id", "text_key")
        .limit(rows)
    )
    found = distinct.collect()
    dealt = [
        (r.doc_id, r.text_key, row, block, r.weight, r.label)
        for row, (r, block) in enumerate(zip(found, dealt_blocks([r["size"] for r in found])))
    ]
    id_type = distinct.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {id_type}, text_key long, row int, block int, weight long, label int"
    dealt = documents.sparkSession.createDataFrame(dealt, schema)
    chosen = keyed.join(F.broadcast(dealt), ["doc_id", "text_key"]).select("row", "block", "weight", "label", "text")
    if all(r.weight == 1 for r in found):
        return chosen
    once = chosen.filter("weight > 1").dropDuplicates(["row"])
    return chosen.filter("weight = 1").unionByName(once)


def dealt_blocks(sizes: list[int]) -> list[int]:
    """A block for each row: the longest first, each to the block with the fewest bytes that has room."""
    blocks = max(-(-len(sizes) // BLOCK_ROWS), -(-sum(sizes) // BLOCK_BYTES), 1)
    heap = [(0, 0, block) for block in range(blocks)]
    out = [0] * len(sizes)
    for place in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        held, n, block = heapq.heappop(heap)
        out[place] = block
        if n + 1 < BLOCK_ROWS:
            heapq.heappush(heap, (held + sizes[place], n + 1, block))
    return out
