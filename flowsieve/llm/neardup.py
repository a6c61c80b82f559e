"""Near-duplicates by SuperMinHash signatures, banding, exact verification and union-find.

SuperMinHash ranks the places of a signature in a random permutation per shingle, and a shingle takes
its first place with a value below 1, its second with a value below 2, and so on. The places of one
shingle are thus different ones, which lowers the variance, and a text is done as soon as no later
value can be a minimum: a text with many shingles needs few of them.

Texts with equal shingle sets are one class. Classes that agree in a band are candidates, unless the
counts of their shingles by cells show that they have too few in common: the sum of the lesser counts
is never less than what is shared, so no link is lost. (Of sets of some thousands of shingles cells say
little, and most are compared.) Inside a band's bucket every class is compared with a leader drawn anew for
each band and round, so that a large group of near copies is connected by a few comparisons each; only
where a bucket still spans several components are its other pairs compared, each pair in one of the bands
that it shares.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowsieve.llm.components import components, merged
from flowsieve.llm.textbytes import NOT_SPACE, Chunk, distinct_per_text, mixed, shingles, text_chunks, words
from flowsieve.session import written

SHINGLE_WORDS, PERCENT = 5, 80
# A pair at 0.8 shares no band with probability (1 - 0.8 ** 5) ** 37, 4 in 10 million.
BANDS, BAND_ROWS = 37, 5
# Rounds of leaders at most; a round without a new link is the last.
LEADER_ROUNDS = 2
# A set is summed up by cells: how many shingles fall into each, counted to a depth. Two sets of 400
# shingles are told apart from links unless they are nearly as similar as asked.
CELLS, DEPTH = 1024, 2
_NUMBERS = CELLS * DEPTH // 64
# Texts whose cells are counted at once.
_COUNTED = 1024

_STEP = np.uint32(1 << 24)


def superminhash(text: np.ndarray, value: np.ndarray, texts: int, size: int) -> np.ndarray:
    """Signatures (texts x size) of distinct shingle hashes ``value``, ordered by ``text``.

    A value's upper 8 bits are the step at which it was given, its lower 24 bits a random number.
    """
    out = np.full((texts, size), 0xFFFFFFFF, np.uint32)
    flat = out.reshape(-1)
    order = None
    for step in range(size):
        if step:
            # Done: every value was given at an earlier step than this.
            active = out.max(1) >= np.uint32(step) * _STEP
            keep = active[text]
            if not keep.any():
                break
            if not keep.all():
                text, value = text[keep], value[keep]
                order = order[keep]
        drawn = mixed(value, step + 1)
        place = ((drawn >> np.uint64(32)) % np.uint64(size - step)).astype(np.int64) + step
        if order is None:
            order = np.tile(np.arange(size, dtype=np.uint8 if size <= 256 else np.uint16), (len(text), 1))
        at = np.arange(len(text))
        taken = order[at, place]
        order[at, place] = order[:, step]
        given = (drawn & np.uint64(0xFFFFFF)).astype(np.uint32) + np.uint32(step) * _STEP
        np.minimum.at(flat, text * size + taken.astype(np.int64), given)
    return out


def _sets(chunk: Chunk, shingle_words: int) -> tuple[np.ndarray, np.ndarray]:
    n = len(chunk.ends)
    return distinct_per_text(*shingles(words(chunk, NOT_SPACE), n, shingle_words))


def _class_keys(text: np.ndarray, value: np.ndarray, counts: np.ndarray) -> list[bytes | None]:
    """16 bytes that tell shingle sets apart; none for an empty set."""
    first = np.cumsum(counts) - counts
    total = np.zeros((len(counts), 2), np.uint64)
    some = counts > 0
    if some.any():
        for side in (0, 1):
            total[some, side] = np.add.reduceat(mixed(value, 101 + side), first[some])
    return [row.tobytes() if has else None for row, has in zip(total, some)]


def fingerprints(documents: DataFrame, shingle_words: int, bands: int, band_rows: int) -> DataFrame:
    """(doc_id, n_shingles, class, bands, sketch) of each document; ``bands`` is empty without shingles.

    ``sketch`` has a bit per cell that holds at least one of the shingles, then a bit per cell that holds at
    least two, and so on.
    """
    size = bands * band_rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in text_chunks(batch.column("text"), 1_000_000):
                n = len(chunk.ends)
                text, value = _sets(chunk, shingle_words)
                counts = np.bincount(text, minlength=n)
                signature = superminhash(text, value, n, size)
                sketch = _cells(text, value, n)
                signature = signature.reshape(n, bands, band_rows)
                keys = np.tile(np.arange(bands, dtype=np.uint64), (n, 1))
                for row in range(band_rows):
                    keys = mixed(keys * np.uint64(0xD6E8FEB86659FD93) + signature[:, :, row], row)
                some = counts > 0
                offsets = np.concatenate([[0], np.cumsum(some * bands)])
                bands_column = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(keys[some].reshape(-1).view(np.int64)))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(chunk.first, n),
                        pa.array(counts, pa.int64()),
                        pa.array(_class_keys(text, value, counts), pa.binary()),
                        bands_column,
                        pa.ListArray.from_arrays(
                            pa.array(np.arange(n + 1) * sketch.shape[1], pa.int32()), pa.array(sketch.reshape(-1).view(np.int64))
                        ),
                    ],
                    names=["doc_id", "n_shingles", "class", "bands", "sketch"],
                )

    slim = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return slim.mapInArrow(run, "doc_id long, n_shingles long, class binary, bands array<long>, sketch array<long>")


def _cells(text: np.ndarray, value: np.ndarray, texts: int) -> np.ndarray:
    """Per text, the bits of the cells of its distinct shingle hashes, 64 to a number."""
    out = np.zeros((texts, _NUMBERS), np.uint64)
    cell = (mixed(value, 71) % np.uint64(CELLS)).astype(np.int64)
    for at in range(0, texts, _COUNTED):
        n = min(_COUNTED, texts - at)
        own = slice(*np.searchsorted(text, [at, at + n]))
        held = np.bincount((text[own] - at) * CELLS + cell[own], minlength=n * CELLS).reshape(n, CELLS)
        bits = [np.packbits(held >= depth, axis=1, bitorder="little") for depth in range(1, DEPTH + 1)]
        out[at : at + n] = np.ascontiguousarray(np.concatenate(bits, axis=1)).view(np.uint64)
    return out


def _class_texts(documents: DataFrame, representatives: DataFrame, shingle_words: int) -> DataFrame:
    """(class, text): one text of each class in ``representatives`` (class, doc_id)."""

    def same_class(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # A repeated doc_id can bring another text; it is told by its class.
        for batch in batches:
            for chunk in text_chunks(batch.column("text")):
                n = len(chunk.ends)
                text, value = _sets(chunk, shingle_words)
                own = _class_keys(text, value, np.bincount(text, minlength=n))
                part = batch.slice(chunk.first, n)
                yield part.filter(pa.array([x == y for x, y in zip(own, part.column("class").to_pylist())], pa.bool_()))

    texts = representatives.join(documents.select("doc_id", "text"), "doc_id").select("class", "text")
    return texts.mapInArrow(same_class, "class binary, text string")


def _linked(pairs: DataFrame, texts: DataFrame, shingle_words: int, percent: int) -> DataFrame:
    """The pairs (a, b) of classes whose full shingle sets are as similar as asked."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # Rows that need the same leader's text follow each other only by chance: each is cut anew.
            for start in range(0, batch.num_rows, 200):
                part = batch.slice(start, 200)
                n, sides = part.num_rows, []
                for column in ("text_a", "text_b"):
                    found = [
                        (chunk.first + text, value)
                        for chunk in text_chunks(part.column(column))
                        for text, value in [_sets(chunk, shingle_words)]
                    ]
                    sides.append(tuple(np.concatenate(x) for x in zip(*found)))
                size = [np.bincount(row, minlength=n) for row, _ in sides]
                row, value = (np.concatenate([s[i] for s in sides]) for i in (0, 1))
                order = np.lexsort((value, row))
                row, value = row[order], value[order]
                twice = (row[1:] == row[:-1]) & (value[1:] == value[:-1])
                common = np.bincount(row[1:][twice], minlength=n)
                linked = 100 * common >= percent * (size[0] + size[1] - common)
                yield part.select(["a", "b"]).filter(pa.array(linked))

    text_a, text_b = (texts.select(F.col("class").alias(x), F.col("text").alias(f"text_{x}")) for x in "ab")
    return pairs.join(text_a, "a").join(text_b, "b").select("a", "b", "text_a", "text_b").mapInArrow(check, "a binary, b binary")


def with_cells(df: DataFrame) -> DataFrame:
    """``df`` with the numbers of ``sketch`` as columns s0, s1, ..., and ``held``, the shingles they count."""
    numbers = [F.col("sketch")[i] for i in range(_NUMBERS)]
    held = sum((F.bit_count(x) for x in numbers), F.lit(0))
    return df.select("*", *[x.alias(f"s{i}") for i, x in enumerate(numbers)], held.alias("held")).drop("sketch")


CELL_COLUMNS = [*[f"s{i}" for i in range(_NUMBERS)], "held"]


def may_link(x: str, y: str, percent: int) -> Column:
    """False for two sets that cannot be as similar as asked; ``x`` and ``y`` are what stands before the
    names of their columns (n and ``CELL_COLUMNS``).

    They share at most what their cells share, and what the cells of either did not count. The expression
    is kept short: it is evaluated for every two sets of a bucket.
    """
    n_x, n_y = F.col(f"{x}n"), F.col(f"{y}n")
    shared = sum((F.bit_count(F.col(f"{x}s{i}").bitwiseAND(F.col(f"{y}s{i}"))) for i in range(_NUMBERS)), F.lit(0))
    most = shared + F.least(n_x - F.col(f"{x}held"), n_y - F.col(f"{y}held"))
    return most * (100 + percent) >= percent * (n_x + n_y)


def in_first_band(x: str, y: str) -> Column:
    """True in the least of the bands that two classes share; ``earlier`` has a class's lesser bands."""
    return ~F.arrays_overlap(f"{x}earlier", f"{y}earlier")


def near_duplicates(
    documents: DataFrame,
    shingle_words: int = SHINGLE_WORDS,
    percent: int = PERCENT,
    bands: int = BANDS,
    band_rows: int = BAND_ROWS,
) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept), one row per document.

    Two documents are linked if their sets of ``shingle_words``-word shingles have at least ``percent``
    hundredths of their union in common; ``component_id`` is the smallest doc_id in reach, ``kept`` is
    true for that document. Words are runs of anything but ASCII white space, with A-Z lowered; a text
    with fewer words is one shingle.

    Null and empty texts have no shingles and no links. Rows without a doc_id are counted and kept but
    take no part in links (their component_id is null). Rows that share a doc_id share its component if
    their texts do, and are all kept or all not. Other columns are ignored; an empty table gives no
    rows.
    """
    prints = written(fingerprints(documents, shingle_words, bands, band_rows), "fingerprints")
    classed = prints.filter("class is not null and doc_id is not null")
    placed = classed.select(F.explode("bands").alias("band"), "class", F.col("n_shingles").alias("n"))
    shared = placed.groupBy("band").agg(F.min("class").alias("least"), F.max("class").alias("most"))
    shared = shared.filter("least <> most")
    # Classes of the bands that hold at least two.
    members = written(placed.join(shared, "band").select("band", "class", "n").distinct(), "band-members")
    sketches = classed.join(members.select("class"), "class", "left_semi").select("class", "sketch")
    bands_of = members.groupBy("class").agg(F.collect_set("band").alias("bands"))
    sketched = members.join(with_cells(sketches.dropDuplicates(["class"])), "class").join(bands_of, "class")
    earlier = F.filter("bands", lambda b: b < F.col("band"))
    members = written(sketched.withColumn("earlier", earlier).drop("bands"), "sketched-members")
    firsts = written(classed.groupBy("class").agg(F.min("doc_id").alias("doc_id")), "classes")
    involved = members.select("class").distinct().join(firsts, "class")
    texts = written(_class_texts(documents, involved, shingle_words).dropDuplicates(["class"]), "class-texts")

    compared, labels, leading = None, None, True
    for turn in itertools.count():
        rows = members
        if labels is not None:
            named = labels.select(F.col("node").alias("class"), "component")
            rows = rows.join(named, "class", "left")
            rows = rows.withColumn("component", F.coalesce("component", "class"))
            spans = rows.groupBy("band").agg(F.min("component").alias("c0"), F.max("component").alias("c1"))
            rows = rows.join(spans.filter("c0 <> c1").select("band"), "band")
        else:
            rows = rows.withColumn("component", F.col("class"))
        leader = F.struct("class", "n", "component", *CELL_COLUMNS)
        if leading:
            # One leader for all bands first, which connects most with few comparisons.
            by = F.lit(0) if turn == 0 else F.col("band")
            drawn = F.struct(F.xxhash64("class", by, F.lit(turn)), "class")
            leads = rows.groupBy("band").agg(F.min_by(leader, drawn).alias("l"))
        else:
            # What is left: pairs of different components inside one bucket.
            leads = rows.select("band", F.struct("class", "n", "component", *CELL_COLUMNS, "earlier").alias("l"))
        close = (F.col("n") * 100 >= F.col("l.n") * percent) & (F.col("l.n") * 100 >= F.col("n") * percent)
        apart = (F.col("component") != F.col("l.component")) & (F.col("class") != F.col("l.class"))
        if not leading:
            apart = apart & (F.col("class") < F.col("l.class"))
        alike = may_link("", "l.", percent)
        if not leading:
            # Both classes are in the same buckets of several components.
            alike = alike & in_first_band("", "l.")
        pairs = rows.join(leads, (rows.band == leads.band) & close & apart & alike)
        pairs = pairs.select(F.least("class", "l.class").alias("a"), F.greatest("class", "l.class").alias("b")).distinct()
        if compared is not None:
            pairs = pairs.join(compared, ["a", "b"], "left_anti")
        pairs = written(pairs, "pairs")
        compared = pairs if compared is None else compared.unionByName(pairs)
        found = written(_linked(pairs, texts, shingle_words, percent), "links")
        news = not found.isEmpty()
        if news:
            labels = components(found) if labels is None else merged(labels, found)
        if not leading:
            break
        leading = news and turn + 1 < LEADER_ROUNDS

    if labels is None:
        named = firsts.select("class", F.col("doc_id").alias("component_id"))
    else:
        of = firsts.join(labels.select(F.col("node").alias("class"), "component"), "class", "left")
        of = of.withColumn("component", F.coalesce("component", "class"))
        least = of.groupBy("component").agg(F.min("doc_id").alias("component_id"))
        named = of.join(least, "component").select("class", "component_id")
    own = F.coalesce(F.when(F.col("doc_id").isNotNull(), F.col("component_id")), F.col("doc_id"))
    return prints.join(named, "class", "left").select(
        "doc_id",
        "n_shingles",
        own.alias("component_id"),
        F.coalesce(F.col("doc_id") == own, F.lit(True)).alias("kept"),
    )
