"""Repeated byte strings by refining groups of suffixes to a limited depth, and their removal.

Whether the ``length`` bytes from a place occur elsewhere is whether its suffix shares that depth with
another one. Suffixes are not ordered byte by byte: they are grouped at anchors, and passes refine the
groups by hashes of longer strings, called digits, only to that depth:

* Suffixes travel in runs. The least hash of the first ``anchor_window`` eight-byte strings of a suffix
  names its anchor, which depends on those bytes alone, so equal suffixes have equal anchors at equal
  distances. Neighbouring suffixes with one anchor form a run.
* The first digit is the string that all suffixes around an anchor share. A group of one has no equal.
* In a group whose members are the same in every byte that any of the run's suffixes reaches, all
  suffixes are equal to the full depth: the group is settled as repeated.
* The other groups are cut by their distance from the anchor, and the pass repeats on the pieces with a
  digit that is longer, until a piece is one suffix and the digit its ``length`` bytes.

Digits are named by cryptographic hashes of the bytes, 128 bits for what is called equal. Each pass is
a count by digit, combined map-side; no group is gathered.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowsieve.llm.textbytes import Chunk, mixed, text_chunks
from flowsieve.session import written

LENGTH = 400
# Bytes of text whose suffixes are cut to runs at once (several numbers are held per byte), and bytes
# and rows that a task gathers before it passes them on.
RUN_BYTES, PASSED_ON, PASSED_ROWS = 500_000, 4_000_000, 50_000

_KEY = ["doc_id", "text_key"]
_RUN = "doc_id long, text_key long, first int, n int, far int, digit long, whole long"


def _anchor_window(length: int) -> int:
    return length * 16 // 25


def _widths(length: int) -> list[int]:
    """Distances from the anchor that a piece spans, pass by pass."""
    return sorted({_anchor_window(length), 16, 4, 1} - set(range(_anchor_window(length) + 1, 17)), reverse=True)


def _named(data: memoryview, salt: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(data, digest_size=8, salt=salt).digest(), "little", signed=True)


def _anchors(data: np.ndarray, window: int, gram: int) -> np.ndarray:
    """For each place, the place of the least hashed ``gram`` among the ``window`` from it on."""
    n = len(data) - gram + 1
    if n < window:
        return np.zeros(0, np.int64)
    grams = np.zeros(n, np.uint64)
    for at in range(gram):
        grams |= data[at : at + n].astype(np.uint64) << np.uint64(8 * at)
    # Upper half: hash. Lower half: place, so that the first of equal ones is the least.
    grams = mixed(grams) & np.uint64(0xFFFFFFFF00000000) | np.arange(n, dtype=np.uint64)
    blocks = -(-n // window)
    padded = np.full(blocks * window, np.iinfo(np.uint64).max)
    padded[:n] = grams
    padded = padded.reshape(blocks, window)
    ahead = np.minimum.accumulate(padded, axis=1).reshape(-1)
    behind = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    least = np.minimum(behind[: n - window + 1], ahead[window - 1 : n])
    return (least & np.uint64(0xFFFFFFFF)).astype(np.int64)


def _runs(chunk: Chunk, length: int) -> pd.DataFrame:
    """Runs of a chunk: text, first suffix, number of suffixes, distance of the first from the anchor."""
    window = _anchor_window(length)
    anchor = _anchors(chunk.data, window, min(8, length - window + 1))
    count = np.maximum(chunk.ends - chunk.starts - length + 1, 0)
    text = np.repeat(np.arange(len(count)), count)
    at = np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count) + chunk.starts[text]
    to = anchor[at] if len(at) else at
    new = np.ones(len(at), bool)
    new[1:] = (to[1:] != to[:-1]) | (text[1:] != text[:-1])
    first = np.flatnonzero(new)
    n = np.diff(np.append(first, len(at)))
    return pd.DataFrame({"text": text[first], "first": at[first], "n": n, "far": (to - at)[first]})


def _digits(data: memoryview, first: int, n: int, far: int, length: int, width: int, window: int) -> tuple[int, int]:
    """Names of what the suffixes around an anchor share, and of every byte the run's suffixes reach.

    Suffixes ``first`` to ``first + n - 1``, the first of them ``far`` before its anchor; all of them
    have the same quotient of their distance by ``width``.
    """
    anchor, part = first + far, far // width
    most = min(part * width + width, window) - 1
    shared = data[anchor - part * width : anchor - most + length]
    digit = _named(shared, b"d%d" % part)
    return digit, _named(data[first : first + n - 1 + length], b"w%d,%d" % (far, n))


def _first_digits(documents: DataFrame, length: int, whole: bool) -> DataFrame:
    """The runs of all documents; the digit alone, or everything."""
    window = _anchor_window(length)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, keys = (batch.column(c).to_numpy(zero_copy_only=False) for c in _KEY)
            for chunk in text_chunks(batch.column("text"), RUN_BYTES):
                runs, data = _runs(chunk, length), memoryview(chunk.data)
                if not whole:
                    digits = [
                        _named(data[f + d - (d // window) * window : f + d - window + 1 + length], b"d0")
                        for f, d in zip(runs["first"].tolist(), runs.far.tolist())
                    ]
                    yield pa.RecordBatch.from_pydict({"digit": pa.array(digits, pa.int64())})
                    continue
                found = [
                    _digits(data, f, n, d, length, window, window)
                    for f, n, d in zip(runs["first"].tolist(), runs.n.tolist(), runs.far.tolist())
                ]
                text = runs.text.to_numpy()
                columns = [
                    pa.array(ids[chunk.first + text], pa.int64()),
                    pa.array(keys[chunk.first + text], pa.int64()),
                    pa.array(runs["first"].to_numpy() - chunk.starts[text], pa.int32()),
                    pa.array(runs.n.to_numpy(), pa.int32()),
                    pa.array(runs.far.to_numpy(), pa.int32()),
                    pa.array([x[0] for x in found], pa.int64()),
                    pa.array([x[1] for x in found], pa.int64()),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in _RUN.split(", ")])

    return documents.select(*_KEY, "text").mapInArrow(run, _RUN if whole else "digit long")


def _lists(column: pa.ListArray) -> tuple[np.ndarray, dict[str, pa.Array]]:
    """Where each list of structs begins and the last ends, and the structs' fields one after the other."""
    ends = np.concatenate([[0], np.cumsum(column.value_lengths().fill_null(0).to_numpy())]).astype(np.int64)
    structs = column.flatten()
    return ends, dict(zip([f.name for f in structs.type], structs.flatten()))


def _portions(sizes: np.ndarray, most: int) -> Iterator[slice]:
    """Neighbours that together have at most ``most``; a larger one is a portion of its own."""
    held, at = np.cumsum(sizes), 0
    while at < len(sizes):
        stop = int(np.searchsorted(held, held[at] - sizes[at] + most, "right"))
        yield slice(at, max(stop, at + 1))
        at = max(stop, at + 1)


def _pieces_text(texts: DataFrame, classes: DataFrame, length: int) -> DataFrame:
    """(digit, whole, n, far, copies, bytes): all bytes that a class's suffixes reach, from one of its texts."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends, runs = _lists(batch.column("runs"))
            row = np.repeat(np.arange(batch.num_rows), np.diff(ends))
            first, size = runs["first"].to_numpy(), runs["n"].to_numpy().astype(np.int64) - 1 + length
            for chunk in text_chunks(batch.column("text"), PASSED_ON):
                at, stop = ends[chunk.first], ends[chunk.first + len(chunk.ends)]
                for own in _portions(size[at:stop], PASSED_ON):
                    own = slice(at + own.start, at + own.stop)
                    start = chunk.starts[row[own] - chunk.first] + first[own]
                    pieces = [chunk.data[x : x + n].tobytes() for x, n in zip(start.tolist(), size[own].tolist())]
                    columns = [runs[c][own] for c in ("digit", "whole", "n", "far", "copies")]
                    yield pa.RecordBatch.from_arrays(
                        [*columns, pa.array(pieces, pa.binary())], names=["digit", "whole", "n", "far", "copies", "bytes"]
                    )

    run = F.struct(F.col("at.first").alias("first"), "n", "far", "digit", "whole", "copies")
    wanted = classes.groupBy(F.col("at.doc_id").alias("doc_id"), F.col("at.text_key").alias("text_key"))
    wanted = wanted.agg(F.collect_list(run).alias("runs"))
    found = texts.join(wanted, _KEY).select("text", "runs")
    return found.mapInArrow(cut, "digit long, whole long, n int, far int, copies long, bytes binary")


def _cut_batches(batches: Iterator[pa.RecordBatch], length: int, width: int) -> Iterator[pa.RecordBatch]:
    """The work of ``_cut_pieces`` on rows of classes with their bytes and parts; passed on every ``PASSED_ROWS``."""
    window = _anchor_window(length)
    types = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64()]
    names = ["of_digit", "of_whole", "copies", "far", "n", "digit", "whole"]

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

    for batch in batches:
        ends, parts = _lists(batch.column("parts"))
        starts, sizes = parts["far"].to_numpy(), parts["n"].to_numpy()
        digits, wholes, fars, copies = (
            batch.column(c).to_numpy() for c in ("digit", "whole", "far", "copies")
        )
        rows = []
        for i, data in enumerate(batch.column("bytes")):
            view, far = memoryview(data.as_buffer()), int(fars[i])
            known = int(digits[i]), int(wholes[i]), int(copies[i])
            for at, n in zip(starts[ends[i] : ends[i + 1]].tolist(), sizes[ends[i] : ends[i + 1]].tolist()):
                end = at - n
                while at > end:
                    # Distances fall along the part; a piece ends at a multiple of the width.
                    last = max(at // width * width, end + 1)
                    named = _digits(view, far - at, at - last + 1, at, length, width, window)
                    rows.append((*known, at, at - last + 1, *named))
                    at = last - 1
            if len(rows) >= PASSED_ROWS:
                yield batch_of(rows)
                rows = []
        if rows:
            yield batch_of(rows)


def _cut_pieces(pieces: DataFrame, open_parts: DataFrame, length: int, width: int) -> DataFrame:
    """The parts (far, n) of each class that are still open, cut to ``width`` and with their digits."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _cut_batches(batches, length, width)

    grouped = open_parts.groupBy("digit", "whole").agg(F.collect_list(F.struct("far", "n")).alias("parts"))
    joined = pieces.drop("n").join(grouped, ["digit", "whole"]).select("digit", "whole", "far", "copies", "bytes", "parts")
    return joined.mapInArrow(cut, "of_digit long, of_whole long, copies long, far int, n int, digit long, whole long")


def repeated_places(documents: DataFrame, length: int = LENGTH) -> tuple[DataFrame, DataFrame]:
    """(texts, places): (doc_id, text_key, text) of documents that may hold repeats, and
    (doc_id, text_key, first, n) runs of places from which ``length`` bytes occur at least twice.

    ``documents`` has doc_id, text_key (not null) and text.
    """
    counted = _first_digits(documents, length, False).groupBy("digit").agg(F.count(F.lit(1)).alias("rows"))
    repeated = written(counted.filter("rows > 1").select("digit"), "digits")
    runs = written(_first_digits(documents, length, True).join(repeated, "digit"), "runs")
    involved = runs.select(*_KEY).distinct()
    texts = written(documents.join(involved, _KEY).select(*_KEY, "text").dropDuplicates(_KEY), "repeat-texts")
    classes = runs.groupBy("digit", "whole", "n", "far").agg(
        F.count(F.lit(1)).alias("copies"), F.min(F.struct(*_KEY, "first")).alias("at")
    )
    classes = written(classes, "classes")
    # Groups of one class are settled: its copies are equal in all their bytes.
    kinds = classes.groupBy("digit").agg(F.count(F.lit(1)).alias("kinds"))
    classes = written(classes.join(kinds, "digit"), "classes")
    settled = runs.join(classes.filter("kinds = 1").select("digit"), "digit")
    # Written by itself, so that Spark may split the rows of a very common digit.
    settled = written(settled.select(*_KEY, "first", "n"), "settled")
    mixed_classes = classes.filter("kinds > 1")
    pieces = written(_pieces_text(texts, mixed_classes, length), "pieces")
    open_parts = pieces.select("digit", "whole", "far", "n")
    found = open_parts.limit(0)
    for width in _widths(length)[1:]:
        parts = written(_cut_pieces(pieces, open_parts, length, width), "parts")
        # A piece of one suffix is compared by both names, which are then names of the same bytes.
        by = ["digit", "whole"] if width == 1 else ["digit"]
        groups = parts.groupBy(*by).agg(
            F.sum("copies").alias("copies"), F.min("whole").alias("least"), F.max("whole").alias("most")
        )
        groups = groups.filter("copies > 1").select(*by, (F.col("least") == F.col("most")).alias("equal"))
        judged = written(
            parts.join(groups, by).select(
                F.col("of_digit").alias("digit"), F.col("of_whole").alias("whole"), "far", "n", "equal"
            ),
            "judged",
        )
        found = found.unionByName(judged.filter("equal").drop("equal"))
        open_parts = judged.filter("not equal").drop("equal")
    parts = found.groupBy("digit", "whole").agg(
        F.collect_list(F.struct(F.col("far").alias("part_far"), F.col("n").alias("part_n"))).alias("parts")
    )
    open_runs = runs.join(parts, ["digit", "whole"]).select(*_KEY, "first", "far", F.explode("parts").alias("p"))
    place = (F.col("first") + F.col("far") - F.col("p.part_far")).alias("first")
    open_runs = written(open_runs.select(*_KEY, place, F.col("p.part_n").alias("n")), "open-runs")
    return texts, settled.unionByName(open_runs)


def _gone(chunk: Chunk, row: np.ndarray, first: np.ndarray, n: np.ndarray, length: int) -> np.ndarray:
    """Which bytes of the chunk a repeated string covers; runs stay inside their text ``row``."""
    step = np.zeros(len(chunk.data) + 1, np.int32)
    start = chunk.starts[row] + first
    np.add.at(step, start, 1)
    np.add.at(step, start + n - 1 + length, -1)
    return np.cumsum(step[:-1], dtype=np.int32) > 0


def _without(data: np.ndarray, gone: np.ndarray) -> tuple[int, int, str, bytes]:
    spans = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
    kept = data[~gone].tobytes()
    return int(gone.sum()), spans, hashlib.sha256(kept).hexdigest(), kept


def remove_repeats(documents: DataFrame, length: int = LENGTH, with_kept: bool = False) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256), one row per document.

    A document's UTF-8 bytes lose each byte that a ``length``-byte string covers which also starts
    anywhere else in the corpus, the same document included. Strings never cross documents and are
    judged on the input. ``with_kept`` adds the remaining bytes as ``kept``.

    A null text is empty. Rows that repeat are documents of their own, so a repeated text of at least
    ``length`` bytes is removed whole. Rows without a doc_id are judged like others. Other columns are
    ignored; an empty table gives no rows. ``length`` is 16 at least.
    """
    if length < 16:
        raise ValueError("length must be at least 16")
    keyed = documents.select(
        "doc_id",
        F.coalesce(F.col("doc_id").cast("bigint"), F.lit(-1)).alias("key"),
        F.xxhash64("text").alias("text_key"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    texts, places = repeated_places(keyed.select(F.col("key").alias("doc_id"), "text_key", "text"), length)
    lists = places.groupBy(*_KEY).agg(F.collect_set(F.struct("first", "n")).alias("runs"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends, runs = _lists(batch.column("runs"))
            row = np.repeat(np.arange(batch.num_rows), np.diff(ends))
            first, n = (runs[c].to_numpy().astype(np.int64) for c in ("first", "n"))
            for chunk in text_chunks(batch.column("text")):
                held = slice(ends[chunk.first], ends[chunk.first + len(chunk.ends)])
                gone = _gone(chunk, row[held] - chunk.first, first[held], n[held], length)
                found = [_without(chunk.data[a:b], gone[a:b]) for a, b in zip(chunk.starts, chunk.ends)]
                keys = [batch.column(c).slice(chunk.first, len(chunk.ends)) for c in _KEY]
                yield pa.RecordBatch.from_arrays(
                    [*keys, *[pa.array(c, t) for c, t in zip(zip(*found), types)]], names=[*_KEY, *columns]
                )

    columns, types = ["n_removed", "n_spans", "kept_sha256"], [pa.int64(), pa.int64(), pa.string()]
    if with_kept:
        columns, types = [*columns, "kept"], [*types, pa.binary()]
    schema = "doc_id long, text_key long, n_removed long, n_spans long, kept_sha256 string"
    schema += ", kept binary" if with_kept else ""
    covered = texts.join(lists, _KEY).select(*_KEY, "text", "runs")
    changed = covered.mapInArrow(cut, schema).withColumnRenamed("doc_id", "key")
    whole = keyed.select(
        "doc_id",
        "key",
        "text_key",
        F.octet_length("text").cast("bigint").alias("n_bytes"),
        F.sha2(F.col("text").cast("binary"), 256).alias("whole_sha256"),
        *([F.col("text").cast("binary").alias("whole")] if with_kept else []),
    )
    return whole.join(changed, ["key", "text_key"], "left").select(
        "doc_id",
        "n_bytes",
        F.coalesce("n_removed", F.lit(0)).alias("n_removed"),
        F.coalesce("n_spans", F.lit(0)).alias("n_spans"),
        F.coalesce("kept_sha256", "whole_sha256").alias("kept_sha256"),
        *([F.coalesce("kept", "whole").alias("kept")] if with_kept else []),
    )
