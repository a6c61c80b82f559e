"""Tokens of two tokenizers over the same bytes, aligned by divide and conquer at shared cuts.

A shared cut is a byte offset at which a token of both tokenizers ends. An interval of tokens is
halved at a shared cut near its middle, found by bisecting the ends of the other tokenizer, and both
halves are treated alike; an interval without a cut inside is a group. All intervals of a chunk of
texts are halved together, level by level.

Neither vocabulary has an entry in which a space follows a character that is not white space, so both
tokenizers end a token before a single space between two words. Texts are cut there first; a piece that occurs often
in a chunk is encoded and divided once. (For vocabularies that have such entries, a whole text is one
piece.)

Links are pairs of tokens whose byte ranges overlap. Their corpus-wide counts come back to the
documents by chunk: each chunk numbers its own distinct pairs, documents keep numbers and
multiplicities, and one row per pair and chunk is joined with the counts.
"""

from __future__ import annotations

import hashlib
import os
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowsieve.session import written

FOLDER = "/opt/tokenizers"
BYTE_BPE, PIECES = "byte_bpe_50k.json", "piece_bpe_32k.model"
# Bytes of text whose distinct pieces and pairs are numbered together, pieces encoded in one call, and
# links of documents that are counted at once.
CHUNK_BYTES = 12_000_000
ENCODED_AT_ONCE = 10_000
LINKS_AT_ONCE = 2_000_000
# Ids of the second tokenizer are below this.
ID_SPACE = 1 << 24

_BETWEEN_WORDS = re.compile(r"(?<=\S) (?=\S)")
# A text is cut into pieces so many characters at a time.
_STRETCH = 1_000_000


@dataclass
class Tokenizers:
    """Both encoders, the bytes of each id, and whether texts may be cut between words."""

    a: object
    b: object
    a_bytes: list[bytes]
    b_bytes: list[bytes]
    cut: bool

    def encode_a(self, pieces: list[str]) -> list[list[int]]:
        found = self.a.encode_batch_fast([" " + p for p in pieces], add_special_tokens=False)
        return [f.ids for f in found]

    def encode_b(self, pieces: list[str]) -> list[list[int]]:
        return self.b.encode(pieces, num_threads=1)


def _byte_letters() -> dict[str, int]:
    """The letter by which a byte-level vocabulary writes each byte: printable bytes are themselves."""
    plain = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


@lru_cache(maxsize=2)
def load(folder: str) -> Tokenizers:
    """The tokenizers of ``folder``, once per worker process; encoding stays on the task's own core."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(f"{folder}/{BYTE_BPE}")
    a.encode_special_tokens = True
    letters = _byte_letters()
    a_bytes = []
    for i in range(a.get_vocab_size(with_added_tokens=True)):
        token = a.id_to_token(i) or ""
        known = all(c in letters for c in token)
        a_bytes.append(bytes(letters[c] for c in token) if known else token.encode())
    b = sentencepiece.SentencePieceProcessor(model_file=f"{folder}/{PIECES}")
    b_bytes = []
    for i in range(b.get_piece_size()):
        piece = b.id_to_piece(i)
        b_bytes.append(bytes([int(piece[3:5], 16)]) if b.is_byte(i) else piece.replace("▁", " ").encode())
    cut = not any(re.search(r"\S ", t.decode(errors="replace")) for t in (*a_bytes, *b_bytes))
    return Tokenizers(a, b, a_bytes, b_bytes, cut)


def pieces_of(text: str, cut: bool) -> Iterator[list[str]]:
    """The pieces of ``text`` without the space before each, some at a time."""
    at = 0
    while cut and len(text) - at > _STRETCH:
        between = _BETWEEN_WORDS.search(text, at + _STRETCH)
        if between is None:
            break
        yield _BETWEEN_WORDS.split(text[at : between.start()])
        at = between.end()
    rest = text[at:] if at else text
    yield _BETWEEN_WORDS.split(rest) if cut else [rest]


def shared_cuts(
    a_ends: np.ndarray, b_ends: np.ndarray, a_first: np.ndarray, b_first: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """(a, b): the tokens of both sides that end each group, in order.

    Ends increase over all intervals. Interval ``i`` holds the A tokens from ``a_first[i]`` to before
    ``a_first[i + 1]`` and the B tokens likewise; its last tokens end together. Intervals without
    tokens have no groups.
    """
    a0, a1, b0, b1 = a_first[:-1], a_first[1:], b_first[:-1], b_first[1:]
    some = a1 > a0
    a0, a1, b0, b1 = a0[some], a1[some], b0[some], b1[some]
    ends_a, ends_b = [], []
    while len(a0):
        # A group of one token on a side has no cut inside.
        leaf = (a1 - a0 == 1) | (b1 - b0 == 1)
        at, other = np.full(len(a0), -1), np.full(len(a0), -1)
        open_ = np.flatnonzero(~leaf)
        middle = (a0 + a1 - 2) // 2
        step = 0
        while len(open_):
            # The middle token's end first, then its neighbours', further and further out.
            for tried in (middle[open_] + step, middle[open_] - step)[: 1 if step == 0 else 2]:
                inside = (tried >= a0[open_]) & (tried < a1[open_] - 1) & (at[open_] < 0)
                here, tried = open_[inside], tried[inside]
                found = np.searchsorted(b_ends, a_ends[tried])
                met = b_ends[found] == a_ends[tried]
                at[here[met]], other[here[met]] = tried[met], found[met]
            step += 1
            left = (middle[open_] + step < a1[open_] - 1) | (middle[open_] - step >= a0[open_])
            open_ = open_[(at[open_] < 0) & left]
        split = at >= 0
        ends_a.append(a1[~split] - 1)
        ends_b.append(b1[~split] - 1)
        at, other = at[split] + 1, other[split] + 1
        a0, a1 = np.concatenate([a0[split], at]), np.concatenate([at, a1[split]])
        b0, b1 = np.concatenate([b0[split], other]), np.concatenate([other, b1[split]])
    a = np.concatenate(ends_a) if ends_a else np.zeros(0, np.int64)
    b = np.concatenate(ends_b) if ends_b else np.zeros(0, np.int64)
    order = np.argsort(a)
    return a[order], b[order]


def _ranges(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1, ... for ``count[0]`` places, then the same for the next."""
    return np.arange(count.sum()) + np.repeat(first - (np.cumsum(count) - count), count)


def _starts(counts: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)


@dataclass
class Aligned:
    """Distinct pieces: token counts, groups as text, and links as numbers of distinct pairs.

    ``whole`` is false where the tokens do not give the piece's bytes. ``pairs`` holds
    ``a * ID_SPACE + b`` in order.
    """

    whole: np.ndarray
    n_a: np.ndarray
    n_b: np.ndarray
    n_groups: np.ndarray
    groups: list[bytes]
    link_first: np.ndarray
    links: np.ndarray
    pairs: np.ndarray


def align(pieces: list[str], tokenizers: Tokenizers) -> Aligned:
    """Encode each piece, with a space before it, by both tokenizers, and group and link its tokens."""
    parts_a, parts_b, n_a, n_b, whole = [], [], [], [], []
    a_bytes, b_bytes = tokenizers.a_bytes, tokenizers.b_bytes
    for at in range(0, len(pieces), ENCODED_AT_ONCE):
        some = pieces[at : at + ENCODED_AT_ONCE]
        a_ids, b_ids = [], []
        for piece, a, b in zip(some, tokenizers.encode_a(some), tokenizers.encode_b(some)):
            data = b" " + piece.encode()
            good = data == b"".join([a_bytes[i] for i in a]) == b"".join([b_bytes[i] for i in b])
            whole.append(good)
            n_a.append(len(a) if good else 0)
            n_b.append(len(b) if good else 0)
            if good:
                a_ids += a
                b_ids += b
        # Lists of Python's numbers are several times as large as arrays.
        parts_a.append(np.array(a_ids, np.int64))
        parts_b.append(np.array(b_ids, np.int64))
    none = np.zeros(0, np.int64)
    a_ids, b_ids = np.concatenate([none, *parts_a]), np.concatenate([none, *parts_b])
    n_a, n_b = np.array(n_a, np.int64), np.array(n_b, np.int64)
    a_ends = np.cumsum(np.array([len(t) for t in a_bytes])[a_ids])
    b_ends = np.cumsum(np.array([len(t) for t in b_bytes])[b_ids])
    a_first, b_first = _starts(n_a), _starts(n_b)
    a_cut, b_cut = shared_cuts(a_ends, b_ends, a_first, b_first)
    piece = np.repeat(np.arange(len(pieces)), n_a)
    n_groups = np.bincount(piece[a_cut], minlength=len(pieces))
    # Every distinct end closes one overlap of an A token with a B token.
    ends = np.union1d(a_ends, b_ends)
    a_at, b_at = np.searchsorted(a_ends, ends), np.searchsorted(b_ends, ends)
    pairs, links = np.unique(a_ids[a_at] * ID_SPACE + b_ids[b_at], return_inverse=True)
    groups = _group_texts(a_ids, b_ids, a_cut, b_cut, _starts(n_groups))
    return Aligned(
        np.array(whole, bool), n_a, n_b, n_groups, groups, _starts(n_a + n_b - n_groups), links, pairs
    )


def _group_texts(
    a_ids: np.ndarray, b_ids: np.ndarray, a_cut: np.ndarray, b_cut: np.ndarray, first: np.ndarray
) -> list[bytes]:
    """``a1,a2|b1;a3|b2`` for each piece, whose groups start at ``first``."""
    group = np.arange(len(a_cut))
    a_group = np.repeat(group, np.diff(a_cut, prepend=-1))
    b_group = np.repeat(group, np.diff(b_cut, prepend=-1))
    # Where each token stands when every group's A tokens precede its B tokens.
    a_at = np.arange(len(a_ids)) + np.concatenate([[0], b_cut + 1])[a_group]
    b_at = np.arange(len(b_ids)) + (a_cut + 1)[b_group]
    ids = np.empty(len(a_ids) + len(b_ids), np.int64)
    ids[a_at], ids[b_at] = a_ids, b_ids
    after = np.full(len(ids), ord(","), np.uint8)
    after[a_at[a_cut]], after[b_at[b_cut]] = ord("|"), ord(";")
    digits = np.array([str(i) for i in range(int(ids.max(initial=0)) + 1)], "S")
    digits = digits.view(np.uint8).reshape(len(digits), -1)
    letters = np.concatenate([digits[ids], after[:, None]], 1)
    there = letters != 0
    data = letters[there].tobytes()
    ends = np.concatenate([[0], np.cumsum(there.sum(1))])[np.concatenate([[0], a_cut + b_cut + 2])]
    ends = ends[first].tolist()
    return [data[f : g - 1] for f, g in zip(ends, ends[1:])]


class _Numbered(dict):
    """Numbers keys from 0 in the order of their first look-up."""

    def __missing__(self, key: str) -> int:
        number = self[key] = len(self)
        return number


_DOCUMENT = {
    "chunk": pa.int64(), "is_document": pa.bool_(), "doc_id": pa.int64(),
    "n_a": pa.int64(), "n_b": pa.int64(), "n_groups": pa.int64(), "n_links": pa.int64(), "groups_sha256": pa.string(),
    "groups": pa.string(), "links": pa.binary(), "pairs": pa.list_(pa.int64()), "times": pa.list_(pa.int64()),
}
_DOCUMENT_DDL = (
    "chunk long, is_document boolean, doc_id long, n_a long, n_b long, n_groups long, n_links long,"
    " groups_sha256 string, groups string, links binary, pairs array<long>, times array<long>"
)


def _packed(numbers: np.ndarray, times: np.ndarray) -> bytes:
    """Increasing numbers and their multiplicities; gaps and bytes of one rank stand together."""
    columns = np.concatenate([np.diff(numbers, prepend=0), times]).astype("<u4")
    return zlib.compress(columns.view(np.uint8).reshape(-1, 4).T.tobytes(), 1)


def _unpacked(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    columns = np.frombuffer(zlib.decompress(data), np.uint8)
    columns = np.ascontiguousarray(columns.reshape(4, -1).T).view("<u4")[:, 0].astype(np.int64)
    half = len(columns) // 2
    return np.cumsum(columns[:half]), columns[half:]


class _Chunk:
    """Documents whose pieces and pairs are numbered together."""

    def __init__(self, tokenizers: Tokenizers, groups: bool):
        self.tokenizers = tokenizers
        self.groups = groups
        self.numbered = _Numbered()
        self.ids: list[int | None] = []
        self.sequences: list[np.ndarray] = []
        self.size = 0

    def add(self, doc_id: int | None, text: str | None) -> None:
        parts = []
        if text:
            for pieces in pieces_of(text, self.tokenizers.cut):
                parts.append(np.array(list(map(self.numbered.__getitem__, pieces)), np.int32))
        self.ids.append(doc_id)
        self.sequences.append(np.concatenate(parts) if parts else np.zeros(0, np.int32))
        self.size += len(text or "")

    def rows(self, number: int) -> Iterator[pa.RecordBatch]:
        """A row per document, then one with the chunk's distinct pairs and their link counts."""
        found = align(list(self.numbered), self.tokenizers)
        self.numbered = None
        n_links = np.diff(found.link_first)
        total = np.zeros(len(found.pairs), np.int64)
        at = 0
        while at < len(self.ids):
            # As many documents as have together a few million links, at least one.
            rows, held = [], 0
            while at < len(self.ids) and (not rows or held < LINKS_AT_ONCE):
                sequence = self.sequences[at]
                if len(sequence) and not found.whole[sequence].all():
                    sequence = sequence[:0]
                numbers, times = self._linked(sequence, found, n_links)
                total[numbers] += times
                held += len(sequence) + len(numbers)
                counts = [int(c[sequence].sum()) for c in (found.n_a, found.n_b, found.n_groups, n_links)]
                groups = b";".join([found.groups[i] for i in sequence]).decode() if self.groups else None
                digest = _digest(sequence, found.groups)
                rows.append((number, True, self.ids[at], *counts, digest, groups, _packed(numbers, times), None, None))
                at += 1
            yield _batch(rows)
        used = np.flatnonzero(total)
        # Unused numbers are those of texts without tokens; the places of the others stay.
        if len(used):
            yield _batch([(number, False, *[None] * 8, found.pairs, total)])

    @staticmethod
    def _linked(sequence: np.ndarray, found: Aligned, n_links: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the distinct pairs of a document, and how many of its links are of each."""
        numbers, times = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for first in range(0, len(sequence), LINKS_AT_ONCE // 4):
            part = sequence[first : first + LINKS_AT_ONCE // 4]
            links = found.links[_ranges(found.link_first[part], n_links[part])]
            new, n = np.unique(links, return_counts=True)
            numbers, place = np.unique(np.concatenate([numbers, new]), return_inverse=True)
            times = np.bincount(place, np.concatenate([times, n]), len(numbers)).astype(np.int64)
        return numbers, times


def _digest(sequence: np.ndarray, groups: list[bytes]) -> str:
    if not len(sequence):
        return ""
    digest, between = hashlib.sha256(), b""
    for first in range(0, len(sequence), 100_000):
        digest.update(between + b";".join(map(groups.__getitem__, sequence[first : first + 100_000].tolist())))
        between = b";"
    return digest.hexdigest()


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = [pa.array(list(c), t) for c, t in zip(zip(*rows), _DOCUMENT.values())]
    return pa.RecordBatch.from_arrays(columns, names=list(_DOCUMENT))


def aligned_documents(
    documents: DataFrame, folder: str = FOLDER, chunk_bytes: int = CHUNK_BYTES, groups: bool = False
) -> DataFrame:
    """Written rows of two kinds: documents, with links by number, and each chunk's numbered pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizers = load(folder)
        task, n = TaskContext.get().partitionId(), 0
        chunk = _Chunk(tokenizers, groups)
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id"), batch.column("text")):
                chunk.add(doc_id.as_py(), text.as_py())
                if chunk.size >= chunk_bytes:
                    yield from chunk.rows(task << 32 | n)
                    chunk, n = _Chunk(tokenizers, groups), n + 1
        if chunk.ids:
            yield from chunk.rows(task << 32 | n)

    slim = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return written(slim.mapInArrow(run, _DOCUMENT_DDL), "aligned")


def counted_links(
    documents: DataFrame, folder: str = FOLDER, chunk_bytes: int = CHUNK_BYTES, groups: bool = False
) -> DataFrame:
    """Per document: token, group and link counts, groups' digest, and its links' corpus-wide counts.

    Columns: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256. ``n_best`` counts
    the links whose pair of ids is, corpus-wide, linked most often of all pairs with that B id, ties
    included; ``count_sum`` adds up the corpus-wide counts of the pairs over the links. With ``groups``,
    the groups themselves come as a column too: ``a1,a2|b1;a3|b2`` by decimal ids.

    Every row gives a row: repeated rows are documents of their own, and a null id stays null. Texts
    that are null, empty, or not given back byte by byte by both tokenizers have zeros and an empty
    digest, and no links. Other columns are ignored; an empty table gives no rows.
    """
    rows = aligned_documents(documents, folder, chunk_bytes, groups)
    numbered = rows.filter("not is_document").select(F.col("chunk").alias("part"), F.posexplode(F.arrays_zip("pairs", "times")).alias("place", "held"))
    numbered = numbered.select("part", "place", F.col("held.pairs").alias("pair"), F.col("held.times").alias("times"))
    counts = written(
        numbered.filter("times > 0").groupBy("pair").agg(F.sum("times").alias("n")), "pair-counts"
    ).withColumn("b", F.col("pair") % ID_SPACE)
    # One row per id of the second tokenizer: bounded by its vocabulary.
    best = counts.groupBy("b").agg(F.max("n").alias("highest"))
    counts = counts.join(F.broadcast(best), "b").select("pair", "n", (F.col("n") == F.col("highest")).alias("best"))
    back = numbered.filter("times > 0").join(counts, "pair").select("part", "place", "n", "best")

    def summed(held: pa.Table, counted: pa.Table) -> pa.Table:
        size = counted.num_rows and int(counted["place"].to_numpy().max()) + 1
        n, best = np.zeros(size, np.int64), np.zeros(size, np.int64)
        n[counted["place"].to_numpy()] = counted["n"].to_numpy()
        best[counted["place"].to_numpy()] = counted["best"].to_numpy()
        sums, bests = [], []
        for links in held["links"]:
            numbers, times = _unpacked(links.as_py())
            sums.append(int(n[numbers] @ times))
            bests.append(int(best[numbers] @ times))
        kept = [held[c] for c in kept_columns]
        return pa.Table.from_arrays([*kept, pa.array(bests, pa.int64()), pa.array(sums, pa.int64())], names=[*kept_columns, "n_best", "count_sum"])

    schema = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"
    schema += ", groups string" if groups else ""
    kept_columns = [c.split()[0] for c in schema.split(", ")]
    held = rows.filter("is_document").select("chunk", *kept_columns, "links")
    joined = held.groupBy("chunk").cogroup(back.groupBy("part"))
    return joined.applyInArrow(summed, f"{schema}, n_best long, count_sum long")
