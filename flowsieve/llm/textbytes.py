"""Words, hashes and shingles of many texts at once, on the UTF-8 bytes of an Arrow batch.

Texts are handled in chunks of a few MB (a longer text is a chunk of its own), so that the memory of
a task follows the chunk and never the partition.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 2_000_000

_BASE = np.uint64(0x9E3779B97F4A7C55)
_powers = np.ones(1, np.uint64)


@dataclass
class Chunk:
    """Texts ``first`` to ``first + len(ends)`` of a batch: their bytes, and where each ends."""

    first: int
    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray


def text_chunks(column: pa.Array, chunk_bytes: int = CHUNK_BYTES) -> Iterator[Chunk]:
    """The texts of a string column; a null is an empty text."""
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset :][: len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    starts, ends = offsets[:-1], offsets[1:].copy()
    if column.null_count:
        nulls = column.is_null().to_numpy(zero_copy_only=False)
        ends[nulls] = starts[nulls]
    first = 0
    while first < len(starts):
        stop = int(np.searchsorted(offsets, offsets[first] + chunk_bytes, "right")) - 1
        stop = min(max(stop, first + 1), len(starts))
        at = offsets[first]
        yield Chunk(first, data[at : offsets[stop]], starts[first:stop] - at, ends[first:stop] - at)
        first = stop


def byte_class(*ranges: tuple[int, int]) -> np.ndarray:
    """Table of 256 flags, set inside the given inclusive ranges."""
    table = np.zeros(256, bool)
    for low, high in ranges:
        table[low : high + 1] = True
    return table


NOT_SPACE = ~byte_class((0x20, 0x20), (0x09, 0x0D))
LETTERS_AND_DIGITS = byte_class((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20


def mixed(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit finaliser, so that every bit of the result depends on every bit of ``x``."""
    x = x + np.uint64((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & 0xFFFFFFFFFFFFFFFF)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


@dataclass
class Words:
    """Words of a chunk in order: byte range, 64-bit hash, and the text (of the chunk) they are in."""

    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    text: np.ndarray


def _power_table(size: int) -> np.ndarray:
    global _powers
    while len(_powers) < size:
        last = _powers[-1:] * _BASE
        _powers = np.concatenate([_powers, _powers * last])
    return _powers


def words(chunk: Chunk, letters: np.ndarray, lower: bool = True) -> Words:
    """Maximal runs of bytes in the class ``letters``; with ``lower``, A-Z count as a-z."""
    data = LOWER[chunk.data] if lower else chunk.data
    inside = np.zeros(len(data) + 1, bool)
    inside[:-1] = letters[data]
    change = np.empty(len(data) + 1, bool)
    change[:1] = inside[:1]
    np.not_equal(inside[1:], inside[:-1], out=change[1:])
    # A word ends where its text ends, even if the next text starts with a letter.
    seams = chunk.starts[(chunk.starts > 0) & (chunk.starts < len(data))]
    seams = np.unique(seams[inside[seams] & inside[seams - 1]])
    edges = np.flatnonzero(change)
    if len(seams):
        edges = np.sort(np.concatenate([edges, seams, seams]))
    start, end = edges[0::2], edges[1::2]
    if not len(start):
        none = np.zeros(0, np.int64)
        return Words(none, none, np.zeros(0, np.uint64), none)
    length = end - start
    powers = _power_table(int(length.max()) + 1)
    # Bytes of words only, each weighted by its place in the word.
    held = np.flatnonzero(inside[:-1])
    first = np.cumsum(length) - length
    place = np.arange(len(held)) - np.repeat(first, length)
    weighted = (data[held].astype(np.uint64) + np.uint64(1)) * powers[place]
    total = np.add.reduceat(weighted, first) + length.astype(np.uint64)
    # Texts without bytes share their start with the next text, which is found by its end.
    text = np.searchsorted(chunk.ends, start, "right")
    return Words(start, end, mixed(total), text)


def shingles(found: Words, texts: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of every ``size``-word shingle; a shorter text is one shingle of all its words."""
    count = np.bincount(found.text, minlength=texts)
    first = np.cumsum(count) - count
    width = np.minimum(count, size)
    kept = np.maximum(count - size + 1, np.minimum(count, 1))
    text = np.repeat(np.arange(texts), kept)
    at = np.arange(len(text)) - np.repeat(np.cumsum(kept) - kept, kept) + first[text]
    value = width[text].astype(np.uint64)
    for step in range(size):
        there = step < width[text]
        place = np.minimum(at + step, max(len(found.hash) - 1, 0))
        following = mixed(value * np.uint64(0xD6E8FEB86659FD93) + found.hash[place], step + 1)
        value = np.where(there, following, value)
    return text, value


def distinct_per_text(text: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``shingles`` without repeats inside a text, ordered by text, then value."""
    order = np.lexsort((value, text))
    text, value = text[order], value[order]
    new = np.ones(len(text), bool)
    new[1:] = (text[1:] != text[:-1]) | (value[1:] != value[:-1])
    return text[new], value[new]
