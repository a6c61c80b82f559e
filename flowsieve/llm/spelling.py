"""Spelling variants by reduced-alphabet generation.

Letters are hashed to a few symbols. For every reduced word that occurs, its one-edit neighbourhood
over the small alphabet is generated and joined with the reduced words that occur; only the original
words behind two such reduced words are compared letter by letter. One edit of a word is one edit of
its reduced word or none, so no variant is lost.

Each pair of neighbouring reduced words would be generated from both its ends. It is generated once:
by removing a symbol (the other end would insert it) and by raising one (the other end would lower
it); every pair found counts for both words. Reduced neighbours are named by 64-bit hashes that are
updated symbol by symbol, so the work for a word is linear in its length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowsieve.llm.textbytes import mixed
from flowsieve.session import written

SYMBOLS = 6
LETTERS = r"[A-Za-zÀ-ÿ]"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# Neighbours generated at once in a task.
ROWS_AT_ONCE = 500_000
# A form is this many times as frequent as its variant.
FACTOR = 10

_BASE = 0x9E3779B97F4A7C55
_MASK = (1 << 64) - 1


def typed_words(documents: DataFrame, least_letters: int = 7, every: int = 31) -> DataFrame:
    """(word, n): runs of letters, lower-cased A-Z, one letter missing where the run's hash says so.

    The hash is the crc32 of ``<doc_id>:<run>``; where ``every`` divides it, the letter at the hash
    modulo the length is left out. Results below ``least_letters`` do not count. A null text has no
    runs; a null id is hashed as an empty one.
    """
    # Nothing is left out of a run but one letter, so shorter runs cannot count.
    runs = F.regexp_extract_all("text", F.lit(f"{LETTERS}{{{least_letters},}}"), F.lit(0))
    keyed = documents.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("key"), F.explode(runs).alias("run"))
    keyed = keyed.select("key", F.translate("run", UPPER, LOWER).alias("run"))
    hashed = keyed.select("run", F.crc32(F.concat("key", F.lit(":"), "run").cast("binary")).alias("hash"))
    place = F.pmod("hash", F.length("run")).cast("int")
    shorter = F.concat(F.expr("substring(run, 1, place)"), F.expr("substring(run, place + 2)"))
    words = hashed.select("run", "hash", place.alias("place")).select(
        F.when(F.col("hash") % every == 0, shorter).otherwise(F.col("run")).alias("word")
    )
    words = words.filter(F.length("word") >= least_letters)
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def reduced_letters(symbols: int = SYMBOLS) -> tuple[str, str]:
    """The letters, and the symbol ('0', '1', ...) each is hashed to."""
    letters = [*range(0x61, 0x7B), *range(0x41, 0x5B), *range(0xC0, 0x100)]
    of = mixed(np.array(letters, np.uint64), 13) % np.uint64(symbols)
    return "".join(map(chr, letters)), "".join(str(s) for s in of)


def reduced(word: Column, symbols: int = SYMBOLS) -> Column:
    return F.translate(word, *reduced_letters(symbols))


def _powers(size: int) -> np.ndarray:
    out = np.ones(size + 1, np.uint64)
    out[1:] = _BASE
    return np.multiply.accumulate(out)


def _hash(digits: np.ndarray, powers: np.ndarray) -> np.uint64:
    return np.uint64(((digits + np.uint64(1)) * powers[: len(digits)]).sum())


def neighbours(word: bytes, symbols: int, powers: np.ndarray) -> Iterator[np.ndarray]:
    """The word's own hash first, then those of all words with one symbol removed or raised."""
    digits = np.frombuffer(word, np.uint8).astype(np.uint64) - np.uint64(ord("0"))
    weighted = (digits + np.uint64(1)) * powers[: len(digits)]
    whole = weighted.sum()
    yield np.array([whole])
    # Without symbol i, those after it move down one place.
    before = np.cumsum(weighted) - weighted
    moved = (digits[1:] + np.uint64(1)) * powers[: len(digits) - 1]
    after = np.append(np.cumsum(moved[::-1])[::-1], np.uint64(0))
    # Removing either of two equal neighbours gives the same word.
    first = np.append(True, digits[1:] != digits[:-1])
    yield (before + after)[first]
    for by in range(1, symbols):
        there = digits + np.uint64(by) < symbols
        yield whole + np.uint64(by) * powers[: len(digits)][there]


def _generated(symbols: int):
    """Arrow rows (code, reached): each word's own hash, and a neighbour's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = _powers(64)
        held, size = [], 0
        for batch in batches:
            for word in batch.column("reduced"):
                word = word.as_py().encode()
                if len(word) >= len(powers):
                    powers = _powers(2 * len(word))
                code, *reached = neighbours(word, symbols, powers)
                reached = np.concatenate(reached)
                held.append((np.repeat(code, len(reached)), reached))
                size += len(reached)
                if size >= ROWS_AT_ONCE:
                    yield _rows(held)
                    held, size = [], 0
        if held:
            yield _rows(held)

    return run


def _rows(held: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    code, reached = (np.concatenate(c).view(np.int64) for c in zip(*held))
    return pa.RecordBatch.from_arrays([pa.array(code), pa.array(reached)], names=["code", "reached"])


def _coded(symbols: int):
    """Arrow rows (reduced, code): the hash of each reduced word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = _powers(64)
        for batch in batches:
            codes = []
            for word in batch.column("reduced"):
                word = word.as_py().encode()
                if len(word) >= len(powers):
                    powers = _powers(2 * len(word))
                digits = np.frombuffer(word, np.uint8).astype(np.uint64) - np.uint64(ord("0"))
                codes.append(_hash(digits, powers))
            codes = pa.array(np.array(codes, np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column("reduced"), codes], names=["reduced", "code"])

    return run


def near_pairs(words: DataFrame, symbols: int = SYMBOLS) -> DataFrame:
    """(a, b): every two of the distinct ``word`` that differ by one letter inserted, deleted or replaced.

    Each pair comes once, in one of its two orders. Words are of ``LETTERS`` only.
    """
    keyed = words.select("word", reduced(F.col("word"), symbols).alias("reduced"))
    distinct = keyed.select("reduced").distinct()
    codes = written(distinct.mapInArrow(_coded(symbols), "reduced string, code long"), "reduced")
    generated = codes.select("reduced").mapInArrow(_generated(symbols), "code long, reached long")
    there = codes.select(F.col("code").alias("reached"))
    # Only hashes cross this shuffle; most neighbours do not occur and end here.
    met = written(generated.join(there, "reached", "left_semi").distinct(), "reduced-pairs")
    held = written(keyed.join(codes, "reduced").select("code", "word"), "coded")
    one, other = held.select("code", F.col("word").alias("a")), held.select(F.col("code").alias("reached"), F.col("word").alias("b"))
    # Different letters of one symbol: both words have the same reduced word.
    same = one.join(other.withColumnRenamed("reached", "code"), "code").filter("a < b").select("a", "b")
    apart = met.join(one, "code").join(other, "reached").select("a", "b")
    # A hash may stand for two reduced words, so a pair may be met twice.
    return (
        same.union(apart)
        .filter((F.abs(F.length("a") - F.length("b")) <= 1) & (F.levenshtein("a", "b", 1) == 1))
        .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        .distinct()
    )


def variants(words: DataFrame, symbols: int = SYMBOLS, factor: int = FACTOR) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for each of the distinct (word, n).

    ``form`` is the near word with the largest n (ties: the smallest in code-point order), if that n is
    at least ``factor`` times the word's own; null otherwise. ``root`` follows forms to the last, which
    is the word itself where it has none. An empty table gives no rows.
    """
    words = written(words.select("word", F.col("n").cast("bigint").alias("n")), "words")
    pairs = written(near_pairs(words, symbols), "near")
    both = pairs.union(pairs.select("b", "a"))
    counted = both.join(words.select(F.col("word").alias("b"), F.col("n").alias("near_n")), "b")
    best = counted.groupBy("a").agg(
        F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), F.col("b"))).alias("best")
    )
    found = words.join(best.withColumnRenamed("a", "word"), "word", "left")
    has_form = -F.col("best.less") >= factor * F.col("n")
    found = written(
        found.select(
            "word",
            F.when(has_form, F.col("best.b")).alias("form"),
            "n",
            F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"),
            F.when(has_form, -F.col("best.less")).alias("form_n"),
        ),
        "forms",
    )
    roots = _roots(found.filter("form is not null").select("word", F.col("form").alias("root")))
    return found.join(roots, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )


def _roots(links: DataFrame) -> DataFrame:
    """(word, root): every link followed to its end, twice as far in each round.

    Counts grow along forms by a factor, so there are no circles and few rounds.
    """
    while True:
        links = written(links, "roots")
        further = links.select(F.col("word").alias("root"), F.col("root").alias("next"))
        joined = links.join(further, "root", "left")
        if joined.filter("next is not null").isEmpty():
            return links
        links = joined.select("word", F.coalesce("next", "root").alias("root"))


def spelling_variants(documents: DataFrame, least_letters: int = 7, least_n: int = 2) -> DataFrame:
    """``variants`` of the words of ``documents`` that occur at least ``least_n`` times.

    Texts are read whole; null and empty ones have no words. Every row counts, whatever its id; other
    columns than ``doc_id`` and ``text`` are ignored. An empty table gives no rows.
    """
    return variants(typed_words(documents, least_letters).filter(F.col("n") >= least_n))
