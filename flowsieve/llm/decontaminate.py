"""Benchmark decontamination by a prefix-filtered set join, with DataFrame functions only.

Items are cut into windows of ``WINDOW`` words. The shingles (pairs of neighbouring words) of every
window are ordered by how often they occur in the corpus; a document that contains the window must
contain its rarest shingle, so only that one is joined. Where it occurs, the window's place follows
from the shingle's place in it; places that do not fit into the document are dropped, and the rest
are compared word by word.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowsieve.session import written

WINDOW = 13
# Shingles, and a window's rarest one, have rows of fixed size (under 100 bytes) and are broadcast up to
# this many rows; beyond it Spark shuffles.
PREFIX_ROWS = 500_000

# Letters in either case: A-Z are lowered after the text is cut, which gives the same words.
_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    """Words in order, in their own case. A null text has none."""
    return F.coalesce(F.regexp_extract_all(text, F.lit(_WORD), F.lit(0)), F.array().cast("array<string>"))


def lowered(words: Column) -> Column:
    """The words with A-Z lowered, and no other letter changed."""
    return F.transform(words, lambda w: F.translate(w, string.ascii_uppercase, string.ascii_lowercase))


def _join_words(text: Column) -> Column:
    """Words as they are joined: fully lower-cased, which is cheaper than lowering A-Z and joins no
    fewer places; they are compared exactly later. Capital sigma goes first, as the lower case of
    that letter alone depends on its neighbours.
    """
    return words_of(F.lower(F.replace(text, F.lit("\u03a3"), F.lit("\u03c3"))))


def _pairs(words: Column) -> Column:
    """Hash of each word and the next; the last word's is its own hash."""
    return F.zip_with(words, F.slice(words, F.lit(2), F.size(words)), lambda a, b: F.xxhash64(a, b))


def _singles(words: Column) -> Column:
    return F.transform(words, lambda a: F.xxhash64(a))


def benchmark_windows(benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """Distinct windows (window, words, items): each with the ids of the items that hold it."""
    words = F.col("words")
    count = F.greatest(F.size(words) - F.lit(size - 1), F.lit(1))
    cut = F.transform(F.sequence(F.lit(1), count), lambda i: F.slice(words, i, F.lit(size)))
    return (
        benchmark.filter(F.col("item_id").isNotNull())
        .select("item_id", words_of(F.col("text")).alias("words"))
        .filter(F.size("words") > 0)
        .select("item_id", F.explode(cut).alias("cased"))
        .groupBy(lowered(F.col("cased")).alias("words"))
        .agg(F.collect_set(F.col("item_id").cast("string")).alias("items"))
        .select(F.md5(F.array_join("words", " ")).alias("window"), "words", "items")
    )


def _tokens(docs: DataFrame, tokens) -> DataFrame:
    """(doc_id, text_key, n_words, at, token) of every shingle of every document."""
    cut = docs.select("doc_id", "text_key", _join_words(F.col("text")).alias("words"))
    cut = cut.select("doc_id", "text_key", F.size("words").alias("n_words"), tokens(F.col("words")).alias("t"))
    # The outer form keeps Spark from testing the array in a filter below, which would build it twice.
    return cut.select("doc_id", "text_key", "n_words", F.posexplode_outer("t").alias("at", "token"))


def _broadcast_written(df: DataFrame, label: str) -> DataFrame:
    """``df``, written, and marked for broadcast if it is small; no row becomes a Python object."""
    df = written(df, label)
    return F.broadcast(df) if df.count() <= PREFIX_ROWS else df


def _candidates(docs: DataFrame, windows: DataFrame, tokens, single: bool) -> DataFrame:
    """Places (doc_id, text_key, start, window) where a window may stand."""
    held = tokens(_join_words(F.array_join("words", " ")))
    if not single:
        held = F.slice(held, F.lit(1), F.size("words") - 1)
    held = windows.select("window", F.size("words").alias("size"), F.posexplode(held).alias("offset", "token"))
    held = written(held, "window-tokens")
    distinct = _broadcast_written(held.select("token").distinct(), "window-token-set")
    # Texts are cut once: what no window holds goes at once, and rarity comes from all documents.
    shared = written(_tokens(docs, tokens).join(distinct, "token"), "shared-tokens")
    counts = shared.groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    # A window with a token that occurs nowhere is in no document: fewer of its tokens are counted.
    size = F.lit(1) if single else F.col("size") - 1
    prefix = (
        held.join(counts, "token")
        .groupBy("window")
        .agg(
            F.count(F.lit(1)).alias("found"),
            F.min(F.struct("n", "token", "offset")).alias("rarest"),
            F.first("size").alias("size"),
        )
        .filter(F.col("found") == size)
        .select("rarest.token", "rarest.offset", "window", "size")
    )
    start = F.col("at") - F.col("offset")
    return (
        shared.join(_broadcast_written(prefix, "window-prefixes"), "token")
        .withColumn("start", start)
        .filter((start >= 0) & (start + F.col("size") <= F.col("n_words")))
        .select("doc_id", "text_key", "start", "window")
    )


def candidate_places(docs: DataFrame, windows: DataFrame) -> DataFrame:
    """Distinct (doc_id, text_key, start, window) where a window may stand.

    Equal rows have the same places: each is listed once, however often the row repeats.
    """
    many, one = windows.filter(F.size("words") > 1), windows.filter(F.size("words") == 1)
    found = _candidates(docs, many, _pairs, False)
    if not one.isEmpty():
        found = found.unionByName(_candidates(docs, one, _singles, True))
    return found.distinct()


def contamination(documents: DataFrame, benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """``documents`` with n_words, hits, n_hit, items, contaminated.

    ``hits``: places (start, end) of windows in words, end exclusive, in order. ``n_hit``: words inside
    any of them. ``items``: ids (as text, in order) of the items with a window here. ``contaminated``:
    at least one word in twenty is hit. The result has doc_id, text, these columns, and whatever other
    columns ``documents`` has whose names do not clash with them.

    A null or empty text has no words and is clean. Items without an id or without words are ignored;
    an item_id that repeats holds the windows of all its texts. Repeated document rows get equal
    results. Rows without a doc_id are judged like others.
    """
    added = {"text_key", "n_words", "hits", "n_hit", "items", "contaminated", "places", "words"}
    documents = documents.drop(*added)
    keyed = documents.withColumn("text_key", F.xxhash64("text"))
    slim = keyed.select("doc_id", "text_key", "text")
    windows = written(benchmark_windows(benchmark, size), "windows")
    # Words and items have no bound in bytes, so Spark decides how they are joined.
    found = candidate_places(slim, windows).join(windows, "window")
    places = found.groupBy("doc_id", "text_key").agg(
        F.collect_list(F.struct("start", "words", "items")).alias("places")
    )
    places = places.withColumnsRenamed({"doc_id": "_doc_id", "text_key": "_text_key"})
    same = F.col("doc_id").eqNullSafe(F.col("_doc_id")) & (F.col("text_key") == F.col("_text_key"))
    joined = keyed.join(places, same, "left").withColumn("words", words_of(F.col("text")))

    def stands(p: Column) -> Column:
        return lowered(F.slice(F.col("words"), p["start"] + 1, F.size(p["words"]))) == p["words"]

    verified = F.coalesce(F.filter("places", stands), F.array().cast(joined.schema["places"].dataType))
    hits = F.array_sort(
        F.array_distinct(
            F.transform(
                "places",
                lambda p: F.struct(p["start"].alias("start"), (p["start"] + F.size(p["words"])).alias("end")),
            )
        )
    )
    start = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))

    def step(state: Column, hit: Column) -> Column:
        new = F.greatest(hit["end"] - F.greatest(state["end"], hit["start"]), F.lit(0))
        return F.struct(F.greatest(state["end"], hit["end"]).alias("end"), (state["n"] + new).alias("n"))

    result = (
        joined.withColumn("places", verified)
        .withColumn("n_words", F.size("words").cast("bigint"))
        .withColumn("hits", hits)
        .withColumn("n_hit", F.aggregate("hits", start, step, lambda s: s["n"]).cast("bigint"))
        .withColumn("items", F.array_sort(F.array_distinct(F.flatten(F.col("places.items")))))
        .withColumn("contaminated", (F.col("n_hit") > 0) & (F.col("n_hit") * 20 >= F.col("n_words")))
    )
    return result.select(*documents.columns, "n_words", "hits", "n_hit", "items", "contaminated")
