"""Secret scans with corpus-wide ownership frequency, with DataFrame functions only.

Candidates are found by patterns, each with its place in the text. Their values, as hashes, are then
counted over the whole corpus by distinct repositories and owners: a value that many owners hold is a
copied example, a value that stays with few is likely to be live.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowsieve.session import written

# Held by at least so many owners or repositories, a value counts as a copied example.
EXAMPLE_OWNERS = 4
EXAMPLE_REPOSITORIES = 8
MARK = "[SECRET]"

# A private key: header, attributes of an encrypted one, and the body with what sets it into code or
# quotes, up to the END line; where that is missing, up to the body's last long piece and one short line
# after it. Character classes are repeated, not groups, so that long bodies need no stack. Classes of the
# body leave out the dash, so that no match runs into the next header.
_PEM = (
    r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----"
    r"(?:[\x20\t\r\nrn\\]*[A-Z][A-Za-z]*-[A-Z][A-Za-z]*:\x20?[A-Za-z0-9,-]+){0,8}"
    r"""(?:[A-Za-z0-9+/=\x20\t\r\n\\"'`,;:>#*|]*"""
    r"(?:-----END [A-Z ]{0,20}PRIVATE KEY-----"
    r"|[A-Za-z0-9+/=]{24,}"
    r"""(?:[\x20\t"'\\rn+,;]*(?:\r?\n|\\n)[\x20\t"'`>#*|+]*[A-Za-z0-9+/]{1,23}={0,2})?))?"""
)

# Kind, pattern, group with the value, its least length, and strings (lower case) one of
# which every match contains; in the order in which spans with the same start are listed.
KINDS = [
    (
        "assign",
        r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        1,
        6,
        ["password", "passwd", "secret", "token", "apikey", "api_key"],
    ),
    ("access", r"AKIA[A-Z0-9]{16,}", 0, 20, ["akia"]),
    ("hex", r"[0-9a-f]{24,}", 0, 24, []),
    ("github", r"gh[opsur]_[A-Za-z0-9]{20,}", 0, 24, ["gho_", "ghp_", "ghs_", "ghu_", "ghr_"]),
    ("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}", 0, 15, ["xox"]),
    ("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 29, ["eyj"]),
    ("pem", _PEM, 0, 27, ["private key-----"]),
]
BASE_KINDS = ("assign", "access", "hex")

_SPAN = "struct<start:int,place:int,kind:string,end:int,value:string>"


def _found(text: Column, low: Column, place: int) -> Column:
    """Spans of one kind: what lies between matches gives their places.

    ``split`` and ``regexp_extract_all`` walk the text in the same way, so the pieces and the matches
    alternate.
    """
    kind, pattern, group, least, hints = KINDS[place]
    pieces = F.split(text, pattern, -1)
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    steps = F.zip_with(
        F.arrays_zip(matches.alias("m"), values.alias("v")),
        F.slice(pieces, F.lit(1), F.size(pieces) - 1),
        lambda x, piece: F.struct(x["m"].alias("m"), x["v"].alias("v"), F.length(piece).alias("gap")),
    )
    start = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{_SPAN}>").alias("spans"))

    def step(state: Column, x: Column) -> Column:
        begin = state["at"] + x["gap"]
        end = begin + F.length(x["m"])
        span = F.struct(
            begin.alias("start"),
            F.lit(place).alias("place"),
            F.lit(kind).alias("kind"),
            end.alias("end"),
            F.sha2(x["v"], 256).alias("value"),
        )
        grown = F.concat(state["spans"], F.array(span))
        return F.struct(
            end.alias("at"), F.when(F.length(x["v"]) >= least, grown).otherwise(state["spans"]).alias("spans")
        )

    spans = F.aggregate(steps, start, step, lambda state: state["spans"])
    possible = text.rlike(pattern)
    if hints:
        possible = reduce(lambda x, y: x | y, [F.contains(low, F.lit(h)) for h in hints]) & possible
    return F.when(possible, spans).otherwise(F.array().cast(f"array<{_SPAN}>"))


def scan(documents: DataFrame, owner: Column, repository: Column) -> DataFrame:
    """(row, doc_id, text_key, owner, repository, spans), one row per document, written once.

    Spans have start and end in code points, end exclusive, and the value's SHA-256, never the value.
    """
    low = F.col("low")
    texts = documents.select(
        "doc_id",
        F.xxhash64("text").alias("text_key"),
        owner.cast("string").alias("owner"),
        repository.cast("string").alias("repository"),
        F.coalesce("text", F.lit("")).alias("text"),
    ).withColumn("low", F.lower("text"))
    found = F.flatten(F.array(*[_found(F.col("text"), low, place) for place in range(len(KINDS))]))
    spans = texts.select(
        F.monotonically_increasing_id().alias("row"),
        "doc_id",
        "text_key",
        "owner",
        "repository",
        F.array_sort(found).alias("spans"),
    )
    return written(spans, "secret-spans")


def ownership(scanned: DataFrame) -> DataFrame:
    """(value, owners, repositories): in how many distinct ones each value occurs.

    Null owners or repositories count as one. Distinct triples come first, so that a value found
    everywhere is counted from a row per repository.
    """
    held = scanned.select(
        F.explode("spans.value").alias("value"),
        F.coalesce("owner", F.lit("")).alias("owner"),
        F.coalesce("repository", F.lit("")).alias("repository"),
    ).distinct()
    return held.groupBy("value").agg(
        F.count_distinct("owner").alias("owners"), F.count_distinct("repository").alias("repositories")
    )


def find_secrets(
    documents: DataFrame,
    owner: Column,
    repository: Column,
    example_owners: int = EXAMPLE_OWNERS,
    example_repositories: int = EXAMPLE_REPOSITORIES,
) -> DataFrame:
    """(row, doc_id, text_key, spans) for each document; a span has start, place, kind, end, live, owners.

    ``live``: fewer than ``example_owners`` owners and ``example_repositories`` repositories hold the
    value. Spans are ordered by start, then by the place of their kind in :data:`KINDS`.

    A null text is empty and has no spans. Repeated rows are judged one by one. Rows without doc_id,
    owner or repository are kept. Other columns are ignored; an empty table gives no rows.
    """
    scanned = scan(documents, owner, repository)
    live = (F.col("owners") < example_owners) & (F.col("repositories") < example_repositories)
    judged = ownership(scanned).withColumn("live", live)
    each = scanned.select("row", F.explode("spans").alias("span"))
    each = each.select("row", "span", F.col("span.value").alias("value")).join(judged, "value")
    span = F.struct("span.start", "span.place", "span.kind", "span.end", "live", "owners")
    lists = each.groupBy("row").agg(F.array_sort(F.collect_list(span)).alias("judged"))
    none = F.array().cast(lists.schema["judged"].dataType)
    return scanned.join(lists, "row", "left").select(
        "row", "doc_id", "text_key", F.coalesce("judged", none).alias("spans")
    )


def redacted(text: Column, spans: Column, mark: str = MARK) -> Column:
    """``text`` with each span replaced by ``mark``; spans in order of start, overlaps as one."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("parts"))

    def step(state: Column, span: Column) -> Column:
        gap = F.substr(text, state["at"] + 1, F.greatest(span["start"] - state["at"], F.lit(0)))
        apart = (span["start"] >= state["at"]) & ((span["start"] > state["at"]) | (F.size(state["parts"]) == 0))
        parts = F.concat(state["parts"], F.array(gap, F.lit(mark)))
        return F.struct(
            F.greatest(state["at"], span["end"]).alias("at"),
            F.when(apart, parts).otherwise(state["parts"]).alias("parts"),
        )

    def finish(state: Column) -> Column:
        rest = F.substr(text, state["at"] + 1, F.length(text))
        return F.concat(F.array_join(state["parts"], ""), rest)

    return F.aggregate(spans, start, step, finish)
