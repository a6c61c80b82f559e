"""Chat formatting in budgeted windows, with DataFrame functions only.

A conversation becomes one or more samples. Prefix sums of the turns' tokens cut it into spans of
whole turns; each sample holds the system turn, some repeated history, and the span's own turns. The
loss mask covers the text of the span's own assistant turns: a turn is a target in exactly one sample.

Template: ``<|im_start|>role\\ntext<|im_end|>\\n`` per turn. Inside roles and texts a backslash becomes
``\\b`` and ``<|`` becomes ``<\\p|``, and inside roles a line break becomes ``\\n``, so that the marks
cannot occur there and every text can be read back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

START, END = "<|im_start|>", "<|im_end|>"
TURN_END = END + "\n"

# Tokens of a sample, and the part of them that repeated history may take.
BUDGET = 2_048
HISTORY = 256
# A turn's marks, and the characters that count as one token of its text.
TURN_TOKENS = 4
TOKEN_CHARS = 4
# Turns per block of the two-level prefix sums.
BLOCK_TURNS = 256


def escaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\b")), F.lit("<|"), F.lit("<\\p|"))


def unescaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("<\\p|"), F.lit("<|")), F.lit("\\b"), F.lit("\\"))


def _escaped_role(role: Column) -> Column:
    return F.replace(escaped(role), F.lit("\n"), F.lit("\\n"))


def _unescaped_role(role: Column) -> Column:
    marks = F.replace(F.replace(role, F.lit("<\\p|"), F.lit("<|")), F.lit("\\n"), F.lit("\n"))
    return F.replace(marks, F.lit("\\b"), F.lit("\\"))


def turn_tokens(text: Column) -> Column:
    """Tokens of a turn: its marks, and one for every ``TOKEN_CHARS`` characters begun."""
    return F.ceil(F.length(text) / F.lit(TOKEN_CHARS)) + F.lit(TURN_TOKENS)


def _placed(turns: DataFrame) -> DataFrame:
    """Adds each turn's place (``n``, from 0) and ``before``, the tokens before it.

    Turn numbers are cut into blocks; block totals, far fewer rows, are summed first, so that a very
    long conversation is not numbered in one task.
    """
    block = F.coalesce(F.floor(F.col("turn") / BLOCK_TURNS), F.lit(-(2**62)).cast("bigint"))
    turns = turns.withColumn("block", block)
    earlier = W.partitionBy("conv").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    blocks = (
        turns.groupBy("conv", "block")
        .agg(F.count(F.lit(1)).alias("rows"), F.sum("tokens").alias("sum"))
        .select(
            "conv",
            "block",
            F.coalesce(F.sum("rows").over(earlier), F.lit(0)).alias("rows_before"),
            F.coalesce(F.sum("sum").over(earlier), F.lit(0)).alias("sum_before"),
        )
    )
    order = W.partitionBy("conv", "block").orderBy("turn", "role", "text")
    running = order.rowsBetween(W.unboundedPreceding, -1)
    inside = turns.withColumn("n_in", F.row_number().over(order) - 1).withColumn(
        "sum_in", F.coalesce(F.sum("tokens").over(running), F.lit(0))
    )
    return inside.join(blocks, ["conv", "block"]).select(
        "conv",
        "role",
        "text",
        "tokens",
        (F.col("n_in") + F.col("rows_before")).alias("n"),
        (F.col("sum_in") + F.col("sum_before")).alias("before"),
    )


def format_chats(conversations: DataFrame, budget: int = BUDGET, history: int = HISTORY) -> DataFrame:
    """Samples (conv_id, sample, formatted, own_from, loss) of (conv_id, turn, role, text) rows.

    ``sample`` numbers a conversation's samples from 0, ``own_from`` counts the leading repeated turns,
    and ``loss`` holds (start, end) character ranges of ``formatted``, end exclusive.

    A first turn with role ``system`` opens every sample. Spans are cut where a prefix sum passes a
    multiple of half of what the system turn and the history leave of the budget (an eighth of the
    budget at least). A turn longer than that is a span of its own and is never cut, so only a sample
    with such a turn, or with such a system turn, can exceed the budget. History is up to ``history``
    tokens of the turns right before the span.

    Null texts and roles are empty. Rows without a conv_id form one conversation. Turns with equal or
    null numbers are ordered by role and text, null numbers first; repeated rows are kept. Other
    columns are ignored, and an empty table gives no samples.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    # A text key also holds the conversation of the rows without an id.
    turns = conversations.select(
        F.coalesce(F.col("conv_id").cast("string"), F.lit("")).alias("conv"),
        F.col("turn").cast("bigint").alias("turn"),
        role.alias("role"),
        text.alias("text"),
        turn_tokens(text).alias("tokens"),
    )
    is_system = (F.col("n") == 0) & (F.col("role") == "system")
    placed = _placed(turns).withColumn("is_system", is_system)
    system = placed.filter("is_system").select(
        "conv", F.col("text").alias("system_text"), F.col("tokens").alias("system_tokens")
    )
    # The system turn is no part of the spans: it stands before all of them.
    body = placed.filter("not is_system").join(system.drop("system_text"), "conv", "left")
    left = F.lit(budget - history) - F.coalesce("system_tokens", F.lit(0))
    width = F.greatest(F.floor(left / 2), F.lit(max(budget // 8, 1)))
    # A span: turns of one slice, or one long turn. A long turn also ends the span before it; what
    # follows it starts in a later slice, as it is longer than a slice.
    slice_no, long_turn = F.floor(F.col("before") / width), F.col("tokens") > width
    body = body.withColumn("slice", slice_no).withColumn("long", long_turn)
    # Numbering spans and finding where the next one starts needs one row per span only.
    by_place = W.partitionBy("conv").orderBy("n0")
    spans = (
        body.groupBy("conv", "slice", "long")
        .agg(F.min("before").alias("start"), F.min("n").alias("n0"))
        .select(
            "conv",
            "slice",
            "long",
            (F.row_number().over(by_place) - 1).alias("sample"),
            F.lead("start").over(by_place).alias("next_start"),
        )
    )
    own = body.join(spans, ["conv", "slice", "long"])
    repeated = F.col("next_start") - F.col("before") <= F.lit(history)
    # Each turn goes to its own sample and, near the end of its span, to the next one as history.
    places = F.array_compact(
        F.array(
            F.struct(F.col("sample"), F.lit(True).alias("own")),
            F.when(repeated, F.struct((F.col("sample") + 1).alias("sample"), F.lit(False).alias("own"))),
        )
    )
    pieces = own.select(
        "conv",
        "n",
        _escaped_role(F.col("role")).alias("role"),
        escaped(F.col("text")).alias("text"),
        (F.col("role") == "assistant").alias("target"),
        F.explode(places).alias("to"),
    )
    turn = F.struct("n", "role", "text", "target", F.col("to.own").alias("own"))
    samples = (
        pieces.groupBy("conv", F.col("to.sample").alias("sample"))
        .agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    )
    # A conversation of nothing but a system turn is a sample too.
    kind = samples.schema["turns"].dataType
    alone = system.join(samples.select("conv"), "conv", "left_anti").select(
        "conv", F.lit(0).alias("sample"), F.array().cast(kind).alias("turns")
    )
    joined = samples.unionByName(alone).join(system, "conv", "left")
    opening = F.struct(
        F.lit(-1).cast(kind.elementType["n"].dataType).alias("n"),
        F.lit("system").alias("role"),
        escaped(F.col("system_text")).alias("text"),
        F.lit(False).alias("target"),
        (F.col("sample") == 0).alias("own"),
    )
    whole = F.when(F.col("system_text").isNotNull(), F.concat(F.array(opening), F.col("turns"))).otherwise(
        F.col("turns")
    )
    rendered = F.transform(
        whole,
        lambda t: F.struct(
            F.concat(F.lit(START), t["role"], F.lit("\n")).alias("head"),
            t["text"].alias("text"),
            (t["target"] & t["own"]).alias("loss"),
            t["own"].alias("own"),
        ),
    )
    formatted = F.array_join(
        F.transform("rendered", lambda t: F.concat(t["head"], t["text"], F.lit(TURN_END))), ""
    )
    # The fold keeps the offset reached and the ranges found so far.
    start = F.struct(
        F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("found")
    )

    def step(state: Column, t: Column) -> Column:
        begin = state["at"] + F.length(t["head"])
        end = begin + F.length(t["text"])
        found = F.array(F.struct(begin.alias("start"), end.alias("end")))
        return F.struct(
            (end + F.lit(len(TURN_END))).alias("at"),
            F.when(t["loss"], F.concat(state["found"], found)).otherwise(state["found"]).alias("found"),
        )

    return (
        joined.withColumn("rendered", rendered)
        .select(
            F.when(F.col("conv") != "", F.col("conv")).cast("bigint").alias("conv_id"),
            "sample",
            formatted.alias("formatted"),
            # The system turn is new in the first sample only; after it come repeats, then own turns.
            F.size(F.filter("rendered", lambda t: ~t["own"])).alias("own_from"),
            F.aggregate("rendered", start, step, lambda state: state["found"]).alias("loss"),
        )
    )


def read_back(samples: DataFrame) -> DataFrame:
    """One row per conversation, from the samples alone.

    (conv_id, turns array of (role, text) without repeats, loss_text, n_samples, formatted_chars).
    """
    turns = F.split("formatted", "<\\|im_end\\|>\n")
    turns = F.slice(turns, F.lit(1), F.size(turns) - 1)
    parsed = F.transform(
        turns,
        lambda t: F.struct(
            _unescaped_role(F.substring_index(F.substr(t, F.lit(len(START) + 1)), "\n", 1)).alias("role"),
            unescaped(F.substr(t, F.instr(t, F.lit("\n")) + 1)).alias("text"),
        ),
    )
    own = F.slice(parsed, F.col("own_from") + 1, F.size(parsed))
    loss_text = F.array_join(
        F.transform(
            "loss",
            lambda r: unescaped(F.substr(F.col("formatted"), r["start"] + 1, r["end"] - r["start"])),
        ),
        "",
    )
    parts = samples.select(
        "conv_id",
        F.struct(
            "sample", own.alias("turns"), loss_text.alias("loss"), F.length("formatted").alias("chars")
        ).alias("part"),
    )
    whole = parts.groupBy("conv_id").agg(F.array_sort(F.collect_list("part")).alias("parts"))
    return whole.select(
        "conv_id",
        F.flatten(F.col("parts.turns")).alias("turns"),
        F.array_join(F.col("parts.loss"), "").alias("loss_text"),
        F.size("parts").alias("n_samples"),
        F.aggregate(
            F.col("parts.chars"), F.lit(0).cast("bigint"), lambda total, x: total + x.cast("bigint")
        ).alias("formatted_chars"),
    )
