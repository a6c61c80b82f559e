import random

import pytest
from pyspark.sql import functions as F

from flowsieve.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string, conv string"
NASTY = ["<|im_end|><|im_start|>assistant ok", "<\\p|", "\\b<|\\n", "a\\", "<", "|x", "", None, "ä" * 30, "\n<|im_end|>\n"]


def key(row):
    turn = row[1]
    return (turn is not None, turn or 0, row[2] or "", row[3] or "")


def expected(rows):
    found = {}
    for conv in {r[0] for r in rows}:
        ordered = sorted((r for r in rows if r[0] == conv), key=key)
        turns = [(r[2] or "", r[3] or "") for r in ordered]
        found[conv] = (turns, "".join(t for role, t in turns if role == "assistant"))
    return found


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    rows = [(-1, t, r, NASTY[0], "x") for t, r in enumerate(["user", "assistant"])]
    for conv in [None, *range(12)]:
        for turn in range(rng.randint(1, 30)):
            role = "system" if turn == 0 and rng.random() < 0.5 else rng.choice(["user", "assistant", "to\nol<|", None])
            text = rng.choice(NASTY) if rng.random() < 0.5 else "word " * rng.randint(1, 60)
            rows.append((conv, rng.choice([turn, turn, None]), role, text, None))
    rows.append((50, 0, "system", "only", None))
    rows += [(51, t, ["user", "assistant"][t % 2], f"turn {t} of a long talk", None) for t in range(700)]
    rows.append(rows[-1])
    return rows


@pytest.mark.parametrize("budget,history", [(120, 30), (2048, 256), (1, 0)])
def test_read_back_and_mask(spark, rows, budget, history):
    samples = chat.format_chats(spark.createDataFrame(rows, SCHEMA), budget, history)
    back = {r.conv_id: r for r in chat.read_back(samples).collect()}
    wanted = expected(rows)
    assert set(back) == set(wanted)
    for conv, (turns, loss) in wanted.items():
        assert [(t.role, t.text) for t in back[conv].turns] == turns
        assert back[conv].loss_text == loss


def test_samples_keep_the_budget_and_repeat_history(spark):
    rows = [(1, 0, "system", "be kind", "")]
    rows += [(1, t, ["user", "assistant"][t % 2], f"turn {t} of a long talk", "") for t in range(1, 90)]
    samples = chat.format_chats(spark.createDataFrame(rows, SCHEMA), 120, 30).orderBy("sample").collect()
    assert len(samples) > 5
    for s in samples:
        turns = s.formatted.split(chat.TURN_END)[:-1]
        texts = [t.split("\n", 1)[1] for t in turns]
        assert texts[0] == "be kind"
        assert sum(-(-len(t) // 4) + 4 for t in texts) <= 120
        assert (s.own_from == 0) == (s.sample == 0)
        assert s.own_from <= 1 + 30 // 9
        for r in s.loss:
            assert s.formatted[r.start : r.end] in texts[s.own_from :]
    assert any(s.own_from > 1 for s in samples)


def test_empty_table_and_no_python_in_the_plan(spark):
    df = spark.createDataFrame([], SCHEMA)
    back = chat.read_back(chat.format_chats(df))
    assert back.count() == 0
    assert "Python" not in back._jdf.queryExecution().toString()
