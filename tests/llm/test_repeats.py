import hashlib
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from flowsieve.llm import repeats


def brute(docs, length):
    texts = [(t or "").encode() for _, t in docs]
    counts = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for (doc_id, _), t in zip(docs, texts):
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - length + 1):
            if counts[t[i : i + length]] > 1:
                gone[i : i + length] = True
        kept = bytes(b for b, g in zip(t, gone) if not g)
        spans = sum(1 for i in range(len(t)) if gone[i] and not (i and gone[i - 1]))
        out.append((doc_id, len(t), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def run(spark, docs, length):
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in docs], "doc_id long, text string, key string, n long")
    return sorted([tuple(r) for r in repeats.remove_repeats(df, length).collect()], key=repr)


@pytest.mark.parametrize("length", [16, 50, 400])
def test_matches_brute_force(spark, length):
    rng = random.Random(length)
    letters = "abcdefghijklmnop äß日"
    passages = ["".join(rng.choices(letters, k=rng.randint(length // 2, 3 * length))) for _ in range(6)]
    docs = [(1, None), (2, ""), (3, "ab" * length), (4, "x" * (length + 3)), (5, "x" * (length - 1)), (None, passages[0])]
    for i in range(60):
        text = ""
        for _ in range(rng.randint(0, 4)):
            text += "".join(rng.choices(letters, k=rng.randint(0, length)))
            p = rng.choice(passages)
            at = rng.randint(0, len(p) // 3)
            text += p[at : rng.randint(at, len(p))]
        if i % 5 == 0 and text:
            cut = rng.randrange(len(text))
            docs.append((1000 + i, text[:cut] + "!" + text[cut + 1 :]))
        docs.append((10 + i, text))
    docs += [(200 + i, docs[20][1]) for i in range(5)] + [docs[30], (docs[31][0], "another text with that id")]
    assert run(spark, docs, length) == brute(docs, length)


def test_empty_table(spark):
    assert run(spark, [], 400) == []


def test_kept_bytes(spark):
    rng = random.Random(0)
    a, b = ("".join(rng.choices("abcdef", k=60)) for _ in range(2))
    df = spark.createDataFrame([(1, a + b), (2, "<<" + b)], "doc_id long, text string")
    rows = {r.doc_id: bytes(r.kept).decode() for r in repeats.remove_repeats(df, 30, with_kept=True).collect()}
    assert rows == {1: a, 2: "<<"}


def test_portions():
    sizes = np.array([3, 3, 3, 20, 1, 9, 1])
    parts = [sizes[p].tolist() for p in repeats._portions(sizes, 10)]
    assert parts == [[3, 3, 3], [20], [1, 9], [1]]
    assert list(repeats._portions(sizes[:0], 10)) == []


def test_a_task_holds_no_more_pieces_than_it_passes_on():
    """Classes of 256 suffixes, cut to single ones: none is lost, and no batch grows with the input."""
    rng, classes = np.random.default_rng(0), 500
    data = [rng.integers(0, 256, 655, np.uint8).tobytes() for _ in range(classes)]
    rows = {
        "digit": pa.array(range(classes), pa.int64()),
        "whole": pa.array(range(classes), pa.int64()),
        "far": pa.array([255] * classes, pa.int32()),
        "copies": pa.array([2] * classes, pa.int64()),
        "bytes": pa.array(data, pa.binary()),
        "parts": pa.array([[{"far": 255, "n": 256}]] * classes, pa.list_(pa.struct([("far", pa.int32()), ("n", pa.int32())]))),
    }
    batch = pa.RecordBatch.from_pydict(rows)
    # The first rows of a batch may belong to another one.
    found = list(repeats._cut_batches(iter([batch.slice(0, 100), batch.slice(100)]), 400, 1))
    assert max(b.num_rows for b in found) < repeats.PASSED_ROWS + 256
    table = pa.Table.from_batches(found)
    assert sorted(zip(table["of_digit"].to_pylist(), table["far"].to_pylist())) == [(c, f) for c in range(classes) for f in range(256)]
    digit = repeats._digits(memoryview(data[300]), 5, 1, 250, 400, 1, 256)[0]
    assert {d for c, f, d in zip(*(table[k].to_pylist() for k in ("of_digit", "far", "digit"))) if (c, f) == (300, 250)} == {digit}
