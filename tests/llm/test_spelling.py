import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

from flowsieve.llm import spelling
from pyspark.sql import functions as F

LOWERED = {i: i + 32 for i in range(65, 91)}


def counted(docs):
    found = Counter()
    for doc_id, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWERED)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 7:
                found[run] += 1
    return {w: n for w, n in found.items() if n >= 2}


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(words):
    partners = defaultdict(list)
    for a in words:
        for b in words:
            if a != b and abs(len(a) - len(b)) <= 1 and near(a, b):
                partners[a].append(b)
    form = {}
    for w, n in words.items():
        if partners[w]:
            best = min(partners[w], key=lambda x: (-words[x], x))
            if words[best] >= 10 * n:
                form[w] = best
    out = []
    for w, n in words.items():
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, n, len(partners[w]), words[form[w]] if w in form else None))
    return sorted(out)


def run(spark, docs):
    df = spark.createDataFrame([(i, t, "w", 1, 2) for i, t in docs], "doc_id long, text string, word string, n long, key int")
    return sorted(tuple(r) for r in spelling.spelling_variants(df).collect())


def test_matches_brute_force(spark):
    rng = random.Random(5)
    stems = ["".join(rng.choices("abcdeéÀ×", k=rng.randint(6, 9))) for _ in range(12)]
    docs = [(1, None), (2, ""), (None, "Straßenbahn straßenbahn STRAßENBAHN"), (3, "x" * 300 + " " + "x" * 300 + " " + "x" * 299 + " " + "x" * 299)]
    for i in range(400):
        words = []
        for _ in range(rng.randint(1, 12)):
            w = list(rng.choice(stems[: rng.choice([2, 12])]))
            for _ in range(rng.choice([0, 0, 0, 1, 2])):
                at = rng.randrange(len(w))
                w[at : at + rng.choice([0, 1])] = rng.choices("abcdeé", k=rng.choice([0, 1]))
            words.append("".join(w) if rng.random() < 0.8 else "".join(w).upper())
        docs.append((10 + i, rng.choice([" ", ", ", "1", "_"]).join(words)))
    docs += [docs[20]] * 5
    words = counted(docs)
    expected = brute(words)
    assert run(spark, docs) == expected
    assert any(row[1] for row in expected)


def test_chains_lead_to_the_last_form(spark):
    words = {"aaaaaaa": 100_000, "aaaaaab": 10_000, "aaaaabb": 1_000, "aaaabbb": 100, "aaabbbb": 10, "aabbbbb": 1}
    df = spark.createDataFrame(list(words.items()), "word string, n long")
    rows = {r.word: r for r in spelling.variants(df).collect()}
    assert {r.root for r in rows.values()} == {"aaaaaaa"}
    assert rows["aabbbbb"].form == "aaabbbb" and rows["aaaaaaa"].form is None
    assert rows["aaaaabb"].n_near == 2


def test_ties_go_to_the_smallest_word(spark):
    df = spark.createDataFrame([("abcdefg", 1), ("abcdefz", 10), ("abcdefh", 10), ("abcdefé", 10)], "word string, n long")
    rows = {r.word: r.form for r in spelling.variants(df).collect()}
    assert rows["abcdefg"] == "abcdefh"


@pytest.mark.parametrize("symbols", [2, 6, 10])
def test_any_alphabet_finds_the_same_pairs(spark, symbols):
    rng = random.Random(symbols)
    words = sorted({"".join(rng.choices("abcé", k=rng.randint(1, 6))) for _ in range(300)})
    df = spark.createDataFrame([(w,) for w in words], "word string")
    found = sorted(tuple(r) for r in spelling.near_pairs(df, symbols).select(F.least("a", "b"), F.greatest("a", "b")).collect())
    assert found == sorted((a, b) for a in words for b in words if a < b and abs(len(a) - len(b)) <= 1 and near(a, b))


def test_empty_table(spark):
    assert run(spark, []) == []
    assert run(spark, [(1, None), (2, "short")]) == []


def test_long_words_cost_in_proportion_to_their_length():
    powers = spelling._powers(200_001)
    rows = sum(len(part) for part in spelling.neighbours(b"0123" * 50_000, 6, powers))
    assert rows < 200_000 * 6
