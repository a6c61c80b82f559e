import random
import re

from pyspark.sql import functions as F

from flowsieve.llm import decontaminate

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
AZ = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall((text or "").translate(AZ))


def brute(docs, items):
    windows = {}
    for item, text in items:
        w = words(text)
        for i in range(max(1, len(w) - 12) if w and item is not None else 0):
            windows.setdefault(tuple(w[i : i + 13]), set()).add(str(item))
    found = []
    for doc_id, text in docs:
        w, hit, ids = words(text), set(), set()
        for i in range(len(w)):
            for n in range(1, 14):
                if i + n <= len(w) and tuple(w[i : i + n]) in windows:
                    hit.update(range(i, i + n))
                    ids |= windows[tuple(w[i : i + n])]
        bad = len(hit) > 0 and 20 * len(hit) >= len(w)
        found.append((doc_id, len(w), len(hit), sorted(ids), bad))
    return sorted(found, key=repr)


def run(spark, docs, items):
    d = spark.createDataFrame([(i, t, "x", "y") for i, t in docs], "doc_id long, text string, words string, hits string")
    b = spark.createDataFrame(items, "item_id long, text string")
    rows = decontaminate.contamination(d, b).collect()
    return sorted([(r.doc_id, r.n_words, r.n_hit, r["items"], r.contaminated) for r in rows], key=repr)


def test_matches_brute_force(spark):
    rng = random.Random(1)
    vocabulary = ["a", "the", "Käse", "KÄSE", "käse", "İx", "ΑΣ", "Kelvin", "b1", "c", "d", "e", "日本"]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.choice([1, 2, 5, 13, 14, 30])))) for i in range(25)]
    items += [(100, None), (101, " .,"), (None, "the only a"), (3, "d e d e d"), (102, items[5][1])]
    docs = []
    for i in range(120):
        parts = rng.choices(vocabulary, k=rng.randint(0, 40))
        if i % 2:
            source = words(rng.choice(items)[1])
            parts[rng.randint(0, len(parts)) :][:0] = source
            parts += source[:12] + ["z"] + source
        docs.append((i, rng.choice([" ", "-", ". "]).join(p.upper() if p.isascii() else p for p in parts)))
    docs += [(500, None), (501, ""), (502, "..."), docs[3], (3, "other text"), (None, docs[5][1]), (503, "zz " * 30_000 + docs[1][1])]
    assert run(spark, docs, items) == brute(docs, items)
    assert any(r[4] for r in brute(docs, items))


def test_empty_tables(spark):
    assert run(spark, [], [(1, "a b")]) == []
    assert run(spark, [(1, "a b")], []) == brute([(1, "a b")], [])


def test_no_python_in_the_plan(spark):
    d = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    b = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert "Python" not in decontaminate.contamination(d, b)._jdf.queryExecution().toString().split("Physical")[-1]


def test_a_repeated_row_has_the_places_of_one(spark):
    """A row that stands 2,000 times lists each place once, so the work is in proportion to the rows."""
    item = " ".join(f"w{k}" for k in range(60))
    b = spark.createDataFrame([(1, item)], "item_id long, text string")
    windows = decontaminate.benchmark_windows(b)
    for times in (1, 2000):
        docs = [(1, "before " + item + " after")] * times + [(2, "other words")]
        d = spark.createDataFrame(docs, "doc_id long, text string")
        assert decontaminate.candidate_places(d.withColumn("text_key", F.xxhash64("text")), windows).count() == 48
        assert decontaminate.contamination(d, b).filter("contaminated").count() == times
