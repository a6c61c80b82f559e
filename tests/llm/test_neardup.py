import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowsieve.llm import neardup
from flowsieve.llm.components import components

AZ = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingle_set(text, size=4):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(AZ))
    return {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set()


def brute(docs):
    sets = [shingle_set(t) for _, t in docs]
    parent = list(range(len(docs)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            if sets[i] and sets[j] and docs[i][0] is not None and docs[j][0] is not None:
                if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                    parent[root(i)] = root(j)
    out = []
    for i, (doc_id, _) in enumerate(docs):
        if doc_id is None:
            out.append((None, len(sets[i]), None, True))
            continue
        least = min(docs[j][0] for j in range(len(docs)) if root(j) == root(i) and docs[j][0] is not None)
        out.append((doc_id, len(sets[i]), least, doc_id == least))
    return sorted(out, key=repr)


def run(spark, docs):
    df = spark.createDataFrame([(i, t, "x", True) for i, t in docs], "doc_id long, text string, class string, kept boolean")
    return sorted([tuple(r) for r in neardup.near_duplicates(df, shingle_words=4).collect()], key=repr)


def test_matches_brute_force(spark):
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(400)] + ["Ä", "ä", "日本", "A", "a"]
    docs = [(900, None), (901, ""), (902, " \t"), (903, "one two"), (904, "ONE\ntwo"), (None, "one two"), (905, "one two three four")]
    passage = rng.choices(vocabulary, k=40)
    for group in range(25):
        base = rng.choices(vocabulary, k=rng.choice([3, 6, 12, 60, 200]))
        if group % 3 == 0:
            base += passage
        for _ in range(rng.randint(1, 8)):
            copy = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 4, 8])):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            docs.append((len(docs) * 7 % 1009 + 1000, rng.choice([" ", "\n"]).join(copy)))
    # A chain: each is near the next only; a hot group of copies; an id with two texts.
    chain = rng.choices(vocabulary, k=80)
    for i in range(12):
        docs.append((5000 - i, " ".join(chain[i * 2 : i * 2 + 56])))
    docs += [(6000 + i, docs[-1][1].upper()) for i in range(60)] + [docs[10], (docs[12][0], "quite another text it is")]
    assert run(spark, docs) == brute(docs)


def test_hot_group_of_near_copies(spark):
    rng = random.Random(9)
    base = [f"w{rng.randrange(900)}" for _ in range(120)]
    docs = []
    for i in range(300):
        copy = list(base)
        for _ in range(rng.choice([1, 3, 6])):
            copy[rng.randrange(120)] = f"x{rng.randrange(900)}"
        docs.append((i, " ".join(copy)))
    assert run(spark, docs) == brute(docs)


def test_empty_table(spark):
    assert run(spark, []) == []


@pytest.mark.parametrize("n,common", [(400, 320), (40, 36), (8, 4)])
def test_signatures_estimate_similarity(n, common):
    rng = np.random.default_rng(1)
    estimates = []
    for _ in range(40):
        union = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
        only = (len(union) - common) // 2
        a, b = np.sort(union[: common + only]), np.sort(np.concatenate([union[:common], union[common + only :]]))
        text = np.repeat([0, 1], [len(a), len(b)])
        s = neardup.superminhash(text, np.concatenate([a, b]), 2, 185)
        assert (s < 185 << 24).all()
        estimates.append((s[0] == s[1]).mean())
    assert abs(np.mean(estimates) - common / n) < 0.04


def test_components(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 180)] + [(300, 300), (401, 400)]
    found = components(spark.createDataFrame(links, "a long, b long")).collect()
    expected = {i: 0 for i in range(41)} | {i: 100 for i in range(100, 180)} | {300: 300, 400: 400, 401: 400}
    assert {r.node: r.component for r in found} == expected


@pytest.mark.parametrize("words", [8, 120, 500, 530, 900])
def test_the_filter_loses_no_link_and_refutes_most_others(spark, words):
    """Copies with ever more changes, some of them larger than the sets that are counted by cells."""
    from pyspark.sql import functions as F

    rng = random.Random(words)
    base = [f"w{rng.randrange(5000)}" for _ in range(words)]
    docs = []
    for i in range(60):
        copy = list(base)
        for _ in range(rng.randint(0, max(words // 12, 1))):
            copy[rng.randrange(words)] = f"x{rng.randrange(5000)}"
        docs.append((i, " ".join(copy)))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    prints = neardup.fingerprints(df, 4, neardup.BANDS, neardup.BAND_ROWS).select("doc_id", "n_shingles", "sketch")
    cells = neardup.with_cells(prints.withColumnRenamed("n_shingles", "n"))
    x, y = (cells.select([F.col(c).alias(f"{k}{c}") for c in cells.columns]) for k in "xy")
    pairs = x.join(y, F.col("xdoc_id") < F.col("ydoc_id")).filter(neardup.may_link("x", "y", 80))
    passed = {(r.xdoc_id, r.ydoc_id) for r in pairs.select("xdoc_id", "ydoc_id").collect()}
    sets = [shingle_set(t) for _, t in docs]
    linked = {(i, j) for j in range(60) for i in range(j) if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])}
    far = {(i, j) for j in range(60) for i in range(j) if 100 * len(sets[i] & sets[j]) < 70 * len(sets[i] | sets[j])}
    assert linked <= passed
    assert words > 200 or len(far & passed) <= len(far) / 10


def _family(rng, copies, words, most):
    base = [f"w{rng.randrange(5000)}" for _ in range(words)]
    docs = []
    for i in range(copies):
        copy = list(base)
        for _ in range(rng.randint(1, most)):
            copy[rng.randrange(words)] = f"x{rng.randrange(5000)}"
        docs.append((i, " ".join(copy)))
    return docs


def test_sets_of_hundreds_of_shingles_are_told_apart_before_they_are_compared(spark):
    docs = _family(random.Random(5), 60, 400, 16)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    prints = neardup.fingerprints(df, 4, neardup.BANDS, neardup.BAND_ROWS).select("doc_id", "n_shingles", "sketch")
    cells = neardup.with_cells(prints.withColumnRenamed("n_shingles", "n"))
    x, y = (cells.select([F.col(c).alias(f"{k}{c}") for c in cells.columns]) for k in "xy")
    pairs = x.join(y, F.col("xdoc_id") < F.col("ydoc_id")).filter(neardup.may_link("x", "y", 80))
    passed = {(r.xdoc_id, r.ydoc_id) for r in pairs.select("xdoc_id", "ydoc_id").collect()}
    sets = [shingle_set(t) for _, t in docs]
    alike = {(i, j): len(sets[i] & sets[j]) / len(sets[i] | sets[j]) for j in range(60) for i in range(j)}
    linked, far = {p for p in alike if alike[p] >= 0.8}, {p for p in alike if alike[p] < 0.74}
    assert len(linked) > 50 and len(far) > 500
    assert linked <= passed
    assert len(far & passed) <= len(far) / 10


def test_a_pair_is_met_in_one_of_its_bands(spark):
    df = spark.createDataFrame(_family(random.Random(6), 40, 80, 3), "doc_id long, text string")
    prints = neardup.fingerprints(df, 4, neardup.BANDS, neardup.BAND_ROWS)
    rows = prints.select("doc_id", "bands", F.explode("bands").alias("band"))
    rows = rows.withColumn("earlier", F.filter("bands", lambda b: b < F.col("band")))
    x, y = (rows.select([F.col(c).alias(f"{k}{c}") for c in rows.columns]) for k in "xy")
    shared = x.join(y, (F.col("xband") == F.col("yband")) & (F.col("xdoc_id") < F.col("ydoc_id")))
    pairs = shared.select("xdoc_id", "ydoc_id").distinct().collect()
    met = shared.filter(neardup.in_first_band("x", "y")).select("xdoc_id", "ydoc_id").collect()
    assert len(met) == len(pairs) < shared.count()
    assert set(met) == set(pairs)
