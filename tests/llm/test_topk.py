import math

import numpy as np
from pyspark.sql import functions as F

from flowsieve.llm import topk
from flowsieve.session import written


def brute(rows, k, every):
    vectors = []
    for i, v in rows:
        if i is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        vectors.append((i, [math.floor(1024 * x) for x in v]))
    found = []
    for own, (i, v) in enumerate(vectors):
        if i % every:
            continue
        scored = [(-sum(a * b for a, b in zip(v, w)), j) for at, (j, w) in enumerate(vectors) if at != own]
        found += [(i, r + 1, j, -s) for r, (s, j) in enumerate(sorted(scored)[:k])]
    return sorted(found)


def run(spark, rows, k, every, block=2048):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    vectors = written(topk.prepared(df, "vec_id", "embedding"), "test-vectors")
    found = topk.top_k(vectors, F.col("id") % every == 0, k, block)
    return sorted(tuple(r) for r in found.collect())


def test_matches_brute_force_with_ties_nulls_and_repeats(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(np.float32(x)) for x in rng.integers(-3, 4, 6) / 4]) for i in range(300)]
    rows += [(300, None), (400, [1.0, None]), (500, [float("nan")] * 6), (700, [float("inf")] * 6)]
    rows += [(None, [1.0] * 6), (7, rows[7][1]), (20, [0.5] * 6), (601, []), (602, [9.0])]
    rows += [(i, [0.5] * 6) for i in range(1000, 1100)]
    expected = brute(rows, 5, 20)
    given = [(i, v, 0) for i, v in rows]
    assert run(spark, given, 5, 20) == expected
    assert run(spark, given, 5, 20, block=4) == expected


def test_few_rows_and_large_numbers(spark):
    rows = [(0, [2.0**24, 1.0], 0), (1, [2.0**14, 3.0], 1), (3, [-1.0, 2.0], 1)]
    assert run(spark, rows, 10, 100) == brute([r[:2] for r in rows], 10, 100)
    assert run(spark, [], 10, 100) == []
    assert run(spark, [(0, [1.0], 0)], 10, 100) == []


def test_rows_of_one_id_are_rows_of_their_own(spark):
    """An id with two different vectors, as a query and as a candidate."""
    rows = [(0, [1.0, 0.0]), (0, [0.0, 1.0]), (0, [0.0, 1.0]), (1, [4.0, 0.0]), (1, [0.0, 4.0]), (2, [3.0, 3.0])]
    found = run(spark, [(i, v, 0) for i, v in rows], 3, 100)
    assert found == brute(rows, 3, 100) and len(found) == 9
    assert [r for r in found if r[1] == 1] == [(0, 1, 1, 4 * 1024 * 1024)] * 3
    assert run(spark, [(i, v, 0) for i, v in rows], 3, 100, block=1) == found
