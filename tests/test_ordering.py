import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowsieve.operators import ordering
from flowsieve.operators.ordering import (
    grouped_quantile,
    hash_positions,
    hash_quota,
    order_values,
    quantiles,
    running_sums,
    top_rows,
)
from flowsieve.session import written


@pytest.fixture(scope="module")
def numbers(spark):
    """3,000 rows; a third of them share one value."""
    rng = np.random.default_rng(1)
    values = np.round(rng.exponential(10, 3000), 2)
    values[::3] = 4.0
    rows = [(i, float(v), float(-v) if i % 50 else None) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "id bigint, a double, b double").repartition(7)


@pytest.mark.parametrize("descending", [False, True])
def test_running_sums_in_buckets_equal_one_window(numbers, descending):
    counts = numbers.groupBy("a").agg(F.count(F.lit(1)).alias("n"), F.sum("id").alias("s"))
    plain = running_sums(counts, "a", ["n", "s"], descending).toPandas().sort_values("a")
    bucketed = running_sums(counts, "a", ["n", "s"], descending, task_rows=10).toPandas()
    bucketed = bucketed.sort_values("a")
    assert (plain.to_numpy() == bucketed[plain.columns].to_numpy()).all()
    assert plain["cum_n"].max() == 3000


@pytest.mark.parametrize("task_rows", [10, 1000, 1_000_000])
def test_order_values(numbers, task_rows):
    pdf = numbers.toPandas()
    a, b = np.sort(pdf["a"]), np.sort(pdf["b"].dropna())
    ranks = {"a": [0, 1, 900, 1500, 1501, 2999], "b": [0, 17, len(b) - 1]}
    found = order_values(numbers, ranks, task_rows)
    assert found["a"] == [a[k] for k in ranks["a"]]
    assert found["b"] == [b[k] for k in ranks["b"]]
    with pytest.raises(ValueError):
        order_values(numbers, {"a": [3000]}, task_rows)


@pytest.mark.parametrize("task_rows", [10, 1000, 1_000_000])
def test_quantiles(numbers, task_rows):
    pdf = numbers.toPandas()
    shares = [0.0, 0.005, 0.3, 0.5, 0.95, 0.995, 1.0]
    found = quantiles(numbers, ["a", "b"], shares, task_rows)
    assert np.allclose(found["a"], np.quantile(pdf["a"], shares), atol=1e-12)
    assert np.allclose(found["b"], np.quantile(pdf["b"].dropna(), shares), atol=1e-12)
    empty = numbers.select(F.lit(None).cast("double").alias("x"))
    assert quantiles(empty, ["x"], [0.5], task_rows) == {"x": [None]}


def digest(i, salt):
    return hashlib.md5(f"{i}:{salt}".encode()).hexdigest()


def test_hash_positions(numbers):
    found = hash_positions(numbers.select("id"), ["id"], digits=2).toPandas()
    order = sorted(range(3000), key=lambda i: digest(i, 42))
    assert dict(zip(found["id"], found["position"])) == {i: p for p, i in enumerate(order)}


@pytest.mark.parametrize("digits", [1, 4])
def test_hash_quota_per_group(numbers, digits):
    groups = numbers.select("id", F.when(F.col("id") % 5 > 0, F.col("id") % 2).alias("g"))
    share = F.floor(F.lit(0.3) * F.col("group_rows"))
    found = hash_quota(groups, ["id"], share, by=["g"], digits=digits).toPandas()
    assert len(found) == 3000
    for g in (0, 1, None):
        members = found[found["g"].isna()] if g is None else found[found["g"] == g]
        count = int(0.3 * len(members))
        expected = sorted(members["id"], key=lambda i: digest(i, 42))[:count]
        assert set(members[members["taken"]]["id"]) == set(expected)


def test_hash_quota_larger_than_the_table(numbers):
    found = hash_quota(numbers.select("id"), ["id"], F.lit(5000))
    assert found.filter("taken").count() == 3000
    assert hash_quota(numbers.select("id"), ["id"], F.lit(0)).filter("taken").count() == 0


@pytest.mark.parametrize("task_rows", [10, 1_000_000])
@pytest.mark.parametrize("count", [0, 1, 700, 1500, 2999, 3000, 4000])
def test_top_rows(numbers, count, task_rows):
    pdf = numbers.toPandas().sort_values(["a", "id"], ascending=[False, True])
    chosen = numbers.filter(top_rows(numbers, "a", "id", count, task_rows)).toPandas()
    assert set(chosen["id"]) == set(pdf["id"].head(count))


def test_same_result_for_any_partitioning(numbers):
    results = []
    for parts in (1, 8):
        df = numbers.select("id").repartition(parts)
        taken = hash_quota(df, ["id"], F.lit(100)).filter("taken").select("id")
        results.append(sorted(r.id for r in taken.collect()))
    assert results[0] == results[1] and len(results[0]) == 100


@pytest.mark.parametrize("descending", [False, True])
@pytest.mark.parametrize("task_rows", [2, 1_000_000])
def test_running_sums_keep_null_and_nan_keys(spark, descending, task_rows):
    rows = [(None, 1), (0.5, 2), (1.5, 4), (2.5, 8), (3.5, 16), (float("nan"), 32)]
    df = spark.createDataFrame(rows, "k double, n long")
    found = {repr(r.k): r.cum_n for r in running_sums(df, "k", ["n"], descending, task_rows).collect()}
    order = [n for _, n in (reversed(rows) if descending else rows)]
    expected = {repr(k): sum(order[: order.index(n) + 1]) for k, n in rows}
    assert found == expected


def test_grouped_quantile_matches_numpy(spark):
    rows = [(g, float((i * 37) % 101)) for g in ("a", "b", None) for i in range(40)] + [("a", None)]
    df = spark.createDataFrame(rows, "g string, v double")
    for limit in (7, 1_000_000):
        found = {r.g: r.v for r in grouped_quantile(df, ["v"], 0.9, "g", limit).collect()}
        for g in ("a", "b", None):
            assert found[g] == pytest.approx(np.quantile([v for k, v in rows if k == g and v is not None], 0.9))


def cumulated(rows, descending=False):
    out, total = {}, {}
    for g, k, n in sorted(rows, key=lambda r: (r[0], r[1]), reverse=descending):
        total[g] = total.get(g, 0) + n
        out[g, k] = total[g]
    return out


@pytest.mark.parametrize("descending", [False, True])
def test_running_sums_over_text_keys_and_groups_of_all_sizes(spark, descending):
    """Most groups have a row or two, one has half of them, so that it goes on over many ranges."""
    rng = np.random.default_rng(4)
    rows = {(f"g{int(rng.integers(400))}" if i % 2 else "large", f"key-{i:05d}", i % 7) for i in range(3000)}
    df = spark.createDataFrame(sorted(rows), "g string, k string, n long").repartition(5)
    found = running_sums(df, "k", ["n"], descending, task_rows=100, by=["g"])
    assert {(r.g, r.k): r.cum_n for r in found.collect()} == cumulated(rows, descending)


def test_running_sums_over_a_tiny_limit_keep_the_number_of_ranges(spark, monkeypatch):
    """Each range is a task and a file; 3,000 rows over a limit of 5 took 1,200 of them."""
    kept = {}

    def recorded(df, label):
        kept[label] = written(df, label)
        return kept[label]

    monkeypatch.setattr(ordering, "written", recorded)
    rows = [(i % 3, i, 1) for i in range(3000)]
    df = spark.createDataFrame(rows, "g long, k long, n long")
    found = running_sums(df, "k", ["n"], task_rows=5, by=["g"])
    assert {(r.g, r.k): r.cum_n for r in found.collect()} == cumulated(rows)
    assert 200 < kept["ranges"].select("_bucket").distinct().count() <= 256


def test_running_sums_broadcast_no_more_than_two_totals_a_range(spark):
    rows = [(i, 0, 1) for i in range(5000)] + [(-1, k, 1) for k in range(5000)]
    df = spark.createDataFrame(rows, "g long, k long, n long")
    found = running_sums(df, "k", ["n"], task_rows=500, by=["g"])
    assert {(r.g, r.k): r.cum_n for r in found.collect()} == cumulated(rows)
    text = found._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in text and "SinglePartition" not in text


def test_hundred_thousand_groups_one_beyond_the_limit(spark):
    """Quantiles of many small groups and one large, with nothing per group in the driver."""
    small = spark.range(100_000).select(F.col("id").alias("g"), F.explode(F.sequence(F.lit(0), F.col("id") % 4)).alias("j"))
    small = small.select("g", ((F.col("g") * 31 + F.col("j") * 17) % 1009).cast("double").alias("v"))
    large = spark.range(20_000).select(F.lit(-1).cast("long").alias("g"), ((F.col("id") * 7919) % 20_011).cast("double").alias("v"))
    df = small.unionByName(large)
    found = {r.g: r.v for r in grouped_quantile(df, ["v"], 0.9, "g", task_rows=5_000).collect()}
    assert len(found) == 100_001
    expected = df.toPandas().groupby("g").v.quantile(0.9)
    assert np.allclose([found[g] for g in expected.index], expected.to_numpy())


@pytest.mark.parametrize("slack", [0.007, -0.2])
def test_grouped_quantile_is_exact_when_brackets_miss(spark, monkeypatch, slack):
    from flowsieve.operators import ordering

    monkeypatch.setattr(ordering, "GROUP_SLACK", slack)
    rng = np.random.default_rng(8)
    rows = [(g, float(v), float(-v)) for g in ("a", "b") for v in rng.exponential(3, 1500).round(2)]
    rows += [("none", None, 1.0), ("nan", float("nan"), 2.0), ("nan", 3.0, None), (None, 5.0, 6.0)]
    df = spark.createDataFrame(rows, "g string, x double, y double")
    found = {r.g: r for r in grouped_quantile(df, ["x", "y"], 0.3, "g").collect()}
    for g in ("a", "b"):
        for c, at in (("x", 1), ("y", 2)):
            assert found[g][c] == pytest.approx(np.quantile([r[at] for r in rows if r[0] == g], 0.3))
    assert found["none"].x is None and found["none"].y == 1.0
    assert np.isnan(found["nan"].x) and found["nan"].y == 2.0
    assert (found[None].x, found[None].y) == (5.0, 6.0)


@pytest.mark.parametrize("task_rows", [20, 500, 1_000_000])
def test_order_values_of_texts_and_structs(spark, task_rows):
    rng = np.random.default_rng(2)
    words = ["".join(rng.choice(list("abcé"), int(rng.integers(1, 6)))) for _ in range(3000)]
    words[::3] = ["hot"] * 1000
    rows = [(w, int(n), bool(n % 2)) for w, n in zip(words, rng.integers(0, 50, 3000))] + [(None, 1, None)]
    df = spark.createDataFrame(rows, "w string, n int, b boolean").repartition(4)
    df = df.withColumn("both", F.when(F.col("w").isNotNull(), F.struct("w", "n")))
    ranks = [0, 5, 1234, 1500, 2999]
    found = order_values(df, {"w": ranks, "n": ranks, "both": ranks, "b": [0, 2999]}, task_rows)
    texts = sorted(words, key=lambda w: w.encode())
    pairs = sorted(((w, n) for w, n, _ in rows if w is not None), key=lambda p: (p[0].encode(), p[1]))
    assert found["w"] == [texts[k] for k in ranks]
    assert [tuple(v) for v in found["both"]] == [pairs[k] for k in ranks]
    assert found["n"] == [sorted(n for _, n, _ in rows)[k] for k in ranks]
    assert found["b"] == [False, True]


@pytest.mark.parametrize("task_rows", [10, 1_000_000])
@pytest.mark.parametrize("count", [1, 700, 1500])
def test_top_rows_with_text_ids(numbers, count, task_rows):
    named = numbers.select(F.concat(F.lit("n"), "id").alias("name"), (F.col("id") % 3).alias("kind"), "a")
    pdf = named.toPandas()
    chosen = named.filter(top_rows(named, "a", "name", count, task_rows)).toPandas()
    assert set(chosen["name"]) == set(pdf.sort_values(["a", "name"], ascending=[False, True])["name"].head(count))
    chosen = named.filter(top_rows(named, "a", ["kind", "name"], count, task_rows)).toPandas()
    ordered = pdf.sort_values(["a", "kind", "name"], ascending=[False, True, True])
    assert set(chosen["name"]) == set(ordered["name"].head(count))


def test_top_rows_of_several_scores_take_the_same_passes(numbers):
    from flowsieve.operators.ordering import top_rows_of

    found = top_rows_of(numbers, {"a": 700, "b": 40}, "id", 10)
    for c, n in (("a", 700), ("b", 40)):
        assert numbers.filter(found[c]).count() == n
        assert {r.id for r in numbers.filter(found[c]).collect()} == {
            r.id for r in numbers.filter(top_rows(numbers, c, "id", n, 10)).collect()
        }
