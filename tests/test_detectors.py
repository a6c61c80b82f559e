import time
from pathlib import Path
from urllib.parse import urlparse

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowsieve.operators import ensemble, iforest, lof, recon
from flowsieve.operators.lof import local_outlier_factor
from flowsieve.session import scratch_folder, written

# The thirteen-point table, ten ordinary rows and three planted outliers.
POINTS = [
    (2, 150, 0.01), (3, 200, 0.02), (1, 180, 0.00), (4, 120, 0.03), (2, 170, 0.01),
    (3, 160, 0.02), (2, 190, 0.00), (1, 140, 0.01), (3, 210, 0.02), (2, 155, 0.01),
    (847, 190, 0.02), (3, 5000, 0.01), (2, 165, 0.97),
]
NAMES = ["n_dst_ports", "n_bytes_kb", "failed_ratio"]


@pytest.fixture(scope="module")
def toy(spark):
    rows = [(i, *map(float, p)) for i, p in enumerate(POINTS)]
    return spark.createDataFrame(rows, "id bigint, n_dst_ports double, n_bytes_kb double, failed_ratio double")


@pytest.fixture(scope="module")
def forest(toy):
    return iforest.fit_forest(toy, NAMES, ["id"], seed=7)


def test_planted_outliers_come_first(toy, forest):
    scored = forest.score(toy).orderBy(F.col("anomaly_score").desc()).toPandas()
    assert set(scored["id"].head(3)) == {10, 11, 12}
    assert len(scored) == 13 and scored["anomaly_score"].between(0, 1).all()


def test_forest_shape(forest):
    nodes = forest.nodes.toPandas()
    assert forest.sample_rows == 13 and forest.depth == 4
    assert nodes["tree"].nunique() == 200 and nodes["node"].max() < 32
    roots = nodes[nodes["node"] == 1]
    assert (roots["rows"] == 13).all()
    leaves = nodes[nodes["feature"].isna()]
    assert (leaves.groupby("tree")["rows"].sum() == 13).all()
    totals = iforest.split_counts(forest).toPandas().set_index("tree")
    assert totals.loc[totals.index.notna(), "splits"].sum() == len(nodes) - len(leaves)
    assert (totals[NAMES].sum(axis=1) == totals["splits"]).all()


def test_traced_depths_average_to_mean_depth(toy):
    small = iforest.fit_forest(toy, NAMES, ["id"], trees=3, seed=7)
    traced = [
        iforest.trace_paths(toy, small, t, ["id"]).select("id", "depth").toPandas() for t in range(3)
    ]
    mean = sum(t.set_index("id")["depth"] for t in traced) / 3
    found = small.mean_depth(toy, ["id"]).toPandas().set_index("id")["mean_depth"]
    assert np.allclose(mean.sort_index(), found.sort_index(), atol=1e-9)


def test_forest_does_not_depend_on_partitioning(spark):
    # 6,000 rows and 20 trees of 256 rows: disjoint blocks from one shuffle of the table.
    df = spark.range(6000).select("id", F.rand(3).alias("a"), F.randn(4).alias("b"))
    pdf = df.toPandas()
    results = []
    for parts in (1, 8):
        same = spark.createDataFrame(pdf).repartition(parts)
        fitted = iforest.fit_forest(same, ["a", "b"], ["id"], trees=20)
        assert fitted.nodes.filter("node = 1").select("rows").distinct().collect()[0][0] == 256
        scores = fitted.score(same, ["id"]).orderBy("id").toPandas()
        assert len(scores) == 6000
        results.append(scores["anomaly_score"].to_numpy())
    assert (results[0] == results[1]).all()


def test_flag_lowest_is_strict(spark):
    df = spark.createDataFrame([(float(i // 2),) for i in range(10)], "s double")
    flagged = df.filter(iforest.flag_lowest(df, "s", 0.25))
    assert sorted(r.s for r in flagged.collect()) == [0.0, 0.0]


def brute_lof(points, owner, k):
    """Factors by the definition; ties go to the row whose first copy has the lower id."""
    dist = np.sqrt(((points[:, None] - points[None]) ** 2).sum(-1))
    order = np.array(
        [
            [j for _, _, j in sorted((dist[i, j], owner[j], j) for j in range(len(points)) if j != i)][:k]
            for i in range(len(points))
        ]
    )
    near = np.take_along_axis(dist, order, 1)
    reach = np.maximum(near[:, -1][order], near)
    density = 1 / (reach.mean(1) + 1e-10)
    return density[order].mean(1) / density


@pytest.mark.parametrize("pivots, block_rows", [(None, 2048), (25, 2048), (9, 40)])
def test_lof_equals_brute_force(spark, pivots, block_rows):
    rng = np.random.default_rng(5)
    points = rng.normal(size=(300, 3)).round(1)
    # A third of all rows are copies of one row.
    points = np.vstack([points, np.tile(points[:1], (160, 1)), points[5:25]])
    first = {}
    owner = [first.setdefault(tuple(p), i) for i, p in enumerate(points)]
    rows = [(i, *map(float, p)) for i, p in enumerate(points)]
    df = spark.createDataFrame(rows, "id bigint, a double, b double, c double").repartition(5)
    found = local_outlier_factor(
        df, ["a", "b", "c"], "id", neighbours=20, pivots=pivots, block_rows=block_rows
    ).toPandas().sort_values("id")
    assert list(found["id"]) == list(range(len(points)))
    assert np.allclose(found["lof"], brute_lof(points, owner, 20), rtol=1e-9)


def test_lof_with_few_rows(spark):
    df = spark.createDataFrame([(1, 0.0), (2, 1.0), (3, 3.0)], "id bigint, a double")
    found = local_outlier_factor(df, ["a"], "id").orderBy("id").toPandas()
    points = np.array([[0.0], [1.0], [3.0]])
    assert np.allclose(found["lof"], brute_lof(points, [0, 1, 2], 2))


def test_reconstruction_error_equals_numpy(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(200, 8)) @ rng.normal(size=(8, 8))
    names = [f"x{i}" for i in range(8)]
    rows = [(i, i % 4 == 0, *map(float, v)) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, ["id", "bad", *names])
    detector = recon.fit_reconstruction(df.filter("not bad"), names)
    found = detector.score(df).orderBy("id").toPandas()["recon_error"].to_numpy()
    benign = x[[i for i in range(200) if i % 4]]
    mean = benign.mean(0)
    _, _, axes = np.linalg.svd(benign - mean, full_matrices=False)
    kept = axes[:2]
    rest = (x - mean) - (x - mean) @ kept.T @ kept
    assert np.allclose(found, (rest**2).mean(1), atol=1e-8)
    limit = recon.boundary(detector.score(df).filter("not bad"))
    assert np.isclose(limit, np.quantile((rest**2).mean(1)[[i for i in range(200) if i % 4]], 0.95))


def test_overlap_regions_sum_to_any(spark):
    df = spark.range(1000).select(
        "id", (F.col("id") % 3 == 0).cast("int").alias("y"),
        *[F.rand(s).alias(n) for s, n in enumerate(("a", "b", "c"))],
    )
    df = spark.createDataFrame(df.toPandas())
    for n in ("a", "b", "c"):
        df = ensemble.flag_top(df, n, "id", 0.4, f"{n}_flag")
        assert df.filter(f"{n}_flag = 1").count() == 400
    found = dict(ensemble.detector_overlap(df, ["a_flag", "b_flag", "c_flag"]).collect())
    caught = found.pop("any")
    assert sum(found.values()) == caught


def test_values_one_rounding_step_apart(spark):
    rows = [(i, 0.3 if i % 2 else 0.1 + 0.2) for i in range(8)]
    df = spark.createDataFrame(rows, "id bigint, a double")
    scored = iforest.fit_forest(df, ["a"], ["id"], trees=40).score(df)
    assert scored.count() == 8 and scored.filter("anomaly_score is null").isEmpty()


def test_nan_takes_the_same_way_in_score_and_trace(spark, toy):
    small = iforest.fit_forest(toy, NAMES, ["id"], trees=3, seed=7)
    nan = float("nan")
    odd = spark.createDataFrame(
        [(1, nan, 150.0, 0.01), (2, 2.0, nan, nan)], "id bigint, n_dst_ports double, n_bytes_kb double, failed_ratio double"
    )
    traced = [iforest.trace_paths(odd, small, t, ["id"]).select("id", "depth").toPandas() for t in range(3)]
    mean = sum(t.set_index("id")["depth"] for t in traced) / 3
    found = small.mean_depth(odd, ["id"]).toPandas().set_index("id")["mean_depth"]
    assert np.allclose(mean.sort_index(), found.sort_index(), atol=1e-9)


def test_rows_without_a_score_are_not_flagged(spark):
    df = spark.createDataFrame([(i, None if i < 4 else float(i)) for i in range(14)], "id bigint, s double")
    flags = {r.id: r.flag for r in ensemble.flag_top(df, "s", "id", 0.4).collect()}
    assert flags == {i: int(i >= 10) for i in range(14)}
    assert {r[0] for r in df.select(recon.flag_above(9.5, "s")).collect()} == {0, 1}


@pytest.mark.parametrize("pivots, first_level, block_rows", [(30, 4, 64), (16, 1, 32)])
def test_lof_with_two_levels_of_pivots(spark, pivots, first_level, block_rows):
    rng = np.random.default_rng(6)
    points = np.vstack([rng.normal(c, 0.3, size=(90, 2)).round(2) for c in (0, 5, 5.5, 40)])
    points = np.vstack([points, np.tile(points[:1], (100, 1))])
    first = {}
    owner = [first.setdefault(tuple(p), i) for i, p in enumerate(points)]
    df = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(points)], "id bigint, a double, b double")
    found = local_outlier_factor(
        df, ["a", "b"], "id", neighbours=10, pivots=pivots, block_rows=block_rows, first_level=first_level
    ).orderBy("id").toPandas()
    assert np.allclose(found["lof"], brute_lof(points, owner, 10), rtol=1e-9)


@pytest.mark.parametrize("first_level", [256, 4])
def test_the_bound_from_home_saves_visits(spark, first_level):
    rng = np.random.default_rng(7)
    rows = [(i, [float(x) for x in p], 1) for i, p in enumerate(rng.uniform(size=(1500, 3)))]
    folded = spark.createDataFrame(rows, "rep long, _x array<double>, weight long")
    k, pivots, block_rows = 5, 40, 150
    placed, groups, second = lof.into_cells(folded, k, pivots, block_rows, 42, first_level)
    none = spark.createDataFrame([], "rep long, bound double")
    through_pivots = lof.cells_to_visit(placed, groups, second, none, k, block_rows).count()
    home = placed.select("rep", "cell", F.lit(None).cast("double").alias("bound"))
    near = lof._nearest(lof._met(home, placed, k, block_rows), k)
    bounds = near.groupBy("rep").agg(F.max("dist").alias("bound"), F.sum("take").alias("n")).filter(F.col("n") == k)
    visits = lof.cells_to_visit(placed, groups, second, bounds.select("rep", "bound"), k, block_rows)
    assert "_x" not in visits.columns
    assert visits.count() < 0.7 * through_pivots


def test_cells_follow_the_rows(spark):
    rows = [(i, [float(i % 97), float(i // 97)], 1) for i in range(3000)]
    folded = spark.createDataFrame(rows, "rep long, _x array<double>, weight long")
    placed, groups, _ = lof.into_cells(folded, 3, 120, 100, 1, first_level=8)
    assert len(groups.ids) <= 11 and placed.select("cell").distinct().count() > 100


def curved_set(seed, n):
    """Benign rows on a ring, with a third feature that follows from the first two; in planted rows it
    has the other sign, so that every feature by itself and every two look the same."""
    rng = np.random.default_rng(seed)
    angle = rng.uniform(0, 2 * np.pi, n + n // 10)
    rows = np.stack([3 * np.cos(angle), 3 * np.sin(angle), np.cos(2 * angle)], axis=1) + rng.normal(0, 0.03, (len(angle), 3))
    rows[n:, 2] *= -1
    return [(i, int(i >= n), *map(float, r)) for i, r in enumerate(rows)]


def test_curved_reconstruction_finds_what_the_linear_one_cannot(spark):
    columns = ["a", "b 1", "c"]
    df = spark.createDataFrame(curved_set(1, 1000), "id bigint, y int, a double, `b 1` double, c double").repartition(4)
    benign = df.filter("y = 0")
    linear = recon.fit_reconstruction(benign, columns, 2).score(df)
    curved = recon.fit_curved_reconstruction(benign, columns).score(df)

    def caught(scored):
        limit = recon.boundary(scored.filter("y = 0"))
        return scored.filter((F.col("y") == 1) & (recon.flag_above(limit) == 1)).count() / 100

    assert caught(linear) < 0.2 and caught(curved) > 0.8


def test_curved_reconstruction_matches_numpy(spark):
    rows = curved_set(2, 300)
    columns = ["a", "b", "c"]
    df = spark.createDataFrame(rows, "id bigint, y int, a double, b double, c double").repartition(3)
    fitted = recon.fit_curved_reconstruction(df.filter("y = 0"), columns, components=4, cosine_count=20)
    points = np.array([r[2:] for r in rows])
    benign = points[[r[1] == 0 for r in rows]]
    scaled = (benign - benign.mean(0)) / benign.std(0)
    mapped = np.cos(scaled @ fitted.projections.T + fitted.shifts)
    held = (mapped - mapped.mean(0)) @ np.linalg.svd(mapped - mapped.mean(0))[2][:4].T
    inputs = np.hstack([held, np.ones((len(held), 1))])
    expected = ((scaled - inputs @ np.linalg.lstsq(inputs, scaled, rcond=None)[0]) ** 2).mean(1)
    found = {r.id: r.recon_error for r in fitted.score(df).collect()}
    assert np.allclose([found[r[0]] for r in rows if r[1] == 0], expected, rtol=1e-4, atol=1e-9)


def test_curved_reconstruction_edges(spark):
    df = spark.createDataFrame([(i, float(i % 5), 2.0, None if i == 3 else 1.0 * i) for i in range(30)], "id bigint, a double, flat double, c double")
    fitted = recon.fit_curved_reconstruction(df, ["a", "flat", "c"])
    found = {r.id: r.recon_error for r in fitted.score(df).collect()}
    assert found[3] is None and all(v is not None and v >= 0 for i, v in found.items() if i != 3)
    assert fitted.score(df.limit(0)).collect() == []
    with pytest.raises(ValueError, match="no benign rows"):
        recon.fit_curved_reconstruction(df.limit(0), ["a"])


def test_visits_are_never_broadcast(spark):
    """They compress to a few bytes a row, so that millions of them looked small to the planner."""
    rows = [(i, [float(i), 0.0], 1, i % 3) for i in range(60)]
    placed = written(spark.createDataFrame(rows, "rep long, _x array<double>, weight long, cell long"), "test-placed")
    visits = placed.select("rep", "cell", F.lit(None).cast("double").alias("bound"))
    text = lof._met(visits, placed, 2, 16)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin [rep" in text and "BroadcastHashJoin [rep" not in text


@pytest.mark.parametrize("scale", [1.0, 1e-3, 1e200])
def test_close_pairs_are_those_of_all_distances(scale):
    """Far from the origin, among equal points and where squares overflow, bounds known or not."""
    rng = np.random.default_rng(3)
    points, rows = (np.round(rng.normal(size=(n, 4)), 1) * scale + (1e6 if scale < 1 else 0) for n in (50, 90))
    points[:5] = rows[:5]
    bounds = np.where(rng.random(50) < 0.5, np.nan, rng.random(50) * 2 * scale)
    with np.errstate(over="ignore", invalid="ignore"):
        found = lof._close_pairs(points, rows, 7, bounds)
        dist = np.stack([lof._distances(points, row) for row in rows], axis=1)
    pairs = {(p, r): d for p, r, d in zip(*found)}
    for p in range(50):
        near = sorted(range(90), key=lambda r: (dist[p, r], r))[:7]
        wanted = [r for r in near if not dist[p, r] > bounds[p]]
        mine = sorted((r for q, r in pairs if q == p), key=lambda r: (dist[p, r], r))[:7]
        assert mine == wanted and all(pairs[p, r] == dist[p, r] for r in wanted)


@pytest.mark.parametrize("size,scale,offset", [(2, 1.0, 0.0), (10, 1e-3, 1e5)])
def test_planes_between_pivots_rule_out_no_near_row(size, scale, offset):
    """And more cells than half the difference of distances does."""
    rng = np.random.default_rng(5)
    rows = rng.normal(size=(600, size)) * scale + offset
    pivots, points = np.vstack([rows[:20], rows[:1]]), rows[300:]
    cells = np.stack([lof._distances(rows, p) for p in pivots], axis=1).argmin(axis=1)
    dist = np.stack([lof._distances(points, p) for p in pivots], axis=1)
    least = lof._behind_planes(dist, lof._apart(pivots))
    for cell in range(20):
        nearest = np.stack([lof._distances(points, r) for r in rows[cells == cell]]).min(axis=0)
        assert (least[:, cell] <= nearest * (1 + 1e-9) + 1e-12).all()
    assert least.mean() > 1.3 * ((dist - dist.min(axis=1, keepdims=True)) / 2).mean()


def kept_files(spark, since=()):
    """Bytes by shuffle file of this session."""
    env = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get()
    files = env.blockManager().diskBlockManager().getAllFiles().toList()
    found = [files.apply(i) for i in range(files.size())]
    found = {f.getPath(): f.length() for f in found if f.getName().startswith("shuffle") and f.getName().endswith("data")}
    return {f: n for f, n in found.items() if f not in since}


def scratch_tables(spark):
    top = Path(urlparse(scratch_folder(spark)).path)
    return {p for p in top.iterdir()} if top.exists() else set()


def test_lof_leaves_no_more_on_disk_than_the_rows(spark):
    """All cells are visited by all rows here: 200 bytes for each of 190 x 3000 visits were shuffled and stayed."""
    rng = np.random.default_rng(4)
    points = rng.uniform(size=(3000, 16))
    df = spark.createDataFrame([(i, [float(x) for x in p]) for i, p in enumerate(points)], "id bigint, x array<double>")
    files, tables = set(kept_files(spark)), scratch_tables(spark)
    found = local_outlier_factor(df, ["x"], "id", neighbours=10, block_rows=64).orderBy("id").toPandas()
    assert np.allclose(found["lof"], brute_lof(points, list(range(3000)), 10), rtol=1e-9)
    for _ in range(50):
        if sum(kept_files(spark, files).values()) < 4 * points.nbytes:
            break
        time.sleep(0.2)
    assert sum(kept_files(spark, files).values()) < 4 * points.nbytes
    left = {p.name.rsplit("-", 1)[0] for p in scratch_tables(spark) - tables}
    assert not left & {"lof-points", "lof-groups", "lof-cells", "lof-home", "lof-seen", "lof-visits", "lof-neighbours", "lof-density"}


@pytest.mark.parametrize("first_level", [256, 4])
def test_lof_in_portions_equals_brute_force(spark, monkeypatch, first_level):
    """Several groups, shares of one, and visits sent a few at a time; blocks of a part too."""
    rng = np.random.default_rng(9)
    points = np.vstack([rng.normal(c, 0.4, size=(n, 2)).round(2) for c, n in ((0, 150), (4, 60), (4.5, 60), (30, 40))])
    points = np.vstack([points, np.tile(points[:1], (30, 1))])
    first = {}
    owner = [first.setdefault(tuple(p), i) for i, p in enumerate(points)]
    df = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(points)], "id bigint, a double, b double")
    monkeypatch.setattr(lof, "PORTION_BYTES", 50_000)
    monkeypatch.setattr(lof, "PART_BLOCKS", 2)
    found = local_outlier_factor(df, ["a", "b"], "id", neighbours=7, pivots=24, block_rows=16, first_level=first_level)
    assert np.allclose(found.orderBy("id").toPandas()["lof"], brute_lof(points, owner, 7), rtol=1e-9)


def test_a_row_brings_k_neighbours_from_a_part(spark):
    """It brought as many from each of the part's cells."""
    rows = [(i, [float(i), 0.0], 1, i % 8) for i in range(80)]
    placed = written(spark.createDataFrame(rows, "rep long, _x array<double>, weight long, cell long"), "test-placed")
    visits = placed.filter("rep < 5").select("rep", F.explode(F.expr("sequence(0L, 7L)")).alias("cell"), F.lit(None).cast("double").alias("bound"))
    found = lof._met(visits, placed, 2, 16).toPandas()
    nearest = found.sort_values(["rep", "dist", "other"])
    assert nearest.groupby("rep")["other"].apply(list).to_dict() == {0: [1, 2], 1: [0, 2], 2: [1, 3], 3: [2, 4], 4: [3, 5]}


def test_bounds_by_ball_and_box_rule_out_no_near_row():
    rng = np.random.default_rng(8)
    for offset, scale in ((0.0, 1.0), (1e6, 1e-3), (0.0, 1e200)):
        rows, points = rng.normal(size=(40, 3)) * scale + offset, rng.normal(size=(200, 3)) * 3 * scale + offset
        with np.errstate(over="ignore", invalid="ignore"):
            nearest = np.stack([lof._distances(points, r) for r in rows]).min(axis=0)
        least = lof._least_distances(points, rows)
        assert not (least > nearest).any() and (scale > 1 or (least > 0).any())
