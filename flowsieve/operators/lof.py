"""Local outlier factor (Breunig et al. 2000) with exact nearest neighbours.

Neighbours are found by a pivot join (Lu et al. 2012) in two phases. Rows go to the cell of their
nearest pivot and look for k neighbours there first. The distance of the k-th is a bound: the triangle
inequality tells which other cells can hold a closer row, and only those are visited. No candidate
is dropped that could count, so the result is exact.

* Identical rows are folded into one with a weight, whatever their number.
* The number of cells follows the number of rows. Beyond ``FIRST_LEVEL`` of them pivots form a tree of
  two levels: rows choose among the square root of their number, and then among the pivots of
  that group, which are met by joining groups, not broadcast.
* Cells of a group that follow each other form a part. A part, or the visitors of a part, beyond
  ``PART_BLOCKS * block_rows`` are split into blocks. A task meets two blocks at a time, cell by cell, with
  bounds that shrink as nearer rows are found, and passes on k neighbours per visitor, never the pairs.
  Visits are lists of cells by row and part; vectors are joined to them afterwards, once a part.
* Rows look for their neighbours in portions, one after the other. What is shuffled for a portion, and
  the tables that only lead to the next, are removed at once: the disk in use follows the rows
  and not their visits, which in high dimensions grow with the square of the rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from flowsieve.functions.columns import SEED, quoted
from flowsieve.operators.ordering import hash_quota
from flowsieve.session import broadcast_if_small, drop_written, written_lean

NEIGHBOURS = 20
FIRST_LEVEL = 256
BLOCK_ROWS = 2048
VISIT_ROWS = 512
PAIRS = 65_536
PLANES = 4
# Blocks of rows in a part, a power of two.
PART_BLOCKS = 8
# Bytes aimed at of the rows of a portion with their neighbours, and of the vectors that are sent to parts at once;
# a quarter of the rows' bytes may be sent too, as each time all parts are.
PORTION_BYTES = 1 << 28
NEIGHBOUR_BYTES = 28
DENSITY_FLOOR = 1e-10


def local_outlier_factor(
    df: DataFrame,
    features: Sequence[str],
    id_column: str,
    neighbours: int = NEIGHBOURS,
    pivots: int | None = None,
    block_rows: int = BLOCK_ROWS,
    seed: int = SEED,
    first_level: int = FIRST_LEVEL,
) -> DataFrame:
    """(id, lof) per row, higher = more anomalous. One feature may be an array column."""
    points = df.select(F.col(quoted(id_column)).alias("_id"), _as_vector(df, features).alias("_x"))
    folded = written_lean(
        points.groupBy("_x").agg(F.min("_id").alias("rep"), F.count(F.lit(1)).alias("weight")),
        "lof-points",
    )
    sizes = folded.agg(F.count(F.lit(1)).alias("kinds"), F.sum("weight").alias("rows")).first()
    k = min(neighbours, (sizes.rows or 0) - 1)
    if k < 1:
        raise ValueError("at least two rows are needed")
    # Cells of about a quarter block, so that few of them need splitting.
    pivots = pivots or math.ceil(4 * sizes.kinds / block_rows)
    placed, groups, second = into_cells(folded, k, pivots, block_rows, seed, first_level)
    drop_written(folded)
    nearest = nearest_neighbours(placed, groups, second, k, block_rows)
    factors = density_ratios(nearest, k)
    drop_written(*nearest, *([] if second is None else [second]))
    if sizes.kinds == sizes.rows:
        drop_written(placed)
        return factors.withColumnRenamed("rep", id_column)
    owners = points.join(placed.select("_x", "rep"), "_x").select(F.col("_id").alias(id_column), "rep")
    return owners.join(factors, "rep").drop("rep")


def nearest_neighbours(
    placed: DataFrame, groups: Groups, second: DataFrame | None, k: int, block_rows: int
) -> list[DataFrame]:
    """(rep, other, dist, take): the k nearest rows of each kind of row, ``take`` copies each.

    Ties go to the lower id. The rows come from ``into_cells``. There is a written table for each portion
    of them, as portions are met one after the other.
    """
    width = 8 * groups.centres.shape[1] + 64
    nearest = []
    for portion in _portions(groups, PORTION_BYTES / (width + NEIGHBOUR_BYTES * (k + 1))):
        rows = placed.filter(portion).select("rep", "_x", F.col("cell").alias("home"), _part("cell").alias("part"))
        home = rows.filter(F.col("rep").isNotNull())
        home = home.withColumns({"cells": F.lit(None).cast("array<bigint>"), "bound": F.lit(None).cast("double")})
        near_home = written_lean(_met_parts(home, home, placed, k, block_rows), "lof-home")
        bounds = _nearest(near_home, k).groupBy("rep").agg(F.sum("take").alias("n"), F.max("dist").alias("bound"))
        bounds = bounds.filter(F.col("n") == k).select("rep", "bound")
        seen = written_lean(_groups_seen(rows, groups, bounds, k), "lof-seen")
        vectors = rows.select("rep", "_x")
        visited = F.col("groups") if second is not None else _parts_of("groups")
        shipped = width * (seen.agg(F.sum(F.size(visited))).first()[0] or 0)
        shares = max(1, math.ceil(shipped / max(PORTION_BYTES, width * groups.rows.sum() / 4)))
        for share in range(shares):
            ours = _share(shares, "visits") == share
            visits = _parts_to_visit(seen.filter(ours), vectors.filter(ours), second, block_rows)
            visits = visits.filter(F.col("part") != _part("home"))
            visits = written_lean(visits, "lof-visits")
            left = visits.hint("merge").join(vectors.filter(ours), "rep")
            found = _met_parts(left, visits, placed, k, block_rows)
            found = written_lean(_nearest(near_home.filter(ours).unionByName(found), k), "lof-neighbours")
            drop_written(visits)
            nearest.append(found if share == 0 else nearest.pop().unionByName(found))
        drop_written(near_home, seen)
    return nearest


def _share(shares: int, salt: str):
    return F.pmod(F.xxhash64(F.lit(salt), "rep"), F.lit(shares).cast("bigint"))


def _portions(groups: Groups, rows: float) -> list:
    """Conditions that deal the rows to portions: several groups with about ``rows`` rows, or a share of one."""
    portions, held, filled = [], [], 0
    for group, size in zip(groups.ids.tolist(), groups.rows.tolist()):
        if held and filled + size > rows:
            portions.append(F.col("group").isin(held))
            held, filled = [], 0
        if size > rows:
            shares = math.ceil(size / rows)
            portions += [(F.col("group") == group) & (_share(shares, "portion") == i) for i in range(shares)]
        else:
            held.append(group)
            filled += size
    return portions + ([F.col("group").isin(held)] if held else [])


@dataclass(frozen=True)
class Groups:
    """The first level of pivots, bounded by the square root of the number of cells: centres, radius,
    the k + 1 distances to the rows nearest to each, with their weights, and the number of rows."""

    ids: np.ndarray
    centres: np.ndarray
    radius: np.ndarray
    close: np.ndarray
    weight: np.ndarray
    rows: np.ndarray


def into_cells(
    folded: DataFrame, k: int, pivots: int, block_rows: int, seed: int, first_level: int
) -> tuple[DataFrame, Groups, DataFrame | None]:
    """Rows with their group, cell and distance to the cell's pivot (written), and both levels of pivots.

    The second level is (group, cell, _y, radius); None where each group is one cell.
    """
    first = pivots if pivots <= first_level else math.ceil(math.sqrt(pivots))
    chosen = hash_quota(folded.select("rep", "_x"), ["rep"], F.lit(first), seed=f"pivot:{seed}")
    centres = np.array([r._x for r in chosen.filter("taken").orderBy("rep").select("_x").collect()])
    grouped = folded.withColumn("_p", _nearest_pivot(centres)("_x")).select(
        "rep", "_x", "weight", F.col("_p.cell").cast("bigint").alias("group"), F.col("_p.dist").alias("to_group")
    )
    grouped = written_lean(grouped, "lof-groups")
    inner = W.partitionBy("group").orderBy("to_group", "rep")
    close = (
        grouped.select("group", "rep", "to_group", "weight")
        .withColumn("_r", F.row_number().over(inner))
        .filter(F.col("_r") <= k + 1)
        .groupBy("group")
        .agg(F.array_sort(F.collect_list(F.struct("to_group", "weight"))).alias("close"))
    )
    sizes = grouped.groupBy("group").agg(F.max("to_group").alias("radius"), F.count(F.lit(1)).alias("rows"))
    found = written_lean(sizes.join(close, "group"), "lof-sizes").collect()
    ids = np.array([r.group for r in found])
    distances, weights = np.full((len(found), k + 1), np.inf), np.zeros((len(found), k + 1))
    for i, r in enumerate(found):
        distances[i, : len(r.close)] = [c.to_group for c in r.close]
        weights[i, : len(r.close)] = [c.weight for c in r.close]
    radius, rows = np.array([r.radius for r in found]), np.array([r.rows for r in found])
    groups = Groups(ids, centres[ids], radius, distances, weights, rows)
    if first == pivots:
        placed = grouped.withColumns({"cell": F.col("group"), "to_pivot": F.col("to_group")})
        return placed, groups, None

    # Every group gets pivots in proportion to its rows.
    quota = F.ceil(F.col("group_rows") * 4 / F.lit(block_rows))
    second = hash_quota(grouped.select("rep", "_x", "group"), ["rep"], quota, by=["group"], seed=f"second:{seed}")
    numbered = F.row_number().over(W.partitionBy("group").orderBy("rep")) - 1
    second = second.filter("taken").select(
        "group", (F.col("group") * F.lit(1 << 32) + numbered).alias("cell"), F.col("_x").alias("_y")
    )
    chosen = written_lean(second, "lof-pivots")
    placed = _with_pivots(
        grouped.select("group", "rep", "_x", "weight", "to_group"), chosen, block_rows,
        _nearest_second, "rep long, _x array<double>, weight long, group long, to_group double, cell long, to_pivot double",
    )
    placed = written_lean(placed, "lof-cells")
    reach = placed.groupBy("cell").agg(F.max("to_pivot").alias("radius"))
    second = written_lean(chosen.join(reach, "cell"), "lof-reach")
    drop_written(grouped, chosen)
    return placed, groups, second


def cells_to_visit(
    placed: DataFrame, groups: Groups, second: DataFrame | None, bounds: DataFrame, k: int, block_rows: int
) -> DataFrame:
    """(rep, cell, bound): the cells besides its own in which a row may have one of its k nearest.

    ``bounds`` has a distance within which k rows are known, for rows that have found them at home.
    """
    rows = placed.select("rep", "_x", F.col("cell").alias("home"))
    seen = _groups_seen(rows, groups, bounds, k)
    visits = _parts_to_visit(seen, rows.select("rep", "_x"), second, block_rows)
    visits = visits.select("rep", "home", "bound", F.explode("cells").alias("cell"))
    return visits.filter(F.col("cell") != F.col("home")).select("rep", "cell", "bound")


def _groups_seen(rows: DataFrame, groups: Groups, bounds: DataFrame, k: int) -> DataFrame:
    """(rep, home, bound, groups) of rows (rep, _x, home): the groups that may hold one of the k nearest."""
    known = rows.select("rep", "_x", "home").join(bounds.hint("merge"), "rep", "left")
    seen = known.select("rep", "home", _groups_to_visit(groups, k)("_x", "bound").alias("v"))
    return seen.select("rep", "home", F.col("v.bound").alias("bound"), F.col("v.groups").alias("groups"))


def _parts_to_visit(seen: DataFrame, vectors: DataFrame, second: DataFrame | None, block_rows: int) -> DataFrame:
    """(rep, home, bound, part, cells): the cells to be visited, as one list for each part that has any."""
    if second is None:
        parts = F.explode(_parts_of("groups")).alias("part")
        visits = seen.select("rep", "home", "bound", "groups", parts)
        cells = F.filter("groups", lambda g: _part(g) == F.col("part"))
        return visits.select("rep", "home", "bound", "part", cells.alias("cells"))
    rows = seen.hint("merge").join(vectors, "rep")
    rows = rows.select("rep", "_x", "home", "bound", F.explode("groups").alias("group"))
    return _with_pivots(
        rows, second.withColumn("part", _part("cell")), block_rows,
        _second_to_visit, "rep long, home long, bound double, part long, cells array<long>",
    )


def _parts_of(cells: str):
    return F.array_distinct(F.transform(cells, _part))


def _part(cell):
    """Cells with next numbers of a group form a part, of about ``PART_BLOCKS`` blocks of rows."""
    cell = F.col(cell) if isinstance(cell, str) else cell
    number = F.shiftright(cell.bitwiseAND((1 << 32) - 1), int(math.log2(4 * PART_BLOCKS)))
    return F.shiftright(cell, 32) * F.lit(1 << 32) + number


def _with_pivots(rows: DataFrame, second: DataFrame, block_rows: int, meet: Callable, schema: str) -> DataFrame:
    """Rows of each group, in blocks, next to the pivots of the group."""
    blocks = rows.groupBy("group").agg(F.ceil(F.count(F.lit(1)) / (8 * block_rows)).cast("int").alias("blocks"))
    blocks = broadcast_if_small(written_lean(blocks, "lof-blocks"))
    part = F.pmod(F.xxhash64("rep"), F.col("blocks").cast("bigint")).cast("int")
    left = rows.join(blocks, "group").withColumn("block", part).drop("blocks")
    right = second.join(blocks, "group").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return left.groupBy("group", "block").cogroup(right.drop("blocks").groupBy("group", "block")).applyInPandas(meet, schema)


def _nearest_second(rows: pd.DataFrame, pivots: pd.DataFrame) -> pd.DataFrame:
    points = np.stack(rows["_x"].to_numpy()) if len(rows) else np.zeros((0, 1))
    cell, best = np.zeros(len(rows), np.int64), np.full(len(rows), np.inf)
    for name, pivot in zip(pivots["cell"], pivots["_y"]):
        dist = _distances(points, pivot)
        closer = dist < best
        cell[closer], best[closer] = name, dist[closer]
    kept = rows[["rep", "_x", "weight", "group", "to_group"]]
    return kept.assign(cell=cell, to_pivot=best)


def _second_to_visit(rows: pd.DataFrame, pivots: pd.DataFrame) -> pd.DataFrame:
    columns = ["rep", "home", "bound", "part", "cells"]
    if not len(rows) or not len(pivots):
        return pd.DataFrame({c: [] for c in columns})
    pivots = pivots.sort_values("cell")
    centres, names, radius = np.stack(pivots["_y"].to_numpy()), pivots["cell"].to_numpy(), pivots["radius"].to_numpy()
    parts = pivots["part"].to_numpy()
    apart, found = _apart(centres), []
    for at in range(0, len(rows), VISIT_ROWS):
        part = rows.iloc[at : at + VISIT_ROWS]
        points = np.stack(part["_x"].to_numpy())
        dist = np.stack([_distances(points, c) for c in centres], axis=1)
        least = np.fmax(dist - radius[None, :], _behind_planes(dist, apart))
        row, pivot = np.nonzero(least <= part["bound"].to_numpy()[:, None])
        if len(row):
            first = np.flatnonzero((np.diff(row, prepend=-1) != 0) | (np.diff(parts[pivot], prepend=-1) != 0))
            lists = pd.Series(np.split(names[pivot], first[1:]), dtype=object).to_numpy()
            found.append(part[["rep", "home", "bound"]].iloc[row[first]].assign(part=parts[pivot[first]], cells=lists))
    return pd.concat(found)[columns] if found else pd.DataFrame({c: [] for c in columns})


def _met(visits: DataFrame, placed: DataFrame, k: int, block_rows: int) -> DataFrame:
    """(rep, other, dist, weight): of the cells that a row visits (rep, cell, bound), up to k + 1 rows of each part."""
    lists = visits.groupBy("rep", _part("cell").alias("part")).agg(
        F.collect_list("cell").alias("cells"), F.min("bound").alias("bound")
    )
    # Visits are many, but compress so well that the planner would broadcast them.
    left = lists.hint("merge").join(placed.select("rep", "_x", F.col("cell").alias("home")), "rep")
    return _met_parts(left, lists, placed, k, block_rows)


def _met_parts(left: DataFrame, visits: DataFrame, placed: DataFrame, k: int, block_rows: int) -> DataFrame:
    """(rep, other, dist, weight): up to k + 1 rows for each visit of a row to a part.

    ``left`` has (rep, _x, home, part, cells, bound), ``cells`` NULL for all of the part, and ``visits`` its parts.
    A vector goes to a part once, whatever the number of cells that it visits there.
    """
    # Both sides come from one table; new names tell the members' columns from the visitors'.
    members = placed.select(*[F.col(c).alias(c) for c in ("rep", "_x", "weight", "cell")])
    members = members.withColumn("part", _part("cell"))
    rows = PART_BLOCKS * block_rows
    blocks = (
        visits.groupBy("part")
        .agg(F.count(F.lit(1)).alias("visitors"))
        .join(members.groupBy("part").agg(F.count(F.lit(1)).alias("members")), "part")
        .select(
            "part",
            F.ceil(F.col("visitors") / rows).cast("int").alias("visitor_blocks"),
            F.ceil(F.col("members") / rows).cast("int").alias("member_blocks"),
        )
    )
    blocks = broadcast_if_small(written_lean(blocks, "lof-blocks"))
    keys = ["part", "vb", "mb"]
    left = left.select("rep", "_x", "home", "part", "cells", "bound")
    left = _into_blocks(left, blocks, "vb", "visitor_blocks", "mb", "member_blocks")
    right = _into_blocks(members, blocks, "mb", "member_blocks", "vb", "visitor_blocks")
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(
        _block_neighbours(k, block_rows), "rep bigint, other bigint, dist double, weight bigint"
    )


def _nearest(best: DataFrame, k: int) -> DataFrame:
    """The first k copies of each row's neighbours, the nearest first, lower ids first on ties."""
    order = W.partitionBy("rep").orderBy("dist", "other")
    before = F.coalesce(F.sum("weight").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return (
        best.withColumn("_before", before)
        .filter(F.col("_before") < k)
        .select("rep", "other", "dist", F.least("weight", F.lit(k) - F.col("_before")).alias("take"))
    )


def density_ratios(nearest: Sequence[DataFrame], k: int) -> DataFrame:
    """(rep, lof) from neighbour lists: mean density of the neighbours over the own density.

    The lists come as written tables, which are joined one after the other.
    """
    reach = reduce(DataFrame.unionByName, nearest).groupBy(F.col("rep").alias("other")).agg(F.max("dist").alias("k_dist"))
    reach = written_lean(reach, "lof-k-distances")
    mean_reach = F.sum(F.col("take") * F.greatest("k_dist", "dist")) / k
    densities = [
        written_lean(
            portion.join(reach.hint("merge"), "other")
            .groupBy("rep")
            .agg((1.0 / (mean_reach + F.lit(DENSITY_FLOOR))).alias("density")),
            "lof-density",
        )
        for portion in nearest
    ]
    others = reduce(DataFrame.unionByName, densities)
    others = others.select(F.col("rep").alias("other"), F.col("density").alias("_other_density")).hint("merge")
    mean_density = F.sum(F.col("take") * F.col("_other_density")) / k
    factors = []
    for portion, density in zip(nearest, densities):
        around = portion.join(others, "other").groupBy("rep").agg(mean_density.alias("_mean_density"))
        ratio = F.col("_mean_density") / F.col("density")
        factors.append(written_lean(around.join(density, "rep").select("rep", ratio.alias("lof")), "lof-factors"))
    drop_written(reach, *densities)
    return reduce(DataFrame.unionByName, factors)


def _as_vector(df: DataFrame, features: Sequence[str]):
    if len(features) == 1 and df.schema[features[0]].dataType.typeName() == "array":
        return F.col(quoted(features[0])).cast("array<double>")
    return F.array(*[F.col(quoted(f)).cast("double") for f in features])


def _into_blocks(
    df: DataFrame, blocks: DataFrame, own: str, own_blocks: str, other: str, other_blocks: str
) -> DataFrame:
    """Hash rows into their side's blocks of the part, once for every block of the other side."""
    part = F.pmod(F.xxhash64("rep"), F.col(own_blocks).cast("bigint")).cast("int")
    return (
        df.join(blocks, "part")
        .withColumn(own, part)
        .withColumn(other, F.explode(F.sequence(F.lit(0), F.col(other_blocks) - 1)))
        .drop(own_blocks, other_blocks)
    )


def _distances(rows: np.ndarray, point: np.ndarray) -> np.ndarray:
    return np.sqrt(((rows - point) ** 2).sum(axis=1))


def _apart(centres: np.ndarray) -> np.ndarray:
    return np.stack([_distances(centres, c) for c in centres])


def _behind_planes(dist: np.ndarray, apart: np.ndarray) -> np.ndarray:
    """Lower bounds on the distance from points to any row of each pivot, none of which is nearer to another.

    Such rows lie behind the planes midway between their pivot and others; those to the ``PLANES`` pivots
    nearest to a point are tried. ``dist`` is from points to pivots, ``apart`` from pivots to each other.
    """
    least = np.full(dist.shape, -np.inf)
    near = np.argsort(dist, axis=1)[:, :PLANES]
    for j in range(near.shape[1]):
        own, between = np.take_along_axis(dist, near[:, [j]], 1), apart[near[:, j]]
        with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
            plane = (dist - own) * ((dist + own) / (2 * between)) - 1e-9 * dist
            # Between pivots that lie close together the plane is not sure enough.
            least = np.fmax(least, np.where(between > 1e-4 * dist, plane, (dist - own) / 2))
    return least


def _close_pairs(
    points: np.ndarray, rows: np.ndarray, few: int, bounds: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(point, row, distance) of pairs that hold the ``few`` nearest rows of each point, ties included.

    What is farther than a point's bound, NaN for none, is left out. One matrix product gives squared
    distances less more than their rounding; pairs that may count after it are measured as they are.
    """
    share = 8 * (rows.shape[1] + 4) * np.finfo(float).eps
    squares, others = (points**2).sum(axis=1), (rows**2).sum(axis=1)
    left = np.column_stack([-2 * points, (1 - share) * squares, np.ones(len(points))])
    least = left @ np.column_stack([rows, np.ones(len(rows)), (1 - share) * others]).T
    if np.isfinite(least).all():
        tiny = np.finfo(float).tiny
        last = np.where(np.isnan(bounds), np.inf, bounds**2 * (1 + share) + tiny)
        near = least <= last[:, None]
        many = np.flatnonzero(near.sum(axis=1) > 2 * few)
        if len(many):
            found = np.partition(least[many], few - 1, axis=1)[:, few - 1]
            last = np.minimum(last[many], found + 3 * share * (squares[many] + others.max()) + tiny)
            near[many] = least[many] <= last[:, None]
        point, row = np.nonzero(near)
        # Pairs are measured in portions, as many points may be at one distance of many rows.
        portions = [slice(i, i + PAIRS) for i in range(0, len(point), PAIRS)]
        dist = [np.sqrt(((points[point[i]] - rows[row[i]]) ** 2).sum(axis=1)) for i in portions]
        dist = np.concatenate([np.zeros(0), *dist])
    else:
        # Values too large to be squared and summed, or no numbers.
        dist = np.stack([_distances(points, row) for row in rows], axis=1)
        point, row = np.nonzero(dist <= np.partition(dist, few - 1, axis=1)[:, few - 1 : few])
        dist = dist[point, row]
    kept = ~(dist > bounds[point])
    return point[kept], row[kept], dist[kept]


def _nearest_pivot(centres: np.ndarray) -> Callable:
    @F.pandas_udf("cell int, dist double")
    def place(x: pd.Series) -> pd.DataFrame:
        rows = np.stack(x.to_numpy())
        cell = np.zeros(len(rows), dtype=np.int32)
        best = np.full(len(rows), np.inf)
        for i, centre in enumerate(centres):
            dist = _distances(rows, centre)
            closer = dist < best
            cell[closer], best[closer] = i, dist[closer]
        return pd.DataFrame({"cell": cell, "dist": best})

    return place


def _groups_to_visit(groups: Groups, k: int) -> Callable:
    """A row's bound, and the groups that may hold one of its k nearest neighbours."""
    few = min(4, len(groups.ids))
    apart = _apart(groups.centres)

    @F.pandas_udf("bound double, groups array<long>")
    def visit(x: pd.Series, bound: pd.Series) -> pd.DataFrame:
        # Rows times pivots distances are held at a time, so batches are cut up.
        parts = [slice(at, at + VISIT_ROWS) for at in range(0, len(x), VISIT_ROWS)]
        found = [visits(x.iloc[part], bound.iloc[part].to_numpy(dtype=float, na_value=np.nan)) for part in parts]
        return pd.concat(found, ignore_index=True) if found else pd.DataFrame({"bound": [], "groups": []})

    def visits(x: pd.Series, known: np.ndarray) -> pd.DataFrame:
        rows = np.stack(x.to_numpy())
        dist = np.stack([_distances(rows, c) for c in groups.centres], axis=1)
        near = np.argsort(dist, axis=1)[:, :few]
        # Through a pivot: at least k rows besides the own one lie within this distance.
        at_most = (np.take_along_axis(dist, near, 1)[:, :, None] + groups.close[near]).reshape(len(rows), -1)
        order = np.argsort(at_most, axis=1)
        weight = np.cumsum(np.take_along_axis(groups.weight[near].reshape(len(rows), -1), order, 1), axis=1)
        through = np.full(len(rows), np.inf)
        enough = weight[:, -1] >= k + 1
        first = (weight >= k + 1).argmax(axis=1)
        through[enough] = np.take_along_axis(at_most, order, 1)[enough, first[enough]]
        # The slack covers rounding.
        bound = np.fmin(known, through) * (1 + 1e-9) + 1e-12
        # Both are lower bounds on the distance to any row of the group.
        least = np.fmax(dist - groups.radius[None, :], _behind_planes(dist, apart))
        return pd.DataFrame({"bound": bound, "groups": [groups.ids[kept].tolist() for kept in least <= bound[:, None]]})

    return visit


def _least_distances(points: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Lower bounds on the distance from points to any of the rows, by their ball and their box."""
    with np.errstate(over="ignore", invalid="ignore"):
        centre = rows.mean(axis=0)
        dist = _distances(points, centre)
        ball = dist * (1 - 1e-9) - _distances(rows, centre).max() * (1 + 1e-9)
        outside = np.fmax(np.fmax(rows.min(axis=0) - points, points - rows.max(axis=0)), 0)
        return np.fmax(ball, np.sqrt((outside**2).sum(axis=1)) * (1 - 1e-9))


def _block_neighbours(k: int, block_rows: int) -> Callable:
    few = k + 1

    def meet(visitors: pd.DataFrame, members: pd.DataFrame) -> pd.DataFrame:
        if visitors.empty or members.empty:
            return pd.DataFrame({"rep": [], "other": [], "dist": [], "weight": []})
        members = members.sort_values(["cell", "rep"])
        ids, rows = members["rep"].to_numpy(), np.stack(members["_x"].to_numpy())
        weights, cells = members["weight"].to_numpy(), members["cell"].to_numpy()
        visitors = visitors.sort_values("home")
        # A cell's rows, in pieces of a block at most.
        starts = np.flatnonzero(np.diff(cells, prepend=cells[0] - 1))
        pieces = [
            (cells[start], slice(at, min(at + block_rows, end)))
            for start, end in zip(starts, [*starts[1:], len(cells)])
            for at in range(start, end, block_rows)
        ]
        found = [neighbours(visitors.iloc[at : at + block_rows], ids, rows, pieces) for at in range(0, len(visitors), block_rows)]
        rep, member, near = (np.concatenate(c) for c in zip(*found))
        # One entry may be the row itself, which is left out or has one copy less.
        weight = weights[member] - (ids[member] == rep)
        result = pd.DataFrame({"rep": rep, "other": ids[member], "dist": near, "weight": weight})
        return result[result["weight"] > 0]

    def neighbours(visitors: pd.DataFrame, ids: np.ndarray, rows: np.ndarray, pieces: list) -> tuple:
        """(rep, member, distance) of the ``few`` nearest rows of each visitor, lower ids first on ties."""
        reps, points, home = visitors["rep"].to_numpy(), np.stack(visitors["_x"].to_numpy()), visitors["home"].to_numpy()
        bounds = visitors["bound"].to_numpy(dtype=float, na_value=np.nan, copy=True)
        every = visitors["cells"].isna().to_numpy()
        lists = [[] if all_cells else cells for all_cells, cells in zip(every, visitors["cells"])]
        listed = np.concatenate([np.asarray(c, np.int64) for c in lists])
        of = np.repeat(np.arange(len(reps)), [len(c) for c in lists])
        best = np.full((len(reps), few), np.inf)
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        # The own cell tells most about the bound, so that of other cells little is left to look at.
        for at_home in (True, False):
            for cell, piece in pieces:
                visit = every.copy()
                visit[of[listed == cell]] = True
                who = np.flatnonzero(visit & ((home == cell) == at_home))
                if len(who):
                    who = who[~(_least_distances(points[who], rows[piece]) > bounds[who])]
                if not len(who):
                    continue
                # What is farther than k rows that are known cannot count.
                visitor, member, near = _close_pairs(points[who], rows[piece], min(few, piece.stop - piece.start), bounds[who])
                visitor, member, near, place = first_of(visitor, member, near, ids[piece])
                found.append((who[visitor], member + piece.start, near))
                nearer = np.full((len(who), few), np.inf)
                nearer[visitor, place] = near
                best[who] = np.sort(np.concatenate([best[who], nearer], axis=1), axis=1)[:, :few]
                bounds[who] = np.fmin(bounds[who], best[who, -1])
        visitor, member, near = (np.concatenate(c) for c in zip(*found))
        kept = ~(near > bounds[visitor])
        visitor, member, near = visitor[kept], member[kept], near[kept]
        visitor, member, near, _ = first_of(visitor, member, near, ids)
        return reps[visitor], member, near

    def first_of(visitor: np.ndarray, member: np.ndarray, near: np.ndarray, ids: np.ndarray) -> tuple:
        order = np.lexsort((ids[member], near, visitor))
        visitor, member, near = visitor[order], member[order], near[order]
        place = np.arange(len(visitor)) - np.searchsorted(visitor, visitor)
        kept = place < few
        return visitor[kept], member[kept], near[kept], place[kept]

    return meet
