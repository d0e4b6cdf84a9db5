"""Exact nearest neighbours and core distances between unit vectors.

Identical vectors are first folded into one point with a multiplicity, so a crowd of copies costs one
row.  Points are then assigned to the nearest of a bounded set of pivots, each pivot's cell is split
by hash into blocks of bounded size, and consecutive blocks make up a bounded number of parts.  A part first
searches itself; the distance found bounds what any other part could add, and the triangle inequality over
pivots leaves out the cells that cannot.  What crosses the shuffle is points, once per part, and k rows per
point and part; pairs of points exist only inside a task's distance matrices, which are of bounded size.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foldwise.functions.vectors import GRID, grid_distance, grid_vector
from foldwise.session import materialise, spread

#: Upper bounds: pivots, bytes of a small vector table held by the driver and every task, bytes of one
#: block of vectors, and rows of a block (two blocks meet in one distance matrix).
MAX_PIVOTS = 1024
SMALL_TABLE_BYTES = 16 << 20
BLOCK_BYTES = 32 << 20
BLOCK_ROWS = 2048
#: Parts that all points are dealt into, unless a part would then have more than ``BLOCK_BYTES``; each part meets each other
#: one in a task, so what crosses the shuffle grows with the points.  Rows and columns of a distance matrix there.
PARTS = 16
TILE_ROWS = 256
TILE_COLUMNS = 1024


@dataclass
class Blocks:
    """Points laid out in blocks.

    ``points``: (part, cell, block, pos, copies, grid, away), ``away`` being the distance to the cell's pivot; a part holds
    consecutive blocks.  ``low`` bounds the distance between points of two cells from below, ``cell_of`` is the cell of each
    block, ``total`` counts all rows including copies.
    """

    points: DataFrame
    low: np.ndarray
    cell_of: np.ndarray
    parts: int
    total: int
    dim: int

    @property
    def count(self) -> int:
        return len(self.cell_of)


def matrix(column: pa.ChunkedArray) -> np.ndarray:
    """List column of equal lengths as a float64 matrix."""
    joined = column.combine_chunks()
    flat = joined.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(joined), -1)


def fold_copies(points: DataFrame) -> DataFrame:
    """(pos, copies, grid): one row per distinct unit vector, named by its smallest position."""
    on_grid = points.select("pos", F.transform(grid_vector(F.col("vector")), lambda x: x.cast("int")).alias("grid"))
    return on_grid.groupBy("grid").agg(F.min("pos").alias("pos"), F.count("*").alias("copies"))


def copies_of(points: DataFrame, folded: DataFrame) -> DataFrame:
    """(pos, rep) of the rows that were folded into another one."""
    crowds = folded.where(F.col("copies") > 1).select("grid", F.col("pos").alias("rep"))
    on_grid = points.select("pos", F.transform(grid_vector(F.col("vector")), lambda x: x.cast("int")).alias("grid"))
    return on_grid.join(crowds, "grid").where(F.col("pos") != F.col("rep")).select("pos", "rep")


def lay_out(folded: DataFrame, block_rows: int | None = None) -> Blocks:
    """Assign distinct points to cells and blocks.  The pivots only steer the work, never the result."""
    facts = folded.agg(
        F.count("*").alias("n"), F.sum("copies").alias("total"), F.max(F.size("grid")).alias("dim"),
        F.min(F.size("grid")).alias("least"),
    ).first()
    n, dim = facts.n, facts.dim or 1
    if facts.n and facts.least != facts.dim:
        raise ValueError(f"vectors of different dimensions: {facts.least} and {facts.dim}")
    rows = block_rows or max(64, min(BLOCK_ROWS, BLOCK_BYTES // (8 * dim)))
    wanted = max(1, min(MAX_PIVOTS, -(-n // rows), SMALL_TABLE_BYTES // (8 * dim)))
    if wanted == 1:
        placed = folded.select(F.lit(0).alias("cell"), "pos", "copies", "grid", F.lit(2.0).alias("away"))
        pivots = np.zeros((1, dim))
    else:
        sample = folded.orderBy(F.xxhash64("pos"), "pos").limit(wanted).select("grid").collect()
        pivots = np.array([r.grid for r in sample], dtype=np.float64)

        def assign(batches):
            for batch in batches:
                table = pa.Table.from_batches([batch])
                if len(table) == 0:
                    continue
                away = grid_distance(matrix(table["grid"]), pivots)
                cell = away.argmin(axis=1)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(cell.astype(np.int32)),
                        batch.column("pos"),
                        batch.column("copies"),
                        batch.column("grid"),
                        pa.array(away[np.arange(len(cell)), cell]),
                    ],
                    names=["cell", "pos", "copies", "grid", "away"],
                )

        placed = folded.select("pos", "copies", "grid").mapInArrow(
            assign, "cell int, pos bigint, copies bigint, grid array<int>, away double"
        )
    placed = materialise(placed)
    sizes, radius = np.zeros(len(pivots), dtype=np.int64), np.zeros(len(pivots))
    for row in placed.groupBy("cell").agg(F.count("*").alias("n"), F.max("away").alias("away")).collect():  # one row per pivot
        sizes[row.cell], radius[row.cell] = row.n, row.away
    splits = np.maximum(1, -(-sizes // rows))
    first, before = (np.concatenate(([0], np.cumsum(x)[:-1])) for x in (splits, sizes))
    parts = int(max(1, min(splits.sum(), max(PARTS, -(-n * dim * 4 // BLOCK_BYTES)))))
    table = placed.sparkSession.createDataFrame(
        [(c, int(splits[c]), int(first[c]), int(before[c]), int(sizes[c])) for c in range(len(pivots))],
        "cell int, splits int, first int, before bigint, size bigint",
    )
    split = F.pmod(F.xxhash64("pos"), F.col("splits"))
    middle = F.col("before") + (split + 0.5) * F.col("size") / F.col("splits")
    points = placed.join(F.broadcast(table), "cell").select(
        F.least(F.lit(parts - 1), F.floor(middle * F.lit(parts / max(1, n)))).cast("int").alias("part"),
        "cell", (F.col("first") + split).cast("int").alias("block"), "pos", "copies", "grid", "away",
    )
    cell_of = np.repeat(np.arange(len(pivots)), splits)
    low = np.maximum(0.0, grid_distance(pivots, pivots) - radius[:, None] - radius[None, :])
    np.fill_diagonal(low, 0.0)
    return Blocks(points, low, cell_of, parts, int(facts.total or 0), dim)


FOUND = "pos bigint, nbr bigint, dist double, nbr_copies bigint, reach double"
NOTHING_FOUND = pa.table({"pos": pa.array([], pa.int64()), "nbr": pa.array([], pa.int64()), "dist": pa.array([], pa.float64()), "nbr_copies": pa.array([], pa.int64()), "reach": pa.array([], pa.float64())})


class Side:
    """Rows of one part in a task, ordered by cell and position."""

    def __init__(self, table: pa.Table) -> None:
        table = table.sort_by([("cell", "ascending"), ("pos", "ascending")])
        self.pos, self.cell, self.grid = table["pos"].to_numpy(), table["cell"].to_numpy(), matrix(table["grid"])
        self.own = np.einsum("ij,ij->i", self.grid, self.grid)
        self.table = table
        starts = np.flatnonzero(np.r_[len(self.cell) > 0, np.diff(self.cell) != 0])
        self.cells, self.starts, self.ends = self.cell[starts], starts, np.r_[starts[1:], len(self.cell)].astype(np.int64)

    def column(self, name: str) -> np.ndarray:
        return self.table[name].to_numpy()


def tiles(here: Side, there: Side, low: np.ndarray):
    """(rows, list of (columns, lower bound)) over tiles of bounded size; columns of the nearest cells come first."""
    for first in range(0, len(here.pos), TILE_ROWS):
        rows = slice(first, first + TILE_ROWS)
        bounds = low[np.ix_(np.unique(here.cell[rows]), there.cells)].min(axis=0)
        order = np.argsort(bounds, kind="stable")
        columns = np.concatenate([np.arange(there.starts[k], there.ends[k]) for k in order] or [np.arange(0)])
        bound = np.repeat(bounds[order], (there.ends - there.starts)[order])
        yield rows, [(columns[k : k + TILE_COLUMNS], bound[k]) for k in range(0, len(columns), TILE_COLUMNS)]


def halved(here: Side, rows: slice, there: Side, columns: np.ndarray) -> np.ndarray:
    """x·y - y·y/2 of a tile; the square of the distance is x·x minus twice that."""
    near = here.grid[rows] @ there.grid[columns].T
    near -= there.own[columns][None, :] / 2
    return near


def least_halved(own: np.ndarray, reach: np.ndarray) -> np.ndarray:
    """What ``halved`` is at least where the distance is no larger than the reach, with a guard for rounding."""
    return (own - (np.square(reach * GRID) * (1 + 1e-12) + 4)) / 2


def distances_at(here: Side, i: np.ndarray, there: Side, j: np.ndarray) -> np.ndarray:
    """The distances of single pairs, as ``grid_distance`` gives them."""
    cross = np.einsum("ij,ij->i", here.grid[i], there.grid[j])
    square = (here.own[i] - cross) + (there.own[j] - cross)
    return np.sqrt(np.maximum(square, 0.0)) / GRID


def _nearest(here: Side, there: Side, reach: np.ndarray, k: int, low: np.ndarray) -> pa.Table:
    """The k nearest of ``there`` within the reach of each row; where both are one side, a row isn't its own neighbour."""
    found = []
    copies = there.column("copies")
    for rows, parts in tiles(here, there, low):
        first, size = rows.start, len(here.pos[rows])
        limit = reach[rows].copy()
        dist, nbr = np.full((size, k), np.inf), np.full((size, k), -1)
        for columns, bound in parts:
            if bound - 1e-9 > limit.max():
                break
            near = halved(here, rows, there, columns)
            least = least_halved(here.own[rows], limit)
            unbound = np.isinf(limit)
            if unbound.any() and len(columns) > k + 1:
                kept = np.partition(near[unbound], len(columns) - k - 1, axis=1)[:, len(columns) - k - 1]
                least[unbound] = kept - 4
            i, c = np.nonzero(near >= least[:, None])
            j = columns[c]
            if here is there:
                other = first + i != j
                i, j = i[other], j[other]
            d = distances_at(here, first + i, there, j)
            near_enough = d <= limit[i]
            i, j, d = i[near_enough], j[near_enough], d[near_enough]
            touched = np.unique(i)
            held = nbr[touched].ravel()
            of, at, value = np.r_[i, np.repeat(touched, k)], np.r_[j, held], np.r_[d, dist[touched].ravel()]
            order = np.lexsort((np.where(at < 0, np.iinfo(np.int64).max, there.pos[at]), value, of))
            best = order[np.searchsorted(of[order], touched)[:, None] + np.arange(k)]
            dist[touched], nbr[touched] = value[best], at[best]
            limit = np.minimum(limit, dist[:, -1])
        i, c = np.nonzero(nbr >= 0)
        j = nbr[i, c]
        found.append((here.pos[first + i], there.pos[j], dist[i, c], copies[j], limit[i]))
        if here is there:
            # A point without a neighbour still has to report that its reach is unbounded.
            alone = np.flatnonzero((nbr < 0).all(axis=1))
            found.append((here.pos[first + alone], np.full(len(alone), -1), np.full(len(alone), np.nan), np.full(len(alone), 0), limit[alone]))
    pos, nbr, dist, n, limit = (np.concatenate(c) for c in zip(*found)) if found else (np.arange(0),) * 5
    none = np.isnan(dist.astype(float))
    return pa.table(
        {"pos": pa.array(pos, pa.int64()), "nbr": pa.array(nbr, pa.int64(), mask=none), "dist": pa.array(dist, pa.float64(), mask=none),
         "nbr_copies": pa.array(n, pa.int64(), mask=none), "reach": pa.array(limit, pa.float64())}
    )


def meet(queries: DataFrame, groups: int, points: DataFrame, parts: int, run, schema: str, apart: bool = False) -> DataFrame:
    """``run(queries, points)`` for each group ``i`` of queries and each part ``j`` of points; ``apart``: where i isn't j.

    A query crosses the shuffle once for each part and a point once for each group, whatever the number of blocks.
    """
    here = queries.withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    # Cogroups of two tables from one source mix up columns that they share, so one side gets columns of its own.
    there = points.select(*[F.col(c).alias(f"{c}_") for c in points.columns]).withColumn("i_", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    if apart:
        here, there = here.where("i <> j"), there.where("i_ <> j_")
    pairs = groups * parts

    def renamed(here: pa.Table, there: pa.Table) -> pa.Table:
        return run(here, there.rename_columns([c[:-1] for c in there.column_names]))

    left, right = spread(here, pairs, "i", "j").groupBy("i", "j"), spread(there, pairs, "i_", "j_").groupBy("i_", "j_")
    return left.cogroup(right).applyInArrow(renamed, schema)


def nearest_neighbours(blocks: Blocks, k: int) -> DataFrame:
    """(pos, rank, nbr, dist, nbr_copies): the k nearest distinct points of every point, exactly."""
    low = blocks.low

    def own(table: pa.Table) -> pa.Table:
        side = Side(table)
        return _nearest(side, side, np.full(len(side.pos), np.inf), k, low)

    points = blocks.points.select("part", "cell", "pos", "copies", "grid")
    ranked = spread(points, blocks.parts, "part").groupBy("part").applyInArrow(own, FOUND)
    if blocks.parts > 1:
        inside = materialise(ranked)
        reach = inside.groupBy("pos").agg(F.max("reach").alias("reach"))
        reaching = materialise(points.join(reach, "pos"))

        def across(here: pa.Table, there: pa.Table) -> pa.Table:
            if len(here) == 0 or len(there) == 0:
                return NOTHING_FOUND
            q, p = Side(here), Side(there)
            return _nearest(q, p, q.column("reach"), k, low)

        queries = reaching.select(F.col("part").alias("i"), "cell", "pos", "grid", "reach")
        others = reaching.select(F.col("part").alias("j"), "cell", "pos", "copies", "grid")
        ranked = inside.unionByName(meet(queries, blocks.parts, others, blocks.parts, across, FOUND, apart=True))
    rank = F.row_number().over(Window.partitionBy("pos").orderBy("dist", "nbr"))
    return (
        ranked.where(F.col("nbr").isNotNull())
        .select("pos", "nbr", "dist", "nbr_copies")
        .withColumn("rank", rank)
        .where(F.col("rank") <= k)
    )


def core_distances(blocks: Blocks, neighbours: DataFrame, min_samples: int) -> DataFrame:
    """(pos, core): distance to the ``min_samples``-th other row, copies counted one by one."""
    wanted = max(1, min(int(min_samples), blocks.total - 1))
    listed = neighbours.groupBy("pos").agg(F.array_sort(F.collect_list(F.struct("rank", "dist", "nbr_copies"))).alias("n"))
    walk = (
        f"aggregate(n, named_struct('seen', copies - 1, 'core', if(copies - 1 >= {wanted}, 0.0D, cast(null as double))), "
        f"(st, x) -> named_struct('seen', st.seen + x.nbr_copies, "
        f"'core', coalesce(st.core, if(st.seen + x.nbr_copies >= {wanted}, x.dist, null))), st -> st.core)"
    )
    points = blocks.points.select("pos", "copies").join(listed, "pos", "left")
    alone = F.when(F.col("copies") - 1 >= wanted, 0.0)
    return points.select("pos", F.coalesce(F.expr(walk), alone, F.lit(0.0)).alias("core"))


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
