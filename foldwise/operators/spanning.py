"""Minimum spanning tree of the mutual-reachability graph, and connected components of edge tables.

Edges are ordered by (weight, lo, hi), which makes the tree unique.  Every tree edge
is the least edge that leaves some component in each round of smallest outgoing edges.  Lists of nearest
neighbours settle most rounds; where they can't, points search all parts for the nearest point outside.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldwise.functions.vectors import grid_distance
from foldwise.operators import neighbours as N
from foldwise.session import SINGLE_TASK_ROWS, written

EDGES = "lo bigint, hi bigint, weight double"
#: Neighbours listed for each point before the tree is sought.
LISTED = 8
NO_EDGES = pa.table({"c": pa.array([], pa.int64()), "weight": pa.array([], pa.float64()), "lo": pa.array([], pa.int64()), "hi": pa.array([], pa.int64()), "to": pa.array([], pa.int64())})
CHOSEN = "c bigint, weight double, lo bigint, hi bigint, to bigint"


def tree_of_matrix(weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spanning tree of a full weight matrix under the order (weight, lo, hi), as (lo, hi, weight)."""
    n = len(weight)
    best = weight[0].copy()
    source = np.zeros(n, dtype=np.int64)
    outside = np.ones(n, dtype=bool)
    outside[0], best[0] = False, np.inf
    lo, hi, w = (np.empty(n - 1, dtype=np.int64), np.empty(n - 1, dtype=np.int64), np.empty(n - 1))
    for step in range(n - 1):
        at = int(best.argmin())
        ties = np.flatnonzero((best == best[at]) & outside)
        if len(ties) > 1:
            a, b = np.minimum(ties, source[ties]), np.maximum(ties, source[ties])
            at = int(ties[np.lexsort((b, a))[0]])
        lo[step], hi[step], w[step] = min(at, source[at]), max(at, source[at]), best[at]
        outside[at], best[at] = False, np.inf
        row = weight[at]
        # Of two equal edges into the same vertex the one from the smaller vertex comes first.
        better = outside & ((row < best) | ((row == best) & (at < source)))
        best[better], source[better] = row[better], at
    return lo, hi, w


def _reachability(grid: np.ndarray, core: np.ndarray) -> np.ndarray:
    return np.maximum(np.maximum(grid_distance(grid, grid), core[:, None]), core[None, :])


def _edge_table(pos: np.ndarray, lo: np.ndarray, hi: np.ndarray, w: np.ndarray) -> pa.Table:
    return pa.table({"lo": pos[lo], "hi": pos[hi], "weight": w})


def _block_tree(table: pa.Table) -> pa.Table:
    table = table.sort_by("pos")
    pos = table["pos"].to_numpy()
    return _edge_table(pos, *tree_of_matrix(_reachability(N.matrix(table["grid"]), table["core"].to_numpy())))


class _Forest:
    """Union by smaller name, for the steps that are small enough for one task."""

    def __init__(self) -> None:
        self.parent: dict[int, int] = {}

    def find(self, x: int) -> int:
        parent = self.parent
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    def join(self, x: int, y: int) -> bool:
        a, b = self.find(x), self.find(y)
        if a != b:
            self.parent[max(a, b)] = min(a, b)
        return a != b

    def labels(self) -> list[tuple[int, int]]:
        return [(x, self.find(x)) for x in list(self.parent)]


def _sorted_edges(frames: Iterator[pd.DataFrame]) -> pd.DataFrame | None:
    parts = list(frames)
    return pd.concat(parts).sort_values(["weight", "lo", "hi"], kind="stable") if parts else None


def _finish(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Forest edges of a contracted edge table, and (c, root) for its components."""
    edges = _sorted_edges(frames)
    if edges is not None:
        forest = _Forest()
        kept = edges[[forest.join(a, b) for a, b in zip(edges["a"].tolist(), edges["b"].tolist())]]
        names = pd.DataFrame(forest.labels(), columns=["c", "root"], dtype="Int64")
        for part in (kept[["lo", "hi", "weight"]], names):
            yield part.reindex(columns=["lo", "hi", "weight", "c", "root"]).astype(
                {"lo": "Int64", "hi": "Int64", "weight": "float64", "c": "Int64", "root": "Int64"}
            )


def _renamed(labels: DataFrame, names: DataFrame) -> DataFrame:
    """Replace components by the roots they were merged into."""
    to = names.select(F.col("c").alias("component"), "root")
    return written(
        labels.join(to, "component", "left").select("node", F.coalesce("root", "component").alias("component"))
    )


def contract(edges: DataFrame, limit: int = SINGLE_TASK_ROWS) -> tuple[DataFrame, DataFrame]:
    """(forest, labels) of an edge table by rounds of smallest outgoing edges.

    ``forest`` is the minimum spanning forest, ``labels`` has (node, component) with the smallest node
    number of each component.  Each round at least halves the open components; parallel edges are
    combined before the shuffle, so a component that holds a third of the graph stays cheap.  Once no
    more than ``limit`` contracted edges are left, one task finishes them.
    """
    open_ = written(
        edges.select(F.col("lo").alias("a"), F.col("hi").alias("b"), "weight", "lo", "hi").where(F.col("lo") != F.col("hi"))
    )
    spark = edges.sparkSession
    forest = [spark.createDataFrame([], EDGES)]
    labels = written(open_.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("component", F.col("node")))
    rank = F.struct("weight", "lo", "hi")
    while True:
        if open_.count() <= limit:
            last = written(open_.coalesce(1).mapInPandas(_finish, f"{EDGES}, c bigint, root bigint"))
            forest.append(last.where(F.col("c").isNull()).select("lo", "hi", "weight"))
            labels = _renamed(labels, last.where(F.col("c").isNotNull()).select("c", "root"))
            break
        ends = open_.select(F.col("a").alias("c"), F.col("b").alias("to"), "weight", "lo", "hi").unionByName(
            open_.select(F.col("b").alias("c"), F.col("a").alias("to"), "weight", "lo", "hi")
        )
        best = written(ends.groupBy("c").agg(F.min(F.struct("weight", "lo", "hi", "to")).alias("e")))
        if best.isEmpty():
            break
        forest.append(written(best.select("e.lo", "e.hi", "e.weight").distinct()))
        up = _hooked(best)
        labels = _renamed(labels, up)
        left = up.select(F.col("c").alias("a"), F.col("root").alias("ra"))
        right = up.select(F.col("c").alias("b"), F.col("root").alias("rb"))
        joined = open_.join(left, "a").join(right, "b").where(F.col("ra") != F.col("rb"))
        open_ = written(
            joined.select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b"), "weight", "lo", "hi")
            .groupBy("a", "b")
            .agg(F.min(rank).alias("e"))
            .select("a", "b", "e.*")
        )
    smallest = labels.groupBy("component").agg(F.min("node").alias("name"))
    named = labels.join(smallest, "component").select("node", F.col("name").alias("component"))
    return N.union_all(forest), named


def _hooked(best: DataFrame) -> DataFrame:
    """(c, root) from the edge (weight, lo, hi, to) that each component chose; one that chose none is its own root."""
    # Two components that chose each other share their edge; the smaller becomes the root.
    back = best.select(F.col("c").alias("to"), F.col("e.to").alias("back"))
    hop = best.select("c", F.col("e.to").alias("to")).join(back, "to", "left")
    up = hop.select("c", F.when((F.col("back") == F.col("c")) & (F.col("c") < F.col("to")), F.col("c")).otherwise(F.col("to")).alias("root"))
    passive = best.select(F.col("e.to").alias("c")).distinct().join(best.select("c"), "c", "left_anti").select("c", F.col("c").alias("root"))
    return _to_roots(written(up.unionByName(passive)))


def _to_roots(up: DataFrame) -> DataFrame:
    """Follow (c -> root) pointers to their ends by doubling; rounds grow with the logarithm of depth."""
    while True:
        above = up.select(F.col("c").alias("root"), F.col("root").alias("next"))
        jumped = written(up.join(above, "root").select("c", F.col("next").alias("root"), (F.col("next") != F.col("root")).alias("moved")))
        if jumped.where("moved").isEmpty():
            return jumped.select("c", "root")
        up = jumped.select("c", "root")


def minimum_spanning_forest(edges: DataFrame, limit: int = SINGLE_TASK_ROWS) -> DataFrame:
    """Forest of an edge table (lo, hi, weight)."""
    return contract(edges, limit)[0]


def _merged(best: DataFrame, single: bool) -> tuple[DataFrame, DataFrame]:
    """(edges, names): the distinct chosen edges, and (c, root) of the components that they join; in one task if ``single``."""
    if not single:
        return written(best.select("e.lo", "e.hi", "e.weight").distinct()), _hooked(best)
    chosen = best.select(F.col("c").alias("a"), F.col("e.to").alias("b"), "e.weight", "e.lo", "e.hi")
    done = written(chosen.coalesce(1).mapInPandas(_finish, f"{EDGES}, c bigint, root bigint"))
    return done.where(F.col("c").isNull()).select("lo", "hi", "weight"), done.where(F.col("c").isNotNull()).select("c", "root")


def _search_outside(here: pa.Table, there: pa.Table, low: np.ndarray) -> pa.Table:
    """The least edge (weight, lo, hi) from each component of ``here`` to points of other components in ``there``.

    ``here`` has a limit for each row, the weight of an edge known for its component; heavier edges don't count.
    """
    if len(here) == 0 or len(there) == 0:
        return NO_EDGES
    q, p = N.Side(here), N.Side(there)
    mine, theirs, core_q, core_p = q.column("component"), p.column("component"), q.column("core"), p.column("core")
    names, at = np.unique(mine, return_inverse=True)
    limit = np.full(len(names), np.inf)
    np.minimum.at(limit, at, q.column("limit"))
    chosen: list[tuple | None] = [None] * len(names)

    def offer(i: np.ndarray, j: np.ndarray) -> None:
        weight = np.maximum(np.maximum(N.distances_at(q, i, p, j), core_q[i]), core_p[j])
        lo, hi = np.minimum(q.pos[i], p.pos[j]), np.maximum(q.pos[i], p.pos[j])
        order = np.lexsort((hi, lo, weight, at[i]))
        of = at[i][order]
        for k in order[np.r_[True, of[1:] != of[:-1]][: len(of)]]:
            c, edge = at[i[k]], (weight[k], lo[k], hi[k], theirs[j[k]])
            if edge[0] <= limit[c] and (chosen[c] is None or edge < chosen[c]):
                chosen[c], limit[c] = edge, edge[0]

    for rows, parts in N.tiles(q, p, low):
        first, of = rows.start, at[rows]
        open_, cores = mine[rows], core_q[rows]
        for columns, bound in parts:
            if bound - 1e-9 > limit[of].max():
                break
            columns = columns[core_p[columns] <= limit[of].max()]
            columns = columns if (open_ != open_[0]).any() else columns[theirs[columns] != open_[0]]
            if len(columns) == 0:
                continue
            near = N.halved(q, rows, p, columns)
            foreign = open_[:, None] != theirs[columns][None, :]
            near[~foreign] = -np.inf
            # The nearest point outside lowers the limit first, so that few pairs remain to be weighed.
            c = near.argmax(axis=1)
            i = np.flatnonzero(foreign[np.arange(len(c)), c] & (cores <= limit[of]))
            if len(i):
                offer(first + i, columns[c[i]])
            least = np.where(cores <= limit[of], N.least_halved(q.own[rows], limit[of]), np.inf)
            i, c = np.nonzero((near >= least[:, None]) & foreign)
            light = core_p[columns[c]] <= limit[of][i]
            if light.any():
                offer(first + i[light], columns[c[light]])
    known = [(int(n), *e) for n, e in zip(names, chosen) if e is not None]
    return pa.Table.from_arrays([pa.array([row[k] for row in known], kind) for k, kind in enumerate(NO_EDGES.schema.types)], names=NO_EDGES.schema.names)


def _tree_of_parts(blocks: N.Blocks, points: DataFrame, near: DataFrame, listed: int, limit: int) -> DataFrame:
    """The tree by rounds of smallest outgoing edges over all pairs of points, which are never listed.

    ``near`` holds ``listed`` nearest neighbours of each point.  An edge that is not in a point's list weighs no less than the last
    one's distance, so where a component's best listed edge is lighter, it is the best of all.  Only points for which
    that is open search the parts, those of the largest component never: the others join it.
    """
    low = blocks.low
    core = points.select("pos", "core")
    last = near.groupBy("pos").agg(F.max("dist").alias("last"), F.count("*").alias("n"))
    bound = F.when(F.col("n") >= listed, F.greatest("core", "last")).otherwise(F.lit(float("inf")))
    spots = written(
        points.select("pos", "part", "cell", "grid", "core").join(last, "pos", "left")
        .select("pos", "part", "cell", "grid", "core", F.when(F.col("n").isNull(), 0.0).otherwise(bound).alias("bound"))
    )
    other = core.select(F.col("pos").alias("nbr"), F.col("core").alias("nbr_core"))
    open_ = written(
        near.select("pos", "nbr", "dist").join(core, "pos").join(other, "nbr")
        .select(F.col("pos").alias("a"), F.col("nbr").alias("b"), F.greatest("dist", "core", "nbr_core").alias("weight"), F.least("pos", "nbr").alias("lo"), F.greatest("pos", "nbr").alias("hi"))
    )
    labels = spots.select(F.col("pos").alias("node"), F.col("pos").alias("component"))
    # Of each component the number of points and the least bound of any of them.
    sizes = spots.select(F.col("pos").alias("c"), F.lit(1).cast("bigint").alias("n"), F.col("bound").alias("least")).groupBy("c").agg(F.sum("n").alias("n"), F.min("least").alias("least"))
    limit_of = F.coalesce("e.weight", F.lit(float("inf")))
    unsure = F.col("least") <= limit_of
    forest = []
    while True:
        ends = open_.select(F.col("a").alias("c"), F.struct("weight", "lo", "hi", F.col("b").alias("to")).alias("e")).unionByName(
            open_.select(F.col("b").alias("c"), F.struct("weight", "lo", "hi", F.col("a").alias("to")).alias("e"))
        )
        state = written(sizes.join(ends.groupBy("c").agg(F.min("e").alias("e")), "c", "left"))
        facts = state.agg(
            F.count("*").alias("n"), F.count_if(unsure).alias("unsure"), F.max(F.struct("n", (-F.col("c")).alias("minus_c"), unsure.alias("unsure"))).alias("largest")
        ).first()
        if facts.n < 2:
            return N.union_all(forest) if forest else points.sparkSession.createDataFrame([], EDGES)
        largest = -facts.largest.minus_c
        best = state.where(F.col("e").isNotNull()).select("c", "e")
        if facts.unsure > facts.largest.unsure:
            located = spots.join(labels.select(F.col("node").alias("pos"), "component"), "pos")
            limits = state.where(unsure & (F.col("c") != largest)).select(F.col("c").alias("component"), limit_of.alias("limit"))
            seekers = written(located.join(limits, "component").where(F.col("bound") <= F.col("limit")).select("part", "cell", "pos", "grid", "core", "component", "limit"))
            groups = max(1, min(blocks.parts, -(-seekers.count() * blocks.parts // blocks.total)))
            queries = seekers.select(F.floor(F.col("part") * groups / blocks.parts).cast("int").alias("i"), "cell", "pos", "grid", "core", "component", "limit")
            others = located.select(F.col("part").alias("j"), "cell", "pos", "grid", "core", "component")
            found = N.meet(queries, groups, others, blocks.parts, lambda here, there: _search_outside(here, there, low), CHOSEN)
            searched = found.groupBy("c").agg(F.min(F.struct("weight", "lo", "hi", "to")).alias("e"))
            best = written(best.unionByName(searched).groupBy("c").agg(F.min("e").alias("e")))
        if facts.largest.unsure:
            best = best.where(F.col("c") != largest)
        edges, names = _merged(best, facts.n <= limit)
        forest.append(edges)
        labels = _renamed(labels, names)
        sizes = state.select("c", "n", "least").join(names, "c", "left").groupBy(F.coalesce("root", "c").alias("c")).agg(F.sum("n").alias("n"), F.min("least").alias("least"))
        for end in ("a", "b"):
            to = names.select(F.col("c").alias(end), "root")
            open_ = open_.join(to, end, "left").withColumn(end, F.coalesce("root", end)).drop("root")
        smallest = open_.where(F.col("a") != F.col("b")).groupBy(F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y")).agg(F.min(F.struct("weight", "lo", "hi")).alias("e"))
        open_ = written(smallest.select(F.col("x").alias("a"), F.col("y").alias("b"), "e.weight", "e.lo", "e.hi"))


def mutual_reachability_tree(points: DataFrame, min_samples: int, block_rows: int | None = None, limit: int = SINGLE_TASK_ROWS) -> DataFrame:
    """(lo, hi, weight): the spanning tree over rows (pos, vector), n - 1 edges for n rows."""
    folded = written(N.fold_copies(points))
    blocks = N.lay_out(folded, block_rows)
    k = max(1, min(int(min_samples), blocks.total - 1))
    listed = max(k, LISTED) if blocks.parts > 1 else k
    near = written(N.nearest_neighbours(blocks, listed))
    core = N.core_distances(blocks, near, k)
    placed = written(blocks.points.join(core, "pos").select("part", "cell", "pos", "copies", "grid", "core"))
    if blocks.parts > 1:
        trees = _tree_of_parts(blocks, placed, near, listed, limit)
    else:
        trees = placed.groupBy("part").applyInArrow(_block_tree, EDGES)
    if blocks.total > folded.count():
        # A copy lies at distance 0 from its representative, so their edge weighs the core distance.
        copies = N.copies_of(points, folded).join(placed.select(F.col("pos").alias("rep"), "core"), "rep")
        trees = trees.unionByName(copies.select(F.col("rep").alias("lo"), F.col("pos").alias("hi"), F.col("core").alias("weight")))
    return trees


def components(edges: DataFrame, limit: int = SINGLE_TASK_ROWS) -> DataFrame:
    """(node, component) of the nodes that have an edge; a component is named by its smallest node."""
    return contract(edges, limit)[1]


def density_components(points: DataFrame, eps_cosine: float, min_samples: int, min_cluster_size: int, block_rows: int | None = None, limit: int = SINGLE_TASK_ROWS) -> DataFrame:
    """(pos, cluster_id): components of the graph cut at the radius; -1 for those too small.

    The spanning tree has the same components as the full graph at every radius, so n - 1 edges decide.
    Ids count the components by their smallest position.
    """
    from foldwise.functions.vectors import cosine_to_euclid
    from foldwise.operators.ordering import with_row_index

    tree = mutual_reachability_tree(points, min_samples, block_rows, limit)
    labels = components(tree.where(F.col("weight") <= cosine_to_euclid(eps_cosine)), limit)
    sizes = labels.groupBy("component").agg(F.count("*").alias("n")).where(F.col("n") >= max(2, min_cluster_size))
    numbered = with_row_index(sizes, "component", index="cluster_id").select("component", "cluster_id")
    known = labels.join(numbered, "component").select(F.col("node").alias("pos"), "cluster_id")
    return points.select("pos").join(known, "pos", "left").fillna({"cluster_id": -1})
