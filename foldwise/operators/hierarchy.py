"""Flat clusters from a spanning tree: condensed hierarchy, excess of mass, merge below a radius.

The edges, numbered in ascending order, are the merges of a binary hierarchy: edge k joins two components into one
that is named k.  A component is a cluster once it has ``min_cluster_size`` points; when two clusters meet, both
are closed and the edge opens their parent.  All steps go over slices of consecutive edges, of bounded size, in parallel:

1. Names.  The ends of each edge are renamed to the components that all earlier slices make of them.  Slices are halved
   again and again: what the left half connects renames the ends in the right half, for all halves of a level at once, one
   task for each half of at most ``TASK_EDGES`` edges.
2. Merges.  Each slice is walked on its own and gives the two components that each of its edges joins.
3. Sizes of the components that go from slice to slice, by pointer doubling over the slices.
4. Condensing.  Each slice is walked again.  What happens to a component that was a cluster before is noted under that
   component's name; the names are followed back to clusters by pointer doubling.
5. Excess of mass.  Best stabilities rise from the leaves of the tree of clusters: nodes whose children are known are
   settled (rake), and chains of nodes that wait for one child each are composed, as max(a, b + x) is closed under
   composition (compress); within slices of clusters, and in rounds between them.
6. Selection, by a walk up within slices and pointer doubling between them.

Every step takes a number of rounds that grows with the logarithm of the number of slices.  Densities are whole
numbers of 2⁻⁴⁰, so that sums don't depend on their order.

Method: Campello, Moulavi and Sander 2013; merge below a radius: Malzer and Baum 2020.
"""

from __future__ import annotations

from decimal import Decimal

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldwise.operators.ordering import with_row_index
from foldwise.operators.spanning import components
from foldwise.session import SINGLE_TASK_ROWS, written

#: Smallest distance taken as different from zero, so that densities stay finite.
LEAST_DISTANCE = 1e-12
#: Edges that one task walks.
SLICE_EDGES = 1 << 16
#: Edges of consecutive slices whose names one task finds, where slices are smaller.  Halves beyond that take rounds of contraction.
TASK_EDGES = SINGLE_TASK_ROWS

CLUSTERS = "cluster bigint, parent bigint, birth double, best double, chosen boolean"
MERGES = "number bigint, slice bigint, x bigint, y bigint, weight double, root bigint"
#: ``pointer``: a component's cluster, or the component whose cluster it has.  ``mass``: an amount for a cluster.
#: ``closed``: a cluster, the one that follows it, and the weight and its size then.
NOTES = "kind string, label bigint, via bigint, cluster bigint, amount decimal(38,0), parent bigint, birth double, size bigint"
_EXACT = "decimal(38,0)"


def density(weight: float) -> int:
    return int(2.0**40 / max(weight, LEAST_DISTANCE))


class _Names:
    """Components within a slice, each under its current name."""

    def __init__(self) -> None:
        self.parent: dict[int, int] = {}
        self.name: dict[int, int] = {}

    def find(self, x: int) -> int:
        parent = self.parent
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    def of(self, x: int) -> int:
        root = self.find(x)
        return self.name.get(root, root)

    def join(self, x: int, y: int, name: int) -> None:
        a, b = self.find(x), self.find(y)
        self.parent[b] = a
        self.name[a] = name


def merges_of_slice(edges: pd.DataFrame) -> pd.DataFrame:
    """The components x and y that each edge joins, and the name under which they leave the slice."""
    edges = edges.sort_values("number")
    names, x, y = _Names(), [], []
    ends = list(zip(edges["a"].tolist(), edges["b"].tolist(), edges["number"].tolist()))
    for a, b, number in ends:
        x.append(names.of(a))
        y.append(names.of(b))
        names.join(a, b, number)
    return pd.DataFrame(
        {"number": edges["number"], "slice": edges["slice"], "x": x, "y": y, "weight": edges["weight"], "root": [names.of(a) for a, _, _ in ends]}
    )


def names_after_slice(edges: pd.DataFrame) -> pd.DataFrame:
    """The name that a slice gives each component that it touches."""
    edges = edges.sort_values("number")
    names = _Names()
    for a, b, number in zip(edges["a"].tolist(), edges["b"].tolist(), edges["number"].tolist()):
        names.join(a, b, number)
    touched = list(names.parent)
    return pd.DataFrame({"label": touched, "name": [names.of(x) for x in touched]}, dtype="int64")


def condense_slice(min_size: int, slice_edges: int):
    """Notes on the merges of a slice; ``size_x`` and ``size_y`` are known for components of earlier slices."""

    def run(merges: pd.DataFrame) -> pd.DataFrame:
        merges = merges.sort_values("number")
        first = int(merges["slice"].iloc[0]) * slice_edges
        size: dict[int, int] = {}
        cluster: dict[int, tuple[str, int]] = {}  # of components that are one: its name, or the earlier component it was
        waiting: dict[int, list[int]] = {}  # what came into the slice and lies in a small component
        mass: dict[tuple[str, int], int] = {}
        notes: list[dict] = []

        def of(ref: tuple[str, int]) -> dict:
            return {ref[0]: ref[1]}

        def enter(label: int, known: float) -> None:
            if label < first and label not in size:
                size[label] = 1 if label < 0 else int(known)
                if size[label] >= min_size:
                    cluster[label] = ("via", label)
                else:
                    waiting[label] = [label]

        def settle(labels: list[int], ref: tuple[str, int]) -> None:
            notes.extend({"kind": "pointer", "label": x} | of(ref) for x in labels)

        for x, y, number, weight, known_x, known_y in zip(*(merges[c].tolist() for c in ("x", "y", "number", "weight", "size_x", "size_y"))):
            enter(x, known_x)
            enter(y, known_y)
            total, dense, own = size[x] + size[y], density(weight), ("cluster", number)
            if x in cluster and y in cluster:
                notes.extend({"kind": "closed", "parent": number, "birth": weight, "size": size[z]} | of(cluster.pop(z)) for z in (x, y))
                cluster[number], mass[own] = own, total * dense
            elif x in cluster or y in cluster:
                big, small = (x, y) if x in cluster else (y, x)
                ref = cluster[number] = cluster.pop(big)
                mass[ref] = mass.get(ref, 0) + size[small] * dense
                settle(waiting.pop(small), ref)
            else:
                few, many = sorted((waiting.pop(x), waiting.pop(y)), key=len)
                many += few
                if total >= min_size:
                    cluster[number], mass[own] = own, total * dense
                    settle(many, own)
                else:
                    waiting[number] = many
            size[number] = total
        for label, ref in cluster.items():
            if label >= first:
                settle([label], ref)
        for label, inside in waiting.items():
            if label >= first:
                notes.extend({"kind": "pointer", "label": x, "via": label} for x in inside)
        notes.extend({"kind": "mass", "amount": Decimal(amount)} | of(ref) for ref, amount in mass.items())
        out = pd.DataFrame(notes, columns=[part.split()[0] for part in NOTES.split(", ")])
        for name in ("label", "via", "cluster", "parent", "size"):
            out[name] = out[name].astype("Int64")
        return out

    return run


def _renamed_ends(edges: DataFrame, slices: int, slice_edges: int) -> DataFrame:
    """Edges whose ends are the components made by all earlier slices."""
    block = 1 << max(0, (slices - 1).bit_length()) >> 1
    while block:
        half = F.floor(F.col("slice") / block)
        left = edges.where((half % 2 == 0) & ((half + 1) * block < slices))
        if block == 1 or block * slice_edges <= TASK_EDGES:
            names = left.groupBy(half.alias("half")).applyInPandas(names_after_slice, "label bigint, name bigint")
        else:
            found = components(left.select(F.col("a").alias("lo"), F.col("b").alias("hi"), "weight"), max(slice_edges, TASK_EDGES))
            found = _round(found.select(F.col("node").alias("label"), "component"))
            last = left.join(found, left["a"] == found["label"]).groupBy("component").agg(F.max("number").alias("name"))
            names = found.join(last, "component").select("label", "name")
        names = _round(names)
        right = edges.where(half % 2 == 1)
        for end in ("a", "b"):
            right = right.join(names.withColumnRenamed("label", end), end, "left").withColumn(end, F.coalesce("name", end)).drop("name")
        edges = _round(edges.where(half % 2 == 0).unionByName(right))
        block >>= 1
    return edges


def _round(table: DataFrame) -> DataFrame:
    """Fix the result of a round; unions of settled and open rows would add partitions with every round."""
    return written(table.coalesce(int(table.sparkSession.conf.get("spark.sql.shuffle.partitions"))), "hierarchy")


def _is_open(table: DataFrame, column: str) -> bool:
    return not table.where(F.col(column).isNotNull()).isEmpty()


def _carried_sizes(merges: DataFrame, slice_edges: int) -> DataFrame:
    """(node, total): the points of each component that leaves a slice.

    A component's points are those that enter it in its own slice and those of the components that do.
    """
    incoming = merges.select("root", "slice", F.explode(F.array("x", "y")).alias("label")).where(F.col("label") < F.col("slice") * slice_edges)
    up = incoming.where("label >= 0").select(F.col("label").alias("node"), F.col("root").alias("up"))
    sizes = incoming.groupBy("root").agg(F.count_if(F.col("label") < 0).alias("total")).withColumnRenamed("root", "node").join(up, "node", "left")
    sizes = _round(sizes.select("node", "total", "up"))
    while _is_open(sizes, "up"):
        # what lies up to 2^k slices below is complete; the same again below those adds what lies up to 2^(k+1) below
        moving = sizes.where("up IS NOT NULL")
        more = moving.groupBy("up").agg(F.sum("total").alias("more")).withColumnRenamed("up", "node")
        further = moving.select("node", "up").join(sizes.select(F.col("node").alias("up"), F.col("up").alias("next")), "up").select("node", F.col("next").alias("up"))
        sizes = _round(sizes.drop("up").join(more, "node", "left").select("node", (F.col("total") + F.coalesce("more", F.lit(0))).alias("total")).join(further, "node", "left"))
    return sizes.select("node", "total")


def _followed(pointers: DataFrame) -> DataFrame:
    """(label, cluster): each component's cluster, along any number of pointers; null where there is none."""
    while _is_open(pointers, "via"):
        moving = pointers.where("via IS NOT NULL").select("label", "via")
        to = pointers.select(F.col("label").alias("via"), F.col("via").alias("next"), "cluster")
        pointers = _round(pointers.where("via IS NULL").unionByName(moving.join(to, "via", "left").select("label", F.col("next").alias("via"), "cluster")))
    return pointers.select("label", "cluster")


def condensed(tree: DataFrame, min_size: int, slice_edges: int = SLICE_EDGES) -> tuple[DataFrame, DataFrame]:
    """(cluster, parent, birth, stability) and (pos, cluster) of a spanning tree (lo, hi, weight; positions aren't negative).

    A cluster is named by the edge that opened it.  A root has no parent, and no point leaves it.
    """
    edges = _round(with_row_index(tree, "weight", "lo", "hi", index="number").withColumn("slice", F.floor(F.col("number") / slice_edges)))
    slices = -(-edges.count() // slice_edges)
    # a point's component is named by a negative number
    edges = edges.select("number", "slice", "weight", (-1 - F.col("lo")).alias("a"), (-1 - F.col("hi")).alias("b"))
    merges = _round(_renamed_ends(edges, slices, slice_edges).groupBy("slice").applyInPandas(merges_of_slice, MERGES))
    if slices > 1:
        sizes = _carried_sizes(merges, slice_edges)
        for end in ("x", "y"):
            merges = merges.join(sizes.select(F.col("node").alias(end), F.col("total").alias(f"size_{end}")), end, "left")
    else:
        merges = merges.withColumns({"size_x": F.lit(None).cast("bigint"), "size_y": F.lit(None).cast("bigint")})
    notes = _round(merges.groupBy("slice").applyInPandas(condense_slice(min_size, slice_edges), NOTES))
    pointers = _followed(notes.where("kind = 'pointer'").select("label", "via", "cluster"))
    names = pointers.where("label >= 0").select(F.col("label").alias("via"), F.col("cluster").alias("named"))

    def named(kind: str, *columns: str) -> DataFrame:
        rows = notes.where(F.col("kind") == kind)
        known = rows.where("via IS NULL").select("cluster", *columns)
        return known.unionByName(rows.where("via IS NOT NULL").join(names, "via").select(F.col("named").alias("cluster"), *columns))

    mass = named("mass", "amount").groupBy("cluster").agg(F.sum("amount").cast(_EXACT).alias("mass"))
    closed = named("closed", "parent", "birth", "size")
    dense = F.floor(F.lit(2.0**40) / F.greatest(F.col("birth"), F.lit(LEAST_DISTANCE))).cast(_EXACT)
    stability = F.col("mass") - (F.col("size").cast("decimal(19,0)") * dense).cast(_EXACT)
    clusters = mass.join(closed, "cluster", "left").select("cluster", "parent", F.coalesce("birth", F.lit(float("inf"))).alias("birth"), F.when(F.col("parent").isNotNull(), stability.cast(_EXACT)).alias("stability"))
    return _round(clusters), pointers.where("label < 0 AND cluster IS NOT NULL").select((-1 - F.col("label")).alias("pos"), "cluster")


_NODES = "cluster bigint, slice bigint, least decimal(38,0), left bigint, right bigint, best decimal(38,0), add decimal(38,0), down bigint"
_COLUMNS = [part.split()[0] for part in _NODES.replace("(38,0)", "").split(", ")]


def settle_slice(nodes: pd.DataFrame) -> pd.DataFrame:
    """Rake and compress within a slice: all that can be known without other slices.  Children come before their parents."""
    state: dict[int, tuple] = {}  # (best, None, None, None) or (None, least, add, down), or all None while it waits for two

    def known(x) -> tuple:
        return state.get(x, (None, None, None, None))

    rows = []
    nodes = nodes.sort_values("cluster").astype({c: "Int64" for c in ("left", "right", "down")})
    for cluster, slice_, least, left, right, best, add, down in nodes[_COLUMNS].itertuples(index=False, name=None):
        left, right, down, best, add = (None if pd.isna(x) else x for x in (left, right, down, best, add))
        own = least
        if best is None and down is None:
            x, y = known(left)[0], known(right)[0]
            if x is not None and y is not None:
                best = max(least, x + y)
            elif x is not None or y is not None:
                add, down = (x, right) if x is not None else (y, left)
        if best is None and down is not None:
            below = known(down)
            if below[0] is not None:
                best = max(least, add + below[0])
            elif below[3] is not None:
                least, add, down = max(least, add + below[1]), add + below[2], below[3]
        state[cluster] = (best, None, None, None) if best is not None else (None, least, add, down)
        rows.append((cluster, slice_, own if best is not None else least, left, right, best, add, down))
    out = pd.DataFrame(rows, columns=_COLUMNS)
    return out.astype({c: "Int64" for c in ("left", "right", "down")})


def _across_slices(nodes: DataFrame) -> DataFrame:
    """One round of rake and compress between slices."""
    known = nodes.select("cluster", "best", "least", "add", "down")
    two = nodes.where("best IS NULL AND down IS NULL").drop("best", "add", "down")
    for side in ("left", "right"):
        two = two.join(known.select(F.col("cluster").alias(side), F.col("best").alias(f"best_{side}")), side)
    settled = F.greatest("least", (F.col("best_left") + F.col("best_right")).cast(_EXACT))
    two = two.withColumns({
        "best": F.when(F.col("best_left").isNotNull() & F.col("best_right").isNotNull(), settled), "add": F.coalesce("best_left", "best_right"),
        "down": F.when(F.col("best_left").isNull() & F.col("best_right").isNotNull(), F.col("left")).when(F.col("best_right").isNull() & F.col("best_left").isNotNull(), F.col("right")),
    })
    one = nodes.where("best IS NULL AND down IS NOT NULL").join(
        known.select(F.col("cluster").alias("down"), F.col("best").alias("best_"), F.col("least").alias("least_"), F.col("add").alias("add_"), F.col("down").alias("down_")), "down"
    )
    chain = F.col("down_").isNotNull() & F.col("best_").isNull()
    one = one.select(
        "cluster", "slice", F.when(chain, F.greatest("least", (F.col("add") + F.col("least_")).cast(_EXACT))).otherwise(F.col("least")).alias("least"), "left", "right",
        F.when(F.col("best_").isNotNull(), F.greatest("least", (F.col("add") + F.col("best_")).cast(_EXACT))).alias("best"),
        F.when(chain, (F.col("add") + F.col("add_")).cast(_EXACT)).otherwise(F.col("add")).alias("add"), F.when(chain, F.col("down_")).otherwise(F.col("down")).alias("down"),
    )
    return nodes.where("best IS NOT NULL").unionByName(two.select(_COLUMNS)).unionByName(one.select(_COLUMNS))


def best_stabilities(clusters: DataFrame, slice_edges: int = SLICE_EDGES) -> DataFrame:
    """(cluster, best): the largest total stability of clusters at or below each cluster that exclude each other.

    Rake and compress over (cluster, parent, stability), in turn within slices and between them.  A node waits for two children, or
    for the one ``down`` as max(least, add + best of down), or is settled.
    """
    children = clusters.where("parent IS NOT NULL").groupBy(F.col("parent").alias("cluster")).agg(F.min("cluster").alias("left"), F.max("cluster").alias("right"))
    none = F.lit(None)
    own = F.coalesce("stability", F.lit(0)).cast(_EXACT)
    nodes = clusters.join(children, "cluster", "left").select(
        "cluster", F.floor(F.col("cluster") / slice_edges).alias("slice"), own.alias("least"), "left", "right",
        F.when(F.col("left").isNull(), own).alias("best"), none.cast(_EXACT).alias("add"), none.cast("bigint").alias("down"),
    )
    nodes = _round(nodes.groupBy("slice").applyInPandas(settle_slice, _NODES))
    while not nodes.where("best IS NULL").isEmpty():
        nodes = _round(_across_slices(nodes).groupBy("slice").applyInPandas(settle_slice, _NODES))
    return nodes.select("cluster", "best")


def with_choice(clusters: DataFrame, slice_edges: int = SLICE_EDGES) -> DataFrame:
    """Add ``best`` and ``chosen``: whether a cluster is at least as stable as the best of those below.  Roots never are."""
    best = best_stabilities(clusters, slice_edges)
    below = clusters.where("parent IS NOT NULL").join(best, "cluster").groupBy(F.col("parent").alias("cluster")).agg(F.sum("best").cast(_EXACT).alias("below"))
    chosen = F.col("parent").isNotNull() & (F.col("below").isNull() | (F.col("below") <= F.col("stability")))
    return clusters.join(best, "cluster").join(below, "cluster", "left").select("cluster", "parent", "birth", F.col("best").cast("double").alias("best"), F.coalesce(chosen, F.lit(False)).alias("chosen"))


def _climb(highest: list[str], lowest: list[str]):
    """Move the pointers of a slice up until they leave it; parents have larger names than their children."""
    marks = highest + lowest

    def run(nodes: pd.DataFrame) -> pd.DataFrame:
        at: dict[int, list] = {}
        for cluster, slice_, up, *own in nodes.sort_values("cluster", ascending=False)[["cluster", "slice", "up", *marks]].astype("Int64").itertuples(index=False, name=None):
            own = [None if pd.isna(x) else x for x in own]
            up = None if pd.isna(up) else up
            if up in at:
                above = at[up]
                own = [x if (x is not None and (k >= len(highest) or y is None)) else y for k, (x, y) in enumerate(zip(own, above[2:]))]
                up = above[1]
            at[cluster] = [slice_, up, *own]
        out = pd.DataFrame([(c, *row) for c, row in at.items()], columns=["cluster", "slice", "up", *marks])
        return out.astype("Int64")

    return run


def _upwards(nodes: DataFrame, highest: list[str], lowest: list[str], slice_edges: int) -> DataFrame:
    """For each node (cluster, parent, marks ...) the highest or the lowest marked one at or above it, or null.

    Within slices in one walk, then by pointer doubling over the slices.
    """
    marked = [F.when(F.col(m), F.col("cluster")).alias(m) for m in highest + lowest]
    rows = nodes.select("cluster", F.floor(F.col("cluster") / slice_edges).alias("slice"), F.col("parent").alias("up"), *marked)
    schema = ", ".join(f"{c} bigint" for c in ("cluster", "slice", "up", *highest, *lowest))
    seen = _round(rows.groupBy("slice").applyInPandas(_climb(highest, lowest), schema).drop("slice"))
    while _is_open(seen, "up"):
        above = seen.select(F.col("cluster").alias("up"), F.col("up").alias("next"), *[F.col(m).alias(f"above_{m}") for m in highest + lowest])
        marks = [F.coalesce(f"above_{m}", m).alias(m) for m in highest] + [F.coalesce(m, f"above_{m}").alias(m) for m in lowest]
        moved = seen.where("up IS NOT NULL").join(above, "up", "left").select("cluster", F.col("next").alias("up"), *marks)
        seen = _round(seen.where("up IS NULL").unionByName(moved))
    return seen.drop("up")


def _resolve_in_rounds(clusters: DataFrame, radius: float, slice_edges: int = SLICE_EDGES) -> DataFrame:
    """(cluster, at): the selected cluster at or above each one, or null.

    Of the chosen clusters the highest on each path counts.  One born below the radius gives way to the first above it that is
    born beyond the radius or lies directly below a root.
    """
    roots = clusters.where(F.col("parent").isNull()).select(F.col("cluster").alias("parent"), F.lit(True).alias("under_root"))
    facts = clusters.join(roots, "parent", "left").withColumn("stop", F.coalesce("under_root", F.lit(False)) | (F.col("birth") > radius) & F.col("parent").isNotNull())
    seen = _upwards(facts, ["chosen"], ["stop"], slice_edges)
    births = clusters.select(F.col("cluster").alias("chosen"), "birth")
    lifts = seen.select(F.col("cluster").alias("chosen"), F.col("stop").alias("lifted"))
    tops = seen.where("chosen IS NOT NULL").select("chosen").distinct().join(births, "chosen").join(lifts, "chosen")
    final = tops.select(F.when(F.col("birth") >= radius, F.col("chosen")).otherwise(F.col("lifted")).alias("cluster")).distinct().withColumn("final", F.lit(True))
    marked = clusters.join(final, "cluster", "left").withColumn("final", F.coalesce("final", F.lit(False)))
    return _upwards(marked, ["final"], [], slice_edges).select("cluster", F.col("final").alias("at"))


def flat_clusters(tree: DataFrame, min_cluster_size: int, radius: float, slice_edges: int = SLICE_EDGES) -> DataFrame:
    """(pos, label) of the clustered points of a spanning tree; the others are noise.

    Labels are arbitrary names.
    """
    clusters, points = condensed(tree, max(2, int(min_cluster_size)), slice_edges)
    at = _resolve_in_rounds(_round(with_choice(clusters, slice_edges)), radius, slice_edges)
    return points.join(at, "cluster").where(F.col("at").isNotNull()).select("pos", F.col("at").alias("label"))
