import numpy as np
import pytest
import walk
from pyspark.sql import functions as F

from foldwise.functions.vectors import GRID, cosine_to_euclid, l2_normalize
from foldwise.operators import clustering as C
from foldwise.operators import hierarchy as H
from foldwise.operators import neighbours as N
from foldwise.operators import spanning as S


def blobs(seed, n=60, dim=6, centres=4, noise=10, copies=0, spread=0.15):
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(centres, dim))
    x = np.concatenate([middle[rng.integers(centres, size=n)] + spread * rng.normal(size=(n, dim)), rng.normal(size=(noise, dim))])
    if copies:
        x = np.concatenate([x, np.repeat(x[:2], copies, axis=0)])
    return rng.permutation(x)


def frame(spark, x):
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "pos bigint, vector array<double>").repartition(3)


def unit(x):
    size = np.linalg.norm(x, axis=1, keepdims=True)
    return np.rint(x / np.where(size > 0, size, 1) * GRID) / GRID


def distances(x):
    u = unit(x)
    return np.sqrt(((u[:, None, :] - u[None, :, :]) ** 2).sum(-1))


def reach(x, k):
    d = distances(x)
    k = min(k, len(x) - 1)
    core = np.sort(d, axis=1)[:, k]
    return np.maximum(d, np.maximum(core[:, None], core[None, :])), core


def brute_hdbscan(x, eps, min_samples, min_size):
    """Top-down condensed tree, written independently of the package."""
    w, _ = reach(x, min_samples)
    n = len(x)
    edges = []
    inside = {0}
    while len(inside) < n:
        a, b = min(((i, j) for i in inside for j in range(n) if j not in inside), key=lambda e: (w[e], min(e), max(e)))
        edges.append((w[a, b], min(a, b), max(a, b)))
        inside.add(b)
    edges.sort()

    def parts(points, es):
        """Remove the largest edge: two point sets with their edges."""
        *rest, (weight, a, b) = es
        side = {a}
        grow = True
        while grow:
            grow = False
            for _, p, q in rest:
                if (p in side) != (q in side):
                    side |= {p, q}
                    grow = True
        return weight, side, [e for e in rest if e[1] in side], points - side, [e for e in rest if e[1] not in side]

    clusters = {}  # id -> dict(parent, birth, points-left {point: lambda}, children)

    def build(points, es, parent, birth):
        cid = len(clusters)
        node = clusters[cid] = {"parent": parent, "birth": birth, "left": {}, "children": [], "all": set(points)}
        while True:
            if not es:
                for p in points:
                    node["left"].setdefault(p, 1e12)
                return cid
            weight, pa_, ea, pb, eb = parts(points, es)
            lam = 1 / max(weight, 1e-12)
            big = [len(pa_) >= min_size, len(pb) >= min_size]
            if all(big):
                for p in points:
                    node["left"][p] = lam
                node["children"] = [build(pa_, ea, cid, weight), build(pb, eb, cid, weight)]
                return cid
            if not any(big):
                for p in points:
                    node["left"][p] = lam
                return cid
            keep, drop = ((pa_, ea), pb) if big[0] else ((pb, eb), pa_)
            for p in drop:
                node["left"][p] = lam
            points, es = keep

    if n < min_size:
        return np.full(n, -1)
    build(set(range(n)), edges, None, np.inf)
    chosen = {}
    best = {}
    for cid in reversed(range(len(clusters))):
        c = clusters[cid]
        own = sum(lam - 1 / max(c["birth"], 1e-12) for lam in c["left"].values())
        below = sum(best[k] for k in c["children"])
        chosen[cid] = not (c["children"] and below > own)
        best[cid] = own if chosen[cid] else below
    chosen[0] = False
    selected = set()
    for cid in range(1, len(clusters)):
        p, blocked = clusters[cid]["parent"], False
        while p is not None:
            blocked |= chosen[p]
            p = clusters[p]["parent"]
        if chosen[cid] and not blocked:
            selected.add(cid)
    final = set()
    for c in selected:
        if clusters[c]["birth"] < eps:
            while clusters[c]["parent"] != 0:
                c = clusters[c]["parent"]
                if clusters[c]["birth"] > eps:
                    break
        final.add(c)
    labels = np.full(n, -1)
    for c in final:
        for p in clusters[c]["all"]:
            labels[p] = c
    return labels


def same_partition(a, b):
    pairs = set(zip(a.tolist(), b.tolist()))
    assert len(pairs) == len({p for p, _ in pairs}) == len({q for _, q in pairs})
    assert all((p == -1) == (q == -1) for p, q in pairs)


@pytest.mark.parametrize("k,block_rows,copies", [(1, 1000, 0), (3, 16, 0), (2, 8, 5), (70, 16, 0)])
def test_neighbours_and_core(spark, k, block_rows, copies):
    x = blobs(k, copies=copies)
    points = frame(spark, x)
    blocks = N.lay_out(N.fold_copies(points), block_rows)
    assert block_rows > len(x) or blocks.count > 1
    k_used = min(k, len(x) - 1)
    found = N.nearest_neighbours(blocks, k_used)
    core = {r.pos: r.core for r in N.core_distances(blocks, found, k).collect()}
    _, want = reach(x, k)
    for pos, value in core.items():
        assert value == pytest.approx(want[pos], abs=1e-7)
    if not copies:
        near = found.orderBy("pos", "rank").groupBy("pos").agg(F.array_sort(F.collect_list("dist")).alias("d")).collect()
        d = np.sort(distances(x), axis=1)[:, 1 : k_used + 1]
        for r in near:
            assert np.allclose(r.d, d[r.pos], atol=1e-7)


@pytest.mark.parametrize("block_rows,limit,copies", [(1000, 10**6, 0), (16, 10**6, 6), (16, 40, 6)])
def test_tree_weight_and_components(spark, block_rows, limit, copies):
    x = blobs(11, copies=copies)
    w, _ = reach(x, 2)
    inside, total = {0}, 0.0
    while len(inside) < len(x):
        out = [j for j in range(len(x)) if j not in inside]
        sub = w[np.ix_(sorted(inside), out)]
        total += sub.min()
        inside.add(out[int(sub.min(axis=0).argmin())])
    tree = S.mutual_reachability_tree(frame(spark, x), 2, block_rows, limit).collect()
    assert len(tree) == len(x) - 1
    assert sum(e.weight for e in tree) == pytest.approx(total, abs=1e-6)
    found = S.density_components(frame(spark, x), 0.02, 2, 3, block_rows, limit).orderBy("pos").collect()
    label = np.arange(len(x))
    for _ in range(len(x)):
        for i in range(len(x)):
            label[i] = label[w[i] <= cosine_to_euclid(0.02)].min(initial=label[i])
    sizes = np.bincount(label, minlength=len(x))
    names = {c: i for i, c in enumerate(sorted({c for c in label if sizes[c] >= 3}))}
    assert [r.cluster_id for r in found] == [names.get(c, -1) for c in label]


@pytest.mark.parametrize("seed", range(6))
@pytest.mark.parametrize("eps,min_samples,min_size", [(0.0, 1, 2), (0.05, 2, 3), (0.3, 3, 5)])
def test_hierarchy_against_brute_force(seed, eps, min_samples, min_size):
    """The walk and the selection, without Spark."""
    x = blobs(seed, n=40, noise=8, copies=3 if seed % 2 else 0)
    w, _ = reach(x, min_samples)
    lo, hi, weight = S.tree_of_matrix(w)
    import pandas as pd

    run = walk.in_one_process(min_size, cosine_to_euclid(eps))
    out = list(run(iter([pd.DataFrame({"lo": lo, "hi": hi, "weight": weight})])))[0]
    labels = np.full(len(x), -1)
    labels[out["pos"]] = out["label"]
    same_partition(labels, brute_hdbscan(x, cosine_to_euclid(eps), min_samples, min_size))


@pytest.mark.parametrize("limit", [10**6, 40])
def test_hdbscan_routes_agree(spark, limit):
    x = blobs(5, n=56, noise=8, copies=4)
    want = brute_hdbscan(x, cosine_to_euclid(0.02), 2, 3)
    assert len(set(want.tolist())) > 2
    got = C.hdbscan(frame(spark, x), 0.02, 2, 3, block_rows=20, limit=limit).orderBy("pos").collect()
    labels = np.array([r.cluster_id for r in got])
    same_partition(labels, want)
    firsts = [int(np.flatnonzero(labels == c)[0]) for c in range(labels.max() + 1)]
    assert firsts == sorted(firsts)


@pytest.mark.parametrize("shape, slice_edges, min_size, radius", [("random", 9, 3, 0.6), ("random", 1000, 2, 0.0), ("chain", 16, 2, 0.0), ("star", 30, 5, 100.0), ("equal", 16, 3, 0.6)])
def test_hierarchy_over_slices_against_the_walk(spark, shape, slice_edges, min_size, radius):
    """Trees whose hierarchies are deep, flat, skewed or full of ties, cut into slices of several sizes."""
    import pandas as pd

    rng = np.random.default_rng(len(shape) * 10 + slice_edges)
    n = 60
    up = {"random": lambda k: int(rng.integers(k)), "chain": lambda k: k - 1, "star": lambda k: 0, "equal": lambda k: int(rng.integers(k))}[shape]
    weight = {"chain": lambda k: k / 7, "equal": lambda k: float(rng.integers(1, 4))}.get(shape, lambda k: float(rng.uniform(0.01, 2)))
    edges = pd.DataFrame([(up(k), k, weight(k)) for k in range(1, n)], columns=["lo", "hi", "weight"])
    out = list(walk.in_one_process(min_size, radius)(iter([edges])))
    want, got = np.full(n, -1), np.full(n, -1)
    want[out[0]["pos"]] = out[0]["label"]
    for r in H.flat_clusters(spark.createDataFrame(edges, S.EDGES).repartition(3), min_size, radius, slice_edges).collect():
        got[r.pos] = r.label
    same_partition(got, want)


def test_parts_do_not_grow_with_blocks(spark):
    """Points cross the shuffle once for each part, of which there are few however many the blocks."""
    x = blobs(9, n=150)
    blocks = N.lay_out(N.fold_copies(frame(spark, x)), 2)
    assert blocks.count > 3 * N.PARTS and blocks.parts == N.PARTS
    assert blocks.points.select("part").distinct().count() > 1
    got = N.nearest_neighbours(blocks, 2).groupBy("pos").agg(F.max("dist").alias("d")).collect()
    d = distances(x)
    for r in got:
        others = np.sort(d[r.pos][d[r.pos] > 1e-9])
        assert r.d == pytest.approx(others[1], abs=1e-7)


@pytest.mark.parametrize("centres, spread", [(1, 1.0), (4, 0.01)])
def test_tree_of_parts_is_the_tree_of_all_pairs(spark, centres, spread):
    """Also for tight clusters, whose points list only their own kind and so must search the parts."""
    x = blobs(3, n=90, centres=centres, noise=0, spread=spread)
    lo, hi, _ = S.tree_of_matrix(reach(x, 2)[0])
    got = S.mutual_reachability_tree(frame(spark, x), 2, 10).collect()
    assert {(e.lo, e.hi) for e in got} == set(zip(lo.tolist(), hi.tolist())) and len(got) == 89


def size_bits(frame):
    return frame._jdf.queryExecution().optimizedPlan().stats().sizeInBytes().bit_length()


def test_rounds_do_not_multiply_estimated_sizes(spark):
    """Sizes estimated for joins of joins have more digits with every round, until planning takes longer than the work."""
    x = np.random.default_rng(1).normal(size=(300, 6))
    tree = S.mutual_reachability_tree(frame(spark, x), 2, 10)
    assert size_bits(tree) < 128 and tree.count() == 299
    forest, labels = S.contract(tree, limit=0)
    assert size_bits(forest) < 128 and size_bits(labels) < 128


def chain_of_edges(n, slice_edges, seed):
    import pandas as pd

    rng = np.random.default_rng(seed)
    rows = [(k, k // slice_edges, 1.0 + k, -1 - int(rng.integers(max(0, k - 6), k + 1)), -2 - k) for k in range(n)]
    return pd.DataFrame(rows, columns=["number", "slice", "weight", "a", "b"])


@pytest.mark.parametrize("task_edges", [10**6, 12, 1])
def test_names_by_halves_and_by_contraction(spark, monkeypatch, task_edges):
    edges = chain_of_edges(60, 4, 5)
    want, names = [], {}
    for _, part in edges.groupby("slice"):
        part = part.assign(a=[names.get(x, x) for x in part.a], b=[names.get(x, x) for x in part.b])
        want += part[["number", "a", "b"]].itertuples(index=False, name=None)
        moved = dict(H.names_after_slice(part).itertuples(index=False))
        names = {x: moved.get(y, y) for x, y in (names | {k: k for k in moved}).items()}
    monkeypatch.setattr(H, "TASK_EDGES", task_edges)
    got = H._renamed_ends(spark.createDataFrame(edges), 15, 4).select("number", "a", "b").collect()
    assert sorted(map(tuple, got)) == want


def test_halves_that_fit_a_task_need_no_contraction(spark, monkeypatch):
    monkeypatch.setattr(H, "components", None)
    assert H._renamed_ends(spark.createDataFrame(chain_of_edges(60, 4, 5)), 15, 4).count() == 60


@pytest.mark.parametrize("seed", range(12))
def test_slices_without_spark(seed):
    """Names, merges and notes of slices, put together in a loop, against the walk."""
    import pandas as pd

    rng = np.random.default_rng(seed)
    n, slice_edges, min_size = 80, int(rng.integers(1, 30)), int(rng.integers(2, 7))
    edges = pd.DataFrame([(int(rng.integers(max(0, k - 5), k)), k, float(rng.integers(1, 50))) for k in range(1, n)], columns=["lo", "hi", "weight"])
    edges = edges.sort_values(["weight", "lo", "hi"], kind="stable").reset_index(drop=True)
    states = {k: walk.Component(k) for k in range(n)}
    closed, joined, _ = walk.walk(list(zip(edges.lo, edges.hi, edges.weight, range(n - 1))), states, min_size)
    table = pd.DataFrame({"number": range(n - 1), "slice": np.arange(n - 1) // slice_edges, "a": -1 - edges.lo, "b": -1 - edges.hi, "weight": edges.weight})
    notes, sizes, names = [], {}, {}
    for _, part in table.groupby("slice"):
        part = part.assign(a=[names.get(x, x) for x in part.a], b=[names.get(x, x) for x in part.b])
        merges = H.merges_of_slice(part)
        known = lambda x: float(sizes[x]) if x in sizes else float("nan")
        merges = merges.assign(size_x=[known(x) for x in merges.x], size_y=[known(x) for x in merges.y])
        notes.append(H.condense_slice(min_size, slice_edges)(merges))
        moved = dict(H.names_after_slice(part).itertuples(index=False))
        names = {x: moved.get(y, y) for x, y in (names | {k: k for k in moved}).items()}
        size = lambda x: 1 if x < 0 else sizes[x]
        for row in merges.itertuples(index=False):
            sizes[row.number] = size(row.x) + size(row.y)
    notes = pd.concat(notes)
    pointer = {r.label: r for r in notes[notes.kind == "pointer"].itertuples()}

    def cluster_of(label):
        while label in pointer:
            r = pointer[label]
            if not pd.isna(r.cluster):
                return r.cluster
            label = r.via
        return None

    assert {(-1 - x, cluster_of(x)) for x in pointer if x < 0 and cluster_of(x) is not None} == set(joined)
    ref = lambda r: r.cluster if not pd.isna(r.cluster) else cluster_of(r.via)
    assert sorted((ref(r), r.parent, r.birth) for r in notes[notes.kind == "closed"].itertuples()) == sorted((c, into, w) for c, into, w, _, _ in closed)
    mass = {}
    for r in notes[notes.kind == "mass"].itertuples():
        mass[ref(r)] = mass.get(ref(r), 0) + int(r.amount)
    stable = {ref(r): mass[ref(r)] - r.size * H.density(r.birth) for r in notes[notes.kind == "closed"].itertuples()}
    leaves = set(stable) - {into for _, into, _, _, _ in closed}
    assert all(stable[c] / 2.0**40 == pytest.approx(best, abs=1e-6) for c, _, _, best, _ in closed if c in leaves)


def test_hierarchy_of_an_empty_tree(spark):
    assert H.flat_clusters(spark.createDataFrame([], S.EDGES), 2, 0.1).collect() == []


def test_best_stabilities_of_deep_and_wide_trees(spark):
    """Rake and compress against recursion."""
    from decimal import Decimal

    rng = np.random.default_rng(2)
    for deep in (True, False):
        rows, todo, name = [], [(1000, None, 0)], 999
        while todo and len(rows) < 61:
            me, parent, depth = todo.pop()
            rows.append((me, parent, None if parent is None else int(rng.integers(0, 50))))
            if len(rows) + len(todo) < 60 and (not deep or name % 2 or depth < 40):
                todo += [(name, me, depth + 1), (name - 1, me, depth + 1)] if not deep else [(name - 1, me, depth + 1), (name, me, depth + 1)]
                name -= 2
        rows += [(me, parent, int(rng.integers(0, 50))) for me, parent, _ in todo]
        children = {}
        for me, parent, _ in rows:
            children.setdefault(parent, []).append(me)
        own = {me: s or 0 for me, _, s in rows}

        def best(me):
            return max(own[me], sum(best(c) for c in children[me])) if me in children else own[me]

        df = spark.createDataFrame([(m, p, None if s is None else Decimal(s)) for m, p, s in rows], "cluster bigint, parent bigint, stability decimal(38,0)")
        for slice_edges in (1000, 7):
            assert {r.cluster: int(r.best) for r in H.best_stabilities(df, slice_edges).collect()} == {me: best(me) for me in own}


def test_contraction_by_rounds_alone(spark):
    rng = np.random.default_rng(3)
    edges = [(int(a), int(b), float(w)) for a, b, w in zip(*rng.integers(0, 40, (2, 60)), rng.integers(1, 9, 60)) if a != b]
    edges = [(min(a, b), max(a, b), w) for a, b, w in edges]
    df = spark.createDataFrame(edges, S.EDGES)
    forest, labels = S.contract(df, limit=0)
    want = S.minimum_spanning_forest(df)
    key = lambda f: sorted((r.weight, r.lo, r.hi) for r in f.collect())
    assert key(forest) == key(want)
    pairs = lambda f: sorted((r.node, r.component) for r in f.collect())
    assert pairs(labels) == pairs(S.components(df))


def test_selection_by_rounds_agrees(spark):
    rng = np.random.default_rng(8)
    n = 30
    rows = [(n, None, float("inf"), 0.0, False)]
    for c in range(n - 1, -1, -1):
        up = int(rng.integers(c + 1, min(n, c + 4) + 1))
        birth = 10.0 if up == n else next(r[2] for r in rows if r[0] == up) * float(rng.uniform(0.5, 1))
        rows.append((c, up, birth, 0.0, bool(rng.random() < 0.4)))
    df = spark.createDataFrame(rows, H.CLUSTERS)
    for radius in (0.0, 3.0):
        for slice_edges in (1000, 4):
            got = {r.cluster: r["at"] for r in H._resolve_in_rounds(df, radius, slice_edges).collect()}
            assert got == walk.resolve(rows, radius)


def test_all_noise_falls_back_to_kmeans(spark):
    x = np.eye(9)
    got = C.cluster_points(frame(spark, x), 0.0, 2, 5).collect()
    assert {r.cluster_id for r in got} <= {0, 1, 2} and len(got) == 9
    assert C.kmeans_k(4) == 2 and C.kmeans_k(100) == 10
    assert [r.cluster_id for r in C.cluster_points(frame(spark, x[:1])).collect()] == [-1]


def test_kmeans_sends_no_distances_of_centres_to_the_driver(spark):
    x = np.random.default_rng(3).normal(size=(400, 64))
    context = spark.sparkContext
    context.setJobGroup("kmeans-sends", "")
    try:
        C.kmeans_model(frame(spark, x), 130)
    finally:
        for name in ("spark.jobGroup.id", "spark.job.description"):
            context.setLocalProperty(name, None)
    tracker = context.statusTracker()
    stages = [tracker.getStageInfo(s) for j in tracker.getJobIdsForGroup("kmeans-sends") for s in tracker.getJobInfo(j).stageIds]
    names = {s.name for s in stages if s is not None}
    assert any("KMeans.scala" in n for n in names) and not any("DistanceMeasure.scala" in n for n in names)


def test_norm_is_taken_once_for_a_vector(spark):
    """Not for every coordinate, which takes time with the square of the dimension; odd vectors keep their values."""
    rows = [None, [], [0.0, 0.0], [3.0, 4.0], [None, 1.0], [float("inf"), 1.0]]
    found = spark.createDataFrame([(i, v) for i, v in enumerate(rows)], "pos bigint, vector array<float>").select("pos", l2_normalize(F.col("vector")).alias("u"))
    assert found._jdf.queryExecution().optimizedPlan().toString().count("aggregate(") == 1
    got = [r.u for r in found.orderBy("pos").collect()]
    assert got[:5] == [None, [], [0.0, 0.0], [0.6, 0.8], [None, 1.0]]
    assert np.isnan(got[5][0]) and got[5][1] == 0.0
