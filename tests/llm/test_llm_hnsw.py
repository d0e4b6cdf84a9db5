"""Nearest neighbours against brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from foldwise.llm import hnsw
from foldwise.llm.queries import QUERIES


def brute(rows, chosen, k=5):
    """query_id -> [(vec_id, score)] over rows (vec_id, vector) with distinct ids."""
    out = {}
    halved = lambda v: v / 2.0 ** np.frexp(np.abs(v).max())[1]  # noqa: E731  so that no square overflows
    use = [(i, halved(np.array(v, np.float64))) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    for i, q in use:
        if chosen(i):
            found = [(-float(q @ v / np.sqrt((q @ q) * (v @ v))), j) for j, v in use if j != i and len(v) == len(q)]
            out[i] = sorted(found)[:k]
    return out


def collected(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r["rank"])):
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r["rank"] == len(out[r.query_id])
    return out


def recall(got, want):
    return np.mean([j in {v for v, _ in got.get(q, [])} for q, found in want.items() for _, j in found])


def test_few_vectors_are_found_exactly(spark):
    rng = random.Random(1)
    rows = [(i, [rng.gauss(0, 1) for _ in range(6)]) for i in range(120)]
    rows += [(200, None), (201, []), (202, [0.0] * 6), (203, [1.0, None, 0, 0, 0, 0]), (204, [float("nan")] * 6), (205, [float("inf"), 0, 0, 0, 0, 0]), (None, [1.0] * 6)]
    rows += [(300 + i, [1.0, 2.0, 3.0, -0.0, 0.0, 5.0]) for i in range(40)]  # copies, more than a result holds
    rows += [(400, [1e200, 2e200, 3e200, 0, 0, 5e200]), (401, [1e-300, 0, 0, 0, 0, 0]), (500, [3.0, 4.0]), (501, [4.0, 3.0]), (550, [1.0, 1.0])]
    rows = [(i, v and [x if x is None else float(x) for x in v]) for i, v in rows]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").withColumn("node", F.lit(1)).repartition(3)
    got = collected(hnsw.nearest_neighbours(df.unionByName(df.limit(9)), F.col("vec_id") % 5 == 0))
    want = brute(rows, lambda i: i % 5 == 0)
    assert set(got) == {q for q, found in want.items() if found}
    for q, found in want.items():
        assert np.allclose([s for _, s in got[q]], [-s for s, _ in found], atol=1e-12) and len(got[q]) == len(found)
    assert [v for v, _ in got[300]] == [301, 302, 303, 304, 305] and [v for v, _ in got[335]] == [300, 301, 302, 303, 304]
    assert [v for v, _ in got[500]] == [550, 501]


def test_an_id_with_several_vectors(spark):
    rows = [(1, [1.0, 0.0]), (1, [0.0, 1.0]), (50, [0.0, 2.0]), (2, [1.0, 1.0]), (50, [0.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    got = collected(hnsw.nearest_neighbours(df, F.col("vec_id") == 50))
    assert got[50][0] == (1, 1.0) and [v for v, _ in got[50]] == [1, 2]


def test_empty_tables(spark):
    df = spark.createDataFrame([], "vec_id bigint, embedding array<float>")
    assert hnsw.nearest_neighbours(df, F.lit(True)).collect() == []
    one = spark.createDataFrame([(50, [1.0, 2.0])], "vec_id bigint, embedding array<float>")
    assert hnsw.nearest_neighbours(one, F.lit(True)).collect() == []


def test_recall_over_many_shards(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select("vec_id", "embedding").collect()]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").repartition(4)
    got = collected(hnsw.nearest_neighbours(df, F.col("vec_id") % 7 == 0, shard_rows=300))
    want = brute(rows, lambda i: i % 7 == 0)
    assert recall(got, want) >= 0.98 and all(len(got[q]) == 5 for q in want)


@pytest.mark.parametrize("spread", [0.01, 0.2])
def test_recall_in_one_graph_of_clusters(spread):
    """Tight clusters and vectors of one direction, which graphs are prone to lose."""
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(60, 24))
    points = centres[rng.integers(60, size=5000)] + spread * rng.normal(size=(5000, 24))
    points[:1000] = centres[0] * rng.uniform(0.5, 2, size=(1000, 1)) + 1e-9 * rng.normal(size=(1000, 24))
    order, sizes = hnsw.order_and_sizes(np.arange(5000))
    unit = (points / np.linalg.norm(points, axis=1)[:, None])[order].astype(np.float32)
    links = hnsw.build(unit, sizes)
    assert [len(x) for x in links] == sizes and all(((x >= -1) & (x < len(x))).all() for x in links)
    asked = unit[1000:1400] + 0.05 * rng.normal(size=(400, 24)).astype(np.float32)
    asked /= np.linalg.norm(asked, axis=1)[:, None]
    found = hnsw.search(unit, links, asked)
    exact = asked @ unit.T
    fifth = np.sort(exact, axis=1)[:, -5]
    value = np.take_along_axis(exact, found, 1)
    assert ((value >= fifth[:, None] - 1e-6).sum(1).clip(max=5) / 5).mean() >= 0.95


def test_levels_hold_every_node_once():
    order, sizes = hnsw.order_and_sizes(np.arange(3000))
    assert sorted(order) == list(range(3000)) and sizes[0] == 3000 and sizes == sorted(sizes, reverse=True) and 100 < sizes[1] < 300


def test_query_against_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").select("vec_id", "embedding").collect()]
    df = QUERIES["op11_neighbours"](spark, "/root/testdata/sf0.01")
    assert [(f.name, f.dataType.simpleString()) for f in df.schema] == [("query_id", "bigint"), ("rank", "int"), ("vec_id", "bigint"), ("score", "double")]
    got, want = collected(df), brute(rows, lambda i: i % 50 == 0)
    assert set(got) == set(want) and recall(got, want) >= 0.98
    for q in want:
        scores = [s for _, s in got[q]]
        assert scores == sorted(scores, reverse=True) and len(scores) == 5
