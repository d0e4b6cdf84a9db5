import json
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from foldwise.functions import identifiers as I
from foldwise.functions import text as T
from foldwise.operators import batching, cohesion, embedding, labels, ordering
from foldwise.sources import store


def assert_packed(ids, counts, budget):
    """Batches are runs of texts; no batch could take the text after it, and none holds one text too many."""
    sizes = np.maximum(counts, 1)
    assert len(ids) == len(sizes) and (len(ids) == 0 or ids[0] == 0)
    total = np.bincount(ids, sizes)
    for k in range(1, len(ids)):
        step, before = ids[k] - ids[k - 1], ids[k - 1]
        assert step in (0, 1)
        assert step == (total[before] >= budget or total[before] + sizes[k] > budget) if step else total[before] <= budget


def pack(spark, texts, budget, parts=3):
    rows = spark.createDataFrame(list(enumerate(texts)), "pos bigint, text string").repartition(parts)
    return [r.batch_id for r in batching.word_batches(rows, budget).orderBy("pos").collect()]


def test_word_batches_at_the_limits(spark):
    # exactly full; nothing fits behind two of three; a blank text counts one; larger than the budget; after it
    assert pack(spark, ["r s t", "u v", "w x", "\t", "a b c d", "e"], 3) == [0, 1, 2, 2, 3, 4]
    with pytest.raises(ValueError):
        pack(spark, ["text"], 0)


@pytest.mark.parametrize("seed", range(3))
def test_word_batches_match_the_rule(spark, seed):
    rng = random.Random(seed)
    counts = [rng.choice([0, 1, 2, 3, 9, 12, 30]) for _ in range(300)]
    budget = rng.choice([1, 5, 12])
    assert_packed(pack(spark, [" ".join(["w"] * n) for n in counts], budget, 4), counts, budget)


def test_batch_states_compose():
    rng = np.random.default_rng(0)
    for _ in range(300):
        budget = int(rng.integers(1, 12))
        counts = rng.integers(1, 15, size=int(rng.integers(1, 30)))
        cut = int(rng.integers(0, len(counts)))
        state, ids = (0, 0), []
        for part in (counts[:cut], counts[cut:]):
            if len(part):
                got, *state = batching._assign(part, budget, *state)
                ids += got.tolist()
                after, closed = batching._advance(part, budget, np.array([0]))
        assert_packed(ids, counts, budget)
        after, closed = batching._advance(counts, budget, np.arange(budget + 1))
        whole = batching._assign(counts, budget, 0, 0)
        assert (after[0], closed[0]) == (whole[1], whole[2])


def test_row_index_and_chunks(spark):
    rows = spark.range(1000).select(((F.col("id") * 7919) % 1000).alias("k")).repartition(7)
    got = ordering.with_row_index(rows, "k").collect()
    assert all(r.k == r.row_index for r in got)
    chunks = ordering.chunk_rows(rows, 96, "k").groupBy("chunk").count().orderBy("chunk").collect()
    assert [r["count"] for r in chunks] == [96] * 10 + [40]


def test_request_retry_and_shape():
    calls = []

    def flaky(texts):
        calls.append(len(texts))
        if len(calls) == 1:
            raise ConnectionError
        return [[1.0, 2.0]] * len(texts)

    assert embedding.request_with_retry(flaky, ["a"] * 5, delay=0, size=2).shape == (5, 2)
    assert calls == [2, 2, 2, 1]
    with pytest.raises(ConnectionError):
        embedding.request_with_retry(lambda t: (_ for _ in ()).throw(ConnectionError()), ["a"], delay=0)
    with pytest.raises(RuntimeError, match="asked for"):
        embedding.request_with_retry(lambda t: [], ["a"])
    with pytest.raises(RuntimeError, match="empty"):
        embedding.request_with_retry(lambda t: [[]], ["a"])


def test_embed_batches_sends_whole_batches(spark):
    rows = spark.createDataFrame([(f"c{i}", f"text {i}", i // 3) for i in range(10)], "id string, text string, batch_id bigint")

    class Sizes:
        def __call__(self, texts):
            return [[float(len(texts)), float(t.split()[1])] for t in texts]

    got = {r.id: r.vector for r in embedding.embed_batches(rows, Sizes).collect()}
    assert got == {f"c{i}": [1.0 if i == 9 else 3.0, float(i)] for i in range(10)}


def test_store(spark, tmp_path):
    path = str(tmp_path / "store")
    ids = spark.createDataFrame([("a",), ("b",), ("c",)], "id string")
    assert store.lookup(spark, path, ids).count() == 0

    def rows(*items):
        return spark.createDataFrame([(i, v, f"t{i}", None, 1.0, None, None) for i, v in items], store.SCHEMA)

    store.upsert(spark, path, rows(("a", [1.0, 0.0]), ("b", None), ("d", [0.0, 1.0])))
    store.upsert(spark, path, rows(("a", [0.5, 0.5])))
    assert {r.id: r.vector for r in store.lookup(spark, path, ids).collect()} == {"a": [0.5, 0.5]}
    assert store.read_store(spark, path).count() == 3
    with pytest.raises(ValueError, match="dimension"):
        store.upsert(spark, path, rows(("e", [1.0])))
    store.upsert(spark, path, spark.createDataFrame([("c", {"title": [0.25, 0.75]})], "id string, vectors map<string,array<float>>"))
    assert {r.id: r.vector for r in store.lookup(spark, path, ids).collect()} == {"a": [0.5, 0.5], "c": [0.25, 0.75]}
    named = spark.createDataFrame([(None, {"default": [0.5]}), ([1.0], None), (None, {})], "v array<float>, n map<string,array<float>>")
    assert [r[0] for r in named.select(F.expr(store.first_vector("v", "n"))).collect()] == [[0.5], [1.0], None]


def test_store_keeps_both_of_two_writers(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "store")
    monkeypatch.setattr(store, "next_step", lambda *_: 7)
    for name, x in (("a", 1.0), ("b", 2.0), ("a", 3.0)):
        store.upsert(spark, path, spark.createDataFrame([(name, [x]), (name, [x])], "id string, vector array<float>"))
    got = sorted((r.id, r.vector) for r in store.read_store(spark, path).collect())
    assert got == [("a", [3.0]), ("b", [2.0])]
    store.upsert(spark, path, spark.createDataFrame([("a", [5.0])], "id string, vector array<float>"), step=8)
    store.upsert(spark, path, spark.createDataFrame([("a", [6.0])], "id string, vector array<float>"), step=8)
    assert sorted((r.id, r.vector) for r in store.read_store(spark, path).collect()) == [("a", [6.0]), ("b", [2.0])]


def test_text_cohesion(spark):
    rows = [(0, [1.0, 1.0]), (0, [2.0, 2.0]), (1, [1.0, 0.0]), (2, [0.0, 0.0]), (2, [1.0, 0.0]), (3, [1.0, 0.0]), (3, [-1.0, 0.0])]
    got = cohesion.text_cohesion(spark.createDataFrame(rows, "cluster_id bigint, vector array<double>"))
    assert {r.cluster_id: round(r.cohesion_text, 9) for r in got.collect()} == {0: 1.0, 1: 0.0, 2: 0.0, 3: 0.0}


@pytest.mark.parametrize("segment_rows", [10**6, 7])
def test_temporal_cohesion(spark, segment_rows):
    day, base = 86400.0, 1.7e9
    rng = random.Random(1)
    times = {0: [base, base + day, base + 2 * day], 1: [None, None], 2: [base], 3: [base] * 9}
    times[4] = [base + rng.choice([0, 1e4, 1e7, 9e9]) * rng.random() for _ in range(60)]
    rows = [(c, i, None if i % 2 else t, t) for c, ts in times.items() for i, t in enumerate(ts)]
    df = spark.createDataFrame(rows, "cluster_id int, pos int, create_time double, update_time double").repartition(3)
    got = {r.cluster_id: r.cohesion_time for r in cohesion.temporal_cohesion(df, 30.0, segment_rows=segment_rows).collect()}
    for c, ts in times.items():
        ts = [t for t in ts if t is not None]
        pairs = [math.exp(-abs(a - b) / day / 30) for i, a in enumerate(ts) for b in ts[:i]]
        assert got[c] == pytest.approx(sum(pairs) / len(pairs) if pairs else 0.5, abs=1e-12)


def test_fallback_labels(spark):
    rows = [(0, 5, "late"), (0, 2, "  Hello, World! how are"), (1, 1, "   "), (2, 3, "?! ... x")]
    got = labels.fallback_labels(spark.createDataFrame(rows, "cluster_id bigint, pos bigint, title string"))
    got = {r.cluster_id: (r.label, r.project_folder_slug) for r in got.collect()}
    assert got == {0: ("Hello, World! how", "hello-world-how"), 1: ("Cluster 1", "cluster-1"), 2: ("?! ... x", "x")}


def replies(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "request_id bigint, reply string")


def test_label_replies(spark):
    good = {"cluster_id": 0, "label": "Delta", "project_folder_slug": "delta", "project_title": "", "confidence": 7}
    messy = f"Noise before {json.dumps([good, {'cluster': 'invalid'}])} trailing text"
    rows = labels.validate_labels(labels.reply_items(replies(spark, messy))).collect()
    assert [(r.cluster_id, r.label, r.project_title, r.confidence_model) for r in rows] == [(0, "Delta", "Delta", 1.0)]
    assert labels.reply_items(replies(spark, '{"cluster_id": 1}')).count() == 0
    with pytest.raises(Exception, match="did not return JSON"):
        labels.reply_items(replies(spark, "No JSON here")).collect()


def test_label_clusters_uses_model_or_falls_back(spark, capsys):
    rows = [(0, 0, "First title"), (0, 1, "Second"), (1, 2, "Third")]
    members = spark.createDataFrame(rows, "cluster_id bigint, pos bigint, title string")

    def model():
        def reply(request):
            return json.dumps(
                [{"cluster_id": c["cluster_id"], "label": c["titles"][0], "project_folder_slug": "s", "project_title": "P"} for c in json.loads(request)]
            )

        return reply

    got = {r.cluster_id: (r.label, r.confidence_model) for r in labels.label_clusters(members, model, per_request=1).collect()}
    assert got == {0: ("First title", 0.6), 1: ("Third", 0.6)}

    def broken():
        def reply(request):
            raise ConnectionError

        return reply

    got = labels.label_clusters(members, broken, delay=0).collect()
    assert {r.confidence_model for r in got} == {0.5} and "fallback" in capsys.readouterr().out


def test_identifiers(spark):
    rows = [("  ", "a/b c", "t"), (None, None, "--"), (None, None, " "), ("x.y_z-", "i", "t")]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i bigint, a string, b string, c string")
    got = df.select(F.expr(I.derive_identifier("a", "b", "c", "i")).alias("n")).collect()
    assert [r.n for r in got] == ["a-b-c", "conversation", "conversation-0002", "x.y_z"]
    assert spark.range(1).select(F.expr(I.numbered("12345"))).first()[0] == "12345"


def test_words_and_strip_follow_unicode_space(spark):
    samples = ["", " 　a b\x1cc ", "a​b", "\x85x\x0b", "plain"]
    df = spark.createDataFrame([(s,) for s in samples], "s string")
    got = df.select(F.expr(T.word_count("s")).alias("n"), F.expr(T.strip("s")).alias("t")).collect()
    assert [(r.n, r.t) for r in got] == [(len(s.split()), s.strip()) for s in samples]


def test_embedding_text(spark):
    df = spark.createDataFrame([("t", "e"), ("t", ""), ("t", None)], "a string, b string")
    assert [r[0] for r in df.select(F.expr(T.embedding_text("a", "b"))).collect()] == ["t\n\ne", "t", "t"]
