"""Trained models: held-out accuracy, what they never see, and edge rows."""

import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from foldwise.llm import language, quality, sampling
from foldwise.llm.sampling import bounded_sample, held_out

DATA = "/root/testdata/sf0.01"


def held(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 5 == 0


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet(f"{DATA}/labels.parquet")


def test_held_out_rows(spark):
    got = spark.range(300).select("id", held_out("id").alias("h")).collect()
    assert all(r.h == held(r.id) for r in got)
    assert spark.range(1).select(held_out(F.lit(None).cast("bigint")).alias("h")).first().h is False


def test_sample_is_bounded(spark):
    rows = spark.range(20_000).withColumnRenamed("id", "doc_id")
    assert bounded_sample(rows, "doc_id", 30_000).count() == 20_000
    assert 800 < bounded_sample(rows, "doc_id", 1000).count() <= 1200


def test_language_accuracy_and_edges(spark, docs):
    network = language.fit(docs)
    got = {r.doc_id: r for r in language.identify(docs, network=network).collect()}
    truth = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    out = [k for k in truth if held(k)]
    assert all(got[k].held_out == held(k) for k in truth)
    assert np.mean([got[k].lang_pred == truth[k] for k in out]) > 0.97
    french = docs.where("lang = 'fr'").orderBy("doc_id").first().text
    rows = [(1, None, "en"), (2, "", "fr"), (3, "12 34 !!", None), (4, "x", None), (None, "the of and", None), (6, french * (2_000_000 // len(french)), None), (4, "x", None)]
    edge = spark.createDataFrame(rows, "doc_id bigint, text string, lang string").withColumn("lettered", F.lit(3)).withColumn("score", F.lit("clash"))
    found = language.identify(edge, network=network).collect()
    assert len(found) == 7 and all(0 <= r.score <= 1 for r in found)
    by = {r.doc_id: (r.lang_pred, r.score) for r in found}
    assert by[1] == by[2] == by[3] == ("und", 0.0) and by[6][0] == "fr" and by[4][0] in network.languages
    assert {r.lang_pred for r in language.identify(edge.where("lang is null")).collect()} == {"und"}
    assert language.identify(docs.limit(0)).collect() == []
    kept = language.filter_known(edge, network, 0.0)
    assert kept.columns == edge.columns and sorted(r.doc_id or 0 for r in kept.collect()) == [0, 4, 4, 6]


def test_language_is_blind_to_other_columns(docs):
    network = language.fit(docs)
    changed = docs.withColumn("lang", F.when(held_out(), F.lit("xx")).otherwise(F.col("lang"))).withColumn("source", F.lit("other"))
    again = language.fit(changed)
    assert again.languages == network.languages and np.array_equal(again.filters, network.filters)


def test_windows_cover_whole_texts():
    texts = ["a" * 600, None, "", "é" * 200, "b"]
    from foldwise.llm import bytetext

    data, offsets = bytetext.flat(pa.array(texts))
    rows, text, size = language.windows(data, offsets)
    joined = {t: b"".join(r[:s].tobytes() for r, x, s in zip(rows, text, size) if x == t) for t in range(len(texts))}
    assert [joined[k].decode() for k in range(len(texts))] == [t or "" for t in texts]


def test_quality_accuracy_and_edges(spark, docs, labels):
    got = {r.doc_id: r for r in quality.classify(docs, labels).collect()}
    truth = {r.doc_id: r.quality for r in labels.collect()}
    out = [k for k in truth if held(k)]
    assert np.mean([got[k].predicted == truth[k] for k in out]) > 0.97
    assert all(got[k].held_out == held(k) and got[k].predicted == int(got[k].score >= 0.3) for k in got)
    rows = [(1, None), (2, ""), (3, "word"), (None, "good words here"), (5, "lorem ipsum " * 200_000), (3, "word")]
    edge = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("label", F.lit("clash")).withColumn("score", F.lit("clash"))
    found = quality.classify(edge, labels).collect()
    assert len(found) == 6 and all(0 <= r.score <= 1 for r in found)
    assert {r.score for r in quality.classify(edge, labels.limit(0)).collect()} != set()
    assert quality.classify(docs.limit(0), labels).collect() == []
    machine = quality.fit(docs, labels)
    good = quality.filter_good(edge, machine, 0.0)
    assert good.columns == edge.columns and good.count() == 6


def test_machine_matches_all_pairs():
    """The identity's score is the sum over all pairs of features."""
    rng = np.random.default_rng(2)
    machine = quality.Machine()
    machine.linear[:] = rng.normal(size=machine.linear.shape)
    machine.factors[:] = rng.normal(size=machine.factors.shape) * 0.1
    rows, slots, amounts, stats = quality.features(pa.array(["one two two three. One!", "", None, "four"]))
    got = machine.margin(rows, slots, amounts, stats)
    r, s, x, n = machine._inputs(rows, slots, amounts, stats)
    for text in range(n):
        at = np.flatnonzero(r == text)
        want = machine.bias + sum(machine.linear[s[k]] * x[k] for k in at)
        want += sum(machine.factors[s[a]] @ machine.factors[s[b]] * x[a] * x[b] for i, a in enumerate(at) for b in at[i + 1 :])
        assert got[text] == pytest.approx(float(want), abs=1e-4)


def test_rare_language_is_learnt_at_every_size(spark):
    """A few texts among many are no matter of luck in the sample."""
    rows = [(k, f"the and of text {k}", "en") for k in range(4000)] + [(k, f"der die das und {k}", "de") for k in range(9000, 9003)] + [(k, f"le la les et {k}", "fr") for k in range(9500, 9600)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    network = language.fit(docs, 200)
    assert network.languages == ["de", "en", "fr"]
    picked = sampling.sample_of_each(docs, "lang", ("doc_id", "text"), 200, 50).groupBy("lang").count().collect()
    counts = {r["lang"]: r["count"] for r in picked}
    assert counts["de"] == 3 and 30 < counts["en"] < 110 and 30 < counts["fr"] < 101
    same = spark.createDataFrame([(1, "same", "en")] * 300 + [(2, "other", "de")] * 300, docs.schema)
    assert {r.lang for r in sampling.sample_of_each(same, "lang", ("doc_id", "text"), 4, 1).distinct().collect()} == {"de", "en"}
