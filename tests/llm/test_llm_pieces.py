"""Segmentation against the library's lattice, the chunked scan against the whole, and exact round trips."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from foldwise.llm import bytetext, pieces

SCHEMA = "doc_id bigint, text string"
TEXTS = ["", " ", "a", "the of and", "  two  spaces ", "tab\there\nline\n\nend\n", "日本語のテキスト", "🙂🙂 mixed é", "x" * 90, "\n", "\u0000 odd ​", "Ñandú über große"]


@pytest.fixture(scope="module")
def vocabulary():
    with open(pieces.MODEL, "rb") as f:
        return pieces.Vocabulary(f.read())


def best_score(vocabulary, text):
    """Plain dynamic program over characters."""
    text = " " + text if text else ""
    known = {b.decode("utf-8", "ignore"): k for k, b in enumerate(vocabulary.bytes_of) if b and k not in set(vocabulary.byte_ids.tolist())}
    best = [0.0] + [-np.inf] * len(text)
    for end in range(1, len(text) + 1):
        for size in range(1, min(end, vocabulary.longest) + 1):
            piece = text[end - size : end]
            score = vocabulary.scores[known[piece]] if piece in known else vocabulary.unknown_score if size == 1 else -np.inf
            best[end] = max(best[end], best[end - size] + score)
    return best[-1]


def score_of(vocabulary, ids):
    """Total of the ids; the bytes of one unknown character count once."""
    data = [vocabulary.bytes_of[k][0] if k in set(vocabulary.byte_ids.tolist()) else None for k in ids]
    return sum(vocabulary.unknown_score * ((b & 0xC0) != 0x80) if b is not None else vocabulary.scores[k] for k, b in zip(ids, data))


def test_best_score_and_round_trip(vocabulary):
    ids, bounds = pieces.encode_batch(vocabulary, *bytetext.flat(pa.array([*TEXTS, None])))
    for k, text in enumerate(TEXTS):
        own = ids[bounds[k] : bounds[k + 1]].tolist()
        assert score_of(vocabulary, own) == pytest.approx(best_score(vocabulary, text), abs=1e-6)
    data, offsets = pieces.decode_batch(vocabulary, ids.astype(np.int64), bounds)
    assert [data[a:b].tobytes().decode() for a, b in zip(offsets[:-1], offsets[1:])] == [*TEXTS, ""]


def test_agrees_with_the_library(vocabulary):
    """The library's lattice over the same pieces and scores finds paths of the same total."""
    import duckdb
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2

    model = sentencepiece_model_pb2.ModelProto()
    with open(pieces.MODEL, "rb") as f:
        model.ParseFromString(f.read())
    model.trainer_spec.model_type = 1
    for piece, score in zip(model.pieces, vocabulary.scores):
        piece.score = score
    library = sentencepiece.SentencePieceProcessor(model_proto=model.SerializeToString())
    lines = [t for (text,) in duckdb.sql("SELECT text FROM '/root/testdata/sf0.001/documents.parquet'").fetchall() for t in text.split("\n") if 0 < len(t) < 300]
    ids, bounds = pieces.encode_batch(vocabulary, *bytetext.flat(pa.array(lines)))
    same = 0
    for k, line in enumerate(lines):
        own, theirs = ids[bounds[k] : bounds[k + 1]].tolist(), library.nbest_encode_as_ids(line, 1)[0]
        same += own == theirs
        assert vocabulary.scores[own].sum() == pytest.approx(vocabulary.scores[theirs].sum(), abs=1e-3)
    assert same > 0.95 * len(lines)


def test_scan_of_chunks(vocabulary):
    rng = random.Random(1)
    texts = [" " + "".join(rng.choices("aeinstr", k=700)), " " + "the cat " * 60, " " * 500 + "x", " " + "abcabc" * 100]
    for text in texts:
        codes = np.frombuffer(text.encode("utf-32-le"), np.int32)
        for chunk in (16, 37, 128):
            sizes = np.array([min(chunk, len(codes) - k) for k in range(0, len(codes), chunk)])
            rows = [codes[k : k + chunk + vocabulary.longest - 1] for k in range(0, len(codes), chunk)]
            padded = pieces._padded(np.concatenate(rows), np.array([len(r) for r in rows]))
            matrices = pieces.transfer(vocabulary, padded, sizes)
            whole = pieces.scan(matrices)[-1][0, 0]
            assert whole == pytest.approx(best_score(vocabulary, text[1:]), abs=1e-6)
            turns = matrices[0]
            for m in matrices[1:]:
                turns = pieces.times(turns[None], m[None])[0]
            assert np.array_equal(turns, pieces.scan(matrices)[-1])


def test_giant_texts_in_chunks(spark, vocabulary):
    rng = random.Random(2)
    giants = ["".join(rng.choices("aeinstr ", k=3000)), "".join(rng.choices("abcdefgh", k=2500)), "日本" * 700, "word " * 900, "\n" * 1200]
    rows = [(k, t) for k, t in enumerate(giants)] + [(0, giants[0]), (7, "small"), (8, None), (9, ""), (None, giants[1])]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("key", F.lit("clash")).withColumn("chunk", F.lit(1)).withColumn("ids", F.lit("x"))
    got = pieces.decode(pieces.encode(df, chunk=64, giant=500)).collect()
    assert sorted(((r.doc_id is None, r.doc_id, r.decoded) for r in got), key=repr) == sorted(((i is None, i, t or "") for i, t in rows), key=repr)
    for r in got:
        assert score_of(vocabulary, r.ids) == pytest.approx(best_score(vocabulary, r.decoded), abs=1e-4)
    assert all(r.same for r in pieces.round_trip(df).collect())
    assert pieces.encode(df.limit(0)).collect() == []


def test_space_marks_in_text_come_back(spark):
    got = pieces.round_trip(spark.createDataFrame([(1, "a▁b"), (2, "a b")], SCHEMA)).collect()
    assert {r.doc_id: r.same for r in got} == {1: True, 2: True}
