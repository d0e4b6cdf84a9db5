"""Phrase mining against brute force."""

import random
import re
from collections import Counter

import numpy as np
import pytest
from oracle import differences
from pyspark.sql import functions as F

from foldwise.llm import phrases
from foldwise.llm.oracles import ORACLES
from foldwise.llm.queries import QUERIES

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def counted(rows, longest=4):
    counts, words = Counter(), Counter()
    for lang, text in (("und" if a is None else a, b) for a, b in rows):
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", (text or "").translate(LOWER)):
            w = re.findall("[^ \t]+", piece)
            words[lang] += len(w)
            for k in range(1, longest + 1):
                counts.update((lang, tuple(w[i : i + k])) for i in range(len(w) - k + 1))
    return counts, words


def brute(rows, least, share, most, longest=4):
    counts, words = counted(rows, longest)
    candidates = {p: a for p, a in counts.items() if len(p[1]) > 1 and a >= least}
    best = {}
    for (lang, w), a in candidates.items():
        if any(
            100 * b >= share * a and other == lang and len(v) > len(w) and any(v[i : i + len(w)] == w for i in range(len(v) - len(w) + 1)) for (other, v), b in candidates.items()
        ):
            continue
        score, _, l, r = min((2000000 * a // (counts[lang, w[:k]] + counts[lang, w[k:]]), k, counts[lang, w[:k]], counts[lang, w[k:]]) for k in range(1, len(w)))
        best.setdefault(lang, []).append((-score, -a, " ".join(w).encode(), l, r))
    return sorted((lang, n, p.decode(), -a, l, r, words[lang], -s) for lang, found in best.items() for n, (s, a, p, l, r) in enumerate(sorted(found)[:most], 1))


def corpus(seed, n=400):
    rng = random.Random(seed)
    vocabulary = ["a", "B", "b", "the", "of", "é", "漢字", "x-y", "1", " ", "Z\x00"]
    rows = [
        (rng.choice(("en", "en", "en", None, "und", "de", "")), "".join(rng.choice(vocabulary) + rng.choice((" ", " ", " ", "  ", "\t", " \t ", ". ", ",", "\n", "!", " ? ", "\r\n")) for _ in range(rng.randrange(12))))
        for _ in range(n)
    ]
    return rows + [("en", None), ("en", ""), (None, None), ("fr", ".,;"), ("fr", "  "), ("en", "of the people " * 3000), ("de", "no break " * 200 + "a B")] + rows[:5]


@pytest.mark.parametrize("least, shards, most", [(3, 1, 2000), (5, 3, 2000), (9, 4, 7)])
def test_collocations_against_brute_force(spark, monkeypatch, least, shards, most):
    monkeypatch.setattr(phrases, "CHUNK_WORDS", 64)
    rows = corpus(least)
    df = spark.createDataFrame(rows, "lang string, text string").withColumn("phrase", F.lit("clash")).withColumn("shard", F.lit(1)).repartition(5)
    got = phrases.collocations(df, least=least, shards=shards, most=most, bits=1 << 15)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(map(tuple, got.collect())) == brute(rows, least, phrases.SHARE, most)


def test_a_full_field_costs_no_count(spark):
    """Bit fields so small that nearly everything passes still give the same counts."""
    rows = corpus(21)
    counts, words = counted(rows)
    df = spark.createDataFrame(rows, "lang string, text string").repartition(4)
    found, totals = phrases.count_phrases(df, least=6, bits=64)
    assert {(r.lang, tuple(r.phrase.split(" "))): r.f for r in found.collect()} == {p: a for p, a in counts.items() if a >= 6}
    assert {r.lang: r.n for r in totals.collect()} == {k: v for k, v in words.items() if v}


def test_late_phrases_complete_their_cycle(spark):
    """A word that reaches the threshold in the last shard starts its phrases in a second cycle."""
    rows = [("en", "rare pair of words")] * 4 + [("en", "other text")] * 20
    df = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "k int, lang string, text string").orderBy("k").coalesce(1)
    found, _ = phrases.count_phrases(df, least=4, shards=4)
    counts, _ = counted(rows)
    assert {tuple(r.phrase.split(" ")): r.f for r in found.collect()} == {p[1]: a for p, a in counts.items() if a >= 4}


def test_empty_table(spark):
    assert phrases.collocations(spark.createDataFrame([], "doc_id bigint, lang string, text string")).collect() == []
    assert phrases.collocations(spark.createDataFrame([("en", None), ("en", "a b")], "lang string, text string")).collect() == []


def test_parts_that_pass_64_bits(spark):
    """The score of counts near the end of 64 bits is exact."""
    a, l, r = 9 * 10**18, 9 * 10**18 + 1, 9 * 10**18 + 5
    got = spark.createDataFrame([(a, l, r)], "a bigint, l bigint, r bigint").selectExpr("(CAST(2000000 AS DECIMAL(7,0)) * CAST(a AS DECIMAL(19,0))) DIV (CAST(l AS DECIMAL(19,0)) + CAST(r AS DECIMAL(19,0)))").first()[0]
    assert got == 2000000 * a // (l + r)


def test_field_has_every_phrase(spark):
    texts = ["one", "one two", "one two three", "é 漢字 x y"]
    field = phrases._field(spark.createDataFrame([("en", t) for t in texts], "lang string, phrase string"), 1 << 16)
    import pyarrow as pa

    for t in texts:
        words = phrases._Words(pa.array(["en"]), pa.array([t])).hashes
        h = words[:1]
        for k in range(2, len(words) + 1):
            h = phrases._extend(h, words[k - 1 : k], k)
        assert phrases._within(field, h).all()
    assert not phrases._within(field, np.arange(1000, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).all()


def test_query_matches_sql_on_more_rows(spark):
    assert differences(spark, "/root/testdata/sf0.01", "op13_phrases", QUERIES, ORACLES) == ""
