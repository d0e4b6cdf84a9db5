"""Near-duplicate groups and leaks against brute force, and their edge cases."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from foldwise.llm import bytetext, decontaminate, graph, near_dups
from foldwise.llm.graph import components
from foldwise.session import materialise

SCHEMA = "doc_id bigint, text string"
WORDS = [f"w{k}" for k in range(400)]


def shingle_set(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall("[^\x20\x09-\x0D]+", low)
    if len(words) < 5:
        return {tuple(words)} if words else set()
    return {tuple(words[k : k + 5]) for k in range(len(words) - 4)}


def brute_groups(rows):
    sets = [shingle_set(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            linked = sets[a] and 100 * both >= 85 * (len(sets[a]) + len(sets[b]) - both)
            if linked or rows[a][0] == rows[b][0] and rows[a][0] is not None and sets[a] and sets[b]:
                root[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[find(k)] = min(i, least.get(find(k), i))
    return sorted((i, len(sets[k]), least.get(find(k))) for k, (i, _) in enumerate(rows))


def corpus(seed=0):
    """Texts with copies, light and heavy edits of one base, chains of edits, and a passage many share."""
    rng = random.Random(seed)
    base = rng.choices(WORDS, k=150)
    passage = rng.choices(WORDS, k=40)
    texts = []
    for k in range(60):
        words = list(base)
        for _ in range(rng.choice([0, 0, 1, 1, 2, 3, 4, 6])):
            words[rng.randrange(len(words))] = f"new{rng.random()}"
        texts.append(" ".join(words))
    chain = rng.choices(WORDS, k=120)
    for _ in range(12):
        chain = list(chain)
        chain[rng.randrange(len(chain))] = f"link{rng.random()}"
        texts.append(" ".join(chain))
    texts += [" ".join(passage + rng.choices(WORDS, k=rng.randrange(5, 80))) for _ in range(40)]
    texts += ["", " \t\n", "one", "ONE", "one two three four", "One  two\tthree four", "Ünï one", "ünï one"]
    texts += [texts[3].upper()] * 3
    rng.shuffle(texts)
    return list(enumerate(texts, 10)) + [(500, None)]


@pytest.mark.parametrize("seed", [0, 1])
def test_groups_match_brute_force(spark, seed):
    rows = corpus(seed)
    got = near_dups.near_groups(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute_groups(rows)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_groups_edge_rows(spark):
    long_text = " ".join(f"t{k % 7919}" for k in range(300_000))
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (None, None), (2, None), (3, ""), (4, long_text), (5, long_text + " tail")]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("set_a", F.lit("clash")).withColumn("component", F.lit(1)).withColumn("rep", F.lit(2))
    got = sorted(((r.doc_id is not None, r.doc_id, r.component_id, r.kept) for r in near_dups.near_groups(df).collect()), key=repr)
    assert got == sorted([(True, 1, 1, True)] * 2 + [(False, None, 1, False), (False, None, None, True), (True, 2, 2, True), (True, 3, 3, True), (True, 4, 4, True), (True, 5, 4, False)], key=repr)
    assert near_dups.near_groups(df.limit(0)).collect() == []


def test_words_and_shingles_of_pieces(monkeypatch):
    monkeypatch.setattr(bytetext, "PIECE_BYTES", 7)
    texts = ["Ab cd  ef\tgh", "", None, "x", "nospaceatallinthisverylongword end", "é ü Ñ", "a b c d e f g"]
    hashes, starts, bounds = bytetext.words(*bytetext.flat(pa.array(texts)))
    whole = [re.findall("[^\x20\x09-\x0D]+", (t or "").replace("A", "a")) for t in texts]
    assert np.diff(bounds).tolist() == [len(w) for w in whole]
    flat = [w for ws in whole for w in ws]
    assert len(set(hashes.tolist())) == len(set(flat))
    _, runs = bytetext.shingles(hashes, bounds)
    assert np.diff(runs).tolist() == [1, 0, 0, 1, 1, 1, 3]


def test_components(spark):
    rng = random.Random(5)
    edges = [(k, k + 1) for k in range(1, 30)] + [(100, k) for k in range(101, 140)] + [(200, 200), (None, 3), (139, 300)] + [(rng.randrange(400, 420), rng.randrange(400, 420)) for _ in range(15)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert all(got[k] == 1 for k in range(2, 31)) and all(got[k] == 100 for k in range(101, 140)) and got[300] == 100
    assert 200 not in got and components(spark.createDataFrame([], "a bigint, b bigint")).collect() == []


def test_stars_need_no_round(spark, monkeypatch):
    """Each round is a table on disk, so a graph of stars is told from its edges, and a tree without one more round."""
    made = []
    monkeypatch.setattr(graph, "materialise", lambda df: made.append(1) or materialise(df))
    stars = [(100, k) for k in range(101, 130)] + [(k, 200) for k in range(201, 230)] + [(101, 100), (7, None), (9, 9)]
    got = {r.node: r.root for r in components(spark.createDataFrame(stars, "a bigint, b bigint")).collect()}
    assert got == {k: 100 for k in range(101, 130)} | {k: 200 for k in range(201, 230)} and len(made) == 1
    made.clear()
    got = {r.node: r.root for r in components(spark.createDataFrame([*stars, (129, 229)], "a bigint, b bigint")).collect()}
    assert got == {k: 100 for k in [*range(101, 130), *range(200, 230)]} and len(made) <= 4


def test_buckets_of_one_id_for_all(spark):
    """Sets of one doc_id have one rep; each has its own table keys, not those of every pair of them."""
    rows = [(7, 9, k, list(range(near_dups.BANDS)), [k * 100 + j for j in range(near_dups.BANDS)]) for k in range(20)]
    heads = spark.createDataFrame(rows, "rep bigint, n bigint, set_a bigint, first array<bigint>, second array<bigint>")
    assert near_dups._buckets(heads).count() == 20 * near_dups.BANDS**2


def brute_leaks(docs, items, similarity):
    out = set()
    for doc_id, text in docs:
        words = re.findall("[^\x20\x09-\x0D]+", (text or "").lower())
        for item_id, item in items:
            own = re.findall("[^\x20\x09-\x0D]+", (item or "").lower())
            if not own or not words:
                continue
            size = min(len(own), len(words))

            def runs(ws):
                return [tuple(ws[k : k + 5]) for k in range(len(ws) - 4)] if len(ws) >= 5 else [tuple(ws)]

            best = 0
            for k in range(len(words) - size + 1):
                a, b = runs(words[k : k + size]), runs(own)
                kinds = set(a) | set(b)
                best = max(best, sum(min(a.count(x), b.count(x)) for x in kinds) / sum(max(a.count(x), b.count(x)) for x in kinds))
            if best >= similarity:
                out.add((doc_id, item_id, round(best, 9)))
    return out


def test_leaks_match_brute_force(spark):
    rng = random.Random(3)
    items = [(k, " ".join(rng.choices(WORDS, k=rng.choice([3, 8, 20, 40, 60])))) for k in range(30)] + [(90, None), (91, ""), (92, "Same same same same same same same same")]
    docs = []
    for k in range(80):
        words = rng.choices(WORDS, k=rng.randrange(1, 200))
        if k % 3 == 0:
            leak = rng.choice(items[:30])[1].upper().split()
            if k % 2:
                leak[rng.randrange(len(leak))] = "edited"
            at = rng.randrange(len(words))
            words[at:at] = leak
        docs.append((k, " ".join(words)))
    docs += [(200, None), (201, ""), (202, "same " * 50), (203, items[3][1]), (204, " ".join(items[4][1].split()[:-1]))]
    benchmark = spark.createDataFrame(items, "item_id bigint, text string").withColumn("doc_id", F.lit(0))
    df = spark.createDataFrame(docs, SCHEMA).withColumn("item_id", F.lit("clash"))
    got = {(r.doc_id, r.item_id, round(r.similarity, 9)) for r in decontaminate.find_leaks(df, benchmark).collect()}
    want = brute_leaks(docs, items, 0.8)
    assert got == want and len(want) > 15
    clean = decontaminate.without_leaks(df, benchmark)
    assert clean.columns == df.columns
    assert sorted(r.doc_id for r in clean.collect()) == sorted({d for d, _ in docs} - {d for d, _, _ in want})
    assert decontaminate.find_leaks(df.limit(0), benchmark).collect() == [] and decontaminate.find_leaks(df, benchmark.limit(0)).collect() == []


def test_leaks_in_slices(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "SLICE_BYTES", 60)
    items = [(k, " ".join(WORDS[k * 9 : k * 9 + 9])) for k in range(20)]
    docs = [(k, "x y " + t + " z") for k, t in items]
    got = decontaminate.find_leaks(spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(items, "item_id bigint, text string")).collect()
    assert sorted((r.doc_id, r.item_id) for r in got) == [(k, k) for k in range(20)]


def test_blocks_find_all_within_radius():
    rng = np.random.default_rng(0)
    bits = lambda x: np.unpackbits(x.view(np.uint8).reshape(len(x), -1), axis=1)
    prints = rng.integers(0, 1 << 63, (200, 4), dtype=np.uint64) * np.uint64(2) + rng.integers(0, 2, (200, 4), dtype=np.uint64)
    flips = np.zeros((50, 256), np.uint8)
    for row in flips:
        row[rng.choice(256, decontaminate.RADIUS, replace=False)] = 1
    near = np.packbits(bits(prints[:50]) ^ flips, axis=1).view(np.uint64)
    index = decontaminate.Index([0], ["a b c d e f"])
    index.by_size[6] = {"prints": (prints, prints), "members": np.arange(200)}
    found = {(item, int(at)) for item, places in index.within(6, (near, near)) for at in places}
    apart = (bits(prints)[:, None, :] != bits(near)[None, :, :]).sum(-1)
    assert found == {(int(i), int(j)) for i, j in zip(*np.nonzero(apart <= decontaminate.RADIUS))} and len(found) >= 50
    other = rng.integers(0, 1 << 63, (2000, 4), dtype=np.uint64)
    assert decontaminate.sifted(other[:1000], other[1000:]).mean() < 0.05


def test_fingerprints_of_windows_one_by_one():
    rng = np.random.default_rng(1)
    shingles = rng.integers(0, 9, 60).astype(np.uint64)
    starts = np.array([0, 1, 5, 30, 48])
    both = decontaminate.simhash(shingles, starts, 12)
    for k, start in enumerate(starts):
        window = shingles[start : start + 12]
        for kind, counted in enumerate((window, np.unique(window))):
            want = np.packbits(decontaminate._signs(counted).sum(0) > 0).view(np.uint64)
            assert (both[kind][k] == want).all()


@pytest.mark.parametrize("size", [20, 54, 104, 204, 404, 500])
def test_passages_beside_runs_of_one_word(size):
    """A passage at the start or end of a text, beside a run of one word, or held together by one: no link is lost."""
    import pyarrow as pa

    rng, lost, found = random.Random(size), 0, 0
    for trial in range(40):
        words = [f"w{rng.randrange(10**6)}" for _ in range(size)]
        if trial % 4 == 3:
            words[: size // 2] = ["same"] * (size // 2)
        common = max(5, round(size * rng.choice((0.89, 0.9, 0.92, 0.95))))
        run = ["run"] * (size - common) if trial % 2 else (["run", "walk"] * size)[: size - common]
        text = words[:common] + run if trial % 4 < 2 else run + words[size - common :]
        index = decontaminate.Index([7], [" ".join(words)])
        search = decontaminate._Search(index, decontaminate.SIMILARITY)
        hashes, _, bounds = decontaminate.B.words(*decontaminate.B.flat(pa.array([" ".join(text)])))
        exact = decontaminate.weighted_similarity(decontaminate.B.shingles(hashes, bounds)[0], index.of(0))
        got = [m for _, matches in search.found(pa.array([" ".join(text)])) for m in matches]
        found += exact >= 0.8
        lost += exact >= 0.8 and not got
        assert exact >= 0.8 or not got
    assert lost == 0 and found >= 10


def test_repeated_rows_and_one_id_for_all(spark):
    item = " ".join(f"t{k}" for k in range(300))
    rows = [(1, item)] * 3 + [(1, "else " * 40), (None, "before " + item + " after")]
    df, benchmark = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame([(5, item)] * 2, "item_id bigint, text string")
    got = decontaminate.find_leaks(df, benchmark).collect()
    assert sorted((r.doc_id or 0, r.item_id) for r in got) == [(0, 5)] + [(1, 5)] * 3
    assert [r.text for r in decontaminate.without_leaks(df, benchmark).collect()] == ["else " * 40]
