"""Benchmark items that stand in documents, by SimHash of item-sized windows.

Every run of as many words as an item has is a window.  Windows and items are fingerprinted from their five-word
shingles in ``BITS`` bits, twice: with the multiplicity of each shingle, and with each distinct one counted once.  Fingerprints
are cut into ``BLOCKS`` blocks, so two within ``RADIUS`` are within ``RADIUS // BLOCKS`` in at least one block; the blocks sift the
pairs, the whole distance decides.  A window that is near an item by either fingerprint is a candidate.  Candidates are then
measured exactly: the sum of the smaller over the sum of the larger multiplicity of each shingle must reach the similarity.

Windows that cannot pass that measure, because too few of their shingles occur in any item, are left out before
fingerprinting; the shared weight can't exceed that number.

Two windows of distinct shingles at similarity 0.8 differ in 39 of 256 bits on average, with a deviation of 5.7.  Where one
shingle holds much of what differs (a run of one word) fingerprints by multiplicity lie far apart and those of
distinct shingles near; where one shingle holds much of what is common it is the other way round.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldwise.llm import bytetext as B

SIMILARITY = 0.8
BITS, BLOCKS = 256, 4
#: The largest that leaves its blocks within 18 of 64 bits, which one of 800 pairs of other fingerprints is in some block.
RADIUS = 75
#: Bytes of item text that one pass over the documents holds in each task.
SLICE_BYTES = 8 << 20
MATCHES = "doc_id bigint, item_id bigint, similarity double, first_word bigint, n_words bigint, n_windows bigint"


def _signs(shingles: np.ndarray) -> np.ndarray:
    """A row of BITS values +1 or -1 for each shingle."""
    mixed = np.stack([B.mix(shingles, 5 + k) for k in range(BITS // 64)], axis=1)
    return np.unpackbits(mixed.view(np.uint8).reshape(len(shingles), -1), axis=1).astype(np.int32) * 2 - 1


def _packed(sums: np.ndarray) -> np.ndarray:
    return np.packbits(sums > 0, axis=1).view(np.uint64)


def simhash(shingles: np.ndarray, starts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Two fingerprints of each window of ``length`` shingles at ``starts``: by multiplicity, and of distinct shingles.

    A shingle is counted once by taking off, for each repeat, the windows that also hold the occurrence before it.
    Both are one array where no window holds a repeat.
    """
    signs = _signs(shingles)
    total = np.zeros((len(shingles) + 1, BITS), np.int32)
    np.cumsum(signs, axis=0, out=total[1:])
    sums = total[starts + length] - total[starts]
    order = np.argsort(shingles, kind="stable")
    again = np.flatnonzero(shingles[order[1:]] == shingles[order[:-1]])
    later, earlier = order[again + 1], order[again]
    near = later - earlier < length
    later, earlier = later[near], earlier[near]
    once = _packed(sums)
    if not len(later):
        return once, once
    taken = np.zeros((len(shingles) + 1, BITS), np.int32)
    np.add.at(taken, np.maximum(later - length + 1, 0), signs[later])
    np.subtract.at(taken, earlier + 1, signs[later])
    np.cumsum(taken, axis=0, out=taken)
    return once, _packed(sums - taken[starts])


class Index:
    """Items of one slice: their shingles, and for each number of words the items and their fingerprints."""

    def __init__(self, item_ids: list[int], texts: list[str]):
        hashes, _, bounds = B.words(*B.flat(pa.array(texts, pa.string())))
        self.shingles, self.bounds = B.shingles(hashes, bounds)
        self.item_ids, self.words = item_ids, np.diff(bounds)
        self.known = np.unique(self.shingles)
        self.seen = np.zeros(1 << 20, bool)
        self.seen[self.known & np.uint64((1 << 20) - 1)] = True
        self.by_size: dict[int, dict] = {}
        for size in np.unique(self.words[self.words > 0]):
            members = np.flatnonzero(self.words == size)
            prints = [simhash(self.of(m), np.zeros(1, int), self.bounds[m + 1] - self.bounds[m]) for m in members]
            self.by_size[int(size)] = {"members": members, "prints": tuple(np.concatenate([x[kind] for x in prints]) for kind in (0, 1))}

    def of(self, item: int) -> np.ndarray:
        return self.shingles[self.bounds[item] : self.bounds[item + 1]]

    def hits(self, shingles: np.ndarray) -> np.ndarray:
        """Which shingles occur in an item."""
        out = self.seen[shingles & np.uint64((1 << 20) - 1)]
        at = np.flatnonzero(out)
        place = np.minimum(np.searchsorted(self.known, shingles[at]), len(self.known) - 1)
        out[at] = self.known[place] == shingles[at]
        return out

    def within(self, size: int, prints: tuple[np.ndarray, np.ndarray]) -> Iterator[tuple[int, np.ndarray]]:
        """Each item of that size with the places in ``prints`` of the windows within the radius by either fingerprint."""
        side = self.by_size[size]
        kinds = list(zip(prints, side["prints"]))
        for first in range(0, len(side["members"]), 1024):
            found = np.zeros((len(prints[0]), len(side["members"][first : first + 1024])), bool)
            for mine, theirs in kinds:
                theirs = theirs[first : first + 1024]
                some = sifted(mine, theirs)
                window, item = np.nonzero(some)
                some[window, item] = np.bitwise_count(mine[window] ^ theirs[item]).sum(axis=1) <= RADIUS
                found |= some
            for column in np.flatnonzero(found.any(axis=0)):
                yield int(side["members"][first + column]), np.flatnonzero(found[:, column])


def sifted(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """Pairs of fingerprints of which some block lies within its part of the radius; all pairs within the radius are among them."""
    found = np.zeros((len(one), len(two)), bool)
    for k in range(BLOCKS):
        found |= np.bitwise_count(one[:, k, None] ^ two[None, :, k]) <= RADIUS // BLOCKS
    return found


def weighted_similarity(one: np.ndarray, two: np.ndarray) -> float:
    """Sum of smaller over sum of larger multiplicities; 0 when both are empty."""
    values, inverse = np.unique(np.concatenate([one, two]), return_inverse=True)
    a = np.bincount(inverse[: len(one)], minlength=len(values))
    b = np.bincount(inverse[len(one) :], minlength=len(values))
    most = int(np.maximum(a, b).sum())
    return int(np.minimum(a, b).sum()) / most if most else 0.0


def _in_text(index: Index, hashes: np.ndarray, shingles: np.ndarray, similarity: float) -> Iterator[tuple]:
    """(item, similarity, first word, words, windows) of each item that some window of the text reaches."""
    total = np.concatenate([[0], np.cumsum(index.hits(shingles))])
    for size, side in index.by_size.items():
        length = max(size - B.SHINGLE + 1, 1)
        if size < B.SHINGLE or len(hashes) < B.SHINGLE:
            # an item shorter than a shingle is one shingle, and so is each run of just so many words
            if size < B.SHINGLE:
                runs = _short_runs(hashes, size)
                for item in side["members"]:
                    at = np.flatnonzero(runs == index.of(item)[0])
                    if len(at):
                        yield int(item), 1.0, int(at[0]), size, len(at)
            continue
        span = min(length, len(shingles))
        need = math.ceil(similarity * length)
        starts = np.flatnonzero(total[span:] - total[:-span] >= need)
        if not len(starts):
            continue
        breaks = np.flatnonzero(np.diff(starts) > span) + 1
        best: dict[int, list] = {}
        for group in np.split(starts, breaks):
            for part in np.split(group, range(4096, len(group), 4096)):
                base = part[0]
                prints = simhash(shingles[base : part[-1] + span], part - base, span)
                for item, at in index.within(size, prints):
                    for start in part[at]:
                        value = weighted_similarity(shingles[start : start + span], index.of(item))
                        if value >= similarity:
                            entry = best.setdefault(item, [value, int(start), 0])
                            entry[2] += 1
                            if value > entry[0]:
                                entry[:2] = value, int(start)
        for item, (value, start, windows) in best.items():
            yield item, value, start, min(size, len(hashes)), windows


def _short_runs(hashes: np.ndarray, size: int) -> np.ndarray:
    """The single shingle of every run of ``size`` words, for sizes below a shingle."""
    n = len(hashes) - size + 1
    if n < 1:
        return np.zeros(0, np.uint64)
    places = np.arange(n)[:, None] + np.arange(size)
    return B.shingles(hashes[places].reshape(-1), np.arange(0, n * size + 1, size))[0]


class _Search:
    """The items of one slice looked for in batches of documents."""

    def __init__(self, index: Index, similarity: float):
        self.index, self.similarity = index, similarity
        self.short = bool((index.words[index.words > 0] < B.SHINGLE).any())

    def found(self, texts: pa.Array) -> Iterator[tuple[int, Iterator[tuple]]]:
        """The rows that may hold an item, with the matches in each."""
        for a, b in B.row_slices(texts):
            data, offsets = B.flat(texts.slice(a, b - a))
            hashes, _, words = B.words(data, offsets)
            shingles, bounds = B.shingles(hashes, words)
            some = np.concatenate([[0], np.cumsum(self.index.hits(shingles))])
            for t in np.flatnonzero((some[bounds[1:]] > some[bounds[:-1]]) | self.short & (np.diff(words) > 0)):
                yield a + int(t), _in_text(self.index, hashes[words[t] : words[t + 1]], shingles[bounds[t] : bounds[t + 1]], self.similarity)

    def matches(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "item_id", "similarity", "first_word", "n_words", "n_windows"]
        kinds = [pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64(), pa.int64()]
        for batch in batches:
            rows = [
                (batch["doc_id"][row].as_py(), self.index.item_ids[item], *rest)
                for row, matches in self.found(batch["text"]) for item, *rest in matches
            ]
            columns = list(zip(*rows)) if rows else [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], names=names)

    def clean(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.ones(batch.num_rows, bool)
            for row, matches in self.found(batch["text"]):
                keep[row] = next(matches, None) is None
            yield batch.filter(pa.array(keep))


def _slices(benchmark: DataFrame, similarity: float) -> Iterator[_Search]:
    """Searches for all items; each holds about SLICE_BYTES of item text."""
    items = benchmark.select(F.col("item_id").cast("bigint").alias("item_id"), F.col("text").cast("string").alias("text")).where("text is not null").distinct()
    held = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes")).first().bytes
    slices = max(1, math.ceil(held / SLICE_BYTES))
    for k in range(slices):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(slices)) == k).orderBy("item_id", "text").collect()
        if rows:
            yield _Search(Index([r.item_id for r in rows], [r.text for r in rows]), similarity)


def find_leaks(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """One row for each document row and item that some window of the document reaches.

    Columns: doc_id, item_id, similarity (the best window's), first_word (its place in words, the first of equals),
    n_words, n_windows (how many reach it).  Items are read in slices of ``SLICE_BYTES`` of text, one pass over the
    documents for each slice, so what tasks hold of the benchmark is bounded.  Null and empty texts, on either side,
    match nothing; repeated rows give repeated results; an item of fewer than five words matches only itself.
    A text shorter than an item is one window.  Extra columns are ignored.
    """
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = docs.sparkSession.createDataFrame([], MATCHES)
    for search in _slices(benchmark, similarity):
        found = found.unionByName(texts.mapInArrow(search.matches, MATCHES))
    return found


def without_leaks(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The rows, with all their columns, in which no item stands."""
    for search in _slices(benchmark, similarity):
        docs = docs.mapInArrow(search.clean, docs.schema)
    return docs
