"""Quality scores of whole texts by a factorisation machine over hashed words, structure and metadata.

score = sigmoid(w0 + Σ wᵢxᵢ + ½ Σ_f [(Σ vᵢf xᵢ)² - Σ vᵢf² xᵢ²]): all pairwise interactions in time linear in the
number of distinct words.  The model is fitted with numpy on a bounded sample; tasks receive its fixed-size arrays.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldwise.llm import bytetext as B
from foldwise.llm.sampling import bounded_sample, held_out

WORD_SLOTS = 1 << 13
RANK = 8
#: Bound on the labelled rows that the model is fitted on.
TRAIN_ROWS = 8_000
EPOCHS = 8
STATS = (
    "upper", "digit", "symbol", "space", "line_ends", "bar", "mean_word", "repeated_word", "distinct_words",
    "repeated_shingle", "length", "no_words", "marked_words",
)
FEATURES = "label int, slots array<int>, amounts array<float>, stats array<float>"


def _class(text: str) -> np.ndarray:
    table = np.zeros(256, np.float32)
    table[list(text.encode())] = 1
    return table


_UPPER, _DIGIT, _BAR, _LINE = _class("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), _class("0123456789"), _class("|"), _class("\n")
_SYMBOL, _BLANK = _class("!\"#$%&'()*+/;<=>?@[\\]^_`{|}~"), _class(" \t\r\n")


def _shares(data: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> np.ndarray:
    total = np.zeros(len(data) + 1, np.float32 if len(data) < 1 << 23 else np.float64)
    np.cumsum(table[data], out=total[1:])
    return (total[offsets[1:]] - total[offsets[:-1]]) / np.maximum(np.diff(offsets), 1)


def features(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row, slot and amount of each distinct hashed word, and one row of structure figures for each text."""
    data, offsets = B.flat(column)
    hashes, starts, bounds = B.words(data, offsets)
    counts = np.diff(bounds)
    n = len(counts)
    row = np.repeat(np.arange(n), counts)
    keys, amounts = np.unique(row * WORD_SLOTS + (hashes & np.uint64(WORD_SLOTS - 1)).astype(np.int64), return_counts=True)
    rows, slots = keys // WORD_SLOTS, (keys % WORD_SLOTS).astype(np.int32)
    amounts = np.log1p(amounts).astype(np.float32)
    norm = np.sqrt(np.bincount(rows, amounts**2, minlength=n))
    amounts = (amounts / np.maximum(norm, 1e-9)[rows]).astype(np.float32)

    def share_of(flags: np.ndarray, at: np.ndarray, of: np.ndarray) -> np.ndarray:
        return np.bincount(at, flags, minlength=n) / np.maximum(of, 1)

    same = np.zeros(len(hashes))
    if len(hashes):
        same[1:] = (hashes[1:] == hashes[:-1]) & (row[1:] == row[:-1])
    runs, run_bounds = B.shingles(hashes, bounds)
    run_counts = np.diff(run_bounds)
    kinds = np.array([len(np.unique(runs[a:b])) for a, b in zip(run_bounds[:-1], run_bounds[1:])], float)
    distinct = np.array([len(np.unique(hashes[a:b])) for a, b in zip(bounds[:-1], bounds[1:])], float)
    symbol_total = np.zeros(len(data) + 1)
    np.cumsum(_SYMBOL[data], out=symbol_total[1:])
    ends = np.append(starts[1:], len(data))
    marked = (symbol_total[ends] - symbol_total[starts] > 0) if len(starts) else np.zeros(0)
    letters = np.maximum(1 - _shares(data, offsets, _BLANK), 1e-6)
    stats = np.stack(
        [
            _shares(data, offsets, _UPPER) / letters, _shares(data, offsets, _DIGIT) / letters, _shares(data, offsets, _SYMBOL) / letters,
            _shares(data, offsets, _BLANK), np.minimum(1, 20 * _shares(data, offsets, _LINE)), np.minimum(1, 20 * _shares(data, offsets, _BAR)),
            np.minimum(1, np.diff(offsets) / np.maximum(counts, 1) / 20), share_of(same, row, counts), distinct / np.maximum(counts, 1),
            1 - np.where(run_counts > 0, kinds / np.maximum(run_counts, 1), 1), np.minimum(1, np.log1p(counts) / 12), (counts == 0).astype(float),
            share_of(np.asarray(marked, float), row, counts),
        ],
        axis=1,
    ).astype(np.float32)
    return rows, slots, amounts, stats


def _feature_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b in B.row_slices(batch["text"]):
            rows, slots, amounts, stats = features(batch["text"].slice(a, b - a))
            bounds = pa.array(np.searchsorted(rows, np.arange(b - a + 1)).astype(np.int32))
            lists = [pa.ListArray.from_arrays(bounds, pa.array(x)) for x in (slots, amounts)]
            fixed = pa.ListArray.from_arrays(pa.array(np.arange(0, stats.size + 1, stats.shape[1], dtype=np.int32)), pa.array(stats.reshape(-1)))
            yield pa.RecordBatch.from_arrays([batch["label"].slice(a, b - a), *lists, fixed], names=["label", "slots", "amounts", "stats"])


class Machine:
    """A factorisation machine; the structure figures take the slots after the words'."""

    def __init__(self, seed: int = 1):
        rng = np.random.default_rng(seed)
        size = WORD_SLOTS + len(STATS)
        self.bias, self.linear = np.float32(0), np.zeros(size, np.float32)
        self.factors = (rng.standard_normal((size, RANK)) * 0.02).astype(np.float32)
        self.centre, self.spread = np.zeros(len(STATS), np.float32), np.ones(len(STATS), np.float32)

    def _inputs(self, rows, slots, amounts, stats):
        n, m = stats.shape
        scaled = np.clip((stats - self.centre) / self.spread, -4, 4)
        return (
            np.concatenate([rows, np.repeat(np.arange(n), m)]), np.concatenate([slots, np.tile(np.arange(m) + WORD_SLOTS, n)]),
            np.concatenate([amounts, scaled.reshape(-1)]).astype(np.float32), n,
        )

    def _sums(self, rows, slots, x, n):
        v = self.factors[slots] * x[:, None]
        total = np.stack([np.bincount(rows, v[:, f], minlength=n) for f in range(RANK)], axis=1)
        squares = np.bincount(rows, (v * v).sum(axis=1), minlength=n)
        return v, total, self.bias + np.bincount(rows, self.linear[slots] * x, minlength=n) + 0.5 * ((total**2).sum(axis=1) - squares)

    def margin(self, rows, slots, amounts, stats) -> np.ndarray:
        return self._sums(*self._inputs(rows, slots, amounts, stats))[2]

    def fit(self, rows, slots, amounts, stats, labels, epochs: int, seed: int = 1) -> "Machine":
        """Adagrad on the logistic loss; the rarer label weighs as much as the other."""
        self.centre, self.spread = stats.mean(axis=0), stats.std(axis=0) + 1e-3
        share = min(max(labels.mean(), 1e-6), 1 - 1e-6)
        weight = np.where(labels == 1, 0.5 / share, 0.5 / (1 - share))
        bounds = np.searchsorted(rows, np.arange(len(labels) + 1))
        grown_w, grown_v, grown_b = np.full(len(self.linear), 1e-3), np.full(self.factors.shape, 1e-3), 1e-3
        rng = np.random.default_rng(seed)
        for _ in range(epochs):
            order = rng.permutation(len(labels))
            for part in np.array_split(order, max(1, len(order) // 100)):
                lens = bounds[part + 1] - bounds[part]
                at = np.arange(lens.sum()) - np.repeat(np.cumsum(lens) - lens, lens) + np.repeat(bounds[part], lens)
                r, s, x, n = self._inputs(np.repeat(np.arange(len(part)), lens), slots[at], amounts[at], stats[part])
                v, total, margin = self._sums(r, s, x, n)
                slope = (1 / (1 + np.exp(-np.clip(margin, -30, 30))) - labels[part]) * weight[part] / n
                own = slope[r] * x
                grad_w = np.bincount(s, own, minlength=len(self.linear)) + 1e-5 * self.linear
                inner = own[:, None] * (total[r] - v)
                grad_v = np.stack([np.bincount(s, inner[:, f], minlength=len(self.linear)) for f in range(RANK)], axis=1) + 1e-5 * self.factors
                grown_w += grad_w**2
                grown_v += grad_v**2
                grown_b += slope.sum() ** 2
                self.linear -= (0.1 * grad_w / np.sqrt(grown_w)).astype(np.float32)
                self.factors -= (0.03 * grad_v / np.sqrt(grown_v)).astype(np.float32)
                self.bias -= np.float32(0.1 * slope.sum() / np.sqrt(grown_b))
        return self


def fit(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> Machine:
    """Fit on at most about ``train_rows`` labelled rows that are not held out.

    Labels other than 0 and 1 and texts that are null are not learnt from; a repeated label is learnt once for each
    pair of rows.  Without any usable row the machine is untrained and scores everything 0.5.
    """
    known = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("quality").cast("int").alias("label"))
    known = known.where(F.col("label").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out()).distinct()
    sample = bounded_sample(known, "doc_id", train_rows)
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).where("text is not null")
    # the sample's size is bounded by train_rows, so it can go to every task
    found = texts.join(F.broadcast(sample), "doc_id").select("label", "text").mapInArrow(_feature_rows, FEATURES).toArrow()
    if not len(found):
        return Machine()
    found = found.combine_chunks()
    lists = [found[c].combine_chunks() for c in ("slots", "amounts", "stats")]
    lists = [x.chunk(0) if isinstance(x, pa.ChunkedArray) else x for x in lists]
    rows = np.repeat(np.arange(len(found)), pc.list_value_length(lists[0]).to_numpy())
    stats = lists[2].flatten().to_numpy().reshape(len(found), len(STATS))
    values = [lists[0].flatten().to_numpy(), lists[1].flatten().to_numpy()]
    # rows arrive in the order tasks end; a fixed order makes the fit repeatable
    sizes = np.bincount(rows, minlength=len(found))
    order = np.lexsort((np.bincount(rows, values[1], minlength=len(found)), *stats.T, sizes))
    starts = np.cumsum(sizes) - sizes
    at = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes[order]) - sizes[order], sizes[order]) + np.repeat(starts[order], sizes[order])
    label = found["label"].to_numpy()[order].astype(np.float32)
    return Machine().fit(np.repeat(np.arange(len(found)), sizes[order]), values[0][at], values[1][at], stats[order], label, EPOCHS)


def _scorer(machine: Machine) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in B.row_slices(batch["text"]):
                margin = machine.margin(*features(batch["text"].slice(a, b - a)))
                score = 1 / (1 + np.exp(-np.clip(margin, -30, 30)))
                yield pa.RecordBatch.from_arrays(
                    [*(batch[c].slice(a, b - a) for c in batch.schema.names if c != "text"), pa.array(score.astype(np.float64))],
                    names=[*(c for c in batch.schema.names if c != "text"), "score"],
                )

    return run


def score(docs: DataFrame, machine: Machine) -> DataFrame:
    """doc_id and score (0 to 1) of every row; null and empty texts are scored by their structure figures alone."""
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(_scorer(machine), "doc_id bigint, score double")


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs``; an empty table gives an empty table."""
    scored = score(docs, fit(docs, labels, train_rows))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def _good(machine: Machine, threshold: float) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in B.row_slices(batch["text"]):
                part = batch.slice(a, b - a)
                margin = machine.margin(*features(part["text"]))
                yield part.filter(pa.array(1 / (1 + np.exp(-np.clip(margin, -30, 30))) >= threshold))

    return run


def filter_good(docs: DataFrame, machine: Machine, threshold: float) -> DataFrame:
    """The rows, with all their columns, that score at least the threshold."""
    return docs.mapInArrow(_good(machine, threshold), docs.schema)
