"""Language of whole texts by a byte convolutional network.

A text is cut into windows of ``WINDOW`` bytes.  Byte embeddings, filters of several widths, max pooling over the
window and softmax give log-probabilities; a text's are the mean of its windows', weighted by their bytes.  The
network is fitted with numpy on a bounded sample of labelled texts and applied to batches of windows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldwise.llm import bytetext as B
from foldwise.llm.sampling import held_out, sample_of_each

WINDOW = 256
WIDTHS = (2, 3, 4)
FILTERS = 12
EMBEDDING = 6
#: Bounds on the labelled texts the network is fitted on and on the windows taken from each.
TRAIN_ROWS = 3_000
TRAIN_WINDOWS = 4
#: Texts of each language at least, where it has as many.
LANGUAGE_ROWS = 50
STEPS = 500
UNKNOWN = "und"
_LAST = max(WIDTHS)


def windows(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All windows as rows of WINDOW byte codes (0 pads the end), their text and their bytes."""
    sizes = np.diff(offsets)
    count = -(-sizes // WINDOW)
    text = np.repeat(np.arange(len(sizes)), count)
    start = (np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)) * WINDOW
    size = np.minimum(WINDOW, sizes[text] - start)
    if not len(text):
        return np.zeros((0, WINDOW), np.uint8), text, size
    padded = np.concatenate([data, np.zeros(WINDOW, np.uint8)])
    rows = np.lib.stride_tricks.sliding_window_view(padded, WINDOW)[offsets[text] + start].copy()
    rows[np.arange(WINDOW) >= size[:, None]] = 0
    return rows, text, size


class Network:
    """Embedding, one bank of filters of all widths as a single matrix with zero tails, pooling, softmax."""

    def __init__(self, languages: list[str], seed: int = 3):
        rng = np.random.default_rng(seed)
        self.languages = languages
        self.embedding = (rng.standard_normal((256, EMBEDDING)) * 0.5).astype(np.float32)
        bank = FILTERS * len(WIDTHS)
        self.mask = np.concatenate([np.repeat(np.arange(_LAST) < w, EMBEDDING)[:, None] * np.ones(FILTERS) for w in WIDTHS], axis=1).astype(np.float32)
        self.filters = (rng.standard_normal((_LAST * EMBEDDING, bank)) * 0.3).astype(np.float32) * self.mask
        self.offset = np.zeros(bank, np.float32)
        self.out = (rng.standard_normal((bank, len(languages))) * 0.1).astype(np.float32)
        self.bias = np.zeros(len(languages), np.float32)

    def _patches(self, rows: np.ndarray) -> np.ndarray:
        spread = np.zeros((len(rows), WINDOW + _LAST - 1, EMBEDDING), np.float32)
        spread[:, :WINDOW] = self.embedding[rows]
        patches = np.lib.stride_tricks.sliding_window_view(spread, _LAST, axis=1)[:, :WINDOW]
        return np.ascontiguousarray(patches.transpose(0, 1, 3, 2)).reshape(len(rows) * WINDOW, -1)

    def _logits(self, rows: np.ndarray):
        patches = self._patches(rows)
        maps = (patches @ self.filters).reshape(len(rows), WINDOW, -1)
        pooled = np.maximum(maps.max(axis=1) + self.offset, 0)
        return patches, maps, pooled, pooled @ self.out + self.bias

    def log_probabilities(self, rows: np.ndarray) -> np.ndarray:
        out = np.empty((len(rows), len(self.languages)), np.float32)
        for a in range(0, len(rows), 64):
            logits = self._logits(rows[a : a + 64])[3]
            logits = logits - logits.max(axis=1, keepdims=True)
            out[a : a + 64] = logits - np.log(np.exp(logits).sum(axis=1, keepdims=True))
        return out

    def fit(self, rows: np.ndarray, labels: np.ndarray, steps: int = STEPS, seed: int = 3) -> "Network":
        """Adam on the cross entropy; languages are drawn equally often."""
        rng = np.random.default_rng(seed)
        names = ["embedding", "filters", "offset", "out", "bias"]
        first = {k: np.zeros_like(getattr(self, k)) for k in names}
        second = {k: np.zeros_like(getattr(self, k)) for k in names}
        chance = 1 / np.bincount(labels, minlength=len(self.languages))[labels]
        chance = np.cumsum(chance / chance.sum())
        for step in range(1, steps + 1):
            part = np.minimum(np.searchsorted(chance, rng.random(64)), len(labels) - 1)
            x, y = rows[part], labels[part]
            patches, maps, pooled, logits = self._logits(x)
            share = np.exp(logits - logits.max(axis=1, keepdims=True))
            share /= share.sum(axis=1, keepdims=True)
            share[np.arange(len(y)), y] -= 1
            share /= len(y)
            back = (share @ self.out.T) * (pooled > 0)
            place = maps.argmax(axis=1)
            at = (np.arange(len(y))[:, None] * WINDOW + place).reshape(-1)
            chosen = patches[at].reshape(len(y), -1, patches.shape[1])
            grads = {"out": pooled.T @ share, "bias": share.sum(axis=0), "offset": back.sum(axis=0)}
            grads["filters"] = np.einsum("nk,nkp->pk", back, chosen) * self.mask
            to_patch = (back[:, :, None] * self.filters.T[None]).reshape(len(y), -1, _LAST, EMBEDDING)
            padded = np.concatenate([x, np.zeros((len(y), _LAST), np.uint8)], axis=1)
            codes = padded[np.arange(len(y))[:, None, None], place[:, :, None] + np.arange(_LAST)]
            grads["embedding"] = np.zeros_like(self.embedding)
            np.add.at(grads["embedding"], codes.reshape(-1), to_patch.reshape(-1, EMBEDDING))
            for k in names:
                first[k] = 0.9 * first[k] + 0.1 * grads[k]
                second[k] = 0.999 * second[k] + 0.001 * grads[k] ** 2
                pace = 0.01 * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
                setattr(self, k, (getattr(self, k) - pace * first[k] / (np.sqrt(second[k]) + 1e-8)).astype(np.float32))
        return self

    def predict(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Index of the likeliest language and its probability for each text; empty texts get a uniform guess."""
        data, offsets = B.flat(column)
        rows, text, size = windows(data, offsets)
        logs = self.log_probabilities(rows) * size[:, None]
        n = len(offsets) - 1
        mean = np.stack([np.bincount(text, logs[:, k], minlength=n) for k in range(len(self.languages))], axis=1).astype(float)
        mean /= np.maximum(np.diff(offsets), 1)[:, None]
        share = np.exp(mean - mean.max(axis=1, keepdims=True))
        share /= share.sum(axis=1, keepdims=True)
        return share.argmax(axis=1), share.max(axis=1)


def _train_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Up to TRAIN_WINDOWS windows of each text, spread over its whole length."""
    for batch in batches:
        for a, b in B.row_slices(batch["text"]):
            rows, text, _ = windows(*B.flat(batch["text"].slice(a, b - a)))
            count = np.bincount(text, minlength=b - a)
            order = np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)
            step = np.maximum(count[text] / TRAIN_WINDOWS, 1)
            keep = (order / step).astype(int) != ((order - 1) / step).astype(int)
            keep |= order == 0
            yield pa.RecordBatch.from_arrays(
                [batch["lang"].slice(a, b - a).take(pa.array(text[keep])), pa.array([r.tobytes() for r in rows[keep]], pa.binary())],
                names=["lang", "window"],
            )


def fit(docs: DataFrame, train_rows: int = TRAIN_ROWS) -> Network | None:
    """Fit on texts with a language that are not held out; None when there are none.

    Above ``train_rows`` texts, each language gives an equal share of about so many, ``LANGUAGE_ROWS`` at least; a
    language with fewer gives all, so that every language is learnt at every size.
    """
    known = docs.select(*(F.col(c).cast(t).alias(c) for c, t in (("doc_id", "bigint"), ("text", "string"), ("lang", "string"))))
    known = known.where(F.col("lang").isNotNull() & (F.length("text") > 0) & F.col("doc_id").isNotNull() & ~held_out())
    sample = sample_of_each(known, "lang", ("doc_id", "text"), train_rows, LANGUAGE_ROWS)
    found = sample.select("lang", "text").mapInArrow(_train_windows, "lang string, window binary").toArrow()
    if not len(found):
        return None
    pairs = sorted(zip(found["window"].to_pylist(), found["lang"].to_pylist()))
    languages = sorted({lang for _, lang in pairs})
    rows = np.frombuffer(b"".join(w for w, _ in pairs), np.uint8).reshape(-1, WINDOW)
    return Network(languages).fit(rows, np.array([languages.index(lang) for _, lang in pairs]))


def _predictor(network: Network) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = np.array(network.languages, dtype=object)
        for batch in batches:
            for a, b in B.row_slices(batch["text"], B.SLICE_BYTES // 2):
                best, share = network.predict(batch["text"].slice(a, b - a))
                yield pa.RecordBatch.from_arrays(
                    [batch["doc_id"].slice(a, b - a), batch["lettered"].slice(a, b - a), pa.array(names[best].tolist(), pa.string()), pa.array(share.astype(np.float64))],
                    names=["doc_id", "lettered", "lang_pred", "score"],
                )

    return run


def identify(docs: DataFrame, train_rows: int = TRAIN_ROWS, network: Network | None = None) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row of ``docs`` (doc_id, text, lang; others are ignored).

    Texts that are null or hold no letter are ``und`` with score 0; so is every text when no row has a language to
    learn from.  Ties go to the language first in order.  Repeated rows give equal results.
    """
    network = network or fit(docs, train_rows)
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    lettered = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    out = F.col("doc_id"), held_out().alias("held_out")
    if network is None:
        return texts.select(*out, F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    found = texts.withColumn("lettered", lettered).mapInArrow(_predictor(network), "doc_id bigint, lettered boolean, lang_pred string, score double")
    return found.select(
        *out, F.when(F.col("lettered"), F.col("lang_pred")).otherwise(UNKNOWN).alias("lang_pred"),
        F.when(F.col("lettered"), F.col("score")).otherwise(0.0).alias("score"),
    )


def _known(network: Network, least: float) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in B.row_slices(batch["text"], B.SLICE_BYTES // 2):
                part = batch.slice(a, b - a)
                yield part.filter(pa.array(network.predict(part["text"])[1] >= least))

    return run


def filter_known(docs: DataFrame, network: Network | None, least: float) -> DataFrame:
    """The rows, with all their columns, whose text has a letter and a language of at least that probability.

    Without a network (nothing to learn from) every lettered text stays.
    """
    lettered = docs.where(F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)))
    return lettered if network is None else lettered.mapInArrow(_known(network, least), docs.schema)
