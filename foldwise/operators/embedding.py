"""Calls to an embedding model, batch by batch, and an offline stand-in."""

from __future__ import annotations

import threading
import time
import zlib
from collections.abc import Callable, Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame

from foldwise.session import spread
from foldwise.sources.group_log import GroupLog

# Texts per request, attempts, and seconds before the second attempt (doubling after).
REQUEST_TEXTS = 96
ATTEMPTS = 3
FIRST_DELAY = 2.0

Embedder = Callable[[Sequence[str]], Sequence[Sequence[float]]]


class HashingEmbedder:
    """Counts of hashed words: deterministic and offline, not a language model."""

    #: It computes in the calling process, where threads would only pass the interpreter's lock around.
    waits = False

    def __init__(self, dim: int = 256):
        self.dim = dim

    def __call__(self, texts: Sequence[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dim), dtype=np.float32)
        for row, text in enumerate(texts):
            words = text.lower().split()
            if words:
                # Words hold no blank, so they are encoded together.
                hashes = np.fromiter(map(zlib.crc32, " ".join(words).encode().split(b" ")), np.int64, len(words))
                out[row] = np.bincount(hashes % self.dim, minlength=self.dim)
        return out


def request_with_retry(
    embed: Embedder, texts: Sequence[str], attempts: int = ATTEMPTS, delay: float = FIRST_DELAY, size: int = REQUEST_TEXTS
) -> np.ndarray:
    """Vectors of the texts as float32 rows; a failed request is repeated, a short reply is an error."""
    rows: list[Sequence[float]] = []
    for start in range(0, len(texts), size):
        part = texts[start : start + size]
        for attempt in range(attempts):
            try:
                reply = embed(part)
                break
            except Exception:
                if attempt == attempts - 1:
                    raise
                time.sleep(delay * 2**attempt)
        if len(reply) != len(part):
            raise RuntimeError(f"asked for {len(part)} embeddings, got {len(reply)}")
        rows.extend(reply)
    vectors = np.asarray(rows, dtype=np.float32)
    if vectors.ndim != 2 or vectors.shape[1] == 0:
        raise RuntimeError("the model returned empty embeddings")
    return vectors


def embed_batches(
    batches: DataFrame,
    make_embedder: Callable[[], Embedder],
    id_: str = "id",
    text: str = "text",
    attempts: int = ATTEMPTS,
    delay: float = FIRST_DELAY,
    tasks: int = 1 << 30,
) -> DataFrame:
    """(id, vector) for rows (id, text, batch_id).

    Batches are spread over the cluster whole, the model client is made once per task, and one request
    sequence covers one batch, so ``tasks`` (at most four per core) bounds the requests in flight.
    """

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        embed = make_embedder()
        held: pd.DataFrame | None = None

        def send(pdf: pd.DataFrame) -> pd.DataFrame:
            vectors = request_with_retry(embed, pdf[text].tolist(), attempts, delay)
            return pd.DataFrame({id_: pdf[id_], "vector": list(vectors)})

        for pdf in parts:
            pdf = pdf if held is None else pd.concat([held, pdf])
            if len(pdf) == 0:
                continue
            # The last batch may go on in the next Arrow chunk; a batch has no more rows than words.
            last = pdf["batch_id"].iloc[-1]
            held = pdf[pdf["batch_id"] == last]
            for _, batch in pdf[pdf["batch_id"] != last].groupby("batch_id", sort=False):
                yield send(batch)
        if held is not None and len(held):
            yield send(held)

    id_type = batches.schema[id_].dataType.simpleString()
    placed = spread(batches.select(id_, text, "batch_id"), tasks, "batch_id").sortWithinPartitions("batch_id")
    return placed.mapInPandas(run, f"{id_} {id_type}, vector array<float>")


def _starts(numbers: np.ndarray) -> np.ndarray:
    """Where runs of equal numbers begin, and the end."""
    return np.r_[np.flatnonzero(np.r_[True, np.diff(numbers) != 0]), len(numbers)]


def _as_lists(parts: Sequence[np.ndarray]) -> pa.ChunkedArray:
    """Rows of matrices, which may differ in width."""
    wide = np.repeat([p.shape[1] for p in parts], [len(p) for p in parts])
    ends = np.r_[0, np.cumsum(wide)].astype(np.int32)
    return pa.chunked_array([pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([p.ravel() for p in parts]), pa.float32()))])


def embed_group_after_group(
    rows: DataFrame, make_embedder: Callable[[], Embedder], parallelism: int, log: GroupLog | None = None,
    attempts: int = ATTEMPTS, delay: float = FIRST_DELAY,
) -> DataFrame:
    """(id, vector, group_id, problem) for rows (id, text, batch_id, group_id, ...), group after group in one task, which reads them itself.

    The batches of a group are requested together, by ``parallelism`` threads with a client each, and the group is in the log before
    the next one is requested.  A client whose ``waits`` is false computes in the task itself; its batches follow each other
    without threads.  Groups that the log has from an attempt before are not requested again.  The task holds one
    group at a time.  ``problem`` tells why groups from this one on are not in the log, if the log allows that.
    """

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, spare = threading.local(), []
        kept, pool = log, None

        def send(texts: list[str]) -> np.ndarray:
            if not hasattr(own, "embed"):
                try:
                    own.embed = spare.pop()
                except IndexError:
                    own.embed = make_embedder()
            return request_with_retry(own.embed, texts, attempts, delay)

        def together(batches: list[list[str]]) -> Iterator[np.ndarray]:
            nonlocal pool
            if not (pool or hasattr(own, "embed")):
                own.embed = make_embedder()
                if parallelism > 1 and getattr(own.embed, "waits", True):
                    spare.append(own.embed)
                    pool = ThreadPoolExecutor(parallelism)
            return (pool.map if pool else map)(send, batches)

        def done(group: int, table: pa.Table) -> pa.RecordBatch:
            nonlocal kept
            problem, known = None, kept.read(group) if kept else None
            if known is None:
                texts, starts = table["text"].to_pylist(), _starts(table["batch_id"].to_numpy())
                vectors = _as_lists([*together([texts[a:b] for a, b in zip(starts, starts[1:])])])
                known = table.drop_columns(["text", "batch_id", "group_id"]).append_column("vector", vectors)
                if kept:
                    try:
                        kept.write(group, known)
                    except (ValueError, OSError) as error:
                        if not kept.may_fail:
                            raise
                        kept, problem = None, str(error) or type(error).__name__
            n = len(known)
            columns = [known["id"].combine_chunks(), known["vector"].combine_chunks(), pa.array(np.full(n, group), pa.int64()), pa.array([problem] * n, pa.string())]
            return pa.RecordBatch.from_arrays(columns, names=["id", "vector", "group_id", "problem"])

        held: pa.Table | None = None
        try:
            for part in parts:
                table = pa.Table.from_batches([part])
                table = table if held is None else pa.concat_tables([held, table])
                if len(table) == 0:
                    continue
                # The last group may go on in the next Arrow chunk.
                groups = table["group_id"].to_numpy()
                starts = _starts(groups)
                for a, b in zip(starts[:-2], starts[1:]):
                    yield done(int(groups[a]), table.slice(a, b - a))
                held = table.slice(starts[-2])
            if held is not None and len(held):
                yield done(held["group_id"][0].as_py(), held)
        finally:
            if pool:
                pool.shutdown(cancel_futures=True)

    ordered = rows.coalesce(1).sortWithinPartitions("batch_id")
    return ordered.mapInArrow(run, "id string, vector array<float>, group_id bigint, problem string")
