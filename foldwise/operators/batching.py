"""Greedy packing of texts into batches under a word budget, exact over the whole ordered input."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foldwise.functions.text import word_count
from foldwise.session import materialise


def _batch_ends(words: np.ndarray, budget: int) -> tuple[np.ndarray, np.ndarray]:
    """Prefix sums, and for a batch opened at each row the row after its last one within this slice."""
    prefix = np.concatenate(([0], np.cumsum(words)))
    ends = np.searchsorted(prefix, prefix[:-1] + budget, side="right") - 1
    return prefix, np.maximum(ends, np.arange(len(words)) + 1)


def _fitting(prefix: np.ndarray, used: int, budget: int) -> int:
    """Leading rows that still fit a batch holding ``used`` words; 0 means none is open."""
    return int(np.searchsorted(prefix, budget - used, side="right") - 1) if used else 0


def _advance(words: np.ndarray, budget: int, states: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words in the open batch after this slice, and batches closed in it, for each entry state."""
    n = len(words)
    prefix, ends = _batch_ends(words, budget)
    after, closed = [0] * n, [0] * n
    for i in range(n - 1, -1, -1):
        end = int(ends[i])
        if words[i] >= budget:
            after[i], closed[i] = (after[end], closed[end] + 1) if end < n else (0, 1)
        elif end < n:
            after[i], closed[i] = after[end], closed[end] + 1
        else:
            after[i] = int(prefix[n] - prefix[i])
    out, count = np.empty_like(states), np.empty_like(states)
    for k, used in enumerate(states):
        fit = _fitting(prefix, int(used), budget)
        if fit == n:
            out[k], count[k] = used + prefix[n], 0
        else:
            out[k], count[k] = after[fit], closed[fit] + (1 if used else 0)
    return out, count


def _assign(words: np.ndarray, budget: int, used: int, batch: int) -> tuple[np.ndarray, int, int]:
    """Batch number of each row, then the state behind the slice."""
    n = len(words)
    prefix, ends = _batch_ends(words, budget)
    ids = np.empty(n, dtype=np.int64)
    i = _fitting(prefix, used, budget)
    ids[:i] = batch
    if i == n:
        return ids, used + int(prefix[n]), batch
    if used:
        batch += 1
    while i < n:
        end = int(ends[i])
        ids[i:end] = batch
        if end == n and words[i] < budget:
            return ids, int(prefix[n] - prefix[i]), batch
        batch += 1
        i = end
    return ids, 0, batch


def word_batches(
    texts: DataFrame, budget: int, text: str = "text", order: tuple[str, ...] = ("pos",), keep: tuple[str, ...] = ()
) -> DataFrame:
    """Add ``words`` and ``batch_id`` to the ``order`` and ``keep`` columns.

    Texts are taken in order; each counts at least one word; a batch closes when the next text would
    exceed the budget, and a text that reaches the budget alone is a batch of its own.

    The greedy walk over a partition depends on its past only through the words in the open batch.
    Every partition therefore reports, in one streaming pass, its exit state for each entry state
    (run-length coded, at most budget + 1 runs); folding these few rows gives each partition its true
    entry state, and a second pass numbers the rows.  No task sees more than its own partition.
    """
    if budget <= 0:
        raise ValueError("the word budget must be positive")
    counted = F.greatest(F.lit(1), F.expr(word_count(text))).cast("bigint")
    # Range partitioning samples its input first; the checkpoint keeps that from counting words twice.
    sized = materialise(texts.select(*order, *keep, counted.alias("words")))
    placed = materialise(
        sized.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id())
    )

    def summarise(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state = np.arange(budget + 1, dtype=np.int64)
        closed = np.zeros(budget + 1, dtype=np.int64)
        part = None
        for pdf in batches:
            if len(pdf) == 0:
                continue
            part = int(pdf["_part"].iloc[0])
            distinct, place = np.unique(state, return_inverse=True)
            out, count = _advance(pdf["words"].to_numpy(), budget, distinct)
            state, closed = out[place], closed + count[place]
        if part is not None:
            starts = np.flatnonzero(np.r_[True, (np.diff(state) != 0) | (np.diff(closed) != 0)])
            # A run may also rise by one per entry state while nothing closes; each such state is its own run.
            yield pd.DataFrame(
                {"part": part, "entry": starts, "used": state[starts], "closed": closed[starts]}
            )

    runs = (
        placed.select("_part", "words")
        .mapInPandas(summarise, "part int, entry bigint, used bigint, closed bigint")
        .orderBy("part", "entry")
        .toPandas()
    )
    entry: dict[int, tuple[int, int]] = {}
    used, batch = 0, 0
    for part, rows in runs.groupby("part", sort=True):
        entry[int(part)] = (used, batch)
        at = int(np.searchsorted(rows["entry"].to_numpy(), used, side="right") - 1)
        used, batch = int(rows["used"].iloc[at]), batch + int(rows["closed"].iloc[at])

    schema = T.StructType([f for f in placed.schema if f.name != "_part"] + [T.StructField("batch_id", T.LongType())])

    def number(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state = None
        for pdf in batches:
            if len(pdf) == 0:
                continue
            if state is None:
                state = entry[int(pdf["_part"].iloc[0])]
            ids, now_used, now_batch = _assign(pdf["words"].to_numpy(), budget, *state)
            state = (now_used, now_batch)
            yield pdf.drop(columns="_part").assign(batch_id=ids)

    return placed.mapInPandas(number, schema)


def batch_groups(batches: DataFrame, parallelism: int) -> DataFrame:
    """Add ``group_id``: that many consecutive batches are requested together."""
    return batches.withColumn("group_id", F.floor(F.col("batch_id") / max(1, parallelism)))
