"""One JSON document of any size read by many tasks: a list of conversations cut at the borders of its items.

Spark's text reader splits the file and ends its rows at ``}``, which is never escaped in JSON.  What a row does to the
state of a parser depends only on whether it begins inside a string: the number of its quotes tells whether it ends
inside one, and the brackets outside strings by how much it changes the depth.  Each split reports both cases, and
for each depth how many rows end there.  A prefix scan over these reports, one row for each split, gives every split its true entry state,
its depth and the number of items before it.  Then rows are numbered by item, put together, and parsed as usual.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foldwise.session import written
from foldwise.sources import export

_REPORT = "file string, block bigint, quotes bigint, change array<bigint>, ends array<map<bigint,bigint>>"


def _brackets(text: Column) -> Column:
    """Opening less closing brackets; a row holds no closing brace."""
    return F.length(F.translate(text, "]", "")) - F.length(F.translate(text, "{[", ""))


def _rows(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """file, block, value and the row's quotes and brackets outside strings, if it begins outside or inside one."""
    try:
        text = spark.read.option("recursiveFileLookup", "true").option("lineSep", "}").text(path)
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            raise FileNotFoundError(f"export not found: {path}") from error
        raise
    rows = text.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value")
    parts = rows.withColumn("parts", F.split(F.regexp_replace("value", r"(?s)\\.", ""), '"', -1))

    def outside(first: int) -> Column:
        own = F.transform("parts", lambda x, i: F.when(i % 2 == first, _brackets(x)).otherwise(0))
        return F.aggregate(own, F.lit(0), lambda s, x: s + x).cast("bigint")

    return parts.select("file", "block", "value", (F.size("parts") - 1).cast("bigint").alias("quotes"), outside(0).alias("outer"), outside(1).alias("inner"))


def _depths(quotes: np.ndarray, outer: np.ndarray, inner: np.ndarray, inside: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Depth after each row against the entry, whether it ends outside strings, and the state behind the last row."""
    after = (inside + np.cumsum(quotes)) % 2
    before = np.concatenate([[inside], after[:-1]])
    change = np.where(before == 0, outer, inner) - (after == 0)  # the brace that ended the row
    return np.cumsum(change), after == 0, int(after[-1])


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[str, int, int, int]]:
    """Consecutive rows of one split: file, block, first row, row behind the last."""
    files, blocks = batch["file"].to_pylist(), batch["block"].to_pylist()
    start = 0
    for k in range(1, len(files) + 1):
        if k == len(files) or (files[k], blocks[k]) != (files[start], blocks[start]):
            yield files[start], blocks[start], start, k
            start = k


def _numbers(batch: pa.RecordBatch, a: int, b: int) -> list[np.ndarray]:
    return [batch[c].slice(a, b - a).to_numpy() for c in ("quotes", "outer", "inner")]


def _report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([
        ("file", pa.string()), ("block", pa.int64()), ("quotes", pa.int64()), ("change", pa.list_(pa.int64())), ("ends", pa.list_(pa.map_(pa.int64(), pa.int64()))),
    ])
    place, state, depth, ends, quotes = None, [0, 1], [0, 0], [{}, {}], 0

    def row() -> dict:
        return {"file": place[0], "block": place[1], "quotes": quotes, "change": depth, "ends": [list(e.items()) for e in ends]}

    for batch in batches:
        out = []
        for file, block, a, b in _runs(batch):
            if place != (file, block):
                if place is not None:
                    out.append(row())
                place, state, depth, ends, quotes = (file, block), [0, 1], [0, 0], [{}, {}], 0
            numbers = _numbers(batch, a, b)
            for case in (0, 1):
                after, plain, state[case] = _depths(*numbers, state[case])
                values, counts = np.unique(after[plain] + depth[case], return_counts=True)
                for value, count in zip(values.tolist(), counts.tolist()):
                    ends[case][value] = ends[case].get(value, 0) + count
                depth[case] += int(after[-1])
            quotes += int(numbers[0].sum())
        yield pa.RecordBatch.from_pylist(out, schema)
    if place is not None:
        yield pa.RecordBatch.from_pylist([row()], schema)


_PIECE = "file string, block bigint, n bigint, item bigint, tail boolean, value string"


def _number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows with their place in the split and the item they belong to; an item ends where a row ends at depth one."""
    place, state, depth, item, total, n = None, 0, 0, 0, 0, 0
    for batch in batches:
        for file, block, a, b in _runs(batch):
            if place != (file, block):
                place, n = (file, block), 0
                state, depth, item, total = (batch[c][a].as_py() for c in ("inside", "depth", "item", "total"))
            after, plain, state = _depths(*_numbers(batch, a, b), state)
            last = plain & (after + depth == 1)
            items = item + np.cumsum(last) - last
            yield pa.RecordBatch.from_arrays(
                [batch["file"].slice(a, b - a), batch["block"].slice(a, b - a), pa.array(np.arange(n, n + b - a)), pa.array(items), pa.array(items == total), batch["value"].slice(a, b - a)],
                names=["file", "block", "n", "item", "tail", "value"],
            )
            depth, item, n = depth + int(after[-1]), int(item + last.sum()), n + b - a


def entry_states(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """file, block, inside, depth, item, total: whether each split begins inside a string, at which depth, behind how many items, and of how many.

    A document that isn't a closed list raises.
    """
    reports = written(_rows(spark, path).drop("value").mapInArrow(_report, _REPORT), "splits")
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)

    def ahead(amount: Column) -> Column:
        return F.coalesce(F.sum(amount).over(before), F.lit(0))

    inside = reports.withColumn("inside", (ahead(F.col("quotes")) % 2).cast("int"))
    own = inside.withColumn("own", F.element_at("change", F.col("inside") + 1))
    deep = own.withColumn("depth", ahead(F.col("own")))
    cuts = deep.withColumn("cuts", F.coalesce(F.element_at(F.element_at("ends", F.col("inside") + 1), 1 - F.col("depth")), F.lit(0)))
    total = F.sum("cuts").over(Window.partitionBy("file"))
    states = written(cuts.select("file", "block", "quotes", "own", "inside", "depth", ahead(F.col("cuts")).alias("item"), total.alias("total")), "splits")
    # the text behind the last brace counts as a row that is ended by one
    closed = states.groupBy("file").agg((F.sum("own") == -1).alias("level"), (F.sum("quotes") % 2 == 0).alias("plain")).where(~(F.col("level") & F.col("plain")))
    broken = closed.select("file").take(1)
    if broken:
        raise ValueError(f"document is not a closed JSON list: {broken[0].file}")
    return states.select("file", "block", "inside", "depth", "item", "total")


def read_list(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Conversations (pos, raw) of documents that are lists, as ``read_export`` gives them for whole documents.

    ``pos.block`` counts the items that end with a brace, ``pos.item`` the values that come before such an item without a brace.
    The states are broadcast: a row for each split of the input.
    """
    states = entry_states(spark, path)
    numbered = _rows(spark, path).join(F.broadcast(states), ["file", "block"])
    pieces = numbered.select("file", "block", "value", "quotes", "outer", "inner", "inside", "depth", "item", "total").mapInArrow(_number, _PIECE)
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "n", "value"))), lambda x: x["value"]), "}")
    whole = pieces.groupBy("file", "item").agg(text.alias("text"), F.bool_or("tail").alias("tail"))
    first = F.col("item") == 0
    opened = F.when(first, F.regexp_extract("text", r"(?s)^\s*\[(.*)\z", 1)).otherwise(F.regexp_extract("text", r"(?s)^\s*,(.*)\z", 1))
    begins = F.when(first, F.col("text").rlike(r"^\s*\[")).otherwise(F.col("text").rlike(r"^\s*,"))
    closed = F.regexp_replace(opened, r"\s*\]\s*\z", "")
    broken = F.raise_error(F.concat(F.lit("document is not valid JSON: "), F.substring("text", 1, 200))).cast("string")
    body = (
        F.when(F.col("tail") & ~first & F.col("text").rlike(r"^\s*\]\s*\z"), "").when(~begins, broken)
        .when(F.col("tail") & ~first & closed.rlike(r"^\s*\z"), broken)  # a comma without an item
        .when(F.col("tail"), closed).otherwise(F.concat(opened, F.lit("}")))
    )
    listed = whole.select("file", "item", "text", F.concat(F.lit("["), body, F.lit("]")).alias("json"))
    checked = listed.withColumn("json", F.when(export.is_one_json_value(F.col("json")), F.col("json")).otherwise(broken))
    items = checked.select("file", "item", F.posexplode(export.list_items("json")).alias("k", "value"))
    zero = F.lit(0)
    return export.flatten_items(items.select(export._pos(F.col("file"), F.col("item"), zero, F.col("k"), zero).alias("pos"), F.col("value").alias("json")))
