"""Strict reader for splitting an export: anything that is not a list of objects is an error."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foldwise.functions.text import BLANK_LINE
from foldwise.sources import export as X


def document_items(documents: DataFrame) -> DataFrame:
    """(file, item, json) of list documents, or of the ``conversations`` list of object documents."""
    whole = X.is_one_json_value(F.col("value"))
    items = F.when(whole, F.coalesce(X.list_items("value"), X.member_list("value", "conversations")))
    what = (
        F.when(~whole, "text is not exactly one JSON value")
        .when(F.from_json("value", "map<string,string>").isNotNull(), 'no list stands under the key "conversations"')
        .otherwise("neither a list nor an object holding one")
    )
    wrong = F.raise_error(F.concat("file", F.lit(": "), what)).cast("array<string>")
    return documents.select("file", F.posexplode(F.coalesce(items, wrong)).alias("item", "json"))


def is_json_object(json: Column) -> Column:
    return X.is_one_json_value(json) & F.from_json(json, "map<string,string>").isNotNull()


def item_errors(items: DataFrame) -> DataFrame:
    """(file, item, problem) for the items that are not JSON objects."""
    return items.where(~is_json_object(F.col("json"))).select(
        "file", "item", F.lit("item is not a JSON object").alias("problem")
    )


def line_numbers(lines: DataFrame) -> DataFrame:
    """(file, line_number, json): lines counted from 1 within each file, blank ones included.

    Counted per (file, block): a block is one split of the scan, so no window spans a whole file; the
    offsets come from the table of block sizes.
    """
    block = Window.partitionBy("file", "block").orderBy("line")
    sizes = lines.groupBy("file", "block").agg(F.count("*").alias("n"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("file", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    return (
        lines.withColumn("_n", F.row_number().over(block))
        .join(offsets, ["file", "block"])
        .select("file", (F.col("offset") + F.col("_n")).alias("line_number"), F.col("value").alias("json"))
    )


def line_errors(numbered: DataFrame) -> DataFrame:
    """(file, line_number, problem) for non-blank lines that are no JSON, or no JSON object."""
    json = F.col("json")
    problem = F.when(~X.is_one_json_value(json), F.lit("invalid JSON")).when(
        ~is_json_object(json), F.lit("not a JSON object")
    )
    return (
        numbered.where(~json.rlike(BLANK_LINE))
        .select("file", "line_number", problem.alias("problem"))
        .where(F.col("problem").isNotNull())
    )


def read_numbered_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    lines = X._text(spark, path, whole=False).withColumn("line", F.monotonically_increasing_id())
    return line_numbers(lines)


def read_strict(spark: SparkSession, path: str, layout: str = X.AUTO) -> DataFrame:
    """(pos, raw) of every conversation object, or ValueError naming the first offending item or line."""
    if layout == X.AUTO:
        found = {row.layout for row in X.file_layouts(spark, path).select("layout").distinct().collect()}
        if len(found) > 1:
            raise ValueError("the export mixes documents and newline-delimited files; name the layout")
        layout = found.pop() if found else X.DOCUMENT
    if layout == X.LINES:
        bad = line_errors(read_numbered_lines(spark, path)).orderBy("file", "line_number").take(1)
        if bad:
            raise ValueError(f"line {bad[0].line_number} of {bad[0].file}: {bad[0].problem}")
        return X.read_lines(spark, path).select("pos", F.col("json").alias("raw"))
    items = document_items(X.read_documents(spark, path))
    bad = item_errors(items).orderBy("file", "item").take(1)
    if bad:
        raise ValueError(f"item {bad[0].item} of {bad[0].file}: {bad[0].problem}")
    zero = F.lit(0)
    return items.select(X._pos(F.col("file"), zero, zero, F.col("item"), zero).alias("pos"), F.col("json").alias("raw"))
