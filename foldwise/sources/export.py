"""Readers for conversation exports: whole JSON documents and newline-delimited JSON.

Every conversation row carries ``pos``, its place in the export as
struct<file, block, line, item, part>, because order decides ties, limits and labels later on.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foldwise.functions.text import BLANK_LINE
from foldwise.operators.normalize import looks_like_conversation

# Members of a container document that may hold conversations, in reading order.
CONTAINER_KEYS = ("conversations", "items", "data")
DOCUMENT, LINES, AUTO = "document", "lines", "auto"


def _text(spark: SparkSession, path: str | list[str], whole: bool) -> DataFrame:
    try:
        return (
            spark.read.option("recursiveFileLookup", "true")
            .text(path, wholetext=whole)
            .select(
                "value",
                F.col("_metadata.file_path").alias("file"),
                F.col("_metadata.file_block_start").alias("block"),
            )
        )
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            raise FileNotFoundError(f"export not found: {path}") from error
        raise


def _pos(file: Column, block: Column, line: Column, item: Column, part: Column) -> Column:
    return F.struct(
        file.alias("file"),
        block.cast("bigint").alias("block"),
        line.cast("bigint").alias("line"),
        item.cast("bigint").alias("item"),
        part.cast("bigint").alias("part"),
    )


def is_one_json_value(text: Column) -> Column:
    """True when the text is exactly one JSON value with nothing behind it."""
    return F.coalesce(
        F.size(F.from_json(F.concat(F.lit("["), text, F.lit("]")), "array<string>")) == 1, F.lit(False)
    )


def _exact(texts: Column, values: Column) -> Column:
    """JSON texts of an array's values; strings keep their quotes, so they are never taken for what they spell."""
    return F.zip_with(
        texts, values,
        lambda text, value: F.when(F.coalesce(F.schema_of_variant(value) == "STRING", F.lit(False)), F.to_json(value)).otherwise(text),
    )


def list_items(json: str | Column) -> Column:
    """JSON texts of the items of a list; null for any other value."""
    return _exact(F.from_json(json, "array<string>"), F.from_json(json, "array<variant>"))


def member_values(json: str | Column) -> Column:
    """JSON texts of the members' values of an object, in their order; null for any other value."""
    return _exact(F.map_values(F.from_json(json, "map<string,string>")), F.map_values(F.from_json(json, "map<string,variant>")))


def member_list(json: str | Column, key: str) -> Column:
    """JSON texts of the items of the list under a key of an object; null when there is no list."""
    value = F.from_json(json, "map<string,variant>")[key]
    is_list = F.coalesce(F.schema_of_variant(value).startswith("ARRAY<"), F.lit(False))
    return F.when(is_list, list_items(F.from_json(json, "map<string,string>")[key]))


def file_layouts(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(file, layout) by a look at each file's lines.

    A file is newline-delimited when its first non-blank line is a complete JSON value and another
    non-blank line follows; then it cannot be one document.  Everything else is one document.
    """
    lines = _text(spark, path, whole=False).where(~F.col("value").rlike(BLANK_LINE))
    first = F.min_by("value", F.struct("block", "line"))
    return (
        lines.withColumn("line", F.monotonically_increasing_id())
        .groupBy("file")
        .agg(first.alias("head"), F.count("*").alias("n"))
        .select(
            "file",
            F.when((F.col("n") > 1) & is_one_json_value(F.col("head")), LINES).otherwise(DOCUMENT).alias("layout"),
        )
    )


def read_documents(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(file, value) with one row per file."""
    return _text(spark, path, whole=True).select("file", "value")


def read_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(pos, json) with one row per non-blank line; the scan splits large files."""
    return place_lines(_text(spark, path, whole=False).withColumn("line", F.monotonically_increasing_id()))


def place_lines(lines: DataFrame) -> DataFrame:
    """(pos, json) of the non-blank lines of (value, file, block, line)."""
    zero = F.lit(0)
    return lines.where(~F.col("value").rlike(BLANK_LINE)).select(
        _pos(F.col("file"), F.col("block"), F.col("line"), zero, zero).alias("pos"), F.col("value").alias("json")
    )


def _unreadable(what: str, detail: Column) -> Column:
    message = F.concat(F.lit(f"{what} is not valid JSON: "), F.substring(detail, 1, 200))
    return F.raise_error(message).cast("array<string>")


def _checked(lines: DataFrame) -> DataFrame:
    """Fail on a line that is not exactly one JSON value."""
    json = F.col("json")
    return lines.withColumn(
        "json", F.when(is_one_json_value(json), json).otherwise(_unreadable("line", json).cast("string"))
    )


def flatten_items(items: DataFrame, search_wrappers: Column | None = None) -> DataFrame:
    """Conversations among items (pos, json): the item itself, else the values it wraps.

    One level of wrapping is searched, only where the item is no conversation, and only where
    ``search_wrappers`` holds (everywhere by default).
    """
    wrappers = F.lit(True) if search_wrappers is None else search_wrappers
    shaped = items.withColumn("_is", F.expr(looks_like_conversation("json")))
    wrapped = F.when(wrappers, member_values("json"))
    candidates = F.when(F.col("_is"), F.array("json")).otherwise(wrapped)
    inner = shaped.select("pos", "_is", F.posexplode(candidates).alias("part", "raw"))
    kept = F.col("_is") | F.expr(looks_like_conversation("raw"))
    return inner.where(kept).select(F.col("pos").withField("part", F.col("part").cast("bigint")).alias("pos"), "raw")


def flatten_documents(documents: DataFrame) -> DataFrame:
    """(pos, raw) of the conversations in whole documents (file, value), in one pass.

    A list is searched with its wrappers.  An object gives the lists under its container keys, in
    their fixed order, and then itself; their items are not searched for wrappers.
    """
    readable = documents.withColumn(
        "_list",
        F.when(is_one_json_value(F.col("value")), list_items("value")).otherwise(
            _unreadable("document", F.col("value"))
        ),
    ).withColumn("_object", F.from_json("value", "map<string,string>"))

    def placed(array: Column, place: int) -> Column:
        entries = F.transform(
            array, lambda json, i: F.struct(F.lit(place).alias("place"), i.alias("item"), json.alias("json"))
        )
        return F.coalesce(entries, F.array().cast("array<struct<place:int,item:int,json:string>>"))

    held = [placed(F.col("_list"), 0)]
    held += [
        placed(member_list("value", key), n + 1) for n, key in enumerate(CONTAINER_KEYS)
    ]
    root = F.when(F.col("_object").isNotNull(), F.array("value"))
    held.append(placed(root, len(CONTAINER_KEYS) + 1))
    items = readable.select("file", F.explode(F.concat(*held)).alias("h")).select(
        _pos(F.col("file"), F.lit(0), F.col("h.place"), F.col("h.item"), F.lit(0)).alias("pos"),
        F.col("h.json").alias("json"),
    )
    return flatten_items(items, F.col("pos.line") == 0)


def read_export(spark: SparkSession, path: str | list[str], layout: str = AUTO) -> DataFrame:
    """Conversations of an export as (pos, raw).

    ``layout`` may name the file layout; ``auto`` looks at the files first, which reads them once more.
    A newline-delimited file with a single line counts as a document.
    """
    if layout == DOCUMENT:
        return flatten_documents(read_documents(spark, path))
    lines = read_lines(spark, path)
    if layout == LINES:
        return flatten_items(_checked(lines))
    layouts = file_layouts(spark, path)
    by_document = layouts.where(F.col("layout") == DOCUMENT).select("file")
    by_line = layouts.where(F.col("layout") == LINES).select(F.col("file").alias("_f"))
    documents = read_documents(spark, path).join(by_document, "file", "left_semi")
    lined = lines.join(by_line, F.col("pos.file") == F.col("_f"), "left_semi")
    return flatten_documents(documents).unionByName(flatten_items(_checked(lined)))
