"""Writing every conversation of an export to a file of its own."""

from __future__ import annotations

import json
import os
import uuid

import pandas as pd
import pyarrow.fs as fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foldwise.functions import identifiers as I
from foldwise.functions import jsonval as J
from foldwise.operators.ordering import with_row_index
from foldwise.session import materialise, shared_dir
from foldwise.sources.group_log import place, placed


def named_conversations(conversations: DataFrame) -> DataFrame:
    """(row_index, file_name, raw) from (pos, raw); the number is the place in the whole export."""
    numbered = with_row_index(conversations, "pos").withColumn("m", F.expr("from_json(raw, 'map<string,variant>')"))
    texts = [J.string_or_null(f"m['{key}']") for key in ("conversation_id", "id", "title")]
    return numbered.withColumn("identifier", F.expr(I.derive_identifier(*texts, "row_index"))).select(
        "row_index", F.expr(I.file_name("identifier", "row_index")).alias("file_name"), "raw"
    )


def duplicate_names(named: DataFrame) -> DataFrame:
    return named.groupBy("file_name").count().where("count > 1").select("file_name")


def write_conversation_files(named: DataFrame, output_dir: str, indent: int = 2) -> DataFrame:
    """Write one JSON document per row and return (path) of each; a repeated name is an error.

    Files appear under their names only when all are written.  Tasks write hidden files, each attempt of a task its own, and
    list them; then the listed ones are renamed, also by tasks, which a repeated attempt finds done.  A job that fails or
    repeats tasks leaves no partial file, and nothing passes the driver.  What lost attempts wrote is removed.
    """
    clash = duplicate_names(named).take(1)
    if clash:
        raise ValueError(f"duplicate file name: {clash[0].file_name}")
    target, uri = _folder(named.sparkSession, output_dir)
    hidden = f"_writing-{uuid.uuid4().hex}"

    def write(batches):
        system, root = place(uri)
        folder = f"{root}/{hidden}/{uuid.uuid4().hex}"
        system.create_dir(folder, recursive=True)
        for pdf in batches:
            for name, raw in zip(pdf["file_name"], pdf["raw"]):
                with system.open_output_stream(f"{folder}/{name}") as out:
                    out.write((json.dumps(json.loads(raw), ensure_ascii=False, indent=indent) + "\n").encode())
            yield pd.DataFrame({"folder": folder.rsplit("/", 1)[1], "file_name": pdf["file_name"]})

    def publish(batches):
        system, root = place(uri)
        for pdf in batches:
            for folder, name in zip(pdf["folder"], pdf["file_name"]):
                path = f"{root}/{name}"
                try:
                    system.move(f"{root}/{hidden}/{folder}/{name}", path)
                except FileNotFoundError:  # another attempt moved it, maybe just now
                    if system.get_file_info(path).type != fs.FileType.File:
                        raise
            yield pd.DataFrame({"path": target + "/" + pdf["file_name"]})

    listed = materialise(named.select("file_name", "raw").mapInPandas(write, "folder string, file_name string"))
    done = materialise(listed.mapInPandas(publish, "path string"))
    system, root = place(uri)
    if system.get_file_info(f"{root}/{hidden}").type == fs.FileType.Directory:
        system.delete_dir(f"{root}/{hidden}")
    return done


def _folder(spark: SparkSession, output_dir: str) -> tuple[str, str]:
    """The folder as Spark reads it, and its URI for tasks.

    A path without a scheme is one of the cluster's default file system.  Where that is the machines' own, only a folder
    below the shared one is the same for all tasks.
    """
    target = output_dir.rstrip("/")
    uri = placed(spark, target)
    if uri is None:
        raise ValueError(f"tasks can't write to the file system of {target}")
    if "://" in target or target.startswith("file:"):
        return target, uri
    if not uri.startswith("file:"):
        return uri, uri
    target = os.path.abspath(target)
    uri = f"file:{target}"
    if not spark.sparkContext.master.startswith("local") and not uri.startswith(f"{placed(spark, shared_dir(spark))}/"):
        raise ValueError(f"name the file system of {target}: tasks would write to their own machines")
    return target, uri
