"""Binary files written and read by Spark tasks.

Spark's text sink writes each string's bytes and a separator as they are, through its own committer, so a table
of byte strings becomes flat binary files that survive lost executors.  Ranges are read with Arrow's file systems.
"""

from __future__ import annotations

from functools import lru_cache

import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_bytes(rows: DataFrame, column: str, separator: bytes, path: str) -> None:
    """Write the byte strings of ``column``, each followed by ``separator``, as part files below ``path``."""
    texts = rows.select(F.col(column).cast("string").alias("value"))
    texts.write.option("lineSep", separator.decode("iso-8859-1")).option("encoding", "ISO-8859-1").text(path)


def files(spark: SparkSession, path: str) -> DataFrame:
    """(path, length) of the files; contents are not read."""
    return spark.read.format("binaryFile").load(path).select("path", "length").where("length > 0")


@lru_cache(maxsize=64)
def _system(scheme_and_host: str):
    return pafs.FileSystem.from_uri(scheme_and_host)[0]


def _place(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system and the path of a file named by a URI as Spark writes it."""
    if uri.startswith("file:"):
        from urllib.parse import unquote

        return pafs.LocalFileSystem(), unquote("/" + uri[5:].lstrip("/"))
    head, _, rest = uri.partition("://")
    if head in ("hdfs", "viewfs"):
        return _system(f"{head}://{rest.split('/', 1)[0]}/"), "/" + rest.split("/", 1)[1]
    return pafs.FileSystem.from_uri(uri)


def open_file(uri: str):
    """A seekable input of a file named by a URI as Spark writes it."""
    system, place = _place(uri)
    return system.open_input_file(place)


def create_file(uri: str):
    """An output stream to a new file."""
    system, place = _place(uri)
    return system.open_output_stream(place)


def make_folder(spark: SparkSession, path: str) -> str:
    """Make a folder; its URI with scheme and host."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    system.mkdirs(folder)
    return system.makeQualified(folder).toString()


def remove_folder(spark: SparkSession, path: str) -> None:
    """Remove a scratch folder that no later step reads."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
