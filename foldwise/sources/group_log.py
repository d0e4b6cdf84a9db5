"""Files that a long-running task adds to a folder, one for each group of rows it has finished."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as fs
import pyarrow.parquet as pq
from pyspark.sql import SparkSession


def place(uri: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a URI as Hadoop writes it, in which blanks and the like stand as they are."""
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    head, _, rest = uri.partition("://")
    host, _, path = rest.partition("/")
    if head in ("hdfs", "viewfs"):
        return fs.FileSystem.from_uri(f"{head}://{host}/")[0], "/" + path
    return fs.FileSystem.from_uri(uri)


def placed(spark: SparkSession, path: str) -> str | None:
    """URI of a folder that tasks can write; null where Arrow doesn't know its file system."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    uri = folder.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(folder).toString()
    try:
        place(uri)
    except (ValueError, OSError, NotImplementedError):
        return None
    return uri


@dataclass
class GroupLog:
    """A parquet file for each group, which appears whole.

    ``schema``: the columns of a file; those that a group's rows lack are null.  ``dim``: the length that vectors must have, 0 when
    none is known yet, null when any will do.  ``may_fail``: whether its user goes on without it.
    """

    folder: str
    schema: pa.Schema
    dim: int | None = None
    may_fail: bool = False

    def _path(self, root: str, group: int) -> str:
        return f"{root}/group-{group:010d}.parquet"

    def read(self, group: int) -> pa.Table | None:
        """(id, vector) of a group that is there."""
        try:
            system, root = place(self.folder)
            if system.get_file_info(self._path(root, group)).type != fs.FileType.File:
                return None
            with system.open_input_file(self._path(root, group)) as source:
                return pq.ParquetFile(source).read(columns=["id", "vector"])
        except (ValueError, OSError):
            if self.may_fail:
                return None
            raise

    def write(self, group: int, rows: pa.Table) -> None:
        if self.dim is not None:
            sizes = {n for n in pc.unique(pc.list_value_length(rows["vector"])).to_pylist()} | ({self.dim} if self.dim else set())
            if len(sizes) > 1:
                raise ValueError(f"vectors of different dimensions: {sorted(sizes)}")
            self.dim = max(sizes, default=0)
        columns = [rows[f.name].cast(f.type) if f.name in rows.column_names else pa.nulls(len(rows), f.type) for f in self.schema]
        system, root = place(self.folder)
        system.create_dir(root, recursive=True)
        hidden = f"{root}/.{uuid.uuid4().hex}"
        with system.open_output_stream(hidden) as out:
            pq.write_table(pa.table(columns, schema=self.schema), out)
        system.move(hidden, self._path(root, group))
