"""Session settings and reliable materialisation shared by every job."""

from __future__ import annotations

import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: Rows that one task may hold for a step that is sequential by nature: the remainder of a contraction, a slice of
#: a hierarchy.  Rounds or slices over the cluster bring larger tables down to it.
SINGLE_TASK_ROWS = 1_000_000


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Give Python workers this package, wherever the driver imported it from; once per application."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    package = Path(__file__).resolve().parent
    if package.is_dir():
        archive = Path(tempfile.mkdtemp(prefix="foldwise-code-")) / package.name
        sc.addPyFile(shutil.make_archive(str(archive), "zip", package.parent, package.name))
    _shipped.add(sc.applicationId)


def configure(spark: SparkSession) -> SparkSession:
    """Set the runtime options the engine's results depend on."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.execution.arrow.pyspark.enabled", "true")
    spark.conf.set("spark.sql.variant.allowDuplicateKeys", "true")
    ship_package(spark)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can read, as named by the cluster.

    A machine-local folder is created only for a local master with nothing configured.
    """
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if named is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir is not set; it must name a folder shared by all executors")
        named = tempfile.mkdtemp(prefix="foldwise-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(named)
    return named


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def spread(df: DataFrame, groups: int, *keys: str) -> DataFrame:
    """Hash-partition by the keys of costly groups into a fixed number of tasks.

    Adaptive execution would merge partitions by their bytes and so run heavy work on few cores.
    """
    tasks = max(1, min(groups, 4 * df.sparkSession.sparkContext.defaultParallelism))
    return df.repartition(tasks, *keys)


def materialise(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint, so a lost executor cannot change row order or ids."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame, name: str = "table") -> DataFrame:
    """Cut the lineage with a table in the shared folder.

    A checkpoint keeps the size that was estimated for its plan, which joins multiply; over rounds of joins the numbers
    grow without bound.  A table has its true size, so joins of small ones are broadcast.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
