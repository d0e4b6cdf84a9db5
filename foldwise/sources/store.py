"""Keyed table of embeddings: an append-only log of upserts in parquet, read as the latest row per id.

An upsert writes one folder and rewrites nothing, so its cost follows the new rows, not the store.  The folder is
its own unless the caller names it, so writers at the same time lose nothing; of one step the later write wins.
Writing a named folder again replaces it, which makes a replayed micro-batch harmless.
"""

from __future__ import annotations

import time
import uuid
from dataclasses import replace

import pyarrow as pa
from pyspark.errors import AnalysisException, PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foldwise.sources.group_log import GroupLog, placed

SCHEMA = T.StructType(
    [
        T.StructField("id", T.StringType(), False),
        T.StructField("vector", T.ArrayType(T.FloatType())),
        T.StructField("title", T.StringType()),
        T.StructField("prompt_excerpt", T.StringType()),
        T.StructField("create_time", T.DoubleType()),
        T.StructField("update_time", T.DoubleType()),
        T.StructField("vectors", T.MapType(T.StringType(), T.ArrayType(T.FloatType()))),
    ]
)
_VECTOR = pa.list_(pa.float32())
_ARROW = pa.schema(
    [("id", pa.string()), ("vector", _VECTOR), ("title", pa.string()), ("prompt_excerpt", pa.string()), ("create_time", pa.float64()),
     ("update_time", pa.float64()), ("vectors", pa.map_(pa.string(), _VECTOR))]
)
_WRITE = ("step", "write")
#: Start of Spark's error conditions for files it cannot read.
UNREADABLE = "FAILED_READ_FILE"


def is_store_error(error: Exception) -> bool:
    """Whether the store itself is at fault: its path, its files or the shape of its vectors.  Lost executors and bugs are not."""
    if isinstance(error, (AnalysisException, ValueError, OSError)):
        return True
    if isinstance(error, PySparkException) and (error.getCondition() or "").startswith(UNREADABLE):
        return True
    cause = getattr(error, "java_exception", None)
    if cause is not None and cause.getClass().getName().startswith(("java.io.", "java.nio.file.", "org.apache.hadoop.")):
        return True
    while cause is not None:
        if f"[{UNREADABLE}" in (cause.getMessage() or "")[:200]:
            return True
        cause = cause.getCause()
    return False


def _log(spark: SparkSession, path: str) -> DataFrame:
    """Every written row with its step and write; empty when the store does not exist yet."""
    schema = T.StructType(SCHEMA.fields + [T.StructField("step", T.LongType()), T.StructField("write", T.StringType())])
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return spark.createDataFrame([], schema)
        raise


def latest(log: DataFrame) -> DataFrame:
    """The last written row of each id; rows combine before the shuffle.  Of repeats in one write the greatest row wins."""
    columns = [c for c in log.columns if c not in ("id", *_WRITE)]
    order = F.struct(*_WRITE, *[c for c in columns if c != "vectors"])
    return log.groupBy("id").agg(F.max_by(F.struct(*columns), order).alias("r")).select("id", "r.*")


def read_store(spark: SparkSession, path: str) -> DataFrame:
    return latest(_log(spark, path))


def first_vector(vector: str = "vector", named: str | None = None) -> str:
    """SQL text for a row's vector: its own, else the first of its named vectors; null when empty."""
    value = f"coalesce({vector}, get(map_values({named}), 0))" if named else vector
    return f"if(size({value}) > 0, {value}, null)"


def lookup(spark: SparkSession, path: str, ids: DataFrame) -> DataFrame:
    """(id, vector) of the given ids that have a stored vector.

    The log is cut to the wanted ids before versions are compared, and only two columns are read.
    """
    wanted = _log(spark, path).select("id", "vector", "vectors", *_WRITE).join(ids.select("id").distinct(), "id", "left_semi")
    return latest(wanted).select("id", F.expr(first_vector(named="vectors")).alias("vector")).where(F.col("vector").isNotNull())


def next_step(spark: SparkSession, path: str) -> int:
    last = _log(spark, path).agg(F.max("step")).first()[0]
    return 0 if last is None else last + 1


def new_write() -> str:
    return f"{time.time_ns():020d}-{uuid.uuid4().hex}"


def payload(rows: DataFrame) -> list[Column]:
    """The stored columns of rows but for the vector; missing ones are null."""
    return [(F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in SCHEMA if f.name != "vector"]


def group_log(spark: SparkSession, path: str, may_fail: bool = False) -> GroupLog | None:
    """A folder of one upsert that tasks fill group by group, each with an id of its own; null where they can't write there.

    All vectors must have one dimension.
    """
    held = _log(spark, path).where(F.col("vector").isNotNull()).select(F.size("vector").alias("n")).take(1)
    folder = placed(spark, f"{path.rstrip('/')}/step={next_step(spark, path)}/write={new_write()}")
    return None if folder is None else GroupLog(folder, _ARROW, held[0].n if held else 0, may_fail)


def after_run(log: GroupLog, made: DataFrame) -> GroupLog:
    """The log for the groups after those of a task, which gave (vector, problem); a problem raises."""
    failed = made.where(F.col("problem").isNotNull()).select("problem").first()
    if failed:
        raise OSError(failed.problem)
    first = made.select(F.size("vector").alias("n")).first()
    return replace(log, dim=first.n) if first else log


def scratch_log(spark: SparkSession, path: str) -> GroupLog | None:
    """A folder of ids and vectors that no store keeps."""
    folder = placed(spark, path)
    return None if folder is None else GroupLog(folder, pa.schema([_ARROW.field("id"), _ARROW.field("vector")]))


def upsert(spark: SparkSession, path: str, rows: DataFrame, step: int | None = None) -> None:
    """Write rows (id, vector, payload); later steps win.  All vectors must have one dimension.

    ``step`` names the folder: writing it again replaces it.  Missing payload columns are null.
    """
    at, write = (next_step(spark, path), new_write()) if step is None else (step, "named")
    shaped = rows.select(*[(F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in SCHEMA])
    new, held = (d.where(F.col("vector").isNotNull()).select(F.size("vector").alias("n")) for d in (shaped, _log(spark, path)))
    sizes = {r.n for r in new.distinct().take(2) + held.take(1)}
    if len(sizes) > 1:
        raise ValueError(f"vectors of different dimensions: {sorted(sizes)}")
    shaped.write.mode("overwrite").parquet(f"{path.rstrip('/')}/step={at}/write={write}")


def misses(chats: DataFrame, cached: DataFrame) -> DataFrame:
    """Chats without a stored vector."""
    return chats.join(cached.select("id"), "id", "left_anti")


def vectors_for_chats(chats: DataFrame, *sources: DataFrame) -> DataFrame:
    """Chats with their vectors, from the cache and the newly made ones."""
    vectors = sources[0].select("id", "vector")
    for more in sources[1:]:
        vectors = vectors.unionByName(more.select("id", "vector"))
    return chats.join(vectors, "id")


def missing_vectors(chats: DataFrame, vectors: DataFrame) -> DataFrame:
    """Ids left without a vector."""
    return chats.join(vectors.select("id"), "id", "left_anti").select("id")
