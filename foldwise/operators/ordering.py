"""Dense row numbers over a global order without a single-task window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foldwise.session import materialise

_LOCAL_BITS = (1 << 33) - 1


def with_row_index(df: DataFrame, *order: str | Column, index: str = "row_index") -> DataFrame:
    """Add the 0-based rank of each row by ``order``, which must identify rows uniquely.

    Rows are range-partitioned and sorted once; the checkpoint fixes that arrangement.  The only
    table that meets in one task has one row per partition.
    """
    placed = materialise(
        df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    )
    part = F.shiftright(F.col("_at"), 33)
    sizes = placed.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    return (
        placed.join(F.broadcast(offsets), part == F.col("_part"))
        .withColumn(index, F.col("_offset") + F.col("_at").bitwiseAND(F.lit(_LOCAL_BITS)))
        .drop("_at", "_part", "_offset")
    )


def chunk_rows(df: DataFrame, size: int, *order: str | Column, chunk: str = "chunk") -> DataFrame:
    """Number consecutive runs of ``size`` rows."""
    return with_row_index(df, *order, index="_row").withColumn(chunk, F.floor(F.col("_row") / size)).drop("_row")
