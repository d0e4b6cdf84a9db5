"""The latest version of every conversation over files that arrive apart.

The aggregate of ``dedup_latest`` runs as a streaming aggregate: its state holds, for each id, the place first seen and the
freshest version, so a version that arrives late or twice changes nothing, and versions of one id are combined
before the shuffle.  Each step writes the ids that changed; of an id's rows the one of the latest step counts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from foldwise.operators import normalize
from foldwise.session import configure


def arriving(spark: SparkSession, folder: str, schema: StructType, files_per_step: int = 1000) -> DataFrame:
    """Stream of the rows of Parquet files below ``folder``, those of sub-folders too."""
    configure(spark)
    return spark.readStream.schema(schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", files_per_step).parquet(folder)


def keep_latest(chats: DataFrame, target: str, checkpoint_dir: str) -> None:
    """Take in what has newly arrived of a stream of chat rows (id, pos, update_time, ...), then stop.

    A step that is repeated after a failure writes its folder anew, so no change is counted twice.
    """

    def write(changed: DataFrame, step: int) -> None:
        changed.write.mode("overwrite").parquet(f"{target}/step={step}")

    query = (
        normalize.dedup_latest(chats).writeStream.outputMode("update").foreachBatch(write)
        .option("checkpointLocation", checkpoint_dir).trigger(availableNow=True).start()
    )
    query.awaitTermination()


def read_latest(spark: SparkSession, target: str) -> DataFrame:
    """One row for each id: its state after the last step that changed it."""
    rows = spark.read.parquet(target)
    others = [c for c in rows.columns if c not in ("id", "step")]
    return rows.groupBy("id").agg(F.max_by(F.struct(*others), "step").alias("row")).select("id", "row.*")
