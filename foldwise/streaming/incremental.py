"""Keeping the embedding store up to date with newly arriving export files."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foldwise.functions import text as T
from foldwise.operators import embedding, normalize
from foldwise.plans.move_plan import PlanParameters, embed_in_groups
from foldwise.session import configure, materialise
from foldwise.sources import export, store


def fill_step(
    spark: SparkSession, conversations: DataFrame, store_path: str, make_embedder: Callable[[], embedding.Embedder],
    parameters: PlanParameters,
) -> int:
    """Embed the unfiled chats among (pos, raw) that the store lacks; returns how many were added."""
    chats = normalize.dedup_latest(normalize.normalize_chats(conversations))
    _, unfiled = normalize.split_filed(chats)
    todo = materialise(store.misses(unfiled, store.lookup(spark, store_path, unfiled)))
    added = todo.count()
    if not added:
        return 0
    chats = normalize.with_excerpt(todo, parameters.conversation_word_limit)
    texts = materialise(chats.withColumn("text", F.expr(T.embedding_text("title", "prompt_excerpt"))))
    embed_in_groups(texts, parameters, make_embedder, store_path)
    return added


def fill_from_stream(
    spark: SparkSession, export_dir: str, store_path: str, checkpoint_dir: str,
    make_embedder: Callable[[], embedding.Embedder] = embedding.HashingEmbedder, parameters: PlanParameters | None = None,
    files_per_step: int = 1000,
) -> None:
    """Process the export files not seen before, documents and newline-delimited ones alike, then stop.

    The stream tells which files are new; their contents go through the batch reader, so a broken line or document
    fails the run instead of being lost.  Each group of requests is stored before the next
    is made.  A replayed batch looks up what it already stored, so no text is embedded twice.
    """
    p = parameters or PlanParameters()
    configure(spark)
    arrived = (
        spark.readStream.format("binaryFile")
        .schema("path string, modificationTime timestamp, length bigint, content binary")
        .option("maxFilesPerTrigger", files_per_step)
        .option("recursiveFileLookup", "true")
        .load(export_dir)
        .select(F.col("_metadata.file_path").alias("file"))
    )

    def add(batch: DataFrame, batch_id: int) -> None:
        files = sorted(r.file for r in batch.distinct().collect())  # files_per_step at most
        if files:
            fill_step(batch.sparkSession, export.read_export(batch.sparkSession, files), store_path, make_embedder, p)

    query = (
        arrived.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint_dir).trigger(availableNow=True).start()
    )
    query.awaitTermination()
