"""One query for each operator over whole tables, and the SQL they are checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foldwise.llm import decontaminate, fingerprint, hnsw, language, licenses, main_text, near_dups, phrases, pieces, quality, token_files, turns, warc
from foldwise.session import configure

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the corpus; Arrow batches are kept small because texts may be long."""
    configure(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "256")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op1_token_counts(spark, sf_dir):
    return token_files.count_tokens(table(spark, sf_dir, "documents")).select("doc_id", "n_tokens", "file", "document", "first_token")


@query
def op2_main_text(spark, sf_dir):
    return main_text.extract(table(spark, sf_dir, "pages"))


@query
def op3_near_groups(spark, sf_dir):
    return near_dups.near_groups(table(spark, sf_dir, "documents"))


@query
def op4_quality(spark, sf_dir):
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op5_warc(spark, sf_dir):
    return warc.archive_and_read(table(spark, sf_dir, "pages"))


@query
def op6_language(spark, sf_dir):
    return language.identify(table(spark, sf_dir, "documents"))


@query
def op7_fingerprints(spark, sf_dir):
    return fingerprint.compare_with_edit(table(spark, sf_dir, "documents"))


@query
def op8_licences(spark, sf_dir):
    """Documents as files <source>/<language>/<hundred of the id>/<id>.txt.

    A document whose first line states a licence stands for the licence file of its directory.
    """
    docs = table(spark, sf_dir, "documents")
    path = F.concat_ws("/", "source", "lang", F.floor(F.col("doc_id") / 100).cast("string"), F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))
    files = docs.select("doc_id", path.alias("path"), "text")
    return licenses.scan(files, F.col("own_line") == 0).drop("text")


@query
def op9_benchmark_leaks(spark, sf_dir):
    return decontaminate.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op10_sentencepiece(spark, sf_dir):
    """doc_id, n_pieces, ids and whether decoding gives the text back."""
    docs = table(spark, sf_dir, "documents")
    decoded = pieces.round_trip(docs)
    return decoded.select("doc_id", F.size("ids").cast("bigint").alias("n_pieces"), "ids", "same")


@query
def op11_neighbours(spark, sf_dir):
    """The five nearest vectors of each row whose id is divisible by 50."""
    return hnsw.nearest_neighbours(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


@query
def op12_turn_repair(spark, sf_dir):
    """Conversations after damage, and their cheapest repair."""
    conversations = table(spark, sf_dir, "conversations")
    return turns.repair(turns.damage(conversations), conversations)


@query
def op13_phrases(spark, sf_dir):
    """The best phrases of two to four words of each language."""
    return phrases.collocations(table(spark, sf_dir, "documents"))
