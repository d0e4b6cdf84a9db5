"""Cleaning of a corpus for training, stage by stage: language, quality, near-duplicates, benchmark leaks, encoding."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foldwise.llm import decontaminate, language, near_dups, pieces, quality
from foldwise.llm.queries import table
from foldwise.session import scratch_path

#: Documents with a smaller language score are rejected, as are those without a letter.
LANGUAGE_SCORE = 0.3
#: Documents with a smaller quality score are rejected.
QUALITY_SCORE = 0.3


def _prepared(docs: DataFrame) -> DataFrame:
    docs.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "256")
    return docs


def keep_known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language the network knows; lettered texts it is unsure of go too."""
    network = language.fit(_prepared(docs))
    return language.filter_known(docs, network, LANGUAGE_SCORE)


def keep_good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the factorisation machine scores as good."""
    machine = quality.fit(_prepared(docs), table(spark, sf_dir, "labels"))
    return quality.filter_good(docs, machine, QUALITY_SCORE)


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each near-duplicate group; of rows that repeat an id one stays."""
    groups = near_dups.near_groups(_prepared(docs))
    gone = groups.where(~F.col("kept") & F.col("doc_id").isNotNull()).select("doc_id").distinct()
    left = docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
    return near_dups.without_repeats(left)


def remove_leaking(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item stands."""
    return decontaminate.without_leaks(_prepared(docs), table(spark, sf_dir, "benchmark"))


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, n_pieces, ids and whether they decode to the text."""
    done = pieces.round_trip(_prepared(docs))
    return done.select("doc_id", F.size("ids").cast("bigint").alias("n_pieces"), "ids", "same")


STAGES = [
    ("language ID", keep_known_language),
    ("quality classifier", keep_good_quality),
    ("MinHash near-dedup", keep_one_of_each_group),
    ("benchmark decontamination", remove_leaking),
    ("SentencePiece encoding and decoding", encode_pieces),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to the documents; each stage's result is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES):
        path = scratch_path(spark, f"stage-{number}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs


#: Models that are trained have no SQL.
ORACLE_SQL = None
