"""Token counts of documents in flat token files by a separator scan.

A token file is a run of little-endian token ids in which an end-of-document id follows each document; it has no
index.  Files are cut into blocks that are searched in any order.  Each block reports where its separators lie; a
prefix scan over the blocks' summaries gives each block the number of separators before it and the place of the
last one, which completes the documents that cross block borders.
"""

from __future__ import annotations

import base64
import contextlib
import uuid
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foldwise.llm import bytetext as B
from foldwise.llm.flatfiles import create_file, files, make_folder, open_file, write_bytes
from foldwise.session import scratch_path

RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Splits a text into runs that are tokenised on their own; fixed by the vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SEPARATOR = 50256
WIDTH = 2
BLOCK_TOKENS = 1 << 20


@lru_cache(maxsize=1)
def _encoding(name: str):
    import tiktoken

    with open(SparkFiles.get(name), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def _tokens(name: str, width: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = _encoding(name)
        for batch in batches:
            for a, b in B.row_slices(batch["text"]):
                texts = [t or "" for t in batch["text"].slice(a, b - a).to_pylist()]
                out = [np.array(ids, f"<u{width}").tobytes() for ids in encoding.encode_ordinary_batch(texts, num_threads=1)]
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["tokens"])

    return run


def write_token_files(docs: DataFrame, path: str, ranks: str = RANKS, separator: int = SEPARATOR, width: int = WIDTH) -> None:
    """Tokenise ``text`` and write one flat file for each partition of ``docs``, in row order.

    A null or empty text is a document without tokens.
    """
    docs.sparkSession.sparkContext.addFile(ranks)
    tokens = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(_tokens(ranks.rsplit("/", 1)[-1], width), "tokens binary")
    write_bytes(tokens, "tokens", separator.to_bytes(width, "little"), path)


def _search(separator: int, width: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, block, start, size in zip(*(batch[c].to_pylist() for c in ("path", "block", "start", "size"))):
                with open_file(path) as source:
                    found = np.frombuffer(source.read_at(size * width, start * width), f"<u{width}")
                ends = np.flatnonzero(found == separator) + start
                yield pa.RecordBatch.from_arrays(
                    [pa.array([path]), pa.array([block], pa.int64()), pa.array([start + size], pa.int64()), pa.ListArray.from_arrays(pa.array([0, len(ends)], pa.int32()), pa.array(ends.astype(np.int64)))],
                    names=["path", "block", "stop", "ends"],
                )

    return run


def scan_token_files(spark: SparkSession, path: str, separator: int = SEPARATOR, width: int = WIDTH, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """(path, document, first_token, n_tokens) of every document, numbered from 0 within its file.

    Tokens after the last separator of a file are a document of their own.  Two separators in a row enclose a document
    without tokens.  Empty files have no documents.  A file whose length is no multiple of the token width raises.
    """
    total = (F.col("length") / width).cast("bigint")
    whole = F.when(F.col("length") % width == 0, total).otherwise(F.raise_error(F.concat(F.lit("length is no multiple of the token width: "), F.col("path"))).cast("bigint"))
    blocks = files(spark, path).select("path", whole.alias("total")).select("path", "total", F.explode(F.sequence(F.lit(0), F.ceil(F.col("total") / block_tokens) - 1)).alias("block"))
    blocks = blocks.select("path", F.col("block").cast("bigint").alias("block"), (F.col("block") * block_tokens).cast("bigint").alias("start"), F.col("total"))
    blocks = blocks.withColumn("size", F.least(F.lit(block_tokens), F.col("total") - F.col("start")).cast("bigint"))
    found = blocks.repartition("path", "block").mapInArrow(_search(separator, width), "path string, block bigint, stop bigint, ends array<bigint>")
    before = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    number = F.coalesce(F.sum(F.size("ends")).over(before), F.lit(0))
    previous = F.coalesce(F.max(F.expr("try_element_at(ends, -1)")).over(before), F.lit(-1))
    is_last = F.lead("block").over(Window.partitionBy("path").orderBy("block")).isNull()
    placed = found.select("path", "ends", "stop", number.alias("number"), previous.alias("previous"), is_last.alias("is_last"))
    tail = F.coalesce(F.expr("try_element_at(ends, -1)"), F.col("previous")) + 1 < F.col("stop")
    stops = F.when(F.col("is_last") & tail, F.concat("ends", F.array("stop"))).otherwise(F.col("ends"))
    rows = placed.select("path", "number", F.concat(F.array("previous"), stops).alias("stops")).select("path", "number", "stops", F.posexplode(F.expr("slice(stops, 2, size(stops))")).alias("at", "stop"))
    first = F.expr("stops[at]") + 1
    return rows.select("path", (F.col("number") + F.col("at")).cast("bigint").alias("document"), first.alias("first_token"), (F.col("stop") - first).alias("n_tokens"))


def _listed(name: str, folder: str, separator: int, width: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding, end = _encoding(name), separator.to_bytes(width, "little")
        file = f"{uuid.uuid4().hex}.tokens"  # one for each attempt of a task
        number = 0
        with contextlib.ExitStack() as opened:
            out = None
            for batch in batches:
                out = out or opened.enter_context(create_file(f"{folder}/{file}"))
                for a, b in B.row_slices(batch["text"]):
                    texts = [t or "" for t in batch["text"].slice(a, b - a).to_pylist()]
                    sizes = []
                    for ids in encoding.encode_ordinary_batch(texts, num_threads=1):
                        out.write(np.array(ids, f"<u{width}").tobytes() + end)
                        sizes.append(len(ids))
                    places = pa.array(range(number, number + len(sizes)), pa.int64())
                    number += len(sizes)
                    yield pa.RecordBatch.from_arrays(
                        [batch["doc_id"].slice(a, b - a), pa.array([file] * len(sizes), pa.string()), places, pa.array(sizes, pa.int64())],
                        names=["doc_id", "file", "document", "written"],
                    )

    return run


def count_tokens(docs: DataFrame, folder: str | None = None, ranks: str = RANKS, separator: int = SEPARATOR, width: int = WIDTH) -> DataFrame:
    """doc_id, n_tokens, first_token, file, document of every row of ``docs``, through token files below ``folder``.

    Files carry no ids.  The task that writes a file also lists which document stands at which place of it, so both
    come from one evaluation of ``docs``, in whatever order its rows arrive.  A repeated attempt writes a file of its
    own; files of lost attempts are not listed and so never counted.  A listed document that the scan doesn't find, or
    finds with another number of tokens than were written, raises.  Null and empty texts have no tokens; repeated
    ids keep a row each; other columns are ignored; an empty table gives an empty table.
    """
    spark = docs.sparkSession
    folder = make_folder(spark, folder or scratch_path(spark, "tokens"))
    files_at = make_folder(spark, f"{folder}/files")
    spark.sparkContext.addFile(ranks)
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    write = _listed(ranks.rsplit("/", 1)[-1], files_at, separator, width)
    rows.mapInArrow(write, "doc_id bigint, file string, document bigint, written bigint").write.parquet(f"{folder}/places")
    placed = spark.read.parquet(f"{folder}/places")
    scanned = scan_token_files(spark, files_at, separator, width).select(F.regexp_extract("path", r"([^/]*)$", 1).alias("file"), "document", "first_token", "n_tokens")
    lost = F.raise_error(F.lit("token files and documents differ")).cast("bigint")
    # what the scan finds is far larger than the list of blocks it starts from, by which its size would be judged
    return placed.join(scanned.hint("merge"), ["file", "document"], "left").select(
        "doc_id", F.when(F.col("n_tokens") == F.col("written"), F.col("n_tokens")).otherwise(lost).alias("n_tokens"), "first_token", "file", "document"
    )
