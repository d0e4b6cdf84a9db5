"""Near-duplicate groups by MinHash with tensored banding.

A document's set holds its distinct five-word shingles.  Two collections of ``BANDS`` hashes, each of ``ROWS``
minhashes, give ``BANDS``² tables: table (i, j) is keyed by the i-th hash of the first and the j-th of the second
collection, so 2·BANDS·ROWS = 40 minhashes do the work of 400.  At similarity 0.85 a pair shares a table except
with probability 2·(1 - 0.85²)^10 < 6e-6.

Keys that occur once leave early.  In a table's bucket every member is checked against the member most common in
it, on full sets.  Buckets whose members are then still in different components are not expanded into pairs:
their members go through an exact prefix and position filter over shingles ordered by rarity, which keeps every
pair that can reach the similarity, and what remains is verified on full sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from foldwise.llm import bytetext as B
from foldwise.llm.graph import components
from foldwise.session import materialise

BANDS = 10
ROWS = 2
PERCENT = 85
SKETCH = "doc_id bigint, n_shingles bigint, set_a bigint, set_b bigint, first array<bigint>, second array<bigint>"
_KEY = ["set_a", "set_b", "n_shingles"]


def _lists(flat: np.ndarray, width: int, filled: np.ndarray) -> pa.Array:
    """One list of ``width`` values for each filled row, null for the others."""
    offsets = np.concatenate([[0], np.cumsum(np.where(filled, width, 0))]).astype(np.int32)
    lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.reshape(-1)))
    return pa.ListArray.from_buffers(
        lists.type, len(filled), [pa.array(filled).buffers()[1], lists.buffers()[1]], null_count=int((~filled).sum()), children=[lists.values]
    )


def _minhashes(values: np.ndarray, starts: np.ndarray, seed: int) -> np.ndarray:
    """BANDS combined hashes of ROWS minhashes for each set; ``starts`` are the first places of non-empty sets."""
    out = np.empty((len(starts), BANDS), np.uint64)
    for band in range(BANDS):
        key = np.zeros(len(starts), np.uint64)
        for row in range(ROWS):
            factor = np.uint64(2 * int(B.mix(np.array([band * ROWS + row], np.uint64), seed)[0] >> np.uint64(1)) + 1)
            key = B.mix(key ^ np.minimum.reduceat((values ^ (factor >> np.uint64(7))) * factor, starts))
        out[:, band] = key
    return out


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b in B.row_slices(batch["text"]):
            data, offsets = B.flat(batch["text"].slice(a, b - a))
            hashes, _, bounds = B.words(data, offsets)
            values, bounds = B.distinct(*B.shingles(hashes, bounds))
            sizes = np.diff(bounds)
            filled = sizes > 0
            starts = bounds[:-1][filled]
            sums = np.zeros((2, len(sizes)), np.uint64)
            first = second = np.zeros((0, BANDS), np.uint64)
            if len(starts):
                for k in range(2):
                    sums[k, filled] = np.add.reduceat(B.mix(values, 11 + k), starts)
                first, second = _minhashes(values, starts, 21), _minhashes(values, starts, 22)
            yield pa.RecordBatch.from_arrays(
                [
                    batch["doc_id"].slice(a, b - a).cast(pa.int64()), pa.array(sizes.astype(np.int64)),
                    pa.array(sums[0].view(np.int64)), pa.array(sums[1].view(np.int64)),
                    _lists(first.view(np.int64), BANDS, filled), _lists(second.view(np.int64), BANDS, filled),
                ],
                names=["doc_id", "n_shingles", "set_a", "set_b", "first", "second"],
            )


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b in B.row_slices(batch["text"]):
            data, offsets = B.flat(batch["text"].slice(a, b - a))
            hashes, _, bounds = B.words(data, offsets)
            values, bounds = B.distinct(*B.shingles(hashes, bounds))
            lists = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(values.view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch["doc_id"].slice(a, b - a).cast(pa.int64()), lists], names=["rep", "shingles"])


def _buckets(heads: DataFrame) -> DataFrame:
    """(bucket, rep, n, centre): the table keys of those sets that share a hash of the first collection.

    ``centre`` counts how many sets share the hashes of this one; it is largest for the text that copies stem from.
    A set is known by ``set_a`` here, as sets whose texts repeat a doc_id have the same rep; it has ``BANDS`` lefts.
    """
    left = heads.select("set_a", F.posexplode("first").alias("i", "left"))
    common = left.groupBy("i", "left").agg(F.count("*").alias("sharing")).where("sharing > 1")
    shared = left.join(common, ["i", "left"]).groupBy("set_a").agg(
        F.sum("sharing").alias("centre"), F.collect_list(F.struct("i", "left")).alias("lefts")
    )
    return (
        heads.select("set_a", "rep", "n", "second").join(shared, "set_a")
        .select("rep", "n", "centre", "second", F.explode("lefts").alias("of"))
        .select("rep", "n", "centre", "of.i", "of.left", F.posexplode("second").alias("j", "right"))
        .select(F.xxhash64("i", "left", "j", "right").alias("bucket"), "rep", "n", "centre")
    )


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets reach the similarity."""
    one = sets.select(F.col("rep").alias("a"), F.col("shingles").alias("of_a"))
    two = sets.select(F.col("rep").alias("b"), F.col("shingles").alias("of_b"))
    both = F.size(F.array_intersect("of_a", "of_b"))
    return pairs.join(one, "a").join(two, "b").where(100 * both >= percent * (F.size("of_a") + F.size("of_b") - both)).select("a", "b")


def _rest(open_sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) in different components that the prefix and position filters leave; complete for the similarity.

    ``open_sets``: rep, comp, shingles.  Shingles are ordered by how few sets hold them.  In the smaller set of a
    similar pair the first common shingle stands within n - ceil(2t/(1+t)·n) + 1, in the larger within n - ceil(t·n) + 1.
    """
    tokens = open_sets.select("rep", "comp", F.size("shingles").cast("bigint").alias("n"), F.explode("shingles").alias("token"))
    held = tokens.groupBy("token").agg(F.count("*").alias("held")).where("held > 1")
    common = tokens.join(held, "token")
    within = Window.partitionBy("rep", "n").orderBy("held", "token")
    count = F.count("*").over(Window.partitionBy("rep", "n"))
    placed = materialise(
        common.withColumn("place", F.col("n") - count + F.row_number().over(within))
        .where(F.col("place") <= F.expr(f"n - ceil({percent} * n / 100) + 1"))
        .select("token", "rep", "comp", "n", "place")
    )
    small = placed.where(F.col("place") <= F.expr(f"n - ceil({2 * percent} * n / {100 + percent}) + 1")).select(
        "token", *(F.col(c).alias(f"{c}_a") for c in ("rep", "comp", "n", "place"))
    )
    large = placed.select("token", *(F.col(c).alias(f"{c}_b") for c in ("rep", "comp", "n", "place")))
    fits = (
        (F.col("comp_a") != F.col("comp_b"))
        & ((F.col("n_a") < F.col("n_b")) | ((F.col("n_a") == F.col("n_b")) & (F.col("rep_a") < F.col("rep_b"))))
        & (100 * F.col("n_a") >= percent * F.col("n_b"))
        & ((100 + percent) * (1 + F.least(F.col("n_a") - F.col("place_a"), F.col("n_b") - F.col("place_b"))) >= percent * (F.col("n_a") + F.col("n_b")))
    )
    joined = small.join(large, (small["token"] == large["token"]) & fits)
    return joined.select(F.col("rep_a").alias("a"), F.col("rep_b").alias("b")).distinct()


def near_groups(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of ``docs`` (columns doc_id and text; others are ignored).

    Null and empty texts have an empty set, are linked with nothing and are kept.  A text of fewer than five words
    is one shingle.  Rows with equal sets form one class before any pairing, so copies never meet as pairs.  Rows
    that repeat a doc_id count as one document; each gets its row.  A row without doc_id joins the group of its set
    and is itself never named; alone its component_id is null.  An empty table gives an empty table.
    """
    sketched = materialise(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_sketches, SKETCH))
    classes = materialise(
        sketched.where("n_shingles > 0").groupBy(*_KEY)
        .agg(F.min("doc_id").alias("rep"), F.first("first").alias("first"), F.first("second").alias("second")).where("rep is not null")
    )
    buckets = _buckets(classes.withColumnRenamed("n_shingles", "n"))
    peaks = buckets.groupBy("bucket").agg(
        F.count("*").alias("members"), F.min("rep").alias("least"), F.max("rep").alias("most"),
        F.max(F.struct("centre", (-F.col("rep")).alias("low"), "n")).alias("top"),
    )
    peaks = peaks.where("least < most").select("bucket", "members", (-F.col("top.low")).alias("peak"), F.col("top.n").alias("peak_n"))
    seats = materialise(buckets.join(peaks, "bucket").select("bucket", "members", "rep", "n", "peak", "peak_n"))

    wanted = seats.select(F.col("rep").alias("doc_id")).distinct()
    sets = materialise(
        docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
        .join(wanted, "doc_id", "left_semi").distinct().mapInArrow(_sets, "rep bigint, shingles array<bigint>")
    )
    near_size = 100 * F.least("n", "peak_n") >= percent * F.greatest("n", "peak_n")
    to_peak = seats.where((F.col("rep") != F.col("peak")) & near_size).select(F.col("rep").alias("a"), F.col("peak").alias("b"))
    to_peak = to_peak.repartition("a").distinct()
    links = materialise(_verified(to_peak, sets, percent))
    rooted = components(links)

    comp = F.coalesce("root", "rep")
    seated = seats.where("members > 2").select("bucket", "rep").join(rooted.withColumnRenamed("node", "rep"), "rep", "left").select("bucket", "rep", comp.alias("comp"))
    mixed = seated.groupBy("bucket").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low < high").select("bucket")
    unsettled = seated.join(mixed, "bucket").select("rep", "comp").distinct()
    more = _verified(_rest(materialise(sets.join(unsettled, "rep")), percent), sets, percent)
    rooted = components(rooted.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(more))

    named = classes.select(*_KEY, "rep").join(rooted.withColumnRenamed("node", "rep"), "rep", "left").select(*_KEY, comp.alias("component"))
    return (
        sketched.select("doc_id", *_KEY).join(named, _KEY, "left")
        .select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))
        .withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
    )


def without_repeats(docs: DataFrame) -> DataFrame:
    """One row for each doc_id; rows without an id all stay."""
    alone = F.when(F.col("doc_id").isNull(), F.monotonically_increasing_id())
    return docs.withColumn("_alone", alone).dropDuplicates(["doc_id", "_alone"]).drop("_alone")
