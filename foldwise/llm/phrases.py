"""Collocations: frequent phrases of up to four words, by dynamic itemset counting.

The corpus is dealt into ``SHARDS`` shards that are scanned in a cycle.  Words are counted from the first scan on.  As
soon as both phrases that a longer phrase consists of (all but its last word, all but its first) have reached the
threshold, the longer one becomes active, in the middle of a cycle if need be, and stays so until it has been counted
in every shard.  The scans end when a whole cycle has passed since the last phrase reached the threshold.

What is active is decided inside the scan by two bit fields of fixed size over phrase hashes: phrases that have
reached the threshold, and those that had a whole cycle before.  A phrase is counted if both its parts are in the first
field and not both in the second, hence in exactly as many scans as there are shards, beginning with the first
that finds its parts in the field.  The fields miss nothing; what they let through by chance is counted earlier than
need be, but over a whole cycle too.  So each count is complete one cycle after the phrase was first met; rare phrases leave the table of
counts then.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foldwise.llm import bytetext as B
from foldwise.llm.flatfiles import remove_folder
from foldwise.session import materialise, scratch_path

LONGEST = 4
LEAST = 30
SHARDS = 2
#: A phrase is dropped if a longer one has at least so many hundredths of its occurrences.
SHARE = 80
MOST = 2000
#: Bits of each field, a power of two.
BITS = 1 << 25
#: Words handled at a time, and bytes of texts.
CHUNK_WORDS = 1 << 18
SLICE_BYTES = 1 << 22
_BREAKS = np.isin(np.arange(256), [*b".,;:!?", *range(0x0A, 0x0E)])
_PLAIN = np.arange(256, dtype=np.uint8)
_PLAIN[65:91] += 32
_PLAIN[0x09] = 0x20
_PLAIN[_BREAKS] = 0x0A
_COUNTS = "lang string, phrase string, k int, c bigint"


def _clean(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower case, pieces ended by line feeds, words by single spaces."""
    data = _PLAIN[data]
    blank = data == 0x20
    keep = np.ones(len(data), bool)
    keep[1:] = ~(blank[1:] & blank[:-1])
    starts = offsets[:-1]
    keep[starts[starts < len(data)]] = True
    total = np.concatenate([[0], np.cumsum(keep)])
    return data[keep], total[offsets]


def _extend(shorter: np.ndarray, last: np.ndarray, k: int) -> np.ndarray:
    """Hashes of phrases of k words from those of their first k - 1 words and of their last one."""
    return B.mix(shorter * np.uint64(0x9E3779B97F4A7C15) + last, k)


def _probes(hashes: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    mask = np.uint64(bits - 1)
    return hashes & mask, (hashes >> np.uint64(32)) & mask


def _within(field: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Whether both bits of each hash are set; ``field`` holds bytes of eight bits, lowest first."""
    found = np.ones(len(hashes), bool)
    for at in _probes(hashes, 8 * len(field)):
        found &= (field[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1
    return found


def _salts(langs: list[str]) -> np.ndarray:
    """A hash of each language."""
    return np.array([B.mix(np.array([int.from_bytes(x.encode("utf-8", "surrogatepass"), "little") % ((1 << 64) - 59)], np.uint64), 77)[0] for x in langs], np.uint64)


def _strings(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The byte ranges as strings."""
    sizes = ends - starts
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    at = np.arange(offsets[-1]) + np.repeat(starts - offsets[:-1], sizes)
    return pa.StringArray.from_buffers(len(starts), pa.py_buffer(offsets.astype(np.int32).tobytes()), pa.py_buffer(data[at].tobytes()))


class _Words:
    """The words of some texts: hash with language, place, and the piece each lies in."""

    def __init__(self, langs: pa.Array, texts: pa.Array):
        self.data, offsets = _clean(*B.flat(texts))
        hashes, self.starts, bounds = B.words(self.data, offsets)
        self.text = np.repeat(np.arange(len(texts)), np.diff(bounds))
        coded = langs.dictionary_encode()
        self.langs, self.lang = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False)[self.text]
        self.hashes = B.mix(hashes ^ _salts(self.langs.to_pylist())[self.lang]) if len(hashes) else hashes
        separators = np.flatnonzero((self.data == 0x20) | (self.data == 0x0A))
        following = np.concatenate([separators, [len(self.data)]])[np.searchsorted(separators, self.starts)]
        self.ends = np.minimum(following, offsets[1:][self.text])
        self.piece = np.searchsorted(np.flatnonzero(self.data == 0x0A), self.starts) + self.text

    def counted(self, choose: Callable, longest: int) -> Iterator[pa.RecordBatch]:
        """Counts of the chosen phrases, chunk by chunk.  ``choose(k, shorter)`` says which phrases of k words count."""
        for a in range(0, len(self.hashes), CHUNK_WORDS):
            word, piece = self.hashes[a : a + CHUNK_WORDS + longest - 1], self.piece[a : a + CHUNK_WORDS + longest - 1]
            shorter = phrase = word
            for k in range(1, longest + 1):
                n = max(0, len(word) - k + 1)
                phrase = word if k == 1 else _extend(shorter[:n], word[k - 1 :], k)
                here = min(n, CHUNK_WORDS)  # phrases that begin in this chunk
                chosen = choose(k, shorter)
                if chosen is not None:
                    chosen = np.flatnonzero(chosen[:here] & (piece[:here] == piece[k - 1 : k - 1 + here]))
                    _, first, counts = np.unique(phrase[chosen], return_index=True, return_counts=True)
                    if len(first):
                        at = chosen[first] + a
                        yield pa.RecordBatch.from_arrays(
                            [self.langs.take(pa.array(self.lang[at])), _strings(self.data, self.starts[at], self.ends[at + k - 1]), pa.array(np.full(len(at), k, np.int32)), pa.array(counts.astype(np.int64))],
                            names=["lang", "phrase", "k", "c"],
                        )
                shorter = phrase


def _scan(words: bool, fields, longest: int) -> Callable:
    """Count the active phrases of a shard; ``fields`` is a broadcast pair of bit fields, or None."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reached, before = (np.frombuffer(x, np.uint8) for x in fields.value) if fields is not None else (None, None)

        def choose(k: int, shorter: np.ndarray) -> np.ndarray | None:
            if k == 1:
                return np.ones(len(shorter), bool) if words else None
            if reached is None:
                return None
            old = _within(reached, shorter)
            chosen = old[:-1] & old[1:]
            at = np.flatnonzero(chosen)
            chosen[at] = ~(_within(before, shorter[at]) & _within(before, shorter[at + 1]))
            return chosen

        for batch in batches:
            for a, b in B.row_slices(batch["text"], SLICE_BYTES):
                part = batch.slice(a, b - a)
                yield from _Words(part["lang"], part["text"]).counted(choose, longest)

    return run


def _places(bits: int) -> Callable:
    """The bits of phrases, numbered from 1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = batch["lang"].dictionary_encode()
            salts = _salts(langs.dictionary.to_pylist())[langs.indices.to_numpy(zero_copy_only=False)] if batch.num_rows else np.zeros(0, np.uint64)
            hashes, _, bounds = B.words(*B.flat(batch["phrase"]))
            sizes = np.diff(bounds)
            hashes = B.mix(hashes ^ np.repeat(salts, sizes))
            out = hashes[bounds[:-1]]
            for k in range(2, int(sizes.max(initial=1)) + 1):
                long = np.flatnonzero(sizes >= k)
                out[long] = _extend(out[long], hashes[bounds[:-1][long] + k - 1], k)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(_probes(out, bits)).astype(np.int64) + 1)], names=["place"])

    return run


def _field(phrases: DataFrame, bits: int) -> np.ndarray | None:
    """The bit field of some phrases (lang, phrase), of bits / 8 bytes however many they are; None if there are none."""
    places = phrases.select("lang", "phrase").mapInArrow(_places(bits), "place bigint")
    packed = places.groupBy(F.bitmap_bucket_number("place").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("place")).alias("bits")).collect()
    if not packed:
        return None
    field = np.zeros(max(bits // 8, 4096), np.uint8)
    for row in packed:
        field[(row.bucket - 1) * 4096 : row.bucket * 4096] = np.frombuffer(row.bits, np.uint8)
    return field[: bits // 8]


def count_phrases(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, shards: int = SHARDS, bits: int = BITS) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, k, f) of all phrases that occur ``least`` times, and (lang, n) with the number of words."""
    spark = docs.sparkSession
    folder = scratch_path(spark, "phrases")
    rows = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("string").alias("text"))
    rows.where("text <> ''").withColumn("shard", (F.monotonically_increasing_id() % shards).cast("int")).write.partitionBy("shard").parquet(f"{folder}/shards")
    corpus = spark.read.schema("lang string, text string, shard int").parquet(f"{folder}/shards")
    state = spark.createDataFrame([], "lang string, phrase string, k int, total bigint, since int, reached int")
    reached = [np.zeros(bits // 8, np.uint8)]  # the field before each scan
    words, step, last, path = None, 0, 0, None
    while step < shards or step <= last + shards:
        active = spark.sparkContext.broadcast((reached[step].tobytes(), reached[max(0, step - shards)].tobytes())) if reached[step].any() else None
        found = corpus.where(F.col("shard") == step % shards).select("lang", "text").mapInArrow(_scan(step < shards, active, longest), _COUNTS)
        old_path, path = path, f"{folder}/counts-{step}"
        _added(state.where((F.col("since") > step - shards) | F.col("reached").isNotNull()), found, step, least).write.parquet(path)
        state = spark.read.schema(state.schema).parquet(path)
        if old_path:
            remove_folder(spark, old_path)
        fresh = _field(state.where((F.col("reached") == step) & (F.col("k") < longest)), bits)
        reached.append(reached[step] if fresh is None else reached[step] | fresh)
        if fresh is not None:
            last = step
        if step == shards - 1:
            words = materialise(state.where("k = 1").groupBy("lang").agg(F.sum("total").alias("n")))
        step += 1
    remove_folder(spark, f"{folder}/shards")
    return state.where("reached IS NOT NULL").select("lang", "phrase", "k", F.col("total").alias("f")), words


def _added(state: DataFrame, found: DataFrame, step: int, least: int) -> DataFrame:
    """The table of counts with those of one scan: total, the scan that met a phrase first, the scan that brought it to the threshold."""
    new = found.select("lang", "phrase", "k", F.col("c").alias("total"), F.lit(step).alias("since"), F.lit(None).cast("int").alias("reached"))
    both = state.unionByName(new).groupBy("lang", "phrase", "k").agg(F.sum("total").alias("total"), F.min("since").alias("since"), F.min("reached").alias("reached"))
    return both.withColumn("reached", F.coalesce("reached", F.when(F.col("total") >= least, F.lit(step))))


def _joined(words: Column, start: Column | int, size: Column | int) -> Column:
    return F.array_join(F.slice(words, start, size), " ")


def collocations(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, share: int = SHARE, most: int = MOST, shards: int = SHARDS, bits: int = BITS) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the ``most`` best phrases of each language in ``docs`` (lang, text; others are ignored).

    Texts are lower-cased (A-Z), cut into pieces at ``.,;:!?`` and line ends, and pieces into words at spaces and tabs.
    ``a``, ``l`` and ``r`` count the phrase and the two parts of its weakest cut.  Null languages are ``und``; null and
    empty texts have no words; repeated rows count each; equal scores are ordered by ``a`` descending and then the phrase's bytes.
    Languages without a frequent phrase have no rows, nor has an empty table.  Phrases of one chunk are told apart by
    64-bit hashes, those of different chunks by their text.
    """
    counts, words = count_phrases(docs, least, longest, shards, bits)
    counts = materialise(counts)
    part = F.split("phrase", " ", -1)
    long = counts.where("k > 1").select("lang", "phrase", "k", F.col("f").alias("a"), part.alias("w"))
    cuts = long.select("lang", "phrase", "a", "k", "w", F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("cut"))
    cuts = cuts.select("lang", "phrase", "a", "k", "cut", _joined(F.col("w"), F.lit(1), F.col("cut")).alias("left"), _joined(F.col("w"), F.col("cut") + 1, F.col("k") - F.col("cut")).alias("right"))
    cuts = cuts.join(counts.select("lang", F.col("phrase").alias("left"), F.col("f").alias("l")), ["lang", "left"])
    cuts = cuts.join(counts.select("lang", F.col("phrase").alias("right"), F.col("f").alias("r")), ["lang", "right"])
    cuts = cuts.withColumn("score", F.expr("(CAST(2000000 AS DECIMAL(7,0)) * CAST(a AS DECIMAL(19,0))) DIV (CAST(l AS DECIMAL(19,0)) + CAST(r AS DECIMAL(19,0)))"))
    scored = cuts.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "cut", "l", "r")).alias("weakest"))
    spans = [(start, size) for size in range(2, longest) for start in range(1, longest)]
    inside = F.filter(F.array(*[F.when(F.col("k") > size, F.when(F.col("k") - size + 1 >= start, _joined(F.col("w"), start, size))) for start, size in spans]) if spans else F.array().cast("array<string>"), lambda x: x.isNotNull())
    longer = long.select("lang", F.explode(inside).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    left = scored.join(longer, ["lang", "phrase"], "left").where(
        F.coalesce(F.expr(f"CAST(100 AS DECIMAL(3,0)) * CAST(longer AS DECIMAL(19,0)) < CAST({share} AS DECIMAL(3,0)) * CAST(a AS DECIMAL(19,0))"), F.lit(True))
    )
    left = left.select("lang", "phrase", "a", "weakest.*")
    best = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = left.withColumn("rank", F.row_number().over(best).cast("bigint")).where(F.col("rank") <= most)
    return ranked.join(words, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", F.col("score").cast("bigint").alias("score"))
