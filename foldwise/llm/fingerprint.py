"""Bottom-k fingerprints of texts in Spark SQL expressions.

A fingerprint holds the ``SIZE`` least 64-bit hashes of a text's five-word shingles, in order.  Fingerprints of parts
merge into that of the whole.  Two of them estimate resemblance and containment of the shingle sets, one the number
of distinct shingles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foldwise.operators.ordering import with_row_index

SIZE = 128
WORDS = 5
#: Documents that one window of neighbours holds on average.
BLOCK_ROWS = 64


def with_fingerprint(df: DataFrame, text: str, name: str, size: int = SIZE) -> DataFrame:
    """Add ``name``, the fingerprint of the column ``text``; null and wordless texts have an empty one.

    Words are what white space separates, in lower case; fewer than five words are one shingle.
    """
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[\x09-\x0D ]+"), lambda w: w != "")
    hashed = df.withColumn("_hashes", F.transform(words, lambda w: F.xxhash64(w)))
    n = F.size("_hashes")
    run = F.transform(F.sequence(F.lit(0), n - WORDS), lambda i: F.xxhash64(*(F.get("_hashes", i + k) for k in range(WORDS))))
    all_ = F.when(n >= WORDS, run).when(n > 0, F.array(F.xxhash64("_hashes"))).otherwise(F.array().cast("array<bigint>"))
    return hashed.withColumn(name, F.slice(F.sort_array(F.array_distinct(all_)), 1, size)).drop("_hashes")


def resemblance(one: str | Column, two: str | Column, size: int = SIZE) -> Column:
    """Estimated Jaccard similarity; two empty fingerprints are alike, an empty and another one are not."""
    both = F.array_intersect(one, two)
    least = F.slice(F.sort_array(F.array_union(one, two)), 1, size)
    return F.when(F.size(least) == 0, 1.0).otherwise(F.size(F.array_intersect(least, both)) / F.size(least))


def distinct_shingles(one: str | Column, size: int = SIZE) -> Column:
    """Estimated number of distinct shingles: exact below ``size``, else from the place of the largest kept hash."""
    one = F.col(one) if isinstance(one, str) else one
    share = (F.element_at(one, -1).cast("double") + 2.0**63) / 2.0**64
    return F.when(F.size(one) < size, F.size(one).cast("double")).otherwise((size - 1) / share)


def containment(one: str | Column, two: str | Column, size: int = SIZE) -> Column:
    """Estimated share of the first text's shingles that the second holds."""
    near = resemblance(one, two, size)
    shared = near / (1 + near) * (distinct_shingles(one, size) + distinct_shingles(two, size))
    return F.when(F.size(one) == 0, 1.0).otherwise(F.least(F.lit(1.0), shared / distinct_shingles(one, size)))


def merge(parts: DataFrame, key: str, fingerprint: str, size: int = SIZE) -> DataFrame:
    """One fingerprint for each key from those of its parts.

    The least hashes are picked before and after the shuffle, so a key with very many parts sends few rows.
    """
    hashes = parts.select(key, F.explode(fingerprint).alias("_hash")).distinct()
    rank = F.row_number().over(Window.partitionBy(key).orderBy("_hash"))
    kept = hashes.withColumn("_rank", rank).where(F.col("_rank") <= size)
    lists = kept.groupBy(key).agg(F.sort_array(F.collect_list("_hash")).alias(fingerprint))
    filled = parts.select(key).distinct().join(lists, key, "left")
    return filled.select(key, F.coalesce(fingerprint, F.array().cast("array<bigint>")).alias(fingerprint))


def as_text(fingerprint: str | Column) -> Column:
    """Sixteen hexadecimal digits for each hash."""
    return F.array_join(F.transform(fingerprint, lambda h: F.lpad(F.lower(F.hex(h)), 16, "0")), "")


def with_next(docs: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """doc_id, text, fingerprint, next_text, next_fingerprint: each row with the next in order of doc_id, the last with the first.

    Rows are dealt by stretches of ids that hold ``block_rows`` rows on average, so texts are shuffled once.  The
    first row of each stretch also follows the last of the stretch before.  Equal ids are ordered by text; a null id comes first.
    """
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    key = F.coalesce(F.col("doc_id"), F.lit(-(1 << 63)))
    spread = rows.agg(F.count("*").alias("n"), F.percentile_approx(key, [0.01, 0.99]).alias("p")).first()
    width = max(1, int((spread.p[1] - spread.p[0] + 1) * block_rows / (0.98 * spread.n))) if spread.n else 1
    block = F.expr(f"floor(coalesce(doc_id, -9223372036854775808) / {width}D)").cast("bigint") if width > 1 else key
    dealt = rows.withColumn("block", block).repartition("block")
    order = Window.partitionBy("block").orderBy(key, "text")

    blocks = with_row_index(rows.select(block.alias("block")).distinct(), "block")
    following = blocks.select("block", (F.col("row_index") + 1).alias("at"))
    count = blocks.agg(F.count("*").alias("count"))
    following = following.crossJoin(count).select("block", F.when(F.col("at") == F.col("count"), 0).otherwise(F.col("at")).alias("row_index"))
    after = following.join(blocks.withColumnRenamed("block", "next_block"), "row_index").select("block", "next_block")

    inner = with_fingerprint(dealt, "text", "fingerprint")
    inner = inner.withColumn("next_text", F.lead("text").over(order)).withColumn("next_fingerprint", F.lead("fingerprint").over(order))
    heads = dealt.withColumn("place", F.row_number().over(order)).where("place = 1").select("block", "text")
    heads = with_fingerprint(heads, "text", "head_fingerprint").select(F.col("block").alias("next_block"), F.col("text").alias("head_text"), "head_fingerprint")
    first_of_next = after.join(heads, "next_block").select("block", "head_text", "head_fingerprint")
    whole = inner.join(first_of_next, "block", "left")
    return whole.select(
        "doc_id", "text", "fingerprint", F.coalesce("next_text", "head_text").alias("next_text"), F.coalesce("next_fingerprint", "head_fingerprint").alias("next_fingerprint")
    )


def compare_with_edit(docs: DataFrame, size: int = SIZE) -> DataFrame:
    """Fingerprints of every text and of its edit, and their likeness to each other and to the next document.

    The edit replaces the last floor(n_chars / 2) code points by as many from the start of the next document (or all
    it has).  Null texts count as empty; repeated rows are documents of their own; a lone document follows itself.
    """
    rows = with_next(docs)
    half = F.expr("cast(floor(n_chars / 2) as int)")
    rows = rows.withColumn("n_chars", F.length("text").cast("bigint"))
    edited = F.concat(F.expr("substr(text, 1, cast(n_chars - floor(n_chars / 2) as int))"), F.col("next_text").substr(F.lit(1), half))
    rows = with_fingerprint(rows.withColumn("edited", edited), "edited", "edited_print", size)
    return rows.select(
        "doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), as_text("fingerprint").alias("fingerprint"),
        as_text("edited_print").alias("edited_fingerprint"), resemblance("fingerprint", "edited_print", size).alias("near_edited"),
        resemblance("fingerprint", "next_fingerprint", size).alias("near_next"), distinct_shingles("fingerprint", size).alias("n_shingles"),
    )
