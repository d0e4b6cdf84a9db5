"""Held-out rows and bounded samples for fitting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def held_out(doc_id: str | Column = "doc_id") -> Column:
    """Rows never learnt from: crc32 of the id as text is divisible by 5.  A null id is not held out."""
    doc_id = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def bounded_sample(rows: DataFrame, key: str, most: int) -> DataFrame:
    """At most about ``most`` rows (1.2 times at the outside), chosen by the hash of the key; all rows when there are fewer."""
    total = rows.count()
    if total <= most:
        return rows
    share = int(most / total * (1 << 30))
    return rows.where(F.pmod(F.xxhash64(F.lit(7), key), F.lit(1 << 30)) < share)


def sample_of_each(rows: DataFrame, group: str, key: tuple[str, ...], most: int, least: int) -> DataFrame:
    """An equal share of about ``most`` rows from each group, about ``least`` rows at least and one for certain; all rows when there are fewer.

    Rows are chosen by the hash of the key; the groups' counts and smallest hashes are worked out over all rows.
    """
    place = F.pmod(F.xxhash64(F.lit(7), *key), F.lit(1 << 62))
    groups = rows.groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("first")).collect()
    if sum(g.n for g in groups) <= most:
        return rows
    share = max(least, most // len(groups))
    limits = [(g[group], max(int(min(share / g.n, 1) * (1 << 62)), g.first + 1)) for g in groups]
    limits = rows.sparkSession.createDataFrame(limits, f"{group} string, limit bigint")
    return rows.join(F.broadcast(limits), group).where(place < F.col("limit")).select(*rows.columns)
