"""From raw conversation objects to chat rows, and the choice of chats to work on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foldwise.functions import jsonval as J
from foldwise.functions.epoch import to_epoch
from foldwise.functions.text import let
from foldwise.operators import messages as M

# Keys that mark a conversation as filed, in order of preference, and where to look.
FILING_KEYS = ("project_id", "workspace_id", "folder_id", "project", "workspace", "folder")
FILING_PLACES = ("metadata", "conversation")
UNTITLED = "(untitled)"


MEMBERS = "from_json({raw}, 'map<string,variant>')"


def looks_like_conversation(raw: str) -> str:
    """JSON object with a title and an id: as own keys, even null, or truthy in ``conversation``."""
    inner = "mb['conversation']"
    titled = f"array_contains(map_keys(mb), 'title') or {J.truthy(J.field(inner, 'title'))}"
    inner_id = J.truthy(J.field(inner, "id"))
    other_id = J.truthy("mb['conversation_id']")
    named = f"array_contains(map_keys(mb), 'id') or {other_id} or {inner_id}"
    return let(MEMBERS.format(raw=raw), "mb", f"coalesce(mb is not null and ({titled}) and ({named}), false)")


def filed_under(members: str) -> str:
    """First truthy filing value of a map<string,variant>, as text; null when the chat is not filed."""
    values = [f"{members}['{key}']" for key in FILING_KEYS]
    values += [J.field(f"{members}['{place}']", key) for place in FILING_PLACES for key in FILING_KEYS]
    return J.as_text(J.first_truthy(*values))


def normalize_chats(conversations: DataFrame) -> DataFrame:
    """Chat rows (pos, id, title, create_time, update_time, project_id, raw) from (pos, raw).

    Values are chosen by truthiness, so 0 and "" fall through; rows without any id are dropped.
    """

    def own(name: str) -> str:
        return f"m['{name}']"

    def inner(name: str) -> str:
        return J.field(own("conversation"), name)

    id_ = J.first_truthy(own("id"), own("conversation_id"), inner("id"), own("uuid"))
    title = J.first_truthy(own("title"), inner("title"))
    created = J.first_truthy(own("create_time"), own("created_at"), inner("create_time"))
    updated = J.first_truthy(own("update_time"), own("updated_at"), inner("update_time"))
    parsed = conversations.withColumn("m", F.expr(MEMBERS.format(raw="raw")))
    picked = parsed.select(
        "pos",
        F.expr(J.as_text(id_)).alias("id"),
        F.expr(f"coalesce({J.as_text(title)}, '{UNTITLED}')").alias("title"),
        F.expr(to_epoch(created)).alias("create_time"),
        F.expr(to_epoch(updated)).alias("update_time"),
        F.expr(filed_under("m")).alias("project_id"),
        "raw",
    )
    return picked.where(F.col("id").isNotNull())


def dedup_latest(chats: DataFrame) -> DataFrame:
    """One row per id: the first of those with the latest update time, at the place first seen.

    An aggregate, not a window: copies are combined before the shuffle, so an id that fills a third
    of the export still reaches its task as one row per input partition.
    """
    others = [c for c in chats.columns if c not in ("id", "pos")]
    freshness = F.struct(-F.coalesce(F.col("update_time"), F.lit(0.0)), F.col("pos"))
    return (
        chats.groupBy("id")
        .agg(F.min("pos").alias("pos"), F.min_by(F.struct(*others), freshness).alias("w"))
        .select("pos", "id", "w.*")
    )


def with_excerpt(chats: DataFrame, word_limit: int = M.DEFAULT_WORD_LIMIT) -> DataFrame:
    """Replace ``raw`` by ``prompt_excerpt``; computed within each row, without a shuffle."""
    source = M.conversation_messages("m['messages']", "m['mapping']", "t['mapping']")
    parsed = chats.withColumn("m", F.expr(MEMBERS.format(raw="raw"))).withColumn(
        "t", F.expr("from_json(raw, 'map<string,string>')")
    )
    ordered = M.with_message_array(parsed.withColumn("_source", F.expr(source)), "_source", "_messages")
    excerpt = M.excerpt_of_messages("_messages", word_limit)
    return ordered.withColumn("prompt_excerpt", F.expr(excerpt)).drop("raw", "m", "t", "_source", "_messages")


def is_filed(project_id: Column) -> Column:
    return F.coalesce(project_id != "", F.lit(False))


def split_filed(chats: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(filed, unfiled).  Must follow ``dedup_latest``: the latest version decides."""
    return chats.where(is_filed(F.col("project_id"))), chats.where(~is_filed(F.col("project_id")))


def head_limit(chats: DataFrame, limit: int) -> DataFrame:
    """First ``limit`` chats in export order; zero or less keeps all."""
    return chats.orderBy("pos").limit(limit) if limit > 0 else chats
