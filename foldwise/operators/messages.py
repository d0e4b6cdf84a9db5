"""From messages to a word-limited transcript excerpt.

Two layouts are served by the same rules.  In an export every conversation is one JSON value, so
the whole excerpt is computed inside its row and nothing is shuffled.  In a table of turns one
conversation may hold a large share of all rows, so turns are deduplicated by (conversation,
message) and cut to the few that can fit the budget before they meet.

Expressions are Spark SQL text, as in ``foldwise.functions``.
"""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from foldwise.functions import jsonval as J
from foldwise.functions import text as T
from foldwise.functions.epoch import to_epoch

DEFAULT_WORD_LIMIT = 250

# Metadata fields searched for excluded keywords, flags that drop a message, role labels.
METADATA_TEXTS = ("message_type", "source", "message_source", "description")
METADATA_FLAGS = ("is_thinking", "is_thought", "is_system_message")
ROLE_LABELS = {"user": "User: ", "assistant": "Assistant: "}


def clean_word_limit(limit: Any) -> int:
    """Whole number of words; negative means no limit (0), anything unreadable the default."""
    try:
        return max(0, int(limit))
    except (TypeError, ValueError):
        return DEFAULT_WORD_LIMIT


# -- content ------------------------------------------------------------------------------------


def text_fragments(content: str) -> str:
    """Stripped, non-empty text pieces of a content payload of any depth, in reading order, as array<string>.

    A list starts with the payload.  Each round replaces every container in it by its members, until only
    strings are left; the brackets of the payload's JSON text bound the rounds.
    """
    kind = J.first_truthy(J.field("x", "content_type"), J.field("x", "type"))
    shown = f"({J.is_object('x')} and not {T.has_excluded_keyword(J.as_text(kind))})"
    own = ", ".join([J.first_truthy(J.field("x", "text"), J.field("x", "value")), J.field("x", "data.code"), J.field("x", "data.text")])
    members = (
        f"case when {J.is_string('x')} then array(x) when {J.is_array('x')} then {J.array_items('x')} "
        f"when {shown} then concat({J.array_items(J.field('x', 'parts'))}, filter(array({own}), lf -> {J.is_string('lf')})) "
        f"else {J.NO_ITEMS} end"
    )
    opened = f"named_struct('items', it, 'open', exists(it, y -> not {J.is_string('y')}))"
    step = f"if(st.open, {T.let(f'flatten(transform(st.items, x -> {members}))', 'it', opened)}, st)"
    brackets = "coalesce(length(to_json(c)) - length(translate(to_json(c), '[{', '')), 0)"
    start = "named_struct('items', array(c), 'open', true)"
    leaves = f"transform(st.items, leaf -> {T.strip(J.string_or_null('leaf'))})"
    walked = f"aggregate(sequence(0, {brackets}), {start}, (st, rd) -> {step}, st -> {leaves})"
    return f"filter({T.let(content, 'c', walked)}, s -> s is not null and s != '')"


def labelled_text(role: str, fragments: str) -> str:
    """``User: …`` or ``Assistant: …``; null for other roles and blank text."""
    label = " ".join(f"when {role} = '{name}' then '{label}'" for name, label in ROLE_LABELS.items())
    return T.let(
        T.strip(f"array_join({fragments}, ' ')"), "body", f"if(body != '', concat(case {label} end, body), null)"
    )


def role_allowed(role: str) -> str:
    return f"coalesce({role} in {tuple(ROLE_LABELS)}, false)"


def metadata_allowed(metadata: str, message_type: str) -> str:
    """False when a flag is boolean true or a keyword occurs in a metadata text or the message type."""
    flags = ", ".join(J.field("md", name) for name in METADATA_FLAGS)
    texts = ", ".join([J.field("md", name) for name in METADATA_TEXTS] + [message_type])
    return T.let(
        metadata,
        "md",
        f"not (exists(array({flags}), fl -> {J.is_true('fl')}) or "
        f"exists(array({texts}), tx -> {T.has_excluded_keyword(J.string_or_null('tx'))}))",
    )


def message_role(message: str) -> str:
    return J.string_or_null(J.field(message, "author.role"))


def message_block(message: str) -> str:
    """Transcript block of one message held as VARIANT, or null when it is left out."""
    allowed = metadata_allowed(J.field(message, "metadata"), J.field(message, "message_type"))
    block = labelled_text("role", text_fragments(J.field(message, "content")))
    return T.let(message_role(message), "role", f"case when {role_allowed('role')} and {allowed} then {block} end")


# -- one conversation per row -------------------------------------------------------------------


def conversation_messages(messages: str, mapping: str, mapping_json: str) -> str:
    """Messages of a conversation in encounter order: the list first, then the mapping's nodes.

    ``mapping_json`` is the raw text of ``mapping``, because a VARIANT sorts its keys.
    """
    nodes = f"case when {J.is_object(mapping)} then map_values(from_json({mapping_json}, 'map<string,variant>')) end"
    from_nodes = f"coalesce(transform({nodes}, nd -> {J.field('nd', 'message')}), {J.NO_ITEMS})"
    return f"filter(concat({J.array_items(messages)}, {from_nodes}), mg -> {J.is_object('mg')})"


def _ascending(key: str, otherwise: str) -> str:
    """Comparator step over one key of structs a and b, nulls last."""
    a, b = f"a.{key}", f"b.{key}"
    return (
        f"case when {a} is null and {b} is null then {otherwise} when {a} is null then 1 when {b} is null then -1 "
        f"when {a} < {b} then -1 when {a} > {b} then 1 else {otherwise} end"
    )


def with_message_array(df: DataFrame, source: str, out: str = "messages") -> DataFrame:
    """Add the deduplicated, chronologically ordered messages as array<struct<id, ord, ts, message>>.

    A repeated string id keeps its first copy.  Copies are found by sorting on (id, ord), so a very
    long conversation costs n log n.
    """
    entry = (
        f"named_struct('id', {J.string_or_null(J.field('m', 'id'))}, 'ord', i, "
        f"'ts', {to_epoch(J.field('m', 'create_time'))}, 'message', m)"
    )
    by_id = f"(a, b) -> {_ascending('id', _ascending('ord', '0'))}"
    by_time = f"(a, b) -> {_ascending('ts', _ascending('ord', '0'))}"
    # The id of the message before, so that a copy is recognised without looking back into the array.
    shifted = "concat(array(cast(null as string)), transform(_by_id, m -> m.id))"
    first = (
        f"filter(zip_with(_by_id, slice({shifted}, 1, size(_by_id)), (m, before) -> "
        "case when m.id is null or not m.id <=> before then m end), m -> m is not null)"
    )
    return (
        df.withColumn("_by_id", F.expr(f"array_sort(transform({source}, (m, i) -> {entry}), {by_id})"))
        .withColumn(out, F.expr(f"array_sort({first}, {by_time})"))
        .drop("_by_id")
    )


def take_words(blocks: str, limit: int) -> str:
    """Join blocks with blank lines up to ``limit`` words; null when nothing remains.

    A block that fits is kept as it is; the one that crosses the limit is cut to the words left and
    re-joined with single spaces.  0 keeps everything.
    """
    if limit == 0:
        return f"nullif(array_join({blocks}, '\\n\\n'), '')"
    piece = "if(size(tk) <= st.room, bl, array_join(slice(tk, 1, st.room), ' '))"
    grown = (
        f"named_struct('txt', if(st.txt = '', {piece}, concat(st.txt, '\\n\\n', {piece})), "
        "'room', greatest(st.room - size(tk), 0))"
    )
    step = f"if(st.room = 0, st, {T.let(T.words('bl'), 'tk', f'if(size(tk) = 0, st, {grown})')})"
    start = f"named_struct('txt', '', 'room', {limit})"
    return f"aggregate({blocks}, {start}, (st, bl) -> {step}, st -> nullif(st.txt, ''))"


def excerpt_of_messages(messages: str, limit: int) -> str:
    """Excerpt from the array made by ``with_message_array``."""
    blocks = f"filter(transform({messages}, m -> {message_block('m.message')}), b -> b is not null)"
    return take_words(blocks, limit)


# -- one message per row ------------------------------------------------------------------------


def first_message_copies(df: DataFrame, chat: str = "chat_id", msg_id: str = "msg_id", order: str = "ord") -> DataFrame:
    """Keep the first copy of every (chat, message id); messages without an id are all kept.

    The grouping key contains the message id and the aggregate combines before the shuffle, so
    neither a huge conversation nor a heavily repeated message lands in one task.
    """
    others = [c for c in df.columns if c not in (chat, msg_id)]
    first = (
        df.where(F.col(msg_id).isNotNull())
        .groupBy(chat, msg_id)
        .agg(F.min_by(F.struct(*others), F.col(order)).alias("m"))
        .select(chat, msg_id, "m.*")
    )
    return first.unionByName(df.where(F.col(msg_id).isNull()))


def chronological(chat: str = "chat_id", ts: str = "ts", order: str = "ord") -> WindowSpec:
    return Window.partitionBy(chat).orderBy(F.col(ts).asc_nulls_last(), F.col(order))


def excerpts_of_turns(
    df: DataFrame, limit: int = DEFAULT_WORD_LIMIT, chat: str = "chat_id", ts: str = "ts", order: str = "ord"
) -> DataFrame:
    """(chat, prompt_excerpt) from rows (chat, ts, ord, block), with ``block`` null for left-out messages.

    Each block has at least two words, so no more than limit/2 + 1 of them can matter; the rank filter
    is applied before the shuffle as well.  A block longer than the limit can only be the one that is
    cut, so its first ``limit`` words and one more are enough.
    """
    blocks = df.where(F.col("block").isNotNull())
    if limit > 0:
        cut = f"if(size(tk) <= {limit}, block, array_join(slice(tk, 1, {limit + 1}), ' '))"
        blocks = (
            blocks.select(chat, ts, order, F.expr(T.let(T.words("block"), "tk", cut)).alias("block"))
            .withColumn("_rank", F.row_number().over(chronological(chat, ts, order)))
            .where(F.col("_rank") <= limit // 2 + 1)
        )
    late = F.col(ts).isNull()
    listed = blocks.groupBy(chat).agg(
        F.array_sort(F.collect_list(F.struct(late.alias("late"), F.col(ts), F.col(order), F.col("block")))).alias("b")
    )
    return listed.select(chat, F.expr(take_words("transform(b, x -> x.block)", limit)).alias("prompt_excerpt"))
