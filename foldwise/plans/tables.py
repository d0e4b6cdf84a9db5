"""Chats, messages and exports derived from the driver's tables.

``conversations`` gives the messages, ``events`` the times, ``embeddings`` the vectors and planted
clusters.  An export document holds at most 64 turns of one conversation, and an export file at most 64
parts of 64 conversations, so no key decides the size of a document.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foldwise.functions import text as T
from foldwise.session import configure, scratch_path

TURNS_PER_DOCUMENT = 64
CONVERSATIONS_PER_FILE = 64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    configure(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def event_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(pos, create_time) in epoch seconds."""
    seconds = F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(1_000_000.0)
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("pos"), seconds.alias("create_time"))


def chats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(pos, id, title, create_time, update_time, project_id); the title is five words of the first user turn."""
    turns = table(spark, sf_dir, "conversations")
    user_turn = F.when(F.col("role") == "user", F.col("turn"))
    heads = turns.groupBy(F.col("conv_id").alias("pos")).agg(F.min_by("text", user_turn).alias("text"))
    return heads.join(event_times(spark, sf_dir), "pos", "left").select(
        "pos",
        F.col("pos").cast("string").alias("id"),
        F.expr(f"coalesce(nullif({T.first_words('text', 5)}, ''), '(untitled)')").alias("title"),
        "create_time",
        F.lit(None).cast("double").alias("update_time"),
        F.expr("if(pos % 10 = 0, concat('ws-', pos), null)").alias("project_id"),
    )


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("pos"), F.col("embedding").alias("vector"), "label")


def planted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(pos, label, vector): the label's axis plus a small part of the embedding, so that labels are clusters."""
    mixed = F.expr("transform(vector, (x, i) -> cast(x as double) * 0.3D + if(i = label, 1.0D, 0.0D))")
    return vectors(spark, sf_dir).select("pos", "label", mixed.alias("vector"))


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(chat_id, ord, msg_id, ts, role, text)."""
    return table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("chat_id"),
        F.col("turn").alias("ord"),
        F.concat_ws("-", "conv_id", "turn").alias("msg_id"),
        F.col("turn").cast("double").alias("ts"),
        "role",
        "text",
    )


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(conv_id, turn, message): every turn as a message in JSON, with metadata that hides some of them."""
    times = event_times(spark, sf_dir).withColumnRenamed("pos", "conv_id")
    body = F.expr(
        "named_struct('id', concat_ws('-', conv_id, turn), 'author', named_struct('role', role),"
        " 'create_time', if(turn % 4 = 3, null, create_time + turn * 60),"
        " 'content', named_struct('content_type', 'text', 'parts', array(text)),"
        " 'metadata', named_struct('message_type', if((conv_id + turn) % 11 = 5, 'web_search_result', 'reply'),"
        " 'is_thinking', (conv_id + turn) % 13 = 7))"
    )
    return (
        table(spark, sf_dir, "conversations")
        .join(times, "conv_id", "left")
        .select("conv_id", "turn", F.to_json(body).alias("message"))
    )


def conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(conv_id, part, raw): conversation objects in the shapes exports use.

    Four ways to name the conversation, three kinds of update time, seconds and milliseconds, and two
    kinds of filing marks take turns by conv_id.
    """
    part = F.floor(F.col("turn") / TURNS_PER_DOCUMENT)
    listed = (
        messages(spark, sf_dir)
        .groupBy("conv_id", part.alias("part"))
        .agg(F.array_sort(F.collect_list(F.struct("turn", "message"))).alias("all"))
        .join(chats(spark, sf_dir).select(F.col("pos").alias("conv_id"), "title", "create_time"), "conv_id")
        .withColumn("name", F.expr("if(part = 0, cast(conv_id as string), concat_ws('-', conv_id, part))"))
    )

    def member(name: str, value: str) -> str:
        """A member of an object; null when its value is, so that ``concat_ws`` leaves no empty place between commas."""
        packed = f"to_json(named_struct('{name}', {value}))"
        return f"nullif(substring({packed}, 2, length({packed}) - 2), '')"

    inner = member("conversation", "named_struct('id', name, 'title', title)")
    named = (
        f"case conv_id % 4 when 0 then concat_ws(',', {member('id', 'name')}, {member('title', 'title')})"
        f" when 1 then concat_ws(',', {member('conversation_id', 'name')}, {member('title', 'title')})"
        f" when 2 then {inner}"
        f""" else concat_ws(',', '"id":null', {member('uuid', 'name')}, {member('title', 'title')}) end"""
    )
    created = (
        f"if(conv_id % 5 = 0, {member('create_time', 'cast(floor(create_time * 1000) as bigint)')},"
        f" {member('created_at', 'create_time')})"
    )
    updated = (
        f"case conv_id % 3 when 0 then {member('update_time', 'create_time + 3600')}"
        f""" when 1 then {member('updated_at', "date_format(timestamp_seconds(floor(create_time) + 7200), 'yyyy-MM-dd''T''HH:mm:ssX')")} end"""
    )
    ws = member("metadata", "named_struct('project_id', concat('ws-', conv_id))")
    folder = member("metadata", "named_struct('project', 0, 'folder', conv_id)")
    filed = f"""case conv_id % 10 when 0 then {ws} when 5 then concat('"folder_id":"",', {folder}) end"""
    some = """concat('"messages":[', array_join(transform(filter(all, x -> x.turn % 2 = 0), x -> x.message), ','), ']')"""
    nodes = """concat('"mapping":{', array_join(transform(all, x -> concat('"n', x.turn, '":{"message":', x.message, '}')), ','), '}')"""
    raw = f"concat('{{', concat_ws(',', {named}, {created}, {updated}, {filed}, {some}, {nodes}), '}}')"
    return listed.select("conv_id", "part", F.expr(raw).alias("raw"))


def write_documents(spark: SparkSession, sf_dir: str, layout: str = "list") -> str:
    """Write the export as JSON documents of bounded size; returns the folder.

    ``list``: a list per file; ``wrapped``: every third item inside another object; ``container``: an
    object with three lists, itself a conversation.
    """
    rows = conversations(spark, sf_dir).select(
        F.floor(F.col("conv_id") / CONVERSATIONS_PER_FILE).alias("export"),
        F.floor(F.col("part") / CONVERSATIONS_PER_FILE).alias("slice"),
        "conv_id", "part", "raw",
    )
    item = F.expr("""if(conv_id % 3 = 1, concat('{"n":1,"wrapper":', raw, '}'), raw)""") if layout == "wrapped" else F.col("raw")
    files = rows.groupBy("export", "slice").agg(F.array_sort(F.collect_list(F.struct("conv_id", "part", item.alias("raw")))).alias("items"))

    def joined(condition: str) -> str:
        return f"concat('[', array_join(transform(filter(items, x -> {condition}), x -> x.raw), ','), ']')"

    if layout == "container":
        lists = ",".join(
            f"""'"{key}":', {joined(f'x.conv_id % 3 = {n}')}, ','""" for n, key in enumerate(("conversations", "items", "data"))
        )
        value = f"""concat('{{', {lists}, '"id":"file-', export, '-', slice, '","title":"File ', export, '"}}')"""
    else:
        value = joined("true")
    path = scratch_path(spark, f"export-{layout}")
    files.select("export", "slice", F.expr(value).alias("value")).write.partitionBy("export", "slice").text(path)
    return path


def write_lines(spark: SparkSession, sf_dir: str, rows: DataFrame | None = None) -> str:
    """Write one conversation per line; returns the folder."""
    path = scratch_path(spark, "export-lines")
    (conversations(spark, sf_dir) if rows is None else rows).select(F.col("raw").alias("value")).write.text(path)
    return path
