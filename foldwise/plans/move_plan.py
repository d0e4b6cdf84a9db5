"""The whole job: from an export to a plan of moves and of everything left out."""

from __future__ import annotations

import os
from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foldwise.functions import text as T
from foldwise.operators import batching, clustering, cohesion, embedding, labels, messages, normalize
from foldwise.operators.ordering import with_row_index
from foldwise.session import configure, materialise, scratch_path
from foldwise.sources import export, store
from foldwise.sources.group_log import GroupLog


@dataclass
class PlanParameters:
    eps_cosine: float = 0.25
    min_samples: int = 2
    min_cluster_size: int = 2
    confidence_threshold: float = 0.60
    time_weight: float = 0.25
    time_decay_days: float = 30.0
    limit: int = 0
    embedding_batch_words: int = 512
    embedding_batch_parallelism: int = 1
    conversation_word_limit: Any = 250

    def __post_init__(self) -> None:
        self.time_weight = min(1.0, max(0.0, float(self.time_weight)))
        self.min_samples = max(1, int(self.min_samples))
        self.min_cluster_size = max(2, int(self.min_cluster_size))
        self.embedding_batch_words = max(1, int(self.embedding_batch_words))
        self.embedding_batch_parallelism = max(1, int(self.embedding_batch_parallelism))
        self.conversation_word_limit = messages.clean_word_limit(self.conversation_word_limit)

    def shown(self) -> dict[str, Any]:
        """The values written to the plan document, in its order."""
        names = (
            "eps_cosine", "min_samples", "min_cluster_size", "confidence_threshold", "time_weight",
            "time_decay_days", "embedding_batch_words", "embedding_batch_parallelism", "conversation_word_limit",
        )
        return {name: getattr(self, name) for name in names}


@dataclass
class MovePlan:
    """The plan as tables with one row per item, which stay usable at any cluster size.

    ``clusters``: cluster_id, place (order in the plan), n, label, project_folder_slug, project_title,
    confidence and cohesion columns.  ``members``: cluster_id, member_ix, id, title, create_time,
    update_time.  ``moves`` and ``low_confidence``: cluster_id, place.  ``singletons`` and ``filed``: pos, id.
    """

    clusters: DataFrame
    members: DataFrame
    moves: DataFrame
    low_confidence: DataFrame
    singletons: DataFrame
    filed: DataFrame
    parameters: PlanParameters
    source: str = ""
    collection: str = "chats"


def chats_of_export(spark: SparkSession, path: str, layout: str = export.AUTO) -> DataFrame:
    """Deduplicated chats (pos, id, title, create_time, update_time, project_id, raw)."""
    return normalize.dedup_latest(normalize.normalize_chats(export.read_export(spark, path, layout)))


def embed_missing(
    spark: SparkSession, chats: DataFrame, parameters: PlanParameters,
    make_embedder: Callable[[], embedding.Embedder], store_path: str | None = None,
) -> DataFrame:
    """(id, vector) for every chat: stored vectors first, the model for the rest, results stored.

    A store that cannot be read counts as empty, one that cannot be written is given up; both warn.
    """
    cached = None
    if store_path:
        try:
            cached = materialise(store.lookup(spark, store_path, chats))
        except Exception as error:
            if not store.is_store_error(error):
                raise
            print(f"embedding store unreadable, treated as empty: {error}")
    todo = store.misses(chats, cached) if cached is not None else chats
    texts = materialise(todo.withColumn("text", F.expr(T.embedding_text("title", "prompt_excerpt"))))
    if texts.isEmpty():
        return cached

    made = embed_in_groups(texts, parameters, make_embedder, store_path, may_fail=True).select("id", "vector")
    return made if cached is None else cached.unionByName(made)


#: Text that one task requests, in groups one after another, before the next task goes on.
RUN_BYTES = 64 << 20


def embed_in_groups(
    texts: DataFrame, parameters: PlanParameters, make_embedder: Callable[[], embedding.Embedder],
    store_path: str | None = None, may_fail: bool = False, run_bytes: int = RUN_BYTES,
) -> DataFrame:
    """(id, vector, group_id) of rows (pos, id, text), requested group after group of consecutive batches.

    A group has ``embedding_batch_parallelism`` batches, which are in flight together.  A group is in the store, or in a scratch folder
    if there is none, before the next one is requested, so that a job that stops has lost one group at most.  Texts are dealt once
    into runs of consecutive groups, of about ``run_bytes``, each a sorted file; a job of one task reads and goes through a run, and
    the jobs follow each other.  Where tasks can't write to the file system, a run is one group, which Spark stores.  With ``may_fail`` a store that
    cannot be written is given up with a warning.
    """
    spark = texts.sparkSession
    requests, vectors = scratch_path(spark, "requests"), scratch_path(spark, "vectors")
    log = None

    def in_store(step: Callable[[], GroupLog | None]) -> GroupLog | None:
        """The step's result; of a store that is given up, that of a scratch folder."""
        nonlocal store_path
        try:
            return step()
        except Exception as error:
            if not (may_fail and store.is_store_error(error)):
                raise
            print(f"embedding store not written, going on without it: {error}")
            store_path = None
            return store.scratch_log(spark, scratch_path(spark, "groups"))

    if store_path:
        log = in_store(lambda: store.group_log(spark, store_path, may_fail))
    else:
        log = store.scratch_log(spark, scratch_path(spark, "groups"))
    batches = batching.word_batches(texts, parameters.embedding_batch_words, order=("pos",), keep=("id",)).select("id", "batch_id")
    grouped = materialise(batching.batch_groups(batches, parameters.embedding_batch_parallelism))
    count = grouped.agg(F.coalesce(F.max("group_id") + 1, F.lit(0)).alias("n")).first().n
    size = texts.agg(F.sum(F.octet_length("text")).alias("n")).first().n or 0
    per_run = max(1, count * run_bytes // max(1, size)) if log else 1
    kept = [c for c in store.payload(texts) if store_path] or [F.col("id")]
    dealt = texts.select(*kept, "text").join(grouped, "id").withColumn("run", F.floor(F.col("group_id") / per_run))
    files = max(1, -(-size // run_bytes))  # a number, else adaptive execution would put many runs into a task
    dealt.repartition(files, "run").sortWithinPartitions("run", "batch_id").write.partitionBy("run").parquet(requests)
    dealt = spark.read.schema(dealt.schema).parquet(requests)
    schema = "id string, vector array<float>, group_id bigint, problem string"
    for run in range(-(-count // per_run)):
        rows = dealt.where(F.col("run") == run).drop("run")
        embedding.embed_group_after_group(rows, make_embedder, parameters.embedding_batch_parallelism, log).write.parquet(f"{vectors}/run={run}")
        made = spark.read.schema(schema).parquet(f"{vectors}/run={run}")
        if store_path and log is None:
            upserted = rows.join(made.select("id", "vector"), "id")
            log = in_store(lambda: store.upsert(spark, store_path, upserted))
        elif store_path:
            log = in_store(lambda: store.after_run(log, made))
    if not count:
        return spark.createDataFrame([], "id string, vector array<float>, group_id bigint")
    return spark.read.schema(schema).parquet(vectors).select("id", "vector", "group_id")


def assemble(
    chats: DataFrame, assigned: DataFrame, vectors: DataFrame, filed: DataFrame, parameters: PlanParameters,
    make_labeller: Callable[[], labels.Labeller] | None = None, source: str = "", collection: str = "chats",
) -> MovePlan:
    """Plan tables from chats (pos, id, …), their (pos, cluster_id) and their (pos, vector).

    A chat without a cluster or without a vector is listed among the singletons.
    """
    placed = materialise(
        chats.select("pos", "id", "title", "create_time", "update_time")
        .join(assigned, "pos", "left").join(vectors, "pos", "left")
        .withColumn("cluster_id", F.when(F.col("vector").isNotNull(), F.col("cluster_id")))
        .fillna({"cluster_id": -1})
    )
    clustered = placed.where(F.col("cluster_id") >= 0)
    numbered = materialise(clustering.member_index(clustered.drop("vector")))
    first = numbered.groupBy("cluster_id").agg(F.min("pos").alias("first"), F.count("*").alias("n"))
    places = with_row_index(first, "first", "cluster_id", index="place").select("cluster_id", "place", "n")
    text = cohesion.text_cohesion(clustered)
    time = cohesion.temporal_cohesion(numbered, parameters.time_decay_days)
    named = labels.label_clusters(numbered, make_labeller)
    scored = materialise(cohesion.score_clusters(places, text, time, named, parameters.time_weight))
    accepted = cohesion.is_move(parameters.confidence_threshold)
    return MovePlan(
        clusters=scored,
        members=numbered.select("cluster_id", "member_ix", "pos", "id", "title", "create_time", "update_time"),
        moves=scored.where(accepted).select("cluster_id", "place"),
        low_confidence=scored.where(~accepted).select("cluster_id", "place"),
        singletons=placed.where(F.col("cluster_id") < 0).select("pos", "id"),
        filed=filed.select("pos", "id"),
        parameters=parameters,
        source=source,
        collection=collection,
    )


def build_move_plan(
    spark: SparkSession, export_path: str, parameters: PlanParameters | None = None,
    make_embedder: Callable[[], embedding.Embedder] = embedding.HashingEmbedder,
    make_labeller: Callable[[], labels.Labeller] | None = None, store_path: str | None = None,
    layout: str = export.AUTO, collection: str = "chats",
) -> MovePlan:
    """Read, deduplicate, set aside filed chats, embed, cluster, score and label."""
    p = parameters or PlanParameters()
    configure(spark)
    source = os.path.realpath(export_path) if os.path.exists(export_path) else export_path
    every = materialise(chats_of_export(spark, source, layout))
    filed, unfiled = normalize.split_filed(every)
    picked = normalize.head_limit(unfiled, p.limit)
    todo = materialise(normalize.with_excerpt(picked, p.conversation_word_limit))
    filed = with_row_index(filed.select("pos", "id").withColumnRenamed("pos", "at"), "at", index="pos")
    numbered = with_row_index(todo.withColumnRenamed("pos", "at"), "at", index="pos").drop("at")
    chats = materialise(numbered)
    if chats.isEmpty():
        return empty_plan(spark, filed, p, source, collection)
    vectors = embed_missing(spark, chats, p, make_embedder, store_path)
    left = store.missing_vectors(chats, vectors).take(5)
    if left:
        raise RuntimeError(f"missing embeddings for chats: {[r.id for r in left]}")
    points = materialise(store.vectors_for_chats(chats.select("id", "pos"), vectors).select("pos", "vector"))
    assigned = clustering.cluster_points(points, p.eps_cosine, p.min_samples, p.min_cluster_size)
    return assemble(chats, assigned, points, filed, p, make_labeller, source, collection)


def empty_plan(spark: SparkSession, filed: DataFrame, p: PlanParameters, source: str = "", collection: str = "chats") -> MovePlan:
    """Plan of an export in which nothing is left to file."""
    chats = spark.createDataFrame(
        [], "pos bigint, id string, title string, create_time double, update_time double"
    )
    assigned = spark.createDataFrame([], "pos bigint, cluster_id bigint")
    vectors = spark.createDataFrame([], "pos bigint, vector array<float>")
    return assemble(chats, assigned, vectors, filed, p, None, source, collection)


# -- results ------------------------------------------------------------------------------------


def proposed_moves(plan: MovePlan) -> DataFrame:
    """(place, cluster_id, project_folder_slug, project_title, member_ix, id), one row per chat to move."""
    heads = plan.clusters.select("cluster_id", "project_folder_slug", "project_title")
    return plan.moves.join(heads, "cluster_id").join(plan.members.select("cluster_id", "member_ix", "id"), "cluster_id")


def skipped_lists(plan: MovePlan) -> DataFrame:
    """(list, ordinal, value) of the three kinds of skipped items; cluster ids are text."""

    def rows(name: str, df: DataFrame, order: str, value) -> DataFrame:
        return df.select(F.lit(name).alias("list"), F.col(order).cast("bigint").alias("ordinal"), value.alias("value"))

    return (
        rows("clusters_low_confidence", plan.low_confidence, "place", F.col("cluster_id").cast("string"))
        .unionByName(rows("singletons", plan.singletons, "pos", F.col("id")))
        .unionByName(rows("already_in_project", plan.filed, "pos", F.col("id")))
    )


def summary(plan: MovePlan, shown: int = 50) -> DataFrame:
    """(line, text): the counts, the first moves, and how many more there are."""
    tagged = (
        plan.clusters.select(F.lit("c").alias("kind"))
        .unionByName(plan.moves.select(F.lit("m").alias("kind")))
        .unionByName(plan.singletons.select(F.lit("s").alias("kind")))
        .unionByName(plan.filed.select(F.lit("f").alias("kind")))
    )
    counts = tagged.agg(*[F.count_if(F.col("kind") == kind).alias(kind) for kind in "cmsf"])
    head = counts.select(
        F.lit(0).cast("bigint").alias("line"),
        F.format_string(
            "Clusters: %d | Proposed moves: %d | Singletons: %d | Pre-assigned skipped: %d", "c", "m", "s", "f"
        ).alias("text"),
    )
    heads = plan.clusters.select("cluster_id", "project_folder_slug", "project_title", "n")
    top = plan.moves.orderBy("place").limit(shown).join(heads, "cluster_id")
    lines = with_row_index(top, "place", index="row").select(
        (F.col("row") + 1).alias("line"),
        F.format_string("  -> %s [%s] : %d chats", "project_title", "project_folder_slug", "n").alias("text"),
    )
    more = counts.where(F.col("m") > shown).select(
        F.lit(shown + 1).cast("bigint").alias("line"), F.format_string("  ... and %d more", F.col("m") - shown).alias("text")
    )
    return head.unionByName(lines).unionByName(more)


def _json_text(value) -> str:
    import json

    return json.dumps(value, ensure_ascii=False)


def plan_lines(plan: MovePlan, generated_at: str | None = None) -> DataFrame:
    """The plan document as (section, place, item, text) rows, whose order gives one JSON text.

    Every chat is a row of its own, so a cluster of any size is never gathered.  Commas depend only on a
    row's place: all rows but the first of a list are preceded by one.
    """
    spark = plan.clusters.sparkSession
    stamp = generated_at or spark.range(1).select(
        F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSSxxx")
    ).first()[0]
    place, item = F.col("place").cast("bigint"), F.lit(0).cast("bigint")

    def row(section: int, df: DataFrame, text, place=place, item=item) -> DataFrame:
        return df.select(F.lit(section).alias("section"), place.alias("place"), item.alias("item"), text.alias("text"))

    def fixed(section: int, text: str) -> DataFrame:
        return row(section, spark.range(1), F.lit(text), F.lit(0).cast("bigint"))

    def js(column: str):
        """JSON form of one value: the member text of a one-field object, without its braces and name."""
        packed = F.to_json(F.struct(F.col(column).alias("v")), {"ignoreNullFields": "false"})
        return F.regexp_replace(packed, r'(?s)\A\{"v":(.*)\}\z', "$1")

    def comma(number):
        return F.when(number > 0, F.lit(",")).otherwise(F.lit(""))

    # The keys of the document and their order.
    head = [
        "{",
        f'  "plan_generated_at": {_json_text(stamp)},',
        f'  "source": {_json_text({"type": "conversations_json", "path": plan.source})},',
        f'  "parameters": {_json_text(plan.parameters.shown())},',
        f'  "collections": {_json_text({"qdrant_collection": plan.collection})},',
        '  "clusters": [',
    ]
    fields = (
        "cluster_id", "label", "project_folder_slug", "project_title", "confidence_model", "cohesion_text",
        "cohesion_time", "confidence_cohesion", "confidence_combined",
    )
    opening = F.concat(
        comma(F.col("place")), F.lit("{"), *[x for f in fields for x in (F.lit(f'"{f}": '), js(f), F.lit(", "))], F.lit('"chats": [')
    )
    members = plan.members.join(plan.clusters.select("cluster_id", "place"), "cluster_id")
    chat = F.concat(
        comma(F.col("member_ix")),
        F.to_json(F.struct("id", "title", "create_time", "update_time"), {"ignoreNullFields": "false"}),
    )
    order = with_row_index(plan.moves, "place", index="move")
    moved = proposed_moves(plan).join(order.select("cluster_id", "move"), "cluster_id")
    move_heads = plan.clusters.drop("place").join(order, "cluster_id")
    move_opening = F.concat(
        comma(F.col("move")), F.lit("{"),
        *[x for f in ("project_folder_slug", "project_title", "cluster_id") for x in (F.lit(f'"{f}": '), js(f), F.lit(", "))],
        F.lit('"chats": ['),
    )

    def listed(section: int, df: DataFrame, order_by: str, value: str) -> DataFrame:
        ranked = with_row_index(df.withColumn(value, F.col(value).cast("string")), order_by, index="row")
        return row(section, ranked, F.concat(comma(F.col("row")), js(value)), F.col("row"))

    last = F.lit(2**62).cast("bigint")
    parts = [
        fixed(0, "\n".join(head)),
        row(1, plan.clusters, opening),
        row(1, members, chat, item=F.col("member_ix") + 1),
        row(1, plan.clusters, F.lit("]}"), item=last),
        fixed(2, '  ],\n  "proposed_moves": ['),
        row(3, move_heads, move_opening, F.col("move")),
        row(3, moved, F.concat(comma(F.col("member_ix")), js("id")), F.col("move"), F.col("member_ix") + 1),
        row(3, move_heads, F.lit("]}"), F.col("move"), last),
        fixed(4, '  ],\n  "skipped": {\n    "clusters_low_confidence": ['),
        listed(5, plan.low_confidence, "place", "cluster_id"),
        fixed(6, '    ],\n    "singletons": ['),
        listed(7, plan.singletons, "pos", "id"),
        fixed(8, '    ],\n    "already_in_project": ['),
        listed(9, plan.filed, "pos", "id"),
        fixed(10, "    ]\n  }\n}"),
    ]
    lines = parts[0]
    for part in parts[1:]:
        lines = lines.unionByName(part)
    return lines


def write_plan(plan: MovePlan, path: str, generated_at: str | None = None) -> None:
    """Write the document as text; the part files in name order are one JSON text.

    The layout is the same at every size: one part for each range of lines.
    """
    lines = materialise(plan_lines(plan, generated_at))
    order = ("section", "place", "item")
    arranged = lines.repartitionByRange(*order).sortWithinPartitions(*order)
    arranged.select("text").write.mode("overwrite").text(path)
