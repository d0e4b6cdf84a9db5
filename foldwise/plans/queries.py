"""One query per operator over the driver's tables, for checks and timing."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foldwise.functions import epoch as E
from foldwise.functions import identifiers as I
from foldwise.functions import jsonval as J
from foldwise.functions import text as T
from foldwise.functions import vectors as V
from foldwise.operators import batching, clustering, cohesion, embedding, labels, messages, neighbours, normalize, ordering, spanning, split
from foldwise.plans import move_plan as P
from foldwise.plans import tables as D
from foldwise.session import materialise, scratch_path
from foldwise.sources import export, split_list, store, strict
from foldwise.streaming import incremental, latest

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
DENSITY_EPS = 0.64
#: Rows of a block in the clustering queries: small, so that the test tables already take many blocks.
BLOCK_ROWS = 100
BATCH_WORDS = 512


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


# -- scans --------------------------------------------------------------------------------------


def _by_file(conversations: DataFrame) -> DataFrame:
    """(file_no, id, ord): conversations numbered within their file, which is of bounded size."""
    chats = normalize.normalize_chats(conversations)
    ord_ = F.row_number().over(Window.partitionBy("pos.file").orderBy("pos"))
    file_no = F.regexp_extract("pos.file", r"export=(\d+)", 1).cast("bigint")
    return chats.select(file_no.alias("file_no"), "id", "title", ord_.cast("bigint").alias("ord"))


@query
def scan_export_json(spark, sf_dir):
    return _by_file(export.read_export(spark, D.write_documents(spark, sf_dir)))


@query
def scan_export_split(spark, sf_dir):
    """The same documents, each read by as many tasks as it has splits."""
    return _by_file(split_list.read_list(spark, D.write_documents(spark, sf_dir)))


@query
def scan_export_ndjson(spark, sf_dir):
    path = D.write_lines(spark, sf_dir)
    return normalize.normalize_chats(export.read_export(spark, path, export.LINES)).select("id", "title", "create_time")


@query
def flatten_wrapped(spark, sf_dir):
    return _by_file(export.read_export(spark, D.write_documents(spark, sf_dir, "wrapped"), export.DOCUMENT))


@query
def flatten_container(spark, sf_dir):
    return _by_file(export.read_export(spark, D.write_documents(spark, sf_dir, "container"), export.DOCUMENT))


@query
def scan_strict(spark, sf_dir):
    found = strict.read_strict(spark, D.write_documents(spark, sf_dir), export.DOCUMENT)
    return found.select(
        F.regexp_extract("pos.file", r"export=(\d+)", 1).cast("bigint").alias("file_no"),
        F.col("pos.item").alias("item"),
        F.expr("array_contains(map_keys(from_json(raw, 'map<string,string>')), 'mapping')").alias("has_mapping"),
    )


@query
def ndjson_error_lines(spark, sf_dir):
    broken = D.table(spark, sf_dir, "events").select(
        F.expr("case event_id % 50 when 7 then 'not json' when 9 then '[1]' when 11 then '  ' "
               "when 13 then concat(props, ' {}') else props end").alias("value")
    )
    path = scratch_path(spark, "lines")
    broken.write.text(path)
    found = strict.line_errors(strict.read_numbered_lines(spark, path))
    return found.groupBy("problem").agg(F.count("*").alias("n"))


# -- store --------------------------------------------------------------------------------------


def _stored(spark, sf_dir) -> tuple[str, DataFrame]:
    """A store in which every chat is written once and each second one a second time, doubled."""
    rows = D.chats(spark, sf_dir).withColumn("prompt_excerpt", F.lit(None).cast("string")).join(D.vectors(spark, sf_dir), "pos")
    path = scratch_path(spark, "store")
    store.upsert(spark, path, rows.where("pos % 3 != 1"))
    again = rows.where("pos % 2 = 0 and pos % 3 != 1")
    store.upsert(spark, path, again.withColumn("vector", F.expr("transform(vector, x -> x * 2)")).withColumn("title", F.concat("title", F.lit(" (2)"))))
    return path, D.chats(spark, sf_dir)


@query
def store_upsert(spark, sf_dir):
    path, _ = _stored(spark, sf_dir)
    return store.read_store(spark, path).select("id", "title", F.size("vector").alias("dim"), "create_time")


@query
def store_lookup(spark, sf_dir):
    path, chats = _stored(spark, sf_dir)
    found = store.lookup(spark, path, chats.where("pos % 5 != 0"))
    return found.select("id", F.round(F.expr("vector[0]").cast("double"), 6).alias("v0"))


@query
def embedding_misses(spark, sf_dir):
    path, chats = _stored(spark, sf_dir)
    return store.misses(chats, store.lookup(spark, path, chats)).select("id", "title")


@query
def vectors_for_chats(spark, sf_dir):
    path, chats = _stored(spark, sf_dir)
    cached = store.lookup(spark, path, chats)
    made = store.misses(chats, cached).join(D.vectors(spark, sf_dir), "pos").select("id", "vector")
    return store.vectors_for_chats(chats, cached, made).select("pos", "id", F.round(F.expr("vector[1]").cast("double"), 6).alias("v1"))


@query
def missing_vectors(spark, sf_dir):
    path, chats = _stored(spark, sf_dir)
    return store.missing_vectors(chats, store.lookup(spark, path, chats))


# -- chats --------------------------------------------------------------------------------------


def _normal(spark, sf_dir) -> DataFrame:
    rows = D.conversations(spark, sf_dir).select(F.struct("conv_id", "part").alias("pos"), "raw")
    return normalize.normalize_chats(rows)


@query
def shape_filter(spark, sf_dir):
    shapes = D.table(spark, sf_dir, "events").select(
        "event_id",
        F.expr(
            """case event_id % 8 when 0 then '{"title":null,"id":null}' when 1 then '{"conversation":{"title":"t"},"id":1}'
            when 2 then '{"title":"t"}' when 3 then '{"id":1}' when 4 then '{"title":"t","conversation_id":""}'
            when 5 then '{"title":"t","conversation":{"id":"x"}}' when 6 then concat('{"title":"t","conversation_id":', event_id, '}')
            else props end"""
        ).alias("raw"),
    )
    return shapes.where(F.expr(normalize.looks_like_conversation("raw"))).select("event_id")


@query
def normalize_chats(spark, sf_dir):
    return _normal(spark, sf_dir).select("id", "title", "create_time", "update_time")


@query
def detect_filed(spark, sf_dir):
    return _normal(spark, sf_dir).select("id", "project_id")


@query
def filed_split(spark, sf_dir):
    filed, unfiled = normalize.split_filed(normalize.dedup_latest(_normal(spark, sf_dir)))
    return filed.select("id", F.lit(True).alias("filed")).unionByName(unfiled.select("id", F.lit(False).alias("filed")))


@query
def head_limit(spark, sf_dir):
    _, unfiled = normalize.split_filed(_normal(spark, sf_dir))
    return normalize.head_limit(unfiled, 25).select("id", "title")


def _versions(spark, sf_dir) -> DataFrame:
    """Events as versions of their user: the value is the update time, so many versions tie."""
    return D.table(spark, sf_dir, "events").select(
        F.col("event_id").alias("pos"),
        F.col("user_id").cast("string").alias("id"),
        F.concat_ws("-", "event_type", "event_id").alias("title"),
        F.expr("if(event_id % 4 = 0, null, floor(value / 100))").cast("double").alias("update_time"),
    )


@query
def dedup_latest(spark, sf_dir):
    return normalize.dedup_latest(_versions(spark, sf_dir))


@query
def incremental_latest(spark, sf_dir):
    """Three arrivals of versions: some, then newer and repeated ones, then all again, stale ones among them."""
    folder, target = scratch_path(spark, "arrivals"), scratch_path(spark, "latest")
    versions = _versions(spark, sf_dir)
    for name, wanted in (("a", "pos % 3 = 1"), ("b", "pos % 3 < 2"), ("c", "true")):
        versions.where(wanted).write.parquet(f"{folder}/{name}")
        latest.keep_latest(latest.arriving(spark, folder, versions.schema), target, f"{target}-progress")
    return latest.read_latest(spark, target)


@query
def embedding_text(spark, sf_dir):
    rows = D.chats(spark, sf_dir).join(_excerpts(spark, sf_dir, 20), F.col("pos") == F.col("chat_id"), "left")
    excerpt = F.expr("if(pos % 4 = 0, '', prompt_excerpt)")
    return rows.withColumn("e", excerpt).select("id", F.expr(T.embedding_text("title", "e")).alias("text"))


# -- messages -----------------------------------------------------------------------------------


@query
def exclude_keywords(spark, sf_dir):
    return D.table(spark, sf_dir, "pages").select("page_id", F.expr(T.has_excluded_keyword("html")).alias("excluded"))


@query
def role_filter(spark, sf_dir):
    return D.turns(spark, sf_dir).where(F.expr(messages.role_allowed("role"))).select("chat_id", "ord", "role")


def _message_values(spark, sf_dir) -> DataFrame:
    return D.messages(spark, sf_dir).withColumn("v", F.expr("parse_json(message)"))


@query
def message_filter(spark, sf_dir):
    allowed = messages.metadata_allowed(J.field("v", "metadata"), J.field("v", "message_type"))
    return _message_values(spark, sf_dir).where(F.expr(allowed)).select("conv_id", "turn")


@query
def text_fragments(spark, sf_dir):
    """Every third payload lies within twelve more lists and parts."""
    nested = F.expr(
        "to_json(named_struct('parts', array(to_json(array(text)), role), 'text', concat('  ', role, ' '), 'data', named_struct('code', text, 'text', '')))"
    )
    deep = F.expr("""if(ord % 3 = 1, concat(repeat('[{"parts":[', 6), j, repeat(']}]', 6)), j)""")
    rows = D.turns(spark, sf_dir).select("chat_id", "ord", nested.alias("j")).withColumn("j", deep)
    found = F.expr(messages.text_fragments("parse_json(j)"))
    return rows.select("chat_id", "ord", F.posexplode(found).alias("ix", "fragment")).select("chat_id", "ord", F.col("ix").cast("bigint").alias("ix"), "fragment")


@query
def message_text(spark, sf_dir):
    block = F.expr(messages.message_block("v"))
    return _message_values(spark, sf_dir).select("conv_id", "turn", block.alias("block")).where("block is not null")


@query
def message_dedup(spark, sf_dir):
    rows = D.turns(spark, sf_dir).withColumn("msg_id", F.expr("if(ord % 3 = 2, null, concat(role, ord % 2))"))
    return messages.first_message_copies(rows).select("chat_id", "ord", "msg_id")


@query
def message_order(spark, sf_dir):
    rows = D.turns(spark, sf_dir).withColumn("ts", F.expr("if(ord % 4 = 1, null, -floor(ord / 2))").cast("double"))
    # A conversation may be of any length, so places come from a global order, not a window per chat.
    late = rows.withColumn("late", F.col("ts").isNull())
    ranked = ordering.with_row_index(late, "chat_id", "late", "ts", "ord", index="row")
    first = ranked.groupBy("chat_id").agg(F.min("row").alias("start"))
    return ranked.join(first, "chat_id").select("chat_id", "ord", (F.col("row") - F.col("start")).alias("place"))


def _excerpts(spark, sf_dir, limit: int) -> DataFrame:
    block = messages.labelled_text("role", f"array({T.strip('text')})")
    return messages.excerpts_of_turns(D.turns(spark, sf_dir).withColumn("block", F.expr(block)), limit)


@query
def conversation_excerpt(spark, sf_dir):
    return _excerpts(spark, sf_dir, messages.DEFAULT_WORD_LIMIT)


@query
def full_transcript(spark, sf_dir):
    return _excerpts(spark, sf_dir, 0)


@query
def export_excerpts(spark, sf_dir):
    rows = normalize.with_excerpt(_normal(spark, sf_dir), messages.DEFAULT_WORD_LIMIT)
    return rows.select("id", "prompt_excerpt")


# -- scalar functions ---------------------------------------------------------------------------


@query
def to_epoch(spark, sf_dir):
    stamps = D.table(spark, sf_dir, "events").select(
        "event_id",
        F.expr(
            """case event_id % 7
            when 0 then to_json(named_struct('t', unix_micros(cast(ts as timestamp)) div 1000))
            when 1 then to_json(named_struct('t', unix_micros(cast(ts as timestamp)) / 1000000))
            when 2 then to_json(named_struct('t', date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")))
            when 3 then to_json(named_struct('t', date_format(ts, 'yyyy-MM-dd HH:mm:ss')))
            when 4 then to_json(named_struct('t', cast(event_id as string)))
            when 5 then to_json(named_struct('t', event_type))
            else '{"t":null}' end"""
        ).alias("j"),
    )
    return stamps.select("event_id", F.round(F.expr(E.to_epoch(J.field("parse_json(j)", "t"))), 6).alias("epoch"))


@query
def word_count(spark, sf_dir):
    return D.table(spark, sf_dir, "documents").select("doc_id", F.expr(T.word_count("text")).cast("bigint").alias("words"))


@query
def eps_convert(spark, sf_dir):
    rows = D.table(spark, sf_dir, "events")
    return rows.select("event_id", F.round(V.cosine_to_euclid_col(F.col("value") / 100 - 1), 6).alias("eps"))


@query
def l2_normalize(spark, sf_dir):
    unit = V.l2_normalize(F.transform("vector", lambda x: x * F.col("pos")))
    return D.vectors(spark, sf_dir).select("pos", F.posexplode(unit).alias("dim", "u")).select("pos", F.col("dim").cast("bigint").alias("dim"), F.round("u", 6).alias("u"))


@query
def pair_cosine(spark, sf_dir):
    """Each vector with the next one: a number of pairs linear in the table."""
    a = D.vectors(spark, sf_dir).select("pos", F.col("vector").alias("a"))
    b = D.vectors(spark, sf_dir).select((F.col("pos") - 1).alias("pos"), F.col("vector").alias("b"))
    return a.join(b, "pos").select("pos", F.round(V.cosine(F.col("a"), F.col("b")), 6).alias("cosine"))


@query
def pair_time(spark, sf_dir):
    a = D.event_times(spark, sf_dir)
    b = a.select((F.col("pos") - 1).alias("pos"), F.col("create_time").alias("after"))
    return a.join(b, "pos").select("pos", F.round(V.time_kernel(F.col("after") - F.col("create_time"), 30.0), 8).alias("sim"))


@query
def file_identifier(spark, sf_dir):
    rows = D.table(spark, sf_dir, "pages").select(
        F.col("page_id"), F.expr("if(page_id % 3 = 0, '  ', null)").alias("a"), F.expr("if(page_id % 3 = 1, url, null)").alias("b"),
        F.expr("if(page_id % 3 = 2 and page_id % 2 = 0, url, '')").alias("c"),
    )
    name = I.derive_identifier("a", "b", "c", "page_id")
    return rows.select("page_id", F.expr(I.file_name(name, "page_id")).alias("file_name"))


@query
def sanitize_id(spark, sf_dir):
    return D.table(spark, sf_dir, "pages").select("page_id", F.expr(I.sanitize("url")).alias("token"))


# -- batches ------------------------------------------------------------------------------------


@query
def word_batches(spark, sf_dir):
    docs = D.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("pos"), "text")
    return batching.batch_groups(batching.word_batches(docs, BATCH_WORDS), 4)


@query
def chunk_rows(spark, sf_dir):
    docs = D.table(spark, sf_dir, "documents").select("doc_id")
    return ordering.chunk_rows(docs, embedding.REQUEST_TEXTS, "doc_id")


@query
def embed_hashed(spark, sf_dir):
    docs = D.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("pos"), F.col("doc_id").cast("string").alias("id"), "text")
    batches = batching.word_batches(docs, BATCH_WORDS, keep=("id",))
    made = embedding.embed_batches(docs.select("id", "text").join(batches.select("id", "batch_id"), "id"), lambda: embedding.HashingEmbedder(64))
    return made.select("id", F.size("vector").alias("dim"), F.expr("aggregate(vector, 0.0D, (s, x) -> s + x)").alias("words"))


@query
def embed_groups(spark, sf_dir):
    """Vectors with the group they were requested in; a group's vectors are stored before the next is requested."""
    docs = D.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("pos"), F.col("doc_id").cast("string").alias("id"), "text")
    parameters = P.PlanParameters(embedding_batch_words=BATCH_WORDS, embedding_batch_parallelism=100)
    made = P.embed_in_groups(docs, parameters, lambda: embedding.HashingEmbedder(64))
    return made.select("id", "group_id", F.size("vector").alias("dim"))


@query
def incremental_fill(spark, sf_dir):
    """Two arrivals of export files; the second repeats the first, and nothing is embedded twice."""
    folder, target = scratch_path(spark, "arrivals"), scratch_path(spark, "store")
    rows = D.conversations(spark, sf_dir)
    for name, wanted in (("a", "conv_id % 3 = 0"), ("b", "true")):
        rows.where(wanted).select(F.col("raw").alias("value")).write.text(f"{folder}/{name}")
        incremental.fill_from_stream(spark, folder, target, f"{target}-progress")
    return store.read_store(spark, target).select("id", "title", F.size("vector").alias("dim"))


# -- clusters given by the planted labels -------------------------------------------------------


@query
def text_cohesion(spark, sf_dir):
    found = cohesion.text_cohesion(D.planted(spark, sf_dir).withColumnRenamed("label", "cluster_id"))
    return found.select(F.col("cluster_id").cast("bigint").alias("cluster_id"), "n", F.round("cohesion_text", 6).alias("cohesion_text"))


@query
def temporal_cohesion(spark, sf_dir):
    members = D.table(spark, sf_dir, "events").select(
        F.col("event_id").alias("pos"), (F.col("event_id") % 97).alias("cluster_id")
    ).join(D.event_times(spark, sf_dir), "pos")
    timed = members.withColumn("update_time", F.expr("if(pos % 2 = 0, create_time, null)")).withColumn(
        "create_time", F.expr("if(pos % 3 = 0, null, create_time)")
    )
    found = cohesion.temporal_cohesion(timed, segment_rows=2000)
    return found.select("cluster_id", F.round("cohesion_time", 6).alias("cohesion_time"))


def _assigned(spark, sf_dir) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(unfiled chats, filed chats, planted vectors, planted clusters with lone members as noise)."""
    filed, unfiled = normalize.split_filed(D.chats(spark, sf_dir))
    points = D.planted(spark, sf_dir).join(unfiled.select("pos"), "pos")
    sizes = points.groupBy("label").agg(F.count("*").alias("n")).where("n > 1").select("label")
    known = clustering.by_first_member(points.join(F.broadcast(sizes), "label").select("pos", "label"))
    every = points.select("pos").join(known, "pos", "left").fillna({"cluster_id": -1})
    return unfiled, filed, points.select("pos", "vector"), every


def _plan(spark, sf_dir, threshold: float | None = None) -> P.MovePlan:
    """The plan at a threshold; midway between the least and the largest score unless given, so some clusters fail it."""
    chats, filed, points, assigned = _assigned(spark, sf_dir)
    if threshold is None:
        scores = P.assemble(chats, assigned, points, filed, P.PlanParameters(), source=sf_dir).clusters
        ends = scores.agg(F.min("confidence_combined").alias("low"), F.max("confidence_combined").alias("high")).first()
        threshold = (ends.low + ends.high) / 2
    return P.assemble(chats, assigned, points, filed, P.PlanParameters(confidence_threshold=threshold), source=sf_dir)


def _members(spark, sf_dir) -> DataFrame:
    chats, _, _, assigned = _assigned(spark, sf_dir)
    return chats.join(assigned.where("cluster_id >= 0"), "pos")


@query
def cluster_members(spark, sf_dir):
    return clustering.member_index(_members(spark, sf_dir)).select("cluster_id", "member_ix", "id")


@query
def relabel(spark, sf_dir):
    rows = D.table(spark, sf_dir, "events").select(F.expr("if(user_id % 5 = 0, -1, user_id * 3)").alias("label"))
    return clustering.relabel(rows)


@query
def label_requests(spark, sf_dir):
    return labels.label_requests(_members(spark, sf_dir), per_request=4)


@query
def fallback_labels(spark, sf_dir):
    return labels.fallback_labels(_members(spark, sf_dir))


def _replies(spark, sf_dir) -> DataFrame:
    """Replies of a labelling model, one per 10 events: lists with noise around them and bad items."""
    rows = D.table(spark, sf_dir, "events").withColumn(
        "item",
        F.expr(
            """case event_id % 6 when 0 then concat('{"cluster_id":', event_id, ',"label":" ', event_type, ' ","project_folder_slug":"s","project_title":"","confidence":', value, '}')
            when 1 then concat('{"cluster_id":"', event_id, '","label":"x","project_folder_slug":"s","project_title":"T"}')
            when 2 then concat('{"cluster_id":', event_id, ',"label":"x","project_folder_slug":"s","project_title":"T","confidence":null}')
            when 3 then concat('{"cluster":', event_id, '}')
            when 4 then concat('{"cluster_id":', event_id - 4, ',"label":"again","project_folder_slug":7,"project_title":" U ","confidence":"0.25"}')
            else '{"cluster_id":"none","label":"x","project_folder_slug":"s","project_title":"T"}' end"""
        ),
    )
    lists = rows.groupBy(F.floor(F.col("event_id") / 12).alias("request_id")).agg(
        F.array_sort(F.collect_list(F.struct("event_id", "item"))).alias("items")
    )
    body = "concat('[', array_join(transform(items, x -> x.item), ','), ']')"
    return lists.select("request_id", F.expr(f"if(request_id % 2 = 0, {body}, concat('Here: ', {body}, ' done'))").alias("reply"))


@query
def parse_label_json(spark, sf_dir):
    items = labels.reply_items(_replies(spark, sf_dir))
    return items.groupBy("request_id").agg(F.count("*").alias("items"))


@query
def validate_labels(spark, sf_dir):
    return labels.validate_labels(labels.reply_items(_replies(spark, sf_dir)))


@query
def labels_with_defaults(spark, sf_dir):
    members = _members(spark, sf_dir)
    clusters = members.groupBy("cluster_id").agg(F.count("*").alias("n"))
    known = labels.fallback_labels(members).where("cluster_id % 2 = 0")
    none = clusters.where("false").select("cluster_id", F.lit(0.0).alias("cohesion_text"), F.lit(0.0).alias("cohesion_time"))
    return cohesion.score_clusters(clusters, none, none, known).select(
        "cluster_id", "label", "project_folder_slug", "project_title", "confidence_model", "cohesion_text", "cohesion_time"
    )


@query
def cluster_scores(spark, sf_dir):
    return _plan(spark, sf_dir).clusters.drop("place")


@query
def proposed_moves(spark, sf_dir):
    return P.proposed_moves(_plan(spark, sf_dir)).select("cluster_id", "project_folder_slug", "project_title", "member_ix", "id")


@query
def skipped_lists(spark, sf_dir):
    return P.skipped_lists(_plan(spark, sf_dir))


@query
def plan_summary(spark, sf_dir):
    return P.summary(_plan(spark, sf_dir), shown=3)


@query
def plan_document(spark, sf_dir):
    return P.plan_lines(_plan(spark, sf_dir), "2024-01-01T00:00:00+00:00")


@query
def plan_empty(spark, sf_dir):
    filed = D.chats(spark, sf_dir).select("pos", "id")
    plan = P.empty_plan(spark, filed, P.PlanParameters(), sf_dir)
    return P.skipped_lists(plan)


@query
def split_files(spark, sf_dir):
    rows = D.conversations(spark, sf_dir).select(F.struct("conv_id", "part").alias("pos"), "raw")
    return split.named_conversations(rows).select("row_index", "file_name")


@query
def split_file_contents(spark, sf_dir):
    """The files that the splitter writes, read back."""
    rows = D.conversations(spark, sf_dir).select(F.struct("conv_id", "part").alias("pos"), "raw")
    target = scratch_path(spark, "split")
    split.write_conversation_files(split.named_conversations(rows), target)
    files = spark.read.text(target, wholetext=True).select(F.col("_metadata.file_name").alias("file_name"), F.col("value").alias("raw"))
    lines = F.size(F.split("raw", "\n"))
    found = normalize.normalize_chats(files.select(F.col("file_name").alias("pos"), "raw"))
    wide = files.select("file_name", (lines > 3).alias("indented"))
    return found.join(wide, F.col("pos") == F.col("file_name")).select("file_name", "id", "title", "create_time", "update_time", "project_id", "indented")


# -- clustering ---------------------------------------------------------------------------------


def _blocks(spark, sf_dir) -> neighbours.Blocks:
    return neighbours.lay_out(materialise(neighbours.fold_copies(D.vectors(spark, sf_dir))), BLOCK_ROWS)


@query
def knn(spark, sf_dir):
    found = neighbours.nearest_neighbours(_blocks(spark, sf_dir), 3)
    return found.select("pos", F.col("rank").cast("bigint").alias("rank"), "nbr", F.round("dist", 6).alias("dist"))


@query
def core_distance(spark, sf_dir):
    blocks = _blocks(spark, sf_dir)
    return neighbours.core_distances(blocks, neighbours.nearest_neighbours(blocks, 2), 2).select("pos", F.round("core", 6).alias("core"))


@query
def mutual_reach(spark, sf_dir):
    """Over the pairs of each point and its three nearest neighbours."""
    blocks = _blocks(spark, sf_dir)
    near = materialise(neighbours.nearest_neighbours(blocks, 3))
    core = materialise(neighbours.core_distances(blocks, near, 2))
    other = core.select(F.col("pos").alias("nbr"), F.col("core").alias("nbr_core"))
    return near.join(core, "pos").join(other, "nbr").select("pos", "nbr", F.round(F.greatest("dist", "core", "nbr_core"), 6).alias("reach"))


@query
def mst_weight(spark, sf_dir):
    tree = spanning.mutual_reachability_tree(D.vectors(spark, sf_dir), 2, BLOCK_ROWS)
    return tree.agg(F.count("*").alias("edges"), F.round(F.sum("weight"), 6).alias("weight"))


@query
def density_components(spark, sf_dir):
    return spanning.density_components(D.vectors(spark, sf_dir), DENSITY_EPS, 2, 2, BLOCK_ROWS)


@query
def hdbscan_clusters(spark, sf_dir):
    return clustering.hdbscan(D.vectors(spark, sf_dir), 0.0, 2, 2, BLOCK_ROWS)


@query
def hdbscan_planted_slices(spark, sf_dir):
    """The planted clusters again, their hierarchy condensed over slices of few edges."""
    return clustering.hdbscan(D.planted(spark, sf_dir), 0.25, 2, 2, BLOCK_ROWS, slice_edges=BLOCK_ROWS)


@query
def hdbscan_planted(spark, sf_dir):
    """Planted labels must come back as clusters when splits below the radius are merged."""
    return clustering.hdbscan(D.planted(spark, sf_dir), 0.25, 2, 2, BLOCK_ROWS)


@query
def kmeans_fallback(spark, sf_dir):
    found = clustering.kmeans_clusters(D.vectors(spark, sf_dir))
    return found.groupBy("cluster_id").agg(F.count("*").alias("n"))


@query
def move_plan(spark, sf_dir):
    chats, filed, points, _ = _assigned(spark, sf_dir)
    points = materialise(points)
    assigned = clustering.cluster_points(points)
    plan = P.assemble(chats, assigned, points, filed, P.PlanParameters())
    accepted = cohesion.is_move(plan.parameters.confidence_threshold)
    return plan.clusters.withColumn("moved", accepted)
