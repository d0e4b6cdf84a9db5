"""Names for clusters: requests to a labelling model, checks on its replies, and the fallback."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foldwise.functions import jsonval as J
from foldwise.functions import text as T
from foldwise.operators.embedding import ATTEMPTS, FIRST_DELAY
from foldwise.session import materialise, spread

# Titles shown per cluster, confidence of a fallback label and of a reply that names none.
TITLES_PER_CLUSTER = 12
LIST_TEXT = r"(?s)\[.*\]"
FALLBACK_CONFIDENCE = 0.5
DEFAULT_CONFIDENCE = 0.6
LABEL_SCHEMA = "cluster_id bigint, label string, project_folder_slug string, project_title string, confidence_model double"

#: Takes the JSON text of a request, returns the model's reply.
Labeller = Callable[[str], str]


def first_titles(members: DataFrame, order: str = "pos", n: int = TITLES_PER_CLUSTER) -> DataFrame:
    """(cluster_id, titles): the first titles in order; the rank limit applies before the shuffle."""
    rank = F.row_number().over(Window.partitionBy("cluster_id").orderBy(order))
    top = members.select("cluster_id", order, "title").withColumn("_rank", rank).where(F.col("_rank") <= n)
    listed = F.array_sort(F.collect_list(F.struct("_rank", "title")))
    return top.groupBy("cluster_id").agg(F.transform(listed, lambda t: t["title"]).alias("titles"))


def label_requests(members: DataFrame, order: str = "pos", per_request: int = 50) -> DataFrame:
    """(request_id, request): JSON lists of {cluster_id, titles} for up to ``per_request`` clusters."""
    titles = first_titles(members, order)
    return (
        titles.groupBy(F.floor(F.col("cluster_id") / per_request).alias("request_id"))
        .agg(F.array_sort(F.collect_list(F.struct("cluster_id", "titles"))).alias("clusters"))
        .select("request_id", F.to_json("clusters").alias("request"))
    )


def ask(requests: DataFrame, make_labeller: Callable[[], Labeller], attempts: int = ATTEMPTS, delay: float = FIRST_DELAY):
    """(request_id, reply): one call per request with bounded retries and a last extra call."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        call = make_labeller()

        def reply(text: str) -> str:
            for attempt in range(attempts):
                try:
                    return call(text)
                except Exception:
                    if attempt < attempts - 1:
                        time.sleep(delay * 2**attempt)
                        continue
                    return call(text)
            raise ValueError("attempts must be positive")

        for pdf in parts:
            yield pd.DataFrame({"request_id": pdf["request_id"], "reply": [reply(t) for t in pdf["request"]]})

    return spread(requests, 1 << 30, "request_id").mapInPandas(run, "request_id bigint, reply string")


def reply_items(replies: DataFrame) -> DataFrame:
    """(request_id, item, value): list elements of each reply, as VARIANT.

    A reply is read as strict JSON, else from its first ``[`` to its last ``]``; anything else raises.
    A JSON object gives no items.
    """
    strict = "from_json(concat('[', reply, ']'), 'array<string>')"
    whole = f"if(size({strict}) = 1, try_parse_json(reply), null)"
    inner = f"try_parse_json(nullif(regexp_extract(reply, {T.raw(LIST_TEXT)}, 0), ''))"
    failed = "raise_error(concat('the labelling model did not return JSON: ', substring(coalesce(reply, ''), 1, 200)))"
    parsed = replies.withColumn("v", F.expr(f"coalesce({whole}, {inner}, cast({failed} as variant))"))
    return parsed.select("request_id", F.posexplode(F.expr(J.array_items("v"))).alias("item", "value"))


def _number_text(value: str) -> str:
    """Text of a JSON number or string, trimmed; true and false count as 1 and 0."""
    text = f"trim(try_variant_get({value}, '$', 'string'))"
    return f"case to_json({value}) when 'true' then '1' when 'false' then '0' else {text} end"


def validate_labels(items: DataFrame) -> DataFrame:
    """Label rows from reply items; bad items are dropped and the last valid one of a cluster wins."""
    keys = ("cluster_id", "label", "project_folder_slug", "project_title")
    present = " and ".join(f"{J.field('value', k)} is not null" for k in keys)
    cid = _number_text(J.field("value", "cluster_id"))
    # A float is cut to a whole number; text must be a whole number already.
    not_whole = f"({J.is_string(J.field('value', 'cluster_id'))} and not {cid} rlike '^[+-]?[0-9]+$')"
    whole = f"case when {not_whole} then null else try_cast(try_cast({cid} as double) as bigint) end"
    confidence = (
        f"if({J.field('value', 'confidence')} is null, {DEFAULT_CONFIDENCE}D, "
        f"try_cast({_number_text(J.field('value', 'confidence'))} as double))"
    )
    rows = items.where(F.expr(present)).select(
        "request_id",
        "item",
        F.expr(whole).alias("cluster_id"),
        *[F.expr(T.strip(J.as_text(J.field("value", k)))).alias(k) for k in keys[1:]],
        F.expr(confidence).alias("confidence"),
    )
    valid = rows.where(F.col("cluster_id").isNotNull() & F.col("confidence").isNotNull())
    info = F.struct(
        "label",
        "project_folder_slug",
        F.when(F.col("project_title") != "", F.col("project_title")).otherwise(F.col("label")).alias("project_title"),
        F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("confidence"))).alias("confidence_model"),
    )
    last = F.max_by(info, F.struct("request_id", "item"))
    return valid.groupBy("cluster_id").agg(last.alias("i")).select("cluster_id", "i.*")


def fallback_labels(members: DataFrame, order: str = "pos") -> DataFrame:
    """Labels from the first title of each cluster."""
    first = members.groupBy("cluster_id").agg(F.min_by("title", F.col(order)).alias("title"))
    label = F.expr(T.fallback_label("title", "cluster_id"))
    return first.select(
        "cluster_id",
        label.alias("label"),
        F.expr(T.fallback_slug("title", "cluster_id")).alias("project_folder_slug"),
        label.alias("project_title"),
        F.lit(FALLBACK_CONFIDENCE).alias("confidence_model"),
    )


def label_clusters(
    members: DataFrame,
    make_labeller: Callable[[], Labeller] | None = None,
    order: str = "pos",
    per_request: int = 50,
    attempts: int = ATTEMPTS,
    delay: float = FIRST_DELAY,
) -> DataFrame:
    """Labels by the model, or the fallback for every cluster when there is none or any part of it fails."""
    if make_labeller is None:
        return fallback_labels(members, order)
    try:
        replies = ask(label_requests(members, order, per_request), make_labeller, attempts, delay)
        return materialise(validate_labels(reply_items(replies)))
    except Exception as error:  # any failure of model or reply leads to the fallback
        print(f"labelling failed, using fallback labels: {error}")
        return fallback_labels(members, order)
