"""Cohesion of clusters in text and time, and the confidence built from it.

Both measures are means over all pairs of a cluster.  Neither lists pairs: each has a form that is
linear in the members.
"""

from __future__ import annotations

from pyspark.ml.feature import Normalizer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foldwise.functions.vectors import dot
from foldwise.operators.ordering import with_row_index

DAY = 86400.0
#: Members of one segment in the time recurrence, and its longest span in decay times (e**500 is a double).
SEGMENT_ROWS = 100_000
SEGMENT_SPAN = 500.0


def clip(value: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), value))


def text_cohesion(members: DataFrame, vector: str = "vector") -> DataFrame:
    """(cluster_id, n, cohesion_text): mean cosine over pairs, in [0, 1]; 0 for a single member.

    With unit vectors u the sum over pairs is (|sum u|^2 - sum |u|^2) / 2.  ``Summarizer`` adds vectors
    inside the map tasks, so a huge cluster crosses the shuffle as one vector per task.
    """
    wide = members.select("cluster_id", array_to_vector(F.col(vector)).alias("_v"))
    unit = Normalizer(p=2.0, inputCol="_v", outputCol="_u").transform(wide)
    sums = unit.groupBy("cluster_id").agg(
        F.count("*").alias("n"),
        Summarizer.sum(F.col("_u")).alias("_sum"),
        F.sum(dot(vector_to_array("_u"), vector_to_array("_u"))).alias("_own"),
    )
    total = vector_to_array("_sum")
    pairs = F.col("n") * (F.col("n") - 1)
    mean = (dot(total, total) - F.col("_own")) / pairs
    return sums.select("cluster_id", "n", F.when(F.col("n") < 2, 0.0).otherwise(clip(mean)).alias("cohesion_text"))


def temporal_cohesion(
    members: DataFrame, decay_days: float = 30.0, order: str = "pos", segment_rows: int = SEGMENT_ROWS
) -> DataFrame:
    """(cluster_id, cohesion_time): mean of exp(-gap / decay) over pairs; 0.5 with fewer than two times.

    In time order S_j = sum over earlier i of exp(-(t_j - t_i)/decay) follows from a running sum of
    exp(t_i/decay).  Clusters are cut into segments of bounded rows and span, so a huge cluster is
    spread over many tasks; a segment's earlier members enter through one carried number.
    """
    tau = DAY * max(1e-6, decay_days)
    time = F.coalesce(F.col("create_time"), F.col("update_time"))
    timed = members.select("cluster_id", F.col(order), time.alias("t")).where(F.col("t").isNotNull())
    timed = with_row_index(timed, "cluster_id", "t", order, index="_row")
    row_segment = F.floor(F.col("_row") / segment_rows)
    placed = timed.withColumn("_seg", F.struct(F.floor(F.col("t") / (tau * SEGMENT_SPAN)), row_segment))
    segment = Window.partitionBy("cluster_id", "_seg")
    ordered = segment.orderBy("t", order)
    earlier = ordered.rowsBetween(Window.unboundedPreceding, -1)
    since = (F.col("t") - F.col("_first")) / tau
    scanned = (
        placed.withColumn("_first", F.min("t").over(segment))
        .withColumn("_rise", F.exp(since))
        .withColumn("_inner", F.exp(-since) * F.coalesce(F.sum("_rise").over(earlier), F.lit(0.0)))
    )
    segments = scanned.groupBy("cluster_id", "_seg").agg(
        F.count("*").alias("n"),
        F.min("t").alias("first"),
        F.max("t").alias("last"),
        F.sum("_inner").alias("inner"),
        F.sum(F.exp(-since)).alias("fall"),
        F.sum("_rise").alias("rise"),
    )
    # Segments of a cluster, in order: carry is the sum of exp(-(last - t_i)/tau) over all rows so far.
    listed = segments.groupBy("cluster_id").agg(
        F.sum("n").alias("n"),
        F.array_sort(F.collect_list(F.struct("first", "last", "inner", "fall", "rise", "_seg"))).alias("segs"),
    )
    gap = f"exp(-(s.first - st.last) / {tau!r}D)"
    carried = f"st.carry * {gap}"
    folded = (
        "aggregate(segs, named_struct('pairs', 0.0D, 'carry', 0.0D, 'last', segs[0].first), (st, s) -> named_struct("
        f"'pairs', st.pairs + s.inner + {carried} * s.fall, "
        f"'carry', ({carried} + s.rise) * exp(-(s.last - s.first) / {tau!r}D), 'last', s.last), st -> st.pairs)"
    )
    pairs = F.col("n") * (F.col("n") - 1) / 2.0
    value = F.when(F.col("n") >= 2, clip(F.expr(folded) / pairs)).otherwise(0.5)
    known = listed.select("cluster_id", value.alias("cohesion_time"))
    every = members.select("cluster_id").distinct()
    return every.join(known, "cluster_id", "left").fillna({"cohesion_time": 0.5})


def score_clusters(
    clusters: DataFrame, text: DataFrame, time: DataFrame, labels: DataFrame, time_weight: float = 0.25
) -> DataFrame:
    """Clusters with label, rounded cohesion and confidence; missing parts take their defaults.

    Order of rounding matters: cohesion is blended from unrounded parts, the combined value from the
    rounded blend.
    """
    weight = min(1.0, max(0.0, float(time_weight)))
    joined = (
        clusters.join(text.select("cluster_id", "cohesion_text"), "cluster_id", "left")
        .join(time.select("cluster_id", "cohesion_time"), "cluster_id", "left")
        .join(labels, "cluster_id", "left")
    )
    number = F.col("cluster_id").cast("string")
    t_text = F.coalesce("cohesion_text", F.lit(0.0))
    t_time = F.coalesce("cohesion_time", F.lit(0.5))
    label = F.coalesce("label", F.concat(F.lit("Cluster "), number))
    own = [c for c in clusters.columns if c != "cluster_id"]
    return joined.select(
        "cluster_id",
        *own,
        label.alias("label"),
        F.coalesce("project_folder_slug", F.concat(F.lit("cluster-"), number)).alias("project_folder_slug"),
        F.coalesce(F.col("project_title"), label).alias("project_title"),
        F.coalesce("confidence_model", F.lit(0.5)).alias("confidence_model"),
        F.round(t_text, 4).alias("cohesion_text"),
        F.round(t_time, 4).alias("cohesion_time"),
        F.round((1.0 - weight) * t_text + weight * t_time, 4).alias("confidence_cohesion"),
    ).withColumn(
        "confidence_combined", F.round(0.65 * F.col("confidence_model") + 0.35 * F.col("confidence_cohesion"), 4)
    )


def is_move(threshold: float) -> Column:
    return (F.col("confidence_combined") >= threshold) & (F.col("n") >= 2)
