"""Clusters of chats from their vectors: density first, k-means when density finds nothing."""

from __future__ import annotations

import math

from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import Normalizer
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldwise.functions.vectors import cosine_to_euclid
from foldwise.operators.hierarchy import SLICE_EDGES, flat_clusters
from foldwise.operators.neighbours import copies_of, fold_copies
from foldwise.operators.ordering import with_row_index
from foldwise.operators.spanning import mutual_reachability_tree
from foldwise.session import SINGLE_TASK_ROWS, materialise

KMEANS_SEED = 42


def relabel(labels: DataFrame, label: str = "label") -> DataFrame:
    """(label, cluster_id): distinct non-noise labels numbered from 0 in ascending order."""
    return (
        with_row_index(labels.where(F.col(label) != -1).select(label).distinct(), label, index="cluster_id")
    ).select(label, "cluster_id")


def by_first_member(labels: DataFrame) -> DataFrame:
    """(pos, cluster_id): clusters numbered by the smallest position among their members."""
    first = labels.groupBy("label").agg(F.min("pos").alias("first"))
    numbered = with_row_index(first, "first", index="cluster_id").select("label", "cluster_id")
    return labels.join(numbered, "label").select("pos", "cluster_id")


def hdbscan(
    points: DataFrame, eps_cosine: float = 0.25, min_samples: int = 2, min_cluster_size: int = 2,
    block_rows: int | None = None, limit: int = SINGLE_TASK_ROWS, slice_edges: int = SLICE_EDGES,
) -> DataFrame:
    """(pos, cluster_id) of rows (pos, vector); noise gets -1."""
    tree = mutual_reachability_tree(points, max(1, int(min_samples)), block_rows, limit)
    labels = materialise(flat_clusters(tree, min_cluster_size, cosine_to_euclid(eps_cosine), min(limit, slice_edges)))
    numbered = by_first_member(labels)
    return points.select("pos").join(numbered, "pos", "left").fillna({"cluster_id": -1})


def kmeans_k(n: int) -> int:
    return max(2, math.isqrt(max(n, 1)))


def kmeans_model(points: DataFrame, k: int):
    """(fitted model, unit vectors) on the normalised vectors.

    The solver over rows sends the distances of all pairs of centres to the driver in every iteration, k² or about n of them; the
    one over blocks sends none.
    """
    wide = points.select("pos", array_to_vector(F.col("vector")).alias("_v"))
    unit = materialise(Normalizer(p=2.0, inputCol="_v", outputCol="features").transform(wide).select("pos", "features"))
    return KMeans(k=k, seed=KMEANS_SEED, maxIter=50, tol=1e-4, solver="block").fit(unit), unit


def kmeans_clusters(points: DataFrame, k: int | None = None) -> DataFrame:
    """(pos, cluster_id) by k-means with k = max(2, floor(sqrt(n))).

    With no more distinct vectors than k every distinct vector is a cluster.
    """
    k = k or kmeans_k(points.count())
    folded = materialise(fold_copies(points))
    if folded.count() <= k:
        own = folded.select("pos", F.col("pos").alias("label"))
        return by_first_member(own.unionByName(copies_of(points, folded).select("pos", F.col("rep").alias("label"))))
    model, unit = kmeans_model(points, k)
    found = materialise(model.transform(unit).select("pos", F.col("prediction").cast("bigint").alias("label")))
    return found.join(relabel(found), "label").select("pos", "cluster_id")


def cluster_points(
    points: DataFrame, eps_cosine: float = 0.25, min_samples: int = 2, min_cluster_size: int = 2
) -> DataFrame:
    """Density clusters; when every point is noise, k-means.  A lone point stays noise."""
    found = materialise(hdbscan(points, eps_cosine, min_samples, min_cluster_size))
    if not found.where(F.col("cluster_id") >= 0).isEmpty() or found.limit(2).count() < 2:
        return found
    return kmeans_clusters(points)


def member_index(members: DataFrame, order: str = "pos") -> DataFrame:
    """Add ``member_ix``, the 0-based place of each member in its cluster.

    Taken from a global order of (cluster, pos), so a huge cluster is spread over tasks.
    """
    ranked = with_row_index(members, "cluster_id", order, index="_row")
    starts = ranked.groupBy("cluster_id").agg(F.min("_row").alias("_start"))
    return ranked.join(starts, "cluster_id").withColumn("member_ix", F.col("_row") - F.col("_start")).drop("_row", "_start")


