"""Approximate nearest neighbours by cosine: a hierarchical navigable small-world graph for each shard.

Distinct vectors are dealt into shards of bounded size by their hash.  A task builds the graph of one shard: a node's
number of levels is drawn from a hash of its id, each level links a node to near and mutually distant ones, and the
levels are stored as flat arrays of neighbour numbers, one row for each shard.  A search descends through the levels of
every shard with a beam of candidates; the shards' results are merged by score.  Copies of a vector are one node, which
stands for their smallest ids.

Nodes are inserted in groups, and a group's searches advance together, so that the work lies in array operations.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foldwise.llm.bytetext import mix
from foldwise.session import scratch_path

NEAREST = 5
#: Distinct vectors in a shard, about.
SHARD_ROWS = 8192
#: Links of a new node, of which a node of the lowest level may gather twice as many.
LINKS = 16
#: Candidates kept while a node is inserted, while a query is answered, and on the way down.
BUILD_BEAM, SEARCH_BEAM, WAY_BEAM = 80, 128, 8
#: Nodes inserted together, queries answered together, candidates expanded together.
GROUP, BLOCK, EXPAND = 512, 256, 4
FIRST = 64


def beam(vectors: np.ndarray, links: np.ndarray, queries: np.ndarray, seeds: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The best nodes of one level found for each query and their similarities, best first; -1 where there are fewer.

    ``seeds`` has a row of start nodes for each query, without repeats and -1 for none.
    """
    n = len(links)
    seen = np.zeros((len(queries), n + 1), bool)  # the last column stands for no node
    seen[:, n] = True
    seen[np.arange(len(queries))[:, None], seeds] = True
    nodes = np.full((len(queries), width), -1, np.int32)
    value = np.full((len(queries), width), -np.inf, np.float32)
    spent = np.ones((len(queries), width), bool)
    live, fresh = np.arange(len(queries)), seeds.astype(np.int32)
    while len(live):
        row, col = np.nonzero(fresh >= 0)
        new = np.full(fresh.shape, -np.inf, np.float32)
        new[row, col] = np.einsum("ij,ij->i", vectors[fresh[row, col]], queries[live[row]])
        all_nodes, all_value = np.concatenate([nodes[live], fresh], 1), np.concatenate([value[live], new], 1)
        all_spent = np.concatenate([spent[live], fresh < 0], 1)
        top = np.argpartition(-all_value, width - 1, axis=1)[:, :width]
        here, worth, done = (np.take_along_axis(x, top, 1) for x in (all_nodes, all_value, all_spent))
        ahead = np.where(done, -np.inf, worth)
        pick = np.argpartition(-ahead, min(EXPAND, width) - 1, axis=1)[:, :EXPAND]
        open_ = np.take_along_axis(ahead, pick, 1) > -np.inf
        chosen = np.where(open_, np.take_along_axis(here, pick, 1), -1)
        np.put_along_axis(done, pick, True, 1)
        nodes[live], value[live], spent[live] = here, worth, done
        going = open_.any(1)
        live, chosen = live[going], chosen[going]
        around = np.where((chosen >= 0)[:, :, None], links[chosen], -1)
        for k in range(around.shape[1]):
            new_nodes = np.where(seen[live[:, None], around[:, k]], -1, around[:, k])
            seen[live[:, None], new_nodes] = True
            around[:, k] = new_nodes
        fresh = around.reshape(len(live), around.shape[1] * around.shape[2])
    order = np.argsort(-value, axis=1, kind="stable")
    return np.take_along_axis(nodes, order, 1), np.take_along_axis(value, order, 1)


def choose_links(vectors: np.ndarray, nodes: np.ndarray, value: np.ndarray, most: int) -> np.ndarray:
    """Up to ``most`` of each row's candidates, -1 for none: nearest first, and none that is nearer to a chosen one than to the row's own node."""
    order = np.argsort(-value, axis=1, kind="stable")
    nodes, value = np.take_along_axis(nodes, order, 1), np.take_along_axis(value, order, 1)
    out = np.full((len(nodes), most), -1, np.int32)
    for a in range(0, len(nodes), GROUP):
        part, worth = nodes[a : a + GROUP], value[a : a + GROUP]
        points = vectors[part]
        among = points @ points.transpose(0, 2, 1)
        kept, count = np.zeros(part.shape, bool), np.zeros(len(part), np.int64)
        for j in range(part.shape[1]):
            rival = np.where(kept, among[:, j], -np.inf).max(1)
            good = (part[:, j] >= 0) & (rival < worth[:, j]) & (count < most)
            kept[:, j] = good
            rows = np.flatnonzero(good)
            out[a + rows, count[rows]] = part[rows, j]
            count += good
    return out


def order_and_sizes(ids: np.ndarray) -> tuple[np.ndarray, list[int]]:
    """Nodes by falling number of levels, which a hash of the id draws, and how many have each level, lowest first."""
    drawn = mix(ids.astype(np.uint64), 3)
    level = np.floor(-np.log(((drawn >> np.uint64(11)).astype(np.float64) + 1) * 2.0**-53) / np.log(LINKS)).astype(np.int64)
    order = np.lexsort((drawn, -level))
    return order, [int((level >= k).sum()) for k in range(int(level.max(initial=0)) + 1)]


def build(vectors: np.ndarray, sizes: list[int]) -> list[np.ndarray]:
    """The links of each level over unit vectors in the order of ``order_and_sizes``: flat arrays of node numbers, -1 for none."""
    room = [2 * LINKS if k == 0 else LINKS for k in range(len(sizes))]
    links = [np.full((size, most), -1, np.int32) for size, most in zip(sizes, room)]
    a = 0
    while a < len(vectors):
        b = min(len(vectors), a + min(GROUP, max(FIRST, a)))
        group = vectors[a:b]
        within = group @ group.T
        np.fill_diagonal(within, -np.inf)
        seeds = None
        for level in reversed(range(len(sizes))):
            old, new = min(a, sizes[level]), min(b, sizes[level]) - a
            nodes, value = np.full((len(group), 1), -1, np.int32), np.full((len(group), 1), -np.inf, np.float32)
            if old:
                if seeds is None:
                    seeds = np.broadcast_to(np.arange(min(old, FIRST)), (len(group), min(old, FIRST)))
                nodes, value = beam(vectors[:old], links[level][:old], group, seeds, BUILD_BEAM if new > 0 else WAY_BEAM)
                seeds = nodes[:, :WAY_BEAM]
            if new <= 0:
                continue
            mates = np.argsort(-within[:new, :new], axis=1, kind="stable")[:, : BUILD_BEAM // 2]
            beside = np.take_along_axis(within[:new, :new], mates, 1)
            mates = np.where(beside > -np.inf, mates + a, -1)
            chosen = choose_links(vectors, np.concatenate([nodes[:new], mates], 1), np.concatenate([value[:new], beside], 1), LINKS)
            links[level][a : a + new, :LINKS] = chosen
            _link_back(vectors, links[level], a, chosen)
        a = b
    return links


def _link_back(vectors: np.ndarray, links: np.ndarray, first: int, chosen: np.ndarray) -> None:
    """Add the links of new nodes ``first``, ... to the nodes they chose; lists that overflow are chosen anew."""
    row, col = np.nonzero(chosen >= 0)
    to, source = chosen[row, col], (row + first).astype(np.int32)
    known = (links[to] == source[:, None]).any(1)  # mates that chose each other
    to, source = to[~known], source[~known]
    near = np.einsum("ij,ij->i", vectors[to], vectors[source])
    order = np.lexsort((source, -near, to))
    to, source = to[order], source[order]
    target, start, count = np.unique(to, return_index=True, return_counts=True)
    turn = np.arange(len(to)) - np.repeat(start, count)
    used = (links[target] >= 0).sum(1)
    most = links.shape[1]
    fits = used + count <= most
    plain = np.repeat(fits, count)
    links[to[plain], (np.repeat(used, count) + turn)[plain]] = source[plain]
    if fits.all():
        return
    full = target[~fits]
    extra = np.full((len(full), most), -1, np.int32)
    late = ~plain & (turn < most)
    extra[np.repeat(np.cumsum(~fits) - 1, count)[late], turn[late]] = source[late]
    nodes = np.concatenate([links[full], extra], 1)
    value = np.where(nodes >= 0, np.einsum("rcd,rd->rc", vectors[nodes], vectors[full]), -np.inf)
    links[full] = choose_links(vectors, nodes, value, most)


def search(vectors: np.ndarray, links: list[np.ndarray], queries: np.ndarray, width: int = SEARCH_BEAM) -> np.ndarray:
    """The nodes of the lowest level's beam for each query (unit vectors, like the nodes); -1 where there are fewer."""
    sizes = [len(level) for level in links]
    top = next((k for k, size in enumerate(sizes) if size <= width), len(sizes) - 1)  # small enough to be searched whole
    seeds = np.broadcast_to(np.arange(min(sizes[top], width)), (len(queries), min(sizes[top], width)))
    for level in reversed(range(top + 1)):
        nodes, _ = beam(vectors[: sizes[level]], links[level], queries, seeds, width if level == 0 or level == top else 2 * WAY_BEAM)
        seeds = nodes[:, : 2 * WAY_BEAM]
    return nodes


def _matrix(column: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _scaled(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Doubles divided by a power of two, which is exact, so that no square overflows, and their lengths."""
    vectors = vectors.astype(np.float64)
    vectors = np.ldexp(vectors, -np.frexp(np.abs(vectors).max(1))[1][:, None])
    return vectors, np.sqrt(np.einsum("ij,ij->i", vectors, vectors))


_INDEX = "dim int, shard int, ids binary, vectors binary, sizes array<int>, links array<binary>"


def _build_shard(table: pa.Table) -> pa.Table:
    dim, shard = table["dim"][0].as_py(), table["shard"][0].as_py()
    ids, vectors = table["vec_id"].to_numpy(), _matrix(table["embedding"], dim)
    order, sizes = order_and_sizes(ids)
    ids, vectors = ids[order], vectors[order]
    scaled, length = _scaled(vectors)
    links = build((scaled / length[:, None]).astype(np.float32), sizes)
    row = {
        "dim": dim, "shard": shard, "ids": ids.astype("<i8").tobytes(), "vectors": vectors.astype(f"<f{vectors.itemsize}").tobytes(),
        "sizes": sizes, "links": [x.astype("<i4").tobytes() for x in links],
    }
    schema = pa.schema([("dim", pa.int32()), ("shard", pa.int32()), ("ids", pa.binary()), ("vectors", pa.binary()), ("sizes", pa.list_(pa.int32())), ("links", pa.list_(pa.binary()))])
    return pa.Table.from_pylist([row], schema)


class _Shard:
    """A shard's graph as it was stored."""

    def __init__(self, row: dict):
        self.dim, self.ids = row["dim"], np.frombuffer(row["ids"], "<i8")
        width = len(row["vectors"]) // (len(self.ids) * self.dim)
        self.scaled, self.length = _scaled(np.frombuffer(row["vectors"], f"<f{width}").reshape(-1, self.dim))
        self.unit = (self.scaled / self.length[:, None]).astype(np.float32)
        self.links = [np.frombuffer(x, "<i4").reshape(size, -1) for size, x in zip(row["sizes"], row["links"])]

    def nearest(self, queries: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Query number, id and cosine of the ``most`` best nodes found for each query."""
        scaled, length = _scaled(queries)
        nodes = search(self.unit, self.links, (scaled / length[:, None]).astype(np.float32), max(SEARCH_BEAM, most))
        score = np.einsum("qcd,qd->qc", self.scaled[nodes], scaled) / (self.length[nodes] * length[:, None])
        score[nodes < 0] = -np.inf
        order = np.lexsort((self.ids[nodes], -score), axis=1)[:, :most]
        row, col = np.nonzero(np.take_along_axis(score, order, 1) > -np.inf)
        at = order[row, col]
        return row, self.ids[nodes[row, at]], score[row, at]


def _answer(most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = place = None
        for batch in batches:
            for row in batch.to_pylist():
                if row["ids"] is not None:
                    shard, place = _Shard(row), (row["dim"], row["shard"])
                    continue
                if place != (row["dim"], row["shard"]):
                    continue  # no vector of this length lies in the shard
                asked = np.array([x["query_id"] for x in row["block"]], np.int64)
                query, found, score = shard.nearest(np.array([x["embedding"] for x in row["block"]], np.float64), most)
                yield pa.RecordBatch.from_arrays([pa.array(asked[query]), pa.array(found), pa.array(score)], names=["query_id", "node", "score"])

    return run


def usable(vector: str | Column) -> Column:
    """Whether a vector takes part: not null, not zero, all components finite."""
    vector = F.col(vector) if isinstance(vector, str) else vector
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def _rows(vectors: DataFrame) -> DataFrame:
    """vec_id and embedding of the rows that take part; integers and decimals become doubles."""
    kind = "array<float>" if vectors.schema["embedding"].dataType.simpleString() == "array<float>" else "array<double>"
    rows = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("embedding").cast(kind).alias("embedding"))
    return rows.where(F.col("vec_id").isNotNull() & usable("embedding"))


def build_index(vectors: DataFrame, path: str, shard_rows: int = SHARD_ROWS, copies: int = NEAREST + 1) -> int:
    """Write the index of ``vectors`` (vec_id, embedding; others are ignored) below ``path``; the number of shards.

    ``path``/graphs has a row for each shard, ``path``/copies the ``copies`` smallest ids of each distinct vector.
    Null ids and vectors that aren't ``usable`` take no part.  Of an id's vectors the smallest counts.  Vectors of other
    lengths lie in shards of their own.
    """
    spark = vectors.sparkSession
    rows = _rows(vectors)
    total = rows.agg(F.count("*").alias("n"), F.count_distinct("vec_id").alias("ids")).first()
    if total.ids < total.n:
        rows = rows.groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    alike = Window.partitionBy("embedding").orderBy("vec_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    numbered = rows.select("vec_id", "embedding", F.min("vec_id").over(alike).alias("node"), F.row_number().over(Window.partitionBy("embedding").orderBy("vec_id")).alias("copy")).where(F.col("copy") <= copies)
    numbered.select("node", "vec_id", F.when(F.col("copy") == 1, F.col("embedding")).alias("embedding")).write.parquet(f"{path}/copies")
    shards = max(1, -(-total.n // shard_rows))
    points = spark.read.parquet(f"{path}/copies").where("embedding IS NOT NULL")
    points = points.select("vec_id", "embedding", F.size("embedding").alias("dim"), F.pmod(F.xxhash64("embedding"), F.lit(shards)).cast("int").alias("shard"))
    points.repartition(shards, "dim", "shard").groupBy("dim", "shard").applyInArrow(_build_shard, _INDEX).write.parquet(f"{path}/graphs")
    return shards


def search_index(spark: SparkSession, path: str, queries: DataFrame, shards: int, nearest: int = NEAREST) -> DataFrame:
    """query_id, rank, vec_id, score of the ``nearest`` vectors found for each of ``queries`` (vec_id, embedding), itself excepted.

    Every shard answers every query, block by block; the results of a shard are at most ``nearest`` + 1 rows a query.
    Ties go to the smaller vec_id.
    """
    asked = _rows(queries).select(F.col("vec_id").alias("query_id"), "embedding").dropDuplicates(["query_id"])
    blocks = max(1, -(-asked.count() // BLOCK))
    packed = asked.groupBy(F.size("embedding").alias("dim"), F.pmod(F.xxhash64("query_id"), F.lit(blocks)).alias("part")).agg(F.collect_list(F.struct("query_id", F.col("embedding").cast("array<double>").alias("embedding"))).alias("block"))
    sent = packed.select("dim", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), "block")
    both = spark.read.parquet(f"{path}/graphs").unionByName(sent, allowMissingColumns=True)
    streams = both.repartition(shards, "dim", "shard").sortWithinPartitions("dim", "shard", F.col("ids").isNull())
    found = streams.mapInArrow(_answer(nearest + 1), "query_id bigint, node bigint, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "node")
    merged = found.withColumn("place", F.row_number().over(best)).where(F.col("place") <= nearest + 1)
    copies = spark.read.parquet(f"{path}/copies").select("node", "vec_id")
    members = merged.join(copies, "node").where("vec_id <> query_id")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return members.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= nearest).select("query_id", "rank", "vec_id", "score")


def nearest_neighbours(vectors: DataFrame, chosen: Column, nearest: int = NEAREST, shard_rows: int = SHARD_ROWS, folder: str | None = None) -> DataFrame:
    """``search_index`` over all of ``vectors`` for those rows of it that are ``chosen``; an empty table gives an empty table."""
    spark = vectors.sparkSession
    folder = folder or scratch_path(spark, "graphs")
    shards = build_index(vectors, folder, shard_rows, nearest + 1)
    return search_index(spark, folder, vectors.where(chosen), shards, nearest)
