"""Exact inner-product search by ball trees, one tree for each shard of the vectors.

Vectors go to the cell of their nearest pivot (a bounded sample of them), and a cell's
vectors to shards of bounded size; a ball tree is built over each shard. Within a tree a
search takes the nodes in the order of the largest inner product that their balls allow,
until no ball can hold a vector as good as the query's k-th. Each query first visits the
shard whose root ball allows most; the k-th score found there is shared, so that only
those shards are visited then whose root balls are open to it. Trees are sent only where
queries visit them.
"""

from __future__ import annotations

import heapq
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from texspark.llm.common import saved, table

#: Vectors of a shard and of a leaf, and queries of a block, at most (about, for shards and blocks).
SHARD, LEAF, BLOCK = 4096, 64, 1024
#: Cells at most; beyond that many shards, a cell's vectors are dealt to several shards by hash.
PIVOTS = 1024


class BallTree:
    """Nodes in arrays: a ball (centre, radius), two children or a run of vectors. Scores are summed as doubles if these hold them (`whole`)."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, whole: bool = True, leaf: int = LEAF):
        order, points = np.arange(len(ids)), vectors.astype(float)
        centres, radii, children, runs = [], [], [], []
        waiting = [(0, len(ids), -1, 0)]
        while waiting:
            a, b, parent, side = waiting.pop()
            node, part = len(centres), points[order[a:b]]
            if parent >= 0:
                children[parent][side] = node
            centre = part.mean(axis=0)
            distance = np.sqrt(((part - centre) ** 2).sum(axis=1))
            centres.append(centre)
            radii.append(distance.max() * (1 + 1e-9))
            children.append([-1, -1])
            runs.append((a, b))
            if b - a > leaf and distance.max() > 0:
                far = part[distance.argmax()]
                other = part[((part - far) ** 2).sum(axis=1).argmax()]
                along = (part @ (other - far)).argsort(kind="stable")
                order[a:b] = order[a:b][along]
                half = (b - a) // 2
                waiting += [(a, a + half, node, 0), (a + half, b, node, 1)]
        self.ids, self.vectors = ids[order], points[order] if whole else vectors[order]
        self.centres, self.radii, self.children, self.runs = np.array(centres), np.array(radii), children, runs
        self.opened = 0  # leaves, over all searches

    def search(self, query: np.ndarray, own: int | None, k: int, least: int | None) -> list[tuple[int, int]]:
        """The k best (score, id) of the vectors, ties to smaller ids, but none below `least`."""
        bounds = bounds_of(query.astype(float), self.centres, self.radii)
        asked = query.astype(self.vectors.dtype)
        least = -np.inf if least is None else least
        queue, best = [(-bounds[0], 0)], []
        while queue:
            bound, node = heapq.heappop(queue)
            if -bound < least:
                break
            if self.children[node][0] >= 0:
                for child in self.children[node]:
                    if bounds[child] >= least:
                        heapq.heappush(queue, (-bounds[child], child))
                continue
            a, b = self.runs[node]
            scores, ids = (self.vectors[a:b] @ asked).astype(np.int64), self.ids[a:b]
            good = scores >= least
            if own is not None:
                good &= ids != own
            best = sorted([*best, *zip((-scores[good]).tolist(), ids[good].tolist(), strict=True)])[:k]
            self.opened += 1
            if len(best) == k:
                least = max(least, -best[-1][0])
        return [(-s, i) for s, i in best]


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """Integer vectors as rows; shorter ones end in zeros."""
    lengths = pc.list_value_length(column).to_numpy(zero_copy_only=False)
    out = np.zeros((len(column), width), dtype=np.int64)
    out[np.arange(width) < lengths[:, None]] = column.flatten().to_numpy()
    return out


def bounds_of(queries: np.ndarray, centres: np.ndarray, radii: np.ndarray) -> np.ndarray:
    """The largest inner products that balls allow, rounded up."""
    lengths = np.sqrt((queries**2).sum(axis=-1))
    reach = np.sqrt((centres**2).sum(axis=1)) + radii
    return queries @ centres.T + np.multiply.outer(lengths, radii + 1e-9 * reach) + 1e-6


def search(vectors: DataFrame, is_query: Column, k: int = 5) -> DataFrame:
    """The k highest integer inner products of each query.

    vectors: (vec_id long, vector array<long>); is_query: a condition on it. A row is no
    candidate of its own (nor are rows of the same id). Returns query_id, rank, vec_id,
    score, ties to the smaller vec_id; all candidates if there are fewer than k. Rows with
    a null id, a null vector or null components take no part; vectors of unequal length
    count as ending in zeros; repeated rows are candidates once each, and of the rows of
    one id that the condition holds for, the smallest vector asks; an empty table gives no
    rows. Scores are exact; OverflowError is raised if they might not fit into a long.
    """
    vectors = vectors.where("vec_id is not null and vector is not null and not exists(vector, x -> x is null)").select("vec_id", "vector", is_query.alias("asks"))
    vectors = saved(vectors, "vectors")
    stats = vectors.agg(F.count("*").alias("n"), F.sum(F.col("asks").cast("int")).alias("asking"), F.max(F.size("vector")).alias("width"), F.max(F.array_max(F.transform("vector", lambda x: F.abs(x.cast("double"))))).alias("most")).first()
    if not stats.n or not stats.asking:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    shards, blocks, width, most = -(-stats.n // SHARD), -(-stats.asking // BLOCK), max(1, stats.width), stats.most or 0.0
    if most**2 * width >= 2.0**62:
        raise OverflowError("inner products may exceed a long")
    whole = most**2 * width < 2.0**52  # doubles hold the products

    # Vectors go to the cell of the nearest pivot, and a cell's to shards of bounded size.
    pivots = matrix(vectors.orderBy(F.xxhash64("vec_id"), "vector").limit(min(shards, PIVOTS)).select("vector").toArrow()["vector"].combine_chunks(), width).astype(float)

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = matrix(batch.column("vector"), width).astype(float)
            cells = ((pivots**2).sum(axis=1) - 2 * rows @ pivots.T).argmin(axis=1)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("vector"), pa.array(cells, pa.int64())], ["vec_id", "vector", "cell"])

    placed = saved(vectors.select("vec_id", "vector").mapInArrow(nearest, "vec_id long, vector array<long>, cell long").withColumn("row", F.monotonically_increasing_id()), "placed")
    sizes = placed.groupBy("cell").agg(F.ceil(F.count("*") / SHARD).alias("parts"))  # PIVOTS rows at most
    dealt = placed.join(F.broadcast(sizes), "cell").withColumn("shard", F.col("cell") + PIVOTS * F.pmod(F.xxhash64("row"), F.col("parts")))

    def build(group: pa.Table) -> pa.Table:
        ids = group["vec_id"].to_numpy()
        order = np.argsort(ids, kind="stable")
        tree = BallTree(ids[order], matrix(group["vector"].combine_chunks(), width)[order], whole)
        return pa.table({"shard": group["shard"][:1], "centre": pa.array([tree.centres[0].tolist()]), "radius": pa.array([float(tree.radii[0])]), "tree": pa.array([pickle.dumps(tree)], pa.binary())})

    trees = saved(dealt.groupBy("shard").applyInArrow(build, "shard long, centre array<double>, radius double, tree binary"), "trees")
    roots = trees.groupBy(F.pmod(F.xxhash64("shard"), F.lit(-(-shards // BLOCK))).alias("page")).agg(F.collect_list(F.struct("shard", "centre", "radius")).alias("roots"))  # BLOCK of them, about
    queries = vectors.where("asks").groupBy(F.col("vec_id").alias("query_id")).agg(F.min("vector").alias("vector"))
    queries = saved(queries, "queries")

    def open_pairs(asking: DataFrame, best: bool) -> DataFrame:
        """The shards (query_id, shard, bound) whose root ball is open to a query (query_id, vector, least); only the best of a page, if told."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in range(batch.num_rows):
                    balls, asked = batch.column("roots")[i].values, batch.column("queries")[i].values
                    centres = balls.field("centre").flatten().to_numpy().reshape(len(balls), width)
                    least = asked.field("least").fill_null(-(1 << 63)).to_numpy()
                    bounds = bounds_of(matrix(asked.field("vector"), width).astype(float), centres, balls.field("radius").to_numpy())
                    q, s = (np.arange(len(asked)), bounds.argmax(axis=1)) if best else np.nonzero(bounds >= least[:, None])
                    yield pa.record_batch({"query_id": asked.field("query_id").take(pa.array(q)), "shard": balls.field("shard").take(pa.array(s)), "bound": pa.array(bounds[q, s])})

        block = F.pmod(F.xxhash64("query_id", F.lit(7)), F.lit(blocks)).alias("block")
        packed = asking.groupBy(block).agg(F.collect_list(F.struct("query_id", "vector", "least")).alias("queries"))  # BLOCK queries, about
        pages = roots.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
        return pages.join(packed, "block").select("roots", "queries").mapInArrow(run, "query_id long, shard long, bound double")

    def visited(pairs: DataFrame, asking: DataFrame) -> DataFrame:
        """The best vectors (query_id, vec_id, score) of the shards for the queries that pairs (query_id, shard) name."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in range(batch.num_rows):
                    asked, tree, found = batch.column("queries")[i].values, pickle.loads(batch.column("tree")[i].as_py()), []
                    rows = matrix(asked.field("vector"), width)
                    for q, row, least in zip(asked.field("query_id").to_pylist(), rows, asked.field("least").to_pylist(), strict=True):
                        found += [(q, s, v) for s, v in tree.search(row, q, k, least)]
                    yield pa.record_batch({"query_id": pa.array([x[0] for x in found], pa.int64()), "vec_id": pa.array([x[2] for x in found], pa.int64()), "score": pa.array([x[1] for x in found], pa.int64())})

        parts = pairs.groupBy("shard").agg(F.ceil(F.count("*") / BLOCK).alias("parts"))
        named = pairs.join(parts, "shard").join(asking, "query_id").withColumn("part", F.pmod(F.xxhash64("query_id", F.lit(5)), F.col("parts")))
        packed = named.groupBy("shard", "part").agg(F.collect_list(F.struct("query_id", "vector", "least")).alias("queries"))
        return packed.join(trees.select("shard", "tree"), "shard").select("tree", "queries").repartition(max(1, shards * blocks)).mapInArrow(run, "query_id long, vec_id long, score long")

    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    fresh = queries.withColumn("least", F.lit(None).cast("long"))
    nearby = saved(open_pairs(fresh, True).groupBy("query_id").agg(F.max_by("shard", F.struct("bound", "shard")).alias("shard")), "nearby")
    first = saved(visited(nearby, fresh), "first")
    shared = first.withColumn("rank", F.row_number().over(order)).where(F.col("rank") == k).select("query_id", F.col("score").alias("least"))
    asking = queries.join(shared, "query_id", "left")
    rest = open_pairs(asking, False).select("query_id", "shard").join(nearby.withColumnRenamed("shard", "done"), "query_id").where("shard <> done").drop("done")
    best = first.unionByName(visited(rest, asking)).withColumn("rank", F.row_number().over(order))
    return best.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op4_top_k(spark, sf_dir: str) -> DataFrame:
    """The five nearest of every fiftieth vector among all others, by integer inner product."""
    finite = "embedding is not null and not exists(embedding, x -> x is null or isnan(x) or abs(x) = double('infinity'))"
    rows = table(spark, sf_dir, "embeddings").where(finite).select(F.col("vec_id").cast("long").alias("vec_id"), F.transform("embedding", lambda x: F.floor(256 * x.cast("double"))).alias("vector"))
    return search(rows, F.col("vec_id") % 50 == 0)


def oracle() -> str:
    return """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.e, c.e), lambda x: x[1] * x[2]))::BIGINT AS score FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INT AS rank, vec_id, score FROM r WHERE rank <= 5"""
