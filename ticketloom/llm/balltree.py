"""Exact top-k by inner product: one ball tree per shard of the vectors, branch and bound per query.

A node's ball bounds every score in it by centre times query plus radius times the query's length. Nodes
are opened in the order of that bound until it falls below the k-th best score so far. Each query first
visits one shard; the k-th score it finds there goes along to all other shards, which open little else.
Shards are cut by a hash of the id, so equal vectors spread; a task holds one shard and one batch of
queries at a time.
"""
from __future__ import annotations

import heapq
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from .shared import arrow_map, picked, stored

LEAF = 48
# Vectors of a shard: as few as LEAST_SHARD where tasks are free, and MOST_SHARD at most.
LEAST_SHARD, MOST_SHARD = 500, 50_000


class BallTree:
    """Ball tree over the rows of a matrix; rows are put in tree order."""

    def __init__(self, ids: list, vectors: np.ndarray):
        order = np.arange(len(ids))
        self.nodes: list[tuple[int, int, int, int]] = []  # first row, end, left child, right child
        centres, radii = [], []

        def build(first: int, end: int) -> int:
            own = vectors[order[first:end]]
            centre = own.mean(axis=0)
            away = np.sqrt(((own - centre) ** 2).sum(axis=1))
            place = len(self.nodes)
            self.nodes.append((first, end, -1, -1))
            centres.append(centre)
            radii.append(away.max())
            if end - first > LEAF and away.max() > 0:
                one = own[away.argmax()]
                other = own[((own - one) ** 2).sum(axis=1).argmax()]
                half = (end - first) // 2
                order[first:end] = order[first:end][np.argpartition(own @ (other - one), half)]
                self.nodes[place] = (first, end, build(first, first + half), build(first + half, end))
            return place

        build(0, len(ids))
        self.ids = [ids[i] for i in order]
        self.vectors = vectors[order]
        self.centres, self.radii = np.array(centres), np.array(radii)

    def search(self, query: np.ndarray, own, k: int, bound: float) -> list[tuple[float, object]]:
        """Best ``k`` (score, id) of at least ``bound``, without the id ``own``; ties to smaller ids."""
        limits = self.centres @ query + self.radii * math.sqrt(float(query @ query))
        limits = limits + 1e-9 * (1 + np.abs(limits))  # rounding never hides a node
        best: list[tuple[float, object]] = []
        heap = [(-limits[0], 0)]
        while heap:
            limit, place = heapq.heappop(heap)
            if -limit < bound:
                break
            first, end, left, right = self.nodes[place]
            if left >= 0:
                for child in (left, right):
                    if limits[child] >= bound:
                        heapq.heappush(heap, (-limits[child], child))
                continue
            scores = self.vectors[first:end] @ query
            for row in np.flatnonzero(scores >= bound).tolist():
                if self.ids[first + row] != own:
                    best.append((float(scores[row]), self.ids[first + row]))
            if len(best) >= k:
                best.sort(key=lambda b: b[1])
                best.sort(key=lambda b: -b[0])
                del best[k:]
                bound = max(bound, best[-1][0])
        best.sort(key=lambda b: b[1])
        best.sort(key=lambda b: -b[0])
        return best[:k]


def _searched(k: int):
    """Rows come sorted by shard, vectors (side 0) before queries."""
    def run(batches):
        shard, ids, vectors, tree = None, [], [], None
        for batch in batches:
            rows = [batch.column(i).to_pylist() for i in (0, 1, 2, 4, 5)]
            matrix = batch.column(3)
            values, offsets = matrix.values.to_numpy(), matrix.offsets.to_numpy()
            out: list[tuple] = []
            for i, (own_shard, side, own, bound, key) in enumerate(zip(*rows)):
                if own_shard != shard:
                    shard, ids, vectors, tree = own_shard, [], [], None
                vector = values[offsets[i]:offsets[i + 1]]
                if side == 0:
                    ids.append(own)
                    vectors.append(vector.copy())
                    continue
                if ids and tree is None:
                    tree = BallTree(ids, np.array(vectors))
                    vectors = []
                if tree is not None:
                    out += [(own, key, v, s) for s, v in tree.search(vector, own, k, bound)]
            kind = batch.schema.field(2).type
            yield pa.RecordBatch.from_arrays(
                [pa.array([o[i] for o in out], t) for i, t in enumerate((kind, pa.int64(), kind, pa.float64()))],
                names=["query_id", "key", "vec_id", "score"])
    return run


def usable(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(vec_id, vec as doubles) of rows with an id and a vector without NULL or non-finite components."""
    rows = picked(vectors, vec_id=vec_id, vec=embedding).select("vec_id", F.col("vec").cast("array<double>").alias("vec"))
    return rows.where(
        F.col("vec_id").isNotNull() & F.col("vec").isNotNull() & (F.size("vec") > 0)
        & ~F.exists("vec", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, vec_id: str = "vec_id", embedding: str = "embedding",
          shards: int | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` highest inner products of each query, exactly.

    ``queries`` has the columns of ``vectors``. A query meets every vector of its own length whose id is not
    its own; with fewer than ``k`` of them all are returned, with none no row. Ties go to the smaller id.
    Vectors or queries that are NULL, empty, or hold NULL or non-finite components take no part, nor do
    NULL ids. Vectors with a repeated id are candidates each; repeated equal queries count once. Scores are
    double; sums of integers below 2**53 are exact.
    """
    base, asked = usable(vectors, vec_id, embedding), usable(queries, vec_id, embedding).distinct()
    kind = base.schema["vec_id"].dataType.simpleString()
    if shards is None:
        n, tasks = base.count(), int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        shards = max(1, math.ceil(n / MOST_SHARD), min(math.ceil(n / LEAST_SHARD), tasks))
    key = F.xxhash64("vec_id", "vec")
    sharded = base.select(F.pmod(F.xxhash64("vec_id"), F.lit(shards)).alias("shard"), F.lit(0).alias("side"), "vec_id", "vec",
                          F.lit(None).cast("double").alias("bound"), F.lit(0).cast("long").alias("key"))

    def search(asked):
        rows = sharded.unionByName(asked).select(
            F.xxhash64("shard", F.size("vec")).alias("shard"), "side", "vec_id", "vec", "bound", "key")
        return arrow_map(rows.repartition("shard").sortWithinPartitions("shard", "side"), _searched(k),
                         f"query_id {kind}, key long, vec_id {kind}, score double")

    asked = asked.select("vec_id", "vec", key.alias("key"), F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(shards)).alias("home"),
                         F.lit(1).alias("side"))
    at_home = asked.select(F.col("home").alias("shard"), "side", "vec_id", "vec", F.lit(float("-inf")).alias("bound"), "key")
    first = stored(search(at_home), "home-scores")
    bounds = first.groupBy("key").agg(F.min("score").alias("least"), F.count(F.lit(1)).alias("n")).where(
        F.col("n") >= k).select("key", F.col("least").alias("bound"))
    every = F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))
    elsewhere = asked.join(bounds, "key", "left").withColumn("shard", F.explode(every)).where("shard <> home").select(
        "shard", "side", "vec_id", "vec", F.coalesce("bound", F.lit(float("-inf"))).alias("bound"), "key")
    found = first.unionByName(search(elsewhere))
    order = W.partitionBy("query_id", "key").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score")
