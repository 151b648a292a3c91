"""Exact top-k by inner product: a ball tree per shard, searched by branch and bound.

Vectors are dealt to shards by a hash of their id; a group of shards and a
block of queries meet in one task. A node's bound for a query is the product
with the centre plus the query's length times the radius; nodes are opened in
the order of their bounds, and a node is left out for the queries whose kth
score so far is above its bound. A block of queries is first searched in one
group; the kth scores it finds there go with the queries to all other groups,
and inside a group from shard to shard.

Cases: vectors that are null, hold null or non-finite components, or have a
null id take no part; vectors of different length are not compared; ties go to
the smaller id; a row that repeats id and vector counts once; an empty table
gives no rows. A query has at most as many results as there are other ids.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

SHARD_ROWS = 2048
GROUP_SHARDS = 4
QUERY_BLOCK = 2048
LEAF = 64
EXACT = float(1 << 53)


class BallTree:
    """Nodes over the rows of one shard; children follow the halves of a projection on the farthest pair."""

    def __init__(self, vectors: np.ndarray):
        self.vectors = vectors
        self.order = np.arange(len(vectors))
        self.centre, self.radius, self.span, self.child = [], [], [], []
        self._build(0, len(vectors))

    def _build(self, low: int, high: int) -> int:
        rows = self.vectors[self.order[low:high]]
        centre = rows.mean(axis=0)
        distance = np.sqrt(((rows - centre) ** 2).sum(axis=1))
        node = len(self.span)
        self.centre.append(centre)
        self.radius.append(float(distance.max()))
        self.span.append((low, high))
        self.child.append(None)
        if high - low > LEAF:
            far = rows[distance.argmax()]
            other = rows[((rows - far) ** 2).sum(axis=1).argmax()]
            self.order[low:high] = self.order[low:high][np.argsort(rows @ (far - other), kind="stable")]
            middle = (low + high) // 2
            self.child[node] = (self._build(low, middle), self._build(middle, high))
        return node


class Best:
    """The k best (score, id) of each query so far."""

    def __init__(self, n: int, k: int, floor: np.ndarray):
        self.n, self.k = n, k
        self.floor = floor.astype(np.float64)
        self.query = np.zeros(0, np.int64)
        self.score: np.ndarray = np.zeros(0, np.int64)
        self.id = np.zeros(0, np.int64)

    def add(self, query: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        query, score, ids = np.concatenate([self.query, query]), np.concatenate([self.score, score]), np.concatenate([self.id, ids])
        order = np.lexsort((ids, -score, query))
        query, score, ids = query[order], score[order], ids[order]
        first = np.searchsorted(query, np.arange(self.n + 1))
        rank = np.arange(len(query)) - first[query]
        keep = rank < self.k
        full = np.flatnonzero(np.diff(first) >= self.k)
        self.floor[full] = np.maximum(self.floor[full], score[first[full] + self.k - 1].astype(np.float64))
        self.query, self.score, self.id = query[keep], score[keep], ids[keep]


def search_shard(tree: BallTree, exact: np.ndarray, ids: np.ndarray, queries: np.ndarray, exact_queries: np.ndarray, query_ids: np.ndarray, best: Best) -> None:
    """Branch and bound of a block of queries in one tree; ``exact`` holds the components as exact numbers."""
    length = np.sqrt((queries**2).sum(axis=1))
    slack = 1e-9 * (length * (np.abs(tree.vectors).max(initial=0.0) * np.sqrt(max(1, queries.shape[1])) + 1)) + 1e-6

    def bound(node: int, active: np.ndarray) -> np.ndarray:
        return queries[active] @ tree.centre[node] + length[active] * tree.radius[node] + slack[active]

    everyone = np.arange(len(queries))
    heap = [(0.0, 0, everyone)]
    while heap:
        _, node, active = heapq.heappop(heap)
        active = active[bound(node, active) >= best.floor[active]]
        if not len(active):
            continue
        if tree.child[node] is None:
            low, high = tree.span[node]
            rows = tree.order[low:high]
            score = exact_queries[active] @ exact[rows].T
            wanted = (score >= best.floor[active][:, None]) & (query_ids[active][:, None] != ids[rows][None, :])
            q, r = np.nonzero(wanted)
            best.add(active[q], np.array(score[q, r].tolist(), dtype=object) if score.dtype == object else score[q, r].astype(np.int64), ids[rows[r]])
            continue
        for child in tree.child[node]:
            above = bound(child, active) - np.where(np.isfinite(best.floor[active]), best.floor[active], 0.0)
            heapq.heappush(heap, (-float(above.max()), child, active))


def _search_group(k: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        names = ["query_id", "vec_id", "score"]
        empty = pa.table([pa.array([], pa.int64())] * 3, names=names)
        if not left.num_rows or not right.num_rows:
            return empty
        out = []
        sizes, query_sizes = left["v"].combine_chunks().value_lengths().to_numpy(), right["q"].combine_chunks().value_lengths().to_numpy()
        for dim in np.unique(query_sizes).tolist():
            rows, cols = left.filter(pa.array(sizes == dim)), right.filter(pa.array(query_sizes == dim))
            if not rows.num_rows:
                continue
            cut = lambda c: c.combine_chunks().flatten().to_numpy().reshape(len(c), dim)  # noqa: B023, E731
            vectors, queries = cut(rows["v"]), cut(cols["q"])
            ids, query_ids, shard = rows["vec_id"].to_numpy(), cols["query_id"].to_numpy(), rows["shard"].to_numpy()
            floor = cols["floor"].to_pandas().fillna(-np.inf).to_numpy(np.float64) if "floor" in cols.column_names else np.full(len(queries), -np.inf)
            best = Best(len(queries), k, floor)
            wide, wide_queries = vectors.astype(np.float64), queries.astype(np.float64)
            sure = dim * np.abs(wide).max(initial=0) * np.abs(wide_queries).max(initial=0) < EXACT
            kind = np.float64 if sure else object
            for number in np.unique(shard):
                mine = np.flatnonzero(shard == number)
                search_shard(BallTree(wide[mine]), vectors[mine].astype(kind), ids[mine], wide_queries, queries.astype(kind), query_ids, best)
            out.append(pa.table([query_ids[best.query], best.id, np.array(best.score.tolist(), np.int64)], names=names))
        return pa.concat_tables([empty, *out])

    return run


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10, shard_rows: int = SHARD_ROWS, group_shards: int = GROUP_SHARDS, query_block: int = QUERY_BLOCK) -> DataFrame:
    """The ``k`` vectors with the largest inner product for each query, other than the query's own id.

    Both tables hold ``vec_id`` long and ``v`` array<long>. Returns
    ``query_id, rank, vec_id, score``.
    """
    clean = lambda t: t.select("vec_id", "v").where("vec_id IS NOT NULL AND v IS NOT NULL").dropDuplicates(["vec_id", "v"])
    vectors, queries = clean(vectors), clean(queries)
    n, n_queries = vectors.count(), queries.count()
    shards = max(1, -(-n // shard_rows))
    groups, blocks = max(1, -(-shards // group_shards)), max(1, -(-n_queries // query_block))
    held = vectors.withColumn("shard", F.pmod(F.xxhash64("vec_id"), F.lit(shards))).withColumn("g", F.col("shard") % groups)
    held = held.withColumn("b", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
    asked = queries.select(F.col("vec_id").alias("query_id"), F.col("v").alias("q"), F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(blocks)).alias("b"))
    schema = "query_id long, vec_id long, score long"
    home = F.col("b") % groups

    def meet(candidates: DataFrame, block: DataFrame) -> DataFrame:
        left = candidates.select("b", "g", "shard", "vec_id", "v")
        right = block.toDF(*[{"b": "b_", "g": "g_"}.get(c, c) for c in block.columns])
        return left.groupBy("b", "g").cogroup(right.groupBy("b_", "g_")).applyInArrow(_search_group(k), schema)

    found = meet(held.where(F.col("g") == home), asked.withColumn("g", home))
    if groups > 1:
        kth = found.groupBy("query_id").agg(F.when(F.count("*") >= k, F.min("score")).alias("floor"))
        known = asked.join(kth, "query_id", "left")
        everywhere = known.withColumn("g", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long")))).where(F.col("g") != home)
        found = found.unionByName(meet(held.where(F.col("g") != home), everywhere))
    place = F.row_number().over(W.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return found.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def integer_vectors(table: DataFrame, scale: int = 1024) -> DataFrame:
    """Components as ``floor(scale * x)``; rows that may not take part are left out."""
    x = F.col("embedding")
    bad = F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    return table.where(x.isNotNull() & ~bad).select(F.col("vec_id").cast("long"), F.transform(x, lambda c: F.floor(F.lit(float(scale)) * c.cast("double")).cast("long")).alias("v"))
