"""Vector retrieval: exact and LSH top-k, thresholds, fusion, recommendation.

Exact search takes a stated set of queries, sent to the tasks behind a check of its size, against all
rows block by block; beyond that size blocks of queries and blocks of items meet in one shuffle.
"""

from __future__ import annotations

import random
from collections.abc import Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

MAX_QUERY_ROWS = 4096
#: Rows of a block of queries and of items, and of the slice of items that is scored at once.
QUERY_BLOCK, ITEM_BLOCK, ITEM_SLICE = 2048, 32768, 2048


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def normalised(v: Column) -> Column:
    n = F.sqrt(dot(v, v))
    return F.when(n > 0, F.transform(v, lambda x: x.cast("double") / n)).otherwise(F.transform(v, lambda x: x.cast("double")))


def _ranked(scores: DataFrame, query: str, item: str, k: int) -> DataFrame:
    w = Window.partitionBy(query).orderBy(F.desc("score"), item)
    return scores.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


class _Best:
    """The k best items of each query of a block, over items that come in batches."""

    def __init__(self, ids: np.ndarray, matrix: np.ndarray, k: int, digits: int, exclude_same: bool, candidates=None):
        self.ids, self.matrix, self.k, self.digits, self.exclude_same, self.candidates = ids, matrix, k, digits, exclude_same, candidates
        # sorted by query, then score, then item
        self.held = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))

    def add(self, item: np.ndarray, vecs: np.ndarray) -> None:
        if not len(item) or not len(self.ids):
            return
        scores = np.round(vecs @ self.matrix.T, self.digits) + 0.0
        if self.candidates:
            scores[~self.candidates(vecs, len(self.ids))] = -np.inf
        if self.exclude_same:
            scores[item[:, None] == self.ids[None, :]] = -np.inf
        least = np.full(len(self.ids), -np.inf)
        if len(item) > self.k:  # with all ties of the k-th score
            least = np.partition(scores, len(item) - self.k, axis=0)[len(item) - self.k]
        at, q = np.nonzero((scores >= least) & (scores > -np.inf))
        q, i, s = (np.concatenate(x) for x in zip(self.held, (q, item[at], scores[at, q]), strict=True))
        order = np.lexsort((i, -s, q))
        q, i, s = q[order], i[order], s[order]
        first = np.flatnonzero(np.concatenate([[True], q[1:] != q[:-1]])) if q.size else np.zeros(0, np.int64)
        place = np.arange(q.size) - np.repeat(first, np.diff(np.append(first, q.size)))
        self.held = tuple(x[place < self.k] for x in (q, i, s))

    def columns(self) -> list[pa.Array]:
        return [pa.array(self.ids[self.held[0]], pa.int64()), pa.array(self.held[1], pa.int64()), pa.array(self.held[2], pa.float64())]


def _matrix(column) -> np.ndarray:
    """A column of equally long lists as rows of doubles."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _hits_schema(query_id: str, item_id: str) -> T.StructType:
    return T.StructType([T.StructField(query_id, T.LongType()), T.StructField(item_id, T.LongType()), T.StructField("score", T.DoubleType())])


def knn(queries: DataFrame, index: DataFrame, k: int, query_id: str, query_vec: str, item_id: str, item_vec: str, exclude_same: bool = False, digits: int = 6, sketch=None) -> DataFrame:
    """query_id, item_id, score, rank of the k best items by dot product (rounded, ties by item).

    Up to MAX_QUERY_ROWS queries go to the tasks, each of which keeps its k best per query, so k rows per query and
    task are shuffled, never the pairs; more are dealt in blocks by ``knn_join``. Queries with a null vector are
    left out. ``sketch``: what is made of the queries' vectors, and which items it makes candidates, by item and query.
    """
    q = queries.select(F.col(query_id).cast("long").alias("q"), F.col(query_vec).alias("v")).where("v is not null")
    rows = q.limit(MAX_QUERY_ROWS + 1).collect()  # bounded
    if len(rows) > MAX_QUERY_ROWS:
        return knn_join(queries, index, k, query_id, query_vec, item_id, item_vec, exclude_same, digits, sketch)
    ids, matrix = np.array([r["q"] for r in rows], np.int64), np.array([r["v"] for r in rows], np.float64)
    schema = _hits_schema(query_id, item_id)
    looks = sketch[0](matrix) if sketch and len(ids) else None

    def search(batches):
        best = _Best(ids, matrix, k, digits, exclude_same, sketch and (lambda vecs, n: sketch[1](looks, vecs, n)))
        for batch in batches:
            if batch.num_rows and len(ids):
                best.add(batch.column(0).to_numpy(), _matrix(batch.column(1)))
        yield pa.RecordBatch.from_arrays(best.columns(), names=schema.fieldNames())

    found = index.select(F.col(item_id).cast("long").alias(item_id), F.col(item_vec).alias("v")).where("v is not null").mapInArrow(search, schema)
    return _ranked(found, query_id, item_id, k)


def blocks_topk(queries: DataFrame, items: DataFrame, block: list[str], k: int, schema: T.StructType, exclude_same: bool = False, digits: int = 6, sketch=None) -> DataFrame:
    """The k best of each block: ``queries`` (block, q, v) against ``items`` (block, x, v) of the same block, which fit a task."""

    def search(_, left, right):
        matrix = _matrix(left.column("v")) if left.num_rows and right.num_rows else np.zeros((0, 0))
        looks = sketch[0](matrix) if sketch and len(matrix) else None
        best = _Best(left.column("q").to_numpy()[: len(matrix)], matrix, k, digits, exclude_same, sketch and (lambda vecs, n: sketch[1](looks, vecs, n)))
        for batch in right.to_batches(max_chunksize=ITEM_SLICE) if len(matrix) else []:
            best.add(batch.column("x").to_numpy(), _matrix(batch.column("v")))
        return pa.Table.from_arrays(best.columns(), names=schema.fieldNames())

    return queries.groupBy(*block).cogroup(items.groupBy(*block)).applyInArrow(search, schema)


def knn_join(queries: DataFrame, index: DataFrame, k: int, query_id: str, query_vec: str, item_id: str, item_vec: str, exclude_same: bool = False, digits: int = 6, sketch=None, query_block: int = QUERY_BLOCK, item_block: int = ITEM_BLOCK) -> DataFrame:
    """As ``knn``, for any number of queries; nothing passes through the driver but two counts.

    Equal vectors are searched for once: queries by their distinct vectors, items by the k smallest ids of each distinct
    vector (equal vectors have equal scores, so later ids are behind these). Both are dealt into blocks, and every pair of blocks
    is a cell of a grid that one task holds: one shuffle on the cell, in which vectors of queries are repeated once an item block and items
    once a query block. Cells give k rows a vector, which are merged by key and joined to the queries by their vectors.
    """
    q = queries.select(F.col(query_id).cast("long").alias(query_id), F.col(query_vec).cast("array<double>").alias("v")).where("v is not null")
    x = index.select(F.col(item_id).cast("long").alias("x"), F.col(item_vec).cast("array<double>").alias("v")).where("v is not null")
    most = k + 1 if exclude_same else k  # the query itself may be among them
    looked = q.groupBy("v").agg(F.min(query_id).alias("q"))
    kept = x.withColumn("no", F.row_number().over(Window.partitionBy("v").orderBy("x"))).where(F.col("no") <= most).drop("no")
    rows, cols = max(1, -(-looked.count() // query_block)), max(1, -(-kept.count() // item_block))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = looked.withColumn("row", F.pmod(F.xxhash64("q"), F.lit(rows)).cast("int")).withColumn("col", every(cols))
    right = kept.withColumn("col", F.pmod(F.xxhash64("x"), F.lit(cols)).cast("int")).withColumn("row", every(rows))
    best = _ranked(blocks_topk(left, right, ["row", "col"], most, _hits_schema("q", item_id), False, digits, sketch), "q", item_id, most)
    # a vector's hits by rank, at most ``most``
    lists = best.groupBy("q").agg(F.sort_array(F.collect_list(F.struct("rank", item_id, "score"))).alias("hits"))
    found = q.join(looked.join(lists, "q").select("v", "hits"), "v").select(query_id, "hits")
    if exclude_same:
        found = found.select(query_id, F.filter("hits", lambda h: h[item_id] != F.col(query_id)).alias("hits"))
    out = found.select(query_id, F.posexplode(F.slice("hits", 1, k)).alias("rank", "h"))
    return out.select(query_id, F.col(f"h.{item_id}").alias(item_id), F.col("h.score").alias("score"), (F.col("rank") + 1).alias("rank"))


def prefetch(models: dict[str, tuple[DataFrame, DataFrame]], limit: int, merge: bool = False, k: int = 60) -> DataFrame:
    """The ``limit`` best items of every query for each model; merged: fused over the models by reciprocal ranks.

    ``models``: by name a table of queries (q_id, v) and one of items (x_id, v).
    """
    found = [knn(q, x, limit, "q_id", "v", "x_id", "v").withColumn("model", F.lit(name)) for name, (q, x) in models.items()]
    hits = reduce(DataFrame.unionByName, found)
    return reciprocal_rank_fusion(hits, "q_id", "x_id", limit, k) if merge else hits


def above_threshold(queries: DataFrame, index: DataFrame, k: int, least: float, **names: str) -> DataFrame:
    return knn(queries, index, k, **names).where(F.col("score") >= least)


def lsh_knn(queries: DataFrame, index: DataFrame, k: int, query_id: str, query_vec: str, item_id: str, item_vec: str, dim: int, tables: int = 24, bits: int = 8, seed: int = 7, digits: int = 6) -> DataFrame:
    """Approximate top-k: items that share a bucket with a query, or lie in one of a single other bit, are scored exactly.

    Buckets are sign hashes of random directions. The probing of neighbouring buckets is what finds
    neighbours of low similarity: with it the recall at 10 is over 0.9 at cosines from 0.26, without it under 0.5.
    """
    planes = np.array([[random.Random(f"{seed}|{i}|{j}").gauss(0, 1) for j in range(dim)] for i in range(tables * bits)])

    def codes(v: np.ndarray) -> np.ndarray:
        return ((v @ planes.T > 0).reshape(len(v), tables, bits) * (1 << np.arange(bits))).sum(axis=2)

    def buckets(v: np.ndarray) -> np.ndarray:
        """By table and code, the queries that look there, as packed bits."""
        own, out = codes(v), np.zeros((tables, 1 << bits, -(-len(v) // 8)), np.uint8)
        for t in range(tables):
            looks = np.zeros((1 << bits, len(v)), bool)
            for flip in (0, *(1 << np.arange(bits))):
                looks[own[:, t] ^ flip, np.arange(len(v))] = True
            out[t] = np.packbits(looks, axis=1)
        return out

    def candidates(looks: np.ndarray, v: np.ndarray, n: int) -> np.ndarray:
        own = codes(v)
        met = reduce(np.bitwise_or, (looks[t][own[:, t]] for t in range(tables)))
        return np.unpackbits(met, axis=1, count=n).astype(bool)

    return knn(queries, index, k, query_id, query_vec, item_id, item_vec, digits=digits, sketch=(buckets, candidates))


def reciprocal_rank_fusion(hits: DataFrame, query: str, item: str, limit: int, k: int = 60) -> DataFrame:
    """``hits``: query, item, rank from 1, of any number of models. Score: sum of 1 / (k + rank)."""
    fused = hits.groupBy(query, item).agg(F.round(F.sum(1.0 / (F.lit(k) + F.col("rank"))), 6).alias("score"))
    return _ranked(fused, query, item, limit)


def mean_vector(df: DataFrame, vec: str, key: str | None = None) -> DataFrame:
    """The mean of vectors (per key)."""
    keys = [key] if key else []
    parts = df.select(*keys, F.posexplode(vec).alias("pos", "x")).groupBy(*keys, "pos").agg(F.avg(F.col("x").cast("double")).alias("m"))
    return parts.groupBy(*keys).agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "m"))), lambda p: p["m"]).alias(vec))


def recommend_vector(positives: DataFrame, negatives: DataFrame, vec: str) -> DataFrame:
    """avg(positives) + (avg(positives) - avg(negatives)) as one row."""
    p, n = mean_vector(positives, vec).withColumnRenamed(vec, "p"), mean_vector(negatives, vec).withColumnRenamed(vec, "n")
    return p.crossJoin(F.broadcast(n)).select(F.zip_with("p", "n", lambda a, b: 2 * a - b).alias(vec))  # one row each


def discover(pairs: DataFrame, index: DataFrame, item_id: str, item_vec: str, k: int, target: DataFrame | None = None) -> DataFrame:
    """item_id, score of the k best items by context pairs: the number of pairs whose positive is nearer than the
    negative less the others, plus the sigmoid of the similarity to ``target`` (one row, column ``v``).

    ``pairs``: one row each, vectors ``p`` and ``n``; a few rows, checked.
    """
    if pairs.limit(MAX_QUERY_ROWS + 1).count() > MAX_QUERY_ROWS:
        raise ValueError(f"more than {MAX_QUERY_ROWS} context pairs")
    items = index.select(F.col(item_id), F.col(item_vec).alias("_v"))
    met = items.crossJoin(F.broadcast(pairs.select("p", "n")))  # a stated, checked set
    score = F.signum(F.round(dot(F.col("_v"), F.col("p")) - dot(F.col("_v"), F.col("n")), 9))
    ranked = met.groupBy(item_id).agg(F.sum(score).alias("score"))
    if target is not None:
        near = items.crossJoin(F.broadcast(target.select("v").limit(1))).select(item_id, (1 / (1 + F.exp(-dot(F.col("_v"), F.col("v"))))).alias("_s"))
        ranked = ranked.join(near, item_id).select(item_id, (F.col("score") + F.col("_s")).alias("score"))
    return ranked.select(item_id, F.round("score", 6).alias("score")).orderBy(F.desc("score"), item_id).limit(k)


def padded_hits(hits: DataFrame, query: str, item: str, width: int) -> DataFrame:
    """query, items, scores: a batch's hits by rank as lists of one length, padded with -1 and minus infinity."""
    rows = hits.where(F.col("rank") <= width).groupBy(query).agg(F.sort_array(F.collect_list(F.struct("rank", item, "score"))).alias("_h"))
    fill = lambda x: F.array_repeat(F.lit(x), F.lit(width) - F.size("_h"))
    return rows.select(query, F.concat(F.transform("_h", lambda h: h[item]), fill(-1).cast("array<long>")).alias("items"), F.concat(F.transform("_h", lambda h: h["score"]), fill(float("-inf"))).alias("scores"))


def index_fingerprint(df: DataFrame, id_col: str, *parts: str) -> DataFrame:
    """Order-insensitive digest of an id set and a configuration: the number of ids and four sums of 32 bits of their
    digests, so that tasks send a few numbers."""
    piece = lambda i: F.conv(F.substring(F.md5(F.col(id_col).cast("string")), 8 * i + 1, 8), 16, 10).cast("decimal(20,0)")
    sums = df.agg(F.count(id_col).cast("string").alias("n"), *(F.coalesce(F.sum(piece(i)), F.lit(0).cast("decimal(30,0)")).cast("string").alias(f"s{i}") for i in range(4)))
    return sums.select(F.md5(F.concat_ws("|", *map(F.lit, parts), "n", "s0", "s1", "s2", "s3")).alias("fingerprint"))
