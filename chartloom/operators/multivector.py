"""Late interaction: items and queries that are sets of vectors, scored by the sum of each query vector's best match.

The score of a query set and an item set is the sum, over the query's vectors, of the greatest dot product with any of the item's.
Sets are dealt whole into blocks that meet pair by pair in one shuffle; a block of both sides fits a task, and no
row is made for a pair of vectors. An item of more than LARGE_SET vectors is split over tasks, which give the best match
of each query vector in their share. Vectors that are null are left out, as are sets without any; sets are told apart by their id alone. Empty tables give no
rows. Query sets have at most MAX_QUERY_SET vectors (more raise an error, they are not cut).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .vector_index import cells_topk, fit_cells, with_cells
from .vectors import ITEM_BLOCK, ITEM_SLICE, QUERY_BLOCK, _hits_schema, _matrix, _ranked

MAX_QUERY_SET, LARGE_SET = 4096, 16384
#: Candidates of a query set that one task scores.
RERANK_SHARE = 32


def _by_set(table: pa.Table, key: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(set ids, first row of each, vectors) with rows in the order of the sets."""
    ids = table.column(key).to_numpy()
    order = np.argsort(ids, kind="stable")
    kinds, first = np.unique(ids[order], return_index=True)
    return kinds, first, _matrix(table.column("v"))[order]


def _scores(q_first: np.ndarray, q: np.ndarray, x_first: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Sums by query set and item; items go in slices of about ITEM_SLICE vectors, whole items each."""
    out, at, ends = [], 0, np.append(x_first[1:], len(x))
    while at < len(x_first):
        to = max(at + 1, int(np.searchsorted(ends, x_first[at] + ITEM_SLICE, side="right")))
        lo, hi = x_first[at], ends[to - 1]
        best = np.maximum.reduceat(q @ x[lo:hi].T, x_first[at:to] - lo, axis=1)
        out.append(np.add.reduceat(best, q_first, axis=0))
        at = to
    return np.concatenate(out, axis=1)


def _every(n: int):
    return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))


def _dealt(key: str, n: int, *more: str):
    return F.pmod(F.xxhash64(key, *more), F.lit(n)).cast("int")


def max_sim(queries: DataFrame, items: DataFrame, k: int, query_id: str, query_vec: str, item_id: str, item_vec: str, digits: int = 6, query_block: int = QUERY_BLOCK, item_block: int = ITEM_BLOCK, large: int = LARGE_SET) -> DataFrame:
    """query_id, item_id, score, rank of the k best item sets for each query set (rounded, ties by item).

    Both tables have a row for each vector of a set.
    """
    q = queries.select(F.col(query_id).cast("long").alias("q"), F.col(query_vec).alias("v")).where("v is not null and q is not null")
    x = items.select(F.col(item_id).cast("long").alias("x"), F.col(item_vec).alias("v")).where("v is not null and x is not null")
    sizes = q.groupBy("q").agg(F.count("*").alias("n"))
    n_queries, widest = sizes.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max("n"), F.lit(0))).first()
    if widest > MAX_QUERY_SET:
        raise ValueError(f"a query set has more than {MAX_QUERY_SET} vectors")
    counts = x.groupBy("x").agg(F.count("*").alias("n"))
    n_items, n_large = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.when(F.col("n") > large, 1))).first()
    rows, cols = max(1, -(-n_queries // query_block)), max(1, -(-n_items // item_block))
    schema = T.StructType([T.StructField(query_id, T.LongType()), T.StructField(item_id, T.LongType()), T.StructField("score", T.DoubleType())])

    def score(_, left, right):
        if not left.num_rows or not right.num_rows:
            return pa.Table.from_pylist([], schema=pa.schema([(query_id, pa.int64()), (item_id, pa.int64()), ("score", pa.float64())]))
        sets, q_first, qv = _by_set(left, "q")
        kinds, x_first, xv = _by_set(right, "x")
        total = np.round(_scores(q_first, qv, x_first, xv), digits) + 0.0
        least = np.full(len(sets), -np.inf)
        if len(kinds) > k:
            least = np.partition(total, len(kinds) - k, axis=1)[:, len(kinds) - k]
        at, item = np.nonzero(total >= least[:, None])
        s = total[at, item]
        order = np.lexsort((kinds[item], -s, at))
        at, item, s = at[order], item[order], s[order]
        first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
        keep = np.arange(at.size) - np.repeat(first, np.diff(np.append(first, at.size))) < k
        return pa.table({query_id: pa.array(sets[at[keep]]), item_id: pa.array(kinds[item[keep]]), "score": pa.array(s[keep])})

    left = q.withColumn("row", _dealt("q", rows)).withColumn("col", _every(cols))
    if n_large:  # at most one of LARGE_SET vectors' items
        big = F.broadcast(counts.where(F.col("n") > large).select("x"))
        few, x = x.join(big, "x", "left_semi"), x.join(big, "x", "left_anti")
    right = x.withColumn("col", _dealt("x", cols)).withColumn("row", _every(rows))
    found = left.groupBy("row", "col").cogroup(right.groupBy("row", "col")).applyInArrow(score, schema)
    if n_large:
        found = found.unionByName(_large_sets(q, few, rows, cols, query_id, item_id, digits))
    return _ranked(found, query_id, item_id, k)


def _large_sets(q: DataFrame, items: DataFrame, rows: int, cols: int, query_id: str, item_id: str, digits: int) -> DataFrame:
    """All scores of items whose vectors are split over tasks: the best match of a query vector in each share, then of all, then sums."""
    marked = q.withColumn("no", F.xxhash64("q", "v"))
    n_same = marked.groupBy("q", "no").agg(F.count("*").alias("n"), F.first("v").alias("v"))  # equal vectors of a set count each
    left = n_same.withColumn("row", _dealt("q", rows)).withColumn("col", _every(cols))
    right = items.withColumn("col", _dealt("x", cols, "v")).withColumn("row", _every(rows))
    kinds = [("q", pa.int64()), ("no", pa.int64()), ("n", pa.int64()), ("x", pa.int64()), ("best", pa.float64())]

    def best(_, a, b):
        if not a.num_rows or not b.num_rows:
            return pa.Table.from_pylist([], schema=pa.schema(kinds))
        ids, first, xv = _by_set(b, "x")
        qv, out = _matrix(a.column("v")), []
        for i, lo in enumerate(first):
            hi = first[i + 1] if i + 1 < len(first) else len(xv)
            out.append(np.max([(qv @ xv[s : min(hi, s + ITEM_SLICE)].T).max(axis=1) for s in range(lo, hi, ITEM_SLICE)], axis=0))
        n = len(ids)
        rep = lambda c: pa.array(np.tile(a.column(c).to_numpy(), n))
        return pa.table({"q": rep("q"), "no": rep("no"), "n": rep("n"), "x": pa.array(np.repeat(ids, a.num_rows)), "best": pa.array(np.concatenate(out))})

    parts = left.groupBy("row", "col").cogroup(right.groupBy("row", "col")).applyInArrow(best, "q long, no long, n long, x long, best double")
    whole = parts.groupBy("q", "no", "n", "x").agg(F.max("best").alias("best")).groupBy("q", "x").agg(F.sum(F.col("n") * F.col("best")).alias("s"))
    return whole.select(F.col("q").alias(query_id), F.col("x").alias(item_id), F.round("s", digits).alias("score"))


def max_sim_pruned(queries: DataFrame, items: DataFrame, k: int, query_id: str, query_vec: str, item_id: str, item_vec: str, cells: int = 32, probes: int = 16, depth: int = 200, rerank: int = 100, seed: int = 0, digits: int = 6) -> DataFrame:
    """As ``max_sim``, from candidates: the items of the best vectors in the ``probes`` cells next to each query vector.

    Cells are k-means cells fitted on a bounded sample; all vectors lie in one. A query vector's ``depth`` best vectors in its
    cells give an estimate for their items: the sum of what each of the query's vectors gains over the least of its own best. The ``rerank``
    best of a query set are then scored exactly. Approximate by design; a cell of any size is looked through whole.
    """
    q = queries.select(F.col(query_id).cast("long").alias("q"), F.col(query_vec).cast("array<double>").alias("v")).where("v is not null and q is not null")
    x = items.select(F.col(item_id).cast("long").alias("x"), F.col(item_vec).cast("array<double>").alias("v")).where("v is not null and x is not null")
    centres = fit_cells(x, "x", "v", cells, seed)
    held = with_cells(x, "v", centres)
    sizes = {r["cell"]: r["n"] for r in held.groupBy("cell").agg(F.count("*").alias("n")).collect()}  # at most MAX_CELLS
    # equal vectors of queries are one look
    looks = with_cells(q.select("v").distinct(), "v", centres, probes).withColumn("q", F.xxhash64("v"))
    near = _ranked(cells_topk(looks, held, sizes, depth, _hits_schema("no", "x"), digits=digits), "no", "x", depth)
    gains = near.groupBy("no", "x").agg(F.max("score").alias("best")).withColumn("gain", F.col("best") - F.min("best").over(Window.partitionBy("no")))
    met = q.select("q", F.xxhash64("v").alias("no")).join(gains, "no").groupBy("q", "x").agg(F.sum("gain").alias("score"))
    best = _ranked(met, "q", "x", rerank).select("q", "x")
    # exact scores of the candidates, whose vectors go to their query sets in shares of about RERANK_SHARE items
    kinds = pa.schema([(query_id, pa.int64()), (item_id, pa.int64()), ("score", pa.float64())])
    counts = x.groupBy("x").agg(F.count("*").alias("n")).join(best.select("x").distinct(), "x", "left_semi")
    big = counts.where(F.col("n") > LARGE_SET).select("x")
    pairs = x.join(best.join(big, "x", "left_anti"), "x").withColumnRenamed("q", "set")
    shares = -(-rerank // RERANK_SHARE)

    def score(_, left, right):
        if not left.num_rows or not right.num_rows:
            return pa.Table.from_pylist([], schema=kinds)
        sets, q_first, qv = _by_set(left, "q")
        ids, x_first, xv = _by_set(right, "x")
        total = np.round(_scores(q_first, qv, x_first, xv), digits)[0] + 0.0
        return pa.table({query_id: pa.array(np.full(len(ids), sets[0])), item_id: pa.array(ids), "score": pa.array(total)})

    left = q.withColumn("set", F.col("q")).withColumn("share", _every(shares)).groupBy("set", "share")
    right = pairs.withColumn("share", _dealt("x", shares)).groupBy("set", "share")
    exact = left.cogroup(right).applyInArrow(score, T.StructType([T.StructField(query_id, T.LongType()), T.StructField(item_id, T.LongType()), T.StructField("score", T.DoubleType())]))
    if big.limit(1).count():
        few = best.join(big, "x").select(F.col("q").alias(query_id), F.col("x").alias(item_id))
        cols = -(-x.join(big, "x", "left_semi").count() // ITEM_BLOCK)
        exact = exact.unionByName(_large_sets(q, x.join(big, "x", "left_semi"), -(-q.count() // QUERY_BLOCK), cols, query_id, item_id, digits).join(few, [query_id, item_id], "left_semi"))
    return _ranked(exact, query_id, item_id, k)
