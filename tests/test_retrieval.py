"""Blocks of vectors, stored indexes, sets of vectors and sparse vectors, against plain versions."""

import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from chartloom.operators import multivector, sparse, vector_index, vectors
from chartloom.plans import catalog, retrieval  # noqa: F401

DATA = "/root/testdata/sf0.001"


def points(spark, n, dim, name, seed, some_null=True):
    rng = random.Random(seed)
    rows = [(i, None if some_null and i % 17 == 5 else [float(rng.randint(-3, 3)) for _ in range(dim)]) for i in range(n)]
    return spark.createDataFrame(rows, f"{name} long, v array<double>"), {i: np.array(v) for i, v in rows if v is not None}


def nearest(q, x, k, skip_same=False):
    out = {}
    for i, a in q.items():
        best = sorted((-round(float(a @ b), 6), j) for j, b in x.items() if not (skip_same and i == j))[:k]
        out |= {(i, j): (-s + 0.0, r) for r, (s, j) in enumerate(best, 1)}
    return out


def hits(df):
    return {(r["q_id"], r["x_id"]): (r["score"], r["rank"]) for r in df.collect()}


@pytest.mark.parametrize("q_block, x_block", [(7, 11), (1000, 5), (3, 1000)])
def test_blocks_of_queries_and_items(spark, q_block, x_block):
    """Integers, so that scores tie; nulls on both sides; blocks of all shapes."""
    (q, a), (x, b) = points(spark, 60, 3, "q_id", 1), points(spark, 90, 3, "x_id", 2)
    got = vectors.knn_join(q, x, 5, "q_id", "v", "x_id", "v", exclude_same=True, query_block=q_block, item_block=x_block)
    assert hits(got) == nearest(a, b, 5, skip_same=True)


def test_more_queries_than_the_tasks_are_sent(spark, monkeypatch):
    (q, a), (x, b) = points(spark, 50, 4, "q_id", 3), points(spark, 40, 4, "x_id", 4)
    monkeypatch.setattr(vectors, "MAX_QUERY_ROWS", 10)
    assert hits(vectors.knn(q, x, 3, "q_id", "v", "x_id", "v")) == nearest(a, b, 3)


def test_nothing_to_find(spark):
    none = spark.createDataFrame([], "q_id long, v array<double>")
    some, _ = points(spark, 5, 3, "x_id", 1)
    assert vectors.knn_join(none, some, 3, "q_id", "v", "x_id", "v").count() == 0
    assert vectors.knn_join(some.withColumnRenamed("x_id", "q_id"), none.withColumnRenamed("q_id", "x_id"), 3, "q_id", "v", "x_id", "v").count() == 0


# ---- stored index -------------------------------------------------------------------------
def test_an_index_is_built_once(spark, tmp_path):
    home = f"file://{tmp_path}/index"
    x, b = points(spark, 300, 4, "x_id", 7)
    q, a = points(spark, 30, 4, "q_id", 8)
    index = vector_index.ensure_index(x, "x_id", "v", home, cells=9)
    assert sum(index.sizes.values()) == len(b) and len(index.sizes) <= 9
    stood = {f for _, _, files in os.walk(tmp_path) for f in files}
    again = vector_index.ensure_index(x.repartition(5).orderBy(F.desc("x_id")), "x_id", "v", home, cells=9)
    assert again.folder == index.folder and stood == {f for _, _, files in os.walk(tmp_path) for f in files}
    assert hits(again.search(q, 5, "q_id", "v", probes=9)) == nearest(a, b, 5)
    assert hits(again.search(q, 5, "q_id", "v", probes=99)) == nearest(a, b, 5)
    near = hits(again.search(q, 5, "q_id", "v", probes=2))
    assert all(near[p][0] == round(float(a[p[0]] @ b[p[1]]), 6) for p in near)
    other = x.withColumn("v", F.when(F.col("x_id") == 3, F.array(*map(F.lit, (9.0, 9.0, 9.0, 9.0)))).otherwise(F.col("v")))
    assert vector_index.ensure_index(other, "x_id", "v", home, cells=9).fingerprint != index.fingerprint
    assert vector_index.ensure_index(x, "x_id", "v", home, cells=8).folder != index.folder


def test_a_killed_build_is_not_used(spark, tmp_path, monkeypatch):
    """Vectors that were written without a manifest are no index."""
    home = f"file://{tmp_path}/index"
    x, b = points(spark, 50, 3, "x_id", 9)
    stop = lambda *a, **k: (_ for _ in ()).throw(RuntimeError("killed"))
    with monkeypatch.context() as m, pytest.raises(RuntimeError):
        m.setattr(F, "current_timestamp", stop)
        vector_index.ensure_index(x, "x_id", "v", home, cells=4)
    index = vector_index.ensure_index(x, "x_id", "v", home, cells=4)
    assert hits(index.search(x.withColumnRenamed("x_id", "q_id"), 2, "q_id", "v", probes=4)) == nearest(b, b, 2)


def test_an_index_of_nothing(spark, tmp_path):
    none = spark.createDataFrame([], "x_id long, v array<double>")
    index = vector_index.ensure_index(none, "x_id", "v", f"file://{tmp_path}/index", cells=4)
    q, _ = points(spark, 5, 3, "q_id", 1)
    assert index.sizes == {} and index.search(q, 3, "q_id", "v", probes=4).count() == 0


def test_crowded_cells_are_split(spark, tmp_path, monkeypatch):
    """A third of the rows are one vector: their cell meets its queries in many blocks."""
    monkeypatch.setattr(vector_index, "ITEM_BLOCK", 13)
    monkeypatch.setattr(vector_index, "QUERY_BLOCK", 4)
    x, b = points(spark, 120, 3, "x_id", 11, some_null=False)
    x = x.withColumn("v", F.when(F.col("x_id") % 3 == 0, F.array(F.lit(1.0), F.lit(1.0), F.lit(1.0))).otherwise(F.col("v")))
    b = {i: np.ones(3) if i % 3 == 0 else v for i, v in b.items()}
    index = vector_index.ensure_index(x, "x_id", "v", f"file://{tmp_path}/index", cells=5)
    assert hits(index.search(x.withColumnRenamed("x_id", "q_id"), 6, "q_id", "v", probes=5)) == nearest(b, b, 6)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no driver tables")
def test_recall_by_cells(spark):
    exact = hits(catalog.QUERIES["knn_exact"](spark, DATA))
    near = hits(catalog.QUERIES["stored_index_near_cells"](spark, DATA))
    assert len(near.keys() & exact.keys()) >= 0.9 * len(exact)


# ---- sets of vectors -------------------------------------------------------------------------
def plain_max_sim(q, x, k):
    out = {}
    for s in {s for s, _ in q}:
        own = [v for t, v in q if t == s]
        best = sorted((-round(sum(max(float(a @ b) for t, b in x if t == item) for a in own), 6), item) for item in {t for t, _ in x})[:k]
        out |= {(s, i): (-n + 0.0, r) for r, (n, i) in enumerate(best, 1)}
    return out


def sets(spark, n, most, name, seed):
    rng = random.Random(seed)
    rows = [(i, [float(rng.randint(-4, 4)) for _ in range(5)]) for i in range(n) for _ in range(rng.randint(1, most))]
    rows += [rows[0]] * 2
    df = spark.createDataFrame([*rows, (n + 1, None), (None, [1.0] * 5)], f"{name} long, v array<double>")
    return df.repartition(3), [(i, np.array(v)) for i, v in rows]


@pytest.mark.parametrize("q_block, x_block, large", [(2048, 32768, 16384), (5, 9, 16384), (5, 9, 3), (4, 1000, 1)])
def test_late_interaction(spark, q_block, x_block, large):
    """Repeated vectors, sets of one vector, null vectors and ids, sets that are split over tasks."""
    (q, a), (x, b) = sets(spark, 12, 5, "q_id", 5), sets(spark, 30, 7, "x_id", 6)
    got = multivector.max_sim(q, x, 4, "q_id", "v", "x_id", "v", query_block=q_block, item_block=x_block, large=large)
    assert hits(got) == plain_max_sim(a, b, 4)


def test_late_interaction_of_nothing(spark):
    (q, _), none = sets(spark, 3, 2, "q_id", 5), spark.createDataFrame([], "x_id long, v array<double>")
    assert multivector.max_sim(q, none, 4, "q_id", "v", "x_id", "v").count() == 0
    with pytest.raises(ValueError):
        multivector.max_sim(spark.range(5000).selectExpr("1L AS q_id", "array(1.0D, cast(id as double)) AS v"), none, 4, "q_id", "v", "x_id", "v")


def test_pruned_late_interaction(spark, monkeypatch):
    """Looked through whole it is exact; scores of what it finds are exact; large sets are scored too."""
    (q, a), (x, b) = sets(spark, 12, 5, "q_id", 5), sets(spark, 30, 7, "x_id", 6)
    exact = plain_max_sim(a, b, 4)
    assert hits(multivector.max_sim_pruned(q, x, 4, "q_id", "v", "x_id", "v", cells=4, probes=4, depth=1000, rerank=1000)) == exact
    monkeypatch.setattr(multivector, "LARGE_SET", 3)
    assert hits(multivector.max_sim_pruned(q, x, 4, "q_id", "v", "x_id", "v", cells=4, probes=4, depth=1000, rerank=1000)) == exact


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no driver tables")
def test_recall_of_pruned_late_interaction(spark):
    exact, near = (hits(catalog.QUERIES[n](spark, DATA)) for n in ("late_interaction", "late_interaction_pruned"))
    assert len(near.keys() & exact.keys()) >= 0.9 * len(exact) and all(near[p][0] == exact[p][0] for p in near.keys() & exact.keys())


# ---- sparse vectors -------------------------------------------------------------------------
def plain_sparse(items, queries, k):
    n, df = len({i for i, _, _ in items}), {}
    for i, t, _ in items:
        df.setdefault(t, set()).add(i)
    out = {}
    for q in {q for q, _, _ in queries}:
        score = {}
        for _, t, w in (r for r in queries if r[0] == q):
            for i, u, v in items:
                if u == t:
                    score[i] = score.get(i, 0) + w * v * np.log(1 + (n - len(df[t]) + 0.5) / (len(df[t]) + 0.5))
        best = sorted((-round(s, 6), i) for i, s in score.items())[:k]
        out |= {(q, i): (pytest.approx(-s, abs=2e-6), r) for r, (s, i) in enumerate(best, 1)}
    return out


@pytest.mark.parametrize("block, most", [(1, 10**6), (4, 10**6), (1000, 10**6), (4, 0), (1000, 0)])
def test_sparse_search(spark, tmp_path, block, most):
    """In the tasks and by joins; repeated and null terms, weights that do not count, unknown terms, empty vectors."""
    rng = random.Random(block)
    vec = lambda n, m: {i: [(f"t{int(rng.paretovariate(0.7)) % 25}", rng.choice([0.5, 1.0, 2.5, 9.0]) * (1 + i % 7)) for _ in range(rng.randint(1, m))] for i in range(n)}
    items, queries = vec(80, 9), vec(20, 6)
    odd = [(None, ["t1"], [1.0]), (900, [], []), (901, None, None), (902, [None, "t1"], [1.0, 0.0]), (903, ["t2"], [-3.0])]
    rows = lambda vs: [(i, [t for t, _ in v] + [None, "t3"], [w for _, w in v] + [1.0, -1.0]) for i, v in vs.items()] + odd
    df = lambda r: spark.createDataFrame(r, sparse.VECTOR).repartition(3)
    long = lambda vs: [(i, t, w) for i, v in vs.items() for t, w in v]
    index = sparse.sparse_index(df(rows(items)), f"file://{tmp_path}/sparse", block)
    assert index.n == 80
    found = sparse.sparse_search(index, df([*rows(queries), (999, ["nowhere"], [1.0])]), 5, most=most)
    assert {(r["q"], r["x"]): (r["score"], r["rank"]) for r in found.collect()} == plain_sparse(long(items), long(queries), 5)
    assert sparse.sparse_search(sparse.sparse_index(df([]), f"file://{tmp_path}/none"), df(rows(queries)), 5, most=most).count() == 0
    assert sparse.sparse_search(index, df([]), 5, most=most).count() == 0


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no driver tables")
def test_blocks_below_the_floor_are_not_read(spark, tmp_path):
    tables = [spark.read.parquet(f"{DATA.replace('0.001', '0.01')}/{n}.parquet") for n in ("documents", "benchmark")]
    index = sparse.sparse_index(sparse.word_vectors(tables[0], "doc_id", "text"), f"file://{tmp_path}/sparse")
    queries = sparse.word_vectors(tables[1], "item_id", "text")
    every = sparse.sparse_hits(index, queries, 10, prune=False).agg(F.sum("read")).first()[0]
    assert sparse.sparse_hits(index, queries, 10).agg(F.sum("read")).first()[0] < 0.7 * every
    assert sparse.sparse_hits(index, queries, 10, most=0).agg(F.sum("read")).first()[0] < 0.7 * every
    same = [sorted(map(tuple, sparse.sparse_search(index, queries, 10, **o).collect())) for o in ({}, {"prune": False}, {"most": 0}, {"most": 0, "prune": False})]
    assert all(s == same[0] for s in same)
