"""Rows that the driver's small tables lack: against the queries' own SQL, or against plain searches."""

import random

import duckdb
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from chartloom.functions import text
from chartloom.operators import fuzzy, segments, sparse, vectors
from chartloom.plans import catalog, columns  # noqa: F401
from tests.compare import same, tables


def folder(path, **selects):
    for name, sql in selects.items():
        duckdb.sql(f"COPY ({sql}) TO '{path}/{name}.parquet'")
    return str(path)


def same_as_sql(spark, d, name):
    same(catalog.QUERIES[name](spark, d), tables(d), catalog.SQL[name])


def test_customers_without_orders(spark, tmp_path):
    orders = "SELECT * FROM (VALUES (1::BIGINT, 1::BIGINT, 'O', '5-LOW'), (2, 1, 'F', '1-URGENT'), (3, 3, 'F', NULL)) t(o_orderkey, o_custkey, o_orderstatus, o_orderpriority)"
    same_as_sql(spark, folder(tmp_path, customer="SELECT range AS c_custkey FROM range(1, 5)", orders=orders), "caregiver_profile")


def test_orders_of_many_bytes(spark, tmp_path):
    """Keys from which the bytes pass each unit."""
    keys = "(0), (1), (2), (1048), (1049), (1073741), (1073742), (8999999), (1099511628)"
    orders = f"SELECT k::BIGINT AS o_orderkey, k % 15000 AS o_custkey, 'O' AS o_orderstatus, 1000.0 + k % 997 AS o_totalprice, '5-LOW' AS o_orderpriority FROM (VALUES {keys}) t(k)"
    same_as_sql(spark, folder(tmp_path, orders=orders), "text_columns")
    sizes = spark.createDataFrame([(1023,), (2**20,), (2**30,)], "n long").select(text.human_bytes(F.col("n")).alias("s"))
    assert [r["s"] for r in sizes.collect()] == ["1023 B", "1.00 MB", "1.00 GB"]


def test_copies_of_vectors_are_searched_for_once(spark, monkeypatch):
    """Many queries and items of few vectors: the blocks get each query vector once, and the k first items of each vector."""
    rng, met = random.Random(5), []
    rows = lambda n: [(i, [float(rng.randint(-2, 2)), float(rng.randint(-2, 2))]) for i in range(n)]
    q, x = rows(400), rows(300)
    whole = vectors.blocks_topk
    monkeypatch.setattr(vectors, "blocks_topk", lambda left, right, *rest: met.append((left.count(), right.count())) or whole(left, right, *rest))
    for same_id in (False, True):
        frames = spark.createDataFrame(q, "q_id long, v array<double>"), spark.createDataFrame(x, "x_id long, v array<double>")
        got = vectors.knn_join(*frames, 3, "q_id", "v", "x_id", "v", exclude_same=same_id)
        want = set()
        for i, a in q:
            best = sorted((-(a[0] * b[0] + a[1] * b[1]), j) for j, b in x if not (same_id and i == j))[:3]
            want |= {(i, j, -s + 0.0, r) for r, (s, j) in enumerate(best, 1)}
        assert {tuple(r) for r in got.collect()} == want and met[-1][0] <= 25 and met[-1][1] <= 25 * (3 + same_id)


def test_dense_names_need_no_blocks(spark, monkeypatch):
    """Numbered names share all but a few characters: each has many near ones, and no segment tells them apart."""
    names = [f"Customer#{i:09}" for i in range(700)] + [f"Customer#{i:09}" for i in range(5)] + ["Customer", "", "Supplier#000000001"]
    terms = list(enumerate(names))
    met, blocks = [], fuzzy._nearest_in_blocks
    monkeypatch.setattr(fuzzy, "_nearest_in_blocks", lambda left, *rest: met.append(left.count()) or blocks(left, *rest))
    asked = names[:700:20] + ["Customer#00000001", "Customer#0000000001", "Customer#00000000011"]
    for extra, left in (([], 0), (["something else"], 1)):
        del met[:]
        got = fuzzy.find_terms(spark.createDataFrame([(q,) for q in asked + extra], "q string"), "q", spark.createDataFrame(terms, "id long, title string"), "id", "title", 3, title_block=100)
        want = set()
        for q in asked + extra:
            best = sorted((-round(fuzzy.indel_ratio(fuzzy.processed(q), fuzzy.processed(t)), 6), i) for i, t in terms)[:3]
            want |= {(q, i, -s, r) for r, (s, i) in enumerate(best, 1)}
        assert {tuple(r) for r in got.collect()} == want and sum(met) == left


def test_blocks_of_names_meet_in_any_task(spark):
    """Every query meets every title, however many tasks the blocks are dealt to."""
    q, t = ([(f"{c}{i:03}",) for i in range(60)] for c in "qt")
    kept = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.shuffle.partitions")}
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        spark.conf.set("spark.sql.shuffle.partitions", "13")
        titles = spark.createDataFrame([(x, i) for i, (x,) in enumerate(t)], "t string, id int")
        got = fuzzy._nearest_in_blocks(spark.createDataFrame(q, "q string"), titles, 60, 7, 11).select("q", "t").distinct().count()
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)
    assert got == 3600


@pytest.mark.parametrize("rows", [1, 7])
def test_segments_are_handed_on_in_parts(spark, monkeypatch, rows):
    """Whatever number of segments a batch holds: the same segments, never more than so many at once; batches are held to so many bytes."""
    made, whole = [], segments.map_arrow
    monkeypatch.setattr(segments, "SEGMENT_ROWS", rows)
    monkeypatch.setattr(segments, "map_arrow", lambda df, run, schema: made.append(run) or whole(df, run, schema))
    kept = {k: spark.conf.get(f"spark.sql.execution.arrow.{k}") for k in ("maxRecordsPerBatch", "maxBytesPerBatch")}
    try:
        for k in kept:
            spark.conf.unset(f"spark.sql.execution.arrow.{k}")
        texts = [(i, None if i % 5 == 0 else "A one. B two. " * i) for i in range(12)]
        sized = segments.segment_table(spark.createDataFrame(texts, "id long, t string").coalesce(1), "id", "t", segments.by_pattern(r"\. ", 3))
        want = [(i, no, *s) for i, t in texts for no, s in enumerate(segments.by_pattern(r"\. ", 3)(t or ""), 1)]
        assert sorted(map(tuple, sized.collect())) == want
        handed = list(made[0]([pa.record_batch({"id": pa.array([i for i, _ in texts]), "t": pa.array([t for _, t in texts], pa.string())})]))
        assert max(b.num_rows for b in handed) <= rows and sum(b.num_rows for b in handed) == len(want)
        sparse.word_vectors(spark.createDataFrame(texts, "id long, t string"), "id", "t")
        assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= 1024
    finally:
        for k, v in kept.items():
            spark.conf.set(f"spark.sql.execution.arrow.{k}", v)


def test_batches_of_word_vectors_are_bounded(spark):
    kept = {k: spark.conf.get(f"spark.sql.execution.arrow.{k}") for k in ("maxRecordsPerBatch", "maxBytesPerBatch")}
    try:
        for k in kept:
            spark.conf.unset(f"spark.sql.execution.arrow.{k}")
        sparse.word_vectors(spark.createDataFrame([(1, "a b")], "id long, t string"), "id", "t")
        assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= 1024
    finally:
        for k, v in kept.items():
            spark.conf.set(f"spark.sql.execution.arrow.{k}", v)
