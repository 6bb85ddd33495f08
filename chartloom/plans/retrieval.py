"""Queries of the retrieval operators beside their SQL: blocks of queries, fused models, stored indexes, sets of vectors,
sparse vectors, fuzzy names, passages and overlaps; see ``catalog``."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import fuzzy, intervals, multivector, sparse, vector_index, vectors
from ..session import shared_folder, table
from .catalog import V, query

# ---- dense vectors -------------------------------------------------------------------------
RANKED = "SELECT q_id, x_id, score, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY score DESC, x_id) AS rank FROM s) WHERE rank <= "


@query(f"""WITH s AS (
  SELECT o_orderkey AS q_id, s_suppkey AS x_id, (floor(o_totalprice / 1000) - 250) * floor(s_acctbal / 1000) + (o_custkey % 25 - 12) * (s_nationkey - 12)::DOUBLE AS score FROM orders, supplier
) {RANKED} 3""")
def suppliers_for_orders(spark, d):
    """All orders against all suppliers in blocks: more queries than the tasks are sent."""
    q = table(spark, d, "orders").select(F.col("o_orderkey").alias("q_id"), F.array(F.floor(F.col("o_totalprice") / 1000) - 250, F.col("o_custkey") % 25 - 12).cast("array<double>").alias("qv"))
    x = table(spark, d, "supplier").select(F.col("s_suppkey").alias("x_id"), F.array(F.floor(F.col("s_acctbal") / 1000), F.col("s_nationkey") - 12).cast("array<double>").alias("v"))
    return vectors.knn(q, x, 3, "q_id", "qv", "x_id", "v")


HALF = "SELECT q.vec_id AS q_id, v.vec_id AS x_id, round(list_dot_product(q.e[{0}:{1}], v.e[{0}:{1}]), 6) AS score FROM v q, v WHERE q.vec_id % 20 = 0"


@query(f"""WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings), a AS ({HALF.format(1, 32)}), b AS ({HALF.format(33, 64)}),
h AS (SELECT q_id, x_id, row_number() OVER (PARTITION BY q_id ORDER BY score DESC, x_id) AS r FROM a UNION ALL SELECT q_id, x_id, row_number() OVER (PARTITION BY q_id ORDER BY score DESC, x_id) FROM b),
s AS (SELECT q_id, x_id, round(sum(1.0 / (60 + r)), 6) AS score FROM h WHERE r <= 20 GROUP BY 1, 2) {RANKED} 20""")
def prefetch_fused(spark, d):
    """Two models, the halves of the vectors, each with its own hits, fused by ranks."""
    e = table(spark, d, "embeddings")
    part = lambda at: (e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("q_id"), F.slice("embedding", at, 32).alias("v")), e.select(F.col("vec_id").alias("x_id"), F.slice("embedding", at, 32).alias("v")))
    return vectors.prefetch({"head": part(1), "tail": part(33)}, 20, merge=True)


@query(f"WITH {V} {RANKED} 10")
def stored_index_all_cells(spark, d):
    """A stored index, built once for these rows, looked through in all its cells."""
    e = table(spark, d, "embeddings")
    index = vector_index.ensure_index(e, "vec_id", "embedding", shared_folder(spark, "vector-index"), cells=32)
    return index.search(e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("q_id"), F.col("embedding").alias("qv")), 10, "q_id", "qv", probes=32)


@query()
def stored_index_near_cells(spark, d):
    """The same index, 24 of 32 cells for each query."""
    e = table(spark, d, "embeddings")
    index = vector_index.ensure_index(e, "vec_id", "embedding", shared_folder(spark, "vector-index"), cells=32)
    return index.search(e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("q_id"), F.col("embedding").alias("qv")), 10, "q_id", "qv", probes=24)


# ---- sets of vectors -------------------------------------------------------------------------
def vector_sets(spark, d):
    sets = table(spark, d, "embeddings").select(F.floor(F.col("vec_id") / 5).alias("x_id"), F.col("embedding").alias("v"))
    return sets.where("x_id % 20 = 0").withColumnRenamed("x_id", "q_id"), sets


@query(f"""WITH v AS (SELECT vec_id, vec_id // 5 AS x_id, embedding::DOUBLE[] AS e FROM embeddings),
m AS (SELECT q.x_id AS q_id, q.vec_id, v.x_id, max(list_dot_product(q.e, v.e)) AS best FROM v q, v WHERE q.x_id % 20 = 0 GROUP BY ALL),
s AS (SELECT q_id, x_id, round(sum(best), 6) AS score FROM m GROUP BY ALL) {RANKED} 10""")
def late_interaction(spark, d):
    q, x = vector_sets(spark, d)
    return multivector.max_sim(q, x, 10, "q_id", "v", "x_id", "v")


@query()
def late_interaction_pruned(spark, d):
    q, x = vector_sets(spark, d)
    return multivector.max_sim_pruned(q, x, 10, "q_id", "v", "x_id", "v")


# ---- sparse vectors -------------------------------------------------------------------------
@query(f"""WITH w AS (SELECT doc_id AS x_id, unnest(regexp_extract_all(text, '[A-Za-z]+')) AS term FROM documents), x AS (SELECT x_id, term, 1 + ln(count(*)) AS weight FROM w GROUP BY ALL),
u AS (SELECT item_id AS q_id, unnest(regexp_extract_all(text, '[A-Za-z]+')) AS term FROM benchmark), q AS (SELECT q_id, term, 1 + ln(count(*)) AS weight FROM u GROUP BY ALL),
n AS (SELECT count(DISTINCT x_id) AS n FROM x), i AS (SELECT term, ln(1 + (any_value(n) - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM x, n GROUP BY term),
s AS (SELECT q_id, x_id, round(sum(q.weight * idf * x.weight), 6) AS score FROM q JOIN i USING (term) JOIN x USING (term) GROUP BY ALL) {RANKED} 10""")
def sparse_words(spark, d):
    """Benchmark items against all documents by their words, with block maxima."""
    index = sparse.sparse_index(sparse.word_vectors(table(spark, d, "documents"), "doc_id", "text"), shared_folder(spark, "sparse-index"))
    found = sparse.sparse_search(index, sparse.word_vectors(table(spark, d, "benchmark"), "item_id", "text"), 10)
    return found.select(F.col("q").alias("q_id"), F.col("x").alias("x_id"), "score", "rank")


# ---- fuzzy names -------------------------------------------------------------------------
@query()
def fuzzy_names(spark, d):
    """Names that differ in a few characters: found by their segments."""
    c = table(spark, d, "customer")
    return fuzzy.find_terms(c.where("c_custkey % 20 = 0").select(F.col("c_name").alias("query")), "query", c, "c_custkey", "c_name", 3)


# ---- intervals and passages -------------------------------------------------------------------------
@query("""WITH t AS (SELECT event_id, user_id, event_type, date_diff('second', TIMESTAMP '2024-01-01', ts) AS s FROM events WHERE event_type IN ('click', 'error'))
SELECT a.user_id, a.event_id AS click, b.event_id AS error FROM t a JOIN t b ON a.user_id = b.user_id AND a.event_type = 'click' AND b.event_type = 'error' AND a.s < b.s + 900 AND b.s < a.s + 3600""")
def overlapping_events(spark, d):
    """Clicks' hours and errors' quarters of an hour that overlap, by user, swept in bins of a day."""
    e = table(spark, d, "events").select("user_id", "event_id", "event_type", F.expr("timestampdiff(SECOND, TIMESTAMP_NTZ '2024-01-01 00:00:00', ts)").alias("start"))
    kind = lambda name, long, key: e.where(F.col("event_type") == name).select("user_id", F.col("event_id").alias(key), "start", (F.col("start") + long).alias("end"))
    return intervals.overlap_pairs(kind("click", 3600, "click"), kind("error", 900, "error"), "user_id", "click", "error", width=86400)


@query("""SELECT doc_id, item_id, (i - 1)::INT AS start, (i - 1 + length(b.text))::INT AS "end" FROM documents d JOIN benchmark b ON contains(d.text, b.text), unnest(range(1, length(d.text) - length(b.text) + 2)) r(i)
WHERE substr(d.text, i, length(b.text)) = b.text""")
def passages_everywhere(spark, d):
    """Every place of every passage."""
    return intervals.passage_places(table(spark, d, "documents"), table(spark, d, "benchmark"), "doc_id", "text", "item_id", "text")
