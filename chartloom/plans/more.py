"""More queries beside their SQL: dictionaries, label lists, samplers, hierarchies and vectors; see ``catalog``."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import codes, lists
from ..operators import cohort, hierarchy, intervals, lookups, metrics, sampling, vectors
from ..session import table
from .catalog import ADM, LABELS, LISTS, TOP, TREE, V, admissions, code_list_table, code_of, joined, nearest, paired, predictions, query, targets, tree


# ---- dictionaries, filters and statistics --------------------------------------------------
@query("SELECT p_brand, arg_max(p_type, (p_partkey, p_type)) AS p_type FROM part GROUP BY p_brand")
def last_write_dictionary(spark, d):
    return cohort.dictionary(table(spark, d, "part"), "p_brand", "p_type", "p_partkey")


@query(f"WITH {ADM}, c AS (SELECT DISTINCT code_type AS split, code FROM adm) SELECT split, length(replace(code, '.', ''))::INT AS length, count(*) AS n FROM c GROUP BY 1, 2")
def code_length_histogram(spark, d):
    return cohort.length_histogram(admissions(spark, d).withColumnRenamed("code_type", "split"), "split", "code")


@query(f"WITH {LABELS}, r AS (SELECT hadm_id, count(t.class) AS size FROM (SELECT DISTINCT hadm_id FROM adm) a LEFT JOIN t ON t.row_id = a.hadm_id AND t.class < 'P00020' GROUP BY 1) SELECT size::INT AS size, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 6) AS percent FROM r GROUP BY size")
def class_balance(spark, d):
    few = targets(spark, d).where("class < 'P00020'").groupBy("row_id").agg(F.collect_list("class").alias("targets"))
    rows = admissions(spark, d).select(F.col("hadm_id").alias("row_id")).distinct().join(few, "row_id", "left")
    return metrics.class_balance(rows, "targets").withColumn("percent", F.round("percent", 6))


@query("SELECT CASE WHEN o_orderkey % 10 = 0 THEN 'test' WHEN o_orderkey % 10 = 1 THEN 'validation' ELSE 'train' END AS split, count(*) AS n FROM orders GROUP BY 1")
def split_sizes(spark, d):
    k = F.col("o_orderkey") % 10
    parts = [table(spark, d, "orders").where(test).withColumn("split", F.lit(name)) for name, test in (("test", k == 0), ("validation", k == 1), ("train", k > 1))]
    return cohort.combine({"held": parts[:2], "seen": (parts[2],)}).groupBy("split").agg(F.count("*").alias("n"))


@query("SELECT p_partkey FROM part WHERE starts_with(p_brand, 'Brand#1') OR starts_with(p_brand, 'Brand#4') OR contains(lower(p_type), 'tin')")
def prefix_keyword_filter(spark, d):
    part = table(spark, d, "part")
    return part.where(lists.any_prefix(F.array("p_brand"), ["Brand#1", "Brand#4"]) | lists.any_keyword(F.col("p_type"), ["tin"])).select("p_partkey")


@query("SELECT l_orderkey, l_linenumber, CASE l_returnflag WHEN 'A' THEN 'accepted' WHEN 'R' THEN 'returned' ELSE l_returnflag END AS kind, CASE WHEN l_quantity > 25 THEN l_quantity / 1000.0 ELSE l_quantity END::DOUBLE AS quantity FROM lineitem")
def relabel_and_rescale(spark, d):
    q = F.col("l_quantity").cast("double")
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", lists.relabel(F.col("l_returnflag"), {"A": "accepted", "R": "returned"}).alias("kind"), lists.rescaled(q, 25.0).alias("quantity"))


@query("SELECT vec_id, round(list_sum(list_transform(list_zip(embedding, range(len(embedding))), lambda z: CASE WHEN z[2] % 3 = 0 THEN 1 / (1 + exp(-z[1]::DOUBLE)) ELSE 0 END)), 5) AS total FROM embeddings")
def masked_sigmoid(spark, d):
    mask = F.transform("embedding", lambda x, i: (i % 3 == 0).cast("int"))
    p = lists.masked_sigmoid(F.transform("embedding", lambda x: x.cast("double")), mask)
    return table(spark, d, "embeddings").select("vec_id", F.round(F.aggregate(p, F.lit(0.0), lambda a, x: a + x), 5).alias("total"))


ROWS = ", ".join(f"sum(('0x' || substr(h, {8 * i + 1}, 8))::BIGINT)::VARCHAR AS s{i}" for i in range(4))


@query(f"""WITH h AS (SELECT md5('{{"c_custkey":' || c_custkey || ',"c_name":"' || c_name || '"}}') AS h FROM customer), p AS (SELECT count(*) AS n, {ROWS} FROM h)
SELECT n, md5(s0 || '|' || s1 || '|' || s2 || '|' || s3) AS digest FROM p""")
def row_set_digest(spark, d):
    return cohort.row_set_digest(table(spark, d, "customer"), "c_custkey", "c_name")


# ---- lists ----------------------------------------------------------------------------------
@query(f"""WITH {LISTS}, k AS (SELECT hadm_id, list_filter(codes, lambda c: c IN ({', '.join(f"'{c}'" for c in TOP)})) AS kept FROM lists)
SELECT hadm_id, array_to_string(kept, ',') AS codes, CASE WHEN len(kept) > 0 THEN array_to_string(list_transform(kept, lambda c: lower(c)), ',') END AS spans FROM k""")
def aligned_filter(spark, d):
    rows = code_list_table(spark, d).withColumn("spans", F.transform("codes", F.lower))
    kept, spans = lists.aligned_filter(F.col("codes"), F.col("spans"), F.array(*map(F.lit, TOP)))
    return rows.select("hadm_id", joined(kept).alias("codes"), joined(spans).alias("spans"))


@query(f"""WITH {LISTS}, c AS (SELECT hadm_id, codes, unnest(range(0, len(codes) + 1)) AS i FROM lists)
SELECT hadm_id, i // 4 AS chunk, string_agg(coalesce(codes[i + 1], 'pad'), ',' ORDER BY i) || repeat(',pad', (3 - max(i) % 4)::INT) AS codes FROM c GROUP BY hadm_id, i // 4""")
def padded_chunks(spark, d):
    pad = lists.padded_chunks(F.col("codes"), 4, "pad")
    return code_list_table(spark, d).select("hadm_id", F.posexplode(pad).alias("chunk", "c")).select("hadm_id", F.col("chunk").cast("bigint").alias("chunk"), joined("c").alias("codes"))


@query("""WITH e AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x, unnest(range(len(embedding))) AS i FROM embeddings), r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY x DESC, i) AS place FROM e)
SELECT vec_id, string_agg(i::VARCHAR, ',' ORDER BY place) AS best, round(sum(x), 5) AS total FROM r WHERE place <= 5 GROUP BY vec_id""")
def top_k_labels(spark, d):
    best = lists.top_k_scores(F.transform("embedding", lambda x: x.cast("double")), 5)
    got = table(spark, d, "embeddings").select("vec_id", best.alias("b"))
    return got.select("vec_id", joined(F.transform("b", lambda p: p["index"].cast("string"))).alias("best"), F.round(F.aggregate("b", F.lit(0.0), lambda a, p: a + p["score"]), 5).alias("total"))


@query("SELECT p_partkey, p_size < 26 AS empty FROM part")
def empty_lists(spark, d):
    part = table(spark, d, "part")
    return part.select("p_partkey", lists.all_empty(F.when(F.col("p_size") > 25, F.array("p_brand")), F.array().cast("array<string>")).alias("empty"))


@query(f"""WITH {LISTS}, k AS (SELECT 'P' || lpad(p_partkey::VARCHAR, 5, '0') AS code FROM part WHERE p_size > 25), e AS (SELECT hadm_id, unnest(codes) AS code FROM lists)
SELECT lists.hadm_id, coalesce(string_agg(e.code, ',' ORDER BY e.code), '') AS codes FROM lists LEFT JOIN (SELECT * FROM e WHERE code IN (SELECT code FROM k)) e ON e.hadm_id = lists.hadm_id GROUP BY lists.hadm_id""")
def filter_known_targets(spark, d):
    known = table(spark, d, "part").where("p_size > 25").select(code_of("p_partkey").alias("code"))
    rows, _ = cohort.filter_known_targets(code_list_table(spark, d), "hadm_id", "codes", known)
    return rows.select("hadm_id", joined("codes").alias("codes"))


@query(f"WITH {ADM} SELECT code, count(DISTINCT hadm_id) AS n FROM adm WHERE code NOT IN (SELECT 'P' || lpad(p_partkey::VARCHAR, 5, '0') FROM part WHERE p_size > 25) GROUP BY code")
def dropped_targets(spark, d):
    known = table(spark, d, "part").where("p_size > 25").select(code_of("p_partkey").alias("code"))
    return cohort.filter_known_targets(code_list_table(spark, d), "hadm_id", "codes", known)[1]


@query("SELECT c_custkey AS \"key\", c_nationkey AS \"place.nation\", n_name AS \"place.name.long\" FROM customer JOIN nation ON n_nationkey = c_nationkey")
def flattened(spark, d):
    j = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("n_nationkey") == F.col("c_nationkey"))
    nested = j.select(F.col("c_custkey").alias("key"), F.struct(F.col("c_nationkey").alias("nation"), F.struct(F.col("n_name").alias("long")).alias("name")).alias("place"))
    return cohort.flatten(nested)


@query(f"""WITH {LISTS}, e AS (SELECT hadm_id, unnest(codes) AS code, unnest(range(len(codes))) AS pos FROM lists), j AS (SELECT hadm_id, pos, p_brand, p_type FROM e JOIN part ON 'P' || lpad(p_partkey::VARCHAR, 5, '0') = code)
SELECT hadm_id, p_brand, min(pos)::INT AS pos, arg_min(p_type, pos) AS p_type FROM j GROUP BY hadm_id, p_brand""")
def first_by_code(spark, d):
    terms = table(spark, d, "part").select(code_of("p_partkey").alias("term"), "p_brand", "p_type", "p_partkey")
    return lookups.first_by_code(code_list_table(spark, d), "hadm_id", "codes", terms, "term", "p_brand", order="p_partkey").select("hadm_id", "p_brand", "pos", "p_type")


# ---- metrics ----------------------------------------------------------------------------------
@query(f"WITH {LABELS}, s AS (SELECT sum(t * p) AS tp, sum(p) AS np, sum(t) AS nt FROM j WHERE class IN (SELECT class FROM t)) SELECT round(tp / np, 6) AS \"precision\", round(tp / nt, 6) AS recall FROM s")
def seen_classes_scores(spark, d):
    return metrics.seen_classes_scores(targets(spark, d), predictions(spark, d)).select(F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"))


@query(f"WITH {LABELS} SELECT class, (tp + fn)::BIGINT AS freq, tp::BIGINT AS tp, fp::BIGINT AS fp, fn::BIGINT AS fn, round(2 * tp / (2 * tp + fp + fn), 5) AS f1 FROM conf")
def class_table(spark, d):
    return metrics.class_table(metrics.confusion(targets(spark, d), predictions(spark, d), 0)).withColumn("f1", F.round("f1", 5))


@query(f"""WITH {LISTS} SELECT hadm_id AS row_id, unnest(list_distinct(list_filter([codes[1], codes[2], codes[len(codes)]], lambda c: c IS NOT NULL))) AS class FROM lists""")
def listed_labels(spark, d):
    ids = F.concat_ws(",", F.lit("1, 2"), F.size("codes").cast("string"), F.lit("0"), F.lit("x"), F.lit("99"))
    return metrics.listed_labels(code_list_table(spark, d).select(F.col("hadm_id").alias("row_id"), "codes", ids.alias("ids")), "row_id", "ids", "codes")


@query(f"""WITH {LABELS}, x AS (SELECT row_id, class, row_number() OVER (PARTITION BY row_id ORDER BY class) - 1 AS pos FROM p)
SELECT x.row_id, pos::INT AS pos, round(1.0 / (1 + pos), 6)::DOUBLE AS prob, t.class IS NOT NULL AS correct FROM x LEFT JOIN t ON t.row_id = x.row_id AND t.class = x.class""")
def probabilities_by_outcome(spark, d):
    rows = paired(spark, d).withColumn("probs", F.transform("pred", lambda _, i: F.round(1.0 / (1 + i), 6)))
    return metrics.split_by_outcome(rows, "row_id", "probs", "pred", "gold")


@query(f"""WITH {LABELS}, r AS (SELECT DISTINCT row_id FROM j) SELECT r.row_id, coalesce(string_agg(class, ',' ORDER BY class), '0') AS labels FROM r LEFT JOIN (SELECT * FROM t WHERE class < 'P00020') t ON t.row_id = r.row_id GROUP BY r.row_id""")
def labels_to_lists(spark, d):
    rows = targets(spark, d).select("row_id").union(predictions(spark, d).select("row_id"))
    return metrics.labels_to_lists(targets(spark, d).where("class < 'P00020'"), rows, "row_id").select("row_id", joined("labels").alias("labels"))


@query(f"WITH {LABELS} SELECT row_id, round(sum(CASE WHEN t = 1 AND p = 1 THEN -ln(1 - 1e-7) WHEN t = 1 THEN -ln(1e-7) ELSE 0 END), 5) AS loss FROM j GROUP BY row_id")
def cross_entropy(spark, d):
    return paired(spark, d).select("row_id", F.round(metrics.cross_entropy(F.col("pred"), F.col("gold")), 5).alias("loss"))


# ---- samplers -----------------------------------------------------------------------------------
U = "(('0x' || substr(md5('{seed}|' || {key}), 1, 8))::BIGINT + 0.5) / 4294967296.0"


@query(f"SELECT doc_id FROM documents WHERE {U.format(seed=0, key='doc_id')} < 0.1")
def fraction_sample(spark, d):
    return sampling.fraction(table(spark, d, "documents"), "doc_id", 0.1).select("doc_id")


@query(f"""WITH l AS (SELECT l_orderkey AS r, l_returnflag AS lst, l_partkey::VARCHAR AS code, min(l_linenumber) - 1 AS rank FROM lineitem GROUP BY 1, 2, 3),
pos AS (SELECT DISTINCT l_orderkey AS r, l_partkey::VARCHAR AS code FROM lineitem WHERE l_linenumber = 1),
n AS (SELECT r, lst, row_number() OVER (PARTITION BY r ORDER BY lst) AS i, count(*) OVER (PARTITION BY r) AS n FROM (SELECT DISTINCT r, lst FROM l)),
w AS (SELECT r, count(*) * 3 AS want FROM pos GROUP BY r),
s AS (SELECT n.r, lst, want // n.n + (i <= want % n.n)::INT AS share FROM n JOIN w ON w.r = n.r),
o AS (SELECT r, code, min(lst) AS lst, arg_min(rank, lst) AS rank FROM l WHERE (r, code) NOT IN (SELECT r, code FROM pos) GROUP BY r, code),
p AS (SELECT *, row_number() OVER (PARTITION BY r, lst ORDER BY rank, code) - 1 AS p FROM o),
k AS (SELECT *, round(ln({U.format(seed=0, key="r || '|' || code")}) / exp(-0.5 * p), 6) AS k FROM p),
c AS (SELECT *, row_number() OVER (PARTITION BY r, lst ORDER BY k DESC, code) AS c FROM k)
SELECT c.r, c.lst, c.code FROM c JOIN s ON s.r = c.r AND s.lst = c.lst WHERE c <= share""")
def fair_share_negatives(spark, d):
    li = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("r"), F.col("l_returnflag").alias("lst"), F.col("l_partkey").cast("string").alias("code"), F.col("l_linenumber").alias("n"))
    ranked = li.groupBy("r", "lst", "code").agg((F.min("n") - 1).alias("rank"))
    return sampling.fair_shares(ranked, li.where("n = 1").select("r", "code").distinct(), "r", "lst", "code", "rank", 3)


PAIRS = """prs AS (SELECT 'N' || a.n_nationkey AS code, 'N' || b.n_nationkey AS other, abs(a.n_nationkey - b.n_nationkey) AS rank, a.n_regionkey = b.n_regionkey AS near FROM nation a JOIN nation b ON a.n_nationkey <> b.n_nationkey),
cap AS (SELECT *, row_number() OVER (PARTITION BY code ORDER BY rank, other) - 1 AS p FROM prs WHERE NOT near),
key AS (SELECT *, round(ln((('0x' || substr(md5('0|' || code || '|' || other), 1, 8))::BIGINT + 0.5) / 4294967296.0) / exp(-0.5 * p), 6) AS k FROM cap WHERE p < 8),
neg AS (SELECT code, other FROM (SELECT *, row_number() OVER (PARTITION BY code ORDER BY k DESC, other) AS c FROM key) WHERE c <= 3)"""


def _capped(spark, d):
    n = table(spark, d, "nation").select(F.concat(F.lit("N"), "n_nationkey").alias("code"), F.concat(F.lit("R"), "n_regionkey").alias("chapter"), "n_nationkey")
    o = n.select(F.col("code").alias("other"), F.col("n_nationkey").alias("k"))
    pairs = n.join(o, F.col("code") != F.col("other")).select("code", "other", F.abs(F.col("n_nationkey") - F.col("k")).alias("rank"))  # 25 nations
    return sampling.capped_negatives(pairs, n.select("code"), n.select("code", "chapter"), "code", "other", "rank", 8, 3, within=False)


@query(f"WITH {PAIRS} SELECT code, other FROM neg")
def chapter_negatives(spark, d):
    return _capped(spark, d)


@query(f"""WITH {PAIRS}, l AS (SELECT code, string_agg(other, ',' ORDER BY other) AS o FROM neg GROUP BY code),
t AS (SELECT n_regionkey, 'N' || n_nationkey AS code, row_number() OVER (PARTITION BY n_regionkey ORDER BY 'N' || n_nationkey) - 1 AS pos FROM nation)
SELECT n_regionkey, pos::INT AS pos, t.code, concat_ws(',', l.o, t.code) AS candidates FROM t LEFT JOIN l ON l.code = t.code""")
def candidate_lists(spark, d):
    rows = table(spark, d, "nation").groupBy("n_regionkey").agg(F.sort_array(F.collect_list(F.concat(F.lit("N"), "n_nationkey"))).alias("targets"))
    return sampling.expanded(rows, "n_regionkey", "targets", _capped(spark, d), "code", "other").select("n_regionkey", "pos", "code", joined("candidates").alias("candidates"))


# ---- hierarchies, intervals and text --------------------------------------------------------------
@query(f"""WITH RECURSIVE {TREE}, s AS (SELECT * FROM closed UNION ALL SELECT id, id, 0 FROM nodes)
SELECT descendant AS id, string_agg(lower(name), ' / ' ORDER BY depth DESC) AS full_description FROM s JOIN nodes ON id = ancestor GROUP BY descendant""")
def full_description(spark, d):
    t = tree(spark, d).withColumn("description", F.lower("name"))
    return hierarchy.full_description(t, hierarchy.closure(t, include_self=True), " / ")


@query("SELECT o_orderpriority AS lead_id, count(*) AS n, md5(string_agg(o_orderpriority || '.' || o_orderkey, ',' ORDER BY o_orderpriority || '.' || o_orderkey)) AS digest FROM orders WHERE o_orderkey % 50 = 1 GROUP BY 1")
def terms_by_lead(spark, d):
    terms = table(spark, d, "orders").where("o_orderkey % 50 = 1").select(F.concat_ws(".", "o_orderpriority", "o_orderkey").alias("id"))
    return hierarchy.by_lead_term(terms).select("lead_id", F.size("terms").cast("bigint").alias("n"), F.md5(joined("terms")).alias("digest"))


@query("""WITH f AS (SELECT item_id, d.doc_id, strpos(d.text, b.text) - 1 AS s, strpos(d.text, b.text) - 1 + length(b.text) AS e, length(d.text) AS n FROM documents d JOIN benchmark b ON contains(d.text, b.text))
SELECT doc_id, item_id, array_to_string(list_transform(range(s // 400 + 1, (e - 1) // 400 + 2), lambda x: x::VARCHAR), ',') AS segments FROM f""")
def feature_segments(spark, d):
    docs = table(spark, d, "documents")
    spans = intervals.shared_passages(docs, table(spark, d, "benchmark"), "doc_id", "text", "item_id", "text")
    at = F.explode(F.sequence(F.lit(0), F.greatest(F.length("text"), F.lit(1)) - 1, F.lit(400)))
    segs = docs.join(spans.select("doc_id").distinct(), "doc_id", "left_semi").select("doc_id", F.length("text").alias("n"), at.alias("start")).select("doc_id", (F.floor(F.col("start") / 400) + 1).cast("int").alias("seg"), "start", F.least(F.col("start") + 400, F.col("n")).alias("end"))
    return intervals.feature_segments(spans, segs, "doc_id", "item_id", "seg").select("doc_id", "item_id", joined(F.transform("segments", lambda x: x.cast("string"))).alias("segments"))


@query("SELECT p_partkey, 'A' || lpad((p_partkey % 100)::VARCHAR, 2, '0') BETWEEN 'A10' AND 'A20' AS inside FROM part")
def category_range(spark, d):
    code = F.concat(F.lit("A"), F.lpad((F.col("p_partkey") % 100).cast("string"), 2, "0"))
    return table(spark, d, "part").select("p_partkey", codes.within_category(code, F.lit("A10"), F.lit("A20")).alias("inside"))


# ---- vectors ------------------------------------------------------------------------------------------
@query("""WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings), c AS (SELECT a.e AS p, b.e AS n FROM e a JOIN e b ON b.vec_id = a.vec_id + 1 WHERE a.vec_id < 6 AND a.vec_id % 2 = 0),
t AS (SELECT e FROM e WHERE vec_id = 7), m AS (SELECT vec_id, sum(sign(round(list_dot_product(e.e, c.p) - list_dot_product(e.e, c.n), 9))) AS r FROM e, c GROUP BY vec_id)
SELECT m.vec_id, round(r + 1 / (1 + exp(-list_dot_product(e.e, t.e))), 6) AS score FROM m JOIN e ON e.vec_id = m.vec_id, t ORDER BY score DESC, m.vec_id LIMIT 15""")
def discover(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", "embedding")
    first = e.where("vec_id < 6 and vec_id % 2 = 0").select((F.col("vec_id") + 1).alias("other"), F.col("embedding").alias("p"))
    pairs = first.join(e.select(F.col("vec_id").alias("other"), F.col("embedding").alias("n")), "other")
    return vectors.discover(pairs, e, "vec_id", "embedding", 15, e.where("vec_id = 7").select(F.col("embedding").alias("v")))


@query(f"""WITH {V}, r AS (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY score DESC, x_id) AS rank FROM s), k AS (SELECT * FROM r WHERE rank <= 5 AND score >= 0.3)
SELECT q_id, string_agg(x_id::VARCHAR, ',' ORDER BY rank) || repeat(',-1', (5 - count(*))::INT) AS items, count(*) AS n FROM k GROUP BY q_id""")
def padded_hits(spark, d):
    got = vectors.padded_hits(nearest(spark, d, 5).where("score >= 0.3"), "q_id", "x_id", 5)
    return got.select("q_id", joined(F.transform("items", lambda x: x.cast("string"))).alias("items"), F.size(F.filter("scores", lambda s: s > float("-inf"))).cast("bigint").alias("n"))
