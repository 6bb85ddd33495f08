"""Queries of prefix hierarchies, table functions, mergeable aggregates, answer parsing and stemmed overlap; see ``catalog``."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import answers
from ..operators import metrics, prefix_tree, table_functions
from ..session import shared_folder, table
from ..streaming.partials import PartialStore
from .catalog import query

# ---- prefix hierarchies: region, nation and customer as one code -------------------------------------------
CODES = """nodes AS (SELECT DISTINCT substr(c, 1, n)::VARCHAR AS code FROM (
  SELECT chr(65 + n_regionkey::INT) || lpad(n_nationkey::VARCHAR, 2, '0') || lpad(c_custkey::VARCHAR, 7, '0') AS c FROM customer JOIN nation ON n_nationkey = c_nationkey), (VALUES (1), (3), (10)) l(n)),
up AS (SELECT d.code, a.code AS ancestor FROM nodes d JOIN nodes a ON starts_with(d.code, a.code) AND a.code <> d.code)"""


def customer_codes(spark, d):
    nations = table(spark, d, "nation")
    each = table(spark, d, "customer").join(nations, F.col("n_nationkey") == F.col("c_nationkey"))
    code = F.concat(F.chr(65 + F.col("n_regionkey")), F.lpad(F.col("n_nationkey").cast("string"), 2, "0"), F.lpad(F.col("c_custkey").cast("string"), 7, "0"))
    return each.select(code.alias("code"), "c_custkey", "c_acctbal")


def customer_tree(spark, d):
    return prefix_tree.prefix_tree(customer_codes(spark, d), lengths=[1, 3])


@query(f"""WITH {CODES}, e AS (SELECT code, row_number() OVER (ORDER BY code) - 1 AS entry FROM nodes)
SELECT e.code, max(u.ancestor) AS parent, count(DISTINCT u.ancestor)::INT AS depth, entry, entry + (SELECT count(*) FROM up b WHERE b.ancestor = e.code) AS "exit" FROM e LEFT JOIN up u ON u.code = e.code GROUP BY e.code, entry""")
def nested_set_numbers(spark, d):
    return customer_tree(spark, d).select("code", "parent", "depth", "entry", "exit")


@query(f"WITH {CODES} SELECT a.ancestor, count(*) FILTER (WHERE NOT EXISTS (SELECT 1 FROM up b WHERE b.ancestor = a.code)) AS n_leaves, count(*) AS n_below FROM up a GROUP BY 1")
def leaves_by_range(spark, d):
    """Leaves and nodes below every inner node: the range of its numbers is as long as its subtree, so nothing is joined."""
    inner = customer_tree(spark, d).where(~prefix_tree.is_leaf())
    return inner.select(F.col("code").alias("ancestor"), "n_leaves", (F.col("exit") - F.col("entry")).alias("n_below"))


@query(f"WITH {CODES} SELECT n.code, coalesce(min(ancestor), n.code) AS root FROM nodes n LEFT JOIN up ON up.code = n.code GROUP BY n.code")
def chapter_of_code(spark, d):
    return prefix_tree.roots(customer_tree(spark, d))


@query("""WITH c AS (SELECT chr(65 + n_regionkey::INT) || lpad(n_nationkey::VARCHAR, 2, '0') || lpad(c_custkey::VARCHAR, 7, '0') AS c, c_acctbal FROM customer JOIN nation ON n_nationkey = c_nationkey)
SELECT substr(c, 1, n)::VARCHAR AS code, round(sum(c_acctbal), 2) AS total FROM c, (VALUES (1), (3), (10)) l(n) GROUP BY 1""")
def rolled_up_sums(spark, d):
    sums = prefix_tree.rolled_up(customer_tree(spark, d), customer_codes(spark, d), value="c_acctbal")
    return sums.select("code", F.round("value", 2).alias("total"))


# ---- table functions -------------------------------------------------------------------------
@query("""WITH w AS (SELECT doc_id, unnest(range(0, length(text)::BIGINT, 150)) AS s, text FROM documents)
SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY s))::INT AS seg_no, md5(trim(substr(text, s + 1, 200), ' ')) AS digest, s::INT AS start, least(s + 200, length(text))::INT AS "end" FROM w WHERE trim(substr(text, s + 1, 200), ' ') <> ''""")
def lateral_windows(spark, d):
    """Windows from SQL."""
    table_functions.register(spark)
    docs = table(spark, d, "documents")
    return spark.sql("SELECT d.doc_id, s.seg_no, md5(s.text) AS digest, s.start, s.end FROM {docs} d, LATERAL segment_window(d.text, 200, 50) s", docs=docs)


@query()
def lateral_sentences(spark, d):
    table_functions.register(spark)
    return spark.sql("SELECT d.doc_id, s.seg_no, s.start, s.end FROM {docs} d, LATERAL segment_text(d.text, 'raw_sentence') s", docs=table(spark, d, "documents"))


# ---- mergeable aggregates -------------------------------------------------------------------------
@query("SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean, max(value) AS high, round(sum(value), 4) AS total FROM events WHERE NOT isnan(value) GROUP BY 1")
def merged_runs(spark, d):
    """Three runs over a third of the events each, one of them made twice, merged."""
    events = table(spark, d, "events")
    store = PartialStore(spark, shared_folder(spark, f"partials-{uuid.uuid4().hex}"), "event_type", "value")
    for run in (0, 1, 2, 1):
        store.add(events.where(F.col("event_id") % 3 == run), run)
    return store.values().select("event_type", "n", F.round("mean", 6).alias("mean"), "high", F.round("total", 4).alias("total"))


@query("""WITH e AS (SELECT label, unnest(embedding)::DOUBLE AS x, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings)
SELECT label, i::INT AS i, round(sum(x), 5) AS x FROM e GROUP BY 1, 2""")
def class_vector_sums(spark, d):
    rows = table(spark, d, "embeddings")
    store = PartialStore(spark, shared_folder(spark, f"partials-{uuid.uuid4().hex}"), "label", "vec_id", "embedding")
    for run in (0, 1):
        store.add(rows.where(F.col("vec_id") % 2 == run), run)
    return store.vectors().select("label", F.posexplode("total").alias("i", "x")).select("label", (F.col("i") + 1).alias("i"), F.round("x", 5).alias("x"))


# ---- answers -------------------------------------------------------------------------
@query("SELECT conv_id, turn, role, md5(text) AS digest FROM conversations")
def near_json_answers(spark, d):
    """Turns written as calls, literals and half-closed lists, and read back."""
    quoted = lambda c: F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    conv, turn, role, text = F.col("conv_id").cast("string"), F.col("turn").cast("string"), F.col("role"), quoted(F.col("text"))
    forms = [
        F.format_string('<answer>list[ dict( conv=%s, turn=%s, role="%s", text="%s" ) ]</answer>', conv, turn, role, text),
        F.format_string('<answer>dict[ conv: %s, turn: %s, role: %s, text: "%s",', conv, turn, role, text),
        F.format_string("<think>[]</think>```json\n[{'conv': %s, \"turn\": %s, role: '%s', \"text\": \"%s\"},]\n```", conv, turn, role, text),
    ]
    rows = table(spark, d, "conversations")
    reply = F.when(F.col("turn") % 3 == 0, forms[0]).when(F.col("turn") % 3 == 1, forms[1]).otherwise(forms[2])
    read = rows.select(answers.query_answer(reply)["output"].alias("o")).select(F.explode(F.from_json("o", "array<struct<conv:long,turn:long,role:string,text:string>>")).alias("r"))
    return read.select(F.col("r.conv").alias("conv_id"), "r.turn", "r.role", F.md5("r.text").alias("digest"))


# ---- stemmed overlap -------------------------------------------------------------------------
@query()
def rouge_of_turns(spark, d):
    """Mean stemmed Rouge-L of each turn against the one before it, by role."""
    turns = table(spark, d, "conversations")
    before = turns.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("before"))
    return metrics.mean_rouge(turns.join(before, ["conv_id", "turn"]), "text", "before", "role").withColumn("rouge", F.round("rouge", 9))
