"""The queries over the driver's tables, one per operator, and their SQL where SQL can say it."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import audio, warc
from .common import spill, table
from .decontaminate import contamination
from .exact_dedup import exact_dedup
from .fill_middle import fill_in_middle, restored
from .filter_audit import audit_orders, failure_counts
from .line_dedup import dedup_lines
from .mixing import copies, fit_mixing, with_rates
from .ngram_join import ngram_components
from .packing import pack_documents
from .substring_dedup import remove_repeats
from .token_counts import prefix_token_counts
from .toxicity import fit_toxicity


def vocabulary() -> str:
    return public_tokenizers.path("word_bpe_49k.json")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = prefix_token_counts(table(spark, sf_dir, "documents"), vocabulary())
    return counts.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 2048).alias("over_limit"))


def held_out(id_col: str = "doc_id"):
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(4)) == 2


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit_toxicity(docs, table(spark, sf_dir, "labels"), usable=~held_out())
    scored = model.score(docs)
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op3_audio_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("text"))
    # an id of both parts carries n_bytes through the operator, which keeps the id as it is
    clips = docs.select(F.struct("doc_id", F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes")).alias("id"), audio.text_payload(F.col("text")).alias("payload"))
    got = audio.audio_features(audio.encode_media(clips, "id"), "id")
    spans = F.to_json("segments")
    return got.select(
        "id.doc_id",
        "id.n_bytes",
        F.length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.substring("payload", -16, 16)).alias("tail_crc32"),
        F.length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        F.concat_ws(":", F.col("n_tensors").cast("string"), F.sha2("tensors", 256), F.size("segments").cast("string"), F.sha2(spans.cast("binary"), 256)).alias("feature"),
    )


def op4_warc_bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = warc.mark_revisits(table(spark, sf_dir, "pages"), "page_id", "url", "html", min_payload=0)
    bundles = spill(warc.write_bundles(marked), "warc-bundles")
    records = warc.read_bundles(bundles)
    return records.select(F.col("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


#: Target weights by language and quality; domains a corpus lacks are left out.
TARGET_WEIGHTS = {"en-1": 0.40, "fr-1": 0.16, "de-1": 0.16, "es-1": 0.16, "en-0": 0.03, "fr-0": 0.03, "de-0": 0.03, "es-0": 0.03}


def labelled_domains(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id and domain (language and quality) of the labelled rows."""
    known = labels.where("quality is not null").select("doc_id", "quality")
    return docs.select("doc_id", "lang").join(known, "doc_id").select("doc_id", F.concat_ws("-", "lang", F.col("quality").cast("string")).alias("domain"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model, members = fit_mixing(docs, labelled_domains(docs, table(spark, sf_dir, "labels")), TARGET_WEIGHTS, vocabulary=vocabulary())
    return with_rates(model, members).select(F.col("id").alias("doc_id"), "domain", "n_tokens", "rate", copies(F.col("rate"), F.col("id")).alias("copies"))


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), vocabulary(), capacity=4096, end_id=1)


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"), batches=2, window=35)


def op8_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_components(table(spark, sf_dir, "documents"), k=3, num=90, den=100)


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(table(spark, sf_dir, "documents"), num=8, den=10)


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").select("doc_id", (F.col("quality") == 1).alias("good"), (F.col("toxic") == 1).alias("toxic"))
    counts = failure_counts(table(spark, sf_dir, "documents"), labels, "source")
    return audit_orders(counts, "ABCDE", ["good", "toxic"])


def op12_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = fill_in_middle(table(spark, sf_dir, "documents"))
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    return cut.select(
        "doc_id",
        "n",
        "form",
        F.length("prefix").cast("long").alias("prefix_chars"),
        F.length("middle").cast("long").alias("middle_chars"),
        digest(F.col("output")).alias("output_sha256"),
        digest(restored()).alias("restored_sha256"),
    )


OP4_SQL = r"""
WITH p AS (
  SELECT page_id, coalesce(html, '') AS body FROM pages
), f AS (
  SELECT page_id, strlen(body) AS payload_bytes, sha1(body) AS h, min(page_id) OVER (PARTITION BY body) AS first FROM p
)
SELECT page_id, payload_bytes,
       (SELECT string_agg(translate(upper(lpad(to_base(('0x' || substr(h, 10 * i + 1, 10))::BIGINT, 32), 8, '0')),
               '0123456789ABCDEFGHIJKLMNOPQRSTUV', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'), '' ORDER BY i)
        FROM range(4) r(i)) AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to
FROM f
"""

OP7_SQL = r"""
WITH w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents
), p AS (SELECT doc_id, ws, unnest(range(1, len(ws) - 33)) AS i FROM w),
k AS (SELECT doc_id, i, array_to_string(ws[i:i + 34], ' ') AS g FROM p),
h AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY g) AS n FROM k) WHERE n > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS j FROM h),
words AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS j FROM w),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY j) AS body FROM words ANTI JOIN gone USING (doc_id, j) GROUP BY doc_id),
r AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id)
SELECT w.doc_id, len(ws) AS n_words, coalesce(r.n, 0) AS n_removed, sha256(coalesce(kept.body, '')) AS kept_sha256
FROM w LEFT JOIN r ON r.doc_id = w.doc_id LEFT JOIN kept ON kept.doc_id = w.doc_id
"""

OP8_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                             '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(ws) = 0 THEN []
                      WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
                      ELSE list_distinct(list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2])) END AS sh
  FROM w
), n AS (SELECT doc_id, len(sh) AS n FROM s), u AS (SELECT doc_id, unnest(sh) AS g FROM s),
i AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM u a JOIN u b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM i JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 90 * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT a AS doc_id, a AS far FROM e UNION SELECT r.doc_id, e.b FROM r JOIN e ON e.a = r.far),
m AS (SELECT doc_id, min(far) AS c FROM r GROUP BY doc_id)
SELECT n.doc_id, n.n AS n_shingles, coalesce(m.c, n.doc_id) AS component_id FROM n LEFT JOIN m ON m.doc_id = n.doc_id
"""

OP9_SQL = r"""
WITH t AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS body FROM documents
)
SELECT doc_id, min(doc_id) OVER (PARTITION BY body) AS keep_id, count(*) OVER (PARTITION BY body) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY body) AS kept, sha256(body) AS text_sha256
FROM t
"""

OP11_SQL = r"""
WITH w AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents
), l AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
m AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
         (len(ws) < 200)::INT + 2 * (100 * len(list_distinct(ws)) < 50 * len(ws))::INT
         + 4 * (100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t))::INT + 8 * regexp_matches(t, '[#$%&*|]')::INT
         + 16 * coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false)::INT AS mask
  FROM w LEFT JOIN l USING (doc_id)
), c AS (SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM m GROUP BY ALL),
f(x) AS (VALUES ('A'), ('B'), ('C'), ('D'), ('E')),
o AS (SELECT a.x || b.x || c.x || d.x || e.x AS ord FROM f a, f b, f c, f d, f e WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
s AS (
  SELECT ord, step, 1 << (ascii(substr(ord, step, 1)) - 65) AS bit,
         (SELECT sum(contains(substr(ord, 1, step - 1), x)::INT << (ascii(x) - 65)) FROM f)::INT AS gone
  FROM o, range(1, 6) r(step)
), r AS (
  SELECT part, ord AS filter_order, step::INT AS step, bit,
         coalesce(sum(n) FILTER (mask & (gone | bit) = 0), 0)::BIGINT AS kept,
         coalesce(sum(n) FILTER (mask & gone = 0 AND mask & bit <> 0), 0)::BIGINT AS removed,
         coalesce(sum(n) FILTER (mask & gone <> 0 AND mask & bit <> 0), 0)::BIGINT AS redundant,
         coalesce(sum(n) FILTER (mask = bit), 0)::BIGINT AS unique_fails,
         coalesce(sum(good) FILTER (mask & gone = 0 AND mask & bit <> 0), 0)::BIGINT AS good_lost,
         coalesce(sum(toxic) FILTER (mask & gone = 0 AND mask & bit <> 0), 0)::BIGINT AS toxic_lost
  FROM c, s GROUP BY ALL
)
SELECT * EXCLUDE (bit), (sum(removed) OVER (PARTITION BY part, bit))::BIGINT AS shapley FROM r
"""

OP12_SQL = r"""
WITH d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                             '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS ws FROM documents
), b AS (
  SELECT item_id::VARCHAR AS item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                             '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS ws FROM benchmark
), p AS (SELECT item_id, ws, least(len(ws), 10) AS k, unnest(range(1, len(ws) - least(len(ws), 10) + 2)) AS j FROM b WHERE len(ws) > 0),
i AS (SELECT DISTINCT item_id, k, array_to_string(ws[j:j + k - 1], ' ') AS g FROM p),
q AS (SELECT doc_id, ws, k, unnest(range(1, len(ws) - k + 2)) AS j FROM d, (SELECT DISTINCT k FROM i)),
h AS (SELECT doc_id, j, i.k AS k, item_id FROM q JOIN i ON i.k = q.k AND g = array_to_string(ws[j:j + q.k - 1], ' ')),
x AS (SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(range(j, j + k)) AS pos FROM h) GROUP BY doc_id),
y AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM h) GROUP BY doc_id)
SELECT d.doc_id, len(ws) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN x ON x.doc_id = d.doc_id LEFT JOIN y ON y.doc_id = d.doc_id
"""

OP13_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || doc_id) AS h FROM documents),
u AS (
  SELECT doc_id, t, regexp_extract_all(t, '[A-Za-z]+|[^A-Za-z]') AS us, ('0x' || substr(h, 1, 8))::BIGINT AS h1, ('0x' || substr(h, 9, 8))::BIGINT AS h2,
         ('0x' || substr(h, 17, 8))::BIGINT AS h3, ('0x' || substr(h, 25, 8))::BIGINT AS h4 FROM d
), c AS (
  SELECT doc_id, t, us, len(us) AS n, least(h1 % (len(us) + 1), h2 % (len(us) + 1)) AS a, greatest(h1 % (len(us) + 1), h2 % (len(us) + 1)) AS b,
         CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM u
), p AS (
  SELECT doc_id, t, n, form, coalesce(array_to_string(us[1:a], ''), '') AS p, coalesce(array_to_string(us[a + 1:b], ''), '') AS m, coalesce(array_to_string(us[b + 1:], ''), '') AS s FROM c
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM p
"""

QUERIES = {
    f.__name__: f
    for f in (op1_token_counts, op2_toxicity, op3_audio_columns, op4_warc_bundles, op5_mixing, op6_best_fit_packing, op7_substring_dedup, op8_ngram_join, op9_exact_dedup, op10_line_dedup, op11_filter_audit, op12_decontaminate, op13_fill_middle)
}
SQL = {"op4_warc_bundles": OP4_SQL, "op7_substring_dedup": OP7_SQL, "op8_ngram_join": OP8_SQL, "op9_exact_dedup": OP9_SQL, "op11_filter_audit": OP11_SQL, "op12_decontaminate": OP12_SQL, "op13_fill_middle": OP13_SQL}
