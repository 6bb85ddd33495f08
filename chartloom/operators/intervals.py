"""Interval joins within a document by a plane sweep over time bins, and the places of passages in texts.

Intervals are half-open; two overlap if each starts before the other ends, so an empty one overlaps what holds its place inside. Intervals
without a document, a start or an end, and those that end before they start, overlap nothing.
"""

from __future__ import annotations

import heapq

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: Leading characters by which short passages are joined.
SHORT_KEY = 4
#: Positions of a bin. A document is swept bin by bin, so that a long one is spread over tasks.
BIN = 1 << 14
#: Rows of a batch that a sweep or a search gives.
OUT_ROWS = 8192


def overlap_pairs(left: DataFrame, right: DataFrame, doc: str, left_key: str, right_key: str, width: int = BIN) -> DataFrame:
    """doc, left_key, right_key of every left and right interval of a document that overlap, once a pair of rows.

    Both sides have ``doc``, ``start``, ``end`` and their key. Every bin of ``width`` positions gets the intervals that reach into it, sorted by
    start; a task streams through them with the open intervals of both sides as its only state, so time grows
    with rows and pairs, not with rows of one side times rows of the other.
    """
    kinds = [left.schema[doc].dataType, left.schema[left_key].dataType, right.schema[right_key].dataType]

    def events(df: DataFrame, key: str, side: int, other) -> DataFrame:
        own, none = F.col(key), F.lit(None).cast(other)
        keys = (own, none) if side == 0 else (none, own)
        rows = df.where(F.col("start").isNotNull() & (F.col("end") >= F.col("start")) & F.col(doc).isNotNull())
        first, last = F.floor(F.col("start") / width), F.floor(F.greatest(F.col("start"), F.col("end") - 1) / width)
        return rows.select(F.col(doc).alias("d"), F.explode(F.sequence(first, last)).alias("bin"), F.col("start").cast("long").alias("s"), F.col("end").cast("long").alias("e"), F.lit(side).alias("side"), keys[0].alias("l"), keys[1].alias("r"))

    both = events(left, left_key, 0, kinds[2]).unionByName(events(right, right_key, 1, kinds[1]))
    schema = T.StructType([T.StructField("d", kinds[0]), T.StructField("l", kinds[1]), T.StructField("r", kinds[2])])

    def sweep(batches):
        place, open_, out, order = None, ([], []), [], 0
        for batch in batches:
            for d, at, s, e, side, l, r in zip(*(c.to_pylist() for c in batch.columns), strict=True):  # noqa: E741
                if (d, at) != place:
                    place, open_ = (d, at), ([], [])
                for ends in open_:
                    while ends and ends[0][0] <= s:
                        heapq.heappop(ends)
                others = open_[1 - side]
                if s >= at * width:  # what began in an earlier bin has met there what began before it
                    out += [(d, l, x[3]) if side == 0 else (d, x[3], r) for x in others if x[2] < e]
                order += 1  # keys of any type are not compared
                heapq.heappush(open_[side], (e, order, s, l if side == 0 else r))
                if len(out) >= OUT_ROWS:
                    yield from pieces(out)
                    out = []
        yield from pieces(out)

    def pieces(out):
        for i in range(0, len(out), OUT_ROWS):
            yield pa.RecordBatch.from_pylist([dict(zip("dlr", x, strict=True)) for x in out[i : i + OUT_ROWS]], schema=arrow)

    arrow = to_arrow_schema(schema)
    dealt = both.repartition("d", "bin").sortWithinPartitions("d", "bin", "s")
    return dealt.mapInArrow(sweep, schema).select(F.col("d").alias(doc), F.col("l").alias(left_key), F.col("r").alias(right_key))


def segment_targets(segments: DataFrame, spans: DataFrame, doc: str, seg: str, code: str = "code") -> DataFrame:
    """Every segment with the sorted distinct codes of the spans that overlap it; none gives an empty list.

    Both sides have ``start`` and ``end`` (half-open). ``segments`` may repeat no (doc, seg).
    """
    hits = overlap_pairs(segments.select(doc, seg, "start", "end"), spans.select(doc, code, "start", "end"), doc, seg, code)
    grouped = hits.groupBy(doc, seg).agg(F.sort_array(F.collect_set(code)).alias("targets"))
    return segments.join(grouped, [doc, seg], "left").withColumn("targets", F.coalesce("targets", F.array().cast("array<string>")))


def feature_segments(features: DataFrame, segments: DataFrame, doc: str, feature: str, seg: str) -> DataFrame:
    """Per feature the sorted 1-based numbers of the segments it overlaps; features without a span get [0].

    A feature with a span that no segment covers raises.
    """
    hits = overlap_pairs(features.select(doc, feature, "start", "end"), segments.select(doc, seg, "start", "end"), doc, feature, seg)
    met = hits.groupBy(doc, feature).agg(F.sort_array(F.collect_set(seg)).alias("found"))
    own = features.groupBy(doc, feature).agg(F.max("start").alias("_start"))
    out = own.join(met, [doc, feature], "left").withColumn("found", F.coalesce("found", F.array().cast(met.schema["found"].dataType)))
    lost = F.raise_error(F.concat(F.lit("no segment covers feature "), F.col(feature).cast("string")))
    return out.select(doc, feature, F.when(F.col("_start").isNull(), F.array(F.lit(0))).when(F.size("found") == 0, lost).otherwise(F.col("found")).alias("segments"))


def locate_spans(docs: DataFrame, pieces: DataFrame, text: str = "text", piece: str = "piece", key: str | None = None) -> DataFrame:
    """First occurrence of each piece in its document's text: start, end; misses go. ``key`` joins both sides."""
    joined = docs.join(pieces, key)
    start = F.position(F.col(piece), F.col(text)) - 1
    return joined.withColumn("start", start).where("start >= 0").withColumn("end", F.col("start") + F.length(piece))


def shared_passages(docs: DataFrame, passages: DataFrame, doc_id: str, text: str, passage_id: str, passage: str, words: int = 6) -> DataFrame:
    """Passages that occur verbatim in texts, with the first place: an equality join, then the containment test.

    Passages of at least ``words`` + 2 words are joined on a hash of their first ``words`` whole words (their first
    word may be the tail of a word of the text, the last one its head); shorter ones on their first characters.
    """
    tokens = lambda c: F.filter(F.split(c, r"\s+"), lambda w: w != "")
    gram = lambda ws, at: F.xxhash64(*(F.element_at(ws, at + i) for i in range(words)))
    p = passages.select(passage_id, F.col(passage).alias("_p"), tokens(F.col(passage)).alias("_w")).where("_p <> ''")
    long = p.where(F.size("_w") >= words + 2).select(passage_id, "_p", F.transform(F.array(F.transform("_w", lambda w: F.xxhash64(w))), lambda ws: gram(ws, F.lit(2)))[0].alias("_h"))
    short = p.where(F.size("_w") < words + 2).select(passage_id, "_p")
    d = docs.select(doc_id, F.col(text).alias("_t"))
    # a word is hashed once; a one-item array binds the hashes, so that they are made once
    hashes = F.transform(F.array(F.transform(tokens(F.col("_t")), lambda w: F.xxhash64(w))), lambda ws: F.when(F.size(ws) >= words, F.transform(F.sequence(F.lit(1), F.size(ws) - words + 1), lambda i: gram(ws, i))))[0]
    hits = d.select(doc_id, F.explode(F.array_distinct(hashes)).alias("_h")).join(long, "_h").select(doc_id, passage_id, "_p").distinct()
    found = hits.join(d, doc_id).where(F.col("_t").contains(F.col("_p")))
    for n in [r["n"] for r in short.select(F.least(F.lit(SHORT_KEY), F.length("_p")).alias("n")).distinct().collect()]:  # at most SHORT_KEY lengths
        keyed = short.where(F.least(F.lit(SHORT_KEY), F.length("_p")) == n).select(passage_id, "_p", F.substring("_p", 1, n).alias("_h"))
        wide = F.array(F.encode("_t", "UTF-32"))
        places = F.transform(wide, lambda b: F.when(F.length(b) >= 4 * n, F.transform(F.sequence(F.lit(0), (F.length(b) / 4 - n).cast("int")), lambda i: F.decode(F.substring(b, (i * 4 + 1).cast("int"), F.lit(4 * n)), "UTF-32"))))[0]  # noqa: B023
        found = found.unionByName(d.select(doc_id, F.explode(F.array_distinct(places)).alias("_h")).join(keyed, "_h").select(doc_id, passage_id, "_p").join(d, doc_id).where(F.col("_t").contains(F.col("_p"))))
    return found.select(doc_id, passage_id, (F.position("_p", "_t") - 1).alias("start"), (F.position("_p", "_t") - 1 + F.length("_p")).alias("end"))


def passage_places(docs: DataFrame, passages: DataFrame, doc_id: str, text: str, passage_id: str, passage: str, words: int = 6) -> DataFrame:
    """doc_id, passage_id, start, end of every place of every passage in every text, places that overlap included.

    Pairs come from ``shared_passages``, an equality join, so any number of passages will do; then a text is read once, by an
    Aho-Corasick automaton of the passages that it holds.
    """
    schema = T.StructType([docs.schema[doc_id], T.StructField("_p", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])
    of = passages.select(passage_id, F.col(passage).alias("_p"))
    held = shared_passages(docs, passages, doc_id, text, passage_id, passage, words).select(doc_id, passage_id).join(of, passage_id)
    lists = held.groupBy(doc_id).agg(F.sort_array(F.collect_set("_p")).alias("_ps"))
    arrow = to_arrow_schema(schema)

    def search(batches):
        made: tuple = (None, None)
        for batch in batches:
            ids, kind, out = batch.column(0), batch.column(0).type, []
            for i, (body, found) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)):
                if found != made[0]:
                    automaton = ahocorasick.Automaton()
                    for p in found:
                        automaton.add_word(p, p)
                    automaton.make_automaton()
                    made = (found, automaton)
                for last, p in made[1].iter(body):
                    out.append((i, p, last + 1 - len(p), last + 1))
                    if len(out) >= OUT_ROWS:
                        yield rows(ids, kind, out)
                        out = []
            if out:
                yield rows(ids, kind, out)

    def rows(ids, kind, out):
        at, p, start, end = zip(*out, strict=True)
        return pa.RecordBatch.from_arrays([ids.take(pa.array(at)).cast(kind), pa.array(p, pa.string()), pa.array(start, pa.int32()), pa.array(end, pa.int32())], schema=arrow)

    places = docs.select(doc_id, F.col(text).alias("_t")).join(lists, doc_id).select(doc_id, "_t", "_ps").mapInArrow(search, schema)
    return places.join(of, "_p").select(doc_id, passage_id, "start", "end")
