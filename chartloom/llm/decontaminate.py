"""Benchmark decontamination by winnowing.

Of the word 5-grams of every run of ten words the one with the least hash is a fingerprint. A run of ten words that
texts and items share has the same fingerprint on both sides, so joining fingerprints finds every shared window.
Items of fewer words are one window; their length's word sequences are all fingerprints. Hits carry the words around
them and are extended: every window there is joined with the items' windows on its words, not on hashes.

A filter of fixed size (``FILTER_BITS``) over the items' fingerprints, made by the executors, keeps most other
fingerprints of texts from being written; what it lets through by chance goes at the joins. Joins are salted on the
texts' side, as one passage may stand in a third of all texts. Texts with the same set of windows form a family; items are
listed once a family. So no pairs of texts and items are made, except where a family's list of items is the result.

Null texts and texts without words have no words and no hits; items without words have no windows; items without an id
mark words but are not listed; an id that several items share is listed once; rows that repeat an id get a row each. Long texts are read whole.
Empty tables give no hits, or no rows. Columns other than id and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, map_arrow, text_or_empty
from .word_hashes import _BYTE_POWERS, _BYTES, _LOWER, Sequences, U, mix

#: Words of a window and of a gram; any ten words in a row hold a fingerprint, the least of six grams.
WINDOW, GRAM = 10, 5
#: Bits of the filter over the items' fingerprints: 4 MiB, whatever the benchmark's size.
FILTER_BITS = 25
#: Shares into which a hot fingerprint or window is split.
SALTS = 32

# Letters and digits of ASCII, and all that is not ASCII, make words.
_INSIDE = np.zeros(256, bool)
_INSIDE[48:58] = _INSIDE[65:91] = _INSIDE[97:123] = _INSIDE[128:] = True


class Words:
    """The words of one text as bytes, with their hashes."""

    def __init__(self, text: str):
        raw = _LOWER[np.frombuffer(text.encode(), np.uint8)]
        edge = np.zeros(raw.size + 2, np.int8)
        edge[1:-1] = _INSIDE[raw]
        edge = np.diff(edge)
        self.raw, self.starts, self.ends = raw.tobytes(), np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        self.n = self.starts.size
        if self.n:
            up, down = _BYTE_POWERS.to(raw.size)
            sums = np.zeros(raw.size + 1, np.uint64)
            np.cumsum(_BYTES[raw] * up[: raw.size], out=sums[1:])
            of = mix((sums[self.ends] - sums[self.starts]) * down[self.starts] + (self.ends - self.starts).astype(np.uint64))
            self.runs = Sequences(of)

    def grams(self, k: int) -> np.ndarray:
        """Hashes of all runs of ``k`` words."""
        at = np.arange(max(0, self.n - k + 1))
        return self.runs.of(at, at + k) if at.size else np.zeros(0, np.uint64)

    def chosen(self, window: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
        """By window: the place of its fingerprint, the last of the least grams; and the grams' hashes."""
        hashes, wide = self.grams(gram), window - gram + 1
        if hashes.size < wide:
            return np.zeros(0, np.int64), hashes
        runs = np.lib.stride_tricks.sliding_window_view(hashes, wide)
        return np.arange(len(runs)) + wide - 1 - np.argmin(runs[:, ::-1], axis=1), hashes

    def spelled(self, start: int, end: int) -> str:
        return b" ".join(self.raw[a:b] for a, b in zip(self.starts[start:end].tolist(), self.ends[start:end].tolist(), strict=True)).decode()


def item_windows(items: DataFrame, item_col: str, text_col: str, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """item, size (words), words, print (fingerprint) of every window of the items."""
    schema = "item string, size int, words string, print long"

    def cut(batches):
        for batch in batches:
            for item, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                w = Words(text)
                if not w.n:
                    continue
                size = min(w.n, window)
                places, hashes = w.chosen(window, gram) if w.n >= window else (np.zeros(1, np.int64), w.grams(size))
                for at in range(0, len(places), 4096):
                    part = places[at : at + 4096]
                    words = [w.spelled(i, i + size) for i in range(at, at + len(part))]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([item] * len(part), pa.string()), pa.array([size] * len(part), pa.int32()), pa.array(words), pa.array(hashes[part].view(np.int64))],
                        names=["item", "size", "words", "print"],
                    )

    return map_arrow(items.select(F.col(item_col).cast("string").alias("item"), text_or_empty(text_col).alias("text")), cut, schema)


def _places(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    mask = U((1 << FILTER_BITS) - 1)
    return prints & mask, (prints >> U(FILTER_BITS)) & mask


def print_filter(prints: DataFrame) -> np.ndarray:
    """Bytes of the filter over a column ``print``: two bits for each; tasks merge 64 bits at a time, at most 2^25 / 64 words arrive."""
    mask = (1 << FILTER_BITS) - 1
    bits = prints.select(F.explode(F.array(F.col("print").bitwiseAND(mask), F.shiftright("print", FILTER_BITS).bitwiseAND(mask))).alias("bit"))
    words = bits.groupBy(F.shiftright("bit", 6).alias("at")).agg(F.expr("bit_or(shiftleft(1L, int(bit & 63)))").alias("word")).toArrow()
    out = np.zeros(1 << FILTER_BITS - 6, np.int64)
    out[words.column("at").to_numpy()] = words.column("word").to_numpy()
    return out.view(np.uint8)


def text_prints(docs: DataFrame, id_col: str, text_col: str, seen: np.ndarray, short: list[int], window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """Two kinds of rows. Heads (size null): row, id, n_words of each row. Hits: row, size, print, start, words around it.

    ``row`` names a row of ``docs`` within one run of the job, so the result is to be written before it is used.
    """
    schema = T.StructType([T.StructField("row", T.LongType()), T.StructField("id", docs.schema[id_col].dataType), T.StructField("n_words", T.LongType()), T.StructField("size", T.IntegerType()), T.StructField("print", T.LongType()), T.StructField("start", T.IntegerType()), T.StructField("words", T.StringType())])

    def passes(prints: np.ndarray) -> np.ndarray:
        a, b = _places(prints)
        return (seen[a >> U(3)] >> (a & U(7)).astype(np.uint8) & seen[b >> U(3)] >> (b & U(7)).astype(np.uint8) & 1).astype(bool)

    def hits(w: Words) -> Iterator[tuple[int, int, int, str]]:
        """size, print, first word and words of what the filter lets through."""
        places, hashes = w.chosen(window, gram)
        places = np.unique(places)
        for p in places[passes(hashes[places])].tolist():
            start, end = max(0, p - (window - gram)), min(w.n, p + window)
            yield window, int(hashes[p].view(np.int64)), start, w.spelled(start, end)
        for size in short:
            prints = w.grams(size)
            for p in np.flatnonzero(passes(prints)).tolist():
                yield size, int(prints[p].view(np.int64)), p, w.spelled(p, p + size)

    def scan(batches):
        no = TaskContext.get().partitionId() << 40
        for batch in batches:
            rows, heads = [], []
            for text in batch.column(1).to_pylist():
                w = Words(text)
                heads.append((no, w.n))
                if w.n:
                    for hit in hits(w):
                        rows.append((no, *hit))
                        if len(rows) == 16384:
                            yield found(rows, batch.column(0).type)
                            rows = []
                no += 1
            if rows:
                yield found(rows, batch.column(0).type)
            n = len(heads)
            yield pa.RecordBatch.from_arrays(
                [pa.array([h[0] for h in heads], pa.int64()), batch.column(0), pa.array([h[1] for h in heads], pa.int64()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.string())],
                names=schema.fieldNames(),
            )

    def found(rows, kind):
        cols = list(zip(*rows, strict=True))
        return pa.RecordBatch.from_arrays(
            [pa.array(cols[0], pa.int64()), pa.nulls(len(rows), kind), pa.nulls(len(rows), pa.int64()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.int32()), pa.array(cols[4], pa.string())],
            names=schema.fieldNames(),
        )

    return map_arrow(docs.select(id_col, text_or_empty(text_col).alias("text")), scan, schema)


def _spread(left: DataFrame, right: DataFrame, keys: list[str], by: str, how: str = "inner") -> DataFrame:
    """An equality join whose left side may have hot keys: they are dealt by ``by`` to SALTS copies of the right side's rows."""
    salted = left.withColumn("_salt", F.pmod(F.xxhash64(by), F.lit(SALTS)).cast("int"))
    copies = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return salted.join(copies, [*keys, "_salt"], how).drop("_salt")


def find_contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", window: int = WINDOW, gram: int = GRAM) -> tuple[DataFrame, DataFrame]:
    """(rows, families). Rows: id, n_words, spans (sorted word ranges, start and end, that items' windows cover; null
    without hits), family (null without hits). Families: family, items (sorted ids of the items that occur)."""
    work = Scratch(docs.sparkSession)
    cut = work.spill(item_windows(items, item_col, item_text, window, gram), "item-windows")
    short = sorted(r["size"] for r in cut.where(F.col("size") < window).select("size").distinct().collect())  # at most window - 1
    prints = cut.select("size", "print").distinct()
    scanned = work.spill(text_prints(docs, id_col, text_col, print_filter(prints), short, window, gram), "text-prints")

    near = _spread(scanned.where("size is not null").drop("id", "n_words"), prints, ["size", "print"], "row", "left_semi")
    # a hit is extended to every window around it; windows that several hits reach are kept once below
    parts = F.array(F.split("words", " "))
    each = F.transform(parts, lambda ws: F.transform(F.sequence(F.lit(0), F.size(ws) - F.col("size")), lambda i: F.struct((F.col("start") + i).alias("start"), F.array_join(F.slice(ws, i + 1, F.col("size")), " ").alias("words"))))[0]
    reached = near.select("row", "size", F.explode(each).alias("w")).select("row", "size", "w.start", "w.words")
    windows = cut.select("size", "words").distinct()
    hits = _spread(reached, windows, ["size", "words"], "row").select("row", "start", "size", F.md5("words").alias("window"))

    ordered = Window.partitionBy("row").orderBy("start")
    reach = F.max(F.col("start") + F.col("size")).over(ordered.rowsBetween(Window.unboundedPreceding, -1))
    runs = hits.withColumn("opens", F.coalesce(F.col("start") > reach, F.lit(True)).cast("int")).withColumn("run", F.sum("opens").over(ordered.rowsBetween(Window.unboundedPreceding, 0)))
    spans = runs.groupBy("row", "run").agg(F.min("start").alias("start"), F.max(F.col("start") + F.col("size")).alias("end"), F.collect_set("window").alias("windows"))
    marked = spans.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("spans"), F.sort_array(F.array_distinct(F.flatten(F.collect_list("windows")))).alias("windows"))
    marked = work.spill(marked.withColumn("family", F.sha2(F.array_join("windows", ","), 256)), "text-hits")

    sets = marked.groupBy("family").agg(F.first("windows").alias("windows")).select("family", F.explode("windows").alias("window"))
    owners = cut.where("item is not null").select(F.md5("words").alias("window"), "item").distinct()
    listed = _spread(sets, owners, ["window"], "family").groupBy("family").agg(F.sort_array(F.collect_set("item")).alias("items"))
    heads = scanned.where("size is null").select("row", "id", "n_words")
    rows = heads.join(marked.select("row", "spans", "family"), "row", "left")
    return rows.select(F.col("id").alias(id_col), "n_words", "spans", "family"), listed


def contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """Per row: id, n_words, n_hit (words in some window), n_items, items_sha256, contaminated."""
    rows, families = find_contamination(docs, items, id_col, text_col, item_col, item_text, window, gram)
    length = F.aggregate("spans", F.lit(0).cast("long"), lambda s, x: s + (x["end"] - x["start"]))
    lists = families.select("family", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"))
    hit = _spread(rows.where("family is not null"), lists, ["family"], id_col, "left")
    clean = rows.where("family is null").select("*", F.lit(None).cast("long").alias("n_items"), F.lit(None).cast("string").alias("items_sha256"))
    none = F.sha2(F.lit("").cast("binary"), 256)
    out = hit.unionByName(clean).withColumn("n_hit", F.coalesce(length, F.lit(0).cast("long")))
    return out.select(id_col, "n_words", "n_hit", F.coalesce("n_items", F.lit(0).cast("long")).alias("n_items"), F.coalesce("items_sha256", none).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))
