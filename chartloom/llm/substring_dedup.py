"""Removal of repeated passages with a log-structured fingerprint index.

A window is ``window`` consecutive words. Each window is represented by one of its word grams, the one
with the least hash (winnowing), so equal windows are represented by equal grams and a gram stands for
a run of neighbouring windows. Per run the index keeps the gram's fingerprint, a hash of all the run's
words (its context), how often both occurred and a text that holds them.

The index is a set of immutable runs, bucketed and sorted by fingerprint, that a manifest in its home
folder names. A batch becomes a new run and is merge-joined with the historical runs: fingerprints that
they hold too, or that the batch repeats, are its hits. Then runs are compacted by size tiers. Hits are
verified: contexts seen twice settle
their windows at once; where a fingerprint repeats in differing contexts, the windows themselves are
compared by two independent 64-bit hashes of their 35 words, one member for each
context that repeats, so copies are never expanded. With a ``home`` the index and the texts stay, and a later call
finds the passages that its rows share with those of earlier calls. A call's runs and its batch's name are published together, at its
end; a call that broke off before leaves nothing that is read, and one that is made again with its batch's name adds nothing.

Null and empty texts have no words; texts under ``window`` words keep all of them. Rows that repeat an
id and its text are separate rows (their windows repeat); rows that share only the id do not mix. Only
the id and text columns are read. An empty frame gives an empty frame.
"""

from __future__ import annotations

import hashlib
import uuid
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, drop_path, map_arrow, n_slices, new_path, path_exists, text_or_empty
from .word_hashes import U, Sequences, mix, word_hashes

WINDOW, GRAM = 35, 12
#: Input partitions to a bucket of the index; runs merge when one is under so many times the sum of the later ones.
SLICES_PER_BUCKET, TIER = 2, 4
ENTRY = "fp long, ctx long, c int, src long"


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Least value of each ``width`` neighbours, by doubling."""
    out, size = x, 1
    while 2 * size <= width:
        out, size = np.minimum(out[:-size], out[size:]), 2 * size
    return np.minimum(out[: out.size - (width - size)], out[width - size :])


class Runs:
    """A text's runs of windows: fingerprint, context, first and last window start, in order."""

    def __init__(self, text: str, window: int, gram: int):
        words = word_hashes(text)[0]
        self.n = words.size
        n_win = words.size - window + 1
        if n_win < 1:
            self.fp = self.ctx = np.zeros(0, np.uint64)
            self.first = self.last = np.zeros(0, np.int64)
            return
        self.seq, self.seq2 = Sequences(words), Sequences(words, 1)
        at = np.arange(words.size - gram + 1)
        grams = self.seq.of(at, at + gram)
        # rank by a second mix, so that the choice is independent of the index's order; ties go to the left
        rank = (mix(grams ^ U(0x2545F4914F6CDD1D)) & U(0xFFFFFFFF00000000)) | at.astype(np.uint64)
        chosen = (sliding_min(rank, window - gram + 1) & U(0xFFFFFFFF)).astype(np.int64)
        cut = np.flatnonzero(np.diff(chosen)) + 1
        self.first = np.concatenate([[0], cut])
        self.last = np.append(cut, n_win) - 1
        place = chosen[self.first]
        self.fp = grams[place]
        self.ctx = mix(self.seq2.of(self.first, self.last + window) + (place - self.first).astype(np.uint64))


def index_rows(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """fp, ctx, c, src: the index entries of (key, text) rows, counted slice by slice before any shuffle."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                runs = [Runs(t.as_py(), window, gram) for t in part.column(1)]
                fp, ctx = (np.concatenate([getattr(r, x) for r in runs]) for x in ("fp", "ctx"))
                src = np.repeat(part.column(0).to_numpy(), [r.fp.size for r in runs])
                order = np.lexsort((ctx, fp))
                fp, ctx, src = fp[order], ctx[order], src[order]
                new = np.flatnonzero(np.concatenate([[True], (fp[1:] != fp[:-1]) | (ctx[1:] != ctx[:-1])])) if fp.size else np.zeros(0, np.int64)
                count = np.diff(np.append(new, fp.size))
                yield pa.RecordBatch.from_arrays([pa.array(fp[new].view(np.int64)), pa.array(ctx[new].view(np.int64)), pa.array(count.astype(np.int32)), pa.array(src[new])], names=["fp", "ctx", "c", "src"])

    return map_arrow(docs.select("key", "text"), run, ENTRY)


def occurrences(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """key, fp, ctx, first, last of every run of (key, text) rows."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                runs = [Runs(t.as_py(), window, gram) for t in part.column(1)]
                rows = pa.array(np.repeat(np.arange(len(runs)), [r.fp.size for r in runs]))
                join = lambda name, kind: pa.array(np.concatenate([getattr(r, name) for r in runs]).astype(kind, copy=False))
                ints = [pa.array(np.concatenate([getattr(r, name) for r in runs]).view(np.int64)) for name in ("fp", "ctx")]
                yield pa.RecordBatch.from_arrays([part.column(0).take(rows), *ints, join("first", np.int32), join("last", np.int32)], names=["key", "fp", "ctx", "first", "last"])

    return map_arrow(docs.select("key", "text"), run, "key long, fp long, ctx long, first int, last int")


class FingerprintIndex:
    """Immutable runs of (fp, ctx, c, src), bucketed and sorted by fp, as tables over the shared folder.

    The manifest's latest version in ``home`` lists the runs, the oldest first, so an index can be opened again.
    """

    def __init__(self, spark: SparkSession, buckets: int, home: str | None = None):
        self.spark, self.buckets = spark, buckets
        self.home = home or new_path(spark, "fingerprints")
        self.runs: list[tuple[str, str, int]] = []  # table, path, entries
        self.version = 0
        self.batches: list[str] = []  # taken in by earlier calls
        self.replaced: list[tuple[str, str, int]] = []  # listed by the manifest still, not by the next one
        if home and path_exists(spark, f"{home}/manifest"):
            held = spark.read.parquet(f"{home}/manifest")
            self.version = held.agg(F.max("version").alias("v")).first()["v"]
            for r in held.where(F.col("version") == self.version).orderBy("place").collect():  # a few rows: runs grow by tiers
                self.buckets, self.batches = r["buckets"], (r["batches"] or "").split()
                if r["name"]:
                    self.runs.append((r["name"], r["path"], r["entries"]))
                    spark.sql(f"CREATE TABLE IF NOT EXISTS {r['name']} ({ENTRY}) USING parquet CLUSTERED BY (fp) SORTED BY (fp, ctx) INTO {self.buckets} BUCKETS LOCATION '{r['path']}'")

    def publish(self, batch: str | None = None) -> None:
        """A new version of the manifest; only then the runs that it no longer lists go."""
        self.version += 1
        self.batches += [batch] if batch else []
        rows = [(i, *run, self.buckets, " ".join(self.batches)) for i, run in enumerate(self.runs)] or [(0, None, None, 0, self.buckets, " ".join(self.batches))]
        self.spark.createDataFrame(rows, "place int, name string, path string, entries long, buckets int, batches string").coalesce(1).write.mode("overwrite").parquet(f"{self.home}/manifest/version={self.version}")
        for name, path, _ in self.replaced:
            self._drop(name, path)
        self.replaced = []

    def _drop(self, name: str, path: str) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        drop_path(self.spark, path)

    def _write(self, rows: DataFrame) -> tuple[str, str, int]:
        name = f"fingerprints_{uuid.uuid4().hex}"
        path = f"{self.home}/{name}"
        rows.sortWithinPartitions("fp", "ctx").write.bucketBy(self.buckets, "fp").sortBy("fp", "ctx").option("path", path).option("compression", "zstd").saveAsTable(name)
        return name, path, self.spark.table(name).count()

    def add(self, entries: DataFrame) -> DataFrame:
        """A batch's entries become a new run; one shuffle deals them to their buckets. Returns the batch's hits (fp)."""
        dealt = entries.repartition(self.buckets, "fp").groupBy("fp", "ctx").agg(F.sum("c").cast("int").alias("c"), F.min("src").alias("src"))
        self.runs.append(self._write(dealt))
        return self.hits(len(self.runs) - 1)

    def hits(self, run: int) -> DataFrame:
        """Fingerprints of a run that it repeats or that earlier runs hold too: merge joins of sorted buckets."""
        new = self.spark.table(self.runs[run][0])
        own = new.groupBy("fp").agg(F.sum("c").alias("n"))
        old = [own.hint("merge").join(self.spark.table(name).select("fp").distinct().hint("merge"), "fp").select("fp") for name, _, _ in self.runs[:run]]
        return reduce(DataFrame.unionByName, [own.where("n > 1").select("fp"), *old]).repartition(self.buckets, "fp").distinct()

    def compact(self, every: bool = False, publish: bool = True) -> None:
        """Merge the latest runs while the one before them is not TIER times as large (or all); then publish, now or later."""
        at = len(self.runs) - 1
        while at > 0 and (every or self.runs[at - 1][2] < TIER * sum(n for _, _, n in self.runs[at:])):
            at -= 1
        gone = self.runs[at:] if len(self.runs) - at > 1 else []
        if gone:
            # the cast makes each side a row-wise plan: Spark 4.1 takes a union of columnar bucketed scans for
            # bucketed although it only strings their partitions together
            rows = [self.spark.table(name).select("fp", "ctx", F.col("c").cast("long").alias("c"), "src") for name, _, _ in gone]
            merged = reduce(DataFrame.unionByName, rows).groupBy("fp", "ctx").agg(F.sum("c").cast("int").alias("c"), F.min("src").alias("src"))
            self.runs = [*self.runs[:at], self._write(merged)]
            self.replaced += gone
        if publish:
            self.publish()

    def entries(self) -> DataFrame:
        """All entries; contexts that several runs hold are summed."""
        rows = [self.spark.table(name).select("fp", "ctx", F.col("c").cast("long").alias("c"), "src") for name, _, _ in self.runs]
        return rows[0] if len(rows) == 1 else reduce(DataFrame.unionByName, rows).groupBy("fp", "ctx").agg(F.sum("c").alias("c"), F.min("src").alias("src"))

    def close(self) -> None:
        """Delete the index."""
        for name, path, _ in [*self.runs, *self.replaced]:
            self._drop(name, path)
        drop_path(self.spark, self.home)

    def repeated(self, own: DataFrame) -> DataFrame:
        """Fingerprints of ``own`` (fp), which are in the index, that it holds more than once."""
        return self.entries().join(own.select("fp").distinct(), "fp", "left_semi").groupBy("fp").agg(F.sum("c").alias("n")).where("n > 1").select("fp")

    def status(self, hits: DataFrame) -> DataFrame:
        """fp, ctx, src, full, rival of the contexts of hits. full: the context itself repeats;
        rival: another context of the fingerprint does not, so windows have to be compared."""
        held = self.entries().join(hits, "fp", "left_semi")
        per = held.groupBy("fp").agg(F.count_if(F.col("c") == 1).alias("single"))
        return held.join(per, "fp").select("fp", "ctx", "src", (F.col("c") > 1).alias("full"), (F.col("single") > 0).alias("rival"))


def _first_pass(joined: DataFrame, window: int, gram: int) -> DataFrame:
    """Results of texts without open runs; for the others their windows' hashes, settled runs and text."""
    spans = T.ArrayType(T.StructType([T.StructField("first", T.IntegerType()), T.StructField("last", T.IntegerType())]))
    wins = T.ArrayType(T.StructType([T.StructField("h0", T.LongType()), T.StructField("h1", T.LongType()), T.StructField("s", T.IntegerType()), T.StructField("w", T.IntegerType())]))
    schema = T.StructType([joined.schema["id"], joined.schema["key"], T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept_sha256", T.StringType()), T.StructField("windows", wins), T.StructField("settled", spans), T.StructField("text", T.StringType()), T.StructField("here", T.BooleanType())])
    spans_pa = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))
    wins_pa = pa.list_(pa.struct([("h0", pa.int64()), ("h1", pa.int64()), ("s", pa.int32()), ("w", pa.int32())]))

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                out = [[] for _ in range(6)]
                for text, marks in zip(part.column(2).to_pylist(), part.column(3).to_pylist(), strict=True):
                    words = text.encode().split()
                    marks = marks or []
                    spans = [(m["first"], m["last"]) for m in marks if m["kind"] == 0]
                    hashed, open_ = [], False
                    if any(m["kind"] for m in marks):
                        seqs = Runs(text, window, gram)
                        for m in marks:
                            if m["kind"]:
                                s = np.arange(m["first"], m["last"] + 1)
                                h0, h1 = seqs.seq.of(s, s + window).view(np.int64).tolist(), seqs.seq2.of(s, s + window).view(np.int64).tolist()
                                hashed += [{"h0": a, "h1": b, "s": c, "w": m["kind"]} for a, b, c in zip(h0, h1, s.tolist(), strict=True)]
                                open_ |= m["kind"] == 1
                    removed, sha = (None, None) if open_ else kept_digest(words, spans, window)
                    row = (len(words), removed, sha, hashed, [{"first": a, "last": b} for a, b in spans] if open_ else [], text if open_ else None)
                    for col, v in zip(out, row, strict=True):
                        col.append(v)
                kinds = [pa.int64(), pa.int64(), pa.string(), wins_pa, spans_pa, pa.string()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *(pa.array(c, k) for c, k in zip(out, kinds, strict=True)), part.column(4)], names=schema.fieldNames())

    return map_arrow(joined.select("id", "key", "text", "marks", "here"), run, schema)


def kept_digest(words: list[bytes], spans: list[tuple[int, int]], window: int) -> tuple[int, str]:
    """(words removed, SHA-256 of the kept ones) when the windows starting in ``spans`` are cut."""
    if spans:
        step = np.zeros(len(words) + 1, np.int64)
        for first, last in spans:
            step[first] += 1
            step[last + window] -= 1
        keep = np.cumsum(step[:-1]) == 0
        kept = [w for w, k in zip(words, keep.tolist(), strict=True) if k]
    else:
        kept = words
    return len(words) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()


def _second_pass(joined: DataFrame, window: int) -> DataFrame:
    schema = T.StructType([joined.schema["id"], T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept_sha256", T.StringType())])

    def run(batches):
        for batch in batches:
            removed, sha = [], []
            for text, settled, starts in zip(batch.column(2), batch.column(3), batch.column(4), strict=True):
                spans = [(m["first"], m["last"]) for m in settled.as_py()] + [(s, s) for s in starts.as_py() or []]
                r, h = kept_digest(text.as_py().encode().split(), spans, window)
                removed.append(r)
                sha.append(h)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(removed, pa.int64()), pa.array(sha)], names=schema.fieldNames())

    return map_arrow(joined.select("id", "n_words", "text", "settled", "starts"), run, schema)


def remove_repeats(docs: DataFrame, batches: int = 2, window: int = WINDOW, gram: int = GRAM, id_col: str = "doc_id", text_col: str = "text", home: str | None = None, batch: str | None = None) -> DataFrame:
    """Per row: id, n_words, n_removed, kept_sha256, after taking ``docs`` into the index in ``batches``.

    With a ``home`` that earlier calls used, passages repeat also where those calls' rows hold them. ``batch`` (without blanks) names
    the rows of this call: made again, whether it broke off or not, the call gives the same and counts them once.
    """
    spark = docs.sparkSession
    work, text = Scratch(spark), text_or_empty(text_col)
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.col(id_col), text).alias("key"), text.alias("text"))
    index = FingerprintIndex(spark, max(8, n_slices(docs) // SLICES_PER_BUCKET), home)
    earlier, batch = None, batch or uuid.uuid4().hex
    known = batch in index.batches
    if home:
        others = [f"{home}/contents/{b}" for b in index.batches if b != batch]
        if others:
            earlier = spark.read.schema("key long, text string").parquet(*others)
        if not known:
            rows.select("key", "text").write.mode("overwrite").option("compression", "zstd").parquet(f"{home}/contents/{batch}")
    name = f"hits_{uuid.uuid4().hex}"  # bucketed like the runs, so that no join with them moves these
    path = new_path(spark, "repeat-hits")
    for i in range(batches):
        part = index_rows(rows.where(F.pmod(F.xxhash64("key", F.lit(5)), F.lit(batches)) == i), window, gram)
        hits = index.repeated(part) if known else index.add(part)
        hits.write.mode("append").bucketBy(index.buckets, "fp").option("path", path).saveAsTable(name)
        if not known:
            index.compact(every=i == batches - 1 and not home, publish=not home)
    if home and not known:
        index.publish(batch)
    status = work.spill(index.status(spark.table(name)), "repeated")
    spark.sql(f"DROP TABLE {name}")
    drop_path(spark, path)
    if not home:
        index.close()

    # kinds: 0 settled, 1 to be compared, 2 stands for a context in the comparison
    marks = work.spill(occurrences(rows, window, gram).join(status.drop("src"), ["fp", "ctx"]), "repeat-marks")
    settled = marks.where("full").select("key", "first", "last", F.lit(0).alias("kind"))
    compare = marks.where("not full").select("key", "first", "last", F.lit(1).alias("kind"))
    stand = marks.where("full and rival").groupBy("fp", "ctx").agg(F.min(F.struct("key", "first", "last")).alias("m")).select("m.*", F.lit(2).alias("kind"))
    parts, every = [settled, compare, stand], rows.withColumn("here", F.lit(True))
    if earlier is not None:
        # the contexts that only earlier rows hold: one text for each, read again
        asked = marks.where("not full").select("fp").distinct()
        only = status.join(asked, "fp", "left_semi").join(marks.select("fp", "ctx"), ["fp", "ctx"], "left_anti")
        past = work.spill(earlier.join(only.select(F.col("src").alias("key")).distinct(), "key", "left_semi").distinct(), "repeat-past")
        held = occurrences(past, window, gram).join(only.select("fp", "ctx"), ["fp", "ctx"])
        parts.append(held.select("key", "first", "last", F.lit(2).alias("kind")))
        every = every.unionByName(past.select(F.lit(None).cast(rows.schema["id"].dataType).alias("id"), "key", "text", F.lit(False).alias("here")))
    lists = reduce(DataFrame.unionByName, parts).groupBy(F.col("key").alias("m_key")).agg(F.collect_set(F.struct("first", "last", "kind")).alias("marks"))  # at most a text's runs
    joined = every.join(lists, F.col("key") == F.col("m_key"), "left")
    done = work.spill(_first_pass(joined, window, gram), "repeat-first-pass")
    work.free(marks, status)

    wins = done.select("key", F.explode("windows").alias("x")).select("key", "x.*")
    twice = wins.groupBy("h0", "h1").agg(F.sum("w").alias("n")).where("n > 1").drop("n")
    starts = wins.where("w = 1").join(twice, ["h0", "h1"]).groupBy(F.col("key").alias("s_key")).agg(F.collect_set("s").alias("starts"))  # at most a text's windows
    rest = done.where("here and text is not null").join(starts, F.col("key") == F.col("s_key"), "left")
    final = done.where("here and text is null").select("id", "n_words", "n_removed", "kept_sha256").unionByName(_second_pass(rest, window))
    return final.withColumnRenamed("id", id_col)
