"""Toxicity: gradient-boosted trees over dense features, calibrated by isotonic regression.

Features of a whole text: densities of a lexicon mined from the labelled rows (words, and word
beginnings for inflected or compounded forms), lexicon words near a second-person word, capitals,
punctuation and obfuscation rates. Fitting uses a bounded sample of labelled rows (``max_rows``,
taken by a hash of the id), dealt by another hash into rows for the lexicon, the trees and the
calibration; a sample under ``MIN_SPLIT`` rows serves all three. Scoring covers every row in one
narrow pass.

Null and empty texts get a score like any other; labels that are null are ignored, repeated label
rows count by their largest label; without labels of both kinds every row gets their smoothed mean.
An empty frame gives an empty frame.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_arrow, spill, text_or_empty, worker_memo

MAX_ROWS = 8_000
MAX_TERMS = 2_000
MIN_SPLIT = 600
BEGIN = 5  # letters of a word beginning

# Second-person words of the corpus's languages, and letters that digits and signs stand for.
SECOND_PERSON = frozenset("you your yours yourself u tu toi te ton ta tes vous votre vos du dich dir dein deine ihr euch euer ti usted ustedes vosotros vuestro".split())
LOOK_ALIKES = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i"})

FEATURES = ["words", "lexicon", "lexicon_hits", "beginnings", "beginning_hits", "hidden_hits", "second_person", "near_second_person", "capital_words", "capitals", "punctuation", "loud", "obfuscated", "digits", "stretched"]

# Bits of a chunk's code.
LEX, BEG, HID, SEC, CAP, OBF, STR = (1 << k for k in range(7))
NEAR = 5
MEMO_CHUNK = 64


class ChunkCodes:
    """White-space chunk -> bit code, memoised per Python worker; long chunks are not kept."""

    def __init__(self, terms: frozenset[str], memo: int = 250_000):
        self.words = frozenset(t for t in terms if not t.startswith("^"))
        self.begins = frozenset(t[1:] for t in terms if t.startswith("^"))
        self.memo, self.limit = {"": 0}, memo

    def code(self, chunk: str) -> int:
        got = self.memo.get(chunk)
        if got is not None:
            return got
        if len(self.memo) > self.limit:
            self.memo = {"": 0}
        low = chunk.lower()
        core = "".join(c for c in low if c.isalpha())
        out = 0
        if core in self.words:
            out |= LEX
        if len(core) >= BEGIN and core[:BEGIN] in self.begins:
            out |= BEG
        if core in SECOND_PERSON:
            out |= SEC
        if len(core) > 1 and core.upper() in chunk:
            out |= CAP
        inner = low.strip(".,;:!?\"'()[]")
        if core and not inner.isalpha():
            plain = inner.translate(LOOK_ALIKES)
            plain = "".join(c for c in plain if c.isalpha())
            if any(c.isdigit() or c in "@$*!" for c in inner):
                out |= OBF
            if plain != core and (plain in self.words or plain[:BEGIN] in self.begins):
                out |= HID
        if any(a == b == c for a, b, c in zip(core, core[1:], core[2:])):
            out |= STR
        if len(chunk) <= MEMO_CHUNK:
            self.memo[chunk] = out
        return out

    def features(self, text: str) -> list[float]:
        chunks = text.split()
        n = max(1, len(chunks))
        code = np.fromiter(map(self.code, chunks), np.int64, len(chunks))
        hit = (code & (LEX | BEG | HID)) != 0
        you = (code & SEC) != 0
        near = 0
        if hit.any() and you.any():
            cs = np.concatenate([[0], np.cumsum(you)])
            at = np.flatnonzero(hit)
            near = int(np.count_nonzero(cs[np.minimum(at + NEAR + 1, len(code))] - cs[np.maximum(at - NEAR, 0)]))
        count = lambda bit: int(np.count_nonzero(code & bit))
        raw = np.frombuffer(text.encode(), np.uint8)
        size = max(1, raw.size)
        kinds = np.bincount(raw, minlength=128)
        upper, digit = int(kinds[65:91].sum()), int(kinds[48:58].sum())
        punct = int(kinds[33:48].sum() + kinds[58:65].sum() + kinds[91:97].sum() + kinds[123:127].sum())
        lex, beg = count(LEX), count(BEG)
        return [
            float(np.log1p(len(chunks))),
            lex / n,
            float(lex),
            beg / n,
            float(beg),
            float(count(HID)),
            int(you.sum()) / n,
            near / n,
            count(CAP) / n,
            upper / size,
            punct / size,
            int(kinds[33] + kinds[63]) / size,
            count(OBF) / n,
            digit / size,
            count(STR) / n,
        ]


def dense_features(docs: DataFrame, terms: list[str], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and one array column ``features`` (doubles, in the order of FEATURES).

    ``id_col`` may name a struct that holds the text as a field, so that a row's text goes to Python once.
    """
    kind = docs.schema[id_col].dataType
    held, inside = frozenset(terms), isinstance(kind, T.StructType) and text_col not in docs.columns
    schema = T.StructType([T.StructField(id_col, kind), T.StructField("features", T.ArrayType(T.DoubleType()))])
    field_no = kind.fieldNames().index(text_col) if inside else None

    def run(batches):
        codes = worker_memo(("toxicity", held), lambda: ChunkCodes(held))
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                texts = part.column(1) if field_no is None else part.column(0).flatten()[field_no]
                rows = [codes.features(t.as_py() or "") for t in texts]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(rows, pa.list_(pa.float64()))], names=[id_col, "features"])

    return map_arrow(docs.select(id_col, *([] if inside else [text_col])), run, schema)


def mine_terms(sample: DataFrame, text_col: str, label_col: str, max_terms: int = MAX_TERMS) -> list[str]:
    """Words and word beginnings (marked ^) that toxic rows of a bounded sample hold far more often."""
    total = sample.agg(F.count("*").alias("n"), F.sum(label_col).alias("t")).first()
    if not total["n"] or not total["t"]:
        return []
    rate = total["t"] / total["n"]
    words = F.array_distinct(F.filter(F.split(F.lower(F.col(text_col)), r"[^\p{L}]+"), lambda w: F.length(w) > 2))
    begins = F.array_distinct(F.transform(F.filter(words, lambda w: F.length(w) >= BEGIN), lambda w: F.concat(F.lit("^"), F.substring(w, 1, BEGIN))))
    counts = sample.select(F.explode(F.concat(words, begins)).alias("term"), F.col(label_col).cast("double").alias("y")).groupBy("term").agg(F.sum("y").alias("t"), F.count("*").alias("n"))
    part = lambda a, e: F.when(a > 0, a * F.log(a / e)).otherwise(F.lit(0.0))
    ratio = 2 * (part(F.col("t"), F.col("n") * rate) + part(F.col("n") - F.col("t"), F.col("n") * (1 - rate)))
    found = counts.where((F.col("t") >= 4) & (F.col("t") / F.col("n") > min(0.9, 4 * rate))).withColumn("g", ratio).where("g >= 16")
    return [r["term"] for r in found.orderBy(F.desc("g"), "term").limit(max_terms).collect()]


@dataclass
class ToxicityModel:
    terms: list[str]
    trees: object | None
    calibration: object | None
    prior: float

    def score(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """id and ``score`` in 0..1 for every row."""
        if self.trees is None:
            return docs.select(id_col, F.lit(self.prior).alias("score"))
        return self._calibrated(_vectors(dense_features(docs, self.terms, id_col, text_col))).select(id_col, "score")

    def _raw(self, frame: DataFrame) -> DataFrame:
        from pyspark.ml.functions import vector_to_array

        out = self.trees.transform(frame)
        return out.withColumn("raw", vector_to_array("probability")[1])

    def _calibrated(self, frame: DataFrame) -> DataFrame:
        out = self._raw(frame)
        if self.calibration is None:
            return out.withColumn("score", F.col("raw"))
        return self.calibration.transform(out).withColumn("score", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("calibrated"))))


def _vectors(frame: DataFrame) -> DataFrame:
    from pyspark.ml.functions import array_to_vector

    return frame.withColumn("features", array_to_vector("features"))


def fit_toxicity(docs: DataFrame, labels: DataFrame, usable: Column | None = None, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_rows: int = MAX_ROWS) -> ToxicityModel:
    """Learn from at most ``max_rows`` rows of ``labels`` for which ``usable`` holds."""
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.regression import IsotonicRegression

    known = labels.where(F.col(label_col).isNotNull())
    if usable is not None:
        known = known.where(usable)
    known = known.groupBy(id_col).agg(F.max(label_col).cast("int").alias("y"))
    bounded = known.orderBy(F.xxhash64(id_col, F.lit(11)), id_col).limit(max_rows)
    joined = docs.select(id_col, text_or_empty(text_col).alias("text")).join(F.broadcast(bounded), id_col)  # at most max_rows
    sample = spill(joined.withColumn("fold", F.pmod(F.xxhash64(id_col, F.lit(12)), F.lit(10))), "toxicity-sample")

    n = sample.count()
    fold = (lambda a, b: sample.where((F.col("fold") >= a) & (F.col("fold") < b))) if n >= MIN_SPLIT else (lambda a, b: sample)
    terms = mine_terms(fold(0, 5), "text", "y")
    frame = spill(dense_features(sample, terms, id_col, "text").join(sample.select(id_col, "y", "fold"), id_col).coalesce(4), "toxicity-features")
    part = (lambda a, b: _vectors(frame.where((F.col("fold") >= a) & (F.col("fold") < b)))) if n >= MIN_SPLIT else (lambda a, b: _vectors(frame))
    kinds = {r["y"]: r["n"] for r in part(5, 8).groupBy("y").agg(F.count("*").alias("n")).collect()}
    total = sum(kinds.values())
    prior = (kinds.get(1, 0) + 1) / (total + 2)
    if len(kinds) < 2:
        return ToxicityModel(terms, None, None, prior)
    trees = GBTClassifier(featuresCol="features", labelCol="y", maxIter=15, maxDepth=3, stepSize=0.3, maxBins=32, seed=7, minInstancesPerNode=max(1, min(10, total // 50))).fit(part(5, 8))
    model = ToxicityModel(terms, trees, None, prior)
    rows = model._raw(part(8, 10)).select("raw", F.col("y").cast("double").alias("y"))
    if rows.agg(F.countDistinct("y").alias("k")).first()["k"] == 2:
        model.calibration = IsotonicRegression(featuresCol="raw", labelCol="y", predictionCol="calibrated").fit(rows)
    return model
