"""Mixing to target weights with soft domain membership.

A classifier fitted on a bounded sample of a labelled table gives every document a posterior over
domains. Rates r >= floor for the documents are then fitted so that the expected token totals
sum(r * tokens * posterior) of the domains match their targets: least squares by projected gradient.
The gradient is taken in the metric of the documents' tokens and whitened by the K x K matrix
sum(tokens * posterior * posterior'), for which the step 1 is the inverse Lipschitz constant. A
document's rate depends only on its posterior and on the K-vectors of the past steps, so an iteration
is one narrow pass that sums K numbers, and only K numbers reach the driver.

Tokens are those of the byte pair encoding that operators 1 and 6 count and pack, not words.

Null and empty texts have no tokens; they get a rate but move no total. Rows of the labelled table
without a domain are ignored, repeated ones count as often as they occur, ids that ``docs`` lacks do
nothing. Targets of domains the sample lacks are left out and the others rescaled. Without any
domain every rate is 1. An empty frame gives an empty frame. ``MixingModel.off`` says how far each domain's total is
from its target at the end, as a share of all tokens.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import chunk_bpe
from .common import drop_path, map_arrow, new_path, scratch_names, spill, text_or_empty

MAX_LABELLED = 4_000
PAIRS = 512
STORED_STEPS = 8
WIDTH = PAIRS + 256


def byte_profile(text: str) -> np.ndarray:
    """Square roots of the relative frequencies of bytes and hashed byte pairs."""
    raw = np.frombuffer(text.encode(), np.uint8)
    out = np.zeros(WIDTH)
    if raw.size:
        out[:256] = np.bincount(raw, minlength=256) / raw.size
        pair = (raw[:-1].astype(np.uint16) * np.uint16(40503) + raw[1:].astype(np.uint16) * np.uint16(30011)) >> np.uint16(7)
        out[256:] = np.bincount(pair, minlength=PAIRS) / raw.size
    return np.sqrt(out)


@dataclass
class DomainClassifier:
    domains: list[str]
    weights: np.ndarray  # WIDTH x K
    bias: np.ndarray

    def posteriors(self, texts: list[str]) -> np.ndarray:
        z = np.stack([byte_profile(t) for t in texts]) @ self.weights + self.bias
        e = np.exp(z - z.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)


def fit_classifier(docs: DataFrame, labelled: DataFrame, id_col: str, text_col: str, domain_col: str, max_rows: int = MAX_LABELLED) -> DomainClassifier:
    """Multinomial logistic regression on at most ``max_rows`` labelled rows, chosen by a hash of the id."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector

    known = labelled.select(F.col(id_col).alias("id"), F.col(domain_col).cast("string").alias("domain")).where("domain is not null and id is not null")
    some = known.orderBy(F.xxhash64("id", F.lit(21)), "id", "domain").limit(max_rows)
    schema = T.StructType([T.StructField("domain", T.StringType()), T.StructField("profile", T.ArrayType(T.DoubleType()))])

    def profile(batches):
        for batch in batches:
            rows = [byte_profile(t.as_py()) for t in batch.column(1)]
            flat = pa.array(np.concatenate(rows) if rows else np.zeros(0))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1) * WIDTH, pa.int32()), flat)], names=["domain", "profile"])

    texts = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text")).join(F.broadcast(some), "id")  # at most max_rows
    sample = spill(map_arrow(texts.select("domain", "text"), profile, schema), "mixing-sample").coalesce(4)  # at most max_rows
    domains = sorted(r["domain"] for r in sample.select("domain").distinct().collect())  # at most max_rows
    if len(domains) < 2:
        return DomainClassifier(domains, np.zeros((WIDTH, len(domains))), np.zeros(len(domains)))
    at = F.array_position(F.array(*map(F.lit, domains)), F.col("domain")).cast("double") - 1
    model = LogisticRegression(featuresCol="x", labelCol="y", family="multinomial", maxIter=40, regParam=1e-4, standardization=False).fit(sample.select(array_to_vector("profile").alias("x"), at.alias("y")))
    return DomainClassifier(domains, model.coefficientMatrix.toArray().T.copy(), model.interceptVector.toArray().copy())


@dataclass
class MixingModel:
    classifier: DomainClassifier
    floor: float
    targets: np.ndarray
    totals: np.ndarray | None = None  # reached
    steps: list[np.ndarray] = field(default_factory=list)
    vocabulary: str = ""

    @property
    def off(self) -> dict[str, float]:
        """(total reached - target) / all targeted tokens, by domain."""
        total = self.targets.sum() if self.totals is not None else 0.0
        return {d: float((a - b) / total) if total else 0.0 for d, a, b in zip(self.classifier.domains, self.totals if total else self.targets, self.targets, strict=True)}

    def rates(self, p: np.ndarray) -> np.ndarray:
        return _replay(p, self.steps, self.floor)

    def apply(self, docs: DataFrame, text_col: str = "text", names: tuple[str | None, str, str, str] = ("n_tokens", "rate", "domain", "posterior")) -> DataFrame:
        """All columns of ``docs`` plus tokens (not counted if their name is None), rate, likeliest domain and posterior; one narrow pass."""
        tokens, rate, domain, posterior = names
        kinds = [*([T.StructField(tokens, T.LongType())] if tokens else []), T.StructField(rate, T.DoubleType()), T.StructField(domain, T.StringType()), T.StructField(posterior, T.ArrayType(T.DoubleType()))]
        (text,) = scratch_names(docs, "mixing_text")
        schema = T.StructType([*docs.schema.fields, *kinds])
        classifier, steps, floor = self.classifier, self.steps, self.floor
        vocabulary = self.vocabulary

        def run(batches):
            bpe = chunk_bpe.loaded(vocabulary) if tokens else None
            for batch in batches:
                for at in range(0, batch.num_rows, 512):
                    part = batch.slice(at, 512)
                    texts = part.column(part.num_columns - 1).to_pylist()
                    n = [pa.array(bpe.counts(texts), pa.int64())] if tokens else []
                    p = _posteriors(classifier, texts)
                    names_ = [classifier.domains[k] for k in p.argmax(axis=1)] if p.size else [None] * len(texts)
                    yield pa.RecordBatch.from_arrays(
                        [*part.columns[:-1], *n, pa.array(_replay(p, steps, floor)), pa.array(names_, pa.string()), pa.array(p.tolist(), pa.list_(pa.float64()))], names=schema.fieldNames()
                    )

        return map_arrow(docs.withColumn(text, text_or_empty(text_col)), run, schema)


def _posteriors(classifier: DomainClassifier, texts: list[str]) -> np.ndarray:
    return classifier.posteriors(texts) if classifier.domains and texts else np.zeros((len(texts), len(classifier.domains)))


def _replay(p: np.ndarray, steps: list[np.ndarray], floor: float, rate: np.ndarray | None = None) -> np.ndarray:
    r = np.ones(len(p)) if rate is None else rate
    for y in steps:
        r = np.maximum(floor, r - p @ y)
    return r


def _sums(members: DataFrame, what, size: int) -> np.ndarray:
    """``what(tokens, posteriors, rates)`` -> vector of ``size``, summed over all rows; partial sums per task."""
    schema = T.StructType([T.StructField("k", T.IntegerType()), T.StructField("v", T.DoubleType())])

    def run(batches):
        total = np.zeros(size)
        for batch in batches:
            if batch.num_rows:
                n = batch.column(0).to_numpy(zero_copy_only=False).astype(float)
                p = batch.column(1).flatten().to_numpy().reshape(batch.num_rows, -1)
                total += what(n, p, batch.column(2).to_numpy())
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size, dtype=np.int32)), pa.array(total)], names=["k", "v"])

    out = np.zeros(size)
    for row in map_arrow(members.select("n_tokens", "posterior", "rate" if "rate" in members.columns else F.lit(1.0).alias("rate")), run, schema).groupBy("k").agg(F.sum("v").alias("v")).collect():  # size rows
        out[row["k"]] = row["v"]
    return out


def fit_mixing(
    docs: DataFrame,
    labelled: DataFrame,
    targets: dict[str, float],
    budget: float = 1.0,
    floor: float = 0.0,
    id_col: str = "doc_id",
    text_col: str = "text",
    domain_col: str = "domain",
    max_labelled: int = MAX_LABELLED,
    iterations: int = 40,
    tolerance: float = 1e-4,
    vocabulary: str | None = None,
) -> tuple[MixingModel, DataFrame]:
    """The model and its members table (id, n_tokens, domain, posterior).

    ``targets``: weights by domain; their tokens sum to ``budget`` times the tokens of ``docs``. Stops
    after ``iterations`` or when no total is off by more than ``tolerance`` of all tokens.
    ``vocabulary``: a tokenizer's file, by default that of operators 1 and 6.
    """
    vocabulary = vocabulary or public_tokenizers.path("word_bpe_49k.json")
    classifier = fit_classifier(docs, labelled, id_col, text_col, domain_col, max_labelled)
    k = len(classifier.domains)
    plain = MixingModel(classifier, floor, np.zeros(k), vocabulary=vocabulary)
    members = spill(plain.apply(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), "text").drop("text", "rate"), "mixing-members")
    if not k:
        return plain, members
    got = _sums(members, lambda n, p, r: np.append(((p * n[:, None]).T @ p).ravel(), n.sum()), k * k + 1)
    gram, tokens = got[:-1].reshape(k, k), got[-1]
    weights = np.array([max(0.0, targets.get(d, 0.0)) for d in classifier.domains])
    if not tokens or not weights.sum():
        return plain, members
    model = MixingModel(classifier, floor, weights / weights.sum() * budget * tokens, gram.sum(axis=1), vocabulary=vocabulary)
    inverse = np.linalg.pinv(gram, rcond=1e-9, hermitian=True)
    rated, since, paths = members, [], []  # rates are stored every few steps, so that a step replays few
    for _ in range(iterations):
        off = model.totals - model.targets
        if np.abs(off).max() <= tolerance * tokens:
            break
        model.steps.append(inverse @ off)
        since.append(model.steps[-1])
        if len(since) == STORED_STEPS:
            paths.append(new_path(docs.sparkSession, "mixing-rates"))
            rated, since = spill(_rated(rated, since, floor, k), "mixing-rates", paths[-1]), []
        model.totals = _sums(rated, lambda n, p, r, steps=list(since): (_replay(p, steps, floor, r) * n) @ p, k)
    drop_path(docs.sparkSession, *paths)
    return model, members


def _rated(members: DataFrame, steps: list[np.ndarray], floor: float, k: int) -> DataFrame:
    """n_tokens, posterior and the rate after these further steps."""
    rows = members.select("n_tokens", "posterior", "rate" if "rate" in members.columns else F.lit(1.0).alias("rate"))

    def run(batches):
        for batch in batches:
            p = batch.column(1).flatten().to_numpy().reshape(batch.num_rows, k)
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(_replay(p, steps, floor, batch.column(2).to_numpy()))], names=["n_tokens", "posterior", "rate"])

    return map_arrow(rows, run, rows.schema)


def with_rates(model: MixingModel, members: DataFrame) -> DataFrame:
    """The members table with each row's rate."""
    schema = T.StructType([*members.schema.fields, T.StructField("rate", T.DoubleType())])
    at, steps, floor, k = members.columns.index("posterior"), model.steps, model.floor, len(model.classifier.domains)

    def run(batches):
        for batch in batches:
            p = batch.column(at).flatten().to_numpy().reshape(batch.num_rows, k)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(_replay(p, steps, floor))], names=schema.fieldNames())

    return map_arrow(members, run, schema)


def copies(rate, id_col, salt: int = 31):
    """Column: rate rounded to a whole number of copies by a hash of the id, right in expectation."""
    u = (F.xxhash64(id_col, F.lit(salt)).bitwiseAND(F.lit((1 << 52) - 1))) / F.lit(float(1 << 52))
    return F.floor(rate + u).cast("int")
