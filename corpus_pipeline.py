"""The corpus pipeline: five stages over ``documents``, each written as Parquet and reread.

Stages take (spark, docs, sf_dir) and return a DataFrame; all but the last return the columns of
``documents``. Null and empty texts pass the first stage, are copies of each other in the second and
link with nothing in the third. Empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chartloom.llm.common import scratch_names, spill, table
from chartloom.llm.exact_dedup import without_copies
from chartloom.llm.mixing import copies, fit_mixing
from chartloom.llm.ngram_join import without_near_copies
from chartloom.llm.packing import pack_documents
from chartloom.llm.queries import TARGET_WEIGHTS, held_out, labelled_domains, vocabulary
from chartloom.llm.toxicity import fit_toxicity

#: Documents whose calibrated toxicity reaches this go.
REJECT_SCORE = 0.3
#: Every document stays at least once; the corpus may grow by a quarter to come nearer the targets.
LEAST_RATE, TOKEN_BUDGET = 1.0, 1.25


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2. A score belongs to a text, so the decision is taken where the text is read."""
    columns = docs.columns
    model = fit_toxicity(docs, table(spark, sf_dir, "labels"), usable=~held_out())
    scored = model.score(docs.select(F.struct(*columns).alias("whole_row")), id_col="whole_row")
    return scored.where(F.col("score") < REJECT_SCORE).select(*(F.col("whole_row")[c].alias(c) for c in columns))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9. The row with the smallest doc_id of equal texts stays."""
    return without_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8. Five-word shingles, similarity 0.8; the row with the smallest doc_id of each group stays."""
    return without_near_copies(docs, k=5, num=80, den=100)


def mix_to_targets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5. A document is repeated by its rate; nothing that the filters kept is lost."""
    labelled = labelled_domains(docs, table(spark, sf_dir, "labels"))
    model, _ = fit_mixing(docs, labelled, TARGET_WEIGHTS, budget=TOKEN_BUDGET, floor=LEAST_RATE, iterations=15, tolerance=1e-3, vocabulary=vocabulary())
    names = scratch_names(docs, "mix_rate", "mix_domain", "mix_posterior", "mix_copy")
    rated = model.apply(docs, names=(None, *names[:3]))
    times = copies(F.col(names[0]), F.col("doc_id"))
    return rated.where(times > 0).withColumn(names[3], F.explode(F.sequence(F.lit(1), times))).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6. Sequences of at most 4096 tokens."""
    return pack_documents(docs, vocabulary(), capacity=4096, end_id=1)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_copies),
    ("n-gram join", drop_near_copies),
    ("mixing", mix_to_targets),
    ("packing", pack),
]

#: Learned scores and rates are not expressible in SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = spill(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
