"""Multi-label metrics in long form: one row per (row, class)."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.stem import stemmed_words

EPS = 1e-10


def long_labels(df: DataFrame, row: str, col: str, cls: str = "class") -> DataFrame:
    return df.select(row, F.explode(col).alias(cls)).distinct()


def signed_labels(df: DataFrame, row: str, col: str, size: int) -> DataFrame:
    """1-based signed indices as (row, class from 0, value 1 or -1); 0 and indices beyond ``size`` go."""
    return df.select(row, F.explode(col).alias("_i")).where((F.col("_i") != 0) & (F.abs("_i") <= size)).select(row, (F.abs("_i") - 1).alias("class"), F.signum(F.col("_i").cast("double")).alias("value")).distinct()


def labels_to_lists(long: DataFrame, rows: DataFrame, row: str, cls: str = "class") -> DataFrame:
    """Sorted lists per row, [0] for rows without a label."""
    lists = long.groupBy(row).agg(F.sort_array(F.collect_set(cls)).alias("labels"))
    return rows.select(row).distinct().join(lists, row, "left").withColumn("labels", F.coalesce("labels", F.array(F.lit(0).cast(dict(long.dtypes)[cls]))))


def _joined(targets: DataFrame, preds: DataFrame, row: str, cls: str, known: DataFrame | None) -> DataFrame:
    if known is not None:
        preds = preds.join(known.select(cls).distinct(), cls, "left_semi")
    t = targets.select(row, cls).distinct().withColumn("t", F.lit(1))
    p = preds.select(row, cls).distinct().withColumn("p", F.lit(1))
    return t.join(p, [row, cls], "full").na.fill(0, ["t", "p"])


def confusion(targets: DataFrame, preds: DataFrame, n_rows: Column | int, row: str = "row_id", cls: str = "class", known: DataFrame | None = None) -> DataFrame:
    """class, tp, fp, fn, tn. Predictions outside ``known`` do not count."""
    n_rows = F.lit(n_rows) if isinstance(n_rows, int) else n_rows
    j = _joined(targets, preds, row, cls, known)
    tp, fp, fn = (F.sum(F.expr(e).cast("long")) for e in ("t * p", "(1 - t) * p", "t * (1 - p)"))
    return j.groupBy(cls).agg(tp.alias("tp"), fp.alias("fp"), fn.alias("fn")).withColumn("tn", n_rows - F.col("tp") - F.col("fp") - F.col("fn"))


def class_table(conf: DataFrame, cls: str = "class") -> DataFrame:
    return conf.select(cls, (F.col("tp") + F.col("fn")).alias("freq"), "tp", "fp", "fn", _f1(F.col("tp"), F.col("fp"), F.col("fn")).alias("f1"))


def _f1(tp: Column, fp: Column, fn: Column) -> Column:
    p, r = tp / (tp + fp + EPS), tp / (tp + fn + EPS)
    return 2 * p * r / (p + r + EPS)


def micro_macro(targets: DataFrame, preds: DataFrame, rows: DataFrame, row: str = "row_id", cls: str = "class", known: DataFrame | None = None) -> DataFrame:
    """One row: micro and macro precision, recall, F1, specificity, exact-match accuracy, bias ratio.

    Macro values are means over the classes that occur in targets or predictions.
    """
    n = rows.select(row).distinct().agg(F.count("*").alias("n_rows"))
    conf = confusion(targets, preds, 0, row, cls, known).crossJoin(F.broadcast(n)).withColumn("tn", F.col("n_rows") + F.col("tn"))  # one row
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    sums = [F.sum(c) for c in ("tp", "fp", "fn", "tn")]
    agg = conf.agg(
        (sums[0] / (sums[0] + sums[1] + EPS)).alias("micro_precision"),
        (sums[0] / (sums[0] + sums[2] + EPS)).alias("micro_recall"),
        _f1(*sums[:3]).alias("micro_f1"),
        (sums[3] / (sums[3] + sums[1] + EPS)).alias("specificity"),
        F.avg(tp / (tp + fp + EPS)).alias("macro_precision"),
        F.avg(tp / (tp + fn + EPS)).alias("macro_recall"),
        F.avg(_f1(tp, fp, fn)).alias("macro_f1"),
        ((sums[0] + sums[1]) / (sums[0] + sums[2] + EPS)).alias("ratio"),
    )
    wrong = _joined(targets, preds, row, cls, known).where("t <> p").agg(F.countDistinct(row).alias("wrong")).crossJoin(F.broadcast(n))
    return agg.crossJoin(F.broadcast(wrong.select((1 - F.col("wrong") / F.col("n_rows")).alias("accuracy"))))  # one row each


def ranked_recall(terms: DataFrame, term_codes: DataFrame, targets: DataFrame, ranks: Sequence[int], row: str = "row_id", parts: int | None = None) -> DataFrame:
    """k, tp, seen, fn and micro precision and recall of the codes of the first k terms.

    ``terms``: row, term_id, rank from 1. Rows with fewer than k terms count as having found nothing.
    ``parts``: in how many parts rows are dealt, so that a task's share does not grow with the input.
    """
    spark = terms.sparkSession
    dealt = lambda df: df.repartition(parts, row) if parts else df
    found = terms.join(term_codes, "term_id").select(row, "code", "rank", F.lit(None).cast("int").alias("t"))
    wanted = targets.select(row, "code", F.lit(None).cast(terms.schema["rank"].dataType).alias("rank"), F.lit(1).alias("t"))
    pairs = dealt(found.union(wanted)).groupBy(row, "code").agg(F.min("rank").alias("rank"), F.max("t").alias("t"))
    lengths = dealt(terms.select(row, "rank")).groupBy(row).agg(F.max("rank").alias("n_terms"))
    # a null code is no hit
    hits = pairs.where("rank is not null").withColumn("t", F.when(F.col("code").isNotNull(), F.col("t"))).join(lengths, row)
    ks = spark.createDataFrame([(k,) for k in ranks], "k int")
    found = hits.join(F.broadcast(ks), F.col("rank") <= F.col("k")).where("n_terms >= k").groupBy("k").agg(F.count("*").alias("seen"), F.count("t").alias("tp"))
    total = pairs.agg(F.count("t").alias("total"))
    out = ks.join(found, "k", "left").na.fill(0).crossJoin(F.broadcast(total))
    return out.select("k", "tp", "seen", (F.col("total") - F.col("tp")).alias("fn"), F.when(F.col("seen") > 0, F.col("tp") / F.col("seen")).otherwise(0.0).alias("precision"), F.when(F.col("total") > 0, F.col("tp") / F.col("total")).otherwise(0.0).alias("recall"))


def set_precision_recall(df: DataFrame, pred: str, gold: str) -> DataFrame:
    p, g = F.array_distinct(pred), F.array_distinct(gold)
    s = df.agg(F.sum(F.size(F.array_intersect(p, g))).alias("tp"), F.sum(F.size(p)).alias("np"), F.sum(F.size(g)).alias("ng"))
    ratio = lambda n: F.when(F.col(n) > 0, F.col("tp") / F.col(n)).otherwise(0.0)
    return s.select(ratio("np").alias("precision"), ratio("ng").alias("recall"))


def row_scores(df: DataFrame, gold: str, pred: str) -> DataFrame:
    """Exact match, precision, recall, F1, positive and negative ratio of every row; empty against empty is 1."""
    g, p = F.array_distinct(gold), F.array_distinct(pred)
    tp, ng, np_ = F.size(F.array_intersect(g, p)), F.size(g), F.size(p)
    both = (ng == 0) & (np_ == 0)
    safe = lambda a, b: F.when(both, 1.0).when(b == 0, 0.0).otherwise(a / b)
    return (
        df.withColumn("exact_match", ((tp == ng) & (tp == np_)).cast("double"))
        .withColumn("precision", safe(tp, np_))
        .withColumn("recall", safe(tp, ng))
        .withColumn("f1", safe(2 * tp, ng + np_))
        .withColumn("positive_ratio", safe(np_, ng))
        .withColumn("negative_ratio", (ng == 0).cast("double") - (np_ == 0).cast("double"))
    )


def match_count(gold: str, pred: str) -> Column:
    """``i/n`` matches of the gold labels; 1/1 when both are empty."""
    n = F.size(F.array_distinct(gold))
    i = F.size(F.array_intersect(gold, pred))
    return F.when((n == 0) & (F.size(pred) == 0), F.lit("1/1")).otherwise(F.concat_ws("/", i.cast("string"), n.cast("string")))


def calibration(df: DataFrame, prob: str, correct: Column, bins: int) -> DataFrame:
    """bin, mid, accuracy, n for all ``bins`` half-open bins; empty ones are 0 and probability 1 is left out."""
    found = df.where((F.col(prob) >= 0) & (F.col(prob) < 1)).groupBy(F.floor(F.col(prob) * bins).cast("int").alias("bin")).agg(F.avg(correct.cast("double")).alias("accuracy"), F.count("*").alias("n"))
    every = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return every.join(found, "bin", "left").select("bin", ((F.col("bin") + 0.5) / bins).alias("mid"), F.coalesce("accuracy", F.lit(0.0)).alias("accuracy"), F.coalesce("n", F.lit(0)).alias("n"))


def cross_entropy(pred: Column, target: Column, eps: float = 1e-7) -> Column:
    """Sum over targets of -ln(clip(1 if predicted else 0))."""
    return F.aggregate(target, F.lit(0.0), lambda acc, t: acc - F.ln(F.when(F.array_contains(pred, t), F.lit(1.0 - eps)).otherwise(F.lit(eps))))


def coverage(a: DataFrame, b: DataFrame, col: str) -> tuple[DataFrame, DataFrame]:
    """(share of b's values that a has, the values it lacks)."""
    x, y = a.select(col).distinct(), b.select(col).distinct()
    hit = y.join(x.withColumn("_h", F.lit(1)), col, "left")
    return hit.agg((F.count("_h") / F.count("*")).alias("recall"), F.count("_h").alias("found"), F.count("*").alias("total")), y.join(x, col, "left_anti")


def rouge_l(pred: Column, ref: Column) -> Column:
    """F1 of the longest common word sequence (lower-cased words), in Arrow batches."""
    @F.pandas_udf("double")
    def score(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([_lcs_f1((x or "").lower().split(), (y or "").lower().split()) for x, y in zip(a, b, strict=True)])

    return score(pred, ref)


def rouge_l_stemmed(pred: Column, ref: Column) -> Column:
    """F1 of the longest common sequence of stemmed words (see ``stem.stemmed_words``); 0 where a side has none."""
    @F.pandas_udf("double")
    def score(a: pd.Series, b: pd.Series) -> pd.Series:
        words = ((stemmed_words(x or ""), stemmed_words(y or "")) for x, y in zip(a, b, strict=True))
        return pd.Series([_lcs_f1(x, y) if x and y else 0.0 for x, y in words], dtype="float64")

    return score(pred, ref)


def mean_rouge(pairs: DataFrame, pred: str, ref: str, by: str | None = None) -> DataFrame:
    """The mean stemmed Rouge-L over rows (per ``by``) as ``rouge``; no rows give 0 without ``by``, no groups with it."""
    keys = [by] if by else []
    return pairs.select(*keys, rouge_l_stemmed(F.col(pred), F.col(ref)).alias("_f")).groupBy(*keys).agg(F.coalesce(F.avg("_f"), F.lit(0.0)).alias("rouge"))


def _lcs_f1(a: list[str], b: list[str]) -> float:
    """By the bit-parallel form: a set bit of ``row`` is a place of b that does not lengthen the sequence."""
    if not a or not b:
        return float(a == b)
    places: dict[str, int] = {}
    for j, y in enumerate(b):
        places[y] = places.get(y, 0) | 1 << j
    row = full = (1 << len(b)) - 1
    for x in a:
        met = row & places.get(x, 0)
        row = ((row + met) | (row - met)) & full
    return 2 * (len(b) - row.bit_count()) / (len(a) + len(b))


def seen_classes_scores(targets: DataFrame, preds: DataFrame, row: str = "row_id", cls: str = "class") -> DataFrame:
    """Micro precision and recall over the classes that occur in the targets; 0 where nothing is divided by."""
    j = _joined(targets, preds, row, cls, targets)
    s = j.agg(F.sum(F.expr("t * p")).alias("tp"), F.sum("p").alias("n_pred"), F.sum("t").alias("n_gold"))
    ratio = lambda n: F.when(F.col(n) > 0, F.col("tp") / F.col(n)).otherwise(0.0)
    return s.select(ratio("n_pred").alias("precision"), ratio("n_gold").alias("recall"))


def listed_labels(df: DataFrame, row: str, ids: str, classes: str, cls: str = "class") -> DataFrame:
    """(row, class) of 1-based ids into the row's own class list, given as text of integers between commas.

    What is no integer, 0 and ids beyond the list are left out.
    """
    number = F.explode(F.transform(F.split(F.coalesce(ids, F.lit("")), ","), lambda x: F.trim(x).try_cast("int"))).alias("_i")
    return df.select(row, classes, number).where((F.col("_i") > 0) & (F.col("_i") <= F.size(classes))).select(row, F.element_at(classes, F.col("_i")).alias(cls)).distinct()


def split_by_outcome(df: DataFrame, row: str, probs: str, labels: str, gold: str) -> DataFrame:
    """row, pos, prob, correct: the probabilities of parallel lists, by whether the label is one of the gold ones."""
    z = df.select(row, gold, F.posexplode(F.arrays_zip(F.col(probs).alias("p"), F.col(labels).alias("l"))).alias("pos", "z"))
    return z.select(row, "pos", F.col("z.p").alias("prob"), F.array_contains(gold, F.col("z.l")).alias("correct"))


def class_balance(df: DataFrame, targets: str) -> DataFrame:
    """size, n, percent: rows by their number of labels; size 0 is the negative class."""
    n = df.groupBy(F.size(F.coalesce(targets, F.array().cast("array<string>"))).alias("size")).agg(F.count("*").alias("n"))
    total = df.agg(F.count("*").alias("_t"))
    return n.crossJoin(F.broadcast(total)).select("size", "n", (100.0 * F.col("n") / F.col("_t")).alias("percent"))  # one row
