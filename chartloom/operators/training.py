"""Training sets: notes cut to segments with label places, and notes with positive and sampled negative classes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import location_bounds
from . import sampling
from .intervals import segment_targets
from .sampling import fair_shares, remap, shuffled
from .segments import Segmenter, segment_table

#: Most classes of a label pipeline; they travel with every row.
MAX_CLASSES = 10_000


def _ordered(items: Column, order: str, seed: Column | int) -> Column:
    if order not in ("alphabetical", "random"):
        raise ValueError(f"no order {order!r}")
    return F.sort_array(items) if order == "alphabetical" else shuffled(items, seed)


def label_pipeline(notes: DataFrame, spans: DataFrame, classes: DataFrame, id_col: str, text_col: str, segmenter: Segmenter, negatives: int = -1, seed: int = 0, order: str = "random") -> DataFrame:
    """id, segments (texts), classes (names) and targets: per segment the 1-based places of its classes, [0] for none.

    ``spans``: id, code, start, end (half-open); codes without a class are ignored. ``classes``: code and name, at most
    MAX_CLASSES. A note's classes are its own and ``negatives`` others (all if negative), shuffled or by code. Notes
    without text have no segments.
    """
    known = classes.select("code", "name").dropDuplicates(["code"])
    if known.limit(MAX_CLASSES + 1).count() > MAX_CLASSES:
        raise ValueError(f"more than {MAX_CLASSES} classes")
    table = known.agg(F.sort_array(F.collect_list(F.struct("code", "name"))).alias("_all"))
    cut = segment_table(notes, id_col, text_col, segmenter)
    own = spans.join(F.broadcast(known.select("code")), "code", "left_semi")  # at most MAX_CLASSES
    hits = segment_targets(cut, own, id_col, "seg_no", "code")
    per = hits.groupBy(id_col).agg(F.sort_array(F.collect_list(F.struct("seg_no", "text", "targets"))).alias("_s"), F.array_distinct(F.flatten(F.collect_list("targets"))).alias("_p"))
    none = F.array().cast("array<string>")
    rows = notes.select(id_col).join(per, id_col, "left").crossJoin(F.broadcast(table))  # one row
    chosen = sampling.negatives(F.transform("_all", lambda x: x["code"]), F.coalesce("_p", none), negatives, seed)
    rows = rows.withColumn("_c", _ordered(chosen, order, seed))
    # a one-item array binds the map, so that a row makes it once
    named = F.transform(F.array(F.map_from_entries("_all")), lambda m: F.transform("_c", lambda c: F.element_at(m, c)))[0]
    segs = F.coalesce("_s", F.array().cast(rows.schema["_s"].dataType))
    return rows.select(id_col, F.transform(segs, lambda s: s["text"]).alias("segments"), named.alias("classes"), F.transform(segs, lambda s: remap(s["targets"], F.col("_c"))).alias("targets"))


def label_rows(rows: DataFrame, aid: Column, text: str, classes: str, spans: Column, segmenter: Segmenter, negatives: int = -1, seed: int = 0, order: str = "random") -> DataFrame:
    """aid, segments, classes (names) and targets of rows that carry their own classes: as ``label_pipeline``, with a map of
    code to name in each row instead of one table.

    ``spans``: array of (code, start, end), half-open; codes that are no class of the row are ignored. Rows without spans (null) have no
    classes and no targets, those without text no segments; ``aid`` names a row once.
    """
    none = F.array().cast("array<string>")
    base = rows.select(aid.alias("aid"), F.col(text).alias("text"), F.col(classes).alias("_m"), spans.alias("_x"))
    cut = segment_table(base, "aid", "text", segmenter)
    own = base.select("aid", "_m", F.explode("_x").alias("x")).where(F.map_contains_key("_m", F.col("x.code"))).select("aid", "x.code", "x.start", "x.end")
    hits = segment_targets(cut, own, "aid", "seg_no", "code")
    per = hits.groupBy("aid").agg(F.sort_array(F.collect_list(F.struct("seg_no", "text", "targets"))).alias("_s"), F.array_distinct(F.flatten(F.collect_list("targets"))).alias("_p"))
    joined = base.select("aid", "_m", F.col("_x").isNotNull().alias("_marked")).join(per, "aid", "left")
    chosen = sampling.negatives(F.sort_array(F.map_keys("_m")), F.coalesce("_p", none), negatives, F.concat_ws("|", F.lit(str(seed)), "aid"))
    joined = joined.withColumn("_c", F.when(F.col("_marked"), _ordered(chosen, order, seed)).otherwise(none))
    segs = F.coalesce("_s", F.array().cast(joined.schema["_s"].dataType))
    targets = F.when(F.col("_marked"), F.transform(segs, lambda s: remap(s["targets"], F.col("_c")))).otherwise(F.array().cast("array<array<int>>"))
    return joined.select("aid", F.transform(segs, lambda s: s["text"]).alias("segments"), F.transform("_c", lambda c: F.element_at(F.col("_m"), c)).alias("classes"), targets.alias("targets"))


def _zipped(codes: str, start: str, end: str) -> Column:
    """Parallel lists as spans; null where the lists are."""
    of = F.arrays_zip(F.col(codes).alias("c"), F.col(start).alias("s"), F.col(end).alias("e"))
    return F.transform(of, lambda x: F.struct(x["c"].cast("string").alias("code"), x["s"].cast("int").alias("start"), x["e"].cast("int").alias("end")))


def _located() -> Column:
    """A feature's places (``a b;c d`` strings) as spans."""
    of = F.arrays_zip(F.col("labels.feature_num").alias("c"), F.col("labels.location").alias("p"))
    bounds = lambda x: location_bounds(F.nullif(F.array_join(x["p"], ";"), F.lit("")))
    spans = F.transform(of, lambda x: F.struct(x["c"].cast("string").alias("code"), bounds(x)[0].alias("start"), bounds(x)[1].alias("end")))
    return F.filter(spans, lambda x: x["start"].isNotNull())


#: Data sets whose rows carry spans and classes: the columns that tell them, their id, text, classes and spans.
LABELLED = {
    "decisions": (("subject_id", "hadm_id", "note_id", "text", "classes", "annotations"), lambda: F.concat_ws("_", "hadm_id", "subject_id", "note_id"), "text", "classes", lambda: _zipped("annotations.category_id", "annotations.start_offset", "annotations.end_offset")),
    "concepts": (("note_id", "text", "classes", "annotations"), lambda: F.col("note_id").cast("string"), "text", "classes", lambda: _zipped("annotations.concept_id", "annotations.start", "annotations.end")),
    "scored": (("pn_num", "case_num", "patient_note", "case_features", "labels"), lambda: F.concat_ws("_", "case_num", "pn_num"), "patient_note", "case_features", _located),
}


def adapt_labelled(df: DataFrame, segmenter: Segmenter, name: str | None = None, negatives: int = -1, seed: int = 0, order: str = "random") -> DataFrame:
    """``label_rows`` of a data set, told by its columns (the first that has them all) or by name."""
    for known, (needs, aid, text, classes, spans) in LABELLED.items():
        if known == name or (name is None and set(needs) <= set(df.columns)):
            return label_rows(df, aid(), text, classes, spans(), segmenter, negatives, seed, order)
    raise ValueError(f"no adapter for columns {df.columns}" if name is None else f"no adapter {name!r}")


def training_classes(rows: DataFrame, names: DataFrame, pairs: DataFrame, per_positive: int = 1, seed: int = 0, order: str = "random") -> DataFrame:
    """aid, note, classes (names), targets (codes): coded notes with negatives near their codes.

    ``rows``: subject_id, hadm_id, note_id, text, codes. ``names``: code and name; codes without one are left out.
    ``pairs``: code, other, rank: each positive's list of near codes, from which ``fair_shares`` draws.
    """
    aid = F.concat_ws("_", "subject_id", "hadm_id", "note_id")
    notes = rows.select(aid.alias("aid"), F.col("text").alias("note"), "codes")
    known = names.select("code", "name").dropDuplicates(["code"])
    pos = notes.select("aid", F.posexplode("codes").alias("pos", "code")).join(known.select("code"), "code", "left_semi")
    pos = pos.groupBy("aid", "code").agg(F.min("pos").alias("pos"))
    lists = pos.select("aid", F.col("code").alias("lst")).join(pairs.select(F.col("code").alias("lst"), F.col("other").alias("code"), "rank"), "lst").join(known.select("code"), "code", "left_semi")
    drawn = fair_shares(lists.select("aid", "lst", "code", "rank"), pos.select("aid", "code"), "aid", "lst", "code", "rank", per_positive, seed).select("aid", "code")
    both = pos.select("aid", "code").unionByName(drawn).join(known, "code")
    classes = both.groupBy("aid").agg(F.map_from_entries(F.collect_list(F.struct("code", "name"))).alias("_m"))
    targets = pos.groupBy("aid").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "code"))), lambda x: x["code"]).alias("targets"))
    out = notes.drop("codes").join(classes, "aid", "left").join(targets, "aid", "left")
    none = F.array().cast("array<string>")
    codes = _ordered(F.map_keys("_m"), order, seed)
    return out.select("aid", "note", F.coalesce(F.transform(codes, lambda c: F.element_at(F.col("_m"), c)), none).alias("classes"), F.coalesce("targets", none).alias("targets"))
