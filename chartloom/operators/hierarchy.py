"""Code hierarchies as an adjacency table and its closure."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.codes import pad_seventh

NOTE_FIELDS = ("notes", "includes", "inclusion_term", "excludes1", "excludes2", "use_additional_code", "code_first", "code_also")


def closure(nodes: DataFrame, id_col: str = "id", parent_col: str = "parent_id", include_self: bool = False, max_depth: int = 32) -> DataFrame:
    """ancestor, descendant, depth; one join a level, so the number of jobs is the tree's depth.

    Roots have a null or empty parent. A tree deeper than ``max_depth`` (or a cycle) raises.
    """
    edges = nodes.select(F.col(id_col).alias("descendant"), F.col(parent_col).alias("ancestor")).where("ancestor is not null and ancestor <> ''")
    step = edges.select(F.col("descendant").alias("mid"), F.col("ancestor").alias("up"))
    level = edges.select("ancestor", "descendant", F.lit(1).alias("depth"))
    out = level
    for depth in range(2, max_depth + 1):
        # kept, so that the next level starts from this one instead of the first
        level = level.join(step, F.col("ancestor") == F.col("mid")).select(F.col("up").alias("ancestor"), "descendant", F.lit(depth).alias("depth")).cache()
        if not level.limit(1).count():
            break
        out = out.unionByName(level)
    else:
        raise ValueError(f"the tree is deeper than {max_depth}")
    if include_self:
        out = out.unionByName(nodes.select(F.col(id_col).alias("ancestor"), F.col(id_col).alias("descendant"), F.lit(0).alias("depth")))
    return out


def ancestors(closed: DataFrame) -> DataFrame:
    """descendant and its ancestors from leaf to root."""
    return closed.where("depth > 0").groupBy("descendant").agg(F.transform(F.sort_array(F.collect_list(F.struct("depth", "ancestor"))), lambda x: x["ancestor"]).alias("path"))


def at_root_depth(closed: DataFrame, depth: int) -> DataFrame:
    """descendant and its ancestor ``depth`` levels below the root (1: chapter, 2: section)."""
    path = F.reverse("path")
    return ancestors(closed).where(F.size("path") > depth).select("descendant", F.element_at(path, depth + 1).alias("ancestor"))


def term_paths(terms: DataFrame, closed: DataFrame, id_col: str = "id", title: str = "title") -> DataFrame:
    """id and the titles from the root to the term, joined by a comma and a blank."""
    titles = terms.select(F.col(id_col).alias("ancestor"), F.col(title).alias("_t"))
    rows = closed.join(titles, "ancestor")
    return rows.groupBy(F.col("descendant").alias(id_col)).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct((-F.col("depth")).alias("d"), "_t"))), lambda x: x["_t"]), ", ").alias("path"))


def leaves(closed: DataFrame, nodes: DataFrame, id_col: str = "id", assignable: str = "assignable") -> DataFrame:
    """ancestor and its assignable descendants, sorted."""
    good = nodes.where(F.col(assignable)).select(F.col(id_col).alias("descendant"))
    return closed.where("depth > 0").join(good, "descendant").groupBy("ancestor").agg(F.sort_array(F.collect_set("descendant")).alias("leaves"))


def group_by_ancestor(codes: DataFrame, code_col: str, closed: DataFrame, nodes: DataFrame, kind: str) -> DataFrame:
    """Codes grouped under their nearest ancestor of ``kind``; codes without one go."""
    tops = nodes.where(F.col("kind") == kind).select(F.col("id").alias("ancestor"))
    near = codes.select(F.col(code_col).alias("descendant")).distinct().join(closed.where("depth > 0"), "descendant").join(tops, "ancestor")
    nearest = near.groupBy("descendant").agg(F.min_by("ancestor", "depth").alias("ancestor"))
    return nearest.groupBy("ancestor").agg(F.sort_array(F.collect_list("descendant")).alias("codes"))


def term_codes(terms: DataFrame, nodes: DataFrame, closed: DataFrame) -> DataFrame:
    """term_id, code: assignable codes and manifestations; others stand for the assignable codes below them."""
    below = closed.join(nodes.where("assignable").select(F.col("id").alias("descendant")), "descendant").select("ancestor", "descendant")
    strip = lambda c: F.regexp_replace(F.col(c), r"[-.]+$", "")
    own = terms.where("code is not null and code <> '' and assignable").select(F.col("id").alias("term_id"), "code")
    mani = terms.where("manifestation_code <> '' and not contains(manifestation_code, '-')").select(F.col("id").alias("term_id"), F.col("manifestation_code").alias("code"))
    open_ = terms.where("code is not null and code <> '' and not assignable").select(F.col("id").alias("term_id"), strip("code").alias("ancestor"))
    open_mani = terms.where("contains(manifestation_code, '-')").select(F.col("id").alias("term_id"), strip("manifestation_code").alias("ancestor"))
    spread = open_.unionByName(open_mani).join(below, "ancestor").select("term_id", F.col("descendant").alias("code"))
    return own.unionByName(mani).unionByName(spread).distinct()


def instructional_notes(rows: DataFrame, id_col: str, codes_col: str, nodes: DataFrame, closed_self: DataFrame, fields: Sequence[str] = NOTE_FIELDS) -> DataFrame:
    """Per row the notes of its codes and their ancestors, each node once, root first, by first code; empty ones go."""
    filled = F.lit(False)
    for f in fields:
        filled = filled | (F.coalesce(F.size(f), F.lit(0)) > 0)
    noted = nodes.where(filled | (F.col("kind") == "chapter")).where("parent_id is not null").select(F.col("id").alias("ancestor"), "name", *fields)
    items = rows.select(id_col, F.posexplode(codes_col).alias("pos", "descendant"))
    hits = items.join(closed_self, "descendant").join(noted, "ancestor")
    firsts = hits.groupBy(id_col, "ancestor").agg(F.min(F.struct("pos", (-F.col("depth")).alias("up"))).alias("first"), F.first("name").alias("name"), *(F.first(f).alias(f) for f in fields))
    return firsts.groupBy(id_col).agg(F.transform(F.sort_array(F.collect_list(F.struct("first", "ancestor", "name", *fields))), lambda x: F.struct(x["ancestor"].alias("id"), x["name"].alias("name"), *(x[f].alias(f) for f in fields))).alias("notes"))


def seventh_characters(nodes: DataFrame, closed_self: DataFrame, extensions: DataFrame) -> DataFrame:
    """Codes with a seventh character: leaves under the nearest code that defines some.

    ``extensions``: owner, char, text. Only leaves whose name holds the owner's name are expanded.
    """
    inner = nodes.select(F.col("parent_id").alias("id")).where("id is not null").distinct()
    tips = nodes.join(inner, "id", "left_anti").select(F.col("id").alias("descendant"), F.col("name").alias("leaf"), "description")
    owners = nodes.select(F.col("id").alias("ancestor"), F.col("name").alias("owner_name")).join(extensions.select(F.col("owner").alias("ancestor")).distinct(), "ancestor")
    near = tips.join(closed_self, "descendant").join(owners, "ancestor").groupBy("descendant", "leaf", "description").agg(F.min_by(F.struct("ancestor", "owner_name"), "depth").alias("o"))
    fit = near.where(F.col("leaf").contains(F.col("o.owner_name"))).select("descendant", "leaf", "description", F.col("o.ancestor").alias("owner"))
    text = F.concat("description", F.lit(" ("), "text", F.lit(")"))
    return fit.join(extensions, "owner").select(F.concat(pad_seventh(F.col("leaf")), "char").alias("name"), F.col("descendant").alias("parent_id"), text.alias("description"), F.lit(True).alias("assignable"))


def axis_product(rows: DataFrame, axes: Sequence[str], declared: str | None = None) -> DataFrame:
    """Codes and descriptions of every combination of a row's axes (arrays of struct<code,title,label>).

    With ``declared``, rows whose number of combinations differs from it raise.
    """
    out = rows
    if declared:
        n = F.lit(1)
        for a in axes:
            n = n * F.size(a)
        out = out.where(F.when(n == F.col(declared), True).otherwise(F.raise_error(F.lit("the number of codes differs from the declared one"))))
    for a in axes:
        out = out.withColumn(a, F.explode(a))
    code = F.concat(*(F.col(f"{a}.code") for a in axes))
    text = F.concat_ws(". ", *(F.concat(F.col(f"{a}.title"), F.lit(": "), F.col(f"{a}.label")) for a in axes))
    return out.select(*[c for c in rows.columns if c not in axes], code.alias("code"), text.alias("description"))


def full_description(nodes: DataFrame, closed_self: DataFrame, sep: str = ", ") -> DataFrame:
    """id and the descriptions from the root down."""
    texts = nodes.select(F.col("id").alias("ancestor"), "description")
    return closed_self.join(texts, "ancestor").groupBy(F.col("descendant").alias("id")).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct((-F.col("depth")).alias("d"), "description"))), lambda x: x["description"]), sep).alias("full_description"))


def check_tree(nodes: DataFrame) -> DataFrame:
    """Rows that break the tree's rules: repeated ids and missing parents."""
    twice = nodes.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select("id", F.lit("repeated id").alias("fault"))
    lost = nodes.where("parent_id is not null and parent_id <> ''").join(nodes.select(F.col("id").alias("parent_id")).distinct(), "parent_id", "left_anti").select("id", F.lit("no such parent").alias("fault"))
    return twice.unionByName(lost)


def guidelines_for(rows: DataFrame, id_col: str, codes_col: str, closed: DataFrame, guidelines: DataFrame) -> DataFrame:
    """Per row the guidelines of its codes' chapters, each once, by id; a chapter without one raises.

    ``guidelines``: id (the chapter's), number, title, content.
    """
    chapters = at_root_depth(closed, 0).select(F.col("descendant").alias("_code"), F.col("ancestor").alias("_chapter"))
    wanted = rows.select(id_col, F.explode(codes_col).alias("_code")).join(chapters, "_code").select(id_col, "_chapter").distinct()
    found = wanted.join(guidelines.withColumnRenamed("id", "_chapter"), "_chapter", "left")
    title = F.when(F.col("title").isNull(), F.raise_error(F.concat(F.lit("no guideline for "), "_chapter"))).otherwise(F.col("title"))
    return found.groupBy(id_col).agg(F.sort_array(F.collect_list(F.struct(F.col("_chapter").alias("id"), "number", title.alias("title"), "content"))).alias("guidelines"))


def by_lead_term(terms: DataFrame, id_col: str = "id") -> DataFrame:
    """lead_id and the sorted ids of its terms."""
    return terms.groupBy(F.split_part(F.col(id_col), F.lit("."), F.lit(1)).alias("lead_id")).agg(F.sort_array(F.collect_list(id_col)).alias("terms"))


def main_terms(terms: DataFrame, parent: str = "parent_id") -> DataFrame:
    """Terms without a parent."""
    return terms.where(F.coalesce(F.col(parent), F.lit("")) == "")


def root_leaves(nodes: DataFrame, closed: DataFrame) -> DataFrame:
    """root and its assignable descendants, sorted."""
    tops = main_terms(nodes).select(F.col("id").alias("root"))
    return leaves(closed, nodes).join(tops, F.col("ancestor") == F.col("root")).select("root", "leaves")


def n_categories(nodes: DataFrame, kind: str = "category") -> DataFrame:
    return nodes.agg(F.count(F.when(F.col("kind") == kind, 1)).alias("n"))
