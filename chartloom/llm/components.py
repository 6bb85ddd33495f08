"""Connected components of a link table, as DataFrame joins.

Random-mate contraction: in a round every node points to the neighbour with the least random
priority (to itself if its own is less) and from there once more; links are renamed to what their ends
point to, and those that become loops or repeat others are gone. So the links shrink by a factor in each
round, whatever the order of the ids, a star takes one round, and a chain a number of rounds that grows
with the logarithm of its length. At the end the rounds' pointers are followed back, the latest first.
Everything stays distributed and each round is written to the shared folder; the driver only learns how many links there are
and whether some are left. No later table has more than two rows a link, so the number of links says in how many parts they are written.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch

#: Links to a part of the tables that rounds write.
LINKS_A_PART = 50_000


def connected_components(links: DataFrame, a: str = "a", b: str = "b", work: Scratch | None = None, parts: int | None = None) -> DataFrame:
    """node, component (the least node of its component) for every node that a link names.

    Null ends and loops are ignored; repeated links do no harm; no links give no rows. ``parts``: how many parts
    the tables are written in, if the caller knows how small they are.
    """
    work = work or Scratch(links.sparkSession)
    ends = links.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v")
    first = ends.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
    left, pointers = work.spill(first.coalesce(parts) if parts else first, "links"), []
    parts = parts or 1 + left.count() // LINKS_A_PART
    while left.limit(1).count() or not pointers:
        rank = lambda x, salt=len(pointers): F.xxhash64(x, F.lit(salt))
        best = left.union(left.select("v", "u")).groupBy("u").agg(F.min_by("v", rank("v")).alias("v"))
        to = work.spill(best.select(F.col("u").alias("node"), F.when(rank("v") < rank("u"), F.col("v")).otherwise(F.col("u")).alias("to")).coalesce(parts), "mates")
        # what a node points to is a node, too
        further = to.select(F.col("node").alias("mid"), F.col("to").alias("further"))
        jumped = work.spill(to.join(further, F.col("to") == F.col("mid")).select("node", F.col("further").alias("to")).coalesce(parts), "pointers")
        work.free(to)
        pu, pv = jumped.select(F.col("node").alias("u"), F.col("to").alias("pu")), jumped.select(F.col("node").alias("v"), F.col("to").alias("pv"))
        renamed = left.join(pu, "u").join(pv, "v").where("pu <> pv").select(F.least("pu", "pv").alias("u"), F.greatest("pu", "pv").alias("v")).distinct()
        pointers.append(jumped)
        before, left = left, work.spill(renamed.coalesce(parts), "links")
        work.free(before)
    found = pointers[-1]
    for earlier in reversed(pointers[:-1]):
        on = found.select(F.col("node").alias("mid"), F.col("to").alias("root"))
        merged = work.spill(earlier.join(on, F.col("to") == F.col("mid"), "left").select("node", F.coalesce("root", "to").alias("to")).coalesce(parts), "pointers")
        work.free(earlier, found)
        found = merged
    names = found.groupBy(F.col("to").alias("root")).agg(F.min("node").alias("component"))
    named = work.spill(found.join(names, F.col("to") == F.col("root")).select("node", "component").coalesce(parts), "components")
    work.free(found, left)
    return named
