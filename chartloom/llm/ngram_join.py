"""Similarity self-join of documents on word n-grams by parity sketches.

A document's set holds the hashes of its distinct n-word shingles. The sketch of a set has one bit
for each of many cells; a shingle flips its cell's bit, so the Hamming distance of two sketches never
exceeds the size of the sets' symmetric difference. In a size band where sets that link differ by at
most d shingles, the shingle space is dealt to d + 1 + s ranges; the sketch's section of a range
depends on the shingles in that range only, so by the pigeonhole principle two sets that link agree
in at least 1 + s sections. Sections are joined by equality; pairs are then verified on the sets.

No group of equal sections is expanded into all its pairs:

* equal sets are one representative to begin with;
  (Below a similarity of 8/9 the least hashes of a set are its keys instead, see ``section_keys``.)
* round 0 compares each member of a group with the group's least member (its leader). A member that
  links to the leader needs no further partner among those that do, as all are one component. The
  others are compared with those that the triangle inequality of the Jaccard distance leaves;
* sections of at most one shingle, and sections shared by more than ``SMALL`` unresolved sets, are
  weak. As s of the 1 + s agreeing sections may be weak, a set with at most s weak ones is left out
  of weak groups: a strong section finds its partners;
* the sets beyond that, crowded families, are joined anew on their rarest shingles (a prefix filter).
  There, sets that are one component by now need no comparing. Groups that stay large are told apart by what
  their sets differ in from what most of the group holds (see ``apart``): sets that differ little link for
  certain, others only with those that differ in the same shingles, by which they are joined anew. In the first
  of these rounds the groups that share sets are one, so that what is written grows with the sets, not with their keys;
* if groups are large after ``PIVOTS`` rounds of that, sets from outside a group's largest component face the
  rest of it: up to ``SMALL`` in the first round, four times as many in each further one as long as they make
  at most ``FACED`` pairs a group, until nothing is unresolved.

So every link between different components is verified or ruled out, none is capped away.

Null and empty texts have an empty set and link with nothing. Each row is judged on its own text, also if
ids repeat. A row without an id gets the class of an equal set, if there is one. Ids may be of any type
that can be compared. Only the id and text columns are read. An empty frame gives an empty frame. Shingles are
told apart by 64-bit hashes: two of a pair's n shingles coincide with probability n**2 / 2**65; so are rows,
by a hash of id and text.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import drop_path, keep_rows, map_arrow, new_path, spill, text_or_empty, worker_memo
from .components import connected_components
from .word_hashes import U, mix, shingle_set

#: Unresolved groups of at most so many sets are settled in one round, member by member.
SMALL = 16
#: Rounds in which crowded groups are told apart by differences, before sets face each other.
PIVOTS = 4
#: Pairs of a crowded group in a round, beyond those of SMALL sets.
FACED = 1 << 18
#: Sets to a part of the tables that are written about them, so that a few sets make few files.
SETS_A_PART, CROWDED_A_PART = 5000, 1000
#: Bits of the sketch by which pairs are ruled out before their sets are fetched.
SKETCH_BITS = 2048
FIRST_BAND = 2


@lru_cache(maxsize=4096)
def bands_of(n: int, num: int, den: int) -> tuple[tuple[int, int, int], ...]:
    """(band, ranges, weak sections allowed) for each band in which a set of n shingles is a key.

    A pair belongs to the band of its smaller set; bands grow by half. A set is also a key in the
    band below if a smaller partner may lie there.
    """
    out, low, band = [], FIRST_BAND, 0
    while low <= n:
        high = low + max(1, low // 2)  # sizes low .. high - 1
        if n < high or num * n <= den * (high - 1):
            differ = (high - 1) * (den - num) // num
            if differ:  # else linked sets are equal
                slack = -int(-(0.06 * differ + 3 * (0.03 * differ) ** 0.5) // 1)
                out.append((band, differ + 1 + slack, slack))
        low, band = high, band + 1
    return tuple(out)


@lru_cache(maxsize=65536)
def _narrow(n: int) -> tuple[int, int, int]:
    """(number, least, most size) of the narrow size class of n; classes grow by a 25th."""
    low, number = 1, 0
    while True:
        high = low + max(1, low // 25)
        if n < high:
            return number, low, high - 1
        low, number = high, number + 1


@lru_cache(maxsize=65536)
def size_pairs(n: int, num: int, den: int) -> tuple[tuple[int, int, int], ...]:
    """(code, prefix, side) of each pair of narrow classes in which a set of n shingles may link.

    A partner shares at least num (n + its size) / (num + den) shingles, so of any ``prefix`` shingles
    of the set it lacks at most all but one.
    """
    out, m, own = [], -(-n * num // den), _narrow(n)[0]
    while m <= n * den // num:
        other, _, top = _narrow(m)
        out.append(((min(own, other) << 12) + max(own, other), n + num * (n + m) // -(num + den) + 1, (own > other) * 2 + (own < other)))
        m = top + 1
    return tuple(out)


def _section_hashes(h: np.ndarray, band: int, ranges: int) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit key, number of shingles) of every section of a sorted set's sketch, 128 bits to a section."""
    bits = U(1) << (mix(h) & U(63))
    more = U(1) << (mix(h ^ U(0x5851F42D4C957F2D)) & U(63))
    # the range of a hash is its place in the ordered hash space, so each range is a run of h
    part = ((h >> U(32)) * U(ranges)) >> U(32)
    first = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
    full = np.zeros((3, ranges), np.uint64)
    at = part[first].astype(np.int64)
    full[0, at], full[1, at], full[2, at] = np.bitwise_xor.reduceat(bits, first), np.bitwise_xor.reduceat(more, first), np.diff(np.append(first, h.size))
    where = np.arange(ranges, dtype=np.uint64) + (U(band) << U(36))
    return mix(mix(full[0] + where * U(0x9E3779B97F4A7C15)) ^ full[1] * U(0xD6E8FEB86659FD93)), full[2]


def parity_sketch(h: np.ndarray) -> np.ndarray:
    """SKETCH_BITS bits, each the parity of the shingles in its cell."""
    cells = (mix(h ^ U(0x8CB92BA72F3D8DD7)) & U(SKETCH_BITS - 1)).astype(np.int64)
    return np.packbits((np.bincount(cells, minlength=SKETCH_BITS) & 1).astype(np.uint8)).view(np.int64)


def section_keys(h: np.ndarray, num: int, den: int) -> tuple[np.ndarray, int]:
    """(64-bit keys, spare) of a sorted set: its sections, and how many more weak ones are allowed (-1: none, all are emitted).

    Below a similarity of 8/9 sections would hold two or three shingles and outnumber the prefix; there
    the least hashes of the set are its keys (a prefix filter in hash order), of which linked sets share
    at least one more than the slack.
    """
    if 8 * (den - num) > num:
        least = -(-h.size * num // den)  # shingles that a partner shares at least
        slack = min(h.size // 16 + 2, least - 1)
        return mix(h[: h.size - least + 1 + slack]).view(np.int64), slack
    keys, spare = [np.zeros(0, np.uint64)], 1 << 20
    for band, ranges, slack in bands_of(h.size, num, den):
        key, size = _section_hashes(h, band, ranges)
        weak = size <= 1
        n_weak = int(np.count_nonzero(weak))
        keys.append(key if n_weak > slack else key[~weak])
        spare = min(spare, max(slack - n_weak, -1))
    return np.concatenate(keys).view(np.int64), spare


def _sketches(docs: DataFrame, id_col: str, text_col: str, k: int, num: int, den: int) -> DataFrame:
    """id, node (the row's name in the join), n, two 64-bit fingerprints of the set, and its section keys."""
    schema = T.StructType(
        [
            T.StructField("id", docs.schema[id_col].dataType),
            T.StructField("node", T.LongType()),
            T.StructField("n", T.LongType()),
            T.StructField("f1", T.LongType()),
            T.StructField("f2", T.LongType()),
            T.StructField("spare", T.IntegerType()),
            T.StructField("sketch", T.ArrayType(T.LongType())),
            T.StructField("keys", T.ArrayType(T.LongType())),
        ]
    )

    def run(batches):
        worker_memo("ngram", dict)
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                n, f1, f2, spare, sketch, keys = [], [], [], [], [], []
                for text in part.column(2):
                    h = shingle_set(text.as_py(), k)
                    n.append(h.size)
                    f1.append(int(h.sum().view(np.int64)) if h.size else 0)
                    f2.append(int(np.bitwise_xor.reduce(mix(h)).view(np.int64)) if h.size else 0)
                    own, slack = section_keys(h, num, den) if h.size else (np.zeros(0, np.int64), 0)
                    keys.append(own)
                    spare.append(slack)
                    sketch.append(parity_sketch(h))
                ends = pa.array(np.cumsum([0, *(x.size for x in keys)]), pa.int32())
                lists = pa.ListArray.from_arrays(ends, pa.array(np.concatenate(keys)))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(n, pa.int64()), pa.array(f1, pa.int64()), pa.array(f2, pa.int64()), pa.array(spare, pa.int32()), pa.array(sketch, pa.list_(pa.int64())), lists], names=schema.fieldNames())

    return map_arrow(docs.select(F.col(id_col).alias("id"), row_key(id_col, text_col).alias("node"), text_or_empty(text_col).alias("text")), run, schema)


def row_key(id_col: str = "doc_id", text_col: str = "text") -> Column:
    """A row's name in the join: a hash of its id and text."""
    return F.xxhash64(F.col(id_col), text_or_empty(text_col))


def _sets(texts: DataFrame, k: int) -> DataFrame:
    """id and the sorted set of (id, text) rows."""
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("shingles", T.ArrayType(T.LongType()))])

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                sets = [shingle_set(t.as_py(), k).view(np.int64) for t in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sets, pa.list_(pa.int64()))], names=schema.fieldNames())

    return map_arrow(texts, run, schema)


def _overlaps(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """a, b, inter, total (size of the union) of each pair; sets are sorted as unsigned."""
    left = sets.select(F.col("id").alias("a"), F.col("shingles").alias("sa"))
    right = sets.select(F.col("id").alias("b"), F.col("shingles").alias("sb"))
    schema = T.StructType([T.StructField(c, T.LongType()) for c in ("a", "b", "inter", "total")])

    def run(batches):
        for batch in batches:
            inter, total = [], []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                p, q = (v.values.to_numpy(zero_copy_only=False).view(np.uint64) for v in (x, y))
                if p.size > q.size:
                    p, q = q, p
                at = np.searchsorted(q, p)
                same = int(np.count_nonzero(q[np.minimum(at, q.size - 1)] == p)) if p.size else 0
                inter.append(same)
                total.append(p.size + q.size - same)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(inter, pa.int64()), pa.array(total, pa.int64())], names=schema.fieldNames())

    return map_arrow(pairs.join(left, "a").join(right, "b").select("a", "b", "sa", "sb"), run, schema)


def _rarest_shingles(sets: DataFrame, num: int, den: int) -> DataFrame:
    """key, id, n, side: the shingles by which crowded sets are joined anew, for each pair of narrow size classes.

    side: 0 if both classes are one, else 1 for the lower and 2 for the higher.

    With one global order, the rarest first, linked sets have one of their prefixes' shingles in common.
    """
    schema = T.StructType([T.StructField("i", T.LongType()), T.StructField("code", T.IntegerType()), T.StructField("prefix", T.IntegerType()), T.StructField("side", T.IntegerType())])

    def classes(batches):
        for batch in batches:
            rows = [(i, *pair) for i, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for pair in size_pairs(n, num, den)]
            cols = list(zip(*rows, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), *(pa.array(c, pa.int32()) for c in cols[1:])], names=schema.fieldNames())

    spaces = map_arrow(sets.select("id", F.size("shingles").cast("long").alias("n")), classes, schema)
    tokens = sets.select("id", F.size("shingles").cast("long").alias("n"), F.explode("shingles").alias("gram"))
    counts = tokens.groupBy(F.col("gram").alias("g")).agg(F.count("*").alias("c"))
    order = Window.partitionBy("id").orderBy("c", "gram")  # a set's own shingles
    placed = tokens.join(counts, F.col("gram") == F.col("g")).withColumn("place", F.row_number().over(order))
    # alone beyond its least partner's reach: no key
    first = placed.where((F.col("c") > 1) & (F.col("place") <= F.col("n") - F.ceil(F.col("n") * num / den) + 1))
    return first.join(spaces, (F.col("id") == F.col("i")) & (F.col("place") <= F.col("prefix"))).select(F.xxhash64("code", "gram").alias("key"), "id", "n", "side")


def _led(keyed: DataFrame, parts: int) -> DataFrame:
    """Rows of keys that more than one set has, with the least of them as leader; they move once, by their key."""
    own = Window.partitionBy("key")
    rows = keyed.withColumns({"c": F.count("*").over(own), "leader": F.min("id").over(own)})
    return spill(rows.where("c > 1").drop("c").coalesce(parts), "ngram-groups")


class _Verifier:
    """Pairs checked so far, and the round that all stages share."""

    def __init__(self, reps: DataFrame, texts: DataFrame, k: int, num: int, den: int, parts: int):
        self.parts = parts  # of what is written, by the number of sets
        self.sketches, self.texts, self.k, self.num, self.den = reps.select("id", "n", "sketch"), texts, k, num, den
        self.done: DataFrame | None = None  # a, b, link, and bounds lo and hi of the Jaccard distance
        self.sets: DataFrame | None = None
        self.known: DataFrame | None = None  # a, b: what links found before make one component
        self.path, self.set_paths = "", []
        self.near = (den - num) / den + 1e-9

    def put(self, df: DataFrame, name: str, path: str | None = None) -> DataFrame:
        return spill(df.coalesce(self.parts), name, path)

    def fetch(self, ids: DataFrame) -> DataFrame:
        """The sets of ``ids``; those not made before are made from their texts."""
        new = ids if self.sets is None else ids.join(self.sets.select("id"), "id", "left_anti")
        if self.sets is None or new.limit(1).count():
            own = self.texts.join(new, "id").groupBy("id").agg(F.min("text").alias("text"))
            self.set_paths.append(new_path(ids.sparkSession, "ngram-sets"))
            part = self.put(_sets(own, self.k), "ngram-sets", self.set_paths[-1])
            self.sets = part if self.sets is None else self.sets.unionByName(part)
        return self.sets.join(ids, "id", "left_semi")

    def check(self, pairs: DataFrame) -> None:
        """Verify pairs that were not before. Sizes and the sketches' Hamming distance, a lower bound of the
        symmetric difference, rule most out. What is written is small, so its size is known to the next
        join and other sets do not move; all results are one table, so that plans stay small."""
        spark, num, den = pairs.sparkSession, self.num, self.den
        pairs = pairs.distinct()
        if self.done is not None:
            pairs = pairs.join(self.done.select("a", "b"), ["a", "b"], "left_anti")
        paths = [new_path(spark, f"ngram-{name}") for name in ("pairs", "bounds", "ids")]
        pairs = self.put(pairs, "ngram-pairs", paths[0])
        side = lambda x: self.sketches.select(F.col("id").alias(x), F.col("n").alias(f"n{x}"), F.col("sketch").alias(f"s{x}"))
        apart = F.aggregate(F.zip_with("sa", "sb", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
        both = F.col("na") + F.col("nb")
        most = pairs.join(side("a"), "a").join(side("b"), "b").withColumn("d", F.greatest(apart.cast("long"), F.abs(F.col("na") - F.col("nb"))))
        bounds = self.put(most.select("a", "b", (2 * F.col("d") / (both + F.col("d"))).alias("lo"), (F.col("d") * (den + num) <= both * (den - num)).alias("may")), "ngram-bounds", paths[1])
        may = bounds.where("may").select("a", "b")
        ids = self.put(may.select(F.col("a").alias("id")).union(may.select("b")).distinct(), "ngram-ids", paths[2])
        far = 1 - F.col("inter") / F.col("total")
        seen = _overlaps(may, self.fetch(ids)).select("a", "b", far.alias("lo"), far.alias("hi"), (F.col("inter") * den >= F.col("total") * num).alias("link"))
        new = seen.unionByName(bounds.where("not may").select("a", "b", "lo", F.lit(1.0).alias("hi"), F.lit(False).alias("link")))
        before, self.path = self.path, new_path(spark, "ngram-checked")
        self.done = self.put(new if self.done is None else self.done.unionByName(new), "ngram-checked", self.path)
        drop_path(spark, *paths, *([before] if before else []))

    def links(self) -> DataFrame:
        links = self.done.where("link").select("a", "b")
        return links if self.known is None else links.union(self.known)

    def round(self, groups: DataFrame) -> DataFrame:
        """Compare groups with their leaders, settle small remainders; the rows of large ones come back."""
        self.check(groups.where("id <> leader").select(F.least("id", "leader").alias("a"), F.greatest("id", "leader").alias("b")))
        # the leader itself has distance 0, so it leaves the group below
        seen = groups.withColumn("a", F.least("id", "leader")).withColumn("b", F.greatest("id", "leader")).join(self.done, ["a", "b"], "left")
        seen = seen.withColumns({"lo": F.coalesce("lo", F.lit(0.0)), "hi": F.coalesce("hi", F.lit(0.0)), "link": F.coalesce("link", F.lit(True))}).drop("a", "b", "leader")
        # a linked member beyond reach of all unlinked ones is settled
        apart = seen.where("not link").groupBy(F.col("key").alias("g")).agg(F.min("lo").alias("nearest"))
        rest = seen.join(apart, F.col("key") == F.col("g")).where((~F.col("link")) | (F.col("hi") >= F.col("nearest") - self.near)).drop("g", "nearest")
        sizes = rest.groupBy(F.col("key").alias("h")).agg(F.count("*").alias("size")).where("size > 1")
        left = self.put(rest.join(sizes, F.col("key") == F.col("h")).drop("h"), "ngram-rest")
        small = left.where(F.col("size") <= SMALL)
        # at most SMALL - 1 partners each, the unlinked against all that are left in the group
        x = small.where("not link").select("key", F.col("id").alias("x"), F.col("n").alias("nx"), F.col("lo").alias("lx"), F.col("hi").alias("hx"))
        y = small.select("key", F.col("id").alias("y"), F.col("n").alias("ny"), F.col("lo").alias("ly_"), F.col("hi").alias("hy"), F.col("link").alias("ly"))
        self.check(self._possible(x.join(y, "key").where("x <> y and (ly or x < y)")))
        return left.where(F.col("size") > SMALL).drop("size")

    def _possible(self, pairs: DataFrame) -> DataFrame:
        """Pairs (a, b) that sizes and the triangle inequality allow to link."""
        sized = pairs.where(F.least("nx", "ny") * self.den >= F.greatest("nx", "ny") * self.num)
        return sized.where((F.col("lx") - F.col("hy") <= self.near) & (F.col("ly_") - F.col("hx") <= self.near)).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))

    def two_sided(self, keyed: DataFrame) -> DataFrame:
        """Settle groups of two size classes of which one has few sets; the rest comes back."""
        sides = keyed.groupBy(F.col("key").alias("k")).agg(F.count_if(F.col("side") == 1).alias("lower"), F.count_if(F.col("side") == 2).alias("higher"))
        few = F.least("lower", "higher")
        both = self.put(keyed.join(sides, F.col("key") == F.col("k")).where((F.col("side") == 0) | (few > 0)), "ngram-sides")
        cross = both.where((F.col("side") > 0) & (few <= SMALL))
        x = cross.where("side = 1").select("key", F.col("id").alias("x"), F.col("n").alias("nx"), F.lit(0.0).alias("lx"), F.lit(1.0).alias("hx"))
        y = cross.where("side = 2").select("key", F.col("id").alias("y"), F.col("n").alias("ny"), F.lit(0.0).alias("ly_"), F.lit(1.0).alias("hy"))
        self.check(self._possible(x.join(y, "key")))
        return both.where((F.col("side") == 0) | (few > SMALL)).select("key", "id", "n")

    def open_groups(self, groups: DataFrame) -> DataFrame:
        """``groups`` with each set's component so far (part), those of one component left out."""
        labels = connected_components(self.links(), parts=self.parts)
        known = groups.join(labels, F.col("id") == F.col("node"), "left").withColumn("part", F.coalesce("component", "id")).drop("node", "component")
        several = known.groupBy(F.col("key").alias("k")).agg(F.min("part").alias("least"), F.max("part").alias("most")).where("least <> most").select("k")
        return self.put(known.join(several, F.col("key") == F.col("k"), "left_semi"), "ngram-open")

    def families(self, groups: DataFrame) -> DataFrame:
        """``groups`` with those that share sets made one, so that each set is in one group only, however many keys it has."""
        first = groups.groupBy("key").agg(F.min("id").alias("a"))
        of = connected_components(groups.join(first, "key").select("a", F.col("id").alias("b")), parts=self.parts)
        return self.put(groups.select("id", "n", "part").distinct().join(of, F.col("id") == F.col("node")).select(F.col("component").alias("key"), "id", "n", "part"), "ngram-families")

    def apart(self, large: DataFrame, whole: bool = False) -> DataFrame:
        """Join the sets of large groups anew on their differences from what most of the group holds; what stays large comes back.
        ``whole``: groups that share sets are one, as a pair may be told apart from any common ground.

        With D the difference of a set of n shingles from the shingles that more than half of a group's sets
        hold, two sets differ in |D| + |D'| - 2 |D and D'| shingles, and link if that is at most (den - num) / (den + num)
        of n + n'. So with u = (|D| - that share of n) / 2 they share at least u + u' differences if they link; if
        u + u' <= 0 they link in any case, and both do with the group's set of least u. Others have one of
        their rarest |D| - (u + u') + 1 differences in common.
        """
        num, den = self.num, self.den
        groups = self.open_groups(large.select("key", "id", "n"))
        groups = self.families(groups) if whole else groups
        tokens = groups.select("key", "id").join(self.sets.select("id", F.explode("shingles").alias("gram")), "id")
        sizes = groups.groupBy("key").agg(F.count("*").alias("size"), F.max("n").alias("top"))
        counts = tokens.groupBy("key", "gram").agg(F.count("*").alias("c")).join(sizes, "key")
        counts = self.put(counts.where("c > 1").select("key", "gram", "c", "size", (2 * F.col("c") > F.col("size")).alias("common")), "ngram-counts")
        tokens = tokens.join(counts, ["key", "gram"], "left")
        # a difference that no other set has (c = 1) counts, but is no key
        added = tokens.where("not coalesce(common, false)").select("key", "id", "gram", F.coalesce("c", F.lit(1)).alias("c"))
        held = tokens.where("common").select("key", "id", "gram")
        lacked = groups.select("key", "id").join(counts.where("common"), "key").select("key", "id", "gram", (F.col("size") - F.col("c")).alias("c")).join(held, ["key", "id", "gram"], "left_anti")
        place = F.row_number().over(Window.partitionBy("key", "id").orderBy("c", "gram"))
        differ = self.put(added.union(lacked).withColumn("place", place), "ngram-differ")
        d = differ.groupBy(F.col("key").alias("k"), F.col("id").alias("i")).agg(F.count("*").alias("d"))
        twice = F.col("d") * (num + den) - F.col("n") * (den - num)  # 2 (num + den) u, whole
        sized = groups.join(d, (F.col("key") == F.col("k")) & (F.col("id") == F.col("i")), "left").withColumn("d", F.coalesce("d", F.lit(0))).withColumn("u", twice)
        width = F.greatest(F.lit(1), F.floor(F.col("top") / 40))
        sized = self.put(sized.join(sizes, "key").select("key", "id", "n", "part", "d", "u", F.floor(F.col("u") / (2 * (num + den)) / width).alias("class")), "ngram-differences")
        first = sized.groupBy(F.col("key").alias("k")).agg(F.min(F.struct("u", "id", "part")).alias("first"))
        led = sized.join(first, F.col("key") == F.col("k")).withColumn("sure", F.col("u") + F.col("first.u") <= 0)
        sure = led.where(F.col("sure") & (F.col("id") != F.col("first.id"))).select(F.col("first.id").alias("a"), F.col("id").alias("b")).distinct()
        self.known = self.put(sure if self.known is None else self.known.union(sure), "ngram-known")
        still = led.withColumn("part", F.when(F.col("sure"), F.col("first.part")).otherwise(F.col("part"))).drop("k", "first", "sure")
        # keys for each class of u of the group: sets of two classes, or of one, that share a difference
        classes = still.groupBy(F.col("key").alias("k"), F.col("class").alias("other")).agg(F.min("u").alias("v"))
        reach = still.join(classes, F.col("key") == F.col("k")).withColumn("prefix", F.col("d") + 1 - F.greatest(F.lit(1), F.ceil((F.col("u") + F.col("v")) / (2 * (num + den)))))
        reach = reach.where("prefix > 0").select(F.col("key").alias("k"), F.col("id").alias("i"), "n", "part", "class", "other", "prefix")
        side = F.when(F.col("class") == F.col("other"), 0).when(F.col("class") < F.col("other"), 1).otherwise(2)
        keyed = differ.where("c > 1").join(reach, (F.col("key") == F.col("k")) & (F.col("id") == F.col("i")) & (F.col("place") <= F.col("prefix")))
        keyed = keyed.select(F.xxhash64("key", F.least("class", "other"), F.greatest("class", "other"), "gram").alias("key"), "id", "n", "part", side.alias("side"))
        use = keyed.groupBy(F.col("key").alias("k")).agg(F.count_if(F.col("side") == 1).alias("lower"), F.count_if(F.col("side") == 2).alias("higher"), F.count_if(F.col("side") == 0).alias("same"), F.min("part").alias("least"), F.max("part").alias("most"))
        use = use.where("least <> most and (same > 1 or lower > 0 and higher > 0)").select("k", F.greatest(F.col("lower") * F.col("higher"), F.col("same") * F.col("same")).alias("pairs"))
        rows = self.put(keyed.join(use, F.col("key") == F.col("k")).drop("k"), "ngram-sides")
        few = rows.where(F.col("pairs") <= SMALL * SMALL)
        x = few.where("side < 2").select("key", F.col("id").alias("a"), F.col("part").alias("pa"), F.col("side").alias("sa"))
        y = few.where("side <> 1").select("key", F.col("id").alias("b"), F.col("part").alias("pb"), F.col("side").alias("sb"))
        found = x.join(y, "key").where("pa <> pb and (sb = 2 or a < b)")
        self.check(found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")))
        many = rows.where(F.col("pairs") > SMALL * SMALL).select("key", "id", "n")
        return self.round(_led(many, self.parts)) if many.limit(1).count() else many

    def across(self, large: DataFrame, most_faces: int = SMALL) -> DataFrame:
        """Up to ``most_faces`` sets of each group's smaller components face the rest of it and are done; what stays open comes back."""
        labels = connected_components(self.links(), parts=self.parts)
        known = large.join(labels, F.col("id") == F.col("node"), "left").select("key", "id", "n", "lo", "hi", F.coalesce("component", "id").alias("part"))
        parts = known.groupBy("key", "part").agg(F.count("*").alias("m"))
        most = parts.groupBy("key").agg(F.max(F.struct("m", "part")).alias("top"), F.count("*").alias("parts"), F.sum("m").alias("all")).where("parts > 1")
        sized = parts.join(most.select(F.col("key").alias("k"), F.col("top.part").alias("main"), "all"), F.col("key") == F.col("k")).select("k", F.col("part").alias("p"), "m", "main", "all")
        rows = known.join(sized, (F.col("key") == F.col("k")) & (F.col("part") == F.col("p"))).withColumn("minor", F.col("part") != F.col("main"))
        order = Window.partitionBy("key").orderBy("m", "id")
        turn = rows.where("minor").withColumn("turn", F.row_number().over(order)).where((F.col("turn") <= SMALL) | (F.col("turn") <= most_faces) & (F.col("turn") * F.col("all") <= FACED)).select(F.col("key").alias("f_key"), F.col("id").alias("f_id"))
        open_ = self.put(rows.join(turn, (F.col("key") == F.col("f_key")) & (F.col("id") == F.col("f_id")), "left").select("key", "id", "n", "lo", "hi", "part", "minor", F.col("f_id").isNotNull().alias("faces")), "ngram-open")
        x = open_.where("faces").select("key", F.col("id").alias("x"), F.col("n").alias("nx"), F.col("lo").alias("lx"), F.col("hi").alias("hx"), F.col("part").alias("px"))
        y = open_.select("key", F.col("id").alias("y"), F.col("n").alias("ny"), F.col("lo").alias("ly_"), F.col("hi").alias("hy"), F.col("part").alias("py"))
        self.check(self._possible(x.join(y, "key").where("px <> py")))
        more = open_.where("minor and not faces").select(F.col("key").alias("k")).distinct()
        return self.put(open_.where("not faces").join(more, F.col("key") == F.col("k"), "left_semi").select("key", "id", "n", "lo", "hi"), "ngram-rest")


def jaccard_links(reps: DataFrame, texts: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """Verified links a, b between representatives that suffice for the components of all links."""
    every = 1 + reps.count() // SETS_A_PART
    groups = _led(reps.select("id", F.explode("keys").alias("key")), every)
    groups = groups.join(reps.select("id", "n", "spare"), "id")
    verify = _Verifier(reps, texts, k, num, den, every)
    large = verify.round(groups)
    weak = large.groupBy("id").agg(F.countDistinct("key").alias("weak"))
    crowded = verify.put(large.join(weak, "id").where(F.col("weak") > F.col("spare")).select("id").distinct(), "ngram-crowded")
    n_crowded = crowded.count()
    if not n_crowded:
        return verify.links()
    parts = 1 + n_crowded // CROWDED_A_PART
    few = _Verifier(verify.put(reps.join(crowded, "id", "left_semi").select("id", "n", "sketch"), "ngram-few"), texts, k, num, den, parts)
    few.sets = verify.put(verify.fetch(crowded), "ngram-few")
    drop_path(reps.sparkSession, *verify.set_paths)
    within = [F.col(c) == F.col("id") for c in ("a", "b")]
    few.done = few.put(verify.done.join(crowded, within[0], "left_semi").join(crowded, within[1], "left_semi"), "ngram-checked")
    few.known = few.put(connected_components(verify.links()).select(F.col("node").alias("a"), F.col("component").alias("b")).join(crowded, within[0], "left_semi").where("a <> b"), "ngram-known")
    large = few.round(_led(few.two_sided(_rarest_shingles(few.sets, num, den)), parts))
    for turn in range(PIVOTS):
        if large.limit(1).count():
            large = few.apart(large, whole=turn == 0)
    faces = SMALL
    while large.limit(1).count():
        large = few.across(large, faces)
        faces *= 4
    return verify.links().union(few.links())


def ngram_classes(docs: DataFrame, k: int = 3, num: int = 90, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, row_key, n_shingles, component_id; sets link when den * intersection >= num * union."""
    paths = [new_path(docs.sparkSession, f"ngram-{name}") for name in ("sketches", "reps")]
    sketches = spill(_sketches(docs, id_col, text_col, k, num, den), "ngram-sketches", paths[0])
    held = sketches.where("n > 0 and id is not null")
    firsts = held.groupBy("n", "f1", "f2").agg(F.min(F.struct("id", "node", "spare", "sketch", "keys")).alias("r"))
    reps = spill(firsts.select("n", "f1", "f2", F.col("r.id").alias("least"), F.col("r.node").alias("id"), "r.spare", "r.sketch", "r.keys"), "ngram-reps", paths[1])
    texts = docs.select(row_key(id_col, text_col).alias("id"), text_or_empty(text_col).alias("text"))
    labels = connected_components(jaccard_links(reps, texts, k, num, den))
    # components are named by their least id
    linked = reps.select("n", "f1", "f2", "id", "least").join(labels, F.col("id") == F.col("node")).select("n", "f1", "f2", "least", "component")
    names = linked.groupBy(F.col("component").alias("c")).agg(F.min("least").alias("name"))
    named = linked.join(names, F.col("component") == F.col("c")).select("n", "f1", "f2", "name")
    every = reps.select("n", "f1", "f2", "least").join(named, ["n", "f1", "f2"], "left").select("n", "f1", "f2", F.coalesce("name", "least").alias("name"))
    found = sketches.select("id", "node", "n", "f1", "f2").join(every, ["n", "f1", "f2"], "left")
    return found.select(F.col("id").alias(id_col), F.col("node").alias("row_key"), F.col("n").alias("n_shingles"), F.coalesce("name", "id").alias("component_id"))


def ngram_components(docs: DataFrame, k: int = 3, num: int = 90, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_shingles, component_id."""
    return ngram_classes(docs, k, num, den, id_col, text_col).drop("row_key")


def without_near_copies(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each component: that with the smallest id. Rows with an empty set stay, as they
    link with nothing (of equal rows one does); a row without an id goes if an equal set has one."""
    found = ngram_classes(docs, k, num, den, id_col, text_col)
    fates = found.select(F.col(id_col).alias("id"), F.col("row_key").alias("key"), F.col(id_col).eqNullSafe(F.col("component_id")).alias("kept"))
    return keep_rows(docs, fates, row_key(id_col, text_col), id_col)
