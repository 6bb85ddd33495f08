"""List columns: null-safe union, distinct, chunks, lookups, spans."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def empty() -> Column:
    return F.array().cast("array<string>")


def null_safe_union(*lists: Column) -> Column:
    return F.concat(*(F.coalesce(c, empty()) for c in lists))


def sorted_distinct(items: Column) -> Column:
    return F.array_sort(F.array_distinct(items))


def clean_codes(items: Column) -> Column:
    """Null list -> empty; null and empty items go."""
    return F.filter(F.coalesce(items, empty()), lambda x: x.isNotNull() & (x != ""))


def keep_known(items: Column, known: Sequence[str]) -> Column:
    """Items of a constant set, in order; repeats stay."""
    return F.filter(items, lambda x: x.isin(list(known)))


def intersect_known(items: Column, other: Column) -> Column:
    return F.filter(items, lambda x: F.array_contains(other, x))


def aligned_filter(codes: Column, spans: Column, known: Column) -> tuple[Column, Column]:
    """Known codes with their parallel span lists; an emptied span list becomes null."""
    kept = F.filter(F.arrays_zip(codes.alias("c"), spans.alias("s")), lambda z: F.array_contains(known, z["c"]))
    left = F.transform(kept, lambda z: z["s"])
    return F.transform(kept, lambda z: z["c"]), F.when(F.size(left) > 0, left)


def chunks(items: Column, size: int) -> Column:
    n = F.ceil(F.size(items) / F.lit(float(size))).cast("int")
    return F.when(n == 0, F.array()).otherwise(F.transform(F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1), lambda i: F.slice(items, i * size + 1, size)))


def padded_chunks(tokens: Column, size: int, pad: int) -> Column:
    """Chunks of ``size``, the last one padded; a multiple of the size gets one more chunk of padding."""
    n = F.floor(F.size(tokens) / F.lit(float(size))).cast("int") + 1
    full = F.concat(tokens, F.array_repeat(F.lit(pad), n * size - F.size(tokens)))
    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.slice(full, i * size + 1, size))


def decode_ids(ids: Column, items: Column) -> Column:
    """Items at 1-based ids; 0 means none and ids beyond the list are ignored."""
    return F.transform(F.filter(ids, lambda i: (i > 0) & (i <= F.size(items))), lambda i: F.element_at(items, i))


def majority(items: Column, test, share: float) -> Column:
    """More than ``share`` of the items pass ``test``."""
    return F.size(F.filter(items, test)) / F.size(items) > share


def all_empty(*lists: Column) -> Column:
    out = F.lit(True)
    for c in lists:
        out = out & (F.coalesce(F.size(c), F.lit(0)) <= 0)
    return out


def top_k_scores(scores: Column, k: int) -> Column:
    """(score, 0-based index) of the k best, ties by index."""
    pairs = F.transform(scores, lambda x, i: F.struct((-x).alias("neg"), i.alias("index")))
    return F.transform(F.slice(F.array_sort(pairs), 1, k), lambda p: F.struct((-p["neg"]).alias("score"), p["index"].alias("index")))


def above(scores: Column, least: float) -> Column:
    """0-based places of the scores of at least ``least``, in order; null scores are below."""
    marked = F.transform(scores, lambda x, i: F.when(x >= least, i))
    return F.filter(marked, lambda i: i.isNotNull())


def masked(scores: Column, least: float) -> Column:
    """1 for scores of at least ``least``, else 0."""
    return F.transform(scores, lambda x: F.when(x >= least, 1).otherwise(0))


def last_k_places(scores: Column, k: int) -> Column:
    """0-based places of the k best scores, the best last; ties by place."""
    ordered = F.array_sort(F.transform(scores, lambda x, i: F.struct(x.alias("x"), i.alias("i"))))
    return F.transform(F.slice(ordered, F.greatest(F.size(ordered) - k, F.lit(0)) + 1, F.lit(k)), lambda p: p["i"])


def relabel(value: Column, names: dict[str, str], default: Column | None = None) -> Column:
    """The dictionary's name of a value; without one, ``default`` or the value itself."""
    table = F.create_map(*(F.lit(x) for pair in names.items() for x in pair))
    return F.coalesce(F.element_at(table, value), value if default is None else default)


def any_prefix(codes: Column, prefixes: Sequence[str]) -> Column:
    """Some code of the list begins with one of the prefixes; null lists have none."""
    hit = lambda c: F.coalesce(*(F.when(c.startswith(p), True) for p in prefixes), F.lit(False))
    return F.coalesce(F.exists(codes, hit), F.lit(False))


def any_keyword(text: Column, words: Sequence[str]) -> Column:
    """The lower-cased text holds one of the words; null texts hold none."""
    low = F.lower(text)
    return F.coalesce(*(F.when(low.contains(w), True) for w in words), F.lit(False))


def rescaled(x: Column, limit: float = 1.0, factor: float = 1000.0) -> Column:
    """Values over the limit are taken for thousandths."""
    return F.when(x > limit, x / factor).otherwise(x)


def masked_sigmoid(logits: Column, mask: Column) -> Column:
    """Probabilities of logits; labels that the mask (0 or 1) leaves out get that of -1e9."""
    return F.zip_with(logits, mask, lambda x, m: F.when(m == 1, 1 / (1 + F.exp(-x))).otherwise(0.0))
