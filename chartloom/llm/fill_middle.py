"""Fill-in-the-middle transformation by escaped marker injection.

A delimiter is escaped in the text, appended after every unit by one ``regexp_replace``, and counted; two
ranked cuts taken by ``substring_index`` then give prefix, middle and suffix, which are unescaped and
assembled in the order that the row's form asks for. The cuts, the form and the order come from a digest of
the row's id, so they depend on no partition, run or neighbour. One narrow pass without shuffle or Python.

Null texts count as empty, and a row without an id draws as the empty id does. A text that is empty or holds
one of the markers stays plain, as does what the rate leaves out; a very long text costs a few passes over
it. Rows that repeat an id draw the same numbers; equal rows give equal rows; an empty table an empty one.
Columns other than the id and the text are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_or_empty

#: A unit is a run of ASCII letters or any other single code point.
UNITS = r"[A-Za-z]+|[^A-Za-z]"
#: Names of prefix, suffix and middle in the output.
MARKERS = ("<P>", "<S>", "<M>")
#: The delimiter of units, the character that escapes it, and what stands for both.
CUT, ESCAPE = "\u0001", "\u0002"
ESCAPED_ESCAPE, ESCAPED_CUT = ESCAPE + "0", ESCAPE + "1"


def _escaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit(ESCAPE), F.lit(ESCAPED_ESCAPE)), F.lit(CUT), F.lit(ESCAPED_CUT))


def _plain(part: Column) -> Column:
    joined = F.replace(part, F.lit(CUT), F.lit(""))
    return F.replace(F.replace(joined, F.lit(ESCAPED_CUT), F.lit(CUT)), F.lit(ESCAPED_ESCAPE), F.lit(ESCAPE))


def _parts(marked: str, count: Column | str) -> Column:
    """The first (``count`` below zero: the last) parts between delimiters."""
    return F.expr(f"substring_index({marked}, '\\u0001', {count})")


def draws(id_col: str, n: int = 4, seed: str = "1") -> list[Column]:
    """Unsigned 32-bit numbers from the digest of a row's id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(n)]


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 90, spm_percent: int = 20, seed: str = "1", units: str = UNITS) -> DataFrame:
    """Per row: id, text, n (units), form (plain, psm or spm), prefix, middle, suffix (null if plain), output.

    ``percent`` of the rows are transformed, ``spm_percent`` of these with the suffix first. ``units`` is a pattern that
    matches every code point in some unit.
    """
    h1, h2, h3, h4 = draws("id", seed=seed)
    rows = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"))
    pair = f"{ESCAPE}[01]|{units}"  # an escaped character is a unit
    rows = rows.select("id", "text", F.regexp_replace(_escaped(F.col("text")), pair, "$0" + CUT).alias("marked"))
    rows = rows.withColumn("n", (F.octet_length("marked") - F.octet_length(F.replace("marked", F.lit(CUT), F.lit("")))).cast("long"))
    held = F.lit(False)
    for m in MARKERS:
        held = held | F.contains("text", F.lit(m))
    plain = (F.col("text") == "") | held | (h3 % 100 >= percent)
    rows = rows.withColumn("form", F.when(plain, "plain").when(h4 % 100 < spm_percent, "spm").otherwise("psm"))
    first, second = h1 % (F.col("n") + 1), h2 % (F.col("n") + 1)
    rows = rows.select("*", F.least(first, second).cast("int").alias("a"), F.greatest(first, second).cast("int").alias("b"))
    rows = rows.withColumn("head", _parts("marked", "b"))
    # the delimiter after the last unit makes one more, empty part at the end
    cut = rows.select("*", _plain(_parts("head", "a")).alias("p"), _plain(_parts("head", "a - b")).alias("m"), _plain(_parts("marked", "int(b - n - 1)")).alias("s"))
    names = [F.lit(m) for m in MARKERS]
    psm = F.concat(names[0], F.col("p"), names[1], F.col("s"), names[2], F.col("m"))
    spm = F.concat(names[1], F.col("s"), names[0], F.col("p"), names[2], F.col("m"))
    part = lambda c: F.when(F.col("form") != "plain", F.col(c))
    output = F.when(F.col("form") == "plain", F.col("text")).when(F.col("form") == "psm", psm).otherwise(spm)
    return cut.select(F.col("id").alias(id_col), "text", "n", "form", part("p").alias("prefix"), part("m").alias("middle"), part("s").alias("suffix"), output.alias("output"))


def restored(output: str = "output", form: str = "form") -> Column:
    """The text as it was, from an output and its form alone: parts hold no marker, so markers are found by their names."""
    mark_p, mark_s, mark_m = (f"'{m}'" for m in MARKERS)
    of = lambda expr: F.expr(expr.format(o=output, p=mark_p, s=mark_s, m=mark_m))
    middle = of("substring_index({o}, {m}, -1)")
    psm = F.concat(of("substring_index(substring_index({o}, {s}, 1), {p}, -1)"), middle, of("substring_index(substring_index({o}, {m}, 1), {s}, -1)"))
    spm = F.concat(of("substring_index(substring_index({o}, {m}, 1), {p}, -1)"), middle, of("substring_index(substring_index({o}, {p}, 1), {s}, -1)"))
    return F.when(F.col(form) == "plain", F.col(output)).when(F.col(form) == "psm", psm).otherwise(spm)
