"""Code strings as Column functions: dotting, truncation, padding, normalising."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _dotted(code: Column, after: Column | int) -> Column:
    after = F.lit(after) if isinstance(after, int) else after
    return F.when(code.contains(".") | (F.length(code) <= after), code).otherwise(F.concat(F.substring(code, F.lit(1), after), F.lit("."), F.substring(code, after + 1, F.length(code))))


def dot_diagnosis9(code: Column) -> Column:
    """Dot after three characters, after four for codes that start with E; unchanged if dotted or short."""
    return _dotted(code, F.when(code.startswith("E"), 4).otherwise(3))


def dot_procedure9(code: Column) -> Column:
    return _dotted(code, 2)


def dot_diagnosis10(code: Column) -> Column:
    return _dotted(code, 3)


def dot_code9(code: Column, diagnosis: Column) -> Column:
    """Redot a version-9 code after removing its dots."""
    plain = F.replace(code, F.lit("."), F.lit(""))
    return F.when(diagnosis, dot_diagnosis9(plain)).otherwise(dot_procedure9(plain))


def code_system(version: Column, diagnosis: bool) -> Column:
    return F.when(version == 10, "icd10cm" if diagnosis else "icd10pcs").when(version == 9, "icd9cm" if diagnosis else "icd9pcs")


def normal_system(name: Column) -> Column:
    """ICD-9-CM -> icd9cm and so on; names of unknown systems are lower-cased."""
    return F.lower(F.replace(name, F.lit("-"), F.lit("")))


def truncate_code(code: Column, level: int) -> Column:
    """Category, dot and the first ``level`` characters after it; a bare category has no dot. No match raises."""
    head, tail = F.regexp_extract(code, r"^([^.]{2,4})\.(.*)$", 1), F.regexp_extract(code, r"^([^.]{2,4})\.(.*)$", 2)
    return (
        F.when(code.rlike(r"^[^.]{2,4}$") | code.rlike(r"^[^.]{7}$"), code)
        .when(head != "", F.regexp_replace(F.concat(head, F.lit("."), F.substring(tail, 1, level)), r"\.$", ""))
        .otherwise(F.raise_error(F.concat(F.lit("not a code: "), code)))
    )


def pad_seventh(code: Column) -> Column:
    """Pad with X to seven characters (dot included) so that a seventh may follow."""
    return F.rpad(F.when(F.length(code) == 3, F.concat(code, F.lit("."))).otherwise(code), 7, "X")


def section_id(code: Column) -> Column:
    """A-B stays, A becomes A-A."""
    return F.when(code.contains("-"), code).otherwise(F.concat(code, F.lit("-"), code))


def within_category(code: Column, low: Column, high: Column) -> Column:
    """Range test on the prefix of the bounds' length."""
    return F.substring(code, F.lit(1), F.length(low)).between(low, high)


def prefix_compatible(a: Column, b: Column) -> Column:
    return a.startswith(b) | b.startswith(a)


def split_title(title: Column) -> tuple[Column, Column]:
    """(title without its bracketed modifiers, list of modifiers)."""
    return F.trim(F.regexp_replace(F.regexp_replace(title, r"\([^)]*\)", ""), r" +", " ")), F.regexp_extract_all(title, F.lit(r"\(([^)]*)\)"), 1)


def assignable_code(code: Column) -> tuple[Column, Column]:
    """(code without trailing dashes and dots, whether it had none)."""
    return F.regexp_replace(code, r"[-.]+$", ""), ~code.contains("-")


def lead_id(term_id: Column) -> Column:
    return F.split_part(term_id, F.lit("."), F.lit(1))


def axis_label(label: Column, definition: Column) -> Column:
    return F.when(F.coalesce(definition, F.lit("")) == "", label).otherwise(F.concat(label, F.lit(" ("), definition, F.lit(")")))
