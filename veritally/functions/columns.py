"""Row-wise feature expressions. All stay inside whole-stage codegen."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column
from pyspark.sql import functions as F

EPS = 1e-12

# ICD-9 chapter ranges of the published grouping, tested in this
# order: (group, half-open range, single whole code or None).
ICD_RANGES = [
    ("Diabetes", (250, 251), None),
    ("Circulatory", (390, 460), 785),
    ("Respiratory", (460, 520), 786),
    ("Digestive", (520, 580), 787),
    ("Injury", (800, 1000), None),
    ("Musculoskeletal", (710, 740), None),
    ("Genitourinary", (580, 630), 788),
    ("Neoplasms", (140, 240), None),
]
# Upper bounds and names of the age bands.
AGE_BANDS = [(40, "<40"), (65, "40-64"), (80, "65-79")]

PLAIN_NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"


def clean_number(text: Column) -> Column:
    """Text as double; null unless the whole trimmed text is a plain number."""
    trimmed = F.trim(text)
    return F.when(trimmed.rlike(PLAIN_NUMBER), trimmed.try_cast("double"))


def icd_group(code: Column) -> Column:
    """One of nine diagnosis groups; blank, V, E and unreadable codes are Other."""
    value = clean_number(code)
    out = None
    for name, (low, high), single in ICD_RANGES:
        hit = (value >= low) & (value < high)
        if single is not None:
            hit = hit | (F.floor(value) == single)
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise("Other")


def distinct_across(columns: list[str]) -> Column:
    """Number of distinct non-null values over the columns of a row."""
    values = F.array(*[F.col(c) for c in columns])
    return F.size(F.array_distinct(F.filter(values, lambda x: x.isNotNull())))


def recode(column: Column, mapping: dict, default: str) -> Column:
    """Level recoding; a level without an entry, or null, becomes ``default``."""
    lookup = F.create_map(*[F.lit(x) for pair in mapping.items() for x in pair])
    return F.coalesce(F.try_element_at(lookup, column), F.lit(default))


def flag_not(column: Column, value: str) -> Column:
    return (~column.eqNullSafe(value)).cast("int")


def interaction(flag: Column, level: Column) -> Column:
    """``flag_level`` as text; a null level prints as ``nan``."""
    return F.concat(flag.cast("string"), F.lit("_"), F.coalesce(level, F.lit("nan")))


def bracket_midpoint(bracket: Column, half_width: float = 5.0) -> Column:
    """``[70-80)`` to 75.0, null when there is no leading whole number."""
    low = F.regexp_extract(bracket, r"^[\[)]*\s*([0-9]+)\s*(-|[\[)]*$)", 1)
    return low.try_cast("int") + F.lit(half_width)


def age_band(midpoint: Column) -> Column:
    out = F.when(midpoint.isNull(), "Unknown")
    for upper, name in AGE_BANDS:
        out = out.when(midpoint < upper, name)
    return out.otherwise(">=80")


def count_matching(columns: list[str], test) -> Column:
    """How many columns of the row satisfy ``test``."""
    return reduce(add, [F.coalesce(test(F.col(c)).cast("int"), F.lit(0)) for c in columns], F.lit(0))


def row_total(columns: list[str]) -> Column:
    return reduce(add, [F.col(c) for c in columns])


def unknown_if_missing(column: Column, tokens: list[str]) -> Column:
    return F.when(column.isNull() | column.isin(tokens), "Unknown").otherwise(column)


def clip_probability(p: Column, eps: float = EPS) -> Column:
    return F.least(F.greatest(p, F.lit(eps)), F.lit(1 - eps))


def logit(p: Column, eps: float = EPS) -> Column:
    clipped = clip_probability(p, eps)
    return F.log(clipped / (1 - clipped))


def sigmoid(x: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-x))
