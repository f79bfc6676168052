"""Truth, tokens and set similarity as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: words that do not tell plants apart (folding of sources)
FOLD_STOP = [
    "INC", "LLC", "CORP", "CORPORATION", "COMPANY", "PLANT", "MILL", "STATION", "FACILITY", "FACILITIES", "SYSTEMS", "SYSTEM", "USA", "VIRGINIA",
    "THE", "AND", "HOLDINGS", "PRODUCTS", "SERVICE", "SERVICES", "GROUP", "LIMITED", "PARTNERSHIP", "OPERATING", "INCORPORATED", "CENTER", "DATA",
]
# fixed values: words that do not tell plants apart (review flags)
FLAG_STOP = [
    "plant", "mill", "works", "corp", "company", "incorporated", "center", "centre", "data", "facility", "systems", "group", "services", "virginia", "station",
]


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def truthy(c, kind: str = "string") -> Column:
    """Neither null, nor zero, nor empty."""
    c = _col(c)
    if kind == "number":
        return c.isNotNull() & (c != 0)
    if kind == "array":
        return c.isNotNull() & (F.size(c) > 0)
    return c.isNotNull() & (c != "")


def words(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def fold_tokens(name) -> Column:
    """Distinct upper-case tokens of three or more letters or digits, without FOLD_STOP, sorted."""
    found = F.regexp_extract_all(F.upper(F.coalesce(_col(name), F.lit(""))), F.lit("[A-Z0-9]{3,}"), 0)
    return F.array_sort(F.array_except(F.array_distinct(found), words(FOLD_STOP)))


def flag_tokens(name) -> Column:
    """Distinct lower-case tokens of four or more letters or digits, without FLAG_STOP, sorted."""
    found = F.regexp_extract_all(F.lower(F.coalesce(_col(name), F.lit(""))), F.lit("[a-z0-9]{4,}"), 0)
    return F.array_sort(F.array_except(F.array_distinct(found), words(FLAG_STOP)))


def jaccard(a, b) -> Column:
    """Shared over all of two sets of tokens; null if both are empty."""
    a, b = _col(a), _col(b)
    return F.try_divide(F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b)))


def subset_either(a, b) -> Column:
    """One set holds the other."""
    a, b = _col(a), _col(b)
    return (F.size(F.array_except(a, b)) == 0) | (F.size(F.array_except(b, a)) == 0)


def squeeze(c) -> Column:
    """Lower case, trimmed, runs of white space as one space."""
    return F.trim(F.regexp_replace(F.lower(_col(c)), r"\s+", " "))
