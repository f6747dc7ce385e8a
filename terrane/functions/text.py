"""Column functions on text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Unicode white space, spelled out because a bare \s is ASCII only in Java's and DuckDB's patterns. Fixed values.
WHITE = r"\t-\r\x1c-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once: a lambda variable, which no optimizer rule copies into its uses."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def squash_key(x: Column) -> Column:
    """Key without any white space and in upper case; NULL stays NULL, blank becomes ''."""
    return F.upper(F.regexp_replace(x, f"[{WHITE}]+", ""))


def strip_white(x: Column) -> Column:
    """Outer white space (no-break spaces included) removed; NULL stays NULL."""
    return F.regexp_replace(x, f"^[{WHITE}]+|[{WHITE}]+$", "")


def spaced_postcode(x: Column) -> Column:
    """Upper case without ASCII white space, one space before the last three; NULL under five characters or for NULL."""
    p = F.upper(F.regexp_replace(F.coalesce(x, F.lit("")), r"\s+", ""))
    return F.when(F.length(p) >= 5, F.concat(p.substr(F.lit(1), F.length(p) - 3), F.lit(" "), F.right(p, F.lit(3))))


def year_quarter(d: Column) -> Column:
    """2019Q3; NULL for NULL."""
    return F.concat(F.year(d).cast("string"), F.lit("Q"), F.quarter(d).cast("string"))
