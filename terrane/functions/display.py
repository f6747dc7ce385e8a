"""Forms of figures for tables."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def percent(log_effect: Column) -> Column:
    """A log difference as a change in percent."""
    return F.expm1(log_effect) * 100


def amount(log_effect: Column, level: Column) -> Column:
    """A log difference as an amount at a level."""
    return F.expm1(log_effect) * level


def signed(x: Column, digits: int = 1, unit: str = "%") -> Column:
    """+1.8 %, with an explicit sign; NULL for NULL."""
    return F.when(x.isNotNull(), F.concat(F.when(F.round(x, digits) > 0, "+").otherwise(""), F.format_number(F.round(x, digits) + F.lit(0.0), digits), F.lit(f" {unit}" if unit else "")))


def p_text(p: Column) -> Column:
    """<0.001, three digits below 0.01, else two."""
    return F.when(p < 0.001, "<0.001").when(p < 0.01, F.format_number(p, 3)).when(p.isNotNull(), F.format_number(p, 2))


def pounds(x: Column, plus: bool = False) -> Column:
    """£8,821 or, with ``plus``, +£8,821; a minus stands before the sign of the currency; NULL for NULL."""
    r = F.round(x, 0)
    sign = F.when(r < 0, "-").when((r > 0) & F.lit(plus), "+").otherwise("")
    return F.when(x.isNotNull(), F.concat(sign, F.lit("£"), F.format_number(F.abs(r), 0)))


def thousands(n: Column) -> Column:
    """A count with commas; NULL for NULL."""
    return F.when(n.isNotNull(), F.format_number(n, 0))
