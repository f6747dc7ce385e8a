"""Quantities recorded in different units: published figures as free text, converted to common units.

The method is a physical identity in logarithms: for columns q1..qn with exponents e1..en the sum of
e * (log figure + log unit factor) must vanish. Every combination of admissible units is tried, that with the least
absolute residual is taken, and a second combination within the tolerance makes the solution non-unique. Units that
the text states restrict the combinations.
"""

from __future__ import annotations

import itertools
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrane.functions.text import let

#: Metres per unit. Fixed values.
METRES = {"m": 1.0, "km": 1000.0, "mile": 1609.344, "yard": 0.9144, "foot": 0.3048}
#: Spellings of units. Fixed values.
UNIT = r"(of a miles?|miles?|mi|kilomet(?:re|er)s?|kms?|met(?:re|er)s?|mtrs?|m|yards?|yds?|feet|foot|ft)"
NUMBER = r"(\d{1,3}(?:[, ]\d{3})+(?!\d)(?:\.\d+)?|\d+[.,]\d+|\.\d+|\d+)"
#: Wordings that give no exact figure. Fixed values.
INEXACT = r"\b(about|around|approx\w*|roughly|nearly|almost|circa|withheld)\b|[<>~≈]"
#: Figures in words, longest first. Fixed values.
WORDS = [("three quarters of an?", "0.75"), ("one and a half", "1.5"), ("a quarter of an?", "0.25"), ("half an?", "0.5"), ("half", "0.5"), ("one", "1"), ("two", "2"), ("three", "3"), ("four", "4"), ("five", "5")]
FRACTIONS = [("½", " 1/2"), ("¼", " 1/4"), ("¾", " 3/4"), ("⅓", " 1/3"), ("⅔", " 2/3"), ("⅛", " 1/8")]
#: Unit names in running text. Fixed values.
NAMED = [("km", r"\b(?:kilomet(?:re|er)s?|kms?)\b"), ("mile", r"\bmiles?\b"), ("yard", r"\b(?:yards?|yds?)\b"), ("foot", r"\b(?:feet|foot|ft)\b"), ("m", r"\b(?:met(?:re|er)s?|mtrs?)\b")]

#: The strict form: a figure, with commas between thousands, and one of these units with its metres. Fixed values.
STRICT_UNITS = {"m": 1.0, "metres": 1.0, "meters": 1.0, "km": 1000.0, "kms": 1000.0, "mile": 1609.344, "miles": 1609.344, "of a mile": 1609.344}
STRICT = r"^\s*([\d,]*\.?\d+)\s*(" + "|".join(sorted(STRICT_UNITS)) + r")\s*$"


def strict_metres(text: Column) -> Column:
    """Metres of a text that is a figure and a unit and nothing else, without case; NULL for any other text."""
    s = F.lower(text)
    figure = F.replace(F.regexp_extract(s, STRICT, 1), F.lit(","), F.lit("")).try_cast("double")
    factors = F.create_map(*(F.lit(x) for kv in STRICT_UNITS.items() for x in kv))
    return F.when(s.rlike(STRICT), figure * F.element_at(factors, F.regexp_extract(s, STRICT, 2)))


def unit_code(spelling: Column) -> Column:
    """m, km, mile, yard or foot for a spelling matched by UNIT; NULL for ''."""
    s = spelling
    return (
        F.when(s == "", None).when(s.rlike("^(of a )?mi"), "mile").when(s.rlike("^k"), "km").when(s.rlike("^y"), "yard").when(s.rlike("^f"), "foot").otherwise("m")
    )


def factor(code: Column) -> Column:
    return F.element_at(F.create_map(*(F.lit(x) for kv in METRES.items() for x in kv)), code)


def _plain(text: Column) -> Column:
    s = F.lower(text)
    for mark, ascii_ in FRACTIONS:
        s = F.replace(s, F.lit(mark), F.lit(ascii_))
    s = F.translate(s, "·   ", ".   ")
    s = F.trim(F.regexp_replace(s, r"\s+", " "))
    for words, digits in WORDS:
        s = F.regexp_replace(s, rf"\b{words}\b(?= ?(?:mile|mi\b|kilomet|km|met(?:re|er)|mtr|yard|yd|f(?:oo|ee)?t\b))", digits)
    return s


def _number(s: Column, comma: str) -> Column:
    """A matched NUMBER as double. A comma or space before exactly three digits, after a non-zero part, parts
    thousands (comma = 'thousands') or decimals (comma = 'decimal'); any other comma is a decimal one."""
    grouped = s.rlike(r"^[1-9]\d{0,2}(?:[, ]\d{3})+(?:\.\d+)?$")
    thousands, decimal = F.regexp_replace(s, "[, ]", ""), F.regexp_replace(F.replace(s, F.lit(" "), F.lit("")), ",", ".")
    return F.when(grouped, (thousands if comma == "thousands" else decimal)).otherwise(decimal).try_cast("double")


def read_distance(text: Column) -> Column:
    """Struct of the first distance in a text: ``figure`` (in its own unit), ``figure_alt`` (the same with a lone
    grouping comma read as a decimal one, else NULL), ``extra_m`` (metres of a second, smaller unit as in
    "1 mile 40 yards"), ``unit`` (NULL when the text names none). NULL figure: no exact figure in it, NULL or ''."""
    return let(_plain(text), _first_distance)


def _first_distance(s: Column) -> Column:
    frac = rf"^\D*?(?:(\d+) )?(\d+)/(\d+) ?{UNIT}?(?![a-z])"
    num = rf"^[^\d]*?(?<![\d,.]){NUMBER} ?{UNIT}?(?![a-z])"
    pair = rf"^[^\d]*?(?<![\d,.]){NUMBER} ?{UNIT}(?: and)? {NUMBER} ?{UNIT}(?![a-z])"
    g = lambda rx, i: F.regexp_extract(s, rx, i)
    kind = F.when(s.rlike(INEXACT), "none").when(s.rlike(frac), "frac").when(s.rlike(pair), "pair").when(s.rlike(num), "num").otherwise("none")
    return let(kind, lambda k: _parts(k, g, frac, num, pair))


def _parts(kind: Column, g, frac: str, num: str, pair: str) -> Column:
    is_frac, is_pair, is_num = kind == "frac", kind == "pair", kind == "num"
    whole = F.coalesce(g(frac, 1).try_cast("double"), F.lit(0.0))
    below = g(frac, 3).try_cast("double")
    fraction = whole + g(frac, 2).try_cast("double") / F.when(below != 0, below)
    figure = F.when(is_frac, fraction).when(is_pair, _number(g(pair, 1), "thousands")).when(is_num, _number(g(num, 1), "thousands"))
    alt = F.when(is_num & g(num, 1).rlike(r"^[1-9]\d{0,2},\d{3}$"), _number(g(num, 1), "decimal"))
    code = F.when(is_frac, unit_code(g(frac, 4))).when(is_pair, unit_code(g(pair, 2))).when(is_num, unit_code(g(num, 2)))
    second = unit_code(g(pair, 4))
    extra = F.when(is_pair & (factor(second) < factor(code)), _number(g(pair, 3), "thousands") * factor(second))
    return F.struct(figure.alias("figure"), alt.alias("figure_alt"), extra.alias("extra_m"), code.alias("unit"))


def named_unit(*texts: Column) -> Column:
    """The unit named in running text, the first text that names one counting; NULL if none does."""
    def one(t: Column) -> Column:
        out = F.lit(None).cast("string")
        for code, rx in reversed(NAMED):
            out = F.when(F.lower(t).rlike(rx), code).otherwise(out)
        return out

    return F.coalesce(*(one(t) for t in texts))


def choose_units(figures: list[Column], terms: list[tuple[float, list[tuple[str, float]]]], stated: list[Column | None], tolerance: float = 0.01) -> Column:
    """The units with which the product identity of the figures holds best.

    ``terms``: per figure its exponent and the admissible [(unit, factor to the common unit)]; the identity says that
    the product of (figure * factor) ** exponent is 1. ``stated``: per figure a unit that the source states, or
    None; a NULL leaves the choice free. Struct of ``units`` (in the order of the terms), ``residual`` (signed log
    residual of the choice), ``second`` (least absolute residual of any other combination), ``unique`` (no other
    combination within the tolerance). A NULL, NaN or non-positive figure gives a NULL struct. The combinations form
    a literal, their number is the product of the unit lists; rows are never exploded.
    """
    combos = list(itertools.product(*(units for _, units in terms)))
    usable, base = F.lit(True), F.lit(0.0)
    for f, (e, _) in zip(figures, terms):
        good = f.isNotNull() & ~F.isnan(f) & (f > 0)
        usable, base = usable & good, base + F.when(good, F.log(f)) * float(e)
    names = F.array(*(F.array(*(F.lit(u) for u, _ in combo)) for combo in combos))

    def options(total: Column) -> Column:
        made = []
        for i, combo in enumerate(combos):
            allowed = F.lit(True)
            for says, (u, _) in zip(stated, combo):
                if says is not None:
                    allowed = allowed & F.coalesce(says == u, F.lit(True))
            r = total + sum(e * math.log(f) for (e, _), (_, f) in zip(terms, combo))
            made.append(F.when(allowed, F.struct(F.abs(r).alias("size"), F.lit(i).alias("i"), r.alias("r"))))
        return F.array_sort(F.array_compact(F.array(*made)))

    def choice(ranked: Column) -> Column:
        best, second = F.get(ranked, F.lit(0)), F.get(ranked, F.lit(1))
        return F.when(F.size(ranked) > 0, F.struct(
            F.get(names, best["i"]).alias("units"), best["r"].alias("residual"), second["size"].alias("second"),
            (second["size"].isNull() | (second["size"] > tolerance)).alias("unique"),
        ))

    return F.when(usable, let(let(base, options), choice))


def solve_units(df: DataFrame, terms: list[tuple[str, float, list[tuple[str, float]]]], *, stated: dict[str, Column] | None = None, tolerance: float = 0.01, out: str = "solution") -> DataFrame:
    """``choose_units`` over columns: adds the struct ``out``. Terms are (column, exponent, admissible units)."""
    stated = stated or {}
    choice = choose_units([F.col(n).cast("double") for n, _, _ in terms], [(e, u) for _, e, u in terms], [stated.get(n) for n, _, _ in terms], tolerance)
    return df.withColumn(out, choice)


def reconcile_distances(df: DataFrame, *, published: str, metres: str, texts: list[str], tolerance_m: float = 1.0, tolerance_log: float = 0.01) -> DataFrame:
    """Published distances in metres, and whether the stored metres agree.

    Adds the struct ``units_of`` with ``metres``, ``unit``, ``source`` ('figure', 'text', 'inferred' or NULL),
    ``unique``, ``residual`` and ``wrong``. The identity is figure * factor / stored = 1. A unit in the figure
    restricts the choice, then one named in ``texts``; without either the identity decides, and a choice beyond the
    tolerance or not unique gives no metres. ``wrong`` is true where a stated unit and an exact figure give metres
    that differ by more than ``tolerance_m`` from the stored ones; false otherwise, also for NULLs. A comma before
    three digits parts thousands; with miles, kilometres or no unit it may also be a decimal one, and the reading with
    the lesser residual is taken, thousands where there is no stored value.
    """
    terms = [(1.0, list(METRES.items())), (-1.0, [("m", 1.0)])]

    def solved(x: Column) -> Column:
        def solution(value: Column) -> Column:  # a second unit counts in parts of the first
            f = value + F.coalesce(x["d"]["extra_m"] / factor(x["stated"]), F.lit(0.0))
            return let(f, lambda v: F.when(v.isNotNull(), F.struct(v.alias("f"), choose_units([v, x["stored"]], terms, [x["stated"], None], tolerance_log).alias("s"))))

        def better(both: Column) -> Column:
            a, b = both["a"], both["b"]
            return F.when(b.isNotNull() & F.coalesce(F.abs(b["s"]["residual"]) < F.abs(a["s"]["residual"]), F.lit(False)), b).otherwise(a)

        def verdict(v: Column) -> Column:
            s = v["s"]
            inferred = x["stated"].isNull() & s.isNotNull() & s["unique"] & (F.abs(s["residual"]) <= tolerance_log)
            return let(F.coalesce(x["stated"], F.when(inferred, F.get(s["units"], F.lit(0)))), lambda unit: let(v["f"] * factor(unit), lambda m: F.struct(
                m.alias("metres"), F.when(m.isNotNull(), unit).alias("unit"),
                F.when(m.isNull(), None).when(x["d"]["unit"].isNotNull(), "figure").when(x["stated"].isNotNull(), "text").otherwise("inferred").alias("source"),
                F.when(m.isNotNull(), F.coalesce(s["unique"], x["stated"].isNotNull())).alias("unique"), s["residual"].alias("residual"),
                # the residual of the stated unit finds the case; the bound in metres is exact and follows it
                (x["stated"].isNotNull() & F.coalesce((F.coalesce(s["residual"], F.lit(1.0)) != 0) & ~F.isnan(x["stored"]) & (F.abs(x["stored"] - m) > tolerance_m), F.lit(False))).alias("wrong"),
            )))

        # a lone comma can be a decimal one only where a figure of that size could be meant: with miles and kilometres
        alt = F.when(F.coalesce(x["stated"].isin("mile", "km"), F.lit(True)), x["d"]["figure_alt"])
        both = F.struct(solution(x["d"]["figure"]).alias("a"), solution(alt).alias("b"))
        return let(let(both, better), verdict)

    read = F.struct(read_distance(F.col(published)).alias("d"), named_unit(*(F.col(t) for t in texts)).alias("named"), F.col(metres).cast("double").alias("stored"))
    stated = lambda r: F.struct(r["d"].alias("d"), r["stored"].alias("stored"), F.coalesce(r["d"]["unit"], r["named"]).alias("stated"))
    return df.withColumn("units_of", let(let(read, stated), solved))
