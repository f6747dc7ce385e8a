"""Histograms with bins (k b, (k + 1) b], and a density discontinuity test."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrane.functions.special import normal_two_sided

C = F.col


def bin_index(x: Column, width: float) -> Column:
    """k of the bin (k b, (k + 1) b] that holds x; 0 belongs to the bin below."""
    return F.ceil(x / F.lit(float(width))).cast("long") - 1


def histogram(df: DataFrame, x: str, width: float, reach: float | None = None) -> DataFrame:
    """(bin, centre, n) over the whole range, empty bins included; NULL and NaN are left out, no rows for no values."""
    v = df.where(C(x).isNotNull() & ~F.isnan(x))
    if reach is not None:
        v = v.where(F.abs(x) < reach)
    n = v.groupBy(bin_index(C(x), width).alias("bin")).agg(F.count("*").alias("n"))
    span = n.agg(F.min("bin").alias("a"), F.max("bin").alias("b")).where("a is not null").select(F.explode(F.sequence("a", "b")).alias("bin"))
    return span.join(n, "bin", "left").select("bin", ((C("bin") + 0.5) * float(width)).alias("centre"), F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def binned_means(df: DataFrame, x: str, y: str, width: float) -> DataFrame:
    """(bin, centre, mean, sd, n) of y by bins of x; sd is NULL for one row."""
    v = df.where(C(x).isNotNull() & ~F.isnan(x) & C(y).isNotNull())
    g = v.groupBy(bin_index(C(x), width).alias("bin")).agg(F.avg(y).alias("mean"), F.stddev_samp(y).alias("sd"), F.count("*").alias("n"))
    return g.select("bin", ((C("bin") + 0.5) * float(width)).alias("centre"), "mean", "sd", "n")


def density_step(df: DataFrame, x: str, width: float = 10.0, h: float = 400.0) -> dict:
    """The log step of the density at 0, from weighted lines through the histogram's bins on either side, as ``step``,
    ``error``, ``p``, the densities ``inside`` and ``outside`` of the line, ``rows``, and ``reason`` ('' if it ran:
    there are at least three bins within ``h`` on either side, and the lines end above 0). All sums are made in Spark;
    one row reaches the driver."""
    bins = histogram(df, x, width)
    total = bins.agg(F.sum("n").alias("total"))
    w = F.greatest(F.lit(0.0), 1 - F.abs("centre") / h)
    sums = {"s0": w, "s1": w * C("centre"), "s2": w * C("centre") * C("centre"), "t0": w * C("n"), "t1": w * C("n") * C("centre")}
    sides = bins.where(F.abs("centre") < h).groupBy((C("centre") > 0).alias("inside")).agg(F.count("*").alias("bins"), *(F.sum(v).alias(k) for k, v in sums.items()))
    det = C("s0") * C("s2") - C("s1") * C("s1")
    ends = sides.where("bins >= 3").select("inside", ((C("s2") * C("t0") - C("s1") * C("t1")) / det).alias("at_line"))
    side = lambda inside: F.max(F.when(C("inside") == inside, C("at_line")))
    r = ends.agg(side(True).alias("inside"), side(False).alias("outside")).crossJoin(total).collect()[0]  # single rows
    out = dict.fromkeys(("step", "error", "p", "inside", "outside"), None) | {"rows": r["total"] or 0, "reason": ""}
    if r["inside"] is None or r["outside"] is None:
        return out | {"reason": "fewer than three bins on a side"}
    out |= {k: r[k] / (r["total"] * width) for k in ("inside", "outside")}
    if min(out["inside"], out["outside"]) <= 0:
        return out | {"reason": "no density at the line"}
    step = math.log(out["inside"] / out["outside"])
    error = math.sqrt(4.8 / (r["total"] * h) * (1 / out["inside"] + 1 / out["outside"]))  # 24/5: of the triangular kernel at a line
    return out | {"step": step, "error": error, "p": normal_two_sided(step / error)}
