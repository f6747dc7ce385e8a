"""Checks of a discontinuity: a table of variants of one specification, fitted together from one scan of the sample.

A check that can't run is a row with its reason. Every variant is data (``variants``), so that a caller can add or take
away checks; shares, densities and the fits before and after a change are added by their own aggregates.
"""

from __future__ import annotations

from dataclasses import replace
from itertools import chain

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrane.operators import density
from terrane.operators import discontinuity as rd
from terrane.session import broadcast_if_small

C = F.col
#: Settings of the checks. Fixed values.
PLACEBO_M, DONUT_M, SHARE_M, BIN_M = (-500.0, -250.0, 250.0, 500.0), (25.0, 50.0), (25.0, 50.0), 10.0
BALANCE = ("is_flat", "is_detached", "is_leasehold", "is_new_build", "imd19_rank", "dist_station_m")
#: Outcomes that say what the effect of the type says already.
TYPE_OUTCOMES = {"is_flat", "is_detached"}


def variants(base: rd.Spec, yearly: str) -> list[rd.Spec]:
    """The specifications of all checks that are fits, labelled 'check: variant'."""
    change = lambda label, **what: replace(base, label=label, **what)
    beyond = {True: "inside", False: "outside"}  # a placebo line takes the rows of its own side only
    untyped = tuple(f for f in base.fe if f != "property_type")
    return [
        *(change(f"placebo: {m:+.0f} m", cutoff=m, side=beyond[m > 0]) for m in PLACEBO_M),
        *(change(f"balance: {y}", outcome=y, fe=untyped if y in TYPE_OUTCOMES else base.fe) for y in BALANCE),
        *(change(f"donut: {m:.0f} m", donut=m) for m in DONUT_M),
        change(f"line of the year: {yearly}", running=yearly),
        change("one region near: n_near < 2", where=[C("n_near") < 2]),
        change("slopes: per region", slopes=True),
        change("effects: and tenure, new_build", fe=(*base.fe, "tenure", "new_build")),
        change("curve: quadratic", poly=2),
    ]


def run_all(sample: DataFrame, base: rd.Spec, yearly: str = "d_year", halves: DataFrame | None = None) -> DataFrame:
    """(check, variant, columns of ``discontinuity.jump_table``) of all checks. ``yearly``: a second running variable.
    ``halves``: rows of ``timing_halves``, for the fits before and after each change; without it that check can't run.
    """
    spark, specs = sample.sparkSession, variants(base, yearly)
    *fitted, main = rd.systems(sample, [*specs, base])
    jumps = [rd.jump_of(system, s) for system, s in zip(fitted, specs)]
    if isinstance(main, rd.CannotFit):
        jumps.append(rd.Jump(replace(base, label="without: any"), reason=str(main)))
    else:
        jumps += [_left_out(main, g, str(name)) for g, name in enumerate(main.names)]
    table = rd.jump_table(spark, jumps)
    parts = [table, _shares(sample, base), _densities(sample, base)]
    if halves is None:
        parts.append(_row(sample, "timing: all", "not run: no changes given"))
    else:
        t = rd.by_group(halves, "part", replace(base, cluster="postcode", fe=tuple(f for f in base.fe if f != base.cluster)))
        t = t.withColumn("label", F.concat(F.lit("timing: "), "grp")).drop("grp")
        parts.append(_row(sample, "timing: all", "not run: no change far enough from either end") if t.isEmpty() else t)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    said = F.split("label", ": ", 2)
    return out.select(said[0].alias("check"), F.get(said, F.lit(1)).alias("variant"), *(c for c in out.columns if c != "label"))


def _left_out(system: rd.System, g: int, name: str) -> rd.Jump:
    try:
        return system.jump(g, f"without: {name}")
    except rd.CannotFit as e:
        return rd.Jump(replace(system.spec, label=f"without: {name}"), reason=str(e))


def _row(sample: DataFrame, label: str, note: str) -> DataFrame:
    return sample.sparkSession.createDataFrame([(label, note)], "label string, note string")


def _shares(sample: DataFrame, base: rd.Spec) -> DataFrame:
    """The share of rows that lie so close to the line that an error of their place may change their side."""
    near = [F.struct(F.lit(f"closeness: {m:.0f} m").alias("label"), F.avg((F.abs(base.running) < m).cast("double")).alias("tau"), F.count("*").alias("n_obs"), F.lit("share of rows").alias("note")) for m in SHARE_M]
    return sample.agg(F.array(*near).alias("a")).select(F.inline("a"))


def _densities(sample: DataFrame, base: rd.Spec) -> DataFrame:
    """The step of the density at the line, of rows and of places (a place counts once per region)."""
    places = sample.groupBy(base.cluster, "postcode").agg(F.min_by(base.running, "txn_id").alias(base.running))
    rows = []
    for name, d in (("sales", sample), ("postcodes", places)):
        r = density.density_step(d, base.running, BIN_M, base.h)
        ran = r["reason"] == ""
        ends = [r["step"] + k * 1.96 * r["error"] for k in (-1, 1)] if ran else [None, None]
        rows.append((f"density: {name}", r["step"], r["error"], *ends, r["p"], r["rows"], base.h, "" if ran else f"not run: {r['reason']}"))
    return sample.sparkSession.createDataFrame(rows, "label string, tau double, se double, ci_low double, ci_high double, p_value double, n_obs long, bandwidth_m double, note string")


def verdict(rows: DataFrame) -> DataFrame:
    """Per check whether its interval excludes 0 in all, some or none of its rows."""
    ran = C("ci_low").isNotNull()
    apart = (C("ci_low") > 0) | (C("ci_high") < 0)
    g = rows.groupBy("check").agg(F.count("*").alias("n"), F.count(F.when(ran, 1)).alias("n_run"), F.count(F.when(ran & apart, 1)).alias("n_excl"))
    return g.withColumn("verdict", F.when(C("n_run") == 0, "context").when(C("n_excl") == 0, "holds").when(C("n_excl") == C("n_run"), "flag").otherwise("mixed"))


def timing_halves(sample: DataFrame, changes: DataFrame, region: str, at: str, name: str | None = None) -> DataFrame:
    """Sample rows marked 'before' or 'after' each change (region, at) of their region, one copy per change. Rows
    without a date are left out. ``name``: a column of the changes that names them; adds ``part``, name and half."""
    given = changes.select(C(region), C(at).alias("change_at"), *([C(name).alias("_name")] if name else []))
    j = sample.where("date is not null").join(broadcast_if_small(given), region)
    j = j.withColumn("half", F.when(C("date") < C("change_at").cast("date"), "before").otherwise("after"))
    return j.withColumn("part", F.concat_ws(", ", "_name", "half")).drop("_name") if name else j


def residualised(sample: DataFrame, y: str, effects: list[str]) -> DataFrame:
    """Adds ``<y>_res``: residual of y from least squares on the effects' dummies, plus the mean of y. The cells of
    the effects, as many as their levels, give the coefficients; rows with NULL y are left out."""
    keys = [f"_e{i}" for i in range(len(effects))]
    rows = sample.where(C(y).isNotNull() & ~F.isnan(C(y).cast("double"))).withColumns({k: F.coalesce(C(e).cast("string"), F.lit("None")) for k, e in zip(keys, effects)})
    cells = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.sum(C(y).cast("double")).alias("t")).collect()
    if not cells:
        return rows.drop(*keys).withColumn(f"{y}_res", C(y).cast("double"))
    dummies = chain.from_iterable([(k, v) for v in sorted({c[k] for c in cells})[1:]] for k in keys)
    at = {d: i for i, d in enumerate(dummies, 1)}
    X = np.zeros((len(cells), len(at) + 1))
    X[:, 0] = 1
    for i, c in enumerate(cells):
        X[i, [at[(k, c[k])] for k in keys if (k, c[k]) in at]] = 1
    n, t = np.array([c["n"] for c in cells], float), np.array([c["t"] for c in cells])
    fitted = X @ (np.linalg.pinv(X.T @ (X * n[:, None]), rcond=1e-12, hermitian=True) @ (X.T @ t))
    mean = t.sum() / n.sum()
    table = sample.sparkSession.createDataFrame([(*(c[k] for k in keys), float(f - mean)) for c, f in zip(cells, fitted)], ", ".join(f"{k} string" for k in keys) + ", _fit double")
    return rows.join(broadcast_if_small(table), keys).withColumn(f"{y}_res", C(y).cast("double") - C("_fit")).drop("_fit", *keys)


def side_lines(sample: DataFrame, y: str, s: rd.Spec, step: float) -> DataFrame:
    """(side, x, fitted, low, high): on either side the weighted line through y with a pointwise 95 % band (normal,
    errors clustered), at multiples of ``step`` from the line. Two moments aggregates: one for the line, one, per
    cluster, for the scores' products. A side that can't be fitted gives no rows."""
    w = rd.window(sample, replace(s, outcome=y)).withColumn("side", F.when(C("_x") > 0, "inside").otherwise("outside"))
    sums = {"s0": C("_w"), "s1": C("_w") * C("_x"), "s2": C("_w") * C("_x") * C("_x"), "t0": C("_w") * C("_y"), "t1": C("_w") * C("_x") * C("_y")}
    per = w.groupBy("side", C(s.cluster).alias("g")).agg(F.count("*").alias("n"), *(F.sum(v).alias(k) for k, v in sums.items()))
    whole = per.groupBy("side").agg(F.sum("n").alias("all_n"), F.count("*").alias("all_g"), *(F.sum(k).alias(f"all_{k}") for k in sums))
    det = C("all_s0") * C("all_s2") - C("all_s1") * C("all_s1")
    line = whole.where(det > 1e-9 * C("all_s0") * C("all_s2")).withColumns({"a": (C("all_s2") * C("all_t0") - C("all_s1") * C("all_t1")) / det, "b": (C("all_s0") * C("all_t1") - C("all_s1") * C("all_t0")) / det, "det": det})
    line = line.where("all_g > 1 and all_n > 2")
    u0, u1 = C("t0") - C("a") * C("s0") - C("b") * C("s1"), C("t1") - C("a") * C("s1") - C("b") * C("s2")
    # the inverse of the cross-products times each cluster's scores: its pull on intercept and slope
    pulled = per.join(F.broadcast(line), "side").withColumns({"_pa": (C("all_s2") * u0 - C("all_s1") * u1) / C("det"), "_pb": (C("all_s0") * u1 - C("all_s1") * u0) / C("det")})  # at most two rows
    cov = pulled.groupBy("side", "a", "b", "all_g", "all_n").agg(F.sum(C("_pa") * C("_pa")).alias("aa"), F.sum(C("_pa") * C("_pb")).alias("ab"), F.sum(C("_pb") * C("_pb")).alias("bb"))
    sign = F.when(C("side") == "inside", 1.0).otherwise(-1.0)
    grid = cov.withColumn("x", F.explode(F.sequence(F.lit(0), F.lit(int(s.h // step))))).withColumn("x", C("x") * F.lit(float(step)) * sign + F.lit(0.0))
    small = C("all_g") / (C("all_g") - 1) * (C("all_n") - 1) / (C("all_n") - 2)
    reach = 1.959963984540054 * F.sqrt(small * (C("aa") + 2 * C("x") * C("ab") + C("x") * C("x") * C("bb")))
    fitted = C("a") + C("b") * C("x")
    return grid.select("side", "x", fitted.alias("fitted"), (fitted - reach).alias("low"), (fitted + reach).alias("high"))
