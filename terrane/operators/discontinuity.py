"""Local-linear discontinuity estimates with fixed effects, from one grouped aggregate of weighted moments.

Every regressor is, within a cell of (cluster, side, fixed effects), a constant times a power of the running variable.
So a cell needs only the sums of w x^k and w y x^k, and all cross-products are sums of these over cells. Spark makes
the moments of any number of specifications in one aggregate over one scan; what remains at the driver is algebra on
matrices of the size of the number of regressors. A cluster's part of it holds only the regressors that occur in it.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terrane.functions.special import t_critical, t_two_sided
from terrane.session import broadcast_if_small

C = F.col
#: Six-point weights of the wild bootstrap, ascending. Fixed values.
SIX_POINTS = np.array([-np.sqrt(1.5), -1.0, -np.sqrt(0.5), np.sqrt(0.5), 1.0, np.sqrt(1.5)])
#: Bootstrap draws handled at a time.
CHUNK = 1000
_CONST, _INSIDE = 0, 1


class CannotFit(ValueError):
    """A specification that the rows don't allow, with the reason."""


@dataclass
class Spec:
    """What to fit. ``fe``: fixed-effect columns; ``slopes``: own slopes per cluster on each side; ``side``: keep one
    side of the true line only (for placebo lines)."""

    h: float = 400.0
    outcome: str = "log_price"
    running: str = "d_signed"
    cluster: str = "boundary_id"
    fe: tuple[str, ...] = ("property_type", "year_quarter", "boundary_id")
    cutoff: float = 0.0
    donut: float = 0.0
    side: str | None = None
    poly: int = 1
    slopes: bool = False
    draws: int = 0
    seed: int = 20150101
    label: str = ""
    where: list = field(default_factory=list)

    def columns(self) -> set[str]:
        return {self.outcome, self.running, self.cluster, *self.fe}


@dataclass(frozen=True)
class Jump:
    """The step of the outcome at the line under a specification, or the reason why there is none."""

    spec: Spec
    size: float | None = None
    error: float | None = None
    clusters: int | None = None
    rows_inside: int | None = None
    rows_outside: int | None = None
    bootstrap_p: float | None = None
    reason: str = ""

    def interval(self) -> tuple[float | None, float | None]:
        """95 % by t with one degree of freedom less than there are clusters."""
        if self.size is None:
            return None, None
        reach = t_critical(self.clusters - 1) * self.error
        return self.size - reach, self.size + reach

    def p(self) -> float | None:
        return t_two_sided(self.size / self.error, self.clusters - 1) if self.size is not None and self.error > 0 else None

    def record(self) -> dict:
        """The columns of result tables."""
        low, high = self.interval()
        ran, s = self.size is not None, self.spec
        return {
            "label": s.label, "note": f"not run: {self.reason}" if self.reason else "", "bandwidth_m": s.h, "cutoff_m": s.cutoff, "donut_m": s.donut, "poly": s.poly,
            "tau": self.size, "se": self.error, "ci_low": low, "ci_high": high, "p_value": self.p(), "p_wild_bootstrap": self.bootstrap_p,
            "n_inside": self.rows_inside, "n_outside": self.rows_outside, "n_obs": self.rows_inside + self.rows_outside if ran else None, "n_clusters": self.clusters, "df_inference": self.clusters - 1 if ran else None,
        }


_TYPES = {"label": "string", "note": "string", **dict.fromkeys(("poly", "n_inside", "n_outside", "n_obs", "n_clusters", "df_inference"), "long")}


def jump_table(spark: SparkSession, jumps: list[Jump]) -> DataFrame:
    """One row per jump, with the change in percent; those that could not run have the reason as their note."""
    names = list(Jump(Spec()).record())
    df = spark.createDataFrame([tuple(j.record().values()) for j in jumps], ", ".join(f"{n} {_TYPES.get(n, 'double')}" for n in names))
    return df.withColumns({out: F.expm1(c) * 100 for out, c in (("pct", "tau"), ("pct_low", "ci_low"), ("pct_high", "ci_high"))})


def _kept(s: Spec) -> tuple[Column, Column, Column]:
    """Whether a row is in the window, its running variable from the cut-off, and its outcome."""
    r, y = C(s.running).cast("double"), C(s.outcome).cast("double")
    x = r - s.cutoff
    keep = r.isNotNull() & ~F.isnan(r) & y.isNotNull() & ~F.isnan(y) & (F.abs(x) < s.h)
    if s.donut:
        keep = keep & (F.abs(x) >= s.donut)
    if s.side:
        keep = keep & (r > 0 if s.side == "inside" else r <= 0)
    for cond in s.where:
        keep = keep & cond
    return keep, x, y


def window(df: DataFrame, s: Spec) -> DataFrame:
    """Rows of the fit with ``_x`` (running variable from the cut-off), ``_y`` and ``_w`` (triangular weight). NULL
    and NaN in either variable leave the row out; |x| < h is strict, the donut keeps its edge, x = 0 is outside."""
    keep, x, y = _kept(s)
    return df.where(keep).withColumns({"_x": x, "_y": y, "_w": 1 - F.abs(x) / s.h})


def _effects(s: Spec) -> Column:
    return F.array(*(F.coalesce(C(f).cast("string"), F.lit("None")) for f in s.fe)).cast("array<string>")


def moments(df: DataFrame, specs: list[Spec]) -> DataFrame:
    """Cell moments of all specifications from one scan: sums of w x^k (s0, s1, ...) and w y x^k (t0, t1, ...), x scaled
    by the bandwidth, per (spec, cluster, effects, inside). A row goes into every specification whose window holds it;
    their partial sums are combined before the shuffle."""
    def one(i: int, s: Spec) -> Column:
        keep, x, y = _kept(s)
        cell = F.struct(F.lit(i).alias("spec"), F.coalesce(C(s.cluster).cast("string"), F.lit("None")).alias("cluster"), _effects(s).alias("effects"), (x > 0).alias("inside"))
        return F.when(keep, F.struct(cell.alias("cell"), (x / s.h).alias("x"), y.alias("y"), (1 - F.abs(x) / s.h).alias("w")))

    degree = max(s.poly for s in specs)
    rows = df.select(F.explode(F.array_compact(F.array(*(one(i, s) for i, s in enumerate(specs))))).alias("r")).select("r.cell.*", "r.x", "r.y", "r.w")
    power = lambda k: F.lit(1.0) if k == 0 else C("x") if k == 1 else F.pow("x", F.lit(k))
    sums = [F.sum(C("w") * power(k)).alias(f"s{k}") for k in range(2 * degree + 1)] + [F.sum(C("w") * C("y") * power(k)).alias(f"t{k}") for k in range(degree + 1)]
    return rows.groupBy("spec", "cluster", "effects", "inside").agg(F.count("*").alias("n"), *sums)


class Cells:
    """Cell moments at the driver: arrays by column, with clusters and effects as codes in the order of their names."""

    def __init__(self, columns: dict[str, np.ndarray], names: dict[str, np.ndarray]):
        self.columns, self.names = columns, names

    @classmethod
    def collect(cls, df: DataFrame, specs: list[Spec]) -> Cells:
        """As many cells as there are combinations of the clusters and the effects' levels, whatever the rows."""
        m = moments(df, specs)
        effects = [f"e{i}" for i in range(max(len(s.fe) for s in specs))]
        rest = [c for c in m.columns if c not in ("cluster", "effects")]
        t = m.select(*rest, "cluster", *(F.get("effects", F.lit(i)).alias(e) for i, e in enumerate(effects))).toArrow()
        columns, names = {c: t[c].to_numpy() for c in rest}, {}
        for c in ("cluster", *effects):
            coded = t[c].fill_null("").combine_chunks().dictionary_encode()
            words = np.array(coded.dictionary.to_pylist(), dtype=str)
            order = np.argsort(words)
            place = np.empty(len(words), int)
            place[order] = np.arange(len(words))
            columns[c], names[c] = place[coded.indices.to_numpy()], words[order]
        return cls(columns, names)

    def __getitem__(self, column: str) -> np.ndarray:
        return self.columns[column]

    def __len__(self) -> int:
        return len(self.columns["n"])

    def at(self, rows: np.ndarray) -> Cells:
        return Cells({c: v[rows] for c, v in self.columns.items()}, self.names)

    def split(self, column: str) -> dict:
        """The cells of each value of a coded column by its name."""
        order = np.argsort(self[column], kind="stable")
        codes, first = np.unique(self[column][order], return_index=True)
        return {str(self.names[column][c]): self.at(rows) for c, rows in zip(codes, np.split(order, first[1:]))}


class System:
    """The weighted normal equations of one specification, in one block per cluster.

    Column 0 is the constant, 1 the step; then x, x inside, x^2, ...; then the levels of each effect but its first,
    in the order of their names; then own slopes of each cluster but the first.
    """

    def __init__(self, cells: Cells, s: Spec, least_clusters: int = 2):
        """``cells``: those of this specification."""
        if not len(cells):
            raise CannotFit("the window holds no rows")
        i = cells["inside"].astype(float)
        if i.min() == i.max():
            raise CannotFit(f"all rows of the window lie {'inside' if i[0] else 'outside'}")
        there, code = np.unique(cells["cluster"], return_inverse=True)
        self.names = cells.names["cluster"][there]
        if len(self.names) < least_clusters:
            raise CannotFit(f"{len(self.names)} cluster where {least_clusters} are needed")
        self.spec, n, p = s, len(cells), s.poly
        cols, powers, coefs = [np.full(n, _CONST), np.full(n, _INSIDE)], [0, 0], [np.ones(n), i]
        for k in range(1, p + 1):
            cols += [np.full(n, 2 * k), np.full(n, 2 * k + 1)]
            powers += [k, k]
            coefs += [np.ones(n), i]
        width, self.level = 2 + 2 * p, {}
        for j, f in enumerate(s.fe):
            names, at = np.unique(cells[f"e{j}"], return_inverse=True)
            self.level |= {(f, str(cells.names[f"e{j}"][v])): width + m - 1 for m, v in enumerate(names) if m}
            cols.append(np.where(at > 0, width + at - 1, _CONST))
            powers.append(0)
            coefs.append((at > 0).astype(float))
            width += len(names) - 1
        for value in (np.ones(n), i) if s.slopes else ():
            cols.append(np.where(code > 0, width + code - 1, _CONST))
            powers.append(1)
            coefs.append(value * (code > 0))
            width += len(self.names) - 1
        self.width = width
        S, T = [cells[f"s{k}"] for k in range(2 * p + 1)], [cells[f"t{k}"] for k in range(p + 1)]
        # per cluster: the columns that occur in it, their cross-products, those with the outcome; summed for all at once
        key, at = np.unique(np.concatenate([code * width + c for c in cols]), return_inverse=True)
        at = at.reshape(len(cols), n)
        first = np.searchsorted(key, np.arange(len(self.names) + 1) * width)
        used = np.diff(first)
        block = np.r_[0, np.cumsum(used**2)]
        xy, xx, local = np.zeros(len(key)), np.zeros(block[-1]), at - first[code]
        for a in range(len(cols)):
            xy += np.bincount(at[a], coefs[a] * T[powers[a]], len(key))
            for b in range(len(cols)):
                xx += np.bincount(block[code] + local[a] * used[code] + local[b], coefs[a] * coefs[b] * S[powers[a] + powers[b]], block[-1])
        self.parts = [(key[i:j] % width, xx[u:v].reshape(j - i, j - i), xy[i:j]) for i, j, u, v in zip(first, first[1:], block, block[1:])]
        count = cells["n"].astype(float)
        self.rows = np.stack([np.bincount(code, count * i, len(self.names)), np.bincount(code, count * (1 - i), len(self.names))]).astype(int)
        self.M, self.v = np.zeros((width, width)), np.zeros(width)
        for used, xx, xy in self.parts:
            self.M[np.ix_(used, used)] += xx
            self.v[used] += xy

    def solved(self, without: int | None = None) -> tuple[np.ndarray, np.ndarray, int]:
        """Inverse, coefficients and number of regressors in use; ``without``: a cluster taken off by subtraction."""
        M, v = self.M, self.v
        if without is not None:
            used, xx, xy = self.parts[without]
            M, v = M.copy(), v.copy()
            M[np.ix_(used, used)] -= xx
            v[used] -= xy
        inv = np.linalg.pinv(M, rcond=1e-12, hermitian=True)
        return inv, inv @ v, int((np.abs(M).sum(0) > 1e-9).sum())

    def scores(self, row: np.ndarray, beta: np.ndarray) -> np.ndarray:
        """Each cluster's part in the step's residual moment."""
        return np.array([row[used] @ (xy - xx @ beta[used]) for used, xx, xy in self.parts])

    def correction(self, rows: int, regressors: int, clusters: int) -> float:
        """The small-sample factor of the clustered variance."""
        return clusters / (clusters - 1) * (rows - 1) / max(1, rows - regressors)

    def jump(self, without: int | None = None, label: str | None = None) -> Jump:
        keep = np.arange(len(self.names)) != (-1 if without is None else without)
        inv, beta, K = self.solved(without)
        inside, outside = (int(x) for x in self.rows[:, keep].sum(1))
        if keep.sum() < 2 or not inside or not outside:
            raise CannotFit("too little is left")
        variance = self.correction(inside + outside, K, int(keep.sum())) * (self.scores(inv[_INSIDE], beta)[keep] ** 2).sum()
        s = self.spec if label is None else replace(self.spec, label=label)
        return Jump(s, float(beta[_INSIDE]), float(np.sqrt(variance)), int(keep.sum()), inside, outside)

    def bootstrap(self, draws: int, seed: int) -> float:
        """p of the wild cluster bootstrap with the step restricted to 0: the share of draws whose t is at least as
        far from 0. A draw weights each cluster's restricted residuals, so it shifts the coefficients by a linear map of
        its weights; the clusters' scores then follow from these shifts."""
        inv, beta, K = self.solved()
        G = len(self.parts)
        others = np.arange(self.width) != _INSIDE
        null = np.zeros(self.width)
        null[others] = np.linalg.pinv(self.M[np.ix_(others, others)], rcond=1e-12, hermitian=True) @ self.v[others]
        residual, pull = np.zeros((G, self.width)), np.zeros((G, self.width))
        for g, (used, xx, xy) in enumerate(self.parts):
            residual[g, used] = xy - xx @ null[used]
            pull[g, used] = xx @ inv[_INSIDE][used]
        factor = self.correction(int(self.rows.sum()), K, G)
        seen = abs(beta[_INSIDE]) / np.sqrt(factor * (self.scores(inv[_INSIDE], beta) ** 2).sum())
        weights = np.random.default_rng(seed).choice(SIX_POINTS, (draws, G))
        beyond = 0
        for part in np.split(weights, range(CHUNK, draws, CHUNK)):
            shifts = part @ residual @ inv  # of all coefficients, per draw
            score = part * (residual @ inv[_INSIDE]) - shifts @ pull.T
            beyond += int((np.abs(shifts[:, _INSIDE]) >= (seen - 1e-12) * np.sqrt(factor * (score**2).sum(1))).sum())
        return beyond / draws


def systems(df: DataFrame, specs: list[Spec], least: int = 2) -> list[System | CannotFit]:
    """The normal equations of every specification from one scan, or why there are none."""
    lacking = [sorted(s.columns() - set(df.columns)) for s in specs]
    usable = [i for i, miss in enumerate(lacking) if not miss]
    cells = Cells.collect(df, [specs[i] for i in usable]) if usable else None
    out: list[System | CannotFit] = []
    for i, s in enumerate(specs):
        try:
            if lacking[i]:
                raise CannotFit(f"no column {', '.join(lacking[i])}")
            out.append(System(cells.at(np.flatnonzero(cells["spec"] == usable.index(i))), s, least))
        except CannotFit as e:
            out.append(e)
    return out


def jump_of(system: System | CannotFit, s: Spec) -> Jump:
    try:
        if isinstance(system, CannotFit):
            raise system
        j = system.jump()
        return replace(j, bootstrap_p=system.bootstrap(s.draws, s.seed)) if s.draws else j
    except CannotFit as e:
        return Jump(s, reason=str(e))


def fits(df: DataFrame, specs: list[Spec]) -> list[Jump]:
    """A jump for each specification, all from one scan; one that can't be fitted has its reason."""
    return [jump_of(system, s) for system, s in zip(systems(df, specs), specs)]


def fit(df: DataFrame, s: Spec) -> Jump:
    """One jump; ``CannotFit`` where the rows don't allow it."""
    (j,) = fits(df, [s])
    if j.reason:
        raise CannotFit(j.reason)
    return j


def sweep(df: DataFrame, s: Spec, bandwidths: list[float]) -> list[Jump]:
    """Jumps for several bandwidths from one scan."""
    return fits(df, [replace(s, h=float(h), label=f"h = {h:g} m") for h in bandwidths])


def leave_one_out(df: DataFrame, s: Spec) -> list[Jump]:
    """The jump without each cluster in turn (labelled by it), by subtraction of the cluster's block."""
    (system,) = systems(df, [s])
    if isinstance(system, CannotFit):
        return [Jump(replace(s, label="all"), reason=str(system))]
    out = []
    for g, name in enumerate(system.names):
        try:
            out.append(system.jump(g, str(name)))
        except CannotFit as e:
            out.append(Jump(replace(s, label=str(name)), reason=str(e)))
    return out


#: Result rows of ``by_group``.
GROUPS = "grp string, tau double, se double, n_obs long, n_inside long, n_clusters long, p_value double, ci_low double, ci_high double, note string"


def by_group(df: DataFrame, group: str, s: Spec) -> DataFrame:
    """A separate fit for every value of ``group``, clustered on ``s.cluster`` however many clusters there are.

    Pass one: moments per group, without clusters, solved at the driver (as many small systems as groups). Pass two:
    each row's score under its group's coefficients, summed per cluster and then squared per group, in Spark. A group
    that can't be fitted (one side empty, a single cluster, no more rows than regressors) is a row with the reason.
    """
    spark = df.sparkSession
    plain = replace(s, cluster=group)
    lines, heads, out = [], {}, []
    names = [r[0] for r in df.where(C(group).isNotNull()).select(C(group).cast("string")).distinct().collect()]
    cells = Cells.collect(df, [plain]).split("cluster")
    for g in names:
        try:
            if g not in cells:
                raise CannotFit("the window holds no rows")
            system = System(cells[g], plain, least_clusters=1)
        except CannotFit as e:
            out.append((g, *[None] * 8, f"not run: {e}"))
            continue
        inv, beta, K = system.solved()
        heads[g] = (float(beta[_INSIDE]), K)
        own = [cells[g].names[f"e{i}"][cells[g][f"e{i}"]] for i in range(len(s.fe))]
        for inside, *effects in {(bool(i), *map(str, e)) for i, *e in zip(cells[g]["inside"], *own)}:
            extra = [system.level[(f, v)] for f, v in zip(s.fe, effects) if (f, v) in system.level]
            line = lambda b: [float(b[_CONST] + inside * b[_INSIDE] + b[extra].sum()), *(float(b[2 * k] + inside * b[2 * k + 1]) for k in range(1, s.poly + 1))]  # noqa: E731,B023
            lines.append((g, inside, effects, line(beta), line(inv[_INSIDE])))
    if lines:
        coef = spark.createDataFrame(lines, "_g string, _i boolean, _fe array<string>, _b array<double>, _m array<double>")
        rows = window(df, s).withColumns({"_g": C(group).cast("string"), "_i": C("_x") > 0, "_fe": _effects(s), "_xs": C("_x") / s.h})
        j = rows.join(broadcast_if_small(coef), ["_g", "_i", "_fe"])
        poly = lambda a: sum((F.get(C(a), F.lit(k)) * F.pow("_xs", F.lit(k)) for k in range(1, s.poly + 1)), F.get(C(a), F.lit(0)))
        sc = j.groupBy("_g", C(s.cluster).alias("_c")).agg(F.sum(C("_w") * poly("_m") * (C("_y") - poly("_b"))).alias("_s"), F.count("*").alias("_n"), F.sum(C("_i").cast("long")).alias("_in"))
        for r in sc.groupBy("_g").agg(F.sum(C("_s") * C("_s")).alias("ss"), F.count("*").alias("G"), F.sum("_n").alias("n"), F.sum("_in").alias("n_in")).collect():
            (tau, K), G, n = heads[r["_g"]], r["G"], r["n"]
            if G < 2 or n <= K:
                out.append((r["_g"], *[None] * 8, "not run: " + ("1 cluster where 2 are needed" if G < 2 else f"{n} rows for {K} regressors")))
                continue
            one = Jump(s, tau, float(np.sqrt(G / (G - 1) * (n - 1) / (n - K) * r["ss"])), G, r["n_in"], n - r["n_in"])
            out.append((r["_g"], tau, one.error, n, r["n_in"], G, one.p(), *one.interval(), ""))
    return spark.createDataFrame(out, GROUPS)


def side_intercepts(df: DataFrame, s: Spec, keys: list[str] = ()) -> DataFrame:
    """Closed form without fixed effects: per key the intercepts of both sides at the line and their difference."""
    x = C("_x")
    agg = window(df, s).groupBy(*keys, (x > 0).alias("inside")).agg(*(F.sum(C("_w") * v).alias(n) for n, v in (("s0", F.lit(1.0)), ("s1", x), ("s2", x * x), ("t0", C("_y")), ("t1", x * C("_y")))), F.count("*").alias("n"))
    det = C("s0") * C("s2") - C("s1") * C("s1")  # next to nothing when all rows lie at one distance
    at = (C("s2") * C("t0") - C("s1") * C("t1")) / F.when(det > 1e-9 * C("s0") * C("s2"), det)
    per = agg.withColumn("a", at)
    return per.groupBy(*keys).agg(
        F.max(F.when(C("inside"), C("a"))).alias("inside_at_line"), F.max(F.when(~C("inside"), C("a"))).alias("outside_at_line"),
        F.coalesce(F.sum(F.when(C("inside"), C("n"))), F.lit(0)).alias("n_inside"), F.coalesce(F.sum(F.when(~C("inside"), C("n"))), F.lit(0)).alias("n_outside"),
    ).withColumn("tau", C("inside_at_line") - C("outside_at_line"))
