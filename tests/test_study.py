"""Assignment, discontinuity, density, histories, quality."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrane.functions.special import normal_two_sided, t_critical, t_two_sided
from terrane.functions.text import spaced_postcode
from terrane.operators import assign, battery, changes, density, discontinuity as rd, governance, quality


@pytest.fixture(scope="module")
def sample(spark):
    rng = np.random.default_rng(42)
    n, B = 6000, 12
    b = rng.integers(0, B, n)
    x = rng.uniform(-740, 740, n)
    typ, q = rng.choice(list("DSTF"), n), rng.choice(["2019Q1", "2019Q2", "2020Q1"], n)
    y = 12 + rng.normal(0, 0.3, B)[b] + 0.08 * (x > 0) + 0.0001 * x + 0.1 * (typ == "D") + rng.normal(0, 0.25, n)
    rows = [(f"t{i}", f"B{b[i]:02d}", float(x[i]), float(y[i]), typ[i], q[i], "F" if i % 3 else "L", "N" if i % 7 else "Y", f"P{b[i]}-{int(x[i] // 60)}", 1 + int(i % 11 == 0), float(typ[i] == "F"), float(x[i] + 5)) for i in range(n)]
    return spark.createDataFrame(rows, "txn_id string, boundary_id string, d_signed double, log_price double, property_type string, year_quarter string, tenure string, new_build string, postcode string, n_near int, is_flat double, d_year double").persist()


def _dense(pdf, h, poly=1, slopes=False, fe=("property_type", "year_quarter", "boundary_id")):
    w = pdf[pdf.d_signed.abs() < h]
    x, i = w.d_signed.to_numpy() / h, (w.d_signed > 0).to_numpy(float)
    cols = [np.ones(len(w)), i]
    for k in range(1, poly + 1):
        cols += [x**k, x**k * i]
    if slopes:
        for g in sorted(w.boundary_id.unique())[1:]:
            m = (w.boundary_id == g).to_numpy(float)
            cols += [m * x, m * x * i]
    for f in fe:
        cols += [(w[f] == v).to_numpy(float) for v in sorted(w[f].unique())[1:]]
    return w, np.column_stack(cols), w.log_price.to_numpy(), 1 - np.abs(x)


@pytest.mark.parametrize("poly, slopes", [(1, False), (2, False), (1, True)])
def test_fit_equals_dense_least_squares(sample, poly, slopes):
    w, X, y, wt = _dense(sample.toPandas(), 400, poly, slopes)
    inv = np.linalg.inv(X.T @ (X * wt[:, None]))
    beta = inv @ (X.T @ (y * wt))
    s = np.array([inv[1] @ (X[m].T @ (wt[m] * (y[m] - X[m] @ beta))) for m in ((w.boundary_id == g).to_numpy() for g in sorted(w.boundary_id.unique()))])
    G, n, K = len(s), *X.shape
    se = math.sqrt(G / (G - 1) * (n - 1) / (n - K) * (s**2).sum())
    e = rd.fit(sample, rd.Spec(h=400, poly=poly, slopes=slopes, draws=499))
    assert e.size == pytest.approx(beta[1], abs=1e-9) and e.error == pytest.approx(se, abs=1e-9) and (e.rows_inside + e.rows_outside, e.clusters) == (n, G)
    low, high = e.interval()
    assert low < 0.08 < high and e.bootstrap_p < 0.05


def test_bootstrap_equals_refitted_draws(sample):
    """Every draw refitted with dense algebra on the rows."""
    few = sample.where("boundary_id < 'B04'")
    w, X, y, wt = _dense(few.toPandas(), 400, fe=("property_type", "boundary_id"))
    names, groups = np.unique(w.boundary_id.to_numpy(str), return_inverse=True)
    inv, G = np.linalg.inv(X.T @ (X * wt[:, None])), len(names)
    rest = np.delete(X, 1, axis=1)
    null = rest @ np.linalg.lstsq(rest * np.sqrt(wt)[:, None], y * np.sqrt(wt), rcond=None)[0]

    def t(values):
        b = inv @ (X.T @ (values * wt))
        s = np.array([inv[1] @ (X[groups == g].T @ (wt * (values - X @ b))[groups == g]) for g in range(G)])
        return abs(b[1]) / np.sqrt((s**2).sum())

    draws = np.random.default_rng(5).choice(rd.SIX_POINTS, (60, G))
    want = np.mean([t(null + d[groups] * (y - null)) >= t(y) - 1e-12 for d in draws])
    assert rd.fit(few, rd.Spec(h=400, fe=("property_type", "boundary_id"), draws=60, seed=5)).bootstrap_p == pytest.approx(want)


def test_sweep_leave_one_out_and_groups(sample):
    out = rd.sweep(sample, rd.Spec(), [200.0, 400.0, 0.001])
    assert out[1].size == pytest.approx(rd.fit(sample, rd.Spec(h=400)).size, abs=1e-10) and out[0].size == pytest.approx(rd.fit(sample, rd.Spec(h=200)).size, abs=1e-10)
    assert out[2].size is None and out[2].reason and out[2].record()["note"].startswith("not run: ")
    e = rd.leave_one_out(sample, rd.Spec())[3]
    direct = rd.fit(sample.where(F.col("boundary_id") != e.spec.label), rd.Spec())
    assert e.size == pytest.approx(direct.size, abs=1e-8) and e.error == pytest.approx(direct.error, rel=1e-6)
    spec = rd.Spec(cluster="postcode", fe=("property_type", "year_quarter"))
    cut_off = sample.where("boundary_id <> 'B05' or d_signed > 0")  # one group has a side without rows
    rows = {r["grp"]: r for r in rd.by_group(cut_off, "boundary_id", spec).collect()}
    one = rd.fit(sample.where("boundary_id = 'B03'"), spec)
    row = rows["B03"]
    assert row["tau"] == pytest.approx(one.size, abs=1e-8) and row["se"] == pytest.approx(one.error, rel=1e-6) and row["n_clusters"] == one.clusters
    assert len(rows) == 12 and rows["B05"]["tau"] is None and rows["B05"]["note"].startswith("not run: ")


def test_fit_refuses(sample):
    with pytest.raises(ValueError):
        rd.fit(sample.where("d_signed > 0"), rd.Spec())
    with pytest.raises(ValueError):
        rd.fit(sample.where("boundary_id = 'B01'"), rd.Spec())
    with pytest.raises(ValueError):
        rd.fit(sample.limit(0), rd.Spec())


def test_battery_reports_everything(spark, sample):
    dated = sample.withColumns({"n_near": F.lit(1), "date": F.expr("date_add(date'2019-01-01', cast(abs(d_signed) as int))")})
    changes_ = spark.createDataFrame([("B01", "2019-06-01", "B01 2 to 1"), ("B02", "2018-01-01", "B02 1 to 3")], "boundary_id string, at string, name string").withColumn("at", F.col("at").cast("timestamp"))
    halves = battery.timing_halves(dated, changes_, "boundary_id", "at", "name")
    df = battery.run_all(dated, rd.Spec(), halves=halves)
    rows = df.collect()
    assert {r["check"] for r in rows} == {"placebo", "balance", "density", "donut", "timing", "closeness", "line of the year", "one region near", "slopes", "effects", "curve", "without"}
    assert sum(r["check"] == "without" for r in rows) == 12
    assert {r["variant"] for r in rows if r["check"] == "timing"} == {"B01 2 to 1, before", "B01 2 to 1, after", "B02 1 to 3, after"}
    assert [r["note"] for r in rows if r["variant"] == "imd19_rank"] == ["not run: no column imd19_rank"]
    v = {r["check"]: r["verdict"] for r in battery.verdict(df).collect()}
    assert v["donut"] == "flag" and v["closeness"] == "context"
    assert {r["note"] for r in battery.run_all(dated.limit(0), rd.Spec()).where("check in ('timing', 'without', 'density')").collect()} == {"not run: no changes given", "not run: the window holds no rows", "not run: fewer than three bins on a side"}


def test_side_lines(sample):
    w, X, y, wt = _dense(sample.toPandas(), 400, fe=())
    got = {(r["side"], r["x"]): r for r in battery.side_lines(sample, "log_price", rd.Spec(), 100.0).collect()}
    assert len(got) == 10
    for side, at in (("inside", w.d_signed.to_numpy() > 0), ("outside", w.d_signed.to_numpy() <= 0)):
        x, z, v = w.d_signed.to_numpy()[at], y[at], wt[at]
        A = np.column_stack([np.ones(len(x)), x])
        inv = np.linalg.inv(A.T @ (A * v[:, None]))
        b, names = inv @ (A.T @ (z * v)), w.boundary_id.to_numpy(str)[at]
        s = np.array([inv @ (A[names == g].T @ (v * (z - A @ b))[names == g]) for g in np.unique(names)])
        G, n = len(s), len(x)
        V = s.T @ s * G / (G - 1) * (n - 1) / (n - 2)
        p = np.array([1.0, 200.0 if side == "inside" else -200.0])
        r = got[(side, p[1])]
        assert r["fitted"] == pytest.approx(p @ b, abs=1e-9) and r["high"] - r["fitted"] == pytest.approx(1.959964 * math.sqrt(p @ V @ p), rel=1e-5)


def test_residuals(sample):
    w, X, y, _ = _dense(sample.toPandas(), 1e9)
    X = np.delete(X, [1, 2, 3], axis=1)
    want = y - X @ np.linalg.lstsq(X, y, rcond=None)[0] + y.mean()
    got = battery.residualised(sample, "log_price", ["property_type", "year_quarter", "boundary_id"]).toPandas().set_index("txn_id").log_price_res
    assert np.allclose(got[w.txn_id].to_numpy(), want, atol=1e-9)


def test_histogram_and_density(spark):
    df = spark.createDataFrame([(-10.0,), (0.0,), (0.0,), (5.0,), (None,), (float("nan"),)], "d double")
    assert {(r["centre"], r["n"]) for r in density.histogram(df, "d", 10).collect()} == {(-15.0, 1), (-5.0, 2), (5.0, 1)}
    assert density.histogram(df.limit(0), "d", 10).count() == 0
    rng = np.random.default_rng(1)
    u = rng.uniform(-400, 400, 20000)
    even = spark.createDataFrame([(float(v),) for v in u], "d double")
    bunched = spark.createDataFrame([(float(-v if -100 < v < 0 and i % 2 else v),) for i, v in enumerate(u)], "d double")
    assert density.density_step(even, "d")["p"] > 0.01 and density.density_step(bunched, "d")["p"] < 0.001
    h = {r["centre"]: r["n"] for r in density.histogram(even, "d", 10.0).collect()}

    def end(side):
        x = np.array([c for c in h if 0 < c * side and abs(c) < 400])
        return np.polyfit(x, [h[c] / 20000 / 10 for c in x], 1, w=np.sqrt(1 - np.abs(x) / 400))[1]

    r = density.density_step(even, "d")
    assert (r["inside"], r["outside"]) == pytest.approx((end(1), end(-1))) and r["step"] == pytest.approx(math.log(end(1) / end(-1)))
    assert density.density_step(even.limit(0), "d")["reason"] and density.density_step(even.where("d > 0"), "d")["reason"]


def test_tails():
    assert t_two_sided(2.200985, 11) == pytest.approx(0.05, abs=1e-6) and t_critical(11) == pytest.approx(2.2009852, abs=1e-6)
    assert normal_two_sided(1.959964) == pytest.approx(0.05, abs=1e-6) and t_two_sided(0, 5) == 1


def test_assignment_rules(spark):
    pairs = spark.createDataFrame([("s0", "A", -100.0), ("s0", "B", 300.0), ("s1", "A", -50.0), ("s1", "B", -600.0), ("s2", "A", 20.0), ("s2", "B", 30.0), ("s2", "B", 30.0), ("s3", "A", 0.0), ("s4", "A", 10.0), ("s4", "B", 10.0)], "s string, b string, d_signed double")
    got = {r["s"]: (r["b"], r["n_near"]) for r in assign.assign_nearest(pairs, "s", "b").collect()}
    assert got == {"s0": ("B", 2), "s1": ("A", 1), "s2": ("A", 2), "s3": ("A", 1), "s4": ("A", 2)}


def test_regions_that_are_no_alternatives(spark):
    pairs = spark.createDataFrame([("s1", "A", -50.0, "Girls"), ("s1", "B", 200.0, "boys"), ("s2", "A", -50.0, "Girls"), ("s2", "C", 200.0, "mixed"), ("s3", "A", -5.0, "Girls"), ("s3", "D", 100.0, None)], "s string, b string, d_signed double, kind string")
    got = {r["s"]: r["b"] for r in assign.assign_nearest(pairs, "s", "b", kind="kind", apart=[("boys", "girls")]).collect()}
    assert got == {"s1": "A", "s2": "C", "s3": "D"}


def test_circles_and_polygons_in_one_sample(spark):
    areas = spark.createDataFrame([("c", 0.0, 0.0, 100.0, None), ("p", 9.0, 9.0, None, "POLYGON ((200 0, 400 0, 400 200, 200 200, 200 0), (280 80, 320 80, 320 120, 280 120, 280 80))"), ("none", 0.0, 0.0, None, None)], "k string, cx double, cy double, r double, wkt string")
    pts = spark.createDataFrame([(1, 50.0, 0.0), (2, 250.0, 50.0), (3, 300.0, 100.0), (4, 150.0, 100.0), (5, 500.0, 300.0), (6, None, 0.0), (7, float("nan"), 0.0), (8, 9000.0, 0.0)], "id int, x double, y double")
    got = {(r["id"], r["k"]): r["d_signed"] for r in assign.region_pairs(pts, "x", "y", areas, key="k", cx="cx", cy="cy", radius="r", wkt="wkt", reach=150.0).collect()}
    want = {(1, "c"): 50.0, (2, "p"): math.hypot(30, 30), (3, "p"): -20.0, (4, "p"): -50.0, (4, "c"): 100 - math.hypot(150, 100), (5, "p"): -math.hypot(100, 100), (2, "c"): None}
    want.pop((2, "c"))
    assert got.keys() == {*want, *({(1, "p")} if (1, "p") in got else set())} and all(got[k] == pytest.approx(v) for k, v in want.items())


def test_circle_distance_and_nearest(spark):
    df = spark.createDataFrame([(530000.0, 180000.0), (531000.0, 180000.0), (None, 1.0)], "e double, n double")
    d = [r[0] for r in df.select(assign.circle_distance(F.col("e"), F.col("n"), F.lit(530000.0), F.lit(180000.0), F.lit(800.0))).collect()]
    assert d == [800.0, -200.0, None]
    rng = np.random.default_rng(2)
    pts = [(float(a), float(b)) for a, b in rng.uniform(-9000, 9000, (60, 2))]
    ts = [(f"t{i}", float(a), float(b)) for i, (a, b) in enumerate(rng.uniform(-200, 9000, (9, 2)))]
    rows = assign.nearest(spark.createDataFrame(pts + [(float("nan"), 0.0)], "x double, y double"), "x", "y", spark.createDataFrame(ts, "t string, tx double, ty double"), target="t", tx="tx", ty="ty", k=2, cell=500.0).collect()
    got = {(r["x"], r["y"], r["rank"]): r["target"] for r in rows}
    for x, y in pts:
        order = sorted(ts, key=lambda t: (math.hypot(x - t[1], y - t[2]), t[0]))
        assert [got[(x, y, 1)], got[(x, y, 2)]] == [order[0][0], order[1][0]]


def test_nearest_outside_the_line_and_built_areas(spark):
    b = spark.createDataFrame([("a", 0.0, 0.0), ("b", 1.0, 0.0), ("c", 2.0, 0.0), ("d", 9.0, 0.0)], "k string, x double, y double")
    lines = spark.createDataFrame([("a", "a"), ("a", "b"), ("b", "b"), ("c", "c"), ("d", "d")], "node string, ancestor string")
    got = {(r["k"], r["rank"]): r["target"] for r in assign.nearest_outside(b, b, lines, key="k", x="x", y="y", k=2, cell=1.0).collect()}
    assert got == {("a", 1): "c", ("a", 2): "d", ("b", 1): "a", ("b", 2): "c", ("c", 1): "b", ("c", 2): "a", ("d", 1): "c", ("d", 2): "b"}
    rows = spark.createDataFrame([("a", 2020, 5.0, "r"), ("a", 2020, 6.0, "r"), ("a", 2021, 8.0, "r"), ("b", 2020, None, "r")], "k string, y int, m double, route string")
    kw = dict(key="k", year="y", radius="m", route="route")
    got = {r["k"]: r for r in assign.build_areas(rows, b, **{**kw}).collect()}
    assert (got["a"]["radius"], got["a"]["n_years"], got["a"]["radius_by_year"], got["a"]["x"]) == (7.0, 2, {2020: 6.0, 2021: 8.0}, 0.0) and got["a"]["cv"] == pytest.approx(math.sqrt(2) / 7)
    assert got["b"]["radius"] is None and got["b"]["radius_by_year"] == {2020: None}
    for bad in (("a", 2022, 1.0, "other"), ("zz", 2022, 1.0, "r")):
        with pytest.raises(ValueError):
            assign.build_areas(rows.unionByName(spark.createDataFrame([bad], rows.schema)), b, **kw)


def test_events(spark):
    S = "urn string, pub date, grade int, num string, start date, role string, source string, event_id long"
    import datetime as dt

    d = dt.date
    rows = [
        ("u", d(2020, 4, 20), 3, "N1", d(2020, 3, 1), "current", "s", 1), ("u", d(2020, 4, 25), 3, "N1", d(2020, 3, 1), "previous", "s", 2), ("u", d(2022, 5, 17), 4, "N2", d(2022, 4, 1), "current", "s", 3),
        ("u", d(2022, 5, 17), 2, None, d(2022, 4, 9), "current", "s", 4), ("v", d(2021, 1, 1), 1, " ", d(2020, 1, 1), "current", "s", 5), ("v", d(2021, 1, 1), 2, "", d(2020, 1, 1), "current", "s", 6), (None, d(2021, 1, 1), 2, "", None, "current", "s", 7),
    ]
    e = changes.dedupe_events(spark.createDataFrame(rows, S), key="urn", at="pub", number="num", start="start", grade="grade", role_rank=(F.col("role") != "current").cast("int"), tie=["source", "event_id"])
    assert sorted((r["urn"], r["event_id"], r["conflict"]) for r in e.collect()) == [("u", 1, False), ("u", 4, False), ("v", 6, True)]
    c = changes.change_points(spark.createDataFrame([("a", 1, 2), ("a", 2, 2), ("a", 3, None), ("a", 4, 1)], "k string, t int, v int"), "k", ["t"], "v")
    assert sorted(r["t"] for r in c.collect()) == [1, 3, 4]
    u = changes.project_events(spark.createDataFrame([("x", 1)], "URN string, g int"), [{"key": "urn", "v": "g"}, {"key": "no"}])
    assert u.columns == ["key", "v"] and changes.project_events(u, [{"a": "zz"}]) is None


def test_grade_over_a_lineage(spark):
    import datetime as dt

    d = dt.date
    ev = spark.createDataFrame([("100", d(2008, 5, 1), 2), ("100", d(2013, 2, 1), 1), ("200", d(2018, 6, 1), 2), ("100", d(2018, 6, 1), 4)], "urn string, on date, grade int")
    lines = spark.createDataFrame([("200", "200", 0), ("200", "100", 1), ("100", "100", 0)], "node string, ancestor string, steps int")
    q = spark.createDataFrame([("200", d(2016, 1, 1)), ("200", d(2020, 1, 1)), ("100", d(2008, 4, 30)), ("300", d(2020, 1, 1)), (None, d(2020, 1, 1))], "urn string, day date")
    got = {(r["urn"], r["day"]): r["in_force"] for r in changes.in_force(q, "urn", "day", ev, lines, event_key="urn", event_at=F.col("on"), value="grade").collect()}
    assert list(got.values()).count(None) == 3 and tuple(got[("200", d(2016, 1, 1))]) == (1, d(2013, 2, 1), "100") and tuple(got[("200", d(2020, 1, 1))]) == (2, d(2018, 6, 1), "200")
    h = changes.line_history(ev, lines, event_key="urn", at=["on"], value="grade").where("node = '200'").collect()
    assert [(r["on"], r["urn"], r["grade"]) for r in sorted(h, key=lambda r: (r["on"], r["steps"]))] == [(d(2008, 5, 1), "100", 2), (d(2013, 2, 1), "100", 1), (d(2018, 6, 1), "200", 2), (d(2018, 6, 1), "100", 4)]
    starts = spark.createDataFrame([("200", d(2010, 1, 1)), ("300", d(2001, 1, 1))], "urn string, opened date")
    more = lines.unionByName(spark.createDataFrame([("300", "300", 0)], lines.schema))
    assert {r["node"]: (r["known"], r["first"]) for r in changes.line_start(more, starts, "urn", "opened").collect()} == {"200": (False, None), "100": (False, None), "300": (True, d(2001, 1, 1))}
    o = spark.createDataFrame([(1, None, None), (2, d(2020, 1, 1), None), (3, d(2020, 1, 2), None), (4, None, d(2020, 1, 1)), (5, None, d(2020, 1, 2))], "id int, a date, z date")
    assert {r["id"] for r in o.where(changes.open_on(F.lit(d(2020, 1, 1)), F.col("a"), F.col("z"))).collect()} == {1, 2, 5}


def test_quality(spark, tmp_path):
    df = spark.createDataFrame([("a", 1), ("a", None), ("b", 3), (None, 0)], "k string, v int")
    log = quality.step_log(df, [("has k", F.col("k").isNotNull()), ("v over 0", F.col("v") > 0)]).collect()
    assert [(r["rows_before"], r["rows_after"], r["dropped"]) for r in log] == [(4, 3, 1), (3, 2, 1)]
    assert [tuple(r) for r in quality.duplicate_keys(df, ["k"]).collect()] == [("a", 2)]
    with pytest.raises(ValueError):
        quality.assert_unique(df, ["k"])
    f = quality.failures(df, [("k", F.col("k").isNotNull()), ("v", F.col("v") > 2)]).collect()
    assert [(r["first_fail"], r["all_fails"]) for r in f] == [("v", "v"), ("v", "v"), (None, ""), ("k", "k;v")]
    digest = lambda d: quality.content_digest(d).collect()[0]["digest"]
    assert digest(df) == digest(df.repartition(3)) != digest(df.na.fill(9))
    governance.write_checked(df, str(tmp_path / "t"))
    assert governance.read_checked(spark, str(tmp_path / "t")).count() == 4
    (tmp_path / "src").write_bytes(b"a\nb\n")
    src = tmp_path / "src"
    seal = governance.Seal(str(tmp_path / "seal"), str(src))
    with pytest.raises(PermissionError):
        seal.facts()
    seal.close(selected=["x"])
    src.write_bytes(b"a\r\nb\r\n")
    assert seal.facts()["selected"] == ["x"] and governance.text_fingerprint(str(src), 2) == governance.text_fingerprint(str(src))
    src.write_bytes(b"a\nc\n")
    with pytest.raises(PermissionError):
        seal.facts()
    one = spark.createDataFrame([("a", 1), ("b", 2)], "k string, w int")
    assert quality.join_one_to_one(one, one.withColumnRenamed("w", "z").limit(1), ["k"]).count() == 2
    with pytest.raises(ValueError):
        quality.join_one_to_one(df, one, ["k"])
    with pytest.raises(ValueError):
        quality.assert_no_orphans(one, one.limit(1), ["k"])
    assert quality.assert_no_orphans(one, one, ["k"]) is one
    assert sorted(tuple(r) for r in quality.audit(df, [F.col("k")], {"big": F.col("v") > 0}).where("k is not null").collect()) == [("a", 2, 1), ("b", 1, 1)]


def test_postcode_forms(spark):
    df = spark.createDataFrame([("sw1a  1aa",), ("N19GU",), ("AB1",), (None,), ("",)], "x string")
    assert [r[0] for r in df.select(spaced_postcode(F.col("x"))).collect()] == ["SW1A 1AA", "N1 9GU", None, None, None]
