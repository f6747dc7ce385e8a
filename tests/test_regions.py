import math
import random

from pyspark.sql import functions as F

from terrane.operators.assign import polygon_pairs
from terrane.operators.regions import box_edges, cells, circle_edges, points_in_regions, polygon_edges

P = "id long, x double, y double, region string"


def _circles(spark, rows):
    return circle_edges(spark.createDataFrame(rows, "k string, cx double, cy double, r double, x double"), "k", "cx", "cy", F.col("r"))


def _inside(spark, pts, edges, **kw):
    df = spark.createDataFrame(pts, P).drop("region")
    return points_in_regions(df, F.col("x"), F.col("y"), edges, **kw)


def test_circles_against_distance(spark):
    rnd = random.Random(1)
    circles = [(f"c{i}", rnd.uniform(-3000, 3000), rnd.uniform(-3000, 3000), rnd.uniform(1, 1500), 0.0) for i in range(25)] + [("none", 0.0, 0.0, None, 0.0), ("zero", 0.0, 0.0, 0.0, 0.0), ("nan", 0.0, 0.0, float("nan"), 0.0)]
    pts = [(i, rnd.uniform(-5000, 5000), rnd.uniform(-5000, 5000), "") for i in range(800)]
    want = {(p[0], c[0]) for p in pts for c in circles if c[3] and c[3] == c[3] and math.hypot(p[1] - c[1], p[2] - c[2]) < c[3]}
    for limit in (10**6, 0):  # broadcast and shuffled
        got = {(r["id"], r["region"]) for r in _inside(spark, pts, _circles(spark, circles), broadcast_edges=limit).where("not on_boundary").collect()}
        assert got == want


def test_boundary_and_bad_points(spark):
    pts = [(1, 100.0, 0.0, ""), (2, 0.0, 100.0, ""), (3, 0.0, 0.0, ""), (4, None, 0.0, ""), (5, float("nan"), 0.0, ""), (6, 60.0, 80.0, ""), (7, float("inf"), 0.0, ""), (3, 0.0, 0.0, "")]
    rows = _inside(spark, pts, _circles(spark, [("c", 0.0, 0.0, 100.0, 1.0)])).collect()
    assert sorted((r["id"], r["on_boundary"]) for r in rows) == [(1, True), (2, True), (3, False), (3, False), (6, True)]


def test_polygons_with_holes_and_vertices(spark):
    wkt = "POLYGON ((0 0, 1000 0, 1000 1000, 0 1000, 0 0), (250 250, 750 250, 750 750, 250 750, 250 250))"
    polys = spark.createDataFrame([("a", wkt), ("b", None), ("c", "POLYGON EMPTY"), ("d", "POLYGON ((0 0, 500 1000, 1000 0, 0 0))")], "k string, w string")
    edges = polygon_edges(polys, "k", "w")
    pts = [(1, 100.0, 100.0, ""), (2, 500.0, 500.0, ""), (3, 0.0, 500.0, ""), (4, 1000.0, 1000.0, ""), (5, -1.0, 500.0, ""), (6, 900.0, 500.0, "")]
    rows = {(r["id"], r["region"]): r["on_boundary"] for r in _inside(spark, pts, edges, strip=300.0).collect()}
    assert rows == {(1, "a"): False, (1, "d"): False, (2, "d"): False, (3, "a"): True, (4, "a"): True, (6, "a"): False}


def test_clashing_columns(spark):
    df = spark.createDataFrame([(1, 0.0, 0.0, "old", 5, 1.0)], "id int, _x double, y double, region string, _edges int, west double")
    r = points_in_regions(df, F.col("_x"), F.col("y"), _circles(spark, [("c", 0.0, 0.0, 9.0, 1.0)])).collect()
    assert [(x["id"], x["region"], x["_edges"], x["west"]) for x in r] == [(1, "c", 5, 1.0)]


def test_empty(spark):
    assert _inside(spark, [], _circles(spark, [("c", 0.0, 0.0, 1.0, 1.0)])).count() == 0
    assert _inside(spark, [(1, 0.0, 0.0, "")], _circles(spark, [])).count() == 0


def test_polygon_distance_near_a_circle(spark):
    ring = ", ".join(f"{900 * math.cos(2 * math.pi * i / 1024)} {900 * math.sin(2 * math.pi * i / 1024)}" for i in [*range(1024), 0])
    rnd = random.Random(2)
    pts = [(i, rnd.uniform(-1500, 1500), rnd.uniform(-1500, 1500)) for i in range(200)]
    df = spark.createDataFrame(pts, "id long, x double, y double")
    rows = polygon_pairs(df, "x", "y", spark.createDataFrame([("k", f"POLYGON (({ring}))")], "k string, w string"), key="k", wkt="w", reach=700.0).collect()
    want = {i: 900 - math.hypot(x, y) for i, x, y in pts if abs(900 - math.hypot(x, y)) < 699}
    got = {r["id"]: r["d_signed"] for r in rows}
    assert set(want) <= set(got) and all(abs(got[i] - d) < 0.1 for i, d in want.items())


def test_large_and_small_regions_together(spark):
    """Columns of a large region are wide, so that its edges are copied a bounded number of times; results stay exact."""
    circles = [("large", 0.0, 0.0, 60_000.0, 1.0), ("small", 1000.0, 1000.0, 700.0, 1.0), ("middle", -5000.0, 0.0, 9000.0, 1.0)]
    edges = _circles(spark, circles)
    per = {r["region"]: r["n"] for r in cells(edges, 500.0).groupBy("region").agg(F.countDistinct("column").alias("n")).collect()}
    assert max(per.values()) <= 18 and per["small"] <= 4
    rnd = random.Random(3)
    pts = [(i, rnd.uniform(-70_000, 70_000), rnd.uniform(-70_000, 70_000), "") for i in range(400)] + [(1000 + i, rnd.uniform(-20_000, 20_000), rnd.uniform(-20_000, 20_000), "") for i in range(400)] + [(2000 + i, rnd.uniform(0, 2000), rnd.uniform(0, 2000), "") for i in range(100)]
    want = {(p[0], c[0]) for p in pts for c in circles if math.hypot(p[1] - c[1], p[2] - c[2]) < c[3]}
    for limit in (10**6, 0):
        assert {(r["id"], r["region"]) for r in _inside(spark, pts, edges, broadcast_edges=limit).collect()} == want


def test_boxes_keep_their_edges(spark):
    boxes = spark.createDataFrame([("a", 0, 0, 10, 5), ("b", 3, 3, 3, 9), ("c", None, 0, 1, 1)], "k string, w int, s int, e int, n int")
    pts = [(1, 0.0, 0.0, ""), (2, 10.0, 5.0, ""), (3, 10.0, 2.0, ""), (4, 4.0, 5.0, ""), (5, 10.5, 2.0, ""), (6, 5.0, 2.0, ""), (7, 5.0, 5.5, "")]
    assert {(r["id"], r["region"]) for r in _inside(spark, pts, box_edges(boxes, "k", "w", "s", "e", "n")).collect()} == {(i, "a") for i in (1, 2, 3, 4, 6)}
