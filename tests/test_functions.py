import json
import zipfile

import pytest
from pyspark.sql import functions as F

from terrane.functions import display, geo
from terrane.operators.regions import points_in_regions, polygon_edges
from terrane.sources import archives, sinks


def _one(spark, *cols):
    return spark.range(1).select(*(c.alias(f"c{i}") for i, c in enumerate(cols))).collect()[0]


def test_display(spark):
    r = _one(spark, display.percent(F.lit(0.0182098)), display.amount(F.lit(0.0182098), F.lit(480000)), display.signed(F.lit(1.84)), display.signed(F.lit(-3.0)), display.p_text(F.lit(0.0004)), display.p_text(F.lit(0.0044)), display.p_text(F.lit(0.4697)), display.p_text(F.lit(None).cast("double")))
    assert r[0] == pytest.approx(1.8376606, abs=1e-6) and r[1] == pytest.approx(8820.77, abs=0.05)
    assert list(r[2:]) == ["+1.8 %", "-3.0 %", "<0.001", "0.004", "0.47", None]


def test_grid(spark):
    df = spark.createDataFrame([(530000.0, 180000.0)], "e double, n double")
    assert geo.require_grid(df, "e", "n", "EPSG:27700") is df
    with pytest.raises(ValueError):
        geo.require_grid(df, "e", "n", "EPSG:4326")
    with pytest.raises(ValueError):
        geo.require_grid(spark.createDataFrame([(-0.1, 51.5)], "e double, n double"), "e", "n")
    d = df.select(geo.to_degrees(F.col("e"), F.col("n")).alias("d"), geo.to_degrees(F.lit(None).cast("double"), F.col("n")).alias("x")).collect()[0]
    assert d["d"]["lat"] == pytest.approx(51.5040, abs=2e-3) and d["d"]["lon"] == pytest.approx(-0.1284, abs=2e-3) and d["x"] is None
    w = df.select(F.lit("k").alias("k"), geo.circle_wkt(F.col("e"), F.col("n"), F.lit(900.0)).alias("w"))
    p = spark.createDataFrame([(1, 530000.0, 180899.0), (2, 530000.0, 180901.0)], "id int, x double, y double")
    assert [r["id"] for r in points_in_regions(p, F.col("x"), F.col("y"), polygon_edges(w, "k", "w")).collect()] == [1]


def test_archives(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("Data/X_MAY_2025.csv", "a,b")
        z.writestr("Doc/readme.txt", "no")
    r = archives.zip_members(spark, str(tmp_path / "a.zip"), r"Data/X_[A-Z]{3}_\d{4}\.csv$").collect()
    assert [(x["archive"], x["member"], bytes(x["content"])) for x in r] == [("a.zip", "Data/X_MAY_2025.csv", b"a,b")]
    page = "<form><input name=\"a\" value='1'><INPUT value=\"x\" name='b' /><input name=\"a\" value=\"2\"><input type=submit></form>"
    assert _one(spark, archives.html_inputs(F.lit(page)))[0] == {"a": "1", "b": "x"}
    (tmp_path / "src.csv").write_text("data")
    m = str(tmp_path / "manifest.json")
    a = archives.fetch((tmp_path / "src.csv").as_uri(), str(tmp_path / "d.csv"), m)
    (tmp_path / "src.csv").unlink()
    assert archives.fetch("file:///none", str(tmp_path / "d.csv"), m) == a and a["bytes"] == 4
    with pytest.raises(FileNotFoundError):
        archives.yearly_files(str(tmp_path), 2015, 2016)


def test_geojson(spark, tmp_path):
    ring = [[0, 0], [10, 0], [10, 10], [0, 0]]
    g = {"type": "FeatureCollection", "features": [{"type": "Feature", "properties": {"urn": "u"}, "geometry": {"type": "Polygon", "coordinates": [ring]}}]}
    (tmp_path / "a.json").write_text(json.dumps(g))
    r = archives.geojson_polygons(spark, str(tmp_path / "a.json")).collect()[0]
    assert r["properties"]["urn"] == "u" and r["wkt"] == "POLYGON ((0 0, 10 0, 10 10, 0 0))"
    g["crs"] = {"properties": {"name": "EPSG:4326"}}
    (tmp_path / "b.json").write_text(json.dumps(g))
    with pytest.raises(ValueError):
        archives.geojson_polygons(spark, str(tmp_path / "b.json"))


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(3, 1), (1, 2)], "k int, price int")
    sinks.write_sorted(df, str(tmp_path / "s"), "k")
    assert spark.read.parquet(str(tmp_path / "s")).count() == 2
    sinks.write_blind(df, str(tmp_path / "b"), ["k"])
    assert spark.read.parquet(str(tmp_path / "b")).columns == ["k"]
    with pytest.raises(ValueError):
        sinks.write_blind(df, str(tmp_path / "c"), ["k", "price"])
    sinks.write_report(df, str(tmp_path / "r"))
    sinks.write_result(str(tmp_path / "x.json"), {"tau": 1.0}, sha256="0")
    assert json.loads((tmp_path / "x.json").read_text())["sha256"] == "0"


def test_money_and_counts(spark):
    from terrane.functions import display

    df = spark.createDataFrame([(8820.77,), (-16655.57,), (0.2,), (None,)], "x double")
    assert [tuple(r) for r in df.select(display.pounds(F.col("x"), True), display.thousands(F.round("x").cast("long"))).collect()] == [("+£8,821", "8,821"), ("-£16,656", "-16,656"), ("£0", "0"), (None, None)]
