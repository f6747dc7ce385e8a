"""Bandwidths whose fit fails stay in rd_sweep."""

from pyspark.sql import functions as F

from terrane.plans import catalogue


def test_failed_bandwidths_are_rows(spark, monkeypatch):
    far = spark.createDataFrame([(i, 300.0 + i, 12.0, "a", "b", f"c{i % 3}") for i in range(9)], "txn_id int, d_signed double, log_price double, property_type string, year_quarter string, boundary_id string")
    both = far.unionByName(far.withColumn("d_signed", -F.col("d_signed")))
    monkeypatch.setattr(catalogue, "_kept", lambda *a: both)
    rows = catalogue.rd_sweep(spark, "").collect()
    assert [r["bandwidth_m"] for r in rows] == [float(h) for h in catalogue.GRID]
    assert all((r["tau"] is None and r["pct"] is None and r["note"].startswith("not run: ")) == (r["bandwidth_m"] <= 300) for r in rows)
