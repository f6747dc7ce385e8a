"""p4_percentiles against plain sorting of the smallest tables."""

import math
from collections import defaultdict

import duckdb

import __spark_entry__ as E

FOLDER = "/root/testdata/sf0.001"


def test_groups_and_distinct_sales(spark):
    con = duckdb.connect()
    sales = con.sql(f"SELECT txn_id, price, district, year_quarter, easting, northing FROM '{FOLDER}/sales.parquet' WHERE price IS NOT NULL").fetchall()
    centres = con.sql(f"SELECT urn, easting, northing, radius_m FROM '{FOLDER}/boundary.parquet' WHERE radius_m IS NOT NULL").fetchall()
    want = defaultdict(dict)
    for txn, price, district, quarter, e, n in sales:
        groups = [("district", district), ("quarter", quarter)]
        if e is not None and n is not None:
            groups += [("boundary", u) for u, x, y, r in centres if r <= math.sqrt((e - x) ** 2 + (n - y) ** 2) < r + 400]
        for g in groups:
            want[g][txn] = min(price, want[g].get(txn, price))
    got = {(r["kind"], r["name"]): r for r in E.queries()["p4_percentiles"](spark, FOLDER).collect()}
    assert {k for k, _ in got} == {"boundary", "district", "quarter"} and set(got) == set(want)
    for g, r in got.items():
        prices = sorted(want[g].values())
        assert r["n"] == len(prices)
        for p in (10, 25, 50, 75, 90):
            rank = max(1, math.ceil(p * len(prices) / 100))
            assert prices[max(0, rank - 1 - r["err"])] <= r[f"p{p}"] <= prices[min(len(prices), rank + r["err"]) - 1]
