import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from terrane.operators.asof import as_of, history
from terrane.session import Spread

D = dt.date


def _day(i):
    return D(2020, 1, 1) + dt.timedelta(days=i)


@pytest.mark.parametrize("broadcast_rows, rows_per_task", [(100, 1000), (0, 40), (45, 1000)])
def test_against_brute_force(spark, broadcast_rows, rows_per_task):
    rnd = random.Random(4)
    events = [(i, "hot" if i % 3 == 0 else rnd.choice(["a", "b", "c"]), _day(rnd.randrange(100))) for i in range(300)]
    changes = {n: [(rnd.choice(["hot", "a", "b"]), _day(rnd.randrange(100)), rnd.randrange(50)) for _ in range(60)] for n in ("p", "q")}
    ev = spark.createDataFrame(events, "id long, k string, t date")
    hs = {n: history(spark.createDataFrame(c, "k string, t date, v int"), n, F.col("k"), F.col("t"), F.col("v")) for n, c in changes.items()}
    rows = {r["id"]: r for r in as_of(ev, "k", "t", hs, rows_per_task, broadcast_rows).collect()}
    assert len(rows) == 300
    for i, k, t in events:
        for n, c in changes.items():
            known = [(u, v) for kk, u, v in c if kk == k and u <= t]
            assert rows[i][n] == (max(known)[1] if known else None)


def test_nulls_ties_repeats_and_clashes(spark):
    ev = spark.createDataFrame([(1, "a", D(2020, 1, 2), 7), (1, "a", D(2020, 1, 2), 7), (2, None, D(2020, 1, 2), 7), (3, "a", None, 7), (4, "a", D(2020, 1, 1), 7)], "id long, key string, at date, value int")
    h = history(spark.createDataFrame([("a", D(2020, 1, 2), 5, 1), ("a", D(2020, 1, 2), 6, None), ("a", D(2020, 1, 2), 9, 0), ("a", D(2020, 1, 1), None, 3), (None, D(2020, 1, 1), 1, 1), ("a", None, 1, 1)], "k string, t date, v int, o int"), "x", F.col("k"), F.col("t"), F.col("v"), [F.col("o")])
    rows = sorted((r["id"], r["value"], r["x"] if r["x"] is not None else -1) for r in as_of(ev, "key", "at", {"x": h}).collect())
    assert rows == [(1, 7, 5), (1, 7, 5), (2, 7, -1), (3, 7, -1), (4, 7, -1)]
    with pytest.raises(ValueError):
        as_of(ev, "key", "at", {"value": h})
    again = as_of(ev, "key", "at", {"x": h}, 1, 0).collect()
    assert sorted((r["id"], r["value"], r["x"] if r["x"] is not None else -1) for r in again) == rows
    assert as_of(ev.limit(0), "key", "at", {"x": h}).count() == 0
    assert as_of(ev, "key", "at", {"x": h.limit(0)}).where("x is null").count() == 5


def test_heavy_key_is_spread(spark):
    """A key with a hundred times the target is matched in as many parts, and none holds much more than the target."""
    ev = spark.range(4000).selectExpr("id", "'hot' as k", "date_add(date'2020-01-01', cast(id % 50 as int)) as t")
    parts = Spread(ev, F.col("k"), 40)
    sizes = parts.salted(ev, F.col("k"), F.struct("id", "k", "t")).groupBy("_salt").count().collect()
    assert len(sizes) == 100 and max(r["count"] for r in sizes) < 80
    h = history(spark.createDataFrame([("hot", _day(10), 1), ("hot", _day(30), 2)], "k string, t date, v int"), "x", F.col("k"), F.col("t"), F.col("v"))
    got = as_of(ev, "k", "t", {"x": h}, 40, 0).groupBy("x").count().collect()
    assert {r["x"]: r["count"] for r in got} == {None: 800, 1: 1600, 2: 1600}
