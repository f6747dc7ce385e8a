import numpy as np
import pytest
from pyspark.sql import functions as F

from terrane.llm import quantiles as Q


@pytest.mark.parametrize("n, k", [(0, 8), (1, 8), (7, 8), (8, 8), (1000, 16), (20000, 64)])
def test_rank_error_bound(n, k):
    rng = np.random.default_rng(n)
    values = rng.permutation(np.r_[rng.normal(size=n - n // 4), np.zeros(n // 4)])
    parts = np.array_split(values, 5)
    total = Q.Buffers(k)
    for p in parts:  # summaries of separate parts merge
        b = Q.Buffers(k)
        b.add(p)
        for w, v, e in b.rows():
            total.put(w, v, e)
    probs = [0.0, 0.1, 0.5, 0.9, 1.0]
    q = total.quantiles(probs)
    assert q["n"] == n
    s = np.sort(values)
    for p, v, lo, hi in zip(probs, q["value"], q["low"], q["high"]):
        rank = max(1, int(np.ceil(p * n)))
        assert np.searchsorted(s, v, "left") + 1 - q["err"] <= rank <= np.searchsorted(s, v, "right") + q["err"]
        assert lo <= s[rank - 1] <= hi
    if n > 4 * k:
        assert q["err"] <= n * (np.log2(n / k) + 4) / k


def test_groups_and_exact_median(spark):
    rng = np.random.default_rng(3)
    rows = [(f"g{i % 3}" if i % 3 else None, float(v) if i % 50 else None) for i, v in enumerate(rng.integers(0, 500, 6000))] + [("odd", 5.0), ("odd", 7.0), ("odd", 6.0), ("two", 1.0), ("two", 2.0), ("empty", None), ("nan", float("nan"))]
    df = spark.createDataFrame(rows, "g string, v double").repartition(6)
    s = Q.merge(Q.summarise(df, ["g"], F.col("v"), k=32), ["g"], k=32, fan_in=3)
    q = Q.quantiles(s, ["g"], [0.5, 0.500001], k=32)
    by = {}
    for g, v in rows:
        if v is not None and v == v:
            by.setdefault(g, []).append(v)
    assert {r["g"]: r["n"] for r in q.collect()} == {g: len(v) for g, v in by.items()}
    bracket = q.select("g", F.array_min("low").alias("low"), F.array_max("high").alias("high"))
    got = {r["g"]: r["median"] for r in Q.exact_median(df.where("not isnan(v)"), "g", "v", bracket).collect()}
    assert got == {g: float(np.median(v)) for g, v in by.items() if g is not None}


def test_empty(spark):
    df = spark.createDataFrame([], "g string, v double, values int, weight int")
    s = Q.summarise(df, ["g"], F.col("v"))
    assert Q.quantiles(Q.merge(s, ["g"]), ["g"], [0.5]).count() == 0
