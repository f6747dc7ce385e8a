"""Percentiles of very large numeric columns by deterministic collapsing of equal-size weighted buffers.

A summary is a set of buffers: sorted arrays of ``k`` values, each value standing for ``weight`` input values, and at
most one tail of fewer than ``k`` values of weight 1. Two buffers of equal weight w collapse into one of weight 2w by
taking every second position of their merged order (the odd and the even positions in turn), so that a collapse
moves no rank by more than w. Each buffer carries the sum of these moves, ``err``: the true rank of any value that a
summary returns is within the sum of ``err`` (plus the largest weight) of the rank asked for. Buffers collapse in a
binary tree by weight, so the bound is about n * log2(n / k) / (2 k). Summaries of any partitions or days merge.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terrane.session import broadcast_if_small

K = 1024
#: Values that one task holds before it emits its summaries and starts anew.
HELD = 4_000_000


class Buffers:
    """The buffers of one group: ``levels[w]`` holds (sorted values, err) of weight w."""

    def __init__(self, k: int = K):
        self.k, self.levels, self.tail, self.held, self.turn = k, defaultdict(list), [], 0, 0

    def add(self, values: np.ndarray) -> None:
        self.tail.append(values)
        self.held += len(values)
        if self.held >= self.k:
            flat = np.concatenate(self.tail)
            whole = len(flat) // self.k * self.k
            for part in flat[:whole].reshape(-1, self.k):
                self.put(1, np.sort(part), 0)
            self.tail, self.held = [flat[whole:]], len(flat) - whole

    def put(self, weight: int, values: np.ndarray, err: int) -> None:
        if len(values) < self.k:
            self.add(values)
            return
        self.levels[weight].append((values, err))
        while len(self.levels[weight]) == 2:
            (a, ea), (b, eb) = self.levels.pop(weight)
            merged = np.sort(np.concatenate([a, b]), kind="stable")
            self.turn ^= 1
            values, err, weight = merged[self.turn :: 2], ea + eb + weight, weight * 2
            self.levels[weight].append((values, err))

    def rows(self):
        """(weight, values, err) of every buffer, the tail last."""
        for w, bs in sorted(self.levels.items()):
            for v, e in bs:
                yield w, v, e
        if self.held:
            yield 1, np.sort(np.concatenate(self.tail)), 0

    def size(self) -> int:
        return self.held + self.k * sum(map(len, self.levels.values()))

    def quantiles(self, probs: list[float]) -> dict:
        """n, err and, for each p, the values at rank max(1, ceil(p n)), at that rank less err and plus err."""
        rows = list(self.rows())
        n = sum(w * len(v) for w, v, _ in rows)
        if not n:
            return {"n": 0, "err": 0, "value": [], "low": [], "high": []}
        values = np.concatenate([v for _, v, _ in rows])
        weights = np.concatenate([np.full(len(v), w) for w, v, _ in rows])
        order = np.argsort(values, kind="stable")
        values, upto = values[order], np.cumsum(weights[order])
        err = int(sum(e for _, _, e in rows) + (max(w for w, _, _ in rows) if any(w > 1 for w, _, _ in rows) else 0))
        at = lambda r: float(values[np.searchsorted(upto, min(max(r, 1), n))])
        ranks = [max(1, int(np.ceil(p * n - 1e-9))) for p in probs]
        ends = (-np.inf, np.inf)
        low = [ends[0] if r - err - 1 < 1 and err else at(r - err - 1) for r in ranks]
        high = [ends[1] if r + err + 2 > n and err else at(r + err + 2) for r in ranks]
        return {"n": n, "err": err, "value": [at(r) for r in ranks], "low": low, "high": high}


def summarise(df: DataFrame, keys: list[str], value: Column, k: int = K) -> DataFrame:
    """Summaries per task: rows (keys, weight, values, err). NULL and NaN values are left out; a NULL key is a group.

    A task keeps the buffers of all groups that it meets; beyond ``HELD`` values it emits them and starts anew.
    """
    schema = T.StructType([*(df.schema[c] for c in keys), T.StructField("weight", T.LongType()), T.StructField("values", T.ArrayType(T.DoubleType())), T.StructField("err", T.LongType())])
    v = value.cast("double")
    rows = df.select(*keys, v.alias("_v")).where(F.col("_v").isNotNull() & ~F.isnan("_v"))

    def run(batches):
        import pandas as pd

        groups: dict = {}

        def emit():
            out = [(*g, w, v, e) for g, b in groups.items() for w, v, e in b.rows()]
            groups.clear()
            return pd.DataFrame(out, columns=[*keys, "weight", "values", "err"])

        for pdf in batches:
            if len(pdf):
                for g, at in pdf.groupby(keys, dropna=False, sort=False).indices.items() if keys else [((), np.arange(len(pdf)))]:
                    g = g if isinstance(g, tuple) else (g,)
                    g = tuple(None if x is None or x != x else x for x in g)
                    groups.setdefault(g, Buffers(k)).add(pdf["_v"].to_numpy()[at])
                if sum(b.size() for b in groups.values()) > HELD:
                    yield emit()
        if groups:
            yield emit()

    return rows.mapInPandas(run, schema)


def merge(summaries: DataFrame, keys: list[str], k: int = K, fan_in: int = 64) -> DataFrame:
    """One summary per group from many, in two steps: first within ``fan_in`` sets of tasks, then over these, so that
    no task gathers more than a share of a hot group's buffers."""
    schema = summaries.schema

    def collapse(key, pdf):
        import pandas as pd

        b = Buffers(k)
        for w, v, e in sorted(zip(pdf["weight"], pdf["values"], pdf["err"]), key=lambda r: (r[0], len(r[1]), tuple(r[1][:1]), r[2])):
            b.put(int(w), np.asarray(v, dtype=float), int(e))
        out = [(*pdf.iloc[0][keys], w, v, e) for w, v, e in b.rows()]
        return pd.DataFrame(out, columns=[*keys, "weight", "values", "err"])

    first = summaries.withColumn("_s", F.pmod(F.xxhash64("values", "weight"), F.lit(fan_in)))
    return first.groupBy(*keys, "_s").applyInPandas(collapse, schema).groupBy(*keys).applyInPandas(collapse, schema)


def quantiles(summaries: DataFrame, keys: list[str], probs: list[float], k: int = K) -> DataFrame:
    """Per group ``n``, ``err`` (bound on the rank error) and arrays ``value``, ``low`` and ``high`` in the order of
    ``probs``; the exact percentile lies within [low, high]. No rows for an empty input."""
    kinds = {"n": T.LongType(), "err": T.LongType(), "value": T.ArrayType(T.DoubleType()), "low": T.ArrayType(T.DoubleType()), "high": T.ArrayType(T.DoubleType())}
    schema = T.StructType([*(summaries.schema[c] for c in keys), *(T.StructField(n, t) for n, t in kinds.items())])

    def answer(key, pdf):
        import pandas as pd

        b = Buffers(k)
        for w, v, e in zip(pdf["weight"], pdf["values"], pdf["err"]):
            b.put(int(w), np.asarray(v, dtype=float), int(e))
        q = b.quantiles(probs)
        return pd.DataFrame([(*pdf.iloc[0][keys], *(q[n] for n in kinds))], columns=[*keys, *kinds])

    return summaries.groupBy(*keys).applyInPandas(answer, schema)


def exact_median(df: DataFrame, key: str, value: str, bracket: DataFrame) -> DataFrame:
    """(key, n, median) with the mean of the middle two, from a bracket (key, low, high) that a summary gave.

    One further pass: values outside the bracket are only counted; those within are counted per value, so ties cost
    nothing, and the number of distinct values there is bounded by the summary's rank error.
    """
    rows = df.where(F.col(key).isNotNull() & F.col(value).isNotNull()).select(key, F.col(value).cast("double").alias("_v"))
    # a value outside stands for its side of the bracket
    b = bracket.select(key, F.col("low").alias("_low"), F.col("high").alias("_high"))
    # one bracket per group; counted before it is broadcast, as groups may be many
    j = rows.join(broadcast_if_small(b), key).withColumn("_p", F.when(F.col("_v") < F.col("_low"), F.lit(float("-inf"))).when(F.col("_v") > F.col("_high"), F.lit(float("inf"))).otherwise(F.col("_v")))
    counts = j.groupBy(key, "_p").agg(F.count("*").alias("c"))
    w = Window.partitionBy(key).orderBy("_p")
    total = counts.groupBy(key).agg(F.sum("c").alias("n"))
    upto = counts.withColumn("upto", F.sum("c").over(w)).join(total, key)
    lo, hi = F.floor((F.col("n") + 1) / 2), F.floor(F.col("n") / 2) + 1
    holds = lambda r: (F.col("upto") >= r) & (F.col("upto") - F.col("c") < r)
    return upto.groupBy(key).agg(F.max("n").alias("n"), ((F.max(F.when(holds(lo), F.col("_p"))) + F.max(F.when(holds(hi), F.col("_p")))) / 2).alias("median"))
