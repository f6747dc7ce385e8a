import random

import pytest
from pyspark.sql import functions as F

from terrane.operators.changes import lineage
from terrane.operators.hierarchy import descendants, hierarchy, other_parents, single_parents


def _tree(spark, edges, **kw):
    df = spark.createDataFrame(edges, "a string, b string, depth int")
    return hierarchy(single_parents(df, F.col("a"), F.col("b")), **kw)


def _brute(edges):
    parent = {}
    for c, p, _ in edges:
        if c is not None and p is not None:
            parent[c] = min(p, parent.get(c, p))
    out = {}
    for n in set(parent) | set(parent.values()):
        path = [n]
        while path[-1] in parent and len(path) <= len(parent) + 1:
            path.append(parent[path[-1]])
        out[n] = path[::-1] if path[-1] not in parent else None
    return out


@pytest.mark.parametrize("local", [10_000, 60, 0])
def test_random_forests_with_rings(spark, local):
    rnd = random.Random(5)
    n = 120
    edges = [(f"n{i}", f"n{rnd.randrange(i)}", 0) for i in range(1, n) if rnd.random() < 0.9]
    edges += [(f"c{i}", f"c{i + 1}", 0) for i in range(40)]  # a chain
    edges += [(f"r{i}", f"r{(i + 1) % 7}", 0) for i in range(7)] + [("below", "r3", 0), ("deeper", "below", 0), ("self", "self", 0), ("s2", "self", 0), ("x", "y", 0), ("y", "x", 0)]
    edges += [(f"hub{i}", "hub", 0) for i in range(200)] + edges[:5] + [(None, "q", 0), ("q", None, 0), ("two", "n1", 0), ("two", "c1", 0)]
    t = _tree(spark, edges, rows_per_task=70, local_links=local)
    want = _brute(edges)
    rows = {r["node"]: r for r in t.collect()}
    assert set(rows) == set(want)
    for k, path in want.items():
        r = rows[k]
        assert r["path"] == path and r["ring"] == (path is None) and r["root"] == (path[0] if path else None) and r["depth"] == (len(path) - 1 if path else None)
    bare = {r["node"]: r for r in _tree(spark, edges, paths=False, local_links=local).collect()}
    assert all((bare[k]["root"], bare[k]["depth"], bare[k]["ring"], bare[k]["path"]) == (rows[k]["root"], rows[k]["depth"], rows[k]["ring"], None) for k in rows) and len(bare) == len(rows)
    d = descendants(t)
    assert {(r["ancestor"], r["descendant"], r["distance"]) for r in d.collect()} == {(a, p[-1], len(p) - 1 - i) for p in want.values() if p for i, a in enumerate(p[:-1])}
    assert lineage(t).where("node = 'c0' and ancestor = 'c40' and steps = 40").count() == 1


def test_empty(spark):
    assert _tree(spark, []).count() == 0
    assert descendants(_tree(spark, [])).count() == 0


def test_other_parents(spark):
    df = spark.createDataFrame([("a", "p"), ("a", "q"), ("a", "q"), ("b", "p"), ("c", None)], "a string, b string")
    assert [tuple(r) for r in other_parents(df, F.col("a"), F.col("b")).collect()] == [("a", "q", "p")]
