"""Predecessors against a breadth-first walk with a visited set, each predecessor once with the least steps."""

import random
from collections import defaultdict

from terrane.operators.changes import predecessors


def _walk(edges):
    parents = defaultdict(set)
    for c, p in edges:
        if c is not None and p is not None:
            parents[c].add(p)
    out = set()
    for node in set(parents) | {p for ps in parents.values() for p in ps}:
        seen, frontier = {node: 0}, [node]
        while frontier:
            up = []
            for u in frontier:
                for p in sorted(parents.get(u, ())):
                    if p not in seen:
                        seen[p] = seen[u] + 1
                        up.append(p)
            frontier = up
        out |= {(node, a, k) for a, k in seen.items()}
    return out


def test_rings_and_several_parents(spark):
    rnd = random.Random(3)
    edges = [(f"n{i}", f"n{rnd.randrange(i)}") for i in range(1, 60) for _ in range(1 + (i % 5 == 0))]  # some with two parents
    edges += [(f"c{i}", f"c{i + 1}") for i in range(37)] + [("c0", "c9")]  # a chain and a short cut
    edges += [(f"r{i}", f"r{(i + 1) % 7}") for i in range(7)] + [("r2", "above"), ("above", "top"), ("below", "r3"), ("self", "self"), ("s2", "self"), ("x", "y"), ("y", "x")]
    edges += edges[:9] + [(None, "q"), ("q", None)]
    got = [(r["node"], r["ancestor"], r["steps"]) for r in predecessors(spark.createDataFrame(edges, "child string, parent string")).collect()]
    assert len(got) == len(set(got)) and set(got) == _walk(edges)
    assert predecessors(spark.createDataFrame([], "child string, parent string")).count() == 0


def test_query_follows_rings(spark):
    import __spark_entry__ as E
    from terrane.plans.problems import _all_links

    folder = "/root/testdata/sf0.01"
    want = _walk([tuple(r) for r in _all_links(spark, folder).collect()])
    got = {(r["node"], r["ancestor"], r["steps"]) for r in E.queries()["lineage"](spark, folder).collect()}
    pairs = {(a, b) for a, b, k in want if k}
    assert got == want and any((b, a) in pairs for a, b in pairs)  # there is a ring
