"""Parent-child links to full hierarchies by tree contraction.

Rounds take two steps on all nodes at once. Rake: every node without children is removed. Compress: in chains of nodes
with a single child, an independent set (nodes whose hash is less than their neighbours') is spliced out, and the
child hangs on its grandparent. Both record what they removed, so the number of rounds is logarithmic whatever the
depth. A ring of links shrinks to a node that is its own parent and can never be raked: such a core exposes a cycle.
Rounds run over the whole cluster until the links left fit one task; the same rounds then go on within that task. The
records form trees no deeper than the number of steps; they are reversed all at once by doubling: each node takes over
what the node that it hung on has, and hangs on from there.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrane.session import ROWS_PER_TASK, Spread, cut, small

#: Links up to which the remaining rounds run within one task.
LOCAL_LINKS = 50_000


def distinct_links(edges: DataFrame, child: Column, parent: Column) -> DataFrame:
    """Distinct (child, parent) with both given."""
    return edges.select(child.alias("child"), parent.alias("parent")).where(F.col("child").isNotNull() & F.col("parent").isNotNull()).distinct()


def single_parents(edges: DataFrame, child: Column, parent: Column) -> DataFrame:
    """Distinct (child, parent) with both given; of several parents of one child the least is taken (those not taken
    are in ``other_parents``)."""
    return distinct_links(edges, child, parent).groupBy("child").agg(F.min("parent").alias("parent"))


def other_parents(edges: DataFrame, child: Column, parent: Column) -> DataFrame:
    """(child, parent, kept): the links that ``single_parents`` leaves out, beside the parent that it keeps."""
    all_ = distinct_links(edges, child, parent)
    kept = all_.groupBy("child").agg(F.min("parent").alias("kept"), F.count("*").alias("_n")).where("_n > 1").drop("_n")
    return all_.join(kept, "child").where("parent <> kept")


def _round(e: DataFrame, r: int) -> DataFrame:
    """Flag each link: what = 'rake', 'splice' or 'keep'; the child of a spliced node is moved up to its parent. Joins
    are on the child, which is unique, so no node's children ever meet in one task."""
    kids = e.groupBy(F.col("parent").alias("child")).agg(F.count("*").alias("n"), F.min("child").alias("only"))
    h = lambda c: F.xxhash64(c, F.lit(r))
    chain = (F.col("n") == 1) & (h(F.col("child")) < h(F.col("parent"))) & (h(F.col("child")) < h(F.col("only")))
    what = F.when(F.col("n").isNull(), "rake").when(chain, "splice").otherwise("keep")
    e = e.join(kids, "child", "left").withColumn("what", what)
    moved = e.where("what = 'splice'").select(F.col("only").alias("child"), F.col("child").alias("_c"), F.col("parent").alias("_p"), F.col("hops").alias("_h"), F.col("via").alias("_v"))
    take = F.col("_p").isNotNull() & (F.col("what") == "keep")
    return e.join(moved, "child", "left").select(
        "child", F.when(take, F.col("_p")).otherwise(F.col("parent")).alias("parent"), F.when(take, F.col("_h") + F.col("hops")).otherwise(F.col("hops")).alias("hops"),
        F.when(take & F.col("_v").isNotNull(), F.concat("_v", F.array("_c"), "via")).otherwise(F.col("via")).alias("via"), "what",
    )


def contract(child: np.ndarray, parent: np.ndarray, hops: np.ndarray, via: list | None) -> list[tuple]:
    """All rounds on links in memory: (node, up, hops, segment or None) of every node removed; ``up`` is None for
    what is left of a ring."""
    names, code = np.unique(np.concatenate([child, parent]), return_inverse=True)
    n = len(child)
    node, up = code[:n].copy(), code[n:].copy()
    hops, rng, out = hops.astype(np.int64).copy(), np.random.default_rng(7), []
    tail = lambda i: None if via is None else [*via[i], names[node[i]]]
    live = np.arange(n)
    while len(live):
        loops = live[node[live] == up[live]]
        out += [(names[node[i]], None, 0, None) for i in loops]
        live = live[node[live] != up[live]]
        kids = np.bincount(up[live], minlength=len(names))
        only = np.full(len(names), -1)
        only[up[live]] = live  # the row of the child, where there is one child
        h = rng.permutation(len(names))
        raked = kids[node[live]] == 0
        one = kids[node[live]] == 1
        below = np.where(one, node[np.maximum(only[node[live]], 0)], 0)
        spliced = one & (h[node[live]] < h[up[live]]) & (h[node[live]] < h[below])
        out += [(names[node[i]], names[up[i]], int(hops[i]), tail(i)) for i in live[raked | spliced]]
        for i in live[spliced]:
            k = only[node[i]]
            up[k], hops[k] = up[i], hops[i] + hops[k]
            if via is not None:
                via[k] = [*via[i], names[node[i]], *via[k]]
        live = live[~(raked | spliced)]
    return out


def _finish(live: DataFrame, schema, paths: bool) -> DataFrame:
    """The remaining rounds within one task."""

    def run(batches):
        import pandas as pd

        pdfs = [p for p in batches if len(p)]
        if not pdfs:
            return
        pdf = pd.concat(pdfs, ignore_index=True)
        rows = contract(pdf["child"].to_numpy(), pdf["parent"].to_numpy(), pdf["hops"].to_numpy(), [list(v) for v in pdf["via"]] if paths else None)
        yield pd.DataFrame(rows, columns=["node", "up", "hops", "seg"], dtype=object).assign(root=None)[["node", "up", "root", "hops", "seg"]]

    return live.select("child", "parent", "hops", "via").coalesce(1).mapInPandas(run, schema)


def hierarchy(links: DataFrame, paths: bool = True, rows_per_task: int = ROWS_PER_TASK, local_links: int = LOCAL_LINKS, max_rounds: int = 200) -> DataFrame:
    """Every node of links (child, parent; one parent per child) with ``root``, ``depth``, ``path`` (from the root to
    the node itself; NULL if ``paths`` is false, which spares the arrays) and ``ring``.

    Nodes on a ring or below one get ``ring`` true and NULL root, depth and path. A node that is its own parent is a
    ring. Links with a NULL are left out; empty links give no rows. A node on which more than ``rows_per_task`` others
    hang is spread over several partitions where results are handed down; contraction itself never gathers a node's
    children. ``local_links``: links up to which the rounds go on within one task.
    """
    node = links.schema["child"].dataType
    name = node.simpleString()
    schema = f"node {name}, up {name}, root {name}, hops long, seg array<{name}>"
    none = F.lit(None).cast(f"array<{name}>")
    via = F.array().cast(f"array<{name}>") if paths else none
    live = cut(links.where(F.col("child").isNotNull() & F.col("parent").isNotNull()).select("child", "parent", F.lit(1).cast("long").alias("hops"), via.alias("via")))
    roots = live.select(F.col("parent").alias("node")).distinct().join(live.select(F.col("child").alias("node")), "node", "left_anti")
    no = F.lit(None).cast(name)
    # (node, up, root, hops, seg): node hangs hops below up, and its path is that of up, then seg; NULL up: all is
    # known, and a NULL root is a ring
    done = [roots.select("node", no.alias("up"), F.col("node").alias("root"), F.lit(0).cast("long").alias("hops"), (F.array("node") if paths else none).alias("seg"))]
    for r in range(max_rounds):
        if small(live, local_links):
            done.append(_finish(live, schema, paths))
            break
        loops = live.where(F.col("child") == F.col("parent"))
        flagged = cut(_round(live.where(F.col("child") != F.col("parent")), r))
        done.append(loops.select(F.col("child").alias("node"), no.alias("up"), no.alias("root"), F.lit(0).cast("long").alias("hops"), none.alias("seg")))
        done.append(flagged.where("what <> 'keep'").select(F.col("child").alias("node"), F.col("parent").alias("up"), no.alias("root"), "hops", F.when(F.col("via").isNotNull(), F.concat("via", F.array("child"))).alias("seg")))
        live = flagged.where("what = 'keep'").drop("what")
    else:
        raise RuntimeError("links did not contract")
    t = cut(_all(done))
    for _ in range(max_rounds):
        open_ = t.where(F.col("up").isNotNull())
        if open_.isEmpty():
            break
        parts = Spread(open_, F.col("up"), rows_per_task)
        known = parts.copied(t.select(F.col("node").alias("up"), F.col("up").alias("_up"), F.col("root").alias("_root"), F.col("hops").alias("_hops"), F.col("seg").alias("_seg")), F.col("up"))
        joined = parts.salted(open_.drop("root"), F.col("up"), F.col("node")).join(known, ["up", "_salt"])
        t = cut(t.where(F.col("up").isNull()).unionByName(joined.select("node", F.col("_up").alias("up"), F.col("_root").alias("root"), (F.col("_hops") + F.col("hops")).alias("hops"), F.concat("_seg", "seg").alias("seg"))))
    ring = F.col("root").isNull()
    return t.select("node", "root", F.when(~ring, F.col("hops")).cast("int").alias("depth"), F.when(~ring, F.col("seg")).alias("path"), ring.alias("ring"))


def _all(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def descendants(tree: DataFrame) -> DataFrame:
    """(ancestor, descendant, distance) of every pair in a path, the node itself left out: one row per pair, so no
    node's descendants are ever gathered."""
    p = tree.where(~F.col("ring")).select(F.col("node").alias("descendant"), "depth", F.posexplode("path").alias("at", "ancestor"))
    return p.where(F.col("at") < F.col("depth")).select("ancestor", "descendant", (F.col("depth") - F.col("at")).cast("int").alias("distance"))
