"""Event histories: unions of differently laid out sources, repeats, change points."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrane.operators import asof
from terrane.session import cut

C = F.col


def project_events(df: DataFrame, column_sets: list[dict[str, str]], constants: list[dict[str, object]] | None = None) -> DataFrame | None:
    """Union of the projections of one table under several column sets {target: source}; a set whose sources are not
    all there is skipped, and None comes back if none is. Types follow the targets' first use; names match without
    regard to case."""
    have = {c.lower(): c for c in df.columns}
    out = None
    for i, cols in enumerate(column_sets):
        if not all(src.lower() in have for src in cols.values()):
            continue
        part = df.select(*(C(f"`{have[src.lower()]}`").alias(t) for t, src in cols.items()), *(F.lit(v).alias(t) for t, v in ((constants or [{}] * len(column_sets))[i]).items()))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def dedupe_events(events: DataFrame, *, key: str, at: str, number: str, start: str, grade: str, role_rank: Column, tie: list[str]) -> DataFrame:
    """One row per (key, time), with ``conflict`` true where its grade is contested.

    Of rows with one number the one with the least role rank stays (then the least ``tie``); rows without a number all
    go on. Of rows of one key and time only the best role's stay, of these only those with the latest start; if more
    than one grade is left the row is marked; the greatest ``tie`` is kept. NULL starts count as earliest.
    """
    e = events.where(C(key).isNotNull() & C(at).isNotNull() & C(grade).isNotNull()).withColumn("_rank", role_rank)
    blank = C(number).isNull() | (F.trim(C(number)) == "")
    w = Window.partitionBy(F.when(blank, None).otherwise(F.trim(C(number)))).orderBy("_rank", *tie)
    numbered = e.where(~blank).withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
    e = numbered.unionByName(e.where(blank))
    g = Window.partitionBy(key, at)
    e = e.withColumn("_best", F.min("_rank").over(g)).where("_rank = _best")
    e = e.withColumn("_late", F.max(start).over(g)).where(C(start).eqNullSafe(C("_late")))
    e = e.withColumn("conflict", F.min(grade).over(g) != F.max(grade).over(g))
    return e.withColumn("_n", F.row_number().over(g.orderBy(*(F.desc(t) for t in tie)))).where("_n = 1").drop("_n", "_best", "_late", "_rank")


def change_points(df: DataFrame, key: str, at: list[str], value: str) -> DataFrame:
    """Rows whose value differs from the one before within the key, the first row included; NULL is a value."""
    w = Window.partitionBy(key).orderBy(*at)
    d = df.withColumns({"_before": F.lag(value).over(w), "_i": F.row_number().over(w)})
    return d.where((C("_i") == 1) | ~C(value).eqNullSafe(C("_before"))).drop("_before", "_i")


def lineage(tree: DataFrame) -> DataFrame:
    """(node, ancestor, steps) of a hierarchy, the node itself first with 0 steps; nodes on or below rings keep only
    themselves, as a hierarchy has no paths for them (``predecessors`` follows rings as well)."""
    p = tree.where(~C("ring")).select(C("node"), "depth", F.posexplode("path").alias("_at", "ancestor"))
    own = tree.where(C("ring")).select("node", C("node").alias("ancestor"), F.lit(0).alias("steps"))
    return p.select("node", "ancestor", (C("depth") - C("_at")).cast("int").alias("steps")).unionByName(own)


def predecessors(links: DataFrame, max_rounds: int = 200) -> DataFrame:
    """(node, ancestor, steps) over links (child, parent): the node itself with 0 steps, then everything above it once,
    with the least number of steps. Children may have several parents, and links may form rings.

    By doubling: ``reach`` holds all pairs closer than ``step``, ``jump`` those exactly ``step`` apart. A pair further
    off but closer than 2 * step is a jump and then a pair of ``reach``, so that the rounds are logarithmic in the
    length; a jump that leads to what is already reached (round a ring) is dropped, which ends the search.
    """
    jump = cut(links.where(C("child").isNotNull() & C("parent").isNotNull()).select(C("child").alias("node"), C("parent").alias("ancestor")).distinct())
    nodes = jump.select("node").unionByName(jump.select(C("ancestor").alias("node"))).distinct()
    reach = nodes.select("node", C("node").alias("ancestor"), F.lit(0).cast("long").alias("steps"))
    jump, step = jump.where("node <> ancestor"), 1
    for _ in range(max_rounds):
        mid = jump.withColumnRenamed("ancestor", "_mid")
        further = mid.join(reach.select(C("node").alias("_mid"), "ancestor", "steps"), "_mid").select("node", "ancestor", (C("steps") + step).alias("steps"))
        reach = cut(reach.unionByName(further).groupBy("node", "ancestor").agg(F.min("steps").alias("steps")))
        twice = mid.join(jump.withColumnRenamed("node", "_mid"), "_mid").select("node", "ancestor").distinct()
        jump, step = cut(twice.join(reach, ["node", "ancestor"], "left_anti")), step * 2
        if jump.isEmpty():
            return reach
    raise RuntimeError("links are too long")


def over_lines(events: DataFrame, lines: DataFrame, event_key: str) -> DataFrame:
    """The events of every node's whole line: columns of the events, ``node`` and ``steps``; ``lines`` (node, ancestor,
    steps) holds the node itself with 0 steps."""
    return lines.select("node", C("ancestor").alias("_a"), "steps").join(events, C("_a") == C(f"`{event_key}`")).drop("_a")


def with_own(lines: DataFrame, keys: DataFrame) -> DataFrame:
    """Lines, and for each key (one column) that they lack the key itself alone."""
    own = keys.toDF("node").where("node is not null").distinct().join(lines.select("node").distinct(), "node", "left_anti")
    return lines.select("node", "ancestor", "steps").unionByName(own.select("node", C("node").alias("ancestor"), F.lit(0).cast("long").alias("steps")))


def line_history(events: DataFrame, lines: DataFrame, *, event_key: str, at: list[str], value: str) -> DataFrame:
    """The change points of each node's whole line: its events and its ancestors' in the order of ``at``, of one moment
    the nearer ancestor's first, where the value differs from the one before."""
    w = over_lines(events, lines, event_key)
    return change_points(w, "node", [at[0], "steps", *at[1:]], value)


def in_force(questions: DataFrame, key: str, at: str, events: DataFrame, lines: DataFrame, *, event_key: str, event_at: Column, value: str) -> DataFrame:
    """Each question (key, time) with the struct ``in_force`` (``value``, ``at``, ``source``): the latest event's value
    up to its time over the key and all its ancestors, its time and whose it was; of one time the nearest ancestor's,
    and of equally near ones the greatest value's. NULL where there is none. Keys that ``lines`` lacks have themselves
    alone."""
    e = events.select(C(f"`{event_key}`").alias("_key"), event_at.alias("_at"), C(f"`{value}`").alias("_v"))
    met = over_lines(e, with_own(lines, questions.select(key)), "_key")
    held = F.struct(C("_v").alias("value"), C("_at").alias("at"), C("_key").alias("source"))
    h = asof.history(met.where(C("_v").isNotNull()), "in_force", C("node"), C("_at"), held, [-C("steps")])
    return asof.as_of(questions, key, at, {"in_force": h})


def line_start(lines: DataFrame, dates: DataFrame, key: str, date: str) -> DataFrame:
    """(node, known, first) per line: ``known`` is false where the furthest ancestor (of equally far ones the greatest)
    has no date, so that the line began before the records; else ``first`` is the least date of the line."""
    d = dates.groupBy(C(f"`{key}`").alias("ancestor")).agg(F.min(date).alias("_d"))
    per = lines.join(d, "ancestor", "left").groupBy("node").agg(F.max_by("_d", F.struct("steps", "ancestor")).alias("_last"), F.min("_d").alias("_first"))
    return per.select("node", C("_last").isNotNull().alias("known"), F.when(C("_last").isNotNull(), C("_first")).alias("first"))


def open_on(day: Column, opened: Column, closed: Column) -> Column:
    """Whether a place was open on a day: begun by then (NULL: before the records) and not closed by then (NULL: open)."""
    return (opened.isNull() | (opened <= day)) & (closed.isNull() | (closed > day))
