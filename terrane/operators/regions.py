"""Points in regions by crossing parity over latitude strips.

A region is a polygon (rings of straight edges) or a circle (a western and an eastern arc). Its edges are binned
into strips of latitude and, so that only near points meet them, into the columns that the region's extent covers.
A point joins the edges of its own cell; the crossings of a ray to the east are counted per point and region, and an
odd count is inside. Edges of one region and cell are grouped before the join, so each point counts its crossings in
its own row: the group-by of crossings needs no shuffle of points, and no pair outside a region's extent arises.
Points that lie on an edge within ``eps`` are reported as boundary points and are left to an exact test.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Edges in cells, copies counted, up to which the cells are broadcast (some 60 bytes each); above it the join shuffles
#: both sides instead. Columns of cells that a region takes at most, about.
BROADCAST_EDGES, COLUMNS = 400_000, 16


def circle_edges(df: DataFrame, region: str, x: str, y: str, radius: Column) -> DataFrame:
    """Two arcs per circle with a positive radius and full coordinates; others give none."""
    r = radius.cast("double")
    good = df.where(r.isNotNull() & ~F.isnan(r) & (r > 0) & F.col(x).isNotNull() & F.col(y).isNotNull() & ~F.isnan(F.col(x)) & ~F.isnan(F.col(y)))
    e = good.select(F.col(region).alias("region"), F.col(x).cast("double").alias("cx"), F.col(y).cast("double").alias("cy"), r.alias("r")).distinct()
    box = dict(west=F.col("cx") - F.col("r"), east=F.col("cx") + F.col("r"), south=F.col("cy") - F.col("r"), north=F.col("cy") + F.col("r"))
    arcs = F.array(*(F.struct(F.lit(side).alias("side"), F.col("cx").alias("x1"), F.col("cy").alias("y1"), F.col("r").alias("x2"), F.lit(0.0).alias("y2"), box["south"].alias("lo"), box["north"].alias("hi")) for side in (-1, 1)))
    return e.select("region", *(c.alias(n) for n, c in box.items()), F.explode(arcs).alias("edge"))


def polygon_edges(df: DataFrame, region: str, wkt: str) -> DataFrame:
    """Straight edges of WKT polygons and multipolygons (all rings; holes work by parity). Bad or NULL WKT gives none."""
    nums = r"\(([^()]+)\)"
    rings = F.regexp_extract_all(F.col(wkt), F.lit(nums), F.lit(1))
    pts = F.transform(F.split(F.col("ring"), r"\s*,\s*"), lambda p: F.struct(F.split(F.trim(p), r"\s+")[0].try_cast("double").alias("x"), F.get(F.split(F.trim(p), r"\s+"), F.lit(1)).try_cast("double").alias("y")))
    d = df.where(F.col(wkt).rlike(r"(?i)polygon")).select(F.col(region).alias("region"), F.explode(rings).alias("ring")).select("region", pts.alias("p"))
    d = d.where((F.size("p") > 2) & ~F.exists("p", lambda q: q["x"].isNull() | q["y"].isNull()))
    n = F.size("p")
    pairs = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(F.get(F.col("p"), i).alias("a"), F.get(F.col("p"), (i + 1) % n).alias("b")))
    e = d.select("region", F.explode(pairs).alias("ab")).where((F.col("ab.a.x") != F.col("ab.b.x")) | (F.col("ab.a.y") != F.col("ab.b.y")))
    box = e.groupBy("region").agg(
        F.min(F.least("ab.a.x", "ab.b.x")).alias("west"), F.max(F.greatest("ab.a.x", "ab.b.x")).alias("east"),
        F.min(F.least("ab.a.y", "ab.b.y")).alias("south"), F.max(F.greatest("ab.a.y", "ab.b.y")).alias("north"),
    )
    edge = F.struct(F.lit(0).alias("side"), F.col("ab.a.x").alias("x1"), F.col("ab.a.y").alias("y1"), F.col("ab.b.x").alias("x2"), F.col("ab.b.y").alias("y2"), F.least("ab.a.y", "ab.b.y").alias("lo"), F.greatest("ab.a.y", "ab.b.y").alias("hi"))
    return e.join(box, "region").select("region", "west", "east", "south", "north", edge.alias("edge"))


def box_edges(df: DataFrame, region: str, west: str, south: str, east: str, north: str) -> DataFrame:
    """The four edges of upright boxes; one with a NULL side or without extent gives none."""
    w, s, e, n = (F.col(c).cast("double") for c in (west, south, east, north))
    edge = lambda x1, y1, x2, y2: F.struct(F.lit(0).alias("side"), x1.alias("x1"), y1.alias("y1"), x2.alias("x2"), y2.alias("y2"), F.least(y1, y2).alias("lo"), F.greatest(y1, y2).alias("hi"))
    around = F.array(edge(w, s, w, n), edge(e, s, e, n), edge(w, s, e, s), edge(w, n, e, n))
    return df.where((w < e) & (s < n)).select(F.col(region).alias("region"), w.alias("west"), e.alias("east"), s.alias("south"), n.alias("north"), F.explode(around).alias("edge"))


def cells(edges: DataFrame, strip: float) -> DataFrame:
    """Edges grouped by (latitude strip, level, column, region). Columns span the region's extent: a ray from a point
    within it crosses all edges of the strip to its east, so each column holds all the strip's edges. A column is
    ``strip`` wide times two to the region's level, which keeps a region within some ``COLUMNS`` columns, so that the
    copies of an edge don't grow with the region."""
    k = lambda c: F.floor(c / strip)
    level = F.greatest(F.ceil(F.log2(F.greatest((F.col("east") - F.col("west")) / (strip * COLUMNS), F.lit(1.0)))), F.lit(0)).cast("int")
    s = edges.withColumn("strip", F.explode(F.sequence(k(F.col("edge.lo")), k(F.col("edge.hi")))))
    g = s.groupBy("strip", "region", "west", "east", "south", "north").agg(F.collect_list("edge").alias("edges")).withColumn("level", level)
    wide = F.lit(strip) * F.pow(F.lit(2.0), F.col("level"))
    return g.withColumn("column", F.explode(F.sequence(F.floor(F.col("west") / wide), F.floor(F.col("east") / wide))))


def points_in_regions(points: DataFrame, x: Column, y: Column, edges: DataFrame, *, strip: float = 500.0, eps: float = 1e-6, broadcast_edges: int = BROADCAST_EDGES) -> DataFrame:
    """Every (point row, region) whose crossing parity is odd or that lies on the boundary.

    Keeps the columns of ``points`` and adds ``region``, ``crossings`` and ``on_boundary`` (replacing columns of these
    names); exact repeats of a point row stay repeats. NULL, NaN and infinite coordinates are in no region. A row on a boundary is returned with
    ``on_boundary`` true for the caller's own rule; otherwise it is strictly inside.
    The edges in the regions' cells are counted: up to ``broadcast_edges`` the cells are broadcast, beyond it both sides
    shuffle by cell. A point is looked up once per level of the regions' sizes, of which there is one where all are small.
    """
    px, py = x.cast("double"), y.cast("double")
    big = F.lit(1e15)
    keep = [n for n in points.columns if n not in ("region", "crossings", "on_boundary")]
    # the row travels as one struct, so that no column of it can clash with the operator's own
    p = points.select(F.struct(*(F.col(f"`{n}`") for n in keep)).alias("_row"), px.alias("_x"), py.alias("_y"))
    p = p.where(F.col("_x").isNotNull() & F.col("_y").isNotNull() & (F.abs("_x") < big) & (F.abs("_y") < big))
    grouped = cells(edges, strip)
    levels = {r["level"]: r["n"] for r in grouped.groupBy("level").agg(F.sum(F.size("edges")).alias("n")).collect()}
    p = p.withColumn("_level", F.explode(F.array(*(F.lit(v) for v in sorted(levels)))) if len(levels) > 1 else F.lit(next(iter(levels), 0)))
    p = p.withColumns({"_strip": F.floor(F.col("_y") / strip), "_column": F.floor(F.col("_x") / (F.lit(strip) * F.pow(F.lit(2.0), F.col("_level"))))})
    c = grouped.select(F.col("strip").alias("_strip"), F.col("level").alias("_level"), F.col("column").alias("_column"), F.col("region").alias("_region"), "west", "east", "south", "north", F.col("edges").alias("_edges"))
    c = c.withColumnsRenamed({n: f"_{n}" for n in ("west", "east", "south", "north")})
    c = F.broadcast(c) if sum(levels.values()) <= broadcast_edges else c.hint("shuffle_hash")
    X, Y = F.col("_x"), F.col("_y")
    near = (F.col("_west") - eps <= X) & (X <= F.col("_east") + eps) & (F.col("_south") - eps <= Y) & (Y <= F.col("_north") + eps)
    j = p.join(c, ["_strip", "_level", "_column"]).where(near)

    def cross_x(e: Column) -> Column:  # where the line of latitude Y meets the edge
        arc = e["x1"] + e["side"] * F.sqrt(F.greatest(e["x2"] * e["x2"] - (Y - e["y1"]) * (Y - e["y1"]), F.lit(0.0)))
        return F.when(e["side"] != 0, arc).otherwise(e["x1"] + (Y - e["y1"]) * (e["x2"] - e["x1"]) / F.when(e["y2"] != e["y1"], e["y2"] - e["y1"]))

    def counts(e: Column) -> Column:  # half-open in latitude, so that a vertex counts once
        return (e["lo"] <= Y) & (Y < e["hi"]) & F.coalesce(cross_x(e) > X, F.lit(False))

    def touches(e: Column) -> Column:
        along = F.when(e["side"] != 0, F.abs(F.sqrt((X - e["x1"]) * (X - e["x1"]) + (Y - e["y1"]) * (Y - e["y1"])) - e["x2"]) <= eps)
        flat = (e["hi"] - e["lo"] <= eps) & (F.abs(Y - e["y1"]) <= eps) & (F.least(e["x1"], e["x2"]) - eps <= X) & (X <= F.greatest(e["x1"], e["x2"]) + eps)
        return F.coalesce(along, flat | ((e["lo"] - eps <= Y) & (Y <= e["hi"] + eps) & F.coalesce(F.abs(cross_x(e) - X) <= eps, F.lit(False))), F.lit(False))

    j = j.withColumns({"crossings": F.size(F.filter("_edges", counts)), "on_boundary": F.exists("_edges", touches)})
    j = j.where((F.col("crossings") % 2 == 1) | F.col("on_boundary"))
    return j.select(*(F.col("_row").getField(n).alias(n) for n in keep), F.col("_region").alias("region"), "crossings", "on_boundary")
