"""Signed distances of points to regions, and the assignment of each point to one region."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrane.operators import regions
from terrane.operators.quality import assert_no_orphans
from terrane.session import broadcast_if_small, cut

C = F.col


def circle_distance(x: Column, y: Column, cx: Column, cy: Column, radius: Column) -> Column:
    """Metres to a circle's line, positive inside, 0 on it, negative outside; NULL if anything is NULL."""
    return radius - F.sqrt((x - cx) * (x - cx) + (y - cy) * (y - cy))


def candidate_pairs(points: DataFrame, x: str, y: str, circles: DataFrame, *, key: str, cx: str, cy: str, radius: str, reach: float) -> DataFrame:
    """(point columns, key, radius, d_signed) of points less than ``reach`` from a circle's line, on either side.

    Points meet only the circles whose widened extent holds them; nothing of the size of points times circles
    arises. Circles without radius or centre, and points without coordinates, give no pairs.
    """
    c = circles.select(C(key).alias("_key"), C(cx).alias("_cx"), C(cy).alias("_cy"), C(radius).alias("_r"))
    near = regions.points_in_regions(points, C(x), C(y), regions.circle_edges(c, "_key", "_cx", "_cy", C("_r") + reach))
    j = near.join(c, near.region == c._key).withColumn("d_signed", circle_distance(C(x), C(y), C("_cx"), C("_cy"), C("_r")))
    return j.where(F.abs("d_signed") < reach).select(*points.columns, C("_key").alias(key), C("_r").alias(radius), "d_signed")


def assign_nearest(pairs: DataFrame, point: str, region: str, near: float = 400.0, kind: str | None = None, apart: list[tuple[str, str]] = ()) -> DataFrame:
    """One pair per point. A pair outside its region is contaminated, and dropped, if the point lies inside another
    region that is an alternative; of the rest the nearest line wins, ties by the region's key. Adds ``n_near``, the
    number of regions less than ``near`` away, counted before the rule. Exact repeats of a pair count once; a NULL
    point is one point. Regions are alternatives for one another unless ``apart`` names the two values of their
    ``kind`` (in either order, without case); a NULL kind is an alternative for all.
    """
    w = Window.partitionBy(point)
    inside = lambda cond: F.sum((C("d_signed") > 0).cast("int") * cond.cast("int")).over(w)
    p = pairs.distinct().withColumns({"_in": inside(F.lit(True)), "n_near": F.sum((F.abs("d_signed") < near).cast("int")).over(w)})
    if kind and apart:
        own = F.lower(C(kind))
        both = [(a.lower(), b.lower()) for pair in apart for a, b in (pair, pair[::-1])]
        other = sum((F.when(own == a, inside(F.coalesce(own == b, F.lit(False)))).otherwise(0) for a, b in both), F.lit(0))
        p = p.withColumn("_in", C("_in") - other)
    p = p.where((C("d_signed") > 0) | (C("_in") == 0))
    return p.withColumn("_rank", F.row_number().over(w.orderBy(F.abs("d_signed"), region))).where("_rank = 1").drop("_rank", "_in")


def assign_in_place(points: DataFrame, x: str, y: str, circles: DataFrame, *, key: str, cx: str, cy: str, radius: str, reach: float, cell: float = 1000.0) -> DataFrame:
    """The same assignment without a shuffle of points: each grid cell holds an array of the circles that come near
    it, a point takes its cell's array by one broadcast join (if the cells' number allows) and chooses within it."""
    c = circles.where(C(radius).isNotNull() & C(cx).isNotNull() & C(cy).isNotNull())
    span = C(radius) + reach
    k = lambda v: F.floor(v / cell)
    c = c.withColumn("_i", F.explode(F.sequence(k(C(cx) - span), k(C(cx) + span)))).withColumn("_j", F.explode(F.sequence(k(C(cy) - span), k(C(cy) + span))))
    cells = c.groupBy("_i", "_j").agg(F.array_sort(F.collect_list(F.struct(C(key).alias("k"), C(cx).cast("double").alias("x"), C(cy).cast("double").alias("y"), C(radius).cast("double").alias("r")))).alias("_near"))
    p = points.where(C(x).isNotNull() & C(y).isNotNull() & ~F.isnan(x) & ~F.isnan(y)).withColumns({"_i": k(C(x)), "_j": k(C(y))})
    j = p.join(broadcast_if_small(cells), ["_i", "_j"])
    d = F.filter(F.transform("_near", lambda b: F.struct(b["k"].alias("k"), circle_distance(C(x), C(y), b["x"], b["y"], b["r"]).alias("d"))), lambda b: F.abs(b["d"]) < reach)
    j = j.withColumn("_d", d).withColumn("_any", F.exists("_d", lambda b: b["d"] > 0))
    valid = F.filter("_d", lambda b: (b["d"] > 0) | ~C("_any"))
    best = F.array_min(F.transform(valid, lambda b: F.struct(F.abs(b["d"]).alias("a"), b["k"].alias("k"), b["d"].alias("d"))))
    return j.withColumn("_b", best).where("_b is not null").select(*points.columns, C("_b.k").alias(key), C("_b.d").alias("d_signed"))


def nearest(points: DataFrame, x: str, y: str, targets: DataFrame, *, target: str, tx: str, ty: str, k: int = 1, cell: float = 2000.0, other_than: str | None = None) -> DataFrame:
    """The ``k`` nearest targets of every distinct point location, exactly: (x, y, [other_than], target, distance, rank).

    Points look in the 3 x 3 cells around them; whoever has k targets within one cell's width is done, the others
    look again on a grid four times as coarse. Ties go to the lesser target. Points that have fewer than k targets
    in all get those there are. ``other_than``: a column of the points that names a target not to be taken.
    """
    keep = [x, y] + ([other_than] if other_than else [])
    p = cut(points.where(C(x).isNotNull() & C(y).isNotNull() & ~F.isnan(x) & ~F.isnan(y)).select(*keep).distinct())
    t = targets.where(C(tx).isNotNull() & C(ty).isNotNull()).select(C(target).alias("target"), C(tx).cast("double").alias("_tx"), C(ty).cast("double").alias("_ty")).distinct()
    box = t.agg(F.min("_tx"), F.max("_tx"), F.min("_ty"), F.max("_ty")).collect()[0]
    if box[0] is None:
        return p.select(*keep, F.lit(None).cast(targets.schema[target].dataType).alias("target"), F.lit(None).cast("double").alias("distance"), F.lit(None).cast("int").alias("rank")).where("false")
    pbox = p.agg(F.min(x), F.max(x), F.min(y), F.max(y)).collect()[0]
    if pbox[0] is None:
        pbox = box
    extent = max(max(box[1], pbox[1]) - min(box[0], pbox[0]), max(box[3], pbox[3]) - min(box[2], pbox[2]), cell)
    out, size = None, float(cell)
    while True:
        last = size > extent
        around = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)))
        wide = t.withColumn("_o", F.explode(around)).select("target", "_tx", "_ty", (F.floor(C("_tx") / size) + C("_o.i")).alias("_i"), (F.floor(C("_ty") / size) + C("_o.j")).alias("_j"))
        c = p.withColumns({"_i": F.floor(C(x) / size), "_j": F.floor(C(y) / size)}).join(wide, ["_i", "_j"])
        if other_than:
            c = c.where(~C("target").eqNullSafe(C(other_than)))
        c = c.withColumn("distance", F.sqrt((C(x) - C("_tx")) * (C(x) - C("_tx")) + (C(y) - C("_ty")) * (C(y) - C("_ty"))))
        # the k least, kept as such before the shuffle too: no point's candidates are ever gathered
        order = Window.partitionBy(*keep).orderBy("distance", "target")
        best = c.withColumn("_r", F.row_number().over(order)).where(C("_r") <= k).groupBy(*keep).agg(F.array_sort(F.collect_list(F.struct("distance", "target"))).alias("_b"))
        if last:
            found = best
        else:
            found = best.where((F.size("_b") == k) & (F.element_at("_b", -1)["distance"] <= size))
        rows = found.select(*keep, F.posexplode("_b").alias("_r", "_n")).select(*keep, C("_n.target").alias("target"), C("_n.distance").alias("distance"), (C("_r") + 1).alias("rank"))
        out = rows if out is None else out.unionByName(rows)
        if last:
            return out
        left = cut(p.alias("p").join(found.alias("f"), [C(f"p.{n}").eqNullSafe(C(f"f.{n}")) for n in keep], "left_anti"))
        if left.isEmpty():
            return out
        p, size = left, size * 4


def nearest_outside(points: DataFrame, targets: DataFrame, lines: DataFrame, *, key: str, x: str, y: str, k: int, cell: float = 2000.0) -> DataFrame:
    """The ``k`` nearest targets of each point that aren't of its own line (node, ancestor): (key, target, distance,
    rank). Both tables have ``key``, ``x`` and ``y``. As many more are looked for as the longest line has members."""
    longest = lines.groupBy("node").count().agg(F.coalesce(F.max("count"), F.lit(0))).collect()[0][0]
    near = nearest(points, x, y, targets, target=key, tx=x, ty=y, k=k + longest, cell=cell, other_than=key)
    out = near.join(lines.select(C("node").alias(key), C("ancestor").alias("target")), [key, "target"], "left_anti").drop("rank")
    w = Window.partitionBy(key).orderBy("distance", "target")
    return out.withColumn("rank", F.row_number().over(w)).where(C("rank") <= k).select(key, "target", "distance", "rank")


def build_areas(rows: DataFrame, places: DataFrame, *, key: str, year: str, radius: str, route: str) -> DataFrame:
    """One area per key from its yearly rows: route, place, ``radius`` (median over the years), ``radius_by_year``,
    ``n_years`` and ``cv`` (sample deviation over mean, NULL for one year). Of several rows of a year the largest
    radius counts. A key with two routes, or without a place, is an error; NULL radii leave a year without a figure.
    """
    mixed = rows.groupBy(key).agg(F.countDistinct(route).alias("n")).where("n > 1").limit(5).collect()
    if mixed:
        raise ValueError(f"several routes for {[r[key] for r in mixed]}")
    assert_no_orphans(rows, places, [key])
    yearly = rows.groupBy(key, year).agg(F.max(radius).alias("_r"), F.min(route).alias("route"))
    kept = F.filter(F.collect_list(F.struct(C(year).alias("key"), C("_r").alias("value"))), lambda e: e["key"].isNotNull())
    per = yearly.groupBy(key).agg(F.min("route").alias("route"), F.median("_r").alias("radius"), F.map_from_entries(kept).alias("radius_by_year"), F.count(year).alias("n_years"), (F.stddev_samp("_r") / F.avg("_r")).alias("cv"))
    return per.join(places, key)


def ring_distance(x: Column, y: Column, edges: Column) -> Column:
    """Least distance from a point to an array of straight edges (x1, y1, x2, y2)."""
    def one(e: Column) -> Column:
        ex, ey = e["x2"] - e["x1"], e["y2"] - e["y1"]
        t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((x - e["x1"]) * ex + (y - e["y1"]) * ey) / (ex * ex + ey * ey)))
        dx, dy = x - (e["x1"] + t * ex), y - (e["y1"] + t * ey)
        return F.sqrt(dx * dx + dy * dy)

    return F.array_min(F.transform(edges, one))


def polygon_pairs(points: DataFrame, x: str, y: str, polygons: DataFrame, *, key: str, wkt: str, reach: float, strip: float = 500.0) -> DataFrame:
    """(point columns, key, d_signed) of points less than ``reach`` from a polygon's line: distance to the nearest
    edge, with the sign from crossing parity (holes and several parts work by parity; parts of one region must not
    overlap). A point meets only the edges whose widened extent reaches its cell, and for the parity those of its
    latitude strip. Points without coordinates and polygons without a valid outline give no pairs.
    """
    e = regions.polygon_edges(polygons, key, wkt)
    k = lambda v, size: F.floor(v / size)
    span = lambda a, b: F.sequence(k(F.least(a, b) - reach, reach), k(F.greatest(a, b) + reach, reach))
    near = e.withColumn("_i", F.explode(span(C("edge.x1"), C("edge.x2")))).withColumn("_j", F.explode(span(C("edge.y1"), C("edge.y2"))))
    near = near.groupBy("_i", "_j", C("region").alias("_region")).agg(F.collect_list("edge").alias("_edges"))
    level = e.withColumn("_strip", F.explode(F.sequence(k(C("edge.lo"), strip), k(C("edge.hi"), strip)))).groupBy("_strip", C("region").alias("_region")).agg(F.collect_list("edge").alias("_ring"))
    p = points.select(F.struct(*(F.col(f"`{c}`") for c in points.columns)).alias("_row"), C(x).cast("double").alias("_x"), C(y).cast("double").alias("_y"))
    p = p.where(C("_x").isNotNull() & C("_y").isNotNull() & (F.abs("_x") < 1e15) & (F.abs("_y") < 1e15)).withColumns({"_i": k(C("_x"), reach), "_j": k(C("_y"), reach), "_strip": k(C("_y"), strip)})
    j = p.join(broadcast_if_small(near), ["_i", "_j"]).withColumn("_d", ring_distance(C("_x"), C("_y"), C("_edges"))).where(C("_d") < reach).drop("_edges")
    j = j.join(broadcast_if_small(level), ["_strip", "_region"], "left")
    east = lambda q: q["x1"] + (C("_y") - q["y1"]) * (q["x2"] - q["x1"]) / F.when(q["y2"] != q["y1"], q["y2"] - q["y1"]) > C("_x")
    crossed = F.size(F.filter(F.coalesce("_ring", F.array()), lambda q: (q["lo"] <= C("_y")) & (C("_y") < q["hi"]) & east(q)))
    return j.select(*(C("_row").getField(c).alias(c) for c in points.columns), C("_region").alias(key), F.when(crossed % 2 == 1, C("_d")).otherwise(-C("_d")).alias("d_signed"))


def region_pairs(points: DataFrame, x: str, y: str, areas: DataFrame, *, key: str, cx: str, cy: str, radius: str, wkt: str, reach: float) -> DataFrame:
    """(point columns, key, radius, d_signed) of points less than ``reach`` from a region's line: a region with a
    radius is a circle round its centre, one without is its polygon."""
    round_ = candidate_pairs(points, x, y, areas.where(C(radius).isNotNull()), key=key, cx=cx, cy=cy, radius=radius, reach=reach)
    drawn = polygon_pairs(points, x, y, areas.where(C(radius).isNull()), key=key, wkt=wkt, reach=reach)
    return round_.unionByName(drawn.withColumn(radius, F.lit(None).cast(areas.schema[radius].dataType)))
