"""Queries of the boundary study's own operators over the domain tables, whole tables throughout."""

from __future__ import annotations

import uuid
from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terrane.functions.display import amount
from terrane.functions.text import spaced_postcode, strip_white, year_quarter
from terrane.operators import asof, assign, battery, changes, density, quality, regions, units
from terrane.operators import discontinuity as rd
from terrane.plans.problems import _all_links
from terrane.plans.sql import SQL  # noqa: F401
from terrane.session import broadcast_if_small, cut, ensure_checkpoint_dir
from terrane.sources.tables import table
from terrane.streaming import ingest

C = F.col
REACH, H = 750.0, 400.0
GRID = [float(h) for h in range(100, 751, 50)]
R = lambda c, n=6: F.round(c, n) + F.lit(0.0)  # noqa: E731  (no negative zero)

# ---- ingest


def step_log(spark: SparkSession, d: str) -> DataFrame:
    steps = [
        ("type", C("property_type").isin("D", "S", "T", "F")), ("price", C("price") > 0), ("date", C("date").isNotNull()),
        ("postcode", F.coalesce(F.trim("postcode_norm"), F.lit("")) != ""), ("matched", C("matched")), ("grid reference", C("gridind") != 9), ("coordinates", C("easting").isNotNull() & C("northing").isNotNull()),
    ]
    return quality.step_log(table(spark, d, "pp_geo"), steps)


def duplicate_postcodes(spark: SparkSession, d: str) -> DataFrame:
    return quality.duplicate_keys(table(spark, d, "onspd"), ["postcode_key"])


def postcode_forms(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pp_geo").groupBy(spaced_postcode(C("postcode")).alias("postcode_form")).agg(F.count("*").alias("n_rows"))


def match_audit(spark: SparkSession, d: str) -> DataFrame:
    """Left join of sales to the directory on the normalised key, keeping whether it matched, audited per year and district."""
    keys = table(spark, d, "onspd").select(spaced_postcode(C("postcode_key")).alias("key")).where("key is not null").distinct().withColumn("hit", F.lit(True))
    sales = table(spark, d, "pp_geo").select(F.year("date").alias("year"), "district", spaced_postcode(C("postcode")).alias("key"))
    # equal keys of one year and district are counted before the join, so a hot postcode is one row
    pre = sales.groupBy("year", "district", "key").agg(F.count("*").alias("n"))
    j = pre.join(keys, "key", "left")
    one = lambda c, n: F.coalesce(F.sum(F.when(c, C("n"))), F.lit(0)).alias(n)
    return j.groupBy("year", "district").agg(F.sum("n").alias("n_sales"), one(C("key").isNull(), "n_no_postcode"), one(C("key").isNotNull() & C("hit").isNull(), "n_unmatched"))


def region_box(spark: SparkSession, d: str) -> DataFrame:
    """Extent of each authority's directory points, widened by 5 km, and the number of sales within it, edges included."""
    g = table(spark, d, "onspd").where("gridind <> 9 and easting is not null and northing is not null").groupBy("laua")
    box = g.agg((F.min("easting") - 5000).alias("west"), (F.max("easting") + 5000).alias("east"), (F.min("northing") - 5000).alias("south"), (F.max("northing") + 5000).alias("north"))
    box = box.withColumn("laua", F.coalesce("laua", F.lit("")))
    sales = table(spark, d, "pp_geo").where("easting is not null and northing is not null").groupBy("easting", "northing").agg(F.count("*").alias("n"))
    inside = regions.points_in_regions(sales, C("easting"), C("northing"), regions.box_edges(box, "laua", "west", "south", "east", "north"), strip=5000.0)
    held = inside.groupBy(C("region").alias("laua")).agg(F.sum("n").alias("n_sales"))
    return box.join(held, "laua", "left").select("laua", "west", "east", "south", "north", F.coalesce("n_sales", F.lit(0)).cast("long").alias("n_sales"))


def geo_steps(spark: SparkSession, d: str) -> DataFrame:
    """The steps from a sale's postcode to a place within the directory's extent (5 km wider), in one pass over the sales."""
    g = table(spark, d, "onspd").where("gridind <> 9 and easting is not null and northing is not null")
    w, e, s, n = g.agg(F.min("easting") - 5000, F.max("easting") + 5000, F.min("northing") - 5000, F.max("northing") + 5000).collect()[0]
    steps = [
        ("postcode", F.coalesce(F.trim("postcode_norm"), F.lit("")) != ""), ("matched", C("matched")), ("grid reference", C("gridind") != 9),
        ("extent", C("easting").between(w, e) & C("northing").between(s, n) if w is not None else F.lit(False)),
    ]
    return quality.step_log(table(spark, d, "pp_geo"), steps)


def quarter_counts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "sales").groupBy(year_quarter(C("date")).alias("quarter")).agg(F.count("*").alias("n_sales"), F.countDistinct("txn_id").alias("n_txn"))


def indicator_sums(spark: SparkSession, d: str) -> DataFrame:
    one = lambda c: F.sum(F.coalesce(c, F.lit(False)).cast("long"))
    return table(spark, d, "sales").groupBy("year_quarter").agg(
        one(C("property_type") == "F").alias("n_flat"), one(C("property_type") == "D").alias("n_detached"), one(C("tenure") == "L").alias("n_leasehold"), one(C("new_build") == "Y").alias("n_new")
    )


def strict_distance(spark: SparkSession, d: str) -> DataFrame:
    """Published distances of the strict form 'number unit' in metres; other forms give none."""
    return table(spark, d, "provenance").select("prov_id", R(units.strict_metres(C("cutoff_as_published")), 3).alias("metres")).where("metres is not null")


def link_years(spark: SparkSession, d: str) -> DataFrame:
    when = F.coalesce(F.try_to_timestamp("linkestablisheddate", F.lit("dd-MM-yyyy")), F.try_to_timestamp("linkestablisheddate", F.lit("dd/MM/yyyy")))
    return table(spark, d, "links_edubasealldata").groupBy(F.year(when).alias("year")).agg(F.count("*").alias("n_links"))


def event_props(spark: SparkSession, d: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").try_cast("long")
    return table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.sum(k).alias("sum_k"), F.max(k).alias("max_k"))


# ---- assignment

_COLS = ["txn_id", "price", "date", "year_quarter", "postcode", "property_type", "tenure", "new_build", "imd19_rank", "easting", "northing"]


def _sales(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "sales").select(*_COLS)


def _circles(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "boundary").select("urn", C("easting").alias("cx"), C("northing").alias("cy"), "radius_m")


def _pairs(spark: SparkSession, d: str, reach: float = REACH) -> DataFrame:
    """Sales near the line of a circle or, where a boundary has no radius, of its polygon."""
    areas = table(spark, d, "boundary").select("urn", C("easting").alias("cx"), C("northing").alias("cy"), "radius_m", "polygon")
    p = assign.region_pairs(_sales(spark, d), "easting", "northing", areas, key="urn", cx="cx", cy="cy", radius="radius_m", wkt="polygon", reach=reach)
    return p.withColumnRenamed("urn", "boundary_id").distinct()


def _sample(spark: SparkSession, d: str) -> DataFrame:
    s = assign.assign_nearest(_pairs(spark, d), "txn_id", "boundary_id")
    return s.where("price > 0 and date is not null").withColumns({
        "log_price": F.log("price"), "is_flat": (C("property_type") == "F").cast("double"), "is_detached": (C("property_type") == "D").cast("double"),
        "is_leasehold": (C("tenure") == "L").cast("double"), "is_new_build": (C("new_build") == "Y").cast("double"),
    })


def _kept(spark: SparkSession, d: str) -> DataFrame:
    """The sample, written once for queries of several scans."""
    return cut(_sample(spark, d))


def candidate_pairs(spark: SparkSession, d: str) -> DataFrame:
    return _pairs(spark, d).select("txn_id", "boundary_id", R(C("d_signed"), 4).alias("d_m"))


def side_counts(spark: SparkSession, d: str) -> DataFrame:
    p = _pairs(spark, d).where(F.abs("d_signed") < H)
    return p.groupBy("boundary_id").agg(F.count(F.when(C("d_signed") > 0, 1)).alias("n_inside"), F.count(F.when(C("d_signed") <= 0, 1)).alias("n_outside"))


def assign_nearest(spark: SparkSession, d: str) -> DataFrame:
    s = assign.assign_nearest(_pairs(spark, d), "txn_id", "boundary_id")
    return s.select("txn_id", "boundary_id", R(C("d_signed"), 4).alias("d_m"), (C("d_signed") > 0).alias("is_inside"), C("n_near").cast("long").alias("n_near"))


def assign_compatible(spark: SparkSession, d: str) -> DataFrame:
    """The assignment where two kinds of school are no alternatives for one another; the kind is the number modulo 3."""
    kind = F.element_at(F.array(F.lit("girls"), F.lit("boys"), F.lit("mixed")), (F.pmod(C("boundary_id").try_cast("long"), F.lit(3)) + 1).cast("int"))
    s = assign.assign_nearest(_pairs(spark, d).withColumn("kind", kind), "txn_id", "boundary_id", kind="kind", apart=[("Girls", "boys")])
    return s.select("txn_id", "boundary_id", "kind", R(C("d_signed"), 4).alias("d_m"))


def assign_in_place(spark: SparkSession, d: str) -> DataFrame:
    s = assign.assign_in_place(_sales(spark, d), "easting", "northing", _circles(spark, d), key="urn", cx="cx", cy="cy", radius="radius_m", reach=REACH)
    return s.select("txn_id", C("urn").alias("boundary_id"), R(C("d_signed"), 4).alias("d_m")).distinct()


def near_counts(spark: SparkSession, d: str) -> DataFrame:
    g = _pairs(spark, d).where(F.abs("d_signed") < H).groupBy("txn_id").agg(F.count("*").alias("k"))
    return g.groupBy(C("k").alias("n_boundaries")).agg(F.count("*").alias("n_sales"))


def active_from(spark: SparkSession, d: str) -> DataFrame:
    """Pairs whose boundary is in force: its first entry year's 1 March is not after the sale."""
    first = table(spark, d, "boundary").select(C("urn").alias("boundary_id"), F.make_date(F.array_min(F.map_keys("radius_by_year")), F.lit(3), F.lit(1)).alias("since"))
    p = _pairs(spark, d).join(first, "boundary_id")
    live = p.withColumn("d_live", F.when(C("date") >= C("since"), C("d_signed")))
    return live.groupBy("boundary_id").agg(F.count("*").alias("n_pairs"), F.count("d_live").alias("n_active"))


def share_within(spark: SparkSession, d: str) -> DataFrame:
    s = _sample(spark, d)
    return s.groupBy("boundary_id").agg(F.count("*").alias("n"), *(F.sum((F.abs("d_signed") < m).cast("long")).alias(f"n_{m}m") for m in (25, 50)))


def polygon_distance(spark: SparkSession, d: str) -> DataFrame:
    p = assign.polygon_pairs(_sales(spark, d), "easting", "northing", table(spark, d, "boundary"), key="urn", wkt="polygon", reach=REACH)
    return p.select("txn_id", C("urn").alias("boundary_id"), R(C("d_signed"), 4).alias("d_m")).distinct()


def nearest_centre(spark: SparkSession, d: str) -> DataFrame:
    n = assign.nearest(_sales(spark, d), "easting", "northing", table(spark, d, "boundary"), target="urn", tx="easting", ty="northing")
    return n.select("easting", "northing", C("target").alias("urn"), R(C("distance"), 4).alias("distance_m"))


def nearest_three(spark: SparkSession, d: str) -> DataFrame:
    b = table(spark, d, "boundary").select("urn", "easting", "northing")
    n = assign.nearest(b, "easting", "northing", b, target="urn", tx="easting", ty="northing", k=3, cell=8000.0, other_than="urn")
    return n.select("urn", C("target").alias("neighbour"), C("rank").cast("long").alias("place"), R(C("distance"), 4).alias("distance_m"))


# ---- time and lineage


def _cut_offs(spark: SparkSession, d: str) -> DataFrame:
    b = table(spark, d, "boundary").select("urn", F.explode("radius_by_year").alias("entry_year", "radius")).where("radius is not null")
    return asof.history(b, "radius", C("urn"), F.make_date("entry_year", F.lit(3), F.lit(1)), C("radius"))


def yearly_radius(spark: SparkSession, d: str) -> DataFrame:
    """Signed distance to the line in force on the day of sale."""
    p = _pairs(spark, d).where("date is not null and radius_m is not null").select("txn_id", "boundary_id", "date", "d_signed", "radius_m")
    known = asof.as_of(p, "boundary_id", "date", {"radius": _cut_offs(spark, d)})
    return known.where("radius is not null").select("txn_id", "boundary_id", R(C("d_signed") - C("radius_m") + C("radius"), 4).alias("d_year_m"))


def _reports(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "ofsted_events").where("urn is not null and publication_date is not null and grade between 1 and 4")


def events_union(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "ofsted_events")
    sets = [{"key": "urn", "at": "publication_date", "grade": "grade"}, {"key": "urn", "at": "inspection_start", "grade": "grade"}, {"key": "urn", "at": "no_such_column"}]
    u = changes.project_events(e, sets, [{"kind": "published"}, {"kind": "inspected"}, {"kind": "none"}])
    return u.where("at is not null").groupBy("kind", "grade").agg(F.count("*").alias("n"))


def events_deduped(spark: SparkSession, d: str) -> DataFrame:
    e = changes.dedupe_events(_reports(spark, d), key="urn", at="publication_date", number="inspection_number", start="inspection_start", grade="grade", role_rank=(C("role") != "current").cast("int"), tie=["source", "event_id"])
    return e.select("event_id", "urn", "grade", C("conflict").alias("is_contested"))


def grade_history(spark: SparkSession, d: str) -> DataFrame:
    return changes.change_points(_reports(spark, d).select("urn", "publication_date", "event_id", "grade"), "urn", ["publication_date", "event_id"], "grade").select("event_id", "urn", "grade")


def lineage(spark: SparkSession, d: str) -> DataFrame:
    """Every school with itself and all its predecessors, those round a ring once each."""
    return changes.predecessors(_all_links(spark, d))


def lineage_grades(spark: SparkSession, d: str) -> DataFrame:
    """Grade in force for each boundary's school and its predecessors on every 1 March from 2015 to 2025, the day it was
    published and the school it was given to."""
    days = table(spark, d, "boundary").select("urn", F.explode(F.sequence(F.lit(2015), F.lit(2025))).alias("year")).withColumn("day", F.make_date("year", F.lit(3), F.lit(1)))
    lines = changes.predecessors(_all_links(spark, d))
    e = _reports(spark, d).where("role = 'current'").groupBy("urn", C("publication_date").cast("date").alias("on_day")).agg(F.max("grade").alias("grade"))
    held = changes.in_force(days, "urn", "day", e, lines, event_key="urn", event_at=C("on_day"), value="grade")
    return held.select("urn", "year", C("in_force.value").alias("grade"), C("in_force.at").alias("published_on"), C("in_force.source").alias("given_to"))


def _line_changes(spark: SparkSession, d: str) -> DataFrame:
    """Change points of the grade over each boundary school's whole line, from current reports."""
    lines = changes.with_own(changes.predecessors(_all_links(spark, d)), table(spark, d, "boundary").select("urn")).join(table(spark, d, "boundary").select(C("urn").alias("node")).distinct(), "node")
    return changes.line_history(_reports(spark, d).where("role = 'current'"), lines, event_key="urn", at=["publication_date", "event_id"], value="grade")


def line_changes(spark: SparkSession, d: str) -> DataFrame:
    return _line_changes(spark, d).select(C("node").alias("boundary_id"), "event_id", C("urn").alias("given_to"), "grade")


def line_starts(spark: SparkSession, d: str) -> DataFrame:
    """For every school with links: the first date of a link in its line, unless its furthest predecessor has none."""
    links = table(spark, d, "links_edubasealldata").select(strip_white(C("urn")).alias("urn"), F.try_to_timestamp("linkestablisheddate", F.lit("dd-MM-yyyy")).cast("date").alias("on_day")).where("on_day is not null")
    return changes.line_start(changes.predecessors(_all_links(spark, d)), links, "urn", "on_day").select("node", C("known").alias("is_known"), C("first").alias("first_day"))


def cutoff_stability(spark: SparkSession, d: str) -> DataFrame:
    y = table(spark, d, "provenance").where("cutoff_m is not null").groupBy("urn", "entry_year").agg(F.avg("cutoff_m").alias("r"))
    return y.groupBy("urn").agg(F.count("*").alias("n_years"), R(F.median("r"), 4).alias("median_m"), R(F.stddev_samp("r") / F.avg("r"), 6).alias("cv"))


def _provenance_marks(spark: SparkSession, d: str) -> DataFrame:
    """(prov_id, error): every rule that a row of the provenance breaks."""
    said = units.strict_metres(C("cutoff_as_published"))
    circle = C("route") == "reconstructed_radius"
    full = lambda c: F.coalesce(C(c), F.lit("")) != ""
    rules = [
        ("route", C("route").isin("reconstructed_radius", "published_polygon", "digitised")), ("status", C("status").isin("draft", "verified", "rejected")), ("year", C("entry_year").between(2015, 2025)),
        ("url", C("source_url").startswith("http")), ("distance", ~circle | said.isNotNull()), ("metres", ~circle | said.isNull() | (F.abs(said - C("cutoff_m")) <= 1.0 + 1e-5 * F.abs("cutoff_m"))),
        ("polygon", circle | full("polygon_file")), ("verifier", (C("status") != "verified") | (full("verified_by") & full("verified_on"))),
    ]
    return quality.errors(table(spark, d, "provenance"), "prov_id", rules, unique=["urn", "entry_year"])


def provenance_errors(spark: SparkSession, d: str) -> DataFrame:
    return _provenance_marks(spark, d).groupBy("error").agg(F.count("*").alias("n_rows"))


def first_errors(spark: SparkSession, d: str) -> DataFrame:
    """The first ten errors for a report: the kinds in falling order of their names, rows in rising order."""
    return _provenance_marks(spark, d).orderBy(F.desc("error"), "prov_id").limit(10)


def figures_rechecked(spark: SparkSession, d: str) -> DataFrame:
    """Each school and year of the provenance beside the boundary's own figure for that year: a left lookup."""
    own = table(spark, d, "boundary").select("urn", F.explode("radius_by_year").alias("entry_year", "radius"))
    p = table(spark, d, "provenance").where("status = 'verified'").groupBy("urn", "entry_year").agg(F.max("cutoff_m").alias("cutoff_m"))
    state = F.when(C("radius").isNull(), "absent").when(F.abs(C("radius") - C("cutoff_m")) <= 1, "same").otherwise("differs")
    return p.join(own, ["urn", "entry_year"], "left").groupBy(state.alias("state")).agg(F.count("*").alias("n_rows"))


def screen_table(spark: SparkSession, d: str) -> DataFrame:
    """Every school of the provenance with its boundary's figures and the sales on either side; those without figures say so."""
    log = table(spark, d, "provenance").groupBy("urn").agg(F.count("*").alias("n_rows"), F.count(F.when(C("status") == "verified", 1)).alias("n_verified"))
    j = log.join(table(spark, d, "boundary").select("urn", "radius_m", "n_years", "cv"), "urn", "left").join(side_counts(spark, d).withColumnRenamed("boundary_id", "urn"), "urn", "left")
    zero = lambda c: F.coalesce(C(c), F.lit(0)).cast("long").alias(c)
    return j.select("urn", "n_rows", "n_verified", "n_years", R(C("radius_m"), 3).alias("radius_m"), zero("n_inside"), zero("n_outside"), F.when(C("n_years").isNull(), "no figures").otherwise("figures").alias("state"))


def results_with_regions(spark: SparkSession, d: str) -> DataFrame:
    """Published results beside their boundaries: keys are unique on both sides, and none lacks its boundary, or it is an error."""
    results, areas = table(spark, d, "per_boundary").select("boundary_id", "n_obs", "tau"), table(spark, d, "boundary").select(C("urn").alias("boundary_id"), "route", "n_years")
    return quality.join_one_to_one(quality.assert_no_orphans(results, areas, ["boundary_id"]), areas, ["boundary_id"]).select("boundary_id", "route", "n_years", "n_obs", R(C("tau")).alias("tau"))


def result_ranges(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "per_boundary")
    return p.agg(F.countDistinct("boundary_id").alias("n_regions"), F.countDistinct("n_clusters").alias("n_cluster_counts"), F.min("n_obs").alias("least_rows"), F.max("n_obs").alias("most_rows"), R(F.min("tau")).alias("least_tau"), R(F.max("tau")).alias("greatest_tau"))


def label_numbers(spark: SparkSession, d: str) -> DataFrame:
    """The school's number in the label of a published result."""
    return table(spark, d, "per_boundary").select("boundary_id", F.nullif(F.regexp_extract("label", r"(\d{3,})", 1), F.lit("")).alias("number"))


def built_areas(spark: SparkSession, d: str) -> DataFrame:
    """Boundaries built from the verified rows of the provenance and the places of the boundaries' own table."""
    rows = table(spark, d, "provenance").where("status = 'verified' and cutoff_m is not null")
    known = table(spark, d, "boundary").select("urn", "easting", "northing")
    areas = assign.build_areas(rows.join(known.select("urn"), "urn", "left_semi"), known, key="urn", year="entry_year", radius="cutoff_m", route="route")
    return areas.select("urn", "route", "easting", "northing", R(C("radius"), 4).alias("radius_m"), C("n_years"), R(C("cv"), 6).alias("cv"))


def nearest_outside_line(spark: SparkSession, d: str) -> DataFrame:
    """The three nearest schools of each school that are not of its own line of predecessors."""
    b = table(spark, d, "boundary").select("urn", "easting", "northing")
    lines = changes.with_own(changes.predecessors(_all_links(spark, d)), b.select("urn")).join(b.select(C("urn").alias("node")), "node", "left_semi")
    n = assign.nearest_outside(b, b, lines, key="urn", x="easting", y="northing", k=3, cell=8000.0)
    return n.select("urn", C("target").alias("neighbour"), C("rank").cast("long").alias("place"), R(C("distance"), 4).alias("distance_m"))


def screen_failures(spark: SparkSession, d: str) -> DataFrame:
    rules = [("circle", C("radius_m").isNotNull()), ("years", C("n_years") >= 8), ("spread", C("cv") <= 0.2)]
    return quality.failures(table(spark, d, "boundary"), rules).select("urn", "first_fail", "all_fails")


def first_fails(spark: SparkSession, d: str) -> DataFrame:
    """How many boundaries fail first by each rule; PASS for those that fail none."""
    f = screen_failures(spark, d)
    return f.groupBy(F.coalesce(F.split("first_fail", ":")[0], F.lit("PASS")).alias("first_fail")).agg(F.count("*").alias("n"))


# ---- discontinuity

_MAIN = rd.Spec(h=H)


def rd_sides(spark: SparkSession, d: str) -> DataFrame:
    r = rd.side_intercepts(_sample(spark, d), _MAIN)
    return r.select(R(C("tau")).alias("tau"), R(C("inside_at_line")).alias("inside_at_line"), R(C("outside_at_line")).alias("outside_at_line"), "n_inside", "n_outside")


def rd_by_region(spark: SparkSession, d: str) -> DataFrame:
    r = rd.side_intercepts(_sample(spark, d), _MAIN, ["boundary_id"])
    return r.select("boundary_id", R(C("tau"), 5).alias("tau"), "n_inside", "n_outside")


def rd_plain_sweep(spark: SparkSession, d: str) -> DataFrame:
    s = _kept(spark, d)
    return quality.union_all([rd.side_intercepts(s, replace(_MAIN, h=h)).select(F.lit(h).alias("h_m"), R(C("tau")).alias("tau"), "n_inside", "n_outside") for h in GRID])


def rd_plain_donut(spark: SparkSession, d: str) -> DataFrame:
    s = _kept(spark, d)
    return quality.union_all([rd.side_intercepts(s, replace(_MAIN, donut=r)).select(F.lit(r).alias("donut_m"), R(C("tau")).alias("tau"), "n_inside", "n_outside") for r in battery.DONUT_M])


def rd_plain_placebo(spark: SparkSession, d: str) -> DataFrame:
    s = _kept(spark, d)
    return quality.union_all([rd.side_intercepts(s, replace(_MAIN, cutoff=c, side="inside" if c > 0 else "outside")).select(F.lit(c).alias("cutoff_m"), R(C("tau")).alias("tau"), "n_inside", "n_outside") for c in battery.PLACEBO_M])


def cell_moments(spark: SparkSession, d: str) -> DataFrame:
    m = rd.moments(_sample(spark, d), [replace(_MAIN, fe=("property_type", "year_quarter"))])
    return m.select("cluster", C("effects")[0].alias("fe_property_type"), C("effects")[1].alias("fe_year_quarter"), C("inside").alias("is_inside"), "n", *(R(C(c), 5).alias(c) for c in ("s0", "s1", "s2", "t0", "t1")))


def rd_main(spark: SparkSession, d: str) -> DataFrame:
    """The main fit, in percent and as an amount at the median price outside."""
    s = _kept(spark, d)
    level = s.where(F.abs("d_signed") < H).agg(F.median(F.when(C("d_signed") <= 0, C("price"))).alias("level")).collect()[0][0]
    j = rd.jump_table(spark, rd.fits(s, [replace(_MAIN, draws=9999, label="main")]))
    return j.withColumns({"median_price_outside": F.lit(level).cast("double")} | {f"amount{k}": amount(C(c), F.lit(level).cast("double")) for k, c in (("", "tau"), ("_low", "ci_low"), ("_high", "ci_high"))})


def rd_sweep(spark: SparkSession, d: str) -> DataFrame:
    """A fit per bandwidth; one that cannot run is a row without figures and with the reason as its note."""
    return rd.jump_table(spark, rd.sweep(_kept(spark, d), _MAIN, GRID))


def rd_forms(spark: SparkSession, d: str) -> DataFrame:
    """Quadratic form, own slopes, and further effects."""
    specs = [replace(_MAIN, poly=2, label="quadratic"), replace(_MAIN, slopes=True, label="own slopes"), replace(_MAIN, fe=(*_MAIN.fe, "tenure", "new_build"), label="more effects")]
    return rd.jump_table(spark, rd.fits(_kept(spark, d), specs))


def rd_leave_one_out(spark: SparkSession, d: str) -> DataFrame:
    return rd.jump_table(spark, rd.leave_one_out(_sample(spark, d), _MAIN))


_ALONE = replace(_MAIN, cluster="postcode", fe=("property_type", "year_quarter"))


def rd_per_region(spark: SparkSession, d: str) -> DataFrame:
    """A fit per boundary with errors clustered on postcodes; one that cannot run is a row with the reason."""
    return rd.by_group(_kept(spark, d), "boundary_id", _ALONE)


def rd_timing(spark: SparkSession, d: str) -> DataFrame:
    """Separate fits before and after each change of grade, errors clustered on postcodes."""
    return rd.by_group(cut(_halves(spark, d)), "part", _ALONE)


def _with_arcs(spark: SparkSession, s: DataFrame, d: str) -> DataFrame:
    """``octant`` (0 to 7) of the bearing from the boundary's centre, clockwise from north, and ``arc``, region and octant."""
    j = s.join(broadcast_if_small(_circles(spark, d).select(C("urn").alias("boundary_id"), "cx", "cy")), "boundary_id")
    octant = F.floor(F.pmod(F.degrees(F.atan2(C("easting") - C("cx"), C("northing") - C("cy"))), F.lit(360.0)) / 45).cast("long")
    return j.withColumn("octant", octant).withColumn("arc", F.concat_ws("_", "boundary_id", C("octant").cast("string")))


def rd_octants(spark: SparkSession, d: str) -> DataFrame:
    """The main fit and one with boundary octants as effects: of all regions, without the region of most sales, and of
    that region alone."""
    s = cut(_with_arcs(spark, _sample(spark, d), d))
    most = s.groupBy("boundary_id").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "boundary_id").limit(1).collect()
    arcs = ("property_type", "year_quarter", "arc")
    specs = [replace(_MAIN, label="main"), replace(_MAIN, fe=arcs, label="octants")]
    if most:
        this = C("boundary_id") == most[0]["boundary_id"]
        specs += [replace(x, where=[~this], label=f"{x.label}, without the region of most sales") for x in specs]
        specs += [replace(_ALONE, where=[this], label="region of most sales"), replace(_ALONE, fe=arcs, where=[this], label="region of most sales, octants")]
    return rd.jump_table(spark, rd.fits(s, specs))


def octant_counts(spark: SparkSession, d: str) -> DataFrame:
    return _with_arcs(spark, _pairs(spark, d), d).groupBy("boundary_id", "octant").agg(F.count("*").alias("n"))


def balance_jumps(spark: SparkSession, d: str) -> DataFrame:
    """Per boundary and outcome the jump, its p and the means of both sides."""
    s, outcomes = _kept(spark, d), ("log_price", "is_flat", "is_detached", "is_leasehold", "is_new_build", "imd19_rank")
    fe = lambda y: ("property_type", "year_quarter") if y == "log_price" else ("year_quarter",)
    jumps = quality.union_all([rd.by_group(s, "boundary_id", replace(_ALONE, outcome=y, fe=fe(y))).withColumn("outcome", F.lit(y)) for y in outcomes])
    near = s.where(F.abs("d_signed") < H).select("boundary_id", "d_signed", F.explode(F.array(*(F.struct(F.lit(y).alias("outcome"), C(y).cast("double").alias("v")) for y in outcomes))).alias("o"))
    side = lambda c: F.avg(F.when(c, C("o.v")))
    means = near.groupBy(C("boundary_id").alias("grp"), "o.outcome").agg(side(C("d_signed") > 0).alias("mean_inside"), side(C("d_signed") <= 0).alias("mean_outside"))
    return jumps.select("grp", "outcome", "tau", "p_value", "note").join(means, ["grp", "outcome"], "left")


def robustness(spark: SparkSession, d: str) -> DataFrame:
    s = _kept(spark, d)
    known = asof.as_of(s, "boundary_id", "date", {"radius": _cut_offs(spark, d)}).withColumn("d_year", C("d_signed") - C("radius_m") + C("radius"))
    return battery.run_all(cut(known), _MAIN, halves=cut(_halves(spark, d, s)))


def verdicts(spark: SparkSession, d: str) -> DataFrame:
    return battery.verdict(robustness(spark, d))


#: Window of the sales, and months that must lie on either side of a change of grade. Fixed values.
FIRST_DAY, LAST_DAY, MONTHS_EACH_SIDE = "2015-01-01", "2025-12-31", 24


def _grade_changes(spark: SparkSession, d: str) -> DataFrame:
    """(boundary_id, publication_date, name): changes of the grade over a school's line, far enough from both ends of the
    window, that differ from the grade in force the day before."""
    far = C("publication_date").between(F.add_months(F.lit(FIRST_DAY).cast("date"), MONTHS_EACH_SIDE).cast("timestamp_ntz"), F.add_months(F.lit(LAST_DAY).cast("date"), -MONTHS_EACH_SIDE).cast("timestamp_ntz"))
    h = _line_changes(spark, d).where(far).select(C("node").alias("boundary_id"), "publication_date", "grade", F.date_sub(C("publication_date").cast("date"), 1).alias("eve")).distinct()
    e = _reports(spark, d).where("role = 'current'").groupBy("urn", C("publication_date").cast("date").alias("on_day")).agg(F.max("grade").alias("grade"))
    was = changes.in_force(h, "boundary_id", "eve", e, changes.predecessors(_all_links(spark, d)), event_key="urn", event_at=C("on_day"), value="grade")
    name = F.concat_ws(" ", "boundary_id", C("in_force.value").cast("string"), F.lit("to"), C("grade").cast("string"), F.lit("on"), C("publication_date").cast("date").cast("string"))
    return was.where("in_force is not null and abs(in_force.value - grade) >= 1").select("boundary_id", "publication_date", name.alias("name")).distinct()


def _halves(spark: SparkSession, d: str, sample: DataFrame | None = None) -> DataFrame:
    """Sales before and after each change of grade that leaves two years of the window on either side."""
    return battery.timing_halves(_sample(spark, d) if sample is None else sample, _grade_changes(spark, d), "boundary_id", "publication_date", "name")


def timing(spark: SparkSession, d: str) -> DataFrame:
    t = _halves(spark, d)
    return t.groupBy("boundary_id", "change_at", "half").agg(F.count("*").alias("n_sales")).groupBy("boundary_id", "half").agg(F.sum("n_sales").alias("n_sales"))


# ---- densities and tables


def density_histogram(spark: SparkSession, d: str) -> DataFrame:
    return density.histogram(_sample(spark, d), "d_signed", battery.BIN_M)


def density_test(spark: SparkSession, d: str) -> DataFrame:
    r = density.density_step(_sample(spark, d), "d_signed", battery.BIN_M, H)
    return spark.createDataFrame([(r["step"], r["error"], r["p"], r["inside"], r["outside"], r["rows"], battery.BIN_M, H, r["reason"])], "theta double, se double, p_value double, f_inside double, f_outside double, n long, bin_m double, bandwidth_m double, note string")


def binned_means(spark: SparkSession, d: str) -> DataFrame:
    b = density.binned_means(_sample(spark, d).where(F.abs("d_signed") < H), "d_signed", "log_price", 50.0)
    return b.select("bin", "centre", R(C("mean")).alias("mean"), R(C("sd")).alias("sd"), "n")


def residual_bins(spark: SparkSession, d: str) -> DataFrame:
    s = _sample(spark, d).where(F.abs("d_signed") < H)
    b = density.binned_means(battery.residualised(s, "log_price", ["property_type", "year_quarter", "boundary_id"]), "d_signed", "log_price_res", 50.0)
    return b


def side_lines(spark: SparkSession, d: str) -> DataFrame:
    """The lines of either side through the residuals, with their band, every 25 m."""
    s = battery.residualised(_sample(spark, d).where(F.abs("d_signed") < H), "log_price", ["property_type", "year_quarter", "boundary_id"])
    return battery.side_lines(cut(s.select("d_signed", "boundary_id", "log_price_res")), "log_price_res", _MAIN, 25.0)


def plain_side_lines(spark: SparkSession, d: str) -> DataFrame:
    """The same through the prices themselves."""
    t = battery.side_lines(_kept(spark, d), "log_price", _MAIN, 100.0)
    return t.select("side", "x", *(R(C(c)).alias(c) for c in ("fitted", "low", "high")))


def median_outside(spark: SparkSession, d: str) -> DataFrame:
    s = _sample(spark, d).where(F.abs("d_signed") < H)
    return s.where("d_signed <= 0").groupBy("boundary_id").agg(F.median("price").alias("median_price"), F.count("*").alias("n"))


def pivot_sides(spark: SparkSession, d: str) -> DataFrame:
    s = _sample(spark, d).withColumn("side", F.when(C("d_signed") > 0, "inside").otherwise("outside"))
    return s.groupBy("boundary_id").pivot("side", ["inside", "outside"]).agg(F.count(F.lit(1))).na.fill(0, ["inside", "outside"])


def balance(spark: SparkSession, d: str) -> DataFrame:
    s = _sample(spark, d).where(F.abs("d_signed") < H).withColumn("is_inside", C("d_signed") > 0)
    return s.groupBy("boundary_id", "is_inside").agg(*(R(F.avg(c)).alias(f"mean_{c}") for c in ("is_flat", "is_detached", "is_leasehold", "is_new_build")))


def regions_without_sales(spark: SparkSession, d: str) -> DataFrame:
    b = table(spark, d, "boundary").select(C("urn").alias("boundary_id"))
    return b.join(_pairs(spark, d).select("boundary_id").distinct(), "boundary_id", "left_anti")


def content_digest(spark: SparkSession, d: str) -> DataFrame:
    return quality.content_digest(table(spark, d, "sales"))


def stream_windows(spark: SparkSession, d: str) -> DataFrame:
    """Sales per 30 days as a stream gives them: windows that the watermark, 60 days behind the latest sale, has closed.
    The stream takes what is there, with its state and output in the shared folder, and stops."""
    at = f"{ensure_checkpoint_dir(spark)}/streams/{uuid.uuid4()}"
    counts = ingest.windowed_counts(ingest.stream_table(spark, d, "sales", files_per_trigger=100_000), "date")
    ingest.drain(counts, f"{at}/out", f"{at}/state")
    return spark.read.schema(counts.schema).parquet(f"{at}/out").select(C("window.start").cast("date").alias("first_day"), C("n").alias("n_sales"), C("total").cast("long").alias("total"))


def stream_first_delivery(spark: SparkSession, d: str) -> DataFrame:
    """The batch counterpart of the streaming ingest: the first delivery of each sale, by loading time."""
    p = table(spark, d, "pp_geo")
    first = p.groupBy("txn_id").agg(F.min("loaded_at").alias("first_loaded"), F.count("*").alias("n_deliveries"))
    return first.groupBy(F.date_trunc("month", "first_loaded").cast("date").alias("month")).agg(F.count("*").alias("n_sales"), F.sum("n_deliveries").alias("n_deliveries"))


QUERIES = {
    f.__name__: f
    for f in (
        step_log, geo_steps, duplicate_postcodes, postcode_forms, match_audit, region_box, quarter_counts, indicator_sums, strict_distance, link_years, event_props, candidate_pairs, side_counts,
        assign_nearest, assign_compatible, assign_in_place, near_counts, active_from, share_within, polygon_distance, nearest_centre, nearest_three, yearly_radius, events_union, events_deduped, grade_history,
        lineage, lineage_grades, line_changes, line_starts, cutoff_stability, provenance_errors, first_errors, figures_rechecked, screen_table, results_with_regions, result_ranges, label_numbers, built_areas, nearest_outside_line, screen_failures, first_fails, rd_sides, rd_by_region, rd_plain_sweep, rd_plain_donut, rd_plain_placebo, cell_moments, rd_main, rd_sweep, rd_forms,
        rd_leave_one_out, rd_per_region, rd_timing, rd_octants, octant_counts, balance_jumps, robustness, verdicts, timing, density_histogram, density_test, binned_means, residual_bins, side_lines, plain_side_lines, median_outside, pivot_sides,
        balance, regions_without_sales, content_digest, stream_windows, stream_first_delivery,
    )
}
