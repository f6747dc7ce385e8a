"""Queries p1 to p7 (without p4, which is in the llm subpackage): data problems of the domain tables, each through its operator, over whole tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terrane.functions.text import WHITE, strip_white, year_quarter
from terrane.operators import asof, hierarchy, integrity, records, regions, units
from terrane.sources.tables import table

C = F.col


def _distance(e: str, n: str, x: str, y: str) -> Column:
    return F.sqrt((C(e) - C(x)) * (C(e) - C(x)) + (C(n) - C(y)) * (C(n) - C(y)))


# ---- p1: references to records that do not exist


def _references(spark: SparkSession, d: str) -> DataFrame:
    return integrity.reference_status(
        table(spark, d, "pp_geo"), table(spark, d, "onspd"), ref_key=C("postcode_norm"), ref_period=F.date_format("date", "yyyyMM"),
        parent_key=C("postcode_key"), parent_from=C("dointr"), parent_to=C("doterm"), carry={"txn_id": C("txn_id"), "quarter": year_quarter(C("date"))}, spread=C("txn_id"),
    )


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return integrity.orphans(_references(spark, d)).select("txn_id").distinct()


def p1_report(spark: SparkSession, d: str) -> DataFrame:
    return integrity.orphan_report(_references(spark, d), "pp_geo", C("quarter"))


# ---- p2: quantities recorded in different units


def p2_metres(spark: SparkSession, d: str) -> DataFrame:
    out = units.reconcile_distances(table(spark, d, "provenance"), published="cutoff_as_published", metres="cutoff_m", texts=["source_title", "notes"])
    return out.select("prov_id", "units_of").where("units_of.metres is not null").select("prov_id", "units_of.metres", "units_of.unit", C("units_of.source").alias("unit_source"), C("units_of.unique").alias("is_unique"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    out = units.reconcile_distances(table(spark, d, "provenance"), published="cutoff_as_published", metres="cutoff_m", texts=["source_title", "notes"])
    return out.where("units_of.wrong").select("prov_id").distinct()


# ---- p3: points in regions


def circles(spark: SparkSession, d: str, radius: Column, *more: Column) -> DataFrame:
    """Centres beside their regions: (region, cx, cy, ...) and the edges of circles of the given radius."""
    return table(spark, d, "boundary").select(C("urn"), C("easting").alias("cx"), C("northing").alias("cy"), radius.alias("reach"), *more)


def sales_within(spark: SparkSession, d: str, centres: DataFrame, *cols: str) -> DataFrame:
    """(sale columns, region, distance, on_boundary) by crossing parity, joined to the centres for an exact test."""
    sales = table(spark, d, "sales").select("txn_id", C("easting").alias("e"), C("northing").alias("n"), *cols)
    edges = regions.circle_edges(centres, "urn", "cx", "cy", C("reach"))
    inside = regions.points_in_regions(sales, C("e"), C("n"), edges)
    return inside.join(centres, inside.region == centres.urn).withColumn("distance", _distance("e", "n", "cx", "cy"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    near = sales_within(spark, d, circles(spark, d, C("radius_m")))
    return near.where("distance < reach").select("txn_id", "urn").distinct()


def p3_regions(spark: SparkSession, d: str) -> DataFrame:
    """Sales inside the drawn areas (polygons); sales on an outline are left out."""
    edges = regions.polygon_edges(table(spark, d, "boundary"), "urn", "polygon")
    sales = table(spark, d, "sales").select("txn_id", "easting", "northing")
    inside = regions.points_in_regions(sales, C("easting"), C("northing"), edges)
    return inside.where("not on_boundary").select("txn_id", C("region").alias("urn")).distinct()


# ---- p5: rows that fail to parse


def _parsed(spark: SparkSession, d: str) -> DataFrame:
    return records.parse_records(table(spark, d, "pp_raw"), "line_id", "raw")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return records.split_records(_parsed(spark, d))[1].select("line_id").distinct()


def p5_valid(spark: SparkSession, d: str) -> DataFrame:
    return records.split_records(_parsed(spark, d))[0]


def p5_reasons(spark: SparkSession, d: str) -> DataFrame:
    return records.split_records(_parsed(spark, d))[1].select("line_id", "reason")


# ---- p6: attributes as known at event time


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    b = table(spark, d, "boundary").select("urn", "easting", "northing", "radius_by_year")
    cut_offs = b.select("urn", F.explode("radius_by_year").alias("entry_year", "radius")).where("entry_year between 1 and 9999")
    reports = table(spark, d, "ofsted_events").where("role = 'current' and grade between 1 and 4")
    histories = {
        "cut_off": asof.history(cut_offs.where("radius is not null"), "cut_off", C("urn"), F.make_date("entry_year", F.lit(3), F.lit(1)), F.struct("entry_year", "radius")),
        "report": asof.history(reports, "report", C("urn"), C("publication_date").cast("date"), C("event_id"), [C("inspection_start")]),
    }
    reach = F.array_max(F.map_values("radius_by_year"))
    near = sales_within(spark, d, circles(spark, d, reach), "date").where("date is not null and distance < reach")
    known = asof.as_of(near.select("txn_id", "urn", "date", "distance"), "urn", "date", histories)
    return known.where("distance < cut_off.radius").select("txn_id", "urn", C("cut_off.entry_year").alias("entry_year"), F.coalesce("report", F.lit(0).cast("long")).alias("event_id")).distinct()


# ---- p7: hierarchies


def _all_links(spark: SparkSession, d: str) -> DataFrame:
    """(child, parent) of every row, repeats and several parents of one child included."""
    kind = F.lower(strip_white(C("linktype")))
    a, b = strip_white(C("urn")), strip_white(C("linkurn"))
    rows = table(spark, d, "links_edubasealldata").select(a.alias("a"), b.alias("b"), kind.alias("kind")).where("a <> '' and b <> '' and (kind like 'predecessor%' or kind like 'successor%')")
    back = C("kind").startswith("predecessor")
    return rows.select(F.when(back, C("a")).otherwise(C("b")).alias("child"), F.when(back, C("b")).otherwise(C("a")).alias("parent"))


def _links(spark: SparkSession, d: str) -> DataFrame:
    return hierarchy.single_parents(_all_links(spark, d), C("child"), C("parent"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    t = hierarchy.hierarchy(_links(spark, d), paths=False)
    return t.select(C("node").alias("urn"), F.coalesce("root", F.lit("cycle")).alias("root_urn"), F.coalesce("depth", F.lit(-1)).cast("int").alias("depth"))


def p7_paths(spark: SparkSession, d: str) -> DataFrame:
    t = hierarchy.hierarchy(_links(spark, d))
    return t.where("not ring").select(C("node").alias("urn"), F.array_join("path", " > ").alias("path"))


def p7_descendants(spark: SparkSession, d: str) -> DataFrame:
    return hierarchy.descendants(hierarchy.hierarchy(_links(spark, d)))


def p7_other_parents(spark: SparkSession, d: str) -> DataFrame:
    """Links that the trees leave out, as their child has a lesser parent as well."""
    return hierarchy.other_parents(_all_links(spark, d), C("child"), C("parent"))


QUERIES = {f.__name__: f for f in (p1_found, p1_report, p2_found, p2_metres, p3_found, p3_regions, p5_found, p5_valid, p5_reasons, p6_found, p7_found, p7_paths, p7_descendants, p7_other_parents)}

# ---- the same in DuckDB's SQL



def _key(c: str) -> str:
    return f"upper(regexp_replace({c}, '[{WHITE}]+', '', 'g'))"


def _trim(c: str) -> str:
    return f"regexp_replace({c}, '^[{WHITE}]+|[{WHITE}]+$', '', 'g')"


_F = '(?:"(?:[^"]|"")*"|[^",\\r\\n]*)'


def _either(rx: str) -> str:
    return f'(?:{rx}|"{rx}")'


_PRICE = _either(" *0*[1-9][0-9]* *")
_DATE = _either(" *([0-9]{4}-[0-9]{2}-[0-9]{2})(?: (?:[01][0-9]|2[0-3]):[0-5][0-9])? *")
_CODE = _either("(?:[ \\t]*|[ \\t]*[A-Za-z]{1,2}[0-9][0-9A-Za-z]? *[0-9][A-Za-z]{2}[ \\t]*)")
_VALID = f"{_F},{_PRICE},{_DATE},{_CODE}" + f",{_F}" * 12
_TREE = f"""
WITH RECURSIVE r AS (SELECT {_trim("urn")} a, {_trim("linkurn")} b, lower({_trim("linktype")}) k FROM links_edubasealldata),
e AS (SELECT child, min(parent) parent FROM (
  SELECT CASE WHEN k LIKE 'predecessor%' THEN a ELSE b END child, CASE WHEN k LIKE 'predecessor%' THEN b ELSE a END parent
  FROM r WHERE a <> '' AND b <> '' AND (k LIKE 'predecessor%' OR k LIKE 'successor%')) GROUP BY child),
n AS (SELECT child u FROM e UNION SELECT parent FROM e),
t AS (SELECT u, u AS root, 0 AS depth, u AS path FROM n WHERE u NOT IN (SELECT child FROM e)
  UNION ALL SELECT e.child, t.root, t.depth + 1, t.path || ' > ' || e.child FROM t JOIN e ON e.parent = t.u)
"""

def _said() -> str:
    """The published figure in plain words and digits, with a space between a figure and its unit."""
    s = "lower(cutoff_as_published)"
    for mark, ascii_ in units.FRACTIONS:
        s = f"replace({s}, '{mark}', '{ascii_}')"
    s = f"trim(regexp_replace(translate({s}, '·\u00a0\u2009\u202f', '.   '), '\\s+', ' ', 'g'))"
    for words, digits in units.WORDS:
        s = f"regexp_replace({s}, '\\b{words}\\b( ?(?:mile|mi\\b|kilomet|km|met(?:re|er)|mtr|yard|yd|f(?:oo|ee)?t\\b))', '{digits}\\1', 'g')"
    return f"regexp_replace({s}, '(\\d)([a-z])', '\\1 \\2', 'g')"


_UNIT = units.UNIT + r"\b"
_FIGURE = r"(\.?\d[\d.,]*(?: \d{3}\b)*(?:\.\d+)?)"
_FRAC, _PAIR, _ONE = rf"^\D*?(?:(\d+) )?(\d+)/(\d+)(?: {_UNIT})?", rf"^\D*?{_FIGURE} {_UNIT}(?: and)? {_FIGURE} {_UNIT}", rf"^\D*?{_FIGURE}(?: {_UNIT})?"


def _metres(u: str) -> str:
    return f"(CASE WHEN {u} ~ '^(of a )?mi.*' THEN 1609.344::DOUBLE WHEN {u} LIKE 'k%' THEN 1000.0::DOUBLE WHEN {u} LIKE 'y%' THEN 0.9144::DOUBLE WHEN {u} LIKE 'f%' THEN 0.3048::DOUBLE WHEN {u} LIKE 'm%' THEN 1.0::DOUBLE END)"


def _value(x: str) -> str:
    x = f"rtrim({x}, '.,')"
    return f"try_cast(CASE WHEN regexp_full_match({x}, '[1-9]\\d{{0,2}}([, ]\\d{{3}})+(\\.\\d+)?') THEN replace(replace({x}, ',', ''), ' ', '') ELSE replace(replace({x}, ' ', ''), ',', '.') END AS DOUBLE)"


def _named(c: str) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches(lower({c}), '{rx}') THEN '{unit}'" for unit, rx in units.NAMED) + " END"


SQL = {
    "p2_found": f"""
WITH a AS (SELECT prov_id, cutoff_m::DOUBLE stored, {_said()} s, coalesce({_named("source_title")}, {_named("notes")}) named FROM provenance WHERE cutoff_m IS NOT NULL AND NOT isnan(cutoff_m)),
k AS (SELECT *, CASE WHEN regexp_matches(s, '{units.INEXACT}') THEN 'none' WHEN regexp_matches(s, '{_FRAC}') THEN 'frac' WHEN regexp_matches(s, '{_PAIR}') THEN 'pair' WHEN regexp_matches(s, '{_ONE}') THEN 'num' ELSE 'none' END kind FROM a),
p AS (SELECT *, CASE kind WHEN 'frac' THEN coalesce(try_cast(nullif(regexp_extract(s, '{_FRAC}', 1), '') AS DOUBLE), 0) + try_cast(regexp_extract(s, '{_FRAC}', 2) AS DOUBLE) / nullif(try_cast(regexp_extract(s, '{_FRAC}', 3) AS DOUBLE), 0)
    WHEN 'pair' THEN {_value(f"regexp_extract(s, '{_PAIR}', 1)")} WHEN 'num' THEN {_value(f"regexp_extract(s, '{_ONE}', 1)")} END f,
  CASE WHEN kind = 'num' AND regexp_full_match(rtrim(regexp_extract(s, '{_ONE}', 1), '.,'), '[1-9]\\d{{0,2}},\\d{{3}}') THEN try_cast(replace(rtrim(regexp_extract(s, '{_ONE}', 1), '.,'), ',', '.') AS DOUBLE) END f2,
  coalesce(nullif(CASE kind WHEN 'frac' THEN regexp_extract(s, '{_FRAC}', 4) WHEN 'pair' THEN regexp_extract(s, '{_PAIR}', 2) WHEN 'num' THEN regexp_extract(s, '{_ONE}', 2) END, ''), named) u,
  CASE WHEN kind = 'pair' THEN {_value(f"regexp_extract(s, '{_PAIR}', 3)")} END x, CASE WHEN kind = 'pair' THEN regexp_extract(s, '{_PAIR}', 4) END ux FROM k),
m AS (SELECT prov_id, stored, f * {_metres("u")} + coalesce(CASE WHEN {_metres("ux")} < {_metres("u")} THEN x * {_metres("ux")} END, 0) m1, CASE WHEN {_metres("u")} >= 1000 THEN f2 * {_metres("u")} END m2 FROM p)
SELECT DISTINCT prov_id FROM m WHERE abs(stored - CASE WHEN stored > 0 AND m1 > 0 AND m2 > 0 AND abs(ln(m2 / stored)) < abs(ln(m1 / stored)) THEN m2 ELSE m1 END) > 1""",
    "p1_found": f"""
WITH p AS (SELECT DISTINCT {_key("postcode_key")} k, dointr a, nullif(doterm, '') b FROM onspd),
g AS (SELECT txn_id, {_key("postcode_norm")} k, strftime(date, '%Y%m') m FROM pp_geo)
SELECT DISTINCT txn_id FROM g WHERE k <> '' AND NOT EXISTS (SELECT 1 FROM p WHERE p.k = g.k AND p.a <= g.m AND (p.b IS NULL OR g.m <= p.b))""",
    "p1_report": f"""
WITH p AS (SELECT {_key("postcode_key")} k, list(DISTINCT {{'a': dointr, 'b': nullif(doterm, '')}}) s FROM onspd GROUP BY 1),
g AS (SELECT {_key("postcode_norm")} k, strftime(date, '%Y%m') m, year(date) || 'Q' || quarter(date) q FROM pp_geo),
j AS (SELECT g.q, g.m, p.s, len(list_filter(s, lambda x: x.a <= g.m AND (x.b IS NULL OR g.m <= x.b))) ok,
  len(list_filter(s, lambda x: x.b < g.m AND x.a IS NOT NULL)) gone, len(list_filter(s, lambda x: x.a > g.m)) later FROM g LEFT JOIN p ON p.k = g.k WHERE g.k <> '')
SELECT 'pp_geo' AS table_name, q AS period, CASE WHEN s IS NULL THEN 'missing' WHEN m IS NULL THEN 'undated' WHEN gone > 0 THEN 'deleted' WHEN later > 0 THEN 'late' ELSE 'undated' END AS status,
  count(*) AS n_refs FROM j WHERE s IS NULL OR m IS NULL OR ok = 0 GROUP BY 1, 2, 3""",
    "p3_found": """
SELECT DISTINCT s.txn_id, b.urn FROM sales s, boundary b WHERE b.radius_m IS NOT NULL AND NOT isnan(s.easting) AND NOT isnan(s.northing)
AND sqrt((s.easting - b.easting) * (s.easting - b.easting) + (s.northing - b.northing) * (s.northing - b.northing)) < b.radius_m""",
    "p3_regions": """
WITH p AS (SELECT urn, list_transform(string_split(regexp_extract(polygon, '\\(\\(([^()]+)\\)', 1), ', '), lambda q: [string_split(q, ' ')[1]::DOUBLE, string_split(q, ' ')[2]::DOUBLE]) v FROM boundary WHERE polygon IS NOT NULL),
e AS (SELECT urn, unnest(range(1, len(v))) i, v FROM p),
k AS (SELECT urn, v[i][1] x1, v[i][2] y1, v[i + 1][1] x2, v[i + 1][2] y2 FROM e),
s AS (SELECT DISTINCT txn_id, easting x, northing y FROM sales WHERE easting IS NOT NULL AND northing IS NOT NULL AND NOT isnan(easting) AND NOT isnan(northing))
SELECT DISTINCT txn_id, urn FROM (SELECT txn_id, x, y, urn FROM s, k GROUP BY ALL HAVING count(*) FILTER (WHERE (y1 > y) <> (y2 > y) AND x < x1 + (y - y1) * (x2 - x1) / (y2 - y1)) % 2 = 1)""",
    "p5_found": f"""
SELECT line_id FROM pp_raw WHERE NOT coalesce(regexp_full_match(rtrim(raw, chr(13) || chr(10)), '{_VALID}')
  AND try_cast(concat(regexp_extract(rtrim(raw, chr(13) || chr(10)), '^{_VALID}$', 1), regexp_extract(rtrim(raw, chr(13) || chr(10)), '^{_VALID}$', 2)) AS DATE) IS NOT NULL, false)""",
    "p5_valid": f"""
WITH v AS (SELECT line_id, rtrim(raw, chr(13) || chr(10)) x FROM pp_raw WHERE coalesce(regexp_full_match(rtrim(raw, chr(13) || chr(10)), '{_VALID}'), false)
  AND try_cast(concat(regexp_extract(rtrim(raw, chr(13) || chr(10)), '^{_VALID}$', 1), regexp_extract(rtrim(raw, chr(13) || chr(10)), '^{_VALID}$', 2)) AS DATE) IS NOT NULL),
f AS (SELECT line_id, list_transform(regexp_extract_all(',' || x, ',("(?:[^"]|"")*"|[^,"]*)', 1), lambda y: CASE WHEN y LIKE '"%' THEN replace(substr(y, 2, length(y) - 2), '""', '"') ELSE y END) f FROM v)
SELECT line_id, {", ".join(f"f[{i + 1}] AS {n}" for i, n in enumerate(records.FIELDS) if n not in ("price", "date", "postcode"))}, try_cast(trim(f[2]) AS BIGINT) AS price,
  coalesce(try_strptime(trim(f[3]), '%Y-%m-%d %H:%M'), try_strptime(trim(f[3]), '%Y-%m-%d'))::TIMESTAMP AS date, nullif(upper(trim(f[4], ' ' || chr(9))), '') AS postcode FROM f""",
    "p6_found": """
WITH s AS (SELECT DISTINCT txn_id, date, easting, northing FROM sales WHERE date IS NOT NULL AND easting IS NOT NULL AND northing IS NOT NULL AND NOT isnan(easting) AND NOT isnan(northing)),
c AS (SELECT urn, easting be, northing bn, unnest(map_entries(radius_by_year)) m FROM boundary),
h AS (SELECT urn, be, bn, m.key y, m.value r FROM c WHERE m.value IS NOT NULL),
i AS (SELECT urn, be, bn, y, r, make_date(y, 3, 1) a, lead(make_date(y, 3, 1)) OVER (PARTITION BY urn ORDER BY y) z FROM h),
f AS (SELECT s.txn_id, s.date, i.urn, i.y FROM s JOIN i ON s.date >= i.a AND (i.z IS NULL OR s.date < i.z) WHERE sqrt((s.easting - be) * (s.easting - be) + (s.northing - bn) * (s.northing - bn)) < i.r),
o AS (SELECT urn, publication_date, inspection_start, event_id FROM ofsted_events WHERE role = 'current' AND grade BETWEEN 1 AND 4 AND publication_date IS NOT NULL)
SELECT DISTINCT f.txn_id, f.urn, f.y AS entry_year, coalesce((SELECT event_id FROM o WHERE o.urn = f.urn AND o.publication_date::DATE <= f.date ORDER BY publication_date::DATE DESC, inspection_start DESC NULLS LAST, event_id DESC LIMIT 1), 0) AS event_id FROM f""",
    "p7_found": _TREE + "SELECT n.u AS urn, coalesce(t.root, 'cycle') AS root_urn, coalesce(t.depth, -1)::INT AS depth FROM n LEFT JOIN t ON t.u = n.u",
    "p7_other_parents": f"""
WITH r AS (SELECT {_trim("urn")} a, {_trim("linkurn")} b, lower({_trim("linktype")}) k FROM links_edubasealldata),
l AS (SELECT DISTINCT CASE WHEN k LIKE 'predecessor%' THEN a ELSE b END child, CASE WHEN k LIKE 'predecessor%' THEN b ELSE a END parent FROM r WHERE a <> '' AND b <> '' AND (k LIKE 'predecessor%' OR k LIKE 'successor%'))
SELECT child, parent, kept FROM (SELECT *, min(parent) OVER (PARTITION BY child) kept FROM l) WHERE parent <> kept""",
    "p7_paths": _TREE + "SELECT u AS urn, path FROM t",
    "p7_descendants": _TREE + ", d AS (SELECT parent AS ancestor, child AS descendant, 1 AS distance FROM e WHERE child IN (SELECT u FROM t) UNION ALL SELECT d.ancestor, e.child, d.distance + 1 FROM d JOIN e ON e.parent = d.descendant) SELECT ancestor, descendant, distance::INT AS distance FROM d",
}
