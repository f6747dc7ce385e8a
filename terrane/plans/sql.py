"""The catalogue's queries in DuckDB's SQL."""

from __future__ import annotations

from terrane.plans.problems import _trim

_OK = "easting IS NOT NULL AND northing IS NOT NULL AND NOT isnan(easting) AND NOT isnan(northing)"
_FORM = "CASE WHEN length({0}) >= 5 THEN substr({0}, 1, length({0}) - 3) || ' ' || right({0}, 3) END"


def _form(c: str) -> str:
    return _FORM.format(f"upper(regexp_replace(coalesce({c}, ''), '\\s+', '', 'g'))")


_SALES = f"s AS (SELECT DISTINCT txn_id, price, date, year_quarter, postcode, property_type, tenure, new_build, imd19_rank, easting, northing FROM sales WHERE {_OK})"
_CIRCLE = """SELECT * FROM (SELECT s.*, b.urn AS boundary_id, b.radius_m, b.easting AS cx, b.northing AS cy,
  b.radius_m - sqrt((s.easting - b.easting) * (s.easting - b.easting) + (s.northing - b.northing) * (s.northing - b.northing)) AS d FROM s, boundary b WHERE b.radius_m IS NOT NULL) WHERE abs(d) < 750"""
_EDGES = """outline AS (SELECT urn, radius_m, easting cx, northing cy, list_transform(string_split(regexp_extract(polygon, '\\(\\(([^()]+)\\)', 1), ', '), lambda q: [string_split(q, ' ')[1]::DOUBLE, string_split(q, ' ')[2]::DOUBLE]) v FROM boundary WHERE polygon IS NOT NULL),
edge AS (SELECT urn, radius_m, cx, cy, v[i][1] x1, v[i][2] y1, v[i + 1][1] x2, v[i + 1][2] y2 FROM (SELECT *, unnest(range(1, len(v))) i FROM outline)),
box AS (SELECT urn, min(x1) - 750 a, max(x1) + 750 b, min(y1) - 750 c, max(y1) + 750 d FROM edge GROUP BY urn)"""
_DRAWN = """drawn AS (SELECT s.*, g.urn AS boundary_id, g.radius_m, g.cx, g.cy, min(sqrt((s.easting - (x1 + t * (x2 - x1))) * (s.easting - (x1 + t * (x2 - x1))) + (s.northing - (y1 + t * (y2 - y1))) * (s.northing - (y1 + t * (y2 - y1))))) m,
  count(*) FILTER (WHERE (y1 > s.northing) <> (y2 > s.northing) AND s.easting < x1 + (s.northing - y1) * (x2 - x1) / (y2 - y1)) k
  FROM s JOIN box ON s.easting BETWEEN a AND b AND s.northing BETWEEN c AND box.d JOIN edge g ON g.urn = box.urn,
  LATERAL (SELECT greatest(0.0, least(1.0, ((s.easting - x1) * (x2 - x1) + (s.northing - y1) * (y2 - y1)) / ((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1)))) t) WHERE x1 <> x2 OR y1 <> y2 GROUP BY ALL)"""
PAIRS = f"""
{_SALES},
{_EDGES},
{_DRAWN},
pairs AS ({_CIRCLE} UNION ALL SELECT * EXCLUDE (m, k), CASE WHEN k % 2 = 1 THEN m ELSE -m END AS d FROM drawn WHERE m < 750 AND radius_m IS NULL)"""


def _assigned(pairs: str, inside: str = "n_in") -> str:
    return (
        pairs
        + f""",
w AS (SELECT *, sum(CASE WHEN d > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY txn_id) n_in, sum(CASE WHEN abs(d) < 400 THEN 1 ELSE 0 END) OVER (PARTITION BY txn_id) n_near,
  sum(CASE WHEN d > 0 AND boundary_id::BIGINT % 3 = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY txn_id) n_0, sum(CASE WHEN d > 0 AND boundary_id::BIGINT % 3 = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY txn_id) n_1 FROM pairs),
assigned AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY txn_id ORDER BY abs(d), boundary_id) k FROM w WHERE d > 0 OR {inside} = 0) WHERE k = 1),
sample AS (SELECT *, ln(price) AS y FROM assigned WHERE price > 0 AND date IS NOT NULL)"""
    )


ASSIGNED = _assigned(PAIRS)
#: Links (child, parent), every school's line upwards by all simple ways, and the least steps to each ancestor.
LINES = f"""
WITH RECURSIVE r AS (SELECT {_trim("urn")} a, {_trim("linkurn")} b, lower({_trim("linktype")}) k FROM links_edubasealldata),
e AS (SELECT DISTINCT CASE WHEN k LIKE 'predecessor%' THEN a ELSE b END child, CASE WHEN k LIKE 'predecessor%' THEN b ELSE a END parent FROM r WHERE a <> '' AND b <> '' AND (k LIKE 'predecessor%' OR k LIKE 'successor%')),
u AS (SELECT n AS node, n AS ancestor, 0::BIGINT AS steps, [n] AS way FROM (SELECT child n FROM e UNION SELECT parent FROM e)
  UNION ALL SELECT u.node, e.parent, u.steps + 1, list_append(u.way, e.parent) FROM u JOIN e ON e.child = u.ancestor WHERE NOT list_contains(u.way, e.parent)),
lines AS (SELECT node, ancestor, min(steps) AS steps FROM u GROUP BY 1, 2)"""
_OWN_LINES = "l AS (SELECT * FROM lines UNION ALL SELECT urn, urn, 0 FROM boundary WHERE urn NOT IN (SELECT node FROM lines))"
_BY_DAY = "g AS (SELECT urn, publication_date::DATE t, max(grade) grade FROM ofsted_events WHERE role = 'current' AND urn IS NOT NULL AND publication_date IS NOT NULL AND grade BETWEEN 1 AND 4 GROUP BY 1, 2)"
_CHANGES = f"""{_OWN_LINES},
m AS (SELECT l.node, l.steps, o.* FROM l JOIN ofsted_events o ON o.urn = l.ancestor WHERE l.node IN (SELECT urn FROM boundary) AND o.publication_date IS NOT NULL AND o.grade BETWEEN 1 AND 4 AND o.role = 'current'),
ch AS (SELECT * FROM (SELECT *, lag(grade) OVER (PARTITION BY node ORDER BY publication_date, steps, event_id) was, row_number() OVER (PARTITION BY node ORDER BY publication_date, steps, event_id) i FROM m) WHERE i = 1 OR grade IS DISTINCT FROM was)"""


def _sides(x: str, where: str, h: str, keys: str = "", by: str = "") -> str:
    """Intercepts of both sides by weighted least squares in closed form; keys end in a comma."""
    return f"""
f AS (SELECT {keys} {x} AS x, y, 1 - abs({x}) / {h} AS w FROM sample{by} WHERE {where} AND abs({x}) < {h}),
g AS (SELECT {keys} x > 0 AS i, sum(w) s0, sum(w * x) s1, sum(w * x * x) s2, sum(w * y) t0, sum(w * x * y) t1, count(*) n FROM f GROUP BY ALL),
a AS (SELECT *, CASE WHEN s0 * s2 - s1 * s1 > 1e-9 * s0 * s2 THEN (s2 * t0 - s1 * t1) / (s0 * s2 - s1 * s1) END AS a FROM g),
r AS (SELECT {keys} max(a) FILTER (WHERE i) AS inside_at_line, max(a) FILTER (WHERE NOT i) AS outside_at_line, coalesce(sum(n) FILTER (WHERE i), 0)::BIGINT AS n_inside, coalesce(sum(n) FILTER (WHERE NOT i), 0)::BIGINT AS n_outside FROM a GROUP BY ALL)"""


_TAU = "round(inside_at_line - outside_at_line, {}) + 0.0::DOUBLE AS tau"
_GRID = "(SELECT unnest(generate_series(100, 750, 50))::DOUBLE AS h_m)"


def _per(values: str, name: str) -> str:
    return f" , (SELECT unnest([{values}])::DOUBLE AS {name})"


_SAID = "lower(cutoff_as_published)"
_METRES = f"""(CASE WHEN regexp_matches({_SAID}, '^\\s*([\\d,]*\\.?\\d+)\\s*(m|metres|meters|kms?|miles?|of a mile)\\s*$') THEN replace(regexp_extract({_SAID}, '([\\d,]*\\.?\\d+)', 1), ',', '')::DOUBLE
  * CASE WHEN {_SAID} LIKE '%k%' THEN 1000.0::DOUBLE WHEN {_SAID} LIKE '%mile%' THEN 1609.344::DOUBLE ELSE 1.0::DOUBLE END END)"""
_MARKS = f"""p AS (SELECT *, {_METRES} said, route = 'reconstructed_radius' circle, count(*) OVER (PARTITION BY urn, entry_year) k FROM provenance),
e AS (SELECT prov_id, unnest(list_filter([CASE WHEN NOT coalesce(route IN ('reconstructed_radius', 'published_polygon', 'digitised'), false) THEN 'route' END, CASE WHEN NOT coalesce(status IN ('draft', 'verified', 'rejected'), false) THEN 'status' END,
  CASE WHEN NOT coalesce(entry_year BETWEEN 2015 AND 2025, false) THEN 'year' END, CASE WHEN NOT coalesce(starts_with(source_url, 'http'), false) THEN 'url' END, CASE WHEN NOT coalesce(NOT circle OR said IS NOT NULL, false) THEN 'distance' END,
  CASE WHEN NOT coalesce(NOT circle OR said IS NULL OR abs(said - cutoff_m) <= 1.0::DOUBLE + 0.00001::DOUBLE * abs(cutoff_m), false) THEN 'metres' END, CASE WHEN NOT coalesce(circle OR coalesce(polygon_file, '') <> '', false) THEN 'polygon' END,
  CASE WHEN NOT coalesce(status <> 'verified' OR (coalesce(verified_by, '') <> '' AND coalesce(verified_on, '') <> ''), false) THEN 'verifier' END, CASE WHEN k > 1 THEN 'duplicate' END], lambda x: x IS NOT NULL)) AS error FROM p)"""
SQL = {
    "step_log": """
WITH c AS (SELECT property_type IN ('D', 'S', 'T', 'F') c1, price > 0 c2, date IS NOT NULL c3, coalesce(trim(postcode_norm), '') <> '' c4, matched c5, gridind <> 9 c6, easting IS NOT NULL AND northing IS NOT NULL c7 FROM pp_geo),
n AS (SELECT [count(*), count(*) FILTER (WHERE c1), count(*) FILTER (WHERE c1 AND c2), count(*) FILTER (WHERE c1 AND c2 AND c3), count(*) FILTER (WHERE c1 AND c2 AND c3 AND c4), count(*) FILTER (WHERE c1 AND c2 AND c3 AND c4 AND c5),
  count(*) FILTER (WHERE c1 AND c2 AND c3 AND c4 AND c5 AND c6), count(*) FILTER (WHERE c1 AND c2 AND c3 AND c4 AND c5 AND c6 AND c7)] v FROM c),
s AS (SELECT unnest(range(1, 8)) i, v FROM n)
SELECT i::INT AS step_no, ['type', 'price', 'date', 'postcode', 'matched', 'grid reference', 'coordinates'][i] AS step, v[i] AS rows_before, v[i + 1] AS rows_after, v[i] - v[i + 1] AS dropped FROM s""",
    "duplicate_postcodes": "SELECT postcode_key, count(*) AS n FROM onspd GROUP BY 1 HAVING count(*) > 1",
    "postcode_forms": f"SELECT {_form('postcode')} AS postcode_form, count(*) AS n_rows FROM pp_geo GROUP BY 1",
    "match_audit": f"""
WITH k AS (SELECT DISTINCT {_form("postcode_key")} AS key FROM onspd WHERE {_form("postcode_key")} IS NOT NULL),
p AS (SELECT year(date)::INT AS year, district, {_form("postcode")} AS key FROM pp_geo)
SELECT year, district, count(*) AS n_sales, count(*) FILTER (WHERE p.key IS NULL) AS n_no_postcode, count(*) FILTER (WHERE p.key IS NOT NULL AND k.key IS NULL) AS n_unmatched FROM p LEFT JOIN k ON k.key = p.key GROUP BY 1, 2""",
    "region_box": """
WITH b AS (SELECT coalesce(laua, '') laua, min(easting) - 5000 AS west, max(easting) + 5000 AS east, min(northing) - 5000 AS south, max(northing) + 5000 AS north FROM onspd WHERE gridind <> 9 AND easting IS NOT NULL AND northing IS NOT NULL GROUP BY laua)
SELECT b.laua, west, east, south, north, count(g.txn_id) AS n_sales FROM b LEFT JOIN pp_geo g ON g.easting BETWEEN west AND east AND g.northing BETWEEN south AND north GROUP BY ALL""",
    "geo_steps": """
WITH x AS (SELECT min(easting) - 5000 w, max(easting) + 5000 e, min(northing) - 5000 s, max(northing) + 5000 n FROM onspd WHERE gridind <> 9 AND easting IS NOT NULL AND northing IS NOT NULL),
c AS (SELECT coalesce(trim(postcode_norm), '') <> '' c1, matched c2, gridind <> 9 c3, easting BETWEEN w AND e AND northing BETWEEN s AND n c4 FROM pp_geo, x),
n AS (SELECT [count(*), count(*) FILTER (WHERE c1), count(*) FILTER (WHERE c1 AND c2), count(*) FILTER (WHERE c1 AND c2 AND c3), count(*) FILTER (WHERE c1 AND c2 AND c3 AND c4)] v FROM c)
SELECT i::INT AS step_no, ['postcode', 'matched', 'grid reference', 'extent'][i] AS step, v[i] AS rows_before, v[i + 1] AS rows_after, v[i] - v[i + 1] AS dropped FROM (SELECT unnest(range(1, 5)) i, v FROM n)""",
    "quarter_counts": "SELECT year(date) || 'Q' || quarter(date) AS quarter, count(*) AS n_sales, count(DISTINCT txn_id) AS n_txn FROM sales GROUP BY 1",
    "indicator_sums": "SELECT year_quarter, count(*) FILTER (WHERE property_type = 'F') AS n_flat, count(*) FILTER (WHERE property_type = 'D') AS n_detached, count(*) FILTER (WHERE tenure = 'L') AS n_leasehold, count(*) FILTER (WHERE new_build = 'Y') AS n_new FROM sales GROUP BY 1",
    "strict_distance": """
WITH r AS (SELECT prov_id, lower(cutoff_as_published) t FROM provenance WHERE regexp_matches(lower(cutoff_as_published), '^\\s*([\\d,]*\\.?\\d+)\\s*(m|metres|meters|kms?|miles?|of a mile)\\s*$')),
x AS (SELECT prov_id, replace(regexp_extract(t, '([\\d,]*\\.?\\d+)', 1), ',', '')::DOUBLE n, regexp_extract(t, '\\d\\s*([a-z].*)$', 1) u FROM r)
SELECT prov_id, round(n * CASE WHEN u LIKE 'k%' THEN 1000.0::DOUBLE WHEN u LIKE '%mile%' THEN 1609.344::DOUBLE ELSE 1.0::DOUBLE END, 3) AS metres FROM x""",
    "link_years": "SELECT year(coalesce(try_strptime(linkestablisheddate, '%d-%m-%Y'), try_strptime(linkestablisheddate, '%d/%m/%Y')))::INT AS year, count(*) AS n_links FROM links_edubasealldata GROUP BY 1",
    "event_props": "SELECT event_type, count(*) AS n, sum((props::JSON ->> '$.k')::BIGINT)::BIGINT AS sum_k, max((props::JSON ->> '$.k')::BIGINT) AS max_k FROM events GROUP BY 1",
    "candidate_pairs": f"WITH {PAIRS} SELECT txn_id, boundary_id, round(d, 4) AS d_m FROM pairs",
    "side_counts": f"WITH {PAIRS} SELECT boundary_id, count(*) FILTER (WHERE d > 0) AS n_inside, count(*) FILTER (WHERE d <= 0) AS n_outside FROM pairs WHERE abs(d) < 400 GROUP BY 1",
    "assign_nearest": f"WITH {ASSIGNED} SELECT txn_id, boundary_id, round(d, 4) AS d_m, d > 0 AS is_inside, n_near::BIGINT AS n_near FROM assigned",
    "assign_compatible": f"WITH {_assigned(PAIRS, 'n_in - CASE boundary_id::BIGINT % 3 WHEN 0 THEN n_1 WHEN 1 THEN n_0 ELSE 0 END')} SELECT txn_id, boundary_id, ['girls', 'boys', 'mixed'][boundary_id::BIGINT % 3 + 1] AS kind, round(d, 4) AS d_m FROM assigned",
    "assign_in_place": f"WITH {_assigned(f'{_SALES}, pairs AS ({_CIRCLE})')} SELECT txn_id, boundary_id, round(d, 4) AS d_m FROM assigned",
    "near_counts": f"WITH {PAIRS}, g AS (SELECT txn_id, count(*) k FROM pairs WHERE abs(d) < 400 GROUP BY 1) SELECT k AS n_boundaries, count(*) AS n_sales FROM g GROUP BY 1",
    "active_from": f"WITH {PAIRS}, f AS (SELECT urn, make_date(list_min(map_keys(radius_by_year)), 3, 1) since FROM boundary) SELECT boundary_id, count(*) AS n_pairs, count(*) FILTER (WHERE date >= since) AS n_active FROM pairs JOIN f ON f.urn = boundary_id GROUP BY 1",
    "share_within": f"WITH {ASSIGNED} SELECT boundary_id, count(*) AS n, count(*) FILTER (WHERE abs(d) < 25) AS n_25m, count(*) FILTER (WHERE abs(d) < 50) AS n_50m FROM sample GROUP BY 1",
    "polygon_distance": f"WITH {_SALES}, {_EDGES}, {_DRAWN} SELECT DISTINCT txn_id, boundary_id, round(CASE WHEN k % 2 = 1 THEN m ELSE -m END, 4) AS d_m FROM drawn WHERE m < 750",
    "nearest_centre": f"""
WITH s AS (SELECT DISTINCT easting, northing FROM sales WHERE {_OK}),
j AS (SELECT s.easting, s.northing, b.urn, sqrt((s.easting - b.easting) * (s.easting - b.easting) + (s.northing - b.northing) * (s.northing - b.northing)) r FROM s, boundary b)
SELECT easting, northing, urn, round(r, 4) AS distance_m FROM (SELECT *, row_number() OVER (PARTITION BY easting, northing ORDER BY r, urn) k FROM j) WHERE k = 1""",
    "nearest_three": """
WITH j AS (SELECT a.urn, b.urn AS neighbour, sqrt((a.easting - b.easting) * (a.easting - b.easting) + (a.northing - b.northing) * (a.northing - b.northing)) r FROM boundary a, boundary b WHERE a.urn <> b.urn)
SELECT urn, neighbour, place, round(r, 4) AS distance_m FROM (SELECT *, row_number() OVER (PARTITION BY urn ORDER BY r, neighbour) place FROM j) WHERE place <= 3""",
    "yearly_radius": f"""
WITH {PAIRS}, h AS (SELECT urn, make_date(m.key, 3, 1) a, m.value v FROM (SELECT urn, unnest(map_entries(radius_by_year)) m FROM boundary) WHERE m.value IS NOT NULL),
i AS (SELECT *, lead(a) OVER (PARTITION BY urn ORDER BY a) z FROM h),
p AS (SELECT DISTINCT txn_id, boundary_id, date, d, radius_m FROM pairs)
SELECT txn_id, boundary_id, round(d - radius_m + v, 4) AS d_year_m FROM pairs JOIN i ON i.urn = boundary_id AND radius_m IS NOT NULL AND date >= a AND (z IS NULL OR date < z)""",
    "events_union": """
SELECT kind, grade, count(*) AS n FROM (SELECT 'published' AS kind, grade, publication_date t FROM ofsted_events WHERE publication_date IS NOT NULL UNION ALL SELECT 'inspected', grade, inspection_start FROM ofsted_events WHERE inspection_start IS NOT NULL) GROUP BY 1, 2""",
    "events_deduped": """
WITH e AS (SELECT *, CASE WHEN role = 'current' THEN 0 WHEN role IS NULL THEN NULL ELSE 1 END rk FROM ofsted_events WHERE urn IS NOT NULL AND publication_date IS NOT NULL AND grade BETWEEN 1 AND 4),
n AS (SELECT * EXCLUDE k FROM (SELECT *, row_number() OVER (PARTITION BY trim(inspection_number) ORDER BY rk NULLS FIRST, source NULLS FIRST, event_id) k FROM e WHERE coalesce(trim(inspection_number), '') <> '') WHERE k = 1
  UNION ALL SELECT * FROM e WHERE coalesce(trim(inspection_number), '') = ''),
b AS (SELECT * FROM (SELECT *, min(rk) OVER (PARTITION BY urn, publication_date) m FROM n) WHERE rk = m),
l AS (SELECT * FROM (SELECT *, max(inspection_start) OVER (PARTITION BY urn, publication_date) z FROM b) WHERE inspection_start IS NOT DISTINCT FROM z),
c AS (SELECT *, min(grade) OVER (PARTITION BY urn, publication_date) <> max(grade) OVER (PARTITION BY urn, publication_date) bad, row_number() OVER (PARTITION BY urn, publication_date ORDER BY source DESC NULLS LAST, event_id DESC) k FROM l)
SELECT event_id, urn, grade, bad AS is_contested FROM c WHERE k = 1""",
    "grade_history": """
WITH e AS (SELECT *, lag(grade) OVER (PARTITION BY urn ORDER BY publication_date, event_id) b, row_number() OVER (PARTITION BY urn ORDER BY publication_date, event_id) k FROM ofsted_events WHERE urn IS NOT NULL AND publication_date IS NOT NULL AND grade BETWEEN 1 AND 4)
SELECT event_id, urn, grade FROM e WHERE k = 1 OR grade IS DISTINCT FROM b""",
    "cutoff_stability": """
WITH y AS (SELECT urn, entry_year, avg(cutoff_m) r FROM provenance WHERE cutoff_m IS NOT NULL GROUP BY 1, 2)
SELECT urn, count(*) AS n_years, round(median(r), 4) AS median_m, round(stddev_samp(r) / avg(r), 6) AS cv FROM y GROUP BY 1""",
    "provenance_errors": f"WITH {_MARKS} SELECT error, count(*) AS n_rows FROM e GROUP BY 1",
    "first_errors": f"WITH {_MARKS} SELECT prov_id, error FROM e ORDER BY error DESC, prov_id LIMIT 10",
    "figures_rechecked": """
WITH p AS (SELECT urn, entry_year, max(cutoff_m) m FROM provenance WHERE status = 'verified' GROUP BY 1, 2),
o AS (SELECT urn, x.key y, x.value r FROM (SELECT urn, unnest(map_entries(radius_by_year)) x FROM boundary))
SELECT CASE WHEN r IS NULL THEN 'absent' WHEN abs(r - m) <= 1 THEN 'same' ELSE 'differs' END AS state, count(*) AS n_rows FROM p LEFT JOIN o ON o.urn = p.urn AND o.y = p.entry_year GROUP BY 1""",
    "screen_table": f"""
WITH {PAIRS}, c AS (SELECT boundary_id, count(*) FILTER (WHERE d > 0) i, count(*) FILTER (WHERE d <= 0) o FROM pairs WHERE abs(d) < 400 GROUP BY 1),
l AS (SELECT urn, count(*) n, count(*) FILTER (WHERE status = 'verified') v FROM provenance GROUP BY 1)
SELECT l.urn, l.n AS n_rows, l.v AS n_verified, b.n_years, round(b.radius_m, 3) AS radius_m, coalesce(c.i, 0) AS n_inside, coalesce(c.o, 0) AS n_outside, CASE WHEN b.n_years IS NULL THEN 'no figures' ELSE 'figures' END AS state
FROM l LEFT JOIN boundary b ON b.urn = l.urn LEFT JOIN c ON c.boundary_id = l.urn""",
    "results_with_regions": "SELECT boundary_id, route, n_years, n_obs, round(tau, 6) + 0.0::DOUBLE AS tau FROM per_boundary JOIN boundary ON urn = boundary_id",
    "result_ranges": "SELECT count(DISTINCT boundary_id) AS n_regions, count(DISTINCT n_clusters) AS n_cluster_counts, min(n_obs) AS least_rows, max(n_obs) AS most_rows, round(min(tau), 6) AS least_tau, round(max(tau), 6) AS greatest_tau FROM per_boundary",
    "label_numbers": "SELECT boundary_id, nullif(regexp_extract(label, '(\\d{3,})', 1), '') AS number FROM per_boundary",
    "first_fails": """
WITH f AS (SELECT CASE WHEN radius_m IS NULL THEN 'circle' WHEN NOT coalesce(n_years >= 8, false) THEN 'years' WHEN NOT coalesce(cv <= 0.2, false) THEN 'spread' ELSE 'PASS' END AS first_fail FROM boundary) SELECT first_fail, count(*) AS n FROM f GROUP BY 1""",
    "screen_failures": """
WITH f AS (SELECT urn, list_filter([CASE WHEN radius_m IS NULL THEN 'circle' END, CASE WHEN NOT coalesce(n_years >= 8, false) THEN 'years' END, CASE WHEN NOT coalesce(cv <= 0.2, false) THEN 'spread' END], lambda x: x IS NOT NULL) f FROM boundary)
SELECT urn, f[1] AS first_fail, coalesce(array_to_string(f, ';'), '') AS all_fails FROM f""",
    "rd_sides": f"WITH {ASSIGNED}, {_sides('d', 'true', '400.0::DOUBLE')} SELECT {_TAU.format(6)}, round(inside_at_line, 6) AS inside_at_line, round(outside_at_line, 6) AS outside_at_line, n_inside, n_outside FROM r",
    "rd_by_region": f"WITH {ASSIGNED}, {_sides('d', 'true', '400.0::DOUBLE', 'boundary_id,')} SELECT boundary_id, {_TAU.format(5)}, n_inside, n_outside FROM r",
    "rd_plain_sweep": f"WITH {ASSIGNED}, {_sides('d', 'true', 'h_m', 'h_m,', ', ' + _GRID)} SELECT h_m, {_TAU.format(6)}, n_inside, n_outside FROM r",
    "rd_plain_donut": f"WITH {ASSIGNED}, {_sides('d', 'abs(d) >= donut_m', '400.0::DOUBLE', 'donut_m,', _per('25, 50', 'donut_m'))} SELECT donut_m, {_TAU.format(6)}, n_inside, n_outside FROM r",
    "rd_plain_placebo": f"WITH {ASSIGNED}, {_sides('d - cutoff_m', '((cutoff_m > 0 AND d > 0) OR (cutoff_m < 0 AND d <= 0))', '400.0::DOUBLE', 'cutoff_m,', _per('-500, -250, 250, 500', 'cutoff_m'))} SELECT cutoff_m, {_TAU.format(6)}, n_inside, n_outside FROM r",
    "cell_moments": f"""
WITH {ASSIGNED}, f AS (SELECT *, d / 400 x, 1 - abs(d) / 400 w FROM sample WHERE abs(d) < 400)
SELECT boundary_id AS cluster, property_type AS fe_property_type, year_quarter AS fe_year_quarter, d > 0 AS is_inside, count(*) AS n, round(sum(w), 5) AS s0, round(sum(w * x), 5) AS s1, round(sum(w * x * x), 5) AS s2, round(sum(w * y), 5) AS t0, round(sum(w * y * x), 5) AS t1 FROM f GROUP BY ALL""",
    "octant_counts": f"""
WITH {PAIRS}, o AS (SELECT boundary_id, degrees(atan2(easting - cx, northing - cy)) a FROM pairs) SELECT boundary_id, floor((CASE WHEN a < 0 THEN a + 360 ELSE a END) / 45)::BIGINT AS octant, count(*) AS n FROM o GROUP BY 1, 2""",
    "density_histogram": f"""
WITH {ASSIGNED}, b AS (SELECT ceil(d / 10)::BIGINT - 1 AS bin, count(*) n FROM sample GROUP BY 1), g AS (SELECT unnest(generate_series((SELECT min(bin) FROM b), (SELECT max(bin) FROM b))) AS bin)
SELECT g.bin, (g.bin + 0.5::DOUBLE) * 10 AS centre, coalesce(n, 0) AS n FROM g LEFT JOIN b ON b.bin = g.bin""",
    "binned_means": f"WITH {ASSIGNED} SELECT ceil(d / 50)::BIGINT - 1 AS bin, (ceil(d / 50) - 1 + 0.5::DOUBLE) * 50 AS centre, round(avg(y), 6) AS mean, round(stddev_samp(y), 6) AS sd, count(*) AS n FROM sample WHERE abs(d) < 400 GROUP BY 1, 2",
    "median_outside": f"WITH {ASSIGNED} SELECT boundary_id, median(price)::DOUBLE AS median_price, count(*) AS n FROM sample WHERE abs(d) < 400 AND d <= 0 GROUP BY 1",
    "pivot_sides": f"WITH {ASSIGNED} SELECT boundary_id, count(*) FILTER (WHERE d > 0) AS inside, count(*) FILTER (WHERE d <= 0) AS outside FROM sample GROUP BY 1",
    "balance": f"""
WITH {ASSIGNED} SELECT boundary_id, d > 0 AS is_inside, round(avg((property_type = 'F')::INT::DOUBLE), 6) AS mean_is_flat, round(avg((property_type = 'D')::INT::DOUBLE), 6) AS mean_is_detached, round(avg((tenure = 'L')::INT::DOUBLE), 6) AS mean_is_leasehold,
  round(avg((new_build = 'Y')::INT::DOUBLE), 6) AS mean_is_new_build FROM sample WHERE abs(d) < 400 GROUP BY 1, 2""",
    "regions_without_sales": f"WITH {PAIRS} SELECT urn AS boundary_id FROM boundary WHERE urn NOT IN (SELECT boundary_id FROM pairs)",
    "stream_windows": """
WITH w AS (SELECT epoch_ms(0)::DATE + (floor((date - DATE '1970-01-01') / 30.0::DOUBLE) * 30)::INT AS first_day, price FROM sales WHERE date IS NOT NULL)
SELECT first_day::DATE AS first_day, count(*) AS n_sales, sum(price)::BIGINT AS total FROM w WHERE first_day + 30 <= (SELECT max(date) - 60 FROM sales) GROUP BY 1""",
    "built_areas": """
WITH y AS (SELECT urn, entry_year, max(cutoff_m) r, min(route) route FROM provenance WHERE status = 'verified' AND cutoff_m IS NOT NULL AND urn IN (SELECT urn FROM boundary) GROUP BY 1, 2),
a AS (SELECT urn, min(route) route, median(r) m, count(entry_year) n, stddev_samp(r) / avg(r) cv FROM y GROUP BY 1)
SELECT a.urn, a.route, b.easting, b.northing, round(m, 4) AS radius_m, n AS n_years, round(a.cv, 6) AS cv FROM a JOIN boundary b ON b.urn = a.urn""",
    "nearest_outside_line": f"""{LINES}, {_OWN_LINES},
j AS (SELECT a.urn, b.urn AS neighbour, sqrt((a.easting - b.easting) * (a.easting - b.easting) + (a.northing - b.northing) * (a.northing - b.northing)) r FROM boundary a, boundary b WHERE NOT EXISTS (SELECT 1 FROM l WHERE l.node = a.urn AND l.ancestor = b.urn))
SELECT urn, neighbour, place, round(r, 4) AS distance_m FROM (SELECT *, row_number() OVER (PARTITION BY urn ORDER BY r, neighbour) place FROM j) WHERE place <= 3""",
    "timing": f"""{LINES}, {_CHANGES}, {_BY_DAY},
h AS (SELECT l.node, l.steps, g.t, g.grade FROM l JOIN g ON g.urn = l.ancestor),
c AS (SELECT * FROM (SELECT DISTINCT node, publication_date t, grade, (SELECT h.grade FROM h WHERE h.node = ch.node AND h.t < ch.publication_date::DATE ORDER BY h.t DESC, h.steps, h.grade DESC LIMIT 1) eve FROM ch WHERE publication_date >= TIMESTAMP '2017-01-01' AND publication_date <= TIMESTAMP '2023-12-31') WHERE eve IS NOT NULL AND abs(eve - grade) >= 1),
{ASSIGNED}
SELECT boundary_id, CASE WHEN date < t::DATE THEN 'before' ELSE 'after' END AS half, count(*) AS n_sales FROM sample JOIN c ON c.node = boundary_id GROUP BY 1, 2""",
    "line_changes": f"{LINES}, {_CHANGES} SELECT node AS boundary_id, event_id, urn AS given_to, grade FROM ch",
    "line_starts": f"""{LINES}, x AS (SELECT {_trim("urn")} urn, min(try_strptime(linkestablisheddate, '%d-%m-%Y'))::DATE t FROM links_edubasealldata GROUP BY 1),
y AS (SELECT node, t, row_number() OVER (PARTITION BY node ORDER BY steps DESC, ancestor DESC) k, min(t) OVER (PARTITION BY node) f FROM lines LEFT JOIN x ON x.urn = ancestor)
SELECT node, t IS NOT NULL AS is_known, CASE WHEN t IS NOT NULL THEN f END AS first_day FROM y WHERE k = 1""",
    "plain_side_lines": f"""
WITH {ASSIGNED}, f AS (SELECT d > 0 AS i, boundary_id g, d x, y, 1 - abs(d) / 400 w FROM sample WHERE abs(d) < 400),
c AS (SELECT i, g, count(*) n, sum(w) s0, sum(w * x) s1, sum(w * x * x) s2, sum(w * y) t0, sum(w * x * y) t1 FROM f GROUP BY 1, 2),
a AS (SELECT i, sum(n) n, count(*) k, sum(s0) s0, sum(s1) s1, sum(s2) s2, sum(t0) t0, sum(t1) t1 FROM c GROUP BY 1),
b AS (SELECT *, s0 * s2 - s1 * s1 det, (s2 * t0 - s1 * t1) / (s0 * s2 - s1 * s1) p, (s0 * t1 - s1 * t0) / (s0 * s2 - s1 * s1) q FROM a WHERE s0 * s2 - s1 * s1 > 1e-9 * s0 * s2 AND k > 1 AND n > 2),
u AS (SELECT b.*, (b.s2 * (c.t0 - p * c.s0 - q * c.s1) - b.s1 * (c.t1 - p * c.s1 - q * c.s2)) / det v0, (b.s0 * (c.t1 - p * c.s1 - q * c.s2) - b.s1 * (c.t0 - p * c.s0 - q * c.s1)) / det v1 FROM b JOIN c USING (i)),
v AS (SELECT i, p, q, k, n, sum(v0 * v0) aa, sum(v0 * v1) ab, sum(v1 * v1) bb FROM u GROUP BY 1, 2, 3, 4, 5),
z AS (SELECT *, m * 100.0::DOUBLE * CASE WHEN i THEN 1 ELSE -1 END x FROM v, (SELECT unnest(range(0, 5)) m)),
o AS (SELECT *, p + q * x AS fitted, 1.959963984540054::DOUBLE * sqrt(k / (k - 1.0::DOUBLE) * (n - 1) / (n - 2.0::DOUBLE) * (aa + 2 * x * ab + x * x * bb)) r FROM z)
SELECT CASE WHEN i THEN 'inside' ELSE 'outside' END AS side, x + 0.0::DOUBLE AS x, round(fitted, 6) AS fitted, round(fitted - r, 6) AS low, round(fitted + r, 6) AS high FROM o""",
    "stream_first_delivery": """
WITH f AS (SELECT txn_id, min(loaded_at) t, count(*) k FROM pp_geo GROUP BY 1) SELECT date_trunc('month', t)::DATE AS month, count(*) AS n_sales, sum(k)::BIGINT AS n_deliveries FROM f GROUP BY 1""",
    "lineage_grades": f"""{LINES}, {_OWN_LINES}, {_BY_DAY},
q AS (SELECT urn, unnest(generate_series(2015, 2025))::INT AS year FROM boundary),
h AS (SELECT l.node, l.steps, l.ancestor, g.t, g.grade FROM l JOIN g ON g.urn = l.ancestor),
k AS (SELECT q.urn, q.year, h.*, row_number() OVER (PARTITION BY q.urn, q.year ORDER BY t DESC NULLS LAST, steps, h.grade DESC) i FROM q LEFT JOIN h ON h.node = q.urn AND h.t <= make_date(q.year, 3, 1))
SELECT urn, year, grade, t AS published_on, ancestor AS given_to FROM k WHERE i = 1""",
    "lineage": f"{LINES} SELECT node, ancestor, steps FROM lines",
}
