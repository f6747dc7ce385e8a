
import re

import pytest
from pyspark.sql import functions as F


from terrane.operators.units import METRES, reconcile_distances, solve_units

SCHEMA = "id long, p string, m double, title string, notes string"


def _run(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    out = reconcile_distances(df, published="p", metres="m", texts=["title", "notes"]).select("id", "units_of.*")
    return {r["id"]: r for r in out.collect()}


@pytest.mark.parametrize(
    "text, metres",
    [
        ("0.5 miles", 804.672), ("1,254m", 1254), ("1.25 km", 1250), ("1.915 kms", 1915), ("0.683 of a mile", 1099.181952), ("  1009 yds ", 922.6296), ("0·63 kms", 630), ("0,81 mi", 1303.56864),
        ("¾ mile", 1207.008), ("1½ miles", 2414.016), ("1 ¾ miles", 2816.352), ("3/4 mile", 1207.008), ("1 1/2 miles", 2414.016), ("half a mile", 804.672), ("three quarters of a mile", 1207.008),
        ("one and a half miles", 2414.016), ("a quarter of a mile", 402.336), ("one kilometre", 1000), ("one mile exactly", 1609.344), ("1 mile and 1227 yds", 2731.3128), ("1 km 771 m", 1771),
        ("0.4021 miles (647 m)", 647.1172224), ("738 yards (straight line)", 674.8272), ("up to 0.5878 mi", 945.9724032), ("Cut off - 946 m", 946), ("20,390.00 meters", 20390), (".883 mile", 1421.050752),
        ("1 469m", 1469), ("1 469.5 M", 1469.5), ("0.54 miles.", 869.04576), ("1158 foot", 352.9584), ("2,355 ft", 717.804), ("furthest child lived 700m, last child offered", 700), ("0,6468 mile", 1040.9236992), ("0,5791 mile", 931.9711104), ("12,3456 km", 12345.6),
    ],
)
def test_readings(spark, text, metres):
    metres = float(metres)
    r = _run(spark, [(1, text, metres, "t", None), (2, text, metres + 1.5, "t", None)])
    assert r[1]["metres"] == pytest.approx(metres, abs=1e-6) and not r[1]["wrong"] and r[1]["source"] == "figure"
    assert r[2]["wrong"]


@pytest.mark.parametrize("text", ["about a mile", "n/a", "-", "", None, "withheld (<5)", "see map", "all applicants offered", "0/0 mile"])
def test_no_exact_figure(spark, text):
    r = _run(spark, [(1, text, 12.0, "in miles", "metres")])[1]
    assert r["metres"] is None and not r["wrong"]


def test_unit_from_text_and_precedence(spark):
    r = _run(spark, [
        (1, "0.5", 804.7, "Table 2020 (distances in miles)", None), (2, "0.5", 900.0, "Table 2020", "table header says miles"), (3, "500 m", 500.0, "all figures in miles", None),
        (4, "1,469", 1343.3, "[yards]", ""), (5, "0.81", 1303.6, "Table", None), (6, "0.81", 999.0, "Table", None), (7, "0.5 miles", None, None, None), (8, "0.5 miles", float("nan"), None, None), (9, "0.5 miles", 0.0, None, None),
        (10, "0,5158", 830.1, "Table 2020 [miles]", None), (11, "0,5158", 828.81, "Table 2020", "Council quotes miles"),
    ])
    assert (r[1]["unit"], r[1]["source"], r[1]["wrong"]) == ("mile", "text", False)
    assert r[2]["wrong"] and r[2]["source"] == "text"
    assert (r[3]["unit"], r[3]["wrong"]) == ("m", False)
    assert (r[4]["unit"], r[4]["wrong"]) == ("yard", False)
    assert (r[5]["unit"], r[5]["source"], r[5]["unique"], r[5]["wrong"]) == ("mile", "inferred", True, False)
    assert r[6]["metres"] is None and not r[6]["wrong"]
    assert r[7]["metres"] == pytest.approx(804.672) and not r[7]["wrong"] and not r[8]["wrong"] and r[9]["wrong"]
    assert r[10]["metres"] == pytest.approx(830.0996352) and not r[10]["wrong"] and r[11]["wrong"]


def test_identity_of_three_columns(spark):
    """mass = density * volume, each in one of two units; a tie of two solutions is flagged."""
    mass, density, volume = [("kg", 1.0), ("t", 1e3)], [("kg/m3", 1.0), ("g/cm3", 1e3)], [("m3", 1.0), ("l", 1e-3)]
    df = spark.createDataFrame([(1, 2.0, 2.0, 1000.0), (2, 5.0, 2.5, 2.0), (3, None, 1.0, 1.0), (4, -1.0, 1.0, 1.0)], "id long, mass double, density double, volume double")
    out = {r["id"]: r["solution"] for r in solve_units(df, [("mass", -1, mass), ("density", 1, density), ("volume", 1, volume)]).collect()}
    assert out[1]["units"] in (["t", "kg/m3", "m3"], ["kg", "kg/m3", "l"], ["t", "g/cm3", "l"]) and abs(out[1]["residual"]) < 1e-9 and not out[1]["unique"]
    assert abs(out[2]["residual"]) < 1e-9 and not out[2]["unique"]
    free = [("mass", -1, mass), ("density", 1, density), ("volume", 1, volume)]
    one = solve_units(df, free, stated={"mass": F.lit("t"), "volume": F.lit("m3")}).where("id = 1").collect()[0]["solution"]
    assert one["units"] == ["t", "kg/m3", "m3"] and one["unique"]
    assert out[3] is None and out[4] is None


def test_against_brute_force(spark):
    """The whole table against a plain reading in Python."""
    rows = spark.read.parquet("/root/testdata/sf0.01/provenance.parquet").select("prov_id", "cutoff_as_published", "cutoff_m", "source_title", "notes").collect()
    names = {"mile": "mile", "mi": "mile", "km": "km", "kilo": "km", "m": "m", "met": "m", "mtr": "m", "y": "yard", "f": "foot"}

    def unit(u):
        u = u.lower().replace("of a ", "").strip()
        return names[next(k for k in ("mile", "mi", "kilo", "km", "met", "mtr", "y", "f", "m") if u.startswith(k))]

    def plain(s):
        s = s.lower().replace(" ", " ").replace("·", ".").strip()
        for a, b in (("½", " 1/2"), ("¼", " 1/4"), ("¾", " 3/4"), ("three quarters of a", "0.75"), ("one and a half", "1.5"), ("a quarter of a", "0.25"), ("half a", "0.5"), ("one ", "1 ")):
            s = s.replace(a, b)
        return " ".join(s.split())

    def number(x):
        if re.fullmatch(r"[1-9]\d{0,2}([, ]\d{3})+(\.\d+)?", x):
            return float(re.sub("[, ]", "", x))
        return float(x.replace(",", "."))

    U = r"(of a mile|miles?|mi|kilometres?|kms?|met(?:re|er)s?|mtrs?|m|yards?|yds?|feet|foot|ft)(?![a-z])"
    N = r"(\d{1,3}(?:[, ]\d{3})+(?!\d)(?:\.\d+)?|\d*[.,]?\d+)"
    want = set()
    for r in rows:
        if r["cutoff_as_published"] is None or r["cutoff_m"] is None:
            continue
        s = plain(r["cutoff_as_published"])
        if "about" in s or "<" in s:
            continue
        said = re.search(r"\b(miles?|kilometres?|yards?|feet|metres?)\b", f"{r['source_title'] or ''} {r['notes'] or ''}".lower())
        if m := re.search(rf"(?:(\d+) )?(\d+)/(\d+) ?(?:{U})?", s):
            v, u = float(m[1] or 0) + int(m[2]) / int(m[3]), m[4]
        elif m := re.search(rf"{N} ?{U} (?:and )?{N} ?{U}", s):
            want.add(r["prov_id"]) if abs(number(m[1]) * METRES[unit(m[2])] + number(m[3]) * METRES[unit(m[4])] - r["cutoff_m"]) > 1 else None
            continue
        elif m := re.search(rf"{N} ?(?:{U})?", s):
            v, u = number(m[1]), m[2]
        else:
            continue
        u = unit(u) if u else unit(said[1]) if said else None
        if u and abs(v * METRES[u] - r["cutoff_m"]) > 1:
            want.add(r["prov_id"])
    from terrane.plans.problems import p2_found

    assert {r[0] for r in p2_found(spark, "/root/testdata/sf0.01").collect()} == want

