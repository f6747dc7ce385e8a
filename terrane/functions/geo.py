"""Guards and shapes on a flat grid in metres."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrane.functions.text import let

#: Axes of the two ellipsoids and the seven-parameter shift between them, and the grid's projection. Fixed values.
AIRY, WGS = (6377563.396, 6356256.909), (6378137.0, 6356752.3141)
SHIFT = (446.448, -125.157, 542.060, 0.1502, 0.2470, 0.8421, -20.4894)
SCALE, LAT0, LON0, E0, N0 = 0.9996012717, math.radians(49), math.radians(-2), 400000.0, -100000.0


def require_grid(df: DataFrame, x: str, y: str, crs: str | None = None) -> DataFrame:
    """The table itself; refused if its stated reference system is another one or its coordinates look like degrees."""
    if crs is not None and crs.upper().replace(" ", "") not in ("EPSG:27700", "URN:OGC:DEF:CRS:EPSG::27700"):
        raise ValueError(f"coordinates in {crs}, not on the metric grid")
    far = df.agg(F.max(F.abs(x)), F.max(F.abs(y))).collect()[0]
    if far[0] is not None and far[1] is not None and far[0] <= 180 and far[1] <= 90:
        raise ValueError("coordinates look like degrees")
    return df


def circle_wkt(x: Column, y: Column, radius: Column, points: int = 256) -> Column:
    """A circle's outline as a WKT polygon of so many points; NULL if anything is NULL."""
    at = lambda i: i * (2 * math.pi / points)
    ring = F.transform(F.sequence(F.lit(0), F.lit(points)), lambda i: F.concat_ws(" ", F.round(x + radius * F.cos(at(i % points)), 3).cast("string"), F.round(y + radius * F.sin(at(i % points)), 3).cast("string")))
    return F.when(x.isNotNull() & y.isNotNull() & radius.isNotNull(), F.concat(F.lit("POLYGON (("), F.array_join(ring, ", "), F.lit("))")))


def _arc(lat: Column) -> Column:
    """Length of the meridian from the origin's latitude, on the grid's ellipsoid."""
    a, b = AIRY
    n = (a - b) / (a + b)
    d, s = lat - LAT0, lat + LAT0
    return b * SCALE * (
        (1 + n + 5 / 4 * n**2 + 5 / 4 * n**3) * d - (3 * n + 3 * n**2 + 21 / 8 * n**3) * F.sin(d) * F.cos(s)
        + (15 / 8 * n**2 + 15 / 8 * n**3) * F.sin(2 * d) * F.cos(2 * s) - 35 / 24 * n**3 * F.sin(3 * d) * F.cos(3 * s)
    )


def to_degrees(east: Column, north: Column) -> Column:
    """Struct of WGS84 ``lat`` and ``lon`` of a grid point, by the published series and the seven-parameter shift
    (good to some metres); NULL for NULL."""
    a, b = AIRY
    e2 = 1 - (b / a) ** 2
    lat = (north - N0) / (a * SCALE) + LAT0
    for _ in range(5):  # each pass reduces the error a hundredfold
        lat = let(lat, lambda p: p + (north - N0 - _arc(p)) / (a * SCALE))

    def geographic(p: Column) -> Column:
        w = 1 - e2 * F.pow(F.sin(p), F.lit(2))
        nu, rho = a * SCALE / F.sqrt(w), a * SCALE * (1 - e2) / F.pow(w, F.lit(1.5))
        return let(F.struct(p.alias("p"), nu.alias("nu"), rho.alias("rho"), F.tan(p).alias("t"), (1 / F.cos(p)).alias("sec"), (east - E0).alias("d")), series)

    def series(v: Column) -> Column:
        nu, rho, t, d, sec = v["nu"], v["rho"], v["t"], v["d"], v["sec"]
        eta = nu / rho - 1
        phi = v["p"] - t / (2 * rho * nu) * d * d + t / (24 * rho * F.pow(nu, F.lit(3))) * (5 + 3 * t * t + eta - 9 * t * t * eta) * F.pow(d, F.lit(4)) - t / (720 * rho * F.pow(nu, F.lit(5))) * (61 + 90 * t * t + 45 * F.pow(t, F.lit(4))) * F.pow(d, F.lit(6))
        lam = LON0 + sec / nu * d - sec / (6 * F.pow(nu, F.lit(3))) * (nu / rho + 2 * t * t) * F.pow(d, F.lit(3)) + sec / (120 * F.pow(nu, F.lit(5))) * (5 + 28 * t * t + 24 * F.pow(t, F.lit(4))) * F.pow(d, F.lit(5))
        return let(F.struct(phi.alias("phi"), lam.alias("lam")), shifted)

    def shifted(g: Column) -> Column:
        nu = a / F.sqrt(1 - e2 * F.pow(F.sin(g["phi"]), F.lit(2)))
        x, y, z = nu * F.cos(g["phi"]) * F.cos(g["lam"]), nu * F.cos(g["phi"]) * F.sin(g["lam"]), nu * (1 - e2) * F.sin(g["phi"])
        return let(F.struct(x.alias("x"), y.alias("y"), z.alias("z")), turned)

    def turned(c: Column) -> Column:
        tx, ty, tz, rx, ry, rz, s = SHIFT
        rx, ry, rz = (math.radians(r / 3600) for r in (rx, ry, rz))
        m = 1 + s * 1e-6
        x, y, z = tx + m * c["x"] - rz * c["y"] + ry * c["z"], ty + rz * c["x"] + m * c["y"] - rx * c["z"], tz - ry * c["x"] + rx * c["y"] + m * c["z"]
        A, B = WGS
        E2 = 1 - (B / A) ** 2
        p = F.sqrt(x * x + y * y)
        out = F.atan2(z, p * (1 - E2))
        for _ in range(4):
            out = let(out, lambda q: F.atan2(z + E2 * A / F.sqrt(1 - E2 * F.pow(F.sin(q), F.lit(2))) * F.sin(q), p))
        return F.struct(F.degrees(out).alias("lat"), F.degrees(F.atan2(y, x)).alias("lon"))

    return F.when(east.isNotNull() & north.isNotNull(), let(lat, geographic))
