"""WGS84 columns: geodetic, earth-centred and local east-north-up coordinates, all as built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The WGS84 ellipsoid.
A = 6378137.0
FLATTENING = 1 / 298.257223563
E2 = FLATTENING * (2 - FLATTENING)
B = A * (1 - FLATTENING)
EP2 = E2 / (1 - E2)


def ecef(lat: Column, lon: Column, alt: Column) -> tuple[Column, Column, Column]:
    p, q = F.radians(lat), F.radians(lon)
    n = F.lit(A) / F.sqrt(1 - E2 * F.sin(p) * F.sin(p))
    return (n + alt) * F.cos(p) * F.cos(q), (n + alt) * F.cos(p) * F.sin(q), (n * (1 - E2) + alt) * F.sin(p)


def geodetic_to_enu(lat: Column, lon: Column, alt: Column, lat0: Column, lon0: Column, alt0: Column) -> tuple[Column, Column, Column]:
    """East, north, up in metres about an origin; a null altitude counts as 0."""
    x, y, z = ecef(lat, lon, F.coalesce(alt, F.lit(0.0)))
    x0, y0, z0 = ecef(lat0, lon0, F.coalesce(alt0, F.lit(0.0)))
    dx, dy, dz, p, q = x - x0, y - y0, z - z0, F.radians(lat0), F.radians(lon0)
    e = -F.sin(q) * dx + F.cos(q) * dy
    n = -F.sin(p) * F.cos(q) * dx - F.sin(p) * F.sin(q) * dy + F.cos(p) * dz
    u = F.cos(p) * F.cos(q) * dx + F.cos(p) * F.sin(q) * dy + F.sin(p) * dz
    return e, n, u


def enu_to_geodetic(e: Column, n: Column, u: Column, lat0: Column, lon0: Column, alt0: Column) -> tuple[Column, Column, Column]:
    """Latitude, longitude, altitude of a local point (one Bowring step; sub-micrometre near the ground)."""
    x, y, z = enu_to_ecef(e, n, u, lat0, lon0, alt0)
    r = F.sqrt(x * x + y * y)
    theta = F.atan2(z * A, r * B)
    lat = F.atan2(z + EP2 * B * F.pow(F.sin(theta), 3), r - E2 * A * F.pow(F.cos(theta), 3))
    big_n = F.lit(A) / F.sqrt(1 - E2 * F.sin(lat) * F.sin(lat))
    return F.degrees(lat), F.degrees(F.atan2(y, x)), r * F.cos(lat) + z * F.sin(lat) - F.lit(A * A) / big_n


def enu_to_ecef(e: Column, n: Column, u: Column, lat0: Column, lon0: Column, alt0: Column) -> tuple[Column, Column, Column]:
    p, q = F.radians(lat0), F.radians(lon0)
    x0, y0, z0 = ecef(lat0, lon0, F.coalesce(alt0, F.lit(0.0)))
    return (
        x0 - F.sin(q) * e - F.sin(p) * F.cos(q) * n + F.cos(p) * F.cos(q) * u,
        y0 + F.cos(q) * e - F.sin(p) * F.sin(q) * n + F.cos(p) * F.sin(q) * u,
        z0 + F.cos(p) * n + F.sin(p) * u,
    )


def rebase_enu(df: DataFrame, xyz: tuple[str, str, str], origin: tuple[Column, Column, Column], target: tuple[Column, Column, Column], out: tuple[str, str, str]) -> DataFrame:
    """Points about one origin expressed about another, in columns `out`; equal origins leave them untouched.

    Goes through earth-centred coordinates in a column step of its own, so that the expressions stay small.
    """
    e, n, u = (F.col(c) for c in xyz)
    same = (origin[0] == target[0]) & (origin[1] == target[1]) & F.coalesce(origin[2], F.lit(0.0)).eqNullSafe(F.coalesce(target[2], F.lit(0.0)))
    x = df.withColumns(dict(zip(("_ex", "_ey", "_ez"), enu_to_ecef(e, n, u, *origin))))
    x0, y0, z0 = ecef(target[0], target[1], F.coalesce(target[2], F.lit(0.0)))
    dx, dy, dz, p, q = F.col("_ex") - x0, F.col("_ey") - y0, F.col("_ez") - z0, F.radians(target[0]), F.radians(target[1])
    moved = (
        -F.sin(q) * dx + F.cos(q) * dy,
        -F.sin(p) * F.cos(q) * dx - F.sin(p) * F.sin(q) * dy + F.cos(p) * dz,
        F.cos(p) * F.cos(q) * dx + F.cos(p) * F.sin(q) * dy + F.sin(p) * dz,
    )
    return x.withColumns({o: F.when(same, a).otherwise(b) for o, a, b in zip(out, (e, n, u), moved)}).drop("_ex", "_ey", "_ez")


def sim3(x: Column, y: Column, z: Column, s: Column, r: Column, t: Column) -> tuple[Column, Column, Column]:
    """s * R p + t with R an array of rows and t an array."""
    return tuple(s * (r[i][0] * x + r[i][1] * y + r[i][2] * z) + t[i] for i in range(3))


def apply_georefs(points: DataFrame, georefs: DataFrame, xyz: tuple[str, str, str] = ("x", "y", "z")) -> DataFrame:
    """Adds e, n, u (about the map's own origin) and the origin to points that have map_id; maps without a georeference drop out.

    Points keep their other columns; a georeference written twice must be made unique by the caller.
    """
    g = georefs.select("map_id", F.col("s").alias("_s"), F.col("r").alias("_r"), F.col("t").alias("_t"), "lat0", "lon0", "alt0")
    e, n, u = sim3(*[F.col(c) for c in xyz], F.col("_s"), F.col("_r"), F.col("_t"))
    return points.drop("lat0", "lon0", "alt0").join(g, "map_id").withColumns({"e": e, "n": n, "u": u}).drop("_s", "_r", "_t")


def y_up(e: Column, n: Column, u: Column) -> tuple[Column, Column, Column]:
    """Local coordinates in the axes of 3-D scenes: (-e, u, n)."""
    return -e, u, n


def decode_fix(lat: Column, lon: Column, alt: Column) -> Column:
    """A position struct; null where latitude or longitude is null or NaN, a NaN altitude passes."""
    gone = lat.isNull() | lon.isNull() | F.isnan(lat) | F.isnan(lon)
    return F.when(~gone, F.struct(lat.alias("lat"), lon.alias("lon"), alt.alias("alt")))
