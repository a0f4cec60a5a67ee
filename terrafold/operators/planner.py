"""Next-flight planning: weak ground cells of each map, their plane, and camera viewpoints over them."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from terrafold.operators import geo
from terrafold.operators.points import GOLDEN_ANGLE, confidence_band, finite_xyz, is_finite

# Cell size in metres, least points of a cell, viewpoints at most, band percentiles, tilt in degrees, stand-off in metres.
CELL, LEAST, TOP, LOW, HIGH, TILT, STANDOFF = 5.0, 30, 10, 60.0, 80.0, 35.0, 15.0


def cells(points: DataFrame, group: str, cell: float = CELL, least: int = LEAST, low: float = LOW, high: float = HIGH) -> DataFrame:
    """Ground cells of each map's confidence band with at least `least` points.

    Cells are counted from the centroid of all valid rows of the map. Columns: group, ce, cn, k (dense number of the
    surviving cells in ce, cn order), n, cx, cy, cz, radius, and the six covariances. A map without such a cell has no rows.
    """
    valid = points.where(finite_xyz() & is_finite(F.col("conf")))
    centre = valid.groupBy(group).agg(*[F.avg(c).alias(f"_{c}") for c in ("x", "y")])
    band = confidence_band(points, group, low, high, LEAST).join(centre, group)
    band = band.withColumn("ce", F.floor((F.col("x") - F.col("_x")) / cell)).withColumn("cn", F.floor((F.col("y") - F.col("_y")) / cell))
    cov = [F.covar_samp(a, b).alias(f"c{a}{b}") for a, b in (("x", "x"), ("x", "y"), ("x", "z"), ("y", "y"), ("y", "z"), ("z", "z"))]
    stats = band.groupBy(group, "ce", "cn").agg(F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(f"m{c}") for c in ("x", "y", "z")], *cov).where(F.col("n") >= least)
    d = sum((F.pow(F.col(c) - F.col(f"m{c}"), 2) for c in ("y", "z")), F.pow(F.col("x") - F.col("mx"), 2))
    radius = band.join(stats, [group, "ce", "cn"]).groupBy(group, "ce", "cn").agg(F.sqrt(F.max(d)).alias("radius"))
    k = F.row_number().over(Window.partitionBy(group).orderBy("ce", "cn")) - 1
    return stats.join(radius, [group, "ce", "cn"]).withColumn("k", k.cast("long"))


def normals(clusters: DataFrame) -> DataFrame:
    """Adds nx, ny, nz: the direction of least variance, pointing up; straight up for fewer than three points."""
    names = ["cxx", "cxy", "cxz", "cyy", "cyz", "czz"]
    types = dict(clusters.dtypes)

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            c = np.nan_to_num(b[names].to_numpy(float))
            m = c[:, [0, 1, 2, 1, 3, 4, 2, 4, 5]].reshape(-1, 3, 3)
            v = np.linalg.eigh(m)[1][:, :, 0] if len(b) else np.zeros((0, 3))
            v = np.where((b.n.to_numpy() < 3)[:, None], np.array([0.0, 0.0, 1.0]), v)
            v = v * np.where(v[:, 2:3] < 0, -1.0, 1.0)
            yield b.assign(nx=v[:, 0], ny=v[:, 1], nz=v[:, 2])

    return clusters.mapInPandas(solve, ", ".join([f"`{c}` {t}" for c, t in types.items()] + ["nx double", "ny double", "nz double"]))


def viewpoints(clusters: DataFrame, group: str, top: int = TOP, tilt_deg: float = TILT, standoff: float = STANDOFF) -> DataFrame:
    """Camera positions over the cells with most points: at most `top` a map, ties by cell order.

    Azimuths follow the golden angle by k. Adds rank, azimuth_deg, px, py, pz and the look-at rotation (columns x, y, z axes).
    """
    rank = F.row_number().over(Window.partitionBy(group).orderBy(F.desc("n"), "k"))
    v = clusters.withColumn("rank", rank.cast("long")).where(F.col("rank") <= top)
    az, tilt = F.pmod(F.col("k") * GOLDEN_ANGLE, F.lit(2 * math.pi)), math.radians(tilt_deg)
    d = (math.sin(tilt) * F.sin(az), math.sin(tilt) * F.cos(az), F.lit(math.cos(tilt)))
    v = v.withColumn("azimuth_deg", F.degrees(az)).withColumns({f"p{a}": F.col(f"m{a}") + d[i] * standoff for i, a in enumerate("xyz")})
    return v.withColumn("rotation", look_at(*[F.col(f"m{a}") - F.col(f"p{a}") for a in "xyz"]))


def look_at(dx, dy, dz):
    """Rows of the rotation whose z axis points along the direction; x is taken as up where the direction is nearly vertical."""
    n = F.sqrt(dx * dx + dy * dy + dz * dz)
    z = (dx / n, dy / n, dz / n)
    steep = F.abs(z[2]) > 0.99
    up = (F.when(steep, 1.0).otherwise(0.0), F.lit(0.0), F.when(steep, 0.0).otherwise(1.0))
    x = (up[1] * z[2] - up[2] * z[1], up[2] * z[0] - up[0] * z[2], up[0] * z[1] - up[1] * z[0])
    m = F.sqrt(x[0] * x[0] + x[1] * x[1] + x[2] * x[2])
    x = tuple(c / m for c in x)
    y = (z[1] * x[2] - z[2] * x[1], z[2] * x[0] - z[0] * x[2], z[0] * x[1] - z[1] * x[0])
    return F.array(*[F.array(x[i].cast("float"), y[i].cast("float"), z[i].cast("float")) for i in range(3)])


def waypoints(views: DataFrame, origin: DataFrame, group: str) -> DataFrame:
    """Adds latitude, longitude and altitude of each viewpoint (lat, lon, alt) and of the cell's centre it looks at (target_lat, target_lon, target_alt).

    origin has the group, lat0, lon0, alt0; groups without an origin drop out.
    """
    v = views.join(origin, group)
    for prefix, at in (("", "p"), ("target_", "m")):
        names = [f"{prefix}{c}" for c in ("lat", "lon", "alt")]
        v = v.withColumns(dict(zip(names, geo.enu_to_geodetic(*[F.col(f"{at}{c}") for c in "xyz"], F.col("lat0"), F.col("lon0"), F.col("alt0")))))
    return v.drop("lat0", "lon0", "alt0")
