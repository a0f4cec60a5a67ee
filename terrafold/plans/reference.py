"""Queries of the mapping operators over the test tables, each with the equivalent SQL where SQL can say it."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from terrafold.operators import align, geo, joins, mesh, planner, points, segments, voxel
from terrafold.sources import formats
from terrafold.session import ensure_checkpoint_dir
from terrafold.streaming import keyframes, stats

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


#: Added before rounding on both sides, so that exact halves do not fall either way by the order of a sum.
NUDGE = 3.3e-8


def nudged(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c) + NUDGE, 6) for c in cols})


def rounded(df: DataFrame, digits: int, *cols: str) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in cols})


# --- voxels and the site ---------------------------------------------------------------------------------------------

@query("""
WITH c AS (SELECT *, floor(x / 0.5)::BIGINT AS vx, floor(y / 0.5)::BIGINT AS vy, floor(z / 0.5)::BIGINT AS vz FROM site WHERE isfinite(x) AND isfinite(y) AND isfinite(z) AND isfinite(conf)),
w AS (SELECT vx, vy, vz, CASE WHEN sum(conf) > 0 THEN sum(conf) ELSE 1 END AS w FROM c GROUP BY ALL),
top AS (SELECT vx, vy, vz, source FROM c QUALIFY row_number() OVER (PARTITION BY vx, vy, vz ORDER BY conf DESC, ord DESC, source DESC NULLS LAST) = 1)
SELECT vx, vy, vz, round(sum(conf * x / w) + 3.3e-8, 6) AS x, round(sum(conf * y / w) + 3.3e-8, 6) AS y, round(sum(conf * z / w) + 3.3e-8, 6) AS z,
  trunc(least(greatest(sum(conf * r) / max(w) + 1e-9, 0), 255))::INT AS r, trunc(least(greatest(sum(conf * g) / max(w) + 1e-9, 0), 255))::INT AS g, trunc(least(greatest(sum(conf * b) / max(w) + 1e-9, 0), 255))::INT AS b, greatest(0, max(conf)) AS conf, min(top.source) AS source, count(*) AS n
FROM c JOIN w USING (vx, vy, vz) JOIN top USING (vx, vy, vz) GROUP BY vx, vy, vz
""")
def voxel_merge(spark, d):
    return nudged(voxel.voxel_merge(table(spark, d, "site"), 0.5), "x", "y", "z").select("vx", "vy", "vz", "x", "y", "z", "r", "g", "b", "conf", "source", "n")


@query("""
WITH c AS (SELECT *, floor(x / 2)::BIGINT AS vx, floor(y / 2)::BIGINT AS vy, floor(z / 2)::BIGINT AS vz FROM site WHERE isfinite(x) AND isfinite(y) AND isfinite(z) AND isfinite(conf))
SELECT vx, vy, vz, round(sum(conf * r) / CASE WHEN sum(conf) > 0 THEN sum(conf) ELSE 1 END + 3.3e-6, 4) AS red, round(sum(conf * g) / CASE WHEN sum(conf) > 0 THEN sum(conf) ELSE 1 END + 3.3e-6, 4) AS green, round(sum(conf * b) / CASE WHEN sum(conf) > 0 THEN sum(conf) ELSE 1 END + 3.3e-6, 4) AS blue
FROM c GROUP BY vx, vy, vz
""")
def weighted_colour(spark, d):
    p = table(spark, d, "site")
    w = F.when(F.sum("conf") > 0, F.sum("conf")).otherwise(1.0)
    return p.groupBy(*voxel.voxel_key(2.0)).agg(*[F.round(F.sum(F.col("conf") * F.col(c)) / w + 3.3e-6, 4).alias(n) for c, n in (("r", "red"), ("g", "green"), ("b", "blue"))])


@query("SELECT DISTINCT floor(x / 0.1)::BIGINT AS vx, floor(y / 0.1)::BIGINT AS vy, floor(z / 0.1)::BIGINT AS vz FROM site")
def voxel_keys(spark, d):
    return table(spark, d, "site").select(*voxel.voxel_key(0.1)).distinct()


def _fold_sql(steps: int) -> str:
    """The fold as nested queries over maps 0..steps-1, cells 2 m wide. Every row of the site belongs to one of the maps, by its source."""
    q = "SELECT 0 AS step, ord, x + 0.37 AS x, y + 0.37 AS y, z + 0.37 AS z, conf, source FROM s WHERE source = 0"
    merged = ""
    for k in range(steps):
        if k:
            q = f"SELECT 0 AS step, 0 AS ord, x, y, z, conf, source FROM m{k - 1} UNION ALL SELECT 1, ord, x + 0.37, y + 0.37, z + 0.37, conf, source FROM s WHERE source = {k}"
        merged += f""", m{k} AS (
  SELECT floor(x / 2) AS vx, floor(y / 2) AS vy, floor(z / 2) AS vz, sum(conf * x) / CASE WHEN sum(conf) > 0 THEN sum(conf) ELSE 1 END AS x, sum(conf * y) / CASE WHEN sum(conf) > 0 THEN sum(conf) ELSE 1 END AS y,
    sum(conf * z) / CASE WHEN sum(conf) > 0 THEN sum(conf) ELSE 1 END AS z, greatest(0, max(conf)) AS conf, arg_max(source, (conf, step, ord, source)) AS source FROM ({q}) GROUP BY 1, 2, 3)"""
    return f"WITH s AS (SELECT * REPLACE (least(coalesce(source, 0) // 3, {steps - 1}) AS source) FROM site WHERE isfinite(x) AND isfinite(y) AND isfinite(z) AND isfinite(conf)){merged} SELECT round(x, 5) AS x, round(y, 5) AS y, round(z, 5) AS z, conf, source FROM m{steps - 1}"


def _fold(spark, d, steps=3):
    s = table(spark, d, "site").withColumns({c: F.col(c) + 0.37 for c in ("x", "y", "z")})
    s = s.withColumn("source", F.least(F.floor(F.coalesce("source", F.lit(0)) / 3), F.lit(steps - 1)).cast("long"))
    return voxel.grow_all([s.where(F.col("source") == k) for k in range(steps)], 2.0)


@query(_fold_sql(3))
def site_grow_fold(spark, d):
    return rounded(_fold(spark, d), 5, "x", "y", "z").select("x", "y", "z", "conf", "source")


@query(f"WITH f AS ({_fold_sql(3)}) SELECT x, y, z, conf, CASE WHEN source > 1 THEN source - 1 ELSE source END AS source FROM f WHERE source <> 1")
def site_drop(spark, d):
    return rounded(voxel.drop_source(_fold(spark, d), 1), 5, "x", "y", "z").select("x", "y", "z", "conf", "source")


@query("SELECT ord, CASE WHEN source > 2 THEN source - 1 ELSE source END AS source FROM site WHERE source IS DISTINCT FROM 2")
def source_renumber(spark, d):
    return voxel.drop_source(table(spark, d, "site"), 2).select("ord", "source")


@query("SELECT ord, source, 0 AS part FROM site UNION ALL SELECT ord, source, 1 FROM site_batches WHERE isfinite(x) AND isfinite(y) AND isfinite(z)")
def union_maps(spark, d):
    """All rows of the site, then those of the batches that have a position."""
    new = table(spark, d, "site_batches").where(points.finite_xyz())
    return table(spark, d, "site").select("ord", "source", F.lit(0).alias("part")).unionByName(new.select("ord", "source", F.lit(1).alias("part")))


@query("SELECT DISTINCT s.source, m.map_id FROM site s JOIN (SELECT row_number() OVER (ORDER BY map_id) - 1 AS source, map_id FROM (SELECT DISTINCT map_id FROM georefs)) m USING (source) WHERE m.map_id IN (SELECT map_id FROM maps)")
def site_semi(spark, d):
    """Maps of the site that the catalogue holds."""
    listed = points.numbered(table(spark, d, "georefs").select("map_id").distinct(), ["map_id"], "source")
    of_site = listed.join(table(spark, d, "site").select("source").distinct(), "source", "left_semi")
    return segments.listed_maps(of_site, table(spark, d, "maps")).select("source", "map_id")


# --- confidence ------------------------------------------------------------------------------------------------------

@query("""
WITH t AS (SELECT source, quantile_cont(conf, 0.1) AS cut, bool_or(isnan(conf)) AS bad FROM site GROUP BY source)
SELECT s.ord, s.source, s.conf FROM site s JOIN t ON s.source IS NOT DISTINCT FROM t.source
WHERE NOT bad AND isfinite(x) AND isfinite(y) AND isfinite(z) AND conf > 1e-6 AND conf >= cut
""")
def confidence_mask(spark, d):
    return points.confidence_mask(table(spark, d, "site"), "source").select("ord", "source", "conf")


_BAND = """
v AS (SELECT * FROM site WHERE isfinite(x) AND isfinite(y) AND isfinite(z) AND isfinite(conf) AND source IS NOT NULL),
t AS (SELECT source, quantile_cont(conf, 0.6) AS lo, quantile_cont(conf, 0.8) AS hi FROM v GROUP BY source),
b0 AS (SELECT v.* FROM v JOIN t USING (source) WHERE lo < hi AND conf >= lo AND conf < hi),
b AS (SELECT * FROM b0 WHERE source IN (SELECT source FROM b0 GROUP BY source HAVING count(*) >= 30))"""


@query(f"WITH {_BAND} SELECT ord, source, conf FROM b")
def confidence_band(spark, d):
    return points.confidence_band(table(spark, d, "site"), "source").select("ord", "source", "conf")


_KEPT = """t AS (SELECT source, quantile_cont(conf, 0.1) AS cut, bool_or(isnan(conf)) AS bad FROM site GROUP BY source),
k AS (SELECT s.* FROM site s JOIN t ON s.source IS NOT DISTINCT FROM t.source WHERE NOT bad AND isfinite(x) AND isfinite(y) AND isfinite(z) AND conf > 1e-6 AND conf >= cut)"""


@query(f"""
WITH {_KEPT}, n AS (SELECT source, count(*) AS total FROM site GROUP BY source), m AS (SELECT source, count(*) AS high, avg(conf) AS mean, stddev_pop(conf) AS std FROM k GROUP BY source)
SELECT n.source, total, coalesce(high, 0) AS high, round(coalesce(mean, 0) + 3.3e-8, 6) AS mean_conf, round(coalesce(std, 0) + 3.3e-8, 6) AS std_conf, round(coalesce(high, 0) / total + 3.3e-8, 6) AS coverage FROM n LEFT JOIN m ON n.source IS NOT DISTINCT FROM m.source
""")
def confidence_report(spark, d):
    return nudged(points.confidence_report(table(spark, d, "site"), "source"), "mean_conf", "std_conf", "coverage")


@query(f"""
WITH {_KEPT} SELECT n.source, count(k.ord) AS num_points, round(avg(k.conf) + 3.3e-8, 6) AS mean_confidence, round(quantile_cont(k.conf, 0.5) + 3.3e-8, 6) AS median_confidence
FROM (SELECT DISTINCT source FROM site) n LEFT JOIN k ON n.source IS NOT DISTINCT FROM k.source GROUP BY n.source
""")
def confidence_stats(spark, d):
    return nudged(points.confidence_stats(table(spark, d, "site"), "source"), "mean_confidence", "median_confidence")


@query("""
SELECT source, round(sqrt(pow(max(x) - min(x), 2) + pow(max(y) - min(y), 2) + pow(max(z) - min(z), 2)) + 3.3e-8, 6) AS extent, round(avg(x) + 3.3e-8, 6) AS cx, round(avg(y) + 3.3e-8, 6) AS cy, round(avg(z) + 3.3e-8, 6) AS cz
FROM site WHERE isfinite(x) AND isfinite(y) AND isfinite(z) GROUP BY source
""")
def scene_extent(spark, d):
    return nudged(points.extent_and_centroid(table(spark, d, "site"), "source"), "extent", "cx", "cy", "cz")


@query("SELECT ord, trunc((1 - least(greatest(conf / 25.0, 0), 1)) * 255)::INT AS red, trunc(least(greatest(conf / 25.0, 0), 1) * 255)::INT AS green, 0 AS blue FROM site")
def confidence_ramp(spark, d):
    return table(spark, d, "site").select("ord", *[c.alias(k) for k, c in points.ramp(F.col("conf")).items()])


@query("""
SELECT ord, round(v, 9) AS v, trunc((1 - v) * 255)::INT AS red, trunc(v * 255)::INT AS green, 0 AS blue
FROM (SELECT ord, CASE WHEN hi > lo THEN (conf - lo) / (hi - lo) ELSE 1 END AS v FROM (SELECT ord, conf, min(conf) OVER (PARTITION BY source) AS lo, max(conf) OVER (PARTITION BY source) AS hi FROM site))
""")
def minmax_ramp(spark, d):
    return points.minmax_ramp(table(spark, d, "site"), "source").select("ord", F.round("v", 9).alias("v"), "red", "green", "blue")


_HUE = """
SELECT {i} AS source, trunc(CASE s WHEN 0 THEN 1.0 WHEN 1 THEN 1 - 0.9 * f WHEN 2 THEN 0.1 WHEN 3 THEN 0.1 WHEN 4 THEN 1 - 0.9 * (1 - f) ELSE 1.0 END * 255 + 1e-9)::INT AS red,
 trunc(CASE s WHEN 0 THEN 1 - 0.9 * (1 - f) WHEN 1 THEN 1.0 WHEN 2 THEN 1.0 WHEN 3 THEN 1 - 0.9 * f ELSE 0.1 END * 255 + 1e-9)::INT AS green,
 trunc(CASE s WHEN 0 THEN 0.1 WHEN 1 THEN 0.1 WHEN 2 THEN 1 - 0.9 * (1 - f) WHEN 3 THEN 1.0 WHEN 4 THEN 1.0 ELSE 1 - 0.9 * f END * 255 + 1e-9)::INT AS blue
FROM (SELECT source, floor(h) AS s, h - floor(h) AS f FROM (SELECT DISTINCT source, (source * 0.6180339887::DOUBLE % 1) * 6 AS h FROM site WHERE source IS NOT NULL))
"""


@query(f"WITH p AS ({_HUE.format(i='source')}) SELECT ord, red, green, blue FROM site JOIN p USING (source)")
def palette_join(spark, d):
    s = table(spark, d, "site")
    return s.select("ord", "source").join(points.palette(s, "source"), "source").select("ord", "red", "green", "blue")


@query("SELECT ord, trunc(r * 0.35::DOUBLE)::INT AS r, trunc(g * 0.35::DOUBLE)::INT AS g, trunc(b * 0.35::DOUBLE)::INT AS b FROM site")
def dim_background(spark, d):
    return table(spark, d, "site").select("ord", *[points.dim(F.col(c)).alias(c) for c in ("r", "g", "b")])


@query("SELECT ord, trunc(conf / 25 * 255)::INT AS raw, trunc(least(greatest(conf / 25, 0), 1) * 255)::INT AS clipped FROM site")
def colour_quantise(spark, d):
    return table(spark, d, "site").select("ord", points.quantise(F.col("conf") / 25).alias("raw"), points.quantise(F.col("conf") / 25, True).alias("clipped"))


@query("SELECT ord, CASE WHEN (r / 255.0)::DOUBLE > 0.1 THEN conf ELSE 0 END AS conf FROM site")
def sky_zero(spark, d):
    return table(spark, d, "site").select("ord", points.zero_sky(F.col("conf"), F.col("r") / 255.0).alias("conf"))


# --- frames' geometry ------------------------------------------------------------------------------------------------

_FIRST_GEOREF = "(SELECT map_id, s, r, t, lat0, lon0, alt0 FROM georefs QUALIFY row_number() OVER (PARTITION BY map_id ORDER BY s, lat0, lon0, alt0 NULLS FIRST) = 1)"
_CAM = "(SELECT DISTINCT map_id, frame, cx, cy, cz FROM cameras)"


def _georefs(spark, d):
    w = Window.partitionBy("map_id").orderBy("s", "lat0", "lon0", F.asc_nulls_first("alt0"))
    return table(spark, d, "georefs").withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def _cameras(spark, d):
    return table(spark, d, "cameras").select("map_id", "frame", "cx", "cy", "cz").distinct()


def _moved(spark, d):
    return geo.apply_georefs(_cameras(spark, d), _georefs(spark, d), ("cx", "cy", "cz"))


_MOVED = f"""moved AS (SELECT c.map_id, c.frame, lat0, lon0, alt0, s * (r[1][1] * cx + r[1][2] * cy + r[1][3] * cz) + t[1] AS e, s * (r[2][1] * cx + r[2][2] * cy + r[2][3] * cz) + t[2] AS n, s * (r[3][1] * cx + r[3][2] * cy + r[3][3] * cz) + t[3] AS u
  FROM {_CAM} c JOIN {_FIRST_GEOREF} g USING (map_id))"""


@query(f"WITH {_MOVED} SELECT map_id, frame, round(e, 6) AS e, round(n, 6) AS n, round(u, 6) AS u FROM moved")
def sim3_apply(spark, d):
    return rounded(_moved(spark, d), 6, "e", "n", "u").select("map_id", "frame", "e", "n", "u")


@query(f"WITH {_MOVED} SELECT map_id, frame, round(-e, 6) AS x, round(u, 6) AS y, round(n, 6) AS z FROM moved")
def y_up_scene(spark, d):
    return _moved(spark, d).select("map_id", "frame", *[F.round(c, 6).alias(a) for a, c in zip("xyz", geo.y_up(F.col("e"), F.col("n"), F.col("u")))])


def _ecef_sql(lat: str, lon: str, alt: str, k: str) -> str:
    n = f"(6378137.0 / sqrt(1 - 0.0066943799901413165 * pow(sin(radians({lat})), 2)))"
    return f"({n} + {alt}) * cos(radians({lat})) * cos(radians({lon})) AS x{k}, ({n} + {alt}) * cos(radians({lat})) * sin(radians({lon})) AS y{k}, ({n} * (1 - 0.0066943799901413165) + {alt}) * sin(radians({lat})) AS z{k}"


_GPS = """(SELECT map_id, frame, gps.lat AS lat, gps.lon AS lon, gps.alt AS alt FROM cameras WHERE gps.lat IS NOT NULL AND gps.lon IS NOT NULL AND isfinite(gps.lat) AND isfinite(gps.lon) AND abs(gps.lat) <= 90 AND abs(gps.lon) <= 180 AND (gps.alt IS NULL OR isfinite(gps.alt)))"""


def _gps(spark, d):
    c = table(spark, d, "cameras").select("map_id", "frame", "gps.lat", "gps.lon", "gps.alt")
    ok = points.is_finite(F.col("lat")) & points.is_finite(F.col("lon")) & (F.abs("lat") <= 90) & (F.abs("lon") <= 180) & (F.col("alt").isNull() | points.is_finite(F.col("alt")))
    return c.where(ok)


_ENU = f"""p AS (SELECT *, {_ecef_sql("lat", "lon", "coalesce(alt, 0)", "")}, {_ecef_sql("lat0", "lon0", "coalesce(alt0, 0)", "0")}, radians(lat0) AS f, radians(lon0) AS l FROM {_GPS} c JOIN {_FIRST_GEOREF} g USING (map_id)),
enu AS (SELECT map_id, frame, -sin(l) * (x - x0) + cos(l) * (y - y0) AS e, -sin(f) * cos(l) * (x - x0) - sin(f) * sin(l) * (y - y0) + cos(f) * (z - z0) AS n, cos(f) * cos(l) * (x - x0) + cos(f) * sin(l) * (y - y0) + sin(f) * (z - z0) AS u FROM p)"""


@query(f"WITH {_ENU} SELECT DISTINCT map_id, frame, round(e, 3) + 0.0 AS e, round(n, 3) + 0.0 AS n, round(u, 3) + 0.0 AS u FROM enu")
def geodetic_to_enu(spark, d):
    j = _gps(spark, d).join(_georefs(spark, d), "map_id")
    e, n, u = geo.geodetic_to_enu(*[F.col(c) for c in ("lat", "lon", "alt", "lat0", "lon0", "alt0")])
    return j.select("map_id", "frame", (F.round(e, 3) + 0.0).alias("e"), (F.round(n, 3) + 0.0).alias("n"), (F.round(u, 3) + 0.0).alias("u")).distinct()


@query(f"""WITH {_MOVED},
w AS (SELECT *, {_ecef_sql("lat0", "lon0", "coalesce(alt0, 0)", "0")}, radians(lat0) AS f, radians(lon0) AS l FROM moved),
q AS (SELECT map_id, frame, x0 - sin(l) * e - sin(f) * cos(l) * n + cos(f) * cos(l) * u AS x, y0 + cos(l) * e - sin(f) * sin(l) * n + cos(f) * sin(l) * u AS y, z0 + cos(f) * n + sin(f) * u AS z FROM w),
h AS (SELECT *, sqrt(x * x + y * y) AS r, atan2(z * 6378137.0, sqrt(x * x + y * y) * 6356752.314245179) AS th FROM q),
a AS (SELECT *, atan2(z + 0.006739496742276435 * 6356752.314245179 * pow(sin(th), 3), r - 0.0066943799901413165 * 6378137.0 * pow(cos(th), 3)) AS lat FROM h)
SELECT map_id, frame, round(degrees(lat), 9) AS lat, round(degrees(atan2(y, x)), 9) AS lon, round(r * cos(lat) + z * sin(lat) - 6378137.0 * sqrt(1 - 0.0066943799901413165 * pow(sin(lat), 2)), 4) AS alt FROM a""")
def enu_to_geodetic(spark, d):
    lat, lon, alt = geo.enu_to_geodetic(*[F.col(c) for c in ("e", "n", "u", "lat0", "lon0", "alt0")])
    return _moved(spark, d).select("map_id", "frame", F.round(lat, 9).alias("lat"), F.round(lon, 9).alias("lon"), F.round(alt, 4).alias("alt"))


 
@query(f"""WITH {_MOVED}, p AS (SELECT m.*, {_ecef_sql("lat0", "lon0", "coalesce(alt0, 0)", "0")}, {_ecef_sql("lat0 + 0.01", "lon0 - 0.01", "coalesce(alt0, 0) + 25", "9")}, radians(lat0) AS f, radians(lon0) AS l, radians(lat0 + 0.01) AS f2, radians(lon0 - 0.01) AS l2 FROM moved m),
q AS (SELECT *, x0 - sin(l) * e - sin(f) * cos(l) * n + cos(f) * cos(l) * u - x9 AS dx, y0 + cos(l) * e - sin(f) * sin(l) * n + cos(f) * sin(l) * u - y9 AS dy, z0 + cos(f) * n + sin(f) * u - z9 AS dz FROM p)
SELECT map_id, frame, round(-sin(l2) * dx + cos(l2) * dy + 3.3e-5, 3) AS e2, round(-sin(f2) * cos(l2) * dx - sin(f2) * sin(l2) * dy + cos(f2) * dz + 3.3e-5, 3) AS n2, round(cos(f2) * cos(l2) * dx + cos(f2) * sin(l2) * dy + sin(f2) * dz + 3.3e-5, 3) AS u2, true AS back FROM q""")
def enu_rebase_round_trip(spark, d):
    """Moves each point to an origin nearby and back: e2, n2, u2 about the other origin; back says that it returned within ten micrometres."""
    m = _moved(spark, d)
    o = (F.col("lat0"), F.col("lon0"), F.col("alt0"))
    o2 = (F.col("lat0") + 0.01, F.col("lon0") - 0.01, F.coalesce("alt0", F.lit(0.0)) + 25)
    x = geo.rebase_enu(m, ("e", "n", "u"), o, o2, ("e2", "n2", "u2"))
    y = geo.rebase_enu(x, ("e2", "n2", "u2"), o2, o, ("e3", "n3", "u3"))
    moved = [F.round(F.col(c) + 3.3e-5, 3).alias(c) for c in ("e2", "n2", "u2")]
    return y.select("map_id", "frame", *moved, (F.greatest(*[F.abs(F.col(f"{c}3") - F.col(c)) for c in ("e", "n", "u")]) < 1e-5).alias("back"))


@query(f"""SELECT map_id, round(-(r[1][1] * t[1] + r[2][1] * t[2] + r[3][1] * t[3]), 6) AS px, round(-(r[1][2] * t[1] + r[2][2] * t[2] + r[3][2] * t[3]), 6) AS py, round(-(r[1][3] * t[1] + r[2][3] * t[2] + r[3][3] * t[3]), 6) AS pz, r[2][1] AS r01 FROM {_FIRST_GEOREF}""")
def camera_pose(spark, d):
    g = _georefs(spark, d).withColumns(points.camera_pose(F.col("r"), F.col("t")))
    return rounded(g, 6, "px", "py", "pz").select("map_id", "px", "py", "pz", F.col("rotation")[0][1].alias("r01"))


@query("SELECT stream, frame_id, CASE WHEN latitude IS NULL OR longitude IS NULL OR isnan(latitude) OR isnan(longitude) THEN 0 ELSE 1 END AS has_fix FROM frames")
def gps_decode(spark, d):
    f = table(spark, d, "frames")
    return f.select("stream", "frame_id", F.when(geo.decode_fix(F.col("latitude"), F.col("longitude"), F.col("altitude")).isNull(), 0).otherwise(1).alias("has_fix"))


_GRID = 'SELECT vec_id, ((k - 1) // 8)::INT AS "row", ((k - 1) % 8)::INT AS col, v::DOUBLE AS v FROM (SELECT vec_id, unnest(embedding) AS v, generate_subscripts(embedding, 1) AS k FROM embeddings)'


def _grid(spark, d):
    return points.flatten_grid(table(spark, d, "embeddings"), "embedding", 8, ["vec_id"]).select("vec_id", "row", "col", F.col("value").cast("double").alias("v"))


@query(f"SELECT vec_id, \"row\", col, v, vec_id * 64 + \"row\" * 8 + col AS ord FROM ({_GRID})")
def grid_flatten(spark, d):
    return _grid(spark, d).withColumn("ord", (F.col("vec_id") * 8 + F.col("row")) * 8 + F.col("col"))


@query(f'SELECT vec_id, "row", col, v FROM ({_GRID}) WHERE "row" % 3 = 0 AND col % 3 = 0')
def stride_sample(spark, d):
    return points.stride_sample(_grid(spark, d), 3)


@query("SELECT 5000 < count(*) AS capped, least(count(*), 5000) AS n, least(count(*), 5000) AS known, true AS stable FROM (SELECT DISTINCT ord, conf FROM site)")
def random_sample(spark, d):
    """The sample's size, how many of its rows are the table's, and whether a second draw gives the same rows."""
    rows = table(spark, d, "site").select("ord", "conf").distinct()
    one, two = points.random_sample(rows, 5000, "ord"), points.random_sample(rows, 5000, "ord")
    size = one.agg(F.count(F.lit(1)).alias("n")).withColumn("_k", F.lit(1))
    known = one.join(rows, ["ord", "conf"], "left_semi").agg(F.count(F.lit(1)).alias("known")).withColumn("_k", F.lit(1))
    again = two.join(one, ["ord", "conf"], "left_semi").agg(F.count(F.lit(1)).alias("again")).withColumn("_k", F.lit(1))
    total = rows.agg(F.count(F.lit(1)).alias("total")).withColumn("_k", F.lit(1))
    return total.join(size, "_k").join(known, "_k").join(again, "_k").select((F.col("total") > 5000).alias("capped"), "n", "known", (F.col("n") == F.col("again")).alias("stable"))


@query(f'SELECT vec_id, "row", col, round((col - 3.5) / 6.0 * (2 + v), 9) AS x, round(("row" - 3.5) / 5.0 * (2 + v), 9) AS y, round(2 + v - 0.5, 9) AS z FROM ({_GRID})')
def depth_unproject(spark, d):
    eye = F.array(*[F.array(*[F.lit(1.0 if i == j else 0.0) for j in range(3)]) for i in range(3)])
    t = F.array(F.lit(0.0), F.lit(0.0), F.lit(0.5))
    xyz = points.unproject(F.col("col"), F.col("row"), F.col("v") + 2, (F.lit(6.0), F.lit(5.0), F.lit(3.5), F.lit(3.5)), eye, t)
    return _grid(spark, d).select("vec_id", "row", "col", *[F.round(c, 9).alias(a) for a, c in zip("xyz", xyz)])


def _mesh_grid(spark, d):
    return _grid(spark, d).select("vec_id", "row", "col", F.col("col").cast("double").alias("x"), F.col("row").cast("double").alias("y"), (F.col("v") * 10).alias("z"), (F.col("v") > -0.15).alias("kept"))


_FACES = f"""g AS (SELECT vec_id, "row" AS rw, col, col::DOUBLE AS x, "row"::DOUBLE AS y, v * 10 AS z, v > -0.15 AS k FROM ({_GRID})),
q AS (SELECT a.vec_id, a.rw, a.col, a.k AS ka, b.k AS kb, c.k AS kc, e.k AS kd, sqrt(1 + pow(a.z - b.z, 2)) AS ab, sqrt(1 + pow(b.z - c.z, 2)) AS bc, sqrt(2 + pow(a.z - c.z, 2)) AS ac, sqrt(1 + pow(c.z - e.z, 2)) AS cd, sqrt(1 + pow(a.z - e.z, 2)) AS ad
  FROM g a JOIN g b ON a.vec_id = b.vec_id AND a.rw = b.rw AND b.col = a.col + 1 JOIN g c ON a.vec_id = c.vec_id AND c.rw = a.rw + 1 AND c.col = a.col + 1 JOIN g e ON a.vec_id = e.vec_id AND e.rw = a.rw + 1 AND e.col = a.col),
f AS (SELECT vec_id, rw, col, 0 AS half, greatest(ab, bc, ac) AS longest FROM q WHERE ka AND kb AND kc UNION ALL SELECT vec_id, rw, col, 1, greatest(ac, cd, ad) FROM q WHERE ka AND kc AND kd)"""


@query(f'WITH {_FACES} SELECT vec_id, rw AS "row", col, half, round(longest, 9) AS longest FROM f')
def triangulate_grid(spark, d):
    return mesh.triangles(_mesh_grid(spark, d), ["vec_id"]).select("vec_id", "row", "col", "half", F.round("longest", 9).alias("longest"))


@query(f'WITH {_FACES}, m AS (SELECT vec_id, quantile_cont(longest, 0.5) AS m FROM f GROUP BY vec_id) SELECT vec_id, count(*) AS faces FROM f JOIN m USING (vec_id) WHERE longest < 1.3 * m GROUP BY vec_id')
def drop_long_edges(spark, d):
    return mesh.drop_long(mesh.triangles(_mesh_grid(spark, d), ["vec_id"]), ["vec_id"], 1.3).groupBy("vec_id").agg(F.count(F.lit(1)).alias("faces"))


@query(f"""WITH g AS (SELECT vec_id, "row" AS rw, col, v * 10 AS z, v > -0.15 AS k FROM ({_GRID})),
q AS (SELECT a.vec_id, a.rw, a.col, a.k AND b.k AND c.k AS t0, a.k AND c.k AND e.k AS t1 FROM g a JOIN g b ON a.vec_id = b.vec_id AND a.rw = b.rw AND b.col = a.col + 1 JOIN g c ON a.vec_id = c.vec_id AND c.rw = a.rw + 1 AND c.col = a.col + 1 JOIN g e ON a.vec_id = e.vec_id AND e.rw = a.rw + 1 AND e.col = a.col),
u AS (SELECT vec_id, rw, col FROM q WHERE t0 OR t1 UNION SELECT vec_id, rw, col + 1 FROM q WHERE t0 UNION SELECT vec_id, rw + 1, col + 1 FROM q WHERE t0 OR t1 UNION SELECT vec_id, rw + 1, col FROM q WHERE t1)
SELECT DISTINCT vec_id, col::DOUBLE AS x, rw::DOUBLE AS y, z FROM u JOIN g USING (vec_id, rw, col)""")
def mesh_vertices(spark, d):
    return mesh.vertices(mesh.triangles(_mesh_grid(spark, d), ["vec_id"]), ["vec_id"])


_ORDERED = f"(SELECT *, row_number() OVER (ORDER BY map_id) - 1 AS i, count(*) OVER () AS total FROM {_FIRST_GEOREF})"


@query(f"""WITH z AS (SELECT map_id, 0.1 * sqrt(pow(quantile_cont(cx, 0.95) - quantile_cont(cx, 0.05), 2) + pow(quantile_cont(cy, 0.95) - quantile_cont(cy, 0.05), 2) + pow(quantile_cont(cz, 0.95) - quantile_cont(cz, 0.05), 2)) AS size FROM {_CAM} WHERE isfinite(cx) AND isfinite(cy) AND isfinite(cz) GROUP BY map_id),
k AS (SELECT * FROM (VALUES (0, 0.0, 0.0, 0.0), (1, -0.5, -0.375, 1.0), (2, 0.5, -0.375, 1.0), (3, 0.5, 0.375, 1.0), (4, -0.5, 0.375, 1.0)) v(vertex, a, b, c)),
w AS (SELECT map_id, vertex, r, t, a::DOUBLE * size AS a, b::DOUBLE * size AS b, c::DOUBLE * size AS c FROM {_FIRST_GEOREF} JOIN z USING (map_id), k)
SELECT map_id, vertex, round(-(r[1][1] * t[1] + r[2][1] * t[2] + r[3][1] * t[3]) + r[1][1] * a + r[1][2] * b + r[1][3] * c, 6) + 0.0 AS vx, round(-(r[1][2] * t[1] + r[2][2] * t[2] + r[3][2] * t[3]) + r[2][1] * a + r[2][2] * b + r[2][3] * c, 6) + 0.0 AS vy,
  round(-(r[1][3] * t[1] + r[2][3] * t[2] + r[3][3] * t[3]) + r[3][1] * a + r[3][2] * b + r[3][3] * c, 6) + 0.0 AS vz FROM w""")
def camera_frustums(spark, d):
    g = _georefs(spark, d).withColumns(points.camera_pose(F.col("r"), F.col("t")))
    size = points.frustum_size(_cameras(spark, d).select("map_id", F.col("cx").alias("x"), F.col("cy").alias("y"), F.col("cz").alias("z")), "map_id")
    return points.frustums(g.join(size, "map_id"), "size").select("map_id", "vertex", *[(F.round(c, 6) + 0.0).alias(c) for c in ("vx", "vy", "vz")])


@query(f"""WITH h AS (SELECT map_id, i, i::DOUBLE / total * 6 AS h FROM {_ORDERED}), k AS (SELECT unnest(range(4)) AS face)
SELECT map_id, face::INT AS face, i * 5 AS a, i * 5 + 1 + face AS b, i * 5 + 1 + (face + 1) % 4 AS c,
  trunc(255 * CASE floor(h) WHEN 0 THEN 1 WHEN 1 THEN 1 - (h - floor(h)) WHEN 2 THEN 0 WHEN 3 THEN 0 WHEN 4 THEN h - floor(h) ELSE 1 END)::INT AS red,
  trunc(255 * CASE floor(h) WHEN 0 THEN h - floor(h) WHEN 1 THEN 1 WHEN 2 THEN 1 WHEN 3 THEN 1 - (h - floor(h)) ELSE 0 END)::INT AS green,
  trunc(255 * CASE floor(h) WHEN 0 THEN 0 WHEN 1 THEN 0 WHEN 2 THEN h - floor(h) WHEN 3 THEN 1 WHEN 4 THEN 1 ELSE 1 - (h - floor(h)) END)::INT AS blue FROM h, k""")
def frustum_faces(spark, d):
    g = points.numbered(_georefs(spark, d).select("map_id"), ["map_id"], "i")
    n = g.agg(F.count(F.lit(1)).alias("total")).withColumn("_k", F.lit(1))
    return points.frustum_faces(g.withColumn("_k", F.lit(1)).join(n, "_k"), "i", "total").select("map_id", "face", "a", "b", "c", "red", "green", "blue")


@query(f"SELECT map_id, round(0.1 * sqrt(pow(quantile_cont(cx, 0.95) - quantile_cont(cx, 0.05), 2) + pow(quantile_cont(cy, 0.95) - quantile_cont(cy, 0.05), 2) + pow(quantile_cont(cz, 0.95) - quantile_cont(cz, 0.05), 2)), 6) AS size FROM {_CAM} WHERE isfinite(cx) AND isfinite(cy) AND isfinite(cz) GROUP BY map_id")
def frustum_size(spark, d):
    return rounded(points.frustum_size(_cameras(spark, d).select("map_id", F.col("cx").alias("x"), F.col("cy").alias("y"), F.col("cz").alias("z")), "map_id"), 6, "size")


_ALIGNED = ", ".join(f"round(r[1][{i}] * (-cx - t[1]) + r[2][{i}] * (-cy - t[2]) + r[3][{i}] * (cz - t[3]), 6) + 0.0 AS {a}" for i, a in ((1, "x"), (2, "y"), (3, "z")))


@query(f"SELECT map_id, frame, {_ALIGNED} FROM {_CAM} JOIN {_FIRST_GEOREF} USING (map_id)")
def scene_alignment(spark, d):
    """Camera centres by the view of their map's first extrinsic (the table's rotation and translation stand for it)."""
    g = _georefs(spark, d).select("map_id", "r", "t")
    xyz = points.scene_alignment(F.col("cx"), F.col("cy"), F.col("cz"), F.col("r"), F.col("t"))
    return _cameras(spark, d).join(g, "map_id").select("map_id", "frame", *[(F.round(c, 6) + 0.0).alias(a) for a, c in zip("xyz", xyz)])


# --- planning --------------------------------------------------------------------------------------------------------

#: The test site is sparse: wider cells with fewer points than the defaults.
CELL, LEAST = 16.0, 8

_CELLS = f"""{_BAND},
ctr AS (SELECT source, avg(x) AS ax, avg(y) AS ay FROM v GROUP BY source),
cell AS (SELECT b.source, floor((x - ax) / 16)::BIGINT AS ce, floor((y - ay) / 16)::BIGINT AS cn, count(*) AS n, avg(x) AS mx, avg(y) AS my, avg(z) AS mz, covar_samp(x, z) AS cxz, var_samp(z) AS czz FROM b JOIN ctr USING (source) GROUP BY ALL HAVING count(*) >= 8),
rad AS (SELECT b.source, ce, cn, sqrt(max(pow(x - mx, 2) + pow(y - my, 2) + pow(z - mz, 2))) AS radius FROM b JOIN ctr USING (source) JOIN cell ON cell.source = b.source AND ce = floor((x - ax) / 16) AND cn = floor((y - ay) / 16) GROUP BY ALL)"""


@query(f"WITH {_CELLS} SELECT source, ce, cn, n, row_number() OVER (PARTITION BY source ORDER BY ce, cn) - 1 AS k, round(mx + 3.3e-8, 6) AS mx, round(my + 3.3e-8, 6) AS my, round(mz + 3.3e-8, 6) AS mz, round(radius + 3.3e-8, 6) AS radius, round(cxz + 3.3e-8, 6) AS cxz, round(czz + 3.3e-8, 6) AS czz FROM cell JOIN rad USING (source, ce, cn)")
def nfn_cells(spark, d):
    c = planner.cells(table(spark, d, "site"), "source", CELL, LEAST)
    return nudged(c, "mx", "my", "mz", "radius", "cxz", "czz").select("source", "ce", "cn", "n", "k", "mx", "my", "mz", "radius", "cxz", "czz")


_VIEWS = f"""{_CELLS}, kk AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY ce, cn) - 1 AS k FROM cell), rr AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n DESC, k) AS rank, (k * pi() * (3 - sqrt(5))) % (2 * pi()) AS az FROM kk),
views AS (SELECT *, mx + 15 * sin(radians(35)) * sin(az) AS px, my + 15 * sin(radians(35)) * cos(az) AS py, mz + 15 * cos(radians(35)) AS pz FROM rr WHERE rank <= 10)"""


@query(f"WITH {_VIEWS} SELECT source, k, rank, n, round(degrees(az) + 3.3e-8, 6) AS azimuth_deg, round(px + 3.3e-8, 6) AS px, round(py + 3.3e-8, 6) AS py, round(pz + 3.3e-8, 6) AS pz FROM views")
def nfn_viewpoints(spark, d):
    v = planner.viewpoints(planner.cells(table(spark, d, "site"), "source", CELL, LEAST), "source")
    return nudged(v, "azimuth_deg", "px", "py", "pz").select("source", "k", "rank", "n", "azimuth_deg", "px", "py", "pz")


#: Smallest eigenvalue of a symmetric 3 x 3 matrix in closed form, and its direction as the longest cross product of two rows of the rest.
_NORMALS = f"""{_CELLS.replace("covar_samp(x, z) AS cxz", "var_samp(x) AS cxx, covar_samp(x, y) AS cxy, covar_samp(x, z) AS cxz, var_samp(y) AS cyy, covar_samp(y, z) AS cyz")},
q AS (SELECT *, (cxx + cyy + czz) / 3 AS m FROM cell), q2 AS (SELECT *, sqrt((pow(cxx - m, 2) + pow(cyy - m, 2) + pow(czz - m, 2) + 2 * (cxy * cxy + cxz * cxz + cyz * cyz)) / 6) AS s FROM q),
q3 AS (SELECT *, acos(greatest(-1, least(1, ((cxx - m) * ((cyy - m) * (czz - m) - cyz * cyz) - cxy * (cxy * (czz - m) - cyz * cxz) + cxz * (cxy * cyz - (cyy - m) * cxz)) / (2 * s * s * s)))) / 3 AS phi FROM q2),
q4 AS (SELECT *, m + 2 * s * cos(phi + 2 * pi() / 3) AS v FROM q3),
q5 AS (SELECT source, ce, cn, unnest([[cxy * cyz - cxz * (cyy - v), cxz * cxy - (cxx - v) * cyz, (cxx - v) * (cyy - v) - cxy * cxy], [cxy * (czz - v) - cxz * cyz, cxz * cxz - (cxx - v) * (czz - v), (cxx - v) * cyz - cxy * cxz], [(cyy - v) * (czz - v) - cyz * cyz, cyz * cxz - cxy * (czz - v), cxy * cyz - (cyy - v) * cxz]]) AS c FROM q4),
q6 AS (SELECT source, ce, cn, c, sqrt(c[1] * c[1] + c[2] * c[2] + c[3] * c[3]) * CASE WHEN c[3] < 0 THEN -1 ELSE 1 END AS w FROM q5 QUALIFY row_number() OVER (PARTITION BY source, ce, cn ORDER BY c[1] * c[1] + c[2] * c[2] + c[3] * c[3] DESC) = 1)"""


@query(f"WITH {_NORMALS} SELECT source, ce, cn, round(c[1] / w + 3.3e-6, 4) AS nx, round(c[2] / w + 3.3e-6, 4) AS ny, round(c[3] / w + 3.3e-6, 4) AS nz FROM q6")
def nfn_normals(spark, d):
    """Each cell's plane; nz is never negative."""
    c = planner.normals(planner.cells(table(spark, d, "site"), "source", CELL, LEAST))
    return c.select("source", "ce", "cn", *[F.round(F.col(n) + 3.3e-6, 4).alias(n) for n in ("nx", "ny", "nz")])


@query(f"""WITH {_VIEWS}, a AS (SELECT source, rank, mx - px AS dx, my - py AS dy, mz - pz AS dz FROM views), z AS (SELECT *, sqrt(dx * dx + dy * dy + dz * dz) AS n FROM a),
u AS (SELECT source, rank, dx / n AS zx, dy / n AS zy, dz / n AS zz FROM z), x AS (SELECT *, sqrt(zx * zx + zy * zy) AS k FROM u)
SELECT source, rank, round(-zy / k, 5) + 0.0 AS xx, round(zx / k, 5) + 0.0 AS xy, round(-zz * zx / k, 5) + 0.0 AS yx, round(-zz * zy / k, 5) + 0.0 AS yy, round(k, 5) AS yz, round(zx, 5) + 0.0 AS zx, round(zy, 5) + 0.0 AS zy, round(zz, 5) AS zz FROM x""")
def look_at(spark, d):
    """The cameras' axes at the viewpoints: right (xx, xy, 0), up (yx, yy, yz) and view (zx, zy, zz); none looks straight down."""
    v = planner.viewpoints(planner.cells(table(spark, d, "site"), "source", CELL, LEAST), "source")
    at = {"xx": (0, 0), "xy": (1, 0), "yx": (0, 1), "yy": (1, 1), "yz": (2, 1), "zx": (0, 2), "zy": (1, 2), "zz": (2, 2)}
    return v.select("source", "rank", *[(F.round(F.col("rotation")[i][j].cast("double"), 5) + 0.0).alias(k) for k, (i, j) in at.items()])


def _plan(spark, d):
    """Viewpoints of every source, about the origin of the map that has its number in the catalogue of georeferences."""
    v = planner.viewpoints(planner.cells(table(spark, d, "site"), "source", CELL, LEAST), "source")
    origins = points.numbered(_georefs(spark, d).select("map_id", "lat0", "lon0", F.coalesce("alt0", F.lit(0.0)).alias("alt0")), ["map_id"], "source")
    return planner.waypoints(v, origins.drop("map_id"), "source")


def _to_geodetic_sql(rows: str, e: str, n: str, u: str, keep: str) -> str:
    """Latitude, longitude and altitude of east, north, up about lat0, lon0, alt0, as (keep, lat, lon, alt)."""
    return f"""(SELECT {keep}, degrees(la) AS lat, degrees(atan2(y, x)) AS lon, r * cos(la) + z * sin(la) - 6378137.0 * sqrt(1 - 0.0066943799901413165 * pow(sin(la), 2)) AS alt FROM
 (SELECT *, atan2(z + 0.006739496742276435 * 6356752.314245179 * pow(sin(th), 3), r - 0.0066943799901413165 * 6378137.0 * pow(cos(th), 3)) AS la FROM
 (SELECT *, sqrt(x * x + y * y) AS r, atan2(z * 6378137.0, sqrt(x * x + y * y) * 6356752.314245179) AS th FROM
 (SELECT *, x0 - sin(l) * {e} - sin(f) * cos(l) * {n} + cos(f) * cos(l) * {u} AS x, y0 + cos(l) * {e} - sin(f) * sin(l) * {n} + cos(f) * sin(l) * {u} AS y, z0 + cos(f) * {n} + sin(f) * {u} AS z FROM
 (SELECT *, {_ecef_sql("lat0", "lon0", "alt0", "0")}, radians(lat0) AS f, radians(lon0) AS l FROM {rows})))))"""


_PLAN = f"""{_VIEWS}, o AS (SELECT row_number() OVER (ORDER BY map_id) - 1 AS source, lat0, lon0, coalesce(alt0, 0) AS alt0 FROM {_FIRST_GEOREF}), vo AS (SELECT * FROM views JOIN o USING (source)),
plan AS {_to_geodetic_sql("vo", "px", "py", "pz", "source, rank")}, aims AS {_to_geodetic_sql("vo", "mx", "my", "mz", "source, rank")}"""


@query(f"""WITH {_PLAN} SELECT source, rank, round(p.lat, 8) AS lat, round(p.lon, 8) AS lon, round(p.alt, 3) AS alt, round(a.lat, 8) AS target_lat, round(a.lon, 8) AS target_lon, round(a.alt, 3) AS target_alt FROM plan p JOIN aims a USING (source, rank)""")
def plan_waypoints(spark, d):
    p = rounded(rounded(_plan(spark, d), 8, "lat", "lon", "target_lat", "target_lon"), 3, "alt", "target_alt")
    return p.select("source", "rank", "lat", "lon", "alt", "target_lat", "target_lon", "target_alt")


_HEAD = "'<?xml version=\"1.0\" encoding=\"UTF-8\"?>' || chr(10) || '<kml xmlns=\"http://www.opengis.net/kml/2.2\">' || chr(10) || '  <Document>' || chr(10) || '    <name>{name}</name>' || chr(10)"
_TAIL = "chr(10) || '  </Document>' || chr(10) || '</kml>' || chr(10)"
_AT = "printf('%.9f,%.9f,%.3f', lon, lat, coalesce(alt, 0.0))"


@query(f"""WITH {_PLAN}, w AS (SELECT source, rank, round(lat, 7) AS lat, round(lon, 7) AS lon, round(alt, 2) AS alt FROM plan), c AS (SELECT source, avg(lat) AS a, avg(lon) AS o, count(*) AS n FROM w GROUP BY source),
r0 AS (SELECT w.*, round(atan2(lat - a, lon - o), 9) AS th FROM w JOIN c USING (source)), r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY th, rank) AS pos FROM r0),
ring AS (SELECT source, string_agg({_AT}, ' ' ORDER BY pos) || ' ' || min({_AT}) FILTER (WHERE pos = 1) AS ring FROM r GROUP BY source),
p AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY rank) - 1 AS i FROM w),
pins AS (SELECT source, string_agg('    <Placemark><name>v' || i || '</name><Point><altitudeMode>absolute</altitudeMode><coordinates>' || {_AT} || '</coordinates></Point></Placemark>', chr(10) ORDER BY i) AS pins FROM p GROUP BY source)
SELECT source, {_HEAD.format(name="next_flight")} || CASE WHEN n >= 3 THEN '    <Placemark><name>nfn_flight_area</name><Polygon><altitudeMode>absolute</altitudeMode><outerBoundaryIs><LinearRing><coordinates>' || ring || '</coordinates></LinearRing></outerBoundaryIs></Polygon></Placemark>' || chr(10) ELSE '' END || pins || {_TAIL} AS kml
FROM pins JOIN ring USING (source) JOIN c USING (source)""")
def plan_kml(spark, d):
    """The plans' KML from waypoints rounded to 7 decimals and centimetres."""
    return formats.plan_kml(rounded(rounded(_plan(spark, d), 7, "lat", "lon"), 2, "alt"), "source", "rank")


@query(f"WITH {_PLAN} SELECT source, row_number() OVER (PARTITION BY source ORDER BY rank) - 1 AS pos, round(lat, 7) AS lat, round(lon, 7) AS lon, round(alt, 2) AS alt FROM plan")
def plan_kml_scan(spark, d):
    """Waypoints read back from the plan's KML."""
    return rounded(rounded(formats.parse_plan_kml(plan_kml(spark, d), "source"), 7, "lat", "lon"), 2, "alt").select("source", "pos", "lat", "lon", "alt")


_FIXED = "(SELECT map_id, frame, min(lat) AS lat, min(lon) AS lon, min(alt) AS alt FROM " + _GPS + " GROUP BY map_id, frame)"


def _fixed(spark, d):
    return _gps(spark, d).groupBy("map_id", "frame").agg(F.min("lat").alias("lat"), F.min("lon").alias("lon"), F.min("alt").alias("alt"))


@query(f"""WITH c AS {_FIXED}, m AS (SELECT map_id, avg(lat) AS a, avg(lon) AS o FROM c GROUP BY map_id), t AS (SELECT c.*, round(atan2(lat - a, lon - o), 9) AS th FROM c JOIN m USING (map_id)),
n AS (SELECT *, row_number() OVER (PARTITION BY map_id ORDER BY th, frame) - 1 AS pos, count(*) OVER (PARTITION BY map_id) AS k FROM t)
SELECT map_id, pos, lat, lon FROM n UNION ALL SELECT map_id, k, lat, lon FROM n WHERE pos = 0""")
def kml_ring(spark, d):
    return formats.ring_order(_fixed(spark, d), "map_id", "frame").select("map_id", "pos", "lat", "lon")


@query(f"""WITH p AS (SELECT *, row_number() OVER (PARTITION BY map_id ORDER BY frame) - 1 AS i FROM {_FIXED})
SELECT map_id, {_HEAD.format(name="camera_poses")} || string_agg('    <Placemark><name>frame_' || printf('%03d', i) || '</name><Point><altitudeMode>absolute</altitudeMode><coordinates>' || {_AT} || '</coordinates></Point></Placemark>', chr(10) ORDER BY i) || {_TAIL} AS kml FROM p GROUP BY map_id""")
def camera_kml(spark, d):
    return formats.camera_kml(_fixed(spark, d), "map_id", "frame")


@query(f"SELECT map_id, row_number() OVER (PARTITION BY map_id ORDER BY frame) - 1 AS pos, round(lat, 9) AS lat, round(lon, 9) AS lon FROM {_FIXED}")
def kml_scan(spark, d):
    return rounded(formats.parse_plan_kml(formats.camera_kml(_fixed(spark, d), "map_id", "frame"), "map_id"), 9, "lat", "lon").select("map_id", "pos", "lat", "lon")


#: Points of the maps: source k is the k-th map of the catalogue of georeferences.
_CATALOGUE = f"(SELECT row_number() OVER (ORDER BY map_id) - 1 AS source, map_id, s, lat0, lon0, alt0 FROM {_FIRST_GEOREF})"


def _catalogue(spark, d):
    return points.numbered(_georefs(spark, d), ["map_id"], "source")


@query(f"""WITH {_KEPT} SELECT c.map_id, 'scene_origin' AS layer, 'scene_geo.glb' AS model, 'absolute' AS altitude_mode, any_value(lon0) AS lon, any_value(lat0) AS lat, any_value(coalesce(alt0, 0)) AS alt, any_value(s) AS scale,
  round(avg(k.conf) + 3.3e-8, 6) AS mean_confidence, round(quantile_cont(k.conf, 0.5) + 3.3e-8, 6) AS median_confidence FROM {_CATALOGUE} c LEFT JOIN k USING (source) GROUP BY c.map_id""")
def map_geojson(spark, d):
    """Every map's GeoJSON with the statistics of its points, read back field by field."""
    stats_ = points.confidence_stats(table(spark, d, "site").where("source IS NOT NULL"), "source")
    texts = formats.map_geojson(_catalogue(spark, d).join(stats_, "source", "left"))
    return nudged(formats.parse_geojson(texts), "mean_confidence", "median_confidence").select("map_id", "layer", "model", "altitude_mode", "lon", "lat", "alt", "scale", "mean_confidence", "median_confidence")


@query(f"""WITH m AS (SELECT map_id, source FROM {_CATALOGUE} WHERE source IN (SELECT source FROM site))
SELECT 'site_origin' AS layer, 'site.glb' AS model, 'absolute' AS altitude_mode, 10.0::DOUBLE AS lon, 45.0::DOUBLE AS lat, 300.0::DOUBLE AS alt, (SELECT count(*) FROM m) AS num_maps, count(*) AS num_points, round(avg(conf) + 3.3e-8, 6) AS mean_confidence, round(quantile_cont(conf, 0.5) + 3.3e-8, 6) AS median_confidence,
  (SELECT string_agg(map_id, ',' ORDER BY source) FROM m) AS map_ids FROM site""")
def site_geojson(spark, d):
    s = table(spark, d, "site")
    maps = _catalogue(spark, d).join(s.select("source"), "source", "left_semi").select("source", "map_id")
    out = nudged(formats.parse_geojson(formats.site_geojson(s, maps, (45.0, 10.0, 300.0))), "mean_confidence", "median_confidence")
    return out.select("layer", "model", "altitude_mode", "lon", "lat", "alt", "num_maps", "num_points", "mean_confidence", "median_confidence", F.array_join("map_ids", ",").alias("map_ids"))


@query(f"SELECT map_id, s, r[1][1] AS r00, r[1][2] AS r01, r[1][3] AS r02, r[2][1] AS r10, r[2][2] AS r11, r[2][3] AS r12, r[3][1] AS r20, r[3][2] AS r21, r[3][3] AS r22, t[1] AS t0, t[2] AS t1, t[3] AS t2, lat0, lon0, coalesce(alt0, 0) AS alt0 FROM {_FIRST_GEOREF}")
def transform_json(spark, d):
    """Every georeference as JSON, parsed again."""
    back = formats.parse_transform(formats.transform_json(_georefs(spark, d)))
    return back.select("map_id", "s", *[F.col("r")[i][j].alias(f"r{i}{j}") for i in range(3) for j in range(3)], *[F.col("t")[i].alias(f"t{i}") for i in range(3)], "lat0", "lon0", "alt0")


@query("SELECT map_id, frame, round(lat, 9) AS latitude, round(lon, 9) AS longitude FROM " + _FIXED)
def gps_csv_round_trip(spark, d):
    """Positions written as CSV and scanned again, joined back by their order."""
    c = points.numbered(_fixed(spark, d), ["map_id", "frame"], "pos").withColumnsRenamed({"lat": "latitude", "lon": "longitude", "alt": "altitude"})
    out = f"{ensure_checkpoint_dir(spark)}/gps-{uuid.uuid4().hex}"
    formats.write_gps_csv(c, out)
    back = formats.read_gps_csv(spark, out)
    return c.select("pos", "map_id", "frame").join(back, "pos").select("map_id", "frame", F.round("latitude", 9).alias("latitude"), F.round("longitude", 9).alias("longitude"))


# --- joins and alignment ---------------------------------------------------------------------------------------------

@query("""WITH s AS (SELECT vec_id AS id, embedding[1]::DOUBLE * 100 AS x, embedding[2]::DOUBLE * 100 AS y, embedding[3]::DOUBLE * 100 AS z, label FROM embeddings)
SELECT a.id, arg_min(b.id, (pow(a.x - b.x, 2) + pow(a.y - b.y, 2) + pow(a.z - b.z, 2), b.id)) AS dst_id, round(sqrt(min(pow(a.x - b.x, 2) + pow(a.y - b.y, 2) + pow(a.z - b.z, 2))), 6) AS dist FROM s a, s b WHERE a.label < 5 AND b.label >= 5 GROUP BY a.id""")
def nearest_neighbour(spark, d):
    e = table(spark, d, "embeddings")
    s = e.select(F.col("vec_id").alias("id"), *[(F.col("embedding")[k].cast("double") * 100).alias(c) for k, c in enumerate("xyz")], "label")
    return rounded(joins.nearest(s.where("label < 5"), s.where("label >= 5")), 6, "dist")


@query("""WITH a AS (SELECT event_id, row_number() OVER (ORDER BY event_id) AS p FROM events), b AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) AS p FROM embeddings)
SELECT event_id, vec_id FROM a JOIN b USING (p)""")
def positional_join(spark, d):
    return joins.zip_rows(table(spark, d, "events").select("event_id"), table(spark, d, "embeddings").select("vec_id"), ["event_id"], ["vec_id"])


@query("""WITH a AS (SELECT event_id, row_number() OVER (ORDER BY event_id) AS p FROM events), b AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) AS p FROM embeddings)
SELECT event_id, vec_id FROM a LEFT JOIN b USING (p)""")
def positional_left_join(spark, d):
    return joins.zip_rows(table(spark, d, "events").select("event_id"), table(spark, d, "embeddings").select("vec_id"), ["event_id"], ["vec_id"], "left")


_MASK = f'SELECT vec_id, "row" AS rw, col, v > 0.1 AS hit, v FROM ({_GRID})'


@query(f"WITH g AS ({_MASK}), t AS (SELECT vec_id, quantile_cont(v + 1, 0.1) AS cut FROM g GROUP BY vec_id) SELECT g.vec_id, rw AS \"row\", col, v FROM g JOIN t USING (vec_id) WHERE hit AND v + 1 >= cut AND v + 1 > 1e-6")
def mask_lift(spark, d):
    g = _grid(spark, d).select(F.col("vec_id").alias("map_id"), F.lit(0).alias("frame"), "row", "col", "v", F.lit(0.0).alias("x"), F.lit(0.0).alias("y"), F.lit(0.0).alias("z"), (F.col("v") + 1).alias("conf"))
    masks = g.select("map_id", "frame", "row", "col", F.lit("q").alias("query"), (F.col("v") > 0.1).alias("hit"))
    return joins.lift_mask(masks, g, points.confidence_mask(g, "map_id")).select(F.col("map_id").alias("vec_id"), "row", "col", "v")


@query(f'WITH g AS ({_MASK}) SELECT vec_id % 10 AS frame, rw AS "row", col, bool_or(hit) AS hit FROM g GROUP BY ALL')
def mask_union(spark, d):
    g = _grid(spark, d).select((F.col("vec_id") % 10).alias("frame"), "row", "col", (F.col("v") > 0.1).alias("hit"))
    return segments.union_masks(g, ["frame", "row", "col"])


@query(f"WITH g AS ({_MASK}) SELECT vec_id, count(*) FILTER (WHERE hit) AS pixels FROM g GROUP BY vec_id")
def mask_pixels(spark, d):
    return segments.mask_pixels(_grid(spark, d).select("vec_id", (F.col("v") > 0.1).alias("hit")), ["vec_id"])


@query("""WITH t AS (SELECT lower(trim(query)) AS query, ord, target_id FROM segments WHERE target_id IS NOT NULL), p AS (SELECT query, min(target_id) AS pos FROM t GROUP BY query)
SELECT t.query, p.pos, t.ord, t.target_id FROM t JOIN p USING (query) WHERE t.query <> 'vehicle' UNION ALL SELECT 'vehicle', coalesce((SELECT max(pos) FROM p WHERE query <> 'vehicle'), -1) + 1, ord, target_id FROM t WHERE target_id = 1""")
def segment_upsert(spark, d):
    t = table(spark, d, "segments").where("target_id IS NOT NULL").select(F.lower(segments.trim_query(F.col("query"))).alias("query"), "ord", "target_id", "x", "y", "z")
    p = t.groupBy("query").agg(F.min("target_id").alias("pos"))
    all_ = t.join(p, "query")
    new = t.where("target_id = 1")
    up = segments.upsert(all_.drop("target_id"), "vehicle", new)
    rest = all_.where("query <> 'vehicle'").select("query", "pos", "ord", "target_id")
    fresh = up.where("query = 'vehicle'").select("query", "pos", "ord").withColumn("target_id", F.lit(1).cast("long"))
    return rest.unionByName(fresh)


@query("SELECT DISTINCT trim(coalesce(query, '')) AS query FROM segments")
def query_trim(spark, d):
    return table(spark, d, "segments").select(segments.trim_query(F.col("query")).alias("query")).distinct()


@query("SELECT target_id, count(*) AS n, (sum(count(*)) OVER (ORDER BY target_id ROWS UNBOUNDED PRECEDING) - count(*))::BIGINT AS start FROM segments WHERE target_id IS NOT NULL GROUP BY target_id")
def running_offsets(spark, d):
    c = table(spark, d, "segments").where("target_id IS NOT NULL").groupBy("target_id").agg(F.count(F.lit(1)).alias("n"))
    return segments.running_offsets(c, "target_id", "n")


def _pairs(spark, d):
    j = _fixed(spark, d).join(_cameras(spark, d).groupBy("map_id", "frame").agg(*[F.min(c).alias(c) for c in ("cx", "cy", "cz")]), ["map_id", "frame"])
    o = _fixed(spark, d).groupBy("map_id").agg(F.min("lat").alias("lat0"), F.min("lon").alias("lon0"), F.min("alt").alias("alt0"))
    j = j.join(o, "map_id")
    e, n, u = geo.geodetic_to_enu(*[F.col(c) for c in ("lat", "lon", "alt", "lat0", "lon0", "alt0")])
    return j.withColumns({"e": e, "n": n, "u": u})


@query(f"SELECT map_id, count(*) AS pairs FROM {_FIXED} JOIN (SELECT DISTINCT map_id, frame FROM cameras WHERE cx IS NOT NULL AND cy IS NOT NULL AND cz IS NOT NULL) USING (map_id, frame) GROUP BY map_id HAVING count(*) >= 3")
def align_pairs(spark, d):
    """Maps with enough positions to be aligned."""
    return align.moments(_pairs(spark, d), "map_id").select("map_id", "pairs")


#: Sum S of the singular values of each map's cross-covariance: S^2 = t + 2 Q and Q^2 = m + 2 |det| S, t and m being the sums of squared entries and minors; the least one by the largest and the determinant.
_ALIGN = f"""o AS (SELECT map_id, min(lat) AS lat0, min(lon) AS lon0, min(alt) AS alt0 FROM {_FIXED} GROUP BY map_id),
cam AS (SELECT map_id, frame, min(cx) AS cx, min(cy) AS cy, min(cz) AS cz FROM {_CAM} GROUP BY ALL),
pr AS (SELECT *, {_ecef_sql("lat", "lon", "coalesce(alt, 0)", "")}, {_ecef_sql("lat0", "lon0", "coalesce(alt0, 0)", "0")}, radians(lat0) AS f, radians(lon0) AS l FROM {_FIXED} JOIN cam USING (map_id, frame) JOIN o USING (map_id) WHERE cx IS NOT NULL AND cy IS NOT NULL AND cz IS NOT NULL),
en AS (SELECT map_id, cx, cy, cz, -sin(l) * (x - x0) + cos(l) * (y - y0) AS e, -sin(f) * cos(l) * (x - x0) - sin(f) * sin(l) * (y - y0) + cos(f) * (z - z0) AS n, cos(f) * cos(l) * (x - x0) + cos(f) * sin(l) * (y - y0) + sin(f) * (z - z0) AS u FROM pr),
h AS (SELECT map_id, count(*) AS pairs, var_pop(cx) + var_pop(cy) + var_pop(cz) AS vs, var_pop(e) + var_pop(n) + var_pop(u) AS vd, covar_pop(e, cx) AS a, covar_pop(e, cy) AS b, covar_pop(e, cz) AS c, covar_pop(n, cx) AS d, covar_pop(n, cy) AS k, covar_pop(n, cz) AS g, covar_pop(u, cx) AS p, covar_pop(u, cy) AS q, covar_pop(u, cz) AS r FROM en GROUP BY map_id HAVING count(*) >= 3),
w AS (SELECT *, a * (k * r - g * q) - b * (d * r - g * p) + c * (d * q - k * p) AS det, a*a + b*b + c*c + d*d + k*k + g*g + p*p + q*q + r*r AS t,
  pow(a*k - b*d, 2) + pow(a*g - c*d, 2) + pow(b*g - c*k, 2) + pow(a*q - b*p, 2) + pow(a*r - c*p, 2) + pow(b*r - c*q, 2) + pow(d*q - k*p, 2) + pow(d*r - g*p, 2) + pow(k*r - g*q, 2) AS m,
  a*a + d*d + p*p AS xx, b*b + k*k + q*q AS yy, c*c + g*g + r*r AS zz, a*b + d*k + p*q AS xy, a*c + d*g + p*r AS xz, b*c + k*g + q*r AS yz FROM h),
w2 AS (SELECT *, list_reduce(list_prepend(sqrt(t), list_transform(range(40), lambda x: 0::DOUBLE)), lambda s, x: sqrt(t + 2 * sqrt(m + 2 * abs(det) * s))) AS total,
  sqrt((pow(xx - t / 3, 2) + pow(yy - t / 3, 2) + pow(zz - t / 3, 2) + 2 * (xy*xy + xz*xz + yz*yz)) / 6) AS v FROM w),
w3 AS (SELECT *, sqrt(t / 3 + 2 * v * cos(CASE WHEN v > 0 THEN acos(greatest(-1, least(1, ((xx - t / 3) * ((yy - t / 3) * (zz - t / 3) - yz*yz) - xy * (xy * (zz - t / 3) - yz * xz) + xz * (xy * yz - (yy - t / 3) * xz)) / (2 * v * v * v)))) / 3 ELSE 0 END)) AS s1 FROM w2),
w4 AS (SELECT *, (total - s1 + sqrt(greatest(0, pow(total - s1, 2) - 4 * abs(det) / s1))) / 2 AS s2 FROM w3),
sv AS (SELECT *, CASE WHEN s1 * s2 > 0 THEN abs(det) / (s1 * s2) ELSE 0 END AS s3 FROM w4), fit AS (SELECT *, total / CASE WHEN vs > 0 THEN vs ELSE 1 END AS s FROM sv)"""


@query(f"WITH {_ALIGN} SELECT map_id, round(s, 4) AS s FROM fit")
def align_sim3(spark, d):
    f = align.fit_sim3(_pairs(spark, d), "map_id")
    return f.select("map_id", F.round("s", 4).alias("s"))


@query(f"WITH {_ALIGN} SELECT map_id, pairs, round(sqrt(greatest(0, s * s * vs + vd - 2 * s * (total - CASE WHEN det < 0 THEN 2 * s3 ELSE 0 END))), 3) AS rmse FROM fit")
def align_rmse(spark, d):
    p = _pairs(spark, d)
    return rounded(align.rmse(p, align.fit_sim3(p, "map_id"), "map_id"), 3, "rmse").select("map_id", "pairs", "rmse")


@query()
def align_icp(spark, d):
    return align.icp(_pairs(spark, d), "map_id").select("map_id", F.round("s", 3).alias("s"), "rounds")


@query(f"WITH n AS (SELECT map_id, count(*) AS total, least(count(*), 7) AS k FROM {_CAM} GROUP BY map_id), i AS (SELECT map_id, total, k, unnest(range(k)) AS i FROM n) SELECT map_id, i, CASE WHEN k > 1 THEN round_even(i * (total - 1) / (k - 1), 0) ELSE 0 END::BIGINT AS pos FROM i")
def even_resample(spark, d):
    n = _cameras(spark, d).groupBy("map_id").agg(F.count(F.lit(1)).alias("total")).withColumn("k", F.least("total", F.lit(7)))
    return align.even_resample(n, "map_id", "k", "total")


# --- frames and batches ----------------------------------------------------------------------------------------------

#: Streamed frames count motion in thousandths of a px.
MILLI = 1000.0


def _selected(spark, d, threshold=keyframes.THRESHOLD * MILLI):
    return keyframes.select_keyframes(keyframes.frame_steps(table(spark, d, "frames")), threshold)


#: The recurrence over each stream's frames in order, as a reduction that carries the anchor and the kept frames.
_KEYFRAMES = """f AS (SELECT stream, frame_id AS seq, min(CASE WHEN isfinite(displacement) THEN round(displacement * 1000)::BIGINT END) AS d, min(n_features) AS n FROM frames WHERE stream IS NOT NULL AND frame_id IS NOT NULL GROUP BY ALL),
c AS (SELECT stream, seq, n, CASE WHEN d IS NOT NULL THEN sum(d) OVER (PARTITION BY stream ORDER BY seq) END::BIGINT AS v FROM f),
l AS (SELECT stream, list({'seq': seq, 'v': v, 'n': n, 'held': false, 'a': 0::BIGINT, 'kept': []::BIGINT[]} ORDER BY seq) AS every FROM c GROUP BY stream),
r AS (SELECT stream, list_reduce(list_prepend({'seq': -1::BIGINT, 'v': NULL::BIGINT, 'n': NULL::INT, 'held': false, 'a': 0::BIGINT, 'kept': []::BIGINT[]}, every), lambda s, x:
  CASE WHEN x.v IS NULL OR (s.held AND coalesce(x.n, 10) >= 10 AND abs(x.v - s.a) <= 40000) THEN s
       WHEN coalesce(x.n, 10) < 10 THEN {'seq': x.seq, 'v': x.v, 'n': x.n, 'held': false, 'a': s.a, 'kept': s.kept}
       ELSE {'seq': x.seq, 'v': x.v, 'n': x.n, 'held': true, 'a': x.v, 'kept': list_append(s.kept, x.seq)} END).kept AS kept FROM l),
k AS (SELECT stream, unnest(kept) AS seq FROM r),
b AS (SELECT stream, seq, (row_number() OVER (PARTITION BY stream ORDER BY seq) - 1) // 25 AS batch, (row_number() OVER (PARTITION BY stream ORDER BY seq) - 1) % 25 AS position FROM k)"""


@query(f"WITH {_KEYFRAMES} SELECT stream, seq FROM k")
def keyframes_selected(spark, d):
    return _selected(spark, d).where("kept").select("stream", "seq")


@query(f"WITH {_KEYFRAMES} SELECT stream, seq, batch, position FROM b")
def count_batches(spark, d):
    return keyframes.tumbling_batches(_selected(spark, d).where("kept").select("stream", "seq")).select("stream", "seq", "batch", "position")


@query(f"WITH {_KEYFRAMES}, z AS (SELECT stream, batch FROM b GROUP BY ALL HAVING count(*) = 25) SELECT stream, seq, batch FROM b JOIN z USING (stream, batch)")
def closed_batches(spark, d):
    return keyframes.closed_batches(_selected(spark, d)).select("stream", "seq", "batch")


@query(f"WITH {_KEYFRAMES}, z AS (SELECT stream, batch FROM b GROUP BY ALL HAVING count(*) = 25), m AS (SELECT b.*, seq % 7 <> 3 AS moved FROM b JOIN z USING (stream, batch)) SELECT stream, batch, printf('frame_%06d.jpg', position) AS name, row_number() OVER (PARTITION BY stream, batch ORDER BY position) - 1 AS place FROM m WHERE moved")
def batch_index(spark, d):
    """File names of the closed batches' frames, where every seventh file could not be moved."""
    return keyframes.batch_index(keyframes.closed_batches(_selected(spark, d)).withColumn("moved", F.col("seq") % 7 != 3), "moved").select("stream", "batch", "name", "place")


@query(f"WITH {_KEYFRAMES}, n AS (SELECT stream, count(*) AS kept FROM k GROUP BY stream) SELECT stream, count(*) AS received, coalesce(any_value(kept), 0) AS kept, coalesce(any_value(kept), 0) // 25 AS closed, coalesce(any_value(kept), 0) % 25 AS collected, 25 AS capacity, CASE WHEN any_value(kept) >= 25 THEN any_value(kept) // 25 - 1 END AS latest FROM f LEFT JOIN n USING (stream) GROUP BY stream")
def batch_status(spark, d):
    return keyframes.batch_status(_selected(spark, d))


@query(f"WITH {_KEYFRAMES}, x AS (SELECT f.stream, f.seq, k.seq IS NOT NULL AS kept FROM f LEFT JOIN k USING (stream, seq)) SELECT stream, seq, CASE WHEN kept THEN 1.0::DOUBLE ELSE 0 END AS status, (count(*) FILTER (WHERE kept) OVER w)::BIGINT AS kept_so_far, count(*) OVER w AS received FROM x WINDOW w AS (PARTITION BY stream ORDER BY seq ROWS UNBOUNDED PRECEDING)")
def frame_replies(spark, d):
    return keyframes.replies(_selected(spark, d))


@query("SELECT stream, count(DISTINCT frame_id) AS n FROM frames WHERE stream IS NOT NULL GROUP BY stream")
def keep_every_frame(spark, d):
    """Threshold 0: the tracker is not asked."""
    return _selected(spark, d, 0.0).where("kept").groupBy("stream").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH RECURSIVE e AS (SELECT user_id AS stream, epoch_us(ts) AS us, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq, value FROM events),
k AS (SELECT stream, us, seq, value AS anchor, true AS kept FROM e WHERE seq = 1
  UNION ALL SELECT e.stream, e.us, e.seq, CASE WHEN abs(e.value - k.anchor) > 40 THEN e.value ELSE k.anchor END, abs(e.value - k.anchor) > 40 FROM k JOIN e ON e.stream = k.stream AND e.seq = k.seq + 1)
SELECT stream, us AS micros FROM k WHERE kept""")
def keyframes_stream(spark, d):
    """The stream form over the events' file, drained once into a table."""
    schema = spark.read.parquet(f"{d}/events.parquet").schema
    src = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{d}/events.parquet" if os.path.isdir(f"{d}/events.parquet") else f"{d}/events.parq[u]et")
    f = src.select(F.col("user_id").alias("stream"), F.unix_micros(F.col("ts").cast("timestamp")).alias("seq"), F.col("value").cast("double").alias("value"), F.lit(100).alias("n_features"), F.lit(None).cast("string").alias("control"))
    return keyframes.drain(keyframes.stream_keyframes(f).where("kept").select("stream", F.col("seq").alias("micros")))


_TIMES = "t AS (SELECT stream, frame_id AS seq, min(epoch_us(arrived) - epoch_us(ts)) / 1e6 AS s FROM frames WHERE stream IS NOT NULL AND frame_id IS NOT NULL GROUP BY ALL)"


@query(f"""WITH {_KEYFRAMES}, {_TIMES}, h AS (SELECT stream, s, row_number() OVER (PARTITION BY stream ORDER BY seq DESC) AS back, count(*) OVER (PARTITION BY stream) AS n FROM t WHERE s IS NOT NULL),
m AS (SELECT stream, avg(s) AS a, max(s) AS b, min(s) AS c FROM h WHERE back <= CASE WHEN n <= 1000 THEN n ELSE 500 + (n - 1001) % 501 END GROUP BY stream), kn AS (SELECT stream, count(*) AS kept FROM k GROUP BY stream), fn AS (SELECT stream, count(*) AS total FROM f GROUP BY stream)
SELECT stream, total, coalesce(kept, 0) AS keyframes, round(100.0 * coalesce(kept, 0) / total + 3.3e-8, 6) AS rate, round(a + 3.3e-8, 6) AS mean_s, round(b + 3.3e-8, 6) AS max_s, round(c + 3.3e-8, 6) AS min_s FROM fn LEFT JOIN kn USING (stream) LEFT JOIN m USING (stream)""")
def selector_stats(spark, d):
    """Selection counts and times; a frame's time is the one from its shot to its first arrival."""
    us = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    t = table(spark, d, "frames").groupBy("stream", F.col("frame_id").alias("seq")).agg((F.min(us("arrived") - us("ts")) / 1e6).alias("s"))
    return nudged(stats.selector_stats(_selected(spark, d).join(t, ["stream", "seq"]), "s"), "rate", "mean_s", "max_s", "min_s").select("stream", "total", "keyframes", "rate", "mean_s", "max_s", "min_s")


@query(f"""WITH {_KEYFRAMES} SELECT count(DISTINCT stream) AS connections, count(*) AS frames, count(latitude) AS with_position, (SELECT count(*) FROM k) AS keyframes, round(100.0 * (SELECT count(*) FROM k) / (SELECT count(*) FROM f), 6) AS rate, round((epoch_us(max(arrived)) - epoch_us(min(arrived))) / 1e6, 6) AS seconds FROM frames""")
def transport_counters(spark, d):
    return rounded(stats.transport_counters(table(spark, d, "frames"), _selected(spark, d)), 6, "rate", "seconds").select("connections", "frames", "with_position", "keyframes", "rate", "seconds")


@query(f'WITH g AS ({_GRID}) SELECT a.vec_id, count(*) AS tracked, round(avg(sqrt(pow(b.v - a.v, 2) + pow((b.v + a.v) / 2, 2))), 9) AS mean_px FROM g a JOIN g b ON a.vec_id + 1 = b.vec_id AND a."row" = b."row" AND a.col = b.col WHERE abs(b.v) < 0.3 GROUP BY a.vec_id HAVING count(*) >= 10')
def mean_displacement(spark, d):
    """Mean length of the motion of features found again between a frame and the next, where at least ten are."""
    g = _grid(spark, d)
    n = g.select((F.col("vec_id") - 1).alias("vec_id"), "row", "col", F.col("v").alias("w"))
    f = g.join(n, ["vec_id", "row", "col"])
    f = f.select("vec_id", F.lit(0.0).alias("x0"), F.lit(0.0).alias("y0"), (F.col("w") - F.col("v")).alias("x1"), ((F.col("w") + F.col("v")) / 2).alias("y1"), F.when(F.abs("w") < 0.3, 1).otherwise(0).alias("status"))
    return stats.mean_displacement(f, ["vec_id"], keyframes.LEAST_FEATURES).withColumn("mean_px", F.round("mean_px", 9))


@query("""WITH n AS (SELECT stream, frame_id, row_number() OVER (PARTITION BY stream ORDER BY frame_id DESC) AS k, count(*) OVER (PARTITION BY stream) AS n FROM (SELECT DISTINCT stream, frame_id FROM frames))
SELECT stream, frame_id FROM n WHERE k <= CASE WHEN n <= 1000 THEN n ELSE 500 + (n - 1001) % 501 END""")
def bounded_history(spark, d):
    return stats.bounded_history(table(spark, d, "frames").select("stream", "frame_id").distinct(), "stream", "frame_id")


# --- catalogue -------------------------------------------------------------------------------------------------------

@query("SELECT map_id, row_number() OVER (ORDER BY map_id DESC) - 1 AS pos FROM (SELECT DISTINCT map_id FROM maps WHERE map_id IS NOT NULL)")
def newest_maps(spark, d):
    """All maps with their place, newest first."""
    m = table(spark, d, "maps").select("map_id").where("map_id IS NOT NULL").distinct()
    n = points.numbered(m, ["map_id"], "_up")
    last = n.agg(F.max("_up").alias("_last")).withColumn("_k", F.lit(1))
    return n.withColumn("_k", F.lit(1)).join(last, "_k").select("map_id", (F.col("_last") - F.col("_up")).alias("pos"))


@query("SELECT map_id, 'map_' || strftime(created_time, '%Y%m%d_%H%M%S_') || printf('%06d', (epoch_us(created_time) % 1000000)::BIGINT) AS made FROM maps")
def map_id_format(spark, d):
    m = table(spark, d, "maps")
    return m.select("map_id", F.concat(F.lit("map_"), F.date_format("created_time", "yyyyMMdd_HHmmss_SSSSSS")).alias("made"))


@query("SELECT map_id, count(*) AS keyframes, min(frame) AS first, max(frame) AS last FROM cameras GROUP BY map_id")
def catalogue_keyframes(spark, d):
    return table(spark, d, "cameras").groupBy("map_id").agg(F.count(F.lit(1)).alias("keyframes"), F.min("frame").alias("first"), F.max("frame").alias("last"))
