"""Queries of the general training-data problems (core operators)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrafold.operators import impute, proximity, spikes

RADIUS_M = 150.0


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return impute.filled_fields(impute.fill_keyframes(table(spark, sf_dir, "cameras")))


def p1_filled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every keyframe with its fields filled and the marks."""
    f = impute.fill_keyframes(table(spark, sf_dir, "cameras"))
    return f.withColumns({"lat": F.round("lat", 7), "lon": F.round("lon", 7), "alt": F.round("alt", 3)})


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spikes.implausible_frames(table(spark, sf_dir, "frames"))


def p3_fences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The normal movement of each stream and the fences it is judged by."""
    f = spikes.fences(spikes.step_sketches(spikes.chunked(table(spark, sf_dir, "frames"), 4096, 128)))
    return f.withColumns({c: F.to_json(F.map_from_entries(F.array_sort(F.map_entries(c)))) for c in ("hours_h", "hours_z")})


def _centres(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = table(spark, sf_dir, "maps")
    return m.select(F.col("map_id").alias("id"), F.col("center_gps.lat").alias("lat"), F.col("center_gps.lon").alias("lon")).where(F.col("id").isNotNull()).distinct()


def _zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "zones").select(F.col("zone_id").alias("id"), "ring").where(F.col("id").isNotNull())


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    centres = _centres(spark, sf_dir)
    near = proximity.close_pairs(centres, RADIUS_M).select("id_a", "id_b")
    inside = proximity.regions_of_points(centres, _zones(spark, sf_dir)).select(F.col("id_point").alias("id_a"), F.col("region_id").alias("id_b")).distinct()
    return near.unionByName(inside)


def p5_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each streamed frame whose position has any: how many maps lie within the radius, how many zones contain it, and the nearest map. A frame sent twice counts once."""
    f = table(spark, sf_dir, "frames").select("stream", "frame_id", F.col("latitude").alias("lat"), F.col("longitude").alias("lon")).where(proximity.usable_position(F.col("latitude"), F.col("longitude"))).dropDuplicates(["stream", "frame_id"])
    pts = f.select(F.struct("stream", "frame_id").alias("id"), "lat", "lon")
    maps = proximity.near_points(pts, _centres(spark, sf_dir), RADIUS_M).groupBy("id_left").agg(F.countDistinct("id_right").alias("n_maps"), F.min(F.struct("dist_m", "id_right")).alias("best"))
    zones = proximity.regions_of_points(pts, _zones(spark, sf_dir)).groupBy("id_point").agg(F.countDistinct("region_id").alias("n_zones"))
    j = maps.join(zones, F.col("id_left") == F.col("id_point"), "full")
    key = F.coalesce("id_left", "id_point")
    return j.select(key["stream"].alias("stream"), key["frame_id"].alias("frame_id"), F.coalesce("n_maps", F.lit(0)).cast("long").alias("n_maps"), F.coalesce("n_zones", F.lit(0)).cast("long").alias("n_zones"), F.col("best.id_right").alias("nearest_map"), F.round("best.dist_m", 3).alias("nearest_m"))


def p5_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The positions of centres, how many maps lie at each, and how many other positions lie within the radius."""
    classes, pairs = proximity.close_classes(_centres(spark, sf_dir), RADIUS_M)
    ends = pairs.select(F.col("class_a").alias("class_id")).unionByName(pairs.select(F.col("class_b").alias("class_id")))
    links = ends.groupBy("class_id").agg(F.count(F.lit(1)).alias("links"))
    return classes.groupBy("class_id").agg(F.sum("n").alias("maps")).join(links, "class_id", "left").fillna(0, ["links"])


QUERIES = {"p1_found": p1_found, "p1_filled": p1_filled, "p3_found": p3_found, "p3_fences": p3_fences, "p5_found": p5_found, "p5_frames": p5_frames, "p5_classes": p5_classes}

#: Brute force over whole tables.
ORACLE = {
    "p5_classes": """
WITH c AS (
  SELECT DISTINCT map_id AS id, center_gps.lat AS lat, (((center_gps.lon + 180) % 360) + 360) % 360 - 180 AS lon
  FROM maps WHERE map_id IS NOT NULL AND center_gps.lat IS NOT NULL AND center_gps.lon IS NOT NULL AND NOT isnan(center_gps.lat) AND NOT isnan(center_gps.lon)
    AND NOT (center_gps.lat = 0 AND center_gps.lon = 0) AND abs(center_gps.lat) <= 90),
k AS (SELECT lat, lon, min(id) AS class_id, count(*) AS n FROM c GROUP BY 1, 2),
p AS (
  SELECT a.class_id AS a, b.class_id AS b FROM k a JOIN k b ON (a.class_id, a.lat, a.lon) < (b.class_id, b.lat, b.lon)
  WHERE 2 * 6371008.8 * asin(least(1.0, sqrt(pow(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lon - a.lon) / 2), 2)))) <= 150),
l AS (SELECT id, count(*) AS links FROM (SELECT a AS id FROM p UNION ALL SELECT b FROM p) GROUP BY id)
SELECT class_id, sum(n)::BIGINT AS maps, coalesce(any_value(links), 0) AS links FROM k LEFT JOIN l ON l.id = class_id GROUP BY class_id
""",
    "p1_found": """
WITH c AS (
  SELECT map_id, frame,
    CASE WHEN NOT isnan(gps.lat) AND abs(gps.lat) <= 90 AND NOT coalesce(gps.lat = 0 AND gps.lon = 0, false) THEN gps.lat END AS lat,
    CASE WHEN NOT isnan(gps.lon) AND abs(gps.lon) <= 180 AND NOT coalesce(gps.lat = 0 AND gps.lon = 0, false) THEN gps.lon END AS lon,
    CASE WHEN NOT isnan(gps.alt) AND gps.alt >= -1000 THEN gps.alt END AS alt,
    CASE WHEN trim(gps_fix) IN ('rtk_fixed', 'rtk_float', 'dgps', 'single') THEN gps_fix END AS fix
  FROM cameras),
m AS (SELECT map_id, max(abs(alt)) FILTER (WHERE alt <> 0) AS far FROM c GROUP BY 1),
k AS (
  SELECT map_id, frame, count(lat) AS lat, count(lon) AS lon, count(CASE WHEN alt <> 0 OR far <= 20 THEN alt END) AS alt, count(fix) AS fix
  FROM c JOIN m USING (map_id) GROUP BY 1, 2),
t AS (SELECT map_id, sum(lat) AS lat, sum(lon) AS lon, sum(alt) AS alt, sum(fix) AS fix FROM k GROUP BY 1)
SELECT map_id, frame, 'lat' AS field FROM k JOIN t USING (map_id) WHERE k.lat = 0 AND t.lat > 0
UNION ALL SELECT map_id, frame, 'lon' FROM k JOIN t USING (map_id) WHERE k.lon = 0 AND t.lon > 0
UNION ALL SELECT map_id, frame, 'alt' FROM k JOIN t USING (map_id) WHERE k.alt = 0 AND t.alt > 0
UNION ALL SELECT map_id, frame, 'fix' FROM k JOIN t USING (map_id) WHERE k.fix = 0 AND t.fix > 0
""",
    "p5_found": """
WITH c AS (
  SELECT DISTINCT map_id AS id, center_gps.lat AS lat, (((center_gps.lon + 180) % 360) + 360) % 360 - 180 AS lon
  FROM maps WHERE map_id IS NOT NULL AND center_gps.lat IS NOT NULL AND center_gps.lon IS NOT NULL AND NOT isnan(center_gps.lat) AND NOT isnan(center_gps.lon)
    AND NOT (center_gps.lat = 0 AND center_gps.lon = 0)),
near AS (
  SELECT DISTINCT a.id AS id_a, b.id AS id_b FROM c a JOIN c b ON a.id < b.id
  WHERE 2 * 6371008.8 * asin(least(1.0, sqrt(pow(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lon - a.lon) / 2), 2)))) <= 150),
corner AS (
  SELECT zone_id, unnest(ring).lat AS lat, ((unnest(ring).lon - ring[1].lon + 540) % 360 + 360) % 360 - 180 AS x, ring[1].lon AS x0, generate_subscripts(ring, 1) AS k, len(ring) AS n FROM zones),
edge AS (
  SELECT a.zone_id, a.x0, a.lat AS y1, a.x AS x1, b.lat AS y2, b.x - a.x AS dx
  FROM corner a JOIN corner b ON a.zone_id = b.zone_id AND b.k = a.k % a.n + 1),
hit AS (
  SELECT c.id AS id_a, e.zone_id AS id_b, count(*) AS n FROM c JOIN edge e
    ON (e.y1 > c.lat) <> (e.y2 > c.lat) AND ((c.lon - e.x0 + 540) % 360 + 360) % 360 - 180 < e.x1 + e.dx * (c.lat - e.y1) / (e.y2 - e.y1)
  GROUP BY 1, 2)
SELECT id_a, id_b FROM near UNION SELECT id_a, id_b FROM hit WHERE n % 2 = 1
""",
}
