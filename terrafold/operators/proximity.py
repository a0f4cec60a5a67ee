"""Points near other points, and the regions that contain them.

Points are hashed to grid cells whose latitude bands are as high as the radius and whose longitude width follows the
band's cosine, so a cell is about radius x radius anywhere on the sphere, across the 180th meridian and at the poles.
Each point is stored once in its home cell and probes the cells that its radius touches; the join is an equi-join on
the cell with hot cells split, and every candidate is verified by great-circle distance.
Regions are covered by cells of the coarsest of several grids in which they span few cells; a point looks up its cell in
each grid in use and is verified by the even-odd rule on the unwrapped ring.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrafold.operators.skew import salted_join

EARTH_RADIUS_M = 6_371_008.8
#: Cell sizes in degrees of the grids that regions are covered with.
REGION_GRIDS = (0.05, 0.4, 3.2, 25.6, 360.0)
#: A region goes to the finest grid in which its box spans at most so many cells a side.
REGION_SPAN = 4
#: Region cells are broadcast up to so many bytes of ring corners (each cell carries its ring), else shuffled.
REGION_BROADCAST_BYTES = 32 << 20


def norm_lon(lon: Column) -> Column:
    """Longitude modulo 360 in [-180, 180)."""
    return F.pmod(lon + 180.0, F.lit(360.0)) - 180.0


def finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))


def usable_position(lat: Column, lon: Column) -> Column:
    """Finite and not exactly 0/0; latitudes beyond the poles are no positions."""
    return F.coalesce(finite(lat) & finite(lon) & ~((lat == 0.0) & (lon == 0.0)) & (F.abs(lat) <= 90.0), F.lit(False))


def great_circle_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Haversine distance in metres."""
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * EARTH_RADIUS_M * F.asin(F.least(F.lit(1.0), F.sqrt(a)))


def _cells_of_band(band: Column, step: float) -> Column:
    """Number of cells around the band: its widest parallel divided by the step, at least 1."""
    lo, hi = band * step - 90.0, (band + 1) * step - 90.0
    nearest = F.when((lo <= 0) & (hi >= 0), F.lit(0.0)).otherwise(F.least(F.abs(lo), F.abs(hi)))
    return F.greatest(F.lit(1), F.floor(360.0 * F.cos(F.radians(F.least(nearest, F.lit(90.0)))) / step)).cast("long")


def _step(radius_m: float) -> float:
    return math.degrees(radius_m / EARTH_RADIUS_M) * 1.000001


def home_cell(df: DataFrame, radius_m: float) -> DataFrame:
    """Adds band and cell of each point (columns lat, lon)."""
    step = _step(radius_m)
    band = F.floor((F.col("lat") + 90.0) / step)
    n = _cells_of_band(F.col("band"), step)
    return df.withColumn("band", band).withColumn("cell", F.pmod(F.floor((F.col("lon") + 180.0) / 360.0 * n), n))


def probe_cells(df: DataFrame, radius_m: float) -> DataFrame:
    """One row for each cell that the point's radius touches (three bands, usually three cells in each)."""
    step = _step(radius_m)
    d = radius_m / EARTH_RADIUS_M * 1.000001
    ratio = F.lit(math.sin(d)) / F.cos(F.radians(F.col("lat")))
    half = F.when((F.cos(F.radians(F.col("lat"))) > math.sin(d)) & (ratio < 1.0), F.degrees(F.asin(F.least(ratio, F.lit(1.0))))).otherwise(180.0)
    own = F.floor((F.col("lat") + 90.0) / step)
    x = df.withColumn("_half", half).withColumn("band", F.explode(F.array(own - 1, own, own + 1)))
    n = _cells_of_band(F.col("band"), step)
    x = x.withColumn("_n", n)
    lo = F.floor((F.col("lon") - F.col("_half") + 180.0) / 360.0 * F.col("_n"))
    hi = F.floor((F.col("lon") + F.col("_half") + 180.0) / 360.0 * F.col("_n"))
    x = x.withColumn("_k", F.explode(F.sequence(lo, F.least(hi, lo + F.col("_n") - 1))))
    return x.withColumn("cell", F.pmod(F.col("_k"), F.col("_n"))).drop("_half", "_n", "_k")


def near_points(left: DataFrame, right: DataFrame, radius_m: float) -> DataFrame:
    """Pairs (left row, right row) at most radius_m apart. Both have columns id, lat, lon; clashing extra columns are not carried.

    Rows without a usable position take no part. Returns id_left, id_right, dist_m; repeated input rows give repeated pairs.
    """
    a = left.where(usable_position(F.col("lat"), F.col("lon"))).select("id", "lat", norm_lon(F.col("lon")).alias("lon"))
    b = right.where(usable_position(F.col("lat"), F.col("lon"))).select(F.col("id").alias("id_right"), "lat", norm_lon(F.col("lon")).alias("lon"))
    p = probe_cells(a, radius_m).select(F.col("id").alias("id_left"), F.col("lat").alias("lat_l"), F.col("lon").alias("lon_l"), "band", "cell")
    h = home_cell(b, radius_m).select("id_right", F.col("lat").alias("lat_r"), F.col("lon").alias("lon_r"), "band", "cell")
    dist = great_circle_m(F.col("lat_l"), F.col("lon_l"), F.col("lat_r"), F.col("lon_r"))
    return salted_join(p, h, ["band", "cell"]).withColumn("dist_m", dist).where(F.col("dist_m") <= radius_m).select("id_left", "id_right", "dist_m")


def region_cover(regions: DataFrame) -> DataFrame:
    """One row per covering cell of each region: region id, unwrapped ring (lats, lons), lon range, grid, row, column.

    Rings may be open or closed and run either way; edges go the shorter way round. Regions without three usable
    corners cover nothing. Rings around a pole are not closed in degrees and are outside the definition.
    """
    ok = F.filter("ring", lambda p: finite(p["lat"]) & finite(p["lon"]))
    r = regions.select(F.col("id").alias("region_id"), ok.alias("ring")).where(F.size("ring") >= 3)
    # Unwrap: each corner's longitude is taken within 180 degrees of the one before.
    start = F.col("ring")[0]["lon"]
    lons = F.aggregate(
        "ring",
        F.array().cast("array<double>"),
        lambda acc, p: F.concat(acc, F.array(F.when(F.size(acc) == 0, p["lon"]).otherwise(F.element_at(acc, -1) + norm_lon(p["lon"] - F.element_at(acc, -1))))),
    )
    r = r.withColumn("lons", F.when(start.isNotNull(), lons)).withColumn("lats", F.transform("ring", lambda p: p["lat"])).drop("ring")
    r = r.select("region_id", "lats", "lons", F.array_min("lons").alias("lon_lo"), F.array_max("lons").alias("lon_hi"), F.array_min("lats").alias("lat_lo"), F.array_max("lats").alias("lat_hi"))
    grid = F.lit(len(REGION_GRIDS) - 1)
    for k in reversed(range(len(REGION_GRIDS) - 1)):
        fits = (F.col("lon_hi") - F.col("lon_lo") <= REGION_GRIDS[k] * REGION_SPAN) & (F.col("lat_hi") - F.col("lat_lo") <= REGION_GRIDS[k] * REGION_SPAN)
        grid = F.when(fits, F.lit(k)).otherwise(grid)
    size = F.element_at(F.array(*[F.lit(g) for g in REGION_GRIDS]), F.col("grid") + 1)
    r = r.withColumn("grid", grid).withColumn("_size", size)
    r = r.withColumn("grow", F.explode(F.sequence(F.floor((F.col("lat_lo") + 90.0) / F.col("_size")), F.floor((F.col("lat_hi") + 90.0) / F.col("_size")))))
    # Columns are counted on the unwrapped axis and brought back to [-180, 180) in degrees, so a cell may be cut by the seam: cover both parts.
    n_cols = F.ceil(F.lit(360.0) / F.col("_size"))
    first = F.floor((norm_lon(F.col("lon_lo")) + 180.0) / F.col("_size"))
    last = F.floor((norm_lon(F.col("lon_lo")) + (F.col("lon_hi") - F.col("lon_lo")) + 180.0) / F.col("_size"))
    # A last, narrower column before the seam makes the wrapped index run one further.
    cols = F.array_distinct(F.transform(F.sequence(first, F.least(last + 1, first + n_cols)), lambda c: F.pmod(c, n_cols)))
    r = r.withColumn("gcol", F.explode(cols))
    return r.drop("_size", "lat_lo", "lat_hi")


def contains(lats: Column, lons: Column, lon_lo: Column, lat: Column, lon: Column) -> Column:
    """Even-odd rule on the unwrapped ring; the point's longitude is brought to the ring's range."""
    x = lon_lo + F.pmod(lon - lon_lo, F.lit(360.0))
    n = F.size(lats)

    def crosses(acc: Column, i: Column) -> Column:
        y1, x1 = F.element_at(lats, i + 1), F.element_at(lons, i + 1)
        j = F.pmod(i + 1, n)
        y2, x2 = F.element_at(lats, j + 1), F.element_at(lons, j + 1)
        hit = ((y1 > lat) != (y2 > lat)) & (x < (x2 - x1) * (lat - y1) / (y2 - y1) + x1)
        return F.when(hit, ~acc).otherwise(acc)

    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(False), crosses)


def regions_of_points(points: DataFrame, regions: DataFrame) -> DataFrame:
    """Pairs (point id, region id) where the region's ring contains the point.

    points: id, lat, lon; regions: id, ring array<struct<lat,lon>>. Rows without a usable position take no part; an
    empty table on either side gives no rows.
    """
    p = points.where(usable_position(F.col("lat"), F.col("lon"))).select("id", "lat", norm_lon(F.col("lon")).alias("lon"))
    cover = region_cover(regions)
    grids = sorted(x["grid"] for x in cover.select("grid").distinct().collect())  # at most len(REGION_GRIDS) values
    if not grids:
        return p.select(F.col("id").alias("id_point"), F.lit(None).cast(dict(regions.dtypes)["id"]).alias("region_id")).where(F.lit(False))
    keys = F.array(*[F.struct(F.lit(g).alias("grid"), F.floor((F.col("lat") + 90.0) / REGION_GRIDS[g]).alias("grow"), F.floor((F.col("lon") + 180.0) / REGION_GRIDS[g]).alias("gcol")) for g in grids])
    p = p.withColumn("_c", F.explode(keys)).select("id", "lat", "lon", "_c.*")
    size = cover.agg(F.sum(F.size("lats") * 16 + 64)).first()[0]
    if size <= REGION_BROADCAST_BYTES:
        j = p.join(F.broadcast(cover), ["grid", "grow", "gcol"])
    else:
        j = salted_join(p, cover, ["grid", "grow", "gcol"], 500)
    return j.where(contains(F.col("lats"), F.col("lons"), F.col("lon_lo"), F.col("lat"), F.col("lon"))).select(F.col("id").alias("id_point"), "region_id")


def close_pairs(points: DataFrame, radius_m: float) -> DataFrame:
    """Unordered pairs of different ids at most radius_m apart, once each: id_a < id_b, dist_m (the least of repeated rows)."""
    rows = points.select("id", "lat", norm_lon(F.col("lon")).alias("lon")).distinct()
    near = near_points(rows, rows, radius_m).where(F.col("id_left") < F.col("id_right"))
    return near.groupBy(F.col("id_left").alias("id_a"), F.col("id_right").alias("id_b")).agg(F.min("dist_m").alias("dist_m"))


def position_classes(points: DataFrame) -> DataFrame:
    """id and class_id of each point with a usable position: points of equal position form a class, under its least id; ids with several positions are in several classes."""
    p = points.where(usable_position(F.col("lat"), F.col("lon"))).select("id", (F.col("lat") + 0.0).alias("lat"), (norm_lon(F.col("lon")) + 0.0).alias("lon")).distinct()
    heads = p.groupBy("lat", "lon").agg(F.min("id").alias("class_id"))
    return salted_join(heads, p, ["lat", "lon"]).select("id", "class_id", "lat", "lon")


def close_classes(points: DataFrame, radius_m: float) -> tuple[DataFrame, DataFrame]:
    """(classes, pairs): class_id, n and position of each position in use, and the pairs of classes at most radius_m apart: class_a < class_b, dist_m.

    With `position_classes` they say all that `close_pairs` says, without the square of the copies of one position.
    """
    classes = position_classes(points).groupBy("class_id", "lat", "lon").agg(F.count(F.lit(1)).alias("n"))
    named = classes.select(F.struct("class_id", "lat", "lon").alias("id"), "lat", "lon")
    near = near_points(named, named, radius_m).where(F.col("id_left") < F.col("id_right"))
    return classes, near.select(F.col("id_left.class_id").alias("class_a"), F.col("id_right.class_id").alias("class_b"), "dist_m")
