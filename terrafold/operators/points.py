"""Point rows: validity and confidence filters, statistics, colours, sampling, camera columns."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from terrafold.operators.quantiles import percentiles
from terrafold.session import cut

# Least confidence that counts, colour ramp range, golden ratio hue step, dimming factor.
EPSILON, RAMP_MAX, HUE_STEP, DIM = 1e-6, 25.0, 0.6180339887, 0.35
# Percentile below which a map's points are cut, rows of a confidence preview, camera pyramids' corners, their share of the scene, and the percentiles that span it.
MASK_PERCENTILE, PREVIEW_ROWS = 10.0, 50_000
CORNERS = ((-0.5, -0.375, 1.0), (0.5, -0.375, 1.0), (0.5, 0.375, 1.0), (-0.5, 0.375, 1.0))
FRUSTUM_SHARE, SPAN = 0.1, (0.05, 0.95)


def is_finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))


def finite_xyz() -> Column:
    return is_finite(F.col("x")) & is_finite(F.col("y")) & is_finite(F.col("z"))


def confidence_mask(points: DataFrame, group: str, percentile: float = 10.0) -> DataFrame:
    """Rows with finite position and conf above EPSILON and at or above the group's exact percentile over all its conf.

    A NaN anywhere in a group's conf makes its percentile undefined, so nothing of the group is kept (percentile 0 skips
    the cut). Null conf is ignored by the percentile and never kept. A null group is a group of its own.
    """
    keep = F.coalesce(finite_xyz() & (F.col("conf") > EPSILON), F.lit(False))
    if percentile == 0:
        return points.where(keep & ~F.isnan("conf"))
    g = points.withColumn("_g", F.col(group))
    bounds = percentiles(g, ["_g"], {"_cut": ("conf", percentile / 100.0)})
    worst = g.groupBy(F.col("_g").alias("_h")).agg(F.max(F.isnan("conf")).alias("_nan"))
    bounds = bounds.join(worst, bounds["_g"].eqNullSafe(worst["_h"])).drop("_h")
    j = points.join(bounds, points[group].eqNullSafe(bounds["_g"]))
    return j.where(keep & ~F.coalesce("_nan", F.lit(False)) & (F.col("conf") >= F.col("_cut"))).drop("_g", "_cut", "_nan")


def confidence_band(points: DataFrame, group: str, low: float = 60.0, high: float = 80.0, least: int = 30) -> DataFrame:
    """Valid rows with p_low <= conf < p_high, both over the group's valid rows; groups whose bounds coincide or that keep fewer than `least` rows drop out (an empty plan is an error there)."""
    valid = points.where(finite_xyz() & is_finite(F.col("conf")))
    cut = percentiles(valid, [group], {"_lo": ("conf", low / 100), "_hi": ("conf", high / 100)})
    band = valid.join(cut.where("_lo < _hi"), group).where("conf >= _lo AND conf < _hi")
    enough = band.groupBy(group).count().where(F.col("count") >= least).select(group)
    return band.join(enough, group, "left_semi").drop("_lo", "_hi")


def confidence_report(points: DataFrame, group: str, percentile: float = MASK_PERCENTILE) -> DataFrame:
    """Per group: total rows, high (those confidence_mask keeps), coverage (their share), and over the kept rows the mean and the population deviation of conf; 0.0 where none is kept."""
    total = points.groupBy(group).agg(F.count(F.lit(1)).alias("total"))
    kept = confidence_mask(points, group, percentile).groupBy(F.col(group).alias("_k")).agg(F.count(F.lit(1)).alias("high"), F.avg("conf").alias("mean_conf"), F.stddev_pop("conf").alias("std_conf"))
    j = total.join(kept, total[group].eqNullSafe(kept["_k"]), "left").drop("_k").fillna(0, ["high"]).fillna(0.0, ["mean_conf", "std_conf"])
    return j.withColumn("coverage", F.col("high") / F.col("total"))


def confidence_stats(points: DataFrame, group: str, percentile: float | None = MASK_PERCENTILE) -> DataFrame:
    """Per group: num_points, mean_confidence and median_confidence over the rows confidence_mask keeps (null where it keeps none); percentile=None takes all rows, as for a site."""
    kept = points if percentile is None else confidence_mask(points, group, percentile)
    kept = kept.withColumn("_k", F.col(group))
    mean = kept.groupBy("_k").agg(F.count(F.lit(1)).alias("num_points"), F.avg("conf").alias("mean_confidence"))
    middle = percentiles(kept, ["_k"], {"median_confidence": ("conf", 0.5)}).withColumnRenamed("_k", "_m")
    stats = mean.join(middle, mean["_k"].eqNullSafe(middle["_m"])).drop("_m")
    groups = points.select(group).distinct()
    return groups.join(stats, groups[group].eqNullSafe(stats["_k"]), "left").drop("_k").fillna(0, ["num_points"])


def extent_and_centroid(points: DataFrame, group: str) -> DataFrame:
    """Per group over finite rows: diagonal of the box, and the mean position."""
    span = [F.max(c) - F.min(c) for c in ("x", "y", "z")]
    return points.where(finite_xyz()).groupBy(group).agg(F.sqrt(span[0] * span[0] + span[1] * span[1] + span[2] * span[2]).alias("extent"), *[F.avg(c).alias(f"c{c}") for c in ("x", "y", "z")])


def quantise(v: Column, clip: bool = False) -> Column:
    """Unit colour to 0-255, truncated; clipped only on request."""
    v = F.least(F.greatest(v, F.lit(0.0)), F.lit(1.0)) if clip else v
    return (v * 255).cast("int")


def ramp(c: Column, top: float = RAMP_MAX) -> dict[str, Column]:
    """Red to green by confidence over a fixed range."""
    v = F.least(F.greatest(c / top, F.lit(0.0)), F.lit(1.0))
    return {"red": ((1 - v) * 255).cast("int"), "green": (v * 255).cast("int"), "blue": F.lit(0)}


def minmax_ramp(points: DataFrame, group: str) -> DataFrame:
    """Adds v in 0..1 over the group's own range (a group of equal values gets 1) and its colour red, green, blue, from red to green."""
    r = points.groupBy(F.col(group).alias("_g")).agg(F.min("conf").alias("_lo"), F.max("conf").alias("_hi"))
    j = points.join(r, points[group].eqNullSafe(r["_g"]))
    j = j.withColumn("v", F.when(F.col("_hi") > F.col("_lo"), (F.col("conf") - F.col("_lo")) / (F.col("_hi") - F.col("_lo"))).otherwise(1.0)).drop("_g", "_lo", "_hi")
    return j.withColumns({"red": quantise(1 - F.col("v")), "green": quantise(F.col("v")), "blue": F.lit(0)})


def hsv_rgb(hue: Column, saturation: float, value: float = 1.0) -> dict[str, Column]:
    """Colour of a hue in 0..1, truncated to 0-255."""
    h = hue * 6
    sector, f = F.floor(h), h - F.floor(h)
    p, q, t, v = F.lit(value * (1 - saturation)), value * (1 - saturation * f), value * (1 - saturation * (1 - f)), F.lit(value)
    pick = lambda *o: F.coalesce(*[F.when(sector == k, c) for k, c in enumerate(o)])
    return {"red": (pick(v, q, p, p, t, v) * 255).cast("int"), "green": (pick(t, v, v, q, p, p) * 255).cast("int"), "blue": (pick(p, p, t, v, v, q) * 255).cast("int")}


def hue_rgb(index: Column) -> dict[str, Column]:
    """Golden-ratio hue at saturation 0.9 and value 1, truncated to 0-255."""
    return hsv_rgb(F.pmod(index * HUE_STEP, F.lit(1.0)), 0.9)


def palette(sources: DataFrame, column: str) -> DataFrame:
    """One colour for each distinct value of an integer column."""
    return sources.select(column).where(F.col(column).isNotNull()).distinct().withColumns(hue_rgb(F.col(column)))


def dim(c: Column) -> Column:
    return (c * DIM).cast("int")


def zero_sky(conf: Column, mask: Column) -> Column:
    """Confidence where the mask is above 0.1, else 0."""
    return F.when(mask > 0.1, conf).otherwise(0.0)


def flatten_grid(df: DataFrame, values: str, width: int, keep: list[str]) -> DataFrame:
    """An array of a frame's cells in row-major order as rows: row, col, value."""
    x = df.select(*keep, F.posexplode(values).alias("pos", "value"))
    return x.withColumn("row", F.floor(F.col("pos") / width).cast("int")).withColumn("col", F.pmod("pos", F.lit(width)).cast("int")).drop("pos")


def stride_sample(df: DataFrame, n: int) -> DataFrame:
    """Every nth row and column (at least 1)."""
    n = max(1, n)
    return df.where((F.pmod("row", F.lit(n)) == 0) & (F.pmod("col", F.lit(n)) == 0))


def random_sample(df: DataFrame, cap: int, key: str, seed: int = 0) -> DataFrame:
    """All rows up to the cap; above it `cap` rows in the order of a seeded hash, the same rows wherever it runs."""
    return df.withColumn("_h", F.xxhash64(key, F.lit(seed))).orderBy("_h", key).limit(cap).drop("_h")


def camera_pose(r: Column, t: Column) -> dict[str, Column]:
    """Camera centre -R^T t and rotation R^T from an extrinsic."""
    centre = {f"p{a}": -(r[0][i] * t[0] + r[1][i] * t[1] + r[2][i] * t[2]) for i, a in enumerate("xyz")}
    return centre | {"rotation": F.array(*[F.array(*[r[j][i] for j in range(3)]) for i in range(3)])}


def unproject(col: Column, row: Column, depth: Column, k: tuple[Column, Column, Column, Column], r: Column, t: Column) -> tuple[Column, Column, Column]:
    """World point of a pixel's depth: R^T (c - t) with c from fx, fy, cx, cy."""
    fx, fy, cx, cy = k
    c = ((col - cx) / fx * depth - t[0], (row - cy) / fy * depth - t[1], depth - t[2])
    return tuple(r[0][i] * c[0] + r[1][i] * c[1] + r[2][i] * c[2] for i in range(3))


def frustum_size(points: DataFrame, group: str) -> DataFrame:
    """A tenth of the diagonal between the 5th and 95th percentiles of each group's finite points."""
    spans = percentiles(points.where(finite_xyz()), [group], {f"_{c}{k}": (c, q) for c in ("x", "y", "z") for k, q in enumerate(SPAN)})
    d2 = sum((F.pow(F.col(f"_{c}1") - F.col(f"_{c}0"), 2) for c in ("y", "z")), F.pow(F.col("_x1") - F.col("_x0"), 2))
    return spans.select(group, (FRUSTUM_SHARE * F.sqrt(d2)).alias("size"))


def frustums(cameras: DataFrame, size: str) -> DataFrame:
    """Five vertices for each camera (centre px, py, pz and camera-to-world rotation): 0 the centre, 1 to 4 the corners.

    The corners are turned by the rotation's transpose, as viewers of these scenes expect.
    """
    s = F.col(size)
    corner = F.array(*[F.struct(F.lit(k).alias("vertex"), *[(F.lit(float(v)) * s).alias(a) for a, v in zip("abc", xyz)]) for k, xyz in enumerate(((0.0, 0.0, 0.0), *CORNERS))])
    x = cameras.withColumn("_v", F.explode(corner))
    world = {f"v{a}": F.col(f"p{a}") + F.col("rotation")[0][i] * F.col("_v.a") + F.col("rotation")[1][i] * F.col("_v.b") + F.col("rotation")[2][i] * F.col("_v.c") for i, a in enumerate("xyz")}
    return x.withColumns(world).withColumn("vertex", F.col("_v.vertex")).drop("_v")


def frustum_faces(cameras: DataFrame, index: str, total: str) -> DataFrame:
    """Four triangles for each camera: face 0-3, corners a, b, c as vertex numbers (five a camera, by its index) and the camera's colour by index / total."""
    face = F.array(*[F.struct(F.lit(k).alias("face"), F.lit(1 + k).alias("i"), F.lit(1 + (k + 1) % 4).alias("j")) for k in range(4)])
    first = F.col(index).cast("long") * 5
    x = cameras.withColumn("_f", F.explode(face))
    x = x.withColumns({"face": F.col("_f.face"), "a": first, "b": first + F.col("_f.i"), "c": first + F.col("_f.j")}).drop("_f")
    return x.withColumns(hsv_rgb(F.col(index) / F.greatest(F.col(total), F.lit(1)), 1.0))


def scene_alignment(x: Column, y: Column, z: Column, r: Column, t: Column) -> tuple[Column, Column, Column]:
    """View coordinates by the first camera's extrinsic (r, t): x and y are flipped, then the extrinsic is undone: R^T (d - t)."""
    d = (-x - t[0], -y - t[1], z - t[2])
    return tuple(r[0][i] * d[0] + r[1][i] * d[1] + r[2][i] * d[2] for i in range(3))


def numbered(df: DataFrame, order: list[str], name: str = "ord") -> DataFrame:
    """Dense numbers from 0 in the given order without one task sorting everything: range partitions, their counts, offsets."""
    parts = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_p", F.spark_partition_id())
    parts = cut(parts)
    counts = parts.groupBy("_p").count()
    before = counts.withColumn("_before", F.coalesce(F.sum("count").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("count")
    inside = F.row_number().over(Window.partitionBy("_p").orderBy(*order)) - 1
    return parts.withColumn("_i", inside).join(before, "_p").withColumn(name, (F.col("_i") + F.col("_before")).cast("long")).drop("_p", "_i", "_before")


GOLDEN_ANGLE = math.pi * (3 - math.sqrt(5))
