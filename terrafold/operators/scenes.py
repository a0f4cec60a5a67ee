"""What viewers are shown of a map, as tables of vertices, triangles and colours; `sources.glb` writes them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrafold.operators import geo, mesh, points


def _aligned(df: DataFrame, first: DataFrame, xyz: tuple[str, str, str]) -> DataFrame:
    """Coordinates by each map's first camera (map_id, r, t); maps without one stay as they are."""
    j = df.join(first.select("map_id", F.col("r").alias("_r"), F.col("t").alias("_t")), "map_id", "left")
    turned = points.scene_alignment(*[F.col(c) for c in xyz], F.col("_r"), F.col("_t"))
    return j.withColumns({c: F.when(F.col("_r").isNull(), F.col(c)).otherwise(v) for c, v in zip(xyz, turned)}).drop("_r", "_t")


def preview(pts: DataFrame, cameras: DataFrame, percentile: float = points.MASK_PERCENTILE) -> tuple[DataFrame, DataFrame]:
    """(points, frustums) of every map's preview: points kept by confidence in their colours; five vertices for each camera (map_id, frame, r, t).

    pts: map_id, ord, x, y, z, conf, r, g, b. Both are turned to the first camera's view.
    """
    kept = points.confidence_mask(pts, "map_id", percentile)
    first = cameras.groupBy("map_id").agg(F.min_by(F.struct("r", "t"), "frame").alias("m")).select("map_id", "m.*")
    shown = _aligned(kept.select("map_id", "ord", "x", "y", "z", F.col("r").alias("red"), F.col("g").alias("green"), F.col("b").alias("blue")), first, ("x", "y", "z"))
    posed = cameras.withColumns(points.camera_pose(F.col("r"), F.col("t"))).join(points.frustum_size(kept, "map_id"), "map_id")
    return shown, _aligned(points.frustums(posed.drop("r", "t"), "size").select("map_id", "frame", "vertex", "vx", "vy", "vz"), first, ("vx", "vy", "vz"))


def confidence(pts: DataFrame, cameras: DataFrame, percentile: float = points.MASK_PERCENTILE, cap: int = points.PREVIEW_ROWS, seed: int = 0) -> DataFrame:
    """Points of every map's confidence preview, from red to green over the map's own range: map_id, ord, x, y, z, red, green, blue.

    A map of more than `cap` kept points is sampled, in the order of a seeded hash.
    """
    from pyspark.sql.window import Window

    kept = points.confidence_mask(pts, "map_id", percentile)
    n = kept.groupBy("map_id").agg(F.count(F.lit(1)).alias("_n"))
    # The hash's range is cut to a little more than the cap first, so a large map's sample is small before it is ranked.
    h = F.xxhash64("ord", F.lit(seed))
    near = kept.join(n, "map_id").withColumn("_h", h).where((F.col("_n") <= cap) | ((F.col("_h") / 2.0**64 + 0.5) * F.col("_n") <= cap + 12 * F.sqrt(F.lit(float(cap))) + 50))
    few = near.withColumn("_k", F.row_number().over(Window.partitionBy("map_id").orderBy("_h", "ord"))).where(F.col("_k") <= cap)
    first = cameras.groupBy("map_id").agg(F.min_by(F.struct("r", "t"), "frame").alias("m")).select("map_id", "m.*")
    coloured = points.minmax_ramp(few.drop("_h", "_k", "_n"), "map_id")
    return _aligned(coloured.select("map_id", "ord", "x", "y", "z", "red", "green", "blue"), first, ("x", "y", "z"))


def surface(grid: DataFrame, georefs: DataFrame, stride: int = 1, percentile: float = 0.0, factor: float = mesh.EDGE_FACTOR) -> DataFrame:
    """Triangles of every map's surface about its origin, y up: map_id, frame, row, col, half and x0..z2.

    grid: map_id, frame, row, col, x, y, z, conf. The confidence cut is taken over all cells, before the stride; a map's median
    edge is that of its own triangles; maps without a georeference have no surface.
    """
    kept = points.confidence_mask(grid, "map_id", percentile).select("map_id", "frame", "row", "col", F.lit(True).alias("kept"))
    cells = points.stride_sample(grid.join(kept, ["map_id", "frame", "row", "col"], "left").withColumn("kept", F.coalesce("kept", F.lit(False))), stride)
    n = max(1, stride)
    cells = cells.withColumns({"row": (F.col("row") / n).cast("int"), "col": (F.col("col") / n).cast("int")})
    faces = mesh.drop_long(mesh.triangles(cells, ["map_id", "frame"]), ["map_id"], factor)
    g = georefs.select("map_id", "s", "r", "t")

    def corner(p: str) -> tuple[Column, ...]:
        return geo.y_up(*geo.sim3(*[F.col(f"{p}.{c}") for c in "xyz"], F.col("s"), F.col("r"), F.col("t")))

    xyz = {f"{a}{k}": v for k in range(3) for a, v in zip("xyz", corner(f"p{k}"))}
    return faces.join(g, "map_id").select("map_id", "frame", "row", "col", "half", *[v.alias(k) for k, v in xyz.items()])
