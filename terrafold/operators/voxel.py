"""Confidence-weighted voxel merge, and the site as an ordered fold of merges.

`voxel_merge` groups once. `grow` is not the same as merging everything at once: each step collapses a cell to its
weighted mean and its largest confidence, and the next step weighs that mean by it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrafold.session import cut

VOXEL = 0.1
SITE = ["ord", "x", "y", "z", "r", "g", "b", "conf", "source"]


def voxel_key(size: float) -> list[Column]:
    """Cell of a point; floors, so negative coordinates fall to the lower cell. Overflowing indices raise under ANSI."""
    return [F.floor(F.col(c) / size).alias(f"v{c}") for c in ("x", "y", "z")]


def voxel_merge(points: DataFrame, size: float = VOXEL, keys: tuple[str, ...] = ()) -> DataFrame:
    """One row a cell: vx, vy, vz, confidence-weighted mean position and colour, largest conf, source of the most confident row, n.

    A cell without weight has divisor 1; conf never falls below 0; of equally confident rows the last (by ord, then the largest source) gives the
    source. Rows with a null or non-finite coordinate or conf are left out; a null source can win. size <= 0 returns the points unchanged.
    """
    if size <= 0:
        return points
    inf = float("inf")
    ok = F.lit(True)
    for c in ("x", "y", "z", "conf"):
        ok = ok & F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < inf)
    w = F.sum("conf")
    by = F.when(w > 0, w).otherwise(1.0)
    mean = [(F.sum(F.col("conf") * F.col(c)) / by).alias(c) for c in ("x", "y", "z")]
    # A hair more before the cut to whole numbers, so that equal colours stay what they are in whatever order they are summed.
    colour = [F.least(F.greatest(F.sum(F.col("conf") * F.col(c)) / by + 1e-9, F.lit(0.0)), F.lit(255.0)).cast("int").alias(c) for c in ("r", "g", "b")]
    best = F.max_by("source", F.struct("conf", "ord", "source")).alias("source")
    return points.where(ok).groupBy(*keys, *voxel_key(size)).agg(*mean, *colour, F.greatest(F.lit(0.0), F.max("conf")).alias("conf"), best, F.count(F.lit(1)).alias("n"))


def grow(site: DataFrame, new: DataFrame, size: float = VOXEL) -> DataFrame:
    """One fold step: the site's rows, then the new map's, merged; columns SITE with ord in cell order.

    The new rows must carry ord; they come after the site's rows wherever confidences tie. The result is written to the
    checkpoint folder, so a long fold keeps a short plan.
    """
    first = site.select(*SITE[1:], F.struct(F.lit(0).alias("step"), F.col("ord")).alias("ord"))
    then = new.select(*SITE[1:], F.struct(F.lit(1).alias("step"), F.col("ord")).alias("ord"))
    merged = voxel_merge(first.unionByName(then), size)
    key = F.shiftleft(F.pmod("vx", F.lit(1 << 21)), 42).bitwiseOR(F.shiftleft(F.pmod("vy", F.lit(1 << 21)), 21)).bitwiseOR(F.pmod("vz", F.lit(1 << 21)))
    return cut(merged.withColumn("ord", key).select(*SITE))


def grow_all(maps: list[DataFrame], size: float = VOXEL) -> DataFrame:
    """The fold over maps in order, starting from nothing; each map's source must be its position."""
    site = None
    for m in maps:
        site = grow(m.limit(0) if site is None else site, m, size)
    return site


def drop_source(site: DataFrame, index: int) -> DataFrame:
    """Removes the cells credited to one map and moves later sources down by one; its share in blended cells stays."""
    return site.where(~F.col("source").eqNullSafe(index)).withColumn("source", F.when(F.col("source") > index, F.col("source") - 1).otherwise(F.col("source")))
