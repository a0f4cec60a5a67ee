"""Triangles over a grid of points, and their filters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrafold.operators.quantiles import percentiles

# Fixed value: a triangle's longest edge must be below so many medians.
EDGE_FACTOR = 5.0


def triangles(grid: DataFrame, keys: list[str], kept: str | None = "kept") -> DataFrame:
    """Two triangles, (a, b, c) and (a, c, d), for each 2 x 2 block of neighbours; with `kept`, all three corners must pass.

    grid: keys, row, col, x, y, z. Corners go by equi-join on (row, col), so holes in the grid make no faces. Columns: keys, row, col, half, and
    x0..z2; with the longest edge.
    """
    cols = [*keys, "row", "col", F.struct("x", "y", "z", *([F.col(kept).alias("k")] if kept else [F.lit(True).alias("k")])).alias("p")]
    g = grid.select(*cols)
    shifted = lambda dr, dc, n: g.select(*keys, (F.col("row") - dr).alias("row"), (F.col("col") - dc).alias("col"), F.col("p").alias(n))
    on = [*keys, "row", "col"]
    q = g.withColumnRenamed("p", "a").join(shifted(0, 1, "b"), on).join(shifted(1, 1, "c"), on).join(shifted(1, 0, "d"), on)
    half = F.explode(F.array(F.struct(F.lit(0).alias("half"), F.col("a").alias("p0"), F.col("b").alias("p1"), F.col("c").alias("p2")), F.struct(F.lit(1).alias("half"), F.col("a").alias("p0"), F.col("c").alias("p1"), F.col("d").alias("p2"))))
    t = q.select(*on, half.alias("t")).select(*on, "t.*").where("p0.k AND p1.k AND p2.k")
    edge = lambda u, v: F.sqrt(sum((F.pow(F.col(f"{u}.{c}") - F.col(f"{v}.{c}"), 2) for c in ("y", "z")), F.pow(F.col(f"{u}.x") - F.col(f"{v}.x"), 2)))
    return t.withColumn("longest", F.greatest(edge("p0", "p1"), edge("p1", "p2"), edge("p2", "p0")))


def drop_long(faces: DataFrame, keys: list[str], factor: float = EDGE_FACTOR) -> DataFrame:
    """Faces whose longest edge is below `factor` medians of their group's longest edges."""
    m = percentiles(faces, keys, {"_m": ("longest", 0.5)})
    return faces.join(m, keys).where(F.col("longest") < factor * F.col("_m")).drop("_m")


def vertices(faces: DataFrame, keys: list[str]) -> DataFrame:
    """The distinct corners in use."""
    p = F.explode(F.array("p0", "p1", "p2"))
    return faces.select(*keys, p.alias("p")).select(*keys, "p.x", "p.y", "p.z").distinct()
