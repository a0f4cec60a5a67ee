"""Positional joins, nearest neighbours and lookups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrafold.operators.points import numbered
from terrafold.operators.skew import salted_join
from terrafold.session import cut

#: Doublings of the search radius, enough for any spread of doubles in use; what is left after them is an error.
ROUNDS, CELL_ROWS = 128, 256


def zip_rows(left: DataFrame, right: DataFrame, left_order: list[str], right_order: list[str], how: str = "inner") -> DataFrame:
    """Rows paired by position in their order; inner stops at the shorter, left keeps all of the left. Right columns that clash get the suffix _right."""
    r = right.select([F.col(c).alias(c if c not in left.columns else f"{c}_right") for c in right.columns])
    order = [c if c not in left.columns else f"{c}_right" for c in right_order]
    return numbered(left, left_order, "_pos").join(numbered(r, order, "_pos"), "_pos", how).drop("_pos")


def nearest(src: DataFrame, dst: DataFrame, start: float | None = None) -> DataFrame:
    """For each src row (id, x, y, z) the closest dst row: id, dst_id, dist; the lowest dst id wins ties.

    Exact: dst is hashed to cells as wide as the search radius and looked up with its 26 neighbours; whoever has no
    neighbour within the radius is tried again with a doubled one. Equal dst positions count once. The radius starts near the
    mean spacing of dst, or smaller where that would put more than CELL_ROWS of them in a cell. Rows with a
    null or non-finite coordinate take no part; an empty dst gives no rows.
    """
    inf = float("inf")
    ok = F.lit(True)
    for c in ("x", "y", "z"):
        ok = ok & F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < inf)
    a = src.where(ok & F.col("id").isNotNull()).select("id", "x", "y", "z")
    b = dst.where(ok & F.col("id").isNotNull()).select(F.col("id").alias("dst_id"), *[F.col(c).alias(f"_{c}") for c in ("x", "y", "z")])
    span = b.agg(F.count(F.lit(1)).alias("n"), *[(F.max(f"_{c}") - F.min(f"_{c}")).alias(c) for c in ("x", "y", "z")]).first()
    if not span["n"]:
        return a.select("id", F.lit(None).cast(dict(dst.dtypes)["id"]).alias("dst_id"), F.lit(None).cast("double").alias("dist")).where(F.lit(False))
    longest = max(span["x"], span["y"], span["z"])
    b = cut(b.groupBy(*[(F.col(f"_{c}") + 0.0).alias(f"_{c}") for c in "xyz"]).agg(F.min("dst_id").alias("dst_id")))
    radius = start or max(longest / max(1.0, span["n"] ** (1 / 3)), 1e-9)
    while start is None and radius > longest * 1e-12:
        most = b.groupBy(*[F.floor(F.col(f"_{c}") / radius) for c in "xyz"]).count().agg(F.max("count")).first()[0]
        if most <= CELL_ROWS:
            break
        radius /= 4
    out = None
    for _ in range(ROUNDS):
        home = b
        near = a
        for c in ("x", "y", "z"):
            home = home.withColumn(f"c{c}", F.floor(F.col(f"_{c}") / radius))
            near = near.withColumn(f"c{c}", F.explode(F.sequence(F.floor(F.col(c) / radius) - 1, F.floor(F.col(c) / radius) + 1)))
        d2 = sum((F.pow(F.col(c) - F.col(f"_{c}"), 2) for c in ("y", "z")), F.pow(F.col("x") - F.col("_x"), 2))
        hit = salted_join(near, home, ["cx", "cy", "cz"]).withColumn("d2", d2).where(F.col("d2") <= radius * radius)
        best = cut(hit.groupBy("id").agg(F.min(F.struct("d2", "dst_id")).alias("m")).select("id", F.col("m.dst_id").alias("dst_id"), F.sqrt("m.d2").alias("dist")))
        out = best if out is None else out.unionByName(best)
        a = cut(a.join(best.select("id"), "id", "left_anti"))
        if a.isEmpty():
            break
        radius *= 2
    else:
        raise ArithmeticError(f"no neighbour within {radius} for some rows")
    return out


def lift_mask(masks: DataFrame, points: DataFrame, kept: DataFrame) -> DataFrame:
    """Points under hit pixels of a mask that also pass the confidence cut: masks and points share map_id, frame, row, col."""
    keys = ["map_id", "frame", "row", "col"]
    return masks.where("hit").select(*keys, "query").join(points, keys).join(kept.select(*keys).distinct(), keys, "left_semi")
