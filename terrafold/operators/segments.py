"""Segmentation targets: mask union, upsert and clearing of keyed targets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from terrafold.operators.points import hue_rgb
from terrafold.session import cut

# Fixed value: the score that an instance must exceed.
SCORE = 0.5
#: Points of a block in which targets' ranges are looked up.
BLOCK = 65_536


def union_masks(instances: DataFrame, keys: list[str]) -> DataFrame:
    """A pixel is hit if any instance hits it; null counts as no hit."""
    return instances.groupBy(*keys).agg(F.bool_or(F.coalesce("hit", F.lit(False))).alias("hit"))


def above_score(instances: DataFrame, threshold: float = SCORE) -> DataFrame:
    """Instances whose score exceeds the threshold; a null or NaN score does not."""
    return instances.where(F.coalesce((F.col("score") > threshold) & ~F.isnan("score"), F.lit(False)))


def mask_pixels(masks: DataFrame, keys: list[str]) -> DataFrame:
    """Hit pixels of each mask, before any confidence cut."""
    return masks.groupBy(*keys).agg(F.count_if("hit").alias("pixels"))


def running_offsets(counts: DataFrame, order: str, n: str) -> DataFrame:
    """Adds start, the sum of the counts of the rows before, in order: sums within range partitions plus those of the partitions before, so no task sorts all."""
    parts = cut(counts.repartitionByRange(order).withColumn("_p", F.spark_partition_id()))
    per = parts.groupBy("_p").agg(F.sum(n).alias("_s"))  # a row a partition
    before = per.select("_p", F.coalesce(F.sum("_s").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    inside = F.sum(n).over(Window.partitionBy("_p").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)) - F.col(n)
    return parts.withColumn("_in", inside).join(before, "_p").withColumn("start", (F.col("_in") + F.col("_before")).cast("long")).drop("_p", "_in", "_before")


def split_points(points: DataFrame, counts: DataFrame) -> DataFrame:
    """Flat points (ord from 0) handed to targets by their counts (query, pos, n): query, pos and the points; points beyond the counts drop out.

    Targets are few; points are matched to them by range, from the offsets and the counts.
    """
    t = running_offsets(counts, "pos", "n").where(F.col("n") > 0)
    spans = t.select("query", "pos", "start", (F.col("start") + F.col("n")).alias("end"))
    blocks = spans.withColumn("_b", F.explode(F.sequence(F.floor(F.col("start") / BLOCK), F.floor((F.col("end") - 1) / BLOCK))))
    p = points.withColumn("_b", F.floor(F.col("ord") / BLOCK))
    return p.join(blocks, "_b").where((F.col("ord") >= F.col("start")) & (F.col("ord") < F.col("end"))).drop("_b", "start", "end")


def listed_maps(site_maps: DataFrame, maps: DataFrame) -> DataFrame:
    """Maps of the site (source, map_id) that the catalogue holds; sources stay as they are."""
    return site_maps.join(maps.select("map_id").where(F.col("map_id").isNotNull()).distinct(), "map_id", "left_semi")


def trim_query(q):
    """The query without surrounding blanks; null becomes empty."""
    return F.trim(F.coalesce(q, F.lit("")))


def upsert(targets: DataFrame, query: str, points: DataFrame) -> DataFrame:
    """Replaces the target of a query by new points and moves it to the end.

    targets and points: query, pos, ord, x, y, z (pos orders the targets). The colour comes from the number of targets
    that remain, so asking again can repeat a hue. An empty query is refused.
    """
    q = query.strip()
    if not q:
        raise ValueError("empty query")
    rest = targets.where(~F.col("query").eqNullSafe(q))
    at = rest.agg(F.countDistinct("query").alias("n"), F.coalesce(F.max("pos"), F.lit(-1)).alias("last")).first()
    new = points.select(F.lit(q).alias("query"), F.lit(at["last"] + 1).cast("long").alias("pos"), "ord", "x", "y", "z").withColumns({k: c for k, c in hue_rgb(F.lit(at["n"])).items()})
    return rest.unionByName(new, allowMissingColumns=True)


def clear(targets: DataFrame) -> tuple[DataFrame, int]:
    """No targets, and how many there were."""
    return targets.where(F.lit(False)), targets.select("query").distinct().count()
