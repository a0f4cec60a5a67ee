"""Exact percentiles of groups, with linear interpolation, whatever a group's size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from terrafold.operators.skew import bucket_of, hot_buckets
from terrafold.session import stored

#: Rows beyond which a hash bucket's groups are ranked by a sort over all tasks instead of one value table a group.
HOT_ROWS = 1_000_000


def percentiles(rows: DataFrame, keys: list[str], wanted: dict[str, tuple[str, float]]) -> DataFrame:
    """keys and one column for each name of `wanted`: name -> (column, share in 0..1), as `percentile` gives it.

    Nulls are ignored, NaN is the largest value; a null key is a group of its own; a group of nulls only has null. Keys in
    hash buckets of more than HOT_ROWS rows are ranked in a range sort of their distinct values (`_ranked`), so no task
    holds a hot group; the others use the built-in aggregate. Both give the same numbers.
    """
    plain = [F.percentile(c, q).alias(name) for name, (c, q) in wanted.items()]
    hot = hot_buckets(rows, keys, HOT_ROWS)
    if not hot:
        return rows.groupBy(*keys).agg(*plain)
    is_hot = bucket_of(keys).isin(hot)
    cold = rows.where(~is_hot).groupBy(*keys).agg(*plain)
    large = rows.where(is_hot)
    out = large.select(*keys).distinct()
    for c in dict.fromkeys(c for c, _ in wanted.values()):
        ranked = _ranked(large, keys, c, {name: q for name, (k, q) in wanted.items() if k == c})
        same = [out[k].eqNullSafe(ranked[k]) for k in keys]
        out = out.join(ranked, same, "left").select(out["*"], *[ranked[n] for n in ranked.columns if n not in keys])
    return cold.unionByName(out)


def _ranked(rows: DataFrame, keys: list[str], column: str, shares: dict[str, float]) -> DataFrame:
    """Percentiles by rank: distinct values with counts, range-sorted; ranks from counts of whole partitions and within them."""
    v = F.col(column).cast("double") + 0.0
    counted = rows.where(F.col(column).isNotNull()).groupBy(*keys, v.alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
    placed = stored(counted.repartitionByRange(*keys, "_v").withColumn("_p", F.spark_partition_id()))
    per = placed.groupBy(*keys, "_p").agg(F.sum("_n").alias("_c"))  # a row a group and partition
    w = Window.partitionBy(*keys)
    before = F.coalesce(F.sum("_c").over(w.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    per = per.withColumn("_before", before).withColumn("_total", F.sum("_c").over(w)).drop("_c")
    same = [placed[k].eqNullSafe(per[k]) for k in (*keys, "_p")]
    x = placed.join(per, same).select(placed["*"], "_before", "_total")
    upto = F.sum("_n").over(Window.partitionBy(*keys, "_p").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0))
    x = x.withColumn("_upto", upto + F.col("_before"))

    def at(rank: Column) -> Column:
        return F.max(F.when((F.col("_upto") > rank) & (F.col("_upto") - F.col("_n") <= rank), F.col("_v")))

    aggs, names = [], []
    for name, q in shares.items():
        place = (F.col("_total") - 1) * F.lit(q)
        aggs += [at(F.floor(place)).alias(f"{name}_lo"), at(F.ceil(place)).alias(f"{name}_hi"), F.max(place - F.floor(place)).alias(f"{name}_f")]
        lo, hi, f = (F.col(f"{name}_{s}") for s in ("lo", "hi", "f"))
        names.append(F.when(lo == hi, lo).otherwise((1 - f) * lo + f * hi).alias(name))
    return x.groupBy(*keys).agg(*aggs).select(*keys, *names)
