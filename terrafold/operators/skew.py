"""Joins that survive hot keys without replicating everything."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Hash buckets in which hot keys are looked for; what reaches the driver is one number for each.
BUCKETS = 4096


def bucket_of(keys: list[str]) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(BUCKETS)).cast("int")


def bucket_sizes(df: DataFrame, keys: list[str], rows: int) -> dict[int, int]:
    """Rows of the hash buckets of the keys that hold `rows` more than twice the mean: only there can a key be hot."""
    sizes = df.groupBy(bucket_of(keys).alias("_b")).agg(F.count(F.lit(1)).alias("n")).collect()  # at most BUCKETS rows
    mean = sum(r["n"] for r in sizes) / BUCKETS
    return {r["_b"]: r["n"] for r in sizes if r["n"] > rows + 2 * mean}


def hot_buckets(df: DataFrame, keys: list[str], rows: int) -> list[int]:
    """The numbers of those buckets."""
    return sorted(bucket_sizes(df, keys, rows))


def spread_join(probe: DataFrame, build: DataFrame, keys: list[str], rows_per_split: int = 5000) -> DataFrame:
    """The join with every key counted and hot ones split."""
    hot = build.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > rows_per_split)
    return _spread(probe, build, keys, hot, rows_per_split)


def _spread(probe: DataFrame, build: DataFrame, keys: list[str], hot: DataFrame, rows_per_split: int) -> DataFrame:
    """The join in which each key of `hot` (keys, _n rows) is cut into splits: build rows go to one, probe rows to all."""
    h = hot.select(*keys, F.ceil(F.col("_n") / rows_per_split).cast("int").alias("_splits"))
    b = build.join(h, keys, "left").withColumn("_salt", F.when(F.col("_splits").isNull(), 0).otherwise(F.floor(F.rand(7) * F.col("_splits"))).cast("int")).drop("_splits")
    p = probe.join(h, keys, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("_splits"), F.lit(1)) - 1))).drop("_splits")
    return p.join(b, [*keys, "_salt"]).drop("_salt")


def salted_join(probe: DataFrame, build: DataFrame, keys: list[str], rows_per_split: int = 5000, counts: DataFrame | None = None) -> DataFrame:
    """Inner equi-join in which the build rows of a hot key are spread over several splits.

    Hot keys are found from the build side's row counts in BUCKETS hash buckets (pre-aggregated map-side, so next to
    nothing is shuffled); only in buckets that stand out are keys counted one by one. Rows of other buckets join plainly;
    in hot buckets each build row goes to one split of its key and probe rows to all, so each pair still meets exactly
    once. Null keys never match. counts: keys and _n, the build side's rows of each key, where they are known already.
    The build side is read up to three times; cut it before if it is costly.
    """
    if counts is not None:
        hot = counts.where(F.col("_n") > rows_per_split)
        return probe.join(build, keys) if hot.isEmpty() else _spread(probe, build, keys, hot, rows_per_split)
    hot = hot_buckets(build, keys, rows_per_split)
    if not hot:
        return probe.join(build, keys)
    is_hot = bucket_of(keys).isin(hot)
    cold = probe.where(~is_hot).join(build.where(~is_hot), keys)
    return cold.unionByName(spread_join(probe.where(is_hot), build.where(is_hot), keys, rows_per_split))


class GroupSpread:
    """Keeps rows and per-group statistics joinable on (key, _salt), with the rows of hot groups spread over `copies` parts.

    Hot groups are found as in salted_join, from one map-side combined count; there are as many copies as the largest bucket
    fills parts of `rows_per_part`, though no more than a few for each shuffle partition. `place` partitions rows by (key, _salt)
    once; grouping by further columns that `spread_by` fixes, and joining statistics, then needs no further shuffle of the rows.
    """

    def __init__(self, rows: DataFrame, key: str, spread_by: str, rows_per_part: int = 50_000):
        self.key, self.spread_by = key, spread_by
        sizes = bucket_sizes(rows, [key], rows_per_part)
        self.bucket, self.hot = bucket_of([key]), sorted(sizes)
        most = 4 * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        self.copies = min(most, -(-max(sizes.values(), default=1) // rows_per_part))

    def place(self, rows: DataFrame) -> DataFrame:
        if not self.hot:  # a constant salt would be folded away and hide the partitioning from what follows
            return rows.withColumn("_salt", F.lit(0)).repartition(self.key)
        part = F.pmod(F.xxhash64(self.spread_by), F.lit(self.copies)).cast("int")
        return rows.withColumn("_salt", F.when(self.bucket.isin(self.hot), part).otherwise(0)).repartition(self.key, "_salt")

    def join(self, placed: DataFrame, stats: DataFrame) -> DataFrame:
        """placed rows with the statistics (one row a group) of their group; groups without statistics drop out."""
        if not self.hot:
            return placed.join(stats, self.key)
        top = F.when(self.bucket.isin(self.hot), self.copies - 1).otherwise(0)
        return placed.join(stats.withColumn("_salt", F.explode(F.sequence(F.lit(0), top))), [self.key, "_salt"])
