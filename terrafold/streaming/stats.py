"""Counters and bounded histories of streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# A history of more than HISTORY entries is cut to its last KEEP; lines that a log keeps.
HISTORY, KEEP, LOG_LINES = 1000, 500, 200


def history_length(n: Column) -> Column:
    """Entries held after n were added one by one: the history grows to HISTORY, and one more cuts it to its last KEEP."""
    return F.when(n <= HISTORY, n).otherwise(KEEP + F.pmod(n - HISTORY - 1, F.lit(HISTORY - KEEP + 1)))


def bounded_history(rows: DataFrame, group: str, order: str) -> DataFrame:
    """The entries a history of each group holds after all rows (distinct in order): the last history_length of them."""
    w = Window.partitionBy(group)
    x = rows.withColumn("_back", F.row_number().over(w.orderBy(F.desc(order)))).withColumn("_n", F.count(F.lit(1)).over(w))
    return x.where(F.col("_back") <= history_length(F.col("_n"))).drop("_back", "_n")


def selector_stats(selected: DataFrame, seconds: str) -> DataFrame:
    """Per stream of selected frames (stream, seq, kept) and their processing times: total, keyframes, rate in percent, and mean, max and min time over the bounded history; null times are not in it."""
    total = selected.groupBy("stream").agg(F.count(F.lit(1)).alias("total"), F.count_if("kept").alias("keyframes"))
    held = bounded_history(selected.where(F.col(seconds).isNotNull()).select("stream", "seq", F.col(seconds).alias("_s")), "stream", "seq")
    times = held.groupBy("stream").agg(F.avg("_s").alias("mean_s"), F.max("_s").alias("max_s"), F.min("_s").alias("min_s"))
    return total.join(times, "stream", "left").withColumn("rate", 100.0 * F.col("keyframes") / F.col("total"))


def transport_counters(frames: DataFrame, selected: DataFrame) -> DataFrame:
    """One row: connections (streams), frames received (repeats included), frames with a position, keyframes, rate in percent and seconds from the first to the last arrival."""
    us = lambda c: F.unix_micros(c.cast("timestamp"))
    f = frames.agg(F.countDistinct("stream").alias("connections"), F.count(F.lit(1)).alias("frames"), F.count("latitude").alias("with_position"), ((us(F.max("arrived")) - us(F.min("arrived"))) / 1e6).alias("seconds"))
    k = selected.agg(F.count_if("kept").alias("keyframes"), F.count(F.lit(1)).alias("_n"))
    both = f.withColumn("_one", F.lit(1)).join(k.withColumn("_one", F.lit(1)), "_one")  # one row each
    return both.withColumn("rate", F.when(F.col("_n") > 0, 100.0 * F.col("keyframes") / F.col("_n")).otherwise(0.0)).drop("_n", "_one")


def mean_displacement(features: DataFrame, keys: list[str], least: int = 1) -> DataFrame:
    """Mean length of the motion of the features that were found again (x0, y0, x1, y1, status = 1) of each frame pair, and their number; pairs with fewer than `least` drop out."""
    found = features.where(F.col("status") == 1)
    length = F.sqrt(F.pow(F.col("x1") - F.col("x0"), 2) + F.pow(F.col("y1") - F.col("y0"), 2))
    return found.groupBy(*keys).agg(F.count(F.lit(1)).alias("tracked"), F.avg(length).alias("mean_px")).where(F.col("tracked") >= least)


def log_tail(lines: DataFrame, last: int = 10) -> DataFrame:
    """The last lines (seq, line) of a log that holds LOG_LINES, oldest first."""
    return lines.orderBy(F.desc("seq")).limit(min(last, LOG_LINES)).orderBy("seq")
