"""Mixing sources to target shares by weighted fair queueing.

Each source's documents are shuffled by a hash. A document's virtual finish time is its source's cumulative tokens divided
by the source's share; a second use of the source continues where the first ended, up to the repeats allowed. All uses
with a finish time up to the one at which the budget is spent form the mix; sorted by finish time (a range sort) every
prefix of it has the target shares. Without a budget the mix is the largest in which every source with documents keeps
its share. Running sums are taken in two levels, over hash ranges and within them, so no source is held by one task.

A document that straddles that time is left out, with all that its source was still due; so the next documents of the source
that fit are taken in its place, in the same order, until none of those unused fits: what a source gets falls short of what it is due by less
than its smallest document left unused (`_filled`).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from terrafold.session import cut

RANGE_ROWS = 20_000
MAX_SOURCES = 10_000


def targets(mix_targets: DataFrame) -> list[tuple[str, float, int]]:
    """(source in lower case and trimmed, share, repeats) by source; spellings of one source add up their shares."""
    t = mix_targets.where(F.col("source").isNotNull()).groupBy(F.lower(F.trim("source")).alias("source"))
    rows = t.agg(F.sum("target_share").alias("share"), F.max("max_repeats").alias("repeats")).limit(MAX_SOURCES + 1).collect()
    if len(rows) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    clean = lambda v: float(v) if v is not None and v == v and v > 0 else 0.0
    return sorted((r["source"], clean(r["share"]), max(0, r["repeats"] or 0)) for r in rows)


def spent_at(supply: dict[str, int], wanted: list[tuple[str, float, int]], budget: int | None) -> float:
    """The finish time at which the budget is spent; without one, the earliest at which a source runs out."""
    ends = sorted((supply[s] * k / w, w) for s, w, k in wanted if w > 0 and k > 0 and supply.get(s, 0) > 0)
    if not ends:
        return 0.0
    if budget is None:
        return ends[0][0]
    spent, at, rate = 0.0, 0.0, sum(w for _, w in ends)
    for end, w in ends:  # shares are served at a constant rate until a source runs out
        if spent + (end - at) * rate >= budget:
            return at + (budget - spent) / rate
        spent, at, rate = spent + (end - at) * rate, end, rate - w
    return at


def _filled(x: DataFrame, gaps: dict[str, float], rounds: int = 200) -> DataFrame | None:
    """(source, doc_id) of documents used once more so that no source's gap, in tokens, holds another one; None if none fits.

    x: doc_id, source, n_tokens, range, h, times, max_repeats. A round takes, in order, documents of at most half the gap as long as their
    running sum fits, which leaves less than half of it; where all left are larger, the largest that fits ends the source.
    So rounds number the logarithm of the gap. The driver sees one number a source. A document is taken at most once here.
    """
    spark, taken = x.sparkSession, None
    gaps = {k: int(g) for k, g in gaps.items() if g >= 1}
    free = x.where((F.col("times") < F.col("max_repeats")) & (F.col("n_tokens") <= max(gaps.values(), default=0)))
    for _ in range(rounds):
        if not gaps:
            return taken
        g = F.broadcast(spark.createDataFrame(list(gaps.items()), "source string, gap long"))  # at most MAX_SOURCES rows
        left = free if taken is None else free.join(taken, ["source", "doc_id"], "left_anti")
        left = left.join(g, "source").where(F.col("n_tokens") <= F.col("gap"))
        half = F.col("n_tokens") * 2 <= F.col("gap")
        state = {r["source"]: r["small"] for r in left.groupBy("source").agg(F.max(half).alias("small")).collect()}
        gaps = {k: v for k, v in gaps.items() if k in state}
        if not gaps:
            return taken
        many, last = [k for k, v in state.items() if v], [k for k, v in state.items() if not v]
        some = left.where(F.col("source").isin(many) & half)
        sums = some.groupBy("source", "times", "range").agg(F.sum("n_tokens").alias("tokens"))
        before = Window.partitionBy("source").orderBy("times", "range").rowsBetween(Window.unboundedPreceding, -1)
        offsets = sums.withColumn("offset", F.coalesce(F.sum("tokens").over(before), F.lit(0))).drop("tokens")
        near = some.join(offsets, ["source", "times", "range"]).where(F.col("offset") < F.col("gap"))  # the first ranges only
        inner = Window.partitionBy("source", "times", "range").orderBy("h", "doc_id").rowsBetween(Window.unboundedPreceding, 0)
        fits = near.withColumn("upto", F.col("offset") + F.sum("n_tokens").over(inner)).where(F.col("upto") <= F.col("gap"))
        ends = left.where(F.col("source").isin(last)).groupBy("source").agg(F.max_by(F.struct("doc_id", "n_tokens"), F.struct("n_tokens", -F.col("times"), -F.col("h"), -F.col("doc_id"))).alias("m"))
        now = cut(fits.select("source", "doc_id", "n_tokens").unionByName(ends.select("source", "m.*")))
        for r in now.groupBy("source").agg(F.sum("n_tokens").alias("n")).collect():
            gaps[r["source"]] -= r["n"]
        gaps = {k: v for k, v in gaps.items() if v >= 1}
        taken = now.select("source", "doc_id") if taken is None else taken.unionByName(now.select("source", "doc_id"))
    raise ArithmeticError(f"gaps {gaps} after {rounds} rounds")


def mixed(sizes: DataFrame, mix_targets: DataFrame, budget: int | None = None, seed: int = 1) -> tuple[DataFrame, DataFrame]:
    """(uses, shares). sizes: doc_id, source, n_tokens.

    uses: doc_id, source, n_tokens, times_used, first_finish - one row for each document of a target source, also where it is
    not used. shares: source, target_share, max_repeats, available, used_tokens, used_docs, actual_share, due_tokens (what the
    target asks for, at most budget in sum); sources without documents have 0, and the others share what they leave in proportion.
    Each source with documents gets at most what it is due, and less by less than its smallest document not used up.
    Documents without a target source and texts of 0 tokens are not used; an empty table gives no uses.
    """
    wanted = targets(mix_targets)
    spark = sizes.sparkSession
    t = spark.createDataFrame(wanted or [("", 0.0, 0)], "source string, target_share double, max_repeats int").where(F.col("source") != "" if not wanted else F.lit(True))
    names = [s for s, _, _ in wanted]
    d = sizes.where(F.col("source").isin(names) & (F.col("n_tokens") > 0)).select("doc_id", "source", "n_tokens").withColumn("h", F.xxhash64("doc_id", F.lit(seed)))
    n = d.count()
    bits = max(0, (max(1, n) // RANGE_ROWS).bit_length())
    # Hash ranges: the top bits of the hash, in the order of the signed number.
    d = d.withColumn("range", F.shiftright("h", 64 - bits) if bits else F.lit(0).cast("long"))
    sums = d.groupBy("source", "range").agg(F.sum("n_tokens").alias("tokens"))
    before = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.withColumn("offset", F.coalesce(F.sum("tokens").over(before), F.lit(0))).withColumn("total", F.sum("tokens").over(Window.partitionBy("source"))).drop("tokens")
    supply = {r["source"]: r["total"] for r in sums.groupBy("source").agg(F.sum("tokens").alias("total")).collect()}
    finish = spent_at(supply, wanted, budget)
    due = {s: min(finish * w, float(supply[s] * k)) for s, w, k in wanted if supply.get(s, 0) > 0 and w > 0}
    inner = Window.partitionBy("source", "range").orderBy("h", "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    x = d.withColumn("within", F.sum("n_tokens").over(inner)).join(offsets, ["source", "range"]).join(F.broadcast(t), "source")
    cum = F.col("offset") + F.col("within")
    # The use in pass k ends at k * total + cum; so many passes end in time. A hair of slack keeps the last document of a source that runs out.
    times = F.floor((F.lit(finish) * (1 + 1e-12) * F.col("target_share") - cum) / F.col("total")) + 1
    x = cut(x.select(
        "doc_id", "source", "n_tokens", "range", "h", "max_repeats",
        F.when(F.col("target_share") > 0, F.greatest(F.lit(0), F.least(times, F.col("max_repeats").cast("long")))).otherwise(0).cast("int").alias("times"),
        F.when(F.col("target_share") > 0, cum / F.col("target_share")).alias("first_finish"), F.col("total").alias("_total"), F.col("target_share").alias("_share"),
    ))
    in_time = {r["source"]: r["n"] for r in x.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("times")).alias("n")).collect()}
    more = _filled(x.where(F.col("_share") > 0), {s: v * (1 + 1e-12) - in_time.get(s, 0) for s, v in due.items()})
    times_used = F.col("times")
    if more is not None:
        x = x.join(more.withColumn("_more", F.lit(1)), ["source", "doc_id"], "left")
        times_used = times_used + F.coalesce("_more", F.lit(0))
    uses = x.select("doc_id", "source", "n_tokens", times_used.cast("int").alias("times_used"), "first_finish", "_total", "_share")
    per = uses.groupBy("source").agg(F.sum("n_tokens").alias("available"), F.sum(F.col("n_tokens") * F.col("times_used")).alias("used_tokens"), F.sum((F.col("times_used") > 0).cast("long")).alias("used_docs"))
    of = F.broadcast(spark.createDataFrame(list(due.items()), "source string, due_tokens double"))
    s = F.broadcast(t).join(per, "source", "left").join(of, "source", "left").fillna(0, ["available", "used_tokens", "used_docs"]).fillna(0.0, ["due_tokens"])
    all_used = F.sum("used_tokens").over(Window.partitionBy(F.lit(1)))  # at most MAX_SOURCES rows
    shares = s.withColumn("actual_share", F.when(all_used > 0, F.col("used_tokens") / all_used).otherwise(0.0))
    return uses, shares


def stream(uses: DataFrame) -> DataFrame:
    """The mix in order: doc_id, source, pass, n_tokens, finish, range-sorted by finish time."""
    u = uses.where(F.col("times_used") > 0).withColumn("pass", F.explode(F.sequence(F.lit(0), F.col("times_used") - 1)))
    return u.select("doc_id", "source", "pass", "n_tokens", (F.col("first_finish") + F.col("pass") * F.col("_total") / F.col("_share")).alias("finish")).orderBy("finish", "source", "doc_id")
