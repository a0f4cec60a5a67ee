"""Duplicates of new points against everything accepted before, through an incremental inverted index.

A point's tokens are the cells that its reach touches. Any accepted point that it repeats has its home cell among them, so
the rare prefix that history must be indexed by is a single token, the home cell: cells are several reaches wide, and nearly
all hold a point or none. A posting also carries its band of confidence, by which the join filters candidates before any
distance is taken, as texts are filtered by length; distance and confidence then verify.

The index is a folder of bucketed tables, so a batch's probes go to the postings' buckets and no posting is shuffled again. Tokens are
numbered along a Z-order curve and each bucket is sorted by token, in row groups that state the range they hold: a batch
reads the row groups of the ranges that its own tokens span, however long the history is. What it accepts it
appends as a generation of its own; generations of one level are merged when there are FAN of them, so a
posting is written again a logarithmic number of times. A batch offered again replaces its generation and gives the same answer.

Within a batch rows are taken by ascending ord: a row is accepted exactly if no accepted row before it is within
reach. This takes rounds: the first open row of each clique cell (any two
points of such a cell repeat each other) meets the open rows around it once; it is accepted if none before it is in
reach, and rows after an accepted one in its reach are repeats of it. A round's pairs number open rows times
neighbouring cells, never the square of a cell.
"""

from __future__ import annotations

import functools
import hashlib
import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from terrafold.operators.skew import bucket_of, hot_buckets, salted_join, spread_join
from terrafold.session import cut, delete_folder, list_folder

POINT = ["ord", "x", "y", "z", "conf"]
#: Postings of a cell from which it is hot, and how many of a clique cell are tried first there.
HOT_POSTINGS, REPRESENTATIVES = 5000, 16
#: Ranges of tokens that a batch is looked up by; generations of a level that are merged into one of the next; bytes of an index file's row group.
RANGES, FAN, ROW_GROUP = 16, 8, 1 << 20
KEYS = ["token", "band"]


@dataclass(frozen=True)
class Reach:
    """Rows repeat each other within `radius` in (x, y, z) and `conf` in conf. Cells are `width` reaches wide."""

    radius: float = 0.05
    conf: float = 1.0
    width: float = 16.0

    @property
    def cell(self) -> float:
        return self.radius * self.width

    @property
    def conf_cell(self) -> float:
        return self.conf * self.width


def finite_points(df: DataFrame) -> DataFrame:
    """ord, x, y, z, conf of rows with an ord, a finite position and a finite conf; -0.0 becomes 0.0."""
    inf = float("inf")
    ok = F.col("ord").isNotNull()
    for c in POINT[1:]:
        ok = ok & F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < inf)
    return df.where(F.coalesce(ok, F.lit(False))).select("ord", *[(F.col(c) + 0.0).alias(c) for c in POINT[1:]])


def clean_points(df: DataFrame) -> DataFrame:
    """finite_points with each ord once: equal ord is the same row (the least of each value stays where they differ)."""
    return finite_points(df).groupBy("ord").agg(*[F.min(c).alias(c) for c in POINT[1:]])


def _floor(c: str, size: float, shift: float = 0.0):
    return F.floor((F.col(c) + shift) / size)


_SEVEN_BITS = f"array({', '.join(f'{sum((n >> b & 1) << 3 * b for b in range(7))}L' for n in range(128))})"


def _spread_bits(v: Column) -> Column:
    """The low 21 bits with two zero bits after each, seven at a time from a table of what seven bits become."""
    table = F.expr(_SEVEN_BITS)
    seven = [F.get(table, F.shiftright(v, at).bitwiseAND(F.lit(127)).cast("int")) for at in (0, 7, 14)]
    return seven[0].bitwiseOR(F.shiftleft(seven[1], 21)).bitwiseOR(F.shiftleft(seven[2], 42))


def z_order(i: Column, j: Column, k: Column) -> Column:
    """Number of a cell along a Z-order curve of 2^21 cells a side; cells farther apart than that share numbers, which costs candidates only."""
    x, y, z = (_spread_bits(F.pmod(c + (1 << 20), F.lit(1 << 21)).cast("long")) for c in (i, j, k))
    return x.bitwiseOR(F.shiftleft(y, 1)).bitwiseOR(F.shiftleft(z, 2))


def probe_tokens(df: DataFrame, r: Reach) -> DataFrame:
    """One row for each cell and band that the point's reach touches; the bounds are widened by a hair against rounding."""
    e = 1.0 + 1e-9
    for c, size, reach, name in (("x", r.cell, r.radius * e, "_x"), ("y", r.cell, r.radius * e, "_y"), ("z", r.cell, r.radius * e, "_z"), ("conf", r.conf_cell, r.conf * e, "band")):
        df = df.withColumn(name, F.explode(F.sequence(_floor(c, size, -reach), _floor(c, size, reach))))
    return df.withColumn("token", z_order(F.col("_x"), F.col("_y"), F.col("_z"))).drop("_x", "_y", "_z")


def _within(a: str, b: str, r: Reach):
    """Verification: within the radius, and conf within its limit."""
    d2 = sum(((F.col(f"{a}{c}") - F.col(f"{b}{c}")) * (F.col(f"{a}{c}") - F.col(f"{b}{c}")) for c in ("y", "z")), (F.col(f"{a}x") - F.col(f"{b}x")) * (F.col(f"{a}x") - F.col(f"{b}x")))
    return (F.abs(F.col(f"{a}conf") - F.col(f"{b}conf")) <= r.conf) & (F.sqrt(d2) <= r.radius)


def postings(points: DataFrame, r: Reach) -> DataFrame:
    """The postings of points: token, band and the point."""
    home = z_order(*[_floor(c, r.cell) for c in ("x", "y", "z")])
    return points.select(home.alias("token"), _floor("conf", r.conf_cell).alias("band"), *[F.col(c).alias(f"k_{c}") for c in POINT])


def _clique(r: Reach, prefix: str = ""):
    """Number of a cell so small that any two points in it repeat each other."""
    side = r.radius / math.sqrt(3) * (1 - 1e-9)
    return F.xxhash64(*[_floor(f"{prefix}{c}", side) for c in ("x", "y", "z")], _floor(f"{prefix}conf", r.conf * (1 - 1e-9)))


def _probes(points: DataFrame, r: Reach) -> DataFrame:
    return probe_tokens(points.select(*POINT), r).select(*KEYS, *[F.col(c).alias(f"p_{c}") for c in POINT])


def probe_pairs(points: DataFrame, index: DataFrame, r: Reach) -> DataFrame:
    """(ord, k_ord) of each point and each posting within reach; a pair meets in one token only, the posting's home."""
    return salted_join(_probes(points, r), index, KEYS).where(_within("p_", "k_", r)).select(F.col("p_ord").alias("ord"), "k_ord")


def probe(p: DataFrame, index: DataFrame, r: Reach, hot: list[int] | None = None) -> DataFrame:
    """ord and the least k_ord of each point (by its `_probes`) with a posting within reach; hot: the index's hot buckets, where they are known.

    Cells with few postings are compared in full. In hot ones equal postings are merged and the first REPRESENTATIVES of each clique
    cell are tried: a hit among them is the least of its clique, and they decide nearly all of a group of copies, however jittered.
    Only cliques in which none of them hits are compared in full, from the next posting on and below the least found elsewhere, split
    over tasks; so nothing is missed.
    """
    hot = hot_buckets(index, KEYS, HOT_POSTINGS) if hot is None else hot
    hit = F.when(_within("p_", "k_", r), F.col("k_ord"))
    if not hot:
        return p.join(index, KEYS).groupBy(F.col("p_ord").alias("ord")).agg(F.min(hit).alias("k_ord")).where("k_ord IS NOT NULL")
    is_hot = bucket_of(KEYS).isin(hot)
    cold = p.where(~is_hot).join(index.where(~is_hot), KEYS).groupBy(F.col("p_ord").alias("ord")).agg(F.min(hit).alias("k_ord"))
    same = [*KEYS, "k_x", "k_y", "k_z", "k_conf"]
    dense = index.where(is_hot).groupBy(*same).agg(F.min("k_ord").alias("k_ord")).withColumn("_c", _clique(r, "k_"))
    w = Window.partitionBy(*KEYS, "_c").orderBy("k_ord")
    dense = cut(dense.withColumn("_r", F.row_number().over(w)).withColumn("_next", F.lead("k_ord").over(w)))
    near = cut(p.where(is_hot))
    few = dense.where(F.col("_r") <= REPRESENTATIVES)
    # The least hit of each clique, or else its first posting that was not tried.
    untried = F.when(F.col("_r") == REPRESENTATIVES, F.col("_next"))
    tried = cut(spread_join(near, few, KEYS, HOT_POSTINGS).groupBy("p_ord", *KEYS, "_c").agg(F.min(hit).alias("hit"), F.min(untried).alias("_next")))
    best = tried.groupBy("p_ord").agg(F.min("hit").alias("hit"))
    open_ = tried.where(F.col("hit").isNull() & F.col("_next").isNotNull()).drop("hit").join(best, "p_ord").where(F.col("hit").isNull() | (F.col("_next") < F.col("hit")))
    rest = near.join(open_.select("p_ord", *KEYS, "_c", "hit"), ["p_ord", *KEYS])
    later = dense.where(F.col("_r") > REPRESENTATIVES).drop("_r", "_next")
    full = spread_join(rest, later, [*KEYS, "_c"], HOT_POSTINGS).where(F.col("hit").isNull() | (F.col("k_ord") < F.col("hit")))
    full = full.drop("hit").groupBy("p_ord").agg(F.min(hit).alias("hit"))
    found = best.unionByName(full).select(F.col("p_ord").alias("ord"), F.col("hit").alias("k_ord")).unionByName(cold)
    return found.groupBy("ord").agg(F.min("k_ord").alias("k_ord")).where("k_ord IS NOT NULL")


def resolve_batch(points: DataFrame, r: Reach) -> tuple[DataFrame, DataFrame]:
    """Greedy acceptance by ascending ord among points of distinct ord: (accepted ords, (kept_ord, dup_ord))."""
    open_ = points.select(*POINT)
    accepted, repeats = [], []
    while True:
        # xxhash64 of a cell could join two cells in one group; that only delays a row to a later round.
        leaders = open_.groupBy(_clique(r)).agg(F.min(F.struct(*POINT)).alias("p")).select("p.*")
        # Who stands in the reach of a leader, the leader itself included: pairs of numbers, on which the rest of the round works.
        pairs = cut(probe_pairs(leaders, postings(open_, r), r).select(F.col("ord").alias("lead"), F.col("k_ord").alias("other")))
        seen = pairs.groupBy("lead").agg(F.min("other").alias("first"))
        taken = seen.where(F.col("first") == F.col("lead")).select(F.col("lead").alias("ord"))
        follow = pairs.where(F.col("other") > F.col("lead")).withColumnRenamed("lead", "ord").join(taken, "ord", "left_semi")
        dup = follow.groupBy(F.col("other").alias("dup_ord")).agg(F.min("ord").alias("kept_ord")).select("kept_ord", "dup_ord")
        settled = taken.unionByName(dup.select(F.col("dup_ord").alias("ord")))
        accepted.append(taken)
        repeats.append(dup)
        open_ = cut(open_.join(settled, "ord", "left_anti"))
        if open_.isEmpty():
            break
    acc, rep = accepted[0], repeats[0]
    for x in accepted[1:]:
        acc = acc.unionByName(x)
    for x in repeats[1:]:
        rep = rep.unionByName(x)
    return acc, rep


def accept(batch: DataFrame, index: DataFrame, r: Reach = Reach()) -> tuple[DataFrame, DataFrame]:
    """Checks rows (ord, x, y, z, conf, ...) against an index of postings and among themselves, by ascending ord.

    Returns (newly accepted points, repeats): repeats has kept_ord and dup_ord, one row for each repeat, with the least ord
    accepted in its reach - of the index where that has one, else of the batch. Rows with a null or non-finite field are neither. Equal ord
    counts once, and a row that the index holds under its own ord was accepted before: it is neither new nor a repeat. An
    empty batch gives two empty tables; further columns are ignored.
    """
    points = cut(clean_points(batch))
    return _accepted(points, cut(probe(_probes(points, r), index, r)), r)


def _accepted(points: DataFrame, known: DataFrame, r: Reach) -> tuple[DataFrame, DataFrame]:
    """`accept` for clean points of which `known` (ord, k_ord) are near the index."""
    fresh = cut(points.join(known, "ord", "left_anti"))
    taken, dup = resolve_batch(fresh, r)
    new = cut(fresh.join(taken, "ord", "left_semi"))
    again = fresh.join(dup.select(F.col("dup_ord").alias("ord")), "ord", "left_semi")
    pairs = known.where(F.col("k_ord") != F.col("ord")).unionByName(probe(_probes(again, r), postings(new, r), r))
    return new, pairs.select(F.col("k_ord").alias("kept_ord"), F.col("ord").alias("dup_ord"))


class PostingIndex:
    """Postings in a folder that all executors share: one bucketed table a generation, named by its level and what it holds."""

    SCHEMA = "token long, band long, k_ord long, k_x double, k_y double, k_z double, k_conf double"

    def __init__(self, spark: SparkSession, path: str, reach: Reach = Reach(), buckets: int | None = None):
        """buckets: of each table, the session's shuffle partitions unless given; an index must be opened with the number it was made with."""
        self.spark, self.path, self.reach = spark, path.rstrip("/"), reach
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self._hot: dict[str, list[int]] = {}

    def generations(self) -> list[str]:
        """Finished generations; one that a merge has taken in counts no more, should a lost driver have left it."""
        names = [n for n in list_folder(self.spark, self.path) if n.startswith("L") and "_SUCCESS" in list_folder(self.spark, f"{self.path}/{n}")]
        merged = {x["m"] for n in names if n.endswith("-of") for x in self.spark.read.parquet(f"{self.path}/{n}").collect()}
        return [n for n in names if not n.endswith("-of") and n not in merged]

    def _name(self, name: str) -> str:
        return f"postings_{hashlib.md5(f'{self.path}/{name}'.encode()).hexdigest()}"  # noqa: S324 - a name

    def _table(self, name: str) -> DataFrame:
        """A generation's table, entered in the session's catalogue if another session wrote it."""
        t = self._name(name)
        if not self.spark.catalog.tableExists(t):
            self.spark.sql(f"CREATE TABLE {t} ({self.SCHEMA.replace('long', 'bigint')}) USING parquet CLUSTERED BY ({', '.join(KEYS)}) SORTED BY (token) INTO {self.buckets} BUCKETS LOCATION '{self.path}/{name}'")
        return self.spark.table(t)

    def _write(self, rows: DataFrame, name: str) -> None:
        t = self._name(name)
        self.spark.sql(f"DROP TABLE IF EXISTS {t}")
        w = rows.repartition(self.buckets, *KEYS).write.mode("overwrite").option("path", f"{self.path}/{name}").option("parquet.block.size", ROW_GROUP)
        w.bucketBy(self.buckets, *KEYS).sortBy("token").saveAsTable(t)
        self._hot.pop(name, None)

    def append(self, points: DataFrame, name: str) -> None:
        """Adds the points' postings as the generation `name`, in place of an earlier one of that name; merges levels that are full."""
        self._write(postings(points, self.reach), f"L0-{name}")
        level = 0
        while len(full := [n for n in self.generations() if n.startswith(f"L{level}-")]) >= FAN:
            into = f"L{level + 1}-{full[0].split('-', 1)[1]}"
            self._write(self._read(full), into)
            self.spark.createDataFrame([(n,) for n in full], "m string").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/{into}-of")
            for n in full:
                self.spark.sql(f"DROP TABLE IF EXISTS {self._name(n)}")
                delete_folder(self.spark, f"{self.path}/{n}")
            level += 1

    def _read(self, names: list[str]) -> DataFrame:
        return functools.reduce(DataFrame.unionByName, [self._table(n) for n in names]) if names else self.spark.createDataFrame([], self.SCHEMA)

    def read(self) -> DataFrame:
        """All postings."""
        return self._read(self.generations())

    def around(self, probes: DataFrame, without: str | None = None) -> dict[str, DataFrame]:
        """By generation, the postings in the ranges of tokens that the probes span: at most RANGES of them, each narrowed to its own tokens, so Parquet skips all other row groups."""
        grid = probes.agg(F.percentile_approx("token", [k / RANGES for k in range(1, RANGES)], 1000)).first()[0]
        if grid is None:
            return {}
        part = F.size(F.filter(F.array(*[F.lit(b) for b in sorted(set(grid))]), lambda b: b < F.col("token")))
        spans = probes.groupBy(part.alias("p")).agg(F.min("token").alias("lo"), F.max("token").alias("hi")).collect()  # at most RANGES rows
        inside = F.lit(False)
        for s in spans:
            inside = inside | F.col("token").between(s["lo"], s["hi"])
        return {n: self._table(n).where(inside) for n in self.generations() if n != f"L0-{without}"}

    def hot(self, name: str) -> list[int]:
        """Hot buckets of a generation, counted once."""
        if name not in self._hot:
            self._hot[name] = hot_buckets(self._table(name), KEYS, HOT_POSTINGS)
        return self._hot[name]

    def offer(self, batch: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
        """Checks a batch, appends what was accepted as generation `name`, and returns (accepted, repeats).

        Offered again under its name, a batch does not meet what it appended itself - as long as that is not merged with later ones,
        after which its accepted rows are known by their ord.
        """
        points = cut(clean_points(batch))
        probes = cut(_probes(points, self.reach))
        near = [probe(probes, rows, self.reach, self.hot(n)) for n, rows in self.around(probes, name).items()]
        none = points.select("ord", F.col("ord").alias("k_ord")).where(F.lit(False))
        known = functools.reduce(DataFrame.unionByName, near, none).groupBy("ord").agg(F.min("k_ord").alias("k_ord"))
        new, repeats = _accepted(points, cut(known), self.reach)
        repeats = cut(repeats)
        self.append(new, name)
        return new, repeats


def backlog(batches: DataFrame, offers: int) -> list[tuple[int, int]]:
    """Waiting batches (batch, ord) as about `offers` ranges of ord (first, last), to be offered in turn: whole batches, and any that overlap in ord together."""
    per = batches.where(F.col("ord").isNotNull()).groupBy("batch").agg(F.count(F.lit(1)).alias("n"), F.min("ord").alias("lo"), F.max("ord").alias("hi")).orderBy("lo", "hi").collect()  # a row a batch
    rows = -(-sum(b["n"] for b in per) // offers)
    out: list[list[int]] = []
    for b in per:
        if out and (b["lo"] <= out[-1][1] or out[-1][2] + b["n"] // 2 <= rows):
            out[-1][1] = max(out[-1][1], b["hi"])
            out[-1][2] += b["n"]
        else:
            out.append([b["lo"], b["hi"], b["n"]])
    return [(lo, hi) for lo, hi, _ in out]
