"""Implausible readings of positions, judged per stream against that stream's own movement.

1. Frames are cut into chunks of `chunk` frame numbers with a margin of `margin` frames on either side, so no stream,
   however hot, is held by one task. Runs of equal readings that reach a chunk's border are joined with those of the
   chunks next to it before they are judged, however long they are.
2. Step lengths between neighbouring frames go into mergeable quantile sketches (counts in logarithmic bins, relative
   error `SKETCH_GAMMA` - 1), kept by stream and hour of day and merged to the stream; partial counts combine map-side.
3. The fences are the expanded interquartile fence and a multiple of the 95th percentile, the wider of the two. A frame is judged
   by the fence of its own hour of day, held within HOUR_RANGE of the stream's, and by the stream's where the hour has few steps.
4. A reading is flagged where it is no position on this planet, where it and at most `MAX_AWAY` neighbours leave the
   path by more than the fence and come back to it, or where it repeats exactly (zero variance) for longer than the
   stream's resolution explains while the image moves on.
"""

from __future__ import annotations

import functools
import operator
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from terrafold.session import cut

SKETCH_GAMMA = 1.05
#: Fence: upper quartile plus so many interquartile ranges, and at least so many times the 95th percentile.
FENCE_IQR, FENCE_P95 = 8.0, 3.5
#: Least fences in metres, for streams that hardly move.
FLOOR_H, FLOOR_Z = 0.6, 0.6
MAX_AWAY = 6
#: An hour's sketch counts from so many steps; its fence may be narrower or wider than the stream's by these factors (a short hour may be mostly wrong readings, and a still one must not make the next start a case).
HOUR_STEPS, HOUR_RANGE = 64, (0.75, 1.5)
#: Altitudes outside are no altitudes of a craft.
ALT_RANGE = (-1000.0, 20000.0)
METRES_PER_DEGREE = 111_195.08
#: Frozen runs: least lengths, the odds at which chance makes a run that long (for each run, so that a stream's length does not matter), displacement in px (and as a share of the stream's median) that counts as moving on.
RUN_ALL, RUN_ALT, RUN_ODDS, MOVING_PX, MOVING_SHARE = 6, 7, 2.5e-5, 8.0, 0.3
#: The odds that a run of equal altitudes goes on come from how many of a stream's runs reach each of these lengths, and from the share of
#: equal altitudes for as many further runs: readings repeat in bouts, so runs of a coarse resolution go on more often than that share says.
RUN_STEPS, RUN_PRIOR = (3, 4, 5, 6), 50

COLUMNS = ["stream", "frame_id", "ts", "displacement", "latitude", "longitude", "altitude"]


def chunked(frames: DataFrame, chunk: int, margin: int) -> DataFrame:
    """The frames' columns in use, with their chunk; frames near a border also go to the neighbour (core = False)."""
    f = frames.where(F.col("stream").isNotNull() & F.col("frame_id").isNotNull()).select(
        "stream", "frame_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), "displacement", "latitude", "longitude", "altitude"
    )
    # Frame numbers count up from 0; what is below counts to the first chunk, which has no neighbour before it.
    own = F.greatest(F.lit(0), F.floor(F.col("frame_id") / chunk))
    pos = F.col("frame_id") - own * chunk
    places = F.array_compact(
        F.array(
            F.struct(own.alias("chunk"), F.lit(True).alias("core")),
            F.when((own > 0) & (pos < margin), F.struct((own - 1).alias("chunk"), F.lit(False).alias("core"))),
            F.when(pos >= chunk - margin, F.struct((own + 1).alias("chunk"), F.lit(False).alias("core"))),
        )
    )
    f = f.withColumn("_p", F.explode(places)).select("*", "_p.*").drop("_p")
    return f.repartition("stream", "chunk")


def _hour() -> Column:
    return F.pmod(F.floor(F.col("us") / 3_600_000_000), F.lit(24)).cast("int")


def step_sketches(chunks: DataFrame) -> DataFrame:
    """Counts of steps: stream, hour, kind (h, z, d: horizontal, vertical, displacement), bin, n. Bin null holds zeros.

    Kind r counts runs of equal altitudes by the lengths in RUN_STEPS that they reach, so that a frozen run, however long, counts once in each.
    """
    w = Window.partitionBy("stream", "chunk").orderBy("frame_id")
    c = chunks.withColumn("_seen", F.lag("frame_id").over(w))
    c = c.where(F.col("_seen").isNull() | (F.col("_seen") != F.col("frame_id")))
    ok = F.col("latitude").isNotNull() & ~F.isnan("latitude") & (F.abs("latitude") <= 90) & F.col("longitude").isNotNull() & ~F.isnan("longitude") & (F.abs("longitude") <= 180)
    alt_ok = F.col("altitude").isNotNull() & ~F.isnan("altitude") & F.col("altitude").between(*ALT_RANGE)
    c = c.withColumn("la", F.when(ok, F.col("latitude"))).withColumn("lo", F.when(ok, F.col("longitude"))).withColumn("al", F.when(alt_ok, F.col("altitude")))
    gap = F.col("frame_id") - F.lag("frame_id").over(w)
    dlon = F.pmod(F.col("lo") - F.lag("lo").over(w) + 180.0, F.lit(360.0)) - 180.0
    h = F.sqrt(F.pow(F.col("la") - F.lag("la").over(w), 2) + F.pow(dlon * F.cos(F.radians("la")), 2)) * METRES_PER_DEGREE / gap
    z = F.abs(F.col("al") - F.lag("al").over(w)) / gap
    back = {k: F.coalesce(F.col("al") == F.lag("al", k).over(w), F.lit(False)) for k in range(1, RUN_STEPS[-1] + 1)}
    reached = F.coalesce(*[F.when(functools.reduce(operator.and_, [back[k] for k in range(1, n)]) & ~back[n], F.lit(n)) for n in RUN_STEPS])
    c = c.select("stream", "chunk", "core", _hour().alias("hour"), h.alias("h"), z.alias("z"), F.col("displacement").alias("d"), reached.alias("r")).where("core")
    kinds = F.explode(F.array(F.struct(F.lit("h").alias("kind"), F.col("h").alias("v")), F.struct(F.lit("z").alias("kind"), F.col("z").alias("v")), F.struct(F.lit("d").alias("kind"), F.col("d").alias("v")), F.struct(F.lit("r").alias("kind"), F.col("r").cast("double").alias("v"))))
    s = c.select("stream", "hour", kinds.alias("k")).select("stream", "hour", "k.*").where(F.col("v").isNotNull() & ~F.isnan("v"))
    bin_ = F.when(F.col("v") > 1e-6, F.ceil(F.log(F.col("v")) / float(np.log(SKETCH_GAMMA))).cast("int"))
    return s.groupBy("stream", "hour", "kind", bin_.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def sketch_quantiles(sketch: DataFrame, by: list[str], quantiles: dict[str, float]) -> DataFrame:
    """Quantiles of merged sketches by `by`; total is the number of values, zeros the share of zeros."""
    merged = sketch.groupBy(*by, "bin").agg(F.sum("n").alias("n"))
    w = Window.partitionBy(*by)
    m = merged.withColumn("total", F.sum("n").over(w)).withColumn("upto", F.sum("n").over(w.orderBy(F.col("bin").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)))
    value = F.when(F.col("bin").isNull(), 0.0).otherwise(F.pow(F.lit(SKETCH_GAMMA), F.col("bin") - 0.5))
    aggs = [F.min(F.when(F.col("upto") >= F.lit(q) * F.col("total"), value)).alias(name) for name, q in quantiles.items()]
    return m.groupBy(*by).agg(*aggs, F.max("total").alias("total"), F.coalesce(F.sum(F.when(F.col("bin").isNull(), F.col("n"))) / F.max("total"), F.lit(0.0)).alias("zeros"))


def fences(sketch: DataFrame) -> DataFrame:
    """One row a stream: fence_h, fence_z, hours_h, hours_z (fences of single hours of day), far_h, far_z (normal 95th percentiles), moves (median displacement), goes_on (odds that a run of equal altitudes goes on), n."""
    q = {"q25": 0.25, "q50": 0.5, "q75": 0.75, "q95": 0.95}
    fence = F.greatest(F.col("q75") + FENCE_IQR * (F.col("q75") - F.col("q25")), FENCE_P95 * F.col("q95"))
    whole = sketch_quantiles(sketch, ["stream", "kind"], q).withColumn("fence", fence)
    # All kinds go through every aggregate, so that the sketch is one plan, computed once.
    hour = sketch_quantiles(sketch, ["stream", "kind", "hour"], q).withColumn("fence", fence).where(F.col("total") >= HOUR_STEPS)
    hour = hour.groupBy("stream", "kind").agg(F.map_from_entries(F.collect_list(F.struct("hour", "fence"))).alias("hours"))  # at most 24 entries
    low, high = (F.col("fence") * k for k in HOUR_RANGE)
    x = whole.join(hour, ["stream", "kind"], "left").withColumn("hours", F.transform_values("hours", lambda k, v: F.least(F.greatest(v, low), high)))
    pick = lambda kind, c: F.max(F.when(F.col("kind") == kind, F.col(c)))
    out = x.groupBy("stream").agg(
        F.coalesce(pick("h", "fence"), F.lit(0.0)).alias("fence_h"),
        F.coalesce(pick("z", "fence"), F.lit(0.0)).alias("fence_z"),
        *[F.first(F.when(F.col("kind") == k, F.col("hours")), ignorenulls=True).alias(f"hours_{k}") for k in ("h", "z")],
        F.coalesce(pick("h", "q95"), F.lit(0.0)).alias("far_h"),
        F.coalesce(pick("z", "q95"), F.lit(0.0)).alias("far_z"),
        pick("d", "q50").alias("moves"),
        F.coalesce(pick("z", "zeros"), F.lit(0.0)).alias("still"),
        F.coalesce(pick("z", "total"), F.lit(0)).alias("n"),
    )
    at = {n: F.coalesce(F.sum(F.when((F.col("kind") == "r") & (F.col("bin") == int(np.ceil(np.log(n) / np.log(SKETCH_GAMMA)))), F.col("n"))), F.lit(0)) for n in RUN_STEPS}
    went, could = (sum((at[n] for n in steps[1:]), at[steps[0]]) for steps in (RUN_STEPS[1:], RUN_STEPS[:-1]))
    runs = sketch.groupBy("stream").agg(went.alias("_went"), could.alias("_could"))
    out = out.join(runs, "stream", "left").fillna(0, ["_went", "_could"])
    return out.withColumn("goes_on", (F.col("_went") + RUN_PRIOR * F.col("still")) / (F.col("_could") + RUN_PRIOR)).drop("_went", "_could")


def _excursions(a: np.ndarray, fid: np.ndarray, sec: np.ndarray, fences: np.ndarray | float, far: float) -> np.ndarray:
    """Flags of the rows of `a` (n x dims, metres) that leave the path and come back within MAX_AWAY rows; fences: of each row."""
    flag = np.zeros(len(a), bool)
    if len(a) < 3:
        return flag
    idx, fences = np.arange(len(a)), np.broadcast_to(np.asarray(fences, float), (len(a),))
    usual = np.median(np.diff(sec)) if len(sec) > 1 else 1.0
    pause = max(8.0 * usual, 3.0)
    for away in range(1, MAX_AWAY + 1):
        if len(idx) < away + 2:
            break
        p, f, t, fence = a[idx], fid[idx].astype(float), sec[idx], fences[idx]
        d1 = np.sqrt(((p[1:] - p[:-1]) ** 2).sum(1))
        g1 = np.maximum(1.0, f[1:] - f[:-1])
        jump = d1 > np.maximum(fence[1:], fence[:-1]) + far * (g1 - 1)
        if not jump.any():
            break
        n = len(idx)
        s = np.nonzero(jump[: n - 1 - away])[0] + 1  # first row away; s - 1 and s + away exist
        s = s[jump[s + away - 1]]
        bad = np.zeros(n, bool)
        if len(s):
            back = np.sqrt(((p[s + away] - p[s - 1]) ** 2).sum(1))
            ok = (back <= np.maximum(fence[s], 1.5 * far * (f[s + away] - f[s - 1]))) & (t[s + away - 1] - t[s - 1] < pause * (away + 2)) & (t[s + away] - t[s + away - 1] < pause * 2)
            for k in range(away):  # every row between must be away from both ends
                ok &= np.minimum(np.sqrt(((p[s + k] - p[s - 1]) ** 2).sum(1)), np.sqrt(((p[s + k] - p[s + away]) ** 2).sum(1))) > fence[s + k]
            for k in range(away):
                bad[s[ok] + k] = True
        if away <= 3:
            # At the start or end of an unbroken stretch the path is known on one side only.
            broken = (t[1:] - t[:-1]) > pause
            first = np.r_[0, np.nonzero(broken)[0] + 1]
            last = np.r_[np.nonzero(broken)[0], n - 1]
            for b, e in zip(first, last):
                if e - b + 1 >= away + 5:
                    if jump[b + away - 1] and not jump[b + away : b + away + 3].any():
                        bad[b : b + away] = True
                    if jump[e - away] and not jump[e - away - 3 : e - away].any():
                        bad[e - away + 1 : e + 1] = True
        if bad.any():
            flag[idx[bad]] = True
            idx = idx[~bad]
    return flag


def _runs(eq: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start of the run and run length of each row; eq[i]: row i equals row i - 1."""
    start = np.maximum.accumulate(np.where(eq, 0, np.arange(len(eq))))
    return start, np.bincount(start, minlength=len(eq))[start]


def judge(g: pd.DataFrame) -> tuple[np.ndarray, list[tuple]]:
    """Flags of one chunk's frames (sorted, one row a frame_id), with its fences in each row, and its border runs (EDGES)."""
    lat, lon, alt = (g[c].to_numpy(float) for c in ("latitude", "longitude", "altitude"))
    fid, sec, dis = g.frame_id.to_numpy(), g.us.to_numpy() / 1e6, g.displacement.to_numpy(float)
    r = g.iloc[0]
    bad_pos = (np.abs(lat) > 90) | (np.abs(lon) > 180)
    bad_alt = (alt < ALT_RANGE[0]) | (alt > ALT_RANGE[1])
    flag = bad_pos | bad_alt
    ok = np.isfinite(lat) & np.isfinite(lon) & ~bad_pos
    if ok.sum() >= 3:
        la, lo = lat[ok], lon[ok]
        mid = np.median(la)
        ref = lo[0]
        xy = np.stack([((lo - ref + 180.0) % 360.0 - 180.0) * np.cos(np.radians(mid)), la], 1) * METRES_PER_DEGREE
        hit = _excursions(xy, fid[ok], sec[ok], np.maximum(g.fence_h.to_numpy(float)[ok], FLOOR_H), r.far_h)
        flag[np.nonzero(ok)[0][hit]] = True
    ok = np.isfinite(alt) & ~bad_alt
    if ok.sum() >= 3:
        hit = _excursions(alt[ok][:, None], fid[ok], sec[ok], np.maximum(g.fence_z.to_numpy(float)[ok], FLOOR_Z), r.far_z)
        flag[np.nonzero(ok)[0][hit]] = True
    core = np.nonzero(g.core.to_numpy(bool))[0]
    if not len(core):
        return flag, []
    lat, lon, alt, dis, fid = lat[core], lon[core], alt[core], dis[core], fid[core]
    moves = r.moves if r.moves == r.moves and r.moves is not None else 0.0
    moving = max(MOVING_PX, MOVING_SHARE * moves)
    goes_on = min(max(float(r.goes_on), 1e-4), 0.95)
    least_alt = max(RUN_ALT, 1 + int(np.ceil(np.log(1 / RUN_ODDS) / -np.log(goes_on))))
    same_alt = np.r_[False, alt[1:] == alt[:-1]]
    same_all = same_alt & np.r_[False, (lat[1:] == lat[:-1]) & (lon[1:] == lon[:-1])]
    edges, full = [], np.zeros(len(core), bool)
    for kind, (eq, least) in enumerate(((same_all, RUN_ALL), (same_alt, least_alt))):
        start, length = _runs(eq)
        for s in {0, int(start[-1])}:
            e = s + length[s]
            d = dis[s + 1 : e]
            d = d[np.isfinite(d)]
            up, low = d[d >= moving], d[d < moving]
            edges.append((r.stream, r.chunk, kind, s, s == 0, e == len(eq), lat[s], lon[s], alt[s], fid[s:e], dis[s], len(d), len(up), low.max() if len(low) else None, up.min() if len(up) else None, least, moving))
        for s in np.unique(start[length >= least]):
            e = s + length[s]
            if s == 0 or e == len(eq):
                continue
            # What repeats altitude alone around a run that repeats all three is judged for itself.
            known = np.nonzero(full[s + 1 : e])[0] + s + 1
            for a, b in ((s, e),) if not len(known) else ((s, int(known[0])), (int(known[-1]), e)):
                d = dis[a + 1 : b]
                d = d[np.isfinite(d)]
                if b - a >= least and len(d) and np.median(d) >= moving:
                    flag[core[a + 1 : b]] = True
                    full[a + 1 : b] |= kind == 0
    return flag, edges


#: The first and the last run of equal readings (kind 0: all three, 1: altitude) of a chunk: place and value, frame_ids, displacement
#: of the first frame, and of the others how many are known, how many show motion, the largest that does not, the smallest that does.
EDGES = "stream long, chunk long, kind int, at int, head boolean, tail boolean, latitude double, longitude double, altitude double, ids array<long>, d0 double, known long, up long, below double, above double, least int, moving double"
_EDGES = [c.split()[0] for c in EDGES.split(", ")]


def border_runs(edges: DataFrame) -> DataFrame:
    """Frames (stream, frame_id) of frozen runs that reach a chunk's border, the runs of neighbouring chunks joined first.

    The median displacement of a joined run is compared from counts, exactly: the two middle ones matter only if half of them show motion.
    """
    w = Window.partitionBy("stream", "kind").orderBy("chunk", "at")
    before = lambda c: F.lag(c).over(w)
    equal = lambda c: (F.col(c) == before(c)) & ~F.isnan(c)
    linked = F.col("head") & before("tail") & equal("altitude") & ((F.col("kind") == 1) | (equal("latitude") & equal("longitude")))
    e = edges.drop("ids").withColumn("linked", F.coalesce(linked, F.lit(False)))
    e = e.withColumn("run", F.sum((~F.col("linked")).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    d = F.when(F.col("linked") & F.col("d0").isNotNull() & ~F.isnan("d0") & (F.abs("d0") < float("inf")), F.col("d0"))
    size = edges.select("stream", "kind", "chunk", "at", F.size("ids").alias("size"))
    e = e.withColumn("d", d).join(size, ["stream", "kind", "chunk", "at"])
    runs = e.groupBy("stream", "kind", "run").agg(
        F.sum("size").alias("length"),
        F.max("least").alias("least"),
        F.max("moving").alias("moving"),
        F.sum(F.col("known") + F.when(F.col("d").isNotNull(), 1).otherwise(0)).alias("known"),
        F.sum(F.col("up") + F.when(F.col("d") >= F.col("moving"), 1).otherwise(0)).alias("up"),
        F.max(F.greatest("below", F.when(F.col("d") < F.col("moving"), F.col("d")))).alias("below"),
        F.min(F.least("above", F.when(F.col("d") >= F.col("moving"), F.col("d")))).alias("above"),
    )
    middle = (2 * F.col("up") == F.col("known")) & ((F.col("below") + F.col("above")) / 2 >= F.col("moving"))
    frozen = runs.where((F.col("length") >= F.col("least")) & (F.col("known") > 0) & ((2 * F.col("up") > F.col("known")) | middle)).select("stream", "kind", "run")
    parts = e.select("stream", "kind", "chunk", "at", "run", "linked").join(frozen, ["stream", "kind", "run"], "left_semi")
    ids = F.when(F.col("linked"), F.col("ids")).otherwise(F.slice("ids", F.lit(2), F.size("ids")))
    return edges.select("stream", "kind", "chunk", "at", "ids").join(parts, ["stream", "kind", "chunk", "at"]).select("stream", F.explode(ids).alias("frame_id"))


def _judge_partitions(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Judges chunk after chunk of a partition sorted by (stream, chunk, frame_id); a chunk may span two batches."""

    def whole(x: pd.DataFrame) -> pd.DataFrame:
        x = x.reindex(columns=["frame_id", *_EDGES]).astype(object)
        return x.where(x.notna(), None)

    def done(x: pd.DataFrame) -> Iterator[pd.DataFrame]:
        if not len(x):
            return
        key = x[["stream", "chunk", "frame_id"]].to_numpy()
        x = x[np.r_[True, (key[1:] != key[:-1]).any(1)]]
        key = x[["stream", "chunk"]].to_numpy()
        cut = np.r_[0, np.nonzero((key[1:] != key[:-1]).any(1))[0] + 1, len(x)]
        flags, edges = zip(*[judge(x.iloc[a:b]) for a, b in zip(cut[:-1], cut[1:])])
        yield x.loc[np.concatenate(flags) & x.core.to_numpy(bool), ["stream", "frame_id"]].pipe(whole)
        yield pd.DataFrame([e for part in edges for e in part], columns=_EDGES).pipe(whole)

    rest = pd.DataFrame()
    for b in batches:
        b = pd.concat([rest, b], ignore_index=True) if len(rest) else b
        if not len(b):
            continue
        open_ = (b.stream == b.stream.iloc[-1]) & (b.chunk == b.chunk.iloc[-1])
        rest = b[open_]
        yield from done(b[~open_])
    yield from done(rest)


def implausible_frames(frames: DataFrame, chunk: int = 4096, margin: int = 128) -> DataFrame:
    """Distinct (stream, frame_id) of frames whose position the craft cannot have had.

    Null or NaN readings are never flagged but keep their place; rows without stream or frame_id take no part; repeated
    frames count once; an empty table gives no rows; extra columns are ignored.
    """
    c = chunked(frames, chunk, margin)
    stats = fences(step_sketches(c))
    by_chunk = c.select("stream", "chunk").distinct().join(stats, "stream")
    joined = c.join(by_chunk, ["stream", "chunk"])
    own = {f"fence_{k}": F.coalesce(F.try_element_at(f"hours_{k}", _hour()), F.col(f"fence_{k}")) for k in ("h", "z")}
    joined = joined.withColumns(own).drop("hours_h", "hours_z").sortWithinPartitions("stream", "chunk", "frame_id")
    out = cut(joined.mapInPandas(_judge_partitions, f"frame_id long, {EDGES}"))
    inside = out.where("frame_id IS NOT NULL").select("stream", "frame_id")
    return inside.unionByName(border_runs(out.where("frame_id IS NULL").drop("frame_id"))).distinct()
