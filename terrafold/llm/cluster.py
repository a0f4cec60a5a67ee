"""Grouping the points of each target into objects by reciprocal-nearest-neighbour average linkage on a sparse graph.

Linked are points of a target at most `reach` apart, reach being a share of the diagonal of the target's box; a link's similarity falls
from 1 to 1/2 at that length. Average linkage over the links that exist (a missing link is no information) merges clusters while
their average similarity reaches the threshold. At CHAINS, the similarity of the longest link, it stops exactly when no link is left
between clusters: an object is what a chain of links joins. A higher threshold stops sooner and keeps apart what only
long links join. Each round merges all mutual best pairs; similarities are compared in steps of 1/LEVELS,
and equally good mutual partners merge in the same round, so a hub does not take one round a neighbour.

Cells are so small that any two points of one are similar enough (side reach / sqrt(3) for chains), so cells are the first clusters. They
bound a target's graph by geometry: a box with diagonal d has at most about 140,000 cells of side 0.02 d / sqrt(3), however many points it holds.
A cell sends at most KEEP points to the target's task: all it has, or its outermost ones in 26 directions. Cell pairs that these
neither link nor rule out and that nothing else joins are checked exactly against all their points by a salted join.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from terrafold.operators.skew import GroupSpread, salted_join
from terrafold.session import cut

REACH, LEAST_POINTS, TYPICAL = 0.02, 20, 3
KEEP, LEVELS = 32, 16
#: Similarity of a link as long as the reach, a hair below it: the threshold at which objects are chains. Pairs of points measured at once.
CHAINS, PAIRS = 0.5 - 1e-9, 1_000_000
_BITS = 21
_DIRECTIONS = [o for o in itertools.product((-1, 0, 1), repeat=3) if o > (0, 0, 0)]


def cell_share(threshold: float) -> float:
    """Side of a cell as a share of reach: its diagonal is the longest link of that similarity, and no longer than reach."""
    return min(1.0, 2 * (1 - max(threshold, 0.5))) * (1 - 1e-9) / math.sqrt(3)


def placed_points(segments: DataFrame, reach: float = REACH, threshold: float = CHAINS) -> tuple[DataFrame, bool]:
    """(points, whether a target is hot). Points: target_id, ord, x, y, z, reach (metres of that target) and cell of each distinct point with finite coordinates."""
    inf = float("inf")
    ok = F.col("target_id").isNotNull() & F.col("ord").isNotNull()
    for c in ("x", "y", "z"):
        ok = ok & F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < inf)
    rows = segments.select("target_id", "ord", "x", "y", "z").where(F.coalesce(ok, F.lit(False)))
    spread = GroupSpread(rows, "target_id", "ord")
    pts = spread.place(rows).groupBy("target_id", "_salt", "ord").agg(F.min(F.struct("x", "y", "z")).alias("p")).select("target_id", "_salt", "ord", "p.*")
    box = pts.groupBy("target_id").agg(*[F.min(c).alias(f"lo_{c}") for c in ("x", "y", "z")], *[F.max(c).alias(f"hi_{c}") for c in ("x", "y", "z")])
    diagonal = F.sqrt(sum((F.pow(F.col(f"hi_{c}") - F.col(f"lo_{c}"), 2) for c in ("y", "z")), F.pow(F.col("hi_x") - F.col("lo_x"), 2)))
    box = box.withColumn("reach", F.lit(reach) * diagonal).drop("hi_x", "hi_y", "hi_z")
    p = spread.join(pts, box)
    side = F.when(F.col("reach") > 0, F.col("reach") * cell_share(threshold)).otherwise(1.0)
    i, j, k = (F.floor((F.col(c) - F.col(f"lo_{c}")) / side) for c in ("x", "y", "z"))
    cell = F.shiftleft(i, 2 * _BITS).bitwiseOR(F.shiftleft(j, _BITS)).bitwiseOR(k)
    return p.select("target_id", "ord", "x", "y", "z", "reach", cell.alias("cell")), bool(spread.hot)


def outline(points: DataFrame, hot: bool = True) -> tuple[DataFrame, DataFrame]:
    """(the bounded points that stand for each cell, the cells with their counts): see the module's text.

    Without hot targets a cell's count comes from a window over the points as they lie; else from a map-side combined
    aggregate that is joined, so that no task sees all points of a hot cell.
    """
    cells = points.groupBy("target_id", "cell").agg(F.count(F.lit(1)).alias("n"), F.min("ord").alias("head"), F.min("reach").alias("reach"))
    w = Window.partitionBy("target_id", "cell").orderBy("ord")
    few = points.withColumn("rn", F.row_number().over(w))
    if hot:
        few = few.where(F.col("rn") <= KEEP).drop("reach", "ord").join(cells, ["target_id", "cell"])
    else:
        all_ = Window.partitionBy("target_id", "cell").orderBy("ord").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        few = few.withColumn("n", F.count(F.lit(1)).over(all_)).withColumn("head", F.min("ord").over(all_))
    cols = ["target_id", "cell", "n", "head", "reach", "x", "y", "z"]
    few = few.where(F.col("n") <= KEEP).select(*cols)
    dense = cells.where(F.col("n") > KEEP)
    if dense.isEmpty():
        return few, cells
    rows = salted_join(dense, points.drop("reach"), ["target_id", "cell"], counts=cells.select("target_id", "cell", F.col("n").alias("_n")))
    ends = []
    for d in _DIRECTIONS:
        dot = F.col("x") * d[0] + F.col("y") * d[1] + F.col("z") * d[2]
        ends += [F.min_by("ord", dot), F.max_by("ord", dot)]
    outer = rows.groupBy("target_id", "cell").agg(F.min("n").alias("n"), F.min("head").alias("head"), F.min("reach").alias("reach"), *[e.alias(f"e{i}") for i, e in enumerate(ends)])
    outer = outer.select("target_id", "cell", "n", "head", "reach", F.explode(F.array_distinct(F.array(*[f"e{i}" for i in range(len(ends))]))).alias("ord"))
    outer = outer.join(points.select("target_id", "ord", "x", "y", "z"), ["target_id", "ord"])
    return few.unionByName(outer.select(*cols)), cells


def _components(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least member of each node's component."""
    lab = np.arange(n)
    while len(a):
        m = np.minimum(lab[a], lab[b])
        np.minimum.at(lab, lab[a], m)
        np.minimum.at(lab, lab[b], m)
        while True:
            nxt = lab[lab]
            if (nxt == lab).all():
                break
            lab = nxt
        open_ = lab[a] != lab[b]
        a, b = a[open_], b[open_]
    return lab


def average_linkage(n: int, a: np.ndarray, b: np.ndarray, links: np.ndarray, total: np.ndarray, threshold: float) -> np.ndarray:
    """Cluster of each node. Edges carry the number of links and the sum of their similarities; merges mutual best pairs until none reaches the threshold."""
    label = np.arange(n)
    while len(a):
        sim = total / links
        good = sim >= threshold
        level = np.floor(np.round(sim * LEVELS, 9)).astype(np.int64)
        best = np.full(n, -1, np.int64)
        np.maximum.at(best, a[good], level[good])
        np.maximum.at(best, b[good], level[good])
        mutual = good & (level == best[a]) & (level == best[b])
        if not mutual.any():
            break
        lab = _components(n, a[mutual], b[mutual])
        label = lab[label]
        a, b = lab[a], lab[b]
        keep = a != b
        a, b, links, total = np.minimum(a, b)[keep], np.maximum(a, b)[keep], links[keep], total[keep]
        if not len(a):
            break
        key, inv = np.unique(a * n + b, return_inverse=True)
        links, total = np.bincount(inv, links), np.bincount(inv, total)
        a, b = key // n, key % n
    return label


def _graph(g: pd.DataFrame, threshold: float) -> tuple[np.ndarray, ...]:
    """Cells of one target and the edges among them, PAIRS of points at a time: (cell, n, head, first rows, a, b, links, total, ambiguous a, ambiguous b)."""
    g = g.sort_values("cell", kind="stable")
    cell = g.cell.to_numpy()
    p = g[["x", "y", "z"]].to_numpy(float)
    reach = float(g.reach.iloc[0])
    first = np.r_[0, np.nonzero(cell[1:] != cell[:-1])[0] + 1]
    count = np.diff(np.r_[first, len(cell)])
    ids, n, head = cell[first], g.n.to_numpy()[first], g["head"].to_numpy()[first]
    mask = (1 << _BITS) - 1
    ijk = np.stack([ids >> (2 * _BITS), (ids >> _BITS) & mask, ids & mask], 1)
    aa, bb = [], []
    far = math.ceil(1 / cell_share(threshold) - 1e-6)
    for o in itertools.product(range(-far, far + 1), repeat=3):
        if o <= (0, 0, 0):
            continue
        q = ijk + o
        want = (q[:, 0] << (2 * _BITS)) | (q[:, 1] << _BITS) | q[:, 2]
        at = np.searchsorted(ids, want)
        hit = np.nonzero((q >= 0).all(1) & (at < len(ids)))[0]
        hit = hit[ids[at[hit]] == want[hit]]
        aa.append(hit)
        bb.append(at[hit])
    a, b = np.concatenate(aa), np.concatenate(bb)
    out: list[list[np.ndarray]] = [[], [], [], [], [], []]
    lo, hi = np.minimum.reduceat(p, first), np.maximum.reduceat(p, first)
    size = count[a] * count[b]
    upto = np.cumsum(size)
    for s, e in _blocks(upto):
        ca, cb, m = a[s:e], b[s:e], size[s:e]
        pair = np.repeat(np.arange(len(ca)), m)
        k = np.arange(len(pair)) - np.repeat(np.cumsum(m) - m, m)
        d = np.sqrt(((p[first[ca][pair] + k // count[cb][pair]] - p[first[cb][pair] + k % count[cb][pair]]) ** 2).sum(1))
        near = d <= reach
        links = np.bincount(pair[near], minlength=len(ca)).astype(float)
        total = np.bincount(pair[near], 1.0 - 0.5 * d[near] / reach if reach > 0 else None, minlength=len(ca))
        joined = links > 0
        for x, v in zip(out, (ca[joined], cb[joined], links[joined], total[joined])):
            x.append(v)
        gap = np.sqrt((np.maximum(0, np.maximum(lo[ca] - hi[cb], lo[cb] - hi[ca])) ** 2).sum(1))
        open_ = ~joined & ((n[ca] > count[ca]) | (n[cb] > count[cb])) & (gap <= reach)
        out[4].append(ca[open_])
        out[5].append(cb[open_])
    cat = [np.concatenate(x) if x else np.zeros(0, int) for x in out]
    return (ids, n, head, *cat)


def _blocks(upto: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of cell pairs with about PAIRS pairs of points each, from their running sum; one cell pair has at most (2 KEEP)^2."""
    s = 0
    while s < len(upto):
        e = max(s + 1, int(np.searchsorted(upto, (upto[s - 1] if s else 0) + PAIRS, "right")))
        yield s, e
        s = e


_LABELS = "target_id long, cell long, head_ord long, size long, other long"


def _labels(target, ids, n, head, label) -> pd.DataFrame:
    heads = np.full(len(ids), np.iinfo(np.int64).max)
    np.minimum.at(heads, label, head)
    size = np.bincount(label, n, len(ids)).astype(np.int64)
    return pd.DataFrame({"target_id": target, "cell": ids, "head_ord": heads[label], "size": size[label], "other": pd.array([None] * len(ids), dtype="Int64")})


def _cluster(g: pd.DataFrame, threshold: float = CHAINS) -> pd.DataFrame:
    target = g.target_id.iloc[0]
    ids, n, head, a, b, links, total, oa, ob = _graph(g, threshold)
    if len(oa):
        lab = _components(len(ids), a, b)
        apart = lab[oa] != lab[ob]
        if apart.any():  # to be settled exactly before this target is clustered
            return pd.DataFrame({"target_id": target, "cell": ids[oa[apart]], "head_ord": 0, "size": 0, "other": pd.array(ids[ob[apart]], dtype="Int64")})
    return _labels(target, ids, n, head, average_linkage(len(ids), a, b, links, total, threshold))


def _cluster_settled(g: pd.DataFrame, extra: pd.DataFrame, threshold: float = CHAINS) -> pd.DataFrame:
    if not len(g):
        return pd.DataFrame({c.split()[0]: np.zeros(0, np.int64) for c in _LABELS.split(", ")})
    ids, n, head, a, b, links, total, _, _ = _graph(g, threshold)
    if len(extra):
        a = np.r_[a, np.searchsorted(ids, extra.cell.to_numpy())]
        b = np.r_[b, np.searchsorted(ids, extra.other.to_numpy())]
        links, total = np.r_[links, np.ones(len(extra))], np.r_[total, 1.0 - 0.5 * extra.ratio.to_numpy()]
    return _labels(g.target_id.iloc[0], ids, n, head, average_linkage(len(ids), a, b, links, total, threshold))


def _exact_links(points: DataFrame, pairs: DataFrame, counts: DataFrame) -> DataFrame:
    """Of the cell pairs, those with two points in reach of each other, and the shortest link as a share of reach."""
    side = points.select("target_id", F.col("cell").alias("at"), F.struct("x", "y", "z").alias("p"), "reach")
    c = counts.select("target_id", F.col("cell").alias("at"), F.col("n").alias("_n"))
    left = salted_join(pairs.withColumn("at", F.col("cell")), side.withColumnRenamed("p", "p1"), ["target_id", "at"], counts=c).drop("at")
    right = side.drop("reach").withColumnRenamed("p", "p2")
    both = salted_join(left.withColumn("at", F.col("other")), right, ["target_id", "at"], 200, counts=c)
    d = F.sqrt(sum((F.pow(F.col(f"p1.{k}") - F.col(f"p2.{k}"), 2) for k in ("y", "z")), F.pow(F.col("p1.x") - F.col("p2.x"), 2)))
    return both.withColumn("d", d).where(F.col("d") <= F.col("reach")).groupBy("target_id", "cell", "other").agg(F.min(F.col("d") / F.col("reach")).alias("ratio"))


def objects(segments: DataFrame, reach: float = REACH, least: int = LEAST_POINTS, threshold: float = CHAINS) -> DataFrame:
    """target_id, head_ord, ord, x, y, z: each point of each object of at least `least` points, under its smallest ord.

    threshold: average similarity, from CHAINS to below 1, down to which clusters merge; above CHAINS, a cell of more than KEEP points
    counts by its outermost ones.

    Points with a null or non-finite coordinate, and rows without target_id or ord, are left out; repeated rows count
    once; a target whose points all coincide is one object if large enough; an empty table gives no rows.
    """
    points, hot = placed_points(segments, reach, threshold)
    points = points.persist()  # stays placed by target: what follows needs no further shuffle of it until the end
    kept, cells = outline(points, hot)
    kept = kept.persist()
    found = kept.groupBy("target_id").applyInPandas(lambda g: _cluster(g, threshold), _LABELS).persist()
    labels = found.where(F.col("other").isNull())
    pairs = found.where(F.col("other").isNotNull()).select("target_id", "cell", "other")
    if not pairs.isEmpty():
        links = cut(_exact_links(points, pairs, cells))
        again = kept.join(pairs.select("target_id").distinct(), "target_id", "left_semi")
        labels = labels.unionByName(again.groupBy("target_id").cogroup(links.groupBy("target_id")).applyInPandas(lambda g, e: _cluster_settled(g, e, threshold), _LABELS))
    labels = labels.where(F.col("size") >= least).select("target_id", "cell", "head_ord")
    counts = cells.select("target_id", "cell", F.col("n").alias("_n"))
    return salted_join(labels, points, ["target_id", "cell"], counts=counts).select("target_id", "head_ord", "ord", "x", "y", "z")


def described(members: DataFrame, typical: int = TYPICAL) -> DataFrame:
    """One row an object: its size, centre and the ords of its most typical points (nearest to the centre, then by ord)."""
    centre = members.groupBy("target_id", "head_ord").agg(F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(f"c{c}") for c in ("x", "y", "z")])
    counts = centre.select("target_id", "head_ord", F.col("n").alias("_n"))
    m = salted_join(centre, members, ["target_id", "head_ord"], counts=counts)
    d = sum((F.pow(F.col(c) - F.col(f"c{c}"), 2) for c in ("y", "z")), F.pow(F.col("x") - F.col("cx"), 2))
    top = m.withColumn("d", F.round(d, 9)).withColumn("rn", F.row_number().over(Window.partitionBy("target_id", "head_ord").orderBy("d", "ord"))).where(F.col("rn") <= typical)
    names = top.groupBy("target_id", "head_ord").agg(F.transform(F.array_sort(F.collect_list(F.struct("rn", "ord"))), lambda s: s["ord"]).alias("typical"))
    return centre.join(names, ["target_id", "head_ord"]).select("target_id", "head_ord", "n", *[F.round(f"c{c}", 6).alias(f"c{c}") for c in ("x", "y", "z")], "typical")
