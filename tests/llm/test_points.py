"""Duplicates against history, and objects of targets, against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrafold.llm import cluster, dedup

POINTS = "ord long, x double, y double, z double, conf double"


def brute(site, batch, r=0.05, c=1.0):
    kept, out = list(site), []
    seen = set()
    for o, x, y, z, f in sorted(batch):
        if o in seen or not all(v is not None and np.isfinite(v) for v in (x, y, z, f)):
            continue
        seen.add(o)
        hit = [k[0] for k in kept if np.sqrt((k[1] - x) ** 2 + (k[2] - y) ** 2 + (k[3] - z) ** 2) <= r and abs(k[4] - f) <= c]
        if hit:
            out.append((o, set(hit)))
        else:
            kept.append((o, x, y, z, f))
    return out, [k[0] for k in kept[len(site) :]]


def cloud(rng, n, start, span=1.0):
    return [(start + k, *map(float, np.round(rng.uniform(-span, span, 3), 4)), float(np.round(rng.uniform(0, 4), 3))) for k in range(n)]


def agrees(rep, acc, site, batch):
    want, kept = brute(site, batch)
    got = {r["dup_ord"]: r["kept_ord"] for r in rep.collect()}
    assert got == {o: min(hits) for o, hits in want}
    assert sorted(r["ord"] for r in acc.collect()) == kept


@pytest.mark.parametrize("span", [0.15, 1.0])
def test_accept_matches_brute_force(spark, span):
    rng = np.random.default_rng(int(span * 100))
    site, batch = cloud(rng, 60, 0, span), cloud(rng, 300, 1000, span)
    batch += [(2000 + k, *batch[k][1:]) for k in range(20)] + batch[:10] + [(3000, None, 0.0, 0.0, 1.0), (3001, float("nan"), 0.0, 0.0, 1.0), (3002, 0.0, 0.0, 0.0, None)]
    b = spark.createDataFrame(batch, POINTS).withColumn("token", F.lit(1)).withColumn("k_ord", F.lit("x"))
    acc, rep = dedup.accept(b, dedup.postings(dedup.finite_points(spark.createDataFrame(site, POINTS)), dedup.Reach()))
    agrees(rep, acc, site, batch)
    assert rep.where("kept_ord >= dup_ord").count() == 0 and rep.count() == rep.select("dup_ord").distinct().count()


def test_a_third_are_copies(spark):
    rng = np.random.default_rng(8)
    site = cloud(rng, 200, 0) + [(500 + k, 0.5, 0.5, 0.5, 2.0) for k in range(6000)]
    batch = cloud(rng, 200, 10_000) + [(20_000 + k, 0.5, 0.5, 0.5, 2.0) for k in range(3000)] + [(30_000 + k, 0.5, 0.52, 0.5, 2.5) for k in range(3000)]
    acc, rep = dedup.accept(spark.createDataFrame(batch, POINTS), dedup.postings(dedup.finite_points(spark.createDataFrame(site, POINTS)), dedup.Reach()))
    got = rep.where("dup_ord >= 20000")
    assert got.count() == 6000 and got.select("kept_ord").distinct().collect() == [(500,)]


def test_empty_sides(spark):
    none = spark.createDataFrame([], POINTS)
    some = spark.createDataFrame(cloud(np.random.default_rng(0), 5, 0), POINTS)
    for batch, site, n in ((none, some, 0), (some, none, 5), (none, none, 0)):
        acc, rep = dedup.accept(batch, dedup.postings(dedup.finite_points(site), dedup.Reach()))
        assert acc.count() == n and rep.count() == 0


@pytest.mark.parametrize("hot", [False, True])
def test_index_batch_by_batch_equals_one_go(spark, tmp_path, monkeypatch, hot):
    if hot:
        monkeypatch.setattr(dedup, "HOT_POSTINGS", 2)
        monkeypatch.setattr(dedup, "REPRESENTATIVES", 1)
    monkeypatch.setattr(dedup, "FAN", 3)
    rng = np.random.default_rng(12)
    site, batch = cloud(rng, 80, 0, 0.3), cloud(rng, 320, 1000, 0.3)
    index = dedup.PostingIndex(spark, str(tmp_path / "index"))
    index.append(spark.createDataFrame(site, POINTS), "site")
    reps = {}
    for k in range(4):
        part = spark.createDataFrame(batch[80 * k : 80 * k + 80] + batch[:2], POINTS)  # two rows come again with every batch
        for _ in range(2 if k == 1 else 1):  # the second batch is offered twice, as after a lost driver
            reps |= {r["dup_ord"]: r["kept_ord"] for r in index.offer(part, f"b{k}")[1].collect()}
    want, kept = brute(site, batch)
    assert reps == {o: min(hits) for o, hits in want}
    assert sorted(r["k_ord"] for r in index.read().collect()) == sorted([s[0] for s in site] + kept)
    assert any(n.startswith("L1-") for n in index.generations()) and len(index.generations()) < 5
    # A merged generation that a lost driver did not delete counts no more.
    index._write(index.read().limit(5), "L0-site")
    assert index.read().count() == len(site) + len(kept)


def rows_read(df):
    """Rows that the scan of a plan without shuffles hands on, after row groups are skipped."""
    q = df._jdf.queryExecution()
    q.toRdd().count()
    leaf = q.executedPlan().collectLeaves().apply(0)
    return leaf.metrics().apply("numOutputRows").value()


def test_a_batch_reads_its_own_part_of_the_history_only(spark, tmp_path, monkeypatch):
    """The same batch against a history four times as long, whose other points lie elsewhere."""
    monkeypatch.setattr(dedup, "ROW_GROUP", 4096)
    rng = np.random.default_rng(5)
    place = lambda n, at, start: spark.createDataFrame([(start + k, *map(float, p + at), 1.0) for k, p in enumerate(rng.uniform(0, 8, (n, 3)))], POINTS)
    batch, read = place(200, 0, 10**6), {}
    for much in (1, 4):
        index = dedup.PostingIndex(spark, str(tmp_path / f"index{much}"))
        index.append(place(4000, 0, 0), "here")
        for k in range(much):
            index.append(place(12_000, 400 + 50 * k, 10_000 * (k + 1)), f"there{k}")
        around = index.around(dedup._probes(batch, index.reach))
        read[much] = sum(rows_read(df) for df in around.values())
        assert index.read().count() == 4000 + 12_000 * much
    assert 0 < read[1] <= 4000 and read[4] <= read[1] * 1.1


def test_backlog_of_batches(spark):
    rows = spark.createDataFrame([(b, 10 * b + k) for b in range(6) for k in range(10)] + [(7, 65), (8, 61), (8, 90), (None, 200), (9, None)], "batch long, ord long")
    assert dedup.backlog(rows, 3) == [(0, 19), (20, 39), (40, 90), (200, 200)]
    assert dedup.backlog(rows.limit(0), 3) == []


def test_z_order_tells_cells_apart(spark):
    rows = [(i, j, k) for i in (-3, -1, 0, 1, 700) for j in (-2, 0, 5) for k in (-1, 0, 9)]
    df = spark.createDataFrame(rows, "i long, j long, k long").select("i", "j", "k", dedup.z_order(F.col("i"), F.col("j"), F.col("k")).alias("t"))
    bits = lambda v: sum(((v + (1 << 20)) >> b & 1) << 3 * b for b in range(21))
    assert all(r["t"] == bits(r["i"]) | bits(r["j"]) << 1 | bits(r["k"]) << 2 for r in df.collect())


SEG = "target_id long, query string, ord long, x double, y double, z double"


def brute_objects(rows, least=20):
    out = set()
    pts = {}
    for t, _, o, *p in rows:
        if t is not None and o is not None and all(v is not None and np.isfinite(v) for v in p):
            pts.setdefault(t, {})[o] = p
    for t, d in pts.items():
        o, p = np.array(sorted(d)), np.array([d[k] for k in sorted(d)], float)
        reach = 0.02 * np.sqrt(((p.max(0) - p.min(0)) ** 2).sum())
        near = np.sqrt(((p[:, None] - p[None]) ** 2).sum(2)) <= reach
        lab = np.full(len(p), -1)
        for i in range(len(p)):
            if lab[i] < 0:
                todo = [i]
                lab[i] = i
                while todo:
                    j = todo.pop()
                    for k in np.nonzero(near[j] & (lab < 0))[0]:
                        lab[k] = i
                        todo.append(k)
        for i in np.unique(lab):
            m = o[lab == i]
            if len(m) >= least:
                out |= {(t, int(m.min()), int(k)) for k in m}
    return out


def targets(rng):
    rows, o = [], 0
    for t in range(6):
        scale = 10.0 ** (t - 2)
        for c in range(5):
            centre = rng.uniform(0, 10, 3)
            for p in centre + rng.normal(size=(rng.integers(10, 90), 3)) * 0.12:
                rows.append((t, "q", o, *map(float, p * scale)))
                o += 1
    return rows


@pytest.mark.parametrize("keep", [2, 32])
def test_objects_match_brute_force(spark, monkeypatch, keep):
    monkeypatch.setattr(cluster, "KEEP", keep)
    rng = np.random.default_rng(2)
    rows = targets(rng)
    rows += rows[:40] + [(0, "q", 9001, float("nan"), 0.0, 0.0), (0, None, 9002, None, 0.0, 0.0), (None, "q", 9003, 0.0, 0.0, 0.0)]
    # A dense target: many points a cell, gaps between cells near the reach, so outlines alone don't settle it.
    rows += [(50, "q", 10_000 + k, *map(float, np.round(p, 3))) for k, p in enumerate(np.r_[rng.uniform(0, 0.3, (300, 3)), rng.uniform(0, 0.3, (300, 3)) + [0.55, 0, 0], [[17.0, 0, 0]]])]
    rows += [(51, "q", 20_000 + k, 1.0, 1.0, 1.0) for k in range(25)] + [(52, "q", 21_000 + k, 1.0, 1.0, 1.0) for k in range(19)]
    df = spark.createDataFrame(rows, SEG).withColumn("cell", F.lit("clash")).withColumn("reach", F.lit(1))
    got = {(r["target_id"], r["head_ord"], r["ord"]) for r in cluster.objects(df).collect()}
    assert got == brute_objects(rows)
    assert cluster.objects(df.limit(0)).count() == 0


def test_ambiguous_cells_are_settled_exactly(spark, monkeypatch):
    """Two dense blobs whose only link is between inner points that no outline shows."""
    monkeypatch.setattr(cluster, "KEEP", 4)
    rng = np.random.default_rng(7)
    # reach is 0.02 * 50 = 1; side 0.577. Cells face each other over a gap; hooks reach out in the middle only.
    a = [(float(x), float(y), float(z)) for x, y, z in rng.uniform(0, 0.5, (200, 3))]
    b = [(x + 1.3, y, z) for x, y, z in a]
    rows = [(1, "q", k, *p) for k, p in enumerate([*a, *b, (0.45, 0.25, 0.25), (1.42, 0.25, 0.25), (50.0, 0.0, 0.0)])]
    got = {(r["target_id"], r["head_ord"], r["ord"]) for r in cluster.objects(spark.createDataFrame(rows, SEG)).collect()}
    assert got == brute_objects(rows)


def test_a_higher_threshold_keeps_apart_what_long_links_join(spark):
    """Two tight balls whose only links are nearly as long as the reach, and a third farther away: chains join the two, a threshold does not."""
    rng = np.random.default_rng(9)
    ball = lambda x, n: np.c_[x + rng.uniform(-0.05, 0.05, n), rng.uniform(-0.05, 0.05, (n, 2))]
    p = np.concatenate([ball(0.0, 30), ball(1.0, 30), ball(20.0, 30), [[50.0, 0, 0]]])  # reach is about 1
    df = spark.createDataFrame([(1, "q", k, *map(float, x)) for k, x in enumerate(p)], SEG)
    sizes = lambda **kw: sorted(r["count"] for r in cluster.objects(df, **kw).groupBy("head_ord").count().collect())
    assert sizes() == [30, 60] and sizes(threshold=0.7) == [30, 30, 30]
    loose = np.concatenate([ball(0.0, 30), ball(0.3, 30), [[50.0, 0, 0]]])
    df = spark.createDataFrame([(1, "q", k, *map(float, x)) for k, x in enumerate(loose)], SEG)
    assert sizes(threshold=0.7) == [60] and sizes(threshold=0.95) == [30, 30]


def test_blocks_are_bounded_and_whole(monkeypatch):
    monkeypatch.setattr(cluster, "PAIRS", 10)
    size = np.array([3, 3, 3, 30, 1, 9, 1])
    got = list(cluster._blocks(np.cumsum(size)))
    assert [x for s, e in got for x in range(s, e)] == list(range(7)) and all(size[s:e].sum() <= 10 or e == s + 1 for s, e in got)
    assert list(cluster._blocks(np.zeros(0, int))) == []


def test_average_linkage_merges_best_first():
    a, b = np.array([0, 1, 2, 3]), np.array([1, 2, 3, 4])
    lab = cluster.average_linkage(5, a, b, np.ones(4), np.array([0.9, 0.2, 0.8, 0.7]), 0.5)
    assert lab[0] == lab[1] != lab[2] and lab[2] == lab[3] == lab[4]
    assert (cluster.average_linkage(3, a[:0], b[:0], np.ones(0), np.ones(0), 0.5) == np.arange(3)).all()


def test_description(spark):
    rng = np.random.default_rng(2)
    m = cluster.objects(spark.createDataFrame(targets(rng), SEG))
    d = cluster.described(m).collect()
    rows = m.toPandas()
    for r in d:
        g = rows[(rows.target_id == r["target_id"]) & (rows.head_ord == r["head_ord"])]
        assert r["n"] == len(g) and len(r["typical"]) == 3
        dist = np.sqrt(((g[["x", "y", "z"]] - g[["x", "y", "z"]].mean()) ** 2).sum(1))
        assert r["typical"][0] == g.ord[dist.idxmin()]
