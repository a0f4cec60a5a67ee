"""Hand-checkable cases of the mapping operators."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrafold.operators import align, geo, joins, mesh, planner, points, quantiles, segments, skew, voxel

SITE = "ord long, x double, y double, z double, r int, g int, b int, conf double, source long"


def site(spark, rows):
    return spark.createDataFrame(rows, SITE)


def pt(o, x, y, z, conf, source=0, rgb=(10, 20, 30)):
    return (o, float(x), float(y), float(z), *rgb, conf if conf is None else float(conf), source)


def test_voxel_tie_takes_last_row(spark):
    m = voxel.voxel_merge(site(spark, [pt(0, 0.01, 0, 0, 2, 0), pt(1, 0.03, 0, 0, 2, 1)]), 0.1).collect()
    assert len(m) == 1 and m[0]["source"] == 1 and m[0]["conf"] == 2 and m[0]["n"] == 2
    assert m[0]["x"] == pytest.approx(0.02)


def test_voxel_without_weight_has_divisor_one(spark):
    m = voxel.voxel_merge(site(spark, [pt(0, 0.05, 0.05, 0.05, 0), pt(1, 0.06, 0.05, 0.05, 0)]), 0.1).first()
    assert (m["x"], m["y"], m["z"], m["conf"]) == (0, 0, 0, 0)


def test_voxel_floors_negative_and_skips_unusable(spark):
    m = voxel.voxel_merge(site(spark, [pt(0, -0.01, 0, 0, 1), pt(1, 0.01, 0, 0, 1), pt(2, float("nan"), 0, 0, 1), pt(3, 0, 0, 0, None)]), 0.1)
    assert sorted(r["vx"] for r in m.collect()) == [-1, 0]
    assert voxel.voxel_merge(site(spark, []), 0.1).count() == 0
    assert voxel.voxel_merge(site(spark, [pt(0, 0, 0, 0, 1)]), 0).count() == 1


def test_fold_is_ordered_and_drop_renumbers(spark):
    maps = [site(spark, [pt(0, 0.31 + 0.2 * k, 0.37, 0.37, 1 + k, k)]) for k in range(3)]
    s = voxel.grow_all(maps, 1.0)
    got = s.first()
    x = 0.31
    conf = 1.0
    for k in (1, 2):
        x = (conf * x + (1 + k) * (0.31 + 0.2 * k)) / (conf + 1 + k)
        conf = max(conf, 1.0 + k)
    assert got["x"] == pytest.approx(x) and got["source"] == 2 and got["conf"] == 3
    two = site(spark, [pt(0, 0, 0, 0, 1, 0), pt(1, 5, 0, 0, 1, 1), pt(2, 9, 0, 0, 1, 2), pt(3, 11, 0, 0, 1, None)])
    assert sorted(voxel.drop_source(two, 1).select("source").collect(), key=str) == sorted([(0,), (1,), (None,)], key=str)


def test_confidence_mask_nan_keeps_nothing(spark):
    rows = [pt(k, k, 0, 0, k + 1, 0) for k in range(9)] + [pt(9, 0, 0, 0, float("nan"), 0)] + [pt(20 + k, k, 0, 0, k + 1, 1) for k in range(10)]
    kept = points.confidence_mask(site(spark, rows), "source", 10.0)
    assert {r["source"] for r in kept.collect()} == {1}
    cut = np.percentile(np.arange(1, 11), 10)
    assert kept.count() == sum(v >= cut for v in range(1, 11))
    assert points.confidence_mask(site(spark, rows), "source", 0).count() == 19


def test_band_of_uniform_confidence_is_empty(spark):
    assert points.confidence_band(site(spark, [pt(k, k, 0, 0, 5, 0) for k in range(100)]), "source").count() == 0


def test_cells_need_thirty_points(spark):
    rng = np.random.default_rng(3)
    rows = []
    for k in range(400):
        rows.append(pt(k, rng.uniform(0, 4.9) if k < 300 else 60.0, rng.uniform(0, 4.9), 0.01 * k, k % 100 + 1, 0))
    c = planner.cells(site(spark, rows), "source").collect()
    assert all(r["n"] >= 30 for r in c) and [r["k"] for r in sorted(c, key=lambda r: (r["ce"], r["cn"]))] == list(range(len(c)))


def test_normals_of_a_tilted_plane(spark):
    rng = np.random.default_rng(1)
    rows = []
    for k in range(600):
        x, y = rng.uniform(0, 4, 2)
        rows.append(pt(k, x, y, 0.5 * x, k % 100 + 1, 0))
    n = planner.normals(planner.cells(site(spark, rows), "source", cell=50.0)).first()
    want = np.array([-0.5, 0, 1]) / math.sqrt(1.25)
    assert np.allclose([n["nx"], n["ny"], n["nz"]], want, atol=1e-6)


def test_frustums_and_alignment_by_hand(spark):
    """Extrinsic: a quarter turn about z and a shift; the numbers are worked out on paper."""
    r, t = [[0.0, -1.0, 0.0], [1.0, 0.0, 0.0], [0.0, 0.0, 1.0]], [1.0, 2.0, 3.0]
    cam = spark.createDataFrame([(r, t, 2.0)], "r array<array<double>>, t array<double>, size double").withColumns(points.camera_pose(F.col("r"), F.col("t")))
    v = {x["vertex"]: (x["vx"], x["vy"], x["vz"]) for x in points.frustums(cam, "size").collect()}
    assert v[0] == (-2.0, 1.0, -3.0)  # -R^T t
    assert v[1] == pytest.approx((-2.0 + 0.75, 1.0 - 1.0, -3.0 + 2.0)) and v[3] == pytest.approx((-2.0 - 0.75, 1.0 + 1.0, -1.0))
    f = points.frustum_faces(spark.createDataFrame([(1, 3)], "i long, n long"), "i", "n").orderBy("face").collect()
    assert [(x["a"], x["b"], x["c"]) for x in f] == [(5, 6, 7), (5, 7, 8), (5, 8, 9), (5, 9, 6)] and (f[0]["red"], f[0]["green"], f[0]["blue"]) == (0, 255, 0)
    a = cam.select(*points.scene_alignment(F.lit(4.0), F.lit(5.0), F.lit(6.0), F.col("r"), F.col("t"))).first()
    assert tuple(a) == (-7.0, 5.0, 3.0)  # d = (-4 - 1, -5 - 2, 6 - 3), then R^T d


def test_report_and_stats_count_kept_rows_only(spark):
    rows = [pt(k, k, 0, 0, k + 1, 0) for k in range(10)] + [pt(10, float("nan"), 0, 0, 50, 0), pt(11, 0, 0, 0, 0, 1), pt(12, 0, 0, 0, 3, None)]
    r = {x["source"]: x for x in points.confidence_report(site(spark, rows), "source").collect()}
    kept = [v for v in range(1, 11) if v >= np.percentile([*range(1, 11), 50], 10)]
    assert (r[0]["total"], r[0]["high"]) == (11, len(kept)) and r[0]["mean_conf"] == pytest.approx(np.mean(kept)) and r[0]["std_conf"] == pytest.approx(np.std(kept))
    assert (r[1]["total"], r[1]["high"], r[1]["mean_conf"], r[1]["coverage"]) == (1, 0, 0.0, 0.0) and r[None]["high"] == 1
    s = {x["source"]: x for x in points.confidence_stats(site(spark, rows), "source").collect()}
    assert s[0]["median_confidence"] == np.median(kept) and s[1]["mean_confidence"] is None and s[1]["num_points"] == 0
    whole = points.confidence_stats(site(spark, rows), "source", None).where("source = 1").first()
    assert whole["mean_confidence"] == 0.0
    assert points.confidence_report(site(spark, []), "source").count() == 0 and points.confidence_stats(site(spark, []), "source").count() == 0


def test_percentiles_of_hot_groups_equal_the_plain_ones(spark, monkeypatch):
    rng = np.random.default_rng(8)
    rows = [(g, float(v), float(w)) for g, n in (("hot", 3000), ("few", 3), (None, 400)) for v, w in zip(rng.integers(0, 40, n) / 4, rng.normal(size=n))]
    rows += [("hot", None, 1.0), ("void", None, None), ("hot", float("nan"), -0.0)]
    df = spark.createDataFrame(rows, "g string, v double, w double").withColumn("_p", F.lit(5))
    wanted = {"a": ("v", 0.1), "b": ("v", 0.5), "c": ("w", 0.05), "d": ("w", 1.0)}
    plain = {r["g"]: tuple(r) for r in quantiles.percentiles(df, ["g"], wanted).collect()}
    monkeypatch.setattr(quantiles, "HOT_ROWS", 100)
    got = {r["g"]: tuple(r) for r in quantiles.percentiles(df, ["g"], wanted).collect()}
    assert set(got) == set(plain) == {"hot", "few", None, "void"}
    for g, want in plain.items():
        assert got[g][0] == want[0] and all((a is None and b is None) or a == pytest.approx(b, rel=1e-12) for a, b in zip(got[g][1:], want[1:]))


def test_nearest_of_clustered_points(spark):
    rng = np.random.default_rng(11)
    b = np.concatenate([rng.normal(0, 1e-3, (900, 3)), np.full((50, 3), 0.5), [[1e6, 0, 0]]])
    a = np.concatenate([rng.normal(0, 1e-3, (100, 3)), [[9e5, 1, 1]]])
    mk = lambda m: spark.createDataFrame([(k, *map(float, v)) for k, v in enumerate(m)], "id long, x double, y double, z double")
    got = {r["id"]: r["dst_id"] for r in joins.nearest(mk(a), mk(b)).collect()}
    assert got == {k: int(((p - b) ** 2).sum(1).argmin()) for k, p in enumerate(a)}


def test_segments_by_score_offsets_and_counts(spark):
    i = spark.createDataFrame([(1, 0.5), (2, 0.51), (3, None), (4, float("nan"))], "k int, score double")
    assert [r["k"] for r in segments.above_score(i).collect()] == [2]
    counts = spark.createDataFrame([("a", 0, 2), ("b", 1, 0), ("c", 2, 70_000)], "query string, pos long, n long")
    assert [(r["pos"], r["start"]) for r in segments.running_offsets(counts, "pos", "n").orderBy("pos").collect()] == [(0, 0), (1, 2), (2, 2)]
    got = segments.split_points(spark.range(70_010).withColumnRenamed("id", "ord"), counts).groupBy("query").agg(F.count(F.lit(1)), F.min("ord"), F.max("ord")).collect()
    assert {tuple(r) for r in got} == {("a", 2, 0, 1), ("c", 70_000, 2, 70_001)}


def test_look_at_is_a_rotation(spark):
    df = spark.createDataFrame([(0.3, -0.4, -2.0), (0.0, 0.0, -1.0)], "x double, y double, z double")
    for r in df.select(planner.look_at(F.col("x"), F.col("y"), F.col("z")).alias("r"), "x", "y", "z").collect():
        m = np.array(r["r"])
        d = np.array([r["x"], r["y"], r["z"]])
        assert np.allclose(m.T @ m, np.eye(3), atol=1e-5) and np.allclose(m[:, 2], d / np.linalg.norm(d), atol=1e-5)


def test_geodetic_round_trip(spark):
    rng = np.random.default_rng(2)
    rows = [(float(rng.uniform(-85, 85)), float(rng.uniform(-180, 180)), float(rng.uniform(-100, 5000)), float(rng.uniform(-300, 300)), float(rng.uniform(-300, 300)), float(rng.uniform(-50, 50))) for _ in range(200)]
    df = spark.createDataFrame(rows, "lat0 double, lon0 double, alt0 double, e double, n double, u double")
    c = [F.col(k) for k in ("e", "n", "u", "lat0", "lon0", "alt0")]
    df = df.withColumns(dict(zip(("lat", "lon", "alt"), geo.enu_to_geodetic(*c))))
    e, n, u = geo.geodetic_to_enu(*[F.col(k) for k in ("lat", "lon", "alt", "lat0", "lon0", "alt0")])
    worst = df.select(F.max(F.greatest(F.abs(e - F.col("e")), F.abs(n - F.col("n")), F.abs(u - F.col("u"))))).first()[0]
    assert worst < 1e-5
    back = geo.rebase_enu(df, ("e", "n", "u"), tuple(c[3:]), tuple(c[3:]), ("e2", "n2", "u2"))
    assert back.where("e2 = e AND n2 = n AND u2 = u").count() == 200


def test_decode_fix(spark):
    df = spark.createDataFrame([(float("nan"), 1.0, 2.0), (1.0, 2.0, float("nan")), (None, 1.0, 1.0)], "a double, b double, c double")
    got = [r[0] for r in df.select(geo.decode_fix(F.col("a"), F.col("b"), F.col("c"))).collect()]
    assert got[0] is None and got[2] is None and got[1]["lat"] == 1.0 and math.isnan(got[1]["alt"])


def _track(spark, mirror=False):
    rng = np.random.default_rng(5)
    p = rng.normal(size=(40, 3))
    q, _ = np.linalg.qr(rng.normal(size=(3, 3)))
    if np.linalg.det(q) < 0:
        q[:, 0] *= -1
    if mirror:
        q[:, 0] *= -1
    m = 2.5 * p @ q.T + np.array([3.0, -4.0, 5.0])
    rows = [("m", k, *map(float, a), *map(float, b)) for k, (a, b) in enumerate(zip(p, m))]
    return spark.createDataFrame(rows, "map_id string, frame int, cx double, cy double, cz double, e double, n double, u double"), q


def test_sim3_recovered(spark):
    df, q = _track(spark)
    f = align.fit_sim3(df, "map_id")
    r = f.first()
    assert r["s"] == pytest.approx(2.5) and np.allclose(r["r"], q) and np.allclose(r["t"], [3, -4, 5])
    assert align.rmse(df, f, "map_id").first()["rmse"] < 1e-9
    assert align.icp(df, "map_id").first()["rmse"] < 1e-6


def test_icp_of_large_groups_equals_that_of_small_ones(spark, monkeypatch):
    rng = np.random.default_rng(4)
    rows = [(m, *map(float, a), *map(float, 2.0 * a + rng.normal(0, wide, 3))) for m, k, wide in (("line", 400, 3.0), ("cloud", 300, 0.5), ("few", 40, 1.0)) for a in rng.normal(0, 1, (k, 3)) * ((50, 1, 0.1) if m == "line" else 5)]
    rows += [("cloud", 1.0, 1.0, 1.0, 2.0, 2.0, float("nan")), ("cloud", None, 1.0, 1.0, 2.0, 2.0, 2.0), (None, *rows[0][1:])]
    df = spark.createDataFrame(rows, "map_id string, cx double, cy double, cz double, e double, n double, u double")
    monkeypatch.setattr(align, "TILE", 32, raising=False)
    want, got = ({r["map_id"]: r for r in align.icp(df, "map_id", largest=k).collect()} for k in (20_000, 100))
    assert set(got) == set(want) == {"line", "cloud", "few"} and all(want[m]["rounds"] > 1 for m in want)
    for m, w in want.items():
        assert got[m]["rounds"] == w["rounds"]
        for c in ("s", "r", "t", "rmse"):
            assert np.allclose(got[m][c], w[c], rtol=1e-9, atol=1e-9)


def test_sim3_mirrored_keeps_unsigned_scale(spark):
    df, _ = _track(spark, mirror=True)
    r = align.fit_sim3(df, "map_id").first()
    assert r["s"] == pytest.approx(2.5) and np.linalg.det(np.array(r["r"])) == pytest.approx(1)
    assert align.fit_sim3(df.limit(2), "map_id").count() == 0
    assert align.icp(df.limit(2), "map_id").count() == 0


def test_nearest_matches_brute_force_with_ties(spark):
    rng = np.random.default_rng(9)
    a, b = rng.integers(0, 30, (200, 3)), rng.integers(0, 30, (60, 3))
    b = np.r_[b, [[900, 900, 900]]]
    mk = lambda m: spark.createDataFrame([(k, *map(float, v)) for k, v in enumerate(m)] + [(10**6, None, 1.0, 1.0)], "id long, x double, y double, z double")
    got = {r["id"]: (r["dst_id"], r["dist"]) for r in joins.nearest(mk(a), mk(b)).collect()}
    d = np.sqrt(((a[:, None] - b[None]) ** 2).sum(2))
    assert len(got) == 200 and all(got[k][0] == d[k].argmin() and got[k][1] == pytest.approx(d[k].min()) for k in range(200))
    assert joins.nearest(mk(a), mk(b).limit(0)).count() == 0


def test_zip_rows(spark):
    a, b = spark.createDataFrame([(3,), (1,), (2,)], "v int"), spark.createDataFrame([(30,), (10,)], "v int")
    assert sorted(map(tuple, joins.zip_rows(a, b, ["v"], ["v"]).collect())) == [(1, 10), (2, 30)]
    assert joins.zip_rows(a, b, ["v"], ["v"], "left").where("v_right IS NULL").count() == 1


def test_triangles_with_a_hole(spark):
    rows = [(0, r, c, float(c), float(r), 0.0, not (r == 0 and c == 0)) for r in range(3) for c in range(3)]
    t = mesh.triangles(spark.createDataFrame(rows, "g int, row int, col int, x double, y double, z double, kept boolean"), ["g"])
    assert t.count() == 6 and mesh.drop_long(t, ["g"]).count() == 6 and mesh.vertices(t, ["g"]).count() == 8


def test_segment_upsert_moves_last_and_repeats_hue(spark):
    p = spark.createDataFrame([(0, 1.0, 2.0, 3.0)], "ord long, x double, y double, z double")
    t = spark.createDataFrame([], "query string, pos long, ord long, x double, y double, z double, red int, green int, blue int")
    for q in ("a", "b", " a "):
        t = segments.upsert(t, q, p)
    rows = {r["query"]: r for r in t.collect()}
    assert rows["a"]["pos"] == 2 and rows["b"]["pos"] == 1
    assert (rows["a"]["red"], rows["a"]["green"]) == (rows["b"]["red"], rows["b"]["green"])
    assert segments.clear(t)[1] == 2
    with pytest.raises(ValueError, match="empty"):
        segments.upsert(t, "  ", p)


def test_mask_union_and_quantise(spark):
    m = spark.createDataFrame([(1, True), (1, False), (2, None)], "k int, hit boolean")
    assert dict(map(tuple, segments.union_masks(m, ["k"]).collect())) == {1: True, 2: False}
    v = spark.createDataFrame([(0.9999,), (1.5,), (-0.1,)], "v double").select(points.quantise(F.col("v")), points.quantise(F.col("v"), True))
    assert [tuple(r) for r in v.collect()] == [(254, 254), (382, 255), (-25, 0)]


def test_salted_join_meets_each_pair_once(spark):
    build = spark.createDataFrame([(1, k) for k in range(3000)] + [(2, 5000), (None, 1)], "k long, v long")
    probe = spark.createDataFrame([(1, 7), (1, 8), (2, 9), (3, 10), (None, 11)], "k long, w long")
    for counts in (None, build.groupBy("k").agg(F.count(F.lit(1)).alias("_n"))):
        j = skew.salted_join(probe, build, ["k"], 100, counts)
        assert j.count() == 6001 and j.distinct().count() == 6001


def test_group_spread_splits_hot_groups(spark):
    rows = spark.createDataFrame([("a", k) for k in range(4000)] + [("b", 1)], "g string, k long")
    sp = skew.GroupSpread(rows, "g", "k", rows_per_part=500)
    placed = sp.place(rows)
    assert sp.hot and placed.where("g = 'a'").select("_salt").distinct().count() == 8
    j = sp.join(placed, rows.groupBy("g").agg(F.count(F.lit(1)).alias("n")))
    assert j.count() == 4001 and j.where("g = 'a'").first()["n"] == 4000
