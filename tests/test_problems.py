"""General problems: filling, implausible readings, proximity; each with its awkward inputs."""

import math

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from terrafold.operators import impute, proximity, spikes
from terrafold.plans import problems

CAM = "map_id string, frame int, cx double, cy double, cz double, gps struct<lat:double,lon:double,alt:double>, gps_fix string"


def track(m, n, seed, lat0=45.0, lon0=10.0):
    rng = np.random.default_rng(seed)
    out = []
    for k in range(n):
        x, y, z = map(float, rng.uniform(-5, 5, 3))
        out.append((m, k, float(x), float(y), float(z), (lat0 + 1e-4 * y + 1e-5 * x, lon0 + 1e-4 * x, 300.0 + 4 * z), "rtk_fixed" if k % 5 else "single"))
    return out


def test_fill_recovers_held_out_values(spark):
    rows = [r for k in range(12) for r in track(f"m{k}", 25, k)]
    held = {(r[0], r[1]): r[5] for r in rows if r[1] in (3, 11)}
    seen = [(*r[:5], (None, float("nan"), 0.0) if r[1] == 3 else None if r[1] == 11 else r[5], " " if r[1] == 3 else r[6]) for r in rows]
    out = impute.fill_keyframes(spark.createDataFrame(seen + seen[:7], CAM)).collect()
    assert len(out) == len(rows)
    for r in out:
        if (r["map_id"], r["frame"]) in held:
            lat, lon, alt = held[(r["map_id"], r["frame"])]
            assert abs(r["lat"] - lat) < 2e-6 and abs(r["lon"] - lon) < 2e-6 and abs(r["alt"] - alt) < 0.2
            assert r["lat_filled"] and r["lon_filled"] and r["alt_filled"] and r["fix_filled"] == (r["frame"] == 3)
            assert r["fix"] == "rtk_fixed" or r["frame"] == 11
        else:
            assert not (r["lat_filled"] or r["lon_filled"] or r["alt_filled"] or r["fix_filled"])


def test_fill_awkward_inputs(spark):
    rows = [
        ("none", 0, 0.0, 0.0, 0.0, None, None), ("none", 1, 0.0, 0.0, 0.0, (0.0, 0.0, -9999.0), "?"),
        ("zero", 0, 0.0, 0.0, 0.0, (1.0, 2.0, 0.0), "dgps"), ("zero", 1, 1.0, 0.0, 0.0, (1.0, 2.0, 12.0), "dgps"),
        ("high", 0, 0.0, 0.0, 0.0, (91.0, 2.0, 0.0), "dgps"), ("high", 1, 1.0, None, float("nan"), (1.0, 200.0, 120.0), "rtk_float"),
        (None, 1, 0.0, 0.0, 0.0, (1.0, 1.0, 1.0), "dgps"), ("x", None, 0.0, 0.0, 0.0, (1.0, 1.0, 1.0), "dgps"),
        ("seam", 0, 0.0, 0.0, 0.0, (5.0, 179.9999, 10.5), "dgps"), ("seam", 1, 1.0, 0.0, 0.0, (5.0, -179.9999, 10.5), "dgps"), ("seam", 2, 0.5, 0.0, 0.0, None, "dgps"),
    ]
    df = spark.createDataFrame(rows, CAM).withColumn("lat", F.lit("clash")).withColumn("fix", F.lit(1)).withColumn("_salt", F.lit(9))
    got = {(r["map_id"], r["frame"]): r for r in impute.fill_keyframes(df).collect()}
    assert len(got) == 9
    assert got[("none", 0)]["lat"] is None and not got[("none", 0)]["fix_filled"]
    assert got[("zero", 0)]["alt"] == 0.0 and not got[("zero", 0)]["alt_filled"]
    assert got[("high", 0)]["alt_filled"] and got[("high", 0)]["lat_filled"] and got[("high", 1)]["lon_filled"] and got[("high", 0)]["lon"] == 2.0
    assert abs(abs(got[("seam", 2)]["lon"]) - 180) < 1e-3 and got[("seam", 2)]["lon_filled"]
    assert impute.fill_keyframes(spark.createDataFrame([], CAM)).count() == 0


def test_statistics_of_gaps_are_the_conditional_ones():
    """Sums over rows with gaps equal those over many draws of the gaps from the model itself."""
    rng = np.random.default_rng(0)
    cov = np.array([[2.0, 1.5, 0.0], [1.5, 3.0, 0.5], [0.0, 0.5, 1.0]])
    m = {"pi": np.array([1.0]), "mu": np.array([[1.0, -1.0, 0.5]]), "sigma": cov[None], "theta": np.full((1, 4), 0.25)}
    whole = rng.multivariate_normal(m["mu"][0], cov, 200_000)
    holed = whole.copy()
    holed[:100_000, 1] = np.nan
    holed[:50_000, 2] = np.nan
    n, mean, second = (lambda s: (s[0], s[1:4], s[4:13].reshape(3, 3)))(impute._sums(holed, np.full(len(holed), -1), m)[:-1].reshape(1, -1)[0])
    assert n == len(whole) and np.allclose(mean / n, whole.mean(0), atol=0.02) and np.allclose(second / n, whole.T @ whole / n, atol=0.05)


def test_likelihood_rises_until_it_stands(spark):
    rng = np.random.default_rng(1)
    small = rng.random(1500) < 0.7
    r = rng.multivariate_normal([0, 0, 0], [[1, 0.8, 0], [0.8, 1, 0], [0, 0, 4]], 1500) * np.where(small, 0.02, 1.5)[:, None]
    c = np.where(small, 0, 3)
    r[rng.random(r.shape) < 0.2] = np.nan
    c[rng.random(len(c)) < 0.2] = -1
    rows = [(*[None if v != v else float(v) for v in x], int(k)) for x, k in zip(r, c)]
    m, seen = impute.fit_mixture(spark.createDataFrame(rows, "re double, rn double, ru double, cat int"), gain=1e-5)
    assert len(seen) < impute.MOST_PASSES and all(b >= a - 1e-6 * abs(a) for a, b in zip(seen, seen[1:])) and seen[-1] > seen[0]
    top = np.argmax(m["pi"])
    assert m["theta"][top, 0] > 0.9 and m["sigma"][top, 0, 0] < 0.01  # the tight residuals are the best fix type's
    empty = impute.fit_mixture(spark.createDataFrame([], "re double, rn double, ru double, cat int"))
    assert empty[1] == [] and np.isfinite(empty[0]["sigma"]).all()


def test_mixture_beats_the_map_alone_on_held_out_values(spark):
    """Errors of east and north go together, and fix types differ in size: what is there tells what is not."""
    rng = np.random.default_rng(2)
    rows, held = [], {}
    for m in range(40):
        for k, (_, frame, x, y, z, (lat, lon, alt), _) in enumerate(track(f"m{m}", 30, 100 + m)):
            bad = rng.random() < 0.4
            e = rng.normal() * (4.0 if bad else 0.05)
            lat, lon, fix = lat + (e + rng.normal() * 0.02) / 111_195, lon + e / 111_195 / np.cos(np.radians(lat)), "single" if bad else "rtk_fixed"
            if k % 6 == 1:
                held[(f"m{m}", frame)] = (lat, fix)
                rows.append((f"m{m}", frame, x, y, z, (None, float(lon), alt), None))
            else:
                rows.append((f"m{m}", frame, x, y, z, (float(lat), float(lon), alt), fix))
    df = spark.createDataFrame(rows, CAM)
    err, right = {}, {}
    for mixture in (False, True):
        out = {(r["map_id"], r["frame"]): r for r in impute.fill_keyframes(df, mixture).collect()}
        err[mixture] = float(np.mean([(out[k]["lat"] - lat) ** 2 for k, (lat, _) in held.items()])) ** 0.5
        right[mixture] = float(np.mean([out[k]["fix"] == fix for k, (_, fix) in held.items()]))
    assert err[True] < 0.6 * err[False] and right[True] > right[False] + 0.1


def test_fill_of_a_hot_map(spark, monkeypatch):
    """The rows of a hot map are spread; nothing else changes."""
    from terrafold.operators import skew

    rows = spark.createDataFrame([r for k in range(3) for r in track(f"m{k}", 60 if k else 400, k)], CAM)
    rows = rows.withColumn("gps", F.when(F.col("frame") % 7 != 3, F.col("gps")))
    want = sorted(tuple(r) for r in impute.fill_keyframes(rows).select("map_id", "frame", F.round("lat", 9), "lat_filled", "fix").collect())
    inner = skew.GroupSpread.__init__
    monkeypatch.setattr(skew.GroupSpread, "__init__", lambda self, rows, key, by, n=50: inner(self, rows, key, by, 50))
    assert skew.GroupSpread(rows, "map_id", "frame").hot
    assert sorted(tuple(r) for r in impute.fill_keyframes(rows).select("map_id", "frame", F.round("lat", 9), "lat_filled", "fix").collect()) == want


FRAMES = "stream long, frame_id long, ts timestamp_ntz, displacement double, n_features int, latitude double, longitude double, altitude double, arrived timestamp_ntz"


def flight(stream, n, seed=0, first=0):
    import datetime as dt

    rng = np.random.default_rng(seed)
    t0 = dt.datetime(2021, 1, 1)
    out, lat, lon, alt = [], 45.0, 10.0, 300.0
    for k in range(n):
        lat += 2e-5 + rng.normal() * 2e-6
        lon += 1e-5 + rng.normal() * 2e-6
        alt += rng.normal() * 0.3
        t = t0 + dt.timedelta(seconds=k)
        out.append([stream, first + k, t, 60.0 + float(rng.normal()), 300, round(float(lat), 7), round(float(lon), 7), round(float(alt), 3), t])
    return out


def found(spark, rows, **kw):
    return {(r["stream"], r["frame_id"]) for r in spikes.implausible_frames(spark.createDataFrame([tuple(r) for r in rows], FRAMES), **kw).collect()}


def test_spikes_runs_and_impossible_readings(spark):
    rows = flight(1, 400)
    rows[50][5] = 95.0
    rows[60][7] = -32768.0
    rows[70][7] += 40
    for k in (80, 81, 82):
        rows[k][6] += 0.002
    for k in range(101, 120):
        rows[k][5:8] = rows[100][5:8]
    for k in range(201, 220):
        rows[k][7] = rows[200][7]
    for k in range(301, 320):
        rows[k][5:8] = rows[300][5:8]
        rows[k][3] = 1.0
    rows[330][5] = rows[330][6] = rows[330][7] = None
    rows[340][5] = rows[340][6] = float("nan")
    want = {50, 60, 70, 80, 81, 82, *range(101, 120), *range(201, 220)}
    assert found(spark, rows) == {(1, k) for k in want}
    # Repeated and shuffled rows, small chunks: the same.
    assert found(spark, rows[::-1] + rows[:90], chunk=64, margin=40) == {(1, k) for k in want}


def test_frames_are_judged_by_their_own_hour(spark):
    """A stream that is lively in one hour and calm in the next: the same excursion is a case in the calm one only."""
    import datetime as dt

    rows = flight(5, 1200)
    for k in range(1200):
        rows[k][2] = dt.datetime(2021, 1, 1) + dt.timedelta(seconds=6 * k)
        rows[k][7] = 300.0 + (3.0 if k < 600 else 1.5) * float(np.random.default_rng(k).normal())
    f = spikes.fences(spikes.step_sketches(spikes.chunked(spark.createDataFrame([tuple(r) for r in rows], FRAMES), 4096, 128))).first()
    assert f["hours_z"][1] < f["fence_z"] < f["hours_z"][0]
    middle = (f["hours_z"][0] + f["hours_z"][1]) / 2
    for k in (300, 900):
        rows[k - 1][7] = rows[k + 1][7] = 300.0
        rows[k][7] = 300.0 + middle
    assert found(spark, rows) == {(5, 900)}


def test_frozen_run_is_judged_alike_in_short_and_long_streams(spark):
    for n in (400, 8000):
        rows = flight(3, n)
        for k in range(n):
            rows[k][7] = 300.0 + 0.5 * ((k // 2) % 2)
        for k in range(101, 120):
            rows[k][7] = 300.7
        assert found(spark, rows) == {(3, k) for k in range(102, 120)}


def test_frozen_run_across_chunks_is_whole(spark):
    for begin, end in ((44, 84), (40, 250), (64, 128)):
        rows = flight(4, 600)
        for k in range(600):
            rows[k][7] = 300.0 + 0.5 * ((k // 3) % 2)
        for k in range(begin, end):
            rows[k][7] = 300.7
            rows[k][3] = None if k % 7 == 0 else 20.0
        want = {(4, k) for k in range(begin + 1, end)}
        assert found(spark, rows) == want and found(spark, rows, chunk=64, margin=8) == want
        for k in range(begin + 1, end):
            rows[k][3] = 20.0 if (k - begin) % 2 else 7.0  # the middle of the two kinds is 13.5 or 7
        whole = found(spark, rows)
        assert found(spark, rows, chunk=64, margin=8) == whole == found(spark, rows, chunk=16, margin=8)


def test_pause_with_new_place_is_no_case(spark):
    import datetime as dt

    rows = flight(7, 300)
    for k in range(150, 300):
        rows[k][2] += dt.timedelta(minutes=40)
        rows[k][5] += 0.01
    assert found(spark, rows) == set()
    assert found(spark, []) == set()
    rows[5][0] = rows[6][1] = rows[7][3] = None
    assert found(spark, rows) == set()


def brute_pairs(pts, radius):
    out = {}
    for i, (a, la, lo) in enumerate(pts):
        for b, lb, lp in pts[i + 1 :]:
            if a == b:
                continue
            h = math.sin(math.radians(lb - la) / 2) ** 2 + math.cos(math.radians(la)) * math.cos(math.radians(lb)) * math.sin(math.radians(lp - lo) / 2) ** 2
            d = 2 * proximity.EARTH_RADIUS_M * math.asin(min(1, math.sqrt(h)))
            if d <= radius:
                out[tuple(sorted((a, b)))] = d
    return out


@pytest.mark.parametrize("lat", [0.0, 60.0, 89.9995, -89.9999])
def test_close_pairs_anywhere(spark, lat):
    rng = np.random.default_rng(4)
    pts = [(f"p{k}", float(np.clip(lat + rng.normal() * 0.002, -90, 90)), float((180 + rng.normal() * 0.004 / max(0.001, math.cos(math.radians(lat)))) % 360 - 180 + (360 if k % 7 == 0 else 0))) for k in range(120)]
    df = spark.createDataFrame(pts + pts[:5] + [("n", None, 1.0), ("z", 0.0, 0.0), ("q", float("nan"), 1.0), (None, 1.0, 1.0)], "id string, lat double, lon double").where("id IS NOT NULL")
    got = {(r["id_a"], r["id_b"]) for r in proximity.close_pairs(df, 150.0).collect()}
    assert got == set(brute_pairs(pts, 150.0)) and (got or lat == 0.0)


def test_hot_cell_is_complete(spark):
    pts = [(f"p{k:04d}", 45.0, 10.0) for k in range(150)]
    df = spark.createDataFrame(pts, "id string, lat double, lon double")
    assert proximity.close_pairs(df, 150.0).count() == 150 * 149 // 2


def test_classes_say_what_pairs_say(spark):
    pts = [(f"p{k:03d}", 45.0, 10.0 + (360 if k % 2 else 0)) for k in range(40)] + [(f"q{k}", 45.0 + 0.0004 * k, 10.0) for k in range(5)] + [("n", None, 1.0), ("z", 0.0, 0.0)]
    df = spark.createDataFrame(pts, "id string, lat double, lon double")
    of = {r["id"]: r["class_id"] for r in proximity.position_classes(df).collect()}
    classes, pairs = proximity.close_classes(df, 150.0)
    near = {(r["class_a"], r["class_b"]) for r in pairs.collect()}
    assert {r["class_id"]: r["n"] for r in classes.collect()} == {"p000": 41, "q1": 1, "q2": 1, "q3": 1, "q4": 1} and pairs.count() == 9
    want = {(r["id_a"], r["id_b"]) for r in proximity.close_pairs(df, 150.0).collect()}
    assert want == {(a, b) for a in of for b in of if a < b and (of[a] == of[b] or tuple(sorted((of[a], of[b]))) in near)}
    assert all(d.count() == 0 for d in proximity.close_classes(df.limit(0), 150.0))


def test_regions(spark):
    ring = lambda *p: [{"lat": a, "lon": b} for a, b in p]
    zones = spark.createDataFrame(
        [("sea", ring((-10.0, 170.0), (-10.0, -170.0), (10.0, -170.0), (10.0, 170.0), (-10.0, 170.0))), ("u", ring((0.0, 0.0), (0.0, 3.0), (3.0, 3.0), (3.0, 2.0), (1.0, 2.0), (1.0, 1.0), (3.0, 1.0), (3.0, 0.0))), ("none", None), ("line", ring((0.0, 0.0), (1.0, 1.0)))],
        "id string, ring array<struct<lat:double,lon:double>>",
    )
    pts = spark.createDataFrame([("a", 0.0, 180.0), ("b", 0.0, -540.0), ("c", 2.0, 1.5), ("d", 0.5, 1.5), ("e", 5.0, -175.0), ("f", None, 1.0), ("g", 11.0, 175.0)], "id string, lat double, lon double")
    got = {tuple(r) for r in proximity.regions_of_points(pts, zones).collect()}
    assert got == {("a", "sea"), ("b", "sea"), ("d", "u"), ("e", "sea")}
    assert proximity.regions_of_points(pts, zones.limit(0)).count() == 0
    assert proximity.regions_of_points(pts.limit(0), zones).count() == 0


@pytest.mark.parametrize("name", ["p1_found", "p5_found"])
def test_against_sql(spark, data, name):
    import os

    c = duckdb.connect()
    for f in os.listdir(data):
        c.execute(f"create view {f[:-8]} as select * from '{data}/{f}'")
    want = c.execute(problems.ORACLE[name]).df()
    got = problems.QUERIES[name](spark, data).toPandas()[want.columns.tolist()]
    assert sorted(map(tuple, got.astype(str).values)) == sorted(map(tuple, want.astype(str).values)) and len(want)
