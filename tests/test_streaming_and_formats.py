"""Keyframes over tables and streams, formats, the database, the registries."""

import json
import struct

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from terrafold.database import Database
from terrafold.functions import registry
from terrafold.operators import voxel
from terrafold.sources import formats
from terrafold.streaming import keyframes as kf
from terrafold.streaming import stats

ROWS = "stream long, seq long, value double, n_features int, control string"


def run(spark, rows, **kw):
    return kf.select_keyframes(spark.createDataFrame(rows, ROWS), **kw).orderBy("stream", "seq").collect()


def test_threshold_is_strict_and_few_features_lose_the_anchor(spark):
    rows = [(1, 0, 0.0, 100), (1, 1, 40.0, 100), (1, 2, 40.1, 100), (1, 3, 50.0, 5), (1, 4, None, 100), (1, 5, 51.0, 100), (1, 6, None, 100), (1, 7, 91.0, None), (1, 8, 91.5, 10)]
    got = run(spark, [(*r, None) for r in rows])
    assert [r["kept"] for r in got] == [True, False, True, False, False, True, False, False, True]
    # A stream that never shows enough features never anchors.
    assert not any(r["kept"] for r in run(spark, [(1, k, 100.0 * k, 9, None) for k in range(4)]))
    # Moving far enough with too few features: rejected, and the next frame that can anchors, however little it moved.
    assert [r["kept"] for r in run(spark, [(1, 0, 0.0, 50, None), (1, 1, 90.0, 3, None), (1, 2, 1.0, 50, None), (1, 3, 2.0, 50, None)])] == [True, False, True, False]
    assert all(r["kept"] for r in run(spark, [(1, k, 0.0, 100, None) for k in range(5)], threshold=0))


def test_frames_become_exact_steps(spark):
    frames = "stream long, frame_id long, displacement double, n_features int, extra int"
    rows = [(1, 2, 20.0, 50, 0), (1, 0, 12.3, 50, 0), (1, 1, None, 50, 0), (1, 2, 20.0, 50, 1), (1, 3, float("nan"), 50, 0), (1, 4, 0.1, None, 0), (None, 1, 1.0, 1, 0), (1, None, 1.0, 1, 0)]
    got = kf.frame_steps(spark.createDataFrame(rows, frames)).orderBy("seq").collect()
    assert [(r["seq"], r["value"]) for r in got] == [(0, 12300.0), (1, None), (2, 32300.0), (3, None), (4, 32400.0)]
    # Exactly 40 px since the anchor is not more than 40.
    rows = [(1, k, v, 50, 0) for k, v in enumerate((5.0, 13.4, 13.3, 13.3, 0.001))]
    assert [r["kept"] for r in kf.select_keyframes(kf.frame_steps(spark.createDataFrame(rows, frames)), 40_000.0).orderBy("seq").collect()] == [True, False, False, False, True]


def test_status_counts_the_open_batch(spark):
    rows = [(1, k, 100.0 * k, 100, None) for k in range(7)] + [(2, 0, 0.0, 100, None), (2, 1, None, None, "clear"), (3, 0, None, 100, None)]
    got = {r["stream"]: r for r in kf.batch_status(kf.select_keyframes(spark.createDataFrame(rows, ROWS), batch_size=3), 3).collect()}
    assert (got[1]["received"], got[1]["kept"], got[1]["closed"], got[1]["collected"], got[1]["latest"]) == (7, 7, 2, 1, 1)
    assert (got[2]["received"], got[2]["kept"], got[2]["collected"], got[2]["latest"]) == (1, 1, 0, None) and got[3]["kept"] == 0
    moved = kf.batch_index(spark.createDataFrame([(1, 0, 0, True), (1, 0, 1, False), (1, 0, 2, True)], "stream long, batch long, position int, ok boolean"), "ok").orderBy("place").collect()
    assert [(r["name"], r["place"]) for r in moved] == [("frame_000000.jpg", 0), ("frame_000002.jpg", 1)]


def test_bounded_history_is_that_of_adding_one_by_one(spark):
    held = []
    for n in range(2600):
        held.append(n)
        if len(held) > stats.HISTORY:
            held = held[-stats.KEEP :]
        if n + 1 in (1, 999, 1000, 1001, 1500, 1501, 1502, 2600):
            rows = spark.range(n + 1).select(F.lit(1).alias("g"), F.col("id").alias("o"))
            assert sorted(r["o"] for r in stats.bounded_history(rows, "g", "o").collect()) == held


def test_batches_flush_clear_and_toggle(spark):
    rows = [(1, k, 100.0 * k, 100, None) for k in range(26)] + [(1, 26, None, None, "flush"), (1, 27, None, None, "flush")]
    got = run(spark, rows)
    assert [r["batch"] for r in got if r["flushed"]] == [0, 1] and got[24]["flushed"] and got[25]["position"] == 0
    rows = [(1, 0, 0.0, 100, None), (1, 1, None, None, "clear"), (1, 2, None, None, "off"), (1, 3, 0.0, 100, None), (1, 4, None, None, "on"), (1, 5, 0.0, 100, None), (1, 6, 1.0, 100, None)]
    got = run(spark, rows, batch_size=2)
    assert [r["kept"] for r in got] == [True, False, False, True, False, True, False] and got[5]["flushed"]
    assert run(spark, []) == []


def test_stream_equals_batch(spark, tmp_path):
    rng = np.random.default_rng(0)
    rows = [(int(s), k, float(rng.uniform(0, 200)) if rng.random() > 0.05 else None, int(rng.integers(5, 200)), None) for s in (1, 2, 3) for k in range(120)]
    for part in range(3):
        spark.createDataFrame(rows, ROWS).where(f"seq >= {part * 40} AND seq < {part * 40 + 40}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    src = spark.readStream.schema(ROWS).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = []
    q = kf.start(kf.stream_keyframes(src, batch_size=7), lambda df, i: out.extend(df.collect()), str(tmp_path / "ck"))
    q.awaitTermination(120)
    want = {tuple(r) for r in run(spark, rows, batch_size=7)}
    assert {tuple(r) for r in out} == want


def test_drained_stream_is_whole_however_long_it_takes(spark, tmp_path, monkeypatch):
    from pyspark.sql.streaming import StreamingQuery

    from terrafold.plans import reference

    wait = StreamingQuery.awaitTermination
    # As if the stream were not finished when a limit is over.
    monkeypatch.setattr(StreamingQuery, "awaitTermination", lambda self, timeout=None: False if timeout is not None else wait(self))
    (tmp_path / "some").mkdir()
    (tmp_path / "none").mkdir()
    e = spark.range(400).selectExpr("id AS event_id", "id % 4 AS user_id", "timestamp_ntz '2024-01-01' + make_interval(0, 0, 0, 0, 0, 0, id) AS ts", "50.0D * id AS value")
    e.write.parquet(str(tmp_path / "some" / "events.parquet"))
    e.limit(0).write.parquet(str(tmp_path / "none" / "events.parquet"))
    assert reference.keyframes_stream(spark, str(tmp_path / "some")).count() == 400
    assert reference.keyframes_stream(spark, str(tmp_path / "none")).count() == 0


def test_gps_csv(spark, tmp_path):
    p = tmp_path / "g.csv"
    p.write_text("latitude,longitude,altitude\n1.5,2.5,3.5\n,2.5,3.5\n1.0,2.0,\n")
    got = [tuple(r) for r in formats.read_gps_csv(spark, str(p)).orderBy("pos").collect()]
    assert got == [(0, 1.5, 2.5, 3.5), (1, None, None, None), (2, 1.0, 2.0, None)]
    assert formats.read_gps_csv(spark, str(p), expected=4).where("latitude IS NOT NULL").count() == 0
    (tmp_path / "c.csv").write_text("Height,LONGITUDE,Latitude\n9,8,x\n9,8,7\n")
    assert [tuple(r) for r in formats.read_client_csv(spark, str(tmp_path / "c.csv")).collect()] == [(None, 8.0, 9.0), (7.0, 8.0, 9.0)]


def test_wire(spark, tmp_path):
    data = formats.pack_frame(b"abc", (1.0, 2.0, None)) + formats.pack_frame(b"", None) + formats.pack_frame(b"zz", (3.0, 4.0, 5.0))
    (tmp_path / "w.bin").write_bytes(data + b"\x00\x00\x00\x09xx")
    got = formats.read_wire(spark, str(tmp_path / "w.bin")).orderBy("frame_id").collect()
    assert [(r["frame_id"], r["n_bytes"], r["lat"]) for r in got] == [(1, 3, 1.0), (2, 0, None), (3, 2, 3.0)] and got[0]["alt"] is None
    assert struct.unpack(">I", data[:4])[0] == 3 and formats.unpack_reply(formats.pack_reply(1, 2, 3, b"kml")) == (1.0, 2.0, 3.0, b"kml")


def test_plan_kml(spark):
    w = spark.createDataFrame([("p", k, lat, lon, 10.0) for k, (lat, lon) in enumerate([(0.0, 0.0), (1.0, 1.0), (0.0, 1.0), (1.0, 0.0)])] + [("two", 0, 1.0, 1.0, None), ("two", 1, 2.0, 2.0, 3.0)], "g string, k int, lat double, lon double, alt double")
    kml = formats.plan_kml(w, "g", "k")
    texts = {r["g"]: r["kml"] for r in kml.collect()}
    assert texts["p"].count("<altitudeMode>absolute</altitudeMode>") == 5 and "<name>nfn_flight_area</name>" in texts["p"] and "<name>v3</name>" in texts["p"]
    assert "Polygon" in texts["p"] and "Polygon" not in texts["two"] and "1.000000000,1.000000000,0.000" in texts["two"]
    assert formats.parse_plan_kml(kml, "g").where("g = 'p'").count() == 4
    ring = [(r["lat"], r["lon"]) for r in formats.ring_order(w.where("g = 'p'"), "g", "k").orderBy("pos").collect()]
    assert ring == [(0.0, 0.0), (0.0, 1.0), (1.0, 1.0), (1.0, 0.0), (0.0, 0.0)]


def test_predictions_and_images(spark, tmp_path):
    np.savez(tmp_path / "a.npz", world_points=np.arange(24, dtype=np.float32).reshape(2, 2, 2, 3), world_points_conf=np.ones((2, 2, 2), np.float32), images=np.full((2, 3, 2, 2), 0.9999, np.float32))
    got = formats.read_predictions(spark, str(tmp_path / "a.npz")).orderBy("ord").collect()
    assert len(got) == 8 and got[5]["frame"] == 1 and (got[5]["row"], got[5]["col"], got[5]["x"], got[5]["r"]) == (0, 1, 15.0, 254)
    (tmp_path / "b.JPG").write_bytes(b"1")
    (tmp_path / "a.png").write_bytes(b"1")
    assert [r["path"][-5:] for r in formats.list_images(spark, str(tmp_path)).collect()] == ["a.png", "b.JPG"]


def test_database(spark, tmp_path):
    db = Database(spark, str(tmp_path / "db"), voxel_size=1.0, percentile=0)
    ids = [db.create_map() for _ in range(3)]
    assert [r["map_id"] for r in db.maps().collect()] == sorted(ids, reverse=True)
    g = spark.createDataFrame([(m, 1.0, [[1.0, 0.0, 0.0], [0.0, 1.0, 0.0], [0.0, 0.0, 1.0]], [0.0, 0.0, 0.0], 45.0, 10.0, 100.0 if m != ids[2] else None) for m in ids], "map_id string, s double, r array<array<double>>, t array<double>, lat0 double, lon0 double, alt0 double")
    for k, m in enumerate(ids):
        pts = spark.createDataFrame([(o, 0.4 + 3 * k + o * 0.01, 0.4, 0.4, 1, 2, 3, 5.0 + k) for o in range(5)], "ord long, x double, y double, z double, r int, g int, b int, conf double")
        db.write_map(m, points=pts)
    assert db.grow_site(ids[0], g) and db.grow_site(ids[1], g) and not db.grow_site(ids[1], g, planned=False) and not db.grow_site(ids[2], g.limit(0))
    assert db.site().count() == 2 and sorted(tuple(r) for r in db.site_maps().collect()) == [(0, ids[0]), (1, ids[1])]
    db.put_segment("tree", spark.createDataFrame([(0, 1.0, 1.0, 1.0)], "ord long, x double, y double, z double"))
    assert db.stats() == {"maps": 3, "site_points": 2, "site_maps": 2, "segments": 1}
    db.del_map(ids[0])
    assert [tuple(r) for r in db.site_maps().collect()] == [(0, ids[1])] and db.site().select("source").distinct().collect() == [(0,)]
    assert db.stats()["segments"] == 0 and db.maps().count() == 2
    with pytest.raises(KeyError):
        db.get_map(ids[0])
    db.del_site()
    assert db.site().count() == 0


def test_site_grows_by_the_tiles_that_a_map_touches(spark, tmp_path):
    """Tiles a voxel wide and whole sites give the same fold; tiles that a map does not touch keep their files."""
    rng = np.random.default_rng(4)
    eye = [[1.0, 0.0, 0.0], [0.0, 1.0, 0.0], [0.0, 0.0, 1.0]]
    sites = {}
    for tile in (2, 10**6):
        db = Database(spark, str(tmp_path / f"db{tile}"), voxel_size=1.0, percentile=0, tile=tile)
        rng = np.random.default_rng(4)
        for k, at in enumerate((0.0, 1.3, 40.0)):
            m = db.create_map(map_id=f"m{k}")
            pts = [(o, *map(float, at + rng.uniform(0.05, 3.95, 3)), 1, 2, 3, float(rng.uniform(1, 5))) for o in range(60)]
            db.write_map(m, points=spark.createDataFrame(pts, "ord long, x double, y double, z double, r int, g int, b int, conf double"))
            before = db._tiles()
            assert db.grow_site(m, spark.createDataFrame([(f"m{j}", 1.0, eye, [0.0, 0.0, 0.0], 45.0, 10.0, 100.0) for j in range(3)], "map_id string, s double, r array<array<double>>, t array<double>, lat0 double, lon0 double, alt0 double"))
            if tile == 2 and k == 2:
                assert before and all(db._tiles()[t] == f for t, f in before.items())
        sites[tile] = {(r["ord"], round(r["x"], 9), round(r["y"], 9), round(r["conf"], 9), r["source"]) for r in db.site().collect()}
        if tile == 2:
            db.drop_from_site("m1")
            assert db.site().where("source > 1").count() == 0 and sorted(r["map_id"] for r in db.site_maps().collect()) == ["m0", "m2"]
    assert sites[2] == sites[10**6]


def test_registry(spark):
    r = registry.Registry("thing")

    @r.register("a")
    def one():
        return 1

    assert r.get("a")() == 1 and r.names() == ["a"] and r.is_registered("a")
    with pytest.raises(ValueError, match="already"):
        r.register("a")(one)
    with pytest.raises(KeyError):
        r.get("b")
    assert "error" in registry.timed(lambda: 1 / 0) and registry.timed(lambda: 2)["value"] == 2
    if not registry.reconstructors.is_registered("flat"):

        @registry.reconstructors.register("flat")
        def flat(g):
            if g.map_id.iloc[0] == "bad":
                raise RuntimeError("no model")
            return pd.DataFrame({"map_id": g.map_id, "frame": g.frame, "row": 0, "col": 0, "ord": 0, "x": 0.0, "y": 0.0, "z": 0.0, "conf": 1.0, "r": 0, "g": 0, "b": 0})

        @registry.segmenters.register("dot")
        def make():
            return lambda frame, query: [(1, 2)]

    f = spark.createDataFrame([("m", 0), ("bad", 0)], "map_id string, frame int")
    assert [r["map_id"] for r in registry.reconstruct(f, "flat").collect()] == ["m"]
    assert registry.segment(f, " q ", "dot").where("hit AND query = 'q'").count() == 2


def test_geojson(spark):
    m = spark.createDataFrame([("m", 45.0, 10.0, None, 2.0, 1.0, None)], "map_id string, lat0 double, lon0 double, alt0 double, s double, mean_confidence double, median_confidence double")
    j = json.loads(formats.map_geojson(m).first()["geojson"])
    f = j["features"][0]
    assert j["type"] == "FeatureCollection" and f["geometry"] == {"type": "Point", "coordinates": [10.0, 45.0, 0.0]}
    assert f["properties"] == {"layer": "scene_origin", "model": "scene_geo.glb", "description": "model local (0,0,0); the first keyframe's GPS fix", "altitude_mode": "absolute", "scale": 2.0, "mean_confidence": 1.0, "median_confidence": None}
    s = spark.createDataFrame([(0, 0.0, 0.0, 0.0, 1, 1, 1, 4.0, 0), (1, 0.0, 0.0, 0.0, 1, 1, 1, 5.0, 0)], voxel_schema())
    p = json.loads(formats.site_geojson(s, spark.createDataFrame([(1, "b"), (0, "a")], "source long, map_id string"), (1.0, 2.0, None)).first()["geojson"])["features"][0]
    assert p["geometry"]["coordinates"] == [2.0, 1.0, 0.0] and p["properties"]["map_ids"] == ["a", "b"]
    assert (p["properties"]["num_points"], p["properties"]["num_maps"], p["properties"]["median_confidence"], p["properties"]["model"]) == (2, 2, 4.5, "site.glb")


def voxel_schema():
    kinds = {"ord": "long", "r": "int", "g": "int", "b": "int", "source": "long"}
    return ", ".join(f"{c} {kinds.get(c, 'double')}" for c in voxel.SITE)
