"""Scenes, arrays and site files; the frame source, the listener and the worker; sky masks, texts and settings."""

import json
import os
import socket
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrafold.database import Database
from terrafold.functions import config, viewer
from terrafold.operators import scenes, sky
from terrafold.session import list_folder
from terrafold.sources import formats, frames, glb, site_files
from terrafold.streaming import keyframes as kf
from terrafold.streaming.worker import Worker

POINTS = "map_id string, frame int, row int, col int, ord long, x double, y double, z double, conf double, r int, g int, b int"


def test_glb_round_trip_and_layout():
    rng = np.random.default_rng(0)
    p, c = rng.normal(size=(7, 3)), rng.integers(0, 255, (7, 3))
    data = glb.pack([{"name": "a", "positions": p, "colors": c}, {"name": "none", "positions": np.zeros((0, 3))}, {"name": "mesh", "positions": p, "faces": [[0, 1, 2], [2, 3, 6]]}])
    assert struct.unpack("<III", data[:12]) == (0x46546C67, 2, len(data)) and len(data) % 4 == 0
    n = struct.unpack("<I", data[12:16])[0]
    head = json.loads(data[20 : 20 + n])
    assert head["accessors"][0]["min"] == pytest.approx(p.astype("f4").min(0).tolist()) and head["meshes"][1]["primitives"][0]["mode"] == 4
    a, m = glb.unpack(data)
    assert np.allclose(a["positions"], p, atol=1e-6) and (a["colors"][:, :3] == c).all() and (a["colors"][:, 3] == 255).all() and (m["faces"] == [[0, 1, 2], [2, 3, 6]]).all()
    assert glb.unpack(glb.pack([])) == []
    with pytest.raises(ValueError, match="glTF"):
        glb.unpack(b"\0" * 20)


def test_point_scenes_come_in_parts(spark):
    rows = [("m", k, float(k), 0.0, 0.0, k, 0, 255) for k in range(10)] + [("n", 0, 1.0, 1.0, 1.0, 1, 2, 3), ("n", 1, None, 1.0, 1.0, 1, 2, 3), (None, 1, 1.0, 1.0, 1.0, 1, 2, 3)]
    df = spark.createDataFrame(rows, "g string, ord long, x double, y double, z double, red int, green int, blue int")
    s = glb.point_scenes(df, "g", 4)
    assert {(r["g"], r["part"]) for r in s.collect()} == {("m", 0), ("m", 1), ("m", 2), ("n", 2)}
    back = glb.read_point_scenes(s, "g").where("g = 'm'").orderBy("x").collect()
    assert [(r["x"], r["red"], r["blue"]) for r in back] == [(float(k), k, 255) for k in range(10)]
    assert glb.point_scenes(df.limit(0), "g").count() == 0


def test_predictions_round_trip(spark, tmp_path):
    rng = np.random.default_rng(1)
    rows = [(m, f, i, j, (f * 2 + i) * 3 + j, *map(float, rng.normal(size=3).astype(np.float32)), float(np.float32(rng.random())), *map(int, rng.integers(0, 256, 3))) for m in ("a", "b") for f in range(2) for i in range(2) for j in range(3)]
    eye, k = [[1.0, 0.0, 0.0], [0.0, 1.0, 0.0], [0.0, 0.0, 1.0]], [[9.0, 0.0, 1.0], [0.0, 9.0, 1.0], [0.0, 0.0, 1.0]]
    cams = spark.createDataFrame([("a", f, eye, [1.0, 2.0, float(f)], k) for f in range(2)], "map_id string, frame int, r array<array<double>>, t array<double>, k array<array<double>>")
    files = formats.prediction_npz(spark.createDataFrame(rows, POINTS), cams).select(F.concat("map_id", F.lit(".npz")).alias("name"), "npz")
    formats.write_files(files, "name", "npz", str(tmp_path))
    got = formats.read_predictions(spark, str(tmp_path)).collect()
    want = {(r[0], r[4]): r for r in rows}
    assert len(got) == len(rows)
    for r in got:
        w = want[(os.path.basename(r["path"])[0], r["ord"])]
        assert (r["frame"], r["row"], r["col"], r["x"], r["y"], r["z"], r["conf"], r["r"], r["g"], r["b"]) == (*w[1:4], *w[5:])
    c = formats.read_cameras(spark, str(tmp_path)).orderBy("frame").collect()
    assert [(r["px"], r["py"], r["pz"], r["k"][0][0]) for r in c] == [(-1.0, -2.0, 0.0, 9.0), (-1.0, -2.0, -1.0, 9.0)]


def test_images_and_names(spark):
    pts = spark.createDataFrame([("m", 0, 0, 1, 1, 0.0, 0.0, 0.0, 1.0, 10, 20, 300)], POINTS)
    r = formats.model_inputs(pts).first()
    data = bytes(r["image"])
    raw = zlib.decompress(data[data.index(b"IDAT") + 4 : data.index(b"IEND") - 8])
    assert r["name"] == "frame_000000.png" and raw == bytes([0, 0, 0, 0, 10, 20, 255])
    n = spark.sql("select 7L as id, timestamp_ntz '2024-01-02 03:04:05.000678' as ts").select(formats.keyframe_name(F.col("id"), F.col("ts"))).first()[0]
    assert n == "keyframe_000007_20240102_030405_000678.jpg"


def test_site_files_round_trip(spark, tmp_path):
    rows = [(k, k / 4, -k / 2, k * 1.0, k, 2 * k, 250, k + 0.5, k % 2 if k else None) for k in range(9)]
    site = spark.createDataFrame(rows, site_files.SITE)
    maps = spark.createDataFrame([(1, "b"), (0, "a")], "source long, map_id string")
    seg = spark.createDataFrame([("tree", 1, 0, 1.0, 2.0, 3.0, 9, 8, 7), ("roof", 0, 0, 4.0, 5.0, 6.0, 1, 2, 3), ("roof", 0, 1, 4.5, 5.0, 6.0, 1, 2, 3)], site_files.SEGMENTS)
    folder = str(tmp_path / "site")
    assert site_files.import_site(spark, folder) is None
    assert site_files.export_site(site, maps, seg, (45.0, 10.0, None), folder, part_rows=4)
    assert {"site.glb", "site_0001.glb", "site_0002.glb", "merged_res.glb", "site_confidence.glb", "seg_site.glb", "site.geojson", "site_points_0002.npz"} <= set(list_folder(spark, folder))
    back, ids, origin = site_files.import_site(spark, folder)
    assert origin == (45.0, 10.0, 0.0) and [tuple(r) for r in ids.orderBy("source").collect()] == [(0, "a"), (1, "b")]
    assert [tuple(r)[1:] for r in back.orderBy("ord").collect()] == [r[1:] for r in rows]
    got = site_files.import_segments(spark, folder).orderBy("pos", "ord").collect()
    assert [(r["query"], r["ord"], r["x"], r["red"]) for r in got] == [("roof", 0, 4.0, 1), ("roof", 1, 4.5, 1), ("tree", 0, 1.0, 9)]
    assert not site_files.export_site(site.limit(0), maps, seg, (0.0, 0.0, 0.0), folder) and not os.path.exists(folder)
    assert site_files.import_segments(spark, folder).count() == 0
    two = tmp_path / "two"
    two.mkdir()
    np.savez(two / "site_segments.npz", queries=np.array(["p", "q", "none"]), colors=np.zeros((3, 3), np.uint8), counts=np.array([1, 2, 0]), points=np.arange(9.0).reshape(3, 3))
    assert [(r["query"], r["ord"], r["x"]) for r in site_files.import_segments(spark, str(two)).orderBy("pos", "ord").collect()] == [("p", 0, 0.0), ("q", 0, 3.0), ("q", 1, 6.0)]


def test_listener_source_and_mailbox(spark, tmp_path):
    spool = str(tmp_path / "spool")
    ear = frames.Listener(spool, decide=lambda client, n: frames.KEYFRAME if n % 2 else frames.SKIPPED)
    frames.register(spark)
    src = spark.readStream.format("terrafold_frames").load(spool)

    def drained(name):
        src.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start().awaitTermination()
        return spark.read.parquet(str(tmp_path / "out")).orderBy("frame_id").collect()

    def exchange(c, image, gps):
        c.sendall(formats.pack_frame(image, gps))
        data = b""
        while len(data) < 28 or len(data) < 28 + struct.unpack_from(">I", data, 24)[0]:
            data += c.recv(4096)
        return formats.unpack_reply(data)

    with socket.create_connection(("127.0.0.1", ear.port), 10) as c:
        ear.mailbox.put(b"lost")
        ear.mailbox.put(b"<kml/>")
        assert exchange(c, b"one", (1.0, 2.0, None)) == (1.0, 1.0, 1.0, b"<kml/>")
        assert exchange(c, b"", None) == (0.0, 1.0, 2.0, b"")
        got = drained("first")
        assert [(r["frame_id"], bytes(r["image"]), r["lat"], r["alt"]) for r in got] == [(1, b"one", 1.0, None), (2, b"", None, None)]
        assert exchange(c, b"three", (float("nan"), 2.0, 3.0))[1:3] == (2.0, 3.0)
        c.sendall(b"\x00\x00\x00\x09half")  # the connection ends within a frame
    got = drained("second")
    assert [r["frame_id"] for r in got] == [1, 2, 3] and got[2]["lat"] is None and ear.connections == 1
    ear.close()


def test_worker_processes_skips_and_hands_on(spark, tmp_path):
    rng = np.random.default_rng(3)

    def process(batch, map_id):
        first = batch.agg(F.min("seq")).first()[0]
        if first == 4:
            raise RuntimeError("model failed")
        flat = first == 8  # even confidence: no plan, so no map
        pts = [(k, *map(float, rng.uniform(0, 4, 3)), 1, 2, 3, 5.0 if flat else float(k)) for k in range(1200)]
        geo = [(1.0, [[1.0, 0.0, 0.0], [0.0, 1.0, 0.0], [0.0, 0.0, 1.0]], [0.0, 0.0, 0.0], 45.0, 10.0, 100.0)]
        return {"points": spark.createDataFrame(pts, "ord long, x double, y double, z double, r int, g int, b int, conf double"), "georefs": spark.createDataFrame(geo, "s double, r array<array<double>>, t array<double>, lat0 double, lon0 double, alt0 double")}

    db = Database(spark, str(tmp_path / "db"), voxel_size=1.0)
    worker = Worker(db, process)
    rows = [(1, k, 100.0 * k, 100, None) for k in range(14)]
    spark.createDataFrame(rows, "stream long, seq long, value double, n_features int, control string").coalesce(1).write.parquet(str(tmp_path / "in"))
    src = spark.readStream.schema("stream long, seq long, value double, n_features int, control string").parquet(str(tmp_path / "in"))
    kf.start(kf.stream_keyframes(src, batch_size=4), worker.handle, str(tmp_path / "ck")).awaitTermination(240)
    assert worker.done == ["map_1_000000"] and set(worker.errors) == {"map_1_000001", "map_1_000002"} and "model failed" in worker.errors["map_1_000001"] and "even" in worker.errors["map_1_000002"]
    assert db.site().count() > 0 and [r["map_id"] for r in db.site_maps().collect()] in ([], ["map_1_000000"])
    assert b"nfn_flight_area" in (kml := worker.mailbox.take()) or b"<name>v0</name>" in kml
    assert worker.mailbox.take() == b""


def test_sky_masks_are_made_once(spark, tmp_path):
    img = np.zeros((4, 6, 3), np.uint8)
    img[:2] = 255
    calls = tmp_path / "calls"

    def make():
        def model(x):
            with open(calls, "a") as f:
                f.write("x")
            assert x.shape == (1, 3, 320, 320)
            return x[:, :1]

        return model

    images = spark.createDataFrame([("m", 0, 4, 6, bytearray(img.tobytes())), ("m", 1, 4, 6, bytearray(b"short")), ("m", 2, 4, 6, None)], "map_id string, frame int, h int, w int, pixels binary").coalesce(1)
    for _ in range(2):
        got = sky.masks(images, make, str(tmp_path / "masks")).collect()
        assert len(got) == 1 and (np.frombuffer(bytes(got[0]["mask"]), np.uint8).reshape(4, 6) == np.repeat([[0], [0], [255], [255]], 6, 1)).all()
    assert calls.read_text() == "x"
    cells = sky.mask_pixels(sky.masks(images, make, str(tmp_path / "masks"))).collect()
    assert {(r["row"], r["col"]) for r in cells if r["mask"] == 1.0} == {(i, j) for i in (2, 3) for j in range(6)}
    assert (sky.mask_of(np.ones((5, 5)), 2, 2) == 255).all() and np.allclose(sky.resize(np.arange(4.0).reshape(2, 2), 2, 2), [[0, 1], [2, 3]])


def test_scenes(spark):
    rng = np.random.default_rng(2)
    rows = [("m", 0, i, j, i * 5 + j, float(j), float(i), float(rng.random()), float(i * 5 + j + 1), 1, 2, 3) for i in range(5) for j in range(5)]
    pts = spark.createDataFrame(rows, POINTS)
    eye = [[1.0, 0.0, 0.0], [0.0, 1.0, 0.0], [0.0, 0.0, 1.0]]
    cams = spark.createDataFrame([("m", 0, eye, [0.0, 0.0, 0.0]), ("m", 1, eye, [0.0, 0.0, 1.0])], "map_id string, frame int, r array<array<double>>, t array<double>")
    shown, pyramids = scenes.preview(pts, cams)
    kept = sum(v >= np.percentile(np.arange(1, 26), 10) for v in range(1, 26))
    assert shown.count() == kept and pyramids.count() == 10
    first = shown.where("ord = 24").first()
    assert (first["x"], first["y"]) == (-4.0, -4.0)
    few = scenes.confidence(pts, cams, cap=6)
    assert few.count() == 6 and scenes.confidence(pts, cams).where("ord = 24 AND green = 255 AND red = 0").count() == 1
    geo = spark.createDataFrame([("m", 2.0, eye, [1.0, 0.0, 0.0])], "map_id string, s double, r array<array<double>>, t array<double>")
    s = scenes.surface(pts, geo)
    assert s.count() == 32 and scenes.surface(pts, geo, stride=2).count() == 8
    x = s.where("row = 0 AND col = 0 AND half = 0").first()
    assert (x["x0"], x["z0"], x["x1"], x["z2"]) == (-1.0, 0.0, -3.0, 2.0)
    assert scenes.surface(pts, geo.limit(0)).count() == 0


def test_texts_and_settings(spark):
    one = spark.range(1)
    t = one.select(viewer.escape_html(F.lit("<a & \"b\" 'c'>"))).first()[0]
    assert t == "&lt;a &amp; &quot;b&quot; &#x27;c&#x27;&gt;"
    null = F.lit(None).cast("long")
    assert one.select(viewer.site_status(F.lit(2), F.lit(12345), F.lit(3.14159), F.lit("o"))).first()[0] == "**Site:** 2 map(s) · 12,345 points · mean confidence 3.1  \nOrigin o"
    assert one.select(viewer.site_status(F.lit(0), F.lit(0), F.lit(None).cast("double"), F.lit("o"))).first()[0].startswith("**No site yet.**")
    assert one.select(viewer.map_status(F.lit(5), null, F.lit(1.0), F.lit("o"))).first()[0] == "**Map:** 5 keyframe(s) · not reconstructed yet"
    assert one.select(viewer.map_status(F.lit(5), F.lit(1000), F.lit(None).cast("double"), F.lit(None).cast("string"))).first()[0] == "**Map:** 5 keyframe(s) · 1,000 points  \nNot GPS-aligned"
    assert one.select(viewer.batch_status(F.lit(3), F.lit(25), F.lit(True))).first()[0] == "**Collecting:** 3 / 25 keyframes  ·  **mapping in progress**"
    s = config.Settings.read({"TERRAFOLD_PORT": "9", "TERRAFOLD_BATCH_SIZE": "", "TERRAFOLD_MIN_DISPARITY": "12.5"}, port=None, output_dir="x")
    assert (s.port, s.batch_size, s.min_disparity, s.output_dir, config.Settings.read({"TERRAFOLD_PORT": "9"}, port=7).port) == (9, 25, 12.5, "x", 7)
    with pytest.raises(TypeError, match="nope"):
        config.Settings.read({}, nope=1)
