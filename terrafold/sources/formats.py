"""Formats of the mapping world: GPS CSV, transform JSON, KML plans, GeoJSON, prediction NPZ, the wire protocol."""

from __future__ import annotations

import io
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terrafold.operators.quantiles import percentiles

GPS = "latitude double, longitude double, altitude double"
TRANSFORM = "scale double, rotation array<array<double>>, translation array<double>, origin struct<latitude: double, longitude: double, altitude: double>"
# The wire's layouts. A frame is a big-endian length, the image, then three big-endian doubles; a reply is three native doubles, a big-endian length and the payload.
FRAME_HEAD, FRAME_GPS, REPLY_HEAD, REPLY_LENGTH = ">I", ">3d", "=3d", ">I"


def read_gps_csv(spark: SparkSession, path: str, expected: int | None = None) -> DataFrame:
    """pos, latitude, longitude, altitude in file order. Blank latitude or longitude makes the row's position null; a row count other than `expected` makes all null.

    A position file is one line a keyframe; its lines are numbered by their order in the file.
    """
    from terrafold.operators.points import numbered

    raw = spark.read.option("header", True).schema(GPS).csv(path).withColumn("_f", F.input_file_name()).withColumn("_i", F.monotonically_increasing_id())
    g = numbered(raw, ["_f", "_i"], "pos").drop("_f", "_i")
    there = F.col("latitude").isNotNull() & F.col("longitude").isNotNull()
    if expected is not None and g.count() != expected:
        there = F.lit(False)
    return g.select("pos", *[F.when(there, F.col(c)).alias(c) for c in ("latitude", "longitude", "altitude")])


def read_client_csv(spark: SparkSession, path: str) -> DataFrame:
    """A client's positions: header in any case, altitude or height."""
    d = spark.read.option("header", True).csv(path)
    low = {c.strip().lower(): c for c in d.columns}
    pick = lambda *names: F.coalesce(*[F.expr(f"try_cast(`{low[n]}` as double)") for n in names if n in low], F.lit(None).cast("double"))
    return d.select(pick("latitude").alias("latitude"), pick("longitude").alias("longitude"), pick("altitude", "height").alias("altitude"))


def write_gps_csv(df: DataFrame, path: str, single: bool = False) -> None:
    """Header and blanks for null, ordered by pos: as files whose names follow the order, or as one, which is what a map's own positions need."""
    parts = df.coalesce(1) if single else df.repartitionByRange("pos")
    parts.sortWithinPartitions("pos").select("latitude", "longitude", "altitude").write.mode("overwrite").option("header", True).option("emptyValue", "").csv(path)


def read_transform(spark: SparkSession, path: str) -> DataFrame:
    """Georeferences from JSON files."""
    t = spark.read.schema(TRANSFORM).option("multiLine", True).json(path)
    return t.select(F.col("scale").alias("s"), F.col("rotation").alias("r"), F.col("translation").alias("t"), F.col("origin.latitude").alias("lat0"), F.col("origin.longitude").alias("lon0"), F.col("origin.altitude").alias("alt0"))


def transform_json(georefs: DataFrame) -> DataFrame:
    """map_id and the georeference as JSON; a missing altitude of the origin is 0."""
    origin = F.struct(F.col("lat0").alias("latitude"), F.col("lon0").alias("longitude"), F.coalesce("alt0", F.lit(0.0)).alias("altitude"))
    return georefs.select("map_id", F.to_json(F.struct(F.col("s").alias("scale"), F.col("r").alias("rotation"), F.col("t").alias("translation"), origin.alias("origin"))).alias("json"))


def parse_transform(texts: DataFrame) -> DataFrame:
    """Georeferences of such texts (map_id, json): map_id, s, r, t, lat0, lon0, alt0."""
    j = texts.select("map_id", F.from_json("json", TRANSFORM).alias("j"))
    return j.select("map_id", F.col("j.scale").alias("s"), F.col("j.rotation").alias("r"), F.col("j.translation").alias("t"), F.col("j.origin.latitude").alias("lat0"), F.col("j.origin.longitude").alias("lon0"), F.col("j.origin.altitude").alias("alt0"))


def coordinates(lon: Column, lat: Column, alt: Column) -> Column:
    """lon,lat,alt with 9, 9 and 3 decimals."""
    return F.format_string("%.9f,%.9f,%.3f", lon, lat, F.coalesce(alt, F.lit(0.0)))


def _kml(name: str, body: Column, styles: str = "") -> Column:
    return F.concat(F.lit(f'<?xml version="1.0" encoding="UTF-8"?>\n<kml xmlns="http://www.opengis.net/kml/2.2">\n  <Document>\n    <name>{name}</name>\n{styles}'), body, F.lit("\n  </Document>\n</kml>\n"))


def _point(at: Column) -> Column:
    """Heights count from the ellipsoid, so viewers do not clamp points to the ground."""
    return F.concat(F.lit("<Point><altitudeMode>absolute</altitudeMode><coordinates>"), at, F.lit("</coordinates></Point>"))


def _lines(df: DataFrame, group: str, order: str, line: Column, sep: str, name: str) -> DataFrame:
    """The lines of each group in order, joined: a map's cameras, or the tens of waypoints of a plan."""
    items = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), line.alias("m"))))
    return df.groupBy(group).agg(F.array_join(F.transform(items, lambda s: s["m"]), sep).alias(name))


def camera_kml(cameras: DataFrame, group: str, order: str) -> DataFrame:
    """One KML text a group with a placemark frame_000, frame_001, ... for each position (lat, lon, alt), in order. Groups without positions have no row."""
    from pyspark.sql.window import Window

    c = cameras.withColumn("_i", F.row_number().over(Window.partitionBy(group).orderBy(order)) - 1)
    mark = F.concat(F.format_string("    <Placemark><name>frame_%03d</name>", F.col("_i")), _point(coordinates(F.col("lon"), F.col("lat"), F.col("alt"))), F.lit("</Placemark>"))
    return _lines(c, group, "_i", mark, "\n", "_marks").select(group, _kml("camera_poses", F.col("_marks")).alias("kml"))


def ring_order(points: DataFrame, group: str, key: str) -> DataFrame:
    """Corners (lat, lon) of each group by angle about their mean, the first repeated to close: group, pos, lat, lon, alt.

    A flight plan has at most tens of waypoints, so a group's ring is one row's array.
    """
    w = points.groupBy(group).agg(F.avg("lat").alias("_a"), F.avg("lon").alias("_o"))
    p = points.join(w, group).withColumn("_t", F.atan2(F.col("lat") - F.col("_a"), F.col("lon") - F.col("_o")))
    ring = F.array_sort(F.collect_list(F.struct(F.round("_t", 9).alias("t"), F.col(key).alias("k"), "lat", "lon", "alt")))
    r = p.groupBy(group).agg(ring.alias("ring")).withColumn("ring", F.concat("ring", F.slice("ring", 1, 1)))
    return r.select(group, F.posexplode("ring").alias("pos", "c")).select(group, F.col("pos").cast("long").alias("pos"), "c.lat", "c.lon", "c.alt")


def plan_kml(waypoints: DataFrame, group: str, order: str) -> DataFrame:
    """The plan's KML: from three waypoints on their area, the ring at the waypoints' own heights, then a pin v0, v1, ... for each. Groups without waypoints have no row."""
    from pyspark.sql.window import Window

    at = coordinates(F.col("lon"), F.col("lat"), F.col("alt"))
    p = waypoints.withColumn("_i", F.row_number().over(Window.partitionBy(group).orderBy(order)) - 1)
    pin = F.concat(F.format_string("    <Placemark><name>v%d</name>", F.col("_i")), _point(at), F.lit("</Placemark>"))
    pins = _lines(p, group, "_i", pin, "\n", "_pins").join(p.groupBy(group).agg(F.count(F.lit(1)).alias("_n")), group)
    ring = _lines(ring_order(waypoints, group, order), group, "pos", at, " ", "_ring")
    area = F.concat(F.lit("    <Placemark><name>nfn_flight_area</name><Polygon><altitudeMode>absolute</altitudeMode><outerBoundaryIs><LinearRing><coordinates>"), F.col("_ring"), F.lit("</coordinates></LinearRing></outerBoundaryIs></Polygon></Placemark>\n"))
    return pins.join(ring, group).select(group, _kml("next_flight", F.concat(F.when(F.col("_n") >= 3, area).otherwise(""), F.col("_pins"))).alias("kml"))


def parse_plan_kml(df: DataFrame, group: str) -> DataFrame:
    """Waypoints of KML texts: group, pos, lat, lon, alt. Only plain numbers in a Point match."""
    pattern = r"(?s)<Point>.*?<coordinates>\s*([-\d.]+),([-\d.]+),([-\d.]+)\s*</coordinates>"
    parts = F.arrays_zip(*[F.regexp_extract_all("kml", F.lit(pattern), F.lit(k)).alias(n) for k, n in ((1, "lon"), (2, "lat"), (3, "alt"))])
    return df.select(group, F.posexplode(parts).alias("pos", "p")).select(group, F.col("pos").cast("long").alias("pos"), *[F.col(f"p.{n}").cast("double").alias(n) for n in ("lat", "lon", "alt")])


def _geojson(lon: Column, lat: Column, alt: Column, layer: str, model: str, description: str, more: list[Column]) -> Column:
    """A FeatureCollection of one point; fields without a value stay, as null."""
    geometry = F.struct(F.lit("Point").alias("type"), F.array(lon.cast("double"), lat.cast("double"), alt.cast("double")).alias("coordinates"))
    text = {"layer": layer, "model": model, "description": description, "altitude_mode": "absolute"}
    props = F.struct(*[F.lit(v).alias(k) for k, v in text.items()], *more)
    feature = F.struct(F.lit("Feature").alias("type"), geometry.alias("geometry"), props.alias("properties"))
    return F.to_json(F.struct(F.lit("FeatureCollection").alias("type"), F.array(feature).alias("features")), {"ignoreNullFields": "false"})


def map_geojson(maps: DataFrame) -> DataFrame:
    """Where each map's (0, 0, 0) lies on Earth: map_id and geojson. maps: map_id, lat0, lon0, alt0, s, mean_confidence, median_confidence; a missing altitude is 0."""
    more = [F.col("s").alias("scale"), F.col("mean_confidence"), F.col("median_confidence")]
    return maps.select("map_id", _geojson(F.col("lon0"), F.col("lat0"), F.coalesce("alt0", F.lit(0.0)), "scene_origin", "scene_geo.glb", "model local (0,0,0); the first keyframe's GPS fix", more).alias("geojson"))


def site_geojson(site: DataFrame, site_maps: DataFrame, origin: tuple[float, float, float | None]) -> DataFrame:
    """Where the site's (0, 0, 0) lies on Earth, with its counts, mean and median confidence and map ids in order. site_maps (source, map_id) is a catalogue, one short row a map."""
    one = site.select("conf", F.lit(1).alias("_k"))
    s = one.groupBy("_k").agg(F.count(F.lit(1)).alias("num_points"), F.avg("conf").alias("mean_confidence")).join(percentiles(one, ["_k"], {"median_confidence": ("conf", 0.5)}), "_k")
    ids = site_maps.agg(F.transform(F.array_sort(F.collect_list(F.struct("source", "map_id"))), lambda x: x["map_id"]).alias("map_ids")).withColumn("_k", F.lit(1))
    more = [F.size("map_ids").alias("num_maps"), F.col("num_points"), F.col("mean_confidence"), F.col("median_confidence"), F.col("map_ids")]
    lat, lon, alt = (F.lit(None if v is None else float(v)) for v in origin)
    return s.join(ids, "_k").select(_geojson(lon, lat, F.coalesce(alt, F.lit(0.0)), "site_origin", "site.glb", "model local (0,0,0); the first merged map's origin", more).alias("geojson"))


GEOJSON = """struct<type: string, features: array<struct<type: string, geometry: struct<type: string, coordinates: array<double>>, properties: struct<layer: string, model: string, description: string,
altitude_mode: string, scale: double, num_maps: long, num_points: long, mean_confidence: double, median_confidence: double, map_ids: array<string>>>>>"""


def parse_geojson(texts: DataFrame, column: str = "geojson") -> DataFrame:
    """The first feature's fields of such texts beside the other columns: layer, model, altitude_mode, lon, lat, alt, scale, num_maps, num_points, mean_confidence, median_confidence, map_ids; null where a text has none."""
    f = F.from_json(F.col(column), GEOJSON)["features"][0]
    at, p = f["geometry"]["coordinates"], f["properties"]
    names = ("layer", "model", "altitude_mode", "scale", "num_maps", "num_points", "mean_confidence", "median_confidence", "map_ids")
    return texts.select(*[c for c in texts.columns if c != column], *[at[k].alias(n) for k, n in enumerate(("lon", "lat", "alt"))], *[p[n].alias(n) for n in names])


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    """NPZ files with world_points (S, H, W, 3), conf and images as point rows: path, frame, row, col, ord, x, y, z, conf, r, g, b."""
    schema = "path string, frame int, row int, col int, ord long, x double, y double, z double, conf double, r int, g int, b int"

    def load(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for p, content in zip(b.path, b.content):
                with np.load(io.BytesIO(content), allow_pickle=False) as z:
                    pts, conf, img = z["world_points"], z["world_points_conf"], z["images"]
                s, h, w = conf.shape
                for f in range(s):  # a frame at a time
                    rgb = (np.moveaxis(img[f], 0, -1).astype(float) * 255).astype(np.int64).reshape(-1, 3)
                    xyz, k = pts[f].reshape(-1, 3).astype(float), np.arange(h * w)
                    yield pd.DataFrame({"path": p, "frame": np.int32(f), "row": (k // w).astype("int32"), "col": (k % w).astype("int32"), "ord": f * h * w + k, "x": xyz[:, 0], "y": xyz[:, 1], "z": xyz[:, 2], "conf": conf[f].ravel().astype(float), "r": rgb[:, 0], "g": rgb[:, 1], "b": rgb[:, 2]})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(load, schema)


CAMERAS = "path string, frame int, r array<array<double>>, t array<double>, k array<array<double>>"


def read_cameras(spark: SparkSession, path: str) -> DataFrame:
    """Cameras of the same files: path, frame, extrinsic as r and t, intrinsic k (null where a file has none), and the pose (px, py, pz, rotation)."""
    from terrafold.operators.points import camera_pose

    def load(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for p, content in zip(b.path, b.content):
                with np.load(io.BytesIO(content), allow_pickle=False) as z:
                    e, k = z["extrinsic"] if "extrinsic" in z.files else np.zeros((0, 3, 4)), z["intrinsic"] if "intrinsic" in z.files else None
                if len(e):
                    yield pd.DataFrame({"path": p, "frame": np.arange(len(e), dtype=np.int32), "r": e[:, :, :3].astype(float).tolist(), "t": e[:, :, 3].astype(float).tolist(), "k": k.astype(float).tolist() if k is not None else [None] * len(e)})

    c = spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(load, CAMERAS)
    return c.withColumns(camera_pose(F.col("r"), F.col("t")))


def prediction_npz(points: DataFrame, cameras: DataFrame | None = None) -> DataFrame:
    """The files that read_predictions reads: map_id, npz. points: map_id, frame, row, col, x, y, z, conf, r, g, b; cameras: map_id, frame, r, t, k.

    A map is one batch of keyframes, so it is the work of one task. Pixels that a map lacks have NaN positions and no confidence.
    """
    left = points.select("map_id", "frame", "row", "col", "x", "y", "z", "conf", "r", "g", "b")
    right = cameras.select("map_id", "frame", F.col("r").alias("e"), "t", "k") if cameras is not None else left.sparkSession.createDataFrame([], "map_id string, frame int, e array<array<double>>, t array<double>, k array<array<double>>")

    def write(key: tuple, g: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        if not len(g):
            return pd.DataFrame({"map_id": [], "npz": []})
        f, i, j = (g[n].to_numpy(int) for n in ("frame", "row", "col"))
        s, h, w = f.max() + 1, i.max() + 1, j.max() + 1
        pts, conf, img = np.full((s, h, w, 3), np.nan, np.float32), np.zeros((s, h, w), np.float32), np.zeros((s, 3, h, w), np.float32)
        pts[f, i, j], conf[f, i, j] = g[["x", "y", "z"]].to_numpy(np.float32), g.conf.to_numpy(np.float32)
        for n, colour in enumerate("rgb"):
            img[f, n, i, j] = (g[colour].to_numpy(np.float32) + 0.5) / 255  # truncation on reading gives the number back
        arrays = {"world_points": pts, "world_points_conf": conf, "images": np.minimum(img, 1.0)}
        c = c.sort_values("frame")
        if len(c):
            arrays["extrinsic"] = np.stack([np.column_stack([np.array(r.tolist()), t]) for r, t in zip(c.e, c.t)])
            if c.k.notna().all():
                arrays["intrinsic"] = np.stack([np.array(k.tolist()) for k in c.k])
        out = io.BytesIO()
        np.savez_compressed(out, **arrays)
        return pd.DataFrame({"map_id": [key[0]], "npz": [out.getvalue()]})

    return left.groupBy("map_id").cogroup(right.groupBy("map_id")).applyInPandas(write, "map_id string, npz binary")


def keyframe_name(frame_id: Column, ts: Column) -> Column:
    """File name of a kept frame: its number and the time of its arrival to the microsecond."""
    return F.concat(F.format_string("keyframe_%06d_", frame_id), F.date_format(ts, "yyyyMMdd_HHmmss_SSSSSS"), F.lit(".jpg"))


def png(image: np.ndarray) -> bytes:
    """An image (h x w x 3, 0-255) as PNG."""
    h, w, _ = image.shape
    raw = np.concatenate([np.zeros((h, 1), np.uint8), np.ascontiguousarray(image, np.uint8).reshape(h, -1)], 1).tobytes()
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def model_inputs(points: DataFrame) -> DataFrame:
    """The frames a model saw, from their points' colours: map_id, name (frame_000000.png, ...), image. One frame is the work of one task; missing pixels are black."""

    def draw(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        i, j = g["row"].to_numpy(int), g["col"].to_numpy(int)
        img = np.zeros((i.max() + 1, j.max() + 1, 3), np.uint8)
        img[i, j] = np.clip(g[["r", "g", "b"]].to_numpy(), 0, 255)
        return pd.DataFrame({"map_id": [key[0]], "name": [f"frame_{key[1]:06d}.png"], "image": [png(img)]})

    return points.select("map_id", "frame", "row", "col", "r", "g", "b").groupBy("map_id", "frame").applyInPandas(draw, "map_id string, name string, image binary")


def write_files(files: DataFrame, name: str, content: str, folder: str) -> None:
    """Each row's bytes as a file of its own, written by the executors under a folder that they share."""
    import os

    def put(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for n, data in zip(b["n"], b["c"]):
                at = os.path.join(folder, n)
                os.makedirs(os.path.dirname(at), exist_ok=True)
                with open(f"{at}.part", "wb") as f:
                    f.write(bytes(data))
                os.replace(f"{at}.part", at)  # a task that runs again replaces the file whole
            yield pd.DataFrame({"k": [len(b)]})

    files.select(F.col(name).alias("n"), F.col(content).alias("c")).mapInPandas(put, "k long").agg(F.sum("k")).collect()


def list_images(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """Image files (jpg, jpeg, png, bmp) sorted by path, at most `limit`."""
    d = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).where(F.lower("path").rlike(r"\.(jpg|jpeg|png|bmp)$")).orderBy("path")
    return d if limit is None else d.limit(limit)


def pack_frame(image: bytes, gps: tuple[float, float, float] | None) -> bytes:
    """A frame as sent; no position is three NaN, no altitude one."""
    lat, lon, alt = gps or (float("nan"),) * 3
    return struct.pack(FRAME_HEAD, len(image)) + image + struct.pack(FRAME_GPS, lat, lon, float("nan") if alt is None else alt)


def unpack_frames(data: bytes) -> tuple[list[tuple[bytes, tuple[float, float, float] | None]], bytes]:
    """Whole frames of a byte stream, and the rest. NaN in latitude or longitude is no position; a NaN altitude passes."""
    out, at = [], 0
    while at + 4 <= len(data):
        n = struct.unpack_from(FRAME_HEAD, data, at)[0]
        if at + 4 + n + 24 > len(data):
            break
        lat, lon, alt = struct.unpack_from(FRAME_GPS, data, at + 4 + n)
        out.append((data[at + 4 : at + 4 + n], None if lat != lat or lon != lon else (lat, lon, alt)))
        at += 28 + n
    return out, data[at:]


def pack_reply(status: float, kept: float, total: float, payload: bytes = b"") -> bytes:
    return struct.pack(REPLY_HEAD, status, kept, total) + struct.pack(REPLY_LENGTH, len(payload)) + payload


def unpack_reply(data: bytes) -> tuple[float, float, float, bytes]:
    status, kept, total = struct.unpack_from(REPLY_HEAD, data, 0)
    n = struct.unpack_from(REPLY_LENGTH, data, 24)[0]
    return status, kept, total, data[28 : 28 + n]


def read_wire(spark: SparkSession, path: str) -> DataFrame:
    """Captured wire streams (binary files) as frames: path, frame_id from 1, n_bytes, image, lat, lon, alt. A broken tail ends its file; a NaN altitude is null."""
    schema = "path string, frame_id long, n_bytes long, image binary, lat double, lon double, alt double"

    def load(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for p, content in zip(b.path, b.content):
                frames, _ = unpack_frames(bytes(content))
                if not frames:
                    continue
                yield pd.DataFrame([(p, k + 1, len(i), i, *(g or (None, None, None))) for k, (i, g) in enumerate(frames)], columns=[c.split()[0] for c in schema.split(", ")]).astype({"lat": float, "lon": float, "alt": float})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(load, schema)
