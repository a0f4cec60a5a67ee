"""A site as files for viewers and for other programs: scenes, arrays, GeoJSON; and back into tables.

A file holds at most PART_ROWS points; the first part has the plain name, further ones a number. Scenes hold positions and
colours only, so each has an array file beside it, row by row, with what a later merge needs.
"""

from __future__ import annotations

import io
import os
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrafold.operators import points
from terrafold.operators.geo import y_up
from terrafold.session import list_folder
from terrafold.sources import formats, glb

SITE = "ord long, x double, y double, z double, r int, g int, b int, conf double, source long"
SEGMENTS = "query string, pos long, ord long, x double, y double, z double, red int, green int, blue int"


def _part_name(stem: str, part: int, end: str) -> str:
    return f"{stem}.{end}" if not part else f"{stem}_{part:04d}.{end}"


def _npz(**arrays: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.savez_compressed(out, **arrays)
    return out.getvalue()


def site_files(site: DataFrame, part_rows: int = glb.PART_ROWS) -> DataFrame:
    """name, content: site.glb in true colours, merged_res.glb by source, site_confidence.glb from red to green, and site_points.npz with conf and source, row by row. A null source has no colour."""
    s = points.numbered(site.where(points.finite_xyz()), ["ord", "x", "y", "z"], "_n").withColumn("part", F.floor(F.col("_n") / part_rows).cast("int"))
    hue = {f"m_{k}": F.coalesce(c, F.lit(0)) for k, c in points.hue_rgb(F.col("source")).items()}
    ramp = {f"c_{k}": c for k, c in points.ramp(F.col("conf")).items()}
    s = s.withColumns(dict(zip(("vx", "vy", "vz"), y_up(F.col("x"), F.col("y"), F.col("z")))) | hue | ramp)

    def write(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("_n")
        p, part = g[["vx", "vy", "vz"]].to_numpy(), int(key[0])
        scene = lambda name, *cols: glb.pack([{"name": name, "positions": p, "colors": np.clip(g[list(cols)].to_numpy(float), 0, 255)}])
        files = {
            _part_name("site", part, "glb"): scene("site", "r", "g", "b"), _part_name("merged_res", part, "glb"): scene("merged", "m_red", "m_green", "m_blue"),
            _part_name("site_confidence", part, "glb"): scene("confidence", "c_red", "c_green", "c_blue"),
            _part_name("site_points", part, "npz"): _npz(conf=g.conf.to_numpy(np.float32), source=g.source.fillna(-1).to_numpy(np.int64)),
        }
        return pd.DataFrame({"name": list(files), "content": list(files.values())})

    return s.groupBy("part").applyInPandas(write, "name string, content binary")


def segment_files(site: DataFrame, segments: DataFrame, part_rows: int = glb.PART_ROWS) -> DataFrame:
    """name, content: seg_site.glb with the dimmed site as its background, a scene for each target's points, and site_segments.npz for each target (queries, colors, counts, points)."""
    back = site.select(F.lit("site").alias("query"), F.lit(-1).cast("long").alias("pos"), "ord", "x", "y", "z", *[points.dim(F.col(c)).alias(n) for c, n in zip("rgb", ("red", "green", "blue"))])
    s = points.numbered(back.unionByName(segments.select(*back.columns)).where(points.finite_xyz()), ["pos", "ord", "x", "y", "z"], "_n")
    first = s.groupBy("pos").agg(F.min("_n").alias("_first"))  # a row a target
    s = s.join(first, "pos").withColumn("part", F.floor((F.col("_n") - F.col("_first")) / part_rows).cast("int")).drop("_first")
    s = s.withColumns(dict(zip(("vx", "vy", "vz"), y_up(F.col("x"), F.col("y"), F.col("z")))))

    def write(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        g, pos, part = g.sort_values("_n"), int(key[0]), int(key[1])
        query, colour = g["query"].iloc[0], g[["red", "green", "blue"]].to_numpy()
        scene = glb.pack([{"name": query, "positions": g[["vx", "vy", "vz"]].to_numpy(), "colors": np.clip(colour, 0, 255)}])
        if pos < 0:
            return pd.DataFrame({"name": [_part_name("seg_site", part, "glb")], "content": [scene]})
        npz = _npz(queries=np.array([query]), colors=colour[:1].astype(np.uint8), counts=np.array([len(g)]), points=g[["x", "y", "z"]].to_numpy())
        return pd.DataFrame({"name": [_part_name(f"seg_site_target{pos:04d}", part, "glb"), _part_name(f"site_segments_target{pos:04d}", part, "npz")], "content": [scene, npz]})

    return s.groupBy("pos", "part").applyInPandas(write, "name string, content binary")


def export_site(site: DataFrame, site_maps: DataFrame, segments: DataFrame, origin: tuple[float, float, float | None], folder: str, part_rows: int = glb.PART_ROWS) -> bool:
    """Writes all files of a site into a folder that the executors share, in place of what was there; an empty site leaves no folder, and False."""
    import shutil

    shutil.rmtree(folder, ignore_errors=True)
    if site.isEmpty():
        return False
    formats.write_files(site_files(site, part_rows), "name", "content", folder)
    if not segments.isEmpty():
        formats.write_files(segment_files(site, segments, part_rows), "name", "content", folder)
    text = formats.site_geojson(site, site_maps, origin).select(F.lit("site.geojson").alias("name"), F.encode("geojson", "utf-8").alias("content"))
    formats.write_files(text, "name", "content", folder)
    return True


def _numbered_files(df: DataFrame, stem: str) -> DataFrame:
    """content of each part of a file, with its number."""
    name = F.element_at(F.split("path", "/"), -1)
    part = F.regexp_extract(name, rf"^{stem}_(\d+)\.", 1)
    return df.where(name.rlike(rf"^{stem}(_\d+)?\.")).select(F.when(part == "", 0).otherwise(part.cast("int")).alias("part"), "content")


def import_site(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, tuple[float, float, float]] | None:
    """(site, site_maps, origin) from such files; None unless GeoJSON, scene and arrays are all there. Scenes and arrays are joined row by row; ord is the row's number."""
    names = list_folder(spark, folder)
    if not {"site.geojson", "site.glb", "site_points.npz"} <= set(names):
        return None
    files = spark.read.format("binaryFile").load(folder).select("path", "content")
    pairs = _numbered_files(files.where(F.col("path").endswith(".glb")), "site").withColumnRenamed("content", "scene").join(_numbered_files(files.where(F.col("path").endswith(".npz")), "site_points"), "part")

    def load(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for part, scene, arrays in zip(b.part, b.scene, b.content):
                m = glb.unpack(bytes(scene))[0]
                with np.load(io.BytesIO(bytes(arrays)), allow_pickle=False) as z:
                    conf, source = z["conf"].astype(float), z["source"]
                x, y, z_ = m["positions"].astype(float).T  # y up: (-east, up, north)
                c = m["colors"][:, :3].astype(np.int32)
                yield pd.DataFrame({"ord": (int(part) << 40) + np.arange(len(conf)), "x": -x, "y": z_, "z": y, "r": c[:, 0], "g": c[:, 1], "b": c[:, 2], "conf": conf, "source": pd.array(np.where(source < 0, 0, source), "Int64").copy() if (source >= 0).all() else pd.Series(source).where(source >= 0).astype("Int64")})

    site = pairs.mapInPandas(load, SITE)
    meta = formats.parse_geojson(files.where(F.col("path").endswith("/site.geojson")).select(F.decode("content", "utf-8").alias("geojson"))).first()
    maps = spark.createDataFrame([(k, m) for k, m in enumerate(meta["map_ids"] or [])], "source long, map_id string")
    return site, maps, (meta["lat"], meta["lon"], meta["alt"])


def import_segments(spark: SparkSession, folder: str) -> DataFrame:
    """Targets from all site_segments files; each file's flat points are split by its counts. pos follows the file names, then the order within."""
    stem = re.compile(r"^site_segments.*\.npz$")
    names = [n for n in list_folder(spark, folder) if stem.match(n)]
    if not names:
        return spark.createDataFrame([], SEGMENTS)
    order = {n: k for k, n in enumerate(names)}

    def load(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for path, content in zip(b.path, b.content):
                with np.load(io.BytesIO(bytes(content)), allow_pickle=False) as z:
                    queries, colors, counts, pts = z["queries"], z["colors"].astype(np.int32), z["counts"].astype(int), z["points"].astype(float)
                at = np.repeat(np.arange(len(counts)), counts)
                if len(at):
                    yield pd.DataFrame({"query": queries[at].astype(str), "pos": order[os.path.basename(path)] * (1 << 20) + at, "ord": np.arange(len(at)) - (np.cumsum(counts) - counts)[at], **dict(zip("xyz", pts[: len(at)].T)), **dict(zip(("red", "green", "blue"), colors[at].T))})

    return spark.read.format("binaryFile").load([f"{folder}/{n}" for n in names]).select("path", "content").mapInPandas(load, SEGMENTS)
