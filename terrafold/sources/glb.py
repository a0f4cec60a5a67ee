"""Binary glTF scenes of points and triangles, written and read with numpy alone."""

from __future__ import annotations

import json
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrafold.operators.points import numbered

# Fixed values of the format: its magic and version, chunk kinds, component types, buffer targets, drawing modes.
MAGIC, VERSION, JSON_CHUNK, BIN_CHUNK = 0x46546C67, 2, 0x4E4F534A, 0x004E4942
UBYTE, UINT, FLOAT, ARRAY, ELEMENTS, POINTS, TRIANGLES = 5121, 5125, 5126, 34962, 34963, 0, 4
#: Points of a file; a larger group is written as several.
PART_ROWS = 1_000_000


def pack(meshes: list[dict]) -> bytes:
    """A scene with a node for each mesh: name, positions (n x 3), colors (n x 3 or 4, 0-255, optional) and faces (m x 3, optional; without them points are drawn)."""
    views, accessors, nodes, out, blob = [], [], [], [], b""

    def add(a: np.ndarray, kind: int, shape: str, target: int, **more) -> int:
        nonlocal blob
        blob += b"\0" * (-len(blob) % 4)
        views.append({"buffer": 0, "byteOffset": len(blob), "byteLength": a.nbytes, "target": target})
        accessors.append({"bufferView": len(views) - 1, "componentType": kind, "count": len(a) if a.ndim > 1 else a.size, "type": shape, **more})
        blob += a.tobytes()
        return len(accessors) - 1

    for m in meshes:
        p = np.ascontiguousarray(m["positions"], "<f4").reshape(-1, 3)
        if not len(p):
            continue
        box = {"min": p.min(0).astype(float).tolist(), "max": p.max(0).astype(float).tolist()}
        part = {"attributes": {"POSITION": add(p, FLOAT, "VEC3", ARRAY, **box)}, "mode": POINTS}
        if m.get("colors") is not None:
            c = np.asarray(m["colors"], np.uint8)
            c = np.ascontiguousarray(np.column_stack([c, np.full(len(c), 255, np.uint8)]) if c.shape[1] == 3 else c)
            part["attributes"]["COLOR_0"] = add(c, UBYTE, "VEC4", ARRAY, normalized=True)
        if m.get("faces") is not None and len(m["faces"]):
            part |= {"indices": add(np.ascontiguousarray(m["faces"], "<u4").ravel(), UINT, "SCALAR", ELEMENTS), "mode": TRIANGLES}
        out.append({"name": m["name"], "primitives": [part]})
        nodes.append({"name": m["name"], "mesh": len(out) - 1})
    head: dict = {"asset": {"version": "2.0"}, "scene": 0, "scenes": [{"nodes": list(range(len(nodes)))} if nodes else {}]}
    if nodes:
        head |= {"nodes": nodes, "meshes": out, "accessors": accessors, "bufferViews": views, "buffers": [{"byteLength": len(blob)}]}
    text = json.dumps(head, separators=(",", ":")).encode()
    text += b" " * (-len(text) % 4)
    blob += b"\0" * (-len(blob) % 4)
    chunks = struct.pack("<II", len(text), JSON_CHUNK) + text + (struct.pack("<II", len(blob), BIN_CHUNK) + blob if blob else b"")
    return struct.pack("<III", MAGIC, VERSION, 12 + len(chunks)) + chunks


def unpack(data: bytes) -> list[dict]:
    """The meshes of a scene that `pack` wrote (or another writer, as long as its numbers lie densely): name, positions, colors, faces."""
    magic, _, total = struct.unpack_from("<III", data, 0)
    if magic != MAGIC or total > len(data):
        raise ValueError("no binary glTF")
    n = struct.unpack_from("<I", data, 12)[0]
    head = json.loads(data[20 : 20 + n])
    at = 20 + n + 8

    def read(k: int) -> np.ndarray:
        a = head["accessors"][k]
        v = head["bufferViews"][a["bufferView"]]
        width = {"SCALAR": 1, "VEC3": 3, "VEC4": 4}[a["type"]]
        kind = {UBYTE: "u1", UINT: "<u4", FLOAT: "<f4"}[a["componentType"]]
        return np.frombuffer(data, kind, a["count"] * width, at + v.get("byteOffset", 0) + a.get("byteOffset", 0)).reshape(-1, width)

    out = []
    for m in head.get("meshes", []):
        p = m["primitives"][0]
        out.append({"name": m.get("name", ""), "positions": read(p["attributes"]["POSITION"]), "colors": read(p["attributes"]["COLOR_0"]) if "COLOR_0" in p["attributes"] else None, "faces": read(p["indices"]).reshape(-1, 3) if "indices" in p else None})
    return out


def point_scenes(points: DataFrame, group: str, part_rows: int = PART_ROWS) -> DataFrame:
    """Scenes of points (group, ord, x, y, z, red, green, blue): group, part, glb.

    Rows are numbered over all tasks by (group, ord) and cut every `part_rows`, so a file, and a task, holds at most so many points; points
    without a finite position are left out; a group without points has no scene.
    """
    kind = dict(points.dtypes)[group]
    inf = float("inf")
    ok = F.lit(True)
    for c in ("x", "y", "z"):
        ok = ok & F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < inf)
    p = numbered(points.where(ok & F.col(group).isNotNull()).select(group, "ord", "x", "y", "z", "red", "green", "blue"), [group, "ord", "x", "y", "z"], "_n")
    p = p.withColumn("part", F.floor(F.col("_n") / part_rows).cast("long"))

    def scene(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("_n")
        mesh = {"name": str(key[0]), "positions": g[["x", "y", "z"]].to_numpy(), "colors": g[["red", "green", "blue"]].to_numpy()}
        return pd.DataFrame({group: g[group].iloc[:1].to_numpy(), "part": [key[1]], "glb": [pack([mesh])]})

    return p.groupBy(group, "part").applyInPandas(scene, f"`{group}` {kind}, part long, glb binary")


def read_point_scenes(scenes: DataFrame, group: str) -> DataFrame:
    """Points of scenes (group, part, glb): group, ord, x, y, z, red, green, blue; ord counts within a part."""
    kind = dict(scenes.dtypes)[group]

    def load(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for key, data in zip(b[group], b.glb):
                for m in unpack(bytes(data)):
                    c = m["colors"] if m["colors"] is not None else np.zeros((len(m["positions"]), 3), np.uint8)
                    yield pd.DataFrame({group: key, "ord": np.arange(len(c)), **dict(zip("xyz", m["positions"].astype(float).T)), **dict(zip(("red", "green", "blue"), c[:, :3].astype(np.int32).T))})

    return scenes.select(group, "glb").mapInPandas(load, f"`{group}` {kind}, ord long, x double, y double, z double, red int, green int, blue int")
