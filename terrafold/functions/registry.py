"""Plug-in slots: reconstructors and segmenters are functions over a map's rows, registered by name.

A reconstructor takes the pandas rows of one map's frames and returns its points; a segmenter takes frames and a query
and returns hit pixels. Models are the user's: the engine runs them in applyInPandas, one map a call.
"""

from __future__ import annotations

import time
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame

POINTS = "map_id string, frame int, row int, col int, ord long, x double, y double, z double, conf double, r int, g int, b int"
MASKS = "map_id string, frame int, row int, col int, query string, hit boolean"


class Registry:
    """Names to implementations; a name can be taken once."""

    def __init__(self, kind: str):
        self.kind, self._items = kind, {}

    def register(self, name: str) -> Callable:
        def add(item):
            if name in self._items:
                raise ValueError(f"{self.kind} {name!r} is already registered")
            self._items[name] = item
            return item

        return add

    def get(self, name: str):
        if name not in self._items:
            raise KeyError(f"unknown {self.kind} {name!r}; known: {', '.join(sorted(self._items)) or 'none'}")
        return self._items[name]

    def names(self) -> list[str]:
        return sorted(self._items)

    def is_registered(self, name: str) -> bool:
        return name in self._items


reconstructors, segmenters = Registry("reconstructor"), Registry("segmenter")


def _empty(g: pd.DataFrame, schema: str) -> pd.DataFrame:
    """No rows, with column types that convert."""
    kinds = {"int": "int32", "long": "int64", "double": "float64", "boolean": "bool"}
    return pd.DataFrame({c: g.map_id.iloc[:0] if k == "string" else pd.Series([], dtype=kinds[k]) for c, k in (x.split() for x in schema.split(", "))})


def reconstruct(frames: DataFrame, name: str) -> DataFrame:
    """Points of every map by the named reconstructor; a map whose model fails gives no rows."""
    model = reconstructors.get(name)

    def run(g: pd.DataFrame) -> pd.DataFrame:
        columns = [c.split()[0] for c in POINTS.split(", ")]
        try:
            return model(g)[columns]
        except Exception:  # noqa: BLE001 - errors are values in a batch run
            return _empty(g, POINTS)

    return frames.groupBy("map_id").applyInPandas(run, POINTS)


def segment(frames: DataFrame, query: str, name: str) -> DataFrame:
    """Hit pixels of every frame for a query; a failing frame has an empty mask, a model that can't start fails the run."""
    make, q = segmenters.get(name), query.strip()
    if not q:
        raise ValueError("empty query")

    def run(g: pd.DataFrame) -> pd.DataFrame:
        model, out = make(), []
        for _, f in g.iterrows():
            try:
                out += [(f.map_id, f.frame, r, c, q, True) for r, c in model(f, q)]
            except Exception:  # noqa: BLE001, S112
                continue
        return pd.DataFrame(out, columns=[c.split()[0] for c in MASKS.split(", ")]) if out else _empty(g, MASKS)

    return frames.groupBy("map_id").applyInPandas(run, MASKS)


def timed(stage: Callable, *args, **kwargs) -> dict:
    """A stage's result as a value: {"value", "seconds"} or {"error"}."""
    t = time.perf_counter()
    try:
        return {"value": stage(*args, **kwargs), "seconds": time.perf_counter() - t}
    except Exception as e:  # noqa: BLE001
        return {"error": str(e) or type(e).__name__}
