"""Sky masks: what a sky model is fed and what is made of its answer, and the table that keeps masks so that none is made twice.

The model is the user's, as a function from 1 x 3 x 320 x 320 numbers to a map of sky odds; an ONNX file goes through `onnx_model`.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Side of the model's input, means and deviations of its colours, odds (0-255) below which a pixel is no sky.
SIDE, MEANS, DEVIATIONS, NO_SKY = 320, (0.485, 0.456, 0.406), (0.229, 0.224, 0.225), 32
MASKS = "map_id string, frame int, h int, w int, mask binary"


def resize(a: np.ndarray, h: int, w: int) -> np.ndarray:
    """Bilinear, pixel centres matched, edges repeated."""
    a = np.asarray(a, float)
    at = lambda n, m: np.clip((np.arange(n) + 0.5) * m / n - 0.5, 0, m - 1)
    y, x = at(h, a.shape[0]), at(w, a.shape[1])
    i, j = np.floor(y).astype(int), np.floor(x).astype(int)
    i1, j1 = np.minimum(i + 1, a.shape[0] - 1), np.minimum(j + 1, a.shape[1] - 1)
    fy, fx = (y - i).reshape(-1, 1, *[1] * (a.ndim - 2)), (x - j).reshape(1, -1, *[1] * (a.ndim - 2))
    top, low = a[i][:, j] * (1 - fx) + a[i][:, j1] * fx, a[i1][:, j] * (1 - fx) + a[i1][:, j1] * fx
    return top * (1 - fy) + low * fy


def model_input(image: np.ndarray) -> np.ndarray:
    """An image (h x w x 3, 0-255) as the model takes it."""
    x = (resize(image, SIDE, SIDE) / 255 - np.array(MEANS)) / np.array(DEVIATIONS)
    return np.moveaxis(x, -1, 0)[None].astype(np.float32)


def mask_of(answer: np.ndarray, h: int, w: int) -> np.ndarray:
    """255 where there is no sky, else 0: the answer stretched to 0-255, brought to the image's size, and cut; an answer without contrast has no sky."""
    a = np.squeeze(np.asarray(answer, float))
    span = a.max() - a.min()
    odds = ((a - a.min()) / span * 255).astype(np.uint8) if span > 0 else np.zeros(a.shape, np.uint8)
    return np.where(resize(odds, h, w) < NO_SKY, 255, 0).astype(np.uint8)


def onnx_model(path: str) -> Callable[[np.ndarray], np.ndarray]:
    import onnxruntime

    s = onnxruntime.InferenceSession(path)
    return lambda x: s.run([s.get_outputs()[0].name], {s.get_inputs()[0].name: x})[0]


def masks(images: DataFrame, make_model: Callable[[], Callable[[np.ndarray], np.ndarray]], folder: str) -> DataFrame:
    """map_id, frame, h, w, mask of each image (map_id, frame, h, w, pixels: h x w x 3 bytes), from the table in `folder` or else made now and added to it.

    Images whose mask is there are not read. An image whose bytes do not fit its size has no mask.
    """
    spark = images.sparkSession
    from terrafold.session import list_folder

    known = spark.read.schema(MASKS).parquet(folder) if list_folder(spark, folder) else spark.createDataFrame([], MASKS)
    missing = images.join(known.select("map_id", "frame"), ["map_id", "frame"], "left_anti")

    def make(batches):  # noqa: ANN001, ANN202
        model = None
        for b in batches:
            rows = []
            for m, f, h, w, data in zip(b.map_id, b.frame, b.h, b.w, b.pixels):
                if data is None or len(data) != h * w * 3 or not h * w:
                    continue
                model = model or make_model()
                rows.append((m, f, h, w, mask_of(model(model_input(np.frombuffer(bytes(data), np.uint8).reshape(h, w, 3))), h, w).tobytes()))
            yield pd.DataFrame(rows, columns=["map_id", "frame", "h", "w", "mask"]) if rows else b[["map_id", "frame", "h", "w"]].iloc[:0].assign(mask=b.pixels.iloc[:0])

    missing.select("map_id", "frame", "h", "w", "pixels").mapInPandas(make, MASKS).write.mode("append").parquet(folder)
    return spark.read.schema(MASKS).parquet(folder).dropDuplicates(["map_id", "frame"]).join(images.select("map_id", "frame"), ["map_id", "frame"], "left_semi")


def mask_pixels(of: DataFrame) -> DataFrame:
    """Masks as rows: map_id, frame, row, col, mask in 0..1, ready to be joined to points for `zero_sky`."""
    x = of.select("map_id", "frame", "w", F.posexplode(F.transform(F.sequence(F.lit(1), F.length("mask")), lambda k: F.conv(F.hex(F.substring("mask", k, F.lit(1))), 16, 10).cast("int"))).alias("k", "v"))
    return x.select("map_id", "frame", F.floor(F.col("k") / F.col("w")).cast("int").alias("row"), (F.col("k") % F.col("w")).cast("int").alias("col"), (F.col("v") / 255.0).alias("mask"))
