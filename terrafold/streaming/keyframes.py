"""Keyframe selection and count-based batches, over a table and over a stream, with the same step function.

A frame is compared with the last anchor. Without an anchor a frame anchors, and is kept, if it shows LEAST_FEATURES
features; else it is rejected and there still is none. With one, a frame that moved by more than the threshold (strictly),
or in which fewer than LEAST_FEATURES of the anchor's features are found again, becomes the new anchor, under the same
condition: with too few features of its own it is rejected and the anchor is gone. A frame without a position value could not be
compared: it is rejected and nothing changes. A null feature count is no reason to reject. Kept frames close a batch every
`batch_size`. Control rows (control = flush, clear, on, off) are part of the stream, so a replay gives the same result:
flush closes a partial batch, clear discards it, off keeps every frame untouched by the tracker, and on after off anchors anew.
The state is keyed by stream; arrival order is given by `seq`.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from terrafold.session import ensure_checkpoint_dir

# Displacement threshold in px, features below which tracking is lost, keyframes of a batch.
THRESHOLD, LEAST_FEATURES, BATCH = 40.0, 10, 25

#: A row out for each row in; open: frames in the unfinished batch after it.
OUT = "stream long, seq long, kept boolean, batch long, position int, flushed boolean, open int, control boolean"
STATE = "anchor double, anchored boolean, active boolean, batch long, open int, received long, kept long"


@dataclass
class Tracker:
    """State of one stream. `open` counts the frames of the unfinished batch."""

    anchor: float = 0.0
    anchored: bool = False
    active: bool = True
    batch: int = 0
    open: int = 0
    received: int = 0
    kept: int = 0

    def step(self, value: float | None, features: int | None, threshold: float) -> bool:
        """Whether the frame is kept. value is the frame's position in px along its motion."""
        self.received += 1
        if threshold <= 0 or not self.active:
            self.kept += 1
            return True
        if value is None or value != value:
            return False
        few = features is not None and features == features and features < LEAST_FEATURES
        if self.anchored and not few and not abs(value - self.anchor) > threshold:
            return False
        self.anchored = not few
        if few:
            return False
        self.anchor = float(value)
        self.kept += 1
        return True

    def row(self, stream, seq, value, features, control, threshold: float, size: int):
        """The output row of one input row, as in OUT; control rows are never kept."""
        if isinstance(control, str) and control:
            flushed, at = False, self.batch
            if control == "flush" and self.open:
                flushed, self.batch, self.open = True, self.batch + 1, 0
            elif control == "clear":
                self.open = 0
            elif control == "on":
                if not self.active:
                    self.anchored = False
                self.active = True
            elif control == "off":
                self.active = False
            return stream, seq, False, at if flushed else None, None, flushed, self.open, True
        if not self.step(value, features, threshold):
            return stream, seq, False, None, None, False, self.open, False
        at, pos = self.batch, self.open
        self.open += 1
        full = self.open >= size
        if full:
            self.batch, self.open = self.batch + 1, 0
        return stream, seq, True, at, pos, full, self.open, False


_COLUMNS = [c.split()[0] for c in OUT.split(", ")]


def _frame(rows: list) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=_COLUMNS)
    return out.astype({"kept": bool, "flushed": bool, "control": bool, "open": "int32"}).assign(batch=out.batch.astype("Int64"), position=out.position.astype("Int32"))


def frame_steps(frames: DataFrame) -> DataFrame:
    """Streamed frames (stream, frame_id, displacement in px since the frame before, n_features) as rows to select from: stream, seq, value, n_features, control.

    value is the motion summed up so far, in thousandths of a px, so that sums are exact; null where the frame's displacement is null or not
    finite. Frames sent again count once (the least values where they differ); frames come in the order of frame_id, whenever they arrived.
    """
    d = F.col("displacement")
    milli = F.when(d.isNotNull() & ~F.isnan(d) & (F.abs(d) < float("inf")), F.round(d * 1000).cast("long"))
    f = frames.where(F.col("stream").isNotNull() & F.col("frame_id").isNotNull()).groupBy("stream", F.col("frame_id").alias("seq")).agg(F.min(milli).alias("_d"), F.min("n_features").alias("n_features"))
    so_far = F.sum("_d").over(Window.partitionBy("stream").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0))
    return f.select("stream", "seq", F.when(F.col("_d").isNotNull(), so_far).cast("double").alias("value"), "n_features", F.lit(None).cast("string").alias("control"))


def select_keyframes(frames: DataFrame, threshold: float = THRESHOLD, batch_size: int = BATCH) -> DataFrame:
    """frames: stream, seq, value, n_features, control. One row out for each row in.

    Partitions are sorted by (stream, seq) and read once with constant memory, so a long stream needs no memory, though
    the recurrence on the last anchor keeps one stream's frames in one task. Rows without stream or seq are left out.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, tracker = None, Tracker()
        for b in batches:
            rows = []
            for stream, seq, value, features, control in b.itertuples(index=False, name=None):
                if stream != now:
                    now, tracker = stream, Tracker()
                rows.append(tracker.row(stream, seq, value, features, control, threshold, batch_size))
            yield _frame(rows)

    f = frames.where(F.col("stream").isNotNull() & F.col("seq").isNotNull()).select("stream", "seq", "value", "n_features", "control")
    return f.repartition("stream").sortWithinPartitions("stream", "seq").mapInPandas(run, OUT)


def stream_keyframes(frames: DataFrame, threshold: float = THRESHOLD, batch_size: int = BATCH) -> DataFrame:
    """The same over a streaming table: state per stream, rows of a micro-batch in seq order, exactly once with a checkpointed sink."""

    def run(key, pdfs, state):
        t = Tracker(*state.get) if state.exists else Tracker()
        rows = []
        for stream, seq, value, features, control in pd.concat(list(pdfs)).sort_values("seq", kind="stable")[["stream", "seq", "value", "n_features", "control"]].itertuples(index=False, name=None):
            rows.append(t.row(stream, seq, value, features, control, threshold, batch_size))
        state.update((t.anchor, t.anchored, t.active, t.batch, t.open, t.received, t.kept))
        yield _frame(rows)

    return frames.select("stream", "seq", "value", "n_features", "control").groupBy("stream").applyInPandasWithState(run, OUT, STATE, "append", "NoTimeout")


def tumbling_batches(kept: DataFrame, size: int = BATCH) -> DataFrame:
    """Batch and position of kept frames (stream, seq) by count: floor((row - 1) / size)."""
    n = F.row_number().over(Window.partitionBy("stream").orderBy("seq")) - 1
    return kept.withColumn("_n", n).withColumn("batch", F.floor(F.col("_n") / size)).withColumn("position", (F.col("_n") % size).cast("long")).drop("_n")


def batch_status(selected: DataFrame, size: int = BATCH) -> DataFrame:
    """Per stream: frames received and kept, batches closed, frames collected in the open batch, capacity, and the latest closed batch (null before the first)."""
    s = selected.groupBy("stream").agg(F.count_if(~F.col("control")).alias("received"), F.count_if("kept").alias("kept"), F.count_if("flushed").alias("closed"), F.max_by("open", "seq").alias("collected"), F.max(F.when(F.col("flushed"), F.col("batch"))).alias("latest"))
    return s.withColumn("capacity", F.lit(size))


def closed_batches(selected: DataFrame) -> DataFrame:
    """Kept frames of batches that were closed; what a worker is handed."""
    done = selected.where("flushed").select("stream", "batch").distinct()
    return selected.where("kept").join(done, ["stream", "batch"], "left_semi")


def replies(selected: DataFrame) -> DataFrame:
    """The reply to each frame: 1 kept, 0 skipped, with running counts of kept and received frames."""
    w = Window.partitionBy("stream").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    return selected.where(~F.col("control")).select("stream", "seq", F.when(F.col("kept"), 1.0).otherwise(0.0).alias("status"), F.sum(F.col("kept").cast("int")).over(w).alias("kept_so_far"), F.count(F.lit(1)).over(w).alias("received"))


def batch_index(kept: DataFrame, moved: str | None = None) -> DataFrame:
    """File names of a batch's frames (stream, batch, position): name, and place, the frame's place in the batch's list.

    moved names a boolean column: a frame whose file could not be moved keeps its number, so names skip it, but the list closes up.
    """
    x = kept if moved is None else kept.where(F.coalesce(F.col(moved), F.lit(False)))
    place = F.row_number().over(Window.partitionBy("stream", "batch").orderBy("position")) - 1
    return x.withColumn("place", place.cast("long")).withColumn("name", F.format_string("frame_%06d.jpg", F.col("position").cast("long")))


def start(selected: DataFrame, handle, checkpoint: str, **trigger):
    """Hands each micro-batch's closed batches to handle(df, id); an error of one is the handler's to return, the stream goes on."""
    return selected.writeStream.outputMode("append").option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).foreachBatch(handle).start()


def drain(selected: DataFrame) -> DataFrame:
    """All rows that the source holds now, once the stream has taken them in, however long that is; a stream that fails raises.

    They are written by the executors to a Parquet table in the checkpoint folder, so nothing is gathered on the driver.
    """
    spark = selected.sparkSession
    ensure_checkpoint_dir(spark)
    at = f"{spark.sparkContext.getCheckpointDir()}/drained-{uuid.uuid4().hex}"
    out = f"{at}/rows"
    spark.createDataFrame([], selected.schema).write.parquet(out)  # a source without rows writes none
    selected.writeStream.outputMode("append").format("parquet").option("path", out).option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(selected.schema).parquet(out)
