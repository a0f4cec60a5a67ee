"""The work on closed batches of a stream: process a map, write it, grow the site, hand its plan to the next client.

Batches arrive in order through foreachBatch, so a query with a checkpoint takes up where it stopped, and each batch's map id
follows from its stream and number, so one that runs again writes over its own rows. A map whose processing fails is left out of everything
that follows; the loop goes on. The stop sign is the end of the query: closing it lets the batch at hand finish.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from terrafold.database import Database
from terrafold.operators import planner
from terrafold.session import cut
from terrafold.sources import formats
from terrafold.sources.frames import Mailbox


@dataclass
class Worker:
    """process(frames of one batch, map id) gives the map's tables by name: points, georefs, and whatever else is to be written.

    It may raise, or give no points; then the map is skipped and `errors` has why. An empty plan, because no confidence stands out,
    discards the map as well.
    """

    db: Database
    process: Callable[[DataFrame, str], dict[str, DataFrame]]
    mailbox: Mailbox = field(default_factory=Mailbox)
    done: list[str] = field(default_factory=list)
    errors: dict[str, str] = field(default_factory=dict)

    def one(self, frames: DataFrame, map_id: str) -> bool:
        """Processes one batch; whether its map went into the site."""
        try:
            tables = self.process(frames, map_id)
            pts, georefs = tables.get("points"), tables.get("georefs")
            if pts is None or pts.isEmpty():
                raise ValueError("no points")
            views = None
            if georefs is not None:
                views, kml = self.plan(pts, georefs, map_id)
                tables = tables | {"viewpoints": views}
        except Exception as e:  # noqa: BLE001 - an error is a result here
            self.errors[map_id] = str(e) or type(e).__name__
            return False
        self.db.create_map(map_id=map_id)
        self.db.write_map(map_id, **tables)
        grown = georefs is not None and self.db.grow_site(map_id, georefs.withColumn("map_id", F.lit(map_id)))
        if views is not None and kml:
            self.mailbox.put(kml.encode())
        self.done.append(map_id)
        return grown

    def plan(self, pts: DataFrame, georefs: DataFrame, map_id: str) -> tuple[DataFrame, str | None]:
        """The next flight's viewpoints, and their KML where there are any; an error where no confidence stands out."""
        from terrafold.operators import geo, points

        placed = geo.apply_georefs(pts.withColumn("map_id", F.lit(map_id)), georefs.withColumn("map_id", F.lit(map_id)))
        placed = cut(placed.withColumns({"x": F.col("e"), "y": F.col("n"), "z": F.col("u")}))
        if points.confidence_band(placed, "map_id", planner.LOW, planner.HIGH, planner.LEAST).isEmpty():
            raise ValueError("confidence is too even for a plan")
        views = cut(planner.viewpoints(planner.cells(placed, "map_id"), "map_id"))
        views = planner.waypoints(views, georefs.select(F.lit(map_id).alias("map_id"), "lat0", "lon0", F.coalesce("alt0", F.lit(0.0)).alias("alt0")), "map_id")
        kml = formats.plan_kml(views, "map_id", "rank").first()
        return views.drop("map_id"), kml["kml"] if kml else None

    def handle(self, closed: DataFrame, _: int | None = None) -> None:
        """A foreachBatch handler for the output of `stream_keyframes`, which marks the frame that closes a batch, joined with the frames' own columns.

        Kept frames wait in the table `kept` until their batch closes; then they are processed, by stream and batch number.
        """
        spark = closed.sparkSession
        closed.where("kept OR flushed").write.mode("append").parquet(f"{self.db.path}/kept")
        kept = spark.read.schema(closed.schema).parquet(f"{self.db.path}/kept")
        w = Window.partitionBy("stream", "batch")
        ready = closed.where("flushed").select("stream", "batch").distinct().orderBy("stream", "batch").collect()  # batches that closed just now
        for b in ready:
            frames = kept.where((F.col("stream") == b["stream"]) & (F.col("batch") == b["batch"]) & F.col("kept")).dropDuplicates(["stream", "seq"])
            self.one(frames.withColumn("n", F.count(F.lit(1)).over(w)), f"map_{b['stream']}_{b['batch']:06d}")
