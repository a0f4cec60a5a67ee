"""Maps and the site as tables in a folder: the catalogue, the fold that grows the site, deletion, segmentation targets.

Each map's rows are a partition (map_id=...) of its tables, so reading or deleting one map touches its files only. The
site grows map by map, as its fold demands, in tiles of whole voxels: a map reads and rewrites the tiles that its points touch, and
no others; readers see the newest finished list of tiles.
"""

from __future__ import annotations

import uuid
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrafold.operators import geo, points, segments, voxel
from terrafold.session import cut, delete_folder, list_folder

MAPS = "map_id string, created timestamp_ntz, deleted boolean, version long"
SITE_MAPS = "source long, map_id string"
TILES = "tile string, folder string"
SITE = "ord long, x double, y double, z double, r int, g int, b int, conf double, source long"


class Database:
    """Catalogue of maps and one site under `path` (a folder every executor can reach)."""

    def __init__(self, spark: SparkSession, path: str, voxel_size: float = voxel.VOXEL, percentile: float = 10.0, tile: int = 1024):
        """tile: side of a site's tile in voxels; a site without voxels is one tile."""
        self.spark, self.path, self.voxel_size, self.percentile, self.tile = spark, path.rstrip("/"), voxel_size, percentile, tile

    def _exists(self, name: str) -> bool:
        return bool(list_folder(self.spark, f"{self.path}/{name}"))

    def _read(self, name: str, schema: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(f"{self.path}/{name}") if self._exists(name) else self.spark.createDataFrame([], schema)

    def create_map(self, now: datetime | None = None, map_id: str | None = None) -> str:
        """Registers a new map; ids are map_ and the time to the microsecond, unless one is given. Registering one again changes nothing."""
        now = now or datetime.now()  # noqa: DTZ005 - local, naive, as ids are
        map_id = map_id or now.strftime("map_%Y%m%d_%H%M%S_%f")
        self.spark.createDataFrame([(map_id, now, False, 0)], MAPS).coalesce(1).write.mode("append").parquet(f"{self.path}/maps")
        return map_id

    def maps(self) -> DataFrame:
        """Maps newest first."""
        m = self._read("maps", MAPS).groupBy("map_id").agg(F.min("created").alias("created"), F.max("deleted").alias("deleted"))
        return m.where(~F.col("deleted")).select("map_id", "created").orderBy(F.desc("map_id"))

    def get_map(self, map_id: str, table: str = "points") -> DataFrame:
        """A map's rows of a table; KeyError for an unknown map."""
        if self.maps().where(F.col("map_id") == map_id).isEmpty():
            raise KeyError(map_id)
        return self.spark.read.parquet(f"{self.path}/{table}").where(F.col("map_id") == map_id)

    def write_map(self, map_id: str, **tables: DataFrame) -> None:
        """Writes whichever tables the map has (points, cameras, georefs, viewpoints, ...), replacing the map's own rows only."""
        for name, df in tables.items():
            df.withColumn("map_id", F.lit(map_id)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("map_id").parquet(f"{self.path}/{name}")

    def _versions(self, name: str) -> list[str]:
        return [v for v in list_folder(self.spark, f"{self.path}/{name}") if "_SUCCESS" in list_folder(self.spark, f"{self.path}/{name}/{v}")]

    def _write_version(self, name: str, df: DataFrame) -> None:
        """A new version beside the old ones, then the old ones go; a lost job leaves the last version readable."""
        old = self._versions(name)
        n = int(old[-1].split("-")[0]) + 1 if old else 0
        df.write.parquet(f"{self.path}/{name}/{n:08d}-{uuid.uuid4().hex[:8]}")
        for v in old:
            delete_folder(self.spark, f"{self.path}/{name}/{v}")

    def _latest(self, name: str, schema: str) -> DataFrame:
        v = self._versions(name)
        return self._read(f"{name}/{v[-1]}" if v else f"{name}/none", schema)

    def _tile_of(self, x: str = "x", y: str = "y"):  # noqa: ANN202
        side = self.voxel_size * self.tile
        return F.concat_ws("_", F.floor(F.col(x) / side).cast("string"), F.floor(F.col(y) / side).cast("string")) if side > 0 else F.lit("0_0")

    def _tiles(self) -> dict[str, list[str]]:
        """Folders that hold each tile's rows now: a row a tile and folder, by the newest finished list."""
        out: dict[str, list[str]] = {}
        for r in self._latest("site_tiles", TILES).orderBy("tile", "folder").collect():
            out.setdefault(r["tile"], []).append(r["folder"])
        return out

    def _read_tiles(self, tiles: dict[str, list[str]]) -> DataFrame:
        paths = [f"{self.path}/site/{f}/tile={t}" for t, folders in tiles.items() for f in folders]
        return self.spark.read.schema(SITE).parquet(*paths) if paths else self.spark.createDataFrame([], SITE)

    def site(self) -> DataFrame:
        return self._read_tiles(self._tiles())

    def _replace_tiles(self, rows: DataFrame, replaced: set[str]) -> None:
        """Rows in place of the tiles `replaced`; a row that rounding moved beyond them is added to its tile. The list of tiles is written last, so readers see all or nothing."""
        tiles, folder = self._tiles(), uuid.uuid4().hex
        rows.withColumn("tile", self._tile_of()).repartition("tile").write.partitionBy("tile").parquet(f"{self.path}/site/{folder}")
        fresh = [n[5:] for n in list_folder(self.spark, f"{self.path}/site/{folder}") if n.startswith("tile=")]
        gone = [(t, f) for t in replaced for f in tiles.get(t, [])]
        kept = {t: f for t, f in tiles.items() if t not in replaced}
        for t in fresh:
            kept.setdefault(t, []).append(folder)
        self._write_version("site_tiles", self.spark.createDataFrame([(t, f) for t, folders in kept.items() for f in folders], TILES))
        for t, f in gone:
            delete_folder(self.spark, f"{self.path}/site/{f}/tile={t}")

    def site_maps(self) -> DataFrame:
        """Maps of the site by source; ids no longer in the catalogue are left out without renumbering."""
        return self._latest("site_maps", SITE_MAPS).join(self.maps().select("map_id"), "map_id", "left_semi").select("source", "map_id")

    def grow_site(self, map_id: str, georef: DataFrame, origin: tuple[float, float, float] | None = None, planned: bool = True) -> bool:
        """Merges a map's confident points into the site. False, and no change, without points, georeference or a finished plan."""
        pts = self.get_map(map_id)
        g = georef.where(F.col("map_id") == map_id).limit(1)
        if not planned or pts.isEmpty() or g.isEmpty():
            return False
        maps = self._latest("site_maps", SITE_MAPS).orderBy("source").collect()  # a catalogue row a map
        if origin is None:
            first = maps[0]["map_id"] if maps else map_id
            o = georef.where(F.col("map_id") == first).select("lat0", "lon0", "alt0").first()
            origin = (o["lat0"], o["lon0"], o["alt0"])
        placed = geo.apply_georefs(points.confidence_mask(pts, "map_id", self.percentile), g)
        target = tuple(F.lit(v).cast("double") for v in origin)
        moved = geo.rebase_enu(placed, ("e", "n", "u"), (F.col("lat0"), F.col("lon0"), F.col("alt0")), target, ("x", "y", "z"))
        new = moved.withColumn("source", F.lit(len(maps)).cast("long"))
        new = cut(new.select(*voxel.SITE))
        touched = {r["t"] for r in new.where(points.finite_xyz()).select(self._tile_of().alias("t")).distinct().collect()}  # the tiles of one map
        here = {t: f for t, f in self._tiles().items() if t in touched}
        self._replace_tiles(voxel.grow(self._read_tiles(here), new, self.voxel_size), touched)
        self._write_version("site_maps", self.spark.createDataFrame([(r["source"], r["map_id"]) for r in maps] + [(len(maps), map_id)], SITE_MAPS))
        return True

    def drop_from_site(self, map_id: str) -> None:
        """Removes the cells credited to a map, renumbers later maps and clears all targets; the origin stays."""
        maps = self._latest("site_maps", SITE_MAPS).orderBy("source").collect()
        at = next((r["source"] for r in maps if r["map_id"] == map_id), None)
        if at is None:
            return
        self._replace_tiles(cut(voxel.drop_source(self.site(), at)), set(self._tiles()))
        rest = [(r["source"] - (r["source"] > at), r["map_id"]) for r in maps if r["source"] != at]
        self._write_version("site_maps", self.spark.createDataFrame(rest, SITE_MAPS))
        self.clear_segments()

    def del_map(self, map_id: str) -> None:
        """Takes the map out of the site and the catalogue and deletes its partitions."""
        self.drop_from_site(map_id)
        self.spark.createDataFrame([(map_id, None, True, 1)], MAPS).coalesce(1).write.mode("append").parquet(f"{self.path}/maps")
        for name in list_folder(self.spark, self.path):
            delete_folder(self.spark, f"{self.path}/{name}/map_id={map_id}")

    def del_site(self) -> None:
        for name in ("site_tiles", "site", "site_maps", "segments"):
            delete_folder(self.spark, f"{self.path}/{name}")

    def segments(self) -> DataFrame:
        return self._latest("segments", "query string, pos long, ord long, x double, y double, z double, red int, green int, blue int")

    def put_segment(self, query: str, found: DataFrame) -> None:
        self._write_version("segments", segments.upsert(self.segments(), query, found))

    def clear_segments(self) -> int:
        """Removes all targets; returns how many there were."""
        n = self.segments().select("query").distinct().count()
        delete_folder(self.spark, f"{self.path}/segments")
        return n

    def stats(self) -> dict[str, int]:
        return {"maps": self.maps().count(), "site_points": self.site().count(), "site_maps": self.site_maps().count(), "segments": self.segments().select("query").distinct().count()}
