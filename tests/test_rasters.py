"""Turned rasters in tiles: only tiles that points need are read."""

import numpy as np
from pyspark.sql import functions as F

from rillwise.operators import raster as r
from rillwise.plans.registry import BROADCAST
from rillwise.sources import readers
from rillwise.store import settings


def test_only_needed_tiles_are_read(spark, tmp_path):
    turn = 0.4
    grid = (7, 100.0, 2 * np.cos(turn), -3 * np.sin(turn), 50.0, 2 * np.sin(turn), 3 * np.cos(turn), 40, 60, 8)
    rasters = spark.createDataFrame([tuple(float(v) if 0 < i < 7 else int(v) for i, v in enumerate(grid))], r.RASTERS)
    pixels = spark.range(40 * 60).select(F.lit(7).cast("long").alias("raster_id"), F.floor(F.col("id") / 60).alias("row"), (F.col("id") % 60).alias("col"), F.when(F.col("id") % 11 > 0, F.col("id").cast("double")).alias("z"))
    readers.write_raster(pixels, rasters, str(tmp_path / "r"))
    tiles, known = readers.read_raster(spark, str(tmp_path / "r"))
    at = lambda row, col: (grid[1] + grid[2] * (col + 0.5) + grid[3] * (row + 0.5), grid[4] + grid[5] * (col + 0.5) + grid[6] * (row + 0.5))
    asked = [(3, 5), (4, 6), (3, 7), (39, 59)]
    points = spark.createDataFrame([(i, *map(float, at(*p))) for i, p in enumerate(asked)] + [(9, -500.0, 0.0), (10, None, 1.0)], "point_id int, x double, y double")
    found = r.sample_tiles(points, tiles, known)
    before = found._jdf.queryExecution().executedPlan().toString()
    assert before.count("SubqueryAdaptiveBroadcast dynamicpruning") == 3  # raster, row and column of tiles reach the scan
    got = {x.point_id: (x.row, x.col, x.z) for x in found.collect()}
    assert got == {i: (*p, float(p[0] * 60 + p[1]) if (p[0] * 60 + p[1]) % 11 else None) for i, p in enumerate(asked)}
    assert r.tile_catalogue(pixels, rasters).count() == 5 * 8


def test_pixels_narrow_towards_the_pole(spark):
    dx, dy = r.pixel_metres(F.col("row"), 0.0, 1.0, 1.0)
    got = spark.range(0, 80, 20).withColumnRenamed("id", "row").select(dx, dy).collect()
    assert [round(x[0] / 1000) for x in got] == [111, 104, 85, 55] and got[0][1] < got[3][1]


def test_tiles_share_folders_and_only_needed_ones_are_opened(spark, tmp_path):
    rasters = spark.createDataFrame([(7, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0, 40, 3000, 8)], r.RASTERS)
    pixels = spark.range(40 * 3000).select(F.lit(7).cast("long").alias("raster_id"), F.floor(F.col("id") / 3000).alias("row"), (F.col("id") % 3000).alias("col"), F.col("id").cast("double").alias("z"))
    with settings(spark, BROADCAST):
        readers.write_raster(pixels, rasters, str(tmp_path / "r"))
        tiles, known = readers.read_raster(spark, str(tmp_path / "r"))
        files = sorted((tmp_path / "r" / "pixels").glob("*/*/*/*.parquet"))
        assert len(files) == 3  # of 1,875 tiles
        found = r.sample_tiles(spark.createDataFrame([(1, 5.5, 3.5), (2, 900.5, 39.5)], "point_id int, x double, y double"), tiles, known)
        for f in files:
            if "block_col=0" not in str(f):
                f.write_bytes(b"not opened")
                f.with_name(f".{f.name}.crc").unlink(missing_ok=True)
        assert {x.point_id: (x.row, x.col, x.z) for x in found.collect()} == {1: (3, 5, 9005.0), 2: (39, 900, 117900.0)}
