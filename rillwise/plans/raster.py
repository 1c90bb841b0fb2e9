"""Raster queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from rillwise.operators import raster as r
from rillwise.plans.adapters import adapted, adapters_sql
from rillwise.plans.places import lambert
from rillwise.plans.registry import query
from rillwise.sources import readers
from rillwise.store import scratch

RASTER = adapters_sql("raster")


@query("J6_sample_raster", f"WITH {adapters_sql('pts', 'raster')}, q AS (SELECT point_id, CAST(floor((lat - 22.4) / 0.0007) AS BIGINT) AS row, CAST(floor((lon - 88.2) / 0.005) AS BIGINT) AS col FROM pts) SELECT point_id, q.row, q.col, round(z, 4) AS z FROM q LEFT JOIN raster USING (row, col)")
def sample(spark, sf_dir):
    p = adapted(spark, sf_dir, "pts")
    row, col = r.pixel_of(F.col("lon"), F.col("lat"), 88.2, 22.4, 0.005, 0.0007)
    return r.sample_raster(p.select("point_id", row.alias("row"), col.alias("col")), adapted(spark, sf_dir, "raster")).select("point_id", "row", "col", F.round("z", 4).alias("z"))


LAT0, DLAT, DLON = 22.4, 0.0007, 0.005
MIDDLE = f"({LAT0} + (row + 0.5) * {DLAT})"


@query("J7_horn_slope", f"""WITH {RASTER}, w AS (SELECT c.row, c.col, sum(n.z * (n.col - c.col) * CASE WHEN n.row = c.row THEN 2 ELSE 1 END) AS gx, sum(n.z * (n.row - c.row) * CASE WHEN n.col = c.col THEN 2 ELSE 1 END) AS gy, count(n.z) AS k
FROM raster c JOIN raster n ON n.row BETWEEN c.row - 1 AND c.row + 1 AND n.col BETWEEN c.col - 1 AND c.col + 1 GROUP BY 1, 2),
m AS (SELECT row, {lambert(MIDDLE, '0.0', MIDDLE, str(DLON))} AS dx, {lambert(f'({MIDDLE} - {DLAT / 2})', '0.0', f'({MIDDLE} + {DLAT / 2})', '0.0')} AS dy FROM (SELECT DISTINCT row FROM raster))
SELECT row, col, round(CASE WHEN k = 9 THEN sqrt((gx / 8 / dx) ** 2 + (gy / 8 / dy) ** 2) * 100 END + 1e-9, 3) AS slope FROM w JOIN m USING (row)""")
def slope(spark, sf_dir):
    """Slopes of a grid in degrees: the metres of a pixel depend on its row's latitude."""
    return r.horn_slope(adapted(spark, sf_dir, "raster"), *r.pixel_metres(F.col("row"), LAT0, DLAT, DLON)).select("row", "col", F.round(F.col("slope") + 1e-9, 3).alias("slope"))


#: Two rasters of the same pixels: one turned by some 31 degrees and skewed, and one that holds the city's north-east only.
RASTERS = ((1, 88.25, 0.0042, -0.0002, 22.38, 0.0025, 0.0006, 500, 64, 50), (2, 88.40, 0.0023, 0.0, 22.60, 0.0, 0.0003, 500, 64, 16))
GRIDS = ", ".join(str(g) for g in RASTERS)


def two_rasters(spark, sf_dir):
    """Pixels and metadata."""
    pixels = adapted(spark, sf_dir, "raster").withColumn("raster_id", F.explode(F.array(*[F.lit(g[0]).cast("long") for g in RASTERS])))
    return pixels, spark.createDataFrame(RASTERS, r.RASTERS)


@query("S6_J6_sample_tiles", f"""WITH {adapters_sql('pts', 'raster')}, g AS (SELECT * FROM (VALUES {GRIDS}) v(raster_id, x0, ax, bx, y0, ay, "by", n_rows, n_cols, tile)),
q AS (SELECT point_id, raster_id, n_rows, n_cols, CAST(floor((ax * (lat - y0) - ay * (lon - x0)) / (ax * "by" - bx * ay)) AS BIGINT) AS row, CAST(floor(("by" * (lon - x0) - bx * (lat - y0)) / (ax * "by" - bx * ay)) AS BIGINT) AS col FROM pts, g)
SELECT point_id, raster_id, q.row, q.col, round(z, 4) AS z FROM q LEFT JOIN raster USING (row, col) WHERE q.row BETWEEN 0 AND n_rows - 1 AND q.col BETWEEN 0 AND n_cols - 1""")
def sample_tiles(spark, sf_dir):
    """Pixels under all points from two rasters that lie on disk as tiles."""
    path, (pixels, grids) = scratch(spark, "rasters"), two_rasters(spark, sf_dir)
    readers.write_raster(pixels, grids, path)
    tiles, known = readers.read_raster(spark, path)
    found = r.sample_tiles(adapted(spark, sf_dir, "pts").select("point_id", F.col("lon").alias("x"), F.col("lat").alias("y")), tiles, known)
    return found.select("point_id", "raster_id", "row", "col", F.round("z", 4).alias("z"))


@query("S6_tile_catalogue", f"""WITH {RASTER}, g AS (SELECT * FROM (VALUES {GRIDS}) v(raster_id, x0, ax, bx, y0, ay, "by", n_rows, n_cols, tile)),
t AS (SELECT raster_id, row // tile AS tile_row, col // tile AS tile_col, count(*) AS pixels, count(z) AS known, min(row) AS r0, max(row) + 1 AS r1, min(col) AS c0, max(col) + 1 AS c1, any_value(g) AS g FROM raster, g GROUP BY 1, 2, 3),
k AS (SELECT raster_id, tile_row, tile_col, pixels, known, g.x0 + g.ax * unnest([c0, c0, c1, c1]) + g.bx * unnest([r0, r1, r0, r1]) AS x, g.y0 + g.ay * unnest([c0, c0, c1, c1]) + g."by" * unnest([r0, r1, r0, r1]) AS y FROM t)
SELECT raster_id, tile_row, tile_col, pixels, known, round(min(x), 6) AS xmin, round(min(y), 6) AS ymin, round(max(x), 6) AS xmax, round(max(y), 6) AS ymax FROM k GROUP BY 1, 2, 3, 4, 5""")
def catalogue(spark, sf_dir):
    """What each tile of both rasters holds, and its bounds."""
    pixels, grids = two_rasters(spark, sf_dir)
    t = r.tile_catalogue(pixels, grids)
    return t.select("raster_id", "tile_row", "tile_col", "pixels", "known", *[F.round(c, 6).alias(c) for c in ("xmin", "ymin", "xmax", "ymax")])


@query("J8_to_orthometric", f"""WITH {adapters_sql('pts', 'raster')}, q AS (SELECT point_id, (lat - 22.4) / 0.0007 AS a, (lon - 88.2) / 0.005 AS b, 50.0e0 AS h FROM pts), f AS (SELECT *, floor(a) AS fa, floor(b) AS fb FROM q),
g AS (SELECT point_id, h, sum(z * CASE WHEN row = fa THEN 1 - (a - fa) ELSE a - fa END * CASE WHEN col = fb THEN 1 - (b - fb) ELSE b - fb END) AS n, count(z) AS k FROM f LEFT JOIN raster ON row IN (fa, fa + 1) AND col IN (fb, fb + 1) GROUP BY 1, 2)
SELECT point_id, round(CASE WHEN k = 4 THEN h - n END + 1e-9, 4) AS height FROM g""")
def orthometric(spark, sf_dir):
    p = adapted(spark, sf_dir, "pts").select("point_id", ((F.col("lat") - 22.4) / 0.0007).alias("grow"), ((F.col("lon") - 88.2) / 0.005).alias("gcol"), F.lit(50.0).alias("h"))
    return r.to_orthometric(p, adapted(spark, sf_dir, "raster")).select("point_id", F.round(F.col("height") + 1e-9, 4).alias("height"))


@query("A31_raster_stats", f"WITH {RASTER} SELECT count(*) AS pixels, round(100.0 * count(*) FILTER (z IS NULL) / count(*), 4) AS nodata_pct, round(min(z), 4) AS least, round(quantile_cont(z, .5), 4) AS median, round(max(z), 4) AS most FROM raster")
def stats(spark, sf_dir):
    return r.raster_stats(adapted(spark, sf_dir, "raster"))


@query("A32_pixel_regions", f"""WITH RECURSIVE {RASTER}, m AS (SELECT row * 1048576 + col AS node FROM raster WHERE z > 2 AND row < 1000000), e AS (SELECT a.node AS u, b.node AS v FROM m a JOIN m b ON b.node IN (a.node + 1, a.node - 1, a.node + 1048576, a.node - 1048576)),
w AS (SELECT node, node AS root FROM m UNION SELECT e.v, w.root FROM w JOIN e ON e.u = w.node WHERE w.root < e.v), l AS (SELECT node, min(root) AS region FROM w GROUP BY 1)
SELECT region, count(*) AS pixels, count(*) * 10.0 AS area FROM l GROUP BY 1 HAVING count(*) * 10.0 >= 25""")
def regions(spark, sf_dir):
    return r.pixel_regions(adapted(spark, sf_dir, "raster").filter("z > 2"), 10.0, 25.0)
