"""Rasters as pixel tables (row, col, z; null: no data)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from rillwise.functions.geo import geodesic_m
from rillwise.operators.graph import connected_components
from rillwise.operators.quantiles import percentiles
from rillwise.store import saved


#: Metadata of a raster: place of pixel (row, col) = (x0 + ax * col + bx * row, y0 + ay * col + by * row), its size, and the edge of its tiles.
RASTERS = "raster_id long, x0 double, ax double, bx double, y0 double, ay double, by double, n_rows long, n_cols long, tile int"


def pixel_of(x: Column, y: Column, x0: float, y0: float, dx: float, dy: float) -> tuple[Column, Column]:
    """Row and column that hold a place, for an affine grid without rotation whose corner is (x0, y0)."""
    return F.floor((y - y0) / dy).cast("long"), F.floor((x - x0) / dx).cast("long")


def affine_pixel(x: Column, y: Column) -> tuple[Column, Column]:
    """Row and column that hold a place on a grid with the columns of RASTERS, which may be turned or skewed."""
    u, v = x - F.col("x0"), y - F.col("y0")
    det = F.col("ax") * F.col("by") - F.col("bx") * F.col("ay")
    return F.floor((F.col("ax") * v - F.col("ay") * u) / det).cast("long"), F.floor((F.col("by") * u - F.col("bx") * v) / det).cast("long")


def tile_catalogue(pixels: DataFrame, rasters: DataFrame) -> DataFrame:
    """(raster_id, tile_row, tile_col, pixels, known, xmin, ymin, xmax, ymax) of every tile that pixels (raster_id, row, col, z) fill."""
    placed = pixels.join(F.broadcast(rasters), "raster_id")  # a row a raster
    x, y = F.col("x0") + F.col("ax") * F.col("c") + F.col("bx") * F.col("r"), F.col("y0") + F.col("ay") * F.col("c") + F.col("by") * F.col("r")
    tiles = placed.groupBy("raster_id", F.floor(F.col("row") / F.col("tile")).alias("tile_row"), F.floor(F.col("col") / F.col("tile")).alias("tile_col")).agg(
        F.count("*").alias("pixels"), F.count("z").alias("known"), F.min("row").alias("r0"), F.max("row").alias("r1"), F.min("col").alias("c0"), F.max("col").alias("c1"), F.first(F.struct(*rasters.columns)).alias("g")
    )
    corners = F.explode(F.array(*[F.struct(F.col(r).alias("r"), F.col(c).alias("c")) for r in ("r0", "r2") for c in ("c0", "c2")])).alias("k")
    at = tiles.withColumn("r2", F.col("r1") + 1).withColumn("c2", F.col("c1") + 1).select("raster_id", "tile_row", "tile_col", "pixels", "known", *[F.col(f"g.{c}").alias(c) for c in rasters.columns if c != "raster_id"], corners)
    at = at.select("raster_id", "tile_row", "tile_col", "pixels", "known", *[c for c in rasters.columns if c != "raster_id"], "k.r", "k.c")
    return at.groupBy("raster_id", "tile_row", "tile_col", "pixels", "known").agg(F.min(x).alias("xmin"), F.min(y).alias("ymin"), F.max(x).alias("xmax"), F.max(y).alias("ymax"))


#: Pixels of a folder's side, unless one tile is larger: a folder for each tile would be as many files as there are tiles.
SIDE = 1024
#: Tiles up to which they go to the scan.
TILES_SENT = 50_000


def tile_places() -> list[Column]:
    """Tile and block (the square of tiles that a folder holds) of a pixel, from row, col and the raster's tile."""
    tile = lambda c: F.floor(F.col(c) / F.col("tile"))
    a_side = F.greatest(F.lit(1), F.floor(SIDE / F.col("tile")))
    return [*[tile(c).cast("int").alias(f"tile_{c}") for c in ("row", "col")], *[F.floor(tile(c) / a_side).cast("int").alias(f"block_{c}") for c in ("row", "col")]]


def sample_tiles(points: DataFrame, pixels: DataFrame, rasters: DataFrame) -> DataFrame:
    """(point_id, raster_id, row, col, z) of the pixels that hold points (point_id, x, y): a row for each raster whose grid a point lies in, z null without data.

    The tiles that points need are known before pixels are read: up to TILES_SENT they go to the scan, which opens no other
    block's files and passes no other tile's pixels. pixels: as readers.read_raster gives them, parted by raster_id, block_row and block_col.
    """
    row, col = affine_pixel(F.col("x"), F.col("y"))
    placed = points.select("point_id", "x", "y").crossJoin(F.broadcast(rasters)).withColumn("row", row).withColumn("col", col)  # a row a raster
    placed = placed.filter((F.col("row") >= 0) & (F.col("row") < F.col("n_rows")) & (F.col("col") >= 0) & (F.col("col") < F.col("n_cols")))
    placed = placed.select("point_id", "raster_id", "row", "col", *tile_places())
    keys = ["raster_id", "tile_row", "tile_col", "block_row", "block_col"]
    needed = saved(placed.select(*keys).distinct(), "tiles").filter("tile_row >= 0 and tile_col >= 0")
    read = pixels.join(F.broadcast(needed) if needed.count() <= TILES_SENT else needed, keys, "left_semi").select("raster_id", "row", "col", "z")
    return placed.select("point_id", "raster_id", "row", "col").join(read, ["raster_id", "row", "col"], "left")


def sample_raster(points: DataFrame, raster: DataFrame) -> DataFrame:
    """points (row, col) with z; null outside and where there is no data."""
    return points.join(raster.select("row", "col", "z"), ["row", "col"], "left")


def pixel_metres(row: Column, lat0: float, dlat: float, dlon: float) -> tuple[Column, Column]:
    """Width and height in metres, on the ellipsoid, of the pixels of a row of a grid in degrees: at the latitude of the row's middle."""
    lat, zero = lat0 + (row + 0.5) * dlat, F.lit(0.0)
    return geodesic_m(lat, zero, lat, F.lit(abs(dlon))), geodesic_m(lat - dlat / 2, zero, lat + dlat / 2, zero)


def horn_slope(raster: DataFrame, dx_m: float | Column, dy_m: float | Column) -> DataFrame:
    """(row, col, slope in percent) by Horn's 3x3 window; null unless all nine pixels have data. Each pixel goes to its nine windows.

    dx_m, dy_m: metres of a pixel, as numbers or as columns of row and col (see pixel_metres).
    """
    weight = lambda i, j: (float(j * (2 if i == 0 else 1)), float(i * (2 if j == 0 else 1)))
    places = [(i, j, *weight(i, j)) for i in (-1, 0, 1) for j in (-1, 0, 1)]
    spread = F.explode(F.array(*[F.struct((F.col("row") - i).alias("row"), (F.col("col") - j).alias("col"), F.lit(wx).alias("wx"), F.lit(wy).alias("wy"), F.lit(i == 0 and j == 0).alias("own")) for i, j, wx, wy in places])).alias("w")
    sums = raster.select(spread, "z").select("w.*", "z").groupBy("row", "col").agg(F.sum(F.col("wx") * F.col("z")).alias("gx"), F.sum(F.col("wy") * F.col("z")).alias("gy"), F.count("z").alias("n"), F.max("own").alias("own"))
    slope = F.sqrt(F.pow(F.col("gx") / (8 * dx_m), 2) + F.pow(F.col("gy") / (8 * dy_m), 2)) * 100
    return sums.filter("own").select("row", "col", F.when(F.col("n") == 9, slope).alias("slope"))


def to_orthometric(points: DataFrame, geoid: DataFrame) -> DataFrame:
    """points (grow, gcol: place in the geoid grid, h: height over the ellipsoid) with height over the geoid; null where a corner is missing.

    The four corners are met by one equi join each point makes four rows for; geoid is (row, col, z).
    """
    corner = F.explode(F.array(*[F.struct((F.floor("grow") + i).alias("row"), (F.floor("gcol") + j).alias("col"), F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (0, 1) for j in (0, 1)])).alias("c")
    met = points.select("*", corner).select(*points.columns, "c.*").join(geoid.select("row", "col", F.col("z").alias("_n")), ["row", "col"], "left")
    fr, fc = F.col("grow") - F.floor("grow"), F.col("gcol") - F.floor("gcol")
    w = F.when(F.col("i") == 1, fr).otherwise(1 - fr) * F.when(F.col("j") == 1, fc).otherwise(1 - fc)
    n = met.groupBy(*points.columns).agg(F.sum(w * F.col("_n")).alias("_g"), F.count("_n").alias("_k"))
    return n.select(*points.columns, F.when(F.col("_k") == 4, F.col("h") - F.col("_g")).alias("height"))


def raster_stats(raster: DataFrame) -> DataFrame:
    """One row: pixels, share without data, least, median and largest height."""
    median, = percentiles(raster, F.col("z"), [0.5])
    return raster.agg(F.count("*").alias("pixels"), F.round(F.avg(F.col("z").isNull().cast("double")) * 100, 4).alias("nodata_pct"), F.round(F.min("z"), 4).alias("least"), F.round(F.lit(median).cast("double"), 4).alias("median"), F.round(F.max("z"), 4).alias("most"))


def pixel_regions(mask: DataFrame, pixel_area: float, least_area: float, width: int = 1 << 20) -> DataFrame:
    """(region, pixels, area) of 4-connected pixels in mask (row, col) that cover least_area; region: the least row * width + col."""
    node = F.col("row") * width + F.col("col")
    own = mask.select(node.alias("node"))
    beside = mask.select(node.alias("u"), F.explode(F.array(node + 1, node + width)).alias("v"))
    edges = beside.join(own.withColumnRenamed("node", "v"), "v", "left_semi").unionByName(own.select(F.col("node").alias("u"), F.col("node").alias("v")))
    sizes = connected_components(edges).groupBy("component").agg(F.count("*").alias("pixels"))
    return sizes.select(F.col("component").alias("region"), "pixels", (F.col("pixels") * pixel_area).alias("area")).filter(F.col("area") >= least_area)
