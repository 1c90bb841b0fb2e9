"""Sources and sinks: GeoJSON, pocket and training CSV, rasters, feeds, control points, model descriptors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from rillwise.functions import shapes
from rillwise.operators.raster import tile_places

FEATURE = "geometry struct<type:string,coordinates:string>, properties map<string,string>"
GEOJSON = f"features array<struct<{FEATURE.replace(' struct', ':struct').replace(' map', ':map')}>>, crs struct<properties:struct<name:string>>"
POCKETS = ("location_name", "ward", "latitude", "longitude", "source", "year", "severity", "notes")


def read_geojson(spark: SparkSession, path: str, layer: str, lines: bool = False) -> DataFrame:
    """layer, geom_type, parts (parts of rings of x, y), coords (all vertices in order), properties of each feature; missing geometry stays null.

    Files hold a FeatureCollection each, which one task reads; with lines each line is a Feature, so that files can be split.
    """
    if lines:
        f = spark.read.schema(FEATURE).json(path).select(F.struct("geometry", "properties").alias("f"))
    else:
        f = spark.read.schema(GEOJSON).option("multiLine", True).json(path).select(F.explode("features").alias("f"))
    kind = F.col("f.geometry.type")
    shaped = f.select(F.lit(layer).alias("layer"), kind.alias("geom_type"), shapes.parts_of(kind, F.col("f.geometry.coordinates")).alias("parts"), F.col("f.properties").alias("properties"))
    return shaped.select("layer", "geom_type", "parts", shapes.vertices(F.col("parts")).alias("coords"), "properties")


def ring_edges(df: DataFrame, keys: list[str]) -> DataFrame:
    """The keys with part, ring (numbers from 0), x0, y0, x1, y1 of each edge of the column parts: what joins by distance and cover read."""
    rings = df.select(*keys, F.posexplode("parts").alias("part", "_p")).select(*keys, "part", F.posexplode("_p").alias("ring", "_r"))
    sides = rings.select(*keys, "part", "ring", F.explode(shapes.sides(F.col("_r"))).alias("_e"))
    return sides.select(*keys, "part", "ring", F.col("_e.a.x").alias("x0"), F.col("_e.a.y").alias("y0"), F.col("_e.b.x").alias("x1"), F.col("_e.b.y").alias("y1"))


def read_pockets(spark: SparkSession, path: str) -> DataFrame:
    """Pocket records of a CSV with a header; an error names required columns that are not there. Numbers that are none become null."""
    df = spark.read.option("header", True).csv(path)
    gone = [c for c in POCKETS if c not in df.columns]
    if gone:
        raise ValueError(f"missing columns: {', '.join(gone)}")
    return df.withColumns({c: F.col(c).try_cast("double") for c in ("latitude", "longitude")})


def write_training(df: DataFrame, path: str) -> None:
    """CSV with a header; null is blank."""
    df.write.mode("overwrite").option("header", True).option("nullValue", "").option("emptyValue", "").csv(path)


def read_training(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("header", True).option("nullValue", "").csv(path)


def write_raster(pixels: DataFrame, rasters: DataFrame, path: str) -> None:
    """pixels (raster_id, row, col, z) as Parquet in a folder for each block of tiles, beside the rasters' metadata (columns of operators.raster.RASTERS)."""
    folder = ["raster_id", "block_row", "block_col"]
    parted = pixels.join(F.broadcast(rasters.select("raster_id", "tile")), "raster_id").select("raster_id", "row", "col", "z", *tile_places())  # a row a raster
    parted.repartition(*folder).write.partitionBy(*folder).parquet(f"{path}/pixels")
    rasters.coalesce(1).write.parquet(f"{path}/rasters")


def read_raster(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Pixels (row, col, z, tile_row, tile_col, raster_id, block_row, block_col; parted by the last three) and the rasters' metadata of a folder that write_raster wrote."""
    pixels = spark.read.schema("row long, col long, z double, tile_row int, tile_col int, raster_id long, block_row int, block_col int").parquet(f"{path}/pixels")
    return pixels, spark.read.parquet(f"{path}/rasters")


def read_weather(spark: SparkSession, path: str, streaming: bool = False) -> DataFrame:
    """One column `record` (map of texts) for each line of JSON; of a list the first record counts, an empty list gives none."""
    lines = spark.readStream.schema("value string").text(path) if streaming else spark.read.text(path)
    one = F.from_json("value", "map<string,string>", {"mode": "PERMISSIVE"})
    many = F.from_json("value", "array<map<string,string>>", {"mode": "PERMISSIVE"})
    record = F.when(F.ltrim("value").startswith("["), F.get(many, F.lit(0))).otherwise(one)
    return lines.select(record.alias("record")).filter("record is not null")


CANDIDATES = "features array<struct<geometry:struct<coordinates:array<double>>,properties:struct<name:string,full_address:string,place_formatted:string,feature_type:string,bbox:array<double>,context:map<string,string>>>>"


def parse_candidates(df: DataFrame, body: str = "body") -> DataFrame:
    """(other columns, rank, name, address, kind, lat, lon, bbox, context) of each well-formed feature of a geocoder's answer."""
    parsed = df.withColumn("_b", F.from_json(body, CANDIDATES))
    f = parsed.select(*[c for c in df.columns if c != body], F.posexplode("_b.features").alias("rank", "f"))
    ok = f.filter(F.size("f.geometry.coordinates") >= 2)
    p = "f.properties."
    return ok.select(*[c for c in df.columns if c != body], "rank", F.col(p + "name").alias("name"), F.coalesce(F.col(p + "full_address"), F.col(p + "place_formatted"), F.col(p + "name")).alias("address"), F.col(p + "feature_type").alias("kind"), F.col("f.geometry.coordinates")[1].alias("lat"), F.col("f.geometry.coordinates")[0].alias("lon"), F.col(p + "bbox").alias("bbox"), F.map_filter(F.coalesce(F.col(p + "context"), F.create_map().cast("map<string,string>")), lambda k, v: v.isNotNull()).alias("context"))


ROUTES = "routes array<struct<distance:double,duration:double,geometry:struct<type:string,coordinates:array<array<double>>>,legs:array<struct<steps:array<struct<distance:double,duration:double,name:string,maneuver:struct<instruction:string>>>>>>>"


def parse_routes(df: DataFrame, body: str = "body") -> DataFrame:
    """(other columns, route_index, distance_m, duration_s, coordinates, steps) of a router's answer; routes that are no line of two vertices go."""
    parsed = df.withColumn("_b", F.from_json(body, ROUTES))
    r = parsed.select(*[c for c in df.columns if c != body], F.posexplode("_b.routes").alias("route_index", "r"))
    ok = r.filter((F.col("r.geometry.type") == "LineString") & (F.size("r.geometry.coordinates") >= 2))
    steps = F.transform(F.flatten(F.coalesce(F.transform("r.legs", lambda leg: leg["steps"]), F.array())), lambda s: F.struct(s["name"].alias("name"), F.round(s["distance"], 1).alias("distance"), s["maneuver"]["instruction"].alias("instruction")))
    return ok.select(*[c for c in df.columns if c != body], "route_index", F.round("r.distance", 1).alias("distance_m"), F.round("r.duration", 1).alias("duration_s"), F.col("r.geometry.coordinates").alias("coordinates"), steps.alias("steps"))


def read_gcps(lines: DataFrame) -> DataFrame:
    """(sx, sy, mx, my, crs) of control-point lines (value: mapX,mapY,sourceX,sourceY,enable): comments and disabled points go.

    Negative page heights are turned up; small map values are degrees, others metres.
    """
    v = F.split("value", ",")
    n = lambda i: F.get(v, F.lit(i)).try_cast("double")
    rows = lines.filter(~F.col("value").startswith("#")).select(n(0).alias("mx"), n(1).alias("my"), n(2).alias("sx"), F.abs(n(3)).alias("sy"), F.lower(F.trim(F.coalesce(F.get(v, F.lit(4)), F.lit("1")))).alias("on"))
    used = rows.filter("mx is not null and my is not null and sx is not null and sy is not null and on not in ('0', 'false')").drop("on")
    return used.withColumn("crs", F.when((F.abs("mx") <= 180) & (F.abs("my") <= 90), "EPSG:4326").otherwise("EPSG:32645"))


def model_descriptors(spark: SparkSession, path: str, version: str | None = None) -> DataFrame:
    """version, features, rows, caveats of model records (JSON lines) with defaults; an unknown version is an error."""
    df = spark.read.schema("version string, features array<string>, rows long, caveats array<string>").json(path)
    out = df.select(F.coalesce("version", F.lit("unknown")).alias("version"), F.coalesce("features", F.array().cast("array<string>")).alias("features"), "rows", F.coalesce("caveats", F.array(F.lit("none recorded"))).alias("caveats"))
    if version is not None:
        out = out.filter(F.col("version") == version)
        if out.isEmpty():
            raise ValueError(f"unknown model version {version}")
    return out


def read_sheets(spark: SparkSession, glob: str) -> DataFrame:
    """All sheets of a glob as one table, with sheet (the name of the Parquet file or folder; the order of sheets is that of their names) and source_file.

    Columns that some sheets lack are null there.
    """
    read = spark.read.option("mergeSchema", True).parquet(glob).withColumn("source_file", F.col("_metadata.file_path"))
    folder, file = F.regexp_extract("source_file", r"/([^/]+)\.parquet/[^/]+$", 1), F.regexp_extract("source_file", r"/([^/]+)\.parquet$", 1)
    return read.withColumn("sheet", F.when(folder != "", folder).otherwise(file))
