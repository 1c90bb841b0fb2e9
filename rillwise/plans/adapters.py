"""Inputs of the registered queries, derived from the given tables by SQL that Spark and the oracle read alike."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, functions as F

ADAPTERS = {
    "pts": "SELECT c_custkey AS point_id, 22.40 + 0.35 * ((c_custkey * 5417) % 10007) / 10007.0e0 AS lat, 88.20 + 0.35 * ((c_custkey * 7919) % 10007) / 10007.0e0 AS lon FROM {customer}",
    "pumps": "SELECT s_suppkey AS pump_id, s_name AS name, 1 + s_nationkey AS ward, 22.40 + 0.35 * ((s_suppkey * 3571 + 17) % 10007) / 10007.0e0 AS lat, 88.20 + 0.35 * ((s_suppkey * 6827 + 29) % 10007) / 10007.0e0 AS lon FROM {supplier}",
    "pockets": """SELECT o_orderkey AS rec_id, 1 + o_custkey % 144 AS ward,
        CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE 22.40 + 0.35 * ((o_orderkey * 4231) % 10007) / 10007.0e0 END AS lat,
        CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE 88.20 + 0.35 * ((o_orderkey * 9241) % 10007) / 10007.0e0 END AS lon,
        CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_orderpriority END AS source FROM {orders}""",
    "pipes": """SELECT p_partkey AS segment_id, p_brand AS source_sheet, 1 + p_partkey % 144 AS ward,
        CASE p_partkey % 10 WHEN 0 THEN 'box_sewer' WHEN 1 THEN 'drain' ELSE 'pipe' END AS conduit_type,
        CASE p_size % 8 WHEN 0 THEN 150 WHEN 1 THEN 225 WHEN 2 THEN 300 WHEN 3 THEN 375 WHEN 4 THEN 450 WHEN 5 THEN 600 WHEN 6 THEN 900 ELSE NULL END AS pipe_diameter_mm,
        22.40 + 0.35 * ((p_partkey * 2753) % 10007) / 10007.0e0 AS lat0, 88.20 + 0.35 * ((p_partkey * 8117) % 10007) / 10007.0e0 AS lon0,
        (10 + 8 * p_size) * cos(radians((p_partkey * 31) % 360)) AS dx_m, (10 + 8 * p_size) * sin(radians((p_partkey * 31) % 360)) AS dy_m FROM {part}""",
    "net": "SELECT p_partkey AS pipe_id, p_partkey AS up_node, CAST(floor(p_partkey / 2.0e0) AS BIGINT) AS down_node, 10.0e0 + 8 * p_size AS length_m FROM {part} WHERE p_partkey > 0",
    "route_segs": """SELECT o.o_custkey AS trip_id, l.l_orderkey AS route_id, l.l_linenumber AS seq, l.l_partkey AS k1, l.l_suppkey AS k2, l.l_quantity AS k3, l.l_extendedprice AS k4, l.l_shipdate AS k5,
        CASE WHEN l.l_returnflag = 'R' THEN NULL ELSE (l.l_quantity / 50.0e0) * (0.5e0 + 5.0e0 * l.l_discount) END AS prob
        FROM {lineitem} l JOIN {orders} o ON o.o_orderkey = l.l_orderkey""",
    "wx": """SELECT event_id, user_id AS station, ts,
        CASE event_type WHEN 'error' THEN 'rate_limited' WHEN 'signup' THEN 'auth' WHEN 'view' THEN 'unavailable' ELSE 'ok' END AS outcome,
        CASE event_id % 17 WHEN 0 THEN 'NIL' WHEN 1 THEN ' trace ' WHEN 2 THEN 'x' ELSE CAST(value AS VARCHAR(20)) END AS rain_raw, value FROM {events}""",
    "cells": """SELECT p_partkey AS cell_id, 3.0e0 + (p_partkey * 37) % 120 / 10.0e0 AS elevation, 0.1e0 + (p_partkey * 13) % 29 / 10.0e0 AS slope, 45.0e0 + (p_partkey * 17) % 53 AS imperviousness,
        150.0e0 + (p_partkey * 101) % 1050 AS drain_capacity, 2.0e0 + (p_partkey * 7) % 58 AS distance_to_drain, (p_partkey * 3) % 21 AS historical_floods FROM {part}""",
    "train": """SELECT d.doc_id AS point_id, l.quality AS label, 22.40 + 0.35 * ((d.doc_id * 6151) % 10007) / 10007.0e0 AS lat, 88.20 + 0.35 * ((d.doc_id * 3323) % 10007) / 10007.0e0 AS lon,
        (d.n_chars % 97) / 97.0e0 AS score FROM {documents} d JOIN {labels} l ON l.doc_id = d.doc_id""",
    "boxes": "SELECT p_partkey AS body_id, p_brand AS source_sheet, 1 + p_partkey % 144 AS ward, ((p_partkey * 2753) % 10007) * 3.6e0 AS cx, ((p_partkey * 8117) % 10007) * 3.6e0 AS cy, 100.0e0 + 16 * p_size AS side_m FROM {part}",
    "dashes": """SELECT p_partkey AS dash_id, CAST(floor(p_partkey / 10.0e0) AS BIGINT) AS row_no, 'L' AS layer, 12.0e0 * (p_partkey % 10) AS x0, 12.0e0 * (p_partkey % 10) + 8 AS x1,
        50.0e0 * floor(p_partkey / 10.0e0) AS y FROM {part} WHERE p_size % 9 <> 0""",
    "line_labels": """SELECT l.l_partkey AS segment_id, l.l_quantity / 50.0e0 * (10 + 8 * p.p_size) AS pos_m, CASE l.l_linenumber % 3 WHEN 0 THEN 300 WHEN 1 THEN 450 ELSE 600 END AS diameter_mm
        FROM {lineitem} l JOIN {part} p ON p.p_partkey = l.l_partkey""",
    "gcps": """SELECT s_nationkey AS sheet, s_suppkey AS gcp_id, ((s_suppkey * 613) % 2003) * 1.0e0 AS sx, ((s_suppkey * 877) % 3001) * 1.0e0 AS sy,
        591500.0e0 + 0.9e0 * ((s_suppkey * 613) % 2003) - 0.2e0 * ((s_suppkey * 877) % 3001) + CASE WHEN s_suppkey % 5 = 0 THEN 7.0e0 ELSE 0.0e0 END AS mx,
        2487900.0e0 + 0.2e0 * ((s_suppkey * 613) % 2003) + 0.9e0 * ((s_suppkey * 877) % 3001) AS my FROM {supplier}""",
    "cands": """SELECT l.l_orderkey AS query_id, l.l_partkey AS cand_id, q.p_name AS query_text, c.p_name AS cand_name,
        CASE l.l_returnflag WHEN 'R' THEN 'place' WHEN 'A' THEN 'street' ELSE 'address' END AS kind,
        22.40 + 0.35 * ((l.l_partkey * 2753) % 10007) / 10007.0e0 AS lat, 88.20 + 0.35 * ((l.l_partkey * 8117) % 10007) / 10007.0e0 AS lon,
        CASE WHEN l.l_returnflag = 'A' THEN NULL ELSE 20.0e0 * l.l_quantity END AS extent_m
        FROM {lineitem} l JOIN {part} c ON c.p_partkey = l.l_partkey JOIN {part} q ON q.p_partkey = l.l_orderkey % 200""",
    "ward_pts": """SELECT o_orderkey AS rec_id, o_custkey AS ward, 1 + o_custkey % 16 AS borough,
        22.40 + 0.30 * ((o_custkey * 5417) % 10007) / 10007.0e0 + 0.05 * ((o_orderkey * 4231) % 10007) / 10007.0e0 AS lat,
        88.20 + 0.30 * ((o_custkey * 7919) % 10007) / 10007.0e0 + 0.05 * ((o_orderkey * 9241) % 10007) / 10007.0e0 AS lon FROM {orders}""",
}
#: Raster pixels; every 97th has no data.
RASTER = {
    "spark": "SELECT vec_id AS row, CAST(pos AS BIGINT) AS col, CASE WHEN (vec_id * 64 + pos) % 97 <> 0 THEN CAST(val AS DOUBLE) * 10 END AS z FROM {embeddings} LATERAL VIEW posexplode(embedding) e AS pos, val",
    "duckdb": "SELECT vec_id AS row, col, CASE WHEN (vec_id * 64 + col) % 97 <> 0 THEN val * 10 END AS z FROM (SELECT vec_id, generate_subscripts(embedding, 1) - 1 AS col, CAST(unnest(embedding) AS DOUBLE) AS val FROM {embeddings})",
}
#: City boundary ring (lat, lon), clockwise from the south-west.
BOUNDARY = ((22.45, 88.25), (22.58, 88.22), (22.68, 88.30), (22.70, 88.42), (22.60, 88.50), (22.48, 88.48), (22.42, 88.36))

def _tables(sql: str) -> list[str]:
    return sorted(set(re.findall(r"\{(\w+)\}", sql)))

def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")

def adapted(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    sql = RASTER["spark"] if name == "raster" else ADAPTERS[name]
    tables = {t: table(spark, sf_dir, t) for t in _tables(sql)}
    if name == "cands":  # texts are the names of some of the first 200 parts: all candidates of a text would else meet in one task
        sql, tables["asked"] = sql.replace("{part} q", "{asked} q"), F.broadcast(tables["part"].filter("abs(p_partkey) < 200"))
    return spark.sql(sql, **tables)

def adapters_sql(*names: str) -> str:
    """WITH clauses (without the keyword) of adapters for the oracle."""
    body = {n: RASTER["duckdb"] if n == "raster" else ADAPTERS[n] for n in names}
    return ", ".join(f"{n} AS ({sql.format(**{t: t for t in _tables(sql)})})" for n, sql in body.items())
