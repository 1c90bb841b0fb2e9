"""Nested shapes: rings with holes, parts, rotated and reversed copies."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from rillwise.functions import shapes
from rillwise.operators import spatial
from rillwise.sources import readers

SQUARE = [[0, 0], [4, 0], [4, 4], [0, 4], [0, 0]]
HOLE = [[1, 1], [1, 3], [3, 3], [3, 1], [1, 1]]


def read(spark, tmp_path, geometries, lines):
    features = [{"type": "Feature", "geometry": g, "properties": {"id": str(i)}} for i, g in enumerate(geometries)]
    (tmp_path / "f.json").write_text("\n".join(map(json.dumps, features)) if lines else json.dumps({"features": features}))
    return readers.read_geojson(spark, str(tmp_path / "f.json"), "x", lines)


@pytest.mark.parametrize("lines", [False, True])
def test_every_type_keeps_its_rings(spark, tmp_path, lines):
    g = [
        {"type": "Polygon", "coordinates": [SQUARE, HOLE]}, {"type": "MultiPolygon", "coordinates": [[SQUARE, HOLE], [[[9, 9], [10, 9], [10, 10], [9, 9]]]]},
        {"type": "LineString", "coordinates": [[0, 0], [1, 1.5e0, 7]]}, {"type": "MultiLineString", "coordinates": [[[0, 0], [1, 1]], [[5, 5], [6, 6]]]},
        {"type": "Point", "coordinates": [1, 2]}, {"type": "MultiPoint", "coordinates": [[1, 2], [3, 4]]}, {"type": "GeometryCollection", "geometries": []}, None, {"type": "Polygon", "coordinates": []},
    ]
    rows = {int(r["properties"]["id"]): r for r in read(spark, tmp_path, g, lines).collect()}
    tuples = lambda parts: [[[(v["x"], v["y"]) for v in ring] for ring in part] for part in parts]
    assert tuples(rows[0]["parts"]) == [[[tuple(map(float, v)) for v in r] for r in (SQUARE, HOLE)]]
    assert [len(p) for p in rows[1]["parts"]] == [2, 1] and tuples(rows[2]["parts"]) == [[[(0, 0), (1, 1.5)]]]
    assert [len(p) for p in rows[3]["parts"]] == [1, 1] and tuples(rows[5]["parts"]) == [[[(1, 2)]], [[(3, 4)]]] and tuples(rows[4]["parts"]) == [[[(1, 2)]]]
    assert rows[6]["parts"] is None and rows[7]["parts"] is None and rows[8]["parts"] == [[]]
    assert len(rows[3]["coords"]) == 4 and rows[7]["coords"] is None


def test_no_edge_joins_two_rings(spark, tmp_path):
    g = [{"type": "MultiPolygon", "coordinates": [[SQUARE, HOLE], [[[9, 9], [12, 9], [9, 12], [9, 9]]]]}]
    edges = readers.ring_edges(read(spark, tmp_path, g, False).withColumn("polygon_id", F.lit(1)), ["polygon_id"])
    assert edges.count() == 11 and edges.select("part", "ring").distinct().count() == 3
    at = [(0.5, 0.5), (2, 2), (1, 2), (9.5, 9.5), (5, 5), (4, 4), (3.5, 2), (2, 8)]
    points = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(at)], "point_id int, x double, y double")
    inside = {r["point_id"] for r in spatial.covered_by(points, edges).collect()}
    assert inside == {0, 2, 3, 5, 6}


def test_copies_of_a_shape_have_one_key(spark):
    rng = np.random.default_rng(3)

    def ring(points, start, turn):
        body = points[start:] + points[:start]
        body = body[::-1] if turn else body
        return [*body, body[0]]

    rows, want = [], []
    for shape in range(40):
        outer = [tuple(map(float, rng.integers(0, 3, 2))) for _ in range(int(rng.integers(3, 7)))]  # few places: least vertices repeat
        holes = [[tuple(map(float, rng.integers(3, 6, 2))) for _ in range(3)] for _ in range(int(rng.integers(0, 3)))]
        for _ in range(4):
            own = [ring(outer, int(rng.integers(len(outer))), rng.integers(2)), *(ring(h, int(rng.integers(3)), rng.integers(2)) for h in rng.permutation(np.array(holes)).tolist())]
            rows.append((len(rows), [[[tuple(v) for v in r] for r in own]]))
            turns = lambda p: min(p[k:] + p[:k] for q in (p, p[::-1]) for p in [q] for k in range(len(p)))
            want.append((turns(outer), tuple(sorted(tuple(map(tuple, turns(h))) for h in holes))))
    df = spark.createDataFrame(rows, f"id int, parts {shapes.PARTS}")
    keys = [r[0] for r in df.orderBy("id").select(shapes.shape_key(F.col("parts"))).collect()]
    for i in range(len(rows)):
        for j in range(i):
            assert (keys[i] == keys[j]) == (want[i] == want[j])


def test_lines_and_areas(spark):
    df = spark.createDataFrame([([[[(0.0, 0.0), (1.0, 1.0), (2.0, 0.0)]]],), ([[[(2.0, 0.0), (1.0, 1.0), (0.0, 0.0)]]],), ([[[(1.0, 1.0), (2.0, 0.0), (0.0, 0.0)]]],), ([],), (None,)], f"parts {shapes.PARTS}")
    keys = [r[0] for r in df.select(shapes.shape_key(F.col("parts"))).collect()]
    assert keys[0] == keys[1] != keys[2] and keys[4] is None
    hollow = spark.createDataFrame([([[[tuple(map(float, v)) for v in r] for r in (SQUARE, HOLE)]],)], f"parts {shapes.PARTS}")
    whole, hole = 16 * 111320 * 110540, 4 * 111320 * 110540 * np.cos(np.radians(1))
    assert hollow.select(shapes.area_m2(F.col("parts"))).first()[0] == pytest.approx(whole - hole)
