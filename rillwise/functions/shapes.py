"""Shapes as nested arrays: parts of rings of vertices (x, y). A line is a part with one ring that is not closed, a point one with one vertex."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from rillwise.functions.geo import haversine_m, local_xy_m

#: Depth of the coordinates of each geometry type, and the levels of parts and rings that it has itself.
DEPTHS = {"Point": 1, "MultiPoint": 2, "LineString": 2, "MultiLineString": 3, "Polygon": 3, "MultiPolygon": 4}
PARTS = "array<array<array<struct<x:double,y:double>>>>"


def _vertex(v: Column) -> Column:
    return F.struct(F.get(v, F.lit(0)).alias("x"), F.get(v, F.lit(1)).alias("y"))


def _ring(r: Column) -> Column:
    return F.transform(r, _vertex)


def parts_of(kind: Column, coordinates: Column) -> Column:
    """Parts of a GeoJSON geometry from its type and the JSON text of its coordinates; null for other types and for text that is no such array."""
    read = lambda depth: F.from_json(coordinates, "array<" * depth + "double" + ">" * depth)
    one = {
        "Point": lambda: F.array(F.array(F.array(_vertex(read(1))))),
        "MultiPoint": lambda: F.transform(read(2), lambda v: F.array(F.array(_vertex(v)))),
        "LineString": lambda: F.array(F.array(_ring(read(2)))),
        "MultiLineString": lambda: F.transform(read(3), lambda line: F.array(_ring(line))),
        "Polygon": lambda: F.array(F.transform(read(3), _ring)),
        "MultiPolygon": lambda: F.transform(read(4), lambda part: F.transform(part, _ring)),
    }
    out = F.lit(None).cast(PARTS)
    for name, parts in one.items():
        out = F.when((kind == name) & read(DEPTHS[name]).isNotNull(), parts()).otherwise(out)
    return out


def vertices(parts: Column) -> Column:
    """All vertices in order."""
    return F.flatten(F.flatten(parts))


def is_area(kind: Column) -> Column:
    return kind.isin("Polygon", "MultiPolygon")


def sides(ring: Column) -> Column:
    """Edges (a, b) between neighbours of one ring: no edge joins two rings."""
    n = F.size(ring)
    return F.arrays_zip(F.slice(ring, F.lit(1), F.greatest(n - 1, F.lit(0))).alias("a"), F.slice(ring, F.lit(2), F.greatest(n - 1, F.lit(0))).alias("b"))


def all_sides(parts: Column) -> Column:
    """Edges (a, b) of all rings of all parts."""
    return F.flatten(F.transform(F.flatten(parts), sides))


def length_m(parts: Column) -> Column:
    return F.aggregate(all_sides(parts), F.lit(0.0), lambda s, e: s + haversine_m(e["a"]["y"], e["a"]["x"], e["b"]["y"], e["b"]["x"]))


def _ring_area_m2(ring: Column) -> Column:
    """Area of a closed ring on the plane that touches at its first vertex."""
    first = ring[0]

    def part(s: Column, e: Column) -> Column:
        (ax, ay), (bx, by) = (local_xy_m(e[k]["y"], e[k]["x"], first["y"], first["x"]) for k in "ab")
        return s + ax * by - bx * ay

    return F.abs(F.aggregate(sides(ring), F.lit(0.0), part)) / 2


def area_m2(parts: Column) -> Column:
    """Area of all parts: a part's first ring less its other rings, which are holes."""
    holes = lambda part: F.aggregate(F.slice(part, 2, F.greatest(F.size(part) - 1, F.lit(1))), F.lit(0.0), lambda s, r: s + _ring_area_m2(r))
    return F.aggregate(parts, F.lit(0.0), lambda s, part: s + F.when(F.size(part) > 0, _ring_area_m2(part[0]) - holes(part)).otherwise(0.0))


def _least_start(open_ring: Column) -> Column:
    """The least of the rotations that start at a least vertex; more than one only where the ring passes its least vertex again."""
    n = F.size(open_ring)
    starts = F.filter(F.sequence(F.lit(1), n), lambda i: F.element_at(open_ring, i.cast("int")) == F.array_min(open_ring))
    return F.array_min(F.transform(starts, lambda i: F.concat(F.slice(open_ring, i.cast("int"), n), F.slice(open_ring, F.lit(1), i.cast("int") - 1))))


def ring_key(ring: Column) -> Column:
    """The same array for equal rings, wherever they start and whichever way they go; a ring that isn't closed only has its two directions."""
    closed = (F.size(ring) > 2) & (F.element_at(ring, 1) == F.element_at(ring, -1))
    body = F.slice(ring, 2, F.greatest(F.size(ring) - 1, F.lit(1)))
    return F.when(closed, F.least(_least_start(body), _least_start(F.reverse(body)))).otherwise(F.least(ring, F.reverse(ring)))


def shape_key(parts: Column) -> Column:
    """A digest that is the same for equal shapes: rings by ring_key, holes and parts in any order."""
    part = lambda p: F.concat(F.slice(F.transform(p, ring_key), 1, 1), F.array_sort(F.slice(F.transform(p, ring_key), 2, F.greatest(F.size(p) - 1, F.lit(1)))))
    return F.sha2(F.to_json(F.array_sort(F.transform(parts, part))), 256)
