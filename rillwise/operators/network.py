"""Drainage network: accumulation from upstream, loads, alerts, inferred nodes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from rillwise.functions.hydrology import STRIP_M, drain_alert, pipe_load
from rillwise.store import discard, saved

LEVELS = ("RED", "ORANGE", "YELLOW", "GREEN", "UNKNOWN")
WORST_SHARE = 0.20
#: Rounds whose settled pipes become one table.
FLUSHED = 32


def _summary(arcs: DataFrame) -> DataFrame:
    """A row for each node that arcs end at: how many nodes they still come from, the constants that have reached it, and the arc if there is one alone."""
    merged = arcs.groupBy("dst", "src").agg(F.sum("scale").alias("scale"), F.sum("add").alias("add"), F.max("far").alias("far"), F.max("least").alias("least"))
    known = F.col("src").isNull()
    return merged.groupBy("dst").agg(
        F.count("src").alias("open"),
        F.coalesce(F.sum(F.when(known, F.col("add"))), F.lit(0.0)).alias("area"),
        F.coalesce(F.max(F.when(known, F.col("least"))), F.lit(0.0)).alias("path"),
        F.max(F.when(~known, F.struct("src", "scale", "add", "far", "least"))).alias("arc"),
    )


def _contracted(arcs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Arcs from settled nodes become constants, those from a node with one arc alone start where that one starts; of open nodes only.

    Arcs move to nodes that are open, so that every node that an arc starts at is looked up once more after it has been settled.
    """
    open_ = nodes.filter("open > 0").select(F.col("dst").alias("_from"), F.lit(True).alias("_waits"))
    known = nodes.join(open_, F.col("arc.src") == F.col("_from"), "left")
    n = known.select(F.col("dst").alias("src"), "_waits", *[F.col(c).alias(f"_{c}") for c in ("open", "area", "path", "arc")])
    met = arcs.filter("src is not null").join(n, "src", "left")
    settled, alone = F.coalesce(F.col("_open") == 0, F.lit(True)), (F.col("_open") == 1) & F.col("_waits")
    area, path, own = F.coalesce("_area", F.lit(0.0)), F.coalesce("_path", F.lit(0.0)), lambda c: F.col(f"_arc.{c}")
    moved = met.select(
        "dst",
        F.when(settled, None).when(alone, own("src")).otherwise(F.col("src")).alias("src"),
        F.when(settled, 0.0).when(alone, F.col("scale") * own("scale")).otherwise(F.col("scale")).alias("scale"),
        F.when(settled, F.col("scale") * area + F.col("add")).when(alone, F.col("scale") * (own("add") + area) + F.col("add")).otherwise(F.col("add")).alias("add"),
        F.when(settled, 0.0).when(alone, F.col("far") + own("far")).otherwise(F.col("far")).alias("far"),
        F.when(settled, F.greatest("least", F.col("far") + path)).when(alone, F.greatest("least", F.col("far") + F.greatest(own("least"), path))).otherwise(F.col("least")).alias("least"),
    )
    zero = F.lit(0.0)
    kept = nodes.filter("open > 0").select("dst", F.lit(None).cast(arcs.schema["src"].dataType).alias("src"), zero.alias("scale"), F.col("area").alias("add"), zero.alias("far"), F.col("path").alias("least"))
    return moved.unionByName(kept)


def accumulate(edges: DataFrame, strip_m: float = STRIP_M) -> DataFrame:
    """edges (pipe_id, up_node, down_node, length_m) with area_m2 and path_m gathered from upstream.

    A pipe's own strip and what reaches it split evenly among the pipes that leave its lower node; the path is the longest.
    Pipes of a loop, and those below it, keep what reaches them from pipes that are settled.

    What a node receives is a function of what another one does: area = scale * area + add, path = max(least, far + path).
    Each round joins these arcs once with a row for each node: arcs from settled nodes become constants (leaves are raked),
    and arcs from a node that waits for one other only start there instead (chains halve). Arcs between the same two nodes
    are one. So rounds grow with the logarithm of the pipes for chains and trees; every round settles a node, or is the last.
    """
    fan = edges.groupBy(F.col("up_node").alias("_n")).agg(F.count("*").alias("_fan"))
    split = edges.join(fan, F.col("up_node") == F.col("_n"), "left").withColumn("_own", F.col("length_m") * strip_m)
    first = split.filter("down_node is not null").select(
        F.col("down_node").alias("dst"), F.col("up_node").alias("src"), F.coalesce(1.0 / F.col("_fan"), F.lit(0.0)).alias("scale"), F.col("_own").alias("add"), F.col("length_m").cast("double").alias("far"), F.col("length_m").cast("double").alias("least")
    )
    arcs, done, rounds, waiting = saved(first, "arcs"), [], [], None
    while True:
        nodes = saved(_summary(arcs), "nodes")
        rounds.append(nodes)
        left = nodes.filter("open > 0").count()
        if left == 0 or left == waiting:
            break
        waiting, after = left, saved(_contracted(arcs, nodes), "arcs")
        discard(arcs)
        arcs = after
        if len(rounds) == FLUSHED:
            done.append(saved(reduce(DataFrame.unionByName, [r.filter("open = 0") for r in rounds]), "settled"))
            discard(*rounds)
            rounds = []
    reached = reduce(DataFrame.unionByName, [*done, *(r.filter("open = 0") for r in rounds), rounds[-1].filter("open > 0")])
    own = split.join(reached.select(F.col("dst").alias("_n"), "area", "path"), "_n", "left")
    area = F.col("_own") + F.coalesce(F.col("area") / F.col("_fan"), F.lit(0.0))
    return own.select("pipe_id", "up_node", "down_node", "length_m", area.alias("area_m2"), (F.col("length_m") + F.coalesce("path", F.lit(0.0))).alias("path_m"))


def network_load(pipes: DataFrame, storms: DataFrame) -> DataFrame:
    """pipes (area_m2, path_m, capacity) under every storm (intensity, minutes; a small table): hydraulics and alert."""
    met = pipes.crossJoin(F.broadcast(storms))
    load = pipe_load(*[F.col(c) for c in ("intensity", "minutes", "area_m2", "path_m", "capacity")])
    return met.withColumn("_l", load).select("*", "_l.*").drop("_l").withColumn("alert", drain_alert(F.col("load")))


def overall_alert(counts: dict[str, Column]) -> Column:
    """The worst level that a fifth of the pipes with a known load reach at least."""
    known = sum((counts[x] for x in LEVELS[:-1]), F.lit(0))
    out, worse = F.when(known == 0, "UNKNOWN"), F.lit(0)
    for level in LEVELS[:3]:
        worse = worse + counts[level]
        out = out.when(worse / known >= WORST_SHARE, level)
    return out.otherwise("GREEN")


def alert_summary(loads: DataFrame, keys: list[str]) -> DataFrame:
    """Counts of all five alerts, pipes assessed (unknown ones too), whole m3 of overflow and the overall alert."""
    n = loads.groupBy(*keys).agg(*[F.count_if(F.col("alert") == x).alias(x.lower()) for x in LEVELS], F.count("*").alias("assessed"), F.round(F.sum("overflow"), 0).alias("overflow_m3"))
    return n.withColumn("overall", overall_alert({x: F.col(x.lower()) for x in LEVELS}))


def infer_nodes(ends: DataFrame, decimals: int = 5) -> DataFrame:
    """Nodes of pipe ends (segment_id, lon, lat, diameter, ward) that agree to 5 decimals: mean place, degree, kind, largest diameter, first ward."""
    nodes = ends.groupBy(F.round("lon", decimals).alias("klon"), F.round("lat", decimals).alias("klat")).agg(
        F.round(F.avg("lon"), 7).alias("lon"), F.round(F.avg("lat"), 7).alias("lat"), F.count("*").alias("degree"), F.max("diameter").alias("max_diameter"), F.min_by("ward", "segment_id").alias("ward")
    )
    return nodes.withColumn("kind", F.when(F.col("degree") >= 3, "junction").when(F.col("degree") == 2, "joint").otherwise("terminal"))


def in_area(x: Column, y: Column, cx: Column, cy: Column, radius: Column) -> Column:
    """Within radius of the centre; everything if no area is given."""
    return F.coalesce(F.pow(x - cx, 2) + F.pow(y - cy, 2) <= radius * radius, cx.isNull() | radius.isNull())
