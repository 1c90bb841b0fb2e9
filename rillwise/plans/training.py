"""Queries on training rows, metrics and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from rillwise.operators import checks as k
from rillwise.plans.adapters import adapted, adapters_sql, table
from rillwise.plans.registry import query
from rillwise.plans.spatial import TRAIN, projected

SCENARIOS = (("dry", 0.0), ("moderate", 40.0), ("heavy", 90.0), ("extreme", 150.0))
EXPANDED = f"""{TRAIN}, x AS (SELECT p.*, scenario, mm, p.point_id || '__' || scenario AS row_id FROM p CROSS JOIN (VALUES {', '.join(f"('{a}', {b}::DOUBLE)" for a, b in SCENARIOS)}) v(scenario, mm) WHERE NOT (point_id % 11 = 0 AND scenario = 'heavy'))"""


def train(spark, sf_dir):
    return projected(adapted(spark, sf_dir, "train"))


def expanded(spark, sf_dir):
    """Every labelled point under every rain scenario, but for some that lack one."""
    s = spark.createDataFrame(SCENARIOS, "scenario string, mm double")
    x = train(spark, sf_dir).crossJoin(F.broadcast(s)).filter("not (point_id % 11 = 0 and scenario = 'heavy')")
    return x.withColumn("row_id", F.concat_ws("__", "point_id", "scenario"))


@query("G7_expand_scenarios", f"WITH {EXPANDED} SELECT row_id, point_id, scenario, mm, label FROM x")
def expand(spark, sf_dir):
    return expanded(spark, sf_dir).select("row_id", "point_id", "scenario", "mm", "label")


@query("A7_A35_dataset_report", f"WITH {TRAIN} SELECT count(*) AS n, count(*) FILTER (label = 1) AS positives, count(*) FILTER (label = 0) AS negatives, round(avg(CASE WHEN score > .05 THEN 1.0 ELSE 0 END), 4) AS complete, round(count(*) FILTER (label = 0) / greatest(count(*) FILTER (label = 1), 1), 4) AS class_weight FROM p")
def report(spark, sf_dir):
    pos, neg = F.count_if(F.col("label") == 1), F.count_if(F.col("label") == 0)
    known = F.when(F.col("score") > 0.05, F.col("score")).isNotNull().cast("double")
    return train(spark, sf_dir).agg(F.count("*").alias("n"), pos.alias("positives"), neg.alias("negatives"), F.round(F.avg(known), 4).alias("complete"), F.round(neg / F.greatest(pos, F.lit(1)), 4).alias("class_weight"))


@query("A11_inconsistent_ids", f"WITH {TRAIN} SELECT CAST(floor(point_id / 2) AS BIGINT) AS base, count(DISTINCT label) AS label, count(DISTINCT round(lat, 2)) AS lat2 FROM p GROUP BY 1 HAVING count(DISTINCT label) > 1 OR count(DISTINCT round(lat, 2)) > 1")
def inconsistent(spark, sf_dir):
    t = train(spark, sf_dir).withColumn("base", F.floor(F.col("point_id") / 2)).withColumn("lat2", F.round("lat", 2))
    return k.inconsistent_ids(t, "base", ["label", "lat2"])


@query("A12_incomplete_expansion", f"WITH {EXPANDED} SELECT point_id, string_agg(scenario, ',' ORDER BY scenario) AS have FROM x GROUP BY 1 HAVING count(*) <> 4")
def incomplete(spark, sf_dir):
    bad = k.incomplete_expansion(expanded(spark, sf_dir), "point_id", "scenario", [s for s, _ in SCENARIOS])
    return bad.select("point_id", F.array_join("have", ",").alias("have"))


@query("A13_label_conflicts", f"WITH {TRAIN} SELECT CAST(floor(x / 3000) AS BIGINT) AS kx, CAST(floor(y / 3000) AS BIGINT) AS ky, count(DISTINCT label) AS labels, count(*) AS n FROM p GROUP BY 1, 2 HAVING count(DISTINCT label) = 2")
def conflicts(spark, sf_dir):
    return k.label_conflicts(train(spark, sf_dir), [F.floor(F.col("x") / 3000).alias("kx"), F.floor(F.col("y") / 3000).alias("ky")], "label")


@query("A15_range_violations", f"""WITH {adapters_sql('cells')} SELECT 'elevation' AS "column", count(*) FILTER (elevation NOT BETWEEN 4 AND 12) AS n FROM cells UNION ALL SELECT 'slope', count(*) FILTER (slope NOT BETWEEN 0 AND 2) FROM cells UNION ALL SELECT 'drain_capacity', count(*) FILTER (drain_capacity NOT BETWEEN 200 AND 1000) FROM cells""")
def violations(spark, sf_dir):
    return k.range_violations(adapted(spark, sf_dir, "cells"), {"elevation": (4, 12), "slope": (0, 2), "drain_capacity": (200, 1000)})


FOLDS = f"""{TRAIN}, c AS (SELECT *, CAST(floor(x / 500) * 1000000 + floor(y / 500) AS BIGINT) AS cell FROM p), z AS (SELECT cell, (row_number() OVER (ORDER BY count(*) DESC, cell) - 1) % 5 AS fold FROM c GROUP BY cell), f AS (SELECT c.*, z.fold FROM c JOIN z USING (cell))"""


@query("W10_spatial_folds", f"WITH {FOLDS} SELECT point_id, cell, fold FROM f")
def folds(spark, sf_dir):
    return k.spatial_folds(train(spark, sf_dir), 5).select("point_id", "cell", "fold")


@query("A19_classification_metrics", f"""WITH {FOLDS}, r AS (SELECT *, rank() OVER (PARTITION BY fold ORDER BY score) + (count(*) OVER (PARTITION BY fold, score) - 1) / 2 AS rk FROM f),
m AS (SELECT fold, count(*) FILTER (label = 1 AND score >= .5) AS tp, count(*) FILTER (label = 0 AND score >= .5) AS fp, count(*) FILTER (label = 1 AND score < .5) AS fn, count(*) FILTER (label = 0 AND score < .5) AS tn, sum(rk) FILTER (label = 1) AS s, count(*) FILTER (label = 1) AS np, count(*) FILTER (label = 0) AS nn FROM r GROUP BY 1)
SELECT fold, tp, fp, fn, tn, round((tp + tn) / (tp + tn + fp + fn), 4) AS accuracy, round(tp / (tp + fp), 4) AS "precision", round(tp / (tp + fn), 4) AS recall, round(2 * tp / (2 * tp + fp + fn), 4) AS f1, round((s - np * (np + 1) / 2) / np / nn, 4) AS auc FROM m""")
def metrics(spark, sf_dir):
    m = k.classification_metrics(k.spatial_folds(train(spark, sf_dir), 5), "fold", "label", "score")
    return m.select("fold", "tp", "fp", "fn", "tn", *[F.round(c, 4).alias(c) for c in ("accuracy", "precision", "recall", "f1", "auc")])


@query("A20_regression_metrics", f"WITH {TRAIN} SELECT round(avg(abs(label - score)), 4) AS mae, round(1 - sum((label - score) ** 2) / (sum(label * label) - count(*) * avg(label) ** 2), 4) AS r2 FROM p")
def regression(spark, sf_dir):
    return k.regression_metrics(train(spark, sf_dir), "label", "score").select(F.round("mae", 4).alias("mae"), F.round("r2", 4).alias("r2"))


@query("W5_dedupe_by_coord", f"WITH {adapters_sql('pockets')} SELECT rec_id FROM pockets WHERE lat IS NOT NULL QUALIFY row_number() OVER (PARTITION BY round(lat, 6), round(lon, 6) ORDER BY rec_id) = 1")
def dedupe(spark, sf_dir):
    p = adapted(spark, sf_dir, "pockets").filter("lat is not null")
    return k.first_by(p, [F.round("lat", 6), F.round("lon", 6)], ["rec_id"]).select("rec_id")


@query("F6_A18_split_usable", f"""WITH {adapters_sql('pockets')}, r AS (SELECT *, CASE WHEN lat IS NULL OR lon IS NULL THEN 'unlocated' WHEN NOT (lat BETWEEN 22.45 AND 22.65 AND lon BETWEEN 88.25 AND 88.45) THEN 'outside_box' WHEN source IS NULL THEN 'no_source' END AS reason FROM pockets)
SELECT ward, coalesce(reason, 'accepted') AS reason, count(*) AS n FROM r GROUP BY ALL""")
def usable(spark, sf_dir):
    from rillwise.functions.geo import in_bbox

    reason = F.when(F.col("lat").isNull() | F.col("lon").isNull(), "unlocated").when(~in_bbox(F.col("lat"), F.col("lon"), (88.25, 22.45, 88.45, 22.65)), "outside_box").when(F.col("source").isNull(), "no_source").otherwise("accepted")
    return adapted(spark, sf_dir, "pockets").groupBy("ward", reason.alias("reason")).agg(F.count("*").alias("n"))


@query("A14_duplicates", f"WITH {adapters_sql('pipes')} SELECT round(lat0, 2) AS a, round(lon0, 2) AS b, count(*) AS n FROM pipes GROUP BY 1, 2 HAVING count(*) > 1")
def dupes(spark, sf_dir):
    p = adapted(spark, sf_dir, "pipes").select(F.round("lat0", 2).alias("a"), F.round("lon0", 2).alias("b"))
    return k.duplicates(p, ["a", "b"])


@query("O5_top_offenders", f"WITH {adapters_sql('pipes')}, r AS (SELECT ward, segment_id, row_number() OVER (PARTITION BY ward ORDER BY segment_id) AS i, count(*) OVER (PARTITION BY ward) AS total FROM pipes WHERE pipe_diameter_mm IS NULL OR segment_id % 2 = 0) SELECT ward, string_agg(segment_id, ',' ORDER BY segment_id) AS items, max(total) AS total, greatest(max(total) - 5, 0) AS more FROM r WHERE i <= 5 GROUP BY ward")
def offenders(spark, sf_dir):
    bad = adapted(spark, sf_dir, "pipes").filter("pipe_diameter_mm is null or segment_id % 2 = 0")
    return k.top_offenders(bad, ["ward"], F.col("segment_id"), 5)


@query("U2_schema_diff", "SELECT 'mm' AS \"column\", 'missing' AS problem, 0 AS filled UNION ALL SELECT 'n_chars', 'unexpected', count(n_chars) FROM documents WHERE n_chars % 2 = 0")
def diff(spark, sf_dir):
    """Columns that are missing or not expected, and how many values stand in them (odd lengths are blanked)."""
    d = table(spark, sf_dir, "documents").withColumn("n_chars", F.when(F.col("n_chars") % 2 == 0, F.col("n_chars")))
    filled = d.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).isNotNull().alias("there")) for c in d.columns])).alias("c")).groupBy("c.column").agg(F.count_if("c.there").alias("filled"))
    return k.schema_diff(d, ["doc_id", "text", "lang", "source", "mm"]).join(filled, "column", "left").withColumn("filled", F.coalesce("filled", F.lit(0)))


@query("U3_unexpected_values", "SELECT DISTINCT o_orderstatus AS value FROM orders WHERE o_orderstatus NOT IN ('O')")
def unexpected(spark, sf_dir):
    return k.unexpected_values(table(spark, sf_dir, "orders"), "o_orderstatus", ["O"])


@query("U4_distinct_sorted", f"WITH {adapters_sql('pipes')} SELECT source_sheet, string_agg(DISTINCT ward, ',' ORDER BY ward) AS wards FROM pipes GROUP BY 1")
def wards(spark, sf_dir):
    return adapted(spark, sf_dir, "pipes").groupBy("source_sheet").agg(F.array_join(F.sort_array(F.collect_set("ward")), ",").alias("wards"))


@query("O3_value_counts", f"WITH {adapters_sql('pipes')} SELECT conduit_type, count(*) AS n FROM pipes GROUP BY 1")
def value_counts(spark, sf_dir):
    return adapted(spark, sf_dir, "pipes").groupBy("conduit_type").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "conduit_type")


@query("A16_mode_per_group", f"WITH {adapters_sql('line_labels')}, n AS (SELECT segment_id, diameter_mm, count(*) AS n FROM line_labels GROUP BY 1, 2) SELECT segment_id, diameter_mm, n FROM n QUALIFY row_number() OVER (PARTITION BY segment_id ORDER BY n DESC, diameter_mm) = 1")
def mode(spark, sf_dir):
    return k.mode_per_group(adapted(spark, sf_dir, "line_labels"), ["segment_id"], "diameter_mm")


@query("A17_V7_sequence_gaps", "SELECT conv_id, min(turn) AS least, max(turn) AS most, count(turn) AS n, count(DISTINCT turn) AS own FROM conversations WHERE conv_id % 3 <> 0 OR turn <> 1 GROUP BY 1 HAVING min(turn) <> 0 OR max(turn) - min(turn) + 1 <> count(turn) OR count(DISTINCT turn) <> count(turn)")
def gaps(spark, sf_dir):
    return k.sequence_gaps(table(spark, sf_dir, "conversations").filter("conv_id % 3 <> 0 or turn <> 1"), "conv_id", "turn", 0)


@query("V4_validate_training", f"""WITH {EXPANDED} SELECT 'labels' AS "check", CASE WHEN count(*) FILTER (label NOT IN (0, 1)) > 0 THEN 'ERROR' ELSE 'OK' END AS severity, count(*) FILTER (label NOT IN (0, 1)) AS n FROM x
UNION ALL SELECT 'both_classes', CASE WHEN count(DISTINCT label) = 2 THEN 'OK' ELSE 'ERROR' END, count(DISTINCT label) FROM x
UNION ALL SELECT 'class_rate', CASE WHEN avg(label) BETWEEN .02 AND .6 THEN 'OK' ELSE 'WARN' END, count(*) FILTER (label = 1) FROM x
UNION ALL SELECT 'scenarios', CASE WHEN count(*) > 0 THEN 'ERROR' ELSE 'OK' END, count(*) FROM (SELECT point_id FROM x GROUP BY 1 HAVING count(*) <> 4)
UNION ALL SELECT 'duplicates', CASE WHEN count(*) > 0 THEN 'WARN' ELSE 'OK' END, count(*) FROM (SELECT lat, lon, scenario FROM x GROUP BY ALL HAVING count(*) > 1)""")
def validate(spark, sf_dir):
    x = expanded(spark, sf_dir)
    row = lambda name, bad, n: F.struct(F.lit(name).alias("check"), bad.alias("severity"), n.cast("long").alias("n"))
    label, wrong = F.col("label"), F.count_if(~F.col("label").isin(0, 1))
    one = x.agg(F.array(
        row("labels", F.when(wrong > 0, "ERROR").otherwise("OK"), wrong),
        row("both_classes", F.when(F.count_distinct(label) == 2, "OK").otherwise("ERROR"), F.count_distinct(label)),
        row("class_rate", F.when(F.avg(label).between(0.02, 0.6), "OK").otherwise("WARN"), F.count_if(label == 1)),
    ).alias("r")).select(F.explode("r").alias("r")).select("r.*")
    bad = k.incomplete_expansion(x, "point_id", "scenario", [s for s, _ in SCENARIOS]).agg(F.count("*").alias("n"))
    twice = k.duplicates(x, ["lat", "lon", "scenario"]).agg(F.count("*").alias("n"))
    told = lambda df, name, level: df.select(F.lit(name).alias("check"), F.when(F.col("n") > 0, level).otherwise("OK").alias("severity"), "n")
    return one.unionByName(told(bad, "scenarios", "ERROR")).unionByName(told(twice, "duplicates", "WARN"))


@query("V5_partial_drainage", f"WITH {adapters_sql('pipes')} SELECT segment_id FROM pipes WHERE (segment_id % 3 = 0 AND (pipe_diameter_mm IS NOT NULL OR segment_id % 2 = 0)) OR (segment_id % 2 = 0 AND pipe_diameter_mm IS NULL)")
def partial(spark, sf_dir):
    p = adapted(spark, sf_dir, "pipes").withColumn("distance", F.when(F.col("segment_id") % 3 != 0, 1.0)).withColumn("capacity", F.when(F.col("segment_id") % 2 == 0, 1.0))
    return p.filter("(distance is null and (pipe_diameter_mm is not null or capacity is not null)) or (capacity is not null and pipe_diameter_mm is null)").select("segment_id")


@query("M6_O2_split", f"""WITH {adapters_sql('train')}, h AS (SELECT point_id, ('0x' || md5('42:' || point_id)[1:7])::BIGINT / 268435456.0 AS share, row_number() OVER (ORDER BY ('0x' || md5('7:' || point_id)[1:7])::BIGINT, point_id) AS k FROM train)
SELECT point_id, CASE WHEN share < 0.2 THEN 'test' ELSE 'train' END AS part, k <= 50 AS sampled FROM h""")
def split(spark, sf_dir):
    """Every labelled point with its part of the split, and whether it is in the seeded sample of 50."""
    t = train(spark, sf_dir)
    learn, test = k.split(t, 0.2, 42, "point_id")
    parts = learn.select("point_id", F.lit("train").alias("part")).unionByName(test.select("point_id", F.lit("test").alias("part")))
    sampled = k.limit_sample(t, 50, 7, "point_id").select("point_id", F.lit(True).alias("sampled"))
    return parts.join(F.broadcast(sampled), "point_id", "left").withColumn("sampled", F.coalesce("sampled", F.lit(False)))


@query("U1_S11_union_layers", f"WITH {adapters_sql('pipes', 'boxes')}, u AS (SELECT source_sheet, ward, conduit_type FROM pipes UNION ALL SELECT source_sheet, ward, NULL FROM boxes) SELECT source_sheet, count(*) AS n, count(conduit_type) AS typed FROM u GROUP BY 1")
def union(spark, sf_dir):
    both = adapted(spark, sf_dir, "pipes").unionByName(adapted(spark, sf_dir, "boxes"), allowMissingColumns=True)
    return both.groupBy("source_sheet").agg(F.count("*").alias("n"), F.count("conduit_type").alias("typed"))
