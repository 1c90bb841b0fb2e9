"""Data-quality rules, reports and evaluation metrics over whole tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F


def range_violations(df: DataFrame, rules: dict[str, tuple[float, float]]) -> DataFrame:
    """(column, n): how many known values lie beyond the column's bounds. One pass, whatever the number of rules."""
    n = [F.count_if(~F.col(c).between(*b)).alias(c) for c, b in rules.items()]
    return unpivoted(df.agg(*n), list(rules), "column", "n")


def unpivoted(df: DataFrame, columns: list[str], name: str, value: str) -> DataFrame:
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias(name), F.col(c).alias(value)) for c in columns])).alias("_p")
    return df.select(pairs).select(f"_p.{name}", f"_p.{value}")


def inconsistent_ids(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Keys with more than one value of any of the columns."""
    n = df.groupBy(key).agg(*[F.count_distinct(c).alias(c) for c in columns])
    return n.filter(" or ".join(f"{c} > 1" for c in columns))


def incomplete_expansion(df: DataFrame, key: str, scenario: str, expected: list[str]) -> DataFrame:
    """Keys whose set of scenarios is not the expected one."""
    have = df.groupBy(key).agg(F.array_sort(F.collect_set(scenario)).alias("have"))
    return have.filter(F.col("have") != F.array(*[F.lit(x) for x in sorted(expected)]))


def label_conflicts(df: DataFrame, keys: list[Column], label: str) -> DataFrame:
    """Places with both labels."""
    return df.groupBy(*keys).agg(F.count_distinct(label).alias("labels"), F.count("*").alias("n")).filter("labels = 2")


def duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n) of those that come more than once."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")


def classification_metrics(df: DataFrame, fold: str, label: str, score: str, threshold: float = 0.5) -> DataFrame:
    """Confusion, accuracy, precision, recall, F1 (0 where undefined) and ROC AUC (average ranks for ties; null with one class) of each fold.

    Ranks come from counts of distinct scores, so a fold's rows are aggregated before they are ordered.
    """
    counts = df.groupBy(fold, score).agg(F.count_if(F.col(label) == 1).alias("_p"), F.count_if(F.col(label) == 0).alias("_n"))
    below = F.coalesce(F.sum("_n").over(W.partitionBy(fold).orderBy(score).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    ranked = counts.withColumn("_u", F.col("_p") * (below + F.col("_n") / 2))
    hit = F.col(score) >= threshold
    s = lambda c, cond: F.sum(F.when(cond, F.col(c)).otherwise(0))
    out = ranked.groupBy(fold).agg(s("_p", hit).alias("tp"), s("_n", hit).alias("fp"), s("_p", ~hit).alias("fn"), s("_n", ~hit).alias("tn"), F.sum("_u").alias("_u"), F.sum("_p").alias("_ps"), F.sum("_n").alias("_ns"))
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    precision, recall = ratio(tp, tp + fp), ratio(tp, tp + fn)
    auc = F.when((F.col("_ps") > 0) & (F.col("_ns") > 0), F.col("_u") / F.col("_ps") / F.col("_ns"))
    return out.select(fold, "tp", "fp", "fn", "tn", ratio(tp + tn, tp + fp + fn + tn).alias("accuracy"), precision.alias("precision"), recall.alias("recall"), ratio(2 * precision * recall, precision + recall).alias("f1"), auc.alias("auc"))


def regression_metrics(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    a, p = F.col(actual), F.col(predicted)
    return df.agg(F.avg(F.abs(a - p)).alias("mae"), (1 - F.sum(F.pow(a - p, 2)) / (F.sum(a * a) - F.count(a) * F.pow(F.avg(a), 2))).alias("r2"))


def spatial_folds(df: DataFrame, k: int, size: float = 500.0) -> DataFrame:
    """df (x, y) with cell and fold: whole cells of 500 m lie in one fold; cells are dealt by size, the largest first."""
    cell = (F.floor(F.col("x") / size) * 1000000 + F.floor(F.col("y") / size)).cast("long")
    placed = df.withColumn("cell", cell)
    sizes = placed.groupBy("cell").agg(F.count("*").alias("_n"))
    # the rank of a cell: larger sizes before it by counts of sizes (few), and its place among cells of its size
    per_size = sizes.groupBy("_n").agg(F.count("*").alias("_cells"))
    before = F.coalesce(F.sum("_cells").over(W.orderBy(F.desc("_n")).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    own = F.row_number().over(W.partitionBy("_n").orderBy("cell")) - 1
    dealt = sizes.withColumn("_own", own).join(per_size.withColumn("_before", before).select("_n", "_before"), "_n")
    return placed.join(dealt.select("cell", ((F.col("_before") + F.col("_own")) % k).cast("int").alias("fold")), "cell")


def first_by(df: DataFrame, keys: list, order: list) -> DataFrame:
    """The first row of each key."""
    return df.withColumn("_r", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).filter("_r = 1").drop("_r")


def hash_number(*parts: str | int | Column) -> Column:
    """A whole number below 2**28 that depends on the parts alone, the same in every engine: the first seven digits of the MD5 of the parts joined by colons."""
    text = F.concat_ws(":", *[F.lit(str(p)) if isinstance(p, int) else (F.col(p) if isinstance(p, str) else p).cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 7), 16, 10).cast("long")


def hash_share(*ids: str, seed: int = 42) -> Column:
    """A number from 0 to 1 that depends on the ids and the seed alone: rows are split alike in every run."""
    return hash_number(seed, *ids) / float(1 << 28)


def split(df: DataFrame, test: float, seed: int, *ids: str) -> tuple[DataFrame, DataFrame]:
    share = hash_share(*ids, seed=seed)
    return df.filter(share >= test), df.filter(share < test)


def limit_sample(df: DataFrame, n: int, seed: int, *ids: str) -> DataFrame:
    """n rows without replacement: those least by a seeded hash of their ids."""
    return df.orderBy(hash_number(seed, *ids), *ids).limit(n)


def top_offenders(df: DataFrame, keys: list[str], item: Column, n: int = 25) -> DataFrame:
    """The first n items of each key and how many more there are. Only n of a key's items are kept before they are listed."""
    w = W.partitionBy(*keys).orderBy("_item")
    ranked = df.withColumn("_item", item).withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= n)
    total = df.groupBy(*keys).agg(F.count("*").alias("total"))
    listed = ranked.groupBy(*keys).agg(F.array_join(F.array_sort(F.collect_list("_item")), ",").alias("items"))
    return listed.join(total, keys).withColumn("more", F.greatest(F.col("total") - n, F.lit(0)))


def schema_diff(df: DataFrame, expected: list[str]) -> DataFrame:
    """(column, problem): columns that are missing or unexpected."""
    rows = [(c, "missing") for c in expected if c not in df.columns] + [(c, "unexpected") for c in df.columns if c not in expected]
    return df.sparkSession.createDataFrame(rows, "column string, problem string")


def unexpected_values(df: DataFrame, column: str, allowed: list) -> DataFrame:
    return df.filter(F.col(column).isNotNull() & ~F.col(column).isin(*allowed)).select(F.col(column).alias("value")).distinct()


def mode_per_group(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """The most common value of each key (ties: the least) and how often it comes; null if all are."""
    n = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("n"))
    return n.groupBy(*keys).agg(F.max(F.struct("n", (-F.col(value)).alias("v"))).alias("m")).select(*keys, (-F.col("m.v")).alias(value), F.col("m.n").alias("n"))


def sequence_gaps(df: DataFrame, key: str, number: str, first: int) -> DataFrame:
    """Keys whose numbers are not first, first + 1, ... without gaps or repeats."""
    s = df.groupBy(key).agg(F.min(number).alias("least"), F.max(number).alias("most"), F.count(number).alias("n"), F.count_distinct(number).alias("own"))
    return s.filter(f"least <> {first} or most - least + 1 <> n or own <> n")
