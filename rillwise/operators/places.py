"""Resolution of place names and consistency of located records."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from rillwise.functions.geo import geodesic_m, geodesic_of
from rillwise.functions.names import clean_query, distinctive_tokens
from rillwise.operators.fuzzy import matched_names
from rillwise.operators.graph import connected_components, group_links
from rillwise.store import saved

# Limits in metres, and kinds of candidates that are too wide.
UNCERTAINTY_M, AMBIGUITY_M, WARD_M, BOROUGH_M = 750.0, 1000.0, 2500.0, 6000.0
WIDE = ("country", "region", "postcode", "district", "place")
#: Pairs of texts up to which they go to the candidates; of more, both move.
TEXTS_SENT = 50_000
STATUSES = ("none", "too_generic", "outside", "name_mismatch", "too_vague", "ambiguous", "ok")


def choose_candidate(cands: DataFrame, inside: Column) -> DataFrame:
    """One row for each query_id: status and the candidate that is chosen (the first by rank that passes all gates).

    Gates in order: too_generic, outside, name_mismatch, too_vague, ambiguous (another precise one farther than 1 km from the
    first), ok. cands: query_id, rank, cand_id, query_text, cand_name, kind, lat, lon, extent_m. Names are matched by the
    similarity ratio of their tokens, each pair of texts once. Queries without candidates have no row; repeated ones don't matter.
    """
    told = F.coalesce(inside, F.lit(False)).alias("_in")
    c = saved(cands.select("query_id", "rank", "cand_id", "query_text", "cand_name", "kind", "lat", "lon", "extent_m", told), "candidates")  # read three times
    texts = saved(c.groupBy("query_text", "cand_name").agg(F.bool_or("_in").alias("_any")), "texts")
    named = matched_names(texts.filter("_any"), "query_text", "cand_name")
    each = texts.join(named, ["query_text", "cand_name"], "left").select(F.col("query_text").alias("_q"), F.col("cand_name").alias("_n"), F.coalesce("named", F.lit(False)).alias("_like"), F.size(distinctive_tokens(F.col("query_text"))).alias("_words"))
    each = saved(each, "matched")
    c = c.join(F.broadcast(each) if each.count() <= TEXTS_SENT else each, F.col("query_text").eqNullSafe(F.col("_q")) & F.col("cand_name").eqNullSafe(F.col("_n"))).withColumn("_named", F.col("_in") & F.col("_like"))
    precise = ~F.coalesce(F.col("kind").isin(*WIDE), F.lit(False)) & (F.coalesce("extent_m", F.lit(0.0)) <= UNCERTAINTY_M)
    own = F.struct("rank", "cand_id", "lat", "lon", "extent_m", "kind")
    told = [F.max("_words").alias("distinctive"), F.bool_or("_in").alias("any_in"), F.bool_or("_named").alias("any_named"), F.min(F.when(F.col("_named") & precise, own)).alias("best")]
    n = saved(c.groupBy("query_id").agg(*told), "gates")
    fine = c.filter(F.col("_named") & precise).select("query_id", "lat", "lon").distinct()
    out = n.join(ambiguous(fine.join(n.select("query_id", "best"), "query_id")).select("query_id", "far"), "query_id", "left")
    status = (
        F.when(F.col("distinctive") == 0, "too_generic").when(~F.col("any_in"), "outside").when(~F.col("any_named"), "name_mismatch")
        .when(F.col("best").isNull(), "too_vague").when(F.coalesce("far", F.lit(False)), "ambiguous").otherwise("ok")
    )
    ok = status == "ok"
    suffix = F.when(ok, F.when((F.col("best.kind") == "street") & F.col("best.extent_m").isNull(), "street_centroid").otherwise("auto"))
    return out.select("query_id", status.alias("status"), F.when(ok, F.col("best.cand_id")).alias("cand_id"), F.when(ok, F.round("best.lat", 6)).alias("lat"), F.when(ok, F.round("best.lon", 6)).alias("lon"), suffix.alias("method"))


def ambiguous(fine: DataFrame) -> DataFrame:
    """(query_id, best, far): whether any precise candidate lies more than a kilometre from the best (a struct column)."""
    d = geodesic_m(F.col("best.lat"), F.col("best.lon"), F.col("lat"), F.col("lon"))
    return fine.groupBy("query_id").agg(F.min("best").alias("best"), F.max(d > AMBIGUITY_M).alias("far"))


def apply_overrides(rows: DataFrame, manual: DataFrame, keys: list[str]) -> DataFrame:
    """Verified positions (manual: keys, lat, lon) replace those of rows; method tells where a position is from."""
    m = manual.select(*keys, F.col("lat").alias("_lat"), F.col("lon").alias("_lon"))
    out = rows.join(m, keys, "left")
    method = F.when(F.col("_lat").isNotNull(), "manual").when(F.col("lat").isNotNull(), "geocoder")
    return out.withColumn("method", method).withColumn("lat", F.coalesce("_lat", "lat")).withColumn("lon", F.coalesce("_lon", "lon")).drop("_lat", "_lon")


def uncached_queries(queries: DataFrame, cache: DataFrame) -> DataFrame:
    """Distinct query texts that name something and are not in the cache."""
    good = queries.filter(F.size(distinctive_tokens(F.col("query_text"))) > 0).select("query_text").distinct()
    return good.join(cache.select("query_text").distinct(), "query_text", "left_anti")


def consistency_outliers(rows: DataFrame, group: str, limit: float) -> DataFrame:
    """(rec_id, group, no_majority): located records outside the one largest cluster of their group.

    Records within limit of each other link; clusters are the components. If two clusters are the largest, all records of the
    group are outliers; a group of one is left alone. Records of a group at one place are one site; links come from grid cells
    of the group, not from all its pairs.
    """
    from rillwise.functions.geo import utm_xy
    from rillwise.operators.spatial import reached_cells

    own = saved(rows.filter("lat is not null and lon is not null").select("rec_id", F.col(group).alias("g"), "lat", "lon"), "located")
    x, y = utm_xy(F.col("lat"), F.col("lon"))
    sites = own.groupBy("g", "lat", "lon").agg(F.min("rec_id").alias("site"), F.count("*").alias("n"))
    sites = saved(sites.select("*", x.alias("x"), y.alias("y")), "sites")  # the projection is computed once a place
    reach = limit * 1.01  # the plane's scale differs from the ellipsoid's by less
    # of two sites within reach both are within half of it of the cell that holds their middle; a site lies in some two cells
    dealt = reached_cells(sites, F.col("x"), F.col("y"), F.col("x"), F.col("y"), reach / 2, 3 * reach)

    # the plane tells all but those about as far apart as the limit; the ellipsoid is asked for these alone, as it costs far more
    def near(a: list[Column], b: list[Column]) -> Column:
        flat = F.sqrt(F.pow(a[2] - b[2], 2) + F.pow(a[3] - b[3], 2))
        return (flat <= reach) & ((flat <= limit / 1.01) | (geodesic_m(*a[:2], *b[:2]) <= limit))

    def near_all(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
        flat = np.hypot(a[2] - b[2], a[3] - b[3])
        met = flat <= limit / 1.01
        i, j = np.nonzero((flat <= reach) & ~met)
        met[i, j] = geodesic_of(a[0][i, 0], a[1][i, 0], b[0][0, j], b[1][0, j]) <= limit
        return met

    edges = group_links(dealt, ["g", "_cx", "_cy"], "site", ["lat", "lon", "x", "y"], near, near_all)
    alone = sites.select(F.col("site").alias("u"), F.col("site").alias("v"))
    placed = saved(sites.select("site", "g", "lat", "lon", "n").join(connected_components(edges.unionByName(alone)).withColumnRenamed("node", "site"), "site"), "clusters")
    sizes = placed.groupBy("g", "component").agg(F.sum("n").alias("n"))
    alike = sizes.groupBy("g", "n").agg(F.count("*").alias("alike"), F.max("component").alias("component"))
    top = alike.groupBy("g").agg(F.max(F.struct("n", "alike", "component")).alias("m"), F.sum(F.col("n") * F.col("alike")).alias("total"))
    judged = placed.join(top, "g").filter("total > 1").withColumn("no_majority", F.col("m.alike") > 1)
    out = judged.filter(F.col("no_majority") | (F.col("component") != F.col("m.component"))).select("g", "lat", "lon", "no_majority")
    return own.join(out, ["g", "lat", "lon"]).select("rec_id", F.col("g").alias(group), "no_majority")


def first_candidate(cands: DataFrame, keys: list[str], rank: str, carry: list[str]) -> DataFrame:
    return cands.groupBy(*keys).agg(F.min(F.struct(rank, *carry)).alias("b")).select(*keys, "b.*")


def _cleaned(raw: DataFrame) -> DataFrame:
    """raw with query_text, cleaned once for each distinct location."""
    texts = saved(raw.select("location").distinct().withColumn("query_text", clean_query(F.col("location"))), "cleaned-texts")
    return raw.join(F.broadcast(texts) if texts.count() <= TEXTS_SENT else texts, "location", "left")


def texts_to_ask(raw: DataFrame, known: DataFrame) -> DataFrame:
    """query_text of the distinct cleaned texts of raw (location) that name something and are none of those of known (location)."""
    told = [df.select("location").distinct().select(clean_query(F.col("location")).alias("query_text")) for df in (raw, known)]
    return uncached_queries(*told)


def resolve_pockets(raw: DataFrame, cands: DataFrame, manual: DataFrame, inside: Column) -> DataFrame:
    """Places of location texts.

    raw: query_id, location, ward, borough; cands: query_id, rank, cand_id, cand_name, kind, lat, lon, extent_m (repeated ones don't
    matter); manual: query_id, lat, lon that someone has verified. Texts are cleaned, candidates chosen for what is left of
    them, verified positions come first, and records far from the others of their ward, or else of their borough, are marked.
    Returns (query_id, query_text, status, cand_id, method, lat, lon, ward, borough, outlier: ward, borough or null), a row
    for each row of raw.
    """
    texts = saved(_cleaned(raw).select("query_id", "query_text", "ward", "borough"), "cleaned")
    chosen = choose_candidate(cands.join(texts.select("query_id", "query_text"), "query_id"), inside).drop("method")
    placed = texts.join(chosen, "query_id", "left").withColumn("status", F.coalesce("status", F.lit("none")))
    placed = saved(apply_overrides(placed, manual, ["query_id"]), "placed")
    known = placed.filter("lat is not null").select(F.col("query_id").alias("rec_id"), "ward", "borough", "lat", "lon")
    of_ward = saved(consistency_outliers(known, "ward", WARD_M).select(F.col("rec_id").alias("query_id"), F.lit("ward").alias("outlier")), "outliers")
    rest = known.join(of_ward.select(F.col("query_id").alias("rec_id")), "rec_id", "left_anti")
    of_borough = consistency_outliers(rest, "borough", BOROUGH_M).select(F.col("rec_id").alias("query_id"), F.lit("borough").alias("outlier"))
    out = placed.join(of_ward.unionByName(of_borough), "query_id", "left")
    return out.select("query_id", "query_text", "status", "cand_id", "method", "lat", "lon", "ward", "borough", "outlier")


def review_counts(resolved: DataFrame) -> DataFrame:
    """(borough, n, located, manual, outliers, and rows by status) of what resolve_pockets tells."""
    status = [F.count_if(F.col("status") == s).alias(s) for s in STATUSES]
    return resolved.groupBy("borough").agg(F.count("*").alias("n"), F.count("lat").alias("located"), F.count_if(F.col("method") == "manual").alias("manual"), F.count("outlier").alias("outliers"), *status)
