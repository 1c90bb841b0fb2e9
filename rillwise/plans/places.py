"""Place resolution queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from rillwise.functions.geo import in_bbox
from rillwise.functions.names import CLEANING, GENERIC, STREET_TYPES, clean_query, distinctive_tokens, name_matches_native
from rillwise.operators import fuzzy as fuzzy_names, places as p
from rillwise.plans.adapters import adapted, adapters_sql
from rillwise.plans.registry import query
from rillwise.store import saved

F_ = 1 / 298.257223563


def lambert(a: str, b: str, c: str, d: str) -> str:
    """SQL of the geodesic distance between (a, b) and (c, d)."""
    b1, b2 = f"atan({1 - F_!r} * tan(radians({a})))", f"atan({1 - F_!r} * tan(radians({c})))"
    q = f"(sin(({b2} - {b1}) / 2) ** 2 + cos({b1}) * cos({b2}) * sin(radians({d} - {b}) / 2) ** 2)"
    s, m, h = f"(2 * asin(sqrt{q}))", f"(({b1} + {b2}) / 2)", f"(({b2} - {b1}) / 2)"
    return f"CASE WHEN {q} = 0 THEN 0 ELSE 6378137.0 * ({s} - {F_ / 2!r} * (({s} - sin({s})) * (sin({m}) * cos({h}) / cos({s} / 2)) ** 2 + ({s} + sin({s})) * (cos({m}) * sin({h}) / sin({s} / 2)) ** 2)) END"


CANDS = adapters_sql("cands")
WORDS = ", ".join(f"'{w}'" for w in GENERIC)
TOKENS = "regexp_extract_all(lower({}), '[a-z0-9]+')"


#: Query texts with slips of the pen, so that tokens are near others without being equal.
SLIPS = "CASE {0} % 6 WHEN 1 THEN replace({1}, 'l', 'll') WHEN 2 THEN replace({1}, 'd', 't') WHEN 3 THEN replace({1}, 'in', 'im') || ' Lane' WHEN 4 THEN replace({1}, 'g', '') || ' street' WHEN 5 THEN '12th ' || upper({1}) || ' Road' ELSE {1} END"
TYPES = "[CASE " + " ".join(f"WHEN t = '{a}' THEN '{b}'" for a, b in STREET_TYPES.items()) + " END FOR t IN {}]"
#: Names that match by the similarity ratio: blocks are found by recursion, for distinct pairs of tokens.
MATCHED = f"""u AS (SELECT DISTINCT * FROM slips), names AS (SELECT DISTINCT query_text, cand_name FROM u),
tk AS (SELECT *, [t FOR t IN {TOKENS.format('query_text')} IF t NOT IN ({WORDS}) AND NOT regexp_full_match(t, '\\d+(st|nd|rd|th)?') AND length(t) > 2] AS want, {TOKENS.format('cand_name')} AS have FROM names),
tp AS (SELECT DISTINCT w, unnest(have) AS h FROM (SELECT unnest(want) AS w, have FROM tk)),
seg AS (SELECT w, h, 0 AS alo, length(w) AS ahi, 0 AS blo, length(h) AS bhi, 0 AS size FROM tp WHERE 2 * least(length(w), length(h)) >= 0.8 * (length(w) + length(h)) UNION ALL
  SELECT w, h, CASE WHEN side = 0 THEN alo ELSE m.k - m.i END, CASE WHEN side = 0 THEN -m.i ELSE ahi END, CASE WHEN side = 0 THEN blo ELSE m.k - m.j END, CASE WHEN side = 0 THEN -m.j ELSE bhi END, CASE WHEN side = 0 THEN m.k ELSE 0 END
  FROM (SELECT *, list_max(flatten(list_transform(range(alo, ahi), lambda a: list_transform(range(blo, bhi), lambda b: {{'k': list_max(list_filter(range(0, least(ahi - a, bhi - b) + 1), lambda z: substr(w, a + 1, z) = substr(h, b + 1, z))), 'i': -a, 'j': -b}})))) AS m FROM seg WHERE alo < ahi AND blo < bhi), (VALUES (0), (1)) s(side) WHERE m.k > 0),
near AS (SELECT w, list(h) AS near FROM (SELECT w, h FROM seg GROUP BY 1, 2 HAVING 2.0 * sum(size) / (length(w) + length(h)) >= 0.8) GROUP BY 1),
each AS (SELECT query_text, cand_name, have, unnest(want) AS w FROM tk),
tokened AS (SELECT query_text, cand_name, bool_and(contains(array_to_string(have, ''), w) OR coalesce(list_has_any(have, near), false)) AS ok FROM each LEFT JOIN near USING (w) GROUP BY 1, 2),
types AS (SELECT query_text, cand_name, list_filter({TYPES.format(TOKENS.format('query_text'))}, lambda x: x IS NOT NULL) AS a, list_filter({TYPES.format(TOKENS.format('cand_name'))}, lambda x: x IS NOT NULL) AS b FROM names),
matched AS (SELECT t.query_text, t.cand_name, coalesce(ok, false) AND (len(a) = 0 OR len(b) = 0 OR list_has_any(a, b)) AS named, len(want) AS distinctive FROM tk t JOIN types USING (query_text, cand_name) LEFT JOIN tokened USING (query_text, cand_name))"""
SLIPPED = f"{CANDS}, slips AS (SELECT * REPLACE ({SLIPS.format('query_id', 'query_text')} AS query_text) FROM cands), {MATCHED}"


def slipped(spark, sf_dir):
    return adapted(spark, sf_dir, "cands").withColumn("query_text", F.expr(SLIPS.format("query_id", "query_text")))


def candidates(spark, sf_dir):
    return slipped(spark, sf_dir).withColumn("rank", F.struct("cand_id", "kind", F.coalesce("extent_m", F.lit(-1.0)).alias("e")))


@query("F8_J25_choose_candidate", f"""WITH RECURSIVE {SLIPPED}, g AS (SELECT u.*, distinctive, lat BETWEEN 22.45 AND 22.70 AND lon BETWEEN 88.20 AND 88.50 AS ins, named AS like_ FROM u JOIN matched USING (query_text, cand_name)),
f AS (SELECT *, ins AND like_ AS named, ins AND like_ AND kind <> 'place' AND coalesce(extent_m, 0) <= 750 AS fine FROM g),
b AS (SELECT query_id, max(distinctive) AS w, count(*) FILTER (ins) AS ni, count(*) FILTER (named) AS nn, count(*) FILTER (fine) AS nf FROM f GROUP BY 1),
o AS (SELECT * FROM f WHERE fine QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY cand_id, kind, coalesce(extent_m, -1)) = 1),
d AS (SELECT f.query_id, max({lambert('o.lat', 'o.lon', 'f.lat', 'f.lon')}) AS spread FROM f JOIN o ON f.query_id = o.query_id WHERE f.fine GROUP BY 1),
s AS (SELECT b.query_id, CASE WHEN w = 0 THEN 'too_generic' WHEN ni = 0 THEN 'outside' WHEN nn = 0 THEN 'name_mismatch' WHEN nf = 0 THEN 'too_vague' WHEN spread > 1000 THEN 'ambiguous' ELSE 'ok' END AS status FROM b LEFT JOIN d USING (query_id))
SELECT s.query_id, status, CASE WHEN status = 'ok' THEN o.cand_id END AS cand_id FROM s LEFT JOIN o USING (query_id)""")
def choose(spark, sf_dir):
    inside = in_bbox(F.col("lat"), F.col("lon"), (88.20, 22.45, 88.50, 22.70))
    return p.choose_candidate(candidates(spark, sf_dir), inside).select("query_id", "status", "cand_id")


@query("J12_apply_overrides", f"WITH {adapters_sql('pockets')} SELECT rec_id, CASE WHEN rec_id % 10 = 0 THEN 'manual' WHEN lat IS NOT NULL THEN 'geocoder' END AS method, round(CASE WHEN rec_id % 10 = 0 THEN 22.5 ELSE lat END, 4) AS lat FROM pockets")
def overrides(spark, sf_dir):
    rows = adapted(spark, sf_dir, "pockets")
    manual = rows.filter("rec_id % 10 = 0").select("rec_id", F.lit(22.5).alias("lat"), F.lit(88.3).alias("lon"))
    return p.apply_overrides(rows, manual, ["rec_id"]).select("rec_id", "method", F.round("lat", 4).alias("lat"))


@query("J13_uncached_queries", f"WITH {CANDS} SELECT DISTINCT query_text FROM cands WHERE query_text NOT IN (SELECT query_text FROM cands WHERE query_id % 5 = 0) AND len([t FOR t IN {TOKENS.format('query_text')} IF t NOT IN ({WORDS}) AND NOT regexp_full_match(t, '\\d+(st|nd|rd|th)?') AND length(t) > 2]) > 0")
def uncached(spark, sf_dir):
    c = adapted(spark, sf_dir, "cands")
    return p.uncached_queries(c, c.filter("query_id % 5 = 0"))


@query("O4_first_candidate", f"WITH {CANDS} SELECT query_id, min(cand_id) AS cand_id FROM cands WHERE kind <> 'place' GROUP BY 1")
def first(spark, sf_dir):
    return p.first_candidate(adapted(spark, sf_dir, "cands").filter("kind <> 'place'"), ["query_id"], "cand_id", [])


@query("P29_name_matches", f"WITH RECURSIVE {SLIPPED} SELECT query_text, cand_name, named, distinctive FROM matched")
def fuzzy(spark, sf_dir):
    """Which names match: every pair of texts that meets, by the similarity ratio of their tokens."""
    found = fuzzy_names.matched_names(slipped(spark, sf_dir), "query_text", "cand_name")
    return found.withColumn("distinctive", F.size(distinctive_tokens(F.col("query_text"))))


@query("P29_native_names", f"""WITH {CANDS}, slips AS (SELECT * REPLACE ({SLIPS.format('query_id', 'query_text')} AS query_text) FROM cands), t AS (SELECT *, [t FOR t IN {TOKENS.format('query_text')} IF t NOT IN ({WORDS}) AND NOT regexp_full_match(t, '\\d+(st|nd|rd|th)?') AND length(t) > 2] AS want, {TOKENS.format('cand_name')} AS have,
list_filter({TYPES.format(TOKENS.format('query_text'))}, lambda x: x IS NOT NULL) AS a, list_filter({TYPES.format(TOKENS.format('cand_name'))}, lambda x: x IS NOT NULL) AS b FROM slips)
SELECT query_id, cand_id, len(want) > 0 AND (len(a) = 0 OR len(b) = 0 OR list_has_any(a, b)) AND len([w FOR w IN want IF contains(array_to_string(have, ''), w) OR len([h FOR h IN have IF levenshtein(w, h) <= greatest(length(w), length(h)) * (1 - 0.8) + 1e-9]) > 0]) = len(want) AS named FROM t""")
def native(spark, sf_dir):
    """The same question by edit distance, as a column expression."""
    c = slipped(spark, sf_dir)
    return c.select("query_id", "cand_id", name_matches_native(F.col("query_text"), F.col("cand_name")).alias("named"))


@query("A25_consistency_outliers", f"""WITH RECURSIVE {adapters_sql('ward_pts')}, e AS (SELECT a.rec_id AS u, b.rec_id AS v FROM ward_pts a JOIN ward_pts b ON a.ward = b.ward AND a.rec_id <> b.rec_id WHERE {lambert('a.lat', 'a.lon', 'b.lat', 'b.lon')} <= 2500),
w AS (SELECT rec_id AS node, rec_id AS root FROM ward_pts UNION SELECT e.v, w.root FROM w JOIN e ON e.u = w.node WHERE w.root < e.v), l AS (SELECT node, min(root) AS c FROM w GROUP BY 1),
z AS (SELECT ward, c, count(*) AS n FROM l JOIN ward_pts ON rec_id = node GROUP BY 1, 2), k AS (SELECT ward, max(n) AS top, sum(n) AS total FROM z GROUP BY 1), t AS (SELECT z.ward, count(*) > 1 AS tie, max(c) AS c FROM z JOIN k ON z.ward = k.ward AND n = top GROUP BY 1)
SELECT rec_id, p.ward, tie AS no_majority FROM ward_pts p JOIN l ON node = rec_id JOIN t ON t.ward = p.ward JOIN k ON k.ward = p.ward WHERE total > 1 AND (tie OR l.c <> t.c)""")
def outliers(spark, sf_dir):
    return p.consistency_outliers(adapted(spark, sf_dir, "ward_pts"), "ward", p.WARD_M)


def outliers_sql(name: str, source: str, group: str, limit: float) -> str:
    """CTEs that end in name (rec_id): records of source (rec_id, lat, lon and the group) outside the one largest cluster of their group."""
    n = name
    return f"""{n}e AS (SELECT a.rec_id AS u, b.rec_id AS v FROM {source} a JOIN {source} b ON a.{group} = b.{group} AND a.rec_id <> b.rec_id AND abs(a.lat - b.lat) < {limit / 100000} AND {lambert('a.lat', 'a.lon', 'b.lat', 'b.lon')} <= {limit}),
{n}w AS (SELECT rec_id AS node, rec_id AS root FROM {source} UNION SELECT x.v, r.root FROM {n}w r JOIN {n}e x ON x.u = r.node WHERE r.root < x.v), {n}l AS (SELECT node, min(root) AS c FROM {n}w GROUP BY 1),
{n}z AS (SELECT {group} AS g, c, count(*) AS n FROM {n}l JOIN {source} ON rec_id = node GROUP BY 1, 2), {n}k AS (SELECT g, max(n) AS top, sum(n) AS total FROM {n}z GROUP BY 1),
{n}t AS (SELECT z.g, count(*) > 1 AS tie, max(c) AS c FROM {n}z z JOIN {n}k k ON z.g = k.g AND n = top GROUP BY 1),
{n} AS (SELECT rec_id FROM {source} p JOIN {n}l l ON l.node = rec_id JOIN {n}t t ON t.g = p.{group} JOIN {n}k k ON k.g = p.{group} WHERE total > 1 AND (tie OR l.c <> t.c))"""


RAW = "CASE query_id % 4 WHEN 0 THEN '46, ' || {0} || ' (portion)' WHEN 1 THEN {0} || ' near Park & Other' WHEN 2 THEN 'jn. ' || {0} ELSE {0} END"


def _cleaned_sql(text: str) -> str:
    for pattern, put in CLEANING:
        text = f"regexp_replace({text}, '{pattern}', '{put}', 'g')"
    return f"trim({text}, ' ,.-')"


POCKET_TEXTS = f"""{CANDS}, raw AS (SELECT DISTINCT query_id, {RAW.format(SLIPS.format('query_id', 'query_text'))} AS location, query_id % 72 AS ward, query_id % 9 AS borough FROM cands),
texts AS (SELECT query_id, {_cleaned_sql('location')} AS query_text, ward, borough FROM raw), slips AS (SELECT c.* REPLACE (t.query_text AS query_text) FROM cands c JOIN texts t USING (query_id)), {MATCHED}"""
RESOLVED = f"""{POCKET_TEXTS}, g AS (SELECT u.*, distinctive, lat BETWEEN 22.45 AND 22.70 AND lon BETWEEN 88.20 AND 88.50 AS ins, named AS like_ FROM u JOIN matched USING (query_text, cand_name)),
f AS (SELECT *, ins AND like_ AS named, ins AND like_ AND kind <> 'place' AND coalesce(extent_m, 0) <= 750 AS fine FROM g),
b AS (SELECT query_id, max(distinctive) AS w, count(*) FILTER (ins) AS ni, count(*) FILTER (named) AS nn, count(*) FILTER (fine) AS nf FROM f GROUP BY 1),
o AS (SELECT * FROM f WHERE fine QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY cand_id, kind, coalesce(extent_m, -1)) = 1),
d AS (SELECT f.query_id, max({lambert('o.lat', 'o.lon', 'f.lat', 'f.lon')}) AS spread FROM f JOIN o ON f.query_id = o.query_id WHERE f.fine GROUP BY 1),
st AS (SELECT t.query_id, t.query_text, ward, borough, CASE WHEN w = 0 THEN 'too_generic' WHEN ni = 0 THEN 'outside' WHEN nn = 0 THEN 'name_mismatch' WHEN nf = 0 THEN 'too_vague' WHEN spread > 1000 THEN 'ambiguous' WHEN w IS NOT NULL THEN 'ok' ELSE 'none' END AS status FROM texts t LEFT JOIN b USING (query_id) LEFT JOIN d USING (query_id)),
pl AS (SELECT st.query_id AS rec_id, st.query_text, status, CASE WHEN status = 'ok' THEN o.cand_id END AS cand_id, ward, borough, CASE WHEN st.query_id % 40 = 0 THEN 'manual' WHEN status = 'ok' THEN 'geocoder' END AS method,
  CASE WHEN st.query_id % 40 = 0 THEN 22.5 + (st.query_id % 997) / 10000.0 WHEN status = 'ok' THEN round(o.lat, 6) END AS lat, CASE WHEN st.query_id % 40 = 0 THEN 88.3 + (st.query_id % 991) / 10000.0 WHEN status = 'ok' THEN round(o.lon, 6) END AS lon FROM st LEFT JOIN o USING (query_id)),
kn AS (SELECT rec_id, ward, borough, lat, lon FROM pl WHERE lat IS NOT NULL), {outliers_sql('ow', 'kn', 'ward', p.WARD_M)}, kr AS (SELECT * FROM kn WHERE rec_id NOT IN (SELECT rec_id FROM ow)), {outliers_sql('ob', 'kr', 'borough', p.BOROUGH_M)},
rs AS (SELECT pl.*, CASE WHEN rec_id IN (SELECT rec_id FROM ow) THEN 'ward' WHEN rec_id IN (SELECT rec_id FROM ob) THEN 'borough' END AS outlier FROM pl)"""
COUNTED = ", ".join(f"count(*) FILTER (status = '{x}') AS {x}" for x in p.STATUSES)


def location_texts(spark, sf_dir):
    """query_id and location of all texts; a row for each candidate."""
    return adapted(spark, sf_dir, "cands").select("query_id", F.expr(RAW.format(SLIPS.format("query_id", "query_text"))).alias("location"))


def resolved_pockets(spark, sf_dir):
    c, q = adapted(spark, sf_dir, "cands"), F.col("query_id")
    raw = location_texts(spark, sf_dir).distinct().withColumns({"ward": q % 72, "borough": q % 9})
    raw = saved(raw, "texts-asked")
    manual = raw.filter("query_id % 40 = 0").select("query_id").distinct().select("query_id", (22.5 + q % 997 / 10000.0).alias("lat"), (88.3 + q % 991 / 10000.0).alias("lon"))
    ranked = c.drop("query_text").withColumn("rank", F.struct("cand_id", "kind", F.coalesce("extent_m", F.lit(-1.0)).alias("e")))
    return p.resolve_pockets(raw, ranked, manual, in_bbox(F.col("lat"), F.col("lon"), (88.20, 22.45, 88.50, 22.70)))


@query("E10_resolve_pockets", f"WITH RECURSIVE {RESOLVED} SELECT rec_id AS query_id, query_text, status, cand_id, method, round(lat, 5) AS lat, round(lon, 5) AS lon, outlier FROM rs")
def resolve(spark, sf_dir):
    """Every location text with its place: cleaned, matched, chosen, overridden and judged by its ward and borough."""
    return resolved_pockets(spark, sf_dir).select("query_id", "query_text", "status", "cand_id", "method", F.round("lat", 5).alias("lat"), F.round("lon", 5).alias("lon"), "outlier")


@query("E10_A18_review_counts", f"WITH RECURSIVE {RESOLVED} SELECT borough, count(*) AS n, count(lat) AS located, count(*) FILTER (method = 'manual') AS manual, count(outlier) AS outliers, {COUNTED} FROM rs GROUP BY 1")
def review(spark, sf_dir):
    """What is left to review, by borough."""
    return p.review_counts(resolved_pockets(spark, sf_dir))


@query("E10_J13_texts_to_ask", f"WITH RECURSIVE {POCKET_TEXTS} SELECT DISTINCT query_text FROM matched WHERE distinctive > 0 AND query_text NOT IN (SELECT query_text FROM texts WHERE query_id % 5 = 0)")
def to_ask(spark, sf_dir):
    """Cleaned texts that name something and that no earlier answer is known for."""
    asked = location_texts(spark, sf_dir).select("location", (F.col("query_id") % 5 == 0).alias("known"))
    asked = saved(asked.distinct(), "locations")
    return p.texts_to_ask(asked, asked.filter("known"))
