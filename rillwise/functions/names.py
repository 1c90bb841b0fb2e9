"""Place names: cleaning, tokens and fuzzy matching."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Words that do not identify a place on their own, and street types with their common name.
GENERIC = (
    "road rd lane ln street st sarani sarak avenue ave row place bye main no the of and near bustee colony park block bl area gali "
    "kolkata calcutta east west north south new old village portion part crossing more station garden gardens nagar pally palli para "
    "bagan abasan housing project scheme phase market bazar bazaar township terrace path"
).split()
STREET_TYPES = {
    "road": "road", "rd": "road", "lane": "lane", "ln": "lane", "street": "street", "st": "street", "place": "place", "row": "row",
    "avenue": "avenue", "ave": "avenue", "sarani": "sarani", "sarak": "sarani", "terrace": "terrace",
}
RATIO = 0.8


# Words before another place, words that name nothing (both as patterns, in any case), street types cut short,
# and what a premises number looks like.
BESIDE = (r"near", r"beside", r"opp\.?", r"opposite", r"infront of", r"in front of", r"towards")
EMPTY = (r"portion", r"part", r"jn\.?", r"junction of", r"crossing of")
SHORT = {"Rd": "Road", "St": "Street", "Ln": "Lane"}
PREMISES = r"\d[0-9A-Za-z/\-]*"
#: The rules in their order: what is found, and what stands there then. A rule that ends a text takes all that follows.
CLEANING = (
    (r"\([^)]*\)?", " "),
    (r"(?s)(\s*&|\s+and\s+[A-Z]).*", ""),
    (rf"(?is)\s+({'|'.join(BESIDE)})\s.*", ""),
    (rf"(?i)\b({'|'.join(EMPTY)})\b", " "),
    (rf"^\s*({PREMISES}\s*,\s*)+({PREMISES}\s+)?", ""),
    *((rf"\b{short}\b\.?", long) for short, long in SHORT.items()),
    (r"\s+", " "),
)


def clean_query(c: Column) -> Column:
    """The first place a location text names, with street types written out.

    Brackets are dropped, also one that isn't closed; the text ends before an ampersand, before an "and" that a capital
    follows and before a word of BESIDE between white space; words of EMPTY are dropped; premises numbers go where each is
    followed by a comma, and one number after them. Words end at any character that is no letter, digit or underscore.
    """
    for pattern, put in CLEANING:
        c = F.regexp_replace(c, "(?U)" + pattern, put)
    return F.trim(c, F.lit(" ,.-"))


def tokens(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(c), F.lit("([a-z0-9]+)"))


def distinctive_tokens(c: Column) -> Column:
    """Tokens that are neither generic nor ordinal and have more than two characters."""
    return F.filter(tokens(c), lambda t: ~t.isin(*GENERIC) & ~t.rlike(r"^\d+(st|nd|rd|th)?$") & (F.length(t) > 2))


def street_types(c: Column) -> Column:
    named = F.create_map(*[F.lit(x) for pair in STREET_TYPES.items() for x in pair])
    return F.array_distinct(F.filter(F.transform(tokens(c), lambda t: named[t]), lambda t: t.isNotNull()))


def street_types_agree(q: Column, name: Column) -> Column:
    a, b = street_types(q), street_types(name)
    return (F.size(a) == 0) | (F.size(b) == 0) | F.arrays_overlap(a, b)


def name_matches_native(q: Column, name: Column) -> Column:
    """Names match where every distinctive token is near one of the name by edit distance (at most a fifth of the longer), or in the name's joined tokens.

    A column expression beside rillwise.operators.fuzzy.matched_names, which goes by the similarity ratio: other at the margin.
    """
    have = tokens(name)
    joined = F.array_join(have, "")
    near = lambda w: F.exists(have, lambda h: F.levenshtein(w, h) <= F.greatest(F.length(w), F.length(h)) * (1 - RATIO) + 1e-9)
    want = distinctive_tokens(q)
    return (F.size(want) > 0) & F.forall(want, lambda w: F.contains(joined, w) | near(w)) & street_types_agree(q, name)
