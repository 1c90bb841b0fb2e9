"""Secret scans by an incremental blob ledger.

Every version of a content is a blob, named by the digest of its bytes. The ledger holds the (blob, rule version) pairs
that were scanned, and the findings. A scan reads only unseen pairs: each new blob once, however many paths hold it, and
old blobs only under new rule versions. Digests decide what is unseen; a bounded bitmap of the unseen ones goes to the
texts, so that only texts to be scanned (and few others) move. Findings are then joined back to all paths.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.utils import AnalysisException

from rillwise.llm import text as tx
from rillwise.llm.bitmap import may_hold
from rillwise.store import saved, scratch


@dataclass(frozen=True)
class Rule:
    """Matches of pattern whose group is at least `least` long; version follows from all of these."""

    kind: str
    pattern: str
    least: int
    group: int = 0
    ignore_case: bool = False
    #: Lower-case texts of which one is in every match (in lower case); none: always looked for.
    hints: tuple[str, ...] = ()

    @property
    def version(self) -> str:
        return hashlib.sha256(repr((self.kind, self.pattern, self.least, self.group, self.ignore_case)).encode()).hexdigest()[:16]


# The patterns of the contract, in its order.
BASE = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 12, 2, True, ("passw", "secret", "token", "api")),
    Rule("access", r"AKIA[A-Z0-9]+", 18, 0, False, ("akia",)),
    Rule("hex", r"[0-9a-f]+", 16),
)
MORE = (
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----[A-Za-z0-9+/=\s]*(?:-----END [A-Z ]*PRIVATE KEY-----)?", 1, hints=("private key",)),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 1, hints=("eyj",)),
    Rule("prefixed", r"\b(?:gh[pousr]_[A-Za-z0-9]{30,}|xox[abprs]-[A-Za-z0-9-]{20,}|sk_live_[A-Za-z0-9]{16,}|glpat-[A-Za-z0-9_-]{20,})", 1, hints=("gh", "xox", "sk_live_", "glpat-")),
    Rule("url_login", r"\b[a-z][a-z0-9+.-]{1,20}://[^\s:/@]{1,64}:([^\s:/@]{3,128})@", 3, 1, False, ("://",)),
)
RULES = BASE + MORE


def _compiled(rule: Rule) -> re.Pattern:
    return re.compile(rule.pattern, re.ASCII | (re.IGNORECASE if rule.ignore_case else 0))


_LONG_HEX = re.compile(r"[0-9a-f]{16}")


def rule_spans(text: str, rules: tuple[Rule, ...]) -> list[tuple[Rule, int, int]]:
    """(rule, start, end) of each match in code points, leftmost and non-overlapping for each rule; too short ones are dropped."""
    out, low = [], text.lower()
    for rule in rules:
        if rule.hints and not any(h in low for h in rule.hints) or rule.kind == "hex" and not _LONG_HEX.search(text):
            continue
        out += [(rule, m.start(), m.end()) for m in _patterns(rule).finditer(text) if len(m[rule.group]) >= rule.least]
    return out


def find_spans(text: str, rules: tuple[Rule, ...]) -> list[tuple[str, int, int]]:
    """As rule_spans, with the rules' kinds."""
    return [(rule.kind, start, end) for rule, start, end in rule_spans(text, rules)]


_cache: dict[Rule, re.Pattern] = {}


def _patterns(rule: Rule) -> re.Pattern:
    return _cache.get(rule) or _cache.setdefault(rule, _compiled(rule))


def _read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException:  # nothing has been written there yet
        return spark.createDataFrame([], schema)


LEDGER = "blob string, version string"
FINDINGS = "blob string, version string, kind string, start long, end long"


def _digests(files: DataFrame, text: str) -> DataFrame:
    return files.select(tx.content_key(F.col(text)).alias("blob"), F.coalesce(F.col(text), F.lit("")).alias("text"))


def scan(files: DataFrame, ledger: str, rules: tuple[Rule, ...] = RULES, text: str = "text") -> DataFrame:
    """(blob, kind, start, end) of all findings in the contents of files under these rules; `ledger` is the folder that remembers them.

    Scans only pairs that the ledger lacks and appends them, findings first: a run that is lost in between is scanned again
    and its findings count once. Offsets are code points, the end is exclusive. Files without text have no findings.
    Repeated rows are one blob; a very long text is one blob, scanned in one task. Rules of one kind have versions of their own.
    """
    spark = files.sparkSession
    tx.small_batches(spark)
    versions = spark.createDataFrame([(r.version, i) for i, r in enumerate(rules)], "version string, rule int")
    seen = _read(spark, f"{ledger}/seen", LEDGER).join(F.broadcast(versions), "version").select("blob", "version").distinct()
    done = seen.groupBy("blob").agg(F.collect_set("version").alias("done"))  # no more than there are rules
    own = _digests(files, text)
    lacking = own.select("blob").distinct().join(done, "blob", "left").filter(F.size(F.coalesce("done", F.array().cast("array<string>"))) < len(rules))
    todo = saved(lacking, "unseen")
    contents = may_hold(own, F.col("blob"), todo, "blob").groupBy("blob").agg(F.min("text").alias("text"))  # copies are one before they move
    unseen = contents.join(todo, "blob")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for blob, content, done in zip(batch["blob"], batch["text"], batch["done"]):
                new = tuple(r for r in rules if done is None or r.version not in done)
                out += [(blob, rule.version, rule.kind, start, end) for rule, start, end in rule_spans(content, new)]
                out += [(blob, r.version, None, None, None) for r in new]
            yield pd.DataFrame(out, columns=["blob", "version", "kind", "start", "end"]).astype({"start": "Int64", "end": "Int64"})

    fresh = saved(unseen.select("blob", "text", "done").mapInPandas(run, FINDINGS), "scanned")
    fresh.filter("kind is not null").write.mode("append").parquet(f"{ledger}/findings")
    fresh.filter("kind is null").select("blob", "version").write.mode("append").parquet(f"{ledger}/seen")
    found = _read(spark, f"{ledger}/findings", FINDINGS).join(F.broadcast(versions.drop("rule")), "version")
    return found.select("blob", "kind", "start", "end").distinct()


def findings_by_path(files: DataFrame, found: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """keys, blob and spans (kind, start, end; by start, then as rules come) of every row of files, found or not."""
    order = F.create_map(*[F.lit(x) for i, r in enumerate(RULES) for x in (r.kind, i)])
    spans = found.groupBy("blob").agg(F.array_sort(F.collect_list(F.struct("start", order[F.col("kind")].alias("rule"), "end", "kind"))).alias("spans"))
    spans = saved(spans, "spans")  # both sides of the join are plain exchanges then, and a blob that many paths hold can be split
    paths = files.select(*keys, tx.content_key(F.col(text)).alias("blob"))
    return paths.join(spans, "blob", "left").withColumn("spans", F.coalesce("spans", F.array().cast(spans.schema["spans"].dataType)))


def arrivals(docs: DataFrame, parts: int = 2) -> list[DataFrame]:
    """What is there after each of so many arrivals: rows arrive by a hash of doc_id, and stay. The last is docs."""
    turn = F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.lit(parts))
    return [*(docs.filter(turn <= k) for k in range(parts - 1)), docs]


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its findings, by a ledger that has seen half of the rows before the whole table comes."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    ledger = scratch(spark, "secrets")
    for there in arrivals(docs):
        found = scan(there, ledger)
    found = findings_by_path(docs, found, ["doc_id"])
    kinds = [r.kind for r in BASE]
    line = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    base = F.filter("spans", lambda x: x["kind"].isin(kinds))
    count = lambda kind: F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *map(count, kinds), F.sha2(line(base).cast("binary"), 256).alias("base_sha256"), line(F.col("spans")).alias("spans"))
