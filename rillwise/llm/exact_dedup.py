"""Exact deduplication by a stream over keyed state (native operations only).

The stream keeps one state row for each digest, in RocksDB on the executors' disks and without expiry: how often it came,
the row that stays (largest doc_id) and where its content lies. No text enters the state. Digests seen more than once are
hits: a bounded bitmap of them goes to the texts, and those that may be hits are grouped by digest and full text, whose
copies collapse before the shuffle. Other texts don't move.
"""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, functions as F

from rillwise.llm.bitmap import may_hold
from rillwise.llm.text import content_key as digest
from rillwise.store import saved, scratch

STATE = {
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "200",
    "spark.sql.streaming.stateStore.rocksdb.writeBufferSizeMB": "4",
}


@contextmanager
def _settings(spark: SparkSession, conf: dict[str, str]):
    old = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def digest_state(keys: DataFrame, checkpoint: str, updates: str) -> DataFrame:
    """Run a stream of (digest, doc_id, row_tag, locator) until all that is available is in the state.

    Returns (digest, group_size, keep): keep is the struct (doc_id, row_tag, locator) of the row that stays. Given the
    same checkpoint and updates folders, a later call goes on from the state that is there.
    """
    spark = keys.sparkSession
    state = keys.groupBy("digest").agg(F.count("*").alias("group_size"), F.max(F.struct("doc_id", "row_tag", "locator")).alias("keep"))
    schema = state.schema

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{updates}/batch={number}")

    with _settings(spark, STATE):
        query = state.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        query.awaitTermination()
    written = spark.read.schema(schema).option("basePath", updates).option("recursiveFileLookup", "true").parquet(updates)
    return written.groupBy("digest").agg(F.max("group_size").alias("group_size"), F.max("keep").alias("keep"))


def exact_dedup(docs: DataFrame) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256, locator: one row for each row of docs, of which only doc_id and text are read.

    The locator is the file and place in the digest table (row_tag) of the row that stays; a very long text costs one digest.
    Equal texts form a group, of which the row with the largest doc_id stays (nulls are least; of rows that agree in doc_id
    too, one). A null text counts as empty. An empty table gives an empty result. Other columns have no influence.
    """
    spark = docs.sparkSession
    rows = docs.select(
        digest(F.col("text")).alias("digest"), F.col("doc_id"), F.monotonically_increasing_id().alias("row_tag"), F.input_file_name().alias("locator")
    )
    incoming = scratch(spark, "digests")
    rows.write.parquet(incoming)
    arriving = spark.readStream.schema(rows.schema).option("maxBytesPerTrigger", 4 << 30).parquet(incoming)
    state = saved(digest_state(arriving, scratch(spark, "dedup-state"), scratch(spark, "dedup-updates")), "dedup")
    rows = spark.read.schema(rows.schema).parquet(incoming)

    text = F.coalesce(F.col("text"), F.lit("")).alias("text")
    hits = saved(state.filter("group_size > 1").select("digest", "group_size"), "hits")
    met = may_hold(docs.select(digest(F.col("text")).alias("digest"), text), F.col("digest"), hits, "digest")
    same = met.groupBy("digest", "text").agg(F.count("*").alias("n"))
    differ = same.join(hits, "digest").filter("n <> group_size").select("digest").distinct()
    if differ.isEmpty():
        out = rows.join(state, "digest")
    else:  # different texts of one digest: group by the texts themselves
        full = docs.select(digest(F.col("text")).alias("digest"), "doc_id", F.input_file_name().alias("locator"), text)
        full = saved(full.withColumn("row_tag", F.monotonically_increasing_id()), "texts")
        exact = full.groupBy("digest", "text").agg(F.count("*").alias("group_size"), F.max(F.struct("doc_id", "row_tag", "locator")).alias("keep"))
        out = full.join(exact, ["digest", "text"]).drop("text")
    return out.select(
        "doc_id",
        F.col("keep.doc_id").alias("keep_id"),
        F.col("group_size"),
        (F.col("row_tag") == F.col("keep.row_tag")).alias("kept"),
        F.col("digest").alias("text_sha256"),
        F.col("keep.locator").alias("locator"),
    )


def drop_copies(docs: DataFrame) -> DataFrame:
    """The rows of docs that stay, with all their columns. Repeated rows (equal doc_id and text) leave one row."""
    found = saved(exact_dedup(docs), "copies")
    gone = found.filter("not kept").select(F.col("doc_id").alias("_doc_id"), F.col("text_sha256").alias("_digest"))
    again = saved(gone.join(found.filter("kept"), F.col("_doc_id").eqNullSafe(F.col("doc_id")) & (F.col("_digest") == F.col("text_sha256"))).select("_doc_id", "_digest").distinct(), "repeats")
    tagged = docs.withColumn("_key", digest(F.col("text")))
    left = tagged.join(gone, F.col("doc_id").eqNullSafe(F.col("_doc_id")) & (F.col("_key") == F.col("_digest")), "left_anti")
    if not again.isEmpty():
        repeated = tagged.join(again, F.col("doc_id").eqNullSafe(F.col("_doc_id")) & (F.col("_key") == F.col("_digest")), "left_semi")
        left = left.unionByName(repeated.dropDuplicates(["doc_id", "_key"]))
    return left.select(*docs.columns)


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the copy that stays."""
    return exact_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


ORACLE = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""
