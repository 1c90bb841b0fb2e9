"""A bounded bitmap of keys: a filter in front of a join, which lets through all rows that may meet and few others.

The bitmap has SLOTS bits however many keys there are: with more keys it lets more through, never less. So it may be
broadcast whatever the data, and what it lets through still has to be joined.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

#: Bits of a bitmap (8 MB), and of one of its pages (what Spark's bitmap functions put in one row).
SLOTS = 1 << 26
PAGE = 1 << 15


def _slot(key: Column) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(SLOTS)).cast("long")


def pages(keys: DataFrame, key: str) -> DataFrame:
    """(page, bits): SLOTS / PAGE rows at most. Null keys are left out."""
    slot = _slot(F.col(key))
    marked = keys.filter(F.col(key).isNotNull()).select(F.floor(slot / PAGE).cast("int").alias("page"), (slot % PAGE).alias("bit"))
    return marked.groupBy("page").agg(F.bitmap_construct_agg("bit").alias("bits"))


def flagged(rows: DataFrame, key: Column, keys: DataFrame, name: str, flag: str) -> DataFrame:
    """rows with a flag: whether their key may be in column name of keys (of keys that are not, few have it). No row moves: the bitmap goes to them."""
    slot = _slot(key)
    bit = slot % PAGE
    found = rows.join(F.broadcast(pages(keys, name).withColumnRenamed("page", "_page").withColumnRenamed("bits", "_bits")), F.floor(slot / PAGE).cast("int") == F.col("_page"), "left")
    byte = F.conv(F.hex(F.substring(F.col("_bits"), (bit / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    held = F.pmod(F.floor(byte / F.pow(F.lit(2), bit % 8)), F.lit(2)) == 1
    return found.withColumn(flag, F.coalesce(held, F.lit(False))).drop("_page", "_bits")


def may_hold(rows: DataFrame, key: Column, keys: DataFrame, name: str) -> DataFrame:
    """The rows whose key is in column name of keys, and few others."""
    return flagged(rows, key, keys, name, "_held").filter("_held").drop("_held")


def collected(keys: DataFrame, name: str) -> np.ndarray:
    """The bits of 64-bit whole numbers as bytes of 8, for tasks in Python (SLOTS / 8 bytes, whatever the data)."""
    out = np.zeros(SLOTS // 8, np.uint8)
    # the numbers are hashes already: their lowest bits are the slot
    slot = F.col(name).bitwiseAND(F.lit(SLOTS - 1))
    marked = keys.filter(F.col(name).isNotNull()).select(F.floor(slot / PAGE).cast("int").alias("page"), (slot % PAGE).alias("bit"))
    for row in marked.groupBy("page").agg(F.bitmap_construct_agg("bit").alias("bits")).collect():  # SLOTS bits at most
        page = np.frombuffer(bytes(row["bits"]), np.uint8)
        out[row["page"] * (PAGE // 8) : (row["page"] + 1) * (PAGE // 8)] = page
    return out


def holds(bits: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Which of these 64-bit numbers may be in the collected bitmap."""
    slot = (x & np.uint64(SLOTS - 1)).astype(np.int64)
    return (bits[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1 > 0
