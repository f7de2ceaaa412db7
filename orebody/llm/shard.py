"""Sharding by longest-processing-time scheduling: groups that stay together, largest first, each to the least-loaded shard.

A group is the set of rows with one text. The driver's heap never sees every group: a group
of at least 1/(shards * FINE) of all bytes is an item of its own (there can be no more than
shards * FINE of those), and the rest fall by hash into shards * FINE bundles, which are
scheduled as items. So the heap holds at most 2 * shards * FINE items whatever the input.

Slots: an item's rows are dealt to pieces by a hash of each row's number, so that even rows
that are equal in everything are split. There are at most items + PIECES * partitions pieces, which
is also the bound of what the driver adds up and broadcasts.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from .common import parts, written

#: Items per shard, at most twice: the bound of what the driver schedules.
FINE = 100
#: Pieces a shuffle partition into which all rows are split for numbering, besides one an item.
PIECES = 4


def schedule(items: list[tuple[int, int]], shards: int) -> dict[int, int]:
    """Longest processing time first: (item, size) pairs to {item: shard}; ties go to the lower item and shard."""
    heap = [(0, s) for s in range(shards)]
    out = {}
    for item, size in sorted(items, key=lambda x: (-x[1], x[0])):
        load, shard = heap[0]
        out[item] = shard
        heapq.heapreplace(heap, (load + size, shard))
    return out


def assign(docs: DataFrame, shards: int = 40, text: str = "text", overhead: int = 16, fine: int = FINE, keep_text: bool = True) -> DataFrame:
    """The rows of docs with size, text_crc32, shard and slot, and the text unless keep_text is False.

    size is the text's UTF-8 bytes plus ``overhead``; a null text counts as no bytes, is its own
    group apart from the empty text, and has the checksum of no bytes. Repeated rows keep a slot
    each. Slots run from 0 without gaps in a shard; their order is otherwise free. An empty table gives an empty table. Columns of docs named
    as the new ones are replaced; all others pass through. docs are read once: what is needed of
    them, with a number for each row, is written as a table (with the texts only if they are kept).
    """
    spark = docs.sparkSession
    raw = F.col(text)
    docs = docs.drop("size", "text_crc32", "shard", "slot")
    rows = docs.withColumns({
        "size": F.coalesce(F.octet_length(raw), F.lit(0)).cast("long") + overhead,
        "text_crc32": F.crc32(F.coalesce(raw, F.lit("")).cast("binary")),
        "__uid": F.monotonically_increasing_id(), "__k1": F.xxhash64(raw), "__k2": F.xxhash64(F.lit("second"), raw, raw.isNull()),
    })
    rows = written(rows if keep_text else rows.drop(text), "sized")
    groups = rows.groupBy("__k1", "__k2").agg(F.sum("size").alias("__bytes"))
    total = groups.agg(F.coalesce(F.sum("__bytes"), F.lit(0)).cast("long")).first()[0]
    bundles = shards * fine
    least = max(1, total // bundles)
    bundle = F.pmod("__k1", F.lit(bundles)).cast("long")
    large = groups.where(F.col("__bytes") >= least).select("__k1", "__k2", F.lit(True).alias("__large"))
    large = spark.createDataFrame([(r[0], r[1], bundles + i) for i, r in enumerate(large.orderBy("__k1", "__k2").collect())], "__k1 long, __k2 long, __own long")
    rows = rows.join(F.broadcast(large), ["__k1", "__k2"], "left").withColumn("__item", F.coalesce("__own", bundle)).drop("__own")
    sizes = rows.groupBy("__item").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n")).collect()
    to = schedule([(r["__item"], r["bytes"]) for r in sizes], shards)
    each = max(1, -(-sum(r["n"] for r in sizes) // (PIECES * parts(spark))))
    plan = spark.createDataFrame(
        [(r["__item"], to[r["__item"]], -(-r["n"] // each)) for r in sizes],
        StructType([StructField("__item", LongType()), StructField("shard", IntegerType()), StructField("__split", IntegerType())]),
    )
    rows = rows.join(F.broadcast(plan), "__item").withColumn("__piece", F.pmod(F.xxhash64("__uid"), F.col("__split")).cast("int"))
    piece = ["shard", "__item", "__piece"]
    # At most len(sizes) + PIECES * partitions rows.
    counted = rows.groupBy(*piece).agg(F.count(F.lit(1)).alias("__n")).collect()
    start, offsets = dict.fromkeys(range(shards), 0), []
    for r in sorted(counted, key=lambda r: (r["shard"], r["__item"], r["__piece"])):
        offsets.append((r["__item"], r["__piece"], start[r["shard"]]))
        start[r["shard"]] += r["__n"]
    first = spark.createDataFrame(offsets, "__item long, __piece int, __first long")
    order = Window.partitionBy("__item", "__piece").orderBy("__uid")
    rows = rows.withColumn("__at", F.row_number().over(order).cast("long") - 1)
    rows = rows.join(F.broadcast(first), ["__item", "__piece"]).withColumn("slot", F.col("__first") + F.col("__at"))
    return rows.drop("__item", "__piece", "__first", "__at", "__uid", "__split", "__k1", "__k2")


def write_shards(assigned: DataFrame, path: str) -> None:
    """One folder shard=N of Parquet for each shard; a hot shard is written by several tasks."""
    assigned.write.partitionBy("shard").parquet(path)
