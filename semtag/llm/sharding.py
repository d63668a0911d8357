"""Sharding by a two-pass external shuffle.

Pass one scatters records by seeded hashes: the shard is the key's highest rendezvous hash (so one
more shard takes rows only into itself), and inside a shard a second hash picks one of as many
buckets as keep a bucket near ``bucket_bytes`` in that shard. Pass two Fisher-Yates shuffles every bucket, one task
holding one bucket at a time, and numbers the rows of a shard without gaps.
"""

from __future__ import annotations

import functools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import crc32_text, prepare, table, without


#: Buckets whose first slots are broadcast; more are joined.
MOST_BROADCAST = 200_000


def rendezvous(key: Column, shards: int, seed: int) -> Column:
    """The shard in [0, shards) whose hash with the key is highest, ties to the smaller shard."""
    ranked = [F.struct(F.xxhash64(key, F.lit(s), F.lit(seed)).alias("h"), F.lit(-s).alias("s")) for s in range(shards)]
    return (-F.greatest(*ranked)["s"]).cast("int") if shards > 1 else F.lit(0)


def place(df: DataFrame, key: str, size: str, tie: str | None, shards: int, bucket_bytes: int, seed: int, copies: int) -> DataFrame:
    """df with shard, grown_shard, __bucket and slot; the rows of a bucket lie together."""
    spark = df.sparkSession
    prepare(spark)
    k, order = F.col(key), [key] + ([tie] if tie else [])
    dealt = df.select("*", rendezvous(k, shards, seed).alias("shard"), rendezvous(k, shards + 1, seed).alias("grown_shard"))
    sizes = {r["shard"]: r["bytes"] for r in dealt.groupBy("shard").agg(F.sum(size).alias("bytes")).collect()}
    buckets = [max(1, math.ceil((sizes.get(s) or 0) / bucket_bytes)) for s in range(shards)]
    # of rows that nothing tells apart, many go to buckets at random
    alike = df.groupBy(*order).agg(F.count("*").alias("__copies")).where(F.col("__copies") > copies)
    salt = F.lit(0)
    if max(buckets) > 1 and not alike.isEmpty():
        renamed = alike.select(*[F.col(c).alias(f"__{i}") for i, c in enumerate(order)], "__copies")
        same = functools.reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(f"__{i}")) for i, c in enumerate(order)])
        salt = F.when(F.col("__copies").isNotNull(), F.col("__salt")).otherwise(0)
        # held before it is read twice: a task done again would deal its rows anew
        dealt = dealt.withColumn("__salt", F.floor(F.rand(seed) * 1_000_000)).checkpoint().join(renamed, same, "left")
    bucket = F.pmod(F.xxhash64(*[F.col(c) for c in order], F.lit(seed + 1), salt), F.get(F.lit(buckets), F.col("shard"))).cast("int")
    dealt = dealt.select(*[F.col(f"`{c}`") for c in df.columns], "shard", "grown_shard", bucket.alias("__bucket"))
    out = T.StructType([*dealt.schema.fields, T.StructField("__pos", T.LongType())])

    def shuffle(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([(c, "ascending") for c in order])
        rng = np.random.default_rng([seed, rows["shard"][0].as_py(), rows["__bucket"][0].as_py()])
        at = np.arange(len(rows))
        rng.shuffle(at)  # Fisher-Yates
        return rows.append_column("__pos", pa.array(at)).take(pa.array(np.argsort(at)))

    shuffled = dealt.groupBy("shard", "__bucket").applyInArrow(shuffle, out)
    counts = dealt.groupBy("shard", "__bucket").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(F.col("shard").alias("__s"), F.col("__bucket").alias("__b"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__start"))
    starts = F.broadcast(starts) if sum(buckets) <= MOST_BROADCAST else starts
    joined = shuffled.join(starts, (F.col("shard") == F.col("__s")) & (F.col("__bucket") == F.col("__b")))
    return joined.withColumn("slot", F.col("__start") + F.col("__pos")).drop("__s", "__b", "__start", "__pos")


def assign_shards(
    df: DataFrame,
    key: str = "doc_id",
    size: str = "size",
    tie: str | None = None,
    shards: int = 24,
    bucket_bytes: int = 64 << 20,
    seed: int = 10,
    copies: int = 20_000,
) -> DataFrame:
    """df with ``shard`` int, ``slot`` long (gapless from 0 in its shard) and ``grown_shard`` int.

    Law ``key``: only the key and the number of shards decide a row's shard; ``grown_shard`` is the
    shard with one more of them. Null keys share a shard, which then has more buckets: their number follows each
    shard's own bytes. Repeated rows each get a slot of their own. ``tie`` names a column that, after the key, fixes
    the order a bucket is shuffled from; rows alike in both are interchangeable, and where there are over ``copies``
    of them, they are dealt to the buckets of their shard at random. Input columns of the three added names are replaced.
    """
    placed = place(without(df, "shard", "slot", "grown_shard", "__bucket", "__pos"), key, size, tie, shards, bucket_bytes, seed, copies)
    return placed.select(*[F.col(f"`{c}`") for c in placed.columns if c not in ("shard", "slot", "grown_shard", "__bucket")], "shard", "slot", "grown_shard")


def write_shards(df: DataFrame, path: str, key: str = "doc_id", size: str = "size", tie: str | None = None, shards: int = 24, bucket_bytes: int = 64 << 20, seed: int = 10, copies: int = 20_000) -> None:
    """Write records by shard, as they come out of pass two: ``path/shard=N/...``, whole buckets in slot order, no further shuffle."""
    placed = place(without(df, "shard", "slot", "grown_shard", "__bucket", "__pos"), key, size, tie, shards, bucket_bytes, seed, copies)
    placed.drop("__bucket").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def op10_shard(spark, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 8).cast("long").alias("size"),
        crc32_text(F.col("text")).alias("text_crc32"),
    )
    placed = assign_shards(rows, tie="text_crc32")
    return placed.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")
