"""Sharding by Karmarkar-Karp differencing.

Equal texts are one indivisible group. Differencing repeatedly takes the two partial partitions with the
largest spreads and joins them oppositely ordered, largest part to smallest part.

It runs in two places. On the driver: over the heavy groups, those with more than one part in
``shards * HEAVY`` of all bytes or of all rows, of which there can be at most ``2 * shards * HEAVY``. In
tasks: over each bucket of about ``BUCKET_GROUPS`` other groups together with the bucket's share of the
heavy groups' partition, scaled to the bucket's bytes. Joining never puts two parts of one partition
together, so each final part of a bucket holds exactly one part of the heavy partition and takes its
shard; the buckets thus fill, evenly, what the heavy groups leave open.

Documents meet their group's shard by a broadcast of the heavy groups and a shuffle join for the rest, in
which no key has more than its one part in ``shards * HEAVY`` of the rows. Slots are numbered by bucket.

Cases: null texts are one group, of size 8 each. Equal sizes are taken in the order of the text's digest,
so a run is reproducible. Repeated rows keep a slot each. A group larger than a shard's share fills its
shard alone. An empty table gives no rows. Of the input only doc_id and text are read.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventfold.llm.common import Written, crc32_text, numbered, table

SHARDS = 24
OVERHEAD = 8
HEAVY = 64
BUCKET_GROUPS = 8192


def differencing(sizes: np.ndarray, parts: int, given: np.ndarray | None = None) -> np.ndarray:
    """The part of each size. ``given`` is a partition to start from: its parts keep their numbers."""
    rows = np.zeros((len(sizes) + (given is not None), parts), "i8")
    rows[: len(sizes), 0] = sizes
    named = np.arange(parts)
    if given is not None:
        named = np.argsort(-given, kind="stable")
        rows[-1] = given[named]
    agenda = [(int(r[-1] - r[0]), k) for k, r in enumerate(rows)]
    heapq.heapify(agenda)
    sums, joins = list(rows), []
    while len(agenda) > 1:
        _, a = heapq.heappop(agenda)
        _, b = heapq.heappop(agenda)
        joined = sums[a] + sums[b][::-1]
        order = np.argsort(-joined, kind="stable")
        joined = joined[order]
        joins.append((a, b, order))
        heapq.heappush(agenda, (int(joined[-1] - joined[0]), len(sums)))
        sums[a] = sums[b] = None
        sums.append(joined)
    labels: dict[int, np.ndarray] = {len(sums) - 1: np.arange(parts)}
    for k in range(len(joins) - 1, -1, -1):
        a, b, order = joins[k]
        own = labels.pop(len(rows) + k)
        labels[a], labels[b] = np.empty(parts, "i8"), np.empty(parts, "i8")
        labels[a][order] = own
        labels[b][parts - 1 - order] = own
    if given is not None:
        back = np.empty(parts, "i8")
        back[labels[len(sizes)]] = named
        return np.array([back[labels[k][0]] for k in range(len(sizes))], "i8")
    return np.array([labels[k][0] for k in range(len(sizes))], "i8")


def shard(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, shard and slot of every document."""
    spark = docs.sparkSession
    written = Written(spark, "sharding")
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + OVERHEAD
    key = F.coalesce(F.substring(F.unhex(F.sha2(F.col("text").cast("binary"), 256)), 1, 16), F.lit(b""))
    digests = written.put(docs.select("doc_id", size.alias("size"), crc32_text("text").alias("text_crc32"), key.alias("key")), "digests")
    groups = written.put(digests.groupBy("key").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows")), "groups")
    n_bytes, n_rows, n_groups = (int(x or 0) for x in groups.agg(F.sum("bytes"), F.sum("rows"), F.count("*")).first())
    is_heavy = (F.col("bytes") * (shards * HEAVY) > n_bytes) | (F.col("rows") * (shards * HEAVY) > n_rows)
    heavy = sorted(((r["bytes"], bytes(r["key"])) for r in groups.where(is_heavy).collect()), reverse=True)
    sizes = np.array([x[0] for x in heavy], "i8")
    heavy_shards = differencing(sizes, shards) if heavy else np.zeros(0, "i8")
    taken = np.bincount(heavy_shards, sizes, shards).astype("i8")
    open_bytes = max(1, n_bytes - int(taken.sum()))
    buckets = 1 + n_groups // BUCKET_GROUPS

    def split(bucket: pd.DataFrame) -> pd.DataFrame:
        bucket = bucket.sort_values(["bytes", "key"], ascending=False, ignore_index=True)
        share = np.array([t * int(bucket["bytes"].sum()) // open_bytes for t in taken.tolist()], "i8")
        return pd.DataFrame({"key": bucket["key"], "shard": differencing(bucket["bytes"].to_numpy("i8"), shards, share).astype("i4")})

    light = groups.where(~is_heavy).withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(buckets))).groupBy("bucket").applyInPandas(split, "key binary, shard int")
    named = F.broadcast(spark.createDataFrame([(bytearray(k), int(s)) for (_, k), s in zip(heavy, heavy_shards, strict=True)], "key binary, shard int"))
    placed = digests.join(named, "key").unionByName(digests.join(named, "key", "left_anti").join(light, "key"))
    placed = written.put(placed.select("doc_id", "size", "text_crc32", "shard"), "placed")
    written.drop("digests", "groups")
    return numbered(placed, "shard", ["doc_id", "text_crc32"], ["doc_id", "text_crc32", "size"], "slot", n_rows)


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 24 shards of near equal bytes."""
    out = shard(table(spark, sf_dir, "documents", "doc_id", "text"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
