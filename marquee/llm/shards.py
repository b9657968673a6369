"""Sharding by fixed virtual slots and a versioned slot-to-shard map.

Every row is hashed into one of ``SLOTS`` virtual slots. Bytes and rows are summed per slot, and a table says which shard owns
which slot. Rebalancing edits the stored table and nothing else: the latest version is loaded, shards above the mean release slots, which
go to the shards with the least bytes, and the new map is published as the next version beside the old ones. The map has ``SLOTS`` rows at any size
of the data, which is what bounds the part that passes through the driver and the broadcast.
"""

from __future__ import annotations

import heapq

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import scratch_path
from .common import stored

SLOTS = 4096
MAP_SCHEMA = T.StructType(
    [T.StructField("version", T.IntegerType()), T.StructField("virtual_slot", T.IntegerType()), T.StructField("shard", T.IntegerType()), T.StructField("bytes", T.LongType()), T.StructField("rows", T.LongType())]
)


def virtual_slot(*keys: Column, slots: int = SLOTS) -> Column:
    parts = [F.coalesce(k.cast("string"), F.lit("")) for k in keys]
    return (F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 8), 16, 10).cast("long") % slots).cast("int")


def rebalanced(owner: np.ndarray, weight: np.ndarray, shards: int) -> np.ndarray:
    """``owner`` with about as little weight moved as brings the shards near the mean weight.

    Each shard keeps its heaviest slots while they fit below the mean and releases the others (those of shards that no longer
    exist too); released slots go, heaviest first, to the lightest shard. Ties go to the smaller slot and shard.
    """
    owner, mean = owner.copy(), weight.sum() / shards
    load, free = np.zeros(shards), []
    order = sorted(range(len(owner)), key=lambda s: (-weight[s], s))
    for s in order:
        if 0 <= owner[s] < shards and load[owner[s]] + weight[s] <= mean:
            load[owner[s]] += weight[s]
        elif weight[s] > 0 or not 0 <= owner[s] < shards:
            free.append(s)
    heap = [(load[i], i) for i in range(shards)]
    heapq.heapify(heap)
    for s in free:
        least, shard = heapq.heappop(heap)
        owner[s] = shard
        heapq.heappush(heap, (least + weight[s], shard))
    return owner


class SlotMap:
    """The stored versions of a slot-to-shard map: one Parquet folder per version, never changed once it is complete.

    The marker that Spark writes last publishes a version; what a failed run has left without one is not a version, and is
    replaced by the next run.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def latest(self) -> int | None:
        """The number of the last published version."""
        jvm = self.spark.sparkContext._jvm
        marks = jvm.org.apache.hadoop.fs.Path(f"{self.path}/version=*/_SUCCESS")
        found = marks.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).globStatus(marks) or []
        return max((int(f.getPath().getParent().getName().split("=")[1]) for f in found), default=None)

    def owners(self, version: int, slots: int) -> np.ndarray:
        """Shard of each virtual slot."""
        rows = self.read(version).select("virtual_slot", "shard").collect()  # ``slots`` rows
        if sorted(r.virtual_slot for r in rows) != list(range(slots)):
            raise ValueError(f"the map below {self.path} has {len(rows)} virtual slots, not {slots}")
        return np.array([r.shard for r in sorted(rows, key=lambda r: r.virtual_slot)], np.int64)

    def write(self, version: int, owner: np.ndarray, weight: np.ndarray, rows: np.ndarray) -> DataFrame:
        values = [(version, s, int(owner[s]), int(weight[s]), int(rows[s])) for s in range(len(owner))]
        self.spark.createDataFrame(values, MAP_SCHEMA).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/version={version}")
        return self.read(version)

    def read(self, version: int) -> DataFrame:
        return self.spark.read.schema(MAP_SCHEMA).parquet(f"{self.path}/version={version}")


def shard_rows(df: DataFrame, shards: int = 8, key: str = "doc_id", text: str = "text", path: str | None = None, slots: int = SLOTS) -> DataFrame:
    """Each row's key, ``size`` (UTF-8 bytes plus 1), ``text_crc32``, ``law``, ``shard``, ``slot`` (gapless from 0 in its shard),
    ``virtual_slot`` and ``map_version``; shards have nearly equal bytes.

    The latest map below ``path`` is edited by the measured bytes and the number of shards, and the next version is published there. Where
    there is none, version 0 deals slots out in turn and version 1 is its edit. Only slots that the edit released change their shard.
    A row's virtual slot comes from its key and content, so null keys spread and equal rows stay together. Null text has no
    bytes. Places inside a virtual slot go by key, size and checksum; equal rows take neighbouring places. An empty table
    gives no rows; other columns are not read.
    """
    spark = df.sparkSession
    body = F.coalesce(F.col(text), F.lit("")).cast("binary")
    crc = F.crc32(body)
    rows = df.select(F.col(key).alias("k"), (F.octet_length(body) + 1).cast("long").alias("size"), crc.alias("crc"))
    rows = stored(rows.withColumn("v", virtual_slot(F.col("k"), F.col("crc"), slots=slots)), "shard-rows")
    weight, count = np.zeros(slots, np.int64), np.zeros(slots, np.int64)
    for r in rows.groupBy("v").agg(F.sum("size").alias("b"), F.count(F.lit(1)).alias("n")).collect():  # at most ``slots`` rows
        weight[r.v], count[r.v] = r.b, r.n
    store = SlotMap(spark, path or scratch_path(spark, "slot-map"))
    last = store.latest()
    if last is None:
        last, owner = 0, np.arange(slots, dtype=np.int64) % shards
        store.write(0, owner, weight, count)
    else:
        owner = store.owners(last, slots)
    version = store.write(last + 1, rebalanced(owner, weight, shards), weight, count)
    # where each virtual slot begins in its shard: a window over the map, which has ``slots`` rows
    ahead = F.sum("rows").over(Window.partitionBy("shard").orderBy("virtual_slot").rowsBetween(Window.unboundedPreceding, -1))
    told = version.withColumn("ahead", F.coalesce(ahead, F.lit(0))).select(F.col("virtual_slot").alias("v"), "shard", "version", "ahead")
    place = F.row_number().over(Window.partitionBy("v").orderBy("k", "size", "crc")) - 1
    placed = rows.withColumn("place", place).join(F.broadcast(told), "v")
    return placed.select(
        F.col("k").alias(key), "size", F.col("crc").alias("text_crc32"), F.lit("bytes").alias("law"), "shard",
        (F.col("ahead") + F.col("place")).cast("long").alias("slot"), F.col("v").alias("virtual_slot"), F.col("version").alias("map_version"),
    )
