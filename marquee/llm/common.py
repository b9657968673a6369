"""What the operators of this subpackage share: scratch tables, a cache per Python worker, and word kernels over Arrow text."""

from __future__ import annotations

import sys
import types
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path

CHUNK_BYTES = 2 << 20  # text handled at a time by the vectorised kernels; a longer document is a chunk of its own
SPACES = (0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x20)


def stored(df: DataFrame, name: str, compression: str | None = None) -> DataFrame:
    """``df`` written below ``spark.checkpoint.dir`` and read back: cuts lineage and survives lost executors."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path, compression=compression)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def crc_fold(doc_id, parts: int):
    """CRC-32 of the id's decimal text, modulo ``parts``; null ids count as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % parts


def sampled(df: DataFrame, key, bound: int, salt: str) -> DataFrame:
    """About ``bound`` rows chosen by a hash of ``key``, all of them if there are fewer: the bounded sample of a fit."""
    n = df.count()
    if n <= bound:
        return df
    u = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(salt), F.coalesce(key.cast("string"), F.lit("")))), 1, 13), 16, 10).cast("long")
    return df.filter(u < int((1 << 52) * bound / n))


def parts_for(df: DataFrame, rows: int, rows_each: int) -> int:
    """Partitions for ``rows`` rows, at least the session's shuffle partitions."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows // rows_each))


def bounded_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Arrow batches of at most ``rows`` rows: whole texts travel in them, so the default of 10 000 rows can be gigabytes."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, str(rows))


def worker_cache(key: str, make: Callable):
    """``make()`` once per Python worker; functions travel by value, so their globals are new in every task."""
    cache = sys.modules.setdefault("marquee_worker_cache", types.ModuleType("marquee_worker_cache")).__dict__
    if key not in cache:
        cache[key] = make()
    return cache[key]


def text_slices(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Consecutive row ranges of at most ``limit`` bytes of text, one row at least."""
    _, offsets = flat(column)
    at, n = 0, len(column)
    while at < n:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        yield at, end
        at = end


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a text column and its row offsets from 0; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, where, data = column.buffers()
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(where, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    body = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return body, offsets - offsets[0]


def words_of(data: np.ndarray, offsets: np.ndarray, breaks=SPACES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and row numbers of the runs of bytes outside ``breaks``; a run never spans two rows.

    By default these are the words ``[^\\x20\\x09-\\x0D]+``.
    """
    space = np.zeros(256, bool)
    space[list(breaks)] = True
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = ~space[data]
    first = np.zeros(len(data) + 1, bool)
    first[offsets[:-1]] = True  # a row starts here
    here, before = inside[1:-1], inside[:-2]
    starts = np.flatnonzero(here & (~before | first[:-1]))
    last = np.zeros(len(data) + 1, bool)
    last[offsets[1:]] = True  # a row ends before this byte
    ends = np.flatnonzero(here & (~inside[2:] | last[1:])) + 1
    rows = np.searchsorted(offsets, starts, "right") - 1
    return starts, ends, rows


def lowered(data: np.ndarray) -> np.ndarray:
    """Bytes with A-Z lower-cased."""
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    return table[data]


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def hash_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte ranges, eight bytes a step."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.ndarray((len(data) + 1,), "<u8", buffer=padded.data, strides=(1,))
    keep = np.array([(1 << (8 * i)) - 1 for i in range(8)] + [(1 << 64) - 1], np.uint64)
    length = ends - starts
    h = length.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    active, step = np.arange(len(starts)), 0
    while len(active):
        rest = length[active] - step
        value = eight[starts[active] + step] & keep[np.minimum(rest, 8)]
        h[active] = mix(h[active] ^ value) + np.uint64(step + 1)
        active, step = active[rest > 8], step + 8
    return h
