"""SimHash near duplicates by covering locality-sensitive hashing: no pair within the radius is missed, and no group is compared all with all.

*Fingerprint.* A document's shingles vote on 64 bits by their XXH64; a bit is 1 if it is set in over half of them.

*Covering masks.* Every bit position gets a non-zero vector of three bits, every non-zero vector of three bits is a table, and a table
looks at the positions whose vector has an odd product with its own. Two positions can never meet all seven tables, as two linear
conditions on three bits leave a solution: the pairs that differ in two bits or fewer agree in the masked bits of some table.

*Inside a bucket.* The members of a bucket differ in the 28 or so bits outside the mask only. Up to ``PAIR_ROWS`` members are compared
pair by pair. In a larger bucket each member is sent to itself and to every fingerprint one free bit away. Two members differ in at most
two bits exactly if they share such a place, and a place has 65 members at most, all of them linked. So the work is linear in the bucket.

Only distinct fingerprints are linked; copies of one never meet. Components are those of all links.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, flat, lowered, stored, text_slices, words_of
from .components import components

WORDS = 3
SEED = 42
BITS = 64
DIFFERENCES = 2
PAIR_ROWS = 24
VOTES = 1 << 18  # hashes whose bits are unpacked at a time
HOT_PRINTS = 1000  # at most so many fingerprints hold over a thousandth of all rows each


def covering_masks(bits: int = BITS) -> list[int]:
    """The seven masks of radius two; every position is in four of them."""
    odd = lambda x: x.bit_count() & 1
    return [sum(1 << i for i in range(bits) if odd((i % 7 + 1) & v)) for v in range(1, 8)]


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def shingle_bytes(texts: pa.Array, words: int = WORDS) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """All words joined by one space, and start, end and row of every shingle in them, rows ascending.

    Fewer words than ``words`` are one shingle; without words there is none.
    """
    data, offsets = flat(texts)
    data = lowered(data)
    starts, ends, rows = words_of(data, offsets)
    length = ends - starts
    begin = np.cumsum(length + 1) - length - 1
    joined = np.full(int((length + 1).sum()), 0x20, np.uint8)
    inside = np.arange(int(length.sum())) - np.repeat(np.cumsum(length) - length, length)
    joined[np.repeat(begin, length) + inside] = data[np.repeat(starts, length) + inside]
    count = np.bincount(rows, minlength=len(offsets) - 1)
    first = np.cumsum(count) - count
    at = np.flatnonzero(rows[words - 1 :] == rows[: len(rows) - words + 1]) if len(rows) >= words else np.zeros(0, np.int64)
    few = np.flatnonzero((count > 0) & (count < words))
    lead, last = np.concatenate([at, first[few]]), np.concatenate([at + words - 1, first[few] + count[few] - 1])
    order = np.argsort(lead, kind="stable")
    lead, last = lead[order], last[order]
    return joined.tobytes(), begin[lead], begin[last] + length[last], rows[lead]


def simhash(texts: pa.Array, words: int = WORDS) -> np.ndarray:
    """The fingerprint of each text as an unsigned number."""
    body, starts, ends, rows = shingle_bytes(texts, words)
    votes, total = np.zeros((len(texts), BITS), np.int64), np.bincount(rows, minlength=len(texts))
    digest = xxhash.xxh64_intdigest
    for a in range(0, len(rows), VOTES):
        places = zip(starts[a : a + VOTES].tolist(), ends[a : a + VOTES].tolist(), strict=True)
        h = np.array([digest(body[i:j], SEED) for i, j in places], "<u8")
        of = rows[a : a + VOTES]
        lead = np.flatnonzero(np.append(True, of[1:] != of[:-1]))
        bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        votes[of[lead]] += np.add.reduceat(bits, lead, axis=0, dtype=np.int32)
    return np.packbits(2 * votes > total[:, None], axis=1, bitorder="little").view("<u8").ravel()


def fingerprints(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: key ``k`` and fingerprint ``fp``, the 64 bits as a signed number. Null counts as a text without words: zero."""
    bounded_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in text_slices(batch.column(1)):
                found = simhash(batch.column(1).slice(a, b - a)).view(np.int64)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(found)], ["k", "fp"])

    return df.select(F.col(key).alias("k"), F.col(text).alias("t")).mapInArrow(run, f"k {df.schema[key].dataType.simpleString()}, fp long")


def near_prints(prints: DataFrame, pair_rows: int = PAIR_ROWS) -> DataFrame:
    """Links ``a, b`` that connect all distinct fingerprints ``fp`` within two bits of each other, and no others."""
    masks = covering_masks()
    table = F.explode(F.array(*[F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(signed(m))).alias("masked")) for t, m in enumerate(masks)]))
    dealt = prints.select("fp", table.alias("x")).select("fp", "x.t", "x.masked")
    shared = dealt.groupBy("t", "masked").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    met = stored(dealt.join(shared, ["t", "masked"]), "simhash-buckets")

    members = met.filter(F.col("n") <= pair_rows).groupBy("t", "masked").agg(F.collect_list("fp").alias("own"))
    near = lambda x, y: (x < y) & (F.bit_count(x.bitwiseXOR(y)) <= DIFFERENCES)
    pairs = F.flatten(F.transform("own", lambda x: F.transform(F.filter("own", lambda y: near(x, y)), lambda y: F.struct(x.alias("a"), y.alias("b")))))
    small = members.select(pairs.alias("pairs")).filter(F.size("pairs") > 0).select(F.inline("pairs"))

    free = F.array(*[F.array(F.lit(0).cast("long"), *[F.lit(signed(1 << i)) for i in range(BITS) if not m >> i & 1]) for m in masks])
    places = met.filter(F.col("n") > pair_rows).select("fp", F.explode(F.transform(F.get(free, F.col("t")), lambda flip: F.col("fp").bitwiseXOR(flip))).alias("place"))
    around = places.groupBy("place").agg(F.collect_set("fp").alias("own")).filter(F.size("own") > 1)
    star = around.select(F.array_min("own").alias("a"), F.explode("own").alias("b")).filter("a <> b")
    return small.union(star).distinct()


def simhash_components(df: DataFrame, key: str = "doc_id", text: str = "text", pair_rows: int = PAIR_ROWS) -> DataFrame:
    """Per row of ``df``: key, ``fingerprint`` (16 hex digits) and ``component_id``, the smallest key that links reach.

    Null, empty and wordless texts have the fingerprint zero and are linked like any other. Repeated rows and rows that share a key
    are rows of their own. A row without a key takes part in links, but names a component only by null, if nothing in it has a
    key. Other columns are not read; an empty table gives no rows.
    """
    rows = stored(fingerprints(df, key, text), "simhash-rows")
    prints = stored(rows.groupBy("fp").agg(F.min("k").alias("k"), F.count(F.lit(1)).alias("n")), "simhash-prints")
    labels = components(near_prints(prints.select("fp"), pair_rows))
    linked = stored(prints.join(labels, F.col("fp") == F.col("node")).select("fp", "k", "component"), "simhash-linked")
    least = linked.groupBy("component").agg(F.min("k").alias("least"))
    named = prints.join(linked.join(least, "component").select("fp", "least"), "fp", "left")
    told = stored(named.select("fp", "n", F.when(F.col("least").isNull(), F.col("k")).otherwise(F.col("least")).alias("component_id")), "simhash-components")
    # rows learn their component from a fingerprint; the few fingerprints with very many rows are told without a shuffle
    heavy = F.col("n") > max(HOT_PRINTS // 10, rows.count() // HOT_PRINTS)
    hot = F.broadcast(told.filter(heavy).select("fp", "component_id"))
    cold = rows.join(hot, "fp", "left_anti").join(told.filter(~heavy).select("fp", "component_id"), "fp")
    return rows.join(hot, "fp").select("k", "fp", "component_id").union(cold.select("k", "fp", "component_id")).select(
        F.col("k").alias(key), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )
