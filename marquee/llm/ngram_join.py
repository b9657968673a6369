"""N-gram Jaccard join by parity sketches: documents whose sets of word shingles overlap enough, without comparing all pairs.

*Sketch.* Each shingle of a set flips one bit. The sketch of a symmetric difference is the XOR of two sketches, so their Hamming
distance never exceeds the size of the symmetric difference, and a pair whose distance is too large cannot be linked.

*Pigeonhole.* Linked sets differ in at most ``d`` shingles, with ``d`` fixed by their size band. Shingles are dealt into more than
``d`` parts; a part without a difference is equal in both sketches. Parts are compared by the XOR of their shingle hashes. Ordered in
the same way everywhere, the first ``d + 1`` non-empty parts of each set must share one (if one of the two has that many; a set
with fewer gives all of them, and its first ``d + 1`` shingles as parts of their own). Parts made only of frequent shingles come
last in that order, so a passage that many documents share brings no candidates. No link is lost, whatever is frequent.

*Verification.* Candidates of one part are tied to its pivot first (linear in the part). Pairs that pass the sketch test are
decided on the sets themselves.

*Large parts.* A passage that many documents share makes large parts that are nearly the same, and whose members need not be alike. The
members of all large parts are therefore dealt again, by their rarest shingles (``by_rarest_shingles``): counted among these
members, the first ``n - ceil(s * n) + 1`` shingles of two linked sets in the order of their counts share one (``s`` is the similarity),
also if only ``n - ceil(2 * s / (1 + s) * n) + 1`` of the smaller are taken; documents that have only the passage in common share none. Groups that are still large and hold several components are completed: members
outside the largest component meet all others of their group in blocks, and their nearest partners that pass the sketch test are verified,
in each step eight times as many, until no untried pair across components passes. Components are therefore those of all links.

Sets are identified by 128-bit hashes, so copies are one set. Signatures and shingles travel as packed arrays, one row per task and
slot; a slot is bounded by the number of slots unless very many distinct sets share a part. Frequent shingles are found among those of all rows,
each of which is counted the same way.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, flat, hash_words, lowered, mix, stored, text_slices, words_of
from .components import components

WORDS = 5
SIMILARITY = (75, 100)  # a link needs 100 * intersection >= 75 * union
SALTS = 16
FREQUENT_IN, FREQUENT_ONE_IN = 4, 5000  # a shingle is frequent if so many rows hold it, and one in so many
FREQUENT_MAX = 2_000_000  # shingles that can be frequent at most: each is at least such a part of all
SLOT_SIGNATURES = 1_500_000
FLUSH = 500_000
SMALL_RUN = 8
PIVOT_ROWS = 64
BROADCAST_ROWS = 200_000
ASK_ROWS, TELL_ROWS = 256, 4096  # of a block in which members of a large part meet
CHUNK = 8192  # members of a large part in one row
ODD = np.uint64(0x9E3779B97F4A7C15)
MAX_BAND = 200
STEPS = 24  # completion tries eight times as many partners in each step, so this is never reached


class Bands:
    """Size bands: a set can only be linked within its band and with the next one, at a bounded difference."""

    def __init__(self, similarity: tuple[int, int]):
        self.num, self.den = similarity
        edge = [1]
        while len(edge) <= MAX_BAND and edge[-1] < 1 << 40:
            edge.append(max(edge[-1] + 1, (edge[-1] - 1) * self.den // self.num + 1))
        self.edge = np.array(edge, np.int64)
        top = self.edge[1:] - 1
        self.differences = (top + top * self.den // self.num) * (self.den - self.num) // (self.den + self.num)
        self.parts = np.where(top <= 16, 0, self.differences + self.differences // 2 + 2)  # 0: every shingle is a part

    def of(self, size: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.edge, size, "right") - 1

    def reaches_lower(self, size: np.ndarray) -> np.ndarray:
        return size * self.num <= self.den * (self.edge[self.of(size)] - 1)

    def possible(self, a, b, distance=0):
        """Whether sets of these sizes whose difference is at least ``distance`` can be linked."""
        small, large = np.minimum(a, b), np.maximum(a, b)
        return (small * self.den >= large * self.num) & (distance * (self.den + self.num) <= (a + b) * (self.den - self.num))


def shingle_sets(texts: pa.Array, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, one after another, and their bounds.

    Fewer words than ``words`` are one shingle; without words the set is empty.
    """
    data, offsets = flat(texts)
    data = lowered(data)
    starts, ends, rows = words_of(data, offsets)
    n = len(offsets) - 1
    h = hash_words(data, starts, ends)
    count = np.bincount(rows, minlength=n)
    first = np.concatenate([[0], np.cumsum(count)])[:-1]
    full = np.flatnonzero(rows[words - 1 :] == rows[: len(rows) - words + 1]) if len(rows) >= words else np.zeros(0, np.int64)
    value = h[full]
    for j in range(1, words):
        value = mix(value * ODD + h[full + j])
    few = np.flatnonzero((count > 0) & (count < words))
    short = count[few].astype(np.uint64)
    for j in range(words - 1):
        has = count[few] > j
        short[has] = mix(short[has] * ODD + h[first[few[has]] + j])
    value, row = np.concatenate([value, short]), np.concatenate([rows[full], few])
    order = np.lexsort((value, row))
    value, row = value[order], row[order]
    new = np.append(True, (value[1:] != value[:-1]) | (row[1:] != row[:-1]))[: len(value)]
    value, row = value[new], row[new]
    return value, np.searchsorted(row, np.arange(n + 1))


def set_ids(value: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of each set; 0 for empty ones."""
    n = len(bounds) - 1
    out = np.zeros((2, n), np.uint64)
    full = np.flatnonzero(np.diff(bounds))
    if len(full):
        out[0, full] = mix(np.add.reduceat(mix(value), bounds[full]) + np.uint64(1))
        out[1, full] = np.bitwise_xor.reduceat(mix(value ^ ODD), bounds[full])
    return out[0].view(np.int64), out[1].view(np.int64)


def sketch(value: np.ndarray) -> bytes:
    """Parity sketch of one set: at least four bits for each shingle, a power of two."""
    bits = max(64, 1 << (4 * len(value) - 1).bit_length()) if len(value) else 64
    place = (mix(value ^ np.uint64(0x51C0FFEE)) & np.uint64(bits - 1)).astype(np.int64)
    return np.packbits((np.bincount(place, minlength=bits) & 1).astype(np.uint8)).tobytes()


def distance(a: bytes, b: bytes) -> int:
    """Hamming distance of two sketches; the larger is folded to the size of the smaller."""
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    size = min(len(x), len(y))
    x = np.bitwise_xor.reduce(x.reshape(-1, size), 0)
    y = np.bitwise_xor.reduce(y.reshape(-1, size), 0)
    return int(np.bitwise_count(x ^ y).sum())


def signatures(value: np.ndarray, bounds: np.ndarray, bands: Bands, frequent: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Part signatures of the sets and the set of each."""
    size = np.diff(bounds)
    row = np.repeat(np.arange(len(size)), size)
    hot = np.zeros(len(value), bool)
    if len(frequent):
        at = np.minimum(np.searchsorted(frequent, value), len(frequent) - 1)
        hot = frequent[at] == value
    hashed = mix(value ^ np.uint64(0xABCDEF12345))
    found, owner = [], []

    def first_parts(sig: np.ndarray, of: np.ndarray, frequent_only: np.ndarray, limit: np.ndarray) -> None:
        order = np.lexsort((sig, frequent_only, of))
        sig, of = sig[order], of[order]
        begin = np.searchsorted(of, np.arange(len(size)))
        keep = np.arange(len(of)) - begin[of] < limit[of]
        found.append(sig[keep])
        owner.append(of[keep])

    for lower in (False, True):
        space = bands.of(np.maximum(size, 1)) - lower
        use = (size >= 3) & (space >= 0) & (bands.reaches_lower(np.maximum(size, 1)) if lower else True)
        space = np.where(use, space, 0)
        limit = bands.differences[space] + 1
        parts = np.where(use, bands.parts[space], 0)
        tag = mix(space.astype(np.uint64) * ODD + np.uint64(77))
        own = use & (parts == 0)  # every shingle is a part of its own
        base = np.concatenate([[0], np.cumsum(parts)])
        inside = np.flatnonzero((use & (parts > 0))[row])
        if len(inside):
            r = row[inside]
            part = base[r] + (((hashed[inside] >> np.uint64(32)) * parts[r].astype(np.uint64)) >> np.uint64(32)).astype(np.int64)
            xor = np.zeros(base[-1], np.uint64)
            np.bitwise_xor.at(xor, part, mix(value[inside]))
            rare = np.bincount(part[~hot[inside]], minlength=base[-1]) > 0
            full = np.flatnonzero(xor)
            of = np.searchsorted(base, full, "right") - 1
            sig = mix(xor[full] ^ tag[of] ^ mix((full - base[of]).astype(np.uint64) + np.uint64(1)))
            number = np.bincount(of, minlength=len(size))
            lacking = use & (parts > 0) & (number < limit)
            first_parts(sig, of, ~rare[full], np.where(lacking, number, limit))
            own |= lacking
        alone = np.flatnonzero(own[row])
        if len(alone):
            first_parts(mix(value[alone] ^ tag[row[alone]] ^ np.uint64(3)), row[alone], hot[alone], limit)
    if not found:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate(found), np.concatenate(owner)


def frequent_shingles(df: DataFrame, text: str, rows: int, held: int) -> np.ndarray:
    """The shingles that many of the rows hold; ``rows`` is the number of rows and ``held`` the sum of the sizes of their sets.

    Every shingle of every row is counted, in slots of packed arrays as signatures are. Many is a number of rows that at most
    ``FREQUENT_MAX`` shingles can reach, so none of those that do is left out. They only decide the order of the parts.
    """
    least = max(FREQUENT_IN, -(-rows // FREQUENT_ONE_IN), -(-held // FREQUENT_MAX))
    bits = max(4, int(held // SLOT_SIGNATURES).bit_length())

    def pack(held: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        value, n = np.unique(np.concatenate(held), return_counts=True)
        slot = (value >> np.uint64(64 - bits)).astype(np.int64)
        once = n == 1
        made = [(s, v, b"") for s, v in deal(slot[once], value[once])] + deal(slot[~once], value[~once], n[~once].astype(np.uint32))
        # the first bytes of a slot's numbers are alike: side by side they take no room in a shuffle
        made = [(s, np.frombuffer(v, np.uint8).reshape(-1, 8).T.tobytes(), times) for s, v, times in made]
        yield from packed_rows(made, ["slot", "shingles", "times"]).to_batches()

    def shingled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, total = [], 0
        for batch in batches:
            for a, b in text_slices(batch.column(0)):
                held.append(shingle_sets(batch.column(0).slice(a, b - a))[0])
                total += len(held[-1])
                if total > FLUSH:
                    yield from pack(held)
                    held, total = [], 0
        if total:
            yield from pack(held)

    def count(table: pa.Table) -> pa.Table:
        value, n = [], []
        for v, times in zip(table["shingles"].to_pylist(), table["times"].to_pylist(), strict=True):
            value.append(np.ascontiguousarray(np.frombuffer(v, np.uint8).reshape(8, -1).T).view(np.uint64).ravel())
            n.append(np.frombuffer(times, np.uint32) if times else np.ones(len(value[-1]), np.uint32))
        value, at = np.unique(np.concatenate(value), return_inverse=True)
        n = np.bincount(at, weights=np.concatenate(n))
        return pa.table([pa.array(value[n >= least].view(np.int64))], ["s"])

    counted = df.select(text).mapInArrow(shingled, "slot int, shingles binary, times binary").groupBy("slot").applyInArrow(count, "s long")
    return np.sort(counted.toPandas()["s"].to_numpy(np.int64).view(np.uint64))


def describe(df: DataFrame, key: str, text: str) -> DataFrame:
    """Per row: key, set size ``n``, set hashes ``h1``, ``h2`` and the parity sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in text_slices(batch.column(1)):
                value, bounds = shingle_sets(batch.column(1).slice(a, b - a))
                h1, h2 = set_ids(value, bounds)
                sketches = [sketch(value[i:j]) for i, j in zip(bounds[:-1], bounds[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(np.diff(bounds)), pa.array(h1), pa.array(h2), pa.array(sketches, pa.binary())], ["k", "n", "h1", "h2", "sketch"])

    schema = f"k {df.schema[key].dataType.simpleString()}, n long, h1 long, h2 long, sketch binary"
    return df.select(F.col(key).alias("k"), F.col(text).alias("t")).mapInArrow(run, schema)


def candidates(df: DataFrame, text: str, bands: Bands, frequent: np.ndarray) -> DataFrame:
    """Rows ``kind, a, b, members``: 0 ties a set to the smallest of its part, 1 is another pair of a small part, 2 the members
    of a large part. Signatures travel as packed arrays, one row per task and slot."""
    size = df.agg(F.coalesce(F.sum(F.octet_length(text)), F.lit(0)).alias("n")).first().n
    bits = max(4, int(size // 9 // SLOT_SIGNATURES).bit_length())
    shared = df.sparkSession.sparkContext.broadcast(frequent)

    def pack(sig: list, owner: list) -> Iterator[pa.RecordBatch]:
        sig, owner = np.concatenate(sig), np.concatenate(owner)
        slot = (sig >> np.uint64(64 - bits)).astype(np.int64)
        order = np.lexsort((owner, slot))
        sig, owner, slot = sig[order], owner[order], slot[order]
        bounds = np.searchsorted(slot, np.arange((1 << bits) + 1))
        rows = []
        for s in np.flatnonzero(np.diff(bounds)):
            a, b = bounds[s], bounds[s + 1]
            own = owner[a:b]
            lead = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
            keys = np.ascontiguousarray(sig[a:b].astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()
            rows.append((int(s), keys, own[lead].tobytes(), np.diff(np.append(lead, b - a)).astype(np.uint32).tobytes()))
        columns = list(zip(*rows, strict=True))
        yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), *[pa.array(c, pa.binary()) for c in columns[1:]]], ["slot", "keys", "sets", "counts"])

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sig, owner, total, seen = [], [], 0, set()
        for batch in batches:
            for a, b in text_slices(batch.column(0)):
                value, bounds = shingle_sets(batch.column(0).slice(a, b - a))
                h1, _ = set_ids(value, bounds)
                fresh = np.zeros(len(h1), bool)  # copies are signed once per flush: a set's signatures depend on the set alone
                fresh[[i for i in np.unique(h1, return_index=True)[1].tolist() if int(h1[i]) not in seen]] = True
                size = np.diff(bounds)
                value, h1 = value[np.repeat(fresh, size)], h1[fresh]
                bounds = np.concatenate([[0], np.cumsum(size[fresh])])
                seen.update(h1.tolist())
                s, of = signatures(value, bounds, bands, shared.value)
                sig.append(s)
                owner.append(h1[of])
                total += len(s)
                if total > FLUSH:
                    yield from pack(sig, owner)
                    sig, owner, total, seen = [], [], 0, set()
        if total:
            yield from pack(sig, owner)

    def meet(table: pa.Table) -> pa.Table:
        keys, owner = [], []
        for k, s, c in zip(table["keys"], table["sets"], table["counts"], strict=True):
            raw = np.frombuffer(k.as_py(), np.uint8).reshape(-1, 6)
            wide = np.zeros((len(raw), 8), np.uint8)
            wide[:, :6] = raw
            keys.append(wide.view("<u8").ravel())
            owner.append(np.repeat(np.frombuffer(s.as_py(), np.int64), np.frombuffer(c.as_py(), np.uint32)))
        return runs_of(np.concatenate(keys), np.concatenate(owner), int(table["slot"][0].as_py()))

    packed = df.select(text).mapInArrow(sign, "slot int, keys binary, sets binary, counts binary")
    return packed.groupBy("slot").applyInArrow(meet, RUNS)


RUNS = "kind int, a long, b long, members binary"


def runs_of(key: np.ndarray, own: np.ndarray, slot: int) -> pa.Table:
    """What the sets ``own`` of equal ``key`` have to be compared with: see ``candidates``."""
    order = np.argsort(key, kind="stable")
    key, own = key[order], own[order]
    same = key[1:] == key[:-1]
    keep = (np.append(same, False) | np.append(False, same))[: len(key)]  # keys of one row only are most of them
    key, own = key[keep], own[keep]
    order = np.lexsort((own, key))
    key, own = key[order], own[order]
    new = np.append(True, (key[1:] != key[:-1]) | (own[1:] != own[:-1]))[: len(key)]
    key, own = key[new], own[new]
    lead = np.flatnonzero(np.append(True, key[1:] != key[:-1]))[: len(key)]
    length = np.diff(np.append(lead, len(key)))
    # a part's pivot is its member that meets most others: the text that near copies were made from
    known, at, degree = np.unique(own, return_inverse=True, return_counts=True)
    run = np.repeat(np.arange(len(lead)), length)
    best = np.lexsort((own, -degree[at], run))[lead] if len(lead) else lead
    pivot = np.repeat(own[best], length)
    rest = pivot != own
    star = np.unique(np.stack([pivot[rest], own[rest]], 1), axis=0)
    pairs = []
    for g in range(3, SMALL_RUN + 1):
        block = own[lead[length == g][:, None] + np.arange(g)]
        i, j = np.triu_indices(g, 1)
        pairs.append(np.stack([block[:, i].ravel(), block[:, j].ravel()], 1))
    pairs = np.unique(np.concatenate(pairs), axis=0)
    seen, large = set(), []
    for a, n in zip(lead[length > SMALL_RUN], length[length > SMALL_RUN], strict=True):
        held = own[a : a + n].tobytes()
        if held in seen:
            continue  # the same members meet under another key
        seen.add(held)
        name = int(mix(key[a : a + 1] ^ mix(np.array([slot + 1], np.uint64))).view(np.int64)[0])
        large += [(name, own[i : min(i + CHUNK, a + n)].tobytes()) for i in range(a, a + n, CHUNK)]
    a = np.concatenate([star[:, 0], pairs[:, 0], np.array([x[0] for x in large], np.int64)])
    b = np.concatenate([star[:, 1], pairs[:, 1], np.zeros(len(large), np.int64)])
    kind = np.repeat([0, 1, 2], [len(star), len(pairs), len(large)]).astype(np.int32)
    members = pa.array([None] * (len(star) + len(pairs)) + [x[1] for x in large], pa.binary())
    return pa.table([pa.array(kind), pa.array(a), pa.array(b), members], ["kind", "a", "b", "members"])


def deal(slot: np.ndarray, *arrays: np.ndarray) -> list[tuple]:
    """One row per slot: its number, and the bytes of each array."""
    order = np.argsort(slot, kind="stable")
    slot, arrays = slot[order], [x[order] for x in arrays]
    lead = np.flatnonzero(np.append(True, slot[1:] != slot[:-1]))[: len(slot)]
    ends = np.append(lead, len(slot))[1:]
    return [(int(slot[a]), *(x[a:b].tobytes() for x in arrays)) for a, b in zip(lead, ends, strict=True)]


def packed_rows(rows: list[tuple], names: list[str]) -> pa.Table:
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(names)
    return pa.table([pa.array(columns[0], pa.int32()), *[pa.array(c, pa.binary()) for c in columns[1:]]], names)


def unpacked(table: pa.Table, **kinds) -> list[np.ndarray]:
    return [np.concatenate([np.frombuffer(x.as_py(), kind) for x in table[name]]) for name, kind in kinds.items()]


def by_rarest_shingles(df: DataFrame, key: str, text: str, sets: DataFrame, found: DataFrame, similarity: tuple[int, int]) -> DataFrame:
    """Rows as those of ``candidates`` for the members of its large parts, grouped by shingles instead of parts.

    Three steps over packed arrays. Shingles are counted; those of two members or more go back to the members with their counts;
    each member keeps the first of them in the order of counts that two linked sets must share one of (shingles that no other member has
    come first and are only counted). Linked members of a part are both in ``found``, so no link is lost.
    """
    num, den = similarity

    def members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [np.frombuffer(x, np.int64) for x in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(np.concatenate(own)) if own else np.zeros(0, np.int64))], ["h1"])

    known = found.filter("kind = 2").select("members").mapInArrow(members, "h1 long").distinct()
    wanted = stored(sets.select("h1", "h2", "k").join(known, "h1"), "large-part-sets")
    n = wanted.count()
    texts = df.select(F.col(key).alias("k"), F.col(text).alias("t")).join(F.broadcast(wanted) if n <= BROADCAST_ROWS else wanted, "k")
    size = texts.agg(F.coalesce(F.sum(F.octet_length("t")), F.lit(0)).alias("n")).first().n
    bits = max(4, int(size // 6 // SLOT_SIGNATURES).bit_length())
    slot = lambda x: (mix(x.view(np.uint64) ^ ODD) >> np.uint64(64 - bits)).astype(np.int64)

    def shingled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in text_slices(batch.column(0)):
                value, bounds = shingle_sets(batch.column(0).slice(a, b - a))
                h1, h2 = set_ids(value, bounds)
                fit = (h1 == batch.column(1).slice(a, b - a).to_numpy()) & (h2 == batch.column(2).slice(a, b - a).to_numpy())  # or another row of the key
                length = np.diff(bounds)
                keep = np.repeat(fit, length)
                own, number = np.repeat(h1, length)[keep], np.repeat(length, length)[keep].astype(np.uint32)
                rows = deal(slot(value[keep]), value[keep], own, number)
                yield from packed_rows(rows, ["slot", "shingles", "sets", "sizes"]).to_batches()

    def count(table: pa.Table) -> pa.Table:
        value, own, number = unpacked(table, shingles=np.uint64, sets=np.int64, sizes=np.uint32)
        order = np.lexsort((own, value))  # a key with several rows of one text names its set more than once
        value, own, number = value[order], own[order], number[order]
        new = np.append(True, (value[1:] != value[:-1]) | (own[1:] != own[:-1]))[: len(value)]
        value, own, number = value[new], own[new], number[new]
        _, at, times = np.unique(value, return_inverse=True, return_counts=True)
        times = times[at].astype(np.uint32)
        shared = times > 1
        rows = deal(slot(own[shared]), value[shared], own[shared], number[shared], times[shared])
        return packed_rows(rows, ["slot", "shingles", "sets", "sizes", "times"])

    def choose(table: pa.Table) -> pa.Table:
        value, own, number, times = unpacked(table, shingles=np.uint64, sets=np.int64, sizes=np.uint32, times=np.uint32)
        order = np.lexsort((value, times, own))
        value, own, number = value[order], own[order], number[order].astype(np.int64)
        lead = np.flatnonzero(np.append(True, own[1:] != own[:-1]))[: len(own)]
        shared = np.diff(np.append(lead, len(own)))
        place = np.arange(len(own)) - np.repeat(lead, shared)
        first = number - -(-num * number // den) + 1 - (number - np.repeat(shared, shared))
        keep = place < first
        # the smaller of two linked sets shares more than its own part of the similarity: fewer of its shingles will do
        short = place < first + -(-num * number // den) - -(-2 * num * number // (num + den))
        return packed_rows(deal(slot(value[keep]), value[keep], own[keep], short[keep]), ["slot", "shingles", "sets", "short"])

    def meet(table: pa.Table) -> pa.Table:
        value, own, short = unpacked(table, shingles=np.uint64, sets=np.int64, short=np.bool_)
        _, at = np.unique(value, return_inverse=True)
        keep = np.bincount(at, weights=short)[at] > 0
        return runs_of(value[keep], own[keep], int(table["slot"][0].as_py()))

    packed = texts.select("t", "h1", "h2").mapInArrow(shingled, "slot int, shingles binary, sets binary, sizes binary")
    counted = packed.groupBy("slot").applyInArrow(count, "slot int, shingles binary, sets binary, sizes binary, times binary")
    chosen = counted.groupBy("slot").applyInArrow(choose, "slot int, shingles binary, sets binary, short binary")
    return chosen.groupBy("slot").applyInArrow(meet, RUNS)


def pass_sketch(pairs: DataFrame, sets: DataFrame, bands: Bands) -> DataFrame:
    """The pairs ``a, b`` (first hashes) as keys and hashes ``ka, ha1, ha2, kb, hb1, hb2``, where sizes and sketches allow a link."""
    side = lambda x: sets.select(F.col("h1").alias(x), F.col("k").alias(f"k{x}"), F.col("h2").alias(f"h2{x}"), F.col("n").alias(f"n{x}"), F.col("sketch").alias(f"s{x}"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            na, nb = batch.column(6).to_numpy(), batch.column(7).to_numpy()
            far = np.array([distance(x, y) for x, y in zip(batch.column(8).to_pylist(), batch.column(9).to_pylist(), strict=True)], np.int64)
            yield batch.select(range(6)).filter(pa.array(bands.possible(na, nb, far)))

    joined = pairs.join(side("a"), "a").join(side("b"), "b").filter("ka <> kb")
    joined = joined.select("ka", "a", "h2a", "kb", "b", "h2b", "na", "nb", "sa", "sb")
    kind = sets.schema["k"].dataType.simpleString()
    return joined.mapInArrow(run, f"ka {kind}, a long, h2a long, kb {kind}, b long, h2b long")


def verify(df: DataFrame, key: str, text: str, pairs: DataFrame, similarity: tuple[int, int]) -> DataFrame:
    """The pairs whose sets are similar enough, as ``a, b`` (keys). Each text is fetched where it is needed, once per group of
    at most about ``PIVOT_ROWS`` partners of one pivot."""
    num, den = similarity
    pairs = stored(pairs, "candidates")
    groups = pairs.groupBy("ka").agg(F.greatest(F.ceil(F.count(F.lit(1)) / PIVOT_ROWS), F.lit(1)).alias("salts"))
    salted = pairs.join(groups, "ka").withColumn("salt", F.pmod(F.xxhash64("kb"), F.col("salts")))
    left = salted.select(F.col("ka").alias("k"), F.col("ka").alias("pivot"), "salt", F.lit(0).alias("side"), F.col("a").alias("h1"), F.col("h2a").alias("h2")).distinct()
    right = salted.select(F.col("kb").alias("k"), F.col("ka").alias("pivot"), "salt", F.lit(1).alias("side"), F.col("b").alias("h1"), F.col("h2b").alias("h2"))
    wanted = stored(left.union(right), "wanted-texts")
    if wanted.count() <= BROADCAST_ROWS:
        wanted = F.broadcast(wanted)
    texts = df.select(F.col(key).alias("k"), F.col(text).alias("t")).join(wanted, "k")
    kind = pairs.schema["ka"].dataType.simpleString()
    out_kind = pairs.schema["ka"].dataType

    def decide(table: pa.Table) -> pa.Table:
        side = table["side"].to_numpy()
        sets, linked = {}, ([], [])
        keys, h1, h2, texts = table["k"].to_pylist(), table["h1"].to_pylist(), table["h2"].to_pylist(), table["t"].combine_chunks()
        for i in np.argsort(side, kind="stable"):
            value, bounds = shingle_sets(texts.slice(i, 1))
            own = set_ids(value, bounds)
            if (own[0][0], own[1][0]) != (h1[i], h2[i]):
                continue  # another row of the same key
            if side[i] == 0:
                sets[keys[i]] = value
                continue
            other = sets[table["pivot"][int(i)].as_py()]
            both = np.intersect1d(value, other, assume_unique=True).size
            if both * den >= (len(value) + len(other) - both) * num:
                linked[0].append(table["pivot"][int(i)].as_py())
                linked[1].append(keys[i])
        from pyspark.sql.pandas.types import to_arrow_type

        return pa.table([pa.array(x, to_arrow_type(out_kind)) for x in linked], ["a", "b"])

    return texts.groupBy("pivot", "salt").applyInArrow(decide, f"a {kind}, b {kind}").distinct()


def part_members(large: DataFrame) -> DataFrame:
    """``run, h1`` of the members of each large group."""

    def members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for run, held in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = np.frombuffer(held, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([run] * len(own), pa.int64()), pa.array(own)], ["run", "h1"])

    return large.select("a", "members").mapInArrow(members, "run long, h1 long")


def several_components(listed: DataFrame, sets: DataFrame, labels: DataFrame) -> DataFrame:
    """The members of the large parts that hold several components: ``outside`` of the part's largest one or in it, and the numbers
    of blocks ``i`` and ``j`` that askers and members of the part are dealt into."""
    known = sets.select("h1", "k", "n", "sketch").join(labels, F.col("k") == F.col("node"), "left")
    known = known.select("h1", "k", "n", "sketch", F.coalesce("component", "k").alias("c"))
    share = listed.join(known.select("h1", "c"), "h1").groupBy("run", "c").agg(F.count(F.lit(1)).alias("n"))
    most = share.groupBy("run").agg(F.max(F.struct("n", "c")).alias("m"), F.sum("n").alias("all"), F.count(F.lit(1)).alias("kinds")).filter("kinds > 1")
    plan = most.select("run", F.col("m.c").alias("main"), F.ceil((F.col("all") - F.col("m.n")) / ASK_ROWS).cast("int").alias("i"), F.ceil(F.col("all") / TELL_ROWS).cast("int").alias("j"))
    return listed.join(plan, "run").join(known, "h1").select("run", "i", "j", "h1", "k", "n", "sketch", (F.col("c") != F.col("main")).alias("outside"))


def complete(rows: DataFrame, labels: DataFrame, asking: DataFrame | None, failed: DataFrame, bands: Bands, nearest: int) -> DataFrame:
    """Pairs ``a, b`` across components inside the large parts: for each asking member its ``nearest`` members of other components
    that pass the sketch test and were not tried before, in blocks of bounded size. A row ``a, run`` without ``b`` says that
    the member has more of them in that part and asks again. All members outside a part's largest component ask first, so each pair
    across components has a side that asks until none is left."""
    if asking is None:
        live = rows.withColumnRenamed("outside", "asks").withColumn("tried", F.lit(None).cast("array<long>"))
    else:
        again = asking.withColumn("asks", F.lit(True))
        before = failed.select(F.col("a").alias("h1"), F.col("b").alias("o")).union(failed.select("b", "a")).groupBy("h1").agg(F.collect_set("o").alias("tried"))
        live = rows.drop("outside").join(asking.select("run").distinct(), "run", "left_semi").join(again, ["run", "h1"], "left").join(before, "h1", "left")
        live = live.withColumn("asks", F.coalesce("asks", F.lit(False))).withColumn("tried", F.when(F.col("asks"), F.col("tried")))
    live = live.join(labels, F.col("k") == F.col("node"), "left").withColumn("c", F.coalesce("component", "k"))
    number = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    own = lambda n: F.pmod(F.xxhash64("h1"), F.col(n)).cast("int")
    at = lambda side, x, y: F.struct(F.lit(side).alias("side"), x.alias("x"), y.alias("y"))
    single, none = (F.col("i") == 1) & (F.col("j") == 1), F.array().cast("array<struct<side:int,x:int,y:int>>")
    asks = F.when(F.col("asks"), F.transform(number("j"), lambda y: at(0, own("i"), y))).otherwise(none)
    told = F.transform(number("i"), lambda x: at(1, x, own("j")))
    alone = F.array(F.when(F.col("asks"), at(2, F.lit(0), F.lit(0))).otherwise(at(1, F.lit(0), F.lit(0))))
    dealt = rows.agg(F.sum(F.when(single, 1).otherwise(F.col("i") + F.col("j"))).alias("n")).first().n or 0
    placed = live.select("run", F.explode(F.when(single, alone).otherwise(F.concat(asks, told))).alias("at"), "h1", "n", "sketch", "c", "tried")
    placed = placed.select("run", "at.*", "h1", "n", "sketch", "c", "tried")
    placed = placed.withColumn("bucket", F.pmod(F.xxhash64("run", "x", "y"), F.lit(dealt // TELL_ROWS + 1)))

    def meet(table: pa.Table) -> pa.Table:
        side, n, h1, x, y = (table[c].to_numpy() for c in ("side", "n", "h1", "x", "y"))
        held, tried, names = table["sketch"].to_pylist(), table["tried"].to_pylist(), table["run"].to_pylist()
        run = np.array(names, np.int64)
        c = np.unique(np.array(table["c"].to_pylist(), object), return_inverse=True)[1]
        order = np.lexsort((y, x, run))
        cut = np.flatnonzero((np.diff(run[order]) != 0) | (np.diff(x[order]) != 0) | (np.diff(y[order]) != 0)) + 1
        low, high, more = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], ([], [])
        for block in np.split(order, cut):
            if not (side[block] != 1).any():
                continue
            size = min(len(held[i]) for i in block)  # sizes in a part differ by one band; a folded sketch is a sketch
            folded = np.stack([np.bitwise_xor.reduce(np.frombuffer(held[i], np.uint64).reshape(-1, size // 8), 0) for i in block])
            members = side[block] != 0
            others, theirs = block[members], folded[members]
            for at in np.flatnonzero(side[block] != 1):
                i = block[at]
                far = np.bitwise_count(theirs ^ folded[at]).sum(1, dtype=np.int64)
                ok = (c[others] != c[i]) & bands.possible(n[i], n[others], far)
                if tried[i]:
                    ok &= ~np.isin(h1[others], np.array(tried[i], np.int64))
                near = np.flatnonzero(ok)
                if len(near) > nearest:
                    near = near[np.argsort(far[near], kind="stable")[:nearest]]
                    more[0].append(h1[i])
                    more[1].append(names[i])
                low.append(np.minimum(h1[i], h1[others[near]]))
                high.append(np.maximum(h1[i], h1[others[near]]))
        pair = np.unique(np.stack([np.concatenate(low), np.concatenate(high)], 1), axis=0)
        a, b = pa.array(np.append(pair[:, 0], np.array(more[0], np.int64))), pa.array([*pair[:, 1].tolist(), *[None] * len(more[0])], pa.int64())
        return pa.table([a, b, pa.array([*[None] * len(pair), *more[1]], pa.int64())], ["a", "b", "run"])

    return placed.groupBy("bucket").applyInArrow(meet, "a long, b long, run long")


def linked_through(df: DataFrame, key: str, text: str, pairs: DataFrame, labels: DataFrame, sets: DataFrame, bands: Bands, similarity: tuple[int, int]) -> tuple[DataFrame, DataFrame | None]:
    """The labels after the pairs ``a, b`` across components have been decided, and those pairs (None if there were none)."""
    tag = lambda x: labels.select(F.col("node").alias(f"k{x}"), F.col("component").alias(f"c{x}"))
    open_pairs = pass_sketch(pairs.distinct(), sets, bands).join(tag("a"), "ka", "left").join(tag("b"), "kb", "left")
    open_pairs = open_pairs.filter(F.coalesce("ca", "ka") != F.coalesce("cb", "kb")).select("ka", "a", "h2a", "kb", "b", "h2b")
    open_pairs = stored(open_pairs, "open-pairs")
    if open_pairs.isEmpty():
        return labels, None
    known = labels.select(F.col("node").alias("a"), F.col("component").alias("b"))  # stars that stand for all links so far
    return stored(components(known.union(verify(df, key, text, open_pairs, similarity))), "labels"), open_pairs


def similar_components(df: DataFrame, key: str = "doc_id", text: str = "text", similarity: tuple[int, int] = SIMILARITY) -> DataFrame:
    """Per row of ``df``: key, ``n_shingles`` and ``component_id``, the smallest key that links reach.

    Null, empty and wordless texts have no shingles and are linked with nothing, also not with each other. Equal sets are
    linked. A row without a key is counted, but takes no part in links and has a null component. Rows that share a key count as
    one node. Other columns are not read; an empty table gives no rows.
    """
    bounded_batches(df.sparkSession)
    bands = Bands(similarity)
    rows = describe(df, key, text).withColumn("salt", (F.monotonically_increasing_id() % SALTS).cast("int"))
    rows = stored(rows, "shingle-sets")
    per_salt = rows.filter("n > 0 and k is not null").groupBy("h1", "h2", "n", "salt").agg(F.min("k").alias("k"), F.min_by("sketch", "k").alias("sketch"))
    sets = stored(per_salt.groupBy("h1", "h2", "n").agg(F.min_by("sketch", "k").alias("sketch"), F.min("k").alias("k")), "distinct-sets")

    keyed = df.filter(F.col(key).isNotNull())
    size = rows.filter("k is not null").agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum("n"), F.lit(0)).alias("held")).first()
    found = stored(candidates(keyed, text, bands, frequent_shingles(keyed, text, size.rows, size.held)), "parts")
    ties = pass_sketch(found.filter("kind = 0").select("a", "b").distinct(), sets, bands)
    labels = stored(components(verify(df, key, text, ties, similarity)), "labels")

    # members of large parts meet again by their rarest shingles
    parts = None
    close = found.filter("kind = 1").select("a", "b")
    if not found.filter("kind = 2").isEmpty():
        again = stored(by_rarest_shingles(df, key, text, sets, found, similarity), "rare-groups")
        close = close.union(again.filter("kind < 2").select("a", "b"))
        if not again.filter("kind = 2").isEmpty():
            parts = stored(several_components(stored(part_members(again.filter("kind = 2")), "group-members"), sets, labels), "large-groups")
    asking, failed = None, df.sparkSession.createDataFrame([], "a long, b long")
    for step in range(STEPS):
        more = close if step == 0 else None
        if parts is not None:
            wider = stored(complete(parts, labels, asking, failed, bands, 16 * 8**step), "partners")
            asking = wider.filter("b is null").select("run", F.col("a").alias("h1")).distinct()
            wider = wider.filter("b is not null").select("a", "b")
            more = wider if more is None else more.union(wider)
        labels, more = linked_through(df, key, text, more, labels, sets, bands, similarity)
        if more is not None:
            failed = stored(failed.union(more.select("a", "b")), "tried-pairs")  # linked ones are in one component now
        if parts is None or not asking.limit(1).count():
            break
    else:
        raise RuntimeError(f"large parts were not complete after {STEPS} steps")

    named = sets.join(labels, sets["k"] == labels["node"], "left").select("h1", "h2", "n", F.coalesce("component", "k").alias("component_id"))
    told = per_salt.select("h1", "h2", "n", "salt").join(named, ["h1", "h2", "n"])
    out = rows.select("k", "n", "h1", "h2", "salt").join(told, ["h1", "h2", "n", "salt"], "left")
    component = F.when(F.col("k").isNull(), F.lit(None)).otherwise(F.coalesce("component_id", "k"))
    return out.select(F.col("k").alias(key), F.col("n").alias("n_shingles"), component.alias("component_id"))


def keep_one(df: DataFrame, key: str = "doc_id", text: str = "text", similarity: tuple[int, int] = SIMILARITY) -> DataFrame:
    """``df`` with the row of the smallest key of each component; all columns are kept. Rows without a key stay."""
    gone = stored(similar_components(df, key, text, similarity).filter(F.col(key) != F.col("component_id")).select(F.col(key).alias("__gone")).distinct(), "near-copies")
    if gone.count() <= BROADCAST_ROWS:
        gone = F.broadcast(gone)
    return df.join(gone, F.col(key) == F.col("__gone"), "left_anti")
