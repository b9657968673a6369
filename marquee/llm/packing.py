"""Packing by lexical retrieval: windows of a fixed number of tokens, filled with the lexical neighbours of a seed document.

Texts are encoded once into a stored table, together with each task's document frequencies, so inverse document frequencies are
those of the whole corpus (the vocabulary bounds that table and its broadcast). Each row is then stored with a content key: the signs of
its terms, weighted by those frequencies and projected to ``ROUTE_BITS`` numbers, then the term that a weighted minimum hash draws from
it (near copies draw the same one), then a number of its own. Nothing in that key is learned from a sample. Rows are dealt by ranges of
it, so a shard is a lexical neighbourhood of the whole table wherever its rows came from, and a hot leaf or a hot set of copies goes on
through several tasks.

Each task cuts its rows into shards of at most ``shard_tokens`` tokens. A shard holds a BM25 inverted index over token ids. The first
unused document is the seed of a window; all its distinct ids ask the index, and its unused neighbours, best first, fill the window: the
best that fits whole as long as any does, at last the best one is cut at the window's end and what is left of it begins, and seeds, the
next window. The last window of a shard is cut into powers of two, so nothing is padded. Neighbours in other shards are not seen. Rows of a
shard are in the order of their stored keys, so a repeated task gives the same pieces.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, mix, stored, text_slices, worker_cache
from .tokens import ENCODE_BYTES, codec, encode_rows

WINDOW = 2048
END_ID = 1
SHARD_TOKENS = 4_000_000
SHARD_DOCUMENTS = 8192
K1, B = 1.2, 0.75
DENSE_BYTES = 64 << 20  # frequent terms of a shard as plain rows; the others are lists
ROUTE_BITS = 16  # signs of the content key


def _route_tables(ids: int) -> tuple[np.ndarray, np.ndarray]:
    """For every id: its direction in the projection, and its draw in the minimum hash."""

    def make():
        random = np.random.default_rng(11)
        return random.standard_normal((ids, ROUTE_BITS), np.float32), random.exponential(size=ids)

    return worker_cache(f"routes-{ids}", make)


def id_type(ids: int) -> str:
    """How ids are kept between the stages: two bytes hold them if the vocabulary is small enough."""
    return "<u2" if ids <= 1 << 16 else "<u4"


def content_keys(distinct: list[np.ndarray], idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each document's distinct ids: the signs of their projection as a number, and the id that a minimum hash draws, both weighted
    by ``idf``."""
    direction, draw = _route_tables(len(idf))
    draw = draw / idf
    vectors, drawn = np.zeros((len(distinct), ROUTE_BITS)), np.zeros(len(distinct), np.int32)
    for i, term in enumerate(distinct):
        vectors[i] = idf[term] @ direction[term]
        drawn[i] = term[draw[term].argmin()]
    return ((vectors > 0) @ (1 << np.arange(ROUTE_BITS)[::-1])).astype(np.int32), drawn


def encoded(df: DataFrame, key: str, text: str, json_path: str, rank_path: str | None, end_id: int) -> DataFrame:
    """Rows ``k, ids, place`` (ids of ``id_type`` with ``end_id`` last, and a number of its own), and one row of document frequencies
    ``df`` per task."""
    kind = df.schema[key].dataType.simpleString()
    names = ["k", "ids", "df", "place"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        coder = codec(json_path, rank_path)
        frequency = np.zeros(len(coder.width), np.int32)
        type_, number = None, TaskContext.get().partitionId() << 40
        for batch in batches:
            type_ = batch.schema.field(0).type
            for a, b in text_slices(batch.column(1), ENCODE_BYTES):
                ids, count = encode_rows(batch.column(1).slice(a, b - a), coder)
                end = np.cumsum(count)
                with_end = np.insert(ids, end, end_id).astype(id_type(len(coder.width)))
                bounds = np.concatenate([[0], end + np.arange(1, len(end) + 1)])
                documents = [with_end[bounds[i] : bounds[i + 1]] for i in range(b - a)]
                for own in documents:
                    frequency[np.unique(own)] += 1
                place = mix(np.arange(number, number + b - a, dtype=np.uint64)).view(np.int64)
                number += b - a
                out = pa.array([own.tobytes() for own in documents], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), out, pa.nulls(b - a, pa.list_(pa.int32())), pa.array(place)], names)
        if type_ is not None:
            yield pa.RecordBatch.from_arrays([pa.nulls(1, type_), pa.nulls(1, pa.binary()), pa.array([frequency], pa.list_(pa.int32())), pa.nulls(1, pa.int64())], names)

    return df.select(F.col(key).alias("k"), F.col(text).alias("t")).mapInArrow(run, f"k {kind}, ids binary, df array<int>, place long")


def routed(held: DataFrame, idf: np.ndarray) -> DataFrame:
    """Rows ``k, ids, place`` with their content key ``leaf, term, place``; ``idf`` are the weights of the whole corpus."""
    names = ["k", "ids", "place", "leaf", "term"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            leaf, term = content_keys([np.unique(np.frombuffer(ids, id_type(len(idf)))) for ids in batch.column(1).to_pylist()], idf)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(leaf), pa.array(term)], names)

    rows = held.select("k", "ids", "place")
    return rows.mapInArrow(run, f"k {rows.schema['k'].dataType.simpleString()}, ids binary, place long, leaf int, term int")


def inverse_frequencies(table: DataFrame) -> np.ndarray:
    """BM25 weights of all ids over the whole corpus: as many numbers as the vocabulary has."""
    n = table.filter("ids is not null").count()
    counts = table.filter("df is not null").select(F.posexplode("df").alias("id", "n")).groupBy("id").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(int(counts["id"].max()) + 1 if len(counts) else 1, np.float64)
    out[counts["id"]] = counts["n"]
    return np.log1p((n - out + 0.5) / (out + 0.5)).astype(np.float32)


class Bm25Index:
    """Postings of a shard's documents; terms in many documents are rows of plain numbers as far as ``DENSE_BYTES`` go."""

    def __init__(self, documents: list[np.ndarray], idf: np.ndarray):
        n = len(documents)
        size = np.array([len(d) for d in documents], np.int64)
        key = np.repeat(np.arange(n, dtype=np.int64) << 32, size)
        key |= np.concatenate(documents)
        key.sort()
        first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        tf = np.diff(np.append(first, len(key)))
        key = key[first]
        owner, self.term = key >> 32, key & 0xFFFFFFFF
        norm = K1 * (1 - B + B * size / max(size.mean(), 1))
        weight = (idf[self.term] * tf * (K1 + 1) / (tf + norm[owner])).astype(np.float32)
        self.first = np.searchsorted(owner, np.arange(n + 1))  # forward: terms of a document
        order = np.argsort(self.term, kind="stable")
        self.owner, self.weight = owner[order], weight[order]
        self.posting = np.searchsorted(self.term[order], np.arange(len(idf) + 1))
        held = np.diff(self.posting)
        frequent = np.argsort(-held, kind="stable")[: DENSE_BYTES // (4 * n)]
        frequent = frequent[held[frequent] * 16 > n]
        self.row = np.full(len(idf), -1)
        self.row[frequent] = np.arange(len(frequent))
        self.dense = np.zeros((len(frequent), n), np.float32)
        for i, t in enumerate(frequent):
            p = slice(self.posting[t], self.posting[t + 1])
            self.dense[i, self.owner[p]] = self.weight[p]

    def scores(self, seed: int) -> np.ndarray:
        """BM25 of every document for all distinct ids of the seed."""
        terms = self.term[self.first[seed] : self.first[seed + 1]]
        row = self.row[terms]
        rest = terms[row < 0]
        begin, n = self.posting[rest], self.posting[rest + 1] - self.posting[rest]
        at = np.repeat(begin - np.cumsum(n) + n, n) + np.arange(n.sum())
        out = np.bincount(self.owner[at], self.weight[at], self.dense.shape[1]).astype(np.float32)
        for r in row[row >= 0]:
            out += self.dense[r]
        return out


def pack_shard(documents: list[np.ndarray], idf: np.ndarray, window: int) -> list[list[tuple[int, int, int]]]:
    """Sequences of pieces ``(document, start, length)``; every id is in exactly one piece."""
    index, size = Bm25Index(documents, idf), np.array([len(d) for d in documents])
    unused, following = np.ones(len(documents), bool), 0
    sequences, current, room = [], [], window

    def place(document: int, start: int) -> int:
        """Put what fits into windows; returns where the rest of the document would go on (none left: its length)."""
        nonlocal current, room
        total = len(documents[document])
        while start < total:
            n = min(room, total - start)
            current.append((document, start, n))
            start, room = start + n, room - n
            if not room:
                sequences.append(current)
                current, room = [], window
        return start

    while True:
        while following < len(unused) and not unused[following]:
            following += 1
        if following == len(unused):
            break
        seed = following
        unused[seed] = False
        place(seed, 0)
        while room < window:  # the window is open: ask for the neighbours of the document it began with
            score = index.scores(current[0][0])
            near = np.flatnonzero(unused & (score > 0))
            score, long = score[near], size[near]
            begun = len(sequences)
            while len(sequences) == begun and score.any():
                best = np.where(long <= room, score, 0).argmax()  # of all that fit whole; the first of equal ones
                if long[best] > room or not score[best]:
                    best = score.argmax()
                score[best], unused[near[best]] = 0, False
                place(near[best], 0)
            if len(sequences) == begun:
                break  # no neighbour is left: the next seed goes on in this window
    if current:  # the last window: powers of two need no padding
        left, n = [], sum(p[2] for p in current)
        sizes = [1 << i for i in reversed(range(n.bit_length())) if n >> i & 1]
        need = sizes.pop(0)
        for document, start, length in current:
            while length:
                part = min(length, need)
                left.append((document, start, part))
                start, length, need = start + part, length - part, need - part
                if not need:
                    sequences.append(left)
                    left, need = [], sizes.pop(0) if sizes else 0
    return sequences


def pack(df: DataFrame, json_path: str, rank_path: str | None = None, key: str = "doc_id", text: str = "text", window: int = WINDOW, end_id: int = END_ID, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """The pieces of all texts: key, ``start``, ``length``, ``ids`` (unsigned 32-bit, little-endian), ``doc_tokens``,
    ``sequence_id`` and ``offset``.

    A document is the ids of its whole text and ``end_id``; null and empty texts are ``end_id`` alone. Rows are packed one by one, so
    repeated rows, null keys and equal texts each have their own pieces. A document longer than a window goes through
    several. Of neighbours with equal scores the first by content key comes first. Other columns are not read; an empty table gives no rows.
    """
    bounded_batches(df.sparkSession, 250)  # long documents are neighbours of each other, so a batch may hold only such
    table = stored(encoded(df, key, text, json_path, rank_path, end_id), "token-ids", "zstd")
    idf = inverse_frequencies(table)
    held = stored(routed(table.filter("ids is not null"), idf), "routed-ids", "zstd")  # ranges are drawn from it before it is dealt
    n = held.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(F.octet_length("ids")), F.lit(0)).alias("bytes")).first()
    parts = int(1.2 * max(n.bytes / np.dtype(id_type(len(idf))).itemsize / shard_tokens, n.rows / SHARD_DOCUMENTS)) + 1  # a task's rows are one shard, seldom two
    order = ["leaf", "term", "place"]
    kind = df.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 33
        keys, documents, tokens = [], [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal number, keys, documents, tokens
            rows: list[list] = [[] for _ in range(7)]
            names = [key, "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]
            types = [type_, pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
            for sequence in pack_shard(documents, idf, window):
                at = 0
                for document, start, length in sequence:
                    ids = documents[document]
                    for column, value in zip(rows, (keys[document], start, length, ids[start : start + length].astype("<u4").tobytes(), len(ids), number, at), strict=True):
                        column.append(value)
                    at += length
                number += 1
                if len(rows[0]) >= 4096:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, types, strict=True)], names)
                    rows = [[] for _ in range(7)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, types, strict=True)], names)
            keys, documents, tokens = [], [], 0

        type_ = None
        for batch in batches:
            type_ = batch.schema.field(0).type
            for k, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = np.frombuffer(ids, id_type(len(idf)))
                keys.append(k)
                documents.append(own)
                tokens += len(own)
                if tokens >= shard_tokens or len(documents) >= SHARD_DOCUMENTS:
                    yield from flush()
        if documents:
            yield from flush()

    return held.select("k", "ids", *order).repartitionByRange(parts, *order).sortWithinPartitions(*order).select("k", "ids").mapInArrow(run, schema)


def piece_rows(pieces: DataFrame) -> DataFrame:
    """Pieces with a checksum instead of their ids."""
    return pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids")
