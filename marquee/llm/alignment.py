"""Cross-tokenizer alignment with an identity map: which tokens of two vocabularies cover the same bytes, and how often corpus-wide.

Tokenizer A is a byte-level BPE file and reads a space before each text, tokenizer B is a sentencepiece model and adds that space
itself, so both cut the same bytes. Byte offsets where tokens of both end cut a text into groups; two tokens are linked where they overlap.

*Identity map.* For every A id, the B id of the same bytes is computed once. Links between such ids, nearly all of them exact
one-to-one groups, are counted in vectors as long as the vocabulary of A: a task hands on one vector. Only links of irregular groups
become pairs that are counted by a shuffle, after each task has added up its own.

*Pieces.* Both tokenizers always cut at a single space between two visible characters (``tokens.stable_starts``; no entry of B has
a space after another character, which is checked), so texts are cut there, and equal pieces are aligned once per slice of text.

*Back to the documents.* Counts of identity pairs and the highest count of each A id are vectors of vocabulary length and are
broadcast. Pairs are broadcast from the most frequent down, ``BROADCAST_PAIRS`` at most; the rest, rare by construction and so without
hot keys, is joined.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, flat, stored, text_slices, worker_cache
from .tokens import Codec, encode_rows, stable_starts

SLICE_BYTES = 2 << 20
FLUSH_PAIRS = 2_000_000
BROADCAST_PAIRS = 2_000_000
SEGMENT = 4096  # of a vector that travels as one row
FAN_IN = 256  # vectors of so many tasks are added in one group
SPACE_MARK = "▁"


class PlainCodec(Codec):
    """Tokenizer A; the strings of special tokens are plain text."""

    def encode(self, text: bytes) -> np.ndarray:
        if self.ranks is not None and (not text or int(np.frombuffer(text, np.uint8).max()) < 0xD4):
            return self.ranks.encode_to_numpy(text.decode(), disallowed_special=()).astype(np.int64)
        if self.library is None:
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_file(self.json_path)
        self.library.encode_special_tokens = True
        return np.array(self.library.encode(text.decode(), add_special_tokens=False).ids, np.int64)


def byte_symbols() -> dict[str, int]:
    """The character that stands for each byte in a byte-level vocabulary: visible ones for themselves, the others from U+0100 on."""
    own = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or b >= 0xAE]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class Pool:
    """Byte strings by number."""

    def __init__(self, strings: list[bytes]):
        self.size = np.array([len(s) for s in strings], np.int64)
        self.at = np.cumsum(self.size) - self.size
        self.body = np.frombuffer(b"".join(strings), np.uint8)

    def joined(self, index: np.ndarray, extra: int = 0) -> np.ndarray:
        """The strings ``index`` one after another, with ``extra`` bytes of zero behind each."""
        size = self.size[index]
        begin = np.cumsum(size + extra) - size - extra
        out = np.zeros(int((size + extra).sum()), np.uint8)
        inside = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
        out[np.repeat(begin, size) + inside] = self.body[np.repeat(self.at[index], size) + inside]
        return out


class Tokenizers:
    """Both tokenizers, the bytes of their ids, and the identity map."""

    def __init__(self, json_path: str, rank_path: str | None, model_path: str):
        import sentencepiece

        self.a = PlainCodec(json_path, rank_path)
        with open(json_path, encoding="utf-8") as described:
            read = json.load(described)
        symbols, names = byte_symbols(), {}
        for entry, i in read["model"]["vocab"].items():
            names[i] = bytes(symbols[c] for c in entry) if all(c in symbols for c in entry) else entry.encode()
        names |= {t["id"]: t["content"].encode() for t in read["added_tokens"]}
        a = [names.get(i, b"") for i in range(max(names) + 1)]
        self.b = sentencepiece.SentencePieceProcessor(model_file=model_path)
        entries = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        if any(SPACE_MARK in p.lstrip(SPACE_MARK) for p in entries):
            raise ValueError("an entry of the piece model has a space after another character: its texts cannot be cut at spaces")
        b = [bytes([int(p[1:-1], 16)]) if self.b.is_byte(i) else p.replace(SPACE_MARK, " ").encode() for i, p in enumerate(entries)]
        self.pool_a, self.pool_b = Pool(a), Pool(b)
        self.decimal = Pool([str(i).encode() for i in range(max(len(a), len(b)))])
        usable = lambda i: not (self.b.is_control(i) or self.b.is_unknown(i) or self.b.is_unused(i))
        place = {s: i for i, s in reversed(list(enumerate(b))) if usable(i) and not self.b.is_byte(i)}
        place = {s: i for i, s in enumerate(b) if self.b.is_byte(i)} | place  # of equal bytes, the entry that is not a byte
        self.identity = np.array([place.get(s, -1) if s else -1 for s in a], np.int64)

    def encode_b(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces that begin with a space, which the model adds itself."""
        out = self.b.encode([p.decode()[1:] for p in pieces.to_pylist()], num_threads=1)
        number = np.fromiter((len(x) for x in out), np.int64, len(out))
        return np.fromiter((i for x in out for i in x), np.int64, int(number.sum())), number


def tokenizers(json_path: str, rank_path: str | None, model_path: str) -> Tokenizers:
    return worker_cache(f"align {json_path} {rank_path} {model_path}", lambda: Tokenizers(json_path, rank_path, model_path))


@dataclass
class Aligned:
    """Distinct pieces: tokens, groups and links of each, and its groups as text, each with a semicolon behind it."""

    good: np.ndarray  # both sides join to the piece's bytes; the others have no tokens
    n_a: np.ndarray
    n_b: np.ndarray
    n_groups: np.ndarray
    n_links: np.ndarray
    link_a: np.ndarray
    link_b: np.ndarray
    described: pa.Array


def _per(index: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(index, minlength=n)


def align(pieces: pa.Array, tok: Tokenizers) -> Aligned:
    """Alignment of distinct pieces (large binary), each of which begins with a space."""
    body, at = flat(pieces)
    size, n = np.diff(at), len(pieces)
    sides = []
    good = np.ones(n, bool)
    for (ids, number), pool in ((encode_rows(pieces.cast(pa.large_string()), tok.a), tok.pool_a), (tok.encode_b(pieces), tok.pool_b)):
        row = np.repeat(np.arange(n), number)
        own = np.bincount(row, weights=pool.size[ids], minlength=n).astype(np.int64) == size
        held = np.repeat(own, size)
        wrong = np.flatnonzero(pool.joined(ids[own[row]]) != body[held])
        own[np.repeat(np.arange(n), size)[held][wrong]] = False
        good &= own
        sides.append((ids, row, pool))
    (a, row_a, _), (b, row_b, _) = sides
    keep_a, keep_b = good[row_a], good[row_b]
    a, b, row_a, row_b = a[keep_a], b[keep_b], row_a[keep_a], row_b[keep_b]
    end_a, end_b = np.cumsum(tok.pool_a.size[a]), np.cumsum(tok.pool_b.size[b])
    common, every = np.intersect1d(end_a, end_b, assume_unique=True), np.union1d(end_a, end_b)
    piece_end = np.cumsum(np.where(good, size, 0))
    of = lambda ends: _per(np.searchsorted(piece_end, ends), n)
    group_a, group_b = np.searchsorted(common, end_a), np.searchsorted(common, end_b)
    per_a, per_b = _per(group_a, len(common)), _per(group_b, len(common))
    # groups as text: the A ids of a group, then its B ids, each with the sign that follows it
    place_a = np.arange(len(a)) + (np.cumsum(per_b) - per_b)[group_a]
    place_b = np.arange(len(b)) + np.cumsum(per_a)[group_b]
    ids, sign = np.zeros(len(a) + len(b), np.int64), np.zeros(len(a) + len(b), np.uint8)
    last = lambda group: np.append(group[1:] != group[:-1], True)[: len(group)]
    ids[place_a], sign[place_a] = a, np.where(last(group_a), ord("|"), ord(","))
    ids[place_b], sign[place_b] = b, np.where(last(group_b), ord(";"), ord(","))
    text = tok.decimal.joined(ids, 1)
    width = tok.decimal.size[ids] + 1
    text[np.cumsum(width) - 1] = sign
    row = np.zeros(len(ids), np.int64)
    row[place_a], row[place_b] = row_a, row_b
    bounds = np.concatenate([[0], np.cumsum(np.bincount(row, weights=width, minlength=n).astype(np.int64))])
    described = pa.LargeBinaryArray.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(bounds), pa.py_buffer(text)])
    return Aligned(good, of(end_a), of(end_b), of(common), of(every), a[np.searchsorted(end_a, every)], b[np.searchsorted(end_b, every)], described)


def cut(texts: pa.Array) -> tuple[pa.DictionaryArray, np.ndarray]:
    """The texts, a space before each that is not empty, as pieces between stable boundaries; and the row of every piece."""
    data, offsets = flat(texts)
    full = np.diff(offsets) > 0
    data = np.insert(data, offsets[:-1][full], 0x20)
    offsets = offsets + np.concatenate([[0], np.cumsum(full)])
    mark = np.zeros(len(data) + 1, bool)
    mark[stable_starts(data)] = True
    mark[offsets[:-1][full]] = True
    cuts = np.flatnonzero(mark[:-1])
    bounds = np.append(cuts, len(data))
    pieces = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(cuts), [None, pa.py_buffer(bounds), pa.py_buffer(data)])
    return pieces.dictionary_encode(), np.searchsorted(offsets, cuts, "right") - 1


def align_texts(texts: pa.Array, tok: Tokenizers) -> pa.Table:
    """Per text: numbers of tokens, groups and links, the digest of its groups, and its distinct linked pairs with their number of
    links: ``same`` (A ids, identity pairs) and ``pairs`` (A id times the size of B plus B id), each sorted."""
    n = len(texts)
    coded, row = cut(texts)
    at = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    found = align(coded.dictionary, tok)
    fit = np.bincount(row, minlength=n) > 0
    fit[row[~found.good[at]]] = False
    keep = fit[row]
    at, row = at[keep], row[keep]
    total = lambda per: np.bincount(row, weights=per[at], minlength=n).astype(np.int64)
    text = found.described.take(pa.array(at))
    body, where = flat(text)
    bounds = np.searchsorted(row, np.arange(n + 1))
    held = body.tobytes()
    digests = [hashlib.sha256(held[where[i] : where[j] - 1]).hexdigest() if j > i else "" for i, j in zip(bounds[:-1], bounds[1:], strict=True)]

    wide = len(tok.pool_b.size)
    known, code = np.unique(found.link_a * wide + found.link_b, return_inverse=True)
    first, number = np.cumsum(found.n_links) - found.n_links, found.n_links[at]
    inside = np.arange(int(number.sum())) - np.repeat(np.cumsum(number) - number, number)
    linked = np.repeat(row, number) * max(len(known), 1) + code[np.repeat(first[at], number) + inside]
    linked, times = np.unique(linked, return_counts=True)
    of, pair = linked // max(len(known), 1), known[linked % max(len(known), 1)] if len(known) else linked
    same = tok.identity[pair // wide] == pair % wide if len(pair) else np.zeros(0, bool)

    def lists(mask: np.ndarray, values: np.ndarray, kind: pa.DataType) -> pa.Array:
        edges = np.searchsorted(of[mask], np.arange(n + 1)).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(edges), pa.array(values[mask], kind))

    columns = {
        "n_a": pa.array(total(found.n_a)), "n_b": pa.array(total(found.n_b)), "n_groups": pa.array(total(found.n_groups)), "n_links": pa.array(total(found.n_links)),
        "groups_sha256": pa.array(digests, pa.string()), "same": lists(same, pair // wide, pa.int32()), "same_links": lists(same, times, pa.int32()),
        "pairs": lists(~same, pair, pa.int64()), "pair_links": lists(~same, times, pa.int32()),
    }
    return pa.table(columns)


ROW = "n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, same array<int>, same_links array<int>, pairs array<long>, pair_links array<int>"


def flat_list(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values of a list column, and the row of each."""
    return column.flatten().to_numpy(zero_copy_only=False), np.repeat(np.arange(len(column)), np.diff(column.offsets.to_numpy()))


def document_counts(rows: DataFrame, vocabulary: int) -> tuple[np.ndarray, DataFrame]:
    """In how many documents each identity pair is linked, as a vector over the A ids, and each other pair, as a table ``pair, n``."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vector, keys, numbers, waiting = np.zeros(vocabulary, np.int64), [], [], 0

        def merged() -> tuple[np.ndarray, np.ndarray]:
            key, index = np.unique(np.concatenate(keys), return_inverse=True)
            return key, np.bincount(index, weights=np.concatenate(numbers)).astype(np.int64)

        def told(key: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.nulls(len(key), pa.int32()), pa.nulls(len(key), pa.binary()), pa.array(key, pa.int64()), pa.array(n, pa.int64())], ["segment", "held", "pair", "n"])

        for batch in batches:
            vector += np.bincount(batch.column(0).flatten().to_numpy(zero_copy_only=False), minlength=vocabulary)
            key, n = np.unique(batch.column(1).flatten().to_numpy(zero_copy_only=False), return_counts=True)
            keys.append(key)
            numbers.append(n)
            waiting += len(key)
            if waiting > FLUSH_PAIRS:
                key, n = merged()
                if 2 * len(key) > FLUSH_PAIRS:  # little to add up any more
                    yield told(key, n)
                    key, n = key[:0], n[:0]
                keys, numbers, waiting = [key], [n], len(key)
        if keys:
            yield told(*merged())
            parts = [(i // SEGMENT, vector[i : i + SEGMENT].tobytes()) for i in range(0, vocabulary, SEGMENT)]
            numbers_of, held = zip(*parts, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(numbers_of, pa.int32()), pa.array(held, pa.binary()), pa.nulls(len(parts), pa.int64()), pa.nulls(len(parts), pa.int64())], ["segment", "held", "pair", "n"])

    def add(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x.as_py(), np.int64) for x in table["held"])
        return pa.table([table["segment"].slice(0, 1), pa.array([total.tobytes()], pa.binary())], ["segment", "held"])

    counted = rows.select("same", "pairs").mapInArrow(count, "segment int, held binary, pair long, n long")
    counted = stored(counted.withColumn("task", F.spark_partition_id()), "alignment-counts")
    vectors = counted.filter("segment is not null").select("segment", "held", F.floor(F.col("task") / FAN_IN).alias("bundle"))
    vectors = vectors.groupBy("segment", "bundle").applyInArrow(add, "segment int, held binary").groupBy("segment").applyInArrow(add, "segment int, held binary")
    whole = np.zeros(vocabulary, np.int64)
    for r in vectors.collect():  # as long as the vocabulary
        part = np.frombuffer(r.held, np.int64)
        whole[r.segment * SEGMENT : r.segment * SEGMENT + len(part)] = part
    return whole, stored(counted.filter("pair is not null").groupBy("pair").agg(F.sum("n").alias("n")), "alignment-pairs")


def frequent(pairs: DataFrame, bound: int) -> int:
    """The smallest class of counts (eighths of a power of two) from which on there are at most ``bound`` pairs."""
    level = F.floor(F.log2("n") * 8).cast("int")
    classes = pairs.groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("n")).collect()  # some hundred classes at most
    held, least = 0, 1 << 30
    for r in sorted(classes, key=lambda r: -r.level):
        held += r.n
        if held > bound:
            break
        least = r.level
    return least


def align_documents(df: DataFrame, json_path: str, rank_path: str | None, model_path: str, key: str = "doc_id", text: str = "text", broadcast_pairs: int = BROADCAST_PAIRS) -> DataFrame:
    """Per row of ``df``: key, ``n_a``, ``n_b``, ``n_groups``, ``n_links``, ``n_best``, ``count_sum``, ``groups_sha256``.

    A pair's count is the number of rows that hold it linked. ``n_best`` counts the links whose pair has the highest count of its
    A id, ties included; ``count_sum`` adds up the counts of all links. Null and empty texts, and texts that either tokenizer does not give
    back byte for byte, have no tokens: zeros and an empty digest. Repeated rows, and rows of one key or none, are documents of
    their own. Other columns are not read; an empty table gives no rows.
    """
    bounded_batches(df.sparkSession)
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = tokenizers(json_path, rank_path, model_path)
        for batch in batches:
            for a, b in text_slices(batch.column(1), SLICE_BYTES):
                done = align_texts(batch.column(1).slice(a, b - a), tok).combine_chunks()
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), *[c.combine_chunks() for c in done.columns]], ["k", *done.column_names])

    rows = df.select(F.col(key).alias("k"), F.col(text).alias("t")).mapInArrow(run, f"k {kind}, {ROW}")
    rows = stored(rows.withColumn("r", F.monotonically_increasing_id()), "alignment-rows")
    here = Tokenizers(json_path, rank_path, model_path)
    size_a, size_b = len(here.pool_a.size), len(here.pool_b.size)
    vector, pairs = document_counts(rows, size_a)
    of_a = F.floor(F.col("pair") / size_b).cast("int")
    best = vector.copy()
    highest = pairs.groupBy(of_a.alias("a")).agg(F.max("n").alias("n"))
    for r in highest.collect():  # one row per A id at most
        best[r.a] = max(best[r.a], r.n)
    least = frequent(pairs, broadcast_pairs)
    often = F.floor(F.log2("n") * 8) >= least
    sent = pairs.filter(often).toPandas().sort_values("pair")
    shared = df.sparkSession.sparkContext.broadcast((vector, best, sent["pair"].to_numpy(np.int64), sent["n"].to_numpy(np.int64)))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vector, best, key, n = shared.value
        for batch in batches:
            rows_here = batch.num_rows
            a, row = flat_list(batch.column(1))
            links = batch.column(2).flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            won = np.bincount(row, weights=links * (vector[a] == best[a]), minlength=rows_here).astype(np.int64)
            total = np.zeros(rows_here, np.int64)
            np.add.at(total, row, links * vector[a])
            pair, row = flat_list(batch.column(3))
            links = batch.column(4).flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            place = np.minimum(np.searchsorted(key, pair), max(len(key) - 1, 0))
            known = key[place] == pair if len(key) else np.zeros(len(pair), bool)
            count = np.where(known, n[place], 0) if len(key) else np.zeros(len(pair), np.int64)
            won += np.bincount(row, weights=links * known * (count == best[pair // size_b]), minlength=rows_here).astype(np.int64)
            np.add.at(total, row, links * count)
            edges = np.searchsorted(row[~known], np.arange(rows_here + 1)).astype(np.int32)
            rest = [pa.ListArray.from_arrays(pa.array(edges), pa.array(x[~known], t)) for x, t in ((pair, pa.int64()), (links, pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(won), pa.array(total), *rest], ["r", "won", "total", "rest", "rest_links"])

    scored = rows.select("r", "same", "same_links", "pairs", "pair_links").mapInArrow(score, "r long, won long, total long, rest array<long>, rest_links array<long>")
    carried = ["k", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]
    if least > 0 and not pairs.filter(~often).isEmpty():  # rare pairs are beyond the broadcast
        scored = stored(scored, "alignment-scores")
        asked = scored.select("r", F.explode(F.arrays_zip("rest", "rest_links")).alias("x")).select("r", F.col("x.rest").alias("pair"), F.col("x.rest_links").alias("links"))
        top = df.sparkSession.createDataFrame([(i, int(x)) for i, x in enumerate(best)], "a int, top long")
        rare = pairs.filter(~often).withColumn("a", of_a).join(F.broadcast(top), "a").select("pair", "n", (F.col("n") == F.col("top")).cast("long").alias("first"))
        late = asked.join(rare, "pair").groupBy("r").agg(F.sum(F.col("links") * F.col("first")).alias("more_won"), F.sum(F.col("links") * F.col("n")).alias("more_total"))
        scored = scored.join(late, "r", "left")
        scored = scored.withColumn("won", F.col("won") + F.coalesce("more_won", F.lit(0))).withColumn("total", F.col("total") + F.coalesce("more_total", F.lit(0)))
    done = rows.select("r", *carried).join(scored.select("r", "won", "total"), "r")
    return done.select(F.col("k").alias(key), "n_a", "n_b", "n_groups", "n_links", F.col("won").alias("n_best"), F.col("total").alias("count_sum"), "groups_sha256")
