"""Token ids of whole texts under a byte-level BPE file, and token counts by overlap resynchronisation.

The file's own library defines the ids. Two facts make that cheap without changing them:

* *Stable boundaries.* The byte-level pre-tokenizer always starts a new pre-token at a single space that stands between two
  visible characters, whatever comes before or after, and merges never cross pre-tokens. Text may be cut there.
* *Same vocabulary.* The rank file beside the JSON file holds the same merges, and its encoder is several times as fast.
  It is used where the Unicode classes of both libraries agree for certain (code points below U+0500, see ``_plain``);
  rows with any other character go through the library of the JSON file itself.

Texts of a batch are cut at stable boundaries, equal pieces are encoded once, and ids are laid out by index arithmetic.
Documents above ``huge_bytes`` are encoded in overlapping chunks (``resynchronised``), so memory stays bounded.
"""

from __future__ import annotations

import base64
import json
import os
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, flat, text_slices, worker_cache

HUGE_BYTES = 32_768
OVERLAP_BYTES = 256
ENCODE_BYTES = 2 << 20
PIECE_PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"  # fixed value: the byte-level pre-tokenizer


class Codec:
    """Both encoders of one vocabulary, and the bytes of each id."""

    def __init__(self, json_path: str, rank_path: str | None):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.json_path, self.library = json_path, None
        import tiktoken

        with open(json_path, encoding="utf-8") as described:
            special = {t["content"]: t["id"] for t in json.load(described)["added_tokens"]}
        self.ranks = None
        if rank_path and os.path.exists(rank_path):
            with open(rank_path, "rb") as lines:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
            self.ranks = tiktoken.Encoding("ranks", pat_str=PIECE_PATTERN, mergeable_ranks=ranks, special_tokens=special)
            width = {i: len(b) for b, i in ranks.items()} | {i: len(s.encode()) for s, i in special.items()}
        else:
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_file(json_path)
            width = {i: len(t) for t, i in self.library.get_vocab(with_added_tokens=False).items()}  # one symbol per byte
            width |= {i: len(s.encode()) for s, i in special.items()}
        self.special = special
        self.width = np.zeros(max(width) + 1, np.int64)
        self.width[list(width)] = list(width.values())

    def encode(self, text: bytes) -> np.ndarray:
        """Ids of one text."""
        if self.ranks is not None and _plain(text):
            return self.ranks.encode_to_numpy(text.decode(), allowed_special="all").astype(np.int64)
        if self.library is None:  # rarely needed: loaded on first use
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_file(self.json_path)
        return np.array(self.library.encode(text.decode(), add_special_tokens=False).ids, np.int64)


def codec(json_path: str, rank_path: str | None) -> Codec:
    return worker_cache(f"codec {json_path} {rank_path}", lambda: Codec(json_path, rank_path))


def _plain(text: bytes) -> bool:
    """Whether all characters are below U+0500, where both libraries agree on letters, digits and white space."""
    return not len(text) or int(np.frombuffer(text, np.uint8).max()) < 0xD4


def stable_starts(data: np.ndarray) -> np.ndarray:
    """Positions of single spaces between two visible characters of ASCII or Latin-1 letters."""
    n = len(data)
    if n < 3:
        return np.zeros(0, np.int64)
    at = np.flatnonzero(data[1:-1] == 0x20) + 1
    before, after = data[at - 1], data[at + 1]
    visible = (before > 0x20) & (before < 0x7F)
    visible |= (before >= 0x80) & (before < 0xC0) & (at >= 2) & (data[np.maximum(at - 2, 0)] == 0xC3)
    return at[visible & ((after > 0x20) & (after < 0x7F) | (after == 0xC3))]


def resynchronised(data: np.ndarray, encode: Callable[[bytes], np.ndarray], width: np.ndarray, chunk: int = HUGE_BYTES, overlap: int = OVERLAP_BYTES) -> np.ndarray:
    """Ids of one huge text from overlapping chunks.

    Each chunk is encoded with byte offsets. Two neighbours are spliced at the first position of their overlap that is a
    stable boundary of the text and a token boundary of both encodings; what lies right of it depends on no byte left of it
    and the other way round, so the spliced ids are those of the whole text. Where the overlap holds no such position it is
    doubled, at the end up to the whole rest of the text.
    """
    n, stable = len(data), stable_starts(data)
    starts_character = lambda i: i >= n or (data[i] & 0xC0) != 0x80

    def aligned(i: int) -> int:
        while not starts_character(i):
            i += 1
        return min(i, n)

    out, begin, left = [], 0, None  # left: (ids, ends, offset) of the chunk that waits for its right neighbour
    left_ids, left_from = encode(data[: aligned(chunk)].tobytes()), 0
    end = aligned(chunk)
    while end < n:
        wide = overlap
        while True:
            begin = end - wide
            if begin <= left_from:  # widened over the whole chunk: encode both as one
                end = aligned(min(n, end + max(chunk, end - left_from)))
                left_ids = encode(data[left_from:end].tobytes())
                if end >= n:
                    break
                wide = overlap
                continue
            begin = aligned(begin)
            left_at = left_from + np.concatenate([[0], np.cumsum(width[left_ids])])
            common = stable[(stable > begin) & (stable < end)]
            common = common[np.isin(common, left_at)]
            if len(common):
                stop = aligned(min(n, begin + chunk + wide))
                right_ids = encode(data[begin:stop].tobytes())
                right_at = begin + np.concatenate([[0], np.cumsum(width[right_ids])])
                common = common[np.isin(common, right_at)]
                if len(common):
                    at = common[0]
                    out.append(left_ids[: np.searchsorted(left_at, at)])
                    left_ids, left_from, end = right_ids[np.searchsorted(right_at, at) :], int(at), stop
                    break
            wide *= 2
    return np.concatenate([*out, left_ids])


def encode_rows(column: pa.Array, coder: Codec, huge: int = HUGE_BYTES) -> tuple[np.ndarray, np.ndarray]:
    """All ids of the rows one after another, and the number of ids of each row."""
    data, offsets = flat(column)
    size = np.diff(offsets)
    high = np.zeros(len(size), bool)
    if len(data):
        odd = np.flatnonzero(data >= 0xD4)
        high[np.searchsorted(offsets, odd, "right") - 1] = True
    own = high | (size > huge) | (coder.ranks is None)  # rows encoded by themselves
    single = {i: resynchronised(data[offsets[i] : offsets[i + 1]], coder.encode, coder.width, huge) for i in np.flatnonzero(own & (size > 0))}
    keep = np.repeat(~own, size)
    rest, where = (data, offsets) if keep.all() else (data[keep], np.concatenate([[0], np.cumsum(np.where(own, 0, size))]))
    ids, per_row = _encode_pieces(rest, where, coder)
    if not single:
        return ids, per_row
    ends = np.concatenate([[0], np.cumsum(per_row)])
    parts = [single.get(i, ids[ends[i] : ends[i + 1]]) for i in range(len(size))]
    return np.concatenate(parts), np.array([len(p) for p in parts], np.int64)


def _encode_pieces(data: np.ndarray, offsets: np.ndarray, coder: Codec) -> tuple[np.ndarray, np.ndarray]:
    rows = len(offsets) - 1
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(rows, np.int64)
    cut = np.zeros(len(data) + 1, bool)
    cut[stable_starts(data)] = True
    cut[offsets[:-1]] = True
    cuts = np.flatnonzero(cut[:-1])
    bounds = np.append(cuts, len(data))
    pieces = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(cuts), [None, pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(data))])
    coded = pieces.dictionary_encode()
    index, values = coded.indices.to_numpy(zero_copy_only=False), coded.dictionary
    body, at = flat(values)
    length = np.diff(at)
    first, second, last = body[at[:-1]], body[np.minimum(at[:-1] + 1, len(body) - 1)], body[at[1:] - 1]
    joins = (first == 0x20) & (length > 1) & ((second > 0x20) & (second < 0x7F) | (second == 0xC3))
    joins &= ((last > 0x20) & (last < 0x7F)) | ((last >= 0x80) & (last < 0xC0) & (body[np.maximum(at[1:] - 2, 0)] == 0xC3))
    text = body[np.repeat(joins, length)]  # pieces that begin and end at stable boundaries stand side by side
    ids = coder.encode(text.tobytes())
    token_end = np.cumsum(coder.width[ids])
    piece_end = np.cumsum(length[joins])
    upto = np.searchsorted(token_end, piece_end)
    if len(piece_end) and not np.array_equal(token_end[upto], piece_end):
        raise AssertionError("a piece does not end at a token boundary")
    number = np.zeros(len(values), np.int64)
    number[joins] = np.diff(np.concatenate([[0], upto + 1])) if len(piece_end) else 0
    others = {i: coder.encode(body[at[i] : at[i + 1]].tobytes()) for i in np.flatnonzero(~joins)}
    for i, own in others.items():
        number[i] = len(own)
    start = np.zeros(len(values), np.int64)
    start[joins] = np.concatenate([[0], upto + 1])[:-1] if len(piece_end) else 0
    start[~joins] = len(ids) + np.concatenate([[0], np.cumsum([len(o) for o in others.values()])])[:-1].astype(np.int64) if others else 0
    pool = np.concatenate([ids, *others.values()])
    count = number[index]
    total = int(count.sum())
    ahead = np.concatenate([[0], np.cumsum(count)])[:-1]
    flat_ids = pool[np.arange(total) + np.repeat(start[index] - ahead, count)]
    row = np.searchsorted(offsets, cuts, "right") - 1
    return flat_ids, np.bincount(row, weights=count, minlength=rows).astype(np.int64)


def count_tokens(df: DataFrame, json_path: str, rank_path: str | None = None, text: str = "text", into: str = "n_tokens", carry: list[str] | None = None, huge_bytes: int = HUGE_BYTES) -> DataFrame:
    """The number of tokens of every whole text beside the columns ``carry`` (all, if not given).

    Null and empty texts have none. Rows stay where they are: there is no shuffle, and repeated rows, ties, other columns
    and column order do not matter. A column already called ``into`` is replaced. An empty table gives an empty table.
    """
    bounded_batches(df.sparkSession)
    rest = [c for c in (df.columns if carry is None else carry) if c != into]
    schema = df.select(*rest).withColumn(into, F.lit(0).cast("long")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = codec(json_path, rank_path)
        for batch in batches:
            counts, texts = [np.zeros(0, np.int64)], batch.column(len(rest))
            for a, b in text_slices(texts, ENCODE_BYTES):
                counts.append(encode_rows(texts.slice(a, b - a), coder, huge_bytes)[1])
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(np.concatenate(counts), pa.int64())], [*rest, into])

    return df.select(*rest, F.col(text).alias("__text")).mapInArrow(run, schema)


def utf8_bytes(text: str | Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long")
