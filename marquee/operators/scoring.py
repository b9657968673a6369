"""Exact top-k scoring of a table of requests against a table of item components.

Items stay where they are stored: each task packs its rows into chunks, so they are never shuffled or copied. Requests are packed into
blocks of bounded size, and a bounded number of blocks (a round) is sent to all tasks at a time. A task scores its chunks against the
blocks with matrix products, keeps a running top-k for each request, and hands on that many rows at most; the rows of all tasks are
merged by rank. What is shuffled grows with requests x ``k`` x tasks, and not with requests x items.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F

from .. import config as C
from ..session import scratch_path

TINY = 1e-12
FILTERED = ["final_rating", "votes", "year"]  # item columns that requests may set conditions on
LIMITS = ["min_rating", "min_votes", "year_from", "year_to"]  # conditions that a request may set
SCORE_CELLS = 500_000  # item x request scores held at a time by a task
SLACK = 2e-9  # more than rounding to nine digits moves a score
LIGHT_GROUP = 16  # requests of the same weights that are worth items scaled by them


@dataclass
class RequestBlock:
    """A bounded set of requests as matrices. Rows of ``vectors`` already carry the squared weights."""

    qid: np.ndarray  # (Q,)
    vectors: np.ndarray  # (Q, total dims of the item parts)
    part_weights: np.ndarray  # (Q, parts): squared weight of each part in the item norm
    norms: np.ndarray  # (Q,): norm of the weighted request vector
    wanted: np.ndarray  # (Q,): number of items to rank
    bars: np.ndarray  # (Q,): similarity that so many items are known to reach, or minus infinity
    limits: np.ndarray | None = None  # (Q, 4): least rating, least votes, first and last year; NaN where not asked for
    edges: np.ndarray | None = None  # bounds of the parts in ``vectors``


def _matrix(column: pa.Array) -> np.ndarray:
    """An Arrow list (or number) column as a float64 matrix without per-row objects."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if pa.types.is_list(column.type) or pa.types.is_large_list(column.type):
        flat = column.flatten().to_numpy(zero_copy_only=False)
        return flat.reshape(len(column), -1).astype(np.float64, copy=False)
    return column.to_numpy(zero_copy_only=False).astype(np.float64, copy=False).reshape(-1, 1)


def _best(q: np.ndarray, score: np.ndarray, tid: np.ndarray, k: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ``k[q]`` best (score descending, key ascending) of every request ``q``."""
    order = np.lexsort((tid, -score, q))
    q, score, tid = q[order], score[order], tid[order]
    starts = np.flatnonzero(np.r_[True, q[1:] != q[:-1]]) if len(q) else np.empty(0, dtype=np.int64)
    lengths = np.diff(np.r_[starts, len(q)])
    keep = np.arange(len(q)) - np.repeat(starts, lengths) < k[q]
    return q[keep], score[keep], tid[keep]


def _passes(limits: np.ndarray, values: np.ndarray) -> np.ndarray:
    """(Q, items): whether an item meets the conditions of a request; an unknown value fails a condition that is set."""
    rating, votes, year = (values[:, i][None, :] for i in range(3))
    least_rating, least_votes, first, last = (limits[:, i][:, None] for i in range(4))
    return (
        (np.isnan(least_rating) | (rating >= least_rating))
        & (np.isnan(least_votes) | (votes >= least_votes))
        & (np.isnan(first) | ((year >= first) & (year <= last)))
    )


def request_block(asked: pa.Table, parts: list[str]) -> RequestBlock:
    """The requests of a cell. The vector of a request is that of its parts, each scaled by its weight."""
    vectors = [_matrix(asked[p]) for p in parts]
    squared = _matrix(asked["weights"]) ** 2
    norms = np.sqrt(sum((v**2).sum(1) * squared[:, i] for i, v in enumerate(vectors)))
    limits = np.hstack([_matrix(asked[c]) for c in LIMITS]) if LIMITS[0] in asked.column_names else None
    if limits is not None and np.isnan(limits).all():
        limits = None
    bars = asked["bar"].to_numpy()
    return RequestBlock(
        asked["qid"].to_numpy(),
        np.hstack([v * squared[:, i : i + 1] for i, v in enumerate(vectors)]),
        squared,
        norms,
        asked["k"].to_numpy().astype(np.int64),
        np.where(np.isnan(bars), -np.inf, bars),
        limits,
        np.cumsum([0, *(v.shape[1] for v in vectors)]),
    )


class LightScores:
    """Scores in single precision that differ from those of a block by less than ``slack``, for whole groups of requests at a time.

    Requests of the same weights share the lengths of the items, so items are scaled by them once, and no length is computed for a
    request and an item. A part in which all of a group's requests have the same vector is one number for each item. Requests are
    scaled to unit norm first, so an error is one of rounding, of as many terms as there are dimensions. ``None`` is returned where that
    does not hold: for numbers near the limits of single precision.
    """

    def __init__(self, block: RequestBlock):
        self.slack = (block.vectors.shape[1] + 16) * 2.0**-22
        weights, of = np.unique(block.part_weights, axis=0, return_inverse=True)
        self.groups = []
        self.usable = len(weights) * LIGHT_GROUP <= len(of) + LIGHT_GROUP
        top = np.sqrt(weights.max(1, initial=0.0))
        top[top == 0] = 1.0
        whole = np.where(block.norms > 0, block.norms, 1.0)
        self.usable &= bool(((whole > 1e-3) & (whole < 1e15)).all() and ((top > 1e-3) & (top < 1e15)).all())
        for g in range(len(weights) if self.usable else 0):
            rows = np.flatnonzero(of.reshape(-1) == g)
            unit = block.vectors[rows] / (top[g] * whole[rows])[:, None]
            columns, common = [], []
            for a, b in zip(block.edges[:-1], block.edges[1:], strict=True):
                own = block.vectors[rows, a:b]
                if b - a > 1 and len(rows) > 1 and (own == own[0]).all():
                    common.append((a, b, own[0] / (top[g] * whole[rows[0]])))
                else:
                    columns.append(np.arange(a, b))
            columns = np.concatenate([np.zeros(0, np.int64), *columns])
            share = np.repeat((whole[rows[0]] / whole[rows])[:, None], len(common), axis=1)
            light = np.hstack([unit[:, columns], share])
            self.usable &= bool((np.abs(light) < 1e15).all())
            self.groups.append((rows, weights[g] / top[g] ** 2, columns, common, light.astype(np.float32)))

    def items(self, vectors: np.ndarray, squares: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]] | None:
        """Of each group its requests, their vectors, and the items' vectors; the scores are their products."""
        made = []
        for rows, weights, columns, common, light in self.groups if self.usable else []:
            length = np.sqrt(np.maximum(squares @ weights, 0.0))
            if not ((length == 0) | (length > 1e-5)).all():  # an unknown length, or one so small that TINY may stand for it
                return None
            turned = 1.0 / np.where(length > 0, length, np.inf)
            items = np.hstack([vectors[:, columns], *[(vectors[:, a:b] @ same)[:, None] for a, b, same in common]]) * turned[:, None]
            if not (np.abs(items) < 1e15).all():
                return None
            made.append((rows, light, items.astype(np.float32)))
        return made if self.usable else None


class BestOfBlock:
    """The wanted number of best items of each request of a block, among the items seen so far."""

    def __init__(self, block: RequestBlock):
        self.block, self.floor = block, block.bars.copy()
        self.most, self.room = int(block.wanted.max(initial=0)), 2 * int(block.wanted.sum())
        self.norms = np.maximum(block.norms, TINY)[:, None]
        self.light = LightScores(block)
        self.held, self.count = [], 0  # requests, scores and keys; and how many

    def add(self, keys: np.ndarray, vectors: np.ndarray, squares: np.ndarray, values: np.ndarray | None) -> None:
        """Score a chunk. Scores are rounded to nine digits; only those that may reach the floor are, which tells them apart alike.

        Which may is seen from scores in single precision where those are close enough; all that may are then scored in double."""
        made, everyone = self.light.items(vectors, squares), np.arange(len(self.block.qid))
        step = max(1, SCORE_CELLS // max(1, len(keys)))
        for rows, light, items in made if made is not None else [(everyone, None, None)]:
            for start in range(0, len(rows), step):
                some = rows[start : start + step]
                if light is None:
                    cells, slack = self._exact(some, vectors, squares), SLACK
                else:
                    cells, slack = light[start : start + step] @ items.T, self.light.slack
                self._take(some, cells, slack, light is None, keys, vectors, squares, values)
        if self.count > self.room:
            self._settle()

    def _take(self, some: np.ndarray, cells: np.ndarray, slack: float, exact: bool, keys: np.ndarray, vectors: np.ndarray, squares: np.ndarray, values: np.ndarray | None) -> None:
        """Hold what may be among the best of the requests ``some``, by ``cells`` that are within ``slack`` of the scores."""
        block, width = self.block, cells.shape[1]
        if block.limits is not None:
            cells[~_passes(block.limits[some], values)] = -np.inf
        request, row = self._above(cells, self.floor[some] - slack)
        if width > self.most > 0 and len(request) > 2 * int(block.wanted[some].sum()):
            kth = np.partition(cells, width - self.most, axis=1)[:, width - self.most].astype(np.float64)
            self.floor[some] = np.maximum(self.floor[some], np.where(kth > -np.inf, kth - slack, -np.inf))
            request, row = self._above(cells, self.floor[some] - slack)
        if exact:
            score = cells[request, row]
            request = some[request]
        else:
            request = some[request]
            score = self._exact_of(request, row, vectors, squares)
        score = np.round(score, 9) + 0.0
        kept = score >= self.floor[request]
        self.held.append((request[kept], score[kept], keys[row[kept]]))
        self.count += len(self.held[-1][0])

    def _exact(self, some: np.ndarray, vectors: np.ndarray, squares: np.ndarray) -> np.ndarray:
        length = np.maximum(self.block.part_weights[some] @ squares.T, 0.0)
        length = np.maximum(np.multiply(np.sqrt(length, out=length), self.norms[some], out=length), TINY, out=length)
        cells = self.block.vectors[some] @ vectors.T
        cells /= length
        return cells

    def _exact_of(self, request: np.ndarray, row: np.ndarray, vectors: np.ndarray, squares: np.ndarray) -> np.ndarray:
        """The scores of some requests and rows, a bounded number of vectors at a time."""
        score, step = np.empty(len(request)), max(1, SCORE_CELLS // max(1, vectors.shape[1]))
        for start in range(0, len(request), step):
            part = slice(start, start + step)
            q, r = request[part], row[part]
            length = np.sqrt(np.maximum(np.einsum("ij,ij->i", self.block.part_weights[q], squares[r]), 0.0)) * self.norms[q, 0]
            score[part] = np.einsum("ij,ij->i", self.block.vectors[q], vectors[r]) / np.maximum(length, TINY)
        return score

    def _above(self, cells: np.ndarray, bar: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        hits = cells >= bar[:, None].astype(cells.dtype)
        if self.block.limits is not None:
            hits &= cells > -np.inf
        return np.divmod(np.flatnonzero(hits), max(1, hits.shape[1]))  # of a flat array the few are found faster

    def _best(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        none = (np.empty(0, dtype=np.int64), np.empty(0), np.empty(0, dtype=np.int64))
        return _best(*(np.concatenate(x) for x in zip(none, *self.held, strict=True)), self.block.wanted)

    def _settle(self) -> None:
        q, score, tid = self._best()
        self.held, self.count = [(q, score, tid)], len(q)
        counts = np.bincount(q, minlength=len(self.block.qid))
        full = np.flatnonzero((counts == self.block.wanted) & (counts > 0))
        self.floor[full] = np.maximum(self.floor[full], score[np.cumsum(counts)[full] - 1])

    def rows(self) -> pa.RecordBatch:
        q, score, tid = self._best()
        columns = [pa.array(self.block.qid[q], pa.int64()), pa.array(tid, pa.int64()), pa.array(score, pa.float64()), pa.array(self.block.wanted[q], pa.int32())]
        return pa.RecordBatch.from_arrays(columns, ["qid", "tid", "similarity", "k"])


def measure(asked: DataFrame) -> Row:
    """Number of requests ``n``, largest ``k``, their sum ``total``, and whether any has a condition (``limited``)."""
    given = [F.col(c).isNotNull() for c in LIMITS if c in asked.columns]
    limited = F.greatest(F.lit(False), *given) if given else F.lit(False)
    return asked.agg(
        F.count(F.lit(1)).alias("n"),
        F.coalesce(F.max("k"), F.lit(0)).alias("k"),
        F.coalesce(F.sum(F.col("k").cast("long")), F.lit(0)).alias("total"),
        F.coalesce(F.max(limited), F.lit(False)).alias("limited"),
    ).first()


def _packed(df: DataFrame, name: str, rows: int) -> DataFrame:
    """``(lane, name_id, name)``: the rows of each partition as Arrow tables of at most ``rows`` rows; ``lane`` is the same for all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number, held, n = TaskContext.get().partitionId() << 32, [], 0

        def flush() -> pa.RecordBatch:
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, held[0].schema) as writer:
                for batch in held:
                    writer.write_batch(batch)
            body = pa.array([sink.getvalue().to_pybytes()], pa.binary())
            return pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.array([number], pa.int64()), body], ["lane", f"{name}_id", name])

        for batch in batches:
            while batch.num_rows:
                head, batch = batch.slice(0, rows - n), batch.slice(rows - n)
                held.append(head)
                n += head.num_rows
                if n == rows:
                    yield flush()
                    number, held, n = number + 1, [], 0
        if n:
            yield flush()

    return df.mapInArrow(run, f"lane int, {name}_id long, {name} binary")


def _scored(items: DataFrame, asked: DataFrame, parts: list[str], norms: list[str], dims: int) -> DataFrame:
    """``(qid, tid, similarity, k)``: what each task of ``items`` found for all requests, which are sent to every task.

    A joined row is a chunk and a block, some megabytes; Spark bounds the bytes of an Arrow batch (``maxBytesPerBatch``).
    """
    chunk = max(1, min(C.CELL_BYTES // (4 * dims), 4 * C.REQUESTS_PER_BLOCK))

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, BestOfBlock] = {}
        last, keys, vectors, squares, values = None, None, None, None, None
        for batch in batches:
            for at in range(batch.num_rows):
                chunk_id, block_id = batch["held_id"][at].as_py(), batch["asked_id"][at].as_py()
                if chunk_id != last:
                    held = pa.ipc.open_stream(batch["held"][at].as_buffer()).read_all()
                    last, keys, vectors = chunk_id, held["tid"].to_numpy(), np.hstack([_matrix(held[p]) for p in parts])
                    squares = np.column_stack([held[n].to_numpy() for n in norms])
                    values = np.column_stack([held[n].to_numpy() for n in FILTERED]).astype(np.float64) if FILTERED[0] in held.column_names else None
                if block_id not in found:
                    requests = pa.ipc.open_stream(batch["asked"][at].as_buffer()).read_all()
                    found[block_id] = BestOfBlock(request_block(requests, parts))
                found[block_id].add(keys, vectors, squares, values)
        for best in found.values():
            yield best.rows()

    pairs = _packed(items, "held", chunk).join(F.broadcast(_packed(asked, "asked", C.REQUESTS_PER_BLOCK)), "lane")
    return pairs.select("held_id", "asked_id", "held", "asked").mapInArrow(meet, "qid long, tid long, similarity double, k int")


def _grid(items: DataFrame, asked: DataFrame, parts: list[str], norms: list[str], dims: int, size: Row, sample: bool) -> DataFrame:
    spark = items.sparkSession
    limits = [F.col(c).cast("double").alias(c) for c in LIMITS if c in asked.columns]
    filters = [F.col(c).cast("double").alias(c) for c in FILTERED] if limits else []
    blocks = max(1, -(-size.n // C.REQUESTS_PER_BLOCK))
    rounds = max(1, -(-size.n * dims * 8 // C.ROUND_BYTES))
    bar = F.col("bar") if "bar" in asked.columns else F.lit(None).cast("double").alias("bar")
    weights = F.col("weights") if "weights" in asked.columns else F.array_repeat(F.lit(1.0), len(parts)).alias("weights")
    left = items.select("tid", *parts, *norms, *filters)
    right = asked.select("qid", "k", weights, bar, *limits, *parts)
    order = Window.partitionBy("qid").orderBy(F.desc("similarity"), "tid")

    def ranked(some: DataFrame) -> DataFrame:
        found = _scored(left, some.repartition(min(-(-blocks // rounds), C.CELL_TASKS)), parts, norms, dims)
        placed = found.withColumn("rank", F.row_number().over(order)).filter((F.col("rank") <= int(size.k)) & (F.col("rank") <= F.col("k")))
        return placed.filter(F.col("rank") == F.col("k")) if sample else placed

    if rounds == 1:
        return ranked(right)
    path = scratch_path(spark, "ranked")
    for number in range(rounds):  # one after the other, so only one round's blocks are held at a time
        some = ranked(right.filter(F.pmod(F.xxhash64("qid"), F.lit(rounds)) == number))
        some.write.mode("append").option("compression", "snappy").parquet(path)
    return spark.read.schema(some.schema).parquet(path)


def top_k(
    items: DataFrame,
    asked: DataFrame,
    parts: list[str],
    norms: list[str],
    dims: int,
    sample: DataFrame | None = None,
    size: Row | None = None,
) -> DataFrame:
    """``(qid, tid, similarity, rank)``: the ``k`` most similar items of every request, exactly.

    ``parts`` are vector (or number) columns of ``dims`` components in all that both tables have, ``norms`` the items' squared norms.
    ``asked`` has a unique ``qid`` and ``k``, and may have ``weights`` of the parts and conditions (:data:`LIMITS`), which hold before
    the ranking. It is read several times, so it should be stored. Ties go to the smaller key. With a ``sample`` (any part of
    ``items``), its k-th best similarity is found first for each request; tasks leave out what lies below, so the shuffled rows no
    longer grow with the number of tasks. The result is the same. More requests than a round holds are ranked and stored round by round.
    """
    size = size or measure(asked)
    if sample is not None:
        bars = _grid(sample, asked, parts, norms, dims, size, sample=True).select("qid", F.col("similarity").alias("bar"))
        asked = asked.join(bars, "qid", "left")
    return _grid(items, asked, parts, norms, dims, size, sample=False).drop("k")
