"""Approximate nearest neighbours by cosine: a hierarchical k-means tree, searched best bin first.

The tree is fitted on a bounded sample of the unit vectors (``SAMPLE_ROWS``); it has at most ``SAMPLE_ROWS / LEAF_SAMPLE`` leaves or so, which
bounds what is broadcast. Every row is indexed: it goes down to its leaf. A query walks the tree with a priority queue of branches
by distance to their centres and visits leaves in that order. How many leaves are visited is calibrated: a bounded sample of the
queries is answered exactly against all rows, and visits widen until those queries find the wanted share of their neighbours.

Rows of a leaf are dealt into blocks of bounded size, and so are the queries that visit it; a task scores one block of queries
against one block of rows. A leaf that holds a third of all rows, such as copies of one vector, is many blocks.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import sampled, stored

SAMPLE_ROWS = 20_000
BRANCHES = 8
LEAF_SAMPLE = 64
LLOYD = 12
CALIBRATION_QUERIES = 100
RECALL = 0.96
BLOCK_ROWS, BLOCK_QUERIES = 4096, 1024


@dataclass
class Node:
    centres: np.ndarray | None = None
    children: list | None = None
    leaf: int = -1


class KMeansTree:
    """``leaves`` regions of the unit sphere."""

    def __init__(self, sample: np.ndarray, branches: int = BRANCHES, leaf_sample: int = LEAF_SAMPLE):
        self.leaves, self.branches, self.leaf_sample = 0, branches, leaf_sample
        self.random = np.random.default_rng(5)
        self.root = self._grow(sample)

    def _grow(self, points: np.ndarray) -> Node:
        distinct = np.unique(points, axis=0) if len(points) > self.leaf_sample else points[:0]
        if len(distinct) <= 1:
            self.leaves += 1
            return Node(leaf=self.leaves - 1)
        centres = distinct[self.random.choice(len(distinct), min(self.branches, len(distinct)), replace=False)]
        for _ in range(LLOYD):
            nearest = (points @ centres.T - (centres**2).sum(1) / 2).argmax(1)
            used = np.unique(nearest)
            centres = np.stack([points[nearest == c].mean(0) for c in used])
        nearest = (points @ centres.T - (centres**2).sum(1) / 2).argmax(1)
        used = np.unique(nearest)
        if len(used) < 2:
            self.leaves += 1
            return Node(leaf=self.leaves - 1)
        return Node(centres[used], [self._grow(points[nearest == c]) for c in used])

    def leaf_of(self, points: np.ndarray) -> np.ndarray:
        out = np.zeros(len(points), np.int32)

        def down(node: Node, rows: np.ndarray) -> None:
            if node.children is None:
                out[rows] = node.leaf
                return
            nearest = (points[rows] @ node.centres.T - (node.centres**2).sum(1) / 2).argmax(1)
            for c, child in enumerate(node.children):
                inside = rows[nearest == c]
                if len(inside):
                    down(child, inside)

        down(self.root, np.arange(len(points)))
        return out

    def best_bins(self, point: np.ndarray, visits: int) -> list[int]:
        """Leaves in the order of a best-bin-first walk: always the open branch with the nearest centre, down to a leaf."""
        queue, found, tie = [(0.0, 0, self.root)], [], 0
        while queue and len(found) < visits:
            _, _, node = heapq.heappop(queue)
            while node.children is not None:
                far = ((node.centres - point) ** 2).sum(1)
                near = int(far.argmin())
                for c, child in enumerate(node.children):
                    if c != near:
                        tie += 1
                        heapq.heappush(queue, (float(far[c]), tie, child))
                node = node.children[near]
            found.append(node.leaf)
        return found


def usable(vector: Column) -> Column:
    """Not null, not empty, only finite components, not zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    return F.coalesce(vector.isNotNull() & (F.size(vector) > 0) & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def _matrix(column: pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _scaled(x: np.ndarray) -> np.ndarray:
    """Rows times the power of two that brings their largest component to at least 0.5 and below 1.

    Squares then neither overflow nor vanish. Powers of two do not round, so cosines of ordinary rows keep every bit.
    """
    return np.ldexp(x, -np.frexp(np.abs(x).max(1, keepdims=True))[1])


def _unit(x: np.ndarray) -> np.ndarray:
    x = _scaled(x)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _nearest(query: np.ndarray, query_id: np.ndarray, rows: np.ndarray, row_id: np.ndarray, k: int) -> tuple[list, list, list]:
    """The ``k`` largest cosines of each query, ties to the smaller id. Scores are summed in one order, so equal vectors tie."""
    query, rows = _scaled(query), _scaled(rows)
    q, r = _unit(query), _unit(rows)
    # rounded products choose, with a margin, what is then scored pair by pair
    rough, out = q @ r.T, ([], [], [])
    rough[query_id[:, None] == row_id[None, :]] = -np.inf
    for i in range(len(q)):
        possible = int((rough[i] > -np.inf).sum())
        if not possible:
            continue
        bar = np.partition(rough[i], -min(k, possible))[-min(k, possible)]
        near = np.flatnonzero(rough[i] >= bar - 1e-12)
        score = (rows[near] * query[i]).sum(1) / (np.sqrt((rows[near] ** 2).sum(1)) * np.sqrt((query[i] ** 2).sum()))
        best = np.lexsort((row_id[near], -score))[:k]
        out[0].append(np.full(len(best), query_id[i]))
        out[1].append(row_id[near][best])
        out[2].append(score[best])
    return out


def _table(out: tuple[list, list, list]) -> pa.Table:
    kinds = (np.int64, np.int64, np.float64)
    return pa.table([pa.array(np.concatenate(x) if x else np.zeros(0, t)) for x, t in zip(out, kinds, strict=True)], ["query_id", "vec_id", "score"])


def _bounded(df: DataFrame, key: str, vector: str, bound: int, salt: str) -> DataFrame:
    """About ``bound`` distinct rows ``key, vector`` at most: an id with many vectors is drawn vector by vector, copies of a row count once."""
    drawn = F.concat_ws(":", F.col(key).cast("string"), F.xxhash64(vector).cast("string"))
    return sampled(df.select(key, vector), drawn, bound, salt).dropDuplicates([key, vector])


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    distinct = found.dropDuplicates(["query_id", "vec_id"])
    return distinct.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


class WidthIndex:
    """The tree and, by leaf, the stored rows ``vec_id, v`` of one width; there is one row at least."""

    def __init__(self, rows: DataFrame, width: int, sample_rows: int):
        self.spark, self.width = rows.sparkSession, width
        sample = _matrix(_bounded(rows, "vec_id", "v", sample_rows, "tree").select("v").toArrow()["v"])  # bounded by sample_rows
        self.tree = KMeansTree(_unit(sample[np.lexsort(sample.T[::-1])]))
        self.rows = stored(self._dealt(rows), "tree-index")

    def _dealt(self, rows: DataFrame) -> DataFrame:
        tree = self.spark.sparkContext.broadcast(self.tree)

        def leaf(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(tree.value.leaf_of(_unit(_matrix(batch.column(1)))))], ["vec_id", "v", "leaf"])

        return rows.mapInArrow(leaf, "vec_id long, v array<double>, leaf int")

    def _visits(self, queries: DataFrame, visits: int, first: int = 0) -> DataFrame:
        tree = self.spark.sparkContext.broadcast(self.tree)

        def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                unit = _unit(_matrix(batch.column(1)))
                for a in range(0, len(unit), 256):
                    bins = [tree.value.best_bins(p, visits)[first:] for p in unit[a : a + 256]]
                    at = np.repeat(np.arange(a, a + len(bins)), [len(b) for b in bins])
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), batch.column(1).take(pa.array(at)), pa.array(np.concatenate(bins).astype(np.int32))], ["query_id", "q", "leaf"])

        return queries.mapInArrow(walk, "query_id long, q array<double>, leaf int")

    def _scored(self, asked: DataFrame, k: int) -> DataFrame:
        """Rows ``query_id, vec_id, score``: the ``k`` best of each block that a query meets."""
        size = self.rows.groupBy("leaf").agg(F.ceil(F.count(F.lit(1)) / BLOCK_ROWS).cast("int").alias("r"))
        many = asked.groupBy("leaf").agg(F.ceil(F.count(F.lit(1)) / BLOCK_QUERIES).cast("int").alias("c"))
        plan = F.broadcast(size.join(many, "leaf"))  # a row per leaf: bounded by the sample of the tree
        place = lambda key, n: F.pmod(F.xxhash64(key), F.col(n)).cast("int")
        number = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        rows = self.rows.join(plan, "leaf").select("leaf", place("vec_id", "r").alias("x"), number("c").alias("y"), "vec_id", "v")
        queries = asked.join(plan, "leaf").select("leaf", number("r").alias("x"), place("query_id", "c").alias("y"), "query_id", "q")

        def meet(left: pa.Table, right: pa.Table) -> pa.Table:
            if not left.num_rows or not right.num_rows:
                return _table(([], [], []))
            rows, row_id = _matrix(left["v"]), left["vec_id"].to_numpy()
            q, ids, out = _matrix(right["q"]), right["query_id"].to_numpy(), ([], [], [])
            for a in range(0, len(q), 256):
                for whole, part in zip(out, _nearest(q[a : a + 256], ids[a : a + 256], rows, row_id, k), strict=True):
                    whole.extend(part)
            return _table(out)

        return rows.groupBy("leaf", "x", "y").cogroup(queries.groupBy("leaf", "x", "y")).applyInArrow(meet, "query_id long, vec_id long, score double")

    def exact(self, queries: DataFrame, k: int) -> DataFrame:
        """Brute force for a bounded set of queries (they are broadcast): every row is scored."""
        held = [(r.query_id, r.q) for r in queries.collect()]
        if not held:
            return self.spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
        ids, matrix = np.array([h[0] for h in held], np.int64), np.array([h[1] for h in held])

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield from _table(_nearest(matrix, ids, _matrix(batch.column(1)), batch.column(0).to_numpy(), k)).to_batches()

        return _ranked(self.rows.select("vec_id", "v").mapInArrow(scan, "query_id long, vec_id long, score double"), k)

    def calibrate(self, queries: DataFrame, k: int, recall: float = RECALL) -> int:
        """Leaf visits at which a bounded sample of the queries, answered exactly, finds the share ``recall`` of its neighbours."""
        sample = stored(_bounded(queries, "query_id", "q", CALIBRATION_QUERIES, "calibration"), "calibration")
        truth = self.exact(sample, k).select("query_id", "vec_id")
        where = self.rows.join(F.broadcast(truth), "vec_id").select("query_id", "vec_id", "leaf").distinct().collect()  # CALIBRATION_QUERIES x k x leaves rows at most, whatever rows share an id
        if not where:
            return self.tree.leaves
        order = {}
        for r in sample.collect():
            bins = self.tree.best_bins(_unit(np.array([r.q]))[0], self.tree.leaves)
            order[r.query_id] = np.argsort(bins)  # visit at which each leaf is reached
        # widening the walk visit by visit: the visit at which each true neighbour's leaf is reached
        reached = np.sort([order[r.query_id][r.leaf] for r in where])
        return int(reached[int(np.ceil(recall * len(reached))) - 1]) + 1

    def search(self, queries: DataFrame, k: int, recall: float) -> DataFrame:
        """As :meth:`TreeIndex.search`, for usable queries of this width."""
        queries = stored(queries, "tree-queries")
        visits, seen = self.calibrate(queries, k, recall), 0
        total = self.rows.count()
        best = None
        while True:
            new = self._scored(self._visits(queries, visits, seen), k)
            best = stored(_ranked(new if best is None else best.select("query_id", "vec_id", "score").union(new), k), "tree-best")
            answered = best.groupBy("query_id").count().filter(F.col("count") >= min(k, max(total - 1, 0))).select("query_id")
            rest = queries.join(answered, "query_id", "left_anti")
            if visits >= self.tree.leaves or not rest.limit(1).count():
                return best
            queries, seen, visits = stored(rest, "tree-queries"), visits, visits * 4


class TreeIndex:
    """All usable rows of ``df``, one :class:`WidthIndex` for each length of vector; ``search`` answers a table of queries.

    A cosine needs two vectors of one length, so rows of another length are no candidates; none is left out for being rare. Each
    width has a sample and a tree of its own, one after the other: made for tables with few widths.
    """

    def __init__(self, df: DataFrame, key: str = "vec_id", vector: str = "embedding", sample_rows: int = SAMPLE_ROWS):
        self.spark = df.sparkSession
        rows = df.filter(usable(F.col(vector)) & F.col(key).isNotNull()).select(F.col(key).alias("vec_id"), F.col(vector).cast("array<double>").alias("v"))
        widths = [r.w for r in rows.select(F.size("v").alias("w")).distinct().orderBy("w").collect()]
        self.widths = [WidthIndex(rows.filter(F.size("v") == w), w, sample_rows) for w in widths]

    def search(self, queries: DataFrame, k: int = 5, recall: float = RECALL) -> DataFrame:
        """``query_id, rank, vec_id, score`` of the ``k`` nearest rows found for each query ``query_id, q``.

        A query's own row is left out; ties go to the smaller id. Fewer than ``k`` found (a small table) leads to more visits, up
        to all leaves. Unusable vectors (null, zero, or with null or non-finite components) and null keys take no part; a query
        meets the rows of its own width. Very large and very small components are scaled first, so scores are finite. Repeated
        ids count once, with their best score; an id whose vectors differ in width has an answer for each. An empty table gives
        no rows.
        """
        found = self.spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
        queries = queries.filter(usable(F.col("q")))
        for index in self.widths:
            found = found.union(index.search(queries.filter(F.size("q") == index.width), k, recall))
        return found
