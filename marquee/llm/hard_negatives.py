"""Hard negatives by exact scores of anchors against all rows, scored with tables of subset sums (the method of Four Russians).

Vectors become integers. A row is stored as bit planes: for each binary digit of its components, one byte for eight dimensions. For an
anchor, the sums of all 256 subsets of its eight components are precomputed for each group of dimensions, so a byte of a bit plane looks up
what it adds to the inner product. Planes are added up with shifts, the highest with a minus, as numbers are two's complements.
The scores are exact integers and complete: every anchor meets every row.

Anchors and rows meet in cells of a grid: blocks of rows against blocks of anchors. A cell hands on the best few of each anchor, which
are merged by rank. The first pass finds the positives, among rows of the anchor's label. The second finds, for each positive, the best rows of
other labels in its range of scores. Neither pass depends on how labels are distributed: a label that holds most rows is spread
over all blocks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import parts_for, stored

GROUP = 8
CELL_ROWS, CELL_ANCHORS = 4096, 2048
TABLE_ANCHORS = 32  # anchors whose tables are held at a time: 8 KB each for 64 dimensions
CELL_TASKS = 20_000
POSITIVES, NEGATIVES = 5, 10
RANGE = (30, 90)  # a negative's score lies within these per cent of the positive's


def subset_sums(anchors: np.ndarray, kind=np.int64) -> np.ndarray:
    """Table ``[group, byte, anchor]``: the sum of the anchor's components that the bits of the byte name."""
    groups = anchors.shape[1] // GROUP
    parts = anchors.T.reshape(groups, GROUP, len(anchors)).astype(kind)
    table = np.zeros((groups, 1 << GROUP, len(anchors)), kind)
    for j in range(GROUP):
        table[:, 1 << j : 2 << j] = table[:, : 1 << j] + parts[:, j : j + 1]
    return table


def bit_planes(vectors: np.ndarray, planes: int) -> np.ndarray:
    """Bytes ``[row, plane, group]`` of two's complements; dimension ``8 g + j`` is bit ``j`` of group ``g``."""
    digits = (vectors[:, None, :] >> np.arange(planes)[None, :, None] & 1).astype(np.uint8)
    return np.packbits(digits, axis=2, bitorder="little")


def scores(planes: np.ndarray, anchors: np.ndarray, largest: int) -> np.ndarray:
    """Inner products ``[row, anchor]`` of rows given as bit planes; ``largest`` bounds the size of the anchors' components."""
    rows, digits, groups = planes.shape
    kind = np.int32 if largest * GROUP * max(groups, 1) < 1 << 31 else np.int64
    table = subset_sums(anchors, kind)
    total, plane, found = np.zeros((rows, len(anchors)), np.int64), np.zeros((rows, len(anchors)), kind), np.zeros((rows, len(anchors)), kind)
    for p in range(digits):
        plane[:] = 0
        for g in range(groups):
            np.take(table[g], planes[:, p, g], axis=0, out=found)
            plane += found
        shifted = plane.astype(np.int64) << p
        total += -shifted if p == digits - 1 else shifted
    return total


def best(score: np.ndarray, ids: np.ndarray, tie: np.ndarray, allowed: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` largest allowed scores, ties to the smaller id."""
    at = np.flatnonzero(allowed)
    if len(at) > k:
        own = score[at]
        at = at[own >= np.partition(own, len(own) - k)[len(own) - k]]
    return at[np.lexsort((tie[at], ids[at], -score[at]))][:k]


def usable(vector: Column) -> Column:
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    return F.coalesce(vector.isNotNull() & finite, F.lit(False))


def _blocks(table: pa.Table, digits: int) -> dict[int, dict]:
    """The rows of a cell by the width of their vectors."""
    width, out = table["width"].to_numpy(), {}
    label, ids, tie = table["label"].to_numpy(), table["id"].to_numpy(), table["tie"].to_numpy()
    for w in np.unique(width).tolist():
        at = np.flatnonzero(width == w)
        held = b"".join(table["planes"].take(pa.array(at)).to_pylist())
        out[w] = {"ids": ids[at], "tie": tie[at], "label": label[at], "planes": np.frombuffer(held, np.uint8).reshape(len(at), digits, -(-w // GROUP))}
    return out


def _anchors(table: pa.Table):
    """Anchors of a cell, ``TABLE_ANCHORS`` of one width and label at a time: rows of the table and padded vectors."""
    width, label = table["width"].to_numpy(), table["label"].to_numpy()
    order = np.lexsort((label, width))
    cut = np.flatnonzero((np.diff(width[order]) != 0) | (np.diff(label[order]) != 0)) + 1
    for run in np.split(order, cut):
        for a in range(0, len(run), TABLE_ANCHORS):
            at, w = run[a : a + TABLE_ANCHORS], int(width[run[0]])
            vectors = np.zeros((len(at), -(-w // GROUP) * GROUP), np.int64)
            vectors[:, :w] = table["v"].take(pa.array(at)).combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(at), w)
            yield at, w, int(label[at[0]]), vectors


def mine(df: DataFrame, anchor: Column, key: str = "vec_id", vector: str = "embedding", label: str = "label", scale: float = 256.0, positives: int = POSITIVES, negatives: int = NEGATIVES, within: tuple[int, int] = RANGE) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score`` for the rows of ``df`` that ``anchor`` marks.

    Components become ``floor(scale * x)``; a score is the integer inner product. Higher scores come first, ties go to the smaller key. An
    anchor's positives are its first rows of the same label, its negatives for a positive the first rows of other labels whose score lies
    ``within`` per cent of the positive's. Rows with a null key, label or vector, or with a null or non-finite component, take no part.
    Vectors of different widths do not meet. A row that is repeated whole counts once; different rows of one key are rows of their own,
    but never positives or negatives of each other. An empty table, or one without anchors, gives no rows; other columns are not
    read. Components so large that scores leave 64 bits are an error.
    """
    spark, (low, high) = df.sparkSession, within
    whole = F.transform(F.col(vector), lambda x: F.floor(x.cast("double") * F.lit(scale)))
    source = df.filter(usable(F.col(vector)) & F.col(key).isNotNull() & F.col(label).isNotNull())
    source = source.select(F.col(key).cast("long").alias("id"), F.col(label).cast("long").alias("label"), whole.alias("v"), F.coalesce(anchor, F.lit(False)).alias("asks"))
    rows = stored(source.dropDuplicates(["id", "label", "v", "asks"]).withColumn("tie", F.xxhash64("label", "v")), "negatives-rows")
    bounds = rows.agg(
        F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.col("asks").cast("long")), F.lit(0)).alias("anchors"),
        F.coalesce(F.max(F.array_max("v")), F.lit(0)).alias("most"), F.coalesce(F.min(F.array_min("v")), F.lit(0)).alias("least"), F.coalesce(F.max(F.size("v")), F.lit(0)).alias("width"),
    ).first()
    largest = max(bounds.most, -bounds.least, 1)
    if 100 * max(bounds.width, 1) * largest**2 >= 1 << 62:
        raise ValueError(f"components up to {largest} give scores beyond 64 bits: lower the scale")
    digits = 1 + max(bounds.most.bit_length(), (-bounds.least - 1).bit_length() if bounds.least < 0 else 0)

    def pack(batches):
        for batch in batches:
            lists = batch.column(2)
            width, values = np.diff(lists.offsets.to_numpy()), lists.flatten().to_numpy(zero_copy_only=False)
            at, packed = np.cumsum(width) - width, [b""] * len(width)
            for w in np.unique(width).tolist():
                own = np.flatnonzero(width == w)
                planes = bit_planes(values[at[own][:, None] + np.arange(w)], digits)
                for i, p in zip(own.tolist(), planes, strict=True):
                    packed[i] = p.tobytes()
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(3), pa.array(width.astype(np.int32)), pa.array(packed, pa.binary())], ["id", "label", "tie", "width", "planes"])

    row_blocks = parts_for(df, bounds.n, CELL_ROWS)
    anchor_blocks = max(1, -(-bounds.anchors // CELL_ANCHORS))
    tasks = min(row_blocks * anchor_blocks, CELL_TASKS)
    dealt = lambda n, salt: F.pmod(F.xxhash64("id", "tie", F.lit(salt)), F.lit(n))
    number = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    cell = lambda of_anchor, of_row: (of_anchor * row_blocks + of_row).alias("cell")
    index = stored(rows.select("id", "label", "v", "tie").mapInArrow(pack, "id long, label long, tie long, width int, planes binary"), "negatives-planes")
    index = index.withColumn("row_block", dealt(row_blocks, 1)).withColumn("anchor_block", number(anchor_blocks)).select(cell(F.col("anchor_block"), F.col("row_block")), "id", "label", "tie", "width", "planes")

    def grid(asking: DataFrame, meet, schema: str) -> DataFrame:
        spread = asking.withColumn("anchor_block", dealt(anchor_blocks, 2)).withColumn("row_block", number(row_blocks))
        spread = spread.withColumn("cell", cell(F.col("anchor_block"), F.col("row_block"))).drop("row_block", "anchor_block")
        return index.repartition(tasks, "cell").groupBy("cell").cogroup(spread.repartition(tasks, "cell").groupBy("cell")).applyInArrow(meet, schema)

    def first_same(held: pa.Table, asking: pa.Table) -> pa.Table:
        out = [[] for _ in range(5)]
        blocks = _blocks(held, digits)
        ids, tie = asking["id"].to_numpy(), asking["tie"].to_numpy()
        for at, width, own, vectors in _anchors(asking) if blocks else ():
            block = blocks.get(width)
            same = np.flatnonzero(block["label"] == own) if block else ()
            if not len(same):
                continue
            score = scores(block["planes"][same], vectors, largest)
            for i, a in enumerate(at.tolist()):
                near = best(score[:, i], block["ids"][same], block["tie"][same], block["ids"][same] != ids[a], positives)
                for column, x in zip(out, (np.full(len(near), ids[a]), np.full(len(near), tie[a]), block["ids"][same][near], block["tie"][same][near], score[near, i]), strict=True):
                    column.append(x)
        return pa.table([pa.array(np.concatenate([np.zeros(0, np.int64), *x])) for x in out], ["anchor_id", "anchor_tie", "positive_id", "positive_tie", "positive_score"])

    def first_other(held: pa.Table, asking: pa.Table) -> pa.Table:
        out = [[] for _ in range(7)]
        blocks = _blocks(held, digits)
        ids, tie = asking["id"].to_numpy(), asking["tie"].to_numpy()
        for at, width, own, vectors in _anchors(asking) if blocks else ():
            block = blocks.get(width)
            other = np.flatnonzero(block["label"] != own) if block else ()
            if not len(other):
                continue
            score = scores(block["planes"][other], vectors, largest)
            row_ids, row_tie = block["ids"][other], block["tie"][other]
            for i, a in enumerate(at.tolist()):
                mine = row_ids != ids[a]
                for p in asking["positives"][a].as_py():
                    allowed = mine & (score[:, i] >= -(-low * p["positive_score"] // 100)) & (score[:, i] <= high * p["positive_score"] // 100)
                    near = best(score[:, i], row_ids, row_tie, allowed, negatives)
                    fixed = (ids[a], tie[a], p["positive_id"], p["positive_tie"], p["positive_score"])
                    for column, x in zip(out, (*(np.full(len(near), y) for y in fixed), row_ids[near], score[near, i]), strict=True):
                        column.append(x)
        return pa.table([pa.array(np.concatenate([np.zeros(0, np.int64), *x])) for x in out], ["anchor_id", "anchor_tie", "positive_id", "positive_tie", "positive_score", "negative_id", "negative_score"])

    asking = rows.filter("asks").select("id", "label", "tie", F.size("v").alias("width"), "v")
    same = grid(asking, first_same, "anchor_id long, anchor_tie long, positive_id long, positive_tie long, positive_score long")
    by_anchor = Window.partitionBy("anchor_id", "anchor_tie").orderBy(F.desc("positive_score"), "positive_id", "positive_tie")
    chosen = same.withColumn("place", F.row_number().over(by_anchor)).filter(F.col("place") <= positives)
    chosen = chosen.groupBy(F.col("anchor_id").alias("id"), F.col("anchor_tie").alias("tie")).agg(F.collect_list(F.struct("positive_id", "positive_tie", "positive_score")).alias("positives"))
    asking = stored(asking.join(chosen, ["id", "tie"]), "negatives-positives")

    other = grid(asking, first_other, "anchor_id long, anchor_tie long, positive_id long, positive_tie long, positive_score long, negative_id long, negative_score long")
    by_positive = Window.partitionBy("anchor_id", "anchor_tie", "positive_id", "positive_tie").orderBy(F.desc("negative_score"), "negative_id")
    ranked = other.withColumn("rank", F.row_number().over(by_positive)).filter(F.col("rank") <= negatives)
    return ranked.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")
