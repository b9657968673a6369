"""K-means within every group at once, and over a whole table.

Groups may be tiny or hold a third of all rows. A group larger than ``block_rows`` is salted into blocks of about that
size, and blocks of all groups are packed into buckets of about that size too. A task holds one bucket of vectors and
the few centres of the groups in it, and hands on one partial sum per centre. Vectors are laid out by bucket once and
stay put; each pass moves centres only, until no cluster of any group changes.

A group of one block is whole in its task, so all its passes run there: the passes over the cluster are those of the groups
that span several blocks, and there are none without such groups. The centres of those are few: up to ``CENTRE_BYTES`` the driver
holds them and sends them to the blocks, so a pass is one job and writes nothing. Beyond, they are tables.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark import Broadcast, StorageLevel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import BLOCK_ROWS, KMEANS_STARTS
from ..session import cut_lineage

MOST_PASSES = 1000  # every pass lowers some group's inertia, so this is an alarm and not a limit
BROADCAST_GROUPS = 200_000  # rows of a few numbers each
BUCKETS_PER_PART = 16
CENTRE_BYTES = 32 << 20  # centres of all starts of the groups of several blocks that pass through the driver


def _nearest(points: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the nearest centre (the first of equals) and the squared distance to it."""
    squares = (points**2).sum(1)[:, None] - 2.0 * points @ centres.T + (centres**2).sum(1)[None, :]
    squares = np.round(np.maximum(squares, 0.0), 9)
    label = squares.argmin(1)
    return label, squares[np.arange(len(points)), label]


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    return column.combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _of_groups(points: pa.Table, centres: pa.Table) -> Iterator[tuple]:
    """``(gid, keys, vectors, starts, clusters, centres)`` of every group of a bucket; the last two have an entry for each start."""
    if not points.num_rows or not centres.num_rows:
        return
    points = points.sort_by([("gid", "ascending"), ("tid", "ascending")])
    centres = centres.sort_by([("gid", "ascending"), ("start", "ascending"), ("cluster", "ascending")])
    vectors, matrix = _matrix(points["v"]), _matrix(centres["centre"])
    keys, clusters, starts = points["tid"].to_numpy(), centres["cluster"].to_numpy(), centres["start"].to_numpy()
    of_point, of_centre = points["gid"].to_numpy(), centres["gid"].to_numpy()
    groups, begins = np.unique(of_point, return_index=True)
    ends = np.append(begins[1:], len(of_point))
    first, last = np.searchsorted(of_centre, groups, "left"), np.searchsorted(of_centre, groups, "right")
    for gid, a, b, c, d in zip(groups, begins, ends, first, last):
        if c == d:
            continue  # all starts of the group have settled
        own = np.unique(starts[c:d])
        runs = [c + np.flatnonzero(starts[c:d] == s) for s in own]
        yield gid, keys[a:b], vectors[a:b], own, [clusters[run] for run in runs], [matrix[run] for run in runs]


def _sums(vectors: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Places of the centres that have members, their numbers of members, sums of vectors and inertias."""
    label, distance = _nearest(vectors, centres)
    order = np.argsort(label, kind="stable")
    used, lead, n = np.unique(label[order], return_index=True, return_counts=True)
    return used, n, np.add.reduceat(vectors[order], lead), np.add.reduceat(distance[order], lead)


def _table(rows: list[tuple], schema: pa.Schema) -> pa.Table:
    columns = list(zip(*rows)) if rows else [[] for _ in schema]
    return pa.table([pa.array(list(c), f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


_SUMS = pa.schema([("gid", pa.int64()), ("start", pa.int32()), ("cluster", pa.int32()), ("n", pa.int64()), ("total", pa.list_(pa.float64())), ("inertia", pa.float64())])
_LABELS = pa.schema([("tid", pa.int64()), ("gid", pa.int64()), ("cluster", pa.int32()), ("distance", pa.float64())])


def _partial_sums(points: pa.Table, centres: pa.Table) -> pa.Table:
    rows = []
    for gid, _, vectors, starts, clusters, runs in _of_groups(points, centres):
        for start, names, matrix in zip(starts, clusters, runs):
            rows += [(gid, start, names[i], *x) for i, *x in zip(*_sums(vectors, matrix))]
    return _table(rows, _SUMS)


def _label_table(found: Iterator[tuple]) -> pa.Table:
    """Labels from ``(gid, keys, vectors, names of clusters, centres)`` of each group."""
    tables = []
    for gid, keys, vectors, names, matrix in found:
        label, distance = _nearest(vectors, matrix)
        columns = [pa.array(keys, pa.int64()), pa.array(np.full(len(keys), gid), pa.int64()), pa.array(names[label], pa.int32()), pa.array(distance)]
        tables.append(pa.table(columns, schema=_LABELS))
    return pa.concat_tables(tables) if tables else _LABELS.empty_table()


def _labels(points: pa.Table, centres: pa.Table) -> pa.Table:
    return _label_table((gid, keys, vectors, clusters[0], runs[0]) for gid, keys, vectors, _, clusters, runs in _of_groups(points, centres))


def _settled(vectors: np.ndarray, centres: np.ndarray, passes: int | None) -> tuple[np.ndarray, float]:
    """Centres of one start of a whole group after its last pass, and the inertia; the passes are those of the loop over all blocks."""
    n, inertia = None, np.zeros(len(centres))
    for _ in range(MOST_PASSES if passes is None else passes):
        used, members, totals, spread = _sums(vectors, centres)
        before, inertia_before = n, inertia
        n, inertia, centres = np.zeros(len(centres), np.int64), np.zeros(len(centres)), centres.copy()
        n[used], inertia[used], centres[used] = members, spread, totals / members[:, None]
        if before is not None and (n == before).all() and (np.abs(inertia - inertia_before) <= 1e-9 * np.maximum(1.0, inertia_before)).all():
            break
    else:
        if passes is None:
            raise RuntimeError(f"clusters still change after {MOST_PASSES} passes")
    return centres, round(float(inertia.sum()), 6)


def group_plan(points: DataFrame, clusters: Column) -> DataFrame:
    """``(grp, members, k)`` of every group; ``clusters`` is an expression over ``members``."""
    return points.groupBy("grp").agg(F.count("*").alias("members")).withColumn("k", clusters.cast("int"))


def grouped_kmeans(
    points: DataFrame,
    clusters: Column,
    most_clusters: int,
    passes: int | None = None,
    block_rows: int = BLOCK_ROWS,
    starts: int = KMEANS_STARTS,
) -> DataFrame:
    """Cluster ``points(grp, tid, v)`` within each ``grp``; returns ``(tid, grp, cluster, k, distance)``.

    Groups whose ``clusters`` is 1 or less are left out. Each group is clustered from ``starts`` sets of centres, and the one with the
    smallest inertia (to six digits; the first of equals) gives the labels. The centres of start 0 are the members with the smallest
    digests of their key, those of start ``s`` by the digest of ``s:key``, so results do not depend on partitioning. All starts of all
    groups share a pass over the vectors; those that have settled are left out of the next. A centre that loses all members stays where it
    is. Without ``passes`` the loop runs until the sizes and inertias of all clusters stay the same.
    """
    spark = points.sparkSession
    sized = group_plan(points, clusters).filter(F.col("k") > 1)
    plan = cut_lineage(
        sized.withColumns(
            {
                "salts": F.ceil(F.col("members") / block_rows).cast("int"),
                "gid": F.monotonically_increasing_id(),  # fixed by the checkpoint
            }
        )
    )
    groups, total = plan.agg(F.count("*"), F.coalesce(F.sum("members"), F.lit(0))).first()
    buckets = max(1, -(-total // block_rows))
    # A fixed partition count lets every pass reuse this layout; a lost executor's part is recomputed from the lineage.
    parts = min(buckets, max(int(spark.conf.get("spark.sql.shuffle.partitions")), buckets // BUCKETS_PER_PART))
    bucket = F.pmod(F.xxhash64("gid", "salt"), F.lit(max(buckets, parts))).cast("int")
    salt = F.pmod(F.xxhash64("tid"), F.col("salts")).cast("int")
    # Few groups are sent to the points; with many, the join is shuffled and the adaptive skew join splits a hot group.
    known = F.broadcast(plan) if groups <= BROADCAST_GROUPS else plan
    chosen = points.join(known, "grp").select("gid", "tid", "v", "k", "members", "salts", salt.alias("salt"))
    placed = chosen.select(bucket.alias("bucket"), F.col("gid").alias("gid"), "salts", "tid", "v")
    # The k smallest of n uniform hashes lie below (2k + 128) / n but for a chance under e^-50: whatever the size of a
    # group, only that many members are compared.
    text = F.when(F.col("start") == 0, F.col("tid").cast("string")).otherwise(F.concat_ws(":", "start", "tid"))
    hashed = F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long")
    near_zero = F.col("hashed").cast("double") / 2.0**52 * F.col("members") <= 2 * F.col("k") + 128
    by_hash = Window.partitionBy("gid", "start").orderBy("hashed", "tid")
    seeds = (
        chosen.withColumn("start", F.explode(F.sequence(F.lit(0), F.lit(starts - 1))))
        .withColumn("hashed", hashed)
        .filter(near_zero)
        .withColumn("place", F.row_number().over(by_hash))
        .filter((F.col("place") <= most_clusters) & (F.col("place") <= F.col("k")))
        .select("gid", "start", (F.col("place") - 1).alias("cluster"), F.col("v").cast("array<double>").alias("centre"))
    )
    unknown = [F.lit(None).cast("long").alias("n"), F.lit(None).cast("double").alias("inertia"), F.lit(True).alias("live")]
    centres = cut_lineage(seeds.select("*", *unknown))
    started = centres.groupBy("gid").agg(F.count("*").alias("seeds"))
    wanted = F.least(F.col("k"), F.col("members"), F.lit(most_clusters))
    if plan.join(started, "gid", "left").filter(F.coalesce("seeds", F.lit(0)) < wanted * starts).limit(1).count():
        raise RuntimeError("a group has fewer starting centres than clusters")
    where = (
        plan.select("gid", "salts", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
        .select(F.col("gid").alias("gid"), "salts", bucket.alias("bucket"))
        .distinct()
    )

    def against(blocks: DataFrame, places: DataFrame, current: DataFrame, fn, schema: str) -> DataFrame:
        spread = current.select("gid", "start", "cluster", "centre").join(places, "gid").groupBy("bucket")
        return blocks.select("bucket", "gid", "tid", "v").groupBy("bucket").cogroup(spread).applyInArrow(fn, schema)

    def solved(points: pa.Table, centres: pa.Table) -> pa.Table:
        def best() -> Iterator[tuple]:
            for gid, keys, vectors, _, clusters, runs in _of_groups(points, centres):
                ends = [_settled(vectors, run, passes) for run in runs]
                chosen_start = min(range(len(ends)), key=lambda i: (ends[i][1], i))
                yield gid, keys, vectors, clusters[chosen_start], ends[chosen_start][0]

        return _label_table(best())

    labelled = "tid long, gid long, cluster int, distance double"
    whole = cut_lineage(against(placed.filter("salts = 1"), where.filter("salts = 1").drop("salts"), centres, solved, labelled))
    named = ["tid", "grp", "cluster", "k", "distance"]
    if not plan.filter("salts > 1").limit(1).count():
        return whole.join(plan, "gid").select(*named)
    where = where.filter("salts > 1").drop("salts")
    centres = cut_lineage(centres.join(plan.filter("salts > 1").select("gid"), "gid"))
    blocks = placed.filter("salts > 1").repartition(parts, "bucket").sortWithinPartitions("bucket").persist(StorageLevel.DISK_ONLY)
    blocks.count()  # a pass planned before the cache exists would shuffle and sort the vectors again

    summed = "gid long, start int, cluster int, n long, total array<double>, inertia double"

    def added(sums: DataFrame) -> DataFrame:
        return sums.groupBy("gid", "start", "cluster").agg(
            F.sum("n").alias("n"),
            vector_to_array(Summarizer.sum(array_to_vector("total"))).alias("total"),
            F.sum("inertia").alias("inertia"),
        )

    held = centres.agg(F.coalesce(F.sum(F.size("centre").cast("long")), F.lit(0)).alias("n")).first().n
    if 8 * held <= CENTRE_BYTES:
        kept = _passes_with_sent_centres(blocks, centres, added, summed, passes)
        labels = cut_lineage(_against_sent(blocks, kept, _labels, labelled)[0])
        blocks.unpersist()
        return labels.unionByName(whole).join(plan, "gid").select(*named)

    def against_blocks(current: DataFrame, fn, schema: str) -> DataFrame:
        return against(blocks, where, current, fn, schema)

    for _ in range(MOST_PASSES if passes is None else passes):
        moved = added(against_blocks(centres.filter("live"), _partial_sums, summed))
        before = centres.filter("live").select("gid", "start", "cluster", "centre", F.col("n").alias("n0"), F.col("inertia").alias("inertia0"))
        mean = F.transform("total", lambda x: x / F.col("n"))
        n, inertia = F.coalesce("n", F.lit(0)), F.coalesce("inertia", F.lit(0.0))
        same = (n == F.col("n0")) & (F.abs(inertia - F.col("inertia0")) <= 1e-9 * F.greatest(F.lit(1.0), "inertia0"))
        after = before.join(moved, ["gid", "start", "cluster"], "left").select(
            "gid",
            "start",
            "cluster",
            F.when(n > 0, mean).otherwise(F.col("centre")).alias("centre"),
            n.alias("n"),
            inertia.alias("inertia"),
            F.coalesce(~same, F.lit(True)).alias("changed"),
        )
        live = F.max("changed").over(Window.partitionBy("gid", "start")).alias("live")
        centres = cut_lineage(centres.filter(~F.col("live")).unionByName(after.select("*", live).drop("changed")))
        if not centres.filter("live").limit(1).count():
            break
    else:
        if passes is None:
            raise RuntimeError(f"clusters still change after {MOST_PASSES} passes")
    spread = centres.groupBy("gid", "start").agg(F.round(F.coalesce(F.sum("inertia"), F.lit(0.0)), 6).alias("inertia"))
    best = spread.groupBy("gid").agg(F.min(F.struct("inertia", "start"))["start"].alias("start"))
    centres = centres.join(best, ["gid", "start"])
    labels = cut_lineage(against_blocks(centres, _labels, labelled))
    blocks.unpersist()
    return labels.unionByName(whole).join(plan, "gid").select(*named)


def _against_sent(blocks: DataFrame, current: pa.Table, fn, schema: str) -> tuple[DataFrame, Broadcast]:
    """``fn`` of the points of each bucket and the centres of their groups, which are sent to all tasks once."""
    sent = blocks.sparkSession.sparkContext.broadcast(current)

    def run(points: pa.Table) -> pa.Table:
        near = sent.value
        return fn(points, near.filter(pa.compute.is_in(near["gid"], pa.compute.unique(points["gid"]))))

    return blocks.select("bucket", "gid", "tid", "v").groupBy("bucket").applyInArrow(run, schema), sent


def _passes_with_sent_centres(blocks: DataFrame, centres: DataFrame, added, summed: str, passes: int | None) -> pa.Table:
    """The centres of the best start of each group after its last pass. The passes are those over tables of centres."""
    given = centres.select("gid", "start", "cluster", "centre").toArrow()
    gid, start, cluster = (given[c].to_numpy() for c in ("gid", "start", "cluster"))
    order = np.lexsort((cluster, start, gid))
    gid, start, cluster, centre = gid[order], start[order], cluster[order], _matrix(given["centre"])[order]
    names, group = np.unique(gid, return_inverse=True)
    wide = int(cluster.max(initial=0)) + 1, int(start.max(initial=0)) + 1
    place = lambda g, s, c: (g * wide[1] + s) * wide[0] + c
    key = place(group, start, cluster)
    run = np.unique(key // wide[0], return_inverse=True)[1]
    live, n, inertia = np.ones(len(key), bool), np.full(len(key), -1), np.zeros(len(key))

    def table(rows: np.ndarray) -> pa.Table:
        flat = pa.ListArray.from_arrays(pa.array(np.arange(len(centre[rows]) + 1) * centre.shape[1], pa.int32()), pa.array(centre[rows].ravel()))
        return pa.table([pa.array(gid[rows]), pa.array(start[rows]), pa.array(cluster[rows]), flat], ["gid", "start", "cluster", "centre"])

    for _ in range(MOST_PASSES if passes is None else passes):
        sums, sent = _against_sent(blocks, table(live), _partial_sums, summed)
        moved = added(sums).toArrow()
        sent.destroy()
        at = np.searchsorted(key, place(np.searchsorted(names, moved["gid"].to_numpy()), moved["start"].to_numpy(), moved["cluster"].to_numpy()))
        before, inertia_before = n[live], inertia[live]
        n[live], inertia[live] = 0, 0.0
        n[at], inertia[at] = moved["n"].to_numpy(), moved["inertia"].to_numpy()
        if len(at):
            centre[at] = _matrix(moved["total"]) / n[at][:, None]
        changed = (n[live] != before) | (np.abs(inertia[live] - inertia_before) > 1e-9 * np.maximum(1.0, inertia_before))
        live &= np.bincount(run[live], weights=changed, minlength=len(run))[run] > 0
        if not live.any():
            break
    else:
        if passes is None:
            raise RuntimeError(f"clusters still change after {MOST_PASSES} passes")
    spread = np.round(np.bincount(run, weights=inertia), 6)
    first = np.unique(run, return_index=True)[1]
    best = np.lexsort((start[first], spread, group[first]))
    best = best[np.unique(group[first][best], return_index=True)[1]]
    return table(np.isin(run, best))


def table_kmeans(points: DataFrame, ids: DataFrame, clusters: int, starts: int = KMEANS_STARTS) -> DataFrame | None:
    """Labels of ``ids(tid)`` from one K-means over ``points(tid, v)``; keys without a vector get label 0.

    The vectors are one group of ``grouped_kmeans``. None when there are no more vectors than clusters.
    """
    used = points.join(ids.select("tid"), "tid", "left_semi")
    if used.limit(clusters + 1).count() <= clusters:
        return None
    one = used.select(F.array(F.lit(0)).alias("grp"), "tid", "v")
    labels = grouped_kmeans(one, F.lit(clusters), clusters, starts=starts).select("tid", F.col("cluster").alias("label"))
    return ids.select("tid").join(labels, "tid", "left").select("tid", F.coalesce("label", F.lit(0)).alias("label"))
