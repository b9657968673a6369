import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from marquee.functions.features import cluster_count
from marquee.operators.kmeans import grouped_kmeans, table_kmeans

def K():
    return cluster_count(F.col("members"), 4, 12, 5)


@pytest.fixture(scope="module")
def points(spark):
    rng = np.random.default_rng(11)
    rows = []
    for tid in range(400):
        group = [0] if tid % 3 else ([1, 2] if tid % 2 else [tid])  # one group holds two thirds
        rows.append((group, tid, (rng.normal(size=3) + 4 * (tid % 5)).tolist()))
    return spark.createDataFrame(rows, "grp array<int>, tid long, v array<float>")


def labels(df):
    return {r["tid"]: (tuple(r["grp"]), r["cluster"], r["k"], round(r["distance"], 6)) for r in df.collect()}


def test_contract(points):
    got = labels(grouped_kmeans(points, K(), 8, starts=2))
    rows = points.collect()
    sizes = {}
    for r in rows:
        sizes[tuple(r["grp"])] = sizes.get(tuple(r["grp"]), 0) + 1
    clustered = {g for g, n in sizes.items() if n > 1}
    assert set(got) == {r["tid"] for r in rows if tuple(r["grp"]) in clustered}
    for group, cluster, k, _ in got.values():
        n = sizes[group]
        assert k == min(n, max(2, n // 5), 8) and 0 <= cluster < k


def lloyd(rows, k, start=0):
    """Labels and inertia at convergence, from the members with the smallest digests of a start."""
    digest = lambda r: hashlib.md5((f"{start}:{r['tid']}" if start else str(r["tid"])).encode()).hexdigest()[:13]
    rows = sorted(rows, key=digest)
    x = np.array([r["v"] for r in rows])
    centres, label = x[:k].copy(), None
    while True:
        far = ((x[:, None] - centres[None]) ** 2).sum(2)
        new = far.argmin(1)
        if label is not None and (new == label).all():
            return {r["tid"]: int(c) for r, c in zip(rows, label, strict=True)}, far.min(1).sum()
        label = new
        for c in set(label.tolist()):
            centres[c] = x[label == c].mean(0)


def best_of(rows, k, starts):
    return min((lloyd(rows, k, s) for s in range(starts)), key=lambda x: round(x[1], 6))


@pytest.mark.parametrize("starts", [1, 10])
def test_converges_to_what_plain_passes_give(points, starts):
    found = labels(grouped_kmeans(points, K(), 8, starts=starts))
    groups = {}
    for r in points.collect():
        groups.setdefault(tuple(r["grp"]), []).append(r)
    for rows in groups.values():
        if len(rows) > 1:
            expected, inertia = best_of(rows, found[rows[0]["tid"]][2], starts)
            assert {r["tid"]: found[r["tid"]][1] for r in rows} == expected
            assert inertia <= lloyd(rows, found[rows[0]["tid"]][2])[1] + 1e-6
    whole = table_kmeans(points.select("tid", "v"), points.select("tid"), 5, starts)
    assert {r["tid"]: r["label"] for r in whole.collect()} == best_of(points.collect(), 5, starts)[0]


def test_more_starts_are_never_worse(points):
    total = [sum(d for *_, d in labels(grouped_kmeans(points, K(), 8, starts=s)).values()) for s in (1, 4, 10)]
    assert total[0] > total[1] - 1e-6 and total[1] > total[2] - 1e-6 and total[0] > total[2]


def test_better_than_seeds(points):
    def inertia(passes):
        return sum(d for *_, d in labels(grouped_kmeans(points, K(), 8, passes=passes, starts=1)).values())

    assert inertia(None) < inertia(3) < inertia(0)


@pytest.mark.parametrize("partitions", [1, 17])
def test_same_for_any_partitioning(points, partitions):
    base = labels(grouped_kmeans(points.repartition(4), K(), 8, starts=2))
    assert labels(grouped_kmeans(points.repartition(partitions), K(), 8, starts=2)) == base


def test_salted_hot_group_gives_the_same(points):
    assert labels(grouped_kmeans(points, K(), 8, block_rows=16, starts=2)) == labels(grouped_kmeans(points, K(), 8, starts=2))


def test_no_group_to_cluster(points):
    lone = points.filter("size(grp) = 1 and grp[0] <> 0")
    assert grouped_kmeans(lone, K(), 8).count() == 0


def test_table_kmeans(points):
    ids = points.select("tid").union(points.select(F.col("tid") + 1000))
    got = table_kmeans(points.select("tid", "v"), ids, 5, 2)
    assert got.count() == 800
    assert got.filter("tid >= 1000").select("label").distinct().collect()[0][0] == 0
    assert got.select("label").distinct().count() == 5
    assert table_kmeans(points.select("tid", "v"), points.limit(5).select("tid"), 5) is None


def test_groups_of_one_block_need_no_passes_over_the_cluster(points, monkeypatch):
    from marquee.operators import kmeans

    wanted = labels(grouped_kmeans(points, K(), 8, block_rows=16, starts=2))
    monkeypatch.setattr(kmeans, "_partial_sums", None)
    assert labels(grouped_kmeans(points, K(), 8, starts=2)) == wanted


def test_few_centres_stay_in_the_driver(points, monkeypatch):
    """Passes over groups of several blocks write no table as long as their centres are few, and give what tables of centres give."""
    from marquee.operators import kmeans

    made = []
    write = kmeans.cut_lineage
    monkeypatch.setattr(kmeans, "cut_lineage", lambda df: made.append(1) or write(df))
    sent = labels(grouped_kmeans(points, K(), 8, block_rows=16, starts=3))
    few, made[:] = len(made), []
    monkeypatch.setattr(kmeans, "CENTRE_BYTES", -1)
    assert labels(grouped_kmeans(points, K(), 8, block_rows=16, starts=3)) == sent
    assert few == 5 < len(made)
    monkeypatch.undo()
    for passes in (1, 2):
        assert labels(grouped_kmeans(points, K(), 8, passes, 16, 3)) == labels(grouped_kmeans(points, K(), 8, passes, starts=3))
