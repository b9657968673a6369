"""Four-Russians scores and hard negatives against brute force and SQL."""

import math
import random

import numpy as np
import pytest
from oracle import connect, differences
from pyspark.sql import functions as F

from marquee.llm import hard_negatives as hn
from marquee.llm.queries import ORACLES, QUERIES

SCHEMA = "vec_id long, embedding array<double>, label int, score double, rank int, id string, v string"


def plain(rows, positives=5, negatives=10, low=30, high=90):
    """All pairs, with Python's whole numbers."""
    fit = lambda r: None not in (r[0], r[1], r[2]) and all(x is not None and math.isfinite(x) for x in r[1])
    held = sorted({(r[0], tuple(math.floor(256 * x) for x in r[1]), r[2]) for r in rows if fit(r)})
    out = []
    for a in held:
        if a[0] % 10:
            continue
        scored = [(-sum(x * y for x, y in zip(a[1], b[1], strict=True)), b[0], b[2]) for b in held if b[0] != a[0] and len(b[1]) == len(a[1])]
        for s, i, _ in sorted(x for x in scored if x[2] == a[2])[:positives]:
            fits = sorted(x for x in scored if x[2] != a[2] and low * -s <= 100 * -x[0] <= high * -s)
            out += [(a[0], i, rank + 1, x[1], -s, -x[0]) for rank, x in enumerate(fits[:negatives])]
    return sorted(out)


def found(spark, rows, **options):
    df = spark.createDataFrame([(*r, 0.5, 1, "x", "y") for r in rows], SCHEMA).repartition(3)
    return sorted(tuple(r) for r in hn.mine(df, F.col("vec_id") % 10 == 0, **options).collect())


def vectors(n, width, seed=3, spread=0.3):
    random.seed(seed)
    centres = [[random.gauss(0, spread) for _ in range(width)] for _ in range(6)]
    return [(i, [x + random.gauss(0, spread) for x in random.choice(centres)], random.randrange(3)) for i in range(n)]


def test_scores_are_inner_products():
    rng = np.random.default_rng(1)
    for width, top in ((8, 3), (24, 200), (64, 70_000), (16, 1 << 26)):
        rows, anchors = rng.integers(-top, top, (50, width)), rng.integers(-top, top, (7, width))
        rows[0], rows[1] = -top, top - 1
        planes = hn.bit_planes(rows, 1 + max(int(rows.max()).bit_length(), int(-rows.min() - 1).bit_length()))
        assert (hn.scores(planes, anchors, top) == rows @ anchors.T).all()


def test_table_holds_all_subset_sums():
    anchors = np.arange(1, 17).reshape(1, 16)
    table = hn.subset_sums(anchors)
    assert table.shape == (2, 256, 1)
    assert table[1, 0b10000101, 0] == 9 + 11 + 16 and table[0, 255, 0] == 36


def test_query_equals_sql(spark, sf_dir):
    assert differences(QUERIES["op11_four_russians"](spark, sf_dir), connect(sf_dir), ORACLES["op11_four_russians"]) == []


@pytest.mark.parametrize("width", [1, 7, 8, 20])
def test_equals_brute_force(spark, width):
    rows = vectors(120, width)
    assert plain(rows) and found(spark, rows) == plain(rows)


def test_small_cells_and_ties(spark, monkeypatch):
    rows = vectors(150, 6) + [(200 + i, [0.25, 0.5, 0.0, 0.0, 0.0, 0.25], i % 2) for i in range(60)]  # many equal vectors
    monkeypatch.setattr(hn, "CELL_ROWS", 16)
    monkeypatch.setattr(hn, "CELL_ANCHORS", 4)
    monkeypatch.setattr(hn, "TABLE_ANCHORS", 2)
    assert found(spark, rows) == plain(rows)
    assert found(spark, rows, positives=2, negatives=3, within=(50, 100)) == plain(rows, 2, 3, 50, 100)


def test_awkward_rows(spark):
    rows = vectors(60, 9)
    rows += rows[:25]  # repeated whole
    rows += [(None, [0.1] * 9, 1), (70, None, 1), (71, [0.1] * 9, None), (80, [0.1] * 8 + [None], 1), (90, [float("nan")] * 9, 1), (91, [float("inf")] + [0.0] * 8, 2)]
    rows += [(100 + i, [0.1 * i + 0.3, -0.2 * i, 0.5], i % 2) for i in range(20)]  # another width
    rows += [(300 + i, [], i % 2) for i in range(12)]  # and none
    rows += [(10, [0.4] * 9, 1), (10, [0.2] * 9, 2), (11, [0.3] * 9, 1)]  # other rows of one key
    got = found(spark, rows)
    assert got == plain(rows) and {r[0] for r in got} >= {0, 10, 100, 300}
    assert found(spark, []) == [] and found(spark, [(1, [0.5], 1), (2, [0.4], 2)]) == []


def test_too_large_components_are_an_error(spark):
    with pytest.raises(ValueError, match="beyond 64 bits"):
        found(spark, [(0, [1e9], 1), (1, [1.0], 1)])
