import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from marquee.functions import features as V
from marquee.functions.vectors import dense, fit, l2_normalize, merge_weighted, multi_hot
from marquee.operators.encoders import HashEncoder, ModelEncoder
from marquee.operators.vocab import SPLITTERS, active_features, build_vocab, with_ordinals


def frame(spark, sets):
    return spark.createDataFrame([(i, sorted(s)) for i, s in enumerate(sets)], "tid long, a array<int>")


def vectors(df, expr):
    return [r[0] for r in df.orderBy("tid").select(expr.alias("v")).collect()]


def written_in_order(active, dim):
    """The wide localisation vector, by writing signals one feature after the other."""
    v = np.zeros(dim)
    half, quarter = dim // 2, dim // 4
    for i, f in enumerate(active):
        v[f * 17 % half] = 0.8
        v[(f * 31 + 7) % half + half] = 0.6
        if i < 3:
            p = (f * 53 + 13) % quarter
            v[p] = max(v[p], 0.3)
    return v


def signature(text, count, strength):
    digest = hashlib.md5(text.encode()).hexdigest()
    return [int(digest[2 * i : 2 * i + 2], 16) / 255.0 * strength for i in range(count)]


def test_wide_localisation(spark):
    rng = random.Random(5)
    sets = [set(rng.sample(range(403), rng.randint(0, 9))) for _ in range(60)]
    for dim in (64, 128, 101):
        got = vectors(frame(spark, sets), V.loc_vector(F.col("a"), dim))
        assert np.allclose(got, [written_in_order(sorted(s), dim) for s in sets])


def test_narrow_localisation(spark):
    got = vectors(frame(spark, [{3, 1}, set(), {7}]), V.loc_vector(F.col("a"), 20))
    assert np.allclose(got[0], signature("[1, 3]", 16, 0.7) + [0] * 4)
    assert np.allclose(got[1], np.zeros(20))
    assert np.allclose(got[2], signature("[7]", 16, 0.7) + [0] * 4)


def test_cluster_tails(spark):
    df = frame(spark, [{3, 1}, {2}])
    genre = vectors(df, V.clustered_genre_vector(F.col("a"), F.lit(4), 5, 10))
    combo = hashlib.md5(b"(1, 3)").hexdigest()
    assert np.allclose(genre[0], [0, 1, 0, 1, 0] + signature(f"{combo}_4", 5, 0.5))
    single = hashlib.md5(b"(2,)").hexdigest()
    assert np.allclose(genre[1], [0, 0, 1, 0, 0] + signature(f"{single}_4", 5, 0.5))
    loc = vectors(df, V.clustered_loc_vector(F.col("a"), F.lit(2), F.lit(5), 64))
    assert np.allclose(loc[0][:48], written_in_order([1, 3], 64)[:48])
    assert np.allclose(loc[0][48:], [2 / 4 * 0.3] + signature(f"{combo}_2", 15, 0.2 / 5))


def test_cluster_counts(spark):
    df = spark.createDataFrame([(n,) for n in (1, 2, 4, 11, 400)], "members long")

    def counts(*args):
        return [r[0] for r in df.select(V.cluster_count(F.col("members"), *args)).collect()]

    assert counts(20, 128, 5) == [1, 2, 2, 2, 80]
    assert counts(20, 128, 3) == [1, 2, 2, 3, 108]
    assert counts(403, 128, 3) == [1, 1, 1, 1, 1]


def test_vector_helpers(spark):
    df = spark.createDataFrame([(1, [3.0, 4.0]), (2, [0.0, 0.0])], "tid long, v array<double>")
    assert vectors(df, l2_normalize(F.col("v"))) == [[0.6, 0.8], [0.0, 0.0]]
    assert vectors(df, fit(F.col("v"), 3))[0] == [3.0, 4.0, 0.0]
    assert vectors(df, fit(F.col("v"), 1))[0] == [3.0]
    merged = vectors(df, merge_weighted(F.col("v"), F.col("v"), 2, 1))[0]
    assert np.isclose(np.linalg.norm(merged), 1) and np.isclose(merged[0] / merged[2], 2)
    for weights in ((-1, 2), (0, 0)):
        with pytest.raises(ValueError):
            merge_weighted(F.col("v"), F.col("v"), *weights)


@pytest.mark.parametrize("count", [0, 1, 700, 6 * SPLITTERS])
def test_ordinals(spark, count):
    words = sorted({f"{i * 7919 % 100003:x}é" for i in range(count)} | {"", "z", "\U0001f600", "é"}, key=lambda w: w.encode())
    df = spark.createDataFrame([("k", w) for w in words] + [("other", "only")], "kind string, value string")
    got = {(r["kind"], r["value"]): r["idx"] for r in with_ordinals(df.repartition(7)).collect()}
    assert got == {("k", w): i for i, w in enumerate(words)} | {("other", "only"): 0}


def test_active_features(spark):
    rows = [(1, ["B", " A ", "B"], "x, y"), (2, None, ""), (3, [], "y"), (4, ["C"], None)]
    df = spark.createDataFrame(rows, "tid long, country array<string>, language string")
    columns = {"country": "country", "language": "language"}
    vocab = build_vocab(df.filter("tid < 4"), columns)
    for lookup_max in (0, 100):
        out = active_features(df, vocab, columns, "a", lookup_max=lookup_max)
        assert {r["tid"]: r["a"] for r in out.collect()} == {1: [0, 1, 2, 3], 2: [], 3: [3], 4: []}


def test_hash_encoder(spark):
    df = spark.createDataFrame([(1, "Abc abc, déf!"), (2, "..."), (3, "")], "tid long, t string")
    got = {r["tid"]: r["v"] for r in HashEncoder(16).encode(df, "tid", F.col("t"), "v").collect()}
    expected = np.zeros(16)
    for w in ("abc", "abc", "déf"):
        expected[int(hashlib.md5(w.encode()).hexdigest()[:7], 16) % 16] += 1
    assert np.allclose(got[1], expected / np.linalg.norm(expected))
    assert got[2] == got[3] == [0.0] * 16


def test_model_encoder(spark):
    def load():
        return lambda texts: np.array([[len(t), 1.0] for t in texts])

    df = spark.createDataFrame([(1, "abc"), (2, "")], "tid long, t string")
    got = {r["tid"]: r["v"] for r in ModelEncoder(load).encode(df, "tid", F.col("t"), "v").collect()}
    assert np.allclose(got[1], np.array([3, 1]) / np.sqrt(10)) and got[2] == [0.0, 1.0]


def test_zeros_come_in_runs(spark):
    rows = [(0, [], []), (1, [0], [2.0]), (2, [5], [3.0]), (3, [0, 1, 4], [1.0, -1.0, 0.5]), (4, list(range(6)), [1.0] * 6)]
    df = spark.createDataFrame(rows, "tid long, p array<int>, v array<double>")
    got = vectors(df, dense(F.col("p"), F.col("v"), 6))
    for (_, places, values), vector in zip(rows, got):
        expected = np.zeros(6)
        expected[places] = values
        assert vector == expected.tolist()


def test_vectors_of_nulls_repeats_and_ordinals_beyond_the_end(spark):
    df = spark.createDataFrame([(0, None), (1, []), (2, [4, 1, 4, 9, -1])], "tid long, a array<int>")
    assert vectors(df, multi_hot(F.col("a"), 5)) == [[0.0] * 5, [0.0] * 5, [0.0, 1.0, 0.0, 0.0, 1.0]]
    wide = vectors(df.filter("tid < 2"), V.loc_vector(F.col("a"), 64))
    assert wide == [[0.0] * 64] * 2


def test_hashed_words_equal_counting_by_hand(spark):
    rng = random.Random(8)
    texts = [None, "", "  ..", "one"] + [" ".join(rng.choice(["Ab", "cd", "é", "x1", "漢"]) for _ in range(n)) for n in (2, 9, 500)]
    df = spark.createDataFrame(list(enumerate(texts)), "tid long, t string")
    for dim in (1, 7, 64):
        got = {r.tid: r.v for r in HashEncoder(dim).encode(df, "tid", F.col("t"), "v").collect()}
        for i, text in enumerate(texts):
            expected = np.zeros(dim)
            for word in (text or "").lower().split():
                if word.strip("."):
                    expected[int(hashlib.md5(word.encode()).hexdigest()[:7], 16) % dim] += 1
            assert np.allclose(got[i], expected / max(np.linalg.norm(expected), 1e-12))
