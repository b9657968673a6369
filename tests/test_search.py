import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import pytest
from pyspark.sql import functions as F

from marquee import config as C
from marquee.operators import search as S
from marquee.operators.requests import resolve_recommend, resolve_search
from marquee.operators.scoring import top_k
from marquee.plans import views as W


def item_table(spark, matrix, partitions):
    rows = [(i, [float(x) for x in v], float(v @ v)) for i, v in enumerate(matrix)]
    return spark.createDataFrame(rows, "tid long, plot array<float>, n2 double").repartition(partitions)


def asked_table(spark, queries, k):
    """``k``: one number, or one for each query."""
    wanted = [k] * len(queries) if isinstance(k, int) else k
    rows = [(i * 10, wanted[i], [float(x) for x in q]) for i, q in enumerate(queries)]
    return spark.createDataFrame(rows, "qid long, k int, plot array<double>")


@pytest.mark.parametrize("partitions", [1, 4, 17])
@pytest.mark.parametrize("k", [3, 20, 500])
def test_top_k_is_exact(spark, monkeypatch, partitions, k):
    import marquee.operators.scoring as scoring

    monkeypatch.setattr(scoring, "SCORE_CELLS", 700)  # many small steps, so bars and compaction are used
    rng = np.random.default_rng(3)
    matrix = rng.integers(-1, 2, (300, 4)).astype(float)  # many ties and some zero vectors
    queries = rng.normal(size=(7, 4))
    monkeypatch.setattr(C, "REQUESTS_PER_BLOCK", 3)
    got = top_k(item_table(spark, matrix, partitions), asked_table(spark, queries, k), ["plot"], ["n2"], 4).collect()
    for number, q in enumerate(queries):
        norms = np.maximum(np.linalg.norm(matrix, axis=1) * np.linalg.norm(q), 1e-12)
        scores = np.round(matrix @ q / norms, 9)
        best = sorted(range(300), key=lambda i: (-scores[i], i))[:k]
        mine = sorted((r["rank"], r["tid"], r["similarity"]) for r in got if r["qid"] == number * 10)
        assert [t for _, t, _ in mine] == best
        assert np.allclose([s for _, _, s in mine], scores[best])
        assert [r for r, _, _ in mine] == list(range(1, len(best) + 1))


def test_factorised_score_equals_concatenation(spark, sf_dir):
    films, model = W.stored_model(spark, sf_dir)
    asked = W.benchmark_requests(spark, sf_dir)
    resolved = resolve_search(asked).filter("error_code = 0")
    encoded = S.encode_requests(resolved, model, W.ENCODER)
    rows = encoded.toPandas()
    near = S.neighbour_genres(encoded, model).toPandas().set_index("qid")["genre"]
    parts = model.components.orderBy("tid").toPandas()
    ranked = S.rank_items(encoded, model).toPandas()
    for row in rows.itertuples():
        w = [row.plot_weight, row.genre_weight, row.localization_weight, row.popularity_weight]
        items = np.hstack(
            [np.vstack(parts[c].to_numpy()).astype(float) * x for c, x in zip(("plot", "genre", "loc"), w)]
            + [parts[["pop"]].to_numpy() * w[3]]
        )
        query = np.concatenate([np.array(row.plot) * w[0], np.array(near[row.qid]) * w[1], np.array(row.loc) * w[2], [1.5 * w[3]]])
        scores = items @ query / np.linalg.norm(items, axis=1) / np.linalg.norm(query)
        mine = ranked[ranked.qid == row.qid].sort_values("rank")
        by_key = dict(zip(parts["tid"], scores))
        assert np.allclose(mine["similarity"], [by_key[t] for t in mine["tid"]], atol=1e-8)
        assert np.allclose(mine["similarity"], np.sort(scores)[::-1][: len(mine)], atol=1e-8)
        assert (mine["similarity"].abs() <= 1 + 1e-9).all()


def test_several_blocks_equal_one(spark, sf_dir, monkeypatch):
    films, model = W.stored_model(spark, sf_dir)
    asked = W.benchmark_requests(spark, sf_dir)

    def run(requests):
        found = S.batch_search(requests, films, model, W.ENCODER)
        return sorted((r["qid"], r["rank"], r["tid"], r["similarity"]) for r in found.collect())

    whole = run(asked)
    monkeypatch.setattr(C, "REQUESTS_PER_BLOCK", 25)
    monkeypatch.setattr(C, "CELL_BYTES", 50_000)
    monkeypatch.setattr(C, "CELL_TASKS", 7)
    assert run(asked) == whole
    alone = asked.filter(F.col("qid") == whole[0][0])
    assert run(alone) == [r for r in whole if r[0] == whole[0][0]]


def test_filters_hold_before_the_ranking(spark, sf_dir):
    films, model = W.stored_model(spark, sf_dir)
    query = W.benchmark_requests(spark, sf_dir).select("qid", "query")
    wide = S.batch_search(query.withColumn("max_results", F.lit(200)), films, model, W.ENCODER)
    assert wide.groupBy("qid").count().agg(F.min("count")).first()[0] == min(200, films.count())
    old = query.select("*", F.lit(films.count()).alias("max_results"), F.lit(1990).alias("year_from"))
    every = films.filter("year between 1990 and 2030").count()
    assert {r["count"] for r in S.batch_search(old, films, model, W.ENCODER).groupBy("qid").count().collect()} == {every}
    some = query.select("*", F.lit(10).alias("max_results"), F.lit(30).cast("long").alias("min_votes"))
    found = S.batch_search(some, films, model, W.ENCODER).toPandas()
    assert (found["votes"] >= 30).all() and found.groupby("qid").size().max() <= 10
    assert (found.groupby("qid")["rank"].max() == found.groupby("qid").size()).all()
    assert (found.groupby("qid").size() == min(10, films.filter("votes >= 30").count())).all()


def test_top_k_is_limited_before_the_shuffle(spark, sf_dir):
    _, model = W.stored_model(spark, sf_dir)
    asked = asked_table(spark, np.eye(3, 64), 5)
    plan = top_k(model.components, asked, ["plot"], ["plot_n2"], 64)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2
    assert "ReadSchema: struct<tid:bigint,plot:array<float>,plot_n2:double>" in plan


def test_request_resolution(spark):
    rows = [
        (1, "x", 0, None, None, None, None),
        (2, "x", 200, "cultural", 0.9, None, None),
        (3, "x", 5, "nonsense", None, 1950, 0),
        (4, " ", 5, None, None, None, None),
        (5, "x", -1, None, 0.0, None, 1999),
    ]
    schema = "qid long, query string, max_results int, preset string, plot_weight double, year_from int, year_to int"
    got = {r["qid"]: r for r in resolve_search(spark.createDataFrame(rows, schema)).collect()}
    assert (got[1]["max_results"], got[1]["k"], got[1]["plot_weight"], got[1]["year_from"]) == (20, 20, 0.5, None)
    assert (got[2]["k"], got[2]["plot_weight"], got[2]["genre_weight"]) == (200, 0.9, 0.1)
    assert (got[3]["localization_weight"], got[3]["year_from"], got[3]["year_to"]) == (0.1, 1950, 2030)
    assert got[4]["error_code"] == C.ERROR_INVALID_QUERY and got[5]["error_code"] == C.ERROR_INVALID_PARAMETERS
    assert (got[5]["year_from"], got[5]["year_to"]) == (1900, 1999)
    zero = {r["qid"]: r for r in resolve_search(spark.createDataFrame(rows, schema), zero_allowed=True).collect()}
    assert zero[5]["plot_weight"] == 0.0 and got[5]["plot_weight"] == 0.5


def test_recommend_resolution(spark):
    rows = [(1, "tt0000005", True, None), (2, "tt0000005", False, "niche"), (3, "tt0000005", True, "niche"), (4, "xx", True, None)]
    got = {
        r["qid"]: r
        for r in resolve_recommend(
            spark.createDataFrame(rows, "qid long, item_id string, use_cultural_weights boolean, preset string")
        ).collect()
    }
    assert got[1]["popularity_weight"] == 0.33 and got[2]["plot_weight"] == 0.5 and got[3]["plot_weight"] == 0.7
    assert got[4]["error_code"] == C.ERROR_INVALID_ID and got[1]["source"] == 5


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_plan_does_not_grow_with_the_blocks(spark, monkeypatch):
    rng = np.random.default_rng(4)
    items, asked = item_table(spark, rng.normal(size=(50, 4)), 2), asked_table(spark, rng.normal(size=(40, 4)), 3)
    lines = []
    for size in (100, 4, 1):
        monkeypatch.setattr(C, "REQUESTS_PER_BLOCK", size)
        lines.append(len([x for x in plan_of(top_k(items, asked, ["plot"], ["n2"], 4)).splitlines() if "Generate" not in x]))
    assert max(lines) - min(lines) <= 4  # only the copies of one side appear


def test_each_request_has_its_own_number(spark):
    rng = np.random.default_rng(5)
    found = top_k(item_table(spark, rng.normal(size=(30, 4)), 3), asked_table(spark, rng.normal(size=(4, 4)), [1, 7, 0, 100]), ["plot"], ["n2"], 4)
    assert {r["qid"]: r["count"] for r in found.groupBy("qid").count().collect()} == {0: 1, 10: 7, 30: 30}


def test_request_without_a_vector_is_answered(spark, sf_dir):
    from marquee.operators.encoders import JoinEncoder

    films, model = W.stored_model(spark, sf_dir)
    asked = W.benchmark_requests(spark, sf_dir).select("qid", "query").limit(6)
    some = W.ENCODER.encode(asked.filter("qid % 2 = 0"), "qid", F.col("query"), "v")
    found = S.batch_search(asked, films, model, JoinEncoder(some, "qid", "v"))
    assert {r["qid"] for r in found.select("qid").distinct().collect()} == {r["qid"] for r in asked.collect()}


@pytest.mark.parametrize("options", [{}, {"broadcast_rows": 0}, {"broadcast_rows": 0, "lookup_rows": 1}])
def test_lookup_equals_plain_search(spark, options):
    import random

    random.seed(1)
    names = ["".join(random.choice("abcÉ ") for _ in range(random.randrange(12))) for _ in range(150)] + [None, "a" * 30]
    movies = [(i * 7 % 1000, n) for i, n in enumerate(names)]
    texts = [n[a:b].swapcase() for n in names if n for a in (0, 2, 5) for b in (3, 6, 12)] + ["", None, "zzz", "abcx", "a" * 10] * 3
    got = S.titles_by_text(spark.createDataFrame(list(enumerate(texts)), "qid long, title string"), spark.createDataFrame(movies, "tid long, title string"), **options)
    held = [(t, n.lower()) for t, n in movies if n is not None]
    want = {i: min((k for k, n in held if t.lower() in n), default=None) for i, t in enumerate(texts) if t is not None}
    assert {r["qid"]: r["tid"] for r in got.collect()} == {i: k for i, k in want.items() if k is not None}
    assert S.titles_by_text(spark.createDataFrame([(1, "")], "qid long, title string"), spark.createDataFrame([], "tid long, title string"), **options).collect() == []


def test_titles_by_text(spark):
    movies = spark.createDataFrame([(5, "The (Big) One"), (3, "Big+"), (9, "Éclair"), (1, None)], "tid long, title string")
    asked = spark.createDataFrame(
        [(1, "(big)"), (2, "BIG"), (3, "éc"), (4, "nothing"), (5, ""), (6, "g+"), (7, None)], "qid long, title string"
    )
    got = {r["qid"]: r["tid"] for r in S.titles_by_text(asked, movies).collect()}
    assert got == {1: 5, 2: 3, 3: 9, 5: 3, 6: 3}


def test_recommendation_omits_the_source(spark, sf_dir):
    films, model = W.stored_model(spark, sf_dir)
    asked = films.select(F.col("tid").alias("qid"), F.concat(F.lit("tt"), F.col("tid")).alias("item_id"), F.lit(True).alias("use_cultural_weights"))
    found = S.recommend(asked, films, model, W.ENCODER).toPandas()
    assert (found["qid"] != found["tid"]).all()
    assert found.groupby("qid").size().max() == 10


def test_empty_batch(spark, sf_dir):
    films, model = W.stored_model(spark, sf_dir)
    none = W.benchmark_requests(spark, sf_dir).withColumn("query", F.lit(""))
    assert S.batch_search(none, films, model, W.ENCODER).count() == 0


def test_sample_bars_do_not_change_the_result(spark):
    rng = np.random.default_rng(8)
    items = item_table(spark, rng.integers(-1, 2, (300, 4)).astype(float), 5)
    asked = asked_table(spark, rng.normal(size=(6, 4)), [9, 1, 30, 9, 9, 400])

    def run(sample):
        return sorted(map(tuple, top_k(items, asked, ["plot"], ["n2"], 4, sample).collect()))

    assert run(items.filter("tid % 7 = 0")) == run(None)
    assert run(items.filter("tid < 4")) == run(None)


def test_search_with_sample_is_the_same(spark, sf_dir):
    from dataclasses import replace

    films, model = W.stored_model(spark, sf_dir)
    bounded = replace(model, sample=model.components.filter("tid % 2 = 0"))
    asked = W.benchmark_requests(spark, sf_dir)

    def run(m):
        return sorted((r["qid"], r["rank"], r["tid"]) for r in S.batch_search(asked, films, m, W.ENCODER).collect())

    assert run(bounded) == run(model)


def test_items_are_not_shuffled_and_rounds_give_the_same(spark, monkeypatch):
    rng = np.random.default_rng(9)
    items, asked = item_table(spark, rng.integers(-1, 2, (200, 4)).astype(float), 5), asked_table(spark, rng.normal(size=(30, 4)), 7)
    monkeypatch.setattr(C, "REQUESTS_PER_BLOCK", 4)
    whole = top_k(items, asked, ["plot"], ["n2"], 4)
    plan = plan_of(whole)
    assert "FlatMapCoGroupsInArrow" not in plan and "BroadcastHashJoin" in plan
    monkeypatch.setattr(C, "ROUND_BYTES", 4 * 8 * 10)  # ten requests
    rounds = top_k(items, asked, ["plot"], ["n2"], 4)
    assert sorted(map(tuple, rounds.collect())) == sorted(map(tuple, whole.collect()))


def test_light_scores_are_close_and_shared():
    """Scores in single precision stay within their bound; requests of equal weights share the items' lengths and equal parts."""
    from marquee.operators import scoring

    rng = np.random.default_rng(8)
    dims, weights = [6, 5, 1], np.array([[0.25, 0.1, 0.02], [0.5, 0.0, 0.3]])[np.arange(64) % 2]
    parts = [rng.normal(size=(64, 6)), np.repeat(rng.normal(size=(1, 5)), 64, axis=0), np.full((64, 1), 1.5)]
    parts[0][3], items = 0.0, [rng.normal(size=(900, d)) * rng.choice([0.0, 1.0, 40.0], (900, 1)) for d in dims]
    squares = np.column_stack([(x**2).sum(1) for x in items])
    vectors, norms = np.hstack([x * weights[:, i : i + 1] for i, x in enumerate(parts)]), np.sqrt(sum((x**2).sum(1) * weights[:, i] for i, x in enumerate(parts)))
    wanted, bars = np.full(64, 7), np.full(64, -np.inf)
    block = scoring.RequestBlock(np.arange(64), vectors, weights, norms, wanted, bars, None, np.cumsum([0, *dims]))
    exact = vectors @ np.hstack(items).T / np.maximum(np.sqrt(weights @ squares.T) * norms[:, None], scoring.TINY)
    light = scoring.LightScores(block)
    made = light.items(np.hstack(items), squares)
    assert len(made) == 2 and all(shown.shape[1] == 8 for _, shown, _ in made)  # 12 dimensions, five of them as one number
    for rows, shown, theirs in made:
        assert shown.dtype == theirs.dtype == np.float32 and np.abs(shown @ theirs.T - exact[rows]).max() < light.slack / 2
    best = scoring.BestOfBlock(block)
    for a in range(0, 900, 250):
        best.add(np.arange(a, min(900, a + 250)), np.hstack(items)[a : a + 250], squares[a : a + 250], None)
    found = best.rows()
    for q in range(64):
        order = sorted(range(900), key=lambda i: (-np.round(exact[q, i], 9), i))[:7]
        assert found.filter(pa.compute.equal(found["qid"], q))["tid"].to_pylist() == order
    assert light.items(np.hstack(items) * 1e30, squares * 1e60) is not None
    assert light.items(np.hstack(items) * 1e-9, squares * 1e-18) is None  # lengths that may be the least ones are left to double precision
    assert not scoring.LightScores(scoring.RequestBlock(np.arange(64), vectors * np.nan, weights, norms * np.nan, wanted, bars, None, np.cumsum([0, *dims]))).usable
