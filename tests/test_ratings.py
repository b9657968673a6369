import pytest
from pyspark.sql import functions as F

from marquee.operators.eligibility import eligible_ids, require_columns
from marquee.operators.features import with_popularity
from marquee.operators.ratings import fuse_ratings, normalize_scalars


def test_fusion(spark):
    rows = [(1, 8.0, 100, 70), (2, 6.0, 300, None), (3, None, 50, 40), (4, None, 10, None), (5, 9.0, 0, None), (6, 5.0, 0, 50)]
    df = spark.createDataFrame(rows, "tid long, rating double, votes long, metascore int")
    got = {r["tid"]: r for r in fuse_ratings(df).collect()}
    mv, mr = (100 + 300 + 50 + 10) / 4, (0.8 + 0.6 + 0.9 + 0.5) / 4
    bayes = 100 / (100 + mv) * 0.8 + mv / (100 + mv) * mr
    assert set(got) == {1, 2, 3, 6}
    assert got[1]["bayes_rating"] == pytest.approx(bayes)
    assert got[1]["final_rating"] == pytest.approx((bayes + 0.7) / 2)
    assert got[1]["controversy_score"] == pytest.approx(abs(bayes - 0.7) * min(100, mv) / mv)
    assert got[2]["final_rating"] == got[2]["bayes_rating"] and got[2]["controversy_score"] is None
    assert got[3]["final_rating"] == 0.4 and got[3]["bayes_rating"] is None
    assert got[6]["votes"] is None and got[6]["final_rating"] == 0.5


def test_scaling(spark):
    rows = [(1, 10, 5, None), (2, 20, 5, None), (3, None, None, None)]
    df = spark.createDataFrame(rows, "tid long, a int, b int, c double")
    got = {r["tid"]: r for r in normalize_scalars(df, ["a", "b", "c"]).collect()}
    assert [got[i]["sn_a"] for i in (1, 2, 3)] == [0.0, 1.0, None]
    assert [got[i]["sn_b"] for i in (1, 2, 3)] == [0.5, 0.5, 0.5]
    assert [got[i]["sn_c"] for i in (1, 2, 3)] == [0.5, 0.5, 0.5]


def test_eligible(spark):
    titles = [
        ("tt0000001", "movie", 1970), ("tt0000002", "tvMovie", 1969), ("tt0000003", "tvSeries", 2000), ("tt0000004", "movie", None),
        ("tt0000005", "movie", 2000), ("tt0000006", "movie", 2000), ("tt12345678", "tvMovie", 2001), ("tt0000008", "movie", 2000),
    ]
    ratings = [
        ("tt0000001", 1.0, 2500), ("tt0000002", 9.0, 9999), ("tt0000003", 9.0, 9999), ("tt0000004", 9.0, 9999),
        ("tt0000005", 9.0, 2499), ("tt0000006", 0.9, 9999), ("tt12345678", 5.0, 5000), ("tt0000009", 9.0, 9999),
    ]
    df = eligible_ids(
        spark.createDataFrame(titles, "tconst string, titleType string, startYear int"),
        spark.createDataFrame(ratings, "tconst string, averageRating double, numVotes long"),
    )
    assert sorted(r["tid"] for r in df.collect()) == [1, 12345678]


def test_popularity(spark):
    df = spark.createDataFrame([(1, 0.0), (2, 1.0), (3, None), (4, 0.05)], "tid long, sn_votes double")
    got = {r["tid"]: r["pop"] for r in with_popularity(df).collect()}
    assert got[1] == pytest.approx(0.01) and got[2] == pytest.approx(2.0) and got[3] == got[1]
    assert got[1] < got[4] < got[2]
    same = with_popularity(df.withColumn("sn_votes", F.lit(0.3)))
    assert {r["pop"] for r in same.collect()} == {1.0}


def test_required_columns(spark):
    require_columns(spark.createDataFrame([(1, "x")], "tid long, plot string"))
    for schema in ("a long, plot string", "tid long, title string"):
        with pytest.raises(ValueError):
            require_columns(spark.createDataFrame([(1, "x")], schema))
