import json

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from marquee.functions import parsing as P
from marquee.functions.ids import key_from_text, text_from_key, try_key_from_text
from marquee.functions.text import diversity_bucket, item_query, keyword_genres
from marquee.sources.payloads import good_rows, parse_payloads, quarantine, require_good


def values(spark, fn, inputs, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(inputs)], f"i int, v {kind}")
    return [r[0] for r in rows.orderBy("i").select(fn(F.col("v")).alias("r")).collect()]


def test_lists(spark):
    texts = [None, "", "N/A", "Crime, , Drama", " a ,b", " x ,y"]
    assert values(spark, P.parse_list, texts) == [[], [], [], ["Crime", "Drama"], ["a", "b"], ["x", "y"]]
    assert values(spark, lambda c: P.parse_list(c, "&"), ["A & B", "A.B", "N/A"]) == [["A", "B"], ["A.B"], []]


def test_integers(spark):
    texts = ["2,500,000", " 12 ", "1994–1998", "1.5", "", "N/A", None, "-3", "abc"]
    assert values(spark, P.parse_int, texts) == [2500000, 12, None, None, None, None, None, -3, None]


def test_numbers(spark):
    texts = ["9.3", " 7 ", "nan", "inf", "1e2", "1d", "N/A", None, "x", ".5"]
    assert values(spark, P.parse_float, texts) == [9.3, 7.0, None, None, 100.0, None, None, None, None, 0.5]


def test_minutes(spark):
    texts = ["2h 13min", "173 min", "1h", "45min", "90", "0 min", "1,030 min", "abc", "N/A", None, "2 H 5 M"]
    assert values(spark, P.parse_minutes, texts) == [133, 173, 60, 45, 90, 0, 30, None, None, None, 125]


def test_texts(spark):
    assert values(spark, P.parse_text, ["  a ", "   ", "", "N/A", None]) == ["a", "", None, None, None]


def test_list_fields(spark):
    assert values(spark, P.list_from_text, [None, " ", "a, ,b "]) == [[], [], ["a", "b"]]
    assert values(spark, P.list_from_array, [None, [], ["a", "", None]], "array<string>") == [[], [], ["a"]]


def test_ids(spark):
    assert values(spark, text_from_key, [7, 1234567, 123456789], "long") == ["tt0000007", "tt1234567", "tt123456789"]
    assert values(spark, key_from_text, ["tt0000007", "tt123456789"]) == [7, 123456789]
    assert values(spark, try_key_from_text, ["tt", "xx", "tt1x", "tt-5", None, "tt9"]) == [None] * 5 + [9]
    with pytest.raises(PySparkException):
        values(spark, key_from_text, ["ttx"])


def test_query_texts(spark):
    df = spark.createDataFrame([(["Crime", "Drama"], "é" * 300), ([], None)], "g array<string>, p string")
    assert [r[0] for r in df.select(item_query(F.col("g"), F.col("p"))).collect()] == ["crime drama " + "é" * 300, " "]
    assert [r[0] for r in df.select(item_query(F.col("g"), F.col("p"), 200)).collect()] == ["crime drama " + "é" * 200, " "]
    assert values(spark, keyword_genres, ["A MAFIA love story", "", "edge of Space"]) == [
        ["Crime", "Romance"],
        [],
        ["Thriller", "Sci-Fi"],
    ]


def test_diversity(spark):
    import numpy as np

    counts = [0, 1, 2, 3, 4, 5, 6, 7]
    expected = np.digitize(counts, np.linspace(1, 7, 5)).tolist()
    assert values(spark, lambda c: diversity_bucket(c, F.lit(7), 5), counts, "int") == expected
    assert values(spark, lambda c: diversity_bucket(c, F.lit(1), 5), [0, 1], "int") == [0, 0]


def payload(**fields):
    return json.dumps({"Response": "True", **fields})


def test_payloads(spark):
    rows = [
        (1, payload(Title=" T ", Year="1994", Runtime="2h 22min", Genre="Drama", imdbRating="9.3", imdbVotes="2,500,000")),
        (2, json.dumps({"Response": "False", "Error": "Movie not found!"})),
        (3, "{broken"),
        (4, json.dumps({"Title": "no response"})),
        (5, payload(Year="70000")),
        (6, payload(Title="N/A", Metascore="80", Awards="A & B", Plot="   ")),
        (7, None),
        (2**40, payload(imdbVotes="5,000,000,000", Runtime="10000h", Metascore="-1", Year="9" * 30)),
    ]
    parsed = parse_payloads(spark.createDataFrame(rows, "tid long, raw string"))
    good = {r["tid"]: r for r in good_rows(parsed).collect()}
    bad = {r["tid"]: r["error"] for r in quarantine(parsed).collect()}
    assert set(good) == {1, 5, 6, 2**40} and good[5]["year"] == 70000
    large = good[2**40]
    assert (large["votes"], large["runtime"], large["metascore"], large["year"]) == (5_000_000_000, 600_000, -1, None)
    assert bad == {
        2: "Movie not found!",
        3: "malformed payload",
        4: "Unknown error",
        7: "malformed payload",
    }
    one = good[1]
    assert (one["title"], one["year"], one["runtime"], one["genre"], one["director"]) == ("T", 1994, 142, ["Drama"], [])
    assert (one["rating"], one["votes"], one["metascore"], one["plot"]) == (9.3, 2500000, None, None)
    assert (good[6]["title"], good[6]["metascore"], good[6]["awards"], good[6]["plot"]) == (None, 80, ["A", "B"], "")
    with pytest.raises(PySparkException):
        require_good(parsed).collect()
