import pytest

WORDS = "one two three four five six seven eight nine ten eleven twelve".split()


def awkward_rows():
    """Nulls, empty and long texts, ties, repeated rows; extra columns are named as the operators' own."""
    long = " ".join(f"{WORDS[i % 12]}{i}" for i in range(9000))
    texts = [
        (1, "The cat sat on the mat and looked at the dog."), (2, None), (3, ""), (4, " \t\n "), (5, long), (6, long + " end"), (7, "The  cat sat on the mat\nand looked at the dog."),
        (7, "The  cat sat on the mat\nand looked at the dog."), (8, "été à la mer 你好 <|endoftext|> 😀"), (9, "x"), (None, "a row without an id"), (10, long),
    ]
    return [(i, t, None if i == 3 else ("en" if (i or 0) % 2 else "fr"), None if i == 4 else f"s{(i or 0) % 3}", 0, 0.5, "x", 1, "k") for i, t in texts]


SCHEMA = "doc_id long, text string, lang string, source string, copy int, score double, lang_pred string, n_tokens int, k string"


@pytest.fixture(scope="session")
def awkward(spark):
    return spark.createDataFrame(awkward_rows(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
