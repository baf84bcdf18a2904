import pytest

#: Names that operators use within.
CLASHES = {"score": 1.0, "rank": 2, "block": 3, "band": 4, "label": "x", "shard": 5, "n": 6, "size": 7, "kept": True, "v": "y", "word": "z"}


def with_clashes(df):
    from pyspark.sql import functions as F

    return df.select("*", *(F.lit(v).alias(k) for k, v in CLASHES.items()))


@pytest.fixture(scope="session")
def messy(spark):
    """Documents with nulls in every column, empty, long and repeated texts, and clashing names."""
    long = " ".join(f"word{i % 977}" for i in range(30_000))
    rows = [(1, None), (2, ""), (3, "one two three"), (3, "one two three"), (4, " \n\t "), (None, "text without an id at all"), (5, long), (6, long), (None, None), (7, "ß É ñ 日本 \U0001f600"), (8, "a")]
    rows = [(i, t, None if k % 2 else "en", None, None) for k, (i, t) in enumerate(rows)]
    return with_clashes(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"))


@pytest.fixture(scope="session")
def nothing(spark):
    return with_clashes(spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long"))


@pytest.fixture(scope="session")
def no_labels(spark):
    return spark.createDataFrame([], "doc_id long, quality int, toxic int")
