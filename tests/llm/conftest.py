import pytest
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, shard string, row int"
LINE = "The seventh letter was found under a stone by the river, and nobody could read it."


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and very long texts, ties, repeated rows and extra columns whose names clash."""
    rows = [
        (1, None, None, None, None),
        (2, "", "en", "a", 0),
        (None, LINE, "en", "a", 9),
        (4, LINE, "en", "a", 9),
        (4, LINE, "en", "a", 9),
        (5, LINE, None, "b", None),
        (6, " \n\t ", "en", "a", 4),
        (7, "\n".join([LINE] * 3), "en", "a", 1),
        (8, "word " * 60_000, "en", "a", 1),
        (9, " ".join(f"w{i}" for i in range(50_000)), "en", "a", 1),
        (10, "é ü \U0001f600 " + LINE, "fr", "a", 1),
        (11, "x" * 200_000, "en", "a", 1),
        (12, "7" * 50_000 + " " + "1 2-3 " * 20_000, "en", "a", 1),
    ]
    return spark.createDataFrame([(*r, "k", "s", 3) for r in rows], SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def empty(odd):
    return odd.where(F.lit(False))
