import pytest
from pyspark.sql import functions as F

LONG = " ".join(f"w{i % 97}x{i % 31}" for i in range(6000))
BASE = " ".join(f"word{i}" for i in range(60))
ODD = [
    (1, None, "a"), (2, "", "a"), (3, " \t\n ", None), (4, BASE, "b"), (5, BASE, "b"), (6, BASE.upper() + "\n", "a"),
    (7, BASE + " tail", "c"), (8, BASE.replace("word30", "other"), "c"), (9, "two words", "a"), (10, "two  words", "a"),
    (11, LONG, "b"), (12, LONG + " end", "b"), (13, "mail a.b@c.de, card 4111 1111 1111 1111 ip 10.0.0.1 tel +1 (212) 555-0100.", "a"),
    (14, "é ▁ 日本\x00 \U0001f600", "é"), (5, BASE, "b"), (None, BASE, "b"), (15, "one", None),
]


@pytest.fixture(scope="session")
def odd(spark):
    """Null, empty, wordless, repeated and long texts; repeated rows; a row without id; columns with clashing names."""
    rows = [(i, t, "en", s, None if t is None else len(t), "x", 1) for i, t, s in ODD]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, node string, score int").coalesce(1).cache()


@pytest.fixture(scope="session")
def nothing(odd):
    return odd.filter(F.lit(False))
