import random

import pytest

EXTRA = "doc string, id long, h1 long, words string, lost string, bucket long, rank int, kept boolean, row string, length long, posterior double, copies long, word string, vec_id long"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + EXTRA


def filler(name: str):
    return (name, 1, 2, "w", "l", 3, 4, True, "r", 5, 0.5, 6, "x", 7)


def words(seed: int, n: int, vocabulary: int = 4000) -> str:
    draw = random.Random(seed)
    return " ".join(f"w{draw.randrange(vocabulary)}" for _ in range(n))


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls in every column, empty, blank and very long texts, ties, repeated rows and ids, clashing extra columns."""
    long = words(1, 60_000, 50_000)
    near = words(2, 300)
    rows = [
        (1, words(3, 120), "en", "s", 1), (2, None, "en", None, None), (3, "", "en", "s", 0), (4, " \t\n \r", None, "s", 4),
        (5, long, "en", "s", 1), (6, long, "en", "s", 1), (7, near, "de", "s", 1), (8, near.replace("w1", "v1", 3), "de", "s", 1),
        (9, "Released under the MIT License.\nline of at least twenty chars\nx", "en", "s", 1),
        (10, "LINE of at least twenty chars \n\nGNU General Public License", "xx", "s", 1),
        (11, "line of at least twenty chars\nline of at least twenty chars", "fr", "s", 1),
        (None, words(4, 80), "en", "s", 1), (None, words(4, 80), "en", "s", 1), (None, None, None, None, None),
        (12, "Ünïcödé ÉCOLE 你好 世界 🙂 " + "a b c d e f g h " * 9, "en", "s", 1), (12, "Ünïcödé ÉCOLE 你好 世界 🙂 " + "a b c d e f g h " * 9, "en", "s", 1),
        (13, "single", "es", "s", 1), (14, "single", "es", "s", 1), (-5, "word " * 30, "es", "s", 1),
    ]
    return [r + filler(str(i)) for i, r in enumerate(rows)]


@pytest.fixture(scope="session")
def odd_docs(spark, odd_rows):
    return spark.createDataFrame(odd_rows, SCHEMA).cache()


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def odd_labels(spark):
    return spark.createDataFrame([(1, 1, 0), (5, None, 1), (9, 0, None), (None, 1, 1), (7, 1, 1), (999, 1, 1), (7, 1, 0)], "doc_id long, quality int, toxic int")
