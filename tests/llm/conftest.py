import re

import pytest

EDGES = [
    (1, None, "en", "a", 0),
    (2, "", "en", None, 0),
    (3, " \n\t", None, "a", 3),
    (4, "one", "en", "b", 3),
    (5, "a b c d e f g", "en", "b", 13),
    (5, "a b c d e f g", "en", "b", 13),
    (None, "x y z", "en", "c", 5),
    (6, "The MIT License is " + "w " * 200, "de", "c", None),
    (7, " ".join(f"v{i}" for i in range(300)), "fr", "c", 1),
    (8, " ".join(f"v{i}" for i in range(300)) + " tail", "fr", "c", 1),
    (9, "ünï cödé 漢字 🙂 " * 30, "es", "a", 1),
    (10, "long " + " ".join(f"u{i % 977}x{i}" for i in range(40000)), "en", "a", 1),
]


def words(text, lower=False, pattern=r"[^\x20\x09-\x0D]+"):
    text = text or ""
    return re.findall(pattern, re.sub("[A-Z]", lambda m: m[0].lower(), text) if lower else text)


@pytest.fixture(scope="session")
def edges(spark):
    """Nulls, empty and long texts, repeated rows, and columns whose names clash with those of the operators."""
    rows = [(*r, 1, 2, "k") for r in EDGES]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, chunk int, row int, kept string").repartition(3)


@pytest.fixture(scope="session")
def none(edges):
    return edges.limit(0)


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


@pytest.fixture(scope="session")
def labels(spark):
    return spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
