import pathlib

import pytest
from pyspark.sql import functions as F

ROOT = str(pathlib.Path(__file__).resolve().parents[2])

LONG = " ".join(f"word{k % 977} other{k % 1013}" for k in range(12_000))
PASSAGE = " ".join(f"passage{k}" for k in range(70))
AWKWARD = [
    (1, None),
    (2, ""),
    (3, ""),
    (4, LONG),
    (5, LONG + " and one more"),
    (6, f"start of one {PASSAGE} end of one"),
    (7, f"another start\n{PASSAGE}\nanother end"),
    (8, "same row"),
    (8, "same row"),
    (8, "same id, other text"),
    (None, "a row without an id"),
    (9, " \n\t \x0b "),
    (10, "tab\tand\r\nline\n\n\nends  two spaces   three"),
    (11, "ÄÖÜ ß é é 日本語 😀     x"),
    (12, "one"),
    (13, "a a a a a a a a a a a a a a a a a a a a a a a a a a a a a a a a a a a a a a a a a a a a a a a a a a a a"),
    (14, "the line that is there twice in this text\nthe line that is there twice in this text\nlast"),
    (-5, "<|endoftext|> ▁ marks <s> </s> \x1c\x1d"),
]
#: Names the operators use themselves.
CLASHING = ["id", "kept", "n_words", "fp", "place", "line", "text_hash", "h1", "bucket", "count", "sequence_id", "ids", "path", "word", "extra_0"]


def brute_components(items, linked):
    """Least member of each item's component; `linked` tells pairs."""
    parent = {x: x for x in items}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in linked:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {x: find(x) for x in items}


@pytest.fixture(scope="session")
def awkward(spark):
    """Nulls, empty and long texts, ties, repeated rows, and columns with the names the operators use."""
    df = spark.createDataFrame(AWKWARD, "doc_id bigint, text string").repartition(3)
    return df.withColumns({c: F.lit(f"value of {c}") for c in CLASHING})


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], "doc_id bigint, text string, lang string, source string, n_chars bigint")


@pytest.fixture(scope="session")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.fixture(scope="session")
def texts(docs):
    return {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
