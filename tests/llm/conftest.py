"""A small corpus with every awkward row: null and empty texts, copies, a long text, clashing extra columns."""

import random

import pytest
from pyspark.sql import types as T

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()), T.StructField("row", T.StringType()), T.StructField("kept", T.StringType())])


def words(r: random.Random, n: int) -> list[str]:
    return ["".join(r.choice(["ba", "to", "ri", "ne", "su", "mo", "ka", "le"]) for _ in range(r.randrange(1, 5))) for _ in range(n)]


def corpus() -> list[tuple]:
    r = random.Random(7)
    texts = [" ".join(words(r, r.randrange(1, 160))) for _ in range(60)]
    shared = words(r, 70)
    texts += [" ".join(words(r, 30) + shared + words(r, 30)) for _ in range(4)]
    edited = list(shared)
    edited[20], edited[45] = "changed", "words"
    texts += [" ".join(words(r, 40) + edited), texts[3], texts[3].replace(" ", " \t\n", 2), texts[3] + " more", "", "   ", None, None, "!!! ...", "Ünïcode ÉTÉ straße 12", "x" * 3000, " ".join(words(r, 9000))]
    rows = [(k, t, "en", "s", len(t or ""), "r", "k") for k, t in enumerate(texts)]
    return [*rows, rows[5]]  # a repeated row


@pytest.fixture(scope="session")
def rows():
    return corpus()


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
