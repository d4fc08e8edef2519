import pytest
from pyspark.sql import functions as F

TEXTS = [
    "the cat sat on the mat and the dog ran to the park with a ball in the sun",
    "The Cat sat on the mat and the dog ran to the park with a ball in the sun",
    "",
    " \t\n ",
    None,
    "wort " * 3000,
    "é" * 5000,
    'token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff" secret:ab pass',
    "x",
]


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty and long texts, repeated rows, and columns named like results."""
    rows = [(i, text, "en", i * 7) for i, text in enumerate(TEXTS)]
    rows += [rows[0], rows[0], rows[4], (None, TEXTS[0], None, None), (None, None, None, None)]
    names = "doc_id long, text string, print string, found int"
    return spark.createDataFrame(rows, names).withColumn("kept", F.lit(1)).repartition(3).persist()


@pytest.fixture(scope="session")
def nothing(odd):
    return odd.where("doc_id < 0")


def documents(spark, sf):
    return [(row["doc_id"], row["text"]) for row in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
