"""Vectors of known runs next to those of Spark's stages."""

import random

import pyarrow as pa
import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.feature import CountVectorizerModel, NGram
from pyspark.sql import functions as F

from moodtide.operators import vectors
from moodtide.operators.vectors import VECTORS, KnownRuns, label_vectors
from moodtide.plans.training import Settings, fit, ngram_stages
from moodtide.sinks.files import keep


@pytest.mark.parametrize("slice_tokens", [1, 7, 1 << 18])
def test_vectors_equal_those_of_the_stages(spark, monkeypatch, slice_tokens):
    monkeypatch.setattr(vectors, "SLICE_TOKENS", slice_tokens)
    rng = random.Random(slice_tokens)
    rows = [[rng.choice(["a", "b", "c", "", "é", "unknown"]) for _ in range(rng.randint(0, 9))] for _ in range(80)]
    # Some longer terms whose beginnings are no terms, and one that no row holds.
    terms = ["a", "b", "", "é", "a b", "c c", " a", "a ", "b a c", "c é b", "  ", "nowhere"]
    frame = spark.createDataFrame([(float(i), row) for i, row in enumerate(rows)], "label double, words array<string>").repartition(3)
    counter = CountVectorizerModel.from_vocabulary(terms, "c_words", "features")
    expected = PipelineModel([*ngram_stages(Settings())[2:], counter]).transform(frame).select("label", "features")
    found = keep(label_vectors(frame, "words", terms, 3), "vectors", VECTORS)
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, expected.collect()))


def test_no_terms_and_no_rows():
    known = KnownRuns([], 3)
    assert known.vectors(pa.array([["a", "b"], []], pa.list_(pa.string()))).to_pylist() == [{"type": 0, "size": 0, "indices": [], "values": []}] * 2
    assert KnownRuns(["a"], 3).vectors(pa.array([], pa.list_(pa.string()))).to_pylist() == []


def test_slices_of_a_batch_start_where_they_are_cut():
    whole = pa.array([["x"], ["a", "b"], ["b"]], pa.list_(pa.string()))
    assert [vector["indices"] for vector in KnownRuns(["a", "b", "a b"], 3).vectors(whole.slice(1)).to_pylist()] == [[0, 1, 2], [1]]


def test_a_fit_spells_out_no_run(spark, monkeypatch):
    def spelled(self, dataset):
        raise AssertionError("runs are spelled out")

    monkeypatch.setattr(NGram, "_transform", spelled)
    rows = spark.range(60).select((F.col("id") % 2 * 4).cast("int").alias("sentiment"), F.concat(F.lit("day of number"), F.col("id") % 5).alias("text"))
    assert "day of number" in fit(rows, Settings(vocabulary_size=20, max_iterations=2)).stages[-3].vocabulary
