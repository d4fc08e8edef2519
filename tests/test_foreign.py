"""The scorer outside Spark."""

import random

import pandas as pd
import pytest

from moodtide.plans.foreign import LinearScorer, score_elsewhere, store_weights
from moodtide.plans.optimality import INTERCEPT


def test_scorer_sums_the_weights_of_runs(spark, tmp_path):
    path = str(tmp_path / "w")
    store_weights(spark, [("good", 2.0), ("not good", -5.0), ("a b c", 1.5), (INTERCEPT, -1.0)], path)
    scorer = LinearScorer(path)
    texts = ["good", "not good", "a b c", "good good", "", "other"]
    assert [scorer.margin(text) for text in texts] == pytest.approx([1.0, -4.0, 0.5, 3.0, -1.0, -1.0])
    rows = spark.createDataFrame([(i, text) for i, text in enumerate([*texts, None])], "id long, text string").repartition(3)
    found = score_elsewhere(rows, lambda: LinearScorer(path), "id long, prediction double").collect()
    # No row for the null text.
    assert sorted(map(tuple, found)) == [(0, 4.0), (1, 0.0), (2, 4.0), (3, 4.0), (4, 0.0), (5, 0.0)]


def test_many_texts_at_once_score_as_spelled_out_runs(spark, tmp_path):
    rng = random.Random(5)
    tokens = ["a", "b", "c", "dd", "", "é"]
    spelled = {" ".join(rng.choices(tokens, k=rng.randint(1, 4))) for _ in range(60)} - {INTERCEPT}
    weights = {term: rng.uniform(-1, 1) for term in sorted(spelled)} | {INTERCEPT: 0.25}
    store_weights(spark, list(weights.items()), str(tmp_path / "w"))
    scorer = LinearScorer(str(tmp_path / "w"))
    texts = [" ".join(rng.choices([*tokens, "unknown"], k=rng.randint(0, 9))) for _ in range(600)]

    def margin(text):
        held = text.split(" ")
        runs = [" ".join(held[at : at + n]) for n in (1, 2, 3) for at in range(len(held) - n + 1)]
        return 0.25 + sum(weights[run] for run in runs if run != INTERCEPT and run in weights)

    expected = [margin(text) for text in texts]
    assert list(scorer.margins(texts)) == pytest.approx(expected, abs=1e-12)
    assert len(scorer.margins([])) == 0
    found = pd.concat(scorer(pd.DataFrame({"id": range(601), "text": [*texts, None]})))
    assert list(found["id"]) == list(range(600))
    assert list(found["prediction"]) == [4.0 if value > 0 else 0.0 for value in expected]


def test_only_an_intercept(spark, tmp_path):
    store_weights(spark, [(INTERCEPT, 1.0)], str(tmp_path / "w"))
    scorer = LinearScorer(str(tmp_path / "w"))
    assert list(scorer.margins(["a b c d", ""])) == [1.0, 1.0]


def test_a_scorer_may_give_any_number_of_rows_and_is_set_up_once_per_task(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "5")
    try:

        def setup():
            calls = [0]

            def scorer(batch):
                calls[0] += 1
                if calls[0] % 2:
                    yield batch.assign(n=calls[0])
                    yield batch.assign(n=calls[0])

            return scorer

        found = score_elsewhere(spark.range(0, 15, 1, 1), setup, "id long, n long").collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted(map(tuple, found)) == sorted([(i, 1) for i in range(5)] * 2 + [(i, 3) for i in range(10, 15)] * 2)
