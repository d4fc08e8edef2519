"""Series, features, metrics and splits."""

import random
from collections import Counter
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from moodtide.operators import features
from moodtide.operators.bitmaps import bitmap, may_hold
from moodtide.operators.features import all_ngrams, corpus_counts, ngram_vocabulary, ngrams, term_counts, vocabulary
from moodtide.operators.metrics import accuracy, class_report, confusion_matrix
from moodtide.operators.series import chunk_means, last_per_time, number_points
from moodtide.operators.splits import random_split, recode_label, split_label, stable_split
from moodtide.plans.trend import trend

START = datetime(2021, 2, 2, 9, 17, 35)


def _series(spark, rows):
    return spark.createDataFrame(rows, "job string, dt timestamp, value int").repartition(4)


def test_golden_chunks(spark):
    rows = [("j", START + timedelta(seconds=i), v) for i, v in enumerate([1, -1, 1, 1, 1, -1, 1])]
    chunks = chunk_means(_series(spark, rows), ["job"]).orderBy("chunk").collect()
    assert [(c["chunk"], c["dt"], c["value"], c["points"]) for c in chunks] == [
        (0, START + timedelta(seconds=2), 0.6, 5),
        (1, START + timedelta(seconds=5), 0.0, 2),
    ]


def python_chunks(rows, size):
    out = []
    for job in sorted({row[0] for row in rows}):
        points = sorted((dt, value) for j, dt, value in rows if j == job)
        for start in range(0, len(points), size):
            part = points[start : start + size]
            label = part[size // 2 if len(part) == size else 0][0]
            out.append((job, label, sum(v for _, v in part) / len(part)))
    return sorted(out)


@pytest.mark.parametrize("size", [1, 4, 5])
@pytest.mark.parametrize("bucket", ["minute", "hour", "day"])
def test_chunks_with_a_hot_series(spark, size, bucket):
    rng = random.Random(size)
    rows = [("hot", START + timedelta(seconds=s), rng.choice([-1, 1])) for s in rng.sample(range(400_000), 700)]
    for job in range(40):
        rows += [(f"j{job}", START + timedelta(seconds=s), rng.choice([-1, 1])) for s in rng.sample(range(400_000), rng.randint(1, 12))]
    found = chunk_means(_series(spark, rows), ["job"], size, bucket=bucket).collect()
    assert sorted((c["job"], c["dt"], c["value"]) for c in found) == python_chunks(rows, size)
    assert all(-1 <= c["value"] <= 1 for c in found)


def test_no_window_over_a_whole_series(spark):
    frame = _series(spark, [("j", START, 1)])
    plan = number_points(frame, ["job"])._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.splitlines() if "row_number" in line and "Window" in line]
    assert windows and all("_bucket" in line for line in windows)


def test_last_value_wins(spark):
    rows = [("j", "2021-02-02 09:23:49", 4.0, 1), ("j", "2021-02-02 09:23:49", 0.0, 2), ("j", "2021-02-02 09:23:49", 4.0, 3),
            ("j", "None", 0.0, 4), ("j", "2021-02-02 09:23:50", 0.0, 5)]
    frame = spark.createDataFrame(rows, "job string, dt string, prediction double, seq long").repartition(3)
    assert [(c["value"], c["points"]) for c in trend(frame, ["job"]).collect()] == [(0.0, 2)]
    sample = spark.createDataFrame([("a", START, 1, 1), ("a", START, -1, 2)], "job string, dt timestamp, value int, seq long")
    assert [row["value"] for row in last_per_time(sample, ["job"]).collect()] == [-1]


def test_ngrams(spark):
    frame = spark.createDataFrame([(1, ["a", "b", "c"]), (2, ["a"]), (3, [])], "i int, w array<string>")
    rows = {r["i"]: (r["two"], r["all"]) for r in frame.select("i", ngrams(F.col("w"), 2).alias("two"), all_ngrams(F.col("w")).alias("all")).collect()}
    assert rows == {1: (["a b", "b c"], ["a", "b", "c", "a b", "b c", "a b c"]), 2: ([], ["a"]), 3: ([], [])}


def test_ngrams_like_the_ml_stage(spark):
    from pyspark.ml.feature import NGram

    rng = random.Random(3)
    rows = [([rng.choice("abcd") for _ in range(rng.randint(0, 9))],) for _ in range(50)]
    frame = spark.createDataFrame(rows, "w array<string>")
    for n in (1, 2, 3):
        both = NGram(n=n, inputCol="w", outputCol="ml").transform(frame).select("ml", ngrams(F.col("w"), n).alias("own"))
        assert both.where("ml <> own").count() == 0


def test_counts(spark):
    frame = spark.createDataFrame([(1, "b a b"), (2, "a"), (3, "")], "i int, t string")
    words = frame.withColumn("w", F.filter(F.split("t", " "), lambda w: w != ""))
    assert {tuple(r) for r in corpus_counts(words, "w").collect()} == {("a", 2), ("b", 2)}
    assert [tuple(r) for r in vocabulary(words, "w", 1).collect()] == [("a", 2)]
    assert {tuple(r) for r in term_counts(words, "i", F.col("w")).collect()} == {(1, "a", 1), (1, "b", 2), (2, "a", 1)}


def _plain_counts(rows, longest):
    counts = Counter()
    for tokens in rows:
        for n in range(1, longest + 1):
            counts.update(" ".join(tokens[i : i + n]) for i in range(len(tokens) - n + 1))
    return counts


@pytest.mark.parametrize("size, bits", [(1, 1 << 12), (7, 1 << 12), (40, 1 << 12), (40, 64), (100_000, 1 << 12)])
def test_pruned_vocabulary_equals_plain_counts(spark, size, bits):
    rng = random.Random(size)
    rows = [[rng.choice("aaaabbcdéfghij") for _ in range(rng.randint(0, 12))] for _ in range(60)] + [[], ["x"], ["x", "y"]]
    frame = spark.createDataFrame([(row,) for row in rows] + [(None,)], "w array<string>").repartition(3)
    counts = _plain_counts(rows, 3)
    expected = sorted(counts.items(), key=lambda item: (-item[1], item[0]))[:size]
    found = ngram_vocabulary(frame, "w", size, bits=bits)
    assert sorted(map(tuple, found.collect())) == sorted(expected)
    plain = vocabulary(frame.where("w IS NOT NULL").select(all_ngrams(F.col("w")).alias("terms")), "terms", size)
    assert sorted(map(tuple, plain.collect())) == sorted(expected)


def test_no_terms(spark):
    frame = spark.createDataFrame([([],), (None,)], "w array<string>")
    assert ngram_vocabulary(frame, "w", 5).count() == 0
    assert vocabulary(frame, "w", 5).count() == 0


def test_nth_term_sorts_few(spark):
    rng = random.Random(8)
    terms = sorted({"".join(rng.choice("abé日") for _ in range(rng.randint(1, 6))) for _ in range(300)} | {""})
    frame = spark.createDataFrame([(term,) for term in terms], "term string").repartition(4)
    for n in (1, 2, 57, len(terms)):
        for most in (1, 5, 1000):
            assert features._nth_term(frame, len(terms), n, most) == terms[n - 1]


def test_bitmap_never_misses(spark):
    held = spark.range(500).select(F.concat(F.lit("t"), F.col("id")).alias("term"))
    words = bitmap(held, "term", 1 << 14)
    rows = spark.range(20_000).select(F.col("id"), F.concat(F.lit("t"), F.col("id")).alias("term"))
    passed = [row["id"] for row in rows.where(may_hold(words, F.col("term"), 1 << 14)).select("id").collect()]
    assert set(range(500)) <= set(passed)
    assert len(passed) < 500 + 0.06 * 20_000


def test_rare_runs_are_left_out_before_the_shuffle(spark):
    rows = [["a", "b", "a", "b"]] * 30 + [[f"x{i}", f"y{i}", f"z{i}"] for i in range(500)]
    frame = spark.createDataFrame([(row,) for row in rows], "w array<string>")
    tokens = frame.select(F.col("w").alias("tokens"))
    hashes = corpus_counts(features._run_hashes(tokens, 1), "run_1")
    words = bitmap(hashes.where("cnt > 1"), "term", 1 << 14)
    counted = features._long_counts(tokens, 2, words, 1 << 14)
    assert counted.count() < 20
    plan = counted._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Aggregate") < plan.index("getbit") < plan.index("Generate")


def test_term_counts_shuffle_nothing(spark):
    frame = spark.createDataFrame([(1, "b a b")], "i int, t string")
    plan = term_counts(frame, "i", F.split("t", " "))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 0


def test_report_with_a_class_never_predicted(spark):
    frame = spark.createDataFrame([(0, 4), (4, 4), (4, 4), (0, 4)], "sentiment int, prediction int")
    rows = {r["class"]: tuple(r)[1:] for r in class_report(frame).collect()}
    assert rows["0"] == (0.0, 0.0, 0.0, 2)
    assert rows["4"] == pytest.approx((0.5, 1.0, 2 / 3, 2))
    assert rows["macro avg"] == pytest.approx((0.25, 0.5, 1 / 3, 4))
    assert rows["weighted avg"] == pytest.approx((0.25, 0.5, 1 / 3, 4))
    assert accuracy(frame).first()["accuracy"] == 0.5
    assert {tuple(r) for r in confusion_matrix(frame, [0, 4]).collect()} == {(0, 0, 2), (4, 0, 2)}


def test_splits(spark):
    frame = spark.range(20_000).withColumnRenamed("id", "doc_id")
    train, test = stable_split(frame, "doc_id")
    assert train.count() + test.count() == 20_000 and abs(train.count() - 16_000) < 400
    again = stable_split(frame.repartition(7), "doc_id")[1]
    assert test.exceptAll(again).count() == 0
    other = frame.where(split_label(F.col("doc_id"), seed=1) == "test")
    assert other.exceptAll(test).count() > 0
    a, b = random_split(frame)
    assert a.count() + b.count() == 20_000


def test_recode(values):
    assert values(lambda c: recode_label(c), ["0", "4", "2", None]) == [0, 1, None, None]
