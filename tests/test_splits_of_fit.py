"""The regression runs in few tasks, however small the splits of its vectors."""

import pytest
from pyspark.ml.classification import LogisticRegression
from pyspark.sql import functions as F

from moodtide.plans import training
from moodtide.plans.training import Settings, fit, unigram_stages
from moodtide.sources.files import fewer_splits

SPLITS = {"spark.sql.files.maxPartitionBytes": "2k", "spark.sql.files.openCostInBytes": "2k"}


@pytest.fixture
def small_splits(spark):
    before = {key: spark.conf.get(key) for key in SPLITS}
    for key, value in SPLITS.items():
        spark.conf.set(key, value)
    yield
    for key, value in before.items():
        spark.conf.set(key, value)


@pytest.fixture
def labelled(spark):
    text = F.concat(F.lit("love this great happy day number"), F.col("doc_id") % 7, F.when(F.col("doc_id") % 2 == 0, " sad").otherwise(" glad"))
    rows = spark.range(400).withColumnRenamed("id", "doc_id").withColumn("text", text)
    return rows.withColumn("sentiment", (F.col("doc_id") % 2 * 4).cast("int")).repartition(40)


@pytest.mark.parametrize("single", [False, True])
def test_regression_runs_in_few_tasks(spark, labelled, small_splits, monkeypatch, single):
    seen = []

    class Counting(LogisticRegression):
        def fit(self, dataset):
            seen.append((dataset.rdd.getNumPartitions(), dataset.count()))
            return super().fit(dataset)

    monkeypatch.setattr(training, "LogisticRegression", Counting)
    settings = Settings(vocabulary_size=50, max_iterations=5)
    model = fit(labelled, settings, unigram_stages(settings) if single else None)
    (tasks, rows), cores = seen[0], spark.sparkContext.defaultParallelism
    assert rows == 400 and tasks <= cores
    assert model.transform(labelled).where("prediction <> sentiment").count() == 0


def test_splits_stay_below_a_bound(spark, labelled, small_splits, tmp_path):
    labelled.write.parquet(str(tmp_path / "rows"))
    stored = spark.read.parquet(str(tmp_path / "rows"))
    splits, cores = stored.rdd.getNumPartitions(), spark.sparkContext.defaultParallelism
    assert splits == 40
    assert fewer_splits(stored).rdd.getNumPartitions() == cores
    assert cores < fewer_splits(stored, 4_000).rdd.getNumPartitions() < splits
    assert fewer_splits(stored, 1).rdd.getNumPartitions() == splits
    assert fewer_splits(stored).exceptAll(stored).count() == 0 and fewer_splits(stored).count() == 400


def test_no_rows(spark, labelled, tmp_path):
    labelled.where("doc_id < 0").write.parquet(str(tmp_path / "rows"))
    assert fewer_splits(spark.read.parquet(str(tmp_path / "rows"))).count() == 0
