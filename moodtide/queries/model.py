"""Training, evaluation and scoring."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from moodtide.functions.cleaning import clean_text
from moodtide.functions.stopped import STOP_WORDS
from moodtide.functions.words import lower_tokens
from moodtide.operators.features import all_ngrams, term_counts
from moodtide.operators.metrics import accuracy, class_report, confusion
from moodtide.operators.records import result_lines
from moodtide.operators.splits import random_split, recode_label, stable_split
from moodtide.plans.analysis import analyse_jobs
from moodtide.plans.foreign import LinearScorer, score_elsewhere, store_weights
from moodtide.plans.optimality import INTERCEPT, loss_gradient, stored_weights
from moodtide.plans.scoring import predict, predict_file
from moodtide.plans.training import Settings, fit, train_and_store, unigram_stages
from moodtide.queries.base import TWEET_TIME_SQL, clean_sql, documents, labelled, query, search_jobs, terms_sql, tokens_sql, tweets
from moodtide.session import scratch_path
from moodtide.sinks import files as sinks
from moodtide.sources.files import load_model
from moodtide.sources.files import table

_fitted: dict[tuple[str, str], tuple[str, PipelineModel, DataFrame]] = {}


def fitted(spark: SparkSession, sf: str) -> tuple[str, PipelineModel, DataFrame]:
    """Model folder, model and held-out predictions; fitted once per session and scale."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _fitted:
        root = scratch_path(spark, "model")
        model, predicted = train_and_store(labelled(spark, sf), "doc_id", root)
        _fitted[key] = (root, model, predicted)
    return _fitted[key]


_LABELLED_SQL = "(SELECT doc_id, text, quality * 4 AS sentiment FROM documents JOIN labels USING (doc_id))"


def _part_sql(part: str) -> str:
    """The labelled documents of one part of the split."""
    sign = "<" if part == "train" else ">="
    return f"(SELECT * FROM {_LABELLED_SQL} WHERE left(md5('100500:' || CAST(doc_id AS VARCHAR)), 8) {sign} 'cccccccc')"


def _terms_of(spark, model: PipelineModel) -> DataFrame:
    """The vocabulary of a fitted model, as large as its settings allow."""
    listed = next(stage.vocabulary for stage in model.stages if hasattr(stage, "vocabulary"))
    return spark.createDataFrame([(term,) for term in listed], "term string")


@query(
    "train_vocabulary",
    f"""SELECT term FROM {terms_sql(f"(SELECT doc_id, {tokens_sql(clean_sql('text'))} AS w FROM {_part_sql('train')})")}
        GROUP BY term ORDER BY count(*) DESC, term LIMIT 80000""",
)
def train_vocabulary(spark, sf):
    """The terms that the stored model knows: the most frequent ones of the training part."""
    root, _, _ = fitted(spark, sf)
    return _terms_of(spark, load_model(root))


# The fit ends when a step improves the loss by less than a millionth; at sf0.01 the largest component is then 1e-9.
_FLAT = 1e-6


@query(
    "fit_gradient",
    f"""SELECT least(80000, (SELECT count(DISTINCT term) FROM
                   {terms_sql(f"(SELECT doc_id, {tokens_sql(clean_sql('text'))} AS w FROM {_part_sql('train')})")})) AS terms,
               (SELECT count(*) FROM {_part_sql('train')}) AS rows, true AS flat""",
)
def fit_gradient(spark, sf):
    """Whether the gradient of the loss at the stored weights is flat, from term counts joined with the weights."""
    root, _, _ = fitted(spark, sf)
    train, _ = stable_split(labelled(spark, sf), "doc_id")
    train = train.withColumnRenamed("doc_id", "row_id")
    counts = term_counts(train, "row_id", all_ngrams(lower_tokens(clean_text(F.col("text")))))
    labels = train.select("row_id", recode_label(F.col("sentiment")).alias("label"))
    weights = stored_weights(load_model(root))
    gradient = loss_gradient(counts, labels, spark.createDataFrame(weights, "term string, weight double"), len(weights))
    rows = labels.agg(F.count(F.lit(1)).alias("rows")).scalar()
    return gradient.agg(
        F.count_if(F.col("term") != INTERCEPT).alias("terms"), rows.alias("rows"), (F.max(F.abs("gradient")) < _FLAT).alias("flat")
    )


@query("held_out", f"SELECT doc_id, sentiment, true AS coded FROM {_part_sql('test')}")
def held_out(spark, sf):
    """Stored held-out rows; every prediction is one of the two codes."""
    _, _, predicted = fitted(spark, sf)
    return predicted.select("doc_id", "sentiment", F.col("prediction").isin(0.0, 4.0).alias("coded"))


@query(
    "stored_report_support",
    f"""SELECT CAST(sentiment AS VARCHAR) AS class, count(*) AS support, true AS same FROM {_part_sql('test')} GROUP BY sentiment
        UNION ALL SELECT unnest(['macro avg', 'weighted avg']), count(*), true FROM {_part_sql('test')}""",
)
def stored_report_support(spark, sf):
    """The stored class report: its rows and supports, and whether its figures follow from the stored predictions."""
    root, _, predicted = fitted(spark, sf)
    spark_report = spark.read.json(f"{root}/models/v5/report")
    classes = predicted.groupBy("sentiment").agg(
        F.count(F.lit(1)).alias("held"), F.avg((F.col("prediction") == F.col("sentiment")).cast("double")).alias("found")
    )
    classes = classes.select(F.col("sentiment").cast("string").alias("class"), "held", "found")
    every = predicted.agg(F.count(F.lit(1)).alias("held"), F.avg((F.col("prediction") == F.col("sentiment")).cast("double")).alias("found"))
    # The weighted recall is the accuracy; the macro recall is the plain mean over the classes.
    weighted = every.select(F.lit("weighted avg").alias("class"), "held", "found")
    macro = classes.agg(F.lit("macro avg").alias("class"), F.sum("held").alias("held"), F.avg("found").alias("found"))
    again = classes.unionByName(weighted).unionByName(macro)
    same = (F.abs(F.col("recall") - F.col("found")) < 1e-9) & (F.col("support") == F.col("held"))
    return spark_report.join(again, "class", "left").select("class", "support", F.coalesce(same, F.lit(False)).alias("same"))


@query("train_eval")
def train_eval(spark, sf):
    """Accuracy on the held-out part."""
    _, _, predicted = fitted(spark, sf)
    return accuracy(predicted)


@query("stored_scores")
def stored_scores(spark, sf):
    """The accuracy as stored next to the model."""
    root, _, _ = fitted(spark, sf)
    return spark.read.json(f"{root}/models/v5/scores")


@query("model_confusion")
def model_confusion(spark, sf):
    _, _, predicted = fitted(spark, sf)
    return confusion(predicted)


@query("model_report")
def model_report(spark, sf):
    _, _, predicted = fitted(spark, sf)
    return class_report(predicted)


def _parts(model: PipelineModel) -> tuple:
    """What the predictions of a model depend on: its terms and its weights."""
    counter = next(stage for stage in model.stages if hasattr(stage, "vocabulary"))
    weights = next(stage for stage in model.stages if hasattr(stage, "coefficients"))
    return counter.vocabulary, weights.coefficients.toArray().tolist(), weights.intercept


@query("model_roundtrip", "SELECT true AS same, count(*) AS n FROM documents")
def model_roundtrip(spark, sf):
    """Documents scored by the loaded model, and whether its terms and weights are those from before it was stored.

    The model before that is not applied itself: its training summary holds the session, which no task can take.
    """
    root = scratch_path(spark, "roundtrip")
    train, _ = stable_split(labelled(spark, sf), "doc_id")
    model = fit(train, Settings())
    sinks.save_model(model, root)
    loaded = load_model(root)
    scored = predict(documents(spark, sf, "doc_id", "text"), loaded, ["doc_id"])
    same = F.lit(_parts(model) == _parts(loaded)) & F.col("prediction").isin(0.0, 4.0)
    return scored.groupBy(same.alias("same")).agg(F.count(F.lit(1)).alias("n"))


@query("predicted_times", f"SELECT {TWEET_TIME_SQL} AS dt, true AS coded FROM documents")
def predicted_times(spark, sf):
    """The result lines taken apart: a time and one of the two codes in each."""
    parts = F.split("value", ", ")
    coded = F.get(parts, 1).isin("0.0", "4.0") & (F.size(parts) == 2)
    return predict_lines(spark, sf).select(F.get(parts, 0).alias("dt"), coded.alias("coded"))


@query("predict_lines")
def predict_lines(spark, sf):
    """Every document scored, as result lines."""
    root, _, _ = fitted(spark, sf)
    texts = tweets(spark, sf).withColumn("dt", F.try_to_timestamp(F.substring("datetime", 1, 19)))
    return result_lines(predict(texts, load_model(root), ["doc_id", "dt"]))


@query("predict_file")
def predict_from_file(spark, sf):
    """Collected tweets from a CSV file to a result file."""
    root, _, _ = fitted(spark, sf)
    source, target = scratch_path(spark, "tweets"), scratch_path(spark, "results")
    rows = tweets(spark, sf).select(
        F.col("text").alias("tweet"),
        "datetime",
        *[(F.col("n_chars") % base).cast("int").alias(f"{name}_count") for name, base in (("replies", 7), ("retweets", 11), ("likes", 13))],
    )
    sinks.write_tweets(rows, source)
    predict_file(spark, source, target, root, multi_line=True)
    return spark.read.text(target)


@query("predict_file_differences", "SELECT count(*) AS lines, 0::BIGINT AS differences FROM documents")
def predict_file_differences(spark, sf):
    """Lines of a result file, and how many differ from scoring the table itself."""
    tagged = predict_from_file(spark, sf).withColumn("side", F.lit(1)).unionByName(predict_lines(spark, sf).select("value", F.lit(-1).alias("side")))
    return (
        tagged.groupBy("value")
        .agg(F.sum("side").alias("excess"), F.count_if(F.col("side") == 1).alias("lines"))
        .agg(F.coalesce(F.sum("lines"), F.lit(0)).alias("lines"), F.coalesce(F.sum(F.abs("excess")), F.lit(0)).alias("differences"))
    )


@query("train_unigrams")
def train_unigrams(spark, sf):
    """The second model: single words without stop words."""
    root = scratch_path(spark, "unigrams")
    settings = Settings(vocabulary_size=100_000)
    _, predicted = train_and_store(labelled(spark, sf), "doc_id", root, settings, "v1", unigram_stages(settings))
    return accuracy(predicted)


@query("train_raw_text")
def train_raw_text(spark, sf):
    """The model that reads the raw text, as the first training job does."""
    root = scratch_path(spark, "raw-text")
    settings = Settings(text_col="text")
    _, predicted = train_and_store(labelled(spark, sf), "doc_id", root, settings, "v2")
    return accuracy(predicted)


_STOP_WORDS_SQL = "['" + "', '".join(word.replace("'", "''") for word in STOP_WORDS) + "']"


@query(
    "unigram_vocabulary",
    f"""SELECT term FROM (SELECT unnest(list_filter({tokens_sql(clean_sql('text'))},
                                 lambda w: length(w) > 1 AND NOT list_contains({_STOP_WORDS_SQL}, w))) AS term
                      FROM {_part_sql('train')})
        GROUP BY term ORDER BY count(*) DESC, term LIMIT 100000""",
)
def unigram_vocabulary(spark, sf):
    """The terms of the second model, with the stop words of the second cleaner."""
    train, _ = stable_split(labelled(spark, sf), "doc_id")
    settings = Settings(vocabulary_size=100_000)
    return _terms_of(spark, fit(train, settings, unigram_stages(settings, STOP_WORDS)))


@query("split_random_parts", "SELECT doc_id, 1::BIGINT AS parts FROM labels")
def split_random_parts(spark, sf):
    """Every row falls into one part of the random split."""
    train, test = random_split(table(spark, sf, "labels"))
    return train.unionByName(test).groupBy("doc_id").agg(F.count(F.lit(1)).alias("parts"))


@query("split_random")
def split_random(spark, sf):
    train, test = random_split(table(spark, sf, "labels"))
    parts = train.withColumn("split", F.lit("train")).unionByName(test.withColumn("split", F.lit("test")))
    return parts.groupBy("split").count()


@query("analyse_jobs")
def analysed(spark, sf):
    """Every job from its phrase to its series, with the stored model."""
    root, _, _ = fitted(spark, sf)
    found = tweets(spark, sf).select("doc_id", "lang", "text", "datetime")
    return analyse_jobs(found, search_jobs(spark, sf), load_model(root).transform, ["doc_id"])


@query("predict_elsewhere", "SELECT doc_id, true AS same FROM documents")
def predicted_elsewhere(spark, sf):
    """Every document by a scorer outside Spark, and whether it says what the stored model says."""
    root, _, _ = fitted(spark, sf)
    path = scratch_path(spark, "weights")
    store_weights(spark, stored_weights(load_model(root)), path)
    cleaned = tweets(spark, sf).select("doc_id", clean_text(F.col("text")).alias("text"))
    found = score_elsewhere(cleaned, lambda: LinearScorer(path), "doc_id long, prediction double")
    own = predict(tweets(spark, sf), load_model(root), ["doc_id"]).withColumnRenamed("prediction", "expected")
    return own.join(found, "doc_id", "left").select("doc_id", F.col("prediction").eqNullSafe(F.col("expected")).alias("same"))
