"""Quality of predictions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def accuracy(df: DataFrame, label: str = "sentiment", prediction: str = "prediction") -> DataFrame:
    hit = (F.col(label) == F.col(prediction)).cast("double")
    return df.agg(F.avg(hit).alias("accuracy"))


def confusion(df: DataFrame, label: str = "sentiment", prediction: str = "prediction") -> DataFrame:
    """Long form: one row per label and prediction that occur together."""
    return df.groupBy(F.col(label).alias("label"), F.col(prediction).alias("prediction")).agg(
        F.count(F.lit(1)).alias("n")
    )


def confusion_matrix(df: DataFrame, classes: list[int], label: str = "sentiment", prediction: str = "prediction") -> DataFrame:
    """Matrix form: a row per label and a column per prediction, zero where nothing fell."""
    cells = [F.count_if(F.col(prediction) == value).alias(f"predicted_{value}") for value in classes]
    return df.groupBy(F.col(label).alias("label")).agg(*cells)


def class_report(df: DataFrame, label: str = "sentiment", prediction: str = "prediction") -> DataFrame:
    """Precision, recall, F1 and support per class, with macro and weighted means.

    A quotient with a zero denominator counts as 0.  Everything after the
    confusion counts works on a handful of rows.
    """
    hit = F.when(F.col("label") == F.col("prediction"), F.col("n")).otherwise(0)
    zero = F.lit(0).cast("bigint")
    as_label = F.struct(F.col("label").cast("double").alias("cls"), F.col("n").alias("support"), zero.alias("predicted"), hit.alias("hits"))
    as_prediction = F.struct(F.col("prediction").cast("double").alias("cls"), zero.alias("support"), F.col("n").alias("predicted"), zero.alias("hits"))
    per_class = (
        confusion(df, label, prediction)
        .select(F.inline(F.array(as_label, as_prediction)))
        .groupBy("cls")
        .agg(*[F.sum(name).alias(name) for name in ("support", "predicted", "hits")])
    )

    def ratio(top, bottom):
        return F.when(bottom == 0, 0.0).otherwise(top / bottom)

    rated = (
        per_class.withColumn("precision", ratio(F.col("hits"), F.col("predicted")))
        .withColumn("recall", ratio(F.col("hits"), F.col("support")))
        .withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))
    )
    rows = F.array(
        F.struct(F.col("cls").cast("int").cast("string").alias("class"), F.lit(1.0).alias("weight")),
        F.struct(F.lit("macro avg").alias("class"), F.lit(1.0).alias("weight")),
        F.struct(F.lit("weighted avg").alias("class"), F.col("support").cast("double").alias("weight")),
    )
    spread = rated.select("precision", "recall", "f1", "support", F.inline(rows))

    def mean(name: str):
        return (F.sum(F.col(name) * F.col("weight")) / F.sum("weight")).alias(name)

    return spread.groupBy("class").agg(mean("precision"), mean("recall"), mean("f1"), F.sum("support").alias("support"))
