"""Pipeline stages of our own."""

from __future__ import annotations

from pyspark import keyword_only
from pyspark.ml import Transformer
from pyspark.ml.param.shared import HasInputCol, HasOutputCol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from moodtide.functions.cleaning import clean_text


class TextCleaner(Transformer, HasInputCol, HasOutputCol, DefaultParamsReadable, DefaultParamsWritable):
    """The first cleaner as a stage: a native expression, so batch and stream plans stay in the JVM."""

    @keyword_only
    def __init__(self, *, inputCol: str = "text", outputCol: str = "text_clean"):
        super().__init__()
        self._set(**self._input_kwargs)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return dataset.withColumn(self.getOutputCol(), clean_text(F.col(self.getInputCol())))
