"""A scorer outside Spark: numpy weights and a vocabulary, loaded once per task."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyarrow import dataset
from pyspark.sql import DataFrame, SparkSession

from moodtide.plans.optimality import INTERCEPT
from moodtide.sources.objects import opened

Batches = Iterator[pd.DataFrame]

# Texts whose runs are looked up together.
SLICE = 256


def store_weights(spark: SparkSession, weights: list[tuple[str, float]], path: str) -> None:
    """Terms and weights as a table that any engine reads."""
    spark.createDataFrame(weights, "term string, weight double").coalesce(1).write.mode("overwrite").parquet(path)


class LinearScorer:
    """Sentiment 0 or 4 of cleaned texts, by the weights of their 1- to `longest`-grams.

    Terms are a tree of tokens, one sorted array of keys per length; a key is the place of the run without its last
    token, and that token's. All runs of many texts are looked up at once, and no run is spelled out.
    """

    def __init__(self, path: str, longest: int = 3):
        store, folder = opened(path)
        table = dataset.dataset(folder, filesystem=store, format="parquet").to_table()
        known = dict(zip(table.column("term").to_pylist(), table.column("weight").to_pylist()))
        self.intercept = float(known.pop(INTERCEPT))
        terms = [(parts, weight) for parts, weight in ((term.split(" "), weight) for term, weight in known.items()) if len(parts) <= longest]
        self.tokens: dict[str, int] = {}
        runs = [[self.tokens.setdefault(part, len(self.tokens)) for part in parts] for parts, _ in terms]
        sizes = np.array([len(run) for run in runs], np.int64)
        weights = np.array([weight for _, weight in terms], np.float64)
        nodes = np.array([run[0] for run in runs], np.int64)
        self.first = _by_place(nodes[sizes == 1], weights[sizes == 1], len(self.tokens))
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []
        for n in range(2, longest + 1):
            held = np.flatnonzero(sizes >= n)
            keys = nodes[held] * len(self.tokens) + np.array([runs[at][n - 1] for at in held], np.int64)
            level, places = np.unique(keys, return_inverse=True)
            nodes[held] = places
            ended = sizes[held] == n
            self.levels.append((level, _by_place(places[ended], weights[held[ended]], len(level))))

    def margins(self, texts: list[str]) -> np.ndarray:
        find, places, ends = self.tokens.get, [], [0]
        for text in texts:
            places += [find(token, -1) for token in text.split(" ")]
            # No run goes on into the next text.
            places.append(-1)
            ends.append(len(places))
        tokens = np.array(places, np.int64)
        total, nodes = self.first[tokens], tokens
        for n, (level, weights) in enumerate(self.levels, 2):
            following = tokens[n - 1 :]
            nodes = nodes[: len(following)]
            live = np.flatnonzero((nodes >= 0) & (following >= 0))
            wanted = nodes[live] * len(self.tokens) + following[live]
            at = np.searchsorted(level, wanted)
            hit = np.append(level, -1)[at] == wanted
            nodes = np.full(len(following), -1)
            nodes[live[hit]] = at[hit]
            total[: len(nodes)] += weights[nodes]
        return self.intercept + np.add.reduceat(total, ends[:-1]) if texts else np.zeros(0)

    def margin(self, text: str) -> float:
        return float(self.margins([text])[0])

    def __call__(self, batch: pd.DataFrame) -> Batches:
        """One row per text; none for a row without a text."""
        kept = batch[batch["text"].notna()]
        texts = kept["text"].tolist()
        margins = [self.margins(texts[at : at + SLICE]) for at in range(0, len(texts), SLICE)]
        scores = np.where(np.concatenate([np.zeros(0), *margins]) > 0, 4.0, 0.0)
        yield kept.drop(columns="text").assign(prediction=scores)


def _by_place(places: np.ndarray, weights: np.ndarray, size: int) -> np.ndarray:
    """Weights by place, 0 where no term ends; the last element stands for place -1."""
    out = np.zeros(size + 1)
    out[places] = weights
    return out


def score_elsewhere(rows: DataFrame, setup: Callable[[], Callable[[pd.DataFrame], Batches]], schema: str) -> DataFrame:
    """Rows of a foreign scorer, which may give any number of rows for a batch.

    `setup` runs once per task, when its first rows are there, and returns the scorer.
    """

    def run(batches: Batches) -> Batches:
        scorer = None
        for batch in batches:
            scorer = scorer or setup()
            yield from scorer(batch)

    return rows.mapInPandas(run, schema)
