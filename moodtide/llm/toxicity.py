"""Toxicity: character n-gram embeddings averaged into a linear softmax, trained jointly in numpy.

A word's vector is the mean of the vectors of its character n-grams, and a text's
vector the mean over all its words, so an unseen misspelling is judged by the n-grams
it shares with known words.

The fit sees at most `TOXIC_ROWS` and `OTHER_ROWS` labelled documents, chosen by a
hash of their ids, with their whole texts.  Scores are computed for every text, in Arrow
batches.  Labels, language, source and id are no inputs of a score.

Defined results: a null or empty text gets the score of the bias alone.  Rows whose
label or id is null are not learned from; of several labels of one id the
highest counts.  Without labelled rows of both classes every score is the share
of toxic ones, or 0.  Repeated rows get equal scores.  Extra columns are not read.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from moodtide.llm.registry import query
from moodtide.sources.files import table

# Bound of the labelled rows used to fit.
TOXIC_ROWS = 3000
OTHER_ROWS = 6000

GRAMS = (3, 6)
BUCKETS = 1 << 18
DIMENSIONS = 8
STEPS = 150
RATE = 0.05
DECAY = 1e-4
# Means over hundreds of words are small numbers; this factor keeps the embeddings small too.
SCALE = 100.0
THRESHOLD = 0.7
# N-grams found in too few texts get no embedding, nor do those that say next to nothing of the
# classes.  Of a sample with twice as many other rows as toxic ones, four toxic texts and no other give 2.96.
LEAST_EVIDENCE = 2.9
LEAST_TEXTS = 5
# Inputs of n-grams with less evidence than this are made smaller, of those with more larger.
FULL_EVIDENCE = 4.0
# One text in so many of the sample is kept aside to choose the best step.
ASIDE = 5
_EDGES = ".,;:!?\"'()[]{}<>|#*$%&~`=+-_/\\"


def word_grams(word: str) -> list[int]:
    """Buckets of the character n-grams of a word in lower case, without outer punctuation, and of the whole word."""
    core = word.lower().strip(_EDGES)
    if not core:
        return []
    marked = f"<{core}>"
    data = marked.encode()
    low, high = GRAMS
    ranges = [(at, at + size) for size in range(low, min(high, len(marked)) + 1) for at in range(len(marked) - size + 1)]
    if len(data) == len(marked):
        parts = [data[a:b] for a, b in ranges]
    else:
        parts = [marked[a:b].encode() for a, b in ranges]
    return [zlib.crc32(part) & (BUCKETS - 1) for part in (*parts, b"=" + data)]


@dataclass
class Model:
    """Embeddings (buckets x dimensions), softmax weights (dimensions x 2) and biases."""

    embeddings: np.ndarray
    weights: np.ndarray
    bias: np.ndarray

    def margins(self) -> np.ndarray:
        """How far each bucket moves the toxic class ahead of the other."""
        return (self.embeddings @ (self.weights[:, 1] - self.weights[:, 0])).astype(np.float64)

    def prior(self) -> float:
        return float(self.bias[1] - self.bias[0])


@dataclass
class _Sample:
    """Labelled texts as a sparse matrix: what share of all n-grams of a text each chosen bucket has, times its size."""

    buckets: np.ndarray
    shares: np.ndarray
    texts: np.ndarray
    labels: np.ndarray
    sizes: np.ndarray


def _shares(
    text: str, known: dict[str, tuple[np.ndarray, int]], chosen: np.ndarray | None = None
) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of a text (only the chosen ones), and their shares in the mean over words of the means over n-grams."""
    counts = Counter(text.split())
    total = max(sum(counts.values()), 1)
    grams, weights = [], []
    for word, count in counts.items():
        if word not in known:
            own = np.array(word_grams(word), np.int32)
            known[word] = (own if chosen is None else own[chosen[own]], len(own))
        own, every = known[word]
        if len(own):
            grams.append(own)
            weights.append((len(own), count / total / every))
    if not grams:
        return np.zeros(0, np.int64), np.zeros(0)
    buckets, place = np.unique(np.concatenate(grams), return_inverse=True)
    lengths, values = zip(*weights)
    return buckets, np.bincount(place, np.repeat(values, lengths)) * SCALE


def _evidence(sums: np.ndarray, squares: np.ndarray, held: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """How surely the use of each bucket differs between the classes, in standard errors.

    The larger of two tests that suppose no difference: one of the mean shares, with the
    deviation over both classes, and the likelihood ratio of the numbers of texts, which
    holds for words of a few texts too.  `held` and `rows` are per class.
    """
    if not rows.all():
        return np.zeros(BUCKETS)
    total, both = rows.sum(), held.sum(axis=0)
    deviations = np.maximum(squares / total - (sums.sum(axis=0) / total) ** 2, 1e-12)
    of_means = np.abs(sums[1] / rows[1] - sums[0] / rows[0]) / np.sqrt(deviations * (1 / rows).sum())
    ratio = np.zeros(BUCKETS)
    for label in (0, 1):
        for found, expected in ((held[label], both), (rows[label] - held[label], total - both)):
            ratio += found * np.log(np.maximum(found, 1) / np.maximum(expected * rows[label] / total, 1e-9))
    return np.maximum(of_means, np.sqrt(np.maximum(2 * ratio, 0)))


def _sample(texts: list[str], labels: list[int]) -> _Sample:
    """Two passes: sums per class choose the buckets, then only these are kept."""
    known: dict[str, tuple[np.ndarray, int]] = {}
    sums, held, squares = np.zeros((2, BUCKETS)), np.zeros((2, BUCKETS)), np.zeros(BUCKETS)
    every = np.zeros(BUCKETS, np.int64)
    for number, (text, label) in enumerate(zip(texts, labels)):
        buckets, shares = _shares(text, known)
        every[buckets] += 1
        # The texts kept aside have no say, or the best step would be chosen by texts seen before.
        if number % ASIDE:
            # Square roots, lest a few very short texts decide.
            sums[label, buckets] += np.sqrt(shares)
            held[label, buckets] += 1
            squares[buckets] += shares
        if len(known) > Scorer.MAX_HELD:
            known.clear()
    rows = np.bincount([label for number, label in enumerate(labels) if number % ASIDE], minlength=2)
    evidence = _evidence(sums, squares, held, rows)
    chosen = (evidence >= LEAST_EVIDENCE) & (every >= LEAST_TEXTS)
    known, parts = {}, []
    for number, text in enumerate(texts):
        buckets, shares = _shares(text, known, chosen)
        parts.append((buckets, shares, np.full(len(buckets), number)))
        if len(known) > Scorer.MAX_HELD:
            known.clear()
    buckets, shares, numbers = (np.concatenate(column) for column in zip(*parts))
    sizes = (evidence / FULL_EVIDENCE) ** 2
    return _Sample(buckets, shares * sizes[buckets], numbers, np.array(labels), sizes)


class _Adam:
    def __init__(self, value: np.ndarray, rate: float) -> None:
        self.value, self.rate, self.step = value, rate, 0
        self.mean, self.square = np.zeros_like(value), np.zeros_like(value)

    def move(self, gradient: np.ndarray) -> None:
        self.step += 1
        self.mean += 0.1 * (gradient - self.mean)
        self.square += 0.001 * (gradient * gradient - self.square)
        self.value -= self.rate * (self.mean / (1 - 0.9**self.step)) / (np.sqrt(self.square / (1 - 0.999**self.step)) + 1e-8)


def fit(texts: list[str], labels: list[int], share: float, steps: int = STEPS, seed: int = 7) -> Model:
    """Fit embeddings and softmax together; `share` is that of toxic rows among all labelled ones.

    With two classes the gradient of a text's vector is its error times the
    difference of the two weight vectors, so one sum of errors per bucket
    serves the embeddings and the weights alike.
    """
    random = np.random.default_rng(seed)
    model = Model(
        random.normal(0, 0.05, (BUCKETS, DIMENSIONS)).astype(np.float32),
        random.normal(0, 0.5, (DIMENSIONS, 2)).astype(np.float32),
        np.array([0.0, np.log(max(share, 1e-6) / max(1 - share, 1e-6))], np.float32),
    )
    if len(set(labels)) < 2:
        model.embeddings[:] = 0
        return model
    data = _sample(texts, labels)
    # The sample holds more toxic rows than the table; weights go half of the way back.
    positive = data.labels.mean()
    row_weights = np.where(data.labels == 1, np.sqrt(share / positive), np.sqrt((1 - share) / (1 - positive))) / len(labels)
    used = np.unique(data.buckets)
    rest = np.ones(BUCKETS, bool)
    rest[used] = False
    model.embeddings[rest] = 0
    aside = np.arange(len(labels)) % ASIDE == 0
    best, best_loss = None, np.inf
    adams = [_Adam(model.embeddings, RATE), _Adam(model.weights, RATE), _Adam(model.bias, RATE)]
    for _ in range(steps):
        margin = np.bincount(data.texts, model.margins()[data.buckets] * data.shares, len(labels)) + model.prior()
        chance = 1 / (1 + np.exp(-np.clip(margin, -30, 30)))
        loss = -(row_weights * np.log(np.where(data.labels == 1, chance, 1 - chance)))[aside].sum()
        if loss < best_loss:
            best, best_loss = Model(model.embeddings.copy(), model.weights.copy(), model.bias.copy()), loss
        error = np.where(aside, 0, (chance - data.labels) * row_weights)
        by_bucket = np.bincount(data.buckets, error[data.texts] * data.shares, BUCKETS).astype(np.float32)
        sums = by_bucket[used] @ model.embeddings[used]
        embeddings = np.outer(by_bucket, model.weights[:, 1] - model.weights[:, 0])
        adams[0].move(embeddings + DECAY / len(labels) * model.embeddings)
        adams[1].move(np.stack([-sums, sums], axis=1).astype(np.float32))
        adams[2].move(np.array([-error.sum(), error.sum()], np.float32))
    # What was multiplied to the inputs belongs to the embeddings of a text as it is.
    best.embeddings *= data.sizes[:, None].astype(np.float32)
    return best


class Scorer:
    """Scores of whole texts; what a word adds is kept for the next time it comes."""

    MAX_HELD = 400_000

    def __init__(self, model: Model) -> None:
        self.margins, self.prior = model.margins().tolist(), model.prior()
        self.known: dict[str, float] = {}

    def _word(self, word: str) -> float:
        grams = word_grams(word)
        value = sum(map(self.margins.__getitem__, grams)) / max(len(grams), 1)
        if len(word) <= 64:
            if len(self.known) >= self.MAX_HELD:
                self.known.clear()
            self.known[word] = value
        return value

    def score(self, text: str | None) -> float:
        words = (text or "").split()
        known = self.known
        total = sum([known[word] if word in known else self._word(word) for word in words])
        margin = self.prior + SCALE * total / max(len(words), 1)
        return float(1 / (1 + np.exp(-min(max(margin, -30.0), 30.0))))


def labelled_sample(
    docs: DataFrame, labels: DataFrame, learn: Column, id_col: str, text_col: str, label_col: str,
    toxic_rows: int = TOXIC_ROWS, other_rows: int = OTHER_ROWS,
) -> tuple[list[str], list[int], float]:
    """Texts and labels of a bounded number of labelled rows, and the share of toxic rows among all of them."""
    known = (
        labels.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"))
        .dropna()
        .groupBy("id")
        .agg(F.max("label").cast("int").alias("label"))
        .where(learn)
    )
    held = {row["label"]: row["n"] for row in known.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    order = F.xxhash64("id"), F.col("id")
    chosen = known.where("label = 1").orderBy(*order).limit(toxic_rows).unionByName(known.where("label = 0").orderBy(*order).limit(other_rows))
    # At most toxic_rows + other_rows ids; of rows that share an id one is learned from.
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    found = texts.join(F.broadcast(chosen), "id").groupBy("id").agg(F.min(F.struct("label", "text")).alias("row"))
    rows = sorted((row["id"], row["row"]["text"], row["row"]["label"]) for row in found.collect())
    return [text for _, text, _ in rows], [label for _, _, label in rows], held.get(1, 0) / max(sum(held.values()), 1)


def score_texts(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Id and score of every row."""
    # The size of a model is fixed: buckets x dimensions numbers of four bytes.
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for batch in batches:
            scores = [scorer.score(text.as_py()) for text in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], names=["doc_id", "score"])

    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return slim.mapInArrow(run, f"doc_id {slim.schema['doc_id'].dataType.simpleString()}, score double")


def held_out(id_col: Column) -> Column:
    """The third of all ids that no label is learned from."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """One row per document: `doc_id`, `held_out`, `score` and `predicted`."""
    texts, known, share = labelled_sample(docs, labels, ~held_out(F.col("id")), id_col, text_col, label_col)
    scored = score_texts(docs, fit(texts, known, share), id_col, text_col)
    return scored.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted")
    )


@query("op6_subword_toxicity")
def op6_subword_toxicity(spark: SparkSession, sf: str) -> DataFrame:
    return toxicity(table(spark, sf, "documents"), table(spark, sf, "labels"))
