"""Counts of known runs of tokens as sparse vectors, many texts at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import DataFrame
from pyspark.sql.types import DoubleType, StructField, StructType

# Tokens that are looked up together, so that a task's memory does not follow its batches.
SLICE_TOKENS = 1 << 18

# Rows of `label_vectors` as written, and as the regression reads them: a vector is stored as such a struct.
STORED = "label double, features struct<type: tinyint, size: int, indices: array<int>, values: array<double>>"
VECTORS = StructType([StructField("label", DoubleType()), StructField("features", VectorUDT())])
_SPARSE = 0


class KnownRuns:
    """Places of the runs of a vocabulary, as a tree of tokens with one sorted array of keys per length.

    A key is the node of the run without its last token, and that token's number.
    """

    def __init__(self, terms: list[str], longest: int):
        numbers: dict[str, int] = {}
        # Tokens hold no spaces but may be empty, so a term is cut at every space.
        runs = [[numbers.setdefault(part, len(numbers)) for part in term.split(" ")] for term in terms]
        self.size, self.tokens = len(terms), list(numbers)
        sizes, places = np.array([len(run) for run in runs], np.int64), np.arange(len(terms))
        nodes = np.array([run[0] for run in runs], np.int64)
        self.first = self._ends(nodes[sizes == 1], places[sizes == 1], len(numbers))
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []
        for n in range(2, longest + 1):
            held = np.flatnonzero(sizes >= n)
            last = np.array([runs[at][n - 1] for at in held], np.int64)
            keys, found = np.unique(nodes[held] * len(numbers) + last, return_inverse=True)
            nodes[held] = found
            ended = sizes[held] == n
            self.levels.append((keys, self._ends(found[ended], held[ended], len(keys))))

    @staticmethod
    def _ends(nodes: np.ndarray, places: np.ndarray, size: int) -> np.ndarray:
        """Place of the term that ends at each node, -1 if none does."""
        out = np.full(size, -1, np.int64)
        out[nodes] = places
        return out

    def numbered(self, tokens: pa.Array) -> np.ndarray:
        """The number of each token, -1 for one in no term."""
        coded = tokens.dictionary_encode()
        known = pc.index_in(coded.dictionary, value_set=pa.array(self.tokens, tokens.type)).fill_null(-1).to_numpy(zero_copy_only=False)
        return known.astype(np.int64)[coded.indices.to_numpy(zero_copy_only=False)] if len(known) else np.zeros(0, np.int64)

    def found(self, tokens: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row and place of each known run of numbered tokens; no run goes on into the next row."""
        live = np.flatnonzero(tokens >= 0)
        nodes = tokens[live]
        hits = [(live, self.first[nodes])]
        for n, (keys, ends) in enumerate(self.levels, 2):
            inside = live + n - 1 < len(tokens)
            live, nodes = live[inside], nodes[inside]
            following = tokens[live + n - 1]
            inside = (following >= 0) & (rows[live + n - 1] == rows[live])
            live, wanted = live[inside], nodes[inside] * len(self.tokens) + following[inside]
            at = np.searchsorted(keys, wanted)
            hit = np.append(keys, -1)[at] == wanted
            live, nodes = live[hit], at[hit]
            hits.append((live, ends[nodes]))
        starts, places = (np.concatenate(parts) for parts in zip(*hits))
        ended = places >= 0
        return rows[starts[ended]], places[ended]

    def vectors(self, tokens: pa.ListArray) -> pa.StructArray:
        """One stored vector per list of tokens, with its places in order."""
        offsets = tokens.offsets.to_numpy()
        rows = np.repeat(np.arange(len(tokens)), np.diff(offsets))
        held, places = self.found(self.numbered(tokens.flatten()), rows)
        cells, counts = np.unique(held * max(self.size, 1) + places, return_counts=True)
        ends = np.concatenate([[0], np.cumsum(np.bincount(cells // max(self.size, 1), minlength=len(tokens)))]).astype(np.int32)
        indices = pa.ListArray.from_arrays(ends, pa.array((cells % max(self.size, 1)).astype(np.int32)))
        values = pa.ListArray.from_arrays(ends, pa.array(counts.astype(np.float64)))
        kind = pa.array(np.full(len(tokens), _SPARSE, np.int8))
        size = pa.array(np.full(len(tokens), self.size, np.int32))
        return pa.StructArray.from_arrays([kind, size, indices, values], ["type", "size", "indices", "values"])


def _slices(tokens: pa.ListArray) -> Iterator[tuple[int, int]]:
    """First row and number of rows of slices of some `SLICE_TOKENS` tokens, a row at least."""
    offsets, start = tokens.offsets.to_numpy(), 0
    while start < len(tokens):
        stop = max(int(np.searchsorted(offsets, offsets[start] + SLICE_TOKENS, "right")) - 1, start + 1)
        yield start, stop - start
        start = stop


def label_vectors(rows: DataFrame, tokens_col: str, terms: list[str], longest: int) -> DataFrame:
    """`label`, and the counts of the 1- to `longest`-grams of an array of tokens that are among `terms`, by their place there.

    The same as spelling out each run and counting the known ones, but nothing is spelled out.
    Tokens are not null.
    """
    known = KnownRuns(terms, longest)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, count in _slices(batch.column(1)):
                part = batch.slice(start, count)
                yield pa.RecordBatch.from_arrays([part.column(0), known.vectors(part.column(1))], ["label", "features"])

    return rows.select("label", tokens_col).mapInArrow(run, STORED)
