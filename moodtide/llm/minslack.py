"""Best-fit packing by minimum bin slack.

The fullest feasible combination of the lengths at hand is found by a bitset
subset-sum, taken out, and so on until nothing is left.  All that this needs is
how many pieces there are of each length, a table of at most `capacity` rows
whatever the data.  A combination is taken as often as its rarest length allows:
removing pieces never makes a fuller one possible, so each repetition is again the fullest.
Each combination brings some length below what it takes of it, which can happen to a
length l only about log2(capacity / l) times: the plan stays below some 2.5 x capacity
combinations whatever the data.

Pieces are numbered per length: inside each task while they are tokenized, then
shifted by what earlier tasks hold.  The number names the combination, its
repetition, and the place in the sequence.  No length, however common, is
ever gathered in one task.

Defined results: a null or empty text is the end id alone.  Repeated rows are
packed each for themselves.  An empty table gives no pieces.  Only the id and
the text are read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from moodtide.llm.registry import query
from moodtide.llm.scratch import stored
from moodtide.llm.tokens import CAPACITY, END_ID, document_pieces, tokenizer_path
from moodtide.sources.files import table


# -- plan ---------------------------------------------------------------------------------


@dataclass(frozen=True)
class Combination:
    """Lengths, longest first, with how often each stands in a sequence, and the number of sequences."""

    parts: tuple[tuple[int, int], ...]
    times: int


def combinations(counts: dict[int, int], capacity: int = CAPACITY) -> list[Combination]:
    """The fullest combination of what is left, again and again."""
    left = {length: count for length, count in sorted(counts.items()) if count > 0}
    if any(not 0 < length <= capacity for length in left):
        raise ValueError(f"lengths must lie between 1 and {capacity}")
    lengths = list(left)
    mask = (1 << (capacity + 1)) - 1
    # reach[k]: sums that the first k lengths can make; usable[k]: how many of length k count for that.
    reach = [1] * (len(lengths) + 1)
    usable = [0] * len(lengths)
    stale = 0
    out = []
    while True:
        for k in range(stale, len(lengths)):
            usable[k] = min(left[lengths[k]], capacity // lengths[k])
            reach[k + 1] = _extended(reach[k], lengths[k], usable[k], mask)
        rest = reach[-1].bit_length() - 1
        if rest == 0:
            return out
        parts = []
        for k in range(len(lengths) - 1, -1, -1):
            if rest == 0:
                break
            length = lengths[k]
            for used in range(min(usable[k], rest // length), -1, -1):
                if reach[k] >> (rest - used * length) & 1:
                    break
            if used:
                parts.append((length, used))
                rest -= used * length
        times = min(left[length] // used for length, used in parts)
        out.append(Combination(tuple(parts), times))
        stale = len(lengths)
        for length, used in parts:
            left[length] -= used * times
        for k, length in enumerate(lengths):
            if min(left[length], capacity // length) != usable[k]:
                stale = k
                break


def _extended(sums: int, length: int, count: int, mask: int) -> int:
    """The sums with up to `count` more of one length, by doubling."""
    step = 1
    while count > 0:
        take = min(step, count)
        sums |= (sums << (take * length)) & mask
        count -= take
        step *= 2
    return sums


class Layout:
    """Where the n-th piece of a length goes."""

    def __init__(self, plan: list[Combination]) -> None:
        rows: dict[int, list[tuple[int, int, int, int]]] = {}
        taken: dict[int, int] = {}
        sequence = 0
        for combination in plan:
            offset = 0
            for length, used in combination.parts:
                first = taken.get(length, 0)
                rows.setdefault(length, []).append((first, used, sequence, offset))
                taken[length] = first + used * combination.times
                offset += used * length
            sequence += combination.times
        self.rows = {length: np.array(own, np.int64) for length, own in rows.items()}
        self.sequences = sequence

    def places(self, length: int, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sequence and offset of the pieces of one length with these numbers."""
        rows = self.rows[length]
        row = rows[np.searchsorted(rows[:, 0], numbers, side="right") - 1]
        inside = numbers - row[:, 0]
        return row[:, 2] + inside // row[:, 1], row[:, 3] + inside % row[:, 1] * length


# -- pieces -------------------------------------------------------------------------------


def numbered_pieces(
    docs: DataFrame,
    tokenizer: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    capacity: int = CAPACITY,
    end_id: int = END_ID,
) -> DataFrame:
    """All pieces without their ids, numbered per task and length; to be stored, as a task's number is part of the rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, np.int64)
        for batch in batches:
            rows, places, starts, lengths, sums, numbers = [], [], [], [], [], []
            for row, text in enumerate(batch.column(1)):
                for start, ids in document_pieces(text.as_py(), tokenizer, capacity, end_id):
                    rows.append(row)
                    places.append(start // capacity)
                    starts.append(start)
                    lengths.append(len(ids))
                    sums.append(zlib.crc32(ids.tobytes()))
                    numbers.append(seen[len(ids)])
                    seen[len(ids)] += 1
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(rows, pa.int64())),
                    pa.array(places, pa.int32()),
                    pa.array(starts, pa.int64()),
                    pa.array(lengths, pa.int64()),
                    pa.array(sums, pa.int64()),
                    pa.array([task] * len(rows), pa.int32()),
                    pa.array(numbers, pa.int64()),
                ],
                names=["doc_id", "piece", "start", "length", "ids_crc32", "task", "number"],
            )

    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = slim.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, task int, number long"
    return slim.mapInArrow(run, schema)


def pack(
    docs: DataFrame,
    tokenizer: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    capacity: int = CAPACITY,
    end_id: int = END_ID,
) -> DataFrame:
    """One row per piece: `doc_id`, `piece`, `start`, `length`, `ids_crc32`, `sequence_id` and `offset`."""
    pieces = stored(numbered_pieces(docs, tokenizer, id_col, text_col, capacity, end_id), "pieces")
    per_task = pieces.groupBy("length", "task").agg(F.count(F.lit(1)).alias("held"))
    # At most one row per possible length.
    counts = {row["length"]: row["held"] for row in per_task.groupBy("length").agg(F.sum("held").alias("held")).collect()}
    layout = Layout(combinations(counts, capacity))
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    shifts = per_task.select("length", "task", F.coalesce(F.sum("held").over(before), F.lit(0)).alias("shift"))
    known = layout_broadcast(docs.sparkSession, layout)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths, numbers = batch.column(3).to_numpy(), batch.column(5).to_numpy()
            sequences, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
            for length in np.unique(lengths):
                own = lengths == length
                sequences[own], offsets[own] = known.value.places(int(length), numbers[own])
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:5], pa.array(sequences), pa.array(offsets)], names=[*batch.schema.names[:5], "sequence_id", "offset"]
            )

    joined = pieces.join(shifts, ["length", "task"]).select(
        "doc_id", "piece", "start", "length", "ids_crc32", (F.col("number") + F.col("shift")).alias("number")
    )
    kind = joined.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    return joined.mapInArrow(run, schema)


def layout_broadcast(spark: SparkSession, layout: Layout):
    """The size of a layout is bounded by the capacity: a few rows for each of at most 2.5 x capacity combinations."""
    return spark.sparkContext.broadcast(layout)


@query("op8_min_bin_slack")
def op8_min_bin_slack(spark: SparkSession, sf: str) -> DataFrame:
    return pack(table(spark, sf, "documents"), tokenizer_path())
