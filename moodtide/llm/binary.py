"""Token-id output: documents packed into fixed rows of ids, written as binary.

Each input task packs its own documents, block by block: a document longer than a
row is cut without loss, the pieces of a block are placed longest first into the
open row with the least room that suffices, and a segment tree over the amounts
of room finds that row.  Nothing is shuffled, and a repeated task gives the same rows.

A stored row is one row of the id matrix, filled up with the padding id, with
the running lengths of its segments (from 0 to the number of tokens) and the
offsets at which positions start again at 0.

Defined results: a null or empty text is the end id alone.  Repeated rows are
packed each for themselves.  An empty table gives an empty table.  Only the id
and the text are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from moodtide.llm.registry import query
from moodtide.llm.tokens import CAPACITY, END_ID, document_pieces, tokenizer_path
from moodtide.session import scratch_path
from moodtide.sources.files import table

# Tokens that one task holds at a time.
BLOCK_TOKENS = 2 << 20
# Ids below 65,536 take two bytes.
ID_TYPE = "<u2"
PADDING = 0


class RoomTree:
    """Counts of open rows by room, as a segment tree over 0 to capacity."""

    def __init__(self, capacity: int) -> None:
        self.leaves = 1 << capacity.bit_length()
        self.held = [0] * (2 * self.leaves)

    def change(self, room: int, by: int) -> None:
        node = self.leaves + room
        while node:
            self.held[node] += by
            node //= 2

    def least(self, room: int) -> int | None:
        """The smallest room held that is at least `room`."""
        node = self.leaves + room
        if not self.held[node]:
            # Up to the first ancestor with something on its right, and down again.
            while node > 1 and (node % 2 or not self.held[node + 1]):
                node //= 2
            if node <= 1:
                return None
            node += 1
            while node < self.leaves:
                node *= 2
                node += not self.held[node]
        return node - self.leaves


def best_fit_decreasing(lengths: list[int], capacity: int = CAPACITY) -> list[list[int]]:
    """Rows of piece numbers; equal lengths are placed in their order."""
    rows: list[list[int]] = []
    tree, by_room = RoomTree(capacity), {}
    for piece in sorted(range(len(lengths)), key=lambda piece: -lengths[piece]):
        length = lengths[piece]
        room = tree.least(length)
        if room is None:
            rows.append([])
            row, room = len(rows) - 1, capacity
        else:
            row = by_room[room].pop()
            tree.change(room, -1)
        rows[row].append(piece)
        by_room.setdefault(room - length, []).append(row)
        tree.change(room - length, 1)
    return rows


def _schema(id_kind: str) -> str:
    return (
        f"sequence_id long, ids binary, n_tokens int, cu_seqlens array<int>, position_resets array<int>, "
        f"doc_ids array<{id_kind}>, pieces array<int>, starts array<bigint>"
    )


def packed_rows(
    docs: DataFrame,
    tokenizer: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    capacity: int = CAPACITY,
    end_id: int = END_ID,
    block_tokens: int = BLOCK_TOKENS,
    id_type: str = ID_TYPE,
    padding: int = PADDING,
) -> DataFrame:
    """One row per sequence: `sequence_id`, `ids`, `n_tokens`, `cu_seqlens`, `position_resets`, and the document id,
    piece and start of each segment."""

    def block(task: int, first: int, pieces: list[tuple], id_pa: pa.DataType) -> pa.RecordBatch:
        rows = best_fit_decreasing([len(ids) for _, _, _, ids in pieces], capacity)
        matrix = np.full((len(rows), capacity), padding, id_type)
        borders = []
        for number, row in enumerate(rows):
            ids = np.concatenate([pieces[piece][3] for piece in row])
            if ids.max() > np.iinfo(id_type).max:
                raise ValueError(f"an id does not fit into {id_type}")
            matrix[number, : len(ids)] = ids
            borders.append([0, *np.cumsum([len(pieces[piece][3]) for piece in row]).tolist()])
        return pa.RecordBatch.from_arrays(
            [
                pa.array((np.int64(task) << 40) + first + np.arange(len(rows))),
                pa.array([row.tobytes() for row in matrix], pa.binary()),
                pa.array([border[-1] for border in borders], pa.int32()),
                pa.array(borders, pa.list_(pa.int32())),
                pa.array([border[:-1] for border in borders], pa.list_(pa.int32())),
                pa.array([[pieces[piece][0] for piece in row] for row in rows], pa.list_(id_pa)),
                pa.array([[pieces[piece][1] for piece in row] for row in rows], pa.list_(pa.int32())),
                pa.array([[pieces[piece][2] for piece in row] for row in rows], pa.list_(pa.int64())),
            ],
            names=["sequence_id", "ids", "n_tokens", "cu_seqlens", "position_resets", "doc_ids", "pieces", "starts"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, first, tokens, pieces, id_pa = TaskContext.get().partitionId(), 0, 0, [], pa.int64()
        for batch in batches:
            id_pa = batch.column(0).type
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                for place, (start, ids) in enumerate(document_pieces(text.as_py(), tokenizer, capacity, end_id)):
                    pieces.append((doc_id, place, start, ids))
                    tokens += len(ids)
                if tokens >= block_tokens:
                    out = block(task, first, pieces, id_pa)
                    yield out
                    first, tokens, pieces = first + out.num_rows, 0, []
        if pieces:
            yield block(task, first, pieces, id_pa)

    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return slim.mapInArrow(run, _schema(slim.schema["doc_id"].dataType.simpleString()))


def write_packed(docs: DataFrame, folder: str, tokenizer: str, **settings) -> None:
    """Write the rows as Parquet, from the tasks that made them."""
    packed_rows(docs, tokenizer, **settings).write.parquet(folder)


def read_packed(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(folder)


def segments(packed: DataFrame, id_bytes: int = np.dtype(ID_TYPE).itemsize) -> DataFrame:
    """One row per segment of stored rows, with its ids as cut out of the matrix."""
    listed = F.arrays_zip(F.col("doc_ids").alias("doc_id"), F.col("pieces").alias("piece"), F.col("starts").alias("start"))
    rows = packed.select("sequence_id", "ids", "cu_seqlens", F.posexplode(listed).alias("at", "segment"))
    begin, end = F.get("cu_seqlens", F.col("at")), F.get("cu_seqlens", F.col("at") + 1)
    return rows.select(
        F.col("segment.doc_id").alias("doc_id"),
        F.col("segment.piece").alias("piece"),
        F.col("segment.start").alias("start"),
        (end - begin).cast("bigint").alias("length"),
        F.substring("ids", begin * id_bytes + 1, (end - begin) * id_bytes).alias("ids"),
        "sequence_id",
        begin.cast("bigint").alias("offset"),
    )


@query("op7_best_fit_decreasing")
def op7_best_fit_decreasing(spark: SparkSession, sf: str) -> DataFrame:
    """Writes the packed rows, reads them back, and gives each segment with the checksum of its stored ids."""
    folder = scratch_path(spark, "packed-ids")
    write_packed(table(spark, sf, "documents"), folder, tokenizer_path())
    found = segments(read_packed(spark, folder))
    return found.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "sequence_id", "offset")
