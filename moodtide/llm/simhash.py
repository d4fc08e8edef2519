"""SimHash near-duplicates: a byte-position inverted index with count filtering.

Two fingerprints that differ in at most 4 of 64 bits differ in at most 4 of
their 8 bytes, so they share at least 4 bytes at the same positions.  A posting
list of one positional byte would hold a 256th of all fingerprints, and its
pairs would grow with the square of the table.  Postings are therefore keyed by
three positional bytes at once, for 20 of the 56 triples of positions, chosen
so that any four positions include a chosen triple.  Inside a posting list the shared
positional bytes of each pair are tallied, pairs below the guaranteed four are
dropped, and the rest is verified bit by bit.

Only distinct fingerprints are indexed, so exact copies cost one row.  A posting
list gives a spanning forest of its links, never all pairs, and one of more
than `MAX_LIST` fingerprints is cut into blocks that are compared two by two in
separate tasks.  Components come from joins over written tables.

Defined results: a null, empty or blank text has fingerprint zero and is linked
like any other.  Fewer words than a shingle make one shingle.  Equal rows share
a component.  A null id never names a component unless all its ids are null.
Extra columns are not read by `fingerprints`, and pass through `keep_first`.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from moodtide.llm.components import connected
from moodtide.llm.names import fresh
from moodtide.llm.registry import query
from moodtide.llm.scratch import stored
from moodtide.sources.files import table

SHINGLE = 4
SEED = 42
MAX_DISTANCE = 4
BYTES = 8
MAX_LIST = 4096


# -- fingerprints -------------------------------------------------------------------------


def shingle_hashes(text: str, size: int = SHINGLE) -> list[int]:
    """XXH64 of each run of `size` lower-cased words, repeats included."""
    # For bytes, lower() and split() know ASCII letters and ASCII white space only.
    words = text.encode().lower().split()
    if not words:
        return []
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    last = max(len(words) - size + 1, 1)
    digest = xxhash.xxh64_intdigest
    return [digest(joined[a:b], SEED) for a, b in zip(starts[:last].tolist(), ends[-last:].tolist())]


def fingerprint(text: str | None, size: int = SHINGLE) -> int:
    """Bits set in more than half of the shingle hashes; zero without words."""
    hashes = np.array(shingle_hashes(text or "", size), "<u8")
    if not len(hashes):
        return 0
    counts = np.zeros(64, np.int64)
    for part in range(0, len(hashes), 1 << 14):
        bits = np.unpackbits(hashes[part : part + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE) -> DataFrame:
    """Id and fingerprint (as a signed long) of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = np.fromiter((fingerprint(text.as_py(), size) for text in batch.column(1)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints.view(np.int64))], names=["doc_id", "print"])

    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return slim.mapInArrow(run, f"doc_id {slim.schema['doc_id'].dataType.simpleString()}, print long")


# -- index --------------------------------------------------------------------------------


def cover_triples(count: int = BYTES) -> list[tuple[int, ...]]:
    """Triples of positions such that any four positions include one (20 for eight positions).

    Positions are dealt into three groups; a triple lies in one group, or has
    two of a group and one of the next.
    """
    group = [place * 3 // count for place in range(count)]
    chosen = []
    for triple in combinations(range(count), 3):
        held = [sum(group[place] == g for place in triple) for g in range(3)]
        if 3 in held or any(held[g] == 2 and held[(g + 1) % 3] == 1 for g in range(3)):
            chosen.append(triple)
    return chosen


def _byte(value: Column, place: int) -> Column:
    return F.shiftrightunsigned(value, 8 * place).bitwiseAND(F.lit(255))


def postings(prints: DataFrame) -> DataFrame:
    """One row per fingerprint and triple: the key has the triple's number and its three bytes."""
    keys = []
    for number, triple in enumerate(cover_triples()):
        key = F.lit(number).cast("bigint")
        for place in triple:
            key = key * 256 + _byte(F.col("print"), place)
        keys.append(key)
    return prints.select(F.explode(F.array(*keys)).alias("key"), F.lit(0).alias("block"), "print")


def _forest(values: np.ndarray, distance: int) -> Iterator[tuple[int, int]]:
    """Links that join each component of one posting list, found from the inside out."""
    left = values
    while len(left) > 1:
        reached, left = left[:1], left[1:]
        while len(reached) and len(left):
            here, reached = reached[0], reached[1:]
            differ = left ^ here
            shared = (differ.view(np.uint8).reshape(-1, BYTES) == 0).sum(axis=1)
            near = shared >= BYTES - distance
            near[near] = np.bitwise_count(differ[near]) <= distance
            if near.any():
                found = left[near]
                for value in found.tolist():
                    yield int(here), value
                reached = np.concatenate([reached, found])
                left = left[~near]


def _linker(distance: int):
    """Link the fingerprints of each (key, block) run of a sorted partition."""

    def pairs(keys: np.ndarray, blocks: np.ndarray, values: np.ndarray) -> tuple[list[int], list[int]]:
        new = np.flatnonzero((np.diff(keys) != 0) | (np.diff(blocks) != 0)) + 1
        starts, ends = np.concatenate([[0], new]), np.concatenate([new, [len(keys)]])
        sizes = ends - starts
        left, right = [], []
        # Lists of two, nearly all that matter, at once.
        twos = starts[sizes == 2]
        differ = values[twos] ^ values[twos + 1]
        shared = (differ.view(np.uint8).reshape(-1, BYTES) == 0).sum(axis=1)
        near = (shared >= BYTES - distance) & (np.bitwise_count(differ) <= distance)
        left += values[twos[near]].tolist()
        right += values[twos[near] + 1].tolist()
        for start, end in zip(starts[sizes > 2].tolist(), ends[sizes > 2].tolist()):
            for a, b in _forest(values[start:end], distance):
                left.append(a)
                right.append(b)
        return left, right

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # The last run of a batch may go on in the next one.
        held = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)]
        ended = False
        source = iter(batches)
        while not ended:
            batch = next(source, None)
            ended = batch is None
            if not ended:
                columns = [batch.column(0).to_numpy(), batch.column(1).to_numpy().astype(np.int64), batch.column(2).to_numpy().view(np.uint64)]
                held = [np.concatenate(both) for both in zip(held, columns)]
            if not len(held[0]):
                continue
            last = (held[0] == held[0][-1]) & (held[1] == held[1][-1])
            cut = len(last) if ended else int(np.argmax(last))
            ready, held = [part[:cut] for part in held], [part[cut:] for part in held]
            if len(ready[0]):
                left, right = pairs(*ready)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.array(side, np.uint64).view(np.int64)) for side in (left, right)], names=["a", "b"]
                )

    return run


def _linked(rows: DataFrame, distance: int) -> DataFrame:
    """Links inside the (key, block) lists of rows."""
    dealt = rows.repartition("key", "block").sortWithinPartitions("key", "block", "print")
    return dealt.mapInArrow(_linker(distance), "a long, b long")


def links(prints: DataFrame, distance: int = MAX_DISTANCE, max_list: int = MAX_LIST) -> DataFrame:
    """Pairs of distinct fingerprints, at most `distance` bits apart, that join every component.

    `prints` holds each fingerprint once.
    """
    if distance > 4:
        raise ValueError("the index guarantees four shared bytes, hence at most 4 differing bits")
    rows = postings(prints)
    counted = rows.groupBy("key").agg(F.count(F.lit(1)).alias("held"))
    # Few: each long list takes more than max_list of the rows.
    long_lists = stored(counted.where(F.col("held") > max_list), "long-lists")
    if long_lists.isEmpty():
        return _linked(rows, distance)
    short = rows.join(long_lists, "key", "left_anti")
    return _linked(short, distance).unionByName(_linked(_block_pairs(rows.join(long_lists, "key"), max_list // 2), distance))


def _block_pairs(rows: DataFrame, block: int) -> DataFrame:
    """Each row of a long list once per pair of blocks that includes its own."""
    count = F.ceil(F.col("held") / F.lit(block)).cast("int")
    own = F.pmod(F.xxhash64("print"), count).cast("int")
    numbered = rows.select("key", "print", count.alias("count"), own.alias("own"))
    spread = numbered.select("*", F.explode(F.sequence(F.lit(0), F.col("count") - 1)).alias("other"))
    pair = F.least("own", "other") * F.col("count") + F.greatest("own", "other")
    return spread.select("key", (pair + 1).cast("int").alias("block"), "print")


# -- components ---------------------------------------------------------------------------


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    size: int = SHINGLE,
    distance: int = MAX_DISTANCE,
    max_list: int = MAX_LIST,
) -> DataFrame:
    """One row per document: its id, its `print`, and `component_id`, the smallest id it is linked to."""
    prints = stored(fingerprints(docs, id_col, text_col, size), "fingerprints")
    nodes = stored(prints.groupBy("print").agg(F.min("doc_id").alias("first")), "nodes")
    edges = links(nodes.select("print"), distance, max_list)
    labels = connected(edges, "simhash")
    linked = labels.join(nodes.withColumnRenamed("print", "node"), "node")
    # Pre-aggregated per label before the join back, so a large component is no hot key.
    smallest = linked.groupBy("label").agg(F.min("first").alias("component_id"))
    moved = stored(labels.join(smallest, "label").select(F.col("node").alias("print"), "component_id"), "moved")
    component = nodes.join(moved, "print", "left").select("print", F.coalesce("component_id", "first").alias("component_id"))
    # Written, so that both sides of the last join are shuffled and AQE can split a print with many copies.
    return prints.join(stored(component, "components"), "print")


def keep_first(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    size: int = SHINGLE,
    distance: int = MAX_DISTANCE,
    max_list: int = MAX_LIST,
) -> DataFrame:
    """One document of each component, with all its columns: the one with the smallest id.

    Null ids come last.  Among rows with the same id, the one with the smallest
    hash of all columns is taken, and of wholly equal rows any.
    """
    row, print_col = fresh(docs.columns, "row"), fresh(docs.columns, "print")
    kinds = [F.col(f"`{name}`") for name in docs.columns]
    keyed = docs.withColumn(row, F.xxhash64(*kinds))
    key = F.struct(F.col(id_col).isNull().alias("unnamed"), F.col(id_col).alias("id"), F.col(row).alias("row"))
    slim = keyed.select(key.alias("doc_id"), F.col(text_col).alias("text"))
    found = near_duplicates(slim, "doc_id", "text", size, distance, max_list)
    first = found.select("component_id").distinct()
    wanted = first.select(F.col("component_id.id").alias(print_col), F.col("component_id.row").alias(row))
    same = keyed[id_col].eqNullSafe(wanted[print_col]) & (keyed[row] == wanted[row])
    # Equal rows survive the join together; one of them stays.
    return keyed.join(wanted, same, "left_semi").dropDuplicates([row, id_col]).drop(row)


def hexadecimal(print_col: Column) -> Column:
    return F.lower(F.lpad(F.hex(print_col), 16, "0"))


@query("op2_simhash_near_dedup")
def op2_simhash_near_dedup(spark: SparkSession, sf: str) -> DataFrame:
    found = near_duplicates(table(spark, sf, "documents"))
    return found.select("doc_id", hexadecimal(F.col("print")).alias("fingerprint"), "component_id")
