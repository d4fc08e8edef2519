"""Benchmark decontamination: word windows of test items, looked up in training texts.

The windows of the benchmark are hashed and broadcast, once their size has been
measured; training texts are scanned where they lie, so nothing is shuffled.  A
benchmark beyond the bound is split by hash into several sets, scanned one after
the other with the same result.  A hit on the hash counts only if the words are
the same.

Defined results: a null or empty text has no words and no hits.  A benchmark
item without words has no window; one with fewer words than a window is one
window of all its words.  An empty benchmark hits nothing.  Repeated rows get
equal results, repeated items count once.  Other columns pass through unchanged,
whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from moodtide.llm import wordarrays as wa
from moodtide.llm.names import fresh
from moodtide.llm.registry import query
from moodtide.sources.files import table

WINDOW = 13
# A document goes if this share of its words, or more, is hit.
CONTAMINATED_SHARE = 0.05
# Windows of one broadcast set, in bytes of text; held by the driver and by each Python worker.
MAX_SET_BYTES = 32 << 20

FOUND = "struct<n_words:bigint,n_hit:bigint,items:array<string>,ranges:array<int>>"
_FOUND_TYPE = pa.struct(
    [("n_words", pa.int64()), ("n_hit", pa.int64()), ("items", pa.list_(pa.string())), ("ranges", pa.list_(pa.int32()))]
)


def benchmark_windows(benchmark: DataFrame, size: int = WINDOW, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """Distinct windows of all items: hash, number of words, the words, and the ids of the items."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, hashes, lengths, windows = [], [], [], []
            for found in wa.words(batch.column(1), wa.LETTERS, lower=True):
                word_hashes = wa.word_hashes(found)
                counts = found.counts()
                for length in np.unique(np.minimum(counts, size)):
                    if length == 0:
                        continue
                    starts = wa.window_starts(found.first, int(length))
                    document = np.searchsorted(found.first, starts, side="right") - 1
                    fits = (counts[document] >= size) if length == size else (counts[document] == length)
                    window_hashes = wa.window_hashes(word_hashes, int(length))[starts]
                    for start, doc in zip(starts[fits].tolist(), document[fits].tolist()):
                        windows.append(found.joined(start, start + int(length)).decode())
                        ids.append(batch.column(0)[found.rows.start + doc].as_py())
                    hashes.append(window_hashes[fits].view(np.int64))
                    lengths += [int(length)] * int(fits.sum())
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate(hashes) if hashes else np.zeros(0, np.int64)),
                    pa.array(lengths, pa.int32()),
                    pa.array(windows, pa.string()),
                    pa.array(ids, pa.string()),
                ],
                names=["hash", "length", "words", "item"],
            )

    slim = benchmark.select(F.col(id_col).cast("string").alias("item"), F.col(text_col).alias("text"))
    rows = slim.mapInArrow(cut, "hash long, length int, words string, item string")
    return rows.groupBy("hash", "length", "words").agg(F.sort_array(F.collect_set("item")).alias("items"))


class WindowSet:
    """Windows to look for, by number of words."""

    def __init__(self, rows: list) -> None:
        self.by_length: dict[int, tuple[np.ndarray, np.ndarray, dict[int, list[tuple[bytes, list[str]]]]]] = {}
        for length in {row["length"] for row in rows}:
            known: dict[int, list[tuple[bytes, list[str]]]] = {}
            for row in rows:
                if row["length"] == length:
                    known.setdefault(row["hash"] % 2**64, []).append((row["words"].encode(), row["items"]))
            hashes = np.sort(np.fromiter(known, np.uint64, len(known)))
            seen = np.zeros(1 << 20, bool)
            seen[(hashes >> np.uint64(44)).astype(np.int64)] = True
            self.by_length[length] = (hashes, seen, known)

    def hits(self, found: wa.Words) -> Iterator[tuple[int, int, list[str]]]:
        """First word, number of words and item ids of each verified window."""
        word_hashes = wa.word_hashes(found)
        for length, (hashes, seen, known) in self.by_length.items():
            starts = wa.window_starts(found.first, length)
            values = wa.window_hashes(word_hashes, length)[starts]
            maybe = np.flatnonzero(seen[(values >> np.uint64(44)).astype(np.int64)])
            place = np.minimum(np.searchsorted(hashes, values[maybe]), len(hashes) - 1)
            maybe = maybe[hashes[place] == values[maybe]]
            for start, value in zip(starts[maybe].tolist(), values[maybe].tolist()):
                text = found.joined(start, start + length)
                for words, items in known[value]:
                    if words == text:
                        yield start, length, items


def _ranges(hit: np.ndarray) -> np.ndarray:
    """Starts and ends of the runs of hit words, in turn."""
    return np.flatnonzero(np.diff(np.concatenate([[0], hit.view(np.int8), [0]]))).astype(np.int32)


def _scan(text_at: int, found_at: int | None, found_name: str, sets):
    """Look for one set of windows and add what is found to what earlier sets have found."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows = sets.value
        for batch in batches:
            n_words, n_hit, items, ranges = [], [], [], []
            earlier = batch.column(found_at).to_pylist() if found_at is not None else [None] * batch.num_rows
            for found in wa.words(batch.column(text_at), wa.LETTERS, lower=True):
                hit = np.zeros(len(found.starts), bool)
                seen: dict[int, set[str]] = {}
                for start, length, names in windows.hits(found):
                    hit[start : start + length] = True
                    seen.setdefault(int(np.searchsorted(found.first, start, side="right")) - 1, set()).update(names)
                for doc in range(len(found.first) - 1):
                    lo, hi = found.first[doc], found.first[doc + 1]
                    own, before = hit[lo:hi], earlier[found.rows.start + doc]
                    names = seen.get(doc, set())
                    if before:
                        for begin, end in zip(before["ranges"][::2], before["ranges"][1::2]):
                            own[begin:end] = True
                        names = names | set(before["items"])
                    n_words.append(int(hi - lo))
                    n_hit.append(int(own.sum()))
                    items.append(sorted(names))
                    ranges.append(_ranges(own).tolist() if n_hit[-1] else [])
            out = pa.StructArray.from_arrays(
                [pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()), pa.array(items, pa.list_(pa.string())), pa.array(ranges, pa.list_(pa.int32()))],
                fields=list(_FOUND_TYPE),
            )
            kept = [batch.column(place) for place in range(batch.num_columns) if place != found_at]
            names = [name for place, name in enumerate(batch.schema.names) if place != found_at]
            yield pa.RecordBatch.from_arrays([*kept, out], names=[*names, found_name])

    return run


def scan(
    docs: DataFrame,
    benchmark: DataFrame,
    found_col: str = "found",
    text_col: str = "text",
    size: int = WINDOW,
    item_col: str = "item_id",
    item_text_col: str = "text",
    max_set_bytes: int = MAX_SET_BYTES,
) -> DataFrame:
    """All columns of `docs` and what was found in the text.

    `found_col` has the number of words, the number hit, the items whose
    windows occur, and the hit ranges of words as starts and ends in turn.
    """
    spark = docs.sparkSession
    windows = benchmark_windows(benchmark, size, item_col, item_text_col).persist()
    try:
        load = F.octet_length("words") + F.aggregate("items", F.lit(64), lambda total, item: total + 64 + F.octet_length(item))
        total = windows.agg(F.coalesce(F.sum(load.cast("bigint")), F.lit(0)).alias("bytes")).first()["bytes"]
        passes = max(1, -(-total // max_set_bytes))
        sets = []
        for number in range(passes):
            share = windows.where(F.pmod("hash", F.lit(passes)) == number)
            sets.append(spark.sparkContext.broadcast(WindowSet(share.collect())))
    finally:
        windows.unpersist()
    # The column of findings is added under a name that no input column has.
    inner = fresh(docs.columns, "found")
    out = docs
    for number, windows_set in enumerate(sets):
        columns = docs.columns + ([inner] if number else [])
        schema = ", ".join(f"`{field.name}` {field.dataType.simpleString()}" for field in docs.schema)
        at = columns.index(inner) if number else None
        out = out.select(*[F.col(f"`{name}`") for name in columns]).mapInArrow(
            _scan(columns.index(text_col), at, inner, windows_set), f"{schema}, `{inner}` {FOUND}" if schema else f"`{inner}` {FOUND}"
        )
    return out.withColumnRenamed(inner, found_col)


def is_contaminated(found: Column, share: float = CONTAMINATED_SHARE) -> Column:
    """Some word is hit, and the hit ones are at least the given share."""
    hit, words = found.getField("n_hit"), found.getField("n_words")
    return (hit > 0) & (hit * round(1 / share) >= words)


def without_ranges(text: Column, ranges: Column) -> Column:
    """The text without the hit words and the separators that follow each of them."""
    # One match is a word with what follows it; what stands before the first word is kept.
    word = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*"
    head = F.regexp_extract(text, r"^[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*", 0)
    parts = F.regexp_extract_all(text, F.lit(word), F.lit(0))
    borders = F.concat(F.array(F.lit(0)), ranges, F.array(F.size(parts)))
    # Ranges are few; the words between them are joined as slices.
    pieces = F.transform(
        F.sequence(F.lit(0), F.size(borders) - 1, F.lit(2)),
        lambda at: F.array_join(F.slice(parts, F.get(borders, at) + 1, F.get(borders, at + 1) - F.get(borders, at)), ""),
    )
    return F.when(F.size(ranges) > 0, F.concat(head, F.array_join(pieces, ""))).otherwise(text)


def decontaminate(
    docs: DataFrame,
    benchmark: DataFrame,
    remove: str = "documents",
    text_col: str = "text",
    size: int = WINDOW,
    share: float = CONTAMINATED_SHARE,
) -> DataFrame:
    """Without contaminated documents, or (remove="spans") with the hit words cut out of every text."""
    inner = fresh(docs.columns, "found")
    scanned = scan(docs, benchmark, inner, text_col, size)
    if remove == "documents":
        return scanned.where(~is_contaminated(F.col(inner), share)).drop(inner)
    if remove != "spans":
        raise ValueError(f"remove is documents or spans, not {remove}")
    return scanned.withColumn(text_col, without_ranges(F.col(text_col), F.col(inner)["ranges"])).drop(inner)


_WORD_SQL = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

SQL = f"""
WITH d AS (SELECT doc_id, coalesce({_WORD_SQL}, []) AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORD_SQL} AS w FROM benchmark),
windows AS (
    SELECT DISTINCT item, least(len(w), {WINDOW}) AS n,
           array_to_string(w[i:i + least(len(w), {WINDOW}) - 1], ' ') AS words
    FROM (SELECT item, w, unnest(range(1, len(w) - least(len(w), {WINDOW}) + 2)) AS i FROM b WHERE len(w) > 0)),
texts AS (
    SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS words
    FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i
          FROM d CROSS JOIN (SELECT DISTINCT n FROM windows) WHERE len(w) >= n)),
hits AS (SELECT doc_id, i, texts.n, item FROM texts JOIN windows USING (n, words)),
words_hit AS (
    SELECT doc_id, count(DISTINCT spot) AS n_hit
    FROM (SELECT doc_id, unnest(range(i, i + n)) AS spot FROM (SELECT DISTINCT doc_id, i, n FROM hits)) GROUP BY doc_id),
items AS (
    SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS listed
    FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(listed, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN words_hit USING (doc_id) LEFT JOIN items USING (doc_id)"""


@query("op3_ngram_decontamination", SQL)
def op3_ngram_decontamination(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text")
    scanned = scan(docs, table(spark, sf, "benchmark"))
    found = F.col("found")
    return scanned.select(
        "doc_id",
        "found.n_words",
        "found.n_hit",
        F.size("found.items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("found.items", ","), 256).alias("items_sha256"),
        is_contaminated(found).alias("contaminated"),
    )
