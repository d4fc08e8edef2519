"""Substring deduplication: repeated word windows, found through difference-cover anchors.

Removed is every word inside a window of `size` words whose words also begin at
an earlier place: in a document with a smaller id, or earlier in the same one.

Only short windows at cover positions (place modulo the period) are hashed at
first.  For any two places some shift below the period moves both onto the
cover, so two equal long windows share an aligned anchor.  Whoever has an anchor
in common with somebody is extended: the full windows around its shared
anchors are hashed, and of each only the earliest place stays.

Hashes travel as blocks of sorted arrays, dealt by hash, and every batch sends each hash
once: a passage that a third of all documents hold is one entry per batch.
Nothing is compared pair by pair.  All judgements refer to the input, not to
what is left of it.

Defined results: a null or empty text has no words and loses none.  Rows with
the same id count as one document: of windows at the same place of equal rows none is
earlier than the other.  A null id is later than all others.  Extra
columns are not read by `repeated_ranges`, and pass through `remove_repeats`.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from moodtide.llm import wordarrays as wa
from moodtide.llm.names import fresh
from moodtide.llm.registry import query
from moodtide.sources.files import table

SIZE = 20
# A perfect difference cover: each difference modulo 13 occurs between two of the four.
PERIOD = 13
COVER = (0, 1, 3, 9)
# Blocks of hashes for each shuffle partition; a task of the next stage reads whole blocks.
BLOCKS_PER_PARTITION = 2

ANCHOR_BITS = np.uint64(0xFFFFFFFFFFFF0000)

# Stands for a null id.
LAST = np.iinfo(np.int64).max


def is_cover(cover: tuple[int, ...], period: int) -> bool:
    """Every difference modulo the period occurs."""
    return {(a - b) % period for a in cover for b in cover} == set(range(period))


# -- blocks of (hash, check, document, place) -----------------------------------------------

_ENTRY = np.dtype([("hash", "<u8"), ("check", "<u4"), ("doc", "<i8"), ("place", "<i4")])
BLOCK_SCHEMA = "block int, entries binary"


def _entries(hashes: np.ndarray, checks: np.ndarray, docs: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Entries by hash, and for equal windows by document and place."""
    out = np.empty(len(hashes), _ENTRY)
    out["hash"], out["check"], out["doc"], out["place"] = hashes, checks, docs, places
    return out[np.lexsort((places, docs, checks, hashes))]


def _runs(entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For sorted entries: whether each begins a run of equal windows, and the number of its run."""
    new = np.ones(len(entries), bool)
    new[1:] = (entries["hash"][1:] != entries["hash"][:-1]) | (entries["check"][1:] != entries["check"][:-1])
    return new, np.cumsum(new) - 1


def _packed(entries: np.ndarray) -> bytes:
    """Byte after byte of each column, so that the like bytes of ids and places meet for the shuffle's compression."""
    planes = [np.ascontiguousarray(entries[name]).view(np.uint8).reshape(len(entries), -1).T for name in _ENTRY.names]
    return b"".join(plane.tobytes() for plane in planes)


def _unpacked(data: bytes) -> np.ndarray:
    count = len(data) // _ENTRY.itemsize
    out, at = np.empty(count, _ENTRY), 0
    for name in _ENTRY.names:
        width = _ENTRY[name].itemsize
        planes = np.frombuffer(data, np.uint8, count * width, at).reshape(width, count)
        out[name] = np.ascontiguousarray(planes.T).view(_ENTRY[name]).reshape(count)
        at += width * count
    return out


def _dealt(entries: np.ndarray, bits: int) -> pa.RecordBatch:
    """Sorted entries as one row per block, which the first bits of the hash name."""
    block = (entries["hash"] >> np.uint64(64 - bits)).astype(np.int64)
    cuts = np.searchsorted(block, np.arange((1 << bits) + 1))
    used = np.flatnonzero(np.diff(cuts))
    return pa.RecordBatch.from_arrays(
        [pa.array(used, pa.int32()), pa.array([_packed(entries[cuts[b] : cuts[b + 1]]) for b in used], pa.binary())],
        names=["block", "entries"],
    )


# Places found, as parallel arrays of document ids (LAST for null) and places, dealt by document.
PLACES_SCHEMA = "block int, docs binary, places binary"
STREAM_SCHEMA = "block int, entries binary, docs binary, places binary"


def _planes(values: np.ndarray) -> bytes:
    return np.ascontiguousarray(values).view(np.uint8).reshape(len(values), -1).T.tobytes()


def _values(data: bytes, kind: str) -> np.ndarray:
    width = np.dtype(kind).itemsize
    planes = np.frombuffer(data, np.uint8).reshape(width, -1)
    return np.ascontiguousarray(planes.T).view(kind).reshape(-1)


def _by_document(docs: np.ndarray, places: np.ndarray, bits: int) -> pa.RecordBatch:
    """One row per block of documents, of which there are half as many as of hashes."""
    bits -= 1
    block = (wa.mixed(docs.astype("<i8").view(np.uint64)) >> np.uint64(64 - bits)).astype(np.int64)
    order = np.lexsort((places, docs, block))
    docs, places, block = docs[order].astype("<i8"), places[order].astype("<i4"), block[order]
    cuts = np.searchsorted(block, np.arange((1 << bits) + 1))
    used = np.flatnonzero(np.diff(cuts))
    ranges = [(cuts[number], cuts[number + 1]) for number in used]
    return pa.RecordBatch.from_arrays(
        [
            pa.array(used, pa.int32()),
            pa.array([_planes(docs[a:b]) for a, b in ranges], pa.binary()),
            pa.array([_planes(places[a:b]) for a, b in ranges], pa.binary()),
        ],
        names=["block", "docs", "places"],
    )


def _gathered_places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per document with all its places."""
    docs, places = [np.zeros(0, "<i8")], [np.zeros(0, "<i4")]
    for batch in batches:
        docs += [_values(data.as_buffer(), "<i8") for data in batch.column(1)]
        places += [_values(data.as_buffer(), "<i4") for data in batch.column(2)]
    docs, places = np.concatenate(docs), np.concatenate(places)
    order = np.lexsort((places, docs))
    docs, places = docs[order], places[order]
    starts = np.flatnonzero(np.diff(docs, prepend=docs[:1] - 1))
    for part in range(0, len(starts), 4096):
        cuts = [*starts[part : part + 4096].tolist(), starts[part + 4096] if part + 4096 < len(starts) else len(docs)]
        yield pa.RecordBatch.from_arrays(
            [pa.array(docs[cuts[:-1]]), pa.array([places[a:b].tobytes() for a, b in zip(cuts, cuts[1:])], pa.binary())],
            names=["doc", "places"],
        )


# -- stages -------------------------------------------------------------------------------


def _with_known(entries: np.ndarray, known: pa.RecordBatch, bits: int) -> Iterator[pa.RecordBatch]:
    """One stream of two kinds of rows: blocks of hashes to resolve, and places already settled."""
    dealt, names = _dealt(entries, bits), ["block", "entries", "docs", "places"]
    nothing = pa.nulls(dealt.num_rows, pa.binary())
    yield pa.RecordBatch.from_arrays([*dealt.columns, nothing, nothing], names=names)
    if known.num_rows:
        yield pa.RecordBatch.from_arrays([known.column(0), pa.nulls(known.num_rows, pa.binary()), *known.columns[1:]], names=names)


def _batch_ids(column: pa.Array) -> np.ndarray:
    return column.fill_null(LAST).to_numpy().astype(np.int64)


def _anchors(size: int, period: int, cover: tuple[int, ...], bits: int):
    """Hashes of the short windows at cover positions, each once per batch."""
    short = size - period + 1
    on_cover = np.zeros(period, bool)
    on_cover[list(cover)] = True

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, parts = _batch_ids(batch.column(0)), []
            for found in wa.words(batch.column(1), wa.NOT_SPACE):
                starts = wa.window_starts(found.first, short)
                document = found.document()[starts]
                places = starts - found.first[document]
                # Texts shorter than a whole window can hold no match.
                wanted = on_cover[places % period] & (found.counts()[document] >= size)
                starts, document, places = starts[wanted], document[wanted], places[wanted]
                # 48 bits suffice: a chance match only means that a few more windows are hashed.
                hashes = wa.window_hashes(wa.word_hashes(found), short)[starts] & ANCHOR_BITS
                parts.append((hashes, ids[found.rows.start + document], places))
            hashes, docs, places = (np.concatenate(part) if part else np.zeros(0, np.int64) for part in zip(*parts)) if parts else [np.zeros(0, np.int64)] * 3
            entries = _entries(hashes, np.zeros(len(hashes)), docs, places)
            new, number = _runs(entries)
            many = np.bincount(number, minlength=1)[number] > 1 if len(entries) else new
            yield from _with_known(entries[new], _by_document(entries["doc"][many], entries["place"][many], bits), bits)

    return run


def _shared(entries: np.ndarray) -> np.ndarray:
    """Which entries have a hash that came more than once."""
    _, number = _runs(entries)
    return np.bincount(number)[number] > 1


def _later(entries: np.ndarray) -> np.ndarray:
    """Which entries are not the earliest of their window."""
    return ~_earliest(entries)


def _earliest(entries: np.ndarray) -> np.ndarray:
    """Which sorted entries share document and place with the first of their run."""
    new, number = _runs(entries)
    first = np.flatnonzero(new)[number] if len(entries) else number
    return (entries["doc"] == entries["doc"][first]) & (entries["place"] == entries["place"][first])


def _resolver(wanted, bits: int):
    """Hand on settled places, and add those of the wanted entries of each block of hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[np.ndarray]] = {}
        for batch in batches:
            known = batch.column(2).is_valid()
            yield pa.RecordBatch.from_arrays([batch.column(place).filter(known) for place in (0, 2, 3)], names=["block", "docs", "places"])
            dealt = batch.column(1).is_valid()
            for block, data in zip(batch.column(0).filter(dealt).to_pylist(), batch.column(1).filter(dealt)):
                held.setdefault(block, []).append(_unpacked(data.as_buffer()))
        docs, places = [np.zeros(0, "<i8")], [np.zeros(0, "<i4")]
        while held:
            entries = np.concatenate(held.popitem()[1])
            entries = _entries(*(entries[name] for name in _ENTRY.names))
            chosen = wanted(entries)
            docs.append(entries["doc"][chosen])
            places.append(entries["place"][chosen])
        yield _by_document(np.concatenate(docs), np.concatenate(places), bits)

    return run


def _distinct(blob: bytes | None) -> np.ndarray:
    """The distinct places of one document."""
    return np.unique(np.frombuffer(blob or b"", "<i4")).astype(np.int64)


def _windows(size: int, period: int, bits: int):
    """Hashes of the full windows around shared anchors, each once per batch with its earliest place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, parts = _batch_ids(batch.column(0)), []
            for found in wa.words(batch.column(1), wa.NOT_SPACE):
                counts = found.counts()
                starts = []
                for doc, count in enumerate(counts.tolist()):
                    anchors = _distinct(batch.column(2)[found.rows.start + doc].as_py())
                    anchors = anchors[anchors < count]
                    # A window begins at most period - 1 words before its anchor.
                    reach = np.zeros(count + 1, np.int64)
                    np.add.at(reach, np.maximum(anchors - period + 1, 0), 1)
                    np.add.at(reach, anchors + 1, -1)
                    near = np.flatnonzero(np.cumsum(reach[:-1]) > 0)
                    starts.append(near[near <= count - size] + found.first[doc])
                starts = np.concatenate(starts) if starts else np.zeros(0, np.int64)
                if not len(starts):
                    continue
                document = found.document()[starts]
                hashes = wa.word_hashes(found)
                again = wa.window_hashes(wa.mixed(hashes + np.uint64(1)), size)[starts] >> np.uint64(32)
                parts.append((wa.window_hashes(hashes, size)[starts], again, ids[found.rows.start + document], starts - found.first[document]))
            columns = [np.concatenate(part) for part in zip(*parts)] if parts else [np.zeros(0, np.int64)] * 4
            entries = _entries(*columns)
            new, _ = _runs(entries)
            late = ~_earliest(entries)
            yield from _with_known(entries[new], _by_document(entries["doc"][late], entries["place"][late], bits), bits)

    return run


def _judged(size: int, text_at: int, places_at: int, carried: list[int], name: str = "judged"):
    """The carried columns, and for each text its words, removed ranges of words, and what is kept."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, n_removed, digests, ranges, texts = [], [], [], [], []
            for found in wa.words(batch.column(text_at), wa.NOT_SPACE):
                for doc, count in enumerate(found.counts().tolist()):
                    starts = _distinct(batch.column(places_at)[found.rows.start + doc].as_py())
                    gone = wa.covered(starts[starts < count], size, count)
                    lo, hi = int(found.first[doc]), int(found.first[doc]) + count
                    # bytes.split() cuts at the same characters.
                    words = found.data[found.starts[lo] : found.ends[hi - 1]].tobytes().split() if count else []
                    kept = b" ".join([word for word, out in zip(words, gone.tolist()) if not out] if len(starts) else words)
                    n_words.append(count)
                    n_removed.append(int(gone.sum()))
                    digests.append(hashlib.sha256(kept).hexdigest())
                    ranges.append(np.flatnonzero(np.diff(np.concatenate([[0], gone.view(np.int8), [0]]))).tolist() if n_removed[-1] else [])
                    texts.append(kept.decode() if n_removed[-1] else None)
            columns = [pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(digests, pa.string())]
            columns += [pa.array(ranges, pa.list_(pa.int32())), pa.array(texts, pa.string())]
            judged = pa.StructArray.from_arrays(columns, names=["n_words", "n_removed", "kept_sha256", "ranges", "kept_text"])
            names = [batch.schema.names[place] for place in carried]
            yield pa.RecordBatch.from_arrays([*[batch.column(place) for place in carried], judged], names=[*names, name])

    return run


JUDGED = "struct<n_words:bigint,n_removed:bigint,kept_sha256:string,ranges:array<int>,kept_text:string>"


def _resolved(rows: DataFrame, wanted, bits: int) -> DataFrame:
    """Deal blocks by hash, resolve them, and bring the places of each document together."""
    places = rows.repartition("block").mapInArrow(_resolver(wanted, bits), PLACES_SCHEMA)
    return places.repartition("block").mapInArrow(_gathered_places, "doc long, places binary")


def _block_bits(df: DataFrame) -> int:
    partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(4, (partitions * BLOCKS_PER_PARTITION - 1).bit_length())


def repeated_starts(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    size: int = SIZE,
    period: int = PERIOD,
    cover: tuple[int, ...] = COVER,
) -> DataFrame:
    """For each document with repeated windows: `doc`, and where they start as `places` (32-bit numbers)."""
    if not is_cover(cover, period) or period > size:
        raise ValueError("the cover must hold every difference modulo the period, which is at most the window")
    bits = _block_bits(docs)
    slim = docs.select(F.coalesce(F.col(id_col), F.lit(LAST)).cast("bigint").alias("doc"), F.col(text_col).alias("text"))
    anchors = slim.mapInArrow(_anchors(size, period, cover, bits), STREAM_SCHEMA)
    shared = _resolved(anchors, _shared, bits)
    # The texts are shuffled by document once; the last join, below, uses the same exchange.
    extended = slim.join(shared, "doc").mapInArrow(_windows(size, period, bits), STREAM_SCHEMA)
    return _resolved(extended, _later, bits)


def repeated_ranges(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **settings) -> DataFrame:
    """One row per document: `doc_id`, `n_words`, `n_removed`, `kept_sha256`, the removed `ranges` of words, and
    `kept_text` where words were removed."""
    slim = docs.select(F.coalesce(F.col(id_col), F.lit(LAST)).cast("bigint").alias("doc"), F.col(text_col).alias("text"))
    joined = slim.join(repeated_starts(docs, id_col, text_col, **settings), "doc", "left")
    judged = joined.mapInArrow(_judged(settings.get("size", SIZE), 1, 2, [0]), f"doc long, judged {JUDGED}")
    return judged.select(F.nullif(F.col("doc"), F.lit(LAST)).alias("doc_id"), "judged.*")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **settings) -> DataFrame:
    """The documents with repeated words cut out; a text that loses none is left as it is."""
    doc, places, judged = (fresh(docs.columns, name) for name in ("doc", "places", "judged"))
    starts = repeated_starts(docs, id_col, text_col, **settings).select(F.col("doc").alias(doc), F.col("places").alias(places))
    keyed = docs.withColumn(doc, F.coalesce(F.col(id_col), F.lit(LAST)).cast("bigint"))
    joined = keyed.join(starts, doc, "left").select(*[F.col(f"`{name}`") for name in docs.columns], F.col(places))
    carried = list(range(len(docs.columns)))
    schema = ", ".join(f"`{field.name}` {field.dataType.simpleString()}" for field in docs.schema)
    run = _judged(settings.get("size", SIZE), docs.columns.index(text_col), len(carried), carried, judged)
    out = joined.mapInArrow(run, f"{schema}, `{judged}` {JUDGED}")
    return out.withColumn(text_col, F.coalesce(F.col(judged)["kept_text"], F.col(text_col))).drop(judged)


SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
windows AS (
    SELECT doc_id, i, array_to_string(w[i:i + {SIZE - 1}], ' ') AS words
    FROM (SELECT doc_id, w, unnest(range(1, len(w) - {SIZE} + 2)) AS i FROM d)),
later AS (SELECT doc_id, i FROM windows QUALIFY row_number() OVER (PARTITION BY words ORDER BY doc_id, i) > 1),
removed AS (SELECT doc_id, list(DISTINCT spot) AS gone FROM (SELECT doc_id, unnest(range(i, i + {SIZE})) AS spot FROM later) GROUP BY doc_id),
marked AS (
    SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS spot, gone FROM d LEFT JOIN removed USING (doc_id)),
kept AS (
    SELECT doc_id, string_agg(word, ' ' ORDER BY spot) AS kept FROM marked
    WHERE gone IS NULL OR NOT list_contains(gone, spot) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(gone), 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN removed USING (doc_id) LEFT JOIN kept USING (doc_id)"""


@query("op4_difference_cover", SQL)
def op4_difference_cover(spark: SparkSession, sf: str) -> DataFrame:
    judged = repeated_ranges(table(spark, sf, "documents"))
    return judged.select("doc_id", "n_words", "n_removed", "kept_sha256")
