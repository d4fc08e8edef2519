"""Hard negatives: bounds that travel along a spanning tree of the anchors.

The score of a row at an anchor is their inner product.  For two anchors a and
b and a row r, |<b, r> - <a, r>| is at most |b - a| * |r|, so a score known at
`a` gives an interval for the score at `b`.  Anchors are joined by a spanning
tree of least total edge length; each row is scored at the root, and
from there every child's interval comes from its parent's score or interval.
A child's score is computed only if that interval meets the window that is
searched at the child; all other rows are passed over unscored.

Anchors are put into blocks of at most `BLOCK_ANCHORS`, neighbours by the signs
of fixed projections together, each block with a tree of its own.  Rows are
dealt into groups of about `GROUP_ROWS` by their place in the input, never by
id, label or vector, so that no value makes a group large.  Every block is sent
to every group, where blocks pass one after the other: a task holds one group
and one block.  What leaves it are the few best rows per anchor.  The work is
rows times anchors at most, as the anchors are a stated query set; nothing is broadcast.

Defined results: rows with a null label, a null vector, or a null, NaN or
infinite component take no part.  A row without an id is no anchor, and comes
last among equal scores.  Repeated rows count each; an anchor repeated is an
anchor each time, and only one row that equals it is left out of its own
positives.  A vector shorter than others is continued by zeros.  Scores are
exact up to 2**53; larger ones are rounded to a double, and end where a long ends.  A
negative positive_score has an empty window.  Extra columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from moodtide.llm.registry import query
from moodtide.llm.scratch import stored
from moodtide.sources.files import table

SCALE = 256
EVERY = 100
POSITIVES = 5
NEGATIVES = 5
LOWEST_PERCENT = 80

BLOCK_ANCHORS = 8192
GROUP_ROWS = 65_536
TILE_PAIRS = 1 << 22
PROJECTIONS = 16
# Sums of products below these are exact in the floating types.
_EXACT32, _EXACT64 = 2.0**24, 2.0**53
_TAME = 2.0**26


# -- vectors ------------------------------------------------------------------------------


def usable(label: Column, vector: Column) -> Column:
    """Whether a row takes part."""
    whole = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return label.isNotNull() & vector.isNotNull() & whole


def _matrix(vectors: pa.Array) -> np.ndarray:
    """Vectors as rows of a matrix, short ones continued by zeros."""
    values = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    lengths = np.asarray(vectors.value_lengths().to_numpy(zero_copy_only=False), np.int64)
    width = int(lengths.max()) if len(lengths) else 0
    if (lengths == width).all():
        return values.reshape(len(lengths), width)
    out = np.zeros((len(lengths), width))
    out[np.arange(width) < lengths[:, None]] = values
    return out


def _same_width(*parts: np.ndarray) -> list[np.ndarray]:
    width = max(part.shape[1] for part in parts)
    return [np.pad(part, ((0, 0), (0, width - part.shape[1]))) for part in parts]


class Vectors:
    """Scaled whole-numbered components, norms, and exact inner products."""

    def __init__(self, raw: np.ndarray):
        with np.errstate(over="ignore"):
            self.scaled = np.floor(raw * SCALE)
            self.norms = np.sqrt((self.scaled * self.scaled).sum(axis=1))
        self.wild = np.flatnonzero(~(self.norms < _TAME))
        self.raw_wild = {int(at): raw[at].copy() for at in self.wild}
        self.scaled[self.wild] = 0
        self.longest = float(self.norms.max(initial=0, where=self.norms < _TAME))
        self.narrow = self.scaled.astype(np.float32)

    def __len__(self) -> int:
        return len(self.norms)

    def whole(self, at: int) -> list[int]:
        """Components as Python integers."""
        if at in self.raw_wild:
            return [math.floor(Fraction(float(x)) * SCALE) for x in self.raw_wild[at]]
        return [int(x) for x in self.scaled[at]]


def _long(value: int) -> int:
    return max(-(2**63), min(2**63 - 1, value))


def _product(a: Vectors, i: int, b: Vectors, j: int) -> float:
    return float(_long(sum(x * y for x, y in zip(a.whole(i), b.whole(j)))))


def products(a: Vectors, left: np.ndarray, b: Vectors, right: np.ndarray) -> np.ndarray:
    """Inner products of all of `left` (rows of a) with all of `right` (rows of b), exact."""
    small = a.longest * b.longest < _EXACT32
    x, y = (a.narrow, b.narrow) if small else (a.scaled, b.scaled)
    out = (x[left] @ y[right].T).astype(np.float64)
    for i in np.flatnonzero(np.isin(left, a.wild)) if len(a.wild) else ():
        out[i] = [_product(a, int(left[i]), b, int(j)) for j in right]
    for j in np.flatnonzero(np.isin(right, b.wild)) if len(b.wild) else ():
        out[:, j] = [_product(a, int(i), b, int(right[j])) for i in left]
    return out


def pair_products(a: Vectors, left: np.ndarray, b: Vectors, right: np.ndarray) -> np.ndarray:
    """The inner product of each left row with the right row at the same place, exact."""
    out = np.einsum("ij,ij->i", a.scaled[left], b.scaled[right])
    if len(a.wild) or len(b.wild):
        for at in np.flatnonzero(np.isin(left, a.wild) | np.isin(right, b.wild)):
            out[at] = _product(a, int(left[at]), b, int(right[at]))
    return out


# -- spanning tree ------------------------------------------------------------------------


def spanning_tree(anchors: Vectors) -> tuple[np.ndarray, np.ndarray]:
    """Parent (-1 for the root, which is row 0) and edge length of each anchor, total length being least."""
    count = len(anchors)
    parent, edge = np.full(count, -1, np.int32), np.zeros(count)
    squares = anchors.norms**2
    best, near = np.full(count, np.inf), np.zeros(count, np.int32)
    outside = np.ones(count, bool)
    here = 0
    for _ in range(count - 1):
        outside[here] = False
        with np.errstate(over="ignore", invalid="ignore"):
            apart = squares + squares[here] - 2 * (anchors.scaled @ anchors.scaled[here])
        # A wild anchor's distance is only known to be at most the sum of the norms.
        loose = ~np.isfinite(apart) | (anchors.norms >= _TAME) | (anchors.norms[here] >= _TAME)
        apart = np.where(loose, (anchors.norms + anchors.norms[here]) ** 2, np.maximum(apart, 0))
        closer = outside & (apart < best)
        best[closer], near[closer] = apart[closer], here
        here = int(np.argmin(np.where(outside, best, np.inf)))
        if not outside[here]:
            here = int(np.argmax(outside))
        parent[here], edge[here] = near[here], math.sqrt(best[here])
    return parent, edge


def levels(parent: np.ndarray) -> list[np.ndarray]:
    """Anchors by their distance, in edges, from the root."""
    depth = np.full(len(parent), -1)
    depth[parent < 0] = 0
    left = np.flatnonzero(depth < 0)
    while len(left):
        depth[left] = np.where(depth[parent[left]] >= 0, depth[parent[left]] + 1, -1)
        left = left[depth[left] < 0]
    order = np.argsort(depth, kind="stable")
    return np.split(order, np.flatnonzero(np.diff(depth[order])) + 1)


class Block:
    """Anchors with their tree."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, raw: np.ndarray, parent: np.ndarray, edge: np.ndarray):
        self.ids, self.labels, self.vectors = ids, labels, Vectors(raw)
        self.parent, self.edge = parent, edge
        self.levels = levels(parent)

    def __len__(self) -> int:
        return len(self.ids)

    def in_windows(
        self, rows: Vectors, tile: np.ndarray, allowed: np.ndarray, low: np.ndarray, high: np.ndarray
    ) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """Pairs of anchor and row (numbers) with a score from low to high of the anchor, their scores, and how many were scored.

        `allowed` tells for each anchor and row of the tile whether the pair matters at all.
        """
        norms, scored, found = rows.norms[tile], 0, []
        place = np.zeros(len(self), np.int64)
        for depth, level in enumerate(self.levels):
            place[level] = np.arange(len(level))
            may = allowed[level]
            if depth == 0:
                least = most = exact = products(self.vectors, level, rows, tile)
                scored += exact.size
                need = may
            else:
                up = place[self.parent[level]]
                with np.errstate(over="ignore", invalid="ignore"):
                    slack = self.edge[level][:, None] * norms[None, :] * (1 + 1e-9) + 1
                    # A bound that is no number bounds nothing.
                    least = np.nan_to_num(least[up] - slack, nan=-np.inf, posinf=np.inf, neginf=-np.inf)
                    most = np.nan_to_num(most[up] + slack, nan=np.inf, posinf=np.inf, neginf=-np.inf)
                need = may & (most >= low[level][:, None]) & (least <= high[level][:, None])
                i, j = np.nonzero(need)
                if len(i) * 8 > need.size:
                    # Most rows are needed by some anchor of the level: scored together.
                    columns = np.flatnonzero(need.any(axis=0))
                    exact = products(self.vectors, level, rows, tile[columns])
                    scored += exact.size
                    least[:, columns] = most[:, columns] = exact
                elif len(i):
                    least[i, j] = most[i, j] = pair_products(self.vectors, level[i], rows, tile[j])
                    scored += len(i)
            inside = need & (least >= low[level][:, None]) & (least <= high[level][:, None])
            i, j = np.nonzero(inside)
            found.append((level[i], tile[j], least[i, j]))
        return *(np.concatenate(part) for part in zip(*found)), scored


def _blocks(size: int):
    """Blocks of anchors, each with its tree, from a partition of anchors."""

    def one(ids, labels, vectors, number) -> pa.RecordBatch:
        raw = _matrix(vectors)
        parent, edge = spanning_tree(Vectors(raw))
        cells = {
            "block": pa.array([number], pa.int64()),
            "ids": pa.array([ids], pa.list_(pa.int64())),
            "labels": pa.array([labels], pa.list_(pa.int64())),
            "width": pa.array([raw.shape[1]], pa.int32()),
            "matrix": pa.array([raw.tobytes()], pa.binary()),
            "parent": pa.array([parent.tobytes()], pa.binary()),
            "edge": pa.array([edge.tobytes()], pa.binary()),
        }
        return pa.RecordBatch.from_pydict(cells)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, made, held = TaskContext.get().partitionId(), 0, None
        for batch in batches:
            held = pa.Table.from_batches([batch] if held is None else [*held.to_batches(), batch])
            while held.num_rows >= size:
                full, held = held.slice(0, size), held.slice(size)
                yield one(*_columns(full), (part << 32) + made)
                made += 1
        if held is not None and held.num_rows:
            yield one(*_columns(held), (part << 32) + made)

    return run


def _columns(rows: pa.Table) -> tuple[list, list, pa.Array]:
    vectors = rows.column("vector").combine_chunks()
    if isinstance(vectors, pa.ChunkedArray):
        vectors = pa.concat_arrays(vectors.chunks)
    return rows.column("id").to_pylist(), rows.column("label").to_pylist(), vectors


def _signs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the signs of fixed projections, so that neighbours come near each other."""
    for batch in batches:
        raw = _matrix(batch.column(2))
        axes = np.random.default_rng(17).standard_normal((PROJECTIONS, max(raw.shape[1], 1)))[:, : raw.shape[1]]
        with np.errstate(over="ignore", invalid="ignore"):
            code = ((raw @ axes.T) > 0) @ (1 << np.arange(PROJECTIONS)[::-1])
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(code, pa.int64())], names=[*batch.schema.names, "code"])


_BLOCK = "block long, ids array<long>, labels array<long>, width int, matrix binary, parent binary, edge binary"


def anchor_blocks(rows: DataFrame, every: int = EVERY, size: int = BLOCK_ANCHORS) -> tuple[DataFrame, int]:
    """Blocks of the rows whose `id` is divisible by `every`, as a written table, and the number of those rows."""
    anchors = rows.where(F.col("id") % every == 0)
    count = anchors.count()
    kind = rows.schema["vector"].dataType.simpleString()
    signed = anchors.select("id", "label", "vector").mapInArrow(_signs, f"id long, label long, vector {kind}, code long")
    # The running number splits a range of equal codes.
    dealt = signed.withColumn("at", F.monotonically_increasing_id())
    parts = max(1, -(-count // size))
    dealt = dealt.repartitionByRange(parts, "code", "at").sortWithinPartitions("code", "at")
    return stored(dealt.select("id", "label", "vector").mapInArrow(_blocks(size), _BLOCK), "anchor-blocks"), count


# -- search -------------------------------------------------------------------------------


def leading(anchors: np.ndarray, scores: np.ndarray, ids: np.ndarray, unnamed: np.ndarray, most: int) -> np.ndarray:
    """Places of the first `most` pairs of each anchor: highest score, then smallest id, null ids last."""
    order = np.lexsort((ids, unnamed, -scores, anchors))
    sorted_anchors = anchors[order]
    starts = np.flatnonzero(np.diff(sorted_anchors, prepend=-1))
    rank = np.arange(len(order)) - np.repeat(starts, np.diff(starts, append=len(order)))
    return order[rank < most]


class Group:
    """The rows of one group."""

    def __init__(self, ids: pa.Array, labels: pa.Array, raw: np.ndarray):
        self.unnamed = np.asarray(ids.is_null())
        self.ids = ids.fill_null(0).to_numpy(zero_copy_only=False)
        self.labels = labels.to_numpy(zero_copy_only=False)
        self.vectors = Vectors(raw)

    def tiles(self, anchors: int) -> Iterator[np.ndarray]:
        step = max(64, TILE_PAIRS // max(anchors, 1))
        for start in range(0, len(self.ids), step):
            yield np.arange(start, min(start + step, len(self.ids)))

    def best(self, anchors: np.ndarray, at: np.ndarray, scores: np.ndarray, most: int) -> tuple[np.ndarray, ...]:
        kept = leading(anchors, scores, self.ids[at], self.unnamed[at], most)
        return anchors[kept], at[kept], scores[kept]

    def closest(self, block: Block, most: int) -> tuple[np.ndarray, ...]:
        """The first `most` rows of each anchor's own label.

        The window of an anchor begins at the score of its last row so far, and so closes while tiles pass.
        """
        low, high = np.full(len(block), -np.inf), np.full(len(block), np.inf)
        have = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        for tile in self.tiles(len(block)):
            own = block.labels[:, None] == self.labels[tile][None, :]
            *found, _ = block.in_windows(self.vectors, tile, own, low, high)
            have = self.best(*(np.concatenate(both) for both in zip(have, found)), most)
            held = np.bincount(have[0], minlength=len(block))
            least = np.full(len(block), np.inf)
            np.minimum.at(least, have[0], have[2])
            low = np.where(held >= most, least, -np.inf)
        return have

    def between(self, block: Block, targets: np.ndarray, lowest_percent: int, most: int) -> Iterator[tuple]:
        """For each anchor and column of `targets` (positive scores, NaN if there is none), the first rows of other labels in its window.

        Windows reach from `lowest_percent` of the positive score to that score.
        """
        open_targets = np.where(targets >= 0, targets, np.nan)
        # Bounds of the pruning are a little wider than the windows, which are tested in whole numbers below.
        low = np.floor(np.nanmin(open_targets, axis=1, initial=np.inf) * (lowest_percent / 100) * (1 - 1e-9)) - 1
        high = np.nanmax(open_targets, axis=1, initial=-np.inf)
        have = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))] * targets.shape[1]
        for tile in self.tiles(len(block)):
            other = block.labels[:, None] != self.labels[tile][None, :]
            anchors, at, scores, _ = block.in_windows(self.vectors, tile, other, low, high)
            for number in range(targets.shape[1]):
                goal = open_targets[anchors, number]
                inside = (scores <= goal) & (lowest_percent * goal <= 100 * scores)
                found = anchors[inside], at[inside], scores[inside]
                have[number] = self.best(*(np.concatenate(both) for both in zip(have[number], found)), most)
        for number, (anchors, at, scores) in enumerate(have):
            yield anchors, np.full(len(anchors), number, np.int32), at, scores


def _searcher(search):
    """Runs `search(group, block, cells)` for each block that follows the rows of its group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, pieces, group = None, [], None
        for batch in batches:
            groups = batch.column("group").to_numpy()
            is_block = ~np.asarray(batch.column("block").is_null())
            # Runs of equal group and kind.
            new = np.flatnonzero((np.diff(groups) != 0) | (np.diff(is_block) != 0)) + 1
            for start, end in zip([0, *new], [*new, len(groups)]):
                if start == end:
                    continue
                if groups[start] != now:
                    now, pieces, group = groups[start], [], None
                part = batch.slice(start, end - start)
                if not is_block[start]:
                    pieces.append((part.column("id"), part.column("label"), _matrix(part.column("vector"))))
                    continue
                if not pieces:
                    continue
                if group is None:
                    ids, labels, raws = zip(*pieces)
                    group = Group(pa.concat_arrays(ids), pa.concat_arrays(labels), np.concatenate(_same_width(*raws)))
                    pieces = [None]
                for cells in part.to_pylist():
                    raw = np.frombuffer(cells["matrix"]).reshape(len(cells["ids"]), cells["width"])
                    if raw.shape[1] != group.vectors.scaled.shape[1]:
                        raw, group = _fitted(raw, group)
                    block = Block(
                        np.array(cells["ids"], np.int64), np.array(cells["labels"], np.int64), raw,
                        np.frombuffer(cells["parent"], np.int32), np.frombuffer(cells["edge"]),
                    )
                    for found in search(group, block, cells):
                        yield found

    return run


def _fitted(raw: np.ndarray, group: Group) -> tuple[np.ndarray, Group]:
    """Anchors and rows with equally many components."""
    width = max(raw.shape[1], group.vectors.scaled.shape[1])
    vectors = group.vectors
    vectors.scaled = np.pad(vectors.scaled, ((0, 0), (0, width - vectors.scaled.shape[1])))
    vectors.narrow = vectors.scaled.astype(np.float32)
    vectors.raw_wild = {at: np.pad(x, (0, width - len(x))) for at, x in vectors.raw_wild.items()}
    return np.pad(raw, ((0, 0), (0, width - raw.shape[1]))), group


def _ids(group: Group, at: np.ndarray) -> pa.Array:
    return pa.array(group.ids[at], pa.int64(), mask=group.unnamed[at])


def _scores(scores: np.ndarray) -> pa.Array:
    return pa.array([_long(int(x)) for x in scores], pa.int64())


def _find_positives(most: int):
    def search(group: Group, block: Block, cells: dict) -> Iterator[pa.RecordBatch]:
        # One more, as the anchor itself may be among them.
        anchors, at, scores = group.closest(block, most + 1)
        own = (group.ids[at] == block.ids[anchors]) & ~group.unnamed[at]
        for place in np.flatnonzero(own):
            own[place] = group.vectors.whole(int(at[place])) == block.vectors.whole(int(anchors[place]))
        yield pa.RecordBatch.from_pydict(
            {
                "block": pa.array(np.full(len(anchors), cells["block"]), pa.int64()),
                "anchor": pa.array(anchors, pa.int32()),
                "positive_id": _ids(group, at),
                "positive_score": _scores(scores),
                "own": pa.array(own),
            }
        )

    return search


def _find_negatives(most: int, lowest_percent: int):
    def search(group: Group, block: Block, cells: dict) -> Iterator[pa.RecordBatch]:
        wanted = cells["targets"] or []
        targets = np.full((len(block), max([one["number"] for one in wanted], default=0)), np.nan)
        for one in wanted:
            targets[one["anchor"], one["number"] - 1] = one["score"]
        for anchors, number, at, scores in group.between(block, targets, lowest_percent, most) if wanted else ():
            yield pa.RecordBatch.from_pydict(
                {
                    "block": pa.array(np.full(len(anchors), cells["block"]), pa.int64()),
                    "anchor": pa.array(anchors, pa.int32()),
                    "number": pa.array(number + 1, pa.int32()),
                    "negative_id": _ids(group, at),
                    "negative_score": _scores(scores),
                }
            )

    return search


def _met(rows: DataFrame, blocks: DataFrame, groups: int) -> DataFrame:
    """Rows by group, each group followed by all blocks."""
    place = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(groups)).cast("int")
    dealt = rows.select(place.alias("group"), "id", "label", "vector")
    sent = blocks.select(F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("group"), "*")
    both = dealt.unionByName(sent, allowMissingColumns=True)
    return both.repartition("group").sortWithinPartitions("group", F.asc_nulls_first("block"))


def _first(found: DataFrame, keys: list[str], score: str, name: str, most: int, rank: str) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.desc(score), F.asc_nulls_last(name))
    return found.withColumn(rank, F.row_number().over(order)).where(F.col(rank) <= most)


def hard_negatives(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    every: int = EVERY,
    positives: int = POSITIVES,
    negatives: int = NEGATIVES,
    lowest_percent: int = LOWEST_PERCENT,
    block_anchors: int = BLOCK_ANCHORS,
    group_rows: int = GROUP_ROWS,
) -> DataFrame:
    """For each anchor and each of its positives, the first negatives whose score is from `lowest_percent` % of the positive's to the positive's.

    Anchors are the rows with an id divisible by `every`; ids and labels are
    whole numbers.  Components are scaled by 256 and rounded down before scoring.
    """
    taken = vectors.where(usable(F.col(label_col), F.col(vector_col)))
    rows = taken.select(
        F.col(id_col).cast("bigint").alias("id"), F.col(label_col).cast("bigint").alias("label"), F.col(vector_col).alias("vector")
    )
    blocks, _ = anchor_blocks(rows, every, block_anchors)
    cores = vectors.sparkSession.sparkContext.defaultParallelism
    groups = max(-(-rows.count() // group_rows), 4 * cores)

    near = _met(rows, blocks, groups).mapInArrow(
        _searcher(_find_positives(positives)), "block long, anchor int, positive_id long, positive_score long, own boolean"
    )
    ranked = _first(near, ["block", "anchor"], "positive_score", "positive_id", positives + 1, "place")
    # One row that is the anchor goes; rows behind it move up.
    self_place = F.min(F.when(F.col("own"), F.col("place"))).over(Window.partitionBy("block", "anchor"))
    behind = ranked.withColumn("gone", self_place)
    number = F.col("place") - F.when(F.col("place") > F.col("gone"), 1).otherwise(0)
    kept = behind.where(~F.col("place").eqNullSafe(F.col("gone")))
    chosen = stored(
        kept.withColumn("number", number).where(F.col("number") <= positives).select("block", "anchor", "number", "positive_id", "positive_score"),
        "positives",
    )
    wanted = chosen.groupBy("block").agg(F.collect_list(F.struct("anchor", "number", F.col("positive_score").alias("score"))).alias("targets"))
    hard = _met(rows, blocks.join(wanted, "block"), groups).mapInArrow(
        _searcher(_find_negatives(negatives, lowest_percent)),
        "block long, anchor int, number int, negative_id long, negative_score long",
    )
    best = _first(hard, ["block", "anchor", "number"], "negative_score", "negative_id", negatives, "rank")
    names = blocks.select("block", F.posexplode("ids").alias("anchor", "anchor_id"))
    out = best.join(chosen, ["block", "anchor", "number"]).join(names, ["block", "anchor"])
    return out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


# The label of every seventh row is moved on before mining.
MOVED_EVERY = 7
LABELS = 10

_SQL = f"""
WITH moved AS (
  SELECT vec_id, CASE WHEN vec_id % {MOVED_EVERY} = 0 THEN (label + 1) % {LABELS} ELSE label END AS label, embedding
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scaled AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: floor({SCALE} * CAST(x AS DOUBLE))) AS v FROM moved
), scored AS (
  SELECT a.vec_id AS anchor_id, r.vec_id AS other_id, a.label = r.label AS same,
    CAST(list_dot_product(a.v, r.v) AS BIGINT) AS score
  FROM scaled a, scaled r
  WHERE a.vec_id % {EVERY} = 0 AND r.vec_id <> a.vec_id
), positives AS (
  SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= {POSITIVES}
)
SELECT p.anchor_id, p.positive_id,
  CAST(row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY n.score DESC, n.other_id) AS INTEGER) AS rank,
  n.other_id AS negative_id, p.positive_score, n.score AS negative_score
FROM positives p JOIN scored n ON n.anchor_id = p.anchor_id AND NOT n.same
WHERE {LOWEST_PERCENT} * p.positive_score <= 100 * n.score AND n.score <= p.positive_score
QUALIFY row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY n.score DESC, n.other_id) <= {NEGATIVES}
"""


@query("op13_spanning_tree_negatives", _SQL)
def op13_spanning_tree_negatives(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "embeddings")
    moved = F.when(F.col("vec_id") % MOVED_EVERY == 0, (F.col("label") + 1) % LABELS).otherwise(F.col("label"))
    return hard_negatives(rows.withColumn("label", moved))
