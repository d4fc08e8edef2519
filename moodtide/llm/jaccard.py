"""Similar documents by shared word n-grams: a prefix-tree join.

A document's set holds its distinct n-grams, as 64-bit hashes.  Two sets link when their shared
n-grams are at least `percent` of their union.  Sets that link share at least `percent` of
the larger one, so of any order of all n-grams, each has one of the shared n-grams
among its first `size - ceil(percent * size) + 1`, and k of them if k - 1 more are looked at.  That narrows the search twice, exactly:

1. By the order of the hashes, the first fifth and a tenth more are counted over the corpus.  A set of which too few
   of these occur in another set has no partner.
2. Of the sets left, n-grams found in one set only are taken away, and the rest is
   ordered by how many sets hold it, rarest first.  Sets that share one of their
   first n-grams in this order form a group; a passage that is common to many documents
   stands last and joins nobody.

Each group is stored as a tree of its sets, most frequent n-gram first, so that sets
share their beginnings.  A set is compared with all others by one walk: the overlap so far is carried
down the tree and shared by all sets below, and a branch is left when the
n-grams that remain on either side cannot reach the needed overlap.  Sets
found leave the tree and are walked next, so a class of n sets gives n - 1 links and never its pairs.
A group above `GROUP_GRAMS` n-grams is cut into blocks, compared two by two in separate tasks.

Equal sets are one node, and only nodes are searched; no list of partners or candidates is capped.

Defined results: a null, empty or blank text has an empty set and is linked with
nothing, so its class is its own id.  Fewer words than an n-gram make one n-gram.
Equal rows share a class.  A null id never names a class unless all its ids are null.
Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from moodtide.llm.components import connected
from moodtide.llm.registry import query
from moodtide.llm.scratch import stored
from moodtide.llm.wordarrays import NOT_SPACE, mixed, powers, window_hashes, word_hashes, words
from moodtide.operators.sizing import broadcast_if_small
from moodtide.sources.files import table

SHINGLE = 5
PERCENT = 80
GROUP_GRAMS = 2_000_000
# One in so many n-grams is looked at beside the guaranteed prefix.
MORE = 10
# Keys that are counted over the corpus are the first 48 bits of an n-gram; a clash only keeps a set that could go.
_KEY_SHIFT = 16
_SEEDS = (np.uint64(0xA0761D6478BD642F), np.uint64(0xE7037ED1A0B428DB))
_SHORT_BASE = np.uint64(0x8EBC6AF09C88C6E3)


# -- sets ---------------------------------------------------------------------------------


def _grams_of(found, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams of each text, sorted, and how many each text has."""
    hashes, counts, first = word_hashes(found), found.counts(), found.first
    windows = window_hashes(hashes, size)
    document = found.document()
    whole = np.zeros(len(hashes), bool)
    whole[: len(windows)] = document[: len(windows)] == document[size - 1 :] if len(windows) else False
    owner, grams = document[whole], windows[whole[: len(windows)]]
    short = np.flatnonzero((counts > 0) & (counts < size))
    if len(short):
        factors = powers(_SHORT_BASE, size)
        own = [(hashes[first[at] : first[at + 1]] * factors[: counts[at]]).sum(dtype=np.uint64) + np.uint64(counts[at]) for at in short]
        owner, grams = np.concatenate([owner, short]), np.concatenate([grams, mixed(np.array(own, np.uint64))])
    order = np.lexsort((grams, owner))
    owner, grams = owner[order], grams[order]
    new = np.ones(len(grams), bool)
    new[1:] = (np.diff(owner) != 0) | (grams[1:] != grams[:-1])
    return grams[new], np.bincount(owner[new], minlength=len(counts))


def needed(sizes: np.ndarray, percent: int) -> np.ndarray:
    """The least overlap of a set with any partner."""
    return -(-percent * sizes // 100)


def _segments(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sums of runs that begin at `starts`, empty ones too."""
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values, dtype=np.uint64)])
    return total[np.append(starts[1:], len(values))] - total[starts]


def _lists(values: np.ndarray, sizes: np.ndarray) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.view(np.int64)))


def _profiler(size: int, percent: int, whole: bool):
    """Per text: size and two checksums of its set, and the n-grams (`whole`) or the keys of its first ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for found in words(batch.column(1), NOT_SPACE, lower=True):
                grams, sizes = _grams_of(found, size)
                starts = np.cumsum(sizes) - sizes
                sums = [_segments(mixed(grams ^ seed), starts).view(np.int64) for seed in _SEEDS]
                if whole:
                    lists = _lists(grams, sizes)
                else:
                    looked = np.where(sizes > 0, sizes - needed(sizes, percent) + np.maximum(sizes // MORE, 1), 0)
                    place = np.arange(len(grams)) - np.repeat(starts, sizes)
                    lists = _lists(grams[place < np.repeat(looked, sizes)] >> np.uint64(_KEY_SHIFT), looked)
                ids = batch.column(0).slice(found.rows.start, len(found.rows))
                yield pa.RecordBatch.from_arrays([ids, pa.array(sizes), *map(pa.array, sums), lists], names=["id", "n", "a", "b", "grams"])

    return run


def _profiles(docs: DataFrame, size: int, percent: int, whole: bool) -> DataFrame:
    """`docs` has columns id, text."""
    kind = docs.schema["id"].dataType.simpleString()
    return docs.mapInArrow(_profiler(size, percent, whole), f"id {kind}, n long, a long, b long, grams array<long>")


# -- candidates ---------------------------------------------------------------------------


def _least_overlap(n: Column, percent: int) -> Column:
    return F.ceil(n * percent / 100)


def _shared(rows: DataFrame, key: str, label: str) -> DataFrame:
    """Keys that several rows have, with their number.  Written, so that AQE can split a hot key of the join that follows."""
    return stored(rows.groupBy(key).agg(F.count(F.lit(1)).alias("held")).where("held > 1"), label)


def _with_partners(first: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """Nodes of whose first n-grams enough occur in other sets."""
    rows = first.select("node", F.explode("grams").alias("key"))
    hits = rows.join(_shared(rows, "key", "first-keys").select("key"), "key").groupBy("node").agg(F.count(F.lit(1)).alias("hits"))
    # A partner has at least `percent` of this set's size, and looks at one in MORE of its own.
    enough = F.greatest(F.floor(_least_overlap(F.col("n"), percent) / MORE), F.lit(1))
    return nodes.join(hits, "node").where(F.col("hits") >= enough).select("node")


def _groups(sets: DataFrame, percent: int) -> DataFrame:
    """Nodes and the group in which they meet all their partners."""
    rows = sets.select("node", "n", F.explode("grams").alias("gram"))
    rows = rows.select("node", "n", F.shiftrightunsigned("gram", _KEY_SHIFT).alias("key"))
    counted = rows.join(_shared(rows, "key", "keys"), "key")
    held = counted.groupBy("node").agg(F.max("n").alias("n"), F.sort_array(F.collect_list(F.struct("held", "key"))).alias("keys"))
    spare = F.size("keys") - _least_overlap(F.col("n"), percent).cast("int") + 1
    rare = held.where(spare > 0).select("node", F.explode(F.slice("keys", F.lit(1), spare)).alias("one"))
    rare = stored(rare.select("node", "one.key"), "rarest")
    least = stored(rare.groupBy("key").agg(F.min("node").alias("other"), F.count(F.lit(1)).alias("held")).where("held > 1"), "rarest-held")
    edges = rare.join(least, "key").where("node <> other").select(F.col("node").alias("a"), F.col("other").alias("b")).distinct()
    return connected(edges, "groups")


# -- prefix tree --------------------------------------------------------------------------


class Tree:
    """Sets of ranks in a tree whose nodes hold runs of ranks; sets can be taken out.

    A node holds the ranks from its parent's depth to its own, as they stand in set `example`.
    """

    def __init__(self, sets: list[np.ndarray], percent: int):
        self.sets, self.percent = sets, percent
        self.depth, self.parent, self.example, self.leaf = [0], [-1], [-1], [-1]
        self.node_of = [0] * len(sets)
        # Big-endian bytes sort like the ranks.
        order = sorted(range(len(sets)), key=lambda at: sets[at].astype(">u4").tobytes())
        path, before = [0], -1
        for at in order:
            shared = self._common(sets[before], sets[at]) if before >= 0 else 0
            below = -1
            while self.depth[path[-1]] > shared:
                below = path.pop()
            if self.depth[path[-1]] < shared:
                # The run of the node below is cut in two.
                cut = self._add(shared, path[-1], before)
                self.parent[below] = cut
                path.append(cut)
            self.node_of[at] = self._add(len(sets[at]), path[-1], at, at)
            path.append(self.node_of[at])
            before = at
        count = len(self.depth)
        self.children = [[] for _ in range(count)]
        # Smallest and largest set, and number of sets, from each node down.
        self.least, self.most, self.alive = [1 << 60] * count, [0] * count, [0] * count
        for node in sorted(range(count), key=lambda node: -self.depth[node]):
            if self.leaf[node] >= 0:
                self.least[node] = min(self.least[node], self.depth[node])
                self.most[node] = max(self.most[node], self.depth[node])
                self.alive[node] += 1
            up = self.parent[node]
            if up >= 0:
                self.children[up].append(node)
                self.least[up] = min(self.least[up], self.least[node])
                self.most[up] = max(self.most[up], self.most[node])
                self.alive[up] += self.alive[node]
        highest = max((int(ranks[-1]) for ranks in sets if len(ranks)), default=-1)
        self.mark = np.zeros(highest + 1, bool)
        self.steps = 0

    @staticmethod
    def _common(a: np.ndarray, b: np.ndarray) -> int:
        length = min(len(a), len(b))
        differ = np.flatnonzero(a[:length] != b[:length])
        return int(differ[0]) if len(differ) else length

    def _add(self, depth: int, parent: int, example: int, leaf: int = -1) -> int:
        for values, value in ((self.depth, depth), (self.parent, parent), (self.example, example), (self.leaf, leaf)):
            values.append(value)
        return len(self.depth) - 1

    def remove(self, at: int) -> None:
        node = self.node_of[at]
        while node >= 0:
            self.alive[node] -= 1
            node = self.parent[node]

    def linked(self, at: int) -> list[int]:
        """Sets still in the tree that link with set `at`, which is not in it any more."""
        ranks, percent = self.sets[at], self.percent
        size = len(ranks)
        smallest, largest = -(-percent * size // 100), 100 * size // percent
        self.mark[ranks] = True
        found, open_nodes = [], [(0, 0)]
        while open_nodes:
            node, overlap = open_nodes.pop()
            for child in self.children[node]:
                least, most = max(self.least[child], smallest), min(self.most[child], largest)
                if not self.alive[child] or least > most:
                    continue
                self.steps += 1
                depth = self.depth[child]
                run = self.sets[self.example[child]][self.depth[node] : depth]
                shared = overlap + int(np.count_nonzero(self.mark[run]))
                # What is left of this set beyond the run, and the size with which that is used best.
                rest = size - int(np.searchsorted(ranks, run[-1], side="right"))
                best = min(max(depth + rest, least), most)
                if (100 + percent) * (shared + min(rest, best - depth)) < percent * (size + best):
                    continue
                other = self.leaf[child]
                if other >= 0 and 100 * shared >= percent * (size + depth - shared) and self.alive[child] > sum(
                    self.alive[below] for below in self.children[child]
                ):
                    found.append(other)
                open_nodes.append((child, shared))
        self.mark[ranks] = False
        return found


def forest(sets: list[np.ndarray], percent: int = PERCENT) -> list[tuple[int, int]]:
    """Links, as places in the list, that join each class of linked sets; sets are distinct arrays of n-grams."""
    values, place, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    # Most frequent first, so that sets share their beginnings.
    rank = np.empty(len(values), np.uint32)
    rank[np.lexsort((values, -counts))] = np.arange(len(values), dtype=np.uint32)
    ends = np.cumsum([len(one) for one in sets])
    tree = Tree([np.sort(one) for one in np.split(rank[place], ends[:-1])], percent)
    links, waiting, left = [], [], set(range(len(sets)))
    for start in range(len(sets)):
        if start not in left:
            continue
        left.discard(start)
        tree.remove(start)
        waiting.append(start)
        while waiting and left:
            at = waiting.pop()
            for other in tree.linked(at):
                links.append((at, other))
                left.discard(other)
                tree.remove(other)
                waiting.append(other)
        waiting.clear()
    return links


def _linker(percent: int):
    """Links of each (label, block) run of sorted rows: label, block, node, grams."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, nodes, sets = None, [], []

        def links() -> Iterator[pa.RecordBatch]:
            found = forest(sets, percent) if len(sets) > 1 else []
            if found:
                ends = [pa.array([nodes[pair[side]] for pair in found], pa.int64()) for side in (0, 1)]
                yield pa.RecordBatch.from_arrays(ends, names=["a", "b"])

        for batch in batches:
            grams = batch.column(3)
            for at, key in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())):
                if key != now:
                    yield from links()
                    now, nodes, sets = key, [], []
                nodes.append(batch.column(2)[at].as_py())
                sets.append(grams[at].values.to_numpy(zero_copy_only=False).view(np.uint64).copy())
        yield from links()

    return run


def _dealt(sets: DataFrame, groups: DataFrame, group_grams: int) -> DataFrame:
    """Sets by group; those of a large one once per pair of blocks that includes their own."""
    weights = groups.join(sets.select("node", "n"), "node").groupBy("label").agg(F.sum("n").alias("weight"))
    joined = groups.join(weights, "label")
    count = F.when(F.col("weight") <= group_grams, 1).otherwise(F.ceil(2 * F.col("weight") / group_grams)).cast("int")
    own = F.pmod(F.xxhash64("node"), count).cast("int")
    numbered = joined.select("label", "node", count.alias("count"), own.alias("own"))
    spread = numbered.select("*", F.explode(F.sequence(F.lit(0), F.col("count") - 1)).alias("other"))
    pair = F.least("own", "other").cast("bigint") * F.col("count") + F.greatest("own", "other")
    return spread.select("label", pair.alias("block"), "node").join(sets.select("node", "grams"), "node").select(
        "label", "block", "node", "grams"
    )


# -- classes ------------------------------------------------------------------------------


def similar_classes(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    size: int = SHINGLE,
    percent: int = PERCENT,
    group_grams: int = GROUP_GRAMS,
) -> DataFrame:
    """One row per document: its id, `n_shingles`, and `component_id`, the smallest id that links lead to."""
    if not 0 < percent <= 100:
        raise ValueError("percent is from 1 to 100")
    slim = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    profiles = stored(_profiles(slim, size, percent, False).withColumn("row", F.monotonically_increasing_id()), "profiles")
    filled = profiles.where("n > 0")
    # Equal sets are one node, named by one of their rows.
    nodes = stored(
        filled.groupBy("a", "b").agg(F.min("row").alias("node"), F.max("n").alias("n"), F.min("id").alias("first")), "nodes"
    )
    copies = stored(filled.select("row", "a", "b").join(nodes, ["a", "b"]).where("row <> node").select("row"), "copies")
    first = filled.select("row", "grams").join(broadcast_if_small(copies), "row", "left_anti").withColumnRenamed("row", "node")

    partnered = stored(_with_partners(first, nodes.select("node", "n"), percent), "partnered")
    chosen = stored(
        profiles.select("id", "a", "b", F.col("row").alias("node")).join(broadcast_if_small(partnered), "node"), "chosen"
    )
    ids = chosen.select(F.col("id").alias("chosen_id")).distinct()
    again = slim.join(broadcast_if_small(ids), F.col("id").eqNullSafe(F.col("chosen_id")), "left_semi")
    whole = _profiles(again, size, percent, True).groupBy("a", "b").agg(F.first("n").alias("n"), F.first("grams").alias("grams"))
    sets = stored(whole.join(chosen.select("a", "b", "node"), ["a", "b"]).select("node", "n", "grams"), "sets")

    dealt = _dealt(sets, _groups(sets, percent), group_grams)
    ordered = dealt.repartition("label", "block").sortWithinPartitions("label", "block", "node")
    labels = connected(ordered.mapInArrow(_linker(percent), "a long, b long"), "jaccard")

    smallest = labels.join(nodes, "node").groupBy("label").agg(F.min("first").alias("least"))
    moved = labels.join(smallest, "label").select("node", "least")
    classes = nodes.join(moved, "node", "left").select("a", "b", F.coalesce("least", "first").alias("component_id"))
    # Written, so that AQE can split a set with many copies.
    out = profiles.select("id", "n", "a", "b").join(stored(classes, "classes"), ["a", "b"], "left")
    alone = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id"))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), alone.alias("component_id"))


_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_SQL = rf"""
WITH RECURSIVE worded AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}'), '[^ 	-]+') AS w FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {SHINGLE} THEN [array_to_string(w, ' ')] ELSE
    list_distinct(list_transform(range(1, len(w) - {SHINGLE - 2}), lambda i: array_to_string(w[i:i + {SHINGLE - 1}], ' '))) END AS grams
  FROM worded
), held AS (
  SELECT doc_id, len(grams) AS n, unnest(grams) AS gram FROM sets
), pairs AS (
  SELECT x.doc_id AS a, y.doc_id AS b FROM held x JOIN held y ON x.gram = y.gram AND x.doc_id < y.doc_id
  GROUP BY x.doc_id, y.doc_id, x.n, y.n HAVING 100 * count(*) >= {PERCENT} * (x.n + y.n - count(*))
), reached AS (
  SELECT doc_id, doc_id AS other FROM sets
  UNION
  SELECT r.doc_id, e.b FROM reached r JOIN (SELECT a, b FROM pairs UNION ALL SELECT b, a FROM pairs) e ON r.other = e.a
)
SELECT s.doc_id, CAST(len(s.grams) AS BIGINT) AS n_shingles, min(r.other) AS component_id
FROM sets s JOIN reached r ON r.doc_id = s.doc_id GROUP BY s.doc_id, len(s.grams)
"""


@query("op11_prefix_tree_jaccard", _SQL)
def op11_prefix_tree_jaccard(spark: SparkSession, sf: str) -> DataFrame:
    return similar_classes(table(spark, sf, "documents"))
