import math
import random
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from moodtide.llm import hardnegatives
from moodtide.llm.queries import QUERIES

SCHEMA = "vec_id long, embedding array<double>, label int"


def plain(rows, every=100, positives=5, negatives=5, percent=80):
    """Every anchor against every row, by the definition."""
    taken = [
        (i, [math.floor(Fraction(x) * 256) for x in v], label)
        for i, v, label in rows
        if label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)
    ]

    def score(a, b):
        return sum(x * y for x, y in zip(a, b))

    def order(found):
        return sorted(found, key=lambda pair: (-pair[1], pair[0] is None, pair[0] or 0))

    out = []
    for at, (anchor, vector, label) in enumerate(taken):
        if anchor is None or anchor % every:
            continue
        scored = [(i, score(vector, v), other == label) for k, (i, v, other) in enumerate(taken) if k != at]
        for positive, goal in order([(i, s) for i, s, same in scored if same])[:positives]:
            window = [(i, s) for i, s, same in scored if not same and percent * goal <= 100 * s <= 100 * goal]
            for rank, (negative, found) in enumerate(order(window)[:negatives], 1):
                out.append((anchor, positive, rank, negative, goal, found))
    return sorted(out, key=repr)


def mined(spark, rows, **options):
    frame = spark.createDataFrame(rows, SCHEMA).repartition(3)
    return sorted((tuple(row) for row in hardnegatives.hard_negatives(frame, **options).collect()), key=repr)


def near_rows(seed, count, width=6, labels=3):
    """Rows around a few centres, so that the bounds exclude some."""
    rng = random.Random(seed)
    centres = [[rng.uniform(-1, 1) for _ in range(width)] for _ in range(4)]
    return [
        (i, [c + rng.gauss(0, 0.2) for c in rng.choice(centres)], rng.randrange(labels))
        for i in range(count)
    ]


def test_query_against_plain_search(spark, sf):
    rows = [
        (row["vec_id"], row["embedding"], (row["label"] + 1) % 10 if row["vec_id"] % 7 == 0 else row["label"])
        for row in spark.read.parquet(f"{sf}/embeddings.parquet").collect()
    ]
    found = sorted((tuple(row) for row in QUERIES["op13_spanning_tree_negatives"](spark, sf).collect()), key=repr)
    assert found == plain(rows)
    assert found


@pytest.mark.parametrize("block, group", [(3, 40), (50, 1000)])
def test_blocks_and_groups_do_not_matter(spark, block, group):
    rows = near_rows(5, 160)
    assert mined(spark, rows, every=10, block_anchors=block, group_rows=group) == plain(rows, every=10)


def test_nulls_ties_repeated_rows_and_odd_vectors(spark):
    rows = near_rows(8, 40)
    rows += [rows[0], rows[0], rows[20], (None, rows[0][1], 1), (None, rows[0][1], 0), (20, rows[3][1], 2)]
    rows += [(50, None, 1), (60, [0.5, None], 1), (70, [0.5, float("nan")], 1), (80, [float("inf")], 1), (90, [0.5], None)]
    rows += [(110, [], 0), (111, [0.5], 1), (112, [0.3, 0.1], 1), (None, None, None), (200, [1e11, -3e10, 1.0], 1), (201, [1e11], 0)]
    rows += [(None, None, 1)]
    assert mined(spark, rows, every=10) == plain(rows, every=10)


def test_huge_components_do_not_crash(spark):
    rows = [(100, [1e308, 1e300], 1), (101, [1e308], 1), (102, [1e307, -1e308], 0), (200, [1.0, 2.0], 1), (201, [1.0, 2.0], 0)]
    found = mined(spark, rows)
    assert found
    assert all(-(2**63) <= score < 2**63 for row in found for score in row[4:])


def test_nothing_to_search(spark):
    assert mined(spark, []) == []
    assert mined(spark, [(1, [0.5], 1), (2, [0.5], 0)]) == []
    assert mined(spark, [(100, [0.5], 1)]) == []


def test_extra_columns_and_other_names(spark):
    rows = near_rows(3, 60)
    frame = spark.createDataFrame(rows, SCHEMA).toDF("rank", "block", "group")
    frame = frame.withColumn("anchor", F.lit("x")).withColumn("id", F.lit(None).cast("string"))
    found = hardnegatives.hard_negatives(frame, "rank", "block", "group", every=10)
    assert sorted((tuple(row) for row in found.collect()), key=repr) == plain(rows, every=10)


def test_many_equal_vectors_are_spread(spark):
    rows = [(i, [0.5, 0.25], i % 2) for i in range(300)]
    assert mined(spark, rows, group_rows=50) == plain(rows)


def test_bounds_pass_over_rows():
    """With clustered rows most pairs are never scored, and what is found is the same."""
    rng = np.random.default_rng(1)
    centres = rng.standard_normal((8, 16)) * 4
    anchors = centres[np.arange(64) % 8] + rng.standard_normal((64, 16)) * 0.01
    rows = hardnegatives.Vectors(centres[np.arange(4000) % 8] + rng.standard_normal((4000, 16)) * 0.01)
    parent, edge = hardnegatives.spanning_tree(hardnegatives.Vectors(anchors))
    block = hardnegatives.Block(np.arange(64), np.zeros(64, int), anchors, parent, edge)
    exact = hardnegatives.products(block.vectors, np.arange(64), rows, np.arange(4000))
    low, high = np.quantile(exact, 0.90, axis=1), np.quantile(exact, 0.95, axis=1)
    at, row, scores, scored = block.in_windows(rows, np.arange(4000), np.ones((64, 4000), bool), low, high)
    wanted = (exact >= low[:, None]) & (exact <= high[:, None])
    assert {(int(a), int(r)) for a, r in zip(at, row)} == set(zip(*(side.tolist() for side in np.nonzero(wanted))))
    assert (scores == exact[at, row]).all()
    assert scored < 0.6 * exact.size


def test_tree_is_of_least_length():
    vectors = hardnegatives.Vectors(np.random.default_rng(2).standard_normal((30, 4)))
    parent, edge = hardnegatives.spanning_tree(vectors)
    apart = np.sqrt(((vectors.scaled[:, None] - vectors.scaled[None]) ** 2).sum(axis=2))
    pairs = sorted((apart[i, j], i, j) for i in range(30) for j in range(i))
    label, least = list(range(30)), 0.0
    for length, i, j in pairs:
        if label[i] != label[j]:
            least += length
            label = [label[j] if x == label[i] else x for x in label]
    assert edge.sum() == pytest.approx(least)
    assert sorted(np.concatenate(hardnegatives.levels(parent)).tolist()) == list(range(30))
