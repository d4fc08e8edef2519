import random
import re
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from moodtide.llm import jaccard
from moodtide.llm.queries import QUERIES
from tests.llm.conftest import documents


def plain_set(text, size=5):
    lowered = re.sub("[A-Z]", lambda found: found[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    if not words:
        return set()
    return {tuple(words[i : i + size]) for i in range(max(len(words) - size + 1, 1))}


def plain_classes(sets, percent=80):
    """Smallest key reachable by links, from all pairs."""
    label = {key: key for key in sets}

    def root(key):
        while label[key] != key:
            key = label[key]
        return key

    for a, b in combinations(sorted(sets), 2):
        shared = len(sets[a] & sets[b])
        if shared and 100 * shared >= percent * len(sets[a] | sets[b]):
            x, y = sorted((root(a), root(b)))
            label[y] = x
    return {key: root(key) for key in sets}


def found(frame, **options):
    return sorted((tuple(row) for row in jaccard.similar_classes(frame, **options).collect()), key=repr)


def expected(rows, percent=80, size=5):
    sets = {doc_id: plain_set(text, size) for doc_id, text in rows}
    classes = plain_classes(sets, percent)
    return sorted(((doc_id, len(sets[doc_id]), classes[doc_id]) for doc_id, _ in rows), key=repr)


def edited_rows(seed, originals=12, versions=8, passage=True):
    """Texts with versions that differ in a few words, and a passage that most of them hold."""
    rng = random.Random(seed)
    common = " ".join(f"law{i}" for i in range(60))
    rows = []
    for original in range(originals):
        words = [f"w{rng.randrange(4000)}" for _ in range(rng.randint(8, 150))]
        for _ in range(versions):
            own = list(words)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3, 6])):
                own[rng.randrange(len(own))] = f"x{rng.randrange(9000)}"
            text = " ".join(own)
            rows.append(text + " " + common if passage and original % 2 else text)
    rng.shuffle(rows)
    return list(enumerate(rows))


def test_query_against_all_pairs(spark, sf):
    rows = documents(spark, sf)
    result = QUERIES["op11_prefix_tree_jaccard"](spark, sf)
    assert result.columns == ["doc_id", "n_shingles", "component_id"]
    assert sorted((tuple(row) for row in result.collect()), key=repr) == expected(rows)


@pytest.mark.parametrize("percent, size, grams", [(80, 5, 2_000_000), (80, 5, 300), (50, 3, 2_000_000), (100, 2, 500)])
def test_edited_texts(spark, percent, size, grams):
    rows = edited_rows(percent + size)
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert found(frame, percent=percent, size=size, group_grams=grams) == expected(rows, percent, size)


def test_odd_rows(odd, nothing):
    result = found(odd)
    rows = [(row["doc_id"], row["text"]) for row in odd.select("doc_id", "text").collect()]
    sizes = {text: len(plain_set(text)) for _, text in rows}
    assert sorted(repr(row[:2]) for row in result) == sorted(repr((doc_id, sizes[text])) for doc_id, text in rows)
    by = {(doc_id, n): component for doc_id, n, component in result}
    # The first two texts differ in capitals only; the row without an id has the same text.
    assert by[0, 15] == by[1, 15] == by[None, 15] == 0
    assert by[2, 0] == 2 and by[3, 0] == 3 and by[4, 0] == 4 and by[None, 0] is None
    assert by[5, 1] == 5
    assert found(nothing) == []


def test_ids_that_are_null_or_repeated(spark):
    words = " ".join(f"w{i}" for i in range(40))
    other = " ".join(f"v{i}" for i in range(40))
    rows = [(None, words), (7, words + " end"), (7, other), (7, other), (3, other + " end"), (None, "only one of these here at all")]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    assert found(frame) == sorted([(None, 36, 7), (7, 37, 7), (7, 36, 3), (7, 36, 3), (3, 37, 3), (None, 3, None)], key=repr)


def test_names_that_clash(spark):
    rows = edited_rows(4, 4, 4)
    frame = spark.createDataFrame(rows, "node long, grams string").withColumns({name: F.lit("z") for name in ("id", "text", "a", "row", "n")})
    assert [row for row in found(frame, id_col="node", text_col="grams")] == expected(rows)


def test_many_copies_and_one_common_passage(spark):
    common = " ".join(f"law{i}" for i in range(60))
    rows = [(i, "one text that many sources hold word for word") for i in range(200)]
    rows += [(200 + i, f"a{i} b{i} c{i} d{i} e{i} f{i} g{i} h{i} i{i} j{i} k{i} l{i} m{i} n{i} o{i} p{i} q{i} " + common) for i in range(100)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    assert found(frame) == expected(rows)


def test_percent_is_checked(odd):
    with pytest.raises(ValueError):
        jaccard.similar_classes(odd, percent=0)


@pytest.mark.parametrize("percent", [40, 80, 100])
def test_forest_against_all_pairs(percent):
    rng = np.random.default_rng(percent)
    sets = {}
    while len(sets) < 150:
        size = int(rng.integers(1, 40))
        start = int(rng.integers(0, 60))
        chosen = np.unique(np.concatenate([np.arange(start, start + size), rng.integers(0, 200, 3)])).astype(np.uint64)
        sets[chosen.tobytes()] = chosen
    sets = list(sets.values())
    plain = plain_classes({at: set(one.tolist()) for at, one in enumerate(sets)}, percent)
    links = jaccard.forest(sets, percent)
    label = list(range(len(sets)))

    def root(at):
        while label[at] != at:
            at = label[at]
        return at

    for a, b in links:
        shared = len(np.intersect1d(sets[a], sets[b]))
        assert 100 * shared >= percent * len(np.union1d(sets[a], sets[b]))
        x, y = sorted((root(a), root(b)))
        # A forest: no link joins what is joined.
        assert x != y
        label[y] = x
    assert [root(at) for at in range(len(sets))] == [plain[at] for at in range(len(sets))]


def test_walk_shares_beginnings_and_leaves_branches():
    """Sets with a common beginning and different ends are passed over without being visited one by one."""
    common = np.arange(50, dtype=np.uint32)
    sets = [np.concatenate([common, np.arange(1000 + 60 * i, 1050 + 60 * i, dtype=np.uint32)]) for i in range(100)]
    sets.append(np.arange(100, 200, dtype=np.uint32))
    tree = jaccard.Tree(sets, 80)
    tree.remove(100)
    assert tree.linked(100) == []
    # One look at the common beginning excludes all hundred.
    assert tree.steps == 1
