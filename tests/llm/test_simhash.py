import random
from itertools import combinations

import pytest
import xxhash
from pyspark.sql import functions as F

from moodtide.llm import simhash
from moodtide.llm.components import connected
from moodtide.llm.queries import QUERIES
from tests.llm.conftest import documents


def plain_print(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words, word = [], ""
    for char in lowered + " ":
        if char in " \t\n\x0b\x0c\r":
            words, word = words + [word] * bool(word), ""
        else:
            word += char
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(len(words) - 3, 1))]
    hashes = [xxhash.xxh64(shingle.encode(), seed=42).intdigest() for shingle in shingles]
    return sum(1 << bit for bit in range(64) if 2 * sum(h >> bit & 1 for h in hashes) > len(hashes))


def plain_components(prints):
    """Smallest id reachable, by comparing all pairs."""
    label = dict(enumerate(sorted(prints)))
    ids = [label[i] for i in sorted(label)]
    parent = {i: i for i in ids}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in combinations(ids, 2):
        if (prints[a] ^ prints[b]).bit_count() <= 4:
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    return {i: root(i) for i in ids}


def test_query_against_all_pairs(spark, sf):
    prints = {doc_id: plain_print(text) for doc_id, text in documents(spark, sf)}
    expected = plain_components(prints)
    rows = QUERIES["op2_simhash_near_dedup"](spark, sf).collect()
    assert len(rows) == len(prints)
    for row in rows:
        assert row["fingerprint"] == f"{prints[row['doc_id']]:016x}"
        assert row["component_id"] == expected[row["doc_id"]]


def test_triples_cover_every_four_positions():
    triples = simhash.cover_triples()
    assert len(triples) == 20
    for four in combinations(range(8), 4):
        assert any(set(triple) <= set(four) for triple in triples)


@pytest.mark.parametrize("max_list", [4096, 16])
def test_links_join_all_near_pairs(spark, max_list):
    rng = random.Random(5)
    values = set()
    for _ in range(60):
        centre = rng.getrandbits(64)
        for _ in range(rng.choice([1, 1, 2, 40])):
            value = centre
            for bit in rng.sample(range(64), rng.randint(0, 6)):
                value ^= 1 << bit
            values.add(value)
    values = sorted(values)
    frame = spark.createDataFrame([(v - 2**64 if v >= 2**63 else v,) for v in values], "print long")
    labels = {row["node"] % 2**64: row["label"] for row in connected(simhash.links(frame, max_list=max_list), "t").collect()}
    expected = plain_components(dict(enumerate(values)))
    for a, b in combinations(range(len(values)), 2):
        same = values[a] in labels and values[b] in labels and labels[values[a]] == labels[values[b]]
        assert same == (expected[a] == expected[b])


def test_long_chain_and_hub(spark):
    edges = [(i, i + 1) for i in range(300)] + [(1000, 1001 + i) for i in range(500)] + [(5000, 5000)]
    rows = connected(spark.createDataFrame(edges, "a long, b long"), "t").collect()
    assert {row["node"]: row["label"] for row in rows} == {i: 0 for i in range(301)} | {i: 1000 for i in range(1000, 1501)}


def test_odd_rows(odd, nothing):
    rows = simhash.near_duplicates(odd).collect()
    assert len(rows) == odd.count()
    components = {row["doc_id"]: row["component_id"] for row in rows if row["doc_id"] is not None}
    assert components[0] == components[1] == 0
    assert components[2] == components[3] == components[4] == 2
    assert {row["component_id"] for row in rows if row["doc_id"] is None} == {0, 2}
    kept = simhash.keep_first(odd)
    assert kept.columns == odd.columns
    assert sorted(row["doc_id"] for row in kept.collect()) == [0, 2, 5, 6, 7, 8]
    assert simhash.near_duplicates(nothing).count() == simhash.keep_first(nothing).count() == 0


def test_only_null_ids(odd):
    unnamed = odd.where(F.col("doc_id").isNull())
    assert {row["component_id"] for row in simhash.near_duplicates(unnamed).collect()} == {None}
    assert simhash.keep_first(unnamed).count() == 2
