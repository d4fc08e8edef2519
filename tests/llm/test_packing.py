import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from moodtide.llm import binary, minslack, sharding
from moodtide.llm.queries import QUERIES
from moodtide.llm.tokens import encoder, tokenizer_path
from tests.llm.conftest import documents


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(tokenizer_path())


@pytest.fixture(scope="module")
def expected(spark, sf, tokenizer):
    """Ids of each document, with the end id."""
    return {doc_id: tokenizer.encode(text or "", add_special_tokens=False).ids + [1] for doc_id, text in documents(spark, sf)}


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab'sS.,^<|> \n\té́İΣ1|-한 ", max_size=60))
def test_encoder_agrees(text):
    plain = Tokenizer.from_file(tokenizer_path()) if not hasattr(test_encoder_agrees, "plain") else test_encoder_agrees.plain
    test_encoder_agrees.plain = plain
    assert np.frombuffer(encoder(tokenizer_path()).encode(text), "<u4").tolist() == plain.encode(text, add_special_tokens=False).ids


def test_encoder_forgets_and_agrees(expected, spark, sf, monkeypatch):
    own = type(encoder(tokenizer_path()))(tokenizer_path())
    monkeypatch.setattr(own, "MAX_HELD", 20_000, raising=False)
    for doc_id, text in documents(spark, sf)[:50]:
        assert np.frombuffer(own.encode(text), "<u4").tolist() == expected[doc_id][:-1]


def check_layout(rows, capacity=4096):
    places = defaultdict(list)
    for row in rows:
        places[row["sequence_id"]].append((row["offset"], row["length"]))
    for held in places.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= capacity
    return len(places)


@pytest.mark.parametrize("name,width", [("op8_min_bin_slack", "<u4"), ("op7_best_fit_decreasing", "<u2")])
def test_pieces_round_trip(spark, sf, expected, name, width):
    rows = QUERIES[name](spark, sf).collect()
    pieces = defaultdict(dict)
    for row in rows:
        assert row["piece"] not in pieces[row["doc_id"]]
        pieces[row["doc_id"]][row["piece"]] = row
    assert set(pieces) == set(expected)
    for doc_id, ids in expected.items():
        held = pieces[doc_id]
        assert len(held) == -(-len(ids) // 4096)
        for number, row in held.items():
            part = ids[number * 4096 : (number + 1) * 4096]
            assert (row["start"], row["length"]) == (number * 4096, len(part))
            assert row["ids_crc32"] == zlib.crc32(np.array(part, width).tobytes())
    total = sum(map(len, expected.values()))
    assert check_layout(rows) <= -(-total // 4096) + 2


def test_packed_rows(spark, sf, expected, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    binary.write_packed(docs, str(tmp_path / "packed"), tokenizer_path(), block_tokens=50_000)
    for row in binary.read_packed(spark, str(tmp_path / "packed")).collect():
        ids = np.frombuffer(row["ids"], "<u2")
        assert len(ids) == 4096 and not ids[row["n_tokens"] :].any()
        borders = row["cu_seqlens"]
        assert borders[0] == 0 and borders[-1] == row["n_tokens"] and row["position_resets"] == borders[:-1]
        for doc_id, start, begin, end in zip(row["doc_ids"], row["starts"], borders, borders[1:]):
            assert ids[begin:end].tolist() == expected[doc_id][start : start + end - begin]


def fullest(counts, capacity):
    """Largest sum up to the capacity, by trying all combinations."""
    items = [length for length, count in counts.items() for _ in range(count)]
    sums = {0}
    for item in items:
        sums |= {s + item for s in sums if s + item <= capacity}
    return max(sums)


def test_each_combination_is_the_fullest():
    rng = random.Random(3)
    for _ in range(60):
        capacity = rng.randint(5, 40)
        counts = Counter(rng.randint(1, capacity) for _ in range(rng.randint(0, 40)))
        left = Counter(counts)
        for combination in minslack.combinations(counts, capacity):
            for _ in range(combination.times):
                assert sum(length * used for length, used in combination.parts) == fullest(left, capacity)
                left.subtract(dict(combination.parts))
        assert not any(left.values())
    with pytest.raises(ValueError):
        minslack.combinations({5: 1}, 4)


def test_layout_places_every_piece_once():
    counts = {1: 50, 2: 17, 3: 29, 7: 11, 10: 4}
    layout = minslack.Layout(minslack.combinations(counts, 10))
    rows = []
    for length, count in counts.items():
        sequences, offsets = layout.places(length, np.arange(count))
        rows += [{"sequence_id": s, "offset": o, "length": length} for s, o in zip(sequences.tolist(), offsets.tolist())]
    assert check_layout(rows, 10) == layout.sequences == -(-sum(k * v for k, v in counts.items()) // 10)


def test_best_fit_decreasing_against_plain():
    rng = random.Random(4)
    for _ in range(50):
        lengths = [rng.randint(1, 30) for _ in range(rng.randint(0, 60))]
        rooms = []
        for length in sorted(lengths, reverse=True):
            fits = [room for room in rooms if room >= length]
            if fits:
                rooms.remove(min(fits))
                rooms.append(min(fits) - length)
            else:
                rooms.append(30 - length)
        rows = binary.best_fit_decreasing(lengths, 30)
        assert sorted(piece for row in rows for piece in row) == list(range(len(lengths)))
        assert sorted(30 - sum(lengths[piece] for piece in row) for row in rows) == sorted(rooms)


def test_packing_odd_rows(odd, nothing):
    rows = minslack.pack(odd, tokenizer_path()).collect()
    assert {row["doc_id"] for row in rows} == {None, *range(9)}
    assert sum(row["piece"] == 0 for row in rows) == odd.count()
    check_layout(rows)
    segments = binary.segments(binary.packed_rows(odd, tokenizer_path())).collect()
    assert sum(row["piece"] == 0 for row in segments) == odd.count()
    assert Counter(row["length"] for row in rows) == Counter(row["length"] for row in segments)
    assert minslack.pack(nothing, tokenizer_path()).count() == binary.packed_rows(nothing, tokenizer_path()).count() == 0


# -- sharding -----------------------------------------------------------------------------


def test_shards(spark, sf):
    rows = QUERIES["op5_virtual_slots"](spark, sf).collect()
    texts = dict(documents(spark, sf))
    assert sorted(row["doc_id"] for row in rows) == sorted(texts)
    held, slots = Counter(), defaultdict(list)
    for row in rows:
        data = (texts[row["doc_id"]] or "").encode()
        assert (row["size"], row["text_crc32"], row["law"], row["grown_shard"]) == (len(data) + 1, zlib.crc32(data), "bytes", None)
        held[row["shard"]] += row["size"]
        slots[row["shard"]].append(row["slot"])
    assert set(held) == set(range(16))
    assert all(sorted(own) == list(range(len(own))) for own in slots.values())
    assert max(held.values()) - min(held.values()) <= max(row["size"] for row in rows)


@pytest.fixture(scope="module")
def loads(spark):
    rng = random.Random(1)
    rows = [(slot, rng.randint(0, 1000), 1) for slot in range(256)]
    return spark.createDataFrame(rows, "virtual_slot int, bytes long, rows long")


def totals(slot_map):
    return {row["shard"]: row["s"] for row in slot_map.groupBy("shard").agg(F.sum("bytes").alias("s")).collect()}


def test_growing_moves_slots_only_into_the_new_shard(loads):
    old = sharding.assigned(loads, 4)
    before = {row["virtual_slot"]: row["shard"] for row in old.collect()}
    new = sharding.grown(loads, old, 4)
    after = {row["virtual_slot"]: row["shard"] for row in new.collect()}
    assert set(after) == set(before) == set(range(256))
    assert {after[slot] for slot in after if after[slot] != before[slot]} == {4}
    held = totals(new)
    assert max(held.values()) < 1.1 * sum(held.values()) / 5


def test_rebalancing_evens_out(loads, spark):
    skewed = loads.select("virtual_slot", F.when(F.col("virtual_slot") < 180, 0).otherwise(F.col("virtual_slot") % 3 + 1).alias("shard"))
    new = sharding.rebalanced(loads, skewed, 5)
    held = totals(new)
    assert new.count() == 256 and set(held) == set(range(5))
    assert max(held.values()) < 1.2 * sum(held.values()) / 5


def test_versions_are_kept(loads, spark, tmp_path):
    first = sharding.assigned(loads, 4)
    sharding.store_map(first, str(tmp_path), 0)
    sharding.store_map(sharding.grown(loads, sharding.stored_map(spark, str(tmp_path), 0), 4), str(tmp_path), 1)
    assert totals(sharding.stored_map(spark, str(tmp_path), 0)) == totals(first)
    assert len(totals(sharding.stored_map(spark, str(tmp_path), 1))) == 5
    with pytest.raises(Exception):
        sharding.store_map(first, str(tmp_path), 1)


def test_sharding_odd_rows(odd, nothing, tmp_path):
    rows = sharding.shard(odd, 3, str(tmp_path / "a")).collect()
    assert len(rows) == odd.count()
    assert len({row["shard"] for row in rows if row["doc_id"] == 0}) == 1
    assert {(row["size"], row["text_crc32"]) for row in rows if row["doc_id"] == 4} == {(1, 0)}
    assert sharding.shard(nothing, 3, str(tmp_path / "b")).count() == 0
    sharding.write_shards(odd, sharding.stored_map(odd.sparkSession, str(tmp_path / "a"), 0), str(tmp_path / "c"))
    assert odd.sparkSession.read.parquet(str(tmp_path / "c")).count() == odd.count()


def test_parts_are_cut_like_the_tokenizer_cuts(tokenizer):
    parts = ["(word)", "a1b22", "Word;", "don't", "x.y,z", "...", "it's.", "^a", "a^", "A_b-C", "é.", "über,", "12.5%", "'tis", "<|endoftext|>x", "#$%"]
    own = type(encoder(tokenizer_path()))(tokenizer_path())
    for part in [*parts, " ".join(parts)]:
        assert np.frombuffer(own.encode(part), "<u4").tolist() == tokenizer.encode(part, add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.characters(max_codepoint=0x24F, exclude_characters="\x00"), max_size=40) | st.text(alphabet="ab's'tredvml. ^é²½ÀŸǅ\u00a0\t\n1", max_size=60))
def test_latin_texts_agree(text):
    test_latin_texts_agree.plain = getattr(test_latin_texts_agree, "plain", None) or Tokenizer.from_file(tokenizer_path())
    ids = test_latin_texts_agree.plain.encode(text, add_special_tokens=False).ids
    assert np.frombuffer(encoder(tokenizer_path()).encode(text), "<u4").tolist() == ids


def test_every_latin_character_agrees(tokenizer):
    own = encoder(tokenizer_path())
    for code in range(1, 0x250):
        text = f"a{chr(code)}b {chr(code)}{chr(code)} 1{chr(code)}."
        assert np.frombuffer(own.encode(text), "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids, hex(code)


def test_other_tokenizers_are_given_whole_texts():
    path = tokenizer_path("byte_bpe_50k.json")
    own, plain = type(encoder(tokenizer_path()))(path), Tokenizer.from_file(path)
    assert not own.by_parts and encoder(tokenizer_path()).by_parts
    text = "Hello  World, it's a  Test\n\nwith 123 Numbers "
    assert np.frombuffer(own.encode(text), "<u4").tolist() == plain.encode(text, add_special_tokens=False).ids
