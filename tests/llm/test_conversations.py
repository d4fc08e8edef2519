import hashlib
import random
import re
import zlib
from functools import lru_cache

import pytest
from pyspark.sql import functions as F

from moodtide.llm import conversations
from moodtide.llm.queries import QUERIES

SCHEMA = "conv_id long, turn long, role string, text string"
PATTERN = re.compile(r"(s?(ua)+)?")


def plain_faults(rows):
    seen, out = set(), []
    for _, role, text in rows:
        last = text.strip(" \t\n\x0b\x0c\r")[-1:]
        out.append("blank" if not last else "duplicate" if (role, text) in seen else "" if last in ".!?" else "truncated")
        seen.add((role, text))
    return out


def plain_edits(initials, faults):
    """Every way to edit, by recursion: the least (cost, audit)."""

    @lru_cache(None)
    def least(at, last):
        found = [(0, "")] if at == len(initials) and last in ("", "a") else []
        due = {"": "u", "s": "u", "u": "a", "a": "u"}[last]

        def add(cost, letter, rest):
            if rest:
                found.append((cost + rest[0], letter + rest[1]))

        if at < len(initials):
            extra = faults[at] == "truncated"
            add(3, "D", least(at + 1, last))
            if faults[at] in ("", "truncated"):
                if initials[at] == due or (initials[at] == "s" and last == ""):
                    add(extra, "K", least(at + 1, initials[at]))
                elif initials[at] == "u" and last == "":
                    add(extra, "K", least(at + 1, "u"))
                add(2 + extra, "R", least(at + 1, due))
        # At most two rows in a row are ever put in.
        inserted(at, last, add)
        return min(found) if found else None

    def inserted(at, last, add, depth=0):
        due = {"": "u", "s": "u", "u": "a", "a": "u"}[last]
        if depth == 2:
            return
        extra = at < len(initials) and faults[at] == "truncated"
        letters = "I" * (depth + 1)
        if at == len(initials):
            if due == "a":
                add(2 * (depth + 1), letters, (0, ""))
        else:
            after = {"s": "u", "u": "a", "a": "u"}[due]
            add(2 * (depth + 1) + 3, letters + "D", least(at + 1, due))
            if faults[at] in ("", "truncated"):
                if initials[at] == after:
                    add(2 * (depth + 1) + extra, letters + "K", least(at + 1, after))
                add(2 * (depth + 1) + 2 + extra, letters + "R", least(at + 1, after))
        inserted(at, due, add, depth + 1)

    return least(0, "")


def plain_repair(rows):
    """rows: (turn, role, text) with nulls."""
    rows = [(turn, " " if role is None else role, " " if text is None else text) for turn, role, text in rows]
    rows.sort(key=lambda row: (row[0] is not None, row[0] or 0, row[1], row[2]))
    faults = plain_faults(rows)
    initials = [role[:1] for _, role, _ in rows]
    turns = [turn for turn, _, _ in rows if turn is not None]
    cost, audit = plain_edits(tuple(initials), tuple(faults))
    left, at, due = [], 0, "user"
    for edit in audit:
        role, text = ("", "") if edit == "I" else rows[at][1:]
        at += edit != "I"
        if edit == "D":
            continue
        if edit != "K":
            role = due
        due = "assistant" if role[0] == "u" else "user"
        left.append((role, text))
    assert at == len(rows)
    assert PATTERN.fullmatch("".join(role[0] for role, _ in left))
    return (
        max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0,
        faults.count("blank"), faults.count("duplicate"), faults.count("truncated"),
        sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])),
        cost, audit, hashlib.sha256("\n".join(f"{role}:{text}" for role, text in left).encode()).hexdigest(),
    ), left


def expected(rows):
    by = {}
    for conv, *row in rows:
        by.setdefault(conv, []).append(tuple(row))
    return {conv: plain_repair(own)[0] for conv, own in by.items()}


def found(frame, **options):
    return {row[0]: tuple(row[1:]) for row in conversations.repair(frame, **options).collect()}


def random_rows(seed, convs, most=9):
    rng = random.Random(seed)
    roles = ["user", "user", "assistant", "assistant", "system", "sage", "tool", "", None]
    texts = ["Yes.", "No!", "why", " ", "", None, "a. b", "end? \n", "x.", "y.", "z."]
    rows = []
    for conv in range(convs):
        for _ in range(rng.randint(1, most)):
            rows.append((conv, rng.choice([None, 0, 1, 2, 3, 5, 9]), rng.choice(roles), rng.choice(texts) if rng.random() < 0.7 else f"{rng.random()}."))
    return rows


def test_query_against_plain_search(spark, sf):
    rows, every = [], set()
    for row in spark.read.parquet(f"{sf}/conversations.parquet").collect():
        every.add(row["conv_id"])
        damage = zlib.crc32(f"{row['conv_id']}:{row['turn']}".encode()) % 20
        role, text = "user" if damage == 4 else row["role"], row["text"]
        if damage:
            text = "" if damage == 1 else re.sub("[.!?]", "", text) if damage == 2 else text
            rows += [(row["conv_id"], row["turn"], role, text)] * (2 if damage == 3 else 1)
    wanted = expected(rows)
    result = QUERIES["op12_edit_lattice_repair"](spark, sf).collect()
    assert {row["conv_id"] for row in result} == every and len(result) == len(every)
    nothing = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    for row in result:
        assert tuple(row[1:]) == wanted.get(row["conv_id"], nothing)


@pytest.mark.parametrize("segment", [1, 3, 1024])
def test_random_conversations(spark, segment):
    rows = random_rows(segment, 120)
    frame = spark.createDataFrame(rows, SCHEMA).repartition(5)
    assert found(frame, segment=segment) == expected(rows)


def test_one_long_conversation(spark):
    rows = random_rows(77, 1, 1) + [(7, *row[1:]) for row in random_rows(5, 60)]
    frame = spark.createDataFrame(rows, SCHEMA).repartition(6)
    wanted = expected(rows)
    assert found(frame, segment=16) == wanted
    assert found(frame) == wanted


def test_many_equal_rows(spark):
    rows = [(1, 4, "user", "Hello.")] * 300 + [(1, None, "user", "Hello.")] * 20 + [(2, 0, "user", "x")]
    frame = spark.createDataFrame(rows, SCHEMA)
    result = found(frame, segment=50)
    assert result == found(frame)
    assert result[1][2] == 319
    assert result[1][5:7] == (319 * 3 + 2, "K" + "D" * 319 + "I")
    assert result[2] == plain_repair([(0, "user", "x")])[0]


def test_null_conversation_and_empty_table(spark):
    rows = [(None, 1, "user", "a."), (None, 2, "user", "b."), (3, None, None, None), (4, 1, "user", "a."), (4, 2, "assistant", "b")]
    frame = spark.createDataFrame(rows, SCHEMA)
    assert found(frame) == expected(rows)
    assert found(frame.limit(0)) == {}
    assert conversations.repaired_rows(frame.limit(0)).count() == 0


@pytest.mark.parametrize("segment", [2, 1024])
def test_repaired_rows(spark, segment):
    rows = random_rows(3, 60)
    frame = spark.createDataFrame(rows, SCHEMA).repartition(4)
    got = {}
    for row in conversations.repaired_rows(frame, segment=segment).orderBy("conv_id", "place").collect():
        got.setdefault(row["conv_id"], []).append(tuple(row))
    by = {}
    for conv, *row in rows:
        by.setdefault(conv, []).append(tuple(row))
    for conv, own in by.items():
        left = plain_repair(own)[1]
        assert got.get(conv, []) == [(conv, place, *row) for place, row in enumerate(left)]


def test_extra_columns_and_other_names(spark):
    rows = random_rows(9, 20)
    frame = spark.createDataFrame(rows, SCHEMA).toDF("audit", "part", "at", "conv").withColumn("role", F.lit("x"))
    frame = frame.withColumn("audit", F.concat(F.lit("c"), F.col("audit")))
    result = {row["audit_"]: tuple(row[1:]) for row in conversations.repair(frame.withColumnRenamed("audit", "audit_"), "audit_", "part", "at", "conv").collect()}
    assert result == {f"c{conv}": value for conv, value in expected(rows).items()}


def test_long_text_and_white_space(values):
    texts = ["", " \t\n", "x. \n", "x" * 100_000 + ".", " " * 50_000 + "y" + " " * 50_000, ".\n.", "a "]
    assert values(conversations.is_blank, texts) == [True, True, False, False, False, False, False]
    assert values(conversations.is_truncated, texts) == [True, True, False, False, True, False, True]


def test_meeting_searches_equal_one_plain_search():
    rng = random.Random(4)
    for _ in range(300):
        size = rng.randint(0, 8)
        initials = [rng.choice("suaxua") for _ in range(size)]
        faults = [rng.choice(["", "", "", "blank", "duplicate", "truncated"]) for _ in range(size)]
        assert conversations._lattice(initials, faults).solved() == plain_edits(tuple(initials), tuple(faults))
