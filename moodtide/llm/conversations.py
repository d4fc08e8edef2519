"""Conversation repair: bidirectional Dijkstra over the lattice of edits.

A conversation is in order if the initials of its roles read `(s?(ua)+)?`.
A node of the lattice is a number of rows passed and a state of that pattern;
edits are its edges: keep a row, give it the role that is due, delete it, or
insert an empty row.  One search runs from the start, one back from the end, each
with a heap; when their least open costs together exceed the best meeting, every meeting of
equal cost has been seen.  Among these the least audit, the joined initials of
the edits, is taken.  An audit leads along one path only, as state and initial determine the next state.

Rows are sorted over the cluster by conversation and turn, and each task repairs the
conversations it holds whole.  What a task holds of a conversation at its
borders, or one of more than `SEGMENT` rows, is passed on in segments of at most that many rows:
each segment is solved for all pairs of states, and the lattice of segments
is searched in the same way.  So a conversation of any length is spread over
many tasks; only its audit, one letter per edit, and the running hash of its repaired text pass through one.

Defined results: a null role or text counts as one space.  Null turns come
first; rows of equal turn are ordered by role, then text.  Rows with a null conversation id
form one conversation.  Repeated rows are duplicates.  A blank row has no character but white
space.  Extra columns are not read.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from moodtide.llm.registry import query
from moodtide.llm.scratch import stored
from moodtide.sources.files import table

SEGMENT = 1024
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1

# States: nothing yet, after system, after user, after assistant.
START, SYSTEM, USER, ASSISTANT = range(4)
# The state that a re-roled or inserted row leads to.
_DUE = (USER, USER, ASSISTANT, USER)
_DUE_FROM = ((), (), (START, SYSTEM, ASSISTANT), (USER,))
_ROLE = {USER: "user", ASSISTANT: "assistant"}
ENDS = (START, ASSISTANT)
_LEGAL = ("su", "ua", "au")

Edge = tuple[int, str, tuple[int, int]]


# -- search -------------------------------------------------------------------------------


def least_edits(
    starts: Iterable[tuple[int, int]],
    ends: Iterable[tuple[int, int]],
    after: Callable[[tuple[int, int]], Iterable[Edge]],
    before: Callable[[tuple[int, int]], Iterable[Edge]],
    trace: bool = False,
) -> tuple[int, str, str] | None:
    """Cost and audit of the cheapest way from a start to an end, the least audit among equals.

    `after` and `before` give the edges (cost, letters, other node) out of and
    into a node.  With `trace`, the state that each edge leads to is returned too.
    """
    # Edges without cost lead to more rows passed, so equal costs are taken in that order from
    # the front, and in the opposite one from the back: a node's audit is final when it is taken.
    ways = [({node: (0, "", "") for node in side}, set(), after if sign > 0 else before, sign) for side, sign in ((starts, 1), (ends, -1))]
    heaps = [[(0, sign * node[0], node) for node in labels] for labels, _, _, sign in ways]
    for heap in heaps:
        heapq.heapify(heap)
    front, back = ways[0][0], ways[1][0]
    best = 0 if front.keys() & back.keys() else None
    while all(heaps) and (best is None or heaps[0][0][0] + heaps[1][0][0] <= best):
        side = 0 if heaps[0][0][0] <= heaps[1][0][0] else 1
        labels, done, edges, sign = ways[side]
        others = ways[1 - side][0]
        cost, _, node = heapq.heappop(heaps[side])
        if node in done:
            continue
        done.add(node)
        _, audit, states = labels[node]
        for price, letters, other in edges(node):
            mark = str((other if sign > 0 else node)[1]) if trace else ""
            label = (cost + price, *((audit + letters, states + mark) if sign > 0 else (letters + audit, mark + states)))
            held = labels.get(other)
            if held is None or label < held:
                labels[other] = label
                if held is None or label[0] < held[0]:
                    heapq.heappush(heaps[side], (label[0], sign * other[0], other))
            if other in others:
                met = labels[other][0] + others[other][0]
                best = met if best is None else min(best, met)
    if best is None:
        return None
    meetings = [node for node in front.keys() & back.keys() if front[node][0] + back[node][0] == best]
    return best, *min((front[node][1] + back[node][1], front[node][2] + back[node][2]) for node in meetings)


class Rows:
    """The lattice over some rows: initials of roles, whether each must go, whether each is truncated."""

    def __init__(self, initials: list[str], must_go: list[bool], cut: list[bool]):
        self.kinds = list(zip(initials, must_go, (TRUNCATED if one else 0 for one in cut)))

    @staticmethod
    def _kept(initial: str, state: int) -> int | None:
        """The state after keeping a row, if it may be kept here."""
        if initial == "s":
            return SYSTEM if state == START else None
        if initial == "u":
            return USER if state != USER else None
        return ASSISTANT if initial == "a" and state == USER else None

    def after(self, node: tuple[int, int]) -> Iterator[Edge]:
        at, state = node
        yield INSERT, "I", (at, _DUE[state])
        if at < len(self.kinds):
            initial, must_go, extra = self.kinds[at]
            yield DELETE, "D", (at + 1, state)
            if not must_go:
                kept = self._kept(initial, state)
                if kept is not None:
                    yield extra, "K", (at + 1, kept)
                yield REROLE + extra, "R", (at + 1, _DUE[state])

    def before(self, node: tuple[int, int]) -> Iterator[Edge]:
        at, state = node
        for earlier in _DUE_FROM[state]:
            yield INSERT, "I", (at, earlier)
        if at:
            initial, must_go, extra = self.kinds[at - 1]
            yield DELETE, "D", (at - 1, state)
            if not must_go:
                for earlier in range(4):
                    if self._kept(initial, earlier) == state:
                        yield extra, "K", (at - 1, earlier)
                for earlier in _DUE_FROM[state]:
                    yield REROLE + extra, "R", (at - 1, earlier)

    def solved(self, start: int = START, ends: Iterable[int] = ENDS) -> tuple[int, str] | None:
        """Cost and audit, or nothing if no edits lead there."""
        way = least_edits([(0, start)], [(len(self.kinds), end) for end in ends], self.after, self.before)
        return way and way[:2]


class Segments:
    """The lattice over segments, each given as (cost, audit) by pair of states."""

    def __init__(self, moves: list[dict[tuple[int, int], tuple[int, str]]]):
        self.moves = moves

    def after(self, node: tuple[int, int]) -> Iterator[Edge]:
        at, state = node
        if at < len(self.moves):
            for (start, end), (cost, audit) in self.moves[at].items():
                if start == state:
                    yield cost, audit, (at + 1, end)

    def before(self, node: tuple[int, int]) -> Iterator[Edge]:
        at, state = node
        if at:
            for (start, end), (cost, audit) in self.moves[at - 1].items():
                if end == state:
                    yield cost, audit, (at - 1, start)

    def solved(self) -> tuple[int, str, list[int]]:
        """Cost, audit, and the state after each segment."""
        ends = [(len(self.moves), end) for end in ENDS]
        cost, audit, states = least_edits([(0, START)], ends, self.after, self.before, trace=True)
        return cost, audit, [int(state) for state in states]


def replayed(audit: str, rows: Iterable[tuple[str, str]], state: int = START) -> Iterator[tuple[str, str]]:
    """Role and text of each row that the edits leave; `rows` are the rows before them."""
    source = iter(rows)
    for edit in audit:
        role, text = ("", "") if edit == "I" else next(source)
        if edit == "D":
            continue
        if edit == "K":
            state = Rows._kept(role[:1], state)
        else:
            state = _DUE[state]
            role = _ROLE[state]
        yield role, text


# -- faults -------------------------------------------------------------------------------


def is_blank(text: Column) -> Column:
    return ~text.rlike(r"[^\x20\x09-\x0D]")


def is_truncated(text: Column) -> Column:
    """Whether the last character that is no white space ends no sentence."""
    return ~text.rlike(r"[.!?][\x20\x09-\x0D]*\z")


def _illegal(initials: list[str]) -> int:
    return sum(a + b not in _LEGAL for a, b in zip(initials, initials[1:]))


def _gaps(least: int | None, most: int | None, distinct: int) -> int:
    return 0 if least is None else most - least + 1 - distinct


_COUNTS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]


def _counts(turns: list, faults: list[str], initials: list[str]) -> dict:
    known = {turn for turn in turns if turn is not None}
    return {
        "gaps": _gaps(min(known, default=None), max(known, default=None), len(known)),
        "blank": faults.count("blank"),
        "duplicate": faults.count("duplicate"),
        "truncated": faults.count("truncated"),
        "illegal": _illegal(initials),
    }


def _fault(blank: bool, duplicate: bool, cut: bool) -> str:
    return "blank" if blank else "duplicate" if duplicate else "truncated" if cut else ""


def _lattice(initials: list[str], faults: list[str]) -> Rows:
    return Rows(initials, [one in ("blank", "duplicate") for one in faults], [one == "truncated" for one in faults])


def _runs(batches: Iterable[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, dict | None]]:
    """Rows in order with the values of their first `keys` columns; a null row after the last of each run."""
    now = None
    for batch in batches:
        columns = [column.to_pylist() for column in batch.columns]
        for row in zip(*columns):
            if now is not None and row[:keys] != now:
                yield now, None
            now = row[:keys]
            yield now, row[keys:]
    if now is not None:
        yield now, None


class _Out:
    """Records gathered into batches."""

    def __init__(self, schema: pa.Schema, size: int = 2048):
        self.schema, self.size, self.rows = schema, size, []

    def add(self, **cells) -> Iterator[pa.RecordBatch]:
        self.rows.append(cells)
        if len(self.rows) >= self.size:
            yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        if self.rows:
            yield pa.RecordBatch.from_pylist(self.rows, self.schema)
            self.rows = []


# -- conversations inside one task --------------------------------------------------------


def _first_pass(segment: int, with_rows: bool, out_schema: pa.Schema):
    """Repairs conversations held whole; the rows of others pass on, numbered."""

    def solved(rows: list[tuple]) -> dict:
        seen, faults = set(), []
        for _, role, text, blank, cut in rows:
            faults.append(_fault(blank, (role, text) in seen, cut))
            seen.add((role, text))
        initials = [row[1][:1] for row in rows]
        cost, audit = _lattice(initials, faults).solved()
        left = list(replayed(audit, ((row[1], row[2]) for row in rows)))
        lines = "\n".join(f"{role}:{text}" for role, text in left)
        return {
            **_counts([row[0] for row in rows], faults, initials), "cost": cost, "audit": audit,
            "digest": hashlib.sha256(lines.encode()).hexdigest(),
            "repaired": [{"role": role, "text": text} for role, text in left] if with_rows else None,
        }

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        out = _Out(out_schema)
        # What stands at the border of a task may go on in another one.
        held, passed, at_border = [], 0, True
        last = None

        def pass_on(conv, rows):
            nonlocal passed
            for turn, role, text, blank, cut in rows:
                yield from out.add(conv=conv, part=part, at=passed, turn=turn, role=role, text=text, is_blank=blank, cut=cut)
                passed += 1

        for (conv,), row in _runs(batches, 1):
            if last is not None:
                # The conversation before this one has ended inside the task.
                before, rows, on_border = last
                last = None
                if on_border or passed:
                    yield from pass_on(before, rows)
                else:
                    yield from out.add(conv=before, **solved(rows))
                passed = 0
            if row is None:
                last, held, at_border = (conv, held, at_border), [], False
                continue
            held.append(row)
            if len(held) > segment or passed:
                yield from pass_on(conv, held)
                held = []
        if last is not None:
            yield from pass_on(last[0], last[1])
        yield from out.flush()

    return run


# -- conversations over several tasks -----------------------------------------------------


def _segment_pass(out_schema: pa.Schema):
    """One record per segment: counts, borders, and the cheapest edits between any two states."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, rows = _Out(out_schema, 64), []
        for (conv, part, chunk), row in _runs(batches, 3):
            if row is not None:
                rows.append(row)
                continue
            turns = [turn for _, turn, *_ in rows]
            initials = [initial for _, _, initial, *_ in rows]
            faults = [_fault(blank, duplicate, cut) for *_, blank, duplicate, cut in rows]
            lattice = _lattice(initials, faults)
            moves = []
            for start in range(4):
                for end in range(4):
                    way = lattice.solved(start, (end,))
                    if way:
                        moves.append({"start": start, "end": end, "cost": way[0], "audit": way[1]})
            known = [turn for turn in turns if turn is not None]
            yield from out.add(
                conv=conv, part=part, chunk=chunk, initials=[initials[0], initials[-1]], moves=moves,
                least=min(known, default=None), most=max(known, default=None), distinct=len(set(known)),
                **{name: count for name, count in _counts(turns, faults, initials).items() if name != "gaps"},
            )
            rows = []
        yield from out.flush()

    return run


def _joined_pass(out_schema: pa.Schema):
    """Chooses the way through the segments of each conversation; its counts stand at the last segment."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, held = _Out(out_schema, 64), []
        names = None

        def named(source):
            nonlocal names
            for batch in source:
                names = batch.schema.names[1:]
                yield batch

        for (conv,), row in _runs(named(batches), 1):
            if row is not None:
                held.append(dict(zip(names, row)))
                continue
            moves = [{(one["start"], one["end"]): (one["cost"], one["audit"]) for one in part["moves"]} for part in held]
            cost, audit, states = Segments(moves).solved()
            state, place = START, 0
            total = {name: sum(part[name] for part in held) for name in ("blank", "duplicate", "truncated", "illegal", "distinct")}
            for a, b in zip(held, held[1:]):
                total["illegal"] += a["initials"][-1] + b["initials"][0] not in _LEGAL
                total["distinct"] -= a["most"] is not None and a["most"] == b["least"]
            least = min((part["least"] for part in held if part["least"] is not None), default=None)
            most = max((part["most"] for part in held if part["most"] is not None), default=None)
            for number, (part, end) in enumerate(zip(held, states)):
                piece = moves[number][state, end][1]
                is_last = number + 1 == len(held)
                counts = {name: total[name] for name in ("blank", "duplicate", "truncated", "illegal")} if is_last else {}
                if is_last:
                    counts |= {"gaps": _gaps(least, most, total["distinct"]), "cost": cost, "audit": audit}
                yield from out.add(conv=conv, part=part["part"], chunk=part["chunk"], state=state, piece=piece, place=place, **counts)
                place += len(piece) - piece.count("D")
                state = end
            held = []
        yield from out.flush()

    return run


def _replay_pass(out_schema: pa.Schema):
    """The rows that the edits of each segment leave."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, rows = _Out(out_schema), []
        for (conv, part, chunk), row in _runs(batches, 3):
            if row is not None:
                rows.append(row)
                continue
            _, state, piece, place = rows[0][:4]
            for role, text in replayed(piece, ((row[4], row[5]) for row in rows), state):
                yield from out.add(conv=conv, place=place, role=role, text=text)
                place += 1
            rows = []
        yield from out.flush()

    return run


def _digest_pass(out_schema: pa.Schema):
    """The hash of each conversation's lines, taken as they pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, running = _Out(out_schema), None
        for (conv,), row in _runs(batches, 1):
            if row is None:
                yield from out.add(conv=conv, digest=running.hexdigest())
                running = None
                continue
            _, role, text = row
            line = f"{role}:{text}".encode()
            if running is None:
                running = hashlib.sha256(line)
            else:
                running.update(b"\n" + line)
        yield from out.flush()

    return run


def _mapped(rows: DataFrame, run, columns: str) -> DataFrame:
    """`run` over the rows of each task; `columns` beside the conversation, which keeps its type."""
    kind = rows.schema["conv"].dataType.simpleString()
    schema = rows.sparkSession.createDataFrame([], f"conv {kind}, {columns}").schema
    return rows.mapInArrow(run(to_arrow_schema(schema)), schema)


_LONGS = ", ".join(f"{name} long" for name in _COUNTS)


def _solved_and_lines(rows: DataFrame, segment: int, with_rows: bool) -> DataFrame:
    """Finished conversations, and the rows of those that no task holds whole."""
    ordered = rows.repartitionByRange("conv", "turn", "role", "text").sortWithinPartitions("conv", "turn", "role", "text")
    found = _mapped(
        ordered,
        lambda schema: _first_pass(segment, with_rows, schema),
        f"part int, at long, turn long, role string, text string, is_blank boolean, cut boolean, {_LONGS}, "
        "audit string, digest string, repaired array<struct<role: string, text: string>>",
    )
    return stored(found, "conversations")


def _joined(lines: DataFrame, segment: int) -> DataFrame:
    """One row per segment with its share of the edits; counts at the last segment of each conversation."""
    # Which rows repeat an earlier one is asked over all tasks; only digests are compared.
    slim = lines.select(
        "conv", F.struct("part", "at").alias("where"), "turn", F.substring("role", 1, 1).alias("initial"), "is_blank", "cut",
        F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text")).alias("print"),
    )
    first = slim.groupBy("conv", "print").agg(F.min("where").alias("first")).toDF("own", "own_print", "first")
    flagged = slim.join(first, F.col("conv").eqNullSafe(F.col("own")) & (F.col("print") == F.col("own_print"))).select(
        "conv", "where.part", F.floor(F.col("where.at") / segment).alias("chunk"), "where.at", "turn", "initial",
        "is_blank", (F.col("where") != F.col("first")).alias("duplicate"), "cut",
    )
    place = ["conv", "part", "chunk"]
    segments = _mapped(
        flagged.repartition(*place).sortWithinPartitions(*place, "at"),
        _segment_pass,
        "part int, chunk long, initials array<string>, moves array<struct<start: int, end: int, cost: long, audit: string>>, "
        "least long, most long, distinct long, blank long, duplicate long, truncated long, illegal long",
    )
    ways = _mapped(
        segments.repartition("conv").sortWithinPartitions(*place),
        _joined_pass,
        f"part int, chunk long, state int, piece string, place long, {_LONGS}, audit string",
    )
    return stored(ways, "repairs")


def _replayed(lines: DataFrame, ways: DataFrame, segment: int) -> DataFrame:
    """Rows left in conversations of several tasks: conv, place, role, text."""
    place = ["conv", "part", "chunk"]
    numbered = lines.withColumn("chunk", F.floor(F.col("at") / segment)).select(*place, "at", "role", "text")
    shares = ways.select(*[F.col(name).alias(f"own_{name}") for name in place], "state", "piece", "place")
    same = F.col("conv").eqNullSafe(F.col("own_conv")) & (F.col("part") == F.col("own_part")) & (F.col("chunk") == F.col("own_chunk"))
    both = numbered.join(shares, same).select(*place, "at", "state", "piece", "place", "role", "text")
    dealt = both.repartition(*place).sortWithinPartitions(*place, "at")
    return _mapped(dealt, _replay_pass, "place long, role string, text string")


def _slim(conversations: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    rows = conversations.select(
        F.col(conv_col).alias("conv"),
        F.col(turn_col).cast("bigint").alias("turn"),
        F.coalesce(F.col(role_col), F.lit(" ")).alias("role"),
        F.coalesce(F.col(text_col), F.lit(" ")).alias("text"),
    )
    return rows.withColumns({"is_blank": is_blank(F.col("text")), "cut": is_truncated(F.col("text"))})


def repair(
    conversations: DataFrame,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
    segment: int = SEGMENT,
) -> DataFrame:
    """One row per conversation: its faults, the cost and audit of its repair, and the hash of the repaired lines."""
    found = _solved_and_lines(_slim(conversations, conv_col, turn_col, role_col, text_col), segment, False)
    whole = found.where(F.col("audit").isNotNull()).select("conv", *_COUNTS, "audit", "digest")
    lines = found.where(F.col("audit").isNull())
    ways = _joined(lines, segment)
    left = _replayed(lines, ways, segment)
    hashed = _mapped(left.repartition("conv").sortWithinPartitions("conv", "place"), _digest_pass, "digest string").toDF("own", "digest")
    ends = ways.where(F.col("audit").isNotNull())
    joined = ends.drop("digest").join(hashed, F.col("conv").eqNullSafe(F.col("own")), "left").select(
        "conv", *_COUNTS, "audit", F.coalesce("digest", F.sha2(F.lit(""), 256)).alias("digest")
    )
    return whole.unionByName(joined).select(
        F.col("conv").alias(conv_col), *_COUNTS, "audit", F.col("digest").alias("repaired_sha256")
    )


def repaired_rows(
    conversations: DataFrame,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
    segment: int = SEGMENT,
) -> DataFrame:
    """The repaired conversations: one row per message left or put in, numbered from 0 in column `place`."""
    found = _solved_and_lines(_slim(conversations, conv_col, turn_col, role_col, text_col), segment, True)
    whole = found.where(F.col("audit").isNotNull()).select("conv", F.posexplode("repaired").alias("place", "row"))
    lines = found.where(F.col("audit").isNull())
    left = _replayed(lines, _joined(lines, segment), segment)
    rows = whole.select("conv", F.col("place").cast("bigint").alias("place"), "row.role", "row.text").unionByName(left)
    return rows.toDF(conv_col, "place", role_col, text_col)


# -- query --------------------------------------------------------------------------------

# What is done to a row, by the checksum of its place modulo this.
DAMAGE_EVERY = 20
DROPPED, EMPTIED, UNPUNCTUATED, REPEATED, MADE_USER = range(5)


def damaged(conversations: DataFrame) -> DataFrame:
    """Some rows dropped, emptied, stripped of sentence ends, repeated, or given to the user."""
    shown = [F.coalesce(F.col(name).cast("string"), F.lit(" ")) for name in ("conv_id", "turn")]
    kind = F.crc32(F.concat(shown[0], F.lit(":"), shown[1])) % DAMAGE_EVERY
    text = F.coalesce("text", F.lit(" "))
    rows = conversations.withColumn("damage", kind).where(F.col("damage") != DROPPED)
    return rows.select(
        "conv_id",
        "turn",
        F.when(F.col("damage") == MADE_USER, "user").otherwise(F.coalesce("role", F.lit(" "))).alias("role"),
        F.when(F.col("damage") == EMPTIED, "")
        .when(F.col("damage") == UNPUNCTUATED, F.regexp_replace(text, "[.!?]", ""))
        .otherwise(text)
        .alias("text"),
        F.explode(F.when(F.col("damage") == REPEATED, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
    ).drop("copy")


def _add(label: str, cost: str, edit: str) -> str:
    """SQL that adds an edit to a label, which is a cost of nine digits and the audit so far."""
    return f"(lpad(CAST(CAST(left({label}, 9) AS INTEGER) + {cost} AS VARCHAR), 9, '0') || substr({label}, 10) || '{edit}')"


# Labels of each state with rows put in at this place.
_WITH_INSERTS = f"""
  SELECT * EXCLUDE (a), least(a, {_add("u", str(INSERT), "I")}) AS a FROM (
    SELECT * EXCLUDE (u), least(u, {_add("n", str(INSERT), "I")}, {_add("s", str(INSERT), "I")}, {_add("a", str(INSERT), "I")}) AS u FROM
"""

_SQL = rf"""
WITH RECURSIVE keyed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS key
  FROM conversations
), summed AS (
  SELECT *, xor(4294967295, list_reduce(
    list_prepend(4294967295, list_transform(string_split(key, ''), lambda c: CAST(ascii(c) AS BIGINT))),
    lambda sum, byte: list_reduce(list_prepend(xor(sum, byte), range(8)), lambda x, i: xor(x >> 1, 3988292384 * (x & 1)))
  )) % {DAMAGE_EVERY} AS damage FROM keyed
), hurt AS (
  SELECT conv_id, turn, CASE WHEN damage = {MADE_USER} THEN 'user' ELSE role END AS role,
    CASE damage WHEN {EMPTIED} THEN '' WHEN {UNPUNCTUATED} THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, damage
  FROM summed WHERE damage <> {DROPPED}
), repeated AS (
  SELECT * FROM hurt UNION ALL SELECT * FROM hurt WHERE damage = {REPEATED}
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos FROM repeated
), faulty AS (
  SELECT *, left(role, 1) AS initial, CASE
    WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank'
    WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) > 1 THEN 'duplicate'
    WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 'truncated' ELSE '' END AS fault,
    left(lag(role) OVER (PARTITION BY conv_id ORDER BY pos), 1) || left(role, 1) AS border
  FROM placed
), counted AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
    count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
    count(*) FILTER (border NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS rows
  FROM faulty GROUP BY conv_id
), walk AS (
  SELECT conv_id, CAST(0 AS BIGINT) AS pos, '000000000' AS n, CAST(NULL AS VARCHAR) AS s, CAST(NULL AS VARCHAR) AS u, CAST(NULL AS VARCHAR) AS a
  FROM counted
  UNION ALL
  SELECT w.conv_id, w.pos + 1, {_add("n", str(DELETE), "D")},
    least({_add("s", str(DELETE), "D")}, CASE WHEN stays AND initial = 's' THEN {_add("n", "extra", "K")} END),
    least({_add("u", str(DELETE), "D")}, CASE WHEN stays AND initial = 'u' THEN {_add("least(n, s, a)", "extra", "K")} END,
      CASE WHEN stays THEN {_add("least(n, s, a)", f"{REROLE} + extra", "R")} END),
    least({_add("a", str(DELETE), "D")}, CASE WHEN stays AND initial = 'a' THEN {_add("u", "extra", "K")} END,
      CASE WHEN stays THEN {_add("u", f"{REROLE} + extra", "R")} END)
  FROM ({_WITH_INSERTS} walk)) w
  JOIN (SELECT *, fault NOT IN ('blank', 'duplicate') AS stays, CASE WHEN fault = 'truncated' THEN {TRUNCATED} ELSE 0 END AS extra FROM faulty) f
    ON f.conv_id IS NOT DISTINCT FROM w.conv_id AND f.pos = w.pos + 1
), ended AS (
  SELECT c.*, CAST(left(label, 9) AS BIGINT) AS cost, substr(label, 10) AS audit
  FROM (SELECT conv_id, pos, least(n, a) AS label FROM ({_WITH_INSERTS} walk))) w
  JOIN counted c ON c.conv_id IS NOT DISTINCT FROM w.conv_id AND c.rows = w.pos
), edits AS (
  SELECT conv_id, i, substr(audit, i, 1) AS edit FROM ended, unnest(range(1, length(audit) + 1)) AS t(i)
), dealt AS (
  SELECT *, sum(CAST(edit <> 'I' AS INTEGER)) OVER (PARTITION BY conv_id ORDER BY i) AS pos,
    sum(CAST(edit <> 'D' AS INTEGER)) OVER (PARTITION BY conv_id ORDER BY i) AS place
  FROM edits
), left_over AS (
  SELECT d.conv_id, d.place, d.edit, f.role, f.text,
    max(CASE WHEN d.place = 1 AND d.edit = 'K' AND f.initial = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY d.conv_id) AS opened
  FROM dealt d LEFT JOIN faulty f ON d.edit <> 'I' AND f.conv_id IS NOT DISTINCT FROM d.conv_id AND f.pos = d.pos
  WHERE d.edit <> 'D'
), hashed AS (
  SELECT conv_id, sha256(string_agg(
    CASE WHEN edit = 'K' THEN role WHEN (place - opened) % 2 = 1 THEN 'user' ELSE 'assistant' END
    || ':' || CASE WHEN edit = 'I' THEN '' ELSE text END, chr(10) ORDER BY place)) AS digest
  FROM left_over GROUP BY conv_id
)
SELECT o.conv_id, coalesce(e.gaps, 0) AS gaps, coalesce(e.blank, 0) AS blank, coalesce(e.duplicate, 0) AS duplicate,
  coalesce(e.truncated, 0) AS truncated, coalesce(e.illegal, 0) AS illegal, coalesce(e.cost, 0) AS cost,
  coalesce(e.audit, '') AS audit, coalesce(h.digest, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o
LEFT JOIN ended e ON e.conv_id IS NOT DISTINCT FROM o.conv_id
LEFT JOIN hashed h ON h.conv_id IS NOT DISTINCT FROM o.conv_id
"""


def repaired_of(conversations: DataFrame, hurt: DataFrame) -> DataFrame:
    """Repairs of the damaged rows, with zeros for conversations of which none is left."""
    every = conversations.select(F.col("conv_id").alias("original")).distinct()
    found = repair(hurt)
    return every.join(found, every["original"].eqNullSafe(found["conv_id"]), "left").select(
        F.col("original").alias("conv_id"),
        *[F.coalesce(name, F.lit(0).cast("bigint")).alias(name) for name in _COUNTS],
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"),
    )


@query("op12_edit_lattice_repair", _SQL)
def op12_edit_lattice_repair(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "conversations")
    return repaired_of(rows, damaged(rows))
