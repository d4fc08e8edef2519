"""Chat formatting by quotation linking.

Message bodies are parsed into own text and quoted passages of any nesting level.
Passages are normalised and hashed, and the hashes are joined to the
first message of the same thread that says the same, or else to the first message of any
thread.  A passage that no message says as a whole or in one line is linked to the earlier message of its
thread that shares most of its lines and sentences.  The passages of level 1 name the message that is answered, and with it the
conversation, its order, and the depth of each reply; quotes and attribution
lines are gone from the texts.

The first message with a passage comes from an aggregate combined before its
shuffle, so a greeting that opens a third of all threads is one row per task.
Replies are followed to their beginnings by doubling, over written tables.

Defined results: a null text is an empty message without quotes.  A message
without thread or place answers nothing and is never answered.  Rows with the same thread and
place share the latest parent among them.  A quote of text of which no earlier
message of the thread has a line or sentence links to no parent.  Extra columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from moodtide.llm.registry import query
from moodtide.llm.scratch import stored
from moodtide.sources.files import table

_QUOTED = re.compile(r"[ \t]*((?:>[ \t]?)+)")
_SENTENCE = re.compile(r"(?<=[.!?]) ")
_ATTRIBUTION = re.compile(r"[^\n]*\bwrote:[ \t]*")
# Places are counted in runs of this many, so that no long thread is sorted in one task.
RUN = 256


def normalised(text: str) -> str:
    """Words in ASCII lower case with one space between them: line breaks of a quote do not matter."""
    return b" ".join(text.encode().lower().split()).decode()


def passage_key(text: str) -> str | None:
    """128-bit hash of the normalised text; none for blank text."""
    words = normalised(text)
    return xxhash.xxh3_128_hexdigest(words.encode()) if words else None


def parse_body(body: str) -> tuple[str, list[tuple[int, str]]]:
    """Own text, and the quoted passages with their levels, in order.

    A passage is a run of lines of one level.  A line that ends in "wrote:"
    right before a deeper level belongs to the quote.
    """
    runs: list[tuple[int, list[str]]] = []
    for line in body.split("\n"):
        mark = _QUOTED.match(line)
        level = mark.group(1).count(">") if mark else 0
        if not runs or runs[-1][0] != level:
            if runs and level > runs[-1][0] and _ATTRIBUTION.fullmatch(runs[-1][1][-1]):
                runs[-1][1].pop()
            runs.append((level, []))
        runs[-1][1].append(line[mark.end() :] if mark else line)
    own = "\n".join(line for level, lines in runs if not level for line in lines).strip("\n")
    return own, [(level, "\n".join(lines)) for level, lines in runs if level and any(line.strip() for line in lines)]


def own_keys(own: str) -> list[str]:
    """Keys by which a message can be quoted: its whole text and each of its lines."""
    keys = dict.fromkeys(passage_key(part) for part in (own, *own.split("\n")))
    return [key for key in keys if key]


def part_keys(text: str) -> list[int]:
    """64-bit hashes of the lines of a text and of its sentences, which may run over lines or end with them."""
    lines = [normalised(line) for line in text.split("\n")]
    parts = dict.fromkeys(lines)
    for run in (normalised(text), *lines):
        parts.update(dict.fromkeys(_SENTENCE.split(run)))
    return [xxhash.xxh3_64_intdigest(part.encode()) - (1 << 63) for part in parts if part]


def parsed(
    messages: DataFrame, thread_col: str = "conv_id", place_col: str = "turn", role_col: str = "role", text_col: str = "text"
) -> DataFrame:
    """`thread`, `place`, `role`, own `text`, `keys` and `parts` of the message and its `quotes` (level, key and parts)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, keys, parts, quotes = [], [], [], []
            for body in batch.column(3):
                own, passages = parse_body(body.as_py() or "")
                texts.append(own)
                keys.append(own_keys(own))
                parts.append(part_keys(own))
                quotes.append([{"level": level, "key": passage_key(text), "parts": part_keys(text)} for level, text in passages])
            yield pa.RecordBatch.from_arrays(
                [
                    *batch.columns[:3],
                    pa.array(texts, pa.string()),
                    pa.array(keys, pa.list_(pa.string())),
                    pa.array(parts, pa.list_(pa.int64())),
                    pa.array(quotes, pa.list_(pa.struct([("level", pa.int32()), ("key", pa.string()), ("parts", pa.list_(pa.int64()))]))),
                ],
                names=["thread", "place", "role", "text", "keys", "parts", "quotes"],
            )

    slim = messages.select(
        F.col(thread_col).alias("thread"), F.col(place_col).alias("place"), F.col(role_col).alias("role"), F.col(text_col).alias("text")
    )
    kinds = ", ".join(f"{field.name} {field.dataType.simpleString()}" for field in slim.schema)
    return slim.mapInArrow(run, f"{kinds}, keys array<string>, parts array<bigint>, quotes array<struct<level:int,key:string,parts:array<bigint>>>")


def quotation_links(rows: DataFrame) -> DataFrame:
    """Each quoted passage of parsed messages with the message it comes from, if any: `from_thread`, `from_place`."""
    said = rows.where("thread IS NOT NULL AND place IS NOT NULL").select("thread", "place", F.explode("keys").alias("key"))
    in_thread = said.groupBy("thread", "key").agg(F.min("place").alias("near_place"))
    anywhere = said.groupBy("key").agg(F.min(F.struct("thread", "place")).alias("far"))
    quoted = rows.select("thread", "place", F.posexplode("quotes").alias("at", "quote")).select(
        "thread", "place", "at", F.col("quote.level").alias("level"), F.col("quote.key").alias("key")
    )
    near = quoted.join(in_thread, ["thread", "key"], "left")
    is_near = F.coalesce(F.col("near_place") < F.col("place"), F.lit(False))
    found = near.join(anywhere, "key", "left")
    far = F.when(F.col("far.thread") != F.col("thread"), F.col("far"))
    links = stored(
        found.select(
            "thread",
            "place",
            "at",
            "level",
            "key",
            F.when(is_near, F.col("thread")).otherwise(far["thread"]).alias("from_thread"),
            F.when(is_near, F.col("near_place")).otherwise(far["place"]).alias("from_place"),
        ),
        "links",
    )
    still = links.where("from_place IS NULL AND thread IS NOT NULL AND place IS NOT NULL").drop("from_thread", "from_place").distinct()
    if still.isEmpty():
        return links
    return links.join(part_links(rows, still), ["thread", "place", "at", "key"], "left").select(
        "thread",
        "place",
        "at",
        "level",
        "key",
        F.coalesce("from_thread", F.when(F.col("part_place").isNotNull(), F.col("thread"))).alias("from_thread"),
        F.coalesce("from_place", "part_place").alias("from_place"),
    )


def part_links(rows: DataFrame, still: DataFrame) -> DataFrame:
    """Of passages without a link, the earlier message of the thread that shares most lines and sentences, the first of several."""
    quoted = rows.select("thread", "place", F.posexplode("quotes").alias("at", "quote")).select(
        "thread", "place", "at", F.col("quote.key").alias("key"), F.explode("quote.parts").alias("part")
    )
    same = ["thread", "place", "at", "key"]
    asked = quoted.join(still.select(same), same, "left_semi").distinct()
    said = rows.join(still.select("thread").distinct(), "thread", "left_semi").select(
        "thread", F.col("place").alias("part_place"), F.explode("parts").alias("part")
    )
    shared = asked.join(said.distinct(), ["thread", "part"]).where("part_place < place").groupBy(*same, "part_place").count()
    return shared.groupBy(same).agg(F.max_by("part_place", F.struct("count", -F.col("part_place"))).alias("part_place"))


def reply_roots(parents: DataFrame) -> DataFrame:
    """First message and depth of each reply; `parents` has one row per `thread` and `place`, its `parent` or null.

    Each round doubles the distance looked back, so the rounds grow with the
    logarithm of the longest chain of replies.  Only replies whose beginning is still open are
    joined, and only to messages of threads that hold such replies; all others are left
    in the tables written before.
    """
    start = stored(
        parents.select(
            "thread",
            "place",
            F.coalesce("parent", "place").alias("root"),
            F.when(F.col("parent").isNull(), 0).otherwise(1).alias("depth"),
            F.col("parent").isNotNull().alias("open"),
        ),
        "replies",
    )
    known, still = start.where("NOT open"), start.where("open")
    while not still.isEmpty():
        live = known.unionByName(still).join(still.select("thread").distinct(), "thread", "left_semi")
        back = live.select(
            "thread", F.col("place").alias("root"), F.col("root").alias("next"), F.col("depth").alias("more"), F.col("open").alias("goes_on")
        )
        step = stored(
            still.drop("open")
            .join(back, ["thread", "root"], "left")
            .select(
                "thread",
                "place",
                F.coalesce("next", "root").alias("root"),
                (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"),
                F.coalesce("goes_on", F.lit(False)).alias("open"),
            ),
            "replies",
        )
        known, still = known.unionByName(step.where("NOT open")), step.where("open")
    return known.drop("open")


def numbered(rows: DataFrame, keys: list[str], run: int = RUN) -> DataFrame:
    """Position of each row among those with the same keys, by `place`: counted in runs, then shifted."""
    split = rows.withColumn("_run", F.floor(F.col("place") / run))
    counts = split.groupBy(*keys, "_run").agg(F.count(F.lit(1)).alias("_held"))
    before = Window.partitionBy(*keys).orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)
    shifts = counts.select(*keys, "_run", F.coalesce(F.sum("_held").over(before), F.lit(0)).alias("_shift"))
    inside = Window.partitionBy(*keys, "_run").orderBy("place", F.xxhash64("text"))
    ranked = split.withColumn("_rank", F.row_number().over(inside))
    same = [ranked[name].eqNullSafe(shifts[name]) for name in (*keys, "_run")]
    joined = ranked.join(shifts, same, "left").select(*[ranked[name] for name in ranked.columns], "_shift")
    return joined.withColumn("position", (F.col("_shift") + F.col("_rank") - 1).cast("bigint")).drop("_run", "_rank", "_shift")


def conversations(
    messages: DataFrame, thread_col: str = "conv_id", place_col: str = "turn", role_col: str = "role", text_col: str = "text"
) -> DataFrame:
    """All messages without quotes, in reply order.

    `thread` and `root` name a conversation, `position` is the place in it, `parent` the
    message that is answered and `depth` the number of answers before.
    """
    rows = stored(parsed(messages, thread_col, place_col, role_col, text_col), "parsed")
    links = quotation_links(rows)
    direct = F.when((F.col("level") == 1) & (F.col("from_thread") == F.col("thread")), F.col("from_place"))
    answered = links.groupBy("thread", "place").agg(F.max(direct).alias("parent"), F.count("from_place").alias("n_linked"))
    named = rows.where("thread IS NOT NULL AND place IS NOT NULL").select("thread", "place").distinct()
    parents = stored(named.join(answered, ["thread", "place"], "left"), "parents")
    placed = parents.join(reply_roots(parents), ["thread", "place"])
    known = rows.join(placed, ["thread", "place"], "left").select(
        "thread",
        "place",
        "role",
        "text",
        F.size("quotes").cast("bigint").alias("n_quotes"),
        F.coalesce("n_linked", F.lit(0)).alias("n_linked"),
        "parent",
        F.coalesce("root", "place").alias("root"),
        F.coalesce("depth", F.lit(0)).alias("depth"),
    )
    return numbered(known, ["thread", "root"])


# -- mails, derived from conversations ------------------------------------------------------


def mails(turns: DataFrame) -> DataFrame:
    """Each turn as a mail that quotes the one before, which quotes the one before that; quotes are broken at sentences."""
    rows = turns.select("conv_id", "turn", "role", "text")

    def quoted(text: str, mark: str):
        broken = F.regexp_replace(F.col(text), r"\. ", ".\n")
        return F.concat(F.lit(mark), F.regexp_replace(broken, "\n", f"\n{mark}"))

    last = rows.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("role").alias("role_1"), F.col("text").alias("text_1"))
    first = rows.select("conv_id", (F.col("turn") + 2).alias("turn"), F.col("role").alias("role_2"), F.col("text").alias("text_2"))
    joined = rows.join(last, ["conv_id", "turn"], "left").join(first, ["conv_id", "turn"], "left")
    inner = F.concat(F.lit("> "), F.col("role_2"), F.lit(" wrote:\n"), quoted("text_2", ">> "), F.lit("\n"))
    outer = F.concat(F.col("role_1"), F.lit(" wrote:\n"), F.coalesce(inner, F.lit("")), quoted("text_1", "> "), F.lit("\n"))
    return joined.select("conv_id", "turn", "role", F.concat(F.coalesce(outer, F.lit("")), F.coalesce("text", F.lit(""))).alias("text"))


_NORM = r"lower(trim(regexp_replace({}, '[ \t\n\r\f\v]+', ' ', 'g')))"

SQL = f"""
WITH RECURSIVE m AS (SELECT conv_id, turn, role, text, {_NORM.format("text")} AS norm FROM conversations),
said AS (
    SELECT conv_id, turn, norm AS key FROM m
    UNION SELECT conv_id, turn, {_NORM.format("line")} FROM (SELECT conv_id, turn, unnest(string_split(text, chr(10))) AS line FROM m)),
firsts AS (SELECT conv_id, key, min(turn) AS turn FROM said WHERE key <> '' GROUP BY ALL),
quoted AS (
    SELECT m.conv_id, m.turn, p.turn = m.turn - 1 AS direct, f.turn AS origin
    FROM m JOIN m p ON p.conv_id = m.conv_id AND p.norm <> ''
         AND (p.turn = m.turn - 1 OR p.turn = m.turn - 2 AND EXISTS (SELECT 1 FROM m q WHERE q.conv_id = m.conv_id AND q.turn = m.turn - 1))
    JOIN firsts f ON f.conv_id = p.conv_id AND f.key = p.norm),
parents AS (
    SELECT m.conv_id, m.turn, max(origin) FILTER (direct) AS parent, count(origin) AS n
    FROM m LEFT JOIN quoted USING (conv_id, turn) GROUP BY ALL),
tree AS (
    SELECT conv_id, turn, turn AS root, 0 AS depth FROM parents WHERE parent IS NULL
    UNION ALL
    SELECT p.conv_id, p.turn, root, depth + 1 FROM parents p JOIN tree t ON t.conv_id = p.conv_id AND t.turn = p.parent)
SELECT conv_id, turn, role, parent AS parent_turn, root AS root_turn, depth AS reply_depth,
       row_number() OVER (PARTITION BY conv_id, root ORDER BY turn) - 1 AS position, n AS n_quotes, n AS n_linked,
       sha256(text) AS text_sha256
FROM m JOIN parents USING (conv_id, turn) JOIN tree USING (conv_id, turn)"""


@query("op1_quotation_links", SQL)
def op1_quotation_links(spark: SparkSession, sf: str) -> DataFrame:
    """All conversation turns, sent as mails with nested quotes and put back into conversations without them."""
    found = conversations(mails(table(spark, sf, "conversations")))
    return found.select(
        F.col("thread").alias("conv_id"),
        F.col("place").alias("turn"),
        "role",
        F.col("parent").alias("parent_turn"),
        F.col("root").alias("root_turn"),
        F.col("depth").alias("reply_depth"),
        "position",
        "n_quotes",
        "n_linked",
        F.sha2("text", 256).alias("text_sha256"),
    )
