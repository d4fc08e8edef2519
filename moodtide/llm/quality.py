"""Quality rules: a table of thresholds compiled into one projection.

Nothing leaves the JVM and nothing is shuffled: every measure of a text is
computed from that text alone.

Defined results: a null or empty text has no words, all its counts are 0, it
fails the base rule and is not kept.  Repeated rows are judged one by one and
alike.  An empty table gives an empty table.  Extra columns pass through
`quality_filter` and are left out by `quality_measures`.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from moodtide.functions.binding import bind
from moodtide.llm.registry import query
from moodtide.sources.files import table

SPACES = "[\\x20\\x09-\\x0D]+"
SYMBOLS = "#*$%&|<>"
WINDOW = 3

# The commonest words of the languages at hand, in natural order.
STOP_WORDS = {
    "en": "a and are as at be by for from in is it of on or that the this to was with",
    "de": "das dem den der des die ein eine im in ist mit nicht sich und von zu",
    "fr": "au avec ce dans de des du elle en est et la le les par pas pour que qui sur un une",
    "es": "al como con de del el en es la las lo los no para por que se su un una y",
}

BASE_MIN_WORDS = 50
BASE_MAX_REPEATED = 0.5


@dataclass(frozen=True)
class Rule:
    """A text is rejected if the measure is below `least` or above `most`."""

    name: str
    measure: str
    least: float | None = None
    most: float | None = None

    def failed(self, measures: dict[str, Column]) -> Column:
        value = measures[self.measure]
        low = value < F.lit(float(self.least)) if self.least is not None else F.lit(False)
        high = value > F.lit(float(self.most)) if self.most is not None else F.lit(False)
        return low | high


RULES = (
    Rule("word_length", "chars_per_word", least=2.0, most=15.0),
    Rule("symbols", "symbols_per_word", most=0.1),
    Rule("stop_words", "stop_word_share", least=0.01),
    Rule("lines", "repeated_line_share", most=0.5),
)


def stop_words() -> list[str]:
    """All listed words, also with a capital letter."""
    listed = sorted({word for words in STOP_WORDS.values() for word in words.split()})
    return listed + [word.capitalize() for word in listed]


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, SPACES, -1), "")


def repeated_window_words(words: Column, size: int = WINDOW) -> Column:
    """How many words lie in windows of `size` words that occur twice or more.

    Windows are sorted with their places, so equal ones become neighbours.
    """
    last = F.size(words) - size

    def covered(windows: Column) -> Column:
        def same(place: Column) -> Column:
            here, before = F.get(windows, place), F.get(windows, place - 1)
            equal = here.getField("w0") == before.getField("w0")
            for part in range(1, size):
                equal = equal & (here.getField(f"w{part}") == before.getField(f"w{part}"))
            return equal

        pairs = F.transform(
            F.filter(F.sequence(F.lit(1), F.size(windows) - 1), same),
            lambda place: F.array(F.get(windows, place).getField("at"), F.get(windows, place - 1).getField("at")),
        )
        starts = F.array_distinct(F.flatten(pairs))
        spread = F.transform(starts, lambda start: F.sequence(start, start + (size - 1)))
        return F.size(F.array_distinct(F.flatten(spread)))

    parts = [F.slice(words, part + 1, last + 1).alias(f"w{part}") for part in range(size)]
    windows = F.sort_array(F.arrays_zip(*parts, F.sequence(F.lit(0), last).alias("at")))
    return F.when(last >= 1, bind(windows, covered)).otherwise(F.lit(0))


def counts_of(text: Column) -> Column:
    """All counts of one text as a struct."""
    body = F.coalesce(text, F.lit(""))
    listed = stop_words()

    def measured(words: Column) -> Column:
        lines = F.filter(F.split(body, "\n", -1), lambda line: line.rlike("[^\\x20\\x09-\\x0D]"))
        return bind(
            lines,
            lambda kept: F.struct(
                F.size(words).cast("bigint").alias("n_words"),
                F.length(F.translate(body, " \t\n\x0b\x0c\r", "")).cast("bigint").alias("word_chars"),
                (F.length(body) - F.length(F.translate(body, SYMBOLS, ""))).cast("bigint").alias("n_symbols"),
                (F.size(kept) - F.size(F.array_distinct(kept))).cast("bigint").alias("n_dup_lines"),
                repeated_window_words(words).cast("bigint").alias("n_repeat_words"),
                F.size(kept).cast("bigint").alias("n_lines"),
                F.size(F.filter(words, lambda word: word.isin(listed))).cast("bigint").alias("n_stop_words"),
            ),
        )

    return bind(words_of(body), measured)


def verdict_of(counts: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """Names of the failed rules, the base rule first; empty for a text that is kept."""
    words = counts.getField("n_words")
    some_words = F.greatest(words, F.lit(1))
    measures = {
        "chars_per_word": counts.getField("word_chars") / some_words,
        "symbols_per_word": counts.getField("n_symbols") / some_words,
        "stop_word_share": counts.getField("n_stop_words") / some_words,
        "repeated_line_share": counts.getField("n_dup_lines") / F.greatest(counts.getField("n_lines"), F.lit(1)),
    }
    failed = [F.when(base_failed(counts), F.lit("base"))]
    failed += [F.when(rule.failed(measures), F.lit(rule.name)) for rule in rules]
    return F.array_compact(F.array(*failed))


def base_failed(counts: Column) -> Column:
    """Too few words, or more than half of them in repeated windows."""
    words = counts.getField("n_words")
    return (words < BASE_MIN_WORDS) | (100 * counts.getField("n_repeat_words") > round(100 * BASE_MAX_REPEATED) * words)


def quality_measures(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES
) -> DataFrame:
    """One row per document: its id, the counts, `base_failed`, `failed_rules` and `kept`."""
    judged = bind(
        counts_of(F.col(text_col)),
        lambda counts: F.struct(counts.alias("counts"), verdict_of(counts, rules).alias("failed_rules")),
    )
    rows = docs.select(F.col(id_col).alias("doc_id"), judged.alias("judged"))
    counts = [F.col(f"judged.counts.{name}") for name in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    return rows.select(
        "doc_id",
        *counts,
        F.array_contains("judged.failed_rules", "base").alias("base_failed"),
        (F.size("judged.failed_rules") == 0).alias("kept"),
        "judged.failed_rules",
        F.col("judged.counts.n_lines"),
        F.col("judged.counts.n_stop_words"),
    )


def quality_filter(docs: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The documents that fail no rule, with all their columns."""
    failed = bind(counts_of(F.col(text_col)), lambda counts: F.size(verdict_of(counts, rules)))
    return docs.where(failed == 0)


_STOP_SQL = ", ".join(f"'{word}'" for word in stop_words())

SQL = rf"""
WITH split AS (
    SELECT doc_id, coalesce(text, '') AS body,
           regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
           list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS lines
    FROM documents),
placed AS (
    SELECT doc_id, i, w[i] AS a, w[i + 1] AS b, w[i + 2] AS c
    FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM split)),
twice AS (
    SELECT doc_id, i FROM placed QUALIFY count(*) OVER (PARTITION BY doc_id, a, b, c) > 1),
repeated AS (
    SELECT doc_id, count(*) AS n FROM (
        SELECT doc_id, i FROM twice UNION SELECT doc_id, i + 1 FROM twice UNION SELECT doc_id, i + 2 FROM twice)
    GROUP BY doc_id),
counted AS (
    SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
           CAST(len(regexp_extract_all(body, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
           CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
           CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words, CAST(len(lines) AS BIGINT) AS n_lines,
           CAST(len(list_filter(w, lambda x: x IN ({_STOP_SQL}))) AS BIGINT) AS n_stop_words
    FROM split LEFT JOIN repeated USING (doc_id)),
judged AS (
    SELECT *, list_filter([
        CASE WHEN n_words < 50 OR 100 * n_repeat_words > 50 * n_words THEN 'base' END,
        CASE WHEN word_chars / greatest(n_words, 1) < 2 OR word_chars / greatest(n_words, 1) > 15 THEN 'word_length' END,
        CASE WHEN n_symbols / greatest(n_words, 1) > 0.1 THEN 'symbols' END,
        CASE WHEN n_stop_words / greatest(n_words, 1) < 0.01 THEN 'stop_words' END,
        CASE WHEN n_dup_lines / greatest(n_lines, 1) > 0.5 THEN 'lines' END], lambda r: r IS NOT NULL) AS failed_rules
    FROM counted)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       list_contains(failed_rules, 'base') AS base_failed, len(failed_rules) = 0 AS kept,
       array_to_string(failed_rules, ',') AS failed_rules, n_lines, n_stop_words
FROM judged"""


@query("op10_quality_rules", SQL)
def op10_quality_rules(spark: SparkSession, sf: str) -> DataFrame:
    measured = quality_measures(table(spark, sf, "documents"))
    return measured.withColumn("failed_rules", F.array_join("failed_rules", ","))
