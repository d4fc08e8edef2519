"""Secret scans: fixed patterns, and sliding-window Shannon entropy over candidate strings.

All in column functions: no row leaves the JVM and nothing is shuffled.  Texts
without any hit, nearly all of them, cost one pass per pattern.

Defined results: a null text is scanned as an empty one and has no spans; very
long texts are scanned whole; repeated rows get equal results; extra columns
pass through `redact` and are left out by `secret_spans`.  Places are counted
in code points, ends are exclusive.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from moodtide.functions.binding import bind
from moodtide.llm.registry import query
from moodtide.sources.files import table


def either_case(word: str) -> str:
    """A pattern for an ASCII word in any case, the same in every regex engine."""
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


KEYS = ("password", "passwd", "secret", "token", "api_?key")
ASSIGN = "(" + "|".join(either_case(key) for key in KEYS) + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_VALUE = 6
ACCESS = "AKIA[A-Z0-9]+"
ACCESS_LENGTH = 20
HEX = "[0-9a-f]+"
HEX_LENGTH = 24

SPAN = "array<struct<start:int,rank:int,stop:int,kind:string>>"


@dataclass(frozen=True)
class EntropyClass:
    """A class of characters whose long runs are candidates.

    A candidate needs a digit and a letter, and is a hit if some `window` of
    its characters has a Shannon entropy of at least `bits`.
    """

    kind: str
    alphabet: str
    run: str
    window: int
    bits: float


_DIGITS = "0123456789"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_LOWER = _UPPER.lower()

ENTROPY_CLASSES = (
    EntropyClass("entropy_hex", _DIGITS + "ABCDEF" + "abcdef", "[0-9A-Fa-f]{24,}", 24, 3.03),
    EntropyClass("entropy_base64", _DIGITS + _UPPER + _LOWER + "+/_-", "[A-Za-z0-9+/_-]{24,}", 24, 3.93),
)

# Candidates that match one of these are not secrets: placeholders, runs of the
# alphabet or of digits, and identifiers that are public by design.
ALLOWED = (
    "[Ee][Xx][Aa][Mm][Pp][Ll][Ee]",
    "abcdefgh|ABCDEFGH|01234567|12345678",
    "^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",
    "^sha[0-9]+-",
)

# Entropies are kept as whole millionths, so sums do not depend on their order.
_UNIT = 1_000_000


def _log_terms(window: int) -> list[int]:
    """count * log2(count) for each count that a window can hold."""
    return [0] + [round(_UNIT * count * math.log2(count)) for count in range(1, window + 1)]


def _least_terms(rule: EntropyClass) -> int:
    """The largest sum of count * log2(count) at which a window still has enough entropy."""
    return math.floor(_UNIT * rule.window * (math.log2(rule.window) - rule.bits))


def window_terms(candidate: Column, rule: EntropyClass) -> Column:
    """The smallest sum of count * log2(count) over all windows of the candidate.

    The window slides by one character: the count of the one that enters
    grows, the count of the one that leaves shrinks, and only their two terms
    of the sum change.
    """
    terms = F.array(*[F.lit(term) for term in _log_terms(rule.window)])
    alphabet = F.lit(rule.alphabet)
    codes = F.transform(
        F.filter(F.split(candidate, "", -1), lambda char: char != ""),
        lambda char: F.call_function("instr", alphabet, char) - 1,
    )
    far = F.lit(2**30)
    empty = F.struct(
        F.array_repeat(F.lit(0), len(rule.alphabet)).alias("counts"), F.lit(0).alias("total"), far.alias("least")
    )

    def slide(codes: Column) -> Column:
        def step(state: Column, place: Column) -> Column:
            counts, total = state.getField("counts"), state.getField("total")
            enters = F.get(codes, place)
            leaves = F.when(place >= rule.window, F.get(codes, place - rule.window)).otherwise(F.lit(-1))
            more = F.get(counts, enters)
            fewer = F.coalesce(F.get(counts, leaves), F.lit(0))
            gained = F.get(terms, more + 1) - F.get(terms, more)
            lost = F.when(leaves >= 0, F.get(terms, fewer) - F.get(terms, fewer - 1)).otherwise(F.lit(0))
            moved = F.when(enters == leaves, total).otherwise(total + gained - lost)

            def counted(count: Column, code: Column) -> Column:
                return count + F.when(code == enters, 1).otherwise(0) - F.when(code == leaves, 1).otherwise(0)

            return bind(
                moved,
                lambda now: F.struct(
                    F.transform(counts, counted).alias("counts"),
                    now.alias("total"),
                    F.when(place >= rule.window - 1, F.least(state.getField("least"), now))
                    .otherwise(state.getField("least"))
                    .alias("least"),
                ),
            )

        return F.aggregate(F.sequence(F.lit(0), F.size(codes) - 1), empty, step).getField("least")

    return bind(codes, slide)


def is_random(candidate: Column, rule: EntropyClass) -> Column:
    """Mixed letters and digits, on no allow-list, with a window of high entropy."""
    mixed = candidate.rlike("[0-9]") & candidate.rlike("[A-Za-z]")
    allowed = F.lit(False)
    for pattern in ALLOWED:
        allowed = allowed | candidate.rlike(pattern)
    suspect = mixed & ~allowed
    return F.when(suspect, window_terms(candidate, rule) <= _least_terms(rule)).otherwise(F.lit(False))


def _spans(text: Column, pattern: str, kind: str, rank: int, group: int, keep) -> Column:
    """Spans of the leftmost non-overlapping matches whose group passes `keep`.

    Splitting at the pattern gives what lies between the matches, so places
    are running sums of lengths.
    """
    nothing = F.array().cast(SPAN)
    start = F.struct(F.lit(0).alias("at"), nothing.alias("found"))

    def step(state: Column, part: Column) -> Column:
        begin = state.getField("at") + F.length(part.getField("gap"))
        stop = begin + F.length(part.getField("match"))
        span = F.struct(
            begin.alias("start"), F.lit(rank).alias("rank"), stop.alias("stop"), F.lit(kind).alias("kind")
        )
        here = F.when(keep(part.getField("value")), F.array(span)).otherwise(nothing)
        return F.struct(stop.alias("at"), F.concat(state.getField("found"), here.cast(SPAN)).alias("found"))

    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    parts = F.arrays_zip(
        F.slice(F.split(text, pattern, -1), F.lit(1), F.size(matches)).alias("gap"),
        matches.alias("match"),
        F.regexp_extract_all(text, F.lit(pattern), F.lit(group)).alias("value"),
    )
    found = F.aggregate(parts, start, step).getField("found")
    return F.when(text.rlike(pattern), found).otherwise(nothing)


def base_spans(text: Column) -> Column:
    """Spans of the three fixed patterns, by start and kind."""
    # A run that is too short holds no longer one, so the length may stand in the pattern.
    long_hex = HEX.replace("+", f"{{{HEX_LENGTH},}}")
    parts = (
        _spans(text, ASSIGN, "assign", 0, 2, lambda value: F.length(value) >= ASSIGN_VALUE),
        _spans(text, ACCESS, "access", 1, 0, lambda value: F.length(value) >= ACCESS_LENGTH),
        _spans(text, long_hex, "hex", 2, 0, lambda value: F.lit(True)),
    )
    return F.sort_array(F.concat(*parts))


def entropy_spans(text: Column, base: Column, classes: tuple[EntropyClass, ...] = ENTROPY_CLASSES) -> Column:
    """Spans of random-looking strings outside all base spans."""
    parts = [
        _spans(text, rule.run, rule.kind, 3 + place, 0, lambda value, rule=rule: is_random(value, rule))
        for place, rule in enumerate(classes)
    ]

    def is_new(span: Column) -> Column:
        def holds(other: Column) -> Column:
            return (other.getField("start") <= span.getField("start")) & (span.getField("stop") <= other.getField("stop"))

        return ~F.exists(base, holds)

    return F.filter(F.concat(*parts), is_new)


def all_spans(text: Column, classes: tuple[EntropyClass, ...] = ENTROPY_CLASSES) -> Column:
    """A struct of the base spans and of all spans, each by start and kind."""
    return bind(
        base_spans(text),
        lambda base: F.struct(
            base.alias("base"), F.sort_array(F.concat(base, entropy_spans(text, base, classes))).alias("spans")
        ),
    )


def secret_spans(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    classes: tuple[EntropyClass, ...] = ENTROPY_CLASSES,
) -> DataFrame:
    """One row per document: its id, `base` and `spans`."""
    found = all_spans(F.coalesce(F.col(text_col), F.lit("")), classes)
    return docs.select(F.col(id_col).alias("doc_id"), found.alias("found")).select("doc_id", "found.base", "found.spans")


def redacted(text: Column, spans: Column) -> Column:
    """The text with each span replaced by its kind in brackets; of overlapping spans the first names the place."""
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(state: Column, span: Column) -> Column:
        at, out = state.getField("at"), state.getField("out")
        before = F.substring(text, at + 1, span.getField("start") - at)
        mark = F.concat(F.lit("["), F.upper(span.getField("kind")), F.lit("]"))
        fresh = span.getField("start") >= at
        return F.struct(
            F.greatest(at, span.getField("stop")).alias("at"),
            F.when(fresh, F.concat(out, before, mark)).otherwise(out).alias("out"),
        )

    def finished(state: Column) -> Column:
        return F.concat(state.getField("out"), F.substring(text, state.getField("at") + 1, F.length(text)))

    return F.when(F.size(spans) > 0, F.aggregate(spans, start, step, finished)).otherwise(text)


def redact(docs: DataFrame, text_col: str = "text", length_col: str | None = None) -> DataFrame:
    """The documents with all secrets replaced; a null text stays null.

    `length_col` names a column that holds the length of the text, which is set anew.
    """
    # An array of one element keeps the optimizer from repeating the scan for each column.
    text = F.when(
        F.col(text_col).isNotNull(),
        bind(F.col(text_col), lambda whole: bind(all_spans(whole), lambda found: redacted(whole, found.getField("spans")))),
    )
    out = docs.withColumn(text_col, text)
    if length_col and length_col in docs.columns:
        kind = docs.schema[length_col].dataType
        out = out.withColumn(length_col, F.length(F.col(text_col)).cast(kind))
    return out


def written(spans: Column) -> Column:
    """Spans as kind:start:stop, joined by commas."""
    return F.array_join(
        F.transform(spans, lambda span: F.concat_ws(":", span.getField("kind"), span.getField("start"), span.getField("stop"))), ","
    )


def _quoted(pattern: str) -> str:
    return pattern.replace("'", "''")


def _matches_sql(kind: str, rank: int, pattern: str, group: int, keep: str) -> str:
    """Spans of one pattern: the lengths of the parts between matches and of the matches, summed up."""
    return f"""
    SELECT doc_id, {rank} AS rank, '{kind}' AS kind, m AS found,
           CAST(list_sum(list_transform(gaps[1:i], lambda g: length(g))) + coalesce(list_sum(list_transform(ms[1:i - 1], lambda g: length(g))), 0) AS BIGINT) AS start,
           CAST(start + length(m) AS BIGINT) AS stop
    FROM (SELECT doc_id, ms, gaps, unnest(ms) AS m, unnest(vs) AS v, generate_subscripts(ms, 1) AS i
          FROM (SELECT doc_id, regexp_extract_all(body, '{_quoted(pattern)}') AS ms, regexp_extract_all(body, '{_quoted(pattern)}', {group}) AS vs,
                       regexp_split_to_array(body, '{_quoted(pattern)}') AS gaps FROM texts))
    WHERE {keep}"""


def _entropy_sql(place: int, rule: EntropyClass) -> str:
    allowed = " OR ".join(f"regexp_matches(v, '{_quoted(pattern)}')" for pattern in ALLOWED)
    windows = f"list_transform(range(1, length(v) - {rule.window} + 2), lambda s: list_aggregate(string_split(substr(v, s, {rule.window}), ''), 'entropy'))"
    keep = f"regexp_matches(v, '[0-9]') AND regexp_matches(v, '[A-Za-z]') AND NOT ({allowed}) AND list_max({windows}) >= {rule.bits}"
    return _matches_sql(rule.kind, 3 + place, rule.run, 0, keep)


_WRITTEN_SQL = "coalesce(string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank, stop), '')"

SQL = f"""
WITH texts AS (SELECT doc_id, coalesce(text, '') AS body FROM documents),
base AS (
    {_matches_sql("assign", 0, ASSIGN, 2, f"length(v) >= {ASSIGN_VALUE}")}
    UNION ALL {_matches_sql("access", 1, ACCESS, 0, f"length(v) >= {ACCESS_LENGTH}")}
    UNION ALL {_matches_sql("hex", 2, HEX, 0, f"length(v) >= {HEX_LENGTH}")}),
random AS ({" UNION ALL ".join(_entropy_sql(*rule) for rule in enumerate(ENTROPY_CLASSES))}),
spans AS (
    SELECT doc_id, rank, kind, start, stop FROM base
    UNION ALL SELECT doc_id, rank, kind, start, stop FROM random r WHERE NOT EXISTS (
        SELECT 1 FROM base b WHERE b.doc_id = r.doc_id AND b.start <= r.start AND r.stop <= b.stop)),
per_document AS (
    SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access,
           count(*) FILTER (kind = 'hex') AS n_hex,
           coalesce(string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank, stop) FILTER (rank < 3), '') AS base,
           {_WRITTEN_SQL} AS spans
    FROM spans GROUP BY doc_id)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM texts LEFT JOIN per_document USING (doc_id)"""


@query("op9_entropy_secrets", SQL)
def op9_entropy_secrets(spark: SparkSession, sf: str) -> DataFrame:
    found = secret_spans(table(spark, sf, "documents"))

    def count(kind: str) -> Column:
        return F.size(F.filter("base", lambda span: span.getField("kind") == kind)).cast("bigint").alias(f"n_{kind}")

    return found.select(
        "doc_id",
        *[count(kind) for kind in ("assign", "access", "hex")],
        F.sha2(written(F.col("base")), 256).alias("base_sha256"),
        written(F.col("spans")).alias("spans"),
    )
