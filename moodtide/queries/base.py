"""Query registry, and the inputs that queries derive from the given tables.

Every input exists twice: as a DataFrame and as SQL for the comparison engine.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from moodtide.functions.cleaning import NEGATIONS
from moodtide.functions.words import NOT_WHITELISTED
from moodtide.sources.files import spread, table

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query; `sql` is its equivalent on the same tables."""

    def register(run: Query) -> Query:
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return run

    return register


def documents(spark: SparkSession, sf: str, *columns: str) -> DataFrame:
    return spread(table(spark, sf, "documents").select(*columns))


# -- tweets: documents with mentions, links, negations and references put in front --------

FIRST_TWEET_EPOCH = 1612257455  # 2021-02-02 09:17:35


def tweets(spark: SparkSession, sf: str) -> DataFrame:
    key = F.col("doc_id").cast("string")
    text = F.concat(
        F.lit("@u_"),
        key,
        F.lit(" I can't, WWW.x.co www.t.co/"),
        key,
        F.lit(" ISN'T &amp; awww yes <b>https://x.co/a?b=1 "),
        F.col("text"),
    )
    rows = documents(spark, sf, "doc_id", "lang", "n_chars", "text")
    return rows.withColumn("text", text).withColumn("datetime", tweet_time())


def tweet_time():
    """One tweet a minute, written with a zone name."""
    moment = F.timestamp_seconds(F.lit(FIRST_TWEET_EPOCH) + F.col("doc_id") * 60)
    return F.concat(F.date_format(moment, "yyyy-MM-dd HH:mm:ss"), F.lit(" UTC"))


TWEET_TIME_SQL = "strftime(TIMESTAMP '2021-02-02 09:17:35' + to_minutes(doc_id), '%Y-%m-%d %H:%M:%S')"

TWEETS_SQL = f"""(
    SELECT doc_id, lang, n_chars,
           concat('@u_', CAST(doc_id AS VARCHAR), ' I can''t, WWW.x.co www.t.co/', CAST(doc_id AS VARCHAR),
                  ' ISN''T &amp; awww yes <b>https://x.co/a?b=1 ', text) AS text,
           {TWEET_TIME_SQL} || ' UTC' AS datetime
    FROM documents)"""


# -- labelled documents -------------------------------------------------------------------


def labelled(spark: SparkSession, sf: str) -> DataFrame:
    """Documents with sentiment 0 or 4."""
    sentiment = (F.col("quality") * 4).alias("sentiment")
    labels = table(spark, sf, "labels").select("doc_id", sentiment)
    return documents(spark, sf, "doc_id", "text").join(labels, "doc_id")


# -- search jobs: phrases from the benchmark items ----------------------------------------


def search_jobs(spark: SparkSession, sf: str) -> DataFrame:
    parts = F.split("text", " ")
    first = F.get(parts, 0)
    phrase = F.when(F.length(first) > 3, first).otherwise(F.concat_ws(" ", first, F.get(parts, 1)))
    created = F.date_format(F.timestamp_seconds(F.lit(FIRST_TWEET_EPOCH) + F.col("item_id")), "yyyy-MM-dd HH:mm:ss")
    return table(spark, sf, "benchmark").select(
        F.concat(F.lit("job_"), F.col("item_id").cast("string")).alias("job_id"),
        phrase.alias("query"),
        created.alias("created_at"),
    )


JOBS_SQL = """(
    SELECT 'job_' || CAST(item_id AS VARCHAR) AS job_id,
           CASE WHEN length(string_split(text, ' ')[1]) > 3 THEN string_split(text, ' ')[1]
                ELSE concat_ws(' ', string_split(text, ' ')[1], string_split(text, ' ')[2]) END AS query,
           strftime(TIMESTAMP '2021-02-02 09:17:35' + to_seconds(item_id), '%Y-%m-%d %H:%M:%S') AS created_at
    FROM benchmark)"""


# -- objects: the files that the jobs of a user and day left behind -----------------------


def event_jobs(spark: SparkSession, sf: str) -> DataFrame:
    """One row per event: job, path of the file it wrote, and the event's own columns."""
    kind = F.col("event_type")
    name = (
        F.when(kind == "purchase", "results.csv")
        .when(kind == "error", "_error")
        .when(kind == "click", "tweets.csv")
        .otherwise("meta.json")
    )
    job = F.concat(F.lit("u"), F.col("user_id").cast("string"), F.lit("-"), F.date_format("ts", "yyyyMMdd"))
    return (
        table(spark, sf, "events")
        .withColumn("job_id", job)
        .withColumn("path", F.concat(F.lit("jobs/"), F.col("job_id"), F.lit("/"), name))
    )


EVENT_JOBS_SQL = """(
    SELECT *, 'jobs/' || job_id || '/' || CASE event_type WHEN 'purchase' THEN 'results.csv'
              WHEN 'error' THEN '_error' WHEN 'click' THEN 'tweets.csv' ELSE 'meta.json' END AS path
    FROM (SELECT *, 'u' || CAST(user_id AS VARCHAR) || '-' || strftime(ts, '%Y%m%d') AS job_id FROM events))"""


# -- results: scored events ----------------------------------------------------------------


def results(spark: SparkSession, sf: str, unit: str = "day") -> DataFrame:
    """Event values as predictions; coarse times give a series several values per time."""
    return table(spark, sf, "events").select(
        "user_id",
        "event_id",
        F.date_trunc(unit, F.col("ts")).cast("timestamp").alias("dt"),
        F.when(F.col("value") < 30, 0.0).otherwise(4.0).alias("prediction"),
    )


def results_sql(unit: str = "day") -> str:
    return f"""(
    SELECT user_id, event_id, date_trunc('{unit}', ts) AS dt,
           CASE WHEN value < 30 THEN 0.0::DOUBLE ELSE 4.0::DOUBLE END AS prediction
    FROM events)"""


# -- messages: conversation turns ----------------------------------------------------------


def message_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Conversation turns as nested messages."""
    moment = F.date_format(F.timestamp_seconds(F.lit(FIRST_TWEET_EPOCH) + F.col("conv_id") * 60 + F.col("turn")), "yyyy-MM-dd HH:mm:ss")
    return table(spark, sf, "conversations").select(
        F.struct(F.col("text"), moment.alias("created_at")).alias("tweet"),
        F.struct(
            F.concat(F.lit("c"), F.col("conv_id").cast("string")).alias("job_id"),
            F.col("role").alias("query"),
            F.lit("2021-02-02 09:00:00").alias("created_at"),
        ).alias("job_config"),
    )


MESSAGES_SQL = """(
    SELECT text,
           strftime(TIMESTAMP '2021-02-02 09:17:35' + to_seconds(conv_id * 60 + turn), '%Y-%m-%d %H:%M:%S') AS created_at,
           'c' || CAST(conv_id AS VARCHAR) AS job_id, role AS query, '2021-02-02 09:00:00' AS job_created_at
    FROM conversations)"""


# -- SQL renderings of the text functions --------------------------------------------------


def replace_sql(text: str, pattern: str, replacement: str = "") -> str:
    quoted = pattern.replace("'", "''")
    return f"regexp_replace({text}, '{quoted}', '{replacement}', 'g')"


MARKUP_RE2 = (
    r"(?is)<(?:(?:script|style|template)\b.*?(?:</(?:script|style|template)\s*>|\z)|!--.*?(?:-->|\z)"
    r"""|[!?][^>]*(?:>|\z)|/?[a-z_:][^>=]*(?:=\s*(?:"[^"]*"|'[^']*')?[^>=]*)*(?:>|\z))"""
)


def html_text_sql(text: str) -> str:
    """Markup removal plus the references that occur in the tables."""
    out = replace_sql(text, MARKUP_RE2)
    for name, code in (("quot", 34), ("copy", 169), ("middot", 183), ("lt", 60), ("gt", 62), ("amp", 38)):
        out = f"replace({out}, '&{name};', chr({code}))"
    return out


def strip_links_sql(text: str) -> str:
    return replace_sql(replace_sql(text, r"@[A-Za-z0-9_]+|https?://[^ ]+"), r"www[^\n][^ ]+")


def negations_sql(text: str) -> str:
    for short, full in NEGATIONS.items():
        text = replace_sql(text, rf"\b{short}\b", full)
    return text


def long_words_sql(text: str, longer_than: int) -> str:
    return f"list_filter(string_split({text}, ' '), lambda w: length(w) > {longer_than})"


def clean_sql(text: str) -> str:
    lowered = f"lower({strip_links_sql(html_text_sql(text))})"
    letters = replace_sql(negations_sql(lowered), "[^a-zA-Z]", " ")
    return f"array_to_string({long_words_sql(letters, 1)}, ' ')"


def gate_words_sql(text: str) -> str:
    kept = replace_sql(text, NOT_WHITELISTED)
    return rf"list_filter(regexp_split_to_array({kept}, '\s+'), lambda w: length(w) > 2)"


def tokens_sql(text: str) -> str:
    return f"string_split({text}, ' ')"


def terms_sql(tokens: str) -> str:
    """1-, 2- and 3-grams of (doc_id, w) rows, one per row with their place."""
    placed = f"(SELECT doc_id, unnest(w) AS t, generate_subscripts(w, 1) AS i FROM {tokens})"
    ahead = f"""(SELECT doc_id, i, t, lead(t) OVER o AS t2, lead(t, 2) OVER o AS t3
                 FROM {placed} WINDOW o AS (PARTITION BY doc_id ORDER BY i))"""
    return f"""(SELECT doc_id, i, 1 AS n, t AS term FROM {ahead}
        UNION ALL SELECT doc_id, i, 2, t || ' ' || t2 FROM {ahead} WHERE t2 IS NOT NULL
        UNION ALL SELECT doc_id, i, 3, t || ' ' || t2 || ' ' || t3 FROM {ahead} WHERE t3 IS NOT NULL)"""
