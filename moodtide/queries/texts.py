"""Text functions and the content gate."""

from __future__ import annotations

from pyspark.ml.feature import Tokenizer
from pyspark.sql import functions as F

from moodtide.functions.cleaning import clean_text, expand_negations, letters_only, strip_mentions_links
from moodtide.functions.html import html_text
from moodtide.functions.stemming import stem_words
from moodtide.functions.stopped import STOP_WORDS, second_clean, stopped_text, strip_at_signs, strip_http
from moodtide.functions.words import join_words, whitelist, word_character_tokens, words_longer_than
from moodtide.operators.gate import STREAM_MIN_WORDS, content_gate, gate_counts, not_empty
from moodtide.queries.base import (
    TWEETS_SQL,
    clean_sql,
    documents,
    gate_words_sql,
    html_text_sql,
    long_words_sql,
    negations_sql,
    query,
    replace_sql,
    strip_links_sql,
    tweets,
)
from moodtide.sources.files import spread, table


@query(
    "clean_by_lang",
    f"""
    SELECT lang, count(*) AS kept, sum(words)::BIGINT AS words_left
    FROM (SELECT lang, len(list_filter(string_split({clean_sql("text")}, ' '), lambda w: w <> ''))::BIGINT AS words
          FROM (SELECT lang, array_to_string(w, ' ') AS text
                FROM (SELECT lang, {gate_words_sql("text")} AS w FROM documents) WHERE len(w) >= 5))
    GROUP BY lang""",
)
def clean_by_lang(spark, sf):
    """Flagship: gate, clean, and count what is left per language."""
    gated = content_gate(documents(spark, sf, "lang", "text"))
    cleaned = gated.select("lang", clean_text(F.col("text")).alias("text"))
    spaces = F.length("text") - F.length(F.replace("text", F.lit(" "), F.lit("")))
    words = F.when(F.col("text") == "", 0).otherwise(spaces + 1)
    return cleaned.groupBy("lang").agg(
        F.count(F.lit(1)).alias("kept"), F.sum(words.cast("bigint")).alias("words_left")
    )


@query("html_text", f"SELECT page_id, {html_text_sql('html')} AS text FROM pages")
def html_text_of_pages(spark, sf):
    return spread(table(spark, sf, "pages").select("page_id", "html")).select("page_id", html_text(F.col("html")).alias("text"))


@query("strip_mentions_links", f"SELECT doc_id, {strip_links_sql('text')} AS text FROM {TWEETS_SQL}")
def mentions_and_links(spark, sf):
    return tweets(spark, sf).select("doc_id", strip_mentions_links(F.col("text")).alias("text"))


@query("negations", f"SELECT doc_id, {negations_sql('lower(text)')} AS text FROM {TWEETS_SQL}")
def negations(spark, sf):
    return tweets(spark, sf).select("doc_id", expand_negations(F.lower("text")).alias("text"))


@query("letters_only", f"SELECT doc_id, {replace_sql('text', '[^a-zA-Z]', ' ')} AS text FROM {TWEETS_SQL}")
def letters(spark, sf):
    return tweets(spark, sf).select("doc_id", letters_only(F.col("text")).alias("text"))


@query("clean_text", f"SELECT doc_id, {clean_sql('text')} AS text_clean FROM {TWEETS_SQL}")
def clean_tweets(spark, sf):
    return tweets(spark, sf).select("doc_id", clean_text(F.col("text")).alias("text_clean"))


@query("clean_pages", f"SELECT page_id, {clean_sql('html')} AS text_clean FROM pages")
def clean_pages(spark, sf):
    return spread(table(spark, sf, "pages").select("page_id", "html")).select("page_id", clean_text(F.col("html")).alias("text_clean"))


@query(
    "whitelist_words",
    f"SELECT doc_id, array_to_string({gate_words_sql('text')}, ' ') AS text FROM {TWEETS_SQL}",
)
def whitelist_words(spark, sf):
    kept = join_words(words_longer_than(whitelist(F.col("text")), 2))
    return tweets(spark, sf).select("doc_id", kept.alias("text"))


_STOPS_SQL = "[" + ", ".join("'" + word.replace("'", "''") + "'" for word in STOP_WORDS) + "]"


def _stopped_sql(text: str) -> str:
    no_links = replace_sql(f"replace({text}, '@', '')", r"http\S+")
    parts = f"string_split(lower({replace_sql(no_links, '[^a-zA-Z]', ' ')}), ' ')"
    return f"list_filter({parts}, lambda w: w <> '' AND NOT list_contains({_STOPS_SQL}, w))"


@query("strip_at_http", "SELECT doc_id, " + replace_sql("replace(text, '@', '')", r"http\S+") + f" AS text FROM {TWEETS_SQL}")
def at_signs_and_http(spark, sf):
    return tweets(spark, sf).select("doc_id", strip_http(strip_at_signs(F.col("text"))).alias("text"))


@query("stop_words", f"SELECT doc_id, array_to_string({_stopped_sql('text')}, ' ') AS text FROM {TWEETS_SQL}")
def stop_words(spark, sf):
    return tweets(spark, sf).select("doc_id", stopped_text(F.col("text")).alias("text"))


@query(
    "second_clean_nostem",
    "SELECT doc_id, array_to_string(list_filter("
    + _stopped_sql("text")
    + f", lambda v: length(v) > 3), ' ') AS text_clean FROM {TWEETS_SQL}",
)
def second_clean_nostem(spark, sf):
    return second_clean(tweets(spark, sf).select("doc_id", "text"), stems=False).select("doc_id", "text_clean")


_MENTIONS_SQL = "(SELECT event_id, CASE WHEN user_id % 3 = 0 THEN '@u' || CAST(user_id AS VARCHAR) ELSE event_type || ' ' || props END AS text FROM events)"


@query("not_empty", f"SELECT event_id, text_clean FROM (SELECT event_id, {clean_sql('text')} AS text_clean FROM {_MENTIONS_SQL}) WHERE text_clean <> ''")
def not_empty_texts(spark, sf):
    """Texts of which something is left; those of a mention alone are not."""
    mention = F.concat(F.lit("@u"), F.col("user_id").cast("string"))
    text = F.when(F.col("user_id") % 3 == 0, mention).otherwise(F.concat("event_type", F.lit(" "), "props"))
    cleaned = table(spark, sf, "events").select("event_id", clean_text(text).alias("text_clean"))
    return not_empty(cleaned)


@query("second_clean")
def second_clean_stemmed(spark, sf):
    return second_clean(tweets(spark, sf).select("doc_id", "text")).select("doc_id", "text_clean")


@query("stem_words")
def stems(spark, sf):
    """Stem counts of all documents."""
    stemmed = documents(spark, sf, "text").select(stem_words(clean_text(F.col("text"))).alias("text"))
    return (
        stemmed.select(F.explode(F.split("text", " ")).alias("stem"))
        .groupBy("stem")
        .agg(F.count(F.lit(1)).alias("cnt"))
    )


@query(
    "tokenize",
    f"""SELECT doc_id, len(string_split(lower(t), ' '))::BIGINT AS n_tokens,
               array_to_string(string_split(lower(t), ' '), '|') AS tokens,
               array_to_string(list_filter(string_split(t, ' '), lambda w: length(w) >= 2), '|') AS word_tokens
        FROM (SELECT doc_id, {clean_sql('text')} AS t FROM {TWEETS_SQL})""",
)
def tokenize(spark, sf):
    """White-space tokens and word tokens of the cleaned text."""
    cleaned = tweets(spark, sf).select("doc_id", clean_text(F.col("text")).alias("t"))
    tokens = Tokenizer(inputCol="t", outputCol="w").transform(cleaned)
    return tokens.select(
        "doc_id",
        F.size("w").cast("bigint").alias("n_tokens"),
        F.array_join("w", "|").alias("tokens"),
        F.array_join(word_character_tokens(F.col("t")), "|").alias("word_tokens"),
    )


def _gate_sql(min_words: int) -> str:
    return f"""SELECT doc_id, array_to_string(w, ' ') AS text
        FROM (SELECT doc_id, {gate_words_sql('text')} AS w FROM documents) WHERE len(w) >= {min_words}"""


@query("gate_batch", _gate_sql(5))
def gate_batch(spark, sf):
    return content_gate(documents(spark, sf, "doc_id", "text"))


@query("gate_stream", _gate_sql(6))
def gate_stream(spark, sf):
    return content_gate(documents(spark, sf, "doc_id", "text"), min_words=STREAM_MIN_WORDS)


@query(
    "gate_counts",
    f"""SELECT role, count(*) AS before_filtering, count(*) FILTER (WHERE len({gate_words_sql('text')}) >= 5) AS after_filtering
        FROM conversations GROUP BY role""",
)
def gate_counts_by_role(spark, sf):
    return gate_counts(table(spark, sf, "conversations"), "role")
