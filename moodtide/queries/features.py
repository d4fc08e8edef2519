"""Tokens, n-grams, vocabulary and counts."""

from __future__ import annotations

from pyspark.sql import functions as F

from moodtide.functions.cleaning import clean_text
from moodtide.functions.words import lower_tokens
from moodtide.operators.features import all_ngrams, ngram_vocabulary, term_counts
from moodtide.queries.base import clean_sql, documents, query, terms_sql, tokens_sql


def _tokens(spark, sf):
    cleaned = documents(spark, sf, "doc_id", "text").select("doc_id", clean_text(F.col("text")).alias("text_clean"))
    return cleaned.select("doc_id", lower_tokens(F.col("text_clean")).alias("w"))


def _terms(spark, sf):
    return _tokens(spark, sf).select("doc_id", all_ngrams(F.col("w")).alias("c_words"))


_TOKENS_SQL = f"(SELECT doc_id, {tokens_sql(clean_sql('text'))} AS w FROM documents)"
_TERMS_SQL = terms_sql(_TOKENS_SQL)


@query(
    "ngrams",
    f"SELECT doc_id, count(*) AS n_terms, string_agg(term, '|' ORDER BY n, i) AS c_words FROM {_TERMS_SQL} GROUP BY doc_id",
)
def ngrams_of_documents(spark, sf):
    return _terms(spark, sf).select(
        "doc_id", F.size("c_words").cast("bigint").alias("n_terms"), F.array_join("c_words", "|").alias("c_words")
    )


@query("vocab_topk", f"SELECT term, count(*) AS cnt FROM {_TERMS_SQL} GROUP BY term ORDER BY cnt DESC, term LIMIT 80000")
def vocab_topk(spark, sf):
    return ngram_vocabulary(_tokens(spark, sf), "w")


@query("term_counts", f"SELECT doc_id, term, count(*) AS cnt FROM {_TERMS_SQL} GROUP BY doc_id, term")
def counts_per_document(spark, sf):
    texts = documents(spark, sf, "doc_id", "text")
    return term_counts(texts, "doc_id", all_ngrams(lower_tokens(clean_text(F.col("text")))))
