"""Single projections, filters and scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from moodtide.functions.timestamps import age_seconds, drop_zone, format_timestamp, parse_timestamp
from moodtide.functions.words import matches_query_characters, word_count
from moodtide.operators.features import ngrams
from moodtide.operators.gate import observed_gate
from moodtide.operators.metrics import accuracy, class_report, confusion, confusion_matrix
from moodtide.operators.records import replace_tweet_text, result_lines, sentiment_rows
from moodtide.operators.splits import recode_label, split_label
from moodtide.queries.base import MESSAGES_SQL, TWEET_TIME_SQL, documents, gate_words_sql, labelled, message_rows, query, tweet_time
from moodtide.sources.files import table, typed_tweets



@query(
    "project_typed",
    f"""SELECT (n_chars % 7)::INTEGER AS replies_count, (n_chars % 11)::INTEGER AS retweets_count,
               (n_chars % 13)::INTEGER AS likes_count, text, {TWEET_TIME_SQL} AS dt
        FROM documents WHERE text IS NOT NULL""",
)
def project_typed(spark, sf):
    """Collected columns renamed and typed."""
    raw = table(spark, sf, "documents").select(
        F.col("text").alias("tweet"),
        tweet_time().alias("datetime"),
        *[
            (F.col("n_chars") % base).cast("int").alias(name)
            for name, base in (("replies_count", 7), ("retweets_count", 11), ("likes_count", 13))
        ],
    )
    return typed_tweets(raw).withColumn("dt", format_timestamp(F.col("dt")))


@query(
    "nested_update",
    f"SELECT lower(text) AS text, created_at, job_id, query FROM {MESSAGES_SQL}",
)
def nested_update(spark, sf):
    changed = replace_tweet_text(message_rows(spark, sf), F.lower("tweet.text"))
    return changed.select("tweet.text", "tweet.created_at", "job_config.job_id", "job_config.query")


@query(
    "format_record",
    f"""SELECT text, created_at, (length(text) % 2 * 4)::INTEGER AS sentiment, job_id, query, job_created_at FROM {MESSAGES_SQL}""",
)
def format_record(spark, sf):
    """The output record, with a rule in place of the model."""
    scored = message_rows(spark, sf).withColumn("prediction", (F.length("tweet.text") % 2 * 4).cast("double"))
    return sentiment_rows(scored).select(
        "text",
        format_timestamp(F.col("created_at")).alias("created_at"),
        "sentiment",
        "job.job_id",
        "job.query",
        format_timestamp(F.col("job.created_at")).alias("job_created_at"),
    )


@query(
    "filter_nonnull",
    "SELECT event_id, event_type FROM events WHERE nullif(event_type, 'error') IS NOT NULL AND trim(props) <> ''",
)
def filter_nonnull(spark, sf):
    rows = table(spark, sf, "events").withColumn("known", F.nullif("event_type", F.lit("error")))
    return rows.where(F.col("known").isNotNull() & (F.trim("props") != "")).select("event_id", "event_type")


@query(
    "split_counts",
    """SELECT split, count(*) AS n, count(*) FILTER (WHERE quality = 0) AS n_negative
       FROM (SELECT CASE WHEN left(md5('100500:' || CAST(doc_id AS VARCHAR)), 8) < 'cccccccc' THEN 'train' ELSE 'test' END AS split, quality
             FROM labels) GROUP BY split""",
)
def split_counts(spark, sf):
    """Rows of each part of the split, and of one class in it, in one pass."""
    return (
        table(spark, sf, "labels")
        .groupBy(split_label(F.col("doc_id")).alias("split"))
        .agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("quality") == 0).alias("n_negative"))
    )


@query(
    "split_stable",
    """SELECT doc_id, CASE WHEN left(md5('100500:' || CAST(doc_id AS VARCHAR)), 8) < 'cccccccc' THEN 'train' ELSE 'test' END AS split
       FROM documents""",
)
def split_stable(spark, sf):
    return table(spark, sf, "documents").select("doc_id", split_label(F.col("doc_id")).alias("split"))


@query(
    "label_recode",
    "SELECT doc_id, CASE quality * 4 + toxic WHEN 0 THEN 0 WHEN 4 THEN 1 END AS target FROM labels",
)
def label_recode(spark, sf):
    """Labels outside the table become null."""
    return table(spark, sf, "labels").select("doc_id", recode_label(F.col("quality") * 4 + F.col("toxic")).alias("target"))


def _judged(spark, sf):
    """Labels with a rule as prediction: toxic texts are negative."""
    return table(spark, sf, "labels").select(
        (F.col("quality") * 4).alias("sentiment"), ((1 - F.col("toxic")) * 4).alias("prediction")
    )


_JUDGED_SQL = "(SELECT quality * 4 AS sentiment, (1 - toxic) * 4 AS prediction FROM labels)"


@query("accuracy", f"SELECT avg((sentiment = prediction)::INTEGER) AS accuracy FROM {_JUDGED_SQL}")
def accuracy_of_rule(spark, sf):
    return accuracy(_judged(spark, sf))


@query("confusion", f"SELECT sentiment AS label, prediction, count(*) AS n FROM {_JUDGED_SQL} GROUP BY ALL")
def confusion_counts(spark, sf):
    return confusion(_judged(spark, sf))


@query(
    "confusion_matrix",
    f"""SELECT sentiment AS label, count(*) FILTER (WHERE prediction = 0) AS predicted_0,
               count(*) FILTER (WHERE prediction = 4) AS predicted_4 FROM {_JUDGED_SQL} GROUP BY sentiment""",
)
def confusion_cells(spark, sf):
    return confusion_matrix(_judged(spark, sf), [0, 4])


@query(
    "class_report",
    f"""WITH c AS (SELECT cls::INTEGER AS cls,
                          (SELECT count(*) FROM {_JUDGED_SQL} WHERE sentiment = cls) AS support,
                          (SELECT count(*) FROM {_JUDGED_SQL} WHERE prediction = cls) AS predicted,
                          (SELECT count(*) FROM {_JUDGED_SQL} WHERE sentiment = cls AND prediction = cls) AS hits
                   FROM (SELECT sentiment AS cls FROM {_JUDGED_SQL} UNION SELECT prediction FROM {_JUDGED_SQL})),
             r AS (SELECT *, CASE WHEN predicted = 0 THEN 0 ELSE hits / predicted END AS p,
                          CASE WHEN support = 0 THEN 0 ELSE hits / support END AS q FROM c),
             s AS (SELECT *, CASE WHEN p + q = 0 THEN 0 ELSE 2 * p * q / (p + q) END AS f FROM r)
        SELECT class, round(precision, 9) AS precision, round(recall, 9) AS recall, round(f1, 9) AS f1, support FROM (
        SELECT CAST(cls AS VARCHAR) AS class, p AS precision, q AS recall, f AS f1, support FROM s
        UNION ALL SELECT 'macro avg', avg(p), avg(q), avg(f), sum(support)::BIGINT FROM s
        UNION ALL SELECT 'weighted avg', sum(p * support) / sum(support), sum(q * support) / sum(support),
                         sum(f * support) / sum(support), sum(support)::BIGINT FROM s)""",
)
def report(spark, sf):
    rows = class_report(_judged(spark, sf))
    return rows.select("class", *[F.round(name, 9).alias(name) for name in ("precision", "recall", "f1")], "support")


@query("first_n", "SELECT doc_id, lang FROM documents ORDER BY doc_id LIMIT 100")
def first_n(spark, sf):
    return table(spark, sf, "documents").select("doc_id", "lang").orderBy("doc_id").limit(100)


@query(
    "array_ops",
    """SELECT doc_id, len(w)::BIGINT AS n, w[len(w) // 2 + 1] AS middle,
              array_to_string(list_filter(w, lambda x: length(x) > 3), ' ') AS long_words,
              array_to_string(w[1:5], ' ') AS first_chunk, coalesce(w[5], '') AS fifth,
              array_to_string(list_concat(w, CASE WHEN len(w) >= 2 THEN list_transform(range(1, len(w)::BIGINT), lambda i: w[i] || ' ' || w[i + 1]) ELSE [] END), '|') AS with_pairs
       FROM (SELECT doc_id, string_split(text, ' ') AS w FROM documents)""",
)
def array_ops(spark, sf):
    """Filter, index, slice and concatenate word arrays."""
    rows = documents(spark, sf, "doc_id", "text").select("doc_id", F.split("text", " ").alias("w"))
    middle = F.floor(F.size("w") / 2) + 1
    return rows.select(
        "doc_id",
        F.size("w").cast("bigint").alias("n"),
        F.element_at("w", middle.cast("int")).alias("middle"),
        F.array_join(F.filter("w", lambda x: F.length(x) > 3), " ").alias("long_words"),
        F.array_join(F.slice("w", 1, 5), " ").alias("first_chunk"),
        F.coalesce(F.try_element_at("w", F.lit(5)), F.lit("")).alias("fifth"),
        F.array_join(F.concat(F.col("w"), ngrams(F.col("w"), 2)), "|").alias("with_pairs"),
    )


@query(
    "query_stats",
    r"""SELECT conv_id, turn, len(list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> ''))::BIGINT AS n_words,
               length(text) AS n_characters, regexp_full_match(text, '[a-zA-Z\d!\s@#$^&*()_+"|}{?><~]*') AS allowed
        FROM conversations""",
)
def query_stats(spark, sf):
    text = F.col("text")
    return table(spark, sf, "conversations").select(
        "conv_id",
        "turn",
        word_count(text).cast("bigint").alias("n_words"),
        F.length(text).cast("bigint").alias("n_characters"),
        matches_query_characters(text).alias("allowed"),
    )


@query(
    "reformat_ts",
    f"""SELECT doc_id, {TWEET_TIME_SQL} AS without_zone, strftime(TIMESTAMP '2021-02-02 09:17:35' + to_minutes(doc_id), '%Y/%m/%d') AS day,
               round(epoch(TIMESTAMP '2021-02-03 00:00:00') - epoch(TIMESTAMP '2021-02-02 09:17:35' + to_minutes(doc_id)), 3) AS age_s,
               CAST(NULL AS VARCHAR) AS bad
        FROM documents""",
)
def reformat_ts(spark, sf):
    """Parse, reformat, age; text that is no time gives null."""
    moment = parse_timestamp(tweet_time())
    return table(spark, sf, "documents").select(
        "doc_id",
        drop_zone(tweet_time()).alias("without_zone"),
        F.date_format(moment, "yyyy/MM/dd").alias("day"),
        F.round(age_seconds(moment, F.lit("2021-02-03 00:00:00")), 3).alias("age_s"),
        drop_zone(F.col("lang")).alias("bad"),
    )


@query(
    "format_line",
    """SELECT event_id, CASE WHEN event_type = 'error' THEN 'None' ELSE strftime(ts, '%Y-%m-%d %H:%M:%S') END
              || ', ' || CASE WHEN value < 30 THEN '0.0' ELSE '4.0' END AS value FROM events""",
)
def format_line(spark, sf):
    rows = table(spark, sf, "events").select(
        "event_id",
        F.when(F.col("event_type") != "error", F.col("ts")).alias("dt"),
        F.when(F.col("value") < 30, 0.0).otherwise(4.0).alias("prediction"),
    )
    return result_lines(rows)


@query(
    "gate_observed",
    f"""SELECT 'before_filtering' AS stage, count(*) AS n FROM documents
        UNION ALL SELECT 'after_filtering', count(*) FROM documents WHERE len({gate_words_sql('text')}) >= 5""",
)
def gate_observed(spark, sf):
    """Gate counts as a by-product of a write-free run over the documents."""
    gated, before, after = observed_gate(documents(spark, sf, "doc_id", "text"))
    gated.write.format("noop").mode("overwrite").save()
    counts = [("before_filtering", before.get["rows"]), ("after_filtering", after.get["rows"])]
    return spark.createDataFrame(counts, "stage string, n bigint")


@query("labelled_text", "SELECT doc_id, quality * 4 AS sentiment, text FROM documents JOIN labels USING (doc_id)")
def labelled_text(spark, sf):
    return labelled(spark, sf).select("doc_id", "sentiment", "text")
