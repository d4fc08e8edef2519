"""Search: texts that contain a phrase, for one phrase or for a whole table of jobs."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from moodtide.functions.binding import bind
from moodtide.operators.bitmaps import bitmap, may_hold
from moodtide.operators.sizing import MAX_BROADCAST_ROWS, Size, broadcast_if_small, measure
from moodtide.sinks.files import keep
from moodtide.sources.files import spread

# Fixed values, needed for equal results.
LANGUAGE = "en"
TWEETS_LIMIT = 100

# Up to this many phrases are tested one after the other in a projection, which
# costs less than indexing the texts; measured to break even at about 200.
DIRECT_PHRASES = 128
LONGEST_GRAM = 8
SHORT = 4
SAMPLE_TEXTS = 2000
_SALTS = 64


def contains_phrase(text: Column, phrase: Column) -> Column:
    return F.contains(F.lower(text), F.lower(phrase))


def in_language(df: DataFrame, lang_col: str = "lang", language: str = LANGUAGE) -> DataFrame:
    return df.where(F.col(lang_col) == language)


def search(
    tweets: DataFrame,
    phrase: str,
    newest_first: list[str],
    limit: int = TWEETS_LIMIT,
    text_col: str = "text",
) -> DataFrame:
    """The newest `limit` texts with the phrase, in the searched language."""
    found = in_language(tweets).where(contains_phrase(F.col(text_col), F.lit(phrase)))
    return found.orderBy(*[F.desc(name) for name in newest_first]).limit(limit)


_GROUP_LIMIT = "spark.sql.optimizer.windowGroupLimitThreshold"


def top_per_group(df: DataFrame, keys: list[str], newest_first: list[str], limit: int) -> DataFrame:
    """At most `limit` newest rows per key.

    Ranked first within salted parts of each key and then among the survivors,
    so a key that holds a third of the table is spread over many tasks and its
    last task sees no more than salts x limit rows.  The salt is the same for
    all rows of an input task: the limit is known to the window, which sends
    at most `limit` rows per key and task into the first shuffle.  Spark does so up to a limit that is
    a setting of the session; it is raised here if it is lower.
    """
    conf = df.sparkSession.conf
    if int(conf.get(_GROUP_LIMIT)) < limit:
        conf.set(_GROUP_LIMIT, str(limit))
    order = [F.desc(name) for name in newest_first]
    salted = df.withColumn("_salt", F.pmod(F.spark_partition_id(), F.lit(_SALTS)))
    for part in (keys + ["_salt"], keys):
        rank = F.row_number().over(Window.partitionBy(*part).orderBy(*order))
        salted = salted.withColumn("_rank", rank).where(F.col("_rank") <= limit).drop("_rank")
    return salted.drop("_salt")


def _distinct_phrases(jobs: DataFrame, query_col: str) -> DataFrame:
    return jobs.select(F.lower(F.col(query_col)).alias("phrase")).where(F.length("phrase") > 0).distinct()


def _words(text: Column) -> Column:
    """What stands between spaces."""
    return F.split(text, " ")


def _grams(text: Column, size: int) -> Column:
    """Distinct runs of `size` characters, at every position of the text."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(rf"(?s)(?=(.{{{size}}}))"), 1))


def _gram_size(piece: Column) -> Column:
    """Length of the character runs of a piece: the largest power of two that fits, so words are cut in few ways."""
    size = F.lit(LONGEST_GRAM)
    for shorter in (4, 2, 1):
        size = F.when(F.length(piece) < 2 * shorter, shorter).otherwise(size)
    return size


def _piece_grams(piece: Column) -> Column:
    """Distinct runs of a piece, as long as the piece allows."""
    starts = F.sequence(F.lit(1), F.length(piece) - _gram_size(piece) + 1)
    return F.array_distinct(F.transform(starts, lambda at: F.substr(piece, at, _gram_size(piece))))


def _direct_matches(texts: DataFrame, phrases: list[str], text_col: str) -> DataFrame:
    """Test every phrase of a short list against each text, without a join."""
    listed = F.array(*[F.lit(phrase) for phrase in phrases]).cast("array<string>")
    found = bind(
        F.lower(F.col(text_col)),
        lambda lowered: F.filter(listed, lambda phrase: F.contains(lowered, phrase)),
    )
    return texts.select("*", F.explode(found).alias("phrase"))


@dataclass(frozen=True)
class Anchors:
    """How phrases are looked up in a corpus."""

    phrases: DataFrame  # phrase, gram (its anchor), and of the sampled texts: uses of the gram in words, and whether more than texts
    words: DataFrame  # the words of the corpus that hold an anchor
    sizes: list[int]


def _pieces(phrase: Column) -> Column:
    """The parts of a phrase between spaces that may serve as its anchor: long ones, if there are any."""
    every = F.filter(_words(phrase), lambda piece: F.length(piece) > 0)
    return bind(F.filter(every, lambda piece: F.length(piece) >= SHORT), lambda long: F.when(F.size(long) > 0, long).otherwise(every))


def _is_short(phrase: Column) -> Column:
    return ~F.exists(_words(phrase), lambda piece: F.length(piece) >= SHORT)


def _cut(words: DataFrame, sizes: list[int]) -> DataFrame:
    """Each word once per run of it."""
    return words.select("*", F.explode(F.concat(*[_grams(F.col("word"), size) for size in sizes])).alias("gram"))


def _chosen_anchors(texts: DataFrame, phrases: DataFrame, text_col: str, size: Size | None = None, sample: int = SAMPLE_TEXTS) -> Anchors:
    """The rarest character run of each phrase, and the words of all texts that hold one.

    A text that contains a phrase contains each run of it, so one run finds
    every match, whichever it is.  Which one is rare is counted over at most `sample` texts.
    Runs lie between spaces, hence inside words, and are sought
    in the different words of the corpus, which are few, instead of in all texts.
    """
    size = size or measure(phrases)
    lengths = F.array_distinct(F.flatten(F.collect_set(F.transform(_pieces(F.col("phrase")), _gram_size))))
    sizes = sorted(phrases.agg(lengths).first()[0]) or [LONGEST_GRAM]
    words = F.array_distinct(_words(F.lower(F.col(text_col))))
    # A null more per text, so that the null word counts the texts.
    each = texts.limit(sample).select(F.explode(F.array_append(words, F.lit(None).cast("string"))).alias("word"))
    seen = keep(each.groupBy("word").agg(F.count(F.lit(1)).alias("uses")), "sampled-words")
    runs = phrases.select("phrase", F.explode(_pieces(F.col("phrase"))).alias("piece"))
    runs = runs.select("phrase", F.explode(_piece_grams(F.col("piece"))).alias("gram")).distinct()
    uses = _cut(seen.where(F.length("word") > 0), sizes).groupBy("gram").agg(F.sum("uses").alias("uses"))
    # Among equals the last in the alphabet.
    used = F.coalesce("uses", F.lit(0).cast("bigint"))
    rarest = F.max_by(F.struct("gram", used.alias("uses")), F.struct(-used, "gram"))
    chosen = runs.join(uses, "gram", "left").groupBy("phrase").agg(rarest.alias("rarest")).select("phrase", "rarest.*")
    rows = seen.where(F.col("word").isNull()).agg(F.coalesce(F.max("uses"), F.lit(1)).alias("texts")).scalar()
    anchors = keep(chosen.select("*", (F.col("uses") >= rows).alias("frequent")), "anchors")
    every = texts.select(F.explode(words).alias("word")).where(F.length("word") > 0).distinct()
    fewer = Size(size.rows, 4 * LONGEST_GRAM * size.rows)
    hit = _cut(every, sizes).join(broadcast_if_small(anchors.select("gram").distinct(), fewer), "gram").select("word")
    return Anchors(anchors, hit, sizes)


def _candidate_grams(lowered: DataFrame, anchors: Anchors) -> DataFrame:
    """Each row once per run of each of its words that hold an anchor, as `gram`.

    A bitmap tells those words apart before they are cut into runs.
    """
    words = lowered.select("*", F.explode_outer(F.array_distinct(_words(F.col("_lowered")))).alias("_word"))
    hits = words.where(may_hold(bitmap(anchors.words, "word"), F.col("_word")))
    return hits.select("*", F.explode(F.concat(*[_grams(F.col("_word"), size) for size in anchors.sizes])).alias("gram"))


def _shuffled_matches(texts: DataFrame, anchors: Anchors, phrases: DataFrame, text_col: str, id_col: str) -> DataFrame:
    """Equi-join on the anchors of `phrases` (phrase, gram), then verify.

    Only ids and runs of words that hold an anchor are shuffled; texts rejoin the surviving pairs.
    Rows that share an id, or have none, are candidates together and verified one by one.
    """
    lowered = texts.withColumn("_lowered", F.lower(F.col(text_col)))
    slim = lowered.select(F.col(id_col).alias("_id"), "_lowered")
    pairs = _candidate_grams(slim, anchors).select("_id", "gram").join(phrases, "gram").select("_id", "phrase").distinct()
    candidates = lowered.join(pairs, lowered[id_col].eqNullSafe(pairs["_id"]))
    return candidates.where(F.contains(F.col("_lowered"), F.col("phrase"))).select(*texts.columns, "phrase")


def _broadcast_matches(texts: DataFrame, phrases: DataFrame, text_col: str, gram_sizes: list[int]) -> DataFrame:
    """Equi-join on one character run of each phrase, with the phrases in every task, then verify.

    The run shared with the fewest other phrases is taken, which keeps the
    number of candidates per text low.  Runs have up to `LONGEST_GRAM` characters; texts are cut into runs of each
    length in use, so a phrase of one letter does not shorten the others' runs.  Nothing is shuffled.
    """
    runs = phrases.select("phrase", F.explode(_piece_grams(F.col("phrase"))).alias("gram"))
    shared = runs.groupBy("gram").agg(F.count(F.lit(1)).alias("sharing"))
    # Among equals the last in the alphabet: runs with spaces, the most common in texts, come first.
    anchors = (
        runs.join(shared, "gram")
        .groupBy("phrase")
        .agg(F.max_by("gram", F.struct(-F.col("sharing"), "gram")).alias("gram"))
    )
    lowered = texts.withColumn("_lowered", F.lower(F.col(text_col)))
    gram = F.explode(F.concat(*[_grams(F.col("_lowered"), size) for size in gram_sizes])).alias("gram")
    candidates = lowered.select("*", gram).join(F.broadcast(anchors), "gram").drop("gram")
    return candidates.where(F.contains(F.col("_lowered"), F.col("phrase"))).drop("_lowered")


def match_phrases(
    texts: DataFrame,
    jobs: DataFrame,
    text_col: str = "text",
    id_col: str = "doc_id",
    query_col: str = "query",
    direct_phrases: int = DIRECT_PHRASES,
    broadcast_rows: int = MAX_BROADCAST_ROWS,
) -> DataFrame:
    """Each text once per distinct job phrase that it contains, as column `phrase`.

    Phrases and texts are compared in lower case.  Few phrases are tested one by
    one, more are broadcast by a character run of each.  Phrases beyond a broadcast are looked up by
    anchors, but for those of short words and those whose anchor is more frequent than texts: they would
    shuffle nearly every text, and up to `DIRECT_PHRASES` of them are still tested one by one.  Every way is exact.
    """
    phrases = _distinct_phrases(jobs, query_col)
    size = measure(phrases, gram_sizes=F.sort_array(F.collect_set(_gram_size(F.col("phrase")))))
    if size.rows <= direct_phrases:
        return _direct_matches(texts, sorted(row["phrase"] for row in phrases.collect()), text_col)
    if size.fits_broadcast(max_rows=broadcast_rows):
        return _broadcast_matches(texts, phrases, text_col, size.extra["gram_sizes"] or [LONGEST_GRAM])
    # Those of spaces only have no anchor; of the short ones the shortest come first.
    short = phrases.where(_is_short(F.col("phrase")))
    blank = F.length(F.trim("phrase")) == 0
    worded = short.where(~blank).orderBy(F.length("phrase"), "phrase").limit(DIRECT_PHRASES)
    listed = [row["phrase"] for row in short.where(blank).unionByName(worded).collect()]
    long_phrases = phrases.where(~F.col("phrase").isin(listed))
    anchors = _chosen_anchors(texts, long_phrases, text_col, size)
    room = max(DIRECT_PHRASES - len(listed), 0)
    frequent = anchors.phrases.where("frequent").orderBy(F.desc("uses"), "phrase").limit(room)
    listed = sorted(listed + [row["phrase"] for row in frequent.collect()])
    others = anchors.phrases.select("phrase", "gram").where(~F.col("phrase").isin(listed))
    found = _shuffled_matches(texts, anchors, others, text_col, id_col)
    return found.unionByName(_direct_matches(texts, listed, text_col)) if listed else found


def fan_out(
    tweets: DataFrame,
    jobs: DataFrame,
    newest_first: list[str],
    limit: int = TWEETS_LIMIT,
    text_col: str = "text",
    id_col: str = "doc_id",
    direct_phrases: int = DIRECT_PHRASES,
) -> DataFrame:
    """Every job with its own newest tweets, at most `limit` per job.

    Jobs that ask for the same phrase share one search: the limit is applied
    per phrase, and only the survivors are copied to the jobs.  Ids are ranked without
    their texts, which the survivors fetch afterwards; equal rows are told apart by nothing and fetch one another's.
    """
    searched = in_language(tweets)
    print_of = F.xxhash64(*[F.col(f"`{name}`") for name in tweets.columns]).alias("_print")
    slim = list(dict.fromkeys([id_col, *newest_first]))
    found = match_phrases(searched, jobs, text_col, id_col, direct_phrases=direct_phrases).select(*slim, print_of, "phrase")
    newest = keep(top_per_group(found, ["phrase"], newest_first, limit).select(F.col(id_col).alias("_id"), "_print", "phrase"), "newest")
    wanted = newest.select("_id", "_print").distinct()
    marked = searched.select("*", print_of)
    same = marked[id_col].eqNullSafe(F.col("_id")) & (marked["_print"] == wanted["_print"])
    rows = marked.join(broadcast_if_small(wanted), same, "left_semi").dropDuplicates(["_print", id_col]).withColumnRenamed("_print", "_own")
    texts = rows.join(newest, rows[id_col].eqNullSafe(F.col("_id")) & (F.col("_own") == F.col("_print"))).drop("_id", "_print", "_own")
    return texts.join(broadcast_if_small(jobs), F.lower(F.col("query")) == F.col("phrase")).drop("phrase")
