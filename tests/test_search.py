"""Gate, search, fan-out and the registry."""

import random

import pytest
from pyspark.sql import functions as F

from moodtide.functions.jobkeys import decode_job_id, directory_of, job_type_error, query_error
from moodtide.functions.timestamps import drop_zone, within_age
from moodtide.operators import search
from moodtide.operators.gate import content_gate, observed_gate
from moodtide.operators.registry import analysed_jobs, files_of_job, job_status
from moodtide.operators.sizing import Size, broadcast_if_small, measure

GATE = {
    "one two three four five": (True, False),
    "one two three four five six": (True, True),
    "I can't won't really stop-now \"ok\" yes": (True, False),
    "é日本 abc def ghi jkl mno": (True, False),
    "one two three four": (False, False),
    None: (False, False),
}


def test_gate(spark):
    frame = spark.createDataFrame([(text,) for text in GATE], "text string").withColumn("raw", F.col("text"))
    for index, words in enumerate((5, 6)):
        kept = {row["raw"] for row in content_gate(frame, min_words=words).collect()}
        assert kept == {text for text, passes in GATE.items() if passes[index]}
    texts = {row["raw"]: row["text"] for row in content_gate(frame).collect()}
    assert texts["I can't won't really stop-now \"ok\" yes"] == "cant wont really stopnow yes"


def test_gate_runs_its_regexes_once(spark):
    frame = spark.createDataFrame([("a b c",)], "text string")
    plan = content_gate(frame)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace") == 1


def test_observed_gate(spark):
    frame = spark.createDataFrame([(text,) for text in GATE], "text string")
    gated, before, after = observed_gate(frame)
    gated.collect()
    assert (before.get["rows"], after.get["rows"]) == (6, 4)


def _corpus(spark, seed):
    rng = random.Random(seed)
    words = ["cat", "Cats", "dog", "the", "bird", "sky", "Real", "donald", "x", "aaaa"]
    texts = [(i, "en", " ".join(rng.choices(words, k=rng.randint(0, 12)))) for i in range(300)]
    queries = ["cat", "the dog", "aaaa", "cats SKY", "donald", "zzzz", "real donald", "THE DOG", "a", ""]
    jobs = [(f"j{i}", query, "2021-01-01 00:00:00") for i, query in enumerate(queries)]
    return (
        texts,
        jobs,
        spark.createDataFrame(texts, "doc_id long, lang string, text string").repartition(5),
        spark.createDataFrame(jobs, "job_id string, query string, created_at string"),
    )


@pytest.mark.parametrize("direct", [64, 0])
@pytest.mark.parametrize("broadcast", [True, False])
def test_fan_out_equals_brute_force(spark, monkeypatch, direct, broadcast):
    if not broadcast:
        monkeypatch.setattr(Size, "fits_broadcast", lambda self, **_: False)
    texts, jobs, tweets, jobs_frame = _corpus(spark, 7)
    out = search.fan_out(tweets, jobs_frame, ["doc_id"], limit=9, direct_phrases=direct)
    found = sorted((row["job_id"], row["doc_id"]) for row in out.collect())
    expected = []
    for job_id, query, _ in jobs:
        hits = sorted((i for i, _, text in texts if query and query.lower() in text.lower()), reverse=True)
        expected += [(job_id, i) for i in hits[:9]]
    assert found == sorted(expected)


def test_phrases_with_regex_characters(spark):
    tweets = spark.createDataFrame([(1, "a.b (c) [d] \\e $1 ünï 😀 end"), (2, "aXb")], "doc_id long, text string")
    queries = ["a.b", "(c) [", "\\e $1", "ünï 😀", "NÏ"]
    jobs = spark.createDataFrame([(q,) for q in queries], "query string")
    for direct in (64, 0):
        rows = search.match_phrases(tweets, jobs, direct_phrases=direct).collect()
        assert sorted((row["doc_id"], row["phrase"]) for row in rows) == sorted((1, q.lower()) for q in queries)


def test_no_cross_join_in_fan_out(spark, sf):
    from moodtide.queries import QUERIES

    for name in ("job_fanout", "match_phrases", "match_phrases_indexed"):
        plan = QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_limit_is_cut_before_the_shuffle(spark):
    rows = spark.range(10_000).select(F.lit("hot").alias("k"), F.col("id"))
    top = search.top_per_group(rows, ["k"], ["id"], 3)
    assert sorted(row["id"] for row in top.collect()) == [9997, 9998, 9999]
    assert "WindowGroupLimit" in top._jdf.queryExecution().executedPlan().toString()


def test_any_limit_is_cut_before_the_shuffle(spark):
    rows = spark.range(10_000).select(F.lit("hot").alias("k"), F.col("id"))
    top = search.top_per_group(rows, ["k"], ["id"], 5_000)
    assert top.count() == 5_000
    assert "WindowGroupLimit" in top._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("ways", [{}, {"direct_phrases": 0}, {"direct_phrases": 0, "broadcast_rows": -1}])
def test_phrases_of_all_lengths_and_shared_ids(spark, ways):
    rows = [(1, "a long sentence here"), (1, "a long sentence here"), (None, "Sentence"), (2, ""), (3, None)]
    texts = spark.createDataFrame(rows, "doc_id long, text string")
    queries = ["a", "e", "se", "sentence", "long sentence", "", None]
    jobs = spark.createDataFrame([(query,) for query in queries], "query string")
    found = search.match_phrases(texts, jobs, **ways).select("doc_id", "phrase").collect()
    expected = [(i, query) for i, text in rows for query in queries if query and query in (text or "").lower()]
    assert sorted(map(str, map(tuple, found))) == sorted(map(str, expected))
    assert search.match_phrases(texts, jobs.where("query = ''"), **ways).count() == 0


_WAYS = [{}, {"direct_phrases": 0}, {"direct_phrases": 0, "broadcast_rows": -1}]


@pytest.mark.parametrize("ways", _WAYS)
def test_phrases_at_any_place_of_a_word(spark, ways):
    rng = random.Random(11)
    words = ["concatenate", "cat", "cats", "catty", "doğa", "the", "tree", "x", "xx", "a-b", "line\nbreak", "tab\tbed"]
    texts = [(i, (" " * rng.randint(1, 3)).join(rng.choices(words, k=rng.randint(0, 9)))) for i in range(200)]
    texts += [(3, "cat catty concatenate cats"), (None, " leading and trailing "), (5, "   ")]
    queries = ["cat", "CAT", "enat", "e c", "s the", "cat cats", "ts the tr", "x", " x", "x ", " ", "  ", "a-b", "line\nbreak", "bed", "e  t", "zzz cat", "ğa"]
    frame = spark.createDataFrame(texts, "doc_id long, text string").repartition(4)
    jobs = spark.createDataFrame([(query,) for query in queries], "query string")
    found = search.match_phrases(frame, jobs, **ways)
    assert found.columns == ["doc_id", "text", "phrase"]
    expected = [(i, text, phrase) for i, text in texts for phrase in {query.lower() for query in queries} if phrase in text.lower()]
    assert sorted(map(str, map(tuple, found.collect()))) == sorted(map(str, expected))


def test_anchor_is_the_rarest_run_of_the_corpus(spark):
    texts = spark.createDataFrame([(i, "common words everywhere") for i in range(30)] + [(99, "common unusual")], "doc_id long, text string")
    phrases = spark.createDataFrame([("common unusual",), ("common nowhere",), ("words",)], "phrase string")
    anchors = search._chosen_anchors(texts, phrases, "text")
    chosen = {row["phrase"]: (row["gram"], row["uses"]) for row in anchors.phrases.collect()}
    assert [row["phrase"] for row in anchors.phrases.where("frequent").collect()] == []
    assert chosen["common unusual"][1] == 1 and chosen["common unusual"][0] in "unusual"
    assert chosen["common nowhere"][1] == 0 and chosen["common nowhere"][0] in "nowhere"
    assert {row["word"] for row in anchors.words.collect()} == {"unusual", "words"}


def test_words_without_an_anchor_are_not_cut(spark):
    texts = spark.createDataFrame([(i, "many other words here " * 5) for i in range(50)] + [(77, "needle")], "doc_id long, text string")
    anchors = search._chosen_anchors(texts, spark.createDataFrame([("needle",)], "phrase string"), "text")
    lowered = texts.withColumn("_lowered", F.lower("text"))
    assert {row["_word"] for row in search._candidate_grams(lowered, anchors).select("_word").collect()} == {"needle"}


def test_equal_rows_are_all_found(spark):
    tweets = spark.createDataFrame([(1, "en", "big cat")] * 3 + [(2, "en", "cat"), (None, "en", "cat"), (2, "en", "cat")], "doc_id long, lang string, text string")
    jobs = spark.createDataFrame([("j", "cat", "2021"), ("k", "CAT", "2021")], "job_id string, query string, created_at string")
    for direct in (64, 0):
        found = search.fan_out(tweets, jobs, ["doc_id"], direct_phrases=direct)
        assert sorted(row["job_id"] for row in found.collect()) == ["j"] * 6 + ["k"] * 6
        few = search.fan_out(tweets, jobs, ["doc_id"], limit=3, direct_phrases=direct)
        assert sorted((row["job_id"], row["doc_id"], row["text"]) for row in few.collect()) == sorted(
            (job, i, text) for job in "jk" for i, text in ((2, "cat"), (2, "cat"), (1, "big cat"))
        )


def test_texts_are_not_ranked(spark, sf):
    """Between the match and the survivors only ids are shuffled."""
    rows = spark.range(100).select(F.col("id").alias("doc_id"), F.lit("en").alias("lang"), F.lit("a text").alias("text"))
    slim = rows.select("doc_id", F.lit("p").alias("phrase"))
    plan = search.top_per_group(slim, ["phrase"], ["doc_id"], 3)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "text" not in plan.split("Exchange")[1]


def test_a_low_group_limit_of_the_session_is_raised(spark):
    before = spark.conf.get(search._GROUP_LIMIT)
    spark.conf.set(search._GROUP_LIMIT, "10")
    try:
        rows = spark.range(1000).select(F.lit("hot").alias("k"), F.col("id"))
        plan = search.top_per_group(rows, ["k"], ["id"], 50)._jdf.queryExecution().executedPlan().toString()
        assert "WindowGroupLimit" in plan
    finally:
        spark.conf.set(search._GROUP_LIMIT, before)


def test_analysed_jobs_leave_out_failed_ones(spark):
    paths = spark.createDataFrame([("jobs/a/meta.json",), ("jobs/b/results.csv",), ("jobs/c/meta.json",), ("jobs/c/_error",)], "path string")
    failures = spark.createDataFrame([("b", "x"), ("z", "y")], "job_id string, message string")
    assert sorted(row["job_id"] for row in analysed_jobs(paths).collect()) == ["a", "b"]
    assert [row["job_id"] for row in analysed_jobs(paths, failures).collect()] == ["a"]


def test_broadcast_needs_a_small_table(spark):
    frame = spark.range(10).select(F.lit("abc").alias("t"))
    assert measure(frame) == Size(10, 30)
    assert "ResolvedHint" in broadcast_if_small(frame)._jdf.queryExecution().analyzed().toString()
    large = broadcast_if_small(frame, Size(10**9, 10**12))
    assert "ResolvedHint" not in large._jdf.queryExecution().analyzed().toString()


def test_query_errors(values):
    hundred = " ".join(["word"] * 100)
    cases = ["cat", "a-b cats", "real donald trump", hundred, "", "١٢٣٤ fünf", "١٢٣٤"]
    assert values(query_error, cases) == [
        "Word should have more than 4 characters.",
        "String includes invalid characters.",
        None,
        "Number of words should be less than 100.",
        "Word should have more than 4 characters.",
        "String includes invalid characters.",
        None,
    ]
    assert values(job_type_error, ["batch", "stream", "x", None]) == [None, None] + ["Job type is invalid value."] * 2


def test_job_ids_and_paths(values):
    assert values(decode_job_id, ["base64:aGVsbG8=", "hello", "test_8"]) == ["hello", "hello", "test_8"]
    assert values(directory_of, ["jobs/a/meta.json", "meta.json"]) == ["jobs/a", ""]


def test_job_status(spark):
    files = {"d": ["meta.json", "results.csv"], "p": ["meta.json"], "e": ["meta.json", "results.csv", "_error"]}
    paths = spark.createDataFrame([(f"jobs/{job}/{name}",) for job, names in files.items() for name in names], "path string")
    jobs = spark.createDataFrame([(job,) for job in "dpem"], "job_id string")
    assert {tuple(row) for row in job_status(jobs, paths).collect()} == {
        ("d", "done"), ("p", "in_progress"), ("e", "error"), ("m", "missing"),
    }
    assert files_of_job(paths, "d").count() == 2


def test_prefix_listing(spark):
    paths = spark.createDataFrame([("jobs/cat/meta.json",), ("jobs/cats/meta.json",)], "path string")
    assert files_of_job(paths, "cat").count() == 1
    assert files_of_job(paths, "cat", exact=False).count() == 2


def test_times(values):
    texts = ["2021-02-02 09:17:35 UTC", "2021-02-02 09:17:35", "nonsense", None]
    assert values(drop_zone, texts) == ["2021-02-02 09:17:35"] * 2 + [None, None]
    now = F.lit("2021-02-02T09:18:35Z")
    events = ["2021-02-02T09:17:35Z", "2021-02-02T09:17:34.999Z", "2021-02-02T09:18:36Z"]
    assert values(lambda c: within_age(c, 60, now), events) == [True, False, True]
