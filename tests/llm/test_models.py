import zlib

import corpus_pipeline
from moodtide.llm import quotations, toxicity
from moodtide.llm.queries import QUERIES
from tests.llm.conftest import documents


def test_parse_body():
    body = "ada wrote:\n> bob wrote:\n> > first\n> > line\n> second\nmine\n\nmore"
    assert quotations.parse_body(body) == ("mine\n\nmore", [(2, "first\nline"), (1, "second")])
    assert quotations.parse_body("") == ("", [])
    assert quotations.passage_key(" A\n b ") == quotations.passage_key("a B") and quotations.passage_key(" \n") is None


def test_conversations_odd_rows(spark):
    rows = [(1, 0, "a", "Hello you"), (1, 1, "b", "> hello\n> you\nyes"), (1, 2, "a", ">> hello you\n> yes\nfine"), (1, 2, "a", "> yes\nfine")]
    rows += [(2, 0, "a", "> yes\nother"), (2, 1, "b", None), (None, None, None, "> yes\nlost"), (3, 5, "c", "")]
    found = quotations.conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert len(found) == len(rows)
    by = {(row["thread"], row["place"]): row for row in found}
    assert (by[1, 1]["parent"], by[1, 1]["depth"], by[1, 1]["text"]) == (0, 1, "yes")
    assert (by[1, 2]["parent"], by[1, 2]["root"], by[1, 2]["depth"]) == (1, 0, 2)
    assert sorted(row["position"] for row in found if row["thread"] == 1) == [0, 1, 2, 3]
    assert (by[2, 0]["parent"], by[2, 0]["n_linked"]) == (None, 1)
    assert by[None, None]["parent"] is None


def test_conversations_of_partial_quotes(spark):
    """Two of three lines, a re-wrapped part of a paragraph, and lines from around a deeper quote, against counting by hand."""
    first = "one line here\ntwo lines here\nthree lines"
    second = "> one line here\n> two lines here\nBirds sing at dawn. Cats sleep until noon. Dogs bark."
    third = "> Cats sleep\n> until noon. Dogs\n> bark.\nleft\nright\n>> three lines\nbelow"
    rows = [(1, 0, first), (1, 1, second), (1, 2, third), (1, 3, "> left\n> right\n>> three lines\n> below\nfine"), (1, 4, "> never said\nodd")]
    rows += [(2, 0, "same words"), (2, 1, "same words\nmore of it\nlast"), (2, 2, "> same words\n> more of it\nyes")]
    turns = spark.createDataFrame([(c, t, "a", text) for c, t, text in rows], "conv_id long, turn long, role string, text string")
    by = {(row["thread"], row["place"]): row for row in quotations.conversations(turns).collect()}
    assert [by[1, place]["parent"] for place in range(5)] == [None, 0, 1, 2, None]
    assert [by[1, place]["depth"] for place in range(5)] == [0, 1, 2, 3, 0]
    assert (by[2, 2]["parent"], by[2, 2]["n_linked"]) == (1, 1)


def test_toxicity_learns_and_spells(spark):
    rng = __import__("random").Random(2)
    words = ["".join(rng.choice("abcdefghilmnorstu") for _ in range(rng.randint(2, 8))) for _ in range(400)]
    texts, labels = [], []
    for number in range(600):
        own = [rng.choice(words) for _ in range(60)]
        if number % 3 == 0:
            own[10], own[40] = rng.choice(["blockhead", "nitwit"]), rng.choice(["blockhead", "nitwit"])
        texts.append(" ".join(own))
        labels.append(int(number % 3 == 0))
    scorer = toxicity.Scorer(toxicity.fit(texts[:450], labels[:450], 1 / 3))
    right = [(scorer.score(text) >= 0.5) == label for text, label in zip(texts[450:], labels[450:])]
    assert sum(right) / len(right) > 0.95
    plain = " ".join(words[:30])
    assert scorer.score(plain + " blockheads nitwitt") > scorer.score(plain)
    assert 0 <= scorer.score("") == scorer.score(None) <= 1


def test_toxicity_learns_rare_words():
    """Words of eight toxic texts each and of no other, next to common ones."""
    rng = __import__("random").Random(3)
    words = ["".join(rng.choice("abcdefghilmnorstu") for _ in range(rng.randint(2, 8))) for _ in range(400)]
    rare = ["".join(rng.choice("jkpqvwxyzäöüßñçé") for _ in range(7)) for _ in range(15)]
    texts, labels = [], []
    for number in range(900):
        own = [rng.choice(words) for _ in range(60)]
        if number % 3 == 0:
            at = number // 3 // 8
            own[10] = own[40] = rare[at] if at < len(rare) else "blockhead"
        texts.append(" ".join(own))
        labels.append(int(number % 3 == 0))
    order = rng.sample(range(900), 900)
    scorer = toxicity.Scorer(toxicity.fit([texts[at] for at in order], [labels[at] for at in order], 1 / 3))
    plain = [" ".join(rng.choice(words) for _ in range(58)) for _ in range(30)]
    assert sum(scorer.score(text) >= 0.5 for text in plain) <= 3
    for word in rare:
        assert sum(scorer.score(f"{text} {word} {word}") >= 0.5 for text in plain) >= 24, word


def test_toxicity_odd_rows(odd, nothing, spark):
    labels = spark.createDataFrame([(0, 1), (2, 0), (None, 1), (3, None), (6, 0), (0, 0)], "doc_id long, toxic int")
    rows = toxicity.toxicity(odd, labels).collect()
    assert len(rows) == odd.count() and all(0 <= row["score"] <= 1 for row in rows)
    for row in rows:
        assert row["held_out"] == (row["doc_id"] is not None and zlib.crc32(str(row["doc_id"]).encode()) % 3 == 1)
    assert toxicity.toxicity(odd, labels.where("toxic > 5")).count() == odd.count()
    assert toxicity.toxicity(nothing, labels).count() == 0


def test_pipeline(spark, sf):
    """Stages keep columns, remove only what they judge, and pack what is left."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = {row["doc_id"] for row in QUERIES["op10_quality_rules"](spark, sf).where("kept").collect()}
    after = corpus_pipeline.quality(spark, docs, sf)
    assert {row["doc_id"] for row in after.collect()} == kept and after.columns == docs.columns
    assert len(documents(spark, sf)) > len(kept)
    ids = {row["doc_id"] for row in corpus_pipeline.run(spark, sf).collect()}
    assert ids and ids < kept
