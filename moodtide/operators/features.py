"""Tokens to n-grams, vocabularies and counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from moodtide.functions.binding import bind
from moodtide.operators.bitmaps import BITS, bitmap, may_hold
from moodtide.sinks.files import keep

# Fixed values, needed for equal results.
VOCABULARY_SIZE = 80_000
LONGEST_NGRAM = 3


def _longer(runs: Column, tokens: Column, n: int) -> Column:
    """Runs of n tokens from the runs of n - 1: each takes in the token after it."""
    count = F.greatest(F.size(tokens) - (n - 1), F.lit(0))
    following = F.slice(tokens, F.lit(n), count)
    return F.zip_with(F.slice(runs, F.lit(1), count), following, lambda run, token: F.concat(run, F.lit(" "), token))


def ngrams(tokens: Column, n: int) -> Column:
    """Runs of n tokens joined by a space; none if there are fewer."""

    def grow(bound: Column) -> Column:
        runs = bound
        for size in range(2, n + 1):
            runs = _longer(runs, bound, size)
        return runs

    return bind(tokens, grow)


def all_ngrams(tokens: Column, longest: int = LONGEST_NGRAM) -> Column:
    """1-grams, then 2-grams and so on, in one array."""

    def extend(bound: Column, runs: Column, n: int) -> Column:
        """These runs and all longer ones; each length is built once."""
        if n == longest:
            return runs
        return bind(_longer(runs, bound, n + 1), lambda grown: F.concat(runs, extend(bound, grown, n + 1)))

    return bind(tokens, lambda bound: extend(bound, bound, 1))


def _terms(df: DataFrame, terms: Column) -> DataFrame:
    """One row per term.

    The outer form is taken because the inner one makes the optimizer add a
    filter on the array size, which is pushed down to the scan and computes
    every array a second time.
    """
    return df.select(F.explode_outer(terms).alias("term")).where(F.col("term").isNotNull())


def corpus_counts(df: DataFrame, terms_col: str) -> DataFrame:
    """Occurrences of each term in the corpus; combined before the shuffle, so hot terms stay cheap."""
    return _terms(df, F.col(terms_col)).groupBy("term").agg(F.count(F.lit(1)).alias("cnt"))


def _reached(counts: DataFrame, size: int) -> tuple[int, int, int]:
    """The count of the `size`-th most frequent term (0 if there are fewer), the terms above it, and those at it.

    Different counts are few, as n of them need n * n / 2 occurrences.
    """
    held = counts.groupBy("cnt").agg(F.count(F.lit(1)).alias("terms"))
    reached = held.withColumn("reached", F.sum("terms").over(Window.orderBy(F.desc("cnt"))))
    last = reached.where(F.col("reached") >= size).orderBy(F.desc("cnt")).first()
    return (last["cnt"], last["reached"] - last["terms"], last["terms"]) if last else (0, 0, 0)


def _nth_term(terms: DataFrame, held: int, n: int, most: int = 10_000) -> str:
    """The n-th of `held` distinct terms in alphabetical order.

    Found through the numbers of terms per first characters, so that no task
    ever sorts more than `most` terms.
    """
    start, left = "", terms
    while held > most:
        heads = left.groupBy(F.substring("term", 1, len(start) + 2).alias("head")).agg(F.count(F.lit(1)).alias("held"))
        placed = heads.withColumn("reached", F.sum("held").over(Window.orderBy("head")))
        here = placed.where(F.col("reached") >= n).orderBy("head").first()
        n, held = n - here["reached"] + here["held"], here["held"]
        longer = len(here["head"]) > len(start) + 1
        left = left.where(F.startswith("term", F.lit(here["head"])) if longer else F.col("term") == here["head"])
        start = here["head"]
    return left.orderBy("term").limit(n).agg(F.max("term")).first()[0]


def most_frequent(counts: DataFrame, size: int, reached: tuple[int, int, int] | None = None) -> DataFrame:
    """The `size` most frequent of counted terms (`term`, `cnt`); equal counts in alphabetical order.

    The last admitted term is found first; the rest is a filter, so the terms are neither
    sorted nor gathered.  `counts` is read several times; `reached` is what `_reached` tells of it, if known.
    """
    last, above, tied = reached or _reached(counts, size)
    if size <= 0 or above + tied <= size:
        return counts.where(F.lit(size > 0) & (F.col("cnt") >= last))
    term = _nth_term(counts.where(F.col("cnt") == last).select("term"), tied, size - above)
    return counts.where((F.col("cnt") > last) | ((F.col("cnt") == last) & (F.col("term") <= term)))


def vocabulary(df: DataFrame, terms_col: str, size: int = VOCABULARY_SIZE) -> DataFrame:
    """The most frequent terms of an array column."""
    return most_frequent(keep(corpus_counts(df, terms_col), "term-counts"), size)


def token_runs(df: DataFrame, tokens_col: str, longest: int = LONGEST_NGRAM, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per token, as `token_0`, with the tokens after it as `token_1` and so on; null beyond the last one.

    A row without tokens gives one row of nulls.  Unlike functions over arrays, what is then done with a row is compiled.
    """
    left = [F.slice(tokens_col, F.lit(at + 1), F.greatest(F.size(tokens_col) - at, F.lit(0))).alias(f"token_{at}") for at in range(longest)]
    return df.select(*keep, F.explode_outer(F.arrays_zip(*left)).alias("_run")).select(*keep, "_run.*")


def _pairs(values: Column) -> Column:
    """One hash for each two neighbours of an array of hashes."""
    count = F.greatest(F.size(values) - 1, F.lit(0))
    return F.zip_with(F.slice(values, F.lit(1), count), F.slice(values, F.lit(2), count), lambda a, b: F.xxhash64(a, b))


def _run_hashes(tokens: DataFrame, longest: int) -> DataFrame:
    """Hashes of the runs of 1 to `longest` tokens, as array columns `run_1` and so on: a run's hash comes from its two parts'."""
    out = tokens.select("tokens", F.transform("tokens", lambda token: F.xxhash64(token)).alias("run_1"))
    for n in range(2, longest + 1):
        out = out.select("*", _pairs(F.col(f"run_{n - 1}")).alias(f"run_{n}"))
    return out


def _long_counts(tokens: DataFrame, n: int, words: Column, bits: int) -> DataFrame:
    """Hashes of the runs of n tokens, of which both runs of n - 1 may be in the bitmap, and their occurrences."""
    parts = F.col(f"run_{n - 1}")
    count = F.greatest(F.size(parts) - 1, F.lit(0))
    both = F.arrays_zip(F.slice(parts, F.lit(1), count).alias("a"), F.slice(parts, F.lit(2), count).alias("b"))
    rows = _run_hashes(tokens, n - 1).select(F.explode_outer(both).alias("run")).select("run.a", "run.b")
    kept = rows.where(may_hold(words, F.col("a"), bits) & may_hold(words, F.col("b"), bits))
    return kept.groupBy(F.xxhash64("a", "b").alias("term")).agg(F.count(F.lit(1)).alias("cnt"))


def _named_counts(tokens: DataFrame, longest: int, words: Column, bits: int) -> DataFrame:
    """Terms and occurrences of the runs whose hash may be in the bitmap; of the longest runs, both of whose parts may."""
    parts = F.col(f"run_{longest - 1}")
    count = F.greatest(F.size(parts) - 1, F.lit(0))
    shorter = [F.col(f"run_{n}") for n in range(1, longest)]
    both = [F.concat(*shorter, F.slice(parts, F.lit(first), count)).alias(name) for first, name in ((1, "a"), (2, "b"))]
    rows = _run_hashes(tokens, longest - 1).select("tokens", F.posexplode_outer(F.arrays_zip(*both)).alias("at", "run"))
    rows = rows.where(may_hold(words, F.col("run.a"), bits) & may_hold(words, F.col("run.b"), bits))
    # The place in the joined arrays tells the length of the run and its first token.
    held, before, start, length = F.size("tokens"), F.lit(0), F.col("at"), F.lit(1)
    for n in range(2, longest + 1):
        before = before + F.greatest(held - (n - 2), F.lit(0))
        start = F.when(F.col("at") >= before, F.col("at") - before).otherwise(start)
        length = F.when(F.col("at") >= before, n).otherwise(length)
    term = F.array_join(F.slice("tokens", start + 1, length), " ")
    return rows.select(term.alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("cnt"))


def ngram_vocabulary(
    df: DataFrame,
    tokens_col: str,
    size: int = VOCABULARY_SIZE,
    longest: int = LONGEST_NGRAM,
    bits: int = BITS,
    written: bool = False,
) -> DataFrame:
    """The most frequent 1- to `longest`-grams of an array of tokens.

    A run is at most as frequent as its parts, and the `size`-th count among
    the shorter runs is one that the last admitted term must reach.  So a run is
    counted only if both runs of one token less in it reach that count, which a
    bitmap tells before anything is combined; the others are never shuffled.
    Runs below the longest are first counted by hashes of eight bytes, and spelled
    out and counted by their text only if they reach the bound.  So a clash of
    hashes changes no count, and one that lifts the bound too far is noticed.
    Tokens are written once, unless `df` is `written` already, and read for each length.
    Tokens are not null.
    """
    if longest == 1:
        return vocabulary(df, tokens_col, size)
    tokens = df.select(F.col(tokens_col).alias("tokens"))
    tokens = tokens if written else keep(tokens, "tokens")
    found = parts = keep(corpus_counts(_run_hashes(tokens, 1).select("run_1"), "run_1"), "counts-1")
    last, _, _ = _reached(found, size)
    for n in range(2, longest):
        parts = keep(_long_counts(tokens, n, bitmap(parts.where(F.col("cnt") >= last), "term", bits), bits), f"counts-{n}")
        found = found.where(F.col("cnt") >= last).unionByName(parts)
        last, _, _ = _reached(found, size)
    words = bitmap(found.where(F.col("cnt") >= last), "term", bits)
    named = keep(_named_counts(tokens, longest, words, bits), "named-counts")
    reached = _reached(named, size)
    if reached[0] < last:
        # Two runs of one hash have lifted the bound above what the last term reaches.
        return vocabulary(tokens.select(all_ngrams(F.col("tokens"), longest).alias("terms")), "terms", size)
    return most_frequent(named, size, reached)


def _tally(terms: Column) -> Column:
    """Distinct elements of an array with their number, from the runs of the sorted array."""

    def runs(ordered: Column) -> Column:
        changes = F.transform(ordered, lambda term, at: F.when((at == 0) | (term != F.get(ordered, at - 1)), at))
        starts = F.filter(changes, lambda at: at.isNotNull())

        def count(bound: Column) -> Column:
            def run(start: Column, number: Column) -> Column:
                end = F.coalesce(F.get(bound, number + 1), F.size(ordered))
                return F.struct(F.get(ordered, start).alias("term"), (end - start).cast("bigint").alias("cnt"))

            return F.transform(bound, run)

        return bind(starts, count)

    return bind(F.sort_array(terms), runs)


def term_counts(df: DataFrame, id_col: str, terms: Column) -> DataFrame:
    """Occurrences of each term in each row; `terms` is an array expression over the row.

    Counted inside the row, so nothing is shuffled.  Rows that share an id are counted apart.
    """
    tallied = df.select(id_col, F.explode_outer(_tally(terms)).alias("run"))
    return tallied.where(F.col("run").isNotNull()).select(id_col, "run.term", "run.cnt")
