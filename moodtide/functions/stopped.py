"""Second cleaner: stop words, stems and a longer minimum word length."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from moodtide.functions.cleaning import letters_only
from moodtide.functions.stemming import stem_words
from moodtide.functions.words import join_words, words_longer_than

# The usual English stop word list of 179 words.
STOP_WORDS = """
i me my myself we our ours ourselves you you're you've you'll you'd your yours yourself yourselves
he him his himself she she's her hers herself it it's its itself they them their theirs themselves
what which who whom this that that'll these those am is are was were be been being have has had having
do does did doing a an the and but if or because as until while of at by for with about against between
into through during before after above below to from up down in out on off over under again further
then once here there when where why how all any both each few more most other some such no nor not only
own same so than too very s t can will just don don't should should've now d ll m o re ve y ain aren
aren't couldn couldn't didn didn't doesn doesn't hadn hadn't hasn hasn't haven haven't isn isn't ma
mightn mightn't mustn mustn't needn needn't shan shan't shouldn shouldn't wasn wasn't weren weren't
won won't wouldn wouldn't
""".split()

# Fixed value: links as this cleaner sees them.
LINK = r"http\S+"


def strip_at_signs(text: Column) -> Column:
    return F.replace(text, F.lit("@"), F.lit(""))


def strip_http(text: Column) -> Column:
    return F.regexp_replace(text, LINK, "")


def without_stop_words(lowered_words: Column, stop_words: list[str] | None = None) -> Column:
    """Drop stop words from an array of lower-case words."""
    listed = STOP_WORDS if stop_words is None else stop_words
    return F.filter(lowered_words, lambda word: ~word.isin(*listed))


def stopped_text(text: Column) -> Column:
    """The second cleaner up to the stop words: lower-case words joined by one space."""
    letters = letters_only(strip_http(strip_at_signs(text)))
    parts = F.filter(F.split(F.lower(letters), " "), lambda word: word != "")
    return join_words(without_stop_words(parts))


def second_clean(df: DataFrame, text_col: str = "text", out_col: str = "text_clean", stems: bool = True) -> DataFrame:
    """The whole second cleaner; `stems=False` leaves words as they are."""
    stopped = df.withColumn(out_col, stopped_text(F.col(text_col)))
    if stems:
        stopped = stopped.withColumn(out_col, stem_words(F.col(out_col)))
    return stopped.withColumn(out_col, join_words(words_longer_than(F.col(out_col), 3)))
