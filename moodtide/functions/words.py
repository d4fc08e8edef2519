"""Whitelists, tokenizers and word lists."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from moodtide.functions.binding import bind

# Fixed values, needed for equal results.
NOT_WHITELISTED = r"[^A-Za-z0-9_!@#$%^&*()<>,.\s/:]+"
QUERY_CHARACTERS = r"^[a-zA-Z\d!\s@#$^&*()_+\"|}{?><~]*$"
JOB_ID_PREFIX = "base64:"

_LAST_SPACE = 0x3000  # no white space exists above this code point


def _character_class(member) -> str:
    """A regex class of the code points up to the last space for which `member` holds.

    Characters below 256 are listed one by one and the rest as ranges: Java
    then tests the former with one table lookup, which made the whitelist
    about ten times faster than the negated class it comes from.
    """
    low = "".join(rf"\x{code:02x}" for code in range(256) if member(chr(code)))
    ranges, start = [], None
    for code in range(256, _LAST_SPACE + 2):
        inside = member(chr(code))
        if inside and start is None:
            start = code
        elif not inside and start is not None:
            ranges.append((start, code - 1))
            start = None
    if start is not None:
        ranges.append((start, 0x10FFFF))
    return "[" + low + "".join(rf"\x{{{a:x}}}-\x{{{b:x}}}" for a, b in ranges) + "]"


# Spaces are meant in the Unicode sense; Java's \s alone is ASCII.
SPACE = _character_class(str.isspace)
_DROPPED = _character_class(lambda ch: re.match(NOT_WHITELISTED, ch) is not None) + "+"


def whitelist(text: Column) -> Column:
    """Remove every character outside the whitelist."""
    return F.regexp_replace(text, _DROPPED, "")


def words(text: Column) -> Column:
    """Split on white space, without empty parts."""
    return F.filter(F.split(text, f"{SPACE}+"), lambda word: word != "")


def words_longer_than(text: Column, length: int) -> Column:
    return F.filter(F.split(text, f"{SPACE}+"), lambda word: F.length(word) > length)


def join_words(parts: Column) -> Column:
    return F.array_join(parts, " ")


def word_count(text: Column) -> Column:
    """Words between white space; blank text has none."""
    trimmed = F.regexp_replace(text, f"^{SPACE}+|{SPACE}+$", "")
    return bind(trimmed, lambda bound: F.when(bound == "", 0).otherwise(F.size(F.split(bound, f"{SPACE}+"))))


def lower_tokens(text: Column) -> Column:
    """Lower-case and split on each white-space character, as the ML tokenizer does.

    Inner empty tokens stay and trailing ones go; the empty text is one empty
    token while blank text has none.
    """

    def tokens(bound: Column) -> Column:
        blank = F.rlike(bound, F.lit(r"^\s+$"))
        none = F.array().cast("array<string>")
        return F.when(blank, none).otherwise(F.split(F.regexp_replace(F.lower(bound), r"\s+$", ""), r"\s"))

    return bind(text, tokens)


def word_character_tokens(text: Column) -> Column:
    """Lower-case runs of two or more word characters."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"(?U)\b\w\w+\b"), 0)


def matches_query_characters(text: Column) -> Column:
    """Full match with the query whitelist; digits and spaces in the Unicode sense."""
    pattern = QUERY_CHARACTERS.replace(r"\d", r"\p{Nd}").replace(r"\s", SPACE[1:-1])
    return F.rlike(text, F.lit(pattern))
