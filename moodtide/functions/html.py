"""Text of an HTML fragment, with character references decoded."""

from __future__ import annotations

from html.entities import name2codepoint

from pyspark.sql import Column
from pyspark.sql import functions as F

from moodtide.functions.binding import bind

# One alternation, so whatever starts first in the text wins: a script that
# holds "<!--" and a comment that holds "<script>" both end where they should.
# A "<" that opens no tag name ("I <3 you", "a < b") is ordinary text.
# Quantifiers are possessive: no backtracking on long attribute lists.
_HIDDEN = r"(?:script|style|template)\b.*?(?:</(?:script|style|template)\s*>|\z)"
_COMMENT = r"!--.*?(?:-->|\z)"
_DECLARATION = r"[!?][^>]*+(?:>|\z)"
_TAG = r"""/?[a-z_:][^>=]*+(?:=\s*+(?:"[^"]*+"|'[^']*+')?+[^>=]*+)*+(?:>|\z)"""
MARKUP = rf"(?is)<(?:{_HIDDEN}|{_COMMENT}|{_DECLARATION}|{_TAG})"

_REFERENCE = r"^(?:[A-Za-z][A-Za-z0-9]*;|#[0-9]+;?|#[xX][0-9A-Fa-f]+;?)"

# The HTML 4 names, plus the XML one that HTML parsers accept as well.
_NAMED = {**{name: chr(code) for name, code in name2codepoint.items()}, "apos": "'"}


def strip_markup(text: Column) -> Column:
    """Drop tags, comments, declarations and the content of scripts, styles and templates."""
    return F.when(F.contains(text, F.lit("<")), F.regexp_replace(text, MARKUP, "")).otherwise(text)


def _character(code: Column) -> Column:
    """The character with this code point, or nothing if XML does not allow it."""
    legal = (
        code.isin(9, 10, 13)
        | code.between(0x20, 0xD7FF)
        | code.between(0xE000, 0xFFFD)
        | code.between(0x10000, 0x10FFFF)
    )
    return F.when(legal, F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")).otherwise(F.lit(""))


def _code_point(body: Column) -> Column:
    """The number in "#65" or "#x41"."""
    decimal = F.substr(body, F.lit(2)).try_cast("bigint")
    # Without leading zeros, longer digit strings overflow and cannot name a character anyway.
    digits = F.regexp_replace(F.substr(body, F.lit(3)), "^0+(?=.)", "")
    hexadecimal = F.when(F.length(digits) <= 10, F.conv(digits, 16, 10).cast("bigint"))
    return F.when(F.rlike(body, F.lit("^#[xX]")), hexadecimal).otherwise(decimal)


def _decode_piece(names: Column):
    """Decoder of one piece of a text that was cut at each "&"."""

    def character(reference: Column) -> Column:
        named = F.try_element_at(names, F.rtrim(reference, F.lit(";")))
        numeric = F.coalesce(_character(_code_point(F.rtrim(reference, F.lit(";")))), F.lit(""))
        kept = F.concat(F.lit("&"), reference)
        return F.when(F.startswith(reference, F.lit("#")), numeric).otherwise(F.coalesce(named, kept))

    def decode(piece: Column, index: Column) -> Column:
        rest = F.regexp_replace(piece, _REFERENCE, "")
        decoded = F.concat(bind(F.regexp_extract(piece, _REFERENCE, 0), character), rest)
        return F.when(index == 0, piece).otherwise(decoded)

    return decode


def decode_references(text: Column) -> Column:
    """Decode named and numeric character references in one pass.

    A single pass matters: "&amp;lt;" is the text "&lt;", not "<".  The text is
    cut at each "&" and every piece after the first begins with a candidate.
    """
    names = F.create_map(*[F.lit(part) for pair in _NAMED.items() for part in pair])
    return F.array_join(F.transform(F.split(text, "&"), _decode_piece(names)), "")


def html_text(text: Column) -> Column:
    """Visible text of a fragment; plain text passes through untouched."""
    plain = ~F.contains(text, F.lit("<"))
    return (
        F.when(F.contains(text, F.lit("&")), decode_references(F.regexp_replace(text, MARKUP, "")))
        .when(plain, text)
        .otherwise(F.regexp_replace(text, MARKUP, ""))
    )
