"""Porter's suffix stripping (1980) with the small extensions of the usual English toolkit default.

The stemmer is a helper for single words; Spark moves the texts in Arrow
batches and each Python worker remembers the words it has already stemmed.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Words that do not follow the rules.
IRREGULAR = {
    "sky": "sky",
    "skies": "sky",
    "dying": "die",
    "lying": "lie",
    "tying": "tie",
    "news": "news",
    "innings": "inning",
    "inning": "inning",
    "outings": "outing",
    "outing": "outing",
    "cannings": "canning",
    "canning": "canning",
    "howe": "howe",
    "proceed": "proceed",
    "exceed": "exceed",
    "succeed": "succeed",
}

# Suffix tables of steps 2, 3 and 4, in the order they are tried.
STEP2 = (
    "ational ate tional tion enci ence anci ance izer ize bli ble alli al entli ent eli e ousli ous "
    "ization ize ation ate ator ate alism al iveness ive fulness ful ousness ous aliti al iviti ive "
    "biliti ble fulli ful logi log"
)
STEP3 = "icate ic ative - alize al iciti ic ical ic ful - ness -"
STEP4 = "al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize"


# Texts of a batch that a worker turns into Python strings at once.
TEXTS_AT_ONCE = 256


def _pairs(table: str) -> list[tuple[str, str]]:
    parts = table.split()
    return [(old, "" if new == "-" else new) for old, new in zip(parts[::2], parts[1::2])]


_STEP2, _STEP3, _STEP4 = _pairs(STEP2), _pairs(STEP3), [(suffix, "") for suffix in STEP4.split()]


def _shape(word: str) -> str:
    """Vowel/consonant pattern; y is a vowel after a consonant."""
    shape = ""
    for letter in word:
        vowel = letter in "aeiou" or (letter == "y" and shape[-1:] == "c")
        shape += "v" if vowel else "c"
    return shape


def _measure(word: str) -> int:
    return _shape(word).count("vc")


def _short_end(word: str) -> bool:
    """Ends consonant-vowel-consonant (last not w, x, y), or is vowel-consonant."""
    shape = _shape(word)
    return (shape.endswith("cvc") and word[-1] not in "wxy") or shape == "vc"


def _double_consonant(word: str) -> bool:
    return len(word) > 1 and word[-1] == word[-2] and _shape(word)[-1] == "c"


def _first_rule(word: str, table: list[tuple[str, str]], accept) -> str:
    """Apply the first rule whose suffix fits; if its condition fails nothing changes."""
    for suffix, replacement in table:
        if word.endswith(suffix):
            base = word[: len(word) - len(suffix)]
            return base + replacement if accept(base, suffix) else word
    return word


def _plural(word: str) -> str:
    if word.endswith("sses"):
        return word[:-2]
    if word.endswith("ies"):
        return word[:-1] if len(word) == 4 else word[:-2]
    if word.endswith("s") and not word.endswith("ss"):
        return word[:-1]
    return word


def _past(word: str) -> str:
    if word.endswith("ied"):
        return word[:-1] if len(word) == 4 else word[:-2]
    if word.endswith("eed"):
        return word[:-1] if _measure(word[:-3]) > 0 else word
    for suffix in ("ed", "ing"):
        base = word[: -len(suffix)]
        if word.endswith(suffix) and "v" in _shape(base):
            if base.endswith(("at", "bl", "iz")):
                return base + "e"
            if _double_consonant(base):
                return base if base[-1] in "lsz" else base[:-1]
            return base + "e" if _measure(base) == 1 and _short_end(base) else base
    return word


def _final_y(word: str) -> str:
    return word[:-1] + "i" if word.endswith("y") and len(word) > 2 and _shape(word[:-1])[-1] == "c" else word


def _double_suffix(word: str) -> str:
    if word.endswith("alli") and _measure(word[:-4]) > 0:
        word = word[:-2]

    def accept(base: str, suffix: str) -> bool:
        return _measure(base + "l" if suffix == "logi" else base) > 0

    return _first_rule(word, _STEP2, accept)


def _long_suffix(base: str, suffix: str) -> bool:
    return _measure(base) > 1 and (suffix != "ion" or base.endswith(("s", "t")))


def _final_e(word: str) -> str:
    if word.endswith("e"):
        base = word[:-1]
        size = _measure(base)
        if size > 1 or (size == 1 and not _short_end(base)):
            return base
    return word


def _final_double_l(word: str) -> str:
    return word[:-1] if word.endswith("ll") and _measure(word[:-1]) > 1 else word


@lru_cache(maxsize=1 << 16)
def stem(word: str) -> str:
    """Stem of one word."""
    word = word.lower()
    if word in IRREGULAR:
        return IRREGULAR[word]
    if len(word) <= 2:
        return word
    word = _final_y(_past(_plural(word)))
    word = _double_suffix(word)
    word = _first_rule(word, _STEP3, lambda base, _: _measure(base) > 0)
    word = _first_rule(word, _STEP4, _long_suffix)
    return _final_double_l(_final_e(word))


def _stemmed(text: str | None) -> str | None:
    return None if text is None else " ".join(map(stem, text.split()))


@F.arrow_udf(T.StringType())
def stem_words(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """Stem each space-separated word of a text.

    A batch stays as it came, and only a slice of its texts at a time is held as Python strings.
    """
    for batch in texts:
        for at in range(0, len(batch), TEXTS_AT_ONCE):
            yield pa.array(map(_stemmed, batch.slice(at, TEXTS_AT_ONCE).to_pylist()), batch.type)
