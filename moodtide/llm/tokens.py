"""Token ids of whole texts, computed per Arrow batch."""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np

# Longest sequence of ids, and the id that ends each document.
CAPACITY = 4096
END_ID = 1


# Stands between parts that are encoded together; parts that hold it are encoded alone.
SEPARATOR = "^"


class Encoder:
    """Ids of a text as little-endian 32-bit numbers.

    A tokenizer that folds case and cuts texts at white space, and letters
    from digits and from all else, before anything else gives a text the ids of its parts
    between spaces and line breaks, and a part those of its runs.  Their ids are kept for the next time they come.  Any
    other tokenizer is given whole texts.
    """

    # Bytes of known parts; the parts of the half filled before are still looked up.
    MAX_HELD = 144 << 20

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.by_parts = _cuts_runs(json.loads(self.tokenizer.to_str()))
        self.separator = self.tokenizer.encode(SEPARATOR, add_special_tokens=False).ids
        self.known: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}
        self.held = 0

    def _find(self, parts: set[str]) -> set[str]:
        """Parts that are not known; those known before are known again."""
        new = parts.difference(self.known)
        again = [part for part in new if part in self.before]
        for part in again:
            self._keep(part, self.before[part])
        return new.difference(again)

    def _keep(self, part: str, ids: bytes) -> None:
        self.known[part] = ids
        self.held += 180 + len(part) + len(ids)

    def _encode_parts(self, parts: list[str]) -> None:
        """Encode unknown parts, all in one text where their ids can be told apart again."""
        alone = [part for part in parts if SEPARATOR in part or len(self.separator) != 1]
        together = [part for part in parts if SEPARATOR not in part] if len(self.separator) == 1 else []
        for part, encoding in zip(alone, self.tokenizer.encode_batch_fast(alone, add_special_tokens=False)):
            self._keep(part, np.array(encoding.ids, "<u4").tobytes())
        if together:
            joined = f" {SEPARATOR} ".join(together)
            ids = np.array(self.tokenizer.encode_batch_fast([joined], add_special_tokens=False)[0].ids, "<u4")
            cuts = np.flatnonzero(ids == self.separator[0])
            starts, ends = [0, *(cuts + 1).tolist()], [*cuts.tolist(), len(ids)]
            data = ids.tobytes()
            for part, start, end in zip(together, starts, ends, strict=True):
                self._keep(part, data[4 * start : 4 * end])

    def encode(self, text: str) -> bytes:
        if not self.by_parts:
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        if _LATIN.fullmatch(text) and "<|" not in text:
            # Cut as the tokenizer cuts: few different runs, and no part is kept for itself.
            runs = _LATIN_RUN.findall(text.lower())
            new = self._find(set(runs))
            if new:
                self._encode_parts(sorted(new))
            return self._turned(b"".join(map(self.known.__getitem__, runs)))
        parts = text.replace("\n", " ").split(" ")
        new = self._find(set(parts))
        if new:
            cut = {part: _runs(part) for part in new}
            unknown = self._find({run for runs in cut.values() for run in runs})
            if unknown:
                self._encode_parts(sorted(unknown))
            for part, runs in cut.items():
                if part not in self.known:
                    self._keep(part, b"".join(map(self.known.__getitem__, runs)))
        return self._turned(b"".join(map(self.known.__getitem__, parts)))

    def _turned(self, out: bytes) -> bytes:
        """Begins a new half when this one is full."""
        if self.held > self.MAX_HELD // 2:
            self.before, self.known, self.held = self.known, {}, 0
        return out


# Texts of Latin letters up to U+017F, without control characters that count as white space in one place only, and without
# the dotted capital I, which becomes two characters.  No character of these is changed by composition.
_LATIN = re.compile("[\t\n\r -~\u00a0-\u012f\u0131-\u017f]*")
# Letters and numbers of that range, in lower case; else the tokenizer's own pattern.
_LETTERS, _NUMBERS = "a-zªµºß-öø-\u024f", "0-9²³¹¼½¾"
_LATIN_RUN = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[{_NUMBERS}]|[^\s{_LETTERS}{_NUMBERS}]+")
# Visible ASCII characters but the apostrophe, which may belong to the letters after it.
_PLAIN = re.compile(r"[!-&(-~]+")
_RUN = re.compile(r"[a-z]+|[0-9]|[^a-z0-9]+")


def _runs(part: str) -> list[str]:
    """Runs whose ids together are those of the part: of plain ones the letters, digits and other characters, in lower case."""
    if "<|" in part:
        return [part]
    if _PLAIN.fullmatch(part):
        return _RUN.findall(part.lower())
    # Else only a last full stop or comma after a letter comes off.
    ends = part[-1:] in (".", ",") and part[-2:-1].lower().isalpha()
    core, tail = (part[:-1], [part[-1]]) if ends else (part, [])
    return [core.lower() if core.isascii() else core, *tail]


def _cuts_runs(described: dict) -> bool:
    """Whether a tokenizer folds case and cuts letters, single digits and other characters apart."""
    folds = [one.get("type") for one in (described.get("normalizer") or {}).get("normalizers", [])]
    cuts = (described.get("pre_tokenizer") or {}).get("pretokenizers", [])
    pattern = (cuts[0].get("pattern") or {}).get("Regex", "") if cuts else ""
    return folds == ["NFC", "Replace", "Lowercase"] and pattern.endswith(r"|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One encoder per Python worker."""
    return Encoder(path)


def document_pieces(text: str | None, path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> Iterator[tuple[int, np.ndarray]]:
    """Start and ids of each piece of a document; only one longer than the capacity is cut."""
    ids = np.frombuffer(encoder(path).encode(text or "") + int(end_id).to_bytes(4, "little"), "<u4")
    for start in range(0, len(ids), capacity):
        yield start, ids[start : start + capacity]


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))
