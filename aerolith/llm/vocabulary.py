"""The word-level byte-pair vocabulary: its file, normal form, pieces of text and initial symbols.

A word's symbols depend on the word alone, so they are worked out once for each distinct word a worker meets.
"""

from __future__ import annotations

import json
import re
import unicodedata
from functools import lru_cache

import public_tokenizers
import regex

DEFAULT = "word_bpe_49k.json"

# The split pattern of the vocabulary file; a file with another one is refused.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

# Unicode white space.
_WHITE = r"\t-\r\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
# Beyond these characters the tables below may matter.
_RARE = re.compile(r"[^\x00-\u02ff\u2010-\u2027\u20ac]")
_PIECE = regex.compile(PIECES.replace(r"\s", _WHITE))

# Letters and numbers that Unicode 16 added to the 15.1 of Python's own tables. The library classes
# characters by Unicode 16; what came later is neither a letter nor a number to it.
_ADDED = [
    (0x1C89, 0x1C8A), (0xA7CB, 0xA7CD), (0xA7DA, 0xA7DC), (0x105C0, 0x105F3), (0x10D40, 0x10D65), (0x10D6F, 0x10D85), (0x10EC2, 0x10EC4), (0x11380, 0x11389),
    (0x1138B, 0x1138B), (0x1138E, 0x1138E), (0x11390, 0x113B5), (0x113B7, 0x113B7), (0x113D1, 0x113D1), (0x113D3, 0x113D3), (0x116D0, 0x116E3), (0x11BC0, 0x11BE0),
    (0x11BF0, 0x11BF9), (0x13460, 0x143FA), (0x16100, 0x1611D), (0x16130, 0x16139), (0x16D40, 0x16D6C), (0x16D70, 0x16D79), (0x18CFF, 0x18CFF), (0x1CCF0, 0x1CCF9),
    (0x1E5D0, 0x1E5ED), (0x1E5F0, 0x1E5FA),
]
# Lower case that came with Unicode 16 and 17.
_LOWER = {0x1C89: 0x1C8A, 0xA7CB: 0x264, 0xA7CC: 0xA7CD, 0xA7CE: 0xA7CF, 0xA7D2: 0xA7D3, 0xA7D4: 0xA7D5, 0xA7DA: 0xA7DB, 0xA7DC: 0x19B}
_LOWER |= {c: c + 32 for c in range(0x10D50, 0x10D66)} | {c: c + 27 for c in range(0x16EA0, 0x16EB9)}


def _late(char: str) -> bool:
    """Assigned after the library's Unicode version, as far as Python can tell."""
    return unicodedata.category(char) == "Cn" and not any(a <= ord(char) <= b for a, b in _ADDED)


def pieces(text: str) -> list[str]:
    if not any(map(_late, text)):
        return _PIECE.findall(text)
    shadow = "".join("\ue000" if _late(c) else c for c in text)
    return [text[m.start() : m.end()] for m in _PIECE.finditer(shadow)]


def byte_letters() -> list[str]:
    """The printable character that stands for each byte in files of byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(spare)) for b in range(256)]


class Vocabulary:
    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        kind, splits = spec["model"]["type"], json.dumps(spec["pre_tokenizer"])
        if kind != "BPE" or json.dumps(PIECES) not in splits or spec["model"]["end_of_word_suffix"] != "</w>":
            raise ValueError(f"{path} is not a word-level byte-pair vocabulary of the known form")
        ids: dict[str, int] = spec["model"]["vocab"]
        merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        letters = byte_letters()
        self.first = [ids[c] for c in letters]
        self.last = [ids[c + "</w>"] for c in letters]
        # left id x 2 ^ 20 + right id -> rank, and the merged id of each rank
        self.ranks = {ids[a] << 20 | ids[b]: rank for rank, (a, b) in enumerate(merges)}
        self.made = [ids[a + b] for a, b in merges]
        self.strings = {i: s for s, i in ids.items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.strings |= {i: s for s, i in self.special.items()}
        self._specials = regex.compile("(" + "|".join(regex.escape(s) for s in self.special) + ")")

    def words(self, text: str) -> list[str]:
        """Words of a text in order; a special string of the vocabulary is a word of its own."""
        if "<|" in text:
            parts = self._specials.split(text)
            if len(parts) > 1:
                return [w for k, p in enumerate(parts) for w in ([p] if k % 2 else self._plain(p))]
        return self._plain(text)

    @staticmethod
    def _plain(text: str) -> list[str]:
        if text.isascii():
            return _PIECE.findall(text.lower())
        # lower case goes by single characters: no final form of sigma
        text = unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()
        return pieces(text.translate(_LOWER)) if _RARE.search(text) else _PIECE.findall(text)

    def symbols(self, word: str) -> list[int]:
        """Initial symbols of a word."""
        if word in self.special:
            return [self.special[word]]
        raw = word.encode()
        return [*map(self.first.__getitem__, raw[:-1]), self.last[raw[-1]]]


@lru_cache(maxsize=2)
def load(name: str) -> Vocabulary:
    """By the name of a public file or a path that every executor has."""
    return Vocabulary(name if "/" in name else public_tokenizers.path(name))
