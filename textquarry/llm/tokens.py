"""Token ids of whole texts by a tokenizers file, fast where a corpus repeats its words.

A vocabulary with the steps in WORD_STEPS drops white space before it splits, so a text's ids are its words' ids in a row. Each
worker keeps the ids of recent short words, as bytes, up to a bound; a word of plain Latin-1 letters, digits and marks goes
straight to the vocabulary's merge model piece by piece, any other word through the whole tokenizer. A file with any other
steps is used as it is, a text at a time.
"""

from __future__ import annotations

import json
import re
from array import array

#: Words and pieces kept by a worker: two generations of this many at most.
KEPT = 300_000
LONGEST = 48

# The steps of a vocabulary file whose ids go by words.
WORD_STEPS = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {"type": "Sequence", "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ]},
}
# What the Split step keeps, for Latin-1 text.
_PIECE = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z\xaa\xb5\xba\xdf-\xf6\xf8-\xff]+|[0-9\xb2\xb3\xb9\xbc-\xbe]|[^a-z0-9\xaa\xb5\xba\xdf-\xf6\xf8-\xff\xb2\xb3\xb9\xbc-\xbe]+")
_PLAIN = re.compile(r"[!-;=-~\xa1-\xff]+")
#: What Python's split() takes for a space beyond the ASCII ones that every tokenizer drops.
_ODD = re.compile("[\x1c-\x1f\x85\xa0  -     　]")


def _byte_letters() -> dict[int, str]:
    """The usual printable letter for each byte in byte-level vocabularies."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    table = {b: chr(b) for b in shown}
    for b in range(256):
        if b not in table:
            table[b] = chr(0x100 + len(table) - len(shown))
    return table


class _Kept(dict):
    """Ids of recent words and of the pieces of words; makes what it doesn't hold."""

    def __init__(self, make, at_most: int):
        self._make, self._at_most, self._old = make, at_most, {}

    def __missing__(self, word: str) -> bytes:
        ids = self._old.get(word)
        if ids is None:
            ids = self._make(word)
        if len(word) <= LONGEST:
            if len(self) >= self._at_most:
                self._old = dict(self)
                self.clear()
            self[word] = ids
        return ids


class WordIds:
    """ids(text): the text's ids as little-endian unsigned 32-bit integers in a row."""

    def __init__(self, path: str, kept: int = KEPT):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            said = json.load(f)
        self._whole = Tokenizer.from_file(path)
        self._merge = self._whole.model.tokenize
        self._letters = _byte_letters()
        plain = all(x["content"][:1] == "<" and not x["lstrip"] and not x["rstrip"] and not re.search(r"\s", x["content"]) for x in said["added_tokens"])
        self.by_words = plain and {k: said[k] for k in WORD_STEPS} == WORD_STEPS
        self._get = _Kept(self._encode, kept).__getitem__

    def _encode(self, word: str) -> bytes:
        if not _PLAIN.fullmatch(word):  # < may start a special token
            return array("I", self._whole.encode(word, add_special_tokens=False).ids).tobytes()
        pieces = _PIECE.findall(word.lower())
        if pieces != [word]:
            return b"".join(map(self._get, pieces))
        shown = word if word.isascii() else word.encode().decode("latin-1").translate(self._letters)
        return array("I", [t.id for t in self._merge(shown)]).tobytes()

    def ids(self, text: str | None) -> bytes:
        if not text:
            return b""
        if not self.by_words:
            return array("I", self._whole.encode(text, add_special_tokens=False).ids).tobytes()
        words = text.split() if not _ODD.search(text) else [w for w in re.split("[ \t\n\r]+", text) if w]
        return b"".join(map(self._get, words))


_BY_PATH: dict[str, WordIds] = {}


def word_ids(path: str) -> WordIds:
    """One encoder for each vocabulary and worker process."""
    if path not in _BY_PATH:
        _BY_PATH[path] = WordIds(path)
    return _BY_PATH[path]


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
