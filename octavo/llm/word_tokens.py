"""Exact and fast use of a ``tokenizers`` file whose words can be encoded one by one.

``WordTokens.encode`` gives the ids of ``Tokenizer.encode(text, add_special_tokens=False)``, which gives an
added token's string in the text that token's id.  Texts made only of plain characters and without such a
string are split into words here, each distinct word goes to the library's model once, and its ids are
remembered; any other text goes through the library whole.
"""

from __future__ import annotations

import functools
import json
import os
import re

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

from tokenizers import Tokenizer, pre_tokenizers  # noqa: E402

from .shared import take_memory  # noqa: E402

#: Texts with any other character are encoded by the library as a whole.  The characters allowed are their own
#: composed form, have a one-to-one lower case, and are classed alike by every Unicode version.
_PLAIN = re.compile("[\t\n\r -~À-įı-ňŊ-ž]*")
_LETTERS = "a-zß-öø-įı-ňŊ-ž"
_PIECES = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[0-9]|[^\s{_LETTERS}0-9]+")

#: The normaliser and the splitting rule for which the shortcut holds.
_NORMALIZER = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
_SPLIT = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"

#: Words remembered by one Python worker; beyond it the memory is emptied and fills anew.
MEMORY_WORDS = 700_000


class _Memory(dict):
    """word -> its ids as little-endian unsigned 32-bit integers."""

    def __init__(self, piece_ids):
        super().__init__()
        self.piece_ids = piece_ids

    def __missing__(self, word: str) -> bytes:
        if len(word) > 256:
            return self.piece_ids(word)
        if len(self) >= MEMORY_WORDS:
            self.clear()
        self[word] = ids = self.piece_ids(word)
        return ids


class WordTokens:
    def __init__(self, path: str):
        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        added = spec.get("added_tokens") or []
        #: Strings that the library takes out of a text before it splits it.
        self.added = tuple(x["content"] for x in added)
        split, level = ((spec.get("pre_tokenizer") or {}).get("pretokenizers") or [{}, {}])[:2]
        self.simple = (
            (spec.get("normalizer") or {}).get("normalizers") == _NORMALIZER
            and split.get("pattern") == {"Regex": _SPLIT}
            and (split.get("behavior"), split.get("invert")) == ("Removed", True)
            and (level.get("type"), level.get("add_prefix_space"), level.get("use_regex")) == ("ByteLevel", False, False)
            and not any(x.get("normalized") for x in added)
        )
        self.model = self.library.model
        as_text = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        #: byte -> the character that stands for it, as the library writes it
        self.bytes_as = {}
        for c in map(chr, [*range(128), *range(0xC0, 0x180)]):
            for b, x in zip(c.encode(), as_text.pre_tokenize_str(c)[0][0], strict=True):
                self.bytes_as[b] = x
        self.memory = _Memory(self._ids_of)

    def _ids_of(self, word: str) -> bytes:
        out = []
        for piece in _PIECES.findall(word):
            shown = piece.encode().decode("latin-1").translate(self.bytes_as)
            out += [t.id.to_bytes(4, "little") for t in self.model.tokenize(shown)]
        return b"".join(out)

    def encode(self, text: str | None) -> bytes:
        """Ids as little-endian unsigned 32-bit integers; a null text has none."""
        if not text:
            return b""
        if self.simple and _PLAIN.fullmatch(text) and not any(x in text for x in self.added):
            return b"".join(map(self.memory.__getitem__, text.lower().split()))
        return b"".join(i.to_bytes(4, "little") for i in self.library.encode(text, add_special_tokens=False).ids)


_made = functools.cache(WordTokens)


def word_tokens(path: str) -> WordTokens:
    """One per Python worker and file, until another operator takes the worker's memory."""
    take_memory("words", _made.cache_clear)
    return _made(path)
