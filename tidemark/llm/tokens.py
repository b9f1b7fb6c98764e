"""Token ids by the tokenizers library, with each pre-token encoded once and remembered.

BPE never merges across pre-tokens, so a text's ids are its pre-tokens' ids in order. For texts made of ASCII
and Latin-1 letters, where the pre-token pattern is plain, pre-tokens are found here, and the library encodes
each distinct one once. Every other text, and any that may hold a special token's string, goes to the library whole.
"""

from __future__ import annotations

import os
import re
from array import array
from itertools import chain

# Outside of this set Unicode tables and normal forms matter, and the library decides.
_PLAIN = re.compile(r"[\t\n\r\x20-\x7eÀ-ÖØ-öø-ÿ]*\Z")
_L = "A-Za-zÀ-ÖØ-öø-ÿ"
_WORDS = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_L}]+|[0-9]|[^\s{_L}0-9]+")
_BYTES = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_L}]+| ?[0-9]+| ?[^\s{_L}0-9]+|\s+(?!\S)|\s+")

# The byte-level alphabet: printable Latin-1 characters stand for themselves, the other bytes follow from 256 on.
_KEPT = [*range(33, 127), *range(161, 173), *range(174, 256)]
_BYTE_CHARS = {b: chr(b) for b in _KEPT} | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in _KEPT)}


class _Memo(dict):
    def __init__(self, encode, most):
        super().__init__()
        self.encode, self.most = encode, most

    def __missing__(self, piece):
        got = self.encode(piece)
        if len(self) < self.most and len(piece) <= 64:
            self[piece] = got
        return got


class Encoder:
    """ids(text) equals Tokenizer.encode(text, add_special_tokens=False).ids; memory is bounded by ``most`` pre-tokens."""

    def __init__(self, path: str, most: int = 450_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.lower = self.pattern = None
        normalizer, pre = str(self.tokenizer.normalizer), str(self.tokenizer.pre_tokenizer)
        if normalizer == r'Sequence(normalizers=[NFC(), Replace(pattern=Regex("\s+"), content=" "), Lowercase()])' and r"[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+" in pre:
            self.lower, self.pattern = True, _WORDS
        elif normalizer == "None" and pre == "ByteLevel(add_prefix_space=False, trim_offsets=True, use_regex=True)":
            self.lower, self.pattern = False, _BYTES
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        model = self.tokenizer.model
        self.memo = _Memo(lambda piece: tuple(t.id for t in model.tokenize(piece.encode().decode("latin-1").translate(_BYTE_CHARS))), most)

    def _plain(self, text: str) -> bool:
        return self.pattern is not None and not any(s in text for s in self.special) and _PLAIN.match(text) is not None

    def ids(self, text: str) -> array:
        if not self._plain(text):
            return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids)
        pieces = self.pattern.findall(text.lower() if self.lower else text)
        return array("I", chain.from_iterable(map(self.memo.__getitem__, pieces)))

    def count(self, text: str) -> int:
        if not self._plain(text):
            return len(self.tokenizer.encode(text, add_special_tokens=False))
        pieces = self.pattern.findall(text.lower() if self.lower else text)
        return sum(map(len, map(self.memo.__getitem__, pieces)))


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder a Python worker and file."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]
