"""Tokenizing whole texts inside tasks with the ``tokenizers`` library.

A byte-level vocabulary splits a text into pieces by a fixed pattern and
merges bytes inside each piece only.  For such vocabularies, texts made of
plain Latin characters are split here by the same pattern, and each distinct
piece goes through the library's model once per worker; any other text, any
text that holds the string of an added token, and any other kind of vocabulary
goes through the library whole.
"""

from __future__ import annotations

import array
import json
import os
import re
import sys

#: Fixed value: the split pattern of the vocabulary, with its letter and
#: number classes spelled out for the characters of ``_PLAIN``.
_LETTERS = "A-Za-zÀ-ÖØ-öø-ſ"
_PIECES = re.compile(
    rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LETTERS}]+| ?[0-9]+| ?[^\s{_LETTERS}0-9]+|\s+(?!\S)|\s+"
)
_NOT_PLAIN = re.compile(rf"[^\t\n\r\x20-\x7e{_LETTERS}]")

#: Pieces kept per worker; beyond it the cache starts anew (results do not change).
CACHE_PIECES = 250_000
#: Longer pieces are not kept.
CACHE_CHARS = 64


def u32(ids) -> bytes:
    """Little-endian unsigned 32-bit ids."""
    a = array.array("I", ids)
    if sys.byteorder != "little":
        a.byteswap()
    return a.tobytes()


def _byte_characters() -> dict[int, str]:
    """Byte-level vocabularies write a byte as itself if it prints, else as the next free character from 256."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = [b for b in range(256) if b not in own]
    return {b: chr(b) if b in own else chr(256 + others.index(b)) for b in range(256)}


class _Pieces(dict):
    """Id bytes of pieces, filled by the library's model."""

    def __init__(self, model):
        self._model = model
        names = _byte_characters()
        plain = [c for c in map(chr, range(0x180)) if not _NOT_PLAIN.search(c)]
        self._table = {ord(c): "".join(names[b] for b in c.encode()) for c in plain}

    def __missing__(self, piece: str) -> bytes:
        ids = u32([t.id for t in self._model.tokenize(piece.translate(self._table))])
        if len(piece) <= CACHE_CHARS:
            self[piece] = ids
        return ids


class Encoder:
    """Texts to little-endian id bytes."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self._tok = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            about = json.load(f)
        split = about["pre_tokenizer"] or {}
        self._by_piece = (
            about["model"]["type"] == "BPE" and about["normalizer"] is None and split.get("type") == "ByteLevel"
            and split.get("use_regex", True) and not split.get("add_prefix_space")
        )
        self._pieces = _Pieces(self._tok.model)
        self._added = [t["content"] for t in about["added_tokens"] or [] if t["content"]]

    def one(self, text: str) -> bytes:
        if not self._by_piece or _NOT_PLAIN.search(text) or any(t in text for t in self._added):
            return u32(self._tok.encode(text, add_special_tokens=False).ids)
        if len(self._pieces) > CACHE_PIECES:
            self._pieces.clear()
        return b"".join(map(self._pieces.__getitem__, _PIECES.findall(text)))


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The worker's encoder for a vocabulary file (kept between its tasks)."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")
