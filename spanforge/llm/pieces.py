"""Ids of pre-tokens by the tokenizers library, for a byte-level BPE file without a normaliser."""

from __future__ import annotations

import codecs
import json

import numpy as np
import public_tokenizers

from . import spans

VOCABULARY = "byte_bpe_50k.json"

# Byte-level alphabet: printable Latin-1 bytes stand for themselves, the others follow from U+0100 on.
_PRINTABLE = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
_OTHERS = {b: chr(0x100 + k) for k, b in enumerate(b for b in range(256) if b not in _PRINTABLE)}
_ALPHABET = "".join(_OTHERS.get(b, chr(b)) for b in range(256))


class PieceModel:
    """The library's BPE model, asked for one pre-token at a time; special strings are pieces of their own."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            said = json.load(f)
        before = said.get("pre_tokenizer") or {}
        if said.get("normalizer") or before.get("type") != "ByteLevel" or before.get("add_prefix_space") or not before.get("use_regex", True):
            raise ValueError(f"{path}: only byte-level BPE without a normaliser or prefix is supported")
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in said["added_tokens"]):
            raise ValueError(f"{path}: special strings that take in their surroundings are not supported")
        self.library = Tokenizer.from_file(path)
        self.model = self.library.model
        self.special = {t["content"].encode(): t["id"] for t in said["added_tokens"]}
        self.size = self.library.get_vocab_size()

    def ids(self, piece: bytes) -> list[int]:
        if piece in self.special:
            return [self.special[piece]]
        return [t.id for t in self.model.tokenize(codecs.charmap_decode(piece, "strict", _ALPHABET)[0])]

    def split(self, buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Starts of the pieces; a special string inside a text cuts it and is one piece."""
        data = buf.tobytes()
        found = []
        for word in sorted(self.special, key=len, reverse=True):
            at = data.find(word)
            while at >= 0:
                end = at + len(word)
                if np.searchsorted(offsets, at, side="right") == np.searchsorted(offsets, end - 1, side="right"):
                    found.append((at, end))
                at = data.find(word, end)
        if not found:
            return spans.pretoken_starts(buf, offsets)
        a, b = np.array(sorted(found)).T
        starts = spans.pretoken_starts(buf, np.unique(np.concatenate([offsets, a, b])))
        k = np.searchsorted(a, starts, side="right") - 1
        return starts[(k < 0) | (starts == a[k]) | (starts >= b[k])]


_MODELS: dict[str, PieceModel] = {}


def model(path: str | None = None) -> PieceModel:
    path = path or public_tokenizers.path(VOCABULARY)
    if path not in _MODELS:
        _MODELS[path] = PieceModel(path)
    return _MODELS[path]
