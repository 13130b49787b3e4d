"""Token ids of whole texts by the tokenizers library, with a bounded cache of pieces.

A text may be cut where its tokenizer provably treats both sides alone as it does in place; equal pieces then cost
one lookup. Where no such cut is known the whole text goes to the library.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from collections.abc import Callable
from functools import lru_cache

import numpy as np

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark's tasks are the parallelism

from tokenizers import Tokenizer  # noqa: E402

ID = np.dtype("<u4")
#: Pieces in a worker's cache.
CACHE = 500_000
#: Longer pieces aren't kept.
KEPT_CHARS = 48
#: What stands for the begin of a text in a piece's key.
_FIRST = "\x01"
#: Blanks in runs, around which no cut is safe for a byte-level pre-tokenizer.
_RUNS = ("  ", "\n\n", " \n", "\n ")
#: Other white space, likewise, and what keys use themselves.
_ODD = re.compile("[\x00\x01\t\r\x0b\x0c\x1c-\x1f]")
_ODD_WIDE = re.compile("[\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")


def words(text: str) -> list[str]:
    """For tokenizers that drop white space: what stands between blanks."""
    return list(filter(None, text.replace("\n", " ").split(" ")))


def word_text(key: str) -> str:
    return key


def before_blanks(text: str) -> list[str] | None:
    """For byte-level pre-tokenizers: cuts before each single blank. A key lacks its leading space; None: don't cut."""
    if any(map(text.__contains__, _RUNS)) or text[-1:] == " " or _ODD.search(text) or not text.isascii() and _ODD_WIDE.search(text):
        return None
    first, *rest = text.replace("\n", " \n").split(" ")
    return [_FIRST + first, *rest] if first else rest


def before_blank_text(key: str) -> str:
    return key[1:] if key[0] == _FIRST else key if key[0] == "\n" else " " + key


def byte_alphabet() -> dict[int, str]:
    """The printable character that stands for each byte in a byte-level vocabulary: itself where printable, else the next from U+0100."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(0x100, 0x200))
    return {b: chr(b) if b in shown else chr(next(rest)) for b in range(256)}


_BYTES = str.maketrans(byte_alphabet())


class _Pieces(dict):
    """Ids by key. Once full it stays as it is: frequent pieces come early."""

    def __init__(self, learn: Callable[[str], bytes], most: int):
        super().__init__()
        self._learn, self._most = learn, most

    def __missing__(self, key: str) -> bytes:
        ids = self._learn(key)
        if len(self) < self._most and len(key) <= KEPT_CHARS:
            self[key] = ids
        return ids


class PieceEncoder:
    """Encodes as the library does with add_special_tokens=False and neither truncation nor padding."""

    def __init__(self, path: str, cache: int = CACHE):
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self._special = [t["content"] for t in spec["added_tokens"]]
        self._cuts, self._text = self._splitter(spec)
        self._known = _Pieces(self._learn, cache)
        self._byte_level = self._text is before_blank_text
        self._space = _BYTES[32] if self._byte_level else ""
        self._normalize = self.tokenizer.normalizer.normalize_str if self.tokenizer.normalizer else None
        self._tokenize = self.tokenizer.model.tokenize
        self._marks = dict(zip(".,\n", self._library([".", ",", "\n"]), strict=True)) if self._text else {}

    @staticmethod
    def _splitter(spec: dict) -> tuple[Callable[[str], list[str] | None], Callable[[str], str] | None]:
        """How texts are cut into keys, and what text a key stands for; (.., None) where no cut is known to be safe."""
        pre, normal = spec.get("pre_tokenizer") or {}, spec.get("normalizer") or {}
        if pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True) and not normal:
            return before_blanks, before_blank_text
        parts = pre.get("pretokenizers", [])
        kinds = {n.get("type") for n in normal.get("normalizers", [])}
        if parts and parts[0]["type"] == "Split" and parts[0]["behavior"] == "Removed" and parts[0]["invert"] and r"[^\s\p{L}\p{N}]" in parts[0]["pattern"].get("Regex", "") and kinds <= {"NFC", "Replace", "Lowercase"} and not any(p.get("add_prefix_space") for p in parts):
            return words, word_text
        return lambda text: None, None

    def _library(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, dtype=ID).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _word(self, key: str) -> bytes:
        """The ids of a key of letters only, which is one word to the pre-tokenizer: by the library's normalizer and model."""
        bare = key[1:] if key[0] == _FIRST else key
        word = bare if self._normalize is None else bare.lower() if bare.isascii() else self._normalize(bare)
        if not word.isascii():
            if not word.isalpha():
                return self._library([self._text(key)])[0]
            word = word.encode().decode("latin-1").translate(_BYTES)
        return array("I", [t.id for t in self._tokenize(self._space + word if bare is key else word)]).tobytes()

    def _learn(self, key: str) -> bytes:
        """The ids of a key that the cache lacks. A line feed before a word, and a full stop or comma after it, are words of their own."""
        stem, tail = (key[:-1], self._marks[key[-1]]) if key[-1] in ".," else (key, b"")
        lead = b""
        if self._byte_level and stem[:1] == "\n":
            lead, stem = self._marks["\n"], _FIRST + stem[1:]
        if not (stem[1:] if stem[:1] == _FIRST else stem).isalpha():
            return self._library([self._text(key)])[0]
        return lead + self._known[stem] + tail if lead or tail else self._word(stem)

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """Each text's ids, as little-endian unsigned 32-bit integers."""
        ids, special, out = self._known.__getitem__, self._special, []
        for text in texts:
            keys = None if any(map(text.__contains__, special)) else self._cuts(text)
            out.append(self._library([text])[0] if keys is None else b"".join(map(ids, keys)))
        return out


@lru_cache(maxsize=2)
def encoder(path: str) -> PieceEncoder:
    """One encoder for each worker process and file."""
    return PieceEncoder(path)
