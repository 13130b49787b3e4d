"""Byte-level BPE by forced-boundary splitting.

No merge crosses a pair of bytes that stands inside no vocabulary token, so such a pair marks a certain cut:
the pieces on either side encode as they would in the whole text. Whole texts are cut first at the forced pairs
that the pre-tokenizer's pattern also separates whatever surrounds them (a byte other than white space, then
white space), with one table lookup a byte; a piece is then split by the pattern, and each word at all its
forced pairs. Every fragment is encoded by itself, once: a bounded cache holds what a fragment gave.

Defined cases: a null text counts as empty and gives no ids; special tokens' strings in a text become their ids,
as the library does by default; repeated rows are each returned; an empty table gives no rows; a text of any length
is encoded whole, in time that grows with its length; columns in keep may have any names but those that are added, and
other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from mediastrata.llm.common import Transform, table, text_list, with_columns

#: Fragments in a worker's cache; when full it starts anew.
CACHE = 600_000
# Fixed value: the byte-level pre-tokenizer's pattern.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: White space outside ASCII's blanks, after which a cut before a blank isn't safe.
_OTHER_SPACE = regex.compile("[\x1c-\x1f\x85\xa0  -     　]")
ID = np.dtype("<u4")
_BLANKS = b" \t\n\r\x0b\x0c"


def byte_alphabet() -> dict[int, str]:
    """The printable character that stands for each byte in a byte-level vocabulary: itself where printable, else the next from U+0100."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(0x100 + k) for k, b in enumerate(rest)}


class ForcedBoundaryCodec:
    """Encodes and decodes with a byte-level BPE file of the tokenizers library."""

    def __init__(self, path: str, cache: int = CACHE):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec["pre_tokenizer"]
        if pre["type"] != "ByteLevel" or pre["add_prefix_space"] or not pre.get("use_regex", True) or spec.get("normalizer"):
            raise ValueError("only plain byte-level BPE files are supported")
        self.model = Tokenizer.from_file(path).model
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self._special = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        alphabet = byte_alphabet()
        self._shown = {b: c for b, c in alphabet.items()}
        back = {c: b for b, c in alphabet.items()}
        vocab = spec["model"]["vocab"]
        self.bytes_of: list[bytes] = [b""] * (max([*vocab.values(), *self.special.values()]) + 1)
        inside = np.zeros(65536, dtype=bool)
        for token, i in vocab.items():
            raw = bytes(back[c] for c in token) if all(c in back for c in token) else token.encode()
            self.bytes_of[i] = raw
            for a, b in zip(raw, raw[1:], strict=False):
                inside[a << 8 | b] = True
        for token, i in self.special.items():
            self.bytes_of[i] = token.encode()
        #: By pair of bytes, first << 8 | second: whether no token holds it.
        self.forced = ~inside
        blank = np.zeros(256, bool)
        blank[list(_BLANKS)] = True
        first, second = np.divmod(np.arange(65536), 256)
        self._safe = self.forced & blank[second] & ~blank[first]
        self._pattern = regex.compile(PATTERN)
        self._known: dict[bytes, bytes] = {}
        self._pieces: dict[bytes, bytes] = {}
        self._cache = cache

    def fragments(self, word: bytes) -> list[bytes]:
        """word, cut at all its forced pairs."""
        forced = self.forced
        cuts = [k + 1 for k in range(len(word) - 1) if forced[word[k] << 8 | word[k + 1]]]
        return [word[a:b] for a, b in zip([0, *cuts], [*cuts, len(word)], strict=True)] if cuts else [word]

    def _fragment(self, fragment: bytes) -> bytes:
        ids = self._known.get(fragment)
        if ids is None:
            if len(self._known) >= self._cache // 2:
                self._known.clear()
            shown = self._shown
            ids = self._known[fragment] = np.array([t.id for t in self.model.tokenize("".join([shown[b] for b in fragment]))], dtype=ID).tobytes()
        return ids

    def _piece(self, piece: bytes) -> bytes:
        """The ids of a piece of text that the pattern treats as it would in its place."""
        return b"".join([self._fragment(f) for word in self._pattern.findall(piece.decode()) for f in self.fragments(word.encode())])

    def pieces(self, text: str) -> list[bytes]:
        """The text's UTF-8 bytes, cut at the forced pairs that are safe before the pattern has been applied."""
        raw = text.encode("utf-8", "replace")
        if len(raw) < 2 or _OTHER_SPACE.search(text):
            return [raw] if raw else []
        b = np.frombuffer(raw, dtype=np.uint8)
        cuts = (np.flatnonzero(self._safe[b[:-1].astype(np.uint16) << 8 | b[1:]]) + 1).tolist()
        return [raw[i:j] for i, j in zip([0, *cuts], [*cuts, len(raw)], strict=True)]

    def encode_bytes(self, text: str) -> bytes:
        """The text's ids, as little-endian unsigned 32-bit integers."""
        if self._special is not None and self._special.search(text):
            out, at = [], 0
            for m in self._special.finditer(text):
                out += [self._plain(text[at : m.start()]), np.array([self.special[m[0]]], dtype=ID).tobytes()]
                at = m.end()
            return b"".join([*out, self._plain(text[at:])])
        return self._plain(text)

    def _plain(self, text: str) -> bytes:
        known = self._pieces
        if len(known) >= self._cache:
            known.clear()
        pieces = self.pieces(text)
        found = list(map(known.get, pieces))
        if None in found:
            for k, ids in enumerate(found):
                if ids is None:
                    piece = pieces[k]
                    ids = known.get(piece)
                    if ids is None:
                        ids = self._piece(piece)
                        if len(piece) <= 64:
                            known[piece] = ids
                    found[k] = ids
        return b"".join(found)

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.encode_bytes(text), dtype=ID).tolist()

    def decode(self, ids: list[int]) -> str:
        table = self.bytes_of
        return b"".join([table[i] for i in ids]).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def codec(path: str) -> ForcedBoundaryCodec:
    """One codec for each worker process and file."""
    return ForcedBoundaryCodec(path)


@lru_cache(maxsize=2)
def _decimals(path: str) -> list[str]:
    return [str(i) for i in range(len(codec(path).bytes_of))]


def round_trips(docs: DataFrame, tokenizer: str, text_col: str = "text", keep: dict[str, Column] | None = None) -> DataFrame:
    """The columns in keep; n_tokens, ids_sha256 of the ids, and decoded_sha256 of the text that they decode to."""

    def digester() -> Transform:
        c, decimal = codec(tokenizer), _decimals(tokenizer)

        def digest(texts: pa.Array) -> list[pa.Array]:
            n, of_ids, of_text = [], [], []
            for text in text_list(texts):
                ids = c.encode(text)
                n.append(len(ids))
                of_ids.append(hashlib.sha256(",".join([decimal[i] for i in ids]).encode()).hexdigest())
                of_text.append(hashlib.sha256(c.decode(ids).encode()).hexdigest())
            return [pa.array(n, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_text, pa.string())]

        return digest

    return with_columns(docs, F.col(f"`{text_col}`"), keep or {}, "n_tokens bigint, ids_sha256 string, decoded_sha256 string", digester)


def encoded(docs: DataFrame, tokenizer: str, text_col: str = "text", keep: dict[str, Column] | None = None) -> DataFrame:
    """The columns in keep, and the ids of every whole text."""

    def encoder() -> Transform:
        c = codec(tokenizer)

        def encode(texts: pa.Array) -> list[pa.Array]:
            ids = [np.frombuffer(c.encode_bytes(t), dtype=ID).astype(np.int32) for t in text_list(texts)]
            offsets = np.concatenate(([0], np.cumsum([len(x) for x in ids]))).astype(np.int32)
            values = np.concatenate(ids) if ids else np.zeros(0, np.int32)
            return [pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))]

        return encode

    return with_columns(docs, F.col(f"`{text_col}`"), keep or {}, "ids array<int>", encoder)


def decoded(rows: DataFrame, tokenizer: str, ids_col: str = "ids", keep: dict[str, Column] | None = None) -> DataFrame:
    """The columns in keep, and the text of every sequence of ids (null: empty)."""

    def decoder() -> Transform:
        c = codec(tokenizer)
        return lambda ids: [pa.array([c.decode(x or []) for x in ids.to_pylist()], pa.string())]

    return with_columns(rows, F.col(f"`{ids_col}`"), keep or {}, "text string", decoder)


def op7_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return round_trips(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), "text", {"doc_id": F.col("doc_id")})
