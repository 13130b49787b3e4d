"""Canonical manifest JSON: the bytes that are hashed and signed.

Signed is the parsed content written again: compact, unescaped Unicode, fields in their declared order, the type tag first,
absent optional fields as null (display_name alone is left out), unknown fields dropped.
"""

from __future__ import annotations

import json
from typing import Any

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The manifest's fields, in order. "?" marks an optional field, "[]" a list that may be absent; a name is a nested object.
FIELDS: dict[str, tuple[tuple[str, str], ...]] = {
    "manifest": (("content", "content"), ("signatures", "signature*")),
    "signature": (("signature", ""), ("public_key", ""), ("display_name", "-")),
    "Original": (("work_id", ""), ("title", ""), ("authors", "author*"), ("authorship_fingerprint", "?"), ("created_at", ""), ("tracks", "track*")),
    "author": (("author_id", ""), ("name", ""), ("role", "")),
    "track": (
        ("track_id", ""), ("codec", ""), ("container_type", "?"), ("codec_extradata", "?"), ("width", "?"), ("height", "?"), ("sample_rate", "?"), ("channel_count", "?"),
        ("timebase_num", "?"), ("timebase_den", "?"), ("merkle_root", ""), ("perceptual_hash", "?"), ("total_chunks", ""), ("chunk_size", ""), ("chunk_index", "entry[]"),
    ),
    "entry": (("chunk_index", ""), ("pts", "?"), ("offset", ""), ("size", "")),
    "Derivative": (
        ("derivative_id", ""), ("original_owd", "Original"), ("original_signature", ""), ("ancestry", "manifest[]"), ("clipper_id", ""), ("authorship_fingerprint", "?"),
        ("created_at", ""), ("clip_mappings", "mapping*"),
    ),
    "mapping": (("track_id", ""), ("start_chunk_index", ""), ("end_chunk_index", ""), ("proofs", "proof*")),
    "proof": (("chunk_index", ""), ("hash", ""), ("path", "step*"), ("chunk_size", ""), ("pts", "?")),
    "step": (("is_left", ""), ("hash", "")),
}


class MalformedManifest(ValueError):
    """A manifest that lacks a mandatory field or has the wrong shape."""


def canonical(kind: str, value: Any) -> dict[str, Any]:
    """The value with its kind's fields, in order."""
    if not isinstance(value, dict):
        raise MalformedManifest(f"{kind}: not an object")
    out: dict[str, Any] = {}
    if kind == "content":
        kind = value.get("type", "")
        if kind not in ("Original", "Derivative"):
            raise MalformedManifest(f"content: unknown type {kind!r}")
        out["type"] = kind
    for name, how in FIELDS[kind]:
        found = value.get(name)
        if how == "-":
            if found is not None:
                out[name] = found
        elif how == "?":
            out[name] = found
        elif how[-1:] == "*" or how[-2:] == "[]":
            if name not in value and how[-1] == "*" or name in value and not isinstance(found, list):
                raise MalformedManifest(f"{kind}: {name} isn't a list")
            out[name] = [canonical(how.rstrip("*[]"), x) for x in found or []]
        elif found is None:
            raise MalformedManifest(f"{kind}: no {name}")
        else:
            out[name] = canonical(how, found) if how else found
    return out


def to_bytes(value: dict[str, Any]) -> bytes:
    return json.dumps(value, separators=(",", ":"), ensure_ascii=False).encode()


def content_bytes(manifest_json: str | bytes) -> bytes:
    """The canonical bytes of a signed manifest's content."""
    return to_bytes(canonical("content", json.loads(manifest_json)["content"]))


@F.arrow_udf(T.BinaryType())
def _content_column(manifests: pa.Array) -> pa.Array:
    out = []
    for m in manifests.to_pylist():
        try:
            out.append(None if m is None else content_bytes(m))
        except (ValueError, KeyError, TypeError):
            out.append(None)
    return pa.array(out, pa.binary())


def content_column(manifest_json: Column) -> Column:
    """The canonical content of each manifest; null where it can't be parsed."""
    return _content_column(manifest_json)
