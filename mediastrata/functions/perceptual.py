"""Perceptual hash of raw bytes: a 16 x 16 gradient hash of the bytes seen as a square grey image.

Best effort: the hash depends on a resize filter that no public vector fixes; ours averages areas.
"""

from __future__ import annotations

import base64
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

SIDE, LEAST = 16, 8


def _resize(image: np.ndarray, rows: int, columns: int) -> np.ndarray:
    """Means over equal areas, with fractions of pixels at the edges."""

    def weights(n: int, m: int) -> np.ndarray:
        edges = np.linspace(0, n, m + 1)
        at = np.arange(n)
        return np.clip(np.minimum(edges[1:, None], at + 1) - np.maximum(edges[:-1, None], at), 0, None) * m / n

    return weights(image.shape[0], rows) @ image @ weights(image.shape[1], columns).T


def perceptual_hash(data: bytes) -> str | None:
    """Base64 of the gradient bits; None under 8 x 8 bytes."""
    side = math.isqrt(len(data))
    if side < LEAST:
        return None
    image = np.frombuffer(data[: side * side], dtype=np.uint8).reshape(side, side).astype(float)
    small = _resize(image, SIDE, SIDE + 1)
    return base64.b64encode(np.packbits(small[:, :-1] < small[:, 1:], bitorder="little").tobytes()).decode()


@F.arrow_udf(T.StringType())
def _column(data: pa.Array) -> pa.Array:
    return pa.array([None if x is None else perceptual_hash(x) for x in data.to_pylist()], pa.string())


def perceptual_hash_column(data: Column) -> Column:
    return _column(data)
