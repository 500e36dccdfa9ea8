"""Golomb codes of sorted distinct numbers: gaps as a unary quotient and a remainder of fixed width."""

from __future__ import annotations

import math
import struct

import numpy as np


def encode(values: np.ndarray, span: int) -> bytes:
    """Code sorted distinct numbers below ``span``; the parameter is a power of two near the mean gap times ln 2."""
    count = len(values)
    width = max(0, int(math.log2(max(1.0, math.log(2) * span / max(1, count)))))
    gaps = np.diff(values.astype(np.int64), prepend=-1) - 1
    quotients = gaps >> width
    unary = np.ones(int(quotients.sum()) + count, np.uint8)
    unary[np.cumsum(quotients + 1) - 1] = 0
    rest = (gaps[:, None] >> np.arange(width)) & 1
    return struct.pack("<IBI", count, width, len(unary)) + np.packbits(unary).tobytes() + np.packbits(rest.astype(np.uint8)).tobytes()


def decode(blob: bytes) -> np.ndarray:
    count, width, ones = struct.unpack_from("<IBI", blob)
    packed = np.frombuffer(blob, np.uint8, offset=struct.calcsize("<IBI"))
    cut = -(-ones // 8)
    ends = np.flatnonzero(np.unpackbits(packed[:cut], count=ones) == 0)
    quotients = np.diff(ends, prepend=-1) - 1
    bits = np.unpackbits(packed[cut:], count=count * width).reshape(count, width).astype(np.int64)
    gaps = (quotients << width) + bits @ (1 << np.arange(width, dtype=np.int64))
    return np.cumsum(gaps + 1) - 1
