"""Hashes of byte strings inside a text, vectorised."""

from __future__ import annotations

import numpy as np

BASE = 0x9E3779B97F4A7C15
U = np.uint64


def gram_hashes(data: np.ndarray, size: int) -> np.ndarray:
    """64-bit hash of each ``size``-byte string of ``data`` (uint8), by its start.

    Hashes of 2m bytes are made of two of m bytes, so the work is logarithmic in ``size``.
    """
    power = data.astype(np.uint64)
    power += U(1)
    power *= U(0xFF51AFD7ED558CCD)
    power ^= power >> U(29)
    length, done, out = 1, 0, None
    rest = size
    while rest:
        if rest & 1:
            if out is None:
                out, done = power, length
            else:
                n = len(data) - done - length + 1
                out = out[:n] * U(pow(BASE, length, 1 << 64)) + power[done : done + n]
                done += length
        rest >>= 1
        if rest:
            n = len(power) - length
            power = power[:n] * U(pow(BASE, length, 1 << 64)) + power[length : length + n]
            length *= 2
    out = out ^ (out >> U(31))
    out *= U(0x7FB5D329728EA185)
    return out ^ (out >> U(27))


def window_minima(values: np.ndarray, width: int) -> np.ndarray:
    """Smallest of each ``width`` neighbouring values."""
    n = len(values) - width + 1
    step = 1
    while step * 2 <= width:
        values = np.minimum(values[:-step], values[step:])
        step *= 2
    return values[:n] if step == width else np.minimum(values[:n], values[width - step : width - step + n])
