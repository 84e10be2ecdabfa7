"""Hashes of character n-grams of a batch of texts, as arrays."""

from __future__ import annotations

import sys
import unicodedata
from functools import cache

import numpy as np
import pyarrow as pa

from .common import code_points, mix64, utf8


@cache
def lower_letters() -> np.ndarray:
    """For every code point its lower case if it is a letter, else 0."""
    table = np.zeros(sys.maxunicode + 1, np.uint32)
    for c in range(sys.maxunicode + 1):
        ch = chr(c)
        if unicodedata.category(ch)[0] == "L":
            low = ch.lower()
            table[c] = ord(low) if len(low) == 1 else c
    return table


@cache
def lower_visible() -> np.ndarray:
    """For every code point its lower case, 0 for white space."""
    table = np.arange(sys.maxunicode + 1, dtype=np.uint32)
    letters = lower_letters()
    table[letters > 0] = letters[letters > 0]
    for c in (*range(9, 14), 0x20, 0x85, 0xA0, 0x2028, 0x2029, 0x3000):
        table[c] = 0
    return table


def spaced(column: pa.Array, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Mapped code points of all texts, a 0 before and after each; the row of each; the offsets of rows."""
    points, offsets = code_points(*utf8(column))
    n = len(offsets) - 1
    lengths = np.diff(offsets)
    row = np.repeat(np.arange(n), lengths)
    out = np.zeros(len(points) + n + 1, np.uint32)
    out[np.arange(len(points)) + row + 1] = table[points]
    at = offsets + np.arange(n + 1)
    return out, np.repeat(np.arange(n + 1), np.append(lengths + 1, 1)), at


def hashes(points: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the n-grams that start at each point, and which of them lie in one word and its borders."""
    size = max(0, len(points) - n + 1)
    h = np.full(size, n, np.uint64)
    inside = np.ones(size, bool)
    with np.errstate(over="ignore"):
        for k in range(n):
            c = points[k : k + size]
            h *= np.uint64(0x9E3779B97F4A7C15)
            h += c
            if 0 < k < n - 1:
                inside &= c != 0
    return mix64(h), inside
