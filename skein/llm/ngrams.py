"""Hashed byte n-grams of many texts at once, as numpy arrays."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np

_u = np.uint32
#: Odd multipliers for the hash of each n-gram length.
_MULTIPLY = np.array([0, 0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F, 0x165667B1, 0x2545F491], _u)


def hashed(flat: np.ndarray, n: int, bits: int) -> np.ndarray:
    """The bucket, below 2**bits, of each n-gram of ``flat`` (bytes), by its first byte's place."""
    h = np.full(max(len(flat) - n + 1, 0), n, _u)
    for k in range(n if len(h) else 0):
        h = (h + flat[k : len(flat) - n + 1 + k]) * _MULTIPLY[n]
        h ^= h >> _u(15)
    return (h * _u(0x9E3779B1)) >> _u(32 - bits)


def slices(texts: Iterable, most: int = 1 << 20) -> Iterator[list[str]]:
    """Consecutive texts of about ``most`` characters together, or one longer text; nulls are empty."""
    part, size = [], 0
    for t in texts:
        part.append((t.as_py() if hasattr(t, "as_py") else t) or "")
        size += len(part[-1])
        if size >= most:
            yield part
            part, size = [], 0
    if part:
        yield part


def joined(texts: list[str], lower: bool, words: bool) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, starts) of the texts one after another, each between spaces; starts has one more. Empty
    texts have no bytes. ``words``: white space is one space each."""
    made = []
    for t in texts:
        raw = (t.lower() if lower else t).encode("utf-8", "replace")
        raw = b" ".join(raw.split()) if words else raw
        made.append(b" %s " % raw if raw else b"")
    starts = np.cumsum([0, *map(len, made)])
    return np.frombuffer(b"".join(made), np.uint8).astype(_u), starts


def sums(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sums of ``values`` between starts, in double precision; empty stretches give 0."""
    total = np.zeros(len(values) + 1)
    np.cumsum(values, out=total[1:])
    return total[np.minimum(starts[1:], len(values))] - total[np.minimum(starts[:-1], len(values))]
