"""Seeded draws: a pure function of (seed, tag, row id), as Spark SQL text.

The same row gets the same value on every attempt, partitioning and cluster,
so a lost task recomputes exactly what it lost.  The mixing step is the
published two-multiply 32-bit integer finalizer; every product stays below
2^63, so the whole draw is plain long arithmetic inside generated code.
``row_id`` and ``n`` are SQL expressions, usually column names.
"""

from __future__ import annotations

import hashlib

MASK32 = 0xFFFFFFFF
MASK31 = 0x7FFFFFFF

# Shifts and multipliers of the 32-bit finalizer.
MIX_SHIFTS = (16, 15, 15)
MIX_MULTIPLIERS = (0x21F0AAAD, 0x735A2D97)


def stream_constants(seed: int, tag: str) -> tuple[int, int, int]:
    """Two odd multipliers below 2^30 and an offset, one set per drawn column."""
    digest = hashlib.md5(f"{seed}:{tag}".encode()).digest()
    low, high, offset = (int.from_bytes(digest[i : i + 4], "big") for i in (0, 4, 8))
    return (low >> 2) | 1, (high >> 2) | 1, offset


def u32(seed: int, tag: str, row_id: str) -> str:
    """Uniform whole number in [0, 2^32)."""
    low, high, offset = stream_constants(seed, tag)
    folded = f"({row_id} & {MASK32}L) * {low}L + {offset}L"
    x = f"((({folded}) ^ (shiftright({row_id}, 32) * {high}L)) & {MASK32}L)"
    for shift, multiplier in zip(MIX_SHIFTS, MIX_MULTIPLIERS):
        x = f"((({x} ^ shiftright({x}, {shift})) * {multiplier}L) & {MASK32}L)"
    return f"({x} ^ shiftright({x}, {MIX_SHIFTS[-1]}))"


def u63(seed: int, tag: str, row_id: str) -> str:
    """Uniform whole number in [0, 2^63) from two streams."""
    rest = u32(seed, tag + "/low", row_id)
    return f"(shiftleft({u32(seed, tag, row_id)}, 31) | ({rest} & {MASK31}L))"


def draw(seed: int, tag: str, row_id: str, n: int | str) -> str:
    """Uniform whole number in [0, n): multiply-shift for small constant n,
    otherwise the remainder of 63 bits, which carries any table size."""
    if isinstance(n, int):
        if n < 1:
            raise ValueError(f"{tag}: nothing to draw from")
        if n <= MASK31:
            return f"shiftright({u32(seed, tag, row_id)} * {n}L, 32)"
        n = f"{n}L"
    return f"({u63(seed, tag, row_id)} % {n})"


def chance(seed: int, tag: str, row_id: str, probability: float) -> str:
    """True with the given probability."""
    return f"({u32(seed, tag, row_id)} < {int(probability * (1 << 32))}L)"
