"""64-bit gram keys: a polynomial over the bytes, kept apart by a secret, and mixed. NumPy's uint64 wraps as needed."""

from __future__ import annotations

import numpy as np

BASE = 0x9E3779B97F4A7C15
FOLD_SALT = 0xF01D5A17C0DED00D
MASK64 = (1 << 64) - 1
LONGEST = 16


def folded(secret: int = 0) -> int:
    """The secret of the key space for grams of the case-folded text."""
    return secret ^ FOLD_SALT


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finalizer; the argument is left as it is."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def mix_int(x: int) -> int:
    return int(mix(np.array([x & MASK64], np.uint64))[0])


def key_of(gram: bytes, secret: int = 0) -> int:
    """The key of a gram as a signed 64-bit number, as Spark keeps it."""
    h = 1
    for b in gram:
        h = (h * BASE + b) & MASK64
    return as_signed(mix_int(h ^ secret))


def as_signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def as_unsigned(x: int) -> int:
    return x & MASK64


def powers(n: int) -> np.ndarray:
    out = np.full(n + 1, BASE, np.uint64)
    out[0] = 1
    return np.cumprod(out)


def fnv1a(data: bytes) -> int:
    """64-bit FNV-1a."""
    h = 0xCBF29CE484222325
    for b in data:
        h = ((h ^ b) * 0x100000001B3) & MASK64
    return h


def path_hash(path: str) -> int:
    """FNV-1a of a path with forward slashes."""
    return fnv1a(path.replace("\\", "/").encode("utf-8", "surrogatepass"))
