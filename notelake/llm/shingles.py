"""Numpy kernels for character shingles: hashes of all windows of a batch of texts at once."""

from __future__ import annotations

import numpy as np

# The odd fraction of the golden ratio, and shifts and multipliers of a published 64-bit finaliser.
PRIME = np.uint64(0x9E3779B97F4A7C15)
FINALISER = ((30, np.uint64(0xBF58476D1CE4E5B9)), (27, np.uint64(0x94D049BB133111EB)), (31, None))


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")


def mix(x: np.ndarray) -> np.ndarray:
    """Scatters 64-bit numbers over all their bits."""
    for shift, factor in FINALISER:
        x = x ^ (x >> np.uint64(shift))
        if factor is not None:
            x = x * factor
    return x


def window_hashes(cps: np.ndarray, width: int) -> np.ndarray:
    """Hash of every window of `width` code points; empty if the text is shorter."""
    n = len(cps) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    c = cps.astype(np.uint64)
    h = np.zeros(n, np.uint64)
    for j in range(width):
        h *= PRIME
        h += c[j:j + n]
    return mix(h)


def shingle_set(text: str, width: int) -> np.ndarray:
    """Sorted distinct window hashes of a text."""
    return np.unique(window_hashes(code_points(text), width))


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Of two sorted distinct arrays; 0 if both are empty."""
    if not len(a) or not len(b):
        return 0.0
    at = np.searchsorted(a, b)
    at[at == len(a)] = 0
    both = int((a[at] == b).sum())
    return both / (len(a) + len(b) - both)
