"""Words of texts as arrays of 64-bit hashes."""

from __future__ import annotations

import numpy as np

from . import common

BASE, STEP = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93


def letters_and_digits() -> np.ndarray:
    """Byte table: what [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ keeps after A-Z are lower-cased, else 0."""
    t = np.zeros(256, np.uint64)
    for b in range(256):
        c = b + 32 if 65 <= b <= 90 else b
        if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128:
            t[b] = c + 1
    return t


def not_white() -> np.ndarray:
    """Byte table: what [^\\x20\\x09-\\x0D]+ keeps after A-Z are lower-cased, else 0."""
    t = np.zeros(256, np.uint64)
    for b in range(256):
        if b != 32 and not 9 <= b <= 13:
            t[b] = (b + 32 if 65 <= b <= 90 else b) + 1
    return t


def word_hashes(raw: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word of every text, and offsets of the texts into them.

    UTF-8 makes it safe to work on bytes: every byte of a character that is not
    ASCII has its high bit set, and the word patterns keep all of those.
    """
    n = len(offsets) - 1
    v = table[raw]
    inside = v != 0
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    cut = offsets[:-1][offsets[:-1] < len(raw)]
    begins[cut] = inside[cut]
    starts = np.flatnonzero(begins)
    bounds = np.searchsorted(starts, offsets)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(n + 1, np.int64)
    lengths = np.diff(np.append(starts, len(raw)))
    at = np.arange(starts[0], len(raw)) - np.repeat(starts, lengths)
    p = common.powers(BASE, int(lengths.max()))
    h = np.add.reduceat(v[starts[0] :] * p[at], starts - starts[0])
    return common.mix64(h), bounds


def grams(words: np.ndarray, k: int, seed: int = STEP) -> np.ndarray:
    """Hash of every k consecutive words (also over text bounds; the caller masks those)."""
    m = max(len(words) - k + 1, 0)
    if not m:
        return np.zeros(0, np.uint64)
    p = common.powers(seed, k)
    h = np.zeros(m, np.uint64)
    for j in range(k):
        h += words[j : j + m] * p[j]
    return common.mix64(h)
