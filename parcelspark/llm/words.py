"""Words of a text as arrays: where they start and end and a 64-bit hash of each."""

from __future__ import annotations

import numpy as np

from .common import BLOCK_BYTES, mixed, powers

# odd bases of the polynomial hashes
BYTE_BASE = 0x9E3779B97F4A7C15
WORD_BASE = 0xD6E8FEB86659FD93

# [^\x00-\x2F\x3A-\x60\x7B-\x7F] after lower-casing A-Z: digits, a-z and everything beyond ASCII
WORD_BYTE = np.zeros(256, bool)
WORD_BYTE[0x30:0x3A] = WORD_BYTE[0x61:0x7B] = WORD_BYTE[0x80:] = True


def byte_powers() -> tuple[np.ndarray, np.ndarray]:
    """The powers ``word_hashes`` needs; a kernel makes them once."""
    return powers(BYTE_BASE, 2 * BLOCK_BYTES)


def word_bounds(low: bytes, word_byte: np.ndarray = WORD_BYTE) -> tuple[np.ndarray, np.ndarray]:
    """Start and end offsets of the words of a lower-cased text."""
    inside = np.zeros(len(low) + 2, np.int8)
    inside[1:-1] = word_byte[np.frombuffer(low, np.uint8)]
    edge = np.diff(inside)
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def word_hashes(low: bytes, starts: np.ndarray, ends: np.ndarray, base_powers: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Polynomial hash of each word modulo 2**64, block by block so that a long text needs small arrays only."""
    up, down = base_powers
    data = np.frombuffer(low, np.uint8)
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        at = int(starts[i])
        j = max(i + 1, int(np.searchsorted(ends, at + BLOCK_BYTES, "right")))
        until = int(ends[j - 1])
        if until - at > len(up):  # one word longer than a block: fold its pieces
            h = np.uint64(0)
            for piece in range(at, until, BLOCK_BYTES):
                part = data[piece:min(until, piece + BLOCK_BYTES)].astype(np.uint64)
                h = mixed(np.array([h ^ (part * up[:len(part)]).sum(dtype=np.uint64)]))[0]
            out[i] = h
            i += 1
            continue
        sums = np.zeros(until - at + 1, np.uint64)
        np.cumsum(data[at:until].astype(np.uint64) * up[:until - at], out=sums[1:])
        s, e = starts[i:j] - at, ends[i:j] - at
        out[i:j] = mixed((sums[e] - sums[s]) * down[s] + (e - s).astype(np.uint64))
        i = j
    return out


def window_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hash of every run of ``size`` consecutive words; it does not depend on where the run stands."""
    n = len(words) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    factor = 1
    for k in range(size):
        out += words[k:k + n] * np.uint64(factor)
        factor = factor * WORD_BASE % (1 << 64)
    return mixed(out)
