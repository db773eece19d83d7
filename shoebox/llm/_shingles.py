"""Vectorised word shingles: the hashed 4-word sets of a batch of texts."""

from __future__ import annotations

import numpy as np

from ._common import LOWER_BYTES

U = np.uint64
_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) | U(1)
_BASE = U(0x9E3779B97F4A7C15)
_INVERSE = U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = max(n, 1 << 20)
        for k, base in enumerate((_BASE, _INVERSE)):
            table = np.full(size, base, np.uint64)
            table[0] = 1
            _powers[k] = np.multiply.accumulate(table)
    return _powers[0][:n], _powers[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of a 64-bit hash."""
    x = (x ^ x >> U(30)) * U(0xBF58476D1CE4E5B9)
    x = (x ^ x >> U(27)) * U(0x94D049BB133111EB)
    return x ^ x >> U(31)


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of lower-cased texts, and where each text's words begin (one more at the end)."""
    data = np.frombuffer(b" ".join(texts).translate(LOWER_BYTES) + b" ", np.uint8)
    sizes = np.array([len(t) + 1 for t in texts], np.int64)
    text_at = np.concatenate([[0], np.cumsum(sizes)])
    solid = ~_SPACE[data]
    edge = np.flatnonzero(np.diff(solid.astype(np.int8), prepend=0))
    starts, ends = edge[::2], edge[1::2]
    powers, inverses = _power_tables(len(data) + 1)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTE[data] * powers[: len(data)])])
    hashes = mix((sums[ends] - sums[starts]) * inverses[starts] + (ends - starts).astype(np.uint64))
    return hashes, np.searchsorted(starts, text_at)


def shingle_sets(texts: list[bytes], n: int = 4) -> list[np.ndarray]:
    """For each text the sorted distinct hashes (63 bits) of its n-word shingles; fewer words make one shingle."""
    words, cuts = word_hashes(texts)
    grams = np.zeros(len(words), np.uint64)
    factors = [U(x) for x in (0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3, 0x1D8E4E27C47D124F)]
    full = len(words) - n + 1
    if full > 0:
        for k in range(n):
            grams[:full] += words[k : k + full] * factors[k % len(factors)] * U(2 * (k // len(factors)) + 1)
        grams[:full] = mix(grams[:full]) >> U(1)
    out = []
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
        if b - a >= n:
            out.append(np.unique(grams[a : b - n + 1]))
        elif b > a:
            whole = U(b - a)
            for k, h in enumerate(words[a:b]):
                with np.errstate(over="ignore"):
                    whole = U(whole + h * factors[(k + 1) % len(factors)] * U(2 * k + 3))
            out.append(mix(np.array([whole], np.uint64)) >> U(1))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def set_identity(tokens: np.ndarray) -> bytes:
    """16 bytes that stand for a set: two sums over differently mixed members."""
    with np.errstate(over="ignore"):
        a = mix(tokens + U(1)).sum(dtype=np.uint64)
        b = mix(tokens ^ U(0xC2B2AE3D27D4EB4F)).sum(dtype=np.uint64) + U(len(tokens))
    return a.tobytes() + b.tobytes()
