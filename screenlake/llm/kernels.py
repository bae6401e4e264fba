"""Hash kernels over UTF-8 bytes in numpy: ranges of bytes by prefix sums, words, and word shingles."""

from __future__ import annotations

import numpy as np

_RNG = np.random.Generator(np.random.PCG64(20_240_501))
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64)
_BASE = int(_RNG.integers(2**61, 2**62)) * 2 + 1
_WORD = (_RNG.integers(2**61, 2**62, 64).astype(np.uint64) << np.uint64(1)) | np.uint64(1)
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]

#: ASCII white space and A-Z to a-z.
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The base's powers 0 to n - 1 and their inverses, modulo 2**64."""
    if len(_POWERS[0]) < n:
        most = 1 << (n - 1).bit_length()
        inverse = pow(_BASE, -1, 2**64)
        for k, b in ((0, _BASE), (1, inverse)):
            p = np.ones(1, np.uint64)
            while len(p) < most:
                p = np.concatenate([p, p * np.uint64(pow(b, len(p), 2**64))])
            _POWERS[k] = p
    return _POWERS[0][:n], _POWERS[1][:n]


def prefix_sums(b: np.ndarray) -> np.ndarray:
    out = np.zeros(len(b) + 1, np.uint64)
    np.cumsum(_BYTE[b] * powers(len(b))[0], out=out[1:])
    return out


def range_hashes(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of bytes [start, end) that depend on the bytes alone."""
    return mix((sums[end] - sums[start]) * powers(len(sums))[1][start] + (end - start).astype(np.uint64))


def joined(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The texts' bytes one after the other, each followed by a space, and where each begins (with the end)."""
    raw = [t.encode() for t in texts]
    starts = np.zeros(len(raw) + 1, np.int64)
    np.cumsum([len(r) + 1 for r in raw], out=starts[1:])
    return np.frombuffer(b" ".join([*raw, b""]), np.uint8), starts


def word_hashes(texts: list[str], most: int = 1 << 20) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words [^\\x20\\x09-\\x0D]+ with A-Z lower-cased, and each text's first (with the end)."""
    b, starts = joined(texts)
    hashes, at = [], []
    a = 0
    while a < len(b):
        e = min(a + most, len(b))
        while e < len(b) and not IS_SPACE[b[e - 1]]:  # blocks end after white space
            gap = np.flatnonzero(IS_SPACE[b[e : e + 65_536]])
            e = e + int(gap[0]) + 1 if len(gap) else min(e + 65_536, len(b))
        block = LOWER[b[a:e]]
        space = IS_SPACE[block]
        edge = np.flatnonzero(np.diff(np.concatenate([[True], space, [True]])))
        s, t = edge[::2], edge[1::2]
        hashes.append(range_hashes(prefix_sums(block), s, t))
        at.append(s + a)
        a = e
    h = np.concatenate(hashes) if hashes else np.empty(0, np.uint64)
    at = np.concatenate(at) if at else np.empty(0, np.int64)
    return h, np.searchsorted(at, starts)


def shingle_sets(texts: list[str], words: int) -> list[np.ndarray]:
    """Each text's sorted set of shingle hashes; a text of fewer words has its whole sequence as one, without words none."""
    h, first = word_hashes(texts)
    n = len(h)
    if n >= words:
        grams = np.zeros(n - words + 1, np.uint64)
        for k in range(words):
            grams += h[k : n - words + 1 + k] * _WORD[k]
        grams = mix(grams)
    out = []
    for a, e in zip(first[:-1].tolist(), first[1:].tolist()):
        if e - a >= words:
            out.append(np.unique(grams[a : e - words + 1]))
        elif e > a:
            short = np.uint64(e - a)
            for k in range(e - a):
                short = np.uint64((int(short) + int(h[a + k]) * int(_WORD[k % 32 + 32])) % 2**64)
            out.append(mix(np.array([short], np.uint64)))
        else:
            out.append(np.empty(0, np.uint64))
    return out
