"""Hashed word shingles of whole texts, many texts at a time."""

from __future__ import annotations

import hashlib

import numpy as np

#: Bytes of text hashed in one go; a longer text is a chunk of its own.
CHUNK = 1 << 18
_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_MIX = (_U(0xBF58476D1CE4E5B9), _U(0x94D049BB133111EB))
_STEP = np.array([int.from_bytes(hashlib.blake2b(b"step%d" % i, digest_size=8).digest(), "little") | 1 for i in range(64)], _U)
#: White space of the word rule: space and U+0009 to U+000D.
_SPACE = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
#: A number for each byte; A-Z have those of a-z, white space has 0.
_BYTE = np.array([int.from_bytes(hashlib.blake2b(bytes([b]).lower(), digest_size=8).digest(), "little") for b in range(256)], _U)
_BYTE[_SPACE] = 0
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    got = _powers.get(base)
    if got is None or len(got) < n:
        got = np.cumprod(np.full(max(n, CHUNK + 1), base % 2**64, _U))
        if n <= 2 * CHUNK:
            _powers[base] = got
    return got[:n]


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _U(30))) * _MIX[0]
    h = (h ^ (h >> _U(27))) * _MIX[1]
    return h ^ (h >> _U(31))


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in order, and where each text's words begin (one more entry than texts)."""
    data = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    space = _SPACE[data]
    edge = np.flatnonzero(np.diff(space, prepend=True))
    start, end = edge[::2], edge[1::2]
    run = np.cumsum(_BYTE[data] * _power(_BASE, len(data)))
    run = np.concatenate([[_U(0)], run])
    back = _power(pow(_BASE, -1, 2**64), len(data))
    words = mix((run[end] - run[start]) * back[start] + (end - start).astype(_U) * _STEP[0])
    ends = np.cumsum([0, *(len(t) + 1 for t in texts)])
    return words, np.searchsorted(start, ends)


def shingle_sets(texts: list[bytes], k: int) -> list[np.ndarray]:
    """Sorted distinct hashes (signed) of each text's ``k``-word shingles.

    A text of fewer words has its whole sequence as one shingle, a text
    without words has none.
    """
    out: list[np.ndarray] = []
    at = 0
    while at < len(texts):
        end, total = at, 0
        while end < len(texts) and (end == at or total + len(texts[end]) <= CHUNK):
            total += len(texts[end])
            end += 1
        words, cut = word_hashes(texts[at:end])
        n = len(words)
        full = np.zeros(max(n - k + 1, 0), _U)
        for i in range(k):
            full += words[i:n - k + 1 + i] * _STEP[i + 1] if n >= k else _U(0)
        full = mix(full).view(np.int64)
        for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
            if b - a >= k:
                out.append(np.unique(full[a:b - k + 1]))
            elif b > a:
                out.append(mix((words[a:b] * _STEP[1:b - a + 1]).sum(keepdims=True) + _STEP[b - a]).view(np.int64))
            else:
                out.append(np.zeros(0, np.int64))
        at = end
    return out


def set_digest(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()
