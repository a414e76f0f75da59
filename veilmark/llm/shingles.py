"""Hashes of words and of word n-grams, vectorised over the bytes of many texts at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

_RNG = np.random.default_rng(20240517)
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_ORDER = _RNG.integers(1, 2**63, 64, dtype=np.uint64) | np.uint64(1)
#: Bytes of texts hashed at once; a longer text is hashed alone.
_BLOCK = 1 << 20


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads every bit of 64-bit numbers over all bits."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _hash_words(data: bytes) -> np.ndarray:
    """A hash of each word of words joined by single spaces."""
    a = np.frombuffer(data, np.uint8)
    space = a == 32
    starts = np.concatenate(([0], np.flatnonzero(space) + 1))
    lengths = np.diff(np.concatenate((starts, [len(a) + 1]))) - 1
    powers = np.ones(int(lengths.max()) + 2, np.uint64)
    np.multiply.accumulate(np.full(len(powers) - 1, _BASE), out=powers[1:])
    place = np.arange(len(a)) - np.repeat(starts, lengths + 1)[: len(a)]
    part = np.where(space, np.uint64(0), _BYTE[a] * powers[place])
    return mix(np.add.reduceat(part, starts) + lengths.astype(np.uint64))


def word_hashes(texts: list[bytes]) -> Iterator[np.ndarray]:
    """For each text (words joined by single spaces) the hashes of its words, in order."""
    at = 0
    while at < len(texts):
        end, size = at, 0
        while end < len(texts) and (end == at or size + len(texts[end]) <= _BLOCK):
            size += len(texts[end]) + 1
            end += 1
        filled = [t for t in texts[at:end] if t]
        hashes = _hash_words(b" ".join(filled)) if filled else np.empty(0, np.uint64)
        done = 0
        for t in texts[at:end]:
            n = t.count(b" ") + 1 if t else 0
            yield hashes[done : done + n]
            done += n
        at = end


def gram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the n-grams of a text's word hashes; a text of fewer words is one gram, an empty one has none."""
    if not len(words):
        return np.empty(0, np.uint64)
    if len(words) < n:
        return mix((words * _ORDER[: len(words)]).sum(keepdims=True) + np.uint64(len(words)))
    total = np.zeros(len(words) - n + 1, np.uint64)
    for i in range(n):
        total += words[i : len(total) + i] * _ORDER[i]
    return mix(total + np.uint64(n))
