"""Sets of hashed word shingles, worked out over whole buffers of bytes."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np

#: Bytes that are hashed together.
BUFFER = 1 << 20

_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_RANDOM = np.random.Generator(np.random.PCG64(20240229))
#: A random word for each byte at each of the first 64 places of a word; later places turn it by an odd factor.
_BYTES = _RANDOM.integers(0, 1 << 64, (64, 256), np.uint64)
_PLACES = _RANDOM.integers(0, 1 << 64, 256, np.uint64) | np.uint64(1)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _words(buffer: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hash and first byte of each word, A-Z lower-cased, words between runs of white space."""
    raw = _LOWER[np.frombuffer(buffer, np.uint8)]
    space = _SPACE[raw]
    starts = ~space
    starts[1:] &= space[:-1]
    first = np.flatnonzero(starts)
    if not len(first):
        return np.zeros(0, np.uint64), first
    at = np.flatnonzero(~space)
    heads = np.flatnonzero(starts[at])
    place = at - np.repeat(first, np.diff(np.append(heads, len(at))))
    value = _BYTES[place & 63, raw[at]]
    if (far := place >> 6).any():
        value = value * (np.uint64(2) * far.astype(np.uint64) + np.uint64(1))
    return mixed(np.add.reduceat(value, heads)), first


def _grams(words: np.ndarray, k: int) -> np.ndarray:
    if len(words) < k:
        return mixed((words * _PLACES[128 : 128 + len(words)]).sum(dtype=np.uint64, keepdims=True) + np.uint64(len(words))) if len(words) else words
    total = words[: len(words) - k + 1] * _PLACES[0]
    for j in range(1, k):
        total = total + words[j : len(words) - k + 1 + j] * _PLACES[j]
    return mixed(total)


def shingle_sets(texts: Iterable[str | None], k: int = 4) -> Iterator[np.ndarray]:
    """For each text its distinct shingles of ``k`` words (all words if fewer) as ascending 64-bit numbers."""
    held: list[bytes] = []
    size = 0

    def flush() -> Iterator[np.ndarray]:
        hashes, first = _words(b"\n".join(held))
        ends = np.searchsorted(first, np.cumsum([len(t) + 1 for t in held]))
        for a, b in zip(np.concatenate([[0], ends[:-1]]), ends):
            yield np.unique(_grams(hashes[a:b], k))

    for text in texts:
        held.append((text or "").encode("utf-8", "surrogatepass"))
        size += len(held[-1])
        if size >= BUFFER:
            yield from flush()
            held, size = [], 0
    if held:
        yield from flush()
