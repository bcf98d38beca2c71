"""Sets of word shingles as arrays of 64-bit hashes, a batch of texts at a time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from .common import mix64

WORDS = 5
#: Bytes of text that are hashed together.
CHUNK_BYTES = 1 << 20

_rng = np.random.default_rng(20_24)
_BYTE = _rng.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + _rng.integers(0, 2, 256, dtype=np.uint64)
_PLACE = _rng.integers(0, 1 << 63, 4096, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_TURN = _rng.integers(0, 1 << 63, WORDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: White space becomes a space, A-Z become lower case, other bytes stay.
_PLAIN = np.arange(256, dtype=np.uint8)
_PLAIN[9:14] = 32
_PLAIN[65:91] += 32


def _bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The texts' bytes without gaps, and offsets of the texts in them."""
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, kind, len(column) + 1, column.offset * np.dtype(kind).itemsize).astype(np.int64)
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word ([^\\x20\\x09-\\x0D]+ with A-Z in lower case), and how many words each text has."""
    data = _PLAIN[data]
    inside = data != 32
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    first = offsets[:-1][offsets[:-1] < offsets[1:]]
    begins[first] = inside[first]
    starts = np.flatnonzero(begins)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(len(offsets) - 1, np.int64)
    kept = data[inside]
    at = np.cumsum(inside)[starts] - 1  # where each word begins among the bytes that are kept
    lengths = np.diff(np.r_[at, len(kept)])
    place = np.arange(len(kept)) - np.repeat(at, lengths)
    hashes = np.add.reduceat(_BYTE[kept] * _PLACE[place & 4095], at)
    return mix64(hashes ^ lengths.astype(np.uint64)), np.diff(np.searchsorted(starts, offsets))


def shingle_sets(column: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct shingle hashes) of each text; with fewer than WORDS words the whole sequence is the one shingle."""
    data, offsets = _bytes(column)
    row = 0
    while row < len(column):
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + CHUNK_BYTES, side="right")) - 1)
        own = offsets[row : end + 1]
        words, counts = word_hashes(data[own[0] : own[-1]], own - own[0])
        total = np.zeros(len(words), np.uint64)
        for j in range(WORDS):
            total[: len(words) - j] += words[j:] * _TURN[j]
        total = mix64(total)
        stops = np.cumsum(counts)
        for i, (stop, n) in enumerate(zip(stops.tolist(), counts.tolist())):
            if n >= WORDS:
                hashes = np.sort(total[stop - n : stop - WORDS + 1])
                fresh = np.empty(len(hashes), bool)
                fresh[0] = True
                np.not_equal(hashes[1:], hashes[:-1], out=fresh[1:])
                yield row + i, hashes[fresh]
            elif n:
                yield row + i, mix64(np.array([np.sum(words[stop - n : stop] * _TURN[:n]) + np.uint64(n)], np.uint64))
            else:
                yield row + i, np.zeros(0, np.uint64)
        row = end


def set_hash(shingles: np.ndarray) -> int:
    """One signed 64-bit hash of a set."""
    return int(mix64(np.array([np.sum(mix64(shingles)) + np.uint64(len(shingles))], np.uint64)).view(np.int64)[0])
