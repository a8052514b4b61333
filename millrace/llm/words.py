"""Words of whole batches of texts as 64-bit hashes, without a Python object per word."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa

#: The bytes between words.
_GAP = np.zeros(256, bool)
_GAP[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: Bytes that are hashed at a time.
PART = 1 << 20
_BASE = 0x9E3779B97F4A7C15 | 1
_U = np.uint64
_powers: list[np.ndarray] = []


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit integers."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _letters(fold_case: bool) -> np.ndarray:
    table = mix(np.arange(1, 257, dtype=_U) * _U(0xD6E8FEB86659FD93))
    if fold_case:
        table[ord("A") : ord("Z") + 1] = table[ord("a") : ord("z") + 1]
    return table


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first powers of the base and of its inverse modulo 2^64."""
    if not _powers or len(_powers[0]) < n:
        inverse = pow(_BASE, -1, 1 << 64)
        size = max(n, PART + 65536)
        with np.errstate(over="ignore"):
            _powers[:] = [np.multiply.accumulate(np.concatenate(([_U(1)], np.full(size - 1, _U(b))))) for b in (_BASE, inverse)]
    return _powers[0][:n], _powers[1][:n]


def word_hashes(texts: pa.Array, fold_case: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, row, start byte and end byte (within the row's text) of every word; null texts have none."""
    if texts.null_count:
        texts = texts.fill_null("")
    texts = texts.cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    n = len(data)
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    inside = ~_GAP[data]
    starts = np.flatnonzero(inside & (edge[:-1] | np.concatenate(([True], ~inside[:-1]))))
    ends = np.flatnonzero(inside & (edge[1:] | np.concatenate((~inside[1:], [True])))) + 1
    letters, out = _letters(fold_case), np.empty(len(starts), _U)
    first = 0
    with np.errstate(over="ignore"):
        while first < len(starts):
            begin = starts[first]
            last = max(first + 1, int(np.searchsorted(ends, begin + PART, "right")))
            stop = ends[last - 1]
            up, down = _power(stop - begin)
            total = np.concatenate(([_U(0)], np.cumsum(letters[data[begin:stop]] * up, dtype=_U)))
            a, b = starts[first:last] - begin, ends[first:last] - begin
            out[first:last] = mix((total[b] - total[a]) * down[a] + (b - a).astype(_U))
            first = last
    row = np.searchsorted(offsets, starts, "right") - 1
    return out, row, starts - offsets[row], ends - offsets[row]


def gram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """The hash of each n consecutive words, by their first word's place; they may cross rows."""
    size = len(words) - n + 1
    if size <= 0:
        return np.empty(0, _U)
    with np.errstate(over="ignore"):
        total = np.zeros(size, _U)
        for k in range(n):
            total *= _U(_BASE)
            total += words[k : k + size]  # words are scrambled already
        return mix(total)


#: Odd factors of the two lanes.
_LANES = (_U(0x9E3779B97F4A7C15), _U(0xC2B2AE3D27D4EB4F))


def word_digests(texts: pa.Array, fold_case: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """The 128-bit BLAKE2 digest of every word, as two lanes of 64 bits, and its row; null texts have none.

    Words are told apart by their bytes, so that each different one of a batch is hashed once.
    """
    if texts.null_count:
        texts = texts.fill_null("")
    texts = texts.cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    if fold_case:
        data = np.where((data >= ord("A")) & (data <= ord("Z")), data + np.uint8(32), data)
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    inside = ~_GAP[data]
    starts = np.flatnonzero(inside & (edge[:-1] | np.concatenate(([True], ~inside[:-1]))))
    ends = np.flatnonzero(inside & (edge[1:] | np.concatenate((~inside[1:], [True])))) + 1
    # words and the gaps between them alternate, so the text's own bytes serve as the array
    cuts = np.append(np.stack((starts, ends), 1).reshape(-1), len(data)).astype(np.int64)
    told = pa.Array.from_buffers(pa.large_binary(), 2 * len(starts), [None, pa.py_buffer(cuts), pa.py_buffer(np.ascontiguousarray(data))]).dictionary_encode()
    digests = np.frombuffer(b"".join(hashlib.blake2b(w, digest_size=16).digest() for w in told.dictionary.to_pylist()), _U).reshape(-1, 2)
    return digests[told.indices.to_numpy()[::2]], np.searchsorted(offsets, starts, "right") - 1


def gram_digests(words: np.ndarray, n: int) -> np.ndarray:
    """Two lanes for each n consecutive words of :func:`word_digests`, by their first word's place; they may cross rows."""
    size = len(words) - n + 1
    if size <= 0:
        return np.empty((0, 2), _U)
    total = np.zeros((size, 2), _U)
    with np.errstate(over="ignore"):
        for k in range(n):
            for lane, factor in enumerate(_LANES):
                total[:, lane] = mix((total[:, lane] + words[k : k + size, lane]) * factor)
    return total


def distinct(lanes: np.ndarray) -> np.ndarray:
    """The different rows of two lanes, ordered by the first lane, then the second."""
    out = lanes[np.argsort(lanes[:, 0], kind="stable")]
    same = out[1:] == out[:-1]
    if (same[:, 0] & ~same[:, 1]).any():  # different ones may share the first lane
        out = lanes[np.lexsort((lanes[:, 1], lanes[:, 0]))]
        same = out[1:] == out[:-1]
    return out[np.concatenate((np.ones(min(1, len(out)), bool), ~same.all(1)))]
