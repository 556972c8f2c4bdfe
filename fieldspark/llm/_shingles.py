"""Vectorised word and shingle hashing over Arrow string buffers.

Words are maximal runs of bytes outside ``[\\x20\\x09-\\x0D]``; ASCII letters
are lower-cased.  A word's 64-bit hash is a polynomial over randomised byte
values, so words hash without Python objects per word.  Work goes through the
buffer in slices of bounded size, so a very long text needs no more memory
than its words' hashes.
"""

from __future__ import annotations

import numpy as np

U = np.uint64
SLICE = 1 << 18

_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.int64).astype(U) * U(2) + U(1)
_BASE = int(_rng.integers(1, 2**62)) * 2 + 1
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_POW: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """``base**i`` and ``base**-i`` modulo 2**64 for i up to n."""
    if "p" not in _POW or len(_POW["p"]) <= n:
        size = max(n + 1, SLICE + 1)
        for key, base in (("p", _BASE), ("q", pow(_BASE, -1, 2**64))):
            steps = np.full(size, base % 2**64, U)
            steps[0] = 1
            _POW[key] = np.multiply.accumulate(steps)
    return _POW["p"], _POW["q"]


def mix(x: np.ndarray) -> np.ndarray:
    """Finalise 64-bit values so that every bit depends on every bit."""
    x = (x ^ (x >> U(31))) * U(0x7FB5D329728EA185)
    x = (x ^ (x >> U(27))) * U(0x81DADEF4BC2DD44D)
    return x ^ (x >> U(33))


def word_hashes(data: np.ndarray) -> np.ndarray:
    """Hashes of the words of one text, given as its UTF-8 bytes."""
    out, at = [], 0
    while at < len(data):
        end = min(at + SLICE, len(data))
        if end < len(data):
            gaps = np.flatnonzero(_SPACE[data[at:end]])
            while not len(gaps) and end < len(data):  # one word longer than the slice
                end = min(end + SLICE, len(data))
                gaps = np.flatnonzero(_SPACE[data[at:end]])
            if len(gaps) and end < len(data):
                end = at + int(gaps[-1]) + 1
        out.append(_slice_hashes(data[at:end])[0])
        at = end
    return np.concatenate(out) if out else np.empty(0, U)


def _slice_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and start offsets of the words of a slice."""
    word = np.zeros(len(data) + 2, np.int8)
    word[1:-1] = ~_SPACE[data]
    edge = np.diff(word)
    start, stop = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    pos, neg = _powers(len(data))
    total = np.zeros(len(data) + 1, U)
    np.cumsum(_BYTE[_LOWER[data]] * pos[: len(data)], out=total[1:])
    return mix((total[stop] - total[start]) * neg[start] + (stop - start).astype(U)), start


def distinct(values: np.ndarray) -> np.ndarray:
    """Sorted distinct values, by a sort: ``np.unique`` hashes, which is slower here."""
    values = np.sort(values)
    return values[np.append(True, values[1:] != values[:-1])] if len(values) else values


def shingles(words: np.ndarray, k: int) -> np.ndarray:
    """Sorted distinct hashes of the k-word shingles; fewer words make one shingle."""
    if len(words) == 0:
        return words
    width = min(k, len(words))
    n = len(words) - width + 1
    acc = np.full(n, U(width), U)
    for i in range(width):
        acc = (acc ^ words[i : i + n]) * U(0x9E3779B97F4A7C15)
        acc ^= acc >> U(29)
    return distinct(mix(acc))


def texts_of(column):
    """Yield each row's UTF-8 bytes (a numpy view); a null gives an empty array."""
    import pyarrow as pa

    if column.type != pa.large_string():
        column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    valid = column.is_valid().to_numpy(zero_copy_only=False)
    for i in range(len(column)):
        yield raw[at[i] : at[i + 1]] if valid[i] else raw[:0]


def word_batches(column):
    """Yield each row's word hashes; short rows share one vectorised pass."""
    texts = list(texts_of(column))
    i = 0
    while i < len(texts):
        if len(texts[i]) > SLICE:
            yield word_hashes(texts[i])
            i += 1
            continue
        j, size = i, 0
        while j < len(texts) and size + len(texts[j]) + 1 <= SLICE + 1:
            size += len(texts[j]) + 1
            j += 1
        joined = np.full(size, 32, np.uint8)
        begin = np.zeros(j - i + 1, np.int64)
        for k in range(i, j):
            lo = begin[k - i]
            joined[lo : lo + len(texts[k])] = texts[k]
            begin[k - i + 1] = lo + len(texts[k]) + 1
        hashes, start = _slice_hashes(joined)
        cut = np.searchsorted(start, begin)
        for k in range(j - i):
            yield hashes[cut[k] : cut[k + 1]]
        i = j
