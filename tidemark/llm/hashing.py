"""Word and shingle hashes of whole texts, as NumPy arrays, in groups of bounded size.

A word is a run of bytes other than space and 09-0D, with A-Z lower-cased. Its hash is a polynomial in an odd
64-bit base over random values of the bytes, mixed at the end.
"""

import sys

import numpy as np
from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: What a group takes in memory is some forty times its bytes.
GROUP_BYTES = 1 << 18
_BASE = np.uint64(0x9E3779B97F4A7C15)


def mix(x):
    """A bijection of 64-bit values that spreads every bit over all."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True


def _piece(raw: np.ndarray):
    """(start offsets, hashes) of the words of a byte array."""
    solid = ~_SPACE[raw]
    at = np.flatnonzero(solid)
    if not len(at):
        return at, np.zeros(0, np.uint64)
    first = np.flatnonzero(np.r_[True, at[1:] != at[:-1] + 1])
    length = np.diff(np.r_[first, len(at)])
    j = np.arange(len(at)) - np.repeat(first, length)
    power = np.cumprod(np.full(int(length.max()), _BASE, np.uint64), dtype=np.uint64)
    values = _BYTES[_LOWER[raw[at]]] * power[j]
    return at[first], mix(np.add.reduceat(values, first) + length.astype(np.uint64))


def words_of(texts: list[bytes]):
    """(hashes, bounds): the words of text k are hashes[bounds[k]:bounds[k + 1]]."""
    raw = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    starts, hashes, at = [], [], 0
    while at < len(raw):
        end = min(at + GROUP_BYTES, len(raw))
        while end < len(raw) and not _SPACE[raw[end - 1]]:
            more = np.flatnonzero(_SPACE[raw[end : end + GROUP_BYTES]])
            end = end + int(more[0]) + 1 if len(more) else min(end + GROUP_BYTES, len(raw))
        s, h = _piece(raw[at:end])
        starts.append(s + at)
        hashes.append(h)
        at = end
    begin = np.cumsum([0] + [len(t) + 1 for t in texts])
    return np.concatenate(hashes), np.searchsorted(np.concatenate(starts), begin)


def shingles_of(texts: list[bytes], k: int):
    """The distinct hashes of each text's k-word shingles, sorted; a shorter text has one, a text without words none."""
    words, bounds = words_of(texts)
    rows = np.zeros(max(len(words) - k + 1, 0), np.uint64)
    places = mix(np.arange(1, k + 1, dtype=np.uint64))
    for t in range(k):
        rows += mix(words[t : t + len(rows)] + places[t])
    rows = mix(rows)
    out = []
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        n = b - a
        if n >= k:
            out.append(np.unique(rows[a : b - k + 1]))
        elif n:
            out.append(mix(np.cumsum(mix(words[a:b] * np.arange(1, 2 * n, 2, dtype=np.uint64)), dtype=np.uint64)[-1:] + np.uint64(n)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def groups(rows, size_of, most=GROUP_BYTES):
    """Lists of consecutive rows of about `most` bytes."""
    held, total = [], 0
    for r in rows:
        held.append(r)
        total += size_of(r)
        if total >= most:
            yield held
            held, total = [], 0
    if held:
        yield held
