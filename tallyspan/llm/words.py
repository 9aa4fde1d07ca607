"""Words of whole texts as 64-bit hashes, found and hashed by numpy over Arrow's buffers.

A word is a longest run of ASCII letters and digits and of non-ASCII characters; A-Z are
lower-cased. Two different words share a hash with probability 2^-64.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit over all others."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


with np.errstate(over="ignore"):
    _KEY = mix(np.arange(1, 257, dtype=np.uint64) * _MULTIPLIER)
    _KEY[65:91] = _KEY[97:123]
    _POWER = np.cumprod(np.full(1 << 16, _MULTIPLIER, np.uint64))
_IN_WORD = np.zeros(256, bool)
for _low, _high in ((48, 58), (65, 91), (97, 123), (128, 256)):
    _IN_WORD[_low:_high] = True


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all texts, offset of each text and the end); null counts as empty."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    if not len(texts):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


class Words:
    """hashes: of all words in order; first: index of each text's first word, and the end;
    start, end: byte places in data; offsets: of each text's bytes; heads: for each n asked
    for, hashes of the words' first n bytes."""

    def __init__(self, texts: pa.Array, heads: tuple[int, ...] = ()):
        self.data, self.offsets = data, offsets = text_bytes(texts)
        inside = _IN_WORD[data]
        fresh = np.ones(len(data) + 1, bool)
        fresh[1:] = ~np.append(inside[:-1], False) if len(data) else False
        fresh[offsets] = True
        self.start = np.flatnonzero(inside & fresh[:-1])
        last = np.ones(len(data), bool)
        if len(data):
            last[:-1] = ~inside[1:]
            cut = offsets[(offsets > 0)] - 1
            last[cut] = True
        self.end = np.flatnonzero(inside & last) + 1
        self.first = np.searchsorted(self.start, offsets)
        length = self.end - self.start
        at = np.cumsum(length) - length
        within = np.arange(int(length.sum())) - np.repeat(at, length)
        with np.errstate(over="ignore"):
            value = _KEY[np.compress(inside, data)] * _POWER[within & 0xFFFF]
            if len(length) and length.max() > len(_POWER):  # places further on differ by their block too
                value *= np.where(within > 0xFFFF, mix((within >> 16).astype(np.uint64)) | np.uint64(1), np.uint64(1))
            total = lambda value: mix(np.add.reduceat(value, at)) if len(at) else np.empty(0, np.uint64)
            self.hashes = total(value)
            self.heads = [total(value * (within < n)) for n in heads]

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def of(self, i: int) -> np.ndarray:
        return self.hashes[self.first[i] : self.first[i + 1]]


def slices(texts: pa.Array, most: int = 1 << 19) -> Iterator[tuple[int, int]]:
    """Ranges of texts that hold about `most` bytes together, or one longer text."""
    size = np.append(0, np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)))
    low = 0
    while low < len(texts):
        high = max(low + 1, int(np.searchsorted(size, size[low] + most, "right")) - 1)
        yield low, high
        low = high


def windows(hashes: np.ndarray, n: int) -> np.ndarray:
    """One hash for each run of n words, in order."""
    count = max(0, len(hashes) - n + 1)
    out = np.zeros(count, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(n):
            out = mix(out * _MULTIPLIER + hashes[k : k + count])
    return out
