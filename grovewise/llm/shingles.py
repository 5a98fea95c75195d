"""Word shingles of whole texts, hashed over a whole Arrow batch at once.

Words are runs of the bytes other than space and 0x09 to 0x0D, A-Z lower-cased. A word's hash is a polynomial in its
bytes (each mapped to a random 64-bit number), taken from one running sum over the batch; a shingle's hash mixes its
words' hashes. Equal hashes of 64 bits stand for equal shingles.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
_RNG = np.random.default_rng(20)
BYTE = _RNG.integers(0, 2**64, 256, dtype=np.uint64)
PLACE = _RNG.integers(0, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BASE = 0x9E3779B97F4A7C15
BLOCK = 1 << 22  # bytes worked on at once
BASE_INVERSE = pow(BASE, -1, 2**64)


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit hashes."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


@lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The powers of BASE and of its inverse modulo 2**64, up to n - 1."""
    return tuple(np.multiply.accumulate(np.append(np.uint64(1), np.full(n - 1, b, dtype=np.uint64))) for b in (BASE, BASE_INVERSE))


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string array, null as empty."""
    texts = texts.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]] if len(offsets) else data[:0], offsets - offsets[0] if len(offsets) else np.zeros(1, np.int64)


def _blocks(data: np.ndarray, marks: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of about BLOCK bytes that end where no word goes on: at a space or a text's end."""
    at = 0
    while at < len(data):
        end = min(at + BLOCK, len(data))
        while end < len(data):
            stop = SPACE[data[end : end + BLOCK]] | marks[end : min(end + BLOCK, len(data))]
            if stop.any():
                end += int(stop.argmax())
                break
            end = min(end + BLOCK, len(data))
        yield at, end
        at = end


def words_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every word in order, first word of each text and the number of words).

    Works through the bytes in blocks, so that what it needs at once, beside the texts and the words' hashes, doesn't
    follow the length of a text: a few bytes for each byte of text.
    """
    data, offsets = text_bytes(texts)
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    marks = np.zeros(len(data) + 1, dtype=bool)
    marks[offsets] = True
    hashes, places = [], []
    for at, end in _blocks(data, marks):
        part = data[at:end]
        space = SPACE[part]
        before, after = np.append(True, space[:-1]) | marks[at:end], np.append(space[1:], True) | marks[at + 1 : end + 1]
        starts, ends = np.flatnonzero(~space & before), np.flatnonzero(~space & after) + 1
        up, down = _powers(1 << (len(part) - 1).bit_length() if len(part) > 1 else 2)
        sums = np.append(np.uint64(0), np.cumsum(BYTE[LOWER[part]] * up[: len(part)], dtype=np.uint64))
        hashes.append(mixed((sums[ends] - sums[starts]) * down[starts]))
        places.append(starts + at)
    return np.concatenate(hashes), np.searchsorted(np.concatenate(places), offsets)


def shingles_of(texts: pa.Array, width: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text: ``width`` words, or all words as one where there are fewer."""
    words, first = words_of(texts)
    n = len(words) - width + 1
    every = np.zeros(max(n, 0), np.uint64)
    for k in range(width if n > 0 else 0):
        every += words[k : k + n] * PLACE[k]
    every = mixed(every)
    out = []
    for a, b in zip(first[:-1], first[1:], strict=True):
        if b - a >= width:
            found = np.sort(every[a : b - width + 1])
            out.append(found[np.append(True, found[1:] != found[:-1])])
        elif b > a:
            out.append(mixed((words[a:b] * PLACE[: b - a]).sum(keepdims=True, dtype=np.uint64) + np.uint64(b - a)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def shared(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted distinct arrays."""
    both = np.concatenate((a, b))
    both.sort(kind="stable")
    return int((both[1:] == both[:-1]).sum())
