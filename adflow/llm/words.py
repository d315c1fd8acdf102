"""Words of a batch of texts as numpy arrays, without a Python object per word.

A word is a run of bytes of one class; class 0 (white space) separates.  Texts
are read as the UTF-8 bytes that Arrow holds, in slices of bounded size that end
between words, so memory follows the batch and not the longest text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE = 1 << 21   # bytes hashed at a time
SHINGLE = 5       # words

_ASCII_SPACE = [*range(9, 14), *range(28, 33)]
#: Words between ASCII white space.
PLAIN = np.ones(256, np.uint8)
PLAIN[_ASCII_SPACE] = 0
#: Letters, digits and other signs are words of their own.
KINDS = np.full(256, 3, np.uint8)
KINDS[_ASCII_SPACE] = 0
KINDS[[*range(65, 91), *range(97, 123), *range(128, 256)]] = 1
KINDS[48:58] = 2

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_BASE = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def byte_sizes(texts: pa.Array) -> np.ndarray:
    return pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def stretches(sizes: np.ndarray, most: int = SLICE) -> Iterator[tuple[int, int]]:
    """Stretches of rows of about ``most`` bytes together (a longer row stands alone)."""
    total = np.concatenate([[0], np.cumsum(sizes + 8)])
    start = 0
    while start < len(sizes):
        stop = max(start + 1, int(np.searchsorted(total, total[start] + most, side="right")) - 1)
        yield start, stop
        start = stop


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts (null: empty) and the ends of each."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    ends = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset:texts.offset + len(texts) + 1]
    if texts.buffers()[2] is None:
        return np.zeros(0, np.uint8), ends - ends[0]
    return np.frombuffer(texts.buffers()[2], dtype=np.uint8)[ends[0]:ends[-1]], ends - ends[0]


def word_hashes(texts: pa.Array, kinds: np.ndarray = PLAIN,
                fold: np.ndarray = LOWER) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A hash per word, the byte at which each word starts, and the words' ends per text (one more than texts)."""
    data, ends = text_bytes(texts)
    hashes, starts = [], []
    at = 0
    while at < len(data):
        upto = min(at + SLICE, len(data))
        while upto < len(data):   # on to the next white space or text
            stop = ends[np.searchsorted(ends, upto)]
            spaces = np.flatnonzero(kinds[data[upto:min(upto + 4096, stop)]] == 0)
            if len(spaces) or upto + 4096 >= stop:
                upto = upto + int(spaces[0]) if len(spaces) else int(stop)
                break
            upto += 4096
        part = data[at:upto]
        kind = kinds[part]
        new = np.empty(len(part), bool)
        new[0] = True
        np.not_equal(kind[1:], kind[:-1], out=new[1:])
        inner = ends[np.searchsorted(ends, at):np.searchsorted(ends, upto)] - at
        new[inner] = True
        first = np.flatnonzero(new)
        length = np.diff(np.append(first, len(part)))
        place = np.arange(len(part), dtype=np.int32) - np.repeat(first.astype(np.int32), length)
        power = np.full(int(length.max()), _BASE, np.uint64)
        power[0] = 1
        np.multiply.accumulate(power, out=power)
        value = (fold[part].astype(np.uint64) + np.uint64(1)) * power[place]
        word = np.add.reduceat(value, first) + length.astype(np.uint64)
        real = kind[first] > 0
        hashes.append(mix(word[real]))
        starts.append(first[real] + at)
        at = upto
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(len(ends), np.int64)
    start = np.concatenate(starts)
    return np.concatenate(hashes), start, np.searchsorted(start, ends)


def shingle_hashes(words: np.ndarray, ends: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """A hash per run of ``size`` words inside a text (a shorter text: all its words), and their ends per text."""
    counts = np.diff(ends)
    out = np.zeros(len(words), np.uint64)
    for k in range(size):
        odd = np.uint64((2 * k + 3) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF | 1)
        out[:len(words) - k] += words[k:] * odd if k else words * odd
    short = np.flatnonzero((counts > 0) & (counts < size))
    for t in short:
        own = words[ends[t]:ends[t + 1]]
        odd = np.array([(2 * k + 3) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF | 1 for k in range(len(own))], np.uint64)
        out[ends[t]] = (own * odd).sum() + np.uint64(len(own))
    keep = np.where(counts >= size, counts - size + 1, np.minimum(counts, 1))
    upto = np.zeros(len(ends), np.int64)
    np.cumsum(keep, out=upto[1:])
    place = np.arange(upto[-1]) - np.repeat(upto[:-1], keep) + np.repeat(ends[:-1], keep)
    return mix(out[place]), upto
