"""Vectorised word hashing over Arrow string batches.

A batch of texts is one contiguous UTF-8 buffer, so words, their hashes and the
hashes of runs of words are computed with a handful of NumPy passes over that
buffer instead of a Python loop over words.  Hashes are mixed at every step, so no regular pattern of letters or
words makes two runs alike.  Words are maximal runs of bytes
other than space and ``\\x09-\\x0D``; because those separators are ASCII this is
the same as splitting on code points.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SEPARATORS = (0x20, *range(0x09, 0x0E))
#: Texts are hashed in slices of about this many bytes, which bounds the working memory.
SLICE_BYTES = 1 << 20
_IS_WORD = np.ones(256, dtype=bool)
_IS_WORD[list(SEPARATORS)] = False
# bytes that may open or close a word without being part of it: ASCII punctuation
_IS_MARK = np.zeros(256, dtype=bool)
_IS_MARK[[c for c in range(0x21, 0x7F) if not chr(c).isalnum()]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_ODD = np.uint64(0x9E3779B97F4A7C15)
_TAIL = np.array([(1 << 8 * k) - 1 for k in range(9)], dtype=np.uint64)
#: Words of more bytes than this are hashed one by one.
LONG_WORD = 64


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser, so that every bit of a hash depends on every other."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _word_hashes(packed: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """64-bit hashes of the words packed[offsets[i]:offsets[i + 1]]: eight bytes at a time, each mixed into the last.

    Long words are digested with BLAKE2b instead.
    """
    sizes = np.diff(offsets)
    h = mix(sizes.astype(np.uint64) + _ODD)
    padded = np.concatenate([packed, np.zeros(8, dtype=np.uint8)])
    lanes = np.ndarray((len(packed) + 1,), dtype="<u8", buffer=padded, strides=(1,))
    left, at, own = sizes, offsets[:-1], None  # own: the words that go on, all at first
    for _ in range(0, LONG_WORD, 8):
        value = lanes[at] & _TAIL[np.minimum(left, 8)]
        if own is None:
            h = mix(h * _ODD + value)
        else:
            h[own] = mix(h[own] * _ODD + value)
        more = np.flatnonzero(left > 8)
        if not len(more):
            break
        own = more if own is None else own[more]
        left, at = left[more] - 8, at[more] + 8
    for i in np.flatnonzero(sizes > LONG_WORD).tolist():
        h[i] = int.from_bytes(hashlib.blake2b(packed[offsets[i] : offsets[i + 1]], digest_size=8).digest(), "little")
    return h


def run_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of h[i : i + n] for every i, from hashes of runs of 1, 2, 4, .. elements.

    Every join of two runs is mixed, so runs differ in their hash whatever regular pattern they follow
    (a sum of powers would not tell some of them apart).
    """
    count = len(h) - n + 1
    if count <= 0:
        return np.zeros(0, dtype=np.uint64)
    power, size, done, out = h, 1, 0, None
    while True:
        if n & size:
            part = power[done : done + count]
            out = mix(part ^ _ODD) if out is None else mix(out * _ODD + part)
            done += size
        if 2 * size > n:
            return out
        power = mix(power[:-size] * _ODD + power[size:])
        size *= 2


class Words:
    """The words of a slice of texts: per word its byte range and hashes, per text its range of words."""

    def __init__(self, data: np.ndarray, bounds: np.ndarray, lower: bool = False, normal: bool = False):
        self.data, self.bounds = data, bounds
        word = np.zeros(len(data) + 2, dtype=np.int8)
        word[1:-1] = _IS_WORD[data]
        step = np.diff(word)
        inner = bounds[1:-1]
        inner = inner[(inner > bounds[0]) & (inner < bounds[-1])]
        starts, ends = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
        cut = np.unique(inner[(word[inner] == 1) & (word[inner + 1] == 1)]) if len(inner) else inner
        if len(cut):  # two texts that touch without white space between them
            starts, ends = np.sort(np.concatenate([starts, cut])), np.sort(np.concatenate([ends, cut]))
        self.starts, self.ends = starts, ends
        self.first = np.searchsorted(starts, bounds)  # text i has words first[i] .. first[i + 1]
        if normal and len(starts):  # without the marks around a word; words of marks alone go
            letter = np.flatnonzero(_IS_WORD[data] & ~_IS_MARK[data])
            a = np.searchsorted(letter, starts)
            b = np.searchsorted(letter, ends)
            some = b > a
            self.starts, self.ends = starts, ends = letter[a[some]], letter[b[some] - 1] + 1
            self.first = np.searchsorted(starts, bounds)
        source = _LOWER[data] if lower or normal else data
        sizes = self.ends - self.starts
        self.packed = np.zeros(len(self.starts) + 1, dtype=np.int64)  # offsets of the words without what lies between
        np.cumsum(sizes, out=self.packed[1:])
        inside = np.zeros(len(data) + 1, dtype=np.int8)
        inside[self.starts] += 1
        inside[self.ends] -= 1
        self.letters = source[np.cumsum(inside[:-1], dtype=np.int8).view(bool)]
        self.hashes = _word_hashes(self.letters, self.packed)

    def __len__(self) -> int:
        return len(self.bounds) - 1

    def runs(self, n: int) -> np.ndarray:
        """Hash of the n words from each word on (as many as the slice has; the caller drops those that cross texts)."""
        return run_hashes(self.hashes, n)

    def text_hash(self, i: int) -> np.uint64:
        """Digest of text i's whole word sequence."""
        data = self.hashes[self.first[i] : self.first[i + 1]].tobytes()
        return np.uint64(int.from_bytes(hashlib.blake2b(data, digest_size=8).digest(), "little"))

    def joined(self) -> tuple[bytes, np.ndarray]:
        """All words of the slice, each closed by one blank, and the n + 1 offsets of the words in that."""
        offsets = self.packed + np.arange(len(self.packed))
        out = np.full(int(offsets[-1]), 0x20, dtype=np.uint8)
        out[np.arange(len(self.letters)) + np.repeat(np.arange(len(self.starts)), np.diff(self.packed))] = self.letters
        return out.tobytes(), offsets


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string array and its n + 1 offsets; a null is an empty text."""
    texts = texts.cast(pa.large_string()) if not pa.types.is_large_string(texts.type) else texts
    if texts.null_count:
        texts = texts.fill_null("")
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    return (np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), offsets


def slices(texts: pa.Array, lower: bool = False, limit: int = SLICE_BYTES, normal: bool = False) -> Iterator[tuple[int, Words]]:
    """(index of its first text, Words) for consecutive slices; a longer text is a slice of its own."""
    if not len(texts):
        return
    data, offsets = buffers(texts)
    i, n = 0, len(texts)
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1)
        yield i, Words(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], lower, normal)
        i = j


def shingles(words: Words, n: int = 5) -> list[np.ndarray]:
    """Per text the sorted distinct hashes of its n-word shingles; of fewer words the whole sequence is the one shingle."""
    run, out = words.runs(n), []
    for i in range(len(words)):
        a, b = words.first[i], words.first[i + 1]
        if b - a >= n:
            x = np.sort(run[a : b - n + 1])
            out.append(x[np.concatenate([[True], x[1:] != x[:-1]])] if len(x) > 1 else x)
        else:
            out.append(np.array([words.text_hash(i)]) if b > a else run[:0])
    return out
