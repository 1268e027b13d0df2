"""Words of Arrow text columns as NumPy arrays, computed on whole UTF-8 buffers.

A word is a maximal run of ``0-9``, ``a-z`` (``A-Z`` is lower-cased first) and characters from
U+0080 on, which are exactly the UTF-8 bytes from 0x80 on; so the work is done on bytes. Words are
known by a 64-bit hash of their bytes.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SLICE_BYTES = 2 << 20  # text handled at once inside a task; a longer single text is handled alone
U = np.uint64

_FOLD = np.zeros(256, np.uint8)
_FOLD[0x30:0x3A] = np.arange(0x30, 0x3A)
_FOLD[0x61:0x7B] = np.arange(0x61, 0x7B)
_FOLD[0x41:0x5B] = np.arange(0x61, 0x7B)
_FOLD[0x80:] = np.arange(0x80, 0x100)

_BASE = U(0x9E3779B97F4A7C15)
_UNBASE = U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_powers = [np.ones(1, U), np.ones(1, U)]


def _grown(n):
    """Powers of the hash base and of its inverse modulo 2^64, up to exponent n - 1."""
    if len(_powers[0]) < n:
        size = max(n, min(2 * len(_powers[0]), SLICE_BYTES + 1))
        for k, base in enumerate((_BASE, _UNBASE)):
            p = np.full(size, base, U)
            p[0] = 1
            _powers[k] = np.cumprod(p, dtype=U)
    return _powers[0][:n], _powers[1][:n]


def mix(h):
    """A bijective scramble of 64-bit values (the finaliser of splitmix64)."""
    h = (h ^ (h >> U(30))) * U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U(27))) * U(0x94D049BB133111EB)
    return h ^ (h >> U(31))


def text_buffer(column):
    """(bytes, offsets) of a string column; a null counts as an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None and len(buffers[2]) else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batch, text="text", limit=SLICE_BYTES):
    """Cut a record batch into runs of rows whose texts hold at most ``limit`` bytes (or one row)."""
    _, off = text_buffer(batch.column(batch.schema.get_field_index(text)))
    at, n = 0, len(off) - 1
    while at < n:
        to = max(at + 1, int(np.searchsorted(off, off[at] + limit, "right")) - 1)
        yield batch.slice(at, to - at)
        at = to


@dataclass
class Words:
    """Words of several texts, one after the other; text d owns words first[d] to first[d + 1]."""

    data: np.ndarray  # the raw bytes
    offsets: np.ndarray  # of the texts in data
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray
    hash: np.ndarray

    def count(self):
        return np.diff(self.first)

    def owner(self):
        return np.repeat(np.arange(len(self.first) - 1), self.count())

    def left(self):
        """How many words the text still holds from each word on, itself included."""
        return np.repeat(self.first[1:], self.count()) - np.arange(len(self.start))

    def _run(self, at, k):
        acc = self.hash[at]
        for j in range(1, k):
            acc = acc * _BASE + self.hash[at + j]
        return acc

    def shingles(self, k):
        """(text, hash) of every run of k words; a text of fewer words, but not none, is one run."""
        n, owner = self.count(), self.owner()
        at = np.flatnonzero(self.left() >= k)
        docs, out = [owner[at]], [mix(self._run(at, k))]
        for size in range(1, k):
            short = np.flatnonzero(n == size)
            if len(short):
                docs.append(short)
                out.append(mix(self._run(self.first[short], size) + U(size)))
        return np.concatenate(docs), np.concatenate(out)


def words(column) -> Words:
    data, off = text_buffer(column)
    n = len(data)
    t = _FOLD[data]
    is_word = t != 0
    before, after = np.zeros(n, bool), np.zeros(n, bool)
    if n:
        before[1:], after[:-1] = is_word[:-1], is_word[1:]
        inner = off[(off > 0) & (off < n)]
        before[inner] = False
        after[inner - 1] = False
    start, end = np.flatnonzero(is_word & ~before), np.flatnonzero(is_word & ~after) + 1
    power, inverse = _grown(n + 1)
    sums = np.zeros(n + 1, U)
    np.cumsum(t * power[:n], dtype=U, out=sums[1:])
    h = (sums[end] - sums[start]) * inverse[start]
    return Words(data, off, start, end, np.searchsorted(start, off), mix(h + (end - start).astype(U)))


def word_hashes(texts) -> list[np.ndarray]:
    """Hashes of the words of each text of a Python list."""
    w = words(pa.array(texts, pa.large_string()))
    return [w.hash[a:b] for a, b in zip(w.first[:-1], w.first[1:], strict=True)]


def column(batch, name):
    return batch.column(batch.schema.get_field_index(name))
