"""Vectorised word work on whole Arrow batches of text, in NumPy, without a Python object per word.

A batch is cut into blocks of whole documents so that the working arrays stay near the size of a CPU cache.
Words are runs of bytes of a class; as every class used here keeps all bytes of non-ASCII characters, working
on UTF-8 bytes gives the same words as the regular expression on characters.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 1 << 18


def _table(keep) -> np.ndarray:
    """Byte -> random 64-bit value, 0 for bytes that end a word; A-Z count as a-z."""
    values = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
    values[65:91] = values[97:123]
    values[[b for b in range(256) if not keep(b)]] = 0
    return values


#: [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ after lower-casing A-Z
ALNUM = _table(lambda b: b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 or 65 <= b <= 90)
#: [^\x20\x09-\x0D]+
NONSPACE = _table(lambda b: not (b == 32 or 9 <= b <= 13))

#: Every byte but white space; with KINDS, runs of letters and digits apart from runs of signs.
TOKENS = _table(lambda b: not (b == 32 or 9 <= b <= 13))
TOKENS[65:91] = np.random.default_rng(99).integers(1, 2**63, 26, dtype=np.uint64) | np.uint64(1)
KINDS = np.array([1 if b >= 128 or chr(b).isalnum() else 2 for b in range(256)], np.uint8)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_factors: list[np.ndarray] = [np.ones(1, np.uint64)]


def factors(n: int) -> np.ndarray:
    """Odd 64-bit numbers for the first n places of a word, from a random source, so that no pattern of bytes cancels out."""
    if len(_factors[0]) < n:
        _factors[0] = np.random.default_rng(61).integers(0, 2**63, 1 << (n - 1).bit_length(), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    return _factors[0]


def portions(sizes: np.ndarray, most: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """(first, end) of runs of items of about `most` bytes in all, so that working arrays stay small however large a text is."""
    return blocks(np.concatenate([[0], np.cumsum(sizes)]), most)


def run_hashes(table: np.ndarray, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each run of bytes: the sum, over the places in the run, of the byte's value times the factor of
    the place. Two given runs collide with a probability of about 2**-63 over the factors, whatever their bytes."""
    out = np.empty(len(starts), np.uint64)
    for i, j in portions(sizes):
        at, size = starts[i:j], sizes[i:j]
        ends = np.cumsum(size)
        place = np.arange(int(ends[-1])) - np.repeat(ends - size, size)
        terms = factors(int(size.max()))[place]
        place += np.repeat(at, size)
        terms *= table[data[place]]
        out[i:j] = np.add.reduceat(terms, ends - size)
    return mix(out)


def same_bytes(a: np.ndarray, at: np.ndarray, b: np.ndarray, to: np.ndarray, sizes: np.ndarray, fold: np.ndarray | None = None) -> np.ndarray:
    """Whether a, from each of at on, has the bytes of b from each of to on; fold: a table that a is read through. No size is 0."""
    out = np.empty(len(at), bool)
    for i, j in portions(sizes):
        size = sizes[i:j]
        ends = np.cumsum(size)
        inner = np.arange(int(ends[-1])) - np.repeat(ends - size, size)
        left, right = a[inner + np.repeat(at[i:j], size)], b[inner + np.repeat(to[i:j], size)]
        out[i:j] = np.logical_and.reduceat((left if fold is None else fold[left]) == right, ends - size)
    return out


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser; equal inputs stay equal, nothing else collides."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0x7FB5D329728EA185)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x81DADEF4BC2DD44D)
    return h ^ (h >> np.uint64(33))


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and the offsets of the texts; a null text is an empty one."""
    a = column.cast(pa.large_binary())
    if a.null_count:
        a = a.fill_null(b"")
    offsets = np.frombuffer(a.buffers()[1], np.int64)[a.offset : a.offset + len(a) + 1]
    data = a.buffers()[2]
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), offsets


def blocks(offsets: np.ndarray, size: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """(first, end) of runs of whole documents of about size bytes; a longer document stands alone."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + size, "right")) - 1)
        yield i, min(j, n)
        i = j


class Words:
    """The words of documents i to j of a batch: starts, sizes in bytes, hashes, and first[k]: number of the first word of document k."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, i: int, j: int, table: np.ndarray, kinds: np.ndarray | None = None):
        base = int(offsets[i])
        self.data = data[base : int(offsets[j])]
        self.docs = offsets[i : j + 1] - base
        inside = (table != 0)[self.data]
        begins = inside.copy()
        if kinds is None:
            begins[1:] &= ~inside[:-1]
        else:  # a word ends where the kind of byte changes, too
            kind = kinds[self.data]
            begins[1:] &= ~inside[:-1] | (kind[1:] != kind[:-1])
        cuts = self.docs[:-1][self.docs[:-1] < len(self.data)]
        begins[cuts] = inside[cuts]
        self.inside, self.starts = inside, np.flatnonzero(begins)
        self.first = np.searchsorted(self.starts, self.docs)
        self.sizes = np.add.reduceat(inside, self.starts, dtype=np.int64) if len(self.starts) else np.zeros(0, np.int64)
        self.hashes = run_hashes(table, self.data, self.starts, self.sizes)

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def doc_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts())

    def shingles(self, k: int, short: bool = True) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of k consecutive words of a document, and offsets by document; short: fewer words, but not none, are one shingle."""
        h, n = self.hashes, self.counts()
        made = np.maximum(n - k + 1, ((n > 0) & short).astype(np.int64))
        at = np.concatenate([[0], np.cumsum(made)])
        doc = np.repeat(np.arange(len(n)), made)
        place = self.first[:-1][doc] + np.arange(at[-1]) - at[:-1][doc]
        out, end = np.zeros(len(place), np.uint64), self.first[1:][doc]
        for step in range(k):
            ok = place + step < end
            term = h[np.minimum(place + step, max(len(h) - 1, 0))] if len(h) else out
            out = mix(out * np.uint64(0xD6E8FEB86659FD93) + np.where(ok, term, np.uint64(0x51ED2701)))
        return out, at


def distinct(values: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values within each run given by offsets."""
    if not len(values):
        return values, np.zeros(len(at), np.int64)
    run = np.repeat(np.arange(len(at) - 1), np.diff(at))
    order = np.lexsort((values, run)) if len(at) > 2 else np.argsort(values, kind="stable")
    values, run = values[order], run[order]
    new = np.ones(len(values), bool)
    new[1:] = (values[1:] != values[:-1]) | (run[1:] != run[:-1])
    values, run = values[new], run[new]
    return values, np.searchsorted(run, np.arange(len(at)))
