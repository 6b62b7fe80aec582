"""Exact byte-level BPE ids of whole batches of text.

Texts of a checked set of characters are cut into pre-tokens in NumPy (classes of bytes, then the rule for the space
before a run) and each pre-token's ids come from a direct-mapped table, found by a 64-bit hash and confirmed byte for
byte; pre-tokens that aren't in it, and any text with other characters or with a special token's string, go to the
tokenizer itself. So the ids are the tokenizer's own. Ids must be under 65,536. The table has a fixed size and is
emptied when its pools are full; a text with more distinct pre-tokens than they hold is encoded beside it.
"""

from __future__ import annotations

import base64
import os

import numpy as np
import pyarrow as pa

from .text import blocks, raw, run_hashes, same_bytes

DEFAULT_FILE = "byte_bpe_50k.json"
TABLE_BITS = 19
POOL_IDS = 3_000_000
POOL_BYTES = 6_000_000

#: Classes of bytes: 0 white space, 1 letters, 2 digits, 3 others, 9 bytes that send the text to the tokenizer.
_CLASS = np.full(256, 9, np.uint8)
_CLASS[33:127] = 3
_CLASS[[9, 10, 13, 32]] = 0
_CLASS[48:58] = 2
_CLASS[65:91] = _CLASS[97:123] = 1
#: UTF-8 of U+00C0 to U+024F, all letters but for the signs of multiplication and division.
_CLASS[0xC3:0xCA] = _CLASS[0x80:0xC0] = 1
_VALUES = np.random.default_rng(7).integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)


def _byte_signs() -> list[str]:
    """The printable sign by which a byte-level vocabulary writes each byte: its own character, or those from U+0100 on in turn."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = [b for b in range(256) if b not in shown]
    return [chr(b) if b in shown else chr(256 + hidden.index(b)) for b in range(256)]


class Encoder:
    """file: a path, or the name of a file of public_tokenizers."""

    def __init__(self, file: str = DEFAULT_FILE):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        if not os.path.isabs(file):
            import public_tokenizers

            file = public_tokenizers.path(file)
        self.tokenizer = Tokenizer.from_file(file)
        if self.tokenizer.get_vocab_size() > 65536:
            raise ValueError("ids of this tokenizer don't fit into 16 bits")
        self.special = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.piece = self._ranked(file)
        self._clear()

    def _ranked(self, file: str):
        """The same vocabulary as ranks, if that file lies beside and has the same ids: ids of one pre-token without the rest of the tokenizer."""
        ranks = os.path.splitext(file)[0] + ".tiktoken"
        try:
            import tiktoken
        except ImportError:
            return None
        if not os.path.exists(ranks):
            return None
        with open(ranks, "rb") as lines:
            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        vocabulary, sign = self.tokenizer.get_vocab(), _byte_signs()
        if any(vocabulary.get("".join(map(sign.__getitem__, t))) != rank for t, rank in table.items()):
            return None
        return tiktoken.Encoding("ranked", pat_str=r"[\s\S]+", mergeable_ranks=table, special_tokens={}).encode_ordinary

    def _pieces(self, pieces: list[bytes]) -> list[list[int]]:
        texts = [x.decode() for x in pieces]
        return [self.piece(x) for x in texts] if self.piece else self.slow(texts)

    def _clear(self) -> None:
        n = 1 << TABLE_BITS
        self.keys = np.zeros(n, np.uint64)
        self.at, self.size = np.zeros(n, np.int64), np.zeros(n, np.int32)  # of the ids in their pool
        self.key_at, self.key_size = np.zeros(n, np.int64), np.full(n, -1, np.int32)  # of the bytes in theirs
        self.pool, self.full = np.zeros(POOL_IDS, np.uint16), 0
        self.key_pool, self.key_full = np.zeros(POOL_BYTES, np.uint8), 0

    def slow(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _found(self, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, hashes: np.ndarray, slot: np.ndarray) -> np.ndarray:
        """Which pre-tokens the table has: same hash, same length, same bytes."""
        hit = (self.keys[slot] == hashes) & (self.key_size[slot] == sizes)
        some = np.flatnonzero(hit)
        if len(some):
            hit[some] = same_bytes(data, starts[some], self.key_pool, self.key_at[slot[some]], sizes[some])
        return hit

    def _add(self, pieces: list[bytes], hashes: np.ndarray, ids: np.ndarray, size: np.ndarray) -> None:
        """Puts new pre-tokens into the table, unless they are more than its pools hold."""
        blob, key_size = np.frombuffer(b"".join(pieces), np.uint8), np.array([len(p) for p in pieces], np.int64)
        if len(ids) > len(self.pool) or len(blob) > len(self.key_pool):
            return
        if self.full + len(ids) > len(self.pool) or self.key_full + len(blob) > len(self.key_pool):
            self._clear()
        slot = (hashes & np.uint64((1 << TABLE_BITS) - 1)).astype(np.int64)
        _, last = np.unique(slot[::-1], return_index=True)  # one pre-token a slot
        own = len(slot) - 1 - last
        self.pool[self.full : self.full + len(ids)], self.key_pool[self.key_full : self.key_full + len(blob)] = ids, blob
        self.keys[slot[own]] = hashes[own]
        self.at[slot[own]], self.size[slot[own]] = self.full + (np.cumsum(size) - size)[own], size[own]
        self.key_at[slot[own]], self.key_size[slot[own]] = self.key_full + (np.cumsum(key_size) - key_size)[own], key_size[own]
        self.full += len(ids)
        self.key_full += len(blob)

    def _block(self, data: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of checked texts, one after another, and their offsets."""
        kind = _CLASS[data]
        begin = np.ones(len(data), bool)
        begin[1:] = kind[1:] != kind[:-1]
        heads = docs[:-1][docs[:-1] < docs[1:]]
        begin[heads] = True
        head = np.zeros(len(data), bool)
        head[heads] = True
        # the last white space before a run is a token, or goes with the run if it is a space
        after = np.flatnonzero(begin & (kind != 0) & ~head)
        after = after[kind[after - 1] == 0]
        begin[after - 1] = True
        begin[after[data[after - 1] == 32]] = False
        # contractions
        tick = np.flatnonzero((data == 39) & begin)
        if len(tick):
            end = docs[np.searchsorted(docs, tick, "right")]
            a = np.where(tick + 1 < end, data[np.minimum(tick + 1, len(data) - 1)], 0)
            b = np.where(tick + 2 < end, data[np.minimum(tick + 2, len(data) - 1)], 0)
            two = np.isin(a, np.frombuffer(b"stmd", np.uint8))
            three = ((a == 114) | (a == 118)) & (b == 101) | (a == 108) & (b == 108)
            for some, width in ((two, 2), (three, 3)):
                begin[tick[some] + 1] = False
                then = tick[some] + width
                then = then[then < end[some]]
                begin[then[kind[then] == 1]] = True
        starts = np.flatnonzero(begin)
        ends = np.append(starts[1:], len(data))
        sizes = ends - starts
        hashes = run_hashes(_VALUES, data, starts, sizes)
        slot = (hashes & np.uint64((1 << TABLE_BITS) - 1)).astype(np.int64)
        hit = self._found(data, starts, sizes, hashes, slot)
        size = np.where(hit, self.size[slot], 0).astype(np.int64)
        miss = np.flatnonzero(~hit)
        fresh, at_miss = np.zeros(0, np.uint16), np.zeros(0, np.int64)
        if len(miss):
            blob = data.tobytes()
            which: dict[bytes, int] = {}
            number = np.array([which.setdefault(blob[s:e], len(which)) for s, e in zip(starts[miss].tolist(), ends[miss].tolist(), strict=True)])
            pieces = list(which)
            made = self._pieces(pieces)
            n_new = np.array([len(x) for x in made], np.int64)
            fresh = np.fromiter((i for x in made for i in x), np.uint16, int(n_new.sum()))
            size[miss], at_miss = n_new[number], (np.cumsum(n_new) - n_new)[number]
        stop = np.cumsum(size)
        upto = np.concatenate([[0], stop])
        ids = np.empty(int(upto[-1]), np.uint16)
        for some, pool, at in ((np.flatnonzero(hit), self.pool, self.at[slot[hit]]), (miss, fresh, at_miss)):
            n = size[some]
            inner = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
            ids[inner + np.repeat(upto[some], n)] = pool[inner + np.repeat(at, n)]
        if len(miss):
            first = np.zeros(len(pieces), np.int64)
            first[number] = miss
            self._add(pieces, hashes[first], fresh, n_new)
        return ids, upto[np.searchsorted(starts, docs)]

    def encode_column(self, column: pa.Array, block_bytes: int = 1 << 20) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after another, as unsigned 16-bit numbers, and their offsets. A null text has none."""
        data, offsets = raw(column)
        out, sizes = [], []
        for i, j in blocks(offsets, block_bytes):
            part, docs = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
            if not len(part):
                sizes.append(np.zeros(j - i, np.int64))
                continue
            odd = _CLASS[part] == 9
            sign = part[1:]
            odd[:-1] |= (part[:-1] == 0xC3) & ((sign == 0x97) | (sign == 0xB7))
            blob = part.tobytes()
            for s in self.special:
                k = blob.find(s)
                while k >= 0:
                    odd[k] = True
                    k = blob.find(s, k + 1)
            bad = np.unique(np.searchsorted(docs, np.flatnonzero(odd), "right") - 1)
            if not len(bad):
                ids, at = self._block(part, docs)
                out.append(ids)
                sizes.append(np.diff(at))
                continue
            # runs of checked texts between the others
            size, edges = np.zeros(j - i, np.int64), [-1, *bad.tolist(), j - i]
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                if b > a + 1 and docs[b] > docs[a + 1]:
                    ids, at = self._block(part[docs[a + 1] : docs[b]], docs[a + 1 : b + 1] - docs[a + 1])
                    out.append(ids)
                    size[a + 1 : b] = np.diff(at)
                if b < j - i:
                    ids = np.array(self.slow([blob[docs[b] : docs[b + 1]].decode()])[0], np.uint16)
                    out.append(ids)
                    size[b] = len(ids)
            sizes.append(size)
        sizes = np.concatenate(sizes) if sizes else np.zeros(0, np.int64)
        return np.concatenate(out) if out else np.zeros(0, np.uint16), np.concatenate([[0], np.cumsum(sizes)])


_encoders: dict[str, Encoder] = {}


def encoder(file: str = DEFAULT_FILE) -> Encoder:
    """One encoder for each file in a worker process."""
    if file not in _encoders:
        _encoders[file] = Encoder(file)
    return _encoders[file]
