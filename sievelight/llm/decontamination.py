"""2. Benchmark decontamination with training suffix arrays.

Each shard (a run of whole documents) gets a suffix array over its words: suffixes of a document, sorted word by word.
Every suffix of every test item is binary-searched in every shard; the range of suffixes that share its first `window`
words gives all locations. Those that can't be extended to the left are extended to the right as far as the words agree,
so longest matches have no cap; a match that holds no window isn't one.

Words are numbered by the test vocabulary (0: not in it). A training suffix that begins with a word no test item has
can't match any test suffix, so it is left out of the sort; within a shard the array is otherwise complete. Word
numbers are found by 64-bit hashes and confirmed on the bytes of each word.

The test items are broadcast in blocks of at most `block_bytes` of text each; each block is one pass over the training
documents. The driver reads one block at a time.

Defined cases: a null or empty text, or one without words, has none and is clean; an item with fewer words than the
window, but some, is one window; an item without words never occurs; rows with equal item ids count as one item; a
null item id is reported as "null"; equal document rows are judged each; no items, nothing is hit.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import join_unique
from .text import ALNUM, LOWER, Words, blocks, raw, same_bytes

#: Fixed value: a word, after lower-casing A-Z.
WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
_LOWER = {c: c + 32 for c in range(65, 91)}
#: Columns that find() adds; columns of the documents with these names are left out.
RESULTS = ("n_words", "spans", "items", "longest_match", "longest_at", "n_hit")
SHARD_BYTES = 4 << 20
BLOCK_BYTES = 16 << 20


def words_of(text: str | None) -> list[str]:
    return WORD.findall((text or "").translate(_LOWER))


class TestSet:
    """One block of test items: vocabulary, all words of all items as numbers with 0 after each item, and its suffixes."""

    __test__ = False

    def __init__(self, items: list[tuple[str, str]], window: int):
        self.window, self.ids = window, sorted({i for i, _ in items})
        number = {i: k for k, i in enumerate(self.ids)}
        words = [words_of(t) for _, t in items]
        vocabulary = sorted({w for ws in words for w in ws})
        data, offsets = raw(pa.array(vocabulary, pa.string()))
        hashed = Words(data, offsets, 0, len(vocabulary), ALNUM).hashes
        order = np.argsort(hashed, kind="stable")
        self.hashes, code = hashed[order], {vocabulary[k]: n + 1 for n, k in enumerate(order)}
        encoded = [vocabulary[k].encode() for k in order]
        self.bytes = np.frombuffer(b"".join(encoded), np.uint8)
        self.sizes = np.array([len(w) for w in encoded], np.int64)
        self.at = np.cumsum(self.sizes) - self.sizes
        size = np.array([len(ws) for ws in words], np.int64)
        self.text = np.zeros(int(size.sum()) + len(words) + window, np.int32)
        self.text[: int(size.sum()) + len(words)] = [c for ws in words for c in [*(code[w] for w in ws), 0]]
        self.place = np.flatnonzero(self.text)  # where each suffix begins
        item = np.repeat(np.arange(len(words)), size)
        self.item = np.array([number[i] for i, _ in items], np.int64)[item] if len(item) else np.zeros(0, np.int64)
        self.need = np.minimum(window, size)[item]
        self.left = (np.cumsum(size + 1) - 1)[item] - self.place if len(item) else np.zeros(0, np.int64)
        self.suffix = self.text[self.place[:, None] + np.arange(window)]
        self.suffix *= np.cumprod(self.suffix != 0, 1)  # nothing of the next item

    def codes(self, w: Words) -> np.ndarray:
        """The number of each word, 0 if no item has it; words are compared byte for byte."""
        out, last = np.zeros(len(w.hashes), np.int32), len(self.hashes) - 1
        if last < 0:
            return out
        may = np.flatnonzero(_prefixes(self.hashes)[(w.hashes >> np.uint64(48)).astype(np.int64)])
        k = np.searchsorted(self.hashes, w.hashes[may])
        while len(may):  # vocabulary words of one hash stand next to each other
            same = k <= last
            same[same] = self.hashes[k[same]] == w.hashes[may[same]]
            may, k = may[same], k[same]
            equal = self.sizes[k] == w.sizes[may]
            equal[equal] = same_bytes(w.data, w.starts[may[equal]], self.bytes, self.at[k[equal]], w.sizes[may[equal]], LOWER)
            out[may[equal]] = k[equal] + 1
            may, k = may[~equal], k[~equal] + 1
        return out


def _prefixes(hashes: np.ndarray) -> np.ndarray:
    """Which first 16 bits occur."""
    table = np.zeros(1 << 16, bool)
    table[(hashes >> np.uint64(48)).astype(np.int64)] = True
    return table


def _compare(rows: np.ndarray, keys: np.ndarray, length: np.ndarray) -> np.ndarray:
    """-1, 0, 1 for each pair of rows by their first `length` numbers."""
    differs = (rows != keys) & (np.arange(rows.shape[1]) < length[:, None])
    at = differs.argmax(1)
    k = np.arange(len(rows))
    return np.where(differs[k, at], np.sign(rows[k, at].astype(np.int64) - keys[k, at]), 0)


class Shard:
    """The suffix array of one run of documents. text: word numbers, with 0 after each document."""

    def __init__(self, text: np.ndarray, depth: int):
        self.depth = depth
        self.text = np.concatenate([text, np.zeros(depth, np.int32)])
        at = np.flatnonzero(text)
        # sort by three words at a time; after each step only the suffixes that still tie are sorted further
        order = at
        if len(at):
            tie, rank = at, np.zeros(len(at), np.int64)
            for step in range(0, depth, 3):
                key = np.zeros(len(tie), np.uint64)
                for k in range(3):
                    word = self.text[tie + step + k] if step + k < depth else np.zeros(len(tie), np.int32)
                    key = (key << np.uint64(21)) | word.astype(np.uint64)
                sort = np.lexsort((key, rank)) if step else np.argsort(key, kind="stable")
                tie, rank, key = tie[sort], rank[sort], key[sort]
                new = np.ones(len(tie), bool)
                new[1:] = (key[1:] != key[:-1]) | (rank[1:] != rank[:-1])
                if step == 0:
                    order, slots = tie.copy(), np.arange(len(tie))
                else:
                    order[slots] = tie
                group = np.cumsum(new) - 1
                shared = np.bincount(group)[group] > 1  # only ties are sorted further
                tie, rank, slots = tie[shared], group[shared], slots[shared]
                if not len(tie):
                    break
        self.order = order

    def row(self, k: np.ndarray) -> np.ndarray:
        return self.text[self.order[k][:, None] + np.arange(self.depth)]

    def search(self, keys: np.ndarray, length: np.ndarray, after: bool) -> np.ndarray:
        """For each key the number of suffixes before it (after: or equal to it over its length)."""
        low, high = np.zeros(len(keys), np.int64), np.full(len(keys), len(self.order), np.int64)
        while len(run := np.flatnonzero(low < high)):
            mid = (low[run] + high[run]) // 2
            side = _compare(self.row(mid), keys[run], length[run])
            right = (side <= 0) if after else (side < 0)
            low[run[right]] = mid[right] + 1
            high[run[~right]] = mid[~right]
        return low


def _extend(a: np.ndarray, at: np.ndarray, b: np.ndarray, to: np.ndarray, begun: np.ndarray, step: int = 32) -> np.ndarray:
    """Lengths of the longest matches of a from `at` with b from `to`, of which `begun` words are known; 0 ends a text."""
    size, run = begun.copy(), np.arange(len(at))
    reach = np.arange(step)
    while len(run):
        x, y = (at[run] + size[run])[:, None] + reach, (to[run] + size[run])[:, None] + reach
        x, y = a[np.minimum(x, len(a) - 1)], b[np.minimum(y, len(b) - 1)]
        more = np.cumprod((x == y) & (x != 0), 1).sum(1)
        size[run] += more
        run = run[more == step]
    return size


def _search_shard(test: TestSet, codes: np.ndarray, doc: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hits (document, word in it, suffix of the test set), and each document's longest match and where it starts."""
    n = len(first) - 1
    text = np.zeros(len(codes) + n, np.int32)
    place = np.arange(len(codes)) + doc
    text[place] = codes
    shard = Shard(text, test.window)
    longest, where = np.zeros(n, np.int64), np.zeros(n, np.int64)
    nothing = np.zeros(0, np.int64)
    if not len(shard.order) or not len(test.suffix):
        return nothing, nothing, nothing, longest, where
    starts = first[:-1] + np.arange(n)

    def note(at: np.ndarray, size: np.ndarray) -> None:
        """The longest match of each document; of equal ones the first."""
        d = np.searchsorted(starts, at, "right") - 1
        order = np.lexsort((at, -size, d))
        d, at, size = d[order], at[order], size[order]
        top = np.flatnonzero(np.append(True, d[1:] != d[:-1])) if len(d) else nothing
        top = top[size[top] > longest[d[top]]]
        longest[d[top]], where[d[top]] = size[top], (at - starts[d])[top]

    search = np.flatnonzero(test.left >= test.need)
    low = shard.search(test.suffix[search], test.need[search], False)
    high = shard.search(test.suffix[search], test.need[search], True)
    size = high - low
    hit = np.repeat(search, size)
    at = shard.order[np.repeat(low, size) + np.arange(len(hit)) - np.repeat(np.cumsum(size) - size, size)]
    # every match at least as long as a window begins with a hit that can't be extended to the left
    before = np.where(at > 0, shard.text[at - 1], 0)
    own = np.where(test.place[hit] > 0, test.text[test.place[hit] - 1], 0)
    left = np.flatnonzero((before != own) | (before == 0))
    note(at[left], _extend(shard.text, at[left], test.text, test.place[hit[left]], test.need[hit[left]]))
    d = np.searchsorted(starts, at, "right") - 1
    return d, at - starts[d], hit, longest, where


def _merged(d: np.ndarray, a: np.ndarray, b: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Flat pairs of the union of [a, b) by document, and offsets by document."""
    order = np.lexsort((a, d))
    d, a, b = d[order], a[order], b[order]
    if not len(d):
        return np.zeros(0, np.int64), np.zeros(n + 1, np.int64)
    wide = int(b.max()) + 1
    reach = np.maximum.accumulate(b + d * wide) - d * wide  # the furthest end so far; what an earlier document gives is below 0
    new = np.append(True, (d[1:] != d[:-1]) | (a[1:] > reach[:-1]))
    head = np.flatnonzero(new)
    tail = np.append(head[1:], len(d)) - 1
    return np.stack([a[head], reach[tail]], 1).ravel(), 2 * np.searchsorted(d[head], np.arange(n + 1))


def _pass(docs: DataFrame, test: TestSet, id_col: str, text_col: str) -> DataFrame:
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(test)
    names = [c for c in docs.columns if c != text_col and c not in RESULTS]
    fields = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        test = shared.value
        ids = pa.array(test.ids, pa.string())
        for batch in batches:
            data, offsets = raw(batch.column(batch.schema.get_field_index(text_col)))
            made: list[tuple[np.ndarray, ...]] = []
            for i, j in blocks(offsets, SHARD_BYTES):
                w = Words(data, offsets, i, j, ALNUM)
                d, at, hit, longest, where = _search_shard(test, test.codes(w), w.doc_of(), w.first)
                spans, spans_at = _merged(d, at, at + test.need[hit], j - i)
                found = np.unique(np.stack([d, test.item[hit]], 1), axis=0)  # items are numbered in the order of their ids
                made.append((w.counts(), longest, where, spans, np.diff(spans_at), found[:, 1], np.bincount(found[:, 0], minlength=j - i)))
            n_words, longest, where, spans, n_spans, items, n_items = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (list(zip(*made, strict=True)) or [()] * 7))
            cut = lambda n: pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32))
            long = lambda x: pa.array(x.astype(np.int64))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(batch.schema.get_field_index(c)) for c in names), long(n_words), pa.ListArray.from_arrays(cut(n_spans), long(spans)), pa.ListArray.from_arrays(cut(n_items), ids.take(long(items))), long(longest), long(where)],
                names=[*names, "n_words", "spans", "items", "longest_match", "longest_at"],
            )

    return docs.mapInArrow(run, f"{fields}, n_words long, spans array<bigint>, items array<string>, longest_match long, longest_at long")


def _blocks_of(items: DataFrame, block_bytes: int) -> int:
    total = items.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    return max(1, -(-total // block_bytes))


def find(docs: DataFrame, benchmark: DataFrame, *, window: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The documents' columns without the text, and n_words, spans (flat pairs of word positions, disjoint), n_hit, items (sorted), longest_match (in words; 0 without a hit) and longest_at, where the first of the longest begins."""
    items = benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("null")).alias("i"), F.coalesce(item_text_col, F.lit("")).alias("t"))
    n = _blocks_of(items, block_bytes)
    if n == 1:
        found = _pass(docs, TestSet([(r.i, r.t) for r in items.collect()], window), id_col, text_col)
    else:  # a larger test set: one pass for each block, joined by document row
        keyed = docs.withColumn("_row", F.sha2(F.concat_ws("\x00", F.col(id_col).cast("string"), F.sha2(F.coalesce(text_col, F.lit("")), 256)), 256))
        parts = []
        for k in range(n):
            block = items.where(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == k).collect()
            parts.append(_pass(keyed.select("_row", text_col), TestSet([(r.i, r.t) for r in block], window), "_row", text_col).where("longest_match > 0"))
        hits = parts[0]
        for p in parts[1:]:
            hits = hits.unionByName(p)
        pairs = hits.groupBy("_row").agg(  # a row for each block at most, equal rows fall together
            F.array_sort(F.flatten(F.collect_set(F.expr("transform(sequence(0, int(size(spans) / 2)), k -> struct(get(spans, 2 * k) as a, get(spans, 2 * k + 1) as b))")))).alias("s"),
            F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"),
            F.max(F.struct("longest_match", "longest_at")).alias("m"),
        )
        merge = """aggregate(filter(s, x -> x.a is not null), cast(array() as array<bigint>), (m, x) -> if(size(m) > 0 and x.a <= element_at(m, -1),
            concat(slice(m, 1, size(m) - 1), array(greatest(x.b, element_at(m, -1)))), concat(m, array(x.a, x.b))))"""
        pairs = pairs.select("_row", F.expr(merge).alias("spans"), "items", "m.longest_match", "m.longest_at")
        words = _pass(keyed, TestSet([], window), id_col, text_col).drop("spans", "items", "longest_match", "longest_at")
        none = {"spans": F.array().cast("array<bigint>"), "items": F.array().cast("array<string>"), "longest_match": F.lit(0), "longest_at": F.lit(0)}
        pairs = pairs.join(words.groupBy("_row").agg(F.count("*").alias("rows")), "_row")
        found = join_unique(words, pairs, "_row", "rows", "left").drop("_row").withColumns({k: F.coalesce(F.col(k), v) for k, v in none.items()})
    hit = F.aggregate("spans", F.struct(F.lit(0).cast("long").alias("n"), F.lit(-1).cast("long").alias("s")), lambda a, x: F.struct((a.n + x * a.s).alias("n"), (-a.s).alias("s")))
    return found.withColumn("n_hit", F.when(F.size("spans") > 0, hit.n).otherwise(F.lit(0)).cast("long"))


def clean(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The documents that contain no window of any item, with their own columns."""
    id_col, text_col = options.get("id_col", "doc_id"), options.get("text_col", "text")
    found = find(docs.select(text_col, *(F.col(c).alias(f"_c{k}") for k, c in enumerate(docs.columns))), benchmark, **{**options, "id_col": "_c" + str(docs.columns.index(id_col))})
    return found.where("n_hit = 0").select(*(F.col(f"_c{k}").alias(c) for k, c in enumerate(docs.columns)))
