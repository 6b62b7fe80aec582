"""8. MinHash near-dedup with odd sketches.

A document's set holds its distinct shingles of k words. Documents with equal sets are one from here on. Each set gets
`BANDS * ROWS` MinHash values; every band of ROWS values is a bucket key, and all values together are folded into a parity
bitmap (odd sketch), whose XOR population count estimates how much two sets differ. Candidates are confirmed on the full
sets; components of the confirmed links are the classes.

No bucket is expanded into its pairs. First each member of a bucket is a candidate with two members of it: one chosen by a
hash, a different one in each band, and the most central one, whose buckets have the most members in all; that is
the common origin, where copies differ each in their own way. Of each document the best by sketch and the best central one
are confirmed, which joins most of any group, however large. Then, in each bucket whose members still lie in several components, the members outside its largest
component are compared by sketch with the members of other components; what passes is confirmed. No pair that shares a
bucket and isn't joined yet goes untested, but for those whose sketches differ by more than MOST_BITS, over four standard
deviations more than what the threshold gives, and those whose odd sketches of the whole sets differ in more bits than
the sets of a link can differ in elements: each differing element flips one bit, so that bound loses nothing.

At similarity 0.8 a pair shares no bucket with probability (1 - 0.8**5)**40, 1.3e-7.

Defined cases: a null or empty text, or one without words, has the empty set and is linked with nothing; with fewer than k
words the whole sequence is one shingle; equal rows, and rows of one id, belong together; empty tables give empty results;
other columns are ignored, or kept by `deduplicate`, whatever their names. Ids are numbers; a null id is linked with nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .graph import components, matching
from .tables import join_unique, store
from .text import NONSPACE, Words, blocks, distinct, mix, raw

BANDS, ROWS = 40, 5
SKETCH_BITS = 512
#: Members of a bucket on one side of a comparison.
SLICE = 1024
MOST_BITS = 112
_R = np.random.default_rng(1109)
_MULT = _R.integers(1, 2**32, BANDS * ROWS, dtype=np.uint64).astype(np.uint32) | np.uint32(1)
_ADD = _R.integers(0, 2**32, BANDS * ROWS, dtype=np.uint64).astype(np.uint32)
WHOLE_BITS = 1024
_SKETCH = [f"s{k}" for k in range(SKETCH_BITS // 64)]
_WHOLE = [f"w{k}" for k in range(WHOLE_BITS // 64)]
_ALL = _SKETCH + _WHOLE


def minhashes(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """[documents, BANDS * ROWS] minima; every document must have a value."""
    low = (values ^ (values >> np.uint64(32))).astype(np.uint32)
    out = np.empty((len(at) - 1, BANDS * ROWS), np.uint32)
    tmp = np.empty_like(low)
    for k in range(BANDS * ROWS):
        np.multiply(low, _MULT[k], out=tmp)
        tmp += _ADD[k]
        tmp ^= tmp >> np.uint32(15)
        out[:, k] = np.minimum.reduceat(tmp, at[:-1])
    return out


def band_keys(minima: np.ndarray) -> np.ndarray:
    h = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), (len(minima), BANDS)).copy()
    for r in range(ROWS):
        h = mix(h * np.uint64(0xD6E8FEB86659FD93) + minima[:, r::ROWS])
    return h.view(np.int64)


def _parity(place: np.ndarray, at: np.ndarray, bits: int) -> np.ndarray:
    """Parity bitmaps [documents, bits / 64] of the places of each run."""
    out = np.zeros((len(at) - 1, bits // 64), np.int64)
    for i in range(0, len(out), 512):
        edge = at[i : i + 513]
        doc = np.repeat(np.arange(len(edge) - 1), np.diff(edge))
        count = np.bincount(place[edge[0] : edge[-1]] + doc * bits, minlength=(len(edge) - 1) * bits)
        out[i : i + 512] = np.packbits((count & 1).astype(np.uint8).reshape(-1, bits), axis=1).view(np.int64)
    return out


def odd_sketches(minima: np.ndarray) -> np.ndarray:
    """Odd sketches of the MinHash values of each document."""
    n, k = minima.shape
    place = mix(minima.astype(np.uint64) + (np.arange(k, dtype=np.uint64) << np.uint64(32))) % np.uint64(SKETCH_BITS)
    return _parity(place.astype(np.int64).ravel(), np.arange(n + 1) * k, SKETCH_BITS)


def whole_sketches(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Odd sketches of the sets themselves."""
    return _parity((mix(values + np.uint64(31)) % np.uint64(WHOLE_BITS)).astype(np.int64), at, WHOLE_BITS)


def _sets(data: np.ndarray, offsets: np.ndarray, i: int, j: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    return distinct(*Words(data, offsets, i, j, NONSPACE).shingles(k))


def signatures(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", k: int = 2) -> DataFrame:
    """Per row: id, n (set size), f0 and f1 (fingerprint of the set), bands, and the sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = raw(batch.column(1))
            ids = batch.column(0)
            for i, j in blocks(offsets):
                values, at = _sets(data, offsets, i, j, k)
                n = np.diff(at)
                full = np.flatnonzero(n)
                f = np.zeros((j - i, 2), np.uint64)
                bands, sketch = np.zeros((j - i, BANDS), np.int64), np.zeros((j - i, len(_ALL)), np.int64)
                if len(full):
                    starts = np.append(at[:-1][full], at[-1])
                    f[full, 0] = np.add.reduceat(mix(values), starts[:-1])
                    f[full, 1] = np.bitwise_xor.reduceat(mix(values + np.uint64(77)), starts[:-1])
                    low = minhashes(values, starts)
                    bands[full], sketch[full] = band_keys(low), np.hstack([odd_sketches(low), whole_sketches(values, starts)])
                where = pa.array(np.arange(0, (j - i + 1) * BANDS, BANDS, dtype=np.int32))
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(i, j - i), pa.array(n), pa.array(f[:, 0].view(np.int64)), pa.array(f[:, 1].view(np.int64)), pa.ListArray.from_arrays(where, pa.array(bands.ravel())), *(pa.array(np.ascontiguousarray(sketch[:, c])) for c in range(len(_ALL)))],
                    names=["id", "n", "f0", "f1", "bands", *_ALL],
                )

    fields = ", ".join(["id long, n long, f0 long, f1 long, bands array<bigint>", *(f"{s} long" for s in _ALL)])
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("t")).mapInArrow(run, fields)


def full_sets(docs: DataFrame, keys: DataFrame, *, id_col: str, text_col: str, k: int) -> DataFrame:
    """id and all hashed shingles, sorted, of the documents in keys (id); one row an id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = raw(batch.column(1))
            for i, j in blocks(offsets):
                values, at = _sets(data, offsets, i, j, k)
                column = pa.Array.from_buffers(pa.large_binary(), j - i, [None, pa.py_buffer((at * 8).astype(np.int64)), pa.py_buffer(values)]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), column], names=["id", "hashes"])

    found = matching(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("t")), keys, "id")
    return found.mapInArrow(run, "id long, hashes binary").dropDuplicates(["id"])


def _differ(a: str, b: str, words: list[str] = _SKETCH) -> Column:
    return sum((F.bit_count(F.col(f"{a}{s}").bitwiseXOR(F.col(f"{b}{s}"))) for s in words), F.lit(0))


def _confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of pairs (a, b) with 100 * intersection >= percent * union."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = np.zeros(batch.num_rows, bool)
            for k, (x, y) in enumerate(zip(batch.column(2), batch.column(3), strict=True)):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                ok[k] = 100 * both >= percent * (len(x) + len(y) - both)
            yield pa.RecordBatch.from_arrays(batch.columns[:2], names=["a", "b"]).filter(pa.array(ok))

    joined = pairs.join(sets.select(F.col("id").alias("a"), F.col("hashes").alias("x")), "a").join(sets.select(F.col("id").alias("b"), F.col("hashes").alias("y")), "b")
    return joined.select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def classes(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", k: int = 2, percent: int = 80, most_bits: int = MOST_BITS) -> DataFrame:
    """Per row of docs: id, n_shingles, component_id (smallest id reachable), kept."""
    rows = store(signatures(docs, id_col=id_col, text_col=text_col, k=k), "signatures")
    full = rows.where("n > 0")
    sets = store(full.groupBy("n", "f0", "f1").agg(F.min("id").alias("rep"), F.first("bands").alias("bands"), *(F.first(s).alias(s) for s in _ALL)).where("rep is not null"), "sets", few=True)

    member = sets.select(F.explode("bands").alias("key"), "rep")
    heads = member.groupBy("key").agg(F.count("*").alias("size"), F.min(F.struct(F.xxhash64("rep", "key"), "rep")).alias("h")).where("size > 1")
    buckets = store(member.join(heads.select("key", "size", F.col("h.rep").alias("head")), "key"), "buckets", few=True)
    crowd = buckets.groupBy("rep").agg(F.sum("size").alias("crowd"))
    central = buckets.join(crowd, "rep").groupBy("key").agg(F.max(F.struct("crowd", F.xxhash64("rep"), "rep")).alias("m"))
    central = buckets.select("key", "rep").join(central.select("key", F.col("m.rep").alias("head")), "key")

    sketch = lambda side: sets.select(F.col("rep").alias(side), F.col("n").alias(f"{side}n"), *(F.col(s).alias(f"{side}{s}") for s in _ALL))
    similar = (F.least("an", "bn") * 100 >= F.greatest("an", "bn") * percent) & (_differ("a", "b") <= most_bits)
    similar &= _differ("a", "b", _WHOLE) * (100 + percent) <= (F.col("an") + F.col("bn")) * (100 - percent)
    pairs = buckets.select("key", "rep", "head").withColumn("mid", F.lit(0)).unionByName(central.withColumn("mid", F.lit(1))).where("rep <> head")
    pairs = pairs.groupBy(F.least("rep", "head").alias("a"), F.greatest("rep", "head").alias("b"), "rep").agg(F.max("mid").alias("mid"))
    pairs = pairs.join(sketch("a"), "a").join(sketch("b"), "b").where(similar).select("a", "b", "rep", "mid", _differ("a", "b").alias("d"))
    best = pairs.groupBy("rep").agg(
        F.min(F.struct("d", "a", "b")).alias("p"), F.min(F.struct(-F.col("mid"), "d", "a", "b")).alias("q"), F.min(F.struct("d", F.xxhash64("a", "b"), "a", "b")).alias("r")
    )
    chosen = F.array(*(F.struct(f"{x}.a", f"{x}.b") for x in "pqr"))
    first = store(best.select(F.explode(chosen).alias("p")).select("p.*").distinct(), "first", few=True)

    keys = buckets.select(F.col("rep").alias("id")).distinct()
    whole = store(full_sets(docs, keys, id_col=id_col, text_col=text_col, k=k), "full_sets", few=True)
    links = store(_confirm(first, whole, percent), "links", few=True)
    joined = components(links)

    # what is left between components within a bucket
    placed = buckets.select("key", "rep").join(joined.select(F.col("v").alias("rep"), "c"), "rep", "left").withColumn("c", F.coalesce("c", "rep"))
    sizes = placed.groupBy("key", "c").agg(F.count("*").alias("size"))
    mixed = sizes.groupBy("key").agg(F.count("*").alias("parts"), F.sum("size").alias("all"), F.max(F.struct("size", "c")).alias("m")).where("parts > 1")
    mixed = mixed.select("key", F.col("m.c").alias("main"), F.ceil(F.sqrt(F.col("all") / SLICE)).cast("int").alias("slices"))
    open_ = placed.join(mixed, "key").join(sets.select("rep", "n", *_ALL), "rep")
    open_ = store(open_, "open", few=True)
    # a large bucket is dealt over slices of either side, so that no task compares more than about SLICE * SLICE pairs of a key
    own, every = F.expr("int(pmod(xxhash64(rep), slices))"), F.explode(F.expr("sequence(0, slices - 1)"))
    side = lambda x, mine, theirs: open_.withColumn(mine, own).withColumn(theirs, every).select("key", "i", "j", "main", *(F.col(c).alias(f"{x}{c}") for c in ("rep", "c", "n", *_ALL)))
    minor, other = side("a", "i", "j").where("ac <> main"), side("b", "j", "i").drop("main")
    across = minor.join(other, (minor["key"] == other["key"]) & (minor["i"] == other["i"]) & (minor["j"] == other["j"]) & (F.col("ac") != F.col("bc")) & ((F.col("bc") == F.col("main")) | (F.col("arep") < F.col("brep"))) & similar)
    across = across.select(F.least("arep", "brep").alias("a"), F.greatest("arep", "brep").alias("b")).distinct().join(first, ["a", "b"], "left_anti")
    more = store(_confirm(across, whole, percent), "more_links", few=True)
    if more.limit(1).count():
        joined = components(links.unionByName(more), "components2")

    of_set = sets.select("n", "f0", "f1", "rep").join(joined.select(F.col("v").alias("rep"), "c"), "rep", "left").select("n", "f0", "f1", F.coalesce("c", "rep").alias("c"))
    print_ = F.concat_ws(":", "n", "f0", "f1")
    copies = full.groupBy(print_.alias("set")).agg(F.count("*").alias("rows"))
    of_set = of_set.select(print_.alias("set"), "c").join(copies, "set")
    found = join_unique(full.select("id", "n", print_.alias("set")), of_set, "set", "rows", "left").select("id", "n", "c")
    found = found.unionByName(rows.where("n = 0").select("id", "n", F.lit(None).cast("long").alias("c")))  # empty sets stay out of the join
    return found.select(F.col("id"), F.col("n").alias("n_shingles"), F.coalesce("c", "id").alias("component_id"), (F.col("id") == F.coalesce("c", "id")).alias("kept"))


def deduplicate(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 80) -> DataFrame:
    """docs without the documents that aren't the first of their class.

    Ids should be unique: all rows with a kept id stay, and if rows with one id differ in text, all are confirmed with the
    shingles of one of them (see full_sets), so links can be lost or made wrongly.
    """
    found = classes(docs, id_col=id_col, text_col=text_col, k=k, percent=percent)
    drop = store(found.where("not kept").select(F.col("id").alias("_drop")), "drop", few=True)
    own = {c: f"_c{k}" for k, c in enumerate(docs.columns)}
    keyed = docs.select(*(F.col(c).alias(own[c]) for c in docs.columns), F.col(id_col).cast("long").alias("_drop"))
    return matching(keyed, drop, "_drop", invert=True).select(*(F.col(own[c]).alias(c) for c in docs.columns))
