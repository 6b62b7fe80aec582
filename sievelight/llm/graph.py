"""Connected components of a table of links, and joins that move few rows of a wide table."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import store

BLOOM_BITS = 1 << 24


def components(links: DataFrame, name: str = "components") -> DataFrame:
    """links: a, b (long). Per node of a link: v, c, the smallest node reachable.

    Minimum labels with hooking and pointer jumping: the number of rounds grows with the logarithm of the longest path.
    Every round ends in a stored table. A node with very many links is a hot key of joins whose other side has each key
    once; adaptive execution splits those. Minima are aggregated before the shuffle.
    """
    both = links.where("a <> b").select("a", "b")
    both = store(both.unionByName(both.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), f"{name}_links", few=True)
    label = store(both.groupBy(F.col("a").alias("v")).agg(F.min("b").alias("m")).select("v", F.least("v", "m").alias("c")), name, few=True)
    while True:
        seen = both.join(label.select(F.col("v").alias("b"), "c"), "b").groupBy(F.col("a").alias("v")).agg(F.min("c").alias("m"))
        near = seen.join(label, "v").where("m < c")
        better = near.select("v", "m").unionByName(near.select(F.col("c").alias("v"), "m")).groupBy("v").agg(F.min("m").alias("m"))
        hooked = label.join(better, "v", "left").select("v", F.least("c", F.coalesce("m", "c")).alias("c"), F.col("c").alias("old"))
        root = hooked.select(F.col("v").alias("c"), F.col("c").alias("root"))
        moved = store(hooked.join(root, "c").select("v", F.col("root").alias("c"), (F.col("root") < F.col("old")).alias("moved")), name, few=True)
        label = moved.select("v", "c")
        if not moved.where("moved").limit(1).count():
            return label


class Bloom:
    """A filter of at most BLOOM_BITS bits over long keys: says of no key in it that it isn't. When full it passes all, which costs time only."""

    def __init__(self, keys: DataFrame, key: str):
        h = F.pmod(F.xxhash64(key), F.lit(BLOOM_BITS))
        words = keys.select(h.alias("h")).groupBy(F.shiftright("h", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, int(h & 63))")).alias("bits"))
        bits = np.zeros(BLOOM_BITS // 64, np.int64)
        for r in words.toLocalIterator():
            bits[r.w] = r.bits
        self.bits = bits

    @staticmethod
    def place(key: str):
        return F.pmod(F.xxhash64(key), F.lit(BLOOM_BITS))

    def may(self, place: np.ndarray) -> np.ndarray:
        return (self.bits[place >> 6] >> (place & 63)) & 1 == 1


def matching(wide: DataFrame, keys: DataFrame, key: str, *, invert: bool = False) -> DataFrame:
    """Rows of wide whose key is in keys (invert: those whose key isn't; null keys too): only rows that pass a Bloom filter are shuffled."""
    shared = wide.sparkSession.sparkContext.broadcast(Bloom(keys, key))
    own = {c: f"_m{k}" for k, c in enumerate(wide.columns)}
    marked = wide.select(*(F.col(c).alias(own[c]) for c in wide.columns), F.coalesce(Bloom.place(key), F.lit(0)).alias("_place"))
    fields = ", ".join(f"`{own[f.name]}` {f.dataType.simpleString()}" for f in wide.schema)

    def run(want: bool):
        def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                may = shared.value.may(batch.column(batch.num_columns - 1).to_numpy())
                yield pa.RecordBatch.from_arrays(batch.columns[:-1], names=batch.schema.names[:-1]).filter(pa.array(may == want))

        return rows

    some = marked.mapInArrow(run(True), fields)
    theirs = keys.select(F.col(key).alias(own[key])).distinct()
    exact = some.join(theirs, own[key], "left_anti" if invert else "left_semi").select(*own.values())
    out = marked.mapInArrow(run(False), fields).unionByName(exact) if invert else exact
    return out.select(*(F.col(n).alias(c) for c, n in own.items()))
