"""9. Sharding, in DataFrame operations only: minimax contiguous partition of atomic groups.

Groups (rows of equal text) lie on a line in the order of their digest, each as long as its bytes. The smallest
capacity for which the greedy cut needs no more than n shards is found by binary search, and the line is cut there.
The driver never sees the groups: it searches over a summary of a bounded number of intervals of the line, which
brackets the capacity from both sides, and has only the intervals refined that a greedy cut within the bracket can
meet, until none is open. Any cuts that keep the least capacity are equally good for the largest shard; of them those
near even shares are taken, as the greedy ones leave all the slack to the last shard.

A group larger than an even share of what remains takes a shard of its own, as no shard with it can be smaller; the
others are cut over the shards that are left. So the partition is contiguous on the line without those groups (at most
n - 1 of them), not on the whole line.

Defined cases: a null text has no bytes, checksum 0, and forms one group with other null texts, apart from empty texts;
equal rows stay together; no rows, no result; with fewer groups than shards some shards stay empty; other columns are
ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import prefix_sums, store

OVERHEAD = 8
INTERVALS = 1 << 14


def _chain(cap: int, total: int, shards: int, low: np.ndarray, high: np.ndarray, hopeful: bool) -> list[int]:
    """Ends of the greedy shards. Within an interval only its first and last group end are known: hopeful takes the limit itself, else its first."""
    ends, at = [], 0
    for _ in range(shards):
        limit = at + cap
        if limit >= total:
            return [*ends, total]
        i = int(np.searchsorted(low, limit, "right")) - 1
        if i >= 0:
            at = max(at, int(high[i]) if high[i] <= limit else limit if hopeful else int(low[i]))
        ends.append(at)
    return ends


def _least(total: int, shards: int, floor: int, low: np.ndarray, high: np.ndarray, hopeful: bool) -> int:
    a, b = max(floor, -(-total // shards)), total
    while a < b:
        mid = (a + b) // 2
        if _chain(mid, total, shards, low, high, hopeful)[-1] >= total:
            b = mid
        else:
            a = mid + 1
    return a


def _spread(cap: int, total: int, shards: int, known: np.ndarray) -> list[int]:
    """Ends near even shares, none further than the capacity from the one before; `known` are the group ends that may be cut at."""
    least = [total]  # from here on the shards that are left suffice
    for _ in range(shards - 1):
        need = least[-1] - cap
        least.append(0 if need <= 0 else int(known[np.searchsorted(known, need)]))
    at, ends = 0, []
    for k, from_ in enumerate(reversed(least)):
        even = at + (total - at) // (shards - k)
        i = int(np.searchsorted(known, even, "right"))
        near = min((int(x) for x in known[max(i - 1, 0) : i + 1]), key=lambda x: abs(x - even), default=at)
        i = int(np.searchsorted(known, at + cap, "right")) - 1
        at = max(at, from_, min(near, int(known[i]) if i >= 0 else at))
        ends.append(at)
    return ends


def minimax_cuts(groups: DataFrame, end: Column, total: int, largest: int, shards: int, intervals: int = INTERVALS) -> tuple[int, list[int]]:
    """The least capacity and the ends of the shards; `end` is a group's end on the line."""

    def summary(ranges: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
        each = max(2, intervals // len(ranges))
        key = F.lit(None).cast("long")
        for k, (a, b) in enumerate(ranges):
            width = (b - a) // each + 1
            key = F.when(end.between(a, b), F.lit(k * (each + 1)) + F.floor((end - a) / width)).otherwise(key)
        got = groups.select(end.alias("e"), key.alias("k")).where("k is not null").groupBy("k").agg(F.min("e").alias("a"), F.max("e").alias("b")).collect()
        made = sorted((r.a, r.b) for r in got)
        return np.array([a for a, _ in made], np.int64), np.array([b for _, b in made], np.int64)

    low, high = summary([(0, total)])
    while True:
        best, sure = (_least(total, shards, largest, low, high, hopeful) for hopeful in (True, False))
        early, late = _chain(best, total, shards, low, high, False), _chain(sure, total, shards, low, high, True)
        early, late = ([*x, *[x[-1]] * (shards - len(x))] for x in (early, late))
        open_, ranges = low < high, []
        for a, b in zip([0, *early[:-1]], [0, *late[:-1]], strict=True):
            some = np.flatnonzero(open_ & (high > a + best) & (low <= b + sure))
            if len(some):
                ranges.append((int(low[some[0]]), int(high[some[-1]])))
        if not ranges:
            return sure, _spread(sure, total, shards, np.unique(np.concatenate([low, high])))
        merged: list[tuple[int, int]] = []
        for a, b in sorted(ranges):
            if merged and a <= merged[-1][1]:
                merged[-1] = (merged[-1][0], max(b, merged[-1][1]))
            else:
                merged.append((a, b))
        new_low, new_high = summary(merged)
        keep = np.ones(len(low), bool)
        for a, b in merged:
            keep &= ~((low >= a) & (high <= b))
        low, high = np.concatenate([low[keep], new_low]), np.concatenate([high[keep], new_high])
        order = np.argsort(low)
        low, high = low[order], high[order]


def shard(docs: DataFrame, *, shards: int = 24, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, size, text_crc32, shard, slot (gapless from 0 in its shard)."""
    text = F.col(text_col)
    rows = docs.select(
        F.col(id_col),
        (F.coalesce(F.octet_length(text), F.lit(0)) + OVERHEAD).cast("long").alias("size"),
        F.coalesce(F.crc32(text), F.lit(0)).cast("long").alias("text_crc32"),
        F.coalesce(F.unhex(F.sha2(text, 256)), F.lit(b"")).alias("_group"),
    )
    rows = store(rows, "sizes")
    line = prefix_sums(rows, [F.col("_group"), F.col(id_col)], {"_bytes": F.col("size"), "_rank": F.lit(1)}, "line")
    groups = store(line.groupBy("_group").agg((F.max(F.col("_bytes") + F.col("size"))).alias("end"), F.sum("size").alias("size"), F.count("*").alias("n")), "groups")

    total = groups.agg(F.sum("size")).first()[0] or 0
    top = groups.orderBy(F.desc("size"), "end").limit(shards).collect()
    left, rest, alone = shards, total, []
    while len(alone) < len(top) and left > 1 and top[len(alone)].size * left > rest:
        g = top[len(alone)]
        alone.append(g)
        left, rest = left - 1, rest - g.size
    largest = top[len(alone)].size if len(alone) < len(top) else 0

    def without(col: Column, what: str, of: Column) -> Column:
        """What lies before a row, less the groups that stand alone."""
        for g in alone:
            col = col - F.when(of > g.end, F.lit(g[what])).otherwise(F.lit(0))
        return col

    lone = F.lit(None).cast("int")
    for k, g in enumerate(alone):
        lone = F.when((F.col("end") <= g.end) & (F.col("end") > g.end - g.size), F.lit(shards - 1 - k)).otherwise(lone)
    others = groups.select(without(F.col("end"), "size", F.col("end")).alias("e"), lone.alias("lone")).where("lone is null")
    cuts = minimax_cuts(others, F.col("e"), rest, largest, left)[1] if rest else []

    end = (F.col("_bytes") + F.col("size")).alias("end")
    placed = line.select(id_col, "size", "text_crc32", "_rank", end).withColumn("lone", lone)
    place = sum((F.when(without(F.col("end"), "size", F.col("end")) > c, 1).otherwise(0) for c in cuts[:-1]), F.lit(0))
    placed = placed.withColumns({"shard": F.coalesce("lone", place).cast("int"), "_rank": F.when(F.col("lone").isNull(), without(F.col("_rank"), "n", F.col("end"))).otherwise(F.col("_rank"))})
    first = placed.groupBy("shard").agg(F.min("_rank").alias("_first"))  # a row per shard
    return placed.join(F.broadcast(first), "shard").select(id_col, "size", "text_crc32", "shard", (F.col("_rank") - F.col("_first")).alias("slot"))
