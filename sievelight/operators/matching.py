"""Joins of the engine: run comparison, bans, member binding, overlaps, nearest and shifted matches."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def compare_runs(a: DataFrame, b: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Full grid of two runs; `changed` is null-safe, a side that is missing stays null."""
    x = a.select(*keys, F.col(value).alias("run_a"))
    y = b.select(*keys, F.col(value).alias("run_b"))
    return x.join(y, keys, "full").withColumn("changed", ~F.col("run_a").eqNullSafe(F.col("run_b")))


def banned(df: DataFrame, ban: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Violations and the clean rest."""
    return df.join(ban.select(key).distinct(), key, "left_semi"), df.join(ban.select(key).distinct(), key, "left_anti")


def bind_members(claimed: DataFrame, actual: DataFrame, key: str, size: str, digest: str) -> DataFrame:
    """Why a claimed member isn't the actual one: the first of id, length and hash that fails."""
    b = actual.select(key, F.col(size).alias("_size"), F.col(digest).alias("_digest"), F.lit(True).alias("_known"))
    reason = F.when(F.col("_known").isNull(), "UNKNOWN_MEMBER").when(F.col(size) != F.col("_size"), "LENGTH_MISMATCH").when(F.col(digest) != F.col("_digest"), "HASH_MISMATCH").otherwise("OK")
    return claimed.join(b, key, "left").select(key, reason.alias("binding"))


#: Right intervals of a block at most, and left ones that one task holds against it at once.
BLOCK, SLICE = 1 << 18, 1 << 17


def _running_best(rows: np.ndarray, behind: bool) -> np.ndarray:
    """The largest value of each row up to a place; behind: from it on."""
    return np.maximum.accumulate(rows[:, ::-1], axis=1)[:, ::-1] if behind else np.maximum.accumulate(rows, axis=1)


def _overlapping_most(lo: np.ndarray, hi: np.ndarray, a: np.ndarray, b: np.ndarray, worth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each [lo, hi) the place of the [a, b) that overlaps it most, of equal ones that of the greatest worth, and the overlap (0: none).

    The best is sought in four sets: it begins before lo or not, and ends behind hi or not. Within each set one order tells
    which is best: the end, the length, the worth, or the earlier begin. A set is a prefix or suffix by begins, cut into
    blocks of powers of two; each block is sorted by ends with running bests of either direction.
    """
    n = len(a)
    order = np.argsort(a, kind="stable")
    a, b, worth = a[order], b[order], worth[order]
    levels = max(n - 1, 0).bit_length()
    size = 1 << levels
    by_end = np.argsort(b, kind="stable")
    end_rank = np.arange(size)
    end_rank[by_end] = np.arange(n)

    def ranked(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """By the rank of its end, each interval's rank in an order, -1 for those that only fill up; and the intervals in that order."""
        line = np.lexsort(keys)
        rank = np.full(size, -1)
        rank[end_rank[line]] = np.arange(n)
        return rank, line

    # (begins before lo, ends behind hi): the order within
    sets = {(True, False): ranked(worth, b), (False, False): ranked(worth, b - a), (True, True): ranked(worth), (False, True): ranked(worth, -a)}
    best = {k: np.full(len(lo), -1) for k in sets}
    before, ended = np.searchsorted(a, lo), np.searchsorted(b[by_end], hi, "right")
    ends = end_rank.reshape(size, 1)
    for level in range(levels + 1):
        width = 1 << level
        ends = np.sort(ends.reshape(size // width, width), axis=1, kind="stable")
        flat = (ends + np.arange(size // width)[:, None] * size).ravel()
        running = {k: _running_best(rank[ends], k[1]).ravel() for k, (rank, _) in sets.items()}
        for early in (True, False):
            length = before if early else size - before
            mine = np.flatnonzero(length >> level & 1)
            block = (length[mine] >> level) - 1 if early else size // width - (length[mine] >> level)
            at = np.searchsorted(flat, block * size + ended[mine])
            for late in (True, False):
                some = at < (block + 1) * width if late else at > block * width
                to = best[early, late]
                to[mine[some]] = np.maximum(to[mine[some]], running[early, late][at[some] if late else at[some] - 1])
    overlap, place, most = np.zeros(len(lo), np.int64), np.zeros(len(lo), np.int64), np.full(len(lo), np.iinfo(np.int64).min)
    for k, (_, line) in sets.items():
        got = np.flatnonzero(best[k] >= 0)
        i = line[best[k][got]]
        o = np.minimum(hi[got], b[i]) - np.maximum(lo[got], a[i])
        better = (o > 0) & ((o > overlap[got]) | ((o == overlap[got]) & (worth[i] > most[got])))
        got, i = got[better], i[better]
        overlap[got], place[got], most[got] = o[better], order[i], worth[i]
    return place, overlap


def best_overlap(left: DataFrame, right: DataFrame, *, left_id: str, right_id: str, lo: str, hi: str, width: int = 1, last_wins: bool = False, block: int = BLOCK, slice_: int = SLICE) -> DataFrame:
    """For each left interval the right one that overlaps it most, of equal ones that of the smallest id (last_wins: the greatest).

    Intervals are half open, with long ends and numeric ids. Pairs are never made: right intervals (of equal ones only the
    first) are dealt by their begins into blocks. A block that lies within a left interval as a whole answers with its
    longest, one that doesn't touch it not at all; in the others the best is searched in about log(block)^2 steps. Cuts
    between blocks, at multiples of `width`, are found by the driver and broadcast, a row for each.
    """
    sign = 1 if last_wins else -1
    ends = lambda df, i, p: df.select(F.col(i).alias(f"{p}id"), F.col(lo).cast("long").alias(f"{p}lo"), F.col(hi).cast("long").alias(f"{p}hi")).where(f"{p}lo < {p}hi")
    lefts = ends(left, left_id, "l")
    rights = ends(right, right_id, "r").groupBy("rlo", "rhi").agg((F.max if last_wins else F.min)("rid").alias("rid"))
    blocks = max(1, -(-rights.count() // block))
    cuts = sorted({c // width * width for c in rights.approxQuantile("rlo", [k / blocks for k in range(1, blocks)], 0.25 / blocks)}) if blocks > 1 else []

    @F.pandas_udf("int")
    def part(begin: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(np.array(cuts), begin.to_numpy(), "right").astype("int32"))

    rights = rights.withColumn("part", part("rlo") if cuts else F.lit(0))
    longest = F.max(F.struct((F.col("rhi") - F.col("rlo")).alias("overlap"), (F.col("rid") * sign).alias("r"))).alias("longest")
    extent = rights.groupBy("part").agg(F.count("*").alias("n"), F.min("rlo").alias("first"), F.max("rlo").alias("last"), F.max("rhi").alias("end"), longest)
    extent = left.sparkSession.createDataFrame(extent.collect(), extent.schema)
    extent = extent.withColumn("shares", F.ceil(F.col("n") / block).cast("int"))  # of equal begins, or where cuts are uneven
    met = lefts.join(F.broadcast(extent), (F.col("llo") < F.col("end")) & (F.col("first") < F.col("lhi")))
    within = (F.col("llo") <= F.col("first")) & (F.col("end") <= F.col("lhi"))
    asked = met.where(~within).select("lid", "llo", "lhi", "part", "shares")
    tasks = asked.groupBy("part").agg(F.count("*").alias("asked")).collect()
    tasks = left.sparkSession.createDataFrame([(r.part, -(-r.asked // slice_)) for r in tasks], "part int, slices int")
    asked = asked.join(F.broadcast(tasks), "part").select("lid", "llo", "lhi", "part", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("share"), F.pmod(F.xxhash64("lid", "llo", "lhi"), "slices").cast("int").alias("slice"))
    dealt = rights.join(F.broadcast(tasks), "part").join(F.broadcast(extent.select("part", "shares")), "part")
    dealt = dealt.select("rid", "rlo", "rhi", "part", F.pmod(F.xxhash64("rlo", "rhi"), "shares").cast("int").alias("share"), F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("slice"))

    def search(x: pa.Table, y: pa.Table) -> pa.Table:
        if not x.num_rows or not y.num_rows:
            return pa.table({"lid": x.column("lid").slice(0, 0), "overlap": pa.array([], pa.int64()), "rid": y.column("rid").slice(0, 0)})
        ids = y.column("rid").combine_chunks()
        worth = pc.rank(ids, sort_keys="ascending" if last_wins else "descending", null_placement="at_start", tiebreaker="dense").to_numpy().astype(np.int64)
        place, overlap = _overlapping_most(*(t.column(c).to_numpy() for t, c in ((x, "llo"), (x, "lhi"), (y, "rlo"), (y, "rhi"))), worth)
        found = np.flatnonzero(overlap > 0)
        return pa.table({"lid": x.column("lid").take(pa.array(found)), "overlap": pa.array(overlap[found]), "rid": ids.take(pa.array(place[found]))})

    kinds = f"lid {lefts.schema['lid'].dataType.simpleString()}, overlap long, rid {rights.schema['rid'].dataType.simpleString()}"
    keys = ["part", "share", "slice"]
    sought = asked.groupBy(*keys).cogroup(dealt.groupBy(*keys)).applyInArrow(search, kinds).select("lid", "overlap", (F.col("rid") * sign).alias("r"))
    whole = met.where(within).select("lid", "longest.overlap", "longest.r")
    found = whole.unionByName(sought).groupBy(F.col("lid").alias(left_id)).agg(F.max(F.struct("overlap", "r")).alias("m"))
    return found.select(left_id, F.col("m.r") * F.lit(sign), "m.overlap").toDF(left_id, right_id, "overlap")


def nearest(left: DataFrame, right: DataFrame, *, by: list[str], left_id: str, right_id: str, at: str, tolerance: int) -> DataFrame:
    """The nearest right row within tolerance, not exclusive; ties to the smaller right id. `at` is a long."""
    x = left.select(*by, F.col(left_id).alias("lid"), F.col(at).alias("lat"), F.explode(F.expr(f"sequence(({at} - {tolerance}) div {tolerance}, ({at} + {tolerance}) div {tolerance})")).alias("bin"))
    y = right.select(*by, F.col(right_id).alias("rid"), F.col(at).alias("rat"), F.expr(f"{at} div {tolerance}").alias("bin"))
    pairs = x.join(y, [*by, "bin"]).withColumn("distance", F.abs(F.col("lat") - F.col("rat"))).where(F.col("distance") <= tolerance)
    return pairs.groupBy(F.col("lid").alias(left_id)).agg(F.min(F.struct("distance", "rid")).alias("m")).select(left_id, F.col("m.rid").alias(right_id), F.col("m.distance").alias("distance"))


def nearest_exclusive(left: DataFrame, right: DataFrame, *, by: str, left_id: str, right_id: str, at: str, tolerance: int) -> DataFrame:
    """As `nearest`, in the order of the left rows, each right row used once. One group is one unit of work."""
    both = left.select(by, F.lit(0).alias("side"), F.col(left_id).alias("i"), F.col(at).alias("t")).unionByName(right.select(by, F.lit(1).alias("side"), F.col(right_id).alias("i"), F.col(at).alias("t")))

    def match(pdf: pd.DataFrame) -> pd.DataFrame:
        right = pdf[pdf.side == 1].sort_values(["t", "i"])
        t, ids, n, out = right.t.to_numpy(), right.i.to_numpy(), len(right), []
        later, earlier = list(range(n + 1)), list(range(n + 1))  # the next free one from k on; one more than the last free one before k

        def root(line: list[int], k: int) -> int:
            while line[k] != k:
                line[k] = line[line[k]]
                k = line[k]
            return k

        for at, own in pdf[pdf.side == 0].sort_values(["t", "i"])[["t", "i"]].itertuples(index=False):
            k = int(np.searchsorted(t, at))
            up, down = root(later, k), root(earlier, k) - 1
            options = [(t[up] - at, ids[up], up)] if up < n else []
            if down >= 0:  # of equal times the smallest id
                down = root(later, int(np.searchsorted(t, t[down])))
                options.append((at - t[down], ids[down], down))
            best = min(options, default=None)
            if best is not None and best[0] <= tolerance:
                later[best[2]], earlier[best[2] + 1] = best[2] + 1, best[2]
                out.append((own, best[1], best[0]))
        return pd.DataFrame(out, columns=[left_id, right_id, "distance"]).astype("int64")

    return both.groupBy(by).applyInPandas(match, f"{left_id} long, {right_id} long, distance long")


def best_shift(a: Column, b: Column, reach: int) -> Column:
    """struct<agree, shift>: the shift of b against a with most equal characters; ties to the smallest, then the positive."""

    def agree(s: int) -> Column:
        i = F.sequence(F.lit(1), F.length(a))
        same = F.filter(F.when(F.length(a) > 0, i).otherwise(F.array().cast("array<int>")), lambda k: (k + s >= 1) & (k + s <= F.length(b)) & (F.substr(a, k, F.lit(1)) == F.substr(b, k + s, F.lit(1))))
        return F.struct(F.size(same).alias("agree"), F.lit(-abs(s)).alias("near"), F.lit(s).alias("shift"))

    return F.array_max(F.array(*(agree(s) for s in range(-reach, reach + 1))))


def greedy_non_overlapping(spans: DataFrame, *, group: str, keep: int | None = None) -> DataFrame:
    """group, start, end, score: best score first, dropping what overlaps a kept span."""

    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        kept: list = []
        for row in pdf.sort_values(["score", "start", "end"], ascending=[False, True, True]).itertuples(index=False):
            if all(row.end <= k.start or k.end <= row.start for k in kept):
                kept.append(row)
                if keep is not None and len(kept) == keep:
                    break
        return pd.DataFrame(kept, columns=pdf.columns)

    return spans.groupBy(group).applyInPandas(choose, spans.schema)

