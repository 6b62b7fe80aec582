"""Order-dependent operators on (aggregated) series and exact order statistics."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .lineage import cut


def hysteresis(df: DataFrame, order: str, strict: Column, lenient: Column) -> DataFrame:
    """Runs of rows that pass the lenient test and hold one that passes the strict one: first, last, length, seeds."""
    w = Window.orderBy(order)
    marked = df.select(order, strict.alias("_s"), lenient.alias("_l"))
    new = F.when(F.col("_l") & ~F.coalesce(F.lag("_l").over(w), F.lit(False)), 1).otherwise(0)
    runs = marked.withColumn("_new", new).withColumn("_run", F.sum("_new").over(w)).where("_l")
    found = runs.groupBy("_run").agg(F.min(order).alias("first"), F.max(order).alias("last"), F.count("*").alias("length"), F.count_if("_s").alias("seeds"))
    return found.where("seeds > 0").drop("_run")


def box_mean(grid: DataFrame, x: str, y: str, value: str, reach: int) -> DataFrame:
    """Half-up integer mean over the part of a square of cells that lies on the grid: two passes of sums, one division."""
    across = Window.partitionBy(y).orderBy(x).rangeBetween(-reach, reach)
    down = Window.partitionBy(x).orderBy(y).rangeBetween(-reach, reach)
    rows = grid.withColumns({"_s": F.sum(value).over(across), "_n": F.count(value).over(across)})
    return rows.withColumns({"_s": F.sum("_s").over(down), "_n": F.sum("_n").over(down)}).withColumn("mean", F.expr("(2 * _s + _n) div (2 * _n)")).drop("_s", "_n")


def range_mass(df: DataFrame, index: str, value: str, width: int) -> DataFrame:
    """Sum of each run of `width` rows from prefix sums, where the run is whole; index is gapless."""
    sums = df.select(F.col(index).alias("i"), F.sum(value).over(Window.orderBy(index)).alias("cum"), F.col(value).alias("v"))
    ends = sums.select((F.col("i") - width + 1).alias("i"), F.col("cum").alias("upto"))
    return sums.join(ends, "i").select("i", (F.col("upto") - F.col("cum") + F.col("v")).alias("mass"))


def mad_outliers(df: DataFrame, order: str, value: str, reach: int, factor: float) -> DataFrame:
    """Residual against a centred rolling median (cut off at the ends); an outlier is farther than factor scaled MADs from the median residual."""
    near = Window.orderBy(order).rowsBetween(-reach, reach)
    rest = df.select(order, value, (F.col(value) - F.percentile(value, F.lit(0.5)).over(near)).alias("residual"))
    centre = rest.agg(F.median("residual").alias("_m"))
    away = rest.crossJoin(F.broadcast(centre)).withColumn("_d", F.abs(F.col("residual") - F.col("_m")))
    scale = away.agg((F.median("_d") * 1.4826).alias("_mad"))
    return away.crossJoin(F.broadcast(scale)).select(order, value, "residual", (F.col("_d") > F.col("_mad") * factor).alias("outlier"))


def median_reject(df: DataFrame, group: str, value: str, share: float) -> DataFrame:
    """reason: why a value is dropped, further than a share from its group's median; null if it stays."""
    middle = df.groupBy(group).agg(F.median(value).alias("median"))
    far = F.abs(F.col(value) - F.col("median")) > F.abs(F.col("median")) * share
    return df.join(middle, group).withColumn("reason", F.when(far, F.when(F.col(value) < F.col("median"), "BELOW_MEDIAN").otherwise("ABOVE_MEDIAN")))


def agree_with_neighbours(df: DataFrame, group: str, chosen: str, candidates: str, share: float) -> DataFrame:
    """selected: the chosen value, or the candidate nearest the group's median if that is further than a share from it; ties to the smaller."""
    middle = df.groupBy(group).agg(F.median(chosen).alias("median"))
    nearest = F.array_min(F.transform(candidates, lambda c: F.struct(F.abs(c - F.col("median")).alias("d"), c.alias("c"))))["c"]
    return df.join(middle, group).withColumn("selected", F.when(F.abs(F.col(chosen) - F.col("median")) > F.col("median") * share, nearest).otherwise(F.col(chosen)))


def hopping_phase(df: DataFrame, index: str, value: str, *, size: int, hop: int, period: int) -> DataFrame:
    """Per window [start, start + size), starts being multiples of hop: phase and weight of one period, and the rows in it."""
    starts = df.select(index, value, F.explode(F.expr(f"sequence(({index} div {hop}) * {hop}, greatest(0, {index} - {size} + {hop}) div {hop} * {hop}, -{hop})")).alias("start"))
    angle = F.col(index) * (2 * np.pi / period)
    sums = starts.groupBy("start").agg(F.count("*").alias("n"), F.sum(F.col(value) * F.cos(angle)).alias("c"), F.sum(F.col(value) * F.sin(angle)).alias("s"))
    return sums.select("start", "n", F.atan2("s", "c").alias("phase"), F.sqrt(F.col("c") * F.col("c") + F.col("s") * F.col("s")).alias("weight"))


def smooth(df: DataFrame, group: str, order: str, value: str, strength: float) -> DataFrame:
    """x with (I + strength * L) x = value, L the Laplacian of the path through a group's rows; one group, already aggregated, is one unit of work."""

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order)
        y, n = pdf[value].to_numpy(float), len(pdf)
        side, ends = np.full(n, -strength), np.isin(np.arange(n), (0, n - 1)).astype(float) * (n > 1) + 2.0 * (n == 1)
        main, out = 1 + strength * (2 - ends), y.copy()
        for k in range(1, n):  # elimination of a tridiagonal system
            f = side[k] / main[k - 1]
            main[k] -= f * side[k - 1]
            out[k] -= f * out[k - 1]
        for k in range(n - 1, -1, -1):
            out[k] = (out[k] - (side[k] * out[k + 1] if k + 1 < n else 0)) / main[k]
        return pd.DataFrame({group: pdf[group], order: pdf[order], "smooth": out})

    kinds = dict(df.dtypes)
    return df.select(group, order, value).groupBy(group).applyInPandas(solve, f"{group} {kinds[group]}, {order} {kinds[order]}, smooth double")


def first_success(df: DataFrame, group: str, order: str, success: Column, depth: Column) -> DataFrame:
    """The first row that succeeds; where none does, the deepest, the first of equals."""
    good = F.min(F.when(success, F.col(order)))
    deepest = F.max(F.struct(depth.alias("d"), (-F.col(order)).alias("o")))
    return df.groupBy(group).agg(good.alias("_g"), deepest.alias("_d")).select(group, F.coalesce("_g", -F.col("_d.o")).alias(order), F.col("_g").isNotNull().alias("success"))


def fill_gaps(df: DataFrame, index: str, value: str) -> DataFrame:
    """Every index between the least and the greatest; missing values are interpolated between their neighbours."""
    ends = df.agg(F.min(index).alias("a"), F.max(index).alias("b")).where("a is not null")
    every = ends.select(F.explode(F.sequence("a", "b")).alias(index)).join(df, index, "left")
    before, after = Window.orderBy(index).rowsBetween(Window.unboundedPreceding, 0), Window.orderBy(index).rowsBetween(0, Window.unboundedFollowing)
    known = F.when(F.col(value).isNotNull(), F.struct(index, value))
    near = every.withColumns({"_a": F.last(known, ignorenulls=True).over(before), "_b": F.first(known, ignorenulls=True).over(after)})
    i, x = F.col(index), lambda side, c: F.col(f"{side}.{c}")
    line = x("_a", value) + (x("_b", value) - x("_a", value)) * (i - x("_a", index)) / (x("_b", index) - x("_a", index))
    return near.select(index, F.coalesce(F.col(value).cast("double"), line).alias(value), F.col(value).isNull().alias("filled"))


def ranked(df: DataFrame, group: str, value: str) -> DataFrame:
    """df (group, value) without nulls, with the row's place from 0 in its group's order, and the group's size n.

    Two passes over range partitions: counts of each group in each partition, then their running totals (a row per
    group and partition, broadcast) added to the places within a partition. No group is ever gathered in one task.
    """
    part = cut(df.where(F.col(value).isNotNull()).select(group, value).repartitionByRange(group, value).withColumn("_p", F.spark_partition_id()))
    sizes = part.groupBy(group, "_p").agg(F.count("*").alias("_c"))
    w = Window.partitionBy(group)
    before = sizes.select(group, "_p", (F.sum("_c").over(w.orderBy("_p")) - F.col("_c")).alias("_before"), F.sum("_c").over(w).alias("n"))
    within = F.row_number().over(Window.partitionBy("_p", group).orderBy(value)) - 1
    return part.withColumn("place", within).join(F.broadcast(before), [group, "_p"]).select(group, value, (F.col("place") + F.col("_before")).alias("place"), "n")


def quantiles(df: DataFrame, group: str, value: str, shares: dict[str, float]) -> DataFrame:
    """Linearly interpolated quantiles of each group, by their places."""
    places, out = ranked(df, group, value), {}
    for name, q in shares.items():
        at = F.lit(q) * (F.col("n") - 1)
        low = F.max(F.when(F.col("place") == F.floor(at), F.col(value)))
        high = F.max(F.when(F.col("place") == F.ceil(at), F.col(value)))
        share = F.max(at - F.floor(at))
        out[name] = (low + (high - low) * share).alias(name)
    return places.groupBy(group).agg(*out.values())


def lower_quantile(df: DataFrame, group: str, value: str, num: int, den: int) -> DataFrame:
    """Element (n - 1) * num div den of each group's order: never interpolated."""
    return ranked(df, group, value).where(f"place = (n - 1) * {num} div {den}").select(group, value)
