"""Order-dependent operators: islands, sessions, rolling baselines, lags and histograms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def islands(df: DataFrame, group: list[str], order: list[str], value: str) -> DataFrame:
    """Runs of equal value: group, value, island, length, first, last (of the first order column)."""
    w = Window.partitionBy(*group).orderBy(*order)
    new = F.when(F.lag(value).over(w).eqNullSafe(F.col(value)) & (F.row_number().over(w) > 1), 0).otherwise(1)
    marked = df.withColumn("_new", new).withColumn("island", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy(*group, value, "island").agg(F.count("*").alias("length"), F.min(order[0]).alias("first"), F.max(order[0]).alias("last"))


def gap_sessions(df: DataFrame, group: list[str], order: str, tie: str, factor: float) -> DataFrame:
    """A new session where the gap exceeds factor times the group's median gap; order must be numeric."""
    w = Window.partitionBy(*group).orderBy(order, tie)
    gaps = df.withColumn("_gap", F.col(order) - F.lag(order).over(w))
    median = gaps.groupBy(*group).agg(F.median("_gap").alias("_median"))
    cut = F.when(F.col("_gap") > F.col("_median") * factor, 1).otherwise(0)
    joined = gaps.join(median, group).withColumn("_cut", cut)
    return joined.withColumn("session", F.sum("_cut").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_gap", "_median", "_cut")


def rolling(df: DataFrame, group: list[str], order: str, value: str, reach: int) -> DataFrame:
    """Centred rolling mean, median, minimum and maximum; frames are cut off at the ends."""
    w = Window.partitionBy(*group).orderBy(order).rowsBetween(-reach, reach)
    return df.withColumns({"roll_mean": F.avg(value).over(w), "roll_median": F.percentile(value, F.lit(0.5)).over(w), "roll_min": F.min(value).over(w), "roll_max": F.max(value).over(w)})


def autocorrelation(df: DataFrame, index: str, value: str, lags: int) -> DataFrame:
    """Sum of products of the centred series at each lag; index must be gapless."""
    mean = df.agg(F.avg(value).alias("_mean"))
    centred = df.crossJoin(F.broadcast(mean)).select(F.col(index).alias("i"), (F.col(value) - F.col("_mean")).alias("x"))
    shifted = centred.select(F.explode(F.sequence(F.lit(1), F.lit(lags))).alias("lag"), "i", "x")
    pairs = shifted.join(centred.select(F.col("i").alias("j"), F.col("x").alias("y")), F.col("i") + F.col("lag") == F.col("j"))
    return pairs.groupBy("lag").agg(F.sum(F.col("x") * F.col("y")).alias("r"))


def local_maxima(df: DataFrame, order: str, value: str, fraction: float) -> DataFrame:
    """Points above their left and not below their right neighbour, at least fraction of the greatest, refined by a parabola."""
    w = Window.orderBy(order)
    top = df.agg(F.max(value).alias("_top"))
    a, b, c = F.col("_a"), F.col(value), F.col("_c")
    near = df.withColumns({"_a": F.lag(value).over(w), "_c": F.lead(value).over(w)}).crossJoin(F.broadcast(top))
    curve = a - 2 * b + c
    shift = F.when(curve == 0, F.lit(0.0)).otherwise(F.lit(0.5) * (a - c) / curve)
    return near.where((b > a) & (b >= c) & (b >= F.col("_top") * fraction)).select(order, value, (F.col(order) + shift).alias("refined"))


def otsu(df: DataFrame, value: str, low: float, high: float, bins: int) -> DataFrame:
    """Histogram and the threshold bin of greatest between-class variance, ties to the first bin."""
    b = F.greatest(F.lit(0), F.least(F.lit(bins - 1), F.floor((F.col(value) - low) / ((high - low) / bins)).cast("int"))).alias("bin")
    hist = df.select(b).groupBy("bin").agg(F.count("*").alias("n"))
    w = Window.orderBy("bin")
    cum = hist.withColumns({"w0": F.sum("n").over(w), "s0": F.sum(F.col("n") * F.col("bin")).over(w)})
    total = hist.agg(F.sum("n").alias("w"), F.sum(F.col("n") * F.col("bin")).alias("s"))
    joined = cum.crossJoin(F.broadcast(total)).where("w0 < w")
    diff = F.col("s0") / F.col("w0") - (F.col("s") - F.col("s0")) / (F.col("w") - F.col("w0"))
    var = F.col("w0").cast("double") * (F.col("w") - F.col("w0")) * diff * diff
    return joined.select("bin", var.alias("between")).orderBy(F.desc("between"), "bin").limit(1)
