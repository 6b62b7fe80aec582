"""Line fits that withstand outliers.

What a round hands to the next is one line per group, checkpointed; rows are joined with it and aggregated by group, so
plans don't grow with the rounds and no group is gathered in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .lineage import cut


def _points(df: DataFrame, by: str, x: str, y: str) -> DataFrame:
    points = df.select(by, F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y"))
    return points.where(F.col(by).isNotNull() & F.col("_x").isNotNull() & F.col("_y").isNotNull())


def _off(slope: str = "_slope", intercept: str = "_intercept"):
    return F.abs(F.col(slope) * F.col("_x") + F.col(intercept) - F.col("_y"))


def consensus_line(df: DataFrame, by: str, x: str, y: str, *, tolerance: float, rounds: int = 3, least: int = 4) -> DataFrame:
    """by, slope, intercept, n_kept: a fit to the rows within tolerance of the last fit, over some rounds.

    A round that would leave fewer than `least` rows changes nothing; a group of fewer rows has null results. Rows with
    a null are ignored.
    """
    points = _points(df, by, x, y)
    line = [F.regr_slope("_y", "_x").alias("_slope"), F.regr_intercept("_y", "_x").alias("_intercept"), F.count("*").alias("n_kept")]
    held = None
    for _ in range(rounds):
        kept = points if held is None else points.join(held, by).where((F.col("_s").isNull()) | (_off("_s", "_i") <= tolerance))
        tried = cut(kept.groupBy(by).agg(*line))
        near = points.join(tried, by).groupBy(by).agg(F.count_if(_off() <= tolerance).alias("_n"))
        new = tried.join(near, by)
        new = new.withColumns({"_s": F.lit(None).cast("double"), "_i": F.lit(None).cast("double")}) if held is None else new.join(held, by)
        enough = F.col("_n") >= least
        held = cut(new.select(by, F.when(enough, F.col("_slope")).otherwise(F.col("_s")).alias("_s"), F.when(enough, F.col("_intercept")).otherwise(F.col("_i")).alias("_i")))
    kept = points if held is None else points.join(held, by).where(F.col("_s").isNull() | (_off("_s", "_i") <= tolerance))
    ok = F.col("n_kept") >= least
    return kept.groupBy(by).agg(*line).select(by, F.when(ok, F.col("_slope")).alias("slope"), F.when(ok, F.col("_intercept")).alias("intercept"), "n_kept")


def huber_line(df: DataFrame, by: str, x: str, y: str, *, rounds: int = 5, k: float = 1.5) -> DataFrame:
    """by, slope, intercept: least squares weighted anew each round by min(1, k * scale / residual), the scale being 1.4826 median residuals.

    The weight multiplies the residual, so its square enters the sums. Groups whose x are all equal have null results;
    rows with a null are ignored.
    """
    points = _points(df, by, x, y)

    def fit(weighted: DataFrame) -> DataFrame:
        w2 = F.col("_w") * F.col("_w")
        sums = weighted.groupBy(by).agg(F.sum(w2).alias("w"), F.sum(w2 * F.col("_x")).alias("sx"), F.sum(w2 * F.col("_y")).alias("sy"), F.sum(w2 * F.col("_x") * F.col("_x")).alias("xx"), F.sum(w2 * F.col("_x") * F.col("_y")).alias("xy"))
        det = F.col("w") * F.col("xx") - F.col("sx") * F.col("sx")
        slope = F.when(det > 0, (F.col("w") * F.col("xy") - F.col("sx") * F.col("sy")) / det)
        return cut(sums.withColumn("_slope", slope).select(by, "_slope", ((F.col("sy") - F.col("_slope") * F.col("sx")) / F.col("w")).alias("_intercept")))

    line = fit(points.withColumn("_w", F.lit(1.0)))
    for _ in range(rounds):
        off = points.join(line, by).select(by, "_x", "_y", _off().alias("_off"))
        scale = off.groupBy(by).agg((F.percentile("_off", F.lit(0.5)) * 1.4826 + 1e-9).alias("_scale"))
        line = fit(off.join(scale, by).withColumn("_w", F.least(F.lit(1.0), F.col("_scale") * k / (F.col("_off") + 1e-12))))
    return line.select(by, F.col("_slope").alias("slope"), F.col("_intercept").alias("intercept"))
