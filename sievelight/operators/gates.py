"""Threshold gates with ordered reasons, tolerance checks and three-state policies."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    """Passes if `metric op limit`; a null metric fails."""

    metric: str
    op: str
    limit: float
    reason: str

    def passes(self) -> Column:
        m = F.col(self.metric)
        return F.coalesce({">=": m >= self.limit, "<=": m <= self.limit, ">": m > self.limit, "<": m < self.limit}[self.op], F.lit(False))


def gate(df: DataFrame, rules: list[Rule]) -> DataFrame:
    """Adds reasons, in the order of the rules, and status: ACCEPT if there are none, else RECAPTURE."""
    failed = F.array(*(F.when(~r.passes(), F.lit(r.reason)) for r in rules))
    reasons = F.filter(failed, lambda x: x.isNotNull())
    return df.withColumn("reasons", reasons).withColumn("status", F.when(F.size(reasons) == 0, "ACCEPT").otherwise("RECAPTURE"))


def reason_counts(gated: DataFrame, id_col: str) -> DataFrame:
    """Per reason the number of rows and the first of their ids."""
    return gated.select(F.explode("reasons").alias("reason"), id_col).groupBy("reason").agg(F.count("*").alias("n"), F.min(id_col).alias("first_id"))


def zero_filled(counts: DataFrame, key: str, domain: list[str]) -> DataFrame:
    """Counts over a fixed domain, 0 where there are none."""
    return counts.sparkSession.range(1).select(F.explode(F.array(*map(F.lit, domain))).alias(key)).join(counts, key, "left").select(key, F.coalesce("n", F.lit(0)).alias("n"))


def first_reason(cases: list[tuple[Column, str]], otherwise: str) -> Column:
    """The first case that holds."""
    out = F.lit(otherwise)
    for holds, reason in reversed(cases):
        out = F.when(holds, reason).otherwise(out)
    return out


def policy(flags: str, key: str) -> Column:
    """A missing flag isn't a false one: MISSING, REFUSED or ALLOWED."""
    value = F.try_element_at(F.col(flags), F.lit(key))
    return F.when(value.isNull(), "MISSING").when(value, "ALLOWED").otherwise("REFUSED")


def tolerance_failures(checks: list[tuple[str, Column, Column, float]]) -> Column:
    """Names of the checks whose values differ by more than the tolerance; one absent side alone is a failure, too."""
    bad = [F.when(a.isNull() & b.isNull(), None).when(a.isNull() | b.isNull() | (F.abs(a - b) > tol), name) for name, a, b, tol in checks]
    return F.filter(F.array(*bad), lambda x: x.isNotNull())
