"""Sources and sinks: strict JSON, tabular text, key=value lines, listings, and canonical output (SRC1-SRC10, SNK1-SNK7)."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_KINDS = {"int": int, "str": str, "float": float, "bool": bool, "list": list, "dict": dict}


def check(raw: str | None, fields: dict[str, str]) -> tuple[bool, str]:
    """Exact key set, no key twice, exact types (a bool is no int); the first rule that fails."""
    twice: list[str] = []

    def pairs(items):
        names = [k for k, _ in items]
        twice.extend(k for k in names if names.count(k) > 1)
        return dict(items)

    try:
        found = json.loads(raw or "", object_pairs_hook=pairs)
    except ValueError:
        return False, "NOT_JSON"
    if twice:
        return False, f"DUPLICATE_KEY {sorted(twice)[0]}"
    if not isinstance(found, dict):
        return False, "NOT_AN_OBJECT"
    if set(found) != set(fields):
        return False, "KEY_SET"
    for k, kind in fields.items():
        if type(found[k]) is not _KINDS[kind]:
            return False, f"TYPE {k}"
    return True, ""


def strict_report(df: DataFrame, raw_col: str, fields: dict[str, str]) -> DataFrame:
    """Adds ok and reason."""

    @F.pandas_udf("ok boolean, reason string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for raw in batches:
            yield pd.DataFrame([check(x, fields) for x in raw], columns=["ok", "reason"])

    return df.withColumn("_r", run(raw_col)).select(*df.columns, "_r.ok", "_r.reason")


def read_json_documents(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", True).json(path)


def read_tsv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).csv(path, sep="\t", header=True)


def read_pairs(spark: SparkSession, path: str) -> DataFrame:
    """Lines of key=value;... as a map."""
    return spark.read.text(path).select(F.expr("str_to_map(value, ';', '=')").alias("pairs"))


def listing(spark: SparkSession, path: str, glob: str = "*", recursive: bool = False) -> DataFrame:
    """path, length and sha256 of files, in the order of their names."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", recursive).load(path)
    return files.select("path", "length", F.sha2("content", 256).alias("sha256")).orderBy("path")


def canonical(value: Column) -> Column:
    """Compact JSON of a struct whose fields are in sorted order, with a line feed."""
    return F.concat(F.to_json(value), F.lit("\n"))


def canonical_digest(value: Column) -> Column:
    return F.sha2(canonical(value), 256)


def write_new(df: DataFrame, path: str, kind: str = "parquet") -> None:
    """Creates, never overwrites."""
    df.write.mode("errorifexists").format(kind).save(path)


def missing(wanted: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """What a content-addressed cache lacks."""
    return wanted.join(done.select(*keys).distinct(), keys, "left_anti")
