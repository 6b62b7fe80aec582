"""Windows over streams, an extension of the engine."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def tumbling(stream: DataFrame, ts: str, width: str, keys: list[str], value: str, late: str = "1 day") -> DataFrame:
    out = stream.withWatermark(ts, late).groupBy(F.window(ts, width).alias("w"), *keys).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    return out.select(F.col("w.start").alias("start"), *keys, "n", "total")


def sessions(stream: DataFrame, ts: str, gap: str, keys: list[str], late: str = "1 day") -> DataFrame:
    out = stream.withWatermark(ts, late).groupBy(F.session_window(ts, gap).alias("w"), *keys).agg(F.count("*").alias("n"))
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, "n")


def deduplicated(stream: DataFrame, ts: str, keys: list[str], late: str = "1 day") -> DataFrame:
    return stream.withWatermark(ts, late).dropDuplicatesWithinWatermark(keys)


def drained(spark: SparkSession, schema: StructType, folder: str, name: str, plan: Callable[[DataFrame], DataFrame], mode: str) -> DataFrame:
    """Runs plan over what the folder holds now, to its end, and returns the result table."""
    stream = spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(folder)
    table = f"drained_{uuid.uuid4().hex}"
    run = plan(stream).writeStream.format("memory").queryName(table).outputMode(mode).trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.table(table)
