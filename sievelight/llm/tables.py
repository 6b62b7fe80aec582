"""Tables in the folder that the cluster shares, and prefix sums over rows in a global order."""

from __future__ import annotations

import tempfile
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

FOLDER = "spark.checkpoint.dir"
#: Bounds of one Arrow batch: with them the memory of a Python worker depends on neither the table nor its partitions.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": 2_000, "spark.sql.execution.arrow.maxBytesPerBatch": 8 << 20}
#: Files of a table stored in few, where the cluster has fewer than half as many cores.
FEWEST_FILES = 12


def shared_folder(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; where it is unset, as in tests on one machine, one of our own."""
    folder = spark.conf.get(FOLDER, None) or spark.sparkContext.getConf().get(FOLDER)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"{FOLDER} must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="sievelight-")
        spark.conf.set(FOLDER, folder)
    return folder.rstrip("/")


def bound_batches(spark: SparkSession) -> None:
    """Lowers the session's bounds of Arrow batches to BATCH, unless they are lower already."""
    for name, most in BATCH.items():
        now = spark.conf.get(name, None)
        if now is None or not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(name, str(most))


def give_back(spark: SparkSession) -> None:
    """Collects the garbage of the executors' JVMs, which then give free heap back to the machine.

    A JVM that isn't told to keeps all the heap that earlier work once needed, beside the Python workers of later work.
    Four short tasks a core; an executor that gets none of them only keeps its heap.
    """
    n = 4 * spark.sparkContext.defaultParallelism
    spark.range(0, n, 1, n).select(F.java_method(F.lit("java.lang.System"), F.lit("gc"))).write.format("noop").mode("overwrite").save()


def store(df: DataFrame, name: str, *, few: bool = False) -> DataFrame:
    """Writes df to the shared folder and reads it again: lineage ends here and a lost executor costs nothing before it.

    few: for tables of ids and numbers; the partitions of the last shuffle are written in two files for each core of the
    cluster. On a local file system each file costs an executor's JVM a fork (chmod), and while it forks its memory is
    counted twice.
    """
    spark = df.sparkSession
    bound_batches(spark)
    path = f"{shared_folder(spark)}/sievelight/{name}-{uuid.uuid4().hex}"
    (df.coalesce(max(FEWEST_FILES, 2 * spark.sparkContext.defaultParallelism)) if few else df).write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def prefix_sums(df: DataFrame, order: list[Column], sums: dict[str, Column], name: str, *, few: bool = False) -> DataFrame:
    """df with, for each of sums, the exclusive running sum in the global order; stored.

    Two passes: rows are range partitioned, so that equal keys may spread over partitions only if the order tells them
    apart, each partition is summed on its own, and one row per partition gives the offsets (that table is broadcast:
    it has as many rows as there are partitions).
    """
    part = "_part"
    rows = df.repartitionByRange(*order).withColumn(part, F.spark_partition_id())
    within = Window.partitionBy(part).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    local = {k: F.coalesce(F.sum(v).over(within), F.lit(0)).cast("long") for k, v in sums.items()}
    value = {f"_value_{k}": v.cast("long") for k, v in sums.items()}
    rows = store(rows.withColumns(local | value), name, few=few)
    totals = rows.groupBy(part).agg(*(F.sum(f"_value_{k}").alias(f"_value_{k}") for k in sums))
    before = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(part, *(F.coalesce(F.sum(f"_value_{k}").over(before), F.lit(0)).alias(f"_before_{k}") for k in sums))
    joined = rows.join(F.broadcast(offsets), part)
    return joined.withColumns({k: F.col(k) + F.col(f"_before_{k}") for k in sums}).drop(
        part, *(f"_before_{k}" for k in sums), *(f"_value_{k}" for k in sums)
    )


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def join_unique(left: DataFrame, right: DataFrame, key: str, rows: str, how: str = "inner") -> DataFrame:
    """left joined with right, which has each key once and in column `rows` about how many rows of left have it.

    Keys with over 1/256 of the rows, of which there can be 256 at most, are broadcast; the others are shuffled. So no
    key is ever gathered in one task. `rows` is dropped; a null key joins nothing.
    """
    total = right.agg(F.sum(rows)).first()[0] or 0
    flagged = right.withColumn("_heavy", F.col(rows) * 256 > total).drop(rows)
    keys = flagged.where("_heavy").select(F.col(key), F.lit(True).alias("_is"))
    marked = left.join(F.broadcast(keys), key, "left")
    often = marked.where("_is").drop("_is").join(F.broadcast(flagged.where("_heavy").drop("_heavy")), key, how)
    seldom = marked.where("_is is null").drop("_is").join(flagged.where("not _heavy").drop("_heavy"), key, how)
    return often.unionByName(seldom)
