"""Tables of a data folder and a session for local work."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

_own_dirs: dict[str, str] = {}


def session(cores: int | str = "*", shuffle_partitions: int = 8) -> SparkSession:
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("VERISTRATA_DRIVER_MEMORY", "6g"))
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a temporary one in local mode."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _own_dirs:
        _own_dirs[app] = "file://" + tempfile.mkdtemp(prefix="veristrata-")
    return _own_dirs[app]


def shared_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def numbered(df: DataFrame, key: str) -> DataFrame:
    """Rows with ``place``, their number from 0 in the order of ``key``: range-sorted parts and one offset per part.

    The parts are written once, so that places do not change when a task is run again.
    """
    rows = df.repartitionByRange(key).sortWithinPartitions(key).withColumn("_part", F.spark_partition_id())
    rows = materialize(rows.withColumn("_own", F.row_number().over(Window.partitionBy("_part").orderBy(key)) - 1), "numbered")
    sizes = {r["_part"]: r["n"] for r in rows.groupBy("_part").agg(F.count("*").alias("n")).collect()}  # a row per part
    first, total = [], 0
    for p in sorted(sizes):
        first.append((p, total))
        total += sizes[p]
    offsets = df.sparkSession.createDataFrame(first, "_part int, _before long")
    return rows.join(F.broadcast(offsets), "_part").withColumn("place", F.col("_before") + F.col("_own")).drop("_part", "_own", "_before")


def join_same(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """A join on keys in which null meets null; the right side's keys are dropped."""
    r = right.select(*[F.col(k).alias(f"_r_{k}") for k in keys], *[c for c in right.columns if c not in keys])
    on = [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in keys]
    return left.join(r, on, how).drop(*[f"_r_{k}" for k in keys])


def running(df: DataFrame, keys: list[str], order: list[Column], sums: dict[str, Column]) -> DataFrame:
    """Rows with running sums (whole numbers, own row included) in a total order within each key, and ``total``, the
    key's number of rows.

    Rows are dealt by ranges of (keys, order), summed within each range, and the ranges before are added: a key that
    holds most rows is spread over many tasks. The ranges are written once, so that reruns see the same ones.
    """
    start = df.select("*", *[c.cast("long").alias(f"_v_{n}") for n, c in sums.items()])
    ranged = materialize(start.repartitionByRange(*keys, *order).withColumn("_part", F.spark_partition_id()), "ranges")
    parts = ranged.groupBy(*keys, "_part").agg(F.count("*").alias("_n"), *[F.sum(f"_v_{n}").alias(f"_s_{n}") for n in sums])
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.select(*keys, "_part", F.sum("_n").over(Window.partitionBy(*keys)).alias("total"), *[F.coalesce(F.sum(f"_s_{n}").over(before), F.lit(0)).alias(f"_b_{n}") for n in sums])
    own = Window.partitionBy(*keys, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    rows = ranged.select("*", *[F.sum(f"_v_{n}").over(own).alias(f"_o_{n}") for n in sums])
    out = join_same(rows, materialize(offsets, "offsets"), [*keys, "_part"])  # one row per key and range
    return out.select(*df.columns, "total", *[(F.col(f"_b_{n}") + F.col(f"_o_{n}")).alias(n) for n in sums])


def dealt(df: DataFrame) -> DataFrame:
    """Rows of a table read in fewer tasks than there are cores (one row group, say), dealt to all; else as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it again: cuts lineage, survives lost executors."""
    path = shared_path(df.sparkSession, name)
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
