"""Sinks as tables in the shared folder: versions that merge by key, whole replacements, idempotent batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def upsert(path: str, rows: DataFrame, keys: list[str], version: int) -> None:
    """Write a version of rows by key. Writing a version again replaces it, so a repeated job changes nothing."""
    rows.write.mode("overwrite").parquet(f"{path}/version={version}")


def merged(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """The rows after all versions: per key and column the last version's value that is not null."""
    rows = spark.read.parquet(path)
    values = [c for c in rows.columns if c not in (*keys, "version")]
    return rows.groupBy(*keys).agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), F.col("version"))).alias(c) for c in values])


def write_whole(rows: DataFrame, path: str, kind: str) -> None:
    """Write beside the target, then put it in the target's place: readers see all of it or the one before."""
    spark = rows.sparkSession
    beside, hadoop = f"{path}.tmp", spark.sparkContext._jvm.org.apache.hadoop.fs
    rows.write.mode("overwrite").format(kind).save(beside)
    target = hadoop.Path(path)
    fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.delete(target, True)
    fs.rename(hadoop.Path(beside), target)


def write_batch(rows: DataFrame, path: str, batch: int) -> None:
    rows.write.mode("overwrite").parquet(f"{path}/batch={batch}")


def append_feedback(rows: DataFrame, path: str, batch: int, most: int = 2000) -> None:
    """Append a batch of feedback (claim_id, label, rationale): missing ids and labels are empty, reasons are cut to ``most``
    characters. A repeated batch replaces itself."""
    kept = rows.fillna("", ["claim_id", "label"]).withColumn("rationale", F.substring("rationale", 1, most))
    write_batch(kept, path, batch)


def progress(spark: SparkSession, path: str) -> DataFrame:
    """(run, position, done, finished) of runs from their batches; a finished run stays finished."""
    rows = spark.read.parquet(path)
    return rows.groupBy("run").agg(F.max("position").alias("position"), F.sum("done").alias("done"), F.max("finished").alias("finished"))


def retries(items: DataFrame, key: str, most: int, first_pause: float) -> DataFrame:
    """(key, attempts, state, waited): items with the failures before they succeed, tried up to ``most`` times.

    The pause doubles after each failure; there is none after the last attempt.
    """
    fails, done = F.col("failures"), F.col("failures") < most
    pauses = F.least(fails, F.lit(most - 1))
    return items.select(key, F.when(done, fails + 1).otherwise(most).cast("long").alias("attempts"), F.when(done, "done").otherwise("dead").alias("state"), (first_pause * (F.pow(F.lit(2.0), pauses) - 1)).alias("waited"))


def stream_of(like: DataFrame, spark: SparkSession, path: str) -> DataFrame:
    """A file or folder of Parquet as a stream with the schema of ``like``."""
    folder, _, name = path.rpartition("/")
    return spark.readStream.schema(like.schema).option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", True).parquet(f"{folder}/{name}")
