"""Structured Streaming forms of the stateful operators: windows with watermarks, token buckets, idempotent batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import IntegerType, StructField, StructType

from ..operators.corpus import cut_vocabulary
from ..session import materialize, shared_path


def window_counts(events: DataFrame, key: str, ts: str, width: str = "60 seconds", late: str | None = None, limit: int = 20) -> DataFrame:
    """Requests per key and fixed window, and whether the window went over its limit; state expires one window late."""
    counts = events.withWatermark(ts, late or width).groupBy(F.window(ts, width), key).agg(F.count("*").alias("n"))
    return counts.select(key, F.col("window.start").alias("start"), "n", (F.col("n") > limit).alias("over"))


def token_bucket(events: DataFrame, key: str, ts: str, rate: float, burst: float, forget: bool = True) -> DataFrame:
    """(key, event_id, allowed) by a bucket per key that refills with ``rate`` per second up to ``burst``.

    ``events`` has key, event_id and ts; within a batch a key's events are taken in (ts, event_id) order. A key that
    stays away longer than its bucket needs to fill loses its state, which is the same as a full bucket; a run over
    what is there (availableNow) must not ``forget``, as it would wait for the time-outs.
    """

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        level, last = state.get if state.exists else (burst, None)
        pdf = pd.concat(list(batches)).sort_values([ts, "event_id"])
        out = []
        for t in pdf[ts]:
            now = t.timestamp()
            if last is not None:
                level = min(burst, level + max(0.0, now - last) * rate)
            last = now if last is None else max(last, now)
            out.append(level >= 1)
            level -= level >= 1
        state.update((float(level), float(last)))
        if forget:
            state.setTimeoutDuration(int(1000 * burst / rate) + 1000)
        yield pd.DataFrame({key: k[0], "event_id": pdf["event_id"].to_numpy(), "allowed": out})

    schema = f"{key} long, event_id long, allowed boolean"
    return events.groupBy(key).applyInPandasWithState(step, schema, "level double, last double", "append", GroupStateTimeout.ProcessingTimeTimeout if forget else GroupStateTimeout.NoTimeout)


def job_states(events: DataFrame, job: str, ts: str, terminal: tuple[str, ...] = ("done", "error")) -> DataFrame:
    """(job, status, phase, completed_at) after each batch: terminal jobs stay as they are, later values fill gaps."""

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        status, phase, completed = state.get if state.exists else (None, None, None)
        for row in pd.concat(list(batches)).sort_values(ts).itertuples(index=False):
            if status in terminal:
                break
            status, phase = row.status, row.phase if row.phase is not None else phase
            if status in terminal and completed is None:
                completed = getattr(row, ts).timestamp()
        state.update((status, phase, completed))
        yield pd.DataFrame({job: [k[0]], "status": [status], "phase": [phase], "completed_at": [completed]})

    return events.groupBy(job).applyInPandasWithState(step, f"{job} string, status string, phase string, completed_at double", "status string, phase string, completed_at double", "update", GroupStateTimeout.NoTimeout)


def first_deliveries(messages: DataFrame, ts: str, keys: list[str], late: str = "1 hour") -> DataFrame:
    """Each (run, batch) once, redeliveries within the watermark dropped."""
    return messages.withWatermark(ts, late).dropDuplicatesWithinWatermark(keys)


def ttl_cache(requests: DataFrame, scope: str, key: str, at: str, ttl: int, most: int = 1000) -> DataFrame:
    """(scope, event_id, hit, size): each request against its scope's cache, which it fills when it misses.

    ``requests`` has scope (long), event_id, key (string) and ``at``, whole microseconds. An entry serves until its
    request's time plus ``ttl``; one that is found too old is taken out and counts as a miss. A full cache gives up
    the entry that was put in first, however often it was read. The state of a scope is its entries, at most ``most``,
    in the order in which they came; within a batch a scope's requests are taken in (at, event_id) order, so the size of a
    trigger bounds what a task sorts.
    """

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        keys, until = state.get if state.exists else ((), ())
        entries = dict(zip(keys, until, strict=True))
        pdf = pd.concat(list(batches)).sort_values([at, "event_id"])
        hits, sizes = [], []
        for name, now in zip(pdf[key], pdf[at], strict=True):
            hits.append(entries.get(name, now - 1) >= now)
            if not hits[-1]:
                entries.pop(name, None)
                if len(entries) >= most:
                    del entries[next(iter(entries))]
                entries[name] = int(now) + ttl
            sizes.append(len(entries))
        state.update((list(entries), [int(u) for u in entries.values()]))
        yield pd.DataFrame({scope: k[0], "event_id": pdf["event_id"].to_numpy(), "hit": hits, "size": sizes})

    schema = f"{scope} long, event_id long, hit boolean, size long"
    return requests.groupBy(scope).applyInPandasWithState(step, schema, "keys array<string>, until array<long>", "append", GroupStateTimeout.NoTimeout)


def run_totals(deliveries: DataFrame, totals: DataFrame) -> DataFrame:
    """(run, batches_completed, total_seen, total_errors, status) from first deliveries and the runs' sizes.

    ``deliveries`` (run, batch, seen, failure): one row per finished batch (failure null) and one per failed attempt. A run is complete
    when all of its ``batches_total`` are; more never count.
    """
    good = F.col("failure").isNull()
    d = deliveries.groupBy("run").agg(F.count_if(good).alias("n"), F.coalesce(F.sum(F.when(good, F.col("seen"))), F.lit(0)).alias("total_seen"), F.count_if(~good).alias("total_errors"))
    rows = totals.join(d, "run", "left").fillna(0, ["n", "total_seen", "total_errors"])
    done = (F.col("batches_total") > 0) & (F.col("n") >= F.col("batches_total"))
    counted = F.when(F.col("batches_total") > 0, F.least("n", "batches_total")).otherwise(F.col("n"))
    return rows.select("run", counted.alias("batches_completed"), "total_seen", "total_errors", F.when(done, "complete").otherwise("running").alias("status"))


def batch_idf(batch: DataFrame, number: int, path: str, key: str, size: int) -> None:
    """A foreachBatch sink that keeps idf scores by batches: version ``number`` of the vocabulary from the one before.

    ``batch`` (key, token, one row for each token and text). A token's score comes from the last batch that holds it: its texts there,
    and all texts up to then. A vocabulary of more than 1.5 times ``size`` is cut to the ``size`` highest scores (by token where they
    are equal). A version is written whole, so a repeated batch changes nothing.
    """
    spark = batch.sparkSession
    rows = materialize(batch.select(key, "token").distinct(), "tokens")
    own = rows.select(key).distinct().count()
    last = spark.read.parquet(f"{path}/version={number - 1}") if number else None
    before = 0 if last is None else last.agg(F.max("texts")).first()[0] or 0
    df = rows.where("token IS NOT NULL").groupBy("token").agg(F.count("*").alias("df"))
    score = F.greatest(F.log((before + own - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1), F.lit(0.0))
    new = df.select("token", "df", score.alias("idf"))
    if last is not None:
        new = new.unionByName(last.select("token", "df", "idf").where("token IS NOT NULL").join(df, "token", "left_anti"))
    new = cut_vocabulary(materialize(new, "vocabulary"), size)
    marker = spark.createDataFrame([(None, 0, 0.0)], "token string, df long, idf double")  # keeps the count where no token is left
    new.unionByName(marker).withColumn("texts", F.lit(before + own)).write.mode("overwrite").parquet(f"{path}/version={number}")


def replayed(rows: DataFrame, pieces: list[Column], name: str, query: Callable[[DataFrame], DataFrame], mode: str) -> DataFrame:
    """What a streaming query gives for rows that arrive in pieces, with ``piece``, the number of the run that gave it.

    Each piece (a condition) is put into the folder that the stream reads; then the query starts from its checkpoint, works
    on what is new and stops. A batch's rows go to a folder of their own, which a repeated batch overwrites.
    """
    spark = rows.sparkSession
    source, out, marks = (shared_path(spark, f"{name}-{part}") for part in ("source", "out", "marks"))
    schema = None
    for i, piece in enumerate(pieces):
        rows.where(piece).write.parquet(f"{source}/piece={i}")
        stream = query(spark.readStream.schema(rows.schema).option("recursiveFileLookup", True).parquet(source))
        schema = stream.schema

        def write(batch: DataFrame, number: int, i: int = i) -> None:
            batch.write.mode("overwrite").parquet(f"{out}/piece={i}/batch={number}")

        stream.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", marks).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(StructType([*schema.fields, StructField("piece", IntegerType())])).option("basePath", out).parquet(f"{out}/piece=*")


def split_bad(valid: str, good_path: str, bad_path: str) -> Callable[[DataFrame, int], None]:
    """A foreachBatch sink: rows that meet ``valid`` to one table, all others to the rejected ones.

    Files go to a folder per batch id, which a repeated batch overwrites, so each row is written once.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.where(valid).write.mode("overwrite").parquet(f"{good_path}/batch={batch_id}")
        batch.where(f"NOT coalesce({valid}, false)").write.mode("overwrite").parquet(f"{bad_path}/batch={batch_id}")

    return write
