"""Queries over the event table: limits, windows, states, batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import graph as G
from ..operators import metrics as M
from ..session import numbered, table
from .registry import plan


@plan("""SELECT event_id, row_number() OVER (PARTITION BY user_id, floor(epoch(ts) / 3600) ORDER BY ts, event_id) <= 3 AS allowed FROM events""")
def st_fixed_window_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fixed windows: a key's first requests of each hour pass (st_cooldown differs in key and width only)."""
    e = table(spark, sf_dir, "events").withColumn("slot", F.floor(F.unix_micros(F.to_timestamp("ts")) / 3_600_000_000))
    w = Window.partitionBy("user_id", "slot").orderBy("ts", "event_id")
    return e.select("event_id", (F.row_number().over(w) <= 3).alias("allowed"))


@plan("""SELECT event_id, round(sum(value) OVER (PARTITION BY event_type ORDER BY ts, event_id ROWS BETWEEN 99 PRECEDING AND CURRENT ROW), 2) AS total, count(*) OVER (PARTITION BY event_type ORDER BY ts, event_id ROWS BETWEEN 99 PRECEDING AND CURRENT ROW) AS n, max(value) OVER (PARTITION BY event_type ORDER BY ts, event_id ROWS BETWEEN 99 PRECEDING AND CURRENT ROW) AS worst FROM events""")
def st_sliding_latency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sum, number and worst of each kind's last 100 samples; their quotient is the sliding mean."""
    e = table(spark, sf_dir, "events").select("event_id", "event_type", "ts", "value")
    out = M.sliding(e, ["event_type"], [F.col("ts"), F.col("event_id")], 100, {"total": F.sum("value"), "n": F.count("*"), "worst": F.max("value")})
    return out.select("event_id", F.round("total", 2).alias("total"), "n", "worst")


@plan("""SELECT floor(epoch(ts) / 60)::BIGINT AS minute, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL""")
def st_tumbling_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters per minute (st_live_log's rates); streaming.windows has the watermark form."""
    e = table(spark, sf_dir, "events").withColumn("minute", F.floor(F.unix_micros(F.to_timestamp("ts")) / 60_000_000))
    return e.groupBy("minute", "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


@plan("""WITH t AS (SELECT user_id, event_id, ts, event_type, event_type IN ('purchase', 'error') AS final FROM events), f AS (SELECT user_id, min(CASE WHEN final THEN (ts, event_id) END) AS stop FROM t GROUP BY user_id),
kept AS (SELECT t.*, (ts, t.event_id) AS pos FROM t JOIN f USING (user_id) WHERE stop IS NULL OR (ts, t.event_id) <= stop)
SELECT user_id, arg_max(event_type, pos) AS status, count(*) AS steps, max(CASE WHEN final THEN event_id END) AS done_by FROM kept GROUP BY user_id""")
def st_job_machine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A job's events folded: nothing changes after the first terminal event."""
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "ts", "event_type", F.col("event_type").isin("purchase", "error").alias("final")).withColumn("at", F.struct("ts", "event_id"))
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    kept = e.withColumn("ended", F.coalesce(F.max("final").over(w), F.lit(False))).where("NOT ended")
    return kept.groupBy("user_id").agg(F.max_by("event_type", "at").alias("status"), F.count("*").alias("steps"), F.max(F.when(F.col("final"), F.col("event_id"))).alias("done_by"))


@plan("""SELECT user_id, event_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k = 1""")
def agg_last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.last_event(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"]).select("user_id", "event_id", "event_type", "value")


@plan("""WITH b AS (SELECT user_id AS run, event_id // 10 AS batch, event_type FROM events) SELECT run, count(DISTINCT batch) AS batches, count(*) AS attempts, count(*) FILTER (event_type = 'error') AS failures FROM b GROUP BY run""")
def st_batch_idempotent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each (run, batch) counts once, its attempts are kept."""
    b = table(spark, sf_dir, "events").select(F.col("user_id").alias("run"), F.floor(F.col("event_id") / 10).alias("batch"), "event_type")
    return b.groupBy("run").agg(F.count_distinct("batch").alias("batches"), F.count("*").alias("attempts"), F.count_if(F.col("event_type") == "error").alias("failures"))


@plan("""SELECT event_id, (row_number() OVER (ORDER BY event_id) - 1) // 25 AS batch FROM (SELECT * FROM events WHERE event_type = 'signup')""")
def fn_batching(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows dealt into batches of 25 in id order: places from range-sorted partitions, no window over all rows."""
    rows = numbered(table(spark, sf_dir, "events").where("event_type = 'signup'").select("event_id"), "event_id")
    return rows.select("event_id", F.floor(F.col("place") / 25).alias("batch"))


@plan("""SELECT user_id, event_id FROM (SELECT *, max(ts) OVER () AS now FROM events) WHERE ts > now - INTERVAL 1 DAY""")
def st_trace_ttl(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Traces younger than the time to live, as of the last event."""
    e = table(spark, sf_dir, "events")
    now = e.agg(F.max("ts").alias("now")).first()["now"]
    return e.where(F.col("ts") > F.lit(now) - F.expr("INTERVAL 1 DAY")).select("user_id", "event_id")


_TTL, _ENTRIES = 3 * 86_400 * 1_000_000, 5


def _pieces(e: DataFrame, n: int) -> list[Column]:
    """Conditions that part the events into ``n`` stretches of their order."""
    last = e.agg(F.max("event_id").alias("last")).first()["last"] or 0
    return [(F.col("event_id") >= i * (last + 1) // n) & (F.col("event_id") < (i + 1) * (last + 1) // n) for i in range(n)]


@plan(f"""WITH RECURSIVE e AS (SELECT user_id, event_id, epoch_us(ts) AS t, (json_extract(props, '$.k')::BIGINT % 10)::VARCHAR AS key, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
r AS (SELECT user_id, 0::BIGINT AS i, NULL::BIGINT AS event_id, false AS hit, []::STRUCT(k VARCHAR, u BIGINT)[] AS c FROM e WHERE i = 1
    UNION ALL SELECT user_id, i, event_id, hit, CASE WHEN hit THEN c ELSE list_append(CASE WHEN len(other) >= {_ENTRIES} THEN other[2:] ELSE other END, {{'k': key, 'u': t + {_TTL}}}) END FROM (
        SELECT e.user_id, e.i, e.event_id, e.key, e.t, c, len(list_filter(c, lambda x: x.k = e.key AND x.u >= e.t)) > 0 AS hit, list_filter(c, lambda x: x.k <> e.key) AS other FROM r JOIN e ON e.user_id = r.user_id AND e.i = r.i + 1))
SELECT event_id, hit, len(c)::BIGINT AS size FROM r WHERE i > 0""")
def st_ttl_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every request against its user's cache of five entries and three days; the stream stops twice and goes on."""
    from ..streaming.limits import replayed, ttl_cache

    e = table(spark, sf_dir, "events")
    requests = e.select("user_id", "event_id", (F.get_json_object("props", "$.k").cast("long") % 10).cast("string").alias("key"), F.unix_micros(F.to_timestamp("ts")).alias("at"))
    return replayed(requests, _pieces(e, 3), "cache", lambda s: ttl_cache(s, "user_id", "key", "at", _TTL, _ENTRIES), "append").select("event_id", "hit", "size")


@plan("""WITH t AS (SELECT *, event_type IN ('purchase', 'error') AS final, CASE WHEN event_type <> 'view' THEN json_extract_string(props, '$.k') END AS phase FROM events),
f AS (SELECT user_id, min(CASE WHEN final THEN (ts, event_id) END) AS stop FROM t GROUP BY user_id), kept AS (SELECT t.*, (ts, t.event_id) AS pos FROM t JOIN f USING (user_id) WHERE stop IS NULL OR (ts, t.event_id) <= stop)
SELECT user_id::VARCHAR AS job, arg_max(event_type, pos) AS status, arg_max(phase, pos) FILTER (phase IS NOT NULL) AS phase, round(max(CASE WHEN final THEN epoch(ts) END), 3) AS completed_at FROM kept GROUP BY user_id""")
def st_job_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Job states as a stream that stops twice and goes on from its checkpoint: the last state of each job."""
    from ..streaming.limits import job_states, replayed

    e = table(spark, sf_dir, "events")
    phase = F.when(F.col("event_type") != "view", F.get_json_object("props", "$.k"))
    jobs = e.select("event_id", F.col("user_id").cast("string").alias("job"), F.to_timestamp("ts").alias("ts"), F.col("event_type").alias("status"), phase.alias("phase"))
    states = replayed(jobs, _pieces(e, 3), "jobs", lambda s: job_states(s, "job", "ts", ("purchase", "error")), "update")
    last = states.groupBy("job").agg(F.max_by(F.struct("status", "phase", "completed_at"), "piece").alias("s"))
    return last.select("job", "s.status", "s.phase", F.round("s.completed_at", 3).alias("completed_at"))


@plan("""WITH b AS (SELECT user_id AS run, event_id // 10 AS batch, event_type = 'error' AS failed FROM events), t AS (SELECT run, count(DISTINCT batch) + run % 2 AS total FROM b GROUP BY run),
d AS (SELECT run, count(*) AS n, sum(batch % 7)::BIGINT AS seen FROM (SELECT DISTINCT run, batch FROM b WHERE NOT failed) GROUP BY run), x AS (SELECT run, count(*) FILTER (failed) AS errors FROM b GROUP BY run)
SELECT run, least(coalesce(n, 0), total) AS batches_completed, coalesce(seen, 0) AS total_seen, errors AS total_errors, CASE WHEN coalesce(n, 0) >= total THEN 'complete' ELSE 'running' END AS status FROM t JOIN x USING (run) LEFT JOIN d USING (run)""")
def st_batch_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals of runs from a stream of deliveries, a third of which comes twice; a run completes at its total.

    A finished batch counts once, a failed attempt once however often it is delivered.
    """
    from ..streaming.limits import replayed, run_totals

    e = table(spark, sf_dir, "events")
    batch = F.floor(F.col("event_id") / 10)
    messages = e.select("event_id", F.col("user_id").alias("run"), batch.alias("batch"), (batch % 7).alias("seen"), F.when(F.col("event_type") == "error", F.col("event_id")).alias("failure"))
    first, again, rest = _pieces(e, 3)
    deliveries = replayed(messages, [first | again, again | rest], "deliveries", lambda s: s.select("run", "batch", "seen", "failure").dropDuplicates(["run", "batch", "failure"]), "append")
    totals = messages.groupBy("run").agg((F.count_distinct("batch") + F.first("run") % 2).alias("batches_total"))
    return run_totals(deliveries, totals)


@plan("""SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events""")
def src_json_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Open JSON as a variant, a field by path (proj_wikidata's way)."""
    e = table(spark, sf_dir, "events")
    return e.select("event_id", F.try_variant_get(F.try_parse_json("props"), "$.k", "bigint").alias("k"))
