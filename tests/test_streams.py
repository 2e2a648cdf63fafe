"""Streams that stop and go on, against plain replays."""

import random

from pyspark.sql import functions as F

from veristrata.streaming import limits


def plain_cache(rows, ttl, most):
    caches, out = {}, {}
    for scope, event, key, at in sorted(rows, key=lambda r: (r[0], r[3], r[1])):
        entries = caches.setdefault(scope, {})
        hit = key in entries and at <= entries[key]
        if not hit:
            entries.pop(key, None)
            if len(entries) >= most:
                entries.pop(next(iter(entries)))
            entries[key] = at + ttl
        out[event] = (hit, len(entries))
    return out


def test_cache_gives_up_what_came_first(spark):
    """A thousand entries, more keys than that, a hot scope, repeated and null keys, and a stop after each piece."""
    rng = random.Random(5)
    rows = [(1, i, f"k{rng.randint(0, 1300)}", 10 * i) for i in range(3000)] + [(2, 3000 + i, rng.choice(["a", "b", None]), 7 * i) for i in range(60)] + [(3, 4000, "x", 5), (3, 4001, "x", 5)]
    for ttl, most in ((9_000, 1000), (40, 2)):
        frame = spark.createDataFrame(rows, "scope long, event_id long, key string, at long").repartition(4)
        pieces = [F.col("event_id") < 1000, (F.col("event_id") >= 1000) & (F.col("event_id") < 3020), F.col("event_id") >= 3020]
        got = limits.replayed(frame, pieces, "cache", lambda s, ttl=ttl, most=most: limits.ttl_cache(s, "scope", "key", "at", ttl, most), "append")
        assert {r["event_id"]: (r["hit"], r["size"]) for r in got.collect()} == plain_cache(rows, ttl, most)


def test_states_go_on_after_a_stop(spark):
    """Jobs that end in the first piece stay as they are, whatever comes later."""
    rows = [("a", 1, "running", "p1"), ("a", 5, "done", None), ("b", 2, "running", None), ("a", 9, "error", "late"), ("b", 8, "running", "p2"), ("c", 9, "error", None)]
    frame = spark.createDataFrame([(j, t, s, p) for j, t, s, p in rows], "job string, t int, status string, phase string").withColumn("ts", F.timestamp_seconds("t"))
    states = limits.replayed(frame, [F.col("t") < 6, F.col("t") >= 6], "jobs", lambda s: limits.job_states(s, "job", "ts"), "update")
    last = {r["job"]: tuple(r["s"]) for r in states.groupBy("job").agg(F.max_by(F.struct("status", "phase", "completed_at"), "piece").alias("s")).collect()}
    assert last == {"a": ("done", "p1", 5.0), "b": ("running", "p2", None), "c": ("error", None, 9.0)}
    assert {r["piece"] for r in states.collect()} == {0, 1}


def test_runs_complete_at_their_total(spark):
    d = spark.createDataFrame([(1, b, 2, None) for b in range(4)] + [(1, 1, 2, 77), (2, 0, 5, None), (3, 0, 1, None)], "run long, batch long, seen long, failure long")
    totals = spark.createDataFrame([(1, 3), (2, 2), (3, 0), (4, 1)], "run long, batches_total long")
    got = {r["run"]: tuple(r)[1:] for r in limits.run_totals(d, totals).collect()}
    assert got == {1: (3, 8, 1, "complete"), 2: (1, 5, 0, "running"), 3: (1, 1, 0, "running"), 4: (0, 0, 0, "running")}


def test_sliding_windows_over_stretches(spark, monkeypatch):
    """A key that holds most rows, null keys, ties of time, and stretches shorter than a window's reach allows for."""
    from pyspark.sql.window import Window

    from veristrata.operators import metrics

    rng = random.Random(9)
    rows = [(i, rng.choice(["hot"] * 8 + ["cold", None]), rng.randint(0, 50), rng.randint(-5, 5)) for i in range(500)]
    frame = spark.createDataFrame(rows, "id long, key string, at long, value long").repartition(5)
    order, values = [F.col("at"), F.col("id")], {"total": F.sum("value"), "n": F.count("*"), "worst": F.max("value")}
    w = Window.partitionBy("key").orderBy(*order).rowsBetween(-6, 0)
    wanted = sorted(tuple(r) for r in frame.select("id", *[v.over(w).alias(n) for n, v in values.items()]).collect())
    for stretch in (7, 13, 100_000):
        monkeypatch.setattr(metrics, "STRETCH", stretch)
        got = metrics.sliding(frame, ["key"], order, 7, values)
        assert sorted(tuple(r) for r in got.select("id", *values).collect()) == wanted
