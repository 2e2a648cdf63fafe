"""Queries over sinks and states: each writes its table in the sink's way and gives back what it holds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import sinks as K
from ..session import dealt, shared_path, table
from .registry import plan


@plan("SELECT 'Q' || c_custkey AS qid, c_name AS label, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) AS n_links FROM customer UNION ALL SELECT 'Q-' || n_nationkey, n_name, 0 FROM nation")
def sink_graph_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities written twice: the second write wins where it has a value, the first fills its gaps."""
    c = table(spark, sf_dir, "customer")
    n = table(spark, sf_dir, "nation").select(F.concat(F.lit("Q-"), F.col("n_nationkey").cast("string")).alias("qid"), F.col("n_name").alias("label"), F.lit(0).cast("long").alias("n_links"))
    links = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n_links"))
    first = c.select(F.concat(F.lit("Q"), F.col("c_custkey").cast("string")).alias("qid"), F.col("c_name").alias("label"), F.lit(0).cast("long").alias("n_links")).union(n)
    later = links.select(F.concat(F.lit("Q"), F.col("c_custkey").cast("string")).alias("qid"), F.lit(None).cast("string").alias("label"), "n_links")
    path = shared_path(spark, "entities")
    for version, rows in enumerate((first, later)):
        K.upsert(path, rows, ["qid"], version)
    return K.merged(spark, path, ["qid"]).select("qid", "label", "n_links")


@plan("SELECT substring(sha256('Q' || doc_id || '::lead::0::0'), 1, 40) AS passage_id, length(text)::BIGINT AS n_chars, md5(text) AS digest FROM documents")
def sink_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages by deterministic id: a second run over the same texts leaves one row each."""
    d = table(spark, sf_dir, "documents").select(T.passage_id(F.concat(F.lit("Q"), F.col("doc_id").cast("string")), F.lit("lead"), F.lit(0), F.lit(0)).alias("passage_id"), F.length("text").cast("long").alias("n_chars"), F.md5(F.col("text").cast("binary")).alias("digest"))
    path = shared_path(spark, "passages")
    for version in range(2):
        K.upsert(path, d, ["passage_id"], version)
    return K.merged(spark, path, ["passage_id"]).select("passage_id", "n_chars", "digest")


@plan("SELECT vec_id, label, length(embedding)::BIGINT AS dims, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE)), 4) AS square FROM embeddings")
def sink_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors with their payload, by id (sink_points_legacy); arrays come back as they went in."""
    e = table(spark, sf_dir, "embeddings")
    path = shared_path(spark, "vectors")
    K.upsert(path, e, ["vec_id"], 0)
    square = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    return K.merged(spark, path, ["vec_id"]).select("vec_id", "label", F.size("embedding").cast("long").alias("dims"), F.round(square, 4).alias("square"))


_WORDS = r"list_distinct(list_filter(regexp_split_to_array(lower(text), '[^a-z]+'), lambda w: w <> ''))"


@plan(f"SELECT doc_id, source, len(links) AS n_links, md5(array_to_string(links, ',')) AS links, len(categories) AS n_categories, md5(array_to_string(categories, ',')) AS categories FROM (SELECT doc_id, source, list_sort({_WORDS})[1:200] AS links, list_sort(list_filter({_WORDS}, lambda w: length(w) > 6))[1:50] AS categories FROM documents)")
def sink_article_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Article rows in folders by source, with their lists as sorted sets cut to their longest length; a read of one source prunes
    the others (sink_corpus_worker)."""
    from ..operators.knowledge import article_row

    path = shared_path(spark, "articles")
    words = F.filter(F.split(F.lower("text"), "[^a-z]+"), lambda w: w != "")
    rows = table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("part"), words.alias("links"), F.filter(words, lambda w: F.length(w) > 6).alias("categories"))
    article_row(rows).write.partitionBy("part").parquet(path)
    told = lambda c: F.md5(F.array_join(c, ",").cast("binary"))
    size = lambda c: F.size(c).cast("long")
    return spark.read.parquet(path).select("doc_id", F.col("part").alias("source"), size("links").alias("n_links"), told("links").alias("links"), size("categories").alias("n_categories"), told("categories").alias("categories"))


@plan("SELECT conv_id, count(*) AS turns, md5(string_agg(role, ',' ORDER BY turn)) AS roles FROM conversations GROUP BY 1")
def sink_jsonl_atomic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON lines that appear as a whole: written beside, then moved; a second write replaces the first."""
    path = shared_path(spark, "jsonl")
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role")
    for _ in range(2):
        K.write_whole(c, path, "json")
    rows = spark.read.schema("conv_id long, turn long, role string").json(path)
    g = rows.groupBy("conv_id").agg(F.count("*").alias("turns"), F.sort_array(F.collect_list(F.struct("turn", "role"))).alias("r"))
    return g.select("conv_id", "turns", F.md5(F.array_join(F.transform("r", lambda x: x["role"]), ",").cast("binary")).alias("roles"))


@plan("SELECT event_type || ',' || count(*) || ',' || CAST(round(avg(value), 2) AS DECIMAL(18, 2)) AS line FROM events GROUP BY event_type UNION ALL SELECT 'kind,n,mean'")
def sink_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A report as CSV lines with a header; one row per kind."""
    r = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("kind")).agg(F.count("*").alias("n"), F.round(F.avg("value"), 2).cast("decimal(18,2)").alias("mean"))
    path = shared_path(spark, "report")
    r.coalesce(1).write.option("header", True).csv(path)  # as many rows as kinds
    return spark.read.text(path).select(F.col("value").alias("line"))


@plan("""SELECT doc_id, coalesce(source, '') AS claim_id, CASE doc_id % 3 WHEN 0 THEN '' ELSE lang END AS label, coalesce(length(r), 0) AS n_chars, md5(coalesce(r, 'none')) AS rationale, batch::INT AS batch FROM (SELECT *, CASE WHEN doc_id % 5 <> 0 THEN substring(text, 1, 2000) END AS r, doc_id % 2 AS batch FROM documents)""")
def sink_feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feedback appended batch by batch, a repeated batch once; missing fields are empty, long reasons are cut."""
    path = shared_path(spark, "feedback")
    d = table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("claim_id"), F.when(F.col("doc_id") % 3 != 0, F.col("lang")).alias("label"), F.when(F.col("doc_id") % 5 != 0, F.col("text")).alias("rationale"))
    for batch in (0, 1, 1):
        K.append_feedback(d.where(F.col("doc_id") % 2 == batch), path, batch)
    f = spark.read.parquet(path)
    return f.select("doc_id", "claim_id", "label", F.coalesce(F.length("rationale"), F.lit(0)).cast("long").alias("n_chars"), F.md5(F.coalesce("rationale", F.lit("none")).cast("binary")).alias("rationale"), "batch")


@plan("SELECT user_id AS run, max(event_id) AS position, count(*) AS done, max(CASE WHEN event_type = 'purchase' THEN event_id END) IS NOT NULL AS finished FROM events GROUP BY 1")
def st_checkpoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Progress of runs: positions only move forward, however batches are repeated or reordered."""
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("run"), F.col("event_id").alias("position"), F.lit(1).cast("long").alias("done"), (F.col("event_type") == "purchase").alias("finished"))
    path = shared_path(spark, "progress")
    for batch in (1, 0, 1):  # a batch that comes twice overwrites itself
        K.write_batch(e.where(F.col("position") % 2 == batch), path, batch)
    return K.progress(spark, path)


@plan("SELECT event_id, CASE WHEN event_id % 5 < 3 THEN event_id % 5 + 1 ELSE 3 END AS attempts, CASE WHEN event_id % 5 < 3 THEN 'done' ELSE 'dead' END AS state, round(CASE LEAST(event_id % 5, 3) WHEN 0 THEN 0 WHEN 1 THEN 1 ELSE 3 END, 3)::DOUBLE AS waited FROM events")
def st_retry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attempts with doubling pauses: an item that needs more than three goes to the dead letters (st_dlq)."""
    return K.retries(table(spark, sf_dir, "events").select("event_id", (F.col("event_id") % 5).cast("int").alias("failures")), "event_id", most=3, first_pause=1.0)


@plan("SELECT CASE WHEN value > 50 THEN 'good' ELSE 'bad' END AS kind, count(*) AS n FROM events GROUP BY 1")
def st_dlq(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stream of the whole table split into good rows and rejected ones, each batch written once."""
    from ..streaming.limits import split_bad

    good, bad, marks = (shared_path(spark, n) for n in ("good", "bad", "marks"))
    stream = K.stream_of(table(spark, sf_dir, "events"), spark, f"{sf_dir}/events.parquet")
    stream.writeStream.foreachBatch(split_bad("value > 50", good, bad)).option("checkpointLocation", marks).trigger(availableNow=True).start().awaitTermination()
    count = lambda p, kind: spark.read.parquet(p).agg(F.lit(kind).alias("kind"), F.count("*").alias("n"))
    return count(good, "good").union(count(bad, "bad"))


@plan("""WITH RECURSIVE e AS (SELECT user_id, event_id, epoch(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
r AS (SELECT user_id, 0::BIGINT AS i, NULL::BIGINT AS event_id, NULL::DOUBLE AS t, false AS allowed, 5.0::DOUBLE AS level FROM e WHERE i = 1
    UNION ALL SELECT user_id, i, event_id, t, now >= 1, now - (now >= 1)::INT FROM (SELECT e.user_id, e.i, e.event_id, e.t, least(5.0::DOUBLE, level + coalesce(greatest(0.0::DOUBLE, e.t - r.t), 0) * (1.0::DOUBLE / 86400)) AS now FROM r JOIN e ON e.user_id = r.user_id AND e.i = r.i + 1))
SELECT event_id, allowed FROM r WHERE i > 0""")
def st_token_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stream through token buckets of five that get one token a day: every request, passed or not."""
    from ..streaming.limits import token_bucket

    out, marks = shared_path(spark, "allowed"), shared_path(spark, "marks")
    stream = K.stream_of(table(spark, sf_dir, "events"), spark, f"{sf_dir}/events.parquet").select("user_id", "event_id", F.to_timestamp("ts").alias("ts"))
    token_bucket(stream, "user_id", "ts", 1 / 86_400, 5.0, forget=False).writeStream.format("parquet").option("path", out).option("checkpointLocation", marks).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out).select("event_id", "allowed")


@plan(r"""WITH w AS (SELECT DISTINCT item_id, lower(w) AS word FROM (SELECT item_id, unnest(list_filter(regexp_split_to_array(text, '[ \t\n\r\f\v]+'), lambda x: x <> '')[1:5]) AS w FROM benchmark) WHERE length(w) > 3),
m AS (SELECT DISTINCT item_id, doc_id, (doc_id * 37 % 1000) / 1000.0::DOUBLE AS similarity FROM w JOIN documents ON contains(lower(text), word))
SELECT item_id, doc_id, similarity, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY similarity DESC, doc_id) AS rank FROM m) WHERE rank <= 5""")
def filt_persisted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence that was persisted before: texts that contain one of a claim's first long words, by stored similarity."""
    from ..operators.terms import best_with_words

    claims = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("query"))
    texts = dealt(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("tid"), "text", (F.col("doc_id") * 37 % 1000 / 1000).alias("similarity")))
    return best_with_words(claims, texts).select(F.col("qid").alias("item_id"), F.col("tid").alias("doc_id"), "similarity", "rank")
