"""Queries over vectors. The query set is every vector whose id is divisible by 20."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import metrics as M
from ..operators import search as S
from ..session import table
from .registry import plan

_K = """q AS (SELECT vec_id AS qid, embedding::DOUBLE[] AS qv, label AS ql FROM embeddings WHERE vec_id % 20 = 0), c AS (SELECT vec_id AS vid, embedding::DOUBLE[] AS v, label FROM embeddings),
s AS (SELECT qid, vid, ql, label, list_dot_product(qv, v) / (sqrt(list_dot_product(qv, qv)) * sqrt(list_dot_product(v, v))) AS score FROM q JOIN c ON qid <> vid)"""


def _vectors(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    e = table(spark, sf_dir, "embeddings")
    return e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("qvec"), F.col("label").alias("query_label")), e.select(F.col("vec_id").alias("vid"), F.col("embedding").alias("vec"), "label")


def _top(spark: SparkSession, sf_dir: str, k: int, **how) -> DataFrame:
    q, c = _vectors(spark, sf_dir)
    return S.knn(q, c, k, **how)


@plan(f"WITH {_K} SELECT qid, vid, round(score, 6) AS score, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, vid) AS rank FROM s) WHERE rank <= 5")
def vec_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _top(spark, sf_dir, 5).select("qid", "vid", F.round("score", 6).alias("score"), "rank")


@plan(f"WITH {_K} SELECT qid, vid, round(score, 6) AS score, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, vid) AS rank FROM s) WHERE rank <= 5")
def vec_knn_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same five neighbours from an inverted file, whose lists are read as far as the triangle inequality asks."""
    from ..operators import vector_index as I

    q, c = _vectors(spark, sf_dir)
    centers = I.fit_centroids(c)
    hits, _ = I.search(I.build(c, centers), centers, q, 5)
    return hits.select("qid", "vid", F.round("score", 6).alias("score"), "rank")


@plan(f"WITH {_K} SELECT qid, vid, round(score, 6) AS score, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, vid) AS rank FROM s WHERE label IN (1, 2, 3) AND vid >= 50) WHERE rank <= 3")
def filt_vector_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    """k-NN behind a payload filter given as data (vec_by_quality, vec_by_wikidata, vec_no_disambig)."""
    f = S.PayloadFilter(any_of=(("label", (1, 2, 3)),), at_least=(("vid", 50),))
    return _top(spark, sf_dir, 3, filt=f).select("qid", "vid", F.round("score", 6).alias("score"), "rank")


@plan(f"WITH {_K} SELECT qid, least(count(*), 100) AS n FROM s WHERE score >= 0.1::DOUBLE GROUP BY qid")
def vec_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    q, c = _vectors(spark, sf_dir)
    return S.count_above(q, c, 0.1).select("qid", F.least("n", F.lit(100)).alias("n"))


@plan(f"""WITH {_K}, d AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, vid) AS r FROM s), h AS (SELECT qid, vid, least(1.0::DOUBLE, score + least(0.6::DOUBLE, 0.3::DOUBLE * ((ql = label)::INT + (vid % 10 = qid % 10)::INT))) AS score FROM d WHERE r <= 10)
SELECT qid, vid, round(score, 6) AS score, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, vid) AS rank FROM h) WHERE rank <= 5""")
def vec_hybrid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twice as many dense candidates as wanted, boosted by keyword hits (here: equal labels, equal last digits)."""
    q, c = _vectors(spark, sf_dir)
    d = S.knn(q, c, 10).join(c.select("vid", "label"), "vid").join(q.select("qid", "query_label"), "qid")
    d = d.withColumn("hits", (F.col("label") == F.col("query_label")).cast("int") + (F.col("vid") % 10 == F.col("qid") % 10).cast("int"))
    return S.hybrid(d, "hits", 5).select("qid", "vid", F.round("score", 6).alias("score"), "rank")


@plan(f"""WITH {_K}, r AS (SELECT *, ql = label AS rel, row_number() OVER (PARTITION BY qid ORDER BY score DESC, vid) AS rank, sum((ql = label)::INT) OVER (PARTITION BY qid) AS n FROM s), t AS (SELECT *, sum(rel::INT) OVER (PARTITION BY qid ORDER BY rank) AS hits FROM r WHERE rank <= 10 AND n > 0)
SELECT qid, round(sum(rel::INT) / max(n), 6) AS recall, round(sum(rel::INT) / 10.0::DOUBLE, 6) AS precision, max(rel::INT)::DOUBLE AS hit, round(coalesce(max(CASE WHEN rel THEN 1.0::DOUBLE / rank END), 0), 6) AS mrr,
    round(sum(rel::INT / log2(rank + 1)) / list_sum(list_transform(range(1, least(10, max(n))::INT + 1), lambda i: 1 / log2(i + 1))), 6) AS ndcg, round(sum(rel::INT * hits / rank) / least(10, max(n)), 6) AS ap FROM t GROUP BY qid""")
def win_ir_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    q, c = _vectors(spark, sf_dir)
    top = S.knn(q, c, 10).join(c.select("vid", "label"), "vid").join(q.select("qid", "query_label"), "qid")
    sizes = c.groupBy(F.col("label").alias("query_label")).agg((F.count("*") - 1).alias("n_relevant"))
    ranked = top.join(sizes, "query_label").withColumn("relevant", F.col("label") == F.col("query_label"))
    return M.retrieval_at_k(ranked, ["qid"], 10).select("qid", *[F.round(x, 6).alias(x) for x in ("recall", "precision")], "hit", *[F.round(x, 6).alias(x) for x in ("mrr", "ndcg", "ap")])


@plan(f"""WITH {_K}, t AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, vid) AS rank FROM s) SELECT qid, CASE WHEN max(score) >= 0.7::DOUBLE THEN 'SUPPORTED' WHEN max(score) >= 0.49::DOUBLE THEN 'PARTIAL' ELSE 'REFUTED' END AS verdict, string_agg(vid::VARCHAR, ',' ORDER BY rank) AS evidence FROM t WHERE rank <= 3 GROUP BY qid""")
def vec_rag_verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best score against thresholds (fn_verdict_bucket), the first three as evidence."""
    t = _top(spark, sf_dir, 3).groupBy("qid").agg(F.max("score").alias("s"), F.sort_array(F.collect_list(F.struct("rank", "vid"))).alias("e"))
    v = F.when(F.col("s") >= 0.7, "SUPPORTED").when(F.col("s") >= 0.49, "PARTIAL").otherwise("REFUTED")
    return t.select("qid", v.alias("verdict"), F.array_join(F.transform("e", lambda x: x["vid"].cast("string")), ",").alias("evidence"))


@plan(f"""WITH {_K}, t AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, vid) AS rank FROM s), c2 AS (SELECT qid, vid, rank, 1 - (vid % 97) / 97.0::DOUBLE AS rr FROM t WHERE rank <= 40), r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY rr DESC, rank) AS place FROM c2)
SELECT qid, vid, round(rr, 6) AS score, place::INT AS place FROM r WHERE place <= 12""")
def topk_rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forty candidates, a rerank score per row (a column), twelve stay (vec_rerank_apply, late materialization)."""
    from pyspark.sql.window import Window

    c = _top(spark, sf_dir, 40).withColumn("rr", 1 - (F.col("vid") % 97) / 97.0)
    c = c.withColumn("place", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("rr"), "rank"))).where("place <= 12")
    return c.select("qid", "vid", F.round("rr", 6).alias("score"), "place")
