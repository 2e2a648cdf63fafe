"""Queries over predictions, scores and latencies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import metrics as M
from ..operators import reports as R
from ..session import table
from .registry import plan

PRED = """pred AS (SELECT doc_id, source AS evaluator, lang AS domain, quality = 1 AS truth, (n_chars % 1000) / 1000.0::DOUBLE AS p, (n_chars % 1000) >= 500 AS predicted,
    greatest((n_chars % 1000) / 1000.0::DOUBLE, 1 - (n_chars % 1000) / 1000.0::DOUBLE) AS confidence, (quality = 1) = ((n_chars % 1000) >= 500) AS correct FROM documents JOIN labels USING (doc_id))"""


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents with a probability that is a function of their length (join_predictions_truth)."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("evaluator"), F.col("lang").alias("domain"), "n_chars")
    j = d.join(table(spark, sf_dir, "labels"), "doc_id")
    p = (F.col("n_chars") % 1000) / 1000
    return j.select("doc_id", "evaluator", "domain", (F.col("quality") == 1).alias("truth"), p.alias("p"), (p >= 0.5).alias("predicted"), F.greatest(p, 1 - p).alias("confidence"), ((F.col("quality") == 1) == (p >= 0.5)).alias("correct"))


def r6(*names: str) -> list:
    return [F.round(c, 6).alias(c) for c in names]


_CONF = """c AS (SELECT evaluator, count(*) FILTER (truth AND predicted) AS tp, count(*) FILTER (NOT truth AND NOT predicted) AS tn, count(*) FILTER (NOT truth AND predicted) AS fp, count(*) FILTER (truth AND NOT predicted) AS fn FROM pred GROUP BY evaluator)"""
_RATES = """evaluator, tp, tn, fp, fn, round((tp + tn)::DOUBLE / (tp + tn + fp + fn), 6) AS accuracy, round(CASE WHEN tp + fp > 0 THEN tp::DOUBLE / (tp + fp) ELSE 0 END, 6) AS precision, round(CASE WHEN tp + fn > 0 THEN tp::DOUBLE / (tp + fn) ELSE 0 END, 6) AS recall,
    round(CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp::DOUBLE / (2 * tp + fp + fn) ELSE 0 END, 6) AS f1, round(CASE WHEN tn + fp > 0 THEN tn::DOUBLE / (tn + fp) ELSE 0 END, 6) AS specificity, round((tp + fp)::DOUBLE / (tp + tn + fp + fn), 6) AS pass_rate,
    round(CASE WHEN (tp + fp) * (tp + fn) * (tn + fp) * (tn + fn) > 0 THEN (tp * tn - fp * fn)::DOUBLE / sqrt(((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))::DOUBLE) ELSE 0 END, 6) AS mcc"""


@plan(f"WITH {PRED}, {_CONF} SELECT {_RATES} FROM c")
def agg_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = M.confusion(predictions(spark, sf_dir), ["evaluator"])
    return c.select("evaluator", "tp", "tn", "fp", "fn", *r6("accuracy", "precision", "recall", "f1", "specificity", "pass_rate", "mcc"))


_BUCKETS = "CASE WHEN p >= 0.65::DOUBLE THEN 'SUPPORTS' WHEN p <= 0.35::DOUBLE THEN 'REFUTES' ELSE 'NEI' END"
_TRUTH = "CASE WHEN truth THEN 'SUPPORTS' ELSE 'REFUTES' END"


@plan(f"""WITH {PRED}, x AS (SELECT {_TRUTH} AS t, {_BUCKETS} AS b FROM pred), l AS (SELECT t AS label FROM x UNION SELECT b FROM x)
SELECT label, (SELECT count(*) FROM x WHERE t = label) AS n_true, (SELECT count(*) FROM x WHERE b = label) AS n_pred, round((SELECT count(*) FROM x WHERE t = label AND b = label) * 2.0::DOUBLE / ((SELECT count(*) FROM x WHERE t = label) + (SELECT count(*) FROM x WHERE b = label)), 6) AS f1 FROM l""")
def agg_f1_macro(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F1 per label of the three-way buckets (agg_fever, set_label_union); their mean is the macro score."""
    p = predictions(spark, sf_dir)
    b = F.when(F.col("p") >= 0.65, "SUPPORTS").when(F.col("p") <= 0.35, "REFUTES").otherwise("NEI")
    rows = p.select(F.when(F.col("truth"), "SUPPORTS").otherwise("REFUTES").alias("t"), b.alias("b"))
    return M.f1_by_label(rows, "t", "b").select("label", "n_true", "n_pred", *r6("f1"))


@plan(f"""WITH {PRED} SELECT {_TRUTH} AS label, count(*) AS n, round(avg(CASE WHEN {_BUCKETS} = {_TRUTH} THEN 1.0::DOUBLE ELSE 0 END), 6) AS accuracy FROM pred GROUP BY 1""")
def agg_fever(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = F.when(F.col("p") >= 0.65, "SUPPORTS").when(F.col("p") <= 0.35, "REFUTES").otherwise("NEI")
    p = predictions(spark, sf_dir).select(F.when(F.col("truth"), "SUPPORTS").otherwise("REFUTES").alias("label"), b.alias("b"))
    return p.groupBy("label").agg(F.count("*").alias("n"), F.round(F.avg((F.col("b") == F.col("label")).cast("double")), 6).alias("accuracy"))


@plan(f"""WITH {PRED}, c AS (SELECT domain, least(floor(p * 10), 9) AS bin, count(*) AS n, avg(p) AS conf, avg(truth::INT) AS acc FROM pred GROUP BY ALL) SELECT domain, sum(n)::BIGINT AS n, round(sum(n * abs(acc - conf)) / sum(n), 6) AS ece FROM c GROUP BY domain""")
def agg_ece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.ece(predictions(spark, sf_dir), ["domain"], correct="truth").select("domain", "n", *r6("ece"))


@plan(f"""WITH {PRED}, s AS (SELECT domain, abs(truth::INT - p) AS s FROM pred), r AS (SELECT *, count(*) OVER (PARTITION BY domain) AS n, row_number() OVER (PARTITION BY domain ORDER BY s) AS k FROM s)
SELECT domain, max(n) AS n, round(max(CASE WHEN n >= 50 AND k = least(greatest(ceil((n + 1) * (1 - 0.1::DOUBLE)), 1), n) THEN s END), 6) AS quantile FROM r GROUP BY domain""")
def agg_conformal(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = predictions(spark, sf_dir).withColumn("s", F.abs(F.col("truth").cast("int") - F.col("p")))
    return M.conformal_quantiles(s, ["domain"], "s").select("domain", "n", *r6("quantile"))


@plan(f"""WITH {PRED}, s AS (SELECT domain, abs(truth::INT - p) AS s FROM pred), r AS (SELECT *, count(*) OVER (PARTITION BY domain) AS n, row_number() OVER (PARTITION BY domain ORDER BY s) AS k FROM s),
q AS (SELECT domain, max(CASE WHEN n >= 50 AND k = least(greatest(ceil((n + 1) * (1 - 0.1::DOUBLE)), 1), n) THEN s END) AS quantile FROM r GROUP BY domain)
SELECT domain, CASE WHEN quantile IS NULL THEN 'general' END AS fallback_used, count(*) AS n, round(avg(CASE WHEN truth::INT BETWEEN greatest(p - coalesce(quantile, 0.2::DOUBLE), 0) AND least(p + coalesce(quantile, 0.2::DOUBLE), 1) THEN 1.0::DOUBLE ELSE 0 END), 6) AS coverage FROM pred JOIN q USING (domain) GROUP BY ALL""")
def agg_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of intervals that hold the truth, after fn_conformal_apply."""
    p = predictions(spark, sf_dir)
    q = M.conformal_quantiles(p.withColumn("s", F.abs(F.col("truth").cast("int") - F.col("p"))), ["domain"], "s")
    a = M.conformal_apply(p, q, "domain")
    inside = F.col("truth").cast("int").between(F.col("low"), F.col("high")).cast("double")
    return a.groupBy("domain", "fallback_used").agg(F.count("*").alias("n"), F.round(F.avg(inside), 6).alias("coverage"))


_AURC = f"""WITH {PRED}, r AS (SELECT evaluator, doc_id, row_number() OVER w AS k, row_number() OVER b AS kb, count(*) OVER (PARTITION BY evaluator) AS n, sum(1 - correct::INT) OVER w AS e, sum(1 - correct::INT) OVER b AS eb FROM pred
    WINDOW w AS (PARTITION BY evaluator ORDER BY confidence DESC, doc_id DESC ROWS UNBOUNDED PRECEDING), b AS (PARTITION BY evaluator ORDER BY correct::INT DESC, doc_id DESC ROWS UNBOUNDED PRECEDING))"""


@plan(f"""{_AURC}, d AS (SELECT evaluator, n, e / k AS risk, coalesce(lag(e / k) OVER (PARTITION BY evaluator ORDER BY k), 0) AS last FROM r), o AS (SELECT evaluator, n, eb / kb AS risk, coalesce(lag(eb / kb) OVER (PARTITION BY evaluator ORDER BY kb), 0) AS last FROM r),
a AS (SELECT evaluator, sum((risk + last) / 2 / n) AS aurc FROM d GROUP BY evaluator), b AS (SELECT evaluator, sum((risk + last) / 2 / n) AS best FROM o GROUP BY evaluator)
SELECT evaluator, round(aurc, 6) AS aurc, round(best, 6) AS aurc_opt, round(aurc - best, 6) AS eaurc FROM a JOIN b USING (evaluator)""")
def win_aurc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """win_aurc, win_aurc_opt and eaurc."""
    return M.aurc(predictions(spark, sf_dir), ["evaluator"], tie="doc_id").select("evaluator", *r6("aurc", "aurc_opt", "eaurc"))


@plan(f"""{_AURC} SELECT evaluator, doc_id, round(k / n, 6) AS coverage, round(e / k, 6) AS risk FROM r""")
def win_risk_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.risk_coverage(predictions(spark, sf_dir), ["evaluator"], "confidence", "correct", "doc_id").select("evaluator", "doc_id", *r6("coverage", "risk"))


@plan(f"""WITH {PRED}, c AS (SELECT evaluator, count(*) AS n, sum(correct::INT) AS h FROM pred GROUP BY evaluator)
SELECT evaluator, n, round((h / n + 1.96 * 1.96 / (2 * n) - 1.96::DOUBLE * sqrt(h / n * (1 - h / n) / n + 1.96 * 1.96 / (4.0 * n * n))) / (1 + 1.96 * 1.96 / n), 6) AS low, round((h / n + 1.96 * 1.96 / (2 * n) + 1.96::DOUBLE * sqrt(h / n * (1 - h / n) / n + 1.96 * 1.96 / (4.0 * n * n))) / (1 + 1.96 * 1.96 / n), 6) AS high FROM c""")
def agg_wilson(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = predictions(spark, sf_dir).groupBy("evaluator").agg(F.count("*").alias("n"), F.sum(F.col("correct").cast("int")).alias("h"))
    low, high = M.wilson(F.col("h"), F.col("n"))
    return c.select("evaluator", "n", F.round(low, 6).alias("low"), F.round(high, 6).alias("high"))


@plan(f"""WITH {PRED}, c AS (SELECT evaluator, avg(correct::INT) AS p FROM pred GROUP BY evaluator), j AS (SELECT a.evaluator AS a, b.evaluator AS b, a.p AS pa, b.p AS pb, sqrt((a.p * (1 - a.p) + b.p * (1 - b.p)) / 2) AS s FROM c a JOIN c b ON a.evaluator < b.evaluator),
d AS (SELECT a, b, CASE WHEN s <> 0 THEN (pa - pb) / s ELSE 0 END AS d FROM j)
SELECT a, b, round(d, 6) AS d, CASE WHEN abs(d) < 0.2::DOUBLE THEN 'negligible' WHEN abs(d) < 0.5::DOUBLE THEN 'small' WHEN abs(d) < 0.8::DOUBLE THEN 'medium' ELSE 'large' END AS effect FROM d""")
def agg_effect_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    rates = predictions(spark, sf_dir).groupBy("evaluator").agg(F.avg(F.col("correct").cast("double")).alias("rate"))
    return M.effect_sizes(rates, "evaluator", "rate").select("a", "b", *r6("d"), "effect")


_CARD = f"""{_AURC}, d AS (SELECT evaluator, n, e / k AS risk, coalesce(lag(e / k) OVER (PARTITION BY evaluator ORDER BY k), 0) AS last FROM r), au AS (SELECT evaluator, round(sum((risk + last) / 2 / n), 6) AS aurc FROM d GROUP BY evaluator), {_CONF}, m AS (SELECT {_RATES} FROM c),
false_pass AS (SELECT evaluator, CASE WHEN tn + fp > 0 THEN fp::DOUBLE / (tn + fp) ELSE 0 END AS passed FROM c), ev AS (SELECT source AS evaluator, avg(CASE WHEN doc_id % 3 <> 0 THEN 1.0::DOUBLE ELSE 0 END) AS truthfulqa, avg(least(1.0::DOUBLE, len(regexp_extract_all(coalesce(text, ''), '[.!?]+')) / 50.0::DOUBLE)) AS factscore, quantile_cont(n_chars, 0.95) AS p95, avg(CASE WHEN n_chars % 997 >= 200 THEN 1.0::DOUBLE ELSE 0 END) AS faithfulness FROM documents GROUP BY 1),
rk AS (SELECT evaluator, truth, row_number() OVER (PARTITION BY evaluator ORDER BY p DESC, doc_id) AS rank, sum(truth::INT) OVER (PARTITION BY evaluator) AS n FROM pred),
ir AS (SELECT evaluator, round(sum(truth::INT) / max(n), 6) AS recall_at_10, round(sum(truth::INT / log2(rank + 1)) / list_sum(list_transform(range(1, least(10, max(n))::INT + 1), lambda i: 1 / log2(i + 1))), 6) AS ndcg FROM rk WHERE rank <= 10 AND n > 0 GROUP BY evaluator),
card AS (SELECT m.evaluator, accuracy, precision, recall, f1, passed AS pass_rate, aurc, truthfulqa, factscore, p95, faithfulness, coalesce(ndcg, 0) AS ndcg, coalesce(recall_at_10, 0) AS recall_at_10 FROM m JOIN false_pass USING (evaluator) JOIN au USING (evaluator) JOIN ev USING (evaluator) LEFT JOIN ir USING (evaluator))"""


def card(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All metrics of each evaluator in one row: rates, selective risk, facts, latency and retrieval."""
    p = predictions(spark, sf_dir)
    rates = M.confusion(p, ["evaluator"])
    rates = rates.select("evaluator", *r6("accuracy", "precision", "recall", "f1"), M.ratio(F.col("fp").cast("double"), F.col("tn") + F.col("fp")).alias("pass_rate"))
    risk = M.aurc(p, ["evaluator"], tie="doc_id").select("evaluator", *r6("aurc"))
    d = table(spark, sf_dir, "documents")
    facts = F.least(F.lit(1.0), F.size(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit("[.!?]+"), F.lit(0))) / 50)
    share = lambda c: F.avg(F.when(c, 1.0).otherwise(0.0))
    own = d.groupBy(F.col("source").alias("evaluator")).agg(share(F.col("doc_id") % 3 != 0).alias("truthfulqa"), F.avg(facts).alias("factscore"), F.percentile("n_chars", 0.95).alias("p95"), share(F.col("n_chars") % 997 >= 200).alias("faithfulness"))
    sizes = p.groupBy("evaluator").agg(F.count_if("truth").alias("n_relevant"))
    place = Window.partitionBy("evaluator").orderBy(F.desc("p"), "doc_id")
    ranked = p.withColumn("rank", F.row_number().over(place)).where("rank <= 10").withColumn("relevant", F.col("truth")).join(sizes, "evaluator")
    found = M.retrieval_at_k(ranked, ["evaluator"], 10).select("evaluator", F.round("ndcg", 6).alias("ndcg"), F.round("recall", 6).alias("recall_at_10"))
    return rates.join(risk, "evaluator").join(own, "evaluator").join(found, "evaluator", "left").fillna(0.0, ["ndcg", "recall_at_10"])


@plan(f"""{_CARD} SELECT evaluator, unnest(['accuracy', 'precision', 'recall', 'f1', 'safety', 'truthfulqa', 'factscore', 'speed', 'selective', 'relevance']) AS score, round(unnest([accuracy, precision, recall, f1, 1 - pass_rate, truthfulqa, factscore, CASE WHEN p95 > 0 THEN least(1.0::DOUBLE, 1000 / p95) ELSE 0 END, 1 / (1 + greatest(0, aurc)), faithfulness]), 6) AS value FROM card""")
def agg_summary_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten scores from 0 to 1 of each evaluator, higher is better, one row each (agg_comparison_table's long form)."""
    return R.summary_scores(card(spark, sf_dir), "evaluator").select("evaluator", "score", F.round("value", 6).alias("value"))


@plan(f"""{_CARD}, l AS (SELECT evaluator, unnest(['accuracy', 'f1', 'factscore', 'truthfulqa', 'p95', 'pass_rate', 'aurc', 'ndcg', 'recall_at_10', 'faithfulness']) AS metric, unnest([accuracy, f1, round(factscore, 9), round(truthfulqa, 9), CASE WHEN p95 > 0 THEN -p95 END, -round(pass_rate, 9), -aurc, ndcg, recall_at_10, round(faithfulness, 9)]) AS v FROM card)
SELECT evaluator, metric, (rank() OVER (PARTITION BY metric ORDER BY v DESC NULLS LAST))::INT AS place FROM l""")
def win_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places of the evaluators by ten metrics; equal ones share a place."""
    c = card(spark, sf_dir)
    return R.rankings(c.withColumns({x: F.round(x, 9) for x in ("factscore", "truthfulqa", "pass_rate", "faithfulness")}), "evaluator")


@plan(f"""WITH {PRED} SELECT domain, count(*) AS n, count(*) FILTER (p < 0.05::DOUBLE) AS errors, round(avg(CASE WHEN p >= 0.05::DOUBLE THEN correct::INT END), 6) AS accuracy, round(avg(CASE WHEN p >= 0.05::DOUBLE THEN confidence END), 6) AS confidence FROM pred GROUP BY domain""")
def agg_per_domain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """agg_per_domain, agg_category_accuracy and agg_summary: rows that count as errors are left out of the rates."""
    fine = F.col("p") >= 0.05
    return predictions(spark, sf_dir).groupBy("domain").agg(F.count("*").alias("n"), F.count_if(~fine).alias("errors"), F.round(F.avg(F.when(fine, F.col("correct").cast("int"))), 6).alias("accuracy"), F.round(F.avg(F.when(fine, F.col("confidence"))), 6).alias("confidence"))


@plan("""WITH r AS (SELECT event_type, value, event_type <> 'error' AS ok, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS k FROM events), a AS (SELECT event_type, list_sort(list(value)) AS v, count(*) AS n, avg(ok::INT) AS s FROM r WHERE k <= 100 GROUP BY 1)
SELECT event_type, n, v[1 + n // 2] AS p50, v[1 + least(floor(n * 0.95::DOUBLE)::INT, n - 1)] AS p95, round(s, 6) AS success_rate FROM a""")
def agg_latency_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rank percentiles of the last 100 samples (st_sliding_latency)."""
    e = table(spark, sf_dir, "events").withColumn("ok", F.col("event_type") != "error")
    return M.latency_by_rank(e, ["event_type"], "value", ["ts", "event_id"]).withColumn("success_rate", F.round("success_rate", 6))


@plan("""SELECT event_type, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.9), 6) AS p90, round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.99), 6) AS p99, min(value) AS min, max(value) AS max, round(1000 / quantile_cont(value, 0.5), 6) AS throughput FROM events GROUP BY 1""")
def agg_latency_interp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.latency_interpolated(table(spark, sf_dir, "events"), ["event_type"], "value").select("event_type", *r6("mean", "std", "p50", "p90", "p95", "p99"), "min", "max", *r6("throughput"))


@plan("""WITH a AS (SELECT event_type, list_sort(list(value)) AS v, count(*) AS n FROM events GROUP BY 1) SELECT event_type, v[greatest(floor(n * 0.95::DOUBLE)::INT, 1)] AS p95 FROM a""")
def agg_load_percentile(spark: SparkSession, sf_dir: str) -> DataFrame:
    rank = F.greatest(F.floor(F.col("total") * 0.95), F.lit(1))
    return M.value_at_rank(table(spark, sf_dir, "events"), ["event_type"], "value", rank).select("event_type", F.col("value").alias("p95"))


@plan("""SELECT event_id, event_type, round(cume_dist() OVER (PARTITION BY event_type ORDER BY value), 6) AS ecdf FROM events""")
def win_ecdf(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = M.ecdf(table(spark, sf_dir, "events").select("event_id", "event_type", "value"), ["event_type"], "value")
    return e.select("event_id", "event_type", F.round("ecdf", 6).alias("ecdf"))


@plan("""SELECT event_type, q, round(v, 6) AS value FROM (SELECT event_type, unnest([0.1, 0.25, 0.5, 0.75, 0.9]::DOUBLE[]) AS q, unnest(quantile_cont(value, [0.1, 0.25, 0.5, 0.75, 0.9])) AS v FROM events GROUP BY event_type)""")
def win_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    qs = [0.1, 0.25, 0.5, 0.75, 0.9]
    a = table(spark, sf_dir, "events").groupBy("event_type").agg(F.percentile("value", qs).alias("v"))
    z = a.select("event_type", F.explode(F.arrays_zip(F.array(*map(F.lit, qs)).alias("q"), F.col("v"))).alias("x"))
    return z.select("event_type", F.col("x.q").alias("q"), F.round("x.v", 6).alias("value"))


@plan("""WITH n AS (SELECT least(floor(value / 5), 39)::BIGINT AS bin, count(*) AS n FROM events GROUP BY 1), k AS (SELECT o, exp(-0.5::DOUBLE * o * o) AS w FROM range(-2, 3) t(o)), s AS (SELECT sum(w) AS t FROM k)
SELECT bin + o AS bin, round(sum(n * (w / t)), 6) AS smoothed FROM n, k, s WHERE bin + o BETWEEN 0 AND 39 GROUP BY 1""")
def win_smooth_hist(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.smooth_histogram(table(spark, sf_dir, "events"), "value", 5.0, 40).select("bin", *r6("smoothed"))


@plan("""WITH s AS (SELECT user_id, event_type, median(value) AS p50 FROM events WHERE event_type IN ('view', 'click') GROUP BY ALL) SELECT user_id, round(max(CASE WHEN event_type = 'view' THEN p50 END) / max(CASE WHEN event_type = 'click' THEN p50 END), 6) AS speedup FROM s GROUP BY user_id HAVING count(*) = 2 AND max(CASE WHEN event_type = 'click' THEN p50 END) > 0""")
def agg_cache_speedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Median of one kind of sample over that of another, per key."""
    e = table(spark, sf_dir, "events").where(F.col("event_type").isin("view", "click"))
    p = e.groupBy("user_id").pivot("event_type", ["view", "click"]).agg(F.percentile("value", 0.5))
    return p.where("view IS NOT NULL AND click > 0").select("user_id", F.round(F.col("view") / F.col("click"), 6).alias("speedup"))
