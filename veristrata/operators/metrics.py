"""Evaluation of predictions: classification, calibration, selective prediction, retrieval, latency, ranking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import join_same, running


def ratio(a: Column, b: Column, other: float = 0.0) -> Column:
    return F.when(b != 0, a / b).otherwise(F.lit(other))


def confusion(df: DataFrame, keys: list[str], truth: str = "truth", predicted: str = "predicted") -> DataFrame:
    """Counts and rates of boolean predictions; rates without a denominator are 0."""
    n = lambda t, p: F.count_if((F.col(truth) == t) & (F.col(predicted) == p))
    c = df.groupBy(*keys).agg(n(True, True).alias("tp"), n(False, False).alias("tn"), n(False, True).alias("fp"), n(True, False).alias("fn"))
    tp, tn, fp, fn = (F.col(x).cast("double") for x in ("tp", "tn", "fp", "fn"))
    precision, recall = ratio(tp, tp + fp), ratio(tp, tp + fn)
    root = F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))
    return c.select("*", ratio(tp + tn, tp + tn + fp + fn).alias("accuracy"), precision.alias("precision"), recall.alias("recall"), ratio(2 * tp, 2 * tp + fp + fn).alias("f1"), ratio(tn, tn + fp).alias("specificity"), ratio(tp + fp, tp + tn + fp + fn).alias("pass_rate"), ratio(tp * tn - fp * fn, root).alias("mcc"))


def f1_by_label(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """F1 of each label of the union of true and predicted labels."""
    t = df.groupBy(F.col(truth).alias("label")).agg(F.count("*").alias("n_true"))
    p = df.groupBy(F.col(predicted).alias("label")).agg(F.count("*").alias("n_pred"))
    h = df.where(F.col(truth) == F.col(predicted)).groupBy(F.col(truth).alias("label")).agg(F.count("*").alias("hits"))
    joined = t.join(p, "label", "full").join(h, "label", "left").fillna(0)
    return joined.withColumn("f1", ratio(2.0 * F.col("hits"), F.col("n_true") + F.col("n_pred")))


def ece(df: DataFrame, keys: list[str], p: str = "p", correct: str = "correct", bins: int = 10) -> DataFrame:
    """Expected calibration error over equal-width bins, the last one closed."""
    b = df.withColumn("bin", F.least(F.floor(F.col(p) * bins), F.lit(bins - 1)))
    cells = b.groupBy(*keys, "bin").agg(F.count("*").alias("n"), F.avg(p).alias("conf"), F.avg(F.col(correct).cast("double")).alias("acc"))
    return cells.groupBy(*keys).agg((F.sum(F.col("n") * F.abs(F.col("acc") - F.col("conf"))) / F.sum("n")).alias("ece"), F.sum("n").alias("n"))


def aurc(df: DataFrame, keys: list[str], confidence: str = "confidence", correct: str = "correct", tie: str = "idx") -> DataFrame:
    """Area under the risk-coverage curve from (0, 0), the best possible one, and their difference.

    Rows are taken by falling confidence, ties by falling ``tie``.
    """
    wrong = 1 - F.col(correct).cast("int")
    rows = df.select(*keys, confidence, tie, wrong.alias("_w"))

    def area(order: list[Column], name: str) -> DataFrame:
        r = running(rows, keys, order, {"k": F.lit(1), "e": F.col("_w")})
        risk, last = F.col("e") / F.col("k"), F.when(F.col("k") > 1, (F.col("e") - F.col("_w")) / (F.col("k") - 1)).otherwise(0.0)
        return r.groupBy(*keys).agg(F.sum((risk + last) / 2 / F.col("total")).alias(name))

    out = join_same(area([F.desc(confidence), F.desc(tie)], "aurc"), area([F.asc("_w"), F.desc(tie)], "aurc_opt"), keys)
    return out.select(*keys, "aurc", "aurc_opt", (F.col("aurc") - F.col("aurc_opt")).alias("eaurc"))


def risk_coverage(df: DataFrame, keys: list[str], confidence: str, correct: str, tie: str) -> DataFrame:
    rows = df.select(*keys, tie, confidence, (1 - F.col(correct).cast("int")).alias("_w"))
    r = running(rows, keys, [F.desc(confidence), F.desc(tie)], {"k": F.lit(1), "e": F.col("_w")})
    return r.select(*keys, tie, (F.col("k") / F.col("total")).alias("coverage"), (F.col("e") / F.col("k")).alias("risk"))


def value_ranks(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, value, n, upto, total): rows of each distinct value, rows up to it and of the key in all."""
    cells = df.groupBy(*keys, value).agg(F.count("*").alias("n"))
    sizes = df.groupBy(*keys).agg(F.count("*").alias("_size"))
    r = running(cells, keys, [F.asc(value)], {"upto": F.col("n")}).drop("total")
    return join_same(r, sizes, keys).withColumnRenamed("_size", "total")


def ecdf(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Rows with the share of their key's rows whose value is not larger; ranks are those of distinct values."""
    ranks = value_ranks(df, keys, value).select(*keys, value, (F.col("upto") / F.col("total")).alias("ecdf"))
    return join_same(df, ranks, [*keys, value])


def value_at_rank(df: DataFrame, keys: list[str], value: str, rank: Column) -> DataFrame:
    """(keys, n, value): the value of a rank from 1 that may depend on the key's number of rows ``total``."""
    r = value_ranks(df, keys, value).where((F.col("upto") >= rank) & (F.col("upto") - F.col("n") < rank))
    return r.select(*keys, F.col("total").alias("n"), F.col(value))


def conformal_quantiles(df: DataFrame, keys: list[str], score: str, alpha: float = 0.1, least: int = 50) -> DataFrame:
    """Score of rank ceil((n + 1)(1 - alpha)), kept within 1..n; null for strata under ``least`` rows."""
    rank = F.least(F.greatest(F.ceil((F.col("total") + 1) * (1 - alpha)), F.lit(1)), F.col("total"))
    r = value_at_rank(df.select(*keys, F.col(score).alias("_score")), keys, "_score", rank)
    return r.select(*keys, "n", F.when(F.col("n") >= least, F.col("_score")).alias("quantile"))


def conformal_apply(df: DataFrame, quantiles: DataFrame, key: str, p: str = "p", fallback: float = 0.2) -> DataFrame:
    """Interval p -+ quantile, clipped to [0, 1]; strata without one use ``fallback`` and say so."""
    j = df.join(quantiles.select(key, "quantile"), key, "left")
    q = F.coalesce("quantile", F.lit(fallback))
    return j.select(*df.columns, F.greatest(F.col(p) - q, F.lit(0.0)).alias("low"), F.least(F.col(p) + q, F.lit(1.0)).alias("high"), F.when(F.col("quantile").isNull(), "general").alias("fallback_used"))


def retrieval_at_k(ranked: DataFrame, keys: list[str], k: int) -> DataFrame:
    """Recall, precision, hit, reciprocal rank, nDCG and average precision at k.

    ``ranked``: keys, rank from 1, relevant boolean, n_relevant of the query; queries without relevants are left out.
    """
    r = ranked.where((F.col("rank") <= k) & (F.col("n_relevant") > 0))
    w = Window.partitionBy(*keys).orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    rel = F.col("relevant").cast("int")
    r = r.withColumn("hits", F.sum(rel).over(w))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.lit(k), F.first("n_relevant").cast("int"))), F.lit(0.0), lambda a, i: a + 1 / F.log2(i + 1.0))
    return r.groupBy(*keys).agg(
        (F.sum(rel) / F.first("n_relevant")).alias("recall"),
        (F.sum(rel) / k).alias("precision"),
        F.max(rel).cast("double").alias("hit"),
        F.coalesce(F.max(F.when(F.col("relevant"), 1 / F.col("rank"))), F.lit(0.0)).alias("mrr"),
        (F.sum(rel / F.log2(F.col("rank") + 1.0)) / ideal).alias("ndcg"),
        (F.sum(rel * F.col("hits") / F.col("rank")) / F.least(F.lit(k), F.first("n_relevant"))).alias("ap"),
    )


def latency_by_rank(df: DataFrame, keys: list[str], value: str, order: list[str], last: int = 100) -> DataFrame:
    """Over each key's last samples: p50 = sorted[n div 2], p95 = sorted[min(floor(.95 n), n - 1)], success rate."""
    w = Window.partitionBy(*keys).orderBy(*[F.desc(o) for o in order])
    recent = df.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= last)
    a = recent.groupBy(*keys).agg(F.sort_array(F.collect_list(value)).alias("v"), F.count("*").alias("n"), F.avg(F.col("ok").cast("double")).alias("success_rate"))
    at = lambda i: F.element_at("v", (i + 1).cast("int"))
    return a.select(*keys, "n", at(F.floor(F.col("n") / 2)).alias("p50"), at(F.least(F.floor(F.col("n") * 0.95), F.col("n") - 1)).alias("p95"), "success_rate")


def latency_interpolated(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Mean, spread, interpolated percentiles, extremes and throughput."""
    p = lambda q: F.percentile(value, q)
    return df.groupBy(*keys).agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), p(0.5).alias("p50"), p(0.9).alias("p90"), p(0.95).alias("p95"), p(0.99).alias("p99"), F.min(value).alias("min"), F.max(value).alias("max"), ratio(F.lit(1000.0), p(0.5)).alias("throughput"))


def wilson(hits: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    p = hits / n
    mid, d = (p + z * z / (2 * n)), 1 + z * z / n
    half = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))
    return (mid - half) / d, (mid + half) / d


def effect_sizes(rates: DataFrame, key: str, rate: str) -> DataFrame:
    """Cohen's d of all pairs of evaluators from Bernoulli spreads, with its usual name."""
    a, b = rates.select(F.col(key).alias("a"), F.col(rate).alias("pa")), rates.select(F.col(key).alias("b"), F.col(rate).alias("pb"))
    j = a.join(b, F.col("a") < F.col("b"))
    pooled = F.sqrt((F.col("pa") * (1 - F.col("pa")) + F.col("pb") * (1 - F.col("pb"))) / 2)
    d = ratio(F.col("pa") - F.col("pb"), pooled)
    name = F.when(F.abs(F.col("d")) < 0.2, "negligible").when(F.abs(F.col("d")) < 0.5, "small").when(F.abs(F.col("d")) < 0.8, "medium").otherwise("large")
    return j.withColumn("d", d).select("a", "b", "d", name.alias("effect"))


def smooth_histogram(df: DataFrame, value: str, width: float, bins: int, radius: int = 2, sigma: float = 1.0) -> DataFrame:
    """Counts in equal bins, smoothed by a Gaussian kernel over neighbouring bins."""
    n = df.select(F.least(F.floor(F.col(value) / width), F.lit(bins - 1)).alias("bin")).groupBy("bin").agg(F.count("*").alias("n"))
    kernel = [(o, 2.718281828459045 ** (-0.5 * (o / sigma) ** 2)) for o in range(-radius, radius + 1)]
    total = sum(k for _, k in kernel)
    spread = F.array(*[F.struct((F.col("bin") + o).alias("bin"), (F.col("n") * (k / total)).alias("part")) for o, k in kernel])
    return n.select(F.explode(spread).alias("x")).select("x.*").where(f"bin BETWEEN 0 AND {bins - 1}").groupBy("bin").agg(F.sum("part").alias("smoothed"))


#: Rows of one key that a task gets in a sliding window.
STRETCH = 100_000


def sliding(df: DataFrame, keys: list[str], order: list[Column], width: int, values: dict[str, Column]) -> DataFrame:
    """``df`` with aggregates over each row and the ``width`` - 1 rows before it in its key's order.

    Rows are numbered over ranges and dealt in stretches of STRETCH rows, each with the rows before it that its first windows need,
    so a key that holds most rows is spread over many tasks.
    """
    rows = running(df, keys, order, {"_at": F.lit(1)}).drop("total")
    stretch = F.floor((F.col("_at") - 1) / STRETCH)
    own = F.struct(stretch.alias("_stretch"), F.lit(False).alias("_lent"))
    lent = F.when(F.col("_at") > (stretch + 1) * STRETCH - (width - 1), F.struct((stretch + 1).alias("_stretch"), F.lit(True).alias("_lent")))
    dealt = rows.select("*", F.explode(F.array_compact(F.array(own, lent))).alias("_s")).select("*", "_s.*").drop("_s")
    w = Window.partitionBy(*keys, "_stretch").orderBy("_at").rowsBetween(-(width - 1), 0)
    return dealt.select("*", *[v.over(w).alias(n) for n, v in values.items()]).where("NOT _lent").drop("_at", "_stretch", "_lent")
