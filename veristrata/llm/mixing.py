"""Mixing sources to target weights by Pareto order sampling.

A source's target in words is its weight's share of all words, at most MOST_COPIES times its own words; what a source
cannot take is shared again by weight among the others. Every document first gets the whole copies that are certain,
floor(target / source size). The rest of the target is a sample with unequal inclusion probabilities in proportion to
size: p = min(1, lambda * size), with lambda such that the expected words are the rest; where p reaches 1 one more copy
is certain. Documents are ranked by Pareto's order statistic (u / (1 - u)) / (p / (1 - p)), with u a hash of the
document, and taken in that order as long as the words stay within the rest: the size is fixed in words. What the next
document would overshoot (less than that document) is filled by at most FILLS documents of best fitting size, outside
the probabilities above.

Ranks are never counted by one task: order statistics fall into BUCKETS bins, words are summed by source and bin, and
only a source's one crossing bin is ordered document by document. The result is one row per source (``plan_mix``), from
which each document's copies follow by a function of its own row (``copies``): texts are neither sorted nor shuffled.

Nulls: a null text has size 0 and is only copied with its whole source; a null source is a source of its own, last in
order; a null doc_id is an id of its own. Very long texts are counted whole; a document longer than its source's rest
is never sampled. Ties of the order statistic go by doc_id and text. Rows alike in doc_id, source and text share one
decision. Reruns agree. An empty table gives an empty result; extra columns are ignored, and kept by ``mixed``
whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import SPACE, beside, documents, materialize, packed, text_of, unpacked

WEIGHTS, MOST_COPIES = (5, 2, 1), 3
BUCKETS, FILLS = 4096, 3
_LOW = -(1 << 63)


def size_of(column: str = "text") -> Column:
    return F.regexp_count(text_of(column), F.lit(f"[^{SPACE}]+")).cast("long")


def key_of(column: str = "text") -> Column:
    """Identity of a text within its doc_id and source."""
    return F.xxhash64(text_of(column))


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_COPIES) -> DataFrame:
    """(source, source_size, target) from (source, source_size): one row per source, all of them in one task.

    Water filling: with sources ordered by cap / weight, the common level is that of the first source at which all
    words not yet given to capped sources, per weight not yet capped, stay below the source's own cap / weight.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    turn = (F.row_number().over(by_name) - 1) % len(weights)
    s = sizes.withColumn("w", F.array(*[F.lit(float(w)) for w in weights])[turn]).withColumn("cap", F.col("source_size") * float(most))
    by_cap = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    before, whole = by_cap.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    s = s.withColumn("level", (F.sum("source_size").over(whole) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (F.sum("w").over(whole) - F.coalesce(F.sum("w").over(before), F.lit(0.0))))
    s = s.withColumn("fits", F.col("level") <= F.col("cap") / F.col("w"))
    s = s.withColumn("at", F.row_number().over(by_cap))
    s = s.withColumn("common", F.min(F.when(F.col("fits"), F.struct("at", "level"))).over(whole)["level"])
    return s.select("source", "source_size", F.least(F.col("cap"), F.col("w") * F.coalesce("common", F.lit(0.0))).alias("target"))


def _place(seed: int) -> Column:
    """Pareto's order statistic q as q / (1 + q), in 0..1; null for documents that are not sampled."""
    u = (F.shiftrightunsigned(F.xxhash64("doc_id", "key", F.lit(f"mix {seed}")), 11).cast("double") + 0.5) / float(1 << 53)
    odds = F.when((F.col("p") > 0) & (F.col("p") < 1), u / (1 - u) * (1 - F.col("p")) / F.col("p"))
    return odds / (1 + odds)


def _ranked(rows: DataFrame, seed: int) -> DataFrame:
    """Rows (doc_id, source, key, size, with lambda of their source) with p and the place in the order."""
    p = F.when(F.col("lambda") * F.col("size") >= 1 - 1e-9, 1.0).otherwise(F.col("lambda") * F.col("size"))
    return rows.withColumn("p", F.coalesce(p, F.lit(0.0))).withColumn("place", _place(seed))


def _turn() -> Column:
    """A document's turn in the order of its source."""
    return F.struct("place", F.coalesce("doc_id", F.lit(_LOW)).alias("doc_id"), "key")


def units_of(docs: DataFrame) -> DataFrame:
    """(doc_id, source, key, size, rows): each distinct (doc_id, source, text) with its number of rows, no texts."""
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), key_of().alias("key"), size_of().alias("size"))
    return d.groupBy("doc_id", "source", "key").agg(F.max("size").alias("size"), F.count("*").alias("rows"))


def plan_mix(units: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_COPIES, seed: int = 0, fills: int = FILLS) -> tuple[DataFrame, int]:
    """What each source's documents need to know, one row per source, and the number of sources.

    (source, source_size, target, certain, lambda, cut, fills): whole copies of every document, the factor of the
    inclusion probabilities, the last (place, doc_id, key) that the sample takes, and the documents that fill the gap.
    """
    histogram = materialize(units.groupBy("source", "size").agg(F.sum("rows").alias("n")), "sizes")
    sums = histogram.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    plan = targets(sums, weights, most).withColumn("certain", F.coalesce(F.floor(F.try_divide("target", "source_size") + 1e-9), F.lit(0)))
    plan = materialize(plan.withColumn("rest", F.greatest(F.col("target") - F.col("certain") * F.col("source_size"), F.lit(0.0))), "targets")
    n = plan.count()
    # lambda: the larger sizes are certain until the next one's probability is at most 1
    h = beside(histogram, plan.select("source", "rest"), n, "source").where("size > 0")
    larger, words = Window.partitionBy("source").orderBy(F.desc("size")).rowsBetween(Window.unboundedPreceding, -1), F.col("size").cast("double") * F.col("n")
    square = words * F.col("size")
    h = h.withColumn("above", F.coalesce(F.sum(words).over(larger), F.lit(0.0))).withColumn("square", F.sum(square).over(Window.partitionBy("source")) - F.coalesce(F.sum(square).over(larger), F.lit(0.0)))
    h = h.withColumn("lambda", F.try_divide(F.col("rest") - F.col("above"), F.col("square")))
    factors = h.groupBy("source").agg(F.max_by("lambda", F.when(F.col("lambda") * F.col("size") <= 1 + 1e-9, F.col("size"))).alias("lambda"))
    plan = materialize(beside(plan, factors, n, "source", "left").withColumn("lambda", F.coalesce("lambda", F.lit(0.0))), "factors")
    ranked = _ranked(beside(units, plan.select("source", "lambda"), n, "source"), seed).withColumn("words", F.col("size") * F.col("rows")).where("p > 0")
    ranked = ranked.withColumn("bin", F.when(F.col("p") < 1, F.least(F.floor(F.col("place") * BUCKETS), F.lit(BUCKETS - 1))).otherwise(-1).cast("int"))
    bins = ranked.groupBy("source", "bin").agg(F.sum("words").alias("in_bin"))
    reach = F.sum("in_bin").over(Window.partitionBy("source").orderBy("bin"))
    bins = beside(bins.withColumn("reach", reach), plan.select("source", "rest"), n, "source")
    cross = bins.groupBy("source").agg(F.min(F.when(F.col("reach") > F.col("rest"), F.col("bin"))).alias("cross"), F.coalesce(F.max(F.when(F.col("reach") <= F.col("rest"), F.col("reach"))), F.lit(0)).alias("before"))
    cross = materialize(cross, "cross")
    order = Window.partitionBy("source").orderBy(_turn())
    inside = beside(beside(ranked, cross, n, "source").where("bin = cross AND bin >= 0"), plan.select("source", "rest"), n, "source")
    inside = inside.withColumn("done", F.col("before") + F.sum("words").over(order))
    # in order while it fits: the first that overshoots ends the sample
    late = inside.withColumn("over", F.max((F.col("done") > F.col("rest")).cast("int")).over(order)).where("over = 0")
    late = late.groupBy("source").agg(F.max(_turn()).alias("last"), F.max("done").alias("done"))
    late = late.select(F.col("source").alias("_l"), "last", "done")
    edge = F.struct(F.coalesce(F.col("cross") / float(BUCKETS), F.lit(2.0)).alias("place"), F.lit(_LOW).alias("doc_id"), F.lit(_LOW).alias("key"))
    cuts = cross.join(late, F.col("source").eqNullSafe(F.col("_l")), "left").select("source", F.coalesce("last", edge).alias("cut"), F.coalesce("done", "before").alias("done"))
    plan = plan.join(cuts.withColumnRenamed("source", "_c"), F.col("source").eqNullSafe(F.col("_c")), "left").drop("_c")
    plan = plan.withColumn("gap", F.floor(F.col("rest") - F.coalesce("done", F.lit(0)))).drop("done").withColumn("fills", F.array().cast("array<struct<doc_id:bigint,key:bigint>>"))
    plan = materialize(plan, "plan")
    for _ in range(fills):
        open_ = beside(ranked, plan.select("source", "cut", "gap", "fills"), n, "source").where((F.col("p") < 1) & (F.col("words") > 0) & (F.col("words") <= F.col("gap")) & (_turn() > F.col("cut")))
        open_ = open_.where(~F.array_contains("fills", F.struct(F.coalesce("doc_id", F.lit(_LOW)).alias("doc_id"), "key")))
        best = open_.groupBy(F.col("source").alias("_b")).agg(F.max_by(F.struct("words", F.coalesce("doc_id", F.lit(_LOW)).alias("doc_id"), "key"), F.struct("words", (-F.col("place")).alias("place"), "doc_id", "key")).alias("best"))
        plan = plan.join(best, F.col("source").eqNullSafe(F.col("_b")), "left").drop("_b")
        more = F.when(F.col("best").isNotNull(), F.array(F.struct("best.doc_id", "best.key"))).otherwise(F.array().cast("array<struct<doc_id:bigint,key:bigint>>"))
        plan = materialize(plan.withColumn("fills", F.concat("fills", more)).withColumn("gap", F.col("gap") - F.coalesce("best.words", F.lit(0))).drop("best"), "plan")
    return plan.select("source", "source_size", "target", "certain", "lambda", "cut", "fills"), n


def with_copies(rows: DataFrame, plan: DataFrame, n_sources: int, seed: int = 0) -> DataFrame:
    """Rows (doc_id, source, key, size, ...) with source_size, target and the copies that the mix takes."""
    r = _ranked(beside(rows, plan, n_sources, "source"), seed)
    listed = F.array_contains("fills", F.struct(F.coalesce("doc_id", F.lit(_LOW)).alias("doc_id"), "key"))
    sampled = (F.col("p") >= 1) | F.coalesce(F.col("place").isNotNull() & (_turn() <= F.col("cut")), F.lit(False)) | listed
    return r.withColumn("copies", F.col("certain") + sampled.cast("long")).drop("certain", "lambda", "cut", "fills", "place")


def decide(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_COPIES, seed: int = 0, fills: int = FILLS) -> DataFrame:
    """(doc_id, source, key, size, rows, source_size, target, p, copies) for each distinct (doc_id, source, text)."""
    units = materialize(units_of(docs), "units")
    return with_copies(units, *plan_mix(units, weights, most, seed, fills), seed)


def mixed(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_COPIES, seed: int = 0) -> DataFrame:
    """The mix itself: every row of ``docs``, all columns, as often as it is taken. Texts stay where they are read."""
    plan, n = plan_mix(materialize(units_of(docs), "units"), weights, most, seed)
    rows = docs.select(packed(docs).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), key_of().alias("key"), size_of().alias("size"))
    taken = with_copies(rows, plan, n, seed).where("copies > 0")
    return unpacked(taken.select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))), "row", docs.columns)


def op3_mixing_pareto(spark: SparkSession, sf_dir: str) -> DataFrame:
    chosen = decide(documents(spark, sf_dir))
    each = chosen.withColumn("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("rows"))))
    return each.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "p")
