"""Quality rules whose cutoffs are certified on labelled holdouts. DataFrame functions only.

Base rules: fewer than 50 words, or more than half of the words in repeated 3-word windows. The other rules compare
a ratio with a cutoff. Cutoffs are used in a stratum (language) only if the exact binomial test on that stratum's
labelled good documents certifies that all of them together reject at most ``ALPHA`` of them, at confidence
``1 - DELTA`` over all strata. Two ways share ``DELTA`` evenly: joint steps, which take a cutoff of every rule and are
tested in fixed sequence, mildest first, each at the whole ``ALPHA``; and single cutoffs, each at ``ALPHA / number of
rules``, Bonferroni over rules and cutoffs. The joint way needs some 250 labelled good documents in four languages, the
single one some 2,000, but then has a cutoff of its own for each rule. In a stratum the way that rejects more labelled
bad documents is taken; within a way the mildest of those that reject most; a rule that rejects none is not used.
Strata with too few labels get the base rules only.

Nulls: a null text has no words and fails; a null lang is a stratum of its own, apart from the empty one; a null doc_id
stays and has no label. Labels of one doc_id given twice: the lower quality counts. Repeated rows are judged alike.
Very long texts are measured whole, in arrays of one task. Ties: of cutoffs that reject as many labelled bad documents
the mildest is taken. Empty tables give empty results, and without labels only the base rules reject. Extra columns are
ignored by ``quality_features`` and kept by ``keep_good``, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE, beside, documents, materialize, text_of

MIN_WORDS, MOST_REPEATED = 50, 50
ALPHA, DELTA = 0.02, 0.05
#: Rules beyond the base ones: metric by name, in thousandths, with the cutoffs that are tried.
CUTOFFS = {
    "symbols": (50, 100, 200, 400, 700, 1000, 1500),
    "repeats": (100, 150, 200, 250, 300, 400, 450),
    "dup_lines": (100, 200, 300, 400, 500, 600, 800),
    "capitals": (150, 250, 350, 450, 550, 700, 850),
    "shouts": (50, 100, 200, 400, 600, 800, 950),
}
#: Joint steps, strictest first: one cutoff of every rule.
STEPS = [dict(zip(CUTOFFS, cuts, strict=True)) for cuts in zip(*CUTOFFS.values(), strict=True)]
#: Rejected documents (some 160 bytes each) that are told to all tasks; more meet the documents in a shuffle.
MOST_REJECTED = 300_000
_SMALL = 64  # distinct repeated windows up to which a scan of them is cheaper than sorting structs


def _share(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, F.floor(part * 1000 / whole)).otherwise(0).cast("long")


def quality_features(docs: DataFrame) -> DataFrame:
    """doc_id, lang, key of the text, the base counts and the metrics of the other rules.

    The counts come out of a generator of one row: a filter on them stays above it. Pushed down, it would repeat their
    expressions within lambdas.
    """
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), text_of().alias("text"))
    # only the first and the last part can be empty; a pattern that trims would try every inner run of white space
    d = d.withColumn("words", F.split("text", f"[{SPACE}]+"))
    d = d.withColumn("words", F.expr("slice(words, 1 + int(words[0] = ''), size(words) - int(words[0] = '') - int(size(words) > 1 AND words[size(words) - 1] = ''))"))
    d = d.withColumn("n", F.size("words"))
    d = d.withColumn("grams", F.expr("CASE WHEN n < 3 THEN array() ELSE transform(sequence(0, n - 3), i -> xxhash64(words[i], words[i + 1], words[i + 2])) END").cast("array<bigint>"))
    d = d.withColumn("ordered", F.sort_array("grams"))
    d = d.withColumn("again", F.expr("array_distinct(filter(ordered, (g, i) -> i > 0 AND g = ordered[greatest(i - 1, 0)]))"))
    d = d.withColumn("pairs", F.expr(f"CASE WHEN size(again) > {_SMALL} THEN sort_array(transform(grams, (g, i) -> struct(g AS g, i AS i))) END"))
    d = d.withColumn(
        "places",
        F.expr(
            f"""CASE WHEN size(again) = 0 THEN cast(array() AS array<int>)
                WHEN size(again) <= {_SMALL} THEN filter(sequence(0, n - 3), i -> array_contains(again, grams[i]))
                ELSE sort_array(transform(filter(pairs, (x, j) -> coalesce(get(pairs, j - 1).g = x.g, false) OR coalesce(get(pairs, j + 1).g = x.g, false)), x -> x.i)) END"""
        ),
    )
    d = d.withColumn("lines", F.expr(f"filter(split(text, '\\n'), l -> l rlike '[^{SPACE.replace(chr(92), chr(92) * 2)}]')"))
    counts = F.struct(
        F.col("n").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace("text", r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.size("lines").cast("long").alias("n_lines"),
        F.expr("CASE WHEN size(places) = 0 THEN 0L ELSE aggregate(sequence(0, size(places) - 1), 3L, (c, j) -> c + CASE WHEN j = 0 THEN 0 ELSE least(3, places[j] - places[greatest(j - 1, 0)]) END) END").alias("n_repeat_words"),
        F.length(F.regexp_replace("text", r"[^A-Z]+", "")).cast("long").alias("n_capitals"),
        F.length(F.regexp_replace("text", r"[^!]+", "")).cast("long").alias("n_shouts"),
        F.xxhash64("text").alias("key"),
    )
    return d.select("doc_id", "lang", F.inline(F.array(counts))).select(
        "*",
        ((F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))).alias("base_failed"),
        _share(F.col("n_symbols"), F.col("n_words")).alias("symbols"),
        _share(F.col("n_repeat_words"), F.col("n_words")).alias("repeats"),
        _share(F.col("n_dup_lines"), F.col("n_lines")).alias("dup_lines"),
        _share(F.col("n_capitals"), F.col("word_chars")).alias("capitals"),
        _share(F.col("n_shouts"), F.col("n_words")).alias("shouts"),
    )


def _stratum() -> Column:
    """A language as a key that is never null: a null language and the empty one differ."""
    return F.coalesce(F.concat(F.lit("="), F.col("lang")), F.lit(""))


def log_binomial_tail(n: str, k: str, p: float) -> Column:
    """ln P(Bin(n, p) <= k) for columns n and k with k <= n, summed term by term in logarithms."""
    return F.expr(
        f"""aggregate(CASE WHEN {k} > 0 THEN sequence(1L, {k}) ELSE cast(array() AS array<bigint>) END,
            struct({n} * ln(1 - {p}D) AS term, {n} * ln(1 - {p}D) AS total),
            (a, i) -> named_struct('term', a.term + ln(({n} - i + 1) / cast(i AS double)) + ln({p}D / (1 - {p}D)),
                'total', greatest(a.total, a.term + ln(({n} - i + 1) / cast(i AS double)) + ln({p}D / (1 - {p}D)))
                    + ln(1 + exp(-abs(a.total - (a.term + ln(({n} - i + 1) / cast(i AS double)) + ln({p}D / (1 - {p}D))))))),
            a -> a.total)"""
    )


def _beyond(cuts: dict[str, Column]) -> Column:
    """True if any rule's metric is above its cutoff; a null cutoff rejects nothing."""
    out = F.lit(False)
    for r, c in cuts.items():
        out |= F.coalesce(F.col(r) > c, F.lit(False))
    return out


def certified_cutoffs(features: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """(lang, one cutoff or null per rule): one row per stratum in which something is certified."""
    marks = labels.where("quality IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    known = features.where(~F.col("base_failed")).withColumn("stratum", _stratum()).select("doc_id", "stratum", *CUTOFFS).join(marks, "doc_id")
    known = materialize(known, "labelled")
    good, bad = F.col("quality") == 1, F.col("quality") == 0
    tries = [(r, c) for r, cuts in CUTOFFS.items() for c in cuts]
    tested = {f"{r}_{c}": F.col(r) > c for r, c in tries} | {f"step_{i}": _beyond({r: F.lit(c) for r, c in step.items()}) for i, step in enumerate(STEPS)}
    counts = [F.sum(F.when(kind & test, 1).otherwise(0)).alias(f"{name}_{key}") for key, test in tested.items() for name, kind in (("good", good), ("bad", bad))]
    strata = materialize(known.groupBy("stratum").agg(F.sum(F.when(good, 1).otherwise(0)).alias("n"), *counts), "strata")
    n_strata = max(1, strata.count())
    share = delta / (2 * n_strata)  # of delta, for one way in one stratum

    def sure(tested: DataFrame, p: float, level: float) -> DataFrame:
        tested = tested.where(f"k <= n * {p} AND caught > 0").withColumn("log_tail", log_binomial_tail("n", "k", p))
        return tested.where(F.col("log_tail") <= F.log(F.lit(level)))

    rows = ", ".join(f"'{r}', {c}, good_{r}_{c}, bad_{r}_{c}" for r, c in tries)
    single = sure(strata.selectExpr("stratum", "n", f"stack({len(tries)}, {rows}) AS (rule, cutoff, k, caught)"), alpha / len(CUTOFFS), share / len(tries))
    single = single.groupBy("stratum").agg(*[F.max_by(F.col("cutoff"), F.when(F.col("rule") == r, F.struct("caught", "cutoff"))).alias(f"cut_{r}") for r in CUTOFFS])
    caught = F.sum(F.when(bad & _beyond({r: F.col(f"cut_{r}") for r in CUTOFFS}), 1).otherwise(0))
    single = single.join(beside(known, single, n_strata, "stratum").groupBy("stratum").agg(caught.alias("caught")), "stratum")
    # a milder step rejects fewer, so its test is passed whenever a stricter step's is: the sequence has no gaps
    steps = [F.struct(F.lit(i).alias("step"), F.col(f"good_step_{i}").alias("k"), F.col(f"bad_step_{i}").alias("caught"), *[F.when(F.col(f"bad_{r}_{step[r]}") > 0, F.lit(step[r])).alias(f"cut_{r}") for r in CUTOFFS]) for i, step in enumerate(STEPS)]
    joint = sure(strata.select("stratum", "n", F.explode(F.array(*steps)).alias("s")).select("stratum", "n", "s.*"), alpha, share)
    names = ["caught", *(f"cut_{r}" for r in CUTOFFS)]
    joint = joint.groupBy("stratum").agg(F.max_by(F.struct(*names), F.struct("caught", "step")).alias("joint"))
    both = single.select("stratum", F.struct(*names).alias("single")).join(joint, "stratum", "full")
    better = F.coalesce(F.col("joint.caught"), F.lit(0)) > F.coalesce(F.col("single.caught"), F.lit(0))
    lang = F.when(F.col("stratum") != "", F.expr("substring(stratum, 2)"))
    return both.select(lang.alias("lang"), *[F.when(better, F.col(f"joint.{c}")).otherwise(F.col(f"single.{c}")).alias(c) for c in names[1:]])


def judge(features: DataFrame, cutoffs: DataFrame) -> DataFrame:
    """Features with ``kept``: false if a base rule or a certified rule of its stratum rejects the document."""
    found = materialize(cutoffs.withColumn("stratum", _stratum()).drop("lang"), "cutoffs")
    out = beside(features.withColumn("stratum", _stratum()), found, found.count(), "stratum", "left")
    kept = ~F.col("base_failed") & ~_beyond({r: F.col(f"cut_{r}") for r in CUTOFFS})
    return out.withColumn("kept", kept).select(*features.columns, "kept")


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that the rules keep, with all their columns.

    Features are computed once, without the texts; the rejected ones are found again by doc_id, language and text hash.
    """
    features = materialize(quality_features(docs), "quality")
    gone = judge(features, certified_cutoffs(features, labels)).where("NOT kept")
    gone = materialize(gone.select(F.col("doc_id").alias("_d"), F.col("lang").alias("_l"), F.col("key").alias("_k")).distinct(), "rejected")
    gone = F.broadcast(gone) if gone.count() <= MOST_REJECTED else gone
    same = docs["doc_id"].cast("long").eqNullSafe(F.col("_d")) & docs["lang"].cast("string").eqNullSafe(F.col("_l")) & (F.xxhash64(F.coalesce(docs["text"].cast("string"), F.lit(""))) == F.col("_k"))
    return docs.join(gone, same, "left_anti")


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    features = materialize(quality_features(documents(spark, sf_dir)), "quality")
    return judge(features, certified_cutoffs(features, labels)).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
