"""Claims, evidence pairs, labels, and the two families of claim and document scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T
from ..session import dealt, materialize


def claims(texts: DataFrame, id_col: str, text_col: str = "text", most: int = 13) -> DataFrame:
    """(id, ord, claim): sentence claims of each text."""
    return texts.select(F.col(id_col), F.posexplode(T.worker_claims(F.col(text_col), most)).alias("ord", "claim"))


LABEL_TOKENS = 80
#: Rows of claim tokens, or of pairs, that are told to all tasks; more are joined by a shuffle.
MOST_TOLD = 200_000


def told(df: DataFrame) -> DataFrame:
    """A materialized table, broadcast if its size is proven small."""
    return F.broadcast(df) if df.count() <= MOST_TOLD else df


#: Texts that a claim's rarest tokens may reach for a first bound of its best sums, and how many times as many texts as
#: are asked for are then summed in full.
SEED_TEXTS, SEED_BEST = 200, 6


def claim_tokens(claim_rows: DataFrame, evidence: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """(weighted, hits): each claim's tokens, and where they stand in the evidence (doc_id, token).

    ``weighted`` has weight, df (texts that hold the token), ``rest``, the weights of this token and of all that are not
    rarer, and ``seed``: the claim's rarest token, and the next ones while all of them reach at most SEED_TEXTS texts. Only
    the claims' tokens leave the scan.
    """
    own = materialize(claim_rows.select(*keys, F.explode(F.array_distinct(T.significant_tokens(F.col("claim")))).alias("token")), "claim-tokens")
    words = evidence.select("doc_id", F.explode(F.array_distinct(T.raw_tokens(F.col("text")))).alias("token")).where(T.is_significant(F.col("token")))
    hits = materialize(words.join(told(own.select("token").distinct()), "token", "left_semi"), "hits")
    df = hits.groupBy("token").agg(F.count("*").alias("df"))
    weighted = own.join(df, "token").withColumn("weight", F.round(1000 * F.log(1 + F.lit(evidence.count()) / F.col("df"))).cast("long"))
    order = Window.partitionBy(*keys).orderBy(F.desc("weight"), "token")  # one claim's tokens
    after, before = order.rowsBetween(0, Window.unboundedFollowing), order.rowsBetween(Window.unboundedPreceding, 0)
    seed = (F.sum("df").over(before) <= SEED_TEXTS) | (F.row_number().over(order) == 1)
    return materialize(weighted.select("*", F.sum("weight").over(after).alias("rest"), seed.alias("seed")), "weights"), hits


def _sums(tokens: DataFrame, hits: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, doc_id, shared): summed weights of the tokens that a claim and a text share."""
    return hits.join(told(tokens.select(*keys, "token", "weight")), "token").groupBy(*keys, "doc_id").agg(F.sum("weight").alias("shared"))


def _completed(sums: DataFrame, tokens: DataFrame, hits: DataFrame, keys: list[str]) -> DataFrame:
    """Sums of (keys, doc_id, shared) with the weights of further tokens of the claim that the text holds."""
    asked = sums.select(*keys, "doc_id").join(told(tokens.select(*keys, "token", "weight")), keys)
    more = asked.join(hits, ["doc_id", "token"]).select(*keys, "doc_id", F.col("weight").alias("shared"))
    return sums.unionByName(more).groupBy(*keys, "doc_id").agg(F.sum("shared").alias("shared"))


def _best(sums: DataFrame, keys: list[str], most: int) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.desc("shared"), "doc_id")
    return sums.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)


def prefix_tokens(weighted: DataFrame, hits: DataFrame, keys: list[str], most: int) -> tuple[DataFrame, DataFrame]:
    """(tokens, seeds): ``weighted`` with ``bound`` and ``prefix``, and the sums over seed tokens.

    ``bound`` is a sum that at least ``most`` texts of the claim reach (0 if fewer are known): the best texts of the seeds
    are summed in full. A text with none of the tokens whose ``rest`` is at least the bound has a smaller sum than these,
    so it is not among the best. These tokens and the seeds are the claim's prefix.
    """
    seeds = materialize(_sums(weighted.where("seed"), hits, keys), "seeds")
    full = _completed(materialize(_best(seeds, keys, SEED_BEST * most).drop("rank"), "seed-best"), weighted.where("NOT seed"), hits, keys)
    bound = _best(full, keys, most).where(F.col("rank") == most).select(*keys, F.col("shared").alias("bound"))
    bounded = weighted.join(told(materialize(bound, "bounds")), keys, "left").fillna(0, ["bound"])
    return materialize(bounded.withColumn("prefix", F.col("seed") | (F.col("rest") >= F.col("bound"))), "prefixes"), seeds


def best_texts(claim_rows: DataFrame, evidence: DataFrame, keys: list[str], most: int = 5) -> DataFrame:
    """(keys, doc_id, shared, rank): the ``most`` texts of each claim with the largest summed weights, then by doc_id.

    Texts come from the tokens of each claim's prefix only; those whose sum could still reach the bound are summed over
    the claim's other tokens.
    """
    weighted, hits = claim_tokens(claim_rows, evidence, keys)
    tokens, seeds = prefix_tokens(weighted, hits, keys, most)
    limits = tokens.groupBy(*keys).agg(F.max("bound").alias("bound"), F.coalesce(F.sum(F.when(~F.col("prefix"), F.col("weight"))), F.lit(0)).alias("beyond"))
    sums = seeds.unionByName(_sums(tokens.where("prefix AND NOT seed"), hits, keys)).groupBy(*keys, "doc_id").agg(F.sum("shared").alias("shared"))
    near = sums.join(told(materialize(limits, "limits")), keys).where(F.col("shared") + F.col("beyond") >= F.col("bound"))
    return _best(_completed(materialize(near.select(*keys, "doc_id", "shared"), "near"), tokens.where("NOT prefix"), hits, keys), keys, most)


def evidence_pairs(claim_rows: DataFrame, evidence: DataFrame, keys: list[str], most: int = 5) -> DataFrame:
    """Each claim with its ``most`` best evidence texts: by summed weights of shared tokens, then by doc_id.

    ``evidence``: doc_id (one row each), text, source. Whole texts are searched, and every token counts, with the weight
    round(1000 ln(1 + texts / texts that hold it)); whole numbers, so that sums do not depend on their order.
    """
    evidence = dealt(evidence.select("doc_id", "text", "source"))
    top = materialize(best_texts(claim_rows, evidence, keys, most).join(claim_rows, keys), "top")
    found = evidence.join(told(materialize(top.select("doc_id").distinct(), "found")), "doc_id", "left_semi")
    return with_cues(found.repartition("doc_id"), "text").join(told(top), "doc_id")  # once for each text, however many claims find it


def with_cues(evidence: DataFrame, text: str) -> DataFrame:
    """Adds what a label needs of a text: its first tokens and the weight of its refuting cues."""
    return evidence.withColumn("label_tokens", T.significant_tokens(F.col(text), LABEL_TOKENS)).withColumn("cue", T.refuting_cues(F.col(text)))


def lexical_label(pairs: DataFrame, claim: str = "claim", evidence: str = "text") -> DataFrame:
    """Label and scores from token overlap and refuting cues: nli_label, supporting, refuting, neutral, relevance.

    The overlap of a claim with a found text looks at LABEL_TOKENS tokens of each, which is the label's definition. Pairs
    of ``evidence_pairs`` bring ``label_tokens`` and ``cue`` along; others get them here.
    """
    if "label_tokens" not in pairs.columns:
        pairs = with_cues(pairs, evidence)
    # each side is bound to a lambda's variable: a column named within a lambda is computed again for each of its elements
    own, other = T.significant_tokens(F.col(claim), LABEL_TOKENS), F.col("label_tokens")
    share = lambda o, e: F.when(F.size(o) == 0, 0.0).otherwise(F.size(F.filter(o, lambda t: F.array_contains(e, t))) / F.size(o))
    p = pairs.withColumn("ratio", F.element_at(F.zip_with(F.array(own), F.array(other), share), 1))
    ratio = F.col("ratio")
    p = p.withColumn("nli_label", F.when((F.col("cue") > 0) & (ratio >= 0.35), "refute").when(ratio >= 0.42, "support").otherwise("neutral"))
    refute, support, neutral = (F.col("nli_label") == x for x in ("refute", "support", "neutral"))
    p = p.withColumn("confidence", F.when(refute, T.clamp(0.55 + F.col("cue") + ratio * 0.2, 0.55, 0.86)).otherwise(T.clamp(0.35 + ratio * 0.45, 0.25, 0.78)))
    return (
        p.withColumn("supporting", F.when(support, F.col("confidence")).otherwise(0.08))
        .withColumn("refuting", F.when(refute, F.col("confidence")).otherwise(0.05))
        .withColumn("neutral", F.when(neutral, F.col("confidence")).otherwise(1 - F.col("confidence")))
        .withColumn("relevance", T.clamp(0.15 + ratio * 0.6, 0.15, 0.75))
        .drop("label_tokens", "cue")
    )


def beta_fold(labels: DataFrame, keys: list[str], claim_rows: DataFrame | None = None) -> DataFrame:
    """alpha, beta and p_true per claim: evidence that is neutral or not labelled does not count.

    With ``claim_rows`` every claim has a row; one without evidence keeps the prior, alpha = beta = 1.
    """
    counts = ~F.col("nli_label").isin("neutral", "nli_unavailable")
    out = labels.groupBy(*keys).agg(
        (1 + F.sum(F.when(counts, F.col("supporting")).otherwise(0.0))).alias("alpha"),
        (1 + F.sum(F.when(counts, F.col("refuting")).otherwise(0.0))).alias("beta"),
        F.count("*").alias("n_evidence"),
    )
    if claim_rows is not None:
        out = claim_rows.select(*keys).join(out, keys, "left").fillna(1.0, ["alpha", "beta"]).fillna(0, ["n_evidence"])
    return out.withColumn("p_true", F.col("alpha") / (F.col("alpha") + F.col("beta")))


def doc_product(beliefs: DataFrame, keys: list[str], p: str = "p_true") -> DataFrame:
    """Independent claims: the product of clipped probabilities; a single claim's is not clipped."""
    return beliefs.groupBy(*keys).agg(
        F.count("*").alias("n_claims"),
        F.when(F.count("*") == 1, F.max(p)).otherwise(F.exp(F.sum(F.log(T.clamp(F.col(p), 1e-6, 1 - 1e-6))))).alias("doc_score"),
    )


def _signal(score: str, kept: Column) -> Column:
    value = F.when(kept, T.clamp(F.col(score) * F.coalesce(F.col("credibility"), F.lit(0.7)) * F.col("relevance"), 0, 1))
    return F.coalesce(T.clamp(F.max(value) * 0.75 + T.clamp(F.avg(value), 0, 1) * 0.25, 0, 1), F.lit(0.0))


def logit_verdicts(labels: DataFrame, keys: list[str], claim_rows: DataFrame | None = None, coverage_target: float = 0.9, floor: float = 0.4) -> DataFrame:
    """p_true, interval and review flag per claim from its labelled evidence (credibility may be null).

    With ``claim_rows`` every claim has a row; one without evidence is all neutral, with the full penalty, for review.
    """
    relevant = F.col("relevance") >= floor
    supports = (F.col("nli_label") == "support") & (F.col("supporting") >= 0.35) & relevant
    refutes = (F.col("nli_label") == "refute") & (F.col("refuting") >= 0.35) & relevant
    v = labels.groupBy(*keys).agg(
        _signal("supporting", supports).alias("support"),
        _signal("refuting", refutes).alias("refute"),
        F.avg(F.when((F.col("nli_label") == "neutral") | ~relevant, 1.0).otherwise(0.0)).alias("neutral_share"),
        F.avg("relevance").alias("mean_relevance"),
    )
    if claim_rows is not None:
        v = claim_rows.select(*keys).join(v, keys, "left").fillna(0.0, ["support", "refute"]).fillna(1.0, ["neutral_share"])
    bare = F.col("mean_relevance").isNull()
    penalty = F.when(bare, 0.3).otherwise(T.clamp(0.28 * (1 - F.col("mean_relevance")), 0, 0.28))
    logit = -0.25 + 2.0 * F.col("support") - 3.1 * F.col("refute") - 0.2 * F.col("neutral_share") - penalty
    v = v.withColumn("p", T.clamp(1 / (1 + F.exp(-logit)), 0.03, 0.97)).withColumn("strength", T.clamp(F.greatest("support", "refute"), 0, 1))
    v = v.withColumn("width", T.clamp(0.34 - F.col("strength") * 0.16 + (coverage_target - 0.8) * 0.2, 0.12, 0.42))
    v = v.withColumn("low", T.round4(T.clamp(F.col("p") - F.col("width") / 2, 0, 1))).withColumn("high", T.round4(T.clamp(F.col("p") + F.col("width") / 2, 0, 1)))
    return v.select(*keys, T.round4(F.col("p")).alias("p_true"), "low", "high", T.round4(F.col("strength")).alias("gain"), (bare | ((F.col("high") - F.col("low")) > 0.35)).alias("review"))


def geo_mean(verdicts: DataFrame, keys: list[str]) -> DataFrame:
    """Document score as geometric mean, its interval, and the claims' agreement."""
    v = verdicts.groupBy(*keys).agg(
        F.exp(F.avg(F.log(T.clamp(F.col("p_true"), 0.001, 0.999)))).alias("s"),
        F.min("low").alias("lo"),
        F.max("high").alias("hi"),
        F.when(F.count("*") <= 1, 1.0).otherwise(T.clamp(1 - F.stddev_pop("p_true"), 0, 1)).alias("consistency"),
    )
    return v.select(*keys, T.round4(F.col("s")).alias("doc_score"), T.round4(T.clamp(F.least("lo", "s"), 0, 1)).alias("doc_low"), T.round4(T.clamp(F.greatest("hi", "s"), 0, 1)).alias("doc_high"), T.round4(F.col("consistency")).alias("consistency"))


def nli_vote(samples: DataFrame, keys: list[str]) -> DataFrame:
    """Majority label (first seen on ties), the winners' mean scores renormalized, confidence under 0.05 to 0.

    ``samples``: keys, ord, label, supporting, refuting, neutral, confidence, reasoning.
    """
    counts = samples.groupBy(*keys, "label").agg(F.count("*").alias("votes"), F.min("ord").alias("first"))
    win = counts.groupBy(*keys).agg(F.max_by("label", F.struct("votes", -F.col("first"))).alias("label"))
    won = samples.join(win, [*keys, "label"])
    out = won.groupBy(*keys, "label").agg(
        F.avg("supporting").alias("s"), F.avg("refuting").alias("r"), F.avg("neutral").alias("n"), F.avg("confidence").alias("c"),
        F.max_by("reasoning", F.struct("confidence", -F.col("ord"))).alias("reasoning"),
    )
    total = F.col("s") + F.col("r") + F.col("n")
    share = lambda x: F.when(total > 0, F.col(x) / total).otherwise(F.lit(1 / 3))
    return out.select(*keys, "label", share("s").alias("supporting"), share("r").alias("refuting"), share("n").alias("neutral"), F.when(F.col("c") < 0.05, 0.0).otherwise(F.col("c")).alias("confidence"), "reasoning")


def combine_opinions(pairs: DataFrame) -> DataFrame:
    """Two models' opinions (structs ``a`` and ``b``, either null): agreement, disagreement and single rules.

    A struct has label, confidence, supporting, refuting, neutral and relevance. Without both the row has nulls.
    """
    a, b = F.col("a"), F.col("b")
    both, one = a.isNotNull() & b.isNotNull(), F.coalesce(a, b)
    same = a["label"] == b["label"]
    any_refute = (a["label"] == "refute") | (b["label"] == "refute")
    against = F.when(a["label"] == "refute", a).otherwise(b)
    mean = lambda k: (a[k] + b[k]) / 2
    pick = lambda agree, refuted, split, solo: F.when(both & same, agree).when(both & any_refute, refuted).when(both, split).otherwise(solo)
    low, high = (lambda k: F.least(a[k], b[k])), (lambda k: F.greatest(a[k], b[k]))
    return pairs.select(
        *[c for c in pairs.columns if c not in ("a", "b")],
        pick(a["label"], F.lit("refute"), F.lit("neutral"), one["label"]).alias("label"),
        pick(mean("confidence"), against["confidence"] * 0.7, low("confidence") * 0.6, one["confidence"] * 0.85).alias("confidence"),
        pick(mean("supporting"), low("supporting"), low("supporting") * 0.5, one["supporting"] * 0.85).alias("supporting"),
        pick(mean("refuting"), against["refuting"] * 0.7, low("refuting"), one["refuting"]).alias("refuting"),
        pick(mean("neutral"), high("neutral"), high("neutral"), one["neutral"]).alias("neutral"),
        pick(low("relevance"), low("relevance"), low("relevance"), one["relevance"] * 0.9).alias("relevance"),
    )


# Reliability by source, bonus by kind of match.
RELIABILITY = {"graph_exact": 1.0, "graph_inferred": 0.9, "vector_semantic": 0.85, "academic": 0.9, "pubmed": 0.95, "clinical_trials": 0.9, "wikipedia": 0.8, "knowledge_graph": 0.8, "news": 0.65, "world_bank": 0.85, "osv": 0.9, "external_api": 0.7}
MATCH_BONUS = {"exact": 0.15, "partial": 0.05, "wikidata_lookup": 0.12, "quality_filtered": 0.10, "enhanced_quality": 0.10, "geographic_proximity": 0.05}


def evidence_quality(e: DataFrame) -> DataFrame:
    """quality, reliability and weighted value of evidence.

    Columns: similarity, source, match_type, class_conf, ingest_quality, pagerank, is_disambiguation, is_redirect,
    has_wikidata, has_coordinates, incoming_links. A similarity of zero counts as missing.
    """
    pick = lambda table, key, other: F.coalesce(F.create_map(*[F.lit(x) for kv in table.items() for x in kv])[F.col(key)], F.lit(other))
    flag, q, one = (lambda c: F.coalesce(F.col(c), F.lit(False))), F.col("quality"), F.lit(1.0)
    steps = [  # in this order; one column each, as later steps use a value twice
        F.when(F.col("similarity").isNull() | (F.col("similarity") == 0), 0.5).otherwise(F.col("similarity")),
        F.least(one, q + pick(MATCH_BONUS, "match_type", 0.0)),
        F.when(F.col("class_conf").isNotNull(), F.least(one, (q + F.col("class_conf")) / 2)).otherwise(q),
        F.when(F.col("ingest_quality").isNotNull(), q * 0.6 + F.col("ingest_quality") * 0.4).otherwise(q),
        F.when(F.col("pagerank") > 0, F.least(one, q + F.least(F.lit(0.1), F.log10(F.col("pagerank") * 1_000_000 + 1) / 60))).otherwise(q),
        F.when(flag("is_disambiguation"), q * 0.6).otherwise(q),
        F.when(flag("is_redirect"), q * 0.5).otherwise(q),
        F.when(flag("has_wikidata"), F.least(one, q + 0.05)).otherwise(q),
        F.when(flag("has_coordinates"), F.least(one, q + 0.03)).otherwise(q),
        F.when(F.col("incoming_links") > 100, F.least(one, q + F.least(F.lit(0.08), F.log10(F.col("incoming_links") + 1) / 50))).otherwise(q),
    ]
    for step in steps:
        e = e.withColumn("quality", step)
    r = pick(RELIABILITY, "source", 0.5)
    r = F.when(flag("is_disambiguation"), r * 0.7).otherwise(r)
    r = F.when(flag("is_redirect"), r * 0.5).otherwise(r)
    return e.withColumn("reliability", r).withColumn("weighted", F.col("quality") * F.col("reliability"))


def keep_until_sufficient(e: DataFrame, keys: list[str], order: list[str], least: int = 3, high: int = 2, value: float = 2.0) -> DataFrame:
    """Evidence in arrival order up to the first row at which there is enough: by number with enough of high quality,
    or by summed weighted value."""
    w = Window.partitionBy(*keys).orderBy(*order)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    n, h, v = F.count("*").over(before), F.sum(F.when(F.col("quality") >= 0.7, 1).otherwise(0)).over(before), F.sum("weighted").over(before)
    enough = ((n >= least) & (F.coalesce(h, F.lit(0)) >= high)) | (F.coalesce(v, F.lit(0.0)) >= value)
    return e.withColumn("_enough", enough).where("NOT _enough").drop("_enough")
