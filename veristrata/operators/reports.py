"""Report metrics, source choice, provenance graphs and small rules around retrieval."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T
from ..session import materialize, running
from .graph import undirected
from .metrics import ratio

# Fixed values.
DOMAIN_WORDS = {
    "medical": ("patient", "disease", "treatment", "hospital", "medicine", "symptom"),
    "technical": ("software", "code", "api", "database", "algorithm", "python"),
    "science": ("research", "experiment", "physics", "chemistry", "biology"),
    "legal": ("law", "court", "legal", "regulation", "contract"),
    "finance": ("stock", "market", "investment", "bank", "economy"),
}
WEIGHTED_DOMAINS = ("general", "biomedical", "legal", "code", "social")


def question_accuracy(q: DataFrame, keys: list[str]) -> DataFrame:
    """n, accuracy, and accuracy of questions with one (mc1) and with several right answers (mc2), null without any."""
    hit = F.col("correct").cast("double")
    return q.groupBy(*keys).agg(F.count("*").alias("n"), F.round(F.avg(hit), 4).alias("accuracy"), F.round(F.avg(F.when(F.col("single"), hit)), 4).alias("mc1"), F.round(F.avg(F.when(~F.col("single"), hit)), 4).alias("mc2"))


def tfidf_cosine(texts: DataFrame, key: str, side: str, text: str, left: str, right: str) -> DataFrame:
    """(key, cosine) of the smoothed tf-idf vectors of the two sides' texts; sides without words have no row.

    idf = ln((1 + vectors) / (1 + vectors with the word)) + 1, over all vectors.
    """
    w = texts.select(key, side, F.explode(F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))).alias("w"))
    tf = w.groupBy(key, side, "w").agg(F.count("*").alias("n"))
    tf = materialize(tf, "tf")
    vectors = tf.select(key, side).distinct().count()
    df = tf.groupBy("w").agg(F.count("*").alias("df"))
    v = tf.join(df, "w").withColumn("x", F.col("n") * (F.log(F.lit(1 + vectors) / (1 + F.col("df"))) + 1))
    own = lambda s: F.sum(F.when(F.col(side) == s, F.col("x")))
    cells = v.groupBy(key, "w").agg(F.coalesce(own(left), F.lit(0.0)).alias("a"), F.coalesce(own(right), F.lit(0.0)).alias("b"))
    sums = cells.groupBy(key).agg(F.sum(F.col("a") * F.col("b")).alias("d"), F.sqrt(F.sum(F.col("a") * F.col("a"))).alias("na"), F.sqrt(F.sum(F.col("b") * F.col("b"))).alias("nb"))
    return sums.where("na > 0 AND nb > 0").select(key, (F.col("d") / (F.col("na") * F.col("nb"))).alias("cosine"))


def citations(answers: DataFrame, key: str, text: str = "text", n: str = "n_evidence") -> DataFrame:
    """Citation marks [k] of each answer; valid ones point at one of its ``n`` pieces of evidence."""
    marks = F.transform(F.regexp_extract_all(text, F.lit(r"\[([0-9]+)\]"), F.lit(1)), lambda x: x.cast("long"))
    said = F.filter(F.transform(F.split(text, r"[.!?\n]+"), lambda s: F.trim(s)), lambda s: s != "")
    words = F.filter(F.split(text, T.SPACES), lambda w: w != "")
    a = answers.select(key, marks.alias("m"), said.alias("s"), F.size(words).alias("w"), F.col(n).alias("n"))
    size = lambda c: F.size(c).cast("long")
    return a.select(key, size("m").alias("markers"), size(F.filter("m", lambda x: x.between(1, F.col("n")))).alias("valid"), size("s").alias("sentences"), size(F.filter("s", lambda x: x.rlike(r"\[[0-9]+\]"))).alias("cited"), (100.0 * F.size("m") / F.greatest(F.lit(1), F.col("w"))).alias("per_100_words"))


SCORES = ("accuracy", "precision", "recall", "f1", "safety", "truthfulqa", "factscore", "speed", "selective", "relevance")


def summary_scores(card: DataFrame, key: str) -> DataFrame:
    """(key, score, value): ten scores from 0 to 1, higher is better, of a card (one row for each evaluator).

    ``card``: accuracy, precision, recall, f1, pass_rate, truthfulqa, factscore, p95 (milliseconds), aurc, faithfulness;
    missing values count as none: 0, but 1 for safety and for selective.
    """
    none = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    values = {c: none(c) for c in ("accuracy", "precision", "recall", "f1", "truthfulqa", "factscore")}
    values |= {"safety": 1 - none("pass_rate"), "speed": F.when(F.col("p95") > 0, F.least(F.lit(1.0), 1000 / F.col("p95"))).otherwise(0.0)}
    values |= {"selective": F.when(none("aurc") >= 0, 1 / (1 + none("aurc"))).otherwise(0.0), "relevance": none("faithfulness")}
    return card.select(key, F.explode(F.array(*[F.struct(F.lit(c).alias("score"), values[c].cast("double").alias("value")) for c in SCORES])).alias("s")).select(key, "s.score", "s.value")


#: Metrics that evaluators are ranked by, and whether more is better.
RANKED = {"accuracy": True, "f1": True, "factscore": True, "truthfulqa": True, "p95": False, "pass_rate": False, "aurc": False, "ndcg": True, "recall_at_10": True, "faithfulness": True}


def rankings(card: DataFrame, key: str) -> DataFrame:
    """(key, metric, place) of each evaluator by ten metrics; equal ones share a place, a latency of none comes last.

    One row for each evaluator is ordered, so the window over all of them is small.
    """
    value = {m: F.when(F.col(m) > 0, -F.col(m)) if m == "p95" else F.col(m) if more else -F.col(m) for m, more in RANKED.items()}
    long = card.select(key, F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), v.cast("double").alias("v")) for m, v in value.items()])).alias("s")).select(key, "s.metric", "s.v")
    return long.select(key, "metric", F.rank().over(Window.partitionBy("metric").orderBy(F.desc_nulls_last("v"))).alias("place"))


def rag_proxies(units: DataFrame, key: str, supported: float = 0.2, relevant: float = 0.1) -> DataFrame:
    """Five proxies of each sample: answer_relevancy, context_precision, context_recall, context_utilization, faithfulness.

    ``units`` (key, kind, ord, text) has a sample's question, answer, contexts and, where there is one, truth. All are vectors
    of smoothed tf-idf over the whole table; an answer's sentences are weighted by the same words. Cosines are formed
    within a sample only: question and answer; contexts with question, truth, answer and each sentence. A sample without
    contexts has no row, one without a truth no recall, and one without sentences no faithfulness.
    """
    sentences = units.where("kind = 'answer'").select(key, F.lit("sentence").alias("kind"), F.posexplode(F.filter(F.transform(F.split("text", r"[.!?\n]+"), lambda x: F.trim(x)), lambda x: x != "")).alias("ord", "text"))
    every = materialize(units.select(key, "kind", F.col("ord").cast("int").alias("ord"), "text").where("trim(text) <> ''").unionByName(sentences), "units")
    words = every.select(key, "kind", "ord", F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9]+"), F.lit(0))).alias("w"))
    tf = materialize(words.groupBy(key, "kind", "ord", "w").agg(F.count("*").alias("n")), "tf")
    whole = F.col("kind") != "sentence"
    df = tf.where(whole).groupBy("w").agg(F.count("*").alias("df"))
    total = every.where(whole).count()
    x = tf.join(df, "w").withColumn("x", F.col("n") * (F.log(F.lit(1 + total) / (1 + F.col("df"))) + 1))
    norms = x.groupBy(key, "kind", "ord").agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm"))
    v = materialize(x.join(norms, [key, "kind", "ord"]).select(key, "kind", "ord", "w", (F.col("x") / F.col("norm")).alias("x")), "vectors")

    def cosines(left: str, right: str) -> DataFrame:
        a = every.where(F.col("kind") == left).select(key, F.col("ord").alias("a"))
        pairs = a.join(every.where(F.col("kind") == right).select(key, F.col("ord").alias("b")), key)
        dots = v.where(F.col("kind") == left).select(key, "w", F.col("ord").alias("a"), F.col("x").alias("xa")).join(v.where(F.col("kind") == right).select(key, "w", F.col("ord").alias("b"), F.col("x").alias("xb")), [key, "w"])
        return pairs.join(dots.groupBy(key, "a", "b").agg(F.sum(F.col("xa") * F.col("xb")).alias("c")), [key, "a", "b"], "left").fillna(0.0, ["c"])

    share = lambda c, least: F.avg(F.when(F.col(c) >= least, 1.0).otherwise(0.0))
    out = cosines("question", "context").groupBy(key).agg(share("c", relevant).alias("context_precision"))
    out = out.join(cosines("question", "answer").groupBy(key).agg(F.max("c").alias("answer_relevancy")), key, "left")
    for kind, name in (("answer", "context_utilization"), ("truth", "context_recall")):
        out = out.join(cosines(kind, "context").groupBy(key).agg(F.max("c").alias(name)), key, "left")
    best = cosines("sentence", "context").groupBy(key, "a").agg(F.max("c").alias("c"))
    return out.join(best.groupBy(key).agg(share("c", supported).alias("faithfulness")), key, "left")


def union_first(sets: list[DataFrame], keys: list[str]) -> DataFrame:
    """Rows of several sets; of those equal in ``keys`` the one from the first set, named by ``way`` from 1."""
    rows = reduce(DataFrame.unionByName, [s.withColumn("way", F.lit(i + 1)) for i, s in enumerate(sets)])
    values = [c for c in rows.columns if c not in (*keys, "way")]
    best = rows.groupBy(*keys).agg(F.min(F.struct("way", *values)).alias("v"))
    return best.select(*keys, "v.way", *[f"v.{c}" for c in values])


def only_without(rows: DataFrame, other: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose keys the other set lacks: a search that is asked only where another found nothing."""
    return rows.join(other.select(*keys).distinct(), keys, "left_anti")


def progress_events(records: DataFrame, key: str, at: str, order: str, every: int) -> DataFrame:
    """(key, processed, total_estimate, rate, eta_hours) after every ``every``-th record of each pass, by time.

    ``at`` is in microseconds; the rate counts records a second since the pass began. Records are numbered over ranges, so a pass of
    any length is spread over many tasks.
    """
    numbered = running(records.select(key, at, order), [key], [F.col(at), F.col(order)], {"processed": F.lit(1)})
    start = records.groupBy(key).agg(F.min(at).alias("_start"))  # a row for each pass
    r = numbered.where(F.col("processed") % every == 0).join(F.broadcast(start), key)
    rate = F.col("processed") / F.greatest((F.col(at) - F.col("_start")) / 1e6, F.lit(1e-6))
    r = r.withColumn("rate", rate).withColumnRenamed("total", "total_estimate")
    return r.select(key, "processed", "total_estimate", "rate", (F.greatest(F.lit(0), F.col("total_estimate") - F.col("processed")) / F.col("rate") / 3600).alias("eta_hours"))


def select_sources(r: DataFrame, key: str, available: Column, least: float, most: int) -> DataFrame:
    """(key, source, selected): of the sources that are there and relevant enough the ``most`` best; ties by name."""
    r = r.withColumn("_fits", available & (F.col("relevance") >= least))
    w = Window.partitionBy(key, "_fits").orderBy(F.desc("relevance"), "source")
    return r.withColumn("_k", F.row_number().over(w)).select(key, "source", (F.col("_fits") & (F.col("_k") <= most)).alias("selected"))


def keyword_domain(c: Column) -> Column:
    low, out = F.lower(c), F.lit("general")
    for name, words in reversed(DOMAIN_WORDS.items()):
        out = F.when(reduce(lambda a, b: a | b, [low.contains(w) for w in words]), F.lit(name)).otherwise(out)
    return out


def difficulty(c: Column) -> Column:
    n = F.size(F.filter(F.split(c, T.SPACES), lambda w: w != ""))
    return F.when(n <= 15, "easy").when(n <= 30, "medium").otherwise("hard")


def domain_weights(domain: Column) -> Column:
    """Weights of all domains: most for the assigned one, a little more than the rest for the general one."""
    weight = lambda d: F.when(domain == d, 0.8).otherwise(0.1 if d == "general" else 0.05)
    return F.create_map(*[x for d in WEIGHTED_DOMAINS for x in (F.lit(d), weight(d))])


def mesh_nodes(evidence: DataFrame) -> DataFrame:
    """(claim, kind, id, depth, weight): the claim, its sources and their evidence (claim, doc_id, source, weight)."""
    row = lambda kind, name, depth, weight: [F.lit(kind).alias("kind"), name.alias("id"), F.lit(depth).alias("depth"), weight.alias("weight")]
    center = evidence.select("claim").distinct().select("claim", *row("claim", F.concat(F.lit("c"), F.col("claim").cast("string")), 0, F.lit(1.0)))
    sources = evidence.groupBy("claim", "source").agg(F.count("*").alias("n")).select("claim", *row("source", F.concat(F.lit("s"), "source"), 1, F.least(F.lit(1.0), F.col("n") / 10)))
    return center.union(sources).union(evidence.select("claim", *row("evidence", F.concat(F.lit("e"), F.col("doc_id").cast("string")), 2, F.col("weight"))))


def mesh_entities(relations: DataFrame, most: int = 20) -> DataFrame:
    """Entity nodes of a claim's first ``most`` relationships (claim, ord, left, right), each once."""
    k = F.row_number().over(Window.partitionBy("claim").orderBy("ord"))
    first = relations.withColumn("k", k).where(F.col("k") <= most)
    ends = first.select("claim", F.explode(F.array("left", "right")).alias("name")).where("name <> ''").distinct()
    return ends.select("claim", F.lit("entity").alias("kind"), F.concat(F.lit("x"), "name").alias("id"), F.lit(3).alias("depth"), F.lit(0.5).alias("weight"))


def mesh_facts(neighbours: DataFrame, most: int = 15) -> DataFrame:
    """Fact nodes of a claim's ``most`` nearest texts (claim, doc_id, weight, score)."""
    k = F.row_number().over(Window.partitionBy("claim").orderBy(F.desc("score"), "doc_id"))
    near = neighbours.withColumn("k", k).where(F.col("k") <= most)
    return near.select("claim", F.lit("fact").alias("kind"), F.concat(F.lit("f"), F.col("doc_id").cast("string")).alias("id"), F.lit(3).alias("depth"), "weight")


def mesh_edges(evidence: DataFrame) -> DataFrame:
    """(claim, src, dst, type): claims ask sources, sources provide evidence."""
    s = F.concat(F.lit("s"), "source")
    asks = evidence.select("claim", F.concat(F.lit("c"), F.col("claim").cast("string")).alias("src"), s.alias("dst"), F.lit("ASKS").alias("type")).distinct()
    return asks.union(evidence.select("claim", s.alias("src"), F.concat(F.lit("e"), F.col("doc_id").cast("string")).alias("dst"), F.lit("PROVIDES").alias("type")))


def run_limit(source: Column, strategy: Column, asked: Column, most: int = 5000) -> Column:
    """Asked number of items, or the default of its source and strategy, within 1 and ``most``."""
    usual = F.when((source == "wikipedia") & (strategy == "random"), 2000).otherwise(50)
    return F.least(F.lit(most), F.greatest(F.lit(1), F.coalesce(F.nullif(asked, F.lit(0)), usual))).cast("long")


def short_label(c: Column, most: int = 50) -> Column:
    return F.when(F.length(c) <= most, c).otherwise(F.concat(F.substring(c, 1, most - 1), F.lit("…")))


def content_of(title: Column, snippet: Column, extract: Column) -> Column:
    """A result's text: a snippet of 40 characters at least, else the extract, else the title alone."""
    return F.when(F.length(F.trim(snippet)) >= 40, F.concat(title, F.lit(": "), snippet)).when(extract != "", F.concat(title, F.lit(": "), extract)).otherwise(title)


def entity_search(nodes: DataFrame, edges: DataFrame, claim: str) -> DataFrame:
    """(id, type, other): one undirected hop from nodes whose name holds a capitalized word of one claim."""
    words = [w.strip(".,;:!?") for w in claim.split() if w[:1].isupper()]
    hit = reduce(lambda a, b: a | b, [F.lower("name").contains(w.lower()) for w in words], F.lit(False))
    starts = nodes.where(hit).select(F.col("id").alias("src")).distinct()
    return undirected(edges).join(starts, "src", "left_semi").select(F.col("src").alias("id"), "type", F.col("dst").alias("other")).distinct()
