"""Model answers as columns: claims and labels parsed from JSON texts, entity spans, opinions turned to distributions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

# Fixed values.
CLAIM_TYPES = ("subject_predicate_object", "temporal", "quantitative", "comparative", "causal", "definitional", "existential")
SPAN_STOP = ("the", "a", "an", "is", "was", "were", "are", "be", "been", "being", "did", "do", "does", "has", "have", "had", "of", "in", "on", "at", "to", "for", "with", "by", "from", "and", "or", "but")
STARTERS = ("the", "a", "an", "this", "that", "it", "is", "was", "are", "were")
NLI_LABELS = ("support", "refute", "neutral")


def answer_json(c: Column) -> Column:
    """The JSON of a model's answer: a fenced block (closed or cut off) that begins as JSON, else the whole answer, else
    its part from the first opening to the last closing brace or bracket. Null if none of them parses."""
    fenced = F.trim(F.regexp_extract(c, r"(?is)```(?:json)?[ \t\n\r]*(.*?)(?:```|\z)", 1))
    body = F.when(fenced.rlike(r"^[{\[]"), fenced).otherwise(F.trim(c))
    part = F.coalesce(F.nullif(F.regexp_extract(body, r"(?s)\{.*\}", 0), F.lit("")), F.regexp_extract(body, r"(?s)\[.*\]", 0))
    return F.coalesce(F.try_parse_json(body), F.try_parse_json(part))


def claim_type(c: Column) -> Column:
    low = F.lower(F.coalesce(c, F.lit("unclassified")))
    return F.when(low.isin(*CLAIM_TYPES), low).otherwise("unclassified")


def parse_claims(rows: DataFrame, keys: list[str], answer: str = "answer", text: str = "text", offset: str | None = None) -> DataFrame:
    """(keys, ord, claim, claim_type, confidence, lo, hi): claims of a model's answer, with their place in the text.

    An answer that does not parse, or has no list of claims, gives the sentences of the text. The place is that of the
    claim's first 50 characters in any case, moved by ``offset``; null if they do not occur.
    """
    v = rows.withColumn("_v", answer_json(F.col(answer)))
    array = lambda path: F.try_variant_get("_v", path, "array<variant>")
    v = v.withColumn("_items", F.coalesce(array("$.claims"), array("$")))
    get = lambda x, path, kind="string": F.try_variant_get(x, path, kind)
    read = F.transform("_items", lambda x: F.struct(F.trim(F.coalesce(get(x, "$.text"), F.lit(""))).alias("claim"), claim_type(get(x, "$.claim_type")).alias("claim_type"), F.coalesce(get(x, "$.confidence", "double"), F.lit(0.8)).alias("confidence")))
    plain = F.transform(T.fallback_sentences(F.col(text)), lambda s: F.struct(s.alias("claim"), F.lit("unclassified").alias("claim_type"), F.lit(0.8).alias("confidence")))
    found = F.filter(F.when(F.col("_items").isNull(), plain).otherwise(read), lambda x: x["claim"] != "")
    c = v.select(*keys, F.col(text).alias("_text"), *([F.col(offset).alias("_offset")] if offset else []), F.posexplode(found).alias("ord", "_c"))
    at = F.expr("locate(substring(lower(_c.claim), 1, 50), lower(_text))")
    lo = F.when(at > 0, at - 1 + (F.col("_offset") if offset else F.lit(0)))
    return c.select(*keys, "ord", "_c.claim", "_c.claim_type", "_c.confidence", lo.alias("lo"), (lo + F.length("_c.claim")).alias("hi"))


def decomposition_coverage(n_claims: Column, text: Column) -> Column:
    """Claims per closing mark of the text, at most 1; 0 for an empty text."""
    marks = F.greatest(F.lit(1), F.size(F.regexp_extract_all(text, F.lit("[.!?]+"), F.lit(0))))
    return F.when(F.trim(text) == "", 0.0).otherwise(F.least(F.lit(1.0), n_claims / marks))


def _words(c: Column) -> Column:
    return F.filter(F.split(c, T.SPACES), lambda w: w != "")


def _runs(words: Column, inside) -> Column:
    """Runs of neighbouring words that ``inside`` holds for, each joined by spaces."""
    marked = F.array_join(F.transform(words, lambda w: F.when(inside(w), w).otherwise(T.MARK)), " ")
    return F.filter(F.transform(F.split(marked, T.MARK), lambda r: F.trim(r)), lambda r: r != "")


def capitalized_spans(c: Column) -> Column:
    """Runs of words that begin with a capital and are no stop words, in order."""
    words = _words(F.regexp_replace(c, r'[".,;:!?()\[\]]', " "))
    return _runs(words, lambda w: w.rlike(r"^\p{Lu}") & ~F.lower(w).isin(*SPAN_STOP))


def routed_entities(c: Column, most: int = 10) -> Column:
    """Distinct capitalized runs; common first words are passed over without ending a run."""
    capital = lambda w: w.rlike(r"^\p{Lu}.")
    words = F.filter(_words(c), lambda w: ~(capital(w) & F.lower(w).isin(*STARTERS)))
    runs = _runs(F.transform(words, lambda w: F.when(capital(w), F.coalesce(F.nullif(F.regexp_replace(w, r"[.,;:!?]+$", ""), F.lit("")), w)).otherwise(w)), lambda w: w.rlike(r"^\p{Lu}"))
    return F.slice(F.array_distinct(F.filter(runs, lambda r: F.length(r) > 1)), 1, most)


def parse_label(rows: DataFrame, answer: str = "answer") -> DataFrame:
    """Adds label, supporting, refuting, neutral (they sum to 1), confidence and reasoning read from a JSON answer.

    Anything wrong (no JSON, unknown label, a score that is no number or missing, a sum of 0 or less) gives the
    sentinel: neutral, a third each, confidence 0, reasoning nli_unavailable.
    """
    get = lambda path, kind="double": F.try_variant_get("_v", path, kind)
    r = rows.withColumn("_v", F.try_parse_json(answer)).withColumn("_label", get("$.label", "string"))
    r = r.withColumn("_s", get("$.supporting_score")).withColumn("_r", get("$.refuting_score")).withColumn("_n", get("$.neutral_score"))
    r = r.withColumn("_t", F.col("_s") + F.col("_r") + F.col("_n"))
    fine = F.coalesce(F.col("_label").isin(*NLI_LABELS) & (F.col("_t") > 0), F.lit(False))
    share = lambda k: F.when(fine, F.col(k) / F.col("_t")).otherwise(1 / 3)
    out = r.withColumn("label", F.when(fine, F.col("_label")).otherwise("neutral")).withColumn("supporting", share("_s")).withColumn("refuting", share("_r")).withColumn("neutral", share("_n"))
    out = out.withColumn("confidence", F.when(fine, F.coalesce(get("$.confidence"), F.lit(0.0))).otherwise(0.0)).withColumn("reasoning", F.when(fine, F.coalesce(get("$.reasoning", "string"), F.lit(""))).otherwise("nli_unavailable"))
    return out.drop("_v", "_label", "_s", "_r", "_n", "_t")


def distribution(supporting: Column, refuting: Column, neutral: Column) -> Column:
    """struct(entail, contradict, neutral) that sums to 1; thirds if the scores do not sum to more than 0."""
    total = supporting + refuting + neutral
    share = lambda c: F.when(total > 0, c / total).otherwise(1 / 3)
    return F.struct(share(supporting).alias("entail"), share(refuting).alias("contradict"), share(neutral).alias("neutral"))


def fill_from_fallback(primary: DataFrame, fallback: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of the first model; where it is the sentinel and the second has an answer, the second's, with a flag."""
    values = [c for c in primary.columns if c not in keys]
    other = fallback.select(*keys, F.struct(*values).alias("_f"))
    j = primary.join(other, keys, "left")
    fill = (F.col("reasoning") == "nli_unavailable") & (F.col("confidence") == 0) & F.col("_f").isNotNull()
    j = j.withColumn("_fill", F.coalesce(fill, F.lit(False)))
    return j.select(*keys, *[F.when(F.col("_fill"), F.col(f"_f.{c}")).otherwise(F.col(c)).alias(c) for c in values], F.col("_fill").alias("fallback"))


def claim_edges(pairs: DataFrame, doc: str) -> DataFrame:
    """(doc, claim, neighbour, edge_type, strength): both ends of claim pairs (a, b, entail, contradict, neutral)."""
    entails = F.col("entail") >= F.col("contradict")
    p = pairs.withColumn("edge_type", F.when(entails, "entail").otherwise("contradict"))
    p = p.withColumn("strength", T.clamp(F.when(entails, F.col("entail")).otherwise(F.col("contradict")) - F.col("neutral"), 0, 1))
    ends = F.array(F.struct(F.col("a").alias("claim"), F.col("b").alias("neighbour")), F.struct(F.col("b").alias("claim"), F.col("a").alias("neighbour")))
    return p.select(doc, F.explode(ends).alias("e"), "edge_type", "strength").select(doc, "e.claim", "e.neighbour", "edge_type", "strength")


def resolve_entities(claims: DataFrame, labels: DataFrame, key: str = "claim_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """Exact matches (key, qid, label, similarity, source) of spans with entity labels; and the claims without any.

    ``labels``: qid, label. The rest goes to a vector search.
    """
    spans = claims.select(key, F.explode(F.array_distinct(F.transform(capitalized_spans(F.col(text)), lambda s: F.lower(s)))).alias("_label"))
    known = labels.select("qid", "label", F.lower("label").alias("_label"))
    exact = spans.join(known, "_label").select(key, "qid", "label", F.lit(1.0).alias("similarity"), F.lit("exact").alias("source")).distinct()
    return exact, claims.join(exact.select(key).distinct(), key, "left_anti")


# Words that say nothing about whose age a claim is.
AGE_STOP = ("aged", "away", "dead", "death", "died", "passed", "year", "years")
_CLAIMED = (
    r"(?i)\b(?:died|dead|passed\s+away)\b[^.?!]{0,80}\b(?:at|aged|age|with)\s+(?:the\s+age\s+of\s+)?(\d{1,3})\b",
    r"(?i)\b(?:died|dead|passed\s+away)\b[^.?!]{0,80}\b(\d{1,3})\s*(?:years?|yrs?)\b",
    r"(?i)\b(\d{1,3})\s*(?:years?|yrs?)\s*old\b[^.?!]{0,80}\b(?:when\s+)?(?:he|she|they|[A-Z][a-z]+)?\s*(?:died|dead|passed\s+away)\b",
    r"(?i)\b(?:was|were)\s+(\d{1,3})\b[^.?!]{0,80}\b(?:when\s+)?(?:he|she|they)?\s*(?:died|dead|passed\s+away)\b",
)
_TOLD = (
    r"(?i)\b(?:died|dead|death)\b[^.?!]{0,100}\b(?:aged|age|at\s+the\s+age\s+of|at)\s+(\d{1,3})\b",
    r"(?i)\b(?:aged|age)\s+(\d{1,3})\b[^.?!]{0,100}\b(?:died|dead|death)\b",
    r"(?i)\b(\d{1,3})\s*(?:years?|yrs?)\s*old\b[^.?!]{0,100}\b(?:when\s+)?(?:he|she|they)?\s*(?:died|dead|death)\b",
)
_WRITTEN = r"(?i)\b(\d{1,2})\s+(January|Jan|February|Feb|March|Mar|April|Apr|May|June|Jun|July|Jul|August|Aug|September|Sept|Sep|October|Oct|November|Nov|December|Dec)\s+(\d{4})\b"
_YEARS = r"\b(1[5-9]\d{2}|20\d{2})\s*[-–—]\s*(1[5-9]\d{2}|20\d{2})\b"


def _first_age(c: Column, patterns: tuple[str, ...]) -> Column:
    """Number of the first pattern that gives one from 0 to 125."""
    age = lambda p: F.nullif(F.regexp_extract(c, p, 1), F.lit("")).cast("int")
    return F.coalesce(*[F.when(age(p) <= 125, age(p)) for p in patterns])


def _age_from_dates(c: Column) -> Column:
    """Age between the first two written dates, in order, that give one from 0 to 125."""
    month = F.create_map(*[x for i, m in enumerate(T.MONTHS) for x in (F.lit(m[:3]), F.lit(i + 1))])
    dates = F.transform(F.regexp_extract_all(c, F.lit(_WRITTEN), F.lit(0)), lambda d: F.struct(F.regexp_extract(d, _WRITTEN, 3).cast("int").alias("y"), (month[F.lower(F.substring(F.regexp_extract(d, _WRITTEN, 2), 1, 3))] * 100 + F.regexp_extract(d, _WRITTEN, 1).cast("int")).alias("md")))
    age = lambda a, b: b["y"] - a["y"] - F.when(b["md"] >= a["md"], 0).otherwise(1)
    pairs = F.flatten(F.transform(dates, lambda a, i: F.transform(F.slice(dates, i + 2, F.size(dates)), lambda b: age(a, b))))
    return F.get(F.filter(pairs, lambda x: (x >= 0) & (x <= 125)), F.lit(0))


def death_age_rule(rows: DataFrame, claim: str = "claim", evidence: str = "evidence") -> DataFrame:
    """Adds rule_label and rule_confidence where a claim states an age at death and the evidence is about its subject.

    An equal age supports, another one refutes; ages from a range of years are known to a year only. Null: no rule.
    """
    text, low = F.col(evidence), F.lower(evidence)
    r = rows.withColumn("_claimed", _first_age(F.col(claim), _CLAIMED))
    names = F.regexp_extract_all(F.col(claim), F.lit(r"\b[A-Z][a-z]+(?:\s+[A-Z][a-z]+)+\b"), F.lit(0))
    tokens = F.filter(T.significant_tokens(F.col(claim), 80), lambda t: ~t.isin(*AGE_STOP))
    shared = F.size(F.filter(tokens, lambda t: low.contains(t)))
    about = F.exists(names, lambda n: low.contains(F.lower(n))) | ((F.size(tokens) > 0) & (shared >= F.least(F.lit(2), F.size(tokens))))
    years = F.regexp_extract(text, _YEARS, 2).try_cast("int") - F.regexp_extract(text, _YEARS, 1).try_cast("int")
    r = r.withColumn("_about", about).withColumn("_exact", F.coalesce(_first_age(text, _TOLD), _age_from_dates(text)))
    r = r.withColumn("_near", F.when(F.col("_exact").isNull() & (years >= 0) & (years <= 125), years))
    found, gap = F.coalesce("_exact", "_near"), F.abs(F.coalesce("_exact", "_near") - F.col("_claimed"))
    sure = F.col("_exact").isNotNull()
    label = F.when(found.isNull(), "neutral").when(sure & (gap == 0), "support").when(gap > F.when(sure, 0).otherwise(1), "refute").otherwise("neutral")
    confidence = F.when(found.isNull(), 0.74).when(sure & (gap == 0), 0.9).when(gap > F.when(sure, 0).otherwise(1), 0.92).otherwise(0.72)
    rule = F.col("_claimed").isNotNull() & F.col("_about")
    out = r.withColumn("rule_label", F.when(rule, label)).withColumn("rule_confidence", F.when(rule, confidence))
    return out.drop("_claimed", "_about", "_exact", "_near")
