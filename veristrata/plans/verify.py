"""Queries over claims and evidence."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import verify as V
from ..session import table
from .registry import plan

STOP = ", ".join(f"'{w}'" for w in T.CLAIM_STOP)


def squeeze_sql(x: str) -> str:
    return rf"trim(regexp_replace({x}, '[ \t\n\r]+', ' ', 'g'))"


def sentences_sql(x: str) -> str:
    return rf"string_split(regexp_replace({squeeze_sql(x)}, '([.!?]) ', '\1' || chr(31), 'g'), chr(31))"


def tokens_sql(x: str, most: int | None = None) -> str:
    tokens = rf"list_filter(regexp_split_to_array(regexp_replace(lower({x}), '[^a-z0-9 \t\n\r-]', ' ', 'g'), '[ \t\n\r]+'), lambda t: length(t) > 3 AND t NOT IN ({STOP}))"
    return tokens if most is None else f"list_slice({tokens}, 1, {most})"


def claims_sql(table_name: str, key: str, text: str = "text", most: int = 13) -> str:
    pieces = f"list_slice(list_filter({sentences_sql(text)}, lambda s: length(trim(s)) > 8), 1, {most})"
    return rf"""SELECT {key}, i - 1 AS ord, list[i] AS claim FROM (SELECT {key}, list, unnest(range(1, length(list) + 1)) AS i FROM (
        SELECT {key}, list_filter(list_transform(CASE WHEN length({pieces}) > 0 THEN {pieces} ELSE [substring(trim({text}), 1, 500)] END,
            lambda s: substring(regexp_replace(trim(s), '^[-*][ \t\n\r]*', ''), 1, 1000)), lambda s: s <> '') AS list FROM {table_name}))"""


CUES = " + ".join(f"CASE WHEN contains(lower(text), '{c}') THEN 0.18::DOUBLE ELSE 0.0::DOUBLE END" for c in T.REFUTING_CUES)
PAIRS = f"""claims AS ({claims_sql("benchmark", "item_id")}),
dt AS (SELECT DISTINCT doc_id, unnest({tokens_sql("text")}) AS token FROM documents),
ct AS (SELECT DISTINCT item_id, ord, unnest({tokens_sql("claim")}) AS token FROM claims),
df AS (SELECT token, count(*) AS df FROM dt WHERE token IN (SELECT token FROM ct) GROUP BY token),
weights AS (SELECT item_id, ord, token, round(1000 * ln(1 + (SELECT count(*) FROM documents)::DOUBLE / df))::BIGINT AS weight FROM ct JOIN df USING (token)),
shared AS (SELECT item_id, ord, doc_id, sum(weight)::BIGINT AS shared FROM weights JOIN dt USING (token) GROUP BY ALL),
pairs AS (SELECT s.*, claim, text, source FROM (SELECT *, row_number() OVER (PARTITION BY item_id, ord ORDER BY shared DESC, doc_id) AS rank FROM shared) s
    JOIN claims USING (item_id, ord) JOIN documents USING (doc_id) WHERE rank <= 5),
scored AS (SELECT *, CASE WHEN length(own) = 0 THEN 0.0::DOUBLE ELSE length(list_filter(own, lambda t: list_contains(other, t)))::DOUBLE / length(own) END AS ratio,
    least(0.42::DOUBLE, {CUES}) AS cue FROM (SELECT *, {tokens_sql("claim", 80)} AS own, {tokens_sql("text", 80)} AS other FROM pairs)),
named AS (SELECT *, CASE WHEN cue > 0 AND ratio >= 0.35::DOUBLE THEN 'refute' WHEN ratio >= 0.42::DOUBLE THEN 'support' ELSE 'neutral' END AS nli_label FROM scored),
sure AS (SELECT *, CASE WHEN nli_label = 'refute' THEN least(0.86::DOUBLE, greatest(0.55::DOUBLE, 0.55::DOUBLE + cue + ratio * 0.2::DOUBLE))
    ELSE least(0.78::DOUBLE, greatest(0.25::DOUBLE, 0.35::DOUBLE + ratio * 0.45::DOUBLE)) END AS confidence FROM named),
labels AS (SELECT *, CASE WHEN nli_label = 'support' THEN confidence ELSE 0.08::DOUBLE END AS supporting, CASE WHEN nli_label = 'refute' THEN confidence ELSE 0.05::DOUBLE END AS refuting,
    least(0.75::DOUBLE, greatest(0.15::DOUBLE, 0.15::DOUBLE + ratio * 0.6::DOUBLE)) AS relevance FROM sure)"""


def claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.claims(table(spark, sf_dir, "benchmark"), "item_id")


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.lexical_label(V.evidence_pairs(claims(spark, sf_dir), table(spark, sf_dir, "documents"), ["item_id", "ord"]))


@plan(rf"""WITH {PAIRS}, beta AS (SELECT item_id, ord, 1 + sum(CASE WHEN nli_label <> 'neutral' THEN supporting ELSE 0.0::DOUBLE END) AS a, 1 + sum(CASE WHEN nli_label <> 'neutral' THEN refuting ELSE 0.0::DOUBLE END) AS b FROM claims LEFT JOIN labels USING (item_id, ord) GROUP BY ALL),
p AS (SELECT item_id, a / (a + b) AS p FROM beta)
SELECT item_id, count(*) AS n_claims, round(CASE WHEN count(*) = 1 THEN max(p) ELSE exp(sum(ln(least(1 - 1e-6::DOUBLE, greatest(1e-6::DOUBLE, p))))) END, 6) AS doc_score FROM p GROUP BY item_id""")
def verify_documents_beta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims, evidence by weighted shared tokens, lexical labels, Beta fold, product over each document."""
    beliefs = V.beta_fold(labelled(spark, sf_dir), ["item_id", "ord"], claims(spark, sf_dir))
    return V.doc_product(beliefs, ["item_id"]).select("item_id", "n_claims", F.round("doc_score", 6).alias("doc_score"))


@plan(rf"""WITH {PAIRS} SELECT item_id, ord::INT AS ord, doc_id, shared, nli_label, round(ratio, 6) AS ratio, round(confidence, 6) AS confidence, round(relevance, 6) AS relevance FROM labels""")
def fn_nli_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    r6 = [F.round(c, 6).alias(c) for c in ("ratio", "confidence", "relevance")]
    return labelled(spark, sf_dir).select("item_id", "ord", "doc_id", "shared", "nli_label", *r6)


@plan(rf"""WITH {PAIRS} SELECT item_id, ord::INT AS ord, round(1 + sum(CASE WHEN nli_label <> 'neutral' THEN supporting ELSE 0.0::DOUBLE END), 6) AS alpha, round(1 + sum(CASE WHEN nli_label <> 'neutral' THEN refuting ELSE 0.0::DOUBLE END), 6) AS beta, count(doc_id) AS n_evidence FROM claims LEFT JOIN labels USING (item_id, ord) GROUP BY ALL""")
def agg_beta_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = V.beta_fold(labelled(spark, sf_dir), ["item_id", "ord"], claims(spark, sf_dir))
    return b.select("item_id", "ord", F.round("alpha", 6).alias("alpha"), F.round("beta", 6).alias("beta"), "n_evidence")


_LOGIT = rf"""{PAIRS}, sig AS (SELECT item_id, ord,
    CASE WHEN nli_label = 'support' AND supporting >= 0.35::DOUBLE AND relevance >= 0.4::DOUBLE THEN supporting * 0.7::DOUBLE * relevance END AS s,
    CASE WHEN nli_label = 'refute' AND refuting >= 0.35::DOUBLE AND relevance >= 0.4::DOUBLE THEN refuting * 0.7::DOUBLE * relevance END AS r,
    CASE WHEN doc_id IS NULL OR nli_label = 'neutral' OR relevance < 0.4::DOUBLE THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS neu, relevance FROM claims LEFT JOIN labels USING (item_id, ord)),
agg AS (SELECT item_id, ord, coalesce(max(s) * 0.75::DOUBLE + avg(s) * 0.25::DOUBLE, 0) AS support, coalesce(max(r) * 0.75::DOUBLE + avg(r) * 0.25::DOUBLE, 0) AS refute, avg(neu) AS neu, avg(relevance) AS rel FROM sig GROUP BY ALL),
pr AS (SELECT *, least(0.97::DOUBLE, greatest(0.03::DOUBLE, 1 / (1 + exp(-(-0.25::DOUBLE + 2 * support - 3.1::DOUBLE * refute - 0.2::DOUBLE * neu - CASE WHEN rel IS NULL THEN 0.3::DOUBLE ELSE least(0.28::DOUBLE, greatest(0.0::DOUBLE, 0.28::DOUBLE * (1 - rel))) END))))) AS p, greatest(support, refute) AS strength FROM agg),
wd AS (SELECT *, least(0.42::DOUBLE, greatest(0.12::DOUBLE, 0.34::DOUBLE - strength * 0.16::DOUBLE + (0.9::DOUBLE - 0.8::DOUBLE) * 0.2::DOUBLE)) AS width FROM pr),
verdicts AS (SELECT item_id, ord, floor(p * 10000 + 0.5::DOUBLE) / 10000 AS p_true, floor(greatest(0, p - width / 2) * 10000 + 0.5::DOUBLE) / 10000 AS low, floor(least(1, p + width / 2) * 10000 + 0.5::DOUBLE) / 10000 AS high, floor(strength * 10000 + 0.5::DOUBLE) / 10000 AS gain, rel IS NULL AS bare FROM wd)"""


def _verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.logit_verdicts(labelled(spark, sf_dir).withColumn("credibility", F.lit(None).cast("double")), ["item_id", "ord"], claims(spark, sf_dir))


@plan(rf"""WITH {_LOGIT} SELECT item_id, ord::INT AS ord, p_true, low, high, gain, bare OR (high - low) > 0.35::DOUBLE AS review FROM verdicts""")
def agg_claim_logit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _verdicts(spark, sf_dir)


@plan(rf"""WITH {_LOGIT}, d AS (SELECT item_id, exp(avg(ln(p_true))) AS s, min(low) AS lo, max(high) AS hi, CASE WHEN count(*) <= 1 THEN 1.0::DOUBLE ELSE 1 - stddev_pop(p_true) END AS c FROM verdicts GROUP BY item_id)
SELECT item_id, floor(s * 10000 + 0.5::DOUBLE) / 10000 AS doc_score, floor(least(lo, s) * 10000 + 0.5::DOUBLE) / 10000 AS doc_low, floor(greatest(hi, s) * 10000 + 0.5::DOUBLE) / 10000 AS doc_high, floor(c * 10000 + 0.5::DOUBLE) / 10000 AS consistency FROM d""")
def verify_documents_logit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The logistic family: claim verdicts, geometric mean, interval and agreement (agg_geo_mean, agg_consistency)."""
    return V.geo_mean(_verdicts(spark, sf_dir), ["item_id"])


_CONV = "SELECT conv_id, turn, text FROM conversations WHERE role = 'assistant'"


@plan(rf"""WITH p AS (SELECT conv_id, turn, unnest(list_filter(list_transform({sentences_sql("text")}, lambda s: trim(s)), lambda s: length(s) >= 10)) AS claim FROM ({_CONV}))
SELECT conv_id, turn, count(*) AS n_claims, count(DISTINCT regexp_replace({squeeze_sql("lower(claim)")}, '[.,;:!?]$', '')) AS n_forms FROM p GROUP BY ALL""")
def fn_decompose_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").where("role = 'assistant'")
    s = c.select("conv_id", "turn", F.explode(T.fallback_sentences(F.col("text"))).alias("claim"))
    return s.groupBy("conv_id", "turn").agg(F.count("*").alias("n_claims"), F.countDistinct(T.claim_norm(F.col("claim"))).alias("n_forms"))


@plan(claims_sql("benchmark", "item_id").replace("i - 1 AS ord", "(i - 1)::INT AS ord"))
def fn_decompose_worker(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.claims(table(spark, sf_dir, "benchmark"), "item_id")


@plan(rf"""WITH c AS ({claims_sql("(SELECT * FROM conversations WHERE role = 'assistant')", "conv_id, turn")}), f AS (SELECT *, regexp_replace({squeeze_sql("lower(claim)")}, '[.,;:!?]$', '') AS form FROM c)
SELECT conv_id, turn, ord::INT AS ord, form FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, form ORDER BY turn, ord) AS k FROM f) WHERE k = 1""")
def win_dedupe_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").where("role = 'assistant'")
    rows = c.select("conv_id", "turn", F.posexplode(T.worker_claims(F.col("text"), 13)).alias("ord", "claim"))
    return T.first_seen(rows.withColumn("form", T.claim_norm(F.col("claim"))), ["conv_id", "form"], ["turn", "ord"]).select("conv_id", "turn", "ord", "form")


def _hits(domain: str) -> str:
    return " + ".join(f"length(regexp_extract_all(text, '(?i){p}'))" for p in T.DOMAINS[domain])


@plan(rf"""WITH h AS (SELECT conv_id, turn, length(list_filter(regexp_split_to_array(text, '[ \t\n\r]+'), lambda w: w <> '')) AS words, {", ".join(f"{_hits(d)} AS {d}" for d in T.DOMAINS)} FROM conversations),
g AS (SELECT *, greatest({", ".join(T.DOMAINS)}) AS best FROM h)
SELECT conv_id, turn, CASE WHEN best = 0 THEN 'general' {" ".join(f"WHEN {d} = best THEN '{d}'" for d in T.DOMAINS)} END AS domain, round(CASE WHEN best = 0 THEN 0.5::DOUBLE ELSE least(0.95::DOUBLE, 0.5::DOUBLE + best::DOUBLE / greatest(words, 1) * 2) END, 6) AS confidence FROM g""")
def fn_domain_regex(spark: SparkSession, sf_dir: str) -> DataFrame:
    domain, confidence = T.domain_route(F.col("text"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", domain.alias("domain"), F.round(confidence, 6).alias("confidence"))


_EVIDENCE = """SELECT doc_id, (doc_id % 11) / 10.0::DOUBLE AS similarity, ['graph_exact', 'academic', 'news', 'wikipedia', 'unknown'][1 + doc_id % 5] AS source, ['exact', 'partial', 'none'][1 + doc_id % 3] AS match_type,
    CASE WHEN doc_id % 4 = 0 THEN 0.9::DOUBLE END AS class_conf, CASE WHEN doc_id % 3 = 0 THEN (doc_id % 10) / 10.0::DOUBLE END AS ingest_quality, n_chars / 1e7::DOUBLE AS pagerank,
    doc_id % 7 = 0 AS is_disambiguation, doc_id % 13 = 0 AS is_redirect, doc_id % 2 = 0 AS has_wikidata, doc_id % 5 = 0 AS has_coordinates, n_chars AS incoming_links FROM documents"""


def _evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence attributes that the tables lack, as functions of doc_id and n_chars."""
    return table(spark, sf_dir, "documents").selectExpr(
        "doc_id", "(doc_id % 11) / 10D AS similarity", "array('graph_exact', 'academic', 'news', 'wikipedia', 'unknown')[doc_id % 5] AS source",
        "array('exact', 'partial', 'none')[doc_id % 3] AS match_type", "CASE WHEN doc_id % 4 = 0 THEN 0.9D END AS class_conf",
        "CASE WHEN doc_id % 3 = 0 THEN (doc_id % 10) / 10D END AS ingest_quality", "n_chars / 1e7D AS pagerank", "doc_id % 7 = 0 AS is_disambiguation", "doc_id % 13 = 0 AS is_redirect",
        "doc_id % 2 = 0 AS has_wikidata", "doc_id % 5 = 0 AS has_coordinates", "n_chars AS incoming_links",
    )


def _quality_sql() -> str:
    steps = [
        ("CASE WHEN similarity = 0 THEN 0.5::DOUBLE ELSE similarity END", ""),
        ("least(1.0::DOUBLE, q + CASE match_type WHEN 'exact' THEN 0.15::DOUBLE WHEN 'partial' THEN 0.05::DOUBLE ELSE 0.0::DOUBLE END)", ""),
        ("CASE WHEN class_conf IS NOT NULL THEN least(1.0::DOUBLE, (q + class_conf) / 2) ELSE q END", ""),
        ("CASE WHEN ingest_quality IS NOT NULL THEN q * 0.6::DOUBLE + ingest_quality * 0.4::DOUBLE ELSE q END", ""),
        ("CASE WHEN pagerank > 0 THEN least(1.0::DOUBLE, q + least(0.1::DOUBLE, log10(pagerank * 1000000 + 1) / 60)) ELSE q END", ""),
        ("CASE WHEN is_disambiguation THEN q * 0.6::DOUBLE ELSE q END", ""),
        ("CASE WHEN is_redirect THEN q * 0.5::DOUBLE ELSE q END", ""),
        ("CASE WHEN has_wikidata THEN least(1.0::DOUBLE, q + 0.05::DOUBLE) ELSE q END", ""),
        ("CASE WHEN has_coordinates THEN least(1.0::DOUBLE, q + 0.03::DOUBLE) ELSE q END", ""),
        ("CASE WHEN incoming_links > 100 THEN least(1.0::DOUBLE, q + least(0.08::DOUBLE, log10(incoming_links + 1) / 50)) ELSE q END", ""),
    ]
    sql = _EVIDENCE
    for i, (x, _) in enumerate(steps):
        sql = f"SELECT * {'EXCLUDE (q)' if i else ''}, {x} AS q FROM ({sql})"
    r = "CASE source WHEN 'graph_exact' THEN 1.0::DOUBLE WHEN 'academic' THEN 0.9::DOUBLE WHEN 'news' THEN 0.65::DOUBLE WHEN 'wikipedia' THEN 0.8::DOUBLE ELSE 0.5::DOUBLE END * CASE WHEN is_disambiguation THEN 0.7::DOUBLE ELSE 1.0::DOUBLE END * CASE WHEN is_redirect THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END"
    return f"SELECT *, q AS quality, {r} AS reliability, q * {r} AS weighted FROM ({sql})"


@plan(f"SELECT doc_id, round(quality, 6) AS quality, round(reliability, 6) AS reliability, round(weighted, 6) AS weighted FROM ({_quality_sql()})")
def fn_evidence_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.evidence_quality(_evidence(spark, sf_dir)).select("doc_id", *[F.round(c, 6).alias(c) for c in ("quality", "reliability", "weighted")])


@plan(f"""WITH e AS (SELECT *, doc_id // 20 AS claim FROM ({_quality_sql()})), s AS (SELECT *, count(*) OVER w AS n, sum(CASE WHEN quality >= 0.7::DOUBLE THEN 1 ELSE 0 END) OVER w AS h, sum(weighted) OVER w AS v FROM e WINDOW w AS (PARTITION BY claim ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT claim, doc_id FROM s WHERE NOT ((n >= 3 AND coalesce(h, 0) >= 2) OR coalesce(v, 0) >= 2)""")
def st_tiered_early_exit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence in arrival order, up to the row that made it sufficient (agg_sufficiency)."""
    e = V.evidence_quality(_evidence(spark, sf_dir)).withColumn("claim", F.floor(F.col("doc_id") / 20))
    return V.keep_until_sufficient(e, ["claim"], ["doc_id"]).select("claim", "doc_id")


@plan("""WITH s AS (SELECT doc_id // 20 AS claim, doc_id AS ord, ['support', 'refute', 'neutral'][1 + (doc_id // 7) % 3] AS label, (doc_id % 10) / 10.0::DOUBLE AS s, (doc_id % 7) / 10.0::DOUBLE AS r, (doc_id % 3) / 10.0::DOUBLE AS n, (doc_id % 9) / 10.0::DOUBLE AS c, source FROM documents),
w AS (SELECT claim, arg_max(label, (votes, -first)) AS label FROM (SELECT claim, label, count(*) AS votes, min(ord) AS first FROM s GROUP BY ALL) GROUP BY claim),
a AS (SELECT claim, label, avg(s) AS s, avg(r) AS r, avg(n) AS n, avg(c) AS c, arg_max(source, (c, -ord)) AS reasoning FROM s JOIN w USING (claim, label) GROUP BY ALL)
SELECT claim, label, round(CASE WHEN s + r + n > 0 THEN s / (s + r + n) ELSE 1.0::DOUBLE / 3 END, 6) AS supporting, round(CASE WHEN s + r + n > 0 THEN r / (s + r + n) ELSE 1.0::DOUBLE / 3 END, 6) AS refuting, round(CASE WHEN s + r + n > 0 THEN n / (s + r + n) ELSE 1.0::DOUBLE / 3 END, 6) AS neutral, round(CASE WHEN c < 0.05::DOUBLE THEN 0.0::DOUBLE ELSE c END, 6) AS confidence, reasoning FROM a""")
def agg_nli_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "documents").selectExpr("doc_id div 20 AS claim", "doc_id AS ord", "array('support', 'refute', 'neutral')[cast(floor(doc_id / 7) % 3 AS int)] AS label", "(doc_id % 10) / 10D AS supporting", "(doc_id % 7) / 10D AS refuting", "(doc_id % 3) / 10D AS neutral", "(doc_id % 9) / 10D AS confidence", "source AS reasoning")
    v = V.nli_vote(s, ["claim"])
    return v.select("claim", "label", *[F.round(c, 6).alias(c) for c in ("supporting", "refuting", "neutral", "confidence")], "reasoning")


_UN = """e AS (SELECT doc_id // 20 AS doc, doc_id AS claim, (doc_id % 7) / 10.0::DOUBLE AS entail, (doc_id % 3) / 10.0::DOUBLE AS contradict, 1 - (doc_id % 7) / 10.0::DOUBLE - (doc_id % 3) / 10.0::DOUBLE AS neutral FROM documents)"""


def _scored_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.selectExpr("cast(doc_id div 20 AS string) AS doc", "cast(doc_id AS string) AS claim", "(doc_id % 7) / 10D AS entail", "(doc_id % 3) / 10D AS contradict", "1 - (doc_id % 7) / 10D - (doc_id % 3) / 10D AS neutral")


@plan(f"WITH {_UN} SELECT doc::VARCHAR AS doc, round(sum(ln(greatest(contradict + 0.5::DOUBLE * neutral, 0.001::DOUBLE))), 6) AS log_false, round(sum(ln(greatest(entail + 0.5::DOUBLE * neutral, 0.001::DOUBLE))), 6) AS log_true FROM e GROUP BY doc")
def agg_unary_factor(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators import inference as I

    return I.unary_factors(_scored_claims(spark, sf_dir), ["doc"]).select("doc", F.round("log_false", 6).alias("log_false"), F.round("log_true", 6).alias("log_true"))


@plan(f"""WITH {_UN} SELECT claim::VARCHAR AS claim, round(ln(greatest(entail + 0.5::DOUBLE * neutral, 0.001::DOUBLE)) * greatest(0, least(1, greatest(entail, contradict) - neutral)), 6) + 0.0 AS log_same, round(ln(greatest(contradict + 0.5::DOUBLE * neutral, 0.001::DOUBLE)) * greatest(0, least(1, greatest(entail, contradict) - neutral)), 6) + 0.0 AS log_other FROM e""")
def fn_binary_factor(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators import inference as I

    return I.binary_factors(_scored_claims(spark, sf_dir)).select("claim", (F.round("log_same", 6) + 0.0).alias("log_same"), (F.round("log_other", 6) + 0.0).alias("log_other"))


def _factor_graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Twenty claims a document; neighbours in id order share a factor."""
    from pyspark.sql.window import Window

    from ..operators import inference as I

    c = _scored_claims(spark, sf_dir)
    ahead = F.lead("claim").over(Window.partitionBy("doc").orderBy(F.col("claim").cast("long")))
    pairs = I.binary_factors(c.withColumn("b", ahead).where("b IS NOT NULL")).select("doc", F.col("claim").alias("a"), "b", "log_same", "log_other", (F.col("entail") - F.col("contradict")).alias("r"))
    return I.unary_factors(c, ["doc", "claim"]), pairs


#: Exact marginals of a chain of claims, from messages along it in both directions.
_CHAIN = f"""{_UN}, n AS (SELECT doc, claim, lf, lt, lt - lf AS odds, lt * w AS same, lf * w AS other, row_number() OVER (PARTITION BY doc ORDER BY claim) AS k, count(*) OVER (PARTITION BY doc) AS size FROM (
    SELECT *, ln(greatest(contradict + 0.5::DOUBLE * neutral, 0.001::DOUBLE)) AS lf, ln(greatest(entail + 0.5::DOUBLE * neutral, 0.001::DOUBLE)) AS lt, greatest(0, least(1, greatest(entail, contradict) - neutral)) AS w FROM e)),
f AS (SELECT doc, k, 0.0::DOUBLE AS m, lf AS z0, lt AS z1 FROM n WHERE k = 1 UNION ALL SELECT y.doc, y.k, ln((exp(x.same + x.odds + f.m) + exp(x.other)) / (exp(x.other + x.odds + f.m) + exp(x.same))),
    y.lf + ln(exp(f.z0 + x.same) + exp(f.z1 + x.other)), y.lt + ln(exp(f.z1 + x.same) + exp(f.z0 + x.other)) FROM f JOIN n x ON x.doc = f.doc AND x.k = f.k JOIN n y ON y.doc = f.doc AND y.k = f.k + 1),
g AS (SELECT doc, k, 0.0::DOUBLE AS m FROM n WHERE k = size UNION ALL SELECT x.doc, x.k, ln((exp(x.same + y.odds + g.m) + exp(x.other)) / (exp(x.other + y.odds + g.m) + exp(x.same)))
    FROM g JOIN n y ON y.doc = g.doc AND y.k = g.k JOIN n x ON x.doc = g.doc AND x.k = g.k - 1),
exact AS (SELECT n.doc, claim, size, 1 / (1 + exp(-(odds + f.m + g.m))) AS p, f.z0, f.z1, n.k FROM n JOIN f USING (doc, k) JOIN g USING (doc, k))"""


@plan(f"""WITH RECURSIVE {_CHAIN} SELECT doc::VARCHAR AS doc, claim::VARCHAR AS claim, round(p, 6) AS p_true, true AS converged, CASE WHEN size > 1 THEN 'trw_bp' ELSE 'unary' END AS algorithm, size - 1 AS edge_count FROM exact""")
def gr_infer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Posteriors of all claims by propagation over the message table of each document's factor graph (gr_factor_graph, gr_marginals)."""
    from ..operators import propagation as B

    return B.infer(*_factor_graph(spark, sf_dir), tolerance=1e-9).select("doc", "claim", F.round("p_true", 6).alias("p_true"), "converged", "algorithm", "edge_count")


@plan(f"""WITH RECURSIVE {_CHAIN} SELECT doc::VARCHAR AS doc, claim::VARCHAR AS claim, round(p, 6) AS p_true FROM exact""")
def gr_lbp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plain propagation over all claims; the graphs are chains, where it is exact."""
    from ..operators import propagation as B

    return B.infer(*_factor_graph(spark, sf_dir), "fast", tolerance=1e-9, rounds=200).select("doc", "claim", F.round("p_true", 6).alias("p_true"))


@plan(f"""WITH RECURSIVE {_CHAIN} SELECT doc::VARCHAR AS doc, round(ln(exp(z0) + exp(z1)), 5) AS log_bound FROM exact WHERE k = size""")
def gr_trwbp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The reweighted form's bound of each document's log partition function; on a tree it is the function itself."""
    from ..operators import propagation as B

    return B.infer(*_factor_graph(spark, sf_dir), tolerance=1e-9).select("doc", F.round("log_bound", 5).alias("log_bound")).distinct()


@plan(f"""WITH {_UN} SELECT doc::VARCHAR AS doc, claim::VARCHAR AS claim, true AS near FROM e""")
def gr_gibbs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the seeded sampler's share of each claim comes within 0.1 of the propagated posterior."""
    from ..operators import inference as I
    from ..operators import propagation as B

    nodes, pairs = _factor_graph(spark, sf_dir)
    both = B.infer(nodes, pairs).select("doc", "claim", "p_true").join(I.sampled(nodes, pairs), ["doc", "claim"])
    return both.select("doc", "claim", (F.abs(F.col("share") - F.col("p_true")) <= 0.1).alias("near"))


@plan()
def gr_sanity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The solver's marginals against Gibbs sampling, by document (gr_gibbs, gr_conditional)."""
    from ..operators import inference as I

    return I.infer(*_factor_graph(spark, sf_dir), check=0.05).groupBy("doc").agg(F.round(F.max("mismatch"), 4).alias("mismatch"))


@plan()
def gr_copula(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Joint probability of a document's claims under a Gaussian copula with the pairs' correlations."""
    from ..operators import inference as I

    nodes, pairs = _factor_graph(spark, sf_dir)
    beliefs = nodes.select("doc", "claim", (1 / (1 + F.exp(F.col("log_false") - F.col("log_true")))).alias("p_true"))
    return I.copula_scores(beliefs, pairs.select("doc", "a", "b", "r")).withColumn("joint", F.round("joint", 6))


@plan("""WITH e AS (SELECT doc_id // 3 AS doc, doc_id, (doc_id % 7) / 10.0::DOUBLE - (doc_id % 3) / 10.0::DOUBLE AS r FROM documents), p AS (SELECT *, lead(doc_id) OVER (PARTITION BY doc ORDER BY doc_id) IS NOT NULL AS tied FROM e)
SELECT doc::VARCHAR AS doc, count(*) AS n_claims, round(CASE count(*) WHEN 1 THEN 0.5::DOUBLE WHEN 2 THEN 0.25::DOUBLE + sum(CASE WHEN tied THEN asin(r) ELSE 0 END) / (2 * pi()) ELSE 0.125::DOUBLE + sum(CASE WHEN tied THEN asin(r) ELSE 0 END) / (4 * pi()) END, 4) AS joint FROM p GROUP BY doc""")
def gr_copula_orthant(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Joint probabilities of up to three even claims with correlated neighbours, integrated; the SQL has their closed forms."""
    from pyspark.sql.window import Window

    from ..operators import inference as I

    c = table(spark, sf_dir, "documents").selectExpr("cast(doc_id div 3 AS string) AS doc", "doc_id", "cast(doc_id AS string) AS claim", "0.5D AS p_true", "(doc_id % 7) / 10D - (doc_id % 3) / 10D AS r")
    pairs = c.withColumn("b", F.lead("claim").over(Window.partitionBy("doc").orderBy("doc_id"))).where("b IS NOT NULL").select("doc", F.col("claim").alias("a"), "b", "r")
    return I.copula_scores(c.select("doc", "claim", "p_true"), pairs).withColumn("joint", F.round("joint", 4))
