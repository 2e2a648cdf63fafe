"""Queries over model answers, entity spans and opinions. Answers are made of table columns, expected rows are not parsed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import claims as L
from ..operators import search as S
from ..operators import verify as V
from ..session import table
from .registry import plan
from .verify import claims_sql, sentences_sql, squeeze_sql


@plan(rf"SELECT conv_id, turn, md5(regexp_replace({squeeze_sql('lower(text)')}, '[.,;:!?]$', '')) AS form FROM conversations")
def fn_claim_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.md5(T.claim_norm(F.col("text")).cast("binary")).alias("form"))


_WHEN = "CASE o_orderkey % 7 WHEN {0} WHEN 1 THEN {1} WHEN 2 THEN {2} WHEN 3 THEN {3} WHEN 4 THEN {4} WHEN 5 THEN {5} END"


@plan("SELECT o_orderkey, CASE WHEN o_orderkey % 7 IN (0, 1, 2) THEN strftime(o_orderdate, '%Y-%m-%d') WHEN o_orderkey % 7 IN (3, 4) THEN strftime(o_orderdate, '%Y-%m') WHEN o_orderkey % 7 = 5 THEN strftime(o_orderdate, '%Y') END AS iso FROM orders")
def fn_date_iso(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates written in six ways, and none."""
    forms = ("'on ' || date_format(o_orderdate, 'yyyy-MM-dd') || '.'", "'since ' || date_format(o_orderdate, 'MMMM d, yyyy') || ' at least'", "date_format(o_orderdate, 'd MMM yyyy')", "'in ' || date_format(o_orderdate, 'MMMM yyyy')", "date_format(o_orderdate, 'yyyy-MM') || ' or so'", "'the year ' || date_format(o_orderdate, 'yyyy')")
    cases = " ".join(f"WHEN {i} THEN {f}" for i, f in enumerate(forms))
    texts = table(spark, sf_dir, "orders").selectExpr("o_orderkey", f"CASE o_orderkey % 7 {cases} ELSE 'about 42 of them' END AS t")
    return texts.select("o_orderkey", T.date_iso(F.col("t")).alias("iso"))


@plan("SELECT l_orderkey, l_linenumber, round(CASE l_orderkey % 5 WHEN 0 THEN l_linenumber / 100.0::DOUBLE WHEN 1 THEN l_linenumber * 1e6::DOUBLE WHEN 2 THEN l_linenumber * 1e3::DOUBLE WHEN 3 THEN l_linenumber::DOUBLE END, 6) AS value FROM lineitem")
def fn_number_si(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percent before scale word before bare number."""
    t = table(spark, sf_dir, "lineitem").selectExpr("l_orderkey", "l_linenumber", "CASE l_orderkey % 5 WHEN 0 THEN l_linenumber || ' percent of 7 million' WHEN 1 THEN 'some ' || l_linenumber || ' Million, or 5' WHEN 2 THEN l_linenumber || 'k' WHEN 3 THEN l_linenumber || ' apples' ELSE 'none' END AS t")
    return t.select("l_orderkey", "l_linenumber", F.round(T.number_si(F.col("t")), 6).alias("value"))


_OWN = claims_sql("benchmark", "item_id", most=100)


@plan(rf"""WITH own AS ({_OWN}), plain AS (SELECT item_id, i - 1 AS ord, list[i] AS claim FROM (SELECT item_id, list, unnest(range(1, length(list) + 1)) AS i FROM (SELECT item_id, list_filter(list_transform({sentences_sql("text")}, lambda s: trim(s)), lambda s: length(s) >= 10) AS list FROM benchmark WHERE item_id % 4 = 3))),
c AS (SELECT item_id, ord, trim(claim) AS claim, CASE ord % 3 WHEN 0 THEN 'temporal' ELSE 'unclassified' END AS claim_type, CASE WHEN ord % 2 = 0 THEN 0.5::DOUBLE ELSE 0.8::DOUBLE END AS confidence FROM own WHERE item_id % 4 <> 3 UNION ALL SELECT item_id, ord, claim, 'unclassified', 0.8::DOUBLE FROM plain),
p AS (SELECT c.*, instr(lower(text), lower(substring(claim, 1, 50))) AS pos FROM c JOIN benchmark USING (item_id))
SELECT item_id, ord::INT AS ord, claim, claim_type, confidence, CASE WHEN pos > 0 THEN (pos - 1 + 100 * item_id)::BIGINT END AS lo, CASE WHEN pos > 0 THEN (pos - 1 + 100 * item_id + length(claim))::BIGINT END AS hi FROM p""")
def fn_claim_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers fenced, bare, within prose, and broken (fn_claim_type, fn_span_rebase): places are moved by an offset."""
    b = table(spark, sf_dir, "benchmark")
    own = V.claims(b, "item_id", most=100)
    item = F.struct(F.col("claim").alias("text"), F.when(F.col("ord") % 3 == 0, "Temporal").when(F.col("ord") % 3 == 1, "other").alias("claim_type"), F.when(F.col("ord") % 2 == 0, 0.5).alias("confidence"))
    made = own.groupBy("item_id").agg(F.to_json(F.struct(F.transform(F.sort_array(F.collect_list(F.struct("ord", item.alias("c")))), lambda x: x["c"]).alias("claims"))).alias("j"))
    j, m = F.col("j"), F.col("item_id") % 4
    answer = F.when(m == 0, F.concat(F.lit("Here:\n```json\n"), j, F.lit("\n```\nDone."))).when(m == 1, j).when(m == 2, F.concat(F.lit("I found "), j, F.lit(" in it"))).otherwise(F.concat(F.lit("```json\n"), F.substring(j, 1, 20)))
    rows = made.join(b, "item_id").select("item_id", "text", answer.alias("answer"), (100 * F.col("item_id")).alias("start"))
    return L.parse_claims(rows, ["item_id"], offset="start")


@plan("SELECT conv_id, turn, round(CASE WHEN trim(text) = '' THEN 0 ELSE least(1.0::DOUBLE, (turn + 1)::DOUBLE / greatest(1, length(regexp_extract_all(text, '[.!?]+')))) END, 6) AS coverage FROM conversations")
def fn_decomp_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    return c.select("conv_id", "turn", F.round(L.decomposition_coverage(F.col("turn") + 1, F.col("text")), 6).alias("coverage"))


def _in(words: tuple[str, ...]) -> str:
    return ", ".join(f"'{w}'" for w in words)


def _runs_sql(words: str, inside: str) -> str:
    return f"list_filter(list_transform(string_split(array_to_string(list_transform({words}, lambda w: CASE WHEN {inside} THEN w ELSE chr(31) END), ' '), chr(31)), lambda r: trim(r)), lambda r: r <> '')"


_WORDS = r"list_filter(regexp_split_to_array({0}, '[ \t\n\r]+'), lambda w: w <> '')"
_SPANS = _runs_sql(_WORDS.format(r"""regexp_replace(text, '[".,;:!?()\[\]]', ' ', 'g')"""), rf"regexp_matches(w, '^\p{{Lu}}') AND lower(w) NOT IN ({_in(L.SPAN_STOP)})")
_ROUTED = _runs_sql(rf"list_transform(list_filter({_WORDS.format('text')}, lambda w: NOT (regexp_matches(w, '^\p{{Lu}}.') AND lower(w) IN ({_in(L.STARTERS)}))), lambda w: CASE WHEN regexp_matches(w, '^\p{{Lu}}.') THEN coalesce(nullif(regexp_replace(w, '[.,;:!?]+$', ''), ''), w) ELSE w END)", r"regexp_matches(w, '^\p{Lu}')")


@plan(rf"SELECT doc_id, length(s) AS n_spans, md5(array_to_string(s, '|')) AS spans FROM (SELECT doc_id, {_SPANS} AS s FROM documents)")
def fn_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "documents").select("doc_id", L.capitalized_spans(F.col("text")).alias("s"))
    return s.select("doc_id", F.size("s").cast("long").alias("n_spans"), F.md5(F.array_join("s", "|").cast("binary")).alias("spans"))


@plan(rf"""WITH r AS (SELECT conv_id, turn, list_filter({_ROUTED}, lambda r: length(r) > 1) AS r FROM conversations), e AS (SELECT conv_id, turn, unnest(r) AS e, generate_subscripts(r, 1) AS i FROM r), d AS (SELECT conv_id, turn, e, min(i) AS i FROM e GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY i) AS k FROM d) SELECT r.conv_id, r.turn, coalesce(string_agg(e, '|' ORDER BY k), '') AS entities FROM r LEFT JOIN k ON k.conv_id = r.conv_id AND k.turn = r.turn AND k <= 10 GROUP BY ALL""")
def fn_entities_router(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.array_join(L.routed_entities(F.col("text")), "|").alias("entities"))


_SUPPLIERS = "claims AS (SELECT s_suppkey AS claim_id, s_suppkey % 3 = 0 AS named, s_nationkey, s_suppkey % (SELECT count(*) FROM embeddings) AS vec FROM supplier), labels AS (SELECT 'N' || n_nationkey AS qid, n_name AS label, n_nationkey FROM nation)"


@plan(f"""WITH {_SUPPLIERS}, e AS (SELECT 'N' || vec_id AS qid, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id < 25), q AS (SELECT claim_id, embedding::DOUBLE[] AS v FROM claims JOIN embeddings ON vec = vec_id WHERE NOT named),
s AS (SELECT claim_id, e.qid, list_dot_product(q.v, e.v) / (sqrt(list_dot_product(q.v, q.v)) * sqrt(list_dot_product(e.v, e.v))) AS score FROM q, e), t AS (SELECT *, row_number() OVER (PARTITION BY claim_id ORDER BY score DESC, qid) AS k FROM s WHERE score >= 0.1::DOUBLE)
SELECT claim_id, qid, label, 1.0::DOUBLE AS similarity, 'exact' AS source FROM claims JOIN labels ON n_nationkey = s_nationkey WHERE named UNION ALL SELECT claim_id, qid, label, round(score, 6), 'vector' FROM t JOIN labels USING (qid) WHERE k <= 5""")
def join_entity_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans that are labels; claims without any by their vector, the best five above a floor (vec_entity)."""
    sup, nation, e = (table(spark, sf_dir, t) for t in ("supplier", "nation", "embeddings"))
    claims = sup.join(F.broadcast(nation), F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").alias("claim_id"), F.when(F.col("s_suppkey") % 3 == 0, F.concat(F.lit("It was made in "), "n_name", F.lit(", they say."))).otherwise("nothing is named here").alias("text"))
    labels = nation.select(F.concat(F.lit("N"), F.col("n_nationkey").cast("string")).alias("qid"), F.col("n_name").alias("label"))
    exact, rest = L.resolve_entities(claims, labels)
    n = e.count()
    queries = rest.select(F.col("claim_id").alias("qid"), (F.col("claim_id") % n).alias("vec_id")).join(e, "vec_id").select("qid", F.col("embedding").alias("qvec"))
    known = e.where("vec_id < 25").select(F.concat(F.lit("N"), F.col("vec_id").cast("string")).alias("vid"), F.col("embedding").alias("vec"))
    near = S.knn(queries, known, 5, least=0.1, same_ids=False).select(F.col("qid").alias("claim_id"), F.col("vid").alias("qid"), F.round("score", 6).alias("similarity"))
    return exact.unionByName(near.join(labels, "qid").select("claim_id", "qid", "label", "similarity", F.lit("vector").alias("source")))


_ANSWER = "format_string('{\"label\":\"%s\",\"supporting_score\":%d,\"refuting_score\":%d,\"neutral_score\":%d,\"confidence\":0.5,\"reasoning\":\"r%d\"}', l, s, r, n, event_id)"
_LABEL = "CASE event_id % 5 WHEN 0 THEN 'support' WHEN 1 THEN 'refute' WHEN 2 THEN 'neutral' WHEN 3 THEN 'unknown' ELSE 'support' END"
_SCORES = f"SELECT event_id, {_LABEL} AS l, event_id % 4 AS s, event_id % 3 AS r, event_id % 2 AS n FROM events"
_FINE = "l <> 'unknown' AND s + r + n > 0 AND event_id % 11 <> 0"
_THIRD = "CASE WHEN {0} THEN {1}::DOUBLE / (s + r + n) ELSE 1.0::DOUBLE / 3 END"


def _answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").selectExpr("event_id", f"{_LABEL} AS l", "event_id % 4 AS s", "event_id % 3 AS r", "event_id % 2 AS n")
    return e.selectExpr("event_id", f"CASE WHEN event_id % 11 = 0 THEN substring({_ANSWER}, 1, 30) ELSE {_ANSWER} END AS answer")


@plan(f"SELECT event_id, CASE WHEN {_FINE} THEN l ELSE 'neutral' END AS label, round({_THIRD.format(_FINE, 's')}, 6) AS supporting, round({_THIRD.format(_FINE, 'r')}, 6) AS refuting, round({_THIRD.format(_FINE, 'n')}, 6) AS neutral, CASE WHEN {_FINE} THEN 0.5::DOUBLE ELSE 0 END AS confidence, CASE WHEN {_FINE} THEN 'r' || event_id ELSE 'nli_unavailable' END AS reasoning FROM ({_SCORES})")
def fn_nli_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = L.parse_label(_answers(spark, sf_dir))
    return p.select("event_id", "label", *[F.round(c, 6).alias(c) for c in ("supporting", "refuting", "neutral")], "confidence", "reasoning")


@plan(f"SELECT event_id, round({_THIRD.format('s + r + n > 0', 's')}, 6) AS entail, round({_THIRD.format('s + r + n > 0', 'r')}, 6) AS contradict, round({_THIRD.format('s + r + n > 0', 'n')}, 6) AS neutral FROM ({_SCORES})")
def fn_nli_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", L.distribution(F.col("event_id") % 4, F.col("event_id") % 3, F.col("event_id") % 2).alias("d"))
    return e.select("event_id", *[F.round(f"d.{c}", 6).alias(c) for c in ("entail", "contradict", "neutral")])


@plan(f"SELECT event_id, CASE WHEN {_FINE} THEN l WHEN event_id % 2 = 0 THEN 'refute' ELSE 'neutral' END AS label, round(CASE WHEN {_FINE} THEN s::DOUBLE / (s + r + n) WHEN event_id % 2 = 0 THEN 0.1::DOUBLE ELSE 1.0::DOUBLE / 3 END, 6) AS supporting, NOT ({_FINE}) AND event_id % 2 = 0 AS fallback FROM ({_SCORES})")
def join_fallback_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A second model's answers (there are some) stand in for the first's failures."""
    first = L.parse_label(_answers(spark, sf_dir)).drop("answer")
    second = table(spark, sf_dir, "events").where("event_id % 2 = 0").select("event_id", F.lit("refute").alias("label"), F.lit(0.1).alias("supporting"), F.lit(0.8).alias("refuting"), F.lit(0.1).alias("neutral"), F.lit(0.9).alias("confidence"), F.lit("second").alias("reasoning"))
    return L.fill_from_fallback(first, second, ["event_id"]).select("event_id", "label", F.round("supporting", 6).alias("supporting"), "fallback")


_PAIRS = "SELECT doc_id // 20 AS doc, doc_id AS a, doc_id + 1 AS b, (doc_id % 7) / 10.0::DOUBLE AS entail, (doc_id % 5) / 10.0::DOUBLE AS contradict, (doc_id % 3) / 10.0::DOUBLE AS neutral FROM documents"


@plan(f"""WITH p AS (SELECT doc, a, b, CASE WHEN entail >= contradict THEN 'entail' ELSE 'contradict' END AS edge_type, round(greatest(0, least(1, greatest(entail, contradict) - neutral)), 6) AS strength FROM ({_PAIRS}))
SELECT doc, a AS claim, b AS neighbour, edge_type, strength FROM p UNION ALL SELECT doc, b, a, edge_type, strength FROM p""")
def fn_claim_edge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dominant side and clipped strength of each claim pair, at both of its ends (gr_edge_strength)."""
    p = table(spark, sf_dir, "documents").selectExpr("doc_id div 20 AS doc", "doc_id AS a", "doc_id + 1 AS b", "(doc_id % 7) / 10D AS entail", "(doc_id % 5) / 10D AS contradict", "(doc_id % 3) / 10D AS neutral")
    return L.claim_edges(p, "doc").withColumn("strength", F.round("strength", 6))


_SIDE = "SELECT doc_id, ['support', 'refute', 'neutral'][1 + (doc_id // {0}) % 3] AS label, ((doc_id // {0}) % 9) / 10.0::DOUBLE AS c, ((doc_id // {0}) % 7) / 10.0::DOUBLE AS s, ((doc_id // {0}) % 5) / 10.0::DOUBLE AS r, ((doc_id // {0}) % 4) / 10.0::DOUBLE AS n, ((doc_id // {0}) % 6) / 10.0::DOUBLE AS v FROM documents"


@plan(f"""WITH a AS (SELECT * FROM ({_SIDE.format(1)}) WHERE doc_id % 5 <> 0), b AS (SELECT * FROM ({_SIDE.format(3)}) WHERE doc_id % 7 <> 0), j AS (SELECT d.doc_id, a.label AS la, b.label AS lb, a.c AS ca, b.c AS cb, a.s AS sa, b.s AS sb, a.r AS ra, b.r AS rb, a.n AS na, b.n AS nb, a.v AS va, b.v AS vb FROM documents d LEFT JOIN a USING (doc_id) LEFT JOIN b USING (doc_id)),
k AS (SELECT *, CASE WHEN la IS NULL AND lb IS NULL THEN 'none' WHEN la IS NULL OR lb IS NULL THEN 'one' WHEN la = lb THEN 'same' WHEN la = 'refute' OR lb = 'refute' THEN 'refute' ELSE 'split' END AS k FROM j)
SELECT doc_id, CASE k WHEN 'same' THEN la WHEN 'refute' THEN 'refute' WHEN 'split' THEN 'neutral' ELSE coalesce(la, lb) END AS label,
    round(CASE k WHEN 'same' THEN (ca + cb) / 2 WHEN 'refute' THEN CASE WHEN la = 'refute' THEN ca ELSE cb END * 0.7::DOUBLE WHEN 'split' THEN least(ca, cb) * 0.6::DOUBLE ELSE coalesce(ca, cb) * 0.85::DOUBLE END, 6) AS confidence,
    round(CASE k WHEN 'same' THEN (sa + sb) / 2 WHEN 'refute' THEN least(sa, sb) WHEN 'split' THEN least(sa, sb) * 0.5::DOUBLE ELSE coalesce(sa, sb) * 0.85::DOUBLE END, 6) AS supporting,
    round(CASE k WHEN 'same' THEN (ra + rb) / 2 WHEN 'refute' THEN CASE WHEN la = 'refute' THEN ra ELSE rb END * 0.7::DOUBLE WHEN 'split' THEN least(ra, rb) ELSE coalesce(ra, rb) END, 6) AS refuting,
    round(CASE k WHEN 'same' THEN (na + nb) / 2 WHEN 'none' THEN NULL WHEN 'one' THEN coalesce(na, nb) ELSE greatest(na, nb) END, 6) AS neutral, round(CASE k WHEN 'one' THEN coalesce(va, vb) * 0.9::DOUBLE WHEN 'none' THEN NULL ELSE least(va, vb) END, 6) AS relevance FROM k""")
def fn_nli_combine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two models' opinions, either of which may be missing."""
    def side(step: int, every: int):
        k = f"(doc_id div {step})"
        s = f"named_struct('label', array('support', 'refute', 'neutral')[cast({k} % 3 AS int)], 'confidence', ({k} % 9) / 10D, 'supporting', ({k} % 7) / 10D, 'refuting', ({k} % 5) / 10D, 'neutral', ({k} % 4) / 10D, 'relevance', ({k} % 6) / 10D)"
        return F.expr(f"CASE WHEN doc_id % {every} <> 0 THEN {s} END")

    both = table(spark, sf_dir, "documents").select("doc_id", side(1, 5).alias("a"), side(3, 7).alias("b"))
    return V.combine_opinions(both).select("doc_id", "label", *[F.round(c, 6).alias(c) for c in ("confidence", "supporting", "refuting", "neutral", "relevance")])


@plan("WITH e AS (SELECT o_orderkey AS a, o_orderkey + 1 AS b, o_custkey % 9 AS x, o_custkey % 4 AS y FROM orders) SELECT e.a, e.b, length(list_intersect([e.x, e.y], [f.x, f.y]))::INT AS shared FROM e JOIN e f ON f.a = e.b")
def set_intersect_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number of entities that a claim shares with the next one."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("a"), F.array(F.col("o_custkey") % 9, F.col("o_custkey") % 4).alias("e"))
    n = o.select(F.col("a").alias("b"), F.col("e").alias("f"))
    return o.withColumn("b", F.col("a") + 1).join(n, "b").select("a", "b", F.size(F.array_intersect("e", "f")).alias("shared"))


@plan("""WITH c AS (SELECT c_custkey AS id, 40 + c_custkey % 50 AS claimed, 40 + c_custkey % 50 + c_custkey % 3 AS told, c_custkey % 6 AS way FROM customer)
SELECT id, CASE WHEN way = 5 THEN 'none' WHEN way = 4 THEN 'neutral' WHEN way = 3 THEN CASE WHEN id % 3 > 1 THEN 'refute' ELSE 'neutral' END WHEN told = claimed THEN 'support' ELSE 'refute' END AS label,
    round(CASE WHEN way = 5 THEN 0 WHEN way = 4 THEN 0.74::DOUBLE WHEN way = 3 THEN CASE WHEN id % 3 > 1 THEN 0.92::DOUBLE ELSE 0.72::DOUBLE END WHEN told = claimed THEN 0.9::DOUBLE ELSE 0.92::DOUBLE END, 2) AS confidence FROM c""")
def fn_nli_rule_age(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claimed ages at death against explicit ages, dates of birth and death, ranges of years, and nothing."""
    told = "(40 + c_custkey % 50 + c_custkey % 3)"
    c = table(spark, sf_dir, "customer").selectExpr(
        "c_custkey AS id",
        "CASE WHEN c_custkey % 2 = 0 THEN concat('Anna Maria Berg died at the age of ', 40 + c_custkey % 50, '.') ELSE concat('Anna Maria Berg was ', 40 + c_custkey % 50, ' years old when she died.') END AS claim",
        f"""CASE c_custkey % 6 WHEN 0 THEN concat('Anna Maria Berg, painter, died in Rome aged ', {told}) WHEN 1 THEN concat('anna maria berg was ', {told}, ' years old when she died')
            WHEN 2 THEN concat('Anna Maria Berg (4 May 1801 to 3 June ', 1801 + {told}, ')') WHEN 3 THEN concat('Anna Maria Berg (1801–', 1801 + {told}, ')') WHEN 4 THEN 'Anna Maria Berg painted.' ELSE 'Somebody else, aged 50, died.' END AS evidence""",
    )
    return L.death_age_rule(c).select("id", F.coalesce("rule_label", F.lit("none")).alias("label"), F.coalesce("rule_confidence", F.lit(0.0)).alias("confidence"))
