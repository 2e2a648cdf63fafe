"""Queries over evaluation reports, sources, retrieval details and small rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import reports as R
from ..operators import search as S
from ..operators import verify as V
from ..session import table
from .evaluation import PRED, predictions, r6
from .graph import EDGES, NODES, graph
from .registry import plan

_WORDS = r"list_filter(regexp_split_to_array({0}, '[ \t\n\r]+'), lambda w: w <> '')"


@plan("SELECT source AS category, count(*) AS n, round(avg(CASE WHEN doc_id % 3 <> 0 THEN 1.0::DOUBLE ELSE 0 END), 4) AS accuracy, round(count(*) FILTER (doc_id % 2 = 0 AND doc_id % 3 <> 0) / nullif(count(*) FILTER (doc_id % 2 = 0), 0), 4) AS mc1, round(count(*) FILTER (doc_id % 2 = 1 AND doc_id % 3 <> 0) / nullif(count(*) FILTER (doc_id % 2 = 1), 0), 4) AS mc2 FROM documents GROUP BY 1")
def agg_truthfulqa(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accuracy by category, over all questions and those with one or several right answers."""
    q = table(spark, sf_dir, "documents").select(F.col("source").alias("category"), (F.col("doc_id") % 3 != 0).alias("correct"), (F.col("doc_id") % 2 == 0).alias("single"))
    return R.question_accuracy(q, ["category"])


_TF = rf"""w AS (SELECT conv_id, role, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS w FROM conversations WHERE role IN ('user', 'assistant')), tf AS (SELECT conv_id, role, w, count(*) AS n FROM w GROUP BY ALL),
df AS (SELECT w, count(*) AS df FROM tf GROUP BY w), nd AS (SELECT count(*) AS nd FROM (SELECT DISTINCT conv_id, role FROM tf)), v AS (SELECT conv_id, role, w, n * (ln((1 + nd)::DOUBLE / (1 + df)) + 1) AS x FROM tf JOIN df USING (w), nd)"""


@plan(f"""WITH {_TF}, norms AS (SELECT conv_id, role, sqrt(sum(x * x)) AS norm FROM v GROUP BY ALL), d AS (SELECT a.conv_id, sum(a.x * b.x) AS d FROM v a JOIN v b ON a.conv_id = b.conv_id AND a.w = b.w AND a.role = 'user' AND b.role = 'assistant' GROUP BY 1)
SELECT p.conv_id, round(coalesce(d, 0) / (p.norm * q.norm), 6) AS cosine FROM norms p JOIN norms q ON p.conv_id = q.conv_id AND p.role = 'user' AND q.role = 'assistant' LEFT JOIN d ON d.conv_id = p.conv_id""")
def agg_tfidf_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cosine of smoothed tf-idf vectors of what each side of a conversation says."""
    c = table(spark, sf_dir, "conversations").where("role IN ('user', 'assistant')")
    return R.tfidf_cosine(c, "conv_id", "role", "text", "user", "assistant").select("conv_id", F.round("cosine", 6).alias("cosine"))


_UNITS = r"""t AS (SELECT conv_id, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations), u0 AS (SELECT conv_id, CASE WHEN k = 1 THEN 'question' WHEN k = 2 THEN 'answer' WHEN k = n AND n > 3 THEN 'truth' ELSE 'context' END AS kind, k::INT AS ord, text FROM t WHERE trim(text) <> ''),
u AS (SELECT * FROM u0 UNION ALL SELECT conv_id, 'sentence', i::INT, s[i + 1] FROM (SELECT conv_id, s, unnest(range(0, len(s))) AS i FROM (SELECT conv_id, list_filter(list_transform(regexp_split_to_array(text, '[.!?\n]+'), lambda x: trim(x)), lambda x: x <> '') AS s FROM u0 WHERE kind = 'answer'))),
tf AS (SELECT conv_id, kind, ord, w, count(*) AS n FROM (SELECT conv_id, kind, ord, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS w FROM u) GROUP BY ALL), df AS (SELECT w, count(*) AS df FROM tf WHERE kind <> 'sentence' GROUP BY 1),
x AS (SELECT conv_id, kind, ord, w, n * (ln((1 + (SELECT count(*) FROM u0))::DOUBLE / (1 + df)) + 1) AS x FROM tf JOIN df USING (w)), v AS (SELECT *, x / sqrt(sum(x * x) OVER (PARTITION BY conv_id, kind, ord)) AS y FROM x),
dots AS (SELECT a.conv_id, a.kind, a.ord AS i, b.kind AS other, b.ord AS j, sum(a.y * b.y) AS c FROM v a JOIN v b ON a.conv_id = b.conv_id AND a.w = b.w AND ((b.kind = 'context' AND a.kind <> 'context') OR (a.kind = 'question' AND b.kind = 'answer')) GROUP BY ALL),
p AS (SELECT a.conv_id, a.kind, a.ord AS i, b.kind AS other, b.ord AS j, coalesce(c, 0) AS c FROM u a JOIN u b ON a.conv_id = b.conv_id AND ((b.kind = 'context' AND a.kind <> 'context') OR (a.kind = 'question' AND b.kind = 'answer')) LEFT JOIN dots d ON d.conv_id = a.conv_id AND d.kind = a.kind AND d.i = a.ord AND d.other = b.kind AND d.j = b.ord),
best AS (SELECT conv_id, kind, i, max(c) AS c FROM p WHERE other = 'context' GROUP BY ALL)"""


@plan(f"""WITH {_UNITS}, q AS (SELECT conv_id, avg(CASE WHEN c >= 0.1::DOUBLE THEN 1.0::DOUBLE ELSE 0 END) AS precision FROM p WHERE kind = 'question' AND other = 'context' GROUP BY 1)
SELECT conv_id, round(coalesce((SELECT max(c) FROM p WHERE p.conv_id = q.conv_id AND other = 'answer'), -1), 6) AS answer_relevancy, round(precision, 6) AS context_precision, round(coalesce((SELECT max(c) FROM best WHERE best.conv_id = q.conv_id AND kind = 'truth'), -1), 6) AS context_recall,
    round(coalesce((SELECT max(c) FROM best WHERE best.conv_id = q.conv_id AND kind = 'answer'), -1), 6) AS context_utilization, round(coalesce((SELECT avg(CASE WHEN c >= 0.2::DOUBLE THEN 1.0::DOUBLE ELSE 0 END) FROM best WHERE best.conv_id = q.conv_id AND kind = 'sentence'), -1), 6) AS faithfulness FROM q""")
def agg_rag_proxies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five proxies of retrieval quality for each conversation: its first turns as question and answer, the last as truth,
    those between as contexts; -1 where there is nothing to measure."""
    w = Window.partitionBy("conv_id")
    t = table(spark, sf_dir, "conversations").withColumn("ord", F.row_number().over(w.orderBy("turn"))).withColumn("n", F.count("*").over(w))
    kind = F.when(F.col("ord") == 1, "question").when(F.col("ord") == 2, "answer").when((F.col("ord") == F.col("n")) & (F.col("n") > 3), "truth").otherwise("context")
    names = ("answer_relevancy", "context_precision", "context_recall", "context_utilization", "faithfulness")
    out = R.rag_proxies(t.select("conv_id", kind.alias("kind"), "ord", "text"), "conv_id")
    return out.select("conv_id", *[F.round(F.coalesce(c, F.lit(-1.0)), 6).alias(c) for c in names])


_CITED = r"SELECT doc_id, coalesce(text, '') || CASE doc_id % 3 WHEN 0 THEN ' See [1] and [9].' WHEN 1 THEN ' As (2) says [2].' ELSE '' END AS t, 3 AS n FROM documents"


@plan(rf"""WITH r AS ({_CITED}), m AS (SELECT doc_id, list_transform(regexp_extract_all(t, '\[([0-9]+)\]', 1), lambda x: x::BIGINT) AS m, list_filter(list_transform(regexp_split_to_array(t, '[.!?\n]+'), lambda s: trim(s)), lambda s: s <> '') AS s, {_WORDS.format('t')} AS w, n FROM r)
SELECT doc_id, length(m) AS markers, length(list_filter(m, lambda x: x BETWEEN 1 AND n)) AS valid, length(s) AS sentences, length(list_filter(s, lambda x: regexp_matches(x, '\[[0-9]+\]'))) AS cited, round(100.0::DOUBLE * length(m) / greatest(1, length(w)), 6) AS per_100_words FROM m""")
def agg_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Citation marks of each answer: how many, how many point at given evidence, how many sentences have one."""
    tail = F.when(F.col("doc_id") % 3 == 0, " See [1] and [9].").when(F.col("doc_id") % 3 == 1, " As (2) says [2].").otherwise("")
    d = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.coalesce("text", F.lit("")), tail).alias("text"), F.lit(3).alias("n_evidence"))
    c = R.citations(d, "doc_id")
    return c.withColumn("per_100_words", F.round("per_100_words", 6))


@plan(f"""WITH {PRED}, c AS (SELECT evaluator, domain, avg(correct::INT) AS a, count(*) AS n FROM pred GROUP BY ALL) SELECT domain, evaluator, n, round(a, 6) AS accuracy, round(a - max(a) OVER (PARTITION BY domain), 6) AS behind, rank() OVER (PARTITION BY domain ORDER BY a DESC) AS place FROM c""")
def agg_strategy_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evaluators against the best one of each domain (agg_comparison_table)."""
    p = predictions(spark, sf_dir).groupBy("domain", "evaluator").agg(F.avg(F.col("correct").cast("double")).alias("a"), F.count("*").alias("n"))
    w = Window.partitionBy("domain")
    return p.select("domain", "evaluator", "n", F.round("a", 6).alias("accuracy"), F.round(F.col("a") - F.max("a").over(w), 6).alias("behind"), F.rank().over(w.orderBy(F.desc("a"))).cast("long").alias("place"))


@plan("SELECT event_type, count(*) AS n, max(value) < 90 AS fine, coalesce(min(CASE WHEN value >= 90 THEN event_id END), -1) AS stopped_at FROM events GROUP BY 1")
def filt_latency_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kinds that stay under a latency limit, and the first sample that broke it."""
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"), (F.max("value") < 90).alias("fine"), F.coalesce(F.min(F.when(F.col("value") >= 90, F.col("event_id"))), F.lit(-1)).alias("stopped_at"))


@plan("""WITH e AS (SELECT event_type AS pass, epoch_us(ts) AS t, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS processed, count(*) OVER (PARTITION BY event_type) AS total, min(epoch_us(ts)) OVER (PARTITION BY event_type) AS t0 FROM events),
r AS (SELECT pass, processed, total, processed / greatest((t - t0) / 1e6::DOUBLE, 1e-6::DOUBLE) AS rate FROM e WHERE processed % 100 = 0)
SELECT pass, processed, total AS total_estimate, round(rate * 3600, 4) AS rate_per_hour, round(greatest(0, total - processed) / rate / 3600, 3) AS eta_hours FROM r""")
def agg_integrity_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Progress of each pass after every hundredth record: rate since its start, and the hours that are left."""
    e = table(spark, sf_dir, "events").select(F.col("event_type").alias("pass"), "event_id", F.unix_micros(F.to_timestamp("ts")).alias("at"))
    return R.progress_events(e, "pass", "at", "event_id", 100).select("pass", "processed", "total_estimate", F.round(F.col("rate") * 3600, 4).alias("rate_per_hour"), F.round("eta_hours", 3).alias("eta_hours"))


@plan("""WITH d AS (SELECT doc_id // 20 AS claim, doc_id AS id, n_chars, lang FROM documents), direct AS (SELECT claim, id, n_chars / 1e5::DOUBLE AS score, 1 AS way FROM d WHERE n_chars > 3000),
a AS (SELECT * FROM direct UNION ALL SELECT claim, id, 0.5::DOUBLE, 2 FROM d WHERE claim NOT IN (SELECT claim FROM direct) UNION ALL SELECT claim, id, n_chars / 2e5::DOUBLE, 3 FROM d WHERE lang = 'de'),
f AS (SELECT *, row_number() OVER (PARTITION BY claim, id ORDER BY way) AS k FROM a) SELECT claim, id, way, round(score, 6) AS score FROM f WHERE k = 1""")
def set_union_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence of several searches as one set: the entity search counts only for claims whose direct search found nothing,
    and the first search that found a text keeps it (set_union_sources)."""
    d = table(spark, sf_dir, "documents").withColumn("claim", F.floor(F.col("doc_id") / 20)).withColumn("id", F.col("doc_id"))
    way = lambda rows, score: rows.select("claim", "id", F.round(score, 6).alias("score"))
    direct = way(d.where("n_chars > 3000"), F.col("n_chars") / 1e5)
    return R.union_first([direct, R.only_without(way(d, F.lit(0.5)), direct, ["claim"]), way(d.where("lang = 'de'"), F.col("n_chars") / 2e5)], ["claim", "id"]).select("claim", "id", "way", "score")


@plan("""WITH r AS (SELECT user_id AS claim, event_type AS source, max(value) AS relevance FROM events GROUP BY ALL), o AS (SELECT *, relevance >= 50 AND source <> 'error' AS fits FROM r), k AS (SELECT *, row_number() OVER (PARTITION BY claim, fits ORDER BY relevance DESC, source) AS k FROM o)
SELECT claim, source, fits AND k <= 2 AS selected FROM k""")
def topk_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Available sources above a floor, the two best of each claim; all others are skipped."""
    r = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("claim"), F.col("event_type").alias("source")).agg(F.max("value").alias("relevance"))
    return R.select_sources(r, "claim", available=F.col("source") != "error", least=50, most=2)


@plan("SELECT event_id FROM events ORDER BY ts DESC, event_id DESC LIMIT 20")
def sort_recent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last twenty runs (the limit is the feature)."""
    return table(spark, sf_dir, "events").orderBy(F.desc("ts"), F.desc("event_id")).limit(20).select("event_id")


_KEYS = {"medical": "patient disease treatment hospital medicine symptom", "technical": "software code api database algorithm python", "science": "research experiment physics chemistry biology", "legal": "law court legal regulation contract", "finance": "stock market investment bank economy"}


@plan(f"SELECT doc_id, CASE {' '.join('WHEN ' + ' OR '.join(f'contains(lower(text), {chr(39)}{w}{chr(39)})' for w in ws.split()) + f' THEN {chr(39)}{d}{chr(39)}' for d, ws in _KEYS.items())} ELSE 'general' END AS domain, CASE WHEN length({_WORDS.format('text')}) <= 15 THEN 'easy' WHEN length({_WORDS.format('text')}) <= 30 THEN 'medium' ELSE 'hard' END AS difficulty FROM documents")
def fn_domain_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Domain by the first list with a word in the text, difficulty by its number of words (fn_difficulty)."""
    return table(spark, sf_dir, "documents").select("doc_id", R.keyword_domain(F.col("text")).alias("domain"), R.difficulty(F.col("text")).alias("difficulty"))


@plan("""WITH d AS (SELECT doc_id, ['general', 'biomedical', 'legal', 'code', 'social'][1 + doc_id % 5] AS domain FROM documents) SELECT doc_id, name, CASE WHEN name = domain THEN 0.8::DOUBLE WHEN name = 'general' THEN 0.1::DOUBLE ELSE 0.05::DOUBLE END AS weight FROM d, (VALUES ('general'), ('biomedical'), ('legal'), ('code'), ('social')) n(name)""")
def fn_domain_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").selectExpr("doc_id", "array('general', 'biomedical', 'legal', 'code', 'social')[cast(doc_id % 5 AS int)] AS domain")
    return d.select("doc_id", F.explode(R.domain_weights(F.col("domain"))).alias("name", "weight"))


@plan("""WITH e AS (SELECT doc_id // 20 AS claim, doc_id, source, lang, n_chars, text FROM documents), s AS (SELECT claim, source, count(*) AS n FROM e GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY claim ORDER BY doc_id) AS k FROM e),
n AS (SELECT DISTINCT claim, unnest(['x' || source, 'x' || lang]) AS id FROM r WHERE k <= 20), m AS (SELECT *, row_number() OVER (PARTITION BY claim ORDER BY n_chars DESC, doc_id) AS k FROM e)
SELECT claim, 'claim' AS kind, 'c' || claim AS id, 0 AS depth, 1.0::DOUBLE AS weight FROM (SELECT DISTINCT claim FROM e) UNION ALL SELECT claim, 'source', 's' || source, 1, round(least(1.0::DOUBLE, n / 10.0::DOUBLE), 6) FROM s UNION ALL SELECT claim, 'evidence', 'e' || doc_id, 2, round(n_chars / (n_chars + 1000.0::DOUBLE), 6) FROM e
UNION ALL SELECT claim, 'entity', id, 3, 0.5::DOUBLE FROM n UNION ALL SELECT claim, 'fact', 'f' || doc_id, 3, round(n_chars / (n_chars + 1000.0::DOUBLE), 6) FROM m WHERE k <= 15""")
def gr_mesh(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of a provenance graph: the claim, its sources, their evidence, entities of its first twenty relationships and
    its fifteen nearest texts, with depth and weight (the limits are the operator's own)."""
    d = table(spark, sf_dir, "documents").select(F.floor(F.col("doc_id") / 20).alias("claim"), "doc_id", "source", "lang", (F.col("n_chars") / (F.col("n_chars") + 1000)).alias("weight"), "n_chars")
    relations = d.select("claim", F.col("doc_id").alias("ord"), F.col("source").alias("left"), F.col("lang").alias("right"))
    nodes = R.mesh_nodes(d.select("claim", "doc_id", "source", "weight")).unionByName(R.mesh_entities(relations)).unionByName(R.mesh_facts(d.select("claim", "doc_id", "weight", F.col("n_chars").alias("score"))))
    return nodes.withColumn("weight", F.round("weight", 6))


@plan("""SELECT doc_id // 20 AS claim, 's' || source AS src, 'e' || doc_id AS dst, 'PROVIDES' AS type FROM documents UNION SELECT doc_id // 20, 'c' || (doc_id // 20), 's' || source, 'ASKS' FROM documents""")
def gr_mesh_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges of the provenance graph (gr_mesh_enhance adds one more depth in the same way)."""
    e = table(spark, sf_dir, "documents").select(F.floor(F.col("doc_id") / 20).alias("claim"), "doc_id", "source")
    return R.mesh_edges(e)


@plan("SELECT doc_id, n_chars FROM documents WHERE n_chars >= 200 AND NOT coalesce(doc_id % 7 = 0, false) AND NOT coalesce(doc_id % 13 = 0, false) AND (lang = 'en' OR source = 'src1')")
def filt_enhanced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality floor, no disambiguation, no redirect, a wanted label; missing flags count as false; all that pass."""
    d = table(spark, sf_dir, "documents")
    no = lambda c: ~F.coalesce(c, F.lit(False))
    keep = (F.col("n_chars") >= 200) & no(F.col("doc_id") % 7 == 0) & no(F.col("doc_id") % 13 == 0) & ((F.col("lang") == "en") | (F.col("source") == "src1"))
    return d.where(keep).select("doc_id", "n_chars")


@plan("SELECT o_orderkey AS hit, doc_id, md5(text) AS digest FROM orders JOIN documents ON doc_id = o_orderkey")
def join_passage_fetch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts of hits by id; hits without a text fall out."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.md5(F.col("text").cast("binary")).alias("digest"))
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("hit")).join(d, F.col("hit") == F.col("doc_id"))


@plan("SELECT doc_id, least([5, 9, 13][1 + doc_id % 3], greatest(1, coalesce(nullif(doc_id % 20, 0), 13)))::BIGINT AS most FROM documents")
def fn_max_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tier's number of claims, which a configured number can only lower."""
    d = table(spark, sf_dir, "documents").selectExpr("doc_id", "cast(array(5, 9, 13)[cast(doc_id % 3 AS int)] AS bigint) AS tier", "nullif(doc_id % 20, 0) AS configured")
    return d.select("doc_id", F.least("tier", F.greatest(F.lit(1), F.coalesce("configured", F.lit(13)))).alias("most"))


@plan("""SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'ids' WHEN doc_id % 4 = 1 THEN 'random' ELSE 'curated' END AS strategy, least(5000, greatest(1, CASE WHEN doc_id % 3 = 0 THEN CASE WHEN doc_id % 4 = 1 AND doc_id % 2 = 1 THEN 2000 ELSE 50 END ELSE doc_id END))::BIGINT AS most FROM documents""")
def fn_run_config(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Run settings with their defaults: explicit ids win, the default limit depends on source and strategy."""
    strategy = F.when(F.col("doc_id") % 4 == 0, "ids").when(F.col("doc_id") % 4 == 1, "random").otherwise("curated")
    c = table(spark, sf_dir, "documents").select("doc_id", strategy.alias("strategy"), F.when(F.col("doc_id") % 2 == 1, "wikipedia").otherwise("wikidata").alias("source"), F.when(F.col("doc_id") % 3 != 0, F.col("doc_id")).alias("asked"))
    return c.select("doc_id", "strategy", R.run_limit(F.col("source"), F.col("strategy"), F.col("asked")).alias("most"))


@plan("SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN greatest(1, 7) WHEN doc_id % 5 = 1 THEN 3 WHEN doc_id % 5 = 2 THEN 2 WHEN doc_id % 5 = 3 THEN 9 ELSE doc_id END::BIGINT AS expected FROM documents")
def fn_expected_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items that a message stands for: a random limit, else its titles, else its ids, else its search limit, else what was fetched."""
    m = table(spark, sf_dir, "documents").selectExpr("doc_id", "CASE WHEN doc_id % 5 = 0 THEN 7L END AS random_limit", "CASE WHEN doc_id % 5 = 1 THEN array('a', 'b', 'c') END AS titles", "CASE WHEN doc_id % 5 = 2 THEN array('Q1', 'Q2') END AS qids", "CASE WHEN doc_id % 5 = 3 THEN 9L END AS search_limit")
    size = lambda c: F.when(F.size(c) > 0, F.size(c).cast("long"))
    return m.select("doc_id", F.coalesce(F.when(F.col("random_limit").isNotNull(), F.greatest(F.lit(1), F.col("random_limit"))), size("titles"), size("qids"), "search_limit", "doc_id").alias("expected"))


@plan(f"WITH {NODES}, {EDGES} SELECT count(*) FILTER (stub) AS stubs, count(*) AS nodes, (SELECT count(*) FROM edges WHERE dst LIKE 'X%') AS to_stubs FROM nodes")
def agg_stubs(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges = graph(spark, sf_dir)
    rows = nodes.select(F.col("stub").alias("a"), F.lit(True).alias("b"), F.lit(False).alias("c")).union(edges.select(F.lit(False), F.lit(False), F.col("dst").startswith("X")))
    return rows.agg(F.count_if("a").alias("stubs"), F.count_if("b").alias("nodes"), F.count_if("c").alias("to_stubs"))


@plan("SELECT doc_id % 40 AS claim, count(DISTINCT source) AS n_sources, string_agg(DISTINCT source, ',' ORDER BY source) AS sources FROM documents GROUP BY 1")
def agg_distinct_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").groupBy((F.col("doc_id") % 40).alias("claim")).agg(F.sort_array(F.collect_set("source")).alias("s"))
    return d.select("claim", F.size("s").cast("long").alias("n_sources"), F.array_join("s", ",").alias("sources"))


@plan("SELECT item_id, CASE WHEN length(text) <= 50 THEN text ELSE substring(text, 1, 49) || '…' END AS label FROM benchmark")
def fn_truncate_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select("item_id", R.short_label(F.col("text")).alias("label"))


@plan("SELECT conv_id, turn, CASE WHEN length(trim(text)) >= 40 THEN role || ': ' || text WHEN turn % 2 = 0 THEN role || ': extract' ELSE role END AS content, CASE role WHEN 'user' THEN 'wikipedia' WHEN 'assistant' THEN 'pubmed' ELSE 'external_api' END AS source FROM conversations")
def fn_build_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence of a search result: the snippet if it is useful, else the extract, else the title; its source's name (fn_source_enum, fn_result_to_evidence)."""
    c = table(spark, sf_dir, "conversations")
    content = R.content_of(F.col("role"), F.col("text"), F.when(F.col("turn") % 2 == 0, "extract").otherwise(""))
    names = F.create_map(F.lit("user"), F.lit("wikipedia"), F.lit("assistant"), F.lit("pubmed"))
    return c.select("conv_id", "turn", content.alias("content"), F.coalesce(names[F.col("role")], F.lit("external_api")).alias("source"))


@plan("WITH p AS (SELECT doc_id // 20 AS doc, (n_chars % 100) / 100.0::DOUBLE AS p FROM documents) SELECT doc, count(*) AS n_claims, round(CASE WHEN count(*) = 1 THEN max(p) ELSE exp(sum(ln(least(1 - 1e-6::DOUBLE, greatest(1e-6::DOUBLE, p))))) END, 9) AS doc_score FROM p GROUP BY doc")
def agg_doc_product(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = table(spark, sf_dir, "documents").select(F.floor(F.col("doc_id") / 20).alias("doc"), ((F.col("n_chars") % 100) / 100).alias("p_true"))
    return V.doc_product(b, ["doc"]).withColumn("doc_score", F.round("doc_score", 9))


@plan("""WITH v AS (SELECT doc_id // 20 AS doc, (n_chars % 100) / 100.0::DOUBLE AS p, greatest(0, (n_chars % 100) / 100.0::DOUBLE - 0.1::DOUBLE) AS lo, least(1, (n_chars % 100) / 100.0::DOUBLE + 0.2::DOUBLE) AS hi FROM documents), d AS (SELECT doc, exp(avg(ln(least(0.999::DOUBLE, greatest(0.001::DOUBLE, p))))) AS s, min(lo) AS lo, max(hi) AS hi FROM v GROUP BY doc)
SELECT doc, floor(s * 10000 + 0.5::DOUBLE) / 10000 AS doc_score, floor(least(lo, s) * 10000 + 0.5::DOUBLE) / 10000 AS doc_low, floor(greatest(hi, s) * 10000 + 0.5::DOUBLE) / 10000 AS doc_high FROM d""")
def agg_doc_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = (F.col("n_chars") % 100) / 100
    v = table(spark, sf_dir, "documents").select(F.floor(F.col("doc_id") / 20).alias("doc"), p.alias("p_true"), F.greatest(F.lit(0.0), p - 0.1).alias("low"), F.least(F.lit(1.0), p + 0.2).alias("high"))
    return V.geo_mean(v, ["doc"]).drop("consistency")


@plan("""WITH s AS (SELECT doc_id // 20 AS claim, least(1, greatest(0, (doc_id % 11) / 10.0::DOUBLE * (doc_id % 4) / 3.0::DOUBLE * 0.7::DOUBLE)) AS v FROM documents) SELECT claim, round(coalesce(least(1, max(v) * 0.75::DOUBLE + avg(v) * 0.25::DOUBLE), 0), 6) AS signal FROM s GROUP BY claim""")
def agg_signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best value with three quarters, mean with one quarter, of score * credibility (0.7 where unknown) * relevance."""
    d = table(spark, sf_dir, "documents").selectExpr("doc_id div 20 AS claim", "(doc_id % 11) / 10D AS score", "cast(NULL AS double) AS credibility", "(doc_id % 4) / 3D AS relevance")
    return d.groupBy("claim").agg(F.round(V._signal("score", F.lit(True)), 6).alias("signal"))


@plan("""WITH p AS (SELECT vec_id AS vid, embedding::DOUBLE[] AS v, (vec_id % 90)::DOUBLE AS lat, (vec_id % 40)::DOUBLE AS lon FROM embeddings), near AS (SELECT * FROM p WHERE 2 * 6371.0::DOUBLE * asin(least(1, sqrt(pow(sin((radians(48.0::DOUBLE) - radians(lat)) / 2), 2) + cos(radians(lat)) * cos(radians(48.0::DOUBLE)) * pow(sin(radians(11.0::DOUBLE - lon) / 2), 2)))) <= 1500),
s AS (SELECT q.vec_id AS qid, vid, list_dot_product(q.embedding::DOUBLE[], v) / (sqrt(list_dot_product(q.embedding::DOUBLE[], q.embedding::DOUBLE[])) * sqrt(list_dot_product(v, v))) AS score FROM embeddings q JOIN near ON q.vec_id <> vid WHERE q.vec_id % 20 = 0)
SELECT qid, vid, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, vid) AS k FROM s) WHERE k <= 3""")
def vec_by_coords(spark: SparkSession, sf_dir: str) -> DataFrame:
    """k-NN among vectors whose place is within a radius."""
    e = table(spark, sf_dir, "embeddings")
    corpus = e.selectExpr("vec_id AS vid", "embedding AS vec", "cast(vec_id % 90 AS double) AS lat", "cast(vec_id % 40 AS double) AS lon")
    q = e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("qvec"))
    return S.knn(q, corpus, 3, filt=S.PayloadFilter(near=(48.0, 11.0, 1500.0))).select("qid", "vid", F.round("score", 6).alias("score"))


@plan(f"""WITH {NODES}, {EDGES}, w AS (SELECT 'Region' AS w UNION SELECT 'REGION_1' UNION SELECT 'NATION_2'), hit AS (SELECT DISTINCT id FROM nodes JOIN w ON contains(lower(name), lower(w))), u AS (SELECT src, dst, type FROM edges WHERE type = 'PART_OF' UNION ALL SELECT dst, src, type FROM edges WHERE type = 'PART_OF') SELECT DISTINCT src AS id, type, dst AS other FROM u JOIN hit ON hit.id = src""")
def join_entity_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One undirected hop from the nodes whose name holds a capitalized word of the claim."""
    nodes, edges = graph(spark, sf_dir)
    return R.entity_search(nodes, edges.where("type = 'PART_OF'"), "Which Region is REGION_1 in, and NATION_2?")
