"""Queries over search candidates, found pages, cases made false or read from records, article chunks and trees."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import candidates as C
from ..operators import chunking
from ..operators import corpus as O
from ..operators import inference as I
from ..operators import search as S
from ..operators import wikitext as W
from ..session import table
from .claims import _in, _runs_sql
from .registry import plan
from .search import _vectors
from .verify import sentences_sql, squeeze_sql
from .wikitext import articles

_NAMES = _runs_sql(r"list_filter(list_transform(regexp_split_to_array({0}, '[ \t\n\r]+'), lambda w: regexp_replace(regexp_replace(w, '^[^\p{{L}}\p{{N}}_]+', ''), '[^\p{{L}}\p{{N}}_-]+$', '')), lambda w: w <> '')".format("text"), rf"regexp_matches(w, '^\p{{Lu}}.') AND w NOT IN ({_in(C.NAME_STOP)})")
_RANKED = f"""r AS (SELECT conv_id, turn, {_NAMES} AS r FROM conversations), e AS (SELECT conv_id, turn, unnest(r) AS e, generate_subscripts(r, 1) AS i FROM r), d AS (SELECT conv_id, turn, e, min(i) AS i FROM e GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY length(string_split(e, ' ')) DESC, length(e) DESC, i) AS k FROM d)"""


@plan(f"WITH {_RANKED} SELECT c.conv_id, c.turn, coalesce(string_agg(e, '|' ORDER BY k), '') AS entities FROM conversations c LEFT JOIN k ON k.conv_id = c.conv_id AND k.turn = c.turn AND k <= 4 GROUP BY ALL")
def fn_entities_mw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names in a text, those of most words first."""
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.array_join(C.named_candidates(F.col("text")), "|").alias("entities"))


_FOUNDED = "concat(CASE turn % 3 WHEN 0 THEN 'The ' WHEN 1 THEN 'Die ' ELSE '' END, role, ' number one of all ', CASE conv_id % 2 WHEN 0 THEN 'was founded ' ELSE '' END, text)"
_SUBJECT = f"""w AS (SELECT conv_id, turn, regexp_extract_all({_FOUNDED}, '{C.WORD}') AS w FROM conversations), b AS (SELECT conv_id, turn, w[1:coalesce(list_position(list_transform(w, lambda x: lower(x) IN ({_in(C.VERBS)})), true), 1) - 1] AS b FROM w),
s AS (SELECT conv_id, turn, b, list_position(list_transform(b, lambda x: lower(x) NOT IN ({_in(C.DETERMINERS)})), true) AS f FROM b)"""


@plan(f"WITH {_SUBJECT} SELECT conv_id, turn, CASE WHEN f > 0 THEN array_to_string(b[f:f + 3], ' ') ELSE '' END AS subject FROM s")
def fn_subject_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words before the first verb, without articles, four at most."""
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", C.subject_guess(F.expr(_FOUNDED)).alias("subject"))


_SHORT = "substring(" + squeeze_sql("coalesce({0}, '')") + ", 1, 200)"
_WORDS = f"list_filter(regexp_extract_all(lower(coalesce({{0}}, '')), '{C.KEYWORD}'), lambda w: w NOT IN ({_in(C.KEYWORD_STOP)}))"
_CLAIM = {"subject": "CASE WHEN turn % 2 = 0 THEN concat(role, ' ', CAST(conv_id AS STRING)) END", "predicate": "'was founded in'", "object": "concat('Town  ', CAST(turn AS STRING))", "normalized": "lower(text)"}


@plan(f"""WITH {_RANKED}, n AS (SELECT c.conv_id, c.turn, list(e ORDER BY k) FILTER (e IS NOT NULL) AS names FROM conversations c LEFT JOIN k ON k.conv_id = c.conv_id AND k.turn = c.turn AND k <= 4 GROUP BY ALL),
{_SUBJECT.replace(_FOUNDED, "text")}, g AS (SELECT conv_id, turn, CASE WHEN f > 0 THEN array_to_string(b[f:f + 3], ' ') ELSE '' END AS guess FROM s),
c AS (SELECT conv_id, turn, text, {", ".join(f"{v} AS {k}" for k, v in _CLAIM.items())} FROM conversations),
l AS (SELECT conv_id, turn, list_concat([{_SHORT.format("subject")}, guess, {_SHORT.format("object")}, {_SHORT.format("concat_ws(' ', subject, predicate, object)")}, {_SHORT.format("normalized")}], coalesce(names, []), [{_SHORT.format("array_to_string(list_slice(" + _WORDS.format("concat_ws(' ', predicate, object, text)") + ", 1, 6), ' ')")}, {_SHORT.format("text")}]) AS l FROM c JOIN n USING (conv_id, turn) JOIN g USING (conv_id, turn)),
u AS (SELECT conv_id, turn, unnest(l) AS q, generate_subscripts(l, 1) AS i FROM l), m AS (SELECT conv_id, turn, q, min(i) AS i FROM u WHERE q <> '' GROUP BY ALL) SELECT conv_id, turn, count(*) AS n, md5(string_agg(q, '|' ORDER BY i)) AS queries FROM m GROUP BY ALL""")
def fn_query_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries of a claim in order: parts of it, names in it, its telling words, itself."""
    q = C.query_candidates(F.col("text"), *[F.expr(_CLAIM[k]) for k in ("subject", "predicate", "object", "normalized")])
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", q.alias("q"))
    return c.select("conv_id", "turn", F.size("q").cast("long").alias("n"), F.md5(F.array_join("q", "|").cast("binary")).alias("queries"))


_RESULTS = {"claim": "CAST(floor(p_partkey / 10) AS BIGINT)", "query_index": "CAST(floor(p_partkey % 10 / 5) AS INT)", "result_index": "CAST(p_partkey % 5 AS INT)", "page_id": "p_size % 8", "title": "p_name", "snippet": "concat('<b>', p_brand, '</b> of ', p_type, ' in town ', CAST(p_size AS STRING))", "subject": "CASE floor(p_partkey / 10) % 3 WHEN 0 THEN 'small  Ring' WHEN 1 THEN 'ring' END", "object": "CASE floor(p_partkey / 10) % 2 WHEN 0 THEN 'Economy town' ELSE 'town 7' END", "predicate": "'was made of'"}
_FOUND = f"""f AS (SELECT *, CASE WHEN query_index = 0 THEN coalesce(subject, 'x') ELSE object END AS matched_query FROM (SELECT {", ".join(f"{v} AS {k}" for k, v in _RESULTS.items())} FROM part)),
o AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY claim, page_id ORDER BY query_index, result_index) AS k FROM f) WHERE k = 1),
t AS (SELECT *, lower({squeeze_sql("title")}) AS lt, lower({squeeze_sql("matched_query")}) AS lq, lower({squeeze_sql("coalesce(subject, '')")}) AS ls, lower({squeeze_sql("object")}) AS lo, lower({squeeze_sql("regexp_replace(snippet, '<[^>]*>', ' ', 'g')")}) AS sn FROM o),
p AS (SELECT *, CASE WHEN ls = '' THEN 0 ELSE 5.0::DOUBLE * length(list_filter(string_split(ls, ' '), lambda x: contains(lt, x))) + CASE WHEN lt = ls THEN 40 WHEN contains(lt, ls) THEN 15 ELSE 0 END END + CASE WHEN lq = ls THEN 10 WHEN lq = lt THEN 6 ELSE 0 END + CASE WHEN contains(sn, lo) THEN 12 WHEN contains(lt, lo) THEN 6 ELSE 0 END
    + 6 * length(list_filter({_WORDS.format("object")}, lambda x: list_contains(list_concat({_WORDS.format("lt")}, {_WORDS.format("sn")}), x))) + 2.5::DOUBLE * length(list_filter({_WORDS.format("predicate")}, lambda x: contains(sn, x))) + least(8.0::DOUBLE, length(sn) / 80.0::DOUBLE) - query_index * 0.75::DOUBLE - result_index * 1.5::DOUBLE AS score FROM t),
q AS (SELECT *, row_number() OVER (PARTITION BY claim ORDER BY score DESC, query_index, result_index) AS r FROM p), h AS (SELECT *, min(CASE WHEN r > 1 AND matched_query = object THEN r END) OVER (PARTITION BY claim) AS second FROM q),
z AS (SELECT *, row_number() OVER (PARTITION BY claim ORDER BY CASE WHEN r = 1 THEN 0 WHEN r = second THEN 1 ELSE 2 END, r) AS place FROM h)"""


@plan(f"WITH {_FOUND} SELECT claim, page_id, title, round(score, 6) AS score, place::INT AS place, round(greatest(0.65::DOUBLE, 0.9::DOUBLE - (place - 1) * 0.08::DOUBLE), 6) AS similarity FROM z WHERE place <= 3")
def topk_mediawiki(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Found pages by score: the best, the best for the object, and the next."""
    r = table(spark, sf_dir, "part").selectExpr(*[f"{v} AS {k}" for k, v in _RESULTS.items()])
    r = r.withColumn("matched_query", F.when(F.col("query_index") == 0, F.coalesce("subject", F.lit("x"))).otherwise(F.col("object")))
    return C.best_results(r, ["claim"]).select("claim", "page_id", "title", F.round("score", 6).alias("score"), "place", F.round("similarity", 6).alias("similarity"))


_CASE = "concat(CASE doc_id % 3 WHEN 0 THEN 'In 1987 it ' WHEN 1 THEN 'About 45 of them ' ELSE 'No one ' END, CASE doc_id % 4 WHEN 0 THEN 'is the first ' WHEN 1 THEN 'has the largest ' WHEN 2 THEN 'can go to England ' ELSE 'goes home ' END, coalesce(text, ''))"


def _draw_sql(purpose: str) -> str:
    return f"('0x' || substring(md5(id || ':{purpose}'), 1, 7))::BIGINT"


def _first_sql(old: str, new: str) -> str:
    return f"substring(text, 1, instr(text, {old}) - 1) || {new} || substring(text, instr(text, {old}) + length({old}))"


def _step_sql(steps: tuple[int, ...], purpose: str) -> str:
    return f"[{', '.join(map(str, steps))}][1 + {_draw_sql(purpose)} % {len(steps)}]"


def _changes_sql(pairs: tuple[tuple[str, str], ...], where: str) -> str:
    return "CASE " + " ".join(f"WHEN contains({where}, '{a}') THEN CASE WHEN instr(text, '{a}') > 0 THEN {_first_sql(repr(a), repr(b))} ELSE text END" for a, b in pairs) + " ELSE text END"


def _any_sql(pairs: tuple[tuple[str, str], ...], where: str) -> str:
    return "(" + " OR ".join(f"contains({where}, '{a}')" for a, _ in pairs) + ")"


@plan(rf"""WITH c AS (SELECT doc_id AS id, {_CASE} AS text, doc_id % 5 <> 0 AS label FROM documents), n AS (SELECT floor(count(*) * 0.4::DOUBLE / 0.6::DOUBLE)::BIGINT - count(*) FILTER (NOT label) AS n FROM c),
p AS (SELECT *, {_draw_sql("way")} % 100 AS way, regexp_extract(text, '\b(?:19|20)\d{{2}}\b') AS year, regexp_extract(text, '\b\d+\b') AS num FROM (SELECT *, row_number() OVER (ORDER BY {_draw_sql("case")}, id) AS k FROM c WHERE label) WHERE k <= (SELECT n FROM n)),
v AS (SELECT *, try_cast(num AS BIGINT) + {_step_sql(C.NUMBER_STEPS, "number")} AS other FROM p)
SELECT id, label, NULL AS kind, md5(text) AS digest FROM c UNION ALL SELECT -id - 1, false, CASE WHEN way < 40 THEN CASE WHEN {_any_sql(C.NEGATIONS, "lower(text)")} THEN 'negation' ELSE 'synthetic' END WHEN way < 82 THEN CASE WHEN year <> '' THEN 'date_error' WHEN other >= 0 THEN 'numeric_error' ELSE 'synthetic' END WHEN {_any_sql(C.SWAPS, "text")} THEN 'entity_swap' ELSE 'synthetic' END,
    md5(CASE WHEN way < 40 THEN {_changes_sql(C.NEGATIONS, "lower(text)")} WHEN way < 82 THEN CASE WHEN year <> '' THEN {_first_sql("year", "(year::BIGINT + " + _step_sql(C.YEAR_STEPS, "year") + ")::VARCHAR")} WHEN other >= 0 THEN {_first_sql("num", "other::VARCHAR")} ELSE text END ELSE {_changes_sql(C.SWAPS, "text")} END) FROM v""")
def fn_synthetic_negative(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statements negated, misdated, miscounted or with names swapped, until 40 % of a claim set are false."""
    cases = table(spark, sf_dir, "documents").selectExpr("doc_id AS id", f"{_CASE} AS text", "doc_id % 5 <> 0 AS label")
    return C.with_false_variants(cases).select("id", "label", "kind", F.md5(F.col("text").cast("binary")).alias("digest"))


_RECORD = {"response": "CASE WHEN doc_id % 4 = 0 THEN concat(' ', lang, ' is spoken') WHEN doc_id % 4 = 3 THEN 'This Cannot Determine it' END", "claim": "CASE doc_id % 4 WHEN 1 THEN concat(source, ' exists') WHEN 2 THEN 'does it?' END", "query": "CASE WHEN doc_id % 2 = 0 THEN 'why' END", "hallucination": "CASE WHEN doc_id % 3 = 0 THEN CASE doc_id % 2 WHEN 0 THEN 'Yes' ELSE 'faithful' END END", "label": "CASE doc_id % 5 WHEN 0 THEN 'false' WHEN 1 THEN 'Factual' WHEN 2 THEN '7' WHEN 3 THEN 'odd' END"}


@plan("""SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN lang || ' is spoken' ELSE source || ' exists' END AS text, CASE WHEN doc_id % 3 = 0 THEN doc_id % 2 <> 0 ELSE doc_id % 5 <> 0 END AS label, CASE WHEN doc_id % 2 = 0 THEN 'Q: why' ELSE '' END AS notes, 'set' AS source FROM documents WHERE doc_id % 4 IN (0, 1)""")
def src_hf_entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records with varying fields as labelled cases; lone questions and non-answers are left out."""
    return C.record_cases(table(spark, sf_dir, "documents").selectExpr("doc_id", *[f"{v} AS {k}" for k, v in _RECORD.items()]), "doc_id", "set")


@plan("SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN 'Bb;[[A' || (doc_id % 7 + 10) || ';z]];{{d|e' WHEN 1 THEN 'Aa;Bc' WHEN 2 THEN 'One;two' WHEN 3 THEN 'one;two' WHEN 4 THEN '' ELSE 'a1;b2;c3' END AS items FROM documents")
def fn_list_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items of list templates, of links, of parts at separators, and of none. As upstream, a bar within a link parts it."""
    v = table(spark, sf_dir, "documents").selectExpr("doc_id", "CASE doc_id % 6 WHEN 0 THEN concat('{{hlist|[[A', CAST(doc_id % 7 + 10 AS STRING), '|z]]|Bb|x|{{d|e}}|f}}') WHEN 1 THEN '[[Bc|d]], [[Aa]] and more' WHEN 2 THEN 'two, One' WHEN 3 THEN 'one and two' WHEN 4 THEN 'single' ELSE concat('{{Plainlist|', chr(10), '* c3', chr(10), '* a1', chr(10), '* b2}}') END AS v")
    return v.select("doc_id", F.array_join(W.list_items(F.col("v")), ";").alias("items"))


_BEST = """n AS (SELECT count(*) AS n FROM embeddings), e AS (SELECT vec_id, embedding::DOUBLE[] AS v, sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS norm FROM embeddings),
b AS (SELECT q.vec_id, max(list_dot_product(q.v, c.v) / (q.norm * c.norm)) AS best FROM e q JOIN e c ON q.vec_id <> c.vec_id WHERE q.vec_id IN (SELECT vec FROM f) GROUP BY 1)"""


@plan(rf"""WITH s AS (SELECT item_id, list_filter(list_transform({sentences_sql("text")}, lambda s: trim(s)), lambda s: length(s) >= 11) AS s FROM benchmark), f AS (SELECT item_id, (i - 1)::INT AS ord, s[i] AS fact, (item_id * 7 + i - 1) % (SELECT count(*) FROM embeddings) AS vec FROM (SELECT item_id, s, unnest(range(1, length(s) + 1)) AS i FROM s)), {_BEST}
SELECT item_id, ord, md5(fact) AS fact, best >= 0.7::DOUBLE AS by_vectors, best >= 0.49::DOUBLE AS by_graph FROM f JOIN b ON vec = vec_id""")
def fn_factscore_decompose(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences as facts, each with its own verdict: vectors count support only, graphs partial support too."""
    q, c = _vectors(spark, sf_dir)
    e = table(spark, sf_dir, "embeddings")
    n = e.count()
    facts = table(spark, sf_dir, "benchmark").select("item_id", F.posexplode(T.fallback_sentences(F.col("text"), 11)).alias("ord", "fact")).withColumn("vec", (F.col("item_id") * 7 + F.col("ord")) % n)
    asked = e.join(facts.select(F.col("vec").alias("vec_id")).distinct(), "vec_id").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("qvec"))
    best = S.knn(asked, c, 1).select(F.col("qid").alias("vec"), "score")
    return facts.join(best, "vec").select("item_id", "ord", F.md5(F.col("fact").cast("binary")).alias("fact"), (F.col("score") >= 0.7).alias("by_vectors"), (F.col("score") >= 0.49).alias("by_graph"))


@plan("""WITH q AS (SELECT vec_id AS qid, embedding::DOUBLE[] AS qv FROM embeddings WHERE vec_id % 20 = 0), s AS (SELECT qid, vec_id AS vid, list_dot_product(qv, embedding::DOUBLE[]) / (sqrt(list_dot_product(qv, qv)) * sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]))) AS score FROM q JOIN embeddings ON qid <> vec_id),
t AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, vid) AS rank FROM s) SELECT qid, vid, round(score, 6) AS similarity, 0.72::DOUBLE AS credibility, substring(text, 1, 280) AS snippet FROM t JOIN documents ON doc_id = vid WHERE rank <= 3 AND text <> ''""")
def vec_worker(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three nearest texts as evidence with a fixed credibility; empty texts are left out after the search."""
    near = S.knn(*_vectors(spark, sf_dir), 3)
    d = table(spark, sf_dir, "documents").where("text <> ''").select(F.col("doc_id").alias("vid"), F.substring("text", 1, 280).alias("snippet"))
    return near.join(d, "vid").select("qid", "vid", F.round("score", 6).alias("similarity"), F.lit(0.72).alias("credibility"), "snippet")


@plan()
def chunk_article(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of 512 characters of whole articles, each with its section (fn_section_of_pos, win_chunk_overlap)."""
    c = articles(spark, sf_dir).select("doc_id", "source", F.posexplode(chunking.article_column(F.col("wiki"), O.clean_wikitext(F.col("wiki")))).alias("chunk_index", "c"))
    shown = F.concat(F.col("source"), F.lit(" - "), F.col("c.section"), F.lit(": "), F.col("c.text"))
    return c.select("doc_id", "chunk_index", F.col("c.start").alias("start"), F.col("c.end").alias("end"), F.col("c.section").alias("section"), F.md5(shown.cast("binary")).alias("digest"))


_EDGES = "(a * 7 + b * 3) % 5"


@plan(f"""WITH d AS (SELECT doc, doc * 3 AS x, doc * 3 + 1 AS y, doc * 3 + 2 AS z FROM (SELECT doc_id // 3 AS doc FROM documents GROUP BY 1 HAVING count(*) = 3)), w AS (SELECT *, {_EDGES.replace("a", "x").replace("b", "y")} AS xy, {_EDGES.replace("a", "x").replace("b", "z")} AS xz, {_EDGES.replace("a", "y").replace("b", "z")} AS yz FROM d)
SELECT doc, x AS a, CASE WHEN xy >= xz THEN y ELSE z END AS b, 0::BIGINT AS step FROM w UNION ALL SELECT doc, CASE WHEN yz > least(xy, xz) THEN y ELSE x END, CASE WHEN yz > least(xy, xz) OR xy >= xz THEN z ELSE y END, 1 FROM w""")
def topk_mst(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strongest spanning trees of triangles of claims (gr_factor_graph's edge cover begins with one)."""
    d = table(spark, sf_dir, "documents").groupBy(F.expr("doc_id div 3").alias("doc")).agg(F.count("*").alias("n")).where("n = 3")
    ends = F.explode(F.array(*[F.struct((F.col("doc") * 3 + i).alias("a"), (F.col("doc") * 3 + j).alias("b")) for i, j in ((0, 1), (1, 2), (0, 2))]))
    return I.spanning_trees(d.select("doc", ends.alias("e")).select("doc", "e.a", "e.b").withColumn("strength", F.expr(f"{_EDGES}")))
