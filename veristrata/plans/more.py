"""Further queries: filters, sets, sinks as tables, small mappings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T
from ..operators import chunking, search
from ..operators import corpus as C
from ..operators import terms as S
from ..session import dealt, materialize, numbered, table
from .corpus import COUNTS, HASH, TF
from .registry import plan
from .verify import PAIRS, claims, labelled, squeeze_sql, tokens_sql


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


@plan("""SELECT doc_id, n_chars FROM documents WHERE n_chars >= 500 AND coalesce(doc_id % 7 = 0, false) = false AND contains(lower(text), 'the') ORDER BY n_chars DESC, doc_id LIMIT 50""")
def filt_quality_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality floor, missing flags count as false, substring, best first; the limit is the operator's own."""
    d = docs(spark, sf_dir).where((F.col("n_chars") >= 500) & ~F.coalesce(F.col("doc_id") % 7 == 0, F.lit(False)) & F.lower("text").contains("the"))
    return d.orderBy(F.desc("n_chars"), "doc_id").limit(50).select("doc_id", "n_chars")


#: The table of listed terms: long words of the claims. A text's words are runs of letters, digits and underscores.
_TERMS = r"""terms AS (SELECT list(DISTINCT t) AS terms FROM (SELECT unnest(regexp_split_to_array(lower(text), '[^a-z]+')) AS t FROM benchmark) WHERE length(t) >= 8),
b AS (SELECT doc_id, text, len(list_intersect(regexp_split_to_array(lower(coalesce(text, '')), '[^a-z0-9_\x{80}-\x{10FFFF}]+'), terms)) > 0 AS bad FROM documents, terms)"""


def _terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = F.explode(F.split(F.lower("text"), "[^a-z]+"))
    return table(spark, sf_dir, "benchmark").select(words.alias("term")).where("length(term) >= 8")


@plan(f"WITH {_TERMS} SELECT doc_id FROM b WHERE NOT bad")
def filt_blacklist(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts without a listed term, whole words in any case; hundreds of terms come from a table."""
    return S.first_term(dealt(docs(spark, sf_dir)), "text", _terms(spark, sf_dir)).where("term IS NULL").select("doc_id")


_HARM = """CASE doc_id % 7 WHEN 0 THEN '{"harmful": true, "category": "x"}' WHEN 1 THEN 'no json {' WHEN 2 THEN concat('```json', chr(10), '{"harmful": false}', chr(10), '```') ELSE '{}' END"""
_CLAIM = """CASE doc_id % 5 WHEN 0 THEN '{"action": "reject_no_claim"}' WHEN 1 THEN concat('```', chr(10), '{"action": "EXTRACT_CLAIM", "claim": " Claim ', doc_id, ' "}') WHEN 2 THEN '{"action": "EXTRACT_CLAIM", "claim": " "}' WHEN 3 THEN '{"action": "PASS_THROUGH"}' ELSE '' END"""


@plan(f"""WITH {_TERMS}, d AS (SELECT *, CASE WHEN bad THEN 'blacklist' WHEN doc_id % 7 = 0 THEN 'harm' WHEN doc_id % 5 IN (0, 2) THEN 'claim' END AS stopped FROM b)
SELECT doc_id, CASE WHEN stopped IS NOT NULL THEN 'reject' WHEN doc_id % 5 = 1 THEN 'rewrite' ELSE 'allow' END AS action, CASE WHEN stopped IS NOT NULL THEN stopped WHEN doc_id % 5 = 1 THEN 'claim' END AS stage,
    (CASE stopped WHEN 'claim' THEN 422 WHEN 'harm' THEN 403 WHEN 'blacklist' THEN 403 ELSE 200 END)::INT AS status, md5(CASE WHEN stopped IS NULL AND doc_id % 5 = 1 THEN 'Claim ' || doc_id ELSE coalesce(text, '') END) AS digest FROM d""")
def filt_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listed terms, the model's word on harm, its word on claims, in order, with the step that decided."""
    d = dealt(docs(spark, sf_dir)).selectExpr("doc_id", "text", f"{_HARM} AS harm", f"{_CLAIM} AS claim")
    d = S.first_term(d, "text", _terms(spark, sf_dir))
    out = S.run_chain(d, "text", [S.blacklist_step(), S.harm_step(F.col("harm")), S.claim_step(F.col("claim"))])
    return out.select("doc_id", "action", "stage", F.coalesce("status", F.lit(200)).alias("status"), F.md5(F.coalesce("final_text", F.lit("")).cast("binary")).alias("digest"))


@plan(f"WITH {PAIRS} SELECT item_id, ord::INT AS ord, doc_id FROM labels WHERE relevance >= 0.4::DOUBLE AND ((nli_label = 'support' AND supporting >= 0.35::DOUBLE) OR (nli_label = 'refute' AND refuting >= 0.35::DOUBLE))")
def filt_relevance_floor(spark: SparkSession, sf_dir: str) -> DataFrame:
    keep = (F.col("relevance") >= 0.4) & (((F.col("nli_label") == "support") & (F.col("supporting") >= 0.35)) | ((F.col("nli_label") == "refute") & (F.col("refuting") >= 0.35)))
    return labelled(spark, sf_dir).where(keep).select("item_id", "ord", "doc_id")


@plan("SELECT doc_id, CASE WHEN length(trim(text)) = 0 THEN 'empty' WHEN length(text) > 5000 THEN 'too long' WHEN doc_id % 20 > 15 THEN 'max_claims' END AS error FROM documents")
def filt_request(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.when(F.length(F.trim("text")) == 0, "empty").when(F.length("text") > 5000, "too long").when(F.col("doc_id") % 20 > 15, "max_claims")
    return docs(spark, sf_dir).select("doc_id", e.alias("error"))


@plan("SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN text ELSE '' END AS text FROM documents")
def filt_retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).select("doc_id", F.when(F.col("doc_id") % 2 == 0, F.col("text")).otherwise("").alias("text"))


@plan("SELECT doc_id, upper(CASE WHEN starts_with(upper(k), 'Q') THEN k ELSE 'Q' || k END) AS qid FROM (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'q' ELSE '' END || doc_id AS k FROM documents)")
def filt_by_qid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids brought to the form Q123."""
    k = F.concat(F.when(F.col("doc_id") % 3 == 0, "q").otherwise(""), F.col("doc_id").cast("string"))
    return docs(spark, sf_dir).select("doc_id", F.upper(F.when(F.upper(k).startswith("Q"), k).otherwise(F.concat(F.lit("Q"), k))).alias("qid"))


@plan(f"WITH {PAIRS} SELECT item_id, ord::INT AS ord, string_agg(CASE WHEN nli_label = 'support' THEN doc_id::VARCHAR END, ',' ORDER BY doc_id) AS supporting, string_agg(CASE WHEN nli_label = 'refute' THEN doc_id::VARCHAR END, ',' ORDER BY doc_id) AS refuting, round(coalesce(avg(ratio), 0.5::DOUBLE), 6) AS similarity FROM claims LEFT JOIN labels USING (item_id, ord) GROUP BY ALL")
def agg_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence lists by label, and the mean similarity (agg_similarity_mean, agg_verdict_row)."""
    ids = lambda label: F.nullif(F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col("nli_label") == label, F.col("doc_id")))), lambda x: x.cast("string")), ","), F.lit(""))
    rows = claims(spark, sf_dir).select("item_id", "ord").join(labelled(spark, sf_dir), ["item_id", "ord"], "left")
    return rows.groupBy("item_id", "ord").agg(ids("support").alias("supporting"), ids("refute").alias("refuting"), F.round(F.coalesce(F.avg("ratio"), F.lit(0.5)), 6).alias("similarity"))


@plan("""WITH l AS (SELECT user_id AS claim, event_type AS label, count(DISTINCT event_id % 7) AS labelers FROM events GROUP BY ALL) SELECT claim, count(*) FILTER (labelers >= 3) AS concordant, CASE WHEN count(*) FILTER (labelers >= 3) > 1 THEN 'dispute' WHEN count(*) FILTER (labelers >= 3) = 1 THEN 'promoted' ELSE 'open' END AS state FROM l GROUP BY claim""")
def agg_consensus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three concordant labelers promote a claim; more than one such label is a dispute."""
    l = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("claim"), F.col("event_type").alias("label")).agg(F.count_distinct(F.col("event_id") % 7).alias("labelers"))  # noqa: E741
    c = l.groupBy("claim").agg(F.count_if(F.col("labelers") >= 3).alias("concordant"))
    return c.withColumn("state", F.when(F.col("concordant") > 1, "dispute").when(F.col("concordant") == 1, "promoted").otherwise("open"))


@plan("SELECT l_orderkey AS item, string_agg(DISTINCT p_brand, ',' ORDER BY p_brand) AS brands FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1")
def agg_category_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey").join(table(spark, sf_dir, "part").select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
    return j.groupBy(F.col("l_orderkey").alias("item")).agg(F.array_join(F.sort_array(F.collect_set("p_brand")), ",").alias("brands"))


@plan("""WITH g AS (SELECT count(*) AS stored FROM documents), v AS (SELECT count(*) AS vectors FROM embeddings), l AS (SELECT count(*) AS golden, count(*) FILTER (d.doc_id IS NOT NULL) AS resolved FROM labels LEFT JOIN (SELECT DISTINCT doc_id FROM documents) d USING (doc_id))
SELECT stored, vectors, golden, resolved, round(abs(stored - vectors) / greatest(stored, 1), 6) AS mismatch, round(resolved / greatest(golden, 1), 6) AS resolution, abs(stored - vectors) / greatest(stored, 1) <= 0.01::DOUBLE AND resolved / greatest(golden, 1) >= 0.8::DOUBLE AS fine FROM g, v, l""")
def agg_integrity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether two stores hold as many passages, and enough of the golden set is resolved: counts, ratios, the gate."""
    known = docs(spark, sf_dir).select("doc_id").distinct().withColumn("hit", F.lit(1))
    golden = table(spark, sf_dir, "labels").select("doc_id").join(known, "doc_id", "left").agg(F.count("*").alias("golden"), F.count("hit").alias("resolved"))
    stores = docs(spark, sf_dir).agg(F.count("*").alias("stored")).join(table(spark, sf_dir, "embeddings").agg(F.count("*").alias("vectors")))  # a row each
    j = stores.join(golden)
    mismatch, resolution = F.abs(F.col("stored") - F.col("vectors")) / F.greatest("stored", F.lit(1)), F.col("resolved") / F.greatest("golden", F.lit(1))
    return j.select("stored", "vectors", "golden", "resolved", F.round(mismatch, 6).alias("mismatch"), F.round(resolution, 6).alias("resolution"), ((mismatch <= 0.01) & (resolution >= 0.8)).alias("fine"))


@plan("""WITH c AS (SELECT conv_id, sum(length(regexp_extract_all(text, '[.!?]+'))) AS facts, count(*) AS n, avg(length(text)) AS mean, stddev_pop(length(text)) AS std FROM conversations WHERE role = 'assistant' GROUP BY 1) SELECT conv_id, facts::BIGINT AS facts, n AS texts, round(facts / n, 6) AS per_text, round(std, 6) AS std, round(CASE WHEN facts < 10 THEN mean * facts / 10 ELSE mean END, 6) AS penalized FROM c""")
def agg_factscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts per text, spread, and the penalty for few facts (agg_factscore_penalty)."""
    c = table(spark, sf_dir, "conversations").where("role = 'assistant'").groupBy("conv_id").agg(F.sum(F.size(F.regexp_extract_all("text", F.lit("[.!?]+"), F.lit(0))).cast("long")).alias("facts"), F.count("*").alias("texts"), F.avg(F.length("text")).alias("mean"), F.stddev_pop(F.length("text")).alias("std"))
    return c.select("conv_id", "facts", "texts", F.round(F.col("facts") / F.col("texts"), 6).alias("per_text"), F.round("std", 6).alias("std"), F.round(F.when(F.col("facts") < 10, F.col("mean") * F.col("facts") / 10).otherwise(F.col("mean")), 6).alias("penalized"))


@plan(rf"""SELECT conv_id, turn, array_to_string(list_slice(list_filter(regexp_split_to_array(regexp_replace(lower(text), '[^a-z0-9 \t\n\r]', ' ', 'g'), '[ \t\n\r]+'), lambda w: length(w) > 2 AND w NOT IN ('the', 'and', 'was', 'were', 'for', 'with')), 1, 6), ' ') AS query,
    CASE WHEN regexp_matches(text, '[äöüÄÖÜß]') OR regexp_matches(' ' || lower(text) || ' ', ' (der|die|das|und|ist) ') THEN 'de,en' ELSE 'en' END AS languages, {squeeze_sql("text")} = text AS tidy FROM conversations""")
def fn_compact_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First six telling words, and the language guess (fn_lang_guess)."""
    w = F.filter(F.split(F.regexp_replace(F.lower("text"), "[^a-z0-9 \t\n\r]", " "), T.SPACES), lambda x: (F.length(x) > 2) & ~x.isin("the", "and", "was", "were", "for", "with"))
    german = F.col("text").rlike("[äöüÄÖÜß]") | F.concat(F.lit(" "), F.lower("text"), F.lit(" ")).rlike(" (der|die|das|und|ist) ")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.array_join(F.slice(w, 1, 6), " ").alias("query"), F.when(german, "de,en").otherwise("en").alias("languages"), (T.squeeze(F.col("text")) == F.col("text")).alias("tidy"))


@plan("SELECT doc_id, substring(sha256(concat_ws('::', 'Q' || doc_id, lang, (doc_id % 5)::VARCHAR, (doc_id % 3)::VARCHAR)), 1, 40) AS passage_id, concat_ws(chr(10), 'Article: ' || source, CASE WHEN lang <> 'en' THEN 'Section: ' || lang END, text) AS embed_text FROM documents")
def fn_passage_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deterministic passage ids and the text that is embedded (fn_embed_text)."""
    qid = F.concat(F.lit("Q"), F.col("doc_id").cast("string"))
    embed = F.concat_ws("\n", F.concat(F.lit("Article: "), F.col("source")), F.when(F.col("lang") != "en", F.concat(F.lit("Section: "), F.col("lang"))), F.col("text"))
    return docs(spark, sf_dir).select("doc_id", T.passage_id(qid, F.col("lang"), F.col("doc_id") % 5, F.col("doc_id") % 3).alias("passage_id"), embed.alias("embed_text"))


@plan("""SELECT doc_id, CASE WHEN s >= 0.7::DOUBLE THEN 'SUPPORTED' WHEN s >= 0.4::DOUBLE THEN 'PARTIAL' WHEN s >= 0.2::DOUBLE THEN 'UNVERIFIABLE' ELSE 'REFUTED' END AS verdict, round(greatest(0.65::DOUBLE, 0.9::DOUBLE - 0.08::DOUBLE * (rank - 1)), 6) AS similarity FROM (SELECT doc_id, (n_chars % 100) / 100.0::DOUBLE AS s, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS rank FROM documents)""")
def fn_verdict_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts by thresholds and similarity by rank (fn_rank_similarity)."""
    s, rank = (F.col("n_chars") % 100) / 100, F.row_number().over(Window.partitionBy("source").orderBy(F.desc("n_chars"), "doc_id"))
    v = F.when(s >= 0.7, "SUPPORTED").when(s >= 0.4, "PARTIAL").when(s >= 0.2, "UNVERIFIABLE").otherwise("REFUTED")
    return docs(spark, sf_dir).select("doc_id", v.alias("verdict"), F.round(F.greatest(F.lit(0.65), 0.9 - 0.08 * (rank - 1)), 6).alias("similarity"))


@plan("""SELECT 'benchmark' AS origin, item_id AS old_id, item_id AS new_id FROM benchmark UNION ALL SELECT 'conversation', conv_id, (SELECT max(item_id) FROM benchmark) + row_number() OVER (ORDER BY conv_id) FROM (SELECT DISTINCT conv_id FROM conversations)""")
def set_union_datasets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two sets in one, the second renumbered after the first's last id, by offsets of range-sorted parts."""
    b = table(spark, sf_dir, "benchmark")
    top = b.agg(F.max("item_id")).first()[0] or 0
    c = numbered(table(spark, sf_dir, "conversations").select("conv_id").distinct(), "conv_id").withColumn("k", F.col("place") + 1)
    first = b.select(F.lit("benchmark").alias("origin"), F.col("item_id").alias("old_id"), F.col("item_id").alias("new_id"))
    return first.union(c.select(F.lit("conversation"), "conv_id", F.col("k") + top))


@plan("""SELECT sha256(lower(trim(text))) AS hash, min(doc_id) AS first_id, max(doc_id) AS last_id, count(*) - 1 AS accesses FROM documents GROUP BY 1""")
def sink_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence by content hash: first and last sight, further accesses counted."""
    d = docs(spark, sf_dir).select(F.sha2(F.lower(F.trim("text")).cast("binary"), 256).alias("hash"), "doc_id")
    return d.groupBy("hash").agg(F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id"), (F.count("*") - 1).alias("accesses"))


@plan("""WITH u AS (SELECT page_id, coalesce(CASE WHEN page_id % 10 <> 0 THEN regexp_replace(split_part(split_part(url, '?', 1), '//', 2), '^(www|m)\\.', '') END, substring(html, 1, 160)) AS uri FROM pages) SELECT min(page_id) AS page_id, uri, count(*) AS copies FROM u GROUP BY uri""")
def win_dedupe_uri(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first page of each address; pages without one are told apart by their first 160 characters, as upstream does."""
    u = F.regexp_replace(F.split_part(F.split_part("url", F.lit("?"), F.lit(1)), F.lit("//"), F.lit(2)), r"^(www|m)\.", "")
    key = F.coalesce(F.when(F.col("page_id") % 10 != 0, u), F.substring("html", 1, 160))
    return table(spark, sf_dir, "pages").select("page_id", key.alias("uri")).groupBy("uri").agg(F.min("page_id").alias("page_id"), F.count("*").alias("copies"))


@plan(f"""WITH {COUNTS}, v AS (SELECT doc_id, {HASH} AS idx, sum({TF}) AS value FROM counts GROUP BY ALL), s AS (SELECT q.doc_id AS qid, c.doc_id AS vid, sum(q.value * c.value) AS score FROM v q JOIN v c ON q.idx = c.idx AND q.doc_id <> c.doc_id WHERE q.doc_id % 20 = 0 GROUP BY ALL)
SELECT qid, vid, round(score, 4) AS score FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 8) DESC, vid) AS k FROM s) WHERE k <= 5""")
def vec_sparse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sparse dot products for every document whose id is divisible by 20, against all."""
    v = materialize(C.hashed_vectors(dealt(docs(spark, sf_dir).select("doc_id", "text")), "doc_id"), "sparse-vectors")
    top = search.sparse_best(v.where("doc_id % 20 = 0").withColumnRenamed("doc_id", "qid"), v.withColumnRenamed("doc_id", "vid"), 5)
    return top.select("qid", "vid", F.round("score", 4).alias("score"))


@plan(f"""WITH t AS (SELECT item_id, unnest(list_distinct({tokens_sql("text")})) AS term FROM benchmark), m AS (SELECT item_id, doc_id, count(*) AS matched FROM t JOIN documents ON contains(lower(text), term) GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY matched DESC, doc_id) AS rank FROM m),
u AS (SELECT a.doc_id, b.doc_id AS other FROM documents a JOIN documents b ON b.doc_id <> a.doc_id AND b.doc_id BETWEEN a.doc_id - 4 AND a.doc_id + 4), n AS (SELECT doc_id, array_to_string(list_sort(list_distinct(list(other)))[1:6], ',') AS neighbours FROM u GROUP BY 1)
SELECT item_id, doc_id, matched, rank::INT AS rank, coalesce(neighbours, '') AS neighbours FROM r LEFT JOIN n USING (doc_id) WHERE rank <= 10""")
def gr_keyword_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes whose text contains a claim's terms, the ten with most of them, each with its first six neighbours (fn_graph_coverage)."""
    asked = table(spark, sf_dir, "benchmark").select("item_id", F.explode(F.array_distinct(T.significant_tokens(F.col("text")))).alias("term"))
    d = docs(spark, sf_dir)
    edges = d.select(F.col("doc_id").alias("src"), F.explode(F.transform(F.sequence(F.lit(1), F.lit(4)), lambda k: F.col("doc_id") + k)).alias("dst"))
    edges = edges.join(d.select(F.col("doc_id").alias("dst")), "dst", "left_semi")
    found = S.nodes_with_terms(asked, "item_id", dealt(d.select("doc_id", "text")), "doc_id", "text", 10)
    return S.with_neighbours(found, "doc_id", edges, 6).select("item_id", "doc_id", "matched", "rank", F.array_join(F.transform("neighbours", lambda x: x.cast("string")), ",").alias("neighbours"))


@plan("""WITH k AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS k FROM events), c AS (SELECT event_type, count(*) AS total, round(count(*) / greatest((epoch_us(max(ts)) - epoch_us(min(ts))) / 6e7::DOUBLE, 1), 6) AS per_minute FROM events GROUP BY 1)
SELECT event_id, event_type, total, per_minute FROM k JOIN c USING (event_type) WHERE k <= 500""")
def st_live_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each kind's last 500 entries, as a ring buffer keeps them, with its counter and its rate a minute."""
    e = table(spark, sf_dir, "events")
    at = F.unix_micros(F.to_timestamp("ts"))
    counters = e.groupBy("event_type").agg(F.count("*").alias("total"), F.round(F.count("*") / F.greatest((F.max(at) - F.min(at)) / 6e7, F.lit(1.0)), 6).alias("per_minute"))
    k = F.row_number().over(Window.partitionBy("event_type").orderBy(F.desc("ts"), F.desc("event_id")))
    return e.withColumn("k", k).where("k <= 500").join(F.broadcast(counters), "event_type").select("event_id", "event_type", "total", "per_minute")


@plan("SELECT i AS id, CASE WHEN i % 2 = 0 THEN 'true' ELSE 'false' END AS label FROM range(10) t(i)")
def src_synthetic_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.range(10).select("id", F.when(F.col("id") % 2 == 0, "true").otherwise("false").alias("label"))


@plan()
def chunk_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentence-aware chunks with overlap of every whole text."""
    c = docs(spark, sf_dir).select("doc_id", F.posexplode(chunking.chunk_column(F.col("text"), chunking.passages)).alias("chunk_index", "c"))
    return c.select("doc_id", "chunk_index", F.col("c.start").alias("start"), F.length("c.text").alias("n_chars"), F.md5(F.col("c.text").cast("binary")).alias("digest"))


#: Ends of sentences by document; each step goes on to the next end that lies beyond the open slice.
_SLICES = r"""p AS (SELECT doc_id, string_split(regexp_replace(coalesce(text, ''), '([.!?])([ \t\n\r\f\v]+)', '\1' || chr(31) || '\2', 'g'), chr(31)) AS p FROM documents), q AS (SELECT doc_id, generate_subscripts(p, 1) AS i, unnest(p) AS piece FROM p),
z AS (SELECT doc_id, i, sum(length(piece)) OVER (PARTITION BY doc_id ORDER BY i)::BIGINT AS e FROM q), y AS (SELECT *, min(e) OVER (PARTITION BY doc_id ORDER BY e RANGE BETWEEN 400 PRECEDING AND CURRENT ROW) AS back FROM z),
x AS (SELECT doc_id, i, e, coalesce(lag(e) OVER w, 0) AS last, coalesce(lag(back) OVER w, 0) AS back FROM y WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
r AS (SELECT doc_id, 0::BIGINT AS i, 0::BIGINT AS start, 0::BIGINT AS e, []::STRUCT(a BIGINT, b BIGINT)[] AS made FROM documents
    UNION ALL SELECT doc_id, i, s + n * 4000, e, list_concat(CASE WHEN cut THEN [{'a': start, 'b': last}] ELSE [] END, list_transform(range(0, n), lambda j: {'a': s + j * 4000, 'b': s + (j + 1) * 4000}))
    FROM (SELECT *, greatest(0, (e - s + 3999) // 4000 - 1) AS n FROM (SELECT *, CASE WHEN NOT cut THEN start WHEN back > start THEN back ELSE last END AS s FROM (SELECT doc_id, start, v.i AS i, v.e AS e, v.last AS last, v.back AS back, v.last > start AS cut FROM (SELECT r.doc_id, r.start, arg_min({'i': x.i, 'e': x.e, 'last': x.last, 'back': x.back}, x.i) AS v FROM r JOIN x ON x.doc_id = r.doc_id AND x.i > r.i AND x.e - r.start > 4000 GROUP BY r.doc_id, r.start))))),
f AS (SELECT r.doc_id, 1000000000 AS i, start AS a, length(text)::BIGINT AS b FROM r JOIN (SELECT doc_id, max(i) AS i FROM r GROUP BY 1) USING (doc_id, i) JOIN documents USING (doc_id) WHERE regexp_matches(substring(text, start + 1), '[^ \t\n\r\f\v]')),
o AS (SELECT doc_id, i, m.a AS a, m.b AS b FROM (SELECT doc_id, i, unnest(made) AS m FROM r) UNION ALL SELECT * FROM f)"""


@plan(f"WITH RECURSIVE {_SLICES} SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY i, a) - 1)::INT AS chunk_index, a::INT AS start, (b - a)::INT AS n_chars FROM o")
def chunk_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slices of whole texts for claim extraction, offsets kept."""
    c = docs(spark, sf_dir).select("doc_id", F.posexplode(chunking.chunk_column(F.col("text"), chunking.claim_chunks)).alias("chunk_index", "c"))
    return c.select("doc_id", "chunk_index", F.col("c.start").alias("start"), F.length("c.text").alias("n_chars"))
