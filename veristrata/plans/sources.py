"""Queries over the readers. Each writes a dump of a whole table in the source's format and reads it with the reader."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import corpus as C
from ..session import shared_path, table
from ..sources import dumps as D
from .registry import plan
from .verify import tokens_sql


def _lines(rows: DataFrame, name: str, *around: str) -> str:
    """Write the only column as lines; ``around``: lines of their own, in a file beside."""
    path = shared_path(rows.sparkSession, name)
    rows.write.text(path)
    if around:
        rows.sparkSession.createDataFrame([(x,) for x in around], "value string").coalesce(1).write.mode("append").text(path)
    return path


def _wikidata(spark: SparkSession, sf_dir: str) -> DataFrame:
    value = lambda x: F.struct(F.struct(F.lit("value").alias("snaktype"), F.struct(x.alias("value")).alias("datavalue")).alias("mainsnak"))
    text = lambda c: F.struct(F.struct(c.alias("value")).alias("en"))
    c = table(spark, sf_dir, "customer")
    entity = F.struct(
        F.concat(F.lit("Q"), F.col("c_custkey").cast("string")).alias("id"),
        text(F.col("c_name")).alias("labels"),
        text(F.when(F.col("c_custkey") % 2 == 0, F.lit('a "quoted", customer'))).alias("descriptions"),
        F.struct(F.struct(F.concat(F.lit("T "), F.col("c_name")).alias("title")).alias("enwiki")).alias("sitelinks"),
        F.struct(F.array(value(F.struct(F.concat(F.lit("Q"), F.col("c_nationkey").cast("string")).alias("id")))).alias("P17"), F.array(F.struct(F.struct(F.lit("novalue").alias("snaktype")).alias("mainsnak"))).alias("P31")).alias("claims"),
    )
    return D.wikidata(spark, _lines(c.select(F.concat(F.to_json(entity), F.lit(",")).alias("value")), "wikidata", "[", "]", "{broken"))


@plan("SELECT 'Q' || c_custkey AS qid, c_name AS label, coalesce(CASE WHEN c_custkey % 2 = 0 THEN 'a \"quoted\", customer' END, '-') AS description, 'T ' || c_name AS wikipedia_title FROM customer")
def src_wikidata_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _wikidata(spark, sf_dir).select("qid", "label", F.coalesce("description", F.lit("-")).alias("description"), "wikipedia_title")


@plan("SELECT 'Q' || c_custkey AS src, 'Q' || c_nationkey AS dst, 'COUNTRY' AS type FROM customer")
def gr_property_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Item-valued statements of known properties; a statement without a value has no edge."""
    return D.property_edges(_wikidata(spark, sf_dir), {"P17": "COUNTRY", "P31": "INSTANCE_OF"})


_COMPACT = "SELECT 'Q' || c_custkey AS qid, 'P17' AS property, 'Q' || c_nationkey AS value FROM customer"


@plan(_COMPACT)
def proj_compact_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At most three values of each of forty properties, a hundred in all."""
    return D.compact_claims(_wikidata(spark, sf_dir))


@plan("SELECT o_orderkey AS page_id, 'Order ' || o_orderkey AS title, md5('text & <b> of ' || o_orderkey || ' ' || repeat('x', 90 + o_orderkey::INT % 20)) AS digest, o_orderkey % 9 = 0 AS is_redirect FROM orders WHERE o_orderkey % 4 <> 1")
def src_enwiki_xml(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of the main namespace of an XML dump (filt_main_namespace)."""
    return _enwiki(spark, sf_dir).select("page_id", "title", F.md5(F.col("text").cast("binary")).alias("digest"), "is_redirect")


def _enwiki(spark: SparkSession, sf_dir: str) -> DataFrame:
    page = """concat('<page><title>Order ', o_orderkey, '</title><ns>', CASE WHEN o_orderkey % 4 = 1 THEN 10 ELSE 0 END, '</ns><id>', o_orderkey, '</id>', CASE WHEN o_orderkey % 9 = 0 THEN '<redirect title="X"/>' ELSE '' END,
        '<revision><text>text &amp; &lt;b&gt; of ', o_orderkey, ' ', repeat('x', cast(90 + o_orderkey % 20 AS int)), '</text></revision></page>') AS value"""
    path = shared_path(spark, "enwiki")
    pages = table(spark, sf_dir, "orders").selectExpr("o_orderkey % 16 AS file", page)
    dump = pages.groupBy("file").agg(F.concat(F.lit("<mediawiki>\n"), F.concat_ws("\n", F.collect_list("value")), F.lit("\n</mediawiki>")).alias("value"))
    dump.write.partitionBy("file").text(path)  # a root element per file
    return D.enwiki(spark, path)


@plan("SELECT o_orderkey AS page_id, 'https://en.wikipedia.org/wiki/Order_' || o_orderkey AS url FROM orders WHERE o_orderkey % 4 <> 1 AND o_orderkey % 9 <> 0 AND o_orderkey % 5 <> 0 AND length('text & <b> of ' || o_orderkey || ' ' || repeat('x', 90 + o_orderkey::INT % 20)) >= 112")
def src_enwiki_xml_legacy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles with a real text that were not seen yet."""
    seen = table(spark, sf_dir, "orders").where("o_orderkey % 5 = 0").select(F.col("o_orderkey").alias("page_id"))
    return D.articles_only(_enwiki(spark, sf_dir), seen, 112).select("page_id", "url")


def _mysql(spark: SparkSession, sf_dir: str, name: str, row: str) -> DataFrame:
    """Rows of a dump with some hundred tuples a line; the lines of another table stand beside."""
    t = table(spark, sf_dir, "customer").selectExpr("floor(c_custkey / 300) AS g", f"{row} AS t").groupBy("g").agg(F.concat_ws(",", F.collect_list("t")).alias("ts"))
    return D.mysql_tuples(spark, _lines(t.select(F.concat(F.lit(f"INSERT INTO `{name}` VALUES "), "ts", F.lit(";")).alias("value")), name, "-- dump", "INSERT INTO `other` VALUES (1,'x');"), name)


_TITLE = r"""concat('''O\\''Neil_', c_custkey, ', (x)''')"""


@plan("SELECT c_custkey AS page_id, 0 AS namespace, 'O''Neil ' || c_custkey || ', (x)' AS title, c_custkey % 3 AS is_redirect, c_custkey * 2 AS page_length FROM customer")
def src_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quoted commas, brackets and escapes survive (src_mysql_dump, fn_sql_value)."""
    rows = D.typed(_mysql(spark, sf_dir, "page", f"concat('(', c_custkey, ',0,', {_TITLE}, ',', c_custkey % 3, ',0,0.5,''20240101'',NULL,7,', c_custkey * 2, ',''wikitext'',NULL)')"), D.PAGE)
    return rows.withColumn("title", D.plain_title(F.col("title"))).withColumn("is_redirect", F.col("is_redirect").cast("long"))


@plan("SELECT c_custkey AS page_id, 'wikibase_item' AS name, CASE WHEN c_custkey % 2 = 0 THEN 'Q' || c_custkey ELSE '-' END AS value FROM customer")
def src_page_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = D.typed(_mysql(spark, sf_dir, "page_props", "concat('(', c_custkey, ',''wikibase_item'',', CASE WHEN c_custkey % 2 = 0 THEN concat('''Q', c_custkey, '''') ELSE 'NULL' END, ',NULL)')"), D.PAGE_PROPS)
    return rows.fillna("-", ["value"])


@plan("SELECT c_custkey AS page_id, c_custkey % 90 + 0.25::DOUBLE AS lat, c_custkey % 180 - 0.5::DOUBLE AS lon FROM customer")
def src_geo_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.typed(_mysql(spark, sf_dir, "geo_tags", "concat('(1,', c_custkey, ',''earth'',1,', c_custkey % 90, '.25,', cast(c_custkey % 180 - 0.5 AS decimal(9, 1)), ',NULL)')"), D.GEO_TAGS)


@plan("SELECT c_custkey AS page_id, 'Cat_' || c_nationkey AS category FROM customer")
def src_categorylinks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.typed(_mysql(spark, sf_dir, "categorylinks", "concat('(', c_custkey, ',''Cat_', c_nationkey, ''',''S\\\\'' K'',''2020'','''',''x'',''page'')')"), D.CATEGORYLINKS)


@plan("SELECT c_custkey AS page_id, 0 AS namespace, 'To ' || c_nationkey AS title FROM customer")
def src_redirect(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = D.typed(_mysql(spark, sf_dir, "redirect", "concat('(', c_custkey, ',0,''To_', c_nationkey, ''','''','''')')"), D.REDIRECT)
    return r.withColumn("title", D.plain_title(F.col("title")))


@plan("SELECT c_custkey AS category_id, c_name AS title, c_nationkey::BIGINT AS pages, 1::BIGINT AS subcategories, 0::BIGINT AS files FROM customer")
def src_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.typed(_mysql(spark, sf_dir, "category", "concat('(', c_custkey, ',''', c_name, ''',', c_nationkey, ',1,0)')"), D.CATEGORY)


@plan("SELECT c_custkey AS page_id, 0 AS namespace, 'Page ' || c_nationkey AS title FROM customer")
def src_pagelinks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documented old layout: from, namespace, title."""
    r = D.typed(_mysql(spark, sf_dir, "pagelinks", "concat('(', c_custkey, ',0,''Page_', c_nationkey, ''',0)')"), D.REDIRECT)
    return r.withColumn("title", D.plain_title(F.col("title")))


@plan("SELECT item_id::VARCHAR AS id, ['general', 'medical'][1 + item_id % 2] AS domain, item_id % 3 = 0 AS label, md5(trim(text)) AS digest FROM benchmark WHERE trim(text) <> ''")
def src_csv_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled claims of a CSV file with quotes and line ends in its fields."""
    b = table(spark, sf_dir, "benchmark").selectExpr("cast(item_id AS string) AS id", "array('general', 'medical')[item_id % 2] AS domain", "'easy' AS difficulty", "CASE item_id % 3 WHEN 0 THEN 'True' ELSE 'no' END AS label", "text", "'a \"note\"' AS notes", "'' AS hallucination_type")
    path = shared_path(spark, "claims")
    b.union(b.limit(1).withColumn("text", F.lit(" "))).write.option("header", True).option("escape", '"').csv(path)
    return D.csv_claims(spark, path).select("id", "domain", "label", F.md5(F.col("text").cast("binary")).alias("digest"))


@plan("SELECT CASE WHEN item_id % 2 = 0 THEN 'SUPPORTS' ELSE 'REFUTES' END AS label, count(*) AS n, sum(length(text))::BIGINT AS n_chars FROM benchmark GROUP BY 1")
def src_jsonl_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "slice")
    table(spark, sf_dir, "benchmark").select(F.col("text").alias("claim"), F.when(F.col("item_id") % 2 == 0, "SUPPORTS").otherwise("REFUTES").alias("label")).write.json(path)
    return D.jsonl(spark, path, "claim string, label string").groupBy("label").agg(F.count("*").alias("n"), F.sum(F.length("claim")).alias("n_chars"))


@plan("WITH q AS (SELECT o_orderkey AS question, range(1, o_orderkey % 3 + 1) AS r, range(1, o_orderkey % 6 + 1) AS w FROM orders) SELECT question::VARCHAR AS question, 'right ' || unnest(r) AS claim, true AS label FROM q UNION ALL SELECT question::VARCHAR, 'wrong ' || unnest(list_slice(w, 1, 3)), false FROM q")
def src_truthfulqa(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All correct answers and the first three incorrect ones of each question."""
    q = table(spark, sf_dir, "orders").selectExpr("cast(o_orderkey AS string) AS question", "CASE WHEN o_orderkey % 3 = 0 THEN array() ELSE transform(sequence(1, o_orderkey % 3), i -> 'right ' || i) END AS correct", "CASE WHEN o_orderkey % 6 = 0 THEN array() ELSE transform(sequence(1, o_orderkey % 6), i -> 'wrong ' || i) END AS incorrect")
    return D.question_claims(q)


@plan("SELECT conv_id, turn, array_to_string(string_split(text, ' '), ' ') AS abstract FROM conversations")
def fn_inverted_abstract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A text from its words' positions."""
    w = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.posexplode(F.split("text", " ")).alias("p", "w"))
    index = w.groupBy("conv_id", "turn", "w").agg(F.collect_list("p").alias("ps")).groupBy("conv_id", "turn").agg(F.map_from_entries(F.collect_list(F.struct("w", "ps"))).alias("index"))
    return index.select("conv_id", "turn", D.abstract_from_index(F.col("index")).alias("abstract"))


@plan("SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN '' WHEN 1 THEN 'A' WHEN 2 THEN 'A, B' ELSE 'A, B, C' END AS authors, '10.1234/ab.' || o_orderkey || ',10.55555/x' AS dois FROM orders")
def fn_extract_dois(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct DOIs of a text, and the first three authors (fn_authors)."""
    o = table(spark, sf_dir, "orders").selectExpr("o_orderkey", "slice(array('A', 'B', 'C', 'D'), 1, cast(o_orderkey % 5 AS int)) AS a", "concat('see doi:10.1234/ab.', o_orderkey, ' and 10.55555/x, 10.55555/x but 10.1/no') AS t")
    return o.select("o_orderkey", D.authors(F.col("a")).alias("authors"), F.array_join(F.transform(D.dois(F.col("t")), lambda x: F.regexp_replace(x, r"[.,]+$", "")), ",").alias("dois"))


@plan("SELECT o_orderkey AS passage_id, CASE WHEN o_custkey % 25 = n_nationkey THEN '' ELSE 'Q' || n_nationkey END AS mention_qids FROM orders JOIN nation ON n_nationkey = o_orderkey % 25")
def join_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mentioned titles as ids: unknown ones, repeats and the own article are left out; the first row of a title counts."""
    n = table(spark, sf_dir, "nation")
    titles = n.selectExpr("n_name AS title", "concat('Q', n_nationkey) AS qid", "1 AS ord").union(n.selectExpr("n_name", "'Q-later'", "2"))
    name = F.broadcast(n.select(F.col("n_nationkey").alias("k"), "n_name"))
    p = table(spark, sf_dir, "orders").withColumn("k", F.col("o_orderkey") % 25).join(name, "k").select(F.col("o_orderkey").alias("passage_id"), F.concat(F.lit("Q"), (F.col("o_custkey") % 25).cast("string")).alias("qid"), F.array(F.lit("unknown"), "n_name", "n_name").alias("mentions"))
    return C.resolve_mentions(p, titles).select("passage_id", F.array_join("mention_qids", ",").alias("mention_qids"))


@plan(f"SELECT doc_id, length({tokens_sql('text')}) AS n_all, length({tokens_sql('text', 80)}) AS n_first, md5(array_to_string({tokens_sql('text')}, ' ')) AS digest FROM documents")
def fn_significant_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", T.significant_tokens(F.col("text")).alias("all"), T.significant_tokens(F.col("text"), 80).alias("first"))
    return d.select("doc_id", F.size("all").cast("long").alias("n_all"), F.size("first").cast("long").alias("n_first"), F.md5(F.array_join("all", " ").cast("binary")).alias("digest"))


@plan("SELECT event_id, floor(value / 7 * 10000 + 0.5::DOUBLE) / 10000 AS value FROM events")
def fn_round4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", T.round4(F.col("value") / 7).alias("value"))


@plan("SELECT c_custkey AS id, 'T ' || c_name AS wikipedia_title, o.n FROM customer JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) o ON o_custkey = c_custkey")
def join_sitelink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages joined with entities by the entities' site links."""
    e = _wikidata(spark, sf_dir).select("qid", "wikipedia_title")
    pages = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("n")).join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).select(F.concat(F.lit("T "), "c_name").alias("wikipedia_title"), "n")
    return pages.join(e, "wikipedia_title").select(F.substring("qid", 2, 20).cast("long").alias("id"), "wikipedia_title", "n")


@plan("SELECT page_id, url, length(html)::BIGINT AS n_chars, md5(html) AS digest FROM pages")
def src_rest_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages through a paged source, a partition for each page of answers (src_rest_wikipedia without the network)."""
    from ..sources.paged import read_pages, write_pages

    pages, folder = table(spark, sf_dir, "pages").select("page_id", "url", "html"), shared_path(spark, "answers")
    n = write_pages(pages, "page_id", 20, folder)
    return read_pages(spark, pages.schema, folder, n).select("page_id", "url", F.length("html").cast("long").alias("n_chars"), F.md5(F.col("html").cast("binary")).alias("digest"))


@plan("SELECT c_custkey AS id, c_name AS label, c_mktsegment AS segment FROM customer")
def src_rest_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entity records through the same source as a stream whose offset is the token of the next page (src_rest_wikidata)."""
    from ..sources.paged import stream_pages, write_pages

    rows = table(spark, sf_dir, "customer").selectExpr("c_custkey AS id", "c_name AS label", "c_mktsegment AS segment")
    folder, out, marks = (shared_path(spark, f"entities-{x}") for x in ("answers", "out", "marks"))
    write_pages(rows, "id", 50, folder)
    stream_pages(spark, rows.schema, folder).writeStream.format("parquet").option("path", out).option("checkpointLocation", marks).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out)
