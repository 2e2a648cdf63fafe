"""Queries over articles in wikitext. The tables hold none, so each document is set in wikitext by one expression that
both sides evaluate; what is read back from it is compared."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import chunking
from ..operators import wikitext as W
from ..session import table
from .registry import plan

_BOX = """CASE WHEN doc_id % 3 = 0 THEN '' ELSE concat('{{Infobox ', CASE doc_id % 4 WHEN 0 THEN 'scientist' WHEN 1 THEN 'Video game' WHEN 2 THEN 'battle' ELSE 'thing' END, chr(10),
    '| Birth-Date1 = {{date|', CAST(1900 + doc_id % 99 AS STRING), '}} 4 May ', CAST(1900 + doc_id % 99 AS STRING), chr(10), '| home town = [[Town ', CAST(doc_id % 7 AS STRING), '|the town]]<br/>''''there''''', chr(10), '| alias1 = A | alias2 = B', CAST(doc_id % 2 AS STRING), chr(10), '| alias3 = A', chr(10), '}}', chr(10)) END"""
#: (doc_id, wiki): the whole text within headers, links, categories and an infobox.
WIKI = f"""SELECT doc_id, lang, source, concat({_BOX}, '''''''', lang, ' ', source, ''''''' was born on 4 May ', CAST(1900 + doc_id % 99 AS STRING), ' and died 1999. Founded in ', CAST(1700 + doc_id % 200 AS STRING), ', population of 1,', CAST(200 + doc_id % 700 AS STRING), '. See [[Lang ', lang, '|it]] and [[File:x.png]].', chr(10),
    CASE WHEN doc_id % 5 = 0 THEN '' ELSE concat('== Body ==', chr(10), replace(coalesce(text, ''), '=', '-'), chr(10), '=== Sub ', lang, ' ===', chr(10), 'more [[Source ', source, ']] [https://x.org/', CAST(doc_id AS STRING), ' here]', chr(10), '== See also ==', chr(10), '* [[Other ', CAST(doc_id % 9 AS STRING), ']]', chr(10), '* [[Lang ', lang, ']]', chr(10), '== References ==', chr(10), 'x', chr(10)) END,
    '[[Category:', source, ']] [[category:', lang, '|key]]') AS wiki FROM documents"""


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    select, _, _ = WIKI.removeprefix("SELECT doc_id, lang, source, ").rpartition(" AS wiki FROM documents")
    return table(spark, sf_dir, "documents").select("doc_id", "lang", "source", F.expr(select).alias("wiki"))


_TRIM = r"regexp_replace({0}, '^[ \t\n\r]+|[ \t\n\r]+$', '', 'g')"
_PIECES = r"string_split(regexp_replace(wiki, '(?m)^(={2,6})[ \t]*([^\n=]+?)[ \t]*={2,6}[ \t]*$', chr(31) || '\1' || chr(31) || '\2' || chr(31), 'g'), chr(31))"
_SECTIONS = f"""w AS ({WIKI}), p AS (SELECT doc_id, {_PIECES} AS p FROM w), s AS (SELECT doc_id, 0 AS i, 'Introduction' AS title, 1 AS level, {_TRIM.format("p[1]")} AS content FROM p WHERE p[1] <> '' AND length(p) > 1
    UNION ALL SELECT doc_id, 0, 'Introduction', 1, p[1] FROM p WHERE length(p) = 1 UNION ALL SELECT doc_id, i, trim(p[i + 1]), length(p[i]), {_TRIM.format("p[i + 2]")} FROM (SELECT doc_id, p, unnest(range(2, length(p), 3)) AS i FROM p)),
    o AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS ord FROM s)"""


@plan(f"WITH {_SECTIONS} SELECT doc_id, ord::INT AS ord, title, level::INT AS level, md5(content) AS content FROM o")
def fn_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = articles(spark, sf_dir).select("doc_id", F.posexplode(W.sections(F.col("wiki"))).alias("ord", "s"))
    return s.select("doc_id", "ord", "s.title", "s.level", F.md5(F.col("s.content").cast("binary")).alias("content"))


@plan(f"WITH {_SECTIONS} SELECT doc_id, count(*) AS n_kept, sum(length(content))::BIGINT AS n_chars FROM o WHERE lower(title) NOT IN ('see also', 'references') GROUP BY 1")
def filt_low_signal_section(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = articles(spark, sf_dir).select("doc_id", F.explode(W.telling_sections(F.col("wiki"))).alias("s"))
    return s.groupBy("doc_id").agg(F.count("*").alias("n_kept"), F.sum(F.length("s.content")).alias("n_chars"))


@plan("""SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'scientist' WHEN 1 THEN 'Video game' WHEN 2 THEN 'battle' ELSE 'thing' END AS type, '4 May ' || (1900 + doc_id % 99) AS birth_date, 'Town ' || (doc_id % 7) || ' | there' AS home_town, 'A | B' || (doc_id % 2) AS alias, CASE doc_id % 4 WHEN 0 THEN 'person' WHEN 1 THEN 'creative_work' WHEN 2 THEN 'event' ELSE 'none' END AS kind FROM documents WHERE doc_id % 3 <> 0""")
def fn_infobox(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Infoboxes with nested templates, links, repeated keys (fn_infobox_key, fn_instance_type)."""
    kind, properties = W.infobox(F.col("wiki"))
    a = articles(spark, sf_dir).select("doc_id", kind.alias("type"), properties.alias("p")).where("type IS NOT NULL")
    return a.select("doc_id", "type", *[F.col("p")[k].alias(k) for k in ("birth_date", "home_town", "alias")], F.coalesce(W.instance_type(F.col("type")), F.lit("none")).alias("kind"))


@plan("SELECT doc_id, 'Town ' || (doc_id % 7) || ' x' AS value FROM documents")
def link_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("[[Town "), (F.col("doc_id") % 7).cast("string"), F.lit("|t]] ''x''<ref>{{y}} ")).alias("v"))
    return v.select("doc_id", W.link_text(F.col("v")).alias("value"))


_LIST = "array_to_string(list_sort(list_distinct(list_transform({0}, lambda x: trim(x)))), '|')"


@plan(rf"""WITH w AS ({WIKI}) SELECT doc_id, {_LIST.format("list_filter(regexp_extract_all(wiki, '" + chr(92) + "[" + chr(92) + "[([^|" + chr(92) + "]#]+)(?:" + chr(92) + "|[^" + chr(92) + "]]*)?" + chr(92) + "]" + chr(92) + "]', 1), lambda x: NOT regexp_matches(lower(trim(x)), '^(file|image|category|help|user|template|wikipedia|portal):'))")} AS links,
    array_to_string(list_sort(list_distinct([source, lang])), '|') AS categories, lang || ' ' || source AS entities, CASE WHEN doc_id % 5 = 0 THEN '' ELSE array_to_string(list_sort(['Other ' || (doc_id % 9), 'Lang ' || lang]), '|') END AS see_also, {_LIST.format("regexp_extract_all(wiki, '" + chr(92) + "[https?://[^" + chr(92) + "s" + chr(92) + "]]+(?:" + chr(92) + "s+[^" + chr(92) + "]]+)?" + chr(92) + "]')")} AS external_links FROM w""")
def fn_extract_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links, categories, bold names, "see also" and external links of each article, as sorted sets."""
    c, join = F.col("wiki"), lambda x: F.array_join(x, "|")
    return articles(spark, sf_dir).select("doc_id", join(W.links(c)).alias("links"), join(W.categories(c)).alias("categories"), join(W.bold_entities(c)).alias("entities"), join(W.see_also(c)).alias("see_also"), join(W.external_links(c)).alias("external_links"))


@plan("SELECT doc_id, (1700 + doc_id % 200)::VARCHAR AS founded_year, '1' || (200 + doc_id % 700) AS population, '4 May ' || (1900 + doc_id % 99) AS birth, '1999' AS death FROM documents")
def fn_temporal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates of birth and death, year of foundation and population (fn_numeric)."""
    t, n = W.temporal(F.col("wiki")), W.numeric(F.col("wiki"))
    return articles(spark, sf_dir).select("doc_id", n["founded_year"].alias("founded_year"), n["population"].alias("population"), F.get(t["births"], F.lit(0)).alias("birth"), F.get(t["deaths"], F.lit(0)).alias("death"))


@plan(f"""WITH {_SECTIONS}, d AS (SELECT doc_id, lang, source FROM w) SELECT doc_id, (SELECT count(*) FROM o WHERE o.doc_id = d.doc_id) AS n_sections, CASE WHEN doc_id % 3 = 0 THEN 0 ELSE 3 END AS n_properties,
    CASE WHEN doc_id % 5 = 0 THEN concat(lang, ' ', source, ' was born on 4 May ', 1900 + doc_id % 99, ' and died 1999. Founded in ', 1700 + doc_id % 200, ', population of 1,', 200 + doc_id % 700, '. See it and .') ELSE concat(lang, ' ', source, ' was born on 4 May ', 1900 + doc_id % 99, ' and died 1999. Founded in ', 1700 + doc_id % 200, ', population of 1,', 200 + doc_id % 700, '. See it and .') END AS first_paragraph FROM d""")
def proj_article(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The composition of all article fields (fn_first_paragraph, fn_structured's map)."""
    a = W.articles(articles(spark, sf_dir), "doc_id", "wiki")
    return a.select("doc_id", F.size("sections").cast("long").alias("n_sections"), F.coalesce(F.size("properties"), F.lit(0)).alias("n_properties"), "first_paragraph")


@plan()
def chunk_page_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Telling sections of whole articles cut into passages."""
    c = W.passages_of_sections(articles(spark, sf_dir), "doc_id", lambda x: chunking.chunk_column(x, chunking.passages), "wiki")
    return c.select("doc_id", "section_ord", "section", "chunk_index", F.length("chunk").alias("n_chars"))


_CLEAN = "SELECT doc_id, md5(trim(regexp_replace(concat('It is ', lang, ' and bold ', source, ' here. item end'), '[ \\t\\n\\r]+', ' ', 'g'))) AS digest FROM documents"


@plan(_CLEAN)
def fn_clean_wikitext(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.corpus import clean_wikitext

    d = table(spark, sf_dir, "documents").selectExpr("doc_id", "concat('{{note|{{in}}}}It is [[Lang|', lang, ']]<ref name=\"a\">z</ref> and bold ''''''', source, ''''''' <b>here</b>.', chr(10), '* item [[Category:x]][https://e.org end]') AS t")
    return d.select("doc_id", F.md5(clean_wikitext(F.col("t")).cast("binary")).alias("digest"))


@plan("SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'A b' WHEN 1 THEN 'A b|C' WHEN 2 THEN '' ELSE 'X' END AS titles FROM documents")
def filt_wikilink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles of links: namespaces dropped, sections and labels cut (fn_mention_titles)."""
    from ..operators.corpus import wikilinks

    t = table(spark, sf_dir, "documents").selectExpr("doc_id", "CASE doc_id % 4 WHEN 0 THEN '[[A_b#s|l]] [[A b]]' WHEN 1 THEN '[[:A b]] and [[C|c]] [[file:x]]' WHEN 2 THEN 'none [[Help:y]] [[#z]]' ELSE '[[X]] [[User talk]]' END AS t")
    return t.select("doc_id", F.array_join(F.filter(wikilinks(F.col("t")), lambda x: x != "User talk"), "|").alias("titles"))
