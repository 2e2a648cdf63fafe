"""Queries over infobox fields, the edges they make, and a graph that grows by versions. Each document is given an infobox and
link lists by expressions over its columns; the SQL states what must come back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import knowledge as K
from ..operators import wikitext as W
from ..session import materialize, shared_path, table
from .registry import plan

_BOX = """CASE WHEN doc_id % 5 = 0 THEN 'no box' ELSE concat('{{Infobox ', CASE doc_id % 2 WHEN 0 THEN 'settlement' ELSE 'scientist' END, chr(10), '| born = {{d|{{e}}}}4 May ', 1900 + doc_id % 99, chr(10), CASE WHEN doc_id % 3 = 0 THEN concat('| birth_date = first ', doc_id, chr(10)) ELSE '' END,
    '| birthplace = [[Town ', doc_id % 7, '|town]]', chr(10), '| known_for = Field ', lang, chr(10), '| spouses = ''''Person ', doc_id % 5, '''''', chr(10), '| children = 3', chr(10), '| father = Dad ', doc_id % 4, ' and Uncle', chr(10), '| mother = Mum; Aunt ', doc_id % 4, chr(10), '| genre = Rock, Pop ', source, chr(10),
    '| founder = Founder ', lang, chr(10), '| founded = ', 1700 + doc_id % 200, chr(10), '| nation = Land ', doc_id % 4, chr(10), CASE WHEN doc_id % 4 = 0 THEN concat('| country = Main ', doc_id % 3, chr(10)) ELSE '' END, '| state = State ', doc_id % 6, chr(10), '| preceded_by = Doc ', doc_id - 1, chr(10), '| succeeded_by = Doc ', doc_id + 1, chr(10), '}}') END"""
_LINKS = {
    "categories": "array(source, lang, 'All')",
    "entities": "array(concat(lang, ' ', source))",
    "links": "array(concat('Lang ', lang), concat('Source ', source))",
    "see_also": "array(concat('Other ', doc_id % 9))",
    "disambiguation": "CASE WHEN doc_id % 11 = 0 THEN array('Doc 1', 'Doc 2') ELSE array() END",
    "wikidata_id": "concat('Q', doc_id)",
    "redirect_target": "CASE WHEN doc_id % 13 = 0 THEN concat('Doc ', doc_id + 1) END",
    "geo_country_code": "upper(lang)",
    "geo_type": "CASE WHEN doc_id % 4 = 0 THEN 'city' END",
}


def _articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").selectExpr("doc_id", f"{_BOX} AS box", *[f"{e} AS {n}" for n, e in _LINKS.items()])
    kind, properties = W.infobox(F.col("box"))
    d = d.withColumn("kind", kind).withColumn("properties", properties)
    return K.article_row(d.select("doc_id", *_LINKS, *[c.alias(n) for n, c in K.structured(F.col("properties"), F.col("kind")).items()]))


#: What the box tells, by field.
_TOLD = {
    "birth_date": "CASE WHEN doc_id % 3 = 0 THEN 'first ' || doc_id ELSE '4 May ' || (1900 + doc_id % 99) END",
    "location": "'Town ' || (doc_id % 7)",
    "occupation": "'Field ' || lang",
    "spouse": "'Person ' || (doc_id % 5)",
    "founded_by": "'Founder ' || lang",
    "founding_date": "(1700 + doc_id % 200)::VARCHAR",
    "country": "CASE WHEN doc_id % 4 = 0 THEN 'Main ' || (doc_id % 3) ELSE 'Land ' || (doc_id % 4) END",
    "capital_of": "CASE WHEN doc_id % 4 = 0 THEN 'Main ' || (doc_id % 3) END",
    "part_of": "'State ' || (doc_id % 6)",
    "predecessor": "'Doc ' || (doc_id - 1)",
    "successor": "'Doc ' || (doc_id + 1)",
    "instance_of": "CASE WHEN doc_id % 2 = 0 THEN 'place' ELSE 'person' END",
}
_LISTS = {"parents": "list_sort(['Dad ' || (doc_id % 4), 'Uncle', 'Mum', 'Aunt ' || (doc_id % 4)])", "genre": "list_sort(['Rock', 'Pop ' || source])"}
_NONE = ("death_date", "nationality", "headquarters", "industry")
_EMPTY = ("children", "education", "employer", "awards", "author_of", "influenced_by", "influenced")


@plan("SELECT doc_id, " + ", ".join([*[f"CASE WHEN doc_id % 5 <> 0 THEN {e} END AS {n}" for n, e in _TOLD.items()], *[f"CASE WHEN doc_id % 5 <> 0 THEN array_to_string({e}, '|') ELSE '' END AS {n}" for n, e in _LISTS.items()], *[f"NULL::VARCHAR AS {n}" for n in _NONE], *[f"'' AS {n}" for n in _EMPTY]]) + " FROM documents")
def fn_structured(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 25 fields of an article's infobox, each from the first of its keys that is there; lists joined with bars."""
    a = _articles(spark, sf_dir)
    lists = {*_LISTS, *_EMPTY}
    return a.select("doc_id", *[(F.array_join(n, "|") if n in lists else F.col(n)).alias(n) for n in [*[f[0] for f in K.FIELDS], "instance_of"]])


def _edges_sql() -> str:
    box = "FROM documents WHERE doc_id % 5 <> 0"
    plain = {"categories": ["source", "lang", "'All'"], "entities": ["lang || ' ' || source"], "links": ["'Lang ' || lang", "'Source ' || source"], "see_also": ["'Other ' || (doc_id % 9)"], "wikidata_id": ["'Q' || doc_id"], "geo_country_code": ["upper(lang)"]}
    some = {"disambiguation": (["'Doc 1'", "'Doc 2'"], "doc_id % 11 = 0"), "redirect_target": (["'Doc ' || (doc_id + 1)"], "doc_id % 13 = 0"), "geo_type": (["'city'"], "doc_id % 4 = 0")}
    parts = []
    for edge, label, field in K.EDGES:
        head = f"SELECT 'Article' AS src_label, doc_id::VARCHAR AS src, '{edge}' AS type, '{label}' AS dst_label, "
        if field in plain:
            parts += [f"{head}{e} AS dst FROM documents" for e in plain[field]]
        elif field in some:
            parts += [f"{head}{e} AS dst FROM documents WHERE {some[field][1]}" for e in some[field][0]]
        elif field in _TOLD:
            parts.append(f"{head}{_TOLD[field]} AS dst {box}")
        elif field in _LISTS:
            parts.append(f"{head}unnest({_LISTS[field]}) AS dst {box}")
    parts.append("SELECT 'Category', c[i], 'RELATED_TO', 'Category', c[j] FROM (SELECT DISTINCT list_sort(list_distinct([source, lang, 'All'])) AS c FROM documents), (VALUES (1, 2), (1, 3), (2, 3)) t(i, j)")
    return f"edges AS (SELECT DISTINCT * FROM ({' UNION ALL '.join(parts)}) WHERE dst IS NOT NULL)"


@plan(f"WITH {_edges_sql()} SELECT * FROM edges")
def gr_article_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All typed edges of articles, 31 kinds from one table of fields, and between the categories of one article."""
    return K.article_edges(_articles(spark, sf_dir), "doc_id")


@plan(f"""WITH {_edges_sql()}, v AS (SELECT *, CASE WHEN src_label = 'Article' THEN src::BIGINT % 2 ELSE 0 END AS version FROM edges), ends AS (SELECT src_label AS label, src AS name, version FROM v UNION ALL SELECT dst_label, dst, version FROM v),
n AS (SELECT label, name, min(version) AS first, bool_and(stub) AS stub FROM (SELECT *, true AS stub FROM ends UNION ALL SELECT 'Article', doc_id::VARCHAR, doc_id % 2, false FROM documents) GROUP BY ALL), d AS (SELECT dst_label AS label, dst AS name, count(*) AS inbound FROM edges GROUP BY ALL)
SELECT label, name, stub, first::INT AS first, coalesce(inbound, 0) AS inbound FROM n LEFT JOIN d USING (label, name)""")
def sink_graph_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two versions of articles and edges put into one graph, the second twice; missing targets are created as stubs."""
    path = shared_path(spark, "graph")
    a = materialize(_articles(spark, sf_dir), "articles")
    made = {}
    for version in (0, 1):
        own = a.where(F.col("doc_id") % 2 == version)
        edges = K.article_edges(own.drop("categories") if version else own, "doc_id")
        if version:  # all pairs of categories came with the first version
            edges = edges.unionByName(K.article_edges(own.select("doc_id", "categories"), "doc_id").where("src_label = 'Article'"))
        else:
            edges = edges.unionByName(K.article_edges(a.select("doc_id", "categories"), "doc_id").where("src_label = 'Category'"))
        made[version] = own.select(F.lit("Article").alias("label"), F.col("doc_id").cast("string").alias("name")), materialize(edges, "made")
    for version in (0, 1, 1):
        K.upsert_graph(path, *made[version], version)
    nodes, edges = K.read_graph(spark, path)
    inbound = edges.groupBy(F.col("dst_label").alias("label"), F.col("dst").alias("name")).agg(F.count("*").alias("inbound"))
    return nodes.join(inbound, ["label", "name"], "left").fillna(0, ["inbound"]).select("label", "name", "stub", F.col("first").cast("int").alias("first"), "inbound")
