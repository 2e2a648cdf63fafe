"""Readers of knowledge dumps and evaluation sets. Files are read by Spark's own readers, parsed by columns."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import html_text, squeeze


def wikidata(spark: SparkSession, path: str) -> DataFrame:
    """(qid, label, description, wikipedia_title, claims) of a line-per-entity dump.

    Array brackets, trailing commas and broken lines are left out; only items and properties stay.
    """
    lines = spark.read.text(path).select(F.trim(F.regexp_replace("value", "[ ]*,?[ ]*$", "")).alias("line")).where("line NOT IN ('[', ']', '')")
    v = lines.select(F.try_parse_json("line").alias("v")).where("v IS NOT NULL")
    get = lambda p: F.try_variant_get("v", p, "string")
    e = v.select(get("$.id").alias("qid"), get("$.labels.en.value").alias("label"), get("$.descriptions.en.value").alias("description"), get("$.sitelinks.enwiki.title").alias("wikipedia_title"), F.try_variant_get("v", "$.claims", "map<string,variant>").alias("claims"))
    return e.where(F.col("qid").rlike("^[QP]"))


def property_edges(entities: DataFrame, kinds: dict[str, str]) -> DataFrame:
    """(src, dst, type): item-valued statements of known properties."""
    rows = entities.select("qid", F.explode("claims").alias("property", "statements"))
    known = entities.sparkSession.createDataFrame(list(kinds.items()), "property string, type string")
    s = rows.join(F.broadcast(known), "property").select("qid", "type", F.explode(F.try_variant_get("statements", "$", "array<variant>")).alias("s"))
    kind = F.try_variant_get("s", "$.mainsnak.snaktype", "string")
    target = F.coalesce(F.try_variant_get("s", "$.mainsnak.datavalue.value.id", "string"), F.try_variant_get("s", "$.mainsnak.datavalue.value", "string"))
    return s.where(F.coalesce(kind, F.lit("value")) == "value").select(F.col("qid").alias("src"), target.alias("dst"), "type").where("dst IS NOT NULL")


def compact_claims(entities: DataFrame, properties: int = 40, values: int = 3, most: int = 100) -> DataFrame:
    """(qid, property, value): at most so many values of each of the first properties, by name, and in all."""
    names = F.slice(F.array_sort(F.map_keys("claims")), 1, properties)
    rows = entities.select("qid", F.posexplode(names).alias("p", "property"), "claims").select("qid", "p", "property", F.try_variant_get(F.element_at("claims", F.col("property")), "$", "array<variant>").alias("vs"))
    s = rows.select("qid", "p", "property", F.posexplode(F.slice("vs", 1, values)).alias("i", "s"))
    path = "$.mainsnak.datavalue.value"
    s = s.withColumn("value", F.coalesce(F.try_variant_get("s", f"{path}.id", "string"), F.try_variant_get("s", f"{path}.time", "string"), F.try_variant_get("s", f"{path}.amount", "string"), F.try_variant_get("s", f"{path}.text", "string"), F.try_variant_get("s", path, "string")))
    found = s.where("value IS NOT NULL").groupBy("qid").agg(F.slice(F.sort_array(F.collect_list(F.struct("p", "i", "property", "value"))), 1, most).alias("c"))
    return found.select("qid", F.explode("c").alias("c")).select("qid", "c.property", "c.value")


def enwiki(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, title, text, is_redirect) of main-namespace pages of an XML dump."""
    schema = "ns long, id long, title string, redirect struct<_title:string>, revision struct<text:struct<_VALUE:string>>"
    pages = spark.read.format("xml").option("rowTag", "page").schema(schema).load(path)
    return pages.where("ns = 0").select(F.col("id").alias("page_id"), "title", F.col("revision.text._VALUE").alias("text"), F.col("redirect").isNotNull().alias("is_redirect"))


def articles_only(pages: DataFrame, seen: DataFrame | None = None, least: int = 100) -> DataFrame:
    """Pages with a real text that were not ingested yet, with their URL."""
    p = pages.where(~F.col("is_redirect") & ~F.lower(F.ltrim("text")).startswith("#redirect") & (F.length("text") >= least))
    p = p.join(seen, "page_id", "left_anti") if seen is not None else p
    return p.withColumn("url", F.concat(F.lit("https://en.wikipedia.org/wiki/"), F.replace("title", F.lit(" "), F.lit("_"))))


_TUPLE = r"\(((?:[^()']|'(?:[^'\\]|\\.|'')*')*)\)"
_VALUE = re.compile(r"\s*(?:'((?:[^'\\]|\\.|'')*)'|([^,]*))\s*(?:,|$)")
_UNESCAPE = re.compile(r"\\(.)|''", re.S)
_NAMED = {"n": "\n", "r": "\r", "t": "\t", "0": "\0"}


def _values(row: str) -> list[str | None]:
    """Values of one tuple; NULL is null, quotes and escapes are undone."""
    out, at = [], 0
    while at < len(row):
        m = _VALUE.match(row, at)
        if m.end() == at:
            break
        if m[1] is not None:
            out.append(_UNESCAPE.sub(lambda e: "'" if e[1] is None else _NAMED.get(e[1], e[1]), m[1]))
        else:
            out.append(None if m[2].strip().upper() == "NULL" else m[2].strip())
        at = m.end()
    return out


def mysql_tuples(spark: SparkSession, path: str, table: str) -> DataFrame:
    """(values array<string>) of the rows that a dump inserts into a table. Packed files cannot be split, so rows are
    dealt out after they are read."""
    lines = spark.read.text(path).where(F.col("value").startswith(f"INSERT INTO `{table}`"))
    rows = lines.select(F.explode(F.regexp_extract_all("value", F.lit(_TUPLE), 1)).alias("row")).repartition(spark.sparkContext.defaultParallelism)

    @F.pandas_udf("array<string>")
    def parse(texts: pd.Series) -> pd.Series:
        return texts.map(_values)

    return rows.select(parse("row").alias("values"))


def typed(rows: DataFrame, columns: dict[str, tuple[int, str]]) -> DataFrame:
    """Named, typed columns by position; values that do not fit are null."""
    value = lambda i, kind: F.get("values", F.lit(i)).try_cast(kind)
    return rows.select(*[value(i, kind).alias(name) for name, (i, kind) in columns.items()])


# Positions of the columns of the dumps' tables.
PAGE = {"page_id": (0, "long"), "namespace": (1, "int"), "title": (2, "string"), "is_redirect": (3, "int"), "page_length": (9, "long")}
PAGE_PROPS = {"page_id": (0, "long"), "name": (1, "string"), "value": (2, "string")}
GEO_TAGS = {"page_id": (1, "long"), "lat": (4, "double"), "lon": (5, "double")}
CATEGORYLINKS = {"page_id": (0, "long"), "category": (1, "string")}
REDIRECT = {"page_id": (0, "long"), "namespace": (1, "int"), "title": (2, "string")}
CATEGORY = {"category_id": (0, "long"), "title": (1, "string"), "pages": (2, "long"), "subcategories": (3, "long"), "files": (4, "long")}


def plain_title(c: Column) -> Column:
    return F.replace(c, F.lit("_"), F.lit(" "))


def csv_claims(spark: SparkSession, path: str) -> DataFrame:
    """Labelled claims: id, domain, difficulty, label, text, notes, hallucination_type; rows without text are left out."""
    d = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    return d.withColumn("text", F.trim("text")).where("text <> ''").withColumn("label", F.lower(F.trim("label")).isin("true", "1", "yes"))


def jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def question_claims(questions: DataFrame, most_wrong: int = 3) -> DataFrame:
    """(question, claim, label): all correct answers and the first incorrect ones."""
    right = F.transform("correct", lambda a: F.struct(a.alias("claim"), F.lit(True).alias("label")))
    wrong = F.transform(F.slice("incorrect", 1, most_wrong), lambda a: F.struct(a.alias("claim"), F.lit(False).alias("label")))
    return questions.select("question", F.explode(F.concat(right, wrong)).alias("c")).select("question", "c.claim", "c.label")


def abstract_from_index(index: Column) -> Column:
    """Text of an inverted abstract (word to positions)."""
    pairs = F.flatten(F.transform(F.map_entries(index), lambda e: F.transform(e["value"], lambda p: F.struct(p.alias("p"), e["key"].alias("w")))))
    return F.array_join(F.transform(F.sort_array(pairs), lambda x: x["w"]), " ")


def authors(c: Column, most: int = 3) -> Column:
    return F.array_join(F.slice(c, 1, most), ", ")


def dois(c: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(c, F.lit(r"10\.[0-9]{4,9}/[-._;()/:A-Za-z0-9]+"), 0))


def snippet(c: Column) -> Column:
    """Plain text of a search snippet: tags out, common entities undone."""
    t = html_text(c)
    for code, to in (("&quot;", '"'), ("&#39;", "'"), ("&lt;", "<"), ("&gt;", ">"), ("&nbsp;", " "), ("&amp;", "&")):
        t = F.replace(t, F.lit(code), F.lit(to))
    return squeeze(t)
