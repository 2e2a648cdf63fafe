"""What an article's infobox tells, the edges that follow from it, and a graph that grows by versions.

Two tables drive it: ``FIELDS`` says which keys of an infobox give a field, in their order of priority, and
``EDGES`` which edge a field makes. Both are resolved by lookups in the article's own map and arrays.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialize
from .wikitext import instance_type, link_text, list_items

# A field's keys by priority, how it is read, and its longest value or list.
# text: the first key's value; link: the same without link marks; list: the first key's items; union: the items of all keys.
FIELDS = (
    ("birth_date", ("birth_date", "born", "birthdate"), "text", 50),
    ("death_date", ("death_date", "died", "deathdate"), "text", 50),
    ("location", ("location", "birth_place", "birthplace", "city"), "text", 100),
    ("occupation", ("occupation", "profession", "known_for", "field"), "text", 100),
    ("nationality", ("nationality", "citizenship"), "text", 50),
    ("spouse", ("spouse", "partner", "spouses"), "link", 100),
    ("children", ("children", "child"), "list", 20),
    ("parents", ("parents", "parent", "father", "mother"), "union", 10),
    ("education", ("education", "alma_mater", "alma mater", "school", "university"), "union", 10),
    ("employer", ("employer", "employers", "organization", "company", "studio", "label"), "union", 10),
    ("awards", ("awards", "award", "honours", "honors"), "union", 20),
    ("author_of", ("notable_works", "works", "bibliography", "discography", "filmography"), "union", 20),
    ("genre", ("genre", "genres", "style", "movement"), "union", 10),
    ("influenced_by", ("influences", "influenced_by"), "union", 20),
    ("influenced", ("influenced", "students"), "union", 20),
    ("founded_by", ("founder", "founders", "founded_by"), "link", 100),
    ("founding_date", ("founded", "foundation", "established", "formed"), "text", 50),
    ("headquarters", ("headquarters", "hq_location", "location_city"), "link", 100),
    ("industry", ("industry", "industries", "sector"), "link", 100),
    ("country", ("country", "countries", "nation"), "link", 50),
    ("capital_of", ("capital_of", "country"), "link", 100),
    ("part_of", ("subdivision_name", "state", "province", "region", "district"), "link", 100),
    ("predecessor", ("predecessor", "preceded_by"), "link", 100),
    ("successor", ("successor", "succeeded_by"), "link", 100),
)
CAPITALS = ("settlement", "city")  # infobox types whose country is one that they are the capital of
# Longest lists of an article's row.
CAPS = {"links": 200, "categories": 50, "entities": 100, "see_also": 50, "disambiguation": 100}
# Edge type, label of its target, and the field that names the target.
EDGES = (
    ("IN_CATEGORY", "Category", "categories"),
    ("MENTIONS", "Entity", "entities"),
    ("LINKS_TO", "Article", "links"),
    ("SEE_ALSO", "Article", "see_also"),
    ("DISAMBIGUATES", "Article", "disambiguation"),
    ("LOCATED_IN", "Location", "location"),
    ("HAS_OCCUPATION", "Occupation", "occupation"),
    ("HAS_NATIONALITY", "Nationality", "nationality"),
    ("MARRIED_TO", "Person", "spouse"),
    ("PARENT_OF", "Person", "children"),
    ("CHILD_OF", "Person", "parents"),
    ("EDUCATED_AT", "EducationalInstitution", "education"),
    ("EMPLOYED_BY", "Organization", "employer"),
    ("WON_AWARD", "Award", "awards"),
    ("AUTHORED", "CreativeWork", "author_of"),
    ("HAS_GENRE", "Genre", "genre"),
    ("INFLUENCED_BY", "Article", "influenced_by"),
    ("INFLUENCED", "Article", "influenced"),
    ("FOUNDED_BY", "Person", "founded_by"),
    ("HEADQUARTERED_IN", "Location", "headquarters"),
    ("IN_INDUSTRY", "Industry", "industry"),
    ("IN_COUNTRY", "Country", "country"),
    ("PART_OF", "Location", "part_of"),
    ("PRECEDED_BY", "Article", "predecessor"),
    ("SUCCEEDED_BY", "Article", "successor"),
    ("INSTANCE_OF", "Type", "instance_of"),
    ("CAPITAL_OF", "Location", "capital_of"),
    ("HAS_WIKIDATA", "WikidataEntity", "wikidata_id"),
    ("REDIRECTS_TO", "Article", "redirect_target"),
    ("IN_COUNTRY", "Country", "geo_country_code"),
    ("INSTANCE_OF", "Type", "geo_type"),
)


def structured(properties: Column, kind: Column) -> dict[str, Column]:
    """The fields of an infobox (a map of properties and its type): null or empty where no key is there.

    Lists are sorted sets, cut to their longest length; values are cut to theirs.
    """
    out = {}
    for name, keys, way, longest in FIELDS:
        values = [F.try_element_at(properties, F.lit(k)) for k in keys]
        first = F.coalesce(*values)
        if way == "list":
            out[name] = F.slice(F.when(first.isNotNull(), list_items(first)).otherwise(F.array().cast("array<string>")), 1, longest)
        elif way == "union":
            each = F.transform(F.array_compact(F.array(*values)), list_items)
            out[name] = F.slice(F.coalesce(F.array_sort(F.array_distinct(F.flatten(each))), F.array().cast("array<string>")), 1, longest)
        else:
            out[name] = F.substring(first if way == "text" else link_text(first), 1, longest)
    out["capital_of"] = F.when(F.lower(kind).isin(*CAPITALS), out["capital_of"])
    return out | {"instance_of": instance_type(kind)}


def article_row(rows: DataFrame) -> DataFrame:
    """``rows`` as they are stored: lists that have a longest length are sorted sets cut to it."""
    return rows.withColumns({c: F.slice(F.array_sort(F.array_distinct(c)), 1, n) for c, n in CAPS.items() if c in rows.columns})


def article_edges(rows: DataFrame, key: str) -> DataFrame:
    """(src_label, src, type, dst_label, dst): all edges that the fields of articles make, each once.

    Categories of one article are also related to each other, the smaller one first.
    """
    kinds = dict(rows.dtypes)

    def one(edge: str, label: str, names: Column) -> Column:
        return F.transform(names, lambda n: F.struct(F.lit("Article").alias("src_label"), F.col(key).cast("string").alias("src"), F.lit(edge).alias("type"), F.lit(label).alias("dst_label"), n.cast("string").alias("dst")))

    made = [one(edge, label, F.col(f) if kinds[f].startswith("array") else F.array_compact(F.array(F.col(f)))) for edge, label, f in EDGES if f in kinds]
    if "categories" in kinds:
        own = F.array_sort(F.array_distinct("categories"))
        pairs = F.flatten(F.transform(own, lambda a, i: F.transform(F.slice(own, i + 2, F.size(own)), lambda b: F.struct(F.lit("Category").alias("src_label"), a.alias("src"), F.lit("RELATED_TO").alias("type"), F.lit("Category").alias("dst_label"), b.alias("dst")))))
        made.append(pairs)
    none = F.array().cast("array<struct<src_label:string,src:string,type:string,dst_label:string,dst:string>>")
    all_edges = F.concat(*[F.coalesce(m, none) for m in made]) if made else none
    return rows.select(F.explode(all_edges).alias("e")).select("e.*").where("dst IS NOT NULL").distinct()


def upsert_graph(path: str, nodes: DataFrame, edges: DataFrame, version: int) -> None:
    """Write a version of nodes (label, name) and edges; targets that no version knows are created as stubs.

    Writing a version again replaces it. Node and edge rows are only those that are new, so a version's size is that of
    what it adds.
    """
    spark = nodes.sparkSession
    known, linked = read_graph(spark, path, version)
    edges = materialize(edges.distinct(), "edges")  # read for the ends and for the links
    own = nodes.select("label", "name").distinct().withColumn("stub", F.lit(False))
    ends = edges.select(F.col("src_label").alias("label"), F.col("src").alias("name")).union(edges.select("dst_label", "dst")).distinct()
    made = ends.join(own, ["label", "name"], "left_anti").withColumn("stub", F.lit(True))
    fresh = own.unionByName(made)
    if known is not None:  # a stub that comes as a node of its own is written again, as no stub
        fresh = fresh.join(known.select("label", "name", F.col("stub").alias("was")), ["label", "name"], "left").where("was IS NULL OR (was AND NOT stub)").drop("was")
        edges = edges.join(linked, ["src_label", "src", "type", "dst_label", "dst"], "left_anti")
    materialize(fresh, "fresh").write.mode("overwrite").parquet(f"{path}/nodes/version={version}")
    materialize(edges, "linked").write.mode("overwrite").parquet(f"{path}/edges/version={version}")


def read_graph(spark: SparkSession, path: str, before: int | None = None) -> tuple[DataFrame | None, DataFrame | None]:
    """(nodes, edges) after all versions, or those before one: nodes (label, name, stub, first) and edges, each once."""
    if before == 0:
        return None, None
    least = F.col("version") < before if before is not None else F.lit(True)
    nodes = spark.read.parquet(f"{path}/nodes").where(least).groupBy("label", "name").agg(F.min("stub").alias("stub"), F.min("version").alias("first"))
    edges = spark.read.parquet(f"{path}/edges").where(least).select("src_label", "src", "type", "dst_label", "dst")
    return nodes, edges.distinct()
