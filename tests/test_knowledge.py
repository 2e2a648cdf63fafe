"""Infoboxes of any length, structured fields, and graphs by versions on literal rows."""

import time

from pyspark.sql import functions as F

from veristrata.operators import knowledge as K
from veristrata.operators import wikitext as W


def test_infoboxes_of_any_length(spark):
    """Long values, deep and unclosed templates neither end the executor nor take more than linear time."""
    long, spaces = "word " * 20_000, " " * 200_000
    texts = {
        1: "{{Infobox city|a\n| name = Short\n| text = " + long + "\n| after = yes}} rest",
        2: "{{Infobox city\n| open = " + long,
        3: "{{Infobox city\n| deep = {{a|{{b|{{c|{{d|{{e|" + long + "}}}}}}}}}} kept\n}}",
        4: "{{Infobox city\n" + "".join(f"| k{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}x = {{{{t|{i}}}}} v{i}\n" for i in range(3000)) + "}}",
        5: "{{" * 20_000 + "Infobox",
        6: "x" + spaces + "y {{Infobox city\n| a = 1" + spaces + "| b = 2}}" + spaces,
        7: "{{Infobox city\n| a = {{b}} {{c " + "{{d " * 5000,
        8: None,
    }
    kind, p = W.infobox(F.col("t"))
    start = time.perf_counter()
    got = {r["i"]: r for r in spark.createDataFrame(list(texts.items()), "i int, t string").select("i", kind.alias("kind"), p.alias("p"), F.size(W.sections(F.col("t"))).alias("n"), F.length(W.first_paragraph(F.col("t"))).alias("f")).collect()}
    assert time.perf_counter() - start < 60
    assert got[1]["kind"] == "city" and got[1]["p"] == {"name": "Short", "after": "yes"}  # a value of 500 characters or more is left out
    assert [got[i]["kind"] for i in (2, 5, 7, 8)] == [None] * 4
    assert got[3]["p"] == {"deep": "kept"} and got[6]["p"] == {"a": "1", "b": "2"}
    assert len(got[4]["p"]) == 26 * 26 and got[4]["p"]["kaax"].startswith("v0 | v676")


def test_structured_fields(spark):
    rows = [
        (1, "Settlement", {"born": "x" * 60, "birth_date": "1900", "country": "Land", "mother": "Ann and Bo", "father": "Cy, Dan", "children": "Eve; Fay", "child": "Gus; Hal", "partner": "P"}),
        (2, "scientist", {"country": "Land", "awards": ", ".join(f"Prize {i:02d}" for i in range(30)), "label": "aa and bb", "employer": "cc and dd"}),
        (3, None, None), (4, "thing", {}),
    ]
    d = spark.createDataFrame(rows, "id int, kind string, p map<string,string>")
    got = {r["id"]: r for r in d.select("id", *[c.alias(n) for n, c in K.structured(F.col("p"), F.col("kind")).items()]).collect()}
    assert len(got[1]) == 26 and (got[1]["birth_date"], got[1]["spouse"], got[1]["country"], got[1]["capital_of"], got[1]["instance_of"]) == ("1900", "P", "Land", "Land", "place")
    assert got[1]["children"] == ["Eve", "Fay"] and got[1]["parents"] == ["Ann", "Bo", "Cy", "Dan"] and got[2]["capital_of"] is None and got[2]["instance_of"] == "person"
    assert len(got[2]["awards"]) == 20 and got[2]["employer"] == ["aa", "bb", "cc", "dd"]
    for i in (3, 4):
        assert all(v is None or v == [] for k, v in got[i].asDict().items() if k != "id")


def test_graph_by_versions(spark, tmp_path):
    """Stubs become nodes when they come themselves; a version that is written twice changes nothing."""
    path = f"file://{tmp_path}/graph"
    nodes = lambda *names: spark.createDataFrame([("Article", n) for n in names], "label string, name string")
    edges = lambda *pairs: spark.createDataFrame([("Article", a, "LINKS_TO", "Article", b) for a, b in pairs], "src_label string, src string, type string, dst_label string, dst string")
    for version, own, linked in ((0, ("a",), (("a", "b"), ("a", "b"), ("a", "c"))), (1, ("b", "d"), (("a", "b"), ("b", "e"))), (1, ("b", "d"), (("a", "b"), ("b", "e")))):
        K.upsert_graph(path, nodes(*own), edges(*linked), version)
    got, linked = K.read_graph(spark, path)
    assert {(r["name"], r["stub"], r["first"]) for r in got.collect()} == {("a", False, 0), ("b", False, 0), ("c", True, 0), ("d", False, 1), ("e", True, 1)}
    assert sorted((r["src"], r["dst"]) for r in linked.collect()) == [("a", "b"), ("a", "c"), ("b", "e")]
    assert sorted((r["src"], r["version"]) for r in spark.read.parquet(f"{path}/edges").collect()) == [("a", 0), ("a", 0), ("b", 1)]


def test_edges_of_odd_rows(spark):
    rows = spark.createDataFrame([(1, ["x", "y", "x"], None, "l"), (2, None, ["k", None], None), (3, [], [], "")], "id int, categories array<string>, links array<string>, location string")
    got = sorted(tuple(r) for r in K.article_edges(K.article_row(rows), "id").collect())
    assert got == sorted([("Article", "1", "IN_CATEGORY", "Category", "x"), ("Article", "1", "IN_CATEGORY", "Category", "y"), ("Article", "1", "LOCATED_IN", "Location", "l"), ("Article", "2", "LINKS_TO", "Article", "k"), ("Article", "3", "LOCATED_IN", "Location", ""), ("Category", "x", "RELATED_TO", "Category", "y")])
    assert K.article_edges(rows.limit(0), "id").count() == 0
