"""Sources and streams on small files."""

import datetime as dt
import json

from pyspark.sql import functions as F

from veristrata.sources import dumps
from veristrata.streaming import limits


def test_wikidata_lines(spark, tmp_path):
    entity = {"id": "Q1", "labels": {"en": {"value": "universe"}}, "descriptions": {}, "sitelinks": {"enwiki": {"title": "Universe"}}, "claims": {"P31": [{"mainsnak": {"snaktype": "value", "datavalue": {"value": {"id": "Q35120"}}}}, {"mainsnak": {"snaktype": "novalue"}}], "P99": []}}
    (tmp_path / "d.json").write_text("[\n" + json.dumps(entity) + ",\nbroken{,\n" + json.dumps({"id": "L5"}) + "\n]\n")
    e = dumps.wikidata(spark, str(tmp_path / "d.json"))
    assert [tuple(r)[:4] for r in e.collect()] == [("Q1", "universe", None, "Universe")]
    assert [tuple(r) for r in dumps.property_edges(e, {"P31": "INSTANCE_OF"}).collect()] == [("Q1", "Q35120", "INSTANCE_OF")]


def test_enwiki_pages(spark, tmp_path):
    page = "<page><title>{}</title><ns>{}</ns><id>{}</id>{}<revision><text>{}</text></revision></page>"
    body = page.format("Marie Curie", 0, 1, "", "x" * 120) + page.format("Talk:A", 1, 2, "", "y") + page.format("Old", 0, 3, '<redirect title="New" />', "#REDIRECT [[New]]") + page.format("Seen", 0, 4, "", "z" * 120)
    (tmp_path / "w.xml").write_text(f"<mediawiki>{body}</mediawiki>")
    pages = dumps.enwiki(spark, str(tmp_path / "w.xml"))
    assert {(r["page_id"], r["is_redirect"]) for r in pages.collect()} == {(1, False), (3, True), (4, False)}
    left = dumps.articles_only(pages, spark.createDataFrame([(4,)], "page_id long")).collect()
    assert [(r["title"], r["url"]) for r in left] == [("Marie Curie", "https://en.wikipedia.org/wiki/Marie_Curie")]


def test_mysql_rows(spark, tmp_path):
    (tmp_path / "p.sql").write_text("-- x\nINSERT INTO `redirect` VALUES (1,0,'It\\'s, a (b)','',NULL),(2,1,'A_B''c','x','y');\nINSERT INTO `other` VALUES (9);\n")
    rows = dumps.typed(dumps.mysql_tuples(spark, str(tmp_path / "p.sql"), "redirect"), dumps.REDIRECT)
    assert sorted(map(tuple, rows.collect())) == [(1, 0, "It's, a (b)"), (2, 1, "A_B'c")]


def test_claim_files(spark, tmp_path):
    (tmp_path / "c.csv").write_text("id,domain,difficulty,label,text,notes,hallucination_type\n1,a,easy,Yes,One claim,,\n2,a,easy,no,\"Two, claims\",,\n3,a,easy,1,,,\n")
    got = dumps.csv_claims(spark, str(tmp_path / "c.csv")).collect()
    assert [(r["text"], r["label"]) for r in got] == [("One claim", True), ("Two, claims", False)]
    q = spark.createDataFrame([("q", ["a", "b"], ["c", "d", "e", "f"])], "question string, correct array<string>, incorrect array<string>")
    assert [(r["claim"], r["label"]) for r in dumps.question_claims(q).collect()] == [("a", True), ("b", True), ("c", False), ("d", False), ("e", False)]


def test_small_mappings(spark):
    d = spark.createDataFrame([({"world": [1], "hello": [0, 2]}, ["A", "B", "C", "D"], "see 10.1000/xyz123 and 10.1000/xyz123", "<b>a</b> &amp;&quot;")], "i map<string,array<int>>, a array<string>, t string, h string")
    r = d.select(dumps.abstract_from_index(F.col("i")), dumps.authors(F.col("a")), dumps.dois(F.col("t")), dumps.snippet(F.col("h"))).first()
    assert tuple(r) == ("hello world hello", "A, B, C", ["10.1000/xyz123"], 'a &"')


def _stream(spark, tmp_path, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    return spark.readStream.schema(schema).parquet(str(tmp_path / "in"))


def _drain(df, name, mode, tmp_path):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return df.sparkSession.table(name).collect()


def test_token_bucket_stream(spark, tmp_path):
    t0 = dt.datetime(2024, 1, 1)
    rows = [(1, i, t0 + dt.timedelta(seconds=s)) for i, s in enumerate([0, 0, 0, 1, 10])] + [(2, 9, t0)]
    s = _stream(spark, tmp_path, rows, "user_id long, event_id long, ts timestamp")
    got = {r["event_id"]: r["allowed"] for r in _drain(limits.token_bucket(s, "user_id", "ts", 1.0, 2.0, forget=False), "bucket", "append", tmp_path)}
    assert got == {0: True, 1: True, 2: False, 3: True, 4: True, 9: True}


def test_job_stream(spark, tmp_path):
    t0 = dt.datetime(2024, 1, 1)
    rows = [("j", t0 + dt.timedelta(seconds=i), s, p) for i, (s, p) in enumerate([("pending", None), ("running", "claims"), ("done", None), ("error", "late")])]
    s = _stream(spark, tmp_path, rows, "job string, ts timestamp, status string, phase string")
    got = _drain(limits.job_states(s, "job", "ts"), "jobs", "update", tmp_path)
    assert [(r["status"], r["phase"]) for r in got] == [("done", "claims")]


def test_windows_and_redeliveries(spark, tmp_path):
    t0 = dt.datetime(2024, 1, 1)
    rows = [(1, 5, t0), (1, 5, t0 + dt.timedelta(seconds=1)), (1, 6, t0 + dt.timedelta(seconds=90))]
    s = _stream(spark, tmp_path, rows, "run long, batch long, ts timestamp")
    got = _drain(limits.first_deliveries(s, "ts", ["run", "batch"]), "once", "append", tmp_path)
    assert sorted(r["batch"] for r in got) == [5, 6]
    counts = limits.window_counts(s, "run", "ts", limit=1)
    got = _drain(counts, "windows", "complete", tmp_path / "w")
    assert sorted((r["n"], r["over"]) for r in got) == [(1, False), (2, True)]


def test_rejected_rows(spark, tmp_path):
    sink = limits.split_bad("x > 0", str(tmp_path / "good"), str(tmp_path / "bad"))
    for _ in range(2):  # a repeated batch writes the same rows again, once
        sink(spark.createDataFrame([(1,), (-1,), (None,)], "x int"), 0)
    assert spark.read.parquet(str(tmp_path / "good")).count() == 1 and spark.read.parquet(str(tmp_path / "bad")).count() == 2
