"""Literal fixtures of the text functions, scores and solvers."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from veristrata.functions import text as T
from veristrata.operators import corpus, graph, inference, metrics, verify


def one(spark, column, *values):
    df = spark.createDataFrame([(v,) for v in values], "x string")
    return [r[0] for r in df.select(column.alias("y")).collect()]


@pytest.mark.parametrize(
    ("text", "iso"),
    [("born March 14, 1879 in Ulm", "1879-03-14"), ("14 March 1879", "1879-03-14"), ("March 1879", "1879-03"), ("in 1879", "1879"), ("1879-03-14", "1879-03-14"), ("no date", None), ("42 million dollars", None), ("February 30, 2020", "2020"), ("Sept. 5, 1999", "1999-09-05"), (None, None), ("", None)],
)
def test_dates(spark, text, iso):
    assert one(spark, T.date_iso(F.col("x")), text) == [iso]


@pytest.mark.parametrize(("text", "value"), [("5%", 0.05), ("5 per cent", 0.05), ("3.5 billion", 3.5e9), ("1k", 1000.0), ("-2.5", -2.5), ("about 7 apples", 7.0), ("none", None), (None, None), ("5 mb", 5.0)])
def test_numbers(spark, text, value):
    assert one(spark, T.number_si(F.col("x")), text) == [value]


def test_claim_forms(spark):
    assert one(spark, T.claim_norm(F.col("x")), "  A  Sentence. ", "x", None, "Why?!") == ["a sentence", "x", None, "why?"]
    assert one(spark, T.worker_claims(F.col("x"), 2), "First sentence here. - Second one is here! Third is last.") == [["First sentence here.", "Second one is here!"]]
    assert one(spark, T.worker_claims(F.col("x"), 2), "short") == [["short"]]


def test_hash_token_is_md5_modulo(spark):
    import hashlib

    words = ["radium", "a", "physics", "é"]
    assert one(spark, T.hash_token(F.col("x")), *words) == [int(hashlib.md5(w.encode()).hexdigest(), 16) % 50_000 for w in words]


def test_beta_fold_and_product(spark):
    rows = [("c", "support", 0.8, 0.1), ("c", "neutral", 0.3, 0.3), ("c", "nli_unavailable", 0.9, 0.0)]
    got = verify.beta_fold(spark.createDataFrame(rows, "claim string, nli_label string, supporting double, refuting double"), ["claim"]).first()
    assert (got["alpha"], got["beta"]) == (1.8, 1.1) and round(got["p_true"], 6) == 0.62069
    p = spark.createDataFrame([("a", 1.0), ("b", 1.0), ("b", 0.5)], "d string, p_true double")
    out = {r["d"]: r["doc_score"] for r in verify.doc_product(p, ["d"]).collect()}
    assert out["a"] == 1.0 and abs(out["b"] - 0.5 * (1 - 1e-6)) < 1e-9


def test_opinions(spark):
    s = "struct<label:string,confidence:double,supporting:double,refuting:double,neutral:double,relevance:double>"
    yes, no = ("support", 0.8, 0.8, 0.1, 0.1, 0.9), ("refute", 0.6, 0.2, 0.7, 0.1, 0.5)
    df = spark.createDataFrame([(1, yes, yes), (2, yes, no), (3, yes, None), (4, None, None)], f"id int, a {s}, b {s}")
    got = {r["id"]: r for r in verify.combine_opinions(df).collect()}
    assert got[1]["label"] == "support" and got[1]["confidence"] == 0.8
    assert got[2]["label"] == "refute" and abs(got[2]["refuting"] - 0.49) < 1e-9 and got[2]["relevance"] == 0.5
    assert abs(got[3]["supporting"] - 0.68) < 1e-9 and got[4]["label"] is None


def test_wikitext_and_links(spark):
    text = "'''Radium''' is {{a|{{b}}}} in [[physics|Physics]] and [[File:x.png]].<ref>x</ref>\n* item"
    assert one(spark, corpus.clean_wikitext(F.col("x")), text) == ["Radium is in Physics and . item"]
    assert one(spark, corpus.wikilinks(F.col("x")), "[[Radium]] [[Category:X]] [[Marie_Curie#Life|her]] [[Radium]] [[:File:y]]") == [["Radium", "Marie Curie"]]


def test_mentions(spark):
    p = spark.createDataFrame([("p", "Q1", ["Radium", "Self", "Physics", "Radium"])], "passage_id string, qid string, mentions array<string>")
    t = spark.createDataFrame([("Radium", "Q2", 1), ("Self", "Q1", 1), ("Physics", "Q3", 1), ("Radium", "Q9", 2)], "title string, qid string, ord int")
    assert corpus.resolve_mentions(p, t).first()["mention_qids"] == ["Q2", "Q3"]


def test_conformal_small_strata_have_no_quantile(spark):
    rows = [("a", i / 100) for i in range(49)] + [("b", i / 100) for i in range(60)]
    got = {r["k"]: r["quantile"] for r in metrics.conformal_quantiles(spark.createDataFrame(rows, "k string, s double"), ["k"], "s").collect()}
    assert got["a"] is None and got["b"] == 0.54


def test_propagation():
    p, settled, _, _ = inference.loopy_belief_propagation(np.log(np.array([[0.5, 0.5], [0.5, 0.5]])), np.zeros((0, 2), int), np.zeros((0, 2, 2)))
    assert settled and np.allclose(p, 0.5)
    unary = np.log(np.array([[0.2, 0.8], [0.5, 0.5], [0.6, 0.4]]))
    edges, b = np.array([[0, 1], [1, 2]]), np.log(np.array([[[0.9, 0.1], [0.1, 0.9]]] * 2))
    exact = np.zeros((3, 2))
    for x in np.ndindex(2, 2, 2):
        w = np.exp(sum(unary[i, x[i]] for i in range(3)) + b[0, x[0], x[1]] + b[1, x[1], x[2]])
        for i in range(3):
            exact[i, x[i]] += w
    exact /= exact.sum(1, keepdims=True)
    for rho in (None, np.ones(2)):
        p, settled, _, _ = inference.loopy_belief_propagation(unary, edges, b, tolerance=1e-9, rho=rho)
        assert settled and np.allclose(p, exact, atol=1e-6)
    p, settled, name, _, bound = inference.solve(unary, edges, b)
    total = np.log(sum(np.exp(sum(unary[i, x[i]] for i in range(3)) + b[0, x[0], x[1]] + b[1, x[1], x[2]]) for x in np.ndindex(2, 2, 2)))
    assert settled and name == "trw_bp" and abs(bound - total) < 1e-3
    assert np.abs(inference.gibbs(unary, edges, b, inference.seed_of(["a", "b"]))[0] - exact[0, 1]) < 0.05


def test_near_pairs_equal_brute_force(spark):
    rng = np.random.default_rng(3)
    pts = [(i, float(a), float(o)) for i, (a, o) in enumerate(zip(rng.uniform(-89, 89, 300), rng.uniform(-180, 180, 300), strict=True))]
    df = spark.createDataFrame(pts, "id long, lat double, lon double")
    got = {(r["a"], r["b"]) for r in graph.near_pairs(df, 700.0).collect()}
    from math import asin, cos, radians, sin, sqrt

    def km(p, q):
        h = sin((radians(q[1]) - radians(p[1])) / 2) ** 2 + cos(radians(p[1])) * cos(radians(q[1])) * sin(radians(q[2] - p[2]) / 2) ** 2
        return 2 * 6371 * asin(min(1, sqrt(h)))

    assert got == {(p[0], q[0]) for p in pts for q in pts if p[0] < q[0] and km(p, q) < 700}


def test_running_sums_equal_windows(spark):
    import random

    from pyspark.sql import functions as F
    from pyspark.sql.window import Window

    from veristrata.operators import metrics
    from veristrata.session import numbered, running

    rng = random.Random(1)
    df = spark.createDataFrame([(None if i % 9 == 0 else "hot" if i % 3 else f"k{i % 5}", rng.randint(0, 50), i) for i in range(3000)], "k string, v long, i long")
    w = Window.partitionBy("k").orderBy(F.desc("v"), "i").rowsBetween(Window.unboundedPreceding, 0)
    wanted = df.select("k", "v", "i", F.count("*").over(Window.partitionBy("k")).alias("total"), F.count("*").over(w).alias("n"), F.sum("v").over(w).alias("s"))
    got = running(df, ["k"], [F.desc("v"), F.asc("i")], {"n": F.lit(1), "s": F.col("v")})
    assert got.exceptAll(wanted).count() == 0 and got.count() == 3000
    share = df.select("k", "v", "i", F.cume_dist().over(Window.partitionBy("k").orderBy("v")).alias("ecdf"))
    assert metrics.ecdf(df, ["k"], "v").select("k", "v", "i", "ecdf").exceptAll(share).count() == 0
    assert {(r["i"], r["place"]) for r in numbered(df, "i").collect()} == {(i, i) for i in range(3000)}
