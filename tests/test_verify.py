"""Claims, evidence and inference on literal rows with values worked out by hand."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from veristrata.operators import candidates as C
from veristrata.operators import chunking, inference
from veristrata.operators import claims as L
from veristrata.operators import verify as V
from veristrata.operators import wikitext as W


@pytest.fixture(scope="module")
def claims(spark):
    return spark.createDataFrame([(1, 0, "The violet submarine crossed Lisbon harbour"), (1, 1, "Zzyzx qwertyuiop"), (2, 0, "violet")], "item_id long, ord int, claim string")


@pytest.fixture(scope="module")
def texts(spark):
    far = "filler words everywhere " * 60 + "violet submarine crossed the harbour of Lisbon"
    return spark.createDataFrame([(10, far, "a"), (11, "violet curtains", "a"), (12, "nothing to see", "b")], "doc_id long, text string, source string")


def test_evidence_is_found_anywhere_in_a_text(claims, texts):
    got = {(r["item_id"], r["ord"], r["doc_id"]): r["shared"] for r in V.evidence_pairs(claims, texts, ["item_id", "ord"]).collect()}
    w = lambda df: round(1000 * math.log(1 + 3 / df))
    assert got == {(1, 0, 10): w(2) + 4 * w(1), (1, 0, 11): w(2), (2, 0, 10): w(2), (2, 0, 11): w(2)}


def test_frequent_tokens_still_find_evidence(claims, texts):
    """A corpus a hundred times as large, of which every token is frequent, gives every claim its five texts."""
    many = texts.crossJoin(texts.sparkSession.range(100)).select((F.col("doc_id") + 100 * F.col("id")).alias("doc_id"), "text", "source")
    got = V.evidence_pairs(claims, many, ["item_id", "ord"]).groupBy("item_id", "ord").count().collect()
    assert {(r["item_id"], r["ord"]): r["count"] for r in got} == {(1, 0): 5, (2, 0): 5}


def test_claims_without_evidence_keep_the_prior(claims, texts):
    labels = V.lexical_label(V.evidence_pairs(claims, texts, ["item_id", "ord"]))
    beta = {(r["item_id"], r["ord"]): r for r in V.beta_fold(labels, ["item_id", "ord"], claims).collect()}
    assert len(beta) == 3 and (beta[1, 1]["alpha"], beta[1, 1]["beta"], beta[1, 1]["p_true"], beta[1, 1]["n_evidence"]) == (1.0, 1.0, 0.5, 0)
    logit = {(r["item_id"], r["ord"]): r for r in V.logit_verdicts(labels.withColumn("credibility", F.lit(None).cast("double")), ["item_id", "ord"], claims).collect()}
    assert logit[1, 1]["review"] and abs(logit[1, 1]["p_true"] - 1 / (1 + math.exp(0.25 + 0.2 + 0.3))) < 1e-4


def test_beta_fold_of_four_results(spark):
    rows = [("support", 0.8, 0.1), ("neutral", 0.3, 0.3), ("nli_unavailable", 0.5, 0.5)]
    r = V.beta_fold(spark.createDataFrame([(1, *x) for x in rows], "id int, nli_label string, supporting double, refuting double"), ["id"]).first()
    assert (round(r["alpha"], 9), round(r["beta"], 9), round(r["p_true"], 6)) == (1.8, 1.1, 0.62069)


def test_unary_and_pair_marginals():
    p, settled, name, n, bound = inference.solve(np.zeros((3, 2)), np.zeros((0, 2), dtype=int), np.zeros((0, 2, 2)))
    assert np.allclose(p, 0.5) and settled and abs(bound - 3 * math.log(2)) < 1e-9
    assert abs(inference.solve(np.log([[0.2, 0.8]]), np.zeros((0, 2), dtype=int), np.zeros((0, 2, 2)))[0][0, 1] - 0.8) < 1e-9
    table = np.log([[[0.9, 0.1], [0.1, 0.9]]])
    p = inference.solve(np.log([[0.3, 0.7], [0.5, 0.5]]), np.array([[0, 1]]), table)[0]
    assert (p[:, 1] > 0.5).all() and abs(p[1, 1] - (0.7 * 0.9 + 0.3 * 0.1)) < 1e-3
    assert np.abs(inference.gibbs(np.log([[0.3, 0.7], [0.5, 0.5]]), np.array([[0, 1]]), table, 7) - p[:, 1]).max() < 0.06


def test_log_bound_is_exact_on_a_tree():
    rng = np.random.default_rng(2)
    unary, binary, edges = rng.normal(size=(3, 2)), rng.normal(size=(2, 2, 2)), np.array([[0, 1], [1, 2]])
    p, _, _, m = inference.loopy_belief_propagation(unary, edges, binary, tolerance=1e-10)
    exact = math.log(sum(math.exp(unary[0, a] + unary[1, b] + unary[2, c] + binary[0, a, b] + binary[1, b, c]) for a in (0, 1) for b in (0, 1) for c in (0, 1)))
    assert abs(inference.log_bound(unary, edges, binary, p, m, np.ones(2)) - exact) < 1e-6


def test_copula():
    p = np.array([0.6, 0.7])
    assert inference.copula_joint(p, np.eye(2)) == pytest.approx(0.42) and inference.copula_joint(p[:1], np.eye(1)) == 0.6
    high, low = (inference.copula_joint(p, np.array([[1.0, r], [r, 1.0]]), 40_000) for r in (0.95, -0.95))
    assert 0.55 < high <= 0.61 and 0.29 < low < 0.35
    m = inference.nearest_correlation(np.array([[1, 0.9, -0.9], [0.9, 1, 0.9], [-0.9, 0.9, 1.0]]))
    assert np.linalg.eigvalsh(m).min() > 0 and np.allclose(np.diag(m), 1)


def test_passages_and_claim_chunks():
    text = " ".join(f"Sentence number {i} says a little about thing {i}." for i in range(200))
    own = chunking.passages(text)
    assert all(text[a:].startswith(c.split(".")[0]) for a, c in own) and {s for _, c in own for s in c.split(". ")} >= {f"Sentence number {i} says a little about thing {i}" for i in range(199)}
    slices = chunking.claim_chunks(text, 200, 20)
    assert all(text[a : a + len(c)] == c and len(c) <= 800 for a, c in slices) and slices[-1][0] + len(slices[-1][1]) == len(text)


def test_wikitext_sections_and_infobox(spark):
    wiki = "{{Infobox Scientist\n| name = [[Marie|M.]] {{x|{{y}}}} Curie\n| birth-date1 = 1867 | birth-date2 = 1868\n| empty =\n}}Lead text.\n== Legacy ==\nAbout [[Radium]].\n=== Deep ===\nx\n== References ==\ny"
    kind, p = W.infobox(F.col("w"))
    r = spark.createDataFrame([(wiki,), ("plain",)], "w string").select(W.sections(F.col("w")).alias("s"), W.telling_sections(F.col("w")).alias("t"), kind.alias("k"), p.alias("p"), W.first_paragraph(F.col("w")).alias("f")).collect()
    assert [(x["title"], x["level"]) for x in r[0]["s"]] == [("Introduction", 1), ("Legacy", 2), ("Deep", 3), ("References", 2)]
    assert [x["title"] for x in r[0]["t"]] == ["Introduction", "Legacy", "Deep"] and r[0]["s"][1]["content"] == "About [[Radium]]."
    assert r[0]["k"] == "Scientist" and r[0]["p"] == {"name": "Marie  Curie", "birth_date": "1867 | 1868"} and r[0]["f"] == "Lead text."
    assert [tuple(x) for x in r[1]["s"]] == [("Introduction", 1, "plain")] and r[1]["k"] is None and r[1]["p"] is None


def test_answers_that_are_cut_off_or_empty(spark):
    rows = [(1, "```json\n{\"claims\": [{\"text\": \"A b.\"}]}", "x A B."), (2, "{\"claims\": \"no list\"}", "A sentence of its own. Short."), (3, "[{\"text\": \" \"}, {\"claim_type\": \"causal\", \"text\": \"c\"}]", "d"), (4, None, None)]
    got = [(r["id"], r["claim"], r["claim_type"], r["lo"], r["hi"]) for r in L.parse_claims(spark.createDataFrame(rows, "id int, answer string, text string"), ["id"]).orderBy("id", "ord").collect()]
    assert got == [(1, "A b.", "unclassified", 2, 6), (2, "A sentence of its own.", "unclassified", 0, 22), (3, "c", "causal", None, None)]


def test_article_chunks_hold_whole_sentences_and_their_section():
    first, second = (" ".join(f"{w} sentence {i} is here for size." for i in range(20)) for w in ("Early", "Late"))
    raw, plain = f"{first}\n== Later ==\n{second}", f"{first} {second}"
    own = chunking.article_chunks(raw, plain)  # one sentence fits into the overlap: its space is not counted
    assert all(plain[a - (a > 0) :].startswith(t[:20]) and len(t) <= 512 + 64 for a, _, _, t in own)
    # the middles 247 and 720 of 1399 lie at 251 and 731 of the 1422 raw characters; the header stands at 709
    assert [(a, b, s) for a, b, s, _ in own] == [(0, 494, "Introduction"), (459, 982, "Later"), (949, 1400, "Later")]
    assert all(s in " ".join(t for *_, t in own) for s in plain.split(". ")[:-1])
    assert chunking.article_chunks("x", "Too short. It is.") == [] and chunking.article_chunks("", "") == []


def test_first_tree_stays_in_its_component():
    edges = np.array([[0, 1], [1, 2], [0, 2], [3, 4]])
    assert inference.first_tree(5, edges, np.array([0.2, 0.9, 0.2, 1.0])) == [0, 1]
    assert inference.first_tree(1, np.zeros((0, 2), dtype=int), np.zeros(0)) == []


def test_candidates_of_odd_texts(spark):
    rows = [("The great Marie Curie (Warsaw) discovered radium.",), ("",), (None,), ("is what",), ("The a der is it",)]
    got = spark.createDataFrame(rows, "t string").select(C.named_candidates(F.col("t")), C.subject_guess(F.col("t"))).collect()
    assert [tuple(r) for r in got] == [(["Marie Curie Warsaw"], "great Marie Curie Warsaw"), ([], ""), ([], ""), ([], ""), ([], "")]


def test_false_variants_only_where_too_few_are_false(spark):
    few = spark.createDataFrame([(i, f"It is {i} years old in 1990", i > 0) for i in range(10)], "id long, text string, label boolean")
    got = {r["id"]: r for r in C.with_false_variants(few).collect()}
    made = [r for r in got.values() if r["id"] < 0]
    assert len(made) == 5 and all(not r["label"] and r["text"] != got[-r["id"] - 1]["text"] for r in made if r["kind"] != "synthetic")
    assert C.with_false_variants(few.withColumn("label", F.col("id") > 5)).count() == 10 and C.with_false_variants(few.limit(0)).count() == 0


def test_documents_sampled_side_by_side():
    """Graphs of any size and shape (hubs, repeated edges, none) draw and sum as each one alone does."""
    rng, graphs = np.random.default_rng(3), []
    for k in range(25):
        n = int(rng.integers(1, 15))
        e = np.array([sorted(rng.choice(n, 2, replace=False)) for _ in range(int(rng.integers(0, 2 * n)))] if n > 1 else [], dtype=int).reshape(-1, 2)
        if k == 7:
            n, e = 40, np.array([(0, i) for i in range(1, 40)])
        same, other = rng.normal(size=(2, len(e)))
        graphs.append((rng.normal(size=(n, 2)), e, np.stack([np.stack([same, other], 1), np.stack([other, same], 1)], 1)))
    starts = np.cumsum([0] + [len(u) for u, _, _ in graphs])
    alone = [inference.gibbs(*g, seed=i, burn=20, sweeps=90) for i, g in enumerate(graphs)]
    whole = [np.concatenate([g[0] for g in graphs]), np.concatenate([g[1] + s for g, s in zip(graphs, starts)]), np.concatenate([g[2] for g in graphs])]
    assert np.array_equal(inference.gibbs_together(*whole, starts, list(range(25)), 20, 90), np.concatenate(alone))


def test_equal_joints_are_integrated_once(monkeypatch):
    """Arrays of normal probabilities equal the scalar function, and a problem that comes again is not integrated again."""
    z = np.linspace(-37, 9, 5_001)
    assert np.allclose(inference._below(z), [0.5 * math.erfc(-x / math.sqrt(2)) for x in z], rtol=1e-12, atol=0)
    asked, real = [], inference.integrated_joint
    monkeypatch.setattr(inference, "integrated_joint", lambda *a: asked.append(1) or real(*a))
    r = np.array([[1.0, 0.123], [0.123, 1.0]])
    assert len({inference.copula_joint(np.array([0.41, 0.52]), r) for _ in range(5)}) == 1 and len(asked) == 1
