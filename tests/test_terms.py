"""Terms in texts, filter chains, redirect chains and paths against plain Python."""

import random
import re

import pytest
from pyspark.sql import functions as F

from veristrata.operators import graph as G
from veristrata.operators import terms as S

TERMS = ["bad word", "bad", "Evil", "c++", "x", "über", " ", "very bad word", "a-b", "word"]


def texts():
    rng = random.Random(3)
    odd = [None, "", "bad", "Badly", "a bad wording", "bad word", "very bad word", "EVIL!", "c++", "c++x", "xc++x", "ax", "_x", "x y", "Über alles", "a-b c", "za-b", "medieval"]
    return list(enumerate(odd + ["".join(rng.choice(["bad", "word", " ", "-", "x", "evil", "+", "é", "_", "very ", "a-b"]) for _ in range(rng.randint(1, 30))) for _ in range(300)] + ["no " * 200_000 + "evil"]))


@pytest.mark.parametrize("block", [100_000, 3])
def test_first_terms_stand_alone(spark, monkeypatch, block):
    """As a pattern of all terms between word edges finds them; also with more terms than one block holds."""
    monkeypatch.setattr(S, "MOST_TERMS", block)
    terms = spark.createDataFrame([(t,) for t in [*TERMS, None, "BAD"]], "term string")
    got = {r["i"]: r["term"] for r in S.first_term(spark.createDataFrame(texts(), "i int, text string"), "text", terms).select("i", "term").collect()}
    known = [t.lower() for t in TERMS if t.strip()]
    for i, text in texts():
        text = (text or "").lower()
        found = [(m.start(), -len(t), t) for t in known for m in re.finditer(rf"(?=\b{re.escape(t)}\b)", text)]
        assert got[i] == (min(found)[2] if found else None), (text, found)
    assert S.first_term(spark.createDataFrame(texts(), "i int, text string"), "text", terms.limit(0)).where("term IS NOT NULL").count() == 0


def test_best_texts_of_words(spark):
    rng = random.Random(4)
    words = ["alpha", "beta", "gamma", "the", "delta", "epsilon"]
    docs = [(i, None if i == 7 else " ".join(rng.choices(words, k=rng.randint(0, 4))), rng.choice([0.1, 0.5, 0.9, None])) for i in range(400)]
    asked = [(1, "Alpha beta"), (2, "  the a an is of alpha"), (3, "GAMMA gamma the x delta beta"), (4, None), (5, "nothing"), (6, "lpha")]
    got = {}
    for r in S.best_with_words(spark.createDataFrame(asked, "qid int, query string"), spark.createDataFrame(docs, "tid int, text string, similarity double")).collect():
        got.setdefault(r["qid"], []).append((r["rank"], r["tid"]))
    for q, query in asked:
        own = [w.lower() for w in (query or "").split()[:5] if len(w) > 3]
        hits = sorted((d for d in docs if d[1] is not None and any(w in d[1] for w in own)), key=lambda d: (-(d[2] if d[2] is not None else -1), d[0]))[:5]
        assert sorted(got.get(q, [])) == [(k + 1, d[0]) for k, d in enumerate(hits)]


def test_chain_decides_in_order(spark):
    rows = [
        (1, "fine", None, None, "allow", None, "fine"), (2, "evil", '{"harmful": true}', None, "reject", "blacklist", "evil"), (3, "x y", '{"harmful": true}', '{"action": "EXTRACT_CLAIM", "claim": "c"}', "reject", "harm", "x y"),
        (4, "q?", "broken {", '```json\n{"action": "extract_claim", "claim": " The claim. "}\n```', "rewrite", "claim", "The claim."), (5, "q?", '{"harmful": false}', '{"action": "EXTRACT_CLAIM"}', "reject", "claim", "q?"),
        (6, "q", "", '{"action": "REJECT_NO_CLAIM"}', "reject", "claim", "q"), (7, None, "[]", '{"action": 5}', "allow", None, None),
    ]
    d = spark.createDataFrame([r[:4] for r in rows], "i int, text string, harm string, claim string")
    d = S.first_term(d, "text", spark.createDataFrame([("evil",)], "term string"))
    got = S.run_chain(d, "text", [S.blacklist_step(), S.harm_step(F.col("harm")), S.claim_step(F.col("claim"))]).collect()
    assert sorted((r["i"], r["action"], r["stage"], r["final_text"]) for r in got) == [(r[0], *r[4:]) for r in rows]
    assert {r["i"]: r["status"] for r in got} == {1: None, 2: 403, 3: 403, 4: None, 5: 422, 6: 422, 7: None}


def test_chains_of_any_length(spark, monkeypatch):
    """Long chains, cycles with tails, self-links and a target of very many."""
    monkeypatch.setattr(G, "HOT", 20)
    rows = [(i, i + 1) for i in range(100)] + [(200, 201), (201, 202), (202, 200), (210, 200), (300, 300)] + [(1000 + i, 50) for i in range(60)] + [(400, 500)]
    to = dict(rows)
    wanted = {}
    for s in to:
        at, n, seen = s, 0, set()
        while at in to and at not in seen:
            seen.add(at)
            at, n = to[at], n + 1
        wanted[s] = (None, None) if at in to else (at, n)
    frame = spark.createDataFrame(rows, "src long, dst long")
    assert {r["src"]: (r["dst"], r["hops"]) for r in G.follow_redirects(frame).collect()} == wanted
    assert G.follow_redirects(frame.limit(0)).count() == 0


def test_paths_of_any_length(spark):
    rng = random.Random(6)
    rows = [(f"n{rng.randint(0, 9)}", f"n{rng.randint(0, 9)}", rng.choice("ab")) for _ in range(16)]
    near = [(a, b, t) for a, b, t in rows] + [(b, a, t) for a, b, t in rows]
    for source, target in (("n1", "n2"), ("n0", "n9"), ("n3", "n3"), ("n1", "none")):
        wanted, todo = [], [([source], [])]
        while todo:
            nodes, types = todo.pop()
            if nodes[-1] == target and types:
                wanted.append((len(types), ">".join(nodes[1:-1]), ">".join(types)))
            elif len(types) < 5:
                todo += [([*nodes, b], [*types, t]) for a, b, t in near if a == nodes[-1] and b not in nodes]
        got = G.paths(spark.createDataFrame(rows, "src string, dst string, type string"), source, target, 5, 10_000)
        assert sorted(tuple(r) for r in got.collect()) == sorted(wanted)


def test_texts_are_read_in_slices(monkeypatch):
    """No slice of several texts holds more than its bytes; null, empty and long texts keep their places."""
    import pyarrow as pa

    from veristrata.operators import chunking

    monkeypatch.setattr(chunking, "SLICE_BYTES", 10)
    texts = ["abc", None, "", "é" * 30, "defg", "hijklm", "n" * 10, None]
    parts = [p.to_pylist() for p in chunking.text_slices(pa.array(texts))]
    assert [t for p in parts for t in p] == texts
    assert all(len(p) == 1 or sum(len((t or "").encode()) for t in p) <= 10 for p in parts) and len(parts) > 3
    assert list(chunking.text_slices(pa.array([], pa.string()))) == []


def test_vectors_with_told_scores_of_common_tokens(spark):
    """Tokens left out of the told scores count as those of one text do: the same sums as with all scores."""
    from veristrata.operators import corpus as C

    counts = C.term_counts(spark.createDataFrame([(1, "alpha beta beta gamma"), (2, "alpha delta"), (3, "beta"), (4, None)], "doc int, text string").repartition("doc"), "doc")
    idf = C.bm25_idf(counts, "doc", 4)
    sums = lambda v: {(r["doc"], r["idx"]): round(r["value"], 9) for r in v.collect()}
    once = idf.where("df = 1").first()["idf"]
    told = C.sparse_vectors(C.bm25_tf(counts), idf.where("df > 1"), "doc", without=once, told=True)
    assert sums(told) == sums(C.sparse_vectors(C.bm25_tf(counts), idf, "doc")) and len(sums(told)) == 6
