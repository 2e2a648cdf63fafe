"""Belief propagation by rounds over a message table against the grouped solver, and its search for evidence by bounds."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from veristrata.operators import inference, propagation
from veristrata.operators import verify as V

NODES, PAIRS = "doc string, claim string, log_false double, log_true double", "doc string, a string, b string, log_same double, log_other double"


def graphs(rng, n_docs, n_claims, n_pairs, scale):
    nodes, pairs = [], []
    for d in range(n_docs):
        own = [f"c{i:02d}" for i in range(n_claims)]
        nodes += [(f"d{d}", c, *map(float, rng.normal(size=2))) for c in own]
        for _ in range(n_pairs):
            a, b = rng.choice(own, 2, replace=False)
            pairs.append((f"d{d}", str(a), str(b), *map(float, scale * rng.normal(size=2))))
    return nodes, pairs


def check_same(spark, nodes, pairs, rigor, limit, **how):
    left, right = spark.createDataFrame(nodes, NODES), spark.createDataFrame(pairs, PAIRS)
    wanted = {(r["doc"], r["claim"]): r for r in inference.infer(left, right, rigor).collect()}
    got = {(r["doc"], r["claim"]): r for r in propagation.infer(left, right, rigor, limit=limit, **how).collect()}
    assert got.keys() == wanted.keys()
    for k, w in wanted.items():
        g = got[k]
        assert [g[c] for c in ("converged", "algorithm", "iterations", "edge_count")] == [w[c] for c in ("converged", "algorithm", "iterations", "edge_count")], k
        assert abs(g["p_true"] - w["p_true"]) < 1e-8
        assert (g["log_bound"] is None) == (w["log_bound"] is None or np.isnan(w["log_bound"])) and (g["log_bound"] is None or abs(g["log_bound"] - w["log_bound"]) < 1e-6)


@pytest.mark.parametrize("rigor", ["balanced", "fast"])
def test_rounds_equal_the_grouped_solver(spark, rigor):
    """Loopy graphs, repeated pairs, claims without factors, documents without pairs, pairs of unknown claims."""
    rng = np.random.default_rng(4)
    nodes, pairs = graphs(rng, 5, 7, 9, 0.7)
    nodes += [("alone", "x", 0.5, 1.5), ("alone", "y", 0.0, 0.0)]
    pairs += [("d0", "c00", "unknown", 1.0, 0.0), ("d0", "c01", "c01", 1.0, 0.0), ("other", "x", "y", 1.0, 0.0)]
    check_same(spark, nodes, pairs, rigor, propagation.FACTORS)


def test_rounds_by_joins_equal_the_grouped_solver(spark, monkeypatch):
    """The same with documents taken as too large for a task, and a claim taken as a hub."""
    monkeypatch.setattr(propagation, "HUB", 3)
    nodes, pairs = graphs(np.random.default_rng(9), 2, 6, 7, 0.5)
    nodes.append(("d0", "c99", 0.1, 0.3))
    check_same(spark, nodes, pairs, "balanced", 0)


def test_forests_are_the_strongest(spark):
    rng = np.random.default_rng(3)
    rows = [("d", *sorted(map(int, rng.choice(12, 2, replace=False))), float(rng.integers(1, 6))) for _ in range(30)] + [("e", 20, 21, 1.0)]
    edges = spark.createDataFrame([(d, f"{a:02d}", f"{b:02d}", i, w, 0.0) for i, (d, a, b, w) in enumerate(rows)], "doc string, a string, b string, k int, same double, other double")
    got = {(r["doc"], r["a"], r["b"], r["k"]) for r in propagation.forest(edges, [-propagation._strength()]).collect()}
    up, wanted = {}, set()

    def root(x):
        while up.get(x, x) != x:
            x = up[x]
        return x

    for i, (d, a, b, w) in sorted(enumerate(rows), key=lambda x: (-x[1][3], x[1][1:3], x[0])):
        if root((d, a)) != root((d, b)):
            up[root((d, a))] = root((d, b))
            wanted.add((d, f"{a:02d}", f"{b:02d}", i))
    assert got == wanted
    small, large = ({tuple(r[:4]): r["rho"] for r in propagation.tree_weights(edges, by_joins).select(*propagation.EDGE, "rho").collect()} for by_joins in (False, True))
    assert small == large and set(small.values()) <= {0.25, 0.5, 1.0}


def test_odd_graphs(spark):
    nodes = spark.createDataFrame([("a", "x", 0.0, 1.0), (None, "x", 0.0, 1.0), ("a", None, 0.0, 1.0)], NODES)
    none = spark.createDataFrame([], PAIRS)
    assert [(r["claim"], round(r["p_true"], 6), r["algorithm"], round(r["log_bound"], 6)) for r in propagation.infer(nodes, none).collect()] == [("x", 0.731059, "unary", 1.313262)]
    assert propagation.infer(nodes.limit(0), none).count() == 0


def test_bounds_prune_the_evidence_search(spark):
    """The claims' prefixes reach a tenth of the rows that all tokens reach, and the best texts stay the same."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text", "source").repartition(8)
    claims = V.claims(spark.read.parquet("/root/testdata/sf0.1/benchmark.parquet"), "item_id")
    keys = ["item_id", "ord"]
    weighted, hits = V.claim_tokens(claims, docs, keys)
    tokens, _ = V.prefix_tokens(weighted, hits, keys, 5)
    whole, near = tokens.agg(F.sum("df"), F.sum(F.when(F.col("prefix"), F.col("df")))).first()
    assert near < whole / 10
    plain = V._best(V._sums(weighted, hits, keys), keys, 5)
    got = V.best_texts(claims, docs, keys)
    assert sorted(map(tuple, got.select(plain.columns).collect())) == sorted(map(tuple, plain.collect()))


def test_ranks_told_in_blocks_and_by_shuffle(spark, monkeypatch):
    """Blocks of three ranks, and graphs above the bound, against plain rounds; unknown ends, repeated edges and loose nodes."""
    from veristrata.operators import graph as G

    ids = [f"n{i}" for i in range(11)]
    links = [(ids[i % 9], ids[(i * i + 1) % 11]) for i in range(25)] + [("n1", "gone"), ("gone", "n2"), ("n3", "n4"), ("n3", "n4")]
    rank = dict.fromkeys(ids, 1 / 11)
    for _ in range(7):
        given = dict.fromkeys(ids, 0.0)
        for a, b in links:
            if a in rank and b in given:
                given[b] += rank[a] / sum(x == a for x, _ in links)
        rank = {i: 0.15 / 11 + 0.85 * given[i] for i in ids}
    nodes, edges = spark.createDataFrame([(i,) for i in ids], "id string"), spark.createDataFrame(links, "src string, dst string")
    monkeypatch.setattr(G, "BLOCK", 3)
    for most in (100, 0):
        monkeypatch.setattr(G, "MOST_RANKS", most)
        got = {r["id"]: r["rank"] for r in G.pagerank(nodes, edges, 7, every=3).collect()}
        assert set(got) == set(rank) and all(abs(got[i] - rank[i]) < 1e-12 for i in ids)
