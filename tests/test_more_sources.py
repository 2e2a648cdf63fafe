"""Paged sources, sparse search, scores by batches and integrated joints on literal rows."""

import math
import random

import numpy as np
import pytest

from veristrata.operators import inference, search
from veristrata.operators import terms as S
from veristrata.sources import paged
from veristrata.streaming import limits


def test_pages_come_back_whole(spark, tmp_path):
    rows = [(i, None if i % 7 == 0 else f'text "{i}"\n, é 日本 \\', i / 2 if i % 3 else None) for i in range(53)]
    table = spark.createDataFrame(rows, "id long, text string, x double").repartition(3)
    for size in (1, 10, 53, 100):
        folder = f"file://{tmp_path}/{size}"
        n = paged.write_pages(table, "id", size, folder)
        assert n == -(-53 // size)
        got = paged.read_pages(spark, table.schema, folder, n)
        assert sorted(map(tuple, got.collect())) == rows and got.rdd.getNumPartitions() == n
    empty = f"file://{tmp_path}/empty"
    assert paged.write_pages(table.limit(0), "id", 5, empty) == 1 and paged.read_pages(spark, table.schema, empty, 1).count() == 0


def test_a_stream_goes_on_where_it_stopped(spark, tmp_path):
    """Pages that are added later are read once, those before are not read again."""
    table = spark.createDataFrame([(i, f"r{i}") for i in range(30)], "id long, text string")
    folder, out, marks = (f"file://{tmp_path}/{n}" for n in ("pages", "out", "marks"))

    def run():
        paged.stream_pages(spark, table.schema, folder).writeStream.format("parquet").option("path", out).option("checkpointLocation", marks).trigger(availableNow=True).start().awaitTermination()
        return sorted(r["id"] for r in spark.read.schema(table.schema).parquet(out).collect())

    paged.write_pages(table, "id", 5, folder)
    late = tmp_path / "pages" / "4.json"
    kept = late.read_text()
    late.unlink()
    assert run() == list(range(20))
    late.write_text(kept)
    assert run() == list(range(30)) and run() == list(range(30))


@pytest.mark.parametrize("block", [10**6, 40])
def test_sparse_search_equals_all_products(spark, monkeypatch, block):
    """An index that all vectors hold, empty meetings, ties, and several blocks of asked vectors."""
    monkeypatch.setattr(search, "MOST_ENTRIES", block)
    rng = random.Random(1)
    vectors = {v: {0: 1.0, **{rng.randint(1, 30): float(rng.randint(1, 3)) for _ in range(4)}} for v in range(60)} | {60: {99: 1.0}}
    rows = [(v, i, x) for v, own in vectors.items() for i, x in own.items()]
    frame = spark.createDataFrame(rows, "vid long, idx long, value double")
    got = {}
    for r in search.sparse_top(frame.where("vid % 5 = 0").withColumnRenamed("vid", "qid"), frame, 4).collect():
        got.setdefault(r["qid"], []).append((r["rank"], r["vid"], r["score"]))
    for q in range(0, 61, 5):
        scored = sorted(((-sum(x * vectors[v].get(i, 0) for i, x in vectors[q].items()), v) for v in vectors if v != q and set(vectors[v]) & set(vectors[q])))[:4]
        assert sorted(got.get(q, [])) == [(k + 1, v, -s) for k, (s, v) in enumerate(scored)]


def test_scores_by_batches_equal_a_replay(spark, tmp_path):
    """Texts without tokens count, a repeated batch changes nothing, and the vocabulary is cut at one and a half times its size."""
    path = f"file://{tmp_path}/idf"
    batches = [[(1, "a"), (1, "b"), (2, "a"), (3, None)], [(4, "b"), (4, "c"), (5, "d")], [(6, "a"), (6, "e"), (6, "f"), (7, "a")]]
    scores, total, size = {}, 0, 3
    for number, rows in enumerate(batches):
        frame = spark.createDataFrame(rows + rows[:1], "doc long, token string")
        for _ in range(2 if number == 1 else 1):
            limits.batch_idf(frame, number, path, "doc", size)
        total += len({d for d, _ in rows})
        for token in {t for _, t in rows if t}:
            df = len({d for d, t in rows if t == token})
            scores[token] = (df, max(0.0, math.log((total - df + 0.5) / (df + 0.5) + 1)))
        if len(scores) > 1.5 * size:
            scores = dict(sorted(scores.items(), key=lambda x: (-round(x[1][1], 9), x[0]))[:size])
        got = {r["token"]: (r["df"], r["idf"]) for r in spark.read.parquet(f"{path}/version={number}").where("token IS NOT NULL").collect()}
        assert got.keys() == scores.keys() and all(got[t][0] == df and abs(got[t][1] - x) < 1e-12 for t, (df, x) in scores.items())


def test_integrated_joints_equal_closed_forms():
    for a, b in ((0.6, 0.4), (-0.5, 0.3), (0.8, -0.2), (0.1, 0.1)):
        r = np.array([[1, a, 0], [a, 1, b], [0, b, 1.0]])
        assert abs(inference.copula_joint(np.full(3, 0.5), r) - (1 / 8 + (math.asin(a) + math.asin(b)) / 4 / math.pi)) < 1e-4
        assert abs(inference.copula_joint(np.full(2, 0.5), r[:2, :2]) - (1 / 4 + math.asin(a) / 2 / math.pi)) < 1e-4
    same = np.full((8, 8), 0.5) + 0.5 * np.eye(8)
    assert abs(inference.copula_joint(np.full(8, 0.5), same) - 1 / 9) < 1e-4
    p = np.array([0.9, 0.2, 0.6])
    assert abs(inference.copula_joint(p, np.full((3, 3), 0.9999) + 0.0001 * np.eye(3)) - 0.2) < 5e-3  # nearly the same claim
    assert inference.copula_joint(p, np.eye(3)) == pytest.approx(0.108)


def test_nodes_with_terms_and_neighbours(spark):
    nodes = spark.createDataFrame([(1, "alpha beta"), (2, "ALPHABET"), (3, "gamma"), (4, None), (5, "beta gamma alpha")], "id long, text string")
    asked = spark.createDataFrame([("q", "alpha"), ("q", "beta"), ("q", "alpha"), ("p", "gamma"), ("r", "none")], "query string, term string")
    found = S.nodes_with_terms(asked, "query", nodes, "id", "text", 2)
    edges = spark.createDataFrame([(1, 2), (5, 1), (1, 2), (1, 3), (3, 9)], "src long, dst long")
    got = {(r["query"], r["id"]): (r["matched"], r["rank"], r["neighbours"]) for r in S.with_neighbours(found, "id", edges, 2).collect()}
    assert got == {("q", 1): (2, 1, [2, 3]), ("q", 5): (2, 2, [1]), ("p", 3): (1, 1, [1, 9]), ("p", 5): (1, 2, [1])}
