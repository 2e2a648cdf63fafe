"""The vector index against a comparison with all vectors."""

import numpy as np
import pytest

from veristrata.operators import search as S
from veristrata.operators import vector_index as I


def vectors(spark, rng, n, dims, centers, spread):
    at = rng.normal(size=(centers, dims))
    rows = [(i, [float(x) for x in at[i % centers] + spread * rng.normal(size=dims)]) for i in range(n)]
    rows += [(n, [0.0] * dims), (n + 1, [0.0] * dims), (n + 2, None), (n + 3, rows[5][1]), (n + 4, rows[5][1])]
    return spark.createDataFrame(rows, "vid long, vec array<double>")


@pytest.mark.parametrize(("spread", "most_read"), [(0.05, 0.4), (3.0, 1.0)])
def test_index_gives_the_exact_neighbours(spark, spread, most_read):
    """Clustered vectors, where most lists stay unread, and vectors without structure; zero, null and repeated ones."""
    rng = np.random.default_rng(2)
    corpus = vectors(spark, rng, 600, 8, 12, spread)
    queries = corpus.where("vid % 20 = 0 OR vid >= 600").selectExpr("vid AS qid", "vec AS qvec")
    centers = I.fit_centroids(corpus, sample=300)
    index = I.build(corpus, centers)
    assert index.count() == corpus.where("vec IS NOT NULL").count() and abs(np.linalg.norm(centers, axis=1) - 1).max() < 1e-9
    hits, read = I.search(index, centers, queries, 7)
    plain = S.knn(queries.where("qvec IS NOT NULL"), corpus.where("vec IS NOT NULL"), 7)
    told = lambda df: sorted((r["qid"], r["rank"], r["vid"], round(r["score"], 9)) for r in df.collect())
    assert told(hits) == told(plain)
    seen = [r["compared"] for r in read.where("qid < 600").collect()]
    assert np.mean(seen) / 604 <= most_read


def test_index_of_odd_tables(spark, monkeypatch):
    monkeypatch.setattr(I, "MOST_QUERIES", 10)
    rng = np.random.default_rng(3)
    corpus = vectors(spark, rng, 30, 4, 3, 0.3)
    few = corpus.where("vid < 3 OR vid = 30")
    centers = I.fit_centroids(few, lists=50)
    hits, _ = I.search(I.build(few, centers), centers, corpus.selectExpr("vid AS qid", "vec AS qvec"), 5)  # several blocks, fewer than k
    plain = S.knn(corpus.where("vec IS NOT NULL").selectExpr("vid AS qid", "vec AS qvec"), few, 5)
    told = lambda df: sorted((r["qid"], r["rank"], r["vid"]) for r in df.collect())
    assert told(hits) == told(plain)
    for empty in (few.limit(0), corpus.where("vid = 30")):
        centers = I.fit_centroids(empty)
        hits, _ = I.search(I.build(empty, centers), centers, few.selectExpr("vid AS qid", "vec AS qvec"), 5)
        assert hits.count() == 3 * empty.count()


def test_lists_hand_on_a_querys_best_only(spark):
    """A list's scores stay in its tasks: few rows are written for a query, whatever the lists' sizes."""
    rng = np.random.default_rng(5)
    corpus = vectors(spark, rng, 500, 6, 4, 0.2).where("vid < 500").repartition(2)
    queries = corpus.where("vid < 20").selectExpr("vid AS qid", "vec AS qvec")
    centers = I.fit_centroids(corpus, lists=4)
    index = I.build(corpus, centers).coalesce(1)
    read = I._read_lists(index, queries, centers, 3, True)
    assert read.where("vid IS NOT NULL").count() == 20 * 3 and read.where("compared IS NOT NULL").count() == 20
