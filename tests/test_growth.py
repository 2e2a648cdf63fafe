"""Steps that must not grow faster than their tables, and results on odd rows."""

import contextlib
import io
import math
import random

from veristrata.functions import text as T
from veristrata.operators import candidates as C
from veristrata.operators import graph as G
from veristrata.operators import inference as I
from veristrata.plans import registry

registry.load()
DATA = "/root/testdata/sf0.001"


def plan(df) -> str:
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain()
    return out.getvalue()


def test_domain_words_end_at_letters_of_other_scripts(spark):
    df = spark.createDataFrame([(0, "\xf1dollar ci\xf3ngar"), (1, "adollar"), (2, "bank\xe9 BANK"), (3, "Kubernetes")], "i long, text string")
    domain, _ = T.domain_route(df["text"])
    assert [r[0] for r in df.orderBy("i").select(domain.alias("d")).collect()] == ["economic", "general", "economic", "general"]


def test_all_rows_that_pass_come_back(spark):
    got = registry.QUERIES["filt_enhanced"](spark, DATA)
    d = spark.read.parquet(f"{DATA}/documents.parquet").where("n_chars >= 200 AND doc_id % 7 <> 0 AND doc_id % 13 <> 0 AND (lang = 'en' OR source = 'src1')")
    assert got.count() == d.count() > 5


def test_chosen_cases_have_the_smallest_draws(spark):
    cases = spark.range(3000).selectExpr("id", "concat('text ', id) AS text", "id % 5 <> 0 AS label")
    order = [r["id"] for r in cases.where("label").orderBy(C.draw(cases["id"], "case"), "id").select("id").collect()]
    for n in (1, 700, 2400):
        chosen = C._smallest_draws(cases.where("label"), n)
        assert sorted(r["id"] for r in chosen.collect()) == sorted(order[:n])
    ordered = [line for line in plan(C.with_false_variants(cases)).splitlines() if "TakeOrdered" in line]
    assert not any("text" in line for line in ordered)


def test_trees_take_documents_by_the_batch(spark):
    pairs = spark.createDataFrame([(d, 10 * d + a, 10 * d + b, float(s)) for d in range(3) for a, b, s in ((0, 1, 1), (0, 2, 2), (1, 2, 3), (2, 3, -1))], "doc long, a long, b long, strength double")
    trees = I.spanning_trees(pairs)
    assert sorted((r["doc"], r["a"] % 10, r["b"] % 10, r["step"]) for r in trees.collect()) == [(d, a, b, s) for d in range(3) for a, b, s in ((0, 2, 0), (1, 2, 1), (2, 3, 2))]
    assert "FlatMapGroupsInPandas" not in plan(trees)


def test_near_pairs_come_once_without_a_shuffle_of_pairs(spark):
    points = spark.createDataFrame([(i, float(lat), float(lon)) for i, (lat, lon) in enumerate([(89.9, 0), (89.9, 180), (0, 179.9), (0, -179.9), (0, 0), (4.49, 0), (4.5, 0), (-89, 10), (-89, -100), (50, 8), (50, 8)])], "id long, lat double, lon double")
    near = G.near_pairs(points, 500.0)
    assert sorted((r["a"], r["b"]) for r in near.collect()) == [(0, 1), (2, 3), (4, 5), (5, 6), (7, 8), (9, 10)]
    assert "HashAggregate" not in plan(near)


def test_near_pairs_by_blocks_equal_all_pairs(spark, monkeypatch):
    """Poles, the date line, longitudes beyond a turn, equal places, nulls and no numbers; nothing is joined or sorted."""
    rng = random.Random(3)
    rows = [(i, rng.uniform(-90, 90), rng.uniform(-180, 180)) for i in range(300)]
    rows += [(300 + i, rng.choice([-1, 1]) * rng.uniform(84, 90), rng.uniform(-180, 180)) for i in range(60)]
    rows += [(400 + i, rng.uniform(-5, 5), rng.choice([-180.0, 180.0, 179.5, -179.5, 181.0, 540.5])) for i in range(40)]
    rows += [(500 + i, 50.0, 8.0) for i in range(30)] + [(600, None, 8.0), (601, 50.0, None), (602, float("nan"), 8.0), (None, 50.0, 8.0)]
    points = spark.createDataFrame(rows, "id long, lat double, lon double")

    def far(p, q):
        a, b = math.radians(p[1]), math.radians(q[1])
        h = math.sin((b - a) / 2) ** 2 + math.cos(a) * math.cos(b) * math.sin(math.radians(q[2] - p[2]) / 2) ** 2
        return 2 * 6371.0 * math.asin(min(1.0, math.sqrt(h)))

    fine = [r for r in rows if None not in r and r[1] == r[1]]
    want = {(p[0], q[0]): far(p, q) for p in fine for q in fine if p[0] < q[0]}
    for km, most, at_once in ((500.0, 2_000_000, 1_000_000), (500.0, 100, 50), (3000.0, 2_000_000, 20_000)):
        monkeypatch.setattr(G, "MOST_POINTS", most)
        monkeypatch.setattr(G, "PAIRS_AT_ONCE", at_once)
        near = G.near_pairs(points, km)
        got = [(r["a"], r["b"], round(r["km"], 6)) for r in near.collect()]
        assert sorted(got) == sorted((a, b, round(d, 6)) for (a, b), d in want.items() if d < km)
        assert not any(w in plan(near) for w in ("Join", "Sort"))
