"""Belief propagation on factor graphs of any size: rounds over a table of messages.

Claims are true or false and a factor weighs a pair by ``log_same`` where both agree and by ``log_other`` where they do
not, so a message is one number, the log odds it adds to its target. The table has two rows for each factor, one in each
direction, with the message sent (``out``) and the one received (``back``). Documents whose factors fit into a task are
dealt by document and run ``ROUNDS`` rounds of window functions in one stage; then the table is written. Larger ones run
the same round by grouping and joins, so that no task holds a document or a claim with very many factors. A document
that has settled keeps its messages, so its result is that of the round in which it did.

Factors of claims that are not among the nodes, or of a claim with itself, are left out; a pair that is given twice has
two factors. Rows without a document or a claim are left out. Empty tables give empty results.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType
from pyspark.sql.window import Window

from ..session import materialize
from .inference import spanning_cover

FRESH = 0.8  # share of a new message in the damped one
ROUNDS = 6  # rounds between two writes
FACTORS = 20_000  # factors of a document that one task may hold
HUB = 10_000  # factors of a claim beyond which its sum is told to where they lie
EDGE = ["doc", "a", "b", "k"]


def factors(nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """(doc, a, b, k, same, other): the factors between two known claims, numbered where a pair is repeated."""
    known = nodes.select("doc", "claim")
    own = pairs.where("a <> b").join(known.withColumnRenamed("claim", "a"), ["doc", "a"], "left_semi").join(known.withColumnRenamed("claim", "b"), ["doc", "b"], "left_semi")
    number = Window.partitionBy("doc", "a", "b").orderBy("log_same", "log_other")
    return own.select("doc", "a", "b", F.row_number().over(number).alias("k"), F.col("log_same").alias("same"), F.col("log_other").alias("other"))


def _sent(c: str, h: Column) -> Column:
    """Log odds that a factor passes on from a claim with log odds ``h``."""
    same, other = F.col("same") / F.col("rho"), F.col("other") / F.col("rho")

    def either(x: Column, y: Column) -> Column:
        return F.greatest(x, y) + F.log1p(F.exp(-F.abs(x - y)))

    return (either(same + h, other) - either(other + h, same)).alias(c)


def _odds(sums: Column) -> Column:
    return 1 / (1 + F.exp(-(F.col("odds") + sums)))


def messages(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Two rows for each factor (doc, a, b, k, same, other, rho): its ends, the source's log odds, no messages yet."""
    both = edges.select("*", F.explode(F.array(F.struct(F.col("a").alias("src"), F.col("b").alias("dst")), F.struct(F.col("b").alias("src"), F.col("a").alias("dst")))).alias("e"))
    rows = both.select(*EDGE, "e.src", "e.dst", "same", "other", "rho").join(nodes.select("doc", F.col("claim").alias("src"), (F.col("log_true") - F.col("log_false")).alias("odds")), ["doc", "src"])
    zero = F.lit(0.0)
    return rows.withColumns({"out": zero, "back": zero, "p": _odds(zero), "settled": F.lit(False), "rounds": F.lit(0)})


_STATE = (*EDGE, "src", "dst", "same", "other", "rho", "odds")


def _small_round(m: DataFrame, tolerance: float) -> DataFrame:
    """One round of documents that lie in one task each."""
    own, mirror = Window.partitionBy("doc", "src"), Window.partitionBy(*EDGE).orderBy("src")
    m = m.withColumn("sums", F.sum(F.col("rho") * F.col("back")).over(own))
    new = FRESH * _sent("x", F.col("odds") + F.col("sums") - F.col("back")) + (1 - FRESH) * F.col("out")
    m = m.withColumn("out", F.when(F.col("settled"), F.col("out")).otherwise(new))
    m = m.withColumn("back", F.coalesce(F.lag("out").over(mirror), F.lead("out").over(mirror)))
    m = m.withColumn("now", _odds(F.sum(F.col("rho") * F.col("back")).over(own)))
    return _closed(m, F.max(F.abs(F.col("now") - F.col("p"))).over(Window.partitionBy("doc")), tolerance)


def _closed(m: DataFrame, gap: Column, tolerance: float) -> DataFrame:
    """The state after a round, in which the claims of a document moved by at most ``gap``."""
    rounds = F.col("rounds") + (~F.col("settled")).cast("int")
    return m.select(*_STATE, "out", "back", F.col("now").alias("p"), (F.col("settled") | (gap < tolerance)).alias("settled"), rounds.alias("rounds"))


def _with_sums(m: DataFrame) -> DataFrame:
    """Each row with the sum of what its source receives; the sums of claims with many factors go to the rows."""
    sums = materialize(m.groupBy("doc", "src").agg(F.sum(F.col("rho") * F.col("back")).alias("sums"), F.count("*").alias("n")), "sums")
    hubs = F.broadcast(sums.where(F.col("n") > HUB).drop("n"))  # at most a ten-thousandth of the factors
    rest = m.join(hubs.select("doc", "src"), ["doc", "src"], "left_anti").join(sums.where(F.col("n") <= HUB).drop("n"), ["doc", "src"])
    return m.join(hubs, ["doc", "src"]).unionByName(rest)


def _large_round(m: DataFrame, tolerance: float) -> DataFrame:
    """One round of documents of any size."""
    m = _with_sums(m)
    new = FRESH * _sent("x", F.col("odds") + F.col("sums") - F.col("back")) + (1 - FRESH) * F.col("out")
    m = materialize(m.withColumn("out", F.when(F.col("settled"), F.col("out")).otherwise(new)).drop("sums", "back"), "sent")
    received = m.select(*EDGE, F.col("dst").alias("src"), F.col("out").alias("back"))
    m = _with_sums(materialize(m.join(received, [*EDGE, "src"]), "received")).withColumn("now", _odds(F.col("sums")))
    m = materialize(m, "now")
    gaps = m.groupBy("doc").agg(F.max(F.abs(F.col("now") - F.col("p"))).alias("gap"))  # a row for each large document
    return _closed(m.join(F.broadcast(gaps), "doc"), F.col("gap"), tolerance)


def settle(m: DataFrame, rounds: int, tolerance: float, large: bool) -> DataFrame:
    """Messages after at most ``rounds`` rounds; settled documents leave the table."""
    done, step = [], 0
    while step < rounds:
        m = m if large else m.repartition("doc")
        for _ in range(1 if large else min(ROUNDS, rounds - step)):
            m, step = (_large_round if large else _small_round)(m, tolerance), step + 1
        m = materialize(m, "messages")
        done.append(m.where("settled"))
        m = m.where("NOT settled")
        if m.isEmpty():
            break
    for own in done:
        m = m.unionByName(own)
    return m


def _strength() -> Column:
    return F.abs(F.col("same") - F.col("other"))


def forest(edges: DataFrame, order: list[Column]) -> DataFrame:
    """(doc, a, b, k) of the spanning forest of each document that comes first in a total order of its factors.

    Each round every tree takes its first factor to another tree, and trees that meet become one by pointer jumping.
    """
    ends = edges.select("doc", F.explode(F.array("a", "b")).alias("claim")).distinct()
    tree = materialize(ends.withColumn("root", F.col("claim")), "trees")
    ranked = materialize(edges.select(*EDGE, F.struct(*order, "a", "b", "k").alias("place")), "ranked")
    chosen = ranked.select(*EDGE).limit(0)
    while True:
        at = {c: tree.select("doc", F.col("claim").alias(c), F.col("root").alias(f"r{c}")) for c in "ab"}
        live = materialize(ranked.join(at["a"], ["doc", "a"]).join(at["b"], ["doc", "b"]).where("ra <> rb"), "between")
        if live.isEmpty():
            return chosen
        ways = live.select("doc", F.explode(F.array(F.struct(F.col("ra").alias("root"), F.col("rb").alias("up")), F.struct(F.col("rb").alias("root"), F.col("ra").alias("up")))).alias("w"), "place", *EDGE[1:])
        best = ways.groupBy("doc", "w.root").agg(F.min(F.struct("place", "w.up", *EDGE[1:])).alias("e"))
        best = materialize(best.select("doc", "root", "e.up", "e.a", "e.b", "e.k"), "first")
        chosen = materialize(chosen.unionByName(best.select(*EDGE).distinct()), "forest")
        up = best.select("doc", "root", "up")
        again = up.select("doc", F.col("root").alias("up"), F.col("up").alias("top"))
        # of two trees that chose the same factor the smaller one stays a root
        pointer = materialize(up.join(again, ["doc", "up"], "left").select("doc", "root", F.when((F.col("top") == F.col("root")) & (F.col("root") < F.col("up")), F.col("root")).otherwise(F.col("up")).alias("up")), "pointers")
        while True:
            above = pointer.select("doc", F.col("root").alias("up"), F.col("up").alias("top"))
            jumped = materialize(pointer.join(above, ["doc", "up"]).select("doc", "root", "up", "top"), "pointers")
            pointer = jumped.select("doc", "root", F.col("top").alias("up"))
            if jumped.where("up <> top").isEmpty():
                break
        tree = materialize(tree.join(pointer, ["doc", "root"], "left").select("doc", "claim", F.coalesce("up", "root").alias("root")), "trees")


def tree_weights(edges: DataFrame, large: bool) -> DataFrame:
    """``edges`` with ``rho``: how often a factor is in two spanning forests, the second of which shuns the first's."""
    if large:
        first = forest(edges, [-_strength()])
        marked = materialize(edges.join(first.withColumn("one", F.lit(1)), EDGE, "left").fillna(0, ["one"]), "first-forest")
        second = forest(marked, [F.col("one"), -_strength()])
        both = marked.join(second.withColumn("two", F.lit(1)), EDGE, "left").fillna(0, ["two"])
        return both.select(*EDGE, "same", "other", F.greatest((F.col("one") + F.col("two")) / 2, F.lit(0.25)).alias("rho"))

    def cover(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values(["a", "b", "k"]).reset_index(drop=True)
        names = {c: i for i, c in enumerate(sorted(set(p["a"]) | set(p["b"])))}
        ends = np.stack([p["a"].map(names), p["b"].map(names)], 1)
        return p.assign(rho=spanning_cover(len(names), ends, (p["same"] - p["other"]).abs().to_numpy()))

    return edges.groupBy("doc").applyInPandas(cover, StructType([*edges.schema.fields, StructField("rho", DoubleType())]))


def bounds(nodes: DataFrame, m: DataFrame) -> DataFrame:
    """(doc, log_bound): reweighted free energy, an upper bound of the log partition function where trees cover it."""
    entropy = lambda p: -sum((q * F.log(F.greatest(q, F.lit(1e-12))) for q in (p, 1 - p)), F.lit(0.0))
    single = nodes.select("doc", ((1 - F.col("p_true")) * F.col("log_false") + F.col("p_true") * F.col("log_true") + entropy(F.col("p_true"))).alias("part"))
    cavity = lambda c: F.log(F.col("p") / (1 - F.col("p"))) - F.col(c)
    own = m.select(*EDGE, "src", "dst", "same", "other", "rho", cavity("back").alias("h"))
    pair = own.where(F.col("src") == F.col("a")).join(own.where(F.col("src") == F.col("b")).select(*EDGE, F.col("h").alias("g")), EDGE)
    worlds = [(x, y) for x in (0, 1) for y in (0, 1)]
    table = {w: F.col("same") if w[0] == w[1] else F.col("other") for w in worlds}
    score = {w: table[w] / F.col("rho") + w[0] * F.col("h") + w[1] * F.col("g") for w in worlds}
    pair = pair.withColumn("top", F.greatest(*score.values())).withColumns({f"w{x}{y}": F.exp(score[x, y] - F.col("top")) for x, y in worlds})
    total = F.col("w00") + F.col("w01") + F.col("w10") + F.col("w11")
    pair = pair.withColumns({f"q{x}{y}": F.col(f"w{x}{y}") / total for x, y in worlds})
    q = {w: F.col(f"q{w[0]}{w[1]}") for w in worlds}
    alone = {w: (q[w[0], 0] + q[w[0], 1]) * (q[0, w[1]] + q[1, w[1]]) for w in worlds}
    info = sum((q[w] * F.log(F.greatest(q[w], F.lit(1e-12)) / F.greatest(alone[w], F.lit(1e-12))) for w in worlds), F.lit(0.0))
    expected = sum((q[w] * table[w] for w in worlds), F.lit(0.0))
    return single.unionByName(pair.select("doc", (expected - F.col("rho") * info).alias("part"))).groupBy("doc").agg(F.sum("part").alias("log_bound"))


def _solved(nodes: DataFrame, edges: DataFrame, large: bool, reweighted: bool, rounds: int, tolerance: float) -> DataFrame:
    weighted = tree_weights(edges, large) if reweighted else edges.withColumn("rho", F.lit(1.0))
    return materialize(settle(materialize(messages(nodes, weighted), "start"), rounds, tolerance, large), "settled")


def infer(nodes: DataFrame, pairs: DataFrame, rigor: str = "balanced", tolerance: float = 1e-4, rounds: int | None = None, limit: int = FACTORS) -> DataFrame:
    """Posterior of each claim: nodes (doc, claim, log_false, log_true), pairs (doc, a, b, log_same, log_other).

    Returns doc, claim, p_true, converged, algorithm, iterations, edge_count and, where the reweighted form settled,
    log_bound. fast: plain propagation; otherwise the reweighted form, and plain propagation for documents in which that
    does not settle. ``limit``: factors of a document beyond which its rounds run by joins.
    """
    nodes = materialize(nodes.where("doc IS NOT NULL AND claim IS NOT NULL").select("doc", "claim", "log_false", "log_true"), "nodes")
    edges = materialize(factors(nodes, pairs), "factors")
    rounds = rounds or {"fast": 50, "maximum": 300}.get(rigor, 200)
    counts = materialize(edges.groupBy("doc").agg(F.count("*").alias("edge_count")), "factor-counts")
    found = []
    for large in (False, True):
        docs = counts.where(F.col("edge_count") > limit if large else F.col("edge_count") <= limit).select("doc")
        if docs.isEmpty():
            continue
        own = edges.join(F.broadcast(docs) if large else docs, "doc", "left_semi")
        if rigor != "fast":
            m = _solved(nodes, own, large, True, rounds, tolerance)
            found.append(m.where("settled").withColumn("algorithm", F.lit("trw_bp")))
            left = m.where("NOT settled").select("doc").distinct()
            if left.isEmpty():
                continue
            own = own.join(left, "doc", "left_semi")
        m = _solved(nodes, own, large, False, rounds, tolerance)
        found.append(m.withColumn("algorithm", F.when(F.col("settled"), "lbp").otherwise("lbp_nonconvergent")))
    alone = nodes.join(counts, "doc", "left").fillna(0, ["edge_count"]).withColumn("alone", 1 / (1 + F.exp(F.col("log_false") - F.col("log_true"))))
    if not found:
        rows = alone.select("*", F.lit(None).cast("double").alias("p"), F.lit(None).cast("string").alias("algorithm"), F.lit(None).cast("boolean").alias("settled"), F.lit(None).cast("int").alias("rounds"))
        told = None
    else:
        told = found[0]
        for m in found[1:]:
            told = told.unionByName(m)
        marginal = told.groupBy("doc", F.col("src").alias("claim")).agg(F.first("p").alias("p"))
        state = told.groupBy("doc").agg(F.first("algorithm").alias("algorithm"), F.first("settled").alias("settled"), F.max("rounds").alias("rounds"))
        rows = alone.join(marginal, ["doc", "claim"], "left").join(state, "doc", "left")
    rows = rows.select("doc", "claim", "log_false", "log_true", F.coalesce("p", "alone").alias("p_true"), F.coalesce("settled", F.lit(True)).alias("converged"), F.coalesce("algorithm", F.lit("unary")).alias("algorithm"), F.coalesce("rounds", F.lit(0)).alias("iterations"), "edge_count")
    tried = rows.where("algorithm IN ('trw_bp', 'unary')")
    if told is None:
        whole = tried.groupBy("doc").agg(F.sum(F.greatest("log_false", "log_true") + F.log1p(F.exp(-F.abs(F.col("log_true") - F.col("log_false"))))).alias("log_bound"))
    else:
        whole = bounds(tried, told.where("algorithm = 'trw_bp'"))
    return rows.join(whole, "doc", "left").drop("log_false", "log_true")
