"""Factor graphs of claims, one per document, solved in grouped tasks.

Nodes are a document's claims, edges its claim pairs. ``factor_tables`` builds both with column functions; a solver
gets the documents of a task side by side, whose claims are bounded by the decomposer.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

TILT = 1e-3
BELIEF = "doc string, claim string, p_true double, converged boolean, algorithm string, iterations int, edge_count int, log_bound double, mismatch double"


def unary_factors(evidence: DataFrame, keys: list[str]) -> DataFrame:
    """log potentials per claim: sums of log(entail + neutral / 2) and log(contradict + neutral / 2), floored."""
    floor = lambda c: F.log(F.greatest(F.col(c) + 0.5 * F.col("neutral"), F.lit(TILT)))
    return evidence.groupBy(*keys).agg(F.sum(floor("contradict")).alias("log_false"), F.sum(floor("entail")).alias("log_true"))


def binary_factors(pairs: DataFrame, scale: float = 1.0) -> DataFrame:
    """log potentials of claim pairs (same, other) from entail, contradict, neutral."""
    weight = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.greatest("entail", "contradict") - F.col("neutral"))) * scale
    tilt = lambda c: F.log(F.greatest(F.col(c) + 0.5 * F.col("neutral"), F.lit(TILT))) * weight
    return pairs.withColumn("log_same", tilt("entail")).withColumn("log_other", tilt("contradict"))


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)


def marginals(unary: np.ndarray, edges: np.ndarray, messages: np.ndarray) -> np.ndarray:
    belief = unary.copy()
    np.add.at(belief, edges[:, 1], messages[:, 0])
    np.add.at(belief, edges[:, 0], messages[:, 1])
    return np.exp(belief - _lse(belief, 1)[:, None])


def loopy_belief_propagation(unary: np.ndarray, edges: np.ndarray, binary: np.ndarray, iterations: int = 200, tolerance: float = 1e-4, fresh: float = 0.8, rho: np.ndarray | None = None) -> tuple[np.ndarray, bool, int, np.ndarray]:
    """Damped synchronous propagation; with ``rho`` the tree-reweighted form. Marginals, settled, rounds, messages."""
    if not len(edges):
        return np.exp(unary - _lse(unary, 1)[:, None]), True, 0, np.zeros((0, 2, 2))
    rho = np.ones(len(edges)) if rho is None else rho
    i, j = edges[:, 0], edges[:, 1]
    m = np.zeros((len(edges), 2, 2))
    weighted = m * rho[:, None, None]
    before = marginals(unary, edges, weighted)
    scaled = binary / rho[:, None, None]
    for step in range(1, iterations + 1):
        belief = unary.copy()
        np.add.at(belief, j, rho[:, None] * m[:, 0])
        np.add.at(belief, i, rho[:, None] * m[:, 1])
        out_i, out_j = belief[i] - m[:, 1], belief[j] - m[:, 0]
        new = np.stack([_lse(scaled + out_i[:, :, None], 1), _lse(scaled + out_j[:, None, :], 2)], axis=1)
        new -= _lse(new, 2)[:, :, None]
        m = fresh * new + (1 - fresh) * m
        now = marginals(unary, edges, rho[:, None, None] * m)
        gap, before = np.abs(now - before).max(), now
        if gap < tolerance:
            return now, True, step, m
    return before, False, iterations, m


def spanning_cover(n: int, edges: np.ndarray, strength: np.ndarray) -> np.ndarray:
    """Edge weights of two spanning trees, by strength and by strength with the first tree's edges last."""
    def tree(order: np.ndarray) -> np.ndarray:
        up, used = list(range(n)), np.zeros(len(edges), dtype=bool)

        def root(x: int) -> int:
            while up[x] != x:
                up[x] = up[up[x]]
                x = up[x]
            return x

        for k in order:
            a, b = root(edges[k, 0]), root(edges[k, 1])
            if a != b:
                up[a], used[k] = b, True
        return used

    first = tree(np.argsort(-strength, kind="stable"))
    second = tree(np.lexsort((-strength, first)))
    return np.maximum((first.astype(float) + second) / 2, 0.25)


def first_tree(n: int, edges: np.ndarray, strength: np.ndarray) -> list[int]:
    """Edges of the strongest spanning tree of node 0's component, in the order they join it; of equals the first."""
    reached, chosen = np.arange(n) == 0, []
    while len(edges) and (cut := np.flatnonzero(reached[edges[:, 0]] != reached[edges[:, 1]])).size:
        chosen.append(int(cut[np.argmax(strength[cut])]))
        reached[edges[chosen[-1]]] = True
    return chosen


def spanning_trees(pairs: DataFrame) -> DataFrame:
    """(doc, a, b, step) of the strongest spanning tree from each document's smallest claim: pairs (doc, a, b, strength)."""

    @F.pandas_udf("array<struct<a: long, b: long, step: long>>")
    def trees(documents: pd.Series) -> pd.Series:
        out = []
        for p in documents:
            rows = sorted((r["a"], r["b"], r["strength"]) for r in p)
            place = {c: i for i, c in enumerate(sorted({r[0] for r in rows} | {r[1] for r in rows}))}
            chosen = first_tree(len(place), np.array([(place[a], place[b]) for a, b, _ in rows]), np.array([r[2] for r in rows], dtype=float))
            out.append([{"a": rows[k][0], "b": rows[k][1], "step": i} for i, k in enumerate(chosen)])
        return pd.Series(out)

    whole = pairs.groupBy("doc").agg(F.collect_list(F.struct("a", "b", "strength")).alias("p"))  # a document's pairs in a row
    return whole.select("doc", F.explode(trees("p")).alias("t")).select("doc", "t.a", "t.b", "t.step")


def log_bound(unary: np.ndarray, edges: np.ndarray, binary: np.ndarray, p: np.ndarray, messages: np.ndarray, rho: np.ndarray) -> float:
    """Reweighted free energy at the marginals: expected log potentials, node entropies, less weighted information."""
    entropy = lambda q: -float((q * np.log(np.maximum(q, 1e-12))).sum())
    total = float((p * unary).sum()) + entropy(p)
    belief = unary.copy()
    np.add.at(belief, edges[:, 1], rho[:, None] * messages[:, 0])
    np.add.at(belief, edges[:, 0], rho[:, None] * messages[:, 1])
    for k, (i, j) in enumerate(edges):
        joint = binary[k] / rho[k] + (belief[i] - messages[k, 1])[:, None] + (belief[j] - messages[k, 0])[None, :]
        q = np.exp(joint - joint.max())
        q /= q.sum()
        info = float((q * np.log(np.maximum(q, 1e-12) / np.maximum(np.outer(q.sum(1), q.sum(0)), 1e-12))).sum())
        total += float((q * binary[k]).sum()) - rho[k] * info
    return total


def gibbs(unary: np.ndarray, edges: np.ndarray, binary: np.ndarray, seed: int, burn: int = 500, sweeps: int = 2000) -> np.ndarray:
    """Share of sweeps in which each claim is true; one draw per node and sweep, in order."""
    rng, n = np.random.default_rng(seed), len(unary)
    near: list[list[tuple[int, np.ndarray]]] = [[] for _ in range(n)]
    for (i, j), b in zip(edges, binary, strict=True):
        near[i].append((j, b))
        near[j].append((i, b.T))
    state, hits = np.zeros(n, dtype=int), np.zeros(n)
    for sweep in range(burn + sweeps):
        for v in range(n):
            logit = unary[v, 1] - unary[v, 0] + sum(b[1, state[o]] - b[0, state[o]] for o, b in near[v])
            state[v] = rng.random() < 1 / (1 + np.exp(-logit))
        if sweep >= burn:
            hits += state
    return hits / sweeps


SWEEPS = 50  # sweeps whose draws a task holds at once


def gibbs_together(unary: np.ndarray, edges: np.ndarray, binary: np.ndarray, starts: np.ndarray, seeds: list[int], burn: int = 500, sweeps: int = 2000) -> np.ndarray:
    """``gibbs`` for graphs side by side, the i-th with the nodes from starts[i] up to starts[i + 1] and its own seed.

    A node depends on earlier ones of the same sweep and later ones of the sweep before. Nodes as far from the first as each other
    share no edge, so one step takes these of all graphs; each graph's draws and sums keep their order.
    """
    n = len(unary)
    near: list[list[tuple[int, float, float]]] = [[] for _ in range(n)]
    rise = [(b[1, 0] - b[0, 0], b[1, 1] - b[0, 1], b[0, 1] - b[0, 0], b[1, 1] - b[1, 0]) for b in binary]
    for (i, j), (i0, i1, j0, j1) in zip(edges.tolist(), rise, strict=True):
        near[i].append((j, i0, i1))
        near[j].append((i, j0, j1))
    level = np.zeros(n, dtype=int)
    for v in range(n):
        level[v] = max((level[o] + 1 for o, _, _ in near[v] if o < v), default=0)
    order = np.lexsort((-np.array([len(x) for x in near], dtype=int), level))  # of a level the nodes with most edges come first
    at = np.empty(n, dtype=int)
    at[order] = np.arange(n)
    steps = []
    for own in np.split(order, np.flatnonzero(np.diff(level[order])) + 1) if n else []:
        slots = []
        for k in range(len(near[own[0]])):
            edge = [near[v][k] for v in own if len(near[v]) > k]
            slots.append((at[[o for o, _, _ in edge]], np.array([a for _, a, _ in edge]), np.array([b for _, _, b in edge])))
        steps.append((slice(at[own[0]], at[own[-1]] + 1), unary[own, 1] - unary[own, 0], slots))
    state, hits = np.zeros(n, dtype=bool), np.zeros(n)
    drawn = [np.random.default_rng(s) for s in seeds]
    u = np.empty((SWEEPS, n))
    for sweep in range(burn + sweeps):
        if sweep % SWEEPS == 0:
            for rng, a, b in zip(drawn, starts[:-1], starts[1:], strict=True):
                u[:, a:b] = rng.random((SWEEPS, b - a))
            ahead = u[:, order]
        for own, bias, slots in steps:
            told = np.zeros(len(bias))
            for other, off, on in slots:
                told[: len(other)] += np.where(state[other], on, off)
            state[own] = ahead[sweep % SWEEPS, own] < 1 / (1 + np.exp(-(bias + told)))
        if sweep >= burn:
            hits += state
    return hits[at] / sweeps


def seed_of(ids: list[str]) -> int:
    return int.from_bytes(hashlib.sha256("|".join(sorted(ids)).encode()).digest()[:8], "big")


def solve(unary: np.ndarray, edges: np.ndarray, binary: np.ndarray, rigor: str = "balanced") -> tuple[np.ndarray, bool, str, int, float | None]:
    """fast: propagation with a quarter of the rounds; otherwise the reweighted form first, then plain propagation."""
    if not len(edges):
        return *loopy_belief_propagation(unary, edges, binary)[:2], "unary", 0, float(_lse(unary, 1).sum())
    rounds = 300 if rigor == "maximum" else 200
    if rigor != "fast":
        rho = spanning_cover(len(unary), edges, np.abs(binary[:, 0, 0] - binary[:, 0, 1]))
        p, settled, n, m = loopy_belief_propagation(unary, edges, binary, rounds, rho=rho)
        if settled:
            return p, True, "trw_bp", n, log_bound(unary, edges, binary, p, m, rho)
    p, settled, n, _ = loopy_belief_propagation(unary, edges, binary, rounds if rigor != "fast" else 50)
    return p, settled, "lbp" if settled else "lbp_nonconvergent", n, None


#: Claims that a task takes side by side, more only if one document has more.
TOGETHER = 20_000


@dataclass
class Graphs:
    """Factor graphs side by side: the i-th has the claims from starts[i] up to starts[i + 1], edges between places of claims."""

    docs: list[str]
    claims: list[str]
    starts: np.ndarray
    values: dict[str, np.ndarray]
    edges: np.ndarray
    edge_starts: np.ndarray
    links: dict[str, np.ndarray]

    def ids(self, i: int) -> list[str]:
        return self.claims[self.starts[i] : self.starts[i + 1]]

    def each_claim(self, values: list) -> np.ndarray:
        """A value of each document, for each of its claims."""
        return np.repeat(np.array(values), np.diff(self.starts))


def _whole_documents(nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """(doc, nodes, pairs): a document's claims and pairs in a row, in their order."""
    n, p = (F.struct(*[c for c in t.columns if c != "doc"]) for t in (nodes, pairs))
    none = lambda t: F.lit(None).cast(StructType([f for f in t.schema if f.name != "doc"]))
    both = nodes.select("doc", n.alias("nodes"), none(pairs).alias("pairs")).unionByName(pairs.select("doc", none(nodes).alias("nodes"), p.alias("pairs")))
    return both.groupBy("doc").agg(*[F.sort_array(F.collect_list(c)).alias(c) for c in ("nodes", "pairs")])


def _graphs(batches: Iterator[pa.RecordBatch]) -> Iterator[Graphs]:
    """The documents of a task, up to TOGETHER claims at a time; pairs of claims that are not there, or of one claim, are left out."""
    for batch in batches:
        sizes = np.cumsum(np.asarray(batch.column("nodes").value_lengths()))
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + TOGETHER, "right")))
            yield _graph(batch.slice(at, to - at))
            at = to


def _graph(batch: pa.RecordBatch) -> Graphs:
    nodes, pairs = batch.column("nodes"), batch.column("pairs")
    starts, ends = (np.concatenate([[0], np.cumsum(np.asarray(c.value_lengths()))]).astype(int) for c in (nodes, pairs))
    n, p = ({f.name: c.flatten().field(i) for i, f in enumerate(c.type.value_type)} for c in (nodes, pairs))
    claims, a, b = (c.cast(pa.string()).to_pylist() for c in (n.pop("claim"), p.pop("a"), p.pop("b")))
    edges, kept, edge_starts = [], [], [0]
    for i in range(batch.num_rows):
        place = {c: k for k, c in enumerate(claims[starts[i] : starts[i + 1]], starts[i])}
        for k in range(ends[i], ends[i + 1]):
            x, y = place.get(a[k]), place.get(b[k])
            if x is not None and y is not None and x != y:
                edges.append((min(x, y), max(x, y)))
                kept.append(k)
        edge_starts.append(len(edges))
    numbers = lambda c: c.to_numpy(zero_copy_only=False).astype(float)
    links = {k: numbers(c)[kept] for k, c in p.items()}
    return Graphs(batch.column("doc").cast(pa.string()).to_pylist(), claims, starts, {k: numbers(c) for k, c in n.items()}, np.array(edges, dtype=int).reshape(-1, 2), np.array(edge_starts), links)


def _potentials(g: Graphs) -> tuple[np.ndarray, np.ndarray]:
    same, other = g.links["log_same"], g.links["log_other"]
    return np.stack([g.values["log_false"], g.values["log_true"]], 1), np.stack([np.stack([same, other], 1), np.stack([other, same], 1)], 1)


def _shares(g: Graphs) -> np.ndarray:
    unary, binary = _potentials(g)
    return gibbs_together(unary, g.edges, binary, g.starts, [seed_of(g.ids(i)) for i in range(len(g.docs))])


def infer(nodes: DataFrame, pairs: DataFrame, rigor: str = "balanced", check: float | None = None) -> DataFrame:
    """Posterior of each claim: nodes (doc, claim, log_false, log_true), pairs (doc, a, b, log_same, log_other).

    With ``check`` a sampler with a seed from the claims' ids is held against the solver: where a marginal differs by
    more than that, ``mismatch`` is the largest difference of the document; else null.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in _graphs(batches):
            unary, binary = _potentials(g)
            p, told = np.zeros(len(unary)), []
            share = _shares(g) if check is not None else None
            for i in range(len(g.docs)):
                own, tied = slice(g.starts[i], g.starts[i + 1]), slice(g.edge_starts[i], g.edge_starts[i + 1])
                if own.start == own.stop:  # pairs without claims
                    told.append((None, "", 0, 0, None, None))
                    continue
                q, settled, name, n, bound = solve(unary[own], g.edges[tied] - own.start, binary[tied], rigor)
                p[own] = q[:, 1]
                gap = float(np.abs(share[own] - p[own]).max()) if check is not None and tied.start < tied.stop else None
                told.append((settled, name, n, tied.stop - tied.start, bound, gap if gap is not None and gap > check else None))
            names = ("converged", "algorithm", "iterations", "edge_count", "log_bound", "mismatch")
            columns = {c: [t[k] for t, n in zip(told, np.diff(g.starts), strict=True) for _ in range(n)] for k, c in enumerate(names)}
            columns |= {"doc": list(g.each_claim(g.docs)), "claim": g.claims, "p_true": p}
            kinds = {"string": pa.string(), "double": pa.float64(), "boolean": pa.bool_(), "int": pa.int32()}
            yield pa.RecordBatch.from_pydict({c: pa.array(columns[c], kinds[k]) for c, k in (f.split() for f in BELIEF.split(", "))})

    return _whole_documents(nodes, pairs.select("doc", "a", "b", "log_same", "log_other")).mapInArrow(run, BELIEF)


def sampled(nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """(doc, claim, share): how often the sampler found each claim true; a task samples its documents side by side."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in _graphs(batches):
            yield pa.RecordBatch.from_pydict({"doc": pa.array(list(g.each_claim(g.docs)), pa.string()), "claim": pa.array(g.claims, pa.string()), "share": _shares(g)})

    return _whole_documents(nodes, pairs.select("doc", "a", "b", "log_same", "log_other")).mapInArrow(run, "doc string, claim string, share double")


def nearest_correlation(r: np.ndarray, floor: float = 1e-4) -> np.ndarray:
    """Nearest correlation matrix: negative eigenvalues lifted, diagonal brought back to one."""
    values, vectors = np.linalg.eigh((r + r.T) / 2)
    m = (vectors * np.maximum(values, floor)) @ vectors.T
    d = np.sqrt(np.clip(np.diag(m), floor, None))
    m = m / np.outer(d, d)
    np.fill_diagonal(m, 1.0)
    return m


def _quantiles(p: np.ndarray) -> np.ndarray:
    from statistics import NormalDist

    return np.array([NormalDist().inv_cdf(x) for x in p])


def _ratio(x: np.ndarray, over: tuple[float, ...], under: tuple[float, ...]) -> np.ndarray:
    """A quotient of polynomials, highest powers first."""
    return np.polyval(over, x) / np.polyval(under, x)


# W. J. Cody's rational approximations of erf and erfc, up to 0.46875, up to 4 and beyond.
_ERF = (
    ((1.85777706184603153e-1, 3.16112374387056560, 1.13864154151050156e2, 3.77485237685302021e2, 3.20937758913846947e3), (1.0, 2.36012909523441209e1, 2.44024637934444173e2, 1.28261652607737228e3, 2.84423683343917062e3)),
    ((2.15311535474403846e-8, 5.64188496988670089e-1, 8.88314979438837594, 6.61191906371416295e1, 2.98635138197400131e2, 8.81952221241769090e2, 1.71204761263407058e3, 2.05107837782607147e3, 1.23033935479799725e3),
     (1.0, 1.57449261107098347e1, 1.17693950891312499e2, 5.37181101862009858e2, 1.62138957456669019e3, 3.29079923573345963e3, 4.36261909014324716e3, 3.43936767414372164e3, 1.23033935480374942e3)),
    ((1.63153871373020978e-2, 3.05326634961232344e-1, 3.60344899949804439e-1, 1.25781726111229246e-1, 1.60837851487422766e-2, 6.58749161529837803e-4), (1.0, 2.56852019228982242, 1.87295284992346725, 5.27905102951428412e-1, 6.05183413124413191e-2, 2.33520497626869185e-3)),
)


def _below(z: np.ndarray) -> np.ndarray:
    """Standard normal probabilities of arrays."""
    x = np.asarray(z, dtype=float) / -np.sqrt(2)
    y = np.abs(x)
    out = np.empty_like(y)
    low, high = y <= 0.46875, y > 4
    mid = ~(low | high)
    out[low] = 1 - y[low] * _ratio(y[low] ** 2, *_ERF[0])
    out[mid] = np.exp(-y[mid] ** 2) * _ratio(y[mid], *_ERF[1])
    s = 1 / np.minimum(y[high], 1e8) ** 2
    out[high] = np.exp(-np.minimum(y[high], 40.0) ** 2) * np.sqrt(s) * (1 / np.sqrt(np.pi) - s * _ratio(s, *_ERF[2]))
    return 0.5 * np.where(x < 0, 2 - out, out)


def _inverse_below(p: np.ndarray) -> np.ndarray:
    """Standard normal quantiles of arrays: an asymptotic start and Newton steps on the probability's logarithm."""
    q = np.clip(np.minimum(p, 1 - p), 1e-300, 0.5)
    t = np.sqrt(-2 * np.log(q))
    z = -(t - (2.515517 + 0.802853 * t + 0.010328 * t * t) / (1 + 1.432788 * t + 0.189269 * t * t + 0.001308 * t**3))
    for _ in range(3):
        at = np.maximum(_below(z), 1e-300)
        z -= (np.log(at) - np.log(q)) * at * np.sqrt(2 * np.pi) * np.exp(np.minimum(z * z / 2, 700))
    return np.where(p > 0.5, -z, z)


MOST_INTEGRATED, LATTICE = 10, 16_381  # claims up to which the joint is integrated; points of the rule


def integrated_joint(z: np.ndarray, r: np.ndarray, points: int = LATTICE) -> float:
    """P(all Z_i <= z_i) of a normal vector with correlations ``r``, by separation of variables over a lattice.

    Each variable is drawn below its bound given those before, so the integrand is the product of the conditional
    probabilities; the claims with the tightest bounds come first. The lattice's points are folded, which makes the integrand
    periodic.
    """
    order = np.argsort(z, kind="stable")
    z, r = z[order], r[np.ix_(order, order)]
    root, n = np.linalg.cholesky(r), len(z)
    steps = np.sqrt(np.array([2.0, 3, 5, 7, 11, 13, 17, 19, 23, 29])[: n - 1])
    grid = np.outer(np.arange(1, points + 1), steps) % 1
    grid = np.clip(np.abs(2 * grid - 1), 1e-12, 1 - 1e-12)
    y = np.zeros((points, n))
    e = np.full(points, _below(np.array([z[0] / root[0, 0]]))[0])
    total = e.copy()
    for i in range(1, n):
        y[:, i - 1] = _inverse_below(grid[:, i - 1] * e)
        e = _below((z[i] - y[:, :i] @ root[i, :i]) / root[i, i])
        total *= e
    return float(total.mean())


@lru_cache(maxsize=10_000)
def _joint_of(p: bytes, r: bytes) -> float:
    """The integrated joint of equal problems, once for each task's worker."""
    q = np.frombuffer(p)
    return integrated_joint(_quantiles(q), nearest_correlation(np.frombuffer(r).reshape(len(q), -1)) + 1e-10 * np.eye(len(q)))


def copula_joint(p: np.ndarray, r: np.ndarray, draws: int = 10_000, seed: int = 0) -> float:
    """Probability that all claims are true under a Gaussian copula with correlations ``r``.

    The product where there are none, the probability itself for one claim; up to MOST_INTEGRATED claims by integration, beyond
    as the share of seeded draws.
    """
    p = np.clip(p, 1e-6, 1 - 1e-6) if len(p) != 1 else p
    if len(p) <= 1 or np.allclose(r, np.eye(len(p)), atol=1e-8):
        return float(np.prod(p))
    if len(p) <= MOST_INTEGRATED:
        return _joint_of(p.tobytes(), np.ascontiguousarray(r, dtype=float).tobytes())
    near = nearest_correlation(r) + 1e-10 * np.eye(len(p))
    z = np.random.default_rng(seed).standard_normal((draws, len(p))) @ np.linalg.cholesky(near).T
    return float((z <= _quantiles(p)).all(axis=1).mean())


def copula_scores(beliefs: DataFrame, pairs: DataFrame, draws: int = 10_000) -> DataFrame:
    """(doc, n_claims, joint): beliefs (doc, claim, p_true) and correlations of claim pairs (doc, a, b, r)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in _graphs(batches):
            sizes, joint = np.diff(g.starts), []
            for i, n in enumerate(sizes):
                own, tied = g.starts[i], slice(g.edge_starts[i], g.edge_starts[i + 1])
                m = np.eye(n)
                for (a, b), r in zip(g.edges[tied] - own, g.links["r"][tied], strict=True):
                    m[a, b] = m[b, a] = r
                joint.append(copula_joint(g.values["p_true"][own : own + n], m, draws, seed_of(g.ids(i)) % (1 << 32)))
            yield pa.RecordBatch.from_pydict({"doc": pa.array(g.docs, pa.string()), "n_claims": sizes.astype(np.int64), "joint": pa.array(joint, pa.float64())})

    return _whole_documents(beliefs.select("doc", "claim", "p_true"), pairs.select("doc", "a", "b", "r")).mapInArrow(run, "doc string, n_claims long, joint double")
