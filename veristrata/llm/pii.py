"""Personal data: base patterns, and a skip-chain conditional random field that adds spans.

Base spans come from four patterns. The field runs on every text with candidate tokens: runs without white space or
brackets that hold '@' or at least three digits. Its nodes are these tokens, its labels the four kinds and none.
Tokens side by side (up to three separators apart) share chain potentials; however far apart they stand, tokens with
the same digits (six or more) or address share "equal" potentials, and tokens with the same last seven digits or the
same name before '@' share "similar" ones, each with the one before it and with the first of its group, so edges grow
with the number of nodes. A token inside a base span takes the digits of the whole span, so that a number written in
groups meets its repeats in other forms. Tokens in base spans are clamped to their kind; damped loopy belief
propagation carries that along the edges, and an unclamped token whose marginal of a kind is at least ``SURE`` becomes
a span, together with the tokens of its kind beside it, if equal and similar edges lead from it to a clamped token.
Repetition alone is no evidence: two tokens that share their digits are as likely both nothing as both of a kind
(``fair``), and a number that fails its pattern stays plain however often it is repeated.

All weights (token shapes, chain, equal, similar) maximize the pseudo-likelihood of the labels that the base patterns
give, over all documents: one count per configuration of a token and its neighbours, at most N_SHAPES * 6**4 * 5 rows,
is all that the driver gets. A configuration weighs by the logarithm of its count, so that a corpus of any size leaves
the prior its say. Tokens tied to evidence that the patterns do not match count as unlabelled.

Nulls: a null text is empty and has no span; null ids are kept. Empty tables give empty results and the prior's
weights; repeated rows are searched alike; extra columns are ignored by ``find`` and kept by ``redact``. Very long texts
are searched whole; patterns take time in proportion to the text, and the propagation works in blocks of edges. Ties
of marginals go to the kind first in KINDS. Offsets are code points, ends exclusive.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_map, documents, text_of

KINDS = ("email", "ip", "card", "phone")
SURE, ROUNDS, DAMPING = 0.9, 12, 0.3
N_SHAPES, N_LABELS, NONE = 96, 5, 5  # label 0: no personal data, else kind + 1; NONE: no such neighbour
#: Prior means of the weights: no personal data, and what equal and similar tokens share. Learned counts move them.
NOTHING, SAME = 3.0, {"equal": 12.0, "similar": 12.0}
#: Edges that one step of the propagation works on at a time.
BLOCK = 1 << 16
_domain = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_local = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_ip = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_card = re.compile(r"[0-9](?:[ -]?[0-9])+")
_phone = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_digit = re.compile(r"[0-9]")
_break = frozenset(" \t\n\r\x0b\x0c,;:!?()[]<>\"'\u00a0")
_mark = re.compile(r"[0-9@][^\s,;:!?()\[\]<>\"']*")
_beside = re.compile(r"[ ().-]{1,3}")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches without overlap, in time linear in the text: around each '@', not from each character."""
    out, end, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _local:
            start -= 1
        m = _domain.match(text, at) if start < at else None
        if m:
            out.append((start, m.end()))
            end = m.end()
        else:
            end = max(end, at + 1)
        at = text.find("@", max(at + 1, end))
    return out


def _numbers(text: str) -> tuple[list, list, list]:
    ips = [m.span() for m in _ip.finditer(text) if all(len(q := p.lstrip("0")) <= 3 and int(q or 0) <= 255 for p in m[0].split("."))]
    cards = [m.span() for m in _card.finditer(text) if 16 <= len(d := m[0].replace(" ", "").replace("-", "")) <= 19 and luhn(d)]
    phones = [m.span() for m in _phone.finditer(text) if 8 <= sum(map(str.isdigit, m[0])) <= 15] if "+" in text else []
    return ips, cards, phones


def base_spans(text: str) -> list[list[tuple[int, int]]]:
    """Spans by kind, in the order of KINDS."""
    emails = _emails(text) if "@" in text else []
    return [emails, *(_numbers(text) if _digit.search(text) else ([], [], []))]


def _tokens(text: str) -> list[tuple[int, int]]:
    """Candidate tokens: runs without white space or brackets that hold '@' or three digits."""
    out, end = [], 0
    for m in _mark.finditer(text):
        a, b = m.span()
        while a > end and text[a - 1] not in _break and not text[a - 1].isspace():
            a -= 1
        end = b
        t = m[0]
        if "@" in t or len(t) - len(t.translate(_NO_DIGITS)) >= 3:
            out.append((a, b))
    return out


_NO_DIGITS = {c: None for c in range(48, 58)}
_ONLY_DIGITS = re.compile(r"[^0-9]+")


def _shape(token: str, before: str) -> int:
    """'@', a plus sign, number of digits in five classes, dots in three, other signs than digits and dots."""
    if "@" in token:
        return 90 + min(3, token.count(".")) + 2 * token.startswith("@")
    digits, dots = len(token) - len(token.translate(_NO_DIGITS)), token.count(".")
    size = (digits > 3) + (digits > 6) + (digits > 9) + (digits > 15)
    return (((before == "+" or token[0] == "+") * 5 + size) * 3 + min(2, dots)) * 2 + (digits < len(token) - dots)


def _keys(token: str, whole: str) -> tuple[str, str]:
    """What tokens must share to be equal, and to be similar; empty for nothing. ``whole``: the base span around."""
    if "@" in token:
        address = (whole if "@" in whole else token).strip(".").lower()
        name = address.split("@")[0]
        return address, "@" + name if len(name) >= 3 else ""
    digits = _ONLY_DIGITS.sub("", whole or token)
    return digits if len(digits) >= 6 else "", digits[-7:] if len(digits) >= 7 else ""


class Field:
    """Nodes and edges of many texts; no edge leaves its text."""

    def __init__(self, texts: list[str]) -> None:
        self.base = [base_spans(t) if t else [[], [], [], []] for t in texts]
        self.tokens: list[tuple[int, int]] = []
        self.owner: list[int] = []
        shapes: list[int] = []
        labels: list[int] = []
        edges: dict[str, list[int]] = {"chain": [], "equal": [], "similar": []}
        self.before: dict[str, list[int]] = {"equal": [], "similar": []}  # (node before, node) of each group
        for n, (text, base) in enumerate(zip(texts, self.base, strict=True)):
            if "@" in text or _digit.search(text):
                self._add(n, text, base, shapes, labels, edges)
        self.shapes, self.labels = np.array(shapes, dtype=np.int64), np.array(labels, dtype=np.int64)
        self.edges = {k: np.array(v, dtype=np.int64).reshape(-1, 2) for k, v in edges.items()}

    def _add(self, n: int, text: str, base: list, shapes: list, labels: list, edges: dict) -> None:
        spans = sorted((a, b, kind + 1) for kind, found in enumerate(base) for a, b in found)
        seen: dict[str, dict[str, tuple[int, int]]] = {"equal": {}, "similar": {}}
        at = end = 0
        for a, b in _tokens(text):
            while at < len(spans) and spans[at][1] <= a:
                at += 1
            inside = at < len(spans) and spans[at][0] < b
            i, token = len(shapes), text[a:b]
            self.tokens.append((a, b))
            self.owner.append(n)
            shapes.append(_shape(token, text[a - 1] if a else ""))
            labels.append(spans[at][2] if inside else 0)
            if end and a - end <= 3 and self.owner[i - 1] == n and _beside.fullmatch(text, end, a):
                edges["chain"] += (i - 1, i)
            end = b
            equal, similar = _keys(token, text[spans[at][0] : spans[at][1]] if inside else "")
            for name, key in (("equal", equal), ("similar", similar)):
                if key:
                    own = seen[name]
                    if key in own:
                        first, last = own[key]
                        edges[name] += (last, i) if first == last else (last, i, first, i)
                        self.before[name] += (last, i)
                        own[key] = (first, i)
                    else:
                        own[key] = (i, i)

    def configurations(self) -> tuple[np.ndarray, np.ndarray]:
        """(code, count) of labelled tokens with their neighbours' labels: shape, left, right, equal, similar, own."""
        n = len(self.shapes)
        near = {k: np.full(n, NONE, dtype=np.int64) for k in ("left", "right", "equal", "similar")}
        chain = self.edges["chain"]
        near["left"][chain[:, 1]], near["right"][chain[:, 0]] = self.labels[chain[:, 0]], self.labels[chain[:, 1]]
        for k in ("equal", "similar"):
            pair = np.array(self.before[k], dtype=np.int64).reshape(-1, 2)
            near[k][pair[:, 0]] = self.labels[pair[:, 1]]
            near[k][pair[:, 1]] = self.labels[pair[:, 0]]
        tied = (self.labels == 0) & (((near["equal"] > 0) & (near["equal"] < NONE)) | ((near["similar"] > 0) & (near["similar"] < NONE)))
        code = self.shapes
        for k in ("left", "right", "equal", "similar"):
            code = code * 6 + near[k]
        return np.unique((code * N_LABELS + self.labels)[~tied], return_counts=True)

    def _tied(self) -> np.ndarray:
        """Whether equal and similar edges lead from a node to a clamped one."""
        edges = np.concatenate([self.edges["equal"], self.edges["similar"]])
        group = np.arange(len(self.labels))  # the smallest node that is reached; groups have a center, so few rounds do
        while len(edges):
            low = np.minimum(group[edges[:, 0]], group[edges[:, 1]])
            new = group.copy()
            np.minimum.at(new, edges[:, 0], low)
            np.minimum.at(new, edges[:, 1], low)
            new = new[new]
            if (new == group).all():
                break
            group = new
        clamped = np.zeros(len(group), dtype=bool)
        clamped[group[self.labels > 0]] = True
        return clamped[group]

    def added(self, weights: dict[str, np.ndarray]) -> list[list[tuple[int, int, int]]]:
        """(kind, start, end) by text of the tokens that the field labels beyond the base spans; neighbours as one."""
        out: list[list[tuple[int, int, int]]] = [[] for _ in self.base]
        if not len(self.shapes):
            return out
        potential = weights["shape"][self.shapes].copy()
        clamped = np.flatnonzero(self.labels)
        potential[clamped] = -30.0
        potential[clamped, self.labels[clamped]] = 0.0
        names, weights = ("chain", "equal", "similar"), fair(weights)
        pairs = np.concatenate([self.edges[k] for k in names])
        kinds = np.repeat(np.arange(3), [len(self.edges[k]) for k in names])
        p = propagate(potential, pairs, np.stack([weights[k] for k in names]), kinds)
        best = p.argmax(axis=1)
        sure = np.flatnonzero((best > 0) & (self.labels == 0) & (p[np.arange(len(p)), best] >= SURE) & self._tied())
        beside = {(int(a), int(b)) for a, b in self.edges["chain"]} if len(sure) else set()
        last = -1
        for i in sure.tolist():
            spans, kind = out[self.owner[i]], int(best[i]) - 1
            a, b = self.tokens[i]
            if last >= 0 and (last, i) in beside and spans and spans[-1][0] == kind:
                spans[-1] = (kind, spans[-1][1], b)
            else:
                spans.append((kind, a, b))
            last = i
        return out


def fair(weights: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """Weights in which tied tokens share 'no personal data' at least as strongly as any kind."""
    out = {k: v.copy() for k, v in weights.items()}
    for k in SAME:
        out[k][0, 0] = out[k].diagonal().max()
    return out


def propagate(unary: np.ndarray, pairs: np.ndarray, tables: np.ndarray, kinds: np.ndarray) -> np.ndarray:
    """Marginals by damped loopy belief propagation: nodes x labels, edges (i, j), log potentials by edge kind."""
    source, target = np.concatenate([pairs[:, 0], pairs[:, 1]]), np.concatenate([pairs[:, 1], pairs[:, 0]])
    n, e = len(unary), len(pairs)
    table = np.concatenate([tables, tables.transpose(0, 2, 1)])
    kind = np.concatenate([kinds, kinds + len(tables)]).astype(np.int64)
    m = np.zeros((2 * e, unary.shape[1]))
    belief = unary

    def gather() -> np.ndarray:
        return unary + np.stack([np.bincount(target, weights=m[:, k], minlength=n) for k in range(unary.shape[1])], axis=1)

    for _ in range(ROUNDS if e else 0):
        new = np.empty_like(m)
        for a in range(0, 2 * e, BLOCK):
            own = np.arange(a, min(2 * e, a + BLOCK))
            x = table[kind[own]] + (belief[source[own]] - m[(own + e) % (2 * e)])[:, :, None]
            top = x.max(axis=1)
            y = top + np.log(np.exp(x - top[:, None, :]).sum(axis=1))
            new[own] = y - y.max(axis=1, keepdims=True)
        m = DAMPING * m + (1 - DAMPING) * new
        belief = gather()
    p = np.exp(belief - belief.max(axis=1, keepdims=True))
    return p / p.sum(axis=1, keepdims=True)


def fit(codes: np.ndarray, counts: np.ndarray, steps: int = 400, rate: float = 0.05, prior: float = 0.5) -> dict[str, np.ndarray]:
    """Weights that maximize the pseudo-likelihood of counted configurations, with a Gaussian prior.

    Gradient ascent with Adam's steps from the prior's means; a weight that no configuration touches stays there.
    """
    start = {"shape": NOTHING * np.eye(N_LABELS)[np.zeros(N_SHAPES, dtype=int)], "chain": np.zeros((N_LABELS, N_LABELS)), **{k: v * np.eye(N_LABELS) for k, v in SAME.items()}}
    own, rest = codes % N_LABELS, codes // N_LABELS
    near = {}
    for k in ("similar", "equal", "right", "left"):
        near[k], rest = rest % 6, rest // 6
    shape, heavy = rest, np.log1p(counts.astype(float))
    pad = lambda w: np.vstack([w, np.zeros((1, N_LABELS))])
    w = {k: v.copy() for k, v in start.items()}
    first, second = ({k: np.zeros_like(v) for k, v in w.items()} for _ in range(2))
    for t in range(1, steps + 1):
        score = w["shape"][shape] + pad(w["chain"])[near["left"]] + pad(w["chain"].T)[near["right"]] + pad(w["equal"])[near["equal"]] + pad(w["similar"])[near["similar"]]
        p = np.exp(score - score.max(axis=1, keepdims=True))
        g = -p / p.sum(axis=1, keepdims=True)
        g[np.arange(len(own)), own] += 1
        g *= heavy[:, None]
        grad = {k: np.zeros((len(v) + 1, N_LABELS)) for k, v in w.items()}
        np.add.at(grad["shape"], shape, g)
        np.add.at(grad["chain"], near["left"], g)
        back = np.zeros((N_LABELS + 1, N_LABELS))
        np.add.at(back, near["right"], g)
        for k in ("equal", "similar"):
            np.add.at(grad[k], near[k], g)
        grad = {k: v[:-1] for k, v in grad.items()}
        grad["chain"] += back[:-1].T
        for k in ("equal", "similar"):  # an edge has no direction
            grad[k] = (grad[k] + grad[k].T) / 2
        for k, v in w.items():
            d = grad[k] - prior * (v - start[k])
            first[k] = 0.9 * first[k] + 0.1 * d
            second[k] = 0.99 * second[k] + 0.01 * d * d
            v += rate * (first[k] / (1 - 0.9**t)) / (np.sqrt(second[k] / (1 - 0.99**t)) + 1e-8)
    return w


def train(docs: DataFrame) -> dict[str, np.ndarray]:
    """Weights from the configurations of all documents, summed by Spark; a bounded table of counts comes back."""

    def count(batch: pa.RecordBatch) -> pa.RecordBatch:
        codes, n = Field(batch.column("text").to_pylist()).configurations()
        return pa.RecordBatch.from_arrays([pa.array(codes, pa.int64()), pa.array(n, pa.int64())], ["code", "n"])

    rows = sorted(arrow_map(docs.select(text_of().alias("text")), count, "code long, n long").groupBy("code").agg(F.sum("n")).collect())
    table = np.array(rows, dtype=np.int64).reshape(-1, 2)
    return fit(table[:, 0], table[:, 1])


def find(docs: DataFrame, weights: dict[str, np.ndarray]) -> DataFrame:
    """Spans of every document: counts of the base ones, their digest, and all spans."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        field = Field(batch.column("text").to_pylist())
        rows = []
        for base, more in zip(field.base, field.added(weights), strict=True):
            own = [(k, a, b) for k, found in enumerate(base) for a, b in found]
            digest = hashlib.sha256(_join(own).encode()).hexdigest()
            rows.append((*map(len, base), digest, _join(sorted({*own, *more})), len(more)))
        columns = list(zip(*rows, strict=True))
        kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.int64()]
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_added"])

    return arrow_map(docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")), run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long")


def _join(spans) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in spans)


def redact_texts(texts: list[str], weights: dict[str, np.ndarray]) -> list[str]:
    """Texts with every span replaced by its kind in brackets; overlapping spans merge under the first's kind."""
    field, clean = Field(texts), []
    for text, base, more in zip(texts, field.base, field.added(weights), strict=True):
        spans = sorted([(a, b, k) for k, found in enumerate(base) for a, b in found] + [(a, b, k) for k, a, b in more])
        out, at = [], 0
        for a, b, k in spans:
            if a >= at:
                out += [text[at:a], f"[{KINDS[k].upper()}]"]
            at = max(at, b)
        clean.append("".join([*out, text[at:]]) if spans else text)
    return clean


def redact(docs: DataFrame, weights: dict[str, np.ndarray]) -> DataFrame:
    """``docs`` with personal data replaced in text, n_chars counted again, all else unchanged; null texts stay null."""

    def clean(batch: pa.RecordBatch) -> pa.RecordBatch:
        at = batch.schema.get_field_index("text")
        texts = batch.column(at).to_pylist()
        done = redact_texts([t or "" for t in texts], weights)
        new = pa.array([None if t is None else d for t, d in zip(texts, done, strict=True)], batch.schema.field(at).type)
        return pa.RecordBatch.from_arrays([new if i == at else c for i, c in enumerate(batch.columns)], schema=batch.schema)

    # names without dots for the tasks, the user's names after them
    plain = docs.toDF(*[c if c == "text" else f"_{i}" for i, c in enumerate(docs.columns)])
    out = arrow_map(plain, clean, plain.schema).toDF(*docs.columns)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def op2_pii_skip_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return find(docs, train(docs))
