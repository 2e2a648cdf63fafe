"""Near-duplicate documents by min-max hashing, banding and confirmation on full shingle sets.

A document's set holds its distinct 5-word shingles (fewer words: the whole sequence; no words: empty). Under each
permutation both the smallest and the largest value are kept, so PERMUTATIONS evaluations give twice as many
signature values; ROWS of them make a band. Documents with equal word sequences form one class, which its smallest
doc_id stands for. Two representatives with an equal band are candidates, and a pair is linked if
100 * |A and B| >= 85 * |A or B| on the full sets. At that similarity a pair misses all bands with a chance of
(1 - 0.85**4)**20 = 4e-7.

No bucket is expanded into all of its pairs, and no candidate pair is left undecided unless its ends already share a
component. Each bucket has a center z, the member that shares most buckets, and every member is compared with it.
Let D(x) be the symmetric difference of the sets of x and z. Two members m and c that are linked although m is not
linked to z must have more than (|D(c)| - t (|c| - |z|)) / 2 elements of D(m) and D(c) in common, t = 3 / 37: from
|m ^ c| = |D(m)| + |D(c)| - 2 |D(m) & D(c)| <= t (|m| + |c|) and |D(m)| > t (|m| + |z|). So D(m) meets the first
|D(c)| - that + 1 elements of D(c) in any fixed order; those that z does not have come first, as edits make them
rare. An equi-join on (z, element) finds these pairs, and only where z's members have several components. Within it
a positional filter drops pairs whose differences have too few elements left after the shared one.

Nulls: a null text is empty, linked with nothing and its own component; a null doc_id has a null component unless
its class has another. Repeated rows of one document are one node, as are rows that share a doc_id with different
texts: each text makes links of its own. Very long texts are compared whole. Ties: the smallest doc_id names a component
and is kept; of two centers with as many buckets the one with the smaller id is taken. Empty tables give empty
results; extra columns are ignored, and kept by ``keep_first``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_map, documents, fmix64, materialize, spread_join, text_of, word_hashes
from .components import connected_components

WIDTH, SHARE = 5, 85
PERMUTATIONS, ROWS = 40, 4
SIGNED = "doc_id long, n_shingles long, key_a long, key_b long, bands array<bigint>"

_odd = np.random.default_rng(20_240_501).integers(1 << 62, size=(2, PERMUTATIONS), dtype=np.int64).astype(np.uint64)
_MULTIPLY, _ADD = _odd[0] * np.uint64(2) + np.uint64(1), _odd[1]
_STEP = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63], dtype=np.uint64)


def words_of(text: str) -> list[bytes]:
    """Words of a text: A-Z lower-cased, split at [\\x20\\x09-\\x0D]+."""
    return text.encode("utf-8", "surrogatepass").lower().split()


def shingle_hashes(words: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit shingle hashes of all documents in a row, shingles of each), repeats included."""
    counts = np.array([len(w) for w in words], dtype=np.int64)
    flat = word_hashes([x for w in words for x in w])
    if not len(flat):
        return np.zeros(0, dtype=np.uint64), np.zeros(len(words), dtype=np.int64)
    n = np.where(counts >= WIDTH, counts - WIDTH + 1, (counts > 0).astype(np.int64))
    begin = np.cumsum(counts) - counts
    at = np.repeat(begin - (np.cumsum(n) - n), n) + np.arange(n.sum())
    short = np.repeat(counts < WIDTH, n)
    out = np.zeros(len(at), dtype=np.uint64)
    size = np.repeat(np.minimum(counts, WIDTH), n)
    padded = np.concatenate([flat, np.zeros(WIDTH, dtype=np.uint64)])
    for k in range(WIDTH):
        part = padded[at + k] * _STEP[k]
        out += np.where(size > k, part, np.uint64(0)) if short.any() else part
        out = fmix64(out) if k == WIDTH - 1 else out ^ (out >> np.uint64(29))
    return np.where(short, fmix64(out ^ size.astype(np.uint64)), out) if short.any() else out, n


def signatures(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Minimum and maximum of each permutation for every document with shingles: (documents, 2 * PERMUTATIONS)."""
    starts = (np.cumsum(counts) - counts)[counts > 0]
    out = np.zeros((len(starts), 2 * PERMUTATIONS), dtype=np.uint64)
    if not len(starts):
        return out
    for k in range(PERMUTATIONS):
        x = hashes * _MULTIPLY[k] + _ADD[k]
        x ^= x >> np.uint64(32)
        out[:, 2 * k] = np.minimum.reduceat(x, starts)
        out[:, 2 * k + 1] = np.maximum.reduceat(x, starts)
    return out


def band_keys(signature: np.ndarray) -> np.ndarray:
    bands = signature.reshape(len(signature), -1, ROWS)
    out = np.repeat(np.arange(bands.shape[1], dtype=np.uint64)[None, :] * _STEP[0], len(signature), axis=0)
    for k in range(ROWS):
        out = fmix64(out * _STEP[1] + bands[:, :, k])
    return out.view(np.int64)


def sign(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, key of the word sequence, band keys) of every row."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        from xxhash import xxh3_128_digest

        words = [words_of(t) for t in batch.column("text").to_pylist()]
        hashes, counts = shingle_hashes(words)
        bands = np.zeros((len(words), 2 * PERMUTATIONS // ROWS), dtype=np.int64)
        bands[counts > 0] = band_keys(signatures(hashes, counts))
        ends = np.cumsum(counts)
        distinct = [len(np.unique(hashes[e - c : e])) for e, c in zip(ends, counts, strict=True)]
        keys = np.frombuffer(b"".join(xxh3_128_digest(b" ".join(w)) for w in words), dtype=np.int64).reshape(-1, 2)
        some = counts > 0
        offsets = np.concatenate([[0], np.cumsum(np.where(some, bands.shape[1], 0))]).astype(np.int32)
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(distinct, pa.int64()), pa.array(keys[:, 0]), pa.array(keys[:, 1]), pa.ListArray.from_arrays(pa.array(offsets), pa.array(bands[some].ravel()))], ["doc_id", "n_shingles", "key_a", "key_b", "bands"])

    return arrow_map(docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")), run, SIGNED)


def _with_texts(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Pairs (a, b, ...) with both texts; rows of one ``a`` mostly stand together in a task."""
    both = pairs.join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b")), "b")
    return both.join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a")), "a")


class _Latest:
    """A function of a text that is not called again while the text stays the same."""

    def __init__(self, make) -> None:
        self.make, self.text, self.value = make, None, None

    def __call__(self, text: str):
        if self.text is None or text != self.text:
            self.text, self.value = text, self.make(text)
        return self.value


def _confirm(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """(a, b, linked) for pairs (a, b), from the full shingle sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left = _Latest(_set)
        for batch in batches:
            out = []
            for i in range(batch.num_rows):
                own = left(batch.column("text_a")[i].as_py())
                other = _set(batch.column("text_b")[i].as_py())
                common = len(own & other)
                out.append(bool(other) and 100 * common >= SHARE * (len(own) + len(other) - common))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(out, pa.bool_())], ["a", "b", "linked"])

    return _with_texts(pairs, texts).select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long, linked boolean")


def _set(text: str) -> set:
    w = words_of(text)
    return set(zip(w, w[1:], w[2:], w[3:], w[4:], strict=False)) if len(w) >= WIDTH else {tuple(w)} if w else set()


def _deltas(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """(z, element, node, label, probe, after, d, size) from pairs (a = z, b = node, label, apart).

    The elements that a node's set and z's do not share, with the number of elements after each in the order, the
    size of the difference and of the node's set. Index rows hold the prefix of each difference; a node apart from z
    also gets a probe row per element.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left = _Latest(lambda t: np.unique(shingle_hashes([words_of(t)])[0]))
        for batch in batches:
            z, nodes, labels = (batch.column(c).to_pylist() for c in ("a", "b", "label"))
            for i, apart in enumerate(batch.column("apart").to_pylist()):
                own = left(batch.column("text_a")[i].as_py())
                other = np.unique(shingle_hashes([words_of(batch.column("text_b")[i].as_py())])[0])
                more, less = np.setdiff1d(other, own, assume_unique=True), np.setdiff1d(own, other, assume_unique=True)
                n = len(more) + len(less)
                if not n:
                    continue
                # more than (n - t (|c| - |z|)) / 2 with t = 3 / 37, in whole numbers
                need = max(1, (37 * n - 3 * (len(other) - len(own))) // 74 + 1)
                elements = np.concatenate([more, less])
                at = np.arange(n)
                where = np.concatenate([at[: max(0, n - need + 1)], at]) if apart else at[: max(0, n - need + 1)]
                same = lambda v: pa.array(np.full(len(where), v, dtype=np.int64))  # noqa: B023, E731
                yield pa.RecordBatch.from_arrays([same(z[i]), pa.array(elements[where].view(np.int64)), same(nodes[i]), same(labels[i]), pa.array(np.arange(len(where)) >= n - need + 1), pa.array(n - 1 - where), same(n), same(len(other))], _DELTA_NAMES)

    return _with_texts(pairs, texts).select("a", "b", "label", "apart", "text_a", "text_b").mapInArrow(run, _DELTAS)


_DELTAS = "z long, element long, node long, label long, probe boolean, after long, d long, size long"
_DELTA_NAMES = ["z", "element", "node", "label", "probe", "after", "d", "size"]
#: Ids (8 bytes) up to which the documents to compare are told to all tasks; more are joined by a shuffle.
MOST_TOLD = 2_000_000


def _label(df: DataFrame, labels: DataFrame, node: str, label: str) -> DataFrame:
    return df.join(labels.select(F.col("node").alias(node), F.col("component").alias(label)), node, "left").withColumn(label, F.coalesce(label, node))


def near_duplicate_links(classes: DataFrame, docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(representatives' components as (node, component), confirmed links (a, b) between representatives)."""
    members = materialize(classes.where("node IS NOT NULL").select("node", F.explode("bands").alias("bucket")).distinct(), "bands")
    crowded = materialize(members.groupBy("bucket").agg(F.count("*").alias("crowd")).where("crowd > 1"), "crowded")
    total = members.count()
    live = materialize(spread_join(members, crowded, ["bucket"], "crowd", total), "live")
    degree = live.groupBy("node").agg(F.sum("crowd").alias("degree"))
    # every bucket's center, and its pairs with the other members
    centers = live.join(degree, "node").groupBy("bucket").agg(F.max_by("node", F.struct("degree", -F.col("node"))).alias("z"), F.count("*").alias("n"))
    star = spread_join(live, materialize(centers, "centers"), ["bucket"], "n", total).where("node <> z").select(F.col("z").alias("a"), F.col("node").alias("b"))
    star = materialize(star.distinct(), "star")
    wanted = star.select(F.col("a").alias("doc_id")).union(star.select(F.col("b").alias("doc_id"))).distinct()
    wanted = materialize(wanted, "wanted")
    told = F.broadcast(wanted) if wanted.count() <= MOST_TOLD else wanted
    texts = materialize(docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")).join(told, "doc_id", "left_semi"), "texts")
    links = materialize(_confirm(star, texts).where("linked").select("a", "b").distinct(), "links")
    labels = connected_components(links)
    apart = _label(_label(star, labels, "a", "label_a"), labels, "b", "label_b").withColumn("apart", F.col("label_a") != F.col("label_b"))
    mixed = apart.where("apart").select("a").distinct()
    todo = materialize(apart.join(mixed, "a", "left_semi").select("a", "b", F.col("label_b").alias("label"), "apart"), "apart")
    if todo.isEmpty():
        return labels, links
    deltas = materialize(_deltas(todo, texts), "deltas")
    side = lambda x: [F.col(c).alias(f"{c}_{x}") for c in ("node", "label", "after", "d", "size")] + ["z", "element"]
    probe, index = deltas.where("probe").select(*side("m")), deltas.where("NOT probe").select(*side("c"))
    # 2 |D(m) & D(c)| >= d_m + d_c - t (|m| + |c|), and after the first shared element there are at most as many more
    enough = F.expr("74 * (1 + least(after_m, after_c)) >= 37 * (d_m + d_c) - 3 * (size_m + size_c)")
    alike = [probe["z"] == index["z"], probe["element"] == index["element"], F.col("label_m") != F.col("label_c"), enough]
    met = probe.join(index, alike).select(F.least("node_m", "node_c").alias("a"), F.greatest("node_m", "node_c").alias("b")).distinct()
    more = materialize(_confirm(materialize(met, "met"), texts).where("linked").select("a", "b").distinct(), "links")
    links = links.union(more)
    return connected_components(links), links


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept, key_a, key_b) of every row of ``docs`` (doc_id, text)."""
    signed = materialize(sign(docs), "signed")
    first = F.min_by(F.struct("n_shingles", "bands"), "doc_id")
    classes = signed.where("n_shingles > 0").groupBy("key_a", "key_b").agg(F.min("doc_id").alias("node"), F.count("*").alias("n"), first.alias("first"))
    classes = materialize(classes.select("key_a", "key_b", "node", "n", "first.bands"), "classes")
    labels, _ = near_duplicate_links(classes, docs)
    found = classes.join(labels, "node", "left").select("key_a", "key_b", "n", F.coalesce("component", "node").alias("component"))
    rows = signed.select("doc_id", "n_shingles", "key_a", "key_b")
    out = spread_join(rows, materialize(found, "found"), ["key_a", "key_b"], "n", signed.count(), "left")
    component = F.when(F.col("n_shingles") > 0, F.col("component")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), (F.col("doc_id").eqNullSafe(component)).alias("kept"), "key_a", "key_b")


def keep_first(docs: DataFrame) -> DataFrame:
    """One document of each group: rows of ``docs``, all columns, whose doc_id is its component's smallest.

    Rows repeated under one doc_id and text count as copies: one of them stays. Rows without a doc_id stay.
    """
    found = near_duplicates(docs.where("doc_id IS NOT NULL")).where("kept").select("doc_id").distinct()
    kept = docs.join(found, "doc_id", "left_semi").select(docs.columns).dropDuplicates(["doc_id", "text"])
    return kept.unionByName(docs.where("doc_id IS NULL"))


def op5_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir)).select("doc_id", "n_shingles", "component_id", "kept")
