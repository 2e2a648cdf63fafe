"""Best-fit packing of documents into training sequences by fitted length patterns.

1. Every text is tokenized once; a document longer than a sequence is cut into whole sequences, only its first piece
   may be shorter. The pieces (no texts, no ids) are written to the shared folder.
2. The histogram of piece lengths, at most ``capacity`` numbers, goes to the driver. Few-document patterns (pairs,
   triples and quadruples that fill a sequence) are enumerated over it; a non-negative least-squares fit gives how
   often each is used, rounded down. What is left over is packed best-fit decreasing, still on the histogram.
3. The plan, a bounded table of (length, range of ranks, first sequence, offset), places every piece by its rank
   among the pieces of its length. Ranks are counted in buckets of doc_id hashes, so that a length that a third of
   all pieces share is dealt over many tasks.

Nulls: a null text is empty and has the end id only; a null doc_id is kept as null. Repeated rows are packed each on
its own. An empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import arrow_map, documents, materialize, text_of
from .tokenizing import encoder

CAPACITY = 2048
#: Patterns that the fit may use and that the plan may hold; residual packing takes all that they leave.
MOST_CANDIDATES, MOST_PATTERNS = 150_000, 20_000
ROWS_PER_BUCKET = 20_000
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces_of(docs: DataFrame, tokenizer: str, end_id: int, capacity: int = CAPACITY, spaced: bool = True) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): the pieces of every whole text, end id included."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids, counts = encoder(tokenizer, spaced).encode(batch.column("text").to_pylist(), end_id)
        ids = ids.astype("<u4")
        n = -(-counts // capacity)
        row = np.repeat(np.arange(len(counts)), n)
        piece = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        first = (counts - (n - 1) * capacity)[row]
        start = np.where(piece == 0, 0, first + (piece - 1) * capacity)
        length = np.where(piece == 0, first, capacity)
        at = (np.cumsum(counts) - counts)[row] + start
        crc = [zlib.crc32(ids[a:b]) for a, b in zip(at, at + length, strict=True)]
        return pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(row)), pa.array(piece, pa.int32()), pa.array(start), pa.array(length), pa.array(crc, pa.int64())], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return arrow_map(docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")), run, PIECES)


def enumerate_patterns(lengths: np.ndarray, capacity: int, most: int) -> np.ndarray:
    """Patterns of two to four present lengths that leave little of a sequence unused, one row each, -1 for none.

    Every pair (a, b) that fits is extended by the longest lengths that still fit; at most ``most`` rows, evenly
    over the pairs, those that fill sequences first.
    """
    n = len(lengths)
    if not n:
        return np.zeros((0, 4), dtype=np.int64)
    longest = np.searchsorted(lengths, np.arange(capacity + 1), "right") - 1  # index of the longest that fits, or -1
    a, b = np.meshgrid(np.arange(n), np.arange(n), indexing="ij")
    fits = (b <= a) & (lengths[a] + lengths[b] <= capacity)
    a, b = a[fits], b[fits]
    rest = capacity - lengths[a] - lengths[b]
    c = np.minimum(longest[rest], b)
    rest = rest - np.where(c >= 0, lengths[c], 0)
    d = np.where(c >= 0, np.minimum(longest[rest], c), -1)
    rest = rest - np.where(d >= 0, lengths[d], 0)
    rows = np.stack([a, b, c, d], axis=1)
    full = np.flatnonzero(rest == 0)
    near = np.flatnonzero((rest > 0) & (rest <= capacity // 100))
    picked = full if len(full) >= most else np.concatenate([full, near])
    if len(picked) > most:
        picked = picked[np.linspace(0, len(picked) - 1, most).astype(np.int64)]
    alone = np.flatnonzero(lengths == capacity)
    single = np.stack([alone, *[np.full(len(alone), -1)] * 3], axis=1)
    return np.concatenate([single, rows[picked]])


def fit_counts(patterns: np.ndarray, lengths: np.ndarray, histogram: np.ndarray, steps: int = 400) -> np.ndarray:
    """Non-negative least squares: repeat counts x with A x close to the histogram, long pieces weighing more.

    Multiplicative updates x <- x * (A'W h) / (A'W A x) keep x non-negative and lower the weighted squared error in
    every step. The result is then scaled pattern by pattern so that no length is used more often than it occurs.
    """
    if not len(patterns):
        return np.zeros(0)
    n, width = len(histogram), patterns.shape[1]
    where = np.where(patterns >= 0, patterns, n)
    weight = np.append((lengths / lengths.max()) ** 2, 0.0)
    target = np.append(histogram.astype(float), 0.0)
    aim = (weight * target)[where].sum(axis=1)
    x = target[np.where(patterns >= 0, patterns, patterns[:, :1])].min(axis=1) * width / len(patterns) + 1e-9
    made = target
    for _ in range(steps):
        made = np.bincount(where.ravel(), weights=np.repeat(x, width), minlength=n + 1)
        x = x * aim / np.maximum((weight * made)[where].sum(axis=1), 1e-12)
    made = np.bincount(where.ravel(), weights=np.repeat(x, width), minlength=n + 1)
    share = np.minimum(1.0, target / np.maximum(made, 1e-12))
    share[n] = 1.0
    return x * share[where].min(axis=1)


def plan_sequences(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[list[int], int]]:
    """[(lengths of a pattern, longest first; repeats)] that places every piece of the histogram exactly once."""
    lengths = np.array(sorted(k for k, v in histogram.items() if v > 0), dtype=np.int64)
    left = np.array([histogram[int(k)] for k in lengths], dtype=np.int64)
    most = int(min(MOST_CANDIDATES, max(256, left.sum() // 20)))
    patterns = enumerate_patterns(lengths, capacity, most)
    repeats = np.floor(fit_counts(patterns, lengths, left) + 1e-6).astype(np.int64)
    plan: list[tuple[list[int], int]] = []
    for i in np.argsort(-repeats, kind="stable")[:MOST_PATTERNS]:
        if not repeats[i]:
            break
        own, times = np.unique(patterns[i][patterns[i] >= 0], return_counts=True)
        k = int(min(repeats[i], (left[own] // times).min()))
        if k > 0:
            left[own] -= k * times
            plan.append((lengths[patterns[i][patterns[i] >= 0]].tolist(), k))
    # the residual, best fit decreasing; each step uses up what some length has
    counts = {int(k): int(v) for k, v in zip(lengths, left, strict=True) if v}
    present = sorted(counts)
    while present:
        own: dict[int, int] = {}
        rest = capacity
        while (at := bisect_right(present, rest) - 1) >= 0:
            k = present[at]
            while at >= 0 and counts[k := present[at]] <= own.get(k, 0):
                at -= 1
            if at < 0:
                break
            more = min(rest // k, counts[k] - own.get(k, 0))
            own[k] = own.get(k, 0) + more
            rest -= more * k
        times = min(counts[k] // m for k, m in own.items())
        for k, m in own.items():
            counts[k] -= times * m
            if not counts[k]:
                present.remove(k)
        plan.append((sorted((k for k, m in own.items() for _ in range(m)), reverse=True), times))
    return plan


def plan_table(plan: list[tuple[list[int], int]]) -> dict[int, np.ndarray]:
    """By length: rows (first rank, pieces per sequence, first sequence, offset of the first piece), ascending.

    Piece of rank r in a row with m pieces per sequence goes to sequence first + (r - rank) // m, and stands
    ((r - rank) mod m) * length after the row's offset.
    """
    rows: dict[int, list[tuple[int, int, int, int]]] = {}
    used: dict[int, int] = {}
    sequence = 0
    for own, times in plan:
        offset = 0
        for k in dict.fromkeys(own):
            m = own.count(k)
            rows.setdefault(k, []).append((used.get(k, 0), m, sequence, offset))
            used[k] = used.get(k, 0) + m * times
            offset += m * k
        sequence += times
    return {k: np.array(v, dtype=np.int64) for k, v in rows.items()}


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Place materialized pieces: adds sequence_id and offset."""
    counts = {int(r[0]): int(r[1]) for r in pieces.groupBy("length").count().collect()}  # at most ``capacity`` rows
    table = plan_table(plan_sequences(counts, capacity))
    spark = pieces.sparkSession
    buckets = max(64, sum(counts.values()) // ROWS_PER_BUCKET)
    keyed = pieces.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(buckets)))
    # rank = pieces of this length in lower buckets + place in the own bucket; few rows for each length and bucket
    sizes = keyed.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    before = sizes.select("length", "bucket", (F.sum("n").over(Window.partitionBy("length").orderBy("bucket")) - F.col("n")).alias("lower"))
    place = Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32")
    ranked = keyed.withColumn("own", F.row_number().over(place) - 1).join(before, ["length", "bucket"]).withColumn("rank", F.col("lower") + F.col("own"))
    shared = spark.sparkContext.broadcast(table)  # bounded by MOST_PATTERNS and the residual's steps

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        length, rank = (batch.column(c).to_numpy() for c in ("length", "rank"))
        order = np.argsort(length, kind="stable")
        sequence, offset = np.zeros(len(length), dtype=np.int64), np.zeros(len(length), dtype=np.int64)
        keys, starts = np.unique(length[order], return_index=True)
        for k, i, j in zip(keys, starts, [*starts[1:], len(order)], strict=True):
            rows, at = shared.value[int(k)], order[i:j]
            row = rows[np.searchsorted(rows[:, 0], rank[at], "right") - 1]
            past = rank[at] - row[:, 0]
            sequence[at], offset[at] = row[:, 2] + past // row[:, 1], row[:, 3] + past % row[:, 1] * k
        return pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")), pa.array(sequence), pa.array(offset)], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    def each(batches):
        return (run(b) for b in batches if b.num_rows)

    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank").mapInArrow(each, f"{PIECES}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int = 0, capacity: int = CAPACITY) -> DataFrame:
    return pack(materialize(pieces_of(docs, tokenizer, end_id, capacity), "pieces"), capacity)


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack_documents(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))
