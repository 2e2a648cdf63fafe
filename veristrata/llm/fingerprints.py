"""Document fingerprints by locally consistent parsing.

A text's bytes are parsed into phrases, the phrases into longer phrases, and so on. Where a phrase begins depends only
on a few symbols around the place: deterministic coin tossing (twice) turns neighbouring symbols into labels from a
small set in which neighbours differ, and phrases begin at the labels' local minima; runs of one symbol are first made
one symbol. A phrase is named by a hash of its symbols. Equal substrings so have equal phrases except near their ends,
at whatever offset they stand. The fingerprint keeps, of the names of the levels SKETCHED and of the name of the whole
text, the smallest hash in each of BINS bins; likeness is the share of bins that two fingerprints agree on.

Nulls: a null text is empty. The empty fingerprint is like itself (1) and unlike all others (0). Null ids sort last
in the descending order. Rows that share a doc_id are ordered by their text's hash. A table of one row is its own
next document; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, fmix64, slices, text_of

BINS, LEVELS = 64, 9
SKETCHED = (3, 4, 5)
ROWS_PER_RANGE = 1_000
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def _coin(now: np.ndarray, before: np.ndarray) -> np.ndarray:
    """2 * (lowest bit in which a symbol differs from the one before) + that bit; symbols must differ."""
    x = now ^ before
    low = x & (~x + np.uint64(1))
    place = np.log2(low.astype(np.float64)).astype(np.uint64)
    return (place << np.uint64(1)) | ((now >> place) & np.uint64(1))


def _level(symbols: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Parse all texts of a batch one level up. ``first`` marks each text's first symbol."""
    n = len(symbols)
    # 1. runs of one symbol become one symbol that also tells the run's length
    change = np.ones(n, dtype=bool)
    change[1:] = (symbols[1:] != symbols[:-1]) | first[1:]
    at = np.flatnonzero(change)
    run = np.diff(np.append(at, n)).astype(np.uint64)
    s, head = symbols[at].copy(), first[at]
    long = run > 1
    if long.any():
        s[long] = fmix64(s[long] * _M1 + run[long])
        # a run's new symbol may equal a neighbour's by chance only
    # 2. coin tossing twice; the first symbol of a text is held against its own complement
    before = np.empty_like(s)
    before[1:] = s[:-1]
    before[head] = ~s[head]
    same = s == before
    before[same] = ~s[same]
    label = _coin(s, before)
    before[1:] = label[:-1]
    before[head] = label[head] + np.uint64(1)
    same = label == before
    before[same] = label[same] + np.uint64(1)
    label = _coin(label, before)
    # 3. phrases begin at local minima (strictly below the label before, not above the one after)
    begin = head.copy()
    if len(s) > 2:
        low = (label[1:-1] < label[:-2]) & (label[1:-1] <= label[2:])
        begin[1:-1] |= low & ~head[2:]
        follows = np.flatnonzero(begin[1:] & begin[:-1] & ~head[1:]) + 1
        begin[follows] = False
    starts = np.flatnonzero(begin)
    # 4. names: polynomial hash of a phrase's symbols, in order
    place = np.arange(len(s)) - np.repeat(starts, np.diff(np.append(starts, len(s))))
    weights = _powers(int(place.max()) + 1)[place]
    names = fmix64(np.add.reduceat(fmix64(s) * weights, starts)) if len(starts) else s
    return names, head[starts]


_power_table = np.ones(1, dtype=np.uint64)


def _powers(n: int) -> np.ndarray:
    global _power_table
    if len(_power_table) < n:
        _power_table = np.cumprod(np.concatenate([[np.uint64(1)], np.full(2 * n, _M2 | np.uint64(1), dtype=np.uint64)]), dtype=np.uint64)
    return _power_table


def sketches(texts: list[str]) -> np.ndarray:
    """(texts, BINS) smallest 32-bit values of the phrase names by bin, 2**32 for an empty bin."""
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    sizes = np.array([len(r) for r in raw], dtype=np.int64)
    out = np.full((len(texts), BINS), 1 << 32, dtype=np.int64)
    some = np.flatnonzero(sizes)
    if not len(some):
        return out
    symbols = np.frombuffer(b"".join(raw), dtype=np.uint8).astype(np.uint64) + np.uint64(1)
    first = np.zeros(len(symbols), dtype=bool)
    first[(np.cumsum(sizes) - sizes)[some]] = True

    def note(names: np.ndarray, owner: np.ndarray) -> None:
        h = fmix64(names ^ _M2)
        key = owner * BINS + (h & np.uint64(BINS - 1)).astype(np.int64)
        np.minimum.at(out.reshape(-1), key, (h >> np.uint64(32)).astype(np.int64))

    # every text goes through all levels, so its names do not depend on the texts beside it
    for level in range(1, LEVELS + 1):
        symbols, first = _level(symbols, first)
        owner = some[np.cumsum(first) - 1]
        if level in SKETCHED:
            note(symbols, owner)
    # what is left of a text at the last level stands for the whole
    starts = np.flatnonzero(first)
    weights = _powers(int(np.diff(np.append(starts, len(symbols))).max()) + 1)
    place = np.arange(len(symbols)) - np.repeat(starts, np.diff(np.append(starts, len(symbols))))
    note(fmix64(np.add.reduceat(fmix64(symbols) * weights[place], starts)), some)
    return out


def fingerprint(sketch: np.ndarray) -> str:
    """Hex text of a sketch: eight digits a bin, dots for an empty bin; empty if all bins are."""
    return "".join("........" if v >> 32 else f"{v:08x}" for v in sketch.tolist()) if (sketch < 1 << 32).any() else ""


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Share of the bins used by either sketch that agree."""
    used = (a < 1 << 32) | (b < 1 << 32)
    return float(((a == b) & used).sum() / used.sum()) if used.any() else 1.0


def edit(text: str, following: str) -> str:
    """The last half of a text replaced by as much of the following text's beginning (or all of it)."""
    k = len(text) // 2
    return text[: len(text) - k] + following[:k]


def with_next(docs: DataFrame) -> DataFrame:
    """(range, guest, doc_id, text) such that, within a range in the order given, each row's next document follows it.

    Ids are cut into ranges of about ROWS_PER_RANGE rows; the first document of a range also goes, as a guest, to the
    end of the range before, so texts are shuffled once and no order over all rows is needed in one task.
    """
    spark = docs.sparkSession
    low = -(1 << 63)
    d = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(low)).alias("id"), text_of().alias("text"))
    n = d.count()
    k = max(1, min(20_000, n // ROWS_PER_RANGE))
    cuts = sorted({int(c) for c in d.approxQuantile("id", [i / k for i in range(1, k)], min(0.001, 0.2 / k))}) if k > 1 else []
    edges = F.array(*[F.lit(c) for c in cuts]) if cuts else None
    if len(cuts) > 512:  # a search in a long literal list would cost more than its Arrow round trip
        edges = None
    ranged = d.withColumn("range", F.size(F.filter(edges, lambda c: c <= F.col("id"))) if edges is not None else _range_of(d, cuts))
    tops = {r["range"]: r["top"] for r in ranged.groupBy("range").agg(F.max("id").alias("top")).collect()}  # a row per range
    order = sorted(tops, reverse=True)
    to = {tops[r]: order[i - 1] for i, r in enumerate(order)}  # the top of a range is a guest of the range above it
    places = spark.createDataFrame(list(to.items()), "top long, host int") if to else spark.createDataFrame([], "top long, host int")
    hosted = ranged.join(F.broadcast(places), ranged["id"] == places["top"], "left")
    copies = F.when(F.col("host").isNull(), F.array(F.struct(F.col("range").alias("range"), F.lit(False).alias("guest")))).otherwise(F.array(F.struct(F.col("range").alias("range"), F.lit(False).alias("guest")), F.struct(F.col("host").alias("range"), F.lit(True).alias("guest"))))
    rows = hosted.select("id", "text", F.explode(copies).alias("c")).select("c.range", "c.guest", "id", "text")
    return rows.repartition("range").sortWithinPartitions("range", "guest", F.desc("id"), F.xxhash64("text"))


def _range_of(d: DataFrame, cuts: list[int]):
    if not cuts:
        return F.lit(0)
    shared = np.array(cuts, dtype=np.int64)

    @F.pandas_udf("int")
    def find(ids: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(shared, ids.to_numpy(), "right").astype(np.int32))

    return find("id")


RESULT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def compare_with_next(docs: DataFrame) -> DataFrame:
    """Fingerprints of every document and of its edited text, and their likeness to each other and to the next."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []  # the last row, until its next document is here
        for batch in slices(batches):
            rows = held + list(zip(*(batch.column(c).to_pylist() for c in ("range", "guest", "id", "text")), strict=True))
            sketch = sketches([r[3] for r in rows])
            todo = [i for i in range(len(rows) - 1) if not rows[i][1]]
            edited = [edit(rows[i][3], rows[i + 1][3]) for i in todo]
            other = sketches(edited)
            out = []
            for j, i in enumerate(todo):
                out.append((rows[i][2] if rows[i][2] != -(1 << 63) else None, len(rows[i][3]), hashlib.sha256(edited[j].encode("utf-8", "surrogatepass")).hexdigest(), fingerprint(sketch[i]), fingerprint(other[j]), likeness(sketch[i], other[j]), likeness(sketch[i], sketch[i + 1])))
            held = rows[-1:]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), [pa.int64(), pa.int64(), *[pa.string()] * 3, pa.float64(), pa.float64()], strict=True)], ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

    return with_next(docs).mapInArrow(run, RESULT)


def op9_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare_with_next(documents(spark, sf_dir))
