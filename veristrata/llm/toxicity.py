"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features are the distinct words, word pairs and pairs with one word between them, hashed to 2**BITS slots, each of
value 1. Training follows McMahan et al.: per-coordinate learning rates and an L1 term that leaves most weights at
zero, so that the model is a short table of (slot, weight) that is broadcast. It is fitted on at most
``MOST_EXAMPLES`` labelled documents, those with the smallest hash of their id, in that order; all documents are
scored. Labels, language, source and id are never inputs of a score.

Nulls: a null text is empty and scores the bias alone; a null doc_id is scored and counts as not held out. Labels
given twice: toxic wins; null labels are left out. Without any label every score is 0.5. Repeated rows score alike;
an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_map, documents, fmix64, text_of, word_hashes

BITS = 20
MOST_EXAMPLES = 12_000
EPOCHS, RATE, BETA, L1, L2 = 5, 1.0, 1.0, 8.0, 0.1
THRESHOLD = 0.3
_KEEP = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63], dtype=np.uint64)


def slots_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(slots of all texts, repeats included; the text of each slot)."""
    words = [t.encode("utf-8", "surrogatepass").translate(_KEEP).split() for t in texts]
    counts = np.array([len(w) for w in words], dtype=np.int64)
    h = word_hashes([x for w in words for x in w])
    of = np.repeat(np.arange(len(texts)), counts)
    grams, rows = [h * _MIX[0]], [of]
    for gap, (a, b) in ((1, (_MIX[1], _MIX[2])), (2, (_MIX[3], _MIX[4]))):
        same = of[:-gap] == of[gap:]
        grams.append((h[:-gap] * a + (h[gap:] ^ np.uint64(gap)) * b)[same])
        rows.append(of[:-gap][same])
    return (fmix64(np.concatenate(grams)) >> np.uint64(64 - BITS)).astype(np.int64), np.concatenate(rows)


def train_ftrl(texts: list[str], labels: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """(slots with a weight, weights, bias) after EPOCHS passes in the order given."""
    z, n = np.zeros(1 << BITS), np.zeros(1 << BITS)
    bias_z = bias_n = 0.0
    examples = []
    for at in range(0, len(texts), 200):
        slots, of = slots_of(texts[at : at + 200])
        order = np.argsort(of, kind="stable")
        cuts = np.searchsorted(of[order], np.arange(min(200, len(texts) - at) + 1))
        examples += [np.unique(slots[order[a:b]]).astype(np.int32) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]

    def weights(zi: np.ndarray, ni: np.ndarray) -> np.ndarray:
        return np.where(np.abs(zi) <= L1, 0.0, -(zi - np.sign(zi) * L1) / ((BETA + np.sqrt(ni)) / RATE + L2))

    for _ in range(EPOCHS):
        for i, y in zip(examples, labels, strict=True):
            w = weights(z[i], n[i])
            bias = -bias_z / ((BETA + bias_n**0.5) / RATE)
            g = 1 / (1 + np.exp(-np.clip(bias + w.sum(), -35, 35))) - y
            sigma = (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / RATE
            z[i] += g - sigma * w
            n[i] += g * g
            bias_z += g - ((bias_n + g * g) ** 0.5 - bias_n**0.5) / RATE * bias
            bias_n += g * g
    w = weights(z, n)
    kept = np.flatnonzero(w)
    return kept, w[kept], float(-bias_z / ((BETA + bias_n**0.5) / RATE))


def fit(docs: DataFrame, labels: DataFrame, most: int = MOST_EXAMPLES) -> DataFrame:
    """(slot, weight) with the bias at slot -1, from at most ``most`` of the labelled documents.

    ``labels``: doc_id, toxic. One task trains, on a sample whose size does not depend on the input.
    """
    marks = labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = marks.select("doc_id", "toxic", F.xxhash64("doc_id").alias("turn")).orderBy("turn", "doc_id").limit(most)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")).join(F.broadcast(chosen), "doc_id")

    def learn(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["turn", "doc_id", "text"]).drop_duplicates(["doc_id"])
        slots, w, bias = train_ftrl(pdf["text"].tolist(), pdf["toxic"].to_numpy(dtype=float))
        return pd.DataFrame({"slot": np.append(slots, -1), "weight": np.append(w, bias)})

    return rows.groupBy(F.lit(0).alias("all")).applyInPandas(lambda pdf: learn(pdf), "slot long, weight double")


def score(docs: DataFrame, model: DataFrame) -> DataFrame:
    """(doc_id, score) of every document. The model has at most 2**BITS rows and is broadcast as an array."""
    rows = model.collect()
    table = np.zeros(1 << BITS, dtype=np.float32)
    bias = 0.0
    for slot, weight in rows:
        if slot < 0:
            bias = weight
        else:
            table[slot] = weight
    shared = docs.sparkSession.sparkContext.broadcast(table)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        slots, of = slots_of(batch.column("text").to_pylist())
        hit = np.flatnonzero(shared.value[slots])
        pairs = np.unique((of[hit] << BITS) | slots[hit])
        logit = bias + np.bincount(pairs >> BITS, weights=shared.value[pairs & ((1 << BITS) - 1)], minlength=batch.num_rows)
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(1 / (1 + np.exp(-np.clip(logit, -35, 35))))], ["doc_id", "score"])

    return arrow_map(docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")), run, "doc_id long, score double")


def held_out(column: str = "doc_id"):
    """True for the rows whose labels are never learned from."""
    return F.coalesce(F.crc32(F.col(column).cast("string")) % 4 == 2, F.lit(False))


def op1_toxicity_ftrl(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(~held_out()).select("doc_id", "toxic")
    scored = score(docs, fit(docs, labels))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
