"""Corpus ingestion: chunks, sparse vectors, links, duplicates, quality of articles."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..session import materialize

# Words that sparse vectors leave out.
INDEX_STOP = ("the", "a", "an", "and", "or", "but", "in", "on", "at", "to", "for", "of", "with", "by", "is", "are", "was", "were", "be", "been", "it", "this", "that", "as", "from")
NAMESPACES = ("file", "image", "category", "template", "help", "portal", "wikipedia", "special", "talk", "user", "draft", "module", "mediawiki")


def chunk_fixed(docs: DataFrame, key: str, text: str = "text", size: int = 1400, step: int = 1220, least: int = 160, most: int = 200) -> DataFrame:
    """(key, chunk_index, start, chunk): windows of ``size`` every ``step`` characters; short ones are skipped."""
    d = docs.select(F.col(key), T.squeeze(F.col(text)).alias("_t"))
    d = d.select(key, "_t", F.explode(F.sequence(F.lit(0), F.greatest(F.length("_t") - 1, F.lit(0)), F.lit(step))).alias("start"))
    d = d.withColumn("chunk", F.substring(F.col("_t"), F.col("start") + 1, F.lit(size))).where(F.length("chunk") >= least)
    out = d.groupBy(key).agg(F.slice(F.sort_array(F.collect_list(F.struct("start", "chunk"))), 1, most).alias("c"))
    return out.select(key, F.posexplode("c").alias("chunk_index", "c")).select(key, "chunk_index", F.col("c.start").alias("start"), F.col("c.chunk").alias("chunk"))


def term_counts(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, token, n, length) of the index tokens of each text."""
    d = docs.select(key, T.index_tokens(F.col(text), INDEX_STOP).alias("_w"))
    return d.select(key, F.size("_w").alias("length"), F.explode("_w").alias("token")).groupBy(key, "token", "length").agg(F.count("*").alias("n"))


#: BM25's saturation, its share of the length, and the length of a middling text.
K1, B, MEAN_LENGTH = 1.2, 0.75, 500.0


def bm25_tf(counts: DataFrame, k1: float = K1, b: float = B, mean_length: float = MEAN_LENGTH) -> DataFrame:
    n, length = F.col("n"), F.col("length")
    return counts.withColumn("tf", n * (k1 + 1) / (n + k1 * (1 - b + b * (length / mean_length))))


def bm25_idf(counts: DataFrame, key: str, n_docs: int) -> DataFrame:
    df = counts.groupBy("token").agg(F.count("*").alias("df"))
    return df.withColumn("idf", F.greatest(F.log((n_docs - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1), F.lit(0.0)))


def cut_vocabulary(idf: DataFrame, size: int) -> DataFrame:
    """``idf`` (token, idf), cut to the ``size`` highest scores where it has more than 1.5 times as many rows."""
    return idf.orderBy(F.desc(F.round("idf", 9)), "token").limit(size) if idf.count() > 1.5 * size else idf


def sparse_vectors(tf: DataFrame, idf: DataFrame, key: str, buckets: int = 50_000, without: float = 1.0, told: bool = False) -> DataFrame:
    """(key, idx, value): sums of tf * idf by hashed token; a token without idf counts ``without``. A small ``idf`` may be told to
    all tasks, so that rows dealt by key are summed where they are.

    Tokens are hashed once each, beside their idf, and not once for every text that holds them.
    """
    known = idf.select("token", "idf", T.hash_token(F.col("token"), buckets).alias("_idx"))
    j = tf.join(F.broadcast(known) if told else known, "token", "left").withColumn("idx", F.coalesce("_idx", T.hash_token(F.col("token"), buckets)))
    return j.groupBy(key, "idx").agg(F.sum(F.col("tf") * F.coalesce("idf", F.lit(without))).alias("value"))


def hashed_vectors(docs: DataFrame, key: str, text: str = "text", buckets: int = 50_000) -> DataFrame:
    """(key, e): sums of the BM25 term frequencies of a text's index tokens by hashed token, in the order of the hashes.

    A text is counted where it lies; only keys of several texts meet in a shuffle. The rows are those of ``bm25_tf`` of ``term_counts``.
    """
    d = docs.select(key, T.index_tokens(F.col(text), INDEX_STOP).alias("_w")).where(F.size("_w") > 0)
    several = docs.groupBy(key).agg(F.count("*").alias("_n")).where("_n > 1").select(key)
    kind, entry = d.schema[key].dataType.simpleString(), "array<struct<idx: long, value: double>>"

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            sizes = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            words = lists.flatten().dictionary_encode()
            names = [int.from_bytes(hashlib.md5(w.encode()).digest(), "big") % buckets for w in words.dictionary.to_pylist()]
            own = np.repeat(np.arange(len(sizes)), sizes)
            pair, n = np.unique(own * max(1, len(names)) + words.indices.to_numpy(), return_counts=True)
            own, word = pair // max(1, len(names)), pair % max(1, len(names))
            tf = n * (K1 + 1) / (n + K1 * (1 - B + B * (sizes[own] / MEAN_LENGTH)))
            pair, at = np.unique(own * buckets + np.array(names, dtype=np.int64)[word], return_inverse=True)
            value = np.bincount(at, tf, len(pair))
            entries = pa.StructArray.from_arrays([pa.array(pair % buckets), pa.array(value)], ["idx", "value"])
            ends = np.searchsorted(pair, np.arange(len(sizes) + 1) * buckets)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), entries)], [key, "e"])

    if several.isEmpty():
        return d.mapInArrow(count, f"{key} {kind}, e {entry}")
    several = materialize(several, "several")
    meet = bm25_tf(term_counts(docs.join(several.withColumnRenamed(key, "_k"), F.col(key).eqNullSafe(F.col("_k")), "left_semi"), key, text))
    meet = meet.groupBy(key, T.hash_token(F.col("token"), buckets).alias("idx")).agg(F.sum("tf").alias("value")).groupBy(key).agg(F.sort_array(F.collect_list(F.struct("idx", "value"))).alias("e"))
    alone = d.join(several.withColumnRenamed(key, "_k"), F.col(key).eqNullSafe(F.col("_k")), "left_anti")
    return alone.mapInArrow(count, f"{key} {kind}, e {entry}").unionByName(meet)


def normalize_wikilink(c: Column) -> Column:
    """Title of a [[link]]: underscores to spaces, leading colons and sections cut, other namespaces dropped (null)."""
    t = F.trim(F.regexp_replace(F.split_part(F.split_part(c, F.lit("|"), F.lit(1)), F.lit("#"), F.lit(1)), "_", " "))
    t = F.trim(F.regexp_replace(t, r"^:+", ""))
    foreign = F.lower(t).rlike(rf"^({'|'.join(NAMESPACES)})[ ]*:")
    return F.when((t == "") | foreign, None).otherwise(t)


def wikilinks(c: Column) -> Column:
    """Distinct normalized titles of a text's links, in order."""
    raw = F.regexp_extract_all(c, F.lit(r"\[\[([^\[\]]+)\]\]"), 1)
    return F.array_distinct(F.filter(F.transform(raw, normalize_wikilink), lambda t: t.isNotNull()))


def clean_wikitext(c: Column) -> Column:
    """Plain text: nested templates (five deep), references, files, links, tags, quotes and list marks removed."""
    for _ in range(5):
        c = F.regexp_replace(c, r"\{\{[^{}]*\}\}", "")
    for pattern, to in ((r"(?s)<ref[^>]*/>", ""), (r"(?s)<ref[^>]*>.*?</ref>", ""), (r"(?i)\[\[(?:File|Image|Category):[^\]]*\]\]", ""), (r"\[\[[^\]|]*\|([^\]]*)\]\]", "$1"), (r"\[\[([^\]]*)\]\]", "$1"), (r"\[https?://[^ \]]+ ?([^\]]*)\]", "$1"), (r"<[^>]+>", ""), (r"'{2,}", ""), (r"(?m)^[*#:;]+[ \t]*", "")):
        c = F.regexp_replace(c, pattern, to)
    return T.squeeze(c)


def article_quality(a: DataFrame) -> DataFrame:
    """Content score of articles from page_length, word_count, flags and counts; eight parts, at most 1."""
    length = F.when(F.col("page_length") > 0, F.least(F.lit(0.2), F.log10(F.col("page_length") + 1.0) / 25)).when(F.col("word_count") > 0, F.least(F.lit(0.2), F.log10(F.col("word_count") * 5 + 1.0) / 25)).otherwise(0.0)
    flag = lambda c, v: F.when(F.coalesce(F.col(c), F.lit(False)), v).otherwise(0.0)
    s = length + flag("has_infobox", 0.15) + flag("has_wikidata", 0.15) + flag("has_coordinates", 0.1)
    s = s + F.least(F.lit(0.15), F.col("n_categories") * 0.015) + F.when(F.col("first_paragraph_length") > 100, 0.1).otherwise(0.0)
    s = s + F.least(F.lit(0.1), F.col("n_entities") * 0.02) + flag("has_instance_type", 0.05)
    return a.withColumn("content_quality", F.least(F.lit(1.0), s))


def final_quality(content: Column, pagerank: Column, links: Column) -> Column:
    """0.4 content + 0.35 log10 rank / 6 + 0.25 log10 links / 5; missing or non-positive parts count 0."""
    rank = F.when(pagerank > 0, F.log10(pagerank * 1_000_000 + 1) / 6).otherwise(0.0)
    popular = F.when(links > 0, F.log10(links + 1.0) / 5).otherwise(0.0)
    return F.coalesce(content, F.lit(0.0)) * 0.4 + rank * 0.35 + popular * 0.25


def enrich(pages: DataFrame, key: str, lookups: dict[str, DataFrame]) -> DataFrame:
    """Left joins with lookup tables; each is first reduced to its last row per key (column ``ord``)."""
    for _, t in lookups.items():
        values = [c for c in t.columns if c not in (key, "ord")]
        last = t.groupBy(key).agg(F.max_by(F.struct(*values), "ord").alias("_v")).select(key, *[F.col(f"_v.{c}").alias(c) for c in values])
        pages = pages.join(last, key, "left")
    return pages


def resolve_mentions(passages: DataFrame, titles: DataFrame) -> DataFrame:
    """(passage_id, mention_qids): mentioned titles as qids, own article and repeats left out, order kept.

    ``passages``: passage_id, qid, mentions; ``titles``: title, qid, ord (the first row of a title counts).
    """
    first = titles.groupBy("title").agg(F.min_by("qid", "ord").alias("target"))
    m = passages.select("passage_id", "qid", F.posexplode("mentions").alias("pos", "title")).join(first, "title")
    m = m.where(F.col("target") != F.col("qid")).groupBy("passage_id", "target").agg(F.min("pos").alias("pos"))
    found = m.groupBy("passage_id").agg(F.sort_array(F.collect_list(F.struct("pos", "target"))).alias("m")).select("passage_id", F.transform("m", lambda x: x["target"]).alias("mention_qids"))
    return passages.select("passage_id").join(found, "passage_id", "left").select("passage_id", F.coalesce("mention_qids", F.array().cast("array<string>")).alias("mention_qids"))
