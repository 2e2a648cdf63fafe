"""Token-ID files: whole texts to ids, ids to rANS frames in document order, and back.

``write_token_files`` deals documents by ranges of doc_id, sorts each range and encodes its texts; every Parquet row
of the files is one frame: consecutive documents of about ``FRAME`` ids with one static frequency table that all of
the frame's independent interleaved blocks (some 256) share (see ``rans``). A frame needs nothing but itself to be
decoded, so readers may split files as they like; ``part`` and ``before`` give its place. Texts are read once.

Nulls: a null text is empty, a null doc_id sorts first and is kept. Empty texts have the end id only. A very long text
is encoded whole; a frame ends with the document that fills it, so a long document makes a long frame. Repeated rows
are all kept; rows that share a doc_id are ordered by a hash of their text, so reruns agree. An empty table gives an
empty result. Extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import rans
from .common import documents, shared_path, slices, text_of
from .tokenizing import encoder

FRAME = 1 << 22
FRAME_SCHEMA = "part int, frame int, before long, n_tokens long, doc_ids array<bigint>, lengths array<bigint>, payload binary"


def write_token_files(docs: DataFrame, path: str, tokenizer: str, spaced: bool, end_id: int, frame_ids: int = FRAME) -> None:
    """Write the ids of ``docs`` (doc_id, text) in ascending doc_id order; each document ends with ``end_id``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part = encoder(tokenizer, spaced), TaskContext.get().partitionId()
        frame, before = 0, 0
        ids: list[np.ndarray] = []
        names: list[int | None] = []
        lengths: list[int] = []

        def close() -> pa.RecordBatch:
            nonlocal frame, before
            flat = np.concatenate(ids)
            row = pa.RecordBatch.from_pylist([{"part": part, "frame": frame, "before": before, "n_tokens": len(flat), "doc_ids": list(names), "lengths": list(lengths), "payload": rans.encode(flat)}], schema=_FRAME)
            frame, before = frame + 1, before + len(flat)
            ids.clear(), names.clear(), lengths.clear()
            return row

        for batch in slices(batches):
            got, counts = enc.encode(batch.column("text").to_pylist(), end_id)
            ids.append(got)
            names += batch.column("doc_id").to_pylist()
            lengths += counts.tolist()
            if sum(map(len, ids)) >= frame_ids:
                yield close()
        if names:
            yield close()

    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")).repartitionByRange("doc_id").sortWithinPartitions("doc_id", F.xxhash64("text"))
    ordered.mapInArrow(run, FRAME_SCHEMA).write.mode("overwrite").parquet(path)


_FRAME = pa.schema([("part", pa.int32()), ("frame", pa.int32()), ("before", pa.int64()), ("n_tokens", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64())), ("payload", pa.binary())])


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """Frames of the files at ``path``."""
    return spark.read.schema(FRAME_SCHEMA).parquet(path)


def token_ids(frames: DataFrame) -> DataFrame:
    """(doc_id, ids): the documents' ids, decoded."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for names, lengths, payload in zip(*(batch.column(c).to_pylist() for c in ("doc_ids", "lengths", "payload")), strict=True):
                ids = rans.decode(payload)
                offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids.astype(np.int32)))], ["doc_id", "ids"])

    return frames.select("doc_ids", "lengths", "payload").mapInArrow(run, "doc_id long, ids array<int>")


def token_index(frames: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document, from decoded frames.

    ``start`` needs the ids in the parts before: one number per part is collected, as many as write tasks.
    """
    parts = frames.groupBy("part").agg(F.sum("n_tokens").alias("n")).orderBy("part").collect()
    first, total = {}, 0
    for p, n in parts:
        first[p], total = total, total + n

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, before, names, lengths, payload in zip(*(batch.column(c).to_pylist() for c in ("part", "before", "doc_ids", "lengths", "payload")), strict=True):
                ids = np.ascontiguousarray(rans.decode(payload), dtype="<u4")
                n = np.array(lengths, dtype=np.int64)
                ends = np.cumsum(n)
                starts = ends - n
                crc = [zlib.crc32(ids[a:b]) for a, b in zip(starts, ends, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(starts + before + first[part]), pa.array(n), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return frames.select("part", "before", "doc_ids", "lengths", "payload").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = shared_path(spark, "token-ids")
    write_token_files(documents(spark, sf_dir), path, public_tokenizers.path("word_bpe_49k.json"), spaced=False, end_id=1)
    return token_index(read_token_files(spark, path))
