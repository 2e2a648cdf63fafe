"""Helpers that the corpus operators share: shared folders, Arrow mapping, words and hashes."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..session import materialize, shared_dir, shared_path  # noqa: F401

#: White space of every word rule in this package, as a Java character class.
SPACE = r"\x20\x09-\x0D"
#: Largest slice of text (bytes) that one step of a Python task works on.
SLICE_BYTES = 4 << 20

def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def text_of(column: str = "text") -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


#: Rows (about 200 bytes each) of a small table that may be broadcast; larger ones are joined in SALTS parts of each key.
MOST_TOLD, SALTS = 100_000, 64


def beside(rows: DataFrame, table: DataFrame, n: int, key: str, how: str = "inner") -> DataFrame:
    """Rows with the columns of their key's one row of ``table`` (n rows); null with null.

    A table of proven size is broadcast. A larger one is repeated for each salt, so that no task gets all rows of a key.
    """
    t = table.withColumnRenamed(key, "_key")
    if n <= MOST_TOLD:
        return rows.join(F.broadcast(t), rows[key].eqNullSafe(F.col("_key")), how).drop("_key")
    r = rows.withColumn("_salt", (F.rand(1) * SALTS).cast("int"))
    t = t.withColumn("_part", F.explode(F.array(*[F.lit(i) for i in range(SALTS)])))
    return r.join(t, r[key].eqNullSafe(F.col("_key")) & (F.col("_salt") == F.col("_part")), how).drop("_key", "_salt", "_part")


def spread_join(rows: DataFrame, table: DataFrame, keys: list[str], size: str, total: int, how: str = "inner") -> DataFrame:
    """Rows with the columns of their key's one row of ``table``, whose column ``size`` counts the key's rows.

    Keys with more than a hundred-thousandth of all ``total`` rows (at most 100,000 keys) are joined where the rows
    lie, all others by a shuffle, so that no task gets all rows of a large key. ``table`` is read three times.
    """
    limit = max(1_000, total // MOST_TOLD)
    hot = F.broadcast(table.where(F.col(size) > limit))
    near = rows.join(hot, keys)
    return near.unionByName(rows.join(hot.select(*keys), keys, "left_anti").join(table.where(F.col(size) <= limit), keys, how))


def packed(df: DataFrame) -> Column:
    """The whole row as one struct, so that columns of any name can stand beside an operator's own."""
    return F.struct(*[F.col("`" + c.replace("`", "``") + "`") for c in df.columns])


def unpacked(df: DataFrame, row: str, names: list[str]) -> DataFrame:
    return df.select(*[F.col(row).getField(c).alias(c) for c in names])


def slices(batches: Iterator[pa.RecordBatch], column: str = "text") -> Iterator[pa.RecordBatch]:
    """Cut record batches so that a slice holds about SLICE_BYTES of the text column, one row at least."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        sizes = pc.binary_length(batch.column(batch.schema.get_field_index(column)))
        ends = np.cumsum(np.asarray(pc.fill_null(sizes, 0), dtype=np.int64))
        at = 0
        while at < n:
            done = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, done + SLICE_BYTES, "right")))
            yield batch.slice(at, to - at)
            at = to


def arrow_map(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str | StructType, column: str = "text") -> DataFrame:
    """mapInArrow over slices of bounded size; ``fn`` gets one slice and returns one batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in slices(batches, column):
            out = fn(piece)
            if out is not None:
                yield out

    return df.mapInArrow(run, schema)


def fmix64(x: np.ndarray) -> np.ndarray:
    """Finalizer of a 64-bit hash, for uint64 arrays."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


class WordHashes:
    """64-bit hashes of words (bytes); a bounded memo serves the frequent ones."""

    LIMIT = 600_000

    def __init__(self) -> None:
        self.memo: dict[bytes, int] = {}

    def __call__(self, words: list[bytes]) -> np.ndarray:
        from xxhash import xxh3_64_intdigest

        memo = self.memo
        found = list(map(memo.get, words))
        if None in found:
            if len(memo) > self.LIMIT:
                memo.clear()
            for i, h in enumerate(found):
                if h is None:
                    w = words[i]
                    h = memo.get(w)
                    if h is None:
                        h = xxh3_64_intdigest(w)
                        if len(w) <= 64:
                            memo[w] = h
                    found[i] = h
        return np.array(found, dtype=np.uint64)


word_hashes = WordHashes()
