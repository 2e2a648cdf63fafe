"""Fill-in-the-middle: documents cut at seeded places into prefix, middle and suffix, over an index of distinct texts.

Documents with the same text are brought together by a hash of it. Where a group lies, every text is compared in full
with the group's distinct texts, so that texts which only share the hash stay apart; the ends of a text's units are
kept once as an Elias-Fano list, and each document of the text joins that list where it is and selects its two cuts.
Only one exchange moves texts. A text with more than ``limit`` documents is dealt by scan task to several groups, each
with a list of its own, so that no task gets all copies.

Units are runs of ASCII letters and single other code points. The cuts, the form (plain, psm, spm) and nothing else
depend on the seed and the document's id. ``restore`` rebuilds the text from output and form with column functions:
no marker's start is its own end, so the first marker found is the one that was put there.

Nulls: a null text is empty (plain); a null doc_id counts as the empty string for the seed and is kept. Empty texts
are plain. Very long texts are cut whole; a list has about two bits and the low bits a unit. Repeated rows and repeated
doc_ids are cut each by their own id, alike. Ties of the two cuts give an empty middle. Empty tables give empty results;
extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import MOST_TOLD, documents, slices, text_of

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Documents of one text that one task may get; more where a hundred-thousandth of all documents is more.
SHARED = 400
_SCHEMA = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"
_ARROW = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()), ("output", pa.string())])


def unit_ends(text: str) -> np.ndarray:
    """Where each unit of a text ends, in code points."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    small = points | 32
    letter = (small >= ord("a")) & (small <= ord("z"))
    inside = np.zeros(len(points), dtype=bool)  # the unit goes on after this code point
    inside[:-1] = letter[:-1] & letter[1:]
    return np.flatnonzero(~inside) + 1


class Boundaries:
    """Elias-Fano list of ascending ends: low bits as they are, high bits as ones in a bit vector with counts by block."""

    BLOCK = 64  # bytes of the bit vector that one count covers

    def __init__(self, ends: np.ndarray, size: int) -> None:
        self.n = len(ends)
        self.low_bits = max(0, (size // max(1, self.n)).bit_length() - 1)
        upper = np.zeros(int(ends[-1] >> self.low_bits) + self.n if self.n else 0, dtype=bool)
        upper[(ends >> self.low_bits) + np.arange(self.n)] = True
        self.upper = np.packbits(upper, bitorder="little")
        self.lower = np.packbits((ends[:, None] >> np.arange(self.low_bits)) & 1, bitorder="little")
        ones = np.add.reduceat(np.bitwise_count(self.upper).astype(np.int64), np.arange(0, len(self.upper), self.BLOCK)) if self.n else np.zeros(0, dtype=np.int64)
        self.before = np.cumsum(ones) - ones

    def select(self, k: int) -> int:
        """Where the first ``k`` units end."""
        if k == 0:
            return 0
        block = int(np.searchsorted(self.before, k - 1, "right")) - 1
        at = block * self.BLOCK
        ones = np.flatnonzero(np.unpackbits(self.upper[at : at + self.BLOCK], bitorder="little"))
        high = 8 * at + int(ones[k - 1 - self.before[block]]) - (k - 1)
        first = (k - 1) * self.low_bits
        last = first + self.low_bits
        bits = np.unpackbits(self.lower[first // 8 : -(-last // 8)], bitorder="little")[first % 8 : first % 8 + self.low_bits]
        return (high << self.low_bits) + int((bits.astype(np.int64) << np.arange(self.low_bits)).sum())


def cut(text: str, ends: Boundaries, doc_id: int | None, seed: int, fim_percent: int, spm_percent: int) -> tuple:
    """(n, form, prefix_chars, middle_chars, output) of one document."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[i : i + 8], 16) for i in (0, 8, 16, 24))
    if not text or h3 % 100 >= fim_percent or PREFIX in text or SUFFIX in text or MIDDLE in text:
        return ends.n, "plain", None, None, text
    a, b = sorted((ends.select(h1 % (ends.n + 1)), ends.select(h2 % (ends.n + 1))))
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if h4 % 100 < spm_percent:
        return ends.n, "spm", a, b - a, SUFFIX + suffix + PREFIX + prefix + MIDDLE + middle
    return ends.n, "psm", a, b - a, PREFIX + prefix + SUFFIX + suffix + MIDDLE + middle


def cut_groups(batches: Iterator[pa.RecordBatch], seed: int, fim_percent: int, spm_percent: int) -> Iterator[pa.RecordBatch]:
    """Cut rows (key, doc_id, text) that are sorted by key; a distinct text's list lives as long as its group."""
    key, index = None, {}
    for batch in slices(batches):
        out = []
        for own, doc_id, text in zip(*(batch.column(c).to_pylist() for c in ("key", "doc_id", "text")), strict=True):
            if own != key:
                key, index = own, {}
            ends = index.get(text)  # found by its hash, confirmed character by character
            if ends is None:
                ends = index[text] = Boundaries(unit_ends(text), len(text))
            out.append((doc_id, *cut(text, ends, doc_id, seed, fim_percent, spm_percent)))
        columns = zip(*out, strict=True)
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _ARROW, strict=True)], schema=_ARROW)


def fill_in_middle(docs: DataFrame, seed: int = 1, fim_percent: int = 90, spm_percent: int = 20, key: Column | None = None, limit: int = SHARED) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output) of every document (doc_id, text).

    ``key`` brings equal texts together and may be any function of the text; a good hash keeps groups small.
    """
    key = F.xxhash64(text_of()) if key is None else key
    rows = docs.select(key.alias("key"), F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    limit = max(limit, docs.count() // MOST_TOLD)
    hot = rows.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > limit)  # at most 100,000 keys
    hot = hot.select("key", F.ceil(F.col("n") / limit).alias("parts"))
    dealt = rows.join(F.broadcast(hot), "key", "left").withColumn("part", F.coalesce(F.spark_partition_id() % F.col("parts"), F.lit(0)))
    together = dealt.repartition("key", "part").sortWithinPartitions("key").select("key", "doc_id", "text")
    return together.mapInArrow(lambda batches: cut_groups(batches, seed, fim_percent, spm_percent), _SCHEMA)


def restore(output: Column, form: Column) -> Column:
    """The text that ``output`` was made from."""

    def parts(first: str, second: str, third: str) -> tuple[Column, Column, Column]:
        at, last = F.instr(output, second), F.instr(output, third)
        head = F.substring(output, F.lit(len(first) + 1), at - len(first) - 1)
        return head, F.substring(output, at + len(second), last - at - len(second)), F.substring(output, last + len(third), F.length(output))

    p, s, m = parts(PREFIX, SUFFIX, MIDDLE)
    s2, p2, m2 = parts(SUFFIX, PREFIX, MIDDLE)
    return F.when(form == "psm", F.concat(p, m, s)).when(form == "spm", F.concat(p2, m2, s2)).otherwise(output)


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = fill_in_middle(documents(spark, sf_dir))
    digests = [F.sha2(c.cast("binary"), 256).alias(n) for c, n in ((F.col("output"), "output_sha256"), (restore(F.col("output"), F.col("form")), "restored_sha256"))]
    return done.select("doc_id", "n", "form", "prefix_chars", "middle_chars", *digests)


ORACLE_SQL = f"""WITH u AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
    k AS (SELECT doc_id, t, regexp_extract_all(t, '[A-Za-z]+|[^A-Za-z]') AS units, ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2, ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4 FROM u),
    c AS (SELECT *, len(units) AS n, CASE WHEN t = '' OR contains(t, '{PREFIX}') OR contains(t, '{SUFFIX}') OR contains(t, '{MIDDLE}') OR h3 % 100 >= 90 THEN 'plain'
        WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form, least(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS a, greatest(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS b FROM k),
    p AS (SELECT *, array_to_string(units[1:a], '') AS p, array_to_string(units[a + 1:b], '') AS m, array_to_string(units[b + 1:n], '') AS s FROM c)
    SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(p) END::BIGINT AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END::BIGINT AS middle_chars,
        sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '{PREFIX}' || p || '{SUFFIX}' || s || '{MIDDLE}' || m ELSE '{SUFFIX}' || s || '{PREFIX}' || p || '{MIDDLE}' || m END) AS output_sha256, sha256(t) AS restored_sha256
    FROM p"""
