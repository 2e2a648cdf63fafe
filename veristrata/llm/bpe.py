"""Byte-level BPE: whole texts to ids by ranked pairs, and back.

A text is parted by the vocabulary's pattern and each part is encoded by itself. A part that is a token is that token.
Other parts not seen before are dealt into buckets by their length in bytes; a bucket is a matrix of ids padded to the
bucket's width. Each round, every row merges its leftmost pair of minimum rank: ranks of pairs come from a hash table
in numpy arrays, only the two pairs beside a merge are looked up again, the ids behind it move up by one place, and
rows without a pair left the table leave the matrix. Parts longer than ``WIDEST`` bytes, for which a matrix would cost
the square of their length, merge in the same order by a heap. Frequent parts come from a bounded memo.

Nulls: a null text is empty and has no ids; null ids of documents are kept, a null list of ids decodes to nothing.
Very long texts are encoded whole: parts of up to ``WIDEST`` bytes in blocks of ``CELLS`` cells, longer ones in time
n log n. Ties of rank go to the leftmost pair. Repeated rows are encoded alike and kept. Empty tables give empty
results; extra columns are ignored. Ids that the vocabulary lacks raise an error when decoded.
"""

from __future__ import annotations

import base64
import heapq
from array import array
from collections.abc import Iterator
from functools import cached_property
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_map, documents, text_of
from .tokenizing import _gather

NO_RANK = 2**31 - 1
#: Ids of the documents that are decoded into one batch, one document at least.
LISTS = 1 << 18


class PairTable:
    """(left id, right id) -> id of the token that both make, in open addressing; absent pairs give NO_RANK."""

    def __init__(self, left: np.ndarray, right: np.ndarray, made: np.ndarray) -> None:
        self.mask = (1 << max(4, (4 * len(made)).bit_length())) - 1
        self.keys = np.full(self.mask + 1, -1, dtype=np.int64)
        self.made = np.full(self.mask + 1, NO_RANK, dtype=np.int32)
        keys, todo = (left.astype(np.int64) << 32) | right, np.arange(len(made))
        slot = self._slot(keys)
        while len(todo):
            free = self.keys[slot[todo]] < 0
            self.keys[slot[todo[free]]] = keys[todo[free]]  # the last of those with one slot stays
            there = self.keys[slot[todo]] == keys[todo]
            self.made[slot[todo[there]]] = made[todo[there]]
            todo = todo[~there]
            slot[todo] = (slot[todo] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        mixed = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return ((mixed >> np.uint64(32)) & np.uint64(self.mask)).astype(np.int64)

    def __call__(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ids of the pairs; a negative id on either side (padding) makes no pair."""
        keys = (left.astype(np.int64) << 32) | right
        out = np.full(keys.shape, NO_RANK, dtype=np.int32)
        todo = np.flatnonzero((left >= 0) & (right >= 0))
        flat = out.ravel()
        keys = keys.ravel()[todo]
        slot = self._slot(keys)
        while len(todo):
            found = self.keys[slot]
            hit = found == keys
            flat[todo[hit]] = self.made[slot[hit]]
            go = ~hit & (found >= 0)
            todo, keys, slot = todo[go], keys[go], (slot[go] + 1) & self.mask
        return flat.reshape(out.shape)


class Vocabulary:
    """Ranks of tokens (bytes); a token's rank is its id."""

    WIDEST = 512  # bytes of a part in a matrix
    CELLS = 1 << 20  # cells of a matrix
    LIMIT = 300_000  # parts in the memo
    LONGEST = 24  # characters of a part in the memo
    POOL = 4 << 20  # ids in the pool
    BLOCK = 1 << 16  # ids that are decoded at once
    AT_ONCE = 1 << 20  # characters of the texts that are parted at once, one text at least

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        import regex

        self.ranks, self.parts = ranks, regex.compile(pattern).findall
        self.byte_ids = np.array([ranks[bytes([b])] for b in range(256)], dtype=np.int32)
        tokens: list[bytes | None] = [None] * (max(ranks.values()) + 1)
        for token, i in ranks.items():
            tokens[i] = token
        self.known = np.array([t is not None for t in tokens])
        self.lengths = np.array([len(t or b"") for t in tokens], dtype=np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.bytes = np.frombuffer(b"".join(t or b"" for t in tokens), dtype=np.uint8)
        self._reset()

    @cached_property
    def pairs(self) -> PairTable:
        """Every way to put a token together from two; only encoding asks for it."""
        flat = array("q")
        for token, made in self.ranks.items():
            for i in range(1, len(token)):
                a, b = self.ranks.get(token[:i]), self.ranks.get(token[i:])
                if a is not None and b is not None:
                    flat.extend((a, b, made))
        return PairTable(*np.frombuffer(flat, dtype=np.int64).reshape(-1, 3).T)

    @classmethod
    def read(cls, path: str, pattern: str) -> Vocabulary:
        with open(path, "rb") as f:
            return cls({base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}, pattern)

    def merge_rows(self, rows: list[bytes]) -> list[np.ndarray]:
        """Ids of parts of at most WIDEST bytes, in one matrix."""
        lengths = np.array(list(map(len, rows)))
        width = int(lengths.max())
        inside = np.arange(width) < lengths[:, None]
        ids = np.full((len(rows), width), -1, dtype=np.int32)
        ids[inside] = self.byte_ids[np.frombuffer(b"".join(rows), dtype=np.uint8)]
        ranks = np.full((len(rows), width), NO_RANK, dtype=np.int32)  # of the pair that begins at a place
        ranks[:, :-1] = self.pairs(ids[:, :-1], ids[:, 1:])
        out: list[np.ndarray] = [ids[:0, 0]] * len(rows)
        own, place = np.arange(len(rows)), np.arange(width)
        while len(own):
            at = ranks.argmin(axis=1)  # the leftmost of the smallest
            line = np.arange(len(own))
            best = ranks[line, at]
            done = best == NO_RANK
            if done.any():
                for i in np.flatnonzero(done):
                    out[own[i]] = ids[i, : lengths[i]].copy()
                go = ~done
                own, ids, ranks, lengths, at, best = own[go], ids[go], ranks[go], lengths[go], at[go], best[go]
                if not len(own):
                    break
                line = np.arange(len(own))
                width = int(lengths.max())
                ids, ranks, place = ids[:, :width], ranks[:, :width], place[:width]
            ids[line, at] = best
            source = place + (place > at[:, None])  # what stood behind the merged pair moves up
            last = source == width
            source[last] = 0
            ids = np.take_along_axis(ids, source, axis=1)
            ranks = np.take_along_axis(ranks, source, axis=1)
            ids[last], ranks[last] = -1, NO_RANK
            lengths = lengths - 1
            behind = np.where(at + 1 < width, ids[line, np.minimum(at + 1, width - 1)], -1)
            ranks[line, at] = self.pairs(best, behind)
            inner = np.flatnonzero(at > 0)
            before = at[inner] - 1
            ranks[inner, before] = self.pairs(ids[inner, before], best[inner])
        return out

    def merge_long(self, part: bytes) -> np.ndarray:
        """Ids of one part of any length: the same merges in the same order, by a heap over linked places."""
        tokens: list[bytes] = [part[i : i + 1] for i in range(len(part))]
        n, ranks = len(tokens), self.ranks
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        best = [ranks.get(part[i : i + 2], NO_RANK) if i + 1 < n else NO_RANK for i in range(n)]  # of the pair that begins at a place
        heap = [(r, i) for i, r in enumerate(best) if r != NO_RANK]
        heapq.heapify(heap)
        while heap:
            rank, i = heapq.heappop(heap)
            if best[i] != rank:  # merged or renewed since
                continue
            j = after[i]
            tokens[i], tokens[j], best[j], after[i] = tokens[i] + tokens[j], b"", NO_RANK, after[j]
            if after[i] < n:
                before[after[i]] = i
            for k in (before[i], i):
                if k >= 0:
                    best[k] = ranks.get(tokens[k] + tokens[after[k]], NO_RANK) if after[k] < n else NO_RANK
                    if best[k] != NO_RANK:
                        heapq.heappush(heap, (best[k], k))
        return np.array([ranks[t] for t in tokens if t], dtype=np.int32)

    def _reset(self) -> None:
        self.memo: dict[str, int] = {}  # part to its place in ``first`` and ``count``
        self.pool, self.used = np.zeros(1 << 16, dtype=np.int32), 0
        self.first, self.count, self.known_parts = np.zeros(1 << 14, dtype=np.int64), np.zeros(1 << 14, dtype=np.int64), 0

    def _append(self, lists: list[np.ndarray]) -> int:
        """Add the ids of parts to the pool, whose room doubles when it is full; returns the place of the first."""
        n, ids = len(lists), np.concatenate(lists)
        while self.used + len(ids) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        while self.known_parts + n > len(self.first):
            self.first, self.count = (np.concatenate([x, np.zeros_like(x)]) for x in (self.first, self.count))
        own = slice(self.known_parts, self.known_parts + n)
        self.count[own] = list(map(len, lists))
        self.first[own] = self.used + np.cumsum(self.count[own]) - self.count[own]
        self.pool[self.used : self.used + len(ids)] = ids
        self.used, self.known_parts = self.used + len(ids), own.stop
        return own.start

    def learn(self, parts: list[str]) -> dict[str, int]:
        """Put the ids of unseen parts into the pool; returns the places of all, the memo keeps those of short ones."""
        found: dict[str, np.ndarray] = {}
        buckets: dict[int, list[tuple[str, bytes]]] = {}
        for p in parts:
            raw = p.encode("utf-8", "surrogatepass")
            whole = self.ranks.get(raw)
            if whole is not None:
                found[p] = np.array([whole], dtype=np.int32)
            elif len(raw) > self.WIDEST:
                found[p] = self.merge_long(raw)
            else:
                buckets.setdefault((len(raw) - 1).bit_length(), []).append((p, raw))
        for power, same in buckets.items():
            step = max(1, self.CELLS >> power)
            for i in range(0, len(same), step):
                block = same[i : i + step]
                found |= zip((p for p, _ in block), self.merge_rows([raw for _, raw in block]), strict=True)
        first = self._append(list(found.values()))
        places = dict(zip(found, range(first, first + len(found)), strict=True))
        self.memo |= {p: i for p, i in places.items() if len(p) <= self.LONGEST}
        return places

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in a row, number of ids of each text)."""
        ends = np.cumsum([0, *map(len, texts)])
        at, ids, counts = 0, [np.zeros(0, dtype=np.int32)], [np.zeros(0, dtype=np.int64)]
        while at < len(texts):
            to = max(at + 1, int(np.searchsorted(ends, ends[at] + self.AT_ONCE, "right")) - 1)
            for out, own in zip((ids, counts), self._encode(texts[at:to]), strict=True):
                out.append(own)
            at = to
        return np.concatenate(ids), np.concatenate(counts)

    def _encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        if len(self.memo) > self.LIMIT or self.used > self.POOL:
            self._reset()
        split = [self.parts(t) if t else [] for t in texts]
        parts = list(chain.from_iterable(split))
        found = list(map(self.memo.get, parts))
        if None in found:
            missing = [i for i, f in enumerate(found) if f is None]
            places = self.learn(list(dict.fromkeys([parts[i] for i in missing])))
            for i in missing:
                found[i] = places[parts[i]]
        place = np.array(found, dtype=np.int64)
        counts = self.count[place]
        ends = np.concatenate([[0], np.cumsum(counts)])[np.cumsum(list(map(len, split)), dtype=np.int64)]
        return self.pool[_gather(self.first[place], counts)], np.diff(ends, prepend=0)

    def decode(self, ids: np.ndarray) -> tuple[bytes, np.ndarray]:
        """(bytes of all ids in a row, number of bytes of each id)."""
        if len(ids) and not (ids.min() >= 0 and ids.max() < len(self.known) and self.known[ids].all()):
            raise ValueError("an id is not in the vocabulary")
        lengths = self.lengths[ids]
        blocks = [slice(i, i + self.BLOCK) for i in range(0, len(ids), self.BLOCK)]
        return b"".join(self.bytes[_gather(self.starts[ids[x]], lengths[x])].tobytes() for x in blocks), lengths


_vocabularies: dict[tuple[str, str], Vocabulary] = {}


def vocabulary(path: str, pattern: str) -> Vocabulary:
    """One vocabulary per Python worker, file and pattern."""
    if (path, pattern) not in _vocabularies:
        _vocabularies[path, pattern] = Vocabulary.read(path, pattern)
    return _vocabularies[path, pattern]


def encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, ids) of every whole text of ``docs`` (doc_id, text)."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids, counts = vocabulary(path, pattern).encode(batch.column("text").to_pylist())
        offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids, pa.int32()))], ["doc_id", "ids"])

    return arrow_map(docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")), run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """``encoded`` (doc_id, ids) with ``decoded``, the bytes of the ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = vocabulary(path, pattern)
        for batch in batches:
            ends = np.cumsum(np.asarray(batch.column("ids").value_lengths().fill_null(0), dtype=np.int64))
            at = 0
            while at < len(ends):
                to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + LISTS, "right")))
                yield some(own, batch.slice(at, to - at))
                at = to

    def some(own: Vocabulary, batch: pa.RecordBatch) -> pa.RecordBatch:
        lists = batch.column("ids")
        flat, lengths = own.decode(np.asarray(lists.flatten()))
        counts = np.asarray(lists.value_lengths().fill_null(0), dtype=np.int64)
        bounds = np.concatenate([[0], np.cumsum(lengths)])[np.concatenate([[0], np.cumsum(counts)])]
        decoded = pa.array([flat[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)], pa.binary())
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), lists, decoded], ["doc_id", "ids", "decoded"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, ids array<int>, decoded binary")


def op13_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as tokenizers

    path, pattern = tokenizers.path("byte_bpe_50k.tiktoken"), tokenizers.PATTERN
    done = decode(encode(documents(spark, sf_dir), path, pattern), path, pattern)
    told = F.array_join(F.transform("ids", lambda i: i.cast("string")), " ")
    return done.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(told.cast("binary"), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
