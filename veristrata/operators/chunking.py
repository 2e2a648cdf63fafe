"""Sentence-aware chunkers. Their state (a running budget with overlap) resets at every chunk, which no window
expresses, so each text is chunked by a small function within a vectorized UDF."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

_SENTENCE = re.compile(r"(?<=[.!?])\s+")
CHUNKS = "array<struct<start:int,text:string>>"


def passages(text: str, target: int = 320, most: int = 420, overlap: int = 64, least: int = 96) -> list[tuple[int, str]]:
    """Chunks of about ``target`` tokens (4.7 characters each), at most ``most``, with sentences kept whole.

    A sentence longer than ``most`` is cut at words. A chunk begins with the last sentences of the one before that
    fit into ``overlap`` tokens; a last chunk under ``least`` tokens joins the one before it.
    """
    size = lambda s: max(1, round(len(s) / 4.7))
    pieces: list[tuple[int, str]] = []
    at = 0
    for s in _SENTENCE.split(text):
        start = text.index(s, at) if s else at
        at = start + len(s)
        while size(s) > most:
            cut = s.rfind(" ", 1, int(most * 4.7))
            cut = cut if cut > 0 else int(most * 4.7)
            pieces.append((start, s[:cut]))
            rest = s[cut:].lstrip()
            start += len(s) - len(rest)
            s = rest
        if s.strip():
            pieces.append((start, s))
    chunks: list[list[tuple[int, str]]] = []
    own: list[tuple[int, str]] = []
    fresh = 0
    for p in pieces:
        if own and fresh and sum(size(x) for _, x in own) + size(p[1]) > target:
            chunks.append(own)
            tail: list[tuple[int, str]] = []
            for q in reversed(own):
                if sum(size(x) for _, x in tail) + size(q[1]) > overlap:
                    break
                tail.insert(0, q)
            own, fresh = tail, 0
        own.append(p)
        fresh += 1
    if own and fresh:
        if chunks and sum(size(x) for _, x in own) < least:
            chunks[-1] += [p for p in own if p not in chunks[-1]]
        else:
            chunks.append(own)
    return [(c[0][0], " ".join(x for _, x in c)) for c in chunks]


def claim_chunks(text: str, tokens: int = 1000, overlap: int = 100) -> list[tuple[int, str]]:
    """Slices of the text itself (offsets kept): sentences up to four characters a token, the last ones repeated."""
    budget, back = 4 * tokens, 4 * overlap
    ends = [m.start() for m in _SENTENCE.finditer(text)] + [len(text)]
    out, start, last = [], 0, 0
    for e in ends:
        if e - start > budget and last > start:
            out.append((start, text[start:last]))
            start = next((x for x in ends if last - back <= x < last), last)
            start = start if start > out[-1][0] else last
        while e - start > budget:
            out.append((start, text[start : start + budget]))
            start += budget
        last = e
    if text[start:].strip():
        out.append((start, text[start:]))
    return out


#: Bytes of text that a Python task turns into strings at once.
SLICE_BYTES = 4 << 20


def text_slices(texts: pa.Array) -> Iterator[pa.Array]:
    """The texts of a batch in slices of about SLICE_BYTES, one text at least."""
    ends = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(texts), 0), dtype=np.int64))
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + SLICE_BYTES, "right")))
        yield texts.slice(at, to - at)
        at = to


def joined(parts: list[pa.Array], kind: pa.DataType) -> pa.Array:
    return pa.concat_arrays(parts) if parts else pa.array([], kind)


_HEADER = re.compile(r"^(={2,6})[ \t]*([^\n]+?)[ \t]*\1[ \t]*$", re.MULTILINE)
_CAPITAL = re.compile(r"(?<=[.!?])\s+(?=[A-Z])")
ARTICLE_CHUNKS = "array<struct<start:int,end:int,section:string,text:string>>"


def section_of(raw: str, plain_length: int):
    """Finds the section at a place of the plain text: its share of the plain length, as a place in the raw text."""
    heads = list(_HEADER.finditer(raw))
    names = (["Introduction"] if not heads or heads[0].start() > 0 else []) + [h.group(2).strip() for h in heads]
    ends = ([heads[0].start()] if heads and heads[0].start() > 0 else []) + [h.start() for h in heads[1:]] + [len(raw)]
    return lambda place: names[min(bisect_right(ends, int(place / max(plain_length, 1) * len(raw))), len(names) - 1)]


def article_chunks(raw: str, plain: str, size: int = 512, overlap: int = 64, least: int = 100) -> list[tuple[int, int, str, str]]:
    """(start, end, section, text): sentences of the plain text up to ``size`` characters, after the last sentences of the
    chunk before that fit into ``overlap``. Places count one space between sentences, but, as upstream, none
    within the overlap that a chunk begins with. A last chunk under ``least`` characters is left out; one that stays has
    the section of the chunk before it."""
    sentences = [s.strip() for s in _CAPITAL.split(plain) if s.strip()] if len(plain) >= least else []
    find, out, section = section_of(raw, len(plain)), [], "Introduction"
    own: list[str] = []
    held = start = at = 0
    for s in sentences:
        if own and held + len(s) > size:
            section = find((start + at) // 2)
            out.append((start, at, section, " ".join(own)))
            kept, held = [], 0
            while own and held + len(own[-1]) <= overlap:
                kept.append(own.pop())
                held += len(kept[-1])
            own, start = kept[::-1], at - held
        own.append(s)
        held += len(s)
        at += len(s) + 1
    if own and held >= least:
        out.append((start, at, section, " ".join(own)))
    return out


def article_column(raw: Column, plain: Column) -> Column:
    """Chunks of articles with their sections: an array of (start, end, section, text); nulls count as empty."""

    @F.pandas_udf(ARTICLE_CHUNKS)
    def run(raws: pd.Series, plains: pd.Series) -> pd.Series:
        return pd.Series([[dict(zip(("start", "end", "section", "text"), c, strict=True)) for c in article_chunks(r or "", p or "")] for r, p in zip(raws, plains, strict=True)])

    return run(raw, plain)


def chunk_column(c: Column, how) -> Column:
    """A chunker over a text column: an array of (start, text); a null text has none."""
    kind = pa.list_(pa.struct([("start", pa.int32()), ("text", pa.string())]))

    @F.arrow_udf(CHUNKS)
    def run(texts: pa.Array) -> pa.Array:
        return joined([pa.array([[{"start": a, "text": s} for a, s in how(t or "")] for t in part.to_pylist()], kind) for part in text_slices(texts)], kind)

    return run(c)
