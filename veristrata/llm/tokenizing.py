"""Token ids of whole texts at corpus speed, with the ``tokenizers`` library.

The library pre-tokenizes a text into pieces that it encodes one by one. A single space (or line end) between two
characters that are not white space always starts a new piece, so a text can be cut there, and the ids of the
parts joined are the ids of the whole. A letter followed by closing punctuation is such a place too, so a part made
of both is put together from the two. Frequent parts come from a bounded memo; the others are encoded by the
library, many in one call. ``tests/llm/test_operators.py`` holds the results against plain calls.
"""

from __future__ import annotations

import json
import os
import re

import numpy as np

_cut = re.compile(r"(?<=\S)(?= \S)")
#: Marks that join an ASCII letter to one character; a text with them keeps its case until the library has seen it.
_marks = re.compile("[̀-ͯ]")
#: ASCII punctuation that is a piece of its own after a Latin letter (but one, whose small form ends in a mark; other
#: scripts have letters that normalize into two); the apostrophe may begin a contraction and is left out.
_TAIL = ".,;:!?\"*#$%&|)]}>"
_END = 0  # memo key of the end id; all other keys are texts


def _gather(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indexes of stretches (start, length) in a row."""
    ends = np.cumsum(lengths)
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(ends[-1] if len(ends) else 0)


class PieceEncoder:
    """Ids of texts for one tokenizer file.

    ``spaced``: a piece keeps the space before it (byte-level BPE); otherwise white space is dropped and a piece's
    last token ends in ``</w>``.
    """

    LIMIT = 800_000  # parts in the memo
    LONGEST = 40  # characters of a part in the memo
    JOIN = 60  # parts that one library call encodes
    POOL = 24 << 20  # ids in the pool

    def __init__(self, path: str, spaced: bool) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.spaced = spaced
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        #: spaced: tokens that begin a part; else tokens that end a piece
        self.edge = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.edge[[i for t, i in vocabulary.items() if (t[0] in "ĠĊ" if spaced else t.endswith("</w>"))]] = True
        with open(path, encoding="utf-8") as f:
            self.folds = '"Lowercase"' in json.dumps(json.load(f).get("normalizer"))
        self._reset()

    def _reset(self) -> None:
        self.memo: dict[str | int, int] = {}
        self.tails: dict[str, int] = {}
        self.pool = np.zeros(1 << 20, dtype=np.int32)
        self.used = 0
        self.start = np.zeros(1 << 18, dtype=np.int64)
        self.length = np.zeros(1 << 18, dtype=np.int64)
        self.entries = 0

    def _plain(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _append(self, ids: np.ndarray, counts: np.ndarray) -> int:
        """Add parts with their ids to the pool; returns the index of the first."""
        n, m = len(counts), len(ids)
        while self.used + m > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        while self.entries + n > len(self.start):
            self.start = np.concatenate([self.start, np.zeros_like(self.start)])
            self.length = np.concatenate([self.length, np.zeros_like(self.length)])
        first = self.entries
        self.pool[self.used : self.used + m] = ids
        self.start[first : first + n] = self.used + np.cumsum(counts) - counts
        self.length[first : first + n] = counts
        self.used += m
        self.entries += n
        return first

    def _odd(self, part: str) -> bool:
        """Parts next to other white space, which must not be cut there."""
        return not part or part[-1].isspace() or (part[0].isspace() and (part[0] != "\n" or len(part) < 2 or part[1].isspace()))

    def _call(self, parts: list[str]) -> int:
        """Encode parts, many per call, into the pool; returns the index of the first."""
        first = self.entries
        for at in range(0, len(parts), self.JOIN):
            group = parts[at : at + self.JOIN]
            texts = [p if p[0] == "\n" else " " + p for p in group] if self.spaced else group
            ids = np.array(self._plain("".join(texts) if self.spaced else " ".join(texts)), dtype=np.int32)
            edges = np.flatnonzero(self.edge[ids])
            counts = np.diff(np.append(edges, len(ids))) if self.spaced else np.diff(np.concatenate([[-1], edges]))
            if len(counts) != len(group) or counts.sum() != len(ids):  # parts of several pieces: one by one
                each = [self._plain(t) for t in texts]
                counts, ids = np.array([len(x) for x in each], dtype=np.int64), np.array([i for x in each for i in x], dtype=np.int32)
            self._append(ids, counts)
        return first

    def _learn(self, parts: list[str], local: dict[str, int]) -> None:
        """Find the ids of unseen parts and note where they are; -1 marks an odd part."""
        memo, tails = self.memo, self.tails
        whole: dict[str, None] = {}  # parts and stems for the library; those of one piece first
        several: list[str] = []
        ends: dict[str, None] = {}
        joined: list[str] = []
        stems: list[str] = []
        closing: list[str] = []
        for p in parts:
            if self.spaced and self._odd(p):
                memo[p] = -1
                continue
            stem = p.rstrip(_TAIL)
            if len(stem) < len(p) and stem and stem[-1] < "ɐ" and stem[-1].isalpha() and stem[-1] != "İ":
                tail = p[len(stem) :]
                joined.append(p)
                stems.append(stem)
                closing.append(tail)
                if tail not in tails:
                    ends[tail] = None
                if stem in memo:
                    continue
            else:
                stem = p
            if self.spaced or stem.isalpha():
                whole[stem] = None
            else:
                several.append(stem)
        several = [p for p in dict.fromkeys(several) if p not in whole]
        own = [*whole, *several]
        first = self._call(list(whole)) if whole else self.entries
        for p in several:
            self._append(ids := np.array(self._plain(p), dtype=np.int32), np.array([len(ids)]))
        found = dict(zip(own, range(first, first + len(own)), strict=True))
        for t in ends:
            ids = np.array(self._plain(t), dtype=np.int32)
            tails[t] = self._append(ids, np.array([len(ids)]))
        if joined:
            pairs = np.empty(2 * len(joined), dtype=np.int64)
            pairs[::2] = [found[s] if s in found else memo[s] for s in stems]
            pairs[1::2] = [tails[t] for t in closing]
            ids = self.pool[_gather(self.start[pairs], self.length[pairs])]
            at = self._append(ids, self.length[pairs].reshape(-1, 2).sum(axis=1))
            found |= dict(zip(joined, range(at, at + len(joined)), strict=True))
        longest = self.LONGEST
        for p, i in found.items():
            (memo if len(p) <= longest else local)[p] = i

    def _parts(self, text: str) -> list[str]:
        if self.spaced:
            return ("\n" + text).replace("\n", " \n").split(" ")[1:]
        if self.folds:
            text = text.lower() if text.isascii() else text if _marks.search(text) else text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")
        return text.replace("\n", " ").split(" ")

    def _slow(self, text: str, end: list[int]) -> np.ndarray:
        """A text with runs of white space: cut only where a single space stands between other characters."""
        out = []
        for i, part in enumerate(_cut.split(text)):
            at = self.memo.get(part[1:], -1) if i and part else -1
            out.append(self.pool[self.start[at] : self.start[at] + self.length[at]] if at >= 0 else np.array(self._plain(part), dtype=np.int32))
        return np.concatenate([*out, np.array(end, dtype=np.int32)])

    def encode(self, texts: list[str], end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in a row, number of ids of each text); ``end_id`` is added after each text."""
        if len(self.memo) > self.LIMIT:
            self._reset()
        end = [] if end_id is None else [end_id]
        memo = self.memo
        memo[_END] = self._append(np.array(end, dtype=np.int32), np.array([len(end)]))
        split = [self._parts(t) if t else [] for t in texts]
        parts: list = []
        for own in split:
            parts += own
            parts.append(_END)
        local: dict[str, int] = {}
        found = list(map(memo.get, parts))
        missing = [i for i, f in enumerate(found) if f is None]
        if missing:
            self._learn(list(dict.fromkeys([parts[i] for i in missing])), local)
            for i in missing:
                at = memo.get(parts[i])
                found[i] = local[parts[i]] if at is None else at
        index = np.array(found, dtype=np.int64)
        n_parts = np.array([len(own) + 1 for own in split], dtype=np.int64)
        last = np.cumsum(n_parts)
        starts, lengths = self.start[index], self.length[index]
        slow: dict[int, np.ndarray] = {}
        if self.spaced:
            # without the line end that stood before each text
            full = (last - n_parts)[n_parts > 1]
            starts[full] += 1
            lengths[full] -= 1
            odd = np.flatnonzero(index < 0)
            lengths[odd] = 0
            slow = {int(i): self._slow(texts[i], end) for i in np.unique(np.searchsorted(last, odd, "right"))}
        total = np.concatenate([[0], np.cumsum(lengths)])
        ids = self.pool[_gather(starts, lengths)]
        bounds = total[np.concatenate([[0], last])]
        counts = np.diff(bounds)
        if slow:
            pieces = [slow[i] if i in slow else ids[bounds[i] : bounds[i + 1]] for i in range(len(texts))]
            ids, counts = np.concatenate(pieces), np.array([len(x) for x in pieces], dtype=np.int64)
        if self.used > self.POOL:  # long parts stay in the pool until now
            self._reset()
        return ids, counts


_encoders: dict[tuple[str, bool], PieceEncoder] = {}


def encoder(path: str, spaced: bool) -> PieceEncoder:
    """One encoder per Python worker and tokenizer."""
    if (path, spaced) not in _encoders:
        _encoders[path, spaced] = PieceEncoder(path, spaced)
    return _encoders[path, spaced]
