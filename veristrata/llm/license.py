"""License scans: phrases by their places, and an exact set-similarity join of text blocks with license templates.

The join finds every block that holds at least ``CONTAINED`` of a template's distinct words; a notice of fewer than
``SHORT`` distinct words must be there with all of them, as its few telling words (a name, a version) are what tells
it from another license's, and a template may name words that its blocks must not hold. A template's words are ordered
by how often they occur in all documents, rarest first. A block that holds k of a template's n words must hold one of
the template's n - k + 1 rarest (prefix filter), needs at least k words (length filter), and is given up as soon as the
words still to come cannot bring it to k (positional filter). Blocks are windows of twice the template's length at
every multiple of its length, so any stretch as long as the template lies within one.

Nulls: a null text is empty (no words, no places, score 0); null ids are kept. Empty tables give empty results;
repeated rows are scanned alike; extra columns are ignored. Very long texts are scanned whole. Ties: labels are a set
in alphabetical order, the score is the largest share of any template found, 1 where a phrase stands.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from math import ceil

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_map, documents, text_of

CONTAINED, SHORT = 0.8, 12
# The phrases of the base rule, and texts and notices of common licenses with words that exclude them.
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
TEMPLATES: list[tuple[str, str, str]] = [
    (
        "mit",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. The Software is provided as is, without warranty of any kind, express or implied, including but not limited to the warranties of merchantability, fitness for a particular purpose and noninfringement. In no event shall the authors or copyright holders be liable for any claim, damages or other liability, whether in an action of contract, tort or otherwise, arising from, out of or in connection with the Software or the use or other dealings in the Software.",
        "",
    ),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies", ""),
    ("mit", "released under the mit license", ""),
    ("mit", "licensed under the mit license", ""),
    (
        "apache-2",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0. Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an as is basis, without warranties or conditions of any kind, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
        "",
    ),
    ("apache-2", "licensed under the apache license version 2 0", ""),
    (
        "bsd",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        "",
    ),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", ""),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.", "sublicense"),
    (
        "gpl-3",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but without any warranty; without even the implied warranty of merchantability or fitness for a particular purpose.",
        "lesser affero library 2",
    ),
    ("gpl-3", "licensed under the gnu general public license version 3", "lesser affero library"),
    ("gpl-2", "licensed under the gnu general public license version 2", "lesser affero library 3"),
    ("lgpl-3", "licensed under the gnu lesser general public license version 3", ""),
    ("mpl-2", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at", ""),
    ("mpl-2", "licensed under the mozilla public license version 2 0", ""),
    ("unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.", ""),
    ("cc-by-nc", "licensed under cc by nc 4 0", "sa nd"),
]
_WORD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words_of(text: str) -> list[bytes]:
    r"""A-Z lower-cased; words are [^\x00-\x2F\x3A-\x60\x7B-\x7F]+."""
    return text.encode("utf-8", "surrogatepass").translate(_WORD).split()


def word_counts(docs: DataFrame, vocabulary: set[bytes]) -> dict[bytes, int]:
    """How often the templates' words occur in all documents; at most one row per template word is collected."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        seen: Counter = Counter()
        for t in batch.column("text").to_pylist():
            seen.update(filter(vocabulary.__contains__, words_of(t)))
        return pa.RecordBatch.from_arrays([pa.array([w.decode() for w in seen], pa.string()), pa.array(list(seen.values()), pa.int64())], ["word", "n"])

    rows = arrow_map(docs.select(text_of().alias("text")), run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    return {r["word"].encode(): r["n"] for r in rows}


class Template:
    """Distinct words in global order, with the prefix that a block above the threshold must meet."""

    def __init__(self, label: str, text: str, counts: dict[bytes, int], contained: float, without: str = "") -> None:
        words = words_of(text)
        self.label, self.length = label, len(words)
        self.ordered = sorted(set(words), key=lambda w: (counts.get(w, 0), w))
        self.without = words_of(without)
        n = len(self.ordered)
        self.needed = n if n < SHORT else ceil(contained * n - 1e-9)
        self.prefix = frozenset(self.ordered[: len(self.ordered) - self.needed + 1])

    def best(self, words: list[bytes], places: dict[bytes, list[int]]) -> float:
        """Largest containment of the template in a block of the text, or 0 below the threshold."""
        if len(words) < self.needed:
            return 0.0
        step, best = self.length, 0
        blocks = {b for w in self.prefix for p in places.get(w, ()) for b in (p // step, p // step - 1) if b >= 0}
        for b in blocks:
            low, high, found = b * step, (b + 2) * step, 0

            def inside(w: bytes, low: int = low, high: int = high) -> bool:
                at = places.get(w, ())
                j = bisect_left(at, low)
                return j < len(at) and at[j] < high

            if any(map(inside, self.without)):
                continue
            for i, w in enumerate(self.ordered):
                found += inside(w)
                if found + len(self.ordered) - i - 1 < max(self.needed, best + 1):
                    break
            else:
                best = found
        return best / len(self.ordered)


def scan_texts(texts: list[str], templates: list[tuple[str, str, str]] = TEMPLATES, contained: float = CONTAINED, counts: dict[bytes, int] | None = None) -> Iterator[tuple]:
    """(n_words, n_base, first_word, last_word, base_labels, labels, score) of each text."""
    vocabulary = {w for _, text, without in templates for w in words_of(f"{text} {without}")}
    found = [Template(label, text, counts or {}, contained, without) for label, text, without in templates]
    prefixes = frozenset(w for t in found for w in t.prefix)
    phrases = [(f" {p} ".encode(), label) for p, label in PHRASES.items()]
    for text in texts:
        words = words_of(text)
        line = b" " + b" ".join(words) + b" "
        places, labels = [], set()
        for phrase, label in phrases:
            at, seen, n = line.find(phrase), 0, 0
            while at >= 0:
                n += line.count(b" ", seen, at)  # on from the last place
                seen = at
                places.append(n)
                labels.add(label)
                at = line.find(phrase, at + 1)
        score, own = 1.0 if places else 0.0, set(labels)
        if not prefixes.isdisjoint(words):
            where: dict[bytes, list[int]] = {}
            for i, w in enumerate(words):
                if w in vocabulary:
                    where.setdefault(w, []).append(i)
            for t in found:
                if not t.prefix.isdisjoint(where) and (share := t.best(words, where)) > 0:
                    own.add(t.label)
                    score = max(score, share)
        yield len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels)), ",".join(sorted(own)), score


def scan(docs: DataFrame, templates: list[tuple[str, str, str]] = TEMPLATES, contained: float = CONTAINED) -> DataFrame:
    """Places of the phrases, labels and score of every document."""
    counts = word_counts(docs, {w for _, text, without in templates for w in words_of(f"{text} {without}")})

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        columns = list(zip(*scan_texts(batch.column("text").to_pylist(), templates, contained, counts), strict=True))
        kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"])

    return arrow_map(docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")), run, "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double")


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(documents(spark, sf_dir))
