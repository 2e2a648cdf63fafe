"""Many terms in many texts: an automaton over a table of terms, and chains of filter steps.

The terms of a table go into one Aho-Corasick automaton per task, so a text is read once however many terms there are.
Terms are told to all tasks in blocks of MOST_TERMS; with more, each block reads the texts again.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import materialize
from .chunking import joined, text_slices

MOST_TERMS = 100_000
_LONGEST = 10**11
_automata: dict[int, _Terms] = {}


class _Terms:
    """The automaton of a block of terms."""

    def __init__(self, terms: list[str]) -> None:
        import ahocorasick

        self.longest = max(map(len, terms), default=0)
        self.own = ahocorasick.Automaton()
        for t in terms:
            self.own.add_word(t, t)
        self.own.make_automaton()

    def iter(self, text: str) -> Iterator[tuple[int, str]]:
        return self.own.iter(text)


def _automaton(terms: list[str]) -> _Terms:
    """One automaton per Python worker and block of terms."""
    key = hash(tuple(terms))
    if key not in _automata:
        _automata.clear()
        _automata[key] = _Terms(terms)
    return _automata[key]


def _inside(c: str) -> bool:
    return c.isalnum() or c == "_"


def _stands_alone(text: str, start: int, end: int) -> bool:
    """Whether a word's edge lies at both ends of the match, as for a pattern between two edges."""
    at = lambda i: 0 <= i < len(text) and _inside(text[i])
    return at(start - 1) != at(start) and at(end - 1) != at(end)


def _blocks(terms: DataFrame) -> Iterator[list[str]]:
    """The distinct terms, trimmed and in lower case, at most MOST_TERMS at a time."""
    own = materialize(terms.select(F.lower(F.btrim("term", F.lit(" \t\n\r"))).alias("term")).where("term <> ''").distinct(), "terms")
    parts = max(1, -(-own.count() // MOST_TERMS))
    for i in range(parts):
        block = own if parts == 1 else own.where(F.pmod(F.xxhash64("term"), F.lit(parts)) == i)
        yield sorted(r["term"] for r in block.collect())


def _read(terms: list[str], found: Callable, kind: str) -> Callable[[Column], Column]:
    answer = pa.string() if kind == "string" else pa.list_(pa.string())

    @F.arrow_udf(kind)
    def read(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = _automaton(terms) if terms else None
        for batch in texts:
            yield joined([pa.array([None if t is None or own is None else found(own, t) for t in part.to_pylist()], answer) for part in text_slices(batch)], answer)

    return read


def _first(own, text: str) -> str | None:
    """Place and name of the leftmost term that stands alone, of several at one place the longest."""
    best = None
    for end, term in own.iter(text):
        start = end + 1 - len(term)
        if best is not None and end + 1 - own.longest > best[0]:
            break  # terms that end here or later begin after the best one
        if (best is None or (start, -len(term)) < best[:2]) and _stands_alone(text, start, end + 1):
            best = (start, -len(term), term)
    return None if best is None else f"{best[0]:012d}{_LONGEST + best[1]:012d}{best[2]}"  # the smallest of several is the one


def first_term(rows: DataFrame, text: str, terms: DataFrame, name: str = "term") -> DataFrame:
    """``rows`` with the first listed term (column term) that stands in a text as whole words, in any case, or null.

    A null text, an empty table of terms and blank terms find nothing. Of terms at one place the longest is given.
    """
    blocks = list(_blocks(terms))
    parts = [f"_found_{i}" for i in range(len(blocks))]
    out = rows.withColumns({p: _read(block, _first, "string")(F.lower(F.col(text))) for p, block in zip(parts, blocks, strict=True)})
    best = F.array_min(F.array(*parts))
    return out.withColumn(name, F.substring(best, F.lit(25), F.length(best))).drop(*parts)


def _all(own, text: str) -> list[str]:
    return sorted({term for _, term in own.iter(text)})


def contained_terms(rows: DataFrame, text: str, terms: DataFrame, keep: list[str]) -> DataFrame:
    """(keep, term): every listed term that a text contains, within words too, in any case."""
    out = None
    for block in _blocks(terms):
        some = rows.select(*keep, F.explode(_read(block, _all, "array<string>")(F.lower(F.col(text)))).alias("term"))
        out = some if out is None else out.unionByName(some)
    return out


def best_with_words(queries: DataFrame, texts: DataFrame, most: int = 5) -> DataFrame:
    """(qid, tid, similarity, rank): texts that contain any of the query's long words, by their stored similarity.

    ``queries`` (qid, query): of the first five words those of four characters or more count, in lower case. ``texts`` (tid, text,
    similarity). A query's best texts are among the best of each of its words, so only these are kept of a word that very many texts hold.
    """
    words = F.transform(F.filter(F.slice(F.filter(F.split("query", r"[ \t\n\r\f\x0B]+"), lambda w: w != ""), 1, 5), lambda w: F.length(w) > 3), F.lower)
    asked = materialize(queries.select("qid", F.explode(F.array_distinct(words)).alias("term")), "asked-words")
    order = [F.desc_nulls_last("similarity"), F.col("tid")]
    held = contained_terms(texts, "text", asked.select("term"), ["tid", "similarity"])
    best = held.withColumn("k", F.row_number().over(Window.partitionBy("term").orderBy(*order))).where(F.col("k") <= most)
    pairs = asked.join(best, "term").select("qid", "tid", "similarity").distinct()
    return pairs.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(*order))).where(F.col("rank") <= most)


def nodes_with_terms(asked: DataFrame, query: str, nodes: DataFrame, key: str, text: str, most: int) -> DataFrame:
    """(query, key, matched, rank): nodes whose text contains terms of a query (query, term), the ``most`` with most of them."""
    asked = materialize(asked.select(query, "term").distinct(), "asked-terms")
    held = contained_terms(nodes, text, asked.select("term"), [key])
    matched = held.join(asked, "term").groupBy(query, key).agg(F.count("*").alias("matched"))
    order = Window.partitionBy(query).orderBy(F.desc("matched"), key)
    return matched.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)


def with_neighbours(found: DataFrame, key: str, edges: DataFrame, most: int) -> DataFrame:
    """``found`` with the first ``most`` distinct neighbours of each node over undirected edges (src, dst)."""
    both = edges.select(F.col("src").alias(key), F.col("dst").alias("other")).unionByName(edges.select(F.col("dst").alias(key), F.col("src").alias("other")))
    near = both.join(found.select(key).distinct(), key, "left_semi").distinct()
    k = F.row_number().over(Window.partitionBy(key).orderBy("other"))
    lists = near.withColumn("k", k).where(F.col("k") <= most).groupBy(key).agg(F.sort_array(F.collect_list("other")).alias("neighbours"))
    none = F.array().cast(lists.schema["neighbours"].dataType)
    return found.join(lists, key, "left").withColumn("neighbours", F.coalesce("neighbours", none))


@dataclass(frozen=True)
class Step:
    """A filter step: reasons to reject or rewrite the text that reached it, as column functions of that text."""

    name: str
    rejects: Callable[[Column], Column]
    status: int
    rewrites: Callable[[Column], Column] | None = None  # the new text, or null where it stays


def run_chain(rows: DataFrame, text: str, steps: list[Step]) -> DataFrame:
    """``rows`` with action (allow, reject, rewrite), stage (the step that decided last), status and final_text.

    Steps run in order on the text that the ones before left; the first that rejects ends the chain. A null answer of a
    step lets the text pass.
    """
    out = rows.withColumns({"action": F.lit("allow"), "stage": F.lit(None).cast("string"), "status": F.lit(None).cast("int"), "final_text": F.col(text)})
    for s in steps:
        going = F.col("action") != "reject"
        out = out.withColumn("_bad", going & F.coalesce(s.rejects(F.col("final_text")), F.lit(False)))
        new = F.when(going & ~F.col("_bad"), s.rewrites(F.col("final_text"))) if s.rewrites else F.lit(None).cast("string")
        out = out.withColumn("_new", new)
        changed = F.col("_new").isNotNull()
        out = out.withColumns({
            "action": F.when(F.col("_bad"), "reject").when(changed, "rewrite").otherwise(F.col("action")),
            "stage": F.when(F.col("_bad") | changed, s.name).otherwise(F.col("stage")),
            "status": F.when(F.col("_bad"), s.status).otherwise(F.col("status")),
            "final_text": F.coalesce("_new", "final_text"),
        }).drop("_bad", "_new")
    return out


def answer_json(answer: Column) -> Column:
    """A model's answer as a variant, without code fences; null where it is no JSON."""
    fenced = F.btrim(F.regexp_extract(answer, r"(?is)```(?:json)?\s*(.*?)(?:```|\z)", 1), F.lit(" \t\n\r"))
    return F.try_parse_json(F.when(fenced.rlike(r"^[{\[]"), fenced).otherwise(F.btrim(answer, F.lit(" \t\n\r"))))


def harm_step(answer: Column) -> Step:
    """Rejects what the model calls harmful; an answer that cannot be read lets the text pass."""
    harmful = F.try_variant_get(answer_json(answer), "$.harmful", "string")
    return Step("harm", lambda _: harmful.isNotNull() & ~harmful.isin("", "false", "0", "0.0"), 403)


def claim_step(answer: Column) -> Step:
    """Rejects texts without a claim, and rewrites a text to the claim that the model took from it."""
    got = answer_json(answer)
    action = F.upper(F.coalesce(F.try_variant_get(got, "$.action", "string"), F.lit("PASS_THROUGH")))
    claim = F.btrim(F.coalesce(F.try_variant_get(got, "$.claim", "string"), F.lit("")), F.lit(" \t\n\r"))
    empty = (action == "EXTRACT_CLAIM") & (claim == "")
    return Step("claim", lambda _: (action == "REJECT_NO_CLAIM") | empty, 422, lambda _: F.when(action == "EXTRACT_CLAIM", claim))


def blacklist_step(term: str = "term") -> Step:
    """Rejects texts in which ``first_term`` found a listed term."""
    return Step("blacklist", lambda _: F.col(term).isNotNull(), 403)
