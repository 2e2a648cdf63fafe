"""Search queries made of a claim, the ranking of what they find, and labelled cases: mapped from records, or made by
changing facts. Column functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T
from .claims import _runs

# Fixed values.
NAME_STOP = ("A", "An", "Der", "Die", "Das", "Den", "Dem", "Des", "Ein", "Eine", "Einem", "Einen", "The")
KEYWORD_STOP = ("a", "an", "and", "are", "as", "be", "been", "being", "by", "das", "dem", "den", "der", "des", "die", "ein", "eine", "einem", "einen", "erfunden", "for", "from", "hat", "in", "is", "it", "mit", "of", "on", "or", "the", "to", "und", "von", "was", "were")
VERBS = ("is", "are", "was", "were", "be", "been", "being", "has", "have", "had", "hat", "haben", "ist", "war", "wurde", "invented", "erfunden", "founded", "created", "developed", "discovered", "won", "became", "built")
DETERMINERS = ("the", "a", "an", "der", "die", "das", "ein", "eine", "einem", "einen")
WORD, KEYWORD = r"[a-zA-ZÀ-ɏ][a-zA-Z0-9À-ɏ-]*", r"[a-z0-9À-ɏ]+"
NEGATIONS = ((" is ", " is not "), (" was ", " was not "), (" has ", " does not have "), (" can ", " cannot "))
SWAPS = (("United States", "Canada"), ("Canada", "United States"), ("England", "France"), ("France", "Germany"), ("Europe", "Asia"), ("Asia", "Europe"), ("first", "last"), ("last", "first"), ("largest", "smallest"), ("smallest", "largest"), ("north", "south"), ("south", "north"), ("east", "west"), ("west", "east"))
YEAR_STEPS, NUMBER_STEPS = (-50, -20, -10, 10, 20, 50), (-100, -10, -5, 5, 10, 100)
NO_ANSWER = ("cannot be answered", "not enough information", "insufficient context", "unable to answer", "don't have enough", "cannot determine", "not provided in the", "information is not available")
RECORD_FIELDS = {"answer": ("answer", "response", "output"), "text": ("text", "claim", "statement"), "question": ("question", "query", "input", "prompt")}
UNTRUE, TRUE = ("hallucination", "false", "0", "no"), ("factual", "true", "1", "yes", "faithful")


def short(c: Column) -> Column:
    """A query: single spaces, 200 characters at most, empty for null."""
    return F.substring(T.squeeze(F.coalesce(c, F.lit(""))), 1, 200)


def keywords(c: Column) -> Column:
    return F.filter(F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(KEYWORD), F.lit(0)), lambda w: ~w.isin(*KEYWORD_STOP))


def named_candidates(c: Column, most: int = 4) -> Column:
    """Distinct runs of capitalized words: those of most words first, then the longest, then the first."""
    words = F.transform(F.split(F.coalesce(c, F.lit("")), T.SPACES), lambda w: F.regexp_replace(w, r"^[^\p{L}\p{N}_]+|[^\p{L}\p{N}_-]+$", ""))
    runs = _runs(F.filter(words, lambda w: w != ""), lambda w: w.rlike(r"^\p{Lu}.") & ~w.isin(*NAME_STOP))
    ranked = F.array_sort(F.transform(runs, lambda r, i: F.struct((-F.size(F.split(r, " "))).alias("n"), (-F.length(r)).alias("l"), i.alias("i"), F.substring(r, 1, 200).alias("r"))))
    return F.slice(F.array_distinct(F.transform(ranked, lambda x: x["r"])), 1, most)


def subject_guess(c: Column) -> Column:
    """Up to four words before the first verb, without the articles they begin with; empty if there are none."""
    words = F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(WORD), F.lit(0))
    verb = F.array_position(F.transform(words, lambda w: F.lower(w).isin(*VERBS)), True).cast("int")
    before = F.slice(words, F.lit(1), F.greatest(verb - 1, F.lit(0)))
    first = F.array_position(F.transform(before, lambda w: ~F.lower(w).isin(*DETERMINERS)), True).cast("int")
    return F.when((verb > 1) & (first > 0), short(F.array_join(F.slice(before, F.greatest(first, F.lit(1)), F.lit(4)), " "))).otherwise("")


def query_candidates(text: Column, subject: Column, predicate: Column, obj: Column, normalized: Column) -> Column:
    """Distinct queries of a claim, the most telling first; the text's beginning if there is none."""
    telling = F.array_join(F.slice(keywords(F.concat_ws(" ", F.coalesce(predicate, F.lit("")), F.coalesce(obj, F.lit("")), text)), 1, 6), " ")
    some = lambda c: F.nullif(c, F.lit(""))
    parts = [F.array(short(subject), subject_guess(text), short(obj), short(F.concat_ws(" ", some(subject), some(predicate), some(obj))), short(normalized)), named_candidates(text), F.array(short(telling), short(text))]
    found = F.array_distinct(F.filter(F.concat(*parts), lambda q: q != ""))
    return F.when(F.size(found) > 0, found).otherwise(F.array(short(F.substring(text, 1, 100))))


def result_score(r: DataFrame) -> DataFrame:
    """Adds ``score`` to search results (title, snippet, matched_query, query_index, result_index) of a claim (subject,
    predicate, object): exact and partial titles, the object's words, the snippet's length, less late places."""
    low = lambda c: F.lower(T.squeeze(F.coalesce(F.col(c), F.lit(""))))
    r = r.withColumns({f"_{c}": low(c) for c in ("title", "matched_query", "subject", "object")}).withColumn("_snippet", F.lower(T.html_text(F.coalesce("snippet", F.lit("")))))
    title, snippet, query, subject, obj = (F.col(f"_{c}") for c in ("title", "snippet", "matched_query", "subject", "object"))
    points = lambda cases, other=0.0: F.coalesce(*[F.when(test, F.lit(n)) for test, n in cases], F.lit(other))
    r = r.withColumn("_seen", F.array_union(keywords(title), keywords(snippet)))
    named = F.size(F.filter(F.split(subject, " "), lambda t: title.contains(t))) * 5.0 + points([(title == subject, 40.0), (title.contains(subject), 15.0)])
    score = F.when(subject != "", named).otherwise(0.0) + F.when(query != "", points([(query == subject, 10.0), (query == title, 6.0)])).otherwise(0.0)
    score = score + F.when(obj != "", points([(snippet.contains(obj), 12.0), (title.contains(obj), 6.0)])).otherwise(0.0)
    score = score + F.size(F.filter(keywords(F.col("object")), lambda w: F.array_contains(F.col("_seen"), w))) * 6.0
    score = score + F.size(F.filter(keywords(F.col("predicate")), lambda w: snippet.contains(w))) * 2.5
    score = score + F.least(F.lit(8.0), F.length(snippet) / 80.0) - F.col("query_index") * 0.75 - F.col("result_index") * 1.5
    return r.withColumn("score", score).drop("_title", "_snippet", "_matched_query", "_subject", "_object", "_seen")


def best_results(results: DataFrame, keys: list[str], most: int = 3) -> DataFrame:
    """The best result of each claim, then the best that its object's query found, then by score: at most ``most``
    pages with ``place`` and ``similarity``. A page counts where it was found first; ties by query and result."""
    order = ["query_index", "result_index"]
    seen = T.first_seen(results.withColumn("_page", F.coalesce(F.nullif(F.col("page_id").cast("string"), F.lit("")), F.col("title"))).where("_page <> ''"), [*keys, "_page"], order)
    w = Window.partitionBy(*keys)
    r = result_score(seen).withColumn("_rank", F.row_number().over(w.orderBy(F.desc("score"), *order)))
    of_object = (F.col("_rank") > 1) & (short(F.col("object")) != "") & (F.col("matched_query") == short(F.col("object")))
    r = r.withColumn("_second", F.min(F.when(of_object, F.col("_rank"))).over(w))
    turn = F.when(F.col("_rank") == 1, 0).when(F.col("_rank") == F.col("_second"), 1).otherwise(2)
    r = r.withColumn("_turn", turn).withColumn("place", F.row_number().over(w.orderBy("_turn", "_rank"))).where(F.col("place") <= most)
    return r.withColumn("similarity", F.greatest(F.lit(0.65), 0.9 - (F.col("place") - 1) * 0.08)).drop("_page", "_rank", "_second", "_turn")


def replace_first(c: Column, old: Column, new: Column) -> Column:
    at = F.instr(c, old)
    return F.when(at > 0, F.concat(F.substring(c, F.lit(1), at - 1), new, F.substring(c, at + F.length(old), F.length(c)))).otherwise(c)


def draw(key: Column, purpose: str) -> Column:
    """A number below 2^28 that depends on the key and the purpose only."""
    return F.conv(F.substring(F.md5(F.concat(key.cast("string"), F.lit(":" + purpose)).cast("binary")), 1, 7), 16, 10).cast("long")


def false_variant(text: Column, key: Column) -> tuple[Column, Column]:
    """(text, kind) of a statement made false: 40 % negated, 42 % with another year or number, 18 % with another name.

    The choices are hashes of the key. A text that offers nothing to change stays, with the kind "synthetic".
    """
    way, low = draw(key, "way") % 100, F.lower(text)
    step = lambda steps, purpose: F.element_at(F.array(*[F.lit(s) for s in steps]), (draw(key, purpose) % len(steps) + 1).cast("int"))
    year, number = F.regexp_extract(text, rf"{T.BORDER}(?:19|20)\d{{2}}{T.BORDER}", 0), F.regexp_extract(text, rf"{T.BORDER}\d+{T.BORDER}", 0)
    other = number.try_cast("long") + step(NUMBER_STEPS, "number")
    negated, kind, swapped, swap = text, F.lit("synthetic"), text, F.lit("synthetic")
    for old, new in reversed(NEGATIONS):
        negated, kind = F.when(low.contains(old), replace_first(text, F.lit(old), F.lit(new))).otherwise(negated), F.when(low.contains(old), "negation").otherwise(kind)
    for old, new in reversed(SWAPS):
        swapped, swap = F.when(text.contains(old), replace_first(text, F.lit(old), F.lit(new))).otherwise(swapped), F.when(text.contains(old), "entity_swap").otherwise(swap)
    dated = F.when(year != "", replace_first(text, year, (year.try_cast("long") + step(YEAR_STEPS, "year")).cast("string"))).when(other >= 0, replace_first(text, number, other.cast("string"))).otherwise(text)
    date_kind = F.when(year != "", "date_error").when(other >= 0, "numeric_error").otherwise("synthetic")
    return F.when(way < 40, negated).when(way < 82, dated).otherwise(swapped), F.when(way < 40, kind).when(way < 82, date_kind).otherwise(swap)


def _smallest_draws(cases: DataFrame, needed: int) -> DataFrame:
    """The ``needed`` cases with the smallest draws, ties by id: whole buckets of draws, and of the last one those that fit.

    Only the ids of one bucket (a 4,096th of the cases) are ordered in one task.
    """
    order = draw(F.col("id"), "case")
    rows = cases.withColumn("_bucket", F.shiftright(order, 16))
    cut, before = 1 << 12, 0
    for r in sorted(rows.groupBy("_bucket").agg(F.count("*").alias("n")).collect()):  # at most 4,096 rows
        if before + r["n"] > needed:
            cut = r["_bucket"]
            break
        before += r["n"]
    last = rows.where(F.col("_bucket") == cut).select("id").orderBy(order, "id").limit(needed - before).withColumn("_in", F.lit(True))
    rows = rows.where(F.col("_bucket") <= cut).join(F.broadcast(last), "id", "left")
    return rows.where((F.col("_bucket") < cut) | F.col("_in")).drop("_bucket", "_in")


def with_false_variants(cases: DataFrame, share: float = 0.4) -> DataFrame:
    """Cases (id, text, label) and, if under ``share`` of them are false, as many false variants of true ones (of those
    with the smallest hashes) as floor(n * share / (1 - share)) false ones take. A variant's id is -id - 1."""
    n = cases.agg(F.count("*").alias("n"), F.count_if(~F.col("label")).alias("false")).first()
    own = cases.select("id", "text", "label", F.lit(None).cast("string").alias("kind"))
    needed = int(n["n"] * share / (1 - share)) - n["false"] if n["n"] and n["false"] / n["n"] < share else 0
    if needed <= 0:
        return own
    text, kind = false_variant(F.col("text"), F.col("id"))
    chosen = _smallest_draws(cases.where("label"), needed)
    return own.unionByName(chosen.select((-F.col("id") - 1).alias("id"), text.alias("text"), F.lit(False).alias("label"), kind.alias("kind")))


def record_cases(records: DataFrame, key: str, source: str) -> DataFrame:
    """(key, text, label, notes, source) of records with any of several fields (strings; missing columns count as null).

    An answer stands before a text; a lone question, and an answer that says that there is none, are left out. The label
    is read from is_hallucination, hallucination, label, is_factual, is_correct or hallucinated, the first that is there;
    without any it is true.
    """
    have = lambda c: F.trim(F.col(c).cast("string")) if c in records.columns else F.lit(None).cast("string")
    first = lambda names: F.coalesce(*[F.nullif(have(c), F.lit("")) for c in names])
    flag = lambda c: F.when(have(c).isNotNull(), ~F.lower(have(c)).isin("false", "0", ""))
    answer, text, question = (first(RECORD_FIELDS[k]) for k in ("answer", "text", "question"))
    word = lambda c: F.lower(have(c))
    told = F.when(have("hallucination").isNotNull(), ~word("hallucination").isin("true", "1", "yes", "hallucination"))
    label = F.when(word("label").isin(*UNTRUE), False).when(word("label").isin(*TRUE), True).when(have("label").isNotNull(), F.coalesce(have("label").try_cast("int") != 0, F.lit(True)))
    out = records.select(key, F.coalesce(answer, F.when(~(text.endswith("?") & question.isNotNull()), text)).alias("text"), F.coalesce(~flag("is_hallucination"), told, label, flag("is_factual"), flag("is_correct"), ~flag("hallucinated"), F.lit(True)).alias("label"), F.coalesce(F.concat(F.lit("Q: "), F.substring(question, 1, 80)), F.lit("")).alias("notes"), F.lit(source).alias("source"))
    return out.where(F.col("text").isNotNull() & ~F.lower("text").rlike("|".join(NO_ANSWER)))
