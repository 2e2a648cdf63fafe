"""Articles in wikitext as columns: sections, infoboxes, links, categories, dates and numbers. No Python runs per row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import MARK, squeeze

# Fixed values.
LOW_SIGNAL = ("bibliography", "citations", "external links", "further reading", "notes", "references", "see also", "sources")
NO_LINKS = ("file:", "image:", "category:", "help:", "user:", "template:", "wikipedia:", "portal:")
INSTANCE_TYPES = {
    "person": ("person", "biography", "officeholder", "scientist", "artist", "musician", "actor", "writer", "athlete", "politician"),
    "organization": ("company", "organization", "university", "school", "hospital", "government agency"),
    "place": ("settlement", "city", "country", "region", "building", "venue", "station", "airport"),
    "creative_work": ("album", "book", "film", "television", "video game", "software", "newspaper", "magazine"),
    "event": ("event", "election", "war", "battle", "competition"),
    "product": ("automobile", "aircraft", "ship", "weapon"),
}
LINK = r"\[\[([^|\]#]+)(?:\|[^\]]*)?\]\]"
MONTH = "January|February|March|April|May|June|July|August|September|October|November|December"
DATE = rf"(?i)\b\d{{1,2}}\s+(?:{MONTH})\s+\d{{4}}\b"
BORN = r"(?i)(?:born|b\.)\s+(?:on\s+)?(\d{1,2}\s+\w+\s+\d{4}|\d{4})"
DIED = r"(?i)(?:died|d\.)\s+(?:on\s+)?(\d{1,2}\s+\w+\s+\d{4}|\d{4})"
FOUNDED = r"(?i)(?:founded|established|formed)\s+(?:in\s+)?(\d{4})"
POPULATION = r"(?i)population\s+(?:of\s+)?(?:approximately\s+)?([0-9,]+)"
_HEAD = r"(?m)^(={2,6})[ \t]*([^\n]+?)[ \t]*\1[ \t]*$"


def strip(c: Column) -> Column:
    """Without white space at both ends, in time linear in the text."""
    return F.btrim(c, F.lit(" \t\n\r"))


def sections(c: Column) -> Column:
    """array(title, level, content): the introduction, if there is any text before the first header, and a section per
    header of two to six equal signs on both sides. A text without headers is one introduction."""
    pieces = F.split(F.regexp_replace(c, _HEAD, f"{MARK}$1{MARK}$2{MARK}"), MARK)
    one = lambda title, level, content: F.struct(title.alias("title"), level.alias("level"), content.alias("content"))
    intro = one(F.lit("Introduction"), F.lit(1), F.when(F.size(pieces) > 1, strip(pieces[0])).otherwise(c))
    rest = F.transform(F.sequence(F.lit(1), F.size(pieces) - 1, F.lit(3)), lambda i: one(F.trim(F.get(pieces, i + 1)), F.length(F.get(pieces, i)), strip(F.get(pieces, i + 2))))
    some = F.when(F.size(pieces) > 1, F.when(pieces[0] == "", rest).otherwise(F.concat(F.array(intro), rest)))
    return F.coalesce(some, F.array(intro))


def telling_sections(c: Column) -> Column:
    """Sections without those that only list notes, sources and links."""
    return F.filter(sections(c), lambda s: ~F.lower(F.trim(s["title"])).isin(*LOW_SIGNAL))


def infobox_key(c: Column) -> Column:
    c = F.lower(strip(c))
    for pattern, to in ((r"[ \t\n\r]+", "_"), (r"[-/]", "_"), (r"__+", "_"), (r"\d+$", ""), (r"^_+|_+$", "")):
        c = F.regexp_replace(c, pattern, to)
    return c


def infobox_value(c: Column) -> Column:
    for pattern, to in ((LINK, "$1"), (r"\[\[|\]\]", ""), (r"(?i)<br\s*/?>", " | "), (r"'{2,}", ""), (r"<[^>]+>", ""), (r"\{\{[^}]+\}\}", "")):
        c = F.regexp_replace(c, pattern, to)
    return strip(c)


def link_text(c: Column) -> Column:
    """A value without link, quote, tag and template marks."""
    for pattern, to in ((r"\[\[([^|\]]+)(?:\|[^\]]+)?\]\]", "$1"), (r"'{2,}", ""), (r"<[^>]+>", ""), (r"\{\{[^}]+\}\}", "")):
        c = F.regexp_replace(c, pattern, to)
    return strip(c)


LIST = r"(?is)\{\{\s*(?:hlist|plainlist|flatlist|ubl|unbulleted\s*list|bulleted\s*list)\b(.*?)\}\}"


def list_items(c: Column) -> Column:
    """Items of a value, sorted: of a list template, else its links, else its parts at the first of comma, new line,
    semicolon and "and" that it holds. Parts have 2 to 99 characters; bars after a template's opening do not part, bars in links do."""
    body = F.regexp_extract(c, LIST, 1)
    head = F.substring_index(body, "{{", 1)
    parts = F.split(F.concat(F.replace(head, F.lit("|"), F.lit(MARK)), F.substring(body, F.length(head) + 1, F.length(body))), MARK)
    fit = lambda a: F.filter(F.transform(a, strip), lambda x: (F.length(x) > 1) & (F.length(x) < 100))
    listed = fit(F.flatten(F.transform(parts, lambda x: F.transform(F.split(x, r"[\n\r]+|\*"), link_text))))
    linked = F.filter(F.transform(F.regexp_extract_all(c, F.lit(LINK), F.lit(1)), strip), lambda x: F.length(x) > 1)
    plain, pieces = link_text(c), F.array().cast("array<string>")
    for sep in (" and ", ";", "\n", ","):
        pieces = F.when(plain.contains(sep), fit(F.split(plain, sep))).otherwise(pieces)
    return F.array_sort(F.array_distinct(F.when(F.size(listed) > 0, listed).when(F.size(linked) > 0, linked).otherwise(pieces)))


def _template(deep: int) -> str:
    """A template that holds templates ``deep`` levels down. All runs are possessive: no text makes the matcher go back
    or call itself once for each character."""
    inner = r"[^{}]*+" if deep == 0 else rf"(?:[^{{}}]++|{_template(deep - 1)})*+"
    return r"\{\{" + inner + r"\}\}"


_NESTED = _template(5)


def infobox(c: Column) -> tuple[Column, Column]:
    """(type, map of properties) of the first infobox; its templates may hold templates, five deep.

    Fields are split at the top level only: templates within are dropped, as their values are, and bars within links
    are kept. A key that comes twice (after its number is cut) joins its different values with bars.
    """
    block = F.regexp_extract(c, r"(?is)\{\{\s*+(Infobox\b(?:[^{}]++|" + _NESTED + r")*+)\}\}", 1)
    inner = F.regexp_replace(F.regexp_replace(block, _NESTED, ""), r"(?is)^\s*Infobox\s*", "")
    inner = F.regexp_replace(inner, r"\[\[([^\[\]|]*)\|([^\[\]]*)\]\]", f"[[$1{MARK}$2]]")
    fields = F.transform(F.split(inner, r"\|"), lambda f: F.replace(f, F.lit(MARK), F.lit("|")))
    pairs = F.transform(F.filter(F.slice(fields, 2, F.size(fields)), lambda f: f.contains("=")), lambda f: F.struct(infobox_key(F.substring_index(f, "=", 1)).alias("k"), infobox_value(F.regexp_replace(f, r"(?s)^[^=]*=", "")).alias("v")))
    good = F.filter(pairs, lambda p: (p["k"] != "") & (p["v"] != "") & (F.length(p["k"]) < 50) & (F.length(p["v"]) < 500))
    keys = F.array_distinct(F.transform(good, lambda p: p["k"]))
    values = F.transform(keys, lambda k: F.array_join(F.array_distinct(F.transform(F.filter(good, lambda p: p["k"] == k), lambda p: p["v"])), " | "))
    found = block != ""
    return F.when(found, strip(F.get(fields, F.lit(0)))), F.when(found, F.map_from_arrays(keys, values))


def instance_type(kind: Column) -> Column:
    low, out = F.lower(kind), F.lit(None).cast("string")
    for name, words in reversed(INSTANCE_TYPES.items()):
        out = F.when(low.rlike("|".join(words)), F.lit(name)).otherwise(out)
    return out


def links(c: Column) -> Column:
    """Distinct targets of the links that lead to articles, sorted."""
    raw = F.transform(F.regexp_extract_all(c, F.lit(LINK), F.lit(1)), lambda x: F.trim(x))
    return F.array_sort(F.array_distinct(F.filter(raw, lambda x: ~F.lower(x).rlike("^(?:" + "|".join(NO_LINKS) + ")"))))


def categories(c: Column) -> Column:
    return F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(c, F.lit(r"(?i)\[\[Category:([^|\]]+)(?:\|[^\]]*)?\]\]"), F.lit(1)), lambda x: F.trim(x))))


def bold_entities(c: Column) -> Column:
    found = F.transform(F.regexp_extract_all(F.substring(c, 1, 5000), F.lit("'''([^']+)'''"), F.lit(1)), lambda x: F.trim(x))
    return F.array_sort(F.array_distinct(F.filter(found, lambda x: (F.length(x) > 2) & (F.length(x) < 100) & ~x.rlike(r"^(?:\[\[|\{\{)"))))


def see_also(c: Column) -> Column:
    part = F.regexp_extract(c, r"(?is)==\s*See also\s*==\s*(.*?)(?:==|\z)", 1)
    raw = F.transform(F.regexp_extract_all(part, F.lit(LINK), F.lit(1)), lambda x: F.trim(x))
    return F.array_sort(F.array_distinct(F.filter(raw, lambda x: (x != "") & ~x.rlike("^(?:File:|Image:|Category:)"))))


def external_links(c: Column) -> Column:
    raw = F.regexp_extract_all(c, F.lit(r"\[https?://[^\s\]]+(?:\s+[^\]]+)?\]"), F.lit(0))
    return F.array_sort(F.array_distinct(F.transform(raw, lambda x: F.substring(x, 1, 200))))


def first_paragraph(c: Column) -> Column:
    """Introduction (or the first 2000 characters), cleaned, at most 1000 characters."""
    from .corpus import clean_wikitext

    head = F.regexp_extract(c, r"(?s)^(.*?)(?:(?<=\n|^)={2,6}[^=\n]|\z)", 1)
    intro = F.when(F.regexp_count(c, F.lit(_HEAD)) > 0, head).otherwise(F.substring(c, 1, 2000))
    return F.substring(clean_wikitext(intro), 1, 1000)


def temporal(c: Column) -> dict[str, Column]:
    """Full dates of the text, years of its first 5000 characters, dates of birth and death of its first 3000."""
    head = F.substring(c, 1, 3000)
    return {
        "dates": F.regexp_extract_all(c, F.lit(DATE), F.lit(0)),
        "years": F.regexp_extract_all(F.substring(c, 1, 5000), F.lit(r"\b(1[0-9]{3}|20[0-2][0-9])\b"), F.lit(1)),
        "births": F.regexp_extract_all(head, F.lit(BORN), F.lit(1)),
        "deaths": F.regexp_extract_all(head, F.lit(DIED), F.lit(1)),
    }


def numeric(c: Column) -> dict[str, Column]:
    hit = lambda p: F.nullif(F.regexp_extract(c, p, 1), F.lit(""))
    return {"population": F.replace(hit(POPULATION), F.lit(","), F.lit("")), "founded_year": hit(FOUNDED)}


def articles(pages: DataFrame, key: str, text: str = "text") -> DataFrame:
    """One row per article with all that is read from its wikitext."""
    c = F.col(text)
    kind, properties = infobox(c)
    a = pages.select(key, kind.alias("infobox_type"), properties.alias("properties"), sections(c).alias("sections"), links(c).alias("links"), categories(c).alias("categories"), bold_entities(c).alias("entities"), see_also(c).alias("see_also"), external_links(c).alias("external_links"), first_paragraph(c).alias("first_paragraph"), *[v.alias(k) for k, v in {**temporal(c), **numeric(c)}.items()])
    return a.withColumn("instance_type", instance_type(F.col("infobox_type")))


def passages_of_sections(pages: DataFrame, key: str, chunks, text: str = "text") -> DataFrame:
    """(key, section_ord, section, chunk_index, chunk): telling sections cut by a chunker column function."""
    s = pages.select(key, F.posexplode(telling_sections(F.col(text))).alias("section_ord", "s"))
    c = s.select(key, "section_ord", F.col("s.title").alias("section"), F.posexplode(chunks(squeeze(F.col("s.content")))).alias("chunk_index", "c"))
    return c.select(key, "section_ord", "section", "chunk_index", F.col("c.text").alias("chunk"))
