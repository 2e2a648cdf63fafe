"""Chat formatting: event logs folded into conversations, rendered, and read back.

An event log has one row per event: conversation, sequence number, turn, kind (message, delta, edit, regenerate),
role and text. Per turn, the last message, edit or regeneration sets the text (a regeneration starts an assistant
turn anew; its text may be empty and come in deltas), later deltas are appended in order. The fold of a turn runs on
that turn's events alone, so a long conversation is first reduced turn by turn; a conversation's final turns are then
put in order and rendered. Everything is DataFrame functions.

Template: ``### role: text</turn>\\n``. Within roles and texts ``\\`` is written ``\\s``, ``#`` ``\\h``, ``<``
``\\l`` and, in roles, ``:`` ``\\c``, so control strings occur only where the template puts them, and every string
comes back. The loss mask covers the texts of assistant turns.

Nulls: a null text is empty, a null role the empty role, events without a sequence come first, a null conversation
is one conversation, a null turn comes first. Rows of a plain table that share a turn are turns of their own,
ordered by role and text; repeated rows are kept; its texts are written as a log of messages, deltas, edits and
regenerations before they are folded. A conversation is one text, so its turns meet in one task after each
was folded alone; the time is in proportion to their length. Very long texts are kept whole.
Empty tables give empty results; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

OPEN, CLOSE, SEP = "### ", "</turn>\n", ": "
#: Order within the escapes matters: the backslash first when writing, last when reading.
_ESCAPES = (("\\", "\\s"), ("#", "\\h"), ("<", "\\l"), (":", "\\c"))


def escape(c: Column, role: bool = False) -> Column:
    for raw, code in _ESCAPES if role else _ESCAPES[:3]:
        c = F.replace(c, F.lit(raw), F.lit(code))
    return c


def unescape(c: Column) -> Column:
    for raw, code in reversed(_ESCAPES):
        c = F.replace(c, F.lit(code), F.lit(raw))
    return c


def fold_events(events: DataFrame) -> DataFrame:
    """(conv_id, turn, line, role, text): the final messages of an event log (conv_id, seq, turn, kind, role, text).

    ``line`` tells messages apart that share a turn; without that column every turn is one message.
    """
    line = F.coalesce(F.col("line"), F.lit(0)) if "line" in events.columns else F.lit(0)
    e = events.select("conv_id", "turn", line.cast("long").alias("line"), F.coalesce(F.col("seq").cast("long"), F.lit(-(1 << 62))).alias("seq"), "kind", "role", F.coalesce("text", F.lit("")).alias("text"))
    sets = F.col("kind").isin("message", "edit", "regenerate")
    turns = e.groupBy("conv_id", "turn", "line").agg(
        F.max(F.when(sets, F.col("seq"))).alias("since"),
        F.max_by("role", F.when(F.col("role").isNotNull(), F.col("seq"))).alias("role"),
        F.sort_array(F.collect_list(F.struct("seq", "text"))).alias("log"),
    )
    kept = F.filter("log", lambda x: F.col("since").isNull() | (x["seq"] >= F.col("since")))
    return turns.select("conv_id", "turn", "line", "role", F.array_join(F.transform(kept, lambda x: x["text"]), "").alias("text"))


def events_of(conversations: DataFrame) -> DataFrame:
    """A plain table (conv_id, turn, role, text) as the event log of a chat service that gives its messages.

    ``line`` is a message's number in its conversation, by turn, role and text, so rows that share a turn, repeated ones
    too, stay messages of their own. Assistant texts are streamed in two deltas after a message that opens them, and
    every second time after a first answer that was regenerated; other texts are sent whole, or drafted and then
    edited. Sequence numbers ascend within a conversation; the log's rows have no order.
    """
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    rows = conversations.withColumn("line", F.row_number().over(order).cast("long")).withColumn("text", F.coalesce("text", F.lit("")))
    half = F.floor(F.length("text") / 2).cast("int")
    first, second = F.substring("text", F.lit(1), half), F.substring("text", half + 1, F.length("text"))
    draft = F.concat(F.lit("draft: "), F.substring("text", 1, 20))

    def log(*events: tuple[str, Column]) -> Column:
        return F.array(*[F.struct(F.lit(k).alias("step"), F.lit(kind).alias("kind"), text.alias("text")) for k, (kind, text) in enumerate(events)])

    none, again = F.lit(""), F.col("line") % 2 == 0
    streamed = F.when(again, log(("message", draft), ("delta", draft), ("regenerate", none), ("delta", first), ("delta", second))).otherwise(log(("message", none), ("delta", first), ("delta", second)))
    sent = F.when(again, log(("message", draft), ("edit", F.col("text")))).otherwise(log(("message", F.col("text"))))
    each = rows.select("conv_id", "turn", "role", "line", F.explode(F.when(F.col("role") == "assistant", streamed).otherwise(sent)).alias("e"))
    role = F.when(F.col("e.kind") != "delta", F.col("role"))  # deltas do not repeat it
    return each.select("conv_id", (8 * F.col("line") + F.col("e.step")).alias("seq"), "turn", "line", F.col("e.kind").alias("kind"), role.alias("role"), F.col("e.text").alias("text"))


def render(messages: DataFrame) -> DataFrame:
    """(conv_id, formatted, loss): one text per conversation, with the loss mask as (start, length) in code points."""
    m = messages.withColumn("role", F.coalesce("role", F.lit(""))).withColumn("text", F.coalesce("text", F.lit("")))
    m = m.withColumn("head", F.concat(F.lit(OPEN), escape(F.col("role"), role=True), F.lit(SEP))).withColumn("body", escape(F.col("text")))
    # running ends of the turns in one pass of a window, in the order in which they are put together below
    m = m.withColumn("size", F.length("head") + F.length("body") + len(CLOSE))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text", "line").rowsBetween(Window.unboundedPreceding, 0)
    m = m.withColumn("end", F.sum(F.col("size").cast("long")).over(order))
    turns = m.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text", "line", "end", "head", "body"))).alias("turns"))
    own = F.filter("turns", lambda t: t["role"] == "assistant")
    mask = F.transform(own, lambda t: F.struct((t["end"] - len(CLOSE) - F.length(t["body"])).alias("start"), F.length(t["body"]).cast("long").alias("length")))
    text = F.array_join(F.transform("turns", lambda t: F.concat(t["head"], t["body"], F.lit(CLOSE))), "")
    return turns.select("conv_id", text.alias("formatted"), mask.alias("loss"))


def parse(formatted: DataFrame) -> DataFrame:
    """Read rendered texts back: (conv_id, formatted, loss, turns) with turns as (role, text), unescaped."""
    blocks = F.slice(F.split("formatted", CLOSE.replace("\n", "\\n")), F.lit(1), F.greatest(F.size(F.split("formatted", CLOSE.replace("\n", "\\n"))) - 1, F.lit(0)))

    def turn(b: Column) -> Column:
        cut = F.instr(b, SEP)
        role = F.substring(b, F.lit(len(OPEN) + 1), cut - len(OPEN) - 1)
        return F.struct(unescape(role).alias("role"), unescape(F.substring(b, cut + len(SEP), F.length(b))).alias("text"))

    return formatted.withColumn("turns", F.transform(blocks, turn))


def masked_text(formatted: str = "formatted", loss: str = "loss") -> Column:
    """All text under the loss mask, unescaped and joined without anything between."""
    return unescape(F.array_join(F.transform(loss, lambda x: F.substring(F.col(formatted), (x["start"] + 1).cast("int"), x["length"].cast("int"))), ""))


def digests(formatted: DataFrame) -> DataFrame:
    """What rendered texts give when they are read back: number and digest of turns, size and digest of the mask."""
    read = parse(formatted).withColumn("masked", masked_text())
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(told.cast("binary"), 256).alias("turns_sha256"),
        F.length("masked").cast("long").alias("loss_chars"),
        F.sha2(F.col("masked").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op6_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .common import materialize

    table = spark.read.parquet(f"{sf_dir}/conversations.parquet").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    probe = "\\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", probe), (-7, 1, "assistant", probe)], table.schema)
    log = materialize(events_of(table.unionByName(extra)), "events")
    return digests(materialize(render(fold_events(log)), "formatted"))


def _sql(read: str = "conversations") -> str:
    """DuckDB SQL for op6's rows. Escapes cancel out in what is read back; they only count in the formatted length."""
    esc = "replace(replace(replace({0}, '\\', '\\s'), '#', '\\h'), '<', '\\l')"
    role = "replace(" + esc.format("role") + ", ':', '\\c')"
    probe = "'\\### Assistant: </turn> ok'"
    size = f"length({role}) + length({esc.format('text')}) + {len(OPEN) + len(SEP) + len(CLOSE)}"
    return f"""WITH t AS (SELECT conv_id::BIGINT AS conv_id, turn::BIGINT AS turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM {read}
        UNION ALL SELECT -7, 0, 'user', {probe} UNION ALL SELECT -7, 1, 'assistant', {probe}),
    s AS (SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS told,
        coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '') AS loss, sum({size})::BIGINT AS formatted_chars FROM t GROUP BY conv_id)
    SELECT conv_id, n_turns, sha256(told) AS turns_sha256, length(loss)::BIGINT AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars FROM s"""


ORACLE_SQL = _sql()
