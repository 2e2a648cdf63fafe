"""Prefix trie of conversations: distinct turn sequences as nodes, kept by preorder intervals.

A turn is named by a digest of role and text. The name of a prefix is the exclusive or of its (place, turn) hashes, 128
bits in all, which a distributed prefix fold gives to every turn of a conversation of any length; a node is a
(depth, name), and its parent's name comes from undoing the last turn. The distinct nodes are ranked lexicographically
by ranking their leaves: a leaf's sort key holds only the nodes of its path that have fewer members than their parent,
since all others cannot tell two leaves apart. As every such node sends away a conversation of its own depth, a key has
at most sqrt(2 n) entries for n turns. The node's interval of leaf ranks, with its depth, is its place in preorder;
the end of its subtree is where its last leaf stands, and leaves and savings of the subtree are differences of prefix
sums over that order, folded by ranges.

Joins from many rows to one (children to their parent, turns to a node, nodes to their last leaf) place hot keys where
the rows lie. The ids that end at a node are joined into texts by ranges, and one task reads such texts in order into
the digest without holding them.

Nulls: a null role or text is empty, a null turn comes first; rows without a conversation are one conversation, which
counts as a member but has no id to show and takes no turns from others (the smallest 64-bit number is read as null). Turns that share a
number are ordered by their digest; repeated rows are turns of their own. Empty texts are turns without words. Very
long texts are hashed and counted whole. An empty table gives no nodes; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import numbered, running
from .common import SPACE, materialize, spread_join

NO_ID = -(1 << 63)
NODE = ["depth", "h1", "h2"]
#: Ids that one piece of a node's list of ends holds.
PIECE = 1 << 16
FAMILY, MOST_HEAD = 20, 3


def turns_of(conversations: DataFrame) -> DataFrame:
    """(c, d, total, turn_digest, words): each conversation's turns, numbered from 1 in their order."""
    role, text = (F.coalesce(F.col(n).cast("string"), F.lit("")) for n in ("role", "text"))
    rows = conversations.select(
        F.coalesce(F.col("conv_id").cast("long"), F.lit(NO_ID)).alias("c"),
        F.col("turn").cast("long").alias("turn"),
        F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256).alias("turn_digest"),
        F.regexp_count(text, F.lit(f"[^{SPACE}]+")).cast("long").alias("words"),
    )
    return running(rows, ["c"], [F.col("turn"), F.col("turn_digest")], {"d": F.lit(1)}).drop("turn")


def rebuilt(turns: DataFrame) -> DataFrame:
    """(c, d, turn_digest, words, last): the first h turns of a conversation's family head, then its own after h.

    Place 0, without text, is the root. ``last``: the conversation ends here.
    """
    h = F.when(F.col("c") == NO_ID, 0).otherwise(F.crc32(F.col("c").cast("string").cast("binary")) % 4)
    own = turns.where("d = 1").select("c", F.col("total").alias("n"), h.cast("long").alias("h"), F.when(F.col("c") != NO_ID, F.col("c") - F.col("c") % FAMILY).alias("head"))
    given = F.least("h", F.coalesce("n_head", F.lit(0)))
    convs = own.join(own.select(F.col("c").alias("head"), F.col("n").alias("n_head")), "head", "left").withColumn("given", given)
    convs = materialize(convs.withColumn("size", F.col("given") + F.greatest(F.col("n") - F.col("h"), F.lit(0))), "conversations")
    first = turns.where((F.col("d") <= MOST_HEAD) & (F.col("c") % FAMILY == 0)).select(F.col("c").alias("head"), "d", "turn_digest", "words")
    heads = convs.join(first, "head").where("d <= given")
    tails = spread_join(turns, convs, ["c"], "n", turns.count()).where("d > h").withColumn("d", F.col("d") - F.col("h") + F.col("given"))
    roots = convs.select("*", F.lit(0).cast("long").alias("d"), F.lit("").alias("turn_digest"), F.lit(0).cast("long").alias("words"))
    names = ["c", F.col("d").cast("long").alias("d"), "turn_digest", "words", (F.col("d") == F.col("size")).alias("last")]
    return heads.select(*names).unionByName(tails.select(*names)).unionByName(roots.select(*names))


def prefixes(rows: DataFrame) -> DataFrame:
    """(c, depth, h1, h2, p1, p2, words, last): every prefix of every sequence, with its own and its parent's name.

    The fold runs over ranges of (c, d), and each range starts from what the ranges before it gave.
    """

    def turn(seed: int) -> Column:
        return F.when(F.col("d") == 0, F.lit(0).cast("long")).otherwise(F.xxhash64(F.lit(seed), "turn_digest", "d"))

    start = rows.select("c", F.col("d").alias("depth"), turn(1).alias("t1"), turn(2).alias("t2"), "words", "last")
    ranged = materialize(start.repartitionByRange("c", "depth").withColumn("part", F.spark_partition_id()), "prefix-ranges")
    parts = ranged.groupBy("c", "part").agg(*[F.bit_xor(f"t{i}").alias(f"s{i}") for i in (1, 2)])
    before = Window.partitionBy("c").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = materialize(parts.select("c", "part", *[F.coalesce(F.bit_xor(f"s{i}").over(before), F.lit(0).cast("long")).alias(f"b{i}") for i in (1, 2)]), "prefix-offsets")
    own = Window.partitionBy("c", "part").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    named = ranged.select("*", *[F.bit_xor(f"t{i}").over(own).alias(f"o{i}") for i in (1, 2)]).join(offsets, ["c", "part"])
    for i in (1, 2):
        named = named.withColumn(f"h{i}", F.col(f"o{i}").bitwiseXOR(F.col(f"b{i}"))).withColumn(f"p{i}", F.col(f"h{i}").bitwiseXOR(F.col(f"t{i}")))
    return named.select("c", *NODE, "p1", "p2", "words", "last")


def nodes_of(paths: DataFrame, total: int) -> DataFrame:
    """Distinct nodes with members, children, their parent's smallest member, and whether the parent has more members."""
    known = F.when(F.col("c") != NO_ID, F.col("c"))
    found = paths.groupBy(*NODE).agg(F.count("*").alias("n_convs"), F.min(known).alias("conv_id"), F.min("c").alias("some_c"), F.min("p1").alias("p1"), F.min("p2").alias("p2"), F.max("words").alias("words"))
    found = materialize(found, "trie-nodes")
    children = found.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("p1").alias("h1"), F.col("p2").alias("h2")).agg(F.count("*").alias("n_children"))
    own = materialize(found.join(children, NODE, "left").fillna(0, ["n_children"]).withColumn("above", F.col("depth") - 1), "trie-children")
    parents = own.where("n_children > 0").select(F.col("depth").alias("above"), F.col("h1").alias("p1"), F.col("h2").alias("p2"), F.col("n_children").alias("size"), F.col("n_convs").alias("parent_convs"), F.col("conv_id").alias("parent_conv_id"))
    below = spread_join(own.where("depth > 0"), parents, ["above", "p1", "p2"], "size", total).withColumn("parts", F.col("n_convs") < F.col("parent_convs"))
    root = own.where("depth = 0").select("*", F.lit(None).cast("long").alias("parent_conv_id"), F.lit(False).alias("parts"))
    names = [*NODE, "conv_id", "parent_conv_id", "some_c", "n_convs", "n_children", "words", "parts"]
    return materialize(below.select(*names).unionByName(root.select(*names)), "trie-parents")


def leaf_intervals(paths: DataFrame, nodes: DataFrame, total: int) -> DataFrame:
    """(depth, h1, h2, first_leaf, last_leaf): the ranks, from 0 in lexicographic order, of the leaves below a node."""
    leaves = nodes.where("n_children = 0").select(F.col("some_c").alias("c"), (F.col("depth") + 1).alias("size"))
    shown = materialize(spread_join(paths.select("c", *NODE), leaves, ["c"], "size", total).select("c", *NODE), "leaf-paths")
    telling = spread_join(shown, nodes.where("parts").select(*NODE, "n_convs"), NODE, "n_convs", total)
    keys = telling.groupBy("c").agg(F.sort_array(F.collect_list(F.struct(*NODE))).alias("path"))
    ranked = numbered(leaves.join(keys, "c", "left"), "path").select("c", "size", F.col("place").alias("leaf"))
    return spread_join(shown, ranked, ["c"], "size", total).groupBy(*NODE).agg(F.min("leaf").alias("first_leaf"), F.max("leaf").alias("last_leaf"))


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, list]]:
    """Rows of sorted batches in runs of one node; a run that goes on in the next batch comes in two."""
    for batch in batches:
        rows = zip(*(c.to_pylist() for c in batch.columns), strict=True)
        for node, run in groupby(rows, key=lambda r: r[:3]):
            yield node, list(run)


_ID_PIECES = pa.schema([*[(n, pa.int64()) for n in (*NODE, "at")], ("ids", pa.string())])
_DIGESTS = pa.schema([*[(n, pa.int64()) for n in NODE], ("ends_sha256", pa.string())])


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def ends_digests(ends: DataFrame) -> DataFrame:
    """(depth, h1, h2, ends_sha256): SHA-256 of the ids c that end at a node, ascending and joined by commas.

    Ids are sorted and joined by ranges, PIECE at most in one text; a node's texts are then read in order.
    """

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for node, run in _runs(batches):
            ids = [r[3] for r in run]
            yield _batch([(*node, ids[i], ",".join(map(str, ids[i : i + PIECE]))) for i in range(0, len(ids), PIECE)], _ID_PIECES)

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, state = None, None
        for node, run in _runs(batches):
            if node != last:
                if state is not None:
                    yield _batch([(*last, state.hexdigest())], _DIGESTS)
                last, state = node, hashlib.sha256(run.pop(0)[4].encode())
            for row in run:
                state.update(b"," + row[4].encode())
        if state is not None:
            yield _batch([(*last, state.hexdigest())], _DIGESTS)

    pieces = ends.select(*NODE, "c").repartitionByRange(*NODE, "c").sortWithinPartitions(*NODE, "c").mapInArrow(told, "depth long, h1 long, h2 long, at long, ids string")
    return pieces.repartition(*NODE).sortWithinPartitions(*NODE, "at").mapInArrow(digest, "depth long, h1 long, h2 long, ends_sha256 string")


def prefix_trie(sequences: DataFrame) -> DataFrame:
    """Nodes of the trie over ``sequences`` (c, d, turn_digest, words, last), one row per place from 0.

    ``preorder`` and ``subtree_end`` are the places, from 1, of a node and of the last node below it.
    """
    paths = materialize(prefixes(sequences), "prefixes")
    total = paths.count()
    nodes = nodes_of(paths, total)
    placed = nodes.join(leaf_intervals(paths, nodes, total), NODE)
    placed = placed.withColumn("leaf", (F.col("n_children") == 0).cast("long")).withColumn("saved", (F.col("n_convs") - 1) * F.col("words"))
    order = [F.col("first_leaf"), F.col("depth")]
    summed = materialize(running(placed, [], order, {"preorder": F.lit(1), "leaves_to": F.col("leaf"), "saved_to": F.col("saved")}).drop("total"), "preorder")
    closing = summed.groupBy("last_leaf").agg(F.count("*").alias("size"))  # how many subtrees end at a leaf
    last = summed.where("leaf = 1").select("last_leaf", F.col("preorder").alias("subtree_end"), F.col("leaves_to").alias("leaves_end"), F.col("saved_to").alias("saved_end"))
    whole = spread_join(summed, materialize(last.join(closing, "last_leaf"), "subtree-ends"), ["last_leaf"], "size", total)
    ends = ends_digests(paths.where(F.col("last") & (F.col("c") != NO_ID)))
    none = hashlib.sha256(b"").hexdigest()
    return whole.join(ends, NODE, "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "preorder", "subtree_end",
        (F.col("leaves_end") - F.col("leaves_to") + F.col("leaf")).alias("n_leaves"),
        (F.col("saved_end") - F.col("saved_to") + F.col("saved")).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(none)).alias("ends_sha256"),
    )


def conversation_trie(conversations: DataFrame) -> DataFrame:
    """The trie of a table's rebuilt conversations."""
    return prefix_trie(rebuilt(materialize(turns_of(conversations), "turns")))


def op11_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet")).drop("preorder", "subtree_end")


def _sql() -> str:
    """DuckDB SQL for op11's rows: paths as lists, subtrees by every ancestor of every node."""
    step = "xor(x >> 1, CASE WHEN x % 2 = 1 THEN 3988292384 ELSE 0 END)"  # CRC-32, bit by bit
    byte = f"list_reduce([0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[], lambda x, i: {step}, xor(crc, b))"
    crc = f"xor(list_reduce(list_transform(string_split(conv_id::VARCHAR, ''), lambda s: ascii(s)::BIGINT), lambda crc, b: {byte}, 4294967295::BIGINT), 4294967295)"
    words = rf"len(regexp_extract_all(text, '[^\x20\x09-\x0D]+'))"
    return f"""WITH t AS (SELECT conv_id, turn, sha256(length(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, '')) AS g, coalesce({words}, 0) AS words FROM conversations),
    own AS (SELECT conv_id, list(g ORDER BY turn NULLS FIRST, g) AS o FROM t GROUP BY conv_id),
    heads AS (SELECT *, coalesce({crc} % 4, 0) AS h FROM own),
    seqs AS (SELECT a.conv_id, list_concat(coalesce(b.o, [])[1:a.h], a.o[a.h + 1:]) AS r FROM heads a LEFT JOIN own b ON b.conv_id = a.conv_id - a.conv_id % 20),
    steps AS (SELECT conv_id, r, unnest(range(len(r) + 1)) AS depth FROM seqs),
    n AS (SELECT r[1:depth] AS p, depth, min(conv_id) AS conv_id, count(*) AS n_convs, coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (depth = len(r)), '') AS ends FROM steps GROUP BY ALL),
    w AS (SELECT DISTINCT g, words FROM t),
    m AS (SELECT n.*, q.conv_id AS parent_conv_id, coalesce(k.n_children, 0) AS n_children, (n.n_convs - 1) * coalesce(w.words, 0) AS saved FROM n LEFT JOIN w ON w.g = n.p[n.depth]
        LEFT JOIN n q ON n.depth > 0 AND q.depth = n.depth - 1 AND q.p = n.p[1:n.depth - 1]
        LEFT JOIN (SELECT p[1:depth - 1] AS p, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY 1) k ON k.p = n.p),
    below AS (SELECT p[1:up] AS p, sum((n_children = 0)::INT) AS n_leaves, sum(saved) AS saved_tokens FROM (SELECT *, unnest(range(depth + 1)) AS up FROM m) GROUP BY 1)
    SELECT m.conv_id, depth::BIGINT AS depth, parent_conv_id, n_convs, n_children, n_leaves::BIGINT AS n_leaves, saved_tokens::BIGINT AS saved_tokens, sha256(ends) AS ends_sha256 FROM m JOIN below USING (p)"""


ORACLE_SQL = _sql()
