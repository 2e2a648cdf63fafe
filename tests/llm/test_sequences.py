"""Conversation trie, fill-in-the-middle and byte-level BPE against brute-force versions and whole texts."""

import base64
import hashlib
import random
import re
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from veristrata.llm import bpe, fim, registry, trie

P = pytest.importorskip("public_tokenizers")
DATA = "/root/testdata/sf0.001"
UNIT = re.compile(r"[A-Za-z]+|[^A-Za-z]")
CONVERSATIONS = "conv_id long, turn long, role string, text string"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


@pytest.mark.parametrize("name", ["op11_conversation_trie", "op12_fill_in_middle"])
def test_queries_match_their_sql(spark, name):
    con = duckdb.connect(config={"memory_limit": "1GB"})
    for t in ("conversations", "documents"):
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    got = registry.queries()[name](spark, DATA)
    wanted = con.sql(f"select {', '.join(got.columns)} from ({registry.oracle_sql()[name]})").fetchall()
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, wanted))


# ---- trie


def plain_trie(rows):
    """Nodes of the rebuilt conversations in plain Python, keyed by path."""
    own = {}
    for c, turn, role, text in rows:
        role, text = role or "", text or ""
        own.setdefault(c, []).append((turn is not None, turn or 0, sha(f"{len(role)}:{role}{text}"), (role, text)))
    own = {c: [t[3] for t in sorted(v)] for c, v in own.items()}
    nodes = {}
    for c, turns in own.items():
        h = 0 if c is None else zlib.crc32(str(c).encode()) % 4
        path = (*(own.get(c - c % 20, []) if c is not None else [])[:h], *turns[h:])
        for d in range(len(path) + 1):
            nodes.setdefault(path[:d], []).append((c, d == len(path)))
    words = re.compile("[^\x20\x09-\x0d]+")
    ids = {p: [c for c, _ in m if c is not None] for p, m in nodes.items()}
    out = []
    for p, members in nodes.items():
        below = [q for q in nodes if q[: len(p)] == p]
        leaves = [q for q in below if not any(len(r) == len(q) + 1 and r[: len(q)] == q for r in below)]
        out.append((
            min(ids[p], default=None), len(p), min(ids[p[:-1]], default=None) if p else None, len(members), sum(len(q) == len(p) + 1 for q in below), len(leaves),
            sum((len(nodes[q]) - 1) * len(words.findall(q[-1][1])) for q in below if q), sha(",".join(map(str, sorted(c for c, end in members if end and c is not None)))),
        ))
    return sorted(out, key=repr)


NAMES = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def trie_rows():
    rng = random.Random(3)
    rows = [(None, 0, "user", "no id"), (None, None, None, None), (7, None, "user", "first"), (7, 0, "user", "second one"), (7, 0, "user", "second one"), (7, 3, None, " "), (200, 1, "user", "only head"), (403, 1, "user", "alone")]
    rows += [(c, t, "user" if t % 2 else "assistant", rng.choice(["a b c", "d e", "", "f", None])) for c in range(0, 60) if c != 7 for t in range(rng.randint(1, 5))]
    rows += [(c, t, "user", f"long {t % 3}") for c in (80, 100, 120) for t in range(150 if c < 120 else 149)]
    return rows


def test_trie_equals_brute_force(spark):
    rows = trie_rows()
    random.Random(1).shuffle(rows)
    table = spark.createDataFrame(rows, CONVERSATIONS).withColumns({"depth": F.lit("x"), "c": F.lit(1), "h1": F.lit(2)}).repartition(5)
    out = trie.conversation_trie(table)
    got = out.collect()
    assert sorted((tuple(r[n] for n in NAMES) for r in got), key=repr) == plain_trie(rows)
    order = sorted(got, key=lambda r: r["preorder"])
    assert [r["preorder"] for r in order] == list(range(1, len(got) + 1)) and order[0]["depth"] == 0
    for i, r in enumerate(order):  # a subtree is the stretch of deeper nodes that follows
        end = next((j for j in range(i + 1, len(order)) if order[j]["depth"] <= r["depth"]), len(order))
        assert r["subtree_end"] == end
    assert trie.conversation_trie(table.limit(0)).count() == 0


def test_trie_of_hot_nodes_and_keys(spark, monkeypatch):
    """Half of all conversations are the same, and joins place hot keys where the rows lie."""
    monkeypatch.setattr(trie, "PIECE", 7)
    rows = [(c, t, "user", f"hot {t}") for c in range(1500) for t in range(2)] + [(c, t, "user", f"{c % 7} {t}") for c in range(1500, 1800) for t in range(3)]
    got = trie.conversation_trie(spark.createDataFrame(rows, CONVERSATIONS)).select(*NAMES).collect()
    assert sorted(map(tuple, got), key=repr) == plain_trie(rows)
    con = duckdb.connect()
    con.execute("create table conversations (conv_id bigint, turn bigint, role varchar, text varchar)")
    con.executemany("insert into conversations values (?, ?, ?, ?)", rows[-900:])
    wanted = con.sql(f"select {', '.join(NAMES)} from ({trie.ORACLE_SQL})").fetchall()
    assert sorted(wanted, key=repr) == plain_trie(rows[-900:])


def test_digest_of_ends_reads_pieces_in_order(spark, monkeypatch):
    monkeypatch.setattr(trie, "PIECE", 3)
    ids = random.Random(2).sample(range(-50, 10_000), 500)
    ends = spark.createDataFrame([(1, c % 3, 0, c) for c in ids], "depth long, h1 long, h2 long, c long").repartition(6)
    got = {r["h1"]: r["ends_sha256"] for r in trie.ends_digests(ends).collect()}
    assert got == {k: sha(",".join(str(c) for c in sorted(ids) if c % 3 == k)) for k in range(3)}


# ---- fill-in-the-middle


def plain_cut(doc_id, text):
    text = text or ""
    units, h = UNIT.findall(text), sha(f"1:{'' if doc_id is None else doc_id}")
    h1, h2, h3, h4 = (int(h[i : i + 8], 16) for i in (0, 8, 16, 24))
    n = len(units)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    if h4 % 100 < 20:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def fim_rows():
    rng = random.Random(4)
    texts = ["", None, " ", "one", "a b\n\nc\x00d", "<P>x", "a <M> b", "<<P", "ends in <P", "<S<S", "日本 é text 𝒳", "".join(rng.choice("abc <>PSM.é ") for _ in range(200_000))]
    rows = [(i, t) for i, t in enumerate(texts * 5)] + [(None, "no id"), (None, None), (3, "twice"), (3, "twice"), (3, "other")]
    return rows + [(1000 + i, "one text of many copies") for i in range(300)] + [(2000 + i, "".join(rng.choice("ab <>PSM\n") for _ in range(rng.randint(1, 40)))) for i in range(300)]


@pytest.mark.parametrize("key", [None, "1L", "cast(length(text) AS bigint)"])
def test_cuts_equal_brute_force(spark, key):
    """Also where the key brings different texts together, and where copies are dealt to several groups."""
    rows = fim_rows()
    table = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"key": F.lit("x"), "part": F.lit(3), "n": F.lit(0)}).repartition(7)
    done = fim.fill_in_middle(table, key=key and F.expr(key), limit=50)
    got = done.withColumn("restored", fim.restore(F.col("output"), F.col("form"))).collect()
    assert sorted((tuple(r[:6]) for r in got), key=repr) == sorted(((i, *plain_cut(i, t)) for i, t in rows), key=repr)
    texts = {}
    for i, t in rows:
        texts.setdefault(i, set()).add(t or "")
    assert all(r["restored"] in texts[r["doc_id"]] for r in got)
    assert {r["form"] for r in got} == {"plain", "psm", "spm"}
    assert fim.fill_in_middle(table.limit(0)).count() == 0


def test_boundaries_of_a_text_are_made_once(monkeypatch):
    made = []
    monkeypatch.setattr(fim, "unit_ends", lambda text, real=fim.unit_ends: made.append(text) or real(text))
    rows = [(1, i, "ab"[i % 2] * 3 + " x") for i in range(40)] + [(2, i, "a c") for i in range(9)]
    batches = [pa.RecordBatch.from_pylist([dict(zip(("key", "doc_id", "text"), r, strict=True)) for r in rows[i : i + 10]]) for i in range(0, len(rows), 10)]
    out = [tuple(r.values()) for b in fim.cut_groups(iter(batches), 1, 90, 20) for r in b.to_pylist()]
    assert sorted(made) == ["a c", "aaa x", "bbb x"]
    assert out == [(i, *plain_cut(i, t)) for _, i, t in rows]


@pytest.mark.parametrize("size", [0, 1, 5, 64, 513, 5000])
def test_elias_fano_selects_every_end(size):
    rng = random.Random(size)
    for alphabet in ("a", "a b", "aaaaaaaaaaaaaaaaaaaa ", " .\n"):
        text = "".join(rng.choice(alphabet) for _ in range(size))
        ends = fim.unit_ends(text)
        assert ends.tolist() == [m.end() for m in UNIT.finditer(text)]
        kept = fim.Boundaries(ends, len(text))
        assert [kept.select(k) for k in range(kept.n + 1)] == [0, *ends.tolist()]
        assert 8 * (len(kept.upper) + len(kept.lower)) <= (3 + kept.low_bits) * kept.n + 16


# ---- byte-level BPE


@pytest.fixture(scope="module")
def tiktoken_encoding():
    tiktoken = pytest.importorskip("tiktoken")
    with open(P.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def vocabulary():
    return bpe.Vocabulary.read(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)


def odd_texts():
    rng = random.Random(6)
    texts = ["", "a", " ", "\n\n\n", "it's we'll", "x<|endoftext|>y", "日本語 テスト é é 𝒳", "\x00\x1c\x85​", "a" * 700, "-" * 1300, " " * 3000 + "x"]
    return texts + ["".join(rng.choice(a) for _ in range(n)) for a in ("etaoinshr", "0123456789", "aé中\U0001f600 ", "\n\t ", "ab'") for n in (7, 60, 513, 3000)]


def test_ids_equal_those_of_the_library(vocabulary, tiktoken_encoding):
    texts = odd_texts() + [r[0] for r in duckdb.sql(f"select text from '{DATA}/documents.parquet' where text is not null").fetchall()]
    for _ in range(2):  # the second time from the memo
        ids, counts = vocabulary.encode(texts)
        ends = np.cumsum(counts)
        for t, a, b in zip(texts, ends - counts, ends, strict=True):
            assert ids[a:b].tolist() == tiktoken_encoding.encode_ordinary(t)
        assert vocabulary.decode(ids)[0] == "".join(texts).encode()


def test_matrices_and_heap_merge_alike(vocabulary):
    rng = random.Random(7)
    rows = [bytes(rng.choice(b"etaoinsh rdlu\xe3\x81") for _ in range(rng.randint(1, 300))) for _ in range(200)]
    for row, ids in zip(rows, vocabulary.merge_rows(rows), strict=True):
        assert ids.tolist() == vocabulary.merge_long(row).tolist()


def test_the_leftmost_of_the_smallest_pairs_merges_first():
    ranks = {bytes([b]): b for b in range(256)} | {b"aa": 256, b"ab": 257, b"aaa": 258, b"baa": 259}
    v = bpe.Vocabulary(ranks, r"\S+|\s+")
    assert v.merge_rows([b"aaaab", b"baaa", b"a"])[0].tolist() == [256, 256, 98] and v.merge_long(b"aaaab").tolist() == [256, 256, 98]
    assert v.encode(["baaa", "aaa ab"])[0].tolist() == [98, 258, 258, 32, 257]  # a whole part that is a token is that token


def test_pair_table_holds_every_pair():
    rng = np.random.default_rng(1)
    pairs = np.unique(rng.integers(0, 3000, (20_000, 2)), axis=0)
    table = bpe.PairTable(pairs[:, 0], pairs[:, 1], np.arange(len(pairs)))
    assert (table(pairs[:, 0], pairs[:, 1]) == np.arange(len(pairs))).all()
    known = set(map(tuple, pairs.tolist()))
    other = rng.integers(-1, 3000, (5000, 2))
    absent = np.array([tuple(p) not in known for p in other.tolist()])
    assert (table(other[absent, 0], other[absent, 1]) == bpe.NO_RANK).all()


def test_memo_and_pool_are_bounded(vocabulary, tiktoken_encoding, monkeypatch):
    monkeypatch.setattr(bpe.Vocabulary, "LIMIT", 50)
    monkeypatch.setattr(bpe.Vocabulary, "POOL", 500)
    for i in range(30):
        text = " ".join(f"word{i}x{j}" for j in range(40))
        assert vocabulary.encode([text])[0].tolist() == tiktoken_encoding.encode_ordinary(text)
    assert len(vocabulary.memo) < 200 and vocabulary.used < 1500


def test_bpe_of_odd_tables(spark, tiktoken_encoding):
    path = P.path("byte_bpe_50k.tiktoken")
    rows = [(i, t) for i, t in enumerate(odd_texts())] + [(None, "no id"), (None, None), (5, "same"), (5, "same"), (5, "other"), (6, "word " * 60_000)]
    table = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"ids": F.lit("x"), "decoded": F.lit(1)}).repartition(3)
    got = bpe.decode(bpe.encode(table, path, P.PATTERN), path, P.PATTERN).collect()
    wanted = [(i, tiktoken_encoding.encode_ordinary(t or ""), (t or "").encode()) for i, t in rows]
    assert sorted(((r["doc_id"], r["ids"], bytes(r["decoded"])) for r in got), key=repr) == sorted(wanted, key=repr)
    assert bpe.encode(table.limit(0), path, P.PATTERN).count() == 0
    lists = spark.createDataFrame([(1, None), (2, [])], "doc_id long, ids array<int>")
    assert [bytes(r["decoded"]) for r in bpe.decode(lists, path, P.PATTERN).collect()] == [b"", b""]


def test_op13_digests(spark, tiktoken_encoding):
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    for r in registry.queries()["op13_byte_bpe"](spark, DATA).collect():
        ids = tiktoken_encoding.encode_ordinary(texts[r["doc_id"]])
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), sha(" ".join(map(str, ids))), sha(texts[r["doc_id"]]))


def test_unknown_ids_raise(vocabulary):
    with pytest.raises(ValueError, match="vocabulary"):
        vocabulary.decode(np.array([60_000]))


# ---- what earlier operators must withstand


def test_repetition_alone_is_no_personal_data(docs_weights):
    from veristrata.llm import pii

    fails = "4111111111111112"  # 16 digits that fail the checksum
    texts = [" and ".join([f"order {fails}"] * n) for n in (2, 3, 5, 40)]
    texts += [f"pay 4111 1111 1111 1111, order {fails}, again {fails} {fails}", f"{fails} {fails} " * 3 + "mail a@b.example.org"]
    assert pii.Field(texts).added(docs_weights) == [[]] * len(texts)
    tied = "pay 4111 1111 1111 1111 then 4111.1111.1111.1111 and 4111.1111.1111.1111 but " + " ".join([fails] * 4)
    assert [tied[a:b] for _, a, b in pii.Field([tied]).added(docs_weights)[0]] == ["4111.1111.1111.1111"] * 2
    assert pii.redact_texts([f"a {fails} b {fails}"], docs_weights) == [f"a {fails} b {fails}"]


@pytest.fixture(scope="module")
def docs_weights(spark):
    from veristrata.llm import pii

    return pii.train(spark.read.parquet(f"{DATA}/documents.parquet"))


def test_added_spans_are_tied_to_base_spans(spark, docs_weights):
    """Every added span of the table shares its digits or its name with a base span of its text."""
    from veristrata.llm import pii

    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    found = pii.find(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), docs_weights)
    for r in found.where("n_added > 0").collect():
        text = texts[r["doc_id"]]
        base = [text[a:b] for own in pii.base_spans(text) for a, b in own]
        keys = {k for s in base for k in pii._keys(s, s) if k}
        spans = [s.split(":") for s in r["spans"].split(",")]
        more = [text[int(a) : int(b)] for _, a, b in spans if text[int(a) : int(b)] not in base]
        assert all(keys & set(pii._keys(s, "")) for s in more)


def test_loopy_marginals_come_near_enumeration():
    from veristrata.llm import pii

    rng = np.random.default_rng(5)
    for _ in range(5):
        unary, table = rng.normal(size=(6, 5)), rng.normal(size=(1, 5, 5)) * 0.3
        table = (table + table.transpose(0, 2, 1)) / 2
        pairs = np.array([[0, 1], [1, 2], [2, 0], [2, 3], [3, 4], [4, 5], [5, 3]])
        x = np.array(list(np.ndindex(*[5] * 6)))
        w = np.exp(sum(unary[i, x[:, i]] for i in range(6)) + sum(table[0, x[:, i], x[:, j]] for i, j in pairs))
        exact = np.array([[w[x[:, i] == k].sum() for k in range(5)] for i in range(6)]) / w.sum()
        assert np.abs(pii.propagate(unary, pairs, table, np.zeros(len(pairs), dtype=int)) - exact).max() < 0.02


def test_license_places_take_linear_time():
    import time

    from veristrata.llm import license

    text = ("filler words before the phrase " + "under the mit license ") * 40_000  # 2 MB
    start = time.perf_counter()
    row = next(iter(license.scan_texts([text])))
    assert row[1] == 40_000 and (row[2], row[3]) == (5, 9 * 39_999 + 5) and time.perf_counter() - start < 20


def test_white_space_of_any_length(spark):
    from veristrata.llm import quality

    texts = ["a" + " " * 300_000 + "b", " " * 300_000, "\n" * 100_000 + "a b c", "a b c \t", " a", "", None, "x"]
    rows = quality.quality_features(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("lang", F.lit("en"))).collect()
    assert {r["doc_id"]: (r["n_words"], r["word_chars"]) for r in rows} == {i: (len((t or "").split()), len("".join((t or "").split()))) for i, t in enumerate(texts)}


def test_chat_log_folds_to_the_table(spark):
    """The log holds all kinds of events, and its rows may come in any order."""
    from veristrata.llm import chat

    rng = random.Random(8)
    rows = [(c, t, rng.choice(["user", "assistant", None]), rng.choice(["", None, "a", "some longer text", "日本 # <x>"])) for c in (1, 2, None) for t in range(30)]
    rows += [(1, 3, "assistant", "same"), (1, 3, "assistant", "same"), (1, None, "assistant", "first"), (1, 3, "assistant", "draft: same")]
    log = chat.events_of(spark.createDataFrame(rows, CONVERSATIONS))
    kinds = {r["kind"]: r["n"] for r in log.groupBy("kind").agg(F.count("*").alias("n")).collect()}
    assert set(kinds) == {"message", "delta", "edit", "regenerate"} and log.count() > 1.5 * len(rows)
    assert log.groupBy("conv_id", "seq").count().where("count > 1").count() == 0
    got = chat.fold_events(log.orderBy(F.rand(3))).collect()
    assert sorted(((r["conv_id"], r["turn"], r["role"] or "", r["text"]) for r in got), key=repr) == sorted(((c, t, r or "", x or "") for c, t, r, x in rows), key=repr)
