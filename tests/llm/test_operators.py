"""Corpus operators against brute-force versions, on small tables with nulls, ties, repeats and clashing columns."""

import hashlib
import itertools
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from veristrata.llm import chat, components, fingerprints, license, mixing, neardup, packing, pii, quality, rans, tokenizing, tokens, toxicity

P = pytest.importorskip("public_tokenizers")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
W = re.compile("[^\x20\x09-\x0d]+")


def words(rng, n):
    return " ".join(rng.choice("alpha beta gamma delta epsilon zeta eta theta iota kappa".split()) + str(rng.randint(0, 40)) for _ in range(n))


@pytest.fixture(scope="module")
def docs(spark):
    """Texts of all kinds: null, empty, blank, long, repeated, with other scripts and white space."""
    rng = random.Random(5)
    base = words(rng, 300)
    rows = [
        (None, "no id", "en", "a"), (1, None, None, None), (2, "", "en", "a"), (3, " \n\t ", "en", "b"), (4, "one two", "de", "b"), (5, base, "en", "a"), (6, base, "en", "a"), (6, base, "en", "a"),
        (7, base.replace("alpha1 ", "x ", 1), "en", "c"), (8, "日本語 テスト\n\n  two  spaces\r\nend ", "ja", "c"), (9, words(rng, 20_000), "en", "a"), (10, "mail a.b@x.example.com and 1.2.3.4 or 1.2.3.256 +1 (017) 555-7713", "en", "d"),
        (11, "under the MIT License, Apache License, Version 2.0", "en", "d"), *[(20 + i, words(rng, rng.randint(5, 80)), "en", "abcd"[i % 4]) for i in range(60)],
    ]
    return spark.createDataFrame([(i, t, la, s, len(t or "")) for i, t, la, s in rows], DOCS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


@pytest.mark.parametrize(("name", "spaced"), [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)])
def test_ids_equal_those_of_plain_calls(docs, name, spaced):
    from tokenizers import Tokenizer

    texts = [r["text"] or "" for r in docs.collect()] + ["a", "\n", "\n\na", " a b", "a  b\t c", "foo\nbar", "foo \nbar", "x<|endoftext|>y", "é ́x", "\x1c a \x1cb", "it's 12 'll \n 's", "a" * 100 + " b"]
    enc, plain = tokenizing.PieceEncoder(P.path(name), spaced), Tokenizer.from_file(P.path(name))
    for _ in range(2):
        ids, counts = enc.encode(texts)
        ends = np.cumsum(counts)
        for t, a, b in zip(texts, ends - counts, ends, strict=True):
            assert ids[a:b].tolist() == plain.encode(t, add_special_tokens=False).ids


@pytest.mark.parametrize("n", [0, 1, 31, 32, 33, 16_384, 16_385, 70_001])
def test_rans_round_trip(n):
    rng = np.random.default_rng(n)
    ids = np.minimum(rng.zipf(1.3, n), 49_000).astype(np.uint32)
    frame = rans.encode(ids)
    assert (rans.decode(frame) == ids).all()
    if n > 16_384:
        last = rans.n_blocks(frame) - 1
        assert (rans.decode(frame, [last]) == ids[last * rans.BLOCK :]).all()
        broken = bytearray(frame)
        broken[-3] ^= 255
        with pytest.raises(ValueError, match="checksum"):
            rans.decode(bytes(broken))


def test_token_files(spark, docs, none, tmp_path):
    from tokenizers import Tokenizer

    for table in (docs, none):
        path = f"file://{tmp_path}/{table.count()}"
        tokens.write_token_files(table, path, P.path("word_bpe_49k.json"), spaced=False, end_id=1, frame_ids=500)
        got = sorted(tokens.token_index(tokens.read_token_files(spark, path)).collect(), key=lambda r: r["start"])
        plain, at = Tokenizer.from_file(P.path("word_bpe_49k.json")), 0
        assert [r["doc_id"] for r in got] == sorted([r["doc_id"] for r in table.collect()], key=lambda i: -1 if i is None else i)
        by = {r["doc_id"]: r["text"] or "" for r in table.collect()}
        for r in got:
            ids = np.array([*plain.encode(by[r["doc_id"]], add_special_tokens=False).ids, 1], dtype="<u4")
            assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (at, len(ids), zlib.crc32(ids))
            at += len(ids)


def test_packing(spark, docs, none):
    rows = packing.pack_documents(docs, P.path("byte_bpe_50k.json"), capacity=256).collect()
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in by.values():
        parts.sort()
        assert [o for o, _ in parts] == list(itertools.accumulate([0, *[n for _, n in parts[:-1]]]))
        assert sum(n for _, n in parts) <= 256
    total = sum(r["length"] for r in rows)
    assert len(by) <= math.ceil(total / 256) + 1
    assert {r["doc_id"] for r in rows} == {r["doc_id"] for r in docs.collect()}
    assert packing.pack_documents(none, P.path("byte_bpe_50k.json")).count() == 0


def test_pieces_equal_plain_tokenization(docs):
    from tokenizers import Tokenizer

    plain, texts = Tokenizer.from_file(P.path("byte_bpe_50k.json")), {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    got: dict = {}
    for r in packing.pieces_of(docs.dropDuplicates(["doc_id"]), P.path("byte_bpe_50k.json"), 0, 256).collect():
        got.setdefault(r["doc_id"], []).append((r["piece"], r["start"], r["length"], r["ids_crc32"]))
    assert set(got) == set(texts)
    for i, pieces in got.items():
        ids = np.array([*plain.encode(texts[i], add_special_tokens=False).ids, 0], dtype="<u4")
        n = -(-len(ids) // 256)
        first = len(ids) - (n - 1) * 256
        cuts = [0, *range(first, len(ids) + 1, 256)]
        assert sorted(pieces) == [(k, a, b - a, zlib.crc32(ids[a:b])) for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))]


def test_plan_places_every_piece_once():
    rng = random.Random(2)
    histogram = {k: rng.randint(1, 900) for k in rng.sample(range(1, 2049), 700)} | {2048: 5000}
    plan = packing.plan_sequences(histogram)
    placed: dict[int, int] = {}
    for own, times in plan:
        assert sum(own) <= 2048
        for k in own:
            placed[k] = placed.get(k, 0) + times
    assert placed == histogram
    total = sum(k * v for k, v in histogram.items())
    assert sum(t for _, t in plan) <= 1.05 * total / 2048


def brute_components(rows):
    sets = {i: neardup._set(t or "") for i, t in rows}
    up = {i: i for i in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in itertools.combinations(sets, 2):
        common = len(sets[a] & sets[b])
        if common and 100 * common >= 85 * (len(sets[a]) + len(sets[b]) - common):
            x, y = root(a), root(b)
            up[max(x, y)] = min(x, y)
    return {i: root(i) for i in sets}, {i: len(s) for i, s in sets.items()}


def test_near_duplicates_equal_brute_force(spark):
    """Groups of copies whose similarities lie on both sides of the threshold, chains included."""
    rng, rows = random.Random(9), []
    for group in range(6):
        base = words(rng, rng.choice([60, 150, 400])).split()
        for k in range(45):
            own = base[:]
            for _ in range(rng.randint(0, max(1, len(base) // 45))):
                own[rng.randrange(len(own))] = f"edit{rng.random()}" if k % 3 else f"edit{rng.randint(0, 3)}"
            rows.append((len(rows) * 7 % 1009, " ".join(own)))
    rows += [(2000, ""), (2001, None), (2002, "one two"), (2003, "ONE  two"), (2004, "one two three"), (2005, rows[0][1].upper())]
    got = {r["doc_id"]: r for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    wanted, sizes = brute_components(rows)
    assert {i: r["component_id"] for i, r in got.items()} == wanted
    assert {i: r["n_shingles"] for i, r in got.items()} == sizes
    assert all(r["kept"] == (i == r["component_id"]) for i, r in got.items())


def test_near_duplicates_of_odd_tables(docs, none):
    got = neardup.near_duplicates(docs).collect()
    assert len(got) == docs.count()
    by = {r["doc_id"]: r["component_id"] for r in got}
    assert by[6] == by[5] == 5 and by[1] == 1 and by[2] == 2 and by[None] is None
    assert neardup.near_duplicates(none).count() == 0
    kept = [r["doc_id"] for r in neardup.keep_first(docs).collect()]
    assert kept.count(5) == 1 and 6 not in kept and {None, 1, 2, 3} <= set(kept)


def test_components_by_rounds_equal_union_find(spark):
    rng = random.Random(4)
    links = [(i, i + 1) for i in range(0, 60)] + [(100 + rng.randint(0, 50), 100 + rng.randint(0, 50)) for _ in range(40)]
    df = spark.createDataFrame(links, "a long, b long")
    one, rounds = (sorted(map(tuple, components.connected_components(df, one_task=n).collect())) for n in (10**6, 0))
    assert one == rounds


def test_quality_counts_equal_brute_force(docs, none):
    assert quality.quality_features(docs).where("base_failed").count() + quality.quality_features(docs).where("NOT base_failed").count() == docs.count()
    got = {(r["doc_id"], r["lang"]): r for r in quality.quality_features(docs).collect()}
    for r in docs.collect():
        w, seen, covered = W.findall(r["text"] or ""), {}, set()
        for j in range(len(w) - 2):
            seen.setdefault(tuple(w[j : j + 3]), []).append(j)
        for places in seen.values():
            if len(places) > 1:
                covered.update(k for j in places for k in (j, j + 1, j + 2))
        lines = [x for x in (r["text"] or "").split("\n") if W.search(x)]
        g = got[r["doc_id"], r["lang"]]
        assert (g["n_words"], g["word_chars"], g["n_dup_lines"], g["n_repeat_words"]) == (len(w), sum(map(len, w)), len(lines) - len(set(lines)), len(covered))
        assert g["n_symbols"] == len(re.findall(r"[#*$%&|<>]", r["text"] or ""))
        assert g["base_failed"] == (len(w) < 50 or 100 * len(covered) > 50 * len(w))
    assert quality.quality_features(none).count() == 0


def test_quality_many_repeats(spark):
    text = " ".join(["a b c d e f g"] * 40 + [f"w{i}" for i in range(200)] + [f"w{i}" for i in range(200)])
    df = spark.createDataFrame([(1, text, "en", "s", 0)], DOCS)
    w, seen, covered = text.split(), {}, set()
    for j in range(len(w) - 2):
        seen.setdefault(tuple(w[j : j + 3]), []).append(j)
    for places in seen.values():
        if len(places) > 1:
            covered.update(k for j in places for k in (j, j + 1, j + 2))
    assert quality.quality_features(df).first()["n_repeat_words"] == len(covered)


def test_binomial_tail(spark):
    rows = [(1000, 5), (5000, 0), (200, 40), (10, 10)]
    df = spark.createDataFrame(rows, "n long, k long").withColumn("t", quality.log_binomial_tail("n", "k", 0.01))
    for (n, k), r in zip(rows, df.collect(), strict=True):
        exact = sum(math.comb(n, i) * 0.01**i * 0.99 ** (n - i) for i in range(k + 1))
        assert abs(r["t"] - math.log(exact)) < 1e-6


def test_certified_cutoffs_limit_false_rejections(spark):
    n = 6000
    f = spark.range(n).select(F.col("id").alias("doc_id"), F.lit("en").alias("lang"), F.lit(False).alias("base_failed"), F.when(F.col("id") % 10 == 0, 900).otherwise(F.col("id") % 60).alias("symbols"), *[F.lit(0).alias(r) for r in ("repeats", "dup_lines", "capitals", "shouts")])
    labels = spark.range(n).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 10 == 0, 0).otherwise(1).alias("quality"))
    cut = quality.certified_cutoffs(f, labels).first()
    assert cut["cut_symbols"] in quality.CUTOFFS["symbols"] and cut["cut_symbols"] >= 60 and cut["cut_repeats"] is None
    kept = quality.judge(f, quality.certified_cutoffs(f, labels)).where("kept").count()
    assert kept == n - n // 10
    assert quality.certified_cutoffs(f, labels.where("doc_id < 50")).count() == 0


def test_joint_steps_certify_small_strata(spark):
    rows = [(i, lang, i % 330 >= 300) for j, (lang, n) in enumerate([("de", 330), ("en", 330), ("es", 330), ("fr", 200)]) for i in range(330 * j, 330 * j + n)]
    f = spark.createDataFrame(rows, "doc_id long, lang string, bad boolean").withColumn("base_failed", F.lit(False))
    f = f.select("*", F.when(F.col("bad"), 900).otherwise(F.col("doc_id") % 60).alias("symbols"), *[F.lit(0).alias(r) for r in ("repeats", "dup_lines", "capitals", "shouts")])
    cuts = {r["lang"]: r for r in quality.certified_cutoffs(f, f.select("doc_id", F.when(F.col("bad"), 0).otherwise(1).alias("quality"))).collect()}
    assert set(cuts) == {"de", "en", "es"} and all(60 <= r["cut_symbols"] < 900 and r["cut_repeats"] is None for r in cuts.values())
    kept = quality.judge(f, quality.certified_cutoffs(f, f.select("doc_id", F.when(F.col("bad"), 0).otherwise(1).alias("quality")))).where("kept")
    assert kept.where("bad").count() == 0 and kept.count() == 1100


def test_keep_good_keeps_columns(spark, docs, monkeypatch):
    labels = spark.createDataFrame([(5, 1), (5, None), (None, 0)], "doc_id long, quality int")
    kept = quality.keep_good(docs.withColumn("n_words", F.lit("clash")), labels)
    assert kept.columns[:5] == docs.columns and {r["doc_id"] for r in kept.collect()} >= {5, 6, 9}
    assert 4 not in {r["doc_id"] for r in kept.collect()}
    monkeypatch.setattr(quality, "MOST_REJECTED", 0)
    assert quality.keep_good(docs, labels).exceptAll(kept.select(docs.columns)).count() == 0 and quality.keep_good(docs, labels).count() == kept.count()


def brute_pii(t):
    d = lambda s: re.sub("[^0-9]", "", s)
    return [
        [m.span() for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)],
        [m.span() for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))],
        [m.span() for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 16 <= len(d(m[0])) <= 19 and pii.luhn(d(m[0]))],
        [m.span() for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 8 <= len(d(m[0])) <= 15],
    ]


def test_base_spans_equal_the_patterns():
    rng = random.Random(1)
    for _ in range(5000):
        t = "".join(rng.choice("a1@.+ -(2%0\n") for _ in range(rng.randint(0, 40)))
        assert brute_pii(t) == pii.base_spans(t)
    assert pii.base_spans("a" * 200_000 + "1" * 200_000 + "@" * 1000) == [[], [], [], []]


def test_pii_field_adds_tied_tokens(docs, none):
    weights = pii.train(docs)
    texts = [
        "call +1 (017) 555-7713 or later 555-7713; id 12345678 12345678",
        "fax +49 30 1234567, again 1234567 and (030) 123-4567; room 4567",
        "pay 4111 1111 1111 1111 then 4111.1111.1111.1111",
        "mail jo.doe@example.org or jo.doe@localhost, not al@localhost",
        "nothing 555-7713 here 555-7713", "",
    ]
    added = pii.Field(texts).added(weights)
    assert [[t[a:b] for _, a, b in own] for t, own in zip(texts, added, strict=True)] == [["555-7713"], ["1234567", "123-4567"], ["4111.1111.1111.1111"], ["jo.doe@localhost"], [], []]
    assert [pii.Field([t]).added(weights)[0] for t in texts] == added
    assert pii.redact_texts(texts[:1], weights) == ["call [PHONE] or later [PHONE]; id 12345678 12345678"]
    rows = {r["doc_id"]: r for r in pii.find(docs, weights).collect()}
    assert (rows[10]["n_email"], rows[10]["n_ip"], rows[10]["n_phone"], rows[1]["spans"]) == (1, 1, 1, "")
    by = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    for i, r in rows.items():
        told = ",".join(f"{k}:{a}:{b}" for k, found in zip(pii.KINDS, brute_pii(by[i]), strict=True) for a, b in found)
        assert r["base_sha256"] == hashlib.sha256(told.encode()).hexdigest() and set(told.split(",")) <= set(r["spans"].split(","))
    assert pii.find(none, weights).count() == 0
    clash = docs.withColumn("a.b", F.lit(1)).withColumn("spans", F.lit(2))
    clean = {r["doc_id"]: r for r in pii.redact(clash, weights).collect()}
    assert "[EMAIL]" in clean[10]["text"] and clean[1]["text"] is None and clean[5]["text"] == by[5] and clean[5]["a.b"] == 1
    many = "1234567 " * 200_000
    assert pii.Field([many]).added(weights) == [[]]


def test_pii_configurations_equal_a_plain_count():
    rng, texts = random.Random(3), []
    for _ in range(300):
        texts.append(" ".join(rng.choice(["+1 555 123-4567", "555 123-4567", "1234567", "x", "a@b.org", "a@b", "1.2.3.4", "999", "12345678"]) for _ in range(rng.randint(0, 8))))
    field = pii.Field(texts)
    wanted: dict[int, int] = {}
    for n, text in enumerate(texts):
        base = sorted((a, b, k + 1) for k, found in enumerate(brute_pii(text)) for a, b in found)
        own = [(i, *t) for i, t in enumerate(field.tokens) if field.owner[i] == n]
        label, key = [], []
        for _, a, b in own:
            hit = [(x, y, k) for x, y, k in base if x < b and a < y]
            label.append(hit[0][2] if hit else 0)
            key.append(pii._keys(text[a:b], text[hit[0][0] : hit[0][1]] if hit else ""))
        for j, (i, a, b) in enumerate(own):
            beside = lambda x, y: y - x <= 3 and bool(re.fullmatch("[ ().-]+", text[x:y]))
            code = int(field.shapes[i])
            code = code * 6 + (label[j - 1] if j and beside(own[j - 1][2], a) else 5)
            code = code * 6 + (label[j + 1] if j + 1 < len(own) and beside(b, own[j + 1][1]) else 5)
            tied = False
            for k in (0, 1):
                same = [q for q in range(len(own)) if q != j and key[q][k] and key[q][k] == key[j][k]]
                before, after = [q for q in same if q < j], [q for q in same if q > j]
                near = label[before[-1]] if before else label[after[0]] if after else 5
                tied |= 0 < near < 5
                code = code * 6 + near
            if label[j] or not tied:
                wanted[code * 5 + label[j]] = wanted.get(code * 5 + label[j], 0) + 1
    codes, counts = field.configurations()
    assert dict(zip(codes.tolist(), counts.tolist(), strict=True)) == wanted


def test_pii_weights_maximize_the_pseudo_likelihood():
    rng = np.random.default_rng(1)
    codes = np.unique(rng.integers(0, 3, 60) * 6**4 * 5 + rng.integers(0, 6**4 * 5, 60))
    counts = rng.integers(1, 500, len(codes))

    def gain(w):
        total = 0.0
        for c, n in zip(codes.tolist(), counts.tolist(), strict=True):
            y, c = c % 5, c // 5
            similar, equal, right, left, shape = c % 6, c // 6 % 6, c // 36 % 6, c // 216 % 6, c // 1296
            s = w["shape"][shape] + (w["chain"][left] if left < 5 else 0) + (w["chain"][:, right] if right < 5 else 0) + (w["equal"][equal] if equal < 5 else 0) + (w["similar"][similar] if similar < 5 else 0)
            total += math.log1p(n) * (s[y] - math.log(np.exp(s).sum()))
        start = {k: v * np.eye(5) for k, v in pii.SAME.items()} | {"shape": np.array([pii.NOTHING, 0, 0, 0, 0])}
        return total - 0.25 * sum(((v - start.get(k, 0)) ** 2).sum() for k, v in w.items())

    w = pii.fit(codes, counts, steps=3000, rate=0.02)
    best = gain(w)
    for k in w:
        for _ in range(12):
            d = rng.normal(size=w[k].shape) * 0.1
            d = (d + d.T) / 2 if k in pii.SAME else d
            assert gain({**w, k: w[k] + d}) < best + 1e-3
    assert all((v == start).all() for v, start in zip(pii.fit(codes[:0], counts[:0]).values(), [np.array([[pii.NOTHING, 0, 0, 0, 0]] * 96), np.zeros((5, 5)), 12 * np.eye(5), 12 * np.eye(5)], strict=True))


def test_propagation_is_exact_on_a_tree():
    rng = np.random.default_rng(0)
    unary, tables = rng.normal(size=(3, 5)), rng.normal(size=(2, 5, 5))
    pairs, exact = np.array([[0, 1], [1, 2]]), np.zeros((3, 5))
    for x in np.ndindex(5, 5, 5):
        w = np.exp(unary[0, x[0]] + unary[1, x[1]] + unary[2, x[2]] + tables[0, x[0], x[1]] + tables[1, x[1], x[2]])
        for i in range(3):
            exact[i, x[i]] += w
    assert np.allclose(pii.propagate(unary, pairs, tables, np.array([0, 1])), exact / exact.sum(1, keepdims=True), atol=1e-4)


def test_mixing(docs, none, spark):
    got = mixing.decide(docs).collect()
    by = {}
    for r in got:
        s = by.setdefault(r["source"], [r["source_size"], r["target"], 0])
        s[2] += r["copies"] * r["size"] * r["rows"]
        assert 0 <= r["copies"] <= 3
    total, order, cap = sum(s[0] for s in by.values()), sorted(by, key=lambda s: (s is None, s)), set()
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    while True:
        rest, w = total - sum(3 * by[s][0] for s in cap), sum(weight[s] for s in order if s not in cap)
        want = {s: 3 * by[s][0] if s in cap else rest * weight[s] / w for s in order}
        over = {s for s in order if want[s] > 3 * by[s][0] + 1e-9}
        if not over:
            break
        cap |= over
    assert all(abs(by[s][1] - want[s]) < 1e-6 for s in order)
    assert all(by[s][2] <= by[s][1] + 1e-6 for s in order)
    rng = random.Random(1)
    many = spark.createDataFrame([(i, words(rng, rng.randint(1, 60)), "en", f"s{i % 3}", 0) for i in range(900)], DOCS)
    sums = mixing.decide(many).groupBy("source").agg(F.max("target").alias("t"), F.sum(F.col("copies") * F.col("size")).alias("k")).collect()
    assert all(abs(r["k"] - r["t"]) < 0.01 * r["t"] for r in sums)
    again = mixing.decide(many).select("doc_id", "copies")
    assert again.exceptAll(mixing.decide(many).select("doc_id", "copies")).count() == 0
    assert mixing.mixed(many).groupBy("doc_id").count().exceptAll(again.where("copies > 0").withColumnRenamed("copies", "count")).count() == 0
    assert mixing.decide(none).count() == 0 and mixing.mixed(none).count() == 0


def test_mixing_inclusion_frequencies_follow_size(spark):
    """Many sources alike in sizes are as many draws: how often a size is taken must come near its probability."""
    sizes = [*range(1, 41), 60, 90]
    rows = [(1000 * s + i, "w " * n, "en", f"s{s:04d}", 0) for s in range(600) for i, n in enumerate(sizes)]
    table = spark.createDataFrame(rows, DOCS).cache()
    got = mixing.decide(table, fills=0).withColumn("kind", F.pmod(F.substring("source", 2, 4).cast("int"), F.lit(3)))
    whole = sum(sizes)
    for r in got.groupBy("kind", "size").agg(F.avg("copies").alias("mean"), F.min("copies").alias("low"), F.max("p").alias("p"), F.min("p").alias("p0"), F.max("target").alias("target")).collect():
        certain = math.floor(r["target"] / whole + 1e-9)
        rest, lam = r["target"] - certain * whole, None
        for k in range(len(sizes)):  # the k largest are certain
            tail = sorted(sizes)[: len(sizes) - k]
            lam = (rest - (whole - sum(tail))) / sum(n * n for n in tail)
            if lam * tail[-1] <= 1:
                break
        p = min(1.0, lam * r["size"])
        assert abs(r["p"] - p) < 1e-6 and abs(r["p0"] - p) < 1e-6 and r["low"] >= certain
        assert abs(r["mean"] - certain - p) < 0.15, (r, p)
    sums = mixing.decide(table).groupBy("source").agg(F.max("target").alias("t"), F.sum(F.col("copies") * F.col("size")).alias("k")).collect()
    assert all(0 <= r["t"] - r["k"] < 0.03 * r["t"] for r in sums)


def test_mixing_keeps_columns_of_any_name(spark, docs):
    clash = docs.withColumn("_key", F.lit("k")).withColumn("copies", F.lit("c")).withColumn("a.b", F.col("doc_id"))
    out = mixing.mixed(clash)
    assert out.columns == clash.columns and all(r["_key"] == "k" and r["copies"] == "c" and r["a.b"] == r["doc_id"] for r in out.collect())


def test_joins_of_large_keys_equal_plain_joins(spark, monkeypatch):
    from veristrata.llm import common

    rows = spark.createDataFrame([(i, None if i % 7 == 0 else i % 5) for i in range(6000)], "i long, k long")
    one = rows.groupBy("k").agg(F.count("*").alias("n"))
    for told in (100, 0):
        monkeypatch.setattr(common, "MOST_TOLD", told)
        assert common.beside(rows, one, 6, "k").select("i", "k", "n").exceptAll(rows.alias("a").join(one.alias("b"), F.col("a.k").eqNullSafe(F.col("b.k"))).select("i", "a.k", "n")).count() == 0
        assert common.beside(rows, one.where("k > 2"), 6, "k", "left").count() == 6000
    monkeypatch.setattr(common, "MOST_TOLD", 100)
    wide = spark.range(6000).select(F.col("id").alias("i"), F.when(F.col("id") < 5000, 1).otherwise(F.col("id")).alias("k"))
    sizes = wide.groupBy("k").agg(F.count("*").alias("n"))
    assert common.spread_join(wide, sizes, ["k"], "n", 6000).exceptAll(wide.join(sizes, "k").select("k", "i", "n")).count() == 0


def test_chat_round_trip(spark):
    nasty = ["\\### assistant: </turn> ok", "", None, "### user: a</turn>\n", "\\s\\h\\l\\c\\\\", "日本\n<b>#", ": "]
    rows = [(c, i, role, t) for c in (1, 2) for i, (role, t) in enumerate(zip(["system", "user", "assistant", "user: x", None, "assistant", "#"], nasty, strict=True))] + [(3, 0, "user", "a"), (3, 0, "user", "a"), (None, None, "assistant", "z")]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = chat.render(chat.fold_events(chat.events_of(table)))
    got = {r["conv_id"]: r for r in chat.parse(out).collect()}
    assert [tuple(t) for t in got[1]["turns"]] == [(r or "", t or "") for _, _, r, t in rows[:7]]
    assert len(got[3]["turns"]) == 2 and got[None]["turns"][0]["text"] == "z"
    d = {r["conv_id"]: r for r in chat.digests(out).collect()}
    masked = "".join(t or "" for _, _, r, t in rows[:7] if r == "assistant")
    assert d[1]["loss_sha256"] == hashlib.sha256(masked.encode()).hexdigest() and d[1]["loss_chars"] == len(masked)
    assert chat.render(chat.fold_events(chat.events_of(table.limit(0)))).count() == 0


def test_chat_events_fold(spark):
    log = [(1, 1, 0, "message", "user", "hi"), (1, 2, 1, "message", "assistant", "he"), (1, 3, 1, "delta", None, "llo"), (1, 4, 1, "regenerate", "assistant", ""), (1, 5, 1, "delta", None, "good "), (1, 6, 1, "delta", None, "day"), (1, 7, 0, "edit", None, "hi!")]
    e = spark.createDataFrame(log, "conv_id long, seq long, turn long, kind string, role string, text string")
    got = {r["turn"]: (r["role"], r["text"]) for r in chat.fold_events(e).collect()}
    assert got == {0: ("user", "hi!"), 1: ("assistant", "good day")}


def test_license_scan(docs, none, spark):
    rows = {r["doc_id"]: r for r in license.scan(docs).collect()}
    assert rows[11]["base_labels"] == "apache-2,mit" and (rows[11]["n_base"], rows[11]["first_word"], rows[11]["last_word"]) == (2, 0, 4)
    assert rows[1]["n_words"] == 0 and rows[1]["first_word"] is None and license.scan(none).count() == 0
    notice = [w.decode() for w in license.words_of(license.TEMPLATES[7][1])]
    mit = license.TEMPLATES[0][1].split()
    texts = [
        (1, "x " * 100 + " ".join(notice[:-3]) + " y" * 50, "bsd"), (2, " ".join(notice[:8]), ""), (3, "x " * 31 + " ".join(reversed(notice)), "bsd"),
        (4, "Licensed under the Mozilla Public License, version 2.0", "mpl-2"), (5, "licensed under the GNU General Public License version 2", "gpl-2"), (6, "the game was released under the public license", ""),
        (7, "licensed under the GNU Lesser General Public License version 3", "lgpl-3"), (8, "Licensed under CC BY-NC-SA 4.0", "cc-by-nc"), (9, "released under the terms of the MIT license", "mit"), (10, " ".join(mit[:150]), "mit"),
        (11, "Licensed under the Apache License, Version 2.0", "apache-2"), (12, "licensed under the terms of a public license, version 3", ""), (13, " ".join(mit[::3]), ""),
    ]
    got = {r["doc_id"]: r["labels"] for r in license.scan(spark.createDataFrame([t[:2] for t in texts], "doc_id long, text string")).collect()}
    assert got == {i: labels for i, _, labels in texts}


def test_license_places_equal_brute_force(spark):
    rng, vocabulary = random.Random(11), "under the MIT license apache version 2 cc by nc, x-1 é".split()
    texts = [(i, "".join(rng.choice(vocabulary) + rng.choice([" ", ", ", "\n", "-"]) for _ in range(rng.randint(0, 60)))) for i in range(300)]
    for r in license.scan(spark.createDataFrame(texts, "doc_id long, text string")).collect():
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in texts[r["doc_id"]][1]))
        at = [(i, label) for p, label in license.PHRASES.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"]) == (len(w), len(at), min((i for i, _ in at), default=None), max((i for i, _ in at), default=None))
        assert r["base_labels"] == ",".join(sorted({label for _, label in at})) and set(r["base_labels"].split(",")) - {""} <= set(r["labels"].split(","))


def test_license_filters_lose_nothing():
    rng, vocabulary = random.Random(3), [f"w{i}" for i in range(14)]
    for _ in range(200):
        template = " ".join(rng.sample(vocabulary, 8))
        text = [rng.choice(vocabulary).encode() for _ in range(60)]
        t = license.Template("x", template, {w.encode(): rng.randint(0, 9) for w in vocabulary}, 0.8)
        places = {}
        for i, w in enumerate(text):
            places.setdefault(w, []).append(i)
        brute = max(len(set(text[b : b + 16]) & set(t.ordered)) for b in range(0, 60, 8))
        assert t.best(text, places) == (brute / 8 if brute >= t.needed else 0.0)


def test_fingerprints(docs, none):
    rows = {}
    for r in fingerprints.compare_with_next(docs).collect():
        rows.setdefault(r["doc_id"], r)
    order = sorted(docs.collect(), key=lambda r: (r["doc_id"] is None, -(r["doc_id"] or 0)))
    for i, r in enumerate(order):
        t, n = r["text"] or "", order[(i + 1) % len(order)]["text"] or ""
        edited = t[: len(t) - len(t) // 2] + n[: len(t) // 2]
        if r["doc_id"] != 6:  # given twice
            assert rows[r["doc_id"]]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
    assert rows[5]["fingerprint"] == rows[6]["fingerprint"] and rows[2]["fingerprint"] == "" and fingerprints.compare_with_next(none).count() == 0


def test_fingerprints_and_likeness_equal_single_calls(spark):
    rng = random.Random(12)
    texts = {i: words(rng, rng.choice([0, 3, 40, 300])) for i in range(40)} | {40: "", 41: "é" * 9}
    one = lambda t: fingerprints.sketches([t])[0]
    for r in fingerprints.compare_with_next(spark.createDataFrame([(i, t, "en", "s", 0) for i, t in texts.items()], DOCS)).collect():
        t, n = texts[r["doc_id"]], texts[(r["doc_id"] - 1) % 42]
        e = t[: len(t) - len(t) // 2] + n[: len(t) // 2]
        assert (r["n_chars"], r["fingerprint"], r["edited_fingerprint"]) == (len(t), fingerprints.fingerprint(one(t)), fingerprints.fingerprint(one(e)))
        split = lambda s: [s[k : k + 8] for k in range(0, len(s), 8)] or ["." * 8] * 64
        for other, near in ((fingerprints.fingerprint(one(e)), r["near_edited"]), (fingerprints.fingerprint(one(n)), r["near_next"])):
            pairs = [(a, b) for a, b in zip(split(r["fingerprint"]), split(other), strict=True) if a[0] != "." or b[0] != "."]
            assert near == (sum(a == b for a, b in pairs) / len(pairs) if pairs else 1.0)


def test_fingerprints_of_many_ranges(spark, monkeypatch):
    """More cuts than a literal list takes; ranges with null ids and with several rows of one id."""
    rows = [(None, "none")] + [(i, f"text {i} " * 3) for i in range(1500)] + [(700, "twice")]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], DOCS).repartition(3)
    once = {(r["doc_id"], r["edited_sha256"], r["near_next"]) for r in fingerprints.compare_with_next(docs).collect()}
    monkeypatch.setattr(fingerprints, "ROWS_PER_RANGE", 1)
    ranged = fingerprints.with_next(docs)
    assert ranged.select("range").distinct().count() > 513
    many = [(r["doc_id"], r["edited_sha256"], r["near_next"]) for r in fingerprints.compare_with_next(docs).collect()]
    assert len(many) == len(rows) and set(many) == once


def test_fingerprints_do_not_depend_on_offset():
    rng = random.Random(8)
    base, other = words(rng, 500), words(rng, 500)
    a, b, c, d = fingerprints.sketches([base, "zzz " + base, base[:2000] + " inserted " + base[2000:], other])
    assert fingerprints.likeness(a, b) > 0.9 and fingerprints.likeness(a, c) > 0.9 and fingerprints.likeness(a, d) < 0.2
    alone = fingerprints.sketches([base])[0]
    assert (alone == a).all() and fingerprints.likeness(a, a) == 1.0


def test_fingerprints_do_not_depend_on_the_texts_beside(spark):
    rng = random.Random(9)
    texts = ["a", "aaaa", "ab", "é", *[words(rng, n) for n in range(1, 60)]]
    long = words(rng, 20_000)
    together = fingerprints.sketches([*texts, "", long])
    for i, t in enumerate(texts):
        assert (fingerprints.sketches([t])[0] == together[i]).all()
    a, b = (spark.createDataFrame([(1, t, "en", "s", 0), (0, t, "en", "s", 0)], DOCS).coalesce(1) for t in (texts[-1], long))
    both = fingerprints.compare_with_next(a.union(b.selectExpr("doc_id + 2 AS doc_id", "text", "lang", "source", "n_chars")))
    assert {r["fingerprint"] for r in both.where("doc_id < 2").collect()} == {r["fingerprint"] for r in fingerprints.compare_with_next(a).collect()}


def test_ftrl_equals_plain_updates():
    rng = random.Random(2)
    texts = [words(rng, rng.randint(0, 12)) + (" bad word here" if i % 3 == 0 else "") for i in range(120)]
    labels = np.array([float(i % 3 == 0) for i in range(120)])
    grams = []
    for t in texts:
        w = t.split()
        own = {(x,) for x in w} | {(a, b, 1) for a, b in zip(w, w[1:], strict=False)} | {(a, b, 2) for a, b in zip(w, w[2:], strict=False)}
        slots = sorted(set(toxicity.slots_of([t])[0].tolist()))
        assert len(slots) == len(own)
        grams.append(slots)
    z, n, bz, bn, tox = {}, {}, 0.0, 0.0, toxicity

    def weight(s):
        zi = z.get(s, 0.0)
        return 0.0 if abs(zi) <= tox.L1 else -(zi - math.copysign(tox.L1, zi)) / ((tox.BETA + math.sqrt(n.get(s, 0.0))) / tox.RATE + tox.L2)

    for _ in range(tox.EPOCHS):
        for own, y in zip(grams, labels, strict=True):
            w, b = {s: weight(s) for s in own}, -bz / ((tox.BETA + math.sqrt(bn)) / tox.RATE)
            g = 1 / (1 + math.exp(-(b + sum(w.values())))) - y
            for s in own:
                old = n.get(s, 0.0)
                z[s] = z.get(s, 0.0) + g - (math.sqrt(old + g * g) - math.sqrt(old)) / tox.RATE * w[s]
                n[s] = old + g * g
            bz, bn = bz + g - (math.sqrt(bn + g * g) - math.sqrt(bn)) / tox.RATE * b, bn + g * g
    wanted = {s: weight(s) for s in z if weight(s)}
    slots, weights, bias = tox.train_ftrl(texts, labels)
    assert set(slots.tolist()) == set(wanted) and all(abs(wanted[s] - w) < 1e-9 for s, w in zip(slots.tolist(), weights, strict=True))
    assert abs(bias + bz / ((tox.BETA + math.sqrt(bn)) / tox.RATE)) < 1e-9 and len(wanted) > 3


def test_toxicity(spark, none):
    rng = random.Random(6)
    rows = [(i, words(rng, 40) + (" you horrid " * 2 if i % 4 == 0 else ""), "en", "s", 0) for i in range(400)]
    docs = spark.createDataFrame([*rows, (1000, None, "en", "s", 0), (None, "x", "en", "s", 0)], DOCS)
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(400)] + [(5, None)], "doc_id long, toxic int")
    held = toxicity.held_out()
    model = toxicity.fit(docs, labels.where(~held))
    got = [r for r in toxicity.score(docs, model).join(labels, "doc_id").where(held & F.col("toxic").isNotNull()).collect()]
    assert len(got) > 50 and sum((r["score"] >= 0.3) == (r["toxic"] == 1) for r in got) / len(got) > 0.97
    assert toxicity.score(none, model).count() == 0
    empty = toxicity.fit(docs, labels.limit(0))
    assert {round(r["score"], 6) for r in toxicity.score(docs, empty).collect()} == {0.5}
