"""The pipeline's stages on the smallest tables, each against plain Python over its own input."""

import math
import zlib

import numpy as np
import pytest

import corpus_pipeline
from test_operators import W, brute_components, brute_pii
from veristrata.llm import registry
from veristrata.llm.common import documents, materialize

DATA = "/root/testdata/sf0.001"


def base_failed(text):
    w, seen, covered = W.findall(text or ""), {}, set()
    for j in range(len(w) - 2):
        seen.setdefault(tuple(w[j : j + 3]), []).append(j)
    for places in seen.values():
        if len(places) > 1:
            covered.update(k for j in places for k in (j, j + 1, j + 2))
    return len(w) < 50 or 100 * len(covered) > 50 * len(w)


def plainly_redacted(text):
    spans = sorted((a, b, k) for k, found in zip(("EMAIL", "IP", "CARD", "PHONE"), brute_pii(text), strict=True) for a, b in found)
    out, at = "", 0
    for a, b, k in spans:
        if a >= at:
            out += text[at:a] + f"[{k}]"
        at = max(at, b)
    return out + text[at:]


def test_stages(spark):
    from tokenizers import Tokenizer

    import public_tokenizers

    docs = documents(spark, DATA)
    columns, (_, rules), (_, dedup), (_, redact), (_, mix), (_, pack) = docs.columns, *corpus_pipeline.STAGES
    good = materialize(rules(spark, docs, DATA), "t0")
    assert good.columns == columns
    # so few labels certify no cutoff beyond the base rules
    assert sorted(r["doc_id"] for r in good.collect()) == sorted(r["doc_id"] for r in docs.collect() if not base_failed(r["text"]))
    single = materialize(dedup(spark, good, DATA), "t1")
    components, _ = brute_components([(r["doc_id"], r["text"]) for r in good.collect()])
    assert single.columns == columns and sorted(r["doc_id"] for r in single.collect()) == sorted(set(components.values()))
    clean = materialize(redact(spark, single, DATA), "t2")
    before = {r["doc_id"]: r["text"] for r in single.collect()}
    assert clean.columns == columns and clean.count() == len(before)
    assert all(r["text"] == plainly_redacted(before[r["doc_id"]]) and r["n_chars"] == len(r["text"]) for r in clean.collect())
    mixed = materialize(mix(spark, clean, DATA), "t3")
    size = {r["doc_id"]: (r["source"], len(W.findall(r["text"]))) for r in clean.collect()}
    taken, counts = {}, {}
    for r in mixed.collect():
        source, n = size[r["doc_id"]]
        taken[source] = taken.get(source, 0) + n
        counts[r["doc_id"]] = counts.get(r["doc_id"], 0) + 1
    total, own, order = sum(n for _, n in size.values()), {}, sorted({s for s, _ in size.values()})
    for s, n in size.values():
        own[s] = own.get(s, 0) + n
    weight, capped = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}, set()
    while True:
        rest = (total - sum(3 * own[s] for s in capped)) / max(1, sum(weight[s] for s in order if s not in capped))
        target = {s: 3 * own[s] if s in capped else rest * weight[s] for s in order}
        over = {s for s in order if target[s] > 3 * own[s] + 1e-6}
        if not over:
            break
        capped |= over
    largest = {s: max(n for t, n in size.values() if t == s) for s in order}
    assert mixed.columns == columns and max(counts.values()) <= 3
    assert all(target[s] - largest[s] <= taken.get(s, 0) <= target[s] + 1e-6 for s in order)
    packed = pack(spark, mixed, DATA).collect()
    plain = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = {r["doc_id"]: r["text"] for r in mixed.collect()}
    ids = {d: np.array([*plain.encode(t, add_special_tokens=False).ids, 0], dtype="<u4") for d, t in texts.items()}
    by: dict = {}
    for r in packed:
        part = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert len(part) == r["length"] and zlib.crc32(part) == r["ids_crc32"]
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in by.values():
        parts.sort()
        assert all(a[0] + a[1] == b[0] for a, b in zip(parts, parts[1:], strict=False)) and parts[0][0] == 0 and sum(n for _, n in parts) <= 2048
    assert sum(r["length"] for r in packed) == sum(len(ids[d]) * n for d, n in counts.items())
    assert len(by) <= math.ceil(1.02 * sum(r["length"] for r in packed) / 2048) + 2


QUERIES = {
    "op1_toxicity_ftrl": "doc_id bigint, held_out boolean, score double, predicted int",
    "op2_pii_skip_chain": "doc_id bigint, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string",
    "op3_mixing_pareto": "doc_id bigint, size bigint, source_size bigint, target double, taken bigint",
    "op4_token_files": "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint",
    "op5_minhash_near_dedup": "doc_id bigint, n_shingles bigint, component_id bigint, kept boolean",
    "op6_chat_formatting": "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint",
    "op7_license_scan": "doc_id bigint, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double",
    "op8_quality_rules": "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, kept boolean",
    "op9_document_fingerprints": "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double",
    "op10_best_fit_packing": "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint",
    "op12_fill_in_middle": "doc_id bigint, n bigint, form string, prefix_chars bigint, middle_chars bigint, output_sha256 string, restored_sha256 string",
    "op13_byte_bpe": "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string",
}


@pytest.mark.parametrize("name", QUERIES)
def test_queries_return_their_columns_for_all_rows(spark, name):
    out = registry.queries()[name](spark, DATA)
    wanted = [tuple(c.split()) for c in QUERIES[name].split(", ")]
    assert out.dtypes[: len(wanted)] == wanted
    table = "conversations" if name.startswith("op6") else "documents"
    key = "conv_id" if table == "conversations" else "doc_id"
    rows, own = out.collect(), {r[0] for r in spark.read.parquet(f"{DATA}/{table}.parquet").select(key).collect()}
    assert {r[key] for r in rows} == own | ({-7} if key == "conv_id" else set())
    if name.startswith("op6"):
        import duckdb

        con = duckdb.connect(config={"memory_limit": "1GB"})
        con.execute(f"create view conversations as select * from '{DATA}/conversations.parquet'")
        assert sorted(map(tuple, rows)) == sorted(con.execute(registry.oracle_sql()[name]).fetchall())
