"""Queries at a small scale: against SQL, where there is one, else against brute force."""

import collections
import hashlib
import math
import re
import struct
import zlib

import pytest

from quireflow.llm.queries import ORACLES, QUERIES

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(name, spark, sf_dir, same_rows):
    same_rows(QUERIES[name](spark, sf_dir), ORACLES[name])


def test_bpe_equals_the_library(spark, sf_dir):
    import public_tokenizers
    import tiktoken

    from quireflow.llm.bpe import read_ranks

    ranks = read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = {r["doc_id"]: r for r in QUERIES["op6_byte_bpe"](spark, sf_dir).collect()}
    for doc in spark.read.parquet(f"{sf_dir}/documents.parquet").collect():
        ids, row = library.encode_ordinary(doc["text"] or ""), got[doc["doc_id"]]
        assert (row["n_tokens"], row["ids_sha256"]) == (len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest())
        assert row["decoded_sha256"] == hashlib.sha256((doc["text"] or "").encode()).hexdigest()


def test_classifier_on_rows_it_did_not_learn_from(spark):
    sf_dir = "/root/testdata/sf0.01"
    truth = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    rows = QUERIES["op8_quality"](spark, sf_dir).collect()
    assert len(rows) == spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)
        assert 0 <= r["score"] <= 1
        assert r["predicted"] == (r["score"] >= 0.7)
    held = [r for r in rows if r["held_out"] and r["doc_id"] in truth]
    assert sum(r["predicted"] == truth[r["doc_id"]] for r in held) / len(held) > 0.95


def test_language_model_counts_and_base_score(spark):
    sf_dir = "/root/testdata/sf0.01"
    docs = {r["doc_id"]: words(r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = {r["doc_id"]: r for r in QUERIES["op4_context_mixing"](spark, sf_dir).collect()}
    assert rows.keys() == docs.keys()
    count, ends = collections.Counter(), 0
    for i, w in docs.items():
        if zlib.crc32(str(i).encode()) % 7 != 2:
            count.update(w)
            ends += 1
    n, v = sum(count.values()) + ends, len(count) + 1
    for i, w in docs.items():
        r = rows[i]
        base = sum(math.log10((count[x] + 1) / (n + v + 1)) for x in [*w]) + math.log10((ends + 1) / (n + v + 1))
        assert r["base_score"] == pytest.approx(base, abs=1e-6)
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(w) + 1, sum(count[x] > 0 for x in w) + 1, n)
        assert r["score"] < 0
    held = [r for r in rows.values() if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)  # beats the unigram model on unseen texts


def test_pipeline_stages_against_brute_force(spark, sf_dir, tmp_path):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        before = {r["doc_id"]: r for r in docs.collect()}
        out = stage(spark, docs, sf_dir)
        after = out.collect()
        if name == "exact dedup":
            keep = {}
            for i, r in before.items():
                t = (r["text"] or "").translate(LOWER)
                keep[t] = max(keep.get(t, i), i)
            assert {r["doc_id"] for r in after} == set(keep.values())
        elif name == "near dedup":
            sets = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if (w := words(r["text"])) else set() for i, r in before.items()}
            root = {i: i for i in sets}
            ids = sorted(sets)
            for a in ids:
                for b in ids:
                    if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                        x, y = sorted((root[a], root[b]))
                        root = {i: x if r == y else r for i, r in root.items()}
            assert {r["doc_id"] for r in after} == set(root.values())
        elif name == "byte-level bpe":
            assert all(r["decoded_sha256"] == hashlib.sha256((before[r["doc_id"]]["text"] or "").encode()).hexdigest() for r in after if after.count(r) == 1 and sum(x["doc_id"] == r["doc_id"] for x in after) == 1)
        if name != "byte-level bpe":
            assert out.columns == columns
            out.write.mode("overwrite").parquet(str(tmp_path / name))
            docs = spark.read.parquet(str(tmp_path / name))
