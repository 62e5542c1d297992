"""Nulls, empty and very long texts, ties, repeated rows, empty tables and columns with clashing names."""

import hashlib
import math
import random
import re

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from quireflow.llm import bpe, chat, classifier, exact_dedup, licenses, lm_score, minhash_dedup, mixing, vector_dedup, warc
from quireflow.llm.common import shared_dir
from quireflow.llm.components import components

LONG = "lorem ipsum dolor sit amet " * 20_000
DOCS = "doc_id long, text string, lang string, source string, n_chars long, id long, h string, size long, row long, n long"
EXTRA = (None, "x", 5, 5, 5)


def documents(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, len(t or ""), *EXTRA) for i, t, s in rows], DOCS)


MIXED = [(1, "Same text here.", "a"), (2, "same TEXT here.", "a"), (3, None, None), (4, "", "b"), (5, LONG, "b"), (5, LONG, "b"), (None, "no id", "c"), (7, " \n\t ", None), (8, "one", "a")]


@pytest.fixture(scope="module")
def mixed(spark):
    return documents(spark, MIXED)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def test_exact_groups(mixed, empty):
    rows = {r["doc_id"]: r for r in exact_dedup.exact_groups(mixed).collect() if r["doc_id"] != 5}
    assert (rows[1]["keep_id"], rows[1]["group_size"], rows[1]["kept"], rows[2]["kept"]) == (2, 2, False, True)
    assert rows[3]["keep_id"] == 4 and rows[3]["text_sha256"] == hashlib.sha256(b"").hexdigest()
    assert rows[None]["kept"] and rows[None]["keep_id"] is None
    assert exact_dedup.exact_groups(mixed).where("doc_id = 5").count() == 2
    assert exact_dedup.exact_groups(empty).count() == 0


def test_exact_groups_compare_texts_and_not_only_digests(spark):
    rows = [(i, f"text {i % 7}", "s") for i in range(60)]
    weak = lambda t: F.unhex(F.substring(F.md5(t), 1, 0))  # noqa: E731  one digest for all texts
    got = exact_dedup.exact_groups(documents(spark, rows), digest=weak).collect()
    assert len(got) == 60
    assert all(r["keep_id"] % 7 == r["doc_id"] % 7 and r["keep_id"] >= 53 for r in got)


def test_near_copies(spark, mixed, empty):
    got = minhash_dedup.near_copies(mixed, 2).collect()
    by = {r["doc_id"]: r for r in got}
    assert len(got) == len(MIXED)
    assert (by[3]["n_shingles"], by[3]["component_id"], by[4]["component_id"], by[7]["n_shingles"], by[8]["n_shingles"]) == (0, 3, 4, 0, 1)
    assert (by[2]["component_id"], by[2]["kept"], by[5]["component_id"]) == (1, False, 5)
    assert minhash_dedup.near_copies(empty, 2).count() == 0


def test_near_copies_equal_brute_force_in_large_groups(spark):
    draw = random.Random(2)
    base = [f"w{draw.randint(0, 10_000)}" for _ in range(120)]
    rows = []
    for i in range(700):  # many more than a chunk, at many similarities
        w = list(base)
        for _ in range(draw.choice([0, 2, 5, 9, 14, 25])):
            w[draw.randrange(len(w))] = f"x{draw.randint(0, 100_000)}"
        rows.append((i, " ".join(w), "s"))
    got = {r["doc_id"]: r["component_id"] for r in minhash_dedup.near_copies(documents(spark, rows), 2).collect()}
    sets = [{(a, b) for a, b in zip(t.split(), t.split()[1:])} for _, t, _ in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            shared = len(sets[a] & sets[b])
            if 100 * shared >= 80 * (len(sets[a]) + len(sets[b]) - shared):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    assert got == {i: find(i) for i in range(len(rows))}


def test_drops_go_by_id_and_text(spark):
    long = " ".join(f"w{k}" for k in range(60))
    rows = [(1, "same text", "s"), (1, "clean text", "s"), (2, "SAME text", "s"), (None, "same text", "s"), (None, "alone", "s"), (3, None, "s"), (4, "", "s")]
    got = exact_dedup.drop_exact_copies(documents(spark, rows)).collect()
    assert sorted(((r["doc_id"], r["text"]) for r in got), key=repr) == sorted([(1, "clean text"), (2, "SAME text"), (None, "alone"), (4, "")], key=repr)
    rows = [(1, long, "s"), (2, long + " more", "s"), (2, "quite another text of six words", "s"), (None, long, "s"), (None, "nothing like the others at all", "s")]
    got = minhash_dedup.drop_near_copies(documents(spark, rows)).collect()
    assert sorted(((r["doc_id"], r["text"]) for r in got), key=repr) == sorted([(1, long), (2, rows[2][1]), (None, rows[4][1])], key=repr)


def test_components(spark):
    draw = random.Random(9)
    links = [(k, k + 1) for k in range(0, 300)] + [(1000 + draw.randint(0, 99), 1000 + draw.randint(0, 99)) for _ in range(60)] + [(5, 5)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(links, "u long, v long")).collect()}
    assert {got[k] for k in range(301)} == {0}
    assert all(got[a] == got[b] for a, b in links)


def test_vectors(spark):
    draw = np.random.default_rng(1)
    unit = draw.normal(size=16)
    rows = [(i, [float(x) for x in unit + draw.normal(size=16) * 0.02]) for i in range(400)]
    rows += [(1000, None), (1001, [0.0] * 16), (1002, [math.nan] * 16), (1003, [None] * 16), (1004, [1.0, 2.0]), (1005, [2.0, 4.0]), (1006, []), (1007, [math.inf] * 16), (None, [3.0, 6.0]), (400, rows[0][1])]
    df = spark.createDataFrame([(i, v, 1, 2, 3) for i, v in rows], "vec_id long, embedding array<double>, label int, n int, cid long")
    got = {r["vec_id"]: r for r in vector_dedup.near_vectors(df).collect()}
    x = np.array([v for i, v in rows if i is not None and i <= 400])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    linked = x @ x.T >= 0.95
    assert [got[i]["n_links"] for i in range(401)] == (linked.sum(1) - 1).tolist()
    assert got[400]["component_id"] == 0 and not got[400]["kept"]
    assert [(got[i]["n_links"], got[i]["component_id"]) for i in (1000, 1001, 1002, 1003, 1006, 1007)] == [(0, i) for i in (1000, 1001, 1002, 1003, 1006, 1007)]
    assert (got[1004]["n_links"], got[1005]["component_id"], got[None]["component_id"]) == (2, 1004, 1004)
    assert vector_dedup.near_vectors(df.limit(0)).count() == 0


def test_chat(spark):
    texts = ["</s>[INST] ok [/INST]", "<\\s> [\\INST] <s>\\", "", None, "[\\\\/INST] x" * 40, "word " * 2000, "short"]
    rows = [(1, 0, "system", "be kind"), *[(1, k + 1, ("user", "assistant")[k % 2], t) for k, t in enumerate(texts)], (2, None, None, None), (3, 1, "assistant", "a"), (3, 1, "assistant", "a"), (None, 1, "user", "x")]
    turns = spark.createDataFrame([(*r, 0, "y") for r in rows], "conv_id long, turn long, role string, text string, window int, pos string")
    windows = chat.format_chats(turns, budget=64, history=2, history_tokens=40)
    out = {r["conv_id"]: r for r in chat.read_back(windows).collect()}
    assert [(t["role"], t["text"]) for t in out[1]["turns"]] == [(r[2], r[3] or "") for r in rows[: len(texts) + 1]]
    assert out[1]["targets"] == [t or "" for t in texts[1::2]]
    assert (out[2]["turns"][0]["role"], out[3]["targets"], len(out[None]["turns"])) == ("", ["a", "a"], 1)
    later = windows.where("conv_id = 1 and window > 1").collect()
    assert later and all(r["formatted"].startswith("<s>[INST] system [/INST] be kind</s>") for r in later)
    assert chat.read_back(chat.format_chats(turns.limit(0))).count() == 0


def test_chat_windows_keep_to_the_budget(spark):
    draw = random.Random(3)
    rows = []
    for c in range(60):
        if c % 3:
            rows.append((c, 0, "system", "rule " * draw.randint(0, 60)))
        rows += [(c, k + 1, ("user", "assistant")[k % 2], "x" * draw.choice([0, 5, 40, 200, 700, 9000]) + " <s>" * draw.randint(0, 9)) for k in range(draw.randint(1, 30))]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    for budget, history, tokens in ((256, 2, 64), (512, 3, 100), (128, 0, 64)):
        size = {}
        for c, _, role, text in rows:  # tokens of the turns, by the formatted bytes
            escaped = re.sub(chat.CONTROL, r"\1\\\2\3", text)
            size.setdefault(c, []).append((role, -(-len(chat.OPEN + role + chat.MIDDLE + escaped + chat.CLOSE) // chat.BYTES)))
        windows = chat.format_chats(turns, budget, history, tokens).collect()
        for w in windows:
            own = size[w["conv_id"]]
            system = own[0][1] if own[0][0] == "system" else 0
            assert len(w["formatted"]) <= chat.BYTES * max(budget, system + max(n for _, n in own))
        back = {r["conv_id"]: [t["text"] for t in r["turns"]] for r in chat.read_back(chat.format_chats(turns, budget, history, tokens)).collect()}
        assert all(back[c] == [r[3] for r in rows if r[0] == c] for c in size)
        assert history == 0 or sum(w["context_turns"] > 1 for w in windows) > 10


def test_warc(spark):
    body = "<html>" + "x" * 200
    rows = [(5, "http://a/ b\r\n", body), (3, None, body), (3, None, body), (None, "u", body), (6, "u", "tiny"), (7, "u", "tiny"), (8, "u", None), (9, "u", "é" * 300_000)]
    pages = spark.createDataFrame([(*r, "z") for r in rows], "page_id long, url string, html string, digest string")
    path = shared_dir(spark)
    assert warc.write_archives(pages, path)[0] == len(rows)
    got = warc.read_archives(spark, path, payloads=True).collect()
    same = [r for r in got if r["payload_bytes"] == len(body)]
    assert sorted((r["record_type"], r["refers_to"] or 0) for r in same) == [("response", 0), ("revisit", 3), ("revisit", 3), ("revisit", 3)]
    assert all(r["payload_digest"] == hashlib.sha256(body.encode()).hexdigest() for r in same)
    assert {(r["page_id"], r["record_type"]) for r in got if r["payload_bytes"] < 100} == {(6, "response"), (7, "response"), (8, "response")}
    assert next(bytes(r["payload"]) for r in got if r["page_id"] == 9) == ("é" * 300_000).encode()


def test_licenses(spark, mixed, empty):
    long_text = "word " * 5000 + licenses.TEMPLATES["MIT"] + " end" * 3000
    broken = " ".join(w if k % 40 else "zzz" for k, w in enumerate(licenses.TEMPLATES["MIT"].split()))
    rows = [(1, long_text, "s"), (2, "all RIGHTS reserved", "s"), (3, "Released under the MIT License. Released under the MIT License.", "s"), (4, "rights are reserved by all", "s"), (5, broken, "s")]
    got = {(r["doc_id"], r["license"]): r for r in licenses.scan_licenses(documents(spark, rows)).collect()}
    assert {k for k in got if k[0] != 5} == {(1, "MIT"), (2, "reserved"), (3, "MIT-notice")}
    assert 0.8 <= got[5, "MIT"]["n_found"] / got[5, "MIT"]["n_shingles"] < 1
    assert licenses.scan_licenses(mixed).count() == licenses.scan_licenses(empty).count() == 0


def test_licenses_beside_each_other_equal_sql(spark, tmp_path):
    draw = random.Random(12)
    t, rows = licenses.TEMPLATES, []
    for a in t:  # all pairs, at several offsets, whole and with words replaced
        for b in t:
            for at in (0, 1, 7, 17, 31, 45, 62, 95):
                body = (t[a] + " " + t[b]).split()
                body = [w if draw.random() > 0.02 * (at % 3) else "zzz" for w in body]
                rows.append((len(rows), " ".join(["word"] * at + body), "s"))
    rows += [(None, t["MIT"], "s"), (None, None, "s"), (0, t["ISC"], "s"), (9_000, t["ISC"] + " " + t["ISC"], "s")]  # ids that repeat, ties
    docs = documents(spark, rows)
    docs.write.parquet(str(tmp_path / "documents"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents/*.parquet'")
    found = con.execute(licenses.OP3_SQL)
    names = [d[0] for d in found.description]
    got = licenses.scan_licenses(docs).select(names).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(found.fetchall(), key=repr)
    pairs = {(r["doc_id"], r["license"]) for r in got}
    whole = [(k, name) for k in range(0, len(t) ** 2 * 8, 8) for name in (list(t)[k // 8 // len(t)], list(t)[k // 8 % len(t)])]  # those at offset 0
    assert pairs >= set(whole) and {(None, "MIT"), (0, "ISC"), (9_000, "ISC")} <= pairs


def test_mix(spark, empty):
    draw = random.Random(4)
    rows = [(i, " ".join(["w"] * draw.randint(0, 400)), draw.choice(["a", "a", "a", "b", "c", None])) for i in range(500)] + [(1, "x y", "a"), (None, "x", "d"), (777, None, "e")]
    docs = documents(spark, rows)
    got = mixing.Mix(docs).taken().collect()
    assert len(got) == len(rows)
    assert all(r["taken"] <= 3 * r["size"] for r in got)
    total = sum(r["size"] for r in got)
    by = {}
    for r in got:
        by.setdefault(r["source"], [0, r["target"], r["source_size"]])[0] += r["taken"]
    assert sum(t for _, t, _ in by.values()) == pytest.approx(total)
    assert all(t <= 3 * s and abs(k - t) <= 2 * mixing.BLOCK for k, t, s in by.values())
    again = mixing.Mix(docs.repartition(7)).taken().collect()
    assert sorted(map(tuple, got), key=repr) == sorted(map(tuple, again), key=repr)
    slots = [r["slot"] for r in mixing.Mix(docs).slots.collect()]
    assert sorted(slots) == list(range(len(slots)))
    assert mixing.Mix(empty).taken().count() == 0
    rows = mixing.mix_documents(docs)
    assert rows.columns == docs.columns
    passes, sizes = {}, {}
    for r in got:
        passes[r["id"]] = passes.get(r["id"], 0) + r["taken"]
    for r in rows.collect():
        sizes[r["doc_id"]] = sizes.get(r["doc_id"], 0) + len(r["text"].split())
    assert sizes == {k: v for k, v in passes.items() if v}


def test_bpe(spark, mixed, empty):
    import public_tokenizers
    import tiktoken

    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    draw = random.Random(6)
    odd = ["a" * n for n in (1, 2, 3, 5, 99, 4001)] + ["ab" * 400, " the" * 900, "é" * 701, "😀" * 50, "<|endoftext|>", "aaab" * 900, LONG.replace(" ", "")]
    odd += ["".join(draw.choice("abnthesing") for _ in range(draw.randint(1, 3000))) for _ in range(40)]
    codec = bpe.Codec(ranks, public_tokenizers.PATTERN)
    for text, ids in zip(odd, codec.encode(odd), strict=True):
        assert ids.tolist() == library.encode_ordinary(text)
        assert codec.decode(ids.astype(np.int64)) == text.encode()
    got = {r["doc_id"]: r for r in bpe.tokenised(mixed).collect()}
    assert (got[3]["n_tokens"], got[4]["n_tokens"], got[5]["n_tokens"]) == (0, 0, len(library.encode_ordinary(LONG)))
    assert bpe.tokenised(empty).count() == 0
    with pytest.raises(ValueError, match="outside"):
        codec.decode(np.array([60_000]))


def test_classifier(spark, mixed, empty):
    labels = spark.createDataFrame([(1, 1), (1, 1), (2, None), (5, 0)], "doc_id long, quality int")
    rows = classifier.score(mixed, classifier.fit(mixed, labels)).collect()
    assert len(rows) == len(MIXED) and all(0 <= r["score"] <= 1 for r in rows)
    bare = classifier.score(mixed, classifier.fit(mixed, labels.limit(0))).collect()
    assert {r["score"] for r in bare} == {0.5}
    assert classifier.score(empty, classifier.fit(empty, labels)).count() == 0


def test_language_model(spark, mixed, empty):
    got = lm_score.lm_scores(mixed, F.lit(True)).collect()
    assert len(got) == len(MIXED)
    by = {r["doc_id"]: r for r in got}
    assert (by[3]["n_tokens"], by[4]["n_tokens"], by[8]["n_tokens"]) == (1, 1, 2)
    none = lm_score.lm_scores(mixed, F.lit(False)).collect()
    assert all(r["base_score"] == 0 and r["train_tokens"] == 0 for r in none)
    one = next(r for r in none if r["doc_id"] == 8)
    assert one["score"] == pytest.approx(32 * math.log10(0.5), rel=1e-3)  # three bytes and the end
    assert lm_score.lm_scores(empty, F.lit(True)).count() == 0


def test_warc_keeps_a_response_of_each_payload_in_any_order(spark):
    rows = [(k % 40 or None, f"u{k % 3}" if k % 7 else None, f"{'x' * (90 + k % 20)}{k % 6}") for k in range(400)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    for table in (pages.repartition(7, F.rand(3)), pages.orderBy(F.rand(4)).coalesce(3)):
        path = shared_dir(spark)
        assert warc.write_archives(table, path)[0] == len(rows)
        got = warc.read_archives(spark, path, payloads=True).collect()
        assert len({r["record_id"] for r in got}) == len(rows)
        responses = {r["record_id"]: r for r in got if r["record_type"] == "response"}
        want = {}
        for i, _, html in rows:
            want.setdefault(html, []).append(i)
        by = {}
        for r in got:
            by.setdefault(r["payload_digest"], []).append(r)
        for html, ids in want.items():
            own = by[hashlib.sha256(html.encode()).hexdigest()]
            assert sorted(map(str, ids)) == sorted(str(r["page_id"]) for r in own)
            first = [r for r in own if r["record_type"] == "response"]
            if len(html) < 100:
                assert len(first) == len(own)
                continue
            assert [bytes(r["payload"]) for r in first] == [html.encode()]
            assert first[0]["page_id"] == min((i for i in ids if i is not None), default=None)
            assert all(responses[r["refers_to_id"]] is first[0] for r in own if r["record_type"] == "revisit")


def test_warc_of_an_empty_table(spark):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.write_archives(pages, shared_dir(spark)) == (0, 0)
