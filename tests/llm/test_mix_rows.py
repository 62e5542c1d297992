"""The multinomial draw and its remainder step; rows that share ids across sources; nulls and empty tables."""

import hashlib
import random

from quireflow.llm import mixing

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def table(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in rows], DOCS)


def test_shards_are_multinomial_draws_with_a_remainder_step(spark):
    draw = random.Random(8)
    rows = [(i, " ".join(["w"] * draw.randint(1, 300)), draw.choice("aaaab") if i % 9 else "c") for i in range(800)]
    mix = mixing.Mix(table(spark, rows), block=16, shard=64)
    src = {r["sid"]: r for r in mix.sources.collect()}
    total = next(iter(src.values()))["slots"]
    want, got = {}, {}
    for k in range(total):
        at = int(hashlib.md5(f"mix:draw:{k}".encode()).hexdigest()[:12], 16) % total
        sid = next(s for s, r in src.items() if r["first_slot"] <= at < r["first_slot"] + r["draws"])
        want[k // 64, sid] = want.get((k // 64, sid), 0) + 1
    assert {(r["shard"], r["sid"]): r["n"] for r in mix.drawn().collect()} == want
    slots = mix.slots.collect()
    assert sorted(r["slot"] for r in slots) == list(range(total))
    assert all(r["slot"] // 64 == r["shard"] for r in slots)
    for r in slots:
        got[r["shard"], r["sid"]] = got.get((r["shard"], r["sid"]), 0) + 1
    over = sum(max(0, sum(n for (_, s), n in want.items() if s == sid) - r["draws"]) for sid, r in src.items())
    assert sum(abs(got.get(k, 0) - want.get(k, 0)) for k in {*got, *want}) == 2 * over > 0
    for sid, r in src.items():  # all blocks of a pass are met once, and totals are those of the targets
        mine = [(x["pass"], x["block"]) for x in slots if x["sid"] == sid]
        assert len(mine) == len(set(mine)) == r["draws"]
        assert all(sum(p == q for p, _ in mine) == r["blocks"] for q in range(r["draws"] // r["blocks"]))


def words_by_row(rows):
    out = {}
    for r in rows:
        key = r["doc_id"], r["source"], r["text"].split()[0]
        out[key] = out.get(key, 0) + len(r["text"].split())
    return out


def test_rows_that_share_an_id_keep_their_source(spark):
    rows = [(7, "alpha " * 40, "a"), (7, "beta " * 25, "b"), (7, "gamma " * 40, "b"), (None, "delta " * 30, "a"), (None, "eps " * 30, None), (1, None, "a"), (2, "", "b"), (3, "zeta " * 9, "c")]
    docs = table(spark, rows)
    for shuffled in (docs, docs.repartition(5)):
        mix = mixing.Mix(shuffled, block=8, keyed=True)
        taken = {(r["id"], r["source"], r["size"]): r["taken"] for r in mix.taken().collect()}
        out = mixing.mix_documents(shuffled, block=8).collect()
        by = words_by_row(out)
        assert sum(by.values()) == sum(taken.values())
        for i, text, source in rows:
            if (text or "").split() and (i, source, len(text.split())) != (7, "b", 40):
                assert by.get((i, source, text.split()[0]), 0) == taken[i, source, len(text.split())]
        assert all({w for w in r["text"].split()} == {r["text"].split()[0]} and r["n_chars"] == len(r["text"]) for r in out)


def test_repeated_rows_and_empty_tables(spark):
    docs = table(spark, [(5, "same words here " * 9, "a")] * 6 + [(6, "other " * 50, "b")])
    got = mixing.mix_documents(docs, block=8).collect()
    taken = sum(r["taken"] for r in mixing.Mix(docs, block=8).taken().collect())
    assert sum(len(r["text"].split()) for r in got) == taken
    assert mixing.mix_documents(docs.limit(0)).count() == 0
    assert mixing.mix_documents(table(spark, [(1, None, None), (None, "", "a")])).count() == 0
