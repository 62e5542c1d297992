"""The language model against a plain-Python one, and scores that don't depend on what else is scored."""

import math
import random
import shutil
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from quireflow.llm import lm_score
from quireflow.llm.common import mix64, span_hashes

WORDS = "the cat sat on a mat and the old dog of our house ran to it in le chien est la der hund ist ein".split()
SPACE = b" \t\n\v\f\r"


def texts(n, seed):
    draw = random.Random(seed)
    return [" ".join(draw.choice(WORDS) for _ in range(draw.randint(0, 40))) + draw.choice(["", " ", "\n\n", " ."]) for _ in range(n)]


def number(span: bytes) -> int:
    """span_hashes() of one span, not mixed."""
    raw = np.frombuffer(span, np.uint8)
    return int(span_hashes(raw, np.array([0]), np.array([len(raw)]), mixed=False)[0]) if span else 0


def mix(x: int) -> int:
    return int(mix64(np.array([x & (1 << 64) - 1], np.uint64))[0])


def plain_keys(text: str, group) -> list[int]:
    """What stream() gives for one text, byte by byte."""
    raw = bytes(b + 32 if 65 <= b <= 90 else b for b in text.encode())
    met, word, out = [0] * lm_score.GROUPS, b"", []
    top = lambda: met.index(max(met)) if max(met) else lm_score.GROUPS
    open_register = top()
    for i in range(len(raw) + 1):
        register = open_register if word else top()
        key = mix(number(word) + (register + 1) * 0xD1342543DE82EF95) & 0xFFFFFF << 40
        gram = 0
        for b in [*([255] * 4 + list(raw))[i : i + 4], raw[i] if i < len(raw) else 255]:
            gram = gram << 8 | b
        out.append(key | gram)
        if i < len(raw):
            if raw[i] in SPACE:
                if word and len(word) <= 3:
                    own = group[mix(number(word)) % lm_score.SHORT]
                    if own >= 0:
                        met[own] += 1
                word = b""
            else:
                if not word:
                    open_register = top()
                word += raw[i : i + 1]
    return out


def test_strings_equal_a_plain_reading_of_each_text():
    group = np.arange(lm_score.SHORT) % (lm_score.GROUPS + 1) - 1
    rows = [*texts(30, 1), "", " ", "a", "A  b", "é ü the", "the ", " the"]
    raw = [t.encode() for t in rows]
    keys = lm_score.stream(np.frombuffer(b"".join(raw), np.uint8), np.r_[0, np.cumsum([len(x) for x in raw])], group)
    want = [k for t in rows for k in plain_keys(t, group)]
    assert keys.view(np.uint64).tolist() == want


def plain_log10(key: int, model) -> float:
    """The log10 probability of a string's last byte, one decision after another."""
    total = 0.0
    gram = np.array([key], np.uint64).view(np.int64)
    context, last = key >> 8 & 0xFFFFFFFF, key & 255
    for bit in range(8):
        node, y = 1 << bit | last >> 8 - bit, last >> 7 - bit & 1
        slots = [node]
        for k in range(1, len(lm_score.BITS)):
            own = (context & (1 << 8 * k) - 1) << 8 | node
            slots.append(int(lm_score.OFFSET[k]) + (own if lm_score.BITS[k] >= 8 * k + 8 else mix(own + (k << 56)) >> 64 - lm_score.BITS[k]))
        p, gate, often, x = 0.5, 0, None, []
        for k, slot in enumerate([*slots, None]):
            both = int(model.words[lm_score.word_slots(gram, bit)[0]] if slot is None else model.bytes[slot])
            n0, n1 = float(lm_score.COUNT[both & 0xFFFF]), float(lm_score.COUNT[both >> 16])
            p = min(max((n1 + p) / (n0 + n1 + 1), 1e-6), 1 - 1e-6)
            x.append(math.log(p / (1 - p)))
            if slot is not None and (n0 + n1 >= 1 or often is None):
                gate, often = (k if n0 + n1 >= 1 else 0), n0 + n1
        kind = sum(n0 + n1 >= c for c in lm_score.WORD_SEEN)
        own = (gate * (len(lm_score.SEEN) + 1) + sum(often >= c for c in lm_score.SEEN)) * (len(lm_score.WORD_SEEN) + 1) + kind
        z = min(max(sum(a * float(w) for a, w in zip([*x, 1.0], model.weights[own], strict=True)), -16), 16)
        one = 1 / (1 + math.exp(-z))
        place = min(max((z + 8) * 2, 0), lm_score.STEPS - 1.00001)
        cell = node * lm_score.STEPS + int(place)
        fine = model.refine[cell] + (model.refine[cell + 1] - model.refine[cell]) * (place - int(place))
        one = 0.5 * (one + fine)
        total += math.log10(one if y else 1 - one)
    return total


@pytest.fixture(scope="module")
def trained(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts(300, 2))], "doc_id long, text string").coalesce(1)
    counts = lm_score.gather(docs)
    group = lm_score.group_short(counts)
    made = lm_score.strings(docs, group, 1)
    tables, weights, refine = lm_score.train(made)
    return docs, group, made, lm_score.Model(tables.value, weights, refine)


def test_scores_equal_a_plain_model(spark, trained):
    docs, group, _, model = trained
    rows = [*texts(6, 3), "", "unseen words entirely", "the cat "]
    every = docs.unionByName(spark.createDataFrame([(1000 + i, t) for i, t in enumerate(rows)], docs.schema))
    got = {r["doc_id"]: r["score"] for r in lm_score.lm_scores(every, F.col("doc_id") < 1000).collect()}
    for i, text in enumerate(rows):
        assert got[1000 + i] == pytest.approx(sum(plain_log10(k, model) for k in plain_keys(text, group)), rel=1e-4)


def test_the_next_byte_has_a_probability_distribution(trained):
    _, group, _, model = trained
    for text in ["", "the c", "the cat ", "zzz"]:
        key = plain_keys(text, group)[-1]
        every = np.array([key & ~255 | b for b in range(256)], np.uint64).view(np.int64)
        assert (10 ** model.log10(every)).sum() == pytest.approx(1, rel=1e-5)


def test_counts_are_those_of_all_strings(trained):
    docs, group, made, _ = trained
    want = {}
    for row in docs.collect():
        for k in plain_keys(row["text"], group):
            want[k] = want.get(k, 0) + 1
    got = {}
    for row in made.where("kind = 0").collect():
        got.update(zip(np.frombuffer(bytes(row["keys"]), np.uint64).tolist(), np.frombuffer(bytes(row["n"]), np.int64).tolist(), strict=True))
    assert got == want


def test_equal_texts_score_equal_wherever_they_stand(spark):
    draw = random.Random(5)
    same = ["the cat sat on the mat ", "a dog\n", "", "der hund ist  "]
    rows = [(k, t) for k, t in enumerate(texts(80, 4))]
    rows += [(1000 + 10 * k + j, t) for k, t in enumerate(same) for j in range(10)]
    draw.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for table in (docs.coalesce(1), docs.repartition(5)):
        got = lm_score.lm_scores(table, F.col("doc_id") < 1000).where("doc_id >= 1000").collect()
        for k in range(len(same)):
            assert len({round(r["score"], 9) for r in got if (r["doc_id"] - 1000) // 10 == k}) == 1


def test_scoring_writes_no_files(spark):
    """Each file that an executor writes on a local disk starts a process, which shows the JVM's memory twice for a moment."""
    base = Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file:"))
    files = lambda: {p for p in base.rglob("*") if p.is_file()}
    docs = spark.createDataFrame(list(enumerate(texts(60, 6))), "doc_id long, text string")
    before = files()
    ids = {r["doc_id"] for r in lm_score.lm_scores(docs, F.col("doc_id") < 30).collect()}
    assert len(ids) == 60 and files() == before


def test_blocks_of_equal_plans_are_not_shared(spark, tmp_path):
    path = str(tmp_path / "docs")
    totals = []
    for seed in (7, 8):
        spark.createDataFrame(list(enumerate(texts(40, seed))), "doc_id long, text string").coalesce(1).write.parquet(path)
        totals.append({r["train_tokens"] for r in lm_score.lm_scores(spark.read.parquet(path), F.lit(True)).collect()})
        shutil.rmtree(path)  # behind Spark's back
    assert totals == [{sum(len(t.split()) + 1 for t in texts(40, seed))} for seed in (7, 8)]


def test_scores_do_not_depend_on_the_order_of_strings(trained):
    _, group, _, model = trained
    keys = np.unique(np.array([k for t in texts(20, 9) for k in plain_keys(t, group)], np.uint64).view(np.int64))
    order = np.random.default_rng(1).permutation(len(keys))
    assert (model.log10(keys[order]) == model.log10(keys)[order]).all()
