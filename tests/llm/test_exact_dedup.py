"""Exact de-duplication: no files between its steps, decisions by whole texts, A-Z alone lower-cased."""

from pathlib import Path

from pyspark.sql import functions as F

from quireflow.llm import exact_dedup
from quireflow.llm.common import LOWER, UPPER, ascii_lower

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def table(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], DOCS)


def test_no_files_are_written_between_the_steps(spark):
    docs = table(spark, [(i, f"Text {i % 50}") for i in range(200)])
    shared = Path(spark.sparkContext.getConf().get("spark.checkpoint.dir"))
    before = {*shared.rglob("*.parquet")}
    assert exact_dedup.exact_groups(docs).count() == 200
    assert exact_dedup.drop_exact_copies(docs).count() == 50
    assert {*shared.rglob("*.parquet")} == before


def test_dropped_copies_have_equal_texts_and_not_only_digests(spark):
    rows = [(i, f"text {i % 7}") for i in range(60)] + [(None, "text 3"), (None, "alone"), (None, "ALONE"), (8, "of 8"), (59, "Of 59")]
    stay = [*rows[53:60], *rows[61:]]
    weak = lambda t: F.unhex(F.substring(F.md5(t), 1, 0))  # noqa: E731  one digest for all texts
    for digest in (weak, exact_dedup.sha256):
        got = exact_dedup.drop_exact_copies(table(spark, rows), digest=digest).collect()
        assert sorted(((r["doc_id"], r["text"]) for r in got), key=repr) == sorted(stay, key=repr)


def test_rows_are_not_shuffled_to_few_dropped_digests(spark, monkeypatch):
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    docs = table(spark, [(i, f"text {i % 7}") for i in range(60)] + [(None, "text 3"), (None, "alone"), (None, "ALONE"), (59, "Text 3")])
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for limit, used, other in ((48 << 20, "BroadcastHashJoin", "SortMergeJoin"), (0, "SortMergeJoin", "BroadcastHashJoin")):
            monkeypatch.setattr(exact_dedup, "BROADCAST_BYTES", limit, raising=False)
            got = exact_dedup.drop_exact_copies(docs)
            plan = got._jdf.queryExecution().executedPlan().toString()
            assert used in plan and other not in plan
            want = [(i, f"text {i % 7}") for i in range(53, 60)] + [(None, "alone"), (None, "ALONE"), (59, "Text 3")]
            assert sorted(((r["doc_id"], r["text"]) for r in got.collect()), key=repr) == sorted(want, key=repr)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)


def test_only_a_to_z_are_lower_cased(spark):
    texts = ["", "ABC xyz [\\]^_`@{", "\x00A\x7fZ", "ÀB", "İI", "KK", "ΑΣ A", "ẞS", "𐐀A", "É", "A�B"]
    rows = spark.createDataFrame([(t,) for t in [*texts, None]], "t string").select("t", ascii_lower(F.col("t")).alias("low")).collect()
    assert [r["low"] for r in rows] == [(r["t"] or "").translate(str.maketrans(UPPER, LOWER)) for r in rows]
