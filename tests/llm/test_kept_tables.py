"""Near dedup and the mix keep their larger tables in blocks, since executors start processes for files on a local disk."""

from pathlib import Path

from quireflow.llm import minhash_dedup, mixing

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def written(spark, run):
    shared = Path(spark.sparkContext.getConf().get("spark.checkpoint.dir"))
    before = {*shared.rglob("*.parquet")}
    rows = run().count()
    return rows, {p.parent.name for p in {*shared.rglob("*.parquet")} - before}


def test_large_tables_are_not_files(spark):
    text = [" ".join(f"w{i // 2}_{k}" for k in range(60)) for i in range(80)]
    docs = spark.createDataFrame([(i, t + f" x{i}", "en", "ab"[i % 2], len(t)) for i, t in enumerate(text)], DOCS).repartition(6)
    rows, tables = written(spark, lambda: minhash_dedup.drop_near_copies(docs))
    assert rows == 40 and tables <= {"classes", "links", "components"}  # their keys depend on the run, or rounds release them
    rows, tables = written(spark, lambda: mixing.mix_documents(docs, block=16))
    assert rows and tables <= {"sources", "met", "passes"}  # a file each


def test_near_dedup_gives_its_blocks_back(spark):
    spark.catalog.clearCache()
    text = " ".join(f"w{k}" for k in range(60))
    docs = spark.createDataFrame([(i, f"{text} x{i}", "en", "a", 1) for i in range(20)], DOCS)
    got = minhash_dedup.near_copies(docs)
    assert {r["component_id"] for r in got.collect()} == {0}
    assert spark.sparkContext._jsc.getPersistentRDDs().size() <= 1  # the rows that are yet to be returned
