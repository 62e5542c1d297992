import random

import pytest
from pyspark.sql import functions as F

from quireflow import catalog
from quireflow.functions import classify, geometry
from quireflow.functions import text as tx
from quireflow.operators import enrich, merge, metrics, render, route, state
from quireflow.sources import html
from quireflow.streaming import events

BOX = "struct<x0:double,y0:double,x1:double,y1:double>"


def one(spark, col, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'string' if not isinstance(v, tuple) else BOX}" for k, v in values.items()))
    return row.select(col.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("f", "given", "wanted"),
    [
        (tx.drop_replacement, "foo�bar", "foobar"),
        (tx.clean_text, "a​b­c", "abc"),
        (tx.clean_text, "x<sup>&</sup>y", "xy"),
        (tx.clean_text, "x<sup>&amp;</sup>y", "xy"),
        (tx.clean_text, "R &amp; C", "R & C"),
        (tx.clean_text, None, None),
        (tx.composed_form, "café", "café"),
        (tx.fix_whitespace, "a\n\n\n\n\nb", "a\n\nb\n"),
        (tx.sanitize_latex, "$  x\n$", "$ x $"),
        (tx.figure_reference, "see Fig. 3.2 there", "Fig. 3.2"),
        (tx.heading_level, "#### Deep", "h4"),
        (tx.heading_level, "plain", "h2"),
        (classify.markdown_type, "12. item", "list"),
        (classify.markdown_type, "![a](b.png)", "figure"),
        (classify.list_type, "```x```", "paragraph"),
        (classify.region_type, "Short Title", "heading"),
        (classify.region_type, "a ∑ b is a sum.", "equation"),
        (classify.engine_type, "Page-Header", "header"),
        (classify.engine_type, "footnote", "footer"),
        (classify.engine_type, "blob", "paragraph"),
        (classify.label_type, "Section-Header", "heading"),
        (classify.label_type, "DocItemLabel.LIST-ITEM", "list"),
        (classify.label_type, "text_figure", "paragraph"),
        (classify.adapted_type, "blob", "other"),
        (classify.markdown_type, "| one bar", "paragraph"),
        (classify.markdown_type, "|a|", "table"),
        (classify.list_type, "| one bar", "paragraph"),
        (tx.clean_text, "x<SUP> & </SUP>y<Sub> </Sub>", "xy"),
        (tx.clean_text, "AT&T &copy; 2", "AT&T © 2"),
        (tx.clean_text, "&copy; 2", "&copy; 2"),
        (tx.clean_text, "\n a  b\t\tc \n", "a b c"),
        (tx.figure_reference, "Chart 4-1 shows", "Chart 4-1"),
        (tx.figure_reference, "şekil 3", ""),
        (tx.merge_broken_sentences, "One line\ngoes on.\nnext\nUpper\n\nlower\nx\ny", "One line goes on.\nnext\nUpper\n\nlower x y"),
        (tx.safe_name, "a/b/c d!.pdf", "cd.pdf"),
        (tx.safe_name, "", "input.pdf"),
    ],
)
def test_text_functions(spark, f, given, wanted):
    assert one(spark, f(F.col("t")), t=given) == wanted


@pytest.mark.parametrize(("f", "given", "wanted"), [(tx.is_rtl, "مرحبا", True), (tx.is_rtl, "hello", False), (tx.has_equation, "a $x$ b", True), (tx.has_table, "|a|\n|b|\n|c|", True), (tx.caption_ok, "I cannot see it", False), (tx.caption_ok, "A chart of sales", True), (tx.out_of_memory, "CUDA out of memory", True), (tx.job_id_ok, "job-0123abcd", True)])
def test_predicates(spark, f, given, wanted):
    assert one(spark, f(F.col("t")), t=given) is wanted


@pytest.mark.parametrize(("a", "b", "wanted"), [((0.0, 0.0, 1.0, 1.0), (0.0, 0.0, 1.0, 1.0), 1.0), ((0.0, 0.0, 1.0, 1.0), (2.0, 2.0, 3.0, 3.0), 0.0), ((0.0, 0.0, 0.0, 0.0), (0.0, 0.0, 0.0, 0.0), 0.0), ((0.0, 0.0, 2.0, 1.0), (1.0, 0.0, 3.0, 1.0), 1 / 3)])
def test_iou(spark, a, b, wanted):
    assert one(spark, geometry.iou(F.col("a"), F.col("b")), a=a, b=b) == pytest.approx(wanted)


def test_greedy_dedup_equals_a_fold(spark):
    draw = random.Random(5)
    rows = []
    for page in range(8):
        for k in range(14):
            x, y = draw.randint(0, 3), draw.randint(0, 3)
            rows.append((1, page, draw.choice("ab"), k, "paragraph", "t", (float(x), float(y), x + draw.choice([2.0, 2.1]), y + 2.0), draw.choice([0.5, 0.9])))
    df = spark.createDataFrame(rows, f"doc_id int, page int, provider string, ord int, type string, text string, box {BOX}, confidence double")
    got = {(r["page"], r["ord"]) for r in merge.drop_overlapping(df).collect()}

    def iou(p, q):
        w, h = min(p[2], q[2]) - max(p[0], q[0]), min(p[3], q[3]) - max(p[1], q[1])
        shared = max(w, 0) * max(h, 0)
        return shared / ((p[2] - p[0]) * (p[3] - p[1]) + (q[2] - q[0]) * (q[3] - q[1]) - shared)

    wanted = set()
    for page in range(8):
        kept = []
        for r in sorted((r for r in rows if r[1] == page), key=lambda r: (-r[7], r[2], r[3])):
            if all(iou(r[6], k[6]) <= 0.8 for k in kept):
                kept.append(r)
        wanted |= {(page, r[3]) for r in kept}
    assert got == wanted


def test_heading_clamp_equals_a_fold(spark):
    draw = random.Random(3)
    rows = [(d, k, draw.randint(1, 6)) for d in range(20) for k in range(12)]
    got = {(r["doc_id"], r["ord"]): r["clamped"] for r in render.clamp_headings(spark.createDataFrame(rows, "doc_id int, ord int, level int")).collect()}
    for d in range(20):
        before = 6
        for _, k, level in (r for r in rows if r[0] == d):
            before = min(level, before + 1)
            assert got[d, k] == before


def test_line_clusters_compare_with_the_lines_first_word(spark):
    words = [(1, 1, 0.0, 0.0, "a"), (1, 1, 4.0, 1.0, "b"), (1, 1, 8.0, 2.0, "c"), (1, 1, 12.0, 0.0, "d")]
    got = [(r["line"], r["text"]) for r in enrich.line_clusters(spark.createDataFrame(words, "doc_id int, page int, top double, x0 double, text string")).orderBy("line").collect()]
    assert got == [(0, "a b"), (1, "c d")]


def test_word_lines_of_all_pages(spark, tmp_path):
    texts = {1: "\n".join(f"w{k}  x{k} y" for k in range(45)), 2: "one line", 3: "\n" * 25 + " late words ", 4: None}
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    want = []
    for d, text in texts.items():
        held = [(k // 20 + 1, t.split()) for k, t in enumerate((text or "").split("\n")) if t.strip()]
        for page in {p for p, _ in held}:
            want += [(d, page, i, " ".join(w)) for i, w in enumerate(w for p, w in held if p == page)]
    got = catalog.word_lines(spark, str(tmp_path)).select("doc_id", "page", "line", "text").collect()
    assert sorted(map(tuple, got)) == sorted(want)
    assert {r["page"] for r in got} == {1, 2, 3}


def test_texts_are_beautified(spark):
    rows = [(1, "# Title\n#### Deep\nText\ngoes on\n\n\n\nR & C\ufffd"), (2, "a $  x$ \n"), (3, None), (4, "## A\n# B\n##### C\n###### D")]
    got = {r["doc_id"]: r["markdown"] for r in render.beautify(spark.createDataFrame(rows, "doc_id int, markdown string")).collect()}
    assert got == {1: "# Title\n## Deep\nText goes on\n\nR & C\n", 2: "a $ x$ ", 3: None, 4: "## A\n# B\n## C\n### D\n"}


def test_chains_follow_what_is_available(spark):
    got = {(r["type"], r["pos"]): r["provider"] for r in route.chains(spark, available=["markitdown"], override={"code": ["own"]}).collect()}
    assert got["table", 0] == "markitdown" and got["paragraph", 0] == "markitdown" and got["code", 0] == "markitdown" and ("paragraph", 1) not in got
    assert {r["provider"] for r in route.chains(spark, available=["none of them"]).collect()} == {"marker"}
    assert route.chains(spark, override={"code": ["own"]}).where("type = 'code'").first()["score"] == 0.5


def test_regions_take_the_first_provider_of_their_chain(spark):
    matched = spark.createDataFrame([(1, 1, 0, "a", 0), (1, 1, 0, "b", 1), (1, 1, 1, "a", 2), (1, 1, 1, "z", 3)], "doc_id int, page int, region int, provider string, ord int")
    plan = spark.createDataFrame([(1, 1, 0, "b", ["a", "b"]), (1, 1, 1, "b", ["a", "b"])], "doc_id int, page int, region int, best string, chain array<string>")
    assert {(r["region"], r["provider"]) for r in merge.first_in_chain(matched, plan).collect()} == {(0, "b"), (1, "a")}


def test_chains(spark):
    heads = {r["type"]: r["provider"] for r in route.chains(spark).where("pos = 0").collect()}
    assert (heads["equation"], heads["table"], heads["paragraph"]) == ("mineru", "docling", "marker")
    bare = {r["type"]: r["provider"] for r in route.chains(spark, gpu=False).where("pos = 0").collect()}
    assert (bare["paragraph"], bare["table"]) == ("markitdown", "docling")


def test_shards_round_trip_and_empty_values(spark):
    df = spark.createDataFrame([(1, bytearray(bytes(range(256)) * 10)), (2, bytearray())], "key int, content binary")
    cut = state.shards(df, 400)
    assert cut.where("key = 1").count() == 7
    assert {r["key"]: bytes(r["content"]) for r in state.reassemble(cut).collect()} == {1: bytes(range(256)) * 10, 2: b""}


def test_assets_are_stored_once(spark):
    assets, links = state.asset_store(spark.createDataFrame([(1, "x"), (2, "x"), (3, "y")], "block_id int, content string"))
    assert (assets.count(), links.count()) == (2, 3)


def test_cache_keeps_the_newest(spark):
    df = spark.sql("SELECT id AS key, timestamp'2024-01-01' + make_interval(0, 0, 0, 0, cast(id * 5 AS int)) AS mtime FROM range(40)")
    assert {r["key"] for r in state.evict(df, 7).collect()} == set(range(33, 40))


def test_metrics(spark):
    assert one(spark, metrics.character_fidelity(F.col("a"), F.col("b")), a="abcd", b="abXd") == 0.75
    assert one(spark, metrics.line_order(F.col("a"), F.col("b")), a="x\ny", b="x\nz") == 0.5


def test_html_survives_unclosed_elements_and_scripts():
    page = '<title>T &amp; U</title><script>var t="</p>";</script><nav><ul><li>menu</li></ul></nav><p><b>one<br>two<p>three<!-- no --><footer>end</footer>'
    assert html.parse(page) == [("heading", "T & U"), ("header", "menu"), ("paragraph", "one two"), ("paragraph", "three"), ("footer", "end")]


def test_stream_counts_equal_the_batch(spark, sf_dir, tmp_path):
    stream = events.windowed_counts(events.read_events(spark, f"{sf_dir}/events.parque[t]"))
    q = stream.writeStream.format("memory").queryName("counts").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    batch = spark.read.parquet(f"{sf_dir}/events.parquet").count()
    assert spark.table("counts").agg(F.sum("n")).first()[0] == batch


def test_files_round_trip(spark, tmp_path):
    from quireflow.sources import files

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.md").write_text("# A\n\nb")
    (tmp_path / "in" / "b.pdf").write_bytes(b"%PDF-1.7 x")
    (tmp_path / "in" / "c.pdf").write_bytes(b"no")
    assert files.read_texts(spark, str(tmp_path / "in")).first()["text"] == "# A\n\nb"
    assert sorted((r["length"], r["ok"]) for r in files.read_binary(spark, str(tmp_path / "in")).collect()) == [(2, False), (10, True)]
    pages = spark.createDataFrame([(1, 1, "x"), (1, 2, "y"), (2, 1, "z")], "doc_id long, page int, markdown string")
    files.write_pages(pages, str(tmp_path / "pages"))
    files.write_pages(pages, str(tmp_path / "pages"))
    assert spark.read.json(str(tmp_path / "pages")).count() == 3
    rows = spark.createDataFrame([("ab12", "e", 0, "p"), ("cd34", "e", 0, "")], "file_hash string, engine string, page_limit int, payload string")
    files.cache_put(str(tmp_path / "cache"), rows)
    assert [r["file_hash"] for r in files.cache_miss(rows, spark.read.parquet(str(tmp_path / "cache"))).collect()] == ["cd34"]


def test_layout_json_tolerates_bad_rows(spark):
    from quireflow.operators import layout

    rows = [(1, '{"page_number": 3, "segments": [{"block_type": "table", "bbox": [10, 60, 400, 200]}, {"block_type": "odd", "bbox": [5, 5, 1, 1], "confidence": 0.5}, {"bbox": [1, 2]}, {"bbox": [1, 1, 1.5, 9]}]}'), (2, "no json"), (3, None)]
    got = layout.parse_layout(spark.createDataFrame(rows, "doc_id long, layout string")).orderBy("seg").collect()
    assert [(r["page"], r["type"], r["confidence"], r["box"]["x0"]) for r in got] == [(3, "table", 0.82, 10.0), (3, "paragraph", 0.5, 1.0)]


def test_alignment_moves_forward(spark):
    from quireflow.operators import layout

    paragraphs = spark.createDataFrame([(1, 0, "alpha beta"), (1, 1, "gamma delta"), (1, 2, "???"), (1, 3, "alpha")], "doc_id long, idx long, text string")
    pages = spark.createDataFrame([(1, 1, "alpha beta"), (1, 2, "gamma delta"), (1, 3, "omega")], "doc_id long, page int, text string")
    assert [r["page"] for r in layout.align_paragraphs(paragraphs, pages).orderBy("idx").collect()] == [1, 2, 2, 2]


def test_stream_job_states_equal_the_batch(spark, sf_dir):
    source = events.read_events(spark, f"{sf_dir}/events.parque[t]")
    q = events.job_states(source).writeStream.format("memory").queryName("states").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    batch = {(r["job"], r["status"]) for r in state.latest_jobs(spark.read.parquet(f"{sf_dir}/events.parquet")).collect()}
    assert {(r["job"], r["status"]) for r in spark.table("states").collect()} == batch


def test_stream_writes_once_over_a_restart(spark, sf_dir, tmp_path):
    for _ in range(2):
        stream = events.unique_events(events.read_events(spark, f"{sf_dir}/events.parque[t]"))
        events.run_to_table(stream.select("event_id", "event_type"), str(tmp_path / "out"), str(tmp_path / "check"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == spark.read.parquet(f"{sf_dir}/events.parquet").count()


def test_sessions_cover_all_events(spark, sf_dir):
    batch = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("at", F.col("ts").cast("timestamp"))
    assert events.activity(batch).agg(F.sum("n")).first()[0] == batch.count()


def test_divided_pages_by_hand(spark):
    rows = [
        (1, "a\n---\nb\n---\nc", 2),  # enough marks: further parts are left out
        (2, "a\fb\n---\nc", 2),  # form feeds come first
        (3, "aaaa\nbb\ncc\ndddd", 3),  # 14 characters: a page is full at four
        (4, "one line", 3),
        (5, "", 3),
        (6, "x\n\n", 5),
        (7, "y", 0),
        (8, "z", None),
        (9, None, 2),
    ]
    found = {(r["doc_id"], r["page"]): r["markdown"] for r in render.divide_pages(spark.createDataFrame(rows, "doc_id long, markdown string, pages int")).collect()}
    assert found == {
        (1, 1): "a", (1, 2): "b", (2, 1): "a", (2, 2): "b\n---\nc", (3, 1): "aaaa", (3, 2): "bb\ncc", (3, 3): "dddd",
        (4, 1): "one line", (5, 1): "", (6, 1): "x", (6, 2): "", (6, 3): "",
    }


def test_marked_pages_leave_out_empty_ones(spark):
    mark = "\n" + "-" * 48 + "\n"
    rows = [(1, f"{mark} a {mark}{mark}b\n---\nc"), (2, ""), (3, None)]
    found = [tuple(r) for r in render.split_pages(spark.createDataFrame(rows, "doc_id long, markdown string")).orderBy("page").collect()]
    assert found == [(1, 1, "a"), (1, 2, "b\n---\nc")]


def test_shards_are_verified_part_by_part(spark):
    listed = spark.createDataFrame([(k, p, 1, "ca978112ca1bbdcafac231b39a23dc4da786eff8147c4e72b9807785afee48bb") for k in (1, 2, 3, 4) for p in (0, 1)], "key long, part int, bytes long, sha256 string")
    a, b = bytearray(b"a"), bytearray(b"b")
    parts = spark.createDataFrame([(1, 0, a), (1, 1, a), (2, 0, a), (3, 0, a), (3, 1, b), (4, 0, a), (4, 1, a), (4, 2, a), (5, 0, a)], "key long, part int, content binary")
    assert {r["key"]: r["intact"] for r in state.verify_shards(parts, listed).collect()} == {1: True, 2: False, 3: False, 4: False, 5: False}
