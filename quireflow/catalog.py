"""Registry of the engine's queries and of the SQL that they are held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .functions import classify, config, geometry
from .functions import text as tx
from .operators import enrich, layout, merge, metrics, models, profile, progress, relations, render, route, state
from .operators.relations import table
from .plans import convert
from .sources import html

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function (spark, sf_dir) under its name, with the SQL for the same rows."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relations.line_blocks(docs(spark, sf_dir))


def report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relations.report_lines(spark, sf_dir)


# --- parts of the SQL ---------------------------------------------------------------------------------------------

MD_TYPE = r"""CASE WHEN starts_with(trim({t}), '#') THEN 'heading' WHEN starts_with(trim({t}), '$$') OR starts_with(trim({t}), '\[') THEN 'equation'
  WHEN starts_with(trim({t}), '```') THEN 'code' WHEN starts_with(trim({t}), '|') AND contains(substr(trim({t}), 2), '|') THEN 'table' WHEN starts_with(trim({t}), '![') THEN 'figure'
  WHEN starts_with(trim({t}), '- ') OR starts_with(trim({t}), '* ') OR regexp_matches(trim({t}), '^\d+\.') THEN 'list' ELSE 'paragraph' END"""
LINES = f"""raw AS (SELECT doc_id, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS idx, unnest(string_split(coalesce(text, ''), chr(10))) AS text FROM documents),
lines AS (
  SELECT doc_id, (idx // 20 + 1)::INT AS page, idx AS ord, {MD_TYPE.format(t="text")} AS type, text, 0.0::DOUBLE AS x0, (idx % 20 * 50)::DOUBLE AS y0, 612.0::DOUBLE AS x1, (idx % 20 * 50 + 50)::DOUBLE AS y1
  FROM raw WHERE trim(text) <> ''
)"""
REPORT = """report AS (
  SELECT n_nationkey::BIGINT AS doc_id, 0::BIGINT AS ord, '# ' || n_name AS text FROM nation
  UNION ALL SELECT n_nationkey, 1, 'The nation ' || n_name || ' lies in region ' || n_regionkey || '.' FROM nation
  UNION ALL SELECT s_nationkey, s_suppkey + 10, '- ' || s_name FROM supplier
  UNION ALL SELECT p_partkey % 25, p_partkey * 6 + 1000000, '### ' || p_name FROM part
  UNION ALL SELECT p_partkey % 25, p_partkey * 6 + 1000001, '| ' || p_brand || ' | x |' FROM part
  UNION ALL SELECT p_partkey % 25, p_partkey * 6 + 1000002, '$$' || p_size || '$$' FROM part
  UNION ALL SELECT p_partkey % 25, p_partkey * 6 + 1000003, '![' || p_name || '](part.png)' FROM part
  UNION ALL SELECT p_partkey % 25, p_partkey * 6 + 1000004, '```' || p_type || '```' FROM part
  UNION ALL SELECT p_partkey % 25, p_partkey * 6 + 1000005, p_size || '. item' FROM part
)"""
REGION_TYPE = r"""CASE WHEN trim({t}) = '' THEN 'paragraph' WHEN starts_with(trim({t}), '#') OR (length(trim({t})) < 80 AND regexp_matches(trim({t}), '^\p{{Lu}}') AND NOT ends_with(trim({t}), '.')) THEN 'heading'
  WHEN regexp_matches(trim({t}), '[∑∫∂∇≈≠±∞αβγδεθλμσωπΣΔΩ]') OR contains(trim({t}), '$$') OR contains(trim({t}), '\[') OR regexp_matches(trim({t}), '\\\\(frac|int|sum)|E\s*=\s*mc') THEN 'equation'
  WHEN starts_with(trim({t}), '- ') OR starts_with(trim({t}), '* ') OR regexp_matches(trim({t}), '^\d+\.\s') THEN 'list' WHEN starts_with(trim({t}), '```') THEN 'code' ELSE 'paragraph' END"""
REGIONS = f"""numbered AS (SELECT *, ((row_number() OVER (PARTITION BY doc_id, page ORDER BY ord) - 1) // 5)::INT AS region FROM lines),
regions AS (
  SELECT doc_id, page, region, {REGION_TYPE.format(t="first_text")} AS type, x0, y0, x1, y1, blocks
  FROM (SELECT doc_id, page, region, arg_min(text, ord) AS first_text, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1, count(*) AS blocks FROM numbered GROUP BY ALL)
)"""
#: A block's clean text; NFKC stands in for by NFC, which is the same on the tables' texts.
ARTEFACTS = r"""replace(replace(replace(replace(replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(nfc_normalize(replace({t}, chr(65533), '')), '[\x{{200b}}-\x{{200f}}\x{{202a}}-\x{{202e}}\x{{2060}}\x{{feff}}\x{{ad}}]', '', 'g'), '(?i)<sup>\s*&(?:amp;)?\s*</sup>', '', 'g'), '(?i)<sup>\s*</sup>', '', 'g'), '(?i)<sub>\s*</sub>', '', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&')"""
CLEAN = r"regexp_replace(regexp_replace({a}, '[ \t]{{{{2,}}}}', ' ', 'g'), '^\s+|\s+$', '', 'g')".format(a=ARTEFACTS)
_T = CLEAN.format(t="text")
BLOCK_MD = rf"""CASE WHEN type IN ('header', 'footer') THEN NULL
  WHEN type = 'heading' THEN repeat('#', CASE WHEN regexp_matches({_T}, '^#{{1,6}}\s') THEN length(regexp_extract({_T}, '^(#{{1,6}})\s', 1)) ELSE 2 END::INT) || ' ' || regexp_replace({_T}, '^#{{1,6}}\s*', '')
  WHEN type = 'equation' THEN CASE WHEN starts_with({_T}, '$$') AND ends_with({_T}, '$$') THEN {_T} ELSE '$$' || chr(10) || {_T} || chr(10) || '$$' END
  WHEN type = 'code' THEN '```' || chr(10) || text || chr(10) || '```' WHEN type = 'caption' THEN '*' || {_T} || '*' ELSE {_T} END"""
SIGNALS = r"""pages_ AS (SELECT doc_id, page, string_agg(text, chr(10) ORDER BY ord) AS text FROM lines GROUP BY ALL),
signals AS (
  SELECT doc_id, page, length(trim(text)) > 0 AS has_text, CASE WHEN length(trim(text)) > 0 THEN least(length(text) / 8000.0::DOUBLE, 1.0) ELSE 0.0 END AS density,
    (len(regexp_extract_all(text, '\$')) >= 2 OR len(list_filter(['\frac', '\int', '\sum', '\prod', '\lim', '\alpha', '\beta', '\gamma', '\delta', '\theta', '\partial', '\nabla', '\infty', '\sqrt'], lambda m: contains(text, m))) > 0) AS equations,
    (len(list_filter(string_split(text, chr(10)), lambda x: len(regexp_extract_all(x, '\|')) >= 2)) >= 3 OR len(list_filter(string_split(text, chr(10)), lambda x: len(regexp_extract_all(x, '\t')) >= 2)) >= 3) AS tables, length(text) AS chars
  FROM pages_
)"""


# --- scans and scalar functions -----------------------------------------------------------------------------------


@query(f"WITH {LINES} SELECT doc_id, page, ord, type, text, y0, y1 FROM lines")
def scan_lines(spark, d):
    return lines(spark, d).select("doc_id", "page", "ord", "type", "text", F.col("box.y0").alias("y0"), F.col("box.y1").alias("y1"))


@query()
def scan_html(spark, d):
    return html.html_blocks(table(spark, d, "pages"))


@query(rf"WITH {REPORT} SELECT doc_id, ord, {MD_TYPE.format(t='text')} AS type FROM report")
def classify_markdown(spark, d):
    return report(spark, d).select("doc_id", "ord", classify.markdown_type(F.col("text")).alias("type"))


@query(rf"""WITH {REPORT} SELECT doc_id, ord, CASE WHEN starts_with(text, '$$') OR starts_with(text, '\[') THEN 'equation' WHEN starts_with(text, '#') THEN 'heading'
  WHEN starts_with(text, '|') AND contains(substr(text, 2), '|') THEN 'table' WHEN starts_with(text, '![') THEN 'figure' WHEN starts_with(text, '- ') OR starts_with(text, '* ') THEN 'list' ELSE 'paragraph' END AS type FROM report""")
def classify_list_engine(spark, d):
    return report(spark, d).select("doc_id", "ord", classify.list_type(F.col("text")).alias("type"))


@query(rf"WITH {REPORT} SELECT doc_id, ord, {REGION_TYPE.format(t='text')} AS type FROM report")
def classify_regions(spark, d):
    return report(spark, d).select("doc_id", "ord", classify.region_type(F.col("text")).alias("type"))


def _values(names) -> str:
    return ", ".join("('" + "', '".join(x) + "')" for x in names)


_NAMES = [*classify.ENGINE_TYPES, *classify.LABELS, "Section-Header", "list-item-marker", "pagefooter", "blob", "PAGE-HEADER", "text_figure", "other"]


def _names(spark, d):
    """Names of types by row, so that every known one and some unknown ones occur."""
    names = F.array(*map(F.lit, _NAMES))
    return table(spark, d, "events").select("event_id", F.get(names, F.pmod("event_id", F.lit(len(_NAMES))).cast("int")).alias("name"))


_NAMES_SQL = f"names AS (SELECT event_id, {_NAMES}[event_id % {len(_NAMES)} + 1] AS name FROM events)"


@query(f"""WITH {_NAMES_SQL}, known(name, type) AS (VALUES {_values(classify.ENGINE_TYPES.items())})
SELECT event_id, n.name, coalesce(k.type, 'paragraph') AS type, CASE WHEN n.name IN ({", ".join(f"'{x}'" for x in classify.BLOCK_TYPES)}) THEN n.name ELSE 'other' END AS adapted FROM names n LEFT JOIN known k ON k.name = lower(n.name)""")
def classify_engine_types(spark, d):
    own = _names(spark, d)
    return own.select("event_id", "name", classify.engine_type(F.col("name")).alias("type"), classify.adapted_type(F.col("name")).alias("adapted"))


@query(f"""WITH {_NAMES_SQL}, known(part, type, k) AS (VALUES {", ".join(f"('{p}', '{t}', {k})" for k, (p, t) in enumerate(classify.LABELS.items()))})
SELECT event_id, coalesce((SELECT arg_min(type, k) FROM known WHERE contains(replace(lower(name), '-', '_'), part)), 'paragraph') AS type FROM names""")
def classify_labels(spark, d):
    return _names(spark, d).select("event_id", classify.label_type(F.col("name")).alias("type"))


@query(rf"""WITH {REPORT}, t AS (SELECT doc_id, ord, text, ['text', 'image', 'interline_equation', 'table', NULL][(ord % 5 + 1)::INT] AS kind FROM report)
SELECT doc_id, ord, CASE coalesce(kind, 'text') WHEN 'image' THEN 'figure' WHEN 'interline_equation' THEN 'equation' WHEN 'table' THEN 'table' ELSE
  CASE WHEN starts_with(text, '$$') OR starts_with(text, '\[') THEN 'equation' WHEN starts_with(text, '#') THEN 'heading' WHEN starts_with(text, '|') AND contains(substr(text, 2), '|') THEN 'table' WHEN starts_with(text, '![') THEN 'figure'
  WHEN starts_with(text, '- ') OR starts_with(text, '* ') THEN 'list' ELSE 'paragraph' END END AS type FROM t""")
def classify_content_list(spark, d):
    kinds = F.array(*map(F.lit, ["text", "image", "interline_equation", "table", None]))
    own = report(spark, d).withColumn("kind", F.get(kinds, (F.col("ord") % 5).cast("int")))
    return own.select("doc_id", "ord", classify.content_type(F.col("kind"), F.col("text")).alias("type"))


@query(rf"""WITH {REPORT} SELECT doc_id, ord, 'h' || CASE WHEN regexp_matches(text, '^#{{1,6}}\s') THEN length(regexp_extract(text, '^(#{{1,6}})\s', 1)) ELSE 2 END AS level, regexp_replace(text, '^#{{1,6}}\s*', '') AS title FROM report""")
def heading_levels(spark, d):
    return report(spark, d).select("doc_id", "ord", tx.heading_level(F.col("text")).alias("level"), tx.heading_text(F.col("text")).alias("title"))


@query(r"""SELECT doc_id, len(regexp_extract_all(text, '\$')) >= 2 OR len(list_filter(['\frac', '\int', '\sum', '\prod', '\lim', '\alpha', '\beta', '\gamma', '\delta', '\theta', '\partial', '\nabla', '\infty', '\sqrt'], lambda m: contains(text, m))) > 0 AS equations,
  (len(list_filter(string_split(text, chr(10)), lambda x: len(regexp_extract_all(x, '\|')) >= 2)) >= 3 OR len(list_filter(string_split(text, chr(10)), lambda x: len(regexp_extract_all(x, '\t')) >= 2)) >= 3) AS tables,
  regexp_matches(text, '[∑∫∂∇≈≠±∞αβγδεθλμσωπΣΔΩ]') OR contains(text, '$$') OR contains(text, '\[') OR regexp_matches(text, '\\\\(frac|int|sum)|E\s*=\s*mc') AS math FROM documents""")
def text_signals(spark, d):
    t = F.col("text")
    return docs(spark, d).select("doc_id", tx.has_equation(t).alias("equations"), tx.has_table(t).alias("tables"), tx.has_math(t).alias("math"))


@query(r"""SELECT doc_id, CASE WHEN len(regexp_extract_all(substr(text, 1, 2000), '[çğıöşüÇĞİÖŞÜ]')) > 5 THEN 'tr'
  WHEN len(regexp_extract_all(substr(text, 1, 2000), '\p{L}')) > 0 AND len(regexp_extract_all(substr(text, 1, 2000), '[A-Za-z]')) > 0.9 * len(regexp_extract_all(substr(text, 1, 2000), '\p{L}')) THEN 'en' END AS language,
  round(len(regexp_extract_all(text, '[A-Za-z]')) / nullif(length(text), 0), 3) AS latin FROM documents""")
def languages(spark, d):
    return docs(spark, d).select("doc_id", tx.language(F.col("text")).alias("language"), tx.latin_share(F.col("text")).alias("latin"))


@query(r"SELECT doc_id, unnest(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]{3,}'))) AS word FROM documents")
def word_sets(spark, d):
    return docs(spark, d).select("doc_id", F.explode(tx.word_set(F.col("text"))).alias("word"))


@query(r"""SELECT doc_id, rtrim_ || chr(10) AS text FROM (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(text, '\n{3,}', chr(10) || chr(10), 'g'), '[ \t]+(\n|$)', '\1', 'g'), '^\s+|\s+$', '', 'g') AS rtrim_ FROM documents)""")
def whitespace_fixed(spark, d):
    return docs(spark, d).select("doc_id", tx.fix_whitespace(F.col("text")).alias("text"))


@query(r"SELECT doc_id, regexp_replace(regexp_replace(text, '\$\s+', '$ ', 'g'), '\s+\$', ' $', 'g') AS text FROM documents")
def latex_sanitized(spark, d):
    return docs(spark, d).select("doc_id", tx.sanitize_latex(F.col("text")).alias("text"))


@query()
def cleaned_texts(spark, d):
    t = F.col("text")
    return docs(spark, d).select("doc_id", tx.clean_text(t).alias("text"), tx.composed_form(t).alias("composed"), tx.is_rtl(t).alias("rtl"))


@query(r"SELECT event_id, CASE WHEN value IS NULL OR value < 0 THEN '??:??' WHEN floor(value * 100) >= 3600 THEN (floor(value * 100)::BIGINT // 3600) || ':' || lpad(((floor(value * 100)::BIGINT // 60) % 60)::VARCHAR, 2, '0') || ':' || lpad((floor(value * 100)::BIGINT % 60)::VARCHAR, 2, '0') ELSE lpad(((floor(value * 100)::BIGINT // 60) % 60)::VARCHAR, 2, '0') || ':' || lpad((floor(value * 100)::BIGINT % 60)::VARCHAR, 2, '0') END AS shown FROM events")
def durations(spark, d):
    return table(spark, d, "events").select("event_id", tx.duration(F.col("value") * 100).alias("shown"))


@query(r"""SELECT page_id, CASE WHEN n = '' THEN 'input.pdf' ELSE n END AS name FROM (SELECT page_id, substr(regexp_replace(regexp_extract(url, '([^/\\]*)$', 1), '[^\p{L}\p{N}._-]', '', 'g'), 1, 200) AS n FROM pages)""")
def safe_names(spark, d):
    return table(spark, d, "pages").select("page_id", tx.safe_name(F.col("url")).alias("name"))


@query(r"""SELECT conv_id, turn, length(text) >= 10 AND len(regexp_extract_all(text, '\S+')) >= 3 AND NOT (starts_with(lower(text), 'i cannot') OR starts_with(lower(text), 'i can''t') OR starts_with(lower(text), 'sorry') OR starts_with(lower(text), 'as an ai')) AS ok FROM conversations""")
def captions_ok(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", tx.caption_ok(F.col("text")).alias("ok"))


# --- profiles and layout ------------------------------------------------------------------------------------------


@query(f"WITH {LINES}, {SIGNALS} SELECT doc_id, page, has_text, density, equations, tables, chars FROM signals")
def page_signals(spark, d):
    return relations.page_signals(docs(spark, d)).drop("language", "columns")


@query(f"""WITH {LINES}, {SIGNALS}, p AS (
  SELECT doc_id, count(*) AS pages, bool_or(equations) AS math, bool_or(tables) AS tables, count(*) FILTER (NOT has_text) > 0.5 * count(*) AS scanned, false AS multi_column FROM signals GROUP BY doc_id)
SELECT *, CASE WHEN math AND tables THEN 'academic' WHEN tables THEN 'tabular' WHEN math THEN 'scientific' WHEN scanned THEN 'scanned' ELSE 'text-heavy' END AS dominant FROM p""")
def document_profiles(spark, d):
    return profile.document_profile(relations.page_signals(docs(spark, d))).drop("complexity")


@query(f"""WITH {LINES}, {SIGNALS} SELECT doc_id, least(sum((density + CASE WHEN equations THEN 0.2::DOUBLE ELSE 0.0 END + CASE WHEN tables THEN 0.2::DOUBLE ELSE 0.0 END)::DECIMAL(20, 10))::DOUBLE / count(*), 1) AS complexity FROM signals GROUP BY doc_id""")
def document_complexity(spark, d):
    return profile.document_profile(relations.page_signals(docs(spark, d))).select("doc_id", "complexity")


@query(f"WITH {LINES}, {SIGNALS} SELECT doc_id, avg(CASE WHEN chars > 50 THEN 1.0 ELSE 0.0 END) >= 0.6 AS text_layer FROM signals WHERE page <= 3 GROUP BY doc_id")
def text_layers(spark, d):
    return profile.has_text_layer(relations.page_signals(docs(spark, d)))


@query(f"WITH {LINES}, {REGIONS} SELECT doc_id, page, region, type, x0, y0, x1, y1, blocks FROM regions")
def page_regions(spark, d):
    return relations.regions(lines(spark, d)).select("doc_id", "page", "region", "type", "box.*", "blocks")


@query(f"""WITH {LINES}, {REGIONS} SELECT doc_id, page, round(greatest(0.0, least(1.0, least(1.0, 0.08::DOUBLE * count(*)) + CASE WHEN bool_or(type IN ('table', 'figure')) THEN 0.12::DOUBLE ELSE 0.0 END
  - least(0.4::DOUBLE, 0.05::DOUBLE * count(*) FILTER (x0 < -10 OR y0 < -10 OR x1 > 622 OR y1 > 1010 OR x1 <= x0 OR y1 <= y0)))), 6) AS quality FROM regions GROUP BY ALL""")
def layout_quality(spark, d):
    return profile.layout_quality(relations.regions(lines(spark, d)))


# --- routing ------------------------------------------------------------------------------------------------------


def _chains_sql(gpu: bool) -> str:
    rows = []
    for kind, chain in route.CHAINS.items():
        own = [p for p in chain if gpu or p not in route.GPU] or chain
        rows += [f"('{kind}', {k}, '{p}', {route.SCORES[p][kind]}::DOUBLE)" for k, p in enumerate(own)]
    return f"chains(type, pos, provider, score) AS (VALUES {', '.join(rows)}), best AS (SELECT type, arg_max(provider, score * 100 - pos * 0.001) AS best, max(score) AS score, string_agg(provider, ',' ORDER BY pos) AS chain FROM chains GROUP BY type)"


@query(f"WITH {LINES}, {REGIONS}, {_chains_sql(True)} SELECT doc_id, page, region, type, best, score, chain FROM regions JOIN best USING (type)")
def routed_regions(spark, d):
    return convert.routing_plan(docs(spark, d)).select("doc_id", "page", "region", "type", "best", "score", F.array_join("chain", ",").alias("chain"))


@query(f"WITH {LINES}, {REGIONS}, {_chains_sql(False)} SELECT doc_id, page, region, type, best, score, chain FROM regions JOIN best USING (type)")
def routed_without_gpu(spark, d):
    return convert.routing_plan(docs(spark, d), gpu=False).select("doc_id", "page", "region", "type", "best", "score", F.array_join("chain", ",").alias("chain"))


@query(f"WITH {LINES}, {REGIONS}, {_chains_sql(True)} SELECT DISTINCT doc_id, page, provider FROM regions JOIN chains USING (type)")
def providers_needed(spark, d):
    return route.providers_needed(convert.routing_plan(docs(spark, d)))


@query(f"WITH {LINES}, {REGIONS}, {_chains_sql(True)} SELECT best AS provider, doc_id, count(DISTINCT page) AS pages FROM regions JOIN best USING (type) GROUP BY ALL")
def provider_pages(spark, d):
    return route.provider_pages(convert.routing_plan(docs(spark, d)))


@query(f"WITH {LINES}, {REGIONS}, {_chains_sql(True)} SELECT DISTINCT doc_id, page, provider FROM regions JOIN best USING (type) JOIN chains USING (type) WHERE best.score < 0.92 AND pos BETWEEN 1 AND 3 AND provider NOT IN ('marker', 'opendataloader')")
def second_pass(spark, d):
    return route.second_pass(convert.routing_plan(docs(spark, d)), 0.92)


@query(f"""WITH {LINES}, {REGIONS}, {_chains_sql(True)}, p AS (SELECT DISTINCT best AS provider, doc_id, page FROM regions JOIN best USING (type)),
r AS (SELECT *, page - row_number() OVER (PARTITION BY provider, doc_id ORDER BY page) AS run FROM p) SELECT provider, doc_id, min(page) AS first, max(page) AS last FROM r GROUP BY provider, doc_id, run""")
def page_ranges(spark, d):
    return route.page_ranges(convert.routing_plan(docs(spark, d)).select(F.col("best").alias("provider"), "doc_id", "page"))


# --- matching, de-duplication, order, rendering -------------------------------------------------------------------

PAIRS = f"""steps AS (SELECT *, idx - idx % CASE WHEN (idx // 20 + 1) % 2 = 1 THEN 2 ELSE 1 END AS first FROM raw WHERE trim(text) <> ''),
pairs AS (
  SELECT doc_id, (first // 20 + 1)::INT AS page, first AS ord, string_agg(text, chr(10) ORDER BY idx) AS text, 0.0::DOUBLE AS x0, (first % 20 * 50)::DOUBLE AS y0, 612.0::DOUBLE AS x1, (max(idx) % 20 * 50 + 50)::DOUBLE AS y1
  FROM steps GROUP BY doc_id, first
), blocks AS (
  SELECT doc_id, page, ord, 'lines' AS provider, type, text, x0, y0, x1, y1, 0.85::DOUBLE AS confidence FROM lines
  UNION ALL SELECT doc_id, page, ord, 'paras', {MD_TYPE.format(t="text")}, text, x0, y0, x1, y1, 0.7 FROM pairs
)"""
MATCHED = """matched AS (
  SELECT r.region, r.type AS region_type, b.* FROM regions r JOIN blocks b ON r.doc_id = b.doc_id AND r.page = b.page
  WHERE (r.x1 - r.x0) * (r.y1 - r.y0) <= 0 OR greatest(least(b.x1, r.x1) - greatest(b.x0, r.x0), 0) * greatest(least(b.y1, r.y1) - greatest(b.y0, r.y0), 0) / ((b.x1 - b.x0) * (b.y1 - b.y0)) >= 0.3
)"""


def _blocks(spark, d):
    return lines(spark, d).unionByName(relations.pair_blocks(docs(spark, d)))


@query(f"WITH {LINES}, {REGIONS}, {PAIRS}, {MATCHED} SELECT doc_id, page, region, provider, ord FROM matched")
def match_blocks(spark, d):
    return merge.match_blocks(relations.regions(lines(spark, d)), _blocks(spark, d)).select("doc_id", "page", "region", "provider", "ord")


@query(f"""WITH {LINES}, {REGIONS}, {PAIRS}, {MATCHED} SELECT doc_id, page, region, provider, ord FROM matched
QUALIFY CASE provider WHEN 'paras' THEN 1 ELSE 2 END = min(CASE provider WHEN 'paras' THEN 1 ELSE 2 END) OVER (PARTITION BY doc_id, page, region)""")
def first_provider(spark, d):
    matched = merge.match_blocks(relations.regions(lines(spark, d)), _blocks(spark, d))
    return merge.first_provider(matched, ["paras", "lines"]).select("doc_id", "page", "region", "provider", "ord")


DEDUP = """ordered AS (SELECT doc_id, page, list({'provider': provider, 'ord': ord, 'y0': y0, 'y1': y1} ORDER BY confidence DESC, provider, ord) AS a FROM blocks GROUP BY ALL),
kept AS (
  SELECT doc_id, page, unnest(list_reduce(list_transform(a, lambda b: [b]), lambda acc, x: CASE WHEN len(list_filter(acc, lambda k:
    greatest(least(k.y1, x[1].y1) - greatest(k.y0, x[1].y0), 0) / ((k.y1 - k.y0) + (x[1].y1 - x[1].y0) - greatest(least(k.y1, x[1].y1) - greatest(k.y0, x[1].y0), 0)) > 0.8)) > 0 THEN acc ELSE list_concat(acc, x) END)) AS k FROM ordered
)"""


@query(f"WITH {LINES}, {PAIRS}, {DEDUP} SELECT doc_id, page, k.provider AS provider, k.ord AS ord FROM kept")
def drop_overlapping(spark, d):
    return merge.drop_overlapping(_blocks(spark, d)).select("doc_id", "page", "provider", "ord")


@query(f"""WITH {LINES}, {PAIRS}, {DEDUP} SELECT doc_id, page, k.provider AS provider, k.ord AS ord, row_number() OVER (PARTITION BY doc_id ORDER BY page, k.y0, k.provider, k.ord) - 1 AS reading_order FROM kept""")
def reading_order(spark, d):
    return merge.reading_order(merge.drop_overlapping(_blocks(spark, d))).select("doc_id", "page", "provider", "ord", "reading_order")


@query(f"WITH {LINES}, md AS (SELECT doc_id, page, ord, {BLOCK_MD} AS md FROM lines) SELECT doc_id, page, string_agg(md, chr(10) || chr(10) ORDER BY ord) || chr(10) AS markdown FROM md WHERE coalesce(md, '') <> '' GROUP BY ALL")
def page_markdown(spark, d):
    return convert.convert_lines(docs(spark, d))


@query()
def converted_pages(spark, d):
    return convert.convert_pages(docs(spark, d))


@query(f"WITH {REPORT}, t AS (SELECT *, {MD_TYPE.format(t='text')} AS type FROM report) SELECT doc_id, ord, {BLOCK_MD} AS markdown FROM t")
def render_report(spark, d):
    return report(spark, d).select("doc_id", "ord", render.block_markdown(classify.markdown_type(F.col("text")), F.col("text")).alias("markdown"))


@query("""SELECT p_partkey, CASE WHEN body = '' THEN '[Gorsel: ' || p_name || ']' ELSE body END AS markdown FROM (
  SELECT *, concat_ws(chr(10) || chr(10), CASE WHEN p_size % 3 > 0 THEN '![' || p_name || '](p.png)' END,
    CASE WHEN p_size % 2 = 0 THEN '*' || p_type || '*' WHEN p_size % 5 = 0 THEN '*[Figure context: ' || p_brand || ']*' END) AS body FROM part)""")
def render_figures(spark, d):
    size = F.col("p_size")
    figure = render.figure_markdown(F.lit(""), F.col("p_name"), F.when(size % 3 == 0, "").otherwise("p.png"), F.when(size % 2 == 0, F.col("p_type")).otherwise(""), F.when(size % 5 == 0, F.col("p_brand")).otherwise(""))
    return table(spark, d, "part").select("p_partkey", figure.alias("markdown"))


_FIXED = r"""regexp_replace(regexp_replace(regexp_replace({t}, '\n{{3,}}', chr(10) || chr(10), 'g'), '[ \t]+\n', chr(10), 'g'), '^\s+|\s+$', '', 'g') || chr(10)"""
_JOIN = r"regexp_replace({t}, '([^\n:.!?|])[^\S\n]*\n[^\S\n]*(\p{{Ll}})', '\1 \2', 'g')"


@query(f"SELECT doc_id, {_JOIN.format(t=_JOIN.format(t=_FIXED.format(t='text')))} AS text FROM documents")
def join_broken_lines(spark, d):
    return docs(spark, d).select("doc_id", tx.merge_broken_sentences(tx.fix_whitespace(F.col("text"))).alias("text"))


def _beautified(source: str, text: str) -> str:
    """CTEs that end in beauty (doc_id, markdown) of a relation's texts."""
    joined = _JOIN.format(t=_JOIN.format(t=_FIXED.format(t=ARTEFACTS.format(t=text))))
    return rf"""bt AS (SELECT doc_id, {joined} AS t FROM {source}),
bl AS (SELECT doc_id, unnest(range(len(string_split(t, chr(10))))) AS ord, unnest(string_split(t, chr(10))) AS line FROM bt),
bh AS (SELECT *, CASE WHEN regexp_matches(line || chr(10), '^#{{1,6}}\s') THEN length(regexp_extract(line || chr(10), '^(#{{1,6}})\s', 1)) END AS level FROM bl),
bc AS (SELECT *, count(level) OVER (PARTITION BY doc_id ORDER BY ord) AS rn FROM bh),
bm AS (SELECT *, min(level - rn) OVER (PARTITION BY doc_id ORDER BY ord) + rn AS clamped FROM bc),
bj AS (SELECT doc_id, string_agg(CASE WHEN level IS NULL THEN line ELSE repeat('#', clamped::INT) || substr(line, level + 1) END, chr(10) ORDER BY ord) AS t FROM bm GROUP BY doc_id),
beauty AS (SELECT doc_id, regexp_replace(regexp_replace(t, '\$\s+', '$ ', 'g'), '\s+\$', ' $', 'g') AS markdown FROM bj)"""


@query(f"WITH {_beautified('documents', 'text')} SELECT doc_id, markdown FROM beauty")
def beautified(spark, d):
    return render.beautify(docs(spark, d).select("doc_id", F.col("text").alias("markdown")))


@query(rf"""WITH {REPORT}, h AS (SELECT doc_id, ord, length(regexp_extract(text, '^(#{{1,6}})\s', 1)) AS level, row_number() OVER (PARTITION BY doc_id ORDER BY ord) AS rn FROM report WHERE regexp_matches(text, '^#{{1,6}}\s'))
SELECT doc_id, ord, level::INT AS level, (min(level - rn) OVER (PARTITION BY doc_id ORDER BY ord) + rn)::INT AS clamped FROM h""")
def clamp_headings(spark, d):
    heads = report(spark, d).where(F.col("text").rlike(r"^#{1,6}\s"))
    return render.clamp_headings(heads.select("doc_id", "ord", F.length(F.regexp_extract("text", r"^(#{1,6})\s", 1)).alias("level")))


def _split(text: str, mark: str) -> str:
    return f"unnest(range(len(string_split({text}, {mark})))) AS idx, unnest(string_split({text}, {mark})) AS text"


@query(f"""WITH {REPORT}, r AS (SELECT doc_id, string_agg(text, chr(10) || chr(10) ORDER BY ord) AS md FROM report GROUP BY doc_id) SELECT doc_id, idx, text FROM (SELECT doc_id, {_split("md", "chr(10) || chr(10)")} FROM r) WHERE trim(text) <> ''""")
def split_paragraphs(spark, d):
    whole = report(spark, d).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("ord", "text"))).alias("p"))
    return render.split_paragraphs(whole.select("doc_id", F.array_join(F.transform("p", lambda x: x["text"]), "\n\n").alias("markdown")))


# --- neighbours ---------------------------------------------------------------------------------------------------


@query(f"""WITH {LINES}, n AS (SELECT *, lag(type) OVER w AS bt, trim(lag(text) OVER w) AS b, lead(type) OVER w AS at_, trim(lead(text) OVER w) AS a FROM lines WINDOW w AS (PARTITION BY doc_id, page ORDER BY ord))
SELECT doc_id, page, ord, concat_ws(' [...] ', CASE WHEN bt NOT IN ('header', 'footer') AND b <> '' THEN substr(b, 1, 200) END, CASE WHEN at_ NOT IN ('header', 'footer') AND a <> '' THEN substr(a, 1, 200) END) AS context FROM n""")
def context_snippets(spark, d):
    return enrich.context_snippets(merge.page_order(lines(spark, d))).select("doc_id", "page", "ord", "context")


@query()
def nearby_captions(spark, d):
    return enrich.nearby_captions(merge.page_order(lines(spark, d))).select("doc_id", "page", "ord", "caption")


@query(f"""WITH {LINES}, s AS (SELECT *, coalesce(y0 - max(y1) OVER (PARTITION BY doc_id, page ORDER BY y0, ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) > 15, true)::INT AS starts FROM lines)
SELECT doc_id, page, ord, sum(starts) OVER (PARTITION BY doc_id, page ORDER BY y0, ord)::BIGINT AS cluster FROM s""")
def paragraph_clusters(spark, d):
    return enrich.paragraph_clusters(lines(spark, d)).select("doc_id", "page", "ord", "cluster")


@query("""SELECT conv_id, turn, lag(role) OVER w AS before, lead(role) OVER w AS after, substr(lag(text) OVER w, 1, 100) AS context FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text)""")
def turn_neighbours(spark, d):
    at = W.partitionBy("conv_id").orderBy("turn", "role", "text")
    return table(spark, d, "conversations").select("conv_id", "turn", F.lag("role").over(at).alias("before"), F.lead("role").over(at).alias("after"), F.substring(F.lag("text").over(at), 1, 100).alias("context"))


# --- state, assets, sets, metrics ---------------------------------------------------------------------------------

_STATUS = "CASE {e} WHEN 'view' THEN 'pending' WHEN 'click' THEN 'running' WHEN 'purchase' THEN 'done' WHEN 'error' THEN 'failed' ELSE 'running' END"


@query(f"SELECT user_id AS job, arg_max({_STATUS.format(e='event_type')}, (ts, event_id)) AS status, min(ts) AS created, max(ts) AS updated, count(*) AS changes FROM events GROUP BY user_id")
def latest_jobs(spark, d):
    return state.latest_jobs(table(spark, d, "events"))


@query(f"WITH j AS (SELECT user_id AS job, arg_max({_STATUS.format(e='event_type')}, (ts, event_id)) AS s FROM events GROUP BY user_id) SELECT job, CASE s WHEN 'running' THEN 'pending' ELSE s END AS status, s = 'running' AS recovered FROM j")
def recovered_jobs(spark, d):
    return state.recover(state.latest_jobs(table(spark, d, "events")))


@query("SELECT * FROM (SELECT user_id AS job, ts AS at, floor(epoch(ts))::BIGINT - floor(epoch(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)))::BIGINT AS gap FROM events) WHERE gap > 1800")
def stalls(spark, d):
    return state.stalls(table(spark, d, "events"), 1800)


@query("SELECT event_id AS key, ts AS mtime FROM events ORDER BY ts DESC, event_id DESC LIMIT 512")
def cache_kept(spark, d):
    return state.evict(table(spark, d, "events").select(F.col("event_id").alias("key"), F.col("ts").alias("mtime")), 512)


@query("SELECT substr(sha256(text), 1, 16) AS asset_id, max(strlen(text)) AS bytes, count(*) AS links FROM documents GROUP BY 1")
def assets(spark, d):
    return state.asset_store(docs(spark, d).select(F.col("doc_id").alias("block_id"), F.col("text").alias("content")))[0]


@query("SELECT doc_id AS block_id, substr(sha256(text), 1, 16) AS asset_id FROM documents")
def asset_links(spark, d):
    return state.asset_store(docs(spark, d).select(F.col("doc_id").alias("block_id"), F.col("text").alias("content")))[1]


@query("SELECT doc_id AS key, sha256(text) AS digest, greatest((strlen(text) + 399) // 400, 1) AS parts, true AS same FROM documents")
def shard_round_trip(spark, d):
    source = docs(spark, d).select(F.col("doc_id").alias("key"), F.col("text").cast("binary").alias("content"))
    cut = state.shards(source, 400)
    whole = state.reassemble(cut).join(cut.groupBy("key").agg(F.count("*").alias("parts")), "key")
    return whole.join(source.withColumnRenamed("content", "was"), "key").select("key", F.sha2("content", 256).alias("digest"), "parts", (F.col("content") == F.col("was")).alias("same"))


@query("SELECT event_type, count(*) AS n, sum(value) > 0 AS any_value FROM events GROUP BY event_type")
def batch_totals(spark, d):
    return table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"), (F.sum("value") > 0).alias("any_value"))


@query(f"""WITH {LINES}, needed AS (SELECT DISTINCT doc_id, page FROM lines), cached AS (SELECT DISTINCT doc_id, page FROM lines WHERE type <> 'paragraph') SELECT * FROM needed EXCEPT SELECT * FROM cached""")
def pages_to_extract(spark, d):
    own = lines(spark, d)
    return own.select("doc_id", "page").distinct().join(own.where("type <> 'paragraph'").select("doc_id", "page").distinct(), ["doc_id", "page"], "left_anti")


@query(f"WITH {LINES} SELECT doc_id, page, type, count(*) AS blocks FROM lines GROUP BY ALL")
def blocks_by_type(spark, d):
    return lines(spark, d).groupBy("doc_id", "page", "type").agg(F.count("*").alias("blocks"))


@query(f"WITH {LINES} SELECT doc_id, page, ord, substr(text, 1, 80) AS preview FROM lines WHERE page <= 3 QUALIFY row_number() OVER (PARTITION BY doc_id, page ORDER BY ord) <= 5")
def previews(spark, d):
    at = W.partitionBy("doc_id", "page").orderBy("ord")
    own = lines(spark, d).where("page <= 3").withColumn("k", F.row_number().over(at)).where("k <= 5")
    return own.select("doc_id", "page", "ord", F.substring("text", 1, 80).alias("preview"))


@query(r"""WITH p AS (SELECT a.doc_id, a.text AS x, b.text AS y, trim(regexp_replace(a.text, '\s+', ' ', 'g')) AS u, trim(regexp_replace(b.text, '\s+', ' ', 'g')) AS v,
  list_filter(string_split(a.text, chr(10)), lambda l: regexp_matches(l, '\S')) AS la, list_filter(string_split(b.text, chr(10)), lambda l: regexp_matches(l, '\S')) AS lb FROM documents a JOIN documents b ON b.doc_id = a.doc_id + 1),
n AS (SELECT *, len(regexp_extract_all(x, '\|')) AS bx, len(regexp_extract_all(y, '\|')) AS by_, len(regexp_extract_all(x, '(?s)\$\$.*?\$\$|\$.*?\$')) AS ex, len(regexp_extract_all(y, '(?s)\$\$.*?\$\$|\$.*?\$')) AS ey FROM p)
SELECT doc_id, CASE WHEN y = '' THEN 0.0::DOUBLE WHEN u = v THEN 1.0 ELSE len(list_filter(range(1, least(length(u), length(v)) + 1), lambda i: u[i] = v[i])) / greatest(length(v), 1) END AS fidelity,
  CASE WHEN len(lb) = 0 THEN 0.0::DOUBLE ELSE len(list_filter(range(1, least(len(la), len(lb)) + 1), lambda i: la[i] = lb[i])) / len(lb) END AS line_order,
  CASE WHEN by_ = 0 THEN (bx = 0)::INT::DOUBLE ELSE least(bx, by_) / greatest(bx, by_) END AS tables, CASE WHEN ey = 0 THEN (ex = 0)::INT::DOUBLE ELSE least(ex, ey) / greatest(ex, ey) END AS equations FROM n""")
def markdown_fidelity(spark, d):
    a = docs(spark, d)
    b = a.select((F.col("doc_id") - 1).alias("doc_id"), F.col("text").alias("other"))
    x, y = F.col("text"), F.col("other")
    return a.join(b, "doc_id").select(
        "doc_id",
        metrics.character_fidelity(x, y).alias("fidelity"),
        metrics.line_order(x, y).alias("line_order"),
        metrics.count_ratio(x, y, metrics.BARS).alias("tables"),
        metrics.count_ratio(x, y, metrics.FORMULAS).alias("equations"),
    )


@query("""WITH RECURSIVE nodes(name) AS (VALUES ('ocr'), ('layout'), ('table'), ('text'), ('merge')), edges(src, dst) AS (VALUES ('ocr', 'layout'), ('layout', 'table'), ('layout', 'text'), ('table', 'merge'), ('text', 'merge')),
r AS (SELECT name, 0 AS level FROM nodes WHERE name NOT IN (SELECT dst FROM edges) UNION ALL SELECT e.dst, r.level + 1 FROM r JOIN edges e ON e.src = r.name) SELECT name, max(level) AS level FROM r GROUP BY name""")
def graph_levels(spark, d):
    spark.createDataFrame([("ocr",), ("layout",), ("table",), ("text",), ("merge",)], "name string").createOrReplaceTempView("graph_nodes")
    spark.createDataFrame([("ocr", "layout"), ("layout", "table"), ("layout", "text"), ("table", "merge"), ("text", "merge")], "src string, dst string").createOrReplaceTempView("graph_edges")
    return state.levels(spark, "graph_nodes", "graph_edges")


# --- layouts, models, progress ------------------------------------------------------------------------------------


@query(f"WITH {LINES}, {REGIONS} SELECT doc_id, page, 0::BIGINT AS seg, type, x0, y0, x1, y1, 0.82::DOUBLE AS confidence FROM regions")
def layout_json(spark, d):
    r = relations.regions(lines(spark, d))
    seg = F.struct(F.col("type").alias("block_type"), F.array("box.x1", "box.y0", "box.x0", "box.y1").alias("bbox"))
    made = r.select("doc_id", F.to_json(F.struct(F.col("page").alias("page_number"), F.array(seg).alias("segments"))).alias("layout"))
    return layout.parse_layout(made).select("doc_id", "page", "seg", "type", "box.*", "confidence")


@query(f"WITH {LINES} SELECT doc_id, page, ord, 'lines' AS provider FROM lines WHERE page % 2 = 1 UNION ALL SELECT doc_id, page, ord, 'spare' FROM lines WHERE page % 2 = 0")
def fill_gaps(spark, d):
    own = lines(spark, d).select("doc_id", "page", "ord", "provider")
    return layout.fill_gaps(own.where("page % 2 = 1"), own.withColumn("provider", F.lit("spare")))


@query(f"WITH {LINES} SELECT doc_id, page + 100 AS page, ord FROM lines WHERE page <= 2")
def renumbered_pages(spark, d):
    own = lines(spark, d).select("doc_id", "page", "ord")
    return layout.renumber(own, own.select("doc_id", "page").distinct().where("page <= 2").withColumn("original", F.col("page") + 100))


@query(f"""WITH {LINES} SELECT doc_id, page, ord FROM lines l WHERE NOT EXISTS (SELECT 1 FROM lines t WHERE t.doc_id = l.doc_id AND t.page = l.page AND t.ord % 7 = 0 AND l.y0 >= t.y0 - 2 AND l.y1 <= t.y1 + 2)""")
def outside_tables(spark, d):
    own = lines(spark, d)
    return layout.outside_tables(own.select("doc_id", "page", "ord", "box"), own.where("ord % 7 = 0")).select("doc_id", "page", "ord")


@query(f"""WITH {LINES} SELECT doc_id, page, count(*) + 0 AS ord, 'p' || page || '.png' AS path FROM lines GROUP BY doc_id, page HAVING count(*) FILTER (type = 'figure') = 0""")
def missing_figures(spark, d):
    own = lines(spark, d)
    images = own.select("doc_id", "page").distinct().select("doc_id", "page", F.lit(0).alias("idx"), F.concat(F.lit("p"), F.col("page").cast("string"), F.lit(".png")).alias("path"))
    return layout.missing_figures(own, images)


@query(f"WITH {LINES} SELECT doc_id, page, min(ord // 10) AS chunk FROM lines GROUP BY doc_id, page")
def first_chunk_of_page(spark, d):
    chunks = lines(spark, d).select("doc_id", F.floor(F.col("ord") / 10).alias("chunk"), "page").distinct()
    return layout.first_of_page(chunks)


@query(f"WITH {REPORT} SELECT doc_id, ord, CASE WHEN regexp_extract(text, '!\\[([^\\]]*)\\]', 1) = '' THEN 'figure' ELSE regexp_extract(text, '!\\[([^\\]]*)\\]', 1) END AS alt, regexp_extract(text, '\\]\\(([^)]*)\\)', 1) AS path FROM report WHERE starts_with(text, '![')")
def image_links(spark, d):
    return report(spark, d).where(F.startswith("text", F.lit("!["))).select("doc_id", "ord", tx.image_link(F.col("text")).alias("l")).select("doc_id", "ord", "l.*")


@query("SELECT p_partkey, '| ' || p_name || ' | ' || CASE WHEN p_size % 2 = 0 THEN p_brand ELSE '' END || ' |' AS line FROM part")
def table_rows(spark, d):
    cells = F.array("p_name", F.when(F.col("p_size") % 2 == 0, F.col("p_brand")))
    return table(spark, d, "part").select("p_partkey", tx.table_row(cells).alias("line"))


@query("SELECT p_partkey, unnest(list_filter(list_transform(string_split(p_name || ', ,' || p_type, ','), lambda x: trim(x)), lambda x: x <> '')) AS keyword FROM part")
def keyword_lists(spark, d):
    return table(spark, d, "part").select("p_partkey", F.explode(tx.keywords(F.concat_ws(", ,", "p_name", "p_type"))).alias("keyword"))


@query(f"""WITH {LINES}, h AS (SELECT doc_id, ord, regexp_extract(text, '((?i:Figure|Fig\\.?|Diagram|Chart|Illustration|Schematic)\\s*\\d+[.-]?\\d*)', 1) AS reference FROM lines) SELECT * FROM h""")
def figure_references(spark, d):
    return lines(spark, d).select("doc_id", "ord", tx.figure_reference(F.col("text")).alias("reference"))


_MODELS = [("large", 8500, 1, ["en", "de", "fr", "es", "tr", "it"]), ("middle", 4200, 2, ["en", "tr"]), ("small", 1800, 3, ["en"]), ("tiny", 600, 4, ["multilingual"])]
_MODELS_SQL = "models(model_id, min_vram_mb, quality_rank, languages) AS (VALUES ('large', 8500, 1, ['en', 'de', 'fr', 'es', 'tr', 'it']), ('middle', 4200, 2, ['en', 'tr']), ('small', 1800, 3, ['en']), ('tiny', 600, 4, ['multilingual']))"


def _models(spark):
    return spark.createDataFrame(_MODELS, "model_id string, min_vram_mb int, quality_rank int, languages array<string>")


@query(f"WITH {_MODELS_SQL} SELECT model_id, quality_rank FROM models WHERE min_vram_mb <= 4500")
def fitting_models(spark, d):
    return models.fitting_models(_models(spark), 4500).select("model_id", "quality_rank")


@query(f"WITH {_MODELS_SQL} SELECT model_id FROM models WHERE min_vram_mb <= 4500 ORDER BY (list_contains(languages, 'de') OR list_contains(languages, 'multilingual') OR len(languages) > 5) DESC, quality_rank LIMIT 1")
def chosen_model(spark, d):
    return models.choose_model(_models(spark), 4500, "de").select("model_id")


@query("SELECT p_partkey, (p_size // 10 > 2) OR (p_size // 10 = 2 AND p_size % 10 >= 5) AS recent FROM part")
def versions(spark, d):
    v = F.concat_ws(".", F.floor(F.col("p_size") / 10).cast("string"), (F.col("p_size") % 10).cast("string"), F.lit("rc"))
    return table(spark, d, "part").select("p_partkey", models.version_at_least(v, F.lit("2.5")).alias("recent"))


@query("SELECT s_suppkey, CASE s_suppkey % 3 WHEN 0 THEN false WHEN 1 THEN s_acctbal >= 0 ELSE s_acctbal >= 2000 END AS use_gpu, CASE WHEN s_nationkey < 10 THEN 1 ELSE 4 END AS batch FROM supplier")
def memory_decisions(spark, d):
    mode = F.element_at(F.array(F.lit("cpu_only"), F.lit("gpu_preferred"), F.lit("auto")), (F.col("s_suppkey") % 3 + 1).cast("int"))
    return table(spark, d, "supplier").select("s_suppkey", models.memory_decision(mode, F.when(F.col("s_acctbal") >= 0, F.col("s_acctbal")), F.col("s_nationkey"), 2000, 10).alias("m")).select("s_suppkey", "m.*")


@query(f"""SELECT doc_id, replace('{models.PROMPT}', '{{language}}', CASE lang WHEN 'en' THEN 'English' WHEN 'de' THEN 'German' WHEN 'fr' THEN 'French' WHEN 'es' THEN 'Spanish' WHEN 'it' THEN 'Italian' WHEN 'tr' THEN 'Turkish' ELSE 'English' END)
  || CASE WHEN coalesce(text, '') <> '' THEN chr(10) || chr(10) || 'Existing caption hint: ' || substr(text, 1, 200) ELSE '' END AS prompt FROM documents""")
def caption_prompts(spark, d):
    return docs(spark, d).select("doc_id", models.caption_prompt(F.col("lang"), F.col("text")).alias("prompt"))


@query("SELECT event_id, CASE WHEN event_id % 10 > 0 AND event_id % 10 < 8 THEN value / (event_id % 10) * (8 - event_id % 10) END AS eta FROM events")
def progress_eta(spark, d):
    return table(spark, d, "events").select("event_id", progress.eta(F.col("value"), F.col("event_id") % 10, F.lit(8)).alias("eta"))


@query("SELECT user_id AS job, coalesce(max(event_id) FILTER (event_type = 'purchase'), 0) AS last FROM events GROUP BY user_id")
def completed_pages(spark, d):
    tasks = table(spark, d, "events").select(F.col("user_id").alias("job"), F.col("event_id").alias("page"), state.status_of(F.col("event_type")).alias("status"))
    return progress.completed_page(tasks)


@query("SELECT count(*) AS total, count(*) FILTER (event_type IN ('view', 'click')) AS pending, count(*) FILTER (value < 20) AS below FROM events")
def review_summary(spark, d):
    status = F.when(F.col("event_type") == "view", "low-confidence").when(F.col("event_type") == "click", "review-needed").otherwise("ok")
    return progress.review_summary(table(spark, d, "events").select(status.alias("status"), F.col("value").alias("confidence")), 20.0)


@query("SELECT c_custkey AS block_id, arg_max(o_orderpriority, o_orderkey) AS action, count(o_orderkey) AS actions FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey")
def review_actions(spark, d):
    actions = table(spark, d, "orders").select(F.col("o_custkey").alias("block_id"), F.col("o_orderkey").alias("seq"), F.col("o_orderpriority").alias("action"))
    return progress.apply_actions(table(spark, d, "customer").select(F.col("c_custkey").alias("block_id")), actions)


@query("SELECT event_id, ts FROM events WHERE ts > (SELECT max(ts) - INTERVAL 1 DAY FROM events)")
def updates_since(spark, d):
    own = table(spark, d, "events").select("event_id", "ts")
    since = own.agg(F.max("ts") - F.expr("INTERVAL 1 DAY")).scalar()  # found when the plan runs
    return progress.updates_since(own, since)


@query("""SELECT user_id AS job, arg_min(event_type, event_id) FILTER (value > 50) AS provider, count(*) AS tries, CASE WHEN count(*) FILTER (value > 50) = 0 THEN arg_max(event_type, event_id) END AS error FROM events GROUP BY user_id""")
def first_success(spark, d):
    e = table(spark, d, "events")
    return progress.first_success(e.select(F.col("user_id").alias("job"), F.col("event_id").alias("pos"), F.col("event_type").alias("provider"), (F.coalesce(F.col("value"), F.lit(0.0)) > 50).alias("ok"), F.col("event_type").alias("error")))


@query("SELECT event_type AS provider, user_id % 5 AS method, count(*) AS calls, max(value) AS slowest FROM events GROUP BY ALL")
def provider_latencies(spark, d):
    return progress.latencies(table(spark, d, "events").select(F.col("event_type").alias("provider"), (F.col("user_id") % 5).alias("method"), F.col("value").alias("elapsed_ms")))


@query(f"WITH {LINES}, a AS (SELECT doc_id, list_distinct(regexp_extract_all(lower(text), '[a-z0-9]{{3,}}')) AS w FROM documents) SELECT x.doc_id, len(list_intersect(x.w, y.w)) AS shared FROM a x JOIN a y ON y.doc_id = x.doc_id + 1")
def shared_words(spark, d):
    a = docs(spark, d).select("doc_id", tx.word_set(F.col("text")).alias("w"))
    b = a.select((F.col("doc_id") - 1).alias("doc_id"), F.col("w").alias("v"))
    return a.join(b, "doc_id").select("doc_id", F.size(F.array_intersect("w", "v")).cast("long").alias("shared"))


@query(f"WITH {LINES}, {REGIONS} SELECT r.doc_id, r.page, r.region, l.ord, round(CASE WHEN (l.x1 - l.x0) * (l.y1 - l.y0) > 0 THEN greatest(least(l.y1, r.y1) - greatest(l.y0, r.y0), 0) / (l.y1 - l.y0) ELSE 0 END, 6) AS share, round(greatest(least(l.y1, r.y1) - greatest(l.y0, r.y0), 0) / ((l.y1 - l.y0) + (r.y1 - r.y0) - greatest(least(l.y1, r.y1) - greatest(l.y0, r.y0), 0)), 6) AS iou FROM regions r JOIN lines l ON l.doc_id = r.doc_id AND l.page = r.page")
def box_overlaps(spark, d):
    own = lines(spark, d)
    r = relations.regions(own).select("doc_id", "page", "region", F.col("box").alias("r"))
    both = r.join(own.select("doc_id", "page", "ord", "box"), ["doc_id", "page"])
    return both.select("doc_id", "page", "region", "ord", F.round(geometry.share_of(F.col("box"), F.col("r")), 6).alias("share"), F.round(geometry.iou(F.col("box"), F.col("r")), 6).alias("iou"))


@query("SELECT job, status, created FROM (SELECT user_id AS job, arg_max(CASE event_type WHEN 'view' THEN 'pending' WHEN 'click' THEN 'running' WHEN 'purchase' THEN 'done' WHEN 'error' THEN 'failed' ELSE 'running' END, (ts, event_id)) AS status, min(ts) AS created FROM events GROUP BY user_id) ORDER BY created DESC, job LIMIT 50")
def newest_jobs(spark, d):
    return state.latest_jobs(table(spark, d, "events")).orderBy(F.col("created").desc(), "job").limit(50).select("job", "status", "created")


# --- more scans, settings and alignment ---------------------------------------------------------------------------


@query("SELECT doc_id, 0::BIGINT AS idx, trim(text) AS text, 0.5::DOUBLE AS confidence FROM documents WHERE trim(text) <> '' UNION ALL SELECT doc_id, 0, '', 0.3 FROM documents WHERE trim(coalesce(text, '')) = ''")
def text_fallback(spark, d):
    return layout.text_fallback(docs(spark, d)).select("doc_id", "idx", "text", F.col("confidence").cast("double").alias("confidence"))


@query("SELECT p_partkey, 'name' AS key, CASE WHEN p_size % 3 = 0 THEN p_name || '=x' ELSE p_name END AS value FROM part WHERE p_size % 2 = 0")
def overrides(spark, d):
    given = F.concat(F.when(F.col("p_size") % 2 == 0, F.lit("name = ")).otherwise(F.lit("name ")), F.col("p_name"), F.when((F.col("p_size") % 3 == 0) & (F.col("p_size") % 2 == 0), F.lit("=x")).otherwise(F.lit("")))
    return table(spark, d, "part").select("p_partkey", config.override(given).alias("o")).where("o IS NOT NULL").select("p_partkey", "o.*")


@query("SELECT p_partkey, p_brand AS a, CASE WHEN p_size % 2 = 0 THEN p_type ELSE p_name END AS b FROM part")
def layered_settings(spark, d):
    first = F.create_map(F.lit("a"), F.col("p_brand"), F.lit("b"), F.col("p_name"))
    second = F.when(F.col("p_size") % 2 == 0, F.create_map(F.lit("b"), F.col("p_type"))).otherwise(F.create_map().cast("map<string,string>"))
    return table(spark, d, "part").select("p_partkey", config.layered(first, second).alias("m")).select("p_partkey", F.col("m")["a"].alias("a"), F.col("m")["b"].alias("b"))


@query("SELECT p_partkey, p_size AS page, p_name AS value FROM part")
def numbered_pages(spark, d):
    m = F.create_map(F.col("p_size").cast("string"), F.col("p_name"), F.lit("x"), F.col("p_type"))
    return table(spark, d, "part").select("p_partkey", F.inline(config.numbered_keys(m)))


@query("SELECT p_partkey, greatest(p_size % 5, 1) AS page, CASE WHEN p_size % 4 > 0 THEN (p_size % 4)::DOUBLE WHEN p_size % 3 > 0 THEN (p_size % 3)::DOUBLE ELSE 0.0 END AS x0 FROM part")
def engine_boxes(spark, d):
    size = F.col("p_size")
    side = config.engine_side((size % 4).cast("double"), (size % 3).cast("double"))
    return table(spark, d, "part").select("p_partkey", config.engine_page(size % 5).alias("page"), side.alias("x0"))


@query("SELECT p_partkey, floor(p_size * 100 * least(1.0::DOUBLE, 1024::DOUBLE / greatest(p_size * 100, 900)))::INT AS width, floor(900 * least(1.0::DOUBLE, 1024::DOUBLE / greatest(p_size * 100, 900)))::INT AS height FROM part")
def fitted_images(spark, d):
    return table(spark, d, "part").select("p_partkey", config.fitted_size(F.col("p_size") * 100, F.lit(900)).alias("s")).select("p_partkey", "s.*")


@query()
def aligned_paragraphs(spark, d):
    pages = render.page_markdown(merge.page_order(lines(spark, d))).withColumnRenamed("markdown", "text")
    return layout.align_paragraphs(lines(spark, d).select("doc_id", F.col("ord").alias("idx"), "text"), pages)


@query("""WITH l AS (SELECT n_name AS path, 'img/' || n_nationkey AS target FROM nation), b AS (SELECT s_suppkey AS block_id, CASE s_suppkey % 3 WHEN 0 THEN n_name WHEN 1 THEN 'x_' || n_name || '.png' ELSE '#' || s_suppkey END AS path FROM supplier JOIN nation ON s_nationkey = n_nationkey)
SELECT block_id, path, coalesce((SELECT target FROM l WHERE l.path = b.path), (SELECT arg_min(target, l.path) FROM l WHERE contains(b.path, l.path) OR contains(l.path, b.path)), path) AS target FROM b""")
def rewritten_links(spark, d):
    nation = table(spark, d, "nation")
    links = nation.select(F.col("n_name").alias("path"), F.concat(F.lit("img/"), F.col("n_nationkey").cast("string")).alias("target"))
    k = F.col("s_suppkey")
    path = F.when(k % 3 == 0, F.col("n_name")).when(k % 3 == 1, F.concat(F.lit("x_"), "n_name", F.lit(".png"))).otherwise(F.concat(F.lit("#"), k.cast("string")))
    return layout.rewrite_links(table(spark, d, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select(k.alias("block_id"), path.alias("path")), links)


@query()
def flattened_elements(spark, d):
    part = table(spark, d, "part")
    leaf = F.struct(F.col("p_type").alias("type"), F.col("p_name").alias("content"))
    tree = F.struct(F.array(F.struct(F.array(leaf, leaf).alias("kids"))).alias("elements"))
    return layout.flatten_elements(part.select(F.col("p_partkey").alias("doc_id"), F.to_json(tree).alias("layout")))


@query()
def line_changes(spark, d):
    a = docs(spark, d).select("doc_id", "text")
    b = a.select((F.col("doc_id") - 1).alias("doc_id"), F.col("text").alias("other"))
    return a.join(b, "doc_id").select("doc_id", metrics.line_changes(F.col("text"), F.col("other")).alias("c")).select("doc_id", "c.*")


@query()
def word_lines(spark, d):
    words = lines(spark, d).select("doc_id", "page", F.col("box.y0").alias("top"), F.posexplode(F.split(F.trim("text"), " +")).alias("k", "text"))
    return enrich.line_clusters(words.select("doc_id", "page", "top", F.col("k").cast("double").alias("x0"), "text"))


@query(f"""WITH {LINES} SELECT doc_id, '{{"page":' || page || ',"blocks":' || count(*) || '}}' AS line FROM lines GROUP BY doc_id, page""")
def status_lines(spark, d):
    counts = lines(spark, d).groupBy("doc_id", "page").agg(F.count("*").alias("blocks"))
    return counts.select("doc_id", F.to_json(F.struct("page", "blocks")).alias("line"))


@query(f"""WITH {LINES}, {SIGNALS} SELECT doc_id, page, CASE WHEN equations THEN 'equation' WHEN tables THEN 'table' WHEN density < 0.1 AND NOT has_text THEN 'figure' ELSE 'paragraph' END AS type FROM signals""")
def dominant_blocks(spark, d):
    s = relations.page_signals(docs(spark, d))
    return s.select("doc_id", "page", classify.dominant_block_type(F.col("equations"), F.col("tables"), F.col("density"), F.col("has_text")).alias("type"))


@query(f"WITH {LINES}, md AS (SELECT doc_id, page, ord, {BLOCK_MD} AS md FROM lines), p AS (SELECT doc_id, page, string_agg(md, chr(10) || chr(10) ORDER BY ord) || chr(10) AS m FROM md WHERE coalesce(md, '') <> '' GROUP BY ALL) SELECT doc_id, count(*) AS pages, string_agg(m, chr(10) || '---' || chr(10) || chr(10) ORDER BY page) AS markdown FROM p GROUP BY doc_id")
def document_markdown(spark, d):
    return render.document_markdown(convert.convert_lines(docs(spark, d)))


@query(f"WITH {LINES} SELECT doc_id, page, count(*) AS blocks FROM lines WHERE page <= 2 GROUP BY ALL")
def first_pages(spark, d):
    return lines(spark, d).where("page <= 2").groupBy("doc_id", "page").agg(F.count("*").alias("blocks"))


@query(f"WITH {LINES}, {REGIONS}, {_chains_sql(True)}, n AS (SELECT doc_id, count(DISTINCT page) AS n FROM lines GROUP BY doc_id) SELECT best AS provider, doc_id, count(DISTINCT page) / n >= 0.7 AS whole FROM regions JOIN best USING (type) JOIN n USING (doc_id) GROUP BY best, doc_id, n")
def subset_or_whole(spark, d):
    total = lines(spark, d).groupBy("doc_id").agg(F.count_distinct("page").alias("n"))
    return route.provider_pages(convert.routing_plan(docs(spark, d))).join(total, "doc_id").select("provider", "doc_id", (F.col("pages") / F.col("n") >= 0.7).alias("whole"))


@query("SELECT event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 3")
def last_events(spark, d):
    at = W.partitionBy("user_id").orderBy(F.col("ts").desc(), F.col("event_id").desc())
    return table(spark, d, "events").withColumn("k", F.row_number().over(at)).where("k <= 3").select("event_id")


@query("SELECT doc_id, 'body' AS provider, length(text) AS chars FROM documents WHERE length(trim(text)) > 100")
def first_long_text(spark, d):
    own = docs(spark, d)
    head = own.select("doc_id", F.lit(0).alias("pos"), F.lit("head").alias("provider"), F.substring("text", 1, 100).alias("text"))
    both = head.unionByName(own.select("doc_id", F.lit(1).alias("pos"), F.lit("body").alias("provider"), "text"))
    return layout.first_success_text(both).select("doc_id", "provider", F.length("text").alias("chars"))


# --- further rules ------------------------------------------------------------------------------------------------


@query("""WITH b AS (SELECT user_id AS doc_id, (event_id % 7)::INT AS page, (event_id * 37 % 600)::DOUBLE AS x0 FROM events), c AS (SELECT *, (x0 + x0 + 12) / 2 / 612 AS centre FROM b)
SELECT doc_id, page, CASE WHEN count(*) >= 4 AND count(*) FILTER (centre < 0.4) > 0.3::DOUBLE * count(*) AND count(*) FILTER (centre > 0.6) > 0.3::DOUBLE * count(*) THEN 2 ELSE 1 END AS columns FROM c GROUP BY ALL""")
def page_columns(spark, d):
    x0 = (F.col("event_id") * 37 % 600).cast("double")
    shape = F.struct(x0.alias("x0"), F.lit(0.0).alias("y0"), (x0 + 12).alias("x1"), F.lit(10.0).alias("y1"))
    return profile.column_estimate(table(spark, d, "events").select(F.col("user_id").alias("doc_id"), (F.col("event_id") % 7).cast("int").alias("page"), shape.alias("box")), 612.0)


@query("""WITH s AS (SELECT user_id AS doc_id, event_id % 5 = 0 AND user_id % 4 = 0 AS equations, event_id % 3 = 0 AND user_id % 3 = 0 AS tables, event_id % 4 > user_id % 5 AS has_text, (event_id % 50)::DOUBLE / 100 AS density, CASE WHEN event_id % 6 = 0 AND user_id % 7 < 3 THEN 2 WHEN event_id % 11 > 0 THEN 1 END AS columns FROM events),
p AS (SELECT doc_id, count(*) AS pages, bool_or(equations) AS math, bool_or(tables) AS tables, count(*) FILTER (NOT has_text) > 0.5 * count(*) AS scanned, bool_or(coalesce(columns, 1) > 1) AS multi_column,
  least(sum((density + CASE WHEN equations THEN 0.2::DOUBLE ELSE 0.0 END + CASE WHEN tables THEN 0.2::DOUBLE ELSE 0.0 END + CASE WHEN columns > 1 THEN 0.1::DOUBLE ELSE 0.0 END)::DECIMAL(20, 10))::DOUBLE / count(*), 1) AS complexity FROM s GROUP BY doc_id),
t AS (SELECT *, CASE WHEN math AND tables THEN 'academic' WHEN tables THEN 'tabular' WHEN math THEN 'scientific' WHEN scanned THEN 'scanned' WHEN multi_column THEN 'multi-column' ELSE 'text-heavy' END AS dominant FROM p)
SELECT *, CASE dominant WHEN 'academic' THEN 'mineru,docling,marker' WHEN 'tabular' THEN 'docling,mineru,marker' WHEN 'scientific' THEN 'mineru,marker,docling' WHEN 'scanned' THEN 'marker,docling,mineru' ELSE 'marker,docling,markitdown' END AS suggested FROM t""")
def suggested_providers(spark, d):
    e, u = F.col("event_id"), F.col("user_id")
    columns = F.when((e % 6 == 0) & (u % 7 < 3), 2).when(e % 11 > 0, 1)
    signals = table(spark, d, "events").select(u.alias("doc_id"), ((e % 5 == 0) & (u % 4 == 0)).alias("equations"), ((e % 3 == 0) & (u % 3 == 0)).alias("tables"), (e % 4 > u % 5).alias("has_text"), ((e % 50) / 100).alias("density"), columns.alias("columns"))
    own = profile.document_profile(signals)
    return own.withColumn("suggested", F.array_join(classify.suggested_providers(F.col("dominant")), ","))


@query("""SELECT p_partkey, substr('[table: ' || p_name || ' | ' || CASE WHEN p_size % 2 = 0 THEN p_brand ELSE '' END || ' | ' || repeat(p_type, 12) || ']', 1, 200) AS hint,
  '| ' || p_name || ' | ' || CASE WHEN p_size % 2 = 0 THEN p_brand ELSE '' END || ' |' || chr(10) || '| --- | --- |' || CASE WHEN p_size % 3 > 0 THEN chr(10) || '| ' || p_type || ' | ' || p_size || ' |' ELSE '' END AS markdown FROM part""")
def tables_as_markdown(spark, d):
    brand = F.when(F.col("p_size") % 2 == 0, F.col("p_brand"))
    head, row = F.array("p_name", brand), F.array("p_type", F.col("p_size").cast("string"))
    rows = F.when(F.col("p_size") % 3 > 0, F.array(head, row)).otherwise(F.array(head))
    hint = tx.table_hint(F.array("p_name", brand, F.repeat("p_type", F.lit(12))))
    return table(spark, d, "part").select("p_partkey", hint.alias("hint"), tx.table_markdown(rows).alias("markdown"))


@query(f"""WITH {LINES}, {REGIONS}, {_chains_sql(True)}, {PAIRS}, {MATCHED}, f AS (SELECT doc_id, page, region, count(*) AS n FROM matched GROUP BY ALL)
SELECT doc_id, page, count(*) AS segments, string_agg(region || ':' || type || ':' || best || ':' || coalesce(n, 0), ' ' ORDER BY region) AS log FROM regions JOIN best USING (type) LEFT JOIN f USING (doc_id, page, region) GROUP BY doc_id, page""")
def routing_log(spark, d):
    routed = convert.routing_plan(docs(spark, d))
    matched = merge.match_blocks(relations.regions(lines(spark, d)), _blocks(spark, d))
    log = route.routing_log(routed, matched)
    entry = lambda x: F.concat_ws(":", x["seg_idx"].cast("string"), x["type"], x["best_provider"], x["blocks_found"].cast("string"))
    return log.select("doc_id", "page", "segments", F.array_join(F.transform("log", entry), " ").alias("log"))


@query(f"""WITH {LINES}, {PAIRS}, {DEDUP}, p AS (SELECT DISTINCT doc_id, page, k.provider AS provider FROM kept) SELECT doc_id, page, string_agg(provider, ',' ORDER BY provider) AS providers FROM p GROUP BY doc_id, page""")
def providers_used(spark, d):
    kept = merge.drop_overlapping(_blocks(spark, d))
    return kept.groupBy("doc_id", "page").agg(F.array_join(F.array_sort(F.collect_set("provider")), ",").alias("providers"))


@query(f"""WITH {LINES}, {REGIONS}, {_chains_sql(True)}, b AS (SELECT doc_id, best, min(page * 1000 + region) AS first FROM regions JOIN best USING (type) GROUP BY doc_id, best)
SELECT doc_id, string_agg(best, ',' ORDER BY best <> 'marker', first) AS engines FROM b GROUP BY doc_id""")
def engines_in_order(spark, d):
    routed = convert.routing_plan(docs(spark, d))
    own = routed.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("page", "region", "best"))).alias("r"))
    return own.select("doc_id", F.array_join(route.engines(F.transform("r", lambda x: x["best"])), ",").alias("engines"))


@query(f"""WITH j AS (SELECT user_id AS job, arg_max({_STATUS.format(e='event_type')}, (ts, event_id)) AS s FROM events GROUP BY user_id) SELECT count(*) AS total, count(*) FILTER (s = 'done') AS success, count(*) FILTER (s = 'failed') AS failed FROM j""")
def job_totals(spark, d):
    jobs = state.latest_jobs(table(spark, d, "events"))
    return jobs.agg(F.count("*").alias("total"), F.count_if(F.col("status") == "done").alias("success"), F.count_if(F.col("status") == "failed").alias("failed"))


@query("""WITH o AS (SELECT user_id AS key, (event_id % 20)::INT AS page, max(event_id) AS v, max(event_id) % 3 > 0 AS filled FROM events WHERE event_id % 2 = 0 GROUP BY ALL),
n AS (SELECT user_id AS key, (event_id % 20)::INT AS page, max(event_id) AS v, max(event_id) % 5 > 1 AS filled FROM events WHERE event_id % 2 = 1 OR event_id % 3 = 0 GROUP BY ALL)
SELECT coalesce(o.key, n.key) AS key, coalesce(o.page, n.page) AS page, CASE WHEN n.key IS NOT NULL AND (o.key IS NULL OR NOT o.filled OR n.filled) THEN n.v ELSE o.v END AS v FROM o FULL JOIN n ON o.key = n.key AND o.page = n.page""")
def merged_cache_pages(spark, d):
    def pages(rows, k):
        own = rows.groupBy(F.col("user_id").alias("key"), (F.col("event_id") % 20).cast("int").alias("page")).agg(F.max("event_id").alias("v"))
        return own.withColumn("blocks", F.when(F.col("v") % k[0] > k[1], F.array("v")).otherwise(F.array().cast("array<bigint>")))

    events = table(spark, d, "events")
    return state.merge_pages(pages(events.where("event_id % 2 = 0"), (3, 0)), pages(events.where("event_id % 2 = 1 OR event_id % 3 = 0"), (5, 1))).select("key", "page", "v")


@query("SELECT c_custkey AS job, o_orderkey AS page, o_orderstatus AS status FROM customer JOIN orders ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING'")
def tasks_of_jobs(spark, d):
    tasks = table(spark, d, "orders").select(F.col("o_custkey").alias("job"), F.col("o_orderkey").alias("page"), F.col("o_orderstatus").alias("status"))
    return tasks.join(table(spark, d, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("job")), "job").select("job", "page", "status")


CONVERTED = f"""cb AS (SELECT doc_id, page, ord, CASE provider WHEN 'lines' THEN 'marker' ELSE 'docling' END AS provider, type, text, x0, y0, x1, y1, confidence FROM blocks),
cm AS (
  SELECT r.region, b.*, CASE WHEN b.provider = best.best THEN 0 ELSE 1 + list_position(string_split(best.chain, ','), b.provider) END AS place
  FROM regions r JOIN best USING (type) JOIN cb b ON r.doc_id = b.doc_id AND r.page = b.page
  WHERE (r.x1 - r.x0) * (r.y1 - r.y0) <= 0 OR greatest(least(b.x1, r.x1) - greatest(b.x0, r.x0), 0) * greatest(least(b.y1, r.y1) - greatest(b.y0, r.y0), 0) / ((b.x1 - b.x0) * (b.y1 - b.y0)) >= 0.3
), ct AS (SELECT * FROM cm WHERE place IS NOT NULL QUALIFY place = min(place) OVER (PARTITION BY doc_id, page, region)),
cf AS (SELECT DISTINCT doc_id, page, provider, ord FROM ct),
ce AS (SELECT cb.* FROM cb JOIN cf USING (doc_id, page, provider, ord) UNION ALL SELECT doc_id, page, ord, 'lines', type, text, x0, y0, x1, y1, 0.85 FROM lines l WHERE NOT EXISTS (SELECT 1 FROM cf WHERE cf.doc_id = l.doc_id AND cf.page = l.page)),
co AS (SELECT doc_id, page, list({{'provider': provider, 'ord': ord, 'type': type, 'text': text, 'y0': y0, 'y1': y1}} ORDER BY confidence DESC, provider, ord) AS a FROM ce GROUP BY ALL),
ck AS (
  SELECT doc_id, page, unnest(list_reduce(list_transform(a, lambda b: [b]), lambda acc, x: CASE WHEN len(list_filter(acc, lambda k:
    greatest(least(k.y1, x[1].y1) - greatest(k.y0, x[1].y0), 0) / ((k.y1 - k.y0) + (x[1].y1 - x[1].y0) - greatest(least(k.y1, x[1].y1) - greatest(k.y0, x[1].y0), 0)) > 0.8)) > 0 THEN acc ELSE list_concat(acc, x) END)) AS k FROM co
), cx AS (SELECT doc_id, page, k.provider AS provider, k.ord AS ord, k.type AS type, k.text AS text, k.y0 AS y0 FROM ck),
cr AS (SELECT doc_id, page, ord, provider, y0, {BLOCK_MD} AS md FROM cx),
cp AS (SELECT doc_id, page, string_agg(md, chr(10) || chr(10) ORDER BY y0, provider, ord) || chr(10) AS md FROM cr WHERE coalesce(md, '') <> '' GROUP BY doc_id, page),
cd AS (SELECT doc_id, count(*) AS pages, string_agg(md, chr(10) || '---' || chr(10) || chr(10) ORDER BY page) AS md FROM cp GROUP BY doc_id)"""


@query(f"WITH {LINES}, {REGIONS}, {PAIRS}, {_chains_sql(True)}, {CONVERTED}, {_beautified('cd', 'md')} SELECT doc_id, pages, markdown FROM beauty JOIN cd USING (doc_id)")
def convert_documents(spark, d):
    return convert.convert_documents(docs(spark, d))


ORACLES["converted_pages"] = f"WITH {LINES}, {REGIONS}, {PAIRS}, {_chains_sql(True)}, {CONVERTED} SELECT doc_id, page, md AS markdown FROM cp"


# --- pages of one text, parts of files, models and captions -------------------------------------------------------

STRIP = r"regexp_replace({t}, '^\s+|\s+\z', '', 'g')"


@query(rf"""WITH p AS (
  SELECT doc_id, list_filter(list_transform(string_split_regex(replace(text, '. ', '.' || chr(10) || repeat('-', 48) || chr(10) || chr(10)), '\n{{0,2}}-{{48}}\n{{0,2}}'), lambda x: {STRIP.format(t="x")}), lambda x: x <> '') AS a FROM documents
) SELECT doc_id, unnest(range(1, len(a) + 1)) AS page, unnest(a) AS markdown FROM p""")
def marked_pages(spark, d):
    mark = F.lit(".\n" + "-" * 48 + "\n\n")
    return render.split_pages(docs(spark, d).select("doc_id", F.replace("text", F.lit(". "), mark).alias("markdown")))


@query(rf"""WITH RECURSIVE t AS (
  SELECT doc_id, doc_id % 4 + 1 AS pages, replace(text, '. ', '.' || CASE doc_id % 3 WHEN 0 THEN chr(12) WHEN 1 THEN chr(10) || '---' || chr(10) ELSE chr(10) END) AS md FROM documents
), s AS (
  SELECT *, CASE WHEN contains(md, chr(12)) THEN string_split(md, chr(12)) ELSE string_split(md, chr(10) || '---' || chr(10)) END AS a, greatest(length(md) // pages, 1) AS fill FROM t
), l AS (
  SELECT doc_id, pages, fill, unnest(range(len(string_split(md, chr(10))))) AS i, unnest(string_split(md, chr(10))) AS line FROM s WHERE len(a) < pages
), w AS (
  SELECT doc_id, i, 1::BIGINT AS page, length(line) + 1 AS chars, pages, fill FROM l WHERE i = 0
  UNION ALL SELECT l.doc_id, l.i, w.page + (w.chars >= w.fill AND w.page < w.pages)::INT, CASE WHEN w.chars >= w.fill AND w.page < w.pages THEN 0 ELSE w.chars END + length(l.line) + 1, w.pages, w.fill
  FROM w JOIN l ON l.doc_id = w.doc_id AND l.i = w.i + 1
), g AS (SELECT w.doc_id, w.page, string_agg(l.line, chr(10) ORDER BY l.i) AS md FROM w JOIN l ON l.doc_id = w.doc_id AND l.i = w.i GROUP BY w.doc_id, w.page),
m AS (SELECT doc_id, unnest(range(1, pages + 1)) AS page, unnest(list_slice(a, 1, pages)) AS md FROM s WHERE len(a) >= pages)
SELECT doc_id, page, {STRIP.format(t="md")} AS markdown FROM (FROM g UNION ALL FROM m)""")
def divided_pages(spark, d):
    doc_id = F.col("doc_id")
    mark = F.concat(F.lit("."), F.when(doc_id % 3 == 0, "\f").when(doc_id % 3 == 1, "\n---\n").otherwise("\n"))
    return render.divide_pages(docs(spark, d).select("doc_id", F.replace("text", F.lit(". "), mark).alias("markdown"), (doc_id % 4 + 1).alias("pages")))


@query("SELECT doc_id AS key, doc_id % 7 <> 0 AND doc_id % 11 <> 1 AS intact FROM documents")
def verified_shards(spark, d):
    """Parts of which some are missing and some altered, against the manifest."""
    cut = state.shards(docs(spark, d).select(F.col("doc_id").alias("key"), F.col("text").cast("binary").alias("content")), 400)
    altered = F.when((F.col("key") % 11 == 1) & (F.col("part") == 0), F.concat("content", F.lit(b"x"))).otherwise(F.col("content"))
    stored = cut.where(~((F.col("key") % 7 == 0) & (F.col("part") == 0))).withColumn("content", altered)
    return state.verify_shards(stored, state.shard_manifest(cut))


@query("SELECT p_size AS tier, arg_min(p_name, p_partkey) AS model_id FROM part GROUP BY p_size")
def model_of_tier(spark, d):
    return models.first_of(table(spark, d, "part").select(F.col("p_size").alias("tier"), F.col("p_name").alias("model_id"), F.col("p_partkey").alias("seq")), "tier")


@query(r"""SELECT conv_id, count(*) FILTER (WHERE ok) AS refined, count(*) FILTER (WHERE NOT ok) AS failed FROM (
  SELECT conv_id, coalesce(length(text) >= 10 AND len(regexp_extract_all(text, '\S+')) >= 3 AND NOT (starts_with(lower(text), 'i cannot') OR starts_with(lower(text), 'i can''t') OR starts_with(lower(text), 'sorry') OR starts_with(lower(text), 'as an ai')), false) AS ok FROM conversations
) GROUP BY conv_id""")
def caption_totals(spark, d):
    return enrich.caption_counts(table(spark, d, "conversations"), "conv_id")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents to Markdown, by way of regions, routing, matching, de-duplication, rendering and repairs."""
    return convert.convert_documents(docs(spark, sf_dir))
