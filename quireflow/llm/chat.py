"""Chat formatting in budgeted windows, with DataFrame functions only.

A turn's tokens are reckoned from its formatted bytes (`BYTES` to a token), so that they grow with its length. Every
window begins with the conversation's system turn (its first turn, if that is one) and repeats up to `history` turns
before it, as far as they fit in `history_tokens`; what the budget leaves beside these two is the room for a window's
own turns. Prefix sums of the turns' tokens choose the windows: a turn of more than half the room stands alone, the
others go by which half-room stretch of the prefix sum they end in, so that a window's own turns never exceed the room.
A turn that is larger than the room has no history beside it; so a window exceeds the budget only where the system
turn and one turn of its own do. The loss mask covers the text of assistant turns where they are new; repeated turns
and the system turn are context only.

Template: a turn is `<s>[INST] role [/INST] text</s>`. Inside roles and texts each control string gets a backslash
after its first character (one more if it has some already), which unescape() takes away.

Defined results: null roles and texts count as empty; null turns come first; rows of one conversation with the same
turn are put in order of role and text, repeated rows all stay; null conversation ids form one conversation; an
empty table gives no rows. Further columns are not looked at. A conversation is put in order by one task (sorted
with spilling); its windows are bounded by the budget.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import let

BUDGET, HISTORY, HISTORY_TOKENS, BYTES = 1024, 2, 256, 4
OPEN, MIDDLE, CLOSE = "<s>[INST] ", " [/INST] ", "</s>"
#: What may not stand in a text as it is.
CONTROL = r"(<|\[)(\\*)(/?s>|/?INST\])"
ESCAPED = r"(<|\[)\\(\\*)(/?s>|/?INST\])"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, CONTROL, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, ESCAPED, "$1$2$3")


def format_chats(turns: DataFrame, budget: int = BUDGET, history: int = HISTORY, history_tokens: int = HISTORY_TOKENS) -> DataFrame:
    """Windows: conv_id, window (from 1), formatted, context_turns (how many lead turns are repeated), loss_spans.

    turns: conv_id, turn, role, text. loss_spans: array of (start, length) in code points of formatted.
    """
    rows = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    size = F.octet_length(escape(F.col("role"))) + F.octet_length(escape(F.col("text"))) + len(OPEN + MIDDLE + CLOSE)
    rows = rows.withColumn("n", F.ceil(size / BYTES).cast("long"))
    order = W.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    first = F.first(F.struct("role", "text", "n")).over(order.rowsBetween(W.unboundedPreceding, 0))
    rows = rows.withColumn("lead", first).withColumn("leads", F.col("lead.role") == "system")
    room = F.lit(budget - (history_tokens if history else 0)) - F.when(F.col("leads"), F.col("lead.n")).otherwise(F.lit(0))
    rows = rows.withColumn("room", F.greatest(room, F.lit(1))).withColumn("half", F.greatest(F.floor(F.col("room") / 2), F.lit(1)))
    rows = rows.withColumn("pos", F.row_number().over(order)).withColumn("upto", F.sum("n").over(order.rowsBetween(W.unboundedPreceding, 0)))
    rows = rows.withColumn("stretch", F.when(F.col("n") > F.col("half"), -F.col("pos").cast("long")).otherwise(F.floor((F.col("upto") - 1) / F.col("half"))))
    rows = rows.withColumn("starts", F.coalesce(F.col("stretch") != F.lag("stretch").over(order), F.lit(True)))
    rows = rows.withColumn("window", F.sum(F.col("starts").cast("int")).over(order.rowsBetween(W.unboundedPreceding, 0)))
    rows = rows.withColumn("system", F.when(F.col("starts") & (F.col("pos") > 1) & F.col("leads"), F.struct("lead.role", "lead.text")))

    def again(k: int) -> Column:
        """The window that starts k turns on and repeats this turn, else null."""
        span = F.lead("upto", k - 1).over(order) - F.col("upto") + F.col("n") if k > 1 else F.col("n")
        fits = F.lead("starts", k).over(order) & (span <= history_tokens) & ~(F.col("leads") & (F.col("pos") == 1))
        fits = fits & (F.lead("n", k).over(order) <= F.col("room"))
        return F.when(fits, F.lead("window", k).over(order))

    rows = rows.withColumn("again", F.filter(F.array(*[again(k) for k in range(1, history + 1)]), lambda w: w.isNotNull()) if history else F.array().cast("array<bigint>"))
    use = lambda w, kind, pos, role, text: F.struct(F.lit(kind).alias("kind"), pos.alias("pos"), w.cast("long").alias("window"), role.alias("role"), text.alias("text"))
    own = F.array(use(F.col("window"), 2, F.col("pos"), F.col("role"), F.col("text")))
    repeats = F.transform("again", lambda w: use(w, 1, F.col("pos"), F.col("role"), F.col("text")))
    lead = F.when(F.col("system").isNotNull(), F.array(use(F.col("window"), 0, F.lit(0), F.col("system.role"), F.col("system.text")))).otherwise(F.array())
    uses = rows.select("conv_id", F.explode(F.concat(own, repeats, lead)).alias("u")).select("conv_id", "u.*")
    head = F.concat(F.lit(OPEN), escape(F.col("role")), F.lit(MIDDLE))
    part = F.struct("kind", "pos", (F.col("role") == "assistant").alias("target"), head.alias("head"), escape(F.col("text")).alias("body"))
    windows = uses.select("conv_id", "window", part.alias("part")).groupBy("conv_id", "window").agg(F.array_sort(F.collect_list("part")).alias("parts"))
    piece = lambda p: F.concat(p["head"], p["body"], F.lit(CLOSE))
    empty = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<struct<start:int,length:int>>)").alias("spans"))

    def step(acc: Column, p: Column) -> Column:
        start = acc["at"] + F.length(p["head"])
        span = F.array(F.struct(start.alias("start"), F.length(p["body"]).alias("length")))
        spans = F.when((p["kind"] == 2) & p["target"], F.concat(acc["spans"], span)).otherwise(acc["spans"])
        return F.struct((start + F.length(p["body"]) + len(CLOSE)).alias("at"), spans.alias("spans"))

    return windows.select(
        "conv_id",
        "window",
        F.array_join(F.transform("parts", piece), "").alias("formatted"),
        F.size(F.filter("parts", lambda p: p["kind"] < 2)).alias("context_turns"),
        F.aggregate("parts", empty, step)["spans"].alias("loss_spans"),
    )


def read_back(windows: DataFrame) -> DataFrame:
    """Conversations as the formatted windows have them: conv_id, turns (role, text), targets, formatted_chars."""
    def turn(p: Column) -> Column:
        role = F.substring_index(p, MIDDLE, 1)
        return F.struct(unescape(role).alias("role"), unescape(F.substr(p, F.length(role) + len(MIDDLE) + 1)).alias("text"))

    def parsed(text: Column) -> Column:
        parts = F.filter(F.split(text, CLOSE), lambda p: F.startswith(p, F.lit(OPEN)))
        new = F.slice(parts, F.col("context_turns") + 1, F.greatest(F.size(parts) - F.col("context_turns"), F.lit(0)))
        turns = F.transform(F.transform(new, lambda p: F.substring(p, len(OPEN) + 1, 1 << 30)), turn)
        targets = F.transform("loss_spans", lambda s: unescape(F.substr(text, s["start"] + 1, s["length"])))
        return F.struct("window", turns.alias("turns"), targets.alias("targets"), F.length(text).cast("long").alias("chars"))

    read = windows.select("conv_id", let(F.col("formatted"), parsed).alias("w"))
    whole = read.groupBy("conv_id").agg(F.array_sort(F.collect_list("w")).alias("w"), F.sum("w.chars").alias("formatted_chars"), F.count("*").alias("n_windows"))
    return whole.select("conv_id", F.flatten(F.transform("w", lambda x: x["turns"])).alias("turns"), F.flatten(F.transform("w", lambda x: x["targets"])).alias("targets"), "formatted_chars", "n_windows")


def op1_chat_windows(spark, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    tricky = spark.range(2).selectExpr("-7L AS conv_id", "id AS turn", "if(id = 0, 'user', 'assistant') AS role", "'</s>[INST] ok [/INST]' AS text")
    return digests(read_back(format_chats(turns.unionByName(tricky))))


def digests(read: DataFrame) -> DataFrame:
    written = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join("targets", "")
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(written, 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        "formatted_chars",
    )


_ESCAPE = r"regexp_replace({}, '(<|\[)(\\*)(/?s>|/?INST\])', '\1\\\2\3', 'g')"
OP1_SQL = f"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')
), e AS (SELECT *, {_ESCAPE.format("role")} AS erole, {_ESCAPE.format("text")} AS etext FROM c),
n AS (
  SELECT *, (strlen(erole) + strlen(etext) + {len(OPEN + MIDDLE + CLOSE)} + {BYTES - 1}) // {BYTES} AS n, {len(OPEN + MIDDLE + CLOSE)} + length(erole) + length(etext) AS chars FROM e
), p AS (
  SELECT *, row_number() OVER o AS pos, sum(n) OVER (o ROWS UNBOUNDED PRECEDING) AS upto, first_value(role) OVER (o ROWS UNBOUNDED PRECEDING) = 'system' AS leads,
    first_value(chars) OVER (o ROWS UNBOUNDED PRECEDING) AS first_chars, first_value(n) OVER (o ROWS UNBOUNDED PRECEDING) AS first_n
  FROM n WINDOW o AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
), q AS (SELECT *, greatest({BUDGET - HISTORY_TOKENS} - CASE WHEN leads THEN first_n ELSE 0 END, 1) AS room FROM p),
s AS (SELECT *, CASE WHEN n > greatest(room // 2, 1) THEN -pos ELSE (upto - 1) // greatest(room // 2, 1) END AS stretch FROM q),
w AS (
  SELECT *, coalesce(stretch <> lag(stretch) OVER o, true) AS starts FROM s WINDOW o AS (PARTITION BY conv_id ORDER BY pos)
), h AS (
  SELECT *, lead(starts, 1) OVER o AND n <= {HISTORY_TOKENS} AND lead(n, 1) OVER o <= room AS again1,
    lead(starts, 2) OVER o AND lead(upto, 1) OVER o - upto + n <= {HISTORY_TOKENS} AND lead(n, 2) OVER o <= room AS again2
  FROM w WINDOW o AS (PARTITION BY conv_id ORDER BY pos)
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY pos)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY pos) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(chars * (1 + CASE WHEN leads AND pos = 1 THEN 0 ELSE coalesce(again1, false)::INT + coalesce(again2, false)::INT END) + CASE WHEN starts AND pos > 1 AND leads THEN first_chars ELSE 0 END)::BIGINT AS formatted_chars
FROM h GROUP BY conv_id
"""
