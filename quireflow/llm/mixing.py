"""Mixing sources to target weights, with DataFrame functions only.

Every source's documents are laid end to end, in a pseudorandom but fixed order, and the stream of words is packed
into blocks of `block` words. The mix is a list of slots, cut into output shards. How many slots of a shard go to
each source is a multinomial draw by the sources' totals: every slot draws a source by a hash of its number. The draws
of a source are numbered through all shards. Since such a draw misses the totals, a remainder step follows: draws
beyond a source's total are given, in order, to the sources that were drawn too seldom, so that totals are met exactly
(a capped source could exceed its cap otherwise). The j-th slot of a source names the block that the source's own index
permutation (one for each pass over the source) has at j; slots and blocks are then joined by index.

Permutations are swap-or-not networks keyed by MD5, which work on any range and need no state. Prefix sums run in hash
ranges of a source, as many as the rows ask for, and then over the ranges' sums, so that no task holds a whole source.

Defined results: null texts have size 0, and such documents are taken 0 times; a null source is a source of its
own, the last; a source without words has target 0; repeated rows count each on its own; an empty table gives no
rows; further columns of the input are not looked at. Rows that share an id (or have none) stand in one hash range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WORD, kept, let, materialize

WEIGHTS, CAP, BLOCK, BUCKET, ROUNDS, STRIDE = (5, 2, 1), 3, 128, 1 << 11, 8, 1024


def keyed_hash(*parts: Column | str) -> Column:
    """48 bits of the MD5 of the parts, as long."""
    joined = F.concat_ws(":", *[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    return F.conv(F.substring(F.md5(joined), 1, 12), 16, 10).cast("long")


def round_keys(n: Column, *key: Column | str, rounds: int = ROUNDS) -> Column:
    """What a permutation of 0..n-1 needs: for each round, its name in the hash and its pivot."""
    named = F.concat_ws(":", *[F.lit(p) if isinstance(p, str) else p.cast("string") for p in key])
    return F.array(*[F.struct(F.concat_ws(":", F.lit(f"b{r}"), named).alias("name"), F.pmod(keyed_hash(f"k{r}", *key), n).alias("pivot")) for r in range(rounds)])


def permuted(x: Column, n: Column, keys: Column) -> Column:
    """The place of x (0..n-1) under a pseudorandom permutation of 0..n-1: swap-or-not."""

    def step(place: Column, key: Column) -> Column:
        partner = F.pmod(key["pivot"] - place, n)
        coin = F.ascii(F.md5(F.concat_ws(":", key["name"], F.greatest(place, partner).cast("string"))))
        return F.when(coin % 2 == 1, partner).otherwise(place)

    return F.aggregate(keys, x.cast("long"), step)


def source_targets(sized: DataFrame, weights=WEIGHTS, cap: int = CAP) -> DataFrame:
    """source, sid (1.., by code point, null last), source_size, target (words).

    Water filling: sources ordered by cap * size / weight reach their cap one after another; those that follow
    share what is left by weight.
    """
    by_name = W.orderBy(F.col("source").asc_nulls_last())
    every, upto = W.partitionBy(), W.orderBy("fill", "sid").rowsBetween(W.unboundedPreceding, -1)
    onward, before = W.orderBy("fill", "sid").rowsBetween(0, W.unboundedFollowing), W.orderBy("fill", "sid").rowsBetween(W.unboundedPreceding, 0)
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.col("sid") - 1, F.lit(len(weights))) + 1).cast("int")).cast("long")
    src = sized.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("sid", F.row_number().over(by_name).cast("long"))
    src = src.withColumn("weight", weight).withColumn("fill", F.col("source_size") * F.lit(float(cap)) / F.col("weight"))
    src = src.withColumn("total", F.sum("source_size").over(every))
    left = F.col("total") - F.coalesce(F.sum(F.col("source_size") * cap).over(upto), F.lit(0))
    src = src.withColumn("left", left).withColumn("share", F.sum("weight").over(onward))
    src = src.withColumn("full", F.col("fill") * F.col("share") < F.col("left"))
    src = src.withColumn("open", F.sum(F.when(~F.col("full"), 1).otherwise(0)).over(before))  # 1 at the first that isn't full
    first = lambda c: F.max(F.when((F.col("open") == 1) & ~F.col("full"), F.col(c))).over(every)
    src = src.withColumn("left", first("left")).withColumn("share", first("share"))
    target = F.when(F.col("open") == 0, (F.col("source_size") * cap).cast("double")).otherwise(F.col("weight") * F.col("left") / F.col("share"))
    return src.select("source", "sid", "source_size", F.when(F.col("source_size") == 0, F.lit(0.0)).otherwise(target).alias("target"))


def row_key(*columns: Column) -> Column:
    """16 bytes that tell rows apart by the values of some columns."""
    return F.unhex(F.md5(F.concat_ws("\x1f", *[F.coalesce(c.cast("string"), F.lit("\x00")) for c in columns])))


def cells(spans: DataFrame, low: str, length: str, width: int) -> DataFrame:
    """spans cut for a join by cell: cell, and spans' columns; a place x is in the span if low <= x < low + length."""
    last = F.floor((F.col(low) + F.col(length) - 1) / width)
    return spans.where(F.col(length) > 0).withColumn("cell", F.explode(F.sequence(F.floor(F.col(low) / width), last)))


class Mix:
    """The parts of a mix: `sources`, `located` (documents in their streams), `slots` and `pieces`."""

    def __init__(self, docs: DataFrame, id_col="doc_id", text_col="text", source_col="source", block: int = BLOCK, weights=WEIGHTS, cap: int = CAP, seed: str = "mix", shard: int = 4096, keyed: bool = False):
        size = F.regexp_count(F.coalesce(F.col(text_col), F.lit("")), F.lit(WORD)).cast("long")
        key = row_key(F.col(id_col), F.col(source_col), F.col(text_col)) if keyed else F.lit(None).cast("binary")
        sized = kept(docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), size.alias("size"), key.alias("key")))
        src = source_targets(sized, weights, cap)
        blocks = F.ceil(F.col("source_size") / F.lit(block)).cast("long")
        draws = F.when(F.col("source_size") == 0, F.lit(0)).otherwise(F.floor(F.col("target") * blocks / F.col("source_size") + 0.5)).cast("long")
        src = src.withColumn("blocks", blocks).withColumn("draws", draws)
        src = src.withColumn("first_slot", F.coalesce(F.sum("draws").over(W.orderBy("sid").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
        self.block, self.seed, self.shard = block, seed, shard
        self.sources = materialize(src.withColumn("slots", F.sum("draws").over(W.partitionBy())).coalesce(1), "sources")
        self.located = self._located(sized)
        self.slots = self._slots()

    def _located(self, sized: DataFrame) -> DataFrame:
        """Each row's place in its source: sid, bucket, r (together unique), id, size, key, start."""
        place = keyed_hash(self.seed, "order", F.coalesce(F.col("id"), F.lit(-1)))
        rows = sized.join(self.sources.select("source", "sid", "source_size", "target"), sized["source"].eqNullSafe(self.sources["source"])).select("sid", "id", "size", "key", sized["source"], "source_size", "target", place.alias("place"))
        ranges = 1 << min(20, (sized.count() // BUCKET).bit_length())
        rows = rows.withColumn("bucket", F.shiftright("place", 48 - ranges.bit_length() + 1))
        order = W.partitionBy("sid", "bucket").orderBy("place", "id", "size", "key")
        before = F.coalesce(F.sum("size").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
        rows = rows.withColumn("r", F.row_number().over(order)).withColumn("before", before)
        sums = rows.groupBy("sid", "bucket").agg(F.sum("size").alias("n"))
        base = F.coalesce(F.sum("n").over(W.partitionBy("sid").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
        return rows.join(sums.select("sid", "bucket", base.alias("base")), ["sid", "bucket"]).withColumn("start", F.col("base") + F.col("before")).drop("base", "before")

    def drawn(self) -> DataFrame:
        """The multinomial draw: shard, sid, n (how many of the shard's slots drew the source)."""
        total, some = self.sources.agg(F.coalesce(F.max("slots"), F.lit(0)), F.count_if(F.col("draws") > 0)).first()
        width = max(1, total // max(1, 4 * some))
        slots = self.sources.sparkSession.range(0, total, 1, min(20_000, 1 + total // 65536))
        slots = slots.select(F.floor(F.col("id") / self.shard).alias("shard"), F.pmod(keyed_hash(self.seed, "draw", F.col("id")), F.lit(max(1, total))).alias("at"))
        owners = cells(self.sources.select("sid", "first_slot", "draws"), "first_slot", "draws", width)
        inside = (F.col("at") >= F.col("first_slot")) & (F.col("at") < F.col("first_slot") + F.col("draws"))
        return slots.withColumn("cell", F.floor(F.col("at") / width)).join(owners, "cell").where(inside).groupBy("shard", "sid").agg(F.count("*").alias("n"))

    def _slots(self) -> DataFrame:
        """One row for each slot: shard, slot, sid, pass, block."""
        drawn = kept(self.drawn()).withColumn("stretch", F.floor(F.col("shard") / STRIDE))
        sums = drawn.groupBy("sid", "stretch").agg(F.sum("n").alias("own"))
        base = F.coalesce(F.sum("own").over(W.partitionBy("sid").orderBy("stretch").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
        before = F.coalesce(F.sum("n").over(W.partitionBy("sid", "stretch").orderBy("shard").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
        # what a source drew too often or too seldom, end to end over the sources
        got = drawn.groupBy("sid").agg(F.sum("n").alias("got"))
        met = self.sources.where("draws > 0").select("sid", "draws", "blocks").join(got, "sid", "left").withColumn("got", F.coalesce("got", F.lit(0)))
        met = met.withColumn("over", F.greatest(F.col("got") - F.col("draws"), F.lit(0))).withColumn("under", F.greatest(F.col("draws") - F.col("got"), F.lit(0)))
        upto = W.orderBy("sid").rowsBetween(W.unboundedPreceding, -1)
        met = met.withColumn("over_at", F.coalesce(F.sum("over").over(upto), F.lit(0))).withColumn("under_at", F.coalesce(F.sum("under").over(upto), F.lit(0)))
        met = materialize(met.coalesce(1), "met")
        left, seldom = met.agg(F.coalesce(F.sum("under"), F.lit(0)), F.count_if(F.col("under") > 0)).first()
        width = max(1, left // max(1, 4 * seldom))

        runs = drawn.join(sums.select("sid", "stretch", base.alias("base")), ["sid", "stretch"]).withColumn("j", F.col("base") + before)
        runs = runs.join(met.select("sid", "draws", "over_at"), "sid").withColumn("keep", F.greatest(F.lit(0), F.least(F.col("n"), F.col("draws") - F.col("j"))))
        inner = runs.where("keep > 0").select("shard", "sid", "j", F.col("keep").alias("n"))
        x = F.col("over_at") + F.col("j") + F.col("keep") - F.col("draws")
        moved = runs.where("n > keep").select("shard", F.explode(F.sequence(x, x + F.col("n") - F.col("keep") - 1)).alias("x"))
        places = cells(met.select("sid", "got", "under", "under_at"), "under_at", "under", width)
        inside = (F.col("x") >= F.col("under_at")) & (F.col("x") < F.col("under_at") + F.col("under"))
        moved = moved.withColumn("cell", F.floor(F.col("x") / width)).join(places, "cell").where(inside)
        moved = moved.select("shard", "sid", (F.col("got") + F.col("x") - F.col("under_at")).alias("j"), F.lit(1).cast("long").alias("n"))

        total = self.sources.agg(F.coalesce(F.max("slots"), F.lit(0))).first()[0]
        tasks = min(20_000, 1 + total // 16384)  # by number, since the runs are tiny until they are spread out
        every = inner.unionByName(moved).repartition(tasks, "shard")
        each = every.select("shard", "sid", F.explode(F.sequence(F.col("j"), F.col("j") + F.col("n") - 1)).alias("j"))
        passes = met.select("sid", "blocks", F.explode(F.sequence(F.lit(0), F.floor((F.col("draws") - 1) / F.col("blocks")))).alias("pass"))
        passes = materialize(passes.withColumn("keys", round_keys(F.col("blocks"), self.seed, F.col("sid"), F.col("pass"))).coalesce(1), "passes")
        each = each.join(met.select("sid", F.col("blocks").alias("of")), "sid").withColumn("pass", F.floor(F.col("j") / F.col("of")))
        each = each.join(passes, ["sid", "pass"]).withColumn("block", permuted(F.col("j") % F.col("blocks"), F.col("blocks"), F.col("keys")))
        order = W.partitionBy("shard").orderBy(F.xxhash64("sid", "j"), "sid", "j")
        slot = F.col("shard") * self.shard + F.row_number().over(order) - 1
        return kept(each.select("shard", slot.alias("slot"), "sid", "pass", "block"))  # so that joins know its size

    def pieces(self) -> DataFrame:
        """The documents cut at block edges: located's columns, block, at (word in the document, from 0), words."""
        first, last = F.floor(F.col("start") / self.block), F.floor((F.col("start") + F.col("size") - 1) / self.block)
        cut = self.located.withColumn("block", F.explode_outer(F.when(F.col("size") > 0, F.sequence(first, last))))
        low, high = F.greatest(F.col("start"), F.col("block") * self.block), F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * self.block)
        return cut.withColumn("at", low - F.col("start")).withColumn("words", high - low)

    def taken(self) -> DataFrame:
        """One row for each document: id, source, size, source_size, target, taken."""
        times = self.slots.groupBy("sid", "block").agg(F.count("*").alias("times"))
        rows = self.pieces().join(times, ["sid", "block"], "left")
        out = rows.groupBy("sid", "bucket", "r").agg(*[F.first(c).alias(c) for c in ("id", "source", "size", "source_size", "target")], F.coalesce(F.sum(F.col("words") * F.col("times")), F.lit(0)).alias("taken"))
        return out.drop("sid", "bucket", "r")


def mix_documents(docs: DataFrame, **options) -> DataFrame:
    """docs as the mix takes them: a row for each pass that takes words of a document, with docs' columns.

    A document that a pass takes whole keeps its text; of others the words taken are joined by one space. n_chars,
    where there is such a column, is counted anew. Rows are told apart by one key of id, source and text, and rows that
    are equal in these by a number, so that rows that share an id, or have none, get their own words.
    """
    mix = Mix(docs, keyed=True, **options)
    mix.located = mix.located.withColumn("k", F.row_number().over(W.partitionBy("key").orderBy("start")))
    used = mix.pieces().join(mix.slots.select("sid", "block", "pass"), ["sid", "block"])
    runs = used.groupBy("key", "k", "pass").agg((F.sum("words") == F.first("size")).alias("__whole"), F.array_sort(F.collect_list(F.struct("at", "words"))).alias("__runs"))
    runs = runs.select(F.col("key").alias("__at"), F.col("k").alias("__of"), "__whole", "__runs")
    plain = [F.col(c) for c, t in docs.dtypes if not t.startswith(("map", "variant"))]
    rows = docs.withColumn("__key", row_key(F.col("doc_id"), F.col("source"), F.col("text")))
    rows = rows.withColumn("__k", F.row_number().over(W.partitionBy("__key").orderBy(F.xxhash64(*plain))))
    found = rows.join(runs, (F.col("__key") == F.col("__at")) & (F.col("__k") - F.col("__of") == 0))  # texts are dealt once, by key
    words = F.regexp_extract_all(F.col("text"), F.lit(f"({WORD})"), F.lit(1))
    chosen = let(words, lambda w: F.array_join(F.flatten(F.transform("__runs", lambda p: F.slice(w, (p["at"] + 1).cast("int"), p["words"].cast("int")))), " "))
    found = found.withColumn("text", F.when(F.col("__whole"), F.col("text")).otherwise(chosen))
    if "n_chars" in docs.columns:
        found = found.withColumn("n_chars", F.length("text").cast("long"))
    return found.select(*docs.columns)


def op9_source_mix(spark, sf_dir: str) -> DataFrame:
    mixed = Mix(spark.read.parquet(f"{sf_dir}/documents.parquet")).taken()
    return mixed.select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken")


def _rounds() -> str:
    """The block permutation's rounds, one query each: p0 has sid, pass, blocks and x."""
    out = []
    for r in range(ROUNDS):
        out.append(f"q{r} AS (SELECT *, ((('0x' || substr(md5('k{r}:mix:' || sid || ':' || pass), 1, 12))::BIGINT % blocks - x) % blocks + blocks) % blocks AS y FROM p{r})")
        out.append(f"p{r + 1} AS (SELECT sid, pass, blocks, CASE WHEN ascii(md5('b{r}:mix:' || sid || ':' || pass || ':' || greatest(x, y))) % 2 = 1 THEN y ELSE x END AS x FROM q{r})")
    return ",\n".join(out)


OP9_SQL = f"""
WITH sized AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size FROM documents),
s1 AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS sid FROM sized GROUP BY source),
s2 AS (SELECT *, {list(WEIGHTS)}[((sid - 1) % {len(WEIGHTS)} + 1)::INT]::BIGINT AS weight, sum(source_size) OVER ()::BIGINT AS total FROM s1),
s3 AS (SELECT *, source_size * {CAP}::DOUBLE / weight AS fill FROM s2),
s4 AS (
  SELECT *, (total - coalesce(sum(source_size * {CAP}) OVER (ORDER BY fill, sid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS remaining,
    sum(weight) OVER (ORDER BY fill, sid ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::BIGINT AS share FROM s3
), s5 AS (SELECT *, fill * share < remaining AS filled FROM s4),
s6 AS (SELECT *, sum(CASE WHEN filled THEN 0 ELSE 1 END) OVER (ORDER BY fill, sid ROWS UNBOUNDED PRECEDING) AS opened FROM s5),
s7 AS (SELECT *, max(CASE WHEN opened = 1 AND NOT filled THEN remaining END) OVER () AS rest, max(CASE WHEN opened = 1 AND NOT filled THEN share END) OVER () AS among FROM s6),
s8 AS (
  SELECT source, sid, source_size, CASE WHEN source_size = 0 THEN 0 WHEN opened = 0 THEN (source_size * {CAP})::DOUBLE ELSE (weight * rest)::DOUBLE / among::DOUBLE END AS target,
    (source_size + {BLOCK - 1}) // {BLOCK} AS blocks FROM s7
), src AS (SELECT *, CASE WHEN source_size = 0 THEN 0 ELSE floor(target * blocks / source_size + 0.5)::BIGINT END AS draws FROM s8),
located AS (
  SELECT *, row_number() OVER o AS r, (coalesce(sum(size) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS start
  FROM (SELECT z.doc_id, z.size, src.sid, src.source_size, src.target, ('0x' || substr(md5('mix:order:' || coalesce(z.doc_id, -1)), 1, 12))::BIGINT AS place
        FROM sized z JOIN src ON z.source IS NOT DISTINCT FROM src.source)
  WINDOW o AS (PARTITION BY sid ORDER BY place, doc_id NULLS FIRST, size)
), draws AS (SELECT sid, blocks, unnest(range(draws)) AS j FROM src WHERE draws > 0),
p0 AS (SELECT sid, j // blocks AS pass, blocks, j % blocks AS x FROM draws),
{_rounds()},
times AS (SELECT sid, x AS block, count(*) AS times FROM p{ROUNDS} GROUP BY ALL),
cut AS (SELECT *, unnest(range(start // {BLOCK}, (start + size - 1) // {BLOCK} + 1)) AS block FROM located WHERE size > 0),
got AS (
  SELECT cut.sid, cut.r, sum((least(start + size, (cut.block + 1) * {BLOCK}) - greatest(start, cut.block * {BLOCK})) * times.times)::BIGINT AS taken
  FROM cut JOIN times USING (sid, block) GROUP BY ALL
)
SELECT located.doc_id, located.size, located.source_size, located.target, coalesce(got.taken, 0) AS taken FROM located LEFT JOIN got USING (sid, r)
"""
