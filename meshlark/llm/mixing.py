"""Operator 10: mix sources to target weights. DataFrame operations only.

1. *Targets.* Every source gets a share of the total in proportion to its weight, at most
   ``most`` times its own size; what exceeds that is shared again by weight. The fixed point is
   found in one pass: sources in the order in which they reach their limit.
2. *Blocks.* The words of a source, documents one after the other, form one stream, cut into
   blocks of ``block`` words. Positions come from sums within pseudorandom shards of the
   source and the offsets of the shards, so a source with most of the rows is no single task.
3. *Counts.* The output is a sequence of shards of ``slots`` blocks. Each source has the whole
   part of its expected count in every shard, and the rest of the shard's slots are drawn from
   the multinomial distribution of the fractional parts (residual multinomial sampling). What is drawn for a source
   beyond ``most`` times its blocks is drawn again, in one more shard, for the sources that are furthest below
   their expected numbers.
4. *Permutation.* The j-th slot of a source with n blocks takes block ``p(j mod n)``, where
   ``p`` is a swap-or-not shuffle of 0..n-1 keyed by source and epoch ``j div n``: a bijection
   for any n, computed for one index alone. No block is taken more than ``most`` times.
5. *Join.* Slots meet blocks by (source, block); a document's ``taken`` is the words of it in
   the blocks taken, repeats counted. :func:`mixed_documents` has these words themselves.

Everything pseudorandom is a hash of ``seed`` and indices, so reruns agree.

Defined cases: null text has size 0; the null source is a source, the last; documents of size
0 take 0; a repeated row is one more document; sources that tie in the order of limits go by name; a very long
text is cut into its blocks like a source's other words; an empty table, or one without any word, gives
targets of 0 and takes nothing.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from meshlark.llm.common import free_names, materialise, word_count

#: Words in a block, blocks in an output shard, shards into which a source's documents are dealt.
BLOCK, SLOTS, SPREAD = 128, 1024, 1024
#: Rounds of the shuffle; output shards in a range of them.
ROUNDS, RANGE = 24, 4096


def _uniform(*cols: Column) -> Column:
    """A number in [0, 1) from a hash."""
    return F.pmod(F.xxhash64(*cols), F.lit(1 << 52)).cast("double") / float(1 << 52)


def permuted(index: Column, n: Column, *key: Column) -> Column:
    """Where a keyed pseudorandom permutation of 0 .. n-1 sends ``index`` (swap-or-not shuffle)."""

    def swap(x: Column, k: Column) -> Column:
        partner = F.pmod(F.pmod(F.xxhash64(*key, k), n) - x + n, n)
        return F.when(F.xxhash64(*key, k, F.greatest(x, partner)).bitwiseAND(F.lit(1 << 20)) != 0, partner).otherwise(x)

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), index, swap)


def source_targets(sizes: DataFrame, *, most: float = 3.0, weights: int = 3) -> DataFrame:
    """``(source, source_size, weight, target)`` from ``(source, source_size)``; one row per source."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    ranked = sizes.withColumn("weight", ((F.row_number().over(order) - 1) % weights + 1).cast("double"))
    by_limit = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last())
    before, after = by_limit.rowsBetween(Window.unboundedPreceding, -1), by_limit.rowsBetween(0, Window.unboundedFollowing)
    whole = Window.partitionBy()
    level = (F.sum("source_size").over(whole) - most * F.coalesce(F.sum("source_size").over(before), F.lit(0))) / F.sum("weight").over(after)
    rated = ranked.withColumn("level", level)
    # The least level is wrong only for sources at their limit, which come first in this order.
    fits = F.when(F.col("level") * F.col("weight") <= most * F.col("source_size"), F.col("level"))
    return rated.withColumn("fits", fits).select(
        "source",
        "source_size",
        "weight",
        F.least(most * F.col("source_size"), F.col("weight") * F.coalesce(F.max("fits").over(whole), F.lit(float("inf")))).alias("target"),
    )


def mix(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    block: int = BLOCK,
    slots: int = SLOTS,
    most: int = 3,
    seed: int = 42,
) -> DataFrame:
    """``(id, text_hash, source, size, source_size, target, taken)``, a row for each row of ``docs``."""
    narrow = docs.select(F.col(id_col).alias("id"), _text_hash(text_col).alias("text_hash"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"))
    located, pieces = _taken_pieces(narrow.withColumn("row", F.monotonically_increasing_id()), block=block, slots=slots, most=most, seed=seed)
    taken = pieces.groupBy("row").agg(F.sum((F.col("upto") - F.col("from")) * F.col("times")).alias("taken"))
    return located.join(taken, "row", "left").select("id", "text_hash", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def _text_hash(text_col: str) -> Column:
    return F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))


def _taken_pieces(rows: DataFrame, *, block: int, slots: int, most: int, seed: int) -> tuple[DataFrame, DataFrame]:
    """Where the ``(row, id, text_hash, source, size)`` lie in their sources, and ``(row, from, upto, times)`` of the words taken of them."""
    sized = materialise(rows, "sizes")
    sized = sized.withColumn("spread", F.pmod(F.xxhash64(F.lit(seed), "id", "text_hash"), F.lit(SPREAD)))
    parts = materialise(sized.groupBy("source", "spread").agg(F.sum("size").alias("part")), "parts")
    # Per source, no more rows than SPREAD reach these windows, however many documents it has.
    offsets = parts.withColumn("offset", F.sum("part").over(Window.partitionBy("source").orderBy("spread")) - F.col("part")).drop("part")
    sources = source_targets(parts.groupBy("source").agg(F.sum("part").alias("source_size")), most=most)
    sources = sources.withColumn("blocks", F.ceil(F.col("source_size") / block).cast("long"))
    number = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())).cast("long")
    sources = materialise(sources.withColumn("number", number), "sources")

    located = (
        sized.join(offsets, sized["source"].eqNullSafe(offsets["source"]) & (sized["spread"] == offsets["spread"]))
        .select("row", sized["id"], "text_hash", sized["source"], "size", sized["spread"], "offset")
        .withColumn("end", F.sum("size").over(Window.partitionBy("source", "spread").orderBy("id", "text_hash").rowsBetween(Window.unboundedPreceding, 0)) + F.col("offset"))
        .withColumn("begin", F.col("end") - F.col("size"))
    )
    known = sources.select(F.col("source").alias("s"), "number", "source_size", "target", "blocks")
    located = materialise(located.join(known, located["source"].eqNullSafe(known["s"])).drop("s", "offset", "spread"), "located")

    spans = F.explode(F.sequence(F.floor(F.col("begin") / block), F.floor((F.col("end") - 1) / block)))
    pieces = located.where("size > 0").select("row", "number", "begin", "end", spans.alias("block"))
    first, last = F.greatest("begin", F.col("block") * block), F.least("end", (F.col("block") + 1) * block)
    pieces = pieces.select("row", "number", "block", (first - F.col("begin")).alias("from"), (last - F.col("begin")).alias("upto"))
    return located, pieces.join(block_draws(sources, slots=slots, most=most, seed=seed), ["number", "block"]).select("row", "from", "upto", "times")


def wanted_blocks(sources: DataFrame) -> tuple[list[float], list[int]]:
    """For the sources by ``number``: how many blocks the mix should take, and how many there are.

    The sources (one row each) are literals of the plan; a mixture has tens or thousands of them,
    however many documents they hold.
    """
    rows = sources.select("number", "source_size", "target", "blocks").orderBy("number").collect()
    # A source's blocks hold source_size / blocks words on average, as its last one is short.
    return [r["target"] * r["blocks"] / r["source_size"] if r["source_size"] else 0.0 for r in rows], [r["blocks"] for r in rows]


def redrawn(wanted: list[float], got: list[int], limit: list[int]) -> list[int]:
    """What to add to ``got``, so that none is over its ``limit``: the excess goes to those furthest below ``wanted``."""
    change = [min(0, most - n) for n, most in zip(got, limit, strict=True)]
    excess = -sum(change)
    for k in sorted(range(len(got)), key=lambda k: got[k] - wanted[k]):
        room = max(0, min(limit[k] - got[k], math.ceil(wanted[k] - got[k])))
        change[k] += min(room, excess)
        excess -= min(room, excess)
    return change


def shard_counts(spark: SparkSession, wanted: list[float], *, slots: int, seed: int) -> DataFrame:
    """``(number, shard, count)``: how many slots of each output shard each source is drawn for."""
    total = sum(wanted)
    length = round(total)
    share = F.array(*[F.lit(w / total) for w in wanted]) if length else F.array().cast("array<double>")
    here = F.least(F.lit(slots).cast("long"), F.lit(length) - F.col("shard") * slots)
    shard = spark.range(-(-length // slots)).select(F.col("id").alias("shard")).withColumn("here", here).withColumn("share", share)
    shard = shard.withColumn("expected", F.transform("share", lambda p: p * F.col("here"))).drop("share")
    shard = shard.withColumn("whole", F.transform("expected", lambda e: F.floor(e + 1e-9)))
    shard = shard.withColumn("part", F.zip_with("expected", "whole", lambda e, w: F.greatest(e - w, F.lit(0.0))))
    grown = F.aggregate("part", F.array(F.lit(0.0)), lambda acc, p: F.concat(acc, F.array(F.element_at(acc, -1) + p)))
    shard = shard.withColumn("upto", F.slice(grown, 2, F.size("part"))).withColumn("given", F.aggregate("whole", F.lit(0).cast("long"), lambda a, w: a + w))
    fixed = shard.select("shard", F.posexplode("whole").alias("k", "count"))
    draws = shard.where("here > given").select("shard", "upto", F.explode(F.sequence(F.lit(1).cast("long"), F.col("here") - F.col("given"))).alias("draw"))
    point = draws.withColumn("u", _uniform(F.lit(seed), F.lit("draw"), F.col("shard"), F.col("draw")) * F.element_at("upto", -1))
    drawn = point.select("shard", F.least(F.size(F.filter("upto", lambda x: x <= F.col("u"))), F.size("upto") - 1).alias("k"), F.lit(1).cast("long").alias("count"))
    both = fixed.union(drawn).groupBy("k", "shard").agg(F.sum("count").alias("count"))
    return both.select((F.col("k") + 1).cast("long").alias("number"), "shard", "count")


def placed_counts(sources: DataFrame, *, slots: int = SLOTS, most: int = 3, seed: int = 42) -> DataFrame:
    """``(number, shard, start, count, blocks)``: where a shard's slots of a source begin among all of that source's."""
    spark = sources.sparkSession
    wanted, blocks = wanted_blocks(sources)
    counts = materialise(shard_counts(spark, wanted, slots=slots, seed=seed), "counts")
    # Sums of ranges of shards come first, so no window is over all shards of a source.
    ranges = materialise(counts.groupBy("number", F.floor(F.col("shard") / RANGE).alias("range")).agg(F.sum("count").alias("inside")), "ranges")
    per = {r["number"]: r["n"] for r in ranges.groupBy("number").agg(F.sum("inside").alias("n")).collect()}
    got = [per.get(k + 1, 0) for k in range(len(wanted))]
    change = redrawn(wanted, got, [most * b for b in blocks])
    offset = ranges.select("number", "range", (F.sum("inside").over(Window.partitionBy("number").orderBy("range")) - F.col("inside")).alias("offset"))
    here = Window.partitionBy("number", "range").orderBy("shard")
    within = counts.withColumn("range", F.floor(F.col("shard") / RANGE)).withColumn("before", F.sum("count").over(here) - F.col("count"))
    placed = within.join(offset, ["number", "range"]).select("number", "shard", (F.col("offset") + F.col("before")).alias("start"), "count")
    known = F.array(*[F.lit(b).cast("long") for b in blocks]) if blocks else F.array().cast("array<long>")
    # A source whose draws are taken back ends earlier; one that gets more has them in one shard after the last.
    ends = F.array(*[F.lit(n + min(0, c)).cast("long") for n, c in zip(got, change, strict=True)]) if got else known
    at = F.col("number").cast("int")
    placed = placed.withColumn("count", F.greatest(F.lit(0).cast("long"), F.least("count", F.element_at(ends, at) - F.col("start"))))
    more = [(k + 1, -1, n, c) for k, (n, c) in enumerate(zip(got, change, strict=True)) if c > 0]
    if more:
        placed = placed.unionByName(spark.createDataFrame(more, "number long, shard long, start long, count long"))
    return placed.where("count > 0").withColumn("blocks", F.element_at(known, at))


def block_draws(sources: DataFrame, *, slots: int = SLOTS, most: int = 3, seed: int = 42) -> DataFrame:
    """``(number, block, times)`` for the blocks that the mix takes at least once."""
    placed = placed_counts(sources, slots=slots, most=most, seed=seed)
    # Few rows become many here: deal them out first, to a number of tasks that is not merged again.
    placed = placed.repartition(int(placed.sparkSession.conf.get("spark.sql.shuffle.partitions")), "number", "shard")
    slot = placed.select("number", "blocks", F.explode(F.sequence("start", F.col("start") + F.col("count") - 1)).alias("j"))
    epoch = F.floor(F.col("j") / F.col("blocks"))
    taken = permuted(F.pmod("j", "blocks"), F.col("blocks"), F.lit(seed), F.col("number"), epoch)
    return slot.select("number", taken.alias("block")).groupBy("number", "block").agg(F.count(F.lit(1)).alias("times"))


def mixed_documents(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    chars_col: str | None = "n_chars",
    block: int = BLOCK,
    slots: int = SLOTS,
    most: int = 3,
    seed: int = 42,
) -> DataFrame:
    """What the mix takes: a row for each row of ``docs`` of which it takes words, with all its columns.

    The text is the words of the blocks taken, with what separates them, in their order; those that are taken a
    second and a third time follow on lines of their own. A text that is taken whole and once stays as it is.
    ``chars_col``, where the table has it, is set to the new number of code points of the texts that change.
    """
    columns = docs.columns
    row, parts, times, took, size, new = free_names(docs, "row", "parts", "times", "took", "size", "mixed")
    # Written first, as rows are named by number.
    rows = materialise(docs.withColumn(row, F.monotonically_increasing_id()), "mixed")
    narrow = rows.select(F.col(row).alias("row"), F.col(id_col).alias("id"), _text_hash(text_col).alias("text_hash"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"))
    located, pieces = _taken_pieces(narrow, block=block, slots=slots, most=most, seed=seed)
    # One entry for each piece, however often it is taken; a document has no more than its blocks.
    all_parts = F.sort_array(F.collect_list(F.struct("from", "upto", "times")))
    takes = pieces.groupBy("row").agg(all_parts.alias(parts), F.sum((F.col("upto") - F.col("from")) * F.col("times")).alias(took), F.max("times").alias(times))
    takes = takes.join(located.select("row", F.col("size").alias("all_words")), "row").select(F.col("row").alias(row), parts, took, times, F.col("all_words").alias(size))

    def draw(tokens: Column, k: Column) -> Column:
        mine = F.filter(parts, lambda p: p["times"] >= k)
        return F.array_join(F.transform(mine, lambda p: F.array_join(F.slice(tokens, (p["from"] + 1).cast("int"), (p["upto"] - p["from"]).cast("int")), "")), "")

    # Words with what follows them; as an argument of a lambda, they are found once for a text.
    split = F.array(F.regexp_extract_all(F.col(text_col), F.lit(r"([^\x20\x09-\x0D]+[\x20\x09-\x0D]*)"), F.lit(1)))
    cut = F.element_at(F.transform(split, lambda tokens: F.array_join(F.transform(F.sequence(F.lit(1).cast("long"), F.col(times)), lambda k: draw(tokens, k)), "\n")), 1)
    whole = (F.col(times) == 1) & (F.col(took) == F.col(size))
    out = rows.join(takes, row).withColumn(new, F.when(~whole, cut))
    if chars_col in columns:
        out = out.withColumn(chars_col, F.when(F.col(new).isNotNull(), F.length(new).cast(docs.schema[chars_col].dataType)).otherwise(F.col(chars_col)))
    return out.withColumn(text_col, F.coalesce(new, text_col)).select(*[f"`{c}`" for c in columns])
