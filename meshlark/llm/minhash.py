"""Operator 1: document fingerprints by one-permutation MinHash. DataFrame operations only.

Every shingle of ``shingle`` words (all words, if there are fewer) is hashed once; the hash
names a bin and a value, and each bin keeps its least value. An empty bin borrows the value of
a full one, the first in a pseudorandom order of bins of its own (optimal densification), so
bins of two texts still agree with the probability of their Jaccard similarity. A fingerprint
stores the ``bits`` low-order bits of a hash of each bin's value, packed. Of two fingerprints'
bins a share ``m`` agrees; values that differ agree in ``bits`` bits by chance with probability
``c = 2 ** -bits``, so the likeness is ``(m - c) / (1 - c)``, at least 0.

A fingerprint is made within a row, by functions on arrays: no shuffle.

Defined cases: a text without words (null, empty, white space) has the fingerprint '', whose
likeness is 1 to itself and 0 to any other; equal word sequences have equal fingerprints; a
text of any length is hashed whole; repeated rows are fingerprinted alike; an empty table gives
an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meshlark.llm.common import SEPARATORS, materialise

#: Bins and bits of each. A fingerprint is a string of BINS * BITS / 4 hexadecimal digits.
BINS, BITS, SHINGLE = 128, 8, 5
#: Rows in a range, about, when documents are put in order; most ranges; sampled keys for each.
RANGE, RANGES, EACH = 4096, 1 << 16, 20


def with_fingerprint(df: DataFrame, text_col: str, out: str, *, shingle: int = SHINGLE, bins: int = BINS) -> DataFrame:
    """``df`` with the column ``out``: the fingerprint of ``text_col``, two hexadecimal digits a bin.

    ``bins`` is a power of two, 128 at most.
    """
    w, h, k, full, empty, filled = (f"__{x}_{out}" for x in ("words", "hashes", "sorted", "full", "empty", "filled"))
    shift = 63 - (bins.bit_length() - 1)
    df = df.withColumn(w, F.transform(F.array_remove(F.split(F.coalesce(F.col(text_col), F.lit("")), SEPARATORS), ""), lambda x: F.xxhash64(x)))
    last = F.greatest(F.size(w) - shingle, F.lit(0))
    one = F.when(F.size(w) >= shingle, F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(*[F.get(F.col(w), i + j) for j in range(shingle)])))
    short = F.array(F.aggregate(F.col(w), F.lit(0).cast("long"), lambda acc, x: F.xxhash64(acc, x)))
    df = df.withColumn(h, F.when(F.size(w) == 0, F.array().cast("array<long>")).otherwise(F.coalesce(one, short)))
    # Non-negative and sorted, with the bin in the upper bits: each bin's first element is its least.
    # Every bin also gets its greatest possible value, which stays only where no hash fell.
    ends = F.array(*[F.lit(((b + 1) << shift) - 1).cast("long") for b in range(bins)])
    df = df.withColumn(k, F.sort_array(F.concat(F.transform(h, lambda x: F.shiftrightunsigned(x, 1)), ends))).withColumn(empty, F.size(w) == 0).drop(w, h)
    first = F.filter(k, lambda x, i: (i == 0) | (F.shiftright(x, shift) != F.shiftright(F.get(F.col(k), i - 1), shift)))
    df = df.withColumn(full, first).drop(k)

    def is_end(x: Column) -> Column:
        return x.bitwiseAND(F.lit((1 << shift) - 1)) == (1 << shift) - 1

    df = df.withColumn(filled, F.transform(F.filter(full, lambda y: ~is_end(y)), lambda y: F.shiftright(y, shift)))

    def borrowed(x: Column) -> Column:
        """The value of the full bin that comes first in this empty bin's own order."""
        ranked = F.transform(filled, lambda b: F.xxhash64(x, b).bitwiseAND(F.lit(-bins)).bitwiseOR(b))
        return F.get(F.col(full), F.array_min(ranked).bitwiseAND(F.lit(bins - 1)).cast("int"))

    values = F.transform(full, lambda x: F.when(is_end(x), borrowed(x)).otherwise(x))
    low = F.transform(values, lambda x: F.lpad(F.hex(F.xxhash64(x).bitwiseAND(F.lit((1 << BITS) - 1))), BITS // 4, "0"))
    return df.withColumn(out, F.when(F.col(empty), F.lit("")).otherwise(F.lower(F.array_join(low, "")))).drop(full, empty, filled)


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard similarity of two fingerprints' shingle sets, 0 to 1."""
    digits = BITS // 4
    n = F.length(a) / digits
    same = F.aggregate(
        F.sequence(F.lit(0), (n - 1).cast("int")),
        F.lit(0),
        lambda acc, i: acc + (F.substr(a, i * digits + 1, F.lit(digits)) == F.substr(b, i * digits + 1, F.lit(digits))).cast("int"),
    )
    chance = 2.0**-BITS
    return F.when((a == "") | (b == ""), (a == b).cast("double")).otherwise(F.greatest(F.lit(0.0), (same / n - chance) / (1 - chance)))


def _literals(values: list[int]) -> Column:
    """An array of longs that the optimiser folds into one literal."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<long>") if values else F.array().cast("array<long>")


def _range_of(key: Column, tie: Column, cuts: list[tuple[int, int]]) -> Column:
    """How many of the ascending ``cuts`` lie below ``(key, tie)``, by binary search."""
    keys, ties = _literals([c[0] for c in cuts]), _literals([c[1] for c in cuts])
    state = F.struct(F.lit(0).alias("low"), F.lit(len(cuts)).alias("high"))

    def halve(acc: Column, _: Column) -> Column:
        mid = F.floor((acc["low"] + acc["high"]) / 2).cast("int")
        over = (key > F.get(keys, mid)) | ((key == F.get(keys, mid)) & (tie > F.get(ties, mid)))
        half = F.when(over, F.struct((mid + 1).alias("low"), acc["high"].alias("high"))).otherwise(F.struct(acc["low"].alias("low"), mid.alias("high")))
        return F.when(acc["low"] >= acc["high"], acc).otherwise(half)

    return F.aggregate(F.sequence(F.lit(1), F.lit(max(1, len(cuts).bit_length()))), state, halve, lambda acc: acc["low"])


def range_cuts(keys: DataFrame, size: int = RANGE) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """Cuts of the pairs ``(key, tie)`` into ranges of about ``size`` rows, and the pairs that are a range by themselves.

    A sample of ``EACH`` pairs a range comes to the driver, for ``RANGES`` ranges at most.
    """
    rows = keys.count()
    ranges = max(1, min(RANGES, rows // size))
    if ranges == 1:
        return [], []
    rate = min(1.0, ranges * EACH / rows)
    drawn = keys.where(F.rand(7) < rate).orderBy("key", "tie").collect()
    cuts = [(r["key"], r["tie"]) for r in drawn[:: max(1, round(len(drawn) / ranges))][1:]]
    heavy = sorted({a for a, b in zip(cuts, cuts[1:]) if a == b})
    return sorted(set(cuts)), heavy


def in_order(rows: DataFrame, *, size: int = RANGE) -> DataFrame:
    """``rows(key, tie, text)`` with ``fingerprint`` and ``next``, the text and fingerprint that follow in order of key and tie.

    After the last row comes the first. A window within each range of keys gives the next row, and a range's
    last row gets the first one of the next range. Where one key holds many rows, ranges cut its ties. Rows of one
    key and tie are of one text; where they are as many as a range, one of them stands for all in the order, and
    the others follow each other.
    """
    keys = materialise(rows.select("key", "tie"), "keys")
    cuts, heavy = range_cuts(keys, size)
    single = rows
    if heavy:
        wide = keys.sparkSession.createDataFrame(heavy, "key long, tie long").withColumn("heavy", F.lit(True))  # RANGES pairs at most
        marked = rows.join(F.broadcast(wide), ["key", "tie"], "left").withColumn("heavy", F.coalesce("heavy", F.lit(False)))
        others = [F.first(c).alias(c) for c in rows.columns if c not in ("key", "tie")]
        same = materialise(marked.where("heavy").groupBy("key", "tie").agg(F.count(F.lit(1)).alias("many"), *others), "copies")
        single = marked.where("not heavy").select(*rows.columns).unionByName(same.select(*rows.columns))

    here, where = F.struct("text", "fingerprint"), _range_of(F.col("key"), F.col("tie"), cuts)
    # The first row of each range, found by its key alone; only these rows' texts are read again.
    firsts = materialise(keys.withColumn("range", where).groupBy("range").agg(F.min(F.struct("key", "tie")).alias("k")).select("range", "k.*"), "firsts")
    order = Window.orderBy("range")  # a narrow row for each range: RANGES + 1 at most
    after = firsts.select("range", F.coalesce(F.lead("range").over(order), F.first("range").over(order)).alias("after"))
    first_rows = rows.join(F.broadcast(firsts), ["key", "tie"]).groupBy("range").agg(F.first("text").alias("text"))
    first_rows = with_fingerprint(materialise(first_rows, "first-texts"), "text", "fingerprint").select(F.col("range").alias("after"), here.alias("first"))
    follow = materialise(after.join(first_rows, "after").select("range", "first"), "follow")
    placed = with_fingerprint(single.withColumn("range", where), "text", "fingerprint")
    led = placed.withColumn("next", F.lead(here).over(Window.partitionBy("range").orderBy("key", "tie")))
    # Both sides meet by range, by which the window has dealt the rows already.
    led = led.join(follow.hint("merge"), "range").withColumn("next", F.coalesce("next", "first")).drop("range", "first")
    if heavy:
        copies = with_fingerprint(same.where("many > 1"), "text", "fingerprint").withColumn("next", here)
        copies = copies.withColumn("copy", F.explode(F.sequence(F.lit(2).cast("long"), "many")))
        led = led.unionByName(copies.select(*led.columns))
    return led


def edited_fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", size: int = RANGE) -> DataFrame:
    """For every row of ``docs``, its fingerprint, that of its edited text, and how alike they are.

    The edited text has the first half of the text and, in place of the last floor(n / 2) code
    points, as many of the next document's first (all, if it has fewer). Returns ``(id, text,
    n_chars, edited, fingerprint, edited_fingerprint, near_edited, near_next)``.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), text.alias("text"), F.coalesce(F.col(id_col).cast("long"), F.lit(2**63 - 1)).alias("key"), F.xxhash64(text).alias("tie"))
    led = in_order(rows, size=size)
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substr("text", F.lit(1), n - half), F.substr(F.col("next.text"), F.lit(1), half))
    out = with_fingerprint(led.withColumn("edited", edited), "edited", "edited_fingerprint")
    return out.select(
        "id",
        "text",
        n.cast("long").alias("n_chars"),
        "edited",
        "fingerprint",
        "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
        likeness(F.col("fingerprint"), F.col("next.fingerprint")).alias("near_next"),
    )
