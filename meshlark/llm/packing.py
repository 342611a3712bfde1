"""Operator 8: pack documents into padded batches, in length buckets that minimise padding.

1. A document of more than ``context`` tokens is cut into pieces of ``context`` tokens and a
   rest; every piece is packed, so no token is lost. Documents without tokens have no piece.
2. The histogram of piece lengths over the whole table has at most ``context`` rows. Dynamic
   programming over it picks the ``buckets`` upper boundaries with the least total padding.
   The cost satisfies the quadrangle inequality, so each layer is solved by divide and conquer.
3. In a bucket with boundary ``b``, a batch holds ``max(1, budget // b)`` pieces, each padded to
   ``b``. Pieces are ordered by a hash; their ranks come from ranks in shards of the bucket and
   the shards' offsets, so a bucket with most of the rows is no single task. Every batch of a
   bucket but its last is full.

Tokens are words unless ``tokens`` gives another column expression.

Defined cases: null and empty texts have no pieces and no row in the result of :func:`pack`;
repeated rows are packed one by one, and which of two goes first may differ; ties of the optimum go to the
earliest split; a very long text is cut into as many pieces as it needs; fewer distinct lengths than ``buckets`` give that many
buckets and no padding; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meshlark.llm.common import materialise, word_count

CONTEXT, BUCKETS, BUDGET, SPREAD = 2048, 16, 16384, 256


def boundaries(lengths, counts, buckets: int = BUCKETS) -> list[int]:
    """The upper bucket boundaries (some of ``lengths``) with the least padding, ascending.

    ``lengths`` ascend strictly; the last one is always a boundary. Of equal optima, each
    layer takes the earliest split.
    """
    x, n = np.asarray(lengths, np.int64), len(lengths)
    if not n:
        return []
    many = np.r_[0, np.cumsum(np.asarray(counts, np.int64))]
    mass = np.r_[0, np.cumsum(x * np.asarray(counts, np.int64))]
    layers = min(buckets, n)
    best = x * many[1:] - mass[1:]
    splits = []
    for _ in range(layers - 1):
        now, split = best.copy(), np.full(n, -1)
        todo = [(0, n - 1, 0, n - 1)]
        while todo:
            low, high, first, last = todo.pop()
            if low > high:
                continue
            mid = (low + high) // 2
            k = np.arange(first, min(mid - 1, last) + 1)
            if len(k):
                cost = best[k] + x[mid] * (many[mid + 1] - many[k + 1]) - (mass[mid + 1] - mass[k + 1])
                at = int(np.argmin(cost))
                if cost[at] < now[mid]:
                    now[mid], split[mid] = cost[at], k[at]
                first_next = int(k[at])
            else:
                first_next = first
            todo += [(low, mid - 1, first, first_next), (mid + 1, high, first_next, last)]
        splits.append(split)
        best = now
    out, at = [], n - 1
    for split in reversed(splits):
        out.append(int(x[at]))
        if split[at] < 0:
            at = -1
            break
        at = int(split[at])
    if at >= 0:
        out.append(int(x[at]))
    return sorted(set(out))


def pack(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    tokens: Column | None = None,
    context: int = CONTEXT,
    buckets: int = BUCKETS,
    budget: int = BUDGET,
    with_text: bool = False,
) -> DataFrame:
    """``(id, piece, first_token, n_tokens, bucket, padded, batch, slot)``, a row for each piece.

    A piece is the ``n_tokens`` tokens of its document from ``first_token`` on (counted from 0). ``bucket`` counts
    from 0 by length, ``batch`` from 0 within its bucket, ``slot`` from 0 within its batch; ``padded`` is the
    bucket's boundary. ``with_text`` (only where tokens are words) adds ``text``: the piece's words with what
    separates them.
    """
    count = word_count(F.col(text_col)) if tokens is None else tokens
    text_hash = F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))
    carried = [F.col(text_col).alias("whole")] if with_text else []
    sized = docs.select(F.col(id_col).alias("id"), text_hash.alias("text_hash"), count.cast("long").alias("tokens"), *carried).where("tokens > 0")
    numbers = F.sequence(F.lit(0).cast("long"), F.floor((F.col("tokens") - 1) / context))
    if with_text:
        # Words with what follows them; as an argument of a lambda, they are found once for a text.
        split = F.array(F.regexp_extract_all("whole", F.lit(r"([^\x20\x09-\x0D]+[\x20\x09-\x0D]*)"), F.lit(1)))
        cut = F.element_at(F.transform(split, lambda w: F.transform(numbers, lambda k: F.array_join(F.slice(w, (k * context + 1).cast("int"), context), ""))), 1)
        pieces = sized.select("id", "text_hash", "tokens", F.posexplode(F.when(F.col("tokens") > context, cut).otherwise(F.array("whole"))).alias("piece", "text"))
        pieces = pieces.withColumn("piece", F.col("piece").cast("long")).withColumn("row", F.monotonically_increasing_id())
    else:
        pieces = sized.select("id", "text_hash", "tokens", F.explode(numbers).alias("piece"))
    extra = ["row", "text"] if with_text else []
    first = (F.col("piece") * context).alias("first_token")
    stored = materialise(pieces.select("id", "text_hash", "piece", first, F.least(F.lit(context).cast("long"), F.col("tokens") - F.col("piece") * context).alias("n_tokens"), *extra), "pieces")
    pieces = stored.drop("text")

    histogram = pieces.groupBy("n_tokens").count().orderBy("n_tokens").collect()  # at most `context` rows
    upper = boundaries([r[0] for r in histogram], [r[1] for r in histogram], buckets)
    bounds = F.array(*[F.lit(b).cast("long") for b in upper]) if upper else F.array().cast("array<long>")
    bucket = F.size(F.filter(bounds, lambda b: b < F.col("n_tokens")))
    order = F.xxhash64("id", "text_hash", "piece")
    placed = pieces.withColumn("bucket", bucket).withColumn("padded", F.get(bounds, F.col("bucket"))).withColumn("order", order)
    placed = placed.withColumn("spread", F.shiftrightunsigned("order", 56).cast("int"))
    per = placed.groupBy("bucket", "spread").count()  # at most buckets * SPREAD rows
    offsets = per.withColumn("offset", F.sum("count").over(Window.partitionBy("bucket").orderBy("spread")) - F.col("count")).drop("count")
    rank = F.row_number().over(Window.partitionBy("bucket", "spread").orderBy("order", "id", "piece"))
    ranked = placed.withColumn("rank", rank).join(F.broadcast(offsets), ["bucket", "spread"])
    at = F.col("offset") + F.col("rank") - 1
    fits = F.greatest(F.lit(1), F.floor(F.lit(budget) / F.col("padded"))).cast("long")
    out = ["id", "piece", "first_token", "n_tokens", "bucket", "padded"]
    if with_text:
        ranked = ranked.join(stored.select("row", "text"), "row")
        out.append("text")
    return ranked.select(*out, F.floor(at / fits).alias("batch"), F.pmod(at, fits).alias("slot"))
