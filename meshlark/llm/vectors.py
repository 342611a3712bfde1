"""Operator 6: near-duplicate embeddings by int8 tiles with rigorous error bounds.

1. Equal vectors become one, with their number. A vector that is null, zero, or has a null or
   non-finite component links with nothing and takes no part.
2. Vectors are scaled to length 1 and quantised to int8: ``x = s q + e``. The bound
   ``|x.y - s s' q.q'| <= |s q| |e'| + |e| (|s' q'| + |e'|)`` holds for every pair (Cauchy-Schwarz),
   plus an allowance for rounding.
3. Blocks of ``BLOCK_BYTES`` of vectors, as packed bytes, are paired, each pair once, and pairs of blocks go to
   tasks. A task multiplies tiles of int8 values (exactly: a product of two rows stays below 2 ** 24 in
   single precision up to 1,040 components, and longer vectors are multiplied in double) and
   keeps the pairs whose bound reaches the threshold; only these are recomputed from the full
   vectors in double precision.
4. A task returns counts of links and a spanning forest of them, never the pairs; forests are
   joined by :func:`meshlark.llm.components.connected_components`.

Every pair of different vectors is looked at, so work grows with the square of their number; memory
does not. A vector is sent once for each block, of which there are as few as fill the tasks or the blocks. Vectors of different lengths link with nothing of another length.

Defined cases: repeated vectors link with each other; a repeated id is one more vector and counts
as one; a null id never names a component; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshlark.llm.bktree import roots
from meshlark.llm.common import materialise
from meshlark.llm.components import connected_components

#: Bytes of vectors in a block, rows of a tile within a pair of blocks, bytes of vectors recomputed at once.
BLOCK_BYTES, TILE, CHUNK_BYTES = 16 << 20, 1024, 32 << 20
#: Vectors that a block has at least, about, when blocks are made smaller for more tasks.
LEAST = 512
#: Longest vectors whose int8 products single precision holds exactly.
EXACT = (1 << 24) // (127 * 127)


def normalised(vectors: np.ndarray) -> np.ndarray:
    """Rows of length 1, in double precision; scaled first, so that squares neither overflow nor vanish."""
    v = vectors.astype(np.float64)
    v /= np.abs(v).max(1, keepdims=True)
    return v / np.sqrt((v * v).sum(1, keepdims=True))


def quantised(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(q, scale, error)``: int8 rows, their scales, and the lengths of what they leave."""
    scale = np.abs(unit).max(1) / 127
    q = np.rint(unit / scale[:, None]).astype(np.int8)
    left = unit - q * scale[:, None]
    return q, scale, np.sqrt((left * left).sum(1))


def tile_links(a: np.ndarray, b: np.ndarray, least: float, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs ``(i, j)`` with cosine of at least ``least``, for blocks of unit rows; i < j where both are one block."""
    (qa, sa, ea), (qb, sb, eb) = quantised(a), quantised(b)
    kind = np.float32 if a.shape[1] <= EXACT else np.float64
    qa, qb = qa.astype(kind), qb.astype(kind)
    long_a, long_b = 1 + ea, 1 + eb  # at least the lengths of s q
    for i in range(0, len(a), TILE):
        for j in range(i if same else 0, len(b), TILE):
            at, bt = slice(i, i + TILE), slice(j, j + TILE)
            near = (qa[at] @ qb[bt].T) * sa[at, None].astype(kind) * sb[None, bt].astype(kind)
            # error terms are constant along rows or columns but for the product of both
            room = (long_a[at] * eb[bt].max() + ea[at] * (long_b[bt].max() + eb[bt].max()) + 1e-5).astype(kind)
            x, y = np.nonzero(near >= (least - room)[:, None])
            if not len(x):
                continue
            own = long_a[at][x] * eb[bt][y] + ea[at][x] * (long_b[bt][y] + eb[bt][y]) + 1e-5
            maybe = near[x, y] >= least - own
            x, y = x[maybe] + i, y[maybe] + j
            if same:
                x, y = x[x < y], y[x < y]
            step = max(1, CHUNK_BYTES // (16 * a.shape[1]))
            for k in range(0, len(x), step):
                u, v = x[k : k + step], y[k : k + step]
                hit = np.einsum("nd,nd->n", a[u], b[v]) >= least
                if hit.any():
                    yield u[hit], v[hit]


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The vector of each row, in the last column, as bytes."""
    for batch in batches:
        column = batch.column(batch.num_columns - 1)
        flat, at = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy().tolist()
        packed = [flat[a:b].tobytes() for a, b in zip(at, at[1:])]
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(packed, pa.binary())], [*batch.schema.names[:-1], "vec"])


def _task(least: float, kind: str):
    def run(key: tuple[int, ...], rows: pd.DataFrame) -> pd.DataFrame:
        i, j, dims = key
        ids, number = rows["node"].to_numpy(), rows["many"].to_numpy()
        left = np.flatnonzero(rows["block"].to_numpy() == i)
        right = left if i == j else np.flatnonzero(rows["block"].to_numpy() == j)
        unit = normalised(np.frombuffer(b"".join(rows["vec"]), kind).reshape(len(rows), dims))
        links = np.zeros(len(rows), np.int64)
        label = np.arange(len(rows))
        for u, v in tile_links(unit[left], unit[right], least, i == j):
            u, v = left[u], right[v]
            np.add.at(links, u, number[v])
            np.add.at(links, v, number[u])
            join = roots(len(rows), [(label[u], label[v])])
            label = join[label]
        moved = (links > 0) | (label != np.arange(len(rows)))
        return pd.DataFrame({"node": ids[moved], "links": links[moved], "other": ids[label[moved]]})

    return run


def embedding_groups(
    vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", least: float = 0.9, block: int | None = None
) -> DataFrame:
    """``(id, n_links, component)``, a row for each row of ``vectors``."""
    v = F.col("embedding")
    # Single precision goes round as it is; everything else in double precision, in which all is computed.
    single = vectors.schema[vector_col].dataType.simpleString() == "array<float>"
    number = "float" if single else "double"
    plain = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).cast(f"array<{number}>").alias("embedding"))
    sound = F.coalesce(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0), F.lit(False))
    # -0.0 equals 0.0
    plain = plain.withColumn("sound", sound).withColumn("embedding", F.transform(v, lambda x: x + F.lit(0.0).cast(number)))
    rows = materialise(plain.withColumn("sound", F.coalesce("sound", F.lit(False))), "vectors")
    distinct = rows.where("sound").groupBy("embedding").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("many"))
    distinct = materialise(distinct.withColumn("node", F.monotonically_increasing_id()).withColumn("dims", F.size("embedding")), "distinct")
    # As few blocks as memory allows, but enough pairs of them to go round the tasks.
    count, widest = distinct.agg(F.count(F.lit(1)), F.max("dims")).first()
    block = block or max(1, BLOCK_BYTES // ((4 if single else 8) * (widest or 1)))
    tasks = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocks = max(1, -(-count // block), min(-(-count // LEAST), math.ceil(math.sqrt(2 * tasks))))
    packed = distinct.select("node", "many", "dims", "embedding").mapInArrow(_packed, "node long, many long, dims int, vec binary")
    placed = packed.withColumn("block", F.pmod(F.xxhash64("node"), F.lit(blocks)).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    pairs = placed.withColumn("other", other).select("node", "many", "vec", "dims", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
    # In pairs of blocks of one kind, a block's rows come once.
    work = _task(least, "<f4" if single else "<f8")
    found = materialise(pairs.groupBy("i", "j", "dims").applyInPandas(work, "node long, links long, other long"), "links")
    roots_ = connected_components(found.select(F.col("node").alias("a"), F.col("other").alias("b")))
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    named = distinct.select("node", "least", "many", "embedding").join(links, "node", "left").join(roots_, "node", "left").withColumn("root", F.coalesce("root", "node"))
    component = named.groupBy("root").agg(F.min("least").alias("component"))
    named = named.join(component, "root").select("embedding", (F.coalesce("links", F.lit(0)) + F.col("many") - 1).alias("n_links"), "component")
    joined = rows.where("sound").join(named, "embedding").select("id", "n_links", "component")
    alone = rows.where("not sound").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component"))
    return joined.unionByName(alone)
