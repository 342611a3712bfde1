"""Connected components of a graph too large for one machine, by randomised contraction.

Each round gives every node a pseudorandom priority, merges it with the neighbour (or
itself) of the least one, and renames the edges. A constant share of the nodes goes each
round, whatever the shape, so chains take a logarithmic number of rounds too. A node's
name in the end is the composition of the rounds' maps.

The minimum over neighbours is pre-aggregated before its shuffle; the renaming is a plain
equi-join, which adaptive execution splits where a hub holds many edges. Each round's
tables are written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshlark.llm.common import materialise


def connected_components(edges: DataFrame) -> DataFrame:
    """``edges(a long, b long)`` to ``(node long, root long)``: one row per node that has an edge.

    Self loops and repeated edges are allowed and change nothing; an edge with a null end is
    dropped. ``root`` names the component (some node's name, not the least one).
    """
    edges = materialise(
        edges.where("a is not null and b is not null and a <> b")
        .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        .distinct(),
        "edges",
    )
    maps: list[DataFrame] = []
    while not edges.isEmpty():
        rank = F.lit(len(maps))
        both = edges.union(edges.select("b", "a"))
        best = both.groupBy(F.col("a").alias("node")).agg(F.min(F.struct(F.xxhash64("b", rank).alias("p"), F.col("b"))).alias("m"))
        merged = materialise(
            best.select("node", F.when(F.col("m.p") < F.xxhash64("node", rank), F.col("m.b")).otherwise(F.col("node")).alias("root")),
            "contraction",
        )
        maps.append(merged)
        left, right = (merged.select(F.col("node").alias(x), F.col("root").alias(f"{x}_root")) for x in "ab")
        edges = materialise(
            edges.join(left, "a")
            .join(right, "b")
            .where("a_root <> b_root")
            .select(F.least("a_root", "b_root").alias("a"), F.greatest("a_root", "b_root").alias("b"))
            .distinct(),
            "edges",
        )
    if not maps:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    out = maps[0]
    for later in maps[1:]:
        step = later.select(F.col("node").alias("root"), F.col("root").alias("next"))
        out = out.join(step, "root", "left").select("node", F.coalesce("next", "root").alias("root"))
    return materialise(out, "components") if len(maps) > 1 else out
