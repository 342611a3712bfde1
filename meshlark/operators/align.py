"""Alignment of series with different times: a linear as-of join without a self join.

Both sides are united and sorted once within their keys; the known points before and after every
asked time come from two windows over that order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def lerp_join(asked: DataFrame, known: DataFrame, keys: list[str], time: str, value: str, *, out: str | None = None, ends: str = "clamp") -> DataFrame:
    """``asked`` with the ``value`` of ``known`` at its times, linear between the known points.

    ``ends`` says what holds outside: ``clamp`` (the outermost value), ``extend`` (the outermost slope) or
    ``null``. A series of one point is constant unless ``null``. Keys without known points give null.
    """
    if ends not in ("clamp", "extend", "null"):
        raise ValueError(f"unknown ends {ends!r}")
    out = out or value
    # A struct, so that names of the asked side cannot clash.
    left = asked.select(*keys, F.col(time).alias("__t"), F.struct(*asked.columns).alias("__row"), F.lit(None).cast("struct<t:double,v:double>").alias("__p"))
    right = known.where(F.col(value).isNotNull()).select(
        *keys,
        F.col(time).alias("__t"),
        F.lit(None).cast(left.schema["__row"].dataType).alias("__row"),
        F.struct(F.col(time).cast("double").alias("t"), F.col(value).cast("double").alias("v")).alias("__p"),
    )
    order = Window.partitionBy(*keys).orderBy("__t")
    # Frames by range: points at the very time count on both sides.
    back, ahead = order.rangeBetween(Window.unboundedPreceding, Window.currentRow), order.rangeBetween(Window.currentRow, Window.unboundedFollowing)
    rows = left.unionByName(right)
    rows = rows.withColumn("__a", F.last("__p", ignorenulls=True).over(back)).withColumn("__b", F.first("__p", ignorenulls=True).over(ahead))
    if ends == "extend":
        # Two points from either end of each series: its ranks stop there, no series is gathered.
        ends_of = []
        for names, ordered in ((("p0", "p1"), F.col("__p").asc()), (("q1", "q0"), F.col("__p").desc())):
            ranked = right.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(ordered))).where("__n <= 2")
            ends_of.append(ranked.groupBy(*keys).agg(*[F.max(F.when(F.col("__n") == n, F.col("__p"))).alias(name) for n, name in enumerate(names, 1)]))
        edge = ends_of[0].join(ends_of[1], keys)
        rows = rows.where("__row is not null").join(edge, keys, "left")
    a, b, t = F.col("__a"), F.col("__b"), F.col("__t").cast("double")

    def line(p: Column, q: Column) -> Column:
        return F.when(q["t"] > p["t"], p["v"] + (q["v"] - p["v"]) * (t - p["t"]) / F.nullif(q["t"] - p["t"], F.lit(0.0))).otherwise(p["v"])

    got = F.when(a.isNotNull() & b.isNotNull(), line(a, b))
    if ends == "clamp":
        got = F.coalesce(got, a["v"], b["v"])
    elif ends == "extend":
        low = F.when(F.col("p1").isNull(), F.col("p0.v")).otherwise(line(F.col("p0"), F.col("p1")))
        high = F.when(F.col("q0").isNull(), F.col("q1.v")).otherwise(line(F.col("q0"), F.col("q1")))
        got = F.coalesce(got, F.when(a.isNull(), low), high)
    return rows.where("__row is not null").select("__row.*", got.alias(out))


def schedule_at(asked: DataFrame, schedule: DataFrame, keys: list[str], time: str, value: str, *, default: float | None = None) -> DataFrame:
    """A schedule's value at asked times, clamped; ``default`` where there is none, else an error."""
    got = lerp_join(asked, schedule, keys, time, value)
    rest = F.lit(float(default)) if default is not None else F.raise_error(F.lit(f"no schedule of {value}, and no default")).cast("double")
    return got.withColumn(value, F.coalesce(value, rest))
