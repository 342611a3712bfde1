"""Scores of ensembles against truths. Everything is a grouped aggregate; none needs a self join but the
energy score, whose pairs stay within one time and sensor."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meshlark.operators.grid import finite


def rmse(x: Column, y: Column) -> Column:
    return F.sqrt(F.avg(F.pow(x - y, 2)))


def member_rmse(rows: DataFrame, keys: list[str], x: str = "x", y: str = "y") -> DataFrame:
    """Spread of the members about the truth."""
    return rows.groupBy(*keys).agg(rmse(F.col(x), F.col(y)).alias("rmse"))


def mean_rmse(rows: DataFrame, keys: list[str], over: list[str], x: str = "x", y: str = "y") -> DataFrame:
    """Error of the ensemble mean, over ``over`` (sensors)."""
    means = rows.groupBy(*keys, *over).agg(F.avg(x).alias("__m"), F.first(y).alias("__y"))
    return means.groupBy(*keys).agg(rmse(F.col("__m"), F.col("__y")).alias("rmse"))


def crps(rows: DataFrame, keys: list[str], x: str = "x", y: str = "y") -> DataFrame:
    """Continuous ranked probability score, all pairs of members counted, from the sorted members; missing ones do not count."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.col(x).asc_nulls_last()))
    ranked = rows.withColumn("__r", rank)
    n = F.count(x)
    spread = 2 * F.sum(F.col("__r") * F.col(x)) - (n + 1) * F.sum(x)
    return ranked.groupBy(*keys).agg((F.avg(F.abs(F.col(x) - F.col(y))) - spread / (n * n)).alias("crps"))


def knot_metrics(rows: DataFrame, keys: list[str], x: str = "x", y: str = "y", alpha: float = 0.9) -> DataFrame:
    """Error of the mean, spread, CRPS and whether the truth is in the central band, per knot."""
    low, high = (F.percentile(F.col(x), F.lit(0.5 + s * alpha / 2)) for s in (-1, 1))
    truth = F.max(y)
    base = rows.groupBy(*keys).agg(
        F.abs(F.avg(x) - truth).alias("error"),
        F.coalesce(F.stddev_samp(x), F.lit(0.0)).alias("spread"),
        truth.between(low, high).cast("int").alias("in_band"),
    )
    return base.join(crps(rows, keys, x, y), keys)


def knot_summary(knots: DataFrame, keys: list[str]) -> DataFrame:
    """Root mean squared error, mean spread, mean CRPS and coverage over knots."""
    return knots.groupBy(*keys).agg(
        F.sqrt(F.avg(F.pow("error", 2))).alias("rmse"), F.avg("spread").alias("spread"), F.avg("crps").alias("crps"), F.avg("in_band").alias("coverage")
    )


def knots_and_summaries(knots: DataFrame, outer: list[str], inner: str) -> DataFrame:
    """Every knot's metrics and their summary over ``inner``, in one pass; ``level`` tells them apart."""
    both = knots.groupingSets([[*outer, inner], outer], *outer, inner).agg(
        F.sqrt(F.avg(F.pow("error", 2))).alias("rmse"), F.avg("spread").alias("spread"), F.avg("crps").alias("crps"), F.avg("in_band").alias("coverage"), F.grouping(inner).alias("__g")
    )
    return both.withColumn("level", F.when(F.col("__g") == 1, "summary").otherwise("knot")).drop("__g")


def energy_score(rows: DataFrame, keys: list[str], member: str, xs: list[str], ys: list[str], over: list[str]) -> DataFrame:
    """Energy score of vector ensembles, averaged over ``over`` (sensors); each pair of members once."""
    group = [*keys, *over]
    dist = F.sqrt(sum(F.pow(F.col(x) - F.col(y), 2) for x, y in zip(xs, ys, strict=True)))
    near = rows.groupBy(*group).agg(F.avg(dist).alias("near"), F.count(F.lit(1)).alias("n"))
    a = rows.select(*group, F.col(member).alias("__a"), *[F.col(x).alias(f"__a{i}") for i, x in enumerate(xs)])
    b = rows.select(*group, F.col(member).alias("__b"), *[F.col(x).alias(f"__b{i}") for i, x in enumerate(xs)])
    apart = F.sqrt(sum(F.pow(F.col(f"__a{i}") - F.col(f"__b{i}"), 2) for i in range(len(xs))))
    pairs = a.join(b, group).where(F.col("__a") < F.col("__b")).groupBy(*group).agg(F.sum(apart).alias("apart"))
    each = near.join(pairs, group, "left").withColumn("s", F.col("near") - F.coalesce("apart", F.lit(0.0)) / (F.col("n") * F.col("n")))
    return each.groupBy(*keys).agg(F.avg("s").alias("energy_score"))


def vector_rmse(rows: DataFrame, keys: list[str], over: list[str], pairs: list[tuple[str, str]]) -> DataFrame:
    """Length of the vector of the components' errors of the ensemble mean."""
    means = rows.groupBy(*keys, *over).agg(*[F.avg(x).alias(f"__x{i}") for i, (x, _) in enumerate(pairs)], *[F.first(y).alias(f"__y{i}") for i, (_, y) in enumerate(pairs)])
    total = sum(F.avg(F.pow(F.col(f"__x{i}") - F.col(f"__y{i}"), 2)) for i in range(len(pairs)))
    return means.groupBy(*keys).agg(F.sqrt(total).alias("vector_rmse"))


def series_stats(rows: DataFrame, keys: list[str], value: str, order: str) -> DataFrame:
    """Mean, maximum and minimum of the finite values, and the last value (null unless finite)."""
    v = F.when(finite(F.col(value)), F.col(value))
    return rows.groupBy(*keys).agg(F.avg(v).alias("mean"), F.max_by(F.struct(v.alias("v")), order)["v"].alias("final"), F.max(v).alias("max"), F.min(v).alias("min"))


def rmse_reduction(posterior: DataFrame, prior: DataFrame, keys: list[str]) -> DataFrame:
    """``posterior`` with the prior's mean error and the share of it that is gone (null unless it is positive)."""
    before = prior.select(*keys, F.col("rmse").alias("prior_rmse_mean"))
    gone = F.when(F.col("prior_rmse_mean") > 0, 1 - F.col("rmse") / F.nullif("prior_rmse_mean", F.lit(0.0)))
    return posterior.join(before, keys, "left").withColumn("rmse_reduction", gone)


def state_summary(states: DataFrame, keys: list[str]) -> DataFrame:
    """Ensemble means of the components, and mean and spread of the members' magnitudes."""
    return states.groupBy(*keys).agg(*[F.avg(c).alias(f"{c}_mean") for c in ("u", "v", "w")], F.avg("vel").alias("vel_mean"), F.stddev_pop("vel").alias("vel_std"))


def norm_stats(rows: DataFrame, channels: list[str], where: Column | None = None) -> DataFrame:
    """Mean and population spread of each channel over the cells that count."""
    rows = rows if where is None else rows.where(where)
    long = F.explode(F.array(*[F.struct(F.lit(c).alias("channel"), F.col(c).cast("double").alias("value")) for c in channels]))
    return rows.select(long.alias("p")).select("p.*").groupBy("channel").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"))


def state_rmse(a: DataFrame, b: DataFrame, keys: list[str], values: tuple[str, ...] = ("u", "v", "w"), *, time: str = "time", level: str = "kz", regrid=None) -> DataFrame:
    """``(time, rmse)`` of two states on the frames and levels that both have; cells where either is missing do not count.

    Where the cells differ, ``regrid`` puts the second state on the first one's.
    """
    other = b if regrid is None else regrid(b)
    frames, levels = (a.select(c).distinct().join(other.select(c).distinct(), c) for c in (time, level))
    kept = a.join(F.broadcast(frames), time).join(F.broadcast(levels), level)
    pairs = kept.join(other.select(time, *keys, *[F.col(v).alias(f"__{v}") for v in values]), [time, *keys])
    apart = F.explode(F.array(*[F.col(v) - F.col(f"__{v}") for v in values]))
    return pairs.select(time, apart.alias("__d")).where(finite(F.col("__d"))).groupBy(time).agg(F.sqrt(F.avg(F.pow("__d", 2))).alias("rmse"))


def masked_mse(rows: DataFrame, keys: list[str], x: str, y: str, fluid: str = "fluid") -> DataFrame:
    """Mean squared difference over fluid cells."""
    return rows.where(F.col(fluid) == 1).groupBy(*keys).agg(F.avg(F.pow(F.col(x) - F.col(y), 2)).alias("mse"))


def mask_ratio(rows: DataFrame, speed: str, fluid: str = "fluid", most: float = 0.01) -> DataFrame:
    """Mean speeds in solids and fluid, and whether the first is small against the second."""
    means = rows.agg(F.avg(F.when(F.col(fluid) == 0, F.col(speed))).alias("solid_mean"), F.avg(F.when(F.col(fluid) == 1, F.col(speed))).alias("fluid_mean"))
    return means.withColumn("valid", F.coalesce(F.col("solid_mean") <= most * F.col("fluid_mean"), F.lit(True)))


def compare(a: DataFrame, b: DataFrame, keys: list[str], value: str) -> DataFrame:
    """How two tables of values differ: cells that do (missing equals missing), and the differences' range."""
    left, right = a.select(*keys, F.col(value).alias("__a")), b.select(*keys, F.col(value).alias("__b"))
    diff = F.abs(F.col("__a") - F.col("__b"))
    return left.join(right, keys, "full").agg(
        F.count_if(~F.col("__a").eqNullSafe(F.col("__b"))).alias("differing"), F.min(diff).alias("least"), F.max(diff).alias("most"), F.avg(diff).alias("mean"), F.count(F.lit(1)).alias("cells")
    )


def early_stop(losses: DataFrame, keys: list[str], patience: int, least: float = 0.0) -> DataFrame:
    """Each run's best epoch so far, and whether it stops there: no gain of over ``least`` for ``patience`` epochs.

    ``losses(keys, epoch, loss)``; rows after the stop are dropped.
    """
    order = Window.partitionBy(*keys).orderBy("epoch")
    before = F.min("loss").over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = losses.withColumn("__better", F.col("loss") < F.coalesce(before - least, F.lit(float("inf"))))
    marked = marked.withColumn("best_epoch", F.last(F.when(F.col("__better"), F.col("epoch")), ignorenulls=True).over(order))
    marked = marked.withColumn("stop", F.col("epoch") - F.col("best_epoch") >= patience)
    stopped = F.coalesce(F.max(F.col("stop").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return marked.withColumn("__past", stopped).where("__past = 0").drop("__past", "__better")


def curriculum(epoch: Column, stages: list[tuple[int, int]]) -> Column:
    """How many steps a training sample spans at an epoch: that of the last of ``stages(first epoch, steps)`` that has begun."""
    steps = F.lit(stages[0][1])
    for first, n in stages[1:]:
        steps = F.when(epoch >= first, F.lit(n)).otherwise(steps)
    return steps.cast("long")


def wall_clock(rows: DataFrame, keys: list[str], seconds: str, window: str) -> DataFrame:
    """Total and mean seconds, and those of each window in order."""
    ordered = F.transform(F.sort_array(F.collect_list(F.struct(window, seconds))), lambda s: s[seconds])
    return rows.groupBy(*keys).agg(F.sum(seconds).alias("total_seconds"), F.avg(seconds).alias("mean_window_seconds"), ordered.alias("window_seconds"))
