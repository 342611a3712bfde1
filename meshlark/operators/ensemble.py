"""Members: unions, failures and their replacement, splits, plug-in models."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def union_members(states: dict[int, DataFrame], grid: list[str]) -> DataFrame:
    """States of one grid as an ensemble; states on other cells are refused. One pass checks all members."""
    union = reduce(DataFrame.unionByName, [df.withColumn("m", F.lit(k).cast("long")) for k, df in states.items()])
    seen = union.groupBy(*grid).agg(F.count_distinct("m").alias("__n"))
    if not seen.where(F.col("__n") != len(states)).isEmpty():
        raise ValueError("the members' grids differ")
    return union


def union_steps(steps: list[DataFrame], name: str = "esmda_step") -> DataFrame:
    """Tables of successive steps as one."""
    return reduce(DataFrame.unionByName, [df.withColumn(name, F.lit(k).cast("long")) for k, df in enumerate(steps)])


def donors(status: DataFrame, draws: DataFrame, policy: str = "resample") -> DataFrame:
    """``(member, donor)`` for failed members of ``status(member, ok)``; ``draws(member, u)`` picks survivors.

    Policy ``raise`` refuses failures; no survivor at all is an error under either. Members are few.
    """
    failed, alive = status.where("not ok"), status.where("ok")
    if failed.isEmpty():
        return failed.select("member", F.col("member").alias("donor"))
    if policy == "raise" or alive.isEmpty():
        raise RuntimeError("members failed" if policy == "raise" else "all members failed; there is no donor")
    ranked = alive.select(F.col("member").alias("donor"), (F.row_number().over(Window.orderBy("member")) - 1).cast("long").alias("rank"))
    count = alive.count()
    picked = failed.join(draws, "member").select("member", F.least(F.floor(F.col("u") * count), F.lit(count - 1)).cast("long").alias("rank"))
    return picked.join(ranked, "rank").select("member", "donor")


def replace_states(states: DataFrame, substitutes: DataFrame, member: str = "m") -> DataFrame:
    """Failed members' rows are their donors'."""
    everyone = states.select(F.col(member).alias("__m")).distinct().join(substitutes.select(F.col("member").alias("__m"), "donor"), "__m", "full")
    source = everyone.select(F.col("__m"), F.coalesce("donor", "__m").alias("__from"))
    others = [c for c in states.columns if c != member]
    return states.withColumnRenamed(member, "__from").join(F.broadcast(source), "__from").select(F.col("__m").alias(member), *others).select(*states.columns)


def replace_params(params: DataFrame, substitutes: DataFrame, noise: DataFrame, keys: list[str], jitter: float = 0.05) -> DataFrame:
    """Failed members' parameters are their donors' with jitter: ``jitter`` times the ensemble's spread.

    ``params(keys, member, value)``; ``noise(keys, member, z)``; the spread counts all members as they were.
    """
    spread = F.stddev_pop("value").over(Window.partitionBy(*keys))
    known = params.withColumn("__std", spread)
    donor = known.select(*keys, F.col("member").alias("donor"), F.col("value").alias("__given"))
    got = known.join(F.broadcast(substitutes), "member", "left").join(donor, [*keys, "donor"], "left").join(noise.select(*keys, "member", "z"), [*keys, "member"], "left")
    fresh = F.col("__given") + jitter * F.col("__std") * F.coalesce("z", F.lit(0.0))
    return got.select(*keys, "member", F.when(F.col("donor").isNotNull(), fresh).otherwise(F.col("value")).alias("value"))


def split_samples(rows: DataFrame, sizes: dict[str, int], sample: str = "sample") -> DataFrame:
    """``rows`` with ``split``: consecutive samples, numbered from 0 within their split; later ones have none."""
    split, number, start = F.lit(None).cast("string"), F.lit(None).cast("long"), 0
    for name, n in sizes.items():
        here = (F.col(sample) >= start) & (F.col(sample) < start + n)
        split, number = F.when(here, name).otherwise(split), F.when(here, F.col(sample) - start).otherwise(number)
        start += n
    return rows.withColumn("split", split).withColumn("number", number)


def shortest_mean(states: DataFrame, keys: list[str], values: list[str], member: str = "m", frame: str = "frame_idx") -> DataFrame:
    """Ensemble mean over the frames that every member has."""
    shortest = states.groupBy(member).agg((F.max(frame) + 1).alias("n")).agg(F.min("n").alias("n")).first()["n"]
    return states.where(F.col(frame) < F.lit(shortest)).groupBy(frame, *keys).agg(*[F.avg(v).alias(v) for v in values])


def member_params(params: DataFrame, member: int | None) -> DataFrame:
    """One member's parameters; all of them where the table has no members."""
    return params if member is None or "member" not in params.columns else params.where(F.col("member") == member).drop("member")


def run_members(states: DataFrame, params: DataFrame, model: Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame], schema: str, member: str = "m") -> DataFrame:
    """A plug-in forward model, once for each member, members in parallel: ``model(state, params) -> state``."""

    def run(state: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        return model(state, own)

    return states.groupBy(member).cogroup(params.groupBy(member)).applyInPandas(run, schema)


def canonical_levels(levels: DataFrame, member: str = "m") -> DataFrame:
    """The z levels ``(kz, coord)`` of the member that has the fewest; an error unless they ascend strictly."""
    sizes = levels.groupBy(member).agg(F.count(F.lit(1)).alias("n"))
    least = sizes.agg(F.min(F.struct("n", member)).alias("s")).select(F.col(f"s.{member}").alias(member))
    grid = levels.join(F.broadcast(least), member).select("kz", "coord")
    gap = F.col("coord") - F.lag("coord").over(Window.orderBy("kz"))
    checked = F.when(gap <= 0, F.raise_error(F.lit("levels do not ascend")).cast("double")).otherwise(F.col("coord"))
    return grid.withColumn("coord", checked)


def fix_levels(states: DataFrame, levels: DataFrame, values: list[str], coord: str | None = None) -> DataFrame:
    """States cut to canonical levels; an error where a value is not finite, or the states' own ``coord`` is another one."""
    from meshlark.operators.grid import finite

    kept = states.join(F.broadcast(levels.select("kz", F.col("coord").alias("__c"))), "kz")
    if coord is not None:
        # Within one part in 100,000, or 1e-8.
        apart = F.abs(F.col(coord) - F.col("__c")) > 1e-8 + 1e-5 * F.abs(F.col("__c"))
        kept = kept.withColumn(coord, F.when(apart, F.raise_error(F.lit("a member's levels are others")).cast("double")).otherwise(F.col(coord)))
    kept = kept.drop("__c")
    return kept.withColumns({v: F.when(finite(F.col(v)), F.col(v)).otherwise(F.raise_error(F.lit(f"{v} is not finite")).cast("double")) for v in values})


def even_members(members: int, n: int) -> list[int]:
    """``n`` members spread evenly, by whole numbers."""
    from meshlark.operators.grid import spread_frames

    return spread_frames(members, min(n, members))


def status_column(condition: Column) -> Column:
    """Whether a member ran through: a null condition counts as failure."""
    return F.coalesce(condition, F.lit(False))


def merge_params(existing: DataFrame, new: DataFrame, inflow: list[str], keys: list[str]) -> DataFrame:
    """``existing(keys, name, value)`` with the inflow parameters of ``new`` in place of its own, or added."""
    fresh = new.where(F.col("name").isin(inflow)).select(*keys, "name", F.col("value").alias("__new"))
    return existing.join(fresh, [*keys, "name"], "full").select(*keys, "name", F.coalesce("__new", "value").alias("value"))


def merge_positions(left: DataFrame, right: DataFrame, index: list[str]) -> DataFrame:
    """Tables of one grid side by side, cells matched by index; columns that both have are the left one's."""
    new = [c for c in right.columns if c not in left.columns]
    return left.join(right.select(*index, *new), index)


def constant_params(params: DataFrame, constants: dict[str, float], member: str = "member") -> DataFrame:
    """``params(member, name, value)`` with constants that every member has; its own values stay."""
    added = params.select(member).distinct().select(member, F.explode(F.create_map(*[c for n, v in constants.items() for c in (F.lit(n), F.lit(float(v)))])).alias("name", "value"))
    return params.unionByName(added.join(params, [member, "name"], "left_anti"))


def lookup(facets: DataFrame, types: DataFrame, key: str, value: str, default: float = 0.0) -> DataFrame:
    """``facets`` with the first value of its type; ``default`` for types that are not listed.

    ``types(key, position, value)`` is a small dimension.
    """
    first = types.groupBy(key).agg(F.min_by(value, "position").alias(value))
    return facets.join(F.broadcast(first), key, "left").withColumn(value, F.coalesce(value, F.lit(default)))


def spin_up_then_roll(
    states: DataFrame,
    params: DataFrame,
    spin_up: Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame],
    step: Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame],
    schema: str,
    steps: int,
    member: str = "m",
) -> DataFrame:
    """Members spun up in parallel by one model, then rolled out by another from where they stand."""
    return rollout(run_members(states, params, spin_up, schema, member), params, step, schema, steps, member)


def rollout(states: DataFrame, params: DataFrame, model: Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame], schema: str, steps: int, member: str = "m") -> DataFrame:
    """``steps`` steps of a one-step model in one grouped pass for each member: rows with ``step`` from 1."""

    def run(state: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        out = []
        for step in range(1, steps + 1):
            state = model(state, own)
            out.append(state.assign(step=step))
        return pd.concat(out)

    return states.groupBy(member).cogroup(params.groupBy(member)).applyInPandas(run, f"{schema}, step long")
