"""Covariances, localisation and the ensemble-smoother update.

An augmented table has ``(row_id, member, value)``: parameters and state cells, a row for each member.
Observations are few (tens to hundreds), so matrices over them are small whatever the state's size: they
are aggregated by Spark, solved once, and the update streams over the augmented rows.
"""

from __future__ import annotations

from abc import ABC, abstractmethod
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meshlark.functions.scalar import taper_inflation
from meshlark.sources.states import shared_folder


def dense(lists: pa.ListArray, members: np.ndarray, strict: bool = True) -> np.ndarray:
    """Lists of ``(member, value)`` as a matrix, a column for each of the sorted ``members``; NaN where a row has none.

    With ``strict``, a member that is not among them is an error, else it does not count.
    """
    pairs = lists.flatten()
    row = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
    member = pairs.field("member").to_numpy(zero_copy_only=False)
    at = np.minimum(np.searchsorted(members, member), len(members) - 1)
    known = members[at] == member
    if strict and not known.all():
        raise ValueError(f"no prediction for member {member[~known][0]}")
    out = np.full((len(lists), len(members)), np.nan)
    out[row[known], at[known]] = pairs.field("value").to_numpy(zero_copy_only=False)[known]
    return out


def by_row(augmented: DataFrame) -> DataFrame:
    """``(row_id, members)``: the values of each row as an array of ``(member, value)``."""
    return augmented.groupBy("row_id").agg(F.collect_list(F.struct("member", F.col("value").cast("double").alias("value"))).alias("members"))


def _each_pair(rows: DataFrame, obs: DataFrame, out: str, of: Callable[..., np.ndarray]) -> DataFrame:
    """``(row_id, obs_id, out)`` for the pairs with a common member, from sums over members that both have."""
    small, obs_ids, members = _small(obs, "obs_id", "member", "value")
    kinds = {f.name: f.dataType.simpleString() for f in [*rows.schema, *obs.schema]}
    members, ids = np.array(members), pa.array(obs_ids)
    has_o = ~np.isnan(small)
    shift = np.where(has_o.any(1), np.nanmean(np.where(has_o.any(1, keepdims=True), small, 0.0), axis=1), 0.0)
    o = np.where(has_o, small - shift[:, None], 0.0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            raw = dense(batch.column(1), members, strict=False)
            has = ~np.isnan(raw)
            mean = np.where(has, raw, 0.0).sum(1) / np.maximum(has.sum(1), 1)
            a = np.where(has, raw - mean[:, None], 0.0)
            n = has.astype(float) @ has_o.T
            with np.errstate(divide="ignore", invalid="ignore"):
                sa, sb = a @ has_o.T, has @ o.T
                cov = (a @ o.T - sa * sb / n) / (n - 1)
                value = of(cov, (a * a @ has_o.T - sa * sa / n) / (n - 1), (has @ (o * o).T - sb * sb / n) / (n - 1))
            row, col = np.nonzero(n)
            got = pa.array(value[row, col], mask=n[row, col] < 2)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), ids.take(pa.array(col)), got], ["row_id", "obs_id", out])

    return by_row(rows).mapInArrow(run, f"row_id {kinds['row_id']}, obs_id {kinds['obs_id']}, {out} double")


def covariance(rows: DataFrame, obs: DataFrame) -> DataFrame:
    """``(row_id, obs_id, cov)``: sample covariances of rows and predicted observations over the members that both have.

    ``obs(obs_id, member, value)`` is small (observations x members) and a matrix; rows stream by it in batches.
    """
    return _each_pair(rows, obs, "cov", lambda cov, va, vo: cov)


def correlation(rows: DataFrame, obs: DataFrame) -> DataFrame:
    """``(row_id, obs_id, corr)``: correlations within [-1, 1], 0 where either side does not vary."""

    def of(cov: np.ndarray, va: np.ndarray, vo: np.ndarray) -> np.ndarray:
        scale = np.sqrt(va * vo)
        return np.where(scale > 0, np.clip(cov / np.where(scale > 0, scale, 1.0), -1, 1), 0.0)

    return _each_pair(rows, obs, "corr", of)


def correlation_inflation(corr: DataFrame, truncation: float, beta: float, most: float) -> DataFrame:
    """Inflation by weakness of correlation: null below ``truncation``, 1 near a correlation of 1."""
    distance = 1 - F.abs(F.col("corr"))
    return corr.withColumn("inflation", taper_inflation(distance, 1 - truncation, beta, most)).drop("corr")


def distance_inflation(rows: DataFrame, sites: DataFrame, radius: float, beta: float, most: float, *, horizontal: bool = False) -> DataFrame:
    """Inflation by distance, for the pairs within ``radius``: an equi-join on cubes as wide as it.

    ``rows(row_id, x, y, z)``, ``sites(obs_id, x, y, z)``; pairs that are not returned are excluded.
    """
    dims = ("x", "y") if horizontal else ("x", "y", "z")
    near = sites.select("obs_id", *[F.col(d).alias(f"__{d}") for d in dims])
    for d in dims:  # a site shows in the cubes around its own
        near = near.withColumn(f"__c{d}", F.explode(F.array(*[F.floor(F.col(f"__{d}") / radius) + s for s in (-1, 0, 1)])))
    placed = rows.withColumns({f"__c{d}": F.floor(F.coalesce(d, F.lit(0.0)) / radius) for d in dims})
    apart = F.sqrt(sum(F.pow(F.coalesce(F.col(d), F.lit(0.0)) - F.col(f"__{d}"), 2) for d in dims))
    pairs = placed.join(near, [f"__c{d}" for d in dims]).select("row_id", "obs_id", apart.alias("distance")).where(F.col("distance") <= radius)
    return pairs.withColumn("inflation", taper_inflation(F.col("distance"), radius, beta, most))


def block_least(inflation: DataFrame, block: str = "group_id") -> DataFrame:
    """Every row's inflation as the least of its block's, per observation; null only if all are."""
    return inflation.withColumn("inflation", F.min("inflation").over(Window.partitionBy(block, "obs_id")))


def unmasked(inflation: DataFrame, localize: str = "localize") -> DataFrame:
    """Rows that are not localised see every observation as it is."""
    return inflation.withColumn("inflation", F.when(F.col(localize), F.col("inflation")).otherwise(F.lit(1.0)))


def group_numbers(names: DataFrame, name: str, position: str) -> DataFrame:
    """``names`` with ``group_id``: knots of one parameter share a number, in order of first appearance."""
    from meshlark.functions.scalar import base_name

    base = names.withColumn("__base", base_name(F.col(name)))
    first = base.withColumn("__first", F.min(position).over(Window.partitionBy("__base")))
    return first.withColumn("group_id", F.dense_rank().over(Window.orderBy("__first")).cast("long") - 1).drop("__base", "__first")


def flatten_state(state: DataFrame, variables: list[str], keys: list[str]) -> DataFrame:
    """Wide cells as augmented rows, variables by name and cells in order: ``(row_id, name, keys, member, value)``.

    There are at least two keys, and few planes of the first.
    """
    names = sorted(variables)
    cells = state.select(*keys).distinct()
    # Ranks within planes of the first key, after the cells of the planes before: no task sorts them all.
    planes = cells.groupBy(keys[0]).agg(F.count(F.lit(1)).alias("__n"))
    every = Window.partitionBy(F.lit(1))
    planes = planes.withColumn("__all", F.sum("__n").over(every)).withColumn("__before", F.sum("__n").over(every.orderBy(keys[0])) - F.col("__n"))
    rank = F.row_number().over(Window.partitionBy(keys[0]).orderBy(*keys[1:])).cast("long") - 1
    order = cells.withColumn("__rank", rank).join(planes, keys[0]).withColumn("__cell", F.col("__before") + F.col("__rank"))
    pairs = F.explode(F.array(*[F.struct(F.lit(i).cast("long").alias("i"), F.lit(v).alias("name"), F.col(v).alias("value")) for i, v in enumerate(names)]))
    long = state.withColumn("__p", pairs).select(*keys, "m", "__p.*").join(order, keys)
    return long.select((F.col("i") * F.col("__all") + F.col("__cell")).alias("row_id"), "name", *keys, F.col("m").alias("member"), "value")


def unflatten_state(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The inverse of :func:`flatten_state`."""
    return rows.groupBy(*keys, F.col("member").alias("m")).pivot("name").agg(F.first("value"))


def _small(df: DataFrame, row: str, col: str, value: str) -> tuple[np.ndarray, list, list]:
    """A small table as a matrix (observations by members: both are few)."""
    p = df.select(row, col, value).toPandas().pivot(index=row, columns=col, values=value).sort_index().sort_index(axis=1)
    return p.to_numpy(float), p.index.tolist(), p.columns.tolist()


def esmda_update(
    augmented: DataFrame,
    predicted: DataFrame,
    observed: DataFrame,
    noise: DataFrame,
    alpha: float,
    *,
    inflation: DataFrame | None = None,
) -> DataFrame:
    """One step of the ensemble smoother with multiple data assimilation.

    ``augmented(row_id, member, value)``; ``predicted(obs_id, member, value)``; ``observed(obs_id, value, sigma)``;
    ``noise(obs_id, member, z)``, standard normal. With ``inflation(row_id, obs_id, inflation)``, each row sees only
    the observations it has there, their errors inflated; systems are solved once for each distinct pattern of a
    batch. Rows without any pair in ``inflation`` stay as they are. A row that lacks members is updated from those
    that it has, and no member is made up; one that was not predicted is an error. Returns ``augmented`` updated.
    """
    d, obs_ids, members = _small(predicted, "obs_id", "member", "value")
    z, _, _ = _small(noise, "obs_id", "member", "z")
    o = observed.toPandas().set_index("obs_id").loc[obs_ids]
    obs, sigma = o["value"].to_numpy(float), o["sigma"].to_numpy(float)
    dev = d - d.mean(1, keepdims=True)
    c_dd = dev @ dev.T / (len(members) - 1)
    shake = np.sqrt(alpha) * sigma[:, None] * z
    n = len(obs_ids)

    def solve(factors: np.ndarray) -> np.ndarray:
        """Members' weights for one pattern of inflation; NaN excludes an observation."""
        on = np.isfinite(factors)
        e = factors[on]
        out = np.zeros((n, len(members)))
        if on.any():
            system = c_dd[np.ix_(on, on)] + alpha * np.diag(sigma[on] ** 2 * e**2)
            right = obs[on, None] + e[:, None] * shake[on] - d[on]
            try:
                out[on] = np.linalg.solve(system, right)
            except np.linalg.LinAlgError:
                out[on] = np.linalg.lstsq(system, right, rcond=None)[0]
        return out

    kinds = {f.name: f.dataType.simpleString() for f in augmented.schema}
    names, labels = np.array(members), pa.array(members)
    whole = solve(np.ones(n)) if inflation is None else None
    rows = by_row(augmented)
    if inflation is not None:
        # An array of factors in the order of the observations; null excludes one.
        pairs = F.map_from_entries(F.collect_list(F.struct("obs_id", F.col("inflation").cast("double").alias("inflation"))))
        seen = inflation.where("inflation is not null").groupBy("row_id").agg(pairs.alias("f"))
        order = F.array(*[F.lit(k) for k in obs_ids])
        factors = F.transform(order, lambda k: F.try_element_at("f", k))
        rows = rows.join(seen, "row_id", "left").select("row_id", "members", F.when(F.col("f").isNotNull(), factors).alias("factors"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            a = dense(batch.column(1), names)
            has = ~np.isnan(a)
            count = has.sum(1)
            mean = np.where(has, a, 0.0).sum(1) / np.maximum(count, 1)
            # Centred rows sum to 0, so the predictions need no new centre for the members that a row has.
            c = np.where(has, a - mean[:, None], 0.0) @ dev.T / np.maximum(count - 1, 1)[:, None]
            if whole is not None:
                a += c @ whole
            else:
                factors = np.array([x if x is not None else [None] * n for x in batch.column(2).to_pylist()], float).reshape(batch.num_rows, n)
                patterns, which = np.unique(factors, axis=0, return_inverse=True, equal_nan=True)
                for k, pattern in enumerate(patterns):
                    mine = which.ravel() == k
                    a[mine] += c[mine] @ solve(pattern)
            row, col = np.nonzero(has)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), labels.take(pa.array(col)), pa.array(a[row, col])], ["row_id", "member", "value"])

    return rows.mapInArrow(run, f"row_id {kinds['row_id']}, member {kinds['member']}, value double")


def settled(df: DataFrame) -> DataFrame:
    """``df``, checkpointed: in the session's folder, or one of its own where there is none."""
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def analysis(
    augmented: DataFrame,
    forecast: Callable[[DataFrame], DataFrame],
    observed: DataFrame,
    noise: Callable[[int, DataFrame], DataFrame],
    steps: int,
    *,
    localise: Callable[[DataFrame, DataFrame], DataFrame] | None = None,
    repair: Callable[[DataFrame], DataFrame] | None = None,
) -> tuple[DataFrame, list[DataFrame]]:
    """The smoother's loop: forecast, repair, update, ``steps`` times with weights that sum to one.

    ``forecast`` maps augmented rows to predicted observations; each step's rows are checkpointed, so plans do not
    grow. Returns the posterior and the history, prior first.
    """
    history = [augmented]
    for step in range(steps):
        now = history[-1] if repair is None else repair(history[-1])
        predicted = settled(forecast(now))
        inflation = None if localise is None else localise(now, predicted)
        history.append(settled(esmda_update(now, predicted, observed, noise(step, predicted), float(steps), inflation=inflation)))
    return history[-1], history


def noisy(observations: DataFrame, noise: DataFrame, sigma: float) -> DataFrame:
    """``(obs_id, value, sigma)``: the truth's observations with errors, ``noise(obs_id, z)`` standard normal."""
    return observations.join(noise.select("obs_id", "z"), "obs_id").select("obs_id", (F.col("value") + sigma * F.col("z")).alias("value"), error_column(sigma).alias("sigma"))


def run_windows(
    prior: DataFrame,
    state: DataFrame,
    observations: DataFrame,
    windows: int,
    forecast: Callable[[DataFrame, DataFrame], DataFrame],
    errors: Callable[[int], DataFrame],
    noise: Callable[[int, int, DataFrame], DataFrame],
    sigma: float,
    steps: int,
    *,
    warm_start: Callable[[DataFrame, DataFrame], DataFrame],
    next_prior: Callable[[DataFrame, int], DataFrame],
    localise: Callable[[DataFrame, DataFrame], DataFrame] | None = None,
    repair: Callable[[DataFrame], DataFrame] | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Assimilation windows one after the other: ``(posteriors, last state)``, posteriors numbered by ``window``.

    Each window takes its slice of ``observations(window, obs_id, value)``, adds ``errors(window)``, runs the smoother
    on ``forecast(augmented, state)``, forecasts once more to warm-start the next window's state, and makes its prior.
    """
    out = []
    for w in range(windows):
        observed = noisy(observations.where(F.col("window") == w), errors(w), sigma)
        posterior, _ = analysis(prior, lambda rows, s=state: forecast(rows, s), observed, lambda k, d, w=w: noise(w, k, d), steps, localise=localise, repair=repair)
        out.append(posterior.withColumn("window", F.lit(w).cast("long")))
        state = settled(warm_start(posterior, state))
        prior = next_prior(posterior, w)
    return reduce(DataFrame.unionByName, out), state


def row_coords(rows: DataFrame, axes: DataFrame, dims: dict[str, str | None]) -> DataFrame:
    """``rows(.., k<axis>)`` with coordinates: ``dims[axis]`` names the axis table's axis, or None where a field has none (0).

    A cell whose axis is not in ``axes(axis, k, coord)`` is an error.
    """
    for axis, name in dims.items():
        if name is None:
            rows = rows.withColumn(axis, F.lit(0.0))
            continue
        one = axes.where(F.col("axis") == name).select(F.col("k").alias(f"k{axis}"), F.col("coord").cast("double").alias(axis))
        found = rows.join(F.broadcast(one), f"k{axis}", "left")
        lost = F.raise_error(F.concat(F.lit(f"no coordinate on the axis {name} for cell "), F.col(f"k{axis}").cast("string"))).cast("double")
        rows = found.withColumn(axis, F.coalesce(F.col(axis), lost))
    return rows


class Localisation(ABC):
    """Which observations a row sees, and how much less: ``(row_id, obs_id, inflation)``; null excludes. Subclass for more."""

    @abstractmethod
    def inflation(self, rows: DataFrame, predicted: DataFrame) -> DataFrame: ...


class ByCorrelation(Localisation):
    """By the sample correlation of a row with an observation."""

    def __init__(self, truncation: float, beta: float, most: float):
        self.options = truncation, beta, most

    def inflation(self, rows: DataFrame, predicted: DataFrame) -> DataFrame:
        return correlation_inflation(correlation(rows, predicted), *self.options)


def error_column(sigma: float) -> Column:
    """The observation error's standard deviation: the covariance is diagonal, one column says it all."""
    return F.lit(float(sigma))


def pin_knots(params: DataFrame, pinned: bool) -> tuple[DataFrame, DataFrame]:
    """Parameters in time as augmented rows, and the knots left out: the first one, where it is pinned.

    ``params(name, knot, member, value)``; rows are named ``name_knot``, knots of one name together.
    """
    free = params.where(F.col("knot") > 0) if pinned else params
    rows = free.select(F.concat_ws("_", "name", "knot").alias("row_id"), "name", "knot", "member", "value")
    return rows, params.where(F.col("knot") == 0) if pinned else params.where(F.lit(False))


def unpin_knots(rows: DataFrame, kept: DataFrame) -> DataFrame:
    """The inverse of :func:`pin_knots`, from updated rows ``(row_id, member, value)``."""
    name, knot = F.regexp_extract("row_id", r"^(.*)_(\d+)$", 1), F.regexp_extract("row_id", r"^(.*)_(\d+)$", 2).cast("long")
    return rows.select(name.alias("name"), knot.alias("knot"), "member", "value").unionByName(kept.select("name", "knot", "member", "value"))
