"""Gridded fields as rows: slices, magnitude, weights, interpolation at points, collocation, regridding.

A state has index columns (``kz, ky, kx``, with ``time`` or ``frame_idx`` and ``m`` where it has frames and
members) and value columns. An axis table has ``(axis, k, coord)``; it and the points are small
dimensions (thousands of rows), and so are the weight tables made of them.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meshlark.functions.scalar import magnitude

#: The axis that each component sits on, by how a solver's grid is staggered: fixed values.
STAGGERING = {
    "faces": {"u": ("zt", "yt", "xm"), "v": ("zt", "ym", "xt"), "w": ("zm", "yt", "xt")},
    "centres": {"u": ("z", "y", "x"), "v": ("z", "y", "x"), "w": ("z", "y", "x")},
    "mixed": {"u": ("z", "y", "xu"), "v": ("z", "yv", "x"), "w": ("z", "y", "x")},
}
#: Base parameters of models on these grids: fixed values.
PARAMETERS = {"faces": ["inflow_angle", "velocity_magnitude", "pressure_gradient_magnitude"], "centres": ["inflow_angle", "velocity_magnitude"], "mixed": ["inflow_angle", "velocity_magnitude"]}


def resolve_axis(columns: list[str], wanted: str) -> str:
    """The column that holds an axis: the wanted one, or the first that begins with its letter."""
    found = [c for c in columns if c == wanted] or sorted(c for c in columns if c[:1] == wanted[:1])
    if not found:
        raise ValueError(f"no column for the axis {wanted!r} among {columns}")
    return found[0]


def with_magnitude(state: DataFrame, out: str = "vel", components: tuple[str, ...] = ("u", "v", "w")) -> DataFrame:
    """``state`` with the length of its vector; unchanged if it lacks a component."""
    if not set(components) <= set(state.columns):
        return state
    return state.withColumn(out, magnitude(*[F.col(c) for c in components]))


def z_plane(state: DataFrame, level: int) -> DataFrame:
    """One horizontal plane of all frames and members."""
    return state.where(F.col("kz") == level)


def last_slice(state: DataFrame, level: int | None = None, time_col: str = "frame_idx") -> DataFrame:
    """The last frame at one level; the middle one if none is given."""
    last = state.agg(F.max(time_col).alias("t"), F.floor((F.max("kz") + 1) / 2).alias("mid"))
    pick = F.col("mid") if level is None else F.lit(level)
    return state.join(F.broadcast(last), (state[time_col] == last["t"]) & (state["kz"] == pick)).drop("t", "mid")


def slice_extent(plane: DataFrame, x: str, y: str) -> DataFrame:
    """The rectangle that a slice covers."""
    return plane.agg(F.min(x).alias("x_min"), F.max(x).alias("x_max"), F.min(y).alias("y_min"), F.max(y).alias("y_max"))


def spread_levels(levels: int, n: int = 4) -> list[int]:
    """``n`` evenly spaced level numbers, halves to even, each once."""
    return sorted({int(k) for k in np.rint(np.linspace(0, levels - 1, n))})


def spread_frames(frames: int, n: int) -> list[int]:
    """``n`` evenly spaced frame numbers, truncated, each once."""
    return sorted({int(k) for k in np.linspace(0, frames - 1, n)})


def fill_solids(state: DataFrame, columns: list[str]) -> DataFrame:
    """NaN and null, which solvers write inside solids, as 0."""
    return state.withColumns({c: F.coalesce(F.nanvl(F.col(c), F.lit(None).cast("double")), F.lit(0.0)) for c in columns})


def axis_summary(axes: DataFrame) -> DataFrame:
    """``(axis, cells, origin)``: how many cells each axis has, and its first coordinate."""
    return axes.groupBy("axis").agg(F.count(F.lit(1)).alias("cells"), F.min("coord").alias("origin"))


def rescale(state: DataFrame, factors: dict[str, float], shifts: dict[str, float] | None = None, *, inverse: bool = False) -> DataFrame:
    """Columns times their factors, plus their shifts; ``inverse`` undoes it."""
    shifts = shifts or {}

    def one(c: str) -> Column:
        factor, shift = factors.get(c, 1.0), shifts.get(c, 0.0)
        return (F.col(c) - shift) / factor if inverse else F.col(c) * factor + shift

    return state.withColumns({c: one(c) for c in {**factors, **shifts}})


def finite(c: Column) -> Column:
    """Whether a value takes part in statistics."""
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))


def drop_lowest(state: DataFrame) -> DataFrame:
    """Without the first layer, levels numbered anew."""
    return state.where("kz > 0").withColumn("kz", F.col("kz") - 1)


def points_from_grid(spark, sensor_set: str, xs: tuple[float, float, int], ys: tuple[float, float, int], z: float) -> DataFrame:
    """Points on a horizontal raster, numbered row by row: ``(start, stop, number)`` of both axes."""

    def line(name: str, start: float, stop: float, n: int) -> DataFrame:
        step = (stop - start) / max(1, n - 1)
        return spark.range(n).select(F.col("id").alias(f"i_{name}"), (F.lit(float(start)) + F.col("id") * step).alias(name))

    n_x = xs[2]
    both = spark.range(n_x * ys[2]).select((F.col("id") % n_x).alias("i_x"), F.floor(F.col("id") / n_x).alias("i_y"), F.col("id").alias("sensor"))
    return both.join(line("x", *xs), "i_x").join(line("y", *ys), "i_y").select(F.lit(sensor_set).alias("sensor_set"), "sensor", "x", "y", F.lit(float(z)).alias("z"))


def pick_cells(state: DataFrame, cells: DataFrame) -> DataFrame:
    """Values at ``cells(sensor, kz, ky, kx)``; the cells are broadcast, a handful of sensors."""
    return state.join(F.broadcast(cells), ["kz", "ky", "kx"])


def axis_weights(axes: DataFrame, points: DataFrame, axis: str, point_col: str | None = None, *, check: bool = True) -> DataFrame:
    """For each point, the cells below and above on one axis and the weight of the upper one.

    Beyond the ends the outermost interval is extended; with ``check``, points more than half the
    median spacing outside, an axis that does not ascend strictly, or one of a single
    coordinate raise an error. Returns the points with ``lo_<axis>``, ``hi_<axis>``, ``w_<axis>``.
    """
    p = F.col(point_col or axis)
    # Names of the points' own columns cannot clash with these.
    here = axes.where(F.col("axis") == axis).select(F.lit(1).alias("__one"), F.col("k").alias("__k"), F.col("coord").alias("__c"))
    order = Window.partitionBy("__one").orderBy("__k")
    step = here.withColumn("__hi", F.lead("__k").over(order)).withColumn("__next", F.lead("__c").over(order))
    step = step.withColumn("__first", F.lag("__k").over(order).isNull()).withColumn("__last", F.lead("__hi").over(order).isNull())
    facts = step.groupBy("__one").agg(F.min("__c").alias("__low"), F.max("__c").alias("__high"), F.median(F.col("__next") - F.col("__c")).alias("__gap"), F.min(F.col("__next") - F.col("__c")).alias("__least"))
    steps = step.where("__hi is not null").join(F.broadcast(facts), "__one")  # an axis: one row for each cell
    # Each different coordinate meets the axis once; the points then meet their coordinates by equality.
    places = points.select(p.alias("__p")).distinct()
    q = F.col("__p")
    got = places.join(F.broadcast(steps), (F.col("__first") | (q >= F.col("__c"))) & (F.col("__last") | (q < F.col("__next"))))
    weight = (q - F.col("__c")) / (F.col("__next") - F.col("__c"))
    if check:
        wrong = (F.col("__least") <= 0) | (q < F.col("__low") - F.col("__gap") / 2) | (q > F.col("__high") + F.col("__gap") / 2)
        weight = F.when(wrong, F.raise_error(F.concat(F.lit(f"a point is outside the axis {axis}, or the axis does not ascend: "), q.cast("string"))).cast("double")).otherwise(weight)
    got = got.select("__p", F.col("__k").alias(f"lo_{axis}"), F.col("__hi").alias(f"hi_{axis}"), weight.alias(f"w_{axis}"))
    return points.join(got, p == F.col("__p")).drop("__p")


def corner_weights(axes: DataFrame, points: DataFrame, dims: tuple[str, ...] = ("x", "y", "z"), **options) -> DataFrame:
    """The weights of the cells around each point: a row for each corner, with ``k<axis>`` and ``weight``."""
    table = reduce(lambda t, a: axis_weights(axes, t, a, **options), dims, points)
    sides = F.array(F.lit(0), F.lit(1))
    weight = F.lit(1.0)
    for a in dims:
        table = table.withColumn(f"s_{a}", F.explode(sides)).withColumn(f"k{a}", F.when(F.col(f"s_{a}") == 0, F.col(f"lo_{a}")).otherwise(F.col(f"hi_{a}")))
        weight = weight * F.when(F.col(f"s_{a}") == 0, 1 - F.col(f"w_{a}")).otherwise(F.col(f"w_{a}"))
    return table.select(*points.columns, *[f"k{a}" for a in dims], weight.alias("weight"))


def interpolate_at(state: DataFrame, weights: DataFrame, values: list[str], keys: list[str], dims: tuple[str, ...] = ("z", "y", "x"), *, partial: bool = False) -> DataFrame:
    """Linear interpolation of ``values`` at the points of a corner-weight table, per ``keys``.

    An equi-join on the cells, whose weights Spark broadcasts where they are small (sensors); only cells around points
    pass it. A point without all its cells is null, unless ``partial``.
    """
    corners = 2 ** len(dims)
    joined = state.join(weights, [f"k{d}" for d in dims])
    total = {v: F.sum(F.col(v) * F.col("weight")) for v in values}
    if not partial:
        total = {v: F.when(F.count(v) == corners, t) for v, t in total.items()}
    return joined.groupBy(*keys).agg(*[t.alias(v) for v, t in total.items()])


def collocate(field: DataFrame, value: str, axis: str, keys: list[str]) -> DataFrame:
    """A component from faces to cell centres along ``axis``, spacing uniform: the mean with the next face;
    the last centre is extended from the last two faces."""
    order = Window.partitionBy(*keys).orderBy(f"k{axis}")
    ahead, behind = F.lead(value).over(order), F.lag(value).over(order)
    return field.withColumn(value, F.coalesce((F.col(value) + ahead) / 2, F.col(value) + (F.col(value) - behind) / 2, F.col(value)))


def regrid(field: DataFrame, axes: DataFrame, target: DataFrame, value: str, keys: list[str], dims: tuple[str, ...], *, extrapolate: bool = False) -> DataFrame:
    """``value`` at target points ``(id columns, dims)``; outside the source grid null, or extended."""
    points = target
    if not extrapolate:
        # One row with the ends of all axes.
        at = {a: F.when(F.col("axis") == a, F.col("coord")) for a in dims}
        ends = axes.agg(*[f(c).alias(f"__{n}_{a}") for a, c in at.items() for n, f in (("lo", F.min), ("hi", F.max))])
        inside = [F.col(a).between(F.col(f"__lo_{a}"), F.col(f"__hi_{a}")) for a in dims]
        points = points.join(F.broadcast(ends), reduce(lambda x, y: x & y, inside)).select(*target.columns)
    weights = corner_weights(axes, points, dims, check=False)
    inner = interpolate_at(field, weights, [value], keys + [c for c in target.columns], dims, partial=True)
    return inner if extrapolate else target.join(inner, target.columns, "left")


def nearest_cell(axes: DataFrame, axis: str, at: float) -> DataFrame:
    """The cell whose coordinate is nearest; of two, the lower."""
    return axes.where(F.col("axis") == axis).agg(F.min(F.struct(F.abs(F.col("coord") - at).alias("d"), F.col("k").alias("k"))).alias("n")).select(F.lit(axis).alias("axis"), F.col("n.k").alias("k"))


def cell_centres(spark, n: int, size: float, start: float = 0.0) -> DataFrame:
    """``(k, centre, low, high)`` of ``n`` uniform cells."""
    k = F.col("id")
    return spark.range(n).select(k.alias("k"), ((k + 0.5) * size + start).alias("centre"), (k * size + start).alias("low"), ((k + 1) * size + start).alias("high"))


def fluid_mask(state: DataFrame, components: tuple[str, ...] = ("u", "v", "w"), blanking: str = "blanking") -> DataFrame:
    """``state`` with ``fluid``: 1 - blanking where the table has it, else whether any component is not 0."""
    moves = (sum((F.abs(F.col(c)) for c in components[1:]), F.abs(F.col(components[0]))) != 0).cast("int")
    mask = F.coalesce(1 - F.col(blanking), moves) if blanking in state.columns else moves
    return state.withColumn("fluid", mask.cast("long"))


def attach_blanking(state: DataFrame, solid: DataFrame) -> DataFrame:
    """``state`` with ``blanking``: 1 in the cells of ``solid(kz, ky, kx)``, else 0; unchanged if it has it."""
    if "blanking" in state.columns:
        return state
    marked = solid.select("kz", "ky", "kx").distinct().withColumn("blanking", F.lit(1).cast("long"))
    return state.join(marked, ["kz", "ky", "kx"], "left").withColumn("blanking", F.coalesce("blanking", F.lit(0)).cast("long"))


#: Names of cell-centre axes after collocation: fixed values.
REGULAR = {"xt": "x", "yt": "y", "zt": "z"}


def to_regular(state: DataFrame) -> DataFrame:
    """Centre axes under their plain names; nothing changes where they have them."""
    return state.withColumnsRenamed({a: b for a, b in REGULAR.items() if a in state.columns and b not in state.columns})


def limits(state: DataFrame, values: list[str]) -> DataFrame:
    """``(var, low, high)``: the range of each variable over all finite cells and frames."""
    pairs = F.explode(F.array(*[F.struct(F.lit(v).alias("var"), F.col(v).cast("double").alias("value")) for v in values]))
    return state.select(pairs.alias("p")).select("p.*").where(finite(F.col("value"))).groupBy("var").agg(F.min("value").alias("low"), F.max("value").alias("high"))


def long_components(wide: DataFrame, keys: list[str], components: tuple[str, ...] = ("u", "v", "w")) -> DataFrame:
    """Components and their magnitude as rows ``(keys, var, value)``."""
    full = with_magnitude(wide, "vel", components)
    names = [*components, "vel"]
    pairs = F.explode(F.array(*[F.struct(F.lit(v).alias("var"), F.col(v).alias("value")) for v in names]))
    return full.select(*keys, pairs.alias("p")).select(*keys, "p.*")


def sensor_series(states: DataFrame, axes: DataFrame, points: DataFrame, keys: list[str], values: tuple[str, ...] = ("u", "v", "w")) -> DataFrame:
    """Series of all sensor sets at once, by one set of weights: ``(sensor_set, sensor, keys, var, value)``."""
    at = interpolate_at(states, corner_weights(axes, points), list(values), ["sensor_set", "sensor", *keys])
    return long_components(at, ["sensor_set", "sensor", *keys], values)


def initial_fields(state: DataFrame, axes: DataFrame, target: DataFrame, values: list[str], keys: list[str]) -> DataFrame:
    """Fields on another grid to start a solver from: linear, extended at the ends, without NaN.

    ``target(.., x, y, z)`` are the cells of the other grid.
    """
    weights = corner_weights(axes, target, check=False)
    got = interpolate_at(state, weights, values, [*keys, *target.columns], partial=True)
    return fill_solids(got, values)
