"""Frames, windows and intervals of time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: How frames of an interval, or all of them, become one; register another by adding to it.
MODES = {"mean": F.avg, "median": F.median, "max": F.max, "min": F.min}


def known(c: str) -> Column:
    """A value that takes part in a reduction: NaN counts as missing."""
    return F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double"))


def reduce_time(state: DataFrame, mode: str, values: list[str], keys: list[str]) -> DataFrame:
    """All frames as one."""
    return state.groupBy(*keys).agg(*[MODES[mode](known(v)).alias(v) for v in values])


def reduce_intervals(state: DataFrame, seconds: float, mode: str, values: list[str], keys: list[str], *, run: list[str] | None = None, time: str = "time") -> DataFrame:
    """Frames of tumbling intervals as one each, numbered from 0 through the intervals that have any.

    Intervals start at the first frame of the run (all rows, without ``run``).
    """
    if not seconds or seconds <= 0:
        raise ValueError("intervals need a length of over 0 seconds")
    run = run or []
    # Frames are few: their times, with the intervals they fall in, meet the cells in an equi-join.
    every = Window.partitionBy(*(run or [F.lit(1)]))
    frames = state.select(*run, time).distinct()
    frames = frames.withColumn("__bin", F.floor((F.col(time) - F.min(time).over(every)) / seconds))
    frames = frames.withColumn("bin", F.dense_rank().over(every.orderBy("__bin")).cast("long") - 1).drop("__bin")
    others = [k for k in keys if k not in run]
    return state.join(frames, [*run, time]).groupBy(*run, *others, "bin").agg(*[MODES[mode](known(v)).alias(v) for v in values])


def obs_id(block: Column, var: Column, sensor: Column, variables: int, sensors: int) -> Column:
    """Where an observation stands in the vector: blocks, then variables, then sensors, the last running fastest."""
    return ((block * variables + var) * sensors + sensor).cast("long")


def as_observations(wide: DataFrame, variables: list[str], sensors: int, *, block: str = "bin", sensor: str = "sensor") -> DataFrame:
    """Wide sensor rows as an observation vector: ``(others, var, value, obs_id)``."""
    others = [c for c in wide.columns if c not in variables]
    pairs = F.explode(F.array(*[F.struct(F.lit(i).alias("n"), F.lit(v).alias("var"), F.col(v).alias("value")) for i, v in enumerate(variables)]))
    long = wide.select(*others, pairs.alias("p")).select(*others, "p.*")
    return long.withColumn("obs_id", obs_id(F.col(block), F.col("n"), F.col(sensor), len(variables), sensors)).drop("n")


def full_observations(at_sensors: DataFrame, variables: list[str], sensors: int, *, frame: str = "frame_idx") -> DataFrame:
    """Every frame as a block of observations, frames outermost: ``(others, var, value, obs_id)``.

    Blocks are numbered from 0 through the frames that there are.
    """
    order = Window.partitionBy(F.lit(1)).orderBy(frame)
    frames = at_sensors.select(frame).distinct().withColumn("bin", F.row_number().over(order).cast("long") - 1)  # frames are few
    return as_observations(at_sensors.join(F.broadcast(frames), frame), variables, sensors)


def take_frames(state: DataFrame, start: int, count: int, *, t_offset: float = 0.0, x_offset: float = 0.0, x_cols: tuple[str, ...] = ("x", "xt", "xm", "xu")) -> DataFrame:
    """Frames ``start .. start + count``, times and x coordinates shifted; the filter reaches the scan."""
    got = state.where((F.col("frame_idx") >= start) & (F.col("frame_idx") < start + count))
    moved = {c: F.col(c) + x_offset for c in x_cols if c in state.columns} if x_offset else {}
    return got.withColumns({"time": F.col("time") - t_offset, **moved})


def window_frames(state: DataFrame, window: int, frames: int) -> DataFrame:
    """The frames of one assimilation window, by number, half open."""
    return state.where((F.col("frame_idx") >= window * frames) & (F.col("frame_idx") < (window + 1) * frames))


def horizon(state: DataFrame, start: float, length: float) -> DataFrame:
    """Frames from ``start`` on, times rebased to it, before ``length``."""
    return state.where(F.col("time") >= start).withColumn("time", F.col("time") - start).where(F.col("time") < length)


def trim_spinup(state: DataFrame, seconds: float) -> DataFrame:
    """Without the frames before ``seconds``, times rebased; an error if nothing is left."""
    kept = state.where(F.col("time") >= seconds)
    if kept.isEmpty():
        raise ValueError(f"no frame at or after {seconds} s")
    return kept.withColumn("time", F.col("time") - seconds)


def exact_frames(state: DataFrame, dropped: int, count: int, keys: list[str], *, repeat: bool = False) -> DataFrame:
    """``count`` frames after ``dropped`` ones, the last of them if there are more; with fewer, an error, or
    with ``repeat`` the last one again. Frames are numbered anew."""
    order = Window.partitionBy(*keys).orderBy("frame_idx")
    size = Window.partitionBy(*keys)
    kept = state.withColumn("__n", F.row_number().over(order)).where(F.col("__n") > dropped)
    kept = kept.withColumn("__left", F.count(F.lit(1)).over(size)).withColumn("__at", F.row_number().over(order) - 1 - F.greatest(F.col("__left") - count, F.lit(0)))
    kept = kept.where(F.col("__at") >= 0)
    short = F.col("__left") < count
    if repeat:
        last = F.col("__at") == F.col("__left") - 1
        slots = F.when(short & last, F.sequence(F.col("__at"), F.lit(count - 1).cast("long"))).otherwise(F.array(F.col("__at").cast("long")))
        kept = kept.withColumn("__at", F.explode(slots))
    else:
        kept = kept.withColumn("__at", F.when(short, F.raise_error(F.lit("too few frames")).cast("long")).otherwise(F.col("__at")))
    return kept.withColumn("frame_idx", F.col("__at").cast("long")).drop("__n", "__left", "__at")


def stitch(rows: DataFrame, length: float, *, window: str = "window", keys: list[str] | None = None, rebase: bool = True) -> DataFrame:
    """Windows one after the other on one time axis."""
    start = F.min("time").over(Window.partitionBy(*(keys or []), window)) if rebase else F.lit(0.0)
    return rows.withColumn("time", F.col("time") - start + F.col(window) * length)


def prepend_plateau(schedule: DataFrame, seconds: float, keys: list[str]) -> DataFrame:
    """A schedule after a spin-up in which its first values hold: shifted, with a row at 0 before it."""
    others = [c for c in schedule.columns if c not in [*keys, "time"]]
    first = schedule.groupBy(*keys).agg(F.min_by(F.struct(*others), "time").alias("__f")).select(*keys, F.lit(0.0).alias("time"), "__f.*")
    return first.unionByName(schedule.withColumn("time", F.col("time") + seconds)) if seconds > 0 else schedule


def rebase_clock(schedule: DataFrame, keys: list[str], offset: float = 0.0) -> DataFrame:
    """Times counted from each schedule's first one, plus ``offset``."""
    first = F.min("time").over(Window.partitionBy(*keys))
    return schedule.withColumn("time", F.col("time") - first + offset)


def step_samples(states: DataFrame, k: int, keys: list[str], value: str, params: list[str], *, order: str = "frame_idx") -> DataFrame:
    """Training pairs ``k`` frames apart, with the parameters of the ``k`` steps between; none crosses the end.

    A table in which no series has more than ``k`` frames is an error.
    """
    if states.groupBy(*keys).count().where(F.col("count") > k).isEmpty():
        raise ValueError(f"no series of more than {k} frames")
    w = Window.partitionBy(*keys).orderBy(order)
    steps = w.rowsBetween(Window.currentRow, k - 1)
    got = states.withColumn("target", F.lead(value, k).over(w)).withColumns({f"{p}_steps": F.collect_list(p).over(steps) for p in params})
    return got.withColumn("__has", F.lead(F.lit(True), k).over(w)).where("__has").drop("__has")


def output_steps(times: list[float], dt: float, steps: int) -> list[int]:
    """The step nearest each requested time, strictly ascending, within the run."""
    out: list[int] = []
    for t in times:
        step = max(min(round(t / dt), steps), out[-1] + 1 if out else 0)
        if step <= steps:
            out.append(step)
    return out


def last_frames(states: DataFrame, keys: list[str], time: str = "time") -> DataFrame:
    """The last frame of each member: a pre-aggregated maximum, then a join on it."""
    last = states.groupBy(*keys).agg(F.max(time).alias("__t"))
    return states.join(last, keys).where(F.col(time) == F.col("__t")).drop("__t")


def first_frames(states: DataFrame) -> DataFrame:
    """Each member's first frame."""
    return states.where("frame_idx = 0")


def column_runs(solid: DataFrame, keys: list[str] = ["i", "j"], k: str = "k") -> DataFrame:  # noqa: B006
    """Vertical runs of solid cells as ``(keys, ks, ke)``, both ends included."""
    island = F.col(k) - F.row_number().over(Window.partitionBy(*keys).orderBy(k))
    return solid.withColumn("__g", island).groupBy(*keys, "__g").agg(F.min(k).alias("ks"), F.max(k).alias("ke")).drop("__g")


def window_edges(windows: int, length: float) -> list[tuple[int, float, float, bool]]:
    """``(window, start, end, shaded)`` of equal windows, every other one shaded."""
    return [(w, w * length, (w + 1) * length, w % 2 == 1) for w in range(windows)]
