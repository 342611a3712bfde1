"""Tables over parameter sweeps: names, summaries, held axes, best covered settings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: How a run's name spells its settings: model, grid, ensemble, steps, optional interval and localisation.
TAG = r"^(.+?)_nx(\d+)_ny(\d+)_nz(\d+)_ens(\d+)_steps(\d+)(?:_int([0-9.]+))?(_loc)?$"


def fill_settings(runs: DataFrame, summary: str, fields: dict[str, tuple[str, ...]]) -> DataFrame:
    """Settings that a run's name does not spell, from its summary; what the name spells stays. Cells and grid follow."""
    filled = runs.withColumns({c: F.coalesce(F.col(c), safe(summary, *path).cast(runs.schema[c].dataType)) for c, path in fields.items()})
    known = F.col("nx").isNotNull() & F.col("ny").isNotNull() & F.col("nz").isNotNull()
    return filled.withColumns({"grid_cells": F.col("nx") * F.col("ny") * F.col("nz"), "grid": F.when(known, F.concat_ws("x", "nx", "ny", "nz"))})


def parse_tags(runs: DataFrame, tag: str = "tag") -> DataFrame:
    """``runs`` with the settings in their names; null where a name does not spell them."""
    fits = F.col(tag).rlike(TAG)

    def part(n: int, kind: str) -> Column:
        return F.when(fits, F.nullif(F.regexp_extract(tag, TAG, n), F.lit("")).cast(kind))

    out = runs.withColumns({"model": part(1, "string"), **{c: part(n, "long") for n, c in ((2, "nx"), (3, "ny"), (4, "nz"), (5, "ensemble_size"), (6, "esmda_steps"))}})
    return out.withColumns({
        "interval_seconds": part(7, "double"),
        "localization": F.when(fits, F.regexp_extract(tag, TAG, 8) != ""),
        "grid_cells": F.col("nx") * F.col("ny") * F.col("nz"),
        "grid": F.when(fits, F.concat_ws("x", "nx", "ny", "nz")),
    })


def safe(c: str, *path: str) -> Column:
    """A field deep in a JSON column; null where a level is missing."""
    return F.get_json_object(c, "$" + "".join(f".{p}" for p in path))


def flatten_summary(runs: DataFrame, summary: str, fields: dict[str, tuple[str, ...]]) -> DataFrame:
    """``runs`` with numbers out of their nested summaries."""
    return runs.withColumns({name: safe(summary, *path).cast("double") for name, path in fields.items()})


def mode_of(rows: DataFrame, column: str, first_by: str) -> DataFrame:
    """The most common value; of several, the one seen first."""
    counts = rows.where(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("n"), F.min(first_by).alias("first"))
    return counts.orderBy(F.col("n").desc(), "first").limit(1).select(F.col(column).alias("value"), "n")


def hold_axes(rows: DataFrame, swept: str, axes: list[str], first_by: str) -> tuple[DataFrame, dict]:
    """The rows in which only ``swept`` varies: other axes are held, one after the other, at their mode."""
    held = {}
    for axis in axes:
        if axis == swept or rows.where(F.col(axis).isNotNull()).select(axis).distinct().limit(2).count() <= 1:
            continue
        held[axis] = mode_of(rows, axis, first_by).first()["value"]
        rows = rows.where(F.col(axis) == held[axis])
    return rows, held


def pick_domain(rows: DataFrame, grid: str = "grid", size: str = "ensemble_size") -> DataFrame:
    """The grid with the most ensemble sizes, then the most runs, then the least."""
    counts = rows.groupBy(grid).agg(F.countDistinct(size).alias("sizes"), F.count(F.lit(1)).alias("runs"))
    return counts.orderBy(F.col("sizes").desc(), F.col("runs").desc(), grid).limit(1)


def best_combo(rows: DataFrame, keys: list[str], model: str = "model") -> DataFrame:
    """The rows of the setting that the most models cover, then the most rows, then the least setting."""
    counts = rows.groupBy(*keys).agg(F.countDistinct(model).alias("__models"), F.count(F.lit(1)).alias("__rows"))
    best = counts.orderBy(F.col("__models").desc(), F.col("__rows").desc(), *keys).limit(1)
    return rows.join(F.broadcast(best.select(*keys)), keys, "left_semi")


#: The order of runs: fixed values.
RUN_ORDER = ("model", "grid_cells", "ensemble_size", "esmda_steps")


def sort_runs(rows: DataFrame, position: str | None = None) -> DataFrame:
    """Runs by model, cells, members and steps; ``position`` also numbers them from 0 (runs are few)."""
    ordered = rows.orderBy(*RUN_ORDER)
    return ordered if position is None else rows.withColumn(position, F.rank().over(Window.orderBy(*RUN_ORDER)).cast("long") - 1)


def trajectories(rows: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """Mean and population spread of an ensemble along its knots."""
    return rows.groupBy(*keys).agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"))


def top_rows(rows: DataFrame, keys: list[str], order: list, k: int) -> DataFrame:
    """The first ``k`` rows of each group."""
    return rows.withColumn("__r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("__r") <= k).drop("__r")


def of_models(rows: DataFrame, models: list[str], name: str = "run") -> DataFrame:
    """Runs whose name begins with one of the models'; all of them if none is given."""
    keep = F.lit(not models)
    for m in models:
        keep = keep | F.col(name).startswith(f"{m}_") | (F.col(name) == m)
    return rows.where(keep)
