"""A watchdog over logged time steps: trips after several small ones in a row.

The rule is one; a table of logs is settled by windows, a stream by a state of two counters for each run.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: How a log line states its time step.
LINE = r"\bdt\s*[:=]\s*([-+0-9.eE]+)"


def parse_log(lines: DataFrame, text: str = "value") -> DataFrame:
    """Lines that state a time step, with ``dt``; works on batches and streams alike."""
    dt = F.expr(f"try_cast(nullif(regexp_extract({text}, r'{LINE}', 1), '') as double)")
    return lines.withColumn("dt", dt).where("dt is not null")


def tripped(log: DataFrame, least: float, *, patience: int, warmup: int = 0) -> DataFrame:
    """``(run, step)``: where each run has had ``patience`` steps below ``least`` in a row, the first ``warmup`` ignored.

    ``log(run, step, dt)``, steps from 1; runs that never trip are absent.
    """
    after = log.where(F.col("step") > warmup)
    order = Window.partitionBy("run").orderBy("step")
    low = F.col("dt") < least
    streak = after.withColumn("__ok", F.sum(F.when(low, 0).otherwise(1)).over(order)).where(low)
    count = F.row_number().over(Window.partitionBy("run", "__ok").orderBy("step"))
    return streak.withColumn("__n", count).where(F.col("__n") == patience).groupBy("run").agg(F.min("step").alias("step"))


def watch(stream: DataFrame, least: float, *, patience: int, warmup: int = 0) -> DataFrame:
    """The same over a stream ``(run string, step long, dt double)``: a row for each run when it first trips.

    The state of a run is its count of steps, its streak, and whether it has tripped.
    """

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seen, streak, done = state.get if state.exists else (0, 0, False)
        hit = None
        for row in pd.concat(list(batches)).sort_values("step").itertuples():
            seen += 1
            if done or seen <= warmup:
                continue
            streak = streak + 1 if row.dt < least else 0
            if streak >= patience:
                done, hit = True, row.step
        state.update((seen, streak, done))
        if hit is not None:
            yield pd.DataFrame({"run": [key[0]], "step": [hit]})

    return stream.groupBy("run").applyInPandasWithState(update, "run string, step long", "seen long, streak long, done boolean", "append", GroupStateTimeout.NoTimeout)
