"""Stand-ins for grids, ensembles, truths, sensors and runs on the driver's tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r6(c: Column | str) -> Column:
    """Rounded for comparison across engines."""
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c, 6)


def big(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("long")


# Functions, as columns need a session and modules are imported without one.


def _cell() -> dict[str, Column]:
    return {"kz": F.col("l_linenumber") - 1, "ky": F.col("l_suppkey") % 4, "kx": F.col("l_partkey") % 5}


def _uvw() -> list[Column]:
    return [F.avg("l_quantity").alias("u"), (F.avg("l_extendedprice") / 1000).alias("v"), (F.avg("l_discount") * 100).alias("w")]


_SQL_CELL = "CAST(l_linenumber-1 AS BIGINT) AS kz, l_suppkey%4 AS ky, l_partkey%5 AS kx"
_SQL_UVW = "avg(l_quantity) AS u, avg(l_extendedprice)/1000 AS v, avg(l_discount)*100 AS w"


def grid(spark: SparkSession, d: str) -> DataFrame:
    """``(kz, ky, kx, m, u, v, w)``: an ensemble of 8 states on 7 x 4 x 5 cells."""
    keys = [big(c).alias(k) for k, c in _cell().items()] + [(F.col("l_orderkey") % 8).alias("m")]
    return table(spark, d, "lineitem").groupBy(*keys).agg(*_uvw())


GRID = f"SELECT {_SQL_CELL}, l_orderkey%8 AS m, {_SQL_UVW} FROM lineitem GROUP BY ALL"


def timed_grid(spark: SparkSession, d: str) -> DataFrame:
    """``(frame_idx, time, kz, ky, kx, u, v, w)``: one state in frames two seconds apart."""
    orders = table(spark, d, "orders").select("o_orderkey", F.year("o_orderdate").alias("y"))
    rows = table(spark, d, "lineitem").join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    keys = [big(F.col("y") - 1995).alias("frame_idx")] + [big(c).alias(k) for k, c in _cell().items()]
    return rows.groupBy(*keys).agg(*_uvw()).withColumn("time", F.col("frame_idx") * 2.0)


TIMED = (
    f"SELECT frame_idx, frame_idx*2.0::DOUBLE AS time, kz, ky, kx, u, v, w FROM (SELECT CAST(year(o_orderdate)-1995 AS BIGINT) AS frame_idx, {_SQL_CELL}, {_SQL_UVW} "
    "FROM lineitem JOIN orders ON l_orderkey=o_orderkey GROUP BY ALL)"
)


def series(spark: SparkSession, d: str) -> DataFrame:
    """``(param, k, m, x)``: ensembles of 16 of five parameters over the days of a month."""
    rows = table(spark, d, "events").select(F.col("event_type").alias("param"), big(F.day("ts")).alias("k"), (F.col("user_id") % 16).alias("m"), "value")
    return rows.groupBy("param", "k", "m").agg(F.avg("value").alias("x"))


SERIES = "SELECT event_type AS param, CAST(day(ts) AS BIGINT) AS k, user_id%16 AS m, avg(value) AS x FROM events GROUP BY ALL"


def truth(spark: SparkSession, d: str) -> DataFrame:
    """``(param, k, y)``: what the ensembles are held against."""
    rows = table(spark, d, "events").select(F.col("event_type").alias("param"), big(F.day("ts")).alias("k"), "value")
    return rows.groupBy("param", "k").agg(F.avg("value").alias("y"))


TRUTH = "SELECT event_type AS param, CAST(day(ts) AS BIGINT) AS k, avg(value) AS y FROM events GROUP BY ALL"

#: Sensors (set, number, x, y, z) inside the box [0, 4] x [0, 3] x [0, 6]: fixed values.
SENSOR_ROWS = [
    ("assimilation", 0, 0.5, 1.25, 2.5),
    ("assimilation", 1, 3.75, 0.5, 0.25),
    ("assimilation", 2, 2.0, 3.0, 6.0),
    ("assimilation", 3, -0.25, 2.2, 6.4),
    ("validation", 0, 1.1, 1.9, 3.3),
    ("validation", 1, 4.4, -0.3, 5.0),
]


def sensors(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(SENSOR_ROWS, "sensor_set string, sensor long, x double, y double, z double")


SENSORS = "SELECT * FROM (VALUES " + ", ".join(f"('{s}', {n}::BIGINT, {x}::DOUBLE, {y}::DOUBLE, {z}::DOUBLE)" for s, n, x, y, z in SENSOR_ROWS) + ") AS s(sensor_set, sensor, x, y, z)"


def axes(spark: SparkSession) -> DataFrame:
    """``(axis, k, coord)``: cells one metre apart."""
    rows = [(a, k, float(k)) for a, n in (("x", 5), ("y", 4), ("z", 7)) for k in range(n)]
    return spark.createDataFrame(rows, "axis string, k long, coord double")


AXES = "SELECT a AS axis, unnest(range(n)) AS k, CAST(unnest(range(n)) AS DOUBLE) AS coord FROM (VALUES ('x', 5), ('y', 4), ('z', 7)) AS t(a, n)"


def runs(spark: SparkSession, d: str) -> DataFrame:
    """``(run_id, tag, metric)``: a sweep's runs with names that spell out their settings."""
    p = table(spark, d, "part")
    tag = F.concat(
        F.lit("m"), F.substring("p_brand", 7, 1), F.lit("_nx"), F.col("p_size") * 10, F.lit("_ny"), (F.col("p_size") % 4 + 1) * 20, F.lit("_nz"), F.lit("16_ens"),
        F.col("p_partkey") % 3 * 32 + 32, F.lit("_steps"), F.col("p_partkey") % 2 + 2, F.when(F.col("p_partkey") % 5 == 0, F.concat(F.lit("_int"), F.col("p_size") % 7 + 1)).otherwise(""),
        F.when(F.col("p_partkey") % 4 == 0, "_loc").otherwise(""),
    )
    return p.select(F.col("p_partkey").alias("run_id"), tag.alias("tag"), F.col("p_retailprice").alias("metric"))


RUNS = (
    "SELECT p_partkey AS run_id, 'm' || substring(p_brand, 7, 1) || '_nx' || p_size*10 || '_ny' || (p_size%4+1)*20 || '_nz16_ens' || (p_partkey%3*32+32) || '_steps' || (p_partkey%2+2)"
    " || CASE WHEN p_partkey%5=0 THEN '_int' || (p_size%7+1) ELSE '' END || CASE WHEN p_partkey%4=0 THEN '_loc' ELSE '' END AS tag, p_retailprice AS metric FROM part"
)


def dt_log(spark: SparkSession, d: str) -> DataFrame:
    """``(run, step, dt)``: time-step sizes in the order in which each run logged them."""
    from pyspark.sql import Window

    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, d, "events").select(F.col("user_id").alias("run"), big(F.row_number().over(order)).alias("step"), F.col("value").alias("dt"))


DT_LOG = "SELECT user_id AS run, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS step, value AS dt FROM events"


def solids(spark: SparkSession, d: str) -> DataFrame:
    """``(i, j, k)``: solid cells of columns, 1-based."""
    return table(spark, d, "lineitem").select(F.col("l_suppkey").alias("i"), big("l_linenumber").alias("j"), F.col("l_quantity").cast("long").alias("k")).distinct()


SOLIDS = "SELECT DISTINCT l_suppkey AS i, CAST(l_linenumber AS BIGINT) AS j, CAST(floor(l_quantity) AS BIGINT) AS k FROM lineitem"


def vectors(spark: SparkSession, d: str, low: int, high: int) -> DataFrame:
    """``(row_id, member, value)``: components ``low`` .. ``high`` of the vectors, a vector to a member."""
    rows = table(spark, d, "embeddings").select(F.col("vec_id").alias("member"), F.posexplode("embedding").alias("row_id", "value"))
    return rows.where(F.col("row_id").between(low, high)).select(big("row_id").alias("row_id"), "member", F.col("value").cast("double").alias("value"))


def VECTORS(low: int, high: int) -> str:  # noqa: N802
    return f"SELECT CAST(i AS BIGINT) AS row_id, vec_id AS member, CAST(embedding[i+1] AS DOUBLE) AS value FROM embeddings, (SELECT unnest(range({low},{high + 1})) AS i)"
