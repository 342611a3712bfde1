"""Queries that score ensembles, and align series to do so."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from meshlark.operators import align, scores
from meshlark.operators import grid as g
from meshlark.operators import temporal as t
from meshlark.plans.bindings import GRID, SERIES, TIMED, TRUTH, grid, r6, series, table, timed_grid, truth
from meshlark.plans.registry import query

PK = ["param", "k"]
PAIRED = f"SELECT e.param, e.k, m, x, y FROM ({SERIES}) e JOIN ({TRUTH}) t USING (param, k)"


def _paired(spark: SparkSession, d: str) -> DataFrame:
    return series(spark, d).join(truth(spark, d), PK)


def _rounded(df: DataFrame, *keep: str) -> DataFrame:
    return df.select(*keep, *[r6(c).alias(c) for c in df.columns if c not in keep])


@query(f"SELECT param, k, round(sqrt(avg(pow(x-y,2))),6) AS rmse FROM ({PAIRED}) GROUP BY ALL")
def param_rmse(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(scores.member_rmse(_paired(spark, d), PK), *PK)


@query(f"SELECT k, round(sqrt(avg(pow(mx-y,2))),6) AS rmse FROM (SELECT param, k, avg(x) AS mx, any_value(y) AS y FROM ({PAIRED}) GROUP BY param, k) GROUP BY k")
def sensor_rmse(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(scores.mean_rmse(_paired(spark, d), ["k"], ["param"]), "k")


CRPS = f"""
WITH p AS ({PAIRED}), a AS (SELECT param, k, avg(abs(x-y)) AS near FROM p GROUP BY ALL),
b AS (SELECT p.param, p.k, avg(abs(p.x-q.x)) AS apart FROM p JOIN p q USING (param, k) GROUP BY ALL)
SELECT param, k, near-apart/2 AS crps FROM a JOIN b USING (param, k)
"""


@query(f"SELECT param, k, round(crps,6) AS crps FROM ({CRPS})")
def crps(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(scores.crps(_paired(spark, d), PK), *PK)


KNOTS = f"""
SELECT param, k, error, spread, crps, in_band FROM (
  SELECT param, k, abs(avg(x)-max(y)) AS error, coalesce(stddev_samp(x),0) AS spread,
    CAST(max(y) BETWEEN quantile_cont(x,0.05) AND quantile_cont(x,0.95) AS INTEGER) AS in_band FROM ({PAIRED}) GROUP BY ALL)
JOIN ({CRPS}) USING (param, k)
"""


@query(f"SELECT param, k, round(error,6) AS error, round(spread,6) AS spread, round(crps,6) AS crps, CAST(in_band AS BIGINT) AS in_band FROM ({KNOTS})")
def knot_metrics(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(scores.knot_metrics(_paired(spark, d), PK).withColumn("in_band", F.col("in_band").cast("long")), *PK, "in_band").select("param", "k", "error", "spread", "crps", "in_band")


_SUMMARY = "round(sqrt(avg(pow(error,2))),6) AS rmse, round(avg(spread),6) AS spread, round(avg(crps),6) AS crps, round(avg(in_band),6) AS coverage"


@query(f"SELECT param, {_SUMMARY} FROM ({KNOTS}) GROUP BY param")
def knot_summary(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(scores.knot_summary(scores.knot_metrics(_paired(spark, d), PK), ["param"]), "param")


@query(f"SELECT param, coalesce(k,-1) AS k, {_SUMMARY}, CASE WHEN grouping(k)=1 THEN 'summary' ELSE 'knot' END AS level FROM ({KNOTS}) GROUP BY GROUPING SETS ((param, k), (param))")
def metrics_sets(spark: SparkSession, d: str) -> DataFrame:
    sets = scores.knots_and_summaries(scores.knot_metrics(_paired(spark, d), PK), ["param"], "k")
    return _rounded(sets.withColumn("k", F.coalesce("k", F.lit(-1).cast("long"))), "param", "k", "level")


VECTOR = f"SELECT kz, ky, kx, m, u, v, w, avg(u) OVER c AS tu, avg(v) OVER c AS tv, avg(w) OVER c AS tw FROM ({GRID}) WINDOW c AS (PARTITION BY kz, ky)"


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    over = Window.partitionBy("kz", "ky")
    return grid(spark, d).withColumns({f"t{c}": F.avg(c).over(over) for c in "uvw"})


@query(f"""
WITH r AS ({VECTOR}), near AS (SELECT kz, ky, kx, avg(sqrt(pow(u-tu,2)+pow(v-tv,2)+pow(w-tw,2))) AS near FROM r GROUP BY ALL),
far AS (SELECT a.kz, a.ky, a.kx, avg(sqrt(pow(a.u-b.u,2)+pow(a.v-b.v,2)+pow(a.w-b.w,2))) AS apart FROM r a JOIN r b USING (kz, ky, kx) GROUP BY ALL)
SELECT kz, round(avg(near-apart/2),6) AS energy_score FROM near JOIN far USING (kz, ky, kx) GROUP BY kz
""")
def energy_score(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(scores.energy_score(_vectors(spark, d), ["kz"], "m", ["u", "v", "w"], ["tu", "tv", "tw"], ["ky", "kx"]), "kz")


@query(f"""
WITH m AS (SELECT kz, ky, kx, avg(u) AS u, avg(v) AS v, avg(w) AS w, any_value(tu) AS tu, any_value(tv) AS tv, any_value(tw) AS tw FROM ({VECTOR}) GROUP BY ALL)
SELECT kz, round(sqrt(avg(pow(u-tu,2))+avg(pow(v-tv,2))+avg(pow(w-tw,2))),6) AS vector_rmse FROM m GROUP BY kz
""")
def vector_rmse(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(scores.vector_rmse(_vectors(spark, d), ["kz"], ["ky", "kx"], [("u", "tu"), ("v", "tv"), ("w", "tw")]), "kz")


_STATS = f"SELECT param, k, CASE WHEN (k+length(param))%7=0 THEN NULL ELSE x END AS v FROM (SELECT param, k, avg(x) AS x FROM ({SERIES}) GROUP BY ALL)"


@query(f"SELECT param, round(avg(v),6) AS mean, round(struct_extract(arg_max(struct_pack(v := v), k), 'v'),6) AS final, round(max(v),6) AS max, round(min(v),6) AS min FROM ({_STATS}) p GROUP BY param")
def series_stats(spark: SparkSession, d: str) -> DataFrame:
    s = series(spark, d).groupBy(*PK).agg(F.avg("x").alias("v"))
    s = s.withColumn("v", F.when((F.col("k") + F.length("param")) % 7 == 0, F.lit(float("nan"))).otherwise(F.col("v")))
    return _rounded(scores.series_stats(s, ["param"], "v", "k"), "param")


@query(f"""
WITH post AS (SELECT param, sqrt(avg(pow(x-y,2))) AS rmse FROM ({PAIRED}) WHERE m>=8 GROUP BY ALL), prior AS (SELECT param, sqrt(avg(pow(x-y,2))) AS rmse FROM ({PAIRED}) WHERE m<8 GROUP BY ALL)
SELECT param, round(post.rmse,6) AS rmse, round(prior.rmse,6) AS prior_rmse_mean, round(CASE WHEN prior.rmse>0 THEN 1-post.rmse/prior.rmse END,6) AS rmse_reduction FROM post LEFT JOIN prior USING (param)
""")
def rmse_reduction(spark: SparkSession, d: str) -> DataFrame:
    p = _paired(spark, d)
    post, prior = (scores.member_rmse(p.where(c), ["param"]) for c in ("m >= 8", "m < 8"))
    return _rounded(scores.rmse_reduction(post, prior, ["param"]), "param")


@query(f"SELECT kz, ky, kx, round(avg(u),6) AS u_mean, round(avg(v),6) AS v_mean, round(avg(w),6) AS w_mean, round(avg(sqrt(u*u+v*v+w*w)),6) AS vel_mean, round(stddev_pop(sqrt(u*u+v*v+w*w)),6) AS vel_std FROM ({GRID}) GROUP BY ALL")
def state_summary(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(scores.state_summary(g.with_magnitude(grid(spark, d)), ["kz", "ky", "kx"]), "kz", "ky", "kx")


@query(f"""
WITH s AS (SELECT kz, ky, kx, frame_idx, sqrt(u*u+v*v+w*w) AS vel FROM ({TIMED}) WHERE kz IN (0,2,4,6)), r AS (SELECT kz, ky, kx, vel AS ref FROM s WHERE frame_idx=0)
SELECT frame_idx, round(sqrt(avg(pow(vel-ref,2))),6) AS rmse FROM s JOIN r USING (kz, ky, kx) GROUP BY frame_idx
""")
def state_rmse(spark: SparkSession, d: str) -> DataFrame:
    s = g.with_magnitude(timed_grid(spark, d).where(F.col("kz").isin(g.spread_levels(7, 4)))).select("kz", "ky", "kx", "frame_idx", "vel")
    ref = s.where("frame_idx = 0").select("kz", "ky", "kx", F.col("vel").alias("ref"))
    return _rounded(s.join(ref, ["kz", "ky", "kx"]).groupBy("frame_idx").agg(scores.rmse(F.col("vel"), F.col("ref")).alias("rmse")), "frame_idx")


@query(f"SELECT channel, round(avg(value),6) AS mean, round(stddev_pop(value),6) AS std FROM (UNPIVOT (SELECT u, v, w FROM ({GRID}) WHERE w>5) ON u, v, w INTO NAME channel VALUE value) GROUP BY channel")
def norm_stats(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(scores.norm_stats(grid(spark, d), ["u", "v", "w"], F.col("w") > 5), "channel")


@query(f"SELECT m, round(avg(pow(u-w,2)),6) AS mse FROM ({GRID}) WHERE kx>0 GROUP BY m")
def masked_mse(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(scores.masked_mse(grid(spark, d).withColumn("fluid", (F.col("kx") > 0).cast("int")), ["m"], "u", "w"), "m")


@query(f"SELECT round(avg(u) FILTER (kx=0),6) AS solid_mean, round(avg(u) FILTER (kx<>0),6) AS fluid_mean, avg(u) FILTER (kx=0) <= 0.01*avg(u) FILTER (kx<>0) AS valid FROM ({GRID})")
def mask_validation(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(scores.mask_ratio(grid(spark, d).withColumn("fluid", (F.col("kx") != 0).cast("int")), "u"), "valid").select("solid_mean", "fluid_mean", "valid")


@query(f"""
WITH a AS (SELECT kz, ky, kx, u FROM ({GRID}) WHERE m=0), b AS (SELECT kz, ky, kx, u FROM ({GRID}) WHERE m=1)
SELECT count(*) FILTER (a.u IS DISTINCT FROM b.u) AS differing, round(min(abs(a.u-b.u)),6) AS least, round(max(abs(a.u-b.u)),6) AS most, round(avg(abs(a.u-b.u)),6) AS mean, count(*) AS cells
FROM a FULL JOIN b USING (kz, ky, kx)
""")
def compare_states(spark: SparkSession, d: str) -> DataFrame:
    s = grid(spark, d)
    return _rounded(scores.compare(s.where("m = 0"), s.where("m = 1"), ["kz", "ky", "kx"], "u"), "differing", "cells")


def _known(spark: SparkSession, d: str) -> DataFrame:
    # Gaps where the series is at or below its own middle.
    known = truth(spark, d).withColumn("mid", F.median("y").over(Window.partitionBy("param"))).where("y > mid and k > 2 and k < 28")
    return known.select("param", F.col("k").cast("double").alias("time"), "y")


_KNOWN = f"SELECT param, k::DOUBLE AS time, y FROM (SELECT *, median(y) OVER (PARTITION BY param) AS mid FROM ({TRUTH})) WHERE y>mid AND k>2 AND k<28"
_ASKED = f"SELECT DISTINCT param, k, k::DOUBLE AS time FROM ({SERIES})"


def _align_sql(ends: str) -> str:
    low = {"clamp": "s.y0", "extend": "s.y0+(s.y1-s.y0)*(time-s.t0)/(s.t1-s.t0)", "null": "NULL"}[ends]
    high = {"clamp": "s.z1", "extend": "s.z1+(s.z1-s.z0)*(time-s.u1)/(s.u1-s.u0)", "null": "NULL"}[ends]
    return f"""
    WITH kn AS ({_KNOWN}), asked AS ({_ASKED}),
    s AS (SELECT param, list(time ORDER BY time) AS ts, list(y ORDER BY time) AS ys, ts[1] AS t0, ts[2] AS t1, ys[1] AS y0, ys[2] AS y1, ts[-2] AS u0, ts[-1] AS u1, ys[-2] AS z0, ys[-1] AS z1 FROM kn GROUP BY param),
    j AS (SELECT a.param, a.k, a.time, s.*, (SELECT max(time) FROM kn WHERE kn.param=a.param AND kn.time<=a.time) AS lo, (SELECT min(time) FROM kn WHERE kn.param=a.param AND kn.time>=a.time) AS hi FROM asked a JOIN s USING (param))
    SELECT s.param, k, round(CASE WHEN lo IS NULL THEN {low} WHEN hi IS NULL THEN {high} WHEN hi=lo THEN l.y ELSE l.y+(h.y-l.y)*(s.time-lo)/(hi-lo) END,6) AS y
    FROM j s LEFT JOIN kn l ON l.param=s.param AND l.time=lo LEFT JOIN kn h ON h.param=s.param AND h.time=hi
    """.replace("(time-s.", "(s.time-s.")


def _aligned(spark: SparkSession, d: str, ends: str) -> DataFrame:
    asked = series(spark, d).select(*PK, F.col("k").cast("double").alias("time")).distinct()
    return align.lerp_join(asked, _known(spark, d), ["param"], "time", "y", ends=ends).select(*PK, r6("y").alias("y"))


@query(_align_sql("clamp"))
def align_clamp(spark: SparkSession, d: str) -> DataFrame:
    return _aligned(spark, d, "clamp")


@query(_align_sql("extend"))
def align_extrapolate(spark: SparkSession, d: str) -> DataFrame:
    return _aligned(spark, d, "extend")


@query(_align_sql("null"))
def align_inside(spark: SparkSession, d: str) -> DataFrame:
    return _aligned(spark, d, "null")


@query(f"""
WITH p AS (SELECT param, m, k::DOUBLE AS time, x FROM ({SERIES})), q AS (SELECT DISTINCT param, m FROM p), t AS (SELECT unnest(range(62))*0.5::DOUBLE+0.1234567 AS time),
a AS (SELECT param, m, t.time, (SELECT max(time) FROM p WHERE p.param=q.param AND p.m=q.m AND p.time<=t.time) AS lo, (SELECT min(time) FROM p WHERE p.param=q.param AND p.m=q.m AND p.time>=t.time) AS hi FROM q, t)
SELECT a.param, a.m, a.time, round(CASE WHEN lo IS NULL THEN h.x WHEN hi IS NULL OR hi=lo THEN l.x ELSE l.x+(h.x-l.x)*(a.time-lo)/(hi-lo) END,6) AS x
FROM a LEFT JOIN p l ON l.param=a.param AND l.m=a.m AND l.time=lo LEFT JOIN p h ON h.param=a.param AND h.m=a.m AND h.time=hi
""")
def param_to_state_time(spark: SparkSession, d: str) -> DataFrame:
    knots = series(spark, d).select("param", "m", F.col("k").cast("double").alias("time"), "x")
    times = F.explode(F.transform(F.sequence(F.lit(0), F.lit(61)), lambda i: i * 0.5 + 0.1234567)).alias("time")
    asked = knots.select("param", "m").distinct().select("param", "m", times)
    return align.lerp_join(asked, knots, ["param", "m"], "time", "x").select("param", "m", "time", r6("x").alias("x"))


def _reduce(mode: str):
    def run(spark: SparkSession, d: str) -> DataFrame:
        return _rounded(t.reduce_time(timed_grid(spark, d), mode, ["u", "v"], ["kz", "ky", "kx"]), "kz", "ky", "kx")

    run.__name__ = f"temporal_{mode}"
    return run


for _mode, _f in (("mean", "avg"), ("median", "median"), ("max", "max"), ("min", "min")):
    query(f"SELECT kz, ky, kx, round({_f}(u),6) AS u, round({_f}(v),6) AS v FROM ({TIMED}) GROUP BY ALL")(_reduce(_mode))


@query("SELECT event_type, round(sum(value),6) AS total_seconds, round(avg(value),6) AS mean_window_seconds FROM (SELECT event_type, day(ts) AS w, sum(value) AS value FROM events GROUP BY ALL) GROUP BY ALL")
def wall_clock(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").groupBy("event_type", F.day("ts").alias("w")).agg(F.sum("value").alias("value"))
    return _rounded(scores.wall_clock(rows, ["event_type"], "value", "w").drop("window_seconds"), "event_type")
