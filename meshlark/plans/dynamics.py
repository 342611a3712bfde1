"""Queries over time, ensembles, assimilation, priors, sweeps, geometry and logs."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshlark.functions.noise import noise_sql, with_noise
from meshlark.operators import assim, ensemble, geometry, priors, sweep
from meshlark.operators import temporal as t
from meshlark.plans.bindings import (
    DT_LOG, GRID, RUNS, SERIES, SOLIDS, TIMED, VECTORS, big, dt_log, grid, r6, runs, series, solids, table, timed_grid, vectors,
)
from meshlark.plans.registry import query
from meshlark.sources import states as io
from meshlark.streaming.watchdog import tripped

CELL = ["kz", "ky", "kx"]
UVW = "round(u,6) AS u, round(v,6) AS v, round(w,6) AS w"


def _uvw(df: DataFrame, *keys: str) -> DataFrame:
    return df.select(*keys, r6("u").alias("u"), r6("v").alias("v"), r6("w").alias("w"))


# Frames and windows


@query(f"SELECT frame_idx, time-4.0 AS time, kz, ky, kx, {UVW} FROM ({TIMED}) WHERE frame_idx>=2 AND frame_idx<5")
def open_frames(spark: SparkSession, d: str) -> DataFrame:
    return _uvw(t.take_frames(timed_grid(spark, d), 2, 3, t_offset=4.0), "frame_idx", "time", *CELL)


@query(f"SELECT frame_idx, time-3.0 AS time, kz, ky, kx, {UVW} FROM ({TIMED}) WHERE time>=3.0")
def time_trim(spark: SparkSession, d: str) -> DataFrame:
    return _uvw(t.trim_spinup(timed_grid(spark, d), 3.0), "frame_idx", "time", *CELL)


@query(f"SELECT frame_idx, time-2.0 AS time, kz, ky, kx, {UVW} FROM ({TIMED}) WHERE time>=2.0 AND time-2.0<8.0")
def time_horizon(spark: SparkSession, d: str) -> DataFrame:
    return _uvw(t.horizon(timed_grid(spark, d), 2.0, 8.0), "frame_idx", "time", *CELL)


@query(f"SELECT frame_idx, kz, ky, kx, {UVW} FROM ({TIMED}) WHERE frame_idx>=3 AND frame_idx<6")
def window_frames(spark: SparkSession, d: str) -> DataFrame:
    return _uvw(t.window_frames(timed_grid(spark, d), 1, 3), "frame_idx", *CELL)


@query(f"WITH s AS ({TIMED}) SELECT frame_idx, kz, ky, kx, {UVW} FROM s JOIN (SELECT kz, ky, kx, max(time) AS time FROM s GROUP BY ALL) USING (kz, ky, kx, time)")
def last_frames(spark: SparkSession, d: str) -> DataFrame:
    return _uvw(t.last_frames(timed_grid(spark, d), CELL), "frame_idx", *CELL)


@query(f"SELECT frame_idx, kz, ky, kx, round(CAST(CAST(u AS FLOAT) AS DOUBLE),3) AS u FROM ({TIMED})")
def downcast(spark: SparkSession, d: str) -> DataFrame:
    small = io.downcast(timed_grid(spark, d))
    return small.select("frame_idx", *CELL, F.round(F.col("u").cast("double"), 3).alias("u"))


@query(f"SELECT frame_idx, time, kz, ky, kx, {UVW} FROM ({TIMED}) WHERE time BETWEEN 0 AND 8")
def small_state(spark: SparkSession, d: str) -> DataFrame:
    return _uvw(io.small_state(timed_grid(spark, d).withColumn("pres", F.col("u")), 8.0, keys=["frame_idx", "time", *CELL]), "frame_idx", "time", *CELL)


@query(f"SELECT frame_idx-3 AS frame_idx, kz, ky, kx, {UVW} FROM ({TIMED}) JOIN (SELECT kz, ky, kx FROM ({TIMED}) GROUP BY ALL HAVING count(*)=7) USING (kz, ky, kx) WHERE frame_idx>=3")
def exact_frames(spark: SparkSession, d: str) -> DataFrame:
    s = timed_grid(spark, d)
    full = s.groupBy(*CELL).count().where("count = 7").select(*CELL)
    return _uvw(t.exact_frames(s.join(full, CELL), 1, 4, CELL), "frame_idx", *CELL)


_WINDOWS = f"SELECT param, m, (k-1)//10 AS win, (k-1)%10::DOUBLE AS time, x FROM ({SERIES})"


def _windows(spark: SparkSession, d: str) -> DataFrame:
    return series(spark, d).select("param", "m", F.floor((F.col("k") - 1) / 10).alias("win"), ((F.col("k") - 1) % 10).cast("double").alias("time"), "x")


@query(f"SELECT param, m, win, time-min(time) OVER (PARTITION BY param, win)+win*10.0 AS time, round(x,6) AS x FROM ({_WINDOWS})")
def rollout_stitch(spark: SparkSession, d: str) -> DataFrame:
    return t.stitch(_windows(spark, d), 10.0, window="win", keys=["param"]).select("param", "m", "win", "time", r6("x").alias("x"))


@query(f"WITH s AS (SELECT param, m, k::DOUBLE AS time, x FROM ({SERIES})) SELECT param, m, time+5 AS time, round(x,6) AS x FROM s UNION ALL SELECT param, m, 0.0, round(arg_min(x, time),6) FROM s GROUP BY param, m")
def spinup_plateau(spark: SparkSession, d: str) -> DataFrame:
    s = series(spark, d).select("param", "m", F.col("k").cast("double").alias("time"), "x")
    return t.prepend_plateau(s, 5.0, ["param", "m"]).select("param", "m", "time", r6("x").alias("x"))


@query(f"SELECT param, m, k-min(k) OVER (PARTITION BY param, m)+2.5 AS time, round(x,6) AS x FROM ({SERIES})".replace("+2.5", "+2.5::DOUBLE"))
def rebase_clock(spark: SparkSession, d: str) -> DataFrame:
    s = series(spark, d).withColumn("time", F.col("k").cast("double"))
    return t.rebase_clock(s, ["param", "m"], 2.5).select("param", "m", "time", r6("x").alias("x"))


@query(f"""
SELECT kz, ky, kx, frame_idx, round(u,6) AS u, round(target,6) AS target, round(list_sum(p),6) AS param_sum, CAST(len(p) AS BIGINT) AS params FROM (
  SELECT *, lead(u,2) OVER q AS target, lead(true,2) OVER q AS has, list(v) OVER (PARTITION BY kz, ky, kx ORDER BY frame_idx ROWS BETWEEN CURRENT ROW AND 1 FOLLOWING) AS p FROM ({TIMED}) WINDOW q AS (PARTITION BY kz, ky, kx ORDER BY frame_idx)) WHERE has
""")
def kstep_pairs(spark: SparkSession, d: str) -> DataFrame:
    got = t.step_samples(timed_grid(spark, d), 2, CELL, "u", ["v"])
    total = F.aggregate("v_steps", F.lit(0.0), lambda a, x: a + x)
    return got.select(*CELL, "frame_idx", r6("u").alias("u"), r6("target").alias("target"), r6(total).alias("param_sum"), big(F.size("v_steps")).alias("params"))


@query(f"SELECT i, j, min(k) AS ks, max(k) AS ke FROM (SELECT i, j, k, k-row_number() OVER (PARTITION BY i, j ORDER BY k) AS g FROM ({SOLIDS})) GROUP BY i, j, g")
def column_runs(spark: SparkSession, d: str) -> DataFrame:
    return t.column_runs(solids(spark, d))


@query(f"SELECT i, j, ks, 'blocked(' || i || ', ' || j || ', ' || ks || ':' || ke || ') = 1' AS line FROM (SELECT i, j, min(k) AS ks, max(k) AS ke FROM (SELECT i, j, k, k-row_number() OVER (PARTITION BY i, j ORDER BY k) AS g FROM ({SOLIDS})) GROUP BY i, j, g)")
def run_statements(spark: SparkSession, d: str) -> DataFrame:
    return geometry.run_statements(t.column_runs(solids(spark, d)))


@query(f"""
WITH s AS (SELECT run, step, dt<20 AS low FROM ({DT_LOG})), g AS (SELECT *, step-row_number() OVER (PARTITION BY run, low ORDER BY step) AS island FROM s WHERE step>5)
SELECT run, min(hit) AS step FROM (SELECT run, min(step)+1 AS hit FROM g WHERE low GROUP BY run, island HAVING count(*)>=2) GROUP BY run
""")
def dt_watchdog(spark: SparkSession, d: str) -> DataFrame:
    return tripped(dt_log(spark, d), 20.0, patience=2, warmup=5)


# Ensembles


@query(f"SELECT m, sample, split, number FROM (SELECT DISTINCT m, m AS sample, CASE WHEN m<9 THEN 'train' WHEN m<13 THEN 'val' WHEN m<15 THEN 'test' END AS split, CASE WHEN m<9 THEN m WHEN m<13 THEN m-9 WHEN m<15 THEN m-13 END AS number FROM ({SERIES}))")
def splits(spark: SparkSession, d: str) -> DataFrame:
    members = series(spark, d).select("m", F.col("m").alias("sample")).distinct()
    return ensemble.split_samples(members, {"train": 9, "val": 4, "test": 2})


_DRAWS = noise_sql("(SELECT unnest(range(8)) AS member)", "member", "member")
_DONORS = f"""
WITH alive AS (SELECT member AS donor, row_number() OVER (ORDER BY member)-1 AS rank FROM (SELECT unnest(range(8)) AS member) WHERE member NOT IN (3, 7)),
sub AS (SELECT n.member, donor FROM ({_DRAWS}) n JOIN alive ON rank=least(CAST(floor(u*6) AS BIGINT), 5) WHERE n.member IN (3, 7))
"""


def _substitutes(spark: SparkSession, members: int = 8) -> DataFrame:
    members = spark.range(members).withColumnRenamed("id", "member")
    return ensemble.donors(members.withColumn("ok", ~F.col("member").isin(3, 7)), with_noise(members, "member", uniform="u"))


@query(f"{_DONORS} SELECT kz, ky, kx, g.m AS m, {UVW} FROM ({GRID}) g WHERE g.m NOT IN (3, 7) UNION ALL SELECT kz, ky, kx, sub.member, {UVW} FROM ({GRID}) g JOIN sub ON g.m=sub.donor")
def donor_states(spark: SparkSession, d: str) -> DataFrame:
    return _uvw(ensemble.replace_states(grid(spark, d), _substitutes(spark)), *CELL, "m")


_PARAMS = f"SELECT param, k, m AS member, x AS value FROM ({SERIES})"
_JITTER = noise_sql(f"({_PARAMS})", "(k*16+member)", "param, k, member")
_DONORS16 = _DONORS.replace("range(8)", "range(16)").replace("u*6", "u*14").replace(", 5)", ", 13)")


@query(f"""
{_DONORS16}, p AS ({_PARAMS}), s AS (SELECT param, k, stddev_pop(value) AS std FROM p GROUP BY ALL), z AS ({_JITTER})
SELECT p.param, p.k, p.member, round(CASE WHEN sub.donor IS NULL THEN p.value ELSE q.value+0.05*s.std*z.z END,6) AS value
FROM p JOIN s USING (param, k) JOIN z USING (param, k, member) LEFT JOIN sub ON sub.member=p.member LEFT JOIN p q ON q.param=p.param AND q.k=p.k AND q.member=sub.donor
""")
def donor_params(spark: SparkSession, d: str) -> DataFrame:
    p = series(spark, d).select("param", "k", F.col("m").alias("member"), F.col("x").alias("value"))
    noise = with_noise(p.withColumn("id", F.col("k") * 16 + F.col("member")), "id", normal="z")
    got = ensemble.replace_params(p, _substitutes(spark, 16), noise, ["param", "k"])
    return got.select("param", "k", "member", r6("value").alias("value"))


@query(f"SELECT frame_idx, kz, ky, round(avg(u),6) AS u FROM ({TIMED}) WHERE frame_idx<(SELECT min(n) FROM (SELECT max(frame_idx)+1 AS n FROM ({TIMED}) GROUP BY kx)) GROUP BY ALL")
def shortest_mean(spark: SparkSession, d: str) -> DataFrame:
    return ensemble.shortest_mean(timed_grid(spark, d), ["kz", "ky"], ["u"], member="kx").select("frame_idx", "kz", "ky", r6("u").alias("u"))


@query(f"SELECT kz, ky, kx, m, round(0.9*u+0.1*m,6) AS u FROM ({GRID})")
def plugin_model(spark: SparkSession, d: str) -> DataFrame:
    """A linear forward model as a plug-in, members in parallel."""
    state = grid(spark, d).select(*CELL, "m", "u")
    params = spark.range(8).select(F.col("id").alias("m"), (F.col("id") * 0.1).alias("shift"))

    def step(s, p):
        return s.assign(u=0.9 * s["u"] + float(p["shift"].iloc[0]))

    return ensemble.run_members(state, params, step, "kz long, ky long, kx long, m long, u double").select(*CELL, "m", r6("u").alias("u"))


# Assimilation

# Components 9 to 11 of the vectors are observed, all others are the rows to update.
_A, _O = f"SELECT * FROM ({VECTORS(0, 63)}) WHERE row_id NOT BETWEEN 9 AND 11", VECTORS(9, 11)


def _rows(spark: SparkSession, d: str) -> DataFrame:
    return vectors(spark, d, 0, 63).where(~F.col("row_id").between(9, 11))


def _obs(spark: SparkSession, d: str) -> DataFrame:
    return vectors(spark, d, 9, 11).withColumnRenamed("row_id", "obs_id")


@query(f"SELECT a.row_id, o.row_id AS obs_id, round(covar_samp(a.value, o.value),8) AS cov FROM ({_A}) a JOIN ({_O}) o USING (member) GROUP BY ALL")
def covariance(spark: SparkSession, d: str) -> DataFrame:
    return assim.covariance(_rows(spark, d), _obs(spark, d)).select("row_id", "obs_id", F.round("cov", 8).alias("cov"))


def corr_sql(a: str, o: str) -> str:
    both = "covar_samp(a.value, o.value)/nullif(stddev_samp(a.value)*stddev_samp(o.value),0)"
    return f"SELECT a.row_id, o.row_id AS obs_id, CASE WHEN count(*)>1 THEN coalesce(greatest(-1.0, least(1.0, {both})), 0) END AS corr FROM ({a}) a JOIN ({o}) o USING (member) GROUP BY ALL"


CORR = corr_sql(_A, _O)


@query(f"SELECT row_id, obs_id, round(corr,6) AS corr FROM ({CORR})")
def correlation(spark: SparkSession, d: str) -> DataFrame:
    return assim.correlation(_rows(spark, d), _obs(spark, d)).select("row_id", "obs_id", r6("corr").alias("corr"))


def _taper_sql(distance: str, radius: float, beta: float, most: float) -> str:
    flat, width = beta * radius, (1 - beta) * radius / math.sqrt(math.log(most))
    return f"CASE WHEN {distance}<={flat} THEN 1.0 WHEN {distance}<={radius} THEN exp(pow(({distance}-{flat})/{width},2)) END"


def local_sql(corr: str, truncation: float = 0.02) -> str:
    return f"SELECT row_id, obs_id, {_taper_sql('(1-abs(corr))', 1 - truncation, 0.5, 8.0)} AS inflation FROM ({corr})"


LOCAL = local_sql(CORR)


def _local(spark: SparkSession, d: str) -> DataFrame:
    return assim.correlation_inflation(assim.correlation(_rows(spark, d), _obs(spark, d)), 0.02, 0.5, 8.0)


@query(f"SELECT row_id, obs_id, round(inflation,6) AS inflation FROM ({LOCAL})")
def correlation_inflation(spark: SparkSession, d: str) -> DataFrame:
    return _local(spark, d).select("row_id", "obs_id", r6("inflation").alias("inflation"))


@query(f"SELECT row_id, obs_id, row_id//3 AS group_id, round(min(inflation) OVER (PARTITION BY row_id//3, obs_id),6) AS inflation FROM ({LOCAL})")
def block_min(spark: SparkSession, d: str) -> DataFrame:
    grouped = assim.block_least(_local(spark, d).withColumn("group_id", F.floor(F.col("row_id") / 3)))
    return grouped.select("row_id", "obs_id", "group_id", r6("inflation").alias("inflation"))


_SITES = [(0, 0.5, 1.2, 2.5), (1, 3.7, 0.5, 0.2), (2, 2.0, 3.0, 6.0)]


@query(f"""
SELECT row_id, obs_id, round(distance,6) AS distance, round({_taper_sql('distance', 2.5, 0.5, 4.0)},6) AS inflation FROM (
  SELECT c.kz*20+c.ky*5+c.kx AS row_id, obs_id, sqrt(pow(c.kx-s.x,2)+pow(c.ky-s.y,2)+pow(c.kz-s.z,2)) AS distance
  FROM (SELECT DISTINCT kz, ky, kx FROM ({GRID})) c, (VALUES {', '.join(f'({i}::BIGINT,{x}::DOUBLE,{y}::DOUBLE,{z}::DOUBLE)' for i, x, y, z in _SITES)}) s(obs_id,x,y,z)) WHERE distance<=2.5
""")
def distance_inflation(spark: SparkSession, d: str) -> DataFrame:
    cells = grid(spark, d).select(*CELL).distinct()
    rows = cells.select((F.col("kz") * 20 + F.col("ky") * 5 + F.col("kx")).alias("row_id"), *[F.col(f"k{a}").cast("double").alias(a) for a in "xyz"])
    sites = spark.createDataFrame(_SITES, "obs_id long, x double, y double, z double")
    got = assim.distance_inflation(rows, sites, 2.5, 0.5, 4.0)
    return got.select("row_id", "obs_id", r6("distance").alias("distance"), r6("inflation").alias("inflation"))


_OBSERVED = [(9, 0.15, 0.25), (10, -0.1, 0.25), (11, 0.05, 0.25)]
_ALPHA = 3.0
_NOISE = noise_sql(f"({_O})", "(row_id*100003+member)", "row_id, member")


def update_sql(inflation: str | None, a: str = _A, o: str = _O, observed: list = _OBSERVED, noise: str = _NOISE) -> str:
    """The update by elimination, unrolled for three observations; one system for each row."""
    e = inflation or f"SELECT DISTINCT a.row_id, o.row_id AS obs_id, 1.0::DOUBLE AS inflation FROM ({a}) a, (SELECT DISTINCT row_id FROM ({o})) o"
    obs = ", ".join(f"({k}::BIGINT,{v}::DOUBLE,{s}::DOUBLE)" for k, v, s in observed)
    ids = [k for k, _, _ in observed]
    ent = []
    for i, first in enumerate(ids):
        for j, second in enumerate(ids):
            on = f"(e{i} IS NOT NULL AND e{j} IS NOT NULL)"
            diag = f"{_ALPHA}*0.0625*e{i}*e{i}" if first == second else "0"
            ent.append(f"CASE WHEN {on} THEN c{min(i, j)}{max(i, j)}+{diag} ELSE {1.0 if i == j else 0.0} END AS a{i}{j}")
    right = ", ".join(f"CASE WHEN e{i} IS NULL THEN 0 ELSE y{i}+e{i}*sqrt({_ALPHA})*0.25*z{i}-d{i} END AS r{i}" for i in range(3))
    return f"""
    WITH o AS ({o}), a AS ({a}), n AS ({noise}), y AS (SELECT * FROM (VALUES {obs}) AS y(row_id, value, sigma)),
    e AS (SELECT row_id, {', '.join(f'max(inflation) FILTER (obs_id={k}) AS e{i}' for i, k in enumerate(ids))} FROM ({e}) GROUP BY row_id),
    w AS (SELECT member, {', '.join(f'max(value) FILTER (row_id={k}) AS d{i}' for i, k in enumerate(ids))} FROM o GROUP BY member),
    z AS (SELECT member, {', '.join(f'max(z) FILTER (row_id={k}) AS z{i}' for i, k in enumerate(ids))} FROM n GROUP BY member),
    c AS (SELECT {', '.join(f'covar_samp(d{i},d{j}) AS c{i}{j}' for i in range(3) for j in range(i, 3))} FROM w),
    yy AS (SELECT {', '.join(f'max(value) FILTER (row_id={k}) AS y{i}' for i, k in enumerate(ids))} FROM y),
    md AS (SELECT a.row_id, {', '.join(f'coalesce(covar_samp(a.value, w.d{i}), 0) AS m{i}' for i in range(3))} FROM a JOIN w USING (member) GROUP BY a.row_id),
    s AS (SELECT a.row_id, a.member, a.value, {', '.join(f'CASE WHEN e{i} IS NULL THEN 0 ELSE m{i} END AS m{i}' for i in range(3))}, {', '.join(ent)}, {right}
          FROM a JOIN w USING (member) JOIN z USING (member) JOIN md USING (row_id) LEFT JOIN e USING (row_id), c, yy),
    f AS (SELECT *, a11-a10*a01/a00 AS b11, a12-a10*a02/a00 AS b12, r1-a10*r0/a00 AS s1, a21-a20*a01/a00 AS b21, a22-a20*a02/a00 AS b22, r2-a20*r0/a00 AS s2 FROM s),
    g AS (SELECT *, (s2-b21*s1/b11)/(b22-b21*b12/b11) AS x2 FROM f), h AS (SELECT *, (s1-b12*x2)/b11 AS x1 FROM g), k AS (SELECT *, (r0-a01*x1-a02*x2)/a00 AS x0 FROM h)
    SELECT row_id, member, round(value+m0*x0+m1*x1+m2*x2,6) AS value FROM k
    """


def _updated(spark: SparkSession, d: str, inflation: DataFrame | None) -> DataFrame:
    obs = _obs(spark, d)
    noise = with_noise(obs.withColumn("id", F.col("obs_id") * 100003 + F.col("member")), "id", normal="z")
    observed = spark.createDataFrame(_OBSERVED, "obs_id long, value double, sigma double")
    got = assim.esmda_update(_rows(spark, d), obs, observed, noise, _ALPHA, inflation=inflation)
    return got.select("row_id", "member", r6("value").alias("value"))


@query(update_sql(None))
def esmda_global(spark: SparkSession, d: str) -> DataFrame:
    return _updated(spark, d, None)


@query(update_sql(LOCAL))
def esmda_local(spark: SparkSession, d: str) -> DataFrame:
    return _updated(spark, d, _local(spark, d))


_MASKED = f"SELECT row_id, obs_id, CASE WHEN row_id>=6 THEN 1.0 ELSE inflation END AS inflation FROM ({LOCAL})"


@query(update_sql(f"SELECT row_id, obs_id, min(inflation) OVER (PARTITION BY CASE WHEN row_id>=6 THEN row_id ELSE row_id//3 END, obs_id) AS inflation FROM ({_MASKED})"))
def esmda_masked(spark: SparkSession, d: str) -> DataFrame:
    """State rows localised in blocks, parameter rows not: the joint update."""
    masked = assim.unmasked(_local(spark, d).withColumn("localize", F.col("row_id") < 6))
    group = F.when(F.col("row_id") >= 6, F.col("row_id")).otherwise(F.floor(F.col("row_id") / 3))
    return _updated(spark, d, assim.block_least(masked.withColumn("group_id", group)))


@query(f"""
WITH n AS (SELECT param || '_' || k AS name, min(k) AS k, row_number() OVER (ORDER BY param DESC, k) AS pos FROM ({SERIES}) GROUP BY param, k),
f AS (SELECT *, regexp_replace(name, '_[0-9]+$', '') AS base FROM n), g AS (SELECT base, min(pos) AS first FROM f GROUP BY base), h AS (SELECT base, row_number() OVER (ORDER BY first)-1 AS group_id FROM g)
SELECT name, pos, group_id FROM f JOIN h USING (base)
""")
def group_numbers(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    names = series(spark, d).select("param", "k").distinct().withColumn("pos", big(F.row_number().over(Window.orderBy(F.col("param").desc(), "k"))))
    return assim.group_numbers(names.select(F.concat_ws("_", "param", "k").alias("name"), "pos"), "name", "pos")


@query(f"""
WITH c AS (SELECT kz, ky, kx, row_number() OVER (ORDER BY kz, ky, kx)-1 AS cell FROM (SELECT DISTINCT kz, ky, kx FROM ({GRID}))), n AS (SELECT count(*) AS n FROM c)
SELECT cell+CASE name WHEN 'u' THEN 0 WHEN 'v' THEN 1 ELSE 2 END*(SELECT n FROM n) AS row_id, name, m AS member, round(value,6) AS value FROM (UNPIVOT ({GRID}) ON u, v, w INTO NAME name VALUE value) JOIN c USING (kz, ky, kx)
""")
def flatten_state(spark: SparkSession, d: str) -> DataFrame:
    return assim.flatten_state(grid(spark, d), ["w", "u", "v"], CELL).select("row_id", "name", "member", r6("value").alias("value"))


# Priors

_ID = noise_sql("(SELECT unnest(range(4)) AS grp), (SELECT unnest(range(64)) AS member)", "(grp*1000+member)", "grp, member")
_NAMES = {"angle": priors.Normal(25, 6), "speed": priors.Normal(6, 0.5, low=5.5, high=7.0), "height": priors.Uniform(2, 4), "roughness": priors.Constant(0.1)}


@query(f"""
SELECT CASE grp WHEN 0 THEN 'angle' WHEN 1 THEN 'speed' WHEN 2 THEN 'height' ELSE 'roughness' END AS name, member,
  round(CASE grp WHEN 0 THEN 25+6*z WHEN 1 THEN least(greatest(6+0.5*z,5.5),7.0) WHEN 2 THEN 2+2*u ELSE 0.1 END,6) AS value FROM ({_ID})
""")
def static_priors(spark: SparkSession, d: str) -> DataFrame:
    names = F.array(*[F.struct(F.lit(i).cast("long").alias("p"), F.lit(n).alias("name")) for i, n in enumerate(_NAMES)])
    rows = spark.range(64).select(F.col("id").alias("member"), F.explode(names).alias("n")).select("member", "n.*")
    noise = with_noise(rows.withColumn("id", F.col("p") * 1000 + F.col("member")), "id", normal="z", uniform="u")
    return priors.sample_static(noise, _NAMES).select("name", "member", r6("value").alias("value"))


_KNOTS, _MEMBERS, _LENGTH = 10, 16, 100.0
_STEP = "(SELECT unnest(range(1,10)) AS knot), (SELECT unnest(range(16)) AS member)"
_E1, _E2 = (noise_sql(_STEP, f"(member*1000+knot+{off})", "member, knot") for off in (0, 500000))
_N1, _N2 = (noise_sql("(SELECT unnest(range(16)) AS member)", f"(member+{off})", "member") for off in (7000000, 8000000))


def _ar2_noise(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    members = spark.range(_MEMBERS).withColumnRenamed("id", "member")
    steps = members.withColumn("knot", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(_KNOTS - 1).cast("long")))).withColumn("dt", 20.0 + F.col("knot"))
    for name, off in (("e1", 0), ("e2", 500000)):
        steps = with_noise(steps.withColumn("id", F.col("member") * 1000 + F.col("knot") + off), "id", normal=name)
    for name, off in (("n1", 7000000), ("n2", 8000000)):
        members = with_noise(members.withColumn("id", F.col("member") + off), "id", normal=name)
    return members.drop("id"), steps.drop("id")


def ar2_sql(start: str, length: float = _LENGTH) -> str:
    """The recursion step by step; ``start`` gives (member, z, w)."""
    lam = math.sqrt(3.0) / length
    return f"""
    s AS (SELECT a.member, a.knot, ({lam}*(20.0+a.knot))::DOUBLE AS h, a.z AS e1, b.z AS e2 FROM ({_E1}) a JOIN ({_E2}) b USING (member, knot)),
    f AS (SELECT *, exp(-h) AS g, 1-exp(-2*h)*(1+2*h+2*h*h) AS p, 1-exp(-2*h)*(1-2*h+2*h*h) AS q, 2*h*h*exp(-2*h) AS c FROM s),
    k AS (SELECT *, sqrt(p) AS a, c/sqrt(p) AS b, sqrt(greatest(q-c*c/p,0)) AS d FROM f),
    r AS ({start} UNION ALL SELECT r.member, k.knot, g*(r.z+h*(r.z+r.w/{lam}))+a*e1, {lam}*(g*(r.w/{lam}-h*(r.z+r.w/{lam}))+b*e1+d*e2) FROM r JOIN k ON k.member=r.member AND k.knot=r.knot+1)
    """


@query(f"""
WITH RECURSIVE {ar2_sql(f"SELECT a.member, 0::BIGINT AS knot, a.z AS z, b.z*{math.sqrt(3.0) / _LENGTH} AS w FROM ({_N1}) a JOIN ({_N2}) b USING (member)")}
SELECT member, knot, round(z,6) AS z, round(greatest(6+0.5*z,0.1),6) AS value FROM r
""")
def ar2_prior(spark: SparkSession, d: str) -> DataFrame:
    start, steps = _ar2_noise(spark)
    got = priors.ar2_prior(start, steps, ["member"], _LENGTH, F.lit(6.0), F.lit(0.5), low=0.1)
    return got.select("member", "knot", r6("z").alias("z"), r6("value").alias("value"))


_POST = f"SELECT param AS name, m AS member, k::DOUBLE*10 AS time, x AS value FROM ({SERIES})"


@query(f"""
WITH RECURSIVE p AS (SELECT *, (value-avg(value) OVER (PARTITION BY name, time))/0.5 AS z, avg(value) OVER (PARTITION BY name, time) AS mean, row_number() OVER (PARTITION BY name, member ORDER BY time DESC) AS n FROM ({_POST})),
e AS (SELECT a.name, a.member, a.mean AS mu, a.z AS z0, coalesce((a.z-b.z)/(a.time-b.time),0) AS w0 FROM (FROM p WHERE n=1) a LEFT JOIN (FROM p WHERE n=2) b USING (name, member)),
{ar2_sql("SELECT name, member, 0::BIGINT AS knot, z0 AS z, w0 AS w FROM e").replace("SELECT r.member, k.knot", "SELECT r.name, r.member, k.knot")}
SELECT name, member, knot, round(exp(-knot*25.0/{_LENGTH})*mu+(1-exp(-knot*25.0/{_LENGTH}))*6+0.5*z,6) AS value FROM r JOIN e USING (name, member)
""")
def ar2_extrapolate(spark: SparkSession, d: str) -> DataFrame:
    """The next window of every parameter, from where each member's series ends."""
    post = series(spark, d).select(F.col("param").alias("name"), F.col("m").alias("member"), (F.col("k") * 10.0).alias("time"), F.col("x").alias("value"))
    ends = priors.window_ends(post, std=F.lit(0.5))
    steps = ends.select("name", "member").join(_ar2_noise(spark)[1], "member")
    times = spark.range(_KNOTS).select(F.col("id").alias("knot"), (F.col("id") * 25.0).alias("time"))
    got = priors.ar2_extrapolate(ends, steps, ["name", "member"], _LENGTH, times, F.lit(6.0), F.lit(0.5))
    return got.select("name", "member", "knot", r6("value").alias("value"))


@query(f"SELECT member, knot, round(0.1+(3.0-0.1)*u,6) AS value FROM ({_E1})")
def uniform_series(spark: SparkSession, d: str) -> DataFrame:
    rows = spark.range(_MEMBERS).select(F.col("id").alias("member"), F.explode(F.sequence(F.lit(1).cast("long"), F.lit(9).cast("long"))).alias("knot"), F.lit("speed").alias("name"))
    noise = with_noise(rows.withColumn("id", F.col("member") * 1000 + F.col("knot")), "id", uniform="u")
    return priors.sample_uniform_series(noise, {"speed": (0.1, 3.0)}).select("member", "knot", r6("value").alias("value"))


@query(f"SELECT kz, ky, kx, m, round(u,6) AS u FROM (SELECT kz, ky, kx, u FROM ({TIMED}) WHERE frame_idx=0), (SELECT unnest(range(5)) AS m)")
def replicate_state(spark: SparkSession, d: str) -> DataFrame:
    return priors.replicate(t.first_frames(timed_grid(spark, d)), 5).select(*CELL, "m", r6("u").alias("u"))


# Sweeps

_TAGGED = f"""
SELECT run_id, tag, metric, regexp_extract(tag, '^(m\\d)_', 1) AS model, CAST(regexp_extract(tag, '_nx(\\d+)', 1) AS BIGINT) AS nx, CAST(regexp_extract(tag, '_ny(\\d+)', 1) AS BIGINT) AS ny,
  CAST(regexp_extract(tag, '_nz(\\d+)', 1) AS BIGINT) AS nz, CAST(regexp_extract(tag, '_ens(\\d+)', 1) AS BIGINT) AS ensemble_size, CAST(regexp_extract(tag, '_steps(\\d+)', 1) AS BIGINT) AS esmda_steps,
  CAST(nullif(regexp_extract(tag, '_int(\\d+)', 1), '') AS DOUBLE) AS interval_seconds, tag LIKE '%_loc' AS localization FROM ({RUNS})
"""


def _tagged(spark: SparkSession, d: str) -> DataFrame:
    return sweep.parse_tags(runs(spark, d))


@query(f"SELECT *, nx*ny*nz AS grid_cells, nx || 'x' || ny || 'x' || nz AS grid FROM ({_TAGGED})")
def run_tags(spark: SparkSession, d: str) -> DataFrame:
    return _tagged(spark, d)


@query(f"""
WITH t AS (SELECT *, nx*ny*nz AS cells FROM ({_TAGGED})),
a AS (SELECT cells FROM t GROUP BY cells ORDER BY count(*) DESC, min(run_id) LIMIT 1), t1 AS (SELECT * FROM t WHERE cells=(SELECT cells FROM a)),
b AS (SELECT esmda_steps FROM t1 GROUP BY esmda_steps ORDER BY count(*) DESC, min(run_id) LIMIT 1), n1 AS (SELECT count(DISTINCT esmda_steps) AS n FROM t1)
SELECT run_id, ensemble_size, metric FROM t1 WHERE (SELECT n FROM n1)<=1 OR esmda_steps=(SELECT esmda_steps FROM b)
""")
def held_axes(spark: SparkSession, d: str) -> DataFrame:
    rows, _ = sweep.hold_axes(_tagged(spark, d), "ensemble_size", ["grid_cells", "ensemble_size", "esmda_steps"], "run_id")
    return rows.select("run_id", "ensemble_size", "metric")


@query(f"SELECT nx || 'x' || ny || 'x' || nz AS grid, count(DISTINCT ensemble_size) AS sizes, count(*) AS runs FROM ({_TAGGED}) GROUP BY 1 ORDER BY sizes DESC, runs DESC, grid LIMIT 1")
def pick_domain(spark: SparkSession, d: str) -> DataFrame:
    return sweep.pick_domain(_tagged(spark, d))


@query(f"""
WITH t AS (SELECT *, nx*ny*nz AS grid_cells FROM ({_TAGGED})), b AS (SELECT grid_cells, ensemble_size, esmda_steps FROM t GROUP BY ALL ORDER BY count(DISTINCT model) DESC, count(*) DESC, grid_cells, ensemble_size, esmda_steps LIMIT 1)
SELECT run_id, model, metric FROM t SEMI JOIN b USING (grid_cells, ensemble_size, esmda_steps)
""")
def best_combo(spark: SparkSession, d: str) -> DataFrame:
    return sweep.best_combo(_tagged(spark, d), ["grid_cells", "ensemble_size", "esmda_steps"]).select("run_id", "model", "metric")


@query(f"SELECT model, run_id, metric FROM ({_TAGGED}) QUALIFY row_number() OVER (PARTITION BY model ORDER BY metric DESC, run_id)<=3")
def top_runs(spark: SparkSession, d: str) -> DataFrame:
    return sweep.top_rows(_tagged(spark, d), ["model"], [F.col("metric").desc(), "run_id"], 3).select("model", "run_id", "metric")


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k, CAST(NULL AS DOUBLE) AS gap FROM events")
def nested_fields(spark: SparkSession, d: str) -> DataFrame:
    got = sweep.flatten_summary(table(spark, d, "events"), "props", {"k": ("k",), "gap": ("a", "b")})
    return got.select("event_id", "k", "gap")


@query(f"SELECT param, k, round(avg(x),9) AS mean, round(stddev_pop(x),9) AS std FROM ({SERIES}) GROUP BY ALL")
def trajectories(spark: SparkSession, d: str) -> DataFrame:
    got = sweep.trajectories(series(spark, d), ["param", "k"], "x")
    return got.select("param", "k", F.round("mean", 9).alias("mean"), F.round("std", 9).alias("std"))


# Geometry

_BOXES = [(0, 0.0, 2.0, 1.0, 3.0, 0.0, 4.0), (1, 2.5, 5.0, 0.0, 2.0, 0.0, 2.0)]
BOX_SQL = "SELECT * FROM (VALUES " + ", ".join("(" + ",".join([f"{b[0]}::BIGINT", *[f"{x}::DOUBLE" for x in b[1:]]]) + ")" for b in _BOXES) + ") AS b(box,x0,x1,y0,y1,z0,z1)"


def _boxes(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(_BOXES, "box long, x0 double, x1 double, y0 double, y1 double, z0 double, z1 double")


@query(f"SELECT kz, ky, kx FROM (SELECT DISTINCT kz, ky, kx FROM ({GRID})) c WHERE EXISTS (FROM ({BOX_SQL}) b WHERE kx>=x0-1e-9 AND kx+1<=x1+1e-9 AND ky>=y0-1e-9 AND ky+1<=y1+1e-9 AND kz>=z0-1e-9 AND kz+1<=z1+1e-9)")
def cells_in_boxes(spark: SparkSession, d: str) -> DataFrame:
    cells = grid(spark, d).select(*CELL).distinct()
    for a in "xyz":
        cells = cells.withColumn(f"{a}_lo", F.col(f"k{a}").cast("double")).withColumn(f"{a}_hi", F.col(f"k{a}") + 1.0)
    return geometry.cells_in_boxes(cells, _boxes(spark)).select(*CELL)


@query(f"""
WITH c AS (SELECT i, j, i+0.5 AS x, j+0.5 AS y FROM (SELECT unnest(range(5)) AS i), (SELECT unnest(range(4)) AS j))
SELECT i, j, CAST(coalesce(max(z1),0) AS DOUBLE) AS height FROM c LEFT JOIN ({BOX_SQL}) b ON x BETWEEN x0 AND x1 AND y BETWEEN y0 AND y1 GROUP BY ALL
""")
def height_raster(spark: SparkSession, d: str) -> DataFrame:
    mesh = geometry.box_triangles(_boxes(spark)).drop("box", "face").withColumn("id", F.monotonically_increasing_id())
    xs = spark.range(5).select(F.col("id").alias("i"), (F.col("id") + 0.5).alias("x"))
    ys = spark.range(4).select(F.col("id").alias("j"), (F.col("id") + 0.5).alias("y"))
    return geometry.height_raster(mesh, xs, ys).select("i", "j", r6("height").alias("height"))


@query(f"""
WITH n AS (SELECT kz, ky, kx, m, u FROM ({GRID})), x AS (SELECT kz, ky, kx+s AS kx, m, u FROM n, (VALUES (-5),(0),(5)) p(s) WHERE kx+s BETWEEN -1 AND 5),
y AS (SELECT kz, ky AS ky, kx, m, u FROM x UNION ALL SELECT kz, -1, kx, m, u FROM x WHERE ky=0 UNION ALL SELECT kz, 4, kx, m, u FROM x WHERE ky=3) SELECT kz, CAST(ky AS BIGINT) AS ky, kx, m, round(u,6) AS u FROM y
""")
def halo_cells(spark: SparkSession, d: str) -> DataFrame:
    state = grid(spark, d).select(*CELL, "m", "u")
    return geometry.halo(state, {"x": 5, "y": 4}, 1, periodic=("x",)).select(*CELL, "m", r6("u").alias("u"))


# Velocities over a prime number, so that no rounded value is near a half.
_FLOW = f"SELECT kz, ky, kx, m, 1+w/1021 AS rho, u/1021 AS u, v/1021 AS v, w/1021 AS w FROM ({GRID})"
_POPULATIONS = """
SELECT *, CASE abs(cx)+abs(cy)+abs(cz) WHEN 0 THEN 8.0/27 WHEN 1 THEN 2.0/27 WHEN 2 THEN 1.0/54 ELSE 1.0/216 END*rho*(1+3*cu+4.5*cu*cu-1.5*uu{more}) AS f
FROM (SELECT *, cx*u+cy*v+cz*w AS cu, u*u+v*v+w*w AS uu FROM ({flow}), (VALUES (0),(1),(-1)) a(cx), (VALUES (0),(1),(-1)) b(cy), (VALUES (0),(1),(-1)) c(cz))
"""


def _flow(spark: SparkSession, d: str) -> DataFrame:
    return grid(spark, d).select(*CELL, "m", (1 + F.col("w") / 1021).alias("rho"), *[(F.col(c) / 1021).alias(c) for c in "uvw"])


def _populations(spark: SparkSession, d: str, third: bool) -> DataFrame:
    got = geometry.equilibrium(_flow(spark, d), third_order=third)
    return got.select(*CELL, "m", *[F.col(c).cast("int").alias(c) for c in ("cx", "cy", "cz")], F.round("f", 9).alias("f"))


@query(f"SELECT kz, ky, kx, m, cx, cy, cz, round(f,9) AS f FROM ({_POPULATIONS.format(more='', flow=_FLOW)})")
def lattice_populations(spark: SparkSession, d: str) -> DataFrame:
    return _populations(spark, d, False)


@query(f"SELECT kz, ky, kx, m, cx, cy, cz, round(f,9) AS f FROM ({_POPULATIONS.format(more='+4.5*cu*cu*cu-4.5*cu*uu', flow=_FLOW)})")
def lattice_third_order(spark: SparkSession, d: str) -> DataFrame:
    return _populations(spark, d, True)


@query(f"SELECT kz, ky, kx, m, round(rho,8) AS rho, round(a/rho,8) AS u, round(b/rho,8) AS v, round(c/rho,8) AS w FROM (SELECT kz, ky, kx, m, sum(f) AS rho, sum(f*cx) AS a, sum(f*cy) AS b, sum(f*cz) AS c FROM ({_POPULATIONS.format(more='+4.5*cu*cu*cu-4.5*cu*uu', flow=_FLOW)}) GROUP BY ALL)")
def lattice_moments(spark: SparkSession, d: str) -> DataFrame:
    """Density and velocity of populations, which are those of the third order."""
    got = geometry.moments(geometry.equilibrium(_flow(spark, d), third_order=True), [*CELL, "m"])
    return got.select(*CELL, "m", *[F.round(c, 8).alias(c) for c in ("rho", "u", "v", "w")])


@query(f"""
WITH c AS (SELECT DISTINCT kz*20+ky*5+kx AS point, kx::DOUBLE AS x, ky::DOUBLE AS y, kz::DOUBLE AS z FROM ({GRID})), p AS (
  SELECT a.point AS node, b.point, sqrt(pow(a.x-b.x,2)+pow(a.y-b.y,2)+pow(a.z-b.z,2)) AS distance FROM c a, c b WHERE a.point%35=0)
SELECT node, point, round(distance,6) AS distance FROM p WHERE distance<=1.5 QUALIFY row_number() OVER (PARTITION BY node ORDER BY distance, point)<=6
""")
def radius_neighbours(spark: SparkSession, d: str) -> DataFrame:
    points = grid(spark, d).select((F.col("kz") * 20 + F.col("ky") * 5 + F.col("kx")).alias("point"), *[F.col(f"k{a}").cast("double").alias(a) for a in "xyz"]).distinct()
    nodes = geometry.strided_nodes(points, 4, 140).withColumnRenamed("point", "node")
    return geometry.radius_neighbours(points, nodes, 1.5, 6).select("node", "point", r6("distance").alias("distance"))


@query("SELECT event_type, format('{:.6f}  {:.6f}  {:.6f}', t::DOUBLE, round(v,3), round(a,3)) AS line FROM (SELECT event_type, CAST(day(ts) AS BIGINT) AS t, avg(value)/10 AS v, avg(user_id) AS a FROM events GROUP BY ALL)")
def schedule_lines(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").groupBy("event_type", big(F.day("ts")).alias("t")).agg((F.avg("value") / 10).alias("v"), F.avg("user_id").alias("a"))
    rows = rows.select("event_type", F.col("t").cast("double").alias("time"), F.round("v", 3).alias("speed"), F.round("a", 3).alias("angle"))
    return io.schedule_lines(rows).select("event_type", "line")


@query(f"SELECT param || '_' || k AS row_id, m AS member, round(2*x,6) AS value FROM ({SERIES}) WHERE k>1 UNION ALL SELECT param || '_' || 1, m, round(x,6) FROM ({SERIES}) WHERE k=1")
def pinned_knots(spark: SparkSession, d: str) -> DataFrame:
    """Knots as augmented rows, changed, and put back together with those that were pinned."""
    p = series(spark, d).select(F.col("param").alias("name"), (F.col("k") - 1).alias("knot"), F.col("m").alias("member"), F.col("x").alias("value"))
    rows, kept = assim.pin_knots(p, True)
    back = assim.unpin_knots(rows.select("row_id", "member", (2 * F.col("value")).alias("value")), kept)
    return back.select(F.concat_ws("_", "name", F.col("knot") + 1).alias("row_id"), "member", r6("value").alias("value"))


_HALVES = f"SELECT param, m, k>15 AS late, avg(x) AS x FROM ({SERIES}) GROUP BY ALL"


@query(f"SELECT coalesce(a.m, b.m) AS member, coalesce(a.param, b.param) AS name, round(coalesce(b.x, a.x),6) AS value FROM (FROM ({_HALVES}) WHERE NOT late) a FULL JOIN (FROM ({_HALVES}) WHERE late AND param IN ('click','view')) b USING (param, m)")
def merge_params(spark: SparkSession, d: str) -> DataFrame:
    """Means of the first half of the days, two parameters replaced by those of the second."""
    p = series(spark, d).groupBy(F.col("m").alias("member"), F.col("param").alias("name"), (F.col("k") > 15).alias("late")).agg(F.avg("x").alias("value"))
    got = ensemble.merge_params(p.where("not late").drop("late"), p.where("late").drop("late"), ["click", "view"], ["member"])
    return got.select("member", "name", r6("value").alias("value"))


@query(f"SELECT 'speed' AS name, e.member, e.knot, round(least(greatest((4+(8-4)*m.u)+(0.2+(0.6-0.2)*s.u)*e.z,4),8),6) AS value FROM ({_E1}) e JOIN ({_N1}) m USING (member) JOIN ({_N2}) s USING (member)")
def external_series(spark: SparkSession, d: str) -> DataFrame:
    members = spark.range(_MEMBERS).withColumnRenamed("id", "member").withColumn("name", F.lit("speed"))
    paths = members.withColumn("knot", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(9).cast("long"))))
    paths = with_noise(paths.withColumn("id", F.col("member") * 1000 + F.col("knot")), "id", normal="z")
    for name, off in (("u_mean", 7000000), ("u_std", 8000000)):
        members = with_noise(members.withColumn("id", F.col("member") + off), "id", uniform=name)
    got = priors.external_series(paths.drop("id"), members.drop("id"), {"speed": {"mean": {"min": 4, "max": 8}, "std": {"min": 0.2, "max": 0.6}}})
    return got.select("name", "member", "knot", r6("value").alias("value"))


@query(f"SELECT m AS member, param AS name, round(avg(x),6) AS value FROM ({SERIES}) GROUP BY ALL UNION ALL SELECT DISTINCT m, 'roughness', 0.1::DOUBLE FROM ({SERIES})")
def constant_params(spark: SparkSession, d: str) -> DataFrame:
    p = series(spark, d).groupBy(F.col("m").alias("member"), F.col("param").alias("name")).agg(F.avg("x").alias("value"))
    got = ensemble.constant_params(p, {"roughness": 0.1})
    return got.select("member", "name", r6("value").alias("value"))


@query("SELECT l_orderkey, l_linenumber, round(CASE l_returnflag WHEN 'A' THEN 0.2 WHEN 'N' THEN 0.35 ELSE 0.0 END,6) AS albedo FROM lineitem".replace("round(CASE", "round(1.0::DOUBLE*CASE"))
def facet_lookup(spark: SparkSession, d: str) -> DataFrame:
    types = spark.createDataFrame([("A", 0, 0.2), ("N", 1, 0.35), ("A", 2, 0.9)], "l_returnflag string, position long, albedo double")
    got = ensemble.lookup(table(spark, d, "lineitem"), types, "l_returnflag", "albedo")
    return got.select("l_orderkey", "l_linenumber", r6("albedo").alias("albedo"))


@query(f"SELECT m, step, kz, ky, kx, round(u*pow(0.5, step),6) AS u FROM ({GRID}), (SELECT unnest(range(1,4)) AS step)")
def batched_rollout(spark: SparkSession, d: str) -> DataFrame:
    state = grid(spark, d).select(*CELL, "m", "u")
    params = spark.range(8).select(F.col("id").alias("m"), F.lit(0.5).alias("decay"))

    def step(s, p):
        return s.assign(u=s["u"] * float(p["decay"].iloc[0]))

    got = ensemble.rollout(state, params, step, "kz long, ky long, kx long, m long, u double", 3)
    return got.select("m", "step", *CELL, r6("u").alias("u"))


@query(f"""
WITH c AS (SELECT i, j, k, i+0.5 AS x, j+0.5 AS y, k+0.5 AS z FROM (SELECT unnest(range(5)) AS i), (SELECT unnest(range(4)) AS j), (SELECT unnest(range(5)) AS k))
SELECT i, j, k, CAST(NOT EXISTS (FROM ({BOX_SQL}) b WHERE x BETWEEN x0 AND x1 AND y BETWEEN y0 AND y1 AND z BETWEEN z0 AND z1) AS BIGINT) AS fluid FROM c
""")
def mesh_fluid_cells(spark: SparkSession, d: str) -> DataFrame:
    mesh = geometry.box_triangles(_boxes(spark)).drop("box", "face").withColumn("id", F.monotonically_increasing_id())
    xs = spark.range(5).select(F.col("id").alias("i"), (F.col("id") + 0.5).alias("x"))
    ys = spark.range(4).select(F.col("id").alias("j"), (F.col("id") + 0.5).alias("y"))
    zs = spark.range(5).select(F.col("id").alias("k"), (F.col("id") + 0.5).alias("z"))
    return geometry.fluid_cells(mesh, xs, ys, zs)
