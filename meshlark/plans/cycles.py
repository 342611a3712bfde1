"""Queries over assimilation cycles, models of parameters in time, schedules and the small tables around them."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshlark.functions import scalar
from meshlark.functions.noise import noise_sql, with_noise
from meshlark.operators import align, assim, ensemble, priors, scores
from meshlark.operators import grid as g
from meshlark.operators import temporal as t
from meshlark.plans.bindings import GRID, RUNS, SERIES, TIMED, axes, big, grid, r6, runs, series, timed_grid
from meshlark.plans.dynamics import corr_sql, local_sql, update_sql
from meshlark.plans.registry import query

CELL = ["kz", "ky", "kx"]

# Observations of an ensemble of 16: mean, greatest and least value of each member.

_OBS = " UNION ALL ".join(f"SELECT {n}::BIGINT AS row_id, m AS member, {f}(x) AS value FROM ({SERIES}) GROUP BY m" for n, f in enumerate(("avg", "max", "min")))
_SEEN = [(0, 20.0, 0.25), (1, 90.0, 0.25), (2, 1.5, 0.25)]
_NOISE = noise_sql(f"({_OBS})", "(row_id*100003+member)", "row_id, member")
_ALPHA = 3.0


def _predicted(spark: SparkSession, d: str) -> DataFrame:
    stats = F.explode(F.array(*[F.struct(F.lit(n).cast("long").alias("obs_id"), F.col(f).alias("value")) for n, f in enumerate(("avg", "max", "min"))]))
    wide = series(spark, d).groupBy(F.col("m").alias("member")).agg(*[f("x").alias(n) for f, n in ((F.avg, "avg"), (F.max, "max"), (F.min, "min"))])
    return wide.select("member", stats.alias("s")).select("s.obs_id", "member", "s.value")


def _updated(spark: SparkSession, d: str, rows: DataFrame, localisation: assim.Localisation | None = None, localised=None) -> DataFrame:
    obs = _predicted(spark, d)
    noise = with_noise(obs.withColumn("id", F.col("obs_id") * 100003 + F.col("member")), "id", normal="z")
    observed = spark.createDataFrame(_SEEN, "obs_id long, value double, sigma double")
    inflation = None
    if localisation is not None:
        inflation = localisation.inflation(rows, obs)
        if localised is not None:
            inflation = assim.unmasked(inflation.withColumn("localize", localised))
    return assim.esmda_update(rows, obs, observed, noise, _ALPHA, inflation=inflation)


_ROWS = f"SELECT param || '_' || (k-1) AS row_id, m AS member, x AS value FROM ({SERIES}) WHERE k>1"


def _knots(spark: SparkSession, d: str) -> DataFrame:
    return series(spark, d).select(F.col("param").alias("name"), (F.col("k") - 1).alias("knot"), F.col("m").alias("member"), F.col("x").alias("value"))


def _r5(c: str):
    return F.round(c, 5)


@query(f"SELECT row_id, member, round(value,5) AS value FROM ({update_sql(None, _ROWS, _OBS, _SEEN, _NOISE).replace('round(value+m0*x0+m1*x1+m2*x2,6)', 'value+m0*x0+m1*x1+m2*x2')}) UNION ALL SELECT param || '_0', m, round(x,5) FROM ({SERIES}) WHERE k=1")
def time_varying_update(spark: SparkSession, d: str) -> DataFrame:
    """Parameters in time as rows, some of which lack members; the first knots are pinned."""
    rows, kept = assim.pin_knots(_knots(spark, d), True)
    back = assim.unpin_knots(_updated(spark, d, rows.select("row_id", "member", "value")), kept)
    return back.select(F.concat_ws("_", "name", "knot").alias("row_id"), "member", _r5("value").alias("value"))


_STATE = f"SELECT 's' || (kz*20+ky*5+kx) AS row_id, m AS member, u+(kx-2)*x AS value FROM (SELECT kz, ky, kx, u FROM ({TIMED}) WHERE frame_idx=0) s, (SELECT m, avg(x) AS x FROM ({SERIES}) GROUP BY m) p"
_JOINT = f"{_ROWS} UNION ALL {_STATE}"
_JOINT_LOCAL = f"SELECT row_id, obs_id, CASE WHEN row_id LIKE 's%' AND row_id NOT LIKE '%\\_%' ESCAPE '\\' THEN inflation ELSE 1.0 END AS inflation FROM ({local_sql(corr_sql(_JOINT, _OBS), 0.2)})"


def _joint(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    rows, kept = assim.pin_knots(_knots(spark, d), True)
    shift = series(spark, d).groupBy(F.col("m").alias("member")).agg(F.avg("x").alias("x"))
    cell = F.concat(F.lit("s"), F.col("kz") * 20 + F.col("ky") * 5 + F.col("kx"))
    state = t.first_frames(timed_grid(spark, d)).crossJoin(F.broadcast(shift)).select(cell.alias("row_id"), "member", (F.col("u") + (F.col("kx") - 2) * F.col("x")).alias("value"))
    return rows.select("row_id", "member", "value").unionByName(state), kept


@query(f"SELECT row_id, member, round(value,5) AS value FROM ({update_sql(_JOINT_LOCAL, _JOINT, _OBS, _SEEN, _NOISE).replace('round(value+m0*x0+m1*x1+m2*x2,6)', 'value+m0*x0+m1*x1+m2*x2')})")
def joint_update(spark: SparkSession, d: str) -> DataFrame:
    """State rows, localised by correlation, and parameters in time, which see every observation."""
    rows, _ = _joint(spark, d)
    state = F.col("row_id").startswith("s") & ~F.col("row_id").contains("_")
    return _updated(spark, d, rows, assim.ByCorrelation(0.2, 0.5, 8.0), state).select("row_id", "member", _r5("value").alias("value"))


@query(f"SELECT row_id, obs_id, round(inflation,6) AS inflation FROM ({local_sql(corr_sql(_ROWS, _OBS), 0.2)}) WHERE inflation IS NOT NULL")
def plugin_localisation(spark: SparkSession, d: str) -> DataFrame:
    """Localisation as a plug-in, on rows of which some lack members."""
    rows, _ = assim.pin_knots(_knots(spark, d), True)
    got = assim.ByCorrelation(0.2, 0.5, 8.0).inflation(rows.select("row_id", "member", "value"), _predicted(spark, d))
    return got.where("inflation is not null").select("row_id", "obs_id", r6("inflation").alias("inflation"))


# A cycle of two windows with two steps each: one parameter, one state, one observation, all linear.

_TRUTHS, _SIGMA, _STEPS = (30.0, 36.0), 0.5, 2


def _step_sql(name: str, before: str, state: str, window: int, step: int) -> str:
    """One step of the smoother for a scalar, after the table ``before(member, a)``, the state being ``state(member, s)``."""
    y = f"({_TRUTHS[window]}+{_SIGMA}*(SELECT z FROM e WHERE id={window}))"
    return f"""
    {name}f AS (SELECT member, a, 1.5*a+s AS d FROM {before} JOIN {state} USING (member)), {name}c AS (SELECT covar_samp(a, d) AS c, var_samp(d) AS v FROM {name}f),
    {name} AS (SELECT member, a+c/(v+{_STEPS}*{_SIGMA * _SIGMA})*({y}+sqrt({_STEPS})*{_SIGMA}*z-d) AS a FROM {name}f JOIN (SELECT id%100 AS member, z FROM n WHERE id//100={10 * window + step}) USING (member), {name}c)"""


_CYCLE = f"""
WITH p0 AS (SELECT m AS member, avg(x)/10 AS a FROM ({SERIES}) GROUP BY m), s0 AS (SELECT m AS member, avg(x)/7 AS s FROM ({SERIES}) WHERE param='click' GROUP BY m),
e AS (SELECT id, z FROM ({noise_sql('(SELECT unnest(range(2)) AS id)', '(id+5000)', 'id')})), n AS (SELECT id, z FROM ({noise_sql('(SELECT unnest(range(2000)) AS id)', 'id', 'id')})),
{_step_sql('a0', 'p0', 's0', 0, 0)}, {_step_sql('a1', 'a0', 's0', 0, 1)}, s1 AS (SELECT member, 0.5*(1.5*a+s) AS s FROM a1 JOIN s0 USING (member)), p1 AS (SELECT member, a+1 AS a FROM a1),
{_step_sql('b0', 'p1', 's1', 1, 0)}, {_step_sql('b1', 'b0', 's1', 1, 1)}
"""


def _cycle(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    s = series(spark, d)
    prior = s.groupBy(F.col("m").alias("member")).agg((F.avg("x") / 10).alias("value")).select(F.lit(0).cast("long").alias("row_id"), "member", "value")
    state = s.where("param = 'click'").groupBy(F.col("m").alias("member")).agg((F.avg("x") / 7).alias("s"))
    observations = spark.createDataFrame([(w, 0, y) for w, y in enumerate(_TRUTHS)], "window long, obs_id long, value double")

    def forecast(rows: DataFrame, now: DataFrame) -> DataFrame:
        return rows.join(now, "member").select(F.lit(0).cast("long").alias("obs_id"), "member", (1.5 * F.col("value") + F.col("s")).alias("value"))

    def errors(window: int) -> DataFrame:
        return with_noise(spark.range(1).select(F.lit(0).cast("long").alias("obs_id"), F.lit(window + 5000).cast("long").alias("id")), "id", normal="z")

    def noise(window: int, step: int, predicted: DataFrame) -> DataFrame:
        return with_noise(predicted.withColumn("id", F.col("member") + 100 * (10 * window + step)), "id", normal="z").select("obs_id", "member", "z")

    def warm_start(posterior: DataFrame, now: DataFrame) -> DataFrame:
        return forecast(posterior, now).select("member", (0.5 * F.col("value")).alias("s"))

    return assim.run_windows(
        prior, state, observations, 2, forecast, errors, noise, _SIGMA, _STEPS,
        warm_start=warm_start, next_prior=lambda posterior, w: posterior.withColumn("value", F.col("value") + 1),
    )


@query(f"{_CYCLE} SELECT 0::BIGINT AS \"window\", member, round(a,5) AS value FROM a1 UNION ALL SELECT 1, member, round(a,5) FROM b1")
def assimilation_windows(spark: SparkSession, d: str) -> DataFrame:
    """Posteriors of windows with noisy observations, a warm start from the last forecast and a prior made from the last posterior."""
    return _cycle(spark, d)[0].select("window", "member", _r5("value").alias("value"))


@query(f"{_CYCLE} SELECT member, round(0.5*(1.5*a+s),5) AS s FROM b1 JOIN s1 USING (member)")
def warm_started_state(spark: SparkSession, d: str) -> DataFrame:
    return _cycle(spark, d)[1].select("member", _r5("s").alias("s"))


@query("SELECT obs_id, round(value+0.5*z,6) AS value, 0.5::DOUBLE AS sigma FROM (" + noise_sql("(SELECT event_type, row_number() OVER (ORDER BY event_type)-1 AS obs_id, avg(value) AS value FROM events GROUP BY event_type)", "obs_id", "obs_id, value") + ")")
def noisy_observations(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    from meshlark.plans.bindings import table

    means = table(spark, d, "events").groupBy("event_type").agg(F.avg("value").alias("value"))
    obs = means.withColumn("obs_id", big(F.row_number().over(Window.orderBy("event_type"))) - 1)
    return assim.noisy(obs, with_noise(obs, "obs_id", normal="z"), 0.5).select("obs_id", r6("value").alias("value"), "sigma")


@query(f"SELECT DISTINCT kz, ky, kx, kx::DOUBLE AS x, ky::DOUBLE AS y, 0.0::DOUBLE AS z FROM ({GRID})")
def row_coordinates(spark: SparkSession, d: str) -> DataFrame:
    """Coordinates of state rows by their cells; a field without a vertical axis lies at 0."""
    return assim.row_coords(grid(spark, d).select(*CELL).distinct(), axes(spark), {"x": "x", "y": "y", "z": None}).select(*CELL, "x", "y", "z")


# Parameters in time

_LENGTH, _KNOTS = 80.0, 8
_GAPS = [0.0, 20.0, 41.0, 63.0, 86.0, 110.0, 135.0, 161.0]
_NAMES = {"angle": (25.0, 6.0), "speed": (6.0, 0.5)}


def _relaxed_sql(start: str) -> str:
    """Paths of both parameters, with ``start(name, member, z, w)``."""
    lam = math.sqrt(3.0) / _LENGTH
    times = ", ".join(f"({k}::BIGINT,{x}::DOUBLE)" for k, x in enumerate(_GAPS))
    each = " UNION ALL ".join(
        f"SELECT '{n}' AS name, a.member, a.knot, a.z AS e1, b.z AS e2 FROM ({_draws_sql(i, 0)}) a JOIN ({_draws_sql(i, 1)}) b USING (member, knot)" for i, n in enumerate(_NAMES)
    )
    return f"""
    t AS (SELECT * FROM (VALUES {times}) AS t(knot, time)), n AS ({each}), o AS ({start}),
    h AS (SELECT n.*, ({lam}*(t.time-b.time))::DOUBLE AS h FROM n JOIN t USING (knot) JOIN t b ON b.knot=t.knot-1),
    f AS (SELECT *, exp(-h) AS g, 1-exp(-2*h)*(1+2*h+2*h*h) AS p, 1-exp(-2*h)*(1-2*h+2*h*h) AS q, 2*h*h*exp(-2*h) AS c FROM h),
    k AS (SELECT *, sqrt(p) AS a, c/sqrt(p) AS b, sqrt(greatest(q-c*c/p,0)) AS d FROM f),
    r AS (SELECT name, member, 0::BIGINT AS knot, z, w FROM o UNION ALL SELECT r.name, r.member, k.knot, g*(r.z+h*(r.z+r.w/{lam}))+a*e1, {lam}*(g*(r.w/{lam}-h*(r.z+r.w/{lam}))+b*e1+d*e2) FROM r JOIN k ON k.name=r.name AND k.member=r.member AND k.knot=r.knot+1)
    """


def _draws_sql(name: int, lane: int) -> str:
    return noise_sql(f"(SELECT unnest(range({_KNOTS})) AS knot), (SELECT unnest(range(16)) AS member)", f"({name}*100000+member*1000+knot+{lane * 500000})", "member, knot")


def _draws(spark: SparkSession) -> DataFrame:
    names = F.array(*[F.struct(F.lit(i).cast("long").alias("i"), F.lit(n).alias("name")) for i, n in enumerate(_NAMES)])
    knots = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(_KNOTS - 1).cast("long")))
    rows = spark.range(16).withColumnRenamed("id", "member").withColumn("knot", knots).withColumn("n", F.explode(names)).select("member", "knot", "n.*")
    for lane, e in enumerate(("e1", "e2")):
        rows = with_noise(rows.withColumn("id", F.col("i") * 100000 + F.col("member") * 1000 + F.col("knot") + lane * 500000), "id", normal=e)
    return rows.select("name", "member", "knot", "e1", "e2")


def _times(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(enumerate(_GAPS)), "knot long, time double")


_COLD = f"SELECT name, member, e1 AS z, e2*{math.sqrt(3.0) / _LENGTH} AS w FROM n WHERE knot=0"
_MEAN, _STD = (f"CASE name WHEN 'angle' THEN {_NAMES['angle'][i]} ELSE {_NAMES['speed'][i]} END" for i in (0, 1))


@query(f"WITH RECURSIVE {_relaxed_sql(_COLD)} SELECT name, member, knot, time, round({_MEAN}+{_STD}*z,6) AS value FROM r JOIN t USING (knot)")
def relaxation_prior(spark: SparkSession, d: str) -> DataFrame:
    """The first window's prior of a model of parameters in time."""
    got = priors.Relaxation(_NAMES, _LENGTH).sample(spark.range(16).withColumnRenamed("id", "member"), _times(spark), _draws(spark))
    return got.select("name", "member", "knot", "time", r6("value").alias("value"))


_POST = f"SELECT 'angle' AS name, m AS member, k::DOUBLE*10 AS time, x AS value FROM ({SERIES}) WHERE param='click' QUALIFY count(*) FILTER (k IN (29, 30)) OVER (PARTITION BY m)=2"
_WARM = f"""
SELECT name, member, z0 AS z, w0 AS w FROM (SELECT name, member, max((value-mean)/6.0) FILTER (time=300) AS z0, (max((value-mean)/6.0) FILTER (time=300)-max((value-mean)/6.0) FILTER (time=290))/10.0 AS w0
  FROM (SELECT *, avg(value) OVER (PARTITION BY time) AS mean FROM ({_POST})) GROUP BY ALL)
UNION ALL SELECT * FROM ({_COLD}) WHERE name='speed'
"""
_NEXT = f"""
WITH RECURSIVE {_relaxed_sql(_WARM)}, mu AS (SELECT avg(value) AS mu FROM ({_POST}) WHERE time=300)
"""


def _posterior(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    s = series(spark, d).where("param = 'click'").select(F.lit("angle").alias("name"), F.col("m").alias("member"), (F.col("k") * 10.0).alias("time"), F.col("x").alias("value"))
    both = s.withColumn("n", F.count_if(F.col("time").isin(290.0, 300.0)).over(Window.partitionBy("member"))).where("n = 2").drop("n")
    static = both.select("member").distinct().select(F.lit("roughness").alias("name"), "member", F.lit(None).cast("double").alias("time"), F.lit(0.1).alias("value"))
    return both.unionByName(static)


@query(f"""
{_NEXT} SELECT name, member, knot, time, round(CASE name WHEN 'angle' THEN exp(-time/{_LENGTH})*mu+(1-exp(-time/{_LENGTH}))*25.0+6.0*z ELSE 6.0+0.5*z END,6) AS value FROM r JOIN t USING (knot), mu
UNION ALL SELECT 'roughness', member, NULL, NULL, 0.1 FROM (SELECT DISTINCT member FROM ({_POST}))
""")
def relaxation_next(spark: SparkSession, d: str) -> DataFrame:
    """The next window's prior: one parameter goes on from its members' ends, one that is not in the posterior starts cold, a static one passes."""
    got = priors.Relaxation(_NAMES, _LENGTH).extrapolate(_posterior(spark, d), _times(spark), _draws(spark))
    return got.select("name", "member", "knot", "time", r6("value").alias("value"))


@query(f"{_NEXT} SELECT name, member, round(z,6) AS z, round(w,6) AS w FROM r WHERE knot={_KNOTS - 1}")
def carried_paths(spark: SparkSession, d: str) -> DataFrame:
    """What the model carries from window to window: where each path stands, and how it moves."""
    model = priors.Relaxation(_NAMES, _LENGTH)
    model.extrapolate(_posterior(spark, d), _times(spark), _draws(spark))
    return model.state.select("name", "member", r6("z").alias("z"), r6("w").alias("w"))


# Observations, members, schedules

_PICKED = [(0, 0, 1, 2), (1, 3, 3, 4), (2, 6, 0, 0)]


@query(f"""
WITH s AS (SELECT * FROM (VALUES {', '.join(f'({n}::BIGINT,{z},{y},{x})' for n, z, y, x in _PICKED)}) AS s(sensor, kz, ky, kx)), b AS (SELECT frame_idx, row_number() OVER (ORDER BY frame_idx)-1 AS bin FROM (SELECT DISTINCT frame_idx FROM ({TIMED}) JOIN s USING (kz, ky, kx))),
l AS (SELECT frame_idx, sensor, 'u' AS var, 0 AS n, u AS value FROM ({TIMED}) JOIN s USING (kz, ky, kx) UNION ALL SELECT frame_idx, sensor, 'w', 1, w FROM ({TIMED}) JOIN s USING (kz, ky, kx))
SELECT (bin*2+n)*3+sensor AS obs_id, frame_idx, sensor, var, round(value,6) AS value FROM l JOIN b USING (frame_idx)
""")
def full_observations(spark: SparkSession, d: str) -> DataFrame:
    """Every frame at every sensor, frames outermost."""
    cells = spark.createDataFrame(_PICKED, "sensor long, kz long, ky long, kx long")
    at = g.pick_cells(timed_grid(spark, d), cells).select("frame_idx", "sensor", "u", "w")
    return t.full_observations(at, ["u", "w"], 3).select("obs_id", "frame_idx", "sensor", "var", r6("value").alias("value"))


@query(f"SELECT param, k, round(x,6) AS x FROM ({SERIES}) WHERE m=3")
def member_params(spark: SparkSession, d: str) -> DataFrame:
    """One member's parameters, and all of a table without members."""
    one = ensemble.member_params(series(spark, d).withColumnRenamed("m", "member"), 3)
    return ensemble.member_params(one, None).select("param", "k", r6("x").alias("x"))


_STAGGERED = [
    ("faces", "u", "zt", "yt", "xm"), ("faces", "v", "zt", "ym", "xt"), ("faces", "w", "zm", "yt", "xt"),
    ("centres", "u", "z", "y", "x"), ("centres", "v", "z", "y", "x"), ("centres", "w", "z", "y", "x"),
    ("mixed", "u", "z", "y", "xu"), ("mixed", "v", "z", "yv", "x"), ("mixed", "w", "z", "y", "x"),
]


@query("SELECT * FROM (VALUES " + ", ".join(str(r) for r in _STAGGERED) + ") AS s(model, var, z, y, x)")
def staggered_axes(spark: SparkSession, d: str) -> DataFrame:
    """The axes that each component sits on, as the columns of that model name them."""
    rows = []
    for model, components in g.STAGGERING.items():
        columns = sorted({a for dims in components.values() for a in dims})
        rows += [(model, var, *(g.resolve_axis(columns, a) for a in dims)) for var, dims in components.items()]
    return spark.createDataFrame(rows, "model string, var string, z string, y string, x string")


@query("SELECT * FROM (VALUES ('faces','inflow_angle'),('faces','velocity_magnitude'),('faces','pressure_gradient_magnitude'),('centres','inflow_angle'),('centres','velocity_magnitude'),('mixed','inflow_angle'),('mixed','velocity_magnitude')) AS p(model, name)")
def model_parameters(spark: SparkSession, d: str) -> DataFrame:
    return spark.createDataFrame([(m, n) for m, names in g.PARAMETERS.items() for n in names], "model string, name string")


@query(f"SELECT frame_idx, kz AS z, ky AS y, kx AS x, round(u,6) AS u FROM ({TIMED})")
def regular_axes(spark: SparkSession, d: str) -> DataFrame:
    """Centre axes under plain names; a second time changes nothing."""
    s = timed_grid(spark, d).select("frame_idx", F.col("kz").alias("zt"), F.col("ky").alias("yt"), F.col("kx").alias("xt"), "u")
    return g.to_regular(g.to_regular(s)).select("frame_idx", "z", "y", "x", r6("u").alias("u"))


@query(f"""
WITH k AS (SELECT param, k*2.0::DOUBLE+5 AS time, avg(x) AS y FROM ({SERIES}) GROUP BY ALL), a AS (SELECT param, (s+1)*3.5 AS time FROM (SELECT DISTINCT param FROM ({SERIES}) UNION ALL SELECT 'unknown'), (SELECT unnest(range(20)) AS s)),
j AS (SELECT a.*, (SELECT max(time) FROM k WHERE k.param=a.param AND k.time<=a.time) AS lo, (SELECT min(time) FROM k WHERE k.param=a.param AND k.time>=a.time) AS hi FROM a)
SELECT j.param, CAST(j.time AS DOUBLE) AS time, round(coalesce(CASE WHEN lo IS NULL THEN h.y WHEN hi IS NULL OR hi=lo THEN l.y ELSE l.y+(h.y-l.y)*(j.time-lo)/(hi-lo) END, 7.5),6) AS y FROM j LEFT JOIN k l ON l.param=j.param AND l.time=lo LEFT JOIN k h ON h.param=j.param AND h.time=hi
""")
def schedule_lookup(spark: SparkSession, d: str) -> DataFrame:
    """A schedule at the ends of a model's steps, a default where there is none."""
    s = series(spark, d)
    known = s.groupBy("param", "k").agg(F.avg("x").alias("y")).select("param", (F.col("k") * 2.0 + 5).alias("time"), "y")
    names = s.select("param").distinct().unionAll(spark.createDataFrame([("unknown",)], "param string"))
    asked = names.select("param", F.explode(F.transform(F.sequence(F.lit(0), F.lit(19)), lambda i: (i + 1) * 3.5)).alias("time"))
    return align.schedule_at(asked, known, ["param"], "time", "y", default=7.5).select("param", F.col("time").cast("double").alias("time"), r6("y").alias("y"))


@query(f"SELECT kz, ky, kx, round(u,6) AS u, round(w2,6) AS w2 FROM (SELECT * FROM ({TIMED}) WHERE frame_idx=0) JOIN (SELECT kz, ky, kx, w AS w2 FROM ({TIMED}) WHERE frame_idx=1) USING (kz, ky, kx)")
def merged_positions(spark: SparkSession, d: str) -> DataFrame:
    s = timed_grid(spark, d)
    left, right = s.where("frame_idx = 0").select(*CELL, "u"), s.where("frame_idx = 1").select(*CELL, "u", F.col("w").alias("w2"))
    return ensemble.merge_positions(left, right, CELL).select(*CELL, r6("u").alias("u"), r6("w2").alias("w2"))


@query("SELECT 'frames' AS kind, CAST(floor(i*29/6.0) AS BIGINT) AS n FROM (SELECT unnest(range(7)) AS i) UNION ALL SELECT 'members', CAST(floor(i*15/4.0) AS BIGINT) FROM (SELECT unnest(range(5)) AS i)")
def even_subsets(spark: SparkSession, d: str) -> DataFrame:
    """Evenly spaced frames and members."""
    rows = [("frames", n) for n in g.spread_frames(30, 7)] + [("members", n) for n in ensemble.even_members(16, 5)]
    return spark.createDataFrame(rows, "kind string, n long")


@query("SELECT w AS win, w*12.5::DOUBLE AS begin, (w+1)*12.5::DOUBLE AS finish, w%2=1 AS shaded FROM (SELECT unnest(range(6)) AS w)")
def window_edges(spark: SparkSession, d: str) -> DataFrame:
    return spark.createDataFrame(t.window_edges(6, 12.5), "win long, begin double, finish double, shaded boolean")


@query("SELECT DISTINCT least(CAST(round_even(i*1.4, 0) AS BIGINT), 14) AS step FROM (SELECT unnest(range(12)) AS i)")
def output_schedule(spark: SparkSession, d: str) -> DataFrame:
    """The steps nearest to requested times, each once, none after the end."""
    return spark.createDataFrame([(n,) for n in t.output_steps([0.7 * i for i in range(12)], 0.5, 14)], "step long")


_LEVELS = f"SELECT DISTINCT m, kz, kz*1.5+0.75::DOUBLE AS coord FROM ({GRID}) WHERE kz<CASE WHEN m=5 THEN 5 WHEN m=2 THEN 6 ELSE 7 END"


def _levels(spark: SparkSession, d: str) -> DataFrame:
    top = F.when(F.col("m") == 5, 5).when(F.col("m") == 2, 6).otherwise(7)
    return grid(spark, d).select("m", "kz").distinct().where(F.col("kz") < top).withColumn("coord", F.col("kz") * 1.5 + 0.75)


@query(f"SELECT kz, round(coord,6) AS coord FROM ({_LEVELS}) WHERE m=5")
def canonical_levels(spark: SparkSession, d: str) -> DataFrame:
    """The levels of the member that has the fewest."""
    return ensemble.canonical_levels(_levels(spark, d)).select("kz", r6("coord").alias("coord"))


@query(f"SELECT m, kz, ky, kx, round(u,6) AS u, kz*1.5+0.75::DOUBLE AS coord FROM ({GRID}) WHERE kz<5")
def fixed_levels(spark: SparkSession, d: str) -> DataFrame:
    """States cut to canonical levels, which their own have to match."""
    states = grid(spark, d).withColumn("coord", F.col("kz") * 1.5 + 0.75 + 1e-10)
    got = ensemble.fix_levels(states, ensemble.canonical_levels(_levels(spark, d)), ["u"], "coord")
    return got.select("m", *CELL, r6("u").alias("u"), r6("coord").alias("coord"))


_KIND = "CASE substring(tag, 2, 1) WHEN '1' THEN 'pressure' WHEN '2' THEN 'flow_rate' WHEN '3' THEN 'coriolis' END"


@query(f"SELECT run_id, {', '.join(f'''round(CASE WHEN kind='{k}' THEN metric ELSE 0 END,6) AS {c}''' for k, c in scalar.FORCINGS.items())} FROM (SELECT run_id, metric, {_KIND} AS kind FROM ({RUNS}))")
def forcing_table(spark: SparkSession, d: str) -> DataFrame:
    """Each run's forcing in the column of its kind."""
    kind = F.element_at(F.create_map(*[F.lit(x) for x in ("1", "pressure", "2", "flow_rate", "3", "coriolis")]), F.substring("tag", 2, 1))
    kinds = F.array_compact(F.array(kind))
    return runs(spark, d).withColumns(scalar.forcing_columns(kinds, F.col("metric"))).select("run_id", *[r6(c).alias(c) for c in scalar.FORCINGS.values()])


_LOSSES = f"SELECT param, k AS epoch, avg(x) AS loss FROM ({SERIES}) GROUP BY ALL"


@query(f"""
WITH l AS ({_LOSSES}), b AS (SELECT *, loss<coalesce(min(loss) OVER (PARTITION BY param ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 'infinity'::DOUBLE) AS better FROM l),
e AS (SELECT *, max(CASE WHEN better THEN epoch END) OVER (PARTITION BY param ORDER BY epoch) AS best_epoch FROM b), s AS (SELECT *, epoch-best_epoch>=4 AS stop FROM e)
SELECT param, epoch, round(loss,6) AS loss, best_epoch, stop, CAST(CASE WHEN epoch>=12 THEN 4 WHEN epoch>=6 THEN 2 ELSE 1 END AS BIGINT) AS steps FROM s a WHERE NOT EXISTS (FROM s z WHERE z.param=a.param AND z.epoch<a.epoch AND z.stop)
""")
def early_stops(spark: SparkSession, d: str) -> DataFrame:
    """Training runs up to where they stop, with the curriculum's steps."""
    losses = series(spark, d).groupBy("param", F.col("k").alias("epoch")).agg(F.avg("x").alias("loss"))
    got = scores.early_stop(losses, ["param"], 4).withColumn("steps", scores.curriculum(F.col("epoch"), [(0, 1), (6, 2), (12, 4)]))
    return got.select("param", "epoch", r6("loss").alias("loss"), "best_epoch", "stop", "steps")


@query(f"SELECT m, step, kz, ky, kx, round((u+10)*pow(0.5, step),6) AS u FROM ({GRID}), (SELECT unnest(range(1,3)) AS step)")
def spun_up_rollout(spark: SparkSession, d: str) -> DataFrame:
    """Members spun up by one model, then rolled out by another."""
    state = grid(spark, d).select(*CELL, "m", "u")
    params = spark.range(8).select(F.col("id").alias("m"), F.lit(10.0).alias("push"), F.lit(0.5).alias("decay"))

    def push(s, p):
        return s.assign(u=s["u"] + float(p["push"].iloc[0]))

    def step(s, p):
        return s.assign(u=s["u"] * float(p["decay"].iloc[0]))

    got = ensemble.spin_up_then_roll(state, params, push, step, "kz long, ky long, kx long, m long, u double", 2)
    return got.select("m", "step", *CELL, r6("u").alias("u"))


@query(f"""
WITH a AS (SELECT * FROM ({TIMED}) WHERE time<=8 AND kz<6), b AS (SELECT * FROM ({TIMED}) WHERE time>=2 AND kz>0), p AS (SELECT a.time, a.u-2*b.u AS du, a.v-b.v AS dv, a.w-b.w AS dw FROM a JOIN b USING (time, kz, ky, kx))
SELECT time, round(sqrt((sum(du*du)+sum(dv*dv)+sum(dw*dw))/(3*count(*))),6) AS rmse FROM p GROUP BY time
""")
def state_rmse_common(spark: SparkSession, d: str) -> DataFrame:
    """Two states on the frames and levels that both have, the second put on the first one's cells."""
    s = timed_grid(spark, d).drop("frame_idx")
    got = scores.state_rmse(s.where("time <= 8 and kz < 6"), s.where("time >= 2 and kz > 0"), CELL, regrid=lambda b: g.rescale(b, {"u": 2.0}))
    return got.select("time", r6("rmse").alias("rmse"))


@query(f"SELECT kz, ky, kx, m, round(u,6) AS u, round(w,6) AS w FROM ({GRID})")
def rescaled_and_back(spark: SparkSession, d: str) -> DataFrame:
    scales = ({"u": 0.25, "w": 3.0}, {"u": -7.5})
    return g.rescale(g.rescale(grid(spark, d), *scales), *scales, inverse=True).select(*CELL, "m", r6("u").alias("u"), r6("w").alias("w"))
