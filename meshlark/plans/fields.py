"""Queries over gridded fields: projections, slices, interpolation, collocation, masks, functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from meshlark.functions import scalar
from meshlark.operators import grid as g
from meshlark.operators import temporal as t
from meshlark.plans.bindings import AXES, GRID, SENSORS, TIMED, axes, big, grid, r6, sensors, table, timed_grid
from meshlark.plans.registry import query

CELL = ["kz", "ky", "kx"]
UVW = "round(u,6) AS u, round(v,6) AS v, round(w,6) AS w"


def _uvw(df: DataFrame, *keys: str) -> DataFrame:
    return df.select(*keys, r6("u").alias("u"), r6("v").alias("v"), r6("w").alias("w"))


@query(f"SELECT kz, ky, kx, m, round(sqrt(u*u+v*v+w*w),6) AS vel FROM ({GRID})")
def velocity_magnitude(spark: SparkSession, d: str) -> DataFrame:
    return g.with_magnitude(grid(spark, d)).select(*CELL, "m", r6("vel").alias("vel"))


@query(f"SELECT ky, kx, m, {UVW} FROM ({GRID}) WHERE kz=3")
def z_plane(spark: SparkSession, d: str) -> DataFrame:
    return _uvw(g.z_plane(grid(spark, d), 3), "ky", "kx", "m")


@query(f"WITH s AS ({TIMED}) SELECT ky, kx, {UVW} FROM s WHERE frame_idx=(SELECT max(frame_idx) FROM s) AND kz=(SELECT CAST(floor((max(kz)+1)/2) AS BIGINT) FROM s)")
def last_slice(spark: SparkSession, d: str) -> DataFrame:
    return _uvw(g.last_slice(timed_grid(spark, d)), "ky", "kx")


@query(f"WITH s AS ({TIMED}) SELECT min(kx) AS x_min, max(kx) AS x_max, min(ky) AS y_min, max(ky) AS y_max FROM s WHERE frame_idx=(SELECT max(frame_idx) FROM s) AND kz=2")
def slice_extent(spark: SparkSession, d: str) -> DataFrame:
    return g.slice_extent(g.last_slice(timed_grid(spark, d), 2), "kx", "ky")


@query(f"SELECT kz, ky, kx, m, round(sqrt(u*u+v*v+w*w),6) AS vel FROM ({GRID}) WHERE kz IN (0,2,4,6)")
def magnitude_on_levels(spark: SparkSession, d: str) -> DataFrame:
    state = grid(spark, d).where(F.col("kz").isin(g.spread_levels(7, 4)))
    return g.with_magnitude(state).select(*CELL, "m", r6("vel").alias("vel"))


@query(f"SELECT kz-1 AS kz, ky, kx, m, {UVW} FROM ({GRID}) WHERE kz>0")
def drop_lowest_layer(spark: SparkSession, d: str) -> DataFrame:
    return _uvw(g.drop_lowest(grid(spark, d)), *CELL, "m")


@query(f"SELECT kz, ky, kx, m, round(CASE WHEN (kx+ky)%3=0 THEN 0.0 ELSE u END,6) AS u FROM ({GRID})")
def fill_solids(spark: SparkSession, d: str) -> DataFrame:
    holes = grid(spark, d).withColumn("u", F.when((F.col("kx") + F.col("ky")) % 3 == 0, F.lit(float("nan"))).otherwise(F.col("u")))
    return g.fill_solids(holes, ["u"]).select(*CELL, "m", r6("u").alias("u"))


@query(f"SELECT kz, ky, kx, m, round(u*0.25,6) AS u, round(v*0.25,6) AS v, round(w*0.25,6) AS w, round(kx*1.0-7.5,6) AS x FROM ({GRID})")
def scaled_and_shifted(spark: SparkSession, d: str) -> DataFrame:
    s = grid(spark, d).withColumns({c: F.col(c) * 0.25 for c in "uvw"}).withColumn("x", F.col("kx") * 1.0 - 7.5)
    return s.select(*CELL, "m", *[r6(c).alias(c) for c in ("u", "v", "w", "x")])


def _cells(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(0, 1, 2, 3), (1, 0, 0, 0), (2, 6, 3, 4)], "sensor long, kz long, ky long, kx long")


@query(f"SELECT sensor, m, {UVW} FROM ({GRID}) JOIN (VALUES (0,1,2,3),(1,0,0,0),(2,6,3,4)) AS s(sensor,kz,ky,kx) USING (kz,ky,kx)".replace("SELECT sensor,", "SELECT CAST(sensor AS BIGINT) AS sensor,"))
def sensor_pick(spark: SparkSession, d: str) -> DataFrame:
    return _uvw(g.pick_cells(grid(spark, d), _cells(spark)), "sensor", "m")


def _weights_sql(axis: str) -> str:
    n = {"x": 5, "y": 4, "z": 7}[axis]
    lo = f"CAST(least(greatest(floor({axis}), 0), {n - 2}) AS BIGINT)"
    return f"{lo} AS lo_{axis}, {lo}+1 AS hi_{axis}, {axis}-{lo} AS w_{axis}"


@query(f"SELECT sensor_set, sensor, {', '.join(_weights_sql(a) for a in 'xyz')} FROM ({SENSORS})".replace(" AS w_x", " AS wx").replace("x-CAST", "x-CAST").replace(" AS wx", " AS w_x"))
def axis_weights(spark: SparkSession, d: str) -> DataFrame:
    points, lines = sensors(spark), axes(spark)
    for a in "xyz":
        points = g.axis_weights(lines, points, a)
    return points.select("sensor_set", "sensor", *[c for a in "xyz" for c in (f"lo_{a}", f"hi_{a}", f"w_{a}")])


TRILINEAR = f"""
WITH p AS (SELECT sensor_set, sensor, {', '.join(_weights_sql(a) for a in 'xyz')} FROM ({SENSORS})),
c AS (SELECT sensor_set, sensor, lo_x+i AS kx, lo_y+j AS ky, lo_z+k AS kz,
        (CASE WHEN i=0 THEN 1-w_x ELSE w_x END)*(CASE WHEN j=0 THEN 1-w_y ELSE w_y END)*(CASE WHEN k=0 THEN 1-w_z ELSE w_z END) AS weight
      FROM p, (VALUES (0),(1)) a(i), (VALUES (0),(1)) b(j), (VALUES (0),(1)) e(k))
"""


@query(
    TRILINEAR
    + f"SELECT sensor_set, sensor, m, round(CASE WHEN count(*)=8 THEN sum(u*weight) END,6) AS u, round(CASE WHEN count(*)=8 THEN sum(v*weight) END,6) AS v, round(CASE WHEN count(*)=8 THEN sum(w*weight) END,6) AS w FROM ({GRID}) JOIN c USING (kz,ky,kx) GROUP BY ALL"
)
def sensor_trilinear(spark: SparkSession, d: str) -> DataFrame:
    weights = g.corner_weights(axes(spark), sensors(spark))
    return _uvw(g.interpolate_at(grid(spark, d), weights, ["u", "v", "w"], ["sensor_set", "sensor", "m"]), "sensor_set", "sensor", "m")


INTERVALS = f"""
{TRILINEAR}, s AS (SELECT *, sqrt(u*u+v*v+w*w) AS vel FROM ({TIMED})),
b AS (SELECT kz, ky, kx, CAST(floor((time-(SELECT min(time) FROM s))/4.0) AS BIGINT) AS bin, avg(u) AS u, avg(vel) AS vel FROM s GROUP BY ALL),
o AS (SELECT sensor, bin, CASE WHEN count(*)=8 THEN sum(u*weight) END AS u, CASE WHEN count(*)=8 THEN sum(vel*weight) END AS vel FROM b JOIN c USING (kz,ky,kx) WHERE sensor_set='assimilation' GROUP BY ALL)
SELECT bin, sensor, 'u' AS var, round(u,6) AS value, (bin*2+0)*4+sensor AS obs_id FROM o
UNION ALL SELECT bin, sensor, 'vel', round(vel,6), (bin*2+1)*4+sensor FROM o
"""


@query(INTERVALS)
def sensor_interval_obs(spark: SparkSession, d: str) -> DataFrame:
    """From a timed grid to an observation vector: magnitude, interval means, interpolation, order."""
    state = g.with_magnitude(timed_grid(spark, d))
    binned = t.reduce_intervals(state, 4.0, "mean", ["u", "vel"], CELL)
    weights = g.corner_weights(axes(spark), sensors(spark).where("sensor_set = 'assimilation'"))
    at = g.interpolate_at(binned, weights, ["u", "vel"], ["sensor", "bin"])
    return t.as_observations(at, ["u", "vel"], 4).select("bin", "sensor", "var", r6("value").alias("value"), "obs_id")


@query(
    f"SELECT kz, ky, kx, m, round(coalesce((u+lead(u) OVER q)/2, u+(u-lag(u) OVER q)/2, u),6) AS u FROM ({GRID}) WINDOW q AS (PARTITION BY kz, ky, m ORDER BY kx)"
)
def collocate(spark: SparkSession, d: str) -> DataFrame:
    return g.collocate(grid(spark, d), "u", "x", ["kz", "ky", "m"]).select(*CELL, "m", r6("u").alias("u"))


_REGRID_POINTS = [(0, 0.5, 0.5), (1, 3.25, 2.75), (2, 4.0, 3.0), (3, 4.5, 1.0), (4, 2.0, -0.5)]


def _targets(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(_REGRID_POINTS, "point long, x double, y double")


def _regrid_sql(extrapolate: bool) -> str:
    points = ", ".join(f"({p}::BIGINT,{x}::DOUBLE,{y}::DOUBLE)" for p, x, y in _REGRID_POINTS)
    inside = "true" if extrapolate else "x BETWEEN 0 AND 4 AND y BETWEEN 0 AND 3"
    return f"""
    WITH p AS (SELECT * FROM (VALUES {points}) AS p(point,x,y)), q AS (SELECT point, {_weights_sql('x')}, {_weights_sql('y')} FROM p WHERE {inside}),
    c AS (SELECT point, lo_x+i AS kx, lo_y+j AS ky, (CASE WHEN i=0 THEN 1-w_x ELSE w_x END)*(CASE WHEN j=0 THEN 1-w_y ELSE w_y END) AS weight FROM q, (VALUES (0),(1)) a(i), (VALUES (0),(1)) b(j)),
    r AS (SELECT point, kz, m, sum(u*weight) AS u FROM ({GRID}) JOIN c USING (ky,kx) GROUP BY ALL)
    SELECT point, x, y, kz, m, round(u,6) AS u FROM p LEFT JOIN r USING (point)
    """


@query(_regrid_sql(False))
def regrid_bilinear(spark: SparkSession, d: str) -> DataFrame:
    return g.regrid(grid(spark, d), axes(spark), _targets(spark), "u", ["kz", "m"], ("x", "y")).select("point", "x", "y", "kz", "m", r6("u").alias("u"))


@query(_regrid_sql(True))
def regrid_extrapolated(spark: SparkSession, d: str) -> DataFrame:
    return g.regrid(grid(spark, d), axes(spark), _targets(spark), "u", ["kz", "m"], ("x", "y"), extrapolate=True).select("point", "x", "y", "kz", "m", r6("u").alias("u"))


@query(f"SELECT axis, arg_min(k, (abs(coord-2.6), k)) AS k FROM ({AXES}) GROUP BY axis")
def nearest_cells(spark: SparkSession, d: str) -> DataFrame:
    x, y, z = (g.nearest_cell(axes(spark), a, 2.6) for a in "xyz")
    return x.union(y).union(z)


@query("SELECT k, round((k+0.5)*2.5-10,6) AS centre, round(k*2.5-10,6) AS low, round((k+1)*2.5-10,6) AS high FROM (SELECT unnest(range(12)) AS k)")
def cell_centres(spark: SparkSession, d: str) -> DataFrame:
    return g.cell_centres(spark, 12, 2.5, -10.0).select("k", *[r6(c).alias(c) for c in ("centre", "low", "high")])


@query("SELECT 'assimilation' AS sensor_set, CAST(j*4+i AS BIGINT) AS sensor, 1.0+i*2.0 AS x, 0.5+j*1.5 AS y, 3.0::DOUBLE AS z FROM (SELECT unnest(range(4)) AS i), (SELECT unnest(range(3)) AS j)".replace("1.0+i*2.0", "CAST(1.0+i*2.0 AS DOUBLE)").replace("0.5+j*1.5", "CAST(0.5+j*1.5 AS DOUBLE)"))
def sensor_raster(spark: SparkSession, d: str) -> DataFrame:
    return g.points_from_grid(spark, "assimilation", (1.0, 7.0, 4), (0.5, 3.5, 3), 3.0)


@query(f"SELECT kz, ky, kx, m, CAST(w>5 AS BIGINT) AS fluid FROM ({GRID})")
def fluid_mask(spark: SparkSession, d: str) -> DataFrame:
    still = grid(spark, d).withColumns({c: F.when(F.col("w") > 5, F.col(c)).otherwise(F.lit(0.0)) for c in "uvw"})
    return g.fluid_mask(still).select(*CELL, "m", "fluid")


@query(f"SELECT kz, ky, kx, m, CAST(CASE WHEN kz<2 AND kx=1 THEN 1 ELSE 0 END AS BIGINT) AS blanking, CAST(CASE WHEN kz<2 AND kx=1 THEN 0 ELSE 1 END AS BIGINT) AS fluid FROM ({GRID})")
def attach_blanking(spark: SparkSession, d: str) -> DataFrame:
    state = grid(spark, d)
    solid = state.where("kz < 2 and kx = 1").select(*CELL).distinct()
    return g.fluid_mask(g.attach_blanking(state, solid)).select(*CELL, "m", "blanking", "fluid")


@query("""
SELECT o_orderkey, round(s*cos(radians(a)),6) AS u, round(s*sin(radians(a)),6) AS v, round(sqrt(pow(s*cos(radians(a)),2)+pow(s*sin(radians(a)),2)),6) AS speed,
  round(degrees(atan2(s*sin(radians(a)), s*cos(radians(a)))),4) AS angle
FROM (SELECT o_orderkey, CAST(o_orderkey%350-174.5 AS DOUBLE) AS a, o_totalprice/10000+0.1 AS s FROM orders)
""")
def inflow_components(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select("o_orderkey", (F.col("o_orderkey") % 350 - 174.5).cast("double").alias("a"), (F.col("o_totalprice") / 10000 + 0.1).alias("s"))
    u, v = scalar.angle_to_velocity(F.col("a"), F.col("s"))
    return o.select("o_orderkey", r6(u).alias("u"), r6(v).alias("v"), r6(scalar.magnitude(u, v)).alias("speed"), F.round(scalar.velocity_to_angle(u, v), 4).alias("angle"))


@query("""
SELECT o_orderkey, round(p*cos(radians(a)),6) AS dpdx, round(p*sin(radians(a)),6) AS dpdy, round(p,6) AS size, o_orderkey%3<>0 AS consistent
FROM (SELECT o_orderkey, CAST(o_orderkey%170-84.5 AS DOUBLE) AS a, o_totalprice/1000+0.5 AS p FROM orders)
""")
def pressure_gradient(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select("o_orderkey", (F.col("o_orderkey") % 170 - 84.5).cast("double").alias("a"), (F.col("o_totalprice") / 1000 + 0.5).alias("p"))
    x, y = scalar.angle_to_pressure_gradient(F.col("a"), F.col("p"))
    u, v = scalar.angle_to_velocity(F.col("a") + F.when(F.col("o_orderkey") % 3 == 0, 1.0).otherwise(0.0), F.lit(2.0))
    return o.select("o_orderkey", r6(x).alias("dpdx"), r6(y).alias("dpdy"), r6(scalar.magnitude(x, y)).alias("size"), scalar.pressure_gradient_consistent(F.col("a"), u, v, x, y).alias("consistent"))


@query("SELECT p_partkey, 1.0::DOUBLE AS uniform, round(pow(greatest(p_size::DOUBLE, 5.0)/50.0, 0.25),6) AS power_law FROM part")
def profile_shape(spark: SparkSession, d: str) -> DataFrame:
    z = F.col("p_size").cast("double")
    power = scalar.profile_shape(z, "power_law", alpha=0.25, z_ref=50.0, z_0=5.0)
    return table(spark, d, "part").select("p_partkey", scalar.profile_shape(z, "uniform").alias("uniform"), r6(power).alias("power_law"))


@query("SELECT p_partkey, round(CASE WHEN x<0.5 THEN 10+(40-10)*x*2 ELSE 40+(20-40)*(x*2-1) END,6) AS value, round(70/3.0,6) AS mean FROM (SELECT p_partkey, p_size/50.0 AS x FROM part)")
def control_points(spark: SparkSession, d: str) -> DataFrame:
    values = [10.0, 40.0, 20.0]
    return table(spark, d, "part").select("p_partkey", r6(scalar.control_points(values, F.col("p_size") / 50.0)).alias("value"), r6(F.lit(scalar.control_mean(values))).alias("mean"))


@query("""
SELECT p_partkey, round(CASE WHEN x<=12.5 THEN 1.0 WHEN x<=25 THEN exp(pow((x-12.5)/(12.5/sqrt(ln(4.0))),2)) END,6) AS inflation,
  round(least(3.0/sqrt(p_size),0.99),6) AS truncation, round(exp(-(x-1)/100.0),6) AS weight FROM (SELECT p_partkey, p_size, p_size::DOUBLE AS x FROM part)
""")
def taper(spark: SparkSession, d: str) -> DataFrame:
    x = F.col("p_size").cast("double")
    return table(spark, d, "part").select(
        "p_partkey", r6(scalar.taper_inflation(x, 25.0, 0.5, 4.0)).alias("inflation"), r6(scalar.default_truncation(F.col("p_size"))).alias("truncation"),
        r6(scalar.relaxation_weight(x, F.lit(1.0), 100.0)).alias("weight"),
    )


@query("SELECT p_partkey, round(round_even(greatest(p_retailprice-900,0)/2.5,0)*2.5,6) AS height, round(greatest(5.0,least(p_size::DOUBLE,20.0)),6) AS clipped, round(290.0+p_size*(0.01*200.0/50),6) AS thl FROM part")
def heights_and_lapse(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    return p.select(
        "p_partkey", r6(scalar.snap(F.col("p_retailprice"), 2.5, 900.0)).alias("height"), r6(scalar.clip(F.col("p_size").cast("double"), 5.0, 20.0)).alias("clipped"),
        r6(scalar.lapse_profile(F.col("p_size"), 290.0, 0.01, 200.0, 50)).alias("thl"),
    )


@query("SELECT count(*) FILTER (p_size<20) AS levels FROM part")
def nudged_levels(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").agg(scalar.nudged_levels(F.col("p_size"), 20).alias("levels"))


@query("SELECT time, kz, round(u*pow(greatest(kz+0.5,0.5)/7.0,0.25),6) AS u, 288.0::DOUBLE AS thl FROM (SELECT CAST(day(ts) AS BIGINT) AS time, avg(value)/100 AS u FROM events GROUP BY 1), (SELECT unnest(range(7)) AS kz)")
def nudging_profiles(spark: SparkSession, d: str) -> DataFrame:
    schedule = table(spark, d, "events").groupBy(big(F.day("ts")).alias("time")).agg((F.avg("value") / 100).alias("u"))
    levels = schedule.withColumn("kz", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(6).cast("long"))))
    shape = scalar.profile_shape(F.col("kz") + 0.5, "power_law", alpha=0.25, z_ref=7.0, z_0=0.5)
    return levels.select("time", "kz", r6(F.col("u") * shape).alias("u"), F.lit(288.0).alias("thl"))


@query("SELECT event_id, round((value-m)/CASE WHEN s>0 THEN s ELSE 1 END,6) AS z FROM (SELECT event_id, value, avg(value) OVER (PARTITION BY event_type) AS m, stddev_pop(value) OVER (PARTITION BY event_type) AS s FROM events)")
def z_scores(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    stats = e.groupBy("event_type").agg(F.avg("value").alias("m"), F.stddev_pop("value").alias("s"))
    return e.join(F.broadcast(stats), "event_type").select("event_id", r6(scalar.z_score(F.col("value"), F.col("m"), F.col("s"))).alias("z"))


@query(f"SELECT axis, CAST(count(*) AS BIGINT) AS cells, min(coord) AS origin FROM ({AXES}) GROUP BY axis")
def axis_origins(spark: SparkSession, d: str) -> DataFrame:
    return axes(spark).groupBy("axis").agg(F.count(F.lit(1)).alias("cells"), F.min("coord").alias("origin"))


@query(f"SELECT kz, ky, kx, round(u,6) AS u, round(u-avg(u) OVER (PARTITION BY kz),6) AS departure FROM ({TIMED}) WHERE frame_idx=0")
def level_departures(spark: SparkSession, d: str) -> DataFrame:
    first = t.first_frames(timed_grid(spark, d))
    return first.select(*CELL, r6("u").alias("u"), r6(F.col("u") - F.avg("u").over(Window.partitionBy("kz"))).alias("departure"))


@query(f"SELECT var, round(min(value),6) AS low, round(max(value),6) AS high FROM (UNPIVOT (SELECT u, v, w FROM ({TIMED})) ON u, v, w INTO NAME var VALUE value) GROUP BY var")
def value_limits(spark: SparkSession, d: str) -> DataFrame:
    got = g.limits(timed_grid(spark, d), ["u", "v", "w"])
    return got.select("var", r6("low").alias("low"), r6("high").alias("high"))


@query(f"""
{TRILINEAR}, s AS (SELECT sensor_set, sensor, frame_idx, CASE WHEN count(*)=8 THEN sum(u*weight) END AS u, CASE WHEN count(*)=8 THEN sum(v*weight) END AS v, CASE WHEN count(*)=8 THEN sum(w*weight) END AS w
  FROM ({TIMED}) JOIN c USING (kz,ky,kx) GROUP BY ALL), l AS (SELECT *, sqrt(u*u+v*v+w*w) AS vel FROM s)
SELECT sensor_set, sensor, frame_idx, 'u' AS var, round(u,6) AS value FROM l UNION ALL SELECT sensor_set, sensor, frame_idx, 'v', round(v,6) FROM l
UNION ALL SELECT sensor_set, sensor, frame_idx, 'w', round(w,6) FROM l UNION ALL SELECT sensor_set, sensor, frame_idx, 'vel', round(vel,6) FROM l
""")
def sensor_series(spark: SparkSession, d: str) -> DataFrame:
    got = g.sensor_series(timed_grid(spark, d), axes(spark), sensors(spark), ["frame_idx"])
    return got.select("sensor_set", "sensor", "frame_idx", "var", r6("value").alias("value"))


@query(f"""
WITH p AS (SELECT i AS i, j AS j, k AS k, i*1.5-0.25 AS x, j*1.2 AS y, k*2.0+0.5 AS z FROM (SELECT unnest(range(3)) AS i), (SELECT unnest(range(3)) AS j), (SELECT unnest(range(3)) AS k)),
q AS (SELECT i, j, k, {', '.join(_weights_sql(a) for a in 'xyz')} FROM p),
c AS (SELECT i, j, k, lo_x+a AS kx, lo_y+b AS ky, lo_z+e AS kz, (CASE WHEN a=0 THEN 1-w_x ELSE w_x END)*(CASE WHEN b=0 THEN 1-w_y ELSE w_y END)*(CASE WHEN e=0 THEN 1-w_z ELSE w_z END) AS weight
      FROM q, (VALUES (0),(1)) x(a), (VALUES (0),(1)) y(b), (VALUES (0),(1)) z(e))
SELECT i, j, k, m, round(sum(u*weight),6) AS u FROM ({GRID}) JOIN c USING (kz,ky,kx) GROUP BY ALL
""")
def initial_fields(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("id")
    target = spark.range(27).select((n % 3).alias("i"), (F.floor(n / 3) % 3).alias("j"), F.floor(n / 9).alias("k"))
    target = target.withColumns({"x": F.col("i") * 1.5 - 0.25, "y": F.col("j") * 1.2, "z": F.col("k") * 2.0 + 0.5})
    got = g.initial_fields(grid(spark, d), axes(spark), target, ["u"], ["m"])
    return got.select("i", "j", "k", "m", r6("u").alias("u"))
