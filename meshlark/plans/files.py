"""Queries that write tables and texts to the shared folder and read them back, or make and parse texts."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshlark.operators import ensemble, geometry, sweep
from meshlark.plans.bindings import GRID, RUNS, SERIES, TIMED, big, grid, r6, runs, series, timed_grid
from meshlark.plans.dynamics import BOX_SQL, _boxes, _tagged
from meshlark.plans.registry import query
from meshlark.sources import states as io
from meshlark.streaming.watchdog import parse_log

CELL = ["kz", "ky", "kx"]


def _folder(spark: SparkSession, name: str) -> str:
    return f"{io.shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


# States


@query(f"SELECT kz, ky, kx, m, round(u,6) AS u FROM ({GRID})")
def member_files(spark: SparkSession, d: str) -> DataFrame:
    """One file for each member, members by the numbers in the files' names."""
    folder = _folder(spark, "members")
    io.write_state_files(grid(spark, d).select(*CELL, "m", "u"), folder)
    return io.read_state_files(spark, folder).select(*CELL, "m", r6("u").alias("u"))


@query(f"SELECT kz, ky, kx, m, round(u,6) AS u FROM ({GRID}) WHERE m=3")
def member_scan(spark: SparkSession, d: str) -> DataFrame:
    """An ensemble by folders of members, of which one is read."""
    folder = _folder(spark, "ensemble")
    io.write_states(grid(spark, d).select(*CELL, "m", "u"), folder)
    return io.read_member(spark, folder, 3).select(*CELL, big("m").alias("m"), r6("u").alias("u"))


@query(f"WITH s AS ({GRID}), c AS (SELECT DISTINCT kz, ky, kx FROM s) SELECT kz, ky, kx, m, round(u,6) AS u FROM (SELECT * FROM c, (SELECT unnest(range(8)) AS m)) LEFT JOIN s USING (kz, ky, kx, m)")
def stacked_members(spark: SparkSession, d: str) -> DataFrame:
    """Members that come one by one, on the same cells, as an ensemble."""
    s = grid(spark, d).select(*CELL, "m", "u")
    cells = s.select(*CELL).distinct()
    each = {k: cells.join(s.where(F.col("m") == k).drop("m"), CELL, "left") for k in range(8)}
    return ensemble.union_members(each, CELL).select(*CELL, "m", r6("u").alias("u"))


@query(f"SELECT kz, ky, kx, esmda_step, round(u*(1+esmda_step),6) AS u FROM ({TIMED}), (SELECT unnest(range(3)) AS esmda_step) WHERE frame_idx=0")
def stacked_steps(spark: SparkSession, d: str) -> DataFrame:
    first = timed_grid(spark, d).where("frame_idx = 0").select(*CELL, "u")
    return ensemble.union_steps([first.withColumn("u", F.col("u") * (1 + k)) for k in range(3)]).select(*CELL, "esmda_step", r6("u").alias("u"))


@query(f"SELECT param, m, k, CAST((k-1)//10 AS BIGINT) AS win, round(x,6) AS x FROM ({SERIES})")
def appended_windows(spark: SparkSession, d: str) -> DataFrame:
    """Windows appended one after the other to a stored series."""
    folder, s = _folder(spark, "windows"), series(spark, d)
    for w in range(4):
        io.append_window(s.where(F.floor((F.col("k") - 1) / 10) == w), folder, w)
    return spark.read.parquet(folder).select("param", "m", "k", big("window").alias("win"), r6("x").alias("x"))


# Metrics and summaries


@query(f"SELECT param, k, round(avg(x),4) AS mean FROM ({SERIES}) GROUP BY ALL")
def metrics_csv(spark: SparkSession, d: str) -> DataFrame:
    folder = _folder(spark, "metrics")
    io.write_metrics(sweep.trajectories(series(spark, d), ["param", "k"], "x").select("param", "k", F.round("mean", 4).alias("mean")), folder)
    return spark.read.schema("param string, k long, mean double").option("header", True).csv(folder)


_COUNTS = f"SELECT param, count(*) AS cells, min(k) AS first, max(k) AS last FROM ({SERIES}) GROUP BY param"


@query(f"SELECT 'param: ' || param || chr(10) || 'cells: ' || cells || chr(10) || 'days:' || chr(10) || '  first: ' || first || chr(10) || '  last: ' || last || chr(10) || '  gap: null' AS value FROM ({_COUNTS})")
def summary_yaml(spark: SparkSession, d: str) -> DataFrame:
    s = series(spark, d).groupBy("param").agg(F.count(F.lit(1)).alias("cells"), F.struct(F.min("k").alias("first"), F.max("k").alias("last"), F.lit(None).cast("long").alias("gap")).alias("days"))
    return io.summary_yaml(s)


@query(f"SELECT value->>'$.param' AS param, CAST(value->>'$.cells' AS BIGINT) AS cells FROM (SELECT to_json(struct_pack(param := param, cells := cells)) AS value FROM ({_COUNTS}))")
def summary_json(spark: SparkSession, d: str) -> DataFrame:
    s = series(spark, d).groupBy("param").agg(F.count(F.lit(1)).alias("cells"))
    return io.summary_json(s).select(F.get_json_object("value", "$.param").alias("param"), F.get_json_object("value", "$.cells").cast("long").alias("cells"))


#: A run's files by its number: every run has a summary, most have metrics, of which some are broken: fixed values.
_BROKEN, _WITHOUT = "r%7=0", "r%5=0"


def _summaries(spark: SparkSession, d: str) -> DataFrame:
    s = runs(spark, d).select(F.col("run_id").alias("r"), F.col("tag").alias("run"), F.col("metric"))
    good = F.format_string("# metrics\nstate_metrics:\n  rmse: %s\n  steps:\n  - 1\n  - 2\n", F.col("metric").cast("string"))
    broken = F.col("r") % 7 == 0
    metrics = s.where("r % 5 <> 0").select("run", F.lit("metrics.yaml").alias("file"), F.when(broken, F.lit("state_metrics\n  rmse")).otherwise(good).alias("text"))
    other = s.select("run", F.lit("run_summary.json").alias("file"), F.format_string('{"state_metrics": {"rmse": %s}}', (F.col("metric") + 1).cast("string")).alias("text"))
    return metrics.unionByName(other)


@query(f"SELECT run, min(rmse) AS rmse FROM (SELECT tag AS run, CASE WHEN {_WITHOUT} OR {_BROKEN} THEN metric+1 ELSE metric END AS rmse FROM (SELECT run_id AS r, * FROM ({RUNS}))) GROUP BY run HAVING count(*)=1")
def load_runs(spark: SparkSession, d: str) -> DataFrame:
    """Each run's metrics, or its summary where these are missing or broken; runs whose names are not their own are left out."""
    files = _summaries(spark, d)
    own = files.where("file = 'run_summary.json'").groupBy("run").count().where("count = 1").select("run")
    found, _ = io.pick_summaries(files.join(own, "run"))
    return sweep.flatten_summary(found, "summary", {"rmse": ("state_metrics", "rmse")}).select("run", "rmse")


@query(f"SELECT tag AS run, 'metrics.yaml' AS file, 'skipped metrics.yaml of ' || tag || ': unreadable' AS message FROM (SELECT run_id AS r, * FROM ({RUNS})) WHERE NOT {_WITHOUT} AND {_BROKEN}")
def skipped_runs(spark: SparkSession, d: str) -> DataFrame:
    return io.pick_summaries(_summaries(spark, d))[1]


@query(f"""
SELECT run_id, CASE WHEN run_id%4=1 THEN run_id ELSE nx END AS nx, CASE WHEN run_id%4=1 THEN 16 ELSE ensemble_size END AS ensemble_size, CASE WHEN run_id%4=1 THEN run_id || 'x20x4' ELSE nx || 'x' || ny || 'x' || nz END AS grid
FROM (SELECT run_id, CAST(regexp_extract(tag, '_nx(\\d+)', 1) AS BIGINT) AS nx, CAST(regexp_extract(tag, '_ny(\\d+)', 1) AS BIGINT) AS ny, CAST(regexp_extract(tag, '_nz(\\d+)', 1) AS BIGINT) AS nz, CAST(regexp_extract(tag, '_ens(\\d+)', 1) AS BIGINT) AS ensemble_size FROM ({RUNS}))
""")
def run_settings(spark: SparkSession, d: str) -> DataFrame:
    """Settings out of the summary where a run's name does not spell them."""
    r = runs(spark, d)
    plain = F.col("run_id") % 4 == 1
    named = r.withColumn("tag", F.when(plain, F.concat(F.lit("run_"), "run_id")).otherwise(F.col("tag")))
    named = named.withColumn("summary", F.format_string('{"configuration": {"nx": %d, "ny": 20, "nz": 4, "ensemble_size": 16}}', "run_id"))
    paths = {c: ("configuration", c) for c in ("nx", "ny", "nz", "ensemble_size")}
    return sweep.fill_settings(sweep.parse_tags(named), "summary", paths).select("run_id", "nx", "ensemble_size", "grid")


@query(f"SELECT run_id, tag, rank() OVER (ORDER BY model, cells, ens, steps)-1 AS position FROM (SELECT run_id, tag, regexp_extract(tag, '^(m\\d)_', 1) AS model, CAST(regexp_extract(tag, '_nx(\\d+)', 1) AS BIGINT)*CAST(regexp_extract(tag, '_ny(\\d+)', 1) AS BIGINT)*16 AS cells, CAST(regexp_extract(tag, '_ens(\\d+)', 1) AS BIGINT) AS ens, CAST(regexp_extract(tag, '_steps(\\d+)', 1) AS BIGINT) AS steps FROM ({RUNS}))")
def sorted_runs(spark: SparkSession, d: str) -> DataFrame:
    return sweep.sort_runs(_tagged(spark, d), "position").select("run_id", "tag", "position")


@query(f"SELECT run_id, tag FROM ({RUNS}) WHERE tag LIKE 'm1\\_%' ESCAPE '\\' OR tag LIKE 'm3\\_%' ESCAPE '\\'")
def runs_of_models(spark: SparkSession, d: str) -> DataFrame:
    return sweep.of_models(runs(spark, d), ["m1", "m3"], "tag").select("run_id", "tag")


# Obstacles, schedules, drivers

_SOLID = f"SELECT kz, ky, kx FROM ({GRID}) GROUP BY ALL HAVING avg(u)>25.5"


@query(f"SELECT kz, ky, kx, CAST(s.kz IS NOT NULL AS BIGINT) AS blanking FROM (SELECT DISTINCT kz, ky, kx FROM ({GRID})) LEFT JOIN (SELECT * FROM ({_SOLID})) s USING (kz, ky, kx)".replace("s.kz IS NOT NULL", "s.hit IS NOT NULL").replace("SELECT * FROM (SELECT kz", "SELECT *, 1 AS hit FROM (SELECT kz"))
def obstacle_list(spark: SparkSession, d: str) -> DataFrame:
    """Solid cells as a text list, read back as a mask of all cells."""
    folder, s = _folder(spark, "obstacles"), grid(spark, d)
    solid = s.groupBy(*CELL).agg(F.avg("u").alias("u")).where("u > 25.5")
    lines = solid.select(F.lit(1).alias("o"), F.format_string("%d  %d %d", F.col("kx") + 1, F.col("ky") + 1, F.col("kz") + 1).alias("value"))
    head = spark.createDataFrame([(0, "# i j k")], "o int, value string")
    lines.unionByName(head).coalesce(1).sortWithinPartitions("o").select("value").write.text(folder)
    return io.obstacle_mask(io.read_obstacles(spark, folder), s.select(*CELL).distinct(), {"z": 7, "y": 4, "x": 5}).select(*CELL, "blanking")


@query(f"SELECT frame_idx, string_agg(printf('%.6f  %.6f', kz+0.5, n::DOUBLE), chr(10) ORDER BY kz) AS block FROM (SELECT frame_idx, kz, sum(floor(u)) AS n FROM ({TIMED}) GROUP BY ALL) GROUP BY frame_idx")
def nudging_blocks(spark: SparkSession, d: str) -> DataFrame:
    levels = timed_grid(spark, d).groupBy("frame_idx", "kz").agg(F.sum(F.floor("u")).cast("double").alias("n"))
    return io.profile_block(levels.withColumn("z", F.col("kz") + 0.5), ["frame_idx"], ["z", "n"]).select("frame_idx", "block")


@query(f"SELECT CASE WHEN kx=0 THEN 'west' ELSE 'east' END AS side, time, ky, kz, round(CASE WHEN u>26 THEN -9999.0 ELSE u END,6) AS u FROM ({TIMED}) WHERE kx IN (0, 4)")
def driver_file(spark: SparkSession, d: str) -> DataFrame:
    """Boundary planes with missing values, written with finite ones for them."""
    folder = _folder(spark, "driver")
    planes = timed_grid(spark, d).where("kx in (0, 4)").withColumn("side", F.when(F.col("kx") == 0, "west").otherwise("east"))
    io.write_driver(planes.select("side", "time", "ky", "kz", F.when(F.col("u") > 26, F.lit(float("nan"))).otherwise(F.col("u")).alias("u")), folder)
    return spark.read.parquet(folder).select("side", "time", "ky", "kz", r6("u").alias("u"))


@query(f"SELECT m AS sample, kz, ky, kx, round(u,6) AS u, round(m*0.5,6) AS speed FROM ({GRID}) WHERE m<5".replace("m*0.5", "m*0.5::DOUBLE"))
def training_samples(spark: SparkSession, d: str) -> DataFrame:
    """States and parameters by split and sample, stored, checked and put together."""
    folder, sizes = _folder(spark, "training"), {"train": 5, "val": 2, "test": 1}
    states = ensemble.split_samples(grid(spark, d).withColumnRenamed("m", "sample"), sizes)
    params = ensemble.split_samples(spark.range(8).select(F.col("id").alias("sample"), (F.col("id") * 0.5).alias("speed")), sizes)
    for kind, rows in (("state", states.select("split", "sample", *CELL, "u")), ("param", params.select("split", "sample", "speed"))):
        io.write_states(rows, f"{folder}/{kind}", by=["split"])
    got = io.zip_samples(*io.load_samples(spark, folder, "train", ["speed"]), ["speed"])
    return got.select("sample", *CELL, r6("u").alias("u"), r6("speed").alias("speed"))


_RESTARTS = "SELECT user_id%8 AS member, ts AS modified, '/runs/restart_' || event_id || '_' || (user_id%8) || '.nc' AS path FROM events"


def _restarts(spark: SparkSession, d: str) -> DataFrame:
    from meshlark.plans.bindings import table

    member = F.col("user_id") % 8
    return table(spark, d, "events").select(member.alias("member"), F.col("ts").alias("modified"), F.concat(F.lit("/runs/restart_"), "event_id", F.lit("_"), member, F.lit(".nc")).alias("path"))


@query(f"""
WITH f AS (SELECT member, arg_max(path, (modified, path)) AS path FROM ({_RESTARTS}) GROUP BY member), s AS (SELECT * FROM (VALUES (3::BIGINT, 1::BIGINT), (7::BIGINT, 2::BIGINT)) AS s(member, donor))
SELECT a.member, b.path, regexp_replace(regexp_extract(b.path, '[^/]*$'), '_\\d+\\.nc$', '_') || a.member || '.nc' AS name FROM (SELECT a.member, coalesce(donor, a.member) AS donor FROM f a LEFT JOIN s USING (member)) a JOIN f b ON a.donor=b.member
""")
def carried_restarts(spark: SparkSession, d: str) -> DataFrame:
    """Failed members take on their donors' newest restarts, under their own names."""
    return io.carry_restarts(_restarts(spark, d), spark.createDataFrame([(3, 1), (7, 2)], "member long, donor long"))


@query(f"SELECT max_by(path, (modified, path)) AS path FROM ({_RESTARTS})")
def newest_restart(spark: SparkSession, d: str) -> DataFrame:
    files = _restarts(spark, d).withColumns({c: F.lit(n) for c, n in (("nx", 8), ("ny", 6), ("nz", 4))})
    return io.newest_matching(files, (8, 6, 4)).select("path")


@query("SELECT event_id, dt FROM (SELECT event_id, CAST(printf('%.2f', round(value, 2)) AS DOUBLE) AS dt, event_type FROM events) WHERE event_type<>'view'")
def log_lines(spark: SparkSession, d: str) -> DataFrame:
    """Time steps out of the lines of a log, of which some state none."""
    from meshlark.plans.bindings import table

    e = table(spark, d, "events")
    line = F.when(F.col("event_type") == "view", F.lit("remaining steps unknown")).otherwise(F.concat(F.lit("step done, dt: "), F.format_string("%.2f", F.round("value", 2)), F.lit(" s")))
    return parse_log(e.select("event_id", line.alias("value"))).select("event_id", "dt")


# Meshes as files

_FACES = ", ".join("(" + ", ".join([f"{n}::BIGINT", *[str(v) for corner in face for v in corner]]) + ")" for n, face in enumerate(geometry.BOX_FACES))
_CORNERS = ", ".join(f"CASE WHEN c{3 * k + i}=1 THEN {a}1 ELSE {a}0 END AS {a}{k + 1}_" for k in range(3) for i, a in enumerate("xyz"))
MESH_SQL = (
    f"SELECT box*12+face AS id, {', '.join(f'{a}{k}_ AS {a}{k}' for k in (1, 2, 3) for a in 'xyz')} FROM "
    f"(SELECT box, face, {_CORNERS} FROM ({BOX_SQL}), (VALUES {_FACES}) AS f(face, {', '.join(f'c{i}' for i in range(9))}))"
)


def box_mesh(spark: SparkSession) -> DataFrame:
    m = geometry.box_triangles(_boxes(spark))
    return m.withColumn("id", F.col("box") * 12 + F.col("face")).drop("box", "face")


@query(f"SELECT {', '.join(f'{a}{k}' for k in (1, 2, 3) for a in 'xyz')} FROM ({MESH_SQL})")
def stl_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """A mesh written as a text STL file and read back."""
    path = _folder(spark, "mesh")
    geometry.write_stl(box_mesh(spark), path)
    return geometry.read_stl(spark, path).drop("id")


_N = ", ".join(f"(({p}2-{p}1)*({q}3-{q}1)-({q}2-{q}1)*({p}3-{p}1)) AS n{a}" for a, p, q in (("x", "y", "z"), ("y", "z", "x"), ("z", "x", "y")))
_VERTEX = " || chr(10) || ".join(f"printf('vertex %.6f %.6f %.6f', x{k}, y{k}, z{k})" for k in (1, 2, 3))


@query(f"""
SELECT id, printf('facet normal %.6f %.6f %.6f', nx/s+0.0, ny/s+0.0, nz/s+0.0) || chr(10) || 'outer loop' || chr(10) || {_VERTEX} || chr(10) || 'endloop' || chr(10) || 'endfacet' AS text
FROM (SELECT *, sqrt(nx*nx+ny*ny+nz*nz) AS s FROM (SELECT *, {_N} FROM ({MESH_SQL})))
""")
def stl_facets(spark: SparkSession, d: str) -> DataFrame:
    return geometry.stl_text(box_mesh(spark)).select("id", "text")


@query(f"""
WITH c AS (SELECT i, j, i+0.5 AS x, j+0.5 AS y FROM (SELECT unnest(range(5)) AS i), (SELECT unnest(range(4)) AS j)),
h AS (SELECT i, j, CAST(coalesce(max(z1),0) AS DOUBLE) AS height FROM c LEFT JOIN ({BOX_SQL}) b ON x BETWEEN x0 AND x1 AND y BETWEEN y0 AND y1 GROUP BY ALL)
SELECT j, string_agg(printf('%.3f', height), ' ' ORDER BY i) AS line FROM h GROUP BY j
""")
def heights_text(spark: SparkSession, d: str) -> DataFrame:
    xs = spark.range(5).select(F.col("id").alias("i"), (F.col("id") + 0.5).alias("x"))
    ys = spark.range(4).select(F.col("id").alias("j"), (F.col("id") + 0.5).alias("y"))
    return geometry.raster_lines(geometry.height_raster(box_mesh(spark), xs, ys)).select("j", "line")
