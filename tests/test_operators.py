"""Operators by themselves: values worked out by hand, errors, and what SQL does not cover."""

import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from meshlark.functions import scalar
from meshlark.functions.noise import with_noise
from meshlark.operators import align, assim, ensemble, geometry, grid, priors, scores, sweep, temporal
from meshlark.sources import states as io


def values(df, col, by):
    return [r[0] for r in df.orderBy(by).select(col).collect()]


# Time


def frames(spark, times):
    return spark.createDataFrame([(i, float(t), 0, 0, 0, float(t)) for i, t in enumerate(times)], "frame_idx long, time double, kz long, ky long, kx long, u double")


@pytest.mark.parametrize("times, seconds, want", [(range(0, 11, 2), 4.0, [1, 5, 9]), (range(8), 4.0, [1.5, 5.5]), ((0, 2, 4, 6), 1000.0, [3.0])])
def test_interval_means(spark, times, seconds, want):
    got = temporal.reduce_intervals(frames(spark, times), seconds, "mean", ["u"], ["kz"])
    assert values(got, "u", "bin") == want


def test_interval_numbers_skip_empty_ones(spark):
    got = temporal.reduce_intervals(frames(spark, [3, 4, 50, 51]), 2.0, "max", ["u"], ["kz"])
    assert [tuple(r) for r in got.select("bin", "u").orderBy("bin").collect()] == [(0, 4.0), (1, 50.0), (2, 51.0)]


@pytest.mark.parametrize("seconds", [0, None, -1])
def test_interval_without_length(spark, seconds):
    with pytest.raises(ValueError):
        temporal.reduce_intervals(frames(spark, [0, 1]), seconds, "mean", ["u"], ["kz"])


def test_trim_to_nothing(spark):
    with pytest.raises(ValueError):
        temporal.trim_spinup(frames(spark, [0, 1]), 5)


def test_exact_frames(spark):
    s = frames(spark, range(6))
    assert values(temporal.exact_frames(s, 2, 3, ["kz"]), "u", "frame_idx") == [3, 4, 5]
    assert values(temporal.exact_frames(s, 4, 4, ["kz"], repeat=True), "u", "frame_idx") == [4, 5, 5, 5]
    with pytest.raises(Exception, match="too few frames"):
        temporal.exact_frames(s, 4, 4, ["kz"]).collect()


def test_step_samples_stay_inside(spark):
    s = frames(spark, range(5)).withColumn("p", F.col("u") * 10)
    got = temporal.step_samples(s, 2, ["kz"], "u", ["p"]).orderBy("frame_idx").collect()
    assert [(r.u, r.target, r.p_steps) for r in got] == [(0, 2, [0, 10]), (1, 3, [10, 20]), (2, 4, [20, 30])]
    with pytest.raises(ValueError, match="no series"):
        temporal.step_samples(s, 5, ["kz"], "u", ["p"])


def test_output_steps():
    assert temporal.output_steps([0.0, 1.0, 1.2, 3.0], 1.0, 3) == [0, 1, 2, 3]
    assert temporal.output_steps([0.0, 9.0, 9.5], 1.0, 4) == [0, 4]


def test_plateau_and_stitch(spark):
    s = spark.createDataFrame([("a", 0.0, 30.0), ("a", 50.0, 45.0)], "name string, time double, angle double")
    got = temporal.prepend_plateau(s, 20.0, ["name"]).orderBy("time").collect()
    assert [(r.time, r.angle) for r in got] == [(0, 30), (20, 30), (70, 45)]
    assert temporal.prepend_plateau(s, 0.0, ["name"]).count() == 2
    w = spark.createDataFrame([(0, 5.0), (0, 6.0), (1, 1.0), (1, 2.0)], "window long, time double")
    assert values(temporal.stitch(w, 10.0), "time", "time") == [0, 1, 10, 11]


# Alignment


@settings(max_examples=15, deadline=None)
@given(st.lists(st.integers(0, 40), min_size=1, max_size=8, unique=True), st.lists(st.integers(-5, 45), min_size=1, max_size=8))
def test_lerp_is_interp(spark, known, asked):
    known = sorted(known)
    ys = [math.sin(k) for k in known]
    a = spark.createDataFrame([("p", float(t), i) for i, t in enumerate(asked)], "key string, time double, i long")
    b = spark.createDataFrame([("p", float(t), y) for t, y in zip(known, ys)], "key string, time double, y double")
    got = values(align.lerp_join(a, b, ["key"], "time", "y"), "y", "i")
    assert np.allclose(got, np.interp(asked, known, ys))
    got = values(align.lerp_join(a, b, ["key"], "time", "y", ends="extend"), "y", "i")
    if len(known) > 1:
        def line(t):
            j = min(max(int(np.searchsorted(known, t, "right")), 1), len(known) - 1)
            return ys[j - 1] + (ys[j] - ys[j - 1]) * (t - known[j - 1]) / (known[j] - known[j - 1])

        assert np.allclose(got, [line(t) for t in asked])
    got = values(align.lerp_join(a, b, ["key"], "time", "y", ends="null"), "y", "i")
    assert [g is None for g in got] == [not known[0] <= t <= known[-1] for t in asked]


def test_schedule_defaults(spark):
    a = spark.createDataFrame([("p", 1.0), ("q", 1.0)], "key string, time double")
    b = spark.createDataFrame([("p", 0.0, 7.0)], "key string, time double, y double")
    assert values(align.schedule_at(a, b, ["key"], "time", "y", default=3.0), "y", "key") == [7, 3]
    with pytest.raises(Exception, match="no schedule"):
        align.schedule_at(a, b, ["key"], "time", "y").collect()
    with pytest.raises(ValueError):
        align.lerp_join(a, b, ["key"], "time", "y", ends="other")


# Grids


def line(spark, coords, axis="x"):
    return spark.createDataFrame([(axis, i, float(c)) for i, c in enumerate(coords)], "axis string, k long, coord double")


def points(spark, xs):
    return spark.createDataFrame([(i, float(x)) for i, x in enumerate(xs)], "sensor long, x double")


def test_axis_weights(spark):
    got = grid.axis_weights(line(spark, [0, 1, 3]), points(spark, [-0.5, 0, 1, 2, 3, 3.7]), "x").orderBy("sensor").collect()
    assert [(r.lo_x, r.hi_x, round(r.w_x, 9)) for r in got] == [(0, 1, -0.5), (0, 1, 0), (1, 2, 0), (1, 2, 0.5), (1, 2, 1), (1, 2, 1.35)]


@pytest.mark.parametrize("coords, x", [([0, 1, 2], 2.6), ([0, 1, 2], -0.6), ([0, 0, 1], 0.5)])
def test_axis_errors(spark, coords, x):
    with pytest.raises(Exception, match="outside the axis"):
        grid.axis_weights(line(spark, coords), points(spark, [x]), "x").collect()


def test_trilinear_is_exact_on_linear_fields(spark):
    rng = np.random.default_rng(0)
    axes = line(spark, [0, 1, 2.5], "x").union(line(spark, [0, 2], "y")).union(line(spark, [0, 1, 2, 3], "z"))
    xs, ys, zs = [0, 1, 2.5], [0, 2], [0, 1, 2, 3]
    cells = [(k, j, i, float(1 + 2 * x + 3 * y - z)) for k, z in enumerate(zs) for j, y in enumerate(ys) for i, x in enumerate(xs)]
    state = spark.createDataFrame(cells, "kz long, ky long, kx long, u double")
    pts = [(n, *map(float, rng.uniform([0, 0, 0], [2.5, 2, 3]))) for n in range(8)]
    p = spark.createDataFrame(pts, "sensor long, x double, y double, z double")
    got = values(grid.interpolate_at(state, grid.corner_weights(axes, p), ["u"], ["sensor"]), "u", "sensor")
    assert np.allclose(got, [1 + 2 * x + 3 * y - z for _, x, y, z in pts])
    holes = state.where("not (kz = 0 and ky = 0 and kx = 0)")
    assert None in values(grid.interpolate_at(holes, grid.corner_weights(axes, spark.createDataFrame([(0, 0.1, 0.1, 0.1)], "sensor long, x double, y double, z double")), ["u"], ["sensor"]), "u", "sensor")


def test_names_and_levels():
    assert grid.resolve_axis(["zt", "yt", "xm"], "x") == "xm" and grid.resolve_axis(["x", "xm"], "x") == "x"
    with pytest.raises(ValueError):
        grid.resolve_axis(["y"], "x")
    assert grid.spread_levels(16, 4) == [0, 5, 10, 15] and grid.spread_levels(2, 4) == [0, 1]
    assert grid.spread_frames(10, 4) == [0, 3, 6, 9]
    assert grid.STAGGERING["faces"]["u"][2] == "xm"


def test_magnitude_needs_all_components(spark):
    df = spark.createDataFrame([(3.0, 4.0)], "u double, v double")
    assert grid.with_magnitude(df).columns == ["u", "v"]


# Scores


def test_crps_is_all_pairs(spark):
    rng = np.random.default_rng(1)
    x, y = rng.normal(size=(3, 7)), rng.normal(size=3)
    df = spark.createDataFrame([(k, m, float(x[k, m]), float(y[k])) for k in range(3) for m in range(7)], "k long, m long, x double, y double")
    want = [np.abs(x[k] - y[k]).mean() - np.abs(x[k][:, None] - x[k]).mean() / 2 for k in range(3)]
    assert np.allclose(values(scores.crps(df, ["k"]), "crps", "k"), want)
    one = scores.knot_metrics(df.where("m = 0"), ["k"]).orderBy("k").collect()
    assert [r.spread for r in one] == [0, 0, 0] and np.allclose([r.crps for r in one], np.abs(x[:, 0] - y))


def test_series_stats_final(spark):
    df = spark.createDataFrame([("a", 0, 1.0), ("a", 1, 3.0), ("a", 2, float("nan")), ("b", 0, float("inf"))], "s string, k long, v double")
    got = {r.s: (r.mean, r.final, r.max, r.min) for r in scores.series_stats(df, ["s"], "v", "k").collect()}
    assert got == {"a": (2.0, None, 3.0, 1.0), "b": (None, None, None, None)}


def test_compare_counts_missing_as_equal(spark):
    a = spark.createDataFrame([(0, 1.0), (1, None), (2, 2.0), (3, 4.0)], "k long, v double")
    b = spark.createDataFrame([(0, 1.0), (1, None), (2, 2.5)], "k long, v double")
    r = scores.compare(a, b, ["k"], "v").first()
    assert (r.differing, r.most, r.cells) == (2, 0.5, 4)


# Assimilation


def problem(spark, n=24, rows=5, obs=3, seed=0):
    rng = np.random.default_rng(seed)
    a = rng.normal(size=(rows, n))
    h = rng.normal(size=(obs, rows))
    d = h @ a + 0.1 * rng.normal(size=(obs, n))
    y, z, s = rng.normal(size=obs), rng.normal(size=(obs, n)), np.array([0.2, 0.4, 0.3])[:obs]
    long = lambda m, name: spark.createDataFrame([(i, j, float(m[i, j])) for i in range(m.shape[0]) for j in range(n)], f"{name} long, member long, value double")
    observed = spark.createDataFrame([(i, float(y[i]), float(s[i])) for i in range(obs)], "obs_id long, value double, sigma double")
    return (a, d, y, z, s), (long(a, "row_id"), long(d, "obs_id"), observed, long(z, "obs_id").withColumnRenamed("value", "z"))


def matrix(df):
    return df.toPandas().pivot(index="row_id", columns="member", values="value").to_numpy()


def update(a, d, y, z, s, alpha):
    n = a.shape[1]
    da, dd = a - a.mean(1, keepdims=True), d - d.mean(1, keepdims=True)
    x = np.linalg.solve(dd @ dd.T / (n - 1) + alpha * np.diag(s**2), y[:, None] + np.sqrt(alpha) * s[:, None] * z - d)
    return a + da @ dd.T / (n - 1) @ x


def test_global_update(spark):
    raw, tables = problem(spark)
    assert np.allclose(matrix(assim.esmda_update(*tables, 3.0)), update(*raw, 3.0))


def test_local_update(spark):
    raw, tables = problem(spark)
    a, d, y, z, s = raw
    none = spark.createDataFrame([(r, o, 1.0) for r in range(5) for o in range(3)], "row_id long, obs_id long, inflation double")
    assert np.allclose(matrix(assim.esmda_update(*tables, 3.0, inflation=none)), update(*raw, 3.0))
    some = none.where("row_id <> 2").withColumn("inflation", F.when((F.col("row_id") == 0) & (F.col("obs_id") == 1), None).when(F.col("obs_id") == 2, 2.0).otherwise(1.0))
    got = matrix(assim.esmda_update(*tables, 3.0, inflation=some))
    assert np.allclose(got[2], a[2])
    on, e = np.array([True, False, True]), np.array([1.0, 2.0])
    want = update(a, d[on], y[on], z[on], s[on] * e, 3.0)
    assert np.allclose(got[0], want[0])
    assert np.allclose(got[3], update(a, d, y, z, s * np.array([1, 1, 2.0]), 3.0)[3])


def test_correlation_of_constants_is_zero(spark):
    rows = spark.createDataFrame([(0, m, 1.0) for m in range(5)] + [(1, m, float(m)) for m in range(5)], "row_id long, member long, value double")
    obs = spark.createDataFrame([(0, m, float(2 * m)) for m in range(5)], "obs_id long, member long, value double")
    assert np.allclose(values(assim.correlation(rows, obs), "corr", "row_id"), [0, 1])


def test_taper(spark):
    df = spark.createDataFrame([(x,) for x in (0.0, 10.0, 25.0, 25.1)], "d double")
    got = values(df.select("d", scalar.taper_inflation(F.col("d"), 25.0, 0.5, 4.0).alias("t")), "t", "d")
    assert got[:2] == [1, 1] and math.isclose(got[2], 4.0) and got[3] is None
    assert values(df.select("d", scalar.taper_inflation(F.col("d"), 25.0, 0.5, 1.0).alias("t")), "t", "d") == [1, 1, 1, None]
    assert values(df.select("d", scalar.taper_inflation(F.col("d"), 25.0, 1.0, 4.0).alias("t")), "t", "d")[:3] == [1, 1, 1]


def test_distance_pairs_are_those_within(spark):
    rng = np.random.default_rng(4)
    r, o = rng.uniform(0, 20, (60, 3)), rng.uniform(0, 20, (9, 3))
    rows = spark.createDataFrame([(i, *map(float, x)) for i, x in enumerate(r)], "row_id long, x double, y double, z double")
    sites = spark.createDataFrame([(i, *map(float, x)) for i, x in enumerate(o)], "obs_id long, x double, y double, z double")
    for horizontal, axes in ((False, 3), (True, 2)):
        d = np.sqrt(((r[:, None, :axes] - o[None, :, :axes]) ** 2).sum(-1))
        got = {(x.row_id, x.obs_id) for x in assim.distance_inflation(rows, sites, 5.0, 0.5, 4.0, horizontal=horizontal).collect()}
        assert got == {(i, j) for i, j in zip(*np.nonzero(d <= 5))}


def test_flatten_and_back(spark):
    s = spark.createDataFrame([(0, k, m, float(k + m), float(k - m)) for k in range(3) for m in range(2)], "kz long, kx long, m long, v double, u double")
    flat = assim.flatten_state(s, ["v", "u"], ["kz", "kx"])
    assert sorted({(r.row_id, r.name) for r in flat.collect()}) == [(0, "u"), (1, "u"), (2, "u"), (3, "v"), (4, "v"), (5, "v")]
    back = assim.unflatten_state(flat, ["kz", "kx"]).select(s.columns)
    assert sorted(back.collect()) == sorted(s.collect())


def test_analysis_loop_and_windows(spark):
    spark.sparkContext.setCheckpointDir(spark.sparkContext.getConf().get("spark.checkpoint.dir"))
    rng = np.random.default_rng(0)
    prior = spark.createDataFrame([(0, m, float(x)) for m, x in enumerate(rng.normal(0, 2, 40))], "row_id long, member long, value double")
    observed = spark.createDataFrame([(0, 3.0, 0.1)], "obs_id long, value double, sigma double")
    forecast = lambda a: a.select(F.col("row_id").alias("obs_id"), "member", "value")
    noise = lambda k, p: with_noise(p.withColumn("id", F.col("member") + 1000 * k), "id", normal="z").select("obs_id", "member", "z")
    last, history = assim.analysis(prior, forecast, observed, noise, 3)
    assert len(history) == 4 and abs(np.mean(values(last, "value", "member")) - 3) < 0.1
    wins, state = assim.run_windows(
        prior,
        spark.createDataFrame([(0, 0.0)], "row_id long, shift double"),
        spark.createDataFrame([(w, 0, 3.0 + w) for w in range(2)], "window long, obs_id long, value double"),
        2,
        lambda a, s: a.join(s, "row_id").select(F.col("row_id").alias("obs_id"), "member", (F.col("value") + F.col("shift")).alias("value")),
        lambda w: spark.createDataFrame([(0, 0.0)], "obs_id long, z double"),
        lambda w, k, p: noise(k + 10 * w, p),
        0.1,
        2,
        warm_start=lambda post, s: s.withColumn("shift", F.col("shift") + 1),
        next_prior=lambda post, w: prior,
    )
    means = {r["window"]: r["a"] for r in wins.groupBy("window").agg(F.avg("value").alias("a")).collect()}
    # The second window's state is one higher, and so is what is seen.
    assert abs(means[0] - 3) < 0.1 and abs(means[1] - 3) < 0.1 and state.first()["shift"] == 2


def test_update_of_rows_that_lack_members(spark):
    rng = np.random.default_rng(1)
    full, seen = rng.normal(size=(3, 8)), rng.normal(size=(2, 8))
    lost = {(0, 3), (1, 0), (1, 7)} | {(2, m) for m in range(1, 8)}
    aug = spark.createDataFrame([(r, m, float(full[r, m])) for r in range(3) for m in range(8) if (r, m) not in lost], "row_id long, member long, value double")
    pred = spark.createDataFrame([(o, m, float(seen[o, m])) for o in range(2) for m in range(8)], "obs_id long, member long, value double")
    obs = spark.createDataFrame([(0, 0.4, 0.5), (1, -0.2, 0.5)], "obs_id long, value double, sigma double")
    z = rng.normal(size=(2, 8))
    noise = spark.createDataFrame([(o, m, float(z[o, m])) for o in range(2) for m in range(8)], "obs_id long, member long, z double")
    got = {(r.row_id, r.member): r.value for r in assim.esmda_update(aug, pred, obs, noise, 2.0).collect()}
    assert set(got) == {(r, m) for r in range(3) for m in range(8)} - lost
    x = np.linalg.solve(np.cov(seen) + 2 * 0.25 * np.eye(2), np.array([[0.4], [-0.2]]) + np.sqrt(2) * 0.5 * z - seen)
    for r in range(3):
        has = [m for m in range(8) if (r, m) not in lost]
        c = np.array([np.cov(full[r, has], seen[o, has])[0, 1] if len(has) > 1 else 0.0 for o in range(2)])
        assert np.allclose([got[r, m] for m in has], full[r, has] + (c @ x)[has])
    with pytest.raises(Exception, match="no prediction for member"):
        assim.esmda_update(aug.withColumn("member", F.col("member") + 1), pred, obs, noise, 2.0).collect()


def test_covariances_of_common_members(spark):
    rows = spark.createDataFrame([(0, 0, 1.0), (0, 1, 2.0), (0, 2, 4.0), (1, 0, 5.0), (1, 9, 1.0), (2, 9, 1.0)], "row_id long, member long, value double")
    obs = spark.createDataFrame([(7, 0, 1.0), (7, 1, 0.0), (7, 2, 5.0), (8, 1, 3.0), (8, 2, 3.0)], "obs_id long, member long, value double")
    got = {(r.row_id, r.obs_id): r.cov for r in assim.covariance(rows, obs).collect()}
    assert got[0, 7] == pytest.approx(np.cov([1, 2, 4], [1, 0, 5])[0, 1]) and got[0, 8] == 0 and got[1, 7] is None and set(got) == {(0, 7), (0, 8), (1, 7)}
    corr = {(r.row_id, r.obs_id): r.corr for r in assim.correlation(rows, obs).collect()}
    assert corr[0, 7] == pytest.approx(np.corrcoef([1, 2, 4], [1, 0, 5])[0, 1]) and corr[0, 8] == 0


def test_crps_without_missing_members(spark):
    rows = [("a", 1.0, 2.0), ("a", 3.0, 2.0)]
    want = scores.crps(spark.createDataFrame(rows, "k string, x double, y double"), ["k"]).first()["crps"]
    got = scores.crps(spark.createDataFrame([*rows, ("a", None, 2.0)], "k string, x double, y double"), ["k"]).first()["crps"]
    assert want == got == pytest.approx(0.5)


def test_grids_of_one_size_are_apart(spark):
    runs = spark.createDataFrame([("20x40x16", 32), ("20x40x16", 64), ("40x20x16", 32), ("40x20x16", 96), ("40x20x16", 96)], "grid string, ensemble_size long")
    assert tuple(sweep.pick_domain(runs).first()) == ("40x20x16", 2, 3)


def test_groups_by_base_name(spark):
    names = spark.createDataFrame([("speed_0", 0), ("speed_10", 1), ("angle", 2), ("angle_x_1", 3)], "name string, pos long")
    assert values(assim.group_numbers(names, "name", "pos"), "group_id", "pos") == [0, 0, 1, 2]


# Priors


def test_ar2_is_stationary(spark):
    n, knots = 3000, 4
    start = with_noise(with_noise(spark.range(n).withColumn("id2", F.col("id") + 10**7), "id", normal="n1"), "id2", normal="n2").select(F.col("id").alias("member"), "n1", "n2")
    steps = spark.range(n * (knots - 1)).select((F.col("id") % n).alias("member"), (F.floor(F.col("id") / n) + 1).alias("knot"), F.lit(300.0).alias("dt"), (F.col("id") + 2 * 10**7).alias("i1"), (F.col("id") + 3 * 10**7).alias("i2"))
    steps = with_noise(with_noise(steps, "i1", normal="e1"), "i2", normal="e2")
    got = priors.ar2_prior(start, steps, ["member"], 100.0, F.lit(5.0), F.lit(0.5)).groupBy("knot").agg(F.avg("value").alias("m"), F.stddev_pop("value").alias("s")).orderBy("knot").collect()
    assert all(abs(r.m - 5) < 0.05 and abs(r.s - 0.5) < 0.05 for r in got) and len(got) == knots


def test_one_knot_ends_do_not_move(spark):
    post = spark.createDataFrame([("p", m, 0.0, float(m)) for m in range(4)], "name string, member long, time double, value double")
    got = priors.window_ends(post).orderBy("member").collect()
    assert [r.w0 for r in got] == [0] * 4 and [r.z0 for r in got] == [-1.5, -0.5, 0.5, 1.5]


def test_series_that_end_early_are_about_the_mean_of_all_members(spark):
    rows = [("p", 0, 0.0, 1.0), ("p", 0, 1.0, 5.0), ("p", 1, 0.0, 2.0), ("p", 1, 1.0, 3.0), ("p", 1, 2.0, 9.0), ("p", 1, 3.0, 4.0)]
    post = spark.createDataFrame(rows, "name string, member long, time double, value double")
    first, second = priors.window_ends(post).orderBy("member").collect()
    assert (first.mu_end, first.z0, first.w0) == (4.0, 1.0, 1.5)
    assert (second.mu_end, second.z0, second.w0) == (4.0, 0.0, 0.0)


def test_hyper_parameters(spark):
    df = spark.createDataFrame([(0.25,)], "u double")
    r = df.select(priors.hyper_parameter(3, F.col("u")).alias("a"), priors.hyper_parameter({"min": 2, "max": 6}, F.col("u")).alias("b")).first()
    assert (r.a, r.b) == (3.0, 3.0)


# Ensembles


def test_failures(spark):
    status = spark.createDataFrame([(m, m not in (3, 7)) for m in range(16)], "member long, ok boolean")
    draws = with_noise(spark.range(16).withColumnRenamed("id", "member"), "member", uniform="u")
    got = {r.member: r.donor for r in ensemble.donors(status, draws).collect()}
    assert set(got) == {3, 7} and not set(got.values()) & {3, 7}
    with pytest.raises(RuntimeError):
        ensemble.donors(status, draws, policy="raise")
    with pytest.raises(RuntimeError):
        ensemble.donors(status.withColumn("ok", F.lit(False)), draws)
    states = spark.createDataFrame([(m, k, float(m)) for m in range(16) for k in range(3)], "m long, k long, u double")
    sub = spark.createDataFrame(list(got.items()), "member long, donor long")
    fixed = {r.m: r.u for r in ensemble.replace_states(states, sub).collect()}
    assert fixed == {m: float(got.get(m, m)) for m in range(16)}
    params = spark.createDataFrame([("a", m, float(m)) for m in range(16)], "name string, member long, value double")
    noise = with_noise(params.withColumn("id", F.col("member")), "id", normal="z")
    moved = {r.member: r.value for r in ensemble.replace_params(params, sub, noise, ["name"]).collect()}
    std = np.std(range(16))
    assert all(moved[m] == m for m in range(16) if m not in got)
    assert all(0 < abs(moved[m] - d) < std / 2 for m, d in got.items())
    assert ensemble.donors(status.where("ok"), draws).count() == 0


def test_unions(spark):
    a = spark.createDataFrame([(0, 1.0), (1, 2.0)], "kx long, u double")
    assert ensemble.union_members({0: a, 1: a}, ["kx"]).count() == 4
    with pytest.raises(ValueError):
        ensemble.union_members({0: a, 1: a.where("kx = 0")}, ["kx"])
    assert {r.esmda_step for r in ensemble.union_steps([a, a]).collect()} == {0, 1}


def test_levels(spark):
    lv = spark.createDataFrame([(0, k, float(k)) for k in range(4)] + [(1, k, float(k)) for k in range(3)], "m long, kz long, coord double")
    assert values(ensemble.canonical_levels(lv), "kz", "kz") == [0, 1, 2]
    with pytest.raises(Exception, match="ascend"):
        ensemble.canonical_levels(lv.withColumn("coord", -F.col("coord"))).collect()
    s = spark.createDataFrame([(k, float(k)) for k in range(4)], "kz long, u double")
    assert ensemble.fix_levels(s, ensemble.canonical_levels(lv), ["u"]).count() == 3
    with pytest.raises(Exception, match="not finite"):
        ensemble.fix_levels(s.withColumn("u", F.lit(float("nan"))), ensemble.canonical_levels(lv), ["u"]).collect()
    assert ensemble.even_members(10, 4) == [0, 3, 6, 9]


# Sweeps, geometry


def test_hold_axes_takes_the_first_of_equals(spark):
    rows = [(i, g, e, s) for i, (g, e, s) in enumerate([(1, 8, 2), (2, 8, 2), (2, 16, 3), (1, 16, 3), (3, 8, 2)])]
    df = spark.createDataFrame(rows, "run_id long, grid_cells long, ensemble_size long, esmda_steps long")
    kept, held = sweep.hold_axes(df, "ensemble_size", ["grid_cells", "ensemble_size", "esmda_steps"], "run_id")
    assert held == {"grid_cells": 1, "esmda_steps": 2} and values(kept, "run_id", "run_id") == [0]


def test_unspelled_names(spark):
    r = sweep.parse_tags(spark.createDataFrame([("other",)], "tag string")).first()
    assert r.model is None and r.grid is None and r.localization is None


def test_stl_round_trip(spark, tmp_path):
    boxes = spark.createDataFrame([(0, 0.0, 2.0, 0.0, 1.0, 0.0, 3.0)], "box long, x0 double, x1 double, y0 double, y1 double, z0 double, z1 double")
    mesh = geometry.box_triangles(boxes)
    assert mesh.count() == 12
    text = ["solid a"]
    for r in mesh.collect():
        text += ["facet normal 0 0 0", "outer loop", *[f"vertex {r[f'x{k}']} {r[f'y{k}']} {r[f'z{k}']}" for k in (1, 2, 3)], "endloop", "endfacet"]
    (tmp_path / "a.stl").write_text("\n".join([*text, "endsolid a"]))
    got = geometry.read_stl(spark, str(tmp_path / "a.stl"))
    assert got.count() == 12
    xs = spark.range(4).select(F.col("id").alias("i"), (F.col("id") + 0.5).alias("x"))
    ys = spark.range(2).select(F.col("id").alias("j"), (F.col("id") + 0.5).alias("y"))
    zs = spark.range(4).select(F.col("id").alias("k"), (F.col("id") + 0.5).alias("z"))
    assert sorted(tuple(r) for r in geometry.solid_runs(got, xs, ys, zs).collect()) == [(1, 1, 1, 3), (2, 1, 1, 3)]
    lines = geometry.raster_lines(geometry.height_raster(got, xs, ys)).collect()
    assert [r.line for r in lines] == ["0.000 0.000 0.000 0.000", "3.000 3.000 0.000 0.000"]
    doubled = geometry.clean(got.union(got))
    assert doubled.count() == 12
    assert geometry.crop(got, (5, 5), (6, 6)).count() == 0
    turned = geometry.rotate(got, 90).agg(F.min("x1"), F.max("x1")).first()
    assert np.allclose(turned, (0.5, 1.5))
    low = geometry.seat_floor(got.withColumns({f"z{k}": F.col(f"z{k}") - 1 for k in (1, 2, 3)}))
    assert low.agg(F.min(F.least("z1", "z2", "z3"))).first()[0] == 0 and low.count() == 10
    with pytest.raises(ValueError):
        geometry.solid_runs(got, xs.withColumn("x", F.col("x") + 100), ys, zs)


def test_boxes_and_tiles(spark):
    boxes = spark.createDataFrame([(0, 1.0, 3.0, 0.0, 2.0, 0.0, 1.0)], "box long, x0 double, x1 double, y0 double, y1 double, z0 double, z1 double")
    faces = line(spark, range(6), "x").union(line(spark, range(6), "y")).union(line(spark, range(6), "z"))
    got = {r.axis: (r.first, r.last) for r in geometry.box_index(boxes, faces).collect()}
    assert got == {"x": (1, 2), "y": (0, 1), "z": (0, 0)}
    tiles = geometry.tiled_boxes(spark, 3, 2, 1.0, 2.0, 1.0, 6.0, shift=1.5).collect()
    assert len(tiles) == 7 and all(0 <= t.x0 < t.x1 <= 6 for t in tiles)
    assert math.isclose(sum(t.x1 - t.x0 for t in tiles), 6.0)


def test_lattice_weights_sum_to_one(spark):
    df = spark.range(1).select(F.explode(geometry.lattice_directions()).alias("d")).select("d.*")
    assert df.count() == 27 and math.isclose(df.agg(F.sum("weight")).first()[0], 1.0)


# Functions, sources


def test_scalars(spark):
    df = spark.createDataFrame([(0.0, 0.0), (-45.0, 2.0)], "a double, s double")
    u, v = scalar.angle_to_velocity(F.col("a"), F.col("s"))
    rows = df.select(u.alias("u"), v.alias("v"), scalar.base_name(F.lit("inflow_angle_12")).alias("n")).collect()
    assert math.isclose(rows[1].u, 2**0.5) and math.isclose(rows[1].v, -(2**0.5)) and rows[0].n == "inflow_angle"
    with pytest.raises(ValueError):
        scalar.profile_shape(F.col("a"), "unknown")
    with pytest.raises(Exception, match="no level"):
        df.agg(scalar.nudged_levels(F.col("a"), 100)).collect()
    assert scalar.control_mean([1, 2, 6]) == 3 and scalar.control_mean(4) == 4
    assert df.select(scalar.control_points(2.0, F.col("a"))).first()[0] == 2


def test_state_files(spark, tmp_path):
    s = spark.createDataFrame([(0, 0.0, 1.5), (1, 1.0, 2.5)], "frame_idx long, time double, u double")
    for m in (2, 10):
        s.withColumn("u", F.col("u") + m).toPandas().to_parquet(tmp_path / f"state_{m}.parquet")
    s.toPandas().to_parquet(tmp_path / "other.parquet")
    got = io.read_state_files(spark, str(tmp_path))
    assert sorted({r.m for r in got.collect()}) == [2, 10] and got.count() == 4
    out = str(tmp_path / "ens")
    io.write_states(got, out)
    assert io.read_member(spark, out, 10).count() == 2
    plan = io.read_member(spark, out, 10)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(m" in plan
    with pytest.raises(Exception, match="(?i)exists"):
        io.write_states(got, out)
    small = io.downcast(got)
    assert dict(small.dtypes)["u"] == "float" and dict(small.dtypes)["m"] == "bigint"
    io.append_window(s, str(tmp_path / "roll"), 0)
    io.append_window(s, str(tmp_path / "roll"), 1)
    assert spark.read.parquet(str(tmp_path / "roll")).count() == 4
    assert io.newest_file(spark, str(tmp_path / "*.parquet")).count() == 1


def test_text_sources(spark, tmp_path):
    (tmp_path / "solid.txt").write_text("# i j k\n1 2 3\n2 1 1\n")
    solid = io.read_obstacles(spark, str(tmp_path / "solid.txt"))
    assert sorted(map(tuple, solid.collect())) == [(0, 0, 1), (2, 1, 0)]
    cells = spark.createDataFrame([(k, j, i) for k in range(3) for j in range(2) for i in range(2)], "kz long, ky long, kx long")
    mask = io.obstacle_mask(solid, cells, {"z": 3, "y": 2, "x": 2})
    assert mask.agg(F.sum("blanking")).first()[0] == 2
    with pytest.raises(Exception, match="off the grid"):
        io.obstacle_mask(solid, cells, {"z": 2, "y": 2, "x": 2}).collect()
    for run, text in (("a", '{"m": {"rmse": 1.5}}'), ("b", "{broken")):
        (tmp_path / run).mkdir()
        (tmp_path / run / "summary.json").write_text(text)
    got = sweep.flatten_summary(io.read_summaries(spark, str(tmp_path / "*" / "summary.json")), "summary", {"rmse": ("m", "rmse"), "none": ("x",)}).collect()
    assert [(r.run, r.rmse, r.none) for r in got] == [("a", 1.5, None)]
    io.write_metrics(spark.createDataFrame([("a", 1.0)], "k string, v double"), str(tmp_path / "csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).first().k == "a"
    assert "1.0" in io.summary_json(spark.createDataFrame([("a", 1.0)], "k string, v double")).first()[0]
    block = io.profile_block(spark.createDataFrame([(0, 1.0, 5.0), (0, 0.5, 4.0)], "t long, z double, u double"), ["t"], ["z", "u"]).first()
    assert block.block == "0.500000  4.000000\n1.000000  5.000000"
    states = spark.createDataFrame([("train", 0), ("train", 1)], "split string, sample long")
    with pytest.raises(ValueError):
        io.check_samples(states, states.where("sample = 0"), [])
    with pytest.raises(ValueError):
        io.check_samples(states, states, ["angle"])
    io.check_samples(states, states, [])


def test_small_helpers(spark):
    assert temporal.window_edges(3, 10.0)[1] == (1, 10.0, 20.0, True)
    runs = spark.createDataFrame([("one_nx1",), ("two_nx1",), ("two",)], "run string")
    assert sweep.of_models(runs, ["two"]).count() == 2 and sweep.of_models(runs, []).count() == 3
    s = spark.createDataFrame([(1.0, 2.0)], "xt double, u double")
    assert grid.to_regular(s).columns == ["x", "u"] and grid.to_regular(grid.to_regular(s)).columns == ["x", "u"]
    a = spark.createDataFrame([(0, 1.0), (1, 2.0)], "k long, u double")
    b = spark.createDataFrame([(0, 9.0, 5.0), (1, 9.0, 6.0)], "k long, u double, v double")
    assert sorted(map(tuple, ensemble.merge_positions(a, b, ["k"]).collect())) == [(0, 1.0, 5.0), (1, 2.0, 6.0)]
    p = spark.createDataFrame([(0.0, float("nan")), (1.0, 2.0)], "time double, u double")
    assert values(io.driver_planes(p), "u", "time") == [-9999.0, 2.0]
    with pytest.raises(ValueError):
        io.driver_planes(p.where("time > 0"))
    files = spark.createDataFrame([("a", 5, 1, 2, 3), ("b", 9, 1, 2, 3)], "path string, modified long, nx long, ny long, nz long")
    assert io.newest_matching(files, (1, 2, 3)).first().path == "b"
    with pytest.raises(Exception, match="another grid"):
        io.newest_matching(files, (1, 2, 4)).collect()
    clock = scores.wall_clock(spark.createDataFrame([("r", 1, 2.0), ("r", 0, 4.0)], "run string, w long, s double"), ["run"], "s", "w").first()
    assert (clock.total_seconds, clock.mean_window_seconds, clock.window_seconds) == (6.0, 3.0, [4.0, 2.0])
    boxes = spark.createDataFrame([(0, 0.0, 2.0, 0.0, 1.0, 0.0, 3.0)], "box long, x0 double, x1 double, y0 double, y1 double, z0 double, z1 double")
    mesh = geometry.box_triangles(boxes).drop("box")
    got = geometry.prepare(mesh, low=(-1, -1), high=(5, 5), origin=(1.0, 0.0, 0.0)).agg(F.min("x1"), F.max("x1")).first()
    assert np.allclose(got, (-1, 1))


def test_split_samples_and_status(spark):
    df = spark.range(4).withColumnRenamed("id", "sample")
    got = [(r.split, r.number) for r in ensemble.split_samples(df, {"train": 2, "val": 1}).orderBy("sample").collect()]
    assert got == [("train", 0), ("train", 1), ("val", 0), (None, None)]
    assert df.select(ensemble.status_column(F.lit(None).cast("boolean")).alias("ok")).first().ok is False
    params = spark.createDataFrame([(0, "a", 1.0), (1, "a", 2.0)], "member long, name string, value double")
    assert ensemble.member_params(params, 1).columns == ["name", "value"] and ensemble.member_params(params, None).count() == 2
