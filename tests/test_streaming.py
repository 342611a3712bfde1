from meshlark.streaming import watchdog

LOG = [("a", d) for d in (1, 1, 1, 30, 1, 30, 1, 1)] + [("b", d) for d in (30, 1, 30, 1)]


def rows():
    seen = {}
    for run, dt in LOG:
        seen[run] = seen.get(run, 0) + 1
        yield run, seen[run], float(dt)


def test_batch(spark):
    df = spark.createDataFrame(list(rows()), "run string, step long, dt double")
    assert {tuple(r) for r in watchdog.tripped(df, 20.0, patience=2, warmup=3).collect()} == {("a", 8)}
    assert {tuple(r) for r in watchdog.tripped(df, 20.0, patience=2).collect()} == {("a", 2)}


def test_stream_agrees(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    spark.createDataFrame(list(rows()), "run string, step long, dt double").coalesce(1).write.mode("append").parquet(str(source))
    stream = spark.readStream.schema("run string, step long, dt double").parquet(str(source))
    q = watchdog.watch(stream, 20.0, patience=2, warmup=3).writeStream.format("memory").queryName("trips").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert {tuple(r) for r in spark.table("trips").collect()} == {("a", 8)}


def test_log_lines(spark):
    df = spark.createDataFrame([("step 1 dt: 0.25 ok",), ("no step",), ("dt = 1e-3",)], "value string")
    assert sorted(r.dt for r in watchdog.parse_log(df).collect()) == [0.001, 0.25]
