"""Scans and sinks of states, parameters and summaries.

Parquet is the native format: states by ``member=`` (and ``split=``) folders, so that member filters prune
partitions and frame filters reach row groups. Text formats are made of lines by built-in functions.
"""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, DoubleType, FloatType, StructType

STATE_FILE = r"state_(\d+)\.[A-Za-z0-9]+$"


def read_state_files(spark: SparkSession, folder: str, form: str = "parquet") -> DataFrame:
    """``state_<member>.*`` files of a folder as one ensemble; other files are ignored."""
    found = spark.read.format(form).option("pathGlobFilter", "state_*.*").load(folder)
    member = F.regexp_extract(F.col("_metadata.file_name"), STATE_FILE, 1)
    return found.withColumn("m", F.nullif(member, F.lit("")).cast("long")).where("m is not null")


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share, as ``spark.checkpoint.dir`` names it; one machine may do without."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not where and spark.sparkContext.master.partition("[")[0] != "local":
        raise ValueError("spark.checkpoint.dir names no folder that all executors share")
    return f"{(where or tempfile.gettempdir() + '/checkpoints').rstrip('/')}/files/{spark.sparkContext.applicationId}"


def write_state_files(states: DataFrame, folder: str, member: str = "m") -> None:
    """One file ``state_<member>.parquet`` for each member, as single-run tools want them; each is written by one task."""
    spark = states.sparkSession
    states.repartition(F.col(member)).write.mode("overwrite").partitionBy(member).parquet(f"{folder}/parts")
    jvm, conf = spark._jvm.org.apache.hadoop.fs, spark._jsc.hadoopConfiguration()
    root = jvm.Path(folder)
    fs = root.getFileSystem(conf)
    for found in fs.globStatus(jvm.Path(f"{folder}/parts/{member}=*/part-*")):
        number = found.getPath().getParent().getName().partition("=")[2]
        fs.rename(found.getPath(), jvm.Path(root, f"state_{number}.parquet"))
    fs.delete(jvm.Path(f"{folder}/parts"), True)


def read_member(spark: SparkSession, folder: str, member: int) -> DataFrame:
    """One member of a partitioned ensemble: only its folder is read."""
    return spark.read.parquet(folder).where(F.col("m") == member)


def write_states(states: DataFrame, folder: str, by: list[str] | None = None, mode: str = "errorifexists") -> None:
    """An ensemble, a folder for each member, whatever it holds written from many tasks."""
    states.write.mode(mode).partitionBy(*(by or ["m"])).parquet(folder)


def append_window(rows: DataFrame, folder: str, window: int) -> None:
    """One more window of a rollout."""
    rows.withColumn("window", F.lit(window).cast("long")).write.mode("append").partitionBy("window").parquet(folder)


def downcast(df: DataFrame) -> DataFrame:
    """Double columns in single precision, all others as they are."""
    return df.select(*[F.col(f.name).cast(FloatType()).alias(f.name) if isinstance(f.dataType, DoubleType) else F.col(f.name) for f in df.schema])


def small_state(state: DataFrame, until: float = 1000.0, keys: list[str] | None = None) -> DataFrame:
    """Velocity and coordinates of the frames from 0 to ``until`` seconds."""
    keys = keys or ["frame_idx", "time", "kz", "ky", "kx"]
    return state.select(*keys, "u", "v", "w").where(F.col("time").between(0, until))


#: Files with a run's summary, the preferred ones first: fixed values.
SUMMARY_FILES = ("metrics.json", "metrics.yaml", "run_summary.json", "run_summary.yaml")


def summary_files(spark: SparkSession, pattern: str) -> DataFrame:
    """``(run, file, text)`` of files ``<run>/<file>``."""
    path = F.split(F.col("_metadata.file_path"), "/")
    return spark.read.text(pattern, wholetext=True).select(F.element_at(path, -2).alias("run"), F.element_at(path, -1).alias("file"), F.col("value").alias("text"))


def as_json(file: Column, text: Column) -> Column:
    """A summary's text as JSON, whichever of the two formats it is in; null if it is unreadable."""
    parsed = F.when(file.endswith(".json"), text).otherwise(_yaml_json(text))
    return F.when(F.try_parse_json(parsed).isNotNull(), parsed)


def pick_summaries(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(run, summary)`` of each run's preferred file that can be read, and ``(run, file, message)`` of those that cannot."""
    names = F.array(*[F.lit(n) for n in SUMMARY_FILES])
    # Files of other names come after those that are listed.
    known = files.withColumn("__at", F.coalesce(F.nullif(F.array_position(names, F.col("file")), F.lit(0)), F.lit(len(SUMMARY_FILES) + 1))).withColumn("summary", as_json(F.col("file"), F.col("text")))
    best = known.where("summary is not null").groupBy("run").agg(F.min_by("summary", "__at").alias("summary"))
    return best, known.where("summary is null").select("run", "file", F.format_string("skipped %s of %s: unreadable", "file", "run").alias("message"))


def read_summaries(spark: SparkSession, pattern: str) -> DataFrame:
    """``(run, summary)`` of the summaries below a folder; unreadable ones are left out (:func:`pick_summaries` tells which)."""
    return pick_summaries(summary_files(spark, pattern))[0]


def parse_yaml(text: str) -> dict | None:
    """The maps, lists of scalars and scalars of a block-style YAML text; None if it is not one."""
    lines = [(len(x) - len(x.lstrip()), x.strip()) for x in text.splitlines() if x.strip() and not x.strip().startswith("#") and x.strip() != "---"]

    def block(at: int, depth: int):
        if lines[at][1].startswith("- "):
            out: list | dict = []
            while at < len(lines) and lines[at][0] == depth and lines[at][1].startswith("- "):
                out.append(scalar(lines[at][1][2:]))
                at += 1
            return out, at
        out = {}
        while at < len(lines) and lines[at][0] == depth:
            key, colon, rest = lines[at][1].partition(":")
            if not colon:
                raise ValueError(lines[at][1])
            at += 1
            if rest.strip():
                out[scalar(key)] = scalar(rest)
            elif at < len(lines) and (lines[at][0] > depth or lines[at][0] == depth and lines[at][1].startswith("- ")):
                out[scalar(key)], at = block(at, lines[at][0])
            else:
                out[scalar(key)] = None
        return out, at

    def scalar(raw: str):
        raw = raw.strip()
        if raw[:1] in "'\"" and raw[-1:] == raw[:1] and len(raw) > 1:
            return raw[1:-1]
        named = {"null": None, "~": None, "true": True, "false": False, ".nan": None, "[]": [], "{}": {}}
        if raw in named:
            return named[raw]
        for kind in (int, float):
            try:
                return kind(raw)
            except ValueError:
                pass
        return raw

    try:
        out, at = block(0, lines[0][0]) if lines else ({}, 0)
    except ValueError:
        return None
    return out if isinstance(out, dict) and at == len(lines) else None


def _yaml_json(text: Column) -> Column:
    @F.pandas_udf("string")
    def convert(texts):
        import json

        import pandas as pd

        got = [None if t is None else parse_yaml(t) for t in texts]
        return pd.Series([None if g is None else json.dumps(g) for g in got], dtype=object)

    return convert(text)


def yaml_text(kind: DataType, value: Column, depth: int = 0) -> Column:
    """A struct as block-style YAML: a line for each scalar, nested structs indented by two blanks; numbers as JSON has them."""
    lines = []
    for f in kind.fields:
        head = " " * 2 * depth + f.name + ":"
        if isinstance(f.dataType, StructType):
            lines += [F.lit(head), yaml_text(f.dataType, value[f.name], depth + 1)]
        else:
            shown = value[f.name].cast("string")
            lines.append(F.concat(F.lit(head + " "), F.coalesce(shown, F.lit("null"))))
    return F.concat_ws("\n", *lines)


def summary_yaml(rows: DataFrame) -> DataFrame:
    """Rows as YAML texts."""
    return rows.select(yaml_text(rows.schema, F.struct(*rows.columns)).alias("value"))


def write_metrics(rows: DataFrame, folder: str) -> None:
    """Long metrics as CSV with a header."""
    rows.write.mode("overwrite").option("header", True).csv(folder)


def summary_json(row: DataFrame) -> DataFrame:
    """Rows as JSON text."""
    return row.select(F.to_json(F.struct(*row.columns)).alias("value"))


def read_obstacles(spark: SparkSession, path: str) -> DataFrame:
    """``(kz, ky, kx)`` of a text list of solid cells ``i j k`` from 1, after one header line; another line is an error."""
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", r"\r?\n")).alias("n", "line"))
    lines = lines.where((F.col("n") > 0) & (F.trim("line") != ""))
    parts = F.split(F.trim("line"), r"\s+")
    bad = F.raise_error(F.concat(F.lit("not three cell numbers: "), F.col("line"))).cast("long")
    good = F.col("line").rlike(r"^\s*\d+\s+\d+\s+\d+\s*$")
    return lines.select(*[F.when(good, F.try_element_at(parts, F.lit(n)).try_cast("long") - 1).otherwise(bad).alias(k) for n, k in ((3, "kz"), (2, "ky"), (1, "kx"))])


def obstacle_mask(solid: DataFrame, cells: DataFrame, sizes: dict[str, int]) -> DataFrame:
    """``cells(kz, ky, kx)`` with ``blanking``; a solid cell off the grid is an error."""
    off = F.lit(False)
    for axis, n in sizes.items():
        off = off | ~F.col(f"k{axis}").between(0, n - 1)
    checked = solid.withColumn("blanking", F.when(off, F.raise_error(F.lit("a solid cell is off the grid")).cast("long")).otherwise(F.lit(1).cast("long")))
    return cells.join(checked.distinct(), ["kz", "ky", "kx"], "left").withColumn("blanking", F.coalesce("blanking", F.lit(0).cast("long")))


def newest_file(spark: SparkSession, pattern: str) -> DataFrame:
    """``(path, modificationTime)`` of the file written last, whatever its number."""
    files = spark.read.format("binaryFile").load(pattern).select("path", "modificationTime")
    return files.agg(F.max(F.struct("modificationTime", "path")).alias("f")).select("f.path", "f.modificationTime")


def schedule_lines(schedule: DataFrame) -> DataFrame:
    """An inflow schedule as lines ``time speed angle``, six decimals."""
    return schedule.withColumn("line", F.format_string("%.6f  %.6f  %.6f", "time", "speed", "angle"))


def profile_block(levels: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """One block for each time: a line for it, then a line for each level in order."""
    line: Column = F.format_string("  ".join(["%.6f"] * len(values)), *values)
    lines = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("z", line.alias("line")))), lambda s: s["line"]), "\n")
    return levels.groupBy(*keys).agg(lines.alias("block"))


def check_samples(states: DataFrame, params: DataFrame, wanted: list[str]) -> None:
    """Refuse training data whose states and parameters do not match."""
    missing = [p for p in wanted if p not in params.columns]
    if missing:
        raise ValueError(f"parameters without values: {missing}")
    a, b = (df.select("split", "sample").distinct() for df in (states, params))
    if not a.exceptAll(b).isEmpty() or not b.exceptAll(a).isEmpty():
        raise ValueError("states and parameters are of different samples")


def load_samples(spark: SparkSession, folder: str, split: str, wanted: list[str]) -> tuple[DataFrame, DataFrame]:
    """``(states, params)`` of one split of training data ``state/split=<split>/..`` and ``param/split=<split>/..``, checked."""
    states, params = (spark.read.parquet(f"{folder}/{kind}").where(F.col("split") == split) for kind in ("state", "param"))
    check_samples(states, params, wanted)
    return states, params


def zip_samples(states: DataFrame, params: DataFrame, wanted: list[str]) -> DataFrame:
    """Each state's rows with the parameters of its sample, which has one row of them."""
    return states.join(params.select("split", "sample", *wanted), ["split", "sample"])


def write_driver(planes: DataFrame, folder: str, fill: float = -9999.0) -> None:
    """Boundary planes as parquet, a folder for each side."""
    driver_planes(planes, fill).write.mode("overwrite").partitionBy("side").parquet(folder)


def carry_restarts(files: DataFrame, substitutes: DataFrame) -> DataFrame:
    """``(member, path, name)``: the restart that each member takes on: its own newest one, a failed one's its donor's, renamed.

    ``files(member, path, modified)``; ``substitutes(member, donor)``; a file's name ends in ``_<member>.<suffix>``.
    """
    newest = files.groupBy("member").agg(F.max(F.struct("modified", "path")).alias("f")).select("member", "f.path")
    everyone = newest.select("member").union(substitutes.select("member")).distinct()
    source = everyone.join(substitutes, "member", "left").select("member", F.coalesce("donor", "member").alias("donor"))
    got = source.join(newest.withColumnRenamed("member", "donor"), "donor")
    base = F.element_at(F.split("path", "/"), -1)
    return got.select("member", "path", F.concat(F.regexp_extract(base, r"^(.*_)\d+(\.[^.]*)$", 1), F.col("member"), F.regexp_extract(base, r"^(.*_)\d+(\.[^.]*)$", 2)).alias("name"))


def driver_planes(planes: DataFrame, fill: float = -9999.0) -> DataFrame:
    """Boundary planes of a dynamic driver: an error unless times begin at 0; missing values as a finite number."""
    first = planes.agg(F.min("time").alias("t")).first()["t"]
    if first != 0:
        raise ValueError(f"a driver's first time is 0, not {first}")
    numbers = [f.name for f in planes.schema if isinstance(f.dataType, (DoubleType, FloatType)) and f.name != "time"]
    return planes.withColumns({c: F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")), F.lit(fill)) for c in numbers})


def newest_matching(files: DataFrame, grid: tuple[int, int, int]) -> DataFrame:
    """Of restart files ``(path, modified, nx, ny, nz)``, the newest; an error if it is of another grid."""
    last = files.agg(F.max(F.struct("modified", "path", "nx", "ny", "nz")).alias("f")).select("f.*")
    fits = (F.col("nx") == grid[0]) & (F.col("ny") == grid[1]) & (F.col("nz") == grid[2])
    return last.withColumn("path", F.when(fits, F.col("path")).otherwise(F.raise_error(F.lit("the newest restart is of another grid"))))
