"""What the operators of this subpackage share: tables, the shared folder, folds.

Conventions every operator keeps to
-----------------------------------
* A ``null`` text is an empty text. Words are ``[^\\x20\\x09-\\x0D]+``.
* Columns are addressed by name; extra columns never take part, whatever they are called,
  because each operator first narrows its input to the columns it reads. Operators that hand
  the caller's rows on never touch a column of theirs but the text (and its length) that they rewrite: new columns
  come last, and one whose name the table has already gets as many underscores after it as make it new
  (:func:`free_names`). Filters and rewriting stages return the input's columns and no other.
* Intermediate tables go to the folder that ``spark.checkpoint.dir`` names, which every
  executor reads, so a lost executor costs a task and no more. Within :func:`scratch` they are
  deleted at its end.
"""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Regular expression of what separates words; the pieces between are the words.
SEPARATORS = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the parquet tables below ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder shared by driver and executors, as the session names it; a session on one machine needs none."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not where and not spark.sparkContext.master.partition("[")[0] == "local":
        raise ValueError("spark.checkpoint.dir names no folder that all executors share")
    return (where or f"{tempfile.gettempdir()}/checkpoints").rstrip("/")


def _tables(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/meshlark/{spark.sparkContext.applicationId}"


_written: ContextVar[list[str] | None] = ContextVar("written", default=None)


def materialise(df: DataFrame, name: str, keep: bool = False) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: the lineage ends here.

    With ``keep``, the table outlives the :func:`scratch` that it is written in.
    """
    spark = df.sparkSession
    path = f"{_tables(spark)}/{name}-{uuid.uuid4().hex}"
    if (paths := _written.get()) is not None and not keep:
        paths.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables that are materialised inside are deleted at the end; what reads them has to be written before."""
    token = _written.set([])
    try:
        yield
    finally:
        for path in _written.get():
            delete(spark, path)
        _written.reset(token)


def delete(spark: SparkSession, path: str) -> None:
    """Delete a folder, if it is there."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def sweep(spark: SparkSession, *tables: DataFrame) -> None:
    """Delete these tables of :func:`materialise`, and the shuffles of finished queries; what reads the tables has to be written before.

    Spark keeps the files of a shuffle until the driver's garbage collector finds that its plan is dead, by itself often later than the disk lasts.
    """
    for df in tables:
        for path in {file.rpartition("/")[0] for file in df.inputFiles()}:
            delete(spark, path)
    spark._jvm.System.gc()


def release(spark: SparkSession) -> None:
    """Delete the tables that this application has written to the shared folder; results that read them are lost."""
    delete(spark, _tables(spark))


def free_names(df: DataFrame, *wanted: str) -> list[str]:
    """A name for each of ``wanted`` that no column of ``df`` has, whatever the case of its letters."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in wanted:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def words(text: Column) -> Column:
    """The words of a text as an array, in order; none for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SEPARATORS), lambda w: w != "")


def word_count(text: Column) -> Column:
    """How many words a text has. Counts word starts, so no array is built."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def held_out(doc_id: Column) -> Column:
    """Whether a row belongs to the fold that nothing is learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def bounded_sample(df: DataFrame, key: str, most: int) -> DataFrame:
    """The different rows of ``df`` with the ``most`` least hashes of ``key`` (all rows, where there are no more keys).

    For fitting only. The same rows are chosen on every run. Equal keys count once, so copies, however many, neither
    fill the sample nor thin it out. Some more hashes than ``most``, and never those of all keys, come to the driver.
    """
    hashed = F.xxhash64(key, F.lit(977))
    keys = df.agg(F.approx_count_distinct(hashed, 0.02)).first()[0]
    if keys > most * 0.9:
        # Twice as many as wanted are expected below this hash; the count is within some hundredths of the truth.
        scale = 1 << 62
        below = min(scale, int(scale * 2.0 * most / keys))
        kept = F.pmod(hashed, F.lit(scale))
        hashes = df.select(kept.alias("h")).where(F.col("h") < below).distinct()
        # Two runs of merging take the least of them: each task sends on `most` at most.
        least = [r.h for r in hashes.orderBy("h").limit(most + 1).collect()]
        if len(least) > most:
            df = df.where(kept < least[most])
        elif below < scale:
            df = df.where(kept < below)
    return df.distinct()


def kth_least(df: DataFrame, column: str, k: int) -> int:
    """The value of the long ``column`` that ``k`` rows precede in order; counts of 65,536 ranges come to the driver at a time."""
    value = F.col(column)
    for shift in (48, 32, 16, 0):
        counts = df.groupBy(F.shiftright(value, shift).alias("part")).count().collect()
        for part, many in sorted(map(tuple, counts)):
            if k < many:
                break
            k -= many
        df = df.where(F.shiftright(value, shift) == part)
    return part
