"""Stores of bars, posts and reports: schemas, pruned scans, versioned upserts, manifests, compaction.

A version is written whole to its own folder and becomes current when its row is in the pointer table
next to it; readers never see half a version, and a writer that dies leaves nothing that is read. Numbers
and commits are claimed by files that only one writer can make, so two writers lose neither's rows.
All paths go through Spark, so any filesystem that Spark knows will do.
"""

from __future__ import annotations

import os
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratagrid.functions.windows import DATE, ENTITY
from stratagrid.operators.channels import last_write_wins
from stratagrid.session import dropped, stored, tasks_for

BARS = "entity string, date date, open double, high double, low double, close double, volume double, amount double, pct_change double"
INTRADAY = "entity string, ts timestamp, open double, high double, low double, close double, volume double, amount double, bar_period int"
POSTS = "post_id long, entity string, ts timestamp, title string, body string, source string, sentiment_title double, sentiment_body double"


def scan(spark: SparkSession, path: str, schema: str | None = None, start=None, end=None, entities: list | None = None, columns: list[str] | None = None) -> DataFrame:
    """A date range of some entities and columns; range and list reach the files, columns the reader."""
    reader = spark.read.schema(schema) if schema else spark.read
    df = reader.parquet(path)
    if start is not None:
        df = df.where(F.col(DATE) >= F.lit(start).cast("date"))
    if end is not None:
        df = df.where(F.col(DATE) <= F.lit(end).cast("date"))
    if entities is not None:
        df = df.where(F.col(ENTITY).isin(entities))
    return df.select(*columns) if columns else df


def entities(df: DataFrame) -> DataFrame:
    return df.select(ENTITY).distinct()


def partitioned(df: DataFrame, path: str, *by: str) -> None:
    """Written by the given columns (year, month, quarter); rows are first brought together by them, so each folder gets few files."""
    df.repartition(*by).write.mode("overwrite").partitionBy(*by).parquet(path)


def with_year_month(df: DataFrame, at: str = DATE) -> DataFrame:
    return df.withColumns({"year": F.year(at), "month": F.month(at)})


def current_version(spark: SparkSession, root: str) -> int | None:
    """The newest version that was committed; None without any."""
    try:
        return spark.read.schema("version int").parquet(f"{root}/pointer").agg(F.max("version")).first()[0]
    except Exception as e:
        if "PATH_NOT_FOUND" in str(e):
            return None
        raise


def read_version(spark: SparkSession, root: str, version: int | None = None) -> DataFrame:
    v = current_version(spark, root) if version is None else version
    if v is None:
        raise FileNotFoundError(root)
    return spark.read.parquet(f"{root}/v{v:08d}")


class Conflict(RuntimeError):
    """Another writer has put a version on top of the same one."""


def _claimed(spark: SparkSession, path: str) -> bool:
    """Whether this call made the file; a file is made once, whoever tries.

    Hadoop's local file system looks before it creates, so on local folders the operating system's exclusive create is asked.
    """
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    try:
        if fs.getUri().getScheme() == "file":
            fs.mkdirs(at.getParent())
            fd = os.open(fs.makeQualified(at).toUri().getPath(), os.O_CREAT | os.O_EXCL | os.O_WRONLY)
            os.close(fd)
        else:
            fs.create(at, False).close()
    except Exception:
        if fs.exists(at):
            return False
        raise
    return True


def write_version(df: DataFrame, root: str, after: int | None = -1) -> int:
    """A new version: its number is claimed, then the data are written, then the pointer.

    With ``after`` it is only committed on top of that version (None: as the first one), and a second
    writer on top of the same one gets a Conflict; what it has written is never read.
    """
    spark = df.sparkSession
    v = (current_version(spark, root) or 0) + 1
    while not _claimed(spark, f"{root}/claims/v{v:08d}"):
        v += 1
    df.write.mode("overwrite").parquet(f"{root}/v{v:08d}")
    if after != -1 and not _claimed(spark, f"{root}/claims/after{after or 0:08d}"):
        raise Conflict(f"{root}: another version was put after {after}")
    spark.range(1).select(F.lit(v).cast("int").alias("version")).write.mode("append").parquet(f"{root}/pointer")
    return v


def upsert(new: DataFrame, root: str, keys: list[str], tries: int = 20, wait: float = 3.0) -> int:
    """The current version with ``new`` merged in, the last write winning, as a new version.

    If another writer commits meanwhile, the merge is done again on top of what it wrote. A writer that
    died between its claim and its pointer blocks others, which then raise Conflict: its claim in
    ``claims`` is to be removed by hand.
    """
    spark = new.sparkSession
    for left in range(tries, 0, -1):
        base = current_version(spark, root)
        merged = new if base is None else last_write_wins(read_version(spark, root, base), new, keys)
        try:
            return write_version(merged, root, base)
        except Conflict:
            if left == 1:
                raise
            until = time.monotonic() + wait
            while current_version(spark, root) == base and time.monotonic() < until:
                time.sleep(0.2)
    raise AssertionError


def manifest(df: DataFrame, keys: list[str]) -> DataFrame:
    """One row: rows, extent, and a checksum that does not depend on row order."""
    columns = sorted(df.columns)
    h = F.xxhash64(*columns)
    # summed in two halves of the hash, which can't overflow before 2^31 rows a task
    return df.agg(
        F.count("*").alias("rows"), F.count_distinct(*keys).alias("keys"), F.min(DATE).alias("first"), F.max(DATE).alias("last"),
        F.sum(h.bitwiseAND(F.lit(0xFFFFFFFF)).cast("decimal(38,0)")).alias("low"), F.sum(F.shiftrightunsigned(h, 32).cast("decimal(38,0)")).alias("high"),
    ).withColumn("schema", F.lit(",".join(f"{n}:{t}" for n, t in sorted(df.dtypes))))


def compact(df: DataFrame, path: str, files: int) -> None:
    """Many fragments to ``files`` files, or to more where these would hold over TASK_ROWS rows; rows of an entity together and in date order."""
    held = stored(df)  # made once: it is counted, sampled for the ranges, and written
    held.repartitionByRange(tasks_for(held, files), ENTITY, DATE).sortWithinPartitions(ENTITY, DATE).write.mode("overwrite").parquet(path)
    dropped(held)


def report(df: DataFrame, path: str, kind: str = "csv") -> None:
    """A small result as one file for people; the caller aggregates first."""
    writer = df.coalesce(1).write.mode("overwrite")
    writer.json(path) if kind == "json" else writer.option("header", True).csv(path)


def calendar(spark: SparkSession, start: str, end: str, holidays: DataFrame | None = None) -> DataFrame:
    """Sessions: weekdays without holidays, numbered from 1."""
    days = spark.sql(f"SELECT explode(sequence(date '{start}', date '{end}', interval 1 day)) AS date").where(F.weekday(DATE) < 5)
    if holidays is not None:
        days = days.join(holidays.select(DATE), DATE, "left_anti")
    return number_sessions(days)


def number_sessions(days: DataFrame) -> DataFrame:
    from pyspark.sql.window import Window

    return days.select(DATE, F.row_number().over(Window.orderBy(DATE)).alias("session_no"))  # one row a day


def wide_to_long(df: DataFrame, keys: list[str], name: str = "period", value: str = "value") -> DataFrame:
    """Columns of periods as rows."""
    return df.unpivot(keys, [c for c in df.columns if c not in keys], name, value)


def long_to_wide(df: DataFrame, keys: list[str], name: str, values: list, value: str) -> DataFrame:
    """Names as columns; their list is given, so that Spark does not collect it first."""
    return df.groupBy(*keys).pivot(name, values).agg(F.first(value))


def universe(listed: DataFrame, delisted: DataFrame) -> DataFrame:
    """One row per code: list date, and exit date (suspension before the effective one)."""
    both = listed.join(delisted, ENTITY, "full_outer")
    return both.select(ENTITY, "list_date", F.coalesce("suspended", "effective").alias("exit_date"), F.when(F.col("effective").isNotNull(), "delisted").when(F.col("suspended").isNotNull(), "suspended").otherwise("listed").alias("status"))
