"""Session settings that the engine relies on."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "*", memory: str = "8g", partitions: int = 8) -> SparkSession:
    """A local session for tests and benchmarks; on a cluster the caller brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("stratagrid")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one only on a local master, where none is set."""
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="stratagrid-"))
    return sc.getCheckpointDir()


#: About so many rows of a frame go to a task where the number of tasks is set by ``tasks_for``.
TASK_ROWS = 1 << 18


def tasks_for(rows: DataFrame, least: int = 1) -> int:
    """Tasks that hold about TASK_ROWS of ``rows`` each; ``least`` at least. Counting a plain table reads no column."""
    return max(least, -(-rows.count() // TASK_ROWS))


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read from there: replicated, so a lost executor costs nothing."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder as Parquet and read from there: like ``cut``, but later scans read only the columns they need."""
    path = f"{shared_dir(df.sparkSession)}/stored-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def dropped(*tables: DataFrame) -> None:
    """Removes the files of ``stored`` tables that nothing reads any more."""
    for df in tables:
        session = df.sparkSession
        for path in {f.rsplit("/", 1)[0] for f in df.inputFiles() if "/stored-" in f}:
            at = session._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(session._jsparkSession.sessionState().newHadoopConf()).delete(at, True)
