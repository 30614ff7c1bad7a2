"""A panel that arrives entity by entity: sums by date kept in step, so that no row is read twice to score a date.

Each micro-batch brings whole chunks of some entities. A batch is stored under its number as two tables:

* ``chunks/batch=N/bucket=B``: the batch's rows, by a hash of the entity;
* ``deltas/batch=N``: by date and feature, how much the batch changes count, sum and sum of squares. Where
  an entity had a chunk before, that chunk's share is taken off.

What a batch writes follows from its rows and from batches with smaller numbers, and replaces what is there under
its number; so a batch that comes again changes nothing. Reading the former chunks touches only the buckets
of the batch's entities. Sums over values are decimals: taking off what was added leaves exactly nothing.

Defined results: null, NaN and infinite values are no values; of an entity's rows with the same date in a
batch all count; rows without an entity or a date are left out; an empty batch stores nothing but its number.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from stratagrid.functions.windows import DATE, ENTITY

BUCKETS = 64
#: Values are kept to 12 decimal places and 20 digits, their squares to 12 places and 38 digits.
VALUE, SQUARE = "decimal(20,12)", "decimal(38,12)"
#: Fixed: dates with fewer values take the pooled moments of all dates up to theirs.
FEW = 5


class Panel:
    """The stored panel under ``root``; ``columns`` are the features that sums are kept of."""

    def __init__(self, root: str, columns: list[str]):
        self.root, self.columns = root, columns

    def merge(self, batch: DataFrame, number: int) -> None:
        """For ``foreachBatch``: stores a batch and its change of the sums."""
        rows = batch.where(f"{ENTITY} is not null and {DATE} is not null").withColumn("bucket", F.pmod(F.xxhash64(ENTITY), F.lit(BUCKETS)).cast("int"))
        out = f"{self.root}/chunks/batch={number}"
        rows.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(out)
        spark = batch.sparkSession
        new = self._rows(spark, [number])
        if new is None:
            return
        held = new.select("bucket").distinct().collect()  # BUCKETS rows at most
        old = self._rows(spark, [n for n in self.batches(spark) if n < number])
        delta = self._sums(new, 1)
        if old is not None:
            old = old.where(F.col("bucket").isin([r["bucket"] for r in held]))
            was = newest(old).join(new.select(ENTITY).distinct(), ENTITY, "left_semi")
            delta = delta.unionByName(self._sums(was, -1))
        by = delta.groupBy(DATE, "feature").agg(*(F.sum(c).alias(c) for c in ("n", "s", "q"))).where("n <> 0 or s <> 0 or q <> 0")
        by.write.mode("overwrite").parquet(f"{self.root}/deltas/batch={number}")

    def batches(self, spark: SparkSession) -> list[int]:
        """Numbers of the stored batches."""
        at = spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/chunks")
        fs = at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
        if not fs.exists(at):
            return []
        return sorted(int(f.getPath().getName().split("=")[1]) for f in fs.listStatus(at) if f.getPath().getName().startswith("batch="))

    def _rows(self, spark: SparkSession, numbers: list[int]) -> DataFrame | None:
        """Rows of these batches; None if none of them has any."""
        parts = []
        for n in numbers:
            path = f"{self.root}/chunks/batch={n}"
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            fs = at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
            if any(f.isDirectory() for f in fs.listStatus(at)):
                parts.append(path)
        return spark.read.option("basePath", f"{self.root}/chunks").parquet(*parts) if parts else None

    def _sums(self, rows: DataFrame, sign: int) -> DataFrame:
        long = rows.select(DATE, *(F.col(c).cast("double").alias(c) for c in self.columns)).unpivot([DATE], self.columns, "feature", "value")
        long = long.where("value is not null and not isnan(value) and abs(value) < double('inf')")
        v = F.col("value").cast(VALUE)
        by = long.groupBy(DATE, "feature").agg(F.count("*").alias("n"), F.sum(v).alias("s"), F.sum((v * v).cast(SQUARE)).alias("q"))
        return by.select(DATE, "feature", (F.col("n") * sign).alias("n"), (F.col("s") * sign).alias("s"), (F.col("q") * sign).alias("q"))

    def rows(self, spark: SparkSession) -> DataFrame | None:
        """The panel: each entity's newest chunk."""
        held = self._rows(spark, self.batches(spark))
        return None if held is None else newest(held).drop("bucket", "batch")

    def sums(self, spark: SparkSession) -> DataFrame:
        """date, feature, n, s and q over all batches."""
        every = spark.read.parquet(f"{self.root}/deltas")
        return every.groupBy(DATE, "feature").agg(*(F.sum(c).alias(c) for c in ("n", "s", "q"))).where("n > 0")

    def moments(self, spark: SparkSession) -> DataFrame:
        """date, feature, n, mean and dev that a date's values are scored with."""
        n, s, q = F.col("n").cast("double"), F.col("s").cast("double"), F.col("q").cast("double")
        upto = Window.partitionBy("feature").orderBy(DATE).rowsBetween(Window.unboundedPreceding, 0)  # a row a date
        pn, ps, pq = (F.sum(c).over(upto) for c in (n, s, q))
        dev = F.when(F.col("n") >= 2, F.sqrt(F.greatest((q - s * s / n) / (n - 1), F.lit(0.0)))).otherwise(1.0)
        pooled = F.sqrt(F.greatest(pq / pn - ps / pn * ps / pn, F.lit(0.0)))
        few = F.col("n") < FEW
        held = self.sums(spark).select(DATE, "feature", "n", F.when(few, ps / pn).otherwise(s / n).alias("mean"), F.when(few, pooled).otherwise(dev).alias("dev"))
        return held.withColumn("dev", F.greatest("dev", F.lit(1e-8)))

    def scored(self, spark: SparkSession) -> DataFrame:
        """entity, date, feature and z of every value of the panel."""
        long = self.rows(spark).select(ENTITY, DATE, *(F.col(c).cast("double").alias(c) for c in self.columns)).unpivot([ENTITY, DATE], self.columns, "feature", "value")
        long = long.where("value is not null and not isnan(value) and abs(value) < double('inf')")
        return long.join(self.moments(spark), [DATE, "feature"]).select(ENTITY, DATE, "feature", ((F.col("value") - F.col("mean")) / F.col("dev")).alias("z"))


def newest(rows: DataFrame) -> DataFrame:
    """The rows of each entity's last batch; what is joined is a row an entity."""
    last = rows.groupBy(F.col(ENTITY).alias("_e")).agg(F.max("batch").alias("_b"))
    return rows.join(last, (F.col(ENTITY) == F.col("_e")) & (F.col("batch") == F.col("_b"))).drop("_e", "_b")


def fed(spark: SparkSession, panel: Panel, source: DataFrame, checkpoint: str) -> Callable[[], None]:
    """Runs the stream ``source`` into ``panel`` until its input is read."""

    def run() -> None:
        source.writeStream.foreachBatch(panel.merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()

    return run
