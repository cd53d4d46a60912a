"""A table that micro-batches are delivered to, as plain partitioned parquet.

Layout, with G the number of the generation::

    log/number=G/writer=W/batch=N   deliveries since generation G began
    base/number=G                   everything folded when it began
    folded/number=G                 the newest batch of each writer in that base

A batch of a writer is one partition, and Spark's partition overwrite puts a partition in
place as a whole; one that is there is left alone, so a retried batch changes nothing.
:meth:`fold` starts a generation. Readers take the newest base and, of the last two
generations, the batches above the folded numbers: what a writer delivers while another
folds is not lost, as long as a delivery does not last over two folds. So what is read
and listed follows the batches since the last folds, however many there were before.
Nothing is deleted; old generations can be removed once no reader needs them.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PARTITIONS = "writer STRING, batch BIGINT"


def stored(spark: SparkSession, path: str, schema: str, base: str | None = None) -> DataFrame:
    """The parquet folder ``path``, or no rows where there is none yet."""
    try:
        reader = spark.read.schema(schema)
        return (reader.option("basePath", base) if base else reader).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


class BatchTable:
    """Rows of ``schema``, delivered in numbered batches by named writers."""

    def __init__(self, spark: SparkSession, path: str, schema: str):
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema

    def deliver(self, rows: DataFrame, writer: str, batch: int) -> bool:
        """Add the rows of a writer's batch; False, and no change, if it is in the table already."""
        number, folded = self._generation()
        if batch <= folded.get(writer, -1):
            return False
        own = (F.col("writer") == writer) & (F.col("batch") == batch)
        if not self._log(number).where(own).isEmpty():
            return False
        names = [f.name for f in self.spark.createDataFrame([], self.schema).schema]
        rows.select(*names, F.lit(writer).alias("writer"), F.lit(batch).cast("bigint").alias("batch"),
                    F.lit(number).alias("number")).write.mode("overwrite").option(
            "partitionOverwriteMode", "dynamic").partitionBy("number", "writer", "batch").parquet(f"{self.path}/log")
        return True

    def deliveries(self) -> DataFrame:
        """All rows with their writer and batch; those folded have what the fold made of them."""
        return self._deliveries(*self._generation())

    def fold(self, merged: Callable[[DataFrame], DataFrame]) -> int:
        """Start a generation whose base is ``merged(deliveries())``; returns its number.

        ``merged`` keeps the columns. The numbers of folded batches are written last, and
        only a generation that has them counts.
        """
        number, folded = self._generation()
        log = self._log(number)
        newest = {r["writer"]: r["batch"] for r in log.groupBy("writer").agg(F.max("batch").alias("batch")).collect()}
        if not newest or all(n <= folded.get(w, -1) for w, n in newest.items()):
            return number
        newest = {w: max(newest.get(w, -1), folded.get(w, -1)) for w in {*newest, *folded}}
        # Only what the numbers cover goes into the base, whatever is delivered meanwhile.
        covered = reduce(lambda a, b: a | b, [(F.col("writer") == w) & (F.col("batch") <= n) for w, n in newest.items()])
        rows = merged(self._deliveries(number, folded).where(covered))
        self._put(rows, "base", number + 1)
        self._put(self.spark.createDataFrame(list(newest.items()), PARTITIONS).coalesce(1), "folded", number + 1)
        return number + 1

    def _put(self, rows: DataFrame, kind: str, number: int) -> None:
        rows.withColumn("number", F.lit(number)).write.mode("overwrite").option(
            "partitionOverwriteMode", "dynamic").partitionBy("number").parquet(f"{self.path}/{kind}")

    def _generation(self) -> tuple[int, dict[str, int]]:
        """The newest generation and, by writer (a few), the newest batch in its base."""
        rows = stored(self.spark, f"{self.path}/folded", f"{PARTITIONS}, number INT")
        newest = rows.where(F.col("number") == rows.agg(F.max("number").alias("n")).scalar()).collect()
        return (newest[0]["number"] if newest else 0), {r["writer"]: r["batch"] for r in newest}

    def _log(self, number: int) -> DataFrame:
        schema, base = f"{self.schema}, {PARTITIONS}", f"{self.path}/log"
        logs = [stored(self.spark, f"{base}/number={n}", schema, base) for n in (number - 1, number) if n >= 0]
        return reduce(DataFrame.unionByName, [log.drop("number") for log in logs])

    def _deliveries(self, number: int, folded: dict[str, int]) -> DataFrame:
        fresh = self._log(number)
        for writer, batch in folded.items():
            fresh = fresh.where((F.col("writer") != writer) | (F.col("batch") > batch))
        if not number:
            return fresh
        base = stored(self.spark, f"{self.path}/base/number={number}", f"{self.schema}, {PARTITIONS}")
        return base.unionByName(fresh)
