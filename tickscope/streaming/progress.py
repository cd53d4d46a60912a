"""Backlog samples from the progress that streaming queries report."""

from __future__ import annotations

import json
import threading
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.listener import StreamingQueryListener

from tickscope.sources.batch_table import stored

SAMPLES = "run STRING, elapsed DOUBLE, lag BIGINT, burst_size BIGINT, produce_seconds DOUBLE"
REPORTS = "run STRING, batch BIGINT, began DOUBLE, ended DOUBLE, n_rows BIGINT"


def _instant(text: str) -> float:
    return datetime.fromisoformat(text.replace("Z", "+00:00")).timestamp()


class ProgressLog(StreamingQueryListener):
    """Writes what queries report of their micro-batches to a folder of reports.

    Register it with ``spark.streams.addListener``. ``run`` is the query's name, or its id
    if it has none. Reports wait in memory until there are ``at_once`` or the query ends.
    """

    def __init__(self, spark: SparkSession, path: str, at_once: int = 1000):
        self.spark, self.path, self.at_once = spark, path, at_once
        self.waiting: list[tuple] = []
        self.ended: dict[str, threading.Event] = {}
        self.lock = threading.Lock()

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        report = json.loads(event.progress.json)
        began = _instant(report["timestamp"])
        ended = began + report["durationMs"].get("triggerExecution", 0) / 1000
        with self.lock:
            self.waiting.append((report["name"] or report["id"], report["batchId"], began, ended, report["numInputRows"]))
            full = len(self.waiting) >= self.at_once
        if full:
            self._write()

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self._write()
        self._end_of(str(event.runId)).set()

    def _end_of(self, run_id: str) -> threading.Event:
        with self.lock:
            return self.ended.setdefault(run_id, threading.Event())

    def wait(self, query: StreamingQuery, seconds: float = 60.0) -> None:
        """Until the reports of a query that has stopped are in the folder."""
        if not self._end_of(str(query.runId)).wait(seconds):
            raise TimeoutError("the query's last report has not come")

    def _write(self) -> None:
        with self.lock:
            rows, self.waiting = self.waiting, []
        if rows:
            self.spark.createDataFrame(rows, REPORTS).coalesce(1).write.mode("append").parquet(self.path)

    def reports(self) -> DataFrame:
        return stored(self.spark, self.path, REPORTS)


def backlog_samples(reports: DataFrame, bursts: DataFrame) -> DataFrame:
    """Rows still unread after each micro-batch: what `delivery.drain_summary` takes.

    ``bursts``: run, burst_size, produce_seconds. A run's micro-batches are few next to
    its rows, and are put in order within it.
    """
    run = Window.partitionBy("run")
    so_far = run.orderBy("batch", "ended").rowsBetween(Window.unboundedPreceding, 0)
    read = reports.join(bursts, "run").withColumns(
        {"_read": F.sum("n_rows").over(so_far), "_first": F.min("began").over(run)})
    return read.select(
        "run", (F.col("ended") - F.col("_first")).alias("elapsed"),
        F.greatest(F.col("burst_size") - F.col("_read"), F.lit(0)).alias("lag"), "burst_size", "produce_seconds",
    )


def lag_samples(
    spark: SparkSession, run: str, progress: list[dict], total_rows: int, produce_seconds: float
) -> DataFrame:
    """The same from ``StreamingQuery.recentProgress``, which keeps the last hundred reports."""
    rows, read, began = [], 0, None
    for report in progress:
        report = report if isinstance(report, dict) else json.loads(report.json)
        ended = _instant(report["timestamp"]) + report["durationMs"].get("triggerExecution", 0) / 1000
        began = _instant(report["timestamp"]) if began is None else began
        read += report["numInputRows"]
        rows.append((run, ended - began, max(total_rows - read, 0), total_rows, produce_seconds))
    return spark.createDataFrame(rows, SAMPLES)
