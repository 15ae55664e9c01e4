"""Streams of points: cells that are emitted once no more points can come, and sessions of ids."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..session import ensure_checkpoint_dir


def cell_counts(stream: DataFrame, time_column: str, window: str, late: str, cells: list[str], value: str) -> DataFrame:
    """(window_start, cells, n, total): a cell of a window is final once the watermark has passed the window; later rows are dropped."""
    held = stream.withWatermark(time_column, late)
    return held.groupBy(F.window(time_column, window).alias("w"), *cells).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total")).select(F.col("w.start").alias("window_start"), *cells, "n", "total")


def sliding_counts(stream: DataFrame, time_column: str, window: str, step: str, late: str, cells: list[str]) -> DataFrame:
    held = stream.withWatermark(time_column, late)
    return held.groupBy(F.window(time_column, window, step).alias("w"), *cells).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("window_start"), *cells, "n")


def id_sessions(stream: DataFrame, time_column: str, gap: str, late: str, ids: list[str]) -> DataFrame:
    """(session_start, session_end, ids, n): an id is final when it has been absent for longer than gap."""
    held = stream.withWatermark(time_column, late)
    return held.groupBy(F.session_window(time_column, gap).alias("w"), *ids).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), *ids, "n")


def finalise_cells(stream: DataFrame, time_column: str, late: str, cell: str, value: str, idle_ms: int) -> DataFrame:
    """(cell, n, mean): the running sums of each cell are kept as state and emitted when the watermark is idle_ms past its last point.

    State is two numbers and a time, however many points a cell has.
    """

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, total, last = state.get if state.exists else (0, 0.0, 0)
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame({"cell": [key[0]], "n": [n], "mean": [total / n if n else None]})
            return
        for part in batches:
            n, total = n + len(part), total + float(part["value"].sum())
            last = max(last, int(part["at"].max()))
        state.update((n, total, last))
        state.setTimeoutTimestamp(max(last, state.getCurrentWatermarkMs()) + idle_ms)

    held = stream.withWatermark(time_column, late).select(time_column, F.col(cell).cast("string").alias("cell"), F.col(value).cast("double").alias("value"), F.unix_millis(time_column).alias("at"))
    return held.groupBy("cell").applyInPandasWithState(update, "cell string, n long, mean double", "n long, total double, last long", "append", GroupStateTimeout.EventTimeTimeout)


def run_to_table(spark: SparkSession, result: DataFrame, limit_s: float | None = None) -> DataFrame:
    """Runs a stream over what is there into files in the shared folder, and gives them as a table. A stream that has not ended after limit_s, if that is given, is an error."""
    ensure_checkpoint_dir(spark)
    base = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/stream-{uuid.uuid4().hex}"
    query = result.writeStream.format("parquet").option("checkpointLocation", f"{base}/state").option("path", f"{base}/out").outputMode("append").trigger(availableNow=True).start()
    try:
        if query.awaitTermination(limit_s) is False:
            raise TimeoutError(f"the stream has not ended after {limit_s} s")
    finally:
        query.stop()
    return spark.read.schema(result.schema).parquet(f"{base}/out")


class Progress(StreamingQueryListener):
    """Tells a callback of each finished batch: the query's name, the batch and the rows read."""

    def __init__(self, tell: Callable[[str | None, int, int], None]):
        self.tell = tell

    def onQueryStarted(self, event) -> None: ...

    def onQueryProgress(self, event) -> None:
        self.tell(event.progress.name, event.progress.batchId, event.progress.numInputRows)

    def onQueryIdle(self, event) -> None: ...

    def onQueryTerminated(self, event) -> None: ...


def cancel(spark: SparkSession, tag: str) -> None:
    """Ends all work that was started under a tag (spark.addTag)."""
    spark.interruptTag(tag)
