"""Early stopping and the collapse guard over streams of log rows, with typed state for each run.

State lives in the RocksDB store under the query's checkpoint, so a query that is started again goes on where it was. Both
streams keep a run until no row of it has come for a while of event time; a timer then closes the run and drops its state.
Rows that are later than the watermark are dropped by Spark. Within the watermark, a row whose step does not lie beyond
the last step of its run comes too late for the fold and is left out.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from sparkward.operators import trainlog

#: Event time after which a silent run is closed, and by which rows may be late.
IDLE, LATE = "30 days", "1 day"
STOPS = "run_id long, evals long, best_loss double, best_step long, stopped_at long, last_step long, closed boolean"
COLLAPSES = "run_id long, collapsed_at long, reason string"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

State = tuple[int, float, int | None, int, int | None, int]
START: State = (0, math.inf, None, 0, None, -(1 << 62))


def fold(state: State, rows: list[tuple[int, float | None]], patience: int = trainlog.PATIENCE, min_delta: float = trainlog.MIN_DELTA) -> State:
    """(evals, best loss, best step, bad, stopped at, last step) after the rows in step order.

    Steps up to the last one seen are late and ignored; null losses are no evaluation. After the run has stopped,
    evaluations are counted and change nothing else.
    """
    evals, best, best_step, bad, stopped, last = state
    for step, loss in sorted(rows, key=lambda r: r[0]):
        if step <= last or loss is None or loss != loss:
            continue
        last, evals = step, evals + 1
        if stopped is not None:
            continue
        if loss < best - min_delta:
            best, best_step, bad = loss, step, 0
        else:
            bad += 1
        stopped = step if bad >= patience else None
    return evals, best, best_step, bad, stopped, last


class _Run(StatefulProcessor):
    """A value for each run, and a timer that is set anew whenever rows of the run come."""

    schema = ""

    def __init__(self, idle_ms: int):
        self.idle_ms = idle_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.state = handle.getValueState("run", self.schema)

    def awaited(self, latest_ms: int) -> None:
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        self.handle.registerTimer(latest_ms + self.idle_ms)

    def close(self) -> None:
        pass


class _EarlyStop(_Run):
    schema = "evals long, best double, best_step long, bad long, stopped long, last long, latest long"

    def __init__(self, idle_ms: int, patience: int, min_delta: float):
        super().__init__(idle_ms)
        self.patience, self.min_delta = patience, min_delta

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        *now, latest = self.state.get() if self.state.exists() else (*START, 0)
        frame = pd.concat(list(rows))
        losses = [None if pd.isna(x) else float(x) for x in frame["val_loss"]]
        now = fold(tuple(now), list(zip(frame["step"].tolist(), losses, strict=True)), self.patience, self.min_delta)
        latest = max(latest, int(frame["at_ms"].max()))
        self.state.update((*now, latest))
        self.awaited(latest)
        yield self.told(key, now, False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.state.exists():
            *now, _ = self.state.get()
            self.state.clear()
            yield self.told(key, tuple(now), True)

    @staticmethod
    def told(key, now: State, closed: bool) -> pd.DataFrame:
        evals, best, best_step, _, stopped, last = now
        frame = pd.DataFrame({"run_id": [key[0]], "evals": [evals], "best_loss": [best], "best_step": [best_step], "stopped_at": [stopped], "last_step": [last], "closed": [closed]})
        return frame.astype({"best_step": "Int64", "stopped_at": "Int64"})


class _Collapse(_Run):
    schema = "collapsed_at long"

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        frame = pd.concat(list(rows))
        self.awaited(int(frame["at_ms"].max()))
        if not self.state.exists():
            first = frame.loc[frame["step"].idxmin()] if len(frame.index) == 1 else frame.sort_values(["step", "reason"]).iloc[0]
            self.state.update((int(first["step"]),))
            yield pd.DataFrame({"run_id": [key[0]], "collapsed_at": [int(first["step"])], "reason": [first["reason"]]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.state.clear()
        yield from ()


def _milliseconds(interval: str) -> int:
    return int(pd.Timedelta(interval).total_seconds() * 1000)


def _timed(log: DataFrame, late: str, *columns: str) -> DataFrame:
    return log.withWatermark("ts", late).select("run_id", "step", *columns, "ts", F.unix_millis("ts").alias("at_ms"))


def early_stop_stream(log: DataFrame, *, idle: str = IDLE, late: str = LATE, patience: int = trainlog.PATIENCE, min_delta: float = trainlog.MIN_DELTA) -> DataFrame:
    """From (run_id, step, val_loss, ts): in each batch a row for each run that has new rows, with its state after them.

    The row of most evaluations is the run's last state (see last_states). closed rows are given when a run's time is over.
    """
    log.sparkSession.conf.set(_PROVIDER, _ROCKS)
    rows = _timed(log, late, "val_loss")
    return rows.groupBy("run_id").transformWithStateInPandas(_EarlyStop(_milliseconds(idle), patience, min_delta), STOPS, "Append", "EventTime")


def last_states(rows: DataFrame) -> DataFrame:
    """run_id, evals, best_loss, best_step, stopped_at: what early_stop gives for whole logs."""
    newest = rows.groupBy("run_id").agg(F.max_by(F.struct("evals", "best_loss", "best_step", "stopped_at"), F.struct("last_step", "closed")).alias("x"))
    return newest.where("x.evals > 0").select("run_id", "x.*")


def collapse_stream(log: DataFrame, *, idle: str = IDLE, late: str = LATE) -> DataFrame:
    """From (run_id, step, entropy, logps, logits, ts): one row for each run, at its first sign of collapse.

    Of the signs that come in one batch the least step counts. A sign that comes in a later batch changes nothing, even
    if its step is earlier: the run was stopped already.
    """
    log.sparkSession.conf.set(_PROVIDER, _ROCKS)
    reason = trainlog.collapse_reason(F.col("entropy"), F.col("logps"), F.col("logits"))
    rows = _timed(log, late, "entropy", "logps", "logits").withColumn("reason", reason).where("reason is not null")
    return rows.select("run_id", "step", "reason", "ts", "at_ms").groupBy("run_id").transformWithStateInPandas(_Collapse(_milliseconds(idle)), COLLAPSES, "Append", "EventTime")


def run_available(spark: SparkSession, source: str, schema, stream: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, files: int | None = None) -> DataFrame:
    """Run a stream over the files of a folder that are not done yet, and give all that it has written."""
    reader = spark.readStream.schema(schema)
    made = stream((reader.option("maxFilesPerTrigger", files) if files else reader).parquet(source))
    made.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(made.schema).parquet(out)
