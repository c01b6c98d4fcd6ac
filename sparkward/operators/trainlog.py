"""Training logs: early stopping, overfit streaks, collapse and NaN guards, over rows ordered by step within a run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PATIENCE, MIN_DELTA, OVERFIT, SEVERE, OVERFIT_PATIENCE = 5, 1e-4, 0.5, 0.3, 3
# Bounds of the collapse guard.
ENTROPY, LOGP, LOGITS = 3.0, 2000.0, 5.0


def early_stop(log: DataFrame, run: str = "run_id", step: str = "step", loss: str = "val_loss", patience: int = PATIENCE, min_delta: float = MIN_DELTA) -> DataFrame:
    """run, evals, best_loss, best_step, stopped_at (null if it never stops): a fold over each run's losses by step.

    A loss improves if it is below the best by more than min_delta. The run stops at the patience-th evaluation in a row
    that does not, and nothing after that counts. Null losses are no evaluation. A run's steps are one array; its length
    is that of a training run.
    """
    rows = log.where(F.col(loss).isNotNull()).groupBy(run).agg(F.array_sort(F.collect_list(F.struct(F.col(step).cast("long").alias("step"), F.col(loss).cast("double").alias("loss")))).alias("h"))
    none = F.lit(None).cast("long")
    start = F.struct(F.lit(float("inf")).alias("best"), none.alias("best_step"), F.lit(0).alias("bad"), none.alias("stopped"))

    def fold(s: Column, x: Column) -> Column:
        better = x["loss"] < s["best"] - min_delta
        bad = F.when(better, 0).otherwise(s["bad"] + 1)
        now = F.struct(F.when(better, x["loss"]).otherwise(s["best"]).alias("best"), F.when(better, x["step"]).otherwise(s["best_step"]).alias("best_step"), bad.alias("bad"), F.when(bad >= patience, x["step"]).alias("stopped"))
        return F.when(s["stopped"].isNotNull(), s).otherwise(now)

    got = rows.select(run, F.size("h").cast("long").alias("evals"), F.aggregate("h", start, fold).alias("s"))
    return got.select(run, "evals", F.col("s.best").alias("best_loss"), F.col("s.best_step").alias("best_step"), F.col("s.stopped").alias("stopped_at"))


def with_last_train_loss(log: DataFrame, run: str = "run_id", step: str = "step", loss: str = "train_loss") -> DataFrame:
    """Column last_train_loss: the latest known training loss up to the row."""
    w = Window.partitionBy(run).orderBy(step).rowsBetween(Window.unboundedPreceding, 0)
    return log.withColumn("last_train_loss", F.last(loss, ignorenulls=True).over(w))


def overfit_streaks(log: DataFrame, run: str = "run_id", step: str = "step", val: str = "val_loss", train: str = "last_train_loss", threshold: float = OVERFIT) -> DataFrame:
    """Columns overfit_ratio, status and streak: rows in a row whose ratio is below the threshold.

    A row without a training loss or with a loss that is not above 0 has no ratio, and leaves the streak as it is.
    """
    w = Window.partitionBy(run).orderBy(step).rowsBetween(Window.unboundedPreceding, 0)
    known = F.col(train).isNotNull() & (F.col(val) > 0)
    rated = log.withColumn("overfit_ratio", F.when(known, F.col(train) / F.when(F.col(val) > 0, F.col(val))))
    low = F.coalesce(F.col("overfit_ratio") < threshold, F.lit(False))
    status = F.when(low & (F.col("overfit_ratio") < SEVERE), "severe").when(low, "moderate").otherwise("normal")
    resets = F.sum(F.when(F.col("overfit_ratio") >= threshold, 1).otherwise(0)).over(w)
    parted = rated.withColumn("status", status).withColumn("__island", resets).withColumn("__low", low.cast("int"))
    own = Window.partitionBy(run, "__island").orderBy(step).rowsBetween(Window.unboundedPreceding, 0)
    return parted.withColumn("streak", F.sum("__low").over(own)).drop("__island", "__low")


def overfit_warnings(streaks: DataFrame, run: str = "run_id", step: str = "step", patience: int = OVERFIT_PATIENCE) -> DataFrame:
    """The first step of each run at which the streak reaches the patience."""
    return streaks.where((F.col("streak") >= patience) & F.col("overfit_ratio").isNotNull()).groupBy(run).agg(F.min(step).alias("warned_at"))


def collapse_reason(entropy: Column, logps: Column, logits: Column) -> Column:
    return F.when(entropy < ENTROPY, "entropy").when(F.abs(logps) > LOGP, "logps").when(F.abs(logits) < LOGITS, "logits")


def collapse_guard(log: DataFrame, run: str = "run_id", step: str = "step", entropy: str = "entropy", logps: str = "logps", logits: str = "logits") -> DataFrame:
    """run, collapsed_at, reason: the first row that shows a sign of collapse; the signs are tested in a fixed order."""
    told = log.withColumn("reason", collapse_reason(F.col(entropy), F.col(logps), F.col(logits))).where("reason is not null")
    first = told.groupBy(run).agg(F.min(F.struct(F.col(step).alias("step"), "reason")).alias("x"))
    return first.select(run, F.col("x.step").alias("collapsed_at"), F.col("x.reason").alias("reason"))


def nan_rows(log: DataFrame, *columns: str) -> DataFrame:
    bad = F.lit(False)
    for c in columns:
        bad = bad | F.coalesce(F.isnan(c), F.lit(False))
    return log.where(bad)
