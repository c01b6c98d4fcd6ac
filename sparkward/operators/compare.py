"""Comparing models: metric blocks, drop against the baseline, degenerate models, ablation tables, reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkward.functions import text as T
from sparkward.operators import metrics as M

# Methods in the order of reports.
METHODS = ("baseline", "prompt_only", "lora_sft", "lora_dpo", "qlora_sft", "qlora_dpo")


# Adapter folder, four-bit loading and result of each model.
RUNS = {
    "baseline": (None, False, "baseline_results"), "lora_only": ("lora_only_dir", False, "lora_only_results"), "lora_sft": ("lora_sft_dir", False, "lora_sft_results"), "lora_dpo": ("dpo_lora_dir", False, "lora_dpo_results"),
    "qlora_only": ("qlora_only_dir", True, "qlora_only_results"), "qlora_sft": ("qlora_sft_dir", True, "qlora_sft_results"), "qlora_dpo": ("qlora_dpo_dir", True, "qlora_dpo_results"), "always_safe_model": (None, False, "always_safe_results"),
}


def method_order(method: Column, methods: tuple[str, ...] = METHODS) -> Column:
    return F.array_position(F.array(*map(F.lit, methods)), method)


def model_blocks(verdicts: DataFrame, model: str = "model") -> DataFrame:
    """The headline metrics of every model, a row each, in one grouped pass."""
    return M.bundle(verdicts, model)


def drop_against(blocks: DataFrame, baseline: Column, metric: str, name: str = "pct_drop") -> DataFrame:
    """Per cent by which each row's metric lies below that of the baseline row; 0 where the baseline is not above 0."""
    base = blocks.where(baseline).agg(F.max(metric).alias("__base"))
    joined = blocks.crossJoin(base)  # one row
    return joined.withColumn(name, F.when(F.col("__base") > 0, (F.col("__base") - F.col(metric)) / F.col("__base") * 100).otherwise(0.0)).drop("__base")


def degenerate(verdicts: DataFrame, model: str, key: list[str], cells: list[str], order: Column) -> DataFrame:
    """Models whose whole sequence of verdicts equals that of an earlier model: (model, same_as, signature).

    A model's rows are hashed one by one and combined without order-dependent lists: each hash includes the row's key, so
    equal multisets of rows mean equal sequences. Two sums of independent hashes keep chance matches away. A model
    without rows has no signature and matches none.
    """
    row = [F.coalesce(F.col(c).cast("string"), F.lit("\u0000")) for c in (*key, *cells)]
    digest = F.sha2(F.concat_ws("\u0001", *row), 256)
    part = lambda at: F.conv(F.substring(digest, at, 15), 16, 10).cast("decimal(38,0)")
    signed = verdicts.groupBy(model).agg(F.count("*").alias("n"), F.sum(part(1)).alias("s1"), F.sum(part(16)).alias("s2"))
    signature = F.concat_ws(":", "n", "s1", "s2")
    w = Window.partitionBy("signature").orderBy(order)
    ranked = signed.withColumn("signature", signature).withColumn("same_as", F.first(model).over(w)).withColumn("rank", F.row_number().over(w))
    return ranked.where("rank > 1").select(model, "same_as", "signature")


def ablation_table(groups: DataFrame, results: DataFrame, kinds: tuple[str, ...] = ("sft", "dpo")) -> DataFrame:
    """Every group with every model kind, with its metrics where there are any."""
    return groups.crossJoin(groups.sparkSession.createDataFrame([(k,) for k in kinds], "kind string")).join(results, ["group", "kind"], "left")


def markdown_rows(table: DataFrame, labels: list[str], cells: list[str], missing: str = "N/A") -> DataFrame:
    """One text line of a Markdown table for each row. A missing figure is N/A, or 0.0000 in the second form of report."""
    figures = [F.when(F.col(c).isNull(), missing).otherwise(T.metric_cell(F.col(c))) for c in cells]
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("N/A")) for c in labels] + figures
    return table.select(*labels, F.concat(F.lit("| "), F.concat_ws(" | ", *parts), F.lit(" |")).alias("line"))


def wide_summary(blocks: DataFrame, model: str, cells: list[str]) -> DataFrame:
    """One row with columns {model}_{metric}."""
    names = [r[0] for r in blocks.select(model).distinct().orderBy(model).collect()]
    return blocks.agg(*(F.max(F.when(F.col(model) == n, F.col(c))).alias(f"{n}_{c}") for n in names for c in cells))


def without(rows: DataFrame, method: str, excluded: tuple[str, ...]) -> DataFrame:
    """Rows of the methods that are not named as excluded; a null method stays."""
    return rows.where(~F.coalesce(F.col(method).isin(*excluded), F.lit(False))) if excluded else rows


def recomputed(stored: DataFrame, verdicts: DataFrame, model: str, metrics: list[str], near: float = 1e-9) -> DataFrame:
    """(model, metric, stored, recomputed, agrees): the stored figures against those of the verdict rows.

    A model that only one side has is told with a null on the other; two nulls agree.
    """
    cast = lambda df, name: df.select(model, *(F.col(m).cast("double").alias(m) for m in metrics)).unpivot([model], metrics, "metric", name)
    both = cast(stored, "stored").join(cast(M.bundle(verdicts, model), "recomputed"), [model, "metric"], "full")
    same = F.col("stored").eqNullSafe(F.col("recomputed")) | F.coalesce(F.abs(F.col("stored") - F.col("recomputed")) <= near, F.lit(False))
    return both.withColumn("agrees", same)


def run_plan(models: DataFrame, model: str = "model") -> DataFrame:
    """Which adapter and output belong to each model and whether it is loaded in four bits; an unknown model raises."""
    plan = F.lit(None)
    for name, (adapter, four_bit, output) in RUNS.items():
        row = F.struct(F.lit(adapter).cast("string").alias("adapter"), F.lit(four_bit).alias("four_bit"), F.lit(output).alias("output"))
        plan = F.when(F.col(model) == name, row) if name == next(iter(RUNS)) else plan.when(F.col(model) == name, row)
    told = models.withColumn("__plan", plan.otherwise(F.raise_error(F.concat(F.lit("unknown model: "), F.coalesce(F.col(model), F.lit("null"))))))
    return told.select(*models.columns, "__plan.*")


def missing(expected: DataFrame, found: DataFrame, key: str) -> DataFrame:
    return expected.join(found.select(key).distinct(), key, "left_anti")
