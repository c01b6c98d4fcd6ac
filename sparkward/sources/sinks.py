"""Sinks: split writers, JSON lines and arrays, result documents, reject files, tables for reports."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkward.sources import contracts


def publish(rows: DataFrame, path: str, rules: dict, what: str, ident: str = "id", by: tuple[str, ...] = ()) -> int:
    """Write rows as JSON lines and hold them to a contract in the same pass; the number of rows.

    Rows go to a folder beside the path while they are counted and judged. The copy's lines are counted too. Only if nothing
    is broken does the folder get its name, in place of what stood there; otherwise it is removed, what stood there stays,
    and the error shows the first violations.
    """
    spark = rows.sparkSession
    staged = f"{path.rstrip('/')}.{uuid.uuid4().hex[:12]}.staged"
    seen, watch = contracts.watched(rows, rules, what)
    fs = _file_system(spark, path)
    try:
        seen.write.partitionBy(*by).json(staged)
        told = watch.get
        if told["broken"]:
            contracts.require(contracts.violations(rows.withColumn("__ord", F.lit(0)), rules, "__ord", ident), what)
            raise contracts.ContractError(f"{what}: {told['broken']} rows broke the contract when they were written")
        if spark.read.text(staged).count() != told["rows"]:
            raise contracts.ContractError(f"{what}: the copy has another number of rows")
        fs.delete(_path(spark, path), True)
        if not fs.rename(_path(spark, staged), _path(spark, path)):
            raise OSError(f"{what}: {path} cannot be put in place")
        return told["rows"]
    finally:
        fs.delete(_path(spark, staged), True)


def _path(spark: SparkSession, path: str):
    return spark._jvm.org.apache.hadoop.fs.Path(path)


def _file_system(spark: SparkSession, path: str):
    return _path(spark, path).getFileSystem(spark._jsc.hadoopConfiguration())


def write_splits(rows: DataFrame, path: str, by: str = "task_type") -> None:
    """JSON lines in a folder for each task, if the contract holds."""
    publish(rows, path, contracts.sample_rules(rows), "split writer", by=(by,))


def write_lines(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def write_array(rows: DataFrame, path: str, order: str) -> None:
    """A folder of text files that are a JSON array when they are joined in the order of their names.

    Rows are sorted over all tasks and each stands on a line of its own, so no task or value holds the table; every line but the
    first begins with a comma. order names each row once.
    """
    least, n = rows.agg(F.min(order), F.count(order)).first()
    if least is not None and rows.where(F.col(order) == F.lit(least)).count() > 1 or n != rows.count():
        raise contracts.ContractError(f"{order} must name each row once")
    line = F.concat(F.when(F.col(order) == F.lit(least), "").otherwise(","), F.to_json(F.struct(*rows.columns)))
    items = rows.select(F.lit(1).alias("part"), F.col(order).alias("o"), line.alias("value"))
    ends = rows.sparkSession.createDataFrame([(0, "["), (2, "]")], "part int, value string").select("part", F.lit(None).cast(items.schema["o"].dataType).alias("o"), "value")
    items.unionByName(ends).orderBy("part", "o").select("value").write.mode("overwrite").text(path)


def write_checked(spark: SparkSession, rows: DataFrame, path: str) -> DataFrame:
    """JSON lines that the contract and a count of the copy have been held to, read again."""
    publish(rows, path, contracts.sample_rules(rows), "checked copy")
    return spark.read.schema(rows.schema).json(path)


def append_log(spark: SparkSession, rows: DataFrame, path: str, batch: int) -> None:
    """Append a batch to a log of JSON lines once: a batch that is written again takes the place of its first writing.

    Each batch is a folder of its own, which gets its name when it is complete. This is what foreachBatch needs, since a
    stream that is started again repeats its last batch.
    """
    staged, final = f"{path.rstrip('/')}/_staged-{uuid.uuid4().hex[:12]}", f"{path.rstrip('/')}/batch={batch:012d}"
    rows.write.json(staged)
    fs = _file_system(spark, path)
    fs.delete(_path(spark, final), True)
    if not fs.rename(_path(spark, staged), _path(spark, final)):
        raise OSError(f"{final} cannot be put in place")


def log_stream(stream: DataFrame, path: str, checkpoint: str, reject: str | None = None):
    """Append the rows of a stream that are rejected (or all) to a log, each batch once; returns the started query."""

    def write(rows: DataFrame, batch: int) -> None:
        append_log(rows.sparkSession, rows.where(reject) if reject else rows, path, batch)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def write_result(meta: dict, summary: DataFrame, per_sample: DataFrame, path: str) -> None:
    """{meta, summary} as one JSON text and the rows as JSON lines beside it: the form for rows of any number."""
    per_sample.sparkSession.createDataFrame([(json.dumps(meta, ensure_ascii=False),)], "meta string").crossJoin(summary.select(F.to_json(F.struct("*")).alias("s"))).select(
        F.concat(F.lit('{"meta": '), "meta", F.lit(', "summary": '), "s", F.lit("}")).alias("value")
    ).coalesce(1).write.mode("overwrite").text(f"{path}/document")
    per_sample.write.mode("overwrite").json(f"{path}/per_sample")


def nested_summary(bundle: DataFrame) -> Column:
    """The summary of a result document from the columns of a bundle row: headline figures, and a block for each policy."""
    heads = [c for c in bundle.columns if not c.startswith(("valid_only_", "conservative_", "strict_"))]
    blocks = [F.struct(*(F.col(c).alias(c.removeprefix(f"{p}_")) for c in bundle.columns if c.startswith(f"{p}_"))).alias(f"{p}_metrics") for p in ("valid_only", "conservative", "strict")]
    return F.struct(*heads, *blocks)


def write_document(meta: dict, bundle: DataFrame, per_sample: DataFrame, path: str, order: str) -> None:
    """One JSON document {meta, summary, per_sample}, as the loaders of results read it. per_sample is one value of one
    row here, so this form is for the rows of an evaluation, not for tables."""
    item = F.struct(F.col(order).alias("o"), F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("j"))
    rows = per_sample.agg(F.array_sort(F.collect_list(item)).alias("all")).select(F.array_join(F.transform("all", lambda x: x["j"]), ",\n").alias("rows"))
    head = bundle.select(F.to_json(nested_summary(bundle)).alias("summary")).limit(1)
    text = F.concat(F.lit('{"meta": ' + json.dumps(meta, ensure_ascii=False) + ', "summary": '), "summary", F.lit(', "per_sample": ['), "rows", F.lit("]}"))
    head.crossJoin(rows).select(text.alias("value")).coalesce(1).write.mode("overwrite").text(path)


def write_training(train: DataFrame, evaluation: DataFrame, pairs: DataFrame, path: str, order: str) -> None:
    """The three files of a build: train and eval as JSON arrays, preference pairs as JSON lines."""
    write_array(train, f"{path}/train", order)
    write_array(evaluation, f"{path}/eval", order)
    write_lines(pairs, f"{path}/pairs")


def write_rejects(rows: DataFrame, reject: str, order: str, path: str, limit: int, mode: str = "overwrite") -> None:
    """The first rows that are rejected, at most so many: a debugging aid, not data."""
    rows.where(reject).orderBy(order).limit(limit).write.mode(mode).json(path)


def table_lines(rows: DataFrame, label: str, cells: list[str], width: int = 10) -> DataFrame:
    """(label, line): fixed-width lines of a label and per cent cells; N/A for null."""
    from sparkward.functions.text import percent_cell

    return rows.select(label, F.concat(F.rpad(F.col(label).cast("string"), 20, " "), *(percent_cell(F.col(c), width) for c in cells)).alias("line"))


def text_table(rows: DataFrame, label: str, cells: list[str], order: str) -> list[str]:
    """The lines of a report, in order."""
    return [r["line"] for r in table_lines(rows.orderBy(order), label, cells).collect()]


def chart_table(blocks: DataFrame, model: str, cells: list[str]) -> DataFrame:
    """Tidy (model, metric, value) rows for bar charts."""
    return blocks.select(model, *(F.col(c).cast("double").alias(c) for c in cells)).unpivot([model], cells, "metric", "value")
