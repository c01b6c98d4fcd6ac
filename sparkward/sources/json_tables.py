"""JSON sources: arrays and lines told apart by their first letter, read as variants so that token types are kept."""

from __future__ import annotations

import functools
import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkward.scratch import written
from sparkward.sources.contracts import ContractError

BOM = "﻿"


def numbered_lines(spark: SparkSession, *paths: str) -> DataFrame:
    """(ord, path, line): the lines of text files that are not blank, numbered from 0 in the order of files and lines.

    The number is a distributed prefix sum. A file is read in blocks; what each block holds is counted where it is read,
    the counts (a row for each block) are summed in the order of paths and places, and a line's number is its place in its
    block plus that sum. The sums are a small table, so lines are not shuffled. Files stand in the order of their names, the paths in the order given.
    """
    lines = _read(spark, paths, "value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"))
    lines = lines.select("nth", "path", "block", F.regexp_replace("value", f"^{BOM}", "").alias("line")).where(F.trim("line") != "")
    rows = lines.withColumn("at", F.monotonically_increasing_id())  # rises by one within a block
    blocks = rows.groupBy("nth", "path", "block").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    sums = F.sum("n").over(Window.orderBy("nth", "path", "block").rowsBetween(Window.unboundedPreceding, -1))
    offsets = written(spark, blocks.select("nth", "path", "block", "first", F.coalesce(sums, F.lit(0)).alias("before")), "offsets")
    return rows.join(offsets, ["nth", "path", "block"]).select((F.col("before") + F.col("at") - F.col("first")).alias("ord"), "path", "line")


def _read(spark: SparkSession, paths: tuple[str, ...], *columns, **options) -> DataFrame:
    """Text files with the place of their path among the paths."""
    return functools.reduce(DataFrame.unionByName, (spark.read.text(p, **options).select(F.lit(i).alias("nth"), *columns) for i, p in enumerate(paths)))


def load_rows(spark: SparkSession, *paths: str) -> DataFrame:
    """(ord, value): every record of JSON arrays or JSON-lines files as a variant, numbered through all of them.

    Blank lines are skipped. Without any line it raises; a line that is no JSON has a null value (see bad_rows). An array
    whose elements stand on lines of their own, as write_array lays it out, is read in blocks like lines; any other array
    is one document, read by one task.
    """
    rows = numbered_lines(spark, *paths)
    head = rows.where("ord = 0").select("line").collect()
    if not head:
        raise ContractError(f"{', '.join(paths)}: no records")
    if not head[0]["line"].lstrip().startswith("["):
        return rows.select("ord", F.try_parse_json("line").alias("value"))
    elements = _array_lines(rows)
    if elements is not None:
        return elements
    whole = _read(spark, paths, F.col("_metadata.file_path").alias("path"), F.try_variant_get(F.try_parse_json(F.regexp_replace("value", f"^{BOM}", "")), "$", "array<variant>").alias("v"), wholetext=True)
    if whole.where("v is null").head(1):
        raise ContractError(f"{', '.join(paths)}: not a JSON array")
    sums = F.sum("n").over(Window.orderBy("nth", "path").rowsBetween(Window.unboundedPreceding, -1))
    before = whole.select("nth", "path", F.size("v").cast("long").alias("n")).select("nth", "path", F.coalesce(sums, F.lit(0)).alias("before"))
    elements = whole.select("nth", "path", F.posexplode("v").alias("pos", "value"))
    return elements.join(before, ["nth", "path"]).select((F.col("before") + F.col("pos")).alias("ord"), "value")


def _array_lines(rows: DataFrame) -> DataFrame | None:
    """(ord, value) of an array whose brackets and elements stand on lines of their own; None for any other text.

    Commas stand at the beginning of all elements but the first, or at the end of all but the last.
    """
    text = F.trim("line")
    told = rows.select("ord", "line", F.startswith(text, F.lit(",")).alias("leads"), F.endswith(text, F.lit(",")).alias("trails"), F.try_parse_json(F.regexp_replace(text, r"^,|,$", "")).alias("value"))
    inner = ~text.isin("[", "]")
    got = told.agg(
        F.count_if(inner).alias("n"), F.count_if(inner & F.col("value").isNull()).alias("broken"), F.count_if("leads").alias("leads"), F.count_if("trails").alias("trails"), F.count_if(F.col("leads") & F.col("trails")).alias("both"),
        F.count_if(text == "[").alias("opens"), F.count_if(text == "]").alias("closes"), F.min_by(text, "ord").alias("first"), F.max_by(text, "ord").alias("last"), F.count_if((F.col("ord") == 1) & F.col("leads")).alias("early"), F.max_by("trails", F.when(inner, F.col("ord"))).alias("late"),
    ).first()
    commas = got["leads"] + got["trails"] == max(0, got["n"] - 1) and not (got["leads"] and got["trails"]) and not got["early"] and not got["late"]
    if (got["first"], got["last"], got["opens"], got["closes"], got["broken"], got["both"]) != ("[", "]", 1, 1, 0, 0) or not commas:
        return None
    return told.where(inner).select((F.col("ord") - 1).alias("ord"), "value")


def load_array(spark: SparkSession, path: str) -> DataFrame:
    """As load_rows, but the file must hold an array."""
    first = numbered_lines(spark, path).where("ord = 0").select(F.substring(F.ltrim("line"), 1, 1)).head(1)
    if not first or first[0][0] != "[":
        raise ContractError(f"{path}: the top level must be an array")
    return load_rows(spark, path)


def bad_rows(rows: DataFrame) -> DataFrame:
    return rows.where("value is null")


def fields(rows: DataFrame, names: dict[str, str]) -> DataFrame:
    """Columns of the given types from the variants; a token of another type gives null."""
    return rows.select("ord", *(F.try_variant_get("value", f"$.{n}", kind).alias(n) for n, kind in names.items()))


def legacy_sections(rows: DataFrame, prompt: str = "prompt") -> DataFrame:
    """Columns instruction, input and response from '### ...:' sections; without them the whole prompt is the instruction."""
    part = lambda name: F.regexp_extract(prompt, rf"(?s)### {name}:\s*(.*?)(?=### (?:Instruction|Input|Response):|\z)", 1)
    has = F.contains(F.col(prompt), F.lit("### Instruction:"))
    cut = lambda name: F.regexp_replace(part(name), r"(?U)^\s+|\s+$", "")
    return rows.select("*", F.when(has, cut("Instruction")).otherwise(F.col(prompt)).alias("instruction"), F.when(has, cut("Input")).otherwise("").alias("input"), F.when(has, cut("Response")).otherwise("").alias("response"))


def records_only(rows: DataFrame) -> DataFrame:
    """Rows whose value is an object; old files hold other things in between, which are dropped."""
    return rows.where(F.coalesce(F.startswith(F.schema_of_variant("value"), F.lit("OBJECT")), F.lit(False)))


# Names of columns and keys.
#: Columns of a preference file: three that must be there and seven that may. Others, such as the tier, are not read.
PREFERENCE = ("prompt", "chosen", "rejected")
PREFERENCE_TAGS = {"attack_type": "string", "difficulty": "string", "task_type": "string", "expected_vulnerable": "boolean", "schema_table": "string", "schema_column": "string", "chosen_framework": "string"}


def load_preferences(spark: SparkSession, path: str) -> DataFrame:
    """Preference pairs from JSON lines. Raises if a line is no JSON or lacks one of the three texts."""
    rows = load_rows(spark, path)
    got = fields(rows, dict.fromkeys(PREFERENCE, "string") | PREFERENCE_TAGS)
    lacking = [F.count_if(F.col(n).isNull()).alias(n) for n in PREFERENCE]
    counts = got.agg(*lacking).first().asDict()
    if any(counts.values()):
        raise ContractError(f"{path}: rows without " + ", ".join(f"{n} ({k})" for n, k in counts.items() if k))
    return got.drop("ord")


#: Keys that the summary of a result document must have.
SUMMARY_KEYS = ("n_samples", "n_valid", "n_invalid", "extraction_failure_rate", "sql_injection_rate_valid", "safe_rate_valid", "valid_only_metrics", "conservative_metrics", "strict_metrics")
PLOT_KEYS = SUMMARY_KEYS[3:6]


def load_results(spark: SparkSession, *paths: str, required: tuple[str, ...] = SUMMARY_KEYS, tolerant: bool = False) -> DataFrame:
    """(path, doc): result documents {meta, summary, per_sample} as variants, a row for each file.

    A file that is no JSON or whose summary lacks a required key raises; with tolerant it is left out, and so is a path
    where no file is. Documents are read by tasks, one for each file; nothing of them comes to the driver but missing keys.
    """
    there = [p for p in paths if not tolerant or _exists(spark, p)]
    if not there:
        return spark.range(0).select(F.lit("").alias("path"), F.try_parse_json(F.lit("null")).alias("doc"))
    read = spark.read.text(list(there), wholetext=True).select(F.input_file_name().alias("path"), F.try_parse_json(F.regexp_replace("value", f"^{BOM}", "")).alias("doc"))
    lacks = F.array_compact(F.array(*(F.when(F.try_variant_get("doc", f"$.summary.{k}", "variant").isNull(), F.lit(k)) for k in required)))
    told = read.withColumn("lacks", F.when(F.col("doc").isNull(), F.array(F.lit("JSON"))).otherwise(lacks))
    if tolerant:
        return told.where(F.size("lacks") == 0).drop("lacks")
    bad = told.where(F.size("lacks") > 0).select("path", "lacks").limit(5).collect()
    if bad:
        raise ContractError("; ".join(f"{r['path']}: summary lacks {', '.join(r['lacks'])}" for r in bad))
    return told.drop("lacks")


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def summaries(results: DataFrame, **columns: str) -> DataFrame:
    """Columns from the summaries: name = 'path type', as in n='n_samples bigint'; what is missing or no such value is null."""
    return results.select("path", *(F.try_variant_get("doc", f"$.summary.{spec.split()[0]}", spec.split()[1]).alias(n) for n, spec in columns.items()))


def per_sample(results: DataFrame, names: dict[str, str]) -> DataFrame:
    """(path, pos, columns): a row for each element of per_sample, which must be a list."""
    listed = F.try_variant_get("doc", "$.per_sample", "array<variant>")
    checked = F.when(listed.isNull(), F.raise_error(F.concat("path", F.lit(": per_sample is no list")))).otherwise(listed)
    rows = results.select("path", F.posexplode(checked).alias("pos", "value"))
    return rows.select("path", "pos", *(F.try_variant_get("value", f"$.{n}", kind).alias(n) for n, kind in names.items()))


def load_config(path: str, over: str | None = None) -> dict:
    """A YAML configuration, with that of a second file on top of it. A driver-side file."""
    import yaml  # only where configurations are read

    docs = []
    for p in (path, over):
        if p is not None:
            with open(p, encoding="utf-8-sig") as f:
                docs.append(yaml.safe_load(f) or {})
    return deep_merge(docs[0], docs[1]) if len(docs) > 1 else docs[0]


def best_checkpoint(folder: str) -> tuple[str, dict | None]:
    """(folder of the best checkpoint, its marker); the folder itself and None if there is no marker, the marker cannot be
    read, or the folder that it names is missing or empty."""
    root = Path(folder)
    try:
        marker = json.loads((root / "best_checkpoint.json").read_text(encoding="utf-8"))
        best = Path(marker["output_dir"])
        filled = any(best.iterdir())
    except (OSError, ValueError, KeyError, TypeError):
        return folder, None
    return (str(best), marker) if filled else (folder, None)


def deep_merge(base: dict, over: dict) -> dict:
    """over on top of base; two dictionaries are merged, anything else is replaced."""
    out = dict(base)
    for k, v in over.items():
        out[k] = deep_merge(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else v
    return out
