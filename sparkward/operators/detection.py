"""Detectors over a table of code: the external analyser (where it is installed), rules, static taint, and their merge."""

from __future__ import annotations

import json
import os
import shutil
import subprocess
import tempfile

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkward.functions import rules, taint

ISSUE = "array<struct<test_id: string, severity: string, confidence: string, text: string, line_number: int>>"
TOOL = "bandit"
#: Seconds that the tool may take for a text.
TIMEOUT = 30
SQL_TEST = "B608"


def normalised_issues(report: Column) -> Column:
    """Issues of an analyser's JSON report: missing fields are UNKNOWN, a line that is no number is -1; bad JSON has none."""
    raw = F.try_variant_get(F.try_parse_json(report), "$.results", "array<variant>")
    get = lambda x, *names: F.coalesce(*(F.try_variant_get(x, f"$.{n}", "string") for n in names))
    issue = lambda x: F.struct(
        F.coalesce(get(x, "test_id"), F.lit("UNKNOWN")).alias("test_id"), F.coalesce(get(x, "issue_severity", "severity"), F.lit("UNKNOWN")).alias("severity"),
        F.coalesce(get(x, "issue_confidence", "confidence"), F.lit("UNKNOWN")).alias("confidence"), F.coalesce(get(x, "issue_text", "text"), F.lit("")).alias("text"),
        F.coalesce(get(x, "line_number").try_cast("int"), F.lit(-1)).alias("line_number"),
    )
    return F.coalesce(F.transform(raw, issue), F.array().cast(ISSUE))


def _failed(why: str) -> str:
    return json.dumps({"errors": [{"reason": why}], "results": []})


def _of_one(tool: str, path: str) -> str:
    try:
        return subprocess.run([tool, "-q", "-f", "json", path], capture_output=True, text=True, check=False, timeout=TIMEOUT).stdout or _failed("no output")
    except subprocess.TimeoutExpired:
        return _failed(f"no report within {TIMEOUT} s")
    except OSError as e:
        return _failed(type(e).__name__)


def _reports(codes: pd.Series) -> pd.Series:
    """One run of the tool for a batch, its issues told apart by file; where that fails, one run for each row."""
    tool = shutil.which(TOOL)
    if tool is None or not len(codes):
        return pd.Series([None] * len(codes), dtype=object)
    with tempfile.TemporaryDirectory() as folder:
        paths = []
        for i, code in enumerate(codes):
            paths.append(os.path.join(folder, f"{i}.py"))
            with open(paths[-1], "w", encoding="utf-8", errors="surrogatepass") as f:
                f.write(code if isinstance(code, str) else "")
        try:
            told = json.loads(subprocess.run([tool, "-q", "-f", "json", *paths], capture_output=True, text=True, check=False, timeout=TIMEOUT * len(paths)).stdout)
            by_file: dict[str, list] = {p: [] for p in paths}
            for issue in told["results"]:
                by_file[issue["filename"]].append(issue)
            return pd.Series([json.dumps({"results": by_file[p]}) for p in paths], dtype=object)
        except (subprocess.TimeoutExpired, OSError, ValueError, KeyError, TypeError):
            return pd.Series([_of_one(tool, p) for p in paths], dtype=object)


def analyser_report(code: Column) -> Column:
    """The analyser's JSON; null where the tool is not installed on the worker, which reads as skipped.

    A text on which it hangs or fails has a report without issues that says so; the task goes on.
    """
    return F.pandas_udf(_reports, "string")(code)


def detect(rows: DataFrame, code: str = "code", mode: str = "or", use_rules: bool = True, use_taint: bool = False, report: Column | None = None, known: Column | None = None) -> DataFrame:
    """rows with columns of all detectors, the merged verdict and its sources.

    known is what taint_column said of the row's code already.

    report is the analyser's JSON for the row (a column of the table, or analyser_report); without one it is skipped.
    """
    text = F.coalesce(F.col(code), F.lit(""))
    none = F.array().cast(ISSUE)
    told = rows.withColumn("analyser_skipped", F.lit(True) if report is None else report.isNull())
    told = told.withColumn("issues", none if report is None else normalised_issues(report))
    b608 = F.exists("issues", lambda x: x["test_id"] == SQL_TEST)
    told = told.withColumns({"analyser_detected": F.size("issues") > 0, "analyser_b608": b608})
    told = told.withColumn("violations", rules.rule_hits(text) if use_rules else F.array().cast("array<string>"))
    told = told.withColumn("rule_based_detected", F.size("violations") > 0)
    if use_taint:
        told = told.withColumn("taint", taint.taint_column(text) if known is None else known)
    else:
        told = told.withColumn("taint", F.expr("named_struct('is_vulnerable', false, 'taint_flows_detected', 0, 'details', array(), 'error', cast(null as string))"))
    flags = [F.col("analyser_b608"), F.col("analyser_detected"), F.col("rule_based_detected"), F.col("taint.is_vulnerable")]
    return told.withColumns({"is_vulnerable": rules.merged_verdict(mode, *flags), "detection_sources": rules.detection_sources(mode, *flags)})


def execute_parameter(code: Column) -> Column:
    """The one parameter of cur.execute(sql, (x,)), or an empty string."""
    return F.regexp_extract(code, r"cur\.execute\(\s*sql\s*,\s*\(\s*(\w+)\s*,?\s*\)\s*\)", 1)


def schema_of(table: Column, column: Column, given: Column) -> tuple[Column, Column]:
    """(table, column) from the explicit fields or from the input text; null where neither says."""
    patterns = (r"DB table `([^`]+)`, column `([^`]+)`", r"Schema `([^`.]+)\.([^`]+)`", r"(?i)SELECT\s+\*\s+FROM\s+(\w+)\s+WHERE\s+(\w+)\s*=")
    both = (F.trim(F.coalesce(table, F.lit(""))) != "") & (F.trim(F.coalesce(column, F.lit(""))) != "")
    found = lambda i: F.coalesce(*(F.nullif(F.regexp_extract(F.coalesce(given, F.lit("")), p, i), F.lit("")) for p in patterns))
    return F.when(both, F.trim(table)).otherwise(found(1)), F.when(both, F.trim(column)).otherwise(found(2))
