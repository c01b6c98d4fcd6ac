"""Command line: check, build, migrate and compare, each a few calls of the library over files that Spark reads.

Exit codes: 0 all well, 1 a contract is broken, 2 wrong use.
"""

from __future__ import annotations

import argparse
import sys
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkward.functions import pyast, rules
from sparkward.functions import text as T
from sparkward.operators import compare, dataset, diversity, generate, preparation
from sparkward.sources import json_tables, sinks
from sparkward.sources.contracts import ContractError

#: Rows of a build by default, and the least and the most; the share of the evaluation split.
TOTAL, BOUNDS, RATIO = 2500, (20, 8000), 0.12
_ROW = {n: "string" for n in ("id", "instruction", "input", "output", "attack_type", "difficulty", "task_type")} | {"expected_vulnerable": "boolean"}


def check(spark: SparkSession, paths: Sequence[str], quiet: bool = False) -> int:
    """Whether every output of every dataset is there and parses; the counts of each file are printed."""
    failures = 0
    for path in paths:
        try:
            rows = json_tables.fields(json_tables.load_array(spark, path), {"output": "string"})
        except (ContractError, OSError) as e:
            print(f"{path}: {e}", file=sys.stderr)
            failures += 1
            continue
        told = rows.withColumn("ok", pyast.parse_column(F.col("output"))["ok"])
        r = diversity.compliance(told, F.col("output"), F.col("ok"), rules.rule_hits(F.col("output"), rules.TARGET_RULES, False)).first()
        bad = r["empty_output"] + r["ast_parse_failed"]
        failures += bad > 0
        if bad or not quiet:
            print(f"{path}: {r['n']} rows, {r['empty_output']} empty, {r['ast_parse_failed']} that do not parse, {r['unsafe_pattern']} unsafe, {r['parse_pass_pct']:.4f} % parse")
    return 1 if failures else 0


def build(spark: SparkSession, path: str, total: int = TOTAL, ratio: float = RATIO) -> dict[str, int]:
    """Training and evaluation rows and preference pairs, as three folders of the path. Returns their sizes."""
    if not BOUNDS[0] <= total <= BOUNDS[1]:
        raise ContractError(f"total must lie in {BOUNDS}")
    n, held = dataset.split_sizes(total, ratio)
    train, evaluation = generate.fill_plan(spark, n), generate.fill_plan(spark, held, "eval", used=n)
    train = train.withColumn("ord", F.col("bucket") * total + F.col("i"))
    tried = preparation.build_pairs(train, "ord").where("outcome = 'ok'")
    pairs = preparation.sampled_pairs(preparation.quota_of_tiers(tried, "ord"), [F.col("ord"), F.col("attack_type")])
    rows = dataset.eval_prompt_row(evaluation)
    sinks.write_training(train.drop("ord").withColumn("id", T.stable_id(F.col("task_type"), F.col("attack_type"), F.col("instruction"), F.col("input"))), rows, pairs.drop("ord", "steps"), path, "id")
    return {"train": n, "eval": held, "pairs": spark.read.text(f"{path}/pairs").count()}


def migrate(spark: SparkSession, source: str, path: str) -> int:
    """An old dataset as research records, in a folder for each task. Returns the number of rows."""
    rows = json_tables.fields(json_tables.records_only(json_tables.load_rows(spark, source)), _ROW)
    records = dataset.research_record(dataset.normalised_rows(rows))
    sinks.write_splits(records, path)
    return records.count()


def compared(spark: SparkSession, paths: Sequence[str], baseline: str = "baseline") -> DataFrame:
    """Headline figures of result documents and by how much each lies below the baseline's injection rate."""
    results = json_tables.load_results(spark, *paths)
    named = results.select("path", F.coalesce(F.try_variant_get("doc", "$.meta.model", "string"), F.col("path")).alias("model"))
    got = json_tables.summaries(results, sql_injection_rate_valid="sql_injection_rate_valid double", extraction_failure_rate="extraction_failure_rate double", strict_f1="strict_metrics.f1 double")
    blocks = named.join(got, "path").drop("path")
    if not blocks.where(F.col("model") == baseline).head(1):
        raise ContractError(f"no result of the baseline {baseline!r}")
    return compare.drop_against(blocks, F.col("model") == baseline, "sql_injection_rate_valid")


def main(argv: Sequence[str] | None = None, spark: SparkSession | None = None) -> int:
    parser = argparse.ArgumentParser(prog="sparkward")
    commands = parser.add_subparsers(dest="command", required=True)
    c = commands.add_parser("check")
    c.add_argument("paths", nargs="+")
    c.add_argument("--quiet", action="store_true")
    b = commands.add_parser("build")
    b.add_argument("path")
    b.add_argument("--total", type=int, default=TOTAL)
    b.add_argument("--ratio", type=float, default=RATIO)
    m = commands.add_parser("migrate")
    m.add_argument("source")
    m.add_argument("path")
    r = commands.add_parser("compare")
    r.add_argument("paths", nargs="+")
    try:
        args = parser.parse_args(argv)
    except SystemExit as e:
        return 2 if e.code else 0
    spark = spark or SparkSession.builder.appName("sparkward").getOrCreate()
    try:
        if args.command == "check":
            return check(spark, args.paths, args.quiet)
        if args.command == "build":
            print(build(spark, args.path, args.total, args.ratio))
        elif args.command == "migrate":
            print(migrate(spark, args.source, args.path))
        else:
            print("\n".join(sinks.text_table(compared(spark, args.paths), "model", ["sql_injection_rate_valid", "extraction_failure_rate", "strict_f1"], "model")))
    except ContractError as e:
        print(e, file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
