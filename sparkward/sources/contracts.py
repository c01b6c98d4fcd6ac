"""Data contracts: declared schemas, strict type checks on JSON tokens, violation tables, fail-fast reports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as t

from sparkward.functions.text import blank_to_null, strip

SAMPLE = t.StructType([
    t.StructField("id", t.StringType(), False), t.StructField("task_type", t.StringType()), t.StructField("instruction", t.StringType()),
    t.StructField("input_code", t.StringType()), t.StructField("expected_vulnerable", t.BooleanType(), False),
    t.StructField("vulnerability_type", t.StringType()), t.StructField("difficulty", t.StringType()), t.StructField("output", t.StringType()),
])
PAIR = t.StructType([t.StructField(n, t.StringType(), n not in ("prompt", "chosen", "rejected")) for n in ("prompt", "chosen", "rejected", "attack_type", "difficulty", "task_type", "schema_table", "schema_column", "chosen_framework")] + [t.StructField("expected_vulnerable", t.BooleanType())])
#: Names of the attack types, difficulties and tasks.
KINDS = ("string_concat", "fstring", "format_string", "fake_sanitization", "orm_misuse", "parameterized_query", "indirect_injection")
DIFFICULTIES, TASKS = ("easy", "medium", "hard"), ("generation", "fix")
PREVIEW = 5


class ContractError(ValueError):
    """Rows break a contract; the message shows the first of them."""


def violations(rows: DataFrame, rules: dict[tuple[str, str], Column], ordinal: str, ident: str) -> DataFrame:
    """(ord, id, field, reason) of every rule that a row breaks; a rule holds where its column is true."""
    broken = [F.when(~F.coalesce(ok, F.lit(False)), F.struct(F.lit(f).alias("field"), F.lit(r).alias("reason"))) for (f, r), ok in rules.items()]
    some = rows.select(F.col(ordinal).alias("ord"), F.col(ident).cast("string").alias("id"), F.explode(F.array_compact(F.array(*broken))).alias("v"))
    return some.select("ord", "id", "v.field", "v.reason")


def verdict_rules() -> dict[tuple[str, str], Column]:
    """An invalid row has no verdict, a valid one has; truth is never null."""
    bad, said = F.col("invalid_extraction"), F.col("is_vulnerable")
    return {
        ("expected_vulnerable", "missing"): F.col("expected_vulnerable").isNotNull(),
        ("invalid_extraction", "missing"): bad.isNotNull(),
        ("is_vulnerable", "verdict on an invalid row"): ~(F.coalesce(bad, F.lit(False)) & said.isNotNull()),
        ("is_vulnerable", "no verdict on a valid row"): F.coalesce(bad, F.lit(True)) | said.isNotNull(),
    }


def sample_rules(rows: DataFrame) -> dict[tuple[str, str], Column]:
    """Non-blank id, tags and a prompt or instruction; truth present."""
    text = lambda c: F.coalesce(strip(F.col(c).cast("string")) != "", F.lit(False)) if c in rows.columns else F.lit(False)
    some = lambda *names: reduce(lambda a, b: a | b, map(text, names))
    return {
        ("id", "blank"): text("id"), ("prompt", "cannot be built"): some("prompt", "instruction"), ("vulnerability_type", "blank"): some("vulnerability_type", "attack_type"),
        ("difficulty", "blank"): text("difficulty"), ("task_type", "blank"): text("task_type"), ("expected_vulnerable", "missing"): F.col("expected_vulnerable").isNotNull(),
    }


def normalised_sample(rows: DataFrame) -> DataFrame:
    """Evaluation rows with a prompt and both names of the attack type."""
    from sparkward.functions.text import prompt

    have = set(rows.columns)
    col = lambda n: F.col(n).cast("string") if n in have else F.lit(None).cast("string")
    kind = F.coalesce(blank_to_null(col("vulnerability_type")), blank_to_null(col("attack_type")))
    given = F.coalesce(blank_to_null(col("input_code")), blank_to_null(col("input")))
    return rows.select(col("id").alias("id"), F.coalesce(blank_to_null(col("prompt")), prompt(col("instruction"), given)).alias("prompt"), col("instruction").alias("instruction"), given.alias("input_code"), col("output").alias("output"), kind.alias("attack_type"), kind.alias("vulnerability_type"), col("difficulty").alias("difficulty"), col("task_type").alias("task_type"), F.col("expected_vulnerable").alias("expected_vulnerable"))


def require(found: DataFrame, what: str, order: str = "ord") -> None:
    """Raise with a preview of the first violations, if there are any."""
    first = found.orderBy(order, "field", "reason").limit(PREVIEW).collect()
    if first:
        raise ContractError(f"{what}: " + "; ".join(f"row {r['ord']} ({r['id']!r}): {r['field']}: {r['reason']}" for r in first))


def watched(rows: DataFrame, rules: dict[tuple[str, str], Column], name: str) -> tuple[DataFrame, Observation]:
    """rows, and an observation that counts them and those that break a rule while something else reads them."""
    watch = Observation(name)
    good = reduce(lambda a, b: a & F.coalesce(b, F.lit(False)), rules.values(), F.lit(True))
    return rows.observe(watch, F.count(F.lit(1)).alias("rows"), F.count_if(~good).alias("broken")), watch


def sample_report(rows: DataFrame, truth: str = "expected_vulnerable") -> DataFrame:
    """total, valid, pct_valid, pos and neg of evaluation rows; a row is valid if it breaks no rule."""
    good = reduce(lambda a, b: a & F.coalesce(b, F.lit(False)), sample_rules(rows).values(), F.lit(True))
    got = rows.agg(F.count("*").alias("total"), F.count_if(good).alias("valid"), F.count_if(good & F.col(truth)).alias("pos"), F.count_if(good & ~F.col(truth)).alias("neg"))
    return got.select("total", "valid", F.coalesce(F.try_divide(100.0 * F.col("valid"), F.col("total").cast("double")), F.lit(0.0)).alias("pct_valid"), "pos", "neg")


def require_both_classes(rows: DataFrame, truth: str = "expected_vulnerable") -> dict[str, int]:
    """Row counts; raises if the table is empty or has one class only."""
    n, pos, neg = rows.agg(F.count("*"), F.count_if(F.col(truth)), F.count_if(~F.col(truth))).first()
    if n == 0:
        raise ContractError("no rows")
    if not pos or not neg:
        raise ContractError(f"one class only: {pos} positive, {neg} negative rows")
    return {"total": n, "positives": pos, "negatives": neg}


def token_type(value: Column, field: str) -> Column:
    """Type of a field's JSON token: BOOLEAN, STRING, BIGINT, VOID for null, null where it is missing."""
    return F.schema_of_variant(F.variant_get(value, f"$.{field}", "variant"))


def strict_boolean(value: Column, field: str) -> Column:
    """Whether the token is true or false, and not 0, 1 or a string."""
    return F.coalesce(token_type(value, field) == "BOOLEAN", F.lit(False))
