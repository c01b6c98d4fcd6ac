"""Training data: code-only targets, preflight checks, prompt and completion texts, token ids with masks."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import reduce
from os.path import commonprefix

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T_

from sparkward.functions import once, pyast, rewrites, rules
from sparkward.functions import text as T
from sparkward.operators import dataset, detection
from sparkward.operators.metrics import ratio
from sparkward.sources.contracts import ContractError

# Texts that a training target must not hold.
SCAFFOLD = ("[SECURITY WARNING]", "[EXPLANATION]", "[SAFE SOLUTION]", "### Response", "### Solution", "### Test", "# ref=")
Encode = Callable[[str, bool], list[int]]


def has_scaffold(output: Column) -> Column:
    return reduce(lambda a, b: a | b, (F.coalesce(F.contains(output, F.lit(t)), F.lit(False)) for t in SCAFFOLD))


def valid_target(output: Column) -> Column:
    """Not blank, parses, and matches no unsafe pattern."""
    return (T.strip(F.coalesce(output, F.lit(""))) != "") & pyast.parse_column(T.strip(output))["ok"] & rules.target_is_safe(output)


def code_only_targets(rows: DataFrame, output: str = "output") -> DataFrame:
    """rows with the output as code only and dropped_reason: null, no_code or parse_error. Drop where it is not null."""
    made = rows.withColumn(output, pyast.code_only_column(F.col(output)))
    ok = pyast.parse_column(F.col(output))["ok"]
    return made.withColumn("dropped_reason", F.when(F.col(output).isNull(), "no_code").when(~ok, "parse_error"))


def preflight(rows: DataFrame, output: str = "output", check_patterns: bool = False) -> DataFrame:
    """The rows to train on. Raises if none is left, or one holds scaffold (or, if asked, an unsafe pattern)."""
    kept = code_only_targets(rows, output).where("dropped_reason is null").drop("dropped_reason")
    bad = [F.count_if(has_scaffold(F.col(output))), F.count_if(~rules.target_is_safe(F.col(output))) if check_patterns else F.lit(0)]
    n, scaffold, unsafe = kept.agg(F.count("*"), *bad).first()
    if not n:
        raise ContractError("preflight: no row is left")
    if scaffold or unsafe:
        raise ContractError(f"preflight: {scaffold} targets with scaffold, {unsafe} with unsafe patterns")
    return kept


def prompt_completion(rows: DataFrame) -> DataFrame:
    """prompt and completion texts from instruction, input (or input_code) and output."""
    have = set(rows.columns)
    col = lambda n: F.coalesce(F.col(n).cast("string"), F.lit("")) if n in have else F.lit("")
    given = F.when(T.strip(col("input")) != "", col("input")).otherwise(col("input_code"))
    done = T.strip(col("output"))
    return rows.select("*", T.prompt(T.strip(col("instruction")), T.strip(given)).alias("prompt"), F.when(done != "", F.concat(done, F.lit("\n"))).otherwise("").alias("completion"))


def prompt_end(head: list[int], ids: list[int]) -> int:
    """How many of the ids are the prompt's: as far as its own ids go on being a beginning of the whole.

    A whole that is shorter than the prompt alone counts as prompt by half.
    """
    return len(commonprefix([head, ids])) if len(head) <= len(ids) else max(1, len(ids) // 2)


def masked_ids(prompt: str, completion: str, encode: Encode, longest: int, always: bool = True) -> tuple[list[int], list[int]]:
    """Ids of both texts together and 1 for those after the prompt; the last `longest` stay, at least one of them a 1.

    Where the prompt's own ids are no beginning of the whole, the longest common beginning is the prompt. Unless always,
    a whole that is not cut and ends with its prompt has no 1.
    """
    ids = encode(prompt + completion, True)
    cut = max(0, len(ids) - longest)
    edge = max(prompt_end(encode(prompt, True), ids) - cut, 0)
    edge = min(edge, len(ids) - cut - 1) if always or cut else edge
    return ids[cut:], [int(at >= edge) for at in range(len(ids) - cut)]


def pair_ids(prompt: str, chosen: str, rejected: str, encode: Encode, end: str, longest_prompt: int | None, longest: int | None) -> tuple[list[int], list[int], list[int], str | None, int]:
    """(prompt, chosen, rejected ids, why dropped, end marks added). A long prompt keeps its first id and its end."""
    answers = {x: x + end if end and x and not x.rstrip().endswith(end) else x for x in (chosen, rejected)}
    added = sum(answers[x] != x for x in (chosen, rejected))
    head = encode(prompt, True)

    def ids_of(answer: str) -> list[int]:
        # what the answer adds to the prompt's ids; an answer that adds none is read on its own
        return encode(prompt + answer, True)[len(head) :] or encode(answer, False)

    tails = [ids_of(answers[x]) for x in (chosen, rejected)]
    if longest_prompt is not None and len(head) > longest_prompt:
        head = [head[0], *head[len(head) - longest_prompt + 1 :]]
    room = math.inf if longest is None else longest - len(head)
    if max(map(len, tails)) > room:
        if room <= 0:
            return [], [], [], "prompt_too_long", added
        tails = [t[:room] for t in tails]
    if [] in tails:
        return [], [], [], "empty_completion", added
    return head, *tails, None, added


IDS = pa.list_(pa.int32())
#: Rows whose ids a worker holds as lists at a time.
SLICE = 256


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches in pieces of few rows: ids take many times the memory of their texts."""
    for b in batches:
        for at in range(0, b.num_rows, SLICE):
            yield b.slice(at, SLICE)


def tokenise(rows: DataFrame, encode: Encode, longest: int, keep: tuple[str, ...] = (), always: bool = True) -> DataFrame:
    """The columns in keep, then input_ids and completion_mask of prompt and completion; encode(text, special) runs on workers.

    always: as in masked_ids.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            made = [masked_ids(p, c, encode, longest, always) for p, c in zip(b["prompt"].to_pylist(), b["completion"].to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*(b[c] for c in keep), *(pa.array([m[i] for m in made], IDS) for i in (0, 1))], [*keep, "input_ids", "completion_mask"])

    some = rows.select(*keep, "prompt", "completion")
    schema = T_.StructType([some.schema[c] for c in keep] + [T_.StructField(n, T_.ArrayType(T_.IntegerType())) for n in ("input_ids", "completion_mask")])
    return some.mapInArrow(run, schema)


def tokenise_pairs(rows: DataFrame, encode: Encode, end: str, longest_prompt: int | None, longest: int | None) -> DataFrame:
    """Ids of prompt, chosen and rejected, dropped (why, or null) and the number of end marks added."""
    names = ("prompt_ids", "chosen_ids", "rejected_ids", "dropped", "ends")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            made = [pair_ids(*t, encode, end, longest_prompt, longest) for t in zip(*(b[c].to_pylist() for c in ("prompt", "chosen", "rejected")), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([m[i] for m in made], kind) for i, kind in enumerate((IDS, IDS, IDS, pa.string(), pa.int32()))], list(names))

    return rows.select("prompt", "chosen", "rejected").mapInArrow(run, "prompt_ids array<int>, chosen_ids array<int>, rejected_ids array<int>, dropped string, ends int")


def pair_token_stats(ids: DataFrame) -> DataFrame:
    kept = F.col("dropped").isNull()
    size = lambda c: F.when(kept, F.size(c))
    total = size("prompt_ids") + F.greatest(size("chosen_ids"), size("rejected_ids"))
    return ids.agg(
        F.count("*").alias("total"), F.count_if(kept).alias("kept"), F.count_if(F.col("dropped") == "prompt_too_long").alias("dropped_trunc"), F.count_if(F.col("dropped") == "empty_completion").alias("dropped_empty"),
        F.coalesce(F.sum("ends"), F.lit(0)).alias("eos_appended"), *(F.coalesce(F.max(size(f"{n}_ids")), F.lit(0)).alias(f"max_{n}_len") for n in ("prompt", "chosen", "rejected")), F.coalesce(F.max(total), F.lit(0)).alias("max_total_len"),
    )


def build_pairs(rows: DataFrame, ordinal: str) -> DataFrame:
    """Every (row, attack type) that was tried: chosen, rejected, tier, outcome (ok, or why the pair is none) and steps.

    Rows have instruction, input, output, expected_vulnerable and perhaps difficulty; only rows that are expected to be
    vulnerable and whose code parses and is safe give pairs. steps names the tests that were passed, in order: a trace of
    how far the pair came. A text without a bound query of its own gets the aligned variant of its main function. Keep outcome = 'ok', then quota_of_tiers, then sampled_pairs.
    """
    difficulty = F.col("difficulty") if "difficulty" in rows.columns else F.lit("medium")
    asked = rows.withColumn("__difficulty", difficulty).where("expected_vulnerable").select(ordinal, "instruction", "__difficulty", F.col("input").cast("string").alias("input"), F.col("output").cast("string").alias("output"))
    told = once.of_each(asked, ["input", "output"], _tried)
    return told.select(
        ordinal, T.prompt(F.col("instruction"), F.col("input")).alias("prompt"), "chosen", "rejected", F.col("attack").alias("attack_type"), dataset.tier_of(F.col("attack")).alias("tier"),
        F.col("__difficulty").alias("difficulty"), "schema_table", "schema_column", "framework", "driver", "outcome", "steps", "iso_reason",
    )


def _tried(kinds: DataFrame) -> DataFrame:
    """What build_pairs says of each different input and output: a row for each attack type."""
    safe = kinds.withColumn("chosen", pyast.code_only_column(F.col("output"))).where("chosen is not null")
    safe = safe.where(pyast.parse_column(F.col("chosen"))["ok"]).where(rules.target_is_safe(F.col("chosen")))
    tried = safe.withColumn("attack", F.explode(F.array(*(F.lit(a) for a, _ in dataset.ATTACKS))))
    schema = detection.schema_of(F.lit(None).cast("string"), F.lit(None).cast("string"), F.col("input"))
    made = tried.withColumn("rejected", rewrites.variant_column(F.col("chosen"), F.col("attack"), *schema))
    told = made.withColumn("iso", pyast.isomorphic_column(F.col("chosen"), F.col("rejected")))
    tests = {"no_variant": F.col("rejected").isNotNull(), "identical": T.strip(F.col("chosen")) != T.strip(F.col("rejected")), "not_unsafe": ~rules.target_is_safe(F.col("rejected")), "not_isomorphic": F.col("iso.ok")}
    outcome = reduce(lambda out, t: out.when(~F.coalesce(t[1], F.lit(False)), t[0]), list(tests.items())[1:], F.when(~tests["no_variant"], "no_variant")).otherwise("ok")
    told = told.withColumn("outcome", outcome)
    names = F.array(F.lit("variant"), F.lit("differs"), F.lit("unsafe"), F.lit("isomorphic"))
    reached = F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, tests)), F.col("outcome")), F.lit(0)) - 1, F.lit(len(tests)))
    return told.select(
        "input", "output", "chosen", "rejected", "attack", *(c.alias(n) for c, n in zip(schema, ("schema_table", "schema_column"), strict=True)), T.framework_of(F.col("chosen")).alias("framework"),
        T.driver_of(F.col("chosen")).alias("driver"), "outcome", F.slice(names, F.lit(1), reached.cast("int")).alias("steps"), F.col("iso.reason").alias("iso_reason"),
    )


def quota_of_tiers(pairs: DataFrame, ordinal: str, tier: str = "tier", total: int = 6000, shares: dict[str, float] = dataset.TIER_SHARES) -> DataFrame:
    """pairs of the first rows of each tier, until int(share * total) pairs are reached.

    The quota is looked at before a row, not before a pair, so the last row may pass it. A row of a tier has at least one
    pair, so only as many rows as the quota has pairs are ranked, and they are limited in each task before they meet. Tiers
    without a share have no quota.
    """
    quota = reduce(lambda q, s: q.when(F.col(tier) == s[0], int(s[1] * total)), shares.items(), F.when(F.lit(False), 0))
    most = max(int(s * total) for s in shares.values())
    order = Window.partitionBy(tier).orderBy(ordinal)
    rows = pairs.groupBy(tier, ordinal).agg(F.count("*").alias("__n"))
    first = dataset.first_of_tiers(rows, tier, [F.col(ordinal)], most, shares)
    before = F.coalesce(F.sum("__n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    kept = first.withColumn("__before", before).where(F.col("__before") < quota).select(tier, ordinal)
    return pairs.join(kept, [tier, ordinal], "left_semi")


def sampled_pairs(pairs: DataFrame, key: list[Column], total: int = 2000, seed: int = 42) -> DataFrame:
    """At most total pairs: the tiers' shares by a seeded draw, topped up from the rest."""
    drawn = pairs.withColumn("__draw", dataset.draw(seed, *key))
    return dataset.tier_sample(drawn, "tier", [F.col("__draw")], total).drop("__draw", "picked")


def pair_stats(pairs: DataFrame) -> DataFrame:
    """n by tier and outcome, with the share of its tier."""
    counts = pairs.groupBy("tier", "outcome").agg(F.count("*").alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("tier")))


def pair_report(pairs: DataFrame) -> DataFrame:
    """By tier: pairs tried and kept, the share of the tier among the kept, and the share of isomorphic ones among those
    that came to that test."""
    kept, came = F.col("outcome") == "ok", F.col("outcome").isin("ok", "not_isomorphic")
    got = pairs.groupBy("tier").agg(F.count("*").alias("tried"), F.count_if(kept).alias("kept"), F.count_if(came).alias("came"))
    return got.select("tier", "tried", "kept", ratio(F.col("kept"), F.sum("kept").over(Window.partitionBy())).alias("share"), ratio(F.col("kept"), F.col("came")).alias("isomorphic_rate"))


def outcome_counts(pairs: DataFrame) -> DataFrame:
    """(scope, attack_type, difficulty, outcome, framework, n): pairs by attack, attack and difficulty, outcome, framework,
    attack and framework. One pass: a grouping set for each."""
    sets = {"attack_type": ["attack_type"], "attack_type,difficulty": ["attack_type", "difficulty"], "outcome": ["outcome"], "framework": ["framework"], "attack_type,framework": ["attack_type", "framework"]}
    names = ["attack_type", "difficulty", "outcome", "framework"]
    got = pairs.groupingSets(list(sets.values()), *names).agg(F.count("*").alias("n"), F.grouping_id().alias("g"))
    numbers = {sum(1 << (3 - k) for k, n in enumerate(names) if n not in by): scope for scope, by in sets.items()}
    scope = reduce(lambda w, x: w.when(F.col("g") == x[0], x[1]), numbers.items(), F.when(F.lit(False), ""))
    return got.select(scope.alias("scope"), *names, "n")
