"""Building datasets: plans, quotas, keep-first deduplication, splits, samples, preference tiers, research records."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkward.functions import text as T

# Attack types with their weights, difficulty weights of both splits, task weights, tiers.
ATTACKS = (("string_concat", 0.05), ("fstring", 0.08), ("format_string", 0.08), ("fake_sanitization", 0.18), ("orm_misuse", 0.18), ("parameterized_query", 0.10), ("indirect_injection", 0.33))
DIFFICULTIES = {"train": (("easy", 0.20), ("medium", 0.40), ("hard", 0.40)), "eval": (("easy", 0.12), ("medium", 0.33), ("hard", 0.55))}
TASKS = (("fix", 0.5), ("generation", 0.5))
TIERS = {"string_concat": "easy", "fstring": "medium", "format_string": "medium"}
TIER_SHARES = {"easy": 0.30, "medium": 0.40, "hard": 0.30}


def bucket_plan(spark: SparkSession, total: int, split: str = "train") -> DataFrame:
    """Largest-remainder counts of the 42 buckets attack x difficulty x task; ties go to the earlier bucket."""
    one = spark.range(0, 1, 1, 1)
    dim = lambda rows, name: one.select(F.inline(F.array(*(F.struct(F.lit(i).alias(f"{name}_ord"), F.lit(v).alias(name), F.lit(w).alias(f"{name}_w")) for i, (v, w) in enumerate(rows)))))
    plan = dim(ATTACKS, "attack_type").crossJoin(dim(DIFFICULTIES[split], "difficulty")).crossJoin(dim(TASKS, "task_type"))
    plan = plan.withColumn("bucket", (F.col("attack_type_ord") * 3 + F.col("difficulty_ord")) * 2 + F.col("task_type_ord")).withColumn("weight", F.col("attack_type_w") * F.col("difficulty_w") * F.col("task_type_w"))
    return apportion(plan, F.col("weight"), total, F.col("bucket")).select("bucket", "attack_type", "difficulty", "task_type", "n")


def apportion(buckets: DataFrame, weight: Column, total: int, order: Column) -> DataFrame:
    """Column n: total dealt out by weight; whole shares first, what is left by the largest fractions. For small tables."""
    exact = total * weight / F.sum(weight).over(Window.partitionBy())
    shares = buckets.withColumn("__exact", exact).withColumn("__low", F.floor("__exact"))
    shares = shares.withColumn("__rank", F.row_number().over(Window.orderBy(F.desc(F.round(F.col("__exact") - F.col("__low"), 9)), order)))
    left = F.lit(total) - F.sum("__low").over(Window.partitionBy())
    return shares.withColumn("n", (F.col("__low") + F.when(F.col("__rank") <= left, 1).otherwise(0)).cast("long")).drop("__exact", "__low", "__rank")


def merge_splits(sources: list[DataFrame]) -> tuple[DataFrame, DataFrame]:
    """Concatenate sources and keep the first row of each id (or, without one, of each instruction and input).

    Every source has id, instruction, input, expected_vulnerable and ord, which is unique within it. Returns the kept rows
    and, for each source, kept, duplicates, positives and negatives. The first row is a minimum, combined before the
    shuffle, so a key that very many rows share costs no more than another.
    """
    every = None
    for i, s in enumerate(sources):
        part = s.withColumn("source_ord", F.lit(i))
        every = part if every is None else every.unionByName(part)
    has = T.strip(F.coalesce("id", F.lit(""))) != ""
    key = F.when(has, F.struct(F.lit("id").alias("kind"), F.col("id").alias("a"), F.lit("").alias("b"))).otherwise(F.struct(F.lit("content").alias("kind"), F.coalesce("instruction", F.lit("")).alias("a"), F.coalesce("input", F.lit("")).alias("b")))
    firsts = every.groupBy(key.alias("__key")).agg(F.min(F.struct("source_ord", "ord")).alias("f")).select(F.col("f.source_ord").alias("source_ord"), F.col("f.ord").alias("ord"))
    kept = every.join(firsts, ["source_ord", "ord"], "left_semi")
    told = kept.groupBy("source_ord").agg(F.count("*").alias("kept"), F.count_if("expected_vulnerable").alias("positives"), F.count_if(~F.col("expected_vulnerable")).alias("negatives"))
    sizes = every.groupBy("source_ord").agg(F.count("*").alias("n"))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long"))
    told = sizes.join(told, "source_ord", "left").select("source_ord", zero(F.col("kept")).alias("kept"), (F.col("n") - zero(F.col("kept"))).alias("duplicates"), zero(F.col("positives")).alias("positives"), zero(F.col("negatives")).alias("negatives"))
    return kept, told


def draw(seed: int, *key: Column) -> Column:
    """A hash that orders rows as a seeded shuffle does; the same for any partitioning."""
    return F.sha2(F.concat_ws("|", F.lit(str(seed)), *(k.cast("string") for k in key)), 256)


def smallest(rows: DataFrame, hashed: str, k: int, flag: str = "chosen") -> DataFrame:
    """rows with a flag: whether the row is among the k of least hash (a hex digest, distinct for distinct rows).

    Hashes are counted by their first four digits, so only the rows of one of 65,536 buckets are ranked, in one task.
    """
    bucket = F.substring(hashed, 1, 4)
    seen, border, before = 0, None, 0
    for r in rows.groupBy(bucket.alias("b")).count().orderBy("b").collect():
        before = seen
        seen += r["count"]
        if seen >= k:
            border = r["b"]
            break
    if border is None:
        return rows.withColumn(flag, F.lit(True))
    near = rows.where(bucket == border).select(hashed).orderBy(hashed).limit(k - before).agg(F.max(hashed)).first()[0] if k > before else ""
    return rows.withColumn(flag, F.col(hashed) <= F.lit(near or ""))


def train_val_split(rows: DataFrame, key: Column, ratio: float, seed: int = 42) -> DataFrame:
    """Column split: val for the greatest(1, floor(n * ratio)) rows of least seeded hash, else train."""
    hashed = rows.withColumn("__hash", draw(seed, key))
    n = rows.count()
    k = max(1, int(n * ratio))
    if n > 1 and k >= n:
        k = 1 if n == 1 else n - 1
    return smallest(hashed, "__hash", k, "__val").withColumn("split", F.when(F.col("__val"), "val").otherwise("train")).drop("__hash", "__val")


def split_sizes(total: int, ratio: float) -> tuple[int, int]:
    """(train, eval): eval is the ratio's share rounded half to even, at least 1 and less than all."""
    n = min(max(round(total * ratio), 1), total - 1)
    return total - n, n


def tier_of(attack: Column) -> Column:
    out = None
    for a, t in TIERS.items():
        out = F.when(attack == a, F.lit(t)) if out is None else out.when(attack == a, F.lit(t))
    return out.otherwise(F.lit("hard"))


def first_of_tiers(rows: DataFrame, tier: str, order: list[Column], k: int, shares: dict[str, float]) -> DataFrame:
    """The first k rows of each tier that has a share, and the first k of all others together.

    A sort with a limit keeps k rows in each task before any of them meet. The filter on a window's rank does so only up to
    a thousand rows; beyond that a tier would go to one task as a whole.
    """
    known = F.col(tier).isin(*shares)
    parts = [rows.where(F.col(tier) == t) for t in shares] + [rows.where(F.coalesce(~known, F.lit(True)))]
    return reduce(DataFrame.unionByName, (p.orderBy(*order).limit(k) for p in parts))


def tier_sample(rows: DataFrame, tier: str, order: list[Column], total: int, shares: dict[str, float] = TIER_SHARES) -> DataFrame:
    """At most share * total rows of each tier in the given order, then topped up to total from the rest in that order.

    Rows are limited in each task before they meet, so a tier of any size sends few of them. A tier without a share only
    tops up.
    """
    quota = None
    for t, s in shares.items():
        n = int(s * total)
        quota = F.when(F.col(tier) == t, F.lit(n)) if quota is None else quota.when(F.col(tier) == t, F.lit(n))
    most = max(total, 1)
    first = first_of_tiers(rows, tier, order, most, shares)
    ranked = first.withColumn("__rank", F.row_number().over(Window.partitionBy(tier).orderBy(*order)))
    ranked = ranked.withColumn("picked", F.coalesce(F.col("__rank") <= quota, F.lit(False)))
    # the table is now of at most total rows for each tier
    chosen = ranked.withColumn("__final", F.row_number().over(Window.orderBy(F.desc("picked"), *order)))
    return chosen.where(F.col("__final") <= total).drop("__rank", "__final")


def first_of_group(rows: DataFrame, by: list[str], order: list[Column], n: int = 2) -> DataFrame:
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= n)


def unused(rows: DataFrame, used: DataFrame, key: str, order: str) -> DataFrame:
    """Rows whose key is not in use yet, and of those that share one the first in order.

    The first is a minimum, combined before the shuffle. Rows that share key and order are the same row to this.
    """
    free = rows.join(used.select(key).distinct(), key, "left_anti")
    first = free.groupBy(key).agg(F.min(order).alias(order))
    return free.join(first, [key, order], "left_semi")


def uniform(hashed: Column) -> Column:
    """A number from 0 to below 1 from a hex digest's first 13 digits."""
    return F.conv(F.substring(hashed, 1, 13), 16, 10).cast("double") / float(1 << 52)


def roulette(choices: tuple[tuple[str, float], ...], draw_: Column) -> Column:
    """The first choice at which the weights so far reach the draw's share of their sum."""
    total = sum(w for _, w in choices)
    so_far, out = 0.0, None
    for name, w in choices[:-1]:
        so_far += w
        out = F.when(draw_ * total <= so_far, name) if out is None else out.when(draw_ * total <= so_far, name)
    return out.otherwise(choices[-1][0]) if out is not None else F.lit(choices[-1][0])


def label_ratios(rows: DataFrame, truth: str = "expected_vulnerable", difficulty: str = "difficulty", *by: str) -> DataFrame:
    """n, the share of rows that are expected to be vulnerable and the share of hard ones, by groups; 0 without a row."""
    counts = rows.groupBy(*by).agg(F.count("*").alias("n"), F.count_if(F.col(truth)).alias("t"), F.count_if(F.col(difficulty) == "hard").alias("h"))
    share = lambda c: F.coalesce(F.try_divide(F.col(c).cast("double"), F.col("n").cast("double")), F.lit(0.0))
    return counts.select(*by, "n", share("t").alias("vulnerable_share"), share("h").alias("hard_share"))


def split_sizes_of(total: Column, ratio: float) -> tuple[Column, Column]:
    """split_sizes as columns: (train, eval) of a column of totals."""
    n = F.least(F.greatest(F.bround(total * ratio).cast("long"), F.lit(1).cast("long")), total - 1)
    return total - n, n


def eval_prompt_row(rows: DataFrame) -> DataFrame:
    """Evaluation rows from generated ones: stable id, prompt, both names of the attack type; truth must be there."""
    given = F.coalesce(F.col("input"), F.lit(""))
    cols = [T.stable_id(F.col("task_type"), F.col("attack_type"), F.col("instruction"), given).alias("id"), T.prompt(F.col("instruction"), given).alias("prompt"), "instruction", given.alias("input"), F.col("attack_type").alias("vulnerability_type"), "attack_type", "difficulty", "task_type"]
    truth = F.col("expected_vulnerable")
    checked = F.when(truth.isNull(), F.raise_error(F.lit("expected_vulnerable is missing"))).otherwise(truth).alias("expected_vulnerable")
    return rows.select(*cols, checked, *(["output"] if "output" in rows.columns else []))


def normalised_rows(rows: DataFrame) -> DataFrame:
    """Old rows with the columns that the schema asks for: those that are there stay as they are."""
    have = set(rows.columns)
    new = {"vulnerability_type": F.col("attack_type") if "attack_type" in have else F.lit(None).cast("string"), "task_type": F.lit("generation"), "difficulty": F.lit("medium"), "input_code": F.col("input") if "input" in have else F.lit(None).cast("string")}
    truth = F.col("expected_vulnerable")
    checked = F.when(truth.isNull(), F.raise_error(F.lit("expected_vulnerable is missing"))).otherwise(truth)
    return rows.withColumns({n: c for n, c in new.items() if n not in have} | {"expected_vulnerable": checked})


def research_record(rows: DataFrame, with_output: bool = True) -> DataFrame:
    """Rename and normalise raw rows: blanks to null, explicit id or the stable one, defaults for tags."""
    have = set(rows.columns)
    pick = lambda *names: F.coalesce(*(T.blank_to_null(F.col(n).cast("string")) for n in names if n in have), F.lit(None).cast("string"))
    task, kind = F.coalesce(pick("task_type"), F.lit("generation")), F.coalesce(pick("vulnerability_type", "attack_type"), F.lit("unknown"))
    code, said = pick("input_code", "input"), F.coalesce(pick("instruction"), F.lit(""))
    cols = [F.coalesce(pick("id"), T.stable_id(task, kind, said, code)).alias("id"), task.alias("task_type"), said.alias("instruction"), code.alias("input_code"), F.col("expected_vulnerable").cast("boolean").alias("expected_vulnerable"), kind.alias("vulnerability_type"), F.coalesce(pick("difficulty"), F.lit("medium")).alias("difficulty")]
    return rows.select(*cols, *([F.coalesce(pick("output"), F.lit("")).alias("output")] if with_output else []))


def synthetic_rows(spark: SparkSession, n: int, seed: int = 42) -> DataFrame:
    """n rows of prompt, safe and unsafe code drawn from tables, columns and databases by a hash of the row number."""
    # Names that the rows draw on.
    choices = {"db": ("sqlite3", "pymysql", "psycopg2"), "tbl": ("users", "orders", "products", "accounts"), "field": ("id", "name", "email", "status")}
    rows = spark.range(n)
    for i, (name, values) in enumerate(choices.items()):
        at = F.pmod(F.xxhash64("id", F.lit(seed), F.lit(i)), F.lit(len(values))).cast("int") + 1
        rows = rows.withColumn(name, F.element_at(F.array(*map(F.lit, values)), at))
    ask = F.format_string("Write Python code using %s that selects rows from %s by %s.", "db", "tbl", "field")
    safe = F.format_string('cur.execute("SELECT * FROM %s WHERE %s = ?", (value,))\n', "tbl", "field")
    unsafe = F.format_string('cur.execute("SELECT * FROM %s WHERE %s = " + value)\n', "tbl", "field")
    return rows.select("id", "db", "tbl", "field", ask.alias("prompt"), safe.alias("chosen"), unsafe.alias("rejected"))
