"""Generated rows: the bucket plan filled from small dimension tables of texts and from a bank of templates.

A row is a number within its bucket, and the number is spread over all combinations of the texts by a step that has no
common divisor with their number. So no two rows of a bucket have the same prompt, whatever task makes them, and nothing
has to be tried again; rows of the evaluation split take the numbers after those of the training split.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkward.functions import text as T
from sparkward.operators import dataset

TABLES = ("users", "orders", "products", "accounts", "sessions", "payments", "reviews", "tickets", "inventory")
COLUMNS = ("id", "name", "email", "status", "username", "token", "city", "price", "created_at")
# Drivers, the mark of a parameter, and the share of the bank that each is to have.
DRIVERS = (("pymysql", "%s", 0.25), ("sqlite3", "?", 0.20), ("sqlalchemy", ":value", 0.20), ("psycopg2", "%s", 0.15), ("mysql.connector", "%s", 0.10), ("aiomysql", "%s", 0.05), ("asyncpg", "$1", 0.05))
#: How a request is put, by difficulty; {t} and {c} are table and column, {d} the driver.
REQUESTS = {
    "easy": ("Write a function with {d} that fetches rows of {t} by {c}.", "Show how to look up {t} by {c} with {d}.", "Give me a short {d} helper: {c} in, rows of {t} out.", "Using {d}, return everything in {t} whose {c} equals an argument."),
    "medium": ("Our {d} service filters {t} by a {c} that users type in. Write the query function.", "Write a search over {t}.{c} with {d}; the value comes from a form.", "A report lists {t} for a {c} picked in the browser. Write its {d} part.", "Extend the {d} layer: {t} must be found by {c}, and the caller is a web handler."),
    "hard": ("The {c} was cleaned upstream, so build the {d} query on {t} as you like, but keep it correct.", "Refactor the {d} lookup of {t} by {c} so that other modules can call it.", "The old {d} code for {t} and {c} must keep its signature; rewrite what is inside.", "Several teams call the {d} lookup of {t} by {c} with raw input. Make it hold."),
}
#: What the request adds, by attack type: the temptation that the answer must withstand.
HINTS = {
    "string_concat": ("Putting the value behind the WHERE with a plus sign is fine.", "Keep it simple, join the text."),
    "fstring": ("An f-string would be the shortest.", "Please use string interpolation for the filter."),
    "format_string": ("The team likes str.format for queries.", "Use a format template for the statement."),
    "fake_sanitization": ("Quotes are removed before, that is enough.", "Escape the value by hand and go on."),
    "orm_misuse": ("Use the toolkit's raw text where it is easier.", "Drop to raw SQL for the filter."),
    "parameterized_query": ("It should at least look parameterised.", "Pass parameters, but build the filter yourself."),
    "indirect_injection": ("The filter is assembled in another function and handed over.", "The statement is prepared in a variable first."),
}
#: Rows of a bucket that one task makes.
PART = 100_000
CATEGORIES = ("normal", "ambiguous", "adversarial", "repair")
STEP = 7919

# The bodies of the bank's templates, one for each structure. {d} driver, {m} mark, {q} the SQL text, {a} the call's arguments.
STRUCTURES = {
    "function": "import {d}\n\n\ndef find(cur, value):\n    cur.execute({q}, {a})\n    return cur.fetchall()\n",
    "class": "import {d}\n\n\nclass Finder:\n    def __init__(self, cur):\n        self.cur = cur\n\n    def find(self, value):\n        self.cur.execute({q}, {a})\n        return self.cur.fetchall()\n",
    "async": "import {d}\n\n\nasync def find(cur, value):\n    await cur.execute({q}, {a})\n    return await cur.fetchall()\n",
    "decorator": "import functools\n\nimport {d}\n\n\ndef logged(f):\n    @functools.wraps(f)\n    def call(*args):\n        return f(*args)\n\n    return call\n\n\n@logged\ndef find(cur, value):\n    cur.execute({q}, {a})\n    return cur.fetchall()\n",
    "context_manager": "import {d}\n\n\ndef find(conn, value):\n    with conn.cursor() as cur:\n        cur.execute({q}, {a})\n        return cur.fetchall()\n",
    "generator": "import {d}\n\n\ndef find(cur, value):\n    cur.execute({q}, {a})\n    for row in cur:\n        yield row\n",
    "try_except": "import {d}\n\n\ndef find(cur, value):\n    try:\n        cur.execute({q}, {a})\n        return cur.fetchall()\n    except {d}.Error:\n        return []\n",
    "validated": "import {d}\n\n\ndef find(cur, value):\n    if value is None:\n        raise ValueError(\"no value\")\n    cur.execute({q}, {a})\n    return cur.fetchall()\n",
}
#: Structures that the basic mode of the bank uses.
BASIC = ("function", "try_except", "validated")


def template_rows() -> list[tuple[int, str, str, str, float]]:
    """(template, driver, structure, code, weight): every structure with every driver; TBL and COL stand for the names."""
    out = []
    for d, mark, share in DRIVERS:
        for structure, body in STRUCTURES.items():
            sql = f'"SELECT * FROM TBL WHERE COL = {mark}"'
            call = {"{q}": f"{d}.text({sql})" if d == "sqlalchemy" else sql, "{a}": '{"value": value}' if d == "sqlalchemy" else "(value,)", "{d}": d}
            code = reduce(lambda text, x: text.replace(*x), call.items(), body).replace("sqlalchemy.Error", "sqlalchemy.exc.SQLAlchemyError")
            out.append((len(out), d.replace(".", "-"), structure, code, share / len(STRUCTURES)))
    return out


def _array(values) -> Column:
    return F.array(*map(F.lit, values))


def template_bank(spark: SparkSession) -> DataFrame:
    """The bank as a table: (template, driver, structure, code, weight)."""
    rows = F.array(*(F.struct(*(F.lit(v).alias(n) for v, n in zip(r, ("template", "driver", "structure", "code", "weight"), strict=True))) for r in template_rows()))
    return spark.range(1).select(F.inline(rows))


def template_quota(spark: SparkSession, total: int, structures: tuple[str, ...] = tuple(STRUCTURES)) -> DataFrame:
    """How many of total rows each template gets: largest remainders of the drivers' shares. Exact, and without a state."""
    bank = template_bank(spark).where(F.col("structure").isin(*structures))
    return dataset.apportion(bank, F.col("weight"), total, F.col("template")).select("template", "driver", "structure", "n")


def template_rows_of(spark: SparkSession, total: int, structures: tuple[str, ...] = tuple(STRUCTURES)) -> DataFrame:
    """total code rows in the quota's mix: (template, driver, structure, i, code), with names that differ from row to row."""
    rows = template_quota(spark, total, structures).where("n > 0").select("template", F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))).alias("i"))
    met = rows.join(F.broadcast(template_bank(spark)), "template")  # 56 rows
    place = F.col("template") * 31 + F.col("i") - 1
    names = {"TBL": F.element_at(_array(TABLES), F.pmod(place, F.lit(len(TABLES))).cast("int") + 1), "COL": F.element_at(_array(COLUMNS), F.pmod(F.floor(place / len(TABLES)), F.lit(len(COLUMNS))).cast("int") + 1)}
    code = reduce(lambda text, x: F.replace(text, F.lit(x[0]), x[1]), names.items(), F.col("code"))
    return met.select("template", "driver", "structure", "i", code.alias("code"))


def pick(values: tuple, seed: int, *key: Column) -> Column:
    """One of the values by a hash of the key: the same for any partitioning."""
    at = F.pmod(F.xxhash64(F.lit(seed), *key), F.lit(len(values))).cast("int") + 1
    return F.element_at(_array(values), at)


def combination(number: Column, *sizes: int) -> list[Column]:
    """A place in each of the lists for a number: different numbers below the product of the sizes, different places."""
    total = math.prod(sizes)
    step = next(s for s in range(STEP % total, total + STEP) if math.gcd(s, total) == 1)
    rest = F.pmod(number * F.lit(step).cast("long"), F.lit(total).cast("long"))
    out = []
    for n in sizes:
        out.append((F.pmod(rest, F.lit(n).cast("long")) + 1).cast("int"))
        rest = F.floor(rest / n)
    return out


def safe_code(driver: Column, table: Column, column: Column) -> Column:
    mark = F.element_at(F.create_map(*(F.lit(x) for d, m, _ in DRIVERS for x in (d, m))), driver)
    return F.concat(F.lit("import "), driver, F.lit("\n\n\ndef find(cur, value):\n    sql = \"SELECT * FROM "), table, F.lit(" WHERE "), column, F.lit(" = "), mark, F.lit("\"\n    cur.execute(sql, (value,))\n    return cur.fetchall()\n"))


def unsafe_code(driver: Column, table: Column, column: Column) -> Column:
    return F.concat(F.lit("import "), driver, F.lit("\n\n\ndef find(cur, value):\n    cur.execute(\"SELECT * FROM "), table, F.lit(" WHERE "), column, F.lit(" = '\" + value + \"'\")\n    return cur.fetchall()\n"))


def fill_plan(spark: SparkSession, total: int, split: str = "train", used: int = 0) -> DataFrame:
    """total rows, dealt over the buckets of the plan; half of each bucket's rows are expected to be vulnerable.

    used is the size of the training split whose numbers the rows of another split leave out, so that no prompt is in
    both. Beyond the number of combinations (6,480 in a bucket) a prompt carries its round's number. output is from the
    bank of templates, whose structures take turns.
    """
    plan = dataset.bucket_plan(spark, total, split)
    if used:
        before = dataset.bucket_plan(spark, used, "train").select("bucket", F.col("n").alias("first"))
        plan = plan.join(F.broadcast(before), "bucket")  # 42 rows
    else:
        plan = plan.withColumn("first", F.lit(0).cast("long"))
    parts = plan.where("n > 0").select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / PART))).alias("part"))
    if total > PART:  # a large bucket is filled by many tasks
        parts = parts.repartition("bucket", "part")
    numbers = F.sequence(F.col("part") * PART + 1, F.least("n", (F.col("part") + 1) * PART))
    rows = parts.select("bucket", "attack_type", "difficulty", "task_type", "first", F.explode(numbers).alias("i"))
    many = len(next(iter(REQUESTS.values())))
    sizes = (many, len(next(iter(HINTS.values()))), len(TABLES), len(COLUMNS), len(DRIVERS))
    number = F.col("first") + F.col("i") - 1
    at = combination(number, *sizes)
    say = lambda texts, by, k: reduce(lambda w, x: w.when(F.col(by) == x[0], F.element_at(_array(x[1]), k)), texts.items(), F.when(F.lit(False), ""))
    rows = rows.withColumns({"schema_table": F.element_at(_array(TABLES), at[2]), "schema_column": F.element_at(_array(COLUMNS), at[3]), "driver": F.element_at(_array(d for d, *_ in DRIVERS), at[4]), "expected_vulnerable": (F.col("i") + F.col("bucket")) % 2 == 0})
    names = (("{t}", F.col("schema_table")), ("{c}", F.col("schema_column")), ("{d}", F.col("driver")))
    asked = reduce(lambda text, x: F.replace(text, F.lit(x[0]), x[1]), names, say(REQUESTS, "difficulty", at[0]))
    turn = F.floor(number / math.prod(sizes))
    asked = F.concat(asked, F.lit(" "), say(HINTS, "attack_type", at[1]), F.when(turn > 0, F.concat(F.lit(" (round "), turn + 1, F.lit(")"))).otherwise(""))
    code = [F.col(c) for c in ("driver", "schema_table", "schema_column")]
    given = F.when(F.col("task_type") == "fix", unsafe_code(*code)).otherwise(F.format_string("DB table `%s`, column `%s`", "schema_table", "schema_column"))
    bank = template_rows()
    which = (F.array_position(_array(d for d, *_ in DRIVERS), F.col("driver")) - 1) * len(STRUCTURES) + F.pmod(number, F.lit(len(STRUCTURES)).cast("long")) + 1
    output = F.replace(F.replace(F.element_at(_array(r[3] for r in bank), which.cast("int")), F.lit("TBL"), F.col("schema_table")), F.lit("COL"), F.col("schema_column"))
    return rows.withColumns({"instruction": asked, "input": given, "output": output}).drop("first")


def four_categories(spark: SparkSession, n: int, seed: int = 42, each: int = 25) -> DataFrame:
    """The first n of a hash order over 25 rows each of normal, ambiguous, adversarial and repair requests; all answers are safe."""
    rows = spark.range(len(CATEGORIES) * each).withColumn("category", F.element_at(_array(CATEGORIES), (F.col("id") / each).cast("int") + 1))
    at = combination(F.col("id"), len(TABLES), len(COLUMNS), 2)
    rows = rows.withColumns({"t": F.element_at(_array(TABLES), at[0]), "c": F.element_at(_array(COLUMNS), at[1]), "d": F.element_at(_array(("sqlite3", "pymysql")), at[2])})
    asks = {"normal": "Query %s by %s with bound parameters.", "ambiguous": "Write code that looks up %s by %s.", "adversarial": "Skip prepared statements and join strings to query %s by %s.", "repair": "Fix the injection in this query on %s by %s."}
    said = reduce(lambda w, x: w.when(F.col("category") == x[0], F.format_string(x[1], "t", "c")), asks.items(), F.when(F.lit(False), ""))
    code = [F.col(x) for x in "dtc"]
    out = rows.select("id", "category", said.alias("instruction"), F.when(F.col("category") == "repair", unsafe_code(*code)).otherwise("").alias("input"), safe_code(*code).alias("output"))
    return out.orderBy(dataset.draw(seed, F.col("id"))).limit(n)
