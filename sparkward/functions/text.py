"""Text expressions: prompts, identifiers, markers, leaks, tokens."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The sections of a three-part answer, and what a leaked prompt holds.
MARKERS = {"has_warning": "[SECURITY WARNING]", "has_explanation": "[EXPLANATION]", "has_safe_solution": "[SAFE SOLUTION]"}
LEAKS = ("Instruction:", "Input:", "###")
# Tests for the database driver of a code text, in their order; where none holds, pymysql.
DRIVERS = (("sqlalchemy", ("sqlalchemy",)), ("sqlite3", ("sqlite3", "aiosqlite")), ("psycopg2", ("psycopg2",)), ("mysql-connector", ("mysql.connector",)), ("aiomysql", ("aiomysql",)), ("asyncpg", ("asyncpg",)))
DEFAULT_DRIVER = "pymysql"


def strip(c: Column) -> Column:
    """Python's str.strip(): all Unicode white space."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def blank_to_null(c: Column) -> Column:
    return F.when(strip(c) != "", c)


def prompt(instruction: Column, given: Column) -> Column:
    empty = F.lit("")
    return F.concat(F.lit("Instruction:\n"), F.coalesce(instruction, empty), F.lit("\n\nInput:\n"), F.coalesce(given, empty), F.lit("\n\n"))


def completion(output: Column) -> Column:
    return F.concat(strip(F.coalesce(output, F.lit(""))), F.lit("\n"))


def stable_id(task: Column, vulnerability: Column, instruction: Column, given: Column) -> Column:
    """sqlsec- and 20 hex digits of the SHA-256 of the four stripped fields, one to a line."""
    lines = F.concat_ws("\n", *(strip(F.coalesce(c, F.lit(""))) for c in (task, vulnerability, instruction, given)))
    return F.concat(F.lit("sqlsec-"), F.substring(F.sha2(lines, 256), 1, 20))


def prompt_hash(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def response_flags(raw: Column) -> dict[str, Column]:
    return {name: F.coalesce(F.contains(raw, F.lit(m)), F.lit(False)) for name, m in MARKERS.items()}


def leaks_prompt(raw: Column) -> Column:
    out = F.lit(False)
    for token in LEAKS:
        out = out | F.coalesce(F.contains(raw, F.lit(token)), F.lit(False))
    return out


def after_leak(raw: Column) -> Column:
    """What follows the last input section, without leading line ends and an 'Output:' line."""
    text = F.regexp_replace(F.substring_index(F.coalesce(raw, F.lit("")), "\nInput:\n", -1), r"^\n+", "")
    cut = F.regexp_replace(F.regexp_replace(text, r"^[^\n]*\n", ""), r"^\n+", "")
    return F.when(F.startswith(text, F.lit("Output:")) & F.contains(text, F.lit("\n")), cut).otherwise(text)


def repeats_itself(text: Column) -> Column:
    """More than ten lines of which fewer than 30 per cent are distinct."""
    lines = F.split(F.coalesce(text, F.lit("")), "\n", -1)
    return (F.size(lines) > 10) & (F.size(F.array_distinct(lines)) < F.size(lines) * 0.3)


def driver_of(code: Column) -> Column:
    low = F.lower(F.coalesce(code, F.lit("")))
    out = None
    for name, words in DRIVERS:
        test = F.lit(False)
        for w in words:
            test = test | F.contains(low, F.lit(w))
        out = F.when(test, F.lit(name)) if out is None else out.when(test, F.lit(name))
    return out.otherwise(F.lit(DEFAULT_DRIVER))


def framework_of(code: Column) -> Column:
    """The generator's own reading of a chosen text: sqlalchemy, sqlite3 or pymysql. Not the rule of driver_of."""
    low = F.lower(F.coalesce(code, F.lit("")))
    has = lambda *words: F.array_contains(F.array(*(F.contains(low, F.lit(w)) for w in words)), True)
    return F.when(has("sqlalchemy", "session.execute"), "sqlalchemy").when(has("sqlite"), "sqlite3").otherwise("pymysql")


def structures_of(code: Column) -> Column:
    """All structure labels of a code text, in a fixed order."""
    code = F.coalesce(code, F.lit(""))
    has = lambda s: F.contains(code, F.lit(s))
    tests = {
        "async": has("async def ") | has("await "),
        "class": has("class "),
        "decorator": has("@") & has("def "),
        "context_manager": has("with ") & (has("cursor") | has("closing") | has("begin()") | has("acquire")),
        "generator": has("yield"),
        "try_except": has("try:"),
        "function": has("def ") & ~has("class "),
        "orm": F.contains(F.lower(code), F.lit("declarative_base")) | has("DeclarativeBase"),
    }
    return F.array_compact(F.array(*(F.when(t, F.lit(n)) for n, t in tests.items())))


def token_set(code: Column) -> Column:
    """Distinct identifiers, quoted strings, operator runs and brackets."""
    code = F.coalesce(code, F.lit(""))
    found = [F.regexp_extract_all(code, F.lit(p), F.lit(0)) for p in (r"[a-zA-Z_](?U:\w)*", r"\"[^\"]*\"|'[^']*'", r"[+\-*/%=<>!&|^~@]+", r"[()\[\]{}:,]")]
    return F.array_distinct(F.concat(*found))


def jaccard(a: Column, b: Column) -> Column:
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))


def drop_fence_lines(code: Column) -> Column:
    """The text without lines that are only a fence marker."""
    lines = F.filter(F.split(code, "\n", -1), lambda x: ~strip(x).isin("```", "```python", "```sql", "```text"))
    return strip(F.array_join(lines, "\n"))


def optional_double(c: Column) -> Column:
    """A number, or null where the text is not one."""
    return c.try_cast("double")


def percent_cell(v: Column, width: int = 8) -> Column:
    return F.lpad(F.when(v.isNull(), "N/A").otherwise(F.format_string("%.1f%%", v * 100)), width, " ")


def metric_cell(v: Column) -> Column:
    return F.when(v.isNull(), "N/A").otherwise(F.format_string("%.4f", v))
