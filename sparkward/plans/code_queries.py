"""Queries over code texts. Their counterparts in SQL state the known answer for each kind of text, with the row's names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkward.functions import once, pyast, pynames, rewrites, rules, taint
from sparkward.operators import dataset, diversity, evaluate, preparation
from sparkward.operators import metrics as M
from sparkward.plans.metric_sql import bundle_sql
from sparkward.plans.registering import div, matches_any, register, values
from sparkward.plans.views import BUILD_KIND, FLOW_KIND, KIND, REPEAT_KIND, REPEATS, SCOPE_KIND, SNIPPETS, by_kind, named, table, view
from sparkward.scratch import scratch_path

ATTACKS = tuple(a for a, _ in dataset.ATTACKS)
WHOLE = dict(enumerate(SNIPPETS))
_FENCED = 'import sqlite3\ndef FIND(conn, value):\n    with conn.cursor() as cur:\n        cur.execute("SELECT * FROM TBL WHERE COL = ?", (value,))\n        return cur.fetchone()'
#: What extraction gives, by kind of text; the others are code as they are, and kind 9 holds none.
EXTRACTED = WHOLE | {
    6: "import sqlite3", 7: _FENCED, 8: 'import sqlite3\n\ndef FIND(conn, value):\n    return conn.execute("SELECT COL FROM TBL WHERE id = ?", (value,)).fetchall()', 9: None, 10: 'COL = "TBL";',
    11: 'import pymysql\nNAME = "TBL"\ndef FIND(cur):\n    return cur.execute("SELECT COL FROM TBL")', 16: 'value = "COL"', 17: "def FIND(cur):\n    return cur.fetchone()",
}
SOURCE = f"CASE {KIND} WHEN 7 THEN 'python_fence' WHEN 16 THEN 'python_fence' WHEN 8 THEN 'incomplete_fence' WHEN 9 THEN 'full_text_fallback' WHEN 10 THEN 'full_text_fallback' ELSE 'keyword_start' END"
_BROKEN = {6: "SyntaxError: '(' was never closed", **dict.fromkeys((7, 8, 9, 16, 17), "SyntaxError: invalid syntax")}
_FOREIGN = {k: f"ImportError: module '{m}' is not allowed in taint sandbox" for m, ks in (("pymysql", (1, 3, 11)), ("psycopg2", (2, 19)), ("sqlalchemy", (4,)), ("asyncpg", (5,)), ("requests", (14,))) for k in ks}
#: What ends the analysis of flows, where something does.
_ENDED = _FOREIGN | {6: "transform_syntax_error: '(' was never closed (<unknown>, line 2)", **{k: f"transform_syntax_error: invalid syntax (<unknown>, line {n})" for k, n in ((7, 1), (8, 1), (9, 1), (16, 1), (17, 3))}, 13: "OperationalError: no such table: TBL"}
#: What a training target keeps of each text: the first fence, or the whole text if it parses.
TARGET = {k: t for k, t in WHOLE.items() if k not in _BROKEN} | {7: _FENCED, 10: 'COL = "TBL";', 16: 'value = "COL"'}


@register("extract_code", f"SELECT o_orderkey, {by_kind(EXTRACTED)} AS code, {by_kind(EXTRACTED | {9: SNIPPETS[9]})} AS candidate, CASE {KIND} WHEN 9 THEN 'SyntaxError: invalid syntax' ELSE 'ok' END AS reason, {SOURCE} AS source FROM orders")
def extract_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "code_samples").select("o_orderkey", pyast.extract_column(F.col("code")).alias("x")).select("o_orderkey", "x.*")


@register("extraction_summary", f"SELECT {SOURCE} AS extraction_source, count(*) AS n, count(*) FILTER (WHERE {KIND} <> 9) AS n_valid FROM orders GROUP BY 1")
def extraction_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = pyast.extract_column(F.col("code"))
    rows = view(spark, sf_dir, "code_samples").select(x.alias("x")).select(F.col("x.source").alias("extraction_source"), F.col("x.code").isNull().alias("invalid_extraction"))
    return evaluate.extraction_summary(rows)


@register("legacy_extraction", f"SELECT o_orderkey, {by_kind({7: _FENCED})} AS code FROM orders")
def legacy_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "code_samples").select("o_orderkey", pyast.last_fence_column(F.col("code")).alias("code"))


@register("parse_check", f"SELECT o_orderkey, {KIND} NOT IN ({', '.join(map(str, _BROKEN))}) AS ok, coalesce({by_kind(_BROKEN)}, 'ok') AS reason FROM orders")
def parse_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "code_samples").select("o_orderkey", pyast.parse_column(F.col("code")).alias("x")).select("o_orderkey", "x.*")


_UNPARSED = f"kind IN ({', '.join(map(str, _BROKEN))})"
_UNSAFE = matches_any("code", rules.TARGET_RULES, False)


@register("compliance_report", f"""WITH c AS (SELECT count(*) AS n, 0 AS empty_output, count(*) FILTER (WHERE {_UNPARSED}) AS ast_parse_failed, count(*) FILTER (WHERE {_UNSAFE}) AS unsafe_pattern FROM code_samples)
SELECT *, round_even(100 * (1 - ast_parse_failed::DOUBLE / n), 4) AS parse_pass_pct, round_even(100 * (1 - unsafe_pattern::DOUBLE / n), 4) AS rule_pass_pct FROM c""")
def compliance_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = view(spark, sf_dir, "code_samples").select("code", pyast.parse_column(F.col("code"))["ok"].alias("ok"))
    return diversity.compliance(rows, F.col("code"), F.col("ok"), rules.rule_hits(F.col("code"), rules.TARGET_RULES, False))


@register("compliance_violations", f"SELECT o_orderkey, 'ast_parse_failed' AS violation FROM code_samples WHERE {_UNPARSED} UNION ALL " + " UNION ALL ".join(f"SELECT o_orderkey, '{n}' FROM code_samples WHERE {matches_any('code', ((n, p),), False)}" for n, p in rules.TARGET_RULES))
def compliance_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = view(spark, sf_dir, "code_samples").withColumn("ok", pyast.parse_column(F.col("code"))["ok"])
    return diversity.violations(rows, F.col("code"), F.col("ok"), rules.rule_hits(F.col("code"), rules.TARGET_RULES, False), "o_orderkey")


@register("valid_targets", f"SELECT o_orderkey, NOT {_UNPARSED} AND NOT {_UNSAFE} AS valid FROM code_samples")
def valid_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "code_samples").select("o_orderkey", preparation.valid_target(F.col("code")).alias("valid"))


@register("code_only_targets", f"SELECT o_orderkey, {by_kind(TARGET)} AS code, CASE WHEN {KIND} IN ({', '.join(str(k) for k in WHOLE if k not in TARGET)}) THEN 'no_code' END AS dropped_reason FROM orders")
def code_only_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return preparation.code_only_targets(view(spark, sf_dir, "code_samples"), "code").select("o_orderkey", "code", "dropped_reason")


@register("taint_static", f"SELECT o_orderkey, {KIND} = 12 AS is_vulnerable, CASE WHEN {KIND} = 12 THEN 1 ELSE 0 END AS taint_flows_detected, {by_kind(_ENDED)} AS error, CASE WHEN {KIND} = 12 THEN {by_kind({12: 'SELECT * FROM TBL WHERE COL = COL'})} END AS preview FROM orders")
def taint_static(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = once.of_each(view(spark, sf_dir, "code_samples"), ["code"], lambda kinds: kinds.withColumn("x", taint.taint_column(F.col("code"))))
    return rows.select("o_orderkey", "x.is_vulnerable", "x.taint_flows_detected", "x.error", F.get("x.details", F.lit(0))["sql_preview"].alias("preview"))


_CONNECTION, _CURSOR = "sqlite3.Connection.execute", "sqlite3.Cursor.execute"
_FLOWED = [
    (0, 1, None, _CONNECTION, "SELECT * FROM TBL WHERE COL = COL"), (1, 1, None, _CONNECTION, "SELECT * FROM TBL WHERE COL = COL"), (2, 2, None, _CONNECTION, "SELECT 1COL"), (3, 3, None, _CONNECTION, "SELECT COLCOL"),
    (4, 1, None, _CONNECTION, "no such table: TBL COL"), (5, 1, None, _CURSOR, "SELECT * FROM TBL WHERE COL = COL"), (7, 1, "NameError: __build_class__ not found", _CONNECTION, "SELECT COL"),
    (8, 1, "ImportError: module 'os' is not allowed in taint sandbox", _CONNECTION, "SELECT COL"), (9, 0, None, None, None), (10, 1, "limit", _CONNECTION, "SELECT COL"), (11, 1, None, _CONNECTION, "SELECT COL"),
    (12, 1, "ZeroDivisionError: division by zero", _CONNECTION, "SELECT COL"), (13, 2, None, _CONNECTION, "SELECT COL"), (14, 1, None, _CONNECTION, "SELECT COL"), (15, 1, None, _CONNECTION, "SELECT 1 COL"),
    (16, 1, "limit", _CONNECTION, "SELECT COL"),
]
_SHOWN = f"concat(chr(39), {named(repr('COL'))}, chr(39))"


@register("taint_flows", f"""WITH f AS (SELECT o_orderkey, p.n, p.error, p.sink, {named('p.preview')} AS preview FROM orders JOIN ({values(_FLOWED)}) p(k, n, error, sink, preview) ON p.k = {FLOW_KIND}
UNION ALL SELECT o_orderkey, 1, NULL, '{_CONNECTION}', 'SELECT ' || lpad({_SHOWN}, greatest(12, length({_SHOWN}))::INT, ' ') FROM orders WHERE {FLOW_KIND} = 6)
SELECT o_orderkey, n > 0 AS is_vulnerable, n::INT AS taint_flows_detected, error, sink, preview FROM f""")
def taint_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flows through containers, comprehensions, loops, branches, functions and errors, with the first one's preview."""
    rows = once.of_each(view(spark, sf_dir, "flow_samples"), ["code"], lambda kinds: kinds.withColumn("x", taint.taint_column(F.col("code"))))
    first = F.get("x.details", F.lit(0))
    return rows.select("o_orderkey", "x.is_vulnerable", "x.taint_flows_detected", "x.error", first["sink"].alias("sink"), first["sql_preview"].alias("preview"))


_BOUND_SQL = 'SELECT * FROM TBL WHERE COL = ?'
_PLACES = [
    (0, "execute", "", 4, _BOUND_SQL), (1, "execute", "sql", 4, ""), (2, "execute", "", 3, ""), (3, "execute", "", 3, ""), (4, "execute", "", 4, ""), (10, "definition", "COL", 1, "TBL"), (10, "definition", "COL", 1, "TBL"),
    (11, "definition", "NAME", 2, "TBL"), (11, "execute", "", 4, "SELECT COL FROM TBL"), (11, "definition", "NAME", 7, "TBL"), (11, "execute", "", 9, "SELECT COL FROM TBL"), (12, "execute", "", 4, ""),
    (13, "execute", "", 4, _BOUND_SQL), (15, "execute", "", 2, _BOUND_SQL), (18, "returned", "sql_of", 4, _BOUND_SQL), (18, "indirect", "sql_of", 9, _BOUND_SQL),
    (19, "definition", "query", 5, "SELECT * FROM TBL WHERE COL = %s AND state = %s"), (19, "execute", "query", 6, ""),
]


@register("sql_locations", f"SELECT o_orderkey, p.kind, {named('p.name')} AS name, p.line, {named('p.sql')} AS sql FROM orders JOIN ({values(_PLACES)}) p(k, kind, name, line, sql) ON p.k = {KIND}")
def sql_locations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "code_samples").select("o_orderkey", F.inline(pyast.locate_column(F.col("code"))))


_TAGS = "o_orderkey, CASE o_custkey % 7 " + " ".join(f"WHEN {i} THEN '{a}'" for i, a in enumerate(ATTACKS)) + " END AS attack_type, CASE o_custkey % 3 WHEN 0 THEN 'easy' WHEN 1 THEN 'medium' ELSE 'hard' END AS difficulty, CASE o_custkey % 2 WHEN 0 THEN 'fix' ELSE 'generation' END AS task_type, o_custkey % 2 = 0 AS expected_vulnerable"


def tagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples to the code texts: ordinal, id, prompt, tags, truth; code is the answer."""
    cust = F.col("o_custkey")
    attack = F.element_at(F.array(*map(F.lit, ATTACKS)), (cust % 7 + 1).cast("int"))
    difficulty = F.when(cust % 3 == 0, "easy").when(cust % 3 == 1, "medium").otherwise("hard")
    return view(spark, sf_dir, "code_samples").select("o_orderkey", F.concat(F.lit("s"), "o_orderkey").alias("id"), F.lit("ask").alias("prompt"), attack.alias("attack_type"), difficulty.alias("difficulty"), F.when(cust % 2 == 0, "fix").otherwise("generation").alias("task_type"), (cust % 2 == 0).alias("expected_vulnerable"), "code")


_UNDEFINED = ((11, "imp"), (12, "taint_input"), (13, "taint_input"), (15, "wanted"))


@register("undefined_names", f"WITH t AS (SELECT {_TAGS}, {KIND} AS k FROM orders) SELECT attack_type, task_type, difficulty, u.name, count(*) AS n FROM t JOIN ({values(_UNDEFINED)}) u(k, name) USING (k) GROUP BY ALL")
def undefined_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tagged(spark, sf_dir).select("attack_type", "task_type", "difficulty", F.explode(pyast.undefined_column(F.col("code"))).alias("name"))
    return rows.groupBy("attack_type", "task_type", "difficulty", "name").agg(F.count("*").alias("n"))


_SCOPED = [
    (0, "", "x", 8, "undefined"), (0, "FIND", "COL", 3, "undefined"), (1, "", "COL", 1, "before"), (1, "", "q", 4, "undefined"), (2, "FIND", "a", 2, "before"), (2, "FIND.inner", "COL", 6, "undefined"), (3, "", "COL", 6, "undefined"),
    (5, "Repo", "COL", 5, "undefined"), (5, "Repo.FIND", "limit", 4, "undefined"), (6, "", "COL", 1, "undefined"), (6, "", "count", 7, "before"),
]


@register("scoped_names", f"SELECT o_orderkey, {named('p.scope')} AS scope, {named('p.name')} AS name, p.line::INT AS line, p.problem FROM orders JOIN ({values(_SCOPED)}) p(k, scope, name, line, problem) ON p.k = {SCOPE_KIND}")
def scoped_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names that nothing binds, or not yet, by scope: functions in functions, comprehensions, classes, globals."""
    return pynames.scoped_names_of(view(spark, sf_dir, "scope_samples"), "code").select("o_orderkey", "scope", "name", "line", "problem")


_ONCE = REPEATS[0][: len(REPEATS[0]) // 3].rstrip("\n")
_FOLDS = {**dict.fromkeys((0, 1, 2, 3, 4), _ONCE), 5: _ONCE, 6: REPEATS[6], 7: REPEATS[7]}


@register("folded_copies", f"SELECT o_orderkey, {by_kind(_FOLDS, kind=REPEAT_KIND)} AS folded FROM orders")
def folded_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Programs that repeat themselves, with other comments or a last copy that is cut off."""
    rows = view(spark, sf_dir, "repeat_samples")
    return once.of_each(rows, ["code"], lambda kinds: kinds.withColumn("folded", pynames.fold_column(F.col("code")))).select("o_orderkey", "folded")


#: The frame of each kind that has a bound query, with the call's arguments left open (and a line before the call).
_FRAMES = {
    0: "import sqlite3\n\ndef FIND(conn, value):\n    cur = conn.cursor()\n{before:    }    cur.execute({call})\n    return cur.fetchall()",
    13: "import sqlite3\nc = sqlite3.connect(':memory:')\nv = taint_input('COL')\n{before:}c.execute({call})",
    15: "def FIND(cur):\n{before:    }    cur.execute({call})\n    return cur.fetchall()",
    18: "import sqlite3\n\ndef sql_of():\n    return 'SELECT * FROM TBL WHERE COL = ?'\n\ndef FIND(cur, value):\n{before:    }    cur.execute({call})\n    return cur.fetchall()",
    19: "import psycopg2\n\ndef FIND(cur, value, other):\n    query = 'SELECT * FROM TBL WHERE COL = %s AND state = %s'\n{before:    }    cur.execute({call})\n    return cur.fetchall()",
}
_VALUE = {0: "value", 13: "v", 15: "wanted", 18: "value", 19: "value"}


def _attack(attack: str, v: str, two: bool = False, head: str = "SELECT * FROM TBL WHERE COL = ") -> tuple[str, str]:
    """What an attack puts into the call, and the query that is put together."""
    tail = " AND state = "
    joined = f"'{head}' + {v}" + (f" + '{tail}' + other" if two else "")
    call = {
        "string_concat": joined, "fstring": f"f'{head}{{{v}}}" + (f"{tail}{{other}}'" if two else "'"), "format_string": f"'{head}{{0}}" + (f"{tail}{{1}}'.format(value, other)" if two else f"'.format({v})"),
        "fake_sanitization": f"""'{head}' + str({v}).replace("'", '')""" + (f""" + '{tail}' + str(other).replace("'", '')""" if two else ""),
        "orm_misuse": f"'{head}%s" + (f"{tail}%s' % (value, other)" if two else f"' % {v}"), "parameterized_query": f"f'{head}{{{v}}}" + (f"{tail}{{other}}', ()" if two else "', ()"), "indirect_injection": "query",
    }[attack]
    return call, joined


def _unsafe_text(kind: int, attack: str) -> str:
    """The text that an attack makes of a kind, written out."""
    call, joined = _attack(attack, _VALUE[kind], kind == 19)
    text = _FRAMES[kind]
    for indent in ("    ", ""):
        text = text.replace(f"{{before:{indent}}}", f"{indent}query = {joined}\n" if attack == "indirect_injection" else "")
    return text.replace("{call}", call)


def attacked(kinds: DataFrame) -> DataFrame:
    """A row for each text and attack."""
    return kinds.withColumn("attack", F.explode(F.array(*map(F.lit, ATTACKS))))


@register("unsafe_variant", f"SELECT o_orderkey, a.attack, {named('a.rejected')} AS rejected FROM orders JOIN ({values([(k, a, _unsafe_text(k, a)) for k in _FRAMES for a in ATTACKS])}) a(k, attack, rejected) ON a.k = {KIND}")
def unsafe_variant(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = lambda kinds: attacked(kinds).withColumn("rejected", rewrites.unsafe_column(F.col("code"), F.col("attack"))).where("rejected is not null")
    return once.of_each(view(spark, sf_dir, "code_samples"), ["code"], made).select("o_orderkey", "attack", "rejected")


#: Programs without a bound query that have a function with a handle and a value: the aligned text is that function's.
_ALIGNED = {
    **{k: f"import {m}\n\ndef FIND(cur, value):\n{{before:    }}    cur.execute({{call}})\n    return cur.fetchall()" for k, m in ((1, "pymysql"), (2, "psycopg2"), (3, "pymysql"))},
    4: "from sqlalchemy import text\n\nclass Repo:\n\n    def FIND(self, session, value):\n{before:        }        return session.execute(text({call})).fetchall()",
    5: "import asyncpg\n\nasync def FIND(conn, value):\n{before:    }    return await conn.fetch({call})",
}


def _aligned_text(kind: int, attack: str) -> str:
    call, joined = _attack(attack, "value", head="SELECT * FROM t WHERE c = ")
    text = _ALIGNED[kind]
    for indent in ("        ", "    "):
        text = text.replace(f"{{before:{indent}}}", f"{indent}query = {joined}\n" if attack == "indirect_injection" else "")
    return text.replace("text({call})", "text({call}), ()" if attack == "parameterized_query" else "text({call})").replace("{call}", call.removesuffix(", ()") if kind == 4 else call)


@register("aligned_variant", f"SELECT o_orderkey, a.attack, {named('a.rejected')} AS rejected FROM orders JOIN ({values([(k, a, _aligned_text(k, a)) for k in _ALIGNED for a in ATTACKS])}) a(k, attack, rejected) ON a.k = {KIND}")
def aligned_variant(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Variants of programs that have no bound query of their own."""

    def made(kinds: DataFrame) -> DataFrame:
        without = attacked(kinds).withColumn("own", rewrites.unsafe_column(F.col("code"), F.col("attack"))).where("own is null").drop("own")
        return without.withColumn("rejected", rewrites.aligned_column(F.col("code"), F.col("attack"), F.lit("t"), F.lit("c"))).where("rejected is not null")

    return once.of_each(view(spark, sf_dir, "code_samples"), ["code"], made).select("o_orderkey", "attack", "rejected")


_REBOUND = {
    0: "def FIND(cur, a, b):\n    sql = 'SELECT * FROM TBL WHERE COL = ?'\n    params = [a]\n    if b:\n        sql += ' AND state = ?'\n        params += [b]\n    cur.execute(sql, params)\n    return cur.fetchall()",
    1: "def FIND(cur, a):\n    if a:\n        q = 'SELECT * FROM TBL WHERE COL = ?'\n        params = [a]\n    else:\n        q = 'SELECT * FROM TBL'\n        params = []\n    cur.execute(q, params)\n    return cur.fetchall()",
    2: "import pymysql\n\ndef FIND(cur, items):\n    q = 'SELECT * FROM TBL WHERE 1 = 0'\n    params = []\n    for item in items:\n        q += ' OR COL = %s'\n        params += [item]\n    cur.execute(q, params)",
    4: "BASE = 'SELECT * FROM TBL'\n\ndef FIND(cur, a):\n    cur.execute('SELECT * FROM TBL WHERE COL LIKE ?', (f'%{a}%',))",
    5: "def FIND(cur, a):\n    q = 'SELECT * FROM TBL WHERE COL = ?'\n    params = [a]\n    a = None\n    cur.execute(q, params)",
    7: "def FIND(cur, a):\n    try:\n        q = 'SELECT COL FROM TBL WHERE COL = ?'\n        params = [a]\n    except TypeError:\n        q = 'SELECT COL FROM TBL'\n        params = []\n    while a:\n        cur.execute(q, params)\n        q += ' OR COL = ?'\n        params += [a]",
}


@register("safe_fix_flows", f"SELECT o_orderkey, {by_kind(_REBOUND, kind=BUILD_KIND)} AS fixed FROM orders")
def safe_fix_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries built by +=, in branches and loops; null where a piece is unknown, or the value is a table's name."""
    rows = view(spark, sf_dir, "build_samples")
    return once.of_each(rows, ["code"], lambda kinds: kinds.withColumn("fixed", rewrites.fix_column(F.col("code")))).select("o_orderkey", "fixed")


_FIXED = {
    1: "import pymysql\n\ndef FIND(cur, value):\n    sql = 'SELECT * FROM TBL WHERE COL = %s'\n    cur.execute(sql, (value,))\n    return cur.fetchall()",
    2: "import psycopg2\n\ndef FIND(cur, value):\n    cur.execute('SELECT * FROM TBL WHERE COL = %s', (value,))\n    return cur.fetchall()",
    3: "import pymysql\n\ndef FIND(cur, value):\n    cur.execute('SELECT * FROM TBL WHERE COL = %s', (value,))\n    return cur.fetchall()",
    4: "from sqlalchemy import text\n\nclass Repo:\n\n    def FIND(self, session, value):\n        return session.execute(text('SELECT * FROM TBL WHERE COL = :p0'), {'p0': value})",
    12: "import sqlite3\nc = sqlite3.connect(':memory:')\nv = taint_input('COL')\nc.execute('SELECT * FROM TBL WHERE COL = ?', (v,))",
}


@register("safe_fix", f"SELECT o_orderkey, {by_kind(_FIXED)} AS fixed FROM orders WHERE {KIND} IN ({', '.join(map(str, _FIXED))})")
def safe_fix(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = lambda kinds: kinds.withColumn("fixed", rewrites.fix_column(F.col("code"))).where("fixed is not null")
    return once.of_each(view(spark, sf_dir, "code_samples"), ["code"], made).select("o_orderkey", "fixed")


#: Kinds whose target is safe: (kind, driver, framework, outcome of every attack, steps that were passed).
_OK, _NO, _LOST = ("ok", "variant|differs|unsafe|isomorphic"), ("no_variant", ""), ("not_isomorphic", "variant|differs|unsafe")
_TRIED = [
    (0, "sqlite3", "sqlite3", *_OK), (7, "sqlite3", "sqlite3", *_OK), (13, "sqlite3", "sqlite3", *_OK), (15, "pymysql", "pymysql", *_OK), (19, "psycopg2", "pymysql", *_OK), (18, "sqlite3", "sqlite3", *_LOST),
    (4, "sqlalchemy", "sqlalchemy", *_OK),  # the rules ask for something between the braces, so they take it for safe
    (5, "asyncpg", "pymysql", *_OK), (10, "pymysql", "pymysql", *_NO), (11, "pymysql", "pymysql", *_NO), (14, "pymysql", "pymysql", *_NO), (16, "pymysql", "pymysql", *_NO),
]
#: Aligned variants that the rules don't notice: text() around %, and calls that are no execute.
_UNNOTICED = {(4, "orm_misuse"), *((5, a) for a in ("fstring", "format_string", "orm_misuse", "parameterized_query"))}
_OUTCOMES = [(k, a, driver, framework, *(("not_unsafe", "variant|differs") if (k, a) in _UNNOTICED else told)) for k, driver, framework, *told in _TRIED for a in ATTACKS]
_TIER = "CASE a.attack_type WHEN 'string_concat' THEN 'easy' WHEN 'fstring' THEN 'medium' WHEN 'format_string' THEN 'medium' ELSE 'hard' END"
_PAIRS = f"""tagged AS (SELECT {_TAGS}, {KIND} AS k FROM orders), pairs AS (SELECT o_orderkey, a.attack_type, {_TIER} AS tier, t.difficulty, a.driver, a.framework, a.outcome, a.steps
FROM tagged t JOIN ({values(_OUTCOMES)}) a(k, attack_type, driver, framework, outcome, steps) USING (k))"""


_written: dict[tuple[str, str], str] = {}


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pairs that were tried, written once for all queries of an application: making them is the costly part."""
    rows = tagged(spark, sf_dir).select("o_orderkey", F.lit("say").alias("instruction"), F.lit("DB table `t`, column `c`").alias("input"), F.col("code").alias("output"), F.lit(True).alias("expected_vulnerable"), "difficulty")
    made = preparation.build_pairs(rows, "o_orderkey").drop("prompt", "chosen", "rejected", "iso_reason")  # no query shows them
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _written:
        path = scratch_path(spark, "pairs")
        made.write.parquet(path)
        _written[key] = path
    return spark.read.schema(made.schema).parquet(_written[key])


@register("pair_isomorphism", f"WITH {_PAIRS} SELECT o_orderkey, attack_type, tier, driver, framework, outcome, steps, 't' AS schema_table, 'c' AS schema_column FROM pairs")
def pair_isomorphism(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Preference pairs that were tried over the code table, with their outcome and the steps that they passed."""
    return _pairs(spark, sf_dir).select("o_orderkey", "attack_type", "tier", "driver", "framework", "outcome", F.array_join("steps", "|").alias("steps"), "schema_table", "schema_column")


@register("pair_statistics", f"WITH {_PAIRS} SELECT tier, outcome, count(*) AS n, count(*)::DOUBLE / sum(count(*)) OVER (PARTITION BY tier) AS share FROM pairs GROUP BY 1, 2")
def pair_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return preparation.pair_stats(_pairs(spark, sf_dir))


@register("pair_report", f"WITH {_PAIRS}, c AS (SELECT tier, count(*) AS tried, count(*) FILTER (WHERE outcome = 'ok') AS kept, count(*) FILTER (WHERE outcome IN ('ok', 'not_isomorphic')) AS came FROM pairs GROUP BY 1) SELECT tier, tried, kept, {div('kept', 'sum(kept) OVER ()')} AS share, {div('kept', 'came')} AS isomorphic_rate FROM c")
def pair_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return preparation.pair_report(_pairs(spark, sf_dir))


@register("fallback_counts", f"""WITH {_PAIRS}, g AS (SELECT grouping(attack_type, difficulty, outcome, framework) AS g, attack_type, difficulty, outcome, framework, count(*) AS n FROM pairs
GROUP BY GROUPING SETS ((attack_type), (attack_type, difficulty), (outcome), (framework), (attack_type, framework)))
SELECT CASE g WHEN 7 THEN 'attack_type' WHEN 3 THEN 'attack_type,difficulty' WHEN 13 THEN 'outcome' WHEN 14 THEN 'framework' WHEN 6 THEN 'attack_type,framework' END AS scope, attack_type, difficulty, outcome, framework, n FROM g""")
def fallback_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return preparation.outcome_counts(_pairs(spark, sf_dir))


def _kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pairs(spark, sf_dir).where("outcome = 'ok'").select("o_orderkey", "attack_type", "tier")


_QUOTA = f"""{_PAIRS}, good AS (SELECT * FROM pairs WHERE outcome = 'ok'), r AS (SELECT tier, o_orderkey, count(*) AS n FROM good GROUP BY 1, 2),
b AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY tier ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS so_far FROM r),
quota AS (SELECT g.* FROM good g JOIN b USING (tier, o_orderkey) WHERE so_far < CASE tier WHEN 'medium' THEN 2400 ELSE 1800 END)"""


@register("pair_quota", f"WITH {_QUOTA} SELECT o_orderkey, attack_type, tier FROM quota")
def pair_quota(spark: SparkSession, sf_dir: str) -> DataFrame:
    return preparation.quota_of_tiers(_kept(spark, sf_dir), "o_orderkey").select("o_orderkey", "attack_type", "tier")


@register("final_pairs", f"""WITH {_QUOTA}, d AS (SELECT *, sha256('42|' || o_orderkey || '|' || attack_type) AS h FROM quota), p AS (SELECT *, row_number() OVER (PARTITION BY tier ORDER BY h) <= CASE tier WHEN 'medium' THEN 800 ELSE 600 END AS picked FROM d),
f AS (SELECT *, row_number() OVER (ORDER BY picked DESC, h) AS f FROM p) SELECT o_orderkey, attack_type, tier FROM f WHERE f <= 2000""")
def final_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    quota = preparation.quota_of_tiers(_kept(spark, sf_dir), "o_orderkey")
    return preparation.sampled_pairs(quota, [F.col("o_orderkey"), F.col("attack_type")]).select("o_orderkey", "attack_type", "tier")


_HIT = matches_any("code", rules.DETECTOR_RULES, True)
_JUDGED = f"""SELECT {_TAGS}, {by_kind(EXTRACTED)} AS code, {SOURCE} AS extraction_source, {KIND} = 9 AS invalid_extraction, {KIND} = 12 AS flow FROM orders"""
_VERDICTS = f"SELECT *, CASE WHEN NOT invalid_extraction THEN {_HIT} OR flow END AS is_vulnerable, coalesce({_HIT}, false) AS rule_based_detected FROM ({_JUDGED}) j"


def _verdicts(spark: SparkSession, sf_dir: str, constant: bool = False) -> DataFrame:
    rows = tagged(spark, sf_dir).withColumnRenamed("o_orderkey", "sample_ord")
    samples = rows.drop("code")
    outputs = evaluate.constant_answers(samples) if constant else rows.select("sample_ord", F.col("code").alias("raw_output"))
    return evaluate.verdict_rows(outputs, samples, use_taint=True)


@register("verdict_rows", f"""WITH v AS ({_VERDICTS}) SELECT o_orderkey AS sample_ord, 's' || o_orderkey AS id, attack_type, attack_type AS vulnerability_type, difficulty, task_type, expected_vulnerable, coalesce(code, '') AS code, extraction_source, invalid_extraction, is_vulnerable,
rule_based_detected, flow AS taint_detected, concat_ws('|', CASE WHEN rule_based_detected THEN 'rule_based' END, CASE WHEN flow THEN 'taint' END) AS sources FROM v""")
def verdict_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers joined with their samples, and what every detector says; answers without code have no verdict."""
    columns = ("sample_ord", "id", *evaluate.TAGS, "expected_vulnerable", "code", "extraction_source", "invalid_extraction", "is_vulnerable", "rule_based_detected", "taint_detected")
    return _verdicts(spark, sf_dir).select(*columns, F.array_join("detection_sources", "|").alias("sources"))


@register("end_to_end_verdicts", f"WITH judged AS ({_VERDICTS}), " + bundle_sql("attack_type").replace("FROM verdicts", "FROM judged").removeprefix("WITH "))
def end_to_end_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers to verdicts to metrics in one plan."""
    return M.bundle(_verdicts(spark, sf_dir), "attack_type")


@register("constant_control", "SELECT count(*) AS n_samples, count(*) AS n_valid, 0::BIGINT AS valid_only_tp, 0::BIGINT AS valid_only_fp, count(*) FILTER (WHERE o_custkey % 2 = 1) AS valid_only_tn, count(*) FILTER (WHERE o_custkey % 2 = 0) AS valid_only_fn, 0.0::DOUBLE AS valid_only_recall, 1.0::DOUBLE AS defense_success_rate FROM orders")
def constant_control(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same safe answer to every sample, through the same plan."""
    return M.bundle(_verdicts(spark, sf_dir, constant=True)).select("n_samples", "n_valid", "valid_only_tp", "valid_only_fp", "valid_only_tn", "valid_only_fn", "valid_only_recall", "defense_success_rate")


def _bytes(text: str, special: bool) -> list[int]:
    """A stand-in for a tokenizer: a start mark and the text's bytes."""
    return [256] * special + list(text.encode())


@register("pair_token_stats", """WITH d AS (SELECT octet_length(encode(text)) AS a, octet_length(encode(lower(text))) AS b FROM documents), s AS (SELECT 5 AS p, CASE WHEN a > 0 THEN a + 4 ELSE 0 END AS c, CASE WHEN b > 0 THEN b + 4 ELSE 0 END AS r FROM d),
t AS (SELECT p, CASE WHEN p + greatest(c, r) > 1024 THEN least(c, 1024 - p) ELSE c END AS c, CASE WHEN p + greatest(c, r) > 1024 THEN least(r, 1024 - p) ELSE r END AS r, (c > 0)::INT + (r > 0)::INT AS ends FROM s)
SELECT count(*) AS total, count(*) FILTER (WHERE c > 0 AND r > 0) AS kept, 0::BIGINT AS dropped_trunc, count(*) FILTER (WHERE c = 0 OR r = 0) AS dropped_empty, sum(ends)::BIGINT AS eos_appended,
max(p) FILTER (WHERE c > 0) AS max_prompt_len, max(c) FILTER (WHERE c > 0) AS max_chosen_len, max(r) FILTER (WHERE r > 0) AS max_rejected_len, max(p + greatest(c, r)) FILTER (WHERE c > 0) AS max_total_len FROM t""")
def pair_token_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select(F.lit("say\n").alias("prompt"), F.col("text").alias("chosen"), F.lower("text").alias("rejected"))
    return preparation.pair_token_stats(preparation.tokenise_pairs(rows, _bytes, "</s>", 64, 1024))
