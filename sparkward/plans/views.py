"""Views that give the tables of the driver the shape of evaluation data.

The SELECT texts hold in Spark SQL and in DuckDB alike; queries use them through spark.sql and oracles as common table
expressions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

VERDICTS = """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
  concat(l_returnflag, l_linestatus) AS attack_type,
  CASE l_linenumber % 3 WHEN 0 THEN 'easy' WHEN 1 THEN 'medium' ELSE 'hard' END AS difficulty,
  CASE l_linenumber % 2 WHEN 0 THEN 'fix' ELSE 'generation' END AS task_type,
  l_suppkey % 5 AS model,
  l_discount > 0.05 AS expected_vulnerable,
  l_tax >= 0.07 AS invalid_extraction,
  (l_tax < 0.07 AND l_quantity > 30) AS bandit_detected,
  (l_tax < 0.07 AND l_quantity > 40) AS bandit_b608,
  (l_tax < 0.07 AND l_partkey % 7 = 0) AS rule_based_detected,
  (l_tax < 0.07 AND l_suppkey % 11 = 0) AS taint_detected,
  CASE WHEN l_tax >= 0.07 THEN NULL ELSE (l_quantity > 40 OR l_partkey % 7 = 0 OR l_suppkey % 11 = 0) END AS is_vulnerable
FROM lineitem
"""

# Answers of a model, each in a way of its own. FIND, TBL and COL stand for names that change from row to row.
SNIPPETS = (
    'import sqlite3\ndef FIND(conn, value):\n    cur = conn.cursor()\n    cur.execute("SELECT * FROM TBL WHERE COL = ?", (value,))\n    return cur.fetchall()',
    'import pymysql\ndef FIND(cur, value):\n    sql = "SELECT * FROM TBL WHERE COL = " + value\n    cur.execute(sql)\n    return cur.fetchall()',
    'import psycopg2\ndef FIND(cur, value):\n    cur.execute(f"SELECT * FROM TBL WHERE COL = {value}")\n    return cur.fetchall()',
    'import pymysql\ndef FIND(cur, value):\n    cur.execute("SELECT * FROM TBL WHERE COL = %s" % value)\n    return cur.fetchall()',
    'from sqlalchemy import text\nclass Repo:\n    def FIND(self, session, value):\n        return session.execute(text("SELECT * FROM TBL WHERE COL = {}".format(value)))',
    'import asyncpg\nasync def FIND(conn, value):\n    return await conn.fetch("SELECT * FROM TBL WHERE COL = $1", value)',
    'import sqlite3\ndef FIND(conn, value:\n    return conn.execute("SELECT 1")',
    'Here is the fix:\n```python\nimport sqlite3\ndef FIND(conn, value):\n    with conn.cursor() as cur:\n        cur.execute("SELECT * FROM TBL WHERE COL = ?", (value,))\n        return cur.fetchone()\n```\nDone.',
    'Sure.\n```python\nimport sqlite3\n\ndef FIND(conn, value):\n    return conn.execute("SELECT COL FROM TBL WHERE id = ?", (value,)).fetchall()',
    'I cannot help with the TBL table today.',
    'COL = "TBL";COL = "TBL";',
    'import pymysql\nNAME = "TBL"\ndef FIND(cur):\n    return cur.execute("SELECT COL FROM TBL")\n\nimport pymysql\nNAME = "TBL"\ndef FIND(cur):\n    return cur.execute("SELECT COL FROM TBL")\n\nimp',
    'import sqlite3\nc = sqlite3.connect(":memory:")\nv = taint_input("COL")\nc.execute(f"SELECT * FROM TBL WHERE COL = {v}")',
    'import sqlite3\nc = sqlite3.connect(":memory:")\nv = taint_input("COL")\nc.execute("SELECT * FROM TBL WHERE COL = ?", (v,))',
    'import requests\nrequests.get("TBL")',
    'def FIND(cur):\n    cur.execute("SELECT * FROM TBL WHERE COL = ?", (wanted,))\n    return cur.fetchall()',
    'First:\n```python\nvalue = "COL"\n```\nThen:\n```python\ndef FIND(:\n```',
    'def FIND(cur):\n    return cur.fetchone()\nInstruction:\nuse the TBL table',
    'import sqlite3\n\n\ndef sql_of():\n    return "SELECT * FROM TBL WHERE COL = ?"\n\n\ndef FIND(cur, value):\n    cur.execute(sql_of(), (value,))\n    return cur.fetchall()',
    'import psycopg2\n\n\ndef FIND(cur, value, other):\n    query = "SELECT * FROM TBL WHERE COL = %s AND state = %s"\n    cur.execute(query, (value, other))\n    return cur.fetchall()',
)
_START = 'import sqlite3\nc = sqlite3.connect(":memory:")\nv = taint_input("COL")\n'
# Programs whose flows pass through containers, functions, loops, branches and errors.
FLOWS = tuple(_START + text for text in (
    'parts = []\nparts.append("SELECT * FROM TBL WHERE COL = ")\nparts.append(v)\nc.execute(parts[0] + parts[1])',
    'given = {"sql": "SELECT * FROM TBL WHERE COL = " + v}\nc.execute(given["sql"])',
    'for sql in ["SELECT %d" % i + v for i in range(3) if i]:\n    c.execute(sql)',
    'i = 0\nwhile True:\n    i += 1\n    if i == 2:\n        continue\n    c.execute("SELECT COL" + v)\n    if i > 3:\n        break',
    'try:\n    c.execute("SELECT COL FROM TBL")\nexcept sqlite3.Error as e:\n    c.execute(f"{e} {v}")',
    'cur = c.cursor()\nsql_of = lambda x, head="SELECT * FROM TBL WHERE COL = ": head + x\ncur.execute(sql_of(v))',
    'c.execute(f"SELECT {v!r:>12}")',
    'c.execute("SELECT " + v)\nclass Repo:\n    pass',
    'c.execute("SELECT " + v)\nimport os\nc.execute("DELETE " + v)',
    'c.execute("SELECT \'" + v.strip() + "\'")',
    'c.execute("SELECT " + v)\nx = "TBL"\nfor i in range(60):\n    x = x + x',
    'def find():\n    return 1\nfind.sql = "SELECT " + v\nc.execute(find.sql)',
    'try:\n    1 / 0\nfinally:\n    c.execute("SELECT " + v)',
    'def queries(*names, **more):\n    for n in names:\n        yield "SELECT " + n\nfirst, *rest = queries("1", v, v)\nc.execute(first)\nfor q in rest:\n    c.execute(q)',
    'c.execute("CREATE TABLE TBL (COL)")\nc.execute("INSERT INTO TBL VALUES (?)", (v,))\nif c.execute("SELECT count(*) FROM TBL").fetchone()[0]:\n    c.execute("SELECT " + v)',
    'c.execute(f"SELECT {1} %s" % v)\nc.execute("SELECT \'%s\'" % v)',
    'def deep(n):\n    global found\n    found = v if n == 0 else deep(n - 1)\n    return found\nc.execute("SELECT " + deep(5))\nfor x in range(10 ** 12):\n    pass',
))
# Queries that are put together over several statements.
BUILDS = (
    'def FIND(cur, a, b):\n    sql = "SELECT * FROM TBL WHERE COL = " + a\n    if b:\n        sql += " AND state = \'" + b + "\'"\n    cur.execute(sql)\n    return cur.fetchall()',
    'def FIND(cur, a):\n    if a:\n        q = f"SELECT * FROM TBL WHERE COL = {a}"\n    else:\n        q = "SELECT * FROM TBL"\n    cur.execute(q)\n    return cur.fetchall()',
    'import pymysql\n\ndef FIND(cur, items):\n    q = "SELECT * FROM TBL WHERE 1 = 0"\n    for item in items:\n        q += " OR COL = %s" % item\n    cur.execute(q)',
    'def show(v):\n    sql = "COL " + v\n    return sql\n\ndef FIND(cur, sql):\n    cur.execute(sql)',
    'BASE = "SELECT * FROM TBL"\n\ndef FIND(cur, a):\n    cur.execute(BASE + f" WHERE COL LIKE \'%{a}%\'")',
    'def FIND(cur, a):\n    q = "SELECT * FROM TBL WHERE COL = " + a\n    a = None\n    cur.execute(q)',
    'def FIND(cur, a):\n    cur.execute("SELECT * FROM " + a)',
    'def FIND(cur, a):\n    try:\n        q = "SELECT COL FROM TBL WHERE COL = " + a\n    except TypeError:\n        q = "SELECT COL FROM TBL"\n    while a:\n        cur.execute(q)\n        q += " OR COL = " + a',
    'def FIND(cur, a):\n    q = make(a)\n    q += " WHERE COL = " + a\n    cur.execute(q)',
)
# Programs with names of many scopes, and programs that repeat themselves.
SCOPES = (
    'def FIND(a):\n    x = a\n    return COL\n\ndef other():\n    COL = 1\n    return COL\nprint(x)',
    'print(COL)\nCOL = 1\n[q for q in range(3)]\nq',
    'def FIND():\n    print(a)\n    a = 1\n    def inner():\n        nonlocal a\n        return a + COL\n    return inner',
    'n = 0\ndef FIND():\n    global m\n    m = 1\n    return n\nprint(m, COL)',
    'if x := 3:\n    print(x)\nfor i in []:\n    k = i\nprint(k, i)',
    'class Repo:\n    limit = 1\n    def FIND(self):\n        return limit\n    rows = COL',
    'FIND = lambda t: t + COL\ntry:\n    import json\nexcept ImportError as e:\n    print(e)\nprint(json)\ncount += 1',
    'def FIND(rows):\n    for r in rows:\n        if r:\n            last = r\n    return last, [last for last in rows]',
)
_PIECE = 'import sqlite3\n# the TBL table\ndef FIND(cur):\n    return cur.execute("SELECT COL FROM TBL")\n'
REPEATS = (
    _PIECE * 3, _PIECE + _PIECE.replace("# the", "# once more the"), _PIECE + _PIECE.replace("    return", "\n    return").replace("(cur)", "( cur )"), _PIECE * 2 + "import sqlite3\ndef FIND(cur):\n    ret", _PIECE * 2 + "imp",
    _PIECE + 'x = (', _PIECE * 2 + "import os\n", _PIECE + _PIECE.replace("COL", "other"), "no program (",
)
SCOPE_KIND, REPEAT_KIND = f"o_orderkey % {len(SCOPES)}", f"o_orderkey % {len(REPEATS)}"
BUILD_KIND = f"o_orderkey % {len(BUILDS)}"
FLOW_KIND = f"o_orderkey % {len(FLOWS)}"
NAMES = {"TBL": ("users", "orders", "products", "accounts", "sessions", "payments", "reviews", "tickets", "inventory"), "COL": ("name", "email", "status", "username", "token", "city", "price")}
KIND = f"o_orderkey % {len(SNIPPETS)}"


def _literal(text: str, engine: str) -> str:
    quoted = "'" + text.replace("\\", "\\\\").replace("'", "''" if engine == "duckdb" else "\\'").replace("\n", "\\n") + "'"
    return f"E{quoted}" if engine == "duckdb" else quoted


def by_kind(texts: dict[int, str | None], engine: str = "duckdb", kind: str = KIND) -> str:
    """SQL over orders: the text of the row's kind with the row's names in it, null where the kind has none."""
    some = {i: t for i, t in texts.items() if t is not None}
    return named(f"CASE {kind} {' '.join(f'WHEN {i} THEN {_literal(t, engine)}' for i, t in some.items())} END", engine)


def named(text: str, engine: str = "duckdb") -> str:
    """SQL over orders: the text (an SQL expression) with the row's names in it."""
    out = f"replace({text}, 'FIND', concat('find_', CAST(o_custkey % 97 AS STRING)))"
    for mark, names in NAMES.items():
        out = f"replace({out}, '{mark}', CASE o_custkey % {len(names)} {' '.join(f'WHEN {i} THEN {_literal(n, engine)}' for i, n in enumerate(names))} END)"
    return out


def code_samples(engine: str) -> str:
    return f"SELECT o_orderkey, o_custkey, {KIND} AS kind, {by_kind(dict(enumerate(SNIPPETS)), engine)} AS code FROM orders"


def flow_samples(engine: str) -> str:
    return f"SELECT o_orderkey, o_custkey, {FLOW_KIND} AS kind, {by_kind(dict(enumerate(FLOWS)), engine, FLOW_KIND)} AS code FROM orders"


def build_samples(engine: str) -> str:
    return f"SELECT o_orderkey, o_custkey, {BUILD_KIND} AS kind, {by_kind(dict(enumerate(BUILDS)), engine, BUILD_KIND)} AS code FROM orders"


def scope_samples(engine: str) -> str:
    return f"SELECT o_orderkey, o_custkey, {SCOPE_KIND} AS kind, {by_kind(dict(enumerate(SCOPES)), engine, SCOPE_KIND)} AS code FROM orders"


def repeat_samples(engine: str) -> str:
    return f"SELECT o_orderkey, o_custkey, {REPEAT_KIND} AS kind, {by_kind(dict(enumerate(REPEATS)), engine, REPEAT_KIND)} AS code FROM orders"


TRAINLOG = """
SELECT user_id AS run_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS step, value AS val_loss,
  CASE WHEN event_type = 'click' THEN value * 0.4 END AS train_loss, ts
FROM events
"""

CHAT = """
SELECT a.conv_id, a.turn, u.text AS prompt, a.text AS response
FROM conversations u JOIN conversations a ON u.conv_id = a.conv_id AND a.turn = u.turn + 1
WHERE u.role = 'user' AND a.role = 'assistant'
"""

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")
_NAMES = {"verdicts": ("lineitem", VERDICTS), "trainlog": ("events", TRAINLOG), "chat": ("conversations", CHAT), "code_samples": ("orders", code_samples("spark")), "flow_samples": ("orders", flow_samples("spark")), "build_samples": ("orders", build_samples("spark")), "scope_samples": ("orders", scope_samples("spark")), "repeat_samples": ("orders", repeat_samples("spark"))}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view over its table, by name."""
    source, text = _NAMES[name]
    text = text.replace("{", "{{").replace("}", "}}")
    text = text.replace("FROM conversations u JOIN conversations a", "FROM {t} u JOIN {t} a").replace(f"FROM {source}", "FROM {t}")
    return spark.sql(text, t=table(spark, sf_dir, source))


def with_views(sql: str) -> str:
    """DuckDB SQL with the views that it names in front."""
    parts = {"verdicts": VERDICTS, "trainlog": TRAINLOG, "chat": CHAT, "code_samples": code_samples("duckdb"), "flow_samples": flow_samples("duckdb"), "build_samples": build_samples("duckdb"), "scope_samples": scope_samples("duckdb"), "repeat_samples": repeat_samples("duckdb")}
    used = [f"{n} AS ({t})" for n, t in parts.items() if n in sql]
    head = ", ".join(used)
    body = sql.strip()
    if not head:
        return body
    start = "WITH RECURSIVE " if body.upper().startswith("WITH RECURSIVE ") else "WITH "
    return f"{start}{head}, {body[len(start):]}" if body.upper().startswith("WITH ") else f"WITH {head} {body}"
