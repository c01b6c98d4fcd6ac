import json
import re
import subprocess
import sys
import time

import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import __spark_entry__
from sparkward.functions import once, pyast, pynames, rewrites, rules, taint
from sparkward.functions import text as T

SAFE = ['cur.execute("SELECT * FROM t WHERE a = %s", (v,))', 'cur.execute("SELECT ?", (v,))', 'conn.execute(text("SELECT :val"), {"val": v})', 'cur.execute("SELECT %(val)s", {"val": v})', 'cur.executemany("INSERT INTO t VALUES (?)", rows)']
UNSAFE = {
    'cur.execute("SELECT * FROM t WHERE a = %s" % val)': "percent_format_sql", 'cur.execute("SELECT %s, %s" % (a, b))': "percent_format_sql", 'cur.execute(f"SELECT {v}")': "fstring_sql",
    'sql = "SELECT * FROM t WHERE a = " + v': "concat_plus_sql", 'cur.execute("SELECT {0}".format(v))': "format_sql", 'c.execute(text(f"SELECT {v}"))': "sqlalchemy_text_fstring",
    'c.execute(text("SELECT {x}".format(x=v)))': "sqlalchemy_text_format", 'cur.execute(" ".join(parts))': "join_build_sql", 'cur.execute("a" + b)': "unsafe_execute_heuristic",
}


def hits(spark, codes):
    rows = spark.createDataFrame([(i, c) for i, c in enumerate(codes)], "i int, code string")
    return [r[0] for r in rows.orderBy("i").select(rules.rule_hits(F.col("code"))).collect()]


def test_rules(spark):
    assert hits(spark, SAFE + [None, ""]) == [[]] * (len(SAFE) + 2)
    for got, name in zip(hits(spark, list(UNSAFE)), UNSAFE.values(), strict=True):
        assert name in got
    # a literal that holds the other quote is a blind spot of the rules
    assert hits(spark, ["""cur.execute("SELECT * FROM t WHERE a = '%s'" % val)"""]) == [[]]


def test_merge_modes(spark):
    flags = spark.range(16).select(*(((F.col("id") / 2**i).cast("int") % 2 == 1).alias(n) for i, n in enumerate(("b608", "any", "rules", "taint"))))
    cols = [F.col(c) for c in ("b608", "any", "rules", "taint")]
    told = flags.select(*(rules.merged_verdict(m, *cols).alias(m) for m in rules.MODES))
    assert told.where("`or` <> weighted").count() == 0 and told.where("or_bandit_any and not `or`").count() == 1
    with pytest.raises(ValueError):
        rules.merged_verdict("other", *cols)


def test_extraction_order():
    fenced = "Text\n```python\nx = 1\n```\nmore\n```Python\ny = 2\n```"
    assert pyast.extract(fenced) == ("y = 2", "y = 2", "ok", "python_fence")
    assert pyast.extract("```python\nx = (\n```")[0] is None
    assert pyast.extract("```python\nx = 1\ny = (")[0::3] == ("x = 1", "incomplete_fence")
    assert pyast.extract("so:\nimport os\nprint(os)")[0::3] == ("import os\nprint(os)", "keyword_start")
    assert pyast.extract("x = 1")[0::3] == ("x = 1", "full_text_fallback")
    assert pyast.extract("") == (None, None, "no code found", "python_fence") == pyast.extract(None)
    assert pyast.extract("x = 1\nInput:\nno code")[0] == "x = 1"
    assert pyast.extract("a b c\x00")[0] is None


def test_folding():
    assert pyast.fold_repeats("ab" * 4, blocks=False) == "ab"
    twice = "import os\nx = 1\n# again\n"
    assert pyast.fold_repeats(twice + "import os\nx = 1\n# again\nimp") == twice.rstrip()
    two = "import os\nimport re\nx = re"
    assert pyast.fold_repeats(two) == two and pyast.fold_repeats(two, compat=True) == "import os"


def test_first_and_last_fence():
    text = "```python\na = 1\n```\n### Response\n```python\nb = 2\n```"
    assert pyast.code_only(text) == "a = 1" and pyast.extract_last_fence(text) == "b = 2"
    assert pyast.code_only("not python at all") is None and pyast.extract_last_fence("x") is None


@given(st.text(max_size=60))
@settings(max_examples=200, deadline=None)
def test_no_text_breaks_the_functions(text):
    pyast.extract(text), pyast.code_only(text), taint.analyse(text), rewrites.unsafe_variant(text, "fstring"), rewrites.safe_fix(text), rewrites.aligned_variant(text, "fstring", "t", "c"), pyast.locate(text), pyast.undefined_names(text), pynames.scoped_names(text), pynames.fold_copies(text)


HEAD = "import sqlite3\nc = sqlite3.connect(':memory:')\nv = taint_input('x')\n"


@pytest.mark.parametrize(("code", "flows", "error"), [
    ("c.execute(f'SELECT {v}')", 1, None), ("c.execute('SELECT ? AS x', ('ok',))", 0, None), ("c.cursor().execute('a' + input())", 1, None),
    ("def f(v):\n    c.execute('a' + v)\n", 0, None), ("def f(v):\n    c.execute('a' + v)\nf(taint_input('q'))", 1, None),
    ("c.execute('SELECT \\'%s\\'' % v)", 0, None), ("c.execute(f'a{1}%s' % v)", 1, None), ("c.execute((v + '{}').format(1))", 1, None), ("c.execute('\\'{}\\''.format(v))", 0, "OperationalError: near \"'x'\": syntax error"),
    ("import os", 0, "ImportError: module 'os' is not allowed in taint sandbox"), ("x = (", 0, "transform_syntax_error: '(' was never closed (<unknown>, line 4)"),
    ("while True:\n    pass", 0, "limit"), ("for x in [1, 2]:\n    c.execute('a' + input())", 2, None), ("c.execute(v)\nundefined", 1, "NameError: name 'undefined' is not defined"),
    ("def f(a, b): pass\nf(1)", 0, "TypeError: f() missing 1 required positional argument: 'b'"), ("if __name__ == '__main__':\n    c.execute(v)", 0, "NameError: name '__name__' is not defined"),
    ("return 1", 0, "SyntaxError: 'return' outside function (<taint_sandbox>, line 4)"), ("with c:\n    pass", 0, "TypeError: '_ConnWrapper' object does not support the context manager protocol"),
    ("[x for x in {'a': v}.values() if c.execute(x) is None]", 1, None), ("def f():\n    n = 0\n    def g():\n        nonlocal n\n        n += 1\n        return n\n    return g\ng = f()\ng()\nc.execute('a' * g() + v)", 1, None),
    ("try:\n    raise ValueError('x')\nexcept (KeyError, ValueError) as e:\n    c.execute(f'{e}{v}')\nelse:\n    c.execute(v)\nfinally:\n    c.execute(v)", 2, None),
    ("ok = [x for x in sorted(['b', v], key=lambda s: s) if hasattr(x, 'tainted')]\nc.execute(ok[0])", 1, None), ("def f(): yield v\nc.execute(next(f()))", 1, None), ("c.execute(str(v) + f'{v:>3}')", 1, None),
])
def test_taint(code, flows, error):
    vulnerable, n, details, told = taint.analyse(HEAD + code)
    assert (n, told, vulnerable, len(details)) == (flows, error, flows > 0, flows)


GREEDY = [
    "for i in range(10 ** 25):\n    pass", "x = list(range(10 ** 10))", "x = 'a'\nfor i in range(40):\n    x = x + x", "x = [1]\nfor i in range(90):\n    x = [x, x]\nstr(x)", "x = 'a' * 10 ** 9", "x = 9 ** 9 ** 9", "x = 1 << 10 ** 9",
    "x = f'{1:1000000000}'", "x = '%1000000000d' % 1", "x = '%*d' % (10 ** 9, 1)", "x = '{:>{}}'.format('a', 10 ** 9)", "x = 'a'.ljust(10 ** 9)", "x = ('a' * 99999).replace('a', 'b' * 99999)", "x = ('a' * 9999).join(['b'] * 99999)",
    "next(filter(None, iter(int, 1)))", "1 in iter(int, 1)", "sum(map(int, iter(lambda: '1', 2)))", "x = []\nx += iter(int, 1)", "[].extend(iter(int, 1))", "a, *b = iter(int, 1)", "def f(): return f()\nf()", "x = []\nwhile 1:\n    x.append(x)",
    "q = 'WITH RECURSIVE c(x) AS (SELECT 1 UNION ALL SELECT x + 1 FROM c) '\nc.execute(q + 'SELECT zeroblob(8000) FROM c').fetchall()", "q = 'WITH RECURSIVE c(x) AS (SELECT 1 UNION ALL SELECT x + 1 FROM c) '\nc.execute(q + 'SELECT sum(x) FROM c')",
    "c.execute('SELECT zeroblob(1000000000)').fetchall()", "x = max(range(10 ** 12))", "x = {i: 'a' * 99999 for i in range(10 ** 6)}", "x = " + "(" * 150 + ")" * 150 + "[0]", "x = " + "-" * 50_000 + "1", "c.execute(\"ATTACH '/tmp/other.db' AS o\")",
    "open('/tmp/x', 'w')", "__import__('os').system('true')", "''.__class__.__mro__", "'{0.__class__}'.format(c)", "type('A', (), {})", "getattr('', '__class__')", "c.enable_load_extension(True)",
]


def test_no_code_takes_much():
    """Greedy texts, one after the other, in a process that may grow by 50 MB only; each ends with an error."""
    program = """
import resource, sys, json
from sparkward.functions import taint
taint.analyse("import sqlite3; c = sqlite3.connect('x'); x = [i for i in range(9)]")
size = int(open('/proc/self/statm').read().split()[0]) * resource.getpagesize()
resource.setrlimit(resource.RLIMIT_AS, (size + 50 * 2**20,) * 2)
print(json.dumps([taint.analyse(c)[3] for c in json.loads(sys.stdin.read())]))
"""
    began = time.time()
    done = subprocess.run([sys.executable, "-c", program], input=json.dumps([HEAD + g for g in GREEDY]), capture_output=True, text=True, timeout=120, check=True)
    told = json.loads(done.stdout)
    assert all(told), [g for g, t in zip(GREEDY, told, strict=True) if not t]
    assert time.time() - began < 60


PROGRAM = 'import sqlite3\n\ndef find(conn, value):\n    sql = "SELECT * FROM t WHERE a = ?"\n    return conn.execute(sql, (value,)).fetchall()\n'


ATTACKS = ["string_concat", "fstring", "format_string", "fake_sanitization", "orm_misuse", "parameterized_query", "indirect_injection"]


@pytest.mark.parametrize("attack", ATTACKS)
def test_unsafe_variants_and_back(spark, attack):
    made = rewrites.unsafe_variant(PROGRAM, attack)
    assert pyast.isomorphic(PROGRAM, made) == (True, "ok")
    assert hits(spark, [made]) != [[]] and hits(spark, [PROGRAM]) == [[]]
    fixed = rewrites.safe_fix(made)
    assert hits(spark, [fixed]) == [[]] and "?" in fixed


def test_variants_differ_and_follow_indirect_sql():
    assert len({rewrites.unsafe_variant(PROGRAM, a) for a in ATTACKS}) == len(ATTACKS)
    chain = 'def sql_of():\n    return "SELECT * FROM t WHERE a = ?"\n\ndef find(cur, value):\n    if value:\n        cur.execute(sql_of(), (value,))\n'
    assert ("indirect", "sql_of", 6, "SELECT * FROM t WHERE a = ?") in pyast.locate(chain)
    made = rewrites.unsafe_variant(chain, "indirect_injection")
    assert "        query = 'SELECT * FROM t WHERE a = ' + value\n        cur.execute(query)" in made
    assert rewrites.safe_fix('q = "SELECT a FROM t WHERE b = " + v\ncur.execute(q)') == "q = 'SELECT a FROM t WHERE b = ?'\ncur.execute(q, (v,))"


@pytest.mark.parametrize(("code", "fixed"), [
    ('sql = "SELECT * FROM t WHERE a = " + a\nif b:\n    sql += " AND b = " + b\ncur.execute(sql)', "sql = 'SELECT * FROM t WHERE a = ?'\nparams = [a]\nif b:\n    sql += ' AND b = ?'\n    params += [b]\ncur.execute(sql, params)"),
    ('sql = "SELECT 1"\nif a:\n    sql = "SELECT b FROM t WHERE a = " + a\n    cur.execute(sql)\nelse:\n    cur.execute(sql)', "sql = 'SELECT 1'\nif a:\n    sql = 'SELECT b FROM t WHERE a = ?'\n    cur.execute(sql, (a,))\nelse:\n    cur.execute(sql)"),
    ("params = 1\nq = 'SELECT a FROM t'\nfor x in y:\n    if x:\n        break\n    q += ' OR a = ' + x\ncur.execute(q)", "params = 1\nq = 'SELECT a FROM t'\nparams_1 = []\nfor x in y:\n    if x:\n        break\n    q += ' OR a = ?'\n    params_1 += [x]\ncur.execute(q, params_1)"),
    ("def f(sql):\n    cur.execute(sql)\ndef g(v):\n    sql = 'a' + v", None), ("for sql in queries:\n    cur.execute(sql)", None), ("q = 'SELECT ' + v\nq = other()\ncur.execute(q)", None),
    ('cur.execute("SELECT * FROM " + t)', None), ('cur.execute("SELECT a FROM t WHERE b = \'" + v)', None), ('cur.execute("SELECT a FROM t WHERE b = \'x" + v + "y\' AND c = \'%s\'" % w)', "cur.execute('SELECT a FROM t WHERE b = ? AND c = ?', (f'x{v}y', w))"),
    ('import pymysql\ncur.execute(f"SELECT a FROM t WHERE b LIKE \'{v}%\' AND c = \'5%\'")', "import pymysql\ncur.execute(\"SELECT a FROM t WHERE b LIKE %s AND c = '5%%'\", (f'{v}%',))"),
    ("cur.execute(f'SELECT a FROM t WHERE b = {v:>5}')", "cur.execute('SELECT a FROM t WHERE b = ?', (f'{v:>5}',))"), ("def f(a):\n    return 'x'\n    cur.execute('SELECT a FROM t WHERE b = ' + a)", None),
])
def test_fixes_follow_definitions(code, fixed):
    assert rewrites.safe_fix(code) == fixed


def test_aligned_variants():
    chosen = "import pymysql\n\ndef other(a, b):\n    return a\n\ndef find(conn, uid: int):\n    return conn.table('t').where(uid)\n"
    assert rewrites.aligned_variant(chosen.replace("other(a, b)", "other(conn)"), "fstring", "users", "id").endswith("def find(conn, uid: int):\n    return conn.execute(f'SELECT * FROM users WHERE id = {uid}').fetchall()")
    for attack in ATTACKS:
        assert pyast.isomorphic(PROGRAM.replace("execute", "run"), rewrites.aligned_variant(PROGRAM.replace("execute", "run"), attack, "t", "c"))[1] in ("ok", "names missing: sql")
    for text in ("x = 1", "def f(cur): pass", "def f(a, b): pass", "def f(", None):
        assert rewrites.aligned_variant(text, "fstring", "t", "c") is None


@given(st.text(alphabet="ab", max_size=12), st.integers(0, 3))
def test_pieces(piece, doublings):
    got = pyast.smallest_piece(piece * 2**doublings)
    assert got * (len(piece * 2**doublings) // max(1, len(got))) == piece * 2**doublings and len(got) <= max(len(piece), len(got) * (not piece))


def test_shortened_texts():
    assert list(pyast.shortened("a\nb\nc")) == ["a\nb\nc", "a\nb", "a"] and list(pyast.shortened("a")) == ["a"]
    assert len(list(pyast.shortened("\n".join("abcdefgh")))) == 5 and list(pyast.shortened("\n\nx")) == ["\n\nx"]
    assert pyast.parse_or_shorten("x = 1\ny = (") == (True, "x = 1", "ok_truncated_last_1_lines")


def test_isomorphism_reasons():
    assert pyast.isomorphic("import os", "import re")[1] == "imports differ"
    assert pyast.isomorphic("def f(a): pass", "def f(b): pass")[1] == "signatures differ"
    assert not pyast.isomorphic("x = y", "x = 1")[0] and not pyast.isomorphic("(", "x")[0]


def test_text_functions(spark):
    row = spark.createDataFrame([("Instruction:\na\nInput:\nq\nInput:\n\nOutput: x\n\ncode",)], "t string")
    assert row.select(T.after_leak(F.col("t"))).first()[0] == "code"
    assert row.select(T.leaks_prompt(F.col("t"))).first()[0]
    assert row.select(T.percent_cell(F.lit(0.85)), T.percent_cell(F.lit(None).cast("double"), 5), T.metric_cell(F.lit(0.5))).first()[:] == ("   85.0%", "  N/A", "0.5000")
    assert row.select(T.optional_double(F.lit("x")), T.optional_double(F.lit("1.5"))).first()[:] == (None, 1.5)
    assert row.select(T.strip(F.lit("  a\t"))).first()[0] == "a"
    a = "12\n" * 20
    assert row.select(T.repeats_itself(F.lit(a))).first()[0] and not row.select(T.repeats_itself(F.lit("a"))).first()[0]


def test_stable_id_is_hashlib(spark):
    import hashlib

    got = spark.range(1).select(T.stable_id(F.lit(" fix "), F.lit("x"), F.lit("é"), F.lit(None).cast("string"))).first()[0]
    assert got == "sqlsec-" + hashlib.sha256("fix\nx\né\n".encode()).hexdigest()[:20]


@pytest.mark.parametrize(("code", "want"), [
    ("def f():\n    return [y for x in z for y in x if y]\nz = 1", []), ("x = [i for i in range(3)]\ni", [("", "i", 2, "undefined")]), ("def f(a=b): pass\nb = 1", [("", "b", 1, "before")]),
    ("while True:\n    if q:\n        break\n    q = 1", []), ("def f():\n    del x\n    x = 1", []), ("from m import *\nanything", []), ("__name__", []), ("def f():\n    global g\n    return g", [("f", "g", 3, "undefined")]),
    ("def f():\n    try:\n        v = 1\n    except E:\n        pass\n    return v", [("f", "E", 4, "undefined")]), ("match 1:\n    case x:\n        print(x)", []), ("x: int\nprint(x)", [("", "x", 2, "before")]), ("not python (", []), (None, []),
])
def test_scoped_names(code, want):
    assert pynames.scoped_names(code) == want


@given(st.lists(st.integers(0, 1), max_size=14))
def test_z_function(s):
    assert pynames.z_function(s) == [next((k for k in range(len(s) - i) if s[k] != s[i + k]), len(s) - i) for i in range(len(s))]


def test_folding_by_statements():
    piece = "import os\nx = 1\nprint(x)\n"
    for text in (piece * 2, piece * 5, piece + "# other\n" + piece, piece * 2 + "import os\nx", piece * 2 + "import os\nx = 1\npri", piece * 2 + "import os\nx = 1\nprint("):
        assert pynames.fold_copies(text) == piece.rstrip(), text
    for text in (piece, piece + "x = 2\n", piece * 2 + "y = 1\n", piece + piece.replace("1", "2")):
        assert pynames.fold_copies(text) == text
    assert pynames.fold_copies(None) is None and pynames.fold_copies("(((") is None and pynames.fold_copies("") == ""


@pytest.mark.parametrize("query", ["aligned_variant", "unsafe_variant", "scoped_names", "taint_flows", "safe_fix_flows", "safe_fix", "folded_copies", "verdict_rows"])
def test_equal_texts_are_judged_once(spark, sf_dir, query):
    """Python sees different texts only, dealt by their number, and no filter on its result is moved below that."""
    plan = __spark_entry__.queries()[query](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    steps = re.findall(r"^[ :+|-]*(ArrowEvalPython|Generate ScopedNames|Generate|RepartitionByExpression|Aggregate|Relation)", plan, re.MULTILINE)
    python = [i for i, x in enumerate(steps) if x != "RepartitionByExpression" and x not in ("Aggregate", "Relation")]
    assert python and all("RepartitionByExpression" in (below := steps[i : steps.index("Relation", i)]) and "Aggregate" in below for i in python)


def test_of_each_follows_rows(spark):
    rows = spark.createDataFrame([(1, "a", None), (2, "a", None), (3, "", "x"), (4, None, "x"), (5, "b", "x")], "i int, t string, u string")
    seen = spark.sparkContext.accumulator(0)

    def told(kinds):
        def count(texts: pd.Series) -> pd.Series:
            seen.add(len(texts))
            return texts

        return kinds.where("t is null or t <> 'b'").withColumn("again", once.costly(count, "string")(F.col("t"))).withColumn("n", F.explode(F.array(F.lit(1), F.lit(2))))

    got = once.of_each(rows, ["t", "u"], told).where("again is null or again <> 'z'").select("i", "again", "n").collect()
    assert sorted((r.i, r.again or "-", r.n) for r in got) == [(i, x, n) for i, x in ((1, "a"), (2, "a"), (3, "-"), (4, "-")) for n in (1, 2)]
    assert seen.value == 3
