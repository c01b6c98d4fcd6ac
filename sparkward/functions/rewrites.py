"""Rewrites between bound parameters and string-built SQL, for preference pairs and fixes. Both work on the tree."""

from __future__ import annotations

import ast
import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column

from sparkward.functions import defs, once, pyast

PLACEHOLDER = re.compile(r"%s|\?|:[A-Za-z_]\w*|\$\d+")
CALLS = ("execute", "executemany")


def _is_call(node: ast.AST) -> bool:
    return isinstance(node, ast.Call) and isinstance(node.func, ast.Attribute) and node.func.attr in CALLS and bool(node.args)


def _known(tree: ast.Module) -> tuple[dict[str, str], dict[str, str]]:
    """SQL texts by the name that they are assigned to, and by the function that returns them."""
    assigned = {t.id: sql for n in ast.walk(tree) if isinstance(n, ast.Assign) and (sql := pyast.constant_sql(n.value)) for t in n.targets if isinstance(t, ast.Name)}
    return assigned, pyast.returned_sql(tree)


def _values(params: ast.AST | None) -> list[ast.expr]:
    if isinstance(params, (ast.Tuple, ast.List)):
        return params.elts
    if isinstance(params, ast.Dict):
        return params.values
    return [params] if isinstance(params, ast.expr) else []


def _joined(parts: list[str], values: list[ast.expr]) -> ast.expr:
    out: ast.expr = ast.Constant(parts[0])
    for v, p in zip(values, parts[1:], strict=True):
        out = ast.BinOp(out, ast.Add(), v)
        if p:
            out = ast.BinOp(out, ast.Add(), ast.Constant(p))
    return out


def _fstring(parts: list[str], values: list[ast.expr]) -> ast.expr:
    pieces = [x for p, v in zip(parts, [*values, None], strict=True) for x in (ast.Constant(p) if p else None, v and ast.FormattedValue(v, -1)) if x is not None]
    return ast.JoinedStr(pieces)


def _formatted(parts: list[str], values: list[ast.expr]) -> ast.expr:
    escaped = [p.replace("{", "{{").replace("}", "}}") for p in parts]
    text = escaped[0] + "".join(f"{{{i}}}{p}" for i, p in enumerate(escaped[1:]))
    return ast.Call(ast.Attribute(ast.Constant(text), "format", ast.Load()), values, [])


def _percent(parts: list[str], values: list[ast.expr]) -> ast.expr:
    text = "%s".join(p.replace("%", "%%") for p in parts)
    return ast.BinOp(ast.Constant(text), ast.Mod(), values[0] if len(values) == 1 and isinstance(values[0], ast.Name) else ast.Tuple(values, ast.Load()))


def _unquoted(v: ast.expr) -> ast.expr:
    """str(v) without quotes: a clean-up that cleans nothing."""
    text = ast.Call(ast.Name("str", ast.Load()), [v], [])
    return ast.Call(ast.Attribute(text, "replace", ast.Load()), [ast.Constant("'"), ast.Constant("")], [])


#: How the values get into the SQL text, by attack type.
BUILT = {
    "string_concat": _joined, "fstring": _fstring, "format_string": _formatted, "fake_sanitization": lambda parts, values: _joined(parts, [_unquoted(v) for v in values]),
    "orm_misuse": _percent, "parameterized_query": _fstring, "indirect_injection": _joined,
}


def _before(tree: ast.Module, call: ast.Call, new: ast.stmt) -> None:
    """Put a statement before the one that holds the call."""
    for block in (b for n in ast.walk(tree) for b in (getattr(n, "body", None), getattr(n, "orelse", None), getattr(n, "finalbody", None)) if isinstance(b, list)):
        for k, statement in enumerate(block):
            inner = {x for part in ("body", "orelse", "finalbody", "handlers") for y in getattr(statement, part, []) for x in ast.walk(y)}
            if any(x is call for x in ast.walk(statement)) and call not in inner:
                block.insert(k, new)
                return


#: Texts whose results a worker remembers; generated code repeats.
MEMO = 4096


@lru_cache(MEMO)
def unsafe_variant(code: str | None, attack: str) -> str | None:
    """The program with the first bound query built as a string instead; None where there is no such query.

    Each attack type has a form of its own: joined, an f-string, format, joined values that pass a useless clean-up,
    per cent signs (inside text() where the program uses it), an f-string beside an empty tuple of parameters, and a
    query that is put together in a variable first. The SQL may stand in the call, in a name, or in a function that
    returns it. Definitions stay, so imports, signatures and names are those of the input.
    """
    tree = pyast.parse(code)[0]
    if tree is None:
        return None
    assigned, returned = _known(tree)
    for call in ast.walk(tree):
        if not _is_call(call):
            continue
        first = call.args[0]
        called = first.func.id if isinstance(first, ast.Call) and isinstance(first.func, ast.Name) else ""
        sql = assigned.get(first.id) if isinstance(first, ast.Name) else returned.get(called) or pyast.constant_sql(first)
        values = _values(call.args[1]) if len(call.args) > 1 else []
        if sql is None or not values or len(PLACEHOLDER.findall(sql)) != len(values):
            continue
        made = BUILT[attack](PLACEHOLDER.split(sql), values)
        if attack == "indirect_injection":
            name = first.id if isinstance(first, ast.Name) else "query"
            _before(tree, call, ast.Assign([ast.Name(name, ast.Store())], made, lineno=call.lineno))
            made = ast.Name(name, ast.Load())
        call.args = [ast.Call(ast.Name("text", ast.Load()), [made], []) if called == "text" else made, *([ast.Tuple([], ast.Load())] if attack == "parameterized_query" else [])]
        return ast.unparse(ast.fix_missing_locations(tree))
    return None


#: Stands for a value in a template.
HOLE = "\x00"
NAMED = re.compile(rf"(?i)\b(?:from|join|into|update|table|by)\s+{HOLE}")
Template = tuple[str, list[ast.expr]]


def _template(e: ast.expr, text_of) -> Template:
    """The string that an expression builds, with a hole for each value, and the values. text_of gives a name's text."""
    if isinstance(e, ast.Constant) and isinstance(e.value, str):
        return e.value, []
    if isinstance(e, ast.JoinedStr):
        parts = [(p.value, []) if isinstance(p, ast.Constant) else _template(p.value, text_of) if p.conversion == -1 and p.format_spec is None else (HOLE, [ast.JoinedStr([p])]) for p in e.values]
        return "".join(p[0] for p in parts), [v for p in parts for v in p[1]]
    if isinstance(e, ast.BinOp) and isinstance(e.op, ast.Add):
        a, b = _template(e.left, text_of), _template(e.right, text_of)
        return a[0] + b[0], a[1] + b[1]
    if isinstance(e, ast.BinOp) and isinstance(e.op, ast.Mod) and isinstance(e.left, ast.Constant) and isinstance(e.left.value, str):
        values, sql = _values(e.right), re.sub("%[sd]", HOLE, e.left.value).replace("%%", "%")
        if sql.count(HOLE) == len(values):
            return sql, values
    if isinstance(e, ast.Call) and isinstance(e.func, ast.Attribute) and e.func.attr == "format" and isinstance(e.func.value, ast.Constant) and isinstance(e.func.value.value, str) and not e.keywords:
        sql = re.sub(r"\{\d*\}", HOLE, e.func.value.value)
        if sql.count(HOLE) == len(e.args):
            return sql, e.args
    if isinstance(e, ast.Name) and (known := text_of(e.id)) is not None:
        return known, []
    return HOLE, [e]


def _bound(made: Template) -> Template | None:
    """The template with quoted values free of their quotes; None where a value cannot be bound.

    A value within a longer quoted text, as in '%value%', becomes one value with that text around it. Text that leaves a
    quote open cannot be bound piece by piece, and the name of a table or column is no value.
    """
    sql, values = made
    if sql.count("'") % 2 or NAMED.search(sql):
        return None
    out, left = [], list(values)
    for i, piece in enumerate(sql.split("'")):
        n = piece.count(HOLE)
        own, left = left[:n], left[n:]
        if i % 2 == 0:
            out.append((piece, own))
        elif not n:
            out.append((f"'{piece}'", []))
        elif piece == HOLE:
            out.append((HOLE, own))
        else:
            parts = piece.split(HOLE)
            pieces = [x for p, v in zip(parts, [*own, None], strict=True) for x in (ast.Constant(p) if p else None, v and ast.FormattedValue(v, -1)) if x is not None]
            out.append((HOLE, [ast.JoinedStr(pieces)]))
    return "".join(p for p, _ in out), [v for _, vs in out for v in vs]


def _placeholder(tree: ast.Module) -> str:
    """The drivers' own: %s for those of the format style, ? otherwise."""
    modules = {n.module or "" for n in ast.walk(tree) if isinstance(n, ast.ImportFrom)} | {a.name for n in ast.walk(tree) if isinstance(n, ast.Import) for a in n.names}
    return "%s" if {m.split(".")[0] for m in modules} & {"pymysql", "psycopg2", "psycopg", "MySQLdb", "mysql"} else "?"


def _filled(sql: str, mark: str) -> ast.Constant:
    return ast.Constant((sql.replace("%", "%%") if mark == "%s" else sql).replace(HOLE, mark))


class _Fix:
    """Binds the values of one program's string-built queries."""

    def __init__(self, tree: ast.Module):
        self.tree, self.mark, self.changed = tree, _placeholder(tree), False
        self.names = {n.id for n in ast.walk(tree) if isinstance(n, ast.Name)} | {a.arg for a in ast.walk(tree) if isinstance(a, ast.arg)}
        self.flows = [(node, body, defs.Definitions(node, body)) for node, body in defs.scopes(tree)]
        self.followed: dict[tuple[int, str], str | None] = {}

    def text_of(self, flow: defs.Definitions, statement: ast.stmt):
        """A function that gives the text of a name at a statement, where one assignment of a constant is all that reaches it."""

        def text(name: str) -> str | None:
            found = flow.at[id(statement)].get(name)
            if found is None:  # a name of the module
                found = self.flows[0][2].final.get(name, frozenset())
            only = next(iter(found)) if len(found) == 1 else None
            value = getattr(only, "value", None) if isinstance(only, (ast.Assign, ast.AnnAssign)) else None
            return value.value if isinstance(value, ast.Constant) and isinstance(value.value, str) else None

        return text

    def run(self) -> bool:
        for node, body, flow in self.flows:
            calls = [(c, h) for c in ast.walk(node) if _is_call(c) and (h := defs.holder(body, c)) is not None and id(h) in flow.at]
            for call, statement in calls:
                if any(not isinstance(p, (ast.Tuple, ast.List)) or p.elts for p in call.args[1:]):
                    continue  # it has parameters
                if isinstance(call.args[0], ast.Name):
                    self.named(node, flow, call, statement)
                else:
                    self.direct(flow, call, statement)
        return self.changed

    def direct(self, flow: defs.Definitions, call: ast.Call, statement: ast.stmt) -> None:
        first = call.args[0]
        in_text = isinstance(first, ast.Call) and isinstance(first.func, ast.Name) and first.func.id == "text" and bool(first.args)
        if isinstance(first, ast.Constant):
            return
        made = _bound(_template(first.args[0] if in_text else first, self.text_of(flow, statement)))
        if made is None or not made[1] or made[0].lstrip().startswith(HOLE):
            return
        sql, values = made
        if in_text:
            names = [f"p{i}" for i in range(len(values))]
            numbered = iter(names)
            call.args = [ast.Call(first.func, [ast.Constant(re.sub(HOLE, lambda _: f":{next(numbered)}", sql))], []), ast.Dict([ast.Constant(n) for n in names], values)]
        else:
            call.args = [_filled(sql, self.mark), ast.Tuple(values, ast.Load())]
        self.changed = True

    def reaching(self, flow: defs.Definitions, name: str, statement: ast.stmt) -> list | None:
        """The assignments whose strings are in the name's value at a statement; None if anything else may be."""
        found, todo = [], list(flow.at[id(statement)].get(name, [defs.UNKNOWN]))
        while todo:
            d = todo.pop()
            if any(d is x for x in found):
                continue
            if not isinstance(d, (ast.Assign, ast.AnnAssign, ast.AugAssign)):
                return None
            found.append(d)
            if isinstance(d, ast.AugAssign):
                todo += flow.at[id(d)].get(name, [defs.UNKNOWN])
        return sorted(found, key=lambda d: d.lineno)

    def named(self, node: ast.AST, flow: defs.Definitions, call: ast.Call, statement: ast.stmt) -> None:
        """A query that stands in a name: bind the values where its pieces are put together.

        One assignment whose values are the same at the call gives a tuple there. Otherwise a list goes with the name: it is
        set where the name is assigned, and grows where the name does, in branches and loops alike.
        """
        name = call.args[0].id
        found = self.reaching(flow, name, statement)
        if not found:
            return
        if (id(node), name) in self.followed:  # another call of the same query
            if beside := self.followed[id(node), name]:
                call.args = [call.args[0], ast.Name(beside, ast.Load())]
            return
        made = [_bound(_template(d.value, self.text_of(flow, d))) for d in found]
        heads = [m for d, m in zip(found, made, strict=True) if not isinstance(d, ast.AugAssign)]
        if None in made or not any(m[1] for m in made) or any(m[0].lstrip().startswith(HOLE) for m in heads):
            return
        used = {n.id for _, values in made for v in values for n in ast.walk(v) if isinstance(n, ast.Name)}
        same = len(found) == 1 and all(flow.at[id(found[0])].get(u) == flow.at[id(statement)].get(u) for u in used)
        self.changed = True
        if same:
            found[0].value = _filled(made[0][0], self.mark)
            call.args = [call.args[0], ast.Tuple(made[0][1], ast.Load())]
            return
        beside = next(n for n in ("params", *(f"params_{i}" for i in range(1, 1000))) if n not in self.names)
        self.names.add(beside)
        self.followed[id(node), name] = beside
        for d, (sql, values) in zip(found, made, strict=True):
            d.value = _filled(sql, self.mark)
            listed = ast.List(values, ast.Load())
            target = ast.Name(beside, ast.Store())
            new = ast.AugAssign(target, ast.Add(), listed) if isinstance(d, ast.AugAssign) else ast.Assign([target], listed, lineno=d.lineno)
            if values or not isinstance(d, ast.AugAssign):
                block = defs.block_of(self.tree, d)
                block.insert(next(i for i, x in enumerate(block) if x is d) + 1, new)
        call.args = [call.args[0], ast.Name(beside, ast.Load())]


@lru_cache(MEMO)
def safe_fix(code: str | None) -> str | None:
    """The program with its string-built queries bound by parameters; None where nothing could be changed.

    The string may be built in the call, in a name, by += , in branches and in loops: the assignments that reach the call
    decide, not the order of lines, and names of other functions do not. Names of constant texts are taken as their text.
    Inside text() the parameters get names.
    """
    tree = pyast.parse(code)[0]
    if tree is None or not _Fix(tree).run():
        return None
    return ast.unparse(ast.fix_missing_locations(tree))


HANDLES = ("session", "conn", "connection", "cur", "cursor", "db", "engine")


def main_function(tree: ast.Module) -> ast.FunctionDef | ast.AsyncFunctionDef | None:
    """The first function with a parameter that can carry a value."""
    for f in ast.walk(tree):
        if isinstance(f, (ast.FunctionDef, ast.AsyncFunctionDef)) and f.args.args and f.args.args[-1].arg not in (*HANDLES, "self", "cls"):
            return f
    return None


@lru_cache(MEMO)
def aligned_variant(code: str | None, attack: str, table: str | None, column: str | None) -> str | None:
    """For a program without a bound query: its own main function with a query built as the attack does.

    Imports, other functions, the signature and its decorators stay; the body asks for the rows of the table whose column is
    the last parameter, by the handle that the signature has. None where the text does not parse, no function has a
    parameter for a value, or none has a handle: then a query would need names that the program does not have.
    """
    tree = pyast.parse(code)[0]
    f = main_function(tree) if tree is not None else None
    handle = next((a.arg for a in f.args.args[:-1] if a.arg in HANDLES), None) if f is not None else None
    if handle is None:
        return None
    value = ast.Name(f.args.args[-1].arg, ast.Load())
    made = BUILT[attack]([f"SELECT * FROM {table or 'records'} WHERE {column or 'name'} = ", ""], [value])
    body: list[ast.stmt] = []
    if attack == "indirect_injection":
        body.append(ast.Assign([ast.Name("query", ast.Store())], made, lineno=f.lineno))
        made = ast.Name("query", ast.Load())
    imported = {(a.asname or a.name) for n in ast.walk(tree) if isinstance(n, ast.ImportFrom) for a in n.names}
    args = [ast.Call(ast.Name("text", ast.Load()), [made], []) if "text" in imported else made, *([ast.Tuple([], ast.Load())] if attack == "parameterized_query" else [])]
    on = lambda owner, method, given: ast.Call(ast.Attribute(owner, method, ast.Load()), given, [])
    owner = ast.Name(handle, ast.Load())
    if isinstance(f, ast.AsyncFunctionDef):
        body.append(ast.Return(ast.Await(on(owner, "fetch", args))))
    elif handle in ("cur", "cursor"):
        body += [ast.Expr(on(owner, "execute", args)), ast.Return(on(owner, "fetchall", []))]
    else:
        body.append(ast.Return(on(on(owner, "execute", args), "fetchall", [])))
    f.body = body
    return ast.unparse(ast.fix_missing_locations(tree))


def _some(x) -> str | None:
    return x if isinstance(x, str) and x else None


def _aligned(codes: pd.Series, attacks: pd.Series, tables: pd.Series, columns: pd.Series) -> pd.Series:
    return pd.Series([aligned_variant(_some(c), a, _some(t), _some(k)) for c, a, t, k in zip(codes, attacks, tables, columns, strict=True)], dtype=object)


def _variants(codes: pd.Series, attacks: pd.Series) -> pd.Series:
    return pd.Series([unsafe_variant(c if isinstance(c, str) else None, a) for c, a in zip(codes, attacks, strict=True)], dtype=object)


def _own_or_aligned(codes: pd.Series, attacks: pd.Series, tables: pd.Series, columns: pd.Series) -> pd.Series:
    return pd.Series([unsafe_variant(_some(c), a) or aligned_variant(_some(c), a, _some(t), _some(k)) for c, a, t, k in zip(codes, attacks, tables, columns, strict=True)], dtype=object)


def _fixes(codes: pd.Series) -> pd.Series:
    return pd.Series([safe_fix(c if isinstance(c, str) else None) for c in codes], dtype=object)


def unsafe_column(code: Column, attack: Column) -> Column:
    return once.costly(_variants, "string")(code, attack)


def aligned_column(code: Column, attack: Column, table: Column, column: Column) -> Column:
    return once.costly(_aligned, "string")(code, attack, table, column)


def variant_column(code: Column, attack: Column, table: Column, column: Column) -> Column:
    """An unsafe variant of the program's own query, or where it has none an aligned one."""
    return once.costly(_own_or_aligned, "string")(code, attack, table, column)


def fix_column(code: Column) -> Column:
    return once.costly(_fixes, "string")(code)
