"""Names by scope: what is used without being bound anywhere it can see, and what is used before anything gave it a value.

And folding of repeated programs by their statements.
"""

from __future__ import annotations

import ast
import builtins
import hashlib
import symtable
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

from sparkward.functions import defs, once, pyast

NAMES = "scope string, name string, line int, problem string"
_BLOCKS = ("body", "orelse", "finalbody", "handlers", "cases")


def _loads(node: ast.AST, bound: frozenset = frozenset(), later: bool = False) -> Iterator[ast.Name]:
    """Names that an expression reads when it is evaluated, and with later also those that its lambdas read when called.

    What a comprehension or a lambda binds for itself is left out.
    """
    if isinstance(node, ast.Lambda):
        for d in (*node.args.defaults, *(x for x in node.args.kw_defaults if x)):
            yield from _loads(d, bound, later)
        if later:
            yield from _loads(node.body, bound | {a.arg for a in ast.walk(node.args) if isinstance(a, ast.arg)}, later)
    elif isinstance(node, (ast.ListComp, ast.SetComp, ast.DictComp, ast.GeneratorExp)):
        own = bound | {n.id for g in node.generators for n in ast.walk(g.target) if isinstance(n, ast.Name)}
        for i, child in enumerate([node.generators[0].iter, *(c for g in node.generators for c in (g.iter, *g.ifs)), *([node.key, node.value] if isinstance(node, ast.DictComp) else [node.elt])]):
            yield from _loads(child, own if i else bound, later)
    elif isinstance(node, ast.Name):
        if isinstance(node.ctx, ast.Load) and node.id not in bound:
            yield node
    else:
        for child in ast.iter_child_nodes(node):
            yield from _loads(child, bound, later)


def _reads(s: ast.stmt, later: bool = False) -> Iterator[ast.Name]:
    """Names that a statement itself reads, without the statements within it."""
    if isinstance(s, (ast.FunctionDef, ast.AsyncFunctionDef)):
        parts = [*s.decorator_list, *s.args.defaults, *(d for d in s.args.kw_defaults if d)]
    elif isinstance(s, ast.ClassDef):
        parts = [*s.decorator_list, *s.bases, *s.keywords]
    else:
        parts = [x for name, value in ast.iter_fields(s) if name not in _BLOCKS for x in (value if isinstance(value, list) else [value]) if isinstance(x, ast.AST)]
    if later:  # what is evaluated after the statement has begun
        parts += [h.type for h in getattr(s, "handlers", ()) if h.type] + [x for c in getattr(s, "cases", ()) for x in (c.guard, c.pattern) if x]
    for p in parts:
        yield from _loads(p, later=later)
    if isinstance(s, ast.AugAssign) and isinstance(s.target, ast.Name):
        yield s.target


def _tables(table: symtable.SymbolTable, owner: str = "") -> Iterator[tuple[str, symtable.SymbolTable]]:
    """Every scope with the path of functions and classes around it; comprehensions and lambdas belong to their owner."""
    own = table.get_name() if table.get_type() in ("function", "class") and table.get_name() not in ("lambda", "genexpr", "listcomp", "setcomp", "dictcomp") else ""
    path = f"{owner}.{own}".strip(".") if own else owner
    yield path, table
    for child in table.get_children():
        yield from _tables(child, path)


def _owners(node: ast.AST, path: str = "") -> Iterator[tuple[str, ast.AST]]:
    yield path, node
    todo = list(ast.iter_child_nodes(node))
    while todo:
        x = todo.pop()
        if isinstance(x, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
            yield from _owners(x, f"{path}.{x.name}".strip("."))
        else:
            todo += ast.iter_child_nodes(x)


def _inside(node: ast.AST) -> Iterator[ast.stmt]:
    """The statements of a scope, without those of functions and classes inside it."""
    for child in ast.iter_child_nodes(node):
        if isinstance(child, ast.stmt):
            yield child
        if not isinstance(child, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef, ast.expr)):
            yield from _inside(child)


def scoped_names(code: str | None) -> list[tuple[str, str, int, str]]:
    """(scope, name, line of the first use, problem) for names of a program, by scope, then line.

    undefined: the name is looked up in the module and the builtins, and nothing binds it there. before: the name is the
    scope's own, and no assignment, import or parameter can have come before the use. A name that only another function
    binds does not count, and neither does what a comprehension binds for itself.
    """
    tree = pyast.parse(code)[0] if code else None
    if tree is None:
        return []
    try:
        top = symtable.symtable(code, "<code>", "exec")
    except (SyntaxError, ValueError, RecursionError):
        return []
    tables = list(_tables(top))
    module = {s.get_name() for s in top.get_symbols() if s.is_assigned() or s.is_imported() or s.is_namespace()}
    module |= {s.get_name() for _, t in tables for s in t.get_symbols() if s.is_declared_global() and s.is_assigned()}
    star = any(isinstance(n, ast.ImportFrom) and any(a.name == "*" for a in n.names) for n in ast.walk(tree))
    nodes: dict[str, list[ast.AST]] = {}
    for path, node in _owners(tree):
        nodes.setdefault(path, []).append(node)
    out = set()
    for path, t in tables:
        for s in t.get_symbols():
            name = s.get_name()
            if not star and s.is_referenced() and s.is_global() and name not in module and not hasattr(builtins, name) and not (name.startswith("__") and name.endswith("__")):
                lines = [n.lineno for node in nodes.get(path, [tree]) for x in _inside(node) for n in _reads(x, later=True) if n.id == name]
                out.add((path, name, min(lines, default=0), "undefined"))
    local = {(path, s.get_name()) for path, t in tables if t.get_type() in ("function", "module") for s in t.get_symbols() if s.is_local() and not s.is_parameter()}
    for path, found in nodes.items():
        for node in found:
            if isinstance(node, ast.ClassDef):
                continue
            flow = defs.Definitions(node, node.body)
            first: dict[str, int] = {}
            for s in ast.walk(node):
                if isinstance(s, ast.stmt) and id(s) in flow.at:
                    for n in _reads(s):
                        if (path, n.id) in local and not flow.at[id(s)].get(n.id) and not _walrus(s, n.id):
                            first[n.id] = min(n.lineno, first.get(n.id, n.lineno))
            out |= {(path, name, line, "before") for name, line in first.items() if not (star and hasattr(builtins, name))}
    return sorted(out, key=lambda r: (r[0], r[2], r[1], r[3]))


def _walrus(s: ast.stmt, name: str) -> bool:
    return any(isinstance(x, ast.NamedExpr) and x.target.id == name for x in ast.walk(s))


@udtf(returnType=NAMES, useArrow=True)
class ScopedNames:
    def eval(self, code: str):
        yield from scoped_names(code)


def scoped_names_of(rows: DataFrame, code: str) -> DataFrame:
    """Each row with the scoped names of its code: a lateral join of each different text, so rows without any drop out."""
    return once.of_each(rows, [code], lambda kinds: kinds.lateralJoin(ScopedNames(F.col(code).outer())))


def z_function(s: list) -> list[int]:
    """For each place: how many items from there on are those that the list begins with."""
    n, z = len(s), [0] * len(s)
    left = right = 0
    for i in range(1, n):
        z[i] = min(right - i, z[i - left]) if i < right else 0
        while i + z[i] < n and s[z[i]] == s[i + z[i]]:
            z[i] += 1
        if i + z[i] > right:
            left, right = i, i + z[i]
    if n:
        z[0] = n
    return z


def _squeezed(text: str) -> str:
    """Text without comments, blank lines and the width of blanks, for comparing a part that does not parse."""
    return "\n".join(" ".join(x.split()) for line in text.splitlines() if (x := line.split("#", 1)[0]).strip())


def fold_copies(code: str | None) -> str | None:
    """A program that is a piece of itself several times over becomes the piece; null where the text does not parse.

    Copies are compared by their statements, so comments and layout may differ between them. The last copy may be cut off: at
    a statement, or within one, where the rest of the text begins as the statement that should follow does.
    """
    if code is None:
        return None
    ok, text, _ = pyast.parse_or_shorten(code)
    if not ok:
        return None
    body = pyast.parse(text)[0].body
    marks = [hashlib.sha256(ast.dump(s).encode()).digest() for s in body]
    z, n = z_function(marks), len(marks)
    lines, every = text.splitlines(), code.splitlines()
    for p in range(1, n // 2 + 1):
        whole = n - (z[p] == n - p - 1)  # statements that follow the piece; one that is cut off may still parse
        if z[p] < n - p - 1 or whole < 2 * p:
            continue
        cut = _squeezed("\n".join(every[len(lines) :] if whole == n else every[body[-1].lineno - 1 :]))
        if cut:
            following = body[whole % p]
            if not _squeezed("\n".join(lines[following.lineno - 1 : following.end_lineno])).startswith(cut):
                continue
        return "\n".join(lines[: body[p - 1].end_lineno])
    return code if len(lines) == len(every) else text


def _folded(codes: pd.Series) -> pd.Series:
    return pd.Series([fold_copies(c if isinstance(c, str) else None) for c in codes], dtype=object)


def fold_column(code: Column) -> Column:
    return once.costly(_folded, "string")(code)
