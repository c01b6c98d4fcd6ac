"""Static taint analysis: a bounded interpreter over the syntax tree. Code under analysis is never compiled into the worker.

Sources are taint_input() and input(); sinks are execute() of a connection or a cursor of sqlite3, the only module that may
be imported. The answer is what a run of the code would show: the flows in order, their previews, and the error that ended
the run, if one did; flows before an error stay. So values are concrete: texts with a mark, numbers, containers, closures.
Taint passes through f-strings (with conversions and format specifications), through + on either side, and through % and
format() of a marked text; every other operation on a text gives a plain one. Builtins are a fixed list, without those that
reach files, classes or modules. SQL that is not tainted runs in an empty database in memory that cannot attach files.

Everything is bounded: steps, depth of calls, the size of a value and of all values made, and the work of the database.
What is beyond gives the error 'limit', what the interpreter does not know 'unsupported'.
"""

from __future__ import annotations

import ast
import operator
import re
import sqlite3
import warnings
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column

from sparkward.functions import once

STEPS, PREVIEW, DEPTH = 20_000, 200, 48
#: Characters or entries of one value, of all values made, and entries looked at by builtins in all; bits of a number.
VALUE, MADE, SEEN, BITS = 1 << 18, 1 << 22, 1 << 23, 1 << 13
RESULT = "is_vulnerable boolean, taint_flows_detected int, details array<struct<sink: string, sql_preview: string>>, error string"

# The builtins that code under analysis has.
_EXCEPTIONS = (Exception, ValueError, TypeError, RuntimeError, AttributeError, KeyError, IndexError, StopIteration)
_TYPES = (bool, dict, enumerate, filter, float, frozenset, int, list, map, range, reversed, set, slice, str, tuple, type, zip)
_FUNCTIONS = (abs, all, any, bin, chr, format, getattr, hasattr, hash, hex, isinstance, issubclass, iter, len, max, min, next, oct, ord, pow, print, repr, round, sorted, sum)
#: Methods of values that are run as they are; what they give is measured before or after.
_METHODS = {
    str: "capitalize casefold count encode endswith find format index isalnum isalpha isdigit isidentifier islower isnumeric isspace isupper join lower lstrip partition removeprefix removesuffix replace rfind rindex rpartition rsplit rstrip split splitlines startswith strip swapcase title upper zfill ljust rjust center",
    bytes: "decode hex startswith endswith", int: "bit_length", float: "is_integer",
    list: "append clear copy count extend index insert pop remove reverse sort", tuple: "count index",
    dict: "clear copy get items keys pop popitem setdefault update values", set: "add clear copy difference discard intersection isdisjoint issubset issuperset pop remove union update", frozenset: "difference intersection union issubset",
}
_METHODS = {t: frozenset(names.split()) for t, names in _METHODS.items()}
_BINARY = {
    ast.Add: operator.add, ast.Sub: operator.sub, ast.Mult: operator.mul, ast.Div: operator.truediv, ast.FloorDiv: operator.floordiv, ast.Mod: operator.mod, ast.Pow: operator.pow,
    ast.LShift: operator.lshift, ast.RShift: operator.rshift, ast.BitOr: operator.or_, ast.BitXor: operator.xor, ast.BitAnd: operator.and_,
}
_IN_PLACE = {ast.Add: operator.iadd, ast.BitOr: operator.ior, ast.BitAnd: operator.iand, ast.Sub: operator.isub, ast.BitXor: operator.ixor}
_COMPARE = {
    ast.Eq: operator.eq, ast.NotEq: operator.ne, ast.Lt: operator.lt, ast.LtE: operator.le, ast.Gt: operator.gt, ast.GtE: operator.ge, ast.Is: operator.is_, ast.IsNot: operator.is_not,
    ast.In: lambda a, b: a in b, ast.NotIn: lambda a, b: a not in b,
}
_UNARY = {ast.Not: operator.not_, ast.USub: operator.neg, ast.UAdd: operator.pos, ast.Invert: operator.invert}


class Beyond(BaseException):
    """Ends the analysis; not an error that the code could catch."""


class _Return(BaseException):
    def __init__(self, value):
        self.value = value


class _Break(BaseException):
    pass


class _Continue(BaseException):
    pass


class Marked(str):
    """A text that knows whether it is tainted."""

    tainted = False

    def __new__(cls, value: Any = "", tainted: bool = False) -> Marked:
        new = str.__new__(cls, value)
        new.tainted = bool(tainted)
        return new


def tainted(v: Any) -> bool:
    return isinstance(v, Marked) and v.tainted


class Scope:
    """Names of a function's call or of the module."""

    def __init__(self, outer: Scope | None = None, values: dict | None = None):
        self.values, self.outer, self.elsewhere = values if values is not None else {}, outer, {}

    def find(self, name: str) -> Scope | None:
        at: Scope | None = self
        while at is not None and name not in at.values:
            at = at.outer
        return at


class Closure:
    def __init__(self, node, scope: Scope, defaults: list, named: dict):
        self.node, self.scope, self.defaults, self.named, self.attributes = node, scope, defaults, named, {}
        self.name = getattr(node, "name", "<lambda>")
        self.yields = any(isinstance(x, (ast.Yield, ast.YieldFrom)) for s in (node.body if isinstance(node.body, list) else [node.body]) for x in _own(s))

    def __repr__(self) -> str:
        return f"<function {self.name}>"


class Method:
    def __init__(self, owner, name: str):
        self.owner, self.name = owner, name

    def __repr__(self) -> str:
        return f"<method {self.name}>"


class Database:
    """A connection or a cursor of the guarded database."""

    def __init__(self, kind: str, real):
        self.kind, self.real = kind, real


class Module:
    def __repr__(self) -> str:
        return "<module 'sqlite3'>"


class Opaque:
    """A value about which nothing is known."""


def _own(node: ast.AST) -> Iterator[ast.AST]:
    """The nodes below, without those of functions inside."""
    yield node
    if not isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef, ast.Lambda)):
        for child in ast.iter_child_nodes(node):
            yield from _own(child)


_SQLITE3 = Module()
_SOURCES = {"taint_input": lambda value: Marked(value, True), "input": lambda prompt="": Marked("__stdin__", True), "TaintedStr": Marked}


def _builtins() -> dict[str, Any]:
    return {f.__name__: f for f in (*_EXCEPTIONS, *_TYPES, *_FUNCTIONS)} | {"__import__": "import"}


def _connect() -> sqlite3.Connection:
    """An empty database in memory, without files and with little work and memory to spend."""
    real = sqlite3.connect(":memory:")
    real.setlimit(sqlite3.SQLITE_LIMIT_LENGTH, 1 << 13)
    real.setlimit(sqlite3.SQLITE_LIMIT_ATTACHED, 0)
    real.setlimit(sqlite3.SQLITE_LIMIT_SQL_LENGTH, 1 << 16)
    left = [50]

    def spend() -> int:
        left[0] -= 1
        return left[0] < 0

    real.set_progress_handler(spend, 1000)
    denied = {sqlite3.SQLITE_ATTACH, sqlite3.SQLITE_DETACH, sqlite3.SQLITE_PRAGMA}
    real.set_authorizer(lambda action, *_: sqlite3.SQLITE_DENY if action in denied else sqlite3.SQLITE_OK)
    return real


class Interpreter:
    def __init__(self) -> None:
        self.flows: list[tuple[str, str]] = []
        self.steps = self.depth = self.made = self.seen = 0
        self.builtins = _builtins()
        self.module = Scope(values=dict(_SOURCES) | {"sqlite3": _SQLITE3})
        self.open: list[sqlite3.Connection] = []
        self.caught: list[Exception] = []

    # bounds

    def tick(self) -> None:
        self.steps += 1
        if self.steps > STEPS:
            raise Beyond("limit")

    def weigh(self, *values) -> int:
        """Entries and characters of values, with what they hold, each time it is held."""
        n, todo = 0, list(values)
        while todo:
            v = todo.pop()
            n += 1
            if isinstance(v, (str, bytes)):
                n += len(v)
            elif isinstance(v, (list, tuple, set, frozenset)):
                todo += v
            elif isinstance(v, dict):
                todo += v
                todo += v.values()
            elif isinstance(v, range):
                n += len(v) if abs(v.stop - v.start) < 1 << 60 else VALUE
            if n + len(todo) > VALUE:
                raise Beyond("limit")
        self.seen += n
        if self.seen > SEEN:
            raise Beyond("limit")
        return n

    def keep(self, v):
        """v, after what it holds by itself has been added to what was made."""
        n = len(v) if isinstance(v, (str, bytes, list, tuple, set, frozenset, dict)) else v.bit_length() >> 3 if isinstance(v, int) else 1
        self.made += n + 8
        if n > VALUE or self.made > MADE or isinstance(v, int) and v.bit_length() > BITS:
            raise Beyond("limit")
        return v

    def room(self, v) -> None:
        """Count a change of a container."""
        self.keep(0)
        if len(v) > VALUE:
            raise Beyond("limit")

    def drained(self, v) -> list:
        """What an iterator gives, as a list."""
        out = []
        for x in self.items(v):
            self.made += self.weigh(x)
            out.append(x)
            self.room(out)
        return out

    def listed(self, v):
        return self.drained(v) if hasattr(v, "__next__") else v

    def wide(self, text: str, args) -> None:
        """Refuse formats that ask for very wide fields or look into values."""
        numbers = [a for a in args if isinstance(a, int) and abs(a) > 9999]
        if re.search(r"\d{5,}", text) or numbers and ("*" in text or re.search(r"\{[^{}]*\{", text)):
            raise Beyond("limit")
        if "__" in text and "{" in text:
            raise Beyond("unsupported")

    # statements

    def run(self, tree: ast.Module) -> None:
        self.block(tree.body, self.module)

    def block(self, body: list[ast.stmt], scope: Scope) -> None:
        for s in body:
            self.tick()
            step = getattr(self, f"do_{type(s).__name__}", None)
            if step is None:
                raise Beyond("unsupported")
            step(s, scope)

    def do_Pass(self, s, scope):
        pass

    do_Global = do_Nonlocal = do_Pass

    def do_Import(self, s, scope):
        for a in s.names:
            self.bind_name(a.asname or a.name.partition(".")[0], self.imported(a.name), scope)

    def do_ImportFrom(self, s, scope):
        module = self.imported(s.module or "")
        for a in s.names:
            try:
                self.bind_name(a.asname or a.name, self.attribute(module, a.name), scope)
            except AttributeError:
                raise ImportError(f"cannot import name {a.name!r} from 'sqlite3' (unknown location)") from None

    @staticmethod
    def imported(name: str) -> Module:
        if name != "sqlite3":
            raise ImportError(f"module {name!r} is not allowed in taint sandbox")
        return _SQLITE3

    def do_FunctionDef(self, s, scope):
        f = self.closure(s, scope)
        for d in reversed(s.decorator_list):
            f = self.invoke(self.value(d, scope), [f], {})
        self.bind_name(s.name, f, scope)

    do_AsyncFunctionDef = do_FunctionDef

    def closure(self, node, scope: Scope) -> Closure:
        named = {a.arg: self.value(d, scope) for a, d in zip(node.args.kwonlyargs, node.args.kw_defaults, strict=True) if d is not None}
        return Closure(node, scope, [self.value(d, scope) for d in node.args.defaults], named)

    def do_ClassDef(self, s, scope):
        raise NameError("__build_class__ not found")  # the list of builtins cannot make classes

    def do_Expr(self, s, scope):
        self.value(s.value, scope)

    def do_Assign(self, s, scope):
        v = self.value(s.value, scope)
        for t in s.targets:
            self.bind(t, v, scope)

    def do_AnnAssign(self, s, scope):
        if s.value is not None:
            self.bind(s.target, self.value(s.value, scope), scope)

    def do_AugAssign(self, s, scope):
        old = self.value(s.target, scope)
        new = self.listed(self.value(s.value, scope)) if isinstance(old, list) else self.value(s.value, scope)
        if isinstance(old, (list, set, dict)) and type(s.op) in _IN_PLACE:
            self.weigh(old, new)
            self.bind(s.target, self.keep(_IN_PLACE[type(s.op)](old, new)), scope)
        else:
            self.bind(s.target, self.binary(s.op, old, new), scope)

    def bind_name(self, name: str, v, scope: Scope) -> None:
        scope.elsewhere.get(name, scope).values[name] = v

    def bind(self, t, v, scope: Scope) -> None:
        if isinstance(t, ast.Name):
            self.bind_name(t.id, v, scope)
        elif isinstance(t, (ast.Tuple, ast.List)):
            self.unpack(t.elts, v, scope)
        elif isinstance(t, ast.Subscript):
            owner = self.value(t.value, scope)
            if not isinstance(owner, (list, dict, str, tuple, int)):
                raise Beyond("unsupported")
            key = self.value(t.slice, scope)
            self.weigh(key, v)
            operator.setitem(owner, key, v)
            self.room(owner)
        elif isinstance(t, ast.Attribute):
            owner = self.value(t.value, scope)
            if isinstance(owner, Marked) and t.attr == "tainted":
                owner.tainted = bool(v)
            elif isinstance(owner, Closure):
                owner.attributes[t.attr] = v
            elif isinstance(owner, (str, int, float, list, dict, tuple, set, type(None))):
                raise AttributeError(f"{type(owner).__name__!r} object has no attribute {t.attr!r}")
            else:
                raise Beyond("unsupported")
        elif isinstance(t, ast.Starred):
            self.bind(t.value, list(v), scope)
        else:
            raise Beyond("unsupported")

    def unpack(self, targets: list, v, scope: Scope) -> None:
        items = list(self.items(v))
        star = next((i for i, t in enumerate(targets) if isinstance(t, ast.Starred)), None)
        if star is None:
            if len(items) != len(targets):
                raise ValueError(f"not enough values to unpack (expected {len(targets)}, got {len(items)})" if len(items) < len(targets) else f"too many values to unpack (expected {len(targets)})")
        else:
            after = len(targets) - star - 1
            if len(items) < star + after:
                raise ValueError(f"not enough values to unpack (expected at least {star + after}, got {len(items)})")
            items = [*items[:star], items[star : len(items) - after], *items[len(items) - after :]]
        for t, x in zip(targets, items, strict=True):
            self.bind(t, x, scope)

    def do_Delete(self, s, scope):
        for t in s.targets:
            if isinstance(t, ast.Name):
                del (scope.find(t.id) or Scope(values={t.id: 0})).values[t.id]
            elif isinstance(t, ast.Subscript):
                operator.delitem(self.value(t.value, scope), self.value(t.slice, scope))
            else:
                raise Beyond("unsupported")

    def do_Return(self, s, scope):
        raise _Return(self.value(s.value, scope) if s.value else None)

    def do_Break(self, s, scope):
        raise _Break

    def do_Continue(self, s, scope):
        raise _Continue

    def truth(self, v) -> bool:
        if isinstance(v, Opaque):
            raise Beyond("unsupported")
        return bool(v)

    def do_If(self, s, scope):
        self.block(s.body if self.truth(self.value(s.test, scope)) else s.orelse, scope)

    def do_Assert(self, s, scope):
        if not self.truth(self.value(s.test, scope)):
            raise AssertionError(*([self.value(s.msg, scope)] if s.msg else []))

    def loop(self, turns: Iterator, s, scope: Scope) -> None:
        for _ in turns:
            self.tick()
            try:
                self.block(s.body, scope)
            except _Continue:
                pass
            except _Break:
                return
        self.block(s.orelse, scope)

    def do_For(self, s, scope):
        self.loop((self.bind(s.target, x, scope) for x in self.items(self.value(s.iter, scope))), s, scope)

    def do_While(self, s, scope):
        self.loop(iter(lambda: self.truth(self.value(s.test, scope)), False), s, scope)

    def do_With(self, s, scope):
        v = self.value(s.items[0].context_expr, scope)
        name = {"Connection": "_ConnWrapper", "Cursor": "_CursorWrapper"}[v.kind] if isinstance(v, Database) else type(v).__name__
        raise TypeError(f"{name!r} object does not support the context manager protocol")

    def do_Raise(self, s, scope):
        if s.exc is None:
            raise self.caught[-1] if self.caught else RuntimeError("No active exception to reraise")
        e = self.value(s.exc, scope)
        e = self.invoke(e, [], {}) if isinstance(e, type) else e
        if not isinstance(e, Exception):
            raise TypeError("exceptions must derive from BaseException")
        raise e

    def do_Try(self, s, scope):
        try:
            try:
                self.block(s.body, scope)
            except Exception as e:
                for h in s.handlers:
                    kinds = self.value(h.type, scope) if h.type else Exception
                    if not isinstance(e, kinds):
                        continue
                    if h.name:
                        self.bind_name(h.name, e, scope)
                    self.caught.append(e)
                    try:
                        self.block(h.body, scope)
                    finally:
                        self.caught.pop()
                        scope.values.pop(h.name, None)
                    break
                else:
                    raise
            else:
                self.block(s.orelse, scope)
        finally:
            self.block(s.finalbody, scope)

    def do_Match(self, s, scope):
        subject = self.value(s.subject, scope)
        for case in s.cases:
            if self.matches(case.pattern, subject, scope) and (case.guard is None or self.truth(self.value(case.guard, scope))):
                return self.block(case.body, scope)
        return None

    def matches(self, p, v, scope: Scope) -> bool:
        if isinstance(p, ast.MatchValue):
            return v == self.value(p.value, scope)
        if isinstance(p, ast.MatchSingleton):
            return v is p.value
        if isinstance(p, ast.MatchOr):
            return any(self.matches(q, v, scope) for q in p.patterns)
        if isinstance(p, ast.MatchAs):
            if p.pattern is not None and not self.matches(p.pattern, v, scope):
                return False
            if p.name:
                self.bind_name(p.name, v, scope)
            return True
        raise Beyond("unsupported")

    # expressions

    def value(self, e, scope: Scope):
        self.tick()
        at = getattr(self, f"of_{type(e).__name__}", None)
        if at is None:
            raise Beyond("unsupported")
        return at(e, scope)

    def of_Constant(self, e, scope):
        return self.keep(e.value) if isinstance(e.value, (str, bytes, int)) else e.value

    def of_Name(self, e, scope):
        at = scope.elsewhere.get(e.id, scope).find(e.id)
        if at is not None:
            return at.values[e.id]
        if e.id in self.builtins:
            return self.builtins[e.id]
        raise NameError(f"name {e.id!r} is not defined")

    def spread(self, elements: list, scope: Scope) -> list:
        out: list = []
        for x in elements:
            out += self.items(self.value(x.value, scope)) if isinstance(x, ast.Starred) else [self.value(x, scope)]
        return self.keep(out)

    def of_List(self, e, scope):
        return self.spread(e.elts, scope)

    def of_Tuple(self, e, scope):
        return tuple(self.spread(e.elts, scope))

    def of_Set(self, e, scope):
        return set(self.spread(e.elts, scope))

    def of_Dict(self, e, scope):
        out: dict = {}
        for k, v in zip(e.keys, e.values, strict=True):
            out |= self.value(v, scope) if k is None else {self.value(k, scope): self.value(v, scope)}
        return self.keep(out)

    def of_JoinedStr(self, e, scope):
        out: str = ""
        for i, p in enumerate(e.values):
            piece = Marked(p.value) if isinstance(p, ast.Constant) else self.formatted(p, scope)
            out = piece if i == 0 else self.binary(ast.Add(), out, piece)
        return out

    def formatted(self, p: ast.FormattedValue, scope: Scope) -> Marked:
        v = self.value(p.value, scope)
        spec = str(self.value(p.format_spec, scope)) if p.format_spec else ""
        self.weigh(v)
        self.wide(spec, ())
        shown = {ord("r"): repr, ord("s"): str, ord("a"): ascii}.get(p.conversion, lambda x: x)(v)
        return self.keep(Marked(format(shown, spec) if spec else str(shown), tainted(v)))

    def of_BinOp(self, e, scope):
        return self.binary(e.op, self.value(e.left, scope), self.value(e.right, scope))

    def binary(self, op, a, b):
        self.weigh(a, b)
        if isinstance(op, ast.Add) and isinstance(a, str) and isinstance(b, str) and (isinstance(a, Marked) or isinstance(b, Marked)):
            return self.keep(Marked(str.__add__(a, b), tainted(a) or tainted(b)))
        if isinstance(op, ast.Mod) and isinstance(a, (str, bytes)):
            held = b if isinstance(b, tuple) else tuple(b.values()) if isinstance(b, dict) else (b,)
            self.wide(a if isinstance(a, str) else a.decode("latin-1"), held)
            plain = operator.mod(str(a) if isinstance(a, str) else a, b)
            return self.keep(Marked(plain, tainted(a) or any(map(tainted, held))) if isinstance(a, Marked) else plain)
        if isinstance(op, ast.Mult):
            for x, n in ((a, b), (b, a)):
                if isinstance(x, (str, bytes, list, tuple)) and isinstance(n, int) and len(x) * max(0, n) > VALUE:
                    raise Beyond("limit")
        if isinstance(op, ast.Pow) and isinstance(a, int) and isinstance(b, int) and b * a.bit_length() > BITS or isinstance(op, ast.LShift) and isinstance(b, int) and b > BITS:
            raise Beyond("limit")
        if type(op) not in _BINARY or isinstance(a, Opaque) or isinstance(b, Opaque):
            raise Beyond("unsupported")
        return self.keep(_BINARY[type(op)](a, b))

    def of_UnaryOp(self, e, scope):
        v = self.value(e.operand, scope)
        return not self.truth(v) if isinstance(e.op, ast.Not) else _UNARY[type(e.op)](v)

    def of_BoolOp(self, e, scope):
        for x in e.values:
            v = self.value(x, scope)
            if self.truth(v) == isinstance(e.op, ast.Or):
                break
        return v

    def of_Compare(self, e, scope):
        left, told = self.value(e.left, scope), True
        for op, right in zip(e.ops, e.comparators, strict=True):
            right = self.value(right, scope)
            right = self.listed(right) if isinstance(op, (ast.In, ast.NotIn)) else right
            self.weigh(left, right)
            if isinstance(left, Opaque) or isinstance(right, Opaque):
                raise Beyond("unsupported")
            told, left = _COMPARE[type(op)](left, right), right
            if not told:
                break
        return told

    def of_IfExp(self, e, scope):
        return self.value(e.body if self.truth(self.value(e.test, scope)) else e.orelse, scope)

    def of_NamedExpr(self, e, scope):
        v = self.value(e.value, scope)
        self.bind(e.target, v, scope)
        return v

    def of_Lambda(self, e, scope):
        return self.closure(e, scope)

    def of_Slice(self, e, scope):
        return slice(*(self.value(x, scope) if x else None for x in (e.lower, e.upper, e.step)))

    def of_Subscript(self, e, scope):
        owner, key = self.value(e.value, scope), self.value(e.slice, scope)
        if isinstance(owner, (Opaque, Database, Closure, Module)):
            raise Beyond("unsupported")
        self.weigh(key)
        got = owner[key]
        return self.keep(got) if isinstance(key, slice) else got

    def turns(self, generators: list, scope: Scope) -> Iterator[None]:
        if not generators:
            yield
            return
        g, *rest = generators
        for x in self.items(self.value(g.iter, scope)):
            self.bind(g.target, x, scope)
            if all(self.truth(self.value(c, scope)) for c in g.ifs):
                yield from self.turns(rest, scope)

    def of_GeneratorExp(self, e, scope):
        inner = Scope(scope)
        return (self.value(e.elt, inner) for _ in self.turns(e.generators, inner))

    def of_ListComp(self, e, scope):
        return self.keep(list(self.of_GeneratorExp(e, scope)))

    def of_SetComp(self, e, scope):
        return self.keep(set(self.of_GeneratorExp(e, scope)))

    def of_DictComp(self, e, scope):
        inner = Scope(scope)
        return self.keep({self.value(e.key, inner): self.value(e.value, inner) for _ in self.turns(e.generators, inner)})

    def of_Yield(self, e, scope):
        v = self.value(e.value, scope) if e.value else None
        scope.values["*"].append(v)
        return None

    def of_YieldFrom(self, e, scope):
        scope.values["*"] += self.items(self.value(e.value, scope))
        return None

    def items(self, v) -> Iterator:
        if isinstance(v, (Opaque, Closure, Method, Module)):
            raise TypeError(f"{type(v).__name__!r} object is not iterable")
        for x in v:
            self.tick()
            yield x

    def of_Attribute(self, e, scope):
        return self.attribute(self.value(e.value, scope), e.attr)

    def attribute(self, v, name: str):
        if isinstance(v, Module):
            if name == "connect":
                return Method(v, name)
            if name in ("Error", "OperationalError", "sqlite_version", "PARSE_DECLTYPES"):
                return getattr(sqlite3, name)
            raise AttributeError(f"module 'sqlite3' has no attribute {name!r}")
        if isinstance(v, Database):
            if name in ("cursor", "execute", "commit", "rollback", "close", "executemany", "fetchone", "fetchall", "fetchmany") and hasattr(v.real, name):
                return Method(v, name)
            got = getattr(v.real, name)
            return got if isinstance(got, (int, str, tuple, type(None))) else Opaque()
        if isinstance(v, Closure):
            if name in v.attributes:
                return v.attributes[name]
            if name == "__name__":
                return v.name
            raise AttributeError(f"'function' object has no attribute {name!r}")
        if isinstance(v, sqlite3.Cursor):
            return Method(v, name) if name in ("fetchone", "fetchall", "fetchmany", "close") else Opaque()
        if isinstance(v, Marked) and name == "tainted":
            return v.tainted
        if isinstance(v, Exception) and name == "args":
            return v.args
        for kind, names in _METHODS.items():
            if isinstance(v, kind) and name in names:
                return Method(v, name)
        if isinstance(v, type) and name == "__name__":
            return v.__name__
        if isinstance(v, (str, bytes, int, float, list, tuple, dict, set, frozenset, type(None))) and not name.startswith("_"):
            getattr(v, name)  # raises what it would raise
        raise Beyond("unsupported")

    def of_Call(self, e, scope):
        f = self.value(e.func, scope)
        args = self.spread(e.args, scope)
        named: dict = {}
        for k in e.keywords:
            named |= self.value(k.value, scope) if k.arg is None else {k.arg: self.value(k.value, scope)}
        return self.invoke(f, args, named)

    def invoke(self, f, args: list, named: dict):
        self.tick()
        if isinstance(f, Closure):
            return self.enter(f, args, named)
        if isinstance(f, Method):
            return self.method(f.owner, f.name, args, named)
        if f == "import":
            return self.imported(str(args[0]) if args else "")
        if f is Marked or f in _SOURCES.values():
            return self.keep(f(*args, **named))
        if isinstance(f, type) and issubclass(f, Exception) or f in _TYPES or f in _FUNCTIONS:
            return self.builtin(f, args, named)
        if isinstance(f, (Opaque, Database, Module)):
            raise Beyond("unsupported")
        raise TypeError(f"{type(f).__name__!r} object is not callable")

    def plain(self, v):
        """A value that a builtin can take: code's functions become callables."""
        return (lambda *a, **k: self.invoke(v, list(a), k)) if isinstance(v, (Closure, Method)) else v

    def builtin(self, f, args: list, named: dict):
        if f in (getattr, hasattr) and len(args) > 1:
            try:
                got = self.attribute(args[0], args[1])
            except AttributeError:
                if f is getattr and len(args) < 3:
                    raise
                got = args[2] if f is getattr else False
                return got
            return got if f is getattr else True
        if f is print:
            return None
        if f is type and len(args) != 1 or any(isinstance(a, Opaque) for a in args):
            raise Beyond("unsupported")
        if f in (pow, round, format, chr) and any(isinstance(a, int) and abs(a) > 1 << 24 for a in args):
            raise Beyond("limit")
        if f is pow and len(args) == 2:
            return self.binary(ast.Pow(), *args)
        if f is format and len(args) > 1:
            self.wide(str(args[1]), ())
        lazy = f in (enumerate, filter, map, zip)
        if f not in (len, range, reversed, iter, next):
            self.weigh(*(a for a in args if not (lazy and isinstance(a, range))), *named.values())
        if lazy:
            args = [self.items(a) if hasattr(a, "__iter__") and not isinstance(a, type) else a for a in args]
        elif f not in (next, iter, isinstance):
            args = [self.listed(a) for a in args]
        got = f(*map(self.plain, args), **{k: self.plain(v) for k, v in named.items()})
        return self.keep(got) if isinstance(got, (str, list, tuple, set, frozenset, dict, int)) else got

    def method(self, v, name: str, args: list, named: dict):
        self.weigh(v, *args, *named.values()) if not isinstance(v, (Database, Module, sqlite3.Cursor)) else self.weigh(*args)
        if isinstance(v, Module):
            if len(self.open) == 8:
                raise Beyond("limit")
            self.open.append(_connect())
            return Database("Connection", self.open[-1])
        if isinstance(v, Database):
            if name == "cursor":
                return Database("Cursor", v.real.cursor())
            if name == "execute":
                sql = (args + [named.get("sql")])[0]
                if tainted(sql):
                    self.flows.append((f"sqlite3.{v.kind}.execute", str(sql)[:PREVIEW]))
                    return None
                bound = (args[1:] + [named.get("parameters", ())])[0]
                return v.real.execute(str(sql), bound)
            return self.fetched(v.real, name, args) if name.startswith("fetch") else getattr(v.real, name)(*map(self.listed, args))
        if isinstance(v, sqlite3.Cursor):
            return self.fetched(v, name, args)
        if isinstance(v, str):
            if name == "format":
                self.wide(v, [*args, *named.values()])
                plain = str.format(v, *args, **named)
                return self.keep(Marked(plain, tainted(v) or any(map(tainted, [*args, *named.values()]))) if isinstance(v, Marked) else plain)
            if name == "replace" and len(args) > 1 and isinstance(args[0], str) and isinstance(args[1], str) and (v.count(args[0]) + 1) * len(args[1]) > VALUE:
                raise Beyond("limit")
            if name == "join" and args:
                args = [list(self.items(args[0])), *args[1:]]
                if sum(len(x) + len(v) for x in args[0] if isinstance(x, str)) > VALUE:
                    raise Beyond("limit")
            if name in ("zfill", "ljust", "rjust", "center") and any(isinstance(a, int) and a > VALUE for a in args):
                raise Beyond("limit")
        args = [self.listed(a) for a in args]
        got = getattr(v, name)(*map(self.plain, args), **{k: self.plain(x) for k, x in named.items()})
        if isinstance(v, (list, dict, set)):
            self.room(v)
        return self.keep(got) if isinstance(got, (str, bytes, list, tuple, set, dict)) and not isinstance(v, (list, dict)) else got

    def fetched(self, cursor: sqlite3.Cursor, name: str, args: list):
        """Rows are taken one by one, so that a large result is noticed."""
        if name == "close":
            return cursor.close()
        most = {"fetchone": 1, "fetchall": VALUE}.get(name, args[0] if args and isinstance(args[0], int) else 1)
        rows = self.drained(cursor if name == "fetchall" else iter(lambda left=iter(range(most)): cursor.fetchone() if next(left, None) is not None else None, None))
        return (rows[0] if rows else None) if name == "fetchone" else rows

    def enter(self, f: Closure, args: list, named: dict):
        a, name = f.node.args, f.name
        params = [p.arg for p in (*a.posonlyargs, *a.args)]
        if len(args) > len(params) and a.vararg is None:
            raise TypeError(f"{name}() takes {len(params)} positional argument{'s' * (len(params) != 1)} but {len(args)} {'were' if len(args) != 1 else 'was'} given")
        own = dict(zip(params, args, strict=False))
        if a.vararg:
            own[a.vararg.arg] = tuple(args[len(params) :])
        rest = {}
        for k, v in named.items():
            if k in own:
                raise TypeError(f"{name}() got multiple values for argument {k!r}")
            if k in params or k in {p.arg for p in a.kwonlyargs}:
                own[k] = v
            elif a.kwarg:
                rest[k] = v
            else:
                raise TypeError(f"{name}() got an unexpected keyword argument {k!r}")
        if a.kwarg:
            own[a.kwarg.arg] = rest
        own = dict(zip(params[len(params) - len(f.defaults) :], f.defaults, strict=True)) | f.named | own
        lost = [p for p in params if p not in own]
        if lost:
            told = repr(lost[0]) if len(lost) == 1 else ", ".join(map(repr, lost[:-1])) + "," * (len(lost) > 2) + f" and {lost[-1]!r}"
            raise TypeError(f"{name}() missing {len(lost)} required positional argument{'s' * (len(lost) > 1)}: {told}")
        if isinstance(f.node, ast.AsyncFunctionDef):
            return Opaque()
        scope = Scope(f.scope, own)
        if f.yields:
            return self.generated(f, scope)
        return self.called(f, scope)

    def called(self, f: Closure, scope: Scope):
        self.depth += 1
        if self.depth > DEPTH:
            raise Beyond("limit")
        try:
            if isinstance(f.node, ast.Lambda):
                return self.value(f.node.body, scope)
            for s in f.node.body:
                for x in _own(s):
                    if isinstance(x, (ast.Global, ast.Nonlocal)):
                        scope.elsewhere.update((n, self.module if isinstance(x, ast.Global) else scope.outer.find(n) or self.module) for n in x.names)
            self.block(f.node.body, scope)
        except _Return as r:
            return r.value
        finally:
            self.depth -= 1
        return None

    def generated(self, f: Closure, scope: Scope) -> Iterator:
        """What a generator yields; its body runs as a whole when the first value is asked for."""
        scope.values["*"] = []
        self.called(f, scope)
        yield from scope.values["*"]


def analyse(code: str | None) -> tuple[bool, int, list[dict], str | None]:
    """(is_vulnerable, flows, details, error). No text raises; null is a text without statements."""
    try:
        tree = ast.parse(code or "")
    except SyntaxError as e:
        return False, 0, [], f"transform_syntax_error: {e}"
    except (ValueError, RecursionError, MemoryError):
        return False, 0, [], "limit"
    machine, error = Interpreter(), None
    try:
        compile(tree, "<taint_sandbox>", "exec", dont_inherit=True)  # what only the compiler refuses; nothing runs
        machine.run(tree)
    except Beyond as e:
        error = str(e)
    except (RecursionError, MemoryError):
        error = "limit"
    except Exception as e:
        error = f"{type(e).__name__}: {e}"[: 2 * PREVIEW]
    except BaseException as e:  # a return, break or continue that the compiler let through
        if not isinstance(e, (_Return, _Break, _Continue)):
            raise
        error = "unsupported"
    finally:
        for real in machine.open:
            real.close()
    return bool(machine.flows), len(machine.flows), [{"sink": s, "sql_preview": p} for s, p in machine.flows], error


def _analysed(codes: pd.Series) -> pd.DataFrame:
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        return pd.DataFrame([analyse(c if isinstance(c, str) else None) for c in codes], columns=["is_vulnerable", "taint_flows_detected", "details", "error"])


def taint_column(code: Column) -> Column:
    return once.costly(_analysed, RESULT)(code)
