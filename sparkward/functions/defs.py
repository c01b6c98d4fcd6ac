"""Reaching definitions of local names: which statements may have given a name its value at a place of a program."""

from __future__ import annotations

import ast

Env = dict[str, frozenset]
#: A definition that is no assignment of an expression: a parameter, a loop's target, an import, a function.
UNKNOWN = "unknown"


def scopes(tree: ast.Module) -> list[tuple[ast.AST, list[ast.stmt]]]:
    """The module and every function in it, with their bodies."""
    return [(tree, tree.body)] + [(f, f.body) for f in ast.walk(tree) if isinstance(f, (ast.FunctionDef, ast.AsyncFunctionDef))]


def _merged(*envs: Env | None) -> Env | None:
    """What may hold after any of several ways; None is a way that does not come here."""
    there = [e for e in envs if e is not None]
    if not there:
        return None
    return {n: frozenset().union(*(e.get(n, frozenset()) for e in there)) for n in set().union(*there)}


class Definitions:
    """For each statement of a scope (not of scopes inside): the definitions that reach it, by name.

    Blocks are followed in order, branches are merged, and loops are followed until nothing more reaches them.
    """

    def __init__(self, node: ast.AST, body: list[ast.stmt]):
        self.at: dict[int, Env] = {}
        self.exits: list[tuple[list, list]] = []
        args = getattr(node, "args", None)
        params = [a.arg for a in ast.walk(args) if isinstance(a, ast.arg)] if args else []
        self.final = self.block(body, {p: frozenset([UNKNOWN]) for p in params}) or {}

    def block(self, body: list[ast.stmt], env: Env | None) -> Env | None:
        for s in body:
            if env is None:
                return None
            self.at[id(s)] = _merged(self.at.get(id(s)), env)
            env = self.step(s, env)
        return env

    @staticmethod
    def bound(env: Env, targets: list[ast.AST], by=UNKNOWN) -> Env:
        names = {n.id for t in targets for n in ast.walk(t) if isinstance(n, ast.Name) and isinstance(n.ctx, (ast.Store, ast.Del))}
        return env | {n: frozenset([by]) for n in names}

    def step(self, s: ast.stmt, env: Env) -> Env | None:
        if isinstance(s, ast.Assign):
            single = len(s.targets) == 1 and isinstance(s.targets[0], ast.Name)
            return self.bound(self.bound(env, [s.value]), s.targets, s if single else UNKNOWN)
        if isinstance(s, ast.AnnAssign):
            return self.bound(env, [s.target], s if isinstance(s.target, ast.Name) else UNKNOWN) if s.value else env
        if isinstance(s, ast.AugAssign):
            return self.bound(env, [s.target], s if isinstance(s.op, ast.Add) and isinstance(s.target, ast.Name) else UNKNOWN)
        if isinstance(s, ast.If):
            env = self.bound(env, [s.test])
            return _merged(self.block(s.body, env), self.block(s.orelse, env))
        if isinstance(s, (ast.For, ast.AsyncFor, ast.While)):
            return self.loop(s, env)
        if isinstance(s, (ast.With, ast.AsyncWith)):
            return self.block(s.body, self.bound(env, [i.optional_vars for i in s.items if i.optional_vars]))
        if isinstance(s, (ast.Try, ast.TryStar)):
            inside = self.block(s.body, env)
            # an error may come before or after any statement of the body
            broken = _merged(env, inside, *(self.bound(env, [x], x) for b in s.body for x in ast.walk(b) if isinstance(x, (ast.Assign, ast.AugAssign))))
            ends = [self.block(s.orelse, inside)] + [self.block(h.body, self.bound(broken, []) | ({h.name: frozenset([UNKNOWN])} if h.name else {})) for h in s.handlers]
            return self.block(s.finalbody, _merged(*ends)) if s.finalbody else _merged(*ends)
        if isinstance(s, ast.Match):
            return _merged(env, *(self.block(c.body, env | {n.name: frozenset([UNKNOWN]) for n in ast.walk(c.pattern) if isinstance(n, (ast.MatchAs, ast.MatchStar)) and n.name}) for c in s.cases))
        if isinstance(s, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
            return env | {s.name: frozenset([UNKNOWN])}
        if isinstance(s, (ast.Import, ast.ImportFrom)):
            return env | {(a.asname or a.name).split(".")[0]: frozenset([UNKNOWN]) for a in s.names}
        if isinstance(s, (ast.Return, ast.Raise)):
            return None
        if isinstance(s, (ast.Break, ast.Continue)):
            if self.exits:
                self.exits[-1][isinstance(s, ast.Continue)].append(env)
            return None
        return self.bound(env, [s])

    def loop(self, s, env: Env) -> Env | None:
        head = env if isinstance(s, ast.While) else self.bound(env, [s.target])
        while True:
            self.exits.append(([], []))
            start = head if isinstance(s, ast.While) else self.bound(head, [s.target])
            end = self.block(s.body, start)
            breaks, continues = self.exits.pop()
            again = _merged(head, end, *continues)
            if again == head:
                break
            head = again
        return _merged(self.block(s.orelse, head), *breaks)


def holder(body: list[ast.stmt], node: ast.AST) -> ast.stmt | None:
    """The innermost statement of a scope that holds the node; None if it stands in a scope inside."""
    for s in body:
        if isinstance(s, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
            continue
        if any(x is node for x in ast.walk(s)):
            for part in ("body", "orelse", "finalbody", "handlers", "cases"):
                for inner in getattr(s, part, None) or []:
                    found = holder(inner.body if isinstance(inner, (ast.ExceptHandler, ast.match_case)) else [inner], node)
                    if found is not None:
                        return found
            return s if not any(isinstance(x, (ast.Lambda, ast.FunctionDef)) and any(y is node for y in ast.walk(x)) for x in ast.walk(s)) else None
    return None


def block_of(tree: ast.AST, statement: ast.stmt) -> list[ast.stmt]:
    """The list that a statement stands in."""
    for n in ast.walk(tree):
        for part in ("body", "orelse", "finalbody"):
            block = getattr(n, part, None)
            if isinstance(block, list) and any(x is statement for x in block):
                return block
    raise ValueError("the statement is not in the tree")
