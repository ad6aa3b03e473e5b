"""The expression language: a whitelist over Python expressions, read into a small typed tree.

Nothing of an expression is ever evaluated as Python: its syntax tree is walked, and anything outside the whitelist is an
error when it is read, not when it runs. Equal subexpressions become one node.
"""

from __future__ import annotations

import ast
import hashlib
import re
from dataclasses import dataclass

# Fields, functions with their numbers of arguments, and patterns that no expression may hold.
FIELDS = ["open", "high", "low", "close", "volume", "amount"]
ARITY = {
    "delay": (2, 2), "delta": (1, 2), "ret": (1, 2), "ts_mean": (2, 2), "ts_sum": (2, 2), "ts_std": (2, 2), "ts_min": (2, 2),
    "ts_max": (2, 2), "ts_rank": (2, 2), "corr": (3, 3), "cov": (3, 3), "rank": (1, 1), "zscore": (1, 1), "winsorize": (1, 2),
    "abs": (1, 1), "sign": (1, 1), "log1p": (1, 1), "sqrt": (1, 1), "clip": (3, 3), "add": (2, 2), "sub": (2, 2), "mul": (2, 2),
    "div": (2, 2), "min": (2, 2), "max": (2, 2), "where": (3, 3),
}
FORBIDDEN = [
    r"\.shift\s*\(\s*-\d", r"\.lead\s*\(", r"\.future\s*\(", r"\.tail\s*\(", r"iloc\s*\[\s*-\d*\s*\]", r"__import__", r"exec\s*\(",
    r"eval\s*\(", r"compile\s*\(", r"subprocess", r"os\.system", r"open\s*\(", r"import\s+", r"getattr\s*\(", r"setattr\s*\(",
]
LAGS, ROLLING, PAIRED, WHOLE = {"delay", "delta", "ret"}, {"ts_mean", "ts_sum", "ts_std", "ts_min", "ts_max", "ts_rank"}, {"corr", "cov"}, {"rank", "zscore", "winsorize"}
BINARY = {ast.Add: "+", ast.Sub: "-", ast.Mult: "*", ast.Div: "/", ast.Pow: "**"}
ORDERS = {ast.Gt: ">", ast.Lt: "<", ast.GtE: ">=", ast.LtE: "<=", ast.Eq: "==", ast.NotEq: "!="}


class ExpressionError(ValueError):
    """An expression that cannot be read."""


class ForbiddenExpression(ExpressionError):
    """An expression with a forbidden pattern or name."""


@dataclass(frozen=True)
class Node:
    """kind: field, const, call, op, neg, cmp, bool. Window functions carry their window in n; winsorize its width."""

    kind: str
    name: str = ""
    args: tuple[Node, ...] = ()
    value: float | None = None
    n: int | None = None

    @property
    def is_window(self) -> bool:
        return self.kind == "call" and self.name in LAGS | ROLLING | PAIRED | WHOLE

    @property
    def is_bool(self) -> bool:
        return self.kind in ("cmp", "bool") or (self.kind == "call" and self.name == "where" and self.args[1].is_bool and self.args[2].is_bool)

    @property
    def depth(self) -> int:
        return max((a.depth for a in self.args), default=0) + self.is_window

    def walk(self):
        for a in self.args:
            yield from a.walk()
        yield self


def parse(text: str) -> Node:
    """The tree of an expression; ExpressionError says what is wrong with it."""
    if not text or not text.strip():
        raise ExpressionError("empty expression")
    for p in FORBIDDEN:
        if re.search(p, text):
            raise ForbiddenExpression(f"forbidden pattern: {p}")
    try:
        tree = ast.parse(text.strip(), mode="eval")
    except (SyntaxError, ValueError, RecursionError) as e:
        raise ExpressionError(f"syntax error: {e}") from e
    return _read(tree.body)


def validate(text: str) -> tuple[bool, str]:
    try:
        parse(text)
    except ExpressionError as e:
        return False, str(e)
    return True, ""


def expression_hash(text: str) -> str:
    """SHA-256 of the text in lower case without white space."""
    return hashlib.sha256(re.sub(r"\s+", "", text.lower()).encode()).hexdigest()


def complexity(text: str) -> int:
    """Characters ( + - * / in the text."""
    return sum(text.count(c) for c in "(+-*/")


def _read(e: ast.AST) -> Node:
    if isinstance(e, ast.Constant):
        if isinstance(e.value, bool) or not isinstance(e.value, int | float):
            raise ExpressionError(f"not a number: {e.value!r}")
        return Node("const", value=float(e.value), n=e.value if isinstance(e.value, int) else None)
    if isinstance(e, ast.Name):
        if e.id not in FIELDS:
            raise ForbiddenExpression(f"unknown field: {e.id}")
        return Node("field", e.id)
    if isinstance(e, ast.UnaryOp) and isinstance(e.op, ast.USub | ast.UAdd):
        inner = _read(e.operand)
        if isinstance(e.op, ast.UAdd):
            return inner
        if inner.kind == "const":
            return Node("const", value=-inner.value, n=None if inner.n is None else -inner.n)
        return Node("neg", args=(inner,))
    if isinstance(e, ast.BinOp):
        if type(e.op) not in BINARY:
            raise ExpressionError(f"operator {type(e.op).__name__} is not allowed")
        return Node("op", BINARY[type(e.op)], (_read(e.left), _read(e.right)))
    if isinstance(e, ast.Compare):
        # a chain a < b < c compares the truth of a < b with c
        out = _read(e.left)
        for o, right in zip(e.ops, e.comparators, strict=True):
            if type(o) not in ORDERS:
                raise ExpressionError(f"comparison {type(o).__name__} is not allowed")
            out = Node("cmp", ORDERS[type(o)], (out, _read(right)))
        return out
    if isinstance(e, ast.BoolOp):
        parts = [_read(v) for v in e.values]
        out = parts[0]
        for p in parts[1:]:
            out = Node("bool", "and" if isinstance(e.op, ast.And) else "or", (out, p))
        return out
    if isinstance(e, ast.Call):
        return _read_call(e)
    raise ExpressionError(f"{type(e).__name__} is not allowed")


def _read_call(e: ast.Call) -> Node:
    if not isinstance(e.func, ast.Name) or e.func.id not in ARITY:
        raise ForbiddenExpression(f"unknown function: {ast.unparse(e.func)}")
    name, (least, most) = e.func.id, ARITY[e.func.id]
    if e.keywords:
        raise ExpressionError(f"{name} takes no named arguments")
    if not least <= len(e.args) <= most:
        raise ExpressionError(f"{name} takes {least} to {most} arguments")
    args = [_read(a) for a in e.args]
    if name in LAGS | ROLLING | PAIRED:
        series = 2 if name in PAIRED else 1
        n = args[series].n if len(args) > series and args[series].kind == "const" else (1 if len(args) == series else None)
        if n is None:
            raise ExpressionError(f"the window of {name} must be a whole number")
        if n < (0 if name in LAGS else 1):
            raise ExpressionError(f"the window of {name} must not be {n}: it would look ahead")
        return Node("call", name, tuple(args[:series]), n=n)
    if name == "winsorize":
        if len(args) == 2 and args[1].kind != "const":
            raise ExpressionError("the width of winsorize must be a number")
        return Node("call", name, (args[0],), value=args[1].value if len(args) == 2 else 3.0)
    return Node("call", name, tuple(args))


def windows(node: Node) -> list[int]:
    return [x.n for x in node.walk() if x.is_window and x.n is not None]


def looks_at_whole_series(node: Node) -> bool:
    """Whether some part depends on a symbol's whole history, later rows included (with symbol scope)."""
    return any(x.kind == "call" and x.name in WHOLE for x in node.walk())
