"""Per-pixel formulas in C syntax as column expressions, by a parser of a closed grammar; text never reaches SQL."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, functions as F

from ..model import QueryError

_TOKEN = re.compile(r"\s*(?:(\d+\.?\d*(?:[eE][-+]?\d+)?[fF]?|\.\d+(?:[eE][-+]?\d+)?[fF]?)|([A-Za-z_]\w*)|(<<|>>|<=|>=|==|!=|&&|\|\||[-+*/()<>?:,!~&|^]))")
_BINARY = [["||"], ["&&"], ["|"], ["^"], ["&"], ["==", "!="], ["<", ">", "<=", ">="], ["<<", ">>"], ["+", "-"], ["*", "/"]]
_FUNCTIONS: dict[str, tuple[int, Callable[..., Column]]] = {
    "sin": (1, F.sin), "asin": (1, F.asin), "cos": (1, F.cos), "acos": (1, F.acos), "tan": (1, F.tan), "atan": (1, F.atan),
    "mod": (2, lambda a, b: a % b), "fmod": (2, lambda a, b: a % b), "remainder": (2, lambda a, b: a - b * F.rint(a / b)),
    "ceil": (1, lambda a: F.ceil(a).cast("double")), "floor": (1, lambda a: F.floor(a).cast("double")), "round": (1, lambda a: F.signum(a) * F.floor(F.abs(a) + 0.5)),
    "trunc": (1, lambda a: F.signum(a) * F.floor(F.abs(a))), "abs": (1, F.abs), "fabs": (1, F.abs), "fract": (1, lambda a: a - F.floor(a)),
    "pow": (2, F.pow), "sqrt": (1, F.sqrt), "exp": (1, F.exp), "exp2": (1, lambda a: F.pow(F.lit(2.0), a)), "exp10": (1, lambda a: F.pow(F.lit(10.0), a)),
    "log": (1, F.ln), "log2": (1, F.log2), "log10": (1, F.log10), "min": (2, F.least), "max": (2, F.greatest),
}
#: A column, and what it holds: i(nteger), d(ouble) or b(oolean).
Typed = tuple[Column, str]


class _Parser:
    def __init__(self, text: str, names: dict[str, Typed]) -> None:
        self.names, self.at, self.tokens = names, 0, []
        pos = 0
        while pos < len(text.rstrip()):
            m = _TOKEN.match(text, pos)
            if not m:
                raise QueryError(f"not allowed in a formula: {text[pos:pos + 10]!r}")
            self.tokens.append(("n", m[1]) if m[1] else ("w", m[2]) if m[2] else ("o", m[3]))
            pos = m.end()

    def peek(self) -> str:
        return self.tokens[self.at][1] if self.at < len(self.tokens) else ""

    def take(self, want: str | None = None) -> tuple[str, str]:
        if self.at >= len(self.tokens) or want and self.peek() != want:
            raise QueryError(f"{want or 'more'!r} expected at {self.peek()!r}")
        self.at += 1
        return self.tokens[self.at - 1]

    def whole(self) -> Typed:
        out = self.ternary()
        if self.at < len(self.tokens):
            raise QueryError(f"unexpected {self.peek()!r}")
        return out

    def ternary(self) -> Typed:
        test = self.binary(0)
        if self.peek() != "?":
            return test
        self.take()
        a = self.ternary()
        self.take(":")
        b = self.ternary()
        kind = "d" if "d" in (a[1], b[1]) else "i"
        return F.when(_bool(test), _num(a, kind)).otherwise(_num(b, kind)), kind

    def binary(self, level: int) -> Typed:
        if level == len(_BINARY):
            return self.unary()
        left = self.binary(level + 1)
        while self.peek() in _BINARY[level]:
            op = self.take()[1]
            left = _apply(op, left, self.binary(level + 1))
        return left

    def unary(self) -> Typed:
        op = self.peek()
        if op in ("-", "+", "!", "~"):
            self.take()
            c, k = self.unary()
            if op == "!":
                return ~_bool((c, k)), "b"
            if op == "~":
                return F.bitwise_not(_num((c, k), "i")), "i"
            return (-_num((c, k), k if k != "b" else "i") if op == "-" else c), k if k != "b" else "i"
        return self.atom()

    def atom(self) -> Typed:
        kind, t = self.take()
        if kind == "n":
            real = bool(re.search(r"[.eEfF]", t))
            return (F.lit(float(t.rstrip("fF"))), "d") if real else (F.lit(int(t)).cast("long"), "i")
        if t == "(":
            out = self.ternary()
            self.take(")")
            return out
        if kind == "w" and self.peek() == "(":
            if t not in _FUNCTIONS:
                raise QueryError(f"no function {t!r}")
            n, f = _FUNCTIONS[t]
            self.take("(")
            args = [_num(self.ternary(), "d")]
            while self.peek() == ",":
                self.take()
                args.append(_num(self.ternary(), "d"))
            self.take(")")
            if len(args) != n:
                raise QueryError(f"{t} takes {n} values")
            return f(*args).cast("double"), "d"
        if kind == "w" and t in self.names:
            return self.names[t]
        raise QueryError(f"unexpected {t!r}")


def _bool(t: Typed) -> Column:
    return t[0] if t[1] == "b" else t[0] != 0


def _num(t: Typed, kind: str) -> Column:
    c = F.when(t[0], 1).otherwise(0) if t[1] == "b" else t[0]
    return c.cast("double" if kind == "d" else "long")


def _apply(op: str, a: Typed, b: Typed) -> Typed:
    if op in ("&&", "||"):
        return (_bool(a) & _bool(b) if op == "&&" else _bool(a) | _bool(b)), "b"
    if op in ("|", "^", "&", "<<", ">>"):
        x, y = _num(a, "i"), _num(b, "i")
        if op in ("<<", ">>"):
            return (F.call_function("shiftleft" if op == "<<" else "shiftright", x, y.cast("int"))), "i"
        return {"|": x.bitwiseOR, "^": x.bitwiseXOR, "&": x.bitwiseAND}[op](y), "i"
    kind = "d" if "d" in (a[1], b[1]) else "i"
    x, y = _num(a, kind), _num(b, kind)
    if op in ("==", "!=", "<", ">", "<=", ">="):
        return {"==": x == y, "!=": x != y, "<": x < y, ">": x > y, "<=": x <= y, ">=": x >= y}[op], "b"
    if op == "/":
        return (F.try_divide(x, y), "d") if kind == "d" else (F.call_function("div", x, F.nullif(y, F.lit(0).cast("long"))), "i")
    return {"+": x + y, "-": x - y, "*": x * y}[op], kind


def compile(text: str, names: dict[str, Typed]) -> Typed:
    """A formula over named columns; division by zero gives no-data."""
    return _Parser(text, names).whole()
