"""The filter-expression language, compiled to Columns.

``||`` < ``&&`` < ``!`` < comparison; ``== != < <= > >= =~ !~``; arithmetic ``+ - * / %`` and unary minus; parentheses;
numbers, quoted strings, ``null``, fields (``QUAL``, ``DP``, ``AF[0]``) and methods (``vc.isSNP()``,
``vc.getGenotype("S1").getAD()[1]``, ``NAME.contains("x")``; ``methods.py`` has those of sites, genotypes and alleles). Logic is two-valued: a comparison with a missing operand is the policy ``missing_fails``,
but ``x == null`` is true and ``x != null`` false when x is missing, ``!~`` is true and ``=~`` false. Each leaf is
made non-null before it is combined.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

_TOKEN = re.compile(r"\s*(?:(?P<num>\d+(?:\.\d+)?(?:[eE][-+]?\d+)?)|(?P<str>\"[^\"]*\"|'[^']*')|(?P<op>\|\||&&|==|!=|<=|>=|=~|!~|[<>!()+\-*/%,.\[\]])|(?P<name>[A-Za-z_][A-Za-z0-9_]*))")
_COMPARE = {"==", "!=", "<", "<=", ">", ">=", "=~", "!~"}


class ExpressionError(ValueError):
    """The text is no expression of the language."""


@dataclass
class Value:
    """A node: its column, kind ("num", "str", "bool", "null"), and when it is a literal, its text."""

    column: Column | None
    kind: str
    text: str | None = None
    members: Members | None = None


#: Methods of an object in an expression: name -> function of the arguments that gives (column, kind).
Members = dict[str, Callable[..., tuple[Column, str]]]
Resolver = Callable[[str, int | None], tuple[Column, str]]


class _Parser:
    def __init__(self, text: str, field: Resolver, methods: dict[str, Callable[..., Column]], missing_fails: bool):
        self.tokens, at = [], 0
        text = text.strip()
        while at < len(text):
            m = _TOKEN.match(text, at)
            if not m:
                raise ExpressionError(f"unexpected {text[at:at + 10]!r}")
            self.tokens.append((m.lastgroup, m.group(m.lastgroup)))
            at = m.end()
        self.at, self.field, self.methods, self.missing = 0, field, methods, F.lit(missing_fails)

    def peek(self) -> tuple[str | None, str]:
        return self.tokens[self.at] if self.at < len(self.tokens) else (None, "")

    def take(self, text: str | None = None) -> tuple[str, str]:
        kind, value = self.peek()
        if kind is None or text is not None and value != text:
            raise ExpressionError(f"expected {text or 'more'}, found {value or 'the end'}")
        self.at += 1
        return kind, value

    def whole(self) -> Column:
        out = self.truth(self.either())
        if self.peek()[0]:
            raise ExpressionError(f"unexpected {self.peek()[1]!r}")
        return out

    def truth(self, v: Value) -> Column:
        if v.kind == "bool":
            return v.column
        if v.kind == "null":
            return F.lit(False)
        if v.kind == "num":
            return F.coalesce(v.column != 0, self.missing)
        return F.coalesce(v.column == "true", self.missing)

    def either(self) -> Value:
        left = self.both()
        while self.peek()[1] == "||":
            self.take()
            left = Value(self.truth(left) | self.truth(self.both()), "bool")
        return left

    def both(self) -> Value:
        left = self.negated()
        while self.peek()[1] == "&&":
            self.take()
            left = Value(self.truth(left) & self.truth(self.negated()), "bool")
        return left

    def negated(self) -> Value:
        if self.peek() == ("op", "!"):
            self.take()
            return Value(~self.truth(self.negated()), "bool")
        return self.comparison()

    def comparison(self) -> Value:
        left = self.sum()
        if self.peek()[0] == "op" and self.peek()[1] in _COMPARE:
            op = self.take()[1]
            return Value(self.compare(op, left, self.sum()), "bool")
        return left

    def compare(self, op: str, a: Value, b: Value) -> Column:
        if "null" in (a.kind, b.kind):
            other = b if a.kind == "null" else a
            missing = F.lit(True) if other.kind == "null" else other.column.isNull()
            return missing if op == "==" else ~missing if op == "!=" else self.missing
        x, y = a.column, b.column
        if op in ("=~", "!~"):
            if b.text is None:
                raise ExpressionError("a pattern must be a quoted text")
            found = F.coalesce(x.cast("string").rlike(b.text), F.lit(False))
            return ~found if op == "!~" else found
        if a.kind != b.kind:
            x, y = (x.try_cast("double"), y) if b.kind == "num" else (x, y.try_cast("double")) if a.kind == "num" else (x.cast("string"), y.cast("string"))
        tests = {"==": x == y, "!=": x != y, "<": x < y, "<=": x <= y, ">": x > y, ">=": x >= y}
        return F.coalesce(tests[op], self.missing)

    def sum(self) -> Value:
        left = self.product()
        while self.peek()[1] in ("+", "-"):
            op = self.take()[1]
            right = self.product()
            x, y = self.number(left), self.number(right)
            left = Value(x + y if op == "+" else x - y, "num")
        return left

    def product(self) -> Value:
        left = self.unary()
        while self.peek()[1] in ("*", "/", "%"):
            op = self.take()[1]
            x, y = self.number(left), self.number(self.unary())
            left = Value(x * y if op == "*" else F.try_divide(x, y) if op == "/" else F.try_mod(x, y), "num")
        return left

    @staticmethod
    def number(v: Value) -> Column:
        if v.kind == "null":
            return F.lit(None).cast("double")
        return v.column.cast("double") if v.kind in ("num", "bool") else v.column.try_cast("double")

    def unary(self) -> Value:
        if self.peek() == ("op", "-"):
            self.take()
            return Value(-self.number(self.unary()), "num")
        return self.primary()

    def primary(self) -> Value:
        kind, text = self.take()
        if kind == "num":
            return Value(F.lit(float(text)), "num", text)
        if kind == "str":
            return Value(F.lit(text[1:-1]), "str", text[1:-1])
        if text == "(":
            inner = self.either()
            self.take(")")
            return inner
        if kind != "name":
            raise ExpressionError(f"unexpected {text!r}")
        if text == "null":
            return Value(None, "null")
        if text in ("true", "false"):
            return Value(F.lit(text == "true"), "bool")
        if text in ("vc", "g") and self.peek()[1] == ".":
            self.take(".")
            return self.chained(self.call(f"{text}.{self.take()[1]}", None))
        if self.peek()[1] == "(" and text in self.methods:
            return self.chained(self.call(text, None))
        index = None
        if self.peek()[1] == "[":
            self.take()
            index = int(self.take()[1])
            self.take("]")
        column, what = self.field(text, index)
        return self.chained(Value(column, what))

    def chained(self, value: Value) -> Value:
        while self.peek()[1] == ".":
            self.take()
            value = self.call(self.take()[1], value)
        if value.members is not None:
            raise ExpressionError("an object is no value: a method of it is needed")
        return value

    def call(self, name: str, on: Value | None) -> Value:
        self.take("(")
        args = []
        while self.peek()[1] != ")":
            kind, text = self.take()
            args.append(text[1:-1] if kind == "str" else float(text) if kind == "num" else text)
            if self.peek()[1] == ",":
                self.take()
        self.take(")")
        if self.peek()[1] == "[" and not args:  # getAD()[1]
            self.take()
            args.append(float(self.take()[1]))
            self.take("]")
        if on is not None and on.members is not None:
            if name not in on.members:
                raise ExpressionError(f"no such method: {name}")
            column, what = on.members[name](*args)
            return Value(F.coalesce(column, self.missing) if what == "bool" else column, what)
        if on is not None:
            tests = {"contains": lambda s: on.column.contains(s), "startsWith": lambda s: on.column.startswith(s), "endsWith": lambda s: on.column.endswith(s), "matches": lambda s: on.column.rlike(s)}
            if name not in tests:
                raise ExpressionError(f"no such method: {name}")
            return Value(F.coalesce(tests[name](*args), self.missing), "bool")
        if name not in self.methods:
            raise ExpressionError(f"no such method: {name}")
        made = self.methods[name](*args)
        column, what = made if isinstance(made, tuple) else (made, "bool")
        if what == "members":
            return Value(None, what, members=column)
        return Value(F.coalesce(column, self.missing) if what == "bool" else column, what)


def compile_expression(text: str, field: Resolver, methods: dict[str, Callable[..., Column]] | None = None, missing_fails: bool = False) -> Column:
    """The Boolean Column of an expression; it is never null."""
    return _Parser(text, field, methods or {}, missing_fails).whole()


def column_resolver(kinds: dict[str, str]) -> Resolver:
    """Fields that are plain columns (or arrays): name -> "num" or "str"."""

    def field(name: str, index: int | None) -> tuple[Column, str]:
        if name not in kinds:
            return F.lit(None).cast("string"), "str"
        c = F.col(name)
        c = F.get(c, F.lit(index)) if index is not None else c
        return (c.cast("double"), "num") if kinds[name] == "num" else (c.cast("string"), "str")

    return field
