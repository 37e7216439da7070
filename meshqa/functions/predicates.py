"""Rules written as predicate strings (==, !=, in, not in, and, or, not, &, |, .isnull(), .notnull()) as null-safe Spark
SQL. Nulls behave as missing values do in data frames: != and not in are true for them, == and in are false."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

_TOKEN = re.compile(r"""\s*(?:(==|!=|<=|>=|<|>|&|\||\(|\)|\[|\]|,|~)|('[^']*'|"[^"]*")|(-?\d+(?:\.\d+)?)|(`[^`]+`|[A-Za-z_]\w*(?:\.(?:isnull|isna|notnull|notna)\(\))?))""")


class RuleError(ValueError):
    """A rule that is not in the grammar."""


def _tokens(rule: str) -> list[tuple[str, str]]:
    out, at = [], 0
    rule = rule.rstrip()
    while at < len(rule):
        m = _TOKEN.match(rule, at)
        if not m:
            raise RuleError(f"can't read {rule[at:]!r} in {rule!r}")
        out.append(next((kind, g) for kind, g in zip(("op", "text", "number", "name"), m.groups()) if g is not None))
        at = m.end()
    return out


def to_sql(rule: str) -> str:
    """The rule as Spark SQL (and DuckDB SQL) that is never null."""
    tokens, at = _tokens(rule), 0

    def peek() -> str:
        return tokens[at][1] if at < len(tokens) else ""

    def take(*wanted: str) -> tuple[str, str]:
        nonlocal at
        if at >= len(tokens) or wanted and tokens[at][1] not in wanted:
            raise RuleError(f"expected {' or '.join(wanted) or 'more'} at {at} in {rule!r}")
        at += 1
        return tokens[at - 1]

    def either() -> str:
        out = both()
        while peek() in ("or", "|"):
            take()
            out = f"({out} OR {both()})"
        return out

    def both() -> str:
        out = one()
        while peek() in ("and", "&"):
            take()
            out = f"({out} AND {one()})"
        return out

    def literal() -> str:
        kind, value = take()
        if kind == "text":
            return "'" + value[1:-1].replace("'", "''") + "'"
        if kind == "number":
            return value
        if value in ("True", "False"):
            return value.lower()
        raise RuleError(f"{value!r} is no literal in {rule!r}")

    def one() -> str:
        if peek() in ("not", "~"):
            take()
            return f"(NOT {one()})"
        if peek() == "(":
            take()
            out = either()
            take(")")
            return out
        kind, name = take()
        if kind != "name":
            raise RuleError(f"{name!r} is no column in {rule!r}")
        if name.endswith("()"):
            column, test = name[:-2].split(".")
            return f"({column} IS {'NULL' if test in ('isnull', 'isna') else 'NOT NULL'})"
        op = take("==", "!=", "<", ">", "<=", ">=", "in", "not")[1]
        if op == "not":
            take("in")
        if op in ("in", "not"):
            take("[", "(")
            values = [literal()]
            while peek() == ",":
                take()
                values.append(literal())
            take("]", ")")
            inside = f"coalesce({name} IN ({', '.join(values)}), false)"
            return f"(NOT {inside})" if op == "not" else inside
        value = literal()
        if op == "==":
            return f"coalesce({name} = {value}, false)"
        if op == "!=":
            return f"(NOT coalesce({name} = {value}, false))"
        return f"coalesce({name} {op} {value}, false)"

    out = either()
    if at < len(tokens):
        raise RuleError(f"{peek()!r} is left over in {rule!r}")
    return out


def matches(rule: str) -> Column:
    return F.expr(to_sql(rule))


def any_of(rules: list[str]) -> Column:
    return F.expr(" OR ".join(f"({to_sql(r)})" for r in rules) or "false")
