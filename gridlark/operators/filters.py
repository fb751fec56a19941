"""Filter expressions, legacy search filters, quick filters and search, as Catalyst predicates.

``total >= 100 AND status = open OR city = "New York"`` is read from left to right without precedence, a leading ``!`` negates
all of it, and parentheses have no meaning. Values that look like ``2024-03`` or ``2024-Q1`` compare by month and quarter on
date columns; these become ranges, which reach the scan.
"""

from __future__ import annotations

import datetime as dt
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridlark.functions.columns import kind, quoted, resolve, text
from gridlark.functions.numbers import number

OPS = ("==", "!=", ">=", "<=", "=", ">", "<")
_TERM = re.compile(r"\s*(?:`(?P<quoted>[^`]*)`|(?P<name>[^=!<>]+?))\s*(?P<op>==|!=|>=|<=|=|>|<)\s*(?P<value>\"[^\"]*\"|'[^']*'|.*?)\s*(?=(?:\bAND\b|\bOR\b)|$)")


@dataclass(frozen=True)
class Condition:
    column: str
    op: str
    value: str


@dataclass(frozen=True)
class Expression:
    conditions: tuple[Condition, ...]
    logic: tuple[str, ...]
    negated: bool = False


def parse(query: str) -> Expression:
    """The conditions of a filter and the words between them."""
    rest = query.strip()
    negated = rest.startswith("!")
    rest = _outside_quotes(rest[negated:], "()", "")
    conditions, logic = [], []
    while rest.strip():
        m = _TERM.match(rest)
        if not m:
            raise ValueError(f"not a condition: {rest.strip()}")
        value = m["value"]
        if len(value) > 1 and value[0] == value[-1] and value[0] in "\"'":
            value = value[1:-1]
        conditions.append(Condition(m["quoted"] if m["quoted"] is not None else m["name"].strip(), "=" if m["op"] == "==" else m["op"], value))
        rest = rest[m.end() :]
        if word := re.match(r"\s*(AND|OR)\b", rest):
            logic.append(word[1])
            rest = rest[word.end() :]
    if not conditions or len(logic) != len(conditions) - 1:
        raise ValueError(f"not a filter: {query}")
    return Expression(tuple(conditions), tuple(logic), negated)


def _outside_quotes(s: str, drop: str, put: str) -> str:
    out, inside = [], ""
    for c in s:
        if inside:
            inside = "" if c == inside else inside
        elif c in "\"'`":
            inside = c
        out.append(put if c in drop and not inside else c)
    return "".join(out)


def compare(a: Column, op: str, b: Column) -> Column:
    return {"=": a == b, "!=": a != b, ">": a > b, ">=": a >= b, "<": a < b, "<=": a <= b}[op]


def _within(c: Column, op: str, start: dt.date, end: dt.date) -> Column:
    """Comparison with a span of days [start, end)."""
    lo, hi = F.lit(start), F.lit(end)
    return {"=": (c >= lo) & (c < hi), "!=": (c < lo) | (c >= hi), ">": c >= hi, ">=": c >= lo, "<": c < lo, "<=": c < hi}[op]


def _month(year: int, month: int) -> dt.date:
    return dt.date(year + (month - 1) // 12, (month - 1) % 12 + 1, 1)


def span(value: str) -> tuple[dt.date, dt.date] | None:
    """The days that 2024-Q1, 2024-03 or 2024-03-15 stand for."""
    if m := re.fullmatch(r"(\d{4})-[Qq]([1-4])", value):
        return _month(int(m[1]), 3 * int(m[2]) - 2), _month(int(m[1]), 3 * int(m[2]) + 1)
    if m := re.fullmatch(r"(\d{4})-(0[1-9]|1[0-2])", value):
        return _month(int(m[1]), int(m[2])), _month(int(m[1]), int(m[2]) + 1)
    try:
        day = dt.date.fromisoformat(value)
    except ValueError:
        return None
    return day, day + dt.timedelta(days=1)


def as_number(value: str) -> float | None:
    return float(value.replace(",", ".")) if re.fullmatch(r"\s*[-+]?(\d+[.,]?\d*|[.,]\d+)([eE][-+]?\d+)?", value) else None


def condition(df: DataFrame, c: Condition) -> Column:
    """One comparison. An unknown column, or a cell that isn't a number where the value is one, is false for every operator.

    It may be null instead of false: AND and OR keep that apart from true, and a negation is of the whole filter."""
    name = resolve(df, c.column)
    if name is None:
        return F.lit(False)
    value = as_number(c.value)
    if value is not None:
        return compare(number(df, name), c.op, F.lit(value))
    days = span(c.value) if kind(df, name) == "date" else None
    if days:
        found = _within(quoted(name), c.op, *days)
        return found if c.op != "!=" else F.coalesce(found, F.lit(True))
    if dict(df.dtypes)[name] == "string" and c.value:  # as a scan takes it: a missing cell is empty, so less than any text
        found = compare(quoted(name), c.op, F.lit(c.value))
        return found | quoted(name).isNull() if c.op in ("!=", "<", "<=") else found
    return compare(text(df, name), c.op, F.lit(c.value))


def predicate(df: DataFrame, query: str | Expression) -> Column:
    """A filter as a Column: a left fold of its conditions."""
    e = parse(query) if isinstance(query, str) else query
    out = condition(df, e.conditions[0])
    for word, c in zip(e.logic, e.conditions[1:], strict=True):
        out = out & condition(df, c) if word == "AND" else out | condition(df, c)
    return ~F.coalesce(out, F.lit(False)) if e.negated else out


def contains(c: Column, needle: str) -> Column:
    return F.contains(F.lower(c), F.lit(needle.lower()))


def legacy(df: DataFrame, query: str) -> Column:
    """``R:text`` and ``C[column]:text``: a cell contains the text, whatever its case; in double quotes: is equal to it."""
    if m := re.match(r"C\[([^]]*)\]:(.*)", query):
        name, needle = resolve(df, m[1]), m[2]
        names = [name] if name else []
    else:
        names, needle = df.columns, query.removeprefix("R:")
    exact = len(needle) > 1 and needle[0] == needle[-1] == '"'
    out = F.lit(False)
    for n in names:
        out = out | (text(df, n) == needle[1:-1] if exact else contains(text(df, n), needle))
    return out


def is_expression(query: str) -> bool:
    return bool(re.search(r"[><=!(]|\bAND\b|\bOR\b|\bNOT\b", query)) and not re.match(r"(R|C\[[^]]*\]):", query)


def either(df: DataFrame, query: str) -> Column:
    """A filter of either syntax as a Column; an empty one is true."""
    if not query.strip():
        return F.lit(True)
    return predicate(df, query) if is_expression(query) else legacy(df, query)


def apply(df: DataFrame, query: str) -> DataFrame:
    """Rows that a filter of either syntax keeps; none match: none are left."""
    return df.filter(either(df, query)) if query.strip() else df


def quick(query: str, column: str, value: str, op: str = "=", logic: str | None = "AND") -> str:
    """The filter text with a cell's condition appended, or replaced by it (``logic`` None)."""
    term = f'`{column}` {op} "{value}"'
    return f"{query} {logic} {term}" if query.strip() and logic else term


def hits(df: DataFrame, needle: str, key: str) -> DataFrame:
    """(key, column, value) of every cell that contains the text, whatever its case."""
    cells = F.array(*[F.struct(F.lit(c).alias("column"), text(df, c).alias("value")) for c in df.columns])
    found = F.filter(cells, lambda x: contains(x["value"], needle))
    return df.select(quoted(key).alias("key"), F.explode(found).alias("hit")).select("key", "hit.column", "hit.value")


def matching(df: DataFrame, needle: str) -> DataFrame:
    """Rows with a hit."""
    return df.filter(legacy(df, f"R:{needle}"))
