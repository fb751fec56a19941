"""Formulas of computed columns, compiled to Columns.

``round(price * qty, 2)``, ``if(qty > 0, revenue / qty, 0)``, ``col_pct(total)``: comparison, sum, product and sign in rising
precedence, doubles throughout, undefined values spread. ``col_*`` are aggregates of a column over the view, ``col_*_all`` over
the whole table; all that a formula needs of either are taken in one pass, and another for each column with percentiles.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridlark.functions.columns import kind, quoted, resolve, text
from gridlark.functions.numbers import half_away, number, prefix
from gridlark.functions.order import quantiles, ranked

_TOKEN = re.compile(r"\s*(?:(?P<number>\d+\.?\d*(?:[eE][-+]?\d+)?|\.\d+)|`(?P<quoted>[^`]*)`|(?P<name>[^\W\d]\w*)|(?P<op>==|!=|<=|>=|[-+*/(),<>=]))")
ARITY = {"round": (1, 2), "abs": (1, 1), "floor": (1, 1), "ceil": (1, 1), "mod": (2, 2), "pow": (2, 2), "if": (3, 3), "empty": (1, 1)}
AGGREGATES = ("sum", "avg", "min", "max", "count", "median", "percentile", "stddev", "var", "rank", "pct")


@dataclass(frozen=True)
class Node:
    kind: str  # number, column, call, op, negative, aggregate
    value: object
    args: tuple = ()


def tokens(source: str) -> list[tuple[str, str]]:
    out, at, end = [], 0, len(source.rstrip())
    while at < end:
        m = _TOKEN.match(source, at)
        if not m:
            raise ValueError(f"unexpected character: {source[at:].strip()[:1]}")
        out.append((m.lastgroup, m[m.lastgroup]))
        at = m.end()
    return out


class Parser:
    def __init__(self, df: DataFrame, source: str) -> None:
        self.df, self.items, self.at = df, [*tokens(source), ("end", "")], 0

    def peek(self) -> str:
        kind_, value = self.items[self.at]
        return value if kind_ == "op" else ""

    def take(self, value: str | None = None) -> tuple[str, str]:
        item = self.items[self.at]
        if value is not None and item != ("op", value):
            raise ValueError(f"expected {value}, found {item[1] or 'the end'}")
        self.at += 1
        return item

    def parse(self) -> Node:
        out = self.comparison()
        if self.items[self.at][0] != "end":
            raise ValueError(f"unexpected: {self.items[self.at][1]}")
        return out

    def comparison(self) -> Node:
        left = self.chain(("+", "-"), lambda: self.chain(("*", "/"), self.unary))
        if self.peek() in ("=", "==", "!=", "<", "<=", ">", ">="):
            op = self.take()[1]
            left = Node("op", "=" if op == "==" else op, (left, self.chain(("+", "-"), lambda: self.chain(("*", "/"), self.unary))))
        return left

    def chain(self, ops: tuple, below) -> Node:
        left = below()
        while self.peek() in ops:
            op = self.take()[1]
            left = Node("op", op, (left, below()))
        return left

    def unary(self) -> Node:
        if self.peek() == "-":
            self.take()
            return Node("negative", None, (self.unary(),))
        return self.primary()

    def primary(self) -> Node:
        kind_, value = self.take()
        if kind_ == "number":
            return Node("number", float(value))
        if (kind_, value) == ("op", "("):
            inner = self.comparison()
            self.take(")")
            return inner
        if kind_ == "quoted" or kind_ == "name" and self.peek() != "(":
            return Node("column", self.column(value))
        if kind_ != "name":
            raise ValueError(f"unexpected: {value or 'the end'}")
        name = value.lower()
        self.take("(")
        if m := re.fullmatch(f"col_({'|'.join(AGGREGATES)})(_all)?", name):
            column, share = self.column(self.take()[1]), None
            if m[1] == "percentile":
                self.take(",")
                share = float(self.take()[1])
                if not 0 <= share <= 100:
                    raise ValueError("a percentile is from 0 to 100")
            self.take(")")
            return Node("aggregate", (m[1], column, share, bool(m[2])))
        if name not in ARITY:
            raise ValueError(f"unknown function: {value}")
        args = []
        while self.peek() != ")":
            if args:
                self.take(",")
            args.append(self.comparison())
        self.take(")")
        if not ARITY[name][0] <= len(args) <= ARITY[name][1]:
            raise ValueError(f"{name} takes {ARITY[name][0]} to {ARITY[name][1]} values")
        return Node("call", name, tuple(args))

    def column(self, name: str) -> str:
        found = resolve(self.df, name)
        if found is None:
            raise ValueError(f"unknown column: {name}")
        return found


def aggregates(node: Node) -> list[tuple]:
    own = [node.value] if node.kind == "aggregate" else []
    return list(dict.fromkeys(own + [x for a in node.args for x in aggregates(a)]))


def scalar(df: DataFrame, fn: str, column: str) -> Column:
    """One aggregate over all rows of ``df``, but for medians and percentiles; 0 where there is nothing to take it of."""
    x = number(df, column, prefix)
    made = {
        "sum": F.sum(x), "avg": F.avg(x), "min": F.min(x), "max": F.max(x), "count": F.count(x).cast("double"), "pct": F.sum(x),
        "stddev": F.stddev_pop(x), "var": F.var_pop(x),
    }[fn]
    return F.coalesce(made, F.lit(0.0))


def scalars(df: DataFrame, wanted: dict[tuple, str]) -> DataFrame:
    """One row of aggregates over all rows of ``df``. ``wanted``: (function, column, percentile, ..) -> name."""
    plain, shares = [], {}
    for key, name in wanted.items():
        if key[0] in ("median", "percentile"):
            shares.setdefault(key[1], {})[name] = (50 if key[0] == "median" else key[2] or 0) / 100
        else:
            plain.append(scalar(df, *key[:2]).alias(name))
    rows = [df.agg(*plain)] if plain else []
    for of, named in shares.items():
        q = quantiles(df, number(df, of, prefix), list(named.values()))
        rows.append(q.select(*[F.coalesce(F.col("q")[i], F.lit(0.0)).alias(name) for i, name in enumerate(named)]))
    return reduce(DataFrame.crossJoin, rows)  # of one row each


def column(df: DataFrame, node: Node, names: dict[tuple, str]) -> Column:
    """The node as a Column of doubles; null is undefined. ``names``: columns that hold the aggregates."""
    args = [column(df, a, names) for a in node.args]
    if node.kind == "number":
        return F.lit(node.value)
    if node.kind == "column":
        return number(df, node.value, prefix)
    if node.kind == "negative":
        return -args[0]
    if node.kind == "aggregate":
        fn, name, _, _ = node.value
        if fn == "pct":
            x = number(df, name, prefix)
            return F.coalesce(F.try_divide(x, F.nullif(F.col(names[node.value]), F.lit(0.0))) * 100, F.lit(0.0))
        return F.col(names[node.value])
    if node.kind == "op":
        a, b = args
        if node.value in "+-*":
            return a + b if node.value == "+" else a - b if node.value == "-" else a * b
        if node.value == "/":
            return F.try_divide(a, b)
        return {"=": a == b, "!=": a != b, "<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b}[node.value].cast("double")
    if node.value == "empty":
        only = node.args[0]
        if only.kind == "column":
            return (text(df, only.value) == "").cast("double")
        return args[0].isNull().cast("double")
    if node.value == "if":
        return F.when(args[0].isNull(), F.lit(None).cast("double")).when(args[0] != 0, args[1]).otherwise(args[2])
    return {
        "round": lambda: half_away(args[0], args[1] if len(args) > 1 else 0),
        "abs": lambda: F.abs(args[0]),
        "floor": lambda: F.floor(args[0]).cast("double"),
        "ceil": lambda: F.ceil(args[0]).cast("double"),
        "mod": lambda: args[0] % F.nullif(args[1], F.lit(0.0)),
        "pow": lambda: F.pow(args[0], args[1]),
    }[node.value]()


def compute(view: DataFrame, name: str, source: str, base: DataFrame | None = None) -> DataFrame:
    """``view`` with the formula's column; ``base``: the table that ``_all`` aggregates are of (by default the view)."""
    node = Parser(view, source).parse()
    out, names, base = view, {}, base if base is not None else view
    for everything in (False, True):
        of, wanted = (base if everything else view), [x for x in aggregates(node) if x[3] == everything]
        for x in wanted:
            names[x] = f"_agg{len(names)}"
        if once := {x: names[x] for x in wanted if x[0] != "rank"}:
            out = out.crossJoin(F.broadcast(scalars(of, once)))  # one row
        for x in wanted:
            if x[0] == "rank" and not everything:
                out = ranked(out, number(view, x[1], prefix), names[x])
            elif x[0] == "rank":
                out = ranked(out, number(view, x[1], prefix), names[x], base=base, of=number(base, x[1], prefix))
    kept = [quoted(c) for c in view.columns if c != name]
    return out.select(*kept, column(view, node, names).alias(name))


def compiled(df: DataFrame, source: str) -> Column:
    """A formula without aggregates as a Column."""
    node = Parser(df, source).parse()
    if aggregates(node):
        raise ValueError("aggregates need compute()")
    return column(df, node, {})


__all__ = ["compiled", "compute", "kind"]
