"""Multi-level sorts, positions, and going to a row."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridlark.functions.columns import kind, quoted, resolve, text
from gridlark.functions.numbers import full
from gridlark.functions.order import numbered
from gridlark.sources.shared import written


def parse(df: DataFrame, spec: str) -> list[tuple[str, bool]]:
    """``a asc, b desc`` as (column, descending); names may be in backticks, those with commas must; unknown ones are skipped."""
    levels = []
    for part in re.findall(r"(?:`[^`]*`|[^,`])+", spec):
        m = re.fullmatch(r"\s*`?(.+?)`?(?:\s+(asc|desc))?\s*", part, re.I)
        name = m and resolve(df, m[1])
        if name:
            levels.append((name, (m[2] or "").lower() == "desc"))
    return levels


def keys(df: DataFrame, name: str) -> list[Column]:
    """What a column is sorted by: numbers and dates as they are; in text, blank cells, then numbers, then text whatever its case."""
    if kind(df, name) != "text":
        return [quoted(name)]
    cell = text(df, name)
    value = full(cell)
    return [F.when(cell == "", 0).when(value.isNotNull(), 1).otherwise(2), value, F.when(value.isNull(), F.lower(cell))]


def order(df: DataFrame, spec: str, tie: str | None = None) -> list[Column]:
    """The sort's columns; ``tie``: the column with the physical order, which decides between equals."""
    out = [k.desc() if down else k.asc() for name, down in parse(df, spec) for k in keys(df, name)]
    return out + ([quoted(tie).asc()] if tie else [])


def levels(df: DataFrame, spec: str, tie: str | None = None, back: bool = False) -> list[tuple[Column, bool]]:
    """The sort's columns, each with whether it descends; ``back``: from the end."""
    return [(k, down != back) for name, down in parse(df, spec) for k in keys(df, name)] + ([(quoted(tie), back)] if tie else [])


def keyed(df: DataFrame, spec: str, tie: str | None = None, back: bool = False) -> tuple[DataFrame, list[Column], list[str]]:
    """``df`` with the sort's keys as columns, so that they are made once a row; the sort over them, ``back``: from the end;
    their names."""
    by = levels(df, spec, tie, back)
    made = {f"_key{i}": k for i, (k, _) in enumerate(by)}
    return df.withColumns(made) if made else df, [F.col(k).desc() if down else F.col(k).asc() for k, (_, down) in zip(made, by, strict=True)], list(made)


def sort(df: DataFrame, spec: str, tie: str | None = None) -> DataFrame:
    rows, by, made = keyed(df, spec, tie)
    return rows.orderBy(*by).drop(*made) if by else df


def positions(df: DataFrame, spec: str, tie: str, name: str = "pos") -> DataFrame:
    """``df`` with each row's place in the sort, from 1."""
    return numbered(df, levels(df, spec, tie), name)


#: Places up to which a sort with a limit serves; beyond it, rows are numbered by ranges.
NEAR = 5_000


def page(df: DataFrame, spec: str, tie: str, start: int, size: int) -> DataFrame:
    """``size`` rows of the sorted view from place ``start`` (0: the first), in order. The rows before them pass no single task."""
    if start + size <= NEAR:
        return sort(df, spec, tie).offset(start).limit(size)
    found = positions(df, spec, tie, "_pos").filter(F.col("_pos").between(start + 1, start + size))
    return found.orderBy("_pos").drop("_pos")


def go_to(df: DataFrame, spec: str, tie: str, row: int) -> DataFrame:
    """The row at a place of the sorted view, counted from 1; beyond the last the last one."""
    if row > NEAR:
        found = positions(df, spec, tie, "_pos").filter(F.col("_pos") <= row)
        return found.orderBy(F.desc("_pos")).limit(1).drop("_pos")
    rows, by, made = keyed(sort(df, spec, tie).limit(max(1, row)), spec, tie, back=True)
    return rows.orderBy(*by).limit(1).drop(*made)


class OrderIndex:
    """A sorted view that is kept: its rows with their places, written once, places ascending within each file. Pages and rows
    are then found by the places' bounds in the files, so that little else is read."""

    def __init__(self, df: DataFrame, spec: str, tie: str) -> None:
        self.columns, self.tie = df.columns, tie
        self.place = "_place"
        while self.place in df.columns:
            self.place = "_" + self.place
        self.rows = written(positions(df, spec, tie, self.place), "order-index")

    def page(self, start: int, size: int) -> DataFrame:
        """``size`` rows from place ``start`` (0: the first), in order."""
        return self.rows.filter(F.col(self.place).between(start + 1, start + size)).orderBy(self.place).drop(self.place)

    def row(self, n: int) -> DataFrame:
        """The row at a place, counted from 1; beyond the last the last one."""
        found = self.rows.filter(F.col(self.place) == max(1, n))
        return (found if found.head(1) else self.rows.orderBy(F.desc(self.place)).limit(1)).drop(self.place)

    def place_of(self, key) -> DataFrame:
        """(place) of the row with a tie value."""
        return self.rows.filter(quoted(self.tie) == F.lit(key)).select(F.col(self.place).alias("place"))
