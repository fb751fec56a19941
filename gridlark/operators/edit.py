"""Edits of columns, rows and cells. DataFrames don't change, so undo is keeping the one before; ``EditLog`` keeps edits as rows."""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridlark.functions.columns import clean_name, quoted, required
from gridlark.functions.numbers import shown
from gridlark.functions.order import numbered
from gridlark.operators import formulas


def add_column(df: DataFrame, name: str = "untitled", before: str | None = None, after: str | None = None) -> DataFrame:
    """A column of empty text, at the end or beside another."""
    at = df.columns.index(required(df, before)) if before else df.columns.index(required(df, after)) + 1 if after else len(df.columns)
    names = [quoted(c) for c in df.columns]
    return df.select(*names[:at], F.lit("").alias(clean_name(name)), *names[at:])


def delete_column(df: DataFrame, name: str) -> DataFrame:
    return df.drop(required(df, name))


def rename_column(df: DataFrame, name: str, to: str) -> DataFrame:
    return df.withColumnRenamed(required(df, name), clean_name(to))


def hide(df: DataFrame, *names: str) -> DataFrame:
    return df.drop(*[required(df, n) for n in names])


def fill_constant(df: DataFrame, column: str, value) -> DataFrame:
    """Every row, whatever the filter."""
    return df.withColumn(required(df, column), F.lit(value))


def fill_sequence(df: DataFrame, column: str, order: str, start: float = 1, step: float = 1) -> DataFrame:
    """start, start + step, ... in the order of a unique column; a step of 0 counts as 1."""
    rows = numbered(df, [quoted(required(df, order))], "_pos")
    return rows.withColumn(required(df, column) if column in df.columns else column, F.lit(float(start)) + (F.col("_pos") - 1) * float(step or 1)).drop("_pos")


def fill_formula(df: DataFrame, column: str, formula: str, view: Column | None = None, as_text: bool = False) -> DataFrame:
    """The formula's value in the rows of the view; the others keep what they have."""
    name = required(df, column)
    inside = df.filter(view) if view is not None else df
    out = formulas.compute(inside, "_new", formula, base=df).withColumn(name, F.coalesce(shown(F.col("_new")), F.lit("")) if as_text else F.col("_new")).select(*map(quoted, df.columns))
    return out if view is None else out.unionByName(df.filter(~F.coalesce(view, F.lit(False))))


def update_cell(df: DataFrame, key: str, value, column: str, to) -> DataFrame:
    name = required(df, column)
    return df.withColumn(name, F.when(quoted(required(df, key)).eqNullSafe(F.lit(value)), F.lit(to)).otherwise(quoted(name)))


def delete_row(df: DataFrame, key: str, value) -> DataFrame:
    return df.filter(~quoted(required(df, key)).eqNullSafe(F.lit(value)))


def delete_nth(df: DataFrame, n: int, order: str) -> DataFrame:
    """Without the n-th row of the order of a unique column."""
    return numbered(df, [quoted(required(df, order))], "_pos").filter(F.col("_pos") != n).drop("_pos")


def format_cells(df: DataFrame, formats: dict[str, Column]) -> DataFrame:
    """Columns as they are shown."""
    return df.withColumns({required(df, c): made for c, made in formats.items()})


@dataclass(frozen=True)
class EditLog:
    """Edits of a table's cells and rows, merged when it is read. ``key`` is a unique column of ``base``.

    Each edit is a row (version, key, column, value) of a log; without a column the key's row is deleted. Edits by hand are kept as
    such, those of many cells as tables. The last edit of a cell up to the current version counts, so undoing is going back a
    version, and a thousand edits make the same plan as one: one aggregate of the log, one join.
    """

    base: DataFrame
    key: str
    point: tuple = ()
    tables: tuple = ()
    version: int = 0

    def _next(self, **changes) -> EditLog:
        """A new version; what was undone is forgotten."""
        kept = replace(self, point=tuple(x for x in self.point if x[0] <= self.version), tables=tuple(x for x in self.tables if x[0] <= self.version))
        return replace(kept, version=self.version + 1, **{k: (*getattr(kept, k), v) for k, v in changes.items()})

    def set(self, key, column: str, value) -> EditLog:
        """A cell's new value; None empties it."""
        return self._next(point=(self.version + 1, str(key), required(self.base, column), None if value is None else str(value)))

    def delete(self, key) -> EditLog:
        return self._next(point=(self.version + 1, str(key), None, None))

    def set_all(self, cells: DataFrame, column: str) -> EditLog:
        """One edit of many cells: ``cells`` (key, value), a row for each key."""
        return self._next(tables=(self.version + 1, required(self.base, column), cells))

    def undo(self, times: int = 1) -> EditLog:
        return self.at(self.version - times)

    def redo(self, times: int = 1) -> EditLog:
        return self.at(self.version + times)

    def at(self, version: int) -> EditLog:
        """The table at a version, from 0, the base, to the last."""
        last = max([0, *(x[0] for x in (*self.point, *self.tables))])
        return replace(self, version=min(max(version, 0), last))

    def log(self) -> DataFrame:
        """(version, key, column, value) of all edits up to the current version, as text."""
        spark, schema = self.base.sparkSession, "version int, key string, column string, value string"
        points = spark.createDataFrame([x for x in self.point if x[0] <= self.version], schema)
        tables = [t.select(F.lit(v).alias("version"), F.col("key").cast("string"), F.lit(c).alias("column"), F.col("value").cast("string")) for v, c, t in self.tables if v <= self.version]
        return reduce(DataFrame.unionByName, tables, points)

    def df(self) -> DataFrame:
        """The table as it is at the current version. A value that its column can't hold is an error."""
        names, kinds = self.base.columns, dict(self.base.dtypes)
        touched = sorted({x[i] for x, i in [(x, 2) for x in self.point] + [(x, 1) for x in self.tables] if x[0] <= self.version and x[i] is not None})
        own = "_edit"
        while any(c.lower().startswith(own) for c in names):
            own = "_" + own
        last = {f"{own}{i}": F.max(F.when(F.col("column") == c, F.struct("version", "value"))) for i, c in enumerate(touched)}
        gone = F.max(F.when(F.col("column").isNull(), F.col("version"))).alias(f"{own}_gone")
        edits = self.log().groupBy(F.col("key").alias(f"{own}_key")).agg(*[x.alias(n) for n, x in last.items()], gone)
        rows = self.base.join(edits, quoted(self.key).cast("string") == F.col(f"{own}_key"), "left").filter(F.col(f"{own}_gone").isNull())
        at = {c: F.col(f"{own}{i}") for i, c in enumerate(touched)}
        return rows.select(*[F.when(at[c].isNotNull(), at[c]["value"].cast(kinds[c])).otherwise(quoted(c)).alias(c) if c in at else quoted(c) for c in names])

