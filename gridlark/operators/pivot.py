"""Two-dimensional pivots with totals, as a cube."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import asdict, dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridlark.functions.columns import kind, quoted, required, text
from gridlark.functions.dates import bucket, parsed
from gridlark.functions.numbers import cleaned
from gridlark.functions.order import numbered
from gridlark.sources.shared import written

TOTAL = "Total"
AGGREGATES = ("COUNT", "UNIQUE COUNT", "SUM", "AVG", "MIN", "MAX")
#: Column keys that ``wide`` makes columns of at most.
WIDEST = 10_000
#: Aggregates that a column which isn't of numbers may have.
FOR_TEXT = ("COUNT", "UNIQUE COUNT", "MIN", "MAX")


@dataclass
class PivotSpec:
    row: str | None = None
    column: str | None = None
    value: str | None = None
    aggregate: str = "COUNT"  # or several, joined by +
    date_group: str = "auto"
    row_totals: bool = True
    column_totals: bool = True
    row_sort: str = "KEY_ASC"
    column_sort: str = "KEY_ASC"
    extra: dict = field(default_factory=dict)

    def aggregates(self) -> list[str]:
        names = [x.strip().upper() for x in self.aggregate.split("+")]
        if not names or len(names) > 6 or any(x not in AGGREGATES for x in names):
            raise ValueError(f"unknown aggregate: {self.aggregate}")
        return names

    def to_dict(self) -> dict:
        return asdict(self)


def group_key(df: DataFrame, name: str | None, unit: str) -> Column:
    """A row's key: the cell, or its calendar bucket if it is a date. Without a column all rows are in one group."""
    if name is None:
        return F.lit(TOTAL)
    if kind(df, name) == "date":
        return bucket(quoted(name), unit)
    return text(df, name)


def text_date_key(df: DataFrame, name: str, unit: str) -> Column:
    """The same for a text column that holds dates; what can't be read stays as it is."""
    cell = text(df, name)
    return cell if unit == "auto" else bucket(parsed(cell), unit, cell)


def _numeric(df: DataFrame, name: str) -> Column:
    return quoted(name).cast("double") if kind(df, name) == "number" else cleaned(text(df, name))


def _aggregate(df: DataFrame, kind_: str, value: str | None, numeric: bool) -> Column:
    rows = F.count(F.lit(1))
    if kind_ == "COUNT":
        return rows
    if kind_ == "UNIQUE COUNT":
        return F.count_distinct(F.col("_text"))
    if kind_ == "SUM":
        return F.coalesce(F.sum("_number"), F.lit(0.0))
    if kind_ == "AVG":
        return F.coalesce(F.sum("_number"), F.lit(0.0)) / rows
    return (F.min if kind_ == "MIN" else F.max)("_number" if numeric else "_text")


def _key(df: DataFrame, name: str | None, spec: PivotSpec) -> Column:
    """What makes the keys of a side, in ``spec``'s way of reading dates."""
    if name is None:
        return F.lit(TOTAL)
    return (text_date_key if spec.extra.get("text_dates") and kind(df, name) == "text" else group_key)(df, name, spec.date_group)


def _keyed(df: DataFrame, spec: PivotSpec) -> tuple[DataFrame, bool]:
    row, column = (required(df, x) if x else None for x in (spec.row, spec.column))
    value = required(df, spec.value) if spec.value else None
    numeric = value is not None and kind(df, value) == "number" or spec.extra.get("money", False)
    if value is None and set(spec.aggregates()) != {"COUNT"}:
        raise ValueError("a value column is needed")
    if value is not None and not numeric and any(x not in FOR_TEXT for x in spec.aggregates()):
        raise ValueError(f"{spec.aggregate} needs numbers")
    own = [] if value is None else [text(df, value).alias("_text"), *([_numeric(df, value).alias("_number")] if numeric else [])]
    rows = df.select(_key(df, row, spec).alias("row_key"), _key(df, column, spec).alias("col_key"), *own)
    return rows.filter("row_key <> '' and col_key <> ''"), numeric


def names(spec: PivotSpec) -> list[str]:
    return [x.lower().replace(" ", "_") for x in spec.aggregates()]


def _parts(names: Sequence[str], number: str) -> dict[str, Column]:
    """What a cell keeps of its rows for the aggregates, but for unique counts; parts of cells add up to those of totals."""
    parts = {"_n": F.count(F.lit(1))}
    if {"SUM", "AVG"} & set(names):
        parts["_s"] = F.sum("_number")
    return parts | {f"_{k.lower()}": (F.min if k == "MIN" else F.max)(number) for k in ("MIN", "MAX") if k in names}


def _total(aggregate: str) -> Column:
    """An aggregate from the parts of cells."""
    n, s = F.sum("_n"), F.coalesce(F.sum("_s"), F.lit(0.0))
    return {"COUNT": lambda: n, "SUM": lambda: s, "AVG": lambda: s / n, "MIN": lambda: F.min("_min"), "MAX": lambda: F.max("_max")}[aggregate]()


def _cube(rows: DataFrame, *made: Column) -> DataFrame:
    return rows.cube("row_key", "col_key").agg(F.grouping("row_key").alias("_r"), F.grouping("col_key").alias("_c"), *made)


def long(df: DataFrame, spec: PivotSpec) -> DataFrame:
    """(row_key, col_key, is_row_total, is_col_total, aggregates): a row for each cell and each total. Rows without a key have no
    part in it. Totals of a side are left out if ``spec`` doesn't have them.

    Rows are aggregated to cells once, and the cube is of the cells; that of unique counts is of the cells' distinct values.
    """
    rows, numeric = _keyed(df, spec)
    of = dict(zip(names(spec), spec.aggregates(), strict=True))
    added = {n: k for n, k in of.items() if k != "UNIQUE COUNT"}
    own = rows.groupBy("row_key", "col_key").agg(*[x.alias(n) for n, x in _parts(list(added.values()), "_number" if numeric else "_text").items()])
    cube = _cube(own, *[_total(k).alias(n) for n, k in added.items()])
    if len(added) < len(of):
        unique = _cube(rows.select("row_key", "col_key", "_text").distinct(), F.count_distinct("_text").alias("unique_count"))
        same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in ("row_key", "col_key", "_r", "_c")]
        cube = cube.alias("a").join(unique.alias("b"), same).select("a.*", "b.unique_count")
    cube = cube.withColumn("is_row_total", F.col("_c") == 1).withColumn("is_col_total", F.col("_r") == 1)
    if not spec.row_totals:
        cube = cube.filter("not is_row_total")
    if not spec.column_totals:
        cube = cube.filter("not is_col_total")
    key = lambda k, g: F.when(F.col(g) == 1, TOTAL).otherwise(F.col(k)).alias(k)
    return cube.select(key("row_key", "_r"), key("col_key", "_c"), "is_row_total", "is_col_total", *names(spec))


def cells(df: DataFrame, spec: PivotSpec) -> DataFrame:
    """(row_key, col_key, aggregates) without totals: one partial and one final aggregate."""
    rows, numeric = _keyed(df, spec)
    return rows.groupBy("row_key", "col_key").agg(*[_aggregate(df, k, spec.value, numeric).alias(n) for k, n in zip(spec.aggregates(), names(spec), strict=True)])


def axis(df: DataFrame, spec: PivotSpec, side: str = "row") -> DataFrame:
    """(key, total, place): the keys of a side in its order, by key or by the total of the first aggregate."""
    return _axis(long(df, replace(spec, row_totals=True, column_totals=True)), spec, side)


def _axis(table: DataFrame, spec: PivotSpec, side: str) -> DataFrame:
    """The axis from a long table with all totals: a side's are its keys."""
    k, sort, total = ("row_key", spec.row_sort, "is_row_total and not is_col_total") if side == "row" else ("col_key", spec.column_sort, "is_col_total and not is_row_total")
    totals = table.filter(total).select(F.col(k).alias("key"), F.col(names(spec)[0]).alias("total"))
    by, down = sort.split("_")
    return numbered(totals, [(F.col("key" if by == "KEY" else "total"), down == "DESC"), F.col("key")], "place")


def wide(df: DataFrame, spec: PivotSpec, keys: Sequence[str] | None = None) -> DataFrame:
    """A row for each row key, a column for each column key and aggregate: <key>, or <key>_<AGG> with several.

    ``keys`` fixes the columns; without it the column keys are read first, and more than ``WIDEST`` of them are an error: the
    long form has no such bound. Cells that don't exist are 0 for COUNT, SUM and AVG and null for MIN and MAX. The row order
    is ``row_place``. ``df`` is read once: cells and totals are written, and the axes are the totals.
    """
    table = written(long(df, replace(spec, row_totals=True, column_totals=True)), "pivot")
    if keys is None:
        keys = [r["key"] for r in _axis(table, spec, "column").orderBy("place").limit(WIDEST + 1).collect()]
        if len(keys) > WIDEST:
            raise ValueError(f"more than {WIDEST} column keys: take long() or cells()")
    columns = [*keys, *([TOTAL] if spec.row_totals else [])]
    shown = table if spec.row_totals else table.filter("not is_row_total")
    shown = shown if spec.column_totals else shown.filter("not is_col_total")
    out = shown.groupBy("row_key", "is_col_total").pivot("col_key", columns).agg(*[F.first(n).alias(n) for n in names(spec)])
    single = len(names(spec)) == 1
    zero = {"count": F.lit(0), "sum": F.lit(0.0), "avg": F.lit(0.0), "unique_count": F.lit(0)}
    made = []
    for c in columns:
        for n, agg in zip(names(spec), spec.aggregates(), strict=True):
            cell = quoted(c if single else f"{c}_{n}")
            made.append((F.coalesce(cell, zero[n]) if n in zero else cell).alias(c if single else f"{c}_{agg.replace(' ', '_')}"))
    places = _axis(table, spec, "row").select(F.col("key").alias("row_key"), F.lit(False).alias("is_col_total"), "place")
    out = out.join(places, ["row_key", "is_col_total"], "left")
    return out.select("row_key", F.coalesce("place", F.lit(1 << 62)).alias("row_place"), *made)


def display(x: Column, aggregate: str, numeric: bool = True) -> Column:
    """An aggregate as it is shown: counts whole, numbers with two decimals, text as it is, and a dash for nothing."""
    if aggregate in ("COUNT", "UNIQUE COUNT"):
        made = x.cast("long").cast("string")
    else:
        made = F.format_string("%.2f", x.cast("double")) if numeric or aggregate in ("SUM", "AVG") else x.cast("string")
    return F.when(x.isNull() | (made == ""), F.lit("\u2014")).otherwise(made)


def exported(df: DataFrame, spec: PivotSpec, keys: Sequence[str] | None = None) -> DataFrame:
    """The wide pivot as text cells, as an export has them: ``Row``, a column for each key and aggregate, totals; ``row_place``
    (not exported) is the order."""
    numeric = bool(spec.value) and (kind(df, required(df, spec.value)) == "number" or spec.extra.get("money", False))
    table = wide(df, spec, keys)
    cells = [c for c in table.columns if c not in ("row_key", "row_place")]
    of = [spec.aggregates()[i % len(spec.aggregates())] for i in range(len(cells))]
    return table.select(F.col("row_key").alias("Row"), "row_place", *[display(quoted(c), a, numeric).alias(c) for c, a in zip(cells, of, strict=True)])


def export(df: DataFrame, spec: PivotSpec, path: str, keys: Sequence[str] | None = None) -> None:
    """The pivot in a file of its extension, in row order: a folder of parts that follow each other."""
    from gridlark.sources.writers import write

    write(exported(df, spec, keys).orderBy("row_place").drop("row_place"), path)


def drill_down(df: DataFrame, spec: PivotSpec, row_key: str, col_key: str | None = None) -> DataFrame:
    """The rows of a cell, by the expression that made its keys. The total's key is all rows of its side."""
    found = df
    for name, key in ((spec.row, row_key), (spec.column, col_key)):
        if name and key not in (None, TOTAL):
            found = found.filter(_key(df, required(df, name), spec) == key)
    return found


def series(df: DataFrame, spec: PivotSpec) -> DataFrame:
    """(series, x, y): a line for each column key over the row keys, of the first aggregate."""
    return cells(df, spec).select(F.col("col_key").alias("series"), F.col("row_key").alias("x"), F.col(names(spec)[0]).cast("double").alias("y"))
