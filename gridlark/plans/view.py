"""A view: base table, filter, search, deduplication, sort, columns; and what of it is saved."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridlark.functions.columns import quoted, required
from gridlark.functions.order import numbered
from gridlark.operators import dedup, edit, filters, formulas, sorting
from gridlark.operators.pivot import PivotSpec, drill_down


@dataclass(frozen=True)
class ViewSpec:
    """What a view does, as JSON keeps it."""

    delimiter: str = ","
    header: bool = True
    types: dict = field(default_factory=dict)
    formats: dict = field(default_factory=dict)
    filter: str = ""
    search: str = ""
    sort: str = ""
    dedup: tuple = ()
    keep: str = ""
    hidden: tuple = ()
    saved_filters: tuple = ()
    bookmarks: dict = field(default_factory=dict)
    pivot: dict = field(default_factory=dict)

    def dumps(self) -> str:
        return json.dumps(asdict(self), indent=1, sort_keys=True)

    @classmethod
    def loads(cls, text: str) -> ViewSpec:
        found = json.loads(text)
        return cls(**{k: tuple(v) if isinstance(v, list) else v for k, v in found.items() if k in cls.__dataclass_fields__})

    def pivot_spec(self) -> PivotSpec:
        return PivotSpec(**self.pivot)


class View:
    """``base`` as a lazily composed view. ``tie`` is a unique column with the physical order. Views don't change: each
    method gives another, so undo is keeping the one before."""

    def __init__(self, base: DataFrame, tie: str, spec: ViewSpec | None = None) -> None:
        self.base, self.tie, self.spec = base, tie, spec or ViewSpec()

    def _with(self, **changes) -> View:
        return View(self.base, self.tie, replace(self.spec, **changes))

    def where(self, query: str) -> View:
        return self._with(filter=query)

    def quick(self, column: str, value: str, op: str = "=", logic: str | None = "AND") -> View:
        return self.where(filters.quick(self.spec.filter, column, value, op, logic))

    def search(self, needle: str) -> View:
        return self._with(search=needle)

    def order(self, spec: str) -> View:
        return self._with(sort=spec)

    def toggled(self, column: str) -> View:
        """The column as another sort level, or its direction turned."""
        levels = dict((n, d) for n, d in sorting.parse(self.base, self.spec.sort))
        levels[required(self.base, column)] = not levels.get(required(self.base, column), True)
        return self.order(", ".join(f"`{n}` {'desc' if d else 'asc'}" for n, d in levels.items()))

    def unique(self, *by: str, keep: str = "first") -> View:
        return self._with(dedup=tuple(by) or tuple(c for c in self.base.columns if c != self.tie), keep=keep)

    def hide(self, *names: str) -> View:
        return self._with(hidden=(*self.spec.hidden, *names))

    def bookmark(self, sign: str, row) -> View:
        return self._with(bookmarks=self.spec.bookmarks | {sign: row})

    def save_filter(self) -> View:
        return self._with(saved_filters=(*self.spec.saved_filters, self.spec.filter))

    def reset(self) -> View:
        return self._with(filter="", search="", sort="", dedup=(), keep="")

    def rows(self) -> DataFrame:
        """The view's rows, unsorted, with all columns."""
        df = filters.apply(self.base, self.spec.filter)
        if self.spec.search:
            df = filters.matching(df, self.spec.search)
        if self.spec.keep:
            df = dedup.dedup(df, self.spec.dedup, self.spec.keep, self.tie, self.spec.sort)
        return df

    def df(self) -> DataFrame:
        return sorting.sort(self.rows(), self.spec.sort, self.tie).drop(*[required(self.base, h) for h in self.spec.hidden])

    def positions(self) -> DataFrame:
        return sorting.positions(self.rows(), self.spec.sort, self.tie)

    def indexed(self) -> sorting.OrderIndex:
        """The view's order, kept: for many pages of it."""
        return sorting.OrderIndex(self.rows(), self.spec.sort, self.tie)

    def row(self, n: int) -> DataFrame:
        return sorting.go_to(self.rows(), self.spec.sort, self.tie, n)

    def bookmarked(self) -> DataFrame:
        """The base's rows with a bookmark, with its sign."""
        pairs = [F.struct(F.lit(k).alias("sign"), F.lit(v).alias("of")) for k, v in sorted(self.spec.bookmarks.items())]
        found = F.filter(F.array(*pairs), lambda p: p["of"] == quoted(self.tie))
        return self.base.withColumn("_m", found).filter(F.size("_m") > 0).withColumn("sign", F.explode("_m.sign")).drop("_m")

    def hits(self, needle: str) -> DataFrame:
        return filters.hits(self.rows(), needle, self.tie)

    def numbered_hits(self, needle: str) -> DataFrame:
        """Hits in order, with the key of the next one."""
        every = numbered(self.hits(needle), [F.col("key"), F.col("column")], "n")
        after = every.select((F.col("n") - 1).alias("n"), F.col("key").alias("next_key"))
        return every.join(after, "n", "left")

    def compute(self, name: str, formula: str) -> DataFrame:
        return formulas.compute(self.rows(), name, formula, self.base)

    def fill(self, column: str, formula: str) -> View:
        """The base with the formula's values in the view's rows: those that its filter, search and deduplication leave."""
        name, spec = required(self.base, column), self.spec
        if not spec.keep:
            inside = filters.either(self.base, spec.filter)
            if spec.search:
                inside = inside & filters.legacy(self.base, f"R:{spec.search}")
            return View(edit.fill_formula(self.base, name, formula, inside if spec.filter or spec.search else None), self.tie, spec)
        made = formulas.compute(self.rows(), "_new", formula, self.base).select(quoted(self.tie).alias("_of"), "_new")
        out = self.base.join(made, quoted(self.tie) == F.col("_of"), "left").withColumn(name, F.when(F.col("_of").isNull(), quoted(name)).otherwise(F.col("_new")))
        return View(out.select(*map(quoted, self.base.columns)), self.tie, spec)

    def drill(self, column: str, value: str) -> View:
        """The rows behind a value of the column's frequencies: its condition takes the filter's place."""
        return self.quick(column, value, logic=None)

    def drill_pivot(self, row_key: str, col_key: str | None = None) -> DataFrame:
        """The view's rows behind a cell of its pivot."""
        return drill_down(self.rows(), self.spec.pivot_spec(), row_key, col_key)
