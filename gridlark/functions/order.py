"""Positions, ranks, running totals and percentiles over a whole table, without sorting it in one task.

Rows are dealt out by ranges of the order, shuffled once and sorted there; totals of the ranges, a row each, then shift what was
counted within them. Rows are counted first, whatever the files' sizes say; up to ``ALONE`` of them are one range, so one window.
For more, a sample of the order's columns says where ranges end: two jobs, which read these columns alone.
The rest is lazy: the ends are a literal of the plan, which finds the same ranges whenever the table is read, so nothing of it is
written or cached, and only the columns that are asked for are shuffled.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from itertools import groupby
from operator import and_, itemgetter, or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridlark.functions.columns import quoted

#: Rows of a range on average, sampled rows of each, and ranges at most; rows up to which a window alone is quicker.
ROWS, SAMPLED, RANGES, ALONE = 1 << 17, 16, 1 << 13, 1 << 20
#: A column, or a column and whether it descends. Nulls are the smallest. Columns are no sort orders themselves.
Level = Column | tuple[Column, bool]
_EXACT = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}


def _not_before(groups: Sequence[str], down: Sequence[bool], end: Column) -> Column:
    """Whether a row's keys are at or behind those of ``end`` in the order. Structs compare field by field, nulls smallest."""
    *first, (last, d) = zip(groups, down, strict=True)
    out = end[last] >= F.col(last) if d else F.col(last) >= end[last]
    for g, d in reversed(first):
        out = (end[g] > F.col(g) if d else F.col(g) > end[g]) | ((F.col(g) == end[g]) & out)
    return out


class Ranges:
    """``df`` dealt out by ranges of an order. ``rows``: with the order's columns in ``keys`` and, if there are several ranges
    (``many``), the number of its range in ``_range``, which ascends in the order. ``by``: the sort over ``keys``."""

    def __init__(self, df: DataFrame, order: Sequence[Level], rows: int | None = None, counted: DataFrame | None = None) -> None:
        """More than ``rows`` rows are dealt out, in ranges of so many; by default more than ``ALONE``, in ranges of ``ROWS``.
        ``counted``: another table that has at least as many rows and is cheaper to count; then a range has ``rows`` of its."""
        columns, down = zip(*(x if isinstance(x, tuple) else (x, False) for x in order), strict=True)
        self.keys = [f"_by{i}" for i in range(len(columns))]
        self.by = [F.desc(k) if d else F.asc(k) for k, d in zip(self.keys, down, strict=True)]
        self.rows = df.withColumns(dict(zip(self.keys, columns, strict=True)))
        n = (df if counted is None else counted).count()
        parts = min(n // (rows or ROWS) + 1, RANGES) if n > (rows or ALONE) else 1
        self.many = parts > 1
        if not self.many:
            return
        # Keys one after another in the same direction are one struct: a step of the search compares once for each change of direction.
        runs = [list(run) for _, run in groupby(zip(self.keys, down, strict=True), key=itemgetter(1))]
        groups = {f"_bys{i}": F.struct(*[k for k, _ in run]) for i, run in enumerate(runs)}
        keyed = [g.alias(name) for name, g in groups.items()]
        drawn = df.filter(F.rand(len(self.keys)) < SAMPLED * parts / n).select(*[c.alias(k) for k, c in zip(self.keys, columns, strict=True)])
        drawn = drawn.withColumn("_nth", F.row_number().over(Window.orderBy(*self.by)))  # SAMPLED rows a range
        ends = F.array_sort(F.collect_list(F.struct("_nth", F.to_json(F.struct(*keyed), _EXACT).alias("end"))))
        ends = [e["end"] for e in drawn.filter(F.col("_nth") % SAMPLED == 0).agg(ends).first()[0]]
        kinds = dict(self.rows.select(*keyed).dtypes)
        kind = ", ".join(f"{name}: {t}" for name, t in kinds.items())
        # A binary search, a column for each step: of the ends that are left, all rows of a node are held against the middle one.
        # As columns the steps are compiled; a higher-order function would not be.
        dealt, at = self.rows.withColumns({name: g.cast(kinds[name]) for name, g in groups.items()}), F.lit(0)
        for step in reversed(range(len(ends).bit_length())):
            middles = F.from_json(F.lit(f"[{','.join(ends[(1 << step) - 1 :: 2 << step])}]"), f"array<struct<{kind}>>", _EXACT)
            behind = _not_before(list(groups), [run[0][1] for run in runs], F.get(middles, at))
            dealt, at = dealt.withColumn("_range", at * 2 + F.when(behind, 1).otherwise(0)), F.col("_range")
        # Exploded, so that joins by the range take it as it is: else Spark puts the steps into one another when it plans filters
        # for a join's keys, which doubles them again and again.
        self.rows = dealt.withColumn("_range", F.explode(F.array(at))).drop(*groups)

    def shifts(self, totals: DataFrame, value: str) -> DataFrame:
        """(_range, _shift): what ``totals`` (_range, ``value``) sums up to before each range."""
        return totals.select("_range", F.coalesce(F.sum(value).over(_before("_range")), F.lit(0)).alias("_shift"))

    def window(self) -> Window:
        return Window.partitionBy("_range").orderBy(*self.by)


def _before(*by: Column | str) -> Window:
    return Window.orderBy(*by).rowsBetween(Window.unboundedPreceding, -1)


def numbered(df: DataFrame, order: Sequence[Level], name: str = "pos", rows: int | None = None) -> DataFrame:
    """``df`` with each row's position in ``order``, from 1. The order should have no ties."""
    dealt = Ranges(df, order, rows)
    own = [quoted(c) for c in df.columns if c != name]
    if not dealt.many:
        return dealt.rows.select(*own, F.row_number().over(Window.orderBy(*dealt.by)).cast("long").alias(name))
    counts = dealt.rows.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    out = dealt.rows.withColumn("_at", F.row_number().over(dealt.window())).join(F.broadcast(dealt.shifts(counts, "_n")), "_range")  # a row per range
    return out.select(*own, (F.col("_at") + F.col("_shift")).cast("long").alias(name))


def running(df: DataFrame, order: Sequence[Level], value: Column, name: str, rows: int | None = ROWS, counted: DataFrame | None = None) -> DataFrame:
    """``df`` with the total of ``value`` over the rows before each row. ``counted``: see ``Ranges``."""
    dealt = Ranges(df.withColumn("_value", value), order, rows, counted)
    own = [quoted(c) for c in df.columns if c != name]
    if not dealt.many:
        return dealt.rows.select(*own, F.coalesce(F.sum("_value").over(_before(*dealt.by)), F.lit(0)).alias(name))
    sums = dealt.rows.groupBy("_range").agg(F.sum("_value").alias("_sum"))
    within = F.coalesce(F.sum("_value").over(dealt.window().rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    out = dealt.rows.withColumn("_within", within).join(F.broadcast(dealt.shifts(sums, "_sum")), "_range")  # a row per range
    return out.select(*own, (F.col("_within") + F.col("_shift")).alias(name))


def ranked(df: DataFrame, value: Column, name: str, base: DataFrame | None = None, of: Column | None = None, rows: int | None = None) -> DataFrame:
    """``df`` with the competition rank (1, 2, 2, 4) of ``value``, largest first; 0 for null. With ``base``, the rank among
    its values ``of``, and 0 for values that it doesn't have.

    Equal values are counted first, so that a common one is a row of the ranges. Ranks then come back by a join, whose skewed
    partitions Spark splits as it runs.
    """
    every = df if base is None else base
    counts = every.groupBy((value if of is None else of).alias("_of")).agg(F.count(F.lit(1)).alias("_count")).filter("_of is not null")
    ranks = running(counts, [(F.col("_of"), True)], F.col("_count"), "_larger", rows, every).select("_of", "_larger")
    out = df.withColumn("_ranked", value).join(ranks, F.col("_ranked") == F.col("_of"), "left")
    return out.select(*[quoted(c) for c in df.columns if c != name], F.coalesce(F.col("_larger") + 1, F.lit(0)).cast("double").alias(name))


def quantiles(df: DataFrame, value: Column, shares: Sequence[float], by: Sequence[Column] = (), rows: int | None = None) -> DataFrame:
    """(``_key0``.., q) for each group of ``by``, or for all rows: the values at ``shares``, from 0 to 1, of the way through the
    group, between neighbours in proportion; null where the group has no value.

    Equal values are counted. The counts are dealt out by ranges and added up; only ranges in which a share lies are looked into.
    """
    keys = [f"_key{i}" for i in range(len(by))]
    counts = df.select(*[b.alias(k) for b, k in zip(by, keys, strict=True)], value.alias("_v")).groupBy(*keys, "_v").agg(F.count("_v").alias("_n"))
    dealt = Ranges(counts, [F.col(c) for c in (*keys, "_v")], rows, df)
    places = [F.lit(float(p)) * (F.col("_all") - 1) for p in shares]
    ends = [f(r) for r in places for f in (F.floor, F.ceil)]
    inside = lambda first, n: [(first <= e) & (e < first + n) for e in ends]
    sum_before = lambda c, own, by: F.coalesce(F.sum(c).over(own.orderBy(by).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    own = Window.partitionBy(*keys)
    if dealt.many:
        totals = dealt.rows.groupBy(*keys, "_range").agg(F.sum("_n").alias("_c"))
        totals = totals.withColumn("_start", sum_before("_c", own, "_range")).withColumn("_all", F.sum("_c").over(own))
        wanted = totals.filter(reduce(or_, inside(F.col("_start"), F.col("_c")), F.col("_all") == 0)).drop("_c")
        wanted = wanted.withColumnsRenamed({k: f"_of{k}" for k in keys} | {"_range": "_of"})
        found = dealt.rows.join(wanted, reduce(and_, [F.col(k).eqNullSafe(F.col(f"_of{k}")) for k in keys], F.col("_range") == F.col("_of")))
        found = found.withColumn("_first", F.col("_start") + sum_before("_n", Window.partitionBy(*keys, "_range"), "_v"))
    else:
        found = counts.withColumn("_first", sum_before("_n", own, "_v")).withColumn("_all", F.sum("_n").over(own.orderBy("_v").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    values = [F.max(F.when(at, F.col("_v"))).alias(f"_e{i}") for i, at in enumerate(inside(F.col("_first"), F.col("_n")))]
    out = found.groupBy(*keys).agg(F.max("_all").alias("_all"), *values)
    between = lambda lo, hi, r: F.when(lo == hi, lo).otherwise(lo + (hi - lo) * (r - F.floor(r)))
    return out.select(*keys, F.array(*[between(F.col(f"_e{2 * i}"), F.col(f"_e{2 * i + 1}"), r) for i, r in enumerate(places)]).alias("q"))
