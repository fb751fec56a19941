"""Correlations, outliers, and the data behind charts."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations_with_replacement

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridlark.functions.columns import kind, quoted, required, text
from gridlark.functions.dates import bucket
from gridlark.functions.numbers import number
from gridlark.functions.order import numbered, quantiles


def numeric_columns(df: DataFrame, hidden: Sequence[str] = ()) -> list[str]:
    return [c for c in df.columns if kind(df, c) == "number" and c not in hidden]


def correlations(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(a, b, r) of each ordered pair of columns, over rows that have both; 0 where there is no spread. One pass."""
    names = [required(df, c) for c in columns] if columns else numeric_columns(df)
    pairs = list(combinations_with_replacement(names, 2))
    row = df.agg(*[F.coalesce(F.corr(number(df, a), number(df, b)), F.lit(0.0)).alias(f"r{i}") for i, (a, b) in enumerate(pairs)])
    both = [F.struct(F.lit(x).alias("a"), F.lit(y).alias("b"), F.col(f"r{i}").alias("r")) for i, (a, b) in enumerate(pairs) for x, y in {(a, b), (b, a)}]
    return row.select(F.explode(F.array(*both)).alias("p")).select("p.a", "p.b", "p.r")


def scatter(df: DataFrame, x: str, y: str) -> DataFrame:
    """(x, y) of rows that have both."""
    return df.select(number(df, required(df, x)).alias("x"), number(df, required(df, y)).alias("y")).filter("x is not null and y is not null")


def scatter_r(df: DataFrame, x: str, y: str) -> DataFrame:
    """(n, r) of a scatter; r is null without spread."""
    return scatter(df, x, y).agg(F.count(F.lit(1)).alias("n"), F.corr("x", "y").alias("r"))


def viewport(points: DataFrame, x0: float, x1: float, y0: float, y1: float) -> DataFrame:
    return points.filter(F.col("x").between(x0, x1) & F.col("y").between(y0, y1))


def nearest(points: DataFrame, x0: float, tie: str = "y") -> DataFrame:
    """The point with the x next to ``x0``."""
    return points.orderBy(F.abs(F.col("x") - x0), tie).limit(1)


def outliers(df: DataFrame, key: str, sigmas: float = 3.0, hidden: Sequence[str] = ()) -> DataFrame:
    """(key, column, value, z) of numbers ``sigmas`` or more sample deviations from their column's mean."""
    names = [c for c in numeric_columns(df, hidden) if c != key]
    stats = df.agg(*[f(number(df, c)).alias(f"{p}{i}") for i, c in enumerate(names) for p, f in (("m", F.avg), ("s", F.stddev_samp))])
    z = [F.struct(F.lit(c).alias("column"), number(df, c).alias("value"), F.when(F.col(f"s{i}") > 0, (number(df, c) - F.col(f"m{i}")) / F.col(f"s{i}")).alias("z")) for i, c in enumerate(names)]
    cells = F.filter(F.array(*z), lambda v: F.abs(v["z"]) >= sigmas)
    rows = df.crossJoin(F.broadcast(stats)).select(quoted(key).alias("key"), F.explode(cells).alias("v"))  # one row
    return rows.select("key", "v.column", "v.value", "v.z")


def series(df: DataFrame, y: str, order: str, x: str | None = None) -> DataFrame:
    """(pos, x, y) in the order of a unique column; what isn't a number is 0. ``x``: a date column with the labels."""
    label = F.date_format(quoted(required(df, x)), "yyyy-MM-dd") if x else F.lit(None).cast("string")
    rows = df.select(quoted(required(df, order)).alias("_order"), label.alias("x"), F.coalesce(number(df, required(df, y)), F.lit(0.0)).alias("y"))
    return numbered(rows, [F.col("_order")], "pos").select("pos", "x", "y")


def monthly(df: DataFrame, date: str, y: str) -> DataFrame:
    """(month, y): sums by month."""
    return df.groupBy(bucket(quoted(required(df, date)), "month").alias("month")).agg(F.sum(number(df, required(df, y))).alias("y")).filter("month is not null")


def window(points: DataFrame, start: int, end: int) -> DataFrame:
    """A stretch of a series; statistics after it are of the stretch."""
    return points.filter(F.col("pos").between(start, end))


def anomalies(points: DataFrame, sigmas: float = 3.0) -> DataFrame:
    """Points further than ``sigmas`` deviations of the whole from its mean; the deviation counts as 1 where there is none."""
    stats = points.agg(F.avg("y").alias("m"), F.stddev_pop("y").alias("s"))
    s = F.when(F.col("s") > 0, F.col("s")).otherwise(1.0)
    return points.crossJoin(F.broadcast(stats)).filter(F.abs(F.col("y") - F.col("m")) / s > sigmas).drop("m", "s")  # one row


def extremes(points: DataFrame) -> DataFrame:
    """(pos_min, y_min, pos_max, y_max), the first of equals."""
    lo, hi = F.min(F.struct("y", "pos")), F.min(F.struct((-F.col("y")).alias("y"), "pos"))
    return points.agg(lo.alias("lo"), hi.alias("hi")).select(F.col("lo.pos").alias("pos_min"), F.col("lo.y").alias("y_min"), F.col("hi.pos").alias("pos_max"), (-F.col("hi.y")).alias("y_max"))


def downsampled(points: DataFrame, step: int) -> DataFrame:
    """Every step-th point, and the least and the largest."""
    rows = points.crossJoin(F.broadcast(extremes(points)))  # one row
    return rows.filter(((F.col("pos") - 1) % step == 0) | F.col("pos").isin(F.col("pos_min"), F.col("pos_max"))).select(points.columns)


def scaled(points: DataFrame, log: bool = False) -> DataFrame:
    """(pos, share): y against the largest, linear or by log10; 0 and less are 0 on the log scale."""
    top = points.agg(F.max("y").alias("hi"), F.min("y").alias("lo"))
    rows = points.crossJoin(F.broadcast(top))  # one row
    linear = F.try_divide(F.col("y") - F.col("lo"), F.nullif(F.col("hi") - F.col("lo"), F.lit(0.0)))
    logs = F.when(F.col("y") > 0, F.try_divide(F.log10("y"), F.nullif(F.log10("hi"), F.lit(0.0)))).otherwise(0.0)
    return rows.select("pos", F.coalesce(logs if log else linear, F.lit(0.0)).alias("share"))


def axis_scales(df: DataFrame, axes: dict[str, int]) -> DataFrame:
    """(axis, lo, hi) over the series of each axis. ``axes``: column -> axis number."""
    each = F.array(*[F.struct(F.lit(a).alias("axis"), number(df, required(df, c)).alias("y")) for c, a in axes.items()])
    return df.select(F.explode(each).alias("v")).groupBy(F.col("v.axis").alias("axis")).agg(F.min("v.y").alias("lo"), F.max("v.y").alias("hi"))


def five_numbers(df: DataFrame, column: str, by: str | None = None) -> DataFrame:
    """min, q1, median, q3, max; of each group of ``by`` if that is given."""
    keys = [quoted(required(df, by))] if by else []
    rows = quantiles(df, number(df, required(df, column)), [0.0, 0.25, 0.5, 0.75, 1.0], keys)
    named = [F.col("_key0").alias(required(df, by))] if by else []
    return rows.select(*named, *[F.col("q")[i].alias(n) for i, n in enumerate(("min", "q1", "median", "q3", "max"))])


def donut(df: DataFrame, column: str, k: int = 8) -> DataFrame:
    """(label, count): the k - 1 commonest values and the others together."""
    c = required(df, column)
    counts = df.select(text(df, c).alias("value")).filter(F.trim("value") != "").groupBy("value").agg(F.count(F.lit(1)).alias("count"))
    top = counts.orderBy(F.desc("count"), F.asc("value")).limit(k - 1).select("value", F.lit(True).alias("_top"))
    label = F.when(F.col("_top"), F.col("value")).otherwise("Other").alias("label")
    return counts.join(F.broadcast(top), "value", "left").groupBy(label).agg(F.sum("count").alias("count"))  # k rows


def ranked_groups(df: DataFrame, by: str, y: str) -> DataFrame:
    """(key, y, place): groups by their sum, largest first."""
    sums = df.groupBy(text(df, required(df, by)).alias("key")).agg(F.sum(number(df, required(df, y))).alias("y"))
    return numbered(sums, [(F.col("y"), True), F.col("key")], "place")
