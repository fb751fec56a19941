"""Column statistics: counts, frequencies, histograms, percentiles, blocks and date distributions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridlark.functions.columns import quoted, required, text
from gridlark.functions.dates import bucket
from gridlark.functions.numbers import number
from gridlark.functions.order import numbered, quantiles

BINS, BLOCKS = 30, 20


def summary(df: DataFrame, column: str) -> DataFrame:
    """One row: total, valid, empty, valid_pct, n_unique, sum, mean, min, max, median. The mean is over all cells that
    aren't empty, whether numbers or not."""
    c = required(df, column)
    x, valid = number(df, c), F.trim(text(df, c)) != ""
    total, filled = F.count(F.lit(1)), F.count_if(valid)
    row = df.agg(
        total.alias("total"), filled.alias("valid"), (total - filled).alias("empty"), F.try_divide(filled * 100.0, total).alias("valid_pct"),
        F.count_distinct(F.when(valid, text(df, c))).alias("n_unique"), F.sum(x).alias("sum"), F.try_divide(F.sum(x), filled).alias("mean"), F.min(x).alias("min"), F.max(x).alias("max"),
    )
    return row.crossJoin(quantiles(df, x, [0.5]).select(F.col("q")[0].alias("median")))  # of one row each


def frequencies(df: DataFrame, column: str) -> DataFrame:
    """(value, count, pct) of cells that aren't empty."""
    c = required(df, column)
    counts = df.select(text(df, c).alias("value")).filter(F.trim("value") != "").groupBy("value").agg(F.count(F.lit(1)).alias("count"))
    total = counts.agg(F.sum("count").alias("_total"))
    return counts.crossJoin(F.broadcast(total)).select("value", "count", (F.col("count") * 100.0 / F.col("_total")).alias("pct"))  # one row


def frequency_list(df: DataFrame, column: str, sort: str = "COUNT_DESC", limit: int | None = None) -> DataFrame:
    """The frequencies in one of four orders, values deciding between equal counts."""
    orders = {"COUNT_DESC": [F.desc("count"), F.asc("value")], "COUNT_ASC": [F.asc("count"), F.asc("value")], "VALUE_ASC": [F.asc("value")], "VALUE_DESC": [F.desc("value")]}
    out = frequencies(df, column).orderBy(*orders[sort])
    return out.limit(limit) if limit else out


def mode(df: DataFrame, column: str) -> DataFrame:
    """The commonest value, the smallest of equals."""
    return frequency_list(df, column, limit=1)


def top_and_others(df: DataFrame, column: str, k: int = 10) -> DataFrame:
    """(place, value, count, pct): the k commonest values and, at place k + 1, all others together."""
    every = frequencies(df, column)
    top = every.orderBy(F.desc("count"), F.asc("value")).limit(k)
    top = top.withColumn("place", F.row_number().over(Window.orderBy(F.desc("count"), F.asc("value"))).cast("long"))  # k rows
    whole = every.agg(F.sum("count").alias("count"))
    rest = whole.crossJoin(top.agg(F.sum("count").alias("top"))).filter(F.col("count") > F.col("top"))  # of one row each
    others = rest.select(F.lit(k + 1).cast("long").alias("place"), F.lit("Others").alias("value"), (F.col("count") - F.col("top")).alias("count"), ((F.col("count") - F.col("top")) * 100.0 / F.col("count")).alias("pct"))
    return top.select("place", "value", "count", "pct").unionByName(others)


def histogram(df: DataFrame, column: str, bins: int = BINS) -> DataFrame:
    """(bin, low, high, count) of equal bins that aren't empty; the largest value is in the last one."""
    x = df.select(number(df, required(df, column)).alias("x")).filter("x is not null")
    ends = x.agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    width = F.when(F.col("hi") - F.col("lo") < 1e-9, 1.0).otherwise(F.col("hi") - F.col("lo")) / bins
    rows = x.crossJoin(F.broadcast(ends)).withColumn("w", width)  # one row
    rows = rows.withColumn("bin", F.least(F.floor((F.col("x") - F.col("lo")) / F.col("w")), F.lit(bins - 1)))
    counts = rows.groupBy("bin", "lo", "w").agg(F.count(F.lit(1)).alias("count"))
    return counts.select("bin", (F.col("lo") + F.col("bin") * F.col("w")).alias("low"), (F.col("lo") + (F.col("bin") + 1) * F.col("w")).alias("high"), "count")


def date_distribution(df: DataFrame, column: str) -> DataFrame:
    """(unit, bucket, count): months up to 20, quarters up to 80 months, years up to 20, else centuries."""
    c = quoted(required(df, column))
    months, years = F.year("hi") * 12 + F.month("hi") - F.year("lo") * 12 - F.month("lo") + 1, F.year("hi") - F.year("lo") + 1
    unit = F.when(months <= 20, "month").when(months <= 80, "quarter").when(years <= 20, "year").otherwise("century")
    span = df.agg(F.min(c).alias("lo"), F.max(c).alias("hi")).select(unit.alias("unit"))
    d = F.col("d")
    rows = df.select(c.alias("d")).filter("d is not null").crossJoin(F.broadcast(span))  # one row
    label = F.when(F.col("unit") == "month", bucket(d, "month")).when(F.col("unit") == "quarter", bucket(d, "quarter", quarter_sign=" Q")).when(F.col("unit") == "year", bucket(d, "year")).otherwise(bucket(d, "century", century_sign="XX"))
    return rows.groupBy("unit", label.alias("bucket")).agg(F.count(F.lit(1)).alias("count"))


def percentiles(df: DataFrame, column: str) -> DataFrame:
    """One row: p1 to p99, iqr, stddev (of a sample), mean."""
    x = number(df, required(df, column))
    points = (1, 5, 10, 25, 50, 75, 90, 95, 99)
    row = df.agg(F.coalesce(F.stddev_samp(x), F.lit(0.0)).alias("stddev"), F.avg(x).alias("mean")).crossJoin(quantiles(df, x, [p / 100 for p in points]))  # of one row each
    return row.select(*[F.col("q")[i].alias(f"p{p}") for i, p in enumerate(points)], (F.col("q")[5] - F.col("q")[3]).alias("iqr"), "stddev", "mean")


def blocks(df: DataFrame, column: str, n: int = BLOCKS, order_by: str | None = None) -> DataFrame:
    """(block, count, mean, min, max, level) of at most n runs of equally many rows, in order of the value or of ``order_by``;
    ``level``: the mean's place between the least and the largest one, 0 to 7."""
    c = required(df, column)
    by = [quoted(order_by)] if order_by else []
    rows = df.select(number(df, c).alias("x"), *[b.alias("_by") for b in by]).filter("x is not null")
    rows = numbered(rows, [F.col("_by"), F.col("x")] if order_by else [F.col("x")], "_pos")
    total = rows.agg(F.count(F.lit(1)).alias("_n"))
    size = F.least(F.lit(n).cast("long"), F.col("_n"))
    rows = rows.crossJoin(F.broadcast(total)).withColumn("block", F.floor((F.col("_pos") - 1) * size / F.col("_n")))  # one row
    out = rows.groupBy("block").agg(F.count(F.lit(1)).alias("count"), F.avg("x").alias("mean"), F.min("x").alias("min"), F.max("x").alias("max"))
    every = Window.partitionBy(F.lit(0))  # n rows
    lo, hi = F.min("mean").over(every), F.max("mean").over(every)
    return out.withColumn("level", F.when(hi > lo, F.floor((F.col("mean") - lo) / (hi - lo) * 7 + 0.5)).otherwise(F.lit(0)).cast("int"))
