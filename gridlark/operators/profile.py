"""A profile of every column of a table, in few passes over it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridlark.functions.columns import quoted, text
from gridlark.functions.numbers import number


_DATE = r"^\d{4}[-/]\d{2}"


def _long(df: DataFrame) -> DataFrame:
    """(column, cell, x, is_number, is_date) of each cell: one scan, however many columns."""
    cells = F.array(*[F.struct(F.lit(c).alias("column"), text(df, c).alias("cell"), number(df, c).alias("x")) for c in df.columns])
    rows = df.select(F.explode(cells).alias("c")).select("c.*")
    return rows.withColumn("filled", F.trim("cell") != "").withColumn("is_date", F.col("cell").rlike(_DATE))


#: Cells of a task that keeps the distinct ones.
CELLS = 1 << 18


def _dealt(df: DataFrame, cells: int = CELLS) -> DataFrame:
    """``df`` in tasks of about ``cells`` cells, whatever the files' sizes say, so that the distinct ones of a task are bounded.
    Equal rows are kept apart by the task that reads them."""
    parts = -(-df.count() * len(df.columns) // cells)
    return df.repartition(parts, *[quoted(c) for c in df.columns], F.spark_partition_id()) if parts > 1 else df


def profile(df: DataFrame, approximate: bool = False) -> DataFrame:
    """(column, rows, nulls, null_pct, type, n_unique, min, max, mean, stddev) of each column; numbers only where the type is
    number. ``approximate``: estimate the distinct values."""
    rows = _long(df if approximate else _dealt(df))
    value = F.when(F.col("filled"), F.col("cell"))
    distinct = F.approx_count_distinct(value) if approximate else F.count_distinct(value)
    filled, numbers, dates = F.count_if("filled"), F.count("x"), F.count_if(F.col("filled") & F.col("is_date"))
    out = rows.groupBy("column").agg(F.count(F.lit(1)).alias("rows"), filled.alias("_filled"), numbers.alias("_numbers"), dates.alias("_dates"), distinct.alias("n_unique"), F.min("x").alias("_min"), F.max("x").alias("_max"), F.avg("x").alias("_mean"), F.coalesce(F.stddev_samp("x"), F.lit(0.0)).alias("_std"))
    return _shown(out)


def _shown(out: DataFrame) -> DataFrame:
    share = lambda c: F.floor(F.col(c) * 100 / F.col("_filled")) >= 80
    kind = F.when(F.col("_filled") == 0, "empty").when(share("_numbers"), "number").when(share("_dates"), "date").otherwise("string")
    out = out.withColumn("type", kind).withColumn("nulls", F.col("rows") - F.col("_filled"))
    only = lambda c: F.when(F.col("type") == "number", F.col(c)).alias(c[1:])
    return out.select("column", "rows", "nulls", (F.col("nulls") * 100.0 / F.col("rows")).alias("null_pct"), "type", "n_unique", only("_min"), only("_max"), only("_mean"), only("_std")).withColumnRenamed("std", "stddev")


#: Registers of a sketch of distinct values, as a power of two: 4,096 registers, a standard error of 1.6 %.
REGISTERS = 12


def parts(df: DataFrame) -> DataFrame:
    """A row for each column of ``df``, of which ``merged`` makes a profile, also of several tables with the same columns: counts,
    bounds, the mean and squares about it, and a sketch of the distinct values. One aggregate over one scan; each task sends a few
    kilobytes a column, however many distinct values there are."""
    made = []
    for c in df.columns:
        cell, x = text(df, c), number(df, c)
        filled = F.trim(cell) != ""
        made.append(
            F.struct(
                F.lit(c).alias("column"), F.count(F.lit(1)).alias("rows"), F.count_if(filled).alias("_filled"), F.count(x).alias("_numbers"),
                F.count_if(filled & cell.rlike(_DATE)).alias("_dates"), F.hll_sketch_agg(F.when(filled, cell), F.lit(REGISTERS)).alias("_distinct"),
                F.min(x).alias("_min"), F.max(x).alias("_max"), F.avg(x).alias("_mean"), (F.var_pop(x) * F.count(x)).alias("_squares"),
            )
        )
    return df.agg(F.array(*made).alias("c")).select(F.explode("c").alias("c")).select("c.*")  # a row per column


def merged(found: DataFrame) -> DataFrame:
    """The columns of ``profile`` from the rows of ``parts`` of one or more tables; ``n_unique`` is an estimate, exact for few
    values. Means and deviations of parts add up about the common mean, so no digits are lost."""
    own = Window.partitionBy("column")  # a row per part
    rows = found.withColumn("_all", F.sum(F.col("_numbers") * F.col("_mean")).over(own) / F.sum("_numbers").over(own))
    squares = F.sum(F.coalesce("_squares", F.lit(0.0)) + F.col("_numbers") * F.coalesce(F.pow(F.col("_mean") - F.col("_all"), 2), F.lit(0.0)))
    sums = [F.sum(c).alias(c) for c in ("rows", "_filled", "_numbers", "_dates")]
    distinct = F.hll_sketch_estimate(F.hll_union_agg("_distinct")).alias("n_unique")
    std = F.when(F.sum("_numbers") > 1, F.sqrt(squares / (F.sum("_numbers") - 1))).otherwise(F.lit(0.0)).alias("_std")
    return _shown(rows.groupBy("column").agg(*sums, distinct, F.min("_min").alias("_min"), F.max("_max").alias("_max"), F.first("_all").alias("_mean"), std))


def outlier_counts(df: DataFrame, sigmas: float = 3.0) -> DataFrame:
    """(column, outliers): numbers further than ``sigmas`` sample deviations from the mean."""
    rows = _long(df).filter("x is not null").select("column", "x")
    stats = rows.groupBy("column").agg(F.avg("x").alias("m"), F.coalesce(F.stddev_samp("x"), F.lit(0.0)).alias("s"))
    far = (F.col("x") < F.col("m") - sigmas * F.col("s")) | (F.col("x") > F.col("m") + sigmas * F.col("s"))
    return rows.join(F.broadcast(stats), "column").groupBy("column").agg(F.count_if(far).alias("outliers"))  # a row per column


def top_values(df: DataFrame, k: int = 5, columns: list[str] | None = None) -> DataFrame:
    """(column, place, value, count): the k commonest values of each column, the smaller of equals first."""
    columns = columns or df.columns
    df = _dealt(df.select(*[quoted(c) for c in columns]))
    cells = F.array(*[F.struct(F.lit(c).alias("column"), text(df, c).alias("value")) for c in columns])
    rows = df.select(F.explode(cells).alias("c")).select("c.*").filter(F.trim("value") != "")  # one scan, however many columns
    counts = rows.groupBy("column", "value").agg(F.count(F.lit(1)).alias("count"))
    place = F.row_number().over(Window.partitionBy("column").orderBy(F.desc("count"), F.asc("value")))
    return counts.withColumn("place", place.cast("long")).filter(F.col("place") <= k)
