"""Filters, formulas and calendar aggregates over streams."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridlark.functions.columns import quoted, required
from gridlark.functions.numbers import number
from gridlark.operators import filters, formulas


def filtered(stream: DataFrame, query: str) -> DataFrame:
    """A filter holds row by row, so a stream takes it as a table does."""
    return filters.apply(stream, query)


def computed(stream: DataFrame, name: str, formula: str) -> DataFrame:
    """A formula without aggregates."""
    return stream.withColumn(name, formulas.compiled(stream, formula))


def windowed(stream: DataFrame, time: str, value: str, length: str = "1 day", lateness: str = "1 day") -> DataFrame:
    """(start, count, sum) by window of event time; rows later than ``lateness`` are left out and old windows are let go."""
    at = required(stream, time)
    rows = stream.withColumn("_time", quoted(at).cast("timestamp")).withWatermark("_time", lateness)
    out = rows.groupBy(F.window("_time", length)).agg(F.count(F.lit(1)).alias("count"), F.sum(number(stream, required(stream, value))).alias("sum"))
    return out.select(F.col("window.start").alias("start"), "count", "sum")


def reload(stream: DataFrame, partial: Callable[[DataFrame], DataFrame], path: str, checkpoint: str) -> None:
    """Takes up what is new in a folder since the last call: ``partial`` of each batch of new files is written to ``path``, and
    what earlier calls have read isn't read again. A batch that is repeated after a failure replaces its own part."""

    def add(batch: DataFrame, number: int) -> None:
        partial(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    stream.writeStream.trigger(availableNow=True).foreachBatch(add).option("checkpointLocation", checkpoint).start().awaitTermination()


def reloaded(spark: SparkSession, path: str) -> DataFrame:
    """The parts that ``reload`` has written, to be merged: counts by a sum, profiles by ``profile.merged``."""
    return spark.read.parquet(path).drop("batch")
