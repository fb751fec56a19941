"""Joins by a key of which few values may have most of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Keys that count as hot at most: each has more than this share of all rows.
HOT = 10_000


def looked_up(rows: DataFrame, table: DataFrame, key: str, of: str, weight: str, how: str = "left", most: int = HOT) -> DataFrame:
    """``rows`` joined with the row of ``table`` whose ``of`` equals their ``key``; how: left or inner.

    ``table`` has a row for each key, ``weight`` says how many rows have it. It is read three times, so it should be a written
    one. Keys with more than one of ``most`` of the rows, fewer than ``most`` by that, are sent to all tasks. Rows without a key
    and with a hot one stay out of the shuffle's key: they are spread over as many tasks as they came from. So no task gets more
    than its part of a key.
    """
    values = [c for c in table.columns if c != of]
    total = table.agg(F.sum(weight)).first()[0] or 0
    hot = table.filter(F.col(weight) > total / most).select(F.col(of).alias("_hot"), *[F.col(c).alias(f"_hot_{c}") for c in values])
    cold = table.filter(F.col(weight) <= total / most).select(F.col(of).alias("_cold"), F.lit(0).alias("_no"), *[F.col(c).alias(f"_cold_{c}") for c in values])
    out = rows.join(F.broadcast(hot), rows[key] == F.col("_hot"), "left")  # fewer than ``most`` rows
    found = F.col("_hot").isNotNull() | F.col(key).isNull()
    out = out.withColumn("_salt", F.when(found, F.spark_partition_id() + 1).otherwise(0)).drop("_hot")
    out = out.join(cold, (F.col(key) == F.col("_cold")) & (F.col("_salt") == F.col("_no")), "left")
    if how == "inner":
        out = out.filter((F.col("_cold").isNotNull() | (F.col("_salt") > 0)) & F.col(key).isNotNull())
    return out.select(*rows.columns, *[F.coalesce(f"_hot_{c}", f"_cold_{c}").alias(c) for c in values])
