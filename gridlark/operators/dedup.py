"""Deduplication by keys, keeping the first or last row of an order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridlark.functions.columns import quoted, required
from gridlark.operators.sorting import keyed, parse


def key(df: DataFrame, ref: str | int) -> str:
    """A key column by name or by number from 1."""
    if isinstance(ref, int) or str(ref).isdigit():
        if not 1 <= int(ref) <= len(df.columns):
            raise ValueError(f"no column number {ref}")
        return df.columns[int(ref) - 1]
    return required(df, ref)


def dedup(df: DataFrame, by: Sequence[str | int] = (), keep: str = "first", tie: str | None = None, view: str = "", within: Column | None = None) -> DataFrame:
    """One row for each key. ``tie`` is the physical order, ``view`` a sort that goes before it; by default all columns but
    ``tie`` are the key. Only the first row of a key so far is kept in each task before rows are shuffled (window group limit)."""
    if keep not in ("first", "last"):
        raise ValueError(f"keep first or last, not {keep}")
    if keep == "last" and not tie and not parse(df, view):
        raise ValueError("the last row needs an order: a tie column or a sort")
    names = [key(df, x) for x in by] or [c for c in df.columns if c != tie]
    rows, by, made = keyed(df, view, tie, back=keep == "last")
    if not by:
        return df.dropDuplicates(names)
    rank = F.row_number().over(Window.partitionBy(*map(quoted, names)).orderBy(*by))
    return rows.withColumn("_rank", rank).filter("_rank = 1").drop("_rank", *made)


def summary(df: DataFrame, kept: DataFrame) -> DataFrame:
    """(kept, removed) in rows."""
    a, b = df.agg(F.count(F.lit(1)).alias("n")), kept.agg(F.count(F.lit(1)).alias("kept"))
    return b.crossJoin(a).select("kept", (F.col("n") - F.col("kept")).alias("removed"))  # of one row each
