"""Finding columns by name or spreadsheet letter."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def letter(index: int) -> str:
    """0 -> A, 25 -> Z, 26 -> AA."""
    out, index = "", index + 1
    while index:
        index, rest = divmod(index - 1, 26)
        out = chr(65 + rest) + out
    return out


def letter_index(ref: str) -> int | None:
    """A -> 0; None if ``ref`` isn't made of capital letters."""
    if not re.fullmatch("[A-Z]+", ref or ""):
        return None
    n = 0
    for c in ref:
        n = n * 26 + ord(c) - 64
    return n - 1


def resolve(df: DataFrame, ref: str) -> str | None:
    """The column that ``ref`` names, whatever its case, the first of equals; else by its letter; else None."""
    for c in df.columns:
        if c.lower() == ref.strip().lower():
            return c
    index = letter_index(ref.strip())
    return df.columns[index] if index is not None and index < len(df.columns) else None


def required(df: DataFrame, ref: str) -> str:
    found = resolve(df, ref)
    if found is None:
        raise ValueError(f"unknown column: {ref}")
    return found


def quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def kind(df: DataFrame, name: str) -> str:
    """number, date or text."""
    found = dict(df.dtypes)[name]
    if found.startswith(("double", "float", "int", "bigint", "smallint", "tinyint", "decimal")):
        return "number"
    return "date" if found.startswith(("date", "timestamp")) else "text"


def text(df: DataFrame, name: str) -> Column:
    """The cell as text; missing is empty."""
    return F.coalesce(quoted(name).cast("string"), F.lit(""))


def clean_name(name: str) -> str:
    return name.strip(" \t\xa0")
