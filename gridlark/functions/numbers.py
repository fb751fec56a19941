"""Numbers in text cells, and how they are shown."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridlark.functions.columns import kind, quoted

_NUMBER = r"^\s*[-+]?(\d+\.?\d*|\.\d+)([eE][-+]?\d+)?$"
_PREFIX = r"^\s*([-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?)"


def full(cell: Column) -> Column:
    """The number a text cell is, with a decimal point or comma, or null if it isn't one as a whole."""
    dotted = F.translate(cell, ",", ".")
    return F.when(dotted.rlike(_NUMBER), F.trim(dotted).try_cast("double"))


def prefix(cell: Column) -> Column:
    """The number that a text cell begins with, as formulas read it."""
    found = F.regexp_extract(F.translate(cell, ",", "."), _PREFIX, 1)
    return F.when(found != "", found.try_cast("double"))


def cleaned(cell: Column) -> Column:
    """The number left of a money cell: digits, signs and points stay, the first comma is a point. 0 if nothing is left."""
    kept = F.regexp_replace(F.regexp_replace(cell, r"^([^,]*),", "$1."), r"[^0-9+.\-]", "")
    return F.coalesce(prefix(kept), F.lit(0.0))


def number(df: DataFrame, name: str, parse=full) -> Column:
    """A column as double: numeric columns as they are, text columns through ``parse``."""
    c = quoted(name)
    if kind(df, name) == "number":
        return c.cast("double")
    return parse(c.cast("string")) if kind(df, name) == "text" else F.lit(None).cast("double")


def half_away(x: Column, digits: Column | int = 0) -> Column:
    """Rounded half away from zero on the scaled double."""
    scale = F.pow(F.lit(10.0), digits if isinstance(digits, Column) else F.lit(float(digits)))
    return F.signum(x) * F.floor(F.abs(x) * scale + 0.5) / scale


def fixed(cell: Column, digits: int) -> Column:
    """A numeric text cell with ``digits`` decimals; empty is 0, other text stays. Halves of the decimal number go up."""
    value = full(cell)
    return F.when(F.trim(F.coalesce(cell, F.lit(""))) == "", "0").when(value.isNull(), cell).otherwise(F.format_string(f"%.{digits}f", value))


def thousands(x: Column) -> Column:
    """1234567 -> 1 234 567."""
    return F.translate(F.format_number(x, 0), ",", " ")


def short(x: Column) -> Column:
    """1500 -> 1.5K, 2000000 -> 2.0M."""
    out = F.format_string("%.0f", x)
    for size, sign in ((1e3, "K"), (1e6, "M"), (1e9, "G")):
        out = F.when(F.abs(x) >= size, F.concat(F.format_string("%.1f", x / size), F.lit(sign))).otherwise(out)
    return out


def shown(x: Column) -> Column:
    """A formula's result as text: whole numbers without decimals, others with up to ten digits."""
    return F.when(x == F.floor(x), F.format_string("%.0f", x)).otherwise(x.cast("string"))


def truncated(cell: Column, length: int) -> Column:
    return F.when(F.length(cell) > length, F.concat(F.substring(cell, 1, length), F.lit("..."))).otherwise(cell)


def file_name(cell: Column) -> Column:
    return F.regexp_replace(cell, r"[^A-Za-z0-9._-]", "_")
