"""Calendar buckets and date formats."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

UNITS = ("auto", "month", "quarter", "year", "century")
#: The date formats that text cells may have.
INPUT_FORMATS = ("yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd HH:mm", "yyyy-MM-dd", "dd.MM.yyyy HH:mm:ss", "dd.MM.yyyy", "dd/MM/yyyy", "MM/dd/yyyy", "yyyy/MM/dd", "yyyy-MM", "yyyyMMdd")
_STRFTIME = {"%Y": "yyyy", "%m": "MM", "%d": "dd", "%H": "HH", "%M": "mm", "%S": "ss", "%y": "yy", "%b": "MMM", "%B": "MMMM", "%j": "DDD"}


def parsed(cell: Column) -> Column:
    """A text cell as a timestamp, by the first format that fits; ISO times lose their T, fraction and zone."""
    plain = F.regexp_replace(F.regexp_replace(F.trim(cell), r"^(\d{4}-\d{2}-\d{2})T", "$1 "), r"(:\d{2})(\.\d+)?(Z|[+-]\d{2}:?\d{2})?$", "$1")
    return F.coalesce(*[F.try_to_timestamp(plain, F.lit(f)) for f in INPUT_FORMATS])


def java_format(strftime: str) -> str:
    """A strftime format as Spark's: fields by their letters, all else in quotes."""
    out, plain = "", ""
    for token in [*re.findall(r"%.|[^%]|%$", strftime, re.S), None]:
        if token is None or token in _STRFTIME:
            out += f"'{plain}'" if plain else ""
            out, plain = out + _STRFTIME.get(token, ""), ""
        else:
            plain += {"%%": "%", "'": "''"}.get(token, token)
    return out


def formatted(cell: Column, strftime: str) -> Column:
    """A date cell in another format; what isn't a date stays."""
    return F.coalesce(F.date_format(parsed(cell), java_format(strftime)), cell)


def bucket(date: Column, unit: str, raw: Column | None = None, quarter_sign: str = "-Q", century_sign: str = "xx") -> Column:
    """The calendar bucket of a date: 2024-03, 2024-Q1, 2024 or 20xx. Without a date, ``raw``."""
    year = F.year(date)
    made = {
        "auto": F.date_format(date, "yyyy-MM-dd"),
        "month": F.date_format(date, "yyyy-MM"),
        "quarter": F.concat(F.date_format(date, "yyyy"), F.lit(quarter_sign), F.quarter(date).cast("string")),
        "year": F.date_format(date, "yyyy"),
        "century": F.concat(F.lpad(F.floor(year / 100).cast("string"), 2, "0"), F.lit(century_sign)),
    }[unit]
    return made if raw is None else F.coalesce(made, raw)
