"""Writers: views and columns to delimited text or JSON lines, splits by key, and concatenation of tables."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridlark.functions.columns import kind, quoted, required, text
from gridlark.functions.numbers import file_name
from gridlark.sources.readers import DELIMITERS, extension, infer_types, read


#: What a number looks like in JSON.
_BARE = r"^-?(0|[1-9]\d*)(\.\d+)?([eE][+-]?\d+)?$"


def _json_text(cell: Column) -> Column:
    """A text cell in JSON's quotes."""
    made = F.to_json(F.struct(cell.alias("c")))
    return F.substring(made, F.lit(6), F.length(made) - 6)


def json_rows(df: DataFrame, kinds: dict[str, str] | None = None) -> DataFrame:
    """(value) of each row as a JSON object. Bare are numbers, also those in text columns whose kind is ``number`` (``kinds``, as
    ``infer_types`` gives them), and the text cells true, false and null; missing cells are null; all else is text."""
    cells = []
    for c in df.columns:
        name = _json_text(F.lit(c))
        if kind(df, c) == "number" or dict(df.dtypes)[c] == "boolean":
            made = F.to_json(F.struct(quoted(c).alias("c")))
            cell = F.substring(made, F.lit(6), F.length(made) - 6)
            cell = F.when(quoted(c).isNotNull(), F.coalesce(cell, F.lit("null")))
        else:
            value = quoted(c).cast("string")
            bare = value.isin("true", "false", "null")
            if (kinds or {}).get(c) == "number":
                bare = bare | value.rlike(_BARE)
            cell = F.when(bare, value).when(value.isNotNull(), _json_text(value))
        cells.append(F.concat(name, F.lit(":"), F.coalesce(cell, F.lit("null"))))
    return df.select(F.concat(F.lit("{"), F.concat_ws(",", *cells), F.lit("}")).alias("value"))


def _delimited(cells: Sequence[Column], names: Sequence[str], sep: str) -> Column:
    """Text cells as a line. In quotes are those with a delimiter, a quote or a blank at an end, the empty text, which a missing
    cell is not, and what would look like a comment. A line end in a cell is an error: no reader here joins lines."""
    made = []
    for cell, name in zip(cells, names, strict=True):
        needed = (cell == "") | cell.rlike(r'^[\x00-\x20#]|[\x00-\x20]$|"') | F.contains(cell, F.lit(sep))
        shown = F.when(needed, F.concat(F.lit('"'), F.replace(cell, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(F.coalesce(cell, F.lit("" if len(names) > 1 else '""')))
        made.append(F.when(cell.rlike(r"[\r\n]"), F.raise_error(F.lit(f"a cell of {name} has more than one line"))).otherwise(shown))
    return F.concat_ws(sep, *made)


def _write_delimited(df: DataFrame, path: str, sep: str, header: bool) -> None:
    """Lines of text, in each part behind those of the names."""
    line = _delimited([quoted(c).cast("string") for c in df.columns], df.columns, sep)
    names = _delimited([F.lit(c) for c in df.columns], df.columns, sep)
    if header:
        first = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)) == 0  # of its task, so of its part
        line = F.when(first, F.concat(names, F.lit("\n"), line)).otherwise(line)
    lines = lambda df, x: df.select(x.alias("value")).write.mode("overwrite").option("maxRecordsPerFile", 0).text(path)
    lines(df, line)
    if header and df.sparkSession.read.text(path).isEmpty():
        lines(df.sparkSession.range(1).coalesce(1), names)


def write(df: DataFrame, path: str, sep: str | None = None, header: bool = True) -> None:
    """By extension, into a new folder of that name: Spark writes beside it and renames when all is there.

    Delimited cells come back as they were, but for a missing one in a table of one column, which is an empty one there. JSON
    lines have the numbers of text columns bare if the column is one of numbers (``infer_types``).
    """
    if extension(path) in ("ndjson", "jsonl", "ldjson"):
        json_rows(df, infer_types(df)).write.mode("overwrite").text(path)
    elif extension(path) == "parquet":
        df.write.mode("overwrite").parquet(path)
    else:
        _write_delimited(df, path, sep or DELIMITERS.get(extension(path), ","), header)


def write_column(base: DataFrame, column: str, path: str) -> None:
    """One column of all rows, whatever the view."""
    write(base.select(quoted(required(base, column))), path)


def with_split_key(df: DataFrame, key: str) -> DataFrame:
    """``df`` with ``split_key``: the key's cell, ``empty`` where it is blank."""
    cell = text(df, required(df, key))
    return df.withColumn("split_key", F.when(F.trim(cell) == "", "empty").otherwise(cell))


def split(df: DataFrame, key: str, path: str, drop: bool = False, form: str = "csv") -> None:
    """A folder for each value of the key. Rows are dealt out by key and a salt first, so that a common value has several
    writers and no task has all folders open."""
    rows = with_split_key(df, key)
    rows = rows.drop(required(df, key)) if drop else rows
    rows = rows.repartition("split_key", F.pmod(F.monotonically_increasing_id(), F.lit(8)))
    rows.write.mode("overwrite").partitionBy("split_key").options(header=True).format(form).save(path)


def split_manifest(df: DataFrame, key: str) -> DataFrame:
    """(split_key, file_name, rows)."""
    return with_split_key(df, key).groupBy("split_key").agg(F.count(F.lit(1)).alias("rows")).select("split_key", file_name(F.col("split_key")).alias("file_name"), "rows")


def concat(tables: Sequence[tuple[str, DataFrame]], source: str = "source_file") -> DataFrame:
    """All rows by position, with the name of their table in front. Tables must have equally many columns."""
    width = len(tables[0][1].columns)
    for name, df in tables:
        if len(df.columns) != width:
            raise ValueError(f"{name} has {len(df.columns)} columns, not {width}")
    return reduce(DataFrame.union, [df.select(F.lit(name).alias(source), *map(quoted, df.columns)) for name, df in tables])


def concat_files(spark: SparkSession, paths: Sequence[str], source: str = "source_file", **options) -> DataFrame:
    """Files of one kind, named by their base names without extension."""
    return concat([(p.rstrip("/").rpartition("/")[2].rpartition(".")[0], read(spark, p, **options)) for p in paths], source)
