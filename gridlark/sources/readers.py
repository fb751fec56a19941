"""Readers: a format by extension, delimiters, comments, headers, schema discovery and type inference."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridlark.functions.columns import clean_name, letter, quoted
from gridlark.functions.dates import parsed
from gridlark.functions.numbers import full

#: Delimiters by extension, those that are sniffed, and what counts as missing when types are inferred.
DELIMITERS = {"csv": ",", "tsv": "\t", "psv": "|", "ecsv": " ", "txt": ","}
SNIFFED = "\t|;,"
MISSING = ("", "NA", "na", "N/A", "n/a", "null", "NULL", "-")
DATE_PATTERNS = (r"^\d{4}-\d{2}-\d{2}([T ].*)?$", r"^\d{2}\.\d{2}\.\d{4}( .*)?$", r"^\d{2}/\d{2}/\d{4}( .*)?$", r"^\d{4}/\d{2}/\d{2}( .*)?$", r"^\d{4}-\d{2}$")
ROW_ID = "_rid"
#: What an unquoted empty cell is read as, before it becomes null: no text has it. A quoted one is the empty text.
NOTHING = "\ufdd0"
#: Lines whose keys come first, in their order.
HEAD = 200


def extension(path: str) -> str:
    return path.rstrip("/").rpartition(".")[2].lower()


def _head(spark: SparkSession, path: str, n: int = 50) -> list[str]:
    return [r["value"] for r in spark.read.text(path).limit(n).collect()]


def sniff_delimiter(line: str) -> str:
    """The commonest of tab, bar, semicolon and comma; a comma if there is none."""
    best = max(SNIFFED, key=line.count)
    return best if line.count(best) else ","


def delimiter(spark: SparkSession, path: str, sep: str | None = None, sniff: bool = False) -> str:
    """The given one, else the extension's, in ECSV files the declared one, else a sniffed one or a comma."""
    if sep:
        return sep
    kind = extension(path)
    if kind == "ecsv":
        found = [m[1] for x in _head(spark, path) if (m := re.match(r"#\s*delimiter:\s*['\"]?(.+?)['\"]?\s*$", x))]
        return {"space": " ", "comma": ","}.get(found[0], found[0]) if found else " "
    if sniff:
        lines = [x for x in _head(spark, path) if x.strip() and not x.startswith("#")]
        return sniff_delimiter(lines[0]) if lines else ","
    return DELIMITERS.get(kind, ",")


def read_delimited(spark: SparkSession, path: str, sep: str | None = None, header: bool = True, comments: bool | None = None, row_id: bool = False, sniff: bool = False) -> DataFrame:
    """All cells as text. Quotes are doubled inside quotes, no cell spans lines, short rows are filled with nulls.

    Without a header the columns are A, B, ... ``comments`` skips lines that begin with #; by default if the first line does.
    ``row_id`` adds the physical order in ``_rid``, from 0: by the files' names, then as the lines follow each other.
    """
    if comments is None:
        comments = any(x.startswith("#") for x in _head(spark, path, 1))
    options = {"sep": delimiter(spark, path, sep, sniff), "quote": '"', "escape": '"', "header": header, "ignoreLeadingWhiteSpace": True, "multiLine": False, "mode": "PERMISSIVE", "nullValue": NOTHING}
    if comments:
        options["comment"] = "#"
    out = spark.read.options(**options).csv(path)
    names = [clean_name(c) for c in out.columns] if header else [letter(i) for i in range(len(out.columns))]
    return numbered_rows(out, row_id, lambda df: df.select(*[quoted(c).alias(n) for c, n in zip(out.columns, names, strict=True)], *[c for c in df.columns if c == ROW_ID]))


def read_comments(spark: SparkSession, path: str) -> DataFrame:
    """(text) of the lines that begin with #."""
    return spark.read.text(path).filter(F.col("value").startswith("#")).select(F.col("value").alias("text"))


def read_json_lines(spark: SparkSession, path: str, row_id: bool = False) -> DataFrame:
    """Cells as text by key; nested values are JSON text. The keys of all lines are columns: those of the first lines in the
    order in which they occur, then the rest by name. One pass over the lines, in which each task sends a row per key."""
    lines = spark.read.text(path).filter(F.trim("value") != "")
    found = lines.select(F.monotonically_increasing_id().alias("line"), F.posexplode(F.json_object_keys("value")).alias("at", "k"))
    first = found.groupBy("k").agg(F.min(F.struct("line", "at")).alias("first"))
    keys = [r["k"] for r in first.orderBy(F.when(F.col("first.line") < HEAD, F.col("first")).asc_nulls_last(), "k").collect()]
    cells = lambda df: df.withColumn("_m", F.from_json("value", "map<string,string>")).select(*[F.col("_m")[k].alias(k) for k in keys], *[c for c in df.columns if c == ROW_ID])
    return numbered_rows(lines, row_id, cells)


def read_parquet(spark: SparkSession, path: str, row_id: bool = False) -> DataFrame:
    return numbered_rows(spark.read.parquet(path), row_id)


def numbered_rows(files: DataFrame, row_id: bool, made: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """``made`` of ``files``, which reads files and nothing else; with ``row_id`` also the place of each row in ``_rid``, from 0:
    by the names of the files, then by the row's place in its file.

    Rows of a split are read one after the other, so a row's place in its split is that of its running number behind the
    split's first one. Splits are counted, a row each, and begin where those before them end. No row is sorted or shuffled.
    """
    if not row_id:
        return made(files)
    split = {"_path": F.col("_metadata.file_path"), "_block": F.col("_metadata.file_block_start")}
    rows = files.withColumns(split | {"_number": F.monotonically_increasing_id()})
    splits = rows.groupBy("_path", "_block").agg(F.min("_number").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_path", "_block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    out = rows.join(F.broadcast(splits.withColumn("_before", before).drop("_n")), ["_path", "_block"])  # a row per split of a file
    return made(out.withColumn(ROW_ID, F.col("_number") - F.col("_first") + F.col("_before")).drop("_path", "_block", "_number", "_first", "_before"))


READERS: dict[str, Callable[..., DataFrame]] = {
    **dict.fromkeys(("ndjson", "jsonl", "ldjson"), read_json_lines),
    **dict.fromkeys(("csv", "tsv", "psv", "ecsv", "txt"), read_delimited),
    "parquet": read_parquet,
}


def read(spark: SparkSession, path: str, row_id: bool = False, **delimited) -> DataFrame:
    """By extension; what is unknown is delimited text. ``delimited``: options of ``read_delimited``, which other formats have
    no use for and leave aside."""
    reader = READERS.get(extension(path), read_delimited)
    return reader(spark, path, row_id=row_id, **(delimited if reader is read_delimited else {}))


def infer_types(df: DataFrame, columns: Sequence[str] | None = None, sample: int | None = None, share: float = 0.9) -> dict[str, str]:
    """date, number or text of text columns: a type that 90 % of the cells with a value have, dates before numbers. A leading
    zero makes a cell no number. One aggregate over all rows, or over the first ``sample`` ones. With a ``share`` of 1 no cell
    with a value is lost by ``typed``; ``misfits`` counts what else would be."""
    names = list(columns or [c for c, t in df.dtypes if t == "string"])
    head = df.select(*map(quoted, names))
    head = head.limit(sample) if sample else head
    made = []
    for i, c in enumerate(names):
        cell = F.trim(F.coalesce(quoted(c), F.lit("")))
        valid = ~cell.isin(*MISSING)
        number = full(cell).isNotNull() & ~cell.rlike(r"^[-+]?0\d")
        date = F.lit(False)
        for p in DATE_PATTERNS:
            date = date | cell.rlike(p)
        made += [F.count_if(valid).alias(f"v{i}"), F.count_if(valid & number).alias(f"n{i}"), F.count_if(valid & date).alias(f"d{i}")]
    row = head.agg(*made).first() if made else {}
    kinds = {}
    for i, c in enumerate(names):
        least = share * row[f"v{i}"]
        kinds[c] = "text" if not row[f"v{i}"] else "date" if row[f"d{i}"] >= least else "number" if row[f"n{i}"] >= least else "text"
    return kinds


def _cast(c: str, kind: str):
    return full(quoted(c)) if kind == "number" else parsed(quoted(c)).cast("date")


def typed(df: DataFrame, kinds: dict[str, str]) -> DataFrame:
    """Text columns cast to their types; cells that don't fit are null. See ``misfits``."""
    return df.withColumns({c: _cast(c, k) for c, k in kinds.items() if k != "text"})


def misfits(df: DataFrame, kinds: dict[str, str]) -> DataFrame:
    """(column, misfits): cells with a value that ``typed`` would make null, of each column that it casts. One pass."""
    lost = {c: F.count_if(~F.trim(quoted(c)).isin(*MISSING) & _cast(c, k).isNull()) for c, k in kinds.items() if k != "text"}
    counts = F.array(*[F.struct(F.lit(c).alias("column"), n.alias("misfits")) for c, n in lost.items()])
    return df.agg(counts.alias("m")).select(F.explode("m").alias("m")).select("m.*")
