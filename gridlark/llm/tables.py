"""Where the operators read their tables and keep what more than one job needs."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridlark.sources.shared import new_path, shared_dir, written

__all__ = ["new_path", "shared_dir", "table", "written"]

#: ASCII blanks and the words between them, as the contracts define them.
BLANKS = " \t\n\x0b\f\r"
WORD_PATTERN = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole(text: str = "text"):
    """The text column with null as the empty text."""
    return F.coalesce(F.col(text), F.lit(""))


def fold(text: str | None) -> list[bytes]:
    """Words of a text, A-Z lower-cased, cut at ASCII blanks. ``bytes`` methods do exactly that."""
    return [] if text is None else text.encode("utf-8", "surrogatepass").lower().split()


def least_hashed(rows: DataFrame, n: int, seed: int, *columns: str) -> DataFrame:
    """The ``n`` rows that come first by a hash of ``columns``, or all if there are fewer. Rows are counted and hashes are even,
    so all but about ``4 n`` rows go in the scan, and no task sorts more, however many tasks there are. ``columns`` should tell
    rows apart: rows with equal ones go or stay together there."""
    h, total = F.xxhash64(F.lit(seed), *columns), rows.count()
    if 4 * n < total:
        rows = rows.filter(h < F.lit(-(1 << 63) + (1 << 66) * n // total))
    return rows.orderBy(h, *columns).limit(n)


def slices(batches, rows: int = 256):
    """Arrow batches cut into such of at most ``rows`` rows, so that a task has few texts as Python objects at a time."""
    for b in batches:
        for start in range(0, b.num_rows, rows):
            yield b.slice(start, rows)


def fresh(name: str, *frames: DataFrame) -> str:
    """``name``, with as many low lines before it as make it no column of the frames."""
    taken = {c.lower() for df in frames for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def keyed(docs: DataFrame, name: str) -> tuple[DataFrame, str] | None:
    """``docs`` with a number for each row, written, and that column's name, which ``docs`` doesn't have; None if doc_id is such a
    number already: never null and never repeated."""
    worst = docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n"), F.count_if(F.col("doc_id").isNull())).first()
    row = fresh("_row", docs)
    return None if (worst[0] or 0) <= 1 and not worst[1] else (written(docs.withColumn(row, F.monotonically_increasing_id()), name), row)


def crc_mod(column: str, modulus: int):
    """crc32 of the id as decimal text, modulo ``modulus``."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % modulus


def local_path(name: str) -> str:
    """A public tokenizer's file; the vocabulary's place is a parameter everywhere."""
    import public_tokenizers

    return os.fspath(public_tokenizers.path(name))
