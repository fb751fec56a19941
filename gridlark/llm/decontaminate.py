"""Benchmark decontamination by Wu-Manber search over words.

The patterns are the windows of ``WIDTH`` consecutive words of the benchmark's items; an item of fewer words is one window. They
are searched for in classes of equal length. A class has a shift table over blocks of ``BLOCK`` words: how far the search may
move on when it has read that block at the end of its window; a block that no window has lets it skip nearly a whole window.
Where a window may end, the bucket of its last block is asked, divided by first blocks, and what is there is compared word by
word with the text.

The tables are sent to all tasks, so they are bounded: a benchmark of more than ``SHARD`` words is cut into shards, and the
shards' findings are put together by document. Long items are cut into overlapping pieces, so that no shard is larger for them.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridlark.llm.tables import slices, written

#: Words of a window and of a block of the shift table.
WIDTH, BLOCK = 10, 2
#: Benchmark words whose tables are sent to all tasks at a time, and those of a piece of an item.
SHARD, PIECE = 200_000, 5_000
#: What a word is made of, as bytes of UTF-8: digits, letters, all beyond ASCII. A-Z become small, all else parts words.
_FOLD = bytes(ord(" ") if b < 0x30 or 0x39 < b < 0x41 or 0x5A < b < 0x61 or 0x7A < b < 0x80 else b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))


def words(text: str | None) -> list[bytes]:
    """Words of a text; null has none."""
    return [] if text is None else text.encode("utf-8", "surrogatepass").translate(_FOLD).split()


class Matcher:
    """Windows of one length, by Wu-Manber: shifts by block, buckets by last block, divided by first block."""

    def __init__(self, length: int, windows: Iterable[tuple[bytes, ...]]) -> None:
        self.length, self.block = length, min(BLOCK, length)
        self.most = length - self.block + 1
        self.shift: dict[tuple[bytes, ...], int] = {}
        self.buckets: dict[tuple[bytes, ...], dict[tuple[bytes, ...], list[tuple[tuple[bytes, ...], int]]]] = {}
        for number, w in enumerate(windows):
            for end in range(self.block, length + 1):
                b = w[end - self.block : end]
                if length - end < self.shift.get(b, self.most):
                    self.shift[b] = length - end
            self.buckets.setdefault(w[length - self.block :], {}).setdefault(w[: self.block], []).append((w, number))

    def find(self, text: list[bytes]) -> Iterator[tuple[int, int]]:
        """(start, number) of each occurrence of a window in the words, by ascending start."""
        length, block, most, shift = self.length, self.block, self.most, self.shift.get
        end, n = length, len(text)
        while end <= n:
            last = tuple(text[end - block : end])
            far = shift(last, most)
            if far:
                end += far
                continue
            start = end - length
            for window, number in self.buckets[last].get(tuple(text[start : start + block]), ()):
                if list(window) == text[start:end]:
                    yield start, number
            end += 1


class Search:
    """All windows of some items: (item, whether it is a whole item, words) of pieces."""

    def __init__(self, pieces: Iterable[tuple[str | None, bool, list[bytes]]], width: int = WIDTH) -> None:
        found: dict[int, dict[tuple[bytes, ...], set[str]]] = defaultdict(dict)
        for item, whole, text in pieces:
            size = min(width, len(text)) if whole else width
            for k in range(len(text) - size + 1 if size else 0):
                items = found[size].setdefault(tuple(text[k : k + size]), set())
                if item is not None:
                    items.add(item)
        self.matchers = [(Matcher(size, windows), list(windows.values())) for size, windows in sorted(found.items())]

    def search(self, text: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """The stretches [start, end) of the text that windows cover, apart from each other, and the items of the windows."""
        spans, items = [], set()
        for matcher, owners in self.matchers:
            for start, number in matcher.find(text):
                items |= owners[number]
                if spans and spans[-1][0] <= start <= spans[-1][1] and spans[-1][1] <= start + matcher.length:
                    spans[-1] = spans[-1][0], start + matcher.length
                else:
                    spans.append((start, start + matcher.length))
        return united(spans), items


def united(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = out[-1][0], max(out[-1][1], end)
        else:
            out.append((start, end))
    return out


def pieces(items: DataFrame, width: int = WIDTH, size: int = PIECE) -> DataFrame:
    """(item, whole, words) of ``items`` (item_id, text): words joined by blanks, long items in pieces that overlap so far that
    each window is in one of them. Items without words have none."""

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            rows = []
            for item, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
                found = words(text)
                if found:
                    rows += [(item, len(found) <= size, b" ".join(found[k : k + size]).decode("utf-8", "replace")) for k in range(0, max(1, len(found) - width + 1), size - width + 1)]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.bool_(), pa.string()))], names=["item", "whole", "words"])

    return items.select(F.col("item_id").cast("string").alias("item"), "text").mapInArrow(cut, "item string, whole boolean, words string")


def searches(items: DataFrame, width: int = WIDTH, shard: int = SHARD) -> Iterator[Search]:
    """The search for each shard of the items, of about ``shard`` words each."""
    cut = written(pieces(items, width, max(2 * width, min(PIECE, shard))).distinct(), "windows-pieces")
    total = cut.agg(F.sum(F.size(F.split("words", " ")))).first()[0] or 0
    parts = -(-total // shard) or 1
    number = F.pmod(F.xxhash64("item", "words"), F.lit(parts))
    for k in range(parts):
        # a shard's words are bounded: hashes are even, and pieces small
        yield Search(((r["item"], r["whole"], r["words"].encode("utf-8", "surrogatepass").split(b" ")) for r in cut.filter(number == k).collect()), width)


def scanned(docs: DataFrame, search: Search, all_rows: bool = True) -> DataFrame:
    """(row, n_words, spans, items) of ``docs`` (row, text); without ``all_rows``, of those with a hit."""
    sent = docs.sparkSession.sparkContext.broadcast(search)

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = sent.value.search
        for b in slices(batches):
            rows = []
            for row, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                split = words(text)
                spans, items = found(split)
                if spans or all_rows:
                    rows.append((row, len(split), [s for s, _ in spans], [e for _, e in spans], sorted(items)))
            kinds = pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names=["row", "n_words", "first", "last", "items"])

    out = docs.select("row", "text").mapInArrow(scan, "row long, n_words long, first array<long>, last array<long>, items array<string>")
    return out.select("row", "n_words", F.arrays_zip("first", "last").alias("spans"), "items")


def covered(spans: Column) -> Column:
    """How many words lie in the spans, in one pass over them by their starts."""
    nothing = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("end"))
    step = lambda at, s: F.struct((at["n"] + F.greatest(F.lit(0), s["last"] - F.greatest(s["first"], at["end"]))).alias("n"), F.greatest(at["end"], s["last"]).alias("end"))
    return F.aggregate(F.array_sort(spans), nothing, step, lambda at: at["n"])


def report(found: DataFrame) -> DataFrame:
    """The columns of ``contamination`` from (doc_id, n_words, spans, items)."""
    rows = found.withColumn("n_hit", covered(F.col("spans")))
    return rows.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ",").cast("binary"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def contamination(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, shard: int = SHARD) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated) for each row of ``docs`` (doc_id, text, others).

    A word is hit that lies in an occurrence of a window of ``benchmark`` (item_id, text, others). Null, empty and blank texts
    have no words and no windows. Windows of items without an id hit words, but are no item that could be named; rows with one
    item_id are one item. Documents may lack an id or share it: each row is searched on its own and comes out once. Empty
    tables give an empty result, or one without hits.
    """
    texts, found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), searches(benchmark, width, shard)
    first = next(found)
    more = next(found, None)
    if more is None:
        return report(scanned(texts.withColumnRenamed("doc_id", "row"), first).withColumnRenamed("row", "doc_id"))
    rows = written(texts.withColumn("row", F.monotonically_increasing_id()), "windows-rows")
    hits = [written(scanned(rows, first), "windows-found")]
    while more is not None:
        hits.append(written(scanned(rows, more, all_rows=False), "windows-found"))
        more = next(found, None)
    hits = reduce(DataFrame.unionByName, hits).groupBy("row")
    hits = hits.agg(F.max("n_words").alias("n_words"), F.flatten(F.collect_list("spans")).alias("spans"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"))
    return report(rows.select("row", "doc_id").join(hits, "row"))


#: DuckDB SQL for ``contamination`` over the tables documents and benchmark: all windows of the documents, joined.
SQL = r"""
WITH item_words AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), windows AS (
  SELECT DISTINCT item_id, size, array_to_string(w[i:i + size - 1], ' ') AS g
  FROM (SELECT item_id, w, least(len(w), 10) AS size, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM item_words WHERE len(w) > 0)
), doc_words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), places AS (
  SELECT doc_id, size, i, array_to_string(w[i:i + size - 1], ' ') AS g
  FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM doc_words, (SELECT DISTINCT size FROM windows))
), hits AS (
  SELECT p.doc_id, p.i, p.size, x.item_id FROM places p JOIN windows x ON x.size = p.size AND x.g = p.g
), hit_words AS (
  SELECT doc_id, count(DISTINCT place) AS n FROM (SELECT doc_id, unnest(range(i, i + size)) AS place FROM hits) GROUP BY doc_id
), hit_items AS (
  SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits WHERE item_id IS NOT NULL) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(h.n, 0) AS BIGINT) AS n_hit, CAST(coalesce(i.n, 0) AS BIGINT) AS n_items,
       sha256(coalesce(i.items, '')) AS items_sha256, coalesce(h.n, 0) > 0 AS contaminated
FROM doc_words d LEFT JOIN hit_words h ON h.doc_id = d.doc_id LEFT JOIN hit_items i ON i.doc_id = d.doc_id
"""
