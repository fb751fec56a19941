"""Periodic runs of words, after Ellert and Fischer: Lyndon arrays on ordered alphabets, matched stretches reused.

A run's Lyndon root is the longest Lyndon word at its start under one of the two orders of the alphabet, so the next smaller
suffixes of all positions, under both orders, give a root of each run (``next_smaller``). How far the two suffixes of such an
edge agree is found with it: so far does the root's period reach to the right. What two positions have been found to share
isn't read again. Inside a matched stretch the edges of its earlier copy hold, as long as the copy's comparisons ended inside;
one that didn't goes on from the stretch's end. So each comparison of words ends a comparison of suffixes or moves the furthest
word read: linear in the words, without suffix structures and without hashes of stretches. To the left a run's first root is
extended by less than its period.

The words of a batch are numbered in their order. A run of ``PERIODS`` periods holds each of its words so many times, and so
does what would extend it. A word that a stretch holds less often therefore parts it, is in no run and extends none; runs are
looked for in what lies between such words.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridlark.llm.tables import BLANKS, slices, whole

#: Words and periods of a run at least.
WORDS, PERIODS = 24, 3
#: Turns in which stretches are parted at their rare words. More would only save work.
TURNS = 4


def next_smaller(text: list[int]) -> tuple[list[int], list[int]]:
    """For each position the next one whose suffix is smaller, and how many words the two suffixes share.

    ``text`` ends with a sentinel that is smaller than all else; it is next to what has no other.

    text[start:end] and text[start - shift:end - shift] is the matched stretch that reaches furthest. On the way down from a
    position to the previous one whose suffix is smaller, ``at`` words are shared by the last suffix and that of ``i``: where the
    last one and its own smaller one share more, or less, the next comparison's result is known.
    """
    n = len(text) - 1
    smaller, matched = [n] * n, [0] * n
    before, common = [-1] * n, [0] * n
    start = end = shift = 0
    for i in range(1, n):
        j, at = i - 1, 0
        while True:
            if i + at < end:  # as at the copy of i; comparisons that got to the end of the stretch go on there
                k, c = i - shift, j - shift if j >= start else j
                if before[k] == c:
                    at = min(common[k], end - i)
                elif smaller[c] == k:
                    at = min(matched[c], end - i)
            while text[j + at] == text[i + at]:
                at += 1
            if i + at > end:
                start, end, shift = i, i + at, i - j
            if text[j + at] < text[i + at]:
                before[i], common[i] = j, at
                break
            # j's suffix is larger; so are those of smaller ones that share more with it
            smaller[j], matched[j] = i, at
            most, j = common[j], before[j]
            while j >= 0 and most > at:
                smaller[j], matched[j] = i, at
                most, j = common[j], before[j]
            if j < 0:
                break
            if most < at:
                before[i], common[i] = j, most
                break
    return smaller, matched


def runs(text: list[int], words: int = WORDS, periods: int = PERIODS) -> list[tuple[int, int, int]]:
    """(start, length, period) of the runs of at least ``words`` words and ``periods`` periods (2 or more), by start and period.
    ``text``: the ranks of the words, from 0."""
    found: set[tuple[int, int, int]] = set()
    top = max(text, default=0)
    for ranks in ([*text, -1], [*(top - r for r in text), -1]):
        smaller, matched = next_smaller(ranks)
        right, at = np.array(matched, np.int64), np.arange(len(text))
        period = np.array(smaller, np.int64) - at
        # left of a run's first root lies less than a period
        roots = np.flatnonzero((right > (periods - 2) * period) & (2 * period + right > words))
        reach: dict[int, int] = {}
        for i, p, r in zip(roots.tolist(), period[roots].tolist(), right[roots].tolist(), strict=True):
            if i + p <= reach.get(p, 0):
                continue  # a later root of a run that is known
            first = i
            while first and ranks[first - 1] == ranks[first - 1 + p]:
                first -= 1
            last = reach[p] = i + p + r
            if last - first >= max(words, periods * p):
                found.add((first, last - first, p))
    return sorted(found, key=lambda r: (r[0], r[2]))


def stretches(ranks: np.ndarray, texts: np.ndarray, words: int, periods: int) -> list[tuple[int, int]]:
    """[first, last) of the stretches that may hold runs. ``texts``: the text of each word, ascending; ``ranks`` of the words."""
    at, part = np.arange(len(ranks)), texts
    for _ in range(TURNS):
        _, word, times = np.unique(part * (int(ranks.max(initial=0)) + 1) + ranks[at], return_inverse=True, return_counts=True)
        kept = times[word] >= periods
        before = len(at)
        at, part = at[kept], part[kept]
        new = np.ones(len(at), bool)
        new[1:] = (np.diff(at) > 1) | (np.diff(part) > 0)
        part = np.cumsum(new) - 1
        long = np.bincount(part, minlength=1)[part] >= words
        at, part = at[long], part[long]
        if len(at) == before or not len(at):
            break
    ends = np.flatnonzero(np.diff(part)) + 1
    return [(int(x[0]), int(x[-1]) + 1) for x in np.split(at, ends) if len(x)]


class Words:
    """The words of some texts, one after the other: ``flat``, and where each text's begin in ``offsets``."""

    def __init__(self, texts: pa.Array) -> None:
        split = pc.ascii_split_whitespace(texts.fill_null(""))
        self.flat = split.flatten()
        real = pc.greater(pc.binary_length(self.flat), 0)
        ends = np.concatenate([[0], np.cumsum(real.to_numpy(zero_copy_only=False))])
        self.offsets = ends[split.offsets.to_numpy() - split.offsets[0].as_py()]
        self.flat = self.flat.filter(real)

    def ranks(self) -> np.ndarray:
        """Each word's place among the distinct words in their order."""
        coded = self.flat.dictionary_encode()
        place = np.empty(len(coded.dictionary), np.int64)
        place[pc.array_sort_indices(coded.dictionary).to_numpy()] = np.arange(len(place))
        return place[coded.indices.to_numpy()]

    def joined(self, kept: np.ndarray | None = None) -> pa.Array:
        """The texts again, of the words that are ``kept``, joined by blanks."""
        flat, offsets = self.flat, self.offsets
        if kept is not None:
            flat, offsets = flat.filter(pa.array(kept)), np.concatenate([[0], np.cumsum(kept)])[offsets]
        return pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), flat), " ")


def found_runs(docs: DataFrame, words: int = WORDS, periods: int = PERIODS) -> DataFrame:
    """(doc_id, n_words, runs, collapsed) for each row of ``docs`` (doc_id, text, others).

    ``runs``: an array of (start, length, period) by start, then period, of the stretches of words with smallest period
    ``period`` that no neighbouring word extends and that have at least ``words`` words and ``periods`` periods (2 or more).
    ``collapsed``: the words that no run holds behind its first period, joined by blanks. Words lie between ASCII blanks and are
    compared as they are. Null, empty and blank texts have no words, no runs and collapse to the empty text. Ids may be null or
    repeated: each row comes out on its own. An empty table gives an empty result.
    """

    def find(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            made = Words(b.column(1))
            ranks, offsets = made.ranks(), made.offsets
            texts, kept = np.repeat(np.arange(b.num_rows), np.diff(offsets)), None
            found: list[list[tuple[int, int, int]]] = [[] for _ in range(b.num_rows)]
            for first, last in stretches(ranks, texts, words, periods):
                doc, own = texts[first], np.unique(ranks[first:last], return_inverse=True)[1]
                for start, length, period in runs(own.tolist(), words, periods):
                    kept = np.ones(len(ranks), bool) if kept is None else kept
                    kept[first + start + period : first + start + length] = False
                    found[doc].append((first + start - int(offsets[doc]), length, period))
            flat = [x for each in found for x in each]
            ends = pa.array(np.cumsum([0, *map(len, found)]), pa.int32())
            columns = [pa.ListArray.from_arrays(ends, pa.array([x[k] for x in flat], pa.int64())) for k in range(3)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.diff(offsets), pa.int64()), *columns, made.joined(kept)], names=["doc_id", "n_words", "start", "length", "period", "collapsed"])

    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(find, "doc_id long, n_words long, start array<long>, length array<long>, period array<long>, collapsed string")
    return out.select("doc_id", "n_words", F.arrays_zip("start", "length", "period").alias("runs"), "collapsed")


def with_period(docs: DataFrame, every: int = 10) -> DataFrame:
    """(doc_id, text) of ``docs``, with a period put into the texts whose id's crc32 is divisible by ``every``: from a word on
    that the rest of the hash chooses, the next few words are repeated to the end. Texts without words, and rows without an id,
    stay as they are."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g, text = F.floor(h / every), F.btrim(whole(), F.lit(BLANKS))
    split = F.transform(F.array(F.split(text, r"[\x20\x09-\x0D]+")), lambda w: F.struct(w.alias("w"), F.size(w).cast("long").alias("n")))
    split = F.transform(split, lambda s: F.struct(s["w"].alias("w"), s["n"].alias("n"), (g % s["n"]).alias("a")))
    split = F.transform(split, lambda s: F.struct(s["w"].alias("w"), s["n"].alias("n"), s["a"].alias("a"), (1 + F.floor((s["n"] - s["a"]) / (3 + g % 8))).alias("p")))
    word = lambda s, i: F.element_at(s["w"], (F.when(i < s["a"], i).otherwise(s["a"] + (i - s["a"]) % s["p"]) + 1).cast("int"))
    made = F.element_at(F.transform(split, lambda s: F.array_join(F.transform(F.sequence(F.lit(0).cast("long"), s["n"] - 1), lambda i: word(s, i)), " ")), 1)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.when((h % every == 0) & (text != ""), made).otherwise(F.col("text")).alias("text"))


def longest(found: Column) -> Column:
    """The run with the greatest length / period, the first of equals; null if there is none. Compared as whole numbers."""
    more = lambda a, b: a["length"] * b["period"] > b["length"] * a["period"]
    return F.when(F.size(found) > 0, F.aggregate(found, F.element_at(found, 1), lambda best, r: F.when(more(r, best), r).otherwise(best)))


def op11(docs: DataFrame) -> DataFrame:
    """(doc_id, n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256) of the texts with a period put into
    some of them. Without runs the four numbers are null, and ``runs_sha256`` is that of the empty text."""
    digest = lambda text: F.sha2(text.cast("binary"), 256)
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    rows = found_runs(with_period(docs)).withColumn("best", longest(F.col("runs")))
    return rows.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        "best.start",
        "best.length",
        "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        digest(F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise("")).alias("runs_sha256"),
        digest(F.col("collapsed")).alias("collapsed_sha256"),
    )
