"""Language-model scoring with Brown class-based n-grams.

A word's probability is that of its class after the class before, times that of the word in its class. Every word that the
training documents have at least ``LEAST`` times is assigned to a class by its own neighbours; rarer and unseen words share
the class of a bucket of word endings. The clustered vocabulary grows with the corpus:

1. Neighbouring words are counted block by block into a Spark table of pairs.
2. The commonest words and the buckets, a matrix of a fixed size, are assigned on the driver by exchange: a unit moves to the
   class that gains most mutual information between neighbouring classes, until a sweep moves few.
3. All other words start in the class of their ending and are moved in sweeps over the table of pairs. A sweep adds up each
   word's neighbours by class and puts it where they are likeliest, given the class table of the sweep before (Uszkoreit and
   Brants 2008 move words in parallel likewise). Sweeps end when the mutual information no longer rises; the best stays.

Of the vocabulary, nine bytes a clustered word (a 64-bit hash and its class; ``VOCABULARY`` words at most) are held on the driver
and in each task, the counts stay in Spark tables. Two clustered words would share a class unasked only if their hashes were equal.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridlark.llm.tables import crc_mod, fold, slices, written

#: Commonest words that all tasks get; words of the driver's exchange; buckets of endings; classes.
COMMON, HEADS, TAILS, CLASSES = 200_000, 512, 512, 64
#: Occurrences from which on a word is assigned by its own neighbours; sweeps over all words at most.
LEAST, SWEEPS = 3, 4
#: Words that are assigned by their own neighbours at most, which bounds what is sent to all tasks: the commonest of them.
VOCABULARY = 1 << 22
#: Nats a pair of neighbours by which a sweep must raise the mutual information for another to follow.
RISE = 0.02
#: The end of a text, as a token: no word can be a blank.
END = b"\n"
ENDING = 3
PRIOR = 0.5
#: Texts that a task scores at a time; tokens, and pairs, that it counts at a time; units whose neighbours are added up at a time.
ROWS, TOKENS, PAIRS, PART = 256, 400_000, 2_000_000, 1 << 14


def ending(word: bytes) -> int:
    """The bucket of a word's last letters."""
    last = word[-ENDING:] if word.isascii() else word.decode("utf-8", "surrogatepass")[-ENDING:].encode("utf-8", "surrogatepass")
    return zlib.crc32(last) % TAILS


def digests(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words)).view(np.int64)


def plogp(x):
    return x * np.log(np.maximum(x, 1))


def exchange(bigrams: np.ndarray, classes: int = CLASSES, sweeps: int = 10, fixed: int | None = None) -> np.ndarray:
    """Classes of the units of a count matrix of neighbours. ``fixed``: a unit that is a class of its own, the last one."""
    size, last = len(bigrams), classes - (fixed is not None)
    weight = bigrams.sum(1) + bigrams.sum(0)
    order = [u for u in np.argsort(-weight, kind="stable").tolist() if u != fixed]
    of = np.zeros(size, int)
    of[order] = np.arange(len(order)) % last
    if fixed is not None:
        of[fixed] = last
    member = np.zeros((size, classes))
    member[np.arange(size), of] = 1
    between = member.T @ bigrams @ member
    out_of, into = bigrams @ member, (bigrams.T @ member)  # neighbours after and before each unit, by class
    every = np.arange(last)
    for _ in range(sweeps):
        moved = 0
        for u in order:
            if not weight[u]:
                continue
            a, own = of[u], bigrams[u, u]
            after, before = out_of[u].copy(), into[u].copy()
            after[a] -= own
            before[a] -= own
            between[a, :] -= after
            between[:, a] -= before
            between[a, a] -= own
            rows, columns = between[:last], between[:, :last].T
            gain = (plogp(rows + after) - plogp(rows)).sum(1) + (plogp(columns + before) - plogp(columns)).sum(1)
            here = between[every, every]
            gain += plogp(here + after[:last] + before[:last] + own) - plogp(here + after[:last]) - plogp(here + before[:last]) + plogp(here)
            first, second = between.sum(1)[:last], between.sum(0)[:last]
            n1, n2 = after.sum() + own, before.sum() + own
            gain -= plogp(first + n1) - plogp(first) + plogp(second + n2) - plogp(second)
            b = int(np.argmax(gain))
            if gain[b] <= gain[a] + 1e-9:
                b = a
            between[b, :] += after
            between[:, b] += before
            between[b, b] += own
            if b != a:
                of[u], moved = b, moved + 1
                out_of[:, a] -= bigrams[:, u]
                out_of[:, b] += bigrams[:, u]
                into[:, a] -= bigrams[u, :]
                into[:, b] += bigrams[u, :]
        if moved <= len(order) // 200:
            break
    return of


class Units:
    """Numbers of words: the place of a clustered word's hash among the sorted ones, then the buckets of endings."""

    def __init__(self, hashes: np.ndarray) -> None:
        self.hashes = hashes

    def __len__(self) -> int:
        return len(self.hashes) + TAILS

    def of(self, words: list[bytes]) -> np.ndarray:
        hashes = digests(words)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        for i in np.flatnonzero(self.hashes[at] != hashes).tolist():
            at[i] = len(self.hashes) + ending(words[i])
        return at


class Model:
    """Classes of units, log10 probabilities of transitions, and denominators of words in their classes."""

    def __init__(self, units: Units, of: np.ndarray, between: np.ndarray, tokens: np.ndarray, types: np.ndarray) -> None:
        self.units, self.of = units, of
        self.step = np.log10((between + PRIOR) / (between.sum(1, keepdims=True) + PRIOR * len(between)))
        self.room = np.log10(tokens + PRIOR * (types + 1))
        self.end = len(between) - 1
        self.room[self.end] = 0.0  # the end is sure in its class
        self.first = self.end  # a text begins where another has ended

    def classes_of(self, words: list[bytes]) -> np.ndarray:
        return self.of[self.units.of(words)].astype(np.int64)

    def class_of(self, word: bytes) -> int:
        return int(self.classes_of([word])[0])


def word_counts(docs: DataFrame, most: int = 400_000) -> DataFrame:
    """(word, n) over ``docs`` (text), ends included. Tasks count in memory within bounds and Spark adds up."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()

        def out() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(seen.keys(), pa.binary()), pa.array(seen.values(), pa.int64())], names=["word", "n"])
            seen.clear()
            return batch

        for b in slices(batches):
            for words in map(fold, b.column(0).to_pylist()):
                seen.update(words)
                seen[END] += 1
                if len(seen) > most:
                    yield out()
        yield out()

    return docs.select("text").mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def sent_to_all(df: DataFrame, value):
    """``value``, of a bounded size, on all executors."""
    return df.sparkSession.sparkContext.broadcast(value)


def vocabulary(counts: DataFrame, least: int = LEAST, most: int = VOCABULARY) -> tuple[Units, np.ndarray]:
    """The units of ``counts``, and of each unit its row in the driver's exchange: a head's, or that of its ending. Words with
    ``least`` occurrences are units; where there are more than ``most`` of them, the rarest of these are in their endings' buckets."""
    word = F.col("word") != F.lit(bytearray(END))
    best = [bytes(r["word"]) for r in counts.filter(word).orderBy(F.desc("n"), "word").limit(HEADS - 1).collect()]
    heads = digests([*best, END])

    def hashed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words = b.column(0).to_pylist()
            yield pa.RecordBatch.from_arrays([pa.array(digests(words)), pa.array([ending(w) for w in words], pa.int32())], names=["hash", "ending"])

    rest = commonest(counts.filter(word & (F.col("n") >= least)), most).select("word").mapInArrow(hashed, "hash long, ending int").toArrow()
    hashes, at = np.unique(np.concatenate([heads, rest.column("hash").to_numpy()]), return_index=True)
    row = np.concatenate([np.arange(len(best)), [HEADS - 1], HEADS + rest.column("ending").to_numpy()])[at]
    return Units(hashes), np.concatenate([row, HEADS + np.arange(TAILS)]).astype(np.int32)


def packed(*columns: np.ndarray) -> bytes:
    """Arrays of 32-bit numbers, compressed byte by byte: Spark passes them on as one cell."""
    planes = np.stack([c.astype(np.int32) for c in columns]).view(np.uint8).reshape(len(columns), -1, 4).transpose(0, 2, 1)
    return pa.compress(np.ascontiguousarray(planes).data, codec="zstd", asbytes=True)


def unpacked(data: bytes, columns: int, rows: int) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(data, 4 * columns * rows, codec="zstd", asbytes=True), np.uint8).reshape(columns, 4, rows)
    return np.ascontiguousarray(planes.transpose(0, 2, 1)).view(np.int32)[..., 0].astype(np.int64)


def unit_pairs(docs: DataFrame, units: Units) -> DataFrame:
    """Neighbouring units of ``docs`` and their counts, packed block by block; the end is before the first word and after the last."""
    sent = sent_to_all(docs, units)

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units, known, stream = sent.value, {}, [END]

        def out() -> pa.RecordBatch:
            if len(known) > TOKENS:
                known.clear()
            new = list(set(stream).difference(known))
            known.update(zip(new, units.of(new).tolist(), strict=True))
            u = np.fromiter(map(known.__getitem__, stream), np.int64, len(stream))
            pair, n = np.unique(u[:-1] * len(units) + u[1:], return_counts=True)
            del stream[1:]
            data = packed(np.diff(pair // len(units), prepend=0), pair % len(units), n)
            return pa.RecordBatch.from_arrays([pa.array([len(n)]), pa.array([data], pa.binary())], names=["rows", "data"])

        for b in batches:
            for start in range(0, b.num_rows, ROWS):
                for words in map(fold, b.column(0).slice(start, ROWS).to_pylist()):
                    stream += words
                    stream.append(END)
                    if len(stream) > TOKENS:
                        yield out()
        if len(stream) > 1:
            yield out()

    return docs.select("text").mapInArrow(count, "rows long, data binary")


def _blocks(batches: Iterable[pa.RecordBatch], most: int) -> Iterator[np.ndarray]:
    """(a, b, n) of many packed blocks together, about ``most`` pairs."""
    held, rows = [], 0
    for batch in batches:
        for size, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            block = unpacked(data.as_py(), 3, size)
            block[0] = np.cumsum(block[0])
            held.append(block)
            rows += size
            if rows >= most:
                yield np.concatenate(held, axis=1)
                held, rows = [], 0
    if held:
        yield np.concatenate(held, axis=1)


def group_bigrams(pairs: DataFrame, group: np.ndarray, size: int) -> np.ndarray:
    """Counts of neighbouring groups of units, ``size`` by ``size``."""
    sent = sent_to_all(pairs, group)

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, group = np.zeros(size * size), sent.value
        for a, b, n in _blocks(batches, 1):
            total += np.bincount(group[a].astype(np.int64) * size + group[b], n, size * size)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at].astype(np.int64))], names=["pair", "n"])

    found = pairs.mapInArrow(count, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(size * size)
    out[found.column("pair").to_numpy()] = found.column("n").to_numpy()
    return out.reshape(size, size)


def neighbours(pairs: DataFrame, of: np.ndarray, moving: np.ndarray, classes: int) -> DataFrame:
    """(part, rows, data): for the units of a part that may move, how often each class comes after them (slot: the class) and
    before them (slot: ``classes`` more), packed as (unit, slot, count). A part has several rows, which add up."""
    sent = sent_to_all(pairs, (of, moving))

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, moving = sent.value
        for a, b, n in _blocks(batches, PAIRS):
            left, right = moving[a], moving[b]
            key = np.concatenate([a[left] * 2 * classes + of[b[left]], b[right] * 2 * classes + classes + of[a[right]]])
            key, at = np.unique(key, return_inverse=True)
            n = np.bincount(at, np.concatenate([n[left], n[right]]), len(key))
            unit, slot = key // (2 * classes), key % (2 * classes)
            edges = np.append(np.flatnonzero(np.diff(unit // PART, prepend=-1)), len(unit)).tolist()
            for i, j in zip(edges, edges[1:], strict=False):
                data = packed(np.diff(unit[i:j] % PART, prepend=0), slot[i:j], n[i:j])
                yield pa.RecordBatch.from_arrays([pa.array([int(unit[i]) // PART]), pa.array([j - i]), pa.array([data], pa.binary())], names=["part", "rows", "data"])

    return pairs.mapInArrow(count, "part long, rows long, data binary")


def best_classes(found: DataFrame, between: np.ndarray) -> pa.Table:
    """(unit, of): the class, other than the last, in which the unit's neighbours are likeliest by the class table ``between``."""
    classes = len(between)
    total = between + PRIOR
    link = np.log(total) - np.log(total.sum(1, keepdims=True)) - np.log(total.sum(0, keepdims=True))
    sent = sent_to_all(found, np.vstack([link.T, link])[:, : classes - 1])  # a row for each slot, a column for each class

    def choose(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain, part, total = sent.value, None, np.zeros(PART * 2 * classes)

        def out() -> pa.RecordBatch:
            matrix = total.reshape(PART, -1)
            unit = np.flatnonzero(matrix.any(1))
            of = (matrix[unit] @ gain).argmax(1)
            total[:] = 0
            return pa.RecordBatch.from_arrays([pa.array((part * PART + unit).astype(np.int32)), pa.array(of.astype(np.int32))], names=["unit", "of"])

        for batch in batches:  # in order of parts; one may go on in the next batch
            for p, size, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                if part is not None and p != part:
                    yield out()
                part = p
                unit, slot, n = unpacked(data.as_py(), 3, size)
                total[np.cumsum(unit) * 2 * classes + slot] += n  # a row has no unit and slot twice
        if part is not None:
            yield out()

    return found.repartition("part").sortWithinPartitions("part").mapInArrow(choose, "unit int, of int").toArrow()


def information(between: np.ndarray) -> float:
    """Mutual information of neighbouring classes, times the number of neighbours, less a constant."""
    return float(plogp(between).sum() - plogp(between.sum(1)).sum() - plogp(between.sum(0)).sum())


def assigned(pairs: DataFrame, row: np.ndarray, classes: int, sweeps: int = SWEEPS) -> tuple[np.ndarray, np.ndarray]:
    """Classes of all units, and the counts of neighbouring classes. ``row``: of each unit its row in the driver's exchange."""
    of = exchange(group_bigrams(pairs, row, HEADS + TAILS), classes, fixed=HEADS - 1)[row].astype(np.uint8)
    between = group_bigrams(pairs, of, classes)
    moving = row >= HEADS
    moving[len(row) - TAILS :] = False
    if not moving.any():
        return of, between
    for _ in range(sweeps):
        found, other = best_classes(neighbours(pairs, of, moving, classes), between), of.copy()
        other[found.column("unit").to_numpy()] = found.column("of").to_numpy()
        after = group_bigrams(pairs, other, classes)
        rise = information(after) - information(between)
        if rise > 0:
            of, between = other, after
        if rise <= RISE * between.sum():
            break
    return of, between


def class_totals(counts: DataFrame, units: Units, of: np.ndarray, classes: int) -> tuple[np.ndarray, np.ndarray]:
    """Tokens and distinct words of each class."""
    sent = sent_to_all(counts, (units, of))

    def add(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units, of = sent.value
        tokens, types = np.zeros(classes, np.int64), np.zeros(classes, np.int64)
        for b in batches:
            at = of[units.of(b.column(0).to_pylist())]
            np.add.at(tokens, at, b.column(1).to_numpy())
            np.add.at(types, at, 1)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(classes)), pa.array(tokens), pa.array(types)], names=["of", "tokens", "types"])

    found = counts.mapInArrow(add, "of long, tokens long, types long").groupBy("of").agg(F.sum("tokens").alias("tokens"), F.sum("types").alias("types")).toArrow()
    tokens, types = np.zeros(classes), np.zeros(classes)
    tokens[found.column("of").to_numpy()], types[found.column("of").to_numpy()] = found.column("tokens").to_numpy(), found.column("types").to_numpy()
    return tokens, types


def commonest(counts: DataFrame, most: int) -> DataFrame:
    """The end, and of the other words those of the highest counts, ``most`` or fewer: counts fall into classes of an eighth of
    a power of two, and as many classes are taken as have room. Nothing is sorted."""
    of = F.floor(8 * F.log2("n"))
    left, least = most, 1 << 62
    for r in sorted(counts.groupBy(of.alias("of")).count().collect(), reverse=True):  # at most 505 rows
        left -= r["count"]
        if left < 0:
            break
        least = r["of"]
    return counts.filter((of >= least) | (F.col("word") == F.lit(bytearray(END))))


def learn(docs: DataFrame, counts: DataFrame, classes: int = CLASSES) -> Model:
    """The model of ``docs``, given their word counts."""
    units, row = vocabulary(counts)
    of, between = assigned(written(unit_pairs(docs, units), "lm-pairs"), row, classes)
    return Model(units, of, between, *class_totals(counts, units, of, classes))


def scored(docs: DataFrame, train: DataFrame, common: int = COMMON, classes: int = CLASSES) -> DataFrame:
    """``docs`` (doc_id, text, others) scored by a model of ``train`` (text).

    Returns doc_id, n_tokens, n_known, train_tokens, base_score and score, a row for each row. A null or empty text is one
    end. Repeated rows are scored each, null ids are kept. Without training texts the base score is 0. An empty table gives
    an empty result.
    """
    counts = written(word_counts(train), "lm-words")
    total, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    model = learn(train, counts, classes)
    top = commonest(counts, common).toArrow()
    words = {w: i for i, w in enumerate(top.column("word").to_pylist())}
    n = top.column("n").to_numpy()
    sent = sent_to_all(docs, (words, model.classes_of(list(words)), np.log10(n + PRIOR), model))

    def score(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, class_of, log_n, model = sent.value
        number = TaskContext.get().partitionId() << 33
        missing = math.log10(PRIOR)
        end = known.get(END, -1)
        for b in (whole.slice(start, ROWS) for whole in batches for start in range(0, whole.num_rows, ROWS)):
            out: list[tuple] = []
            for tokens in map(fold, b.column(1).to_pylist()):
                at = np.fromiter((known.get(w, -1) for w in tokens), np.int64, len(tokens))
                at = np.append(at, end)
                far = np.flatnonzero(at[:-1] < 0).tolist()
                chain = class_of[at] if len(class_of) else np.zeros(len(at), np.int64)
                if far:
                    chain[far] = model.classes_of([tokens[i] for i in far])
                chain[-1] = model.end
                near = at[at >= 0]
                own = float(log_n[near].sum()) + (missing if end < 0 else 0.0)
                links = float(model.step[np.append(model.first, chain[:-1]), chain].sum() - model.room[chain].sum())
                if end >= 0:
                    links -= float(log_n[end])  # the end is sure in its class
                else:
                    links -= missing
                rare = Counter([tokens[i] for i in far])
                out.append((number, len(at), len(near), own, links, list(rare.items())))
                number += 1
            names = ["row", "n_tokens", "n_near", "own", "links", "rare"]
            types = [pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.map_(pa.binary(), pa.int64())]
            columns = zip(*out, strict=True) if out else [()] * len(names)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], names=["doc_id", *names])

    schema = "doc_id long, row long, n_tokens long, n_near long, own double, links double, rare map<binary, long>"
    rows = written(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(score, schema), "lm-rows")
    rare = rows.select("row", F.explode("rare").alias("word", "times")).join(counts, "word", "left")
    rare = rare.groupBy("row").agg(
        F.sum(F.col("times") * F.log10(F.coalesce("n", F.lit(0)) + PRIOR)).alias("far"), F.sum(F.when(F.col("n").isNotNull(), F.col("times")).otherwise(0)).alias("n_far")
    )
    own = F.col("own") + F.coalesce("far", F.lit(0.0))
    return rows.join(rare, "row", "left").select(
        "doc_id",
        "n_tokens",
        (F.col("n_near") + F.coalesce("n_far", F.lit(0))).alias("n_known"),
        F.lit(int(total)).cast("long").alias("train_tokens"),
        (own - F.col("n_tokens") * math.log10(total + PRIOR * (distinct + 1))).alias("base_score"),
        (own + F.col("links")).alias("score"),
    )


def op9(docs: DataFrame) -> DataFrame:
    """All of ``docs`` scored by a model of those whose crc32(doc_id) mod 5 is not 1; see ``scored``. A null id isn't held out."""
    held = crc_mod("doc_id", 5) == 1
    out = scored(docs, docs.filter(F.coalesce(~held, F.lit(True))))
    return out.select("doc_id", held.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
