"""Mixing sources to target weights by Efraimidis-Spirakis sampling, in DataFrame operations only.

Every source gets a share of the budget. A document's order in its source is an exponential key, ``-ln(u) / weight``, with
``u`` hashed from its id: sorting by it draws without replacement with probabilities by weight. Whole epochs of the source
come first; the rest of the target is the part of one more epoch that lies within the budget along that order.

No source is sorted in one task: keys fall into ranges, the sizes of a range are added up first, and only the one range per
source in which the budget ends is sorted and prefix-summed.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridlark.llm.tables import WORD_PATTERN, crc_mod, fresh, keyed, whole, written

#: Signs whose share of a text lowers its weight in the draw, where no labels teach a weight.
MARKS = "!#$%&*|"
#: The least weight: every document has a chance. What a learned weight is at least.
LIGHTEST, LEARNED = 1e-6, 0.01
#: Bins of a feature of a text's shape.
BINS = 24


def quality_weight(text):
    """The weight of a document that comes with none, in [0.1, 1]: falls with the share of marks in the text. The empty text
    weighs 1. It is a rough one: give ``mix`` labels, or a column such as a classifier's score."""
    n = F.length(text)
    marks = n - F.length(F.translate(text, MARKS, ""))
    return F.when(n == 0, 1.0).otherwise(F.greatest(F.lit(0.1), 1.0 - 5.0 * marks / n))


def shapes(text: Column, size: Column) -> Column:
    """An array of the bins, from 0 to BINS - 1, of features of a text of ``size`` words: the shares of marks, capitals, words of
    one sign and repeated lines, on a scale of octaves, the length of words, and the number of words."""
    n, lines = F.greatest(F.length(text), F.lit(1)), F.split(text, "\n")
    share = lambda x: F.when(x > 0, F.greatest(F.lit(1), 13 + F.floor(F.log2(x)))).otherwise(F.lit(0))
    count = lambda pattern: F.regexp_count(text, F.lit(pattern))
    found = [
        share(count(r"[!#$%&*|<>{}\[\]^~=+_/\\@]") / n),
        share(count(r"[A-Z]") / n),
        share(count(r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0DA-Za-z0-9](?![^\x20\x09-\x0D])") / F.greatest(size, F.lit(1))),
        share(1 - F.size(F.array_distinct(lines)) / F.size(lines)),
        F.floor(n / F.greatest(size, F.lit(1))),
        F.floor(F.log2(size + 1)),
    ]
    return F.array(*[F.greatest(F.lit(0), F.least(F.lit(BINS - 1), x.cast("int"))) for x in found])


def learned_weight(shaped: DataFrame, labels: DataFrame, column: str = "shape") -> Column:
    """A weight in [LEARNED, 1] over ``column`` of ``shaped`` (doc_id, ``column``): how likely ``labels`` (doc_id, quality) make a
    text of such a shape good. Each bin of each feature has a log of odds, counted over the labelled rows whose crc32(doc_id) mod
    5 isn't 0; a text's are added up. A table of the features times the bins reaches the driver, whatever the rows."""
    graded = labels.filter((crc_mod("doc_id", 5) != 0) & F.col("quality").isNotNull()).select("doc_id", "quality")
    bins = shaped.select("doc_id", column).join(graded, "doc_id").select("quality", F.posexplode(column).alias("feature", "bin"))
    good, bad = (F.count_if(F.col("quality") == q) for q in (1, 0))
    rows = bins.groupBy("feature", "bin").agg(good.alias("good"), bad.alias("bad")).collect()
    of = {(r["feature"], r["bin"]): (r["good"], r["bad"]) for r in rows}
    goods, bads = (sum(x[k] for (f, _), x in of.items() if f == 0) for k in (0, 1))
    start, total = math.log((goods + 1) / (bads + 1)), F.lit(0.0)
    for f in range(1 + max((f for f, _ in of), default=-1)):
        odds = [math.log((g + 1) / (goods + BINS)) - math.log((b + 1) / (bads + BINS)) for g, b in (of.get((f, k), (0, 0)) for k in range(BINS))]
        total = total + F.element_at(F.lit(odds), F.col(column)[f] + 1)
    return F.greatest(F.lit(LEARNED), 1 / (1 + F.exp(-(total + start))))


def sized(docs: DataFrame, seed: int = 17, buckets: int = 4096, keep: Sequence[str] = (), weight: Column | None = None, labels: DataFrame | None = None) -> DataFrame:
    """(doc_id, source, size, key, bucket) of each row, and the columns ``keep``; ``bucket`` is monotone in ``key``.

    Buckets are parts of octaves of the key, ``buckets`` for 64 octaves, so they are as fine for small weights as for large
    ones: with 4096 of them and equal weights none has more than half a percent of the rows.
    """
    t, u = whole(), (F.pmod(F.xxhash64(F.lit(seed), F.col("doc_id")), F.lit(1 << 53)) + 0.5) / float(1 << 53)
    size = F.regexp_count(t, F.lit(WORD_PATTERN)).cast("long")
    key = lambda heavy: F.greatest(-F.log(u) / heavy, F.lit(1e-300)).alias("key")
    if weight is None and labels is not None:
        rows = written(docs.select("doc_id", "source", size.alias("size"), shapes(t, size).alias("shape"), *keep), "mix-shapes")
        rows = rows.select("doc_id", "source", "size", key(learned_weight(rows, labels)), *keep)
    else:
        heavy = quality_weight(t) if weight is None else F.greatest(F.coalesce(weight.cast("double"), F.lit(0.0)), F.lit(LIGHTEST))
        rows = docs.select("doc_id", "source", size.alias("size"), key(heavy), *keep)
    return rows.withColumn("bucket", F.floor(F.log2("key") * (buckets / 64)).cast("int"))


def targets(sources: DataFrame, weights: Sequence[float], factor: float, max_epochs: float) -> DataFrame:
    """(source, source_size, target) from (source, source_size): the budget is dealt by weight and capped by water-filling.

    One row per source, so its windows hold as many rows as there are sources.
    """
    every = Window.partitionBy(F.lit(0))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.row_number().over(every.orderBy(F.col("source").asc_nulls_last())) - 1, F.lit(len(weights))) + 1).cast("int"))
    cap = max_epochs * F.col("source_size")
    by_fill = every.orderBy("fill", F.col("source").asc_nulls_last())
    before, onward = by_fill.rowsBetween(Window.unboundedPreceding, -1), by_fill.rowsBetween(0, Window.unboundedFollowing)
    whole_table = by_fill.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (factor * F.sum("source_size").over(every) - F.coalesce(F.sum(cap).over(before), F.lit(0.0))) / F.sum("weight").over(onward)
    return (
        sources.withColumn("weight", weight)
        .withColumn("fill", cap / F.col("weight"))
        .withColumn("level", level)
        # the first source, in order of filling up, that the level leaves room in
        .withColumn("level", F.coalesce(F.first(F.when(F.col("level") <= F.col("fill"), F.col("level")), ignorenulls=True).over(whole_table), F.max("fill").over(every)))
        .select("source", "source_size", F.least(cap, F.col("level") * F.col("weight")).cast("double").alias("target"))
    )


def mix(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), factor: float = 1.5, max_epochs: float = 2.0, seed: int = 17, buckets: int = 4096, keep: Sequence[str] = (), weight: Column | None = None, labels: DataFrame | None = None) -> DataFrame:
    """Words that a mix of ``docs`` (doc_id, source, text) takes of each row.

    Sources in order of code point, null last, weigh ``weights`` in turn. Their targets share ``factor`` times all words,
    none above ``max_epochs`` times its source. Returns doc_id, source, size, source_size, target, taken, one row for each
    row of ``docs``, and the columns ``keep`` with it; ``taken`` counts repeats, and the document at which the budget ends is taken in part, so that a
    source's words meet its target to less than one word. ``weight``: a document's weight in the draw, over the columns of
    ``docs``; null and what is below ``LIGHTEST`` weigh that. ``labels`` (doc_id, quality): the weight is learned from them, see
    ``learned_weight``. By default ``quality_weight`` of the text.

    Null and empty texts have size 0 and are never taken. A null source is a source. Equal keys (repeated ids) are ordered
    by id, then size; repeated rows share a key and are counted one after the other. An empty table gives an empty result.
    """
    rows = written(sized(docs, seed, buckets, keep, weight, labels), "mix-sizes")
    per_bucket = rows.groupBy("source", "bucket").agg(F.sum("size").alias("bucket_size"))
    per_bucket = written(per_bucket, "mix-buckets")
    goal = targets(per_bucket.groupBy("source").agg(F.sum("bucket_size").alias("source_size")), weights, factor, max_epochs)
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    goal = goal.withColumn("epochs", epochs.cast("long")).withColumn("rest", F.round(F.col("target") - F.col("epochs") * F.col("source_size")).cast("long"))
    same = lambda a, b: a["source"].eqNullSafe(b["source"])
    placed = per_bucket.withColumn("before", F.sum("bucket_size").over(Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)))
    placed = placed.join(goal, same(placed, goal)).select(
        placed["source"].alias("s"), placed["bucket"].alias("b"), "bucket_size", F.coalesce("before", F.lit(0)).alias("before"), "source_size", "target", "epochs", "rest"
    )
    joined = rows.join(placed, rows["source"].eqNullSafe(placed["s"]) & (rows["bucket"] == placed["b"])).drop("s", "b")
    room = F.col("rest") - F.col("before")
    cut = (room > 0) & (room < F.col("bucket_size"))
    outside = joined.filter(~cut).withColumn("part", F.when(room >= F.col("bucket_size"), F.col("size")).otherwise(F.lit(0)))
    ordered = Window.partitionBy("source", "bucket").orderBy("key", "doc_id", "size", *keep).rowsBetween(Window.unboundedPreceding, -1)
    inside = joined.filter(cut).withColumn("part", F.greatest(F.lit(0), F.least(F.col("size"), room - F.coalesce(F.sum("size").over(ordered), F.lit(0)))))
    taken = (F.col("epochs") * F.col("size") + F.col("part")).cast("long").alias("taken")
    return outside.unionByName(inside).select("doc_id", "source", "size", "source_size", "target", taken, *keep)


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` as often as the mix takes them (``taken / size``, rounded half up); rows not taken go.

    Each row by what was taken of it, also where ids are null or repeated. All columns come out as they are, whatever their
    names.
    """
    made = keyed(docs, "mix-rows")
    rows, key = (docs, "doc_id") if made is None else made
    name, copies, copy = (fresh(n, rows) for n in ("_id", "_copies", "_copy"))
    wanted = mix(rows, keep=() if key == "doc_id" else (key,), **options).filter("taken > 0")
    wanted = wanted.select(F.col(key).alias(name), F.floor(F.col("taken") / F.col("size") + 0.5).cast("int").alias(copies))
    kept = rows.join(wanted.filter(F.col(copies) > 0), F.col(key) == F.col(name))
    return kept.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(copies)))).select([F.col(f"`{c}`") for c in docs.columns])
