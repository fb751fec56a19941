"""Document fingerprints: bottom-k sketches of shingle hashes, in DataFrame operations only.

A sketch is the sorted array of the ``k`` smallest distinct 48-bit hashes of a text's shingles. The sketch of a union is the
``k`` smallest of two sketches together, so parts merge; resemblance, containment and the distinct count follow from it.

Each document's next one is found in ranges of ids of about equally many bytes of text, cut where the running total of a table
of ids and sizes says so. A range is small, whatever the table, and its own task's.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridlark.functions.order import running
from gridlark.llm.tables import BLANKS, table, whole

#: Bytes of text in a range at least, and ranges at most: their first ids are literals of the plan.
LEAST_BYTES, RANGES = 2 << 20, 1 << 14
#: Hashes are in [0, 2**BITS).
BITS = 48


def shingle_hashes(text: Column, words: int = 5) -> Column:
    """Hashes of the text's word shingles, lower-cased; a shorter text is one shingle, a text without words has none."""
    folded = F.btrim(F.lower(text), F.lit(BLANKS))
    hashed = F.transform(F.split(folded, r"[\x20\x09-\x0D]+"), lambda w: F.xxhash64(w))
    many = lambda h: F.transform(F.sequence(F.lit(1), F.size(h) - (words - 1)), lambda i: F.shiftrightunsigned(F.xxhash64(F.slice(h, i, words)), 64 - BITS))
    # an array of one element carries the word hashes into the next lambda, so that they are made once
    made = F.transform(F.array(hashed), lambda h: F.when(F.size(h) >= words, many(h)).otherwise(F.transform(F.array(F.xxhash64(h)), lambda x: F.shiftrightunsigned(x, 64 - BITS))))
    return F.when(folded == "", F.array().cast("array<bigint>")).otherwise(F.element_at(made, 1))


def sketch(text: Column, k: int = 256, words: int = 5) -> Column:
    return bottom(shingle_hashes(text, words), k)


def bottom(hashes: Column, k: int) -> Column:
    return F.slice(F.sort_array(F.array_distinct(hashes)), 1, k)


def merged(a: Column, b: Column, k: int = 256) -> Column:
    """The sketch of two parts' union."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def resemblance(a: Column, b: Column, k: int = 256) -> Column:
    """Estimated Jaccard likeness, 0 to 1: the share of the union's sketch that lies in both. Two empty sketches: 1."""
    union = merged(a, b, k)
    share = F.size(F.array_intersect(union, F.array_intersect(a, b))) / F.size(union)
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(share)


def distinct_count(s: Column, k: int = 256) -> Column:
    """Estimated number of distinct shingles; exact below ``k``."""
    return F.when(F.size(s) < k, F.size(s).cast("double")).otherwise((k - 1) * float(1 << BITS) / (F.element_at(s, -1) + 1))


def containment(a: Column, b: Column, k: int = 256) -> Column:
    """Estimated share of a's shingles that b has too: resemblance times the union's count, over a's count."""
    share = resemblance(a, b, k) * distinct_count(merged(a, b, k), k) / distinct_count(a, k)
    return F.when(F.size(a) == 0, 1.0).otherwise(F.least(F.lit(1.0), share))


def encoded(s: Column) -> Column:
    """The sketch as a string: base64 of its 6-byte hashes in ascending order."""
    return F.regexp_replace(F.base64(F.unhex(F.array_join(F.transform(s, lambda h: F.lpad(F.hex(h), BITS // 4, "0")), ""))), r"\s", "")


def fingerprints(docs: DataFrame, k: int = 256, words: int = 5) -> DataFrame:
    """``docs`` with ``sketch``, ``n_shingles`` (estimate) and ``fingerprint``, which replace columns of these names. Null text:
    as empty."""
    return docs.withColumn("sketch", sketch(whole(), k, words)).withColumn("n_shingles", distinct_count(F.col("sketch"), k)).withColumn("fingerprint", encoded(F.col("sketch")))


def heads(docs: DataFrame) -> list[tuple[int, int]]:
    """(key, tie) of the first row of each range of ``docs`` (key, tie, text): at most ``RANGES`` of them reach the driver."""
    sizes = docs.select("key", "tie", (F.octet_length(whole()) + 64).alias("size"))
    total = sizes.agg(F.sum("size")).first()[0] or 0
    each = max(LEAST_BYTES, total // RANGES + 1)
    if total <= each:
        first = sizes.agg(F.min(F.struct("key", "tie")).alias("head")).filter("head is not null")
    else:
        before = running(sizes, [F.col("key"), F.col("tie")], F.col("size"), "before")
        first = before.groupBy(F.floor(F.col("before") / each)).agg(F.min(F.struct("key", "tie")).alias("head"))
    return sorted({tuple(r["head"]) for r in first.collect()})


def with_next(docs: DataFrame, carry: str = "text") -> DataFrame:
    """(doc_id, text, key, tie, range, ghost, next): each row's following text in descending doc_id, the first after the last.

    Rows of one id are ordered by a hash of their text. The first row of a range is also the last of the range before, as a
    ``ghost``, so a range is a window of its own. Rows that are equal in id and text are in one range.
    """
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"), carry)
    ids = ids.withColumn("key", F.coalesce(F.bitwise_not("doc_id"), F.lit((1 << 63) - 1))).withColumn("tie", F.xxhash64(whole()))
    found = heads(ids) or [(0, 0)]
    size = 1 << len(found).bit_length()
    padded = found[1:] + [((1 << 63) - 1, (1 << 63) - 1)] * (size - len(found))
    long = lambda values: F.from_json(F.lit(str(list(values))), "array<bigint>")
    keys, ties = long(k for k, _ in padded), long(t for _, t in padded)
    jumps = F.array(*[F.lit(size >> (i + 1)) for i in range(size.bit_length() - 1)])
    at_or_after = lambda i: (F.col("key") > F.element_at(keys, i)) | ((F.col("key") == F.element_at(keys, i)) & (F.col("tie") >= F.element_at(ties, i)))
    rows = ids.withColumn("_at", F.aggregate(jumps, F.lit(0), lambda at, jump: F.when(at_or_after(at + jump), at + jump).otherwise(at)))
    is_head = (F.col("key") == F.element_at(long(k for k, _ in found), F.col("_at") + 1)) & (F.col("tie") == F.element_at(long(t for _, t in found), F.col("_at") + 1))
    place = lambda at, ghost: F.struct(at.alias("range"), F.lit(ghost).alias("ghost"))
    own, ghost = place(F.col("_at"), False), place(F.pmod(F.col("_at") - 1, F.lit(len(found))), True)
    rows = rows.withColumn("_place", F.explode(F.when(is_head, F.array(own, ghost)).otherwise(F.array(own))))
    rows = rows.select("doc_id", carry, "key", "tie", "_place.range", "_place.ghost").repartition(len(found), "range")
    return rows.withColumn("next", F.lead(F.coalesce(carry, F.lit(""))).over(in_order()))


def in_order() -> Window:
    return Window.partitionBy("range").orderBy("ghost", "key", "tie")


def op5(docs: DataFrame, k: int = 256, words: int = 5) -> DataFrame:
    """Fingerprints of each text and of its edited text, in which the next document's head replaces the last third.

    Null texts are empty texts: their sketch is empty, alike to another empty one (1) and to nothing else (0). A table of
    one row follows itself. Repeated rows follow each other. An empty table gives an empty result.
    """
    rows = with_next(docs)
    text, n = whole(), F.length(whole())
    third = F.floor(n / 3).cast("int")
    rows = rows.withColumn("edited", F.concat(F.substring(text, F.lit(1), n - third), F.substring(F.col("next"), F.lit(1), third)))
    rows = rows.withColumn("sketch", sketch(text, k, words))
    rows = rows.withColumn("next_sketch", F.lead("sketch").over(in_order())).filter(~F.col("ghost"))
    rows = rows.withColumn("edited_sketch", sketch(F.col("edited"), k, words))
    return rows.select(
        "doc_id",
        n.cast("long").alias("n_chars"),
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        encoded(F.col("sketch")).alias("fingerprint"),
        encoded(F.col("edited_sketch")).alias("edited_fingerprint"),
        resemblance(F.col("sketch"), F.col("edited_sketch"), k).alias("near_edited"),
        resemblance(F.col("sketch"), F.col("next_sketch"), k).alias("near_next"),
        distinct_count(F.col("sketch"), k).alias("n_shingles"),
    )


def query(spark, sf_dir):
    return op5(table(spark, sf_dir, "documents"))
