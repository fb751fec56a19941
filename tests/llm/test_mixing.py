import math
import random
import re

from pyspark.sql import functions as F

from gridlark.llm import mixing

DOCS = "doc_id long, source string, text string, size string"
WORD = re.compile("[^\x20\x09-\x0d]+")


def water_fill(sizes, weights, factor=1.5, cap=2.0):
    """Deal the budget by weight, stop the full ones, deal the excess again, until none is above."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    got, free, left = dict.fromkeys(order, 0.0), set(order), factor * sum(sizes.values())
    while left > 1e-9 and free:
        total = sum(w[s] for s in free)
        for s in free:
            got[s] += left * w[s] / total
        left = sum(max(0.0, got[s] - cap * sizes[s]) for s in free)
        for s in list(free):
            if got[s] >= cap * sizes[s]:
                got[s] = cap * sizes[s]
                free.remove(s)
    return got


def rows():
    out = []
    for i in range(400):
        source = [None, "a", "b", "é", "c"][0 if i % 50 == 0 else 1 + (i % 3 and 2) if i % 4 else 3 + i % 2]
        out.append((i, source, " ".join(["w"] * (i * 7 % 90)) + "\t!" * (i % 3), "x"))
    return out + [(900, "a", None, "x"), (901, "a", "", "x"), (902, "z", "", None), (10, "b", "again here", "x"), (10, "b", "again here", "x"), (None, "b", "no id", "x"), (903, "b", "long " * 40_000, "x")]


def test_targets_and_taken(spark):
    data = rows()
    got = mixing.mix(spark.createDataFrame(data, DOCS), buckets=16).collect()
    assert len(got) == len(data)
    sizes = {}
    for _, s, t, _ in data:
        sizes[s] = sizes.get(s, 0) + len(WORD.findall(t or ""))
    goal = water_fill(sizes, (5, 2, 1))
    taken = dict.fromkeys(sizes, 0)
    for r in got:
        assert r.source_size == sizes[r.source] and math.isclose(r.target, goal[r.source], rel_tol=1e-9, abs_tol=1e-6)
        assert 0 <= r.taken <= 2 * r["size"]
        taken[r.source] += r.taken
    assert all(abs(taken[s] - goal[s]) <= 1 for s in sizes)
    assert sorted(map(tuple, got), key=repr) == sorted(map(tuple, mixing.mix(spark.createDataFrame(data[::-1], DOCS), buckets=16).collect()), key=repr)


def test_draw_follows_keys(spark):
    """With one epoch and a part, exactly the smallest keys are taken."""
    data = [(i, s, "word " * (1 + i % 5), "") for i in range(300) for s in ["ab"[i % 2]]]
    df = spark.createDataFrame(data, DOCS)
    keys = {r.doc_id: r.key for r in mixing.sized(df).collect()}
    for s in "ab":
        got = sorted((keys[r.doc_id], r["size"], r.taken, r.source_size, r.target) for r in mixing.mix(df, buckets=8).collect() if r.source == s)
        epochs, left = int(got[0][4] // got[0][3]), round(got[0][4] - got[0][4] // got[0][3] * got[0][3])
        for _, size, took, _, _ in got:
            part = min(size, max(0, left))
            assert took == epochs * size + part
            left -= part


def test_empty_table_and_marks(spark):
    empty = spark.createDataFrame([], DOCS)
    assert mixing.mix(empty).collect() == []
    assert mixing.mixed_documents(empty).collect() == []
    clean, marked = (spark.range(1).select(mixing.quality_weight(mixing.F.lit(t))).first()[0] for t in ("plain words", "a*** b$$$"))
    assert clean == 1.0 and marked < 0.2


def test_documents_come_as_often_as_taken(spark):
    data = [(i, "ab"[i % 2], "word " * (1 + i % 5), "k") for i in range(60)]
    df = spark.createDataFrame(data, DOCS)
    got = mixing.mixed_documents(df)
    assert got.columns == df.columns
    want = {r.doc_id: int(r.taken / r["size"] + 0.5) for r in mixing.mix(df).collect()}
    have = {}
    for r in got.collect():
        have[r.doc_id] = have.get(r.doc_id, 0) + 1
    assert have == {k: v for k, v in want.items() if v}


def test_a_weight_column(spark):
    """Heavy documents come first where a source isn't taken whole; null, negative and zero weights are the lightest."""
    rows = [(i, "s", "one two three four", w) for i, w in enumerate([1000.0] * 20 + [None] * 20 + [-1.0] * 20)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string, grade double")
    taken = {r.doc_id: r.taken for r in mixing.mix(df, factor=0.25, weight=F.col("grade")).collect()}
    assert len(taken) == 60 and sum(taken.values()) == 60 and sum(taken[i] for i in range(20)) == 60


def test_clashing_names_come_out_as_they_are(spark):
    """Also where ids are null or repeated, so that rows get a number of their own."""
    names = ["doc_id", "source", "text", "_row", "_ID", "_copies", "_copy", "size", "key", "bucket", "n"]
    for ids in (list(range(40)), [None, 1, 1, *range(3, 40)]):
        rows = [(i, "s", f"one two {k}", k, -k, f"c{k}", k * 0.5, "z", k, k, "n") for k, i in enumerate(ids)]
        df = spark.createDataFrame(rows, "doc_id long, source string, text string, _row long, _ID long, _copies string, _copy double, size string, key long, bucket long, n string")
        got = mixing.mixed_documents(df, factor=1.0)
        assert got.columns == names and sorted(map(tuple, got.collect()), key=repr) == sorted(rows, key=repr)


def test_buckets_are_fine_for_all_weights(spark):
    for weight in (None, 1e-5, 1e-12, 1.0, 1e6):
        df = spark.range(20_000).selectExpr("id doc_id", "'s' source", "'w' text").withColumn("w", F.lit(weight).cast("double"))
        most = mixing.sized(df, weight=F.col("w")).groupBy("bucket").count().agg(F.max("count")).first()[0]
        assert most < 200  # one percent
    keys = mixing.sized(df, weight=F.rand(1)).select("key", "bucket").orderBy("key").collect()
    assert [r.bucket for r in keys] == sorted(r.bucket for r in keys)


def test_weights_learned_from_labels(spark):
    """On rows that the labels of weren't learned from, good texts weigh more."""
    r = random.Random(3)
    word = lambda: "".join(r.choice("abcdefghi") for _ in range(r.randrange(2, 9)))
    good = lambda: " ".join(word() for _ in range(r.randrange(5, 80))).capitalize() + "."
    bad = [lambda: " | ".join(word() for _ in range(20)), lambda: good().upper(), lambda: "\n".join(["the same line"] * 12), lambda: " ".join(word() + "***" for _ in range(30))]
    data = [(i, "s", good() if i % 3 else bad[i % 4]()) for i in range(900)]
    docs = spark.createDataFrame(data, "doc_id long, source string, text string")
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(900)] + [(5, None), (None, 1)], "doc_id long, quality int")
    size = F.regexp_count("text", F.lit(mixing.WORD_PATTERN))
    shaped = docs.withColumn("shape", mixing.shapes(F.col("text"), size))
    found = shaped.select("doc_id", mixing.learned_weight(shaped, labels).alias("w")).filter(mixing.crc_mod("doc_id", 5) == 0).collect()
    pairs = [(a.w, b.w) for a in found for b in found if a.doc_id % 3 and not b.doc_id % 3]
    assert sum(a > b for a, b in pairs) > 0.99 * len(pairs) and all(0.01 <= x.w <= 1 for x in found)
    taken = {x.doc_id: x.taken / x["size"] for x in mixing.mix(docs, factor=0.5, labels=labels).collect()}
    mean = lambda kind: sum(v for i, v in taken.items() if (i % 3 > 0) == kind) / sum((i % 3 > 0) == kind for i in taken)
    assert mean(True) > 4 * mean(False)
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert len({round(x.key * 2, 9) for x in mixing.sized(docs, labels=none).collect()}) > 800 and len(mixing.mix(docs, labels=none).collect()) == 900
