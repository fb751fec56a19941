import hashlib

from pyspark.sql import functions as F

from gridlark.llm import sketches

DOCS = "doc_id long, text string, sketch string, n_shingles int"


def likeness(a, b, words=5):
    def shingles(t):
        w = t.lower().split()
        return {tuple(w[i : i + words]) for i in range(max(1, len(w) - words + 1))} if w else set()

    x, y = shingles(a), shingles(b)
    return len(x & y) / len(x | y) if x | y else 1.0


def texts():
    base = [f"w{i * i % 97}x{i % 13}" for i in range(1200)]
    out = {i: " ".join(base[i * 20 : i * 20 + 15 * (i + 1)]) for i in range(30)}
    return out | {30: None, 31: "", 32: " \t\n", 33: "one Two", 34: "one two", 35: " ".join(f"v{i}" for i in range(30_000)), 36: "é" * 9, 37: out[5]}


def test_against_exact_sets(spark):
    data = texts()
    got = {r.doc_id: r for r in sketches.op5(spark.createDataFrame([(k, v, "s", 1) for k, v in data.items()], DOCS)).collect()}
    assert got.keys() == data.keys()
    order = sorted(data, reverse=True)
    for a, b in zip(order, order[1:] + order[:1], strict=True):
        t, n = data[a] or "", data[b] or ""
        third = len(t) // 3
        edited = t[: len(t) - third] + n[:third]
        r = got[a]
        assert r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert abs(r.near_edited - likeness(t, edited)) < 0.13 and abs(r.near_next - likeness(t, n)) < 0.13
    assert got[5].fingerprint == got[37].fingerprint and got[33].fingerprint == got[34].fingerprint
    assert got[30].fingerprint == got[31].fingerprint == ""
    assert abs(got[35].n_shingles / 29_996 - 1) < 0.2


def test_repeated_rows_one_row_and_empty(spark):
    same = [(3, "a b c d e f", "", 0), (3, "a b c d e f", "", 0), (1, "x", "", 0), (None, "y", "", 0)]
    assert sketches.op5(spark.createDataFrame(same, DOCS)).count() == 4
    one = sketches.op5(spark.createDataFrame([(7, "a b c d e f", "", 0)], DOCS)).first()
    assert one.near_next == 1.0
    assert sketches.op5(spark.createDataFrame([], DOCS)).collect() == []


def test_merge_containment(spark):
    a, b = " ".join(f"a{i}" for i in range(3000)), " ".join(f"a{i}" for i in range(1500, 4500))
    df = spark.createDataFrame([(a, b)], "a string, b string").select(sketches.sketch(F.col("a")).alias("a"), sketches.sketch(F.col("b")).alias("b"), sketches.sketch(F.concat_ws(" ", "a", "b")).alias("ab"))
    r = df.select(sketches.containment(F.col("a"), F.col("b")), sketches.distinct_count(sketches.merged(F.col("a"), F.col("b"))), sketches.resemblance(F.col("ab"), sketches.merged(F.col("a"), F.col("b")))).first()
    assert abs(r[0] - 0.5) < 0.1 and abs(r[1] / 4500 - 1) < 0.2 and r[2] > 0.95


def test_small_ranges(spark, monkeypatch):
    """Many ranges, also within the rows of one id, give the order that one range gives."""
    rows = [(k, v, "s", 1) for k, v in texts().items() if k != 35] + [(50, f"text number {i}", "", 1) for i in range(40)] + [(None, "none", "", 1)]
    df = spark.createDataFrame(rows, DOCS).repartition(3)
    key = lambda r: (r.doc_id is None, r.doc_id or 0, r.fingerprint, r.edited_sha256)
    want = sorted(sketches.op5(df).collect(), key=key)
    monkeypatch.setattr(sketches, "LEAST_BYTES", 300)
    assert len(sketches.heads(sketches.with_next(df).filter("not ghost").select("key", "tie", "text"))) > 20
    assert sorted(sketches.op5(df).collect(), key=key) == want
