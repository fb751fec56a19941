"""Positions, ranks, totals and quantiles over ranges against numpy and plain Python."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridlark.functions.joins import looked_up
from gridlark.functions.order import ROWS, Ranges, numbered, quantiles, ranked, running
from gridlark.operators import explore, stats
from gridlark.sources.shared import shared_dir

SHARES = [0.0, 0.01, 0.25, 0.5, 0.9, 1.0]


@pytest.mark.parametrize("n", [1, 2, 3, 100])
def test_quantiles_with_ties_and_nulls(spark, n):
    rng = np.random.default_rng(n)
    values = [float(v) for v in rng.integers(0, max(2, n // 3), n)]
    df = spark.createDataFrame([(v,) for v in [*values, None, None]], "v double")
    for rows in (ROWS, 3):
        found = quantiles(df, F.col("v"), SHARES, rows=rows).first()["q"]
        assert np.allclose(found, np.quantile(values, SHARES))


def test_quantiles_of_groups(spark):
    groups = {"a": [3.0, 1.0, 1.0, 7.5], "b": [2.0], None: [5.0, 6.0], "none": [None]}
    df = spark.createDataFrame([(k, v) for k, vs in groups.items() for v in vs], "k string, v double")
    for rows in (ROWS, 3):
        found = {r["_key0"]: r["q"] for r in quantiles(df, F.col("v"), SHARES, [F.col("k")], rows).collect()}
        assert set(found) == set(groups) and found.pop("none") == [None] * len(SHARES)
        for k, q in found.items():
            assert np.allclose(q, np.quantile(groups[k], SHARES))
    boxes = {r["k"]: (r["min"], r["median"], r["max"]) for r in explore.five_numbers(df, "v", "k").collect()}
    assert boxes == {"a": (1.0, 2.0, 7.5), "b": (2.0, 2.0, 2.0), None: (5.0, 5.5, 6.0), "none": (None, None, None)}


def test_quantiles_of_nothing(spark):
    df = spark.createDataFrame([], "k string, v double")
    for rows in (ROWS, 3):
        assert quantiles(df, F.col("v"), [0.5], rows=rows).first()["q"] == [None]
        assert quantiles(df, F.col("v"), [0.5], [F.col("k")], rows).count() == 0
    assert stats.percentiles(df, "v").first()["p50"] is None


def test_positions_and_totals(spark):
    cached = lambda: set(spark.sparkContext._jsc.getPersistentRDDs())
    rng, before = np.random.default_rng(5), cached()
    values = [int(v) for v in rng.integers(0, 50, 400)]
    df = spark.createDataFrame(list(enumerate(values)), "id long, v long")
    order = sorted(range(400), key=lambda i: (-values[i], i))
    found = {r.id: r.pos for r in numbered(df, [(F.col("v"), True), F.col("id")], rows=50).collect()}
    assert found == {i: k + 1 for k, i in enumerate(order)}
    sums = {r.id: r.before for r in running(df, [(F.col("v"), True), F.col("id")], F.col("v"), "before", rows=50).collect()}
    assert sums == {i: sum(values[j] for j in order[:k]) for k, i in enumerate(order)}
    assert sorted(map(tuple, numbered(df, [(F.col("v"), True), F.col("id")]).collect())) == sorted((i, values[i], k) for i, k in found.items())
    assert len(numbered(df, [F.col("id")]).columns) == 3 and cached() <= before
    ranks = {r.id: r.r for r in ranked(df.withColumn("v", F.expr("nullif(v, 7)")), F.col("v"), "r").collect()}
    assert ranks == {i: 0.0 if v == 7 else 1.0 + sum(w > v for w in values if w != 7) for i, v in enumerate(values)}
    assert numbered(df.filter("id < 0"), [F.col("id")]).count() == 0


def test_ranges_by_mixed_orders_and_nulls(spark):
    rng = np.random.default_rng(2)
    rows = [(i, None if a == 0 else float(a), None if b == 0 else "xyz"[b - 1] * b) for i, (a, b) in enumerate(zip(rng.integers(0, 9, 3000).tolist(), rng.integers(0, 4, 3000).tolist(), strict=True))]
    df = spark.createDataFrame(rows, "id long, a double, b string")
    for down in ((False, False), (True, False), (False, True), (True, True)):
        dealt = Ranges(df, [(F.col("a"), down[0]), (F.col("b"), down[1]), F.col("id")], rows=100)
        want = [r.id for r in df.orderBy(*dealt_by(down), "id").collect()]
        got = dealt.rows.select("id", "_range").collect()
        of = {r.id: r._range for r in got}
        assert [of[i] for i in want] == sorted(of.values()) and len(set(of.values())) > 15
        found = numbered(df, [(F.col("a"), down[0]), (F.col("b"), down[1]), F.col("id")], rows=100)
        assert {r.id: r.pos for r in found.collect()} == {i: k + 1 for k, i in enumerate(want)}


def dealt_by(down):
    return [F.desc(c) if d else F.asc(c) for c, d in zip("ab", down, strict=True)]


def test_one_shuffle_of_the_columns_that_are_asked_for(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(300_000).selectExpr("id", "id % 977 v", "repeat('x', 50) pad").write.parquet(path)
    before = set(os.listdir(shared_dir(spark)))
    made = numbered(spark.read.parquet(path), [(F.col("v"), True), F.col("id")], rows=ROWS)
    plan = made.select("id", "pos")._jdf.queryExecution().executedPlan().toString()
    assert "pad" not in plan and plan.count("hashpartitioning(_range") == 2 and "rangepartitioning" not in plan  # its rows, and totals of ranges
    assert made.count() == 300_000 and set(os.listdir(shared_dir(spark))) == before


def test_ranges_are_found_once_a_row_by_compiled_steps(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(100_000).selectExpr("id", "nullif(id * 7919 % 977, 5) v", "concat('x', id % 3) s").write.parquet(path)
    order = [F.lower("s"), (F.col("v"), True), F.col("id")]
    made = numbered(spark.read.parquet(path), order, rows=40)  # 2,501 ranges, so twelve steps
    plan = made.select("id", "pos")._jdf.queryExecution().executedPlan().toString()
    assert "lambdafunction" not in plan and "Filter " not in plan  # a filter would look for each row's range once more
    want = spark.read.parquet(path).orderBy(F.lower("s"), F.desc("v"), "id").select("id").collect()
    assert {r.id: r.pos for r in made.collect()} == {r.id: k + 1 for k, r in enumerate(want)}


def test_ends_of_all_kinds(spark):
    """Ranges of dates, times, decimals, doubles that are no numbers, binary cells and text with quotes ascend in the order."""
    rows = spark.range(2000).selectExpr("id", "date_add(date'1969-12-30', cast(id * 7919 % 2003 as int)) d", "timestamp_micros(id * 7919777 - 5000000) t", "cast(timestamp_micros(id * 7919777 % 90001) as timestamp_ntz) n",
        "cast(id * 7919 % 2003 / 7 as decimal(20, 9)) c", "case when id % 9 = 0 then double('NaN') when id % 9 = 1 then double('-Infinity') else sin(id) end f", "cast(cast(id * 7919 % 2003 as string) as binary) b",
        "concat(chr(cast(34 + id % 60 as int)), '\\\\ \"', id) s")
    for c in "dtncfbs":
        for down in (False, True):
            of = {r.id: r._range for r in Ranges(rows, [(F.col(c), down), F.col("id")], rows=100).rows.select("id", "_range").collect()}
            want = [of[r.id] for r in rows.orderBy(F.desc(c) if down else F.asc(c), "id").select("id").collect()]
            assert want == sorted(want) and len(set(want)) > 8, c


def test_many_rows_of_a_small_file_are_many_tasks(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(2_000_000).selectExpr("id div 1000 v").write.parquet(path)
    dealt = Ranges(spark.read.parquet(path), [F.col("v")])
    sizes = [r["count"] for r in dealt.rows.groupBy("_range").count().collect()]
    assert len(sizes) > 8 and max(sizes) < 3 * ROWS


@pytest.mark.parametrize("most", [1, 3, 10_000])
def test_lookups_with_hot_and_missing_keys(spark, most):
    keys = ["hot"] * 300 + [None] * 50 + ["a", "b", "c", "nowhere"]
    rows = spark.createDataFrame(list(enumerate(keys)), "id long, k string").repartition(5)
    table = spark.createDataFrame([("hot", 300, "H"), ("a", 1, "A"), ("b", 1, None), ("c", 1, "C")], "of string, n long, name string")
    want = {"hot": "H", "a": "A", "c": "C"}
    for how in ("left", "inner"):
        found = looked_up(rows, table, "k", "of", "n", how, most)
        assert found.columns == ["id", "k", "n", "name"]
        assert sorted((r.id, r.name or "") for r in found.collect()) == [(i, want.get(k, "")) for i, k in enumerate(keys) if how == "left" or k in ("hot", "a", "b", "c")]
