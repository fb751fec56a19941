"""Profiles of tables with many distinct values."""

from pyspark.sql import functions as F

from gridlark.operators import profile


def test_the_distinct_cells_of_a_task_are_bounded(spark):
    one = spark.range(0, 300_000, 1, 1)  # all in one task
    df = one.selectExpr("id", "concat('name ', id) name", "id % 7 few", "cast(null as string) none")
    sizes = [r["count"] * 4 for r in profile._dealt(df).groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == 1_200_000 and max(sizes) < 1.1 * profile.CELLS
    made, top = profile.profile(df), profile.top_values(df, 1)
    for x in (made, top):
        assert "REPARTITION_BY_NUM" in x._jdf.queryExecution().executedPlan().toString()
    assert {r["column"]: (r.rows, r.nulls, r.type, r.n_unique, r.min, r.max) for r in made.collect()} == {
        "id": (300_000, 0, "number", 300_000, 0.0, 299_999.0), "name": (300_000, 0, "string", 300_000, None, None),
        "few": (300_000, 0, "number", 7, 0.0, 6.0), "none": (300_000, 300_000, "empty", 0, None, None),
    }
    assert sorted((r["column"], r.value, r["count"]) for r in top.collect()) == [("few", "0", 42_858), ("id", "0", 1), ("name", "name 0", 1)]
    assert "REPARTITION" not in profile.profile(df.limit(1000))._jdf.queryExecution().executedPlan().toString()


def test_equal_rows_of_several_tasks_are_not_one_task(spark):
    dealt = profile._dealt(spark.range(0, 40_000, 1, 8).selectExpr("'x' a"), 1_000)
    sizes = [r["count"] for r in dealt.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == 40_000 and len(sizes) > 4
