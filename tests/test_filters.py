import datetime as dt

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from gridlark.operators import filters
from gridlark.plans.view import View

SALES = [(1, 150.0, "open", dt.date(2025, 8, 15)), (2, 99.0, "closed", dt.date(2025, 9, 1)), (3, 200.0, "open", dt.date(2025, 7, 31)), (4, None, "lost", None), (5, 100.0, "Open", dt.date(2024, 12, 31))]


@pytest.fixture(scope="module")
def sales(spark):
    return spark.createDataFrame(SALES, "id int, total double, status string, day date").withColumnRenamed("status", "Deal Status")


def ids(df):
    return sorted(r[0] for r in df.collect())


@pytest.mark.parametrize(("query", "want"), [
    ("total >= 100", [1, 3, 5]),
    ("total != 100", [1, 2, 3]),  # a missing number is false for every operator
    ("`Deal Status` = open", [1, 3]),
    ('`deal status` = "open" AND total > 150', [3]),
    ("total < 100 AND `Deal Status` = closed OR total = 200", [2, 3]),
    ("!(total >= 100)", [2, 4]),
    ("day <= 2025-08", [1, 3, 5]),
    ("day = 2025-08", [1]),
    ("day = 2025-Q3", [1, 2, 3]),
    ("day != 2025-Q3", [4, 5]),
    ("day > 2025-Q2", [1, 2, 3]),
    ("day >= 2025-08-15", [1, 2]),
    ("nothing = 1", []),
    ("!nothing = 1", [1, 2, 3, 4, 5]),
    ("R:OPEN", [1, 3, 5]),
    ('R:"open"', [1, 3]),
    ("C[Deal Status]:o", [1, 2, 3, 4, 5]),
    ("C[C]:clos", [2]),
    ("C[nothing]:x", []),
    ("total > 1000", []),
    ("", [1, 2, 3, 4, 5]),
])
def test_documented_filters(sales, query, want):
    assert ids(filters.apply(sales, query)) == want


@pytest.mark.parametrize("query", ["= 5 AND", "total >", "total >= 1 AND", "total"])
def test_what_is_no_filter(sales, query):
    if query == "total >":  # an empty value is text
        assert ids(filters.apply(sales, query)) == [1, 2, 3, 5]
    else:
        with pytest.raises(ValueError):
            filters.predicate(sales, query)


TEXT = ["", "5", "12,5", "abc", "-3", "Abc", None, " 7", "7 ", "1e2"]


def fold(cells, conditions, logic, negated):
    def one(c):
        name, op, value = c
        cell = cells[name] or ""
        number = filters.as_number(value)
        if number is not None:
            a = filters.as_number(cell.replace(",", ".")) if cell == cell.rstrip() else None
            return a is not None and {"=": a == number, "!=": a != number, ">": a > number, ">=": a >= number, "<": a < number, "<=": a <= number}[op]
        a, b = cell.encode(), value.encode()
        return {"=": a == b, "!=": a != b, ">": a > b, ">=": a >= b, "<": a < b, "<=": a <= b}[op]

    out = one(conditions[0])
    for word, c in zip(logic, conditions[1:], strict=True):
        out = (out and one(c)) if word == "AND" else (out or one(c))
    return out != negated


@pytest.fixture(scope="module")
def cells(spark):
    rows = [(i, a, b) for i, (a, b) in enumerate((a, b) for a in TEXT for b in TEXT)]
    df = spark.createDataFrame(rows, "id int, a string, b string").cache()
    yield rows, df
    df.unpersist()


condition = st.tuples(st.sampled_from("ab"), st.sampled_from(["=", "!=", ">", ">=", "<", "<="]), st.sampled_from(["5", "12.5", "abc", "zz", "-3"]))


@given(st.lists(condition, min_size=1, max_size=4), st.data())
@settings(max_examples=25, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
def test_filters_are_left_folds(cells, conditions, data):
    rows, df = cells
    logic = data.draw(st.lists(st.sampled_from(["AND", "OR"]), min_size=len(conditions) - 1, max_size=len(conditions) - 1))
    negated = data.draw(st.booleans())
    query = "!" * negated + " ".join(x for c, w in zip(conditions, [*logic, ""], strict=True) for x in (*c, w))
    assert ids(filters.apply(df, query)) == [i for i, a, b in rows if fold({"a": a, "b": b}, conditions, logic, negated)]


def test_ranges_reach_the_scan(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.createDataFrame(SALES, "id int, total double, status string, day date").write.parquet(path)
    df = filters.apply(spark.read.parquet(path), "day >= 2025-Q3 AND total > 100 AND status = open").select("id", "status")
    spark.conf.set("spark.sql.maxMetadataStringLength", "1000")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(day,2025-07-01)" in plan and "GreaterThan(total,100.0)" in plan and "EqualTo(status,open)" in plan


def test_views(sales):
    view = View(sales, "id").where("total >= 100")
    assert ids(view.quick("Deal Status", "open").df()) == [1, 3]
    assert ids(view.quick("Deal Status", "open", "!=").df()) == [5]
    assert ids(view.quick("Deal Status", "lost", logic="OR").df()) == [1, 3, 4, 5]
    assert ids(view.quick("Deal Status", "lost", logic=None).df()) == [4]
    assert ids(view.search("2025-07").df()) == [3]
    assert [r.id for r in view.order("total desc").df().collect()] == [3, 1, 5]
    assert [r.id for r in view.toggled("total").toggled("total").df().collect()] == [3, 1, 5]
    assert view.order("total").row(2).first().id == 1
    assert view.hide("day").df().columns == ["id", "total", "Deal Status"] and ids(view.reset().df()) == [1, 2, 3, 4, 5]
    again = type(view.spec).loads(view.order("total").unique("total").bookmark("a", 2).save_filter().spec.dumps())
    assert again.filter == "total >= 100" and again.sort == "total" and again.dedup == ("total",) and again.bookmarks == {"a": 2} and again.saved_filters == ("total >= 100",)
    assert [(r.key, r["column"]) for r in View(sales, "id").hits("open").orderBy("key").collect()] == [(1, "Deal Status"), (3, "Deal Status"), (5, "Deal Status")]
    assert [(r.n, r.key, r.next_key) for r in View(sales, "id").numbered_hits("open").orderBy("n").collect()] == [(1, 1, 3), (2, 3, 5), (3, 5, None)]
