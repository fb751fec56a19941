import math

import pytest

from gridlark.functions import columns, numbers
from gridlark.operators import edit, formulas

ROWS = [(1, 10.0, 4.0, "12abc"), (2, 20.0, 0.0, ""), (3, None, 5.0, "-1,5"), (4, 20.0, 2.0, "x"), (5, -7.5, 3.0, None)]


@pytest.fixture(scope="module")
def df(spark):
    return spark.createDataFrame(ROWS, "id int, price double, qty double, `raw text` string")


def values(df, formula, base=None):
    return [r.v for r in formulas.compute(df, "v", formula, base).orderBy("id").collect()]


@pytest.mark.parametrize(("formula", "want"), [
    ("price * qty + 1", [41, 1, None, 41, -21.5]),
    ("price / qty", [2.5, None, None, 10, -2.5]),
    ("-price - -2", [-8, -18, None, -18, 9.5]),
    ("2 + 3 * 4 - 6 / 3", [12] * 5),
    ("(2 + 3) * 4 = 20", [1] * 5),
    ("price > 10", [0, 1, None, 1, 0]),
    ("round(price / 3, 2)", [3.33, 6.67, None, 6.67, -2.5]),
    ("round(price)", [10, 20, None, 20, -8]),
    ("mod(price, qty)", [2, None, None, 0, -1.5]),
    ("pow(qty, 2)", [16, 0, 25, 4, 9]),
    ("abs(price) + floor(price) + ceil(price)", [30, 60, None, 60, 7.5 - 8 - 7]),
    ("if(qty > 3, 1, price)", [1, 20, 1, 20, -7.5]),
    ("if(price > 0, 1, 2)", [1, 1, None, 1, 2]),
    ("empty(`raw text`)", [0, 1, 0, 0, 1]),
    ("empty(price / qty)", [0, 1, 1, 0, 0]),
    ("`raw text`", [12, None, -1.5, None, None]),
    ("B", [10, 20, None, 20, -7.5]),
    ("col_rank(price)", [3, 1, 0, 1, 4]),
    ("col_count(price) + col_count(`raw text`)", [6] * 5),
    ("col_sum(price) / col_max(qty)", [8.5] * 5),
    ("col_pct(qty)", [4 / 14 * 100, 0, 5 / 14 * 100, 2 / 14 * 100, 3 / 14 * 100]),
    ("col_median(price) + col_percentile(price, 25)", [15 + 5.625] * 5),
])
def test_values(df, formula, want):
    got = values(df, formula)
    assert all(a is b is None or a is not None and b is not None and math.isclose(a, b, abs_tol=1e-9) for a, b in zip(got, want, strict=True)), got


def test_view_and_whole_table(df):
    view = df.filter("id <= 2")
    assert values(view, "col_sum(price) + col_sum_all(qty) * 100", df) == [1430, 1430]
    assert values(view, "col_rank(price)", df) == [2, 1] and values(view, "col_rank_all(qty)", df) == [2, 5]


@pytest.mark.parametrize("formula", ["price +", "nope(1)", "nowhere + 1", "round()", "round(1, 2, 3)", "1 2", "if(1, 2)", "price $ 2", "(1", "col_percentile(price, 101)", ""])
def test_errors(df, formula):
    with pytest.raises(ValueError):
        formulas.compute(df, "v", formula)


def test_edits(df):
    assert [r.v for r in edit.fill_sequence(df, "v", "id", 5, 0).orderBy("id").collect()] == [5, 6, 7, 8, 9]
    out = edit.fill_formula(df.withColumnRenamed("raw text", "t"), "t", "price / 4", df["id"] <= 2, as_text=True)
    assert [r.t for r in out.orderBy("id").collect()] == ["2.5", "5", "-1,5", "x", None]
    assert edit.add_column(df, before="qty").columns == ["id", "price", "untitled", "qty", "raw text"]
    assert [r.id for r in edit.delete_row(df, "id", 3).orderBy("id").collect()] == [1, 2, 4, 5]


def test_letters_and_names(df):
    assert [columns.letter(i) for i in (0, 25, 26, 701, 702)] == ["A", "Z", "AA", "ZZ", "AAA"]
    assert all(columns.letter_index(columns.letter(i)) == i for i in range(800))
    assert columns.resolve(df, "PRICE") == "price" and columns.resolve(df, "C") == "qty" and columns.resolve(df, "ZZ") is None


def test_numbers_in_text(spark):
    cells = ["1234,56", "12.5", "abc", "", " 7", "0x1A", "1d", "1e3", "$1 200", "-3.5 EUR", "1,234,567", None, "5 "]
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cells)], "i int, c string")
    got = df.select("i", numbers.full(df.c).alias("f"), numbers.prefix(df.c).alias("p"), numbers.cleaned(df.c).alias("m")).orderBy("i").collect()
    assert [r.f for r in got] == [1234.56, 12.5, None, None, 7, None, None, 1000, None, None, None, None, None]
    assert [r.p for r in got] == [1234.56, 12.5, None, None, 7, 0, 1, 1000, None, -3.5, 1.234, None, 5]
    assert [r.m for r in got][8:10] == [1200, -3.5]
    shown = spark.range(1).select(*[f(numbers.F.lit(x)).alias(str(i)) for i, (f, x) in enumerate([(numbers.thousands, 1234567.0), (numbers.short, 1500.0), (numbers.short, 2e6), (numbers.shown, 3.0), (numbers.shown, 2.5), (lambda c: numbers.truncated(c, 3), "abcdef"), (numbers.file_name, "a b/c"), (lambda c: numbers.fixed(c, 2), "1,5"), (lambda c: numbers.fixed(c, 2), ""), (lambda c: numbers.fixed(c, 2), "n/a")])])
    assert list(shown.first()) == ["1 234 567", "1.5K", "2.0M", "3", "2.5", "abc...", "a_b_c", "1.50", "0", "n/a"]
