"""The query catalogue: name -> query over the tables of a folder, name -> DuckDB SQL for the same rows.

Sums and means are rounded, places are columns, and every order has a tie breaker, so that results don't depend on the order
in which rows are added up or read.
"""

from __future__ import annotations


from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridlark import streaming
from gridlark.functions import numbers
from gridlark.functions.columns import quoted
from gridlark.functions.dates import formatted
from gridlark.functions.order import numbered
from gridlark.operators import dedup, edit, explore, filters, formulas, pivot, profile, sorting, stats
from gridlark.operators.pivot import PivotSpec
from gridlark.plans.view import View, ViewSpec
from gridlark.sources import readers, writers
from gridlark.sources.shared import new_path

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None):
    """Registers a function as a query, with its SQL if there is any."""

    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLES[fn.__name__] = sql
        return fn

    return add


def t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def rounded(df: DataFrame, **digits: int) -> DataFrame:
    return df.withColumns({c: F.round(quoted(c), n) for c, n in digits.items()})


def longs(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({c: quoted(c).cast("long") for c in names})


# ------------------------------------------------------------------------------------------------------------- filters

LINE = ("l_orderkey", "l_linenumber")


@query("""SELECT l_orderkey, l_linenumber, l_quantity, round(l_extendedprice, 2) AS l_extendedprice FROM lineitem
WHERE l_quantity >= 30 AND l_returnflag = 'R' AND l_shipdate >= DATE '1996-01-01' ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber LIMIT 50""")
def filter_sort_topk(spark, d):
    rows = filters.apply(t(spark, d, "lineitem"), "l_quantity >= 30 AND l_returnflag = R AND l_shipdate >= 1996-Q1")
    top = sorting.sort(rows, "l_extendedprice desc, l_orderkey, l_linenumber").limit(50)
    return rounded(top.select(*LINE, "l_quantity", "l_extendedprice"), l_extendedprice=2)


@query("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity >= 30 AND l_returnflag = 'R'")
def filter_num_and_str(spark, d):
    return filters.apply(t(spark, d, "lineitem"), 'l_quantity >= 30 AND l_returnflag = "R"').select(*LINE, "l_quantity")


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE (l_quantity > 45 AND l_returnflag = 'A') OR l_linestatus = 'F'")
def filter_left_fold(spark, d):
    return filters.apply(t(spark, d, "lineitem"), "l_quantity > 45 AND l_returnflag = A OR l_linestatus = F").select(*LINE)


@query("SELECT o_orderkey FROM orders WHERE NOT (o_orderstatus = 'F' AND o_totalprice < 100000)")
def filter_negated(spark, d):
    return filters.apply(t(spark, d, "orders"), "!(o_orderstatus = F AND o_totalprice < 100000)").select("o_orderkey")


@query("SELECT o_orderkey FROM orders WHERE strftime(o_orderdate, '%Y-%m') = '1997-03'")
def filter_month_eq(spark, d):
    return filters.apply(t(spark, d, "orders"), "o_orderdate = 1997-03").select("o_orderkey")


@query("SELECT o_orderkey FROM orders WHERE strftime(o_orderdate, '%Y-%m') <= '1996-02'")
def filter_month_le(spark, d):
    return filters.apply(t(spark, d, "orders"), "o_orderdate <= 1996-02").select("o_orderkey")


@query("SELECT o_orderkey FROM orders WHERE o_orderdate >= DATE '1996-04-01' AND o_orderdate < DATE '1996-10-01'")
def filter_quarter_range(spark, d):
    return filters.apply(t(spark, d, "orders"), "o_orderdate >= 1996-Q2 AND o_orderdate <= 1996-Q3").select("o_orderkey")


@query("SELECT o_orderkey FROM orders WHERE CAST(o_orderdate AS DATE) > DATE '2000-06-15'")
def filter_date_after(spark, d):
    return filters.apply(t(spark, d, "orders"), "o_orderdate > 2000-06-15").select("o_orderkey")


@query("SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT'")
def filter_missing_column(spark, d):
    return filters.apply(t(spark, d, "orders"), "nowhere = 1 OR o_orderpriority = 1-URGENT").select("o_orderkey")


@query("SELECT c_custkey FROM customer WHERE CAST(c_custkey AS VARCHAR) LIKE '%build%' OR lower(c_name) LIKE '%build%' OR CAST(c_nationkey AS VARCHAR) LIKE '%build%' OR CAST(c_acctbal AS VARCHAR) LIKE '%build%' OR lower(c_mktsegment) LIKE '%build%'")
def filter_any_contains(spark, d):
    return filters.apply(t(spark, d, "customer"), "R:build").select("c_custkey")


@query("SELECT c_custkey FROM customer WHERE CAST(c_custkey AS VARCHAR) = '7' OR c_name = '7' OR CAST(c_nationkey AS VARCHAR) = '7' OR c_mktsegment = '7'")
def filter_any_exact(spark, d):
    return filters.apply(t(spark, d, "customer"), 'R:"7"').select("c_custkey")


@query("SELECT p_partkey FROM part WHERE contains(lower(p_type), 'a')")
def filter_col_contains(spark, d):
    return filters.apply(t(spark, d, "part"), "C[p_type]:A").select("p_partkey")


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' OR o_orderpriority = '2-HIGH'")
def quick_filter_or(spark, d):
    return View(t(spark, d, "orders"), "o_orderkey").where("o_orderstatus = F").quick("o_orderpriority", "2-HIGH", logic="OR").df().select("o_orderkey")


@query("SELECT p_partkey AS key, 'p_name' AS \"column\", p_name AS value FROM part WHERE contains(lower(p_name), 'e') UNION ALL SELECT p_partkey, 'p_brand', p_brand FROM part WHERE contains(lower(p_brand), 'e') UNION ALL SELECT p_partkey, 'p_type', p_type FROM part WHERE contains(lower(p_type), 'e')")
def search_hits(spark, d):
    return filters.hits(t(spark, d, "part").select("p_partkey", "p_name", "p_brand", "p_type"), "E", "p_partkey")


@query("SELECT p_partkey FROM part WHERE p_size > 20 AND (contains(lower(p_name), '1') OR contains(lower(p_brand), '1') OR contains(lower(p_type), '1') OR contains(CAST(p_partkey AS VARCHAR), '1') OR contains(CAST(p_size AS VARCHAR), '1'))")
def search_rows(spark, d):
    return View(t(spark, d, "part").drop("p_retailprice"), "p_partkey").where("p_size > 20").search("1").df().select("p_partkey")


# --------------------------------------------------------------------------------------------------------------- order


@query("SELECT o_orderkey, row_number() OVER (ORDER BY o_orderpriority, o_totalprice DESC, o_orderkey) AS pos FROM orders")
def sort_multi_ranked(spark, d):
    return View(t(spark, d, "orders"), "o_orderkey").order("o_orderpriority, o_totalprice desc").positions().select("o_orderkey", "pos")


_MIXED = "SELECT p_partkey AS id, CASE p_partkey % 7 WHEN 0 THEN CAST(p_size AS VARCHAR) WHEN 1 THEN p_name WHEN 2 THEN upper(p_name) WHEN 3 THEN '' WHEN 4 THEN NULL WHEN 5 THEN '-' || p_size ELSE p_size || '.5' END AS v FROM part"


@query(f"""SELECT id, row_number() OVER (ORDER BY CASE WHEN coalesce(v, '') = '' THEN 0 WHEN try_cast(v AS DOUBLE) IS NOT NULL THEN 1 ELSE 2 END,
try_cast(v AS DOUBLE) NULLS FIRST, lower(coalesce(v, '')), id) AS pos FROM ({_MIXED})""")
def sort_mixed_case(spark, d):
    size, name = F.col("p_size").cast("string"), F.col("p_name")
    cells = (size, name, F.upper(name), F.lit(""), F.lit(None), F.concat(F.lit("-"), size), F.concat(size, F.lit(".5")))
    mixed = F.element_at(F.array(*cells), (F.col("p_partkey") % 7 + 1).cast("int"))
    return sorting.positions(t(spark, d, "part").select(F.col("p_partkey").alias("id"), mixed.alias("v")), "v", "id").select("id", "pos")


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 1 OFFSET 99")
def goto_row(spark, d):
    return View(t(spark, d, "orders"), "o_orderkey").order("o_totalprice").row(100).select("o_orderkey", "o_totalprice")


@query("SELECT o_orderkey FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20 OFFSET 40")
def view_page(spark, d):
    return sorting.page(t(spark, d, "orders"), "o_totalprice desc", "o_orderkey", 40, 20).select("o_orderkey")


# ------------------------------------------------------------------------------------------------------------ formulas


@query("SELECT l_orderkey, l_linenumber, round(l_extendedprice * (1 - l_discount) * (1 + l_tax), 6) AS charge FROM lineitem")
def cf_arith(spark, d):
    out = formulas.compute(t(spark, d, "lineitem"), "charge", "l_extendedprice * (1 - l_discount) * (1 + l_tax)")
    return rounded(out.select(*LINE, "charge"), charge=6)


@query("SELECT c_custkey, sign(c_acctbal) * floor(abs(c_acctbal) * 10 + 0.5) / 10 AS r FROM customer")
def cf_round(spark, d):
    return formulas.compute(t(spark, d, "customer"), "r", "round(c_acctbal, 1)").select("c_custkey", "r")


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity > 25 THEN l_quantity * 2 ELSE -l_quantity END AS v FROM lineitem")
def cf_if(spark, d):
    return formulas.compute(t(spark, d, "lineitem"), "v", "if(l_quantity > 25, l_quantity * 2, -l_quantity)").select(*LINE, "v")


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_discount <> 0 THEN round(l_quantity / l_discount, 6) END AS v FROM lineitem")
def cf_div_zero(spark, d):
    return rounded(formulas.compute(t(spark, d, "lineitem"), "v", "l_quantity / l_discount").select(*LINE, "v"), v=6)


@query("SELECT p_partkey, CAST(p_size % 7 AS DOUBLE) + CAST(p_size AS DOUBLE) * p_size AS v FROM part")
def cf_mod_pow(spark, d):
    return formulas.compute(t(spark, d, "part"), "v", "mod(p_size, 7) + pow(p_size, 2)").select("p_partkey", "v")


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_discount = 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS v FROM lineitem")
def cf_empty(spark, d):
    return formulas.compute(t(spark, d, "lineitem"), "v", "empty(l_quantity / l_discount)").select(*LINE, "v")


@query("SELECT p_partkey, floor(p_retailprice / 10) + ceil(p_retailprice / 7) + abs(p_size - 25) AS v FROM part")
def cf_floor_ceil_abs(spark, d):
    return formulas.compute(t(spark, d, "part"), "v", "floor(p_retailprice / 10) + ceil(p_retailprice / 7) + abs(p_size - 25)").select("p_partkey", "v")


SCALARS = ("sum", "avg", "min", "max", "count", "median", "stddev", "var")


@query("""SELECT round(sum(l_quantity), 2) AS sum, round(avg(l_quantity), 6) AS avg, min(l_quantity) AS min, max(l_quantity) AS max, CAST(count(l_quantity) AS DOUBLE) AS count,
median(l_quantity) AS median, round(stddev_pop(l_quantity), 6) AS stddev, round(var_pop(l_quantity), 6) AS var, quantile_cont(l_quantity, 0.9) AS percentile FROM lineitem""")
def cf_scalar_aggs(spark, d):
    df = t(spark, d, "lineitem")
    made = {(fn, "l_quantity", None): fn for fn in SCALARS} | {("percentile", "l_quantity", 90): "percentile"}
    return rounded(formulas.scalars(df, made), sum=2, avg=6, stddev=6, var=6)


@query("""WITH v AS (SELECT * FROM orders WHERE o_orderstatus = 'F') SELECT o_orderkey, round(o_totalprice - (SELECT avg(o_totalprice) FROM v), 4) AS v,
round(o_totalprice / (SELECT max(o_totalprice) FROM orders), 8) AS w FROM v""")
def cf_view_and_all(spark, d):
    view = View(t(spark, d, "orders"), "o_orderkey").where("o_orderstatus = F")
    out = view.compute("v", "o_totalprice - col_avg(o_totalprice)")
    out = formulas.compute(out, "w", "o_totalprice / col_max_all(o_totalprice)", view.base)
    return rounded(out.select("o_orderkey", "v", "w"), v=4, w=8)


@query("SELECT o_orderkey, CAST(rank() OVER (ORDER BY o_totalprice DESC) AS DOUBLE) AS r FROM orders WHERE o_orderstatus = 'F'")
def cf_rank_view(spark, d):
    return View(t(spark, d, "orders"), "o_orderkey").where("o_orderstatus = F").compute("r", "col_rank(o_totalprice)").select("o_orderkey", "r")


@query("SELECT l_orderkey, l_linenumber, r FROM (SELECT *, CAST(rank() OVER (ORDER BY l_quantity DESC) AS DOUBLE) AS r FROM lineitem) WHERE l_returnflag = 'R'")
def cf_rank_all(spark, d):
    base = t(spark, d, "lineitem")
    return formulas.compute(filters.apply(base, "l_returnflag = R"), "r", "col_rank_all(l_quantity)", base).select(*LINE, "r")


@query("SELECT o_orderkey, round(o_totalprice / sum(o_totalprice) OVER () * 100, 8) AS p FROM orders WHERE o_orderstatus = 'F'")
def cf_pct_view(spark, d):
    return rounded(View(t(spark, d, "orders"), "o_orderkey").where("o_orderstatus = F").compute("p", "col_pct(o_totalprice)").select("o_orderkey", "p"), p=8)


@query("SELECT o_orderkey, p FROM (SELECT *, round(o_totalprice / sum(o_totalprice) OVER () * 100, 8) AS p FROM orders) WHERE o_orderstatus = 'F'")
def cf_pct_all(spark, d):
    return rounded(View(t(spark, d, "orders"), "o_orderkey").where("o_orderstatus = F").compute("p", "col_pct_all(o_totalprice)").select("o_orderkey", "p"), p=8)


# --------------------------------------------------------------------------------------------------------------- edits


@query("SELECT n_nationkey, n_name, n_regionkey, 'x' AS note FROM nation")
def fill_const(spark, d):
    return edit.fill_constant(edit.add_column(t(spark, d, "nation"), "note"), "note", "x")


@query("SELECT n_nationkey, 100.0::DOUBLE + (row_number() OVER (ORDER BY n_nationkey) - 1) * 5 AS seq FROM nation")
def fill_sequence(spark, d):
    return edit.fill_sequence(t(spark, d, "nation"), "seq", "n_nationkey", 100, 5).select("n_nationkey", "seq")


@query("SELECT c_custkey, CASE WHEN c_nationkey = 3 THEN round(c_acctbal * 2, 4) ELSE round(c_acctbal, 4) END AS c_acctbal FROM customer")
def fill_formula_view(spark, d):
    view = View(t(spark, d, "customer"), "c_custkey").where("c_nationkey = 3").fill("c_acctbal", "c_acctbal * 2")
    return rounded(view.base.select("c_custkey", "c_acctbal"), c_acctbal=4)


@query("SELECT n_nationkey, CASE WHEN n_nationkey = 4 THEN 'ATLANTIS' ELSE n_name END AS n_name, n_regionkey FROM nation")
def edit_point_update(spark, d):
    return edit.update_cell(t(spark, d, "nation"), "n_nationkey", 4, "n_name", "ATLANTIS")


@query("SELECT n_nationkey AS id, '' AS untitled, n_name FROM nation WHERE n_nationkey <> (SELECT n_nationkey FROM nation ORDER BY n_nationkey LIMIT 1 OFFSET 2)")
def column_edit(spark, d):
    df = edit.add_column(t(spark, d, "nation"), after="n_nationkey")
    return edit.delete_nth(edit.rename_column(edit.delete_column(df, "n_regionkey"), "n_nationkey", "id"), 3, "id")


# --------------------------------------------------------------------------------------------------------------- pivot


def _money(df: DataFrame, *names: str) -> DataFrame:
    return rounded(df, **dict.fromkeys(names, 2))


@query("""SELECT coalesce(l_returnflag, 'Total') AS row_key, coalesce(l_linestatus, 'Total') AS col_key, grouping(l_linestatus) = 1 AS is_row_total, grouping(l_returnflag) = 1 AS is_col_total,
round(sum(l_extendedprice), 2) AS sum FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)""")
def pivot_sum_long(spark, d):
    return _money(pivot.long(t(spark, d, "lineitem"), PivotSpec("l_returnflag", "l_linestatus", "l_extendedprice", "SUM")), "sum")


@query("""SELECT l_returnflag AS row_key, l_linestatus AS col_key, round(sum(l_quantity), 2) AS sum, count(*) AS count, round(sum(l_quantity) / count(*), 6) AS avg FROM lineitem GROUP BY 1, 2""")
def pivot_multi_agg(spark, d):
    return rounded(pivot.cells(t(spark, d, "lineitem"), PivotSpec("l_returnflag", "l_linestatus", "l_quantity", "SUM+COUNT+AVG")), sum=2, avg=6)


@query("""SELECT coalesce(o_orderstatus, 'Total') AS row_key, coalesce(o_orderpriority, 'Total') AS col_key, grouping(o_orderpriority) = 1 AS is_row_total, grouping(o_orderstatus) = 1 AS is_col_total,
count(*) AS count, count(DISTINCT o_custkey) AS unique_count FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)""")
def pivot_unique_count(spark, d):
    return pivot.long(t(spark, d, "orders"), PivotSpec("o_orderstatus", "o_orderpriority", "o_custkey", "COUNT+UNIQUE COUNT"))


@query("SELECT o_orderstatus AS row_key, 'Total' AS col_key, min(o_orderpriority) AS min, max(o_orderpriority) AS max FROM orders GROUP BY 1")
def pivot_minmax_str(spark, d):
    return pivot.cells(t(spark, d, "orders"), PivotSpec("o_orderstatus", None, "o_orderpriority", "MIN+MAX"))


@query("""SELECT coalesce(l_returnflag, 'Total') AS row_key, CAST(count(*) FILTER (l_linestatus = 'F') AS BIGINT) AS F, CAST(count(*) FILTER (l_linestatus = 'O') AS BIGINT) AS O, count(*) AS Total,
CASE coalesce(l_returnflag, 'Total') WHEN 'A' THEN 1 WHEN 'N' THEN 2 WHEN 'R' THEN 3 ELSE 4611686018427387904 END AS row_place FROM lineitem GROUP BY ROLLUP (l_returnflag)""")
def pivot_wide_totals(spark, d):
    return pivot.wide(t(spark, d, "lineitem"), PivotSpec("l_returnflag", "l_linestatus"), ["F", "O"])


def _dated(unit: str, key: str):
    @query(f"SELECT {key} AS row_key, 'Total' AS col_key, count(*) AS count, round(sum(o_totalprice), 2) AS sum FROM orders GROUP BY 1")
    def run(spark, d):
        return _money(pivot.cells(t(spark, d, "orders"), PivotSpec("o_orderdate", None, "o_totalprice", "COUNT+SUM", unit)), "sum")

    QUERIES[f"pivot_{unit}"], ORACLES[f"pivot_{unit}"] = QUERIES.pop("run"), ORACLES.pop("run")


_dated("month", "strftime(o_orderdate, '%Y-%m')")
_dated("quarter", "strftime(o_orderdate, '%Y') || '-Q' || quarter(o_orderdate)")
_dated("year", "strftime(o_orderdate, '%Y')")
_dated("century", "CAST(year(o_orderdate) // 100 AS VARCHAR) || 'xx'")


@query("SELECT event_type AS row_key, strftime(ts, '%Y-%m-%d') AS col_key, count(*) AS count FROM events GROUP BY 1, 2")
def pivot_auto_date(spark, d):
    return pivot.cells(t(spark, d, "events"), PivotSpec("event_type", "ts"))


@query("""SELECT key, round(total, 2) AS total, row_number() OVER (ORDER BY total DESC, key) AS place FROM (SELECT strftime(o_orderdate, '%Y') AS key, sum(o_totalprice) AS total FROM orders GROUP BY 1)""")
def pivot_sorted_by_value(spark, d):
    return _money(pivot.axis(t(spark, d, "orders"), PivotSpec("o_orderdate", None, "o_totalprice", "SUM", "year", row_sort="VAL_DESC")), "total")


@query("SELECT o_orderkey FROM orders WHERE year(o_orderdate) = 1997 AND o_orderstatus = 'F'")
def pivot_drilldown(spark, d):
    return pivot.drill_down(t(spark, d, "orders"), PivotSpec("o_orderdate", "o_orderstatus", date_group="year"), "1997", "F").select("o_orderkey")


_WHOLE = "CAST(floor(o_totalprice) AS BIGINT)"
_AMOUNT = f"CASE o_orderkey % 7 WHEN 0 THEN 0.0 WHEN 1 THEN 0.0 WHEN 2 THEN -{_WHOLE} WHEN 3 THEN {_WHOLE} + 0.5 ELSE {_WHOLE} END"


@query(f"""SELECT o_orderstatus AS row_key, o_orderpriority AS col_key, sum(CAST({_AMOUNT} AS DOUBLE)) AS sum, round(avg(CAST({_AMOUNT} AS DOUBLE)), 4) AS avg
FROM orders WHERE o_orderkey % 11 <> 0 GROUP BY 1, 2""")
def pivot_money(spark, d):
    whole = F.floor("o_totalprice").cast("string")
    grouped = F.regexp_replace(whole, r"(\d)(?=(\d{3})+$)", "$1 ")
    cells = (F.lit(""), F.lit("n/a"), F.concat(F.lit("-"), whole, F.lit(" EUR")), F.concat(whole, F.lit(",5")), F.concat(F.lit("$"), grouped), whole, F.concat(grouped, F.lit(" $")))
    amount = F.element_at(F.array(*cells), (F.col("o_orderkey") % 7 + 1).cast("int"))
    df = t(spark, d, "orders").select(F.when(F.col("o_orderkey") % 11 == 0, "").otherwise(F.col("o_orderstatus")).alias("r"), F.col("o_orderpriority").alias("c"), amount.alias("amount"))
    return rounded(pivot.cells(df, PivotSpec("r", "c", "amount", "SUM+AVG", extra={"money": True})), avg=4)


@query("SELECT l_linestatus AS series, l_returnflag AS x, round(sum(l_quantity), 2) AS y FROM lineitem GROUP BY 1, 2")
def pivot_series(spark, d):
    return _money(pivot.series(t(spark, d, "lineitem"), PivotSpec("l_returnflag", "l_linestatus", "l_quantity", "SUM")), "y")


# ---------------------------------------------------------------------------------------------------------- statistics


@query("""SELECT count(*) AS total, count(l_extendedprice) AS valid, CAST(0 AS BIGINT) AS empty, 100.0::DOUBLE AS valid_pct, round(sum(l_extendedprice), 2) AS sum, round(avg(l_extendedprice), 4) AS mean,
min(l_extendedprice) AS min, max(l_extendedprice) AS max, round(median(l_extendedprice), 4) AS median, count(DISTINCT l_extendedprice) AS n_unique FROM lineitem""")
def stats_numeric(spark, d):
    return rounded(stats.summary(t(spark, d, "lineitem"), "l_extendedprice"), sum=2, mean=4, median=4)


@query("SELECT p_type AS value, count(*) AS count, round(count(*) * 100.0 / (SELECT count(*) FROM part), 6) AS pct FROM part GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 1")
def stats_mode(spark, d):
    return rounded(stats.mode(t(spark, d, "part"), "p_type"), pct=6)


@query("""WITH c AS (SELECT CAST(p_size AS VARCHAR) AS value, count(*) AS count FROM part GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY count DESC, value) AS place FROM c)
SELECT least(place, 11) AS place, CASE WHEN place <= 10 THEN value ELSE 'Others' END AS value, CAST(sum(count) AS BIGINT) AS count, round(sum(count) * 100.0 / (SELECT count(*) FROM part), 6) AS pct FROM r GROUP BY 1, 2""")
def freq_top10_others(spark, d):
    return rounded(stats.top_and_others(t(spark, d, "part"), "p_size"), pct=6)


@query("SELECT p_brand AS value, count(*) AS count, round(count(*) * 100.0 / (SELECT count(*) FROM part), 6) AS pct FROM part GROUP BY 1")
def freq_full(spark, d):
    return rounded(stats.frequency_list(t(spark, d, "part"), "p_brand", "VALUE_ASC"), pct=6)


@query("""WITH e AS (SELECT min(l_extendedprice) AS lo, (max(l_extendedprice) - min(l_extendedprice)) / 30 AS w FROM lineitem)
SELECT CAST(least(floor((l_extendedprice - lo) / w), 29) AS BIGINT) AS bin, count(*) AS count FROM lineitem, e GROUP BY 1""")
def histogram30(spark, d):
    return stats.histogram(t(spark, d, "lineitem"), "l_extendedprice").select(F.col("bin").cast("long"), "count")


@query("SELECT 'quarter' AS unit, strftime(o_orderdate, '%Y') || ' Q' || quarter(o_orderdate) AS bucket, count(*) AS count FROM orders GROUP BY 2")
def date_distribution_adaptive(spark, d):
    return stats.date_distribution(t(spark, d, "orders"), "o_orderdate")


@query("SELECT 'month' AS unit, strftime(ts, '%Y-%m') AS bucket, count(*) AS count FROM events GROUP BY 2")
def date_distribution_months(spark, d):
    return stats.date_distribution(t(spark, d, "events"), "ts")


_P = (1, 5, 10, 25, 50, 75, 90, 95, 99)


@query("SELECT " + ", ".join(f"round(quantile_cont(l_extendedprice, {p / 100}), 4) AS p{p}" for p in _P) + ", round(quantile_cont(l_extendedprice, 0.75) - quantile_cont(l_extendedprice, 0.25), 4) AS iqr, round(stddev_samp(l_extendedprice), 4) AS stddev, round(avg(l_extendedprice), 4) AS mean FROM lineitem")
def percentile_breakdown(spark, d):
    return rounded(stats.percentiles(t(spark, d, "lineitem"), "l_extendedprice"), **{f"p{p}": 4 for p in _P}, iqr=4, stddev=4, mean=4)


@query("""WITH p AS (SELECT value, row_number() OVER (ORDER BY value) AS pos, count(*) OVER () AS n FROM events)
SELECT (pos - 1) * 20 // n AS block, count(*) AS count, round(avg(value), 4) AS mean, min(value) AS min, max(value) AS max FROM p GROUP BY 1""")
def trend_blocks(spark, d):
    return rounded(stats.blocks(t(spark, d, "events"), "value").drop("level").withColumn("block", F.col("block").cast("long")), mean=4)


@query(" UNION ALL ".join(f"""SELECT '{c}' AS "column", count(*) AS rows, CAST(0 AS BIGINT) AS nulls, '{k}' AS type, count(DISTINCT {c}) AS n_unique, {f'min({c})::DOUBLE' if k == 'number' else 'NULL::DOUBLE'} AS min, {f'max({c})::DOUBLE' if k == 'number' else 'NULL::DOUBLE'} AS max,
{f'round(avg({c}), 4)' if k == 'number' else 'NULL'} AS mean, {f'round(stddev_samp({c}), 4)' if k == 'number' else 'NULL'} AS stddev FROM customer""" for c, k in (("c_custkey", "number"), ("c_name", "string"), ("c_nationkey", "number"), ("c_acctbal", "number"), ("c_mktsegment", "string"))))
def profile_table(spark, d):
    return rounded(profile.profile(t(spark, d, "customer")).drop("null_pct"), mean=4, stddev=4)


@query(" UNION ALL ".join(f"""SELECT '{c}' AS "column", count(*) FILTER ({c} < m - 2 * s OR {c} > m + 2 * s) AS outliers FROM customer, (SELECT avg({c}) AS m, stddev_samp({c}) AS s FROM customer)""" for c in ("c_acctbal", "c_nationkey")))
def profile_outliers(spark, d):
    return profile.outlier_counts(t(spark, d, "customer").select("c_acctbal", "c_nationkey"), 2.0)


@query(" UNION ALL ".join(f"""SELECT * FROM (SELECT '{c}' AS "column", row_number() OVER (ORDER BY count(*) DESC, {c}) AS place, {c} AS value, count(*) AS count FROM documents GROUP BY {c}) WHERE place <= 5""" for c in ("lang", "source")))
def profile_top5(spark, d):
    return profile.top_values(t(spark, d, "documents"), 5, ["lang", "source"]).select("column", "place", "value", "count")


@query("""WITH p AS (SELECT * FROM (VALUES ('l_quantity'), ('l_extendedprice'), ('l_discount')) a(a), (VALUES ('l_quantity'), ('l_extendedprice'), ('l_discount')) b(b)),
v AS (SELECT corr(l_quantity, l_extendedprice) AS qe, corr(l_quantity, l_discount) AS qd, corr(l_extendedprice, l_discount) AS ed FROM lineitem)
SELECT a, b, round(CASE WHEN a = b THEN 1.0 WHEN a || b IN ('l_quantityl_extendedprice', 'l_extendedpricel_quantity') THEN qe WHEN a || b IN ('l_quantityl_discount', 'l_discountl_quantity') THEN qd ELSE ed END, 6) + 0.0 AS r FROM p, v""")
def corr_matrix(spark, d):
    return explore.correlations(t(spark, d, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount"]).withColumn("r", F.round("r", 6) + 0.0)


@query("SELECT count(*) AS n, round(corr(l_quantity, l_extendedprice), 6) AS r FROM lineitem")
def scatter_r(spark, d):
    return rounded(explore.scatter_r(t(spark, d, "lineitem"), "l_quantity", "l_extendedprice"), r=6)


@query("""WITH s AS (SELECT avg(value) AS m, stddev_samp(value) AS s FROM events)
SELECT event_id AS key, 'value' AS "column", value, round((value - m) / s, 6) AS z FROM events, s WHERE abs((value - m) / s) >= 2""")
def outlier_rows(spark, d):
    return rounded(explore.outliers(t(spark, d, "events").select("event_id", "value"), "event_id", 2.0), z=6)


@query("""WITH p AS (SELECT row_number() OVER (ORDER BY event_id) AS pos, value AS y FROM events), s AS (SELECT avg(y) AS m, stddev_pop(y) AS s FROM p) SELECT pos, y FROM p, s WHERE abs(y - m) / s > 2""")
def series_anomalies(spark, d):
    return explore.anomalies(explore.series(t(spark, d, "events"), "value", "event_id"), 2.0).select("pos", "y")


@query("SELECT min(p_retailprice) AS min, round(quantile_cont(p_retailprice, 0.25), 4) AS q1, round(median(p_retailprice), 4) AS median, round(quantile_cont(p_retailprice, 0.75), 4) AS q3, max(p_retailprice) AS max FROM part")
def box_five_number(spark, d):
    return rounded(explore.five_numbers(t(spark, d, "part"), "p_retailprice"), q1=4, median=4, q3=4)


@query("""WITH c AS (SELECT p_brand AS v, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, p_brand) AS r FROM part GROUP BY 1) SELECT CASE WHEN r < 8 THEN v ELSE 'Other' END AS label, CAST(sum(n) AS BIGINT) AS count FROM c GROUP BY 1""")
def donut_top8_other(spark, d):
    return explore.donut(t(spark, d, "part"), "p_brand", 8)


@query("SELECT strftime(o_orderdate, '%Y-%m') AS month, round(sum(o_totalprice), 2) AS y FROM orders GROUP BY 1")
def monthly_series(spark, d):
    return _money(explore.monthly(t(spark, d, "orders"), "o_orderdate", "o_totalprice"), "y")


_POINTS = "WITH p AS (SELECT row_number() OVER (ORDER BY o_orderkey) AS pos, o_totalprice AS y FROM orders)"


def _points(spark, d) -> DataFrame:
    return explore.series(t(spark, d, "orders"), "o_totalprice", "o_orderkey")


@query(f"{_POINTS} SELECT (SELECT pos FROM p ORDER BY y, pos LIMIT 1) AS pos_min, min(y) AS y_min, (SELECT pos FROM p ORDER BY y DESC, pos LIMIT 1) AS pos_max, max(y) AS y_max FROM p")
def series_argminmax(spark, d):
    return explore.extremes(_points(spark, d))


@query(f"{_POINTS} SELECT pos, y FROM p WHERE (pos - 1) % 100 = 0 OR pos = (SELECT pos FROM p ORDER BY y, pos LIMIT 1) OR pos = (SELECT pos FROM p ORDER BY y DESC, pos LIMIT 1)")
def downsample(spark, d):
    return explore.downsampled(_points(spark, d), 100).select("pos", "y")


@query(f"{_POINTS} SELECT count(*) AS n, min(y) AS lo, max(y) AS hi FROM p WHERE pos BETWEEN 200 AND 400")
def series_zoom(spark, d):
    return explore.window(_points(spark, d), 200, 400).agg(F.count(F.lit(1)).alias("n"), F.min("y").alias("lo"), F.max("y").alias("hi"))


@query(f"{_POINTS} SELECT pos, round(CASE WHEN y > 0 THEN log10(y) / log10((SELECT max(y) FROM p)) ELSE 0 END, 8) AS share FROM p")
def series_log_scale(spark, d):
    return rounded(explore.scaled(_points(spark, d), log=True), share=8)


@query("SELECT 1 AS axis, min(l_discount) AS lo, max(l_tax) AS hi FROM (SELECT l_discount, l_tax FROM lineitem UNION ALL SELECT l_tax, l_discount FROM lineitem) UNION ALL SELECT 2, min(l_quantity), max(l_quantity) FROM lineitem")
def axis_scales(spark, d):
    return explore.axis_scales(t(spark, d, "lineitem"), {"l_discount": 1, "l_tax": 1, "l_quantity": 2})


@query("SELECT strftime(ts, '%Y-%m-%d') AS x, row_number() OVER (ORDER BY event_id) AS pos, value AS y FROM events")
def series_date_labels(spark, d):
    return explore.series(t(spark, d, "events"), "value", "event_id", "ts").select("x", "pos", "y")


@query("SELECT l_quantity AS x, l_extendedprice AS y FROM lineitem ORDER BY abs(l_quantity - 17.2), l_extendedprice LIMIT 1")
def nearest_point(spark, d):
    return explore.nearest(explore.scatter(t(spark, d, "lineitem"), "l_quantity", "l_extendedprice"), 17.2)


# ------------------------------------------------------------------------------------------------------ dedup, sources


@query("SELECT event_id, user_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS r FROM events) WHERE r = 1")
def dedup_first(spark, d):
    return dedup.dedup(t(spark, d, "events"), ["user_id", "event_type"], tie="event_id").select("event_id", "user_id", "event_type")


@query("SELECT event_id, user_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM events) WHERE r = 1")
def dedup_last(spark, d):
    return dedup.dedup(t(spark, d, "events"), ["user_id"], "last", "event_id").select("event_id", "user_id")


@query("SELECT event_id, user_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS r FROM events) WHERE r = 1")
def dedup_after_sort(spark, d):
    return View(t(spark, d, "events"), "event_id").order("value desc").unique("user_id").rows().select("event_id", "user_id")


@query("SELECT min(doc_id) AS doc_id, text FROM documents GROUP BY text, lang")
def dedup_all_cols(spark, d):
    return dedup.dedup(t(spark, d, "documents").select("doc_id", "text", "lang"), tie="doc_id").select("doc_id", "text")


@query("SELECT count(DISTINCT user_id) AS kept, count(*) - count(DISTINCT user_id) AS removed FROM events")
def dedup_summary(spark, d):
    df = t(spark, d, "events")
    return dedup.summary(df, dedup.dedup(df, ["user_id"], tie="event_id"))


@query("SELECT 'nation' AS source_file, CAST(n_nationkey AS VARCHAR) AS id, n_name AS name FROM nation UNION ALL SELECT 'region', CAST(r_regionkey AS VARCHAR), r_name FROM region")
def concat_with_source(spark, d):
    nation = t(spark, d, "nation").select(F.col("n_nationkey").cast("string").alias("id"), F.col("n_name").alias("name"))
    region = t(spark, d, "region").select(F.col("r_regionkey").cast("string"), "r_name")
    return writers.concat([("nation", nation), ("region", region)])


@query("SELECT o_orderpriority AS split_key, regexp_replace(o_orderpriority, '[^A-Za-z0-9._-]', '_', 'g') AS file_name, count(*) AS rows FROM orders GROUP BY 1")
def split_manifest(spark, d):
    return writers.split_manifest(t(spark, d, "orders"), "o_orderpriority")


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def ndjson_cells(spark, d):
    return t(spark, d, "events").select("event_id", F.from_json("props", "map<string,string>")["k"].cast("long").alias("k"))


@query("SELECT n_nationkey, '{\"n_nationkey\":' || n_nationkey || ',\"n_name\":\"' || n_name || '\"}' AS value FROM nation")
def ndjson_rows(spark, d):
    df = t(spark, d, "nation")
    made = writers.json_rows(df.select("n_nationkey", "n_name"))
    return made.select(F.get_json_object("value", "$.n_nationkey").cast("int").alias("n_nationkey"), "value")


#: Text cells of orders: dates with gaps, numbers with a comma, keys with leading zeros, one number in five spoiled, nothing.
_CELLS = """SELECT CASE WHEN o_orderkey % 50 = 0 THEN 'NA' WHEN o_orderkey % 97 = 1 THEN 'soon' ELSE strftime(o_orderdate, '%d.%m.%Y') END AS day,
CASE WHEN o_orderkey % 89 = 1 THEN 'many' ELSE replace(CAST(CAST(floor(o_totalprice) AS BIGINT) AS VARCHAR) || '.5', '.', ',') END AS price, '00' || o_custkey AS zip,
CASE WHEN o_orderkey % 5 = 0 THEN 'x' ELSE '' END || o_orderkey AS spoiled, CASE o_orderkey % 3 WHEN 0 THEN '' WHEN 1 THEN 'NA' ELSE '-' END AS blank, o_orderpriority AS name FROM orders"""


def _text_cells(spark: SparkSession, d: str) -> DataFrame:
    at = lambda n, k: F.col("o_orderkey") % n == k
    return t(spark, d, "orders").select(
        F.when(at(50, 0), "NA").when(at(97, 1), "soon").otherwise(F.date_format("o_orderdate", "dd.MM.yyyy")).alias("day"),
        F.when(at(89, 1), "many").otherwise(F.concat(F.floor("o_totalprice").cast("string"), F.lit(",5"))).alias("price"),
        F.concat(F.lit("00"), F.col("o_custkey").cast("string")).alias("zip"),
        F.concat(F.when(at(5, 0), "x").otherwise(""), F.col("o_orderkey").cast("string")).alias("spoiled"),
        F.when(at(3, 0), "").when(at(3, 1), "NA").otherwise("-").alias("blank"),
        F.col("o_orderpriority").alias("name"),
    )


@query(f"""WITH cells AS (SELECT unnest(['day', 'price', 'zip', 'spoiled', 'blank', 'name']) AS "column", unnest([day, price, zip, spoiled, blank, name]) AS v FROM ({_CELLS})),
shares AS (SELECT "column", count(*) FILTER (v NOT IN ('', 'NA', '-')) AS n, count(*) FILTER (regexp_full_match(v, '[0-9]{{2}}\\.[0-9]{{2}}\\.[0-9]{{4}}')) AS dates,
count(*) FILTER (regexp_full_match(v, '[0-9]+(,[0-9]+)?') AND NOT regexp_matches(v, '^0[0-9]')) AS numbers FROM cells GROUP BY 1)
SELECT "column", CASE WHEN n = 0 THEN 'text' WHEN dates >= 0.9 * n THEN 'date' WHEN numbers >= 0.9 * n THEN 'number' ELSE 'text' END AS type FROM shares""")
def type_inference(spark, d):
    return spark.createDataFrame(list(readers.infer_types(_text_cells(spark, d)).items()), "column string, type string")


@query("SELECT o_orderkey, CAST(CAST(round(CAST(o_totalprice AS DECIMAL(18, 2)), 1) AS DECIMAL(18, 1)) AS VARCHAR) AS price, strftime(o_orderdate, '%d.%m.%Y') AS day FROM orders")
def format_number_date(spark, d):
    df = t(spark, d, "orders").select("o_orderkey", F.col("o_totalprice").cast("string").alias("price"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"))
    return edit.format_cells(df, {"price": numbers.fixed(F.col("price"), 1), "day": formatted(F.col("day"), "%d.%m.%Y")})


@query("SELECT key, y, row_number() OVER (ORDER BY y DESC, key) AS place FROM (SELECT p_brand AS key, round(sum(p_retailprice), 2) AS y FROM part GROUP BY 1)")
def bar_groups(spark, d):
    return rounded(explore.ranked_groups(t(spark, d, "part"), "p_brand", "p_retailprice"), y=2)


@query("SELECT n_nationkey, n_name, CASE n_nationkey WHEN 2 THEN 'a' ELSE 'z' END AS sign FROM nation WHERE n_nationkey IN (2, 11)")
def bookmarks(spark, d):
    view = View(t(spark, d, "nation"), "n_nationkey").bookmark("a", 2).bookmark("z", 11)
    return view.bookmarked().select("n_nationkey", "n_name", "sign")


# --------------------------------------------------------------------------------------------------------------- files


_NOTE = """CASE p_partkey % 5 WHEN 0 THEN 'say "' || p_name || '", ' || p_brand WHEN 1 THEN '  ' || p_name || ' ' WHEN 2 THEN '' WHEN 3 THEN NULL ELSE ' ' END"""


@query(f"SELECT p_partkey, p_name, p_size, p_retailprice, {_NOTE} AS note, row_number() OVER (ORDER BY p_partkey) - 1 AS pos FROM part")
def csv_roundtrip(spark, d):
    """Quotes, delimiters, blanks at the ends, empty and missing cells come back, in the order in which they were written."""
    notes = (F.concat(F.lit('say "'), "p_name", F.lit('", '), "p_brand"), F.concat(F.lit("  "), "p_name", F.lit(" ")), F.lit(""), F.lit(None), F.lit(" "))
    part = t(spark, d, "part").select("p_partkey", "p_name", "p_size", "p_retailprice", F.element_at(F.array(*notes), (F.col("p_partkey") % 5 + 1).cast("int")).alias("note"))
    path = new_path(spark, "part.csv")
    writers.write(part.orderBy("p_partkey"), path)
    back = readers.read(spark, path, row_id=True)
    return back.select(F.col("p_partkey").cast("long"), "p_name", F.col("p_size").cast("int"), F.col("p_retailprice").cast("double"), "note", F.col(readers.ROW_ID).cast("long").alias("pos"))


@query("SELECT o_orderkey, o_orderpriority, row_number() OVER (ORDER BY o_orderkey % 4 = 3, o_orderkey) - 1 AS pos FROM orders")
def physical_order(spark, d):
    """Two files of unlike size, which Spark would read the larger first: rows by file name, then line."""
    orders, folder = t(spark, d, "orders").select("o_orderkey", "o_orderpriority"), new_path(spark, "parts")
    for name, small in (("a.csv", False), ("b.csv", True)):
        writers.write(orders.filter((F.col("o_orderkey") % 4 == 3) == small).orderBy("o_orderkey"), f"{folder}/{name}")
    back = readers.read_delimited(spark, f"{folder}/*", row_id=True)
    return back.select(F.col("o_orderkey").cast("long"), "o_orderpriority", F.col(readers.ROW_ID).cast("long").alias("pos"))


@query("""SELECT p_partkey, '{"p_partkey":' || p_partkey || ',"size":' || p_size || ',"code":"0' || p_size || '","flag":' || CASE p_partkey % 4 WHEN 0 THEN 'true' WHEN 1 THEN 'false' WHEN 2 THEN 'null' ELSE '"' || p_brand || '"' END || '}' AS value FROM part""")
def ndjson_of_text_cells(spark, d):
    """A table of text cells, as a CSV file gives them, to JSON lines: numbers, true, false and null are bare."""
    flag = F.element_at(F.array(F.lit("true"), F.lit("false"), F.lit("null"), F.col("p_brand")), (F.col("p_partkey") % 4 + 1).cast("int"))
    cells = t(spark, d, "part").select(F.col("p_partkey").cast("string").alias("p_partkey"), F.col("p_size").cast("string").alias("size"), F.concat(F.lit("0"), "p_size").alias("code"), flag.alias("flag"))
    path = new_path(spark, "part.ndjson")
    writers.write(cells, path)
    return spark.read.text(path).select(F.get_json_object("value", "$.p_partkey").cast("long").alias("p_partkey"), "value")


@query("SELECT event_id, event_type, value, CAST(json_extract(props, '$.k') AS BIGINT) AS k, CASE WHEN event_id % 997 = 5 THEN 'late' END AS late FROM events")
def ndjson_roundtrip(spark, d):
    events = t(spark, d, "events").select("event_id", "event_type", "value", "props", F.when(F.col("event_id") % 997 == 5, "late").alias("late"))
    path = new_path(spark, "events.ndjson")
    writers.write(events, path)
    back = readers.read(spark, path, sep=";")
    return back.select(F.col("event_id").cast("long"), "event_type", F.col("value").cast("double"), F.from_json("props", "map<string,string>")["k"].cast("long").alias("k"), "late")


@query("SELECT o_orderpriority AS split_key, count(*) AS rows, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1")
def split_files(spark, d):
    path = new_path(spark, "split")
    writers.split(t(spark, d, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice"), "o_orderpriority", path, drop=True)
    parts = spark.read.option("header", True).schema("o_orderkey long, o_totalprice double, split_key string").csv(path)
    return _money(parts.groupBy("split_key").agg(F.count(F.lit(1)).alias("rows"), F.sum("o_totalprice").alias("total")), "total")


@query("SELECT 'nation' AS source_file, CAST(n_nationkey AS VARCHAR) AS id, n_name AS name FROM nation UNION ALL SELECT 'region', CAST(r_regionkey AS VARCHAR), r_name FROM region")
def concat_files(spark, d):
    folder = new_path(spark, "files")
    writers.write(t(spark, d, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name")), f"{folder}/nation.tsv")
    writers.write(t(spark, d, "region").select(F.col("r_regionkey").alias("id"), F.col("r_name").alias("name")), f"{folder}/region.tsv")
    return writers.concat_files(spark, [f"{folder}/nation.tsv", f"{folder}/region.tsv"])


@query("SELECT c_mktsegment, count(*) AS n FROM customer GROUP BY 1")
def column_file(spark, d):
    path = new_path(spark, "segments.psv")
    writers.write_column(t(spark, d, "customer"), "c_mktsegment", path)
    return readers.read(spark, path).groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT p_partkey, p_size FROM part WHERE p_size > 25")
def view_file(spark, d):
    path = new_path(spark, "view.jsonl")
    writers.write(View(t(spark, d, "part"), "p_partkey").where("p_size > 25").hide("p_name", "p_brand", "p_type", "p_retailprice").order("p_size desc").df(), path)
    return readers.read(spark, path).select(F.col("p_partkey").cast("long"), F.col("p_size").cast("int"))


@query("SELECT p_partkey, row_number() OVER (ORDER BY p_partkey) AS pos FROM part")
def parquet_row_ids(spark, d):
    return numbered(readers.read(spark, f"{d}/part.parquet", row_id=True), [F.col(readers.ROW_ID)]).select("p_partkey", "pos")


@query(f"""SELECT 'day' AS "column", count(*) FILTER (day = 'soon') AS misfits FROM ({_CELLS}) UNION ALL SELECT 'price', count(*) FILTER (price = 'many') FROM ({_CELLS})""")
def type_misfits(spark, d):
    df = _text_cells(spark, d)
    return readers.misfits(df, readers.infer_types(df))


_SHOWN = ", ".join(
    f"""printf('%.2f', coalesce(sum(l_quantity) FILTER (l_linestatus = '{k}'), 0)) AS "{k}_SUM", CAST(count(*) FILTER (l_linestatus = '{k}') AS VARCHAR) AS "{k}_COUNT",
coalesce(printf('%.2f', min(l_quantity) FILTER (l_linestatus = '{k}')), '\u2014') AS "{k}_MIN" """
    for k in "FO"
)


@query(f"SELECT l_returnflag AS \"Row\", row_number() OVER (ORDER BY l_returnflag) AS row_place, {_SHOWN} FROM lineitem GROUP BY 1")
def pivot_display(spark, d):
    spec = PivotSpec("l_returnflag", "l_linestatus", "l_quantity", "SUM+COUNT+MIN", row_totals=False, column_totals=False)
    return pivot.exported(t(spark, d, "lineitem"), spec)


@query("""SELECT coalesce(o_orderstatus, 'Total') AS "Row", CAST(count(*) FILTER (year(o_orderdate) = 1996) AS VARCHAR) AS "1996", CAST(count(*) FILTER (year(o_orderdate) = 1997) AS VARCHAR) AS "1997",
CAST(count(*) AS VARCHAR) AS "Total", row_number() OVER (ORDER BY o_orderstatus NULLS LAST) AS pos FROM orders WHERE year(o_orderdate) IN (1996, 1997) GROUP BY ROLLUP (o_orderstatus)""")
def pivot_export(spark, d):
    path = new_path(spark, "pivot.csv")
    rows = filters.apply(t(spark, d, "orders"), "o_orderdate >= 1996-01 AND o_orderdate <= 1997-12")
    pivot.export(rows, PivotSpec("o_orderstatus", "o_orderdate", date_group="year"), path)
    return numbered(readers.read(spark, path, row_id=True), [F.col(readers.ROW_ID)]).drop(readers.ROW_ID)


# ---------------------------------------------------------------------------------------------------- drilling, filling


@query("SELECT o_orderkey FROM orders WHERE o_orderpriority = '2-HIGH'")
def frequency_drilldown(spark, d):
    return View(t(spark, d, "orders"), "o_orderkey").where("o_orderstatus = F").drill("o_orderpriority", "2-HIGH").df().select("o_orderkey")


@query("SELECT o_orderkey FROM orders WHERE strftime(o_orderdate, '%Y-%m') = '1997-03' AND o_orderstatus = 'F'")
def pivot_drilldown_text(spark, d):
    text_dates = t(spark, d, "orders").withColumn("day", F.date_format("o_orderdate", "dd.MM.yyyy"))
    spec = PivotSpec("day", "o_orderstatus", date_group="month", extra={"text_dates": True})
    return pivot.drill_down(text_dates, spec, "1997-03", "F").select("o_orderkey")


@query("SELECT c_custkey, round(CASE WHEN c_nationkey < 10 AND contains(lower(c_mktsegment), 'build') THEN c_acctbal * 2 ELSE c_acctbal END, 4) AS c_acctbal FROM customer")
def fill_searched_view(spark, d):
    view = View(t(spark, d, "customer"), "c_custkey").where("c_nationkey < 10").search("BUILD").fill("c_acctbal", "c_acctbal * 2")
    return rounded(view.base.select("c_custkey", "c_acctbal"), c_acctbal=4)


@query("SELECT o_orderkey, CASE WHEN o_orderkey = min(o_orderkey) OVER (PARTITION BY o_custkey) THEN 0.0::DOUBLE ELSE o_totalprice END AS o_totalprice FROM orders")
def fill_unique_view(spark, d):
    return View(t(spark, d, "orders"), "o_orderkey").unique("o_custkey").fill("o_totalprice", "0").base.select("o_orderkey", "o_totalprice")


@query("SELECT o_custkey, max(o_totalprice) AS o_totalprice FROM orders GROUP BY 1")
def dedup_last_view(spark, d):
    return dedup.dedup(t(spark, d, "orders"), ["o_custkey"], "last", view="o_totalprice").select("o_custkey", "o_totalprice")


@query("SELECT o_orderkey, strftime(o_orderdate, '%d of %m, ''%y') AS shown FROM orders")
def format_date_words(spark, d):
    return t(spark, d, "orders").select("o_orderkey", formatted(F.date_format("o_orderdate", "yyyy-MM-dd"), "%d of %m, '%y").alias("shown"))


@query("SELECT o_orderkey FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 3 OFFSET (SELECT greatest(0, least(count(*), 6000) - 10) FROM orders)")
def far_page(spark, d):
    orders = t(spark, d, "orders")
    return sorting.page(orders, "o_totalprice", "o_orderkey", max(0, min(orders.count(), 6000) - 10), 3).select("o_orderkey")


@query("SELECT o_orderkey, CAST(rank() OVER (ORDER BY o_shippriority DESC NULLS LAST) AS DOUBLE) * CAST(o_shippriority IS NOT NULL AS INT) AS r FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN NULL WHEN o_orderkey % 3 = 1 THEN 7.0 ELSE o_totalprice END AS o_shippriority FROM orders)")
def cf_rank_hot(spark, d):
    price = F.when(F.col("o_orderkey") % 3 == 1, F.lit(7.0)).when(F.col("o_orderkey") % 3 == 2, F.col("o_totalprice"))
    return formulas.compute(t(spark, d, "orders").select("o_orderkey", price.alias("p")), "r", "col_rank(p)").select("o_orderkey", "r")


@query("SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS place FROM orders QUALIFY place BETWEEN 101 AND 140 OR place IN (300, 1200)")
def indexed_pages(spark, d):
    """Two pages and two rows of a view whose order is kept."""
    index = View(t(spark, d, "orders"), "o_orderkey").order("o_totalprice desc").indexed()
    found = index.page(100, 20).unionByName(index.page(120, 20)).unionByName(index.row(300)).unionByName(index.row(1200)).select("o_orderkey")
    return found.join(index.rows.select("o_orderkey", F.col(index.place).alias("place")), "o_orderkey")


# ------------------------------------------------------------------------------------------- text of cells and small helpers


@query("""SELECT o_orderkey, replace(format('{:,}', x), ',', ' ') AS thousands, CASE WHEN x >= 1e6 THEN printf('%.1fM', x / 1e6) WHEN x >= 1e3 THEN printf('%.1fK', x / 1e3) ELSE CAST(x AS VARCHAR) END AS short,
CASE WHEN o_orderkey % 2 = 0 THEN CAST(x // 2 AS VARCHAR) ELSE CAST(x // 2 AS VARCHAR) || '.5' END AS shown, CASE WHEN length(o_orderpriority) > 5 THEN o_orderpriority[1:5] || '...' ELSE o_orderpriority END AS cut
FROM (SELECT *, CAST(floor(o_totalprice / 100) AS BIGINT) * 100 + 30 + o_orderkey % 2 AS x FROM orders)""")
def shown_numbers(spark, d):
    x = (F.floor(F.col("o_totalprice") / 100) * 100 + 30 + F.col("o_orderkey") % 2).cast("double")
    orders = formulas.compute(t(spark, d, "orders").withColumn("x", x), "half", "x / 2")
    return orders.select("o_orderkey", numbers.thousands(F.col("x")).alias("thousands"), numbers.short(F.col("x")).alias("short"), numbers.shown(F.col("half")).alias("shown"), numbers.truncated(F.col("o_orderpriority"), 5).alias("cut"))


@query("SELECT min(o_orderkey) AS o_orderkey, o_custkey FROM orders GROUP BY o_custkey")
def dedup_by_number(spark, d):
    return dedup.dedup(t(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice"), [2], tie="o_orderkey").select("o_orderkey", "o_custkey")


@query("SELECT n_nationkey, n_name FROM nation")
def view_reset(spark, d):
    view = View(t(spark, d, "nation"), "n_nationkey").where("n_regionkey = 1").search("a").order("n_name desc").unique("n_regionkey")
    return view.reset().df().select("n_nationkey", "n_name")


@query("SELECT o_orderkey FROM orders WHERE o_totalprice > 200000 AND o_orderstatus = 'F'")
def saved_filter(spark, d):
    """A filter that was saved with a view, read back and applied."""
    orders = t(spark, d, "orders")
    saved = View(orders, "o_orderkey").where("o_totalprice > 200000 AND o_orderstatus = F").save_filter().where("o_orderkey < 5").spec.dumps()
    spec = ViewSpec.loads(saved)
    return View(orders, "o_orderkey", spec).where(spec.saved_filters[0]).df().select("o_orderkey")


@query("""SELECT row_number() OVER (ORDER BY p_partkey, "column") AS n, p_partkey AS key, "column", lead(p_partkey) OVER (ORDER BY p_partkey, "column") AS next_key
FROM (SELECT p_partkey, 'p_brand' AS "column", p_brand AS v FROM part UNION ALL SELECT p_partkey, 'p_name', p_name FROM part UNION ALL SELECT p_partkey, 'p_type', p_type FROM part
UNION ALL SELECT p_partkey, 'p_partkey', CAST(p_partkey AS VARCHAR) FROM part) WHERE contains(lower(v), '1')""")
def next_hits(spark, d):
    view = View(t(spark, d, "part").select("p_partkey", "p_name", "p_brand", "p_type"), "p_partkey")
    return view.numbered_hits("1").select("n", "key", "column", "next_key")


def _text_file(rows: DataFrame, order: str, path: str) -> None:
    """The lines (line) of a small table in their order, as one file."""
    lines = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, "line"))), lambda x: x["line"]), "\n")
    rows.agg(lines.alias("value")).write.text(path)


@query("SELECT CAST(n_nationkey AS VARCHAR) AS id, n_name AS name, 'one' AS comments FROM nation")
def sniffed_file(spark, d):
    """A file of an unknown kind: a line of comment, and cells between semicolons."""
    nation, path = t(spark, d, "nation"), new_path(spark, "nation.dat")
    head = spark.range(1).selectExpr("-1 n", "'# one\nid;name' line")
    _text_file(nation.select(F.col("n_nationkey").alias("n"), F.concat_ws(";", "n_nationkey", "n_name").alias("line")).unionByName(head), "n", path)
    comment = readers.read_comments(spark, path).select(F.substring("text", 3, 10).alias("comments"))
    return readers.read(spark, path, sniff=True, comments=True).crossJoin(F.broadcast(comment))  # one row


@query("SELECT CAST(r_regionkey AS VARCHAR) AS id, r_name AS name FROM region")
def declared_delimiter(spark, d):
    """An ECSV file whose head names the delimiter."""
    region, path = t(spark, d, "region"), new_path(spark, "region.ecsv")
    head = spark.range(1).selectExpr("-1 n", "'# %ECSV 1.0\n# delimiter: ''|''\nid|name' line")
    _text_file(region.select(F.col("r_regionkey").alias("n"), F.concat_ws("|", "r_regionkey", "r_name").alias("line")).unionByName(head), "n", path)
    return readers.read(spark, path)


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 10 = 0 THEN CAST(o_custkey AS DOUBLE) WHEN o_orderkey % 10 = 3 THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice,
CASE WHEN o_orderkey = 7 THEN NULL WHEN o_orderkey BETWEEN 20 AND 39 THEN 'edit ' || o_orderkey ELSE o_orderstatus END AS o_orderstatus FROM orders WHERE o_orderkey <> 11""")
def undo_edits(spark, d):
    """Edits of many cells and of single ones, a deleted row, and the last two edits undone."""
    orders = t(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderstatus")
    some = lambda k, value: orders.filter(F.col("o_orderkey") % 10 == k).select(F.col("o_orderkey").alias("key"), value.alias("value"))
    log = edit.EditLog(orders, "o_orderkey").set_all(some(3, F.col("o_totalprice") + 1), "o_totalprice").set_all(some(0, F.lit(-1.0)), "o_totalprice")
    log = log.set_all(some(0, F.col("o_custkey").cast("double")), "o_totalprice").delete(11).set(7, "o_orderstatus", "x").set(7, "o_orderstatus", None)
    for k in range(20, 40):
        log = log.set(k, "o_orderstatus", f"edit {k}")
    log = log.delete(12).set_all(some(3, F.lit(0.0)), "o_totalprice").undo(2)
    return log.df().select("o_orderkey", "o_totalprice", "o_orderstatus")


_PROFILED = "UNION ALL ".join(
    f"""SELECT '{c}' AS "column", count(*) AS rows, count(*) - count({c}) AS nulls, '{kind}' AS type, {f"CAST(min({c}) AS DOUBLE)" if kind == "number" else "CAST(NULL AS DOUBLE)"} AS min,
    {f"CAST(max({c}) AS DOUBLE)" if kind == "number" else "NULL"} AS max, {f"round(avg({c}), 4)" if kind == "number" else "NULL"} AS mean, {f"round(stddev_samp({c}), 4)" if kind == "number" else "NULL"} AS stddev, true AS near FROM customer """
    for c, kind in (("c_custkey", "number"), ("c_name", "string"), ("c_nationkey", "number"), ("c_acctbal", "number"), ("c_mktsegment", "string"))
)


@query(_PROFILED)
def profile_of_parts(spark, d):
    """A profile by sketches, of three parts; ``near``: the distinct values are estimated to five percent."""
    customer = t(spark, d, "customer")
    found = profile.parts(customer.filter("c_custkey % 3 = 0")).unionByName(profile.parts(customer.filter("c_custkey % 3 = 1"))).unionByName(profile.parts(customer.filter("c_custkey % 3 = 2")))
    out = profile.merged(found).alias("a").join(profile.profile(customer).select("column", F.col("n_unique").alias("exact")), "column")
    near = F.abs(F.col("n_unique") - F.col("exact")) <= 0.05 * F.col("exact")
    return rounded(out.select("column", "rows", "nulls", "type", "min", "max", "mean", "stddev", near.alias("near")), mean=4, stddev=4)


@query("SELECT event_type AS value, count(*) AS count FROM events GROUP BY 1")
def reloaded_frequencies(spark, d):
    """The frequencies of a folder to which files are added; only new ones are read."""
    events, folder, kept, state = t(spark, d, "events").select("event_id", "event_type"), *(new_path(spark, x) for x in ("arrivals", "counts", "state"))
    for part in range(3):
        events.filter(F.col("event_id") % 3 == part).write.mode("append").parquet(folder)
        stream = spark.readStream.schema(events.schema).parquet(folder)
        streaming.reload(stream, lambda new: stats.frequencies(new, "event_type").drop("pct"), kept, state)
    return streaming.reloaded(spark, kept).groupBy("value").agg(F.sum("count").alias("count"))
