import datetime as dt
import os
import random
from functools import reduce

import pytest

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridlark import streaming
from gridlark.operators import dedup, edit, pivot, profile, sorting, stats
from gridlark.operators.pivot import PivotSpec
from gridlark.plans.view import View
from gridlark.sources import readers, shared, writers


def put(path, text):
    path.write_text(text)
    return str(path)


def cells(df):
    return [tuple(r) for r in df.collect()]


def test_delimited_text(spark, tmp_path):
    path = put(tmp_path / "a.csv", 'name, note ,n\n"Smith, J","said ""hi""",1\r\n  x,,\nshort\nlong,a,b,c\n')
    df = readers.read(spark, path)
    assert df.columns == ["name", "note", "n"]
    assert cells(df) == [("Smith, J", 'said "hi"', "1"), ("x", None, None), ("short", None, None), ("long", "a", "b")]
    assert readers.read_delimited(spark, path, header=False).columns == ["A", "B", "C"]
    assert [r[1] for r in cells(readers.read(spark, path, row_id=True).select("name", readers.ROW_ID))] == [0, 1, 2, 3]


def test_other_delimiters_and_comments(spark, tmp_path):
    want = [("1", "2")]
    assert cells(readers.read(spark, put(tmp_path / "a.tsv", "a\tb\n1\t2\n"))) == want
    assert cells(readers.read(spark, put(tmp_path / "a.psv", "a|b\n1|2\n"))) == want
    assert cells(readers.read(spark, put(tmp_path / "a.ecsv", "# %ECSV 1.0\n# delimiter: ','\na,b\n1,2\n"))) == want
    assert cells(readers.read(spark, put(tmp_path / "b.ecsv", "# %ECSV 1.0\na b\n1 2\n"))) == want
    path = put(tmp_path / "c.csv", "# made by hand\na;b\n1;2\n# after\n")
    assert cells(readers.read(spark, path, sep=";")) == want and cells(readers.read(spark, path, sniff=True)) == want
    assert [r.text for r in readers.read_comments(spark, path).collect()] == ["# made by hand", "# after"]
    assert [readers.sniff_delimiter(x) for x in ("a\tb\tc,d", "a|b|c", "a;b;c", "plain")] == ["\t", "|", ";", ","]


def test_json_lines(spark, tmp_path):
    path = put(tmp_path / "a.ndjson", '{"a": 1, "b": {"x": [1, 2]}, "c": true}\n\n{"b": "\\u00e9", "d": null}\n')
    df = readers.read(spark, path)
    assert df.columns == ["a", "b", "c", "d"]
    assert cells(df) == [("1", '{"x":[1,2]}', "true", None), (None, "é", None, None)]


def test_json_keys_of_late_lines(spark, tmp_path):
    path = put(tmp_path / "late.ndjson", '{"m": 1}\n' * 300 + '{"z": 2, "m": 3}\n{"b": 4}\n')
    df = readers.read(spark, path)
    assert df.columns == ["m", "b", "z"]
    assert cells(df)[-2:] == [("3", None, "2"), (None, "4", None)]


@pytest.mark.parametrize("form", ["csv", "tsv", "ndjson", "parquet"])
def test_round_trips(spark, tmp_path, form):
    rows = [("a, b", 'q"q', "1"), ("ä\tx", "", "2"), ("|;", "z", "-3.5")]
    path = str(tmp_path / f"out.{form}")
    writers.write(spark.createDataFrame(rows, "x string, y string, z string").coalesce(1), path)
    assert [tuple(c or "" for c in r) for r in cells(readers.read(spark, path))] == rows
    writers.write_column(spark.createDataFrame(rows, "x string, y string, z string"), "z", str(tmp_path / f"z.{form}"))
    assert sorted(cells(readers.read(spark, str(tmp_path / f"z.{form}")))) == [("-3.5",), ("1",), ("2",)]


def test_json_rows(spark):
    df = spark.createDataFrame([(1, 2.5, "x", True, dt.date(2024, 1, 2)), (None, None, None, None, None)], "i int, d double, s string, b boolean, t date")
    assert [r.value for r in writers.json_rows(df).collect()] == ['{"i":1,"d":2.5,"s":"x","b":true,"t":"2024-01-02"}', '{"i":null,"d":null,"s":null,"b":null,"t":null}']


def test_split_and_concat(spark, tmp_path):
    df = spark.createDataFrame([("north", 1.0), ("", 2.0), (None, 3.0), ("so/uth", 4.0)], "region string, v double")
    path = str(tmp_path / "parts")
    writers.split(df, "region", path)
    assert sorted(x for x in os.listdir(path) if "=" in x) == ["split_key=empty", "split_key=north", "split_key=so%2Futh"]
    assert sorted(r.v for r in spark.read.option("header", True).option("inferSchema", True).csv(path).collect()) == [1, 2, 3, 4]
    assert sorted(cells(writers.split_manifest(df, "region"))) == [("empty", "empty", 2), ("north", "north", 1), ("so/uth", "so_uth", 1)]
    paths = [put(tmp_path / f"{m}.csv", f"a,b\n{m},1\n") for m in ("jan", "feb")]
    assert cells(writers.concat_files(spark, paths)) == [("jan", "jan", "1"), ("feb", "feb", "1")]
    with pytest.raises(ValueError):
        writers.concat_files(spark, [paths[0], put(tmp_path / "mar.csv", "a,b,c\n1,2,3\n")])


def test_types(spark):
    df = spark.createDataFrame([("2024-01-02", "1,5"), ("2024-02-03T10:00:00Z", "7"), ("", "NA")], "d string, n string")
    kinds = readers.infer_types(df)
    assert kinds == {"d": "date", "n": "number"}
    assert cells(readers.typed(df, kinds)) == [(dt.date(2024, 1, 2), 1.5), (dt.date(2024, 2, 3), 7.0), (None, None)]


def test_order_of_mixed_cells(spark):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(["10.5", "100", "apple", "Apple", "banana", "", None, "9"])], "id int, v string")
    assert [r.id for r in sorting.sort(df, "v, nowhere desc", "id").collect()] == [5, 6, 7, 0, 1, 2, 3, 4]
    assert [r.id for r in sorting.sort(df, "v desc", "id").collect()] == [4, 2, 3, 1, 0, 7, 5, 6]
    assert [r.id for r in sorting.page(df, "v", "id", 2, 2).collect()] == [7, 0]


def test_dedup(spark):
    df = spark.createDataFrame([(1, "a", "x"), (2, "a", "y"), (3, "b", "x"), (4, "a", "x"), (5, None, "x"), (6, None, "x")], "id int, k string, v string")
    ids = lambda out: sorted(r.id for r in out.collect())
    assert ids(dedup.dedup(df, ["K"], tie="id")) == [1, 3, 5] and ids(dedup.dedup(df, [2], "last", "id")) == [3, 4, 6]
    assert ids(dedup.dedup(df, tie="id")) == [1, 2, 3, 5] and ids(dedup.dedup(df, ["k"], tie="id", view="v desc")) == [2, 3, 5]
    assert ids(dedup.dedup(spark.createDataFrame([(1, "a"), (2, "a"), (3, "a")], "id int, k string"), ["k"], "last", view="id")) == [3]
    assert cells(dedup.summary(df, dedup.dedup(df, ["k"], tie="id"))) == [(3, 3)]
    for wrong in (["nowhere"], [9], [0]):
        with pytest.raises(ValueError):
            dedup.dedup(df, wrong)


def test_totals_are_made_of_rows(spark):
    df = spark.createDataFrame([("a", "x", 1.0), ("a", "y", 3.0), ("b", "x", 8.0), ("b", "", 9.0), (None, "x", 9.0)], "r string, c string, v double")
    out = {(r.row_key, r.col_key): (r.avg, r.unique_count) for r in pivot.long(df, PivotSpec("r", "c", "v", "AVG+UNIQUE COUNT")).collect()}
    assert out[("Total", "Total")] == (4, 3) and out[("a", "Total")] == (2, 2) and out[("Total", "x")] == (4.5, 2) and len(out) == 8
    wide = pivot.wide(df, PivotSpec("r", "c", "v", "SUM+MIN", row_sort="VAL_DESC"))
    assert wide.columns == ["row_key", "row_place", "x_SUM", "x_MIN", "y_SUM", "y_MIN", "Total_SUM", "Total_MIN"]
    assert [tuple(r) for r in wide.orderBy("row_place").collect()][:2] == [("b", 1, 8, 8, 0, None, 8, 8), ("a", 2, 1, 1, 3, 3, 4, 1)]
    with pytest.raises(ValueError):
        pivot.long(df, PivotSpec("r", "c", "c", "SUM"))
    assert [r.month for r in spark.createDataFrame([("2024-03-05",), ("n/a",)], "d string").select(pivot.text_date_key(spark.createDataFrame([("",)], "d string"), "d", "month").alias("month")).collect()] == ["2024-03", "n/a"]


def test_statistics_of_text_cells(spark):
    df = spark.createDataFrame([("1",), ("2,5",), ("x",), ("",), (None,), ("2,5",)], "v string")
    r = stats.summary(df, "v").first()
    assert (r.total, r.valid, r.empty, r["sum"], r["mean"], r["min"], r["max"], r["median"], r.n_unique) == (6, 4, 2, 6.0, 1.5, 1.0, 2.5, 2.5, 3)
    assert cells(stats.mode(df, "v").select("value", "count")) == [("2,5", 2)]
    assert cells(stats.top_and_others(df, "v", 1).select("value", "count")) == [("2,5", 2), ("Others", 2)]
    same = spark.createDataFrame([(3.0,), (3.0,)], "v double")
    assert cells(stats.histogram(same, "v").select("bin", "count")) == [(0, 2)]
    p = {x["column"]: x for x in profile.profile(df.withColumn("e", df.v.substr(9, 1))).collect()}
    assert (p["v"].type, p["v"].nulls, p["v"].n_unique, p["e"].type) == ("string", 2, 3, "empty")
    assert [r.level for r in stats.blocks(spark.range(100).toDF("v"), "v", 4).orderBy("block").collect()] == [0, 2, 5, 7]


def test_streams(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.json").write_text('{"ts": "2024-01-01T10:00:00", "v": 3}\n{"ts": "2024-01-01T11:00:00", "v": 4}\n{"ts": "2024-01-05T00:00:00", "v": 1}\n{"ts": "2024-01-20T00:00:00", "v": 9}\n')
    stream = spark.readStream.schema("ts timestamp, v double").json(str(folder))
    rows = streaming.computed(streaming.filtered(stream, "v >= 3"), "w", "v * 2")
    query = rows.writeStream.format("memory").queryName("filtered_rows").trigger(availableNow=True).start()
    query.awaitTermination(60)
    assert sorted(r.w for r in spark.table("filtered_rows").collect()) == [6, 8, 18]
    query = streaming.windowed(stream, "ts", "v").writeStream.format("memory").outputMode("append").queryName("windows").trigger(availableNow=True).start()
    query.awaitTermination(60)
    assert [(str(r.start.date()), r["count"], r["sum"]) for r in spark.table("windows").orderBy("start").collect()] == [("2024-01-01", 2, 7.0), ("2024-01-05", 1, 1.0)]


def test_cells_come_back_as_they_were(spark, tmp_path):
    cells = ["  a ", " ", "", None, "\t", 'q"', '"', '""', "a,b", "a|b", "a;b c", "#x", "é", "null", "\\", '\\"', "0 1"]
    rows = [(i, a, b) for i, (a, b) in enumerate((a, b) for a in cells for b in cells)]
    df = spark.createDataFrame([(str(i), a, b) for i, a, b in rows], "`# id` string, `a, b` string, ` c` string").repartition(3)
    for name in ("t.csv", "t.tsv", "t.psv", "t.txt"):
        path = str(tmp_path / name)
        writers.write(df, path)
        back = readers.read(spark, path)
        assert back.columns == ["# id", "a, b", "c"]  # names are trimmed
        assert sorted((int(r[0]), r[1], r[2]) for r in back.collect()) == rows, name


def test_line_ends_are_refused_and_empty_tables_keep_their_names(spark, tmp_path):
    with pytest.raises(Exception, match="more than one line"):
        writers.write(spark.createDataFrame([("x\ny",)], "c string"), str(tmp_path / "t.csv"))
    writers.write(spark.createDataFrame([], "a string, b string"), str(tmp_path / "none.csv"))
    back = readers.read(spark, str(tmp_path / "none.csv"))
    assert back.columns == ["a", "b"] and back.count() == 0


def test_rows_of_several_files_in_their_order(spark, tmp_path):
    """Small files before large ones, large ones in several splits, whatever Spark packs together."""
    for name, n in (("a", 3), ("b", 3000), ("c", 1), ("d", 700)):
        (tmp_path / f"{name}.csv").write_text("id,v\n" + "".join(f"{name}{i},x\n" for i in range(n)))
        (tmp_path / f"{name}.jsonl").write_text("".join('{"id": "%s%d"}\n' % (name, i) for i in range(n)))
    want = [f"{name}{i}" for name, n in (("a", 3), ("b", 3000), ("c", 1), ("d", 700)) for i in range(n)]
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in ("2000", "9000", before):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            for end in ("csv", "jsonl"):
                rows = (readers.read_delimited if end == "csv" else readers.read_json_lines)(spark, str(tmp_path / f"*.{end}"), row_id=True).select("id", readers.ROW_ID).collect()
                assert {r[1]: r[0] for r in rows} == dict(enumerate(want))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_json_of_text_cells(spark):
    df = spark.createDataFrame([("1.50", "true", "x\"y", None), ("-2e3", "null", "", "7"), ("007", "no", "ü\n", "8")], "n string, b string, s string, t string")
    got = [r.value for r in writers.json_rows(df, {"n": "number", "b": "text", "s": "text", "t": "text"}).collect()]
    assert got == ['{"n":1.50,"b":true,"s":"x\\"y","t":null}', '{"n":-2e3,"b":null,"s":"","t":"7"}', '{"n":"007","b":"no","s":"ü\\n","t":"8"}']


def test_kept_order(spark, tmp_path):
    df = spark.range(40_000).selectExpr("id", "id * 7919 % 40009 v", "'x' _place")
    index = View(df, "id").order("v desc").indexed()
    want = [r.id for r in df.orderBy(F.desc("v"), "id").collect()]
    assert [r.id for r in index.page(39_000, 30).collect()] == want[39_000:39_030] and index.page(0, 5).columns == df.columns
    assert index.row(5).first().id == want[4] and index.row(99_999).first().id == want[-1] and index.place_of(want[7]).first().place == 8
    assert index.page(40_000, 5).count() == 0


def test_orders_that_are_needed_and_names_with_commas(spark):
    df = spark.createDataFrame([(1, 3), (2, 1), (3, 2)], "id int, `a, b` int")
    assert [r.id for r in View(df, "id").toggled("a, b").df().collect()] == [2, 3, 1]
    assert [r.id for r in View(df, "id").toggled("a, b").toggled("id").toggled("a, b").df().collect()] == [1, 3, 2]
    with pytest.raises(ValueError, match="order"):
        dedup.dedup(df, ["id"], "last")
    with pytest.raises(ValueError, match="first or last"):
        dedup.dedup(df, ["id"], "any", "id")


def test_edit_log(spark):
    """A thousand edits against a dict, versions back and forth, and a plan no deeper than that of one edit."""
    r = random.Random(2)
    base = [(i, i * 1.5, f"t{i}", None) for i in range(60)]
    df = spark.createDataFrame(base, "id long, v double, `a, b` string, _key string")
    log, states = edit.EditLog(df, "id"), [{x[0]: list(x) for x in base}]
    for k in range(1000):
        now, i = {a: list(b) for a, b in states[-1].items()}, r.randrange(70)
        if r.random() < 0.01:
            log = log.delete(i)
            now.pop(i, None)
        else:
            column, value = r.choice([("v", float(k)), ("a, b", f"e{k}"), ("a, b", None), ("V", None), ("_key", "k")])
            log = log.set(i, column, value)
            if i in now:
                now[i][["id", "v", "a, b", "_key"].index(column.lower())] = value
        states.append(now)
    rows = lambda log: {x[0]: list(x) for x in log.df().collect()}
    assert rows(log) == states[-1] and log.df().columns == df.columns and log.df().dtypes == df.dtypes
    for v in (0, 1, 500, 999):
        assert rows(log.at(v)) == states[v]
    assert rows(log.undo(3).redo(2)) == states[-2] and rows(log.undo(2000)) == states[0] and rows(log.redo(5)) == states[-1]
    assert rows(log.undo(300).delete(5).undo()) == states[700] and log.undo(300).delete(5).redo(9).version == 701
    nodes = lambda log: [x.strip(" +-:").split(" ")[0] for x in log.df()._jdf.queryExecution().optimizedPlan().toString().splitlines()]
    one = edit.EditLog(df, "id").set(1, "v", 2).set(1, "a, b", "x").set(2, "_key", "y")
    assert nodes(log) == nodes(one)
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        edit.EditLog(df, "id").set(1, "v", "no number").df().collect()


def test_profiles_of_parts(spark):
    """Parts with a large common offset, blanks, dates and nothing but blanks; any cut gives the whole table's profile."""
    rows = [(i, 1e9 + i % 7, f"v{i % 500}" if i % 5 else " ", f"2024-0{1 + i % 9}-01", None) for i in range(3000)]
    df = spark.createDataFrame(rows, "id long, x double, s string, day string, none string")
    want = {r.column: r for r in profile.profile(df).collect()}
    for cut in ([df], [df.filter("id < 10"), df.filter("id >= 10"), df.filter("id < 0")]):
        got = {r.column: r for r in profile.merged(reduce(DataFrame.unionByName, map(profile.parts, cut))).collect()}
        assert got.keys() == want.keys()
        for c, r in got.items():
            assert (r.rows, r.nulls, r.type, r.min, r.max) == (want[c].rows, want[c].nulls, want[c].type, want[c].min, want[c].max)
            assert (r.stddev is None) == (want[c].stddev is None) and (r.stddev is None or abs(r.stddev - want[c].stddev) < 1e-6 and abs(r["mean"] - want[c]["mean"]) < 1e-3)
            assert abs(r.n_unique - want[c].n_unique) <= 0.05 * want[c].n_unique


def test_only_new_files_are_read(spark, tmp_path):
    folder, kept, state, read = tmp_path / "in", str(tmp_path / "kept"), str(tmp_path / "state"), []
    folder.mkdir()
    for k, text in enumerate(("a\nb\n", "a\n", "c\nc\n")):
        (folder / f"{k}.txt").write_text(text)

        def partial(new):
            read.append(new.count())
            return stats.frequencies(new, "value").drop("pct")

        streaming.reload(spark.readStream.text(str(folder)), partial, kept, state)
        streaming.reload(spark.readStream.text(str(folder)), partial, kept, state)
    found = streaming.reloaded(spark, kept).groupBy("value").agg(F.sum("count").alias("n"))
    assert read == [2, 1, 2] and {(r.value, r.n) for r in found.collect()} == {("a", 2), ("b", 1), ("c", 2)}


def test_shared_tables_can_be_cleared(spark):
    made = shared.written(spark.range(5).toDF("id"), "few")
    path = made.inputFiles()[0].removeprefix("file:").rpartition("/")[0]
    assert made.count() == 5 and os.path.isdir(path)
    assert shared.cleared(spark) >= 1 and not os.path.exists(path) and shared.cleared(spark) == 0
    assert shared.written(spark.range(2).toDF("id"), "few").count() == 2
