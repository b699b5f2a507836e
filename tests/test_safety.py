"""Inputs that once lost rows, columns or values."""

import pytest
from pyspark.sql import functions as F

import tableprep as tp
from tableprep.operators.filters import rule_predicate
from tableprep.scratch import new_path
from tableprep.sources.detect import detect_newline, inspect_delimited


def write_lines(path, name, text):
    path.mkdir(exist_ok=True)
    (path / name).write_bytes(text.encode())
    return str(path)


def test_dates_are_read_whole(spark):
    df = spark.createDataFrame([("2024-01-01",)], "d string").select(F.col("d").cast("date").alias("d"))
    for good in ("2024-01-01", "20240101", "2024-01-01 00:00:00"):
        assert df.where(rule_predicate(df, {"column": "d", "operator": "equals", "value": good})).count() == 1
    for bad in ("2024-01-01JUNK", "2024-01-01 10:00", "soon"):
        with pytest.raises(ValueError):
            rule_predicate(df, {"column": "d", "operator": "equals", "value": bad})
    times = df.select(F.col("d").cast("timestamp").alias("d"))
    assert times.where(rule_predicate(times, {"column": "d", "operator": "equals", "value": "20240101"})).count() == 1


def test_line_breaks_inside_quotes(spark, rows, tmp_path):
    df = spark.createDataFrame([(1, "a\nb"), (2, 'c "d"\r\ne'), (3, None), (4, "plain")], "id int, text string")
    path = new_path(spark, "breaks")
    tp.write_delimited(df, path)
    info = inspect_delimited(spark, path)
    assert info.quoted_breaks and not info.open_quote
    assert [r[0] for r in rows(tp.read_delimited(spark, path), "text")].count("plain") == 1
    assert tp.read_delimited(spark, path).count() == 4
    broken = write_lines(tmp_path / "broken", "a.csv", 'id,text\n1,"never closed\n2,b\n3,c\n')
    with pytest.raises(ValueError, match="not closed"):
        tp.read_delimited(spark, broken)


def test_bad_rows_are_not_lost_unseen(spark, tmp_path):
    path = write_lines(tmp_path / "bad", "a.csv", "id,text\n1,a\n2,b,c\n")
    with pytest.raises(Exception, match="MALFORMED|malformed"):
        tp.read_delimited(spark, path).collect()
    assert tp.read_delimited(spark, path, bad_rows="keep").count() == 2


def test_unlike_headers(spark, rows, tmp_path):
    folder = tmp_path / "mixed"
    write_lines(folder, "a.csv", "id,amount\n1,300\n")
    path = write_lines(folder, "b.csv", "amount,id\n400,2\n")
    assert rows(tp.read_delimited(spark, path), "id", "amount") == [(1, 300), (2, 400)]
    write_lines(folder, "c.csv", "id,price\n1,2\n")
    with pytest.raises(ValueError, match="different columns"):
        tp.read_delimited(spark, path)


@pytest.mark.parametrize("text, end", [("a\nb\n", "\n"), ("a\r\nb\r\n", "\r\n"), ("a\rb\rc", "\r"), ("", "\n"), ("one line", "\n")])
def test_line_ends(spark, tmp_path, text, end):
    assert detect_newline(spark, write_lines(tmp_path / "ends", "a.txt", text)) == end


def test_fixed_width_lines_stay_whole(spark, rows, tmp_path):
    df = spark.createDataFrame([(1, "é\nb"), (2, "c\r\nd"), (3, "€ 中"), (4, None)], "id int, text string")
    for encoding, last in (("UTF-8", "€ 中"), ("windows-1252", "€ ?")):
        path = new_path(spark, "fixed")
        tp.write_fixed_width(df, path, {"id": 3, "text": 6}, encoding=encoding)
        back = tp.read_fixed_width(spark, path, [("id", 3, "int"), ("text", 6)], encoding=encoding)
        assert rows(back) == [(1, "é b"), (2, "c  d"), (3, last), (4, "")]


def test_columns_are_not_lost(spark, rows):
    own = spark.createDataFrame([(7, "a")], "row_id int, v string")
    with pytest.raises(ValueError, match="row_id"):
        tp.enrich(own, lambda f: f, "row_id int, v string")
    df = spark.createDataFrame([(1, "a", "b")], "k int, name string, name_1 string")
    ref = spark.createDataFrame([(1, "x")], "id int, name string")
    assert tp.lookup(df, ref, "k", "id").columns == ["k", "name", "name_1", "name_2"]


def test_split_is_bounded(spark):
    wide = spark.createDataFrame([("x," * 3000,)], "v string")
    with pytest.raises(ValueError, match="3001 parts"):
        tp.split_column(wide, "v", ",")


def test_diff_of_unlike_types_and_missing_keys(spark, rows):
    a = spark.createDataFrame([(1, 10), (None, 1), (None, 1), (None, 2)], "k int, v int")
    b = spark.createDataFrame([(1, "10"), (2, "x"), (None, "1")], "k bigint, v string")
    assert rows(tp.row_diff(a, b, key="k")) == sorted(
        [("added", 2, "x", None), ("removed", None, "1", None), ("removed", None, "2", None)], key=repr)
    assert rows(tp.row_diff(a.where("k = 1"), b.where("k = 1"))) == []


def test_sql_leaves_views_alone(spark, rows):
    mine, other = spark.createDataFrame([(1,)], "copy int"), spark.createDataFrame([(2,)], "copy int")
    other.createOrReplaceTempView("t_mine")
    assert rows(tp.sql(mine, "SELECT copy, 'load' AS l FROM t_mine", name="t_mine")) == [(1, "load")]
    assert rows(tp.sql(mine, "WITH x AS (SELECT copy + 1 AS n FROM t_mine) SELECT n FROM x", name="t_mine")) == [(2,)]
    assert spark.table("t_mine").first()[0] == 2


def test_fingerprints_of_decomposed_accents(spark):
    df = spark.createDataFrame([("Dvořák",), ("Dvořák",), ("dvorak",), ("Other",)], "v string")
    assert {r["fingerprint"] for r in tp.fingerprint_clusters(df, "v").collect()} == {"dvorak"}
    assert tp.fingerprint_clusters(df, "v").count() == 3


def test_charts_skip_text_that_is_no_number(spark):
    df = spark.createDataFrame([("1",), ("2",), ("x",), (None,)], "v string")
    assert sum(r["count"] for r in tp.histogram(df, "v").collect()) == 2
    assert tp.zscore_top(df, "v").count() == 2
    assert tp.dual_measure(df, "v", "v").count() == 3


def test_row_wise_looks_at_arguments():
    day = tp.Recipe().add("standardize_date", col="d")
    assert not day.row_wise() and tp.Recipe().add("standardize_date", col="d", fmt="dd/MM/yyyy").row_wise()
    assert not tp.Recipe().add("split_column", col="d", sep=",").row_wise()
    for helper in ("require_unique", "one_per_key", "add_rule", "mapping_frame"):
        with pytest.raises(ValueError):
            tp.Recipe().add(helper)
    with pytest.raises(ValueError, match="comes first"):
        tp.Recipe().add("mask", col="a").add("read_delimited", path="x")


def test_top_values_read_the_table_once(spark, rows):
    df = spark.range(100).selectExpr("id % 7 as v").withColumn("v", F.when(F.col("v") > 0, F.col("v")))
    top = tp.top_values(df, "v", 2)
    assert [(r["value"], r["count"], round(r["percent"], 6)) for r in top.collect()] == [(1, 15, 15.0), (2, 14, 14.0)]


def test_guard_computes_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def count(frames):
        for frame in frames:
            seen.add(len(frame))
            yield frame

    before = spark.range(100)
    after = before.mapInPandas(count, "id bigint")
    assert tp.guard_row_loss(before, after).count() == 100 and seen.value == 100


def test_clusters_keep_few_edges(spark, monkeypatch):
    """No table of pairs: at most one edge for each value and round."""
    from tableprep.operators import fuzzy

    sizes, write = [], fuzzy.written

    def counted(df, label="step"):
        out = write(df, label)
        if label == "edges":
            sizes.append(out.count())
        return out

    monkeypatch.setattr(fuzzy, "written", counted)
    names = spark.range(300).selectExpr("concat('Customer#', lpad(id, 6, '0')) as v")
    assert {r["canonical"] for r in tp.near_clusters(names, "v", 3).collect()} == {"Customer#000000"}
    assert max(sizes) <= 2 * 300
