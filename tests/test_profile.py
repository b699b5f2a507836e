import datetime as dt

import pytest
from pyspark.sql import functions as F

import tableprep as tp
from tableprep.operators.profile import RowLossError


@pytest.fixture(scope="module")
def mixed(spark):
    data = [
        (1, 0.0, "a", dt.datetime(2024, 1, 1, 2, 30), dt.date(2024, 1, 1), True, [1, 2]),
        (2, -0.0, "a", dt.datetime(2024, 3, 10, 2, 30), dt.date(2024, 1, 2), False, [1, 2]),
        (2, float("nan"), None, dt.datetime(2024, 3, 10, 3, 30), None, None, None),
        (None, None, "", None, None, True, [3]),
    ]
    schema = "i int, d double, s string, t timestamp_ntz, day date, b boolean, xs array<int>"
    return spark.createDataFrame(data, schema)


def test_distinct_counts_of_all_types(spark, mixed):
    expected = {"i": 2, "d": 2, "s": 2, "t": 3, "day": 2, "b": 2, "xs": 2}
    count = lambda df: {r["column"]: r["distinct_count"] for r in df.collect()}
    assert count(tp.distinct_counts(mixed)) == expected
    assert all(count(tp.distinct_counts(mixed, [c])) == {c: n} for c, n in expected.items())
    assert count(tp.distinct_counts(mixed, ["i", "s"], approx=True)) == {"i": 2, "s": 2}
    empty = mixed.where("i > 100")
    assert count(tp.distinct_counts(empty)) == dict.fromkeys(expected, 0)
    nulls = spark.createDataFrame([(None, 1)], "a string, b int")
    assert count(tp.distinct_counts(nulls)) == {"a": 0, "b": 1}


def test_schema_listing(mixed):
    assert [tuple(r) for r in tp.schema_listing(mixed).collect()][:2] == [("i", "int"), ("d", "double")]


def test_column_stats(spark, mixed):
    stats = {r["column"]: r for r in tp.column_stats(mixed).collect()}
    assert (stats["i"]["rows"], stats["i"]["null_count"], stats["i"]["null_percent"]) == (4, 1, 25.0)
    assert (stats["i"]["min_number"], stats["i"]["max_number"], stats["i"]["sum"]) == (1.0, 2.0, 5.0)
    assert stats["i"]["min_text"] is None and stats["s"]["max_text"] == "a" and stats["s"]["sum"] is None
    assert stats["day"]["min_text"] == "2024-01-01"


def test_empty_table(spark):
    empty = spark.createDataFrame([], "n int, s string, d date")
    stats = {r["column"]: r for r in tp.column_stats(empty).collect()}
    assert set(stats) == {"n", "s", "d"} and {(r["rows"], r["distinct_count"], r["null_percent"]) for r in stats.values()} == {(0, 0, None)}
    health = tp.health_columns(empty)
    assert {(r["score"], r["null_percent"], r["pattern"]) for r in health.collect()} == {(100, 0.0, None)}
    assert tp.health_score(health).first()["overall_score"] == 100
    assert tp.histogram(empty, "n").count() == 0 and tp.zscore_top(empty, "n").count() == 0
    assert tp.top_values(empty, "s").count() == 0 and tp.default_measures(empty).count() == 4
    assert tuple(tp.duplicate_summary(empty).first()) == (0, 0) and tuple(tp.dedup_preview(empty, ["s"]).first()) == (0, 0, 0)
    assert [r["matches"] for r in tp.date_format_scores(empty, "s").collect()] == [0] * 4
    assert tp.split_column(empty, "s", ",").columns == ["n", "s", "d", "s_part1"]
    assert tp.near_pairs(empty, "s").count() == 0 and tp.near_clusters(empty, "s").count() == 0


def test_top_values(spark):
    df = spark.createDataFrame([("b",), ("a",), ("b",), (None,), ("c",), ("a",)], "v string")
    assert [(r["value"], r["count"], round(r["percent"], 4)) for r in tp.top_values(df, "v", 2).collect()] == [
        ("a", 2, 33.3333), ("b", 2, 33.3333)]


def test_measures(spark):
    df = spark.createDataFrame([(1, "x", "2024"), (3, "x", None)], "n int, s string, start_date string")
    assert {(r["column"], r["measure"]): r["value"] for r in tp.default_measures(df).collect()} == {
        ("n", "sum"): 4.0, ("n", "avg"): 2.0, ("s", "distinct"): 1.0, ("start_date", "count"): 1.0}


def test_health(spark):
    data = [(float(i % 7), 1000000.0 if i < 3 else 1.0, 5, None if i % 5 else "x", "x" if i % 5 else None,
             f"u{i}@x.org" if i % 4 else "none", "1" * 14, None) for i in range(200)]
    df = spark.createDataFrame(data, "num double, spike double, same int, sparse string, most string, mail string, siret string, void string")
    health = tp.health_columns(df)
    found = {r["column"]: r for r in health.collect()}
    assert {c: found[c]["score"] for c in found} == {
        "num": 100, "spike": 97, "same": 100, "sparse": 60, "most": 90, "mail": 100, "siret": 100, "void": 60}
    assert found["spike"]["outliers"] == 3 and found["same"]["outliers"] == 0 and found["mail"]["pattern"] == "EMAIL"
    assert found["siret"]["pattern"] == "SIRET" and found["void"]["pattern"] is None and found["void"]["unique_count"] == 0
    assert tp.health_score(health).first()["overall_score"] == 88
    jagged = spark.createDataFrame([(7, 3, 2)], "row long, expected int, actual int")
    issues = [(r["severity"], r["message"]) for r in tp.health_issues(health, jagged).collect()]
    assert sorted(issues) == [("critical", "line 7: expected 3 columns, found 2"), ("warning", "column spike: 3 outliers (z-score > 3)")]


def test_sensitive_and_mainframe(spark, rows):
    df = spark.createDataFrame([("s", "ok €", "x\ty", 1), (None, "→ 😀", "plain", 2)],
                               "My_Token string, `very long name with more than thirty letters` string, note string, id int")
    assert rows(tp.sensitive_columns(df)) == [("My_Token", 1)]
    assert tp.sensitive_columns(df.select("note")).count() == 0
    report = {(r["section"], r["column"]): r["errors"] for r in tp.mainframe_report(df).collect()}
    long_name = "very long name with more than thirty letters"
    assert {k for k, v in report.items() if v} == {("headers", long_name), ("encoding", long_name), ("structure", "note")}
    assert [tuple(r) for r in tp.mainframe_errors(df, "id").collect()] == [(2, long_name, "→", "→ 😀")]


def test_row_loss_guard(spark):
    df = spark.range(100)
    assert tp.guard_row_loss(df, df.where("id < 95")).count() == 95
    with pytest.raises(RowLossError):
        tp.guard_row_loss(df, df.where("id < 94"))


def test_histogram(spark, rows):
    df = spark.createDataFrame([(float(i),) for i in range(21)] + [(None,)], "v double")
    bins = tp.histogram(df, "v").collect()
    assert len(bins) == 21 and bins[-1]["bin"] == 20 and sum(r["count"] for r in bins) == 21
    assert rows(tp.histogram(df, "v", 2, clamp_max=True)) == [(0, 0.0, 10), (1, 10.0, 11)]
    assert rows(tp.histogram(spark.createDataFrame([(5.0,), (5.0,)], "v double"), "v")) == [(0, 5.0, 2)]


def test_charts(spark, rows):
    df = spark.createDataFrame([(1.0, "a"), (2.0, ""), (3.0, None), (100.0, "a")], "v double, k string")
    top = tp.zscore_top(df, "v", 1).first()
    assert top["value"] == 100.0 and not top["is_outlier"]
    constant = tp.zscore_top(df.withColumn("v", F.lit(1.0)), "v")
    assert constant.where("z_score is not null").count() == 0
    assert rows(tp.frequencies(df, "k")) == [("a", 2)]
    assert [tuple(r) for r in tp.labels(df, "k").collect()] == [("a", 2), ("(Vide)", 1)]
    assert rows(tp.dual_measure(df, "k", "v")) == [("", 1, 2.0), ("a", 2, 101.0)]
    times = spark.createDataFrame([("2024-01-01 08:30:00",), ("bad",), ("2023-05-05 12:00:00",)], "t string")
    assert [r["hour_of_day"] for r in tp.timeline(times, "t").collect()] == [12.0, 8.5]
    assert [(str(r["date"]), r["count"]) for r in tp.daily_counts(times, "t", 1).collect()] == [("2023-05-05", 1)]
