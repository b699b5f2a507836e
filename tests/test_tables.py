"""Joins, reshaping, duplicates, comparison, zones."""

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import tableprep as tp


def test_lookup_keeps_and_multiplies(spark, rows):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (None, "c")], "k long, v string")
    ref = spark.createDataFrame([(1, "x"), (1, "y"), (None, "z")], "id long, v string")
    assert rows(tp.lookup(df, ref, "k", "id")) == sorted([(1, "a", "x"), (1, "a", "y"), (2, "b", None), (None, "c", None)], key=repr)
    assert tp.lookup(df, ref, "k", "id").columns == ["k", "v", "v_1"]


def test_lookup_with_the_same_key_name(spark, rows):
    df = spark.createDataFrame([(1, "a")], "k long, v string")
    assert rows(tp.lookup(df, df.withColumn("w", F.lit(7)), "k", "k", ["w"])) == [(1, "a", 7)]


def test_update_by_key(spark, rows):
    df = spark.createDataFrame([(1, 1.0, "a"), (2, 2.0, "b"), (None, 3.0, "c")], "id long, b double, c string")
    new = spark.createDataFrame([(1, None, "n"), (9, 9.0, "z")], "id long, b double, extra string")
    assert rows(tp.update_by_key(df, new, "id")) == sorted(
        [(1, None, "a", "n"), (2, 2.0, "b", None), (None, 3.0, "c", None)], key=repr)
    with pytest.raises(Exception, match="a key occurs more than once: [19]"):
        tp.update_by_key(df, new.unionAll(new), "id").collect()
    named = spark.createDataFrame([(1, "x", "y")], "ID long, B double, C string".replace("double", "string"))
    assert tp.update_by_key(df.withColumn("b", F.col("c")), named, "id").columns == ["id", "b", "c"]


def test_map_values(spark, rows):
    df = spark.createDataFrame([("a",), ("b",), (None,)], "v string")
    assert rows(tp.map_values(df, "v", {"a": "A", "b": None})) == sorted([("A",), (None,), (None,)], key=repr)
    assert rows(tp.map_values(df, "v", {"a": "A"}, to="w")) == sorted([("a", "A"), ("b", None), (None, None)], key=repr)
    table = spark.createDataFrame([("a", "1"), ("a", "2")], "old string, new string")
    with pytest.raises(Exception, match="a key occurs more than once: a"):
        tp.map_values(df, "v", table).collect()


def test_pivot_rules(spark, rows):
    df = spark.createDataFrame([("r", "x", 1.0), ("r", "x", None), ("s", None, 5.0), ("t", "y", None)], "r string, k string, v double")
    assert tp.pivot(df, "r", "k", "v", "COUNT").columns == ["r", "x", "y"]
    assert rows(tp.pivot(df, "r", "k", "v", "COUNT")) == [("r", 1, 0), ("s", 0, 0), ("t", 0, 0)]
    assert rows(tp.pivot(df, "r", "k", "v", "SUM")) == [("r", 1.0, None), ("s", None, None), ("t", None, None)]
    assert rows(tp.pivot(df.where("k is null"), "r", "k", "v")) == [("s",)]
    with pytest.raises(ValueError, match="more than 1"):
        tp.pivot(df, "r", "k", "v", max_columns=1)
    with pytest.raises(ValueError):
        tp.pivot(df, "r", "k", "v", "MEDIAN")


def test_unpivot_rules(spark, rows):
    df = spark.createDataFrame([(1, 2, 0.5, "t"), (2, None, None, None)], "id long, q1 int, q2 double, q3 string")
    assert rows(tp.unpivot(df.drop("q3"), ["q1", "q2"])) == [(1, "q1", 2.0), (1, "q2", 0.5)]
    assert rows(tp.unpivot(df, ["q1", "q3"], "n", "v", keep_nulls=True), "id", "n", "v") == sorted(
        [(1, "q1", "2"), (1, "q3", "t"), (2, "q1", None), (2, "q3", None)], key=repr)
    assert dict(tp.unpivot(df.select("id", "q1"), ["q1"]).dtypes)["Valeur"] == "int"


SLOW = settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
cells = st.one_of(st.none(), st.integers(-3, 3))
tables = st.lists(st.tuples(cells, cells), min_size=1, max_size=12)


@SLOW
@given(tables)
def test_unpivot_then_pivot_is_the_same_table(spark, rows, data):
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(data)], "id int, a int, b int")
    wide = tp.pivot(tp.unpivot(df, ["a", "b"], keep_nulls=True), "id", "Attribut", "Valeur", "MAX", values=["a", "b"])
    assert rows(wide) == rows(df)


@SLOW
@given(tables, tables)
def test_diff_properties(spark, rows, first, second):
    a, b = (spark.createDataFrame(data, "x int, y int") for data in (first, second))
    assert rows(tp.row_diff(a, a)) == [] and rows(tp.row_diff(a, a, mode="bag")) == []
    expected = [("added", *r) for r in set(second) - set(first)] + [("removed", *r) for r in set(first) - set(second)]
    assert rows(tp.row_diff(a, b.select("y", "x"))) == sorted(expected, key=repr)
    bag = tp.row_diff(a, b, mode="bag")
    back = bag.where("status = 'added'").drop("status")
    gone = bag.where("status = 'removed'").drop("status")
    assert rows(a.exceptAll(gone).unionAll(back)) == rows(b)


@SLOW
@given(st.lists(st.tuples(st.sampled_from(["a", " A", "b", None, ""]), cells), min_size=1, max_size=15), st.sampled_from(["exact", "smart"]))
def test_preview_counts_what_dedup_removes(spark, data, mode):
    df = spark.createDataFrame([(i, k, v) for i, (k, v) in enumerate(data)], "id int, k string, v int")
    preview = tp.dedup_preview(df, ["k", "v"], mode).first()
    left = tp.dedup(df, ["k", "v"], mode=mode, order_by="id").count()
    assert (preview["rows"], preview["kept"], preview["removed"]) == (len(data), left, len(data) - left)


def test_diff_checks_the_schema(spark, rows):
    a = spark.createDataFrame([(1, 2)], "x int, y int")
    b = spark.createDataFrame([(1, 2)], "x int, z int")
    assert rows(tp.schema_diff(a, b)) == [("y", "removed"), ("z", "added")]
    with pytest.raises(ValueError):
        tp.row_diff(a, b)


def test_diff_by_key(spark, rows):
    a = spark.createDataFrame([(1, "a", 1), (2, "b", None), (3, "c", 3)], "id int, s string, n int")
    b = spark.createDataFrame([(1, "a", 1), (2, "b", 5), (4, "d", None)], "id int, s string, n int")
    assert rows(tp.row_diff(a, b, key="id")) == sorted(
        [("added", 4, "d", None, None), ("removed", 3, "c", 3, None), ("changed", 2, "b", 5, "n")], key=repr)


def test_diff_by_key_needs_unique_keys(spark):
    a = spark.createDataFrame([(1, "a"), (1, "b")], "id int, s string")
    with pytest.raises(Exception, match="more than once: 1"):
        tp.row_diff(a, a, key="id").collect()


DUPES = [(1, "a", "x", 1), (2, "a", "x", 2), (3, " A ", "x", 3), (4, None, "x", 4), (5, None, "x", 5), (6, "b", None, 6)]


@pytest.fixture(scope="module")
def dupes(spark):
    return spark.createDataFrame(DUPES, "id long, k1 string, k2 string, v int")


def kept(df):
    return sorted(r["id"] for r in df.collect())


def test_dedup(dupes):
    assert kept(tp.dedup(dupes, ["k1", "k2"], order_by="id")) == [1, 3, 4, 6]
    assert kept(tp.dedup(dupes, ["k1", "k2"], keep="last", order_by="id")) == [2, 3, 5, 6]
    assert kept(tp.dedup(dupes, ["k1"], mode="smart", order_by="id")) == [1, 4, 6]
    assert kept(tp.dedup(dupes, ["k1"], keep="last", mode="smart", order_by="id")) == [3, 5, 6]
    assert kept(tp.dedup(dupes.coalesce(1), ["k1"])) == [1, 3, 4, 6]
    assert tp.dedup(dupes, ["k1"]).columns == dupes.columns
    preview = tp.dedup_preview(dupes, ["k1"], "smart").first()
    assert (preview["rows"], preview["kept"], preview["removed"]) == (6, 3, 3)


def test_dedup_is_idempotent_and_independent_of_partitions(spark, dupes):
    once = tp.dedup(dupes, ["k1"], order_by="k2")
    assert kept(tp.dedup(once, ["k1"], order_by="k2")) == kept(once)
    assert kept(tp.dedup(dupes.repartition(5), ["k1"], order_by="k2")) == kept(once)


def test_dedup_puts_nulls_last(spark):
    df = spark.createDataFrame([(1, "a", None), (2, "a", 5), (3, "a", 9)], "id long, k string, at int")
    assert kept(tp.dedup(df, ["k"], order_by="at")) == [2]
    assert kept(tp.dedup(df, ["k"], keep="last", order_by="at")) == [3]


def test_dedup_carries_unorderable_columns(spark):
    df = spark.createDataFrame([(1, "a", {"x": 1}), (2, "a", {"x": 2}), (3, "b", None)], "id long, `k.1` string, m map<string,int>")
    df = df.withColumnRenamed("k.1", "k")
    assert sorted((r["id"], r["m"]) for r in tp.dedup(df, ["k"], keep="last", order_by="id").collect()) == [(2, {"x": 2}), (3, None)]


def test_dedup_sorts_no_hot_group(dupes, plan_of):
    assert "Window" not in plan_of(tp.dedup(dupes, ["k1"], order_by="id"))


def test_duplicates(spark, rows):
    df = spark.createDataFrame([(1, None), (1, None), (1, None), (2, "b"), (2, "b"), (3, "c")], "a int, b string")
    assert rows(tp.duplicate_summary(df)) == [(3, 2)]
    assert [tuple(r) for r in tp.duplicate_groups(df).collect()] == [(1, None, 3), (2, "b", 2)]
    assert tp.merge_duplicates(df).count() == 3
    assert rows(tp.duplicate_summary(df.distinct())) == [(0, 0)]


def test_calendar(spark, rows):
    df = spark.createDataFrame([("2021-01-01",), ("2021-01-04",), ("junk",), (None,)], "d string")
    assert [tuple(map(str, r)) for r in tp.date_bounds(df, "d").collect()] == [("2021-01-01", "2021-01-04", "4")]
    days = tp.calendar(df, "d").orderBy("Date").collect()
    assert [(str(r["Date"]), r["DayName"], r["Week"], r["IsWeekend"]) for r in days][2:] == [
        ("2021-01-03", "Sunday", 53, True), ("2021-01-04", "Monday", 1, False)]
    assert tp.calendar(df.where("d is null"), "d").count() == 0


CITIES = [("Paris", "Europe/Paris"), ("New York", "America/New_York"), ("Tokyo", "Asia/Tokyo")]


@pytest.fixture(scope="module")
def meetings(spark):
    data = [
        (1, "New York", "2024-07-01 09:00:00"), (2, "new york ", "2024-07-01T09:00:00"), (3, "Pariss", "2024-03-31 02:30:00"),
        (4, "Atlantis", "2024-07-01 09:00:00"), (5, None, "2024-07-01 09:00:00"), (6, "Tokyo", "soon"),
        (7, "Base", "2024-01-01 00:00:00.250"), (8, "Paris", "2024-07-01T09:00:00-04:00"), (9, "Tokyo", "2024-07-01T09:00:00Z"),
        (10, "Paris", "2024-01-15"),
    ]
    return spark.createDataFrame(data, "id long, place string, at string")


def test_zones(spark, meetings, rows):
    zones = tp.resolve_zones(meetings, "place", spark.createDataFrame(CITIES, "city string, zone string"), {"Base": "UTC"})
    found = {r["place"]: (r["zone"], r["how"]) for r in zones.collect()}
    assert found["new york "] == ("America/New_York", "exact") and found["Pariss"] == ("Europe/Paris", "near")
    assert found["Atlantis"] == (None, "unresolved") and found["Base"] == ("UTC", "manual") and None not in found
    moved = {r["id"]: r["at_local"] for r in tp.to_zone(meetings, "at", "place", zones).collect()}
    assert moved[1] == moved[2] == "2024-07-01 15:00:00"
    assert moved[4] is moved[5] is moved[6] is None
    assert moved[7] == "2024-01-01 01:00:00" and moved[8] == "2024-07-01 15:00:00" and moved[9] == "2024-07-01 11:00:00"
    assert moved[10] == "2024-01-15 00:00:00"
    kept_text = {r["id"]: r["at"] for r in tp.to_zone(meetings, "at", "place", zones, overwrite=True).collect()}
    assert kept_text[6] == "soon" and kept_text[4] == "2024-07-01 09:00:00" and kept_text[1] == "2024-07-01 15:00:00"


def test_zones_do_not_depend_on_the_session(spark, meetings):
    zones = tp.resolve_zones(meetings, "place", spark.createDataFrame(CITIES, "city string, zone string"))
    before = {r["id"]: r["at_local"] for r in tp.to_zone(meetings, "at", "place", zones).collect()}
    spark.conf.set("spark.sql.session.timeZone", "America/Los_Angeles")
    try:
        after = {r["id"]: r["at_local"] for r in tp.to_zone(meetings, "at", "place", zones).collect()}
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert before == after


def test_addresses(spark, rows):
    df = spark.createDataFrame([("1 rue A",), ("unknown",), (None,)], "adr string")
    known = spark.createDataFrame([("1 rue A", "1 Rue A, Nice", "Nice", None, 43.5, 7.25)],
                                  "query string, label string, city string, context string, lat double, lon double")
    shown = lambda fmt: {r["adr"]: r["adr_geo"] for r in tp.normalize_address(df, "adr", known, fmt).collect()}
    assert shown("full") == {"1 rue A": "1 Rue A, Nice", "unknown": None, None: None}
    assert shown("city")["1 rue A"] == "Nice, " and shown("gps")["1 rue A"] == "43.5, 7.25"
    with pytest.raises(ValueError):
        tp.normalize_address(df, "adr", known, "street")
