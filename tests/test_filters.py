import datetime as dt

import pytest
from pyspark.sql import functions as F

import tableprep as tp
from tableprep.operators import filters


@pytest.fixture(scope="module")
def people(spark):
    data = [
        (1, "Ana", 10.0, dt.date(2024, 1, 1), True), (2, "bob", None, dt.date(2024, 2, 1), False),
        (3, None, 5.5, None, None), (4, "", -1.0, dt.date(2023, 1, 1), True), (5, "a\\b", 0.0, dt.date(2022, 1, 1), True),
        (6, "50%", 1.0, None, None),
    ]
    return spark.createDataFrame(data, "id long, name string, score double, day date, ok boolean")


def ids(df):
    return sorted(r["id"] for r in df.collect())


def only(df, column, operator, value="", **more):
    return ids(tp.apply_rules(df, [{"column": column, "operator": operator, "value": value, **more}]))


def test_null_fails_every_test_but_emptiness(people):
    assert only(people, "name", "not_equals", "Ana") == [2, 4, 5, 6]
    assert only(people, "name", "not_contains", "a") == [2, 4, 6]
    assert only(people, "name", "is_empty") == [3, 4]
    assert only(people, "name", "is_not_empty") == [1, 2, 5, 6]
    assert only(people, "score", "is_empty") == [2]
    assert only(people, "score", "is_not_empty") == [1, 3, 4, 5, 6]


def test_text_tests_ignore_case(people):
    assert only(people, "name", "contains", "A") == [1, 5]
    assert only(people, "name", "starts_with", "AN") == [1]
    assert only(people, "name", "ends_with", "NA") == [1]
    assert only(people, "name", "ends_with", "an") == []


def test_backslash_and_wildcards(people):
    assert only(people, "name", "contains", "\\") == [5]
    assert only(people, "name", "contains", "a_a") == [1]
    assert only(people, "name", "contains", "%") == [1, 2, 4, 5, 6]
    assert only(people, "name", "contains", "%", literal=True) == [6]
    assert ids(tp.search(people, "0%", literal=True)) == [6]


def test_values_are_typed_once(people):
    assert only(people, "score", "equals", "10") == [1]
    assert only(people, "score", "greater_than", "5") == [1, 3]
    assert only(people, "day", "less_than", "2023-06-01") == [4, 5]
    assert only(people, "ok", "equals", "TRUE") == [1, 4, 5]
    assert only(people, "id", "greater_than", "4.5") == [5, 6]
    for column, value in (("score", "abc"), ("day", "yesterday"), ("ok", "maybe"), ("id", "x")):
        with pytest.raises(ValueError, match=column):
            only(people, column, "equals", value)


@pytest.mark.parametrize("text", [
    "1", "0.", "-", "e", "a", "tr", "nan", "2024-0", "%", "1_", "0:", "inf", "+", "fals", "na", " ", "5.5", "e1", "t%e"])
@pytest.mark.parametrize("literal", [False, True])
def test_search_leaves_out_only_columns_that_cannot_match(spark, people, text, literal):
    extra = people.withColumns({
        "big": F.col("score") * 1e30, "odd": F.when(F.col("id") > 2, F.lit("nan").cast("double")).otherwise(F.lit("inf").cast("double")),
        "dec": F.lit("0.0000000001").cast("decimal(20,15)"), "at": F.lit("2024-01-01 10:20:30.5").cast("timestamp"),
    })
    from functools import reduce
    from operator import or_

    from tableprep.functions.text import contains_text

    every = extra.where(reduce(or_, [contains_text(extra[c], text, literal) for c in extra.columns])) if text.strip() else extra
    assert ids(tp.search(extra, text, literal)) == ids(every)


def test_rules_are_checked(people):
    for bad in ({"column": "nope", "operator": "equals", "value": "1"}, {"column": "id", "operator": "like", "value": "1"},
                {"column": "id", "operator": "equals", "value": ""}):
        with pytest.raises(ValueError):
            tp.apply_rules(people, [bad])
    with pytest.raises(ValueError):
        filters.check_rules(people, [{"operator": "equals", "value": "1"}])


def test_rule_set_skips_inactive_and_unbound(people):
    rules = [
        {"column": "score", "operator": "greater_than", "value": "0", "priority": 2},
        {"column": "name", "operator": "equals", "value": "zzz", "active": False},
        {"column": "", "operator": "equals", "value": "zzz"},
    ]
    assert ids(tp.apply_rules(people, rules)) == [1, 3, 6]
    assert ids(tp.apply_rules(people, [])) == [1, 2, 3, 4, 5, 6]
    assert ids(tp.search(people, "  ")) == [1, 2, 3, 4, 5, 6]


def test_rule_lists():
    rules = filters.add_rule(filters.add_rule([], "a", "equals", "1"), "b")
    assert [r["priority"] for r in rules] == [1, 2]
    rules = filters.duplicate_rule(rules, rules[0]["id"])
    assert [r["column"] for r in rules] == ["a", "b", "a"] and len({r["id"] for r in rules}) == 3
    rules = filters.move_rule(rules, rules[2]["id"], 0)
    rules = filters.delete_rule(rules, rules[1]["id"])
    assert [r["priority"] for r in rules] == [1, 2]
    rules = filters.toggle_rule(rules, rules[0]["id"])
    assert not rules[0]["active"]
    rules = filters.change_rule(rules, rules[1]["id"], value="9")
    assert rules[1]["value"] == "9"


def test_templates_lose_their_columns():
    saved = filters.save_template("t", filters.add_rule([], "secret", "equals", "é"))
    assert [r["column"] for r in filters.load_template(saved)] == [""]
    assert filters.bind_template(saved, ["x"])[0]["value"] == "é"
    with pytest.raises(ValueError):
        filters.bind_template(saved, [])


def test_nulls_sort_last_both_ways(people):
    assert [r["score"] for r in tp.sort_rows(people, "score").collect()][-1] is None
    assert [r["score"] for r in tp.sort_rows(people, "score", desc=True).collect()][-1] is None
    mixed = tp.sort_rows(people, ["ok", "score"], [True, False]).select("id").collect()
    assert [r[0] for r in mixed][:3] == [4, 5, 1]


def test_sort_cycle():
    first = filters.next_sort(None, "a")
    second = filters.next_sort(first, "a")
    assert (first, second, filters.next_sort(second, "a")) == (("a", False), ("a", True), None)
    assert filters.next_sort(second, "b") == ("b", False)


def test_page_is_a_top_k(people, plan_of):
    df = tp.page(people, 2, sort="id", desc=True)
    assert [r["id"] for r in df.collect()] == [6, 5]
    assert "TakeOrderedAndProject" in plan_of(df)


def test_one_sorted_value_spreads_over_tasks(spark):
    same = spark.range(0, 80000, 1, 8).select(F.lit(1).alias("k"), "id")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        sizes = [n for (n,) in tp.sort_rows(same, "k").groupBy(F.spark_partition_id()).count().select("count").collect()]
        parts = tp.sort_rows(same, "k").select(F.spark_partition_id().alias("p")).distinct().count()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert parts > 4 and max(sizes) < 40000


def test_coordinates(spark, rows):
    data = [("a", "1.5", "2"), ("b", "abc", "2"), ("c", None, "1"), ("d", "50", "50"), ("e", "2.5", "3")]
    df = spark.createDataFrame(data, "name string, Lat string, LNG string")
    assert [r["name"] for r in tp.geo_box(df, "Lat", "LNG", 1, 2.5, 2, 3).orderBy("name").collect()] == ["a", "e"]
    assert rows(tp.map_points(df)) == [(1.5, 2.0, "a"), (2.5, 3.0, "e"), (50.0, 50.0, "d")]
    many = spark.range(5000).selectExpr("id % 180 - 90 as lat", "id % 360 - 180 as lon")
    assert tp.map_points(many).count() == 5000
    some = [r.lat for r in tp.map_points(many, 500).collect()]
    assert len(some) == 500 and min(some) < -60 and max(some) > 60
    assert tp.around(df, "Lat", "LNG", (1.5, 2.0)).count() == 2
    with pytest.raises(ValueError):
        tp.map_points(df.drop("Lat"))
