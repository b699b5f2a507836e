import pytest
from pyspark.sql import functions as F

import tableprep as tp
from tableprep.functions.names import copybook_names, mainframe_name, normalize_names, number_repeats
from tableprep.functions.text import end_of_text
from tableprep.operators.columns import CONVERSIONS, _looks_only_inside, group_count


def test_header_names():
    got = normalize_names(["First Name", "Montant (EUR)", "select", "Zip", "Élève", "first-name", "1st", "", None])
    assert got == ["first_name", "montant_eur", "_select", "zip", "eleve", "first_name_1", "_1st", "col", "col_1"]


def test_mainframe_names():
    assert mainframe_name("First Name") == "FIRST_NAME"
    assert mainframe_name("customer_first_name") == "CUSTOMERFI"
    assert mainframe_name("a_b_c_d_e_f") == "ABCDEF"
    assert number_repeats(["CUSTOMERFI", "CUSTOMERFI", "x"], 10) == ["CUSTOMERFI", "CUSTOMER_1", "x"]


def test_copybook():
    assert copybook_names("01 NOM PIC X(10)\n\n 05  AGE PIC 9(3)\nVILLE\n99") == ["NOM", "AGE", "VILLE", "99"]


@pytest.fixture(scope="module")
def abc(spark):
    return spark.createDataFrame([(1, "x", 2.0), (2, None, 0.0)], "a long, b string, c double")


def test_rename_swaps(abc):
    swapped = tp.rename(abc, {"a": "c", "c": "a"})
    assert swapped.columns == ["c", "b", "a"] and swapped.first()["a"] == 2.0
    with pytest.raises(ValueError):
        tp.rename(abc, {"a": "B"})
    with pytest.raises(ValueError):
        tp.rename(abc, {"nope": "x"})


def test_order_and_copybook(abc):
    assert tp.reorder(abc, ["c"]).columns == ["c", "a", "b"]
    assert tp.rename_from_copybook(abc, "01 K\nLONG_FIELD_NAME").columns == ["K", "LONG_FIELD_NAME", "c"]
    assert tp.rename_from_copybook(abc, "01 K\nLONG_FIELD_NAME", mainframe=True).columns == ["K", "LONGFIELDN", "c"]


def test_formula(abc, rows):
    assert rows(tp.formula(abc, "f", "`a` + 1"), "f") == [(2.0,), (3.0,)]
    assert rows(tp.formula(abc, "f", "try_divide(a, c)"), "f") == [(0.5,), (None,)]
    assert rows(tp.formula(abc, "f", "concat('1', b)"), "f") == [(None,), (None,)]
    with pytest.raises(Exception):
        tp.formula(abc, "f", "concat('1', b)", strict=True).collect()


def test_conditional(abc, rows):
    assert rows(tp.conditional(abc, "n", "b", "=", "x", "yes", "no"), "n") == [("no",), ("yes",)]
    assert rows(tp.conditional(abc, "n", "c", ">", "1", "yes", "no"), "n") == [("no",), ("yes",)]
    assert rows(tp.conditional(abc, "n", "b", "LIKE", "X", "yes", "no"), "n") == [("no",), ("no",)]
    with pytest.raises(ValueError):
        tp.conditional(abc, "n", "c", ">", "one", "yes", "no")
    with pytest.raises(ValueError):
        tp.conditional(abc, "n", "c", ">=", "1", "yes", "no")


def test_simple_columns(abc, rows):
    assert rows(tp.mask(abc, "b"), "b") == [("*****",), ("*****",)]
    assert rows(tp.fill_empty(abc, "b"), "b") == [("",), ("x",)]
    assert rows(tp.cast_column(abc, "b", "int"), "b") == [(None,), (None,)]
    assert tp.add_row_id(abc).select("row_id").distinct().count() == 2
    assert tp.hide_columns(abc, ["b", "zzz"]).columns == ["a", "c"]


def test_zero_and_false_are_values(spark, rows):
    df = spark.createDataFrame([(0, False), (None, None)], "n int, f boolean")
    assert rows(tp.fill_empty(tp.fill_empty(df, "n"), "f")) == [("", ""), ("0", "false")]


def test_split(spark, rows):
    df = spark.createDataFrame([("a|b|c",), ("x",), (None,), ("",), ("1|",)], "v string")
    assert rows(tp.split_column(df, "v", "|").drop("v")) == sorted(
        [("a", "b", "c"), ("x", None, None), (None, None, None), ("", None, None), ("1", "", None)], key=repr)
    assert tp.split_column(df, "v", "|", n=2).columns == ["v", "v_part1", "v_part2"]
    dotted = spark.createDataFrame([("it's.a.b",)], "v string")
    assert rows(tp.split_column(dotted, "v", ".").drop("v")) == [("it's", "a", "b")]
    assert rows(tp.split_column(dotted, "v", "'").drop("v")) == [("it", "s.a.b")]


def test_regex_extract(spark, rows):
    df = spark.createDataFrame([("k=12 z",), ("none",), (None,)], "v string")
    assert rows(tp.regex_extract(df, "v", r"(\w)=(\d+)").drop("v")) == sorted([("k", "12"), ("", ""), (None, None)], key=repr)
    assert rows(tp.regex_extract(df, "v", r"\d+").drop("v")) == sorted([("12",), ("",), (None,)], key=repr)
    with pytest.raises(ValueError):
        tp.regex_extract(df, "v", r"(\d+)", ["a", "b"])
    assert group_count(r"(?<n>a)(?:b)(?<!x)(c)") == 2
    assert group_count(r"\((a)[(\])(]\Q(\E([^)]*)(?i)") == 2


@pytest.mark.parametrize("pattern, inside", [
    (r"(a+)(b*)", True), (r"^(\w+)@([^/$^]+)/", True), (r"(a)(b)$", False), (r"(a)\b(b)", False), (r"(a)(?=b)(b)", False),
    (r"(a)\1(b)", False), (r"(?:a|ab)(c|bcd)(d*)", True), (r"(a++)(b)", False), (r"x^(a)(b)", False), (r"(?<n>a)(b)", False),
    (r"(a*?)(a|b|$)", False), (r"(.*?)([0-9])", True), (r"(\w)(?i)(b)", False),
])
def test_groups_of_a_match_need_no_second_search(spark, pattern, inside):
    assert _looks_only_inside(pattern) is inside
    texts = ["abcd", "xxabcd", "aabb ab", "me@host/x", "aaab", "", None, "ab", "abcbcd", "zz9", "a1b2", "xaab"]
    df = spark.createDataFrame([(t,) for t in texts], "v string")
    groups = [F.regexp_extract("v", end_of_text(pattern), i + 1).alias(f"g{i}") for i in range(group_count(pattern))]
    assert tp.regex_extract(df, "v", pattern).drop("v").collect() == df.select(*groups).collect()


def test_dollar_is_the_very_end(spark):
    assert end_of_text("a$") == "a\\z" and end_of_text("a\\$") == "a\\$" and end_of_text("a") == "a"
    df = spark.createDataFrame([("x1\n",)], "v string")
    assert tp.regex_extract(df, "v", "([0-9])$").first()["v_ext1"] == ""


def test_units(spark):
    df = spark.createDataFrame([(10, "1.5"), (None, "x")], "n int, t string")
    assert len(CONVERSIONS) == 10
    assert tp.convert_unit(df, "n", "km -> mi").orderBy("n").collect()[1]["n_conv"] == pytest.approx(6.21371)
    assert tp.convert_unit(df, "t", "kg -> lb").where(F.col("t") == "x").first()["t_conv"] is None
    with pytest.raises(ValueError):
        tp.convert_unit(df, "n", "m -> km")
