import pytest

import tableprep as tp


def column(spark, values, name="v"):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"id long, {name} string")


def results(df, *names):
    found = [tuple(r[n] for n in names) for r in df.orderBy("id").collect()]
    return [f[0] for f in found] if len(names) == 1 else found


def test_dates_are_detected(spark):
    df = column(spark, ["31/01/2024", "03/04/2024", "01/07/2024", "1/7/2024", "13/13/2024", "30/02/2024", "", None, "n/a"])
    scores = [(r["format"], r["matches"]) for r in tp.date_format_scores(df, "v").collect()]
    assert scores == [("dd/MM/yyyy", 3), ("MM/dd/yyyy", 2), ("yyyy-MM-dd", 0), ("yyyyMMdd", 0)]
    done = tp.standardize_date(df, "v", flag=True)
    assert results(done, "v") == ["2024-01-31", "2024-04-03", "2024-07-01", "2024-07-01", "13/13/2024", "30/02/2024", "", None, "n/a"]
    assert results(done, "v_parsed") == [True] * 4 + [False] * 5


def test_date_ties_go_to_the_first_format(spark):
    assert results(tp.standardize_date(column(spark, ["03/04/2024"]), "v"), "v") == ["2024-04-03"]


@pytest.mark.parametrize("value, fmt", [("20240229", "yyyyMMdd"), ("02/29/2024", "MM/dd/yyyy"), ("2024-02-29", "yyyy-MM-dd"), ("29.02.2024", "dd.MM.yyyy")])
def test_each_format(spark, value, fmt):
    df = column(spark, [value, "2023-13-01", "00000000", "2023-02-29"])
    assert results(tp.standardize_date(df, "v", fmt), "v") == ["2024-02-29", "2023-13-01", "00000000", "2023-02-29"]


def test_no_date_at_all(spark):
    assert results(tp.standardize_date(column(spark, ["abc", None]), "v"), "v") == ["abc", None]


def test_names(spark):
    df = column(spark, ["Jean Paul Sartre", "Cher", "A  B", None, ""])
    assert results(tp.split_name(df, "v"), "v_prenom", "v_nom") == [
        ("Jean", "Paul Sartre"), ("Cher", ""), ("A", " B"), (None, None), ("", "")]
    assert results(tp.split_name(df, "v", "last_first"), "v_prenom")[0] == "Paul Sartre"
    with pytest.raises(ValueError):
        tp.split_name(df, "v", "middle")


def test_emails(spark):
    df = column(spark, ["a.b-c@x.org", "a+b@x.com", "a@b", "a@b.c\n", None, "no", "x@y@z.fr"])
    assert results(tp.check_email(df, "v"), "v_valide", "v_domaine") == [
        (True, "x.org"), (False, "x.com"), (False, "b"), (False, ""), (None, None), (False, ""), (False, "z.fr")]
    assert tp.check_email(df, "v", domain=False).columns == ["id", "v", "v_valide"]


def test_amounts(spark):
    df = column(spark, ["1.234,50 €", "-5", "", None, "1.234.56", "abc", "€ 7,5", "1-2"])
    assert results(tp.parse_currency(df, "v", ","), "v_num") == [1234.5, -5.0, None, None, 123456.0, None, 7.5, None]
    df = column(spark, ["$1,200.50", "1.234.56", "12 000.1"])
    assert results(tp.parse_currency(df, "v"), "v_num") == [1200.5, None, 12000.1]
    with pytest.raises(ValueError):
        tp.parse_currency(df, "v", ";")


def test_phones(spark):
    df = column(spark, ["06 12 34 56 78", "+33612345678", "0033 6 12 34 56 78", "+33 (0)6.12.34.56.78", "33612345678",
                        "junk", "0012", None, "+1 202-555-0123", "06 12 34"])
    done = tp.standardize_phone(df, "v", "FR", flag=True)
    assert results(done, "v") == ["+33612345678"] * 5 + ["junk", "0012", None, "+12025550123", "06 12 34"]
    assert results(done, "v_is_valid") == [True] * 5 + [False] * 3 + [True, False]


@pytest.mark.parametrize("country, value, expected", [
    ("US", "(202) 555-0123", "+12025550123"), ("US", "1-202-555-0123", "+12025550123"), ("US", "102-555-0123", "102-555-0123"),
    ("GB", "020 7946 0958", "+442079460958"), ("DE", "030 123456", "+4930123456"), ("DE", "0151 23456789", "+4915123456789"),
    ("CH", "044 668 18 00", "+41446681800"), ("ES", "612 34 56 78", "+34612345678"), ("US", "011 33 612345678", "+33612345678"),
])
def test_phone_countries(spark, country, value, expected):
    assert results(tp.standardize_phone(column(spark, [value]), "v", country), "v") == [expected]
    with pytest.raises(ValueError):
        tp.standardize_phone(column(spark, [value]), "v", "XX")


def test_a_phone_is_read_once(spark, plan_of):
    """One test of the shape for each plan, whatever is told about the number, and no search by kind."""
    df = tp.standardize_phone(spark.range(1).selectExpr("cast(id as string) as v"), "v", "CH", flag=True, kind=True)
    assert 0 < plan_of(df).upper().count("RLIKE") <= 6


@pytest.mark.parametrize("country, value, kind", [
    ("FR", "01 42 68 53 00", "fixed"), ("FR", "0262 12 34 56", None), ("FR", "0800 123 456", "free"), ("FR", "0712345678", None),
    ("US", "911-555-0123", None), ("US", "800-555-0123", "free"), ("US", "297 555 0123", None), ("US", "202-155-0123", None),
    ("GB", "0800 1111", "free"), ("GB", "07624 123456", "mobile"), ("GB", "07600 123456", "pager"), ("GB", "020 7946 095", None),
    ("DE", "0170 1234567", "mobile"), ("DE", "0170 12345678", None), ("DE", "0190 123456", None), ("CH", "079 123 45 67", "mobile"),
    ("CH", "023 123 45 67", None), ("ES", "900 123 456", "free"), ("ES", "99 123 45 67", None), ("ES", "+33 6 12 34 56 78", "mobile"),
])
def test_phone_plans(spark, country, value, kind):
    done = tp.standardize_phone(column(spark, [value]), "v", country, flag=True, kind=True).first()
    assert (done.v_kind, done.v_is_valid) == (kind, kind is not None)


def test_repair(spark):
    good = ["é à è ù â ê î ô û ë ï ü ç É Ê °", "10 €", "l'été – fin — fin", "clean 😀", None]
    damaged = [
        "Ã© Ã  Ã¨ Ã¹ Ã¢ Ãª Ã® Ã´ Ã» Ã« Ã¯ Ã¼ Ã§ Ã\u0089 Ã\u008a Â°", "10 â\u0082¬",
        "lâ\u0080\u0099Ã©tÃ© â\u0080\u0093 fin â\u0080\u0094 fin", "clean 😀", None]
    fixed = results(tp.repair_text(column(spark, damaged), "v"), "v")
    assert fixed == good
    assert results(tp.repair_text(column(spark, good), "v"), "v") == good


def test_repair_of_cp1252_damage(spark):
    good = "Ésope paie 10 € – l'âne"
    damaged = good.replace("'", "’").encode("utf-8").decode("cp1252")
    assert results(tp.repair_text(column(spark, [damaged]), "v"), "v") == [good]


def test_lone_letter_only_when_aggressive(spark):
    df = column(spark, ["Ãge", "Ã©Ã"])
    assert results(tp.repair_text(df, "v"), "v") == ["Ãge", "éÃ"]
    assert results(tp.repair_text(df, "v", aggressive=True), "v") == ["Àge", "éÀ"]
