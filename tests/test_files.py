import os

import pytest
from pyspark.sql import functions as F

import tableprep as tp
from tableprep.sources import detect, writers

BODY = [["id", "First Name", "note"], ["1", "Ana", '"x;y,z|w"'], ["2", "Bob", "plain"]]


def put(folder, name, data):
    path = os.path.join(folder, name)
    with open(path, "wb") as file:
        file.write(data if isinstance(data, bytes) else data.encode())
    return path


@pytest.mark.parametrize("name, sep", [("comma.csv", ","), ("semicolon.csv", ";"), ("tab.tsv", "\t"), ("pipe.txt", "|")])
def test_delimiters(spark, tmp_path, name, sep):
    lines = [[c if c != '"x;y,z|w"' else f'"x{sep}y"' for c in line] for line in BODY] + [["3", "Cid", "more"]] * 8
    path = put(tmp_path, name, "\n".join(sep.join(line) for line in lines))
    df = tp.read_delimited(spark, path, sep=tp.detect_delimiter(spark, path))
    assert df.columns == ["id", "first_name", "note"] and df.count() == 10
    assert df.where("id = 1").first()["note"] == f"x{sep}y"


def test_no_delimiter_means_comma(spark, tmp_path):
    assert tp.detect_delimiter(spark, put(tmp_path, "one.txt", "a\nb\n\nc\n")) == ","
    assert tp.detect_delimiter(spark, put(tmp_path, "empty.txt", "")) == ","


def test_scores(spark, tmp_path):
    path = put(tmp_path, "s.txt", "a;b;c\n1;2;3\n\n4;5,6;7\n")
    scores = {r["delimiter"]: r["score"] for r in tp.delimiter_scores(spark, path).collect()}
    assert scores[";"] == 30.0 and scores[","] == pytest.approx(40 / 3 - 100 * 2 / 9) and scores["\t"] == 10.0


def test_encodings(spark, tmp_path):
    old = put(tmp_path, "cp1252.csv", b"name;price\nCaf\xe9;10 \x80\n")
    new = put(tmp_path, "utf8.csv", "name;price\nCafé;10 €\n")
    assert (tp.detect_encoding(spark, old), tp.detect_encoding(spark, new)) == ("windows-1252", "UTF-8")
    for path in (old, new):
        assert tuple(tp.read_delimited(spark, path).first()) == ("Café", "10 €")


def test_byte_order_mark(spark, tmp_path):
    path = put(tmp_path, "bom.csv", "\ufeffid;name\n1;é\n")
    df = tp.read_delimited(spark, path)
    assert df.columns == ["id", "name"] and tuple(df.first()) == (1, "é")
    assert tp.detect_format(spark, put(tmp_path, "bom.json", '\ufeff{"a": 1}')) == "JSON"


def test_format_and_newline(spark, tmp_path):
    array = put(tmp_path, "array.json", '\n [{"a": 1, "n": {"x": 2}},\n {"a": null, "n": {"x": 3}}]')
    lines = put(tmp_path, "lines.json", '{"a": 1}\n{"a": 2}\n')
    text = put(tmp_path, "t.csv", "a,b\r\n1,2\r\n")
    mac = put(tmp_path, "mac.csv", "a,b\r1,2\r")
    assert [tp.detect_format(spark, p) for p in (array, lines, text)] == ["JSON", "JSON", "CSV"]
    assert [tp.detect_newline(spark, p) for p in (lines, text, mac)] == ["\n", "\r\n", "\r"]
    assert tp.read_any(spark, array).count() == 2 and tp.read_any(spark, lines).count() == 2
    assert sorted(r["n"]["x"] for r in tp.read_json(spark, array, multiline=True).collect()) == [2, 3]
    assert tuple(tp.read_any(spark, text).first()) == (1, 2)


def test_file_info(spark, tmp_path):
    path = put(tmp_path, "five.txt", "12345")
    assert [(r["name"], r["size"]) for r in tp.file_info(spark, path).collect()] == [("five.txt", 5)]


def test_bad_rows_are_never_lost_unseen(spark, tmp_path):
    path = put(tmp_path, "bad.csv", "id,v\n1,a\n2\n3,c,x\n4,d\n")
    read = lambda mode: tp.read_delimited(spark, path, sep=",", bad_rows=mode)
    good = read("drop")
    assert good.count() == 2 and len(good.collect()) == 2 and good.select("id").count() == 2
    assert sorted(r["_corrupt_record"] for r in read("only").collect()) == ["2", "3,c,x"]
    assert read("keep").count() == 4
    with pytest.raises(ValueError):
        read("hide")


def test_jagged_rows(spark, tmp_path):
    text = 'a;b;c\n\n1;2;3\n1;2\n"x;y";2;3\n   \n1;2;3;4 ' + "z" * 60 + "\n"
    path = put(tmp_path, "jagged.csv", text)
    found = [tuple(r) for r in tp.jagged_rows(spark, path, ";").orderBy("row").collect()]
    assert [f[1:4] for f in found] == [(3, 3, 2), (5, 3, 4)]
    assert found[0][0] == "jagged.csv" and found[1][4].endswith("z...") and len(found[1][4]) == 53
    clean = put(tmp_path, "clean.csv", "a,b\n1,2\n")
    assert tp.jagged_rows(spark, clean).count() == 0


def test_line_numbers_across_splits(spark, tmp_path):
    lines = [f"{i},x" if i % 1000 else f"{i}" for i in range(1, 20001)]
    path = put(tmp_path, "long.csv", "\n".join(["id,v", *lines]))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16384")
    try:
        assert spark.read.text(path).rdd.getNumPartitions() > 4
        found = {r["content"]: r["row"] for r in tp.jagged_rows(spark, path, ",").collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert found == {f"{i}": i + 1 for i in range(1000, 20001, 1000)}


ODD = [(1, 'q"u;o,te', None, 0), (2, "", "é€→", 5), (3, "tab\there", " lead", None)]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, "id long, a string, b string, n int").coalesce(1)


def content(path, encoding="utf-8"):
    names = [n for n in sorted(os.listdir(path)) if n.startswith("part-")]
    return "".join(open(os.path.join(path, n), encoding=encoding, newline="").read() for n in names)


def test_every_value_is_quoted(odd, path):
    tp.write_delimited(odd, path, sep=";")
    assert content(path) == '"id";"a";"b";"n"\n"1";"q""u;o,te";"";"0"\n"2";"";"é€→";"5"\n"3";"tab\there";" lead";""\n'


def test_cp1252_export(spark, odd, path):
    tp.export(odd, path, "mainframe")
    assert content(path, "cp1252") == '"1";"q""u;o,te";"";"0"\n"2";"";"é€?";"5"\n"3";"tab\there";" lead";""\n'
    with pytest.raises(ValueError):
        tp.export(odd, path, "xlsx")


def test_json_keeps_nulls(odd, path):
    tp.write_json(odd, path)
    assert '{"id":1,"a":"q\\"u;o,te","b":null,"n":0}' in content(path)


def test_preview(odd):
    lines = [r["line"] for r in tp.delimited_preview(odd, 2, ";").collect()]
    assert lines == ["id;a;b;n", '1;"q""u;o,te";;0', "2;;é€→;5"]
    assert [r["line"] for r in tp.delimited_preview(odd, 1, ",", header=False).collect()] == ['1,"q""u;o,te",,0']


def test_fixed_width(spark, odd, tmp_path):
    lines = [r["line"] for r in tp.to_fixed_width(odd, {"id": 3, "a": 4, "b": 5, "n": 2}).collect()]
    assert lines == ['1  q"u;     0 ', "2      é€→  5 ", "3  tab\t lead  "]
    assert {len(r["line"]) for r in tp.to_fixed_width(odd).collect()} == {60}
    assert tp.line_width(odd, {"id": 40}) == {"width": 85, "fits_80": False, "fits_132": True}
    with pytest.raises(ValueError):
        tp.to_fixed_width(odd, {"id": 0})
    path = put(tmp_path, "fixed.txt", "0012Ana  \n 34 Bob")
    assert [tuple(r) for r in tp.read_fixed_width(spark, path, [("id", 4, "int"), ("name", 5)]).collect()] == [(12, "Ana"), (34, "Bob")]


def test_multiline_values(spark, path):
    df = spark.createDataFrame([(1, "two\nlines"), (2, "one")], "id int, t string")
    tp.write_delimited(df, path)
    assert sorted(r["t"] for r in tp.read_delimited(spark, path, multiline=True).collect()) == ["one", "two\nlines"]


def test_presets_cover_the_formats():
    assert {p["format"] for p in writers.PRESETS.values()} == {"csv", "json", "parquet"}
    assert detect.DELIMITERS == (",", ";", "\t", "|")
