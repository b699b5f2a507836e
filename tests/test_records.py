"""Records over line breaks: both starting states of a block, cut files against whole ones, and plans."""

import csv
import io
import json
import random

import pytest
from pyspark.sql import functions as F

import tableprep as tp
from tableprep.sources import records
from tableprep.sources.records import ends_inside, split_delimited


@pytest.fixture
def small_blocks(spark):
    """Blocks of some hundred bytes, so that small files have many of them and records go over their ends."""
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield spark
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


@pytest.mark.parametrize("line, outside, inside", [
    (b"a,b", False, True), (b'a,"b', True, False), (b'"a","b"', False, False), (b'a,5" pipe,c', False, False), (b'x","y', True, True),
    (b'"a ""b"" c', True, False), (b'""', False, True), (b'"', True, False), (b'say ""hi"" ,"', True, False), (b'a,"b"c,"d', True, True), (b"", False, True),
    (b'x ""y"" z', False, True), (b'x"",z,"",', False, True),
])
def test_both_states(line, outside, inside):
    assert (ends_inside(line, False, b","), ends_inside(line, True, b",")) == (outside, inside)


def put(path, text, encoding="utf-8"):
    path.write_bytes(text.encode(encoding))
    return str(path)


def values(seed, n=60):
    rng = random.Random(seed)
    pieces = ["plain", "é€", 'say "hi"', "two\nlines", "a,b", "", ",\n\n,", '"', '\n"', "x" * 900, 'long "\n' * 200, "\r\n in it"]
    return [[str(k), rng.choice(pieces) + rng.choice(pieces), rng.choice(pieces[:9])] for k in range(n)]


def as_text(rows, end="\n"):
    out = io.StringIO()
    csv.writer(out, lineterminator=end, quoting=csv.QUOTE_MINIMAL).writerows(rows)
    return out.getvalue()


def found_rows(df):
    return sorted((tuple("" if v is None else str(v) for v in r) for r in df.collect()), key=lambda r: int(r[0]))


@pytest.mark.parametrize("seed, end, encoding", [(1, "\n", "utf-8"), (2, "\r\n", "utf-8"), (3, "\n", "windows-1252")])
def test_cut_files_equal_the_written_rows(small_blocks, tmp_path, seed, end, encoding):
    rows = values(seed)
    path = put(tmp_path / "in.csv", as_text([["id", "a", "b\nb"], *rows], end), encoding)
    df = tp.read_delimited(small_blocks, path)
    assert df.columns == ["id", "a", "b_b"]
    assert found_rows(df) == sorted((tuple(r) for r in rows), key=lambda r: int(r[0]))
    assert df.select("id").schema[0].dataType.simpleString() == "int"


def test_stray_quotes_and_files_with_other_headers(small_blocks, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    put(folder / "1.csv", 'id,size,note\n1,5" pipe,x\n2,"two\nlines",y\n')
    put(folder / "2.csv", 'note,id,size\n"a\n\nb",3,7" pipe\n')
    put(folder / "3.csv", "")
    df = tp.read_delimited(small_blocks, str(folder)).select("id", "size", "note")
    assert found_rows(df) == [("1", '5" pipe', "x"), ("2", "two\nlines", "y"), ("3", '7" pipe', "a\n\nb")]


def test_bad_rows_open_quotes_and_headers_alone(small_blocks, tmp_path):
    path = put(tmp_path / "bad.csv", 'id,t\n1,"a\nb"\n2\n3,"c\n\nd",e\n')
    with pytest.raises(Exception, match="MALFORMED|Malformed"):
        tp.read_delimited(small_blocks, path).collect()
    assert [r.id for r in tp.read_delimited(small_blocks, path, bad_rows="drop").collect()] == [1]
    assert sorted(r["_corrupt_record"] for r in tp.read_delimited(small_blocks, path, bad_rows="only").collect()) == ["2", '3,"c\n\nd",e']
    with pytest.raises(ValueError, match="not closed"):
        tp.read_delimited(small_blocks, put(tmp_path / "open.csv", 'id,t\n1,"a\n2,b\n'))
    alone = tp.read_delimited(small_blocks, put(tmp_path / "alone.csv", 'id,"t\nu"\n'), multiline=True)
    assert alone.columns == ["id", "t_u"] and alone.collect() == []
    plain = tp.read_delimited(small_blocks, put(tmp_path / "plain.csv", '1,"a\nb"\n'), multiline=True, header=False)
    assert [tuple(r) for r in plain.collect()] == [(1, "a\nb")]


def test_separator_is_one_that_no_file_holds(small_blocks, tmp_path):
    path = put(tmp_path / "in.csv", 'id,t\n1,"a\x1e\n\x1f"\n')
    assert split_delimited(small_blocks, path, ",", "UTF-8", True).separator == "\x1d"
    assert [tuple(r) for r in tp.read_delimited(small_blocks, path).collect()] == [(1, "a\x1e\n\x1f")]
    path = put(tmp_path / "all.csv", f'id,t\n1,"a{"".join(records.SEPARATORS)}\nb"\n')
    assert split_delimited(small_blocks, path, ",", "UTF-8", True) is None
    assert tp.read_delimited(small_blocks, path).count() == 1


def test_one_file_is_read_by_many_tasks(spark, tmp_path):
    line = '7,"two\nlines with ""quotes""",end\n'
    path = put(tmp_path / "in.csv", "id,t,e\n" + line * 60_000)
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(256 << 10))
    try:
        df = tp.read_delimited(spark, path, sep=",", encoding="UTF-8", multiline=True)
        assert df.rdd.getNumPartitions() >= 8
        assert df.groupBy("id", "t", "e").count().collect() == [(7, 'two\nlines with "quotes"', "end", 60_000)]
        array = put(tmp_path / "in.json", "[" + ",".join('{"a": {"b": "x}]\\"{"}, "n": 1}' for _ in range(60_000)) + "]")
        objects = tp.read_json(spark, array, multiline=True)
        assert objects.rdd.getNumPartitions() >= 7
        assert objects.groupBy("a.b", "n").count().collect() == [('x}]"{', 1, 60_000)]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def objects(seed, n=60):
    rng = random.Random(seed)
    texts = ["plain", 'quote " and \\', "{[", "}]", "\\\\", "é中", "", "line\nbreak", 'x"' * 200, "\\" * 301]
    return [{"id": k, "t": rng.choice(texts), "o": {"l": [{"v": rng.choice(texts)}, {"v": "]"}]}, "e": []} for k in range(n)]


@pytest.mark.parametrize("indent", [None, 2])
def test_arrays_equal_their_objects(small_blocks, tmp_path, indent):
    folder = tmp_path / "in"
    folder.mkdir()
    expected = objects(indent or 0)
    put(folder / "a.json", " \n" + json.dumps(expected[:40], indent=indent, ensure_ascii=False) + "\n")
    put(folder / "b.json", json.dumps(expected[40:], indent=indent))
    put(folder / "c.json", "[]")
    put(folder / "d.json", "")
    df = tp.read_json(small_blocks, str(folder), multiline=True)
    found = sorted((json.loads(r.j) for r in df.select(F.to_json(F.struct(*df.columns)).alias("j")).collect()), key=lambda r: r["id"])
    assert found == expected
    one = tp.read_any(small_blocks, str(folder / "b.json"))
    assert one.count() == 20


def test_several_arrays_in_a_file(small_blocks, tmp_path):
    """Whatever bytes a block ends with: spaces move the cuts through the ends of the arrays."""
    folder, expected = tmp_path / "in", []
    folder.mkdir()
    for shift in range(24):
        parts = [objects(100 * shift + k, 6) for k in range(4)]
        expected += [row for part in parts for row in part]
        text = "\n".join(" " * shift + json.dumps(part) + ("" if k % 2 else "\n[]") for k, part in enumerate(parts))
        put(folder / f"{shift}.json", text)
    df = tp.read_json(small_blocks, str(folder), multiline=True)
    found = [json.loads(r.j) for r in df.select(F.to_json(F.struct(*df.columns)).alias("j")).collect()]
    assert sorted(map(json.dumps, found)) == sorted(map(json.dumps, [dict(sorted(row.items())) for row in expected]))


def test_other_json_files(small_blocks, tmp_path):
    assert tp.read_json(small_blocks, put(tmp_path / "o.json", '{"a": 1,\n "b": [1]}'), multiline=True).collect() == [(1, [1])]
    for text in ('[{"a": 1}, {"a": 2', '[{"a": 1}, {"a": "x}]'):
        with pytest.raises(ValueError, match="not closed"):
            tp.read_json(small_blocks, put(tmp_path / "broken.json", text), multiline=True)


def test_small_blocks_share_tasks(spark, tmp_path):
    from tableprep.sources.records import _few_tasks, _pieces

    path = put(tmp_path / "in.csv", 'a,"b\nc"\n' * 200_000)
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(8 << 10))
    try:
        lines = _pieces(spark, path, "\n")
        assert lines.rdd.getNumPartitions() > 100
        assert _few_tasks(lines).rdd.getNumPartitions() == 4 * spark.sparkContext.defaultParallelism
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
