"""Text, JSON, fixed-width and Parquet files written and read back.

The files go to the cluster's shared folder (``spark.checkpoint.dir``).
"""

from contextlib import contextmanager

from pyspark.sql import functions as F

import tableprep as tp
from checks import check, table
from checks.combining import versions
from checks.profiling import NOT_CP1252
from tableprep.scratch import new_path
from tableprep.sources.detect import score_delimiters

PART_TYPES = {"p_partkey": "bigint", "p_size": "int", "p_retailprice": "double"}


def typed(df, types):
    for name, dtype in types.items():
        df = tp.cast_column(df, name, dtype)
    return df


def _delimited(name, sep, shown):
    @check(f"roundtrip_{name}", f"""
        SELECT p_partkey, p_name || '{shown}"x"{shown}' AS p_name, p_brand, p_type, p_size, p_retailprice FROM part""")
    def query(spark, sf):
        path = new_path(spark, name)
        parts = table(spark, sf, "part").withColumn("p_name", F.concat("p_name", F.lit(f'{sep}"x"{sep}')))
        tp.write_delimited(parts, path, sep=sep)
        # Separator, encoding and types are detected.
        return typed(tp.read_delimited(spark, path), PART_TYPES)

    return query


for _name, _sep in (("comma", ","), ("semicolon", ";"), ("pipe", "|")):
    _delimited(_name, _sep, _sep)


@check("roundtrip_tab_cp1252", f"""
    SELECT doc_id, lang, regexp_replace(regexp_replace(text, '[\\r\\n\\t]+', ' ', 'g'), '{NOT_CP1252}', '?', 'g') AS text FROM documents""")
def roundtrip_tab_cp1252(spark, sf):
    path = new_path(spark, "cp1252")
    documents = table(spark, sf, "documents").select("doc_id", "lang", F.regexp_replace("text", "[\\r\\n\\t]+", " ").alias("text"))
    tp.write_delimited(documents, path, sep="\t", encoding="windows-1252")
    return typed(tp.read_delimited(spark, path, sep="\t", encoding="windows-1252"), {"doc_id": "bigint"})


@check("preset_mainframe", "SELECT c_custkey AS key, c_name AS name, c_mktsegment AS segment FROM customer")
def preset_mainframe(spark, sf):
    path = new_path(spark, "mainframe")
    tp.export(table(spark, sf, "customer").select("c_custkey", "c_name", "c_mktsegment"), path, "mainframe")
    rows = tp.read_delimited(spark, path, sep=";", encoding="windows-1252", header=False).toDF("key", "name", "segment")
    return typed(rows, {"key": "bigint"})


@check("preset_json", "SELECT event_id, event_type, value, props FROM events")
def preset_json(spark, sf):
    path = new_path(spark, "json")
    tp.export(table(spark, sf, "events").select("event_id", "event_type", "value", "props"), path, "json")
    return tp.read_any(spark, path)


@check("preset_parquet", "SELECT l_orderkey, l_linenumber, l_extendedprice, l_returnflag FROM lineitem")
def preset_parquet(spark, sf):
    path = new_path(spark, "export") + ".parquet"
    tp.export(table(spark, sf, "lineitem"), path, "parquet")
    return tp.read_any(spark, path).select("l_orderkey", "l_linenumber", "l_extendedprice", "l_returnflag")


WIDTHS = {"p_partkey": 10, "p_name": 8, "p_brand": 9, "p_size": 4, "p_retailprice": 12}
CELL = "rpad(substring(CAST({c} AS VARCHAR), 1, {w}), {w}, ' ')"


@check("fixed_width_lines", "SELECT " + " || ".join(CELL.format(c=c, w=w) for c, w in WIDTHS.items()) + " AS line FROM part")
def fixed_width_lines(spark, sf):
    return tp.to_fixed_width(table(spark, sf, "part").select(*WIDTHS), WIDTHS)


@check("fixed_width_roundtrip", "SELECT p_partkey, rtrim(left(p_name, 8)) AS p_name, p_brand, p_size, p_retailprice FROM part")
def fixed_width_roundtrip(spark, sf):
    path = new_path(spark, "fixed")
    tp.write_fixed_width(table(spark, sf, "part").select(*WIDTHS), path, WIDTHS)
    types = {**PART_TYPES, "p_name": "string", "p_brand": "string"}
    return tp.read_fixed_width(spark, path, [(c, w, types[c]) for c, w in WIDTHS.items()])


@check("delimited_preview", """
    SELECT 'c_custkey;c_name;c_note' AS line UNION ALL (SELECT c_custkey || ';' || c_name || ';"a;' || repeat(chr(34), 2) || c_mktsegment || repeat(chr(34), 3)
    FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 5)""")
def delimited_preview(spark, sf):
    note = F.concat(F.lit('a;"'), "c_mktsegment", F.lit('"'))
    best = tp.sort_rows(table(spark, sf, "customer"), ["c_acctbal", "c_custkey"], [True, False])
    return tp.delimited_preview(best.select("c_custkey", "c_name", note.alias("c_note")), sep=";")


# Lines with one field too many for some customers and one too few for others.
BROKEN = """SELECT c_custkey || ',"' || c_name || ',x"' || CASE WHEN c_mktsegment = 'BUILDING' THEN ',1,2' WHEN c_nationkey = 3 THEN ''
    ELSE ',' || c_mktsegment END AS value, c_mktsegment = 'BUILDING' AS long, c_mktsegment <> 'BUILDING' AND c_nationkey = 3 AS short FROM customer"""


@check("quoted_breaks", """
    SELECT doc_id, lang, replace(text, chr(13), ' ') || '"' || chr(10) || ',"' || source || '"' AS text, n_chars FROM documents""")
def quoted_breaks(spark, sf):
    """Whole texts with line breaks and quotes, in files that are cut into blocks of a fraction of their size."""
    path = new_path(spark, "breaks")
    text = F.concat(F.replace("text", F.lit("\r"), F.lit(" ")), F.lit('"\n,"'), "source", F.lit('"'))
    tp.write_delimited(table(spark, sf, "documents").select("doc_id", "lang", text.alias("text"), "n_chars"), path)
    with small_blocks(spark):
        found = tp.read_delimited(spark, path)
    return typed(found, {"doc_id": "bigint", "n_chars": "bigint"})


@check("json_array", "SELECT event_id, event_type, value, props FROM events")
def json_array(spark, sf):
    """Arrays of objects in files, cut into blocks of a fraction of their size."""
    path = new_path(spark, "array")
    events = table(spark, sf, "events").select("event_id", "event_type", "value", "props")
    # One array on a line for each hundred thousand events; a file may hold several.
    part = F.floor(F.col("event_id") / 100_000).alias("part")
    arrays = events.groupBy(part).agg(F.to_json(F.collect_list(F.struct(*events.columns))).alias("value"))
    arrays.select("value").write.text(path)
    with small_blocks(spark):
        return tp.read_json(spark, path, multiline=True, schema=events.schema)


@contextmanager
def small_blocks(spark):
    """Blocks of 256 KB, so that files of test size are cut as files of many gigabytes are."""
    name = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(name)
    spark.conf.set(name, str(256 << 10))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def broken_lines(spark, sf):
    path = new_path(spark, "broken")
    value = F.expr("""concat(c_custkey, ',"', c_name, ',x"', CASE WHEN c_mktsegment = 'BUILDING' THEN ',1,2' WHEN c_nationkey = 3 THEN ''
        ELSE concat(',', c_mktsegment) END)""")
    lines = table(spark, sf, "customer").select(value.alias("value"))
    # A header line in each part file, as a parallel export writes it.
    lines = lines.withColumn("first", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1) == 0)
    headed = lines.select(F.explode(F.when(F.col("first"), F.array(F.lit("key,name,segment"), "value")).otherwise(F.array("value"))).alias("value"))
    headed.write.text(path)
    return path


@check("jagged_rows", f"""
    SELECT 3 AS expected, CASE WHEN long THEN 4 ELSE 2 END AS actual, left(value, 50) || CASE WHEN length(value) > 50 THEN '...' ELSE '' END AS content
    FROM ({BROKEN}) WHERE long OR short""")
def jagged_rows(spark, sf):
    return tp.jagged_rows(spark, broken_lines(spark, sf), sep=",").select("expected", "actual", "content")


@check("bad_rows_dropped", f"SELECT CAST(c_custkey AS BIGINT) AS key, c_name || ',x' AS name, c_mktsegment AS segment FROM customer WHERE c_mktsegment <> 'BUILDING' AND c_nationkey <> 3")
def bad_rows_dropped(spark, sf):
    schema = spark.createDataFrame([], "key bigint, name string, segment string").schema
    return tp.read_delimited(spark, broken_lines(spark, sf), sep=",", schema=schema, bad_rows="drop")


@check("bad_rows_only", f"""
    SELECT CAST(string_split(value, ',')[1] AS BIGINT) AS key, value AS line FROM ({BROKEN}) WHERE long OR short""")
def bad_rows_only(spark, sf):
    schema = spark.createDataFrame([], "key bigint, name string, segment string").schema
    bad = tp.read_delimited(spark, broken_lines(spark, sf), sep=",", schema=schema, bad_rows="only")
    return bad.select("key", F.col("_corrupt_record").alias("line"))


def _scores_sql():
    lines = "SELECT c_custkey || ';' || c_name || ';a|b,' || c_mktsegment || CASE WHEN c_nationkey = 1 THEN ',' ELSE '' END AS value FROM customer"
    parts = [
        f"""SELECT {i} AS rank, {d} AS delimiter, avg(len(string_split(value, {d}))) AS avg_columns,
            round(var_pop(len(string_split(value, {d}))), 9) AS variance FROM ({lines})"""
        for i, d in enumerate(("','", "';'", "chr(9)", "'|'"))
    ]
    return f"SELECT *, round(avg_columns * 10 - variance * 100, 6) AS score FROM ({' UNION ALL '.join(parts)})"


@check("delimiter_scores", _scores_sql())
def delimiter_scores(spark, sf):
    line = F.expr("concat(c_custkey, ';', c_name, ';a|b,', c_mktsegment, CASE WHEN c_nationkey = 1 THEN ',' ELSE '' END)")
    scores = score_delimiters(table(spark, sf, "customer").select(line.alias("value")))
    return scores.withColumns({"variance": F.round("variance", 9), "score": F.round("score", 6)})


@check("export_diff", """
    WITH a AS (SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderstatus <> 'F'),
      b AS (SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderpriority <> '5-LOW')
    SELECT 'added' AS status, * FROM (SELECT * FROM b EXCEPT SELECT * FROM a)
    UNION ALL SELECT 'removed', * FROM (SELECT * FROM a EXCEPT SELECT * FROM b)""")
def export_diff(spark, sf):
    path = new_path(spark, "diff")
    tp.write_delimited(tp.row_diff(*versions(spark, sf)), path)
    return typed(tp.read_delimited(spark, path), {"o_orderkey": "bigint", "o_totalprice": "double"})


@check("export_pivot", """
    SELECT o_custkey, count(o_totalprice) FILTER (o_orderstatus = 'F') AS f, count(o_totalprice) FILTER (o_orderstatus = 'O') AS o,
      count(o_totalprice) FILTER (o_orderstatus = 'P') AS p FROM orders GROUP BY o_custkey""")
def export_pivot(spark, sf):
    path = new_path(spark, "pivot")
    tp.write_delimited(tp.pivot(table(spark, sf, "orders"), "o_custkey", "o_orderstatus", "o_totalprice"), path, sep=";")
    return typed(tp.read_delimited(spark, path), {c: "bigint" for c in ("o_custkey", "f", "o", "p")})
