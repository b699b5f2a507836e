"""Inputs that once lost or changed rows: each whole table, with names, types and files that clash."""

from pyspark.sql import functions as F

import tableprep as tp
from checks import check, table
from tableprep.scratch import new_path
from tableprep.sources.detect import detect_delimiter, detect_encoding, detect_newline

NAMES = "SELECT DISTINCT c_name AS v FROM customer"


@check("near_pairs_dense", f"""
    SELECT a.v AS v1, b.v AS v2, levenshtein(a.v, b.v)::INTEGER AS distance FROM ({NAMES}) a JOIN ({NAMES}) b ON a.v < b.v
    AND levenshtein(a.v, b.v) <= 3""")
def near_pairs_dense(spark, sf):
    return tp.near_pairs(table(spark, sf, "customer"), "c_name", 3)


@check("near_pairs_cut", """
    SELECT a.v AS v1, b.v AS v2, levenshtein(a.v, b.v)::INTEGER AS distance FROM (SELECT DISTINCT s_name AS v FROM supplier) a
    JOIN (SELECT DISTINCT s_name AS v FROM supplier) b ON a.v < b.v AND levenshtein(a.v, b.v) <= 1""")
def near_pairs_cut(spark, sf):
    return tp.near_pairs(table(spark, sf, "supplier"), "s_name", 1, bucket_limit=20)


@check("near_clusters_dense", """
    WITH RECURSIVE n AS (SELECT DISTINCT s_name AS v FROM supplier), e AS (SELECT a.v AS a, b.v AS b FROM n a JOIN n b ON a.v <> b.v
      AND levenshtein(a.v, b.v) <= 3), r(value, member) AS (SELECT a, a FROM e UNION SELECT r.value, e.b FROM r JOIN e ON r.member = e.a)
    SELECT value, min(member) AS canonical FROM r GROUP BY value""")
def near_clusters_dense(spark, sf):
    return tp.near_clusters(table(spark, sf, "supplier"), "s_name", 3)


@check("map_points_all", "SELECT CAST(l_quantity AS DOUBLE) AS lat, l_discount AS lng FROM lineitem WHERE l_quantity IS NOT NULL AND l_discount IS NOT NULL")
def map_points_all(spark, sf):
    return tp.map_points(table(spark, sf, "lineitem").select(F.col("l_quantity").alias("lat"), F.col("l_discount").alias("lon")))


@check("timeline_all", "SELECT ts, hour(ts) + minute(ts) / 60.0 AS hour_of_day FROM events WHERE ts IS NOT NULL")
def timeline_all(spark, sf):
    return tp.timeline(table(spark, sf, "events"), "ts")


@check("daily_counts_all", "SELECT CAST(l_shipdate AS DATE) AS date, count(*) AS count FROM lineitem GROUP BY 1")
def daily_counts_all(spark, sf):
    return tp.daily_counts(table(spark, sf, "lineitem"), "l_shipdate")


@check("histogram_text", """
    WITH v AS (SELECT TRY_CAST(CASE WHEN c_nationkey = 3 THEN 'none' ELSE CAST(c_acctbal AS VARCHAR) END AS DOUBLE) AS x FROM customer),
      b AS (SELECT min(x) AS low, (max(x) - min(x)) / 20 AS width FROM v)
    SELECT bin, round(bin * width + low, 6) AS lower, count(*) AS count
    FROM (SELECT CAST(floor((x - low) / width) AS BIGINT) AS bin, low, width FROM v, b WHERE x IS NOT NULL) GROUP BY bin, low, width""")
def histogram_text(spark, sf):
    value = F.when(F.col("c_nationkey") == 3, "none").otherwise(F.col("c_acctbal").cast("string"))
    return tp.histogram(table(spark, sf, "customer").select(value.alias("x")), "x").withColumn("lower", F.round("lower", 6))


@check("roundtrip_documents", "SELECT doc_id, text, lang, n_chars FROM documents")
def roundtrip_documents(spark, sf):
    """Raw texts with their line breaks, written and read back with nothing but the path given."""
    path = new_path(spark, "documents")
    tp.write_delimited(table(spark, sf, "documents").select("doc_id", "text", "lang", "n_chars"), path)
    back = tp.read_delimited(spark, path)
    return tp.cast_column(tp.cast_column(back, "doc_id", "bigint"), "n_chars", "bigint")


@check("columns_by_name", "SELECT s_suppkey, s_name, s_acctbal FROM supplier")
def columns_by_name(spark, sf):
    """Files of one folder that order their columns differently."""
    path, rows = new_path(spark, "orders"), table(spark, sf, "supplier")
    tp.write_delimited(rows.where("s_suppkey % 2 = 0").select("s_suppkey", "s_name", "s_acctbal"), path)
    tp.write_delimited(rows.where("s_suppkey % 2 = 1").select("s_acctbal", "s_suppkey", "s_name"), path, mode="append")
    back = tp.read_delimited(spark, path)
    return back.select(F.col("s_suppkey").cast("bigint").alias("s_suppkey"), "s_name", F.col("s_acctbal").cast("double").alias("s_acctbal"))


@check("detected", "SELECT 'windows-1252' AS encoding, ';' AS delimiter, chr(10) AS newline, count(*) AS rows FROM documents")
def detected(spark, sf):
    """What is detected of a windows-1252 file with semicolons."""
    path = new_path(spark, "detected")
    docs = table(spark, sf, "documents").select("doc_id", F.concat(F.lit("é "), F.regexp_replace("text", "[\r\n;,\t|\"]+", " ")).alias("text"), "lang")
    tp.write_delimited(docs, path, sep=";", encoding="windows-1252")
    encoding = detect_encoding(spark, path)
    rows = tp.read_delimited(spark, path).agg(F.count("*").alias("rows"))
    return rows.select(
        F.lit(encoding).alias("encoding"), F.lit(detect_delimiter(spark, path, encoding)).alias("delimiter"),
        F.lit(detect_newline(spark, path)).alias("newline"), "rows",
    )


@check("fixed_width_cp1252", """
    SELECT doc_id, rtrim(left(regexp_replace(regexp_replace(text, '[\\r\\n]', ' ', 'g'), '[^\\x00-\\xFF]', '?', 'g'), 40)) AS text FROM documents""")
def fixed_width_cp1252(spark, sf):
    """Texts with accents and line breaks in lines of one byte a character."""
    path = new_path(spark, "fixed")
    tp.write_fixed_width(table(spark, sf, "documents").select("doc_id", "text"), path, {"doc_id": 10, "text": 40}, encoding="windows-1252")
    return tp.read_fixed_width(spark, path, [("doc_id", 10, "bigint"), ("text", 40)], encoding="windows-1252")


@check("lookup_taken_names", """
    SELECT n_nationkey, n_name, n_name AS n_name_1, n_regionkey, upper(n_name) AS n_name_2 FROM nation""")
def lookup_taken_names(spark, sf):
    nations = table(spark, sf, "nation").withColumn("n_name_1", F.col("n_name"))
    ref = nations.select(F.col("n_nationkey").alias("key"), F.upper("n_name").alias("N_NAME"))
    found = tp.lookup(nations, ref.withColumnRenamed("N_NAME", "n_name"), "n_nationkey", "key", ["n_name"])
    return found.select("n_nationkey", "n_name", "n_name_1", "n_regionkey", "n_name_2")


@check("update_by_case", """
    SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN upper(s_name) ELSE s_name END AS s_name, s_acctbal FROM supplier""")
def update_by_case(spark, sf):
    rows = table(spark, sf, "supplier").select("s_suppkey", "s_name", "s_acctbal")
    new = rows.where("s_suppkey % 3 = 0").select("s_suppkey", F.upper("s_name").alias("S_NAME"))
    return tp.update_by_key(rows, new, "s_suppkey")


@check("row_diff_types", """
    SELECT CASE WHEN a.k IS NULL THEN 'added' WHEN b.k IS NULL THEN 'removed' ELSE 'changed' END AS status, coalesce(b.k, a.k) AS k, coalesce(b.v, a.v) AS v,
      CASE WHEN a.k IS NOT NULL AND b.k IS NOT NULL THEN 'v' END AS changed_columns
    FROM (SELECT c_custkey AS k, CAST(c_nationkey AS VARCHAR) AS v FROM customer WHERE c_custkey % 7 <> 0) a
    FULL JOIN (SELECT c_custkey AS k, CASE WHEN c_custkey % 5 = 0 THEN 'x' ELSE CAST(c_nationkey AS VARCHAR) END AS v FROM customer WHERE c_custkey % 11 <> 0) b
      ON a.k = b.k WHERE a.v IS DISTINCT FROM b.v
    UNION ALL SELECT 'removed', NULL, CAST(c_nationkey AS VARCHAR), NULL FROM customer WHERE c_custkey <= 2""")
def row_diff_types(spark, sf):
    """Numbers against text, and two rows without a key."""
    rows = table(spark, sf, "customer")
    old = rows.where("c_custkey % 7 <> 0").selectExpr("c_custkey as k", "c_nationkey as v")
    old = old.unionAll(rows.where("c_custkey <= 2").selectExpr("cast(null as bigint)", "c_nationkey"))
    new = rows.where("c_custkey % 11 <> 0").selectExpr("c_custkey as k", "case when c_custkey % 5 = 0 then 'x' else cast(c_nationkey as string) end as v")
    return tp.row_diff(old, new, key="k")


@check("schema_diff", "SELECT * FROM (VALUES ('o_comment', 'added'), ('o_clerk', 'removed')) t(column_, status)".replace("column_", '"column"'))
def schema_diff(spark, sf):
    orders = table(spark, sf, "orders")
    return tp.schema_diff(orders.withColumn("o_clerk", F.lit(1)), orders.withColumn("o_comment", F.lit("")))


@check("fingerprint_marks", """
    SELECT DISTINCT lang || ' Dvořák ' || 'é' AS value, 'dvorak e ' || lang AS fingerprint, lang || ' Dvořák ' || 'é' AS canonical, 2::BIGINT AS size FROM documents
    UNION ALL SELECT DISTINCT lang || ' dvorak e', 'dvorak e ' || lang, lang || ' Dvořák ' || 'é', 2::BIGINT FROM documents""".replace("'dvorak e ' || lang", "array_to_string(list_sort([lang, 'dvorak', 'e']), ' ')"))
def fingerprint_marks(spark, sf):
    """Decomposed accents and letters beyond Latin-1."""
    lang = table(spark, sf, "documents").select("lang").distinct()
    spelt = lang.select(F.concat("lang", F.lit(" Dvořák é")).alias("v")).unionAll(lang.select(F.concat("lang", F.lit(" dvorak e"))))
    return tp.fingerprint_clusters(spelt, "v")


@check("recipe_session", """
    SELECT nation, rows * 2 AS rows FROM (SELECT s_nationkey AS nation, count(*) AS rows FROM supplier WHERE s_acctbal > 0 GROUP BY 1)""")
def recipe_session(spark, sf):
    """Load, filter, ask in SQL and enrich, replayed from JSON."""
    path = new_path(spark, "session")
    tp.write_delimited(table(spark, sf, "supplier"), path)
    steps = (
        tp.Recipe().add("read_delimited", path=path)
        .add("cast_column", col="s_acctbal", dtype="double")
        .add("apply_rules", rules=[{"column": "s_acctbal", "operator": "greater_than", "value": "0"}])
        .add("sql", text="SELECT CAST(s_nationkey AS INT) AS nation, count(*) AS rows FROM current_dataset GROUP BY 1")
        .add("enrich", fn={"function": "double"}, schema="nation int, rows bigint", key="nation", step_kind="AI")
    )
    double = lambda frame: frame.assign(rows=frame["rows"] * 2)
    return tp.Recipe.from_json(steps.to_json()).apply(spark, functions={"double": double})
