"""Search, rules, sorting, paging, places, SQL and recipes."""

from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

import tableprep as tp
from checks import check, table
from tableprep.scratch import new_path

CUSTOMER_NULLS = "SELECT * REPLACE (nullif(c_mktsegment, 'BUILDING') AS c_mktsegment) FROM customer"


def customers_with_nulls(spark, sf):
    return table(spark, sf, "customer").withColumn("c_mktsegment", F.nullif("c_mktsegment", F.lit("BUILDING")))


@check("search_any", """
    SELECT * FROM customer WHERE CAST(c_custkey AS VARCHAR) ILIKE '%mach%' OR c_name ILIKE '%mach%'
    OR CAST(c_nationkey AS VARCHAR) ILIKE '%mach%' OR CAST(c_acctbal AS VARCHAR) ILIKE '%mach%'
    OR c_mktsegment ILIKE '%mach%'""")
def search_any(spark, sf):
    return tp.search(table(spark, sf, "customer"), "mach")


@check("search_literal", """
    SELECT p_partkey, p_brand FROM part
    WHERE contains(CAST(p_partkey AS VARCHAR), '#1') OR contains(lower(p_brand), '#1')""")
def search_literal(spark, sf):
    return tp.search(table(spark, sf, "part").select("p_partkey", "p_brand"), "#1", literal=True)


def rule(column, operator, value="", **more):
    return [{"column": column, "operator": operator, "value": value, "active": True, **more}]


@check("rule_equals", "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus = 'F'")
def rule_equals(spark, sf):
    return tp.apply_rules(table(spark, sf, "orders"), rule("o_orderstatus", "equals", "F")).select("o_orderkey", "o_orderstatus")


@check("rule_not_equals", f"SELECT * FROM ({CUSTOMER_NULLS}) WHERE c_mktsegment <> 'MACHINERY'")
def rule_not_equals(spark, sf):
    return tp.apply_rules(customers_with_nulls(spark, sf), rule("c_mktsegment", "not_equals", "MACHINERY"))


@check("rule_contains", "SELECT p_partkey, p_name FROM part WHERE p_name ILIKE '%BOLT%'")
def rule_contains(spark, sf):
    return tp.apply_rules(table(spark, sf, "part"), rule("p_name", "contains", "BOLT")).select("p_partkey", "p_name")


@check("rule_not_contains", f"SELECT * FROM ({CUSTOMER_NULLS}) WHERE c_mktsegment NOT ILIKE '%ur%'")
def rule_not_contains(spark, sf):
    return tp.apply_rules(customers_with_nulls(spark, sf), rule("c_mktsegment", "not_contains", "ur"))


@check("rule_greater_than", "SELECT * FROM customer WHERE c_acctbal > 5000.5")
def rule_greater_than(spark, sf):
    return tp.apply_rules(table(spark, sf, "customer"), rule("c_acctbal", "greater_than", "5000.5"))


@check("rule_less_than", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderdate < TIMESTAMP '1996-01-01'")
def rule_less_than(spark, sf):
    found = tp.apply_rules(table(spark, sf, "orders"), rule("o_orderdate", "less_than", "1996-01-01"))
    return found.select("o_orderkey", "o_totalprice")


@check("rule_starts_with", "SELECT doc_id, lang, source FROM documents WHERE text ILIKE 'the%'")
def rule_starts_with(spark, sf):
    return tp.apply_rules(table(spark, sf, "documents"), rule("text", "starts_with", "the")).select("doc_id", "lang", "source")


@check("rule_ends_with", "SELECT page_id, url FROM pages WHERE url ILIKE '%#TOP'")
def rule_ends_with(spark, sf):
    return tp.apply_rules(table(spark, sf, "pages"), rule("url", "ends_with", "#TOP")).select("page_id", "url")


@check("rule_is_empty", f"SELECT * FROM ({CUSTOMER_NULLS}) WHERE c_mktsegment IS NULL OR c_mktsegment = ''")
def rule_is_empty(spark, sf):
    return tp.apply_rules(customers_with_nulls(spark, sf), rule("c_mktsegment", "is_empty"))


@check("rule_is_not_empty", f"SELECT * FROM ({CUSTOMER_NULLS}) WHERE c_mktsegment IS NOT NULL AND c_mktsegment <> ''")
def rule_is_not_empty(spark, sf):
    return tp.apply_rules(customers_with_nulls(spark, sf), rule("c_mktsegment", "is_not_empty"))


@check("rule_set", """
    SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem
    WHERE l_returnflag = 'A' AND l_quantity > 10 AND l_discount < 0.05""")
def rule_set(spark, sf):
    rules = [
        {"column": "l_quantity", "operator": "greater_than", "value": "10", "active": True, "priority": 2},
        {"column": "l_returnflag", "operator": "equals", "value": "A", "active": True, "priority": 1},
        {"column": "l_discount", "operator": "less_than", "value": "0.05", "active": True, "priority": 3},
        {"column": "l_tax", "operator": "equals", "value": "0", "active": False, "priority": 4},
        {"column": "", "operator": "equals", "value": "x", "active": True, "priority": 5},
    ]
    return tp.apply_rules(table(spark, sf, "lineitem"), rules).select("l_orderkey", "l_linenumber", "l_quantity")


@check("rule_template", """
    SELECT * FROM part WHERE p_type ILIKE '%o%' AND p_name ILIKE '%ring%'""")
def rule_template(spark, sf):
    rules = rule("p_name", "contains", "o", id="a") + rule("p_brand", "contains", "ring", id="b")
    saved = tp.save_template("two texts", rules)
    return tp.apply_rules(table(spark, sf, "part"), tp.bind_template(saved, ["p_type", "p_name"]))


@check("sort_page", """
    SELECT * FROM customer WHERE c_mktsegment ILIKE '%e%' AND c_acctbal > 0
    ORDER BY c_acctbal DESC NULLS LAST, c_custkey LIMIT 100""")
def sort_page(spark, sf):
    return tp.page(
        table(spark, sf, "customer"), 100, rules=rule("c_mktsegment", "contains", "e") + rule("c_acctbal", "greater_than", "0"),
        sort=["c_acctbal", "c_custkey"], desc=[True, False],
    )


@check("sort_multi", f"SELECT * FROM ({CUSTOMER_NULLS}) ORDER BY c_mktsegment NULLS LAST, c_acctbal DESC")
def sort_multi(spark, sf):
    return tp.sort_rows(customers_with_nulls(spark, sf), ["c_mktsegment", "c_acctbal"], [False, True])


PLACES = """SELECT c_custkey AS id, CAST(c_nationkey * 3 AS VARCHAR) AS lat,
    CASE WHEN c_mktsegment = 'BUILDING' THEN 'abc' ELSE CAST(CAST(c_acctbal AS DECIMAL(9, 2)) AS VARCHAR) END AS lon
    FROM customer"""


def places(spark, sf):
    lon = F.expr("CASE WHEN c_mktsegment = 'BUILDING' THEN 'abc' ELSE CAST(CAST(c_acctbal AS DECIMAL(9, 2)) AS STRING) END")
    return table(spark, sf, "customer").select(
        F.col("c_custkey").alias("id"), (F.col("c_nationkey") * 3).cast("string").alias("lat"), lon.alias("lon")
    )


@check("geo_box", f"""
    SELECT id, CAST(lat AS DOUBLE) AS lat, TRY_CAST(lon AS DOUBLE) AS lon FROM ({PLACES})
    WHERE TRY_CAST(lat AS DOUBLE) BETWEEN 10 AND 40 AND TRY_CAST(lon AS DOUBLE) BETWEEN 500 AND 6000""")
def geo_box(spark, sf):
    return tp.geo_box(places(spark, sf), "lat", "lon", 10, 40, 500, 6000)


@check("geo_around", f"""
    SELECT id, lat, lon FROM (SELECT c_custkey AS id, c_nationkey * 1.5::DOUBLE AS lat, c_acctbal / 1000 AS lon FROM customer)
    WHERE lat BETWEEN 23 AND 25 AND lon BETWEEN 2.5 AND 4.5""")
def geo_around(spark, sf):
    points = table(spark, sf, "customer").selectExpr("c_custkey AS id", "c_nationkey * 1.5D AS lat", "c_acctbal / 1000 AS lon")
    return tp.around(points, "lat", "lon", (24.0, 3.5))


@check("map_points", f"""
    SELECT lat, lng, label FROM (SELECT TRY_CAST(lat AS DOUBLE) AS lat, TRY_CAST(lon AS DOUBLE) AS lng,
      CAST(id AS VARCHAR) AS label FROM ({PLACES}))
    WHERE lat IS NOT NULL AND lng IS NOT NULL""")
def map_points(spark, sf):
    return tp.map_points(places(spark, sf))


STATUS_SQL = """
    SELECT o_orderstatus, count(*) AS orders, max(o_totalprice) AS largest
    FROM current_dataset GROUP BY o_orderstatus"""


@check("sql_view", STATUS_SQL.replace("current_dataset", "orders"))
def sql_view(spark, sf):
    return tp.sql(table(spark, sf, "orders"), STATUS_SQL)


SEGMENTS_SQL = """
    WITH sums AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey)
    SELECT c_mktsegment, CAST(sum(n) AS BIGINT) AS orders FROM {t} JOIN sums ON o_custkey = c_custkey GROUP BY c_mktsegment"""


@check("sql_view_join", SEGMENTS_SQL.format(t="customer"))
def sql_view_join(spark, sf):
    return tp.sql(
        table(spark, sf, "customer"), SEGMENTS_SQL.format(t="current_dataset"), orders=table(spark, sf, "orders")
    )


@check("recipe_replay", """
    SELECT c_custkey, upper(c_name) AS name, n_name, c_acctbal * 1.1 AS adjusted
    FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey WHERE c_acctbal > 100""")
def recipe_replay(spark, sf):
    recipe = (
        tp.Recipe(source="customer")
        .add("apply_rules", rules=rule("c_acctbal", "greater_than", "100"))
        .add("change_case", step_kind="CLEAN", col="c_name", kind="upper")
        .add("lookup", ref={"table": "nation"}, left_key="c_nationkey", right_key="n_nationkey", cols=["n_name"])
        .add("formula", name="adjusted", expression="c_acctbal * 1.1D")
        .add("rename", mapping={"c_name": "name"})
        .add("hide_columns", hidden=["c_nationkey", "c_acctbal", "c_mktsegment"])
    )
    replayed = tp.Recipe.from_json(recipe.to_json())
    return replayed.apply(table(spark, sf, "customer"), {"nation": table(spark, sf, "nation")})


@check("row_loss_guard", """
    SELECT o_orderkey, o_orderstatus FROM orders WHERE o_totalprice > 1001""")
def row_loss_guard(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    kept = tp.apply_rules(orders, rule("o_totalprice", "greater_than", "1001"))
    return tp.guard_row_loss(orders, kept, pct=5).drop("o_totalprice")


@check("enrich_merge", """
    SELECT c_custkey, c_name, c_nationkey, c_acctbal,
      CASE WHEN c_mktsegment = 'BUILDING' THEN NULL ELSE lower(c_mktsegment) END AS c_mktsegment,
      CAST(length(c_name) AS BIGINT) AS name_length FROM customer""")
def enrich_merge(spark, sf):
    def fn(rows):
        segment = rows["c_mktsegment"].str.lower().where(rows["c_mktsegment"] != "BUILDING", None)
        return rows[["c_custkey"]].assign(c_mktsegment=segment, name_length=rows["c_name"].str.len())

    return tp.enrich(
        table(spark, sf, "customer"), fn, "c_custkey bigint, c_mktsegment string, name_length bigint",
        hidden=["c_acctbal"], key="c_custkey",
    )


@check("enrich_resumed", """
    SELECT c_custkey, c_name, c_nationkey, c_acctbal, upper(c_mktsegment) AS c_mktsegment, CAST(length(c_name) AS BIGINT) AS name_length FROM customer""")
def enrich_resumed(spark, sf):
    """The function fails at one customer; the same call with the same ledger goes on where it stopped."""
    def asking(fails):
        def fn(rows):
            if fails and (rows["c_custkey"] == 700).any():
                raise RuntimeError("the service is away")
            return rows[["c_custkey"]].assign(c_mktsegment=rows["c_mktsegment"].str.upper(), name_length=rows["c_name"].str.len())

        return fn

    ledger = new_path(spark, "ledger")
    customers, schema = table(spark, sf, "customer"), "c_custkey bigint, c_mktsegment string, name_length bigint"
    options = {"key": "c_custkey", "hidden": ["c_acctbal"], "batch_size": 200, "ledger": ledger, "batches_at_once": 4}
    try:
        tp.enrich(customers, asking(True), schema, **options)
    except StreamingQueryException:
        pass
    return tp.enrich(customers, asking(False), schema, **options)


@check("stream_arrivals", """
    SELECT event_id, upper(event_type) AS event_type, user_id, value FROM events WHERE value > 10""")
def stream_arrivals(spark, sf):
    """Row-wise steps on files as they arrive: two runs, the second goes on after the files that the first one took."""
    source, out, progress = (new_path(spark, name) for name in ("arriving", "cleaned", "progress"))
    events = table(spark, sf, "events").select("event_id", "event_type", "user_id", "value")
    recipe = tp.Recipe().add("apply_rules", rules=[{"column": "value", "operator": "greater_than", "value": "10"}])
    recipe = recipe.add("change_case", col="event_type", kind="upper")
    for which in ("event_id % 3 = 0", "event_id % 3 <> 0"):
        events.where(which).repartition(4).write.mode("append").parquet(source)
        tp.clean_arrivals(spark, source, events.schema, recipe, out, progress).awaitTermination()
    return spark.read.schema(events.schema).parquet(out)
