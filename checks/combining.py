"""Lookups, updates, maps, zones, duplicates, comparison."""

from pyspark.sql import functions as F

import tableprep as tp
from checks import check, table


@check("lookup_nation", """
    SELECT customer.*, n_name, n_regionkey FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey""")
def lookup_nation(spark, sf):
    return tp.lookup(table(spark, sf, "customer"), table(spark, sf, "nation"), "c_nationkey", "n_nationkey", ["n_name", "n_regionkey"])


@check("lookup_many", """
    SELECT o_orderkey, o_custkey, l_linenumber, l_quantity FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey""")
def lookup_many(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    return tp.lookup(orders, table(spark, sf, "lineitem"), "o_orderkey", "l_orderkey", ["l_linenumber", "l_quantity"])


@check("lookup_same_names", """
    SELECT a.doc_id, a.source, b.source AS source_1, b.lang FROM documents a
    LEFT JOIN (SELECT l.doc_id, d.source, d.lang FROM labels l JOIN documents d ON d.doc_id = l.doc_id) b ON a.doc_id = b.doc_id""")
def lookup_same_names(spark, sf):
    documents = table(spark, sf, "documents").select("doc_id", "source")
    labelled = table(spark, sf, "labels").select("doc_id").join(table(spark, sf, "documents"), "doc_id")
    return tp.lookup(documents, labelled, "doc_id", "doc_id", ["source", "lang"])


@check("update_by_key", """
    SELECT d.doc_id, lang, CASE WHEN l.doc_id IS NULL THEN n_chars ELSE nullif(l.quality, 0) END AS quality, toxic
    FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""")
def update_by_key(spark, sf):
    documents = table(spark, sf, "documents").select("doc_id", "lang", F.col("n_chars").alias("quality"))
    labels = table(spark, sf, "labels").withColumn("quality", F.nullif("quality", F.lit(0)))
    return tp.update_by_key(documents, labels, "doc_id")


@check("value_map", """
    SELECT p_partkey, CASE p_type WHEN 'ECONOMY' THEN 'cheap' WHEN 'SMALL' THEN 'little' ELSE p_type END AS p_type FROM part""")
def value_map(spark, sf):
    parts = table(spark, sf, "part").select("p_partkey", "p_type")
    return tp.map_values(parts, "p_type", {"ECONOMY": "cheap", "SMALL": "little", "NONE": "x"})


@check("value_map_table", """
    SELECT s_suppkey, s_nationkey, n_name AS nation FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey""")
def value_map_table(spark, sf):
    nations = table(spark, sf, "nation").select(F.col("n_nationkey").cast("string").alias("old"), F.col("n_name").alias("new"))
    return tp.map_values(table(spark, sf, "supplier").select("s_suppkey", "s_nationkey"), "s_nationkey", nations, to="nation")


def addresses(spark, sf):
    resolved = table(spark, sf, "nation").join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    resolved = resolved.where("r_name <> 'ASIA'").select(
        F.col("n_name").alias("query"), F.concat("n_name", F.lit(" ("), "r_name", F.lit(")")).alias("label"),
        F.lower("n_name").alias("city"), F.nullif("r_name", F.lit("AFRICA")).alias("context"),
        (F.col("n_nationkey") + F.lit(0.5)).alias("lat"), (F.col("n_regionkey") - F.lit(10.25)).alias("lon"),
    )
    nation = table(spark, sf, "nation").select("n_nationkey", F.col("n_name").alias("place"))
    customers = table(spark, sf, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    return customers.select("c_custkey", "place"), resolved


ADDRESSES = """SELECT c_custkey, n_name AS place, {shown} AS place_geo FROM customer JOIN nation n ON c_nationkey = n_nationkey
    LEFT JOIN (SELECT * FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name <> 'ASIA') r USING (n_name)"""


@check("address_full", ADDRESSES.format(shown="n_name || ' (' || r_name || ')'"))
def address_full(spark, sf):
    rows, resolved = addresses(spark, sf)
    return tp.normalize_address(rows, "place", resolved)


@check("address_city", ADDRESSES.format(
    shown="CASE WHEN r.r_name IS NULL THEN NULL ELSE lower(n_name) || ', ' || CASE WHEN r_name <> 'AFRICA' THEN r_name ELSE '' END END"))
def address_city(spark, sf):
    rows, resolved = addresses(spark, sf)
    return tp.normalize_address(rows, "place", resolved, "city")


@check("address_gps", ADDRESSES.format(
    shown="CAST(r.n_nationkey + 0.5::DOUBLE AS VARCHAR) || ', ' || CAST(r.n_regionkey - 10.25::DOUBLE AS VARCHAR)"))
def address_gps(spark, sf):
    rows, resolved = addresses(spark, sf)
    return tp.normalize_address(rows, "place", resolved, "gps")


# Each kind of event stands for a place, some of them misspelt or unknown.
EVENT_PLACES = "CASE event_type WHEN 'click' THEN 'Paris' WHEN 'view' THEN 'new york' WHEN 'error' THEN 'Tokio' WHEN 'purchase' THEN 'Atlantis' ELSE 'Base' END"
CITIES = [("Paris", "Europe/Paris"), ("New York", "America/New_York"), ("Tokyo", "Asia/Tokyo")]


def meetings(spark, sf):
    return table(spark, sf, "events").select(
        "event_id", F.expr(EVENT_PLACES).alias("place"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("local")
    )


def zones(spark, sf):
    cities = spark.createDataFrame(CITIES, "city string, zone string")
    return tp.resolve_zones(meetings(spark, sf), "place", cities, {"Base": "Asia/Kolkata"})


ZONES_SQL = """SELECT DISTINCT {p} AS place, CASE {p} WHEN 'Paris' THEN 'Europe/Paris' WHEN 'new york' THEN 'America/New_York'
    WHEN 'Tokio' THEN 'Asia/Tokyo' WHEN 'Base' THEN 'Asia/Kolkata' END AS zone,
    CASE {p} WHEN 'Tokio' THEN 'near' WHEN 'Base' THEN 'manual' WHEN 'Atlantis' THEN 'unresolved' ELSE 'exact' END AS how
    FROM events""".format(p=EVENT_PLACES)


@check("zone_resolve", ZONES_SQL)
def zone_resolve(spark, sf):
    return zones(spark, sf)


@check("zone_normalize", f"""
    SELECT event_id, e.place, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS local,
      strftime(timezone('Europe/Paris', timezone(zone, date_trunc('second', ts))), '%Y-%m-%d %H:%M:%S') AS local_local
    FROM (SELECT *, {EVENT_PLACES} AS place FROM events) e JOIN ({ZONES_SQL}) z ON e.place = z.place""")
def zone_normalize(spark, sf):
    return tp.to_zone(meetings(spark, sf), "local", "place", zones(spark, sf))


@check("zone_overwrite", f"""
    SELECT event_id, e.place, coalesce(strftime(timezone('UTC', timezone(zone, date_trunc('second', ts))), '%Y-%m-%d %H:%M:%S'),
      strftime(ts, '%Y-%m-%dT%H:%M:%S')) AS local
    FROM (SELECT *, {EVENT_PLACES} AS place FROM events) e JOIN ({ZONES_SQL}) z ON e.place = z.place""")
def zone_overwrite(spark, sf):
    return tp.to_zone(meetings(spark, sf), "local", "place", zones(spark, sf), target="UTC", overwrite=True)


# Users write places in many ways: other word order, several edits, words left out.
USER_PLACES = """CASE user_id % 9 WHEN 0 THEN 'York New' WHEN 1 THEN 'Nwe Yrok City' WHEN 2 THEN 'St Petersburg' WHEN 3 THEN 'Rio Janeiro' WHEN 4 THEN 'Sao Paulo'
    WHEN 5 THEN 'Atlantis' WHEN 6 THEN 'los angelas' WHEN 7 THEN 'Buenos-Ayres' ELSE 'Tokio' END"""
MORE_CITIES = [
    *CITIES, ("Saint Petersburg", "Europe/Moscow"), ("Rio de Janeiro", "America/Sao_Paulo"), ("Sao Paulo", "America/Sao_Paulo"),
    ("Los Angeles", "America/Los_Angeles"), ("Buenos Aires", "America/Argentina/Buenos_Aires"), ("Los Alamos", "America/Denver"),
]
_GRAMS = "list_distinct(list_transform(range(1, length({v}) + 2), lambda i: substr(' ' || lower({v}) || ' ', i, 2)))"


@check("zone_similar", f"""
    WITH cities(city, zone) AS (VALUES {", ".join(f"('{c.lower()}', '{z}')" for c, z in MORE_CITIES)}),
      places AS (SELECT DISTINCT {USER_PLACES} AS place FROM events),
      r AS (SELECT city, unnest({_GRAMS.format(v="city")}) AS gram FROM cities),
      w AS (SELECT gram, ln(1 + (SELECT count(*) FROM cities)::DOUBLE / count(*)) AS weight FROM r GROUP BY gram),
      q AS (SELECT place, gram, coalesce(weight, ln(1 + (SELECT count(*) FROM cities)::DOUBLE)) AS weight
            FROM (SELECT place, unnest({_GRAMS.format(v="place")}) AS gram FROM places) LEFT JOIN w USING (gram)),
      rn AS (SELECT city, sum(weight * weight) AS norm FROM r JOIN w USING (gram) GROUP BY city),
      qn AS (SELECT place, sum(weight * weight) AS norm FROM q GROUP BY place),
      s AS (SELECT place, city, round(sum(q.weight * q.weight) / sqrt(any_value(qn.norm) * any_value(rn.norm)), 9) AS score
            FROM q JOIN r USING (gram) JOIN qn USING (place) JOIN rn USING (city) GROUP BY place, city),
      best AS (SELECT place, first(city ORDER BY score DESC, city) AS city, max(score) AS score FROM s WHERE score >= 0.5 GROUP BY place),
      near AS (SELECT place, first(city ORDER BY levenshtein(lower(place), city), city) AS city, min(levenshtein(lower(place), city)) AS edits
               FROM places, cities WHERE levenshtein(lower(place), city) <= 1 GROUP BY place)
    SELECT place, zone, CASE WHEN edits = 0 THEN 'exact' WHEN edits = 1 THEN 'near' WHEN best.city IS NOT NULL THEN 'similar' ELSE 'unresolved' END AS how,
      CASE WHEN edits IS NULL THEN score END AS score
    FROM places LEFT JOIN near USING (place) LEFT JOIN best USING (place) LEFT JOIN cities ON cities.city = coalesce(near.city, best.city)""")
def zone_similar(spark, sf):
    cities = spark.createDataFrame(MORE_CITIES, "city string, zone string")
    return tp.resolve_zones(table(spark, sf, "events").select(F.expr(USER_PLACES).alias("place")), "place", cities, least_score=0.5)


def ordered_copies(spark, sf):
    orders = table(spark, sf, "orders").select("o_custkey", "o_orderstatus", "o_orderpriority")
    return orders.unionByName(orders.where("o_orderstatus = 'F'"))


COPIES = """SELECT o_custkey, o_orderstatus, o_orderpriority FROM orders UNION ALL
    SELECT o_custkey, o_orderstatus, o_orderpriority FROM orders WHERE o_orderstatus = 'F'"""


@check("duplicate_summary", f"""
    SELECT CAST(coalesce(sum(n - 1), 0) AS BIGINT) AS surplus, count(*) AS groups
    FROM (SELECT count(*) AS n FROM ({COPIES}) GROUP BY o_custkey, o_orderstatus, o_orderpriority HAVING count(*) > 1)""")
def duplicate_summary(spark, sf):
    return tp.duplicate_summary(ordered_copies(spark, sf))


@check("duplicate_groups", """
    SELECT count, md5(text) AS digest, lang FROM (SELECT count(*) AS count, text, lang FROM documents GROUP BY text, lang
      HAVING count(*) > 1 ORDER BY count DESC, text, lang LIMIT 5)""")
def duplicate_groups(spark, sf):
    groups = tp.duplicate_groups(table(spark, sf, "documents").select("text", "lang"))
    return groups.select("count", F.md5("text").alias("digest"), "lang")


@check("merge_duplicates", f"SELECT DISTINCT * FROM ({COPIES})")
def merge_duplicates(spark, sf):
    return tp.merge_duplicates(ordered_copies(spark, sf))


@check("merge_duplicates_text", "SELECT md5(text) AS digest, lang FROM (SELECT DISTINCT text, lang FROM documents)")
def merge_duplicates_text(spark, sf):
    merged = tp.merge_duplicates(table(spark, sf, "documents").select("text", "lang"))
    return merged.select(F.md5("text").alias("digest"), "lang")


@check("distinct_values", "SELECT DISTINCT l_shipdate::DATE::VARCHAR AS day FROM lineitem")
def distinct_values(spark, sf):
    return tp.distinct_values(table(spark, sf, "lineitem").select(F.date_format("l_shipdate", "yyyy-MM-dd").alias("day")), "day")


RANKED = """SELECT {out} FROM (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY {order}) AS rn FROM {source}) WHERE rn = 1"""


@check("dedup_first", RANKED.format(out="event_id, user_id, event_type, value", key="user_id", order="ts, event_id", source="events"))
def dedup_first(spark, sf):
    kept = tp.dedup(table(spark, sf, "events"), ["user_id"], order_by=["ts", "event_id"])
    return kept.select("event_id", "user_id", "event_type", "value")


@check("dedup_last", RANKED.format(
    out="conv_id, turn, role, text", key="conv_id, role", order="turn DESC", source="conversations"))
def dedup_last(spark, sf):
    return tp.dedup(table(spark, sf, "conversations"), ["conv_id", "role"], keep="last", order_by="turn")


SPELLED = "SELECT p_partkey, CASE WHEN p_size > 25 THEN ' ' || upper(p_name) || '  ' ELSE nullif(p_name, 'red rod') END AS p_name, p_brand FROM part"


def spelled_parts(spark, sf):
    name = F.expr("CASE WHEN p_size > 25 THEN concat(' ', upper(p_name), '  ') ELSE nullif(p_name, 'red rod') END")
    return table(spark, sf, "part").select("p_partkey", name.alias("p_name"), "p_brand")


@check("dedup_smart", RANKED.format(
    out="p_partkey, p_name, p_brand", key="trim(upper(p_name)), trim(upper(p_brand))", order="p_partkey", source=f"({SPELLED})"))
def dedup_smart(spark, sf):
    return tp.dedup(spelled_parts(spark, sf), ["p_name", "p_brand"], mode="smart", order_by="p_partkey")


@check("dedup_preview", f"""
    SELECT CAST(sum(n) AS BIGINT) AS rows, count(*) AS kept, CAST(sum(n) - count(*) AS BIGINT) AS removed
    FROM (SELECT count(*) AS n FROM ({SPELLED}) GROUP BY trim(upper(p_name)))""")
def dedup_preview(spark, sf):
    return tp.dedup_preview(spelled_parts(spark, sf), ["p_name"], "smart")


@check("row_diff", """
    WITH a AS (SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderstatus <> 'F'),
      b AS (SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderpriority <> '5-LOW')
    SELECT 'added' AS status, * FROM (SELECT * FROM b EXCEPT SELECT * FROM a)
    UNION ALL SELECT 'removed', * FROM (SELECT * FROM a EXCEPT SELECT * FROM b)""")
def row_diff(spark, sf):
    return tp.row_diff(*versions(spark, sf))


def versions(spark, sf):
    orders = table(spark, sf, "orders")
    columns = ["o_orderkey", "o_orderstatus", "o_totalprice"]
    # The second version has another column order.
    return orders.where("o_orderstatus <> 'F'").select(columns), orders.where("o_orderpriority <> '5-LOW'").select(columns[::-1])


@check("row_diff_counts", """
    WITH a AS (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'F'), b AS (SELECT o_orderkey FROM orders WHERE o_orderpriority <> '5-LOW')
    SELECT 'added' AS status, count(*) AS rows FROM (SELECT * FROM b EXCEPT SELECT * FROM a)
    UNION ALL SELECT 'removed', count(*) FROM (SELECT * FROM a EXCEPT SELECT * FROM b)""")
def row_diff_counts(spark, sf):
    return tp.diff_counts(tp.row_diff(*versions(spark, sf)))


@check("row_diff_bag", """
    WITH a AS (SELECT l_returnflag, l_linestatus, l_quantity FROM lineitem WHERE l_discount < 0.05),
      b AS (SELECT l_returnflag, l_linestatus, l_quantity FROM lineitem WHERE l_tax < 0.04)
    SELECT 'added' AS status, * FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a)
    UNION ALL SELECT 'removed', * FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b)""")
def row_diff_bag(spark, sf):
    lines = table(spark, sf, "lineitem")
    columns = ["l_returnflag", "l_linestatus", "l_quantity"]
    return tp.row_diff(lines.where("l_discount < 0.05").select(columns), lines.where("l_tax < 0.04").select(columns), mode="bag")


@check("row_diff_key", """
    WITH a AS (SELECT o_orderkey AS k, o_orderstatus AS s, o_totalprice AS p FROM orders WHERE o_orderstatus <> 'F'),
      b AS (SELECT o_orderkey AS k, CASE WHEN o_totalprice > 300000 THEN 'X' ELSE o_orderstatus END AS s,
        CASE WHEN o_orderpriority = '2-HIGH' THEN NULL ELSE o_totalprice END AS p FROM orders WHERE o_orderpriority <> '5-LOW')
    SELECT CASE WHEN a.k IS NULL THEN 'added' WHEN b.k IS NULL THEN 'removed' ELSE 'changed' END AS status,
      coalesce(b.k, a.k) AS k, CASE WHEN b.k IS NULL THEN a.s ELSE b.s END AS s, CASE WHEN b.k IS NULL THEN a.p ELSE b.p END AS p,
      CASE WHEN a.k IS NOT NULL AND b.k IS NOT NULL THEN concat_ws(',', CASE WHEN a.s IS DISTINCT FROM b.s THEN 's' END,
        CASE WHEN a.p IS DISTINCT FROM b.p THEN 'p' END) END AS changed_columns
    FROM a FULL JOIN b ON a.k = b.k WHERE a.k IS NULL OR b.k IS NULL OR a.s IS DISTINCT FROM b.s OR a.p IS DISTINCT FROM b.p""")
def row_diff_key(spark, sf):
    orders = table(spark, sf, "orders")
    a = orders.where("o_orderstatus <> 'F'").selectExpr("o_orderkey AS k", "o_orderstatus AS s", "o_totalprice AS p")
    b = orders.where("o_orderpriority <> '5-LOW'").selectExpr(
        "o_orderkey AS k", "CASE WHEN o_totalprice > 300000 THEN 'X' ELSE o_orderstatus END AS s",
        "CASE WHEN o_orderpriority = '2-HIGH' THEN NULL ELSE o_totalprice END AS p",
    )
    return tp.row_diff(a, b, key="k")
