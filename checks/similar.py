"""Near-equal values and clusters."""

from pyspark.sql import functions as F

import tableprep as tp
from checks import check, table

PAIRS = """SELECT a.v AS v1, b.v AS v2, levenshtein(a.v, b.v)::INTEGER AS distance FROM (SELECT DISTINCT {c} AS v FROM {t}) a
    JOIN (SELECT DISTINCT {c} AS v FROM {t}) b ON a.v < b.v AND levenshtein(a.v, b.v) BETWEEN 1 AND {d}"""


@check("near_pairs", PAIRS.format(c="p_name", t="part", d=3))
def near_pairs(spark, sf):
    return tp.near_pairs(table(spark, sf, "part"), "p_name")


@check("near_pairs_url", PAIRS.format(c="url", t="pages", d=2))
def near_pairs_url(spark, sf):
    return tp.near_pairs(table(spark, sf, "pages"), "url", 2)


@check("near_clusters", f"""
    WITH RECURSIVE p AS ({PAIRS.format(c="url", t="pages", d=1)}), e AS (SELECT v1 AS a, v2 AS b FROM p UNION SELECT v2, v1 FROM p),
      r(value, member) AS (SELECT a, a FROM e UNION SELECT r.value, e.b FROM r JOIN e ON r.member = e.a)
    SELECT value, min(member) AS canonical FROM r GROUP BY value""")
def near_clusters(spark, sf):
    return tp.near_clusters(table(spark, sf, "pages"), "url", 1)


@check("near_clusters_merge", f"""
    WITH RECURSIVE p AS ({PAIRS.format(c="p_name", t="part", d=1)}), e AS (SELECT v1 AS a, v2 AS b FROM p UNION SELECT v2, v1 FROM p),
      r(value, member) AS (SELECT a, a FROM e UNION SELECT r.value, e.b FROM r JOIN e ON r.member = e.a),
      c AS (SELECT value, min(member) AS canonical FROM r GROUP BY value)
    SELECT p_partkey, coalesce(canonical, p_name) AS p_name FROM part LEFT JOIN c ON p_name = value""")
def near_clusters_merge(spark, sf):
    parts = table(spark, sf, "part").select("p_partkey", "p_name")
    return tp.merge_clusters(parts, "p_name", tp.near_clusters(parts, "p_name", 1))


SPELLINGS = """SELECT p_partkey, CASE WHEN p_size < 10 THEN upper(p_name) WHEN p_size < 20 THEN string_split(p_name, ' ')[2] || ', ' || string_split(p_name, ' ')[1]
    WHEN p_size < 30 THEN replace(p_name, 'e', 'é') ELSE p_name END AS name FROM part"""
CLUSTERS = f"""SELECT value, fingerprint, first(value) OVER (PARTITION BY fingerprint ORDER BY -length(value), value) AS canonical,
    count(*) OVER (PARTITION BY fingerprint) AS size FROM (SELECT DISTINCT name AS value, array_to_string(list_sort(list_distinct(string_split(
      trim(regexp_replace(strip_accents(lower(name)), '[^a-z0-9]+', ' ', 'g')), ' '))), ' ') AS fingerprint FROM ({SPELLINGS}))
    QUALIFY size > 1"""


def spellings(spark, sf):
    name = F.expr("""CASE WHEN p_size < 10 THEN upper(p_name) WHEN p_size < 20 THEN concat(split(p_name, ' ')[1], ', ', split(p_name, ' ')[0])
        WHEN p_size < 30 THEN replace(p_name, 'e', 'é') ELSE p_name END""")
    return table(spark, sf, "part").select("p_partkey", name.alias("name"))


@check("fingerprint_clusters", CLUSTERS)
def fingerprint_clusters(spark, sf):
    return tp.fingerprint_clusters(spellings(spark, sf), "name")


@check("merge_clusters", f"""
    SELECT p_partkey, coalesce(canonical, name) AS name FROM ({SPELLINGS}) LEFT JOIN ({CLUSTERS}) ON name = value""")
def merge_clusters(spark, sf):
    rows = spellings(spark, sf)
    return tp.merge_clusters(rows, "name", tp.fingerprint_clusters(rows, "name"))


GRAMS = "list_distinct(list_transform(range(1, length({v}) + 2), lambda i: substr(' ' || lower({v}) || ' ', i, 2)))"
MISSPELT = """SELECT p_partkey, CASE p_size % 6 WHEN 0 THEN upper(p_name) WHEN 1 THEN replace(p_name, 'e', 'ee') WHEN 2 THEN p_name || ' part'
    WHEN 3 THEN string_split(p_name, ' ')[2] || ' ' || string_split(p_name, ' ')[1] WHEN 4 THEN left(p_name, length(p_name) - 2) ELSE p_name END AS name FROM part"""
SIMILAR = f"""v AS (SELECT name AS value, {GRAMS.format(v="name")} AS g FROM (SELECT DISTINCT trim(name) AS name FROM ({MISSPELT})) WHERE name <> ''),
    o AS (SELECT *, row_number() OVER (ORDER BY length(value) DESC, value) AS i FROM v),
    p AS (SELECT a.i AS i, b.i AS j, a.value AS first, b.value AS second, len(list_intersect(a.g, b.g)) AS s, len(a.g) + len(b.g) - len(list_intersect(a.g, b.g)) AS u
          FROM o a JOIN o b ON a.i < b.i WHERE 100 * s >= greatest(60, 90 - (3 * length(a.value)) // 4) * u)"""


def misspelt(spark, sf):
    name = F.expr("""CASE p_size % 6 WHEN 0 THEN upper(p_name) WHEN 1 THEN replace(p_name, 'e', 'ee') WHEN 2 THEN concat(p_name, ' part')
        WHEN 3 THEN concat(split(p_name, ' ')[1], ' ', split(p_name, ' ')[0]) WHEN 4 THEN left(p_name, length(p_name) - 2) ELSE p_name END""")
    return table(spark, sf, "part").select("p_partkey", name.alias("name"))


@check("similar_pairs", f"WITH {SIMILAR} SELECT first, second, round(s / u, 9) AS similarity FROM p")
def similar_pairs(spark, sf):
    return tp.similar_pairs(misspelt(spark, sf), "name").withColumn("similarity", F.round("similarity", 9))


LEADERS = f"""WITH RECURSIVE {SIMILAR}, e AS (SELECT j, list(i) AS earlier FROM p GROUP BY j),
    r(i, leaders) AS (SELECT 0::BIGINT, []::BIGINT[] UNION ALL
      SELECT r.i + 1, CASE WHEN list_has_any(leaders, coalesce(earlier, [])) THEN leaders ELSE list_append(leaders, r.i + 1) END
      FROM r LEFT JOIN e ON e.j = r.i + 1 WHERE r.i < (SELECT count(*) FROM o)),
    l AS (SELECT unnest(leaders) AS i FROM r WHERE i = (SELECT count(*) FROM o)),
    m AS (SELECT p.j, min(p.i) AS i FROM p JOIN l USING (i) GROUP BY p.j),
    c AS (SELECT j AS k, i FROM m UNION ALL SELECT DISTINCT i, i FROM m),
    s AS (SELECT a.value, b.value AS canonical, count(*) OVER (PARTITION BY c.i) AS size FROM c JOIN o a ON a.i = c.k JOIN o b ON b.i = c.i)"""


@check("similar_clusters", f"{LEADERS} SELECT * FROM s")
def similar_clusters(spark, sf):
    return tp.similar_clusters(misspelt(spark, sf), "name")


@check("similar_clusters_merge", f"{LEADERS} SELECT p_partkey, coalesce(canonical, name) AS name FROM ({MISSPELT}) LEFT JOIN s ON name = value")
def similar_clusters_merge(spark, sf):
    rows = misspelt(spark, sf)
    return tp.merge_clusters(rows, "name", tp.similar_clusters(rows, "name"))
