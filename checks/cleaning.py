"""Names, columns, and parsing of text."""

from pyspark.sql import functions as F

import tableprep as tp
from checks import check, table
from tableprep.functions import phones
from tableprep.operators.parse import EMAIL, EMAIL_DOMAIN


@check("rename_swap", "SELECT s_suppkey AS id, s_nationkey AS s_acctbal, s_acctbal AS s_nationkey, s_name FROM supplier")
def rename_swap(spark, sf):
    renamed = tp.rename(
        table(spark, sf, "supplier"), {"s_suppkey": "id", "s_nationkey": "s_acctbal", "s_acctbal": "s_nationkey"}
    )
    return tp.reorder(renamed, ["s_name", "id"])


@check("drop_columns", "SELECT p_partkey, p_brand, p_size FROM part")
def drop_columns(spark, sf):
    return tp.drop_columns(table(spark, sf, "part"), "p_name", "p_type", "p_retailprice")


@check("hide_columns", "SELECT c_custkey, c_nationkey, c_mktsegment FROM customer")
def hide_columns(spark, sf):
    return tp.hide_columns(table(spark, sf, "customer"), ["c_name", "c_acctbal"])


@check("mainframe_names", """
    SELECT l_orderkey AS "L_ORDERKEY", l_linenumber AS "LLINENUMBE", l_extendedprice AS "LEXTENDEDP",
      l_returnflag AS "LRETURNFLA", l_linestatus AS "LLINESTATU", l_returnflag AS "LRETURNF_1" FROM lineitem""")
def mainframe_names(spark, sf):
    lines = table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_extendedprice", "l_returnflag", "l_linestatus",
        F.col("l_returnflag").alias("l_return_flag_2"),
    )
    return tp.mainframe_names(lines)


@check("normalize_headers", """
    SELECT s_suppkey AS supplier_key, s_name AS _select, s_acctbal AS montant_eur, s_nationkey AS _select_1 FROM supplier""")
def normalize_headers(spark, sf):
    raw = table(spark, sf, "supplier").select("s_suppkey", "s_name", "s_acctbal", "s_nationkey")
    return tp.normalize_headers(raw.toDF("Supplier Key", "select", "Montant (EUR)", "Select!"))


@check("copybook_names", """
    SELECT c_custkey AS CUSTNO, c_name AS NAME, c_nationkey AS NATION, c_acctbal, c_mktsegment FROM customer""")
def copybook_names(spark, sf):
    text = "  05 CUSTNO  PIC 9(9)\n\n  05 NAME PIC X(30).\n NATION\n"
    return tp.rename_from_copybook(table(spark, sf, "customer"), text)


@check("row_ids", "SELECT count(*) AS rows, count(*) AS kept, CAST(0 AS BIGINT) AS removed FROM lineitem")
def row_ids(spark, sf):
    return tp.dedup_preview(tp.add_row_id(table(spark, sf, "lineitem")), ["row_id"])


@check("formula", """
    SELECT l_orderkey, l_linenumber, l_extendedprice * (1 - l_discount) * (1 + l_tax) AS charge,
      CASE WHEN l_tax = 0 THEN NULL ELSE l_discount / l_tax END AS ratio FROM lineitem""")
def formula(spark, sf):
    lines = tp.formula(table(spark, sf, "lineitem"), "charge", "l_extendedprice * (1 - l_discount) * (1 + l_tax)")
    lines = tp.formula(lines, "ratio", "try_divide(l_discount, l_tax)")
    return lines.select("l_orderkey", "l_linenumber", "charge", "ratio")


@check("formula_text", "SELECT event_id, TRY_CAST(regexp_extract(props, '[0-9]+') AS DOUBLE) AS k FROM events")
def formula_text(spark, sf):
    return tp.formula(table(spark, sf, "events"), "k", "regexp_extract(props, '[0-9]+', 0)").select("event_id", "k")


@check("formula_math", """
    SELECT c_custkey, floor(c_acctbal / 100) AS hundreds, abs(c_acctbal) AS size, CAST(c_acctbal BETWEEN 0 AND 1000 AS DOUBLE) AS small,
      nullif(c_nationkey, 3)::DOUBLE AS nation FROM customer""")
def formula_math(spark, sf):
    rows = table(spark, sf, "customer")
    for name, expression in {
        "hundreds": "floor(c_acctbal / 100)", "size": "abs(c_acctbal)", "small": "c_acctbal BETWEEN 0 AND 1000",
        "nation": "nullif(c_nationkey, 3)",
    }.items():
        rows = tp.formula(rows, name, expression)
    return rows.select("c_custkey", "hundreds", "size", "small", "nation")


@check("conditional", """
    SELECT o_orderkey, CASE WHEN nullif(o_totalprice, 100000) > 200000 THEN 'HIGH' ELSE 'LOW' END AS size_class FROM orders""")
def conditional(spark, sf):
    orders = table(spark, sf, "orders").withColumn("o_totalprice", F.nullif("o_totalprice", F.lit(100000.0)))
    return tp.conditional(orders, "size_class", "o_totalprice", ">", "200000", "HIGH", "LOW").select("o_orderkey", "size_class")


@check("conditional_like", """
    SELECT o_orderkey, CASE WHEN o_orderpriority LIKE '%URGENT' THEN 'now' ELSE 'later' END AS due,
      CASE WHEN o_orderpriority LIKE '%-H%' THEN 'yes' ELSE 'no' END AS high FROM orders""")
def conditional_like(spark, sf):
    orders = tp.conditional(table(spark, sf, "orders"), "due", "o_orderpriority", "LIKE", "%URGENT", "now", "later")
    orders = tp.conditional(orders, "high", "o_orderpriority", "contains", "-H", "yes", "no")
    return orders.select("o_orderkey", "due", "high")


@check("conditional_equal", """
    SELECT c_custkey, CASE WHEN c_mktsegment = 'BUILDING' THEN 'B' ELSE 'other' END AS kind,
      CASE WHEN c_nationkey != 3 THEN 'abroad' ELSE 'home' END AS place,
      CASE WHEN c_acctbal < 0 THEN 'debt' ELSE '' END AS debt FROM customer""")
def conditional_equal(spark, sf):
    rows = tp.conditional(table(spark, sf, "customer"), "kind", "c_mktsegment", "=", "BUILDING", "B", "other")
    rows = tp.conditional(rows, "place", "c_nationkey", "!=", "3", "abroad", "home")
    rows = tp.conditional(rows, "debt", "c_acctbal", "<", "0", "debt", "")
    return rows.select("c_custkey", "kind", "place", "debt")


@check("case_upper", "SELECT p_partkey, upper(p_name) AS p_name FROM part")
def case_upper(spark, sf):
    return tp.change_case(table(spark, sf, "part"), "p_name", "upper").select("p_partkey", "p_name")


@check("case_lower", "SELECT page_id, lower(html) AS html FROM pages")
def case_lower(spark, sf):
    return tp.change_case(table(spark, sf, "pages"), "html", "lower").select("page_id", "html")


@check("case_proper", """
    SELECT p_partkey, array_to_string(list_transform(string_split(p_name, ' '),
      lambda w: upper(w[1]) || lower(w[2:])), ' ') AS p_name FROM part""")
def case_proper(spark, sf):
    return tp.change_case(table(spark, sf, "part"), "p_name", "proper").select("p_partkey", "p_name")


@check("trim_text", "SELECT p_partkey, trim('  ' || p_name || chr(9) || '  ') AS p_name FROM part")
def trim_text(spark, sf):
    padded = table(spark, sf, "part").withColumn("p_name", F.concat(F.lit("  "), "p_name", F.lit("\t  ")))
    return tp.trim_text(padded, "p_name").select("p_partkey", "p_name")


@check("mask", "SELECT c_custkey, '*****' AS c_name, c_nationkey FROM customer")
def mask(spark, sf):
    return tp.mask(table(spark, sf, "customer"), "c_name").select("c_custkey", "c_name", "c_nationkey")


@check("null_fill", "SELECT c_custkey, coalesce(nullif(c_mktsegment, 'BUILDING'), '') AS c_mktsegment FROM customer")
def null_fill(spark, sf):
    rows = table(spark, sf, "customer").withColumn("c_mktsegment", F.nullif("c_mktsegment", F.lit("BUILDING")))
    return tp.fill_empty(rows, "c_mktsegment").select("c_custkey", "c_mktsegment")


@check("cast_column", """
    SELECT o_orderkey, TRY_CAST(replace(o_orderpriority, '-', '.') AS DOUBLE) AS o_orderpriority,
      TRY_CAST(left(o_orderpriority, 1) AS INTEGER) AS level FROM orders""")
def cast_column(spark, sf):
    orders = table(spark, sf, "orders").select(
        "o_orderkey", F.replace("o_orderpriority", F.lit("-"), F.lit(".")).alias("o_orderpriority"),
        F.substring("o_orderpriority", 1, 1).alias("level"),
    )
    return tp.cast_column(tp.cast_column(orders, "o_orderpriority", "double"), "level", "int")


@check("split_fixed", """
    SELECT page_id, string_split(url, '/')[1] AS scheme, string_split(url, '/')[3] AS host, string_split(url, '/')[7] AS tail
    FROM pages""")
def split_fixed(spark, sf):
    names = ["scheme", "blank", "host", "lang", "number", "more", "tail"]
    return tp.split_column(table(spark, sf, "pages"), "url", "/", names=names).select("page_id", "scheme", "host", "tail")


@check("split_detected", """
    SELECT p_partkey, p_name, string_split(p_name, ' ')[1] AS p_name_part1, string_split(p_name, ' ')[2] AS p_name_part2 FROM part""")
def split_detected(spark, sf):
    return tp.split_column(table(spark, sf, "part").select("p_partkey", "p_name"), "p_name", " ")


@check("regex_extract", r"""
    SELECT page_id, regexp_extract(url, '^(https?)://([^/]+)/', 1) AS url_ext1,
      regexp_extract(url, '^(https?)://([^/]+)/', 2) AS url_ext2 FROM pages""")
def regex_extract(spark, sf):
    return tp.regex_extract(table(spark, sf, "pages"), "url", "^(https?)://([^/]+)/").drop("url", "html")


@check("regex_extract_text", r"""
    SELECT doc_id, regexp_extract(text, '([A-Za-z0-9._]+)@([a-z0-9.]+)', 1) AS who,
      regexp_extract(text, '([A-Za-z0-9._]+)@([a-z0-9.]+)', 2) AS host FROM documents""")
def regex_extract_text(spark, sf):
    found = tp.regex_extract(table(spark, sf, "documents"), "text", r"([A-Za-z0-9._]+)@([a-z0-9.]+)", ["who", "host"])
    return found.select("doc_id", "who", "host")


@check("regex_extract_whole", "SELECT event_id, regexp_extract(props, '[0-9]+') AS props_ext1 FROM events")
def regex_extract_whole(spark, sf):
    return tp.regex_extract(table(spark, sf, "events"), "props", "[0-9]+").select("event_id", "props_ext1")


DATES = """SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 'unknown'
    ELSE strftime(o_orderdate, '%d/%m/%Y') END AS d FROM orders"""


def dates(spark, sf):
    shown = F.when(F.col("o_orderstatus") == "P", "unknown").otherwise(F.date_format("o_orderdate", "dd/MM/yyyy"))
    return table(spark, sf, "orders").select("o_orderkey", shown.alias("d"))


@check("date_scores", f"""
    SELECT 0 AS rank, 'dd/MM/yyyy' AS format, count(try_strptime(d, '%d/%m/%Y')) AS matches FROM ({DATES}) UNION ALL
    SELECT 1, 'MM/dd/yyyy', count(try_strptime(d, '%m/%d/%Y')) FROM ({DATES}) UNION ALL
    SELECT 2, 'yyyy-MM-dd', count(try_strptime(d, '%Y-%m-%d')) FROM ({DATES}) UNION ALL
    SELECT 3, 'yyyyMMdd', count(try_strptime(d, '%Y%m%d')) FROM ({DATES})""")
def date_scores(spark, sf):
    return tp.date_format_scores(dates(spark, sf), "d")


@check("date_standardize", """
    SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 'unknown' ELSE strftime(o_orderdate, '%Y-%m-%d') END AS d,
      o_orderstatus <> 'P' AS d_parsed FROM orders""")
def date_standardize(spark, sf):
    return tp.standardize_date(dates(spark, sf), "d", flag=True)


@check("date_standardize_compact", """
    SELECT l_orderkey, l_linenumber, strftime(l_shipdate, '%Y-%m-%d') AS d FROM lineitem""")
def date_standardize_compact(spark, sf):
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.date_format("l_shipdate", "yyyyMMdd").alias("d"))
    return tp.standardize_date(lines, "d")


FULL_NAMES = "SELECT c_custkey, CASE WHEN c_nationkey = 0 THEN 'Solo' ELSE 'Jean ' || replace(c_name, '#', '  ') || ' ' || c_mktsegment END AS who FROM customer"


def full_names(spark, sf):
    who = F.expr("CASE WHEN c_nationkey = 0 THEN 'Solo' ELSE concat('Jean ', replace(c_name, '#', '  '), ' ', c_mktsegment) END")
    return table(spark, sf, "customer").select("c_custkey", who.alias("who"))


@check("name_split", f"""
    SELECT c_custkey, who, string_split(who, ' ')[1] AS who_prenom,
      array_to_string(string_split(who, ' ')[2:], ' ') AS who_nom FROM ({FULL_NAMES})""")
def name_split(spark, sf):
    return tp.split_name(full_names(spark, sf), "who")


@check("name_split_last_first", f"""
    SELECT c_custkey, string_split(who, ' ')[1] AS who_nom,
      array_to_string(string_split(who, ' ')[2:], ' ') AS who_prenom FROM ({FULL_NAMES})""")
def name_split_last_first(spark, sf):
    return tp.split_name(full_names(spark, sf), "who", "last_first").drop("who")


EMAILS = """SELECT c_custkey, CASE WHEN c_nationkey = 5 THEN NULL WHEN c_acctbal < 0 THEN 'no mail' WHEN c_nationkey = 7
    THEN 'a+b@x.com' ELSE lower(c_mktsegment) || '.' || c_custkey || '@mail-' || c_nationkey || '.example.com' END AS mail FROM customer"""


@check("email_check", rf"""
    SELECT c_custkey, mail, regexp_matches(mail, '{EMAIL}') AS mail_valide,
      regexp_extract(mail, '{EMAIL_DOMAIN}', 1) AS mail_domaine FROM ({EMAILS})""")
def email_check(spark, sf):
    mail = F.expr("""CASE WHEN c_nationkey = 5 THEN NULL WHEN c_acctbal < 0 THEN 'no mail' WHEN c_nationkey = 7 THEN 'a+b@x.com'
        ELSE concat(lower(c_mktsegment), '.', c_custkey, '@mail-', c_nationkey, '.example.com') END""")
    return tp.check_email(table(spark, sf, "customer").select("c_custkey", mail.alias("mail")), "mail")


@check("email_check_text", r"""
    SELECT doc_id, regexp_matches(text, '^[\w\.-]+@[\w\.-]+\.[\w\.-]+$') AS text_valide,
      regexp_extract(text, '@([\w\.-]+)$', 1) AS text_domaine FROM documents""")
def email_check_text(spark, sf):
    return tp.check_email(table(spark, sf, "documents").select("doc_id", "text"), "text").drop("text")


EURO = """SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 'n.c.' ELSE
    replace(CAST(CAST(o_totalprice AS DECIMAL(15, 2)) AS VARCHAR), '.', ',') || ' €' END AS price FROM orders"""


@check("currency_comma", rf"""
    SELECT o_orderkey, price, TRY_CAST(replace(replace(regexp_replace(price, '[^0-9.,\-]', '', 'g'), '.', ''), ',', '.') AS DOUBLE)
      AS price_num FROM ({EURO})""")
def currency_comma(spark, sf):
    price = F.expr("""CASE WHEN o_orderstatus = 'P' THEN 'n.c.' ELSE
        concat(replace(cast(cast(o_totalprice AS decimal(15, 2)) AS string), '.', ','), ' €') END""")
    return tp.parse_currency(table(spark, sf, "orders").select("o_orderkey", price.alias("price")), "price", ",")


@check("currency_point", """
    SELECT c_custkey, CAST(CAST(c_acctbal AS DECIMAL(15, 2)) AS DOUBLE) AS amount_num FROM customer""")
def currency_point(spark, sf):
    amount = F.expr("concat('$ ', cast(cast(c_acctbal AS decimal(15, 2)) AS string), ' USD')")
    return tp.parse_currency(table(spark, sf, "customer").select("c_custkey", amount.alias("amount")), "amount").drop("amount")


@check("unit_mass", "SELECT l_orderkey, l_linenumber, l_quantity * 2.20462::DOUBLE AS l_quantity_conv FROM lineitem")
def unit_mass(spark, sf):
    lines = tp.convert_unit(table(spark, sf, "lineitem"), "l_quantity", "kg -> lb")
    return lines.select("l_orderkey", "l_linenumber", "l_quantity_conv")


@check("unit_volume", "SELECT event_id, value * 3.78541::DOUBLE AS value_conv FROM events")
def unit_volume(spark, sf):
    return tp.convert_unit(table(spark, sf, "events"), "value", "gal (US) -> L").select("event_id", "value_conv")


@check("phone_fr", """
    SELECT c_custkey, CASE WHEN c_mktsegment = 'BUILDING' THEN 'n/a' WHEN c_mktsegment = 'MACHINERY' THEN '06 12'
      WHEN c_nationkey < 3 THEN '+1202555' || right('000' || c_custkey, 4)
      ELSE '+336' || lpad(CAST(c_custkey AS VARCHAR), 8, '0') END AS phone,
      c_mktsegment NOT IN ('BUILDING', 'MACHINERY') AS phone_is_valid FROM customer""")
def phone_fr(spark, sf):
    phone = F.expr("""CASE WHEN c_mktsegment = 'BUILDING' THEN 'n/a' WHEN c_mktsegment = 'MACHINERY' THEN '06 12'
        WHEN c_nationkey < 3 THEN concat('+1 (202) 555-', right(concat('000', c_custkey), 4))
        WHEN c_nationkey < 9 THEN concat('0033 6.', lpad(cast(c_custkey AS string), 8, '0'))
        ELSE concat('06 ', lpad(cast(c_custkey AS string), 8, '0')) END""")
    return tp.standardize_phone(table(spark, sf, "customer").select("c_custkey", phone.alias("phone")), "phone", "FR", flag=True)


def _phone_texts(country):
    """An expression for national numbers of the country's lengths, in all ranges, and one for how they are written."""
    code, prefix, trunk, _ = phones.COUNTRIES[country]
    size = {"GB": "9 + c_custkey % 2", "DE": "10 + c_custkey % 2", "US": "10"}.get(country, "9")
    number = f"substring(CAST(100000000000 + (c_custkey * 7919 * 10007) % 900000000000 AS VARCHAR(20)), 1, CAST({size} AS INT))"
    text = f"""CASE c_custkey % 3 WHEN 0 THEN concat('{trunk}', {number}) WHEN 1 THEN concat('+{code} ', {number})
        ELSE concat('{prefix}', '{code}', {number}) END"""
    return number, text


def _phone_query(country):
    number, text = _phone_texts(country)
    plan = ", ".join(f"('{p}', '{kind}', {least}, {most})" for p, kind, least, most in phones.plan_rows(country))
    shape = "AND substring(number, 4, 1) BETWEEN '2' AND '9'" if country == "US" else ""

    @check(f"phone_plan_{country.lower()}", f"""
        WITH plan(prefix, kind, least, most) AS (VALUES {plan}),
        numbers AS (SELECT c_custkey, {number} AS number, {text} AS phone FROM customer),
        longest AS (SELECT c_custkey, max_by(kind, length(prefix)) AS kind, max_by(least, length(prefix)) AS least,
          max_by(most, length(prefix)) AS most FROM numbers JOIN plan ON starts_with(number, prefix) GROUP BY c_custkey),
        valid AS (SELECT c_custkey, kind AS phone_kind FROM longest JOIN numbers USING (c_custkey)
          WHERE kind <> '' AND length(number) BETWEEN least AND most {shape})
        SELECT c_custkey, CASE WHEN phone_kind IS NULL THEN phone ELSE '+{phones.COUNTRIES[country][0]}' || number END AS phone,
          phone_kind IS NOT NULL AS phone_is_valid, phone_kind FROM numbers LEFT JOIN valid USING (c_custkey)""")
    def phone_plan(spark, sf):
        texts = table(spark, sf, "customer").select("c_custkey", F.expr(text).alias("phone"))
        return tp.standardize_phone(texts, "phone", country, flag=True, kind=True)


for _country in phones.COUNTRIES:
    _phone_query(_country)


@check("text_repair", "SELECT doc_id, md5(text) AS digest, length(text) AS n FROM documents")
def text_repair(spark, sf):
    damaged = F.col("text")
    for good, bad in (("é", "Ã©"), ("è", "Ã¨"), ("ç", "Ã§"), ("ê", "Ãª"), ("à", "Ã ")):
        damaged = F.replace(damaged, F.lit(good), F.lit(bad))
    repaired = tp.repair_text(table(spark, sf, "documents").select("doc_id", damaged.alias("text")), "text")
    return repaired.select("doc_id", F.md5("text").alias("digest"), F.length("text").cast("bigint").alias("n"))
