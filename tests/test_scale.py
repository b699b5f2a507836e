"""Plans: what must hold when the data is large."""

import pytest
from pyspark.sql import functions as F

import tableprep as tp

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def lineitem(spark):
    return spark.read.parquet(f"{SF}/lineitem.parquet")


def test_rules_reach_the_scan(lineitem, plan_of):
    rules = [
        {"column": "l_quantity", "operator": "greater_than", "value": "10"}, {"column": "l_returnflag", "operator": "equals", "value": "A"},
        {"column": "l_shipdate", "operator": "less_than", "value": "1999-01-01"},
    ]
    plan = plan_of(tp.apply_rules(lineitem, rules).select("l_orderkey"))
    pushed = plan[plan.index("PushedFilters"):]
    for part in ("GreaterThan(l_quantity,10.0)", "EqualTo(l_returnflag,A)", "LessThan(l_shipdate"):
        assert part in pushed
    assert "ReadSchema: struct<l_orderkey:bigint,l_quantity:double,l_returnflag:string,l_shipdate:timestamp_ntz>" in plan


@pytest.mark.parametrize("make, columns", [
    (lambda df: tp.histogram(df, "l_tax"), "l_tax:double"), (lambda df: tp.zscore_top(df, "l_tax"), "l_tax:double"),
    (lambda df: tp.top_values(df, "l_returnflag"), "l_returnflag:string"),
    (lambda df: tp.grouped(df, "l_returnflag", "l_tax", "SUM"), "l_tax:double,l_returnflag:string"),
    (lambda df: tp.daily_counts(df, "l_shipdate"), "l_shipdate:timestamp_ntz"),
    (lambda df: tp.dedup_preview(df, ["l_returnflag"]), "l_returnflag:string"),
])
def test_only_needed_columns_are_read(lineitem, plan_of, make, columns):
    plan = plan_of(make(lineitem))
    assert f"ReadSchema: struct<{columns}>" in plan
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


@pytest.mark.parametrize("make", [
    lambda df: tp.split_column(df, "l_returnflag", "x", n=2), lambda df: tp.check_email(df, "l_returnflag"),
    lambda df: tp.standardize_phone(df, "l_returnflag"), lambda df: tp.parse_currency(df, "l_returnflag"),
    lambda df: tp.repair_text(df, "l_returnflag"), lambda df: tp.standardize_date(df, "l_returnflag", "yyyyMMdd"),
    lambda df: tp.unpivot(df, ["l_tax", "l_discount"]), lambda df: tp.to_fixed_width(df.select("l_tax")),
])
def test_row_operators_do_not_shuffle(lineitem, plan_of, make):
    plan = plan_of(make(lineitem))
    assert "Exchange" not in plan and "Python" not in plan and "*(1)" in plan


@pytest.mark.parametrize("bucket_limit", [1000, 1])
def test_near_pairs_join_on_keys(spark, plan_of, bucket_limit):
    parts = spark.read.parquet(f"{SF}/part.parquet")
    plan = plan_of(tp.near_pairs(parts, "p_name", 2, bucket_limit))
    assert "key#" in plan and "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_one_shuffle_compares_two_versions(lineitem, plan_of):
    a = lineitem.select("l_orderkey", "l_tax")
    assert plan_of(tp.row_diff(a.where("l_tax < 0.05"), a)).count("Exchange") == 1


def test_copies_combine_before_the_shuffle(lineitem, plan_of):
    for df in (tp.dedup(lineitem, ["l_suppkey"], order_by="l_orderkey"), tp.duplicate_summary(lineitem), tp.distinct_counts(lineitem)):
        plan = plan_of(df)
        below = plan[plan.rindex("Exchange hashpartitioning"):]
        assert "Aggregate" in below and "Window" not in plan


def test_hot_key_is_split(spark):
    """A third of the rows share one key; the join must split that partition."""
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "200KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "100KB",
    }
    old = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        key = F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id"))
        facts = spark.range(0, 300000, 1, 8).select(key.alias("k"), F.sha2(F.col("id").cast("string"), 256).alias("v"))
        ref = spark.range(300000).select(F.col("id").alias("rid"), (F.col("id") * 2).alias("w"))
        for joined in (tp.lookup(facts, ref, "k", "rid"), tp.update_by_key(facts, ref.withColumnRenamed("rid", "k"), "k")):
            assert joined.where("w = 2 * k").count() == 300000
            joined.write.format("noop").mode("overwrite").save()
            query = joined.select("k", "v", "w")
            query.collect()
            assert "skew=true" in query._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_lookup_broadcasts_by_size_only(spark, lineitem, plan_of):
    small = spark.read.parquet(f"{SF}/supplier.parquet")
    assert "BroadcastHashJoin" in plan_of(tp.lookup(lineitem, small, "l_suppkey", "s_suppkey"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "1KB")
    try:
        assert "SortMergeJoin" in plan_of(tp.lookup(lineitem, small, "l_suppkey", "s_suppkey"))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
