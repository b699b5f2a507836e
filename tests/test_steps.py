"""Recipes, SQL, enrichment, streams, the shared folder."""

import pandas as pd
import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

import tableprep as tp
from tableprep.plans.recipe import ROW_WISE, find
from tableprep.scratch import new_path, shared_folder, written
from tableprep.streaming.arrivals import clean_arrivals, clean_stream


@pytest.fixture(scope="module")
def sales(spark):
    return spark.createDataFrame([(1, " ana ", 10.0), (2, "BOB", None), (3, None, 3.0)], "id long, who string, amount double")


def test_recipe_round_trip(spark, sales, rows):
    recipe = (
        tp.Recipe(source="sales.csv").add("trim_text", step_kind="CLEAN", description="tidy", col="who")
        .add("change_case", col="who", kind="upper").add("lookup", ref={"table": "ages"}, left_key="id", right_key="id")
    )
    again = tp.Recipe.from_json(recipe.to_json())
    assert again.steps == recipe.steps and again.source == "sales.csv" and again.steps[0].at
    ages = spark.createDataFrame([(1, 30)], "id long, age int")
    assert rows(again.apply(sales, {"ages": ages}), "who", "age") == sorted([("ANA", 30), ("BOB", None), (None, None)], key=repr)
    assert recipe.steps[0].kind == "CLEAN" and recipe.steps[1].description == "change_case"
    for bad in ("_pieces", "nothing", "F"):
        with pytest.raises(ValueError):
            tp.Recipe().add(bad)
    with pytest.raises(ValueError):
        tp.Recipe().add("mask", step_kind="OTHER", col="who")


def test_row_wise_steps_exist():
    assert all(callable(find(name)) for name in ROW_WISE)


def test_sql_reads_only(spark, sales, rows):
    assert rows(tp.sql(sales, "SELECT count(*) AS n FROM current_dataset WHERE who <> 'drop -- update'")) == [(2,)]
    assert rows(tp.sql(sales, "WITH x AS (SELECT max(amount) m FROM t) SELECT m FROM x", name="t")) == [(10.0,)]
    for text in ("DELETE FROM current_dataset", "DROP TABLE x", "WITH x AS (SELECT 1) INSERT INTO y SELECT * FROM x", "  "):
        with pytest.raises(ValueError):
            tp.sql(sales, text)


def test_enrich(spark, sales, rows):
    def grade(frame: pd.DataFrame) -> pd.DataFrame:
        assert "amount" not in frame.columns and len(frame) <= 2
        return frame[["row_id"]].assign(who=frame["who"].str.strip(), grade="g" + frame["id"].astype(str))

    done = tp.enrich(sales.coalesce(1), grade, "row_id long, who string, grade string", hidden=["amount"], batch_size=2)
    assert done.columns == ["id", "who", "amount", "grade"]
    assert rows(done) == sorted([(1, "ana", 10.0, "g1"), (2, "BOB", None, "g2"), (3, None, 3.0, "g3")], key=repr)


def test_enrich_keeps_rows_left_out(spark, sales, rows):
    first = lambda frame: frame[frame["id"] == 1][["id"]].assign(who="found")
    done = tp.enrich(sales, first, "id long, who string", key="id")
    assert rows(done, "id", "who") == sorted([(1, "found"), (2, "BOB"), (3, None)], key=repr)


def test_enrich_goes_on_after_a_failure(spark, tmp_path, rows):
    calls, away, ledger = tmp_path / "calls", tmp_path / "away", str(tmp_path / "ledger")
    calls.mkdir()
    away.touch()
    table = spark.range(0, 100, 1, 4).selectExpr("id", "cast(null as string) as v", "id * 2 as secret")

    def ask(frame: pd.DataFrame) -> pd.DataFrame:
        assert len(frame) <= 5 and "secret" not in frame.columns
        if away.exists() and (frame["id"] == 99).any():
            raise RuntimeError("away")
        with open(calls / f"{frame['id'].iloc[0]}", "a") as log:
            log.write("x")
        return frame[["row_id"]].assign(v="v" + frame["id"].astype(str))

    options = {"hidden": ["secret"], "batch_size": 5, "ledger": ledger, "batches_at_once": 3}
    with pytest.raises(StreamingQueryException):
        tp.enrich(table, ask, "row_id long, v string", **options)
    before = {p.name: p.read_text() for p in calls.iterdir()}
    assert 0 < len(before) < 20
    away.unlink()
    done = tp.enrich(table, ask, "row_id long, v string", **options)
    assert rows(done) == sorted([(k, f"v{k}", 2 * k) for k in range(100)], key=repr)
    after = {p.name: len(p.read_text()) for p in calls.iterdir()}
    # Only batches of the group that failed are asked for again.
    assert len(after) == 20 and sum(after.values()) <= 20 + 2
    again = tp.enrich(table, ask, "row_id long, v string", **options)
    assert again.count() == 100 and {p.name: len(p.read_text()) for p in calls.iterdir()} == after
    with pytest.raises(ValueError, match="another table"):
        tp.enrich(table.drop("v"), ask, "row_id long, v string", **options)
    empty = tp.enrich(table.limit(0), ask, "row_id long, v string", **{**options, "ledger": str(tmp_path / "empty")})
    assert empty.collect() == []


def test_stream(spark, sales, rows, tmp_path):
    source, out, progress = (str(tmp_path / n) for n in ("in", "out", "progress"))
    recipe = tp.Recipe().add("apply_rules", rules=[{"column": "amount", "operator": "greater_than", "value": "1"}]).add(
        "fill_empty", col="who")
    for _ in range(2):
        sales.write.mode("append").parquet(source)
        clean_arrivals(spark, source, sales.schema, recipe, out, progress).awaitTermination()
    assert rows(spark.read.parquet(out)) == rows(recipe.apply(sales.unionAll(sales)))
    stream = spark.readStream.schema(sales.schema).parquet(source)
    with pytest.raises(ValueError):
        clean_stream(stream, tp.Recipe().add("merge_duplicates"))


class _Context:
    """What shared_folder asks a session for, on a cluster."""

    def __init__(self, conf, folder=None, master="spark://host:7077"):
        self.sparkContext, self.master, self._conf, self._folder = self, master, conf, folder

    def getConf(self):
        return self._conf

    def getCheckpointDir(self):
        return self._folder


def test_a_cluster_must_name_its_folder():
    assert shared_folder(_Context({"spark.checkpoint.dir": "hdfs://nn/shared/"})) == "hdfs://nn/shared"
    assert shared_folder(_Context({}, "hdfs://nn/set-by-user")) == "hdfs://nn/set-by-user"
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared_folder(_Context({}))


def test_shared_folder(spark):
    assert shared_folder(spark) == spark.sparkContext.getConf().get("spark.checkpoint.dir")
    assert new_path(spark, "x") != new_path(spark, "x")
    kept = written(spark.range(3).withColumn("r", F.rand()))
    assert kept.collect() == kept.collect() and kept.inputFiles()[0].split(":")[-1].lstrip("/").startswith(shared_folder(spark).lstrip("/"))
