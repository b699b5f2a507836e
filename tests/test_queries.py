"""Registered queries on small tables made to hold what the test tables lack."""

import tableprep as tp
from checks import QUERIES
from tableprep.operators import enrich


def test_pivot_sparse_counts_values_above_zero(spark, tmp_path, rows):
    events = [(1, "click", 0.0), (1, "click", 2.0), (1, "error", -1.0), (2, "error", None), (2, "view", 1.0)]
    spark.createDataFrame(events, "user_id long, event_type string, value double").write.parquet(str(tmp_path / "events.parquet"))
    found = QUERIES["pivot_sparse"](spark, str(tmp_path))
    assert rows(found, "user_id", "click", "error") == [(1, 1, 0), (2, 0, 0)]


def test_few_columns_are_pivoted_in_one_exchange(spark, plan_of, rows):
    df = spark.createDataFrame([(1, "a", 2.0), (1, "b", None), (2, "c", 1.0), (None, "a", 5.0), (1, "a", 3.0)], "id long, k string, v double")
    wide = tp.pivot(df, "id", "k", "v", "SUM", values=["a", "b"])
    assert wide.columns == ["id", "a", "b"] and rows(wide) == [(1, 5.0, None), (2, None, None), (None, 5.0, None)]
    assert plan_of(wide).split("Initial Plan")[-1].count("Exchange") == 1


def test_a_ledger_of_many_batches_has_few_steps(spark, tmp_path, monkeypatch, rows):
    """Each step lists what was recorded before it, so steps must not grow with the table."""
    monkeypatch.setattr(enrich, "STEPS", 5)
    ledger = tmp_path / "ledger"

    def ask(frame):
        assert len(frame) <= 10
        return frame[["id"]].assign(v=frame["id"] * 2)

    found = tp.enrich(spark.range(0, 1000, 1, 1), ask, "id long, v long", key="id", batch_size=10, ledger=str(ledger), batches_at_once=2)
    assert rows(found) == sorted([(k, 2 * k) for k in range(1000)], key=repr)
    assert len([p for p in (ledger / "progress" / "commits").iterdir() if p.name.isdigit()]) == 5
