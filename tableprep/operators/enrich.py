"""Enrichment of a table by a user's function, in batches, without the hidden columns."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame

from tableprep.operators.columns import add_row_id, hide_columns
from tableprep.operators.joins import update_by_key
from tableprep.scratch import exists, written

# Steps in which a ledger records a large table.
STEPS = 100


def enrich(
    df: DataFrame,
    fn: Callable[[pd.DataFrame], pd.DataFrame],
    schema: str,
    hidden: Sequence[str] = (),
    key: str | None = None,
    batch_size: int = 500,
    ledger: str | None = None,
    batches_at_once: int | None = None,
) -> DataFrame:
    """Run ``fn`` on batches of at most ``batch_size`` rows and merge what it returns by key.

    ``fn`` sees all columns but the hidden ones. It returns the key and the columns it changes or
    adds, as in ``schema``; rows it leaves out keep their values. Without ``key`` a row id
    named ``row_id`` is used and removed at the end; a table with a column of that name must give a key. The batches
    run on the executors.

    ``ledger`` is a folder in shared storage, one for each table, that outlives the job: the rows are written there in files of a batch each, and a
    stream takes ``batches_at_once`` of them at a time (by default as many as there are cores) and records what ``fn`` returned. When the job is lost or
    ``fn`` raises, the same call goes on after the last recorded batches; none of those is asked for again. A table of very many batches has
    several in a file, one asked for after the other, so that it is recorded in about ``STEPS`` steps: a failure costs one of these.
    """
    own_key = key is None
    if own_key:
        key = "row_id"
        if key in (c.lower() for c in df.columns):
            raise ValueError("the table has a column row_id: give the name of its key")
        # The id is needed on both sides of the merge, so it is fixed in a written table first.
        df = written(add_row_id(df, key), "enrich")

    def in_batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for start in range(0, len(frame), batch_size):
                yield fn(frame.iloc[start : start + batch_size].reset_index(drop=True))

    if ledger:
        df, returned = _recorded(df, hidden, in_batches, schema, ledger.rstrip("/"), batch_size, batches_at_once)
    else:
        # Written once: the merge reads it twice, and a paid service must not be called twice.
        returned = written(hide_columns(df, hidden).mapInPandas(in_batches, schema), "returned")
    merged = update_by_key(df, returned, key)
    return merged.drop(key) if own_key else merged


def _recorded(
    df: DataFrame, hidden: Sequence[str], in_batches: Callable, schema: str, ledger: str, batch_size: int, at_once: int | None
) -> tuple[DataFrame, DataFrame]:
    """The table as it was when the ledger was begun, and what its batches returned."""
    spark = df.sparkSession
    rows, returned = f"{ledger}/rows", f"{ledger}/returned"
    at_once = at_once or spark.sparkContext.defaultParallelism
    if not exists(spark, f"{rows}/_SUCCESS"):
        # The cost of a step grows with the steps before it, so their number is bounded.
        batches = -(-df.count() // batch_size)
        in_file = batch_size * max(1, -(-batches // (at_once * STEPS)))
        df.write.mode("overwrite").option("maxRecordsPerFile", in_file).parquet(rows)
    begun = spark.read.parquet(rows)
    if [(f.name, f.dataType) for f in begun.schema] != [(f.name, f.dataType) for f in df.schema]:
        raise ValueError(f"the ledger {ledger} belongs to another table")
    stream = spark.readStream.schema(begun.schema).option("maxFilesPerTrigger", at_once).parquet(rows)
    asked = hide_columns(stream, hidden).mapInPandas(in_batches, schema).writeStream.format("parquet").outputMode("append")
    asked.option("path", returned).option("checkpointLocation", f"{ledger}/progress").trigger(availableNow=True).start().awaitTermination()
    return begun, spark.read.schema(schema).parquet(returned)
