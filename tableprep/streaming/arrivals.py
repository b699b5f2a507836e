"""Clean files as they arrive in a folder, with the same recipe as for a whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from tableprep.plans.recipe import Recipe


def clean_stream(stream: DataFrame, recipe: Recipe) -> DataFrame:
    """The recipe on a streaming table; steps that need all rows at once are refused."""
    if not recipe.row_wise():
        raise ValueError("only row-wise steps can run on a stream")
    return recipe.apply(stream)


def clean_arrivals(
    spark: SparkSession, folder: str, schema: T.StructType, recipe: Recipe, out: str, progress: str
) -> StreamingQuery:
    """Clean the Parquet files in ``folder`` that no earlier run has taken, then stop.

    ``progress`` is a shared folder that remembers them, so a lost run continues where it was.
    """
    stream = spark.readStream.schema(schema).parquet(folder)
    writer = clean_stream(stream, recipe).writeStream.format("parquet").outputMode("append")
    return writer.option("path", out).option("checkpointLocation", progress).trigger(availableNow=True).start()
