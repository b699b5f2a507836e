"""The data behind charts and maps."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tableprep.operators.filters import with_coordinates
from tableprep.operators.profile import top_values

# Column names that hold coordinates and labels.
LAT_NAMES = r"(?i)(lat|latitude)"
LON_NAMES = r"(?i)(lon|long|longitude|lng)"
LABEL_NAMES = r"(?i)(name|label|city|site|id)"


def histogram(df: DataFrame, col: str, bins: int = 20, clamp_max: bool = False) -> DataFrame:
    """Equal bins: ``bin`` (from 0), ``lower`` bound and ``count``; empty bins are left out.

    Values that are no numbers are left out. The largest value falls into a bin of its own, number ``bins``; ``clamp_max`` puts it in the last.
    """
    value = F.col(col).try_cast("double")
    bounds = df.agg(F.struct(F.min(value).alias("low"), F.max(value).alias("high"))).scalar()
    low, high = bounds.getField("low"), bounds.getField("high")
    width = F.coalesce(F.nullif((high - low) / F.lit(bins), F.lit(0.0)), F.lit(1.0))
    number = F.floor((value - low) / width)
    if clamp_max:
        number = F.least(number, F.lit(bins - 1))
    counts = df.where(value.isNotNull()).groupBy(number.cast("bigint").alias("bin")).agg(F.count("*").alias("count"))
    return counts.select("bin", (F.col("bin") * width + low).alias("lower"), "count").orderBy("bin")


def zscore_top(df: DataFrame, col: str, k: int = 200) -> DataFrame:
    """The ``k`` values furthest from the mean, in standard deviations; above 2 is an outlier.

    Values that are no numbers are left out.
    """
    value = F.col(col).try_cast("double")
    moments = df.agg(F.struct(F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"))).scalar()
    mean, deviation = moments.getField("mean"), moments.getField("sd")
    scored = df.where(value.isNotNull()).select(
        F.col(col).alias("value"), ((value - mean) / F.nullif(deviation, F.lit(0.0))).alias("z_score")
    )
    top = scored.orderBy(F.desc_nulls_last(F.abs("z_score")), "value").limit(k)
    return top.withColumn("is_outlier", F.abs("z_score") > 2)


def dual_measure(df: DataFrame, key: str, value: str, k: int = 50) -> DataFrame:
    """Row count and sum of a second column by key, for the ``k`` most frequent keys."""
    sums = df.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("name")).agg(
        F.count("*").alias("count"), F.sum(F.col(value).try_cast("double")).alias("sum")
    )
    return sums.orderBy(F.desc("count"), "name").limit(k)


def frequencies(df: DataFrame, col: str, k: int = 50) -> DataFrame:
    """The ``k`` most frequent non-empty values, as text."""
    counts = df.where(F.col(col).cast("string") != "").groupBy(F.col(col).cast("string").alias("text")).agg(
        F.count("*").alias("count")
    )
    return counts.orderBy(F.desc("count"), "text").limit(k)


def labels(df: DataFrame, col: str, k: int = 5, empty: str = "(Vide)") -> DataFrame:
    """Bar or pie data: the ``k`` most frequent values, with a label for the empty one."""
    top = top_values(df, col, k)
    text = F.col("value").cast("string")
    return top.select(F.when(text == "", F.lit(empty)).otherwise(text).alias("name"), "count")


def timeline(df: DataFrame, col: str, k: int | None = None) -> DataFrame:
    """All times, or the first ``k``, with their hour of day (8:30 is 8.5)."""
    times = df.select(F.col(col).try_cast("timestamp").alias("ts")).where("ts is not null")
    in_order = times.orderBy("ts")
    return (in_order if k is None else in_order.limit(k)).withColumn("hour_of_day", F.hour("ts") + F.minute("ts") / 60.0)


def daily_counts(df: DataFrame, col: str, k: int | None = None) -> DataFrame:
    """Rows per day, for all days or the first ``k``."""
    days = df.select(F.col(col).try_cast("date").alias("date")).where("date is not null")
    counts = days.groupBy("date").agg(F.count("*").alias("count")).orderBy("date")
    return counts if k is None else counts.limit(k)


def find_coordinates(df: DataFrame) -> tuple[str | None, str | None, str | None]:
    """Names of the latitude, longitude and label columns, by their usual names."""
    first = lambda pattern: next((c for c in df.columns if re.fullmatch(pattern, c)), None)
    return first(LAT_NAMES), first(LON_NAMES), first(LABEL_NAMES)


def map_points(df: DataFrame, limit: int | None = None) -> DataFrame:
    """All points ``lat``, ``lng`` and, where there is one, ``label``.

    With ``limit`` a choice of so many by hash, which is spread over the map and the same in each run.
    """
    lat, lon, label = find_coordinates(df)
    if lat is None or lon is None:
        raise ValueError("no latitude and longitude columns")
    rows = with_coordinates(df, lat, lon)
    points = rows.select(
        rows[lat].alias("lat"), rows[lon].alias("lng"), *([rows[label].cast("string").alias("label")] if label else [])
    )
    return points if limit is None else points.orderBy(F.xxhash64(*points.columns), *points.columns).limit(limit)
