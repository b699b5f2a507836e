"""Calendars, and local times of many places as times of one zone."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tableprep.functions.dates import calendar_parts, local_time_in
from tableprep.operators.fuzzy import near_match
from tableprep.operators.joins import map_values, mapping_frame
from tableprep.operators.similar import best_matches
from tableprep.scratch import written


def date_bounds(df: DataFrame, col: str) -> DataFrame:
    """First and last date of a column and the days they span, both included."""
    day = df[col].try_cast("date")
    bounds = df.agg(F.min(day).alias("first"), F.max(day).alias("last"))
    return bounds.withColumn("days", F.date_diff("last", "first") + 1)


def calendar(df: DataFrame, col: str) -> DataFrame:
    """One row per day from the first to the last date of a column."""
    day = F.explode(F.sequence(F.col("first"), F.col("last"), F.expr("interval 1 day"))).alias("day")
    days = date_bounds(df, col).where(F.col("first").isNotNull()).select(day)
    return days.select(*[part.alias(name) for name, part in calendar_parts(F.col("day")).items()])


def resolve_zones(
    df: DataFrame,
    place: str,
    gazetteer: DataFrame,
    overrides: Mapping[str, str] | None = None,
    max_dist: int = 1,
    least_score: float | None = None,
) -> DataFrame:
    """The time zone of each distinct place: columns ``place``, ``zone``, ``how``.

    ``gazetteer`` has columns ``city`` and ``zone``. ``how`` is ``manual`` (from ``overrides``),
    ``exact`` (same name, case ignored), ``near`` (at most ``max_dist`` edits; nearest, then first by
    name) or ``unresolved`` with a NULL zone. With ``least_score`` what is left takes the zone of the most ``similar`` city
    (:func:`best_matches`: other word order, missing words, several edits), and a column ``score`` tells how similar.
    """
    norm = lambda c: F.trim(F.lower(c))
    # One pass over the table; all that follows works on its distinct places.
    places = written(df.select(F.col(place).alias("place")).where(F.col("place") != "").distinct(), "places")
    cities = (
        gazetteer.where("city is not null").groupBy(norm(F.col("city")).alias("city")).agg(F.min("zone").alias("zone"))
    )
    found = places.join(cities, norm(places["place"]) == cities["city"], "left").select("place", "zone")
    unmatched = found.where("zone is null").select(norm(F.col("place")).alias("v1")).distinct()
    near = near_match(unmatched, "v1", cities, "city", max_dist)
    nearest = near.groupBy("v1").agg(F.min_by("v2", F.struct("distance", "v2")).alias("city"))
    close = nearest.join(cities, "city").select("v1", F.col("zone").alias("near_zone"))
    manual = mapping_frame(df, overrides or {}).select(F.col("old"), F.col("new").alias("manual_zone"))
    full = found.join(close, norm(found["place"]) == close["v1"], "left").join(
        manual, F.col("place") == manual["old"], "left"
    )
    how = (
        F.when(F.col("manual_zone").isNotNull(), "manual").when(F.col("zone").isNotNull(), "exact")
        .when(F.col("near_zone").isNotNull(), "near").otherwise("unresolved")
    )
    zones = full.select("place", F.coalesce("manual_zone", "zone", "near_zone").alias("zone"), how.alias("how"))
    zones = written(zones, "zones")
    if least_score is None:
        return zones
    asked = zones.where("how = 'unresolved'").select(norm(F.col("place")).alias("value"))
    best = best_matches(asked, "value", cities, "city", least_score)
    best = best.join(cities.select(F.col("city").alias("match"), F.col("zone").alias("similar_zone")), "match").select("value", "similar_zone", "score")
    joined = zones.join(best, (norm(F.col("place")) == F.col("value")) & (F.col("how") == "unresolved"), "left")
    return written(joined.select(
        "place", F.coalesce("zone", "similar_zone").alias("zone"), F.when(F.col("score").isNotNull(), "similar").otherwise(F.col("how")).alias("how"), "score"
    ), "zones")


def to_zone(
    df: DataFrame,
    time: str,
    place: str,
    zones: DataFrame,
    target: str = "Europe/Paris",
    overwrite: bool = False,
    new_name: str | None = None,
) -> DataFrame:
    """Local times of each row's place as ``yyyy-MM-dd HH:mm:ss`` in the target zone.

    ``zones`` is the result of :func:`resolve_zones`, each place once. A row with an unknown place or an unreadable
    time gets NULL in the new column, or keeps its text with ``overwrite``.
    """
    known = zones.where("zone is not null").select(F.col("place").alias("old"), F.col("zone").alias("new"))
    with_zone = map_values(df, place, known, to="__zone", known_unique=True)
    moved = local_time_in(F.col(time), F.col("__zone"), target)
    if overwrite:
        result = with_zone.withColumn(time, F.coalesce(moved, F.col(time).cast("string")))
    else:
        result = with_zone.withColumn(new_name or f"{time}_local", moved)
    return result.drop("__zone")
