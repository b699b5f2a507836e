"""Lookups, updates by key and value maps.

No join here forces a broadcast. Spark measures the smaller side and broadcasts it below
``spark.sql.autoBroadcastJoinThreshold``; above that it sort-merges, and splits a partition that one
key has made too large (adaptive skew join).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tableprep.functions.names import number_repeats


def one_per_key(df: DataFrame, key: Column, value: Column, what: str) -> DataFrame:
    """``__key`` and ``__new``; a key that occurs more than once raises when the rows are computed.

    One aggregation on the key, whose exchange the join that follows uses too.
    """
    repeated = F.raise_error(F.concat(F.lit(f"{what}: a key occurs more than once: "), F.col("__key").cast("string")))
    keyed = df.where(key.isNotNull()).select(key.alias("__key"), value.alias("__new")).groupBy("__key")
    counted = keyed.agg(F.any_value("__new").alias("__new"), F.count("*").alias("__n"))
    checked = F.when(F.col("__n") > 1, repeated.cast("boolean")).otherwise(F.lit(True))
    return counted.where(checked).select("__key", "__new")


def lookup(
    df: DataFrame, ref: DataFrame, left_key: str, right_key: str, cols: Sequence[str] | None = None
) -> DataFrame:
    """Left join on one key that adds ``cols`` of ``ref``; a name already taken gets the first free of ``_1``, ``_2``...

    A key that occurs more than once in ``ref`` multiplies rows.
    """
    cols = [c for c in ref.columns if c != right_key] if cols is None else list(cols)
    free = number_repeats([*df.columns, *cols])[len(df.columns) :]
    added = [ref[c].alias(name) for c, name in zip(cols, free)]
    right = ref.where(ref[right_key].isNotNull()).select(ref[right_key].alias("__key"), *added)
    return df.join(right, df[left_key] == right["__key"], "left").drop("__key")


def update_by_key(df: DataFrame, updates: DataFrame, key: str) -> DataFrame:
    """Overwrite the columns of matched rows with those of ``updates``, NULLs included.

    Other rows keep their values. Columns that only ``updates`` has are added; names are the same
    whatever their case. A key that occurs twice in ``updates`` raises when the result is computed.
    """
    own = {c.lower(): c for c in df.columns}
    values = {own.get(c.lower(), c): c for c in updates.columns if c.lower() != key.lower()}
    whole = F.struct(*(updates[c].alias(name) for name, c in values.items()), F.lit(True).alias("__hit"))
    right = one_per_key(updates, updates[key], whole, "update_by_key")
    joined = df.join(right, df[key] == right["__key"], "left")
    hit, types = F.col("__new").isNotNull(), {f.name: f.dataType for f in df.schema}
    kept = [
        F.when(hit, F.col("__new").getField(c).cast(types[c])).otherwise(df[c]).alias(c) if c in values else df[c]
        for c in df.columns
    ]
    extra = [F.col("__new").getField(c).alias(c) for c in values if c.lower() not in own]
    return joined.select(*kept, *extra)


def mapping_frame(df: DataFrame, mapping: Mapping[str, str]) -> DataFrame:
    """A value map as a table with columns ``old`` and ``new``."""
    schema = T.StructType([T.StructField("old", T.StringType()), T.StructField("new", T.StringType())])
    return df.sparkSession.createDataFrame(list(mapping.items()), schema)


def map_values(
    df: DataFrame,
    col: str,
    mapping: DataFrame | Mapping[str, str],
    to: str | None = None,
    known_unique: bool = False,
) -> DataFrame:
    """Replace values by a map with columns ``old`` and ``new``; others stay.

    With ``to`` the result goes to that column, and unmapped values are NULL there. An ``old`` value
    that occurs twice raises when the result is computed; ``known_unique`` saves the check.
    """
    table = mapping if isinstance(mapping, DataFrame) else mapping_frame(df, mapping)
    if isinstance(mapping, DataFrame) and not known_unique:
        right = one_per_key(table, table["old"], table["new"], "map_values").withColumnRenamed("__key", "__old")
    else:
        right = table.select(table["old"].alias("__old"), table["new"].alias("__new"))
    joined = df.join(right, df[col].cast("string") == right["__old"], "left")
    if to is not None:
        kept = [df[c] for c in df.columns if c != to]
        return joined.select(*kept, F.col("__new").alias(to))
    mapped = F.when(F.col("__old").isNotNull(), F.col("__new")).otherwise(df[col].cast("string"))
    return joined.select(*[mapped.alias(c) if c == col else df[c] for c in df.columns])


ADDRESS_FORMATS = ("full", "city", "gps")


def normalize_address(df: DataFrame, col: str, resolved: DataFrame, fmt: str = "full") -> DataFrame:
    """Add ``<col>_geo`` from a table of resolved addresses.

    ``resolved`` has columns ``query``, ``label``, ``city``, ``context``, ``lat``, ``lon``. Formats:
    ``full`` (label), ``city`` ("city, context") and ``gps`` ("lat, lon"). Unknown addresses give NULL.
    """
    if fmt not in ADDRESS_FORMATS:
        raise ValueError(f"fmt must be one of {', '.join(ADDRESS_FORMATS)}")
    empty = F.lit("")
    shown = {
        "full": F.nullif(resolved["label"], empty),
        "city": F.concat(F.coalesce(resolved["city"], empty), F.lit(", "), F.coalesce(resolved["context"], empty)),
        "gps": F.concat(resolved["lat"].cast("string"), F.lit(", "), resolved["lon"].cast("string")),
    }[fmt]
    return map_values(df, col, resolved.select(resolved["query"].alias("old"), shown.alias("new")), to=f"{col}_geo")
