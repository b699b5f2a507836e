"""Pivot, grouped tables and unpivot."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

AGGREGATES = {"COUNT": F.count, "SUM": F.sum, "AVG": F.avg, "MIN": F.min, "MAX": F.max}
# Up to so many pivot columns are aggregated side by side.
FEW_VALUES = 20


def _aggregate(agg: str, value: Column) -> Column:
    if agg.upper() not in AGGREGATES:
        raise ValueError(f"agg must be one of {', '.join(AGGREGATES)}")
    return AGGREGATES[agg.upper()](value)


def pivot(
    df: DataFrame,
    row: str,
    col: str,
    value: str,
    agg: str = "COUNT",
    values: Sequence | None = None,
    max_columns: int = 1000,
) -> DataFrame:
    """One line per ``row`` value and one column per non-NULL ``col`` value.

    Without ``values`` the distinct values are read first; more than ``max_columns`` of them raise,
    so the list that reaches the driver is bounded. An empty cell counts 0 under COUNT, else NULL.
    """
    if values is None:
        found = df.select(col).where(F.col(col).isNotNull()).distinct().limit(max_columns + 1).collect()
        if len(found) > max_columns:
            raise ValueError(f"column {col!r} has more than {max_columns} values")
        values = sorted(r[0] for r in found)
    if not values:
        return df.select(row).distinct()
    if len(values) <= FEW_VALUES and all(isinstance(v, str) for v in values) and len(set(values)) == len(values):
        # One exchange of a row for each line. Spark's own pivot groups by line and value first, and then again by line.
        return df.groupBy(row).agg(*(_aggregate(agg, F.when(F.col(col) == v, F.col(value))).alias(v) for v in values))
    result = df.groupBy(row).pivot(col, list(values)).agg(_aggregate(agg, F.col(value)))
    if agg.upper() == "COUNT":
        result = result.fillna(0, subset=[c for c in result.columns if c != row])
    return result


def grouped(df: DataFrame, row: str, value: str, agg: str = "COUNT") -> DataFrame:
    """One aggregate per row value, in order, as column ``<AGG>_<value>``."""
    name = f"{agg.upper()}_{value}"
    return df.groupBy(row).agg(_aggregate(agg, F.col(value)).alias(name)).orderBy(F.asc_nulls_last(row))


def unpivot(
    df: DataFrame, cols: Sequence[str], name: str = "Attribut", value: str = "Valeur", keep_nulls: bool = False
) -> DataFrame:
    """Turn columns into (name, value) rows; the other columns repeat.

    Numbers of different types become doubles, other mixtures become text. NULL values are dropped.
    """
    types = {df.schema[c].dataType for c in cols}
    if len(types) == 1:
        cast = lambda c: df[c]
    elif all(isinstance(t, T.NumericType) for t in types):
        cast = lambda c: df[c].cast("double")
    else:
        cast = lambda c: df[c].cast("string")
    ids = [c for c in df.columns if c not in cols]
    uniform = df.select(*ids, *[cast(c).alias(c) for c in cols])
    long = uniform.unpivot(ids, list(cols), name, value)
    return long if keep_nulls else long.where(F.col(value).isNotNull())
