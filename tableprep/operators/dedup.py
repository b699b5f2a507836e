"""Exact and keyed removal of duplicates.

Everything here is a plain aggregation with map-side combining: no window sorts one hot key in one
task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tableprep.operators.columns import add_row_id


def _orderable(dtype: T.DataType) -> bool:
    if isinstance(dtype, (T.MapType, T.VariantType)):
        return False
    if isinstance(dtype, T.ArrayType):
        return _orderable(dtype.elementType)
    if isinstance(dtype, T.StructType):
        return all(_orderable(f.dataType) for f in dtype)
    return True


def match_key(column: Column, mode: str) -> Column:
    """``exact``: the value itself; ``smart``: its text in upper case without outer spaces."""
    if mode == "exact":
        return column
    if mode == "smart":
        return F.trim(F.upper(column.cast("string")))
    raise ValueError("mode must be 'exact' or 'smart'")


def dedup(
    df: DataFrame,
    keys: Sequence[str],
    keep: str = "first",
    mode: str = "exact",
    order_by: str | Sequence[str] | None = None,
) -> DataFrame:
    """One row per key: the first or last in ``order_by`` order (file order without it).

    NULL keys form a group of their own. Rows that tie on ``order_by`` are told apart by their other
    columns, so the choice does not depend on the partitioning.
    """
    if keep not in ("first", "last"):
        raise ValueError("keep must be 'first' or 'last'")
    columns = df.columns
    if order_by is None:
        df, order_by = add_row_id(df, "__row"), ["__row"]
    order = [order_by] if isinstance(order_by, str) else list(order_by)
    # In a comparison of structs NULL is smallest; the flag puts it last in both directions.
    flag = (lambda c: df[c].isNull()) if keep == "first" else (lambda c: df[c].isNotNull())
    rank = [part for i, c in enumerate(order) for part in (flag(c).alias(f"n{i}"), df[c].alias(f"o{i}"))]
    rest = [c for c in columns if c not in order]
    whole = [c for c in rest if _orderable(df.schema[c].dataType)]
    others = [c for c in rest if c not in whole]
    row = F.struct(*rank, *[df[c].alias(f"t{whole.index(c)}") for c in whole])
    if others:
        pick = F.min_by if keep == "first" else F.max_by
        best = pick(F.struct(row.alias("row"), F.struct(*[df[c] for c in others]).alias("others")), row)
    else:
        # The row is its own rank, so each group carries it once.
        best = F.struct((F.min if keep == "first" else F.max)(row).alias("row"))
    groups = df.groupBy(*[match_key(df[c], mode).alias(f"__k{i}") for i, c in enumerate(keys)]).agg(best.alias("b"))
    place = {c: f"b.row.o{i}" for i, c in enumerate(order)} | {c: f"b.row.t{i}" for i, c in enumerate(whole)}
    return groups.select(*[F.col(place.get(c, f"b.others.`{c}`")).alias(c) for c in columns])


def dedup_preview(df: DataFrame, keys: Sequence[str], mode: str = "exact") -> DataFrame:
    """Rows, distinct keys (NULL counts as a key) and rows that :func:`dedup` would remove."""
    sizes = df.groupBy(*[match_key(df[c], mode).alias(f"__k{i}") for i, c in enumerate(keys)]).agg(
        F.count("*").alias("n")
    )
    rows = F.coalesce(F.sum("n"), F.lit(0))
    return sizes.agg(
        rows.alias("rows"), F.count("*").alias("kept"), (rows - F.count("*")).alias("removed")
    )


def merge_duplicates(df: DataFrame) -> DataFrame:
    """Each distinct row once."""
    return df.distinct()


def duplicate_summary(df: DataFrame) -> DataFrame:
    """Surplus rows (all copies but one) and the number of groups with copies."""
    sizes = df.groupBy(*df.columns).agg(F.count("*").alias("__n")).where("__n > 1")
    return sizes.agg(
        F.coalesce(F.sum(F.col("__n") - 1), F.lit(0)).alias("surplus"), F.count("*").alias("groups")
    )


def duplicate_groups(df: DataFrame, k: int = 5) -> DataFrame:
    """The ``k`` rows with most copies, with their ``count``."""
    sizes = df.groupBy(*df.columns).agg(F.count("*").alias("count")).where(F.col("count") > 1)
    return sizes.orderBy(F.desc("count"), *[F.asc_nulls_last(c) for c in df.columns]).limit(k)


def distinct_values(df: DataFrame, col: str) -> DataFrame:
    return df.select(col).distinct()
