"""Comparison of two versions of a table."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def schema_diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """Columns that only one version has, with ``added`` or ``removed``."""
    added = [(c, "added") for c in b.columns if c not in a.columns]
    removed = [(c, "removed") for c in a.columns if c not in b.columns]
    return a.sparkSession.createDataFrame(added + removed, "column string, status string")


def row_diff(a: DataFrame, b: DataFrame, mode: str = "set", key: str | None = None) -> DataFrame:
    """Rows of ``b`` that ``a`` lacks (``added``) and the reverse (``removed``).

    Columns are aligned by name. ``set`` ignores how often a row occurs; ``bag`` gives each surplus
    copy. With ``key`` the rows are matched by key, and one that differs is ``changed``; a key that
    occurs twice in a version raises; rows without a key match no row by it, so they are compared whole, as in ``bag``.
    A column whose types differ is compared as text, numbers of two types as the wider one.
    Each is one aggregation over the two versions.
    """
    if set(a.columns) != set(b.columns):
        raise ValueError("the versions have different columns; see schema_diff")
    a, b = _same_types(a, b)
    if key is not None:
        return _diff_by_key(a, b, key)
    if mode not in ("set", "bag"):
        raise ValueError("mode must be 'set' or 'bag'")
    both = a.withColumn("__side", F.lit(-1)).unionByName(b.withColumn("__side", F.lit(1)))
    sides = both.groupBy(*a.columns).agg(
        F.sum("__side").alias("__more"), F.min("__side").alias("__lo"), F.max("__side").alias("__hi")
    )
    if mode == "set":
        one_sided = sides.where("__lo = __hi")
        return one_sided.select(_status(F.col("__lo")), *a.columns)
    copies = F.explode(F.sequence(F.lit(1), F.abs("__more")))
    uneven = sides.where("__more <> 0").withColumn("__copy", copies)
    return uneven.select(_status(F.col("__more")), *a.columns)


def _same_types(a: DataFrame, b: DataFrame) -> tuple[DataFrame, DataFrame]:
    one, two = ({f.name: f.dataType for f in v.schema} for v in (a, b))
    # Numbers stay numbers; all other unlike types become text.
    to = {c: _common_number(one[c], two[c]) for c in a.columns if one[c] != two[c]}
    return a.withColumns({c: a[c].cast(t) for c, t in to.items()}), b.withColumns({c: b[c].cast(t) for c, t in to.items()})


def _common_number(one: T.DataType, two: T.DataType) -> T.DataType:
    kinds = (one, two)
    if all(isinstance(k, T.IntegralType) for k in kinds):
        return T.LongType()
    if all(isinstance(k, (T.IntegralType, T.FloatType, T.DoubleType)) for k in kinds):
        return T.DoubleType()
    return T.StringType()


def _status(sign):
    return F.when(sign > 0, "added").otherwise("removed").alias("status")


def _diff_by_key(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    # One aggregation with map-side combining, as in the other modes; an outer join could not split
    # a hot key.
    whole = F.struct(*a.columns)
    nothing = F.lit(None).cast(a.select(whole).schema[0].dataType)
    keyless = row_diff(a.where(a[key].isNull()), b.where(b[key].isNull()), "bag")
    a, b = a.where(a[key].isNotNull()), b.where(b[key].isNotNull())
    both = a.select(whole.alias("__old"), nothing.alias("__new")).unionAll(b.select(nothing, whole))
    keyed = both.withColumn("__key", F.coalesce("__new", "__old").getField(key))
    sides = keyed.groupBy("__key").agg(
        F.any_value("__old", True).alias("__old"), F.any_value("__new", True).alias("__new"),
        F.greatest(F.count("__old"), F.count("__new")).alias("__copies"),
    )
    old, new = F.col("__old"), F.col("__new")
    values = [c for c in a.columns if c != key]
    differs = [~old.getField(c).eqNullSafe(new.getField(c)) for c in values]
    repeated = F.raise_error(F.concat(F.lit("row_diff: a key occurs more than once: "), F.col("__key").cast("string")))
    status = (
        F.when(F.col("__copies") > 1, repeated.cast("string")).when(old.isNull(), "added").when(new.isNull(), "removed")
        .when(reduce(or_, differs, F.lit(False)), "changed")
    )
    changed = F.filter(F.array(*[F.when(d, F.lit(c)) for d, c in zip(differs, values)]), lambda c: c.isNotNull())
    shown = F.coalesce(new, old)
    matched = (
        sides.withColumn("status", status)
        .where(F.col("status").isNotNull())
        .select(
            "status",
            *[shown.getField(c).alias(c) for c in a.columns],
            F.when(F.col("status") == "changed", F.array_join(changed, ",")).alias("changed_columns"),
        )
    )
    return matched.unionAll(keyless.select("status", *a.columns, F.lit(None).cast("string").alias("changed_columns")))


def diff_counts(diff: DataFrame) -> DataFrame:
    """Number of rows per status."""
    return diff.groupBy("status").agg(F.count("*").alias("rows"))
