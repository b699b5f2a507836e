"""Column statistics, quality scores and checks.

Statistics of all columns come from one pass. Exact distinct counts of many columns would multiply
each row once per column *and* keep all values apart in one aggregation; here the values are
unpivoted to (column, value), grouped by both (with map-side combining), and then counted by column.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tableprep.functions.text import NOT_CP1252, outside_cp1252
from tableprep.scratch import written

# Patterns a text column is tested for, in this order, and the share that must match.
PATTERNS = {
    "EMAIL": r"^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}\z",
    "SIRET": r"^\d{14}\z",
    "NIR": r"^[12]\d{12}(\d{2})?\z",
    "IBAN": r"^[A-Z]{2}\d{2}[A-Z0-9]{11,30}\z",
}
PATTERN_SHARE = 0.7

# Parts of a column name that mark sensitive content.
SENSITIVE_WORDS = ("password", "secret", "token", "api_key", "apikey")
# Published forms of keys and tokens, and of card numbers.
SECRET_FORMATS = {
    "AWS_KEY": r"\b(AKIA|ASIA)[0-9A-Z]{16}\b",
    "GITHUB_TOKEN": r"\bgh[pousr]_[A-Za-z0-9]{36}\b",
    "SLACK_TOKEN": r"\bxox[abprs]-[A-Za-z0-9-]{10,}",
    "GOOGLE_KEY": r"\bAIza[0-9A-Za-z_-]{35}\b",
    "JWT": r"\beyJ[A-Za-z0-9_-]{5,}\.[A-Za-z0-9_-]{5,}\.[A-Za-z0-9_-]*",
    "PRIVATE_KEY": r"-----BEGIN [A-Z ]*PRIVATE KEY-----",
    "CARD": r"\b[0-9]{4}([ -]?[0-9]{4}){3}\b",
}
TOKEN = "[A-Za-z0-9+/_=-]{20,}"


def is_numeric(dtype: T.DataType) -> bool:
    return isinstance(dtype, T.NumericType)


def is_date(field: T.StructField) -> bool:
    """A date by type, or a column of another non-numeric type whose name says date or time."""
    if isinstance(field.dataType, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return True
    name = field.name.lower()
    return not is_numeric(field.dataType) and ("date" in name or "time" in name)


def _fields(df: DataFrame, cols: Sequence[str] | None) -> list[T.StructField]:
    return [df.schema[c] for c in (cols or df.columns)]


def _long(df: DataFrame, fields: list[T.StructField], per_column) -> DataFrame:
    """One aggregation over ``df``, turned into one row per column.

    ``per_column(field)`` gives a dict of aggregates; the dicts share their keys and types.
    """
    rows = [
        F.struct(F.lit(f.name).alias("column"), *[agg.alias(name) for name, agg in per_column(f).items()])
        for f in fields
    ]
    return df.agg(F.array(*rows).alias("rows")).select(F.inline("rows"))


def schema_listing(df: DataFrame) -> DataFrame:
    """Column names and types, in order."""
    return df.sparkSession.createDataFrame([(f.name, f.dataType.simpleString()) for f in df.schema], "name string, type string")


def distinct_counts(df: DataFrame, cols: Sequence[str] | None = None, approx: bool = False) -> DataFrame:
    """``column`` and ``distinct_count`` (NULL is no value).

    ``approx`` needs no shuffle of values; its error is about 5%.
    """
    fields = _fields(df, cols)
    if approx:
        return _long(df, fields, lambda f: {"distinct_count": F.approx_count_distinct(f.name)})
    if len(fields) == 1:
        name = fields[0].name
        seen = df.where(F.col(name).isNotNull()).groupBy(name).agg(F.lit(1))
        return seen.agg(F.lit(name).alias("column"), F.count("*").alias("distinct_count"))
    values = F.stack(
        F.lit(len(fields)), *[part for i, f in enumerate(fields) for part in (F.lit(i), *_typed_value(f))]
    ).alias("i", "whole", "number", "text")
    seen = df.select(values).groupBy("i", "whole", "number", "text").agg(F.lit(1))
    # A group of NULLs only keeps its column in the result, with 0.
    filled = F.count_if(F.expr("whole is not null or number is not null or text is not null"))
    counts = seen.groupBy("i").agg(filled.alias("n"))
    # An empty table has no groups; its columns still get their line.
    names = F.posexplode(F.array(*[F.lit(f.name) for f in fields])).alias("i", "column")
    every = df.sparkSession.range(1).select(names).join(counts, "i", "left")
    return every.select("column", F.coalesce("n", F.lit(0)).alias("distinct_count"))


def _typed_value(field: T.StructField) -> tuple[Column, Column, Column]:
    """The value as a whole number, a double or a text, whichever keeps it exactly; others NULL."""
    column, dtype = F.col(field.name), field.dataType
    whole, number, text = (F.lit(None).cast(t) for t in ("bigint", "double", "string"))
    if isinstance(dtype, (T.IntegralType, T.BooleanType)):
        whole = column.cast("bigint")
    elif isinstance(dtype, T.DateType):
        whole = F.unix_date(column).cast("bigint")
    elif isinstance(dtype, T.TimestampType):
        whole = F.unix_micros(column)
    elif isinstance(dtype, (T.FloatType, T.DoubleType)):
        number = column.cast("double")
    elif isinstance(dtype, (T.ArrayType, T.StructType, T.MapType)):
        text = F.when(column.isNotNull(), F.to_json(F.struct(column)))
    else:
        text = column.cast("string")
    return whole, number, text


def column_stats(df: DataFrame, cols: Sequence[str] | None = None, approx: bool = False) -> DataFrame:
    """Per column: rows, NULLs, NULL share, distinct values, bounds, sum and mean.

    Bounds of numbers are in ``min_number`` and ``max_number``, others as text in ``min_text`` and
    ``max_text``. Sum and mean are NULL for other types than numbers.
    """
    fields = _fields(df, cols)
    no_number, no_text = F.lit(None).cast("double"), F.lit(None).cast("string")

    def basics(field: T.StructField) -> dict[str, Column]:
        column, number = F.col(field.name), is_numeric(field.dataType)
        nulls = F.count("*") - F.count(column)
        ordered = not isinstance(field.dataType, (T.MapType, T.VariantType))
        return {
            "rows": F.count("*"),
            "null_count": nulls,
            "null_percent": F.try_divide(nulls * 100.0, F.count("*")),
            "min_number": F.min(column).cast("double") if number else no_number,
            "max_number": F.max(column).cast("double") if number else no_number,
            "min_text": no_text if number or not ordered else F.min(column).cast("string"),
            "max_text": no_text if number or not ordered else F.max(column).cast("string"),
            "sum": F.sum(column.cast("double")) if number else no_number,
            "avg": F.avg(column) if number else no_number,
        }

    return _long(df, fields, basics).join(distinct_counts(df, cols, approx), "column")


def top_values(df: DataFrame, col: str, k: int = 5) -> DataFrame:
    """The most frequent values with their count and their share of all rows, NULLs included there."""
    counts = df.groupBy(F.col(col).alias("value")).agg(F.count("*").alias("count"))
    # NULLs are a group too, so the total is the sum of the counts, and the grouped exchange serves both.
    total = counts.agg(F.sum("count")).scalar()
    top = counts.where("value is not null").orderBy(F.desc("count"), "value").limit(k)
    return top.withColumn("percent", F.col("count") * 100.0 / total)


def default_measures(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Sum and mean of numbers, count of dates, distinct count of other columns, one row each."""
    fields = _fields(df, cols)
    numbers = [f for f in fields if is_numeric(f.dataType)]
    dates = [f for f in fields if is_date(f)]
    others = [f.name for f in fields if f not in numbers and f not in dates]
    rows = [
        F.struct(F.lit(f.name).alias("column"), F.lit(kind).alias("measure"), agg.alias("value"))
        for f in fields
        for kind, agg in (
            [("sum", F.sum(F.col(f.name).cast("double"))), ("avg", F.avg(F.col(f.name)).cast("double"))] if f in numbers
            else [("count", F.count(F.col(f.name)).cast("double"))] if f in dates else []
        )
    ]
    parts = []
    if rows:
        parts.append(df.agg(F.array(*rows).alias("rows")).select(F.inline("rows")))
    if others:
        counts = distinct_counts(df, others)
        value = F.col("distinct_count").cast("double").alias("value")
        parts.append(counts.select("column", F.lit("distinct").alias("measure"), value))
    return parts[0] if len(parts) == 1 else parts[0].unionAll(parts[1])


def health_columns(df: DataFrame, cols: Sequence[str] | None = None, approx: bool = False) -> DataFrame:
    """Per column: type, NULLs, distinct values, outliers, pattern and a score from 0 to 100.

    An outlier lies more than 3 sample standard deviations from the mean. The score loses 10 above
    10% NULLs, 30 more above 50%, and one point per outlier, at most 10. ``pattern`` is the first of
    :data:`PATTERNS` that more than 70% of the non-NULL texts match.
    """
    fields = _fields(df, cols)
    numbers = [f.name for f in fields if is_numeric(f.dataType)]
    # One row of moments; the second pass uses its fields as literals.
    moments = df.agg(
        *[agg for c in numbers for agg in (F.avg(c).alias(f"m_{c}"), F.stddev_samp(c).alias(f"s_{c}"))], F.count("*")
    ).first().asDict()

    def checks(field: T.StructField) -> dict[str, Column]:
        column = F.col(field.name)
        nulls = F.count("*") - F.count(column)
        outliers, pattern = F.lit(0).cast("bigint"), F.lit(None).cast("string")
        if field.name in numbers:
            mean, deviation = moments[f"m_{field.name}"], moments[f"s_{field.name}"]
            if deviation:
                outliers = F.count_if(F.abs(column - F.lit(mean)) > F.lit(3 * deviation))
        if isinstance(field.dataType, T.StringType):
            shares = [
                F.when(F.count_if(column.rlike(p)) > F.count(column) * F.lit(PATTERN_SHARE), F.lit(label))
                for label, p in PATTERNS.items()
            ]
            pattern = F.coalesce(*shares)
        return {
            "type": F.lit(field.dataType.simpleString()),
            "rows": F.count("*"),
            "null_count": nulls,
            "null_percent": F.coalesce(F.try_divide(nulls * 100.0, F.count("*")), F.lit(0.0)),
            "outliers": outliers,
            "pattern": pattern,
        }

    found = _long(df, fields, checks).join(distinct_counts(df, cols, approx), "column")
    share = F.col("null_percent")
    score = (
        F.lit(100) - F.when(share > 10, 10).otherwise(0) - F.when(share > 50, 30).otherwise(0)
        - F.least(F.col("outliers"), F.lit(10))
    )
    return found.withColumnRenamed("distinct_count", "unique_count").withColumn("score", score.cast("int"))


def health_score(health: DataFrame) -> DataFrame:
    """The rounded mean score of the columns in a :func:`health_columns` result."""
    return health.agg(F.floor(F.avg("score") + 0.5).cast("int").alias("overall_score"), F.max("rows").alias("rows"))


def health_issues(health: DataFrame, jagged: DataFrame | None = None) -> DataFrame:
    """Issues as ``severity``, ``column``, ``message``: outliers warn, jagged rows are critical."""
    issues = health.where("outliers > 0").select(
        F.lit("warning").alias("severity"),
        "column",
        F.format_string("column %s: %d outliers (z-score > 3)", "column", "outliers").alias("message"),
    )
    if jagged is not None:
        issues = issues.unionAll(
            jagged.select(
                F.lit("critical"),
                F.lit(None).cast("string"),
                F.format_string("line %d: expected %d columns, found %d", "row", "expected", "actual"),
            )
        )
    return issues


def sensitive_columns(df: DataFrame) -> DataFrame:
    """Columns whose name marks sensitive content, with the number of rows that hold a value."""
    hits = [f for f in df.schema if any(word in f.name.lower() for word in SENSITIVE_WORDS)]
    if not hits:
        return df.sparkSession.createDataFrame([], "column string, filled bigint")
    return _long(df, hits, lambda f: {"filled": F.count(F.col(f.name))})


def _entropy(text: Column) -> Column:
    """Bits a character: how evenly the characters of a text are used."""
    n = F.length(text)
    part = lambda c: (n - F.length(F.replace(text, c, F.lit("")))) / n
    letters = F.array_distinct(F.filter(F.split(text, ""), lambda c: c != ""))
    return -F.aggregate(letters, F.lit(0.0), lambda total, c: total + part(c) * F.log2(part(c)))


def sensitive_values(df: DataFrame, cols: Sequence[str] | None = None, least_entropy: float = 3.0) -> DataFrame:
    """What the values of text columns hold: ``column``, ``kind``, ``count`` of values and ``share`` of the filled ones.

    ``kind`` is a format of ``SECRET_FORMATS``, ``CARD`` (16 digits, parted or not) or ``RANDOM``: the value's first run of 20 or more
    letters, digits and ``+/_=-`` mixes letters with digits and has ``least_entropy`` bits a character, as keys have and words do not. One
    aggregation over all columns and rows; kinds that no value holds are left out.
    """
    fields = [f for f in _fields(df, cols) if isinstance(f.dataType, T.StringType)]
    if not fields:
        return df.sparkSession.createDataFrame([], "column string, kind string, count bigint, share double")

    def tests(name: str) -> dict[str, Column]:
        text = F.col(f"`{name}`")
        run = F.regexp_extract(text, TOKEN, 0)
        mixed = run.rlike("[0-9]") & run.rlike("[A-Za-z]")
        random = F.when(mixed, _entropy(run) >= least_entropy).otherwise(F.lit(False))
        return {**{kind: text.rlike(pattern) for kind, pattern in SECRET_FORMATS.items()}, "RANDOM": random}

    counts = [
        F.struct(F.lit(f.name).alias("column"), F.lit(kind).alias("kind"), F.count_if(test).alias("count"), F.count_if(F.col(f"`{f.name}`") != "").alias("filled"))
        for f in fields for kind, test in tests(f.name).items()
    ]
    found = df.agg(F.array(*counts).alias("rows")).select(F.inline("rows")).where("count > 0")
    return found.select("column", "kind", "count", (F.col("count") / F.col("filled")).alias("share"))


def _broken(column: Column) -> Column:
    return F.contains(column, F.lit("\n")) | F.contains(column, F.lit("\r")) | F.contains(column, F.lit("\t"))


def mainframe_report(df: DataFrame, max_name: int = 30) -> DataFrame:
    """What an old mainframe would refuse, per column (all rows, one pass).

    ``section`` is ``headers`` (name longer than ``max_name``, or not letters, digits and ``_``),
    ``encoding`` (values with characters outside windows-1252) or ``structure`` (values with a line
    break or a tab). ``errors`` counts them; ``valid`` is false above 0.
    """
    texts = {f.name for f in df.schema if isinstance(f.dataType, T.StringType)}
    rows = []
    for name in df.columns:
        bad_name = len(name) > max_name or not name.isascii() or not name.replace("_", "a").isalnum()
        text = name in texts
        none = F.lit(0).cast("bigint")
        for section, errors in (
            ("headers", F.lit(int(bad_name)).cast("bigint")),
            ("encoding", F.count_if(outside_cp1252(F.col(name))) if text else none),
            ("structure", F.count_if(_broken(F.col(name))) if text else none),
        ):
            rows.append(F.struct(F.lit(section).alias("section"), F.lit(name).alias("column"), errors.alias("errors")))
    report = df.agg(F.array(*rows).alias("rows")).select(F.inline("rows"))
    return report.withColumn("valid", F.col("errors") == 0)


def mainframe_errors(df: DataFrame, key: str) -> DataFrame:
    """Each value outside windows-1252: key, column, first such character, value."""
    texts = [f.name for f in df.schema if isinstance(f.dataType, T.StringType) and f.name != key]
    if not texts:
        raise ValueError("no text columns besides the key")
    long = df.unpivot(key, texts, "column", "value")
    bad = long.where(outside_cp1252(F.col("value")))
    return bad.select(key, "column", F.regexp_substr("value", F.lit(NOT_CP1252)).alias("char"), "value")


class RowLossError(RuntimeError):
    """A step removed more rows than allowed."""


def guard_row_loss(before: DataFrame, after: DataFrame, pct: float = 5.0) -> DataFrame:
    """``after``, or :class:`RowLossError` if it lost more than ``pct`` percent of the rows.

    ``after`` is computed once: it is written, counted as it goes, and read back.
    """
    counted = Observation()
    after = written(after.observe(counted, F.count(F.lit(1)).alias("rows")), "guarded")
    had, has = before.count(), counted.get["rows"]
    if had and (had - has) * 100.0 / had > pct:
        raise RowLossError(f"{had - has} of {had} rows would be lost; the limit is {pct}%")
    return after
