"""Names, order, and operators that change or add columns."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tableprep.functions.names import copybook_names, mainframe_name, normalize_names, number_repeats
from tableprep.functions.text import end_of_text, like_pattern, quoted
from tableprep.operators.filters import typed_literal

# Unit conversions and their factors.
CONVERSIONS = {
    "kg -> lb": 2.20462,
    "lb -> kg": 0.453592,
    "g -> oz": 0.035274,
    "oz -> g": 28.3495,
    "m -> ft": 3.28084,
    "ft -> m": 0.3048,
    "km -> mi": 0.621371,
    "mi -> km": 1.60934,
    "L -> gal (US)": 0.264172,
    "gal (US) -> L": 3.78541,
}


def rename(df: DataFrame, mapping: Mapping[str, str]) -> DataFrame:
    """Rename all columns at once, so two columns can swap names."""
    missing = set(mapping) - set(df.columns)
    if missing:
        raise ValueError(f"no columns {sorted(missing)}")
    names = [mapping.get(c, c) for c in df.columns]
    if len({n.lower() for n in names}) < len(names):
        raise ValueError(f"repeated names: {names}")
    return df.toDF(*names)


def reorder(df: DataFrame, order: Sequence[str]) -> DataFrame:
    """Named columns first, in this order; the others follow."""
    return df.select(*order, *[c for c in df.columns if c not in order])


def drop_columns(df: DataFrame, *cols: str) -> DataFrame:
    return df.drop(*cols)


def hide_columns(df: DataFrame, hidden: Sequence[str]) -> DataFrame:
    """What may leave the house: all columns but the hidden ones."""
    return df.drop(*hidden)


def normalize_headers(df: DataFrame) -> DataFrame:
    return df.toDF(*normalize_names(df.columns))


def mainframe_names(df: DataFrame, max_len: int = 10) -> DataFrame:
    """Names that old mainframes accept; names that become equal get a number."""
    return df.toDF(*number_repeats([mainframe_name(c, max_len) for c in df.columns], max_len))


def rename_from_copybook(df: DataFrame, text: str, mainframe: bool = False, max_len: int = 10) -> DataFrame:
    """The nth field name of the text goes to the nth column; further columns keep theirs."""
    fields = copybook_names(text)
    names = [*fields[: len(df.columns)], *df.columns[len(fields):]]
    if mainframe:
        names = [mainframe_name(n, max_len) if i < len(fields) else n for i, n in enumerate(names)]
    return df.toDF(*number_repeats(names))


def add_row_id(df: DataFrame, name: str = "row_id") -> DataFrame:
    """A number that grows with file order, with gaps.

    Take it right after the scan; write the result before a shuffle if the numbers must stay fixed.
    """
    return df.withColumn(name, F.monotonically_increasing_id())


def formula(df: DataFrame, name: str, expression: str, strict: bool = False) -> DataFrame:
    """A numeric column from a Spark SQL expression, with backticks around unusual names.

    A result that is no number gives NULL; ``strict`` raises instead. In ANSI sessions ``/`` raises on
    zero, ``try_divide(a, b)`` gives NULL.
    """
    result = F.expr(expression)
    return df.withColumn(name, result.cast("double") if strict else result.try_cast("double"))


def conditional(
    df: DataFrame, name: str, col: str, op: str, value: str, then: str, otherwise: str
) -> DataFrame:
    """IF column op value THEN .. ELSE .., with op in ``= != > < LIKE contains``.

    A NULL takes the ELSE branch. ``LIKE`` takes the pattern as it is; ``contains`` adds ``%``.
    """
    column = df[col]
    if op in ("LIKE", "contains"):
        around = ("%", "%") if op == "contains" else ("", "")
        test = column.cast("string").like(like_pattern(value, *around))
    elif op in ("=", "!=", ">", "<"):
        literal = typed_literal(value, df.schema[col].dataType, col)
        test = {
            "=": column == literal, "!=": column != literal,
            ">": column > literal, "<": column < literal,
        }[op]
    else:
        raise ValueError("op must be one of = != > < LIKE contains")
    return df.withColumn(name, F.when(test, F.lit(then)).otherwise(F.lit(otherwise)))


def change_case(df: DataFrame, col: str, kind: str) -> DataFrame:
    """``kind``: upper, lower or proper."""
    change = {"upper": F.upper, "lower": F.lower, "proper": F.initcap}
    return df.withColumn(col, change[kind](df[col]))


def trim_text(df: DataFrame, col: str) -> DataFrame:
    """Remove spaces at both ends; tabs stay."""
    return df.withColumn(col, F.trim(df[col]))


def mask(df: DataFrame, col: str, token: str = "*****") -> DataFrame:
    """Replace a whole column, NULLs included."""
    return df.withColumn(col, F.lit(token))


def fill_empty(df: DataFrame, col: str) -> DataFrame:
    """NULL becomes the empty string; a column of another type becomes text."""
    return df.withColumn(col, F.coalesce(df[col].cast("string"), F.lit("")))


def cast_column(df: DataFrame, col: str, dtype: str, strict: bool = False) -> DataFrame:
    """Cast; a value that does not fit becomes NULL, or raises when ``strict``."""
    return df.withColumn(col, df[col].cast(dtype) if strict else df[col].try_cast(dtype))


def split_column(
    df: DataFrame, col: str, sep: str, n: int | None = None, names: Sequence[str] | None = None,
    max_columns: int = 1000,
) -> DataFrame:
    """Split at a literal separator into ``<col>_part1``...; missing parts are NULL.

    Without ``n`` or ``names`` one pass over the column finds the largest number of parts; more than
    ``max_columns`` raise.
    """
    parts = F.split(df[col].cast("string"), quoted(sep), -1)
    if names is None:
        if n is None:
            n = max(df.agg(F.max(F.size(parts))).first()[0] or 1, 1)
            if n > max_columns:
                raise ValueError(f"a value of {col!r} has {n} parts, the limit is {max_columns}: give n, names or max_columns")
        names = [f"{col}_part{i + 1}" for i in range(n)]
    return df.withColumns({name: F.get(parts, F.lit(i)) for i, name in enumerate(names)})


def group_count(pattern: str) -> int:
    """Number of capture groups in a Java regular expression."""
    bare = re.sub(r"\\Q.*?(\\E|$)|\\.", "", pattern, flags=re.S)
    bare = re.sub(r"\[\^?\]?[^\]]*\]", "", bare)
    return len(re.findall(r"\((?!\?)|\(\?<(?![=!])", bare))


def _looks_only_inside(pattern: str) -> bool:
    """True when a match depends on the matched text alone: no anchors but a first ``^``, no lookaround."""
    plain = re.sub(r"\[\^?\]?[^\]]*\]", "", pattern.removeprefix("^"))
    return not re.search(r"[\^$]|\\[bBAzZGkQE1-9]|\(\?[^:]|[*+?}]\+", plain)


def regex_extract(df: DataFrame, col: str, pattern: str, names: Sequence[str] | None = None) -> DataFrame:
    """One column ``<col>_ext1``... per capture group; the empty string where nothing matches.

    A pattern without a group gives one column with the whole match.
    """
    groups = group_count(pattern)
    first, count = (1, groups) if groups else (0, 1)
    names = names or [f"{col}_ext{i + 1}" for i in range(count)]
    if len(names) > count:
        raise ValueError(f"the pattern has {groups} groups, got {len(names)} names")
    text = df[col].cast("string")
    if len(names) > 1 and _looks_only_inside(pattern):
        # Long texts are searched once; the groups come from the short match.
        text = F.regexp_extract(text, pattern, 0)
    pattern = end_of_text(pattern)
    return df.withColumns({nm: F.regexp_extract(text, pattern, first + i) for i, nm in enumerate(names)})


def convert_unit(df: DataFrame, col: str, conversion: str) -> DataFrame:
    """Add ``<col>_conv``; ``conversion`` is a key of :data:`CONVERSIONS`."""
    if conversion not in CONVERSIONS:
        raise ValueError(f"conversion must be one of {', '.join(CONVERSIONS)}")
    return df.withColumn(f"{col}_conv", df[col].try_cast("double") * F.lit(CONVERSIONS[conversion]))
