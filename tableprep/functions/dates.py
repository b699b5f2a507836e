"""Date and time expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Date formats in the order in which ties are decided.
DATE_FORMATS = ("dd/MM/yyyy", "MM/dd/yyyy", "yyyy-MM-dd", "yyyyMMdd")

_YEAR = "(?<y>[0-9]{4})"
# By strictness: two digits, or one where a two-digit number would have a leading zero.
_DAY = {True: "(?<d>0[1-9]|[12][0-9]|3[01])", False: "(?<d>0?[1-9]|[12][0-9]|3[01])"}
_MONTH = {True: "(?<m>0[1-9]|1[0-2])", False: "(?<m>0?[1-9]|1[0-2])"}


def _shape(fmt: str, strict: bool) -> str:
    strict = strict or fmt == "yyyyMMdd"
    parts = {"yyyy": _YEAR, "MM": _MONTH[strict], "dd": _DAY[strict]}
    return "^" + re.sub("yyyy|MM|dd", lambda part: parts[part.group()], fmt) + "\\z"


def parsed_date(column: Column, fmt: str, strict: bool = True) -> Column:
    """The date, or NULL.

    The known formats are matched by shape and cast: a failing date parser costs an exception per
    value, a failing match does not. Other formats go through the parser.
    """
    if fmt not in DATE_FORMATS:
        return F.try_to_timestamp(column, F.lit(fmt)).cast("date")
    shape = _shape(fmt, strict)
    return F.when(column.rlike(shape), F.regexp_replace(column, shape, "${y}-${m}-${d}").try_cast("date"))


def matches_format(column: Column, fmt: str) -> Column:
    """True when the text is a real date in exactly this format."""
    return parsed_date(column, fmt).isNotNull()


def iso_date(column: Column, fmt: str) -> Column:
    """``yyyy-MM-dd`` text; NULL when the value is no date in this format (leading zeros optional)."""
    return parsed_date(column, fmt, strict=False).cast("string")


def calendar_parts(day: Column) -> dict[str, Column]:
    """Columns of a calendar row; the week is the ISO week."""
    return {
        "Date": day,
        "Year": F.year(day),
        "Month": F.month(day),
        "Day": F.day(day),
        "DayName": F.date_format(day, "EEEE"),
        "Quarter": F.quarter(day),
        "Week": F.weekofyear(day),
        "IsWeekend": F.dayofweek(day).isin(1, 7),
    }


def local_time_in(column: Column, zone: Column, target: str) -> Column:
    """Wall time of ``zone`` shown as wall time of ``target``, as ``yyyy-MM-dd HH:mm:ss`` text.

    Works on times without a zone, so the session time zone plays no part. A text that carries its
    own offset keeps it.
    """
    text = F.trim(column.cast("string"))
    has_offset = text.rlike("[T ][0-9:.]+ ?(Z|[+-][0-9]{2}(:?[0-9]{2})?)$")
    offset = F.regexp_extract(text, "(Z|[+-][0-9]{2}(?::?[0-9]{2})?)$", 1)
    offset = F.when(offset == "Z", F.lit("UTC")).otherwise(
        F.regexp_replace(offset, "^([+-][0-9]{2}):?([0-9]{2})?$", "$1:$2")
    )
    offset = F.when(offset.endswith(":"), F.concat(offset, F.lit("00"))).otherwise(offset)
    bare = F.trim(F.regexp_replace(text, " ?(Z|[+-][0-9]{2}(:?[0-9]{2})?)$", ""))
    local = F.when(has_offset, bare).otherwise(text).try_cast("timestamp_ntz")
    source = F.when(has_offset, offset).otherwise(zone)
    moved = F.convert_timezone(source, F.lit(target), local)
    return F.substring(moved.cast("string"), 1, 19)
