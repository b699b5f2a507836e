"""Search, filter rules, rule sets, sorting and paging."""

from __future__ import annotations

import datetime as dt
import json
import uuid
from collections.abc import Iterable, Sequence
from decimal import Decimal, InvalidOperation
from functools import reduce
from operator import and_, or_
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tableprep.functions.text import contains_text, like_pattern

OPERATORS = (
    "equals", "not_equals", "contains", "not_contains", "greater_than", "less_than",
    "starts_with", "ends_with", "is_empty", "is_not_empty",
)
NEEDS_NO_VALUE = ("is_empty", "is_not_empty")


def typed_literal(value: Any, dtype: T.DataType, column: str) -> Column:
    """``value`` as a literal of the column's type, so that the filter reaches the file scan."""
    try:
        if isinstance(dtype, (T.FloatType, T.DoubleType)):
            return F.lit(float(value))
        if isinstance(dtype, T.IntegralType):
            number = Decimal(str(value))
            whole = number == number.to_integral_value()
            return F.lit(int(number)) if whole else F.lit(float(number))
        if isinstance(dtype, T.DecimalType):
            return F.lit(Decimal(str(value)))
        if isinstance(dtype, T.DateType):
            return F.lit(_date(value))
        if isinstance(dtype, (T.TimestampType, T.TimestampNTZType)):
            time = dt.datetime.fromisoformat(str(value))
            # A time without zone means the session's zone, so it is cast as text, in a form that Spark reads.
            return F.lit(time.isoformat(sep=" ")).cast(dtype)
        if isinstance(dtype, T.BooleanType):
            return F.lit({"true": True, "false": False}[str(value).strip().lower()])
    except (ValueError, KeyError, InvalidOperation) as error:
        raise ValueError(f"{value!r} does not fit column {column!r} ({dtype.simpleString()})") from error
    return F.lit(str(value))


def _date(value: Any) -> dt.date:
    """A date, or a time of day 0:00 on it."""
    time = dt.datetime.fromisoformat(str(value))
    if time.time() != dt.time(0):
        raise ValueError(f"{value!r} is no whole day")
    return time.date()


def check_rules(df: DataFrame, rules: Iterable[dict]) -> None:
    """Raise unless each rule names a column, a known operator and, where needed, a value."""
    for rule in rules:
        if not rule.get("column"):
            raise ValueError(f"rule without a column: {rule}")
        if rule["column"] not in df.columns:
            raise ValueError(f"no column {rule['column']!r}")
        if rule.get("operator") not in OPERATORS:
            raise ValueError(f"operator must be one of {', '.join(OPERATORS)}")
        if rule["operator"] not in NEEDS_NO_VALUE and rule.get("value") in (None, ""):
            raise ValueError(f"rule without a value: {rule}")


def rule_predicate(df: DataFrame, rule: dict) -> Column:
    """The condition of one rule.

    ``greater_than`` and ``less_than`` compare text columns as text. A NULL fails every test but
    ``is_empty``.
    """
    check_rules(df, [rule])
    name, operator, value = rule["column"], rule["operator"], rule.get("value")
    column, dtype = df[name], df.schema[name].dataType
    text = column.cast("string")
    if operator == "equals":
        return column == typed_literal(value, dtype, name)
    if operator == "not_equals":
        return column != typed_literal(value, dtype, name)
    if operator == "greater_than":
        return column > typed_literal(value, dtype, name)
    if operator == "less_than":
        return column < typed_literal(value, dtype, name)
    if operator == "contains":
        return contains_text(column, value, rule.get("literal", False))
    if operator == "not_contains":
        return ~contains_text(column, value, rule.get("literal", False))
    if operator == "starts_with":
        return text.ilike(like_pattern(value, before=""))
    if operator == "ends_with":
        return text.ilike(like_pattern(value, after=""))
    empty = column.isNull()
    if isinstance(dtype, T.StringType):
        empty = empty | (column == "")
    return empty if operator == "is_empty" else ~empty


# Characters (in lower case) that the text of a value can hold, by type.
_WRITTEN_WITH = (
    (T.BooleanType, "truefalse"),
    (T.IntegralType, "-0123456789"),
    (T.DecimalType, "-+.0123456789e"),
    ((T.FloatType, T.DoubleType), "-.0123456789einfinitynan"),
    (T.DateType, "-+0123456789"),
    ((T.TimestampType, T.TimestampNTZType), "-+:. 0123456789"),
)


def _can_hold(dtype: T.DataType, text: str, literal: bool) -> bool:
    """False when no value of this type contains ``text``."""
    needed = set(text.lower()) - (set() if literal else set("%_"))
    return all(needed <= set(letters) for kind, letters in _WRITTEN_WITH if isinstance(dtype, kind))


def search(df: DataFrame, text: str, literal: bool = False) -> DataFrame:
    """Rows in which any column, as text, contains ``text``, whatever the case.

    Columns of a type that cannot hold the text (numbers, for a word) are not turned into text.
    """
    if not text.strip():
        return df
    columns = [f.name for f in df.schema if _can_hold(f.dataType, text, literal)]
    return df.where(reduce(or_, [contains_text(df[c], text, literal) for c in columns], F.lit(False)))


def active_rules(rules: Iterable[dict]) -> list[dict]:
    """Rules in use, by priority."""
    chosen = [rule for rule in rules if rule.get("active", True) and rule.get("column")]
    return sorted(chosen, key=lambda rule: rule.get("priority", 0))


def apply_rules(df: DataFrame, rules: Iterable[dict]) -> DataFrame:
    """Rows that pass all active rules."""
    conditions = [rule_predicate(df, rule) for rule in active_rules(rules)]
    return df.where(reduce(and_, conditions)) if conditions else df


def sort_rows(df: DataFrame, cols: str | Sequence[str], desc: bool | Sequence[bool] = False) -> DataFrame:
    """Sort by one or more columns; NULLs come last in both directions.

    Ties are ordered by a hash of the row. So rows that share one value can go to many tasks.
    """
    hashable = [f.name for f in df.schema if not isinstance(f.dataType, (T.MapType, T.VariantType))]
    spread = [F.xxhash64(*hashable)] if hashable else []
    return df.orderBy(*_sort_keys(cols, desc), *spread)


def _sort_keys(cols: str | Sequence[str], desc: bool | Sequence[bool]) -> list[Column]:
    cols = [cols] if isinstance(cols, str) else list(cols)
    flags = [desc] * len(cols) if isinstance(desc, bool) else list(desc)
    if len(flags) != len(cols):
        raise ValueError("one direction per column")
    return [F.desc_nulls_last(c) if down else F.asc_nulls_last(c) for c, down in zip(cols, flags)]


def next_sort(current: tuple[str, bool] | None, column: str) -> tuple[str, bool] | None:
    """The sort after one more click on a column: ascending, descending, none."""
    if current is None or current[0] != column:
        return column, False
    return (column, True) if not current[1] else None


def page(
    df: DataFrame,
    n: int = 100,
    text: str = "",
    rules: Iterable[dict] = (),
    sort: str | Sequence[str] | None = None,
    desc: bool | Sequence[bool] = False,
) -> DataFrame:
    """First ``n`` rows after search, rules and sort (a top-k, without a full sort)."""
    found = apply_rules(search(df, text), rules)
    return (found.orderBy(*_sort_keys(sort, desc)) if sort else found).limit(n)


# Rule lists. Each function returns a new list.


def add_rule(rules: Sequence[dict], column: str = "", operator: str = "contains", value: str = "") -> list[dict]:
    new = {"id": uuid.uuid4().hex, "column": column, "operator": operator, "value": value, "active": True}
    return _ranked([*rules, new])


def change_rule(rules: Sequence[dict], rule_id: str, **changes: Any) -> list[dict]:
    return [{**rule, **changes} if rule["id"] == rule_id else rule for rule in rules]


def delete_rule(rules: Sequence[dict], rule_id: str) -> list[dict]:
    return _ranked([rule for rule in rules if rule["id"] != rule_id])


def duplicate_rule(rules: Sequence[dict], rule_id: str) -> list[dict]:
    copies = [{**rule, "id": uuid.uuid4().hex} for rule in rules if rule["id"] == rule_id]
    return _ranked([*rules, *copies])


def toggle_rule(rules: Sequence[dict], rule_id: str) -> list[dict]:
    return [{**r, "active": not r.get("active", True)} if r["id"] == rule_id else r for r in rules]


def move_rule(rules: Sequence[dict], rule_id: str, to: int) -> list[dict]:
    moved = next(rule for rule in rules if rule["id"] == rule_id)
    rest = [rule for rule in rules if rule["id"] != rule_id]
    return _ranked([*rest[:to], moved, *rest[to:]])


def save_template(name: str, rules: Sequence[dict]) -> str:
    """A rule set as JSON text, under a name."""
    kept = [{k: v for k, v in rule.items() if k != "id"} for rule in rules]
    return json.dumps({"name": name, "rules": kept}, ensure_ascii=False)


def load_template(template: str) -> list[dict]:
    """The rules of a template, with new ids and no columns: the next table may differ."""
    saved = json.loads(template)["rules"]
    return _ranked([{**rule, "id": uuid.uuid4().hex, "column": ""} for rule in saved])


def bind_template(template: str, columns: Sequence[str]) -> list[dict]:
    """The rules of a template, with the nth column given to the nth rule."""
    rules = load_template(template)
    if len(columns) != len(rules):
        raise ValueError(f"the template has {len(rules)} rules, got {len(columns)} columns")
    return [{**rule, "column": column} for rule, column in zip(rules, columns)]


def _ranked(rules: Sequence[dict]) -> list[dict]:
    return [{**rule, "priority": rank} for rank, rule in enumerate(rules, start=1)]


# Places.


def with_coordinates(df: DataFrame, lat: str, lon: str) -> DataFrame:
    """Rows whose coordinates are numbers, both cast to double."""
    numbers = df.withColumns({lat: df[lat].try_cast("double"), lon: df[lon].try_cast("double")})
    return numbers.dropna(subset=[lat, lon])


def geo_box(
    df: DataFrame, lat: str, lon: str, south: float, north: float, west: float, east: float
) -> DataFrame:
    """Rows inside a box, edges included."""
    numbers = with_coordinates(df, lat, lon)
    return numbers.where(numbers[lat].between(south, north) & numbers[lon].between(west, east))


def around(df: DataFrame, lat: str, lon: str, at: tuple[float, float], degrees: float = 1.0) -> DataFrame:
    """Rows within ``degrees`` of a point on both axes."""
    return geo_box(df, lat, lon, at[0] - degrees, at[0] + degrees, at[1] - degrees, at[1] + degrees)
