"""A list of operator steps as data: recorded, saved as JSON, replayed on any table."""

from __future__ import annotations

import datetime as dt
import json
from collections.abc import Callable, Mapping
from dataclasses import asdict, dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from tableprep.operators import (
    charts, columns, console, dedup, diff, enrich, filters, fuzzy, joins, parse, profile, reshape, times,
)
from tableprep.sources import readers

KINDS = ("LOAD", "TRANSFORM", "CLEAN", "AI")

# Steps that read files; one may only come first.
LOADERS = {f.__name__: f for f in (readers.read_delimited, readers.read_json, readers.read_fixed_width, readers.read_any)}

# All operators that a step may name: functions from a table to a table.
OPERATORS = {
    name: getattr(module, name)
    for module, names in {
        columns: """add_row_id cast_column change_case conditional convert_unit drop_columns fill_empty formula hide_columns
            mainframe_names mask normalize_headers regex_extract rename rename_from_copybook reorder split_column trim_text""",
        filters: "apply_rules around geo_box page search sort_rows with_coordinates",
        parse: """check_email parse_currency repair_text split_name standardize_date standardize_phone""",
        joins: "lookup map_values normalize_address update_by_key",
        dedup: "dedup distinct_values duplicate_groups duplicate_summary merge_duplicates",
        reshape: "grouped pivot unpivot",
        diff: "row_diff schema_diff",
        fuzzy: "fingerprint_clusters merge_clusters near_clusters near_match near_pairs",
        times: "resolve_zones to_zone",
        charts: "daily_counts dual_measure frequencies histogram labels map_points timeline zscore_top",
        profile: "column_stats health_columns schema_listing top_values",
        console: "sql",
        enrich: "enrich",
    }.items()
    for name in names.split()
}

# Steps that look at one row at a time, so they also run on a stream.
ROW_WISE = frozenset(
    """
    rename reorder drop_columns hide_columns normalize_headers mainframe_names rename_from_copybook formula
    conditional change_case trim_text mask fill_empty cast_column split_column regex_extract convert_unit search
    apply_rules geo_box with_coordinates around standardize_date split_name check_email parse_currency
    standardize_phone repair_text unpivot map_values
    """.split()
)
# Of these, steps that look at all rows first unless one of some arguments is given.
NEEDS_ARGUMENT = {"standardize_date": ("fmt",), "split_column": ("n", "names")}


def find(name: str):
    """The operator or reader with this name."""
    if name in LOADERS:
        return LOADERS[name]
    if name not in OPERATORS:
        raise ValueError(f"no operator {name!r}")
    return OPERATORS[name]


@dataclass
class Step:
    op: str
    args: dict[str, Any] = field(default_factory=dict)
    kind: str = "TRANSFORM"
    description: str = ""
    at: str = ""


class Recipe:
    """Steps in order: a whole session, from loading on.

    An argument ``{"table": "name"}`` stands for a table given at replay, ``{"function": "name"}`` for a function (that of
    ``enrich``). A reader can only be the first step; its kind is ``LOAD``.
    """

    def __init__(self, steps: list[Step] | None = None, source: str = ""):
        self.steps = list(steps or [])
        self.source = source

    def add(self, op: str, /, *, step_kind: str = "TRANSFORM", description: str = "", **args: Any) -> Recipe:
        """A new recipe with one more step."""
        find(op)
        step_kind = "LOAD" if op in LOADERS else step_kind
        if step_kind not in KINDS:
            raise ValueError(f"step_kind must be one of {', '.join(KINDS)}")
        if (step_kind == "LOAD") != (op in LOADERS) or op in LOADERS and self.steps:
            raise ValueError("a LOAD step names a reader and comes first")
        now = dt.datetime.now(dt.timezone.utc).isoformat(timespec="seconds")
        return Recipe([*self.steps, Step(op, args, step_kind, description or op, now)], self.source)

    def apply(
        self, df: DataFrame | SparkSession, tables: Mapping[str, DataFrame] | None = None,
        functions: Mapping[str, Callable] | None = None,
    ) -> DataFrame:
        """Replay all steps on ``df``; a recipe that loads its table takes the session instead."""
        named = {"table": tables or {}, "function": functions or {}}
        for step in self.steps:
            args = {k: self._resolve(v, named) for k, v in step.args.items()}
            if step.op in LOADERS:
                spark = df if isinstance(df, SparkSession) else df.sparkSession
                df = LOADERS[step.op](spark, **args)
            else:
                df = df.transform(find(step.op), **args)
        return df

    @staticmethod
    def _resolve(value: Any, named: Mapping[str, Mapping[str, Any]]) -> Any:
        if isinstance(value, dict) and len(value) == 1 and next(iter(value)) in named:
            (kind, name), = value.items()
            if name not in named[kind]:
                raise ValueError(f"the recipe needs the {kind} {name!r}")
            return named[kind][name]
        return value

    def row_wise(self) -> bool:
        """True when every step, with its arguments, looks at one row at a time."""
        return all(
            step.op in ROW_WISE
            and (step.op not in NEEDS_ARGUMENT or any(step.args.get(a) is not None for a in NEEDS_ARGUMENT[step.op]))
            for step in self.steps
        )

    def to_json(self) -> str:
        return json.dumps({"source": self.source, "steps": [asdict(s) for s in self.steps]}, ensure_ascii=False)

    @classmethod
    def from_json(cls, text: str) -> Recipe:
        saved = json.loads(text)
        return cls([Step(**step) for step in saved["steps"]], saved.get("source", ""))
