"""Delimited, JSON, fixed-width and Parquet files."""

from __future__ import annotations

import csv
import io
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tableprep.functions.names import normalize_names
from tableprep.scratch import written
from tableprep.session import allow_java_charsets
from tableprep.sources.detect import detect_format, detect_newline, headers, inspect_delimited
from tableprep.sources.records import split_array, split_delimited

CORRUPT = "_corrupt_record"


def read_delimited(
    spark: SparkSession,
    path: str,
    sep: str | None = None,
    encoding: str | None = None,
    bad_rows: str = "raise",
    schema: T.StructType | None = None,
    header: bool = True,
    normalize: bool = True,
    multiline: bool | None = None,
) -> DataFrame:
    """Text with a delimiter; what is not given is detected, types included.

    Rows with too few or too many fields, or with a value of another type, are bad: ``raise`` fails when
    one is read, ``keep`` adds ``_corrupt_record`` with their text (NULL in good rows), ``only`` returns
    just the bad ones, ``drop`` leaves them out.

    Files that order their columns differently are read by name; files with other columns raise.
    ``multiline`` accepts line breaks inside quotes. All tasks look for the records of such files (see
    :mod:`tableprep.sources.records`), which are read twice and written once to the shared folder. If it is not given, it
    is on when lines have quotes that the next line closes; then a quote that is never closed raises.

    Detection reads the files once for encoding, delimiter and quotes, the first lines once, and once
    for the types: for large inputs give ``sep``, ``encoding``, ``multiline`` and ``schema``.
    """
    if bad_rows not in ("raise", "drop", "keep", "only"):
        raise ValueError("bad_rows must be 'raise', 'drop', 'keep' or 'only'")
    if None in (sep, encoding, multiline):
        info = inspect_delimited(spark, path)
        sep, encoding = sep or info.delimiter, encoding or info.encoding
        detected = multiline is None
        multiline = info.quoted_breaks if detected else multiline
    else:
        detected = False
    allow_java_charsets(spark)
    split = split_delimited(spark, path, sep, encoding, header) if multiline and detect_newline(spark, path) != "\r" else None
    if detected and (split.open_quote if split else multiline and info.open_quote):
        raise ValueError("a quote is not closed; give multiline=False to read such lines one by one, or True")
    # Without column pruning each row is parsed in full, so bad rows are found in every query.
    options = {
        "header": header, "sep": sep, "encoding": encoding, "quote": '"', "escape": '"', "columnPruning": False,
        "multiLine": multiline,
    }
    if split:
        groups = {line: [folder] for line, folder in split.folders.items()}
        options |= {"header": False, "encoding": "UTF-8", "multiLine": False, "lineSep": split.separator}
        if len(groups) == 1 and schema is None:
            [(line, files)] = groups.items()
            schema = _schema(spark, files, options, None if line is None else _safe_names(spark, line, sep))
    else:
        groups = {"": [path]} if not header else headers(spark, path, encoding)
    if len(groups) <= 1:
        files = next(iter(groups.values())) if split else [path]
        return _read_files(spark, files, options, schema, None, normalize, bad_rows)
    names = {line: next(csv.reader(io.StringIO(line, newline=""), delimiter=sep)) for line in groups}
    first = next(iter(names.values()))
    if any(sorted(n) != sorted(first) for n in names.values()) or len(set(first)) < len(first):
        raise ValueError(f"the files have different columns: {sorted(map(sorted, names.values()))[:3]}")
    if schema is not None and len(schema) != len(first):
        raise ValueError(f"the schema has {len(schema)} columns, the files have {len(first)}")
    if schema is None:
        found = [_schema(spark, files, options, names[line] if split else None) for line, files in groups.items()]
        types = {n: {s[n].dataType.simpleString() for s in found} for n in first}
        # A type that all files agree on, else text.
        schema = T.StructType([T.StructField(n, found[0][n].dataType if len(types[n]) == 1 else T.StringType()) for n in first])
    else:
        schema = T.StructType([T.StructField(n, f.dataType) for n, f in zip(first, schema)]) if normalize else schema
    parts = [_read_files(spark, files, options, schema, names[line], normalize, bad_rows) for line, files in groups.items()]
    return reduce(DataFrame.unionByName, parts)


def _schema(spark: SparkSession, files: list[str], options: dict, names: list[str] | None) -> T.StructType:
    """The types found in files; ``names`` are those of a header that the files do not hold themselves."""
    found = spark.read.options(inferSchema=True, **options).csv(files).schema
    if names is None:
        return found
    types = [f.dataType for f in found.fields] + [T.StringType()] * len(names)
    return T.StructType([T.StructField(n, t) for n, t in zip(names, types)])


def _safe_names(spark: SparkSession, line: str, sep: str) -> list[str]:
    """The names that Spark gives to the columns of a file with this header."""
    options = {"header": True, "sep": sep, "quote": '"', "escape": '"', "lineSep": "\x1e"}
    return spark.read.options(**options).csv(spark.sparkContext.parallelize([line], 1)).columns


def _read_files(spark, files, options, schema, order, normalize, bad_rows) -> DataFrame:
    """Files with one header; ``order`` names their columns, where it is not the order of ``schema``."""
    if schema is None:
        schema = spark.read.options(inferSchema=True, **options).csv(files).schema
    fields = schema.fields if order is None else [schema[name] for name in order]
    if normalize:
        # Repeats are numbered in the order of the schema, whatever that of the file.
        plain = dict(zip(schema.names, normalize_names(schema.names)))
        names = normalize_names(schema.names) if order is None else [plain[f.name] for f in fields]
        fields = [T.StructField(n, f.dataType, True) for n, f in zip(names, fields)]
    schema = T.StructType(fields)
    reader = spark.read.options(**options)
    if bad_rows in ("raise", "drop"):
        return reader.option("mode", "FAILFAST" if bad_rows == "raise" else "DROPMALFORMED").schema(schema).csv(files)
    marked = T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType())])
    rows = reader.options(mode="PERMISSIVE", columnNameOfCorruptRecord=CORRUPT).schema(marked).csv(files)
    # Written, because Spark refuses some queries on the corrupt text of a raw file.
    return rows if bad_rows == "keep" else written(rows.where(F.col(CORRUPT).isNotNull()), "bad")


def read_json(spark: SparkSession, path: str, multiline: bool = False, schema: T.StructType | None = None) -> DataFrame:
    """One object per line, or with ``multiline`` arrays of objects, one or several in a file.

    All tasks look for the objects of an array (see :mod:`tableprep.sources.records`): the files are read twice and written once to
    the shared folder as lines. Other multi-line files, with one object each, are read by one task each.
    """
    if multiline and (folder := split_array(spark, path)):
        multiline, path = False, folder
    reader = spark.read.option("multiLine", multiline)
    return (reader.schema(schema) if schema else reader).json(path)


def read_fixed_width(
    spark: SparkSession, path: str, fields: Sequence[tuple[str, int] | tuple[str, int, str]], encoding: str = "UTF-8"
) -> DataFrame:
    """Lines of fixed-width fields ``(name, width[, type])``; spaces at the right are removed."""
    allow_java_charsets(spark)
    line = F.col("value") if encoding.upper() in ("UTF-8", "UTF8") else F.decode(F.col("value").cast("binary"), encoding)
    columns, start = [], 1
    for name, width, *dtype in fields:
        text = F.rtrim(F.substring(line, start, width))
        if dtype and dtype[0] != "string":
            text = F.nullif(F.trim(text), F.lit("")).try_cast(dtype[0])
        columns.append(text.alias(name))
        start += width
    return spark.read.text(path).select(*columns)


def read_any(spark: SparkSession, path: str) -> DataFrame:
    """Parquet by its suffix; other files by what their first line looks like."""
    if path.rstrip("/").endswith(".parquet"):
        return spark.read.parquet(path)
    if detect_format(spark, path) == "JSON":
        first = spark.read.text(path).where(F.trim("value") != "").first()[0]
        return read_json(spark, path, multiline=first.lstrip("﻿ \t").startswith("["))
    return read_delimited(spark, path)
