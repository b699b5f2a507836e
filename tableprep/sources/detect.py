"""Encoding, delimiter and format of text files, and rows with a wrong number of fields."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tableprep.functions.text import quoted
from tableprep.scratch import written
from tableprep.session import allow_java_charsets

# Delimiters that are tried, in the order in which ties are decided.
DELIMITERS = (",", ";", "\t", "|")
# Different first lines that are compared on the driver.
MAX_HEADERS = 1000


def _decoded(line: Column, encoding: str) -> Column:
    return line if encoding.upper() in ("UTF-8", "UTF8") else F.decode(line.cast("binary"), encoding)


def _lines(spark: SparkSession, path: str, encoding: str = "UTF-8") -> DataFrame:
    allow_java_charsets(spark)
    return spark.read.text(path).select(_decoded(F.col("value"), encoding).alias("value"))


def detect_encoding(spark: SparkSession, path: str) -> str:
    """``UTF-8`` if every line is valid UTF-8, else ``windows-1252`` (one pass over all lines)."""
    damaged = spark.read.text(path).where(~F.is_valid_utf8("value"))
    return "UTF-8" if damaged.isEmpty() else "windows-1252"


def delimiter_scores(spark: SparkSession, path: str, encoding: str = "UTF-8") -> DataFrame:
    """Score of each delimiter over all lines that are not empty.

    ``score`` is 10 times the mean number of fields less 100 times its variance.
    """
    return score_delimiters(_lines(spark, path, encoding).where("value <> ''"))


def score_delimiters(lines: DataFrame) -> DataFrame:
    """:func:`delimiter_scores` for a table of lines (column ``value``)."""
    scored = lines.agg(F.array(*_delimiter_sums(F.col("value"))).alias("rows")).select(F.inline("rows"))
    return scored.withColumn("score", _score(F.col("avg_columns"), F.col("variance")))


def _delimiter_sums(line: Column) -> list[Column]:
    return [
        F.struct(
            F.lit(i).alias("rank"), F.lit(d).alias("delimiter"), F.avg(_fields(line, d)).alias("avg_columns"),
            F.var_pop(_fields(line, d)).alias("variance"),
        )
        for i, d in enumerate(DELIMITERS)
    ]


def _score(avg_columns, variance):
    return avg_columns * 10 - variance * 100


@dataclass(frozen=True)
class TextInfo:
    """What one pass over all lines of delimited files tells."""

    encoding: str
    delimiter: str
    #: Some lines have an odd number of quotes: a quoted value goes on in the next line, or a quote is not closed.
    quoted_breaks: bool
    #: In some file the number of such lines is odd, so a quote is not closed.
    open_quote: bool


def inspect_delimited(spark: SparkSession, path: str) -> TextInfo:
    """Encoding, delimiter and line breaks inside quotes, in one aggregation over all lines.

    Delimiters and quotes are ASCII, so lines are measured before they are decoded.
    """
    value = F.col("value")
    bare = F.length(value) - F.length(F.replace(value, F.lit('"'), F.lit("")))
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), "value")
    filled = F.when(value != "", value)
    sums = [
        F.struct(F.count(_fields(filled, d)).alias("n"), F.sum(_fields(filled, d).cast("double")).alias("s"),
                 F.sum(F.pow(_fields(filled, d), 2)).alias("q")).alias(f"d{i}")
        for i, d in enumerate(DELIMITERS)
    ]
    by_file = lines.groupBy("file").agg(
        F.max((~F.is_valid_utf8(value)).cast("int")).alias("damaged"), F.sum(bare % 2).alias("odd"), *sums
    )
    totals = [F.sum(f"d{i}.{part}").alias(f"{part}{i}") for i in range(len(DELIMITERS)) for part in "nsq"]
    row = by_file.agg(
        F.max("damaged").alias("damaged"), F.max("odd").alias("odd"), F.max(F.col("odd") % 2).alias("open"), *totals
    ).first()
    best, delimiter = 0.0, ","
    for i, d in enumerate(DELIMITERS):
        n = row[f"n{i}"] or 0
        mean = row[f"s{i}"] / n if n else 0.0
        score = _score(mean, max(row[f"q{i}"] / n - mean * mean, 0.0)) if n else 0.0
        if mean > 1 and score > best:
            best, delimiter = score, d
    return TextInfo("windows-1252" if row.damaged else "UTF-8", delimiter, bool(row.odd), bool(row.open))


def headers(spark: SparkSession, path: str, encoding: str = "UTF-8") -> dict[str, list[str]]:
    """The different first lines of the files and the paths of the files that begin with each.

    One row for each file comes to the driver only when there are several first lines.
    """
    allow_java_charsets(spark)
    lines = (
        spark.read.text(path)
        .select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))
        .where("block = 0")
        .select("file", "value", F.monotonically_increasing_id().alias("at"))
    )
    line = _decoded(F.rtrim(F.min_by("value", "at"), F.lit("\r")), encoding)
    first = written(lines.groupBy("file").agg(line.alias("line")), "headers")
    different = [row.line for row in first.select("line").distinct().limit(MAX_HEADERS + 1).collect()]
    if len(different) > MAX_HEADERS:
        raise ValueError(f"the files have more than {MAX_HEADERS} different first lines")
    if len(different) == 1:
        return {different[0]: [path]}
    found: dict[str, list[str]] = {line: [] for line in different}
    for row in first.orderBy("file").collect():
        found[row.line].append(unquote(row.file))
    return found


def _fields(line: Column, delimiter: str) -> Column:
    return F.size(F.split(line, quoted(delimiter), -1))


def _fields_outside_quotes(line: Column, delimiter: str) -> Column:
    """Fields of a line: everything but the delimiters outside quotes goes, and what is left is measured."""
    if len(delimiter) != 1 or delimiter == '"':
        raise ValueError("the delimiter must be one character and no quote")
    escaped = delimiter if delimiter.isalnum() else "\\" + delimiter
    left = F.regexp_replace(line, f'"[^"]*"|[^{escaped}"]+|"', "")
    return F.octet_length(left) + 1 if delimiter.isascii() else F.length(left) + 1


def detect_delimiter(spark: SparkSession, path: str, encoding: str = "UTF-8") -> str:
    """The best delimiter over all lines; a comma when none gives more than one field."""
    usable = delimiter_scores(spark, path, encoding).where("avg_columns > 1 and score > 0")
    best = usable.orderBy(F.desc("score"), "rank").first()
    return best["delimiter"] if best else ","


def detect_format(spark: SparkSession, path: str) -> str:
    """``JSON`` if the first line that is not blank starts with a bracket or brace, else ``CSV``."""
    first = spark.read.text(path).where(F.trim("value") != "").first()
    return "JSON" if first and first[0].lstrip("﻿ \t")[:1] in ("[", "{") else "CSV"


def detect_newline(spark: SparkSession, path: str) -> str:
    """The line end of most lines: ``\\r\\n``, ``\\r`` or ``\\n``.

    Lines end at any of the three, and of each is known whether a carriage return comes before the next line feed:
    so no file is ever one row.
    """
    ends = spark.read.option("lineSep", "\r").text(path).select(
        F.startswith("value", F.lit("\n")).alias("with_feed"),
        (F.length("value") - F.length(F.replace("value", F.lit("\n"), F.lit("")))).alias("feeds"),
    )
    found = ends.agg(
        F.count("*").alias("rows"), F.sum(F.col("with_feed").cast("int")).alias("both"), F.sum("feeds").alias("feeds")
    ).first()
    both, feeds = found.both or 0, found.feeds or 0
    alone, returns = feeds - both, max(found.rows - 1, 0) - both
    if not (both or returns > alone):
        return "\n"
    return "\r\n" if both >= max(returns, alone) else "\r" if returns > alone else "\n"


def file_info(spark: SparkSession, path: str) -> DataFrame:
    """Name, size and time of change of the files; their content is not read."""
    files = spark.read.format("binaryFile").load(path)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("size"), "modificationTime")


def jagged_rows(spark: SparkSession, path: str, sep: str | None = None, encoding: str = "UTF-8") -> DataFrame:
    """Lines whose number of fields differs from the first line of their file.

    Columns ``file``, ``row`` (from 1, blank lines not counted), ``expected``, ``actual`` and
    ``content`` (50 characters). All lines are read, and the bad ones written. Delimiters inside quotes
    do not count; a quoted line break does, as a new line.
    """
    allow_java_charsets(spark)
    sep = sep or detect_delimiter(spark, path, encoding)
    # Quotes, delimiters and blanks are ASCII, so the lines are counted as they are; only the text shown
    # is decoded.
    lines = (
        spark.read.text(path)
        .select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))
        .where(F.btrim("value", F.lit(" \t\r")) != "")
        .select("file", "block", "value", F.monotonically_increasing_id().alias("at"))
    )
    width = _fields_outside_quotes(F.col("value"), sep)
    # Line numbers without a global sort: ids rise within a block, and the few block sizes add up.
    blocks = lines.groupBy("file", "block").agg(
        F.count("*").alias("n"), F.min("at").alias("first_at"),
        F.min_by(F.when(F.col("block") == 0, width), "at").alias("width"),
    )
    with same_splits(spark):
        # Written, so Spark knows its size when it chooses the join.
        starts = written(_block_starts(blocks), "blocks")
        found = lines.withColumn("actual", width).join(starts, ["file", "block"]).where("actual <> expected")
        text = _decoded(F.rtrim("value", F.lit("\r")), encoding)
        shown = F.concat(F.substring(text, 1, 50), F.when(F.length(text) > 50, "...").otherwise(""))
        jagged = found.select(
            F.element_at(F.split("file", "/"), -1).alias("file"),
            (F.col("at") - F.col("first_at") + F.col("before") + 1).alias("row"),
            "expected", "actual", shown.alias("content"),
        )
        return written(jagged, "jagged")


@contextmanager
def same_splits(spark: SparkSession) -> Iterator[None]:
    """Two scans of the same files cut them at the same places, though executors come and go."""
    name = "spark.sql.files.minPartitionNum"
    if spark.conf.get(name, None):
        yield
        return
    spark.conf.set(name, str(spark.sparkContext.defaultParallelism))
    try:
        yield
    finally:
        spark.conf.unset(name)


def _block_starts(blocks: DataFrame) -> DataFrame:
    """Lines before each block of a file, and the width of the file's first line."""
    earlier = "partition by file order by block rows between unbounded preceding and 1 preceding"
    return blocks.selectExpr(
        "file", "block", "first_at",
        f"coalesce(sum(n) over ({earlier}), 0) as before",
        "first(width) over (partition by file order by block) as expected",
    )
