"""Exports. Each writes a folder of part files, in parallel; no row cap, no single-task merge."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tableprep.functions.text import cp1252_safe
from tableprep.session import allow_java_charsets

# Named export settings.
PRESETS = {
    "mainframe": {"format": "csv", "encoding": "windows-1252", "sep": ";", "header": False},
    "json": {"format": "json"},
    "parquet": {"format": "parquet"},
}
DEFAULT_WIDTH = 15
MAX_WIDTH = 100


def _as_text(df: DataFrame, safe: bool) -> list[Column]:
    columns = []
    for field in df.schema:
        text = F.col(field.name)
        if isinstance(field.dataType, (T.ArrayType, T.MapType, T.StructType)):
            text = F.to_json(text)
        text = F.coalesce(text.cast("string"), F.lit(""))
        columns.append((cp1252_safe(text) if safe else text).alias(field.name))
    return columns


def write_delimited(
    df: DataFrame, path: str, sep: str = ",", encoding: str = "UTF-8", header: bool = True, mode: str = "errorifexists"
) -> None:
    """Every value in quotes, ``"`` doubled, NULL as ``""``.

    With windows-1252, characters it lacks become ``?``.
    """
    allow_java_charsets(df.sparkSession)
    text = df.select(*_as_text(df, encoding.lower() in ("windows-1252", "cp1252")))
    options = {
        "sep": sep, "header": header, "quoteAll": True, "escape": '"', "nullValue": "", "emptyValue": "",
        "encoding": encoding, "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False,
    }
    text.write.mode(mode).options(**options).csv(path)


def write_json(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """One object per line; NULL fields are kept."""
    df.write.mode(mode).option("ignoreNullFields", False).json(path)


def write_parquet(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).parquet(path)


def export(df: DataFrame, path: str, preset: str, mode: str = "errorifexists") -> None:
    """Write with the settings of one of :data:`PRESETS`."""
    if preset not in PRESETS:
        raise ValueError(f"preset must be one of {', '.join(PRESETS)}")
    settings = dict(PRESETS[preset])
    write = {"csv": write_delimited, "json": write_json, "parquet": write_parquet}[settings.pop("format")]
    write(df, path, mode=mode, **settings)


def to_fixed_width(df: DataFrame, widths: Mapping[str, int] | None = None, default: int = DEFAULT_WIDTH) -> DataFrame:
    """One column ``line``: each value cut to its width and padded with spaces; NULL is blank.

    Characters that end a line become spaces.
    """
    widths = {c: (widths or {}).get(c, default) for c in df.columns}
    if not all(1 <= w <= MAX_WIDTH for w in widths.values()):
        raise ValueError(f"widths must lie between 1 and {MAX_WIDTH}")
    plain = lambda c: F.regexp_replace(F.coalesce(F.col(c).cast("string"), F.lit("")), r"[\r\n\x0B\x0C\x85\x00\x01\u2028\u2029]", " ")
    padded = [F.rpad(plain(c), w, " ") for c, w in widths.items()]
    return df.select(F.concat(*padded).alias("line"))


def line_width(df: DataFrame, widths: Mapping[str, int] | None = None, default: int = DEFAULT_WIDTH) -> dict:
    """Total line width, and whether it fits 80 and 132 columns."""
    total = sum((widths or {}).get(c, default) for c in df.columns)
    return {"width": total, "fits_80": total <= 80, "fits_132": total <= 132}


def write_fixed_width(
    df: DataFrame, path: str, widths: Mapping[str, int] | None = None, default: int = DEFAULT_WIDTH,
    mode: str = "errorifexists", encoding: str = "UTF-8",
) -> None:
    """Lines of :func:`to_fixed_width`; with windows-1252, where a character is one byte, others become ``?``."""
    lines = to_fixed_width(df, widths, default)
    if encoding.lower() not in ("windows-1252", "cp1252"):
        lines.write.mode(mode).text(path)
        return
    # The delimited writer knows encodings; without quotes and with a character that is not left in any line, it writes lines as they are.
    allow_java_charsets(df.sparkSession)
    options = {
        "encoding": "windows-1252", "header": False, "quote": "", "escape": "", "sep": "\u0001", "emptyValue": "", "nullValue": "",
        "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False,
    }
    lines.select(cp1252_safe(F.col("line")).alias("line")).write.mode(mode).options(**options).csv(path)


def delimited_preview(df: DataFrame, n: int = 5, sep: str = ",", header: bool = True) -> DataFrame:
    """The first ``n`` rows as lines of text (column ``line``), quoted only where needed."""
    needs_quotes = lambda text: F.contains(text, F.lit(sep)) | F.contains(text, F.lit('"'))
    double = lambda text: F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))
    text = df.limit(n).select(*_as_text(df, safe=False))
    shown = [F.when(needs_quotes(F.col(c)), double(F.col(c))).otherwise(F.col(c)) for c in text.columns]
    lines = text.select(F.concat_ws(sep, *shown).alias("line"))
    if not header:
        return lines
    head = df.sparkSession.createDataFrame([(sep.join(df.columns),)], "line string")
    return head.unionAll(lines)
