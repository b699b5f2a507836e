"""Dates, names, emails, amounts, phone numbers and damaged text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tableprep.functions.dates import DATE_FORMATS, iso_date, matches_format
from tableprep.functions.phones import first_valid, readings
from tableprep.functions.text import parse_amount, repair_damage

# What counts as an email address, and the part after the "@".
EMAIL = r"^[\w\.-]+@[\w\.-]+\.[\w\.-]+\z"
EMAIL_DOMAIN = r"@([\w\.-]+)\z"


def date_format_scores(df: DataFrame, col: str) -> DataFrame:
    """For each known format, the number of values that are dates in it (one pass, all rows).

    Values of four characters or fewer do not count. The best format comes first.
    """
    text = df[col].cast("string")
    counted = F.when(F.length(text) > 4, text)
    sums = [F.count_if(matches_format(counted, fmt)).alias(fmt) for fmt in DATE_FORMATS]
    scored = df.agg(*sums).select(
        F.posexplode(
            F.array(*[F.struct(F.lit(f).alias("format"), F.col(f"`{f}`").alias("matches")) for f in DATE_FORMATS])
        ).alias("rank", "score")
    )
    return scored.select("rank", "score.format", "score.matches").orderBy(F.desc("matches"), "rank")


def standardize_date(df: DataFrame, col: str, fmt: str | None = None, flag: bool = False) -> DataFrame:
    """Rewrite dates as ``yyyy-MM-dd``; without ``fmt`` the best known format is used.

    A value that is no date stays as it is; ``flag`` adds ``<col>_parsed``.
    """
    if fmt is None:
        best = date_format_scores(df, col).first()
        fmt = best["format"] if best["matches"] else None
    text = df[col].cast("string")
    iso = F.lit(None).cast("string") if fmt is None else iso_date(text, fmt)
    result = {col: F.coalesce(iso, text)}
    if flag:
        result[f"{col}_parsed"] = iso.isNotNull()
    return df.withColumns(result)


def split_name(df: DataFrame, col: str, order: str = "first_last") -> DataFrame:
    """Add ``<col>_prenom`` (first name) and ``<col>_nom`` (last name), split at single spaces.

    ``order`` says which comes first in the text; the rest goes to the other column.
    """
    words = F.split(df[col], " ", -1)
    head = F.get(words, F.lit(0))
    rest = F.array_join(F.slice(words, F.lit(2), F.size(words)), " ")
    if order not in ("first_last", "last_first"):
        raise ValueError("order must be 'first_last' or 'last_first'")
    first, last = (head, rest) if order == "first_last" else (rest, head)
    return df.withColumns({f"{col}_prenom": first, f"{col}_nom": last})


def check_email(df: DataFrame, col: str, flag: bool = True, domain: bool = True) -> DataFrame:
    """Add ``<col>_valide`` (boolean) and ``<col>_domaine`` (empty when there is none)."""
    added = {}
    if flag:
        added[f"{col}_valide"] = df[col].rlike(EMAIL)
    if domain:
        added[f"{col}_domaine"] = F.regexp_extract(df[col], EMAIL_DOMAIN, 1)
    return df.withColumns(added) if added else df


def parse_currency(df: DataFrame, col: str, decimal: str = ".") -> DataFrame:
    """Add ``<col>_num``: the amount as a double, NULL for text without a number."""
    return df.withColumn(f"{col}_num", parse_amount(df[col], decimal))


def standardize_phone(df: DataFrame, col: str, country: str = "FR", flag: bool = False, kind: bool = False) -> DataFrame:
    """Valid numbers in E.164 form, others unchanged.

    ``flag`` adds ``<col>_is_valid``, ``kind`` adds ``<col>_kind`` (fixed, mobile, free, ..., NULL when not valid).
    """
    # A column of its own, so that each text is read once for all that is told about it.
    read = df.withColumn("__phone", readings(df[col], country)).withColumn("__phone", first_valid("__phone"))
    number = F.col("__phone.e164")
    result = {col: F.coalesce(number, read[col].cast("string"))}
    if flag:
        result[f"{col}_is_valid"] = number.isNotNull()
    if kind:
        result[f"{col}_kind"] = F.col("__phone.kind")
    return read.withColumns(result).drop("__phone")


def repair_text(df: DataFrame, col: str, aggressive: bool = False) -> DataFrame:
    """Undo double-encoded characters; ``aggressive`` also turns a lone ``Ã`` into ``À``."""
    return df.withColumn(col, repair_damage(df[col], aggressive))
