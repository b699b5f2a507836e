"""SQL over a table."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession

_TEXT_AND_COMMENTS = re.compile(r"'(?:[^']|'')*'|\"[^\"]*\"|`[^`]*`|--[^\n]*|/\*.*?\*/", re.S)


def sql(df: DataFrame, text: str, name: str = "current_dataset", **others: DataFrame) -> DataFrame:
    """A query over ``df`` (named ``current_dataset``) and further tables given by name.

    Only ``SELECT`` and ``WITH`` are taken: a table here never changes, a query gives a new one. The names hold for
    this query alone: views of the session keep theirs.
    """
    bare = _TEXT_AND_COMMENTS.sub(" ", text).strip()
    spark, tables = df.sparkSession, {name: df, **others}
    if not re.match(r"\(*\s*(select|with)\b", bare, re.I) or _changes(spark, text):
        raise ValueError("only SELECT or WITH queries are possible")
    held = {view: f"{view}_{uuid.uuid4().hex}" for view in tables}
    for view, table in tables.items():
        table.createOrReplaceTempView(held[view])
    try:
        named = ", ".join(f"`{view}` AS (SELECT * FROM `{own}`)" for view, own in held.items())
        # The tables come first in the query's own list of named tables.
        start = re.match(r"\s*with\b(\s+recursive\b)?", text, re.I)
        head = f"WITH {named}, {text[start.end():]}" if start else f"WITH {named} {text}"
        return spark.sql(head)
    finally:
        for own in held.values():
            spark.catalog.dropTempView(own)


def _changes(spark: SparkSession, text: str) -> bool:
    """Whether Spark parses the text as more than a query."""
    plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(text)
    nodes = plan.toString()
    return bool(re.search(r"(^|\n)[\s:+-]*'?(Insert|Create|Drop|Alter|Delete|Update|Merge|Set|Truncate|Replace|Cache|Load)\w*", nodes))
