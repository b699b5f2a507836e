"""Text expressions; all of them are built-in Spark functions, so they stay in generated code."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F



def _accents() -> tuple[str, str]:
    """Lower-case Latin letters with marks and the letters they are built on, by their decomposition."""
    pairs = [(chr(c), unicodedata.normalize("NFD", chr(c))[0]) for c in (*range(0xE0, 0x250), *range(0x1E00, 0x1F00))]
    pairs = [(letter, plain) for letter, plain in pairs if plain.isascii() and plain.islower()]
    return "".join(p[0] for p in pairs), "".join(p[1] for p in pairs)


ACCENTED, FOLDED = _accents()

# UTF-8 text that was once read as Latin-1, and the text meant.
DAMAGED_LATIN1 = {
    "Ã©": "é", "Ã ": "à", "Ã¨": "è", "Ã¹": "ù", "Ã¢": "â",
    "Ãª": "ê", "Ã®": "î", "Ã´": "ô", "Ã»": "û", "Ã«": "ë",
    "Ã¯": "ï", "Ã¼": "ü", "Ã§": "ç", "Ã\u0089": "É", "Ã\u008a": "Ê",
    "Â°": "°", "â\u0082¬": "€", "â\u0080\u0099": "'",
    "â\u0080\u0093": "–", "â\u0080\u0094": "—",
}
# The same damage when the reader used windows-1252.
DAMAGED_CP1252 = {
    "Ã‰": "É", "ÃŠ": "Ê", "â‚¬": "€", "â€™": "'",
    "â€“": "–", "â€”": "—", "Ã ": "à",
}
# Fixed value: a letter that stands alone once all longer forms are repaired.
DAMAGED_ALONE = {"Ã": "À"}

# The characters of windows-1252 outside ASCII and Latin-1.
CP1252_EXTRA = "€‚ƒ„…†‡ˆ‰Š‹ŒŽ‘’“”•–—˜™š›œžŸ"
NOT_CP1252 = "[^\\x00-\\x7F\\xA0-\\xFF" + CP1252_EXTRA + "]"
NOT_LATIN1 = "[^\\x00-\\x7F\\xA0-\\xFF]"


def like_pattern(text: str, before: str = "%", after: str = "%") -> str:
    """A LIKE pattern in which ``%`` and ``_`` stay wildcards and a backslash is itself."""
    return before + text.replace("\\", "\\\\") + after


def contains_text(column: Column, text: str, literal: bool = False) -> Column:
    """Case-insensitive "contains" on any type."""
    value = column.cast("string")
    if literal:
        return F.contains(F.lower(value), F.lower(F.lit(text)))
    return value.ilike(like_pattern(text))


def quoted(text: str) -> str:
    """A Java regular expression that matches ``text`` itself."""
    return "\\Q" + text.replace("\\E", "\\E\\\\E\\Q") + "\\E"


def end_of_text(pattern: str) -> str:
    """Let a closing ``$`` mean the very end; Java also accepts it before a last newline."""
    if not pattern.endswith("$"):
        return pattern
    body = pattern[:-1]
    backslashes = len(body) - len(body.rstrip("\\"))
    return pattern if backslashes % 2 else body + "\\z"


def repair_damage(column: Column, aggressive: bool = False) -> Column:
    """Undo double-encoded text; longer damaged forms are replaced before shorter ones.

    Forms are grouped by their first letter, and a group is skipped in values without that letter. The
    longest forms start with ``â``; no repair brings up a letter of a later group.
    """
    pairs = {**DAMAGED_LATIN1, **DAMAGED_CP1252, **(DAMAGED_ALONE if aggressive else {})}
    repaired = column
    for first in "âÂÃ":
        undone = repaired
        for bad in sorted((form for form in pairs if form[0] == first), key=len, reverse=True):
            undone = F.replace(undone, F.lit(bad), F.lit(pairs[bad]))
        repaired = F.when(F.contains(column, F.lit(first)), undone).otherwise(repaired)
    return repaired


def parse_amount(column: Column, decimal: str = ".") -> Column:
    """A number from text such as ``1.234,50 €``; NULL when no number is left."""
    if decimal not in (".", ","):
        raise ValueError("decimal must be '.' or ','")
    kept = F.regexp_replace(column.cast("string"), "[^0-9.,\\-]", "")
    if decimal == ",":
        kept = F.replace(F.replace(kept, F.lit("."), F.lit("")), F.lit(","), F.lit("."))
    else:
        kept = F.replace(kept, F.lit(","), F.lit(""))
    return kept.try_cast("double")


def fingerprint(column: Column) -> Column:
    """Lower case without accents or punctuation; words sorted, each once."""
    # Marks of decomposed letters go first, so that they do not cut words.
    folded = F.translate(F.regexp_replace(F.lower(column), "\\p{M}+", ""), ACCENTED, FOLDED)
    words = F.split(F.trim(F.regexp_replace(folded, "[^\\p{L}\\p{N}]+", " ")), " ")
    return F.array_join(F.array_sort(F.array_distinct(words)), " ")


def outside_cp1252(column: Column) -> Column:
    """True when the text has a character that windows-1252 lacks.

    The cheap tests come first: most text is ASCII or Latin-1 throughout.
    """
    ascii_only = F.octet_length(column) == F.char_length(column)
    return ~ascii_only & column.rlike(NOT_LATIN1) & column.rlike(NOT_CP1252)


def cp1252_safe(column: Column) -> Column:
    """Characters that windows-1252 lacks become ``?``."""
    return F.when(outside_cp1252(column), F.regexp_replace(column, NOT_CP1252, "?")).otherwise(column)
