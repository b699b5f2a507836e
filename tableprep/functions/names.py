"""Rules that turn one column name into another."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable

# Words that a loader must not use as a bare column name.
RESERVED_WORDS = frozenset(
    """
    all analyse analyze and any array as asc asymmetric both case cast check collate column
    constraint create default deferrable desc describe distinct do else end except false fetch
    for foreign from group having in initially intersect into lambda lateral leading limit not
    null offset on only or order pivot pivot_longer pivot_wider placing primary qualify
    references returning select show some summarize symmetric table then to trailing true union
    unique unpivot using variadic when where window with
    """.split()
)


def number_repeats(names: Iterable[str], max_len: int | None = None) -> list[str]:
    """Make names unique (ignoring case) by appending ``_1``, ``_2``...; never longer than max_len."""
    used: set[str] = set()
    result = []
    for name in names:
        candidate, n = name, 0
        while candidate.lower() in used:
            n += 1
            suffix = f"_{n}"
            keep = None if max_len is None else max_len - len(suffix)
            candidate = name[:keep] + suffix
        used.add(candidate.lower())
        result.append(candidate)
    return result


def normalize_names(names: Iterable[str]) -> list[str]:
    """Header names as plain identifiers: no accents, lower case, ``_`` between words."""
    plain = []
    for name in names:
        folded = unicodedata.normalize("NFKD", name or "")
        folded = "".join(ch for ch in folded if not unicodedata.combining(ch))
        word = re.sub(r"[^0-9a-z]+", "_", folded.lower()).strip("_") or "col"
        if word in RESERVED_WORDS or word[0].isdigit():
            word = "_" + word
        plain.append(word)
    return number_repeats(plain)


def mainframe_name(name: str, max_len: int = 10) -> str:
    """Upper case, ``A-Z0-9_`` only; a name that is too long loses its ``_`` and is then cut."""
    word = re.sub(r"[^A-Z0-9]", "_", name.upper())
    if len(word) > max_len:
        word = word.replace("_", "")[:max_len]
    return word


def copybook_names(text: str) -> list[str]:
    """Field names from a copybook or a plain list, one per non-blank line.

    A leading level number (``05 NAME PIC X(10)``) is skipped.
    """
    names = []
    for line in text.splitlines():
        words = line.split()
        if not words:
            continue
        leading_level = len(words) > 1 and re.fullmatch(r"\d+", words[0])
        names.append(words[1] if leading_level else words[0])
    return names
