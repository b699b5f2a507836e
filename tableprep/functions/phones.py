"""Phone numbers in E.164 form, by the numbering plans of six countries.

A number is valid when the longest prefix of its national part in the country's plan is in use and allows its length.
The plans tell ranges apart as far as the regulators' overviews do, not every block that was handed out.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Calling code, international prefix, trunk prefix, shape of the national number.
COUNTRIES = {
    "FR": ("33", "00", "0", "[1-9][0-9]{8}"),
    "US": ("1", "011", "1", "[2-9][0-9]{2}[2-9][0-9]{6}"),
    "GB": ("44", "00", "0", "[1-9][0-9]{6,9}"),
    "DE": ("49", "00", "0", "[1-9][0-9]{4,13}"),
    "CH": ("41", "00", "0", "[1-9][0-9]{8}"),
    "ES": ("34", "00", "", "[5-9][0-9]{8}"),
}

# Kind, digits of the national number (least, most), prefixes. The longest prefix counts; kind "" is not in use.
PLANS = {
    "FR": [
        ("fixed", 9, 9, "1 2 3 4 5"), ("", 9, 9, "262 40 590 594"), ("mobile", 9, 9, "6 73 74 75 76 77 78 79"), ("", 9, 9, "639 690 691 692 693 694 696 697"),
        ("free", 9, 9, "80"), ("shared", 9, 9, "81 82 84 88"), ("premium", 9, 9, "83 85 86 89"), ("voip", 9, 9, "9"),
    ],
    "US": [
        ("fixed or mobile", 10, 10, "2 3 4 5 6 7 8 9"), ("", 10, 10, "211 311 411 511 611 711 811 911"), ("", 10, 10, "29 37 39 49 59 69 79 89 96 99"),
        ("free", 10, 10, "800 833 844 855 866 877 888"), ("premium", 10, 10, "900"), ("personal", 10, 10, "500 521 522 533 544 566 577 588"),
        ("", 10, 10, "822 880 881 882 883 884 885 886 887"),
    ],
    "GB": [
        ("fixed", 9, 10, "1"), ("", 9, 10, "10 110 111 112 119"), ("fixed", 10, 10, "20 23 24 28 29"), ("company", 10, 10, "30 33 34 37"),
        ("free", 9, 9, "500"), ("voip", 10, 10, "55 56"), ("personal", 10, 10, "70"), ("mobile", 10, 10, "71 72 73 74 75 77 78 79 7624"),
        ("pager", 10, 10, "76"), ("free", 9, 10, "800"), ("free", 7, 7, "8001111"), ("free", 10, 10, "808"), ("shared", 10, 10, "84 87"),
        ("premium", 10, 10, "90 91 98"),
    ],
    "DE": [
        ("fixed", 6, 11, "2 3 4 5 6 7 8 9"), ("fixed", 5, 11, "30 40 69 89"), ("", 6, 11, "310 311"), ("mobile", 11, 11, "15"),
        ("mobile", 10, 10, "160 162 163 170 171 172 173 174 175 177 178"), ("mobile", 10, 11, "176 179"), ("pager", 9, 14, "164 168 169"),
        ("shared", 7, 14, "180"), ("voip", 9, 12, "32"), ("personal", 11, 11, "700"), ("free", 10, 14, "800"), ("premium", 10, 10, "900"),
    ],
    "CH": [
        ("fixed", 9, 9, "21 22 24 26 27 31 32 33 34 41 43 44 52 55 56 61 62 71 81 91"), ("company", 9, 9, "51 58"), ("pager", 9, 9, "74"),
        ("mobile", 9, 9, "75 76 77 78 79"), ("free", 9, 9, "800"), ("shared", 9, 9, "840 842 844 848"), ("personal", 9, 9, "878"),
        ("premium", 9, 9, "900 901 906"),
    ],
    "ES": [
        ("fixed", 9, 9, "81 82 83 84 85 86 87 88 91 92 93 94 95 96 97 98"), ("mobile", 9, 9, "6 71 72 73 74 78 79"), ("voip", 9, 9, "51"),
        ("personal", 9, 9, "70"), ("free", 9, 9, "800 900"), ("shared", 9, 9, "901 902"), ("premium", 9, 9, "803 806 807 905"),
    ],
}


def plan_rows(country: str) -> list[tuple[str, str, int, int]]:
    """The country's plan: prefix, kind, least and most digits of the national number."""
    return [(prefix, kind, least, most) for kind, least, most, prefixes in PLANS[country] for prefix in prefixes.split()]


def _kind_sql(digits: str, country: str) -> str:
    """What a national number (digits, without trunk prefix) is for, as SQL text; NULL when the plan has no such number."""
    by_size: dict[int, dict[tuple[str, int, int], list[str]]] = {}
    for prefix, kind, least, most in plan_rows(country):
        by_size.setdefault(len(prefix), {}).setdefault((kind, least, most), []).append(prefix)
    # The longest prefix comes first and decides, whether it is in use or not.
    cases = " ".join(
        f"WHEN substring({digits}, 1, {size}) IN ('{"', '".join(prefixes)}') THEN "
        + (f"if(length({digits}) BETWEEN {least} AND {most}, '{kind}', NULL)" if kind else "CAST(NULL AS STRING)")
        for size in sorted(by_size, reverse=True) for (kind, least, most), prefixes in by_size[size].items()
    )
    return f"if({digits} RLIKE '^{COUNTRIES[country][3]}$', CASE {cases} END, NULL)"


def readings(column: Column, country: str = "FR") -> Column:
    """The readings of a text as a calling code and a national number, the likeliest first; digits are empty where it has no such reading."""
    if country not in COUNTRIES:
        raise ValueError(f"country must be one of {', '.join(COUNTRIES)}")
    code, prefix, trunk, _ = COUNTRIES[country]
    # Spaces and the signs that numbers are grouped with.
    compact = F.translate(column.cast("string"), " \t\n\x0b\f\r().-/\xa0", "")
    # "+33 (0)6..." keeps a trunk zero that must go.
    plus = F.regexp_replace(F.regexp_replace(compact, f"^{prefix}", "+"), "^\\+(33|44|49|41)0", "+$1")
    # No calling code begins another, so a text has one reading at most as an international number.
    codes = "|".join(digits for digits, *_ in COUNTRIES.values())
    abroad = [F.regexp_extract(plus, f"^\\+({codes})([0-9]+)\\z", k) for k in (1, 2)]
    home = [(F.lit(code), F.regexp_extract(compact, f"^{start}([0-9]+)\\z", 1)) for start in dict.fromkeys([trunk, "", code])]
    return F.array(*(F.struct(c.alias("code"), digits.alias("digits")) for c, digits in (abroad, *home)))


def first_valid(name: str) -> Column:
    """The ``e164`` form and the ``kind`` (fixed, mobile, free, ...) of the first valid one of the :func:`readings` in a column, else NULL."""
    kinds = " ".join(f"WHEN '{code}' THEN {_kind_sql('r.digits', where)}" for where, (code, *_) in COUNTRIES.items())
    judged = f"r -> named_struct('e164', concat('+', r.code, r.digits), 'kind', CASE r.code {kinds} END)"
    return F.expr(f"get(filter(transform(filter({name}, r -> r.digits <> ''), {judged}), r -> r.kind IS NOT NULL), 0)")
