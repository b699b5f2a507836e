"""Personal data by proposed spans and boosted trees.

Exact patterns give the base spans of a text. Loose generators propose many more spans, which may overlap; a
boosted-tree model for each kind judges them by their format and context, and a threshold set on examples that
the model has not seen selects those to add. Examples are proposals that the exact patterns decide (a base span of the
kind, or a span that fails the kind's test or is part of another kind's) in a bounded sample of the texts, and
examples made from rules, so that small tables have some too. The features leave out what the exact
patterns ask for where the model is to go beyond them (the plus sign, the bare @).

Cases: a null text is empty and has no spans; texts are searched whole, in time linear in their length;
repeated rows are judged each; an empty table gives an empty one; columns named like the new ones are
replaced. Places count code points, the end is exclusive. Spans that are added overlap no base span and not each other; of
two, the likelier stays, then the longer, then the first.
"""

from __future__ import annotations

import itertools
import re
from bisect import bisect_left
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tableprep.llm.arrow import add_columns, rows_of
from tableprep.llm.boosting import Boosted
from tableprep.scratch import written

KINDS = ("email", "ip", "card", "phone")
SPANS = "array<struct<kind:string,start:int,end:int,base:boolean,score:double>>"

# The exact forms. A lookbehind keeps a search from starting again inside a run that it has left.
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    odd = sum(map(int, digits[-1::-2]))
    return (odd + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])) % 10 == 0


def _emails(text: str) -> list[tuple[int, int]]:
    """Each @ with the run of local characters before it and a domain of two labels or more after it."""
    found, end, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            end = domain.end()
            found.append((start, end))
        at = text.find("@", max(at + 1, end))
    return found


def _only_digits(text: str) -> str:
    return "".join(_DIGIT.findall(text))


def _passes(kind: str, span: str) -> bool:
    if kind == "ip":
        return all(len(part.lstrip("0")) <= 3 and int(part[-3:]) <= 255 for part in span.split("."))
    digits = _only_digits(span)
    return 8 <= len(digits) <= 15 if kind == "phone" else 16 <= len(digits) <= 19 and luhn(digits)


def _matches(kind: str, text: str) -> list[tuple[int, int]]:
    """All places of the exact form, before its test."""
    if kind == "email":
        return _emails(text)
    if kind == "phone" and "+" not in text or not _DIGIT.search(text):
        return []
    return [m.span() for m in {"ip": _IP, "card": _CARD, "phone": _PHONE}[kind].finditer(text)]


def base_spans(text: str) -> dict[str, list[tuple[int, int]]]:
    """The spans that are always personal data, by kind."""
    return {
        kind: [s for s in _matches(kind, text) if kind == "email" or _passes(kind, text[s[0] : s[1]])] for kind in KINDS
    }


# The loose forms: bounded repeats, so that a search takes linear time.
_LOOSE = {
    "email": re.compile(
        r"(?<![\w.%+-])[\w.%+-]{1,64} ?(?:@|\(at\)|\[at\]|\{at\}| at ) ?[\w-]{1,63}"
        r"(?: ?(?:\.|\(dot\)|\[dot\]|\{dot\}| dot ) ?[\w-]{1,63}){1,4}", re.I),
    "ip": re.compile(r"(?<![0-9])[0-9]{1,3}(?: ?(?:\.|\[\.\]|\(\.\)) ?[0-9]{1,3}){3}(?![0-9])"),
    "card": re.compile(r"(?<![0-9])[0-9](?:[ .\-]{0,2}[0-9]){12,18}(?![0-9])"),
    "phone": re.compile(r"(?<![0-9])(?:\+ ?)?\(?[0-9]{1,5}\)?(?:[ .\-/()]{1,3}[0-9]{2,5}){1,5}(?![0-9])"),
}
#: What stands between the parts of an address in the loose form.
_AT = ("@", "(at)", "[at]", "{at}", " at ")
_AROUND = 24
_HINTS = {
    "email": ("mail", "contact", "write", "courriel", "correo", "schreib"),
    "ip": ("ip", "host", "server", "address", "ping", "adresse"),
    "card": ("card", "visa", "credit", "carte", "karte", "tarjeta", "payment"),
    "phone": ("phone", "tel", "call", "mobile", "fax", "fon", "appel", "llam", "number"),
}
_AGAINST = ("order", "version", "isbn", "page", "date", "invoice", "token", "price", "section", "release", "score", "key")


def proposals(text: str) -> list[tuple[str, int, int]]:
    """Spans that may be personal data: generous, and over one another."""
    low = text.lower()
    has_at = any(sign in low for sign in _AT)  # no match is without one, so this only saves time
    found = [("email", *m.span()) for m in _LOOSE["email"].finditer(text)] if has_at else []
    if _DIGIT.search(text):
        found += [(kind, *m.span()) for kind in KINDS[1:] for m in _LOOSE[kind].finditer(text)]
    return found


def features(text: str, kind: str, start: int, end: int) -> list[float]:
    span = text[start:end].removeprefix("+")
    before, after = text[max(0, start - _AROUND) : start].lower(), text[end : end + _AROUND].lower()
    digits = _only_digits(span)
    groups = [len(g) for g in re.findall(r"[0-9]+", span)] or [0]
    words = re.findall(r"[\w-]+", span) or [""]
    parts = re.findall(r"[0-9]+", span)
    return [
        len(span), len(digits), len(digits) / max(1, len(span)), len(groups), groups[0], groups[-1], max(groups), min(groups),
        span.count(" "), span.count("."), span.count("-"), span.count("/"), span.count("("), float("@" in span),
        float(luhn(digits)) if digits else 0.0, float(len(parts) == 4 and all(len(p) <= 3 and int(p) <= 255 for p in parts)),
        float(len(parts) == 3 and len(parts[0]) == 4 and parts[0][:2] in ("19", "20")), len(words), len(words[-1]), len(words[0]),
        float(words[-1].isalpha()), float(any(f"{b}at{c}" in span.lower() for b, c in ("()", "[]", "{}"))),
        float(" dot " in span.lower()), float(before[-1:].isalnum() or before[-1:] in "\"'_#$"),
        float(after[:1].isalnum() or after[:1] in "\"'_%"), float(before[-2:].strip()[-1:] == ":"),
        float(any(h in before for h in _HINTS[kind])), float(any(h in before for h in _AGAINST)),
        float(before[-1:] in ".-/,"), float(re.match(r"[.\-/,][0-9]", after) is not None),
    ]


def decided(text: str) -> list[tuple[str, int, int, int]]:
    """Proposals that the exact patterns decide: 1 a base span of the kind, 0 one that fails or another kind's."""
    base = base_spans(text)
    every = {s for spans in base.values() for s in spans}
    edges = sorted(every)
    found = []
    for kind, start, end in proposals(text):
        if (start, end) in base[kind]:
            found.append((kind, start, end, 1))
        elif (start, end) in every or any(a < end and start < b for a, b in edges[max(0, bisect_left(edges, (start, 0)) - 2) :][:4]):
            same = any(a < end and start < b for a, b in base[kind])
            found.append((kind, start, end, 0)) if not same else None
        elif kind in ("card", "ip") and not _passes(kind, re.sub(r"[^0-9.]", "", text[start:end]) if kind == "ip" else text[start:end]):
            found.append((kind, start, end, 0))
    return found


def made_examples() -> list[tuple[str, str, int, int, int]]:
    """Texts with a span and whether it is personal data, from rules: forms times contexts."""
    n = itertools.count(3)
    number = lambda k: str(pow(7, next(n) * 13, 10**k)).zfill(k)

    def card() -> str:
        body = "4" + number(14)
        return next(body + str(c) for c in range(10) if luhn(body + str(c)))

    who = lambda k: ("jo", "maria", "k.lee", "anna-b", f"user{k}", f"a.b{k}")[k % 6]
    site = lambda k: ("example", "firma", "my-shop", f"host{k}", "mail")[k % 5]
    top = lambda k: ("com", "org", "net", "de", "fr", "info")[k % 6]
    there = lambda k: ("stay", "meet", f"room{k}", "arrive", f"{k}")[k % 5]
    forms = {
        ("email", 1): lambda k: (f"{who(k)} (at) mail{k % 3 or ''}.example.com", f"{who(k)} at {site(k)} dot org", f"{who(k)} [at] {site(k)} [dot] net",
                                 f"{who(k)} (at) {site(k)} dot {top(k)}", f"{who(k)}@{site(k)}.{top(k)}", f"{who(k)} @ {site(k)}.{top(k)}"),
        ("email", 0): lambda k: (f"{there(k)} at home.now", f"look at it dot{k} by dot", f"{there(k)} at noon.Then", f"x{k}@y", f"{there(k)} at {k % 12}.30",
                                 f"{there(k)} at {k}.Later"),
        ("ip", 1): lambda k: (f"10.{k % 256}.7.21", f"192.168.{k % 256}.{k * 7 % 256}", f"172[.]16[.]{k % 256}[.]9", f"8 . 8 . {k % 256} . 4"),
        ("ip", 0): lambda k: (f"1.2.{256 + k}.300", f"999.{300 + k}.1.2", f"12.05.19.{290 + k}", f"4 . {400 + k} . 1 . 2"),
        ("card", 1): lambda k: tuple(sep.join(c[i : i + 4] for i in (0, 4, 8, 12)) for sep in ("", " ", "-", ".") for c in [card()]),
        ("card", 0): lambda k: tuple(f"{int(c) + 1}" for c in [card()]) + (number(13), "0" + number(16), number(18)),
        ("phone", 1): lambda k: (f"({200 + k}) 555-{number(4)}", f"+1 ({300 + k}) 555-{number(4)}", f"{400 + k}-555-{number(4)}",
                                 f"0{k % 9 + 1} 55 {number(2)} {number(2)} {number(2)}", f"+44 20 {number(4)} {number(4)}", f"{500 + k}.555.{number(4)}"),
        ("phone", 0): lambda k: (f"20{k % 25:02d}-0{k % 9 + 1}-1{k % 9}", f"1{k % 9}/0{k % 9 + 1}/20{k % 25:02d}", f"{k % 90 + 10}.{k % 90 + 5}", f"{k} 000",
                                 f"{number(4)} {number(4)} {number(4)} {number(4)}", f"{k % 12}.30 - 14.00", f"{k % 250}.{k % 200}.{k % 99 + 10}.17"),
    }
    told = {"email": "mail: ", "ip": "host ", "card": "card ", "phone": "call "}
    found = []
    for (kind, label), make in forms.items():
        for k in range(24):
            for form in make(k):
                context = (told[kind] if label else ("order ", "version ")[k % 2]) if k % 3 == 0 else ("the ", "and, ", "of ")[k % 3]
                text = f"{context}{form} in the end"
                found.append((kind, text, len(context), len(context) + len(form), label))
    return found


@dataclass
class Model:
    """For each kind a boosted model and the chance from which a proposal is taken."""

    trees: dict[str, Boosted]
    thresholds: dict[str, float]


def fit(docs: DataFrame, text_col: str = "text", max_texts: int = 20_000, max_examples: int = 4_000, precision: float = 0.99) -> Model:
    """Fit on rule-made examples and at most ``max_examples`` a kind and label from about ``max_texts`` texts, by hash.

    A third of the examples, by their order, is not learnt from and sets the thresholds: the smallest
    of at least one half with the wanted share of right answers above it.
    """
    n = docs.count()
    text = F.col(text_col).cast("string")
    some = docs.where(F.pmod(F.xxhash64(text), F.lit(1_000_000)) < int(1_000_000 * min(1.0, max_texts / max(1, n))))

    def start():
        def work(part: pa.RecordBatch):
            rows = [(k, y, features(t, k, a, b)) for t in part.column(0).to_pylist() if t for k, a, b, y in decided(t)]
            if not rows:
                return None
            kinds, labels, values = zip(*rows)
            return pa.RecordBatch.from_arrays(
                [pa.array(kinds), pa.array(labels, pa.int32()), pa.array(values, pa.list_(pa.float64()))],
                ["kind", "label", "x"],
            )

        return work

    drawn = written(rows_of(some, text_col, [], "kind string, label int, x array<double>", start).distinct(), "examples")
    found = None
    for kind in KINDS:
        for label in (0, 1):
            part = drawn.where((F.col("kind") == kind) & (F.col("label") == label))
            part = part.orderBy(F.xxhash64("x"), "x").limit(max_examples)
            found = part if found is None else found.unionAll(part)
    examples = {kind: [] for kind in KINDS}
    for row in found.collect():
        examples[row.kind].append((row.x, row.label))
    for kind, text, a, b, label in made_examples():
        examples[kind].append((features(text, kind, a, b), label))
    model = Model({}, {})
    for kind, rows in examples.items():
        rows.sort(key=lambda r: hash((r[1], *r[0])))
        x, y = np.array([r[0] for r in rows]), np.array([r[1] for r in rows])
        aside = np.arange(len(y)) % 3 == 0
        model.trees[kind] = Boosted().fit(x[~aside], y[~aside])
        chance, right = model.trees[kind].predict(x[aside]), y[aside]
        order = np.argsort(-chance, kind="stable")
        precise = np.cumsum(right[order]) / np.arange(1, len(order) + 1) >= precision
        last_of_ties = np.append(np.diff(chance[order]) != 0, True)
        good = chance[order][precise & last_of_ties & (chance[order] >= 0.5)]
        model.thresholds[kind] = float(good.min()) if len(good) else 2.0
    return model


def _judge(model: Model, texts: list[str | None]) -> list[list[dict]]:
    """Base spans and selected proposals of each text."""
    out, waiting = [], {kind: [] for kind in KINDS}
    for number, text in enumerate(texts):
        text = text or ""
        base = base_spans(text)
        out.append([{"kind": k, "start": a, "end": b, "base": True, "score": 1.0} for k in KINDS for a, b in base[k]])
        taken = sorted(s for spans in base.values() for s in spans)
        reach = np.maximum.accumulate([b for _, b in taken]) if taken else []
        for kind, start, end in proposals(text):
            before = bisect_left(taken, (end, -1)) - 1  # the last base span that begins before the end
            if before < 0 or reach[before] <= start:
                waiting[kind].append((number, start, end, features(text, kind, start, end)))
    chosen = {}
    for kind, rows in waiting.items():
        if rows:
            chance = model.trees[kind].predict(np.array([r[3] for r in rows]))
            for (number, start, end, _), c in zip(rows, chance):
                if c >= model.thresholds[kind]:
                    chosen.setdefault(number, []).append((-c, start - end, start, end, kind))
    for number, spans in chosen.items():
        kept: list[tuple[int, int]] = []
        for c, _, start, end, kind in sorted(spans):
            at = bisect_left(kept, (start, end))
            if (at == 0 or kept[at - 1][1] <= start) and (at == len(kept) or kept[at][0] >= end):
                kept.insert(at, (start, end))
                out[number].append({"kind": kind, "start": start, "end": end, "base": False, "score": float(-c)})
    for spans in out:
        spans.sort(key=lambda s: (KINDS.index(s["kind"]), s["start"]))
    return out


_ARROW_SPANS = pa.list_(pa.struct([
    ("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_()), ("score", pa.float64()),
]))


def find_spans(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` with ``spans``, base and selected ones, by kind and start."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def start():
        def work(part: pa.RecordBatch):
            return {"spans": pa.array(_judge(shared.value, part.column(0).to_pylist()), _ARROW_SPANS)}

        return work

    return add_columns(docs, text_col, f"spans {SPANS}", start)


def redacted(text: str, spans: list[dict]) -> str:
    """Spans that touch one another become one mark, named by the first."""
    pieces, end = [], 0
    for span in sorted(spans, key=lambda s: (s["start"], -s["end"])):
        if span["start"] >= end:
            pieces += [text[end : span["start"]], f"[{span['kind'].upper()}]"]
        end = max(end, span["end"])
    return "".join([*pieces, text[end:]])


def redact(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` with every span of the text replaced by a mark such as ``[EMAIL]``; null texts stay null."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = docs.columns

    def start():
        def work(part: pa.RecordBatch):
            texts = part.column(0).to_pylist()
            spans = _judge(shared.value, texts)
            return {"__redacted": pa.array([t if t is None else redacted(t, s) for t, s in zip(texts, spans)], pa.string())}

        return work

    done = add_columns(docs, text_col, "__redacted string", start)
    return done.select(*(F.col("__redacted").alias(n) if n.lower() == text_col.lower() else F.col(f"`{n}`") for n in names))
