"""Benchmark decontamination by exact pieces and bit-parallel edit distance.

Text and items are compared in lower case with runs of white space as one space. An item of m characters may differ
by ``e = floor(m * error_rate)`` edits from some stretch of a text. Cut into e + 1 pieces, at least one piece is then
found as it is (pigeonhole). The same holds for halves: some piece has all larger parts of the item around
it within their share of the budget, so hits are verified from the smallest part upwards and most end at once. Myers'
bit-parallel recurrence gives the distance.

Cases: null or blank texts match nothing, null or blank items are not looked for; an item shorter than ``min_chars``
counts where it stands as it is between word borders, and one that is a mere phrase (under :data:`PHRASE_WORDS` words and
:data:`PHRASE_CHARS` characters, such as "yes") where it is the whole text; texts are searched whole; items that are equal
when normalised are looked for once under their smallest id, an item without id under null; repeated texts are judged
each; of equal distances the first place is told; an empty table gives an empty one; columns named like the new one are
replaced.
"""

from __future__ import annotations

import uuid
from collections import defaultdict
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tableprep.llm.arrow import add_columns

#: Characters of items whose pieces one automaton holds; more items take more passes over the texts.
BLOCK_CHARS = 1 << 20
#: Shorter items in both respects are no passage: they stand in countless texts that quote nothing.
PHRASE_WORDS, PHRASE_CHARS = 3, 16
MATCH = "struct<item_id:bigint,distance:int,budget:int,begin:int,end:int>"

FIELDS = ("item_id", "distance", "budget", "begin", "end")
ARROW_MATCHES = pa.list_(pa.struct([(name, pa.int64() if name == "item_id" else pa.int32()) for name in FIELDS]))


def normal(text: str | None) -> str:
    return " ".join(text.lower().split()) if text else ""


def best_end(pattern: str, text: str, limit: int) -> tuple[int, int]:
    """The smallest edit distance of the pattern to a stretch of the text, and where the first such ends.

    The distance is ``limit + 1`` when none is within the limit. (Myers, J. ACM 1999.)
    """
    size = len(pattern)
    if not size:
        return 0, 0
    places: dict[str, int] = defaultdict(int)
    for i, char in enumerate(pattern):
        places[char] |= 1 << i
    full, top = (1 << size) - 1, 1 << (size - 1)
    up, down, score = full, 0, size
    best, where = min(limit + 1, size), 0
    find = places.get
    for end, char in enumerate(text, 1):
        equal = find(char, 0)
        sideways = (((equal & up) + up) ^ up) | equal | down
        plus = down | (full & ~(sideways | up))
        minus = up & sideways
        score += 1 if plus & top else -1 if minus & top else 0
        plus, minus = plus << 1 & full, minus << 1 & full
        equal |= down
        up = minus | (full & ~(equal | plus))
        down = plus & equal
        if score < best:
            best, where = score, end
            if not best:
                break
    return best, where


class Items:
    """Items with their pieces in one automaton."""

    def __init__(self, items: list[tuple[int | None, str]], error_rate: float, min_chars: int):
        self.whole: dict[str, int | None] = {}
        self.items: list[tuple[int | None, str, int, bool]] = []
        pieces: dict[str, list[tuple[int, list]]] = defaultdict(list)
        for item_id, text in items:
            if len(text) < min(min_chars, PHRASE_CHARS) and text.count(" ") + 1 < PHRASE_WORDS:
                self.whole.setdefault(text, item_id)
                continue
            short = len(text) < min_chars
            budget = 0 if short else int(len(text) * error_rate)
            cuts = [round(k * len(text) / (budget + 1)) for k in range(budget + 2)]
            for k in range(budget + 1):
                pieces[text[cuts[k] : cuts[k + 1]]].append((len(self.items), self._parts(cuts, k)))
            self.items.append((item_id, text, budget, short))
        self.automaton = ahocorasick.Automaton()
        for piece, owners in pieces.items():
            self.automaton.add_word(piece, (len(piece), owners))
        if pieces:
            self.automaton.make_automaton()
        self.any = bool(pieces)

    @staticmethod
    def _parts(cuts: list[int], k: int) -> list[tuple[int, int, int]]:
        """The parts around piece ``k`` from small to large: first and last character, edits allowed."""
        low, high, found = 0, len(cuts) - 1, []
        while True:
            found.append((cuts[low], cuts[high], high - low - 1))
            if high - low == 1:
                return found[::-1]
            middle = (low + high) // 2
            low, high = (low, middle) if k < middle else (middle, high)

    def search(self, text: str) -> list[dict]:
        """The best match of each item that the text holds, by item."""
        found: dict[int, tuple[int, int]] = {}
        looked: dict[int, tuple[int, int]] = {}
        for last, (size, owners) in self.automaton.iter(text) if self.any and text else ():
            for number, parts in owners:
                if found.get(number, (1, 0))[0] == 0:
                    continue
                _, item, budget, short = self.items[number]
                if short:
                    if self._bordered(text, last - size + 1, last + 1):
                        found[number] = 0, last + 1
                    continue
                begin = last - size + 1 - parts[0][0]  # where the item would begin without edits before the piece
                low, high = looked.get(number, (1, 0))
                if low <= begin <= high:
                    continue  # every match around this hit lies in a stretch that was searched
                for first, end, edits in parts[1:-1]:
                    if best_end(item[first:end], text[max(0, begin + first - edits) : begin + end + edits], edits)[0] > edits:
                        break
                else:
                    # As far around as to cover hits whose beginning is shifted by the budget.
                    start = max(0, begin - 2 * budget)
                    distance, end = best_end(item, text[start : begin + len(item) + 2 * budget], budget)
                    looked[number] = (begin - budget, begin + budget)
                    if distance <= budget:
                        found[number] = min(found.get(number, (distance, start + end)), (distance, start + end))
        rows = []
        for number, (distance, end) in found.items():
            item_id, item, budget, _ = self.items[number]
            rows.append((item_id, distance, budget, self._begin(item, text, end, distance), end))
        if text in self.whole:
            rows.append((self.whole[text], 0, 0, 0, len(text)))
        rows.sort(key=lambda row: (row[0] is None, row[0] or 0, *row[1:]))
        return [dict(zip(FIELDS, row)) for row in rows]

    @staticmethod
    def _bordered(text: str, begin: int, end: int) -> bool:
        """Whether no word goes over either end of that stretch."""
        joined = lambda at: 0 < at < len(text) and text[at - 1].isalnum() and text[at].isalnum()
        return not joined(begin) and not joined(end)

    @staticmethod
    def _begin(item: str, text: str, end: int, distance: int) -> int:
        """Where the match that ends there begins: the same search backwards."""
        back = text[max(0, end - len(item) - distance) : end][::-1]
        size = len(item)
        # The nearest beginning whose distance to the whole item is the one found.
        row = list(range(size + 1))
        reverse = item[::-1]
        for used, char in enumerate(back, 1) if distance else ():
            if row[size] == distance:
                return end - used + 1
            before, row = row, [used]
            for j in range(size):
                row.append(min(before[j] + (reverse[j] != char), before[j + 1] + 1, row[j] + 1))
            if row[size] == distance:
                return end - used
        return end - size if not distance else max(0, end - len(back))


def item_blocks(items: DataFrame, id_col: str, text_col: str) -> Iterator[list[tuple[int | None, str]]]:
    """Distinct normalised items in blocks of at most :data:`BLOCK_CHARS` (one longer item alone)."""

    def start():
        return lambda part: {"normal": pa.array([normal(text) for text in part.column(0).to_pylist()], pa.string())}

    rows = items.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text"))
    rows = add_columns(rows, "text", "normal string", start).where("normal <> ''")
    seen = rows.groupBy("normal").agg(F.min("id").alias("id")).orderBy(F.col("id").asc_nulls_last(), "normal")
    block, size = [], 0
    for row in seen.toLocalIterator():
        if block and size + len(row.normal) > BLOCK_CHARS:
            yield block
            block, size = [], 0
        block.append((row.id, row.normal))
        size += len(row.normal)
    if block:
        yield block


_BUILT: dict[str, Items] = {}


def find_items(
    docs: DataFrame, items: DataFrame, error_rate: float = 0.1, min_chars: int = 32, text_col: str = "text",
    item_id_col: str = "item_id", item_text_col: str = "text",
) -> DataFrame:
    """``docs`` with ``leaks``, the items that each text holds, with distance and place in the normalised text."""
    parts = []
    for number, block in enumerate(item_blocks(items, item_id_col, item_text_col)):
        shared, key = docs.sparkSession.sparkContext.broadcast(block), uuid.uuid4().hex

        def start(shared=shared, key=key, name=f"leaks_{number}"):
            if len(_BUILT) > 8:  # those of earlier searches
                _BUILT.clear()
            if key not in _BUILT:  # once in a worker process
                _BUILT[key] = Items(shared.value, error_rate, min_chars)
            known = _BUILT[key]

            def work(part: pa.RecordBatch):
                found = [known.search(normal(text)) for text in part.column(0).to_pylist()]
                return {name: pa.array(found, ARROW_MATCHES)}

            return work

        parts.append(f"leaks_{number}")
        docs = add_columns(docs, text_col, f"leaks_{number} array<{MATCH}>", start)
    leaks = F.concat(*parts) if parts else F.from_json(F.lit("[]"), f"array<{MATCH}>")
    return docs.withColumn("leaks", leaks).drop(*parts)


def without_leaks(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` whose text holds no item, with their own columns."""
    names = docs.columns
    return find_items(docs, items, **options).where(F.size("leaks") == 0).select(*(f"`{n}`" for n in names))
