"""Records that go over line breaks, found in all parts of a file at once.

A reader that starts in the middle of a file does not know whether it stands inside a quoted value. So each
block of a file is read for both cases (Ge, Li, Eilebrecht, Chandramouli, Kossmann: Speculative distributed CSV data parsing for big
data analytics, SIGMOD 2019): one pass tells, for every block, in which state it ends if it starts outside and if
it starts inside quotes. These are a few values a block, and a window over them gives each block's true start. A second pass cuts the blocks
into records; only pieces of records that go over a block's end are put together by a shuffle. For an array of JSON objects
the state is "inside a string" and the depth of brackets.

The records are written to the shared folder as text that Spark can split anywhere: values separated by a control character that
the files do not hold, or one JSON object a line.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tableprep.scratch import new_path, written
from tableprep.session import allow_java_charsets
from tableprep.sources.detect import MAX_HEADERS, same_splits

#: Characters that may separate records in the rewritten text; the first that the files do not hold is taken.
SEPARATORS = ("\x1e", "\x1f", "\x1d", "\x1c", "\x02", "\x03")
#: Bytes of JSON that are looked at at once.
CHUNK = 4 << 20
#: Bytes that a task reads, if blocks are smaller.
TASK_BYTES = 64 << 20


@dataclass(frozen=True)
class Split:
    """Rewritten delimited text: the folder of each header (``None`` without headers) and what separates the records."""

    folders: dict[str | None, str]
    separator: str
    #: A quote in some file is not closed.
    open_quote: bool


def ends_inside(line: bytes, inside: bool, sep: bytes) -> bool:
    """Whether a quoted value is open at the end of ``line``, if one was at its start (``inside``) or not.

    A quote opens a value only where a field starts; after the closing quote the field goes on to the next delimiter.
    """
    at = 0
    while True:
        if not inside:
            if line[at : at + 1] != b'"':
                at = line.find(sep + b'"', at)
                if at < 0:
                    return False
                at += len(sep)
            at += 1
        close = line.find(b'"', at)
        while close >= 0 and line[close + 1 : close + 2] == b'"':
            close = line.find(b'"', close + 2)
        if close < 0:
            return True
        at = line.find(sep, close + 1)
        if at < 0:
            return False
        at += len(sep)
        inside = False


def _blocks(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[tuple, pa.RecordBatch]]:
    """Parts of batches that belong to one block, with the file and the block's start."""
    for batch in batches:
        start = 0
        while start < batch.num_rows:
            key = batch.column(0)[start].as_py(), batch.column(1)[start].as_py()
            stop = batch.num_rows
            if (batch.column(0)[stop - 1].as_py(), batch.column(1)[stop - 1].as_py()) != key:
                files, blocks = batch.column(0).to_pylist(), batch.column(1).to_pylist()
                stop = next(i for i in range(start, batch.num_rows) if (files[i], blocks[i]) != key)
            yield key, batch.slice(start, stop - start)
            start = stop


def _pieces(spark: SparkSession, path: str, separator: str) -> DataFrame:
    return spark.read.option("lineSep", separator).text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("value").cast("binary").alias("value")
    )


def _few_tasks(lines: DataFrame) -> DataFrame:
    """The same blocks in fewer tasks where blocks are small: a task reads several, one after the other."""
    spark = lines.sparkSession
    size = spark.conf.get("spark.sql.files.maxPartitionBytes").rstrip("b")
    blocks = lines.rdd.getNumPartitions()
    if not size.isdigit():  # set with a unit: blocks are taken as they are
        return lines
    wanted = max(4 * spark.sparkContext.defaultParallelism, blocks * int(size) // TASK_BYTES)
    return lines.coalesce(wanted) if wanted < blocks else lines


def _row(names: list[str], columns: list[list], types: list[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)


def _per_block(fold: Callable, first: Callable, names: list[str]) -> Callable:
    """A function on batches that folds the rows of each block and tells the result, a row for each block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple, tuple] = {}
        for key, part in _blocks(batches):
            if key not in found and found:
                yield tell(found)
                found = {}
            found[key] = fold(found.get(key) or first(), part.column(2))
        if found:
            yield tell(found)

    def tell(found: dict) -> pa.RecordBatch:
        rows = [(*key, *values) for key, values in found.items()]
        return _row(["file", "block", *names], [list(c) for c in zip(*rows)], [pa.string(), pa.int64(), *[pa.int64()] * len(names)])

    return run


def _ends(sep: bytes) -> Callable:
    """Adds lines to what is known of a block: its end if it starts outside and inside quotes, and the separators it holds."""

    def fold(known: tuple, lines: pa.Array) -> tuple:
        outside, inside, held = known
        values = lines.to_pylist()
        text = b"\n".join(values)
        for k, character in enumerate(SEPARATORS):
            held |= (character.encode() in text) << k
        for line in values:
            if b'"' in line:
                same = outside == inside
                outside = int(ends_inside(line, bool(outside), sep))
                inside = outside if same else int(ends_inside(line, bool(inside), sep))
        return outside, inside, held

    return fold


def _cut_lines(sep: bytes) -> Callable:
    """Cuts lines into records: (part, first, text), where part is None for whole records, 0 for what goes on from the block before, 1 for an open one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, block = None, None
        for key, part in _blocks(batches):
            rows: list[tuple] = []
            if key != now:
                if block is not None:
                    rows += block.close()
                now, block = key, _Lines(key, bool(part.column(3)[0].as_py()), sep)
            rows += block.add(part.column(2).to_pylist())
            if rows:
                yield _cut_rows(rows)
        if block is not None and (rows := block.close()):
            yield _cut_rows(rows)

    return run


def _cut_rows(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.string(), pa.int64(), pa.int32(), pa.bool_(), pa.binary()]
    return _row(["file", "block", "part", "first", "text"], [list(c) for c in zip(*rows)], types)


class _Lines:
    """The records of one block, given its lines in order."""

    def __init__(self, key: tuple, inside: bool, sep: bytes):
        self.key, self.sep, self.head = key, sep, inside
        self.open: list[bytes] | None = [] if inside else None
        self.first = key[1] == 0  # the first record of a file that is not blank

    def add(self, lines: list[bytes]) -> list[tuple]:
        out = []
        for line in lines:
            if self.open is None:
                if b'"' in line and ends_inside(line, False, self.sep):
                    self.open = [line]
                else:
                    out.append(self._row(None, line))
            else:
                self.open.append(line)
                if b'"' in line and not ends_inside(line, True, self.sep):
                    out.append(self._row(0 if self.head else None, b"\n".join(self.open)))
                    self.open, self.head = None, False
        return out

    def close(self) -> list[tuple]:
        return [] if self.open is None else [self._row(0 if self.head else 1, b"\n".join(self.open))]

    def _row(self, part: int | None, text: bytes) -> tuple:
        first = self.first and part != 0 and bool(text.strip())
        self.first = self.first and not first
        return (*self.key, part, first, text)


CUT = "file string, block bigint, part int, first boolean, text binary"


def _joined(cut: DataFrame, glue: str) -> DataFrame:
    """Whole records, with those put together that go over the end of a block: ``file``, ``first``, ``text``."""
    whole = cut.where("part is null").select("file", "first", "text")
    # Two rows a block at most: an open record begins one, the others go on with the one before.
    pieces = cut.where("part is not null").selectExpr("*", "sum(part) over (partition by file order by block, part) as record")
    text = F.transform(F.array_sort(F.collect_list(F.struct("block", "part", "text"))), lambda p: F.hex(p["text"]))
    together = pieces.groupBy("file", "record").agg(F.max("first").alias("first"), F.unhex(F.array_join(text, glue.encode().hex())).alias("text"))
    return whole.unionAll(together.select("file", "first", "text"))


def split_delimited(spark: SparkSession, path: str, sep: str, encoding: str, header: bool) -> Split | None:
    """Rewrite delimited files so that no record has a line end that separates records; None if no separator is free.

    Reads the files twice and writes their text once. A carriage return at the end of a record goes. Files whose encoding is not a superset of ASCII,
    or whose lines end in carriage returns only, cannot be cut at line feeds and give None.
    """
    if encoding.upper().replace("_", "-").startswith(("UTF-16", "UTF-32", "UTF16", "UTF32")):
        return None
    allow_java_charsets(spark)
    lines, mark = _few_tasks(_pieces(spark, path, "\n")), sep.encode("utf-8" if encoding.upper() in ("UTF-8", "UTF8") else encoding)
    with same_splits(spark):
        run = _per_block(_ends(mark), lambda: (0, 1, 0), ["outside", "inside", "held"])
        ends = lines.mapInArrow(run, "file string, block bigint, outside bigint, inside bigint, held bigint")
        starts = written(_quote_starts(ends), "blocks")
        total = starts.agg(F.bit_or("held").alias("held"), F.max("still_open").alias("still_open")).first()
        free = [c for k, c in enumerate(SEPARATORS) if not (total.held or 0) >> k & 1]
        if not free:
            return None
        # A row for each block of a file: small beside the files, and it keeps the lines in order.
        known = lines.join(F.broadcast(starts.select("file", "block", "start")), ["file", "block"])
        cut = written(known.select("file", "block", "value", "start").mapInArrow(_cut_lines(mark), CUT), "cut")
    text = F.decode("text", encoding) if encoding.upper() not in ("UTF-8", "UTF8") else F.col("text").cast("string")
    records = _joined(cut, "\n").select("file", "first", F.regexp_replace(text, "\r$", "").alias("record"))
    folder = new_path(spark, "records")
    if not header:
        records.select("record").write.option("lineSep", free[0]).text(folder)
        return Split({None: folder}, free[0], bool(total.still_open))
    heads = written(records.where("first").select("file", "record"), "headers")
    groups = sorted(r.record for r in heads.select("record").distinct().limit(MAX_HEADERS + 1).collect())
    if len(groups) > MAX_HEADERS:
        raise ValueError(f"the files have more than {MAX_HEADERS} different first lines")
    rows = records.where("not first")
    if len(groups) < 2:
        rows.select("record").write.option("lineSep", free[0]).text(folder)
        return Split({line: folder for line in groups or [""]}, free[0], bool(total.still_open))
    number = F.create_map(*(F.lit(x) for k, line in enumerate(groups) for x in (line, k)))
    rows = rows.join(heads.select("file", number[F.col("record")].alias("header")), "file").select("record", "header")
    # A blank record for each header, which readers skip, so that each has a folder.
    blank = spark.range(len(groups)).select(F.lit("").alias("record"), F.col("id").cast("int").alias("header"))
    rows.unionAll(blank).write.partitionBy("header").option("lineSep", free[0]).text(folder)
    return Split({line: f"{folder}/header={k}" for k, line in enumerate(groups)}, free[0], bool(total.still_open))


def _quote_starts(ends: DataFrame) -> DataFrame:
    """Whether each block starts inside quotes. Each block is one of four functions of its start: it keeps it, turns it over, or sets it."""
    order = "partition by file order by block"
    before = f"{order} rows between unbounded preceding and 1 preceding"
    turned = ends.selectExpr("*", f"coalesce(sum(int(outside = 1 and inside = 0)) over ({before}), 0) as turns")
    last = turned.selectExpr("*", f"last(if(outside = inside, struct(outside, turns), null), true) over ({before}) as fixed")
    start = last.selectExpr("*", "coalesce((fixed.outside + turns - fixed.turns) % 2, turns % 2) as start")
    return start.selectExpr(
        "file", "block", "start", "held",
        f"lead(block) over ({order}) is null and if(start = 0, outside, inside) = 1 as still_open",
    )


# --- arrays of JSON objects ---


def json_shape(data: np.ndarray, inside: int) -> tuple[np.ndarray, np.ndarray]:
    """For each byte: whether it stands outside strings, and the change of depth if it does. ``inside``: the first one is in a string."""
    slash = data == ord("\\")
    at = np.arange(len(data), dtype=np.int64)
    plain = np.maximum.accumulate(np.where(slash, -1, at))  # the last place that holds no backslash
    quote = data == ord('"')
    places = np.flatnonzero(quote)
    before = np.where(places > 0, places - 1 - plain[np.maximum(places - 1, 0)], 0)
    quote[places[before % 2 == 1]] = False
    outside = (np.cumsum(quote, dtype=np.int32) + inside) % 2 == 0
    change = ((data == ord("{")) | (data == ord("["))).astype(np.int32) - ((data == ord("}")) | (data == ord("]")))
    return outside, change


def _json_text(pieces: pa.Array) -> Iterator[bytes]:
    """Text of pieces that each ended at a brace, in chunks."""
    values, size = [], 0
    for value in pieces.to_pylist():
        values.append(value)
        size += len(value) + 1
        if size > CHUNK:
            yield b"}".join(values) + b"}"
            values, size = [], 0
    if values:
        yield b"}".join(values) + b"}"


def _depths(known: tuple, pieces: pa.Array) -> tuple:
    """Adds pieces to what is known of a block: quotes modulo two, change of depth if it starts outside and inside a string, first character."""
    quotes, depth, other, first = known
    for text in _json_text(pieces):
        data = np.frombuffer(text, np.uint8)
        outside, change = json_shape(data, 0)
        out, in_ = int(change[outside].sum()), int(change[~outside].sum())
        depth, other = (depth + out, other + in_) if quotes == 0 else (depth + in_, other + out)
        quotes = (quotes + int(not outside[-1])) % 2
        first = first or (text.lstrip(b"\xef\xbb\xbf \t\r\n") or b"\0")[0]
    return quotes, depth, other, first


class _Elements:
    """The objects of one block of a JSON array, given its text in order."""

    def __init__(self, key: tuple, inside: int, depth: int):
        self.key, self.inside, self.depth = key, inside, depth
        self.head = not (inside == 0 and depth <= 1)
        self.open: list[bytes] = []

    def add(self, pieces: pa.Array) -> list[tuple]:
        out = []
        for text in _json_text(pieces):
            data = np.frombuffer(text, np.uint8)
            outside, change = json_shape(data, self.inside)
            depth = np.cumsum(np.where(outside, change, 0), dtype=np.int64) + self.depth
            start = 0
            for end in np.flatnonzero((data == ord("}")) & outside & (depth == 1)):
                out.append(self._row(0 if self.head else None, b"".join([*self.open, text[start : end + 1]])))
                self.open, self.head, start = [], False, int(end) + 1
            if start < len(text):
                self.open.append(text[start:])
            self.inside, self.depth = int(not outside[-1]), int(depth[-1])
        return out

    def close(self) -> list[tuple]:
        row = self._row(0 if self.head else 1, b"".join(self.open))
        # What follows the last object is the end of the array, and a brace that stands for the end of the file.
        return [row] if row[-1].strip(b" \t\r\n,[]}") else []

    def _row(self, part: int | None, text: bytes) -> tuple:
        if part != 0:
            # Before an object there may be a comma, the start of its array, and the end of an array before that one.
            text = text.lstrip(b"\xef\xbb\xbf \t\r\n,[]")
        return (*self.key, part, False, text.replace(b"\n", b" ").replace(b"\r", b" "))


def _cut_objects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    now, block = None, None
    for key, part in _blocks(batches):
        rows: list[tuple] = []
        if key != now:
            if block is not None:
                rows += block.close()
            now, block = key, _Elements(key, part.column(3)[0].as_py(), part.column(4)[0].as_py())
        rows += block.add(part.column(2))
        if rows:
            yield _cut_rows(rows)
    if block is not None and (rows := block.close()):
        yield _cut_rows(rows)


def split_array(spark: SparkSession, path: str) -> str | None:
    """Rewrite files that hold an array of JSON objects, or several in a row, as one object a line; returns the folder, or None if some file is no array.

    Files are cut at closing braces, so one without line breaks is split too. An array that is not closed raises.
    """
    pieces = _few_tasks(_pieces(spark, path, "}"))
    with same_splits(spark):
        run = _per_block(_depths, lambda: (0, 0, 0, 0), ["quotes", "depth", "other", "first"])
        ends = pieces.mapInArrow(run, "file string, block bigint, quotes bigint, depth bigint, other bigint, first bigint")
        order = "partition by file order by block"
        before = f"{order} rows between unbounded preceding and 1 preceding"
        starts = ends.selectExpr("*", f"coalesce(sum(quotes) over ({before}), 0) % 2 as inside").selectExpr(
            "file", "block", "first", "inside", "(inside + quotes) % 2 as after", "if(inside = 0, depth, other) as change"
        ).selectExpr("*", f"coalesce(sum(change) over ({before}), 0) as start", f"lead(block) over ({order}) is null as is_last")
        starts = written(starts, "blocks")
        if not starts.where(f"block = 0 and first not in ({ord('[')}, 0)").isEmpty():
            return None
        # Every file ends after its bracket; the brace that was added stands one step below.
        broken = starts.where("is_last and first <> 0 and (after <> 0 or start + change <> -1)").select("file").first()
        if broken:
            raise ValueError(f"the array in {broken.file} is not closed")
        known = pieces.join(F.broadcast(starts.select("file", "block", "inside", "start")), ["file", "block"])
        cut = written(known.select("file", "block", "value", "inside", "start").mapInArrow(_cut_objects, CUT), "cut")
    folder = new_path(spark, "objects")
    _joined(cut, "").select(F.col("text").cast("string").alias("value")).where("value <> ''").write.text(folder)
    return folder
