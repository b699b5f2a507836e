"""Removal of repeated stretches by a distributed sort of suffixes.

A byte goes when it lies in a stretch of ``length`` bytes that also starts in a text with a smaller id. Not every suffix is
sorted: in each window of stretch starts, the place whose ``GRAM`` bytes have the smallest hash is an anchor. Equal
stretches have their anchors at the same places, so sorting the suffixes at anchors is enough, about one in sixteen
bytes. Three steps:

1. Hashes of the anchors' grams are dealt out, as sorted runs, to find those that occur in several texts.
2. Each task sorts the suffixes at such anchors (``length`` bytes to the right, then the bytes to the left
   backwards), drops suffixes that it holds with a smaller id, and sends the rest as front-coded sorted runs, cut at
   sampled splitters. A loser tree merges the runs of a range; it keeps the common prefix of each loser with the
   winner, so no byte known to be equal is compared again (Bingmann and Sanders' LCP loser tree).
3. From the common prefixes of neighbours and hashes of the left sides follows, for each place of a stretch around an
   anchor, the smallest id that has it too.

A gram that very many texts have would be one range however the others are cut, as its suffixes must meet for their left
sides. Such grams are counted exactly after step 1; each stretch around them is dealt out by a hash of its own instead,
from each run only for the run's smallest id.

Cases: a null text is empty; texts shorter than ``length`` lose nothing; texts are read whole; repeats within one text are kept;
rows with the same id count as one text for each other and lose the same stretches that a smaller id has (their own
places); rows without id keep all; an empty table gives an empty one. Hashes have 64 bits: two unequal stretches are taken for
equal with a chance of about 2**-64 for each pair below a common gram (around frequent grams: for each pair of stretches).
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tableprep.llm.arrow import add_columns, bounded_batches, packed, release, slices, text_bytes, tidy
from tableprep.llm.meeting import MAX_PARTS, parts_for, shared_names, short_names
from tableprep.llm.words import ByteHashes, mix
from tableprep.scratch import written

#: Bytes that an anchor is chosen by.
GRAM = 20
#: Suffixes in one range of the second exchange, and in one sorted run.
RANGE, RUN = 60_000, 120_000
#: Names that are counted at once.
COUNTED = 4_000_000
#: Texts that the splitters are drawn from, about, and places taken in each.
SAMPLED_TEXTS, SAMPLED_PLACES = 2_000, 8


def _slide(x: np.ndarray, width: int, pick) -> np.ndarray:
    """``pick`` (minimum or maximum) over each window of ``width`` values."""
    size = 1
    while size * 2 <= width:
        x = pick(x[:-size], x[size:])
        size *= 2
    rest = width - size
    return pick(x[: len(x) - rest], x[rest:]) if rest else x


def anchors(data: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of the anchors, the hashes of their grams, and the numbers of their texts."""
    none = np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, np.int64)
    if len(data) < length:
        return none
    starts = np.arange(len(data) - GRAM + 1)
    hashes = ByteHashes(data).between(starts, starts + GRAM) | np.uint64(1)
    width = length - GRAM + 1
    least = _slide(hashes, width, np.minimum)  # of the grams in the stretch that starts there
    owner = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    least[owner[: len(least)] != owner[length - 1 :]] = 0  # no stretch goes over the end of a text
    edge = np.zeros(width - 1, np.uint64)
    most = _slide(np.concatenate([edge, least, edge]), width, np.maximum)
    at = np.flatnonzero(most == hashes)
    return at, hashes[at], owner[at]


def _shared_grams(texts: DataFrame, length: int, parts: int) -> DataFrame:
    """The names of each text's grams that may occur in other texts too: ``owner``, ``name``."""

    def make(piece: pa.RecordBatch):
        _, hashes, owner = anchors(*text_bytes(piece.column(0)), length)
        return hashes, owner, piece.column(1).to_numpy()

    return written(shared_names(texts.select("text", "id"), make, parts), "grams")


def _frequent(grams: DataFrame) -> tuple[np.ndarray, int]:
    """The names that more than :data:`RANGE` texts have (and some that half as many have), sorted, and their texts in all.

    Of ``n`` batches, only names that occur ``RANGE / 2n`` times in one are told. A name loses less than ``RANGE / 2``
    by that, so those told more than ``RANGE / 2`` times are all.
    """
    total = grams.count()
    if total <= RANGE // 2:
        return np.empty(0, np.uint64), 0
    least = max(1, RANGE // (2 * (total // COUNTED + grams.rdd.getNumPartitions())))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def flush() -> pa.RecordBatch:
            name, count = np.unique(np.concatenate(held), return_counts=True)
            told = count >= least
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(name[told]), pa.array(count[told])], ["name", "n"])

        for batch in batches:
            held.append(batch.column(0).to_numpy())
            n += batch.num_rows
            if n >= COUNTED:
                yield flush()
                n = 0
        if held:
            yield flush()

    bounded_batches(grams.sparkSession)
    told = grams.select("name").mapInArrow(tidy(run), "name bigint, n bigint").groupBy("name").agg(F.sum("n").alias("n"))
    rows = told.where(F.col("n") > RANGE // 2).collect()
    return np.sort(np.array([r.name for r in rows], np.int64).view(np.uint64)), sum(r.n for r in rows)


class _Run:
    """Sorted keys with the common prefix of each with the one before."""

    def __init__(self, keys: list[bytes], common: list[int]):
        self.keys, self.common, self.at = keys, common, 0


def merged(runs: list[tuple[list[bytes], list[int]]]) -> tuple[list[tuple[int, int]], list[int]]:
    """Places (run, number) of all keys in order, and the common prefix of each with the one before it.

    A loser tree. The entry at a node is the run that lost there, with the common prefix of its key and
    the winner's. While the winners go up, prefixes are common with the last key put out: the longer one is of
    the smaller key, and only keys with equal ones are compared, from there on. Keys have one length.
    """
    runs = [_Run(keys, common) for keys, common in runs if keys]
    leaves = 1
    while leaves < len(runs):
        leaves *= 2
    end = len(runs[0].keys[0]) if runs else 0
    head: list[bytes | None] = [r.keys[0] for r in runs] + [None] * (leaves - len(runs))
    loser, prefix = [0] * leaves, [0] * leaves

    def play(a: int, ha: int, b: int, hb: int) -> tuple[int, int, int, int]:
        """Winner and its prefix, loser and its prefix with the winner."""
        if ha > hb:
            return a, ha, b, hb
        if hb > ha:
            return b, hb, a, ha
        x, y = head[a], head[b]
        if x is None or y is None:
            return (b, hb, a, -1) if x is None else (a, ha, b, -1)
        h = ha
        while h < end and x[h] == y[h]:
            h += 1
        if h == end:
            return (a, ha, b, h) if a < b else (b, hb, a, h)
        return (a, ha, b, h) if x[h] < y[h] else (b, hb, a, h)

    # The first round, bottom up.
    up = [(k, 0 if head[k] is not None else -1) for k in range(leaves)]
    at = leaves
    while len(up) > 1:
        at //= 2
        nodes, up = up, []
        for k in range(0, len(nodes), 2):
            w, hw, l, hl = play(*nodes[k], *nodes[k + 1])
            loser[at + k // 2], prefix[at + k // 2] = l, hl
            up.append((w, hw))
    if not up or not runs:
        return [], []
    winner, h = up[0]
    order, common = [], []
    while head[winner] is not None:
        run = runs[winner]
        order.append((winner, run.at))
        common.append(h)
        run.at += 1
        if run.at < len(run.keys):
            head[winner], h = run.keys[run.at], run.common[run.at]
        else:
            head[winner], h = None, -1
        node = (leaves + winner) // 2
        while node:
            hl = prefix[node]
            if hl > h:
                winner, loser[node] = loser[node], winner
                prefix[node], h = h, hl
            elif hl == h:
                winner, h, loser[node], prefix[node] = play(winner, h, loser[node], hl)
            node //= 2
    return order, common


def _counts(length: int) -> np.dtype:
    """The smallest type, highest byte first, that holds a count of bytes up to a key's width."""
    return next(t for t in map(np.dtype, (">u1", ">u2", ">u4")) if 2 * length - GRAM + 2 * t.itemsize < 1 << 8 * t.itemsize)


def _key_width(length: int) -> int:
    return 2 * length - GRAM + 2 * _counts(length).itemsize


def _both_sides(keys: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """How many bytes of each key are to the right and to the left of its anchor."""
    kind = _counts(length)
    counts = np.ascontiguousarray(keys[:, -2 * kind.itemsize :]).view(kind).astype(np.int64)
    return counts[:, 0], counts[:, 1]


def _keys(data: np.ndarray, offsets: np.ndarray, at: np.ndarray, owner: np.ndarray, length: int) -> np.ndarray:
    """One row of bytes for each anchor: to the right, to the left backwards, and how many of either there are."""
    left = length - GRAM
    around = np.lib.stride_tricks.sliding_window_view(np.pad(data, (left, length)), left + length)[at]
    n_right = np.minimum(offsets[owner + 1] - at, length)
    n_left = np.minimum(at - offsets[owner], left)
    right = np.where(np.arange(length) < n_right[:, None], around[:, left:], 0)
    before = np.where(np.arange(left) < n_left[:, None], around[:, :left][:, ::-1], 0)
    counts = np.stack([n_right, n_left], axis=1).astype(_counts(length)).view(np.uint8)
    return np.concatenate([right, before, counts], axis=1).astype(np.uint8)


def _as_text(keys: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(keys).view(f"S{keys.shape[1]}").ravel()


def _common(keys: np.ndarray) -> np.ndarray:
    """The common prefix of each row with the row before it; 0 for the first."""
    out = np.zeros(len(keys), np.int64)
    if len(keys) > 1:
        unequal = keys[1:] != keys[:-1]
        out[1:] = np.where(unequal.any(axis=1), unequal.argmax(axis=1), keys.shape[1])
    return out


def _squeeze(*columns: np.ndarray) -> list[pa.Array]:
    return [pa.array([zlib.compress(c.tobytes(), 1)], pa.binary()) for c in columns]


RUN_FIELDS = ["part", "common", "tails", "ids", "places", "sure_ids", "sure_from", "sure_to"]


def _run_rows(keys, ids, places, splitters, length, spread) -> Iterator[pa.RecordBatch]:
    """A sorted run as rows, one for each range of keys; ``sure`` are stretches known to be repeated."""
    order = np.argsort(ids, kind="stable")
    order = order[np.argsort(_as_text(keys[order]), kind="stable")]
    keys, ids, places = keys[order], ids[order], places[order]
    group = np.cumsum(np.concatenate([[True], (keys[1:] != keys[:-1]).any(axis=1)])) - 1
    first = ids[np.searchsorted(group, group)]  # the smallest id with this key
    sure = ids > first
    n_right, n_left = _both_sides(keys, length)
    known = [ids[sure], (places - n_left)[sure].astype(np.int32), (places + n_right)[sure].astype(np.int32)]
    keys, ids, places = keys[~sure], ids[~sure], places[~sure]
    part = np.searchsorted(splitters, _as_text(keys[:, :GRAM]), "right")
    cuts = np.searchsorted(part, np.arange(len(splitters) + 2))
    nothing = [np.empty(0, np.int64), np.empty(0, np.int32), np.empty(0, np.int32)]
    chosen = np.flatnonzero(np.diff(cuts))
    for number, k in enumerate(chosen):
        rows = slice(cuts[k], cuts[k + 1])
        common = _common(keys[rows])
        tails = keys[rows][np.arange(keys.shape[1]) >= common[:, None]]
        more = known if number == spread % len(chosen) else nothing
        yield pa.RecordBatch.from_arrays(
            [pa.array([k], pa.int32()), *_squeeze(common.astype(_counts(length)), tails, ids[rows], places[rows].astype(np.int32), *more)],
            RUN_FIELDS,
        )


def _decoded(common: np.ndarray, tails: np.ndarray, width: int) -> np.ndarray:
    """Keys from their front-coded form: each column is filled from the last row that states it."""
    stated = np.arange(width) >= common[:, None]
    keys = np.zeros((len(common), width), np.uint8)
    keys[stated] = tails
    row = np.where(stated, np.arange(len(common))[:, None], 0)
    np.maximum.accumulate(row, axis=0, out=row)
    return np.take_along_axis(keys, row, axis=0)


def _repeats(keys: np.ndarray, common: np.ndarray, ids: np.ndarray, places: np.ndarray, length: int):
    """Ids and stretches (from, to) around anchors that a smaller id has too; the keys are in order."""
    left = length - GRAM
    n_right, n_left = _both_sides(keys, length)
    right = np.minimum(common, n_right)
    right[1:] = np.minimum(right[1:], n_right[:-1])
    least, most = np.full(len(ids), left + 1), np.full(len(ids), -1)
    before = np.zeros(len(ids), np.uint64)
    for back in range(left + 1):  # the stretch begins so many bytes before the anchor
        if back:
            before = mix(before * np.uint64(0x100000001B3) + keys[:, length + back - 1].astype(np.uint64) + np.uint64(1))
        there = (n_right >= length - back) & (n_left >= back)
        alike = np.cumsum(right < length - back).astype(np.uint64)  # equal to the right as far as the stretch goes
        rows = np.flatnonzero(there)
        if not len(rows):
            continue
        name = mix(alike[rows] * np.uint64(0x9E3779B97F4A7C15) + before[rows])
        order = np.argsort(name, kind="stable")
        name, rows = name[order], rows[order]
        starts = np.flatnonzero(np.concatenate([[True], name[1:] != name[:-1]]))
        smallest = np.repeat(np.minimum.reduceat(ids[rows], starts), np.diff(np.append(starts, len(rows))))
        rows = rows[ids[rows] > smallest]
        least[rows] = np.minimum(least[rows], back)
        most[rows] = back
    hit = most >= 0
    return ids[hit], (places - most)[hit], (places - least + length)[hit]


def _starts(at: np.ndarray, owner: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """All places where a stretch around one of the anchors begins, and the numbers of their texts."""
    start = (at[:, None] - np.arange(length - GRAM + 1)).ravel()
    owner = np.repeat(owner, length - GRAM + 1)
    inside = (start >= offsets[owner]) & (start + length <= offsets[owner + 1])
    start, first = np.unique(start[inside], return_index=True)
    return start, owner[inside][first]


def _split_by_first(names: np.ndarray, ids: np.ndarray, places: np.ndarray, length: int):
    """Stretches in order of their names: those of each name's smallest id (names, ids, places), and the others as
    ids, from, to, neighbours in one."""
    order = np.lexsort((ids, names))
    names, ids, places = names[order], ids[order], places[order]
    new = np.ones(len(names), bool)
    new[1:] = names[1:] != names[:-1]
    starts = np.flatnonzero(new)
    again = ids > np.repeat(ids[starts], np.diff(np.append(starts, len(ids))))
    own, place = ids[again], places[again]
    order = np.lexsort((place, own))
    own, place = own[order], place[order]
    new = np.ones(len(own), bool)
    new[1:] = (own[1:] != own[:-1]) | (place[1:] > place[:-1] + length)
    last = np.append(np.flatnonzero(new)[1:], len(own)) - 1
    return (names[~again], ids[~again], places[~again]), (own[new], place[new], place[last[: int(new.sum())]] + length)


def _frequent_rows(names, ids, places, length, base, parts) -> Iterator[pa.RecordBatch]:
    """A run of hashed stretches as rows, one for each part of the hashes, numbered from ``base``."""
    (names, ids, places), sure = _split_by_first(names, ids, places, length)
    part = (((names >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)).astype(np.int64)
    cuts = np.searchsorted(part, np.arange(parts + 1))
    for number, k in enumerate(np.flatnonzero(np.diff(cuts))):
        rows = slice(cuts[k], cuts[k + 1])
        more = sure if not number else [c[:0] for c in sure]
        columns = names[:0], names[rows], ids[rows], places[rows].astype(np.int32), more[0], *(c.astype(np.int32) for c in more[1:])
        yield pa.RecordBatch.from_arrays([pa.array([base + k], pa.int32()), *_squeeze(*columns)], RUN_FIELDS)


def _stretches(
    texts: DataFrame, names: DataFrame, length: int, parts: int, splitters: list[bytes], frequent: np.ndarray, n_frequent: int
) -> DataFrame:
    """Repeated stretches: id, from, to (byte places, to exclusive), overlapping ones too.

    ``frequent``: sorted names of grams whose stretches, around ``n_frequent`` places or so, are dealt out one by one.
    """
    shared = texts.sparkSession.sparkContext.broadcast((np.array(splitters, f"S{GRAM}"), frequent))
    width = _key_width(length)
    ranges = len(splitters) + 1
    hashed = int(min(max(n_frequent * (length - GRAM + 1) / 4 / RANGE, 1), MAX_PARTS))

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, ids, places, n, number = [], [], [], 0, 0
        around, n_around = ([], [], []), 0
        splitters, frequent = shared.value

        def flush() -> Iterator[pa.RecordBatch]:
            if n:
                yield from _run_rows(*map(np.concatenate, (keys, ids, places)), splitters, length, int(ids[0][0]) + number)
            keys.clear(), ids.clear(), places.clear()

        def flush_around() -> Iterator[pa.RecordBatch]:
            if n_around:
                yield from _frequent_rows(*map(np.concatenate, around), length, ranges, hashed)
            for column in around:
                column.clear()

        for piece in slices(batches):
            data, offsets = text_bytes(piece.column(0))
            at, hashes, owner = anchors(data, offsets, length)
            wanted = piece.column(2)
            lengths = np.diff(wanted.offsets.to_numpy())
            of = np.repeat(np.arange(len(lengths)), lengths).astype(np.uint64)
            turn = lambda name, text: mix(name + mix(text.astype(np.uint64) + np.uint64(1)))
            names = short_names(hashes, parts)
            chosen = np.isin(turn(names, owner), turn(wanted.flatten().to_numpy().view(np.uint64), of))
            if len(frequent):
                often = chosen & np.isin(names, frequent)
                start, text = _starts(at[often], owner[often], offsets, length)
                if len(start):
                    mine = ByteHashes(data).between(start, start + length), piece.column(1).to_numpy()[text], start - offsets[text]
                    for column, values in zip(around, mine):
                        column.append(values)
                    n_around += len(start)
                    if n_around > 4 * RUN:
                        yield from flush_around()
                        n_around = 0
                chosen &= ~often
            at, owner = at[chosen], owner[chosen]
            keys.append(_keys(data, offsets, at, owner, length))
            ids.append(piece.column(1).to_numpy()[owner])
            places.append(at - offsets[owner])
            n += len(at)
            if n > RUN:
                yield from flush()
                n, number = 0, number + 1
        yield from flush()
        yield from flush_around()

    def merge(table: pa.Table) -> pa.Table:
        if table["part"][0].as_py() >= ranges:
            return merge_hashed(table)
        told, runs_, keys, ids, places = [], [], [], [], []
        for row in zip(*(table[c] for c in RUN_FIELDS[1:])):
            common, tails, own, place, *sure = (zlib.decompress(v.as_buffer()) for v in row)
            told.append([np.frombuffer(v, t) for v, t in zip(sure, (np.int64, np.int32, np.int32))])
            common = np.frombuffer(common, _counts(length)).astype(np.int64)
            keys.append(_decoded(common, np.frombuffer(tails, np.uint8), width))
            ids.append(np.frombuffer(own, np.int64))
            places.append(np.frombuffer(place, np.int32).astype(np.int64))
            runs_.append((np.ascontiguousarray(keys[-1]).view(f"V{width}").ravel().tolist(), common.tolist()))
        bases = np.cumsum([0] + [len(k) for k in keys])
        order, common = merged(runs_)
        del runs_
        order = np.array([bases[r] + i for r, i in order], np.int64)
        keys, ids, places = (np.concatenate(c)[order] for c in (keys, ids, places))
        told.append(_repeats(keys, np.array(common, np.int64), ids, places, length))
        return as_table(told)

    def merge_hashed(table: pa.Table) -> pa.Table:
        told, rows = [], []
        for row in zip(*(table[c] for c in RUN_FIELDS[2:])):
            name, own, place, *sure = (zlib.decompress(v.as_buffer()) for v in row)
            told.append([np.frombuffer(v, t) for v, t in zip(sure, (np.int64, np.int32, np.int32))])
            rows.append([np.frombuffer(v, t) for v, t in zip((name, own, place), (np.uint64, np.int64, np.int32))])
        names, ids, places = (np.concatenate([r[k] for r in rows]) for k in range(3))
        told.append(_split_by_first(names, ids, places, length)[1])
        return as_table(told)

    def as_table(told: list) -> pa.Table:
        own, start, stop = (np.concatenate([t[k] for t in told]) for k in range(3))
        release()
        return pa.table({"id": pa.array(own, pa.int64()), "from": pa.array(start, pa.int32()), "to": pa.array(stop, pa.int32())})

    with_names = texts.join(names, "id").select("text", "id", "names")
    made = "part int, common binary, tails binary, ids binary, places binary, sure_ids binary, sure_from binary, sure_to binary"
    bounded_batches(texts.sparkSession)
    return with_names.mapInArrow(tidy(runs), made).groupBy("part").applyInArrow(merge, "id bigint, from int, to int")


def _splitters(texts: DataFrame, n_texts: int, length: int) -> tuple[list[bytes], float]:
    """Sorted prefixes of sampled suffixes at anchors, and the anchors in a text on average."""
    share = int(1_000_000 * min(1.0, SAMPLED_TEXTS / max(1, n_texts))) + 1
    some = texts.where(F.pmod(F.xxhash64("id"), F.lit(1_000_000)) < share)

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in slices(batches):
            data, offsets = text_bytes(piece.column(0))
            at, _, owner = anchors(data, offsets, length)
            counts = np.bincount(owner, minlength=piece.num_rows)
            first = np.cumsum(counts) - counts
            grams = []
            for k in range(piece.num_rows):
                step = max(1, counts[k] // SAMPLED_PLACES)
                places = at[first[k] : first[k] + counts[k] : step][:SAMPLED_PLACES]
                grams.append(b"".join(data[p : p + GRAM].tobytes() for p in places))
            yield pa.RecordBatch.from_arrays([pa.array(counts), packed(grams)], ["n", "grams"])

    drawn = some.select("text", "id").mapInArrow(draw, "n bigint, grams binary").collect()
    grams = sorted(row.grams[i : i + GRAM] for row in drawn for i in range(0, len(row.grams), GRAM))
    return [bytes(g) for g in grams], sum(row.n for row in drawn) / max(1, len(drawn))


def find_repeats(docs: DataFrame, length: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each row's id and text (null as empty) with ``spans``, the maximal repeated runs as byte places (to exclusive)."""
    if length < GRAM + 1:
        raise ValueError(f"stretches have more than {GRAM} bytes")
    every = docs.select(F.col(id_col).cast("bigint").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    texts = every.where("id is not null")
    n = docs.count()
    drawn, each = _splitters(texts, n, length)
    total = n * each
    parts = parts_for(total)
    ranges = int(min(max(total / 4 / RANGE, 1), len(drawn) + 1, MAX_PARTS))
    cuts = sorted({drawn[k * len(drawn) // ranges] for k in range(1, ranges)}) if drawn else []
    grams = _shared_grams(texts, length, parts)
    names = grams.groupBy(F.col("owner").alias("id")).agg(F.collect_list("name").alias("names"))
    found = _stretches(texts, names, length, parts, cuts, *_frequent(grams))
    by_id = found.groupBy("id").agg(F.collect_list(F.struct("from", "to")).alias("found"))

    def start():
        def work(part: pa.RecordBatch):
            spans = []
            for row in part.column(3).to_pylist():  # after the text, id and text
                runs: list[list[int]] = []
                for low, high in sorted((s["from"], s["to"]) for s in row or ()):
                    if runs and low <= runs[-1][1]:
                        runs[-1][1] = max(runs[-1][1], high)
                    else:
                        runs.append([low, high])
                spans.append([{"from": a, "to": b} for a, b in runs])
            return {"spans": pa.array(spans, pa.list_(pa.struct([("from", pa.int32()), ("to", pa.int32())])))}

        return work

    joined = texts.join(by_id, "id", "left")
    alone = every.where("id is null").withColumn("found", F.lit(None).cast("array<struct<from:int,to:int>>"))
    whole = joined.select("id", "text", "found").unionByName(alone)
    return add_columns(whole, "text", "spans array<struct<from:int,to:int>>", start).select(
        F.col("id").alias(id_col), F.col("text").alias(text_col), "spans"
    )


def remove_spans(found: DataFrame, text_col: str = "text") -> DataFrame:
    """``found`` with ``kept``, the bytes of the text outside its ``spans``."""
    names = [name for name in found.columns if name.lower() != "kept"]
    where = 1 + names.index("spans")

    def start():
        def work(part: pa.RecordBatch):
            kept = []
            for text, spans in zip(part.column(0).to_pylist(), part.column(where).to_pylist()):
                data, pieces, at = (text or "").encode(), [], 0
                for span in spans or ():
                    pieces.append(data[at : span["from"]])
                    at = span["to"]
                kept.append(b"".join([*pieces, data[at:]]))
            return {"kept": packed(kept)}

        return work

    return add_columns(found, text_col, "kept binary", start)
