"""Which of many hashed names occur with several owners, by packed sorted runs.

A row for each name would cost more to move than the name itself. Here each task sorts the names of many texts, and
sends for each part of the hash range one row: the low halves of the names as differences, and the numbers of their
owners. Parts are merged one by one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tableprep.llm.arrow import bounded_batches, release, slices, tidy

#: Names in one part, about, and names that a task sorts at once.
PART, SORTED = 60_000, 500_000
MAX_PARTS = 32_768

#: From a slice: hashes, the number of the text of each, and the owner of each text.
Make = Callable[[pa.RecordBatch], tuple[np.ndarray, np.ndarray, np.ndarray]]


def parts_for(names: float) -> int:
    return int(min(max(names / PART, 1), MAX_PARTS))


def short_names(hashes: np.ndarray, parts: int) -> np.ndarray:
    """The part of a hash and 32 bits of it, as one number. Unequal hashes with one short name only cost time."""
    part = ((hashes >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)
    return (part << np.uint64(32)) | (hashes & np.uint64(0xFFFFFFFF))


def _row(part: int, *columns: np.ndarray) -> pa.RecordBatch:
    fields = [pa.array([c.tobytes()], pa.binary()) for c in columns]
    return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), *fields], ["part", "low", "owner", "ids"])


def shared_names(texts: DataFrame, make: Make, parts: int) -> DataFrame:
    """``owner`` and ``name`` (:func:`short_names`) for each name that more than one owner has.

    ``texts``: the text first, then what ``make`` needs. Of a name that many owners of a run have, two are
    sent to its part; the others are known to share it and go with any part.
    """

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, names, owners, n = [], [], [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            every, number = np.unique(np.concatenate(ids), return_inverse=True)
            name, owner = np.concatenate(names), number[np.concatenate(owners)]
            order = np.lexsort((owner, name))
            name, owner = name[order], owner[order]
            first = np.ones(len(name), bool)
            first[1:] = (name[1:] != name[:-1]) | (owner[1:] != owner[:-1])
            name, owner = name[first], owner[first]
            third = np.zeros(len(name), bool)
            third[2:] = name[2:] == name[:-2]
            if third.any():
                yield _row(int(every[0]) % parts, name[third], every[owner[third]], np.empty(0, np.int64))
            name, owner = name[~third], owner[~third]
            cuts = np.searchsorted((name >> np.uint64(32)).astype(np.int64), np.arange(parts + 1))
            for k in np.flatnonzero(np.diff(cuts)):
                low = (name[cuts[k] : cuts[k + 1]] & np.uint64(0xFFFFFFFF)).astype(np.uint32)
                used, of = np.unique(owner[cuts[k] : cuts[k + 1]], return_inverse=True)
                of = of.astype(np.uint16 if len(used) < 1 << 16 else np.uint32)
                yield _row(int(k), np.diff(low, prepend=np.uint32(0)), of, every[used])
            ids.clear(), names.clear(), owners.clear()

        for piece in slices(batches):
            hashes, owner, own = make(piece)
            owners.append(owner + sum(map(len, ids)))
            names.append(short_names(hashes, parts))
            ids.append(own)
            n += len(hashes)
            if n > SORTED:
                yield from flush()
                n = 0
        if ids:
            yield from flush()

    def meet(table: pa.Table) -> pa.Table:
        part = np.uint64(table["part"][0].as_py()) << np.uint64(32)
        names, ids, done_names, done_ids = [], [], [], []
        for low, owner, known in zip(table["low"], table["owner"], table["ids"]):
            low, owner, known = (v.as_buffer() for v in (low, owner, known))
            if not len(known):  # known to be shared
                done_names.append(np.frombuffer(low, np.uint64))
                done_ids.append(np.frombuffer(owner, np.int64))
                continue
            low = np.cumsum(np.frombuffer(low, np.uint32), dtype=np.uint32)
            kind = np.uint16 if len(owner) == 2 * len(low) else np.uint32
            names.append(low.astype(np.uint64))
            ids.append(np.frombuffer(known, np.int64)[np.frombuffer(owner, kind)])
        if names:
            name, owner = np.concatenate(names), np.concatenate(ids)
            order = np.lexsort((owner, name))
            name, owner = name[order], owner[order]
            starts = np.flatnonzero(np.concatenate([[True], name[1:] != name[:-1]]))
            group = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(name))))
            last = np.append(starts[1:], len(name)) - 1
            several = (owner[starts] != owner[last])[group]
            again = np.concatenate([[False], (name[1:] == name[:-1]) & (owner[1:] == owner[:-1])])
            done_names.append(name[several & ~again] | part)
            done_ids.append(owner[several & ~again])
        release()
        return pa.table({
            "owner": pa.array(np.concatenate(done_ids), pa.int64()),
            "name": pa.array(np.concatenate(done_names).view(np.int64), pa.int64()),
        })

    bounded_batches(texts.sparkSession)
    sent = texts.mapInArrow(tidy(runs), "part int, low binary, owner binary, ids binary")
    return sent.groupBy("part").applyInArrow(meet, "owner bigint, name bigint")
