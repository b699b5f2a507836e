"""Texts as Arrow slices of bounded size: the one way these operators run Python on executors."""

from __future__ import annotations

import ctypes
import functools
import time
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Bytes of text that are worked on at once; a longer single text makes a slice of its own.
SLICE_BYTES = 1 << 20
#: Bytes of a batch between Spark and Python; rows that are longer make a batch of their own.
BATCH_BYTES = 8 << 20


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts in one array, and the offsets of the texts in it; a null is empty."""
    texts = pc.fill_null(texts.cast(pa.large_binary()), b"")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    data = np.empty(0, np.uint8) if data is None else np.frombuffer(data, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batches: Iterable[pa.RecordBatch], column: int = 0, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches so that the texts in one column of a slice have at most ``limit`` bytes together."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        ends, start = np.cumsum(sizes, dtype=np.int64), 0
        while start < len(sizes):
            before = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + limit, "right")))
            yield batch.slice(start, stop - start)
            start = stop


def packed(values: list[bytes] | np.ndarray, offsets: np.ndarray | None = None) -> pa.Array:
    """A binary array, from bytes or from one buffer and its offsets."""
    if offsets is None:
        return pa.array(values, pa.binary())
    return pa.Array.from_buffers(
        pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(values)]
    )


def bounded_batches(spark: SparkSession) -> None:
    """Smaller batches than Spark's own, unless the session asks for still smaller ones.

    A batch is held up to four times over: on its way in and out, on both sides.
    """
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(name, None)
    if now is None or not now.isdigit() or int(now) <= 0 or int(now) > BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))


_released = [0.0]


def release() -> None:
    """Give freed memory back: a worker lives on beside those of later stages. At most once a second."""
    if time.monotonic() - _released[0] > 1:
        _released[0] = time.monotonic()
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except AttributeError:  # only in some C libraries
            pass


def tidy(run: Callable) -> Callable:
    """``run``, a function on batches or on one table, that gives freed memory back when it is done."""

    @functools.wraps(run)
    def wrapped(given):
        try:
            out = run(given)
            if isinstance(out, Iterator):
                return _until_done(out)
            return out
        finally:
            release()

    return wrapped


def _until_done(batches: Iterator) -> Iterator:
    try:
        yield from batches
    finally:
        _released[0] = 0.0
        release()


Work = Callable[[pa.RecordBatch], "dict[str, pa.Array | np.ndarray] | pa.RecordBatch"]


def add_columns(df: DataFrame, text_col: str, added: str, start: Callable[[], Work]) -> DataFrame:
    """``df`` with columns computed from its texts.

    ``added`` is their schema. ``start`` runs once in each task and returns the function that takes
    a slice, whose first column is the text, and returns the new columns by name. A column of
    ``df`` with the name of a new one (in any case) is replaced.
    """
    schema = StructType.fromDDL(added)
    new = {name.lower() for name in schema.names}
    kept = [f for f in df.schema.fields if f.name.lower() not in new]
    # Plain names on the way in: a name with a dot cannot be passed on.
    taken = df.select(F.col(text_col).cast("string").alias("text"), *(F.col(f"`{f.name}`").alias(f"c{i}") for i, f in enumerate(kept)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = start()
        for part in slices(batches):
            columns = work(part)
            yield pa.RecordBatch.from_arrays(
                [*part.columns[1:], *(pa.array(columns[name]) for name in schema.names)],
                [*(f.name for f in kept), *schema.names],
            )

    bounded_batches(df.sparkSession)
    return taken.mapInArrow(tidy(run), StructType([*kept, *schema.fields]))


def rows_of(df: DataFrame, text_col: str, others: list, made: str, start: Callable[[], Work]) -> DataFrame:
    """New rows of schema ``made`` computed from slices: the text first, then ``others``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = start()
        for part in slices(batches):
            out = work(part)
            if out is not None and out.num_rows:
                yield out

    bounded_batches(df.sparkSession)
    return df.select(F.col(text_col).cast("string").alias("__text"), *others).mapInArrow(tidy(run), made)
