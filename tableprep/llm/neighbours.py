"""Nearest neighbours by collision counting on sorted projections.

Each block of vectors is indexed by arrays of its rows sorted by their projections on random directions, one array
for each direction. A query opens a window around its own projection in every array; a row in the window collides.
Windows widen by virtual rehashing (radius times ``growth``) and only the rows that are new in them are counted.
A row within the radius collides in each array with the same chance; rows with as many collisions as such rows have
but for ``safety`` standard deviations are verified on the original vectors. A query ends in a block when as many rows as
wanted are verified within the radius, or all rows are.
(C2LSH, Gan et al., SIGMOD 2012; QALSH, Huang et al., VLDB 2015.)

Queries are sent to the tasks in blocks of bounded size, each of which passes over the index once. Every row is indexed.

Cases: vectors that are null, empty, zero, or hold a null or a component that isn't finite take no part, as queries or
rows; a query meets only rows of its own length; ties go to the smaller id; rows with the same id are rows of their own,
but none of them is a neighbour of a query with that id; a row without id takes no part; with fewer rows than wanted all are
returned; an empty table gives an empty one; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import erf, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tableprep.scratch import written

#: Rows of an index block, and queries sent at once.
BLOCK, QUERIES = 8192, 4096


def _directions(size: int, arrays: int, seed: int) -> np.ndarray:
    return np.random.default_rng([seed, size]).standard_normal((size, arrays))


def build_index(vectors: DataFrame, id_col: str, vector_col: str, arrays: int, seed: int) -> DataFrame:
    """One row for each block: ``dim``, ``ids``, ``vectors`` (doubles), ``order`` and ``projected`` of all arrays, packed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}

        def block(size: int) -> pa.RecordBatch:
            ids, rows = (np.concatenate(c) for c in zip(*waiting.pop(size)))
            projected = rows @ _directions(size, arrays, seed)
            order = np.argsort(projected, axis=0, kind="stable")
            packed = ids, rows, order.T.astype(np.uint16), np.take_along_axis(projected, order, axis=0).T.astype(np.float32)
            return pa.RecordBatch.from_arrays(
                [pa.array([size], pa.int32()), *(pa.array([np.ascontiguousarray(c).tobytes()], pa.binary()) for c in packed)],
                ["dim", "ids", "vectors", "order", "projected"],
            )

        for batch in batches:
            ids, lists = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1)
            ends = lists.offsets.to_numpy()
            sizes, values = np.diff(ends), lists.flatten().to_numpy(zero_copy_only=False)
            for size in np.unique(sizes):
                of = np.flatnonzero(sizes == size)
                rows = values[(ends[of] - ends[0])[:, None] + np.arange(size)].astype(np.float64)
                for at in range(0, len(of), BLOCK):
                    part = slice(at, at + BLOCK)
                    held = waiting.setdefault(int(size), [])
                    if sum(len(i) for i, _ in held) + len(of[part]) > BLOCK:
                        yield block(int(size))
                    waiting.setdefault(int(size), []).append((ids[of[part]], rows[part]))
        for size in list(waiting):
            yield block(size)

    made = "dim int, ids binary, vectors binary, order binary, projected binary"
    return usable(vectors, id_col, vector_col).mapInArrow(run, made)


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``id`` and ``vector`` (doubles) of the rows that take part."""
    rows = vectors.select(F.col(id_col).cast("bigint").alias("id"), F.col(vector_col).cast("array<double>").alias("vector"))
    rows = rows.where("id is not null and size(vector) > 0")
    bad = F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return rows.where(~bad & F.exists("vector", lambda x: x != 0))


def _search_block(row: dict, queries: tuple[np.ndarray, np.ndarray], wanted: int, settings: dict) -> Iterator[tuple]:
    """(query id, ids, distances) of the nearest verified rows of one index block."""
    ids = np.frombuffer(row["ids"], np.int64)
    n, size, arrays = len(ids), row["dim"], settings["arrays"]
    vectors = np.frombuffer(row["vectors"], np.float64).reshape(n, size)
    order = np.frombuffer(row["order"], np.uint16).reshape(arrays, n)
    projected = np.frombuffer(row["projected"], np.float32).reshape(arrays, n)
    query_ids, points = queries
    centres = (points @ _directions(size, arrays, settings["seed"])).astype(np.float32)
    chance = erf(settings["width"] / sqrt(2))  # a projection of a gap of length r is normal with deviation r
    least = arrays * chance - settings["safety"] * sqrt(arrays * chance * (1 - chance))
    for query, point, centre in zip(query_ids, points, centres):
        counts = np.zeros(n, np.uint16)
        seen = np.zeros(n, bool)
        seen[ids == query] = True
        found, far = [np.empty(0, np.int64)], [np.empty(0)]
        middle = np.array([np.searchsorted(projected[k], centre[k]) for k in range(arrays)])
        low, high = middle.copy(), middle.copy()
        radius, n_found = settings["radius"] * float(np.linalg.norm(point)), 0
        while True:
            half = radius * settings["width"]
            for k in range(arrays):  # the windows widen to both sides
                line, rows = projected[k], order[k]
                new_low = np.searchsorted(line[: low[k]], centre[k] - half)
                new_high = high[k] + np.searchsorted(line[high[k] :], centre[k] + half, "right")
                counts[rows[new_low : low[k]]] += 1
                counts[rows[high[k] : new_high]] += 1
                low[k], high[k] = new_low, new_high
            new = np.flatnonzero((counts >= least) & ~seen)
            if len(new):
                seen[new] = True
                gap = vectors[new] - point
                found.append(new)
                far.append(np.sqrt(np.einsum("ij,ij->i", gap, gap)))
                n_found += len(new)
            if n_found >= wanted and (np.concatenate(far) <= radius).sum() >= wanted:
                break
            if (low == 0).all() and (high == n).all():
                break  # every row collides everywhere
            radius *= settings["growth"]
        rows, distances = np.concatenate(found), np.concatenate(far)
        best = np.lexsort((ids[rows], distances))[:wanted]
        if len(best):
            yield query, ids[rows][best], distances[best]


def nearest(
    vectors: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding",
    arrays: int = 24, radius: float = 0.6, growth: float = 1.1, width: float = 1.0, safety: float = 1.6, seed: int = 17,
) -> DataFrame:
    """The ``k`` nearest rows found for each query: ``query_id``, ``rank``, ``vec_id``, ``score`` (Euclidean distance).

    ``radius`` is the first one, as a share of the query's norm, ``width`` half a window's width by radius.
    """
    spark = vectors.sparkSession
    settings = {"arrays": arrays, "radius": radius, "growth": growth, "width": width, "safety": safety, "seed": seed}
    index = written(build_index(vectors, id_col, vector_col, arrays, seed), "index")
    schema = "query_id bigint, vec_id bigint, score double"
    found = spark.createDataFrame([], schema)
    for block in _query_blocks(usable(queries, id_col, vector_col)):
        shared = spark.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(batch.num_rows):
                    row = {n: batch.column(c)[at] for c, n in enumerate(batch.schema.names)}
                    row = {n: v.as_py() if n == "dim" else v.as_buffer() for n, v in row.items()}
                    if row["dim"] in shared.value:
                        for query, ids, far in _search_block(row, shared.value[row["dim"]], k, settings):
                            yield pa.RecordBatch.from_arrays(
                                [pa.array(np.full(len(ids), query)), pa.array(ids), pa.array(far)], ["query_id", "vec_id", "score"]
                            )

        found = found.unionAll(index.mapInArrow(run, schema))
    nearest_first = Window.partitionBy("query_id").orderBy("score", "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(nearest_first)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def _query_blocks(queries: DataFrame) -> Iterator[dict[int, tuple[np.ndarray, np.ndarray]]]:
    """Queries by their length, at most :data:`QUERIES` at once on the driver."""

    def by_length(rows: list) -> dict[int, tuple[np.ndarray, np.ndarray]]:
        lengths = {len(r.vector) for r in rows}
        return {
            n: (np.array([r.id for r in rows if len(r.vector) == n]), np.array([r.vector for r in rows if len(r.vector) == n]))
            for n in lengths
        }

    held: list = []
    for row in queries.toLocalIterator():
        held.append(row)
        if len(held) == QUERIES:
            yield by_length(held)
            held = []
    if held:
        yield by_length(held)
