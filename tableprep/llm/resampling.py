"""Importance resampling towards a target: which documents look like the target's texts, drawn without replacement.

Each run of words is a feature, hashed to a bucket. The gain of a bucket is the log ratio of its smoothed rate in the
target and in the source; a document's weight is the mean gain of its features. Gumbel noise from a hash
of the id makes the highest scores a draw in proportion to the weights (Xie et al.: Data selection for language
models via importance resampling, NeurIPS 2023).

Features are counted by batch concatenation: the texts of a slice are joined with a line feed between them, one pass
of a pattern finds all words, the documents of the words are looked up in the sorted offsets, which masks runs over two documents,
and the buckets are counted at once.

Cases: null and empty texts have no words, weight 0, and are not drawn; texts are read whole; repeated rows count and are
drawn each; ties go to the smaller id, null ids last; an empty table or target gives gains from what is there;
other columns are kept, but those with a new column's name (in any case) are replaced.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tableprep.llm.arrow import add_columns, bounded_batches, slices, tidy
from tableprep.llm.words import LOWER
from tableprep.scratch import written

_LOWER = LOWER.tobytes()
#: Letters and digits of ASCII, and all other characters beyond it, as bytes of UTF-8 in lower case.
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")


def features(texts: pa.Array, low: int, high: int, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of all features of a slice's texts, the text number of each feature, and the words of each text."""
    pieces = pc.fill_null(texts.cast(pa.large_binary()), b"").to_pylist()
    begins = np.concatenate([[0], np.cumsum([len(p) + 1 for p in pieces])])
    found = list(WORD.finditer(b"\n".join(pieces).translate(_LOWER)))
    starts = np.fromiter((m.start() for m in found), np.int64, len(found))
    words = [m.group() for m in found]
    owner = np.searchsorted(begins, starts, "right") - 1
    hashes, made, owners = [zlib.crc32(w) for w in words], [], []
    for n in range(1, high + 1):
        if n > 1:  # a run's hash goes on from that of its beginning
            hashes = [zlib.crc32(w, zlib.crc32(b" ", h)) for h, w in zip(hashes, words[n - 1 :])]
        if n >= low and len(hashes):
            inside = owner[: len(hashes)] == owner[n - 1 :]
            made.append(np.array(hashes, np.int64)[inside] % buckets)
            owners.append(owner[: len(hashes)][inside])
    none = np.empty(0, np.int64)
    return np.concatenate([none, *made]), np.concatenate([none, *owners]), np.bincount(owner, minlength=len(pieces))


def count_features(docs: DataFrame, text_col: str = "text", low: int = 1, high: int = 1, buckets: int = 10_000) -> np.ndarray:
    """How often the features of all texts fall into each bucket. Each task counts on its own first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for part in slices(batches):
            total += np.bincount(features(part.column(0), low, high, buckets)[0], minlength=buckets)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], ["bucket", "n"])

    bounded_batches(docs.sparkSession)
    counted = docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(tidy(run), "bucket bigint, n bigint")
    found = counted.groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()  # a row for each bucket at most
    out = np.zeros(buckets, np.int64)
    out[found["bucket"].to_numpy()] = found["n"].to_numpy()
    return out


def gains(target: np.ndarray, source: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of each bucket's rates, rounded down."""
    t, s, b = target.astype(np.float64), source.astype(np.float64), len(target)
    return np.floor(1000 * np.log((t + 1) * (s.sum() + b) / ((s + 1) * (t.sum() + b)))).astype(np.int64)


def weigh(docs: DataFrame, gain: np.ndarray, text_col: str = "text", low: int = 1, high: int = 1) -> DataFrame:
    """``docs`` with ``n_words``, ``n_features`` and ``weight``, the mean gain of the features, rounded down (0 without any)."""
    shared = docs.sparkSession.sparkContext.broadcast(gain)  # as long as there are buckets

    def start():
        gain = shared.value

        def work(part: pa.RecordBatch):
            bucket, owner, words = features(part.column(0), low, high, len(gain))
            n = np.bincount(owner, minlength=part.num_rows)
            # Sums of whole numbers below 2**53 are exact in doubles.
            total = np.bincount(owner, weights=gain[bucket], minlength=part.num_rows).astype(np.int64)
            return {"n_words": words, "n_features": n, "weight": total // np.maximum(n, 1)}

        return work

    return add_columns(docs, text_col, "n_words bigint, n_features bigint, weight bigint", start)


def draw(weighed: DataFrame, id_col: str = "doc_id", percent: int = 10, least_words: int = 20, seed: int = 2024) -> DataFrame:
    """``weighed`` with ``score`` and ``rank``: the highest scores of the rows with enough words, null where not drawn.

    There are few different scores (whole numbers within some ten thousand, whatever the number of rows), so ranks come
    from a count by score, and only the drawn rows are sorted, those of each score on their own.
    """
    h = F.conv(F.substring(F.sha2(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256), 1, 8), 16, 10)
    noise = F.floor(-1000 * F.log(-F.log((h.cast("double") + 0.5) / 4294967296.0)))
    kept = weighed.drop("score", "rank")
    scored = written(kept.withColumns({"score": F.col("weight") + noise}), "scored")
    counts = scored.where(F.col("n_words") >= least_words).groupBy("score").agg(F.count("*").alias("n"))
    above = Window.orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    # A row for each score: bounded, so one task may add them up.
    starts = counts.select(
        "score", F.coalesce(F.sum("n").over(above), F.lit(0)).alias("__before"), F.floor(F.sum("n").over(everything) * percent / 100).alias("__drawn")
    ).where("__before < __drawn")
    enough = F.col("n_words") >= least_words
    marked = scored.join(starts.withColumnRenamed("score", "__score"), enough & (F.col("score") == F.col("__score")), "left")
    place = Window.partitionBy("__score").orderBy(F.col(id_col).asc_nulls_last())
    rank = F.col("__before") + F.row_number().over(place)
    likely = marked.where("__score is not null").withColumn("rank", rank)
    likely = likely.withColumn("rank", F.when(F.col("rank") <= F.col("__drawn"), F.col("rank")))
    rest = marked.where("__score is null").withColumn("rank", F.lit(None).cast("bigint"))
    return likely.unionByName(rest).drop("__score", "__before", "__drawn")


def resample(
    docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text", low: int = 1, high: int = 1,
    buckets: int = 10_000, percent: int = 10, least_words: int = 20, seed: int = 2024, keep_text: bool = True,
) -> DataFrame:
    """``docs`` with ``n_words``, ``n_features``, ``weight``, ``score`` and ``rank`` (null where not drawn).

    The scored rows are written once; without ``keep_text`` they are small, and the result has no texts.
    """
    gain = gains(count_features(target, target_col, low, high, buckets), count_features(docs, text_col, low, high, buckets))
    weighed = weigh(docs, gain, text_col, low, high)
    return draw(weighed if keep_text else weighed.drop(text_col), id_col, percent, least_words, seed)
