"""Quality by hierarchical empirical Bayes: what a classifier says about a text, and what is known of its host and path.

Boosted trees on simple features of the whole text, fitted on a bounded sample of labelled rows, give each text's chance to be
good. Grouped aggregation counts, for each path and host, the good texts: labels where known, chances
elsewhere. A host's rate is shrunk towards the global one, a path's towards its host's, each with a strength that the
method of moments takes from the spread of the rates themselves, so sites with few texts get almost the prior.
A text's score combines the odds of its path, counted without the text itself, with the evidence of its classifier.

Cases: null and empty texts have all features zero; texts are read whole; null hosts and paths are sites named by the
empty string; repeated rows count each and get equal scores; a row labelled more than once takes its lowest label; labels other
than 0 and 1 count as unknown; with no or only one label known the classifier is the constant share; an empty table
gives an empty one; columns named like the new ones are replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tableprep.llm.arrow import add_columns, text_bytes
from tableprep.llm.boosting import Boosted
from tableprep.llm.words import distinct, word_hashes
from tableprep.scratch import written

_BYTES = np.arange(256)
_UPPER = (_BYTES >= 65) & (_BYTES <= 90)
_LETTER = _UPPER | ((_BYTES >= 97) & (_BYTES <= 122)) | (_BYTES >= 128)
_DIGIT = (_BYTES >= 48) & (_BYTES <= 57)
_MARK = (_BYTES > 32) & (_BYTES < 127) & ~_LETTER & ~_DIGIT
_LINE_END = _BYTES == 10
#: Spread of rates that shrinking may assume: strengths in numbers of texts.
STRENGTHS = (1.0, 1e6)


def features(texts: pa.Array) -> np.ndarray:
    """One row of numbers for each text."""
    data, offsets = text_bytes(texts)
    n = len(texts)
    sizes = np.diff(offsets)

    def count(table: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(table[data])])
        return (sums[offsets[1:]] - sums[offsets[:-1]]).astype(float)

    words, owner = word_hashes(data, offsets)
    n_words = np.bincount(owner, minlength=n).astype(float)
    kinds = np.diff(distinct(words, owner, n)[1])
    again = np.zeros(len(words), bool)
    again[1:] = (words[1:] == words[:-1]) & (owner[1:] == owner[:-1])
    lines, line_owner = word_hashes(data, offsets, _LINE_END)
    n_lines = np.bincount(line_owner, minlength=n).astype(float)
    line_kinds = np.diff(distinct(lines, line_owner, n)[1])
    over = lambda a, b: a / np.maximum(b, 1)
    letters = count(_LETTER)
    return np.stack([
        np.log1p(sizes), over(letters, sizes), over(count(_MARK), sizes), over(count(_DIGIT), sizes),
        over(count(_UPPER), letters), over(sizes, n_words), over(kinds, n_words),
        over(np.bincount(owner[again], minlength=n), n_words), over(line_kinds, n_lines), over(n_words, n_lines),
    ], axis=1)


def fit(
    docs: DataFrame, labels: DataFrame, usable: Column | None = None, label_col: str = "quality", id_col: str = "doc_id",
    text_col: str = "text", max_rows: int = 20_000,
) -> tuple[Boosted | None, float]:
    """A classifier from about ``max_rows`` labelled texts, chosen by hash, and the share of good ones among them.

    ``usable`` is a condition on ``id_col``.
    """
    known = _known(labels, usable, label_col, id_col)
    n = known.count()
    chosen = known.where(F.pmod(F.xxhash64(id_col, F.lit("quality")), F.lit(1_000_000)) < int(1_000_000 * min(1, max_rows / max(1, n))))
    # `chosen` has about max_rows rows at most: small enough for every task.
    rows = docs.select(F.col(id_col), F.col(text_col).alias("text")).join(F.broadcast(chosen), id_col)

    def start():
        return lambda part: {"x": pa.array(list(features(part.column(0))), pa.list_(pa.float64()))}

    drawn = add_columns(rows, "text", "x array<double>", start).select(F.col("__label").alias("y"), "x").collect()
    y = np.array([row.y for row in drawn], float)
    share = float((y.sum() + 1) / (len(y) + 2))
    if not len(y) or y.min() == y.max():
        return None, share
    return Boosted(rounds=60, l2=4.0, least=10).fit(np.array([row.x for row in drawn]), y), share


def _known(labels: DataFrame, usable: Column | None, label_col: str, id_col: str) -> DataFrame:
    rows = labels if usable is None else labels.where(usable)
    rows = rows.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull())
    return rows.groupBy(id_col).agg(F.min(F.col(label_col).cast("int")).alias("__label"))


def _odds(chance: Column) -> Column:
    kept = F.least(F.greatest(chance, F.lit(1e-6)), F.lit(1 - 1e-6))
    return F.log(kept / (1 - kept))


def _strength(spread: float, noise: float, weight: float) -> float:
    """How many texts a prior is worth: the method of moments for rates of groups (Kleinman, JASA 1973)."""
    share = min(max((spread - noise) / weight if weight > 0 else 0.0, 1e-9), 1.0)
    return float(min(max(1 / share - 1, STRENGTHS[0]), STRENGTHS[1]))


def score(
    docs: DataFrame, labels: DataFrame, model: tuple[Boosted | None, float], host: Column, path: Column,
    usable: Column | None = None, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """``id_col``, ``host``, ``path``, ``evidence`` (the classifier's chance), ``site`` (the path's rate, shrunk) and ``quality``."""
    trees, share = model
    shared = docs.sparkSession.sparkContext.broadcast(trees)

    def start():
        def work(part: pa.RecordBatch):
            x = features(part.column(0))
            return {"evidence": shared.value.predict(x) if shared.value else np.full(len(x), share)}

        return work

    named = docs.select(
        F.col(id_col), F.col(text_col).alias("text"), F.coalesce(host.cast("string"), F.lit("")).alias("host"),
        F.coalesce(path.cast("string"), F.lit("")).alias("path"),
    )
    judged = add_columns(named, "text", "evidence double", start).select(id_col, "host", "path", "evidence")
    known = _known(labels, usable, label_col, id_col)
    rows = judged.join(known, id_col, "left").withColumn("good", F.coalesce(F.col("__label").cast("double"), "evidence"))
    rows = written(rows.drop("__label"), "quality")

    paths = rows.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum("good").alias("s"))
    hosts = paths.groupBy("host").agg(
        F.sum("n").alias("host_n"), F.sum("s").alias("host_s"), F.count("*").alias("paths"),
        F.sum(F.col("n").cast("double") * F.col("n")).alias("squares"), F.sum(F.col("s") * F.col("s") / F.col("n")).alias("within"),
    )
    rate = F.col("host_s") / F.col("host_n")
    total = hosts.agg(
        F.sum("host_n").alias("n"), F.sum("host_s").alias("s"), F.count("*").alias("hosts"),
        F.sum(F.col("host_n").cast("double") * F.col("host_n")).alias("squares"), F.sum(F.col("host_s") * rate).alias("between"),
        F.sum(F.col("within") - F.col("host_s") * rate).alias("path_spread"), F.sum((F.col("paths") - 1) * rate * (1 - rate)).alias("path_noise"),
        F.sum(rate * (1 - rate) * (F.col("host_n") - F.col("squares") / F.col("host_n") - (F.col("paths") - 1))).alias("path_weight"),
    ).first()
    if not total.n:
        mean, host_strength, path_strength = share, STRENGTHS[0], STRENGTHS[0]
    else:
        mean = total.s / total.n
        variance = mean * (1 - mean)
        groups = total.hosts - 1
        weight = variance * (total.n - total.squares / total.n - groups)
        host_strength = _strength(total.between - total.s * mean, groups * variance, weight)
        path_strength = _strength(total.path_spread, total.path_noise, total.path_weight)

    sites = paths.join(hosts.select("host", "host_n", "host_s"), "host")
    own = rows.join(sites, ["host", "path"])
    # Counts without the row itself.
    of_host = (F.col("host_s") - F.col("good") + host_strength * mean) / (F.col("host_n") - 1 + host_strength)
    of_path = (F.col("s") - F.col("good") + path_strength * of_host) / (F.col("n") - 1 + path_strength)
    combined = _odds(of_path) + _odds(F.col("evidence")) - _odds(F.lit(share))
    return own.select(
        id_col, "host", "path", "evidence", of_path.alias("site"), (1 / (1 + F.exp(-combined))).alias("quality")
    )
