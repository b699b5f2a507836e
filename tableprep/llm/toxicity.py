"""Toxicity by learning from positive and unlabelled texts with a non-negative risk.

Confirmed toxic texts are the positives; all other texts are unlabelled, and a known share of them (the
class prior) is toxic too. A linear model over hashed words minimises the risk of Kiryo et al.
(NIPS 2017): ``prior * P(loss as positive) + max(0, U(loss as negative) - prior * P(loss as negative))``.

Cases: null and empty texts have no words and get the score of the intercept; texts are read whole;
repeated rows are scored each, ties get equal scores; without positives or texts the model is the
constant prior (0 without labels); a null label confirms nothing; columns named like the new ones are
replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tableprep.llm.arrow import add_columns, text_bytes
from tableprep.llm.words import NOT_ALPHANUMERIC, word_hashes
from tableprep.scratch import written

#: Hashed words a model can tell apart.
BUCKETS = 1 << 18


@dataclass
class Model:
    """``weights`` by hashed word, ``intercept``, and the class ``prior`` it was fitted with."""

    weights: np.ndarray
    intercept: float
    prior: float


def _word_sets(part: pa.RecordBatch, wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashed words of each text of a slice and the offsets; of the wanted ones only, if given."""
    words, owner = word_hashes(*text_bytes(part.column(0)), NOT_ALPHANUMERIC)
    bucket = (words % np.uint64(BUCKETS)).astype(np.int64)
    if wanted is not None:
        keep = wanted[bucket]
        bucket, owner = bucket[keep], owner[keep]
    pairs = np.unique(owner * BUCKETS + bucket)
    counts = np.bincount(pairs // BUCKETS, minlength=part.num_rows)
    return pairs % BUCKETS, np.concatenate([[0], np.cumsum(counts)])


def _share(ids: Column, share: float) -> Column:
    """A fixed part of the ids, by hash."""
    return F.pmod(F.xxhash64(ids.cast("string"), F.lit("sample")), F.lit(1_000_000)) < int(share * 1_000_000)


def nnpu(buckets: np.ndarray, offsets: np.ndarray, positive: np.ndarray, prior: float, rounds: int = 80, l2: float = 2e-4):
    """Weights and intercept for rows of distinct columns ``0..``; Adam on the whole sample."""
    width = int(buckets.max()) + 1 if len(buckets) else 1
    w = np.zeros(width + 1)  # the intercept comes last
    w[-1] = np.log(prior / (1 - prior))
    p, u = max(1, positive.sum()), max(1, (~positive).sum())
    m, v = np.zeros_like(w), np.zeros_like(w)
    lengths = np.diff(offsets)
    row = np.repeat(np.arange(len(lengths)), lengths)
    for step in range(1, rounds + 1):
        z = np.bincount(row, weights=w[buckets], minlength=len(lengths)) + w[-1]
        chance = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        as_negative = np.logaddexp(0, z)
        rest = as_negative[~positive].sum() / u - prior * as_negative[positive].sum() / p
        # Slopes of the losses: chance - 1 as positive, chance as negative.
        if rest >= 0:
            slope = np.where(positive, (prior * (chance - 1) - prior * chance) / p, chance / u)
        else:  # the estimate went below what a risk can be: step back up
            slope = np.where(positive, prior * chance / p, -chance / u)
        grad = np.append(np.bincount(buckets, weights=slope[row], minlength=width), slope.sum())
        grad[:-1] += l2 * w[:-1]
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        w -= 0.25 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-9)
    return w[:-1], w[-1]


def fit(
    docs: DataFrame, labels: DataFrame, usable: Column | None = None, label_col: str = "toxic", id_col: str = "doc_id",
    text_col: str = "text", max_positive: int = 4000, max_unlabelled: int = 8000, n_words: int = 2048,
    least_z: float = 3.0,
) -> Model:
    """Fit on at most about ``max_positive`` confirmed and ``max_unlabelled`` other texts, chosen by hash.

    ``usable`` is a condition on ``id_col``; labels and texts of other rows are not looked at. The driver
    gets at most ``n_words`` column numbers a text.
    """
    usable = F.lit(True) if usable is None else usable
    marks = labels.where(usable).where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
    toxic = F.sum(F.col(label_col).cast("int").cast("bigint"))
    known, positives = marks.agg(F.count("*"), toxic).first()
    prior = (positives or 0) / known if known else 0.0
    if not positives or positives == known:
        return Model(np.zeros(0), 0.0, prior)
    chosen = marks.where(F.col(label_col) == 1).where(_share(F.col(id_col), max_positive / positives))
    chosen = chosen.select(F.col(id_col).alias("id")).distinct().withColumn("positive", F.lit(True))
    rows = docs.where(usable).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    n = rows.count()
    # `chosen` has about max_positive ids at most: small enough for every task.
    rows = rows.join(F.broadcast(chosen), "id", "left").where(
        F.col("positive") | _share(F.col("id"), max_unlabelled / max(1, n))
    )

    def start():
        def work(part: pa.RecordBatch):
            buckets, offsets = _word_sets(part)
            return {"words": pa.ListArray.from_arrays(offsets.astype(np.int32), buckets.astype(np.int32))}

        return work

    sample = written(add_columns(rows, "text", "words array<int>", start).select("positive", "words"), "toxicity")
    positive = F.coalesce("positive", F.lit(False))
    seen = sample.select(positive.alias("positive"), F.explode("words").alias("word")).groupBy("word").agg(
        F.sum(F.col("positive").cast("int")).alias("p"), F.sum((~F.col("positive")).cast("int")).alias("u")
    )
    sizes = sample.agg(F.sum(positive.cast("int")), F.count("*")).first()
    n_p, n_u = max(1, sizes[0] or 0), max(1, sizes[1] - (sizes[0] or 0))
    rate_p, rate_u = (F.col("p") + 0.5) / (n_p + 1), (F.col("u") + 0.5) / (n_u + 1)
    spread = F.sqrt(rate_p * (1 - rate_p) / n_p + rate_u * (1 - rate_u) / n_u)
    best = seen.withColumn("z", F.abs(rate_p - rate_u) / spread).where(F.col("z") >= least_z).orderBy(F.desc("z"), "word")
    vocabulary = sorted(row.word for row in best.limit(n_words).collect())
    if not vocabulary:
        return Model(np.zeros(0), 0.0, prior)
    kept = sample.select(positive.alias("positive"), F.filter("words", lambda x: x.isin(vocabulary)).alias("words"))
    collected = kept.toArrow()
    lists = collected["words"]
    found = np.searchsorted(vocabulary, pc.list_flatten(lists).to_numpy())
    offsets = np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy())])
    weights, intercept = nnpu(found, offsets, collected["positive"].to_numpy(), prior)
    full = np.zeros(BUCKETS, np.float64)
    full[vocabulary] = weights
    return Model(full, float(intercept), prior)


def score(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` with ``toxicity``, the chance (0 to 1) that the text is toxic."""
    if not len(model.weights):
        return docs.withColumn("toxicity", F.lit(float(model.prior)))
    used = np.flatnonzero(model.weights)
    shared = docs.sparkSession.sparkContext.broadcast((used, model.weights[used], model.intercept))

    def start():
        places, values, intercept = shared.value
        weights = np.zeros(BUCKETS)
        weights[places] = values

        def work(part: pa.RecordBatch):
            buckets, offsets = _word_sets(part, weights != 0)
            row = np.repeat(np.arange(part.num_rows), np.diff(offsets))
            z = np.bincount(row, weights=weights[buckets], minlength=part.num_rows) + intercept
            return {"toxicity": 1 / (1 + np.exp(-np.clip(z, -30, 30)))}

        return work

    return add_columns(docs, text_col, "toxicity double", start)
