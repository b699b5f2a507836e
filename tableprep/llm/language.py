"""Language by words first, by character n-grams where a word is not known.

After HeLI (Jauhiainen, Linden, Jauhiainen: HeLI, a word-based backoff method for language identification, VarDial 2016).
A word that the model knows scores each language by the log of the word's relative frequency there. A word it does not know is
scored by its character n-grams, the longest that are known in any language, as the mean of their scores, and so on down to
single letters. A text's score is the mean over its words; the best language wins.

Cases: a null text, or one without a letter, is ``und`` with score 0, as is every text when nothing was learnt; ties go to the
language with more texts, then the first by name; texts are read whole; repeated rows are judged each; columns
with the new names (in any case) are replaced.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tableprep.llm.arrow import add_columns, tidy
from tableprep.scratch import written

UNKNOWN = "und"
#: Words: letters, and the marks that belong to them.
WORD = regex.compile(r"\p{L}[\p{L}\p{M}]*")
_WORD_SQL = r"\p{L}[\p{L}\p{M}]*"
_GAPS = {k: " " for k in range(128) if not chr(k).isalpha()}
#: Words a worker remembers the scores of.
REMEMBERED = 200_000
#: Different features that a task counts before it passes them on.
FLUSH = 300_000


@dataclass
class Model:
    """Languages, the most frequent first; the rows in ``scores`` of n-grams by their length, and of words under 0."""

    languages: list[str]
    known: dict[int, dict[str, int]] = field(default_factory=dict)
    scores: np.ndarray = field(default_factory=lambda: np.empty((0, 0)))


def _features(words: DataFrame, longest: int) -> DataFrame:
    """Counts of the words, as of size 0, and of their runs of up to ``longest`` characters between spaces, by language."""

    def rows(counts: Counter) -> pa.RecordBatch:
        size, lang, feature = zip(*counts)
        return pa.RecordBatch.from_arrays(
            [pa.array(size, pa.int32()), pa.array(lang, pa.string()), pa.array(feature, pa.string()), pa.array(counts.values(), pa.int64())],
            ["size", "lang", "feature", "n"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            for lang, word, n in zip(*(column.to_pylist() for column in batch.columns)):
                counts[0, lang, word] += n
                spaced = f" {word} "
                for size in range(1, longest + 1):
                    for k in range(len(spaced) - size + 1):
                        counts[size, lang, spaced[k : k + size]] += n
                if len(counts) > FLUSH:
                    yield rows(counts)
                    counts.clear()
        if counts:
            yield rows(counts)

    made = words.select("lang", "word", "n").mapInArrow(tidy(run), "size int, lang string, feature string, n bigint")
    return made.groupBy("size", "lang", "feature").agg(F.sum("n").alias("n"))


def fit(
    docs: DataFrame, usable: Column | None = None, lang_col: str = "lang", id_col: str = "doc_id", text_col: str = "text",
    max_texts: int = 2000, max_words: int = 20_000, max_grams: int = 10_000, longest: int = 5, alpha: float = 0.5,
) -> Model:
    """Learn from rows with a language, about ``max_texts`` of each, chosen by a hash of id and text.

    ``usable`` is a condition on ``id_col``. The driver gets at most ``max_words`` words and ``max_grams`` n-grams of each length and
    language, the most frequent.
    """
    usable = F.lit(True) if usable is None else usable
    rows = docs.where(usable).where(F.col(lang_col).isNotNull()).select(
        F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"), F.xxhash64(id_col, text_col).alias("h")
    )
    sizes = rows.groupBy("lang").agg(F.count("*").alias("size"))
    order = sizes.orderBy(F.desc("size"), "lang").collect()  # a row for each language
    languages = [row.lang for row in order]
    if not languages:
        return Model([])
    shares = F.create_map(*(F.lit(x) for row in order for x in (row.lang, min(1.0, max_texts / row["size"]))))
    sample = rows.where(F.pmod("h", F.lit(1 << 30)) < shares[F.col("lang")] * float(1 << 30))
    found = sample.select("lang", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(_WORD_SQL), 0)).alias("word"))
    words = found.groupBy("lang", "word").agg(F.count("*").alias("n"))
    features = written(_features(words, longest), "features")
    totals = {(row["size"], row.lang): row.n for row in features.groupBy("size", "lang").agg(F.sum("n").alias("n")).collect()}
    best = Window.partitionBy("size", "lang").orderBy(F.desc("n"), "feature")
    most = F.when(F.col("size") == 0, max_words).otherwise(max_grams)
    chosen = features.withColumn("place", F.row_number().over(best)).where(F.col("place") <= most).select("size", "feature").distinct()
    lists = features.join(chosen, ["size", "feature"]).groupBy("size", "feature").agg(F.collect_list(F.struct("lang", "n")).alias("counts"))
    number = {lang: k for k, lang in enumerate(languages)}
    model = Model(languages, {size: {} for size in range(longest + 1)})
    counts, of_size = [], []
    for row in lists.sort("size", "feature").toArrow().to_pylist():
        model.known[row["size"]][row["feature"]] = len(counts)
        line = [0] * len(languages)
        for c in row["counts"]:
            line[number[c["lang"]]] = c["n"]
        counts.append(line)
        of_size.append(row["size"])
    total = np.array([[totals.get((size, lang), 0) for lang in languages] for size in range(longest + 1)], float)
    total += alpha * np.array([[max(1, len(model.known[size]))] for size in range(longest + 1)])
    model.scores = np.log((np.array(counts, float).reshape(-1, len(languages)) + alpha) / total[np.array(of_size, int)])
    return model


class Scores(dict):
    """The row number in ``table`` of each word's scores; a word that is asked for is added."""

    def __init__(self, model: Model):
        super().__init__()
        self.model, self.rows, self.table = model, [], np.empty((0, len(model.languages)))
        self.filled = 0

    def __missing__(self, word: str) -> int:
        self[word] = at = len(self.rows)
        self.rows.append(score_word(self.model, word))
        return at

    def matrix(self) -> np.ndarray:
        if len(self.table) < len(self.rows):
            # Twice as many rows as are needed: most texts have new words, and each would copy the whole table.
            table = np.empty((2 * len(self.rows), self.table.shape[1]))
            table[: self.filled] = self.table[: self.filled]
            self.table = table
        if self.filled < len(self.rows):
            self.table[self.filled : len(self.rows)] = self.rows[self.filled :]
            self.filled = len(self.rows)
        return self.table[: self.filled]


def score_word(model: Model, word: str) -> np.ndarray:
    """A word's score for each language: its own, else the mean of its longest known n-grams, else NaN."""
    at = model.known[0].get(word)
    if at is not None:
        return model.scores[at]
    spaced = f" {word} "
    for size in range(len(model.known) - 1, 0, -1):
        known = model.known[size]
        found = [at for k in range(len(spaced) - size + 1) if (at := known.get(spaced[k : k + size])) is not None]
        if found:
            return np.add.reduce(model.scores.take(found, axis=0), axis=0) / len(found)
    return np.full(len(model.languages), np.nan)


def words_of(text: str) -> list[str]:
    """The words of a text in lower case; in ASCII they are what stands between other characters."""
    return text.lower().translate(_GAPS).split() if text.isascii() else WORD.findall(text.lower())


def judge(scores: Scores, text: str | None) -> tuple[str, float]:
    """Language and share of it; a text of whole words is judged by its distinct words and their counts."""
    languages = scores.model.languages
    found = words_of(text) if text and languages else []
    if not found:
        return UNKNOWN, 0.0
    rows, counts = np.unique(np.fromiter(map(scores.__getitem__, found), np.int64, len(found)), return_counts=True)
    table = scores.matrix()[rows]
    there = ~np.isnan(table[:, 0])
    n = counts[there]
    mean = n @ table[there] / n.sum() if len(n) else np.zeros(len(languages))
    best = int(np.argmax(mean))
    return languages[best], float(1 / np.exp(mean - mean[best]).sum())


def identify(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score``, the share of the best language when the mean scores of a word are compared."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def start():
        state = [Scores(shared.value)]

        def work(part: pa.RecordBatch):
            if len(state[0]) > REMEMBERED:
                state[0] = Scores(shared.value)
            found = [judge(state[0], text) for text in part.column(0).to_pylist()]
            return {"lang_pred": pa.array([f[0] for f in found], pa.string()), "score": pa.array([f[1] for f in found], pa.float64())}

        return work

    return add_columns(docs, text_col, "lang_pred string, score double", start)
