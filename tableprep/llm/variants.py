"""Spelling variants by PartEnum signatures over letter multisets.

A word is taken as the set of its letters with their numbers (``e1``, ``e2``, ``n1`` ...), a binary vector.
One replaced letter changes two places of it, one inserted letter one. PartEnum (Arasu, Ganti, Kaushik:
Efficient exact set-similarity joins, VLDB 2006) parts the places and enumerates which parts may differ:
with ``PARTS`` groups of letters, two words of one length agree in all groups but at most two, words whose
lengths differ by one in all but one. Each choice of groups left out is a signature, the letters of the other
groups; an equi-join on signatures finds all pairs, and the edit distance verifies them. A pair is
verified once, below the first signature that it shares, and words with the same letters never are.

A signature that more than ``hot`` words share is joined on the signature and the word without one of its letters
instead, which is exact as well: so no signature puts out all pairs of its words.

Cases: null and empty texts have no words; texts are read whole; words, ties and repeated rows are counted as
often as they stand there; a null id counts as an empty one; an empty table gives no words; other columns are not looked at.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tableprep.scratch import written

#: Groups of letters. More groups make more signatures, which fewer words share.
PARTS = 6
#: A signature of more words than this is joined on the words without a letter too.
HOT = 1000
# Upper and lower case, and what a word is made of.
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD = "[A-Za-zÀ-ÿ]+"


def without(word: Column, place: Column) -> Column:
    """``word`` without the character at ``place``, from 1."""
    return F.concat(F.substring(word, F.lit(1), place - 1), F.substring(word, place + 1, F.length(word)))


def runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All runs of letters, A-Z in lower case, with their ``id`` as text; a row for each place."""
    text = F.translate(F.col(text_col).cast("string"), _UPPER, _LOWER)
    return docs.select(
        F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.explode(F.regexp_extract_all(text, F.lit(WORD), 0)).alias("run")
    )


def drop_letters(found: DataFrame, every: int) -> DataFrame:
    """Runs with one letter taken out where ``every`` divides the hash of id and run: misspelt words for tests of grouping."""
    h = F.crc32(F.concat_ws(":", "id", "run"))
    place = (h % F.length("run")).cast("int") + 1
    return found.select("id", F.when(h % every == 0, without(F.col("run"), place)).otherwise(F.col("run")).alias("run"))


def count_words(found: DataFrame, least_length: int = 6, least_count: int = 5) -> DataFrame:
    """``word`` and ``n`` of the runs that are long and frequent enough."""
    counted = found.where(F.length("run") >= least_length).groupBy(F.col("run").alias("word")).agg(F.count("*").alias("n"))
    return counted.where(F.col("n") >= least_count)


def letter_groups(words: DataFrame, parts: int = PARTS) -> list[str]:
    """The letters of the words dealt to groups, the frequent ones evenly."""
    letters = words.select(F.explode(F.split("word", "")).alias("letter")).where("letter <> ''").groupBy("letter").count()
    # As many rows as there are letters.
    order = [row.letter for row in letters.orderBy(F.desc("count"), "letter").collect()]
    groups = [""] * parts
    for i, letter in enumerate(order):
        turn, at = divmod(i, parts)
        groups[at if turn % 2 == 0 else parts - 1 - at] += letter
    return groups


def _with_groups(words: DataFrame, groups: list[str]) -> DataFrame:
    """Words with the sorted letters of each group, as columns ``g0``, ``g1`` and so on."""
    letters = F.array_join(F.array_sort(F.split("word", "")), "")
    every = "".join(groups)
    state = words.select("word", "n", letters.alias("letters"))
    taken = [F.translate("letters", "".join(c for c in every if c not in group), "").alias(f"g{k}") for k, group in enumerate(groups)]
    return state.select("word", "n", *taken)


def _keys(state: DataFrame, parts: int, left_out: int, size: Column) -> DataFrame:
    """A row for each word and choice of ``left_out`` groups: the signature, the choice and the letters left out."""
    rows = []
    for k, choice in enumerate(combinations(range(parts), left_out)):
        kept = [F.col(f"g{i}") for i in range(parts) if i not in choice]
        rest = [F.col(f"g{i}") for i in choice] if left_out == 2 else [F.lit(""), F.lit("")]
        rows.append(F.struct(
            F.xxhash64(F.lit(left_out), F.lit(k), size, *kept).alias("signature"), F.lit(choice[0]).alias("i"), F.lit(choice[-1]).alias("j"),
            rest[0].alias("x"), rest[1].alias("y"),
        ))
    return state.select("word", "n", F.inline(F.array(*rows)))


def _renamed(keys: DataFrame, on: list[str]) -> DataFrame:
    return keys.select(*on, *(F.col(c).alias(f"{c}2") for c in ("word", "n", "x", "y")))


def _same_length(keys: DataFrame, on: list[str]) -> DataFrame:
    """Pairs below the first signature they share: the groups left out are those that differ."""
    pairs = keys.select(*on, "i", "j", "word", "n", "x", "y").join(_renamed(keys, on), on).where("word < word2")
    first, second = F.col("x") != F.col("x2"), F.col("y") != F.col("y2")
    once = (first & second) | (first & ~second & (F.col("j") == 1)) | (second & ~first & (F.col("i") == 0))
    return pairs.where(once)


def _next_length(shorter: DataFrame, longer: DataFrame, on: list[str]) -> DataFrame:
    return shorter.select(*on, "word", "n").join(_renamed(longer, on), on)


def _large(keys: list[DataFrame], hot: int) -> DataFrame | None:
    """Signatures of more than ``hot`` words; None if there are none."""
    counted = reduce(DataFrame.unionAll, [k.select("signature") for k in keys]).groupBy("signature").count()
    large = written(counted.where(F.col("count") > hot).select("signature"), "large")
    return None if large.isEmpty() else large


def near_words(words: DataFrame, parts: int = PARTS, hot: int = HOT) -> DataFrame:
    """All pairs of words (``word``, ``n``, ``word2``, ``n2``) that one inserted, deleted or replaced letter parts.

    ``words`` has distinct ``word`` and their count ``n``. Each pair is there once.
    """
    state = _with_groups(words, letter_groups(words, parts))
    size = F.length("word")
    same, shorter, longer = _keys(state, parts, 2, size), _keys(state, parts, 1, size), _keys(state, parts, 1, size - 1)
    found, on = [], ["signature"]
    for keys, join in (([same], _same_length), ([shorter, longer], _next_length)):
        large = _large(keys, hot)
        if large is not None:
            inside = [side.join(large, on, "left_semi") for side in keys]
            keys = [side.join(large, on, "left_anti") for side in keys]
            places = F.transform(F.sequence(F.lit(1), F.length("word")), lambda p: F.struct(p.alias("at"), without(F.col("word"), p).alias("left")))
            if len(inside) == 1:  # both words without the letter at the same place
                cut = [inside[0].select("*", F.inline(places))]
            else:
                left = F.array_distinct(F.transform(places, lambda p: p["left"]))
                cut = [inside[0].withColumn("left", F.col("word")), inside[1].select("*", F.explode(left).alias("left"))]
            finer = ["signature", "at", "left"] if len(inside) == 1 else ["signature", "left"]
            found.append(join(*cut, finer))
        found.append(join(*keys, on))
    pairs = reduce(DataFrame.unionAll, [f.select("word", "n", "word2", "n2") for f in found])
    return pairs.where(F.levenshtein("word", "word2", 1) == 1)


def spelling_forms(words: DataFrame, parts: int = PARTS, hot: int = HOT, times: int = 5) -> DataFrame:
    """Each word with ``form``, its near word of largest count if that is ``times`` its own, and ``root``.

    Of near words with one count the first by name counts. ``root`` follows forms to the last one; ``n_near``
    counts the near words, ``form_n`` is the form's count.
    """
    words = written(words.select("word", F.col("n").cast("bigint").alias("n")), "words")
    pairs = near_words(words, parts, hot)
    both = pairs.unionAll(pairs.select(F.col("word2").alias("word"), F.col("n2").alias("n"), F.col("word").alias("word2"), F.col("n").alias("n2")))
    best = both.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("n2")).alias("n"), F.col("word2").alias("word"))).alias("best"))
    likely = -F.col("best.n") >= times * F.col("n")
    forms = written(words.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0).cast("bigint")).alias("n_near"),
        F.when(likely, F.col("best.word")).alias("form"), F.when(likely, -F.col("best.n")).alias("form_n"),
    ), "forms")
    # Counts rise by `times` with each step, so chains are short, and doubling the steps soon ends.
    links = forms.where("form is not null").select("word", F.col("form").alias("root"))
    while True:
        onward = links.select(F.col("word").alias("root"), F.col("root").alias("onward"))
        links = written(links.join(onward, "root", "left").select("word", F.coalesce("onward", "root").alias("root"), F.col("onward").isNotNull().alias("moved")), "roots")
        if links.where("moved").isEmpty():
            break
        links = links.select("word", "root")
    return forms.join(links.select("word", "root"), "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )
