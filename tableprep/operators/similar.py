"""Similar values: pairs by shared letter pairs, clusters around leaders, best matches in a reference table.

A value's *grams* are its different pairs of neighbouring characters, in lower case, with a space before and after.

``similar_pairs`` joins on a prefix (Chaudhuri, Ganti, Kaushik: A primitive operator for similarity joins in data cleaning,
ICDE 2006): with the grams of each value in one order, the rarest first, two values that are similar enough share one of their first
few. So the join is on rare grams only, and exact. ``best_matches`` does the same with weights.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tableprep.scratch import written


def grams(text: Column) -> Column:
    """The different pairs of neighbouring characters of a text between spaces, in lower case."""
    letters = F.filter(F.split(F.concat(F.lit(" "), F.trim(F.lower(text)), F.lit(" ")), ""), lambda c: c != "")
    pairs = F.zip_with(letters, F.slice(letters, F.lit(2), F.size(letters)), lambda a, b: F.concat(a, b))
    return F.array_distinct(F.filter(pairs, lambda p: p.isNotNull()))


def _values(df: DataFrame, col: str, name: str = "value") -> DataFrame:
    values = df.select(F.trim(F.col(col).cast("string")).alias(name)).where(F.col(name) != "").distinct()
    return values.withColumn("grams", grams(F.col(name)))


def similar_pairs(df: DataFrame, col: str, least: int = 60, strict: int = 90) -> DataFrame:
    """Pairs of distinct values (``first``, ``second``, ``similarity`` from 0 to 1): shared grams by all grams of both.

    The bound in percent is ``strict`` less three for every four characters of the longer value, but not below ``least``: short values must agree
    more. ``first`` is the longer one, of equally long ones the first by name.
    """
    if not 0 < least <= strict <= 100:
        raise ValueError("0 < least <= strict <= 100 must hold")
    values = written(_values(df, col), "values")
    each = values.select("value", F.explode("grams").alias("gram"))
    seen = each.groupBy("gram").agg(F.count("*").alias("seen"))
    ordered = each.join(seen, "gram").groupBy("value").agg(F.array_sort(F.collect_list(F.struct("seen", "gram"))).alias("ordered"))
    state = ordered.select("value", F.length("value").alias("length"), F.col("ordered.gram").alias("grams"), F.size("ordered").alias("n"))
    state = written(state, "grams")
    # Values that share too little are known by the grams that come first, whatever else they hold.
    prefix = F.col("n") - F.ceil(F.col("n") * least / 100).cast("int") + 1
    keys = state.select("*", F.explode(F.slice("grams", F.lit(1), prefix)).alias("key"))
    a, b = (keys.select("key", *(F.col(c).alias(f"{c}_{s}") for c in state.columns)) for s in "ab")
    before = (F.col("length_a") > F.col("length_b")) | ((F.col("length_a") == F.col("length_b")) & (F.col("value_a") < F.col("value_b")))
    pairs = a.join(b, "key").where(before).where(100 * F.least("n_a", "n_b") >= least * F.greatest("n_a", "n_b"))
    shared = F.size(F.array_intersect("grams_a", "grams_b"))
    every = F.col("n_a") + F.col("n_b") - shared
    bound = F.greatest(F.lit(least), F.lit(strict) - F.floor(3 * F.col("length_a") / 4))
    near = pairs.where(100 * shared >= bound * every)
    return near.select(F.col("value_a").alias("first"), F.col("value_b").alias("second"), (shared / every).alias("similarity")).distinct()


def similar_clusters(df: DataFrame, col: str, least: int = 60, strict: int = 90) -> DataFrame:
    """Values grouped around leaders: ``value``, ``canonical`` (the leader) and ``size``; groups of two or more only.

    In the order of :func:`similar_pairs` each value that no earlier leader is similar to becomes a leader, and takes the similar values
    that no leader before it took. All values whose earlier neighbours are decided are decided in one round (Blelloch, Fineman, Shun: Greedy sequential
    maximal independent set and matching are parallel on average, SPAA 2012), so rounds are as many as the longest chain of such decisions.
    """
    pairs = written(similar_pairs(df, col, least, strict), "pairs")
    members, open_pairs = None, pairs.select("first", "second")
    while not open_pairs.isEmpty():
        leaders = open_pairs.select("first").distinct().join(open_pairs.select(F.col("second").alias("first")).distinct(), "first", "left_anti")
        taken = written(open_pairs.join(leaders, "first", "left_semi").select(F.col("second").alias("value")).distinct(), "members")
        members = taken if members is None else members.unionAll(taken)
        left = open_pairs.join(taken.withColumnRenamed("value", "first"), "first", "left_anti")
        open_pairs = written(left.join(taken.withColumnRenamed("value", "second"), "second", "left_anti").select("first", "second"), "open")
    if members is None:
        return pairs.select(F.col("first").alias("value"), F.col("second").alias("canonical"), F.lit(0).cast("bigint").alias("size"))
    # Who is no member is a leader; a member goes to the first of its leaders.
    by_leader = pairs.join(members.withColumnRenamed("value", "first"), "first", "left_anti")
    first = F.min(F.struct((-F.length("first")).alias("length"), F.col("first").alias("name")))
    placed = by_leader.groupBy(F.col("second").alias("value")).agg(first.alias("leader")).select("value", F.col("leader.name").alias("canonical"))
    sizes = placed.groupBy("canonical").agg((F.count("*") + 1).alias("size"))
    every = placed.unionAll(sizes.select(F.col("canonical").alias("value"), "canonical"))
    return every.join(sizes, "canonical").select("value", "canonical", "size")


def best_matches(df: DataFrame, col: str, ref: DataFrame, ref_col: str, least: float = 0.5) -> DataFrame:
    """The most similar reference value of each distinct value: ``value``, ``match`` and ``score``; only with a score of ``least`` or more.

    The score is the cosine of the grams, each weighted by the log of how rare it is among the references: word order, missing words
    and several edits cost little, common endings count little. Of equal scores (to nine digits) the first by name matches.
    """
    known = written(_values(ref, ref_col, "match"), "references")
    n = known.count()
    weights = known.select(F.explode("grams").alias("gram")).groupBy("gram").agg(F.count("*").alias("seen"))
    weights = weights.select("gram", F.log(1 + F.lit(float(n)) / F.col("seen")).alias("weight"))
    square = F.pow("weight", 2)
    by_gram = known.select("match", F.explode("grams").alias("gram")).join(weights, "gram")
    norms = by_gram.groupBy("match").agg(F.sum(square).alias("norm"))
    asked = _values(df, col).select("value", F.explode("grams").alias("gram")).join(weights, "gram", "left")
    asked = asked.withColumn("weight", F.coalesce("weight", F.log(F.lit(1 + float(n)))))
    terms = F.sort_array(F.collect_list(F.struct("weight", "gram")), asc=False)
    queries = written(asked.groupBy("value").agg(F.sum(square).alias("total"), terms.alias("terms")), "queries")
    # The heavy grams: without one of them the others cannot reach the score (by Cauchy and Schwarz).
    enough = F.col("total") * least * least - 1e-9
    start = F.struct(F.col("total").alias("left"), F.array().cast("array<string>").alias("keys"))
    heavy = F.aggregate(
        "terms", start,
        lambda s, t: F.when(s["left"] >= enough, F.struct((s["left"] - F.pow(t["weight"], 2)).alias("left"), F.array_append(s["keys"], t["gram"]).alias("keys"))).otherwise(s),
    )
    keys = queries.select("value", F.explode(heavy["keys"]).alias("gram"))
    likely = keys.join(by_gram.select("gram", "match"), "gram").select("value", "match").distinct()
    full = likely.join(queries, "value").join(known, "match").join(norms, "match")
    common = F.aggregate(
        F.filter("terms", lambda t: F.array_contains(F.col("grams"), t["gram"])), F.lit(0.0), lambda s, t: s + F.pow(t["weight"], 2)
    )
    scored = full.select("value", "match", F.round(common / F.sqrt(F.col("total") * F.col("norm")), 9).alias("score")).where(F.col("score") >= least)
    best = F.min(F.struct((-F.col("score")).alias("score"), "match")).alias("best")
    return scored.groupBy("value").agg(best).select("value", F.col("best.match").alias("match"), (-F.col("best.score")).alias("score"))
