"""Near-equal values: pairs within an edit distance, clusters, fingerprints.

The pairs are exact, without a cap on the number of values. Blocking follows the partition method
for edit-distance joins (Li, Deng, Wang, Feng: Pass-Join, PVLDB 5(3), 2011): cut one value into
``d + 1`` pieces; a value within ``d`` edits holds one of them unchanged, moved by at most ``d``
places. So an equi-join on pieces finds all candidates.

A piece that many values share would make one bucket with a quadratic number of candidates. Such a
bucket is not joined. Two values in it are within ``d`` edits only if what is left of them *without*
the piece is within ``d`` edits as well, so the rests are cut into pieces again, and the bucket falls
apart into smaller ones, until none is large. What all rests of a bucket begin or end with goes first: it takes no part in the distance.

One edit needs no pieces: two values that differ in one character are equal without it. An equi-join on the place and the value
without that character finds just these pairs, however dense the values are (up to ``LONG`` characters).

Where one pair in a hundred is near, as a sample tells, keys save nothing: most buckets are large and each pair is found under many
of them. Then values are folded by their last characters, all beginnings are compared, once each, block by block, and near ones grow
by a character at a time, with their distances (as in a trie join: Wang, Feng, Li: Trie-Join, PVLDB 3(1), 2010).

The number of pairs can be quadratic in the number of values when they really are all close, so ``near_pairs`` can be
given a limit above which it raises. ``near_clusters`` needs no pairs: values that are equal without a character are linked to the first of
them, and where more edits are allowed, only buckets that hold more than one of these groups are looked at.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tableprep.functions.text import fingerprint
from tableprep.operators.joins import map_values
from tableprep.scratch import remove, written

# Up to so many keys that both sides hold are sent to all tasks, so that the rows of other keys are not shuffled.
SENT = 1_000_000
# A bucket is cut further when both of its sides hold more values than this.
BUCKET_LIMIT = 100
# Up to so many characters, values are compared without one of them; longer ones would make too many copies.
LONG = 64
# All pairs are compared where at least this share of them is near, estimated from so many values of each side.
DENSE, SAMPLED = 0.01, 1000
# Blocks of this many values are compared with each other, but of a side there are no more than so many blocks.
BLOCK, MAX_BLOCKS = 1000, 64
# Values that are compared all with all are folded into one row if only so many last characters differ, but a row has no more than so many values.
LEVELS, GROUP = 3, 128


def _array(rows: list[str]) -> Column:
    return F.expr("array(" + ", ".join(rows) + ")")


def _piece_keys(state: DataFrame, moves: list[tuple[int, int, int]], d: int) -> DataFrame:
    """One row per text and move (length difference, piece number, shift) that fits into the text.

    The n characters of the cut side make d + 1 even pieces, of which later ones may be longer. The
    key holds the piece; the new rest is the text around it.
    """
    table = _array([f"struct({delta} as delta, {i} as i, {shift} as shift)" for delta, i, shift in moves])
    rows = state.select("value", "letters", "grp", "rest", "ctx", F.length("rest").alias("m"), F.explode(table).alias("p"))
    rows = rows.select("value", "letters", "grp", "rest", "ctx", "m", "p.*").withColumn("n", F.col("m") - F.col("delta"))
    base, first_longer = F.expr(f"n div {d + 1}").cast("int"), F.expr(f"{d + 1} - n % {d + 1}")
    rows = rows.where(F.col("n") > d).select(
        "*",
        (base * F.col("i") + F.greatest(F.lit(0), F.col("i") - first_longer) + F.col("shift")).alias("at"),
        (base + F.when(F.col("i") >= first_longer, 1).otherwise(0)).alias("size"),
    )
    rows = rows.where((F.col("at") >= 0) & (F.col("at") + F.col("size") <= F.col("m")))
    return rows.selectExpr(
        "value",
        "letters",
        "grp",
        "xxhash64(ctx, i, n, substring(rest, at + 1, size)) as key",
        "concat(substring(rest, 1, at), substring(rest, at + size + 1, m)) as rest",
        "true as can_split",
    )


def _kept_keys(state: DataFrame, uses: dict[int, list[tuple[int, int]]]) -> DataFrame:
    """Keys for a cut text of n <= d characters: the ways to keep ``kept`` characters of this text.

    ``uses`` gives, by length of this text, the pairs (n, kept). A text of m characters is within d
    edits of a short one only if m - d of its characters stay.
    """
    by_length = []
    for length in range(max(uses) + 1):
        rows = [
            f"struct({n} as n, {kept} as kept, cast(array({', '.join(map(str, at))}) as array<int>) as at)"
            for n, kept in uses[length] for at in combinations(range(1, length + 1), kept)
        ]
        by_length.append("array(" + ", ".join(rows) + ")")
    table = F.get(_array(by_length), F.length("rest"))
    short = state.where(F.length("rest") <= max(uses))
    rows = short.select("value", "letters", "grp", "rest", "ctx", F.explode(table).alias("k"))
    return rows.selectExpr(
        "value",
        "letters",
        "grp",
        "xxhash64(ctx, -1, k.n, k.kept, array_join(transform(k.at, x -> substring(rest, x, 1)), '')) as key",
        "rest",
        "false as can_split",
    )


def _index_keys(state: DataFrame, d: int) -> DataFrame:
    """Keys of the cut side: its pieces, or the characters that short rests may keep."""
    short = {length: [(length, kept) for kept in range(length + 1)] for length in range(d + 1)}
    return _piece_keys(state, [(0, i, 0) for i in range(d + 1)], d).unionAll(_kept_keys(state, short))


def _probe_keys(state: DataFrame, d: int, longer_only: bool) -> DataFrame:
    """Keys under which a text may meet a cut one of each length within d of its own."""
    # Edits before the piece move it by at most i, those after it by at most d - i.
    moves = [
        (delta, i, shift)
        for delta in range(0 if longer_only else -d, d + 1)
        for i in range(d + 1)
        for shift in range(max(-i, delta - (d - i)), min(i, delta + (d - i)) + 1)
    ]
    short = {}
    for length in range(2 * d + 1):
        kept, longest = max(0, length - d), min(d, length if longer_only else length + d)
        short[length] = [(n, kept) for n in range(kept, longest + 1)]
    return _piece_keys(state, moves, d).unionAll(_kept_keys(state, short))


def _candidates(
    left: DataFrame, right: DataFrame, d: int, same: bool, bucket_limit: int, groups: bool = False, stripped: bool = False
) -> DataFrame:
    """Pairs (v1, v2, distance) with distance at most d; ``left`` is cut, ``right`` is searched for. Pairs may repeat.

    Both have columns ``value``, ``letters``, ``grp``, ``rest`` and ``ctx``. With ``groups`` only pairs between different groups (``grp``) are
    wanted, and of these just so many that the same values hang together. ``stripped``: :func:`_stripped` made the sides.
    """
    found = []
    while True:
        small = not groups and min(side.count() for side in ((left,) if left is right else (left, right))) <= bucket_limit
        left, right = (left, right) if small or stripped else _stripped(left, right)
        stripped = False
        index, probe = _index_keys(left, d), _probe_keys(right, d, same)
        if small:
            found.append(_near(index, probe, ["key"], d, same, groups))
            return reduce(DataFrame.unionAll, found)
        sizes = _bucket_sizes(index, probe, bucket_limit, same, groups)  # with groups, only of buckets that hold several
        live = _sent(sizes.where("not large").select("key"))
        found.append(_near(*(side.join(live, "key", "left_semi") for side in (index, probe)), ["key"], d, same, groups))
        if groups:
            found.append(_stars(index, probe, sizes.where("large and not can_split").select("key"), d))
        cut_further = sizes.where("large and can_split").select("key")
        if cut_further.isEmpty():
            return reduce(DataFrame.unionAll, found)
        cut_further = _sent(cut_further)
        inside = [side.join(cut_further, "key", "left_semi") for side in (index, probe)]
        left, right = (
            written(side.select("value", "letters", "grp", "rest", F.col("key").alias("ctx")).distinct(), "values") for side in inside
        )
        if left.isEmpty() or right.isEmpty():
            return reduce(DataFrame.unionAll, found)


def _stripped(left: DataFrame, right: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both sides without what all rests of a context begin and end with."""
    rest = F.col("rest")
    ends = left.unionAll(right).groupBy("ctx").agg(
        F.min("rest").alias("low"), F.max("rest").alias("high"), F.min(F.reverse(rest)).alias("back_low"), F.max(F.reverse(rest)).alias("back_high"),
        F.min(F.length("rest")).alias("shortest"),
    )

    def common(a: str, b: str) -> Column:
        """How many characters two texts begin with together; all texts between them in order do so too."""
        letters = F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: F.coalesce(x == y, F.lit(False)) & (x != ""))
        first = F.array_position(letters, False)
        return F.when(first > 0, first - 1).otherwise(F.size(letters)).cast("int")

    ends = ends.select("ctx", "shortest", common("low", "high").alias("head"), common("back_low", "back_high").alias("tail"))
    ends = ends.select("ctx", F.least("head", "shortest").alias("head"), F.least(F.col("tail"), F.col("shortest") - F.least("head", "shortest")).alias("tail"))

    def cut(side: DataFrame) -> DataFrame:
        short = F.substring("rest", F.col("head") + 1, F.length("rest") - F.col("head") - F.col("tail"))
        return side.join(ends, "ctx").select("value", "letters", "grp", short.alias("rest"), "ctx")

    if left is right:
        once = written(cut(left), "values")
        return once, once
    return written(cut(left), "values"), written(cut(right), "values")


def _near(a: DataFrame, b: DataFrame, on: list[str], d: int, same: bool, groups: bool = False) -> DataFrame:
    """Rows of both sides that agree in ``on`` and whose values are within d edits."""

    def side(rows: DataFrame, n: int) -> DataFrame:
        sketch = (F.col("letters.one").alias(f"l{n}"), F.col("letters.two").alias(f"t{n}"))
        return rows.select(*on, F.col("value").alias(f"v{n}"), F.col("rest").alias(f"r{n}"), *sketch, F.col("grp").alias(f"g{n}"))

    # An edit changes at most two letters and four pairs of neighbours: most candidates end here, at little cost. Values that meet under a piece
    # which no edit touched are within d edits without it as well. One condition keeps this order; of two, Spark would take the second first.
    tests = ["g1 <> g2"] * groups + ["v1 <> v2"] * same + [
        f"bit_count(l1 ^ l2) <= {2 * d}", f"bit_count(t1 ^ t2) <= {4 * d}", f"levenshtein(r1, r2, {d}) >= 0", f"levenshtein(v1, v2, {d}) >= 0",
    ]
    near = side(a, 1).join(side(b, 2), on).where(" and ".join(tests)).withColumn("distance", F.levenshtein("v1", "v2", d))
    if same:
        near = near.select(F.least("v1", "v2").alias("v1"), F.greatest("v1", "v2").alias("v2"), "distance")
    return near.select("v1", "v2", "distance")


def _stars(index: DataFrame, probe: DataFrame, keys: DataFrame, d: int) -> DataFrame:
    """Links between the sides of buckets that cannot be cut: all their values are near, so each is linked to the first of the other side."""
    a, b = (side.join(keys, "key", "left_semi") for side in (index, probe))
    links = [
        one.select("key", F.col("value").alias("v1")).join(other.groupBy("key").agg(F.min("value").alias("v2")), "key")
        for one, other in ((a, b), (b, a))
    ]
    near = links[0].unionAll(links[1]).where("v1 <> v2").withColumn("distance", F.levenshtein("v1", "v2", d)).where("distance >= 0")
    return near.select("v1", "v2", "distance")


def _sent(keys: DataFrame) -> DataFrame:
    """The keys, marked to be sent to all tasks unless they are many."""
    return F.broadcast(keys) if keys.count() <= SENT else keys


def _bucket_sizes(index: DataFrame, probe: DataFrame, bucket_limit: int, same: bool, groups: bool) -> DataFrame:
    """The buckets that hold a pair to compare, with ``groups`` those of several groups: ``key``, ``can_split`` and ``large``, to be cut further."""
    sizes = (
        index.select("key", "grp", "can_split", F.lit(1).alias("l"), F.lit(0).alias("r"))
        .unionAll(probe.select("key", "grp", "can_split", F.lit(0).alias("l"), F.lit(1).alias("r")))
        .groupBy("key").agg(
            F.sum("l").alias("l"), F.sum("r").alias("r"), F.min("can_split").alias("can_split"), (F.min("grp") < F.max("grp")).alias("several")
        )
    )
    large = F.least("l", "r") > bucket_limit
    met = sizes.where("l > 0 and r > 0")
    if groups:
        return written(met.where("several").select("key", "can_split", large.alias("large")), "buckets")
    if same:  # A text finds its own pieces: one that only it holds makes no pair.
        met = met.where("l > 1 or r > 1 or not can_split")
    return written(met.select("key", "can_split", (F.col("can_split") & large).alias("large")), "buckets")


def _without_one(state: DataFrame) -> DataFrame:
    """Each value without each of its characters: ``value``, the place ``at`` and what is ``left``."""
    value = F.col("value")
    cut = F.transform(F.sequence(F.lit(1), F.length(value)), lambda p: F.struct(
        p.alias("at"), F.concat(F.substring(value, F.lit(1), p - 1), F.substring(value, p + 1, F.length(value))).alias("left")
    ))
    return state.where(F.length(value) > 0).select("value", F.inline(cut))


def _one_edit(left: DataFrame, right: DataFrame, same: bool) -> DataFrame:
    """Pairs (v1, v2, distance) with at most one edit between them; each is there once."""

    def keyed(side: DataFrame, name: str, *of: Column | str) -> DataFrame:
        return side.select(F.xxhash64(*of).alias("key"), F.col("value").alias(name))

    def shorter(side: DataFrame, name: str) -> DataFrame:
        return keyed(_without_one(side).select("value", "left").distinct(), name, "left")

    replaced = keyed(_without_one(left), "v1", "at", "left").join(keyed(_without_one(right), "v2", "at", "left"), "key")
    pairs = [replaced.where("v1 < v2" if same else "v1 <> v2"), shorter(left, "v1").join(keyed(right, "v2", "value"), "key")]
    if not same:
        pairs += [keyed(left, "v1", "value").join(shorter(right, "v2"), "key"), keyed(left, "v1", "value").join(keyed(right, "v2", "value"), "key")]
    near = reduce(DataFrame.unionAll, [p.select("v1", "v2") for p in pairs]).withColumn("distance", F.levenshtein("v1", "v2", 1)).where("distance >= 0")
    if same:
        near = near.select(F.least("v1", "v2").alias("v1"), F.greatest("v1", "v2").alias("v2"), "distance")
    return near


def _one_edit_links(values: DataFrame) -> DataFrame:
    """Links (v1, v2) that join the same values as all pairs with one edit do: no more than twice the characters of the values."""
    replaced = _without_one(values).groupBy(F.xxhash64("at", "left").alias("key")).agg(F.collect_list("value").alias("members"))
    stars = replaced.where(F.size("members") > 1).select(F.array_min("members").alias("v1"), F.explode("members").alias("v2"))
    cut = _without_one(values).select("value", F.xxhash64("left").alias("key")).distinct()
    inserted = cut.join(values.select(F.col("value").alias("v2"), F.xxhash64("value").alias("key")), "key").select(F.col("value").alias("v1"), "v2")
    return stars.unionAll(inserted).where("v1 <> v2").where(F.levenshtein("v1", "v2", 1) == 1)


def _is_dense(left: DataFrame, right: DataFrame, d: int, same: bool) -> bool:
    """Whether a bounded sample of both sides has many near pairs; this decides how pairs are looked for, not which are found."""
    first, other = (side.orderBy(F.xxhash64("value")).select("rest").limit(SAMPLED) for side in (left, right))
    pairs = first.select(F.col("rest").alias("r1")).join(F.broadcast(other.select(F.col("rest").alias("r2"))), how="cross")
    seen, near = pairs.where("r1 <> r2" if same else "true").agg(F.count("*"), F.count_if(F.levenshtein("r1", "r2", d) >= 0)).first()
    return near > 0 and near >= DENSE * seen


def _end_code(text: Column) -> Column:
    """The last character of a text as a number: what its bytes say."""
    return F.conv(F.hex(F.substring(text, -1, 1)), 16, 10).cast("bigint")


def _levels(sides: list[DataFrame]) -> int:
    """By how many last characters values are folded: each halves the groups at least, and no group has more than ``GROUP`` values."""
    cuts = F.array(*[F.struct(F.lit(n).alias("n"), F.expr(f"xxhash64(substring(rest, 1, length(rest) - {n}))").alias("start")) for n in range(LEVELS + 1)])
    fits = LEVELS
    for side in sides:
        starts = side.select(F.inline(cuts)).groupBy("n", "start").agg(F.count("*").alias("size"))
        seen = {n: (groups, most) for n, groups, most in starts.groupBy("n").agg(F.count("*"), F.max("size")).collect()}
        fits = min(fits, next((n for n in range(fits) if 2 * seen[n + 1][0] > seen[n][0] or seen[n + 1][1] > GROUP), fits))
    return fits


def _folded(side: DataFrame, levels: int) -> DataFrame:
    """Texts that values begin with, all but the last ``levels`` characters: ``text`` and ``node``.

    A node holds the ``codes`` of the characters that come next and, in the same order, the nodes they lead to as ``kids``; the last are the values.
    """
    nodes = side.select(F.col("rest").alias("text"), F.col("value").alias("node"))
    for _ in range(levels):
        kid = F.struct(_end_code(F.col("text")).alias("code"), "node").alias("kid")
        kids = nodes.select(F.expr("substring(text, 1, length(text) - 1)").alias("text"), kid).groupBy("text").agg(F.collect_list("kid").alias("kids"))
        nodes = kids.select("text", F.struct(F.col("kids.code").alias("codes"), F.col("kids.node").alias("kids")).alias("node"))
    return written(nodes, "folded")


def _longer(pairs: DataFrame, d: int) -> DataFrame:
    """Pairs of texts with one character more on both sides, of those that stay within d edits.

    This is one step of the table of distances. ``a0`` is the distance of the texts, ``a1`` to ``ad`` that of the left one to the right one without its
    last characters, ``b1`` to ``bd`` the other way round; ``x1``, ``y1`` and so on are their last characters. Ways farther from the diagonal cost more than d.
    """
    some = range(1, d + 1)

    def cells(own: str, new: str, other: str) -> list[Column]:
        """The new text to the other one without its last characters, from the last of these on."""
        line: list[Column] = []
        for r in reversed(some):
            before = F.col("a0" if r == 1 else f"{own}{r - 1}")
            line.append(F.least(F.col(f"{own}{r}") + F.when(F.col(new) == F.col(f"{other}{r}"), 0).otherwise(1), before + 1, *[c + 1 for c in line[-1:]]))
        return line[::-1]

    kept = ["own", "first", "a0", *[f"{c}{r}" for c in "bxy" for r in some]]
    left = pairs.select(*kept, *[f"a{r}" for r in some], "left", "right", F.posexplode("left.codes").alias("at", "x0"))
    left = left.select(
        *kept, "x0", F.get("left.kids", "at").alias("left"), F.col("right.codes").alias("codes"), F.col("right.kids").alias("kids"),
        *[c.alias(f"a{r}") for r, c in zip(some, cells("a", "x0", "y"))],
    )
    # Of the many pairs here, only near ones fetch what their characters lead to.
    both = left.select(*kept, *[f"a{r}" for r in some], "x0", "left", "kids", F.posexplode("codes").alias("at", "y0"))
    lines = cells("b", "y0", "x")
    ways = [F.col("a0") + F.when(F.col("x0") == F.col("y0"), 0).otherwise(1), *[c + 1 for c in [*[F.col("a1")][:d], *lines[:1]]]]
    both = both.select(
        "own", "first", "left", F.get("kids", "at").alias("right"), (F.least(*ways) if d else ways[0]).alias("a0"), *[f"a{r}" for r in some], *[c.alias(f"b{r}") for r, c in zip(some, lines)],
        *[F.col(f"{c}{r - 1}").alias(f"{c}{r}") for c in "xy" for r in some],
    )
    return both.where(F.col("a0") <= d)


def _all_near(left: DataFrame, right: DataFrame, d: int, same: bool) -> DataFrame:
    """Pairs (v1, v2, distance) with at most d edits between the rests, each once, from comparing all beginnings of them.

    Values that differ in their last characters only are one row. Rows are compared all with all, and near ones grow by a character at a time: two
    texts have no more edits between them than longer ones, so pairs that are farther apart end early. A row meets the others in pairs of blocks:
    its copies are bounded by the number of blocks, a task's rows by their size.
    """
    # What all texts begin with changes no distance; with it, all have characters enough to cut off.
    padded = [side.select("value", F.concat(F.lit("x" * (LEVELS + d)), "rest").alias("rest")) for side in ((left,) if same else (left, right))]
    blocks = min(MAX_BLOCKS, max(side.count() for side in padded) // BLOCK + 1)
    levels = _levels(padded)
    folded = [_folded(side, levels) for side in padded]
    # Both of one type: else the rows would be dealt out again, into few tasks.
    block, meeting = F.pmod(F.xxhash64("text"), F.lit(blocks)).cast("int"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    ends = [[_end_code(F.expr(f"substring(text, 1, length(text) - {r})")).alias(f"{c}{r + 1}") for r in range(d)] for c in "xy"]
    met = (
        folded[0].select(F.col("text").alias("r1"), F.col("node").alias("left"), *ends[0], block.alias("i"), meeting.alias("j")),
        folded[-1].select(F.col("text").alias("r2"), F.col("node").alias("right"), *ends[1], meeting.alias("i"), block.alias("j")),
    )
    # A number of partitions that is given stays: by their bytes alone Spark would merge them.
    parts = blocks * (blocks + 1) // 2 if same else blocks * blocks
    first, other = (side.where("i <= j" if same else "true").repartition(parts, "i", "j") for side in met)
    pairs = first.join(other.hint("shuffle_hash"), ["i", "j"]).where("i < j or r1 <= r2" if same else "true")
    shorter = [f"substring({{}}, 1, length({{}}) - {r})" for r in range(1, d + 1)]
    cell = f"coalesce(nullif(levenshtein({{}}, {{}}, {d}), -1), {d + 1})"
    pairs = pairs.where(f"levenshtein(r1, r2, {d}) >= 0").select(
        # Unless one text begins with the other, they put their values in order, so that these need not be compared.
        "left", "right", F.expr("r1 = r2").alias("own"),
        F.expr("case when startswith(r1, r2) or startswith(r2, r1) then 0 when r1 < r2 then 1 else -1 end").alias("first"),
        F.levenshtein("r1", "r2", d).alias("a0"),
        *[F.expr(cell.format("r1", cut.format("r2", "r2"))).alias(f"a{r}") for r, cut in enumerate(shorter, 1)],
        *[F.expr(cell.format(cut.format("r1", "r1"), "r2")).alias(f"b{r}") for r, cut in enumerate(shorter, 1)],
        *[f"{c}{r}" for c in "xy" for r in range(1, d + 1)],
    )
    for _ in range(levels):
        pairs = _longer(pairs, d)
    if not same:
        return pairs.select(F.col("left").alias("v1"), F.col("right").alias("v2"), F.col("a0").alias("distance"))
    ahead = F.expr("first = 1 or first = 0 and left < right")
    v1, v2 = F.when(ahead, F.col("left")).otherwise(F.col("right")), F.when(ahead, F.col("right")).otherwise(F.col("left"))
    return pairs.where("not own or left < right").select(v1.alias("v1"), v2.alias("v2"), F.col("a0").alias("distance"))


def _pairs(left: DataFrame, right: DataFrame, d: int, same: bool, bucket_limit: int) -> DataFrame:
    if d != 1:
        # All values are in one context here, so what is cut off changes no distance.
        sides = _stripped(left, right)
        if _is_dense(*sides, d, same):
            return _all_near(*sides, d, same)
        return _candidates(*sides, d, same, bucket_limit, stripped=True).distinct()
    length = F.length("value")
    short = _one_edit(left.where(length <= LONG), right.where(length <= LONG), same)
    # Of two values with one edit between them none is long, or both have LONG characters at least.
    long = [side.where(length >= LONG) for side in (left, right)]
    if any(side.isEmpty() for side in long):
        return short
    pairs = _candidates(*long, d, same, bucket_limit).where(F.greatest(F.length("v1"), F.length("v2")) > LONG)
    return short.unionAll(pairs.distinct())


def _letters(text: Column) -> Column:
    """Of a text ``one``, the set of its letters, and ``two``, which pairs of neighbours are in it an odd number of times; 64 bits each.

    A letter has the bit of its code modulo 64, a pair (the ends of the text count as neighbours) that of its hash. What two texts share cancels in ``two``.
    """
    one, none = F.lit(1).cast("bigint"), F.lit(0).cast("bigint")
    bit = lambda char: F.when(char == "", none).otherwise(F.call_function("shiftleft", one, F.ascii(char) % 64))
    letters = F.aggregate(F.split(text, ""), none, lambda seen, char: seen.bitwiseOR(bit(char)))
    chars = F.filter(F.split(text, ""), lambda char: char != "")
    # The end of the text stands as an empty neighbour.
    ends = F.zip_with(F.array_prepend(chars, F.lit("")), F.array_append(chars, F.lit("")), lambda x, y: F.pmod(F.xxhash64(x, y), F.lit(64)).cast("int"))
    pairs = F.aggregate(ends, none, lambda seen, at: seen.bitwiseXOR(F.call_function("shiftleft", one, at)))
    return F.struct(letters.alias("one"), pairs.alias("two"))


def _start(df: DataFrame, col: str) -> DataFrame:
    values = df.select(F.col(col).cast("string").alias("value")).where("value is not null").distinct()
    value = F.col("value")
    zero = F.lit(0).cast("bigint")
    state = values.select(value, _letters(value).alias("letters"), zero.alias("grp"), value.alias("rest"), zero.alias("ctx"))
    return written(state, "values")


def near_pairs(
    df: DataFrame, col: str, max_dist: int = 3, bucket_limit: int = BUCKET_LIMIT, max_pairs: int | None = None
) -> DataFrame:
    """All pairs ``v1 < v2`` of distinct values that 1 to ``max_dist`` edits turn into each other.

    Their number can be quadratic; more than ``max_pairs``, if given, raise. ``bucket_limit`` decides how
    far values are cut, not what is found.
    """
    values = _start(df, col)
    pairs = _pairs(values, values, max_dist, True, bucket_limit)
    if max_pairs is None:
        return pairs
    pairs = written(pairs, "pairs")
    if (n := pairs.count()) > max_pairs:
        raise ValueError(f"{n} pairs are near, the limit is {max_pairs}; near_clusters groups values without pairs")
    return pairs


def near_match(
    df: DataFrame, col: str, ref: DataFrame, ref_col: str, max_dist: int = 1, bucket_limit: int = BUCKET_LIMIT
) -> DataFrame:
    """Pairs (``v1`` from ``df``, ``v2`` from ``ref``) with at most ``max_dist`` edits between them."""
    pairs = _pairs(_start(ref, ref_col), _start(df, col), max_dist, False, bucket_limit)
    return pairs.select(F.col("v2").alias("v1"), F.col("v1").alias("v2"), "distance")


def connected(pairs: DataFrame, a: str = "v1", b: str = "v2", max_rounds: int = 200) -> DataFrame:
    """The component of each value: columns ``value`` and ``canonical``, the smallest member.

    Large-star and small-star rounds (Kiveris et al., SoCC 2014): each round links values to the
    smallest neighbour and ends when nothing moves. Every round is an aggregation and a join on the
    value, written to the shared folder in place of the round before. More than ``max_rounds`` raise: rounds
    grow with the logarithm of the number of values.
    """
    edges = pairs.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v").distinct()
    edges = written(edges, "edges")
    before = _digest(edges)
    for _ in range(max_rounds):
        both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _star(both).where("v > u")
        large = large.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        small = _star(down)
        linked = (
            small.select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionAll(small.select("u", F.col("m").alias("v")))
            .where("u <> v").distinct()
        )
        linked = written(linked, "edges")
        after = _digest(linked)
        remove(edges)
        if after == before:
            members = linked.groupBy("u").agg(F.min("v").alias("canonical")).select(F.col("u").alias("value"), "canonical")
            roots = linked.select(F.col("v").alias("value"), F.col("v").alias("canonical")).distinct()
            return members.unionAll(roots)
        edges, before = linked, after
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")


def _star(edges: DataFrame) -> DataFrame:
    """Edges (u, v) with the smallest of u and its neighbours as m."""
    least = edges.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
    return edges.join(least, "u")


def _digest(edges: DataFrame) -> tuple:
    oriented = edges.select(F.least("u", "v").alias("x"), F.greatest("u", "v").alias("y"))
    mixed = F.xxhash64("x", "y")
    return tuple(oriented.agg(F.count("*"), F.bit_xor(mixed), F.sum(mixed.cast("decimal(38,0)"))).first())


def near_clusters(df: DataFrame, col: str, max_dist: int = 3, bucket_limit: int = BUCKET_LIMIT) -> DataFrame:
    """Groups of values linked by near pairs: ``value`` and ``canonical`` (smallest member).

    First the groups along single edits, from links in proportion to the values. Then, where values are long or more edits
    are allowed, links between different groups; they and the groups' own are merged.
    """
    values = _start(df, col)
    length = F.length("value")
    groups = connected(_one_edit_links(values.where(length <= LONG)))
    more = values if max_dist > 1 else values.where(length >= LONG)
    if max_dist == 1 and more.isEmpty():
        return groups
    groups = written(groups, "groups")
    group = F.xxhash64(F.coalesce("canonical", "value"))
    state = more.drop("grp").join(groups, "value", "left").select("value", "letters", group.alias("grp"), "rest", "ctx")
    state = written(state, "values")
    if state.select("grp").distinct().limit(2).count() < 2:
        return groups
    between = written(_candidates(state, state, max_dist, True, bucket_limit, groups=True).select("v1", "v2").distinct(), "edges")
    if between.isEmpty():
        return groups
    own = groups.where("value <> canonical").select(F.col("value").alias("v1"), F.col("canonical").alias("v2"))
    return connected(own.unionAll(between))


def fingerprint_clusters(df: DataFrame, col: str) -> DataFrame:
    """Values that differ only in case, accents, punctuation, word order or repeated words.

    Columns ``value``, ``fingerprint``, ``canonical`` (the longest member, first by name) and
    ``size``; only groups of two or more distinct values.
    """
    values = df.select(F.col(col).cast("string").alias("value")).where("value <> ''").distinct()
    marked = values.withColumn("fingerprint", fingerprint(F.col("value"))).where("fingerprint <> ''")
    groups = marked.groupBy("fingerprint").agg(
        F.min(F.struct(-F.length("value"), "value")).getField("value").alias("canonical"), F.count("*").alias("size")
    ).where("size > 1")
    return marked.join(groups, "fingerprint").select("value", "fingerprint", "canonical", "size")


def merge_clusters(df: DataFrame, col: str, clusters: DataFrame) -> DataFrame:
    """Replace each value by the ``canonical`` value of its cluster."""
    mapping = clusters.select(F.col("value").alias("old"), F.col("canonical").alias("new"))
    return map_values(df, col, mapping, known_unique=True)
