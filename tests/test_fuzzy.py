import random

import pytest

import tableprep as tp
from pyspark.sql import functions as F

from tableprep.operators import fuzzy
from tableprep.operators.fuzzy import connected


def distance(a, b):
    line = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(line[j] + 1, new[-1] + 1, line[j - 1] + (x != y)))
        line = new
    return line[-1]


def mixture(seed):
    """Short strings, strings with a long common start, and edited copies of random words."""
    rng = random.Random(seed)
    values = {"".join(rng.choice("ab") for _ in range(rng.randint(0, 8))) for _ in range(50)}
    values |= {"Customer#00" + "".join(rng.choice("0123") for _ in range(rng.randint(2, 5))) for _ in range(40)}
    for _ in range(30):
        word = [rng.choice("abcdefghé") for _ in range(rng.randint(3, 15))]
        for _ in range(3):
            copy = list(word)
            for _ in range(rng.randint(0, 4)):
                at, kind = rng.randint(0, len(copy)), rng.randint(0, 2)
                copy[at : at + (kind > 0)] = [] if kind == 2 else [rng.choice("abcdefghé")]
            values.add("".join(copy))
    return sorted(values)


def words(spark, values):
    return spark.createDataFrame([(v,) for v in values], "v string")


@pytest.mark.parametrize("d, bucket_limit", [(1, 100), (2, 10), (3, 100), (3, 8)])
def test_pairs_equal_brute_force(spark, d, bucket_limit):
    values = mixture(d)
    expected = {(a, b, distance(a, b)) for i, a in enumerate(values) for b in values[i + 1 :] if distance(a, b) <= d}
    expected = {(min(a, b), max(a, b), n) for a, b, n in expected}
    found = [tuple(r) for r in tp.near_pairs(words(spark, values), "v", d, bucket_limit).collect()]
    assert len(found) == len(set(found)) and set(found) == expected


@pytest.mark.parametrize("dense, unused", [(0, "_candidates"), (2, "_all_near")])
def test_dense_values_are_compared_once(spark, monkeypatch, dense, unused):
    """All pairs in several blocks, or by keys: the same pairs; names that count up need no keys."""
    values = mixture(7)
    expected = {(min(a, b), max(a, b), distance(a, b)) for i, a in enumerate(values) for b in values[i + 1 :] if distance(a, b) <= 2}
    monkeypatch.setattr(fuzzy, "BLOCK", 30)
    with monkeypatch.context() as context:
        context.setattr(fuzzy, "DENSE", dense)
        context.setattr(fuzzy, unused, None)
        found = [tuple(r) for r in tp.near_pairs(words(spark, values), "v", 2, 10).collect()]
        assert len(found) == len(set(found)) and set(found) == expected
        both = {tuple(r) for r in tp.near_match(words(spark, values[:50]), "v", words(spark, values[30:]), "v", 2, 10).collect()}
        assert both == {(a, b, distance(a, b)) for a in values[:50] for b in values[30:] if distance(a, b) <= 2}
    names = [f"Customer#{k:09}" for k in range(300)]
    monkeypatch.setattr(fuzzy, "_candidates", None)
    assert tp.near_pairs(words(spark, names), "v", 3).count() == 300 * 299 // 2


def test_most_candidates_end_before_their_distance(spark, monkeypatch, plan_of):
    """Urls of one host share almost all letters; only a distance that nothing cheaper rules out is worked out, and no near pair is lost."""
    rng = random.Random(11)
    urls = [f"https://tionsh.example.net/en/{rng.randrange(10**6)}/" for _ in range(400)] + ["x😀y", "xzy", "x😁y", "x😀😁y", "xy", "", "é", "éa"]
    expected = {(min(a, b), max(a, b), n) for i, a in enumerate(urls) for b in urls[i + 1 :] if 0 < (n := distance(a, b)) <= 2}
    monkeypatch.setattr(fuzzy, "DENSE", 2)
    found = tp.near_pairs(words(spark, urls), "v", 2, 10)
    joins = [line for line in plan_of(found).splitlines() if "Join" in line and "levenshtein" in line]
    assert joins and all(line.index("bit_count") < line.index("levenshtein") for line in joins)
    assert {tuple(r) for r in found.collect()} == expected and found.count() == len(expected)
    state = fuzzy._start(words(spark, urls[:400]), "v").select("value", "letters.*")
    pairs = state.join(state.select(F.col("value").alias("w"), F.col("one").alias("o"), F.col("two").alias("t"))).where("value < w")
    cheap = pairs.where("bit_count(one ^ o) <= 4 and bit_count(two ^ t) <= 8")
    assert 5 * cheap.count() < pairs.count() and cheap.where(F.levenshtein("value", "w", 2) >= 0).count() == pairs.where(F.levenshtein("value", "w", 2) >= 0).count()


@pytest.mark.parametrize("levels, d", [(0, 3), (1, 3), (2, 2), (3, 4)])
def test_folded_values_equal_brute_force(spark, monkeypatch, levels, d):
    """By however many last characters values are folded, and in whatever blocks: the same pairs, once each."""
    rng = random.Random(levels)
    values = {"".join(rng.choice("01") for _ in range(rng.randint(0, 7))) + rng.choice(["", "x", "é😀"]) for _ in range(120)} | {"", "😀", "\t"}
    values = sorted(values)
    for name, value in (("DENSE", 0), ("BLOCK", 20), ("MAX_BLOCKS", 4), ("_levels", lambda sides: levels)):
        monkeypatch.setattr(fuzzy, name, value)
    expected = {(min(a, b), max(a, b), distance(a, b)) for i, a in enumerate(values) for b in values[i + 1 :] if distance(a, b) <= d}
    found = [tuple(r) for r in tp.near_pairs(words(spark, values), "v", d).collect()]
    assert len(found) == len(set(found)) and set(found) == expected
    both = [tuple(r) for r in tp.near_match(words(spark, values[:70]), "v", words(spark, values[40:]), "v", d).collect()]
    assert len(both) == len(set(both)) and set(both) == {(a, b, distance(a, b)) for a in values[:70] for b in values[40:] if distance(a, b) <= d}


def test_dense_names_meet_as_few_rows_in_many_tasks(spark, monkeypatch, plan_of):
    """Names that count up are folded before they are compared, and rows are dealt out once, to the tasks asked for."""
    sizes, write = [], fuzzy.written

    def counted(df, label="step"):
        out = write(df, label)
        if label == "folded":
            sizes.append(out.count())
        return out

    monkeypatch.setattr(fuzzy, "written", counted)
    monkeypatch.setattr(fuzzy, "BLOCK", 100)
    names = [f"Customer#{k:09}" for k in range(1000)]
    pairs = tp.near_pairs(words(spark, names), "v", 2)
    plan = plan_of(pairs)
    assert plan.count("Exchange hashpartitioning") == plan.count("REPARTITION_BY_NUM") == 2
    assert sizes == [10]
    assert pairs.count() == sum(distance(a[-3:], b[-3:]) <= 2 for i, a in enumerate(names) for b in names[i + 1 :])


@pytest.mark.parametrize("d, bucket_limit", [(1, 100), (2, 100), (2, 4), (3, 3)])
def test_clusters_equal_components_of_brute_force(spark, d, bucket_limit):
    values = mixture(20 + d)
    root = {v: v for v in values}

    def top(v):
        while root[v] != v:
            v = root[v]
        return v

    linked = set()
    for i, a in enumerate(values):
        for b in values[i + 1 :]:
            if distance(a, b) <= d:
                linked |= {a, b}
                root[max(top(a), top(b))] = min(top(a), top(b))
    found = {r["value"]: r["canonical"] for r in tp.near_clusters(words(spark, values), "v", d, bucket_limit).collect()}
    assert found == {v: top(v) for v in linked}


def test_values_around_the_long_ones(spark):
    rng = random.Random(5)
    start = "".join(rng.choice("abc") for _ in range(60))
    values = sorted({start + "".join(rng.choice("xy") for _ in range(n)) for n in (3, 4, 4, 4, 5, 5, 5, 6, 6) for _ in range(3)} | {"", "a", "b", "ab"})
    expected = {(a, b, 1) for a in values for b in values if a < b and distance(a, b) == 1}
    found = [tuple(r) for r in tp.near_pairs(words(spark, values), "v", 1, 2).collect()]
    assert len(found) == len(set(found)) and set(found) == expected
    grouped = tp.near_clusters(words(spark, values), "v", 1, 2).collect()
    assert {r["value"] for r in grouped} == {v for p in expected for v in p[:2]}


def test_dense_names_take_candidates_in_proportion(spark):
    """Values like 'Customer#000000001': what is joined and linked grows with the values, not with their square."""
    def links(n):
        values = spark.range(n).select(F.format_string("Customer#%09d", "id").alias("v"))
        return fuzzy._one_edit_links(fuzzy._start(values, "v")).count(), tp.near_pairs(values, "v", 1).count()

    (few, pairs), (many, more) = links(1_000), links(10_000)
    assert pairs == 1_000 * 27 // 2 and more == 10_000 * 36 // 2  # nine other digits at each of three and four places
    assert few <= 2 * 1_000 * 18 and many <= 13.5 * few


@pytest.mark.parametrize("d, bucket_limit", [(1, 100), (2, 6)])
def test_match_equals_brute_force(spark, d, bucket_limit):
    values = mixture(7)
    left, right = values[::2], values[::3]
    expected = {(a, b, distance(a, b)) for a in left for b in right if distance(a, b) <= d}
    found = tp.near_match(words(spark, left), "v", words(spark, right), "v", d, bucket_limit).collect()
    assert len(found) == len(expected) and {tuple(r) for r in found} == expected


def test_components(spark):
    chain = [(f"n{i:02d}", f"n{i + 1:02d}") for i in range(12)]
    pairs = spark.createDataFrame(chain + [("x", "y"), ("a-hub", "z1"), ("a-hub", "z2"), ("z2", "z3")], "v1 string, v2 string")
    found = {r["value"]: r["canonical"] for r in connected(pairs).collect()}
    expected = {f"n{i:02d}": "n00" for i in range(13)} | {"x": "x", "y": "x"} | {v: "a-hub" for v in ("a-hub", "z1", "z2", "z3")}
    assert found == expected


def test_clusters_join_through_shared_members(spark):
    # a-d, b-e and d-e are near; one pass over the pairs would leave a value in two groups.
    found = tp.near_clusters(words(spark, ["aaaa", "aaab", "aabb", "abbb", "zzzzzz", None]), "v", 1).collect()
    assert {r["value"]: r["canonical"] for r in found} == {v: "aaaa" for v in ("aaaa", "aaab", "aabb", "abbb")}
    assert tp.near_clusters(words(spark, ["abcdef", "zzzzzz"]), "v", 1).count() == 0


def test_fingerprints(spark, rows):
    df = words(spark, ["Émile Zola", "zola, emile", "ZOLA EMILE", "zola émile zola", "Hugo", "", None, "!!"])
    found = tp.fingerprint_clusters(df, "v")
    assert {r["canonical"] for r in found.collect()} == {"zola émile zola"}
    assert {r["fingerprint"] for r in found.collect()} == {"emile zola"} and found.count() == 4
    merged = tp.merge_clusters(df, "v", found)
    assert rows(merged.groupBy("v").count()) == sorted([("zola émile zola", 4), ("Hugo", 1), ("", 1), (None, 1), ("!!", 1)], key=repr)
