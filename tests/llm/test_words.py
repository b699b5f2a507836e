"""Languages, spelling variants and resampling: odd inputs, and each against a plain version on small tables."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tableprep.llm import language, resampling, variants
from tableprep.llm.queries import QUERIES, SQL

FOLDER = "/root/testdata/sf0.01"
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
LONG = "wörter in einem sehr langen text " * 20_000 + "x" * 200_000


def odd_docs(spark):
    return spark.createDataFrame(
        [
            (1, "A plain text with some words in it.", "en", "src0", 35), (1, "A plain text with some words in it.", "en", "src0", 35),
            (2, None, None, None, None), (3, "", "en", "src0", 0), (4, " \t\n 12 !", "en", None, 4), (5, LONG, "de", "src0", len(LONG)),
            (6, "\x00 é 中文 \U0001f600 ..!", "fr", "src1", 12), (None, "A text without an id", "en", "src0", 20), (7, "one", None, "src0", 3),
        ],
        DOCS,
    )


@pytest.mark.parametrize("name", ["language", "resampling"])
def test_row_wise_operators_keep_all_rows_and_columns(spark, name):
    def apply(docs):
        if name == "language":
            return language.identify(docs, language.fit(docs.withColumn("lang", F.col("lang").cast("string"))))
        return resampling.resample(docs, docs)

    docs = odd_docs(spark)
    out = apply(docs)
    assert set(docs.columns) <= set(out.columns) and out.count() == 9
    assert apply(docs.limit(0)).collect() == []
    new = [c for c in out.columns if c not in docs.columns]
    clash = docs.withColumns({c.upper(): F.lit("old") for c in new}).withColumn("a.b", F.lit(1))
    again = apply(clash)
    assert sorted(c.lower() for c in again.columns) == sorted([*(c.lower() for c in out.columns), "a.b"]) and again.count() == 9


# --- languages ---


def plain_language(rows, texts, longest=5, alpha=0.5):
    """Scores from Python's own counts, without bounds."""
    words = defaultdict(Counter)
    sizes = Counter(lang for _, lang in rows)
    languages = sorted(sizes, key=lambda x: (-sizes[x], x))
    for text, lang in rows:
        words[lang].update(re.findall(r"[^\W\d_]+", (text or "").lower()))
    counts = {n: defaultdict(Counter) for n in range(longest + 1)}
    for lang, found in words.items():
        for word, k in found.items():
            counts[0][lang][word] += k
            for n in range(1, longest + 1):
                for i in range(len(word) + 3 - n):
                    counts[n][lang][f" {word} "[i : i + n]] += k
    seen = {n: set().union(*counts[n].values()) for n in counts}

    def value(n, feature):
        return np.array([math.log((counts[n][x][feature] + alpha) / (sum(counts[n][x].values()) + alpha * max(1, len(seen[n])))) for x in languages])

    def word_score(word):
        if word in seen[0]:
            return value(0, word)
        for n in range(longest, 0, -1):
            grams = [g for i in range(max(0, len(word) + 3 - n)) if (g := f" {word} "[i : i + n]) in seen[n]]
            if grams:
                return np.mean([value(n, g) for g in grams], axis=0)

    out = []
    for text in texts:
        found = re.findall(r"[^\W\d_]+", (text or "").lower())
        scores = [s for w in found if (s := word_score(w)) is not None]
        mean = np.mean(scores, axis=0) if scores else np.zeros(len(languages))
        out.append((languages[int(np.argmax(mean))], 1 / np.exp(mean - mean.max()).sum()) if found else ("und", 0.0))
    return out


def test_language_equals_plain_version(spark):
    rows = [
        ("the cat sat on the mat and the dog ran", "en"), ("a dog and a cat", "en"), ("le chat est sur la table", "fr"), ("der hund und die katze", "de"),
        ("la table et le chien", "fr"), (None, "fr"), ("the end", None),
    ]
    docs = spark.createDataFrame([(k, t, x) for k, (t, x) in enumerate(rows)], "doc_id int, text string, lang string")
    texts = ["the cat", "chats", "katzen und hunde", "zzz", "中文", "cat katze chat", "", None, "123", "L'été", "aaa bbb xyzzy the", "ÉTÉ été"]
    model = language.fit(docs)
    found = language.identify(spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, text string"), model).orderBy("k").collect()
    expected = plain_language([r for r in rows if r[1] is not None], texts)
    assert [r.lang_pred for r in found] == [e[0] for e in expected]
    assert np.allclose([r.score for r in found], [e[1] for e in expected])


def test_language_bounds_and_held_out_rows(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    other = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    small = language.fit(docs, usable=~other, max_texts=20, max_words=100, max_grams=50)
    assert all(len(known) <= 4 * (100 if size == 0 else 50) for size, known in small.known.items())
    found = language.identify(docs, small).where(other & F.col("lang").isNotNull())
    right = found.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert right >= 0.95
    # A wrong language in rows that are held out changes nothing.
    spoilt = docs.withColumn("lang", F.when(other, F.lit("xx")).otherwise(F.col("lang")))
    again = language.fit(spoilt, usable=~other, max_texts=20, max_words=100, max_grams=50)
    assert again.known == small.known and np.array_equal(again.scores, small.scores)
    assert language.fit(docs.limit(0)).languages == []


def test_language_query(spark):
    out = {r.doc_id: r for r in QUERIES["op11_languages"](spark, FOLDER).collect()}
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").collect()
    assert len(out) == len(docs) and all(0 <= r.score <= 1 for r in out.values())
    held = [d for d in docs if zlib.crc32(str(d.doc_id).encode()) % 4 == 2]
    assert {k for k, r in out.items() if r.held_out} == {d.doc_id for d in held}
    named = [d for d in held if d.lang and any(c.isalpha() for c in d.text or "")]
    assert np.mean([out[d.doc_id].lang_pred == d.lang for d in named]) >= 0.95


# --- spelling variants ---


def one_edit(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_forms(counts, times=5):
    near = {w: [v for v in counts if one_edit(w, v)] for w in counts}
    form = {}
    for word, others in near.items():
        best = min(others, key=lambda v: (-counts[v], v), default=None)
        form[word] = best if best is not None and counts[best] >= times * counts[word] else None
    out = []
    for word in counts:
        root = word
        while form[root] is not None:
            root = form[root]
        out.append((word, form[word], root, counts[word], len(near[word]), counts[form[word]] if form[word] else None))
    return sorted(out)


def many_words(seed, n=220):
    rng = random.Random(seed)
    counts = {}
    for _ in range(n):
        word = "".join(rng.choice("abcdeéñ") for _ in range(rng.randint(6, 9)))
        counts[word] = rng.choice([5, 8, 40, 200, 1000, 5000])
        for _ in range(3):
            at, kind = rng.randrange(len(word)), rng.randrange(3)
            word = word[:at] + ("" if kind == 0 else rng.choice("abcé")) + word[at + (kind < 2) :]
            if len(word) >= 6:
                counts.setdefault(word, rng.choice([5, 8, 40, 200, 1000]))
    # Words with the same letters, and words that share all but the last ones.
    counts |= {"aabbccdd": 7, "ddccbbaa": 70, "abababab": 9, "babababa": 300}
    counts |= {"commonbeginning" + "".join(rng.choice("xyz") for _ in range(3)): rng.choice([5, 30, 900]) for _ in range(20)}
    return counts


@pytest.mark.parametrize("parts, hot", [(6, 1000), (6, 3), (4, 2)])
def test_forms_equal_brute_force(spark, parts, hot):
    counts = many_words(parts + hot)
    words = spark.createDataFrame(list(counts.items()), "word string, n bigint")
    found = variants.spelling_forms(words, parts, hot).select("word", "form", "root", "n", "n_near", "form_n").collect()
    assert sorted(tuple(r) for r in found) == plain_forms(counts)


def test_each_pair_once_and_joined_on_signatures(spark, plan_of):
    counts = many_words(5)
    words = spark.createDataFrame(list(counts.items()), "word string, n bigint")
    pairs = variants.near_words(words)
    found = [tuple(sorted((r.word, r.word2))) for r in pairs.collect()]
    expected = {tuple(sorted((a, b))) for a in counts for b in counts if one_edit(a, b)}
    assert len(found) == len(set(found)) and set(found) == expected
    plan = plan_of(pairs)
    assert "signature" in plan and "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_runs_and_dropped_letters(spark):
    docs = odd_docs(spark).unionByName(spark.createDataFrame([(8, "ÀÉ×÷ÿ Straße STRASSE a1b", "de", "s", 1)], DOCS))
    found = Counter((r.id, r.run) for r in variants.drop_letters(variants.runs(docs), 3).collect())
    expected = Counter()
    for row in docs.collect():
        for run in re.findall("[A-Za-zÀ-ÿ]+", row.text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            name = "" if row.doc_id is None else str(row.doc_id)
            h = zlib.crc32(f"{name}:{run}".encode())
            expected[name, run[: h % len(run)] + run[h % len(run) + 1 :] if h % 3 == 0 else run] += 1
    assert found == expected
    assert variants.spelling_forms(variants.count_words(variants.runs(docs.limit(0)))).collect() == []


# --- resampling ---


def plain_resampling(docs, target, low, high, buckets, percent, least_words, seed):
    def lower(text):
        return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")

    def made(text):
        words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lower(text))
        return words, [zlib.crc32(" ".join(words[i : i + n]).encode()) % buckets for n in range(low, high + 1) for i in range(len(words) - n + 1)]

    s, t = Counter(), Counter()
    for _, text in docs:
        s.update(made(text)[1])
    for text in target:
        t.update(made(text)[1])
    ss, tt = sum(s.values()), sum(t.values())
    out = []
    for doc_id, text in docs:
        words, found = made(text)
        gain = [math.floor(1000 * math.log((t[b] + 1) * (ss + buckets) / ((s[b] + 1) * (tt + buckets)))) for b in found]
        weight = sum(gain) // len(gain) if gain else 0
        h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        out.append([doc_id, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(words)])
    enough = sorted((r for r in out if r[5] >= least_words), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for k, row in enumerate(enough[: percent * len(enough) // 100]):
        row[4] = k + 1
    return sorted((tuple(r[:5]) for r in out), key=repr)


@pytest.mark.parametrize("low, high, percent", [(1, 1, 30), (1, 2, 50), (2, 3, 100)])
def test_resampling_equals_plain_version(spark, low, high, percent):
    rng = random.Random(low * 10 + high)
    vocabulary = ["alpha", "Beta", "été", "x1", "zwei", "中文", "the", "of"]
    docs = [(k, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 30)))) for k in range(80)]
    docs += [(200, None), (201, ""), (None, "the of the of the of"), (202, "!! --"), (203, "the\x00of\nthe"), (203, "the\x00of\nthe")]
    target = ["the of x1 zwei", None, "", "the of the"]
    frame = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(4)
    goal = spark.createDataFrame([(t,) for t in target], "text string")
    found = resampling.resample(frame, goal, low=low, high=high, buckets=50, percent=percent, least_words=4, seed=7)
    found = sorted((tuple(r) for r in found.select("doc_id", "n_features", "weight", "score", "rank").collect()), key=repr)
    assert found == plain_resampling(docs, target, low, high, 50, percent, 4, 7)


@pytest.mark.parametrize("name", ["op12_variants", "op13_resampling"])
def test_queries_match_their_sql(spark, rows, name):
    connection = duckdb.connect()
    for table in ("documents", "benchmark"):
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{FOLDER.replace('0.01', '0.001')}/{table}.parquet')")
    found = QUERIES[name](spark, FOLDER.replace("0.01", "0.001"))
    cursor = connection.execute(SQL[name])
    assert [d[0] for d in cursor.description] == found.columns
    assert sorted(map(repr, cursor.fetchall())) == sorted(repr(tuple(r)) for r in found.collect())


def test_language_scores_are_not_copied_for_each_text():
    from tableprep.llm.language import WORD, Model, Scores, judge, words_of

    for text in ("One, two-3 three_FOUR\x00five\x1f", "été x", "", "İ a1b", "12 3"):
        assert words_of(text) == WORD.findall(text.lower())
    scores, tables = Scores(Model(["a", "b"], {0: {}, 1: {"x": 0}}, np.array([[-1.0, -2.0]]))), []
    for k in range(300):
        assert judge(scores, "x" * (k + 1))[0] == "a"
        if not tables or tables[-1] is not scores.table:
            tables.append(scores.table)
    assert len(tables) < 12 and len(scores.matrix()) == 300
