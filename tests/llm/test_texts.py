"""Odd inputs for every operator on texts, and each against a plain version on small tables."""

import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tableprep.llm import bpe, decontaminate, jaccard, licenses, pii, quality, suffixes, toxicity
from tableprep.llm.words import chained_hashes

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
LONG = "word " * 60_000 + "\n" + "x" * 300_000


def odd_docs(spark):
    return spark.createDataFrame(
        [
            (1, "A plain text with some words in it.", "en", "src0", 35),
            (1, "A plain text with some words in it.", "en", "src0", 35),
            (2, None, None, None, None),
            (3, "", "en", "src0", 0),
            (4, " \t\n ", "en", None, 4),
            (5, LONG, "en", "src0", len(LONG)),
            (6, "\x00 é 中文 \U0001f600 ..!", "fr", "src1", 12),
            (None, "A text without an id", "en", "src0", 20),
            (7, "one", "en", "src0", 3),
        ],
        DOCS,
    )


@pytest.fixture(scope="module")
def ranks():
    public_tokenizers = pytest.importorskip("public_tokenizers")
    return bpe.load_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")), public_tokenizers.PATTERN


def labels_of(spark, rows, column="toxic"):
    return spark.createDataFrame(rows, f"doc_id bigint, {column} int")


def item_table(spark):
    return spark.createDataFrame([(1, "a benchmark item that has enough characters to be cut"), (2, None), (None, "x")], "item_id bigint, text string")


def operators(spark, ranks):
    labels = labels_of(spark, [(1, 1), (3, 0), (4, None), (None, 1), (7, 0)])
    good = labels_of(spark, [(1, 1), (3, 0), (4, None), (None, 1), (7, 2)], "quality")
    return {
        "bpe": lambda d: bpe.decode(bpe.encode(d, *ranks), ranks[0]),
        "toxicity": lambda d: toxicity.score(d, toxicity.fit(d, labels)),
        "decontaminate": lambda d: decontaminate.find_items(d, item_table(spark)),
        "without_leaks": lambda d: decontaminate.without_leaks(d, item_table(spark)),
        "pii": lambda d: pii.find_spans(d, pii.fit(d)),
        "redact": lambda d: pii.redact(d, pii.fit(d)),
    }


@pytest.mark.parametrize("name", ["bpe", "toxicity", "decontaminate", "without_leaks", "pii", "redact"])
def test_row_wise_operators_keep_all_rows_and_columns(spark, ranks, name):
    apply = operators(spark, ranks)[name]
    docs = odd_docs(spark)
    out = apply(docs)
    assert set(docs.columns) <= set(out.columns) and out.count() == 9
    assert apply(docs.limit(0)).collect() == []
    new = [c for c in out.columns if c not in docs.columns]
    clash = docs.withColumns({c.upper(): F.lit("old") for c in new}).withColumn("a.b", F.lit(1))
    again = apply(clash)
    assert sorted(c.lower() for c in again.columns) == sorted([*(c.lower() for c in out.columns), "a.b"]) and again.count() == 9


def test_operators_by_id_on_odd_rows(spark, rows):
    docs = odd_docs(spark).withColumn("node", F.lit(0)).withColumn("component_id", F.lit("x")).withColumn("spans", F.lit(1))
    linked = rows(jaccard.link_components(docs, 80, 5))
    assert linked == sorted([(1, 4, 1, 1), (1, 4, 1, 1), (2, 0, 2, 2), (3, 0, 3, 3), (4, 0, 4, 4), (5, 2, 5, 5), (6, 1, 6, 6), (7, 1, 7, 7)], key=repr)
    assert jaccard.link_components(docs.limit(0)).collect() == []
    kept = jaccard.keep_one(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 2, 3, 4, 5, 6, 7]
    found = suffixes.remove_spans(suffixes.find_repeats(docs))
    assert found.count() == 9 and all(r.spans == [] for r in found.collect())
    assert suffixes.find_repeats(docs.limit(0)).collect() == []
    labels = labels_of(spark, [(1, 1), (3, 0), (3, 1), (4, None)], "quality")
    scored = quality.score(docs, labels, quality.fit(docs, labels), F.col("source"), F.col("lang"))
    assert scored.count() == 9 and all(0 <= r.quality <= 1 for r in scored.collect())
    none = docs.limit(0)
    assert quality.score(none, labels, quality.fit(none, labels), F.col("source"), F.col("lang")).collect() == []
    assert licenses.scan(docs, licenses.templates(spark)).collect() == []
    assert licenses.scan(docs, licenses.templates(spark).limit(0)).collect() == []


def test_bpe_agrees_with_tiktoken(ranks):
    tiktoken = pytest.importorskip("tiktoken")
    plain = tiktoken.Encoding("plain", pat_str=ranks[1], mergeable_ranks=ranks[0], special_tokens={})
    pieces = bpe.Pieces(bpe.PrefixEncoder(ranks[0]))
    import regex

    split, draw = regex.compile(ranks[1]).findall, random.Random(5)
    parts = ["a", "th", "ing", " ", "  ", "\n", "é", "中", "😀", "'s", "'ll", "12", "!", "\xa0", "\x1c", "tion", "Z"]
    for _ in range(1500):
        text = "".join(draw.choice(parts) for _ in range(draw.randint(0, 60)))
        for again in range(2):
            ids = np.frombuffer(pieces.encode_all([split(text), []])[0], "<u4").tolist()
            assert ids == plain.encode_ordinary(text)


def test_bpe_edits_match_a_new_start(ranks):
    encoder, draw = bpe.PrefixEncoder(ranks[0]), random.Random(6)
    for _ in range(150):
        data = "".join(draw.choice("abcdeth ing") for _ in range(120)).encode()
        start = draw.randint(0, 120)
        stop = draw.randint(start, 120)
        new = bytes(draw.choice(b"abcde") for _ in range(draw.randint(0, 5)))
        edited = bpe.EditableText(encoder, data)
        done = edited.replace(start, stop, new)
        edited.append(b"tion")
        fresh = bpe.EditableText(encoder, data[:start] + new + data[stop:] + b"tion")
        assert edited.last == fresh.last and done <= len(data) - stop + len(new)
        assert [encoder.tokens[i] for i in fresh.ids()] == encoder.merges(fresh.data)


def test_bpe_raises_on_unknown_ids(spark, ranks):
    bad = spark.createDataFrame([(1, bytearray(b"\xff\xff\xff\x7f"))], "doc_id bigint, token_ids binary")
    with pytest.raises(Exception, match="not in the vocabulary"):
        bpe.decode(bad, ranks[0]).collect()


def test_toxicity_learns_without_labels_of_the_other_rows(spark):
    draw = random.Random(7)
    bad, common = ["scum", "vile", "moron"], [f"w{k}" for k in range(200)]
    rows, marks = [], []
    for k in range(600):
        toxic = k % 6 == 0
        words = [draw.choice(common) for _ in range(30)] + ([draw.choice(bad) for _ in range(3)] if toxic else [])
        draw.shuffle(words)
        rows.append((k, " ".join(words)))
        marks.append((k, int(toxic)))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    usable = F.crc32(F.col("doc_id").cast("string")) % 5 != 0
    model = toxicity.fit(docs, labels_of(spark, marks), usable=usable)
    scored = {r.doc_id: r.toxicity for r in toxicity.score(docs, model).collect()}
    aside = [k for k, _ in rows if zlib.crc32(str(k).encode()) % 5 == 0]
    right = sum((scored[k] >= 0.5) == (k % 6 == 0) for k in aside)
    assert len(aside) > 80 and right / len(aside) > 0.95
    flipped = [(k, y if k not in aside else 1 - y) for k, y in marks]
    other = toxicity.fit(docs, labels_of(spark, flipped), usable=usable)
    assert np.array_equal(other.weights, model.weights) and other.intercept == model.intercept


def words_of(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall("[^\x20\x09-\x0d]+", low)


def plain_components(texts, least, size):
    sets = {}
    for key, text in texts.items():
        words = words_of(text)
        sets[key] = {tuple(words[k : k + size]) for k in range(max(1, len(words) - size + 1))} if words else set()
    parent = {k: k for k in sets}

    def top(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= least * (len(sets[a]) + len(sets[b]) - both):
                x, y = top(a), top(b)
                parent[max(x, y)] = min(x, y)
    return {k: (len(sets[k]), top(k)) for k in sets}


@pytest.mark.parametrize("least,size", [(90, 3), (80, 5), (60, 2)])
def test_jaccard_components_against_all_pairs(spark, least, size):
    draw = random.Random(least)
    texts = {}
    for group in range(25):
        base = [f"w{draw.randint(0, 400)}" for _ in range(draw.choice([2, 4, 12, 40, 120, 400]))]
        for _ in range(draw.choice([1, 2, 3, 14])):
            words = list(base)
            for _ in range(draw.choice([0, 0, 1, 2, 4, 8])):
                at = draw.randrange(len(words))
                words[at : at + draw.choice([0, 1])] = [f"x{draw.randint(0, 50)}"]
            texts[len(texts) * 3 + 1] = " ".join(words).upper() if draw.random() < 0.2 else "\t".join(words)
    docs = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.link_components(docs, least, size).collect()}
    assert found == plain_components(texts, least, size)
    assert len({c for _, c in found.values()}) < len(texts) - 20
    kept = {r.doc_id for r in jaccard.keep_one(docs, least=least, shingle=size).collect()}
    assert kept == {c for _, c in found.values()}


def test_jaccard_blocks_of_a_large_root(spark, monkeypatch):
    """Many near copies that link in a chain, cut into blocks far smaller than their number."""
    monkeypatch.setattr(jaccard, "BLOCK", 8)
    words = [f"w{k}" for k in range(200)]
    texts = {k: " ".join(words[k * 4 : k * 4 + 100] + [f"v{j}" for j in range(60 - k)]) for k in range(25)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.link_components(docs, 85, 2).collect()}
    assert found == plain_components(texts, 85, 2)


@pytest.mark.parametrize("copies", [2, 4])
def test_jaccard_links_below_roots_that_hold_copies(spark, copies):
    """Two texts that link meet only below roots that another comes first at; a fourth one is below one of its roots."""
    base = [f"s16w{k}" for k in range(90)]
    apart = {0, 2, 4, 6, 8, 9, 17, 27, 31, 34, 35, 36, 43, 45, 56, 57, 61, 73, 79, 82, 83}
    fill = (2, 3, 6, 11, 33, 40, 47, 49, 50, 51, 55, 59, 68, 70, 79, 85, 86, 87, 92, 104, 106)
    first = [w for k, w in enumerate(base) if k not in apart] + [f"s16f{k}" for k in fill]
    near = [f"s16d{k}" for k in range(10)] + base[10:]
    fourth = [base[k] for k in (80, 1, 85, 52)] + [f"s16a5_{k}" for k in range(91) if k not in (11, 33, 35, 50, 74)]
    family = [" ".join(words) for words in (first, base, near, fourth)]
    texts = {c * 4 + k: text for c in range(copies) for k, text in enumerate(family)}  # each partition holds one of each
    docs = spark.createDataFrame(spark.sparkContext.parallelize(list(texts.items()), copies), "doc_id bigint, text string")
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.link_components(docs, 80, 1).collect()}
    assert found == plain_components(texts, 80, 1) and {c for _, c in found.values()} == {0, 1, 3}


def test_jaccard_words_whose_polynomial_sums_agree(spark):
    """Words of a and b by the Thue-Morse rule and its complement have one polynomial hash modulo 2**64."""
    signs = [bin(k).count("1") % 2 for k in range(1024)]
    words = ["".join("ab"[s ^ flip] for s in signs) for flip in (0, 1)]
    texts = {1: words[0], 2: words[1], 3: words[0], 4: words[0] * 1500, 5: words[1] * 1500}
    docs = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    assert {r.doc_id: r.component_id for r in jaccard.link_components(docs, 90, 3).collect()} == {1: 1, 2: 2, 3: 1, 4: 4, 5: 5}


def test_chained_hashes_depend_on_the_bytes_of_the_word_alone():
    draw = random.Random(5)
    words = [bytes(draw.choice(b"ab\x00") for _ in range(draw.choice([0, 1, 7, 8, 9, 16, 30, 1024, 1025, 2000]))) for _ in range(400)]
    data = np.frombuffer(b"x".join(words), np.uint8)
    starts = np.cumsum([0, *(len(w) + 1 for w in words[:-1])])
    got = chained_hashes(data, starts, starts + np.array([len(w) for w in words]))
    assert len(set(got.tolist())) == len(set(words)) == len({(w, int(h)) for w, h in zip(words, got)})


def test_cell_puts_out_fewer_links_than_texts():
    """A group of 60 texts of which all link: a forest, not the pairs; one more text stays apart."""
    draw = np.random.default_rng(2)
    base = draw.integers(0, 1 << 63, 200, dtype=np.uint64)
    sets = [np.sort(np.concatenate([base[5:], draw.integers(0, 1 << 63, 5, dtype=np.uint64)])) for _ in range(60)]
    sets.append(np.sort(draw.integers(0, 1 << 63, 200, dtype=np.uint64)))
    n = len(sets)
    whole = pa.array([0] * n, pa.int32())
    cell = pa.table({
        "kind": pa.array([1] * n, pa.int32()), "low": whole, "high": whole, "block": whole, "node": list(range(n)), "component": list(range(n)),
        "n": [200] * n, "is_major": [False] * n, "hashes": [s.tobytes() for s in sets],
    })
    links = jaccard._cell_links(cell, jaccard.Threshold(80)).to_pylist()
    assert len(links) == 59 and all(n - 1 not in r.values() for r in links)


def test_empty_groups_are_left_out_only_where_others_must_agree():
    """Linked sets have a root in common whatever is left out; most unlike ones have none."""
    draw = np.random.default_rng(4)
    for least in (60, 80, 90):
        threshold, alike, unlike = jaccard.Threshold(least), 0, 0
        for size in draw.integers(3, 400, 150):
            x = draw.integers(0, 1 << 64, size, dtype=np.uint64)
            lost = int(size * (100 - least) // 100)
            y, z = x[lost:], draw.integers(0, 1 << 64, size, dtype=np.uint64)
            keys = [set(jaccard.roots(np.sort(v), np.array([0, len(v)]), threshold)[0].tolist()) for v in (x, y, z)]
            alike += bool(keys[0] & keys[1]) or not lost
            unlike += bool(keys[0] & keys[2])
        assert alike == 150
        assert least < 80 or unlike < 60


def test_rtree_prunes_no_pair_that_may_link():
    draw = np.random.default_rng(3)
    base = draw.integers(0, 6, (8, 32))
    at = (base[draw.integers(0, 8, 300)] + draw.integers(0, 2, (300, 32))).astype(np.int32)
    sizes = at.sum(axis=1)
    threshold = jaccard.Threshold(80)
    tree = jaccard.RTree(at, sizes)
    got = {(i, j) for a, b in tree.pairs(tree, threshold) for i, j in zip(a, b)}
    bound = np.minimum(at[:, None], at[None]).sum(axis=2)
    assert got == set(zip(*np.nonzero(bound >= threshold.overlap(sizes[:, None] + sizes[None]))))


def plain_removal(texts, length):
    first, out = {}, {}
    for key in sorted(texts):
        data = texts[key].encode()
        covered = bytearray(len(data))
        own = [data[p : p + length] for p in range(len(data) - length + 1)]
        for p, s in enumerate(own):
            if s in first:
                covered[p : p + length] = b"\1" * length
        for s in own:
            first.setdefault(s, key)
        runs = [m.span() for m in re.finditer(b"\1+", bytes(covered))]
        out[key] = (runs, bytes(c for c, gone in zip(data, covered) if not gone))
    return out


def test_repeats_against_all_stretches(spark, monkeypatch):
    monkeypatch.setattr(suffixes, "RUN", 300)
    monkeypatch.setattr(suffixes, "RANGE", 50)
    draw = random.Random(11)
    passages = ["".join(draw.choice("abcdefgh é") for _ in range(draw.randint(40, 200))) for _ in range(8)] + ["ab" * 60, "z" * 90]
    texts = {}
    for key in range(120):
        parts = ["".join(draw.choice("abcdefghij ") for _ in range(draw.randint(0, 120))) for _ in range(3)]
        texts[key * 2] = parts[0] + draw.choice(passages) + parts[1] + draw.choice([*passages, ""]) + parts[2]
    texts[300], texts[301] = texts[4], texts[4][:49]
    docs = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string").repartition(7)
    found = {r.doc_id: ([(s["from"], s["to"]) for s in r.spans], bytes(r.kept)) for r in suffixes.remove_spans(suffixes.find_repeats(docs)).collect()}
    assert found == plain_removal(texts, 50)


def test_repeats_of_a_frequent_gram_meet_in_many_parts(spark, monkeypatch):
    """A phrase that goes on differently in each text, in short words and in passages before and after it."""
    monkeypatch.setattr(suffixes, "RANGE", 40)
    draw = random.Random(12)
    text = lambda n: "".join(draw.choice("abcdefghij ") for _ in range(n))
    sides = [text(45) for _ in range(30)]
    phrase = text(40)
    texts = {k: (text(60) + draw.choice(sides))[-draw.randint(0, 80) :] + phrase + (draw.choice(sides) + text(60))[: draw.randint(0, 80)] for k in range(400)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string").repartition(3)
    sent, group = [], type(docs).groupBy
    monkeypatch.setattr(type(docs), "groupBy", lambda df, *c: (sent.append(df) if "sure_ids" in df.columns else None, group(df, *c))[1])
    found = {r.doc_id: ([(s["from"], s["to"]) for s in r.spans], bytes(r.kept)) for r in suffixes.remove_spans(suffixes.find_repeats(docs)).collect()}
    assert found == plain_removal(texts, 50)
    assert sum(len(spans) > 0 for spans, _ in found.values()) > 100
    sizes = {}
    for row in sent[0].collect():
        sizes[row.part] = sizes.get(row.part, 0) + len(zlib.decompress(row.ids)) // 8
    assert max(sizes.values()) <= 400


@pytest.mark.parametrize("length", [140, 300])
def test_repeats_of_long_stretches(spark, length):
    draw = random.Random(length)
    text = lambda n: "".join(draw.choice("abcdefghij ") for _ in range(n))
    passages = [text(draw.randint(length - 10, 2 * length)) for _ in range(5)]
    texts = {k: text(draw.randint(0, 400)) + draw.choice(passages) + text(draw.randint(0, 400)) for k in range(40)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string").repartition(3)
    found = {r.doc_id: ([(s["from"], s["to"]) for s in r.spans], bytes(r.kept)) for r in suffixes.remove_spans(suffixes.find_repeats(docs, length)).collect()}
    assert found == plain_removal(texts, length) and any(spans for spans, _ in found.values())


def test_loser_tree_merges_and_keeps_common_prefixes():
    draw = random.Random(2)
    for runs in (0, 1, 2, 5, 9):
        parts = []
        for _ in range(runs):
            keys = sorted(bytes(draw.choice(b"ab") for _ in range(8)) for _ in range(draw.randint(0, 30)))
            common = [0] + [next((k for k in range(8) if x[k] != y[k]), 8) for x, y in zip(keys, keys[1:])]
            parts.append((keys, common[: len(keys)]))
        order, common = suffixes.merged(parts)
        parts = [p for p in parts if p[0]]
        merged = [parts[r][0][k] for r, k in order]
        assert merged == sorted(k for keys, _ in parts for k in keys)
        assert common[1:] == [next((k for k in range(8) if x[k] != y[k]), 8) for x, y in zip(merged, merged[1:])]


def plain_distance(pattern, text):
    before = [0] * (len(text) + 1)
    for i, a in enumerate(pattern, 1):
        row = [i]
        for j, b in enumerate(text, 1):
            row.append(min(before[j - 1] + (a != b), before[j] + 1, row[j - 1] + 1))
        before = row
    return min(before), before.index(min(before))


def test_decontamination_against_full_edit_distance(spark):
    draw = random.Random(4)
    letters = lambda n: "".join(draw.choice("abcd ef") for _ in range(n))
    items = {k: letters(draw.randint(40, 90)) for k in range(6)}
    texts = {}
    for key in range(120):
        item = list(draw.choice(list(items.values())))
        for _ in range(draw.randint(0, 12)):
            at = draw.randrange(len(item))
            item[at : at + draw.choice([0, 1, 1])] = draw.choice(["", "a", "B"])
        texts[key] = letters(50) + "".join(item).upper() + "\n" + letters(50)
    docs = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    wanted = spark.createDataFrame(list(items.items()), "item_id bigint, text string")
    found = decontaminate.find_items(docs, wanted, error_rate=0.15)
    got = {(r.doc_id, m.item_id, m.distance, m.end) for r in found.collect() for m in r.leaks}
    expected = set()
    for key, text in texts.items():
        for number, item in items.items():
            item, text = decontaminate.normal(item), decontaminate.normal(text)
            distance, end = plain_distance(item, text)
            if distance <= int(0.15 * len(item)) and len(item) >= 32:
                expected.add((key, number, distance, end))
    assert got == expected and len(got) > 60
    clean = {r.doc_id for r in decontaminate.without_leaks(docs, wanted, error_rate=0.15).collect()}
    assert clean == set(texts) - {d for d, *_ in got}


def test_decontamination_places_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "BLOCK_CHARS", 60)
    wanted = spark.createDataFrame(
        [(5, "the quick brown fox jumps over the lazy dog again"), (3, "The Quick brown fox jumps over the lazy dog again"),
         (9, "short one"), (2, "another item with quite a few characters in it")], "item_id bigint, text string")
    text = "So the quick brwn fox jumps  over the\nlazy dog again. another item with quite a few characters in it"
    docs = spark.createDataFrame([(1, text), (2, "Short  One"), (3, "a short one")], "doc_id bigint, text string")
    found = {r.doc_id: sorted((m.item_id, m.distance, m.begin, m.end) for m in r.leaks) for r in decontaminate.find_items(docs, wanted).collect()}
    assert found[2] == [(9, 0, 0, 9)] and found[3] == []
    assert {(i, d) for i, d, _, _ in found[1]} >= {(2, 0), (3, 1)}
    normal = decontaminate.normal(text)
    assert [normal[b:e] for i, _, b, e in found[1] if i == 3] == ["the quick brwn fox jumps over the lazy dog again"]


def test_short_items_count_between_word_borders(spark, monkeypatch):
    wanted = spark.createDataFrame(
        [(1, "The capital of France is Paris"), (2, "yes"), (None, "what is the boiling point of water"), (None, "Yes")],
        "item_id bigint, text string")
    texts = ["Q: the capital  of france is paris ok", "xthe capital of france is paris", "the capital of france is parisian", "oh yes sir",
             "YES", "so what is the boiling point of watr", "the capitol of france is paris"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    for block in (1 << 20, 1):
        monkeypatch.setattr(decontaminate, "BLOCK_CHARS", block)
        found = {r.doc_id: [(m.item_id, m.distance) for m in r.leaks] for r in decontaminate.find_items(docs, wanted).collect()}
        assert found == {0: [(1, 0)], 1: [], 2: [], 3: [], 4: [(2, 0)], 5: [(None, 1)], 6: []}
    assert {r.doc_id for r in decontaminate.without_leaks(docs, wanted).collect()} == {1, 2, 3, 6}


def test_equal_items_of_different_blocks_are_told_once(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "BLOCK_CHARS", 10)
    passage = "a passage that two items hold in different case and spacing"
    wanted = spark.createDataFrame(
        [(3, passage.upper()), (2, "some other item that is long enough to count"), (1, passage.replace(" ", "  "))], "item_id bigint, text string")
    docs = spark.createDataFrame([(1, f"so {passage} ends")], "doc_id bigint, text string")
    assert [m.item_id for m in decontaminate.find_items(docs, wanted).first().leaks] == [1]


def test_near_duplicates_of_repeated_ids(spark):
    """Unlike texts under one id are documents of their own; a repeated row counts once."""
    first, second, third = (" ".join(f"{p}{i}" for i in range(30)) for p in "abc")
    rows = [(2, first, "x"), (2, second, "x"), (2, second, "w"), (3, first, "x"), (1, second + " tail", "x"), (4, third, "x"), (5, third, "x"),
            (None, first, "x"), (None, first, "x"), (6, None, "x"), (6, "", "x")]
    docs = spark.createDataFrame(rows, "doc_id int, text string, `a.b` string")
    kept = {(r.doc_id, r.text) for r in jaccard.keep_one(docs).collect()}
    assert kept == {(2, first), (1, second + " tail"), (4, third), (None, first), (6, None), (6, "")}
    alone = docs.where("doc_id = 2")
    assert sorted(tuple(r) for r in jaccard.keep_one(alone).collect()) == [(2, first, "x"), (2, second, "w")]


def test_proposals_depend_on_the_passage_alone():
    alone = "write to maria at firma.com today"
    spans = {s for s in pii.proposals(alone) if s[0] == "email"}
    assert spans and spans <= set(pii.proposals(alone + ". " + "word " * 50 + "x@"))


def test_base_spans_against_the_patterns():
    patterns = {
        "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    }

    def passes(kind, span):
        digits = re.sub("[^0-9]", "", span)
        if kind == "ip":
            return all(int(p) <= 255 for p in span.split("."))
        if kind == "card":
            doubled = [int(d) * (1 + k % 2) for k, d in enumerate(reversed(digits))]
            return 16 <= len(digits) <= 19 and sum(d - 9 * (d > 9) for d in doubled) % 10 == 0
        return kind == "email" or 8 <= len(digits) <= 15

    draw = random.Random(9)
    parts = ["1", "22", "255", "0300", ".", "..", "@", "a", "b-c", "@x.com", "é", " ", "-", "+", "(", ")", "4111111111111111", "+33 6 12", "10.0.0.1"]
    for _ in range(4000):
        text = "".join(draw.choice(parts) for _ in range(draw.randint(0, 25)))
        for kind, spans in pii.base_spans(text).items():
            assert spans == [m.span() for m in re.finditer(patterns[kind], text) if passes(kind, m.group())], (kind, text)
    assert pii.base_spans("@" * 50_000 + "a" * 50_000 + "1" * 50_000 + "1." * 50_000)["ip"]  # linear time


def test_added_spans_and_redaction(spark):
    texts = ["call (521) 555-2373 today", "mail jo (at) example dot org please", "on 2024-01-05 order 12", "x a@b.co y +1 (555) 123-4567 z", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    model = pii.fit(docs)
    found = {r.doc_id: [(s.kind, texts[r.doc_id][s.start : s.end], s.base) for s in r.spans] for r in pii.find_spans(docs, model).collect()}
    assert found[0] == [("phone", "(521) 555-2373", False)] and found[2] == [] and found[4] == []
    assert found[1] == [("email", "jo (at) example dot org", False)]
    assert found[3] == [("email", "a@b.co", True), ("phone", "+1 (555) 123-4567", True)]
    assert [r.text for r in pii.redact(docs, model).orderBy("doc_id").collect()] == [
        "call [PHONE] today", "mail [EMAIL] please", "on 2024-01-05 order 12", "x [EMAIL] y [PHONE] z", None]


def test_license_texts_whole_changed_and_absent(spark):
    lorem = " ".join(f"w{k % 97}" for k in range(500))
    mit = licenses.TEMPLATES["MIT"]
    words = mit.split()
    changed = " ".join(words[:30] + ["really"] + words[30:])
    rows = [(1, f"{lorem}\n{mit.upper()}\n{lorem}"), (2, f"{lorem} {changed}"), (3, lorem), (4, " ".join(words[: len(words) // 2])),
            (5, f"{lorem} Released under the MIT license! {lorem}"), (5, "released under the mit license")]
    found = {(r.doc_id, r.license): r for r in licenses.scan(spark.createDataFrame(rows, "doc_id bigint, text string"), licenses.templates(spark)).collect()}
    assert set(found) == {(1, "MIT"), (2, "MIT"), (5, "MIT grant")}
    assert found[1, "MIT"].containment == 1 and 0.8 <= found[2, "MIT"].containment < 1 and found[5, "MIT grant"].first_word in (0, 500)


def test_license_containment_against_plain_windows(spark):
    rows = [(k, " ".join(f"{(k * 31 + j * j) % 50}" for j in range(40 + 13 * k))) for k in range(20)]
    wanted = spark.createDataFrame([("short", rows[3][1][:60]), ("long", rows[15][1][30:400]), ("none", "...")], "license string, text string")
    found = {(r.doc_id, r.license): (round(r.containment, 9), r.first_word) for r in licenses.scan(spark.createDataFrame(rows, "doc_id bigint, text string"), wanted, containment=0.5).collect()}

    def runs(text):
        words = [w for w in re.split(r"[^\w]+", text.lower()) if w]
        return [tuple(words[k : k + 5]) for k in range(len(words) - 4)]

    expected = {}
    for name, text in (("short", rows[3][1][:60]), ("long", rows[15][1][30:400])):
        own = runs(text)
        for key, doc in rows:
            s = runs(doc)
            if len(own) <= 32:
                stretches = [(max(0, i - len(own) + 1), 2 * len(own) - 1) for i, x in enumerate(s) if x in own]
            else:
                stretches = [(g, (-(-len(own) // 32) + 1) * 32) for g in range(0, len(s), 32)]
            best = max(((len(set(own) & set(s[a : a + n])) / len(set(own)), -a) for a, n in stretches), default=(0, 0))
            if best[0] >= 0.5:
                expected[key, name] = (round(best[0], 9), -best[1])
    assert found == expected and len(found) >= 2


def test_quality_shrinks_sparse_sites_more(spark):
    draw = random.Random(8)
    rows, marks = [], []
    for k in range(900):
        site = k % 30
        good = draw.random() < (0.95 if site % 2 else 0.3)
        words = [f"w{draw.randint(0, 80)}" for _ in range(40)] if good else [draw.choice(["$$$", "&&&", "BUY"]) for _ in range(40)]
        rows.append((k, " ".join(words), f"h{site}", f"p{k % 3}"))
        marks.append((k, int(good)))
    rows += [(1000, "w1 w2 w3 w4", "new", "p"), (1001, "w1 w2 w3 w4", "h1", "p1")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, host string, path string")
    labels = labels_of(spark, marks, "quality")
    usable = F.col("doc_id") % 5 != 0
    model = quality.fit(docs, labels, usable=usable)
    scored = {r.doc_id: r for r in quality.score(docs, labels, model, F.col("host"), F.col("path"), usable=usable).collect()}
    aside = [(k, y) for k, y in marks if k % 5 == 0]
    assert sum((scored[k].quality >= 0.5) == bool(y) for k, y in aside) / len(aside) > 0.95
    assert 0.5 < scored[1000].site < 0.75 and scored[1001].site > 0.8  # the first: the global rate




def test_pairs_by_halves_equal_the_merges(ranks):
    encoder = bpe.PrefixEncoder(ranks[0])
    rng = random.Random(11)
    ids, short = list(encoder.tokens), [i for i, t in encoder.tokens.items() if len(t) < 5]
    alike = [i for i, t in encoder.tokens.items() if len(set(t)) == 1]
    for pool in (ids, short, alike):
        for _ in range(1000):
            a, b = rng.choice(pool), rng.choice(pool)
            both = [encoder.tokens[a], encoder.tokens[b]]
            assert encoder.stays(a, b) == (encoder.merges(b"".join(both)) == both)
    # Vocabularies that no training made: tokens that merges never reach, or whose parts have higher ranks.
    for seed in range(12):
        rng = random.Random(seed)
        tokens = {bytes(rng.choice(b"abc") for _ in range(rng.randint(2, 5))) for _ in range(20)} | {b"a", b"b", b"c"}
        odd = bpe.PrefixEncoder({t: i for i, t in enumerate(sorted(tokens, key=lambda t: (seed % 2 and len(t) > 1, rng.random())))})
        for a in odd.tokens:
            for b in odd.tokens:
                both = [odd.tokens[a], odd.tokens[b]]
                assert odd.stays(a, b) == (odd.merges(b"".join(both)) == both)


def test_decoded_in_one_pass_or_two(spark, ranks):
    docs = odd_docs(spark)
    one = bpe.encode(docs, *ranks, with_decoded=True).select("doc_id", "token_ids", "decoded")
    two = bpe.decode(bpe.encode(docs, *ranks), ranks[0]).select("doc_id", "token_ids", "decoded")
    assert sorted(map(repr, one.collect())) == sorted(map(repr, two.collect()))
