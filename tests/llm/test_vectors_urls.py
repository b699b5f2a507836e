"""Operators on vectors and urls, the registered queries on the driver's tables, and the pipeline."""

import hashlib
import importlib
import re
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tableprep.llm import neighbours, urls
from tableprep.llm.queries import QUERIES, URL_RULES, table

FOLDER = "/root/testdata/sf0.01"


def test_urls_hosts_paths_and_rules(spark):
    rows = [
        "http://Www.Example.COM/en/a?x=/y#z", "https://example.com", "example.com/en/", None, "", "x://a.net/es/1", "ftp://B.net/fr/#/q",
        "http://a.com?u=http://b/en/", "http://com/", "http://notexample.com/en/1", "http://a.example.com/en/1", "http://h.org#t", "://", "a://b://c/d",
        "http://É.com/ÉN/",
    ]

    def split(url):
        if not url or "://" not in url:
            return "", ""
        rest = url.split("://", 1)[1]
        host = re.match("[^/?#]*", rest).group()
        return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), re.match("[^?#]*", rest[len(host):]).group()

    pages = spark.createDataFrame([(k, u, "old") for k, u in enumerate(rows)], "page_id int, url string, Host string")
    out = {r.page_id: r for r in urls.judge(pages, URL_RULES, None).collect()}
    for k, url in enumerate(rows):
        host, path = split(url)
        fits = [(v, r) for v, r in URL_RULES for d, _, p in [r.partition("/")] if (host == d or host.endswith("." + d)) and path.startswith("/" + p)]
        verdict, rule = max(fits, key=lambda f: len(f[1]), default=("allow", None))
        assert (out[k].host, out[k].path, out[k].rule, out[k].verdict) == (host, path, rule, verdict)
    assert "Python" not in urls.judge(pages, URL_RULES, None)._jdf.queryExecution().executedPlan().toString()


def test_url_ngrams_are_those_of_the_plain_way(spark):
    rows = [("example.com", "/en/a"), ("", ""), ("a", "/"), ("x\U0001f600y", "/é\U0001f600zz/q"), ("h", "/ab"), ("h.b", "")]
    grams = spark.createDataFrame(rows, "host string, path string").withColumn("g", urls.ngrams(F.col("host"), F.col("path")))
    for row in grams.collect():
        texts = ((f"^{row.host}$" if row.host else "", "h"), (row.path, "p"))
        assert sorted(row.g) == sorted(m + t[i : i + n] for t, m in texts for n in urls.SIZES for i in range(len(t) - n + 1))


def test_a_very_long_url_takes_linear_time(spark):
    page = spark.createDataFrame([(1, "http://a.b/" + "éx" * 150_000)], "page_id bigint, url string")
    begun = time.monotonic()
    assert urls.judge(page, [], urls.fit(urls.example_urls(spark))).first().verdict in ("allow", "block")
    assert time.monotonic() - begun < 60  # by substrings from the start it was 55 s for a quarter of it


def test_url_model_and_its_edges(spark, plan_of):
    model = urls.fit(urls.example_urls(spark))
    seen = ["https://www.mega-casino.example.org/en/4", "http://cheap-meds.example.net/x", "http://library-news.example.org/de/3", "http://", None, "http://a/" + "x" * 200_000]
    pages = spark.createDataFrame(list(enumerate(seen)), "page_id int, url string")
    judged = urls.judge(pages, [], model)
    out = {r.page_id: r.verdict for r in judged.collect()}
    assert [out[k] for k in range(3)] == ["block", "block", "allow"] and set(out.values()) == {"allow", "block"}
    assert urls.judge(pages.limit(0), [], model).collect() == []
    assert "Python" not in plan_of(judged) and "Arrow" not in plan_of(judged)
    assert urls.fit(urls.example_urls(spark).where("label = 1")) is None
    with pytest.raises(ValueError):
        urls.judge(pages, [("deny", "com/")], None)


def exact(ids, vectors, queries, k):
    out = {}
    for q in queries:
        gap = np.sqrt(((vectors - vectors[ids == q][0]) ** 2).sum(axis=1))
        order = [i for i in np.lexsort((ids, gap)) if ids[i] != q][:k]
        out[int(q)] = [(int(ids[i]), gap[i]) for i in order]
    return out


def test_neighbours_of_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [0.0, 0.0]), (4, None), (5, [nan, 1.0]), (6, [1.0, None]), (7, [inf, 1.0]),
            (8, []), (9, [1.0, 1.0, 1.0]), (None, [1.0, 0.0]), (100, [1.0, 0.5]), (100, [1.0, 0.5]), (11, [1.0, 0.0])]
    table_ = spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id bigint, embedding array<double>, rank int, score string")
    out = neighbours.nearest(table_, table_.where("vec_id in (0, 3, 4, 9)"), k=3).collect()
    found = {}
    for r in sorted(out, key=lambda r: (r.query_id, r.rank)):
        found.setdefault(r.query_id, []).append((r.vec_id, round(r.score, 6)))
    assert found == {0: [(1, 0.0), (11, 0.0), (100, 0.5)]}  # 9 has no row of its length, 3 and 4 take no part
    assert neighbours.nearest(table_.limit(0), table_.limit(0)).collect() == []


def test_neighbours_all_rows_when_few_and_large_groups(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "BLOCK", 64)
    monkeypatch.setattr(neighbours, "QUERIES", 3)
    draw = np.random.default_rng(1)
    vectors = draw.standard_normal((600, 16)).astype(np.float32).astype(float)
    vectors[200:400] = vectors[200]
    ids = np.arange(600)
    frame = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, vectors)], "vec_id bigint, embedding array<float>")
    out = neighbours.nearest(frame, frame.where("vec_id % 50 = 0"), k=10).collect()
    expected = exact(ids, vectors, ids[ids % 50 == 0], 10)
    hits = sum(r.vec_id in {i for i, _ in expected[r.query_id]} for r in out)
    assert len(out) == 120 and hits / 120 >= 0.9
    assert sorted(r.vec_id for r in out if r.query_id == 250) == list(range(200, 210))
    few = neighbours.nearest(frame.limit(4), frame.limit(4), k=10)
    assert few.count() == 12


def test_query_recall_and_scores(spark):
    rows = table(spark, FOLDER, "embeddings").select("vec_id", "embedding").collect()
    ids, vectors = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], float)
    expected = exact(ids, vectors, ids[ids % 100 == 0], 10)
    out = QUERIES["op6_neighbours"](spark, FOLDER).collect()
    assert {(r.query_id, r.rank) for r in out} == {(q, k) for q in expected for k in range(1, 11)}
    assert sum(r.vec_id in dict(expected[r.query_id]) for r in out) / len(out) >= 0.9
    at = {i: v for i, v in zip(ids, vectors)}
    assert all(abs(r.score - np.sqrt(((at[r.query_id] - at[r.vec_id]) ** 2).sum())) < 1e-12 for r in out)


def test_query_of_tokens(spark):
    tiktoken, public = pytest.importorskip("tiktoken"), pytest.importorskip("public_tokenizers")
    from tableprep.llm.bpe import load_ranks

    plain = tiktoken.Encoding("plain", pat_str=public.PATTERN, mergeable_ranks=load_ranks(public.path("byte_bpe_multi_50k.tiktoken")), special_tokens={})
    texts = {r.doc_id: r.text for r in table(spark, FOLDER, "documents").collect()}
    out = QUERIES["op7_bpe"](spark, FOLDER).collect()
    assert len(out) == len(texts)
    for r in out:
        ids = np.array(plain.encode_ordinary(texts[r.doc_id]), "<u4")
        digests = (hashlib.sha256(x).hexdigest() for x in (ids.tobytes(), texts[r.doc_id].encode()))
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), *digests)


def test_query_of_components(spark):
    texts = {r.doc_id: r.text for r in table(spark, FOLDER, "documents").collect()}
    low = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    sets, by_shingle, parent = {}, {}, {d: d for d in texts}
    for d, text in texts.items():
        words = re.findall("[^\x20\x09-\x0d]+", text.translate(low))
        sets[d] = {tuple(words[k : k + 3]) for k in range(max(1, len(words) - 2))} if words else set()

    def top(d):
        while parent[d] != d:
            d = parent[d]
        return d

    for d in sorted(sets):
        shared = {}
        for s in sets[d]:
            for other in by_shingle.setdefault(s, []):
                shared[other] = shared.get(other, 0) + 1
            by_shingle[s].append(d)
        for other, both in shared.items():
            if 100 * both >= 90 * (len(sets[d]) + len(sets[other]) - both):
                a, b = top(d), top(other)
                parent[max(a, b)] = min(a, b)
    out = {r.doc_id: (r.n_shingles, r.component_id) for r in QUERIES["op3_jaccard"](spark, FOLDER).collect()}
    assert out == {d: (len(s), top(d)) for d, s in sets.items()}


def test_query_of_removed_stretches(spark):
    texts = {r.doc_id: r.text.encode() for r in table(spark, FOLDER, "documents").collect()}
    first, expected = {}, {}
    for d in sorted(texts):
        data, covered, own = texts[d], bytearray(len(texts[d])), set()
        for p in range(len(data) - 49):
            s = hash(data[p : p + 50])
            if s in first:
                covered[p : p + 50] = b"\1" * 50
            own.add(s)
        for s in own:
            first.setdefault(s, d)
        kept = bytes(c for c, gone in zip(data, covered) if not gone)
        expected[d] = (len(data), sum(covered), len(re.findall(b"\1+", bytes(covered))), hashlib.sha256(kept).hexdigest())
    out = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in QUERIES["op9_suffixes"](spark, FOLDER).collect()}
    assert out == expected


def test_query_of_toxicity_on_held_out_rows(spark):
    folder = "/root/testdata/sf0.1"
    toxic = {r.doc_id: r.toxic for r in table(spark, folder, "labels").collect()}
    out = [r for r in QUERIES["op5_toxicity"](spark, folder).collect() if r.doc_id in toxic]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in out)
    aside = [r for r in out if r.held_out]
    assert sum(r.predicted == toxic[r.doc_id] for r in aside) / len(aside) > 0.95
    assert sum(r.predicted for r in aside if not toxic[r.doc_id]) / len(aside) < 0.01


def test_query_of_quality_on_held_out_rows(spark):
    folder = "/root/testdata/sf0.1"
    good = {r.doc_id: r.quality for r in table(spark, folder, "labels").collect()}
    aside = [r for r in QUERIES["op1_quality"](spark, folder).collect() if r.held_out and r.doc_id in good]
    assert sum(r.predicted == good[r.doc_id] for r in aside) / len(aside) > 0.95


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """The documents before and after each stage."""
    docs, seen = table(spark, FOLDER, "documents"), []
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("stage") / name)
        stage(spark, docs, FOLDER).write.parquet(path)
        out = spark.read.parquet(path)
        seen.append((name, {r.doc_id: r for r in docs.collect()}, {r.doc_id: r for r in out.collect()}, docs.columns, out.columns))
        docs = out
    return seen


def test_stages_keep_columns_and_change_nothing_else(stages):
    names = [s[0] for s in stages]
    assert names == ["toxicity", "near_duplicates", "decontamination", "personal_data", "tokens"]
    for name, before, after, columns, out in stages[:4]:
        assert columns == out and set(after) <= set(before)
        if name != "personal_data":
            assert all(after[d] == before[d] for d in after) and len(before) > len(after)
    assert set(stages[4][1]) == set(stages[4][2]) and all(r.round_trip for r in stages[4][2].values())


def test_near_duplicate_stage_against_all_links(stages):
    _, before, after, *_ = stages[1]
    sets, by_shingle, parent = {}, {}, {d: d for d in before}
    for d in sorted(before):
        words = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m.group().lower(), before[d].text))
        sets[d] = {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()

    def top(d):
        while parent[d] != d:
            d = parent[d]
        return d

    for d in sorted(sets):
        shared = {}
        for s in sets[d]:
            for other in by_shingle.setdefault(s, []):
                shared[other] = shared.get(other, 0) + 1
            by_shingle[s].append(d)
        for other, both in shared.items():
            if 100 * both >= 80 * (len(sets[d]) + len(sets[other]) - both):
                a, b = top(d), top(other)
                parent[max(a, b)] = min(a, b)
    assert set(after) == {d for d in sets if top(d) == d}


def test_decontamination_stage_drops_texts_with_items(spark, stages):
    _, before, after, *_ = stages[2]
    items = [" ".join(r.text.lower().split()) for r in table(spark, FOLDER, "benchmark").collect()]
    holding = {d for d, r in before.items() if any(i in " ".join(r.text.lower().split()) for i in items)}
    assert holding and not holding & set(after) and len(set(before) - set(after)) <= len(holding) * 1.5 + 2


def test_personal_data_stage_leaves_none(stages):
    from tableprep.llm.pii import base_spans

    _, before, after, *_ = stages[3]
    held = {d for d, r in before.items() if any(base_spans(r.text).values())}
    assert held and not any(any(base_spans(r.text).values()) for r in after.values())
    assert sum(after[d].text != before[d].text for d in before) <= len(held) * 1.2 + 2
    assert all(r.n_chars == len(r.text) for r in after.values())


def test_run_gives_the_last_stage(spark, stages):
    out = {r.doc_id: r for r in corpus_pipeline.run(spark, FOLDER).collect()}
    assert out == stages[4][2]


def test_entry_registers_everything():
    entry = importlib.import_module("__spark_entry__")
    names = set(entry.queries())
    assert set(QUERIES) | {"pipeline"} <= names and {q.split("_")[0] for q in QUERIES} == {f"op{n}" for n in range(1, 14)}


