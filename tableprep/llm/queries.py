"""One query for each operator over its whole table, with production parameters, and SQL where there is some."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(function: Query) -> Query:
        QUERIES[name] = function
        if sql is not None:
            SQL[name] = sql
        return function

    return register


# The crc32 of a text in DuckDB, which has none: its bytes, and eight steps for each.
CRC32 = """xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(0, octet_length(encode({0}))),
    lambda i: ('0x' || substr(hex(encode({0})), 2 * i + 1, 2))::BIGINT)), lambda crc, byte:
    list_reduce(list_prepend(xor(crc, byte), range(0, 8)), lambda c, i: xor(c >> 1, 3988292384 * (c & 1)))))"""
LOWER_SQL = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

SQL_OP12 = f"""
WITH RECURSIVE runs AS (
  SELECT doc_id, run, count(*) AS k FROM (
    SELECT doc_id, unnest(regexp_extract_all({LOWER_SQL.format('text')}, '[A-Za-z\u00C0-\u00FF]+')) AS run FROM documents) GROUP BY ALL),
hashed AS (SELECT run, k, {CRC32.format("(coalesce(doc_id::VARCHAR, '') || ':' || run)")} AS h FROM runs),
spelt AS (
  SELECT CASE WHEN h % 199 = 0 THEN substr(run, 1, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word, k
  FROM hashed),
words AS (SELECT word, sum(k)::BIGINT AS n FROM spelt WHERE length(word) >= 6 GROUP BY word HAVING sum(k) >= 5),
cut AS (SELECT word, n, p, substr(word, 1, p - 1) || substr(word, p + 1) AS rest
        FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS p FROM words)),
pairs AS (SELECT a.word, b.word AS other FROM cut a JOIN cut b USING (p, rest) WHERE a.word <> b.word
          UNION SELECT c.word, w.word FROM cut c JOIN words w ON w.word = c.rest
          UNION SELECT w.word, c.word FROM cut c JOIN words w ON w.word = c.rest),
near AS (SELECT p.word, p.other, w.n AS other_n FROM pairs p JOIN words w ON w.word = p.other),
best AS (SELECT word, count(*) AS n_near, first(other ORDER BY other_n DESC, encode(other)) AS other, max(other_n) AS other_n FROM near GROUP BY word),
forms AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN other_n >= 5 * w.n THEN other END AS form,
                 CASE WHEN other_n >= 5 * w.n THEN other_n END AS form_n FROM words w LEFT JOIN best USING (word)),
steps AS (SELECT word, word AS root, form AS onward FROM forms
          UNION ALL SELECT s.word, f.word, f.form FROM steps s JOIN forms f ON f.word = s.onward)
SELECT f.word, f.form, s.root, f.n, f.n_near, f.form_n FROM forms f JOIN steps s ON s.word = f.word AND s.onward IS NULL
"""

SQL_OP13 = f"""
WITH found AS (
  SELECT doc_id, row_number() OVER () AS row_id,
         regexp_extract_all({LOWER_SQL.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents),
runs AS (SELECT row_id, unnest(words) AS word FROM found),
target_runs AS (SELECT unnest(regexp_extract_all({LOWER_SQL.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word FROM benchmark),
buckets AS (SELECT word, {CRC32.format("word")} % 10000 AS bucket FROM (SELECT word FROM runs UNION SELECT word FROM target_runs)),
s AS (SELECT bucket, count(*)::DOUBLE AS s FROM runs JOIN buckets USING (word) GROUP BY bucket),
t AS (SELECT bucket, count(*)::DOUBLE AS t FROM target_runs JOIN buckets USING (word) GROUP BY bucket),
totals AS (SELECT (SELECT coalesce(sum(s), 0) FROM s) AS ss, (SELECT coalesce(sum(t), 0) FROM t) AS tt),
gains AS (SELECT b.bucket, floor(1000 * ln((coalesce(t, 0) + 1) * (ss + 10000) / ((coalesce(s, 0) + 1) * (tt + 10000))))::BIGINT AS gain
          FROM (SELECT DISTINCT bucket FROM buckets) b LEFT JOIN s USING (bucket) LEFT JOIN t USING (bucket), totals),
sums AS (SELECT row_id, sum(gain)::BIGINT AS total, count(*) AS n FROM runs JOIN buckets USING (word) JOIN gains USING (bucket) GROUP BY row_id),
weighed AS (
  SELECT doc_id, coalesce(n, 0) AS n_features, CASE WHEN n IS NULL THEN 0 ELSE (total - ((total % n) + n) % n) // n END AS weight,
         ('0x' || substr(sha256('2024:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT AS h
  FROM found LEFT JOIN sums USING (row_id)),
scored AS (SELECT *, weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score FROM weighed),
ranked AS (SELECT doc_id, n_features, weight, score,
                  CASE WHEN n_features >= 20 THEN row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) END AS place,
                  (SELECT count(*) FROM scored WHERE n_features >= 20) AS n FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= 10 * n // 100 THEN place END AS rank FROM ranked
"""


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def held_out(id_col: str = "doc_id"):
    """Rows whose labels no model may learn from."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % 5 == 0


@query("op1_quality")
def quality(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's quality from its text and its source and language as host and path."""
    from tableprep.llm.quality import fit, score

    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    model = fit(docs, labels, usable=~held_out())
    scored = score(docs, labels, model, F.col("source"), F.col("lang"), usable=~held_out())
    return scored.select("doc_id", "host", "path", "evidence", "site", F.col("quality").alias("score"),
                         (F.col("quality") >= 0.5).cast("int").alias("predicted"), held_out().alias("held_out"))


@query("op5_toxicity")
def toxicity(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's toxicity, learnt from the labels of four fifths."""
    from tableprep.llm.toxicity import fit, score

    docs = table(spark, folder, "documents").select("doc_id", "text")
    model = fit(docs, table(spark, folder, "labels"), usable=~held_out())
    return score(docs, model).select(
        "doc_id", held_out().alias("held_out"), F.col("toxicity").alias("score"),
        (F.col("toxicity") >= 0.5).cast("int").alias("predicted"),
    )


@query("op7_bpe")
def bpe(spark: SparkSession, folder: str) -> DataFrame:
    """Every document encoded and decoded, as digests."""
    import public_tokenizers

    from tableprep.llm.bpe import encode, load_ranks

    ranks = load_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    docs = table(spark, folder, "documents").select("doc_id", "text")
    # One worker encodes and decodes, so the ids go between Spark and Python once.
    return encode(docs, ranks, public_tokenizers.PATTERN, with_decoded=True).select(
        "doc_id", "n_tokens", F.sha2("token_ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )


@query("op10_decontaminate")
def decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    """All pairs of a document and a benchmark item that it holds, up to a tenth of its characters edited."""
    from tableprep.llm.decontaminate import find_items

    docs = table(spark, folder, "documents").select("doc_id", "text")
    found = find_items(docs, table(spark, folder, "benchmark")).select("doc_id", F.explode("leaks").alias("leak"))
    return found.select("doc_id", "leak.*")


@query("op4_pii")
def pii(spark: SparkSession, folder: str) -> DataFrame:
    """Personal data in every document: counts and a digest of the base spans, and all spans."""
    from tableprep.llm.pii import KINDS, find_spans, fit

    docs = table(spark, folder, "documents").select("doc_id", "text")
    found = find_spans(docs, fit(docs))
    base = F.filter("spans", lambda s: s["base"])
    listed = lambda spans: F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ","
    )

    def count(kind: str):
        return F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")

    return found.select(
        "doc_id", *map(count, KINDS), F.sha2(listed(base).cast("binary"), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans")
    )


@query("op3_jaccard")
def jaccard(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's component under links of at least nine tenths of three-word shingles."""
    from tableprep.llm.jaccard import link_components

    docs = table(spark, folder, "documents")
    return link_components(docs, least=90, shingle=3).select("doc_id", "n_shingles", "component_id", "class_id")


@query("op9_suffixes")
def suffixes(spark: SparkSession, folder: str) -> DataFrame:
    """Every document without the stretches of fifty bytes that a smaller doc_id has too, as digests."""
    from tableprep.llm.suffixes import find_repeats, remove_spans

    found = remove_spans(find_repeats(table(spark, folder, "documents"), length=50))
    removed = F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, s: n + (s["to"] - s["from"]))
    return found.select(
        "doc_id", F.octet_length("text").cast("bigint").alias("n_bytes"), removed.alias("n_removed"),
        F.size("spans").cast("bigint").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"),
    )


@query("op6_neighbours")
def neighbours(spark: SparkSession, folder: str) -> DataFrame:
    """The ten nearest vectors found for each vec_id divisible by 100, among all others."""
    from tableprep.llm.neighbours import nearest

    vectors = table(spark, folder, "embeddings")
    return nearest(vectors, vectors.where("vec_id % 100 = 0"))


URL_RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/")]


@query("op2_urls")
def urls(spark: SparkSession, folder: str) -> DataFrame:
    """Every page's url judged by the rules, else by the model of the example urls."""
    from tableprep.llm.urls import example_urls, fit, judge

    pages = table(spark, folder, "pages").select("page_id", "url")
    return judge(pages, URL_RULES, fit(example_urls(spark))).select("page_id", "host", "path", "rule", "verdict", "block_score")


@query("op8_licenses")
def licenses(spark: SparkSession, folder: str) -> DataFrame:
    """Every license wording that a document holds at least four fifths of."""
    from tableprep.llm.licenses import scan, templates

    return scan(table(spark, folder, "documents"), templates(spark))


@query("op11_languages")
def languages(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's language, learnt from three quarters of the rows that name one."""
    from tableprep.llm.language import fit, identify

    docs = table(spark, folder, "documents").select("doc_id", "text", "lang")
    other = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 4 == 2
    found = identify(docs.select("doc_id", "text"), fit(docs, usable=~other))
    return found.select("doc_id", other.alias("held_out"), "lang_pred", "score")


@query("op12_variants", SQL_OP12)
def variants(spark: SparkSession, folder: str) -> DataFrame:
    """Every frequent word of the documents with its more frequent form and the root of its forms."""
    from tableprep.llm.variants import count_words, drop_letters, runs, spelling_forms

    words = count_words(drop_letters(runs(table(spark, folder, "documents")), every=199), least_length=6, least_count=5)
    return spelling_forms(words)


@query("op13_resampling", SQL_OP13)
def resampling(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's weight towards the benchmark, and the tenth of them that is drawn."""
    from tableprep.llm.resampling import resample

    docs = table(spark, folder, "documents").select("doc_id", "text")
    drawn = resample(docs, table(spark, folder, "benchmark"), keep_text=False)
    return drawn.select("doc_id", "n_features", "weight", "score", F.col("rank").cast("bigint").alias("rank"))
