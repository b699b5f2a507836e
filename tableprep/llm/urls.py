"""URL filter: rules by host and path, and logistic regression on hashed character n-grams for all other urls.

Native: Spark SQL expressions and Spark's own estimators; no Python on executors.

Cases: a null url and one without ``://`` have an empty host and path; a host or path of any length is judged whole; empty
ones have no n-grams and get the intercept's verdict; repeated rows are judged each; of rules that fit, the longest wins (of
equally long ones the first by text); without rules or labelled urls the other part decides alone, without both all is
allowed; an empty table gives an empty one; columns named like the new ones are replaced.
"""

from __future__ import annotations

import re

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Lengths of n-grams, and how many hashed columns they have.
SIZES, BUCKETS = (3, 4, 5), 1 << 15
#: Rules are compared one by one within an expression.
MAX_RULES = 1000


def host_of(url: Column) -> Column:
    """From the first ``://`` up to ``/``, ``?``, ``#`` or the end; A-Z in lower case."""
    after = F.substring_index(_after(url), "/", 1)
    host = F.substring_index(F.substring_index(after, "?", 1), "#", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    whole = F.substring_index(F.substring_index(_after(url), "?", 1), "#", 1)
    return F.when(F.instr(whole, "/") > 0, F.substring(whole, F.instr(whole, "/"), F.length(whole))).otherwise("")


def _after(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")


def _rule_fits(rule: str, host: Column, path: Column) -> Column:
    """A rule is a host, with its subdomains, and a path that the url's begins with."""
    domain, slash, rest = rule.partition("/")
    same = (host == domain) | host.endswith("." + domain)
    return same & path.startswith("/" + rest) if slash else same


def ngrams(host: Column, path: Column) -> Column:
    """Character n-grams of ``^host$`` and of the path, marked by where they are from."""

    def of(text: Column, mark: str) -> list[Column]:
        # Neighbours are zipped, so the work grows with the length; a substring by place would count from the start each time.
        chars = F.split(text, "")
        tail = lambda k: F.slice(chars, k + 1, F.size(chars))
        grams, made = F.transform(chars, lambda c: F.concat(F.lit(mark), c)), []
        for k in range(1, max(SIZES)):
            grams = F.array_compact(F.zip_with(grams, tail(k), lambda left, right: F.concat(left, right)))
            made += [grams] if k + 1 in SIZES else []
        return made

    bounded = F.when(host != "", F.concat(F.lit("^"), host, F.lit("$"))).otherwise("")
    return F.concat(*of(bounded, "h"), *of(path, "p"))


def example_urls(spark: SparkSession) -> DataFrame:
    """A small labelled table to start from: invented urls, 1 to block. Callers with labelled urls of their own pass those."""
    bad = """adult-videos adultx xxx-cams porn-tube sex-chat casino-royal online-casino casino-wins lucky-bets free-bet betting-tips
        bet-now poker-room slots-jackpot cheap-pills pills-shop viagra-store discount-meds diet-pills payday-loan quick-loans
        spam-links spamfarm link-farm seo-spam ads-server adtrack click-ads popup-ads tracker-pixel banner-ads warez-crack
        torrent-leaks crack-serial fake-watches replica-bags win-prize free-prize lottery-win earn-money get-rich""".split()
    good = """news library museum university weather science history garden kitchen travel music school forum docs wiki
        health recipes football cinema theatre bank transport city council law books maps art nature climate energy research
        physics chemistry history-blog poetry radio health-centre daily-news open-data my-travels word-book""".split()
    tops, paths = ("com", "net", "org"), ("/", "/en/{}", "/de/{}.html", "/fr/{}/", "/es/{}", "/article/{}", "/post-{}/")
    rows = []
    for label, names in ((1, bad), (0, good)):
        for k, name in enumerate(names):
            for step in range(6):
                prefix = ("", "www.", "m.", "blog.", "www.", "")[(k + step) % 6]
                path = paths[(k * 5 + step) % len(paths)].format(37 * k + 101 * step)
                rows.append((f"http://{prefix}{name}.example{step}.{tops[(k + step) % 3]}{path}", label))
    return spark.createDataFrame(rows, "url string, label int")


def _features(urls: DataFrame, host: Column, path: Column) -> DataFrame:
    grams = urls.withColumn("__grams", ngrams(host, path))
    return HashingTF(numFeatures=BUCKETS, binary=True, inputCol="__grams", outputCol="__features").transform(grams)


def fit(labelled: DataFrame, regularization: float = 0.002):
    """Logistic regression on ``url`` and ``label`` (1 to block); None when there aren't two labels."""
    rows = labelled.select("url", F.col("label").cast("double").alias("__label")).where("__label in (0, 1)")
    labels = rows.agg(F.min("__label"), F.max("__label")).first()
    if labels[0] is None or labels[0] == labels[1]:
        return None
    features = _features(rows, host_of(F.col("url")), path_of(F.col("url"))).select("__label", "__features")
    return LogisticRegression(
        featuresCol="__features", labelCol="__label", regParam=regularization, probabilityCol="__chance",
        predictionCol="__predicted", rawPredictionCol="__raw", maxIter=60,
    ).fit(features)


def judge(pages: DataFrame, rules: list[tuple[str, str]], model, url_col: str = "url") -> DataFrame:
    """``pages`` with ``host``, ``path``, ``rule`` (null if none fits), ``verdict`` and ``block_score`` of the model.

    ``rules``: (verdict, rule) with the verdict allow or block and a rule like ``example.com/en/``.
    """
    if len(rules) > MAX_RULES:
        raise ValueError(f"more than {MAX_RULES} rules")
    if bad := [r for r in rules if r[0] not in ("allow", "block") or not re.match("[^/]", r[1])]:
        raise ValueError(f"no rule: {bad[0]}")
    new = {"host", "path", "rule", "verdict", "block_score"}
    kept = [F.col(f"`{n}`") for n in pages.columns if n.lower() not in new]
    url = F.col(url_col).cast("string")
    rows = pages.select(*kept, F.coalesce(host_of(url), F.lit("")).alias("host"), F.coalesce(path_of(url), F.lit("")).alias("path"))
    host, path = F.col("host"), F.col("path")
    by_length = sorted(set(rules), key=lambda r: (-len(r[1]), r[1], r[0]))
    rule = verdict = F.lit(None).cast("string")
    for decision, text in reversed(by_length):
        fits = _rule_fits(text, host, path)
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, decision).otherwise(verdict)
    rows = rows.withColumn("rule", rule).withColumn("verdict", verdict)
    if model is None:
        rows = rows.withColumn("block_score", F.lit(None).cast("double"))
    else:
        rows = model.transform(_features(rows, host, path)).withColumn("block_score", vector_to_array("__chance")[1])
    judged = F.coalesce("verdict", F.when(F.col("block_score") >= 0.5, "block").otherwise("allow"))
    return rows.withColumn("verdict", judged).drop("__grams", "__features", "__raw", "__chance", "__predicted")
