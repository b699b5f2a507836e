"""License scan by MinHash bands of overlapping windows, verified by shingle containment.

Native: Spark SQL expressions only. Words are runs of letters and digits in lower case; their shingles are hashed. A text is cut into
segments of :data:`SEGMENT` shingles, each with ``bands`` minima of its hashes under different orders. For every template size
(rounded up to whole segments) windows of one segment more begin at every segment, so that each place where
a template can stand lies in some window whole; a window's minima are those of its segments. A template is retrieved where
a minimum is also its own. A band is a single minimum, the setting with the highest chance to collide: the Jaccard
similarity of window and template, at least about 0.35 for a window that holds four fifths of a template. With 16 bands
such a template is missed with a chance of about 0.65**16 = 0.001. Templates within one segment have every shingle as a
band and are never missed. Exact containment decides: the share of the template's distinct
shingles in the window (within a segment: in a stretch that reaches the template's size to both sides of the hit).

Cases: null and empty texts hold nothing; a text or template shorter than a shingle has its whole sequence of words as its only one;
texts are scanned whole; repeated rows with the same id are told once; templates without words match nothing, equal
templates are told each; an empty table gives an empty one; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Shingles in a segment.
SEGMENT = 32
#: Templates whose shingles and minima stand in the expressions; more are scanned for in further passes.
PASS_TEMPLATES = 500

# The wording of common licenses and grants.
TEMPLATES = {
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    "MIT grant": "Released under the MIT License.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at",
    "Apache grant": "Licensed under the Apache License, Version",
    "BSD": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "GPL": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version",
    "GPL grant": "licensed under the GNU General Public License, version",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at",
    "CC BY-NC grant": "Licensed under CC BY-NC",
    "CC BY-SA grant": "Licensed under CC BY-SA",
    "Unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
}


def templates(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(TEMPLATES.items()), "license string, text string")


def _orders(bands: int) -> list[int]:
    """A constant for each band; hashes are ordered by their exclusive or with it."""
    return [((k + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1) - (1 << 63) for k in range(bands)]


def with_shingles(df: DataFrame, text_col: str, size: int) -> DataFrame:
    """``df`` with ``shingles``, the hashes of all runs of ``size`` words in order."""
    words = F.filter(F.split(F.lower(F.col(text_col).cast("string")), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    df = df.withColumn("hashed", F.transform(words, lambda w: F.xxhash64(w)))
    hashed, n = F.col("hashed"), F.size("hashed")
    runs = F.transform(F.sequence(F.lit(0), n - size), lambda i: F.xxhash64(*(F.get(hashed, i + k) for k in range(size))))
    shingles = F.when(n >= size, runs).when(n > 0, F.array(F.xxhash64(hashed, F.lit(size)))).otherwise(F.array().cast("array<bigint>"))
    return df.withColumn("shingles", shingles).drop("hashed")


def _minima(shingles: Column, orders: Column) -> Column:
    return F.transform(orders, lambda c: F.array_min(F.transform(shingles, lambda x: x.bitwiseXOR(c))))


def _band_keys(minima: Column) -> Column:
    return F.transform(minima, lambda m, band: F.xxhash64(band, m))


def scan(
    docs: DataFrame, wanted: DataFrame, containment: float = 0.8, shingle: int = 5, bands: int = 16,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """``id_col``, ``license``, ``containment`` (the highest) and ``first_word`` of the first such stretch.

    ``wanted``: license and text. Its size in memory is bounded by :data:`PASS_TEMPLATES` a pass.
    """
    orders = F.array(*(F.lit(c) for c in _orders(bands)))
    sized = with_shingles(wanted.select("license", F.col("text")), "text", shingle).where(F.size("shingles") > 0)
    made = sized.select(
        "license", F.array_distinct("shingles").alias("own"), F.size("shingles").alias("n"),
        F.when(F.size("shingles") <= SEGMENT, F.array_distinct("shingles")).otherwise(_band_keys(_minima(F.col("shingles"), orders))).alias("keys"),
        F.when(F.size("shingles") <= SEGMENT, 0).otherwise(F.ceil(F.size("shingles") / SEGMENT)).cast("int").alias("segments"),
    )
    rows = [row.asDict() for row in made.toLocalIterator()]
    found = None
    for at in range(0, max(1, len(rows)), PASS_TEMPLATES):
        part = _scan_for(docs, rows[at : at + PASS_TEMPLATES], containment, shingle, orders, id_col, text_col)
        found = part if found is None else found.unionByName(part)
    return found


def _scan_for(docs, rows, containment, shingle, orders, id_col, text_col) -> DataFrame:
    spark = docs.sparkSession
    table = spark.createDataFrame(
        [(r["license"], r["own"], r["n"], k, r["segments"]) for r in rows for k in dict.fromkeys(r["keys"])],
        "license string, own array<bigint>, n int, key bigint, segments int",
    )
    texts = with_shingles(docs.select(F.col(id_col), F.col(text_col).alias("text")), "text", shingle).drop("text")
    shingles, n = F.col("shingles"), F.size("shingles")
    sequence = lambda stop: F.when(stop >= 0, F.sequence(F.lit(0), stop)).otherwise(F.array().cast("array<int>"))
    hit = lambda segments, first, key, stretch: F.struct(
        F.lit(segments).alias("segments"), first.cast("int").alias("first"), key.alias("key"), stretch.alias("stretch")
    )
    kinds = []
    if any(not r["segments"] for r in rows):
        # Kept apart for each template size, since the stretch depends on it.
        for size in sorted({r["n"] for r in rows if not r["segments"]}):
            keys = sorted({k for r in rows if not r["segments"] and r["n"] == size for k in r["keys"]})
            kinds.append(_short_hits(size, keys, hit))
    sizes = sorted({r["segments"] for r in rows if r["segments"]})
    if sizes:
        segments = F.transform(sequence(F.floor((n - 1) / SEGMENT).cast("int")), lambda g: _minima(F.slice(shingles, g * SEGMENT + 1, F.lit(SEGMENT)), orders))
        texts = texts.withColumn("minima", segments)
    for count in sizes:
        keys = sorted({k for r in rows if r["segments"] == count for k in r["keys"]})
        kinds.append(_window_hits(count, keys, orders, sequence, hit))
    if not kinds:
        return docs.select(F.col(id_col), F.lit("").alias("license"), F.lit(0.0).alias("containment"), F.lit(0).alias("first_word")).limit(0)
    hits = texts.select(F.col(id_col), F.explode(F.concat(*kinds)).alias("hit")).select(id_col, "hit.*")
    own = table.withColumn("segments", F.when(F.col("segments") > 0, F.col("segments")).otherwise(-F.col("n"))).drop("n")
    pairs = hits.join(own, ["segments", "key"])
    share = F.size(F.array_intersect("own", "stretch")) / F.size("own")
    told = pairs.select(F.col(id_col), "license", "first", share.alias("containment")).where(F.col("containment") >= containment)
    best = told.groupBy(id_col, "license").agg(F.max(F.struct("containment", (-F.col("first")).alias("back"))).alias("best"))
    return best.select(F.col(id_col), "license", F.col("best.containment").alias("containment"), (-F.col("best.back")).alias("first_word"))


def _short_hits(size: int, keys: list[int], hit) -> Column:
    """A hit at each shingle that a template of this size has."""
    places = F.transform("shingles", lambda x, i: F.struct(x.alias("key"), i.alias("at")))
    chosen = F.filter(places, lambda s: s["key"].isin(keys))

    def told(s: Column) -> Column:
        first = F.greatest(s["at"] - (size - 1), F.lit(0))
        return hit(-size, first, s["key"], F.slice("shingles", first + 1, F.lit(2 * size - 1)))

    return F.transform(chosen, told)


def _window_hits(count: int, keys: list[int], orders: Column, sequence, hit) -> Column:
    """A hit for each band of each window that a template of ``count`` segments has too."""

    def of_window(g: Column) -> Column:
        window = F.slice("minima", g + 1, F.lit(count + 1))
        bands = F.transform(orders, lambda c, b: F.xxhash64(b, F.array_min(F.transform(window, lambda m: F.get(m, b)))))
        stretch = F.slice("shingles", g * SEGMENT + 1, F.lit((count + 1) * SEGMENT))
        return F.transform(F.filter(bands, lambda k: k.isin(keys)), lambda k: hit(count, g * SEGMENT, k, stretch))

    return F.flatten(F.transform(sequence(F.size("minima") - 1), of_window))
