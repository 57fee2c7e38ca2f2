"""License scan: MinHash bands retrieve templates for text windows, shingle containment verifies; DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from geoflow.llm.common import documents, held, spill

WORDS, CONTAINMENT = 5, 0.8
#: Likeness from which a window must be retrieved, and how surely: sets the number of bands.
LIKENESS, SURE, ROWS = 0.5, 0.999, 2

# Notices of public licenses, as fixed values (name, text).
LICENSES = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "This project is licensed under the terms of the MIT license."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("LGPL", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."),
    ("CC-BY-NC-SA-4.0", "Licensed under CC BY-NC-SA 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC0-1.0", "This work is dedicated to the public domain under CC0 1.0 Universal."),
]


def bands(likeness: float = LIKENESS, sure: float = SURE, rows: int = ROWS) -> int:
    """The fewest bands of `rows` minima that retrieve a pair of this likeness with probability `sure`."""
    b = 1
    while 1 - (1 - likeness**rows) ** b < sure:
        b += 1
    return b


def words(text: Column) -> Column:
    """Lower-case words without the punctuation around them."""
    bare = F.transform(F.split(F.lower(F.coalesce(text, F.lit(""))), r"\s+"), lambda x: F.regexp_replace(x, r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", ""))
    return F.filter(bare, lambda x: x != "")


def shingles(tokens: Column, size: int = WORDS) -> Column:
    """Hashes of all runs of `size` words, in order."""
    n = F.size(tokens) - size
    return F.when(n >= 0, F.transform(F.sequence(F.lit(0), F.greatest(n, F.lit(0))), lambda i: F.xxhash64(F.slice(tokens, i + 1, size)))).otherwise(F.array().cast("array<bigint>"))


def keys(window: Column, n: int, rows: int = ROWS) -> Column:
    """The band keys of a window's shingles: each band hashes `rows` minima and its own number."""
    least = lambda seed: F.array_min(F.transform(window, lambda h: F.xxhash64(h, F.lit(seed))))
    return F.array(*(F.xxhash64(F.lit(b), *(least(b * rows + r) for r in range(rows))) for b in range(n)))


def windows_of(length: int, wanted: list[int]) -> Column:
    """Overlapping windows over the shingles `s` for notices of `length` words, those with any shingle in `wanted`."""
    step = max(1, length // 4)
    size = length - WORDS + step  # shingles of a window of length + step - 1 words
    starts = F.sequence(F.lit(0), F.greatest(F.size("s") - (length - WORDS + 1), F.lit(0)), F.lit(step))
    windows = F.transform(starts, lambda i: F.struct(F.lit(length).alias("length"), i.alias("at"), F.slice("s", i + 1, size).alias("w")))
    return F.filter(windows, lambda x: F.arrays_overlap(x["w"], F.array(*map(F.lit, wanted))))


def license_matches(docs: DataFrame, licenses: list[tuple[str, str]] | None = None, id: str = "doc_id", text: str = "text", containment: float = CONTAINMENT) -> DataFrame:
    """(id, license, containment, at_word, n_windows): the licenses whose notice a document holds.

    For each length of notice, text windows a quarter longer overlap so that one holds any whole notice. MinHash bands
    retrieve notices for windows; a notice counts if the window has at least `containment` of its five-word shingles.
    Texts without any shingle of a notice are passed over first: they cannot match. `at_word` is the first word of the
    first best window. The words of a match run from its first to its last shingle of the notice; a lesser match whose
    words overlap those of a better one does not count. Null, empty and shorter texts match nothing; notices of under five words cannot be asked for;
    repeated rows of one id give one row a license; rows with null ids are left out.
    """
    spark = docs.sparkSession
    table = spark.createDataFrame([(i, name, notice) for i, (name, notice) in enumerate(licenses or LICENSES)], "no int, license string, notice string")
    table = held(table, "t", words(F.col("notice")))
    asked = table.select("no", "license", F.array_distinct(shingles(F.col("t"))).alias("wanted"), F.size("t").alias("length")).where(F.size("wanted") > 0)
    asked = [r.asDict() for r in asked.collect()]  # as many rows as notices
    if not asked:
        return docs.select(F.col(id), F.lit("").alias("license"), F.lit(0.0).alias("containment"), F.lit(0).alias("at_word"), F.lit(0).cast("long").alias("n_windows")).limit(0)
    n, lengths = bands(), sorted({r["length"] for r in asked})
    known = sorted({h for r in asked for h in r["wanted"]})
    rows = held(docs.select(F.col(id).alias("id"), F.col(text).cast("string").alias("text")).where("id IS NOT NULL"), "t", words(F.col("text")))
    rows = held(rows.select("id", "t"), "s", shingles(F.col("t"))).select("id", "s")
    rows = spill(rows.where(F.arrays_overlap("s", F.array(*map(F.lit, known)))), "scanned")
    each = [windows_of(length, sorted({h for r in asked if r["length"] == length for h in r["wanted"]})) for length in lengths]
    windows = rows.select("id", F.explode(F.flatten(F.array(*each))).alias("x")).select("id", "x.*")
    hashed = windows.select("id", "length", "at", "w", F.explode(keys(F.col("w"), n)).alias("key"))
    notices = spark.createDataFrame([(r["no"], r["license"], r["length"], r["wanted"]) for r in asked], "no int, license string, length int, wanted array<bigint>")
    notices = notices.select("no", "license", "length", "wanted", F.explode(keys(F.col("wanted"), n)).alias("key"))
    met = hashed.join(F.broadcast(notices), ["length", "key"]).select("id", "license", "at", "length", "w", "wanted", (F.size(F.array_intersect("w", "wanted")) / F.size("wanted")).alias("containment"))
    places = F.filter(F.transform("w", lambda h, i: F.when(F.array_contains("wanted", h), i)), lambda i: i.isNotNull())
    met = met.where(F.col("containment") >= containment).select("id", "license", "at", "length", "containment", places.alias("places"))
    met = met.select("id", "license", "at", "length", "containment", (F.col("at") + F.array_min("places")).alias("begins"), (F.col("at") + F.array_max("places") + WORDS - 1).alias("ends"))
    met = spill(met.distinct(), "matches")
    # a better match of the same words stands for them: versions of one license share most of their words
    cells = F.explode(F.sequence(F.floor(F.col("begins") / max(lengths)), F.floor(F.col("ends") / max(lengths)))).alias("cell")
    spans = met.select("id", "containment", "begins", "ends").distinct().select("*", cells)
    better = spans.select("id", "cell", *(F.col(c).alias(f"b_{c}") for c in ("containment", "begins", "ends")))
    overlap = (F.col("b_containment") > F.col("containment")) & (F.col("b_begins") <= F.col("ends")) & (F.col("begins") <= F.col("b_ends"))
    lesser = spans.join(better, ["id", "cell"]).where(overlap).select("id", "containment", "begins", "ends").distinct()
    found = met.join(lesser, ["id", "containment", "begins", "ends"], "left_anti")
    best = F.min(F.struct((-F.col("containment")).alias("c"), F.col("at").alias("at"))).alias("best")
    return found.groupBy(F.col("id").alias(id), "license").agg(best, F.count_distinct("length", "at").alias("n_windows")).select(id, "license", (-F.col("best.c")).alias("containment"), F.col("best.at").alias("at_word"), "n_windows")


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_matches(documents(spark, sf_dir))
