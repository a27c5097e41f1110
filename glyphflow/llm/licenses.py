"""Operator 4 - licence scans, with DataFrame functions and MLlib only.

Single lines that hold one of the ``CUES``, and runs of neighbouring lines (one
or more, joined by a blank) that hold enough word 3-grams of a template, are
classified by a multinomial
logistic regression with an L1 penalty on hashed word 1- and 2-grams. It is
trained here, on variants of the templates and, as the class ``unknown``, on
``DECOYS`` and on every paragraph of every text without a cue or a needed
word (each distinct one once; together they weigh as much as ``WEIGHT`` rows, so
that the families keep their share at any size). These paragraphs are runs of
lines like those that are classified: a run ends before a line without words, or
when it holds ``INNER`` words, and each line is in one. The vocabulary is that of
the variants and ``DECOYS``: other n-grams name no family, and without them most
paragraphs have few features, so that those alike are one weighted row. A prediction counts if its
probability is above a threshold that held-out unknown rows stay below, and if a template of the predicted family
shares enough word 3-grams with the run of lines.

A run ends before a line without words (a blank line), and its inner lines hold
at most ``INNER`` words, twice the longest template: a notice may be wrapped at
any width. Per first line and template the run of greatest share is classified
(the shortest of them). Texts without any word of ``NEEDED`` are not looked at:
these words are derived so that no template keeps ``LEAST_SHARE`` of its 3-grams
without one of them. A single line with a short name of a family (``NAMES``) is
confirmed by that name.

Defined cases: null text is the empty text, without licences; several families
are listed in alphabetical order; of equally sure families the one on the first
line leads; rows repeated with the same text have equal results; a null id is
carried; very long texts are read whole; an empty table gives an empty result;
other columns are ignored, whatever their names.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import written

FEATURES, VARIANTS, FEW, WEIGHT, LEAST_SHARE = 1 << 12, 30, 6, 600, 0.6
#: Steps of the scale on which the threshold is found.
GRID = 100_000
UNKNOWN = "unknown"
#: Words that make a single line a candidate whatever its share (fixed values).
CUES = ("licens", "licenc", "copyright", "permission", "redistribut", "warrant", "public domain", "all rights")
#: Short names by family (fixed values): a single line that holds one is a candidate and confirms its family.
NAMES = {
    "apache": ("Apache License 2.0", "Apache License Version 2.0", "Apache-2.0 License", "Apache 2.0", "Apache-2.0"), "bsd": ("BSD License", "BSD 3-Clause", "BSD-3-Clause", "BSD 2-Clause", "BSD-2-Clause"),
    "cc-by": ("CC BY 4.0", "CC-BY-4.0"), "cc-by-nc": ("CC BY-NC 4.0", "CC-BY-NC-4.0"), "cc-by-sa": ("CC BY-SA 4.0", "CC-BY-SA-4.0"),
    "gpl": ("GNU General Public License", "GNU GPL", "GPLv3", "GPLv2", "GPL-3.0", "GPL-2.0"), "lgpl": ("GNU Lesser General Public License", "GNU LGPL", "LGPLv3", "LGPLv2.1", "LGPL-2.1", "LGPL-3.0"),
    "mit": ("MIT License", "MIT licence"), "mpl": ("Mozilla Public License", "MPL 2.0", "MPL-2.0"), "public-domain": ("CC0", "CC0-1.0"),
}
#: Sentences that the names are put into for training.
FRAMES = ("{}", "Released under the {}", "This project uses the {}", "Code is available under {}", "Distributed under the terms of the {}", "See the {} for details", "License: {}")
#: Public licence notices by family (fixed values).
TEMPLATES = {
    "apache": (
        "Licensed under the Apache License, Version 2.0",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.',
        'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.',
        "SPDX-License-Identifier: Apache-2.0",
    ),
    "bsd": (
        "Released under the BSD License",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation",
        "SPDX-License-Identifier: BSD-3-Clause",
    ),
    "cc-by": ("Licensed under CC BY 4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    "cc-by-nc": ("Licensed under CC BY-NC 4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    "cc-by-sa": ("Licensed under CC BY-SA 4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    "gpl": (
        "This work is licensed under the GNU General Public License, version 3",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
        "SPDX-License-Identifier: GPL-3.0-or-later",
    ),
    "lgpl": (
        "This library is licensed under the GNU Lesser General Public License, version 2.1",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License",
    ),
    "mit": (
        "Released under the MIT License",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction",
        "SPDX-License-Identifier: MIT",
    ),
    "mpl": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", "Licensed under the Mozilla Public License, Version 2.0"),
    "public-domain": ("This is free and unencumbered software released into the public domain", "This work has been dedicated to the public domain under CC0"),
}
#: Paragraphs that hold a cue and name no family (fixed values).
DECOYS = (
    "You need a driving licence to rent this car", "The warranty covers parts for two years", "All rights reserved by the author", "Copyright is discussed in the next chapter",
    "Ask for permission before you enter the building", "The licence fee is due in March", "He lost his fishing license on the way home", "The statue stands in the public domain of the city",
    "Wealth was redistributed among the farmers", "She gave permission to publish the letter", "A warrant was issued on Monday", "The license plate was unreadable",
)


def _plain_words(template: str) -> list[str]:
    """``words`` of a template (they are ASCII)."""
    return re.sub(r"[^a-z0-9.-]+|[.](?=[^0-9]|$)", " ", template.lower()).split()


def _plain_grams(template: str) -> list[str]:
    """The distinct 3-grams of a template, or its two words where it has no more."""
    own = _plain_words(template)
    n = min(3, len(own))
    return sorted({" ".join(own[i : i + n]) for i in range(len(own) - n + 1)})


def _needed() -> list[str]:
    """Words, the longest first, until fewer than LEAST_SHARE of the 3-grams of each template do without them."""
    out: set[str] = set()
    for t in (t for f in TEMPLATES.values() for t in f):
        all_grams = _plain_grams(t)
        for word in sorted(set(_plain_words(t)), key=lambda w: (-len(w), w)):
            if sum(not out & set(g.split()) for g in all_grams) < LEAST_SHARE * len(all_grams):
                break
            out.add(word)
    return sorted(out)


#: Lines with these are candidates by themselves.
LINE_CUES = (*CUES, *(n.lower() for own in NAMES.values() for n in own if "licen" not in n.lower()))
GRAMS = [_plain_grams(t) for f in TEMPLATES.values() for t in f]
INNER = 2 * max(len(_plain_words(t)) for f in TEMPLATES.values() for t in f)
NEEDED = _needed()


def words(text: Column) -> Column:
    """Lower-case words of letters, digits, dots and dashes."""
    return F.filter(F.split(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}.-]+|[.](?=[^\p{N}]|$)", " "), " "), lambda w: w != "")


def holds_any(text: Column, parts: tuple[str, ...]) -> Column:
    """Whether a text, in lower case, holds any of the parts; a part that holds another one is not looked for."""
    least = [p for p in dict.fromkeys(parts) if not any(o != p and o in p for o in parts)]
    return _let(F.lower(text), lambda low: reduce(lambda a, b: a | b, (F.contains(low, F.lit(p)) for p in least)))


def _let(value: Column, f) -> Column:
    """f(value), with the value computed once however often f names it."""
    return F.element_at(F.transform(F.array(value), lambda v: f(v)), 1)


def grams(tokens: Column, n: int) -> Column:
    """The n-grams of an array of words, joined by a blank."""
    return _let(tokens, lambda t: _grams(t, n))


def _grams(tokens: Column, n: int) -> Column:
    many = F.size(tokens) - n + 1
    return F.when(many > 0, F.transform(F.sequence(F.lit(1), F.greatest(many, F.lit(1))), lambda i: F.array_join(F.slice(tokens, i, n), " "))).otherwise(F.array().cast("array<string>"))


def _features(df: DataFrame) -> DataFrame:
    return HashingTF(inputCol="_grams", outputCol="features", numFeatures=FEATURES, binary=True).transform(df).drop("_grams")


def _families() -> list[str]:
    return sorted(TEMPLATES)


def labelled_rows(spark: SparkSession) -> DataFrame:
    """(label, v, _words): variants of templates and decoys with every tenth word or so left out."""
    rows = [(k, t, VARIANTS) for k, f in enumerate(_families()) for t in TEMPLATES[f]] + [(len(TEMPLATES), t, VARIANTS) for t in DECOYS]
    rows += [(k, s.format(n), FEW) for k, f in enumerate(_families()) for n in NAMES[f] for s in FRAMES]
    plain = spark.createDataFrame(rows, "label int, text string, n int").withColumn("v", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    left = F.filter(F.split("text", " "), lambda w, i: (F.col("v") < 6) | (F.pmod(F.xxhash64("text", "v", i), F.lit(10)) > 0))
    return plain.select("label", "v", words(F.array_join(left, " ")).alias("_words"))


def vocabulary(spark: SparkSession) -> list[str]:
    """The word 1- and 2-grams of ``labelled_rows``: as many at any size of the input."""
    return sorted(r[0] for r in labelled_rows(spark).select(F.explode(F.concat("_words", grams(F.col("_words"), 2)))).distinct().collect())


def known_grams(tokens: Column, known: list[str]) -> Column:
    """The distinct 1- and 2-grams of words that are in a vocabulary, sorted."""
    single, double = [g for g in known if " " not in g], [g for g in known if " " in g]

    def of(t: Column) -> Column:
        # A word outside the vocabulary is in no 2-gram of it.
        held = F.transform(t, lambda w: F.when(w.isin(single), w))
        pairs = F.filter(F.zip_with(held, F.slice(held, F.lit(2), F.size(held)), lambda a, b: F.concat(a, F.lit(" "), b)), lambda p: p.isin(double))
        return F.concat(F.array_compact(held), pairs)

    return F.array_sort(F.array_distinct(_let(tokens, of)))


def paragraphs(text: Column) -> Column:
    """The lines of a text as runs, joined by line ends: a run ends before a line without words, or when it holds INNER words (told by their blanks)."""
    shut = lambda s: F.when(s["open"] == "", s["done"]).otherwise(F.concat(s["done"], F.array(s["open"])))
    state = lambda done, run, n: F.struct(done.alias("done"), run.alias("open"), n.cast("int").alias("n"))

    def step(s: Column, line: Column) -> Column:
        run = F.when(s["open"] == "", line).otherwise(F.concat(s["open"], F.lit("\n"), line))
        n = s["n"] + F.size(F.split(line, " "))
        full = state(F.concat(s["done"], F.array(run)), F.lit(""), F.lit(0))
        return F.when(F.trim(line) == "", state(shut(s), F.lit(""), F.lit(0))).when(n >= INNER, full).otherwise(state(s["done"], run, n))

    return F.aggregate(F.split(text, "\n"), state(F.array().cast("array<string>"), F.lit(""), F.lit(0)), step, shut)


def training_rows(spark: SparkSession, negatives: DataFrame) -> DataFrame:
    """(label, v, corpus, n, _grams): the labelled rows, and unknown paragraphs (corpus); n paragraphs of one fold with the same n-grams are one row."""
    own = F.concat("_words", grams(F.col("_words"), 2))
    plain = labelled_rows(spark).select("label", "v", F.lit(False).alias("corpus"), F.lit(1).cast("long").alias("n"), own.alias("_grams"))
    fold = F.pmod("h", F.lit(VARIANTS)).cast("int").alias("v")
    unknown = negatives.groupBy(fold, "_grams").agg(F.count("*").alias("n"))
    return plain.union(unknown.select(F.lit(len(TEMPLATES)).alias("label"), "v", F.lit(True).alias("corpus"), "n", "_grams"))


def train(spark: SparkSession, negatives: DataFrame) -> tuple[LogisticRegressionModel, float]:
    """The classifier, from unknown paragraphs (h, _grams), and the probability that 99.9 % of held-out unknown rows, by weight, stay below (0.5 at least)."""
    rows = written(training_rows(spark, negatives), "licence-training")
    weight = WEIGHT / max(WEIGHT, rows.where("corpus").agg(F.sum("n")).first()[0] or 0)
    ready = _features(rows).withColumn("weight", F.when(F.col("corpus"), F.col("n") * weight).otherwise(1.0))
    held_out = F.col("v") % 5 == 4
    model = LogisticRegression(family="multinomial", regParam=0.002, elasticNetParam=0.5, maxIter=60, weightCol="weight").fit(ready.where(~held_out).select("features", F.col("label").cast("double"), "weight"))
    share = F.array_max(F.slice(vector_to_array("probability"), 1, len(TEMPLATES)))
    unknown = model.transform(ready.where(held_out & (F.col("label") == len(TEMPLATES))))
    return model, max(0.5, weighted_quantile(unknown.select(share.alias("share"), "weight"), 0.999))


def weighted_quantile(rows: DataFrame, part: float) -> float:
    """The least step of GRID that ``part`` of the weight of all rows (share from 0 to 1, weight) does not exceed; 0 without rows."""
    steps = sorted(rows.groupBy(F.ceil(F.col("share") * GRID).alias("step")).agg(F.sum("weight").alias("weight")).collect())
    below, whole = 0.0, sum(r["weight"] for r in steps)
    for r in steps:
        below += r["weight"]
        if below >= part * whole:
            return r["step"] / GRID
    return 0.0


def _template_share(family: Column, tokens: Column) -> Column:
    """The largest share of the 3-grams of a template of that family that the paragraph holds."""
    own = grams(tokens, 3)

    def share(template: str) -> Column:
        theirs = F.array_distinct(grams(words(F.lit(template)), 3))
        return F.size(F.array_intersect(theirs, own)) / F.greatest(F.size(theirs), F.lit(1))

    out = F.lit(0.0)
    for name, templates in TEMPLATES.items():
        shares = [share(t) for t in templates if len(t.split()) > 2]
        out = F.when(family == name, F.greatest(*shares, F.lit(0.0))).otherwise(out)
    short = {n: [t for t in ts if len(t.split()) <= 2] for n, ts in TEMPLATES.items()}
    for name, templates in short.items():
        for t in templates:
            whole = F.array_join(words(F.lit(t)), " ")
            out = F.when((family == name) & F.contains(F.array_join(tokens, " "), whole), F.lit(1.0)).otherwise(out)
    line = F.concat(F.lit(" "), F.array_join(tokens, " "), F.lit(" "))
    for name, own in NAMES.items():
        held = F.lit(False)
        for n in own:
            held = held | F.contains(line, F.concat(F.lit(" "), F.array_join(words(F.lit(n)), " "), F.lit(" ")))
        out = F.when((family == name) & held, F.lit(1.0)).otherwise(out)
    return out


def _held(tokens: Column) -> Column:
    """The 3-grams (and two-word templates) of any template that these words hold."""
    every = sorted({g for own in GRAMS for g in own})
    heads = [g.split()[0] for g in every if g.count(" ") == 1]
    pairs = lambda t: F.when(F.arrays_overlap(t, F.lit(heads)), _grams(t, 2)).otherwise(F.array().cast("array<string>"))
    return _let(tokens, lambda t: F.array_intersect(F.lit(every), F.concat(_grams(t, 3), pairs(t))))


def _share(own: list[str], held: Column) -> Column:
    return F.size(F.array_intersect(F.lit(own), held)) / F.lit(len(own))


def _near(tokens: Column) -> Column:
    """Whether these words hold LEAST_SHARE of a template; so do all words around them then."""
    return _let(_held(tokens), lambda held: F.greatest(*(_share(own, held) for own in GRAMS)) >= LEAST_SHARE)


def _runs(docs: DataFrame, cue: str) -> DataFrame:
    """(id, h, at, _words): runs of lines from line ``at`` to classify."""
    docs = docs.where(F.col("text").rlike(cue) | _near(words(F.col("text"))))
    lines = docs.select("id", F.xxhash64("text").alias("h"), F.split("text", "\n").alias("raw")).withColumn("all", F.transform("raw", words))
    first = lines.select("id", "h", "all", F.posexplode("raw").alias("at", "line"))
    # After the first line: how many lines follow until a line without words, or until the inner lines hold INNER words.
    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("inner"), F.lit(True).alias("open"))
    grow = lambda s, w: F.when(
        s["open"] & (F.size(w) > 0), F.struct((s["n"] + 1).alias("n"), (s["inner"] + F.size(w)).alias("inner"), (s["inner"] + F.size(w) <= INNER).alias("open"))
    ).otherwise(F.struct(s["n"].alias("n"), s["inner"].alias("inner"), F.lit(False).alias("open")))
    more = F.aggregate(F.slice("all", F.col("at") + 2, INNER + 1), start, grow)["n"]
    here = F.element_at("all", F.col("at") + 1)
    block = first.select("id", "h", "at", F.col("line").rlike(cue).alias("cue"), F.explode(F.array(F.slice("all", F.col("at") + 1, F.when(F.size(here) > 0, more + 1).otherwise(1)))).alias("next"))
    near = block.select("*", F.explode(F.array(_near(F.flatten("next")))).alias("near")).where("cue or near")
    # What the runs of 1, 2, .. lines hold; only where the longest run, which holds all of it, reaches the share.
    ends = F.when(F.col("near"), F.sequence(F.lit(1), F.size("next"))).otherwise(F.array().cast("array<int>"))
    runs = F.transform(ends, lambda k: F.struct(k.alias("k"), _held(F.flatten(F.slice("next", F.lit(1), k))).alias("held")))
    rated = lambda runs, own: F.transform(runs, lambda r: F.struct(_share(own, r["held"]).alias("share"), (-r["k"]).alias("k")))
    best = _let(runs, lambda r: F.array(*(F.array_max(rated(r, own)) for own in GRAMS)))
    chosen = F.transform(F.filter(best, lambda b: b["share"] >= LEAST_SHARE), lambda b: -b["k"])
    alone = F.when(F.col("cue"), F.array(F.lit(1))).otherwise(F.array().cast("array<int>"))
    out = near.select("id", "h", "at", "next", F.explode(F.array_union(alone, chosen)).alias("k"))
    return out.select("id", "h", "at", F.explode(F.array(F.flatten(F.slice("next", F.lit(1), F.col("k"))))).alias("_words"))


def licence_scan(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: ``key``, n_candidates (lines with a cue, or where a run that reaches the share begins), families, licence (the surest) and score.

    The score is the probability of that licence, or the greatest of any family where none is sure; 0 without candidates.
    """
    spark, cue = df.sparkSession, rf"(?i){'|'.join(map(re.escape, LINE_CUES))}"
    docs = df.select(F.col(key).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    possible = holds_any(F.col("text"), (*LINE_CUES, *NEEDED))
    known = vocabulary(spark)
    others = docs.where(~possible).select(F.explode(paragraphs(F.col("text"))).alias("text"))
    own = others.select(F.xxhash64("text").alias("h"), known_grams(words(F.col("text")), known).alias("_grams"))
    model, limit = train(spark, own.dropDuplicates(["h"]))  # repeated paragraphs count once

    ready = _features(_runs(docs.where(possible), cue).withColumn("_grams", known_grams(F.col("_words"), known)))
    odds = model.transform(ready).withColumn("p", F.slice(vector_to_array("probability"), 1, len(TEMPLATES)))
    best = F.array_position("p", F.array_max("p")).cast("int")
    judged = odds.select("id", "h", "at", "_words", F.element_at(F.array(*map(F.lit, _families())), best).alias("family"), F.array_max("p").alias("score"))
    sure = (F.col("score") >= limit) & (_template_share(F.col("family"), F.col("_words")) >= LEAST_SHARE)
    judged = judged.select("id", "h", "at", F.when(sure, F.col("family")).alias("family"), "score").distinct()
    found = judged.groupBy("id", "h").agg(
        F.size(F.collect_set("at")).cast("long").alias("n_candidates"), F.array_join(F.array_sort(F.collect_set("family")), ",").alias("families"),
        F.max("score").alias("most"), F.max(F.when(F.col("family").isNotNull(), F.struct("score", F.negative(F.col("at")), "family"))).alias("top"),
    )
    own, found = docs.select("id", F.xxhash64("text").alias("h")), found.withColumnsRenamed({"id": "fid", "h": "fh"})
    out = own.join(found, F.col("id").eqNullSafe(F.col("fid")) & (F.col("h") == F.col("fh")), "left")
    none = F.when(F.col("n_candidates") > 0, F.lit(UNKNOWN)).otherwise(F.lit("none"))
    return out.select(
        F.col("id").alias(key), F.coalesce("n_candidates", F.lit(0)).alias("n_candidates"), F.coalesce("families", F.lit("")).alias("families"),
        F.coalesce("top.family", none).alias("licence"), F.coalesce("top.score", "most", F.lit(0.0)).alias("score"),
    )
