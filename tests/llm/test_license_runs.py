"""Licence notices wrapped over lines, and notices without a cue."""

import textwrap

from pyspark.sql import functions as F

from glyphflow.llm import licenses

MIT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the \"Software\"), to deal\n"
    "in the Software without restriction, including without limitation the rights\nto use, copy, modify, merge, publish, distribute, sublicense, and/or sell"
)
GPL = (
    "    This program is free software: you can redistribute it and/or modify\n    it under the terms of the GNU General Public License as published by\n"
    "    the Free Software Foundation, either version 3 of the License, or\n    (at your option) any later version."
)


def test_wrapped_and_cueless_notices(spark):
    whole = licenses.TEMPLATES["mit"][1]
    bare = whole.split(" ", 1)[1]
    rows = [
        (0, MIT), (1, "some prose before\n" + GPL + "\nand after it"), (2, bare), (3, textwrap.fill(licenses.TEMPLATES["lgpl"][1], 30)), (4, "\n".join(whole.split())),
        (5, MIT.replace("\n", "\n\n")), (6, "plain prose\nof no account"), (7, "# " + GPL.replace("\n", "\n# ") + "\n\n" + textwrap.fill(licenses.TEMPLATES["apache"][2], 60)),
    ]
    out = licenses.licence_scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    got = {r["doc_id"]: r["families"] for r in out}
    assert got == {0: "mit", 1: "gpl", 2: "mit", 3: "lgpl", 4: "mit", 5: "", 6: "", 7: "apache,gpl"}


def test_no_template_reaches_the_share_without_a_needed_word():
    for own in licenses.GRAMS:
        free = [g for g in own if not set(g.split()) & set(licenses.NEEDED)]
        assert len(free) < licenses.LEAST_SHARE * len(own)


def test_names_in_sentences(spark):
    rows = [
        (0, "Distributed under the terms of the MIT license."), (1, "This project uses the Apache 2.0 licence."), (2, "Code is available under GPLv3."), (3, "BSD 3-Clause License"),
        (None, "Released under the MIT License"), (4, "He studied at MIT and lost his driving license."), (5, "The Apache helicopter landed at 2.0 miles"), (6, "x " * 20000 + "\nMPL 2.0\n" + "y " * 20000),
    ]
    df = spark.createDataFrame([(*r, "a", "b", "c") for r in rows], "doc_id long, text string, family string, id string, score string")
    got = {r["doc_id"]: (r["families"], r["score"]) for r in licenses.licence_scan(df).collect()}
    assert {k: v[0] for k, v in got.items()} == {0: "mit", 1: "apache", 2: "gpl", 3: "bsd", None: "mit", 4: "", 5: "", 6: "mpl"}
    assert 0 < got[4][1] < 1
    assert licenses.licence_scan(df.where("false")).count() == 0


def test_gate_is_the_search_for_any_cue_or_word(spark):
    import re

    parts = (*licenses.LINE_CUES, *licenses.NEEDED)
    texts = ["", "plain", "LICENCE", "ünder", "UNDER", "x" * 5000 + " Mpl 2.0", "mpl 2x0", "cc0", "under\nthe", "publİc domain", "PUBLIC DOMAIN", "pub lic domain", "SPDX-license-Identifier"]
    df = spark.createDataFrame([(t, bool(re.search("|".join(map(re.escape, parts)), t.lower()))) for t in texts], "text string, want boolean")
    gated = df.select("text", "want", licenses.holds_any(df["text"], parts).alias("got"))
    assert [r["text"] for r in gated.collect() if r["got"] != r["want"]] == []


def test_every_paragraph_of_the_corpus_is_learnt_from(spark, monkeypatch):
    seen = []
    train = licenses.train
    monkeypatch.setattr(licenses, "train", lambda s, negatives: seen.append(negatives.count()) or train(s, negatives))
    rows = [(k, f"prose {k % 1500} of no account\nand more") for k in range(3000)] + [(3000, "Released under the MIT License")]
    out = licenses.licence_scan(spark.createDataFrame(rows, "doc_id long, text string"))
    assert seen == [1500]
    assert {r["doc_id"]: r["families"] for r in out.where("families <> ''").collect()} == {3000: "mit"}


def test_weighted_quantile(spark):
    rows = spark.createDataFrame([(0.2, 998.0), (0.6, 0.5), (0.70000001, 0.5), (0.9, 1.0)], "share double, weight double")
    assert licenses.weighted_quantile(rows, 0.999) == 0.70001
    assert licenses.weighted_quantile(rows, 0.998) == 0.2
    assert licenses.weighted_quantile(rows.limit(0), 0.999) == 0.0


def test_later_paragraphs_are_learnt_from(spark, monkeypatch):
    seen = []
    train = licenses.train
    monkeypatch.setattr(licenses, "train", lambda s, negatives: seen.append(negatives.count()) or train(s, negatives))
    long = "a b c d e f g h i j " * licenses.INNER
    rows = [(k, f"first {k}\n\nthe second {k} of all\nand its end\n \n{long}{k}\nlast {k}") for k in range(10)] + [(10, "first 3\n\n"), (11, "\n \n"), (12, "")]
    licenses.licence_scan(spark.createDataFrame(rows, "doc_id long, text string"))
    assert seen == [40]
    df = spark.createDataFrame(rows, "doc_id long, text string").select("text", licenses.paragraphs(F.col("text")).alias("p"))
    for r in df.collect():
        assert "\n".join(r["p"]).split() == r["text"].split() and all(p.strip() for p in r["p"])


def test_alike_paragraphs_are_one_weighted_row(spark):
    known = licenses.vocabulary(spark)
    df = spark.createDataFrame([("the Xyz of the license",), ("zzz",), ("of the the of",)], "text string")
    got = [r[0] for r in df.select(licenses.known_grams(licenses.words(F.col("text")), known)).collect()]
    assert got == [["license", "of", "of the", "the", "the license"], [], ["of", "of the", "the", "the of"]]
    negatives = spark.createDataFrame([(30, ["a"]), (60, ["a"]), (1, ["a"]), (-1, [])], "h long, _grams array<string>")
    rows = licenses.training_rows(spark, negatives).where("corpus").collect()
    assert sorted((r["v"], r["n"], r["_grams"]) for r in rows) == [(0, 2, ["a"]), (1, 1, ["a"]), (29, 1, [])]
