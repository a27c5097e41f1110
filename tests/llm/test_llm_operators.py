"""The training-data operators against libraries and brute force, on small tables with odd rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

public_tokenizers = pytest.importorskip("public_tokenizers")

from glyphflow.llm import components, embedding_dedup, jaccard_join, language_id, language_model, licenses, media_ts, packing, pii, token_counts  # noqa: E402
from glyphflow.llm import sentencepiece_viterbi as sp  # noqa: E402

ODD = [
    None, "", "  ", "a\x1cb c", "<|endoftext|>", "x<|endoftext|>y <|EndOfText|>", "don't Don'T it's", "á e ́x", "İstanbul ΟΔΟΣ ΣΑΣ", "zero\xa0nb", "12 345,6 7.",
    "日本語 テスト。", "a\n\n  b\t\tc   ", "x" * 3000, "ab1" * 900, "😀👩‍👩‍👧 flags", "ﬁ Ⅷ ² ½ ª", "A.B.C. Hello!! ?!", "é.", " 's 'S 've", "word " * 3000, "word " * 3000,
]


@pytest.fixture(scope="module")
def docs(spark):
    """Ids, texts, and columns whose names clash with the operators' own."""
    rows = [(k, t, "n", "bin", "x") for k, t in enumerate(ODD)]
    return spark.createDataFrame(rows, "doc_id long, text string, n_bytes string, bin string, k string").repartition(3)


def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string")


def test_packing_ids_and_places(spark, docs):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    out = packing.best_fit_pack(packing.tokenised_pieces(docs, path)).toPandas()
    own = Tokenizer.from_file(path)
    for k, text in enumerate(ODD):
        ids = [*own.encode(text or "", add_special_tokens=False).ids, 0]
        rows = out[out["doc_id"] == k].sort_values("piece")
        parts = [ids[i : i + 2048] for i in range(0, len(ids), 2048)]
        assert rows["ids_crc32"].tolist() == [zlib.crc32(np.array(p, "<u4").tobytes()) for p in parts]
        assert rows["start"].tolist() == list(range(0, len(ids), 2048)) and rows["length"].tolist() == [len(p) for p in parts]
    for _, seq in out.sort_values("offset").groupby("sequence_id"):
        assert seq["length"].sum() <= 2048
        assert seq["offset"].tolist() == [0, *seq["length"].cumsum().tolist()[:-1]]
    assert packing.best_fit_pack(packing.tokenised_pieces(empty(spark), path)).count() == 0


def test_packing_merges_across_tasks(spark):
    rnd = random.Random(2)
    sizes = [(k, rnd.randint(1, 900)) for k in range(2000)]
    pieces = spark.createDataFrame(sizes, "doc_id long, length long").repartition(40)
    out = packing.best_fit_pack(pieces)
    assert out.select("sequence_id").distinct().count() <= math.ceil(sum(s for _, s in sizes) / 2048) + 8
    assert out.groupBy("sequence_id").agg(F.sum("length").alias("s")).where("s > 2048").count() == 0


def test_embedding_links(spark):
    rng = np.random.default_rng(4)
    base = rng.standard_normal((40, 16))
    x = np.concatenate([base, base[:20] + 0.15 * rng.standard_normal((20, 16)), np.repeat(base[:1], 30, 0), base[1] + 0.1 * rng.standard_normal((40, 16))])
    rows = [(k, v.tolist()) for k, v in enumerate(x)]
    odd = [None, [], [0.0] * 16, [float("nan")] * 16, [1e300] + [float("inf")] * 15, [1.0] * 15]
    rows += [(1000 + k, v) for k, v in enumerate(odd)]
    embedding_dedup.BLOCK, kept = 16, embedding_dedup.BLOCK
    try:
        out = embedding_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).toPandas().set_index("vec_id").sort_index()
    finally:
        embedding_dedup.BLOCK = kept
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    close = u @ u.T >= 0.9
    np.fill_diagonal(close, False)
    label = np.arange(len(x))
    for _ in range(len(x)):
        label = np.array([min([label[i], *label[close[i]]]) for i in range(len(x))])
    assert out.loc[: len(x) - 1, "n_links"].tolist() == close.sum(1).tolist()
    assert out.loc[: len(x) - 1, "component_id"].tolist() == label.tolist()
    assert (out.loc[1000:, "n_links"] == 0).all() and out.loc[1000:, "kept"].all()
    none = spark.createDataFrame([], "vec_id long, embedding array<double>")
    assert embedding_dedup.near_duplicates(none).count() == 0


@pytest.mark.parametrize("finish", [0, 20, 100_000])
def test_components_of_chains_and_stars(spark, monkeypatch, finish):
    monkeypatch.setattr(components, "FINISH", finish)
    chain = [(k, k + 1) for k in range(1, 60)] + [(100, k) for k in range(101, 160)] + [(200, 200)]
    got = {r["id"]: r["component"] for r in components.components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(1, 61), 1), **dict.fromkeys(range(100, 160), 100)}


def test_sentencepiece_best_score_and_round_trip(spark, docs):
    path = public_tokenizers.path("piece_bpe_32k.model")
    model = sp.Pieces(path)
    rnd = random.Random(9)
    cuts = ["".join(rnd.choice("▁aeinrsthou日éẍ.,1") for _ in range(rnd.randint(1, 14))) for _ in range(400)]
    for cut in ("▁Hello", "▁▁▁x", "▁ê", "abcabcthe", "▁日本x", *cuts):
        best = [0.0] + [-math.inf] * len(cut)
        for e in range(1, len(cut) + 1):
            for a in range(e):
                if cut[a:e] in model.score:
                    best[e] = max(best[e], best[a] + model.score[cut[a:e]][1])
            if cut[e - 1] not in model.score:
                best[e] = max(best[e], best[e - 1] + model.worst)
        score, at = 0.0, 0
        ids = model.viterbi(cut)
        while at < len(ids):
            if ids[at] in model.byte_value:
                score += model.worst
                at += len(bytes([model.byte_value[ids[at]]])) and {0: 1, 12: 2, 13: 2, 14: 3, 15: 4}.get(model.byte_value[ids[at]] >> 4, 1)
            else:
                score += model.score[model.text[ids[at]]][1]
                at += 1
        assert score == pytest.approx(best[-1])
    coded = sp.encode(docs, path, check=True)
    assert coded.where(~F.col("restored")).count() == 0
    marked = spark.createDataFrame([(1, "a▁b"), (None, "a b"), (2, "x" * 200_000)], "doc_id long, text string")
    assert {r["doc_id"]: r["restored"] for r in sp.encode(marked, path, check=True).collect()} == {1: False, None: True, 2: True}
    assert sp.encode(empty(spark), path, check=True).count() == 0
    back = {r["doc_id"]: r["text"] for r in sp.decode(coded, path).collect()}
    assert back == {k: t or "" for k, t in enumerate(ODD)}


def test_license_families(spark):
    rows = [
        (0, "prose\nReleased under the MIT License.\nmore"), (1, "Licensed under the Apache License, Version 2.0.\nLicensed under CC BY-NC 4.0."), (2, None), (3, "the driving licence was lost"),
        (4, ""), (5, "This work is licensed under the GNU General Public License, version 3."), (5, "This work is licensed under the GNU General Public License, version 3."), (6, "plain prose of no account"),
    ]
    out = licenses.licence_scan(spark.createDataFrame(rows, "doc_id long, text string"))
    got = [(r["doc_id"], r["families"], r["licence"]) for r in out.orderBy("doc_id").collect()]
    assert [x[1] for x in got] == ["mit", "apache,cc-by-nc", "", "", "", "gpl", "gpl", ""]
    assert got[3][2] == "unknown" and got[2][2] == "none"


def base_spans(text):
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m.group().split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = [int(c) for c in re.sub("[ -]", "", m.group())][::-1]
        if 13 <= len(d) <= 19 and sum(v if i % 2 == 0 else v * 2 - 9 * (v > 4) for i, v in enumerate(d)) % 10 == 0:
            out.append(("card", *m.span()))
    return out + [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(re.sub("[^0-9]", "", m.group())) <= 15]


def test_pii_spans_and_redaction(spark, docs):
    rnd = random.Random(5)
    texts = [*ODD, "a@b.co_x@c.de a@b@c.d", "1.2.3.4.5.6.7.8 000255.1.1.1", "+1 (415) 555-0100 ++12 345 678 90.", "4111 1111 1111 1111", "my GB82 WEST 1234 5698 7654 32", "a" * 9000 + "@"]
    texts += ["".join(rnd.choice("aA.@-+ 0112345679()%é") for _ in range(rnd.randint(1, 120))) for _ in range(800)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in pii.pii_report(df).collect():
        want = ",".join(f"{k}:{a}:{b}" for k, a, b in base_spans(texts[r["doc_id"]] or ""))
        assert r["base_sha256"] == hashlib.sha256(want.encode()).hexdigest()
    clean = {r["doc_id"]: r["text"] for r in pii.redacted(df).collect()}
    assert clean[len(ODD) + 3] == "[card]" and clean[len(ODD) + 4] == "my [iban]" and clean[0] is None and clean[1] == ""


def test_language_id(spark):
    rnd = random.Random(1)
    words = {"en": "the of and to in that is was for with".split(), "de": "der die und in den von zu das mit sich".split(), "fr": "le la les et des en un du une que".split()}
    rows = [(k, " ".join(rnd.choices(words[lang], k=30)), lang) for k, lang in enumerate(["en", "de", "fr"] * 60)]
    rows += [(1000, None, "en"), (1001, "123 !!", "de"), (1002, "und die der das", None), (1003, "the that was for", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    out = {r["doc_id"]: r for r in language_id.identify_languages(df, training=F.col("doc_id") % 4 != 2).collect()}
    held = [(k, lang) for k, _, lang in rows[:180] if k % 4 == 2]
    assert sum(out[k]["lang_pred"] == lang for k, lang in held) / len(held) > 0.97
    assert [out[k]["lang_pred"] for k in (1000, 1001, 1002, 1003)] == ["und", "und", "de", "en"]
    assert all(0 <= r["score"] <= 1 for r in out.values())
    unlearnt = language_id.identify_languages(df, training=F.lit(False))
    assert unlearnt.where("lang_pred <> 'und'").count() == 0 and language_id.identify_languages(empty(spark)).count() == 0


def test_token_counts_equal_the_library(spark, docs):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    own = Tokenizer.from_file(path)
    for r in token_counts.token_counts(docs, path).collect():
        text = ODD[r["doc_id"]] or ""
        n = len(own.encode(text, add_special_tokens=False).ids)
        assert (r["n_tokens"], r["n_bytes"], r["over_limit"]) == (n, len(text.encode()), n > 512)


@pytest.mark.parametrize(("k", "percent"), [(4, 85), (2, 80)])
def test_jaccard_components(spark, k, percent):
    rnd = random.Random(3)
    rows = [(i, " ".join(rnd.choice(["a", "b", "c", "D", "é"]) for _ in range(rnd.randint(0, 9)))) for i in range(150)]
    base = [" ".join(f"w{rnd.randint(0, 400)}" for _ in range(rnd.randint(3, 60))) for _ in range(20)]
    for i in range(200, 450):
        words = rnd.choice(base).split()
        for _ in range(rnd.choice([0, 0, 1, 1, 2])):
            words[rnd.randrange(len(words))] = f"W{rnd.randint(0, 400)}"
        rows.append((i, "\t".join(words)))
    rows += [(2000, None), (2001, ""), (2002, " \n "), (2003, base[0]), (2003, base[0])]
    sets, lists, root = {}, defaultdict(list), {}
    for i, t in dict(rows).items():
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))
        sets[i] = {tuple(words[j : j + k]) for j in range(len(words) - k + 1)} if len(words) >= k else {tuple(words)} - {()}
        root[i] = i
        for g in sets[i]:
            lists[g].append(i)
    shared = Counter((a, b) for own in lists.values() for x, a in enumerate(own) for b in own[x + 1 :])

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for (a, b), n in shared.items():
        if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    jaccard_join.BLOCK, kept = 16, jaccard_join.BLOCK
    try:
        out = jaccard_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), k=k, percent=percent).collect()
    finally:
        jaccard_join.BLOCK = kept
    assert len(out) == len(rows)
    assert all((r["n_shingles"], r["component_id"]) == (len(sets[r["doc_id"]]), find(r["doc_id"])) for r in out)
    assert jaccard_join.jaccard_components(empty(spark)).count() == 0


def test_light_boundary():
    assert jaccard_join.light_boundary({3: 10, 7: 10, 13: 10}, 5.0, 85) >= 3
    assert jaccard_join.light_boundary({n: 100 for n in range(1, 21)}, 1.0, 85) < 20
    for a in range(1, 60):
        for b in range(a, 60):
            c = jaccard_join.pair_overlap(a, b, 85)
            assert c > a or c >= jaccard_join.least_overlap(b, 85)


def test_language_model(spark):
    rnd = random.Random(6)
    rows = [(i, " ".join(rnd.choice(["a b c d", "x Y z"]) for _ in range(rnd.randint(1, 40)))) for i in range(300)] + [(1000, None), (1001, ""), (1002, "never seen words")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    learn = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10 != 0
    out = {r["doc_id"]: r for r in language_model.language_model_scores(df, learn).collect()}
    tokens = {i: [*(t or "").lower().split(), None] for i, t in rows}
    c = Counter(w for i, own in tokens.items() if zlib.crc32(str(i).encode()) % 10 for w in own)
    n, v = sum(c.values()), len(c)
    for i, own in tokens.items():
        assert out[i]["base_score"] == pytest.approx(sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in own))
        assert (out[i]["n_tokens"], out[i]["n_known"], out[i]["train_tokens"]) == (len(own), sum(c[w] > 0 for w in own), n)
    held = [r for r in out.values() if r["held_out"] and r["n_tokens"] > 20]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)
    assert language_model.language_model_scores(df, F.lit(False)).agg(F.max("base_score").alias("m")).first()["m"] == 0
    assert language_model.language_model_scores(empty(spark), F.lit(True)).count() == 0


def test_gru_gradients():
    from glyphflow.llm import gru_model as g

    counts = np.array([9.0, 5, 4, 2, 1, 1])
    shape = g.Shape(6, g.class_starts(counts))
    texts = [np.array([0, 1, 2, 5, 3], np.int32), np.array([4, 0], np.int32), np.array([2] * 40, np.int32)]
    p = g.initial(shape, counts)
    whole = g.score(p, shape, texts, 0)
    assert whole == pytest.approx([g.score(p, shape, [t], 0)[0] for t in texts], rel=1e-5)
    total = 0.0
    for a in range(6):  # next-symbol probabilities sum to one
        total += math.exp(g.score(p, shape, [np.array([a], np.int32)], 0)[0])
    assert total == pytest.approx(1, rel=1e-5)
    before = whole.sum()
    memory = {k: np.full_like(x, 1e-6) for k, x in p.items()}
    for _ in range(5):
        g.train(p, shape, texts, 0, memory)
    assert g.score(p, shape, texts, 0).sum() > before


def test_media_round_trip(spark, docs):
    for r in media_ts.transport_streams(docs, keep_media=True).collect():
        data = (ODD[r["doc_id"]] or "").encode()
        payload = media_ts.padded(data)
        assert r["payload_sha256"] == hashlib.sha256(payload).hexdigest() and r["tail_crc32"] == zlib.crc32(payload[-32:])
        assert (r["n_bytes"], r["payload_bytes"], r["media_bytes"]) == (len(data), len(payload), len(r["media"]))
        read = media_ts.demux(bytes(r["media"]))
        assert read["payload"] == payload and read["jumps"] == 0
        assert r["timestamps"] == [3600 * k for k in range(len(payload) // 576)]
        assert [p["pts"] for p in r["access_points"]] == r["timestamps"][::12]
        assert all(r["media"][188 * p["packet"]] == 0x47 and r["media"][188 * p["packet"] + 5] & 0x40 for p in r["access_points"])
    assert media_ts.transport_streams(empty(spark)).count() == 0
    stream = bytearray(media_ts.mux(media_ts.padded(b"x" * 3000)))
    stream[188 * 4 + 3] ^= 1  # a wrong continuity counter
    assert media_ts.demux(bytes(stream))["jumps"] > 0


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    prose = "one two three four five six seven eight nine ten eleven twelve"
    rows = [(0, prose, "en", "s", 9), (1, prose, "en", "s", 9), (2, None, None, None, None), (3, "99 88", "en", "s", 5), (4, "write to a@b.org today please", "en", "s", 9), (5, "une autre phrase claire", "fr", "s", 9)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = corpus_pipeline.STAGES[0][1](spark, docs, str(tmp_path))
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {0, 1, 4, 5}
    alone = corpus_pipeline.STAGES[1][1](spark, kept, str(tmp_path))
    assert {r["doc_id"] for r in alone.collect()} == {0, 4, 5}
    clean = {r["doc_id"]: r for r in corpus_pipeline.STAGES[2][1](spark, alone, str(tmp_path)).collect()}
    assert clean[4]["text"] == "write to [email] today please" and clean[4]["n_chars"] == len(clean[4]["text"]) and clean[0]["text"] == prose
    assert {r["doc_id"] for r in corpus_pipeline.run(spark, str(tmp_path)).collect()} == {0, 4, 5}
