"""Cross-tokenizer alignment, whitening and repeated passages against brute force, on small tables with odd rows."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

public_tokenizers = pytest.importorskip("public_tokenizers")

from glyphflow.llm import cross_alignment, substring_dedup, whitening  # noqa: E402

ODD = [
    None, "", " ", "  ", "a▁b c", " lead", "trail ", "a  b", "tab\t x", "\n\n x\n", "<|endoftext|> <s> </s> <unk>", "é ü 日本語 😀 x", "a\x00b c", "it's we'll 'd",
    "x" * 3000, "中" * 500, "a ̈b", "a b \x85c", "▁", "ﬁ ½", " " * 700, "don 't 's s", "\r\n a", "word " * 40_000, "same text here", "same text here",
]
A = tuple(map(public_tokenizers.path, ("byte_bpe_50k.json", "byte_bpe_50k.tiktoken")))
B = public_tokenizers.path("piece_bpe_32k.model")


def plain_alignment(text):
    """Counts, groups as text, and the links of one text, from sets of ends."""
    import sentencepiece
    from tokenizers import Tokenizer

    left, right = Tokenizer.from_file(A[0]), sentencepiece.SentencePieceProcessor(model_file=B)
    left.encode_special_tokens = True
    own_a, own_b = cross_alignment.byte_level(A[0], None).pieces, cross_alignment.sentence_pieces(B).pieces
    a, b = left.encode(f" {text}", add_special_tokens=False).ids, right.encode(text or "")
    spelt = f" {text}".encode()
    if not text or b"".join(own_a[k] for k in a) != spelt or b"".join(own_b[k] for k in b) != spelt:
        return 0, 0, 0, "", Counter()
    ends_a, ends_b = np.cumsum([len(own_a[k]) for k in a]).tolist(), np.cumsum([len(own_b[k]) for k in b]).tolist()
    groups, i, j = [], 0, 0
    for end in sorted(set(ends_a) & set(ends_b)):
        i2, j2 = ends_a.index(end, i) + 1, ends_b.index(end, j) + 1
        groups.append(",".join(map(str, a[i:i2])) + "|" + ",".join(map(str, b[j:j2])))
        i, j = i2, j2
    links, i, j = Counter(), 0, 0
    while i < len(a) and j < len(b):
        links[a[i], b[j]] += 1
        x, y = ends_a[i], ends_b[j]
        i, j = i + (x <= y), j + (y <= x)
    return len(a), len(b), len(groups), hashlib.sha256(";".join(groups).encode()).hexdigest(), links


@pytest.mark.parametrize(("head", "ranks"), [(1 << 16, True), (40, False)])
def test_alignment_equals_sets_of_ends(spark, monkeypatch, head, ranks):
    monkeypatch.setattr(cross_alignment, "HEAD", head)
    rows = [(None if k == 8 else k, t, 1, "x", "y") for k, t in enumerate(ODD)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_a int, row string, pair string").repartition(3)
    out = cross_alignment.cross_alignment(df, (A[0], A[1] if ranks else None), B)
    got = {-1 if r["doc_id"] is None else r["doc_id"]: r for r in out.collect()}
    plain = [plain_alignment(t) for t in ODD]
    counts = sum((p[4] for p in plain), Counter())
    best = {}
    for (_, b), c in counts.items():
        best[b] = max(best.get(b, 0), c)
    assert len(got) == len(ODD)
    for k, (n_a, n_b, n_groups, digest, links) in enumerate(plain):
        r = got[-1 if k == 8 else k]
        assert (r["n_a"], r["n_b"], r["n_groups"], r["groups_sha256"]) == (n_a, n_b, n_groups, digest), ODD[k][:20]
        assert r["n_links"] == sum(links.values()) and r["count_sum"] == sum(n * counts[p] for p, n in links.items())
        assert r["n_best"] == sum(n for (a, b), n in links.items() if counts[a, b] == best[b])
    assert cross_alignment.cross_alignment(df.limit(0), A, B).count() == 0


def test_groups_of_random_ends():
    rnd = random.Random(1)
    for _ in range(300):
        n = rnd.randint(1, 60)
        a, b = (sorted({*rnd.sample(range(1, n + 1), rnd.randint(1, n)), n}) for _ in range(2))
        both = sorted(set(a) & set(b))
        got = cross_alignment.group_ends(a, b)
        assert got[0].tolist() == [a.index(x) + 1 for x in both] and got[1].tolist() == [b.index(x) + 1 for x in both]
    assert [len(x) for x in cross_alignment.group_ends([], [])] == [0, 0]


def plain_whitening(x):
    unique = np.unique(x, axis=0)
    n, s = len(unique), unique.sum(axis=0)
    v = (unique - s / n).T @ (unique - s / n) / n
    e, q = np.linalg.eigh(v)
    e, q = e[::-1], q[:, ::-1]
    return n, ((n * x - s) ** 2).sum(axis=1), (x - s / n) @ q / np.sqrt(e), e / e.sum()


def test_whitening_equals_lapack(spark):
    rng = np.random.default_rng(5)
    c = rng.standard_normal((300, 20)) @ np.diag(np.linspace(0.2, 2, 20))
    c[17] = c[3]
    rows = [(k, v.tolist(), 1, "a") for k, v in enumerate(c)] + [(None, c[5].tolist(), 1, "a"), (4, c[5].tolist(), 1, "a")]
    bad = [(900, None, 1, "a"), (901, [1.0, None] + [0.0] * 18, 1, "a"), (902, [float("nan")] * 20, 1, "a"), (903, [float("inf")] * 20, 1, "a"), (904, [], 1, "a")]
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<double>, component int, x string").repartition(4)
    out = whitening.whiten(df).toPandas()
    x = np.floor(c * 64).astype(np.int64) + 1_000_000
    n, deviation, white, explained = plain_whitening(x)
    assert len(out) == 302 * 16 and set(out["n"]) == {n} and out["identity_error"].nunique() == 1 and out["identity_error"].iloc[0] < 1e-12
    for k in range(1, 17):
        own = out[(out["component"] == k) & out["vec_id"].between(0, 299)].drop_duplicates("vec_id").sort_values("vec_id")
        sign = np.sign(own["whitened"].to_numpy() @ white[:, k - 1])
        got = own["whitened"].to_numpy() * sign
        keep = np.arange(300) != 4  # two vectors share id 4
        assert np.allclose(got[keep], white[keep, k - 1], atol=1e-9) and np.allclose(own["explained"], explained[k - 1], rtol=1e-10)
        assert (own["deviation"].to_numpy()[keep] == deviation[keep]).all()
    assert sorted(out[out["vec_id"].isna() | (out["vec_id"] == 4)]["component"]) == sorted([*range(1, 17)] * 3)


def test_whitening_odd_tables(spark):
    schema = "vec_id long, embedding array<float>"
    assert whitening.whiten(spark.createDataFrame([], schema)).count() == 0
    assert whitening.whiten(spark.createDataFrame([(k, [1.0, 2.0]) for k in range(5)], schema)).count() == 0
    flat = [(k, [float(k), 7.0, float(k * k)]) for k in range(9)] + [(100 + k, [float(k % 3), 1.0]) for k in range(9)]
    out = whitening.whiten(spark.createDataFrame(flat, schema)).toPandas()
    assert out[out["vec_id"] < 100]["component"].max() == 2 and set(out[out["vec_id"] >= 100]["n"]) == {3} and out["identity_error"].max() < 1e-9
    huge = spark.createDataFrame([(k, [float(k) * 1e9, float(k % 7)]) for k in range(50)], "vec_id long, embedding array<double>")
    assert whitening.whiten(huge).where("deviation is null").count() > 0


@pytest.mark.parametrize("values", [np.r_[np.full(9, 3.0), np.full(9, 3 + 1e-9), np.arange(14) * 0.01], np.r_[3 + np.arange(16) * 1e-7, 2 + np.arange(16) * 1e-10], np.ones(32), np.zeros(32), np.r_[1, np.zeros(31)], np.geomspace(1e-8, 1e8, 32)])
def test_refined_eigenvectors(values):
    q, _ = np.linalg.qr(np.random.default_rng(2).standard_normal((32, 32)))
    m = (q * values) @ q.T
    m = (m + m.T) / 2
    e, x = whitening.eigen(m)
    wide = x.astype(np.longdouble)
    assert np.abs(wide.T @ wide - np.eye(32)).max() < 1e-15 and np.abs(m @ wide - wide * e).max() <= 2e-15 * max(1, np.abs(m).max())
    assert np.allclose(e, np.sort(np.linalg.eigvalsh(m))[::-1], atol=1e-13 * np.abs(m).max())


def plain_removal(rows, k=13):
    big, first, out = 1 << 63, {}, []
    words = [re.findall(rb"[^\x20\x09-\x0d]+", (t or "").encode()) for _, t in rows]
    for (d, _), w in zip(rows, words, strict=True):
        for i in range(len(w) - k + 1):
            gram = tuple(w[i : i + k])
            first[gram] = min(first.get(gram, big), big if d is None else d)
    for (d, _), w in zip(rows, words, strict=True):
        keep = [True] * len(w)
        for i in range(len(w) - k + 1):
            if first[tuple(w[i : i + k])] < (big if d is None else d):
                keep[i : i + k] = [False] * k
        kept = [x for x, y in zip(w, keep, strict=True) if y]
        out.append((-1 if d is None else d, len(w), len(w) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("block", [8_000_000, 4_000, 300])
def test_passages_equal_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(substring_dedup, "BLOCK_BYTES", block)
    rnd = random.Random(4)
    vocabulary = [f"w{k}" for k in range(400)]
    prose = lambda n: rnd.choices(vocabulary, k=n)
    passages = [prose(rnd.randint(13, 60)) for _ in range(6)]
    texts = [" ".join(sum((prose(rnd.randint(0, 20)) + rnd.choice(passages) for _ in range(rnd.randint(0, 4))), prose(3))) for _ in range(60)]
    texts += [texts[3], texts[3].replace(" ", "\n\t "), None, "", " \n ", "ab " * 12, "ab " * 13, "ab " * 14, "ab " * 13, "cd ef " * 4000, "cd ef " * 30, "x" * 5000, texts[7].upper()]
    ids = [*range(len(texts))]
    ids[10], ids[11], ids[20], ids[21] = None, None, 5, 5
    rnd.shuffle(ids)
    rows = list(zip(ids, texts, strict=True)) + [(ids[0], texts[0]), (ids[0], texts[0])]
    df = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], "doc_id long, text string, block string, o int, pos int").repartition(5)
    out = substring_dedup.substring_dedup(df)
    assert sorted((-1 if r["doc_id"] is None else r["doc_id"], *list(r)[1:]) for r in out.collect()) == plain_removal(rows)
    assert substring_dedup.substring_dedup(df.limit(0)).count() == 0


def test_spans_name_their_sources(spark):
    passage = " ".join(f"p{k}" for k in range(40))
    branch = passage.replace("p20", "other")
    rows = [(1, f"a b {passage} c"), (2, f"{passage} d e f"), (3, f"g h i {branch}"), (4, f"j {branch} k")]
    texts = substring_dedup._texts(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text")
    spans = substring_dedup.repeated_spans(texts.select("block", "o", "text")).toPandas()
    whole = spans[spans["so"] == 1]
    # The first document's stretches: the passage is left at its node before the other word and met again after it.
    assert whole["n"].sum() == 28 and len(whole) >= 2 and set(spans["so"]) == {1, 3}


def test_compaction_breaks_at_branching_nodes(spark):
    # Edges 1>2>3>4 of one document, and 2>9 of another: node 2 branches.
    rows = [(1, 2, 0, 5, 0), (2, 3, 0, 5, 1), (3, 4, 0, 5, 2), (2, 9, 0, 6, 25)]
    ends = substring_dedup.path_ends(spark.createDataFrame(rows, "left long, right long, sb int, so long, sw int"))
    assert sorted(map(tuple, ends.collect())) == [(0, 5, 1), (0, 6, 25)]
    runs = spark.createDataFrame([(0, 10, 5, 0, 0, 3), (1, 3, 6, 0, 25, 1), (1, 70, 4, 4, 0, 2)], "block int, word int, so long, sb int, sw int, n long")
    got = sorted((r["so"], r["word"], r["n"], r["sw"]) for r in substring_dedup.compacted(runs, ends).collect())
    assert got == [(4, 70, 2, 0), (5, 10, 1, 0), (5, 11, 2, 1), (6, 3, 1, 25)]


def test_a_very_long_text(spark):
    text = " ".join(f"v{k % 70_001}" for k in range(200_000))
    df = spark.createDataFrame([(1, text), (0, " ".join(text.split()[500:560]))], "doc_id long, text string")
    got = {r["doc_id"]: r for r in substring_dedup.substring_dedup(df).collect()}
    assert (got[0]["n_removed"], got[1]["n_words"], got[1]["n_removed"]) == (0, 200_000, 60 * 3)
    aligned = cross_alignment.cross_alignment(df.where(F.col("doc_id") == 1), A, B).first()
    assert aligned["n_links"] == aligned["n_a"] + aligned["n_b"] - aligned["n_groups"] > 200_000
