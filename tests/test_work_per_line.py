"""Work per line grows with the line: kernels of whole batches against plain twins, and steps that a plan holds once."""

import random
import time

import pytest
from pyspark.sql import functions as F

from glyphflow.functions import labels as LB
from glyphflow.functions import text as T
from glyphflow.operators import evaluate, generate


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def lines(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "line_id long, text string")


def plain_layout(text, spacing, factor, start):
    x, out = start, []
    for i, c in enumerate(text):
        base = 4.0 if c in " .,:;!|il'" else 6.0
        wide = max(1.0, base * factor) if c == " " else base
        after = spacing if c != " " and i + 1 < len(text) and text[i + 1] != " " else 0.0
        out.append((c, x, max(x + 1, x + wide)))
        x = x + wide + after
    return out


def plain_clean(spans):
    inner = [s for i, s in enumerate(spans) if s[0] != " " or (i > 0 and spans[i - 1][0] != " ")]
    while inner and inner[-1][0] == " ":
        inner.pop()
    return inner


def plain_crop(spans, left, right):
    kept = []
    for c, x0, x1 in spans:
        seen = min(x1, right) - max(x0, left)
        if seen <= 0:
            continue
        if (x0 < left or x1 > right) and seen / max(1e-6, x1 - x0) < 0.75:
            if seen / max(1e-6, x1 - x0) <= 0.25:
                continue
            return None
        kept.append((c, x0 - left, x1 - left))
    return plain_clean(kept)


def texts():
    rng = random.Random(3)
    return ["", " ", "  ", "é漢 il"] + ["".join(rng.choice("abil .  é") for _ in range(rng.randint(1, 40))) for _ in range(60)]


def test_layout_of_batches_with_empty_null_and_long_lines(spark):
    every = [*texts(), None, "ab il" * 600]
    began = time.time()
    for spacing in (0.5, -0.37):
        spans = LB.glyph_layout(T.chars(F.col("text")), generate.advances(F.col("text")), F.lit(spacing), F.lit(1.3), F.lit(2.0))
        got = lines(spark, every).select("line_id", spans.alias("s")).collect()
        for r in got:
            assert [tuple(s) for s in r.s] == plain_layout(every[r.line_id] or "", spacing, 1.3, 2.0)
    assert time.time() - began < 40  # a line of 3000 characters was split at each of them


def test_crops_and_clean_spans_equal_plain_ones(spark, monkeypatch):
    every = texts()
    laid = generate.laid_out(lines(spark, every), padding=2).cache()
    want = {r.line_id: ([tuple(s) for s in r.spans], r.width) for r in laid.collect()}
    for pairs in (LB.PAIRS, 5):
        monkeypatch.setattr(LB, "PAIRS", pairs)
        got = {(r.line_id, r.left): (r.text, [tuple(s) for s in r.spans]) for r in generate.line_crops(laid, 30, 7).collect()}
        expected = {}
        for k, (spans, width) in want.items():
            for left in range(0, width - 30 + 1, 7) if width >= 30 else ():
                own = plain_crop(spans, left, left + 30)
                if own:
                    expected[k, left] = ("".join(s[0] for s in own), own)
        assert got == expected
    for r in generate.cleaned(laid).collect():
        assert [tuple(s) for s in r.spans] == plain_clean(want[r.line_id][0])


def test_dense_labels_and_cuts_of_spans_in_any_order(spark):
    rng = random.Random(5)
    rows = [(0, []), (1, [("a", 2.0, 6.0)])]
    for k in range(2, 80):
        at, spans = rng.uniform(-3, 3), []
        for _ in range(rng.randint(1, 9)):
            w = rng.choice([1.0, 4.0, 6.5])
            spans.append((rng.choice("abc?"), at, at + w))
            at += w + rng.choice([0.0, 0.5, 3.0, -0.7])
        if k % 3 == 0:
            rng.shuffle(spans)
        rows.append((k, spans))
    df = spark.createDataFrame(rows, "k int, spans array<struct<ch:string,x0:double,x1:double>>")
    alphabet = F.array(*map(F.lit, " abc"))
    got = df.select("k", LB.dense_labels(F.col("spans"), alphabet, F.lit(40)).alias("d"), LB.cut_projection(F.col("spans"), F.lit(40), 2, True).alias("c")).collect()
    for r in got:
        spans = dict(rows)[r.k]
        dense = []
        for x in range(40):
            c = x + 0.5
            if not spans or c < min(s[1] for s in spans) or c >= max(s[2] for s in spans):
                dense.append(0)
                continue
            over = [s for s in spans if s[1] <= c < s[2]] or [min(spans, key=lambda s: abs((s[1] + s[2]) / 2 - c))]
            dense.append(" abc".find(over[0][0]))
        assert r.d == dense
        cuts = [(a[2] + b[1]) / 2 for a, b in zip(spans, spans[1:], strict=False)] + ([spans[0][1], spans[-1][2]] if spans else [])
        places = [p for p in (round(c - 0.5) for c in cuts) if 0 <= p < 40]
        assert r.c == pytest.approx([max((1 - abs(x - p) / 3 for p in places if abs(x - p) <= 2), default=0.0) for x in range(40)])


def test_a_distance_is_taken_once(spark):
    df = spark.createDataFrame([("abc", "abd", ""), ("abc", "abc", ""), ("", "", ""), ("", "x", ""), (None, "a", "")], "gt string, pred string, error string")
    out = evaluate.measured(df)
    assert plan(out).count("levenshtein(") == 1
    assert [(r.exact_match, r.levenshtein, r.gt_len, r.pred_len) for r in out.collect()] == [(0, 1, 3, 3), (1, 0, 3, 3), (1, 0, 0, 0), (0, 1, 0, 1), (None, None, None, 1)]


def test_below_a_share_as_the_uniform_draw(spark):
    df = spark.range(20000)
    for share in (0.0, 0.002, 0.25, 0.999):
        assert df.where(T.hash_below(1, F.col("id"), F.col("id"), share) != (T.hash_uniform(1, F.col("id"), F.col("id")) < share)).count() == 0


def test_lines_as_good_are_judged_at_once(monkeypatch):
    """Pairs of level text tie by hundreds: the medians of their inliers are not taken one by one."""
    import numpy as np

    from glyphflow.operators import images

    rng = np.random.default_rng(4)
    x = np.arange(60.0)
    y = 10 + rng.integers(0, 2, 60) * 0.5
    plain, calls = np.median, []
    monkeypatch.setattr(images.np, "median", lambda *a, **k: calls.append(1) or plain(*a, **k))
    assert images.ransac(x, y, 60.0, 2.0) == (0.0, 10.0) or images.ransac(x, y, 60.0, 2.0)[0] == 0.0
    assert len(calls) <= 1
    for n in (1, 2, 5, 8):
        v = rng.random(n)
        assert images.middle_value(v) == plain(v)


def test_resized_pixels_are_exact_sums_as_in_sql():
    """Weights are whole numbers that add up; DuckDB makes the same ones, and the same pixels, halves included."""
    import duckdb
    import numpy as np

    from glyphflow.operators import images
    from glyphflow.plans.study_queries import _resized

    rows = np.random.default_rng(1).integers(0, 256, (400, 64), np.uint8)
    for n, m in ((64, 51), (64, 85)):
        k = images._cubic(n, m)[1]
        assert k.dtype == np.int64 and (k.sum(axis=1) == images.PART).all()
        values = ", ".join(f"({r}, {i}, {v}::BIGINT)" for r, row in enumerate(rows) for i, v in enumerate(row.tolist()))
        got = duckdb.sql(f"WITH px AS (SELECT * FROM (VALUES {values}) p(line_id, i, v)), {_resized('p', 'px', n, m)} SELECT v FROM p ORDER BY line_id, i").fetchnumpy()["v"]
        assert (got.reshape(len(rows), m) == images.resize(rows, len(rows), m)).all()


def test_lines_are_found_without_a_table_per_image(monkeypatch):
    """Components come from runs at once: a small image makes no DataFrame, and the results are those of a flood fill and of all pairs."""
    import numpy as np

    from glyphflow.operators import images

    rng = np.random.default_rng(6)
    monkeypatch.setattr(images.pd, "DataFrame", None)
    for share in (0.0, 0.1, 0.4, 0.7, 1.0):
        mask = rng.random((9, 23)) < share
        want, n = np.zeros(mask.shape, int), 0
        for y, x in np.argwhere(mask).tolist():
            if want[y, x]:
                continue
            n, todo = n + 1, [(y, x)]
            while todo:
                b, a = todo.pop()
                if 0 <= b < 9 and 0 <= a < 23 and mask[b, a] and not want[b, a]:
                    want[b, a] = n
                    todo += [(b + i, a + j) for i in (-1, 0, 1) for j in (-1, 0, 1)]
        labels, sizes = images._component_sizes(mask)
        assert (labels == want).all() and images.components(mask)[1] == n
        for k in range(n):
            ys, xs = np.nonzero(want == k + 1)
            assert [sizes[c][k] for c in ("first", "area", "left", "top", "w", "h", "x")] == [(ys * 23 + xs).min(), len(xs), xs.min(), ys.min(), np.ptp(xs) + 1, np.ptp(ys) + 1, xs.mean()]
    assert images.line_candidates(np.where(mask, 0, 255).astype(np.uint8))


def test_pairs_that_cannot_win_are_given_up_and_the_best_one_stays(monkeypatch):
    import numpy as np

    from glyphflow.operators import images

    rng = np.random.default_rng(8)
    for n in (2, 3, 9, 60, 130):
        x, y = np.arange(n) * 2.0, np.round(rng.normal(20, 4, n) + np.arange(n) * 0.05)
        found = []
        for quarters, rests in ((1, 1 << 30), (4, 64), (4, 1 << 15)):
            monkeypatch.setattr(images, "QUARTERS", quarters)
            monkeypatch.setattr(images, "RESTS", rests)
            found.append(images.ransac(x, y, 2.0 * n, 2.0))
        assert found[0] == found[1] == found[2]
        assert images.quantiles(y, (0.05, 0.5, 0.98)) == [float(np.quantile(y, q)) for q in (0.05, 0.5, 0.98)]


def test_crop_labels_are_those_of_crops_without_making_spans(spark):
    from glyphflow.plans import score_queries

    every = [*texts(), "il", "漢" * 30]
    laid = generate.laid_out(lines(spark, every), padding=2).cache()
    for width, stride in ((30, 7), (500, 1), (12, 3)):
        got = sorted(tuple(r) for r in generate.crop_labels(laid, width, stride, (1, 6)).collect())
        assert got == sorted(tuple(r) for r in generate.line_crops(laid, width, stride, (1, 6)).select("line_id", "left", "text").collect())
    assert generate.crop_labels(laid.where("text = ''"), 30, 7).count() == 0
    out = score_queries.line_crops(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "_crop_texts(" in out and "_crops(" not in out and "REPARTITION_BY_NUM" in out


def test_lines_are_drawn_at_once_as_glyph_by_glyph():
    import numpy as np

    rng = random.Random(7)
    for height, top, scale in ((24, 5, 2), (9, -3, 1), (12, 4, 2)):
        rows = []
        for k in range(30):
            spans = [(rng.choice("ab é漢."), rng.uniform(-12, 40), 0.0) for _ in range(rng.randint(0, 6) * (k % 9 > 0))]
            rows.append((rng.randint(1, 40), spans))
        got = generate.drawn(np.array([w for w, _ in rows]), [np.array([s[0] for s in own], object) for _, own in rows], [np.array([s[1] for s in own]) for _, own in rows], height, top, scale, 200)
        for (w, spans), image in zip(rows, got, strict=True):
            canvas = np.full((height, w), 200, np.uint8)
            generate.draw(canvas, spans, top, scale)
            assert (image == canvas).all()
    assert generate.drawn(np.zeros(0, int), [], [], 24, 5, 2, 255) == []


def test_resizing_remembers_its_weights_and_stays_exact(monkeypatch):
    import numpy as np

    from glyphflow.operators import images

    def exact(image, h, w):
        at, k = images._cubic(image.shape[0], h)
        out = np.einsum("ikw,ik->iw", image[at].astype(np.int64), k)
        at, k = images._cubic(image.shape[1], w)
        return np.clip((np.einsum("hjk,jk->hj", out[:, at], k) + images.PART**2 // 2) // images.PART**2, 0, 255).astype(np.uint8)

    rng = np.random.default_rng(4)
    for n, m, h, w in ((24, 300, 16, 213), (16, 213, 16, 192), (1, 1, 9, 7), (40, 3, 48, 1), (7, 90, 1, 400), (5, 5, 5, 5)):
        for image in (rng.integers(0, 256, (n, m), np.uint8), rng.choice(np.array([0, 255], np.uint8), (n, m))):
            assert (images.resize(image, h, w) == exact(image, h, w)).all()
    made, cubic = [], images._cubic
    monkeypatch.setattr(images, "_cubic", lambda *a: made.append(a) or cubic(*a))
    for _ in range(50):
        images.resize(image, 11, 13)
    assert len(made) <= 2
    for values in (rng.integers(0, 256, 7, np.uint8), rng.integers(0, 3, (4, 6), np.uint8), np.array([9], np.uint8)):
        assert images.grey_median(values) == np.median(values)
