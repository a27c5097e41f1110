"""Long forms against numpy, edges from heatmaps, target maps, and what is stored and read back."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from glyphflow.operators import heatmaps, images, losses, profiles
from glyphflow.plans import inputs


def heat_of(top, bottom, height):
    heat = np.zeros((2, height, len(top)))
    x = np.arange(len(top))
    heat[0, np.rint(top).astype(int), x] = heat[1, np.rint(bottom).astype(int), x] = 1.0
    return heat


def test_profiles_equal_the_kernels(spark):
    rng = np.random.default_rng(3)
    mask = rng.random((30, 40)) < 0.2
    mask[:, 7] = False
    ys, xs = np.nonzero(mask)
    points = spark.createDataFrame([(1, int(x), float(y)) for x, y in zip(xs, ys, strict=True)] + [(2, 5, 3.0)], "img long, x int, y double")
    profile = profiles.column_profile(points, 0.88).where("img = 1").orderBy("x").toPandas()
    x, y, w = images.profile_points(mask, 0.88)
    assert profile["x"].tolist() == x.tolist() and profile["y"].to_numpy() == pytest.approx(y) and profile["w"].to_numpy() == pytest.approx(w)
    got = {r["img"]: (r["slope"], r["intercept"]) for r in profiles.weighted_lines(profiles.column_profile(points, 0.88)).collect()}
    assert got[1] == pytest.approx(images.line_fit(x, y, w)) and got[2] == (0.0, 3.0)


def test_candidate_lines_count_all_points(spark):
    points = spark.createDataFrame([(1, x, 2.0 + 0.1 * x + (9.0 if x % 7 == 0 else 0.0)) for x in range(200)], "img int, x int, y double")
    few = profiles.spread_points(points, 20)
    assert few.count() == 20
    best = profiles.candidate_lines(few, points, 24, 0.5).orderBy(F.desc("inliers")).first()
    assert best["inliers"] == 171 and best["slope"] == pytest.approx(0.1)


def test_bounds_and_gaps(spark):
    cols = [2, 10, 11, 12, 14, 15, 16, 90]  # one hole is closed, single columns are no run
    points = spark.createDataFrame([(1, x) for x in cols] + [(2, 5)], "img int, x int")
    assert [tuple(r) for r in profiles.text_bounds(points, 100, 40).orderBy("img").collect()] == [(1, 10, 17), (2, None, None)]
    rows = spark.createDataFrame([("a", 1, None), ("a", 2, 1.0), ("a", 3, None), ("a", 4, 5.0), ("a", 5, None), ("b", 1, None)], "k string, t int, v double")
    filled = profiles.filled_gaps(rows, "v", ["k"], ["t"]).orderBy("k", "t").collect()
    assert [r["filled"] for r in filled] == [1.0, 1.0, 3.0, 5.0, 5.0, None]
    assert [r["smooth"] for r in profiles.running_median(rows.na.fill(0.0), "v", ["k"], ["t"], 1).orderBy("k", "t").collect()] == [0.5, 0.0, 1.0, 0.0, 2.5, 0.0]


def test_resized_maps(spark):
    t = np.random.default_rng(1).random((2, 3, 5))
    df = spark.createDataFrame([(t.reshape(-1).tolist(),)], "t array<double>")
    got = np.array(df.select(losses.resized_maps(F.col("t"), (2, 3, 5), (4, 7)).alias("r")).first()[0]).reshape(2, 4, 7)
    ys, xs = np.mgrid[:4, :7]
    sy, sx = ((ys + 0.5) * 3 / 4 - 0.5).clip(0, 2), ((xs + 0.5) * 5 / 7 - 0.5).clip(0, 4)
    for c in (0, 1):
        assert got[c] == pytest.approx(images.bilinear(t[c], sx, sy, 0))
    same = np.array(df.select(losses.resized_maps(F.col("t"), (2, 3, 5), (3, 5)).alias("r")).first()[0])
    assert same == pytest.approx(t.reshape(-1))


def test_max_pooling_skips_the_last_row(spark):
    cells = spark.createDataFrame([(1, 0, y, 9 if y == 47 else y % 3) for y in range(48)], "line_id int, x int, y int, c int")
    assert [tuple(r) for r in losses.max_pooled(cells, 48).collect()] == [(1, 0, 2)]


def heat_images(spark, heats, width, height):
    """Images that only carry the number of their heatmaps, and the function that looks these up."""
    blank = np.full(width * height, 255, np.uint8)
    rows = []
    for k in range(len(heats)):
        pixels = blank.copy()
        pixels[0] = k
        rows.append((k, width, height, pixels.tobytes()))
    return spark.createDataFrame(rows, "line_id long, w int, h int, pixels binary"), lambda image: heats[int(image[0, 0])]


def test_curved_line_becomes_straight(spark):
    x = np.arange(240)
    base = 40 + 10 * np.sin(x / 50)
    image = np.full((90, 240), 255, np.uint8)
    for k in x:
        image[int(round(base[k] - 8)) : int(round(base[k] + 8)), k] = 0
    df = spark.createDataFrame([(1, 240, 90, image.tobytes())], "line_id long, w int, h int, pixels binary")
    heat = heat_of(base - 8, base + 8, 90)
    r = heatmaps.straightened(df, lambda _: heat, heatmaps.HeatParams(line_pad=0.0, line_pad_px=4.0)).first()
    assert r["status"] == "ok_curved" and r["body"] == pytest.approx(16, abs=0.6) and r["confidence"] == pytest.approx(1.0)
    ink = np.frombuffer(r["pixels"], np.uint8).reshape(r["h"], r["w"]) < 128
    tops = ink.argmax(axis=0)[10:-10]
    assert ink.shape == (24, 240) and tops.max() - tops.min() <= 2 and np.ptp(base) > 15


def test_heat_statuses(spark):
    h, n = 40, 100
    flat = lambda v: np.full(n, float(v))
    apart, narrow = heat_of(flat(8), flat(20), h), heat_of(flat(8), flat(20), h)
    apart[0, :, 40:], apart[1, :, :60] = 0, 0
    narrow[1] = 0
    heats = [np.zeros((2, h, n)), narrow, heat_of(flat(20), flat(8), h), apart, heat_of(flat(8), flat(20), h), heat_of(flat(10), flat(12), h)]
    df, heat_fn = heat_images(spark, heats, 100, h)
    curved = {r["line_id"]: r for r in heatmaps.straightened(df, heat_fn).collect()}
    assert [curved[k]["status"] for k in range(6)] == [
        "curved_baseline_fit_failed", "curved_baseline_fit_failed", "curved_baseline_lines_reversed", "curved_baseline_overlap_too_small", "ok_curved", "curved_baseline_lines_reversed",
    ]
    straight = {r["line_id"]: r for r in heatmaps.straightened(df, heat_fn, heatmaps.HeatParams(curved=False)).collect()}
    assert [straight[k]["status"] for k in range(6)] == ["neural_baseline_fit_failed"] * 2 + ["neural_baseline_lines_reversed", "ok", "ok", "ok"]
    assert curved[0]["pixels"] == straight[2]["pixels"].replace(b"\x02", b"\x00", 1)


def test_straight_edges_in_pixels_of_the_image(spark):
    h, x = 40, np.arange(100)
    df, heat_fn = heat_images(spark, [heat_of(8 + 0 * x, 20 + x * 0.1, h)], 200, 2 * h)
    r = heatmaps.straight_edges(heatmaps.warm_columns(df, heat_fn, 0.35)).first()
    assert r["slope"] == pytest.approx(0.1, abs=0.01) and r["intercept"] == pytest.approx(40, abs=1) and r["top_intercept"] == pytest.approx(16, abs=0.5)
    assert r["body"] == pytest.approx(34, abs=1.5)
    out = heatmaps.straightened(df, heat_fn, heatmaps.HeatParams(curved=False, line_pad=0.0)).first()
    assert out["status"] == "ok" and out["w"] > 200 and 30 < out["h"] < 75


def plain_robust(x, y, w, h, text_w, coverage):
    """The same rule, step by step with numpy.polyfit."""
    keep = (y >= np.quantile(y, 0.05)) & (y <= np.quantile(y, 0.98))
    a, b, c = (x[keep], y[keep], w[keep]) if keep.sum() > 1 else (x, y, w)
    slope, icpt = images.ransac(a, b, text_w, max(2.0, 0.055 * h)) or np.polyfit(a, b, 1, w=c)
    for _ in range(5):
        r = np.abs(b - slope * a - icpt)
        m = np.median(r)
        ok = r <= max(2.0, h * 0.045, m + np.median(np.abs(r - m)) * 2.8)
        if ok.sum() < max(2, round(len(a) * 0.4)) or ok.all():
            break
        a, b, c = a[ok], b[ok], c[ok]
        slope, icpt = np.polyfit(a, b, 1, w=c)
    slope, icpt = np.polyfit(a, b, 1, w=c)
    mad = np.median(np.abs(b - slope * a - icpt))
    share = np.mean(np.abs(y - slope * x - icpt) <= max(2.0, h * 0.055, 2.5 * mad))
    return slope, icpt, 0.25 * min(1, coverage / 0.55) + 0.45 * np.clip((share - 0.25) / 0.65, 0, 1) + 0.3 * np.clip(1 - mad / max(2.0, 0.14 * h), 0, 1)


def test_robust_lines_equal_a_plain_twin(spark):
    rng, rows, want = np.random.default_rng(8), [], {}
    for g in range(200):
        n, h = int(rng.integers(6, 90)), float(rng.integers(10, 90))
        x = np.sort(rng.choice(300, n, replace=False)).astype(float)
        y = rng.normal(0, 0.15) * x + rng.normal(20, 5) + rng.normal(0, 1.5, n)
        bad = rng.random(n) < 0.2
        y[bad] += rng.normal(0, 25, bad.sum())
        w = rng.uniform(0.2, 3, n)
        want[g] = plain_robust(x, y, w, h, float(np.ptp(x) + 1), n / 300)
        rows += [(g, *map(float, p), h, float(np.ptp(x) + 1), n / 300) for p in zip(x, y, w, strict=True)]
    points = spark.createDataFrame(rows, "img long, x double, y double, w double, h double, text_w double, coverage double")
    got = profiles.robust_lines(points, ["img"]).collect()
    assert len(got) == 200
    for r in got:
        assert np.allclose((r["slope"], r["intercept"], r["confidence"]), want[r["img"]], atol=1e-6)
    long = {r["img"]: r for r in profiles.reweighted_lines(points, ["img"]).collect()}
    assert len(long) == 200 and all(2 <= r["n"] <= 90 for r in long.values())


def test_straightened_keeps_odd_rows(spark):
    blank = bytes([255] * 200)
    df = spark.createDataFrame([(1, 20, 10, blank), (2, 20, 10, None), (3, 0, 0, b"")], "line_id long, w int, h int, pixels binary")
    from glyphflow.plans.score_queries import ink_edges

    got = {r["line_id"]: (r["status"], r["pixels"] and bytes(r["pixels"])) for r in heatmaps.straightened(df, ink_edges).collect()}
    assert {k: v[0] for k, v in got.items()} == {1: heatmaps.STATUS["curve"], 2: heatmaps.STATUS["image"], 3: heatmaps.STATUS["image"]} and got[1][1] == blank and got[2][1] is None
    assert heatmaps.straightened(df.limit(0), ink_edges).count() == 0


def test_scratch_folders_need_a_shared_place(spark):
    assert inputs.scratch(spark, "x") != inputs.scratch(spark, "x")
