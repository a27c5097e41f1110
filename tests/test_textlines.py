"""Components, candidate lines and the line taken, against plain twins."""

import random

import numpy as np
import pandas as pd
import pytest

from glyphflow.operators import images, textlines

P = vars(images.Params())


def flooded(mask):
    """{first pixel: pixels} of 8-connected components."""
    left, out = {(y, x) for y, x in zip(*np.nonzero(mask))}, {}
    for start in sorted(left):
        if start not in left:
            continue
        todo, own = [start], []
        left.discard(start)
        while todo:
            y, x = todo.pop()
            own.append((y, x))
            near = [(y + a, x + b) for a in (-1, 0, 1) for b in (-1, 0, 1) if (y + a, x + b) in left]
            left.difference_update(near)
            todo += near
        out[start[0] * mask.shape[1] + start[1]] = own
    return out


def test_component_rows_equal_flooding(spark):
    rng = np.random.default_rng(2)
    masks = [(rng.random((h, w)) < d).astype(np.uint8) for h, w, d in ((8, 8, 0.2), (12, 30, 0.35), (5, 40, 0.5), (1, 6, 0.5), (9, 9, 0.0))]
    masks.append(np.pad(np.ones((2, 30), np.uint8), ((3, 30), (2, 8))))  # long and flat
    rows = [(k, *m.shape, m.tobytes()) for k, m in enumerate(masks)] + [(90, 4, 4, None), (91, 0, 0, b"")]
    got = textlines.component_rows(spark.createDataFrame(rows, "line_id long, h int, w int, pixels binary")).collect()
    found = {(r.line_id, r.first): r for r in got}
    want = {(k, first): own for k, m in enumerate(masks) for first, own in flooded(m).items()}
    assert found.keys() == want.keys()
    for (k, first), own in want.items():
        r, ys, xs = found[k, first], [y for y, _ in own], [x for _, x in own]
        height, width = max(ys) - min(ys) + 1, max(xs) - min(xs) + 1
        assert (r.area, r.bottom, r.top, r.left, r.w, r.h) == (len(own), max(ys), min(ys), min(xs), width, height)
        assert r.x == pytest.approx(sum(xs) / len(xs)) and r.weight == pytest.approx(min(8, len(own) ** 0.5))
        h, w = masks[k].shape
        assert r.used == (len(own) >= 2 and height >= 2 and not (width > 0.45 * w and height <= max(2, 0.08 * h)))


def test_bottom_points_go_from_left_to_right():
    mask = np.zeros((40, 100), bool)
    for k, bottom in enumerate((20, 21, 30, 23, 24)):
        mask[bottom - 9 : bottom + 1, 5 + 18 * k : 15 + 18 * k] = True
    x, y, w, coverage = images.bottom_points(mask, 82.0)
    assert x.tolist() == [9.5, 27.5, 45.5, 63.5, 81.5] and y.tolist() == [20.5, 21, 23, 24, 23.5]  # medians of three
    assert w.tolist() == [8.0] * 5 and coverage == pytest.approx(50 / 82)
    assert images.bottom_points(np.zeros((4, 4), bool), 1.0)[3] == 0


def candidate(**own):
    base = {
        "mask": 0, "ink": 50, "enough": True, "method": 0, "slope": 0.0, "intercept": 30.0, "bottom_confidence": 0.9, "top_slope": 0.0, "top_intercept": 10.0,
        "top_confidence": 0.8, "gap": 20.0, "left": 2, "right": 90, "q02": 9.0, "q88": 29.0, "q98": 31.0,
    }
    return base | own


BARE = {"method": None, "slope": None, "intercept": None, "bottom_confidence": None}
TOPLESS = {"top_slope": None, "top_intercept": None, "top_confidence": None, "gap": None}
STATUSES = [
    ([candidate()], "ok", "ok"),
    ([candidate(slope=0.5)], "strict_lines_angle_rejected", "baseline_angle_rejected_bbox_fallback"),
    ([candidate(bottom_confidence=0.2)], "strict_lines_low_confidence", "baseline_low_confidence_bbox_fallback"),
    ([candidate(top_confidence=0.2)], "strict_lines_low_confidence", "ok"),
    ([candidate(gap=1.5)], "baseline_fit_failed", "ok"),
    ([candidate(**TOPLESS)], "baseline_fit_failed", "ok"),
    ([candidate(**BARE)], "baseline_fit_failed", "baseline_fit_failed_bbox_fallback"),
    ([candidate(**BARE, ink=2, enough=False)], "not_enough_foreground", "not_enough_foreground"),
]


@pytest.mark.parametrize(("rows", "strict", "lenient"), STATUSES)
def test_statuses(rows, strict, lenient):
    assert [images.choose_line(rows, s, 12.0, 4)["status"] for s in (True, False)] == [strict, lenient]


def test_the_box_is_that_of_the_largest_mask():
    got = images.choose_line([candidate(**BARE), candidate(**BARE, mask=1, ink=70, q88=27.0), candidate(mask=2, slope=0.4, ink=60)], False, 12.0, 4)
    assert (got["ok"], got["intercept"], got["top_intercept"], got["confidence"], got["candidates"]) == (True, 27.0, 9.0, 0.18, 1)


def test_chosen_rows_equal_the_kernel(spark):
    rng, lines = random.Random(6), []
    for k in range(300):
        rows = []
        for mask in range(rng.randint(1, 3)):
            ink = rng.randint(0, 60)
            own = {"mask": mask, "ink": ink, "enough": ink >= 8, "q88": float(rng.randint(20, 30))} | (TOPLESS if rng.random() < 0.3 else {"gap": rng.choice([1.0, 2.0, 2.5, 20.0]), "top_confidence": rng.choice([0.2, 0.3, 0.8])})
            methods = [] if ink < 8 or rng.random() < 0.2 else rng.sample(range(5), rng.randint(1, 5))
            rows += [candidate(**own | {"method": m, "slope": rng.choice([0.0, 0.1, -0.5]), "intercept": rng.random() * 9, "bottom_confidence": rng.choice([0.1, 0.25, 0.5])}) for m in sorted(methods)] or [candidate(**own | BARE)]
        lines.append(rows)
    flat = [(k, *(c[n] for n in images.CANDIDATE_COLUMNS), 8) for k, rows in enumerate(lines) for c in rows]
    rng.shuffle(flat)
    df = spark.createDataFrame(flat, f"line_id long, {images.CANDIDATE}, least int").repartition(3)
    for strict in (True, False):
        got = {r.line_id: r for r in textlines.chosen_lines(df, strict).collect()}
        assert len(got) == 300
        for k, rows in enumerate(lines):
            want, r = images.choose_line(rows, strict, 12.0, 8), got[k]
            assert (r.ok, r.status, r.candidates) == (want["ok"], want["status"], want["candidates"]), k
            if "confidence" in want:
                assert [r[n] for n in ("method", "confidence", "slope", "intercept", "top_slope", "top_intercept")] == [want[n] for n in ("method", "confidence", "slope", "intercept", "top_slope", "top_intercept")]


def test_crop_rows():
    strict, lenient = P, P | {"strict_lines": False}
    assert images.crop_rows(candidate(), strict) == (8, 33)  # 10 - 23 * 0.08 and 31 + the same
    assert images.crop_rows(candidate(), lenient) == (6, 37)  # 9 - 23 * 0.12 and 32 + 23 * 0.18
    assert images.crop_rows(candidate(**TOPLESS), lenient) == (6, 36)  # 9 - 21 * 0.12 and 32 + 21 * 0.18
    assert images.crop_rows(candidate(**TOPLESS, intercept=10.0), lenient)[0] == -12  # a line near the top of the ink: 0.85 of its height above it
    top, bottom = images.crop_rows(candidate(slope=0.1, intercept=25.0, gap=19.6), strict)
    assert bottom >= 0.1 * 90 + 25 + 1 and top <= 10


def written(tilt=0.0, height=48):
    image = np.full((height, 200), 255, np.uint8)
    for x in range(20, 180, 8):
        y = 18 + round(x * tilt)
        image[y : y + 10, x : x + 5] = 0
    return image


def test_images_are_cropped_over_their_whole_width():
    level, status = images.baseline_cropped(written(), P)
    # All lines are as sure, so the first holds: 80 % of the ink's rows down, 25.2, with 8 % of the ink's ten rows beyond.
    assert status == "ok" and level.shape == (10, 200) and np.array_equal(level, written()[17:27])
    turned, status = images.baseline_cropped(written(0.05), P)
    assert status == "ok_deskewed" and turned.shape[0] < 48
    assert images.baseline_cropped(written(0.05), P | {"deskew": False})[1] == "ok"
    assert images.baseline_cropped(written(0.4, 120), P)[1] == "strict_lines_angle_rejected"
    lenient = P | {"strict_lines": False}
    found, (boxed, status) = images.detected(written(0.4, 120), lenient), images.baseline_cropped(written(0.4, 120), lenient)
    assert found["status"] == "baseline_angle_rejected_bbox_fallback" and (found["method"], found["slope"]) == (None, 0.0)
    assert status == "ok" and boxed.shape == (images.crop_rows(found, lenient)[1] - images.crop_rows(found, lenient)[0], 200)
    assert images.baseline_cropped(np.full((30, 50), 200, np.uint8), P)[1] == "not_enough_foreground"


def test_candidate_rows(spark):
    found = [written(), np.full((30, 50), 200, np.uint8)]
    rows = spark.createDataFrame([(k, *m.shape, m.tobytes()) for k, m in enumerate(found)], "line_id long, h int, w int, pixels binary")
    got = textlines.candidate_rows(rows)
    assert {r.line_id: r.status for r in textlines.chosen_lines(got).collect()} == {0: "ok", 1: "not_enough_foreground"}
    assert got.where("line_id = 0 and mask = 0").count() == len([c for c in images.line_candidates(found[0]) if c["mask"] == 0]) == 5
    assert isinstance(got.limit(1).toPandas(), pd.DataFrame)
