"""Reading through cuts within bounds, against a plain twin."""

import random

from pyspark.sql import functions as F

from glyphflow.operators import decode, evaluate

CLASSES, CROP = "abc", (3, 2)


def plain(p, cuts, width, columns, left, right):
    """Mode off: (text, [(start, end, source_start, source_end)])."""
    t = len(p)
    lo = min(max(0, CROP[0]), max(0, width - 1))
    hi = max(lo + 1, width - CROP[1])
    put = lambda x: max(0, min(t, round((x - lo) * t / (hi - lo))))
    a, e = (put(left), put(right)) if left is not None else (0, t)
    if e <= a:
        a, e = 0, t
    inner = sorted({put(round((c + 0.5) * width / columns)) for c in cuts if 0 <= c < columns})
    edges = [a, *(c for c in inner if c - a >= 2 and e - c >= 2), e]
    text, places = "", []
    for s, f in zip(edges, edges[1:]):
        n = max(1, min(f - s, round((f - s) * 0.6)))
        first = s if f - s <= 1 else max(s, min(f - n, round((s + f) * 0.5 - n * 0.5)))
        means = [sum(row[c] for row in p[first : first + n]) / n for c in range(4)]
        best = means.index(max(means))
        if best < 3:
            text += CLASSES[best]
            places.append((s, f, *(max(0, min(columns, round(x * columns / t))) for x in (s, f))))
    return text, places


def test_bounds_crop_and_source_places(spark):
    rng = random.Random(4)
    rows = []
    for k in range(60):
        t, width, columns = rng.randint(1, 12), rng.randint(20, 60), rng.randint(5, 40)
        bounds = (None, None) if k % 5 == 0 else (rng.randint(0, 25), rng.randint(10, 60))
        rows.append((k, [[rng.random() for _ in range(4)] for _ in range(t)], sorted(rng.sample(range(columns), 4)), width, columns, *bounds))
    df = spark.createDataFrame(rows, "line_id long, p array<array<double>>, cut_positions array<int>, input_width int, cut_width int, l int, r int")
    got = decode.decode_with_cuts(df, F.array(*map(F.lit, CLASSES)), mode="off", bounds=("l", "r"), crop=CROP, k=2).collect()
    assert len(got) == 60
    for row in got:
        text, places = plain(*rows[row.line_id][1:])
        assert row.text == text, row.line_id
        assert [(s.start, s.end, s.source_start, s.source_end) for s in row.symbols or []] == places
        assert all(len(s.candidates) == 2 for s in row.symbols or [])


def test_failed_lines_keep_their_rows(spark):
    one = [[1.0, 0.0, 0.0, 0.0], [1.0, 0.0, 0.0, 0.0]]
    lines = spark.createDataFrame(
        [(1, one, [0.1, 0.2], 8, ""), (2, None, [0.1], 8, None), (3, one, [], 8, ""), (4, one, [0.1, 0.1], 8, "image_not_found: x")],
        "task_id long, p array<array<double>>, cut_scores array<double>, input_width int, error string",
    )
    tasks = spark.createDataFrame([(k, f"{k}.png", "a") for k in range(1, 6)], "task_id long, image string, gt string")
    rows, metrics = evaluate.evaluate_with_segmentator(tasks, lines, F.array(*map(F.lit, CLASSES)))
    found = {r.task_id: (r.pred, r.error) for r in rows.collect()}
    assert found == {1: ("a", ""), 2: ("", "no_scores"), 3: ("", "no_scores"), 4: ("", "image_not_found: x"), 5: ("", "")}
    m = metrics.first()
    assert (m.total, m.recognized, m.exact) == (5, 2, 1)
