"""Sweeps with shared geometries, and studies that are resumed."""

import tempfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from glyphflow.operators import evaluate, images, studies, sweep

PARAMS = images.Params(height=8)


def strips(spark, n=6):
    rng = np.random.default_rng(5)
    rows = [(k, 8, 20 + k, rng.integers(0, 256, (8, 20 + k), np.uint8).tobytes()) for k in range(n)]
    return spark.createDataFrame(rows, "line_id long, h int, w int, pixels binary")


def test_each_geometry_is_scored_once(spark):
    calls = spark.sparkContext.accumulator(0)

    def counted(stack):
        calls.add(len(stack))
        return [image.mean(axis=0)[:, None] / 255 for image in stack]

    trials = sweep.trial_grid(spark, scale_x=[1.0, 0.7, None], cut_threshold=[0.4, 0.5, None], peak_distance=[1, 3])
    lines = strips(spark)
    rows = studies.segmentation_rows(lines.select("line_id", F.lit(5).alias("gt_len")), lines, trials, counted, PARAMS, threshold=0.6).collect()
    assert len(rows) == 18 * 6
    assert calls.value == 2 * 6  # a null scale is the default one
    found = {(r.trial, r.line_id): r.pred_len for r in rows}
    for line in lines.collect():
        image = np.frombuffer(line.pixels, np.uint8).reshape(line.h, line.w)
        for trial in trials.collect():
            scale = trial.scale_x or 1.0
            s = images.prepare(image, vars(PARAMS) | {"scale_x": scale})[0].mean(axis=0) / 255
            t = trial.cut_threshold or 0.6
            tops = [i for i in range(len(s)) if s[i] >= t and s[i] >= max(s[max(0, i - 1)], s[min(len(s) - 1, i + 1)])]
            kept = []
            for i in sorted(tops, key=lambda i: (-s[i], -i)):
                if all(abs(i - j) >= trial.peak_distance for j in kept):
                    kept.append(i)
            assert found[trial.trial, line.line_id] == len(kept) + 1


def test_lines_without_pixels_and_failing_functions_keep_their_rows(spark):
    def fails(stack):
        if stack.shape[2] > 22:
            raise ValueError("too wide")
        return [image.mean(axis=0)[:, None] / 255 for image in stack]

    lengths = spark.createDataFrame([(k, 4) for k in range(7)], "line_id long, gt_len int")
    rows = studies.segmentation_rows(lengths, strips(spark), sweep.trial_grid(spark, y_pad=[0.0]), fails, PARAMS).collect()
    errors = {r.line_id: (r.error, r.length_error if r.error else None) for r in rows}
    assert errors[6] == ("no_scores", -4) and errors[5] == ("ValueError: too wide", -4) and errors[0] == ("", None)
    assert studies.segmentation_rows(lengths, strips(spark).where("false"), sweep.trial_grid(spark, y_pad=[0.0]), fails, PARAMS).where("error = 'no_scores'").count() == 7


def test_random_trials(spark):
    ranges = {"baseline_crop": [False, True], "max_angle": (2.0, 9.0), "peak_distance": (1, 4)}
    some = studies.random_trials(spark, 30, 3, {"max_angle": "baseline_crop"}, **ranges)
    rows = some.collect()
    assert rows[:10] == studies.random_trials(spark, 10, 3, {"max_angle": "baseline_crop"}, **ranges).collect()
    assert all((r.max_angle is None) != r.baseline_crop for r in rows) and {r.peak_distance for r in rows} == {1, 2, 3, 4}
    _, full = studies.with_geometry(some.select("trial", "baseline_crop"))
    assert full.select("geometry").distinct().count() == 2
    with pytest.raises(KeyError):
        studies.random_trials(spark, 1, 3, {"max_angle": "absent"}, max_angle=(1.0, 2.0))


def test_a_study_resumes_where_it_was_left(spark):
    root, ran = tempfile.mkdtemp() + "/ledger", []

    def measure(waiting):
        ran.append(sorted(r.trial for r in waiting.collect()))
        return waiting.select("trial", (F.col("scale_x") * 10).alias("score"))

    trials = sweep.trial_grid(spark, scale_x=[0.5, 0.9, 0.7, 0.9])
    assert studies.recorded(spark, root, "a") is None
    with pytest.raises(ValueError):
        studies.resume(spark, root, "a", trials.where("false"), measure)
    assert studies.resume(spark, root, "a", trials.where("trial < 2"), measure).count() == 2
    whole = studies.resume(spark, root, "a", trials, measure)
    assert ran == [[0, 1], [2, 3]] and whole.count() == 4
    other = studies.resume(spark, root, "b", trials, measure)  # a study of its own in the same ledger
    again = studies.resume(spark, root, "a", trials, measure)
    assert ran[2:] == [[0, 1, 2, 3]]
    rows = lambda df: sorted((r.trial, r.scale_x, r.score) for r in df.collect())
    assert rows(whole) == rows(other) == rows(again)
    assert [r.trial for r in studies.best_params(again, "score", trials).collect()] == [1]
    changed = trials.withColumn("scale_x", F.when(F.col("trial") == 2, 2.0).otherwise(F.col("scale_x")))
    assert rows(studies.resume(spark, root, "a", changed, measure))[2] == (2, 2.0, 20.0)
    assert ran[3:] == [[2]] and studies.recorded(spark, root, "a").count() == 4


def test_final_run_with_the_best_trial(spark):
    lines = strips(spark)
    shades = lambda stack: [np.eye(4)[(image.mean(axis=0) // 64).astype(int)] for image in stack]
    alphabet = F.array(*map(F.lit, "abcd"))
    base = sweep.trial_grid(spark, y_pad=[0.0])
    tasks = studies.recognition_rows(lines.select("line_id", F.lit("").alias("gt")), lines, base, shades, alphabet, PARAMS).select("line_id", F.col("pred").alias("gt"))
    trials = sweep.trial_grid(spark, y_pad=[0.5, 0.0, 0.2])
    metrics = evaluate.ocr_metrics(studies.recognition_rows(tasks, lines, trials, shades, alphabet, PARAMS), ["trial"])
    final = studies.recognition_rows(tasks, lines, studies.best_params(metrics, "average_levenshtein", trials), shades, alphabet, PARAMS).collect()
    assert {r.trial for r in final} == {1} and all(r.exact_match == 1 for r in final) and len(final) == 6
