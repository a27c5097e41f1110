"""Sweeps over preprocessing, and a study that is run by halves."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphflow.functions import scores as S
from glyphflow.operators import evaluate, images, studies, sweep

from . import inputs as I
from .score_queries import _TEXT
from .segmented_queries import _tasks

HEIGHT, SCALES, PADS, THRESHOLDS = 8, (1.0, 0.8), (0.0, -0.25), (0.5, 0.55, 0.6)
#: The width of a strip under each geometry: as it is, with y_pad, and either one scaled.
WIDE = {(1.0, 0.0): 64, (0.8, 0.0): 51, (1.0, -0.25): 85, (0.8, -0.25): 68}
PARAMS = images.Params(height=HEIGHT)


def _strips(spark: SparkSession, sf: str) -> DataFrame:
    """(line_id, h, w, pixels): every embedding as a strip of equal rows, its cut scores as grey values."""
    row = F.array_join(F.transform("cut_scores", lambda v: F.lpad(F.hex(F.round(v * 255).cast("int")), 2, "0")), "")
    out = I.cut_scores(spark, sf).where(F.size("cut_scores") > 0)
    return out.select("line_id", F.lit(HEIGHT).alias("h"), F.size("cut_scores").alias("w"), F.unhex(F.repeat(row, HEIGHT)).alias("pixels"))


def brightness(stack: np.ndarray) -> list[np.ndarray]:
    """A cut score per column: its mean grey value."""
    return [image.mean(axis=0)[:, None] / 255 for image in stack]


def shades(stack: np.ndarray) -> list[np.ndarray]:
    """Eight classes per column: which eighth of the grey values its mean is in."""
    return [np.eye(8)[(image.mean(axis=0) // 32).astype(int)] for image in stack]


def segmentation_sweep(spark: SparkSession, sf: str) -> DataFrame:
    """Q2: length errors of cut strips under twelve trials, four geometries by three thresholds."""
    trials = sweep.trial_grid(spark, scale_x=list(SCALES), y_pad=list(PADS), cut_threshold=list(THRESHOLDS))
    lengths = _tasks(spark, sf).select(F.col("task_id").alias("line_id"), F.char_length("gt").alias("gt_len"))
    rows = studies.segmentation_rows(lengths, _strips(spark, sf), trials, brightness, PARAMS, distance=1)
    ranked = sweep.leaderboard(evaluate.segmentation_metrics(rows, ["trial"]), "average_abs_length_error")
    return ranked.select("trial", "evaluated", "exact_length", "total_abs_length_error", F.round("average_abs_length_error", 6).alias("average_abs_length_error"), "place")


def _shade_tasks(spark: SparkSession, sf: str) -> DataFrame:
    """(line_id, gt): what the grey values say as they are, without pixels."""
    ids = F.transform("cut_scores", lambda v: F.floor(F.round(v * 255) / 32).cast("int"))
    return I.cut_scores(spark, sf).where(F.size("cut_scores") > 0).select("line_id", S.ids_to_text(ids, F.array(*map(F.lit, I.CLASSES))).alias("gt"))


def recognition_study(spark: SparkSession, sf: str) -> DataFrame:
    """Q1, Q3: a stored study of four geometries: two trials run, then the rest when it is resumed, then ranked."""
    trials = sweep.trial_grid(spark, scale_x=list(SCALES), y_pad=list(PADS))
    root = I.scratch(spark, "study")

    def measure(waiting: DataFrame) -> DataFrame:
        rows = studies.recognition_rows(_shade_tasks(spark, sf), _strips(spark, sf), waiting, shades, F.array(*map(F.lit, I.CLASSES)), PARAMS)
        return evaluate.ocr_metrics(rows, ["trial"])

    studies.resume(spark, root, "shades", trials.where("trial < 2"), measure)
    ledger = studies.resume(spark, root, "shades", trials, measure)
    ranked = sweep.leaderboard(ledger, "average_levenshtein")
    return ranked.select("trial", "scale_x", "y_pad", "total", "exact", "total_levenshtein", F.round("average_levenshtein", 6).alias("average_levenshtein"), "place")


QUERIES = (segmentation_sweep, recognition_study)


def _resized(name: str, source: str, n: int, m: int) -> str:
    """``source`` (line_id, i, v) of n columns with m columns instead: the cubic kernel at a = -0.5, wider when shrinking, in whole numbers as ``images.resize``."""
    scale = max(1.0, n / m)
    return f"""{name}_c AS (SELECT j, (j + 0.5::DOUBLE) * {n} / {m} - 0.5::DOUBLE AS c FROM range({m}) r(j)),
    {name}_t AS (SELECT j, a, abs(a - c) / {scale!r}::DOUBLE AS t FROM (SELECT j, c, unnest(range((floor(c) - 3)::BIGINT, (floor(c) + 5)::BIGINT)) AS a FROM {name}_c)),
    {name}_f AS (SELECT j, a, t, CASE WHEN t < 1 THEN 1.5::DOUBLE * t * t * t - 2.5::DOUBLE * t * t + 1 ELSE -0.5::DOUBLE * t * t * t + 2.5::DOUBLE * t * t - 4 * t + 2 END AS f FROM {name}_t WHERE t < 2),
    {name}_w AS (SELECT j, a, t, round_even(f / sum(f) OVER (PARTITION BY j) * {images.PART}, 0)::BIGINT AS k FROM {name}_f),
    {name}_k AS (SELECT j, greatest(0, least({n - 1}, a)) AS i, k + CASE WHEN row_number() OVER (PARTITION BY j ORDER BY t, a) = 1 THEN {images.PART} - sum(k) OVER (PARTITION BY j) ELSE 0 END AS k FROM {name}_w),
    {name} AS (SELECT line_id, j AS i, greatest(0, least(255, (sum(v * k)::BIGINT + {images.PART // 2}) // {images.PART})) AS v FROM {name}_k JOIN {source} USING (i) GROUP BY line_id, j)"""


_STRIPS = f"""px AS (SELECT line_id, i, round(s * 255)::BIGINT AS v FROM sc), {_resized('p1', 'px', 64, 51)}, {_resized('p2', 'px', 64, 85)}, {_resized('p3', 'p2', 85, 68)},
    geo AS (SELECT 1.0::DOUBLE AS scale_x, 0.0::DOUBLE AS y_pad, line_id, i, v FROM px UNION ALL SELECT 0.8, 0.0, * FROM p1 UNION ALL SELECT 1.0, -0.25, * FROM p2 UNION ALL SELECT 0.8, -0.25, * FROM p3)"""


def _grid(*columns: tuple[str, tuple[float, ...]]) -> str:
    """The rows of ``sweep.trial_grid``: the last parameter varies fastest."""
    rows = [()]
    for _, values in columns:
        rows = [(*r, v) for r in rows for v in values]
    listed = ", ".join(f"({k}::BIGINT, {', '.join(f'{v!r}::DOUBLE' for v in r)})" for k, r in enumerate(rows))
    return f"tr AS (SELECT * FROM (VALUES {listed}) g(trial, {', '.join(c for c, _ in columns)}))"


ORACLES = {
    "segmentation_sweep": f"""WITH {I.CUT_SCORES}, {_STRIPS}, {_grid(("scale_x", SCALES), ("y_pad", PADS), ("th", THRESHOLDS))}, {_TEXT},
        gl AS (SELECT vec_id AS line_id, count(c) AS gt_len FROM embeddings LEFT JOIN kn ON line_id = vec_id GROUP BY vec_id),
        nb AS (SELECT *, v / 255 AS s, lag(v) OVER w AS l, lead(v) OVER w AS r FROM geo WINDOW w AS (PARTITION BY scale_x, y_pad, line_id ORDER BY i)),
        pd AS (SELECT trial, line_id, count(*) FILTER (s >= th AND v >= coalesce(l, -1) AND v >= coalesce(r, -1)) + 1 AS pred_len FROM nb JOIN tr USING (scale_x, y_pad) GROUP BY ALL),
        m AS (SELECT trial, count(*) AS evaluated, count(*) FILTER (pred_len = gt_len) AS exact_length, sum(abs(pred_len - gt_len))::BIGINT AS total_abs_length_error, avg(abs(pred_len - gt_len)) AS a FROM pd JOIN gl USING (line_id) GROUP BY trial)
        SELECT trial, evaluated, exact_length, total_abs_length_error, round(a, 6) AS average_abs_length_error, row_number() OVER (ORDER BY a, trial) AS place FROM m""",
    "recognition_study": f"""WITH {I.CUT_SCORES}, {_STRIPS}, {_grid(("scale_x", SCALES), ("y_pad", PADS))},
        cl AS (SELECT scale_x, y_pad, line_id, i, floor(v / 32)::INT AS c FROM geo), ch AS (SELECT *, lag(c) OVER (PARTITION BY scale_x, y_pad, line_id ORDER BY i) AS b FROM cl),
        tx AS (SELECT scale_x, y_pad, line_id, coalesce(string_agg(substr('{I.CLASSES}', c + 1, 1), '' ORDER BY i) FILTER (c < 7 AND (b IS NULL OR b <> c)), '') AS text FROM ch GROUP BY ALL),
        ms AS (SELECT trial, t.scale_x, t.y_pad, levenshtein(g.text, t.text) AS d FROM tx t JOIN tr USING (scale_x, y_pad) JOIN tx g ON g.line_id = t.line_id AND g.scale_x = 1 AND g.y_pad = 0),
        m AS (SELECT trial, scale_x, y_pad, count(*) AS total, count(*) FILTER (d = 0) AS exact, sum(d)::BIGINT AS total_levenshtein, avg(d) AS a FROM ms GROUP BY ALL)
        SELECT trial, scale_x, y_pad, total, exact, total_levenshtein, round(a, 6) AS average_levenshtein, row_number() OVER (ORDER BY a, trial) AS place FROM m""",
}
