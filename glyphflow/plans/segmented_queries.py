"""Evaluation of lines that are read through their cuts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphflow.operators import decode, evaluate

from . import inputs as I
from .score_queries import _PEAKS, _TEXT

#: What the class scores leave out of a line, left and right.
CROP = (2, 1)
OPTIONS = {"segmentation": {"distance": 1}, "mode": "off", "bounds": ("left", "right"), "crop": CROP}


def _lines(spark: SparkSession, sf: str) -> DataFrame:
    """(task_id, p, cut_scores, input_width, left, right, error): both scores of every embedding in one row; some lines fail."""
    rows = I.logits(spark, sf).withColumnRenamed("line_id", "task_id").withColumn("input_width", F.lit(64))
    lost, bare = F.col("task_id") % 97 == 13, F.col("task_id") % 89 == 5
    return rows.withColumns({
        "cut_scores": F.transform(F.flatten("p"), lambda x: F.round(1 / (1 + F.exp(-4 * x)), 4)), "p": F.when(~bare, F.col("p")),
        "left": (F.col("task_id") % 17).cast("int"), "right": (64 - F.col("task_id") % 23).cast("int"),
        "error": F.when(lost, F.concat(F.lit("image_not_found: line_"), F.col("task_id").cast("string"))).otherwise(""),
    })


def _tasks(spark: SparkSession, sf: str) -> DataFrame:
    """(task_id, lang, gt): the text of a line is what the best class of each step says."""
    emb = I.table(spark, sf, "embeddings").select(F.col("vec_id").alias("task_id"), F.col("label").alias("lang"))
    read = decode.recognize(I.logits(spark, sf), F.array(*map(F.lit, I.CLASSES)))
    return emb.join(read.select(F.col("line_id").alias("task_id"), F.col("text").alias("gt")), "task_id")


def segmented_rows(spark: SparkSession, sf: str) -> DataFrame:
    """K2, K3: what each line says through its cuts, within the bounds of its text."""
    return decode.predict_with_cuts(_lines(spark, sf), F.array(*map(F.lit, I.CLASSES)), **OPTIONS)


def segmented_metrics(spark: SparkSession, sf: str) -> DataFrame:
    """K5: metrics of the same per label; failed lines count."""
    _, out = evaluate.evaluate_with_segmentator(_tasks(spark, sf), _lines(spark, sf), F.array(*map(F.lit, I.CLASSES)), ["lang"], **OPTIONS)
    means = ("line_accuracy", "average_char_accuracy", "global_char_accuracy", "average_levenshtein")
    return out.select("lang", "total", "recognized", "exact", *(F.round(c, 6).alias(c) for c in means), "total_levenshtein")


QUERIES = (segmented_rows, segmented_metrics)


def _placed(x: str) -> str:
    """A column of the line as a boundary of eight score columns that leave CROP out."""
    return f"greatest(0, least(8, round_even((({x}) - {CROP[0]}) * 8::DOUBLE / {64 - sum(CROP)}, 0)))::INT"


_READ = f"""{_PEAKS}, {_TEXT}, ln AS (SELECT line_id, {_placed('line_id % 17')} AS lo, {_placed('64 - line_id % 23')} AS hi,
        CASE WHEN line_id % 97 = 13 THEN 'image_not_found: line_' || line_id WHEN line_id % 89 = 5 THEN 'no_scores' ELSE '' END AS error FROM ids),
    bo AS (SELECT line_id, CASE WHEN hi > lo THEN lo ELSE 0 END AS lo, CASE WHEN hi > lo THEN hi ELSE 8 END AS hi, error FROM ln),
    mc AS (SELECT DISTINCT line_id, {_placed('round_even(i + 0.5::DOUBLE, 0)')} AS m FROM pk),
    ed AS (SELECT line_id, m FROM mc JOIN bo USING (line_id) WHERE m - lo >= 2 AND hi - m >= 2 UNION SELECT line_id, lo FROM bo UNION SELECT line_id, hi FROM bo),
    iv AS (SELECT line_id, m AS a, lead(m) OVER (PARTITION BY line_id ORDER BY m) AS e FROM ed),
    pa AS (SELECT *, greatest(1, least(e - a, greatest(1, round_even((e - a) * 0.6::DOUBLE, 0)::INT))) AS n FROM iv WHERE e IS NOT NULL),
    sp AS (SELECT line_id, a, e, CASE WHEN e - a <= 1 THEN a ELSE greatest(a, least(e - n, round_even((a + e) * 0.5::DOUBLE - n * 0.5::DOUBLE, 0)::INT)) END AS s, CASE WHEN e - a <= 1 THEN 1 ELSE n END AS n FROM pa),
    mn AS (SELECT line_id, a, c, avg(v) AS v FROM sp JOIN lg USING (line_id) WHERE t >= s AND t < s + n GROUP BY ALL),
    tp AS (SELECT line_id, a, c FROM (SELECT *, row_number() OVER (PARTITION BY line_id, a ORDER BY v DESC, c) AS k FROM mn) WHERE k = 1 AND c < 7),
    rd AS (SELECT line_id, string_agg(substr('{I.CLASSES}', (c + 1)::INT, 1), '' ORDER BY a) AS text FROM tp GROUP BY line_id),
    pr AS (SELECT line_id AS task_id, CASE WHEN error = '' THEN coalesce(text, '') ELSE '' END AS pred, error FROM bo LEFT JOIN rd USING (line_id))"""

ORACLES = {
    "segmented_rows": f"WITH {_READ} SELECT task_id, pred, error FROM pr",
    "segmented_metrics": f"""WITH {_READ}, gt AS (SELECT line_id AS task_id, string_agg(substr('{I.CLASSES}', (c + 1)::INT, 1), '' ORDER BY t) AS gt FROM kn GROUP BY ALL),
        ms AS (SELECT label AS lang, error, coalesce(gt, '') AS gt, pred, levenshtein(coalesce(gt, ''), pred) AS d FROM embeddings JOIN pr ON vec_id = task_id LEFT JOIN gt USING (task_id)),
        ac AS (SELECT *, CASE WHEN gt = '' THEN (pred = '')::INT::DOUBLE ELSE greatest(0.0, 1 - d::DOUBLE / length(gt)) END AS accuracy FROM ms)
        SELECT lang, count(*) AS total, count(*) FILTER (error = '') AS recognized, count(*) FILTER (gt = pred) AS exact, round(avg((gt = pred)::INT), 6) AS line_accuracy,
        round(avg(accuracy), 6) AS average_char_accuracy, round(CASE WHEN sum(length(gt)) > 0 THEN greatest(0.0, 1 - sum(d)::DOUBLE / sum(length(gt))) ELSE 0 END, 6) AS global_char_accuracy,
        round(avg(d), 6) AS average_levenshtein, sum(d)::BIGINT AS total_levenshtein FROM ac GROUP BY lang""",
}
