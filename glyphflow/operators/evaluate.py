"""Evaluation: joining predictions to tasks and measuring them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphflow.functions.text import char_accuracy
from glyphflow.operators import decode

EVAL_COLUMNS = ("task_id", "image", "gt", "pred", "exact_match", "char_accuracy", "levenshtein", "gt_len", "pred_len", "error")
SEG_COLUMNS = ("task_id", "image", "gt", "gt_len", "pred_len", "cut_count", "length_error", "abs_length_error", "cuts", "error")
#: Tasks that one task of Spark sorts when images are looked for.
ROWS = 1 << 20


def mark_missing_images(tasks: DataFrame, images: DataFrame, rows: int | None = None) -> DataFrame:
    """Tasks (with image) left-joined to the listed image names; ``error`` names what is missing.

    Both sides are dealt to as many partitions as ``rows`` (about how many tasks there are; counted if
    not given) asks for, so that the memory of one does not grow with the input.
    """
    many = tasks.count() if rows is None else rows
    dealt = max(int(tasks.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-many // ROWS))
    have = images.select("image").repartition(dealt, "image").distinct().withColumn("_found", F.lit(True)).hint("merge")
    error = F.when(F.col("_found").isNull(), F.concat(F.lit("image_not_found: "), F.col("image"))).otherwise(F.lit(""))
    return tasks.repartition(dealt, "image").join(have, "image", "left").withColumn("error", error).drop("_found")


def with_images(tasks: DataFrame, images: DataFrame) -> DataFrame:
    """Tasks (with image) and the pixels of their images (image, path, h, w, c, pixels, error).

    Every task stays: without a file the error names it, with a broken file it is that
    file's. Of several files of one name the one of least path counts.
    """
    one = images.groupBy("image").agg(F.min_by(F.struct("h", "w", "c", "pixels", "error"), "path").alias("_i"))
    error = F.coalesce("_i.error", F.concat(F.lit("image_not_found: "), F.coalesce("image", F.lit(""))))
    return tasks.join(one, "image", "left").select(*tasks.columns, *(F.col(f"_i.{c}").alias(c) for c in ("h", "w", "c", "pixels")), error.alias("error"))


def with_predictions(tasks: DataFrame, preds: DataFrame, on: str | list[str] = "task_id") -> DataFrame:
    """Every task stays; without a prediction pred is the empty text."""
    return tasks.join(preds, on, "left").withColumn("pred", F.coalesce("pred", F.lit(""))).withColumn("error", F.coalesce("error", F.lit("")))


def measured(rows: DataFrame) -> DataFrame:
    """Levenshtein, char_accuracy (unrounded), exact_match and lengths of gt and pred."""
    gt, pred = F.col("gt"), F.col("pred")
    # The distance is taken once, and not of equal texts.
    out = rows.withColumn("levenshtein", F.when(gt == pred, 0).otherwise(F.levenshtein(gt, pred)))
    return out.select(
        *(c for c in out.columns if c not in ("exact_match", "char_accuracy", "levenshtein", "gt_len", "pred_len")), (gt == pred).cast("int").alias("exact_match"),
        char_accuracy(gt, pred, F.col("levenshtein")).alias("char_accuracy"), "levenshtein", F.char_length(gt).alias("gt_len"), F.char_length(pred).alias("pred_len"),
    )


def report_rows(rows: DataFrame) -> DataFrame:
    """As ``measured``, with the accuracy rounded to six digits, halves to even."""
    return rows.withColumn("char_accuracy", F.bround("char_accuracy", 6))


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def ocr_metrics(rows: DataFrame, by: list[str] | None = None, elapsed: float | None = None) -> DataFrame:
    """A1 over measured rows: error rows count. One aggregation; partial sums before the shuffle."""
    n, errors, length = F.count("*"), F.sum("levenshtein"), F.sum("gt_len")
    recognized = F.sum((F.col("error") == "").cast("long"))
    out = rows.groupBy(*(by or [])).agg(
        n.alias("total"), recognized.alias("recognized"), F.sum("exact_match").cast("long").alias("exact"),
        _ratio(F.sum("exact_match"), n).alias("line_accuracy"), F.coalesce(F.avg("char_accuracy"), F.lit(0.0)).alias("average_char_accuracy"),
        F.when(length > 0, F.greatest(F.lit(0.0), 1 - errors / length)).otherwise(0.0).alias("global_char_accuracy"),
        _ratio(errors, n).alias("average_levenshtein"), F.coalesce(errors, F.lit(0)).cast("long").alias("total_levenshtein"),
    )
    if elapsed is not None:
        out = out.withColumn("elapsed", F.lit(elapsed)).withColumn("speed", F.when(F.lit(elapsed) > 0, F.col("recognized") / F.lit(elapsed)).otherwise(0.0))
    return out


def length_errors(rows: DataFrame) -> DataFrame:
    """P10: predicted minus true length; the whole length for error rows."""
    diff = F.when(F.col("error") != "", -F.col("gt_len")).otherwise(F.col("pred_len") - F.col("gt_len"))
    return rows.withColumn("length_error", diff).withColumn("abs_length_error", F.abs(diff))


def segmentation_metrics(rows: DataFrame, by: list[str] | None = None) -> DataFrame:
    """A2 over rows with length errors: error rows are left out of all but the total."""
    fine = F.col("error") == ""
    n = F.count(F.when(fine, 1))
    total = lambda c: F.coalesce(F.sum(F.when(fine, F.col(c))), F.lit(0))
    return rows.groupBy(*(by or [])).agg(
        F.count("*").alias("total"), n.alias("evaluated"), F.count(F.when(fine & (F.col("length_error") == 0), 1)).alias("exact_length"),
        _ratio(F.count(F.when(fine & (F.col("length_error") == 0), 1)), n).alias("length_accuracy"),
        _ratio(total("abs_length_error"), n).alias("average_abs_length_error"), total("abs_length_error").cast("long").alias("total_abs_length_error"),
        _ratio(total("length_error"), n).alias("average_signed_length_error"), _ratio(total("abs_length_error"), total("gt_len")).alias("normalized_length_error"),
    )


def evaluate(tasks: DataFrame, preds: DataFrame, by: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """K5: report rows and metrics of predictions (task_id, pred, error) for tasks (task_id, image, gt)."""
    rows = measured(with_predictions(tasks, preds))
    return report_rows(rows), ocr_metrics(rows, by)


def evaluate_with_segmentator(tasks: DataFrame, lines: DataFrame, alphabet: Column, by: list[str] | None = None, **options) -> tuple[DataFrame, DataFrame]:
    """K5 through a segmentator: as ``evaluate``, with predictions read from class scores and cut scores through the cuts.

    Tasks have no error of their own here; those without a line in ``lines`` count as read with the empty text.
    """
    return evaluate(tasks, decode.predict_with_cuts(lines, alphabet, **options), by)
