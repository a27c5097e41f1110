"""Parameter sweeps and run analytics."""

from __future__ import annotations

from itertools import product

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from glyphflow.functions.scores import bound

#: Metrics for which less is better; the others are maximised (fixed values).
MINIMISED = ("average_levenshtein", "total_levenshtein", "average_abs_length_error", "total_abs_length_error", "average_signed_length_error", "normalized_length_error")


def trial_grid(spark: SparkSession, **values: list) -> DataFrame:
    """(trial, one column per parameter): the product of the values given. A trial table is an argument, so it is small."""
    rows = [(k, *v) for k, v in enumerate(product(*values.values()))]
    return spark.createDataFrame(rows, ["trial", *values])


def with_trials(rows: DataFrame, trials: DataFrame, defaults: dict[str, object] | None = None) -> DataFrame:
    """Every row under every trial; a null parameter (switched off) takes its default."""
    out = rows.crossJoin(F.broadcast(trials))
    for name, value in (defaults or {}).items():
        out = out.withColumn(name, F.coalesce(name, F.lit(value)))
    return out


def pending(trials: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Q3: the trials that a named study has not run yet."""
    return trials.join(done.select(*keys).distinct(), keys, "left_anti")


def leaderboard(metrics: DataFrame, metric: str, study: list[str] | None = None, trial: str = "trial") -> DataFrame:
    """Q1, T4: trials ranked within their study by a metric, the first trial on ties."""
    order = F.col(metric).asc() if metric in MINIMISED else F.col(metric).desc()
    return metrics.withColumn("place", F.row_number().over(W.partitionBy(*(study or [])).orderBy(order, trial)).cast("long"))


def best_trial(metrics: DataFrame, metric: str, study: list[str] | None = None, trial: str = "trial") -> DataFrame:
    """One row per study, by partial aggregation."""
    key = F.col(metric) if metric in MINIMISED else -F.col(metric)
    names = [c for c in metrics.columns if c not in (study or [])]
    best = metrics.groupBy(*(study or [])).agg(F.min(F.struct(key.alias("_k"), trial, *(F.col(c).alias(f"_{c}") for c in names))).alias("_b"))
    return best.select(*(study or []), *(F.col(f"_b._{c}").alias(c) for c in names))


def best_epochs(log: DataFrame, run: list[str], loss: str = "val_loss", train: str = "train_loss", ratio: float = 0.7) -> DataFrame:
    """Epochs with a strictly smaller loss than all before, their running best, and overfit flags."""
    w = W.partitionBy(*run).orderBy("epoch").rowsBetween(W.unboundedPreceding, -1)
    before = F.min(loss).over(w)
    best = F.coalesce(F.col(loss) < before, F.col(loss).isNotNull())
    return log.withColumn("is_best", best.cast("int")).withColumn("best_before", before).withColumn("overfit", (F.col(train) < ratio * F.col(loss)).cast("int"))


def plateau(log: DataFrame, run: list[str], patience: int, loss: str = "val_loss") -> DataFrame:
    """Q5: how many epochs ago the best loss was, and whether that is at least ``patience``."""
    flagged = best_epochs(log, run, loss)
    w = W.partitionBy(*run).orderBy("epoch").rowsBetween(W.unboundedPreceding, 0)
    since = F.col("epoch") - F.max(F.when(F.col("is_best") == 1, F.col("epoch"))).over(w)
    return flagged.withColumn("since_best", since).withColumn("plateau", (since >= patience).cast("int"))


def epoch_join(log: DataFrame, summary: DataFrame, run: list[str]) -> DataFrame:
    """Training log (epochs from 0) beside evaluation summary (epochs from 1)."""
    right = summary.withColumn("epoch", F.col("epoch") - 1)
    return log.join(right, [*run, "epoch"], "left")


def window_features(values: Column, radius: int) -> Column:
    """array<array<double>> of the values around each column, zeros outside."""
    near = lambda own, i: F.transform(F.sequence(i - radius, i + radius), lambda j: F.coalesce(F.when(j >= 0, F.get(own, j)), F.lit(0.0)).cast("double"))
    # The values are computed once for the array, not for each place that is read.
    return bound(values, lambda own: F.transform(own, lambda v, i: near(own, i)))


def column_classifier(rows: DataFrame, weight: str | None = None, **options) -> LogisticRegressionModel:
    """Q6: a classifier of score columns from (features array, label), weighted if asked."""
    data = rows.select(array_to_vector("features").alias("features"), F.col("label").cast("double").alias("label"), *([weight] if weight else []))
    return LogisticRegression(**({"weightCol": weight} if weight else {}), **options).fit(data)


def classify_columns(model: LogisticRegressionModel, rows: DataFrame) -> DataFrame:
    """``rows`` with p, the class probabilities."""
    out = model.transform(rows.withColumn("_f", array_to_vector("features")).drop("features").withColumnRenamed("_f", "features"))
    return out.withColumn("p", vector_to_array("probability")).drop("features", "rawPrediction", "probability", "prediction")
