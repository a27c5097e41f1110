"""Evaluating predictions as they arrive."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from glyphflow.operators.evaluate import measured, ocr_metrics

PREDICTIONS = "run_id string, epoch int, task_id long, pred string, error string"


def evaluate_stream(
    spark: SparkSession, incoming: str, tasks: DataFrame, rows_path: str, metrics_path: str, checkpoint: str,
    on_epoch: Callable[[DataFrame], None] | None = None, once: bool = True,
) -> StreamingQuery:
    """Prediction files (PREDICTIONS) are measured against the tasks and stored, a folder for each batch.

    A batch that runs again after a failure replaces its own folders.

    A prediction delivered again for the same run, epoch and task is dropped by an
    anti join with what is stored. Metrics are per micro-batch, run and epoch, with
    the batch number; ``on_epoch`` gets them too.
    """
    stream = spark.readStream.schema(PREDICTIONS).parquet(incoming)
    keys = ["run_id", "epoch", "task_id"]

    def step(batch: DataFrame, number: int) -> None:
        fresh = batch.dropDuplicates(keys)
        try:
            fresh = fresh.join(spark.read.parquet(rows_path).where(F.col("batch") != number).select(*keys), keys, "left_anti")
        except Exception as error:
            if "PATH_NOT_FOUND" not in str(error):
                raise
        joined = fresh.join(tasks, "task_id").withColumn("pred", F.coalesce("pred", F.lit(""))).withColumn("error", F.coalesce("error", F.lit("")))
        measured(joined).write.mode("overwrite").parquet(f"{rows_path}/batch={number}")
        stored = spark.read.parquet(f"{rows_path}/batch={number}")
        metrics = ocr_metrics(stored, ["run_id", "epoch"]).withColumn("batch", F.lit(number))
        metrics.drop("batch").write.mode("overwrite").parquet(f"{metrics_path}/batch={number}")
        if on_epoch:
            on_epoch(metrics)

    writer = stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(step)
    return (writer.trigger(availableNow=True) if once else writer).start()
