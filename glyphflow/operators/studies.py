"""Sweeps over preprocessing, and studies that are kept and resumed.

A trial has parameters of two levels: those of the geometry change the pixels, the
others only what is made of the scores. Every distinct geometry is prepared and
scored once per line; its trials then share the scores.
"""

from __future__ import annotations

import random
from collections.abc import Callable
from typing import Any

import numpy as np
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from glyphflow.functions import scores as S
from glyphflow.operators import decode, evaluate, images, sweep

#: Parameters that change the pixels of a prepared line.
GEOMETRY = images.Params().columns
ScoreFn = Callable[[np.ndarray], list[np.ndarray]]


def random_trials(spark: SparkSession, n: int, seed: int, conditions: dict[str, str] | None = None, **ranges: tuple[float, float] | list[Any]) -> DataFrame:
    """Q1, Q2: (trial, one column per parameter): ``n`` draws, uniform in a pair (low, high) or one of a list.

    ``conditions`` names for a parameter the switch that it hangs on; it is null where
    that is off. A trial's draws depend on the seed, its number and the name alone, so
    a longer study begins with the trials of a shorter one.
    """

    def draw(k: int, name: str, values: Any) -> Any:
        own = random.Random(f"{seed}:{k}:{name}")
        if isinstance(values, list):
            return own.choice(values)
        low, high = values
        return own.randint(low, high) if isinstance(low, int) and isinstance(high, int) else own.uniform(low, high)

    rows = [{name: draw(k, name, v) for name, v in ranges.items()} for k in range(n)]
    rows = [{name: None if (conditions or {}).get(name) and not r[conditions[name]] else v for name, v in r.items()} for r in rows]
    kinds = {bool: "boolean", int: "long", float: "double", str: "string"}
    example = {name: v[0] for name, v in ranges.items()}
    schema = ", ".join(["trial long", *(f"`{name}` {kinds[type(v)]}" for name, v in example.items())])
    return spark.createDataFrame([(k, *r.values()) for k, r in enumerate(rows)], schema)


def with_geometry(trials: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(geometries, trials): the distinct geometries, each named by its least trial, and the trials with theirs.

    A null parameter takes its default, so what is switched off makes no geometry of its own.
    """
    fixed = vars(images.Params())
    names = [c for c in GEOMETRY if c in trials.columns]
    full = trials.withColumns({c: F.coalesce(c, F.lit(fixed[c])) for c in names})
    least = F.min("trial").over(W.partitionBy(*names)) if names else F.min("trial").over(W.partitionBy(F.lit(0)))
    full = full.withColumn("geometry", least)
    return full.where("trial = geometry").select("geometry", *names), full


def scored_geometries(lines: DataFrame, trials: DataFrame, score_fn: ScoreFn, params: images.Params = images.Params()) -> DataFrame:
    """(line_id, p, error, all columns of ``trials``, geometry): scores of lines (line_id, h, w, pixels) under every trial.

    Pixels are prepared and scored once per line and geometry. The trial table is an
    argument and small; lines never meet in a shuffle here.
    """
    distinct, full = with_geometry(trials)
    dealt = lines.select("line_id", "h", "w", "pixels").crossJoin(F.broadcast(distinct))
    ready = images.preprocess_lines(dealt, params, keep=("line_id", "geometry"))
    scored = decode.score_lines(ready, score_fn, keep=("line_id", "geometry"))
    return scored.join(F.broadcast(full), "geometry")


def segmentation_rows(lengths: DataFrame, lines: DataFrame, trials: DataFrame, score_fn: ScoreFn, params: images.Params = images.Params(), threshold: float = 0.5, distance: int = 2) -> DataFrame:
    """Q2: (trial, line_id, gt_len, pred_len, error, length_error, ..) of lines (line_id, gt_len) under every trial.

    ``score_fn`` gives one cut score per step ([t, 1]). Trials may have cut_threshold and
    peak_distance; where these are absent or null, ``threshold`` and ``distance`` hold.
    A line without pixels has the error ``no_scores`` under every trial.
    """
    option = lambda name, value: F.coalesce(name, F.lit(value)) if name in trials.columns else F.lit(value)
    scored = scored_geometries(lines, trials, score_fn, params).withColumn("_s", F.flatten("p"))
    cuts = S.select_cut_peaks(F.col("_s"), option("cut_threshold", threshold), option("peak_distance", distance).cast("int"))
    found = scored.select("trial", "line_id", (F.size(cuts) + 1).alias("pred_len"), "error")
    every = lengths.select("line_id", "gt_len").crossJoin(F.broadcast(trials.select("trial")))
    rows = every.join(found, ["trial", "line_id"], "left")
    return evaluate.length_errors(rows.withColumn("error", F.coalesce("error", F.lit("no_scores"))).withColumn("pred_len", F.coalesce("pred_len", F.lit(0))))


def recognition_rows(tasks: DataFrame, lines: DataFrame, trials: DataFrame, score_fn: ScoreFn, alphabet: Column, params: images.Params = images.Params()) -> DataFrame:
    """Q1: measured rows (trial, line_id, gt, pred, error, ..) of tasks (line_id, gt) under every trial."""
    scored = scored_geometries(lines, trials, score_fn, params)
    read = decode.recognize(scored, alphabet).select("trial", "line_id", F.col("text").alias("pred"), "error")
    every = tasks.select("line_id", "gt").crossJoin(F.broadcast(trials.select("trial")))
    rows = every.join(read, ["trial", "line_id"], "left")
    return evaluate.measured(rows.withColumns({"pred": F.coalesce("pred", F.lit("")), "error": F.coalesce("error", F.lit("no_scores"))}))


def recorded(spark: SparkSession, root: str, study: str) -> DataFrame | None:
    """The ledger of a study, one row per trial that has run; None before its first."""
    try:
        return spark.read.parquet(root).where(F.col("study") == study)
    except AnalysisException as error:
        if error.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def resume(spark: SparkSession, root: str, study: str, trials: DataFrame, measure: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Q3: runs those of ``trials`` that the study at ``root`` lacks, and gives the ledger rows of all of ``trials``.

    ``measure`` turns a trial table into one row of metrics per trial. A trial has run
    if the ledger holds its number with the same parameters; with other ones it runs
    again and takes the old one's place. Every trial is a folder (study, trial) that is
    replaced as a whole when its job has finished, so a lost job leaves the ledger as it was
    and a repeated one adds no rows. Only trial tables are collected.
    """
    names = trials.columns
    done = recorded(spark, root, study)
    left = trials if done is None else trials.join(F.broadcast(done.select(*(F.col(c).alias(f"_{c}") for c in names))), [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in names], "left_anti")
    pending = left.collect()
    if pending:
        waiting = spark.createDataFrame(pending, trials.schema)
        measured = measure(waiting).join(F.broadcast(waiting), "trial").withColumn("study", F.lit(study))
        writer = measured.repartition("trial").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        writer.partitionBy("study", "trial").parquet(root)
    rows = recorded(spark, root, study)
    if rows is None:
        raise ValueError(f"study {study}: no trial to run and none recorded")
    rows = rows.withColumn("trial", F.col("trial").cast(trials.schema["trial"].dataType))
    return rows.join(F.broadcast(trials.select("trial")), "trial", "left_semi")


def best_params(ledger: DataFrame, metric: str, trials: DataFrame) -> DataFrame:
    """The one row of ``trials`` that the ledger ranks first, as the trial table of a final run."""
    first = sweep.best_trial(ledger.select("trial", metric), metric).select("trial")
    return trials.join(F.broadcast(first), "trial", "left_semi")
