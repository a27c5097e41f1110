"""Dense-label losses as aggregations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def cross_entropy_terms(rows: DataFrame, space_class: int | None = None, space_weight: float = 1.0) -> DataFrame:
    """From (.., p array, label): (.., ce, w) for valid labels."""
    valid = rows.where((F.col("label") >= 0) & (F.col("label") < F.size("p")))
    weight = F.when(F.col("label") == space_class, F.lit(space_weight)).otherwise(1.0) if space_class is not None else F.lit(1.0)
    return valid.withColumn("ce", -F.log(F.get("p", F.col("label")))).withColumn("w", weight)


def weighted_cross_entropy(terms: DataFrame, by: list[str] | None = None, weighted: bool = True) -> DataFrame:
    """The mean over valid labels, or the weighted sum over at least 1; null without a valid label."""
    loss = F.sum(F.col("w") * F.col("ce")) / F.greatest(F.lit(1.0), F.sum("w")) if weighted else F.avg("ce")
    return terms.groupBy(*(by or [])).agg(loss.alias("loss"), F.count("*").alias("n"))


def projection_loss(logits: Column, targets: Column, kind: str = "mse", positive_weight: float = 1.0) -> Column:
    """Array of per-value losses of logits against 0..1 targets, weighted by 1 + (pw - 1) * target."""

    def one(x: Column, t: Column) -> Column:
        d = 1 / (1 + F.exp(-x)) - t
        if kind == "mse":
            loss = d * d
        elif kind == "smooth_l1":
            loss = F.when(F.abs(d) < 1, 0.5 * d * d).otherwise(F.abs(d) - 0.5)
        elif kind == "bce":
            loss = F.greatest(x, F.lit(0.0)) - x * t + F.log1p(F.exp(-F.abs(x)))
        else:
            raise ValueError(f"unknown loss {kind!r}")
        return loss * (1 + (positive_weight - 1) * t)

    return F.zip_with(logits, targets, one)


def mean_over_columns(rows: DataFrame, losses: str, by: list[str] | None = None) -> DataFrame:
    """The mean over all columns of all lines: sums per line first, then one aggregation."""
    total, n = F.aggregate(losses, F.lit(0.0), lambda a, x: a + x), F.size(losses)
    return rows.select(*(by or []), total.alias("_s"), n.alias("_n")).groupBy(*(by or [])).agg((F.sum("_s") / F.sum("_n")).alias("loss"), F.sum("_n").cast("long").alias("n"))


def epoch_loss(batches: DataFrame, batch: str, loss: str, by: list[str], max_batches: int | None = None) -> DataFrame:
    """A10: the mean of batch means, over the first ``max_batches`` batches if given."""
    own = batches.where(F.col(batch) < max_batches) if max_batches is not None else batches
    means = own.groupBy(*by, batch).agg(F.avg(loss).alias("_m"))
    return means.groupBy(*by).agg(F.avg("_m").alias("loss"), F.count("*").alias("batches"))


def max_pooled(cells: DataFrame, height: int, by: list[str] | None = None) -> DataFrame:
    """Label maps (line_id, x, y, c) to one label per column: windows of four rows, one row padded, then their greatest; rows past the last window are not read."""
    last = 4 * ((height - 2) // 4) + 2
    return cells.where(F.col("y") <= last).groupBy(*(by or ["line_id"]), "x").agg(F.max("c").alias("label"))


def resized_maps(values: Column, old: tuple[int, int, int], size: tuple[int, int]) -> Column:
    """Target maps of (channels, height, width), row by row, at another height and width: bilinear, half-pixel centres, kept within 0..1."""
    channels, h, w = old
    th, tw = size

    def at(k: Column) -> Column:
        channel, y, x = F.floor(k / (th * tw)), F.floor(k / tw) % th, k % tw
        sy = F.greatest(F.lit(0.0), F.least(F.lit(h - 1.0), (y + 0.5) * h / th - 0.5))
        sx = F.greatest(F.lit(0.0), F.least(F.lit(w - 1.0), (x + 0.5) * w / tw - 0.5))
        fy, fx = sy - F.floor(sy), sx - F.floor(sx)
        cell = lambda dy, dx: F.get(values, ((channel * h + F.least(F.floor(sy) + dy, F.lit(h - 1))) * w + F.least(F.floor(sx) + dx, F.lit(w - 1))).cast("int"))
        mixed = cell(0, 0) * (1 - fy) * (1 - fx) + cell(0, 1) * (1 - fy) * fx + cell(1, 0) * fy * (1 - fx) + cell(1, 1) * fy * fx
        return F.greatest(F.lit(0.0), F.least(F.lit(1.0), mixed))

    return F.transform(F.sequence(F.lit(0), F.lit(channels * th * tw - 1)), at)
